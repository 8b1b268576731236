"""Operator 13: WARC archives, written and read sequentially.

``archived`` writes a table of pages as WARC/1.1 files, one gzip member for each
record, and returns the manifest of the files. Of pages with equal payloads of at
least ``least`` bytes, those with the smallest id become ``response`` records and
the others ``revisit`` records, which hold no payload but name the response. A
task names its files by itself, so what a lost or repeated attempt has left is in
no manifest and never read.

``records`` reads the files of a manifest back, each from its start to its end in
one task: one gzip member after the other is decompressed incrementally, its
record's header is read, its block framed by the content length, and both
digests verified. A member that breaks off, a record that is shorter or longer
than it says, or a digest that differs is an error that names file and offset.

Only ids and digests of pages are grouped; pages themselves are shuffled only if
the payloads that occur more than once are too many to be broadcast.

Cases: a null payload is empty; a null url, or a table without urls, leaves it out; a url keeps any
character (percent-encoded in the header); a null id comes after all others, and
a payload that only such rows have has responses with a null id; rows that repeat
an id with the same payload are of the same type; a payload takes any length that
a value can have; an empty table gives no file and no record; other columns of
the input are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tryloom.llm.shared import folder as own_folder
from tryloom.llm.shared import id_side, table, written

VERSION = b"WARC/1.1"
#: The profile of records that repeat a payload (a fixed value).
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: The time that records carry, as pages have none.
DATE = "2020-01-01T00:00:00Z"
#: Compressed bytes after which a task begins another file, and bytes that are read or decompressed at once.
ROLL, CHUNK = 256 << 20, 1 << 18
#: A header beyond this is no header.
MOST_HEADER = 1 << 20
GZIP = 31

MANIFEST = "archive string, n_records long, n_bytes long"
RECORD = "archive string, record_offset long, record_type string, record_id string, refers_to string, target_uri string, page_id string, refers_to_page_id string, content_length long, payload_bytes long, payload_digest string, payload binary"
_RECORD = pa.schema([("archive", pa.string()), ("record_offset", pa.int64()), ("record_type", pa.string()), ("record_id", pa.string()), ("refers_to", pa.string()), ("target_uri", pa.string()), ("page_id", pa.string()), ("refers_to_page_id", pa.string()), ("content_length", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())])


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or address, and the path on it."""
    local = re.match(r"file:/*(/.*)", path)
    return pafs.FileSystem.from_uri(path) if "://" in path and not local else (pafs.LocalFileSystem(), local[1] if local else path)


def record_id(page_id: str | None, digest: str) -> str:
    """Names a record by its page and payload, so that a reference can be made before its record is written."""
    return f"<urn:page:{quote(page_id or '', safe='')}:{digest}>"


def page_of(name: str) -> str | None:
    return unquote(re.fullmatch(r"<urn:page:(.*):[A-Z2-7]{32}>", name)[1]) or None


def record(kind: str, page_id: str | None, url: str | None, payload: bytes, response_id: str | None) -> bytes:
    """One record: header, block and the two line feeds that end it."""
    digest = base32_sha1(payload)
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + payload if kind == "response" else http
    fields = {"WARC-Type": kind, "WARC-Record-ID": record_id(page_id, digest), "WARC-Date": DATE}
    if url is not None:
        fields["WARC-Target-URI"] = quote(url, safe=":/?#[]@!$&'()*+,;=-._~", errors="surrogatepass")
    if kind == "revisit":
        fields |= {"WARC-Profile": PROFILE, "WARC-Refers-To": record_id(response_id, digest)}
    fields |= {"WARC-Payload-Digest": f"sha1:{digest}", "WARC-Block-Digest": f"sha1:{base32_sha1(block)}", "Content-Type": "application/http; msgtype=response", "Content-Length": str(len(block))}
    head = "".join(f"{k}: {v}\r\n" for k, v in fields.items()).encode()
    return b"".join((VERSION, b"\r\n", head, b"\r\n", block, b"\r\n\r\n"))


def member(data: bytes, level: int = 6) -> bytes:
    """``data`` as one gzip member."""
    squeeze = zlib.compressobj(level, zlib.DEFLATED, GZIP)
    return squeeze.compress(data) + squeeze.flush()


def typed(pages: DataFrame, least: int = 0) -> DataFrame:
    """``page_id``, ``url``, ``payload`` (bytes), ``record_type`` and ``response_id`` (for revisits) of each page."""
    payload = F.coalesce("html", F.lit("")).cast("binary")
    url = F.col("url") if "url" in pages.columns else F.lit(None).cast("string")
    rows = pages.select("page_id", url.alias("url"), payload.alias("payload"), F.unhex(F.sha2(payload, 256)).alias("digest"))
    several = rows.where(F.octet_length("payload") >= least).groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")).where("n > 1").select("digest", "first_id")
    firsts = written(several, "warc-firsts").withColumn("known", F.lit(True))
    joined = rows.join(id_side(firsts), "digest", "left")
    again = F.col("known") & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    return joined.select("page_id", "url", "payload", F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("first_id")).alias("response_id"))


def archived(pages: DataFrame, folder: str, least: int = 0, roll: int = ROLL) -> DataFrame:
    """Writes ``pages`` (``page_id``, ``html`` and, if there, ``url``) below ``folder``, which all executors share, and returns the manifest."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = opened(folder)
        system.create_dir(base, recursive=True)
        out, name, count, size = None, "", 0, 0

        def close() -> pa.RecordBatch:
            nonlocal out
            out.close()
            out = None
            return pa.RecordBatch.from_pydict({"archive": [f"{folder}/{name}"], "n_records": [count], "n_bytes": [size]})

        for batch in batches:
            for i in range(batch.num_rows):
                page_id, url, payload, kind, response = (batch.column(k)[i].as_py() for k in range(5))
                if out is None:
                    name, count, size = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = system.open_output_stream(os.path.join(base, name), compression=None)
                data = member(record(kind, page_id, url, payload, response))
                out.write(data)
                count, size = count + 1, size + len(data)
                if size >= roll:
                    yield close()
        if out is not None:
            yield close()

    ids = [F.col(c).cast("string") for c in ("page_id", "response_id")]
    rows = typed(pages, least).select(ids[0], "url", "payload", "record_type", ids[1])
    # The manifest is written down at once: reading it again must not write the archives again.
    return written(rows.mapInArrow(write, MANIFEST), "warc-manifest")


class Broken(ValueError):
    """An archive that does not hold what it says."""


class _Members:
    """The decompressed bytes of one gzip member after the other, as they are asked for."""

    def __init__(self, source, chunk: int = CHUNK):
        self.source, self.chunk = source, chunk
        self.raw, self.at = b"", 0
        self.inflate = None
        self.ready = b""

    def more(self) -> bool:
        """Reads on if nothing is left of what was read."""
        if not self.raw:
            self.raw = self.source.read(self.chunk)
        return bool(self.raw)

    def begin(self) -> bool:
        """Opens the next member; false at the end of the file."""
        if not self.more():
            return False
        self.inflate, self.ready = zlib.decompressobj(GZIP), b""
        return True

    def some(self) -> bytes:
        """Some more bytes of the member, none at its end."""
        while not self.ready and not self.inflate.eof:
            if not self.inflate.unconsumed_tail and not self.more():
                raise Broken("the file breaks off inside a member")
            fed = self.inflate.unconsumed_tail or self.raw
            try:
                self.ready = self.inflate.decompress(fed, self.chunk)
            except zlib.error as error:
                raise Broken(f"no gzip member: {error}") from error
            left = self.inflate.unused_data if self.inflate.eof else self.inflate.unconsumed_tail
            self.at += len(fed) - len(left)
            self.raw = left if self.inflate.eof else b""
        out, self.ready = self.ready, b""
        return out

    def until(self, mark: bytes, most: int) -> bytes:
        """The bytes up to ``mark``, which is passed over."""
        held = b""
        while mark not in held:
            got = self.some()
            if not got or len(held) > most:
                raise Broken("a header does not end")
            held += got
        found, _, self.ready = held.partition(mark)
        return found

    def exactly(self, n: int) -> Iterator[bytes]:
        """The next ``n`` bytes in parts."""
        while n:
            got = self.some()
            if not got:
                raise Broken("a block is shorter than its content length")
            got, self.ready = got[:n], got[n:]
            n -= len(got)
            yield got


def _fields(head: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in head.decode().split("\r\n")[1:])}


def read_archive(source, archive: str) -> Iterator[dict]:
    """The records of one archive in order, each with its offset. Raises ``Broken`` where it is damaged."""
    members = _Members(source)
    while True:
        offset = members.at
        try:
            if not members.begin():
                return
            yield {"archive": archive, "record_offset": offset} | _one(members)
        except Broken as error:
            raise Broken(f"{archive} at {offset}: {error}") from None


def _one(members: _Members) -> dict:
    head = members.until(b"\r\n\r\n", MOST_HEADER)
    if not head.startswith(b"WARC/1."):
        raise Broken("no record begins here")
    fields = _fields(head)
    block, digest = [], hashlib.sha1()
    for part in members.exactly(int(fields["content-length"])):
        digest.update(part)
        block.append(part)
    if b"".join(members.exactly(4)) != b"\r\n\r\n" or members.some():
        raise Broken("a record is longer than its content length")
    block = b"".join(block)
    if fields["warc-block-digest"] != f"sha1:{base64.b32encode(digest.digest()).decode()}":
        raise Broken("the block's digest differs")
    http, _, payload = block.partition(b"\r\n\r\n")
    payload_digest, said = fields["warc-payload-digest"].removeprefix("sha1:"), int(_fields(http)["content-length"])
    kind, refers = fields["warc-type"], fields.get("warc-refers-to")
    if kind == "response" and (len(payload) != said or base32_sha1(payload) != payload_digest):
        raise Broken("the payload's digest or length differs")
    uri = fields.get("warc-target-uri")
    return {
        "record_type": kind, "record_id": fields["warc-record-id"], "refers_to": refers, "target_uri": uri and unquote(uri, errors="surrogatepass"), "page_id": page_of(fields["warc-record-id"]), "refers_to_page_id": refers and page_of(refers),
        "content_length": int(fields["content-length"]), "payload_bytes": said, "payload_digest": payload_digest, "payload": payload if kind == "response" else None,
    }


def records(manifest: DataFrame, with_payload: bool = True) -> DataFrame:
    """The records of the archives of a manifest (``archive``), verified; a revisit has no payload of its own."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive in batch.column(0).to_pylist():
                system, path = opened(archive)
                out, size = [], 0
                with system.open_input_stream(path, compression=None, buffer_size=CHUNK) as source:
                    for row in read_archive(source, archive):
                        size += len(row["payload"] or b"") + 500
                        out.append(row if with_payload else row | {"payload": None})
                        if size >= 8 << 20:
                            yield pa.RecordBatch.from_pylist(out, _RECORD)
                            out, size = [], 0
                yield pa.RecordBatch.from_pylist(out, _RECORD)

    # An archive is a task's work; rows of the manifest are dealt by their names.
    session = manifest.sparkSession
    tasks = max(session.sparkContext.defaultParallelism, int(session.conf.get("spark.sql.shuffle.partitions")))
    return manifest.select("archive").repartition(tasks, "archive").mapInArrow(read, RECORD)


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of ``pages`` through an archive and back."""
    pages = table(spark, sf_dir, "pages")
    kind = pages.schema["page_id"].dataType
    found = records(archived(pages, f"{own_folder(spark)}/warc-{uuid.uuid4().hex}"), with_payload=False)
    return found.select(F.col("page_id").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to_page_id").cast(kind).alias("refers_to"))


#: Five hexadecimal digits are four digits of base 32.
ORACLE_SQL = {
    "op13_warc": """
WITH pages_ AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
firsts AS (SELECT *, min(page_id) OVER (PARTITION BY html) AS first_id, sha1(html) AS hex FROM pages_)
SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes,
       list_aggregate(list_transform(range(8), lambda i: list_aggregate(list_transform([15, 10, 5, 0], lambda s:
           substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(hex, (5 * i + 1)::INT, 5))::BIGINT >> s) & 31) + 1)::INT, 1)), 'string_agg', '')), 'string_agg', '') AS payload_digest,
       CASE WHEN page_id IS NOT DISTINCT FROM first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id IS NOT DISTINCT FROM first_id THEN NULL ELSE first_id END AS refers_to
FROM firsts
"""
}
