"""Operator 5: media columns of interleaved document sequences.

HTML is parsed into an ordered array of structs, each a text or a reference to
a medium with its caption. References carry the digest of a payload; a join on
digests resolves them against a media table that holds each payload once.
Positions come back in order, and captions stay with their references: a
figure's caption belongs to the medium just before it, else to the figure's
next one, and one that no medium takes is text.

Payloads are stored losslessly as binary PGM images: rows of 64 samples of 8
bits. Features are computed from samples that were read back from the stored
form.

Cases: any string is a page, read in linear time (``markup`` says what becomes of
malformed tags); a null text or page is empty, and an empty text's payload is one row of
zeros; texts are stored whole; equal payloads are one medium, however many
references there are; a reference whose digest is unknown stays, with null media
columns; an empty table gives an empty result; other columns of the input are
ignored unless named in ``keep``.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tryloom.llm.chunks import bounded, column
from tryloom.llm.markup import scan
from tryloom.llm.shared import table, written

#: Samples in a row of a stored image.
WIDTH = 64
#: References to one payload that a group may hold, if they are not over this share of all; so at most so many payloads are dealt to several groups.
GROUP_ROWS, HOT_SHARE = 1000, 10_000
#: The scheme of references by digest.
SCHEME = "sha256:"

ELEMENT = pa.struct([("position", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("ref", pa.string()), ("caption", pa.string())])
_ELEMENT = "struct<position:int,kind:string,text:string,ref:string,caption:string>"


class Sequence:
    """Texts and media references of a page, in order, from its tags and text as ``markup.scan`` gives them."""

    MEDIA = {"img": "image", "audio": "audio", "video": "video", "source": "source"}
    SILENT = {"script", "style", "template", "noscript"}
    BLOCKS = {"p", "div", "br", "li", "ul", "ol", "tr", "td", "th", "table", "section", "article", "figure", "h1", "h2", "h3", "h4", "h5", "h6", "pre", "blockquote", "hr"}

    def __init__(self):
        self.out: list[dict] = []
        self.held: list[str] = []
        self.silent = 0
        self.caption: list[str] | None = None
        self.captioned = False
        self.waiting: str | None = None
        self.figures = 0

    def add(self, kind: str, **fields) -> None:
        self.out.append({"position": len(self.out), "kind": kind, "text": None, "ref": None, "caption": None} | fields)

    def flush(self) -> None:
        text, self.held = " ".join("".join(self.held).split()), []
        if text:
            self.add("text", text=text)

    def close_caption(self) -> None:
        """An open caption goes with the medium just before it, else with the figure's next one."""
        if self.caption is None:
            return
        text, self.caption = " ".join("".join(self.caption).split()), None
        if not text:
            return
        if self.out and self.out[-1]["ref"] is not None:
            self.out[-1]["caption"] = text
        else:
            self.drop_waiting()
            self.waiting = text
            if not self.figures:
                self.drop_waiting()

    def drop_waiting(self) -> None:
        """A caption that no medium took is text."""
        if self.waiting:
            self.held.append(self.waiting)
            self.waiting = None
            self.flush()

    def finish(self) -> None:
        self.close_caption()
        self.flush()
        self.drop_waiting()

    def block(self, tag: str) -> None:
        if self.caption is not None and not self.captioned:
            return  # a block that opens within an empty caption belongs to it
        self.close_caption()
        self.flush()
        if tag == "figure":
            self.drop_waiting()

    def opened(self, tag: str, attributes: dict[str, str | None], alone: bool) -> None:
        if tag in self.SILENT:
            self.silent += not alone
        elif tag in self.MEDIA:
            if attributes.get("src"):
                self.close_caption()
                self.flush()
                self.add(self.MEDIA[tag], ref=attributes["src"], caption=self.waiting or attributes.get("alt") or attributes.get("title"))
                self.waiting = None
        elif tag == "figcaption":
            self.close_caption()
            self.flush()
            self.caption, self.captioned = [], False
        elif tag in self.BLOCKS:
            self.block(tag)
            self.figures += tag == "figure"

    def closed(self, tag: str) -> None:
        if tag in self.SILENT:
            self.silent = max(0, self.silent - 1)
        elif tag == "figcaption":
            self.close_caption()
        elif tag == "figure":
            self.close_caption()
            self.flush()
            self.drop_waiting()
            self.figures = max(0, self.figures - 1)
        elif tag in self.BLOCKS and self.caption is None:
            self.block(tag)

    def text(self, data: str) -> None:
        if self.silent:
            return
        if self.caption is None:
            self.held.append(data)
        else:
            self.caption.append(data)
            self.captioned = self.captioned or bool(data.strip())


def sequence(html: str | None) -> list[dict]:
    page = Sequence()
    scan(html or "", page.opened, page.closed, page.text)
    page.finish()
    return page.out


def sequences(pages: DataFrame, keep: list[str], html: str = "html") -> DataFrame:
    """``keep`` and ``elements``: the ordered texts and references of each page."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([sequence(x.as_py()) for x in column(batch, html)], pa.list_(ELEMENT))
            yield pa.RecordBatch.from_arrays([*(column(batch, k) for k in keep), found], names=[*keep, "elements"])

    fields = ", ".join(f"`{k}` {pages.schema[k].dataType.simpleString()}" for k in keep)
    return pages.select(*keep, html).mapInArrow(parse, f"{fields}, elements array<{_ELEMENT}>")


def stored(payload: bytes) -> bytes:
    """A payload of whole rows as a binary PGM image."""
    return b"P5\n%d %d\n255\n" % (WIDTH, len(payload) // WIDTH) + payload


def samples(image: bytes) -> np.ndarray:
    """The samples of a binary PGM image, by row."""
    kind, shape, most, data = image.split(b"\n", 3)
    width, height = map(int, shape.split())
    if kind != b"P5" or most != b"255" or len(data) != width * height:
        raise ValueError("not an 8-bit PGM image")
    return np.frombuffer(data, np.uint8).reshape(height, width)


def features(image: np.ndarray) -> str:
    """Size, mean, and the shares of eight ranges of sample values in thousandths."""
    counts = np.bincount(image.reshape(-1), minlength=256)
    shares = counts.reshape(8, 32).sum(axis=1) * 1000 // image.size
    return f"{image.shape[1]}x{image.shape[0]};mean={int(counts @ np.arange(256)) / image.size:.3f};hist=" + ",".join(map(str, shares.tolist()))


_MEDIA = [("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("media", pa.binary())]


def media(texts: DataFrame, with_media: bool = True) -> DataFrame:
    """The media table of a ``text`` column: ``digest``, one row a payload, its measures and, if asked, ``media``.

    A text's payload is its UTF-8 bytes with zeros up to whole rows, one at
    least; ``digest`` is that of the unpadded bytes.
    """
    kinds = _MEDIA if with_media else _MEDIA[:-1]
    names = ["digest"] + [k for k, _ in kinds]

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches):
            out: list[list] = [[] for _ in names]
            for text in column(batch, "text"):
                data = (text.as_py() or "").encode("utf-8", "surrogatepass")
                rows = max(1, -(-len(data) // WIDTH))
                image = stored(data.ljust(rows * WIDTH, b"\0"))
                read = samples(image)
                payload = read.tobytes()
                row = [hashlib.sha256(data).digest(), len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(image), hashlib.sha256(image).hexdigest(), features(read), image]
                for values, value in zip(out, row, strict=False):
                    values.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, [pa.binary(), *(t for _, t in kinds)], strict=True)], names=names)

    schema = "digest binary, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string" + ", media binary" * with_media
    # Copies meet in one row a digest; each task reduces its own first.
    firsts = [F.first(k).alias(k) for k in names[1:]]
    return texts.select("text").mapInArrow(store, schema).groupBy("digest").agg(*firsts)


def digest(text: Column) -> Column:
    """The digest of a text's payload."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256))


def elements(found: DataFrame, key: str) -> DataFrame:
    """One row for each element of ``found`` (``key``, ``elements``), with the ``digest`` that it refers to."""
    rows = found.select(key, F.explode_outer("elements").alias("e")).select(key, "e.*")
    return rows.withColumn("digest", F.when(F.startswith("ref", F.lit(SCHEME)), F.unhex(F.substring("ref", len(SCHEME) + 1, 64))))


def resolved(rows: DataFrame, payloads: DataFrame, key: str) -> DataFrame:
    """``rows`` (as ``elements`` gives them, read twice) with the columns of the media that they refer to.

    References to one payload are dealt to as many groups as their count asks
    for; ``HOT_SHARE`` bounds the payloads of which that is so. Rows without a
    reference are spread by their key.
    """
    referred = rows.where("digest IS NOT NULL").groupBy("digest").agg(F.count("*").alias("_n"))
    most = referred.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("n")).first()["n"] // HOT_SHARE
    hot = F.broadcast(referred.where(F.col("_n") > max(most, GROUP_ROWS)).select("digest", F.ceil(F.col("_n") / max(most, GROUP_ROWS)).cast("int").alias("_groups")))
    spread = F.pmod(F.xxhash64(key, "position"), F.when(F.col("digest").isNull(), 1 << 20).otherwise(F.coalesce("_groups", F.lit(1)))).cast("int")
    left = rows.join(hot, "digest", "left").withColumn("_group", spread).drop("_groups")
    right = payloads.join(hot, "digest", "left").withColumn("_group", F.explode(F.sequence(F.lit(0), F.coalesce("_groups", F.lit(1)) - 1))).drop("_groups")
    return left.join(right, ["digest", "_group"], "left").drop("_group")


def aligned(rows: DataFrame, key: str) -> DataFrame:
    """The rows of ``resolved`` as one sequence for each ``key``, in order of position."""
    element = F.struct("position", *[c for c in rows.columns if c not in (key, "position")])
    return rows.groupBy(key).agg(F.array_sort(F.collect_list(F.when(F.col("position").isNotNull(), element)), lambda a, b: a["position"] - b["position"]).alias("elements"))


def page_of(text: Column, name: Column) -> Column:
    """A page of a text in two paragraphs, with the text's payload as a figure between them and once more behind."""
    quoted = lambda t: F.replace(F.replace(t, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    reference = F.concat(F.lit("<img src='"), F.lit(SCHEME), F.lower(F.hex(digest(text))), F.lit("'>"))
    text, half = F.coalesce(text, F.lit("")), (F.length(F.coalesce(text, F.lit(""))) / 2).cast("int")
    figure = F.concat(F.lit("<figure>"), reference, F.lit("<figcaption>"), name, F.lit("</figcaption></figure>"))
    return F.concat(F.lit("<p>"), quoted(F.substring(text, F.lit(1), half)), F.lit("</p>"), figure, F.lit("<p>"), quoted(F.substring(text, half + 1, F.length(text))), F.lit("</p>"), reference)


def op5_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text of ``documents`` as a page that shows it as a medium between its own paragraphs.

    The media columns are those of the captioned element of the aligned
    sequence. ``position`` is its place, ``n_elements`` the sequence's length
    and ``text_chars`` the characters of its texts.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("row", F.monotonically_increasing_id())
    name = F.concat(F.lit("document "), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    pages = docs.select(F.struct("row", "doc_id").alias("at"), page_of(F.col("text"), name).alias("html"))
    # Texts stay where they are; what travels of a text element is its size.
    rows = written(elements(sequences(pages, ["at"]), "at").select("at", "position", "kind", "caption", "digest", F.length("text").alias("chars")), "elements")
    whole = aligned(resolved(rows, media(docs, with_media=False), "at"), "at")
    one = F.get(F.filter("elements", lambda e: e["caption"].isNotNull()), F.lit(0))
    sums = F.aggregate("elements", F.lit(0).cast("long"), lambda n, e: n + F.coalesce(e["chars"], F.lit(0)))
    names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "caption", "position"]
    return whole.withColumn("one", one).select("at.doc_id", *[F.col("one")[n].alias(n) for n in names], F.size("elements").alias("n_elements"), sums.alias("text_chars"))


def page_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page of ``pages``: how many texts and media its sequence has, how many of these are captioned, and a digest of the whole in order."""
    found = sequences(table(spark, sf_dir, "pages"), ["page_id"])
    of = lambda c, good: F.size(F.filter("elements", lambda e: good(e[c])))
    whole = F.transform("elements", lambda e: F.concat_ws("\x1f", e["position"].cast("string"), e["kind"], F.coalesce(e["text"], e["ref"]), F.coalesce(e["caption"], F.lit(""))))
    return found.select("page_id", of("text", lambda x: x.isNotNull()).alias("n_texts"), of("ref", lambda x: x.isNotNull()).alias("n_media"), of("caption", lambda x: x.isNotNull()).alias("n_captions"), F.sha2(F.array_join(whole, "\x1e"), 256).alias("sequence_sha256"))
