"""Unified diffs as tables, and what kind of change each one is.

A diff is taken apart by splitting it in front of its headers, so its parts
come from one row without a shuffle. Lines end at line feeds alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tryloom.functions.scalars import bound
from tryloom.schemas import LOCI

KEY = ["corpus_id", "seq"]

# What decides whether text is prose.
#: Suffixes of files that are prose.
PROSE_SUFFIXES = (".md", ".tex", ".bib", ".txt", ".rst", ".bst", ".cls")
#: Commands after which a cartouche is prose.
DOC_COMMANDS = ("text_raw", "text", "txt", "chapter", "subsubsection", "subsection", "section", "subparagraph", "paragraph")
#: Commands that cannot stand in a prose cartouche, at a line's beginning.
PROOF_COMMANDS = (
    "theory", "imports", "begin", "end", "lemma", "theorem", "corollary", "proposition", "definition", "fun", "primrec",
    "abbreviation", "datatype", "type_synonym", "locale", "instantiation", "proof", "qed", "next", "by", "apply", "done",
    "declare", "notation", "interpretation", "context", "sublocale", "termination", "inductive",
)
#: Globs of source files.
SOURCE_GLOBS = ("*.thy", "*ROOT", "*ROOTS")

#: Lines whose projections are gathered at once.
LINES_A_BLOCK = 64

_WORD_END = r"(?![\w'])"
_OPEN, _CLOSE = r"\<open>", r"\<close>"
_TOKEN = r"(?U)\(\*|\*\)|\\<open>|\\<close>|\\<comment>|(?<![\w'])(?:" + "|".join(DOC_COMMANDS) + ")" + _WORD_END
_RESYNC = r"(?U)^(?:" + "|".join(PROOF_COMMANDS) + ")" + _WORD_END
_HUNK = r"^@@ -\d+(?:,\d+)? \+\d+(?:,\d+)? @@ ?(.*)"
_RANGES = r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@"
_HEADER = r"^diff --git a/(.*?) b/(.*)$"


def lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def parent(path: Column) -> Column:
    """The directory of a path, ``.`` if it names none."""
    return F.when(F.contains(path, F.lit("/")), F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.lit("."))


def is_source(path: Column, globs: tuple[str, ...] = SOURCE_GLOBS) -> Column:
    """Whether a path matches one of the globs; an asterisk also crosses slashes."""
    quoted = ["".join(".*" if c == "*" else "." if c == "?" else rf"\Q{c}\E" for c in g) for g in globs]
    return path.rlike("^(?:" + "|".join(quoted) + ")$")


def other_changes(rows: DataFrame, globs: tuple[str, ...] = SOURCE_GLOBS) -> DataFrame:
    """Changed files outside of the globs by record, from numstat rows (``path``, ``added``, ``deleted`` as text).

    Counts of binary files (``-``) are null; a record without such files has no row.
    """
    number = lambda c: F.expr(f"try_cast(nullif({c}, '-') AS INT)")
    kept = rows.where(~is_source(F.col("path"), globs))
    return kept.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("path", number("added").alias("added"), number("deleted").alias("deleted")))).alias("other_changed"))


def _bodies(diff: Column) -> Column:
    """The part of each file of a diff."""
    return F.filter(F.split(diff, r"(?m)^(?=diff --git )", -1), lambda p: F.startswith(p, F.lit("diff --git ")))


def _hunk_parts(body: Column) -> Column:
    return F.filter(F.split(body, r"(?m)^(?=@@)", -1), lambda p: F.startswith(p, F.lit("@@")))


def _hunk_lines(hunk: Column, header: Column) -> Column:
    """The lines of a hunk behind its header."""
    after = F.substring(hunk, F.length(header) + 2, F.length(hunk))
    # The piece behind a hunk's last line feed is no line.
    body = F.filter(lines(F.regexp_replace(after, r"\n\z", "")), lambda ln: ln.rlike("^[ +-]") | (ln == ""))
    return F.when(after == "", F.array().cast("array<string>")).otherwise(body)


def _suffix(path: Column) -> Column:
    name = F.regexp_extract(path, "[^/]*$", 0)
    return F.when(F.contains(name, F.lit(".")), F.regexp_extract(name, r"\.[^.]*$", 0)).otherwise(F.lit(""))


def files(attempts: DataFrame) -> DataFrame:
    """One row a file of each diff: ``file_no``, ``path_old``, ``path_new``, ``suffix`` and ``body``."""
    rows = attempts.where(F.contains("diff", F.lit("diff --git "))).select(*KEY, F.posexplode(_bodies(F.col("diff"))).alias("file_no", "body"))
    head = F.substring_index("body", "\n", 1)
    old, new = F.regexp_extract(head, _HEADER, 1), F.regexp_extract(head, _HEADER, 2)
    named = rows.withColumns({"path_old": F.when(old == "", head).otherwise(old), "path_new": F.when(new == "", head).otherwise(new)})
    return named.withColumn("suffix", _suffix(F.col("path_new")))


def hunks(found: DataFrame) -> DataFrame:
    """One row a hunk of ``files``: header, context, the four ranges, and its lines (context, added, deleted)."""
    rows = found.select(*KEY, "file_no", "path_new", "suffix", F.posexplode(_hunk_parts(F.col("body"))).alias("hunk_no", "hunk"))
    header = F.substring_index("hunk", "\n", 1)
    number = lambda i: F.expr(f"try_cast(nullif(regexp_extract(header, '{_RANGES.replace(chr(92), chr(92) * 2)}', {i}), '') AS INT)")
    out = rows.withColumn("header", header).withColumns({
        "ctx": F.regexp_extract("header", _HUNK, 1),
        "old_start": number(1),
        "old_len": F.coalesce(number(2), F.lit(1)),
        "new_start": number(3),
        "new_len": F.coalesce(number(4), F.lit(1)),
        "lines": _hunk_lines(F.col("hunk"), F.col("header")),
    })
    return out.drop("hunk")


def diff_lines(found: DataFrame) -> DataFrame:
    """One row a line of ``hunks``: its sign and text."""
    rows = found.select(*KEY, "file_no", "hunk_no", F.posexplode("lines").alias("line_no", "raw"))
    return rows.select(*KEY, "file_no", "hunk_no", "line_no", F.when(F.col("raw") == "", " ").otherwise(F.left("raw", F.lit(1))).alias("sign"), F.substring("raw", 2, 1 << 30).alias("text"))


def stat(found: DataFrame) -> DataFrame:
    """Added and deleted lines by file, with a total (null ``file_no``) for each record."""
    per_file = _stat_rows(found)
    return per_file.groupBy(*KEY, "file_no").agg(F.sum("added").alias("added"), F.sum("deleted").alias("deleted")).unionByName(
        per_file.groupBy(*KEY).agg(F.sum("added").alias("added"), F.sum("deleted").alias("deleted")).withColumn("file_no", F.lit(None).cast("int"))
    )


def _stat_rows(found: DataFrame) -> DataFrame:
    count = lambda sign: F.size(F.filter(lines(F.col("body")), lambda ln: F.startswith(ln, F.lit(sign)) & ~F.startswith(ln, F.lit(sign * 3))))
    return found.select(*KEY, "file_no", count("+").alias("added"), count("-").alias("deleted"))


def path_sets(attempts: DataFrame) -> DataFrame:
    """``pre`` and ``post``: the paths of the old and new sides, without ``/dev/null``."""
    side = lambda mark: F.array_sort(F.array_distinct(F.filter(F.transform(F.filter(lines(F.col("diff")), lambda ln: F.startswith(ln, F.lit(mark))), lambda ln: F.regexp_replace(F.substring(ln, 5, 1 << 30), "^[ab]/", "")), lambda p: p != "/dev/null")))
    return attempts.select(*KEY, side("--- ").alias("pre"), side("+++ ").alias("post"))


def short_hunks(found: DataFrame) -> DataFrame:
    """Hunks with fewer lines than their header says: ``header``, ``old_missing``, ``new_missing``.

    Counting stops when both quotas are met or at a line that is none of a hunk's; an empty
    line counts as context, and a line that begins with a backslash is passed over.
    """
    rows = found.select(*KEY, "file_no", "path_new", "suffix", F.posexplode(_hunk_parts(F.col("body"))).alias("hunk_no", "hunk"))
    ranged = rows.where(F.col("hunk").rlike(_RANGES))
    number = lambda i: F.expr(f"try_cast(nullif(regexp_extract(hunk, '{_RANGES.replace(chr(92), chr(92) * 2)}', {i}), '') AS INT)")
    body = F.slice(lines(F.regexp_replace("hunk", r"\n\z", "")), F.lit(2), F.lit(1 << 30))
    start = F.struct(F.lit(0).alias("old"), F.lit(0).alias("new"), F.lit(False).alias("over"))

    def step(acc: Column, ln: Column) -> Column:
        met = acc["over"] | ((acc["old"] >= F.col("ol")) & (acc["new"] >= F.col("nl")))
        context, plus, minus = ln.rlike(r"^( |\z)"), F.startswith(ln, F.lit("+")), F.startswith(ln, F.lit("-"))
        foreign = ~(context | plus | minus | F.startswith(ln, F.lit("\\")))
        add = lambda name, sign: acc[name] + F.when(met | foreign, 0).when(context | sign, 1).otherwise(0)
        return F.struct(add("old", minus).alias("old"), add("new", plus).alias("new"), (met | foreign).alias("over"))

    counted = ranged.withColumns({"ol": F.coalesce(number(2), F.lit(1)), "nl": F.coalesce(number(4), F.lit(1)), "header": F.substring_index("hunk", "\n", 1)}).withColumn("got", F.aggregate(body, start, step))
    missing = counted.select(*KEY, "file_no", "hunk_no", "header", F.greatest(F.lit(0), F.col("ol") - F.col("got.old")).alias("old_missing"), F.greatest(F.lit(0), F.col("nl") - F.col("got.new")).alias("new_missing"))
    return missing.where("old_missing > 0 OR new_missing > 0")


def theory_moves(found: DataFrame) -> DataFrame:
    """``old_dir`` and ``new_dir`` of every theory that changed directory."""
    rows = found.where("path_old <> path_new AND endswith(path_old, '.thy') AND endswith(path_new, '.thy')")
    return rows.select(*KEY, "file_no", parent(F.col("path_old")).alias("old_dir"), parent(F.col("path_new")).alias("new_dir")).where("old_dir <> new_dir")


def seed(ctx: Column) -> Column:
    """Depth in prose that a hunk's context implies: open cartouches of a document command."""
    opened = F.size(F.regexp_extract_all(ctx, F.lit(r"\\<open>"), F.lit(0))) - F.size(F.regexp_extract_all(ctx, F.lit(r"\\<close>"), F.lit(0)))
    return F.when(ctx.rlike(r"(?U)^\s*(?:" + "|".join(DOC_COMMANDS) + ")" + _WORD_END), F.greatest(F.lit(0), opened)).otherwise(F.lit(0))


def spaced(text: Column) -> Column:
    """``text`` with each run of white space as one blank, and none at its ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def projected(side: Column, depth: Column, guessed: Column) -> Column:
    """A struct of ``bad`` (a close without its open) and ``out``, the code of each line of ``side``.

    Walks the lines' tokens with what they change: depth of prose cartouches,
    of comments, of code cartouches, and whether a document command waits for
    its cartouche. A guessed depth ends where a line begins with a proof command.
    """
    names = ("depth", "ml", "cart", "pending", "bad", "text")
    whole = lambda **kw: F.struct(*[kw[n].alias(n) for n in names])

    def token(acc: Column, piece: Column) -> Column:
        tok = piece["tok"]
        code = (acc["ml"] == 0) & (acc["depth"] == 0)
        comment, prose = acc["ml"] > 0, (acc["ml"] == 0) & (acc["depth"] > 0)
        is_ = lambda t: F.coalesce(tok == t, F.lit(False))
        doc = tok.isNotNull() & ~(is_("(*") | is_("*)") | is_(_OPEN) | is_(_CLOSE))
        opens_code = code & is_(_OPEN) & ~acc["pending"]
        closes_code = code & is_(_CLOSE) & (acc["cart"] > 0)
        bad = code & (is_("*)") | (is_(_CLOSE) & (acc["cart"] == 0)))
        text = F.concat(acc["text"], F.when(code, piece["gap"]).otherwise(""), F.when(opens_code | closes_code, tok).otherwise(""))
        step = lambda up, down: F.when(up, 1).when(down, -1).otherwise(0)
        return whole(
            depth=acc["depth"] + step((prose & is_(_OPEN)) | (code & is_(_OPEN) & acc["pending"]), prose & is_(_CLOSE)),
            ml=acc["ml"] + step((comment | code) & is_("(*"), comment & is_("*)")),
            cart=acc["cart"] + step(opens_code, closes_code),
            pending=F.when(code & doc, True).when(code & is_(_OPEN), False).otherwise(acc["pending"]),
            bad=acc["bad"] | bad,
            text=text,
        )

    def line(acc: Column, raw: Column) -> Column:
        resync = guessed & (acc["depth"] > 0) & raw.rlike(_RESYNC)
        begin = whole(depth=F.when(resync, 0).otherwise(acc["depth"]), ml=acc["ml"], cart=acc["cart"], pending=acc["pending"] & ~resync, bad=acc["bad"], text=F.lit(""))
        pieces = F.zip_with(F.split(raw, _TOKEN, -1), F.regexp_extract_all(raw, F.lit(_TOKEN), F.lit(0)), lambda gap, tok: F.struct(gap.alias("gap"), tok.alias("tok")))
        done = F.aggregate(pieces, begin, token)
        return bound(done, lambda d: F.struct(*[d[n].alias(n) for n in names], F.concat(acc["out"], F.array(spaced(d["text"]))).alias("out")))

    none = F.array().cast("array<string>")
    state = lambda acc, out: F.struct(*[acc[n].alias(n) for n in names], out.alias("out"))
    start = F.struct(depth.cast("int").alias("depth"), F.lit(0).alias("ml"), F.lit(0).alias("cart"), F.lit(False).alias("pending"), F.lit(False).alias("bad"), F.lit("").alias("text"), none.alias("out"))

    # Lines are gathered by blocks, so that few of them are copied often.
    def block(acc: Column, own: Column) -> Column:
        return bound(F.aggregate(own, state(acc, none), line), lambda d: state(d, F.concat(acc["out"], d["out"])))

    def walked(all_: Column) -> Column:
        places = F.filter(F.sequence(F.lit(0), (F.size(all_) / LINES_A_BLOCK).cast("int")), lambda i: i * LINES_A_BLOCK < F.size(all_))
        blocks = F.transform(places, lambda i: F.slice(all_, i * LINES_A_BLOCK + 1, LINES_A_BLOCK))
        return F.aggregate(blocks, start, block, lambda acc: F.struct(acc["bad"].alias("bad"), acc["out"].alias("out")))

    # worked out once, not for each block
    return bound(side, walked)


def _changed(hunk_lines: Column, sign: Column, depth: Column, guessed: Column) -> Column:
    """``bad`` and the non-empty projections ``p`` of the lines of one sign, context lines carrying the state."""
    own = lambda seen, out: F.transform(F.filter(F.zip_with(seen, out, lambda ln, p: F.struct(ln.alias("ln"), p.alias("p"))), lambda x: F.startswith(x["ln"], sign) & (x["p"] != "")), lambda x: x["p"])

    def read(seen: Column) -> Column:
        found = projected(F.transform(seen, lambda ln: F.substring(ln, 2, 1 << 30)), depth, guessed)
        return bound(found, lambda r: F.struct(r["bad"].alias("bad"), own(seen, r["out"]).alias("p")))

    return bound(F.filter(hunk_lines, lambda ln: F.startswith(ln, F.lit(" ")) | F.startswith(ln, sign)), read)


#: Lines up to which a side is searched from its beginning, and beyond which by halving.
FEW_LINES = 64


def lacking(own: Column, other: Column) -> Column:
    """The elements of ``own`` that ``other`` lacks, in order and as often as they stand there."""

    def sought(held: Column) -> Column:
        # how many elements of the sorted side come before p
        step = lambda p: lambda at, n: F.when((at + n <= F.size(held["s"])) & (F.get(held["s"], at + n - 1) < p), at + n).otherwise(at)
        return F.filter(own, lambda p: ~F.coalesce(F.get(held["s"], F.aggregate(held["strides"], F.lit(0), step(p))) == p, F.lit(False)))

    strides = F.filter(F.array(*[F.lit(1 << k) for k in range(30, -1, -1)]), lambda n: n <= F.size(other))
    many = bound(F.struct(F.sort_array(other).alias("s"), strides.alias("strides")), sought)
    return F.when(F.size(other) > FEW_LINES, many).otherwise(F.filter(own, lambda p: ~F.array_contains(other, p)))


def code_evidence(found: DataFrame) -> DataFrame:
    """``hunks`` with ``evidence``."""
    return found.withColumn("evidence", evidence(F.col("lines"), F.col("ctx")))


def evidence(hunk_lines: Column, ctx: Column) -> Column:
    """Projections on one side of a hunk that the other lacks, signed.

    Both sides are read from the depth that the context implies, else from
    within prose, else as bare text: the first reading that fits both. A hunk
    without tokens that is not within prose is all code, and is not walked.
    """
    own = lambda sign: F.transform(F.filter(hunk_lines, lambda ln: F.startswith(ln, F.lit(sign))), lambda ln: F.substring(ln, 2, 1 << 30))
    sides = lambda old, new: F.struct(old.alias("old"), new.alias("new"))
    text = lambda sign: F.transform(own(sign), lambda ln: F.regexp_replace(ln, r"(?U)^\s+|\s+$", ""))
    plain = lambda sign: F.filter(F.transform(own(sign), spaced), lambda p: p != "")
    depth = seed(ctx)

    def reading(found_: Column, way: Column) -> Column:
        read = F.transform(F.array(F.lit("-"), F.lit("+")), lambda sign: _changed(hunk_lines, sign, way["depth"], way["guessed"]))
        fitting = bound(read, lambda r: F.when(~F.get(r, F.lit(0))["bad"] & ~F.get(r, F.lit(1))["bad"], sides(F.get(r, F.lit(0))["p"], F.get(r, F.lit(1))["p"])))
        return F.when(found_.isNotNull(), found_).otherwise(fitting)

    ways = F.array(*[F.struct(at.cast("int").alias("depth"), guessed.alias("guessed")) for at, guessed in ((depth, depth > 0), (F.lit(1), F.lit(True)))])
    none = F.lit(None).cast("struct<old:array<string>,new:array<string>>")
    walked = F.coalesce(F.aggregate(ways, none, reading), sides(text("-"), text("+")))
    simple = (depth == 0) & ~F.exists(hunk_lines, lambda ln: ln.rlike(_TOKEN))
    only = lambda a, b, sign: F.transform(lacking(a, b), lambda p: F.concat(F.lit(sign), p))

    def differing(r: Column) -> Column:
        # Sides that differ in how often a line stands there, and in nothing else, have no evidence.
        differs = F.array_sort(r["old"]) != F.array_sort(r["new"])
        return F.when(differs, F.concat(only(r["old"], r["new"], "-"), only(r["new"], r["old"], "+"))).otherwise(F.array().cast("array<string>"))

    return bound(F.when(simple, sides(plain("-"), plain("+"))).otherwise(walked), differing)


def _is_change(line: Column) -> Column:
    return line.rlike(r"^[+-]") & ~line.rlike(r"^(\+\+\+|---)") & line.rlike(r"(?U)^.\s*\S")


def _is_prose(path: Column, suffix: Column) -> Column:
    return suffix.isin(*PROSE_SUFFIXES) | F.contains(F.concat(F.lit("/"), path), F.lit("/document/"))


def file_verdicts(found: DataFrame) -> DataFrame:
    """``files`` with ``verdict`` (code or doc), its ``evidence``, and ``proof_edit``: code evidence in a theory, wherever it lies."""
    by_hunk = code_evidence(hunks(found.where("suffix = '.thy'")))
    theory = by_hunk.groupBy(*KEY, "file_no").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("hunk_no", "evidence"))), lambda x: x["evidence"])).alias("_ev"))
    other = F.filter(lines(F.col("body")), _is_change)
    prose = _is_prose(F.col("path_new"), F.col("suffix"))
    none = F.array().cast("array<string>")
    rows = found.join(theory, [*KEY, "file_no"], "left").withColumn("_ev", F.when(F.col("suffix") == ".thy", F.coalesce("_ev", none)).otherwise(other))
    return rows.withColumns({
        "proof_edit": (F.col("suffix") == ".thy") & (F.size("_ev") > 0),
        "evidence": F.when(prose, none).otherwise(F.col("_ev")),
        "verdict": F.when(~prose & (F.size("_ev") > 0), "code").otherwise("doc"),
    }).drop("_ev")


def theory_dirs(diff: Column) -> Column:
    """The directories of a diff's theories, each once and in order."""
    paths = F.transform(_bodies(diff), lambda body: bound(F.substring_index(body, "\n", 1), lambda head: F.coalesce(F.nullif(F.regexp_extract(head, _HEADER, 2), F.lit("")), head)))
    return F.array_sort(F.array_distinct(F.transform(F.filter(paths, lambda p: _suffix(p) == ".thy"), parent)))


def kinds(diff: Column) -> Column:
    """For each file of a diff its new path, whether its verdict is ``code``, and ``proof_edit``: ``file_verdicts`` within the row, so nothing is shuffled."""

    def of_hunk(hunk: Column) -> Column:
        header = F.substring_index(hunk, "\n", 1)
        parts = F.struct(F.regexp_extract(header, _HUNK, 1).alias("ctx"), _hunk_lines(hunk, header).alias("lines"))
        return bound(parts, lambda h: F.size(evidence(h["lines"], h["ctx"])) > 0)

    def of_file(body: Column) -> Column:
        head = F.substring_index(body, "\n", 1)
        new = F.regexp_extract(head, _HEADER, 2)
        path = F.when(new == "", head).otherwise(new)
        named = bound(path, lambda p: F.struct(p.alias("path"), _suffix(p).alias("suffix")))

        def judged(f: Column) -> Column:
            theory = f["suffix"] == ".thy"
            some = F.when(theory, F.exists(_hunk_parts(body), of_hunk)).otherwise(F.exists(lines(body), _is_change))
            return bound(some, lambda e: F.struct(f["path"].alias("path_new"), (~_is_prose(f["path"], f["suffix"]) & e).alias("code"), (theory & e).alias("proof_edit")))

        return bound(named, judged)

    return F.transform(_bodies(diff), of_file)


def classified(attempts: DataFrame) -> DataFrame:
    """``attempts`` with ``delta_class`` (code, doc or none) and ``proof_edit``."""
    edit = bound(kinds(F.col("diff")), lambda found: F.struct(
        F.when(F.size(found) > 0, F.when(F.exists(found, lambda f: f["code"]), "code").otherwise("doc")).otherwise("none").alias("delta_class"),
        F.coalesce(F.exists(found, lambda f: f["proof_edit"]), F.lit(False)).alias("proof_edit"),
    ))
    rows = attempts.withColumn("_edit", edit)
    return rows.withColumns({"delta_class": F.col("_edit.delta_class"), "proof_edit": F.col("_edit.proof_edit")}).drop("_edit")


def theory_key(name: Column) -> Column:
    """One key for a path, a qualified name and a repository path of a theory."""
    last = F.regexp_extract(name, "[^/]*$", 0)
    return F.when(F.endswith(last, F.lit(".thy")), F.regexp_replace(last, r"\.thy$", "")).otherwise(F.substring_index(last, ".", -1))


# How an error head names a place.
_LOCUS_QUOTED = r'\(line (\d+) of "([^"]+)"\)'
_LOCUS_BARE = r"line (\d+) of (\S+)"


def error_loci(loci: Column, head: Column) -> Column:
    """Loci of an attempt: its own field, else what its error head names; the first form with a hit wins."""
    given = F.coalesce(loci, F.array().cast("array<array<string>>"))
    own = F.transform(given, lambda x: F.struct(theory_key(F.get(x, F.lit(0))).alias("theory"), F.get(x, F.lit(1)).try_cast("int").alias("line")))
    some = lambda a: F.when(F.size(a) > 0, a)
    read = lambda p: F.zip_with(F.regexp_extract_all(head, F.lit(p), F.lit(2)), F.regexp_extract_all(head, F.lit(p), F.lit(1)), lambda t, n: F.struct(theory_key(t).alias("theory"), n.try_cast("int").alias("line")))
    return F.coalesce(some(own.cast(LOCI)), some(read(_LOCUS_QUOTED).cast(LOCI)), read(_LOCUS_BARE).cast(LOCI), F.array().cast(LOCI))


def map_line(ranges: Column, line: Column) -> Column:
    """Where an old line stands after the edit, null if a hunk covers it.

    ``ranges`` is an array of structs with ``old_start``, ``old_len``, ``new_start`` and ``new_len``
    in order. Hunks that begin behind the line do not move it.
    """
    before = F.filter(ranges, lambda h: h["old_start"] <= line)
    covered = F.exists(before, lambda h: line < h["old_start"] + h["old_len"])
    last = F.element_at(before, -1)
    shift = (last["new_start"] + last["new_len"]) - (last["old_start"] + last["old_len"])
    return F.when(F.size(before) == 0, line).when(~covered, line + shift)


def normalised(diff: Column) -> Column:
    """Ids on ``index`` lines cut to seven characters."""
    return F.regexp_replace(diff, r"(?m)^index ([0-9a-f]{1,7})[0-9a-f]*\.\.([0-9a-f]{1,7})[0-9a-f]*", "index $1..$2")
