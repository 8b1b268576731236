"""Operator 8: personal data by bootstrapped contextual extraction, all native.

The base expressions give seed entities. Every token with a digit or an at sign,
and every run of numbers, is a candidate; one that meets a base span stands for
the whole span and is a seed. The words on either side, alone, together and
with the candidate's coarse class, are its lexical patterns, so that what is
learnt from seeds reaches candidates of other shapes. Next to another candidate,
that one's class is the word. Over the graph of patterns and instances, Spark
scores in turn: a pattern by the share of its instances that are held to be
personal, where unseen ones weigh by their class, an instance by the patterns
that it occurs with. After a fixed number of rounds, patterns of high confidence
mark instances that the base expressions missed. Base spans always stay.

Texts are read once; what follows works on tokens. Edges of the graph are
distinct pairs, counted within each task before they are shuffled.

Cases: a null text counts as empty and has no span; texts are scanned whole, in
time that grows with their tokens and spans times a logarithm; repeated rows give repeated rows but support a pattern once; an empty table
gives an empty result; other columns of the input are ignored. Spans of
different kinds may overlap.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tryloom.llm.shared import cut, fresh, table, written
from tryloom.llm.textspans import bound, joined, matches, placed

KINDS = ("email", "ip", "card", "phone")
CONTEXT = "context"

# Closures are possessive where nothing behind them could give back, so that
# long runs take linear time and no stack. A run that fails from its start
# fails from its middle too, so only starts are tried.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9]++(?:[\x20-][0-9]++)*+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_IP_PARTS = r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])(?:\.|$)){4}$"
#: Runs of numbers, and other tokens with a digit or an at sign, for the graph.
_NUMBER = r"\(?+[0-9][0-9().-]*+(?![A-Za-z@_%+/])"
TOKEN = rf"(?<![A-Za-z0-9@._%+/-])(?:\+?+{_NUMBER}(?:(?<=[0-9)])\x20{_NUMBER})*+|[A-Za-z._%+/-]*+[0-9@][A-Za-z0-9@._%+/-]*+)"
# The last and the first word of what stands between candidates; each word is tried from its beginning only.
LAST_WORD, FIRST_WORD = r"(?<!\S)(\S++)\s*+$", r"^\s*+(\S++)"
#: Characters of a word beyond which a pattern holds its digest instead.
LONG_WORD = 64
#: How much an instance that no base expression knows counts against a pattern, by its class.
UNSEEN = {"address": 0.25, "number": 0.5}


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes Luhn's test."""
    values = F.transform(F.split(F.reverse(number), ""), lambda c: c.cast("int"))
    doubled = F.transform(values, lambda v, i: F.when(i % 2 == 0, v).when(v < 5, v * 2).otherwise(v * 2 - 9))
    return F.aggregate(doubled, F.lit(0), lambda a, v: a + v) % 10 == 0


def base_spans(text: Column) -> Column:
    """A struct of span arrays, one for each base kind."""
    at = F.contains(text, F.lit("@"))
    digit = text.rlike("[0-9]")
    card = F.filter(matches(text, CARD, text.rlike("[0-9]{2}|[0-9][ -][0-9]")), lambda s: (F.length(s["text"]) >= 12) & F.length(digits(s["text"])).between(12, 19))
    return F.struct(
        matches(text, EMAIL, at).alias("email"),
        F.filter(matches(text, IP, digit), lambda s: s["text"].rlike(_IP_PARTS)).alias("ip"),
        F.filter(card, lambda s: luhn(digits(s["text"]))).alias("card"),
        F.filter(matches(text, PHONE, F.contains(text, F.lit("+"))), lambda s: F.length(digits(s["text"])).between(9, 15)).alias("phone"),
    )


def coarse(token: Column) -> Column:
    """The class of a token: address, number (seven digits at least), digits or mixed."""
    bare = ~token.rlike("[A-Za-z]")
    return F.when(F.contains(token, F.lit("@")), "address").when(bare & (F.length(digits(token)) >= 7), "number").when(bare, "digits").otherwise("mixed")


def named(word: Column) -> Column:
    """A word as a pattern names it: in lower case, a long one by the digest of that."""
    word = F.lower(word)
    return F.when(F.length(word) > LONG_WORD, F.sha2(word, 256)).otherwise(word)


def tokens(text: Column) -> Column:
    """Candidates with their places, class and patterns."""
    found = matches(text, TOKEN, text.rlike("[0-9@]"))

    def one(tail: Column, all_: Column, s: Column, i: Column) -> Column:
        none = F.lit(None).cast("string")
        word = lambda gap, expression, other: F.when(gap.rlike(r"\S"), named(F.regexp_extract(gap, expression, 1))).when(other.isNotNull(), F.concat(F.lit("#"), coarse(other["text"]))).otherwise(none)
        last, following = F.when(i > 0, F.get(all_, i - 1)), F.get(all_, i + 1)
        sides = F.struct(word(s["gap"], LAST_WORD, last).alias("before"), word(F.coalesce(following["gap"], tail), FIRST_WORD, following).alias("after"), coarse(s["text"]).alias("class"))

        def whole(x: Column) -> Column:
            # a null side makes null patterns, which are taken out
            parts = (("before", [x["before"]]), ("after", [x["after"]]), (" before", [x["before"], F.lit(" "), x["class"]]), (" after", [x["after"], F.lit(" "), x["class"]]), ("around", [x["before"], F.lit(" "), x["after"]]))
            patterns = F.array(*[F.concat(F.lit(f"{name} "), *values) for name, values in parts])
            return F.struct(s["start"].alias("start"), s["end"].alias("end"), s["text"].alias("instance"), x["class"].alias("class"), F.array_compact(patterns).alias("patterns"))

        return bound(sides, whole)

    def every(all_: Column) -> Column:
        tail = F.when(F.size(all_) > 0, F.substring(text, F.element_at(all_, -1)["end"] + 1, F.length(text)))
        return bound(tail, lambda t: F.transform(all_, lambda s, i: one(t, all_, s, i)))

    return bound(found, every)


def first_meeting(found: Column, spans: Column) -> Column:
    """``found`` with ``whole``: the text of the base span that each token meets, of the first kind that has one.

    A kind's spans stand in order and apart, so the one that may meet a token is
    found by halving: time grows with the tokens times the logarithm of the spans.
    """
    strides = F.array(*[F.lit(1 << k) for k in range(30, -1, -1)])
    side = lambda own: F.struct(own.alias("s"), F.filter(strides, lambda n: n <= F.size(own)).alias("strides"))
    sides = [side(spans[k]).alias(k) for k in KINDS]

    def hit(side: Column, t: Column) -> Column:
        # how many spans end at or before the token's start
        step = lambda at, n: F.when((at + n <= F.size(side["s"])) & (F.get(side["s"], at + n - 1)["end"] <= t["start"]), at + n).otherwise(at)
        one = F.get(side["s"], F.aggregate(side["strides"], F.lit(0), step))
        return F.when(one["start"] < t["end"], one["text"])

    def each(held: Column) -> Column:
        return F.transform(held["t"], lambda t: F.struct(*[t[c].alias(c) for c in ("start", "end", "instance", "class", "patterns")], F.coalesce(*[hit(held[k], t) for k in KINDS]).alias("whole")))

    return bound(F.struct(found.alias("t"), *sides), each)


def scored(edges: DataFrame, rounds: int = 3, least_support: int = 5, least_score: float = 0.9) -> DataFrame:
    """``pattern`` and ``score`` of the patterns of high confidence.

    ``edges`` has distinct ``pattern``, ``instance`` and whether the instance is a ``seed``,
    and may have the ``weight`` with which one not held to be personal counts.
    """
    edges = edges if "weight" in edges.columns else edges.withColumn("weight", F.lit(1.0))
    held = edges.withColumn("belief", F.col("seed").cast("double"))
    for last in [False] * (rounds - 1) + [True]:
        share = F.sum("belief") / (F.sum(F.col("belief") + (1 - F.col("belief")) * F.col("weight")) + 0.25)
        good = held.groupBy("pattern").agg(share.alias("score"), F.sum("belief").alias("support")).where((F.col("support") >= least_support) & (F.col("score") >= least_score)).select("pattern", "score")
        if last:
            return good
        doubt = edges.join(good, "pattern").groupBy("instance").agg(F.sum(F.log(1.0001 - F.col("score"))).alias("doubt"))
        held = edges.join(doubt, "instance", "left").withColumn("belief", F.when(F.col("seed"), 1.0).otherwise(F.coalesce(1 - F.exp("doubt"), F.lit(0.0))))
    return good


def personal_data(docs: DataFrame, rounds: int = 3, least_support: int = 5, least_score: float = 0.9) -> DataFrame:
    """``docs`` without its text, with ``pii``: base spans by kind, and ``context``: spans (start, end) found by patterns.

    Columns of these two names in ``docs`` are replaced.
    """
    text = F.coalesce("text", F.lit(""))
    others = [F.col(f"`{c}`") for c in docs.columns if c not in ("text", "pii", "context")]
    row, tokens_ = (fresh(docs, name) for name in ("_row", "_tokens"))
    read = docs.select(*others, base_spans(text).alias("pii"), tokens(text).alias(tokens_))
    bare = F.struct(*[F.transform(F.col("pii")[k], lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))).alias(k) for k in KINDS])
    rows = written(read.select(*others, F.monotonically_increasing_id().alias(row), bare.alias("pii"), first_meeting(F.col(tokens_), F.col("pii")).alias(tokens_)), "pii")

    # A candidate that meets a base span is the whole of it.
    seen = rows.select(F.col(row).alias("row"), F.explode(tokens_).alias("t")).select("row", "t.*")
    seen = seen.select("row", "start", "end", F.coalesce("whole", "instance").alias("instance"), F.col("whole").isNotNull().alias("seed"), "class", F.explode("patterns").alias("pattern"))
    weight = F.coalesce(*[F.when(F.col("class") == k, w) for k, w in UNSEEN.items()], F.lit(1.0))
    edges = cut(seen.groupBy("pattern", "instance").agg(F.max("seed").alias("seed"), F.min(weight).alias("weight")))
    good = scored(edges, rounds, least_support, least_score)
    found = seen.where("NOT seed").join(good, "pattern").groupBy(F.col("row").alias(row)).agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("context"))
    return rows.join(found, row, "left").select(*others, "pii", F.coalesce("context", F.array().cast("array<struct<start:int,end:int>>")).alias("context"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every whole text of ``documents``."""
    found = personal_data(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.concat(*[placed(F.col("pii")[k], i, k) for i, k in enumerate(KINDS)])
    counts = [F.size(F.col("pii")[k]).cast("long").alias(f"n_{k}") for k in KINDS]
    spans = joined(F.concat(base, placed(F.col("context"), len(KINDS), CONTEXT)))
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), spans.alias("spans"), F.size(base).cast("long").alias("n_base"), F.size("context").cast("long").alias("n_context"))
