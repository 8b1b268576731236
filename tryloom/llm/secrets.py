"""Operator 6: secret scans over a trigram inverted index, all native expressions.

Each rule's regular expression yields a Boolean trigram query: alternatives of
trigram sets, one of which a matching text must hold in full. The index holds a
posting for each text and each trigram that some query names. Postings are
intersected by counting a query's trigrams for each text; only candidate texts
run the rule's expression. A rule without a mandatory trigram scans every text.

A posting names a text by a hash of it, so copies share postings. Equal hashes
of unlike texts could only add candidates, and every candidate is verified.

Cases: a null text counts as empty and has no span; texts are scanned whole, by
every rule in linear time; repeated rows give repeated rows; an empty table gives an empty result; other
columns of the input are ignored. Spans of different kinds may overlap.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tryloom.llm.shared import fresh, id_side, table, written
from tryloom.llm.textspans import joined, matches, no_matches, placed

_KEY = r"(password|passwd|secret|token|api_?key)"
ASSIGN = rf"(?i:{_KEY})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"


@dataclass(frozen=True)
class Rule:
    """A kind of secret. ``least`` is the least length of ``group`` of a match.

    A pattern that begins with the letters ``opening`` and a run of ``run`` (a
    class that holds these) can match only from the first opening in a run: if it
    fails there, it fails from all later ones, which see less of the same run. It
    is sought once a run, so that long runs of openings take linear time.
    """

    kind: str
    pattern: str
    least: int = 0
    group: int = 0
    opening: str = ""
    run: str = ""

    @property
    def sought(self) -> str:
        """What is sought in texts: the pattern, behind what stands before it in its run."""
        return rf"(?<!{self.run})(?:(?!{self.opening}){self.run})*+{self.pattern}" if self.opening else self.pattern


#: The first three are the base kinds, in the order of their ranks.
RULES = (
    Rule("assign", ASSIGN, 6, 2),
    Rule("access", r"AKIA[A-Z0-9]+", 20),
    Rule("hex", r"[0-9a-f]{24,}"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"(?:sk|rk)_(?:live|test)_[A-Za-z0-9]{16,}"),
    Rule("pem", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}+\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+", opening="eyJ", run="[A-Za-z0-9_-]"),
)
N_BASE = 3

#: Up to so many candidate texts (16 bytes each) are broadcast.
CANDIDATES_BROADCAST = 500_000
#: A derived set of strings is given up beyond this size.
MOST_STRINGS = 64


@dataclass
class _Part:
    """What is known of a part of an expression: all strings that it matches, if they are few, else clauses.

    Of each clause, one string must occur. Strings are in lower case.
    """

    strings: set[str] | None
    clauses: list[set[str]]


class _Reader:
    """Reads an expression of literals, classes, groups, alternatives and repetitions."""

    def __init__(self, pattern: str):
        self.pattern, self.at = pattern, 0

    def peek(self) -> str:
        return self.pattern[self.at : self.at + 1]

    def take(self, expression: str) -> str | None:
        found = re.compile(expression).match(self.pattern, self.at)
        if found:
            self.at = found.end()
        return found and found[0]

    def alternatives(self) -> _Part:
        parts = [self.sequence()]
        while self.take(r"\|"):
            parts.append(self.sequence())
        if len(parts) == 1:
            return parts[0]
        known = all(p.strings is not None for p in parts)
        return _Part(set().union(*(p.strings for p in parts)) if known else None, [])

    def sequence(self) -> _Part:
        run, clauses, whole = {""}, [], True

        def close() -> None:
            if run and min(map(len, run)) >= 3:
                clauses.append(run)

        while self.peek() not in ("", "|", ")"):
            part = self.repeated()
            if part.strings is not None and len(part.strings) * len(run) <= MOST_STRINGS:
                run = {a + b for a in run for b in part.strings}
                continue
            whole = False
            close()
            run = part.strings if part.strings is not None else {""}
            clauses += part.clauses
        close()
        return _Part(run if whole else None, clauses)

    def repeated(self) -> _Part:
        part = self.one()
        mark = self.take(r"(?:[*+?]|\{\d+(?:,\d*)?\})")
        if not mark:
            return part
        self.take(r"[?+]")
        least, most = {"*": (0, None), "+": (1, None), "?": (0, 1)}.get(mark) or self._bounds(mark)
        if part.strings is None or most is None or most > 4:
            return _Part(None, part.clauses if least else [])
        return _Part({"".join(x) for n in range(least, most + 1) for x in product(part.strings, repeat=n)}, [])

    @staticmethod
    def _bounds(mark: str) -> tuple[int, int | None]:
        low, comma, high = mark[1:-1].partition(",")
        return int(low), int(high) if high else None if comma else int(low)

    def one(self) -> _Part:
        if self.take(r"\((?:\?i?:)?"):
            if self.peek() == "?":
                raise ValueError(f"unknown group in {self.pattern}")
            part = self.alternatives()
            self.take(r"\)")
            return part
        if self.peek() == "[":
            body = self.take(r"\[\^?\]?(?:\\.|[^\]\\])*\]")[1:-1]
            members = re.findall(r"\\x[0-9A-Fa-f]{2}|\\.|.", body, re.S)
            few = body[0] != "^" and "-" not in body.strip("-") and len(members) <= 8 and not re.search(r"\\[a-wyzA-Z]", body)
            return _Part({self._literal(m) for m in members} if few else None, [])
        if self.take(r"\^|\$"):
            return _Part({""}, [])
        token = self.take(r"(?s)\\x[0-9A-Fa-f]{2}|\\.|.")
        wide = token == "." or re.fullmatch(r"\\[a-zA-Z]", token)
        return _Part(None if wide else {self._literal(token)}, [])

    @staticmethod
    def _literal(token: str) -> str:
        if token.startswith(r"\x"):
            token = chr(int(token[2:], 16))
        return token[-1].lower()


def trigram_query(pattern: str) -> list[frozenset[str]] | None:
    """Alternatives of lower-case trigram sets; None if no trigram is mandatory."""
    options: list[frozenset[str]] = [frozenset()]
    for clause in sorted(_Reader(pattern).alternatives().clauses, key=len):
        sets = [frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in clause]
        if len(options) * len(sets) <= MOST_STRINGS:
            options = [a | b for a in options for b in sets]
    options = [a for a in dict.fromkeys(options) if not any(b < a for b in options)]
    return options if options and all(options) else None


def text_key(text: Column) -> Column:
    return F.xxhash64(text)


def _finder(trigrams: list[str]) -> str:
    """An expression that meets each of ``trigrams`` where it begins, also where they overlap."""
    quoted = lambda c: re.sub(r"([^A-Za-z0-9_])", r"\\\1", c)
    starts: dict[str, dict[str, list[str]]] = {}
    for a, b, c in trigrams:
        starts.setdefault(a, {}).setdefault(b, []).append(c)
    return "(?=(" + "|".join(f"{quoted(a)}(?:" + "|".join(f"{quoted(b)}[{''.join(map(quoted, ends))}]" for b, ends in next_.items()) + ")" for a, next_ in starts.items()) + "))"


def postings(texts: DataFrame, trigrams: list[str]) -> DataFrame:
    """The inverted index: ``gram`` and ``key`` of each text that holds one of ``trigrams``. A text is read once."""
    held = F.regexp_extract_all(F.lower("text"), F.lit(_finder(trigrams)), F.lit(1))
    return texts.select(text_key(F.col("text")).alias("key"), F.explode(F.array_distinct(held)).alias("gram"))


def candidates(texts: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``key`` and ``rules`` (a bit for each): the texts that hold a trigram set of a rule in full."""
    queries = {i: q for i, r in enumerate(rules) if (q := trigram_query(r.pattern))}
    trigrams = sorted({g for q in queries.values() for option in q for g in option})
    if not trigrams:
        return texts.select(text_key(F.col("text")).alias("key"), F.lit(0).cast("long").alias("rules")).limit(0)
    branches = [(i, n, len(option), g) for n, (i, option) in enumerate((i, o) for i, q in queries.items() for o in q) for g in sorted(option)]
    rows = F.array(*[F.struct(*[F.lit(x).alias(k) for k, x in zip(("rule", "branch", "need", "gram"), b, strict=True)]) for b in branches])
    # A row for each trigram of each rule: bounded by the rules.
    wanted = F.broadcast(texts.sparkSession.range(1).select(F.inline(rows)))
    index = postings(texts, trigrams).join(wanted, "gram")
    held = index.groupBy("key", "rule", "branch", "need").agg(F.collect_set("gram").alias("grams")).where(F.size("grams") == F.col("need"))
    return held.groupBy("key").agg(F.bit_or(F.expr("shiftleft(1L, rule)")).alias("rules"))


def _long_enough(rule: Rule):
    value = (lambda m: F.regexp_extract(m, rule.pattern, rule.group)) if rule.group else (lambda m: m)
    return lambda s: F.length(value(s["text"])) >= rule.least


def _spans(rule: Rule, guard: Column | None) -> Column:
    spans = matches(F.col("text"), rule.sought, guard)
    if rule.opening:
        before = lambda s: F.locate(rule.opening, s["text"]) - 1
        spans = F.transform(spans, lambda s: F.struct((s["start"] + before(s)).alias("start"), s["end"].alias("end"), F.substring(s["text"], before(s) + 1, F.length(s["text"])).alias("text"), s["gap"].alias("gap")))
    return F.filter(spans, _long_enough(rule)) if rule.least else spans


def secret_spans(docs: DataFrame, rules: tuple[Rule, ...] = RULES, into: str = "secrets") -> DataFrame:
    """``docs`` with ``into``: for each rule the array of its verified spans.

    A column of that name in ``docs`` is replaced. Texts are not shuffled: what
    is joined to them are the candidates, two numbers each, which are counted
    first; beyond ``CANDIDATES_BROADCAST`` they are hashed by partition, and
    Spark splits a partition of a text that many rows share at run time.
    """
    docs = docs.drop(into).withColumn("text", F.coalesce("text", F.lit("")))
    key, numbers = fresh(docs, "text_key"), fresh(docs, "rules")
    found = written(candidates(docs.select("text"), rules), "candidates").withColumnsRenamed({"key": key, "rules": numbers})
    with_rules = docs.withColumn(key, text_key(F.col("text"))).join(id_side(found, CANDIDATES_BROADCAST), key, "left")
    out = []
    for i, rule in enumerate(rules):
        guard = F.col(numbers).bitwiseAND(F.lit(1 << i)) != 0 if trigram_query(rule.pattern) else None
        out.append(F.coalesce(_spans(rule, guard), no_matches()).alias(rule.kind))
    return with_rules.select(*[F.col(f"`{c}`") for c in docs.columns], F.struct(*out).alias(into))


def all_spans(rules: tuple[Rule, ...] = RULES, first: int = 0, last: int | None = None, column: str = "secrets") -> Column:
    """The spans of ``column`` as one array of sortable structs."""
    chosen = list(enumerate(rules))[first:last]
    return F.concat(*[placed(F.col(column)[r.kind], i, r.kind) for i, r in chosen])


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every whole text of ``documents``."""
    found = secret_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))
    placed_ = found.select("doc_id", *[F.size(F.col("secrets")[r.kind]).cast("long").alias(f"n_{r.kind}") for r in RULES[:N_BASE]], joined(all_spans(last=N_BASE)).alias("base"), all_spans().alias("every"))
    return placed_.select("doc_id", *[f"n_{r.kind}" for r in RULES[:N_BASE]], F.sha2("base", 256).alias("base_sha256"), joined(F.col("every")).alias("spans"), F.size("every").cast("long").alias("n_spans"))


def python_pattern(rule: Rule) -> re.Pattern:
    """The rule's expression for Python, as tests use it."""
    return re.compile(rule.pattern)
