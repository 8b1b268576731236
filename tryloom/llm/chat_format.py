"""Operator 9: chat formatting from an event log, all native expressions.

A conversation arrives as events: ``start`` opens a message, ``delta`` appends
streamed text, ``edit`` replaces the text so far, and ``regenerate`` discards
it. Events are partitioned by conversation and message, sorted by sequence and
folded into final messages; these are sorted by turn and rendered. The
template's control strings inside a text or role are escaped reversibly, so the
output can be read back exactly.

Escapes: ``~`` is written ``~0``; a ``<`` that begins a control string ``~1``;
a ``[`` that does ``~2``; and in roles a line feed ``~3``. Reading back undoes
``~3``, ``~2``, ``~1`` and then ``~0``.

A rendered conversation is one value, so one row holds it; what is shuffled for
it has been folded and gathered within each task first.

Cases: a null text is empty, a null role empty; messages of equal turns are
ordered by role and then text; repeated rows are messages of their own; a null
conversation id is a conversation; an empty log gives no conversation; other
columns of the input are ignored. A message whose events hold no ``start`` is
folded all the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tryloom.llm.shared import table

#: What marks turns.
OPEN, CLOSE = "<|turn|>", "<|end|>\n"
#: Where an escaped character stands: it begins one of these control strings.
_ANGLE = r"<(?=\||/?s>)"
_BRACKET = r"\[(?=/?INST\])"


def escaped(text: Column) -> Column:
    text = F.replace(text, F.lit("~"), F.lit("~0"))
    return F.regexp_replace(F.regexp_replace(text, _ANGLE, "~1"), _BRACKET, "~2")


def unescaped(text: Column) -> Column:
    for mark, char in (("~2", "["), ("~1", "<"), ("~0", "~")):
        text = F.replace(text, F.lit(mark), F.lit(char))
    return text


def escaped_role(role: Column) -> Column:
    return F.replace(escaped(role), F.lit("\n"), F.lit("~3"))


def unescaped_role(role: Column) -> Column:
    return unescaped(F.replace(role, F.lit("~3"), F.lit("\n")))


def folded(events: DataFrame) -> DataFrame:
    """Final messages of an event log.

    In: ``conv_id``, ``message`` (any type), ``turn``, ``role``, ``seq`` (order
    within the message), ``event`` and ``text``. Out: a row for each message
    with ``conv_id``, ``message``, ``turn``, ``role`` (the last given) and ``text``.
    """
    one = F.struct("seq", "event", F.coalesce("text", F.lit("")).alias("text"), "role", "turn")
    log = events.groupBy("conv_id", "message").agg(F.array_sort(F.collect_list(one)).alias("log"))
    # Only what follows the last edit or regeneration counts, the edit's own text included.
    resets = F.filter("log", lambda e: e["event"].isin("edit", "regenerate"))
    since = F.array_max(F.transform(resets, lambda e: e["seq"]))
    live = F.filter("log", lambda e: since.isNull() | (e["seq"] > since) | ((e["seq"] == since) & (e["event"] == "edit")))
    text = F.array_join(F.transform(live, lambda e: e["text"]), "")
    last = lambda name: F.element_at(F.filter(F.transform("log", lambda e: e[name]), lambda x: x.isNotNull()), -1)
    some = lambda name: F.when(F.exists("log", lambda e: e[name].isNotNull()), last(name))
    return log.select("conv_id", "message", some("turn").alias("turn"), F.coalesce(some("role"), F.lit("")).alias("role"), text.alias("text"))


def rendered(messages: DataFrame) -> DataFrame:
    """``conv_id``, ``formatted`` and ``loss_spans``.

    A loss span names a turn (from 0), where its text begins behind the turn's
    opening mark, and its length there; only assistant texts have one.
    """
    turn = F.struct("turn", "role", "text")
    turns = messages.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    role = lambda t: escaped_role(t["role"])
    parts = F.transform("turns", lambda t: F.concat(F.lit(OPEN), role(t), F.lit("\n"), escaped(t["text"]), F.lit(CLOSE)))
    spans = F.transform("turns", lambda t, i: F.when(t["role"] == "assistant", F.struct(i.alias("turn"), (F.length(role(t)) + 1).alias("start"), F.length(escaped(t["text"])).alias("length"))))
    return turns.select("conv_id", F.array_join(parts, "").alias("formatted"), F.array_compact(spans).alias("loss_spans"))


def read_back(conversations: DataFrame) -> DataFrame:
    """``turns`` (role and text) and ``loss`` (texts under the mask) of what ``rendered`` gives."""
    parts = F.split("formatted", CLOSE.replace("|", r"\|"), -1)
    marked = conversations.withColumn("parts", F.transform(F.slice(parts, 1, F.size(parts) - 1), lambda p: F.substring(p, len(OPEN) + 1, F.length(p))))
    turn = lambda p: F.struct(
        unescaped_role(F.substring_index(p, "\n", 1)).alias("role"),
        unescaped(F.substring(p, F.length(F.substring_index(p, "\n", 1)) + 2, F.length(p))).alias("text"),
    )
    under = lambda s: unescaped(F.substring(F.get("parts", s["turn"]), s["start"] + 1, s["length"]))
    return marked.select(*conversations.columns, F.transform("parts", turn).alias("turns"), F.transform("loss_spans", under).alias("loss"))


def as_events(rows: DataFrame) -> DataFrame:
    """Finished messages as an event log that streaming them could have left.

    Each row opens a message and streams its text in two deltas. By a hash of
    conversation and turn, one in three first streams a draft that is then
    regenerated, and one in three a draft that an edit replaces by the first half.
    """
    text = F.coalesce("text", F.lit(""))
    half = (F.length(text) / 2).cast("int")
    first, second, draft = F.substring(text, F.lit(1), half), F.substring(text, half + 1, F.length(text)), F.concat(F.reverse(text), F.lit(CLOSE))
    event = lambda kind, part: F.struct(F.lit(kind).alias("event"), part.alias("text"))
    way = F.pmod(F.xxhash64("conv_id", "turn"), F.lit(3))
    opened = F.array(event("start", F.lit("")))
    regenerated = F.array(event("delta", draft), event("regenerate", F.lit("")), event("delta", first), event("delta", second))
    edited = F.array(event("delta", draft), event("edit", first), event("delta", second))
    plain = F.array(event("delta", first), event("delta", second))
    log = F.concat(opened, F.when(way == 1, regenerated).when(way == 2, edited).otherwise(plain))
    numbered = F.transform(log, lambda e, i: F.struct(i.alias("seq"), e["event"].alias("event"), e["text"].alias("text")))
    named = rows.select("conv_id", F.monotonically_increasing_id().alias("message"), "turn", "role", numbered.alias("log"))
    return named.select("conv_id", "message", "turn", "role", F.inline("log"))


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``conversations``, and one more whose texts hold control strings."""
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    hard = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    found = read_back(rendered(folded(as_events(rows.unionByName(hard)))))
    every = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("loss", "")
    return found.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(every, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


#: ``formatted_chars`` follows from the escapes: one more character for each
#: tilde and each control string's first character.
ORACLE_SQL = """
WITH rows AS (
    SELECT conv_id::BIGINT AS conv_id, turn::BIGINT AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
    UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
sized AS (
    SELECT *, length(x) - length(replace(x, '~', '')) + len(regexp_extract_all(x, '<\\||</?s>|\\[/?INST\\]'))
              + length(r) - length(replace(r, '~', '')) + len(regexp_extract_all(r, '<\\||</?s>|\\[/?INST\\]')) + length(r) - length(replace(r, chr(10), '')) AS more
    FROM (SELECT *, text AS x, role AS r FROM rows)),
folded AS (
    SELECT conv_id, count(*) AS n_turns,
           string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS every,
           coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '') AS loss,
           sum(17 + length(role) + length(text) + more)::BIGINT AS formatted_chars
    FROM sized GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(every) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM folded
"""
