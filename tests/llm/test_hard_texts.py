"""Texts and pages that are long, malformed or made to be slow; and what the operators leave behind."""

import os
import random
import time
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from tryloom.llm import markup, media, pii, secrets, shared
from tests.llm.test_contracts import plain_pii

MEGABYTE = 1_000_000


def read(page: str) -> list[tuple]:
    out = []
    markup.scan(page, lambda name, attributes, alone: out.append((name, attributes, alone)), lambda name: out.append(("/" + name,)), lambda text: out.append(text))
    joined = []
    for x in out:
        if joined and isinstance(x, str) and isinstance(joined[-1], str):
            joined[-1] += x
        else:
            joined.append(x)
    return joined


def test_tags_and_text():
    assert read("a<b>c</b >d<br/>&lt;&#65;") == ["a", ("b", {}, False), "c", ("/b",), "d", ("br", {}, True), "<A"]
    assert read("<IMG SRC='a>b' alt=x&amp;y title disabled=\"\">") == [("img", {"src": "a>b", "alt": "x&y", "title": None, "disabled": ""}, False)]
    assert read("<a href=u/v/>x<!-- <b> --><!doctype html><?php ?></>y") == [("a", {"href": "u/v/"}, False), "xy"]
    assert read("<script>if (a<b) '</b>'</SCRIPT >x<style>y") == [("script", {}, False), ("/script",), "x", ("style", {}, False)]
    assert read("<title>a <b> &amp;</title>c") == [("title", {}, False), "a <b> &", ("/title",), "c"]


def test_what_is_malformed_is_text():
    assert read("<![foo bar]>x") == ["x"] and read("<![ ") == ["<![ "] and read("<!-- a <b>c") == ["<!-- a ", ("b", {}, False), "c"]
    assert read("1 < 2 <3 <") == ["1 < 2 <3 <"] and read("</b") == ["</b"] and read("<a x='u <b>") == ["<a x='u ", ("b", {}, False)]
    assert read("<a x=\"oops>t<i>") == [("a", {"x": '"oops'}, False), "t", ("i", {}, False)]
    assert read("<p class='x' <b>y") == ["<p class='x' ", ("b", {}, False), "y"]
    assert read("&#99999999999;&#x110000;&#0000000000065;&#" + "9" * 6000 + ";") == ["��A�"]


SHAPES = ["<a x='", '<a x="', "<!--", "<![", "<!", "<?", "</", "</a", "<", "<a", "<a ", "<a =", "<a x=", "<script>", "<title>", "<style", "&", "&#", "&#9", "&a", "<figcaption>", "<figcaption> <p>", "<figure>", "<a x='<a x=\"", "<p ><!-", "<img src=x ", "</title", "\n", "<a\x0b"]


@pytest.mark.parametrize("shape", SHAPES)
@pytest.mark.parametrize("end", ["", "'>-->"])
def test_a_megabyte_of_a_shape_is_read_at_once(shape, end):
    page = shape * (MEGABYTE // len(shape)) + end
    began = time.process_time()
    media.sequence(page)
    assert time.process_time() - began < 5


def test_random_strings_are_pages():
    rng = random.Random(2)
    parts = [*SHAPES, ">", "/>", "'", '"', "=", " ", "x", "</p>", "</figcaption>", "<img src=u alt=v>", "&amp;", "é", "\0", "]]>", "-->", "</script>", "template>"]
    for _ in range(10_000):
        page = "".join(rng.choice(parts) for _ in range(rng.randint(0, 40)))
        found = media.sequence(page)
        assert [e["position"] for e in found] == list(range(len(found)))
    for _ in range(2_000):
        media.sequence("".join(chr(rng.choice([60, 62, 33, 45, 47, 91, 39, 34, 61, rng.randrange(32, 300)])) for _ in range(60)))


class Plain(HTMLParser):
    """Pages as the library's parser reads them."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.page = media.Sequence()

    def handle_starttag(self, tag, attrs):
        self.page.opened(tag, dict(attrs), False)

    def handle_startendtag(self, tag, attrs):
        self.page.opened(tag, dict(attrs), True)

    def handle_endtag(self, tag):
        self.page.closed(tag)

    def handle_data(self, data):
        self.page.text(data)


def test_all_pages_as_another_parser_reads_them(spark):
    """``pages`` holds well-formed tags; on all of its rows both parsers give the same sequences."""
    rows = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()
    for r in rows:
        plain = Plain()
        plain.feed(r["html"])
        plain.close()
        plain.page.finish()
        assert media.sequence(r["html"]) == plain.page.out, r["page_id"]


def test_a_text_of_many_tokens_and_addresses(spark):
    """Every token finds its span by halving: 200,000 tokens of which half are addresses, and a small text by the plain graph."""
    texts = [(0, "x1 me@host.org " * 100_000), (1, "card 4111 1111 1111 1111 call +1 (017) 555-7713 a@b.co 1.2.3.4 x 1.2.3.4, +12 345 678 901 2345 " * 9), (2, "W" * 70 + " 12 " + "w" * 70 + " a@b.co " + "w" * 69 + "W c@d.co"), (3, None)]
    began = time.time()
    found = {r["doc_id"]: r for r in pii.personal_data(spark.createDataFrame(texts, "doc_id long, text string").repartition(4)).select("doc_id", F.size("pii.email").alias("n"), F.size("context").alias("c")).collect()}
    assert (found[0]["n"], found[0]["c"]) == (100_000, 0) and time.time() - began < 60
    small = spark.createDataFrame(texts[1:], "doc_id long, text string")
    rows = pii.personal_data(small)
    base = F.concat(*[pii.placed(F.col("pii")[k], i, k) for i, k in enumerate(pii.KINDS)])
    every = pii.joined(F.concat(base, pii.placed(F.col("context"), 4, "context")))
    assert {r["doc_id"]: r["s"] for r in rows.select("doc_id", every.alias("s")).collect()} == {r[0]: r[-1] for r in plain_pii(texts[1:])}


OPENINGS = {"jwt": ["eyJ", "eyJ.", "eyJaaaaaaaa.", "eyJ-"], "assign": ["token", "token ", "token:", "token: ", "token=\""], "access": ["AKIA", "AKIA "], "hex": ["a", "abc "], "github": ["ghp_", "ghp_a"], "slack": ["xoxb-", "xoxb"], "google": ["AIza", "AIza_"], "stripe": ["sk_live_", "sk_live_a"], "pem": ["-----BEGIN ", "-----BEGIN A"]}


@pytest.mark.parametrize("kind", list(OPENINGS))
def test_every_rule_is_linear(spark, kind):
    rule = next(r for r in secrets.RULES if r.kind == kind)
    for opening in OPENINGS[kind]:
        text = opening * (MEGABYTE // len(opening)) + " eyJhbGciOiJI"
        began = time.time()
        spark.createDataFrame([(text,)], "text string").select(F.size(secrets._spans(rule, None)).alias("n")).collect()
        assert time.time() - began < 10, opening


def test_tokens_are_found_inside_of_runs(spark):
    """What stands before a token in its run is no part of it."""
    text = "xeyJhbGciOiJI.eyJzdWIiOiIx.c2lnbmF0dXJl eyJ.eyJhbGciOiJI.eyJzdWIiOiIx.c2lnbmF0dXJl -eyJeyJeyJabcdefg.eyJ12345678.12345678 eyJshort.eyJ12345678.12345678"
    got = spark.createDataFrame([(text,)], "text string").select(secrets._spans(secrets.RULES[-1], None).alias("s")).first()["s"]
    want = [(m.start(), m.end(), m[0]) for m in secrets.python_pattern(secrets.RULES[-1]).finditer(text)]
    assert [(s["start"], s["end"], s["text"]) for s in got] == want and len(want) == 3


def test_the_session_stays_as_it_was(spark, tmp_path):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    with pytest.raises(RuntimeError), shared.small_batches(spark):
        assert spark.conf.get(key) == str(min(shared.TEXT_ROWS, int(before)))
        raise RuntimeError
    assert spark.conf.get(key) == before
    kept = shared.written(spark.range(3), "kept")
    assert kept.count() == 3
    where = shared.folder(spark).removeprefix("file:")
    assert os.listdir(where)
    shared.clear(spark)
    assert not os.path.exists(where)
    assert shared.written(spark.range(4), "again").count() == 4
