"""Literal rows for text functions."""

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from marketlens.functions import text
from marketlens.functions.html import html_to_text, unescape
from marketlens.operators.crawl import visible_text


def values(spark, fn, inputs):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], "i int, v string")
    return [r[1] for r in df.select("i", fn(F.col("v")).alias("o")).orderBy("i").collect()]


CASES = [
    (text.clean_str, [
        ("A & B", "A  B"), ("! x", " x"), (" ! ", None), ("Zoë & Søn²", "Zoë  Søn²"),
        ("a  b", "a b"), ("x\x1cy", "x y"), (None, None), ("", None),
    ]),
    (text.normalize_email, [
        (" User@Example.COM ", "user@example.com"), ("no-at", None), ("a@b", None),
        (" a@b.io\n", "a@b.io"), (None, None), ("", None),
    ]),
    (text.normalize_phone, [
        ("(415) 555-2671", "+14155552671"), ("1-212-555-0100", "+12125550100"),
        ("+44 20 7946 0958", "+442079460958"), ("12345", None), ("+1 123 555 0100", None),
        ("0123456789", None), (None, None),
    ]),
    (text.normalize_url, [
        ("example.com/a", "http://example.com/a"), ("HTTPS://UP.example", None),
        ("mailto:x@y", "http://mailto:x@y"), ("ftp://f.example", None), ("", None),
        (" https://é.org ", "https://é.org"), ("   ", None),
    ]),
    (text.title_case, [
        ("mary-jane o.k 3rd mcDONALD", "Mary-Jane O.K 3Rd Mcdonald"), ("élan", "Élan"),
    ]),
    (text.first_name, [("  mary ann lee", "Mary"), (" ", None), ("x", "X")]),
    (text.last_name, [("mary ann lee", "Ann Lee"), ("x", None), ("A  B", "B")]),
    (lambda c: F.array_join(text.keyword_split(c), "|"), [
        ('a, "b c" ,, " ,"', 'a|b c||'), (" , ,", ""),
    ]),
    (text.extract_status, [("Failed to extract content: x", "failed"), ("fine", "ok")]),
    (unescape, [
        ("&lt;b&gt; &amp;amp; &eacute; &#233;&#xE9; &#x1F600; &bogus; & &#xD800;",
         "<b> &amp; é éé \U0001F600 &bogus; & \ufffd"),
    ]),
]


@pytest.mark.parametrize("fn,cases", CASES)
def test_literal_rows(spark, fn, cases):
    assert values(spark, fn, [i for i, _ in cases]) == [o for _, o in cases]


def test_keyword_packing_stops_at_the_first_overflow(spark):
    df = spark.createDataFrame([("aa, bbb, c", "orig"), (",", "orig")], "k string, f string")
    packed = df.select(text.keyword_pack(text.keyword_split("k"), "f", budget=6)).collect()
    assert [r[0] for r in packed] == ["aa", "orig"]


def test_keywords_are_split_once_and_by_many_tasks(spark, sf_dir, plan_of):
    from marketlens import plans

    for name in ("keyword_pack", "search_query_text"):
        plan = plan_of(plans.QUERIES[name](spark, sf_dir))
        assert plan.count(", ,, -1)") == 1 and "RoundRobinPartitioning" in plan
    rows = [("\u3000,\x1f\x85 ,a,\u200b, \n", "f"), (" ,", "f"), (None, "f"), ('",",b', "f")]
    df = spark.createDataFrame(rows, "k string, f string")
    packed = df.select(text.keyword_pack(text.keyword_split("k"), "f")).collect()
    assert [r[0] for r in packed] == ["a OR \u200b", "f", "f", "b"]


@pytest.mark.parametrize("fn", [text.normalize_email, text.normalize_url])
def test_idempotent(spark, fn):
    inputs = [" A@b.CO ", "a.example", "http://x y", "https://%41", "x@@y.zz", "http://-", "é@b.co"]
    once = values(spark, fn, inputs)
    assert values(spark, fn, once) == once


PAGES = [
    ("<p>a<!-- x <p> -->b</p>", "a b"),
    ('<script>var t="</p>";</script>x', "x"),
    ("<noscript><p>no</p></noscript>y<style>p{}</style>", "y"),
    ("<title>T</title> <b> u &amp; v </b>\n w", "T u & v w"),
    ('<a href="x>y">link</a>', "link"),
    ("a < b", "a < b"),
    ("<!DOCTYPE html><p>one\n two</p>", "one\n two"),
    ("&nbsp;<i>&copy;</i>", "©"),
    ("<SCRIPT>x</SCRIPT >z", "z"),
]


@pytest.mark.parametrize("variant", ["jvm", "strict"])
def test_html_to_text(spark, variant):
    if variant == "jvm":
        got = values(spark, html_to_text, [p for p, _ in PAGES])
    else:
        got = [visible_text(p) for p, _ in PAGES]
    assert got == [t for _, t in PAGES]


@settings(max_examples=20, deadline=None)
@given(st.lists(st.text(max_size=30), min_size=1, max_size=8))
def test_strip_and_clean_agree_with_python(spark, inputs):
    import re

    inputs = [s.replace("\x00", "").encode("utf-8", "ignore").decode() for s in inputs]
    assert values(spark, text.strip, inputs) == [s.strip() for s in inputs]
    # Latin only: which newer characters count as letters depends on each runtime's Unicode.
    plain = ["".join(c for c in s if ord(c) < 0x250) for s in inputs]

    def clean(s):
        squeezed = re.sub(r"\s+", " ", s).strip()
        return re.sub(r"[^\w\s.,\-@:/]", "", squeezed) or None

    assert values(spark, text.clean_str, plain) == [clean(s) for s in plain]


def test_factored_pattern_equals_plain_alternation(spark):
    import random
    import re

    from marketlens.operators.cues import matches, term_pattern
    from marketlens.plans.dimensions import CUES

    terms = [t for _, t, _ in CUES] + ["brand new", "brand new car", "a", "a+b", "car"]
    rnd = random.Random(3)
    words = [w for t in terms for w in t.split()] + ["brands", "xa", "new", "a-b", "carbon"]
    lines = [" ".join(rnd.choices(words, k=12)) for _ in range(200)]
    plain = re.compile(r"\b(" + "|".join(map(re.escape, sorted(set(terms), key=lambda t: -len(t)))) + r")\b")
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, v string")
    got = [r[1] for r in df.select("i", matches("v", terms)).orderBy("i").collect()]
    assert got == [plain.findall(x) for x in lines]
    assert re.compile(term_pattern(terms)).findall(lines[0]) == plain.findall(lines[0])
