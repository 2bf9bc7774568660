"""Rows of the last review: distances at any norm, markup without limits, request ids of any type."""

import html

import numpy as np
import pytest
from pyspark.sql import functions as F

from marketlens.functions.html import html_to_text, unescape
from marketlens.functions.parsing import response_normalize
from marketlens.operators import cues, neighbours, retrieval
from marketlens.plans import dimensions as dim


@pytest.mark.parametrize("options", [{}, {"broadcast_values": 1, "block_rows": 8}])
@pytest.mark.parametrize("norm,place", [(1e-6, 0.0), (1.0, 0.0), (1e8, 0.0), (0.5, 1e8)])
def test_neighbours_at_any_norm(spark, norm, place, options):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(60, 6)) * norm + place
    v[40:45] = v[7]
    rows = [(i, [float(x) for x in r]) for i, r in enumerate(v)] + [(100, None)]
    items = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    found = neighbours.nearest(items, items, 5, query_columns=("vec_id", "embedding"), skip_self=True, **options)
    got = {}
    for r in found.orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["item_id"])
    for i in range(60):
        d = ((v - v[i]) ** 2).sum(axis=1)
        assert got[i] == [j for _, j in sorted((x, j) for j, x in enumerate(d) if j != i)[:5]]
    assert set(got) == set(range(60))


REFERENCES = [
    "a &amp b", "&copy 2", "&copy2;", "&#x10FFFD;", "&#x0000041;", "&#65", "&#128;", "&#0;", "&#xD800;", "&#99999999999;",
    "&notin; &notit; &nosuch; & &; &#; &#x; &NotEqualTilde;", "&lt;b&gt;", "&#1;x&#11;y", "&#129;", "&amp;lt;", "&hellip;",
]


def test_references(spark):
    df = spark.createDataFrame([(t,) for t in REFERENCES], "t string")
    for r in df.select("t", unescape(F.col("t")).alias("u")).collect():
        assert r["u"] == html.unescape(r["t"]), r["t"]


def test_any_number_of_attributes(spark):
    tag = "<p " + " ".join(f'a{i}="x"' for i in range(5000)) + ' z="a > b">Text</p>'
    df = spark.createDataFrame([(tag,), ('<p a="1" b=\'2>3\'>x<br>y',)], "t string")
    assert [r[0] for r in df.select(html_to_text("t")).collect()] == ["Text", "x y"]


def test_request_ids_of_any_type_and_repeated_terms(spark):
    docs = spark.createDataFrame([(1, "red fox"), (2, "red red hen"), (3, "blue")], "id long, t string")
    terms = spark.createDataFrame([("q-a", "red"), ("q-a", "red"), ("q-b", "hen")], "request_id string, term string")
    got = {(r["request_id"], r["rank"]): r["id"] for r in retrieval.bm25(docs, terms, "id", "t").collect()}
    assert got == {("q-a", 1): 2, ("q-a", 2): 1, ("q-b", 1): 2}
    empty = retrieval.bm25(docs.limit(0), terms, "id", "t")
    assert empty.count() == 0 and retrieval.bm25(docs, terms.limit(0), "id", "t").count() == 0


def test_responses_are_compact_json_or_text(spark):
    rows = {
        '{"b": 1, "a": {"n": 1.5}}': '{"b":1,"a":{"n":1.5}}', "[1, 2]": "[1,2]", ' "a b" ': '"a b"', "null": "null",
        '{"a": 1} and more': '{"a": 1} and more', "1, 2": "1, 2", "1] [2": "1] [2", "1}{": "1}{",
        "{'a':1}": "{'a':1}", " plain ": "plain", "": "",
    }
    df = spark.createDataFrame([(r,) for r in rows] + [(None,)], "r string")
    got = {r["r"]: r["n"] for r in df.select("r", response_normalize("r").alias("n")).collect()}
    assert got == rows | {None: None}


def test_contexts_and_questions_are_not_filled(spark):
    asked = spark.createDataFrame([("Rivalry", "about {question}", "why {context}?")], "force_name string, context string, question string")
    templates = spark.createDataFrame([("rivalry", "{context} | {question}")], "force string, template string")
    out = retrieval.render_prompt(asked, dim.forces(spark), templates, question="question").first()["prompt"]
    assert out == "about {question} | why {context}?"


def test_large_vocabularies_of_cues(spark):
    words = [f"term{i}" for i in range(3000)]
    df = spark.createDataFrame([("a term2999 and term7",)], "t string")
    assert df.select(cues.count_matches("t", words)).first()[0] == 2


def test_an_idea_is_not_filled(spark):
    ideas = spark.createDataFrame([("use {porter_force}",)], "idea string")
    prompt = retrieval.render_meta_prompt(ideas, ["Rivalry"], "{project_idea} / {porter_force}").first()["prompt"]
    assert prompt == "use {porter_force} / Rivalry"
