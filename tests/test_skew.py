"""One key holds a third of all rows, and results stay whole."""

import pytest
from pyspark.sql import functions as F

from marketlens.operators import crawl, leads, matching, metrics, retrieval

ROWS = 30_000


@pytest.fixture(scope="module")
def skewed(spark):
    """Ids; ``k`` is one value for every third row and otherwise spread."""
    hot = F.col("id") % 3 == 0
    return spark.range(ROWS).repartition(16).select(
        "id", F.when(hot, F.lit("hot")).otherwise(F.concat(F.lit("k"), (F.col("id") % 5000).cast("string"))).alias("k")
    )


def test_keep_first(spark, skewed):
    rows = skewed.select(
        F.lit("f").alias("source_file"), F.col("id").alias("ordinal"), F.when(F.col("k") != "hot", F.col("k")).alias("email")
    )
    got = {r["email"]: r["ordinal"] for r in leads.dedupe_leads(rows).collect()}
    want = {}
    for i in range(ROWS):
        want.setdefault(None if i % 3 == 0 else f"k{i % 5000}", i)
    assert got == want


def test_content_copies(spark, skewed):
    got = {(r["id"], r["copies"]) for r in leads.dedupe_content(skewed, "k", "id").collect()}
    assert (0, ROWS // 3) in got and sum(c for _, c in got) == ROWS


def test_top_hits(spark, skewed):
    hits = skewed.select(
        F.col("k").alias("porter_force"), F.lit("s").alias("source"), (F.col("id") % 97).cast("double").alias("score"), F.col("id").alias("doc_id")
    )
    top = crawl.top_hits_per_source(hits).filter("porter_force = 'hot'").orderBy("hit_rank").collect()
    want = sorted((-(i % 97), i) for i in range(0, ROWS, 3))[:3]
    assert [(-int(r["score"]), r["doc_id"]) for r in top] == want


def test_fuzzy_names_with_a_crowded_name(spark, skewed):
    pairs = matching.fuzzy_match(skewed.filter("k = 'hot' or k = 'k17'"), skewed, "k", "k").collect()
    got = {(r["left_name"], r["right_name"]): (r["left_records"], r["right_records"]) for r in pairs}
    assert got["hot", "hot"] == (ROWS // 3, ROWS // 3)
    assert ("k17", "k170") in got and ("k17", "k7") in got and ("k17", "k1700") not in got


def test_fuse_with_a_third_keyless(spark, skewed):
    left = skewed.select(F.col("id").alias("a"), F.when(F.col("k") != "hot", F.col("k")).alias("n"))
    right = skewed.select(F.col("id").alias("b"), F.col("k").alias("n"))
    out = matching.fuse(left, right, F.col("n"), ("a", "b"), ["n"])
    # Every record of the left once, and on the right all but the first of each shared key.
    keys = len({f"k{i % 5000}" for i in range(ROWS) if i % 3})
    assert out.count() == 2 * ROWS - keys
    assert out.filter("fused_key is null").count() == ROWS // 3


def test_figures_and_scores(spark, skewed):
    notes = skewed.select(
        F.col("k").alias("entity_id"), F.lit("budget of $5K, churn 1.5%").alias("text")
    )
    reports = spark.createDataFrame([(1, "hot", "$5K and 7%"), (2, "none", "1.5%")], "report_id long, entity_id string, text string")
    got = {(r["report_id"], r["figure"]) for r in matching.ungrounded_numbers(reports, notes).collect()}
    assert got == {(1, "7%"), (2, "1.5%")}
    spent = {r["entity_id"]: r["budget"] for r in metrics.lead_scoring(notes, [("intent", "demo", 1.0), ("engagement", "asked", 1.0)]).collect()}
    assert spent["hot"] == 5000.0 * (ROWS // 3)


def test_keywords_with_a_word_in_every_third_document(spark, skewed):
    docs = skewed.select("id", F.concat_ws(" ", "k", F.concat(F.lit("w"), F.col("id").cast("string"))).alias("text"))
    got = retrieval.keyword_extract(docs, "id", "text", n=2)
    assert got.count() == 2 * ROWS
    assert {r["term"] for r in got.filter("id = 3").collect()} == {"hot", "w3"}


def test_figures_compared_by_value(spark):
    reports = spark.createDataFrame([(1, 7, "$5K, $1.1M, 5%, $5, $2,000.50 and 40.0%")], "report_id long, entity_id long, text string")
    notes = spark.createDataFrame([(7, "$5,000 and $1,100,000; $2000.5"), (7, "40% $5%"), (8, "5%")], "entity_id long, text string")
    got = {r["figure"] for r in matching.ungrounded_numbers(reports, notes, by_value=True).collect()}
    assert got == {"5%"}
    # As texts all differ: even `$5` carries the comma behind it.
    assert matching.ungrounded_numbers(reports, notes).count() == 6
