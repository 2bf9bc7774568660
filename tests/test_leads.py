"""Deduplication, tagging and verdict rules on literal rows."""

from pyspark.sql import functions as F

from marketlens.operators import leads, matching, scoring
from marketlens.plans import dimensions as dim
from marketlens.plans.leads import raw_leads


def lead_rows(spark, rows):
    return spark.createDataFrame(rows, "source_file string, ordinal long, email string")


def kept(df):
    return sorted((r["source_file"], r["ordinal"]) for r in df.collect())


def test_leads_without_email_collapse_per_file(spark):
    rows = [("f", 0, None), ("f", 1, None), ("g", 0, None), ("f", 2, "a@b.co"), ("f", 3, "A@B.co")]
    df = lead_rows(spark, rows)
    assert kept(leads.dedupe_leads(df)) == [("f", 0), ("f", 2), ("g", 0)]
    assert kept(leads.dedupe_leads(df, null_key="keep")) == [("f", 0), ("f", 1), ("f", 2), ("g", 0)]


def test_composite_key_collision_and_option(spark):
    df = spark.createDataFrame(
        [("f", 0, "a_b", "c"), ("f", 1, "a", "b_c")], "source_file string, ordinal long, x string, y string"
    )
    assert kept(leads.dedupe_leads(df, ["x", "y"])) == [("f", 0)]
    assert kept(leads.dedupe_leads(df, ["x", "y"], composite="struct")) == [("f", 0), ("f", 1)]


def test_empty_key_rows_are_dropped(spark):
    assert kept(leads.dedupe_leads(lead_rows(spark, [("f", 0, ""), ("f", 1, "x")]))) == [("f", 1)]


def test_dedupe_is_idempotent_and_keeps_the_first(spark, sf_dir):
    once = leads.dedupe_leads(leads.clean_leads(raw_leads(spark, sf_dir), timestamp=False))
    assert kept(leads.dedupe_leads(once)) == kept(once)


def test_null_address_and_default_source(spark):
    row = [("f", 0, "Ann", None, None, None, None, None, None, None, None, None, None)]
    schema = "source_file string, ordinal long, full_name string, email string, phone string, company string, job_title string, address struct<street:string,city:string,postal_code:string,country:string>, linkedin_url string, website_url string, industry string, company_size string, source string"
    got = leads.clean_leads(spark.createDataFrame(row, schema)).first()
    assert got["address"]["street"] is None and got["source"] == "Unknown"
    assert got["last_updated"] is not None and len(got["id"]) == 64


def test_hot_key_is_cut_before_the_exchange(spark, sf_dir, plan_of):
    plan = plan_of(leads.dedupe_leads(leads.clean_leads(raw_leads(spark, sf_dir), timestamp=False)))
    assert "WindowGroupLimit" in plan and "Partial" in plan
    assert "Python" not in plan and plan.count("Exchange") <= 3


def test_tags_group_by_label(spark):
    rows = spark.createDataFrame([(1, "CTO Acme Tech, Paris"), (2, "nobody")], "id long, t string")
    words = spark.createDataFrame(
        [("Acme Tech", "ORG"), ("Paris", "GPE"), ("CTO", "TITLE"), ("Tech", "ORG")], "surface string, label string"
    )
    got = {r["id"]: r for r in leads.tag_entities(rows, "t", words, "id").collect()}
    assert got[1]["organizations"] == ["Acme Tech"]
    assert got[1]["locations"] == ["Paris"] and got[1]["persons"] == []
    assert got[1]["misc"][0].asDict() == {"text": "CTO", "label": "TITLE"} and 2 not in got


def test_verdicts(spark):
    full = '{"relevance_score": %d, "market_viability": %d, "competitive_edge": 6, "revenue_model": 6, "team_capability": 6}'
    rows = [(1, full % (6, 6)), (2, full % (6, 5)), (3, full % (3, 6)), (4, "not json"), (5, "[1]"), (6, "{}")]
    df = spark.createDataFrame(rows, "id long, response string")
    out = {
        r["id"]: r
        for r in scoring.evaluate_ideas(df, dim.SCORE_KEYS, dim.SUGGESTIONS, dim.PASS_THRESHOLD).collect()
    }
    assert (out[1]["verdict"], out[1]["next"], out[1]["weak_areas"]) == ("pass", "continue", [])
    assert (out[2]["verdict"], out[2]["next"]) == ("fail", "revise")
    assert out[2]["suggestions"] == {"Market Viability": dim.SUGGESTIONS["Market Viability"]}
    assert out[3]["suggestions"] == {"relevance_score": []}
    assert out[4]["status"] == "error" and out[4]["raw"] == "not json" and out[4]["verdict"] is None
    assert out[5]["status"] == "error" and len(out[6]["weak_areas"]) == 5


def test_aliased_suggestions(spark):
    df = spark.createDataFrame([(1, ["relevance_score"])], "id long, weak_areas array<string>")
    dims = dim.suggestions(spark)
    assert scoring.suggest_fixes(df, dims, "id").first()["suggestions"] == []
    alias = {"relevance_score": "Relevance to FinTech"}
    assert len(scoring.suggest_fixes(df, dims, "id", alias).first()["suggestions"]) == 2


def test_fuzzy_match_finds_every_pair(spark):
    import itertools

    words = ["acme", "acne", "ame", "acmee", "mace", "zzz", "acme", "ac", "a", "", "xcmx"]
    df = spark.createDataFrame([(w,) for w in words], "n string")

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, prev = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(prev[j] + 1, row[-1] + 1, prev[j - 1] + (x != y)))
        return row[-1]

    for limit in (0, 1, 2):
        got = {(r["left_name"], r["right_name"]): r for r in matching.fuzzy_match(df, df, "n", "n", limit).collect()}
        want = {(a, b) for a, b in itertools.product(set(words), repeat=2) if edits(a, b) <= limit}
        assert set(got) == want
        assert all(r["edits"] == edits(*pair) for pair, r in got.items())
        assert got["acme", "acme"]["left_records"] == 2


def test_fuzzy_match_broadcasts_no_forms(spark, plan_of):
    df = spark.createDataFrame([("acme",), ("acne",)], "n string")
    pairs = matching.fuzzy_match(df, df, "n", "n")
    assert "SortMergeJoin" in plan_of(pairs) and "Broadcast" not in plan_of(pairs)


def test_fuse_loses_no_record(spark):
    left = spark.createDataFrame([(1, "k", None), (2, "k", "b"), (3, None, "c")], "company_id long, n string, s string")
    right = spark.createDataFrame([(8, "k", "e"), (9, None, "f"), (10, "z", "g"), (11, "k", "h")], "external_id long, n string, s string")
    out = matching.fuse(left, right, F.col("n"), ("company_id", "external_id"), ["n", "s"])
    got = {(r["company_id"], r["external_id"], r["s"]) for r in out.collect()}
    assert got == {(1, 8, "e"), (2, 8, "b"), (3, None, "c"), (None, 9, "f"), (None, 10, "g"), (None, 11, "h")}


def test_fuse_takes_keys_as_given(spark):
    left = spark.createDataFrame(list(enumerate(["Acme", "ACME", "acme", "", "dup", "dup"], 1)), "a long, n string")
    right = spark.createDataFrame([(10, "ACME"), (11, "")], "b long, n string")
    out = matching.fuse(left, right, F.col("n"), ("a", "b"), ["n"])
    assert {(r["a"], r["b"]) for r in out.collect()} == {(1, None), (2, 10), (3, None), (4, 11), (5, None), (6, None)}


def test_long_names_are_tagged(spark):
    rows = spark.createDataFrame([(1, "VP at Bank of New York Mellon")], "id long, t string")
    words = spark.createDataFrame([("Bank of New York Mellon", "ORG"), ("New York", "GPE")], "surface string, label string")
    got = leads.tag_entities(rows, "t", words, "id").first()
    assert got["organizations"] == ["Bank of New York Mellon"] and got["locations"] == []
