"""Search over stored postings against plain scores, block skipping, and what is read."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from marketlens.operators import postings


def documents(n=600):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(60)]
    rows = [(f"d{i:04}", " ".join(rng.choices(words, [1 / (k + 1) for k in range(60)], k=rng.choice([3, 20, 20, 80])))) for i in range(n)]
    return rows + [("empty", ""), ("null", None), ("tie-a", "w1 w59 x"), ("tie-b", "w59 w1 x")]


def plain(rows, terms, limit):
    words = {i: (t or "").split() for i, t in rows}
    mean = sum(map(len, words.values())) / len(words)
    df = {t: sum(t in w for w in words.values()) for t in terms}
    scores = {}
    for i, w in words.items():
        tf = Counter(w)
        if any(tf[t] for t in terms):
            scores[i] = round(sum(math.log(1 + (len(words) - df[t] + 0.5) / (df[t] + 0.5)) * tf[t] * 2.2 / (tf[t] + 1.2 * (0.25 + 0.75 * len(w) / mean)) for t in terms), 6)
    return sorted(((s, i) for i, s in scores.items()), key=lambda x: (-x[0], x[1]))[:limit]


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("index"))
    docs = spark.createDataFrame(documents(), "name string, body string").withColumn("id", F.lit(1)).withColumn("term", F.lit("x"))
    postings.write_index(docs, path, "name", "body", segment_rows=64)
    return path


@pytest.mark.parametrize("limit", [1, 7, 2000])
def test_same_as_plain_scores(spark, index, limit):
    wanted = {1: ["w0", "w5"], 2: ["w59", "w1"], 3: ["w40", "nowhere"], 4: ["nowhere"], 5: [f"w{i}" for i in range(60)]}
    terms = spark.createDataFrame([(r, t) for r, ts in wanted.items() for t in ts + ts[:1]] + [(6, None)], "request_id long, term string")
    got = {}
    for r in postings.search(spark, index, terms, "name", limit=limit).orderBy("request_id", "rank").collect():
        got.setdefault(r["request_id"], []).append((r["score"], r["name"]))
    for request, ts in wanted.items():
        best = plain(documents(), ts, limit)
        assert [i for _, i in got.get(request, [])] == [i for _, i in best]
        assert np.allclose([s for s, _ in got.get(request, [])], [s for s, _ in best], atol=2e-6)
    assert set(got) == {1, 2, 3, 5}


def test_only_the_buckets_of_the_terms_are_read(spark, index, plan_of):
    terms = spark.createDataFrame([(1, "w0"), (1, "w5")], "request_id long, term string")
    plan = plan_of(postings.search(spark, index, terms, "name"))
    assert "PartitionFilters: [bucket" in plan and "CartesianProduct" not in plan
    stored = spark.read.parquet(f"{index}/postings")
    assert stored.select(F.max(F.size("id"))).first()[0] <= 64 and stored.filter("term = 'w0'").count() > 5


def test_blocks_that_cannot_win_are_skipped():
    rng = np.random.default_rng(1)
    best, want = postings.Best(3), []
    for segment in range(10):
        lists = []
        scores = np.zeros(200)
        for rarity in (1.0, 2.0):
            block = np.sort(rng.integers(8, size=200))
            parts = rng.random(200) * (block + 1)
            ids = np.arange(200)
            blocks = np.unique(block)
            lists.append((rarity, blocks, np.array([parts[block == b].max() for b in blocks]), block, ids + 1000 * segment, parts))
            scores += rarity * parts
        # a document lies in one block: align the second list with the first
        lists[1] = (2.0, lists[0][1], np.array([lists[1][5][lists[0][3] == b].max() for b in lists[0][1]]), lists[0][3], lists[0][4], lists[1][5])
        want += list(zip(scores.tolist(), (np.arange(200) + 1000 * segment).tolist()))
        best.add(lists)
    top = sorted(want, reverse=True)[:3]
    mine = sorted(zip(best.scores.tolist(), best.ids.tolist()), reverse=True)[:3]
    assert [i for _, i in mine] == [i for _, i in top] and np.allclose([x for x, _ in mine], [x for x, _ in top])
    assert best.skipped > best.scored


def test_empty_index_and_no_terms(spark, tmp_path):
    docs = spark.createDataFrame(documents(3), "name string, body string")
    none = spark.createDataFrame([], "request_id long, term string")
    postings.write_index(docs, f"{tmp_path}/a", "name", "body")
    assert postings.search(spark, f"{tmp_path}/a", none, "name").count() == 0
    postings.write_index(docs.filter("name = 'null'"), f"{tmp_path}/b", "name", "body")
    for name in "ab":
        assert postings.search(spark, f"{tmp_path}/{name}", spark.createDataFrame([(1, "zzz")], "request_id long, term string"), "name").count() == 0


@pytest.mark.parametrize("frequent", [1, 6, 1000])
def test_keywords_by_bounds(spark, frequent):
    """Whatever share of the vocabulary is broadcast, the same words come out."""
    from marketlens.operators import retrieval

    rows = documents(200) + [("rare", "w0 w0 w0 w0 zebra"), ("two", "a b")]
    words = {i: (t or "").split() for i, t in rows}
    df = Counter(w for ws in words.values() for w in set(ws))
    want = {}
    for i, ws in words.items():
        best = sorted((-round(n * math.log((len(rows) + 1) / (df[w] + 1)), 6), w) for w, n in Counter(ws).items())[:3]
        if best:
            want[i] = [w for _, w in best]
    table = spark.createDataFrame(rows, "name string, body string")
    got = {}
    for r in retrieval.keyword_extract(table, "name", "body", 3, frequent=frequent).orderBy("name", "rank").collect():
        got.setdefault(r["name"], []).append(r["term"])
    assert got == want
    assert retrieval.keyword_extract(table.filter("false"), "name", "body").count() == 0


def test_idf_weighs_rare_words(spark):
    from marketlens.operators import retrieval

    table = spark.createDataFrame([(1, "common rare"), (2, "common"), (3, "common"), (4, None), (5, "")], "id long, body string")
    idf = retrieval.fit_idf(table, "body")
    vectors = {r["id"]: r["embedding"] for r in retrieval.embed_hash(table, "body", idf=idf).collect()}
    seen = sorted(x for x in vectors[1] if x)
    assert vectors[4] is None and not any(vectors[5]) and len(seen) == 2
    assert seen[1] / seen[0] == pytest.approx((math.log(5 / 2) + 1) / (math.log(5 / 4) + 1), rel=1e-5)
    with pytest.raises(ValueError, match="each place"):
        retrieval.embed_hash(table, "body", idf=[1.0])


def test_an_index_is_made_with_one_exchange_of_texts_and_bounded_segments(spark, tmp_path, monkeypatch, plan_of):
    """Words are not exchanged one by one, long texts make more segments, and rows of one id and length are one document."""
    plans = []
    write = postings.write_partitioned
    monkeypatch.setattr(postings, "write_partitioned", lambda df, *a: (plans.append(plan_of(df)), write(df, *a)))
    long = [("long", " ".join(f"w{i % 50}" for i in range(3_000))), ("same", "Éx w1, W1"), ("same", "w1 w1 y"), (None, "w1")]
    docs = spark.createDataFrame(documents(60) + long, "name string, body string")
    postings.write_index(docs, f"{tmp_path}/a", "name", "body", segment_words=100)
    assert plans[0].count("Exchange hashpartitioning") + plans[0].count("\nArguments: hashpartitioning") == 1 and "Generate" not in plans[0]
    stored = spark.read.parquet(f"{tmp_path}/a/postings")
    assert stored.select("segment").distinct().count() > 20
    rows = stored.filter("term = 'w1'").select(F.explode(F.arrays_zip("id", "part", "block"))).select("col.*").collect()
    n = spark.read.parquet(f"{tmp_path}/a/figures").first()
    sizes = {(i, len(postings_words(t))): None for i, t in docs.collect()}
    assert n["n"] == len(sizes) and n["mean_length"] == pytest.approx(sum(k for _, k in sizes) / len(sizes))
    parts = {r["id"]: r["part"] for r in rows}
    length = 3 / n["mean_length"]
    assert len(rows) == len(parts) and None in parts
    assert parts["same"] == pytest.approx(4 * 2.2 / (4 + 1.2 * (0.25 + 0.75 * length)))


def postings_words(t):
    return re.findall(r"[^\W_]+", (t or "").lower())
