"""Exact neighbours against brute force, with clusters, ties and a crowded cell."""

import re

import numpy as np
import pytest

from marketlens.operators import neighbours, retrieval


def corpus_rows():
    rng = np.random.default_rng(7)
    crowd = np.array([3.0, 3.0, 0, 0]) + rng.normal(scale=0.01, size=(160, 4))
    spread = rng.normal(size=(240, 4))
    same = np.tile([0.5, 0.5, 0.5, 0.5], (80, 1))
    return np.round(np.vstack([crowd, spread, same]), 4).astype(np.float32)


def brute(vectors, queries, k, skip_self):
    out = {}
    for qi, q in queries.items():
        d = np.round(((vectors.astype(float) - q.astype(float)) ** 2).sum(axis=1), 8)
        order = sorted((x, i) for i, x in enumerate(d) if not (skip_self and i == qi))[:k]
        out[qi] = [i for _, i in order]
    return out


def table(spark, rows, name="vec_id"):
    return spark.createDataFrame(
        [(int(i), [float(x) for x in v]) for i, v in rows], f"{name} long, embedding array<float>"
    ).repartition(5)


def ranked(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append(r["item_id"])
    return out


@pytest.mark.parametrize("options", [{}, {"broadcast_values": 1, "block_rows": 40}, {"broadcast_values": 1}])
@pytest.mark.parametrize("skip_self", [False, True])
def test_matches_brute_force(spark, options, skip_self):
    v = corpus_rows()
    items = table(spark, enumerate(v))
    got = neighbours.nearest(
        items, items, 5, query_columns=("vec_id", "embedding"), skip_self=skip_self, **options
    )
    assert ranked(got) == brute(v, dict(enumerate(v)), 5, skip_self)


def test_small_corpus_and_no_queries(spark):
    items = table(spark, [(1, [0.0, 1.0]), (2, [1.0, 0.0])])
    asked = table(spark, [(7, [0.0, 0.9])], "query_id")
    for options in ({}, {"broadcast_values": 1}):
        assert ranked(neighbours.nearest(asked, items, 4, **options)) == {7: [1, 2]}
        assert neighbours.nearest(asked.filter("false"), items, 4, **options).count() == 0
        assert neighbours.nearest(asked, items.filter("false"), 4, **options).count() == 0


def test_rows_without_a_vector_are_no_neighbours(spark):
    schema = "vec_id long, embedding array<float>"
    items = spark.createDataFrame([(1, [0.0, 1.0]), (2, None), (3, [1.0, 0.0])], schema)
    for options in ({}, {"broadcast_values": 1}):
        got = neighbours.nearest(
            items, items, 4, query_columns=("vec_id", "embedding"), skip_self=True, **options
        )
        assert ranked(got) == {1: [3], 3: [1]}


def test_no_row_pairs_in_the_plan(spark, plan_of):
    items = table(spark, enumerate(corpus_rows()))
    plan = plan_of(neighbours.nearest(items, items, query_columns=("vec_id", "embedding")))
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_embeddings_are_unit_and_repeatable(spark):
    df = spark.createDataFrame([(1, "pay by card"), (2, "Card by PAY!"), (3, "open bank"), (4, "")], "id long, t string")
    e = {r["id"]: np.array(r["embedding"]) for r in retrieval.embed_hash(df, "t").collect()}
    assert np.allclose(e[1], e[2]) and np.isclose(np.linalg.norm(e[1]), 1, atol=1e-6)
    assert e[1] @ e[3] < 0.99 and not e[4].any()


def test_search_equals_plain_scores(spark, sf_dir):
    from marketlens.plans import dimensions as dim
    from marketlens.sources.tables import table as given

    docs = given(spark, sf_dir, "documents")
    terms = retrieval.query_terms(dim.local_table(spark, "request_id force keywords", dim.SEARCHES), "keywords")
    got = retrieval.bm25(docs, terms, "doc_id", "text").collect()
    words = {r["doc_id"]: re.findall(r"[^\W_]+", (r["text"] or "").lower()) for r in docs.collect()}
    mean = sum(map(len, words.values())) / len(words)
    asked: dict = {}
    for r in terms.collect():
        asked.setdefault(r["request_id"], set()).add(r["term"])
    df = {t: sum(t in w for w in words.values()) for ts in asked.values() for t in ts}
    for request, wanted in asked.items():
        scores = {}
        for d, w in words.items():
            tf = {t: w.count(t) for t in wanted if t in w}
            if tf:
                scores[d] = sum(
                    np.log(1 + (len(words) - df[t] + 0.5) / (df[t] + 0.5)) * n * 2.2
                    / (n + 1.2 * (0.25 + 0.75 * len(w) / mean)) for t, n in tf.items()
                )
        best = sorted(scores.values(), reverse=True)[:50]
        mine = sorted((r for r in got if r["request_id"] == request), key=lambda r: r["rank"])
        assert np.allclose([r["score"] for r in mine], best, atol=2e-6)
        assert all(np.isclose(scores[r["doc_id"]], r["score"], atol=2e-6) for r in mine)


def test_prompts(spark):
    from marketlens.plans import dimensions as dim

    df = spark.createDataFrame([("Buyer Power Force", "c{x}"), ("Rivalry", "d"), ("Nope", "e")], "force_name string, context string")
    out = retrieval.render_prompt(df, dim.forces(spark), dim.templates(spark), unknown="keep").collect()
    got = {r["force_name"]: (r["force"], r["prompt"]) for r in out}
    assert got["Buyer Power Force"][0] == "buyer_power" and "c{x}" in got["Buyer Power Force"][1]
    assert got["Rivalry"][0] == "rivalry" and got["Nope"] == (None, None)
    with pytest.raises(Exception, match="Unknown force: Nope"):
        retrieval.render_prompt(df, dim.forces(spark), dim.templates(spark)).collect()


def test_best_rows_of_a_crowd_and_far_from_zero():
    rng = np.random.default_rng(5)
    v = np.vstack([rng.normal(size=(900, 6)), np.tile([0.25] * 6, (700, 1))])
    ids = np.concatenate([np.arange(1500), np.arange(100)])  # a hundred ids come twice
    for moved in (v, v * 1e-3 + 1e6, v * 1e18):
        best = neighbours._Best(ids, moved, 7, True)
        for low in range(0, 1600, 400):
            best.add(ids[low : low + 400], moved[low : low + 400])
        queries, items, distances = best.arrays()
        for q in range(0, 1600, 13):
            d = neighbours.squared_distances(moved, moved[q])
            want = sorted((x, i) for x, i in zip(d, ids) if i != ids[q])[:7]
            mine = slice(7 * q, 7 * q + 7)
            assert (queries[mine] == ids[q]).all() and list(zip(distances[mine], items[mine])) == want


def test_many_queries_meet_in_tasks_of_both_sides(spark, monkeypatch):
    """However few tasks read the items: neither one scan nor one coalesced partition does the work."""
    v = corpus_rows()
    items = table(spark, enumerate(v)).coalesce(1)
    tasks = []
    plain = neighbours.meet_in_blocks
    monkeypatch.setattr(neighbours, "meet_in_blocks", lambda *a: tasks.append(a[5]) or plain(*a))
    got = neighbours.nearest(items, items, 5, query_columns=("vec_id", "embedding"), block_rows=60)
    assert ranked(got) == brute(v, dict(enumerate(v)), 5, False)
    assert len(tasks) == 2 and all(t >= len(v) // 60 for t in tasks)
