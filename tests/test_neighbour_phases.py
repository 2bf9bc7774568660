"""Bounded output of the exact search, and recall of the approximate one."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from marketlens.operators import inverted_file, neighbours
from test_neighbours import brute, ranked, table


def clustered(n, width=8, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, width)) * 3
    return np.round(centres[rng.integers(12, size=n)] + rng.normal(scale=0.3, size=(n, width)), 4).astype(np.float32)


def test_few_rows_come_back_from_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "FIRST_ROWS", 200)
    monkeypatch.setattr(neighbours, "FAN", 4)
    v, k, tasks = clustered(4000), 5, 64
    items = table(spark, enumerate(v)).repartition(tasks)
    asked = items.filter("vec_id < 20")
    scans = []
    plain = neighbours.scan
    monkeypatch.setattr(neighbours, "scan", lambda *a: scans.append(plain(*a)) or scans[-1])
    got = neighbours.nearest(asked, items, k, query_columns=("vec_id", "embedding"))
    assert ranked(got) == brute(v, {i: v[i] for i in range(20)}, k, False)
    sizes = [s.count() for s in scans]
    assert len(sizes) == 4  # samples of 1/64, 1/16 and 1/4, then all
    assert all(s < k * 20 * tasks / 4 for s in sizes[1:]) and sizes[-1] >= k * 20


@pytest.mark.parametrize("skip_self", [False, True])
def test_second_phase_returns_rows_within_the_bound(spark, monkeypatch, skip_self):
    v, k = clustered(3000), 5
    items = table(spark, enumerate(v))
    met = []
    plain = neighbours.meet_in_blocks
    monkeypatch.setattr(neighbours, "meet_in_blocks", lambda *a: met.append((a[0], plain(*a))) or met[-1][1])
    got = neighbours.nearest(items, items, k, query_columns=("vec_id", "embedding"), skip_self=skip_self, broadcast_values=1, block_rows=100)
    assert ranked(got) == brute(v, dict(enumerate(v)), k, skip_self)
    (first, first_hits), (others, other_hits) = met
    blocks = others.select("cell", "block").distinct().count()
    assert first.count() == 3000 and first_hits.count() <= k * 3000
    # all block pairs would be 3000 rows for each block, and k hits for each of them
    assert others.count() < 3000 * blocks / 4 and other_hits.count() < k * 3000 * blocks / 10


@pytest.mark.parametrize("rows, width", [(900, 16), (3000, 16)])
def test_recall_of_the_inverted_file(spark, tmp_path, rows, width):
    v = clustered(rows, width, seed=rows)
    items = table(spark, enumerate(v))
    model = inverted_file.fit(items, "vec_id", "embedding", subspaces=8)
    inverted_file.write_index(items, str(tmp_path), model, "vec_id", "embedding")
    asked = items.filter("vec_id % 3 = 0")
    routes = inverted_file._route(neighbours._vectors(asked, "vec_id", "embedding"), spark.sparkContext.broadcast(model), model.probes)
    assert routes.count() == asked.count() * model.probes and model.probes < len(model.centres) / 2
    want = brute(v, {i: v[i] for i in range(0, rows, 3)}, 10, True)
    for block_rows in (50, 32_768):
        found = ranked(inverted_file.search(asked, str(tmp_path), 10, query_columns=("vec_id", "embedding"), skip_self=True, block_rows=block_rows))
        hits = sum(len(set(want[i]) & set(found[i])) for i in want)
        assert hits >= 0.95 * sum(map(len, want.values())) and all(len(f) == 10 for f in found.values())


def test_inverted_file_with_all_cells_is_exact(spark, tmp_path):
    v = clustered(300, 5)
    items = table(spark, enumerate(v)).unionByName(spark.createDataFrame([(900, None)], "vec_id long, embedding array<float>"))
    inverted_file.write_index(items, str(tmp_path), inverted_file.fit(items, "vec_id", "embedding", subspaces=3), "vec_id", "embedding")
    found = inverted_file.search(items, str(tmp_path), 4, query_columns=("vec_id", "embedding"), probes=1000, rerank=1000)
    assert ranked(found) == brute(v, dict(enumerate(v)), 4, False)
    assert inverted_file.search(items.filter("false"), str(tmp_path), 4, query_columns=("vec_id", "embedding")).count() == 0
    assert not spark.read.parquet(f"{tmp_path}/codes").filter(F.col("id") == 900).count()
    with pytest.raises(ValueError, match="no vectors"):
        inverted_file.fit(items.filter("false"), "vec_id", "embedding")


def test_queries_travel_once_per_bundle_and_hits_come_back_k_at_a_time(spark, tmp_path, monkeypatch):
    v, k = np.random.default_rng(4).normal(size=(1200, 8)).astype(np.float32), 5  # no clusters: most cells are visited
    items = table(spark, enumerate(v))
    model = inverted_file.fit(items, "vec_id", "embedding", subspaces=4)
    inverted_file.write_index(items, str(tmp_path), model, "vec_id", "embedding")
    met = []
    plain = inverted_file.meet_in_blocks
    monkeypatch.setattr(inverted_file, "meet_in_blocks", lambda *a: met.append((a[0], plain(*a))) or met[-1][1])
    found = ranked(inverted_file.search(items, str(tmp_path), k, query_columns=("vec_id", "embedding"), skip_self=True, block_rows=100))
    want = brute(v, dict(enumerate(v)), k, True)
    assert sum(len(set(want[i]) & set(found[i])) for i in want) >= 0.95 * 1200 * k
    (routed, hits), = met
    assert model.probes > 8 and routed.count() <= 1200 * 5 and hits.count() <= 1200 * 5 * k
