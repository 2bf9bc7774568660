"""Resampling reads texts and lists few rows at a time, so the reader's buffers stay small; no row is lost by that."""

import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from marketlens.llm import resampling
from marketlens.llm.common import BATCH_ROWS, READ_ROWS, short_batches

READER, ARROW = "spark.sql.parquet.columnarReaderBatchSize", "spark.sql.execution.arrow.maxRecordsPerBatch"
N = 3_000


@pytest.fixture(scope="module")
def texts(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("texts") / "documents.parquet")
    spark.range(N, numPartitions=1).select(F.col("id").alias("doc_id"), F.format_string("both w%d w%d", F.col("id") % 7, "id").alias("text")).write.parquet(path)
    return spark.read.parquet(path)


def test_every_written_table_is_read_in_short_batches(spark, texts, monkeypatch):
    before, seen = (spark.conf.get(READER), spark.conf.get(ARROW)), []
    write = resampling.materialise

    def noted(df, label):
        seen.append((label, int(spark.conf.get(READER))))
        return write(df, label)

    monkeypatch.setattr(resampling, "materialise", noted)
    rows = resampling.draw(resampling.weigh(texts, texts.limit(3)), least_words=0).collect()
    assert {label for label, _ in seen} == {"resampling-features", "resampling-order"}
    assert max(n for _, n in seen) <= READ_ROWS
    assert sorted(r["doc_id"] for r in rows) == list(range(N)) and {r["n_features"] for r in rows} == {3}
    assert (spark.conf.get(READER), spark.conf.get(ARROW)) == before


def test_histogram_takes_short_batches(texts, monkeypatch):
    features = resampling.bucketed(texts, "doc_id", "text", 1, 97).coalesce(1)
    assert resampling.histogram(features, 97).sum() == 3 * N

    def longest(buckets):
        def run(batches):
            yield pa.RecordBatch.from_pydict({"bucket": [0], "n": [max(b.num_rows for b in batches)]})

        return run

    monkeypatch.setattr(resampling, "_counted", longest)
    assert resampling.histogram(features, 97)[0] <= BATCH_ROWS


@pytest.mark.parametrize("buckets", [6, 256, 257, 10_000, 65_537])
def test_counts_stay_whole_numbers(buckets):
    last, most = buckets - 1, 2**31 - 1
    places, counts = np.array([last, 1, last], resampling.place_type(buckets)), np.array([most, 5, most], resampling.COUNT)
    batch = pa.RecordBatch.from_pydict({"buckets": [b"", places.tobytes()], "counts": [b"", counts.tobytes()]})
    (out,) = resampling._counted(buckets)(iter([batch, batch.slice(0, 1), batch.slice(0, 0), batch]))
    assert out.to_pydict() == {"bucket": [1, last], "n": [10, 4 * most]}


@pytest.mark.parametrize("buckets", [1, 300, 70_000])
def test_weights_at_other_numbers_of_buckets(texts, buckets):
    got = {r["doc_id"]: (r["n_features"], r["weight"]) for r in resampling.weigh(texts, texts.limit(3), buckets=buckets).collect()}
    split = {i: ["both", f"w{i % 7}", f"w{i}"] for i in range(N)}
    place = {w: zlib.crc32(w.encode()) % buckets for words in split.values() for w in words}
    source, target = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
    for i, words in split.items():
        for w in words:
            source[place[w]] += 1
            target[place[w]] += i < 3
    gain = resampling.gains(source, target)
    assert got == {i: (3, sum(int(gain[place[w]]) for w in words)) for i, words in split.items()}


def test_settings_come_back_after_a_failure(spark):
    before = spark.conf.get(READER), spark.conf.get(ARROW)
    with pytest.raises(RuntimeError), short_batches(spark):
        assert int(spark.conf.get(READER)) <= READ_ROWS
        raise RuntimeError
    assert (spark.conf.get(READER), spark.conf.get(ARROW)) == before
