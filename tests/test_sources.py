"""Real JSON files in, tables out, and the stream over them."""

import json

import pytest

from marketlens.operators.leads import LEAD_SCHEMA
from marketlens.sources import files, vector_store
from marketlens.sources.scratch import scratch_path, shared_folder
from marketlens.streaming.raw_drop import stream_raw_drop

FILES = {
    "array.json": json.dumps([{"full_name": "Ann", "email": "a@b.co"}, {"full_name": "Bo", "email": "A@B.co"}]),
    "lone.json": json.dumps({"full_name": "Cy", "address": "not a struct", "extra": 1}),
    "cut.json": '[{"full_name": "cut',
    "tail.json": '{"full_name": "x"} {"full_name": "y"}',
    "mixed.json": '[1, {"full_name": "x"}]',
    "empty.json": "[]",
    "other.txt": json.dumps([{"full_name": "no"}]),
}
BAD = {"cut.json", "tail.json", "mixed.json"}


@pytest.fixture()
def drop(tmp_path):
    folder = tmp_path / "raw"
    folder.mkdir()
    for name, body in FILES.items():
        (folder / name).write_text(body)
    return str(folder)


def test_raw_drop(spark, drop):
    rows, bad = files.read_raw_drop(spark, drop, LEAD_SCHEMA)
    got = sorted((r["source_file"], r["ordinal"], r["full_name"]) for r in rows.collect())
    assert got == [("array.json", 0, "Ann"), ("array.json", 1, "Bo"), ("lone.json", 0, "Cy")]
    assert {r["source_file"] for r in bad.collect()} == BAD


def test_json_documents(spark, tmp_path):
    (tmp_path / "force_crawl.json").write_text(json.dumps([{"raw_content": "one", "url": "u"}, {"raw_content": "two"}]))
    docs = files.read_json_documents(spark, str(tmp_path)).orderBy("ordinal").collect()
    assert [r["text"] for r in docs] == ["one", "two"]


def test_stream_equals_batch_and_takes_only_new_files(spark, drop, tmp_path):
    clean, bad, state = (str(tmp_path / d) for d in ("clean", "bad", "state"))

    def run():
        stream_raw_drop(spark, drop, clean, bad, state, max_files=2).awaitTermination()
        return sorted((r["source_file"], r["full_name"]) for r in spark.read.parquet(clean).collect())

    assert run() == [("array.json", "Ann"), ("lone.json", "Cy")]
    assert {r["source_file"] for r in spark.read.parquet(bad).collect()} == BAD
    (tmp_path / "raw" / "late.json").write_text('{"full_name": "Di"}')
    assert run() == [("array.json", "Ann"), ("late.json", "Di"), ("lone.json", "Cy")]


def test_a_batch_is_read_once_and_a_repeated_one_replaces_both_outputs(spark, drop, tmp_path):
    clean, bad = str(tmp_path / "clean"), str(tmp_path / "bad")
    for state in ("first", "second"):  # a new state starts from batch 0 again
        stream = stream_raw_drop(spark, drop, clean, bad, str(tmp_path / state))
        stream.awaitTermination()
        assert sum(p["numInputRows"] for p in stream.recentProgress) == len(FILES) - 1
        assert spark.read.parquet(clean).count() == 2 and spark.read.parquet(bad).count() == len(BAD)
    assert spark.sparkContext._jsc.getPersistentRDDs().isEmpty()


def test_new_crawl_replaces_only_its_force(spark, tmp_path):
    path = str(tmp_path / "crawl")
    schema = "porter_force string, url string"
    files.write_crawl(spark.createDataFrame([("A", "a1"), ("B", "b1")], schema), path, "parquet")
    files.write_crawl(spark.createDataFrame([("A", "a2")], schema), path, "parquet")
    assert sorted(tuple(r) for r in spark.read.parquet(path).select("porter_force", "url").collect()) == [("A", "a2"), ("B", "b1")]


def test_vector_table(spark, tmp_path, plan_of):
    path = str(tmp_path / "vectors")
    with pytest.raises(vector_store.MissingIndex):
        vector_store.load(spark, path, "x")
    docs = spark.createDataFrame([(1, "pay by card"), (2, "open bank"), (3, "open bank")], "doc_id long, text string")
    vector_store.ingest(docs, "doc_id", "text", path, "x")
    vector_store.ingest(docs, "doc_id", "text", path, "x")
    assert vector_store.load(spark, path, "x").count() == 3
    chunks = vector_store.embed_chunks(docs, "doc_id", "text")
    vector_store.append(chunks, path, "x", again=True)
    assert vector_store.load(spark, path, "x").count() == 6
    vector_store.append(chunks, path, "y", skip_known=True)
    vector_store.append(chunks, path, "y", skip_known=True)
    y = vector_store.load(spark, path, "y")
    assert sorted(r["doc_id"] for r in y.collect()) == [1, 2]
    assert "PartitionFilters: [isnotnull(index_name" in plan_of(y)
    with pytest.raises(vector_store.MissingIndex):
        vector_store.load(spark, path, "z")


class _Unset:
    """A session whose cluster names no folder."""

    def __init__(self, spark):
        self.sparkContext = spark.sparkContext
        self.conf = self

    def get(self, key, default):
        return default


def test_scratch_follows_the_session(spark):
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        assert shared_folder(spark) == named.rstrip("/")
    assert shared_folder(_Unset(spark)) == spark.sparkContext.getCheckpointDir()
    assert scratch_path(spark, "a").startswith(f"{shared_folder(spark)}/a-")
    assert scratch_path(spark, "a") != scratch_path(spark, "a")
