"""The vector store: appends that repeat, fail half-way or replace, and reads pinned to the manifest."""

import pytest
from pyspark.sql import functions as F

from marketlens.operators.neighbours import nearest
from marketlens.operators.retrieval import embed_hash
from marketlens.sources import vector_store

SCHEMA = "doc_id long, chunk_ix int, chunk_text string, v int"


def rows(spark, *values):
    return spark.createDataFrame(list(values), SCHEMA)


def held(spark, path, name="a"):
    return sorted(tuple(r) for r in vector_store.load(spark, path, name).select("doc_id", "chunk_ix", "v").collect())


def test_a_repeated_append_leaves_one_copy(spark, tmp_path):
    path = str(tmp_path)
    some = rows(spark, (1, 0, "x", 1), (2, 0, "y", 1), (2, 0, "y", 1))
    for _ in range(3):
        vector_store.append(some.repartition(3), path, "a")
    assert held(spark, path) == [(1, 0, 1), (2, 0, 1), (2, 0, 1)]
    assert len(list((tmp_path / "chunks").iterdir())) == 1
    vector_store.append(rows(spark, (1, 0, "x", 1)), path, "a")
    vector_store.append(some, path, "b")
    assert len(held(spark, path)) == 4 and len(held(spark, path, "b")) == 3


def test_a_half_failed_append_is_not_seen(spark, tmp_path):
    path = str(tmp_path)
    vector_store.append(rows(spark, (1, 0, "x", 1)), path, "a")

    def broken():
        return rows(spark, (2, 0, "y", 1), (3, 0, "z", 1)).repartition(2).withColumn(
            "v", F.when(F.col("doc_id") == 3, F.raise_error(F.lit("lost"))).otherwise(F.col("v")).cast("int")
        )

    with pytest.raises(Exception, match="lost"):
        vector_store.append(broken(), path, "a")
    # Rows that were written but never committed.
    stray = rows(spark, (9, 0, "s", 1)).withColumn("chunk_hash", F.lit("")).withColumn("index_name", F.lit("a"))
    stray.write.partitionBy("index_name").parquet(f"{path}/chunks/append=000000002-lost")
    assert held(spark, path) == [(1, 0, 1)]
    vector_store.append(rows(spark, (2, 0, "y", 1), (3, 0, "z", 1)), path, "a")
    assert held(spark, path) == [(1, 0, 1), (2, 0, 1), (3, 0, 1)]


def test_documents_are_replaced(spark, tmp_path):
    path = str(tmp_path)
    vector_store.append(rows(spark, (1, 0, "x", 1), (1, 1, "y", 1), (2, 0, "z", 1), (None, 0, "n", 1)), path, "a")
    vector_store.append(rows(spark, (1, 0, "x", 1)), path, "b")
    vector_store.append(rows(spark, (1, 0, "w", 2), (3, 0, "u", 2)), path, "a", replace=True)
    got = {tuple(r) for r in vector_store.load(spark, path, "a").select("doc_id", "chunk_ix", "v").collect()}
    assert got == {(1, 0, 2), (2, 0, 1), (3, 0, 2), (None, 0, 1)}
    vector_store.append(rows(spark, (1, 5, "x", 3)), path, "a")
    vector_store.append(rows(spark, (3, 0, "t", 4), (None, 0, "m", 4)), path, "a", replace=True)
    got = {tuple(r) for r in vector_store.load(spark, path, "a").select("doc_id", "chunk_ix", "v").collect()}
    assert got == {(1, 0, 2), (1, 5, 3), (2, 0, 1), (3, 0, 4), (None, 0, 4)}
    assert held(spark, path, "b") == [(1, 0, 1)]


def test_earlier_content_may_come_back(spark, tmp_path):
    path = str(tmp_path)
    first, second = rows(spark, (1, 0, "x", 1)), rows(spark, (1, 0, "y", 2))
    for some in (first, second, first, first):
        vector_store.append(some, path, "a", replace=True)
    assert held(spark, path) == [(1, 0, 1)]
    assert vector_store.manifest(spark, path).count() == 3


def test_a_read_is_pinned_and_names_are_text(spark, tmp_path):
    path = str(tmp_path)
    vector_store.append(rows(spark, (1, 0, "x", 1)), path, "1")
    vector_store.append(rows(spark, (2, 0, "x", 1)), path, "01")
    before = vector_store.load(spark, path, "1")
    vector_store.append(rows(spark, (3, 0, "y", 1)), path, "1")
    assert before.count() == 1 and len(held(spark, path, "1")) == 2
    assert held(spark, path, "01") == [(2, 0, 1)]
    vector_store.append(rows(spark, (4, 0, "y", 1)).limit(0), path, "none")
    with pytest.raises(vector_store.MissingIndex):
        vector_store.load(spark, path, "none")


def test_chunks_of_one_hash_stay_two(spark, tmp_path):
    path = str(tmp_path)
    docs = spark.createDataFrame([(1, "pay by card"), (2, "open bank"), (3, "blue car")], "doc_id long, text string")
    chunks = vector_store.embed_chunks(docs, "doc_id", "text").withColumn("chunk_id", F.lit(7).cast("long"))
    vector_store.append(chunks, path, "a")
    vector_store.append(chunks.filter("doc_id = 3").withColumn("chunk_text", F.lit("red car")), path, "a", replace=True)
    index = vector_store.load(spark, path, "a")
    assert {(r["doc_id"], r["chunk_text"]) for r in index.collect()} == {(1, "pay by card"), (2, "open bank"), (3, "red car")}
    asked = embed_hash(spark.createDataFrame([(9, "bank open")], "query_id long, chunk_text string"), "chunk_text")
    hits = nearest(asked, index, k=3, query_columns=("query_id", "embedding"), corpus_columns=("chunk_id", "embedding"))
    assert [r["item_id"] for r in hits.collect()] == [7, 7, 7]


def test_append_query_embeds_once(spark, sf_dir, plan_of, monkeypatch):
    from marketlens import plans
    from marketlens.sources import vector_store

    given, plain = [], vector_store.append
    monkeypatch.setattr(vector_store, "append", lambda chunks, *a, **b: given.append(plan_of(chunks)) or plain(chunks, *a, **b))
    plans.QUERIES["vector_table_append"](spark, sf_dir)
    assert len(given) == 3 and not any("InArrow" in p or "Python" in p for p in given)
