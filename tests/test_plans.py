"""Plans: what may not appear in them."""

import pytest

from marketlens import plans

# The library's own queries; those of the training-data operators have their plan tests beside them.
QUERIES = plans.QUERIES
# Queries whose work cannot be said in built-ins.
PYTHON = {
    "html_to_text_strict", "chunk_paragraphs", "knn_l2", "knn_join", "recommend_items",
    "retrieve_context", "answer_requests", "ingest_document", "knn_ivf", "embed_hash", "embed_idf",
    "search_stored", "keyword_extract",
}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_cross_join_and_no_stray_python(spark, sf_dir, plan_of, name):
    plan = plan_of(QUERIES[name](spark, sf_dir))
    for word in ("CartesianProduct", "BroadcastNestedLoopJoin"):
        assert word not in plan
    if name not in PYTHON:
        assert "Python" not in plan and "InArrow" not in plan
    assert "SinglePartition" not in plan or name in ALLOWED_SINGLE, plan


# One-row results and scalar subqueries.
ALLOWED_SINGLE = {
    "filter_recent", "rivalry_concentration", "observation_confidence", "keyword_extract",
    "top10_entities", "trend_velocity", "threat_matrix",
}


def test_scan_reads_only_what_is_asked(spark, sf_dir, plan_of):
    plan = plan_of(QUERIES["supplier_criticality"](spark, sf_dir))
    assert "ReadSchema: struct<l_partkey:bigint,l_suppkey:bigint>" in plan


def test_small_tables_are_broadcast(spark, sf_dir, plan_of):
    assert "BroadcastHashJoin" in plan_of(QUERIES["suggest_fixes"](spark, sf_dir))
    assert "LocalTableScan" in plan_of(QUERIES["suggest_fixes"](spark, sf_dir))
