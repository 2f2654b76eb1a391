"""What the optimizer makes of queries: pruned scans, pushed filters, no products of large sides."""

import re

import pytest

from quarry import catalog
from quarry.operators import search



def plan(frame) -> str:
    return frame._jdf.queryExecution().executedPlan().toString()


def test_scans_read_what_they_need(spark, sf_dir):
    text = plan(catalog.QUERIES["k3_projected"](spark, sf_dir))
    assert re.findall(r"ReadSchema: struct<([^>]*)>", text) == ["event_id:bigint,user_id:bigint,event_type:string"]
    text = plan(catalog.QUERIES["p1_audit_query"](spark, sf_dir))
    assert "In(event_type" in text and "GreaterThanOrEqual(user_id,10)" in text and "GreaterThanOrEqual(ts" in text
    assert "TakeOrderedAndProject" in text


@pytest.mark.parametrize("name", ["f12_exact_dedup", "a4_term_frequencies", "a23_keywords", "f48_retention", "j7_step_diff", "w1_task_spans", "f37_visible_text", "f13_fixed_chunks", "a13_token_scores", "f10_simhash"])
def test_hot_paths_stay_in_the_jvm(spark, sf_dir, name):
    assert not re.search("Python|Pandas|Arrow", plan(catalog.QUERIES[name](spark, sf_dir)))


@pytest.mark.parametrize("name", ["j1_aligned_actions", "j4_lsh_pairs", "j5_simhash_pairs", "t4_tfidf", "f29_triples", "j14_contained_terms", "p10_robots", "c4_entity_resolution"])
def test_no_products(spark, sf_dir, name):
    text = plan(catalog.QUERIES[name](spark, sf_dir))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_spans_shuffle_once(spark, sf_dir):
    assert plan(catalog.QUERIES["w1_task_spans"](spark, sf_dir)).count("Exchange hashpartitioning") == 1


def test_index_of_lists_finds_most(spark, sf_dir):
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    queries = vectors.where("vec_id % 100 = 0")
    centres = search.coarse_lists(vectors, "vec_id", "embedding")
    index = search.indexed(vectors, "vec_id", "embedding", centres)
    assert index.count() == vectors.count()
    found = {(r.query_id, r.id) for r in search.nearest_in_lists(index, queries, "vec_id", "embedding", centres, probes=12).collect()}
    exact = {(r.query_id, r.id) for r in search.nearest(vectors, queries, "vec_id", "embedding").collect()}
    assert len(found & exact) >= 0.9 * len(exact)
