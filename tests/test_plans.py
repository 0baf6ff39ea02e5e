"""The physical plans that matter at scale."""

import os
import re

import pytest

import __spark_entry__ as entry
from vectrail.plans import QUERIES as PLANS

SF_DIR = "/root/testdata/sf0.001"
QUERIES = {name: plan for name, plan in entry.queries().items() if name in PLANS}


def plan_of(spark, name):
    return QUERIES[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()


NATIVE = [n for n in QUERIES if n not in ("embed_by_model", "embed_model", "embed_model_errors", "embed_model_counts", "topk_cosine_batch", "topk_cosine_batch_ragged", "topk_ivf", "topk_ivf_added")]


@pytest.mark.parametrize("name", sorted(n for n in NATIVE if not n.startswith(("stream", "scan"))))
def test_no_cross_joins_or_python(spark, name):
    plan = plan_of(spark, name)
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert "Python" not in plan and "InPandas" not in plan and "InArrow" not in plan


@pytest.mark.parametrize("name", ["corpus_sample", "corpus_chunk_cap"])
def test_limits_sort_no_texts(spark, name):
    """Documents wanted are cut out by key where they are."""
    plan = plan_of(spark, name)
    assert "rangepartitioning" not in plan and "SinglePartition" not in plan and "TakeOrdered" not in plan


@pytest.mark.parametrize(
    "name", ["topk_cosine", "search_text", "read_latest", "paginate_messages", "unprocessed_batch", "search_corpus"]
)
def test_limits_are_per_task_top_k(spark, name):
    assert "TakeOrderedAndProject" in plan_of(spark, name)


def test_scans_read_only_what_they_need(spark):
    assert re.search(r"ReadSchema: struct<doc_id:bigint,text:string>", plan_of(spark, "chunk_words"))
    assert re.search(r"ReadSchema: struct<>", plan_of(spark, "count_rows"))


def test_one_aggregation_replaces_the_stage_joins(spark):
    plan = plan_of(spark, "stage_latency")
    assert "Join" not in plan and plan.count("Exchange") == 1


def test_no_forbidden_calls():
    root = os.path.join(os.path.dirname(entry.__file__), "vectrail")
    for folder, _, names in os.walk(root):
        for name in names:
            if name.endswith(".py"):
                source = open(os.path.join(folder, name)).read()
                assert "localCheckpoint" not in source and "crossJoin" not in source, name
