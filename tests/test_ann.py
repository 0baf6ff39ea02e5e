"""The clustered index: opened again, added to, split, merged, searched for one and for many queries."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vectrail.operators import ann
from vectrail.operators import search as ops

SHAPE = "vec_id long, embedding array<float>, label int"


def vectors(n=1200, d=16, groups=12, seed=5, first=0):
    rng = np.random.default_rng(seed)
    middle = rng.standard_normal((groups, d)) * 2
    own = rng.integers(0, groups, n)
    data = (middle[own] + rng.standard_normal((n, d)) * 0.4).astype(np.float32)
    return [(first + i, v.tolist(), int(g)) for i, (v, g) in enumerate(zip(data, own))]


def exact(rows, queries, k):
    ids = np.array([r[0] for r in rows])
    matrix = np.array([r[1] for r in rows], np.float64)
    matrix /= np.linalg.norm(matrix, axis=1, keepdims=True)
    out = {}
    for q, v in queries:
        v = np.array(v, np.float64)
        distance = np.round(1 - matrix @ (v / np.linalg.norm(v)), 6)
        out[q] = [int(ids[i]) for i in np.lexsort((ids, distance))[:k]]
    return out


def answers(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append(r.vec_id)
    return out


def asked(spark, rows):
    return spark.createDataFrame([(r[0], r[1]) for r in rows], "query_id long, embedding array<float>")


def test_index_is_opened_again_and_exact_with_all_lists(spark, folder):
    rows = vectors()
    odd = [(9000, None, 1), (9001, [0.0] * 16, 1), (9002, [1.0] * 5, 1)]
    ann.build_index(spark.createDataFrame(rows + odd, SHAPE), folder, "vec_id", lists=12, train_rows=40)
    index = ann.open_index(spark, folder)
    assert sum(index.counts.values()) == len(rows) == index.rows().count()
    queries = rows[::10]
    found = answers(index.search_many(asked(spark, queries + odd), 7, "query_id", probes=12, share_rows=50, block_queries=30))
    assert found == exact(rows, [q[:2] for q in queries], 7)
    one = index.search(rows[3][1], 7, probes=12)
    assert [r.vec_id for r in one.collect()] == exact(rows, [(3, rows[3][1])], 7)[3]
    with pytest.raises(FileNotFoundError):
        ann.open_index(spark, f"{folder}/nowhere")


def test_recall_over_many_queries(spark, folder):
    rows = vectors()
    index = ann.build_index(spark.createDataFrame(rows, SHAPE), folder, "vec_id", lists=12)
    queries = rows[::10]
    assert len(queries) >= 100
    want = exact(rows, [q[:2] for q in queries], 10)
    found = answers(index.search_many(asked(spark, queries), 10, "query_id", probes=3))
    assert sum(len(set(found[q]) & set(want[q])) for q in want) / (10 * len(want)) >= 0.9


def test_rows_added_in_small_batches_leave_few_generations(spark, folder):
    rows = vectors(400)
    ann.build_index(spark.createDataFrame(rows[:200], SHAPE), folder, "vec_id", lists=6)
    for k in range(10):
        index = ann.open_index(spark, folder).add(spark.createDataFrame(rows[200 + 20 * k : 220 + 20 * k], SHAPE), k)
    again = index.add(spark.createDataFrame(rows[380:400], SHAPE), 9)  # a replayed batch
    assert again.version == index.version and sum(again.counts.values()) == 400
    live = {g for names in index.generations.values() for g in names}
    assert len(live) <= 2 * ann.FANOUT
    index.vacuum()
    index = ann.open_index(spark, folder)
    assert index.rows().select("vec_id").distinct().count() == 400 == index.rows().count()
    queries = rows[::4]
    assert answers(index.search_many(asked(spark, queries), 5, "query_id", probes=len(index.list_ids))) == exact(rows, [q[:2] for q in queries], 5)


def test_crowded_lists_are_split(spark, folder):
    rows = vectors(300, groups=6)
    index = ann.build_index(spark.createDataFrame(rows, SHAPE), folder, "vec_id", lists=6)
    crowd = [(1000 + i, (np.array(rows[0][1]) + 0.3 * np.random.default_rng(i).standard_normal(16)).tolist(), 0) for i in range(900)]
    index = index.add(spark.createDataFrame(crowd, SHAPE), "crowd")
    assert len(index.list_ids) > 6 and max(index.counts.values()) < 900
    assert sum(index.counts.values()) == 1200 == index.rows().count()
    queries = [*rows[::6], *crowd[::20]]
    assert answers(index.search_many(asked(spark, queries), 6, "query_id", probes=len(index.list_ids))) == exact(rows + crowd, [q[:2] for q in queries], 6)
    copies = spark.createDataFrame([(5000 + i, [1.0] * 16, 0) for i in range(3000)], SHAPE)
    assert sum(index.add(copies, "copies").counts.values()) == 4200  # copies of one vector stay one list


def test_search_reads_only_probed_lists_and_sends_no_vector_to_the_driver(spark, folder):
    rows = vectors(200)
    index = ann.build_index(spark.createDataFrame(rows, SHAPE), folder, "vec_id", lists=8)
    found = index.search(rows[0][1], 5, probes=2)
    assert "PartitionFilters: [list_id" in found._jdf.queryExecution().toString()
    plan = index.search_many(asked(spark, rows[:50]), 5, "query_id", probes=2)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_too_many_centres_are_refused(spark, monkeypatch):
    monkeypatch.setattr(ann, "CENTRE_BYTES", 100)
    with pytest.raises(ValueError):
        ann.with_lists(spark.createDataFrame(vectors(5), SHAPE), "embedding", np.arange(4), np.ones((4, 16)))


def test_index_answers_as_the_exact_search(spark, folder):
    source = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    index = ann.build_index(source, folder, "vec_id", lists=10)
    query = source.orderBy("vec_id").first().embedding
    want = [(r.vec_id, r.label) for r in ops.top_k(source, query, 10, "vec_id").collect()]
    assert [(r.vec_id, r.label) for r in index.search(query, 10, probes=10).collect()] == want
    assert index.rows().filter(F.col("label").isNull()).count() == source.filter("label is null").count()
