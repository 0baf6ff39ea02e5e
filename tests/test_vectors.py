import numpy as np
import pytest
from pyspark.sql import functions as F

from vectrail.functions import embed as e
from vectrail.functions import vector as v
from vectrail.operators import search as ops


def vectors(spark, rows):
    return spark.createDataFrame(rows, "id long, embedding array<float>")


def test_literal_round_trip(spark):
    df = vectors(spark, [(1, [0.5, -1.25, 3.0])])
    coded = df.select(v.encode_literal(F.col("embedding")).alias("t"))
    assert coded.first().t == "[0.5,-1.25,3.0]"
    assert coded.select(v.decode_literal(F.col("t"))).first()[0] == [0.5, -1.25, 3.0]


def test_fit_dimension(spark):
    df = vectors(spark, [(1, [1.0, 2.0, 3.0]), (2, None), (3, [])])
    fitted = {r.id: r.x for r in df.select("id", v.fit_dimension(F.col("embedding"), 2).alias("x")).collect()}
    assert fitted == {1: [1.0, 2.0], 2: [0.0, 0.0], 3: [0.0, 0.0]}
    assert df.select(v.fit_dimension(F.col("embedding"), 5)).first()[0] == [1.0, 2.0, 3.0, 0.0, 0.0]


def test_zero_vector_normalises_to_itself_and_has_no_distance(spark):
    df = vectors(spark, [(1, [0.0, 0.0]), (2, [3.0, 4.0])])
    unit = [r[0] for r in df.orderBy("id").select(v.l2_normalize(F.col("embedding"))).collect()]
    assert unit[0] == [0.0, 0.0] and unit[1] == pytest.approx([0.6, 0.8])
    found = ops.top_k(df, [1.0, 0.0], 5, "id").collect()
    assert [(r.id, r.distance) for r in found] == [(2, pytest.approx(0.4)), (1, None)]


def test_stand_in_is_reproducible_and_of_unit_length(spark):
    texts = ["Machine learning", "", "naïve 😀", "Machine learning"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = np.array([r[0] for r in df.orderBy("i").select(e.embed_hash(F.col("t"), 48)).collect()])
    assert np.allclose(np.linalg.norm(got, axis=1), 1, atol=1e-6)
    assert (got[0] == got[3]).all() and not np.allclose(got[0], got[1])
    assert np.allclose(got, e.hash_encoder(48)(texts), atol=1e-6)


def test_stand_in_components_are_uniform_before_scaling(spark):
    df = spark.range(300).select(e.embed_hash(F.col("id").cast("string"), 64).alias("x"))
    values = np.array([r.x for r in df.collect()])
    assert abs(values.mean()) < 0.01
    assert abs(np.corrcoef(values[:, 0], values[:, 1])[0, 1]) < 0.2


def test_model_udf(spark):
    df = spark.createDataFrame([("a",), ("bb",)], "t string")
    length = e.model_udf(lambda: lambda texts: np.array([[len(t), 1.0] for t in texts]))
    assert sorted(r[0].embedding for r in df.select(length("t")).collect()) == [[1.0, 1.0], [2.0, 1.0]]


def test_model_by_name_with_failures(spark):
    """A row that fails costs only itself; an unknown model only its rows."""

    def load(name):
        if name == "missing":
            raise KeyError(name)

        def encode(texts):
            if any(t == "bad" for t in texts):
                raise ValueError("cannot encode")
            return np.array([[float(len(t)), 0.0] for t in texts])

        return encode

    rows = [(1, "one", "a"), (2, "bad", "a"), (3, "three", None), (4, "four", "missing"), (5, "x", "")]
    df = spark.createDataFrame(rows, "id int, text string, model string").coalesce(1)
    out = {r.id: r for r in e.embed_by_model(df, load, "default").collect()}
    assert out[1].embedding == [3.0, 0.0] and out[1].model_name == "a"
    assert out[2].embedding is None and "cannot encode" in out[2].embed_error
    assert out[3].model_name == "default" and out[5].model_name == "default"
    assert out[4].embedding is None and out[4].embed_error


def test_remote_encoder(spark):
    """A stand-in service: one status for each kind of answer."""

    def load(name):
        def post(body):
            if body["text"] == "down":
                return 500, {}
            if body["text"] == "odd":
                return 200, {"embedding": "none"}
            return 200, {"embedding": [1, 2]}

        return e.remote_encoder(post, wait=0)

    df = spark.createDataFrame([("fine",), ("down",), ("odd",)], "text string")
    out = {r.text: r for r in e.embed_by_model(df, load, "remote").collect()}
    assert out["fine"].embedding == [1.0, 2.0]
    assert "500" in out["down"].embed_error and out["odd"].embedding is None


def test_remote_requests_keep_order_and_a_bound():
    """Answers come in the order asked though later requests end first; never more than three are open."""
    import threading
    import time

    lock, state = threading.Lock(), {"open": 0, "most": 0}

    def post(body):
        with lock:
            state["open"] += 1
            state["most"] = max(state["most"], state["open"])
        time.sleep(0.03 if int(body["text"]) % 3 == 0 else 0.005)
        with lock:
            state["open"] -= 1
        return 200, {"embedding": [int(body["text"])]}

    got = e.remote_encoder(post, at_once=3)([str(i) for i in range(30)])
    assert [int(v[0]) for v in got] == list(range(30)) and 1 < state["most"] <= 3


def test_remote_requests_are_sent_again_only_where_it_helps(monkeypatch):
    sent, waits = {}, []
    monkeypatch.setattr(e.time, "sleep", waits.append)

    def post(body):
        text = body["text"]
        sent[text] = sent.get(text, 0) + 1
        if text == "busy" and sent[text] < 3:
            return 429, {}
        if text == "cut" and sent[text] < 2:
            raise ConnectionError("reset")
        if text == "down":
            return 503, {}
        if text == "wrong":
            return 400, {}
        return 200, {"embedding": [1.0]}

    encode = e.remote_encoder(post, at_once=1, retries=3, wait=0.5)
    vectors, errors = e._encode_rows(encode, ["busy", "cut", "down", "wrong", "fine"])
    assert sent == {"busy": 3, "cut": 2, "down": 4, "wrong": 1, "fine": 1}
    assert [v is None for v in vectors] == [False, False, True, True, False]
    assert "503" in errors[2] and "400" in errors[3] and errors[4] is None
    assert waits == [0.5, 1.0, 0.5, 0.5, 1.0, 2.0]


def brute(queries, corpus, k):
    out = {}
    for qid, q in queries:
        scored = []
        for id, x in corpus:
            scale = np.linalg.norm(q) * np.linalg.norm(x)
            scored.append((round(1 - np.dot(q, x) / scale, 6) if scale else np.inf, id))
        out[qid] = [id for _, id in sorted(scored)[:k]]
    return out


@pytest.mark.parametrize("block_bytes", [1 << 20, 8 * 8 * 5])
def test_many_queries_against_brute_force(spark, block_bytes):
    """One block, and several: the answers are the same."""
    rng = np.random.default_rng(3)
    corpus = [(i, [float(x) for x in np.float32(rng.normal(size=8))]) for i in range(200)]
    corpus[10] = (10, [0.0] * 8)
    corpus[11] = (11, corpus[12][1])  # a tie
    queries = [(100 + i, corpus[i][1]) for i in range(0, 24, 2) if i != 10]
    got = ops.top_k_many(
        vectors(spark, queries).withColumnRenamed("id", "query_id"),
        vectors(spark, corpus).repartition(4),
        7, "query_id", "id", block_bytes=block_bytes,
    ).collect()
    ranked = {}
    for r in sorted(got, key=lambda r: (r.query_id, r["rank"])):
        ranked.setdefault(r.query_id, []).append(r.id)
    assert ranked == brute(queries, corpus, 7)


def test_many_queries_with_string_ids_and_ragged_rows(spark):
    rows = [("a", [1.0, 0.0]), ("b", [0.0, 1.0]), ("c", [1.0]), ("d", None)]
    corpus = spark.createDataFrame(rows, "id string, embedding array<float>")
    queries = spark.createDataFrame([("q", [1.0, 0.1])], "query_id string, embedding array<float>")
    got = ops.top_k_many(queries, corpus, 5, "query_id", "id").orderBy("rank").collect()
    assert [r.id for r in got] == ["a", "b"]


def test_ragged_and_missing_queries(spark):
    corpus = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0]), ("c", [1.0]), ("d", None), ("e", [0.0, 0.0])], "id string, embedding array<float>")
    asked = [(1, [1.0, 0.0]), (2, [1.0]), (3, [0.0, 1.0, 1.0]), (4, None), (5, [])]
    queries = spark.createDataFrame(asked, "query_id long, embedding array<float>")
    for block_bytes in (1 << 20, 8):
        got = ops.top_k_many(queries, corpus, 5, "query_id", "id", block_bytes=block_bytes).collect()
        assert sorted((r.query_id, r["rank"], r.id) for r in got) == [(1, 1, "a"), (1, 2, "b"), (1, 3, "e"), (2, 1, "c")]
    assert [r.id for r in ops.top_k(corpus, [1.0, 0.0], 5, "id").collect()] == ["a", "b", "e"]


def test_many_queries_are_one_join_of_shares_and_blocks(spark, folder):
    """Queries and rows are evaluated once each, nothing is broadcast but the list of lengths, and
    each task keeps k rows per query before the last shuffle."""
    seen = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def counted(x):
        seen.add(1)
        return x

    rng = np.random.default_rng(5)
    corpus = vectors(spark, [(i, [float(x) for x in rng.normal(size=4)]) for i in range(300)])
    queries = corpus.filter("id % 10 = 0").select(counted("id").alias("query_id"), "embedding")
    got = ops.top_k_many(queries, corpus, 3, "query_id", "id", block_bytes=8 * 4 * 7)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2 and "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert {(r.query_id, r.id) for r in got.collect() if r["rank"] == 1} == {(i, i) for i in range(0, 300, 10)}
    assert got.count() == 90 and seen.value == 30


def test_many_queries_without_rows_or_queries(spark):
    some = vectors(spark, [(1, [1.0, 0.0])])
    named = some.withColumnRenamed("id", "query_id")
    assert ops.top_k_many(named.limit(0), some, 3, "query_id", "id").count() == 0
    assert ops.top_k_many(named, some.limit(0), 3, "query_id", "id").count() == 0


def test_rows_with_undefined_entries_come_last(spark):
    rows = vectors(spark, [(1, [float("nan"), 1.0]), (2, [0.0, 1.0]), (3, [1.0, 0.0]), (None, [1.0, 0.0])])
    asked = vectors(spark, [(7, [1.0, 0.0])]).withColumnRenamed("id", "query_id")
    got = ops.top_k_many(asked, rows, 9, "query_id", "id").orderBy("rank").collect()
    assert [(r.id, r.distance) for r in got] == [(None, 0.0), (3, 0.0), (2, 1.0), (1, None)]


def test_a_failing_text_spares_its_batch(spark):
    def encoder():
        def encode(texts):
            if "bad" in texts:
                raise ValueError("bad text")
            return np.array([[len(t), 1.0] for t in texts])

        return encode

    rows = spark.createDataFrame([("a",), ("bad",), (None,), ("abc",)], "t string").coalesce(1)
    got = rows.select(e.model_udf(encoder)(F.col("t")).alias("v")).collect()
    assert [r.v.embedding for r in got] == [[1.0, 1.0], None, None, [3.0, 1.0]]
    assert [r.v.error for r in got] == [None, "bad text", None, None]
    counts = e.embed_counts(e.with_model(rows, encoder, "t"), text="t").first()
    assert (counts.embedded, counts.failed, counts.without_text) == (2, 1, 1)


def test_a_model_that_cannot_be_loaded_is_an_error_of_every_text(spark):
    def encoder():
        raise OSError("no such model")

    rows = spark.createDataFrame([(1, "a"), (2, None)], "id int, text string")
    got = {r.id: r for r in e.with_model(rows, encoder).collect()}
    assert got[1].embed_error == "no such model" and got[2].embed_error is None
    assert e.with_model(rows.limit(0), encoder).collect() == []


def test_a_model_is_loaded_once_per_worker_process(spark, folder):
    """Sixteen tasks and two jobs over few processes: no more loads than processes."""
    import os
    import uuid

    def encoder():
        open(f"{folder}/{uuid.uuid4().hex}-{os.getpid()}", "w").close()
        return lambda texts: np.array([[float(os.getpid())] for _ in texts])

    rows = spark.range(400).repartition(16).select(F.col("id").cast("string").alias("text"))
    embedded = e.with_model(rows, encoder)
    for _ in range(2):
        assert embedded.filter("embed_error is null").count() == 400
    loads = [name.split("-")[1] for name in os.listdir(folder)]
    assert len(loads) == len(set(loads))


def test_models_are_held_up_to_a_bound():
    e._held_models().clear()
    loads = []

    def load(name):
        loads.append(name)
        return lambda texts: np.zeros((len(texts), 1))

    for name in ["a", "a", "b", "a"]:
        e._held_model("x", name, load)
    assert loads == ["a", "b"]
    for name in ["c", "d", "f"]:  # "b" was used longest ago and goes
        e._held_model("x", name, load)
    assert len(e._held_models()) == e.MODELS_HELD and ("x", "b") not in e._held_models()
    e._held_model("y", "a", load)  # another loader's model of the same name
    assert loads == ["a", "b", "c", "d", "f", "a"]
