import glob

import pytest
from pyspark.sql import functions as F

from vectrail.functions.embed import embed_hash
from vectrail.operators.tables import KeyedTable, routed_table
from vectrail.schemas import EMBEDDINGS, LOG, STREAM_EMBEDDINGS, TEXT_EMBEDDINGS, TEXT_MESSAGES
from vectrail.sources import log
from vectrail.streaming import jobs

def now():
    return F.timestamp_seconds(F.lit(1_700_000_000))
EMBED = jobs.embed_with(lambda text: embed_hash(text, 8), "stand-in")


def produce(spark, path, *messages):
    """Messages (key, value) into the log, one file per call, offsets going on."""
    start = len(spark.read.schema("value string").json(path).collect()) if produce.started.get(path) else 0
    produce.started[path] = True
    rows = [(k, v, start + i) for i, (k, v) in enumerate(messages)]
    df = spark.createDataFrame(rows, "key string, value string, n long").coalesce(1)
    log.write_files(
        log.to_log(df, F.col("key"), F.col("value"), "text-messages", F.col("n"), now(), F.lit(0)), path
    )


produce.started = {}


def text(id, body):
    return id, f'{{"id": "{id}", "text": "{body}", "timestamp": 10.5, "source": "s"}}'


def once(spark, folder, body, name, files_per_batch=None):
    source = log.stream(spark, f"{folder}/log", topic="text-messages", max_per_trigger=files_per_batch)
    jobs.drain(jobs.run(source, name, f"{folder}/checkpoint-{name}", body, once=True))


def pairs(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_text_writer_restarts_and_ignores_repeats(spark, folder):
    table = KeyedTable(spark, f"{folder}/table", TEXT_MESSAGES, key=["id"], rule="first")
    dead = jobs.DeadLetters(f"{folder}/dead")
    body = jobs.text_writer_batch(table, now(), dead)
    produce(spark, f"{folder}/log", text("a", "one"), text("a", "two"), ("x", "{bad"), ("x", '{"text": "t"}'))
    once(spark, folder, body, "writer")
    produce(spark, f"{folder}/log", text("a", "three"), text("b", "new"))
    once(spark, folder, body, "writer")
    assert pairs(table.read(), "id", "content", "source") == [("a", "one", "kafka"), ("b", "new", "kafka")]
    assert pairs(spark.read.parquet(dead.path), "reject_reason") == [("malformed_json",), ("missing_id",)]


def test_last_message_wins_in_one_batch_or_many(spark, folder):
    for n in range(3):
        produce(spark, f"{folder}/log", text("a", f"a{n}"), text(f"k{n}", "x"), text("blank", "  "))
    results = []
    for name, files in (("one", None), ("many", 1)):
        table = KeyedTable(spark, f"{folder}/{name}", STREAM_EMBEDDINGS, key=["id"])
        once(spark, folder, jobs.embed_store_batch(table, EMBED, now(), None), name, files)
        results.append(pairs(table.read(), "id", "text", "embedding", "created_at"))
    assert results[0] == results[1]
    assert [(r[0], r[1]) for r in results[0]] == [("a", "a2"), ("k0", "x"), ("k1", "x"), ("k2", "x")]


def test_embed_then_write(spark, folder):
    """Both stages from log to table; a failing model costs one message."""

    def load(name):
        def encode(texts):
            if "boom" in texts:
                raise RuntimeError("no vector")
            return [[float(len(t)), 1.0] for t in texts]

        return encode

    dead = jobs.DeadLetters(f"{folder}/dead")
    produce(spark, f"{folder}/log", text("a", "one"), text("b", "boom"), ("c", '"bare"'), ("d", "{"))
    body = jobs.embed_batch(jobs.embed_by_name(load, "m"), jobs.file_sink(f"{folder}/out"), now(), dead)
    once(spark, folder, body, "embed")
    assert pairs(spark.read.parquet(dead.path), "reject_reason") == [("embedding_failed",), ("malformed_json",)]

    table = routed_table(spark, f"{folder}/tables", EMBEDDINGS)
    writer = jobs.writer_batch(table, now(), 2, None)
    source = log.stream(spark, f"{folder}/out/batch=*", topic="embeddings")
    jobs.drain(jobs.run(source, "write", f"{folder}/checkpoint-write", writer, once=True))
    assert pairs(table.read(), "table_name", "id", "text", "embedding", "source") == [
        ("embeddings", "a", "one", [3.0, 1.0], "m"),
        ("embeddings", "c", "bare", [4.0, 1.0], "m"),
    ]


def messages(spark, *items):
    return spark.createDataFrame(list(items), "id string, content string, s long").select(
        "id", "content", F.lit("s").alias("source"),
        F.timestamp_seconds("s").alias("created_at"), F.timestamp_seconds("s").alias("processed_at"),
    ).coalesce(1)


def incremental(spark, folder, name, files):
    table = KeyedTable(spark, f"{folder}/{name}", TEXT_EMBEDDINGS, key=["text_message_id"], rule="first")
    source = spark.readStream.schema(TEXT_MESSAGES).option("maxFilesPerTrigger", files).parquet(f"{folder}/messages")
    body = jobs.incremental_embed_batch(table, EMBED, now(), jobs.DeadLetters(f"{folder}/dead"))
    jobs.drain(jobs.run(source, name, f"{folder}/checkpoint-{name}", body, once=True))
    return table


def test_incremental_embedding_in_any_number_of_batches(spark, folder):
    """Late and equal creation times are embedded, too."""
    for n, rows in enumerate([[("a", "x", 50), ("b", "y", 50)], [("c", "z", 50), ("d", "w", 10)], [("a", "again", 60)]]):
        messages(spark, *rows).write.mode("append").parquet(f"{folder}/messages")
    results = [
        pairs(incremental(spark, folder, name, files).read(), "text_message_id", "embedding")
        for name, files in (("all", 10), ("single", 1))
    ]
    assert results[0] == results[1] and [r[0] for r in results[0]] == ["a", "b", "c", "d"]

    messages(spark, ("e", "late", 1)).write.mode("append").parquet(f"{folder}/messages")
    grown = incremental(spark, folder, "all", 10)
    assert [r[0] for r in pairs(grown.read(), "text_message_id")] == ["a", "b", "c", "d", "e"]


def test_a_batch_does_not_shuffle_the_table(spark, folder):
    table = KeyedTable(spark, f"{folder}/t", TEXT_EMBEDDINGS, key=["text_message_id"], rule="first")
    done = spark.range(1000).select(F.col("id").cast("string").alias("text_message_id"), F.lit("").alias("text_content"), F.lit(None).cast("array<float>").alias("embedding"), now().alias("created_at"))
    table.replace(done)
    arrived = messages(spark, ("5", "x", 1), ("2000", "y", 2)).persist()
    pending = jobs.unprocessed_in(arrived, table.read())
    assert [r.id for r in pending.collect()] == ["2000"]
    assert "Exchange hashpartitioning" not in pending._jdf.queryExecution().executedPlan().toString()


def test_pending_round_by_hand(spark, folder):
    table = KeyedTable(spark, f"{folder}/t", TEXT_EMBEDDINGS, key=["text_message_id"], rule="first")
    dead = jobs.DeadLetters(f"{folder}/dead")
    rows = messages(spark, *[(f"m{i:02}", "x", i) for i in range(7)])
    assert jobs.process_pending(rows, table, EMBED, now(), dead, batch_size=4) == 4
    assert [r[0] for r in pairs(table.read(), "text_message_id")] == ["m00", "m01", "m02", "m03"]
    assert jobs.process_pending(rows, table, EMBED, now(), dead, batch_size=4) == 3
    assert jobs.process_pending(rows, table, EMBED, now(), dead, batch_size=4) == 0


def test_failing_messages_are_set_aside_and_retried(spark, folder):
    """Nothing is lost and nothing blocks: stored + set aside = all messages."""

    def moody(rows):
        bad = F.col("text") == "bad"
        return EMBED(rows).withColumn("embed_error", F.when(bad, "no"))

    table = KeyedTable(spark, f"{folder}/t", TEXT_EMBEDDINGS, key=["text_message_id"], rule="first")
    dead = jobs.DeadLetters(f"{folder}/dead")
    rows = messages(spark, ("a", "bad", 1), ("b", "fine", 2), ("c", "bad", 3), ("d", "fine", 4))
    taken = [jobs.process_pending(rows, table, moody, now(), dead, 1) for _ in range(5)]
    assert taken == [1, 1, 1, 1, 0]
    assert [r[0] for r in pairs(table.read(), "text_message_id")] == ["b", "d"]
    assert sorted(r.key for r in dead.read(spark).collect()) == ["a", "c"]
    assert jobs.retry_failed(rows, table, EMBED, now(), dead) == 2
    assert [r[0] for r in pairs(table.read(), "text_message_id")] == ["a", "b", "c", "d"]

    rows.write.parquet(f"{folder}/m")
    other = KeyedTable(spark, f"{folder}/u", TEXT_EMBEDDINGS, key=["text_message_id"], rule="first")
    aside = jobs.DeadLetters(f"{folder}/aside")
    jobs.incremental_embed_batch(other, moody, now(), aside)(spark.read.parquet(f"{folder}/m"), "one")
    assert [r[0] for r in pairs(other.read(), "text_message_id")] == ["b", "d"]
    assert sorted(r.key for r in aside.read(spark).collect()) == ["a", "c"]


def test_failed_batch_is_replayed_under_its_id(spark, folder):
    table = KeyedTable(spark, f"{folder}/table", TEXT_MESSAGES, key=["id"], rule="first")
    real, seen = jobs.text_writer_batch(table, now(), None), []

    def flaky(batch, name):
        real(batch, name)
        seen.append(name)
        if len(seen) == 1:
            raise RuntimeError("lost after the write")

    produce(spark, f"{folder}/log", text("a", "one"), text("b", "two"))
    with pytest.raises(Exception, match="lost after the write"):
        once(spark, folder, flaky, "flaky")
    once(spark, folder, flaky, "flaky")
    assert len(seen) == 2 and seen[0] == seen[1]
    assert pairs(table.read(), "id", "content") == [("a", "one"), ("b", "two")]


def test_stream_started_afresh_adds_to_the_table(spark, folder):
    """A new checkpoint counts from zero again; nothing already stored may get lost."""
    dead = jobs.DeadLetters(f"{folder}/dead")
    table = KeyedTable(spark, f"{folder}/table", TEXT_MESSAGES, key=["id"], rule="first")
    body = jobs.text_writer_batch(table, now(), dead)
    produce(spark, f"{folder}/log", text("a", "one"), ("x", "{bad"))
    once(spark, folder, body, "first")
    table.compact()
    produce(spark, f"{folder}/log", text("b", "two"))
    once(spark, folder, body, "second")
    assert pairs(table.read(), "id", "content") == [("a", "one"), ("b", "two")]
    assert spark.read.parquet(dead.path).count() == 2
    table.truncate()
    once(spark, folder, body, "third")
    assert pairs(table.read(), "id", "content") == [("a", "one"), ("b", "two")]


def test_progress_report(spark, folder):
    report = jobs.ProgressReport()
    spark.streams.addListener(report)
    try:
        table = KeyedTable(spark, f"{folder}/table", TEXT_MESSAGES, key=["id"], rule="first")
        produce(spark, f"{folder}/log", text("a", "one"), text("b", "two"))
        once(spark, folder, jobs.text_writer_batch(table, now(), None), "reported")
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        job = next(j for j in report.jobs.values() if j["name"] == "reported")
        assert job["rows"] >= 2 and job["batches"] >= 1 and job["error"] is None
    finally:
        spark.streams.removeListener(report)


def moody(rows):
    """Fails on texts that begin with ``bad``."""
    return EMBED(rows).withColumn("embed_error", F.when(F.col("text").startswith("bad"), F.lit("no")))


@pytest.mark.parametrize("with_dead", [True, False])
def test_counts_of_a_job_add_up_over_batches(spark, folder, with_dead):
    report, dead = jobs.ProgressReport(), jobs.DeadLetters(f"{folder}/dead") if with_dead else None
    later = ("c", '{"id": "c", "text": "three", "timestamp": 99, "source": "s"}')
    produce(spark, f"{folder}/log", text("a", "one"), text("b", "bad luck"), later)
    produce(spark, f"{folder}/log", text("d", "  "), ("x", "{bad"), text("e", "five"))
    body = jobs.embed_batch(moody, jobs.file_sink(f"{folder}/out"), now(), dead)
    source = log.stream(spark, f"{folder}/log", topic="text-messages", max_per_trigger=1)
    jobs.drain(jobs.run(source, "counted", f"{folder}/checkpoint", body, once=True, report=report))
    job = next(iter(report.jobs.values()))
    assert [job[n] for n in ("processed", "embedded", "refused", "failed")] == [6, 3, 2, 1]
    assert job["newest"].timestamp() == 99
    if with_dead:
        assert dead.read(spark).count() == 3


def test_counts_of_the_poller_and_of_the_writers(spark, folder):
    report, dead = jobs.ProgressReport(), jobs.DeadLetters(f"{folder}/dead")
    rows = [("a", "one", 5), ("b", "bad", 7), ("c", "three", 6)]
    messages = spark.createDataFrame(rows, "id string, content string, s long").withColumn("created_at", F.timestamp_seconds("s"))
    messages.drop("s").write.parquet(f"{folder}/messages")
    table = KeyedTable(spark, f"{folder}/table", TEXT_EMBEDDINGS, key=["text_message_id"], rule="first")
    source = spark.readStream.schema(messages.drop("s").schema).parquet(f"{folder}/messages")
    body = jobs.incremental_embed_batch(table, moody, now(), dead)
    jobs.drain(jobs.run(source, "poller", f"{folder}/poller", body, once=True, report=report))
    job = next(iter(report.jobs.values()))
    assert [job[n] for n in ("processed", "embedded", "refused", "failed")] == [3, 2, 0, 1] and job["newest"].timestamp() == 7
    assert [r.key for r in dead.read(spark).collect()] == ["b"]
    writer = jobs.text_writer_batch(KeyedTable(spark, f"{folder}/texts", TEXT_MESSAGES, key=["id"], rule="first"), now(), None)
    counts = writer(log_rows(spark, folder, text("a", "one"), ("x", "{bad")), "0")
    assert [counts[n] for n in ("processed", "embedded", "refused", "failed")] == [2, 0, 1, 0]


def log_rows(spark, folder, *messages):
    produce(spark, f"{folder}/rows", *messages)
    return log.batch(spark, f"{folder}/rows", topic="text-messages")


def test_a_failing_batch_leaves_nothing_cached(spark, folder):
    def broken(rows, name):
        raise RuntimeError("sink is down")

    spark.catalog.clearCache()
    with pytest.raises(RuntimeError):
        jobs.embed_batch(EMBED, broken, now(), None)(log_rows(spark, folder, text("a", "one")), "0")
    assert spark._jsparkSession.sharedState().cacheManager().isEmpty()


RETRIED = '''
import sys

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from vectrail.operators.tables import KeyedTable
from vectrail.schemas import STREAM_EMBEDDINGS
from vectrail.sources import log
from vectrail.streaming import jobs

folder = sys.argv[1]
spark = (
    SparkSession.builder.master("local[2,3]").config("spark.sql.shuffle.partitions", "2")
    .config("spark.ui.enabled", "false").config("spark.checkpoint.dir", folder + "/shared").getOrCreate()
)


def lost_once(batches):
    """Some rows, and then the first attempt of every task is gone."""
    for batch in batches:
        yield batch
        if TaskContext.get().attemptNumber() == 0 and batch.num_rows:
            raise OSError("lost")


def embed(rows):
    fails = F.when(F.col("text") == "text 3", F.lit("no"))
    vectors = rows.withColumns({"embedding": F.array(F.lit(1.0).cast("float")), "model_name": F.lit("m"), "embed_error": fails})
    return vectors.mapInArrow(lost_once, vectors.schema)


now = F.timestamp_seconds(F.lit(100))
value = F.concat(F.lit('{"id": "'), "id", F.lit('", "text": "text '), "id", F.lit('", "timestamp": 5}'))
rows = spark.range(40).select(F.col("id").cast("string").alias("id"), F.col("id").alias("n"))
log.write_files(log.to_log(rows, F.col("id"), value, "text-messages", F.col("n"), now, F.lit(0)), folder + "/log")
table, dead = KeyedTable(spark, folder + "/table", STREAM_EMBEDDINGS, key=["id"]), jobs.DeadLetters(folder + "/dead")
report = jobs.ProgressReport()
body = jobs.embed_store_batch(table, embed, now, dead)
source = log.stream(spark, folder + "/log", topic="text-messages")
jobs.drain(jobs.run(source, "retried", folder + "/checkpoint", body, once=True, report=report))
job = next(iter(report.jobs.values()))
ids = [r.id for r in table.read().select("id").collect()]
print("RESULT", len(ids), len(set(ids)), dead.read(spark).count(), job["processed"], job["embedded"], job["failed"])
'''


def test_tasks_that_are_lost_once_write_every_message_once(folder):
    """A session of its own, whose tasks may fail twice; every embedding task fails in its first attempt."""
    import os
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(jobs.__file__)))
    env = os.environ | {"PYTHONPATH": os.path.dirname(root)}
    ran = subprocess.run([sys.executable, "-c", RETRIED, folder], env=env, capture_output=True, text=True, timeout=240)
    assert "lost" in ran.stderr, ran.stderr[-2000:]
    assert "RESULT 39 39 1 40 39 1" in ran.stdout, ran.stdout[-500:] + ran.stderr[-2000:]


def read_job(spark, folder, **options):
    """A job that keeps what it reads, a folder per batch; gives the sizes of its batches and the keys read."""
    source = log.stream(spark, f"{folder}/log", topic="text-messages", checkpoint=f"{folder}/job", **options)
    body = lambda batch, name: batch.write.mode("overwrite").parquet(f"{folder}/read/{name}")
    jobs.drain(jobs.run(source, "reader", f"{folder}/job", body, once=True))
    if not glob.glob(f"{folder}/read/*"):
        return [], []
    read = [spark.read.schema(LOG).parquet(f) for f in sorted(glob.glob(f"{folder}/read/*"))]
    return [df.count() for df in read], sorted(r.key for df in read for r in df.collect())


def test_job_from_latest_reads_only_what_came_later_and_what_came_while_it_was_down(spark, folder):
    produce(spark, f"{folder}/log", text("a", "old"), text("b", "old"))
    assert read_job(spark, folder, starting=log.LATEST)[1] == []
    produce(spark, f"{folder}/log", text("c", "new"))
    produce(spark, f"{folder}/log", text("d", "newer"))
    assert read_job(spark, folder, starting=log.LATEST)[1] == ["c", "d"]
    produce(spark, f"{folder}/log", text("e", "newest"))
    assert read_job(spark, folder, starting=log.EARLIEST)[1] == ["c", "d", "e"]


def test_job_from_given_offsets_and_bad_starts(spark, folder):
    produce(spark, f"{folder}/log", *[text(k, "x") for k in "abcd"])
    assert read_job(spark, folder, starting={"text-messages": {0: 2, 7: 5}, "other": {0: 9}})[1] == ["c", "d"]
    with pytest.raises(ValueError):
        log.stream(spark, f"{folder}/log", starting="yesterday", checkpoint=f"{folder}/other")
    with pytest.raises(ValueError):
        log.stream(spark, f"{folder}/log", starting=log.LATEST)


def test_earliest_reads_the_same_rows_as_the_batch_in_bounded_batches(spark, folder):
    rows = spark.range(95).coalesce(1).select(F.col("id").cast("string").alias("k"), "id")
    placed = log.to_log(rows, F.col("k"), F.lit("v"), "text-messages", F.col("id"), now(), F.lit(0))
    log.write_files(placed, f"{folder}/log", per_file=10)
    sizes, keys = read_job(spark, folder, starting=log.EARLIEST, max_per_trigger=35, per_file=10)
    assert max(sizes) == 30 and sum(sizes) == 95
    assert keys == sorted(r.key for r in log.batch(spark, f"{folder}/log", topic="text-messages").collect())
