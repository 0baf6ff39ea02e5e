from datetime import datetime

import pytest
from pyspark.sql import functions as F

from vectrail import fs
from vectrail.operators import joins, keyed
from vectrail.operators.registry import Catalog
from vectrail.operators.tables import KeyedTable, routed_table
from vectrail.schemas import EMBEDDINGS, MANAGED, TEXT_MESSAGES
from vectrail.schemas import _struct, INT, STRING, TIMESTAMP

SIMPLE = _struct(("id", STRING), ("text", STRING))


def rows(spark, *items):
    return spark.createDataFrame(list(items), "id string, text string, seq int")


def content(table, *columns):
    return sorted(tuple(r) for r in table.read().select(*(columns or ("id", "text"))).collect())


def test_upsert_across_batches_and_compaction(spark, folder):
    table = KeyedTable(spark, folder, SIMPLE, key=["id"])
    table.append(rows(spark, ("a", "1", 1), ("a", "2", 2), ("b", "1", 1)), 0, ["seq"])
    assert content(table) == [("a", "2"), ("b", "1")]
    table.compact()
    table.append(rows(spark, ("b", "3", 1), ("c", "1", 1)), 1, ["seq"])
    assert content(table) == [("a", "2"), ("b", "3"), ("c", "1")]
    table.compact()
    table.vacuum()
    assert content(table) == [("a", "2"), ("b", "3"), ("c", "1")]
    assert fs.children(spark, f"{folder}/log") == []


def test_repeated_batch_changes_nothing(spark, folder):
    for rule in ("last", "first"):
        table = KeyedTable(spark, f"{folder}/{rule}", SIMPLE, key=["id"], rule=rule)
        batch = rows(spark, ("a", "1", 1), ("a", "2", 2), ("b", "1", 1))
        table.append(batch, 0, ["seq"])
        before = content(table)
        table.append(batch, 0, ["seq"])
        assert content(table) == before
        table.compact()
        table.append(batch, 0, ["seq"])
        assert content(table) == before


def test_uncommitted_folders_are_not_read(spark, folder):
    table = KeyedTable(spark, folder, SIMPLE, key=["id"])
    table.append(rows(spark, ("a", "1", 1)), 0, ["seq"])
    table.append(rows(spark, ("a", "2", 1)), 1, ["seq"])
    fs.remove(spark, f"{folder}/log/000000001@1/_SUCCESS")
    assert content(table) == [("a", "1")]


def test_first_writer_wins(spark, folder):
    table = KeyedTable(spark, folder, SIMPLE, key=["id"], rule="first")
    table.append(rows(spark, ("a", "late", 5), ("a", "early", 1)), 0, ["seq"])
    table.append(rows(spark, ("a", "other", 0), ("b", "new", 0)), 1, ["seq"])
    assert content(table) == [("a", "early"), ("b", "new")]


@pytest.mark.parametrize("broadcast_keys", [0, 100])
def test_without_existing_both_ways(spark, broadcast_keys):
    new = rows(spark, ("a", "x", 1), ("b", "x", 1), ("c", "x", 1))
    old = rows(spark, ("b", "y", 1), ("z", "y", 1))
    left = keyed.without_existing(new, old, ["id"], broadcast_keys)
    assert sorted(r.id for r in left.collect()) == ["a", "c"]


def test_creation_time_survives_updates(spark, folder):
    schema = _struct(("id", STRING), ("text", STRING), ("created_at", TIMESTAMP))
    table = KeyedTable(spark, folder, schema, key=["id"], keep_first=["created_at"])

    def batch(text, day, n):
        row = [("a", text, datetime(2024, 1, day))]
        table.append(spark.createDataFrame(row, schema), n, ["created_at"])

    batch("one", 1, 0)
    batch("two", 2, 1)
    assert content(table, "text", "created_at") == [("two", datetime(2024, 1, 1))]
    table.compact()
    batch("three", 3, 2)
    batch("four", 4, 3)
    assert content(table, "text", "created_at") == [("four", datetime(2024, 1, 1))]


def test_compaction_starts_by_itself(spark, folder):
    table = KeyedTable(spark, folder, SIMPLE, key=["id"], compact_after=3)
    for n in range(7):
        table.append(rows(spark, ("a", str(n), 1), (f"k{n}", "x", 1)), n, ["seq"])
    assert len(fs.children(spark, f"{folder}/base")) >= 1
    assert content(table)[0] == ("a", "6") and len(content(table)) == 8


@pytest.mark.parametrize("rule", ["last", "first"])
def test_small_batches_on_a_large_base_leave_few_pieces(spark, folder, rule):
    table = KeyedTable(spark, folder, SIMPLE, key=["id"], rule=rule)
    base = spark.range(50_000).select(F.concat(F.lit("b"), "id").alias("id"), F.repeat(F.lit("base "), 20).alias("text"))
    table.replace(base)
    want = {}
    for n in range(40):
        given = [(f"k{n % 5}", str(n)), (f"b{n}", f"new {n}"), (f"n{n}", "x")]
        table.append(rows(spark, *[(i, t, 1) for i, t in given]).coalesce(1), n, ["seq"])
        for i, t in given:
            want[i] = t if rule == "last" else want.get(i, t if i[0] != "b" else "base " * 20)
    assert len(fs.children(spark, f"{folder}/base")) == 1
    assert len(table._pieces(table._covered())) <= 2 * 8 + 1
    got = dict(content(table))
    assert len(got) == 50_000 + 45 and {i: got[i] for i in want} == want
    before = content(table)
    table.append(rows(spark, ("k0", "replayed", 1)), 3, ["seq"])  # long since merged
    assert content(table) == before
    table.vacuum()
    assert content(table) == before and len(fs.children(spark, f"{folder}/log")) <= 2 * 8 + 1
    plan = table.read()._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan


def test_creation_times_outlive_merging(spark, folder):
    shape = "id string, text string, created_at timestamp, seq long"
    table = KeyedTable(spark, folder, spark.createDataFrame([], "id string, text string, created_at timestamp").schema, key=["id"], keep_first=["created_at"], compact_after=1000)
    for n in range(20):
        table.append(spark.createDataFrame([("a", str(n), datetime(2024, 1, 1 + n), 1)], shape), n, ["seq"])
    assert len(table._pieces(-1)) < 12
    assert content(table, "text", "created_at") == [("19", datetime(2024, 1, 1))]


def test_truncate_and_delete(spark, folder):
    table = KeyedTable(spark, folder, SIMPLE, key=["id"])
    table.append(rows(spark, ("a", "1", 1), ("b", "1", 1)), 0, ["seq"])
    table.delete(F.col("id") == "a")
    assert content(table) == [("b", "1")]
    table.truncate()
    assert content(table) == []
    table.append(rows(spark, ("c", "1", 1)), table.next_batch(), ["seq"])
    assert content(table) == [("c", "1")]


def test_one_key_with_most_of_a_batch(spark, folder):
    """A hot key is combined before the shuffle and comes out once."""
    batch = spark.range(20000).select(
        F.when(F.col("id") % 3 > 0, "hot").otherwise(F.col("id").cast("string")).alias("id"),
        F.col("id").cast("string").alias("text"),
        F.col("id").alias("seq"),
    )
    table = KeyedTable(spark, folder, SIMPLE, key=["id"])
    table.append(batch, 0, ["seq"])
    got = dict(content(table))
    assert got["hot"] == "19999" and len(got) == 20000 // 3 + 2


def test_routed_rows_are_pruned_by_destination(spark, folder):
    table = routed_table(spark, folder, EMBEDDINGS)
    batch = rows(spark, ("a", "1", 1), ("a", "2", 2)).select(
        "id", "text", F.lit(None).cast("array<float>").alias("embedding"),
        F.current_timestamp().alias("timestamp"), F.lit("s").alias("source"),
        F.lit("{}").alias("metadata"), F.concat(F.lit("t"), F.col("seq")).alias("table_name"), "seq",
    )
    table.append(batch, 0, ["seq"])
    table.compact()
    one = table.read().filter("table_name = 't2'")
    assert [r.text for r in one.collect()] == ["2"]
    assert "PartitionFilters: [isnotnull(table_name" in one._jdf.queryExecution().toString()


def test_lookup_by_key_reaches_the_scan(spark, folder):
    table = KeyedTable(spark, folder, SIMPLE, key=["id"])
    table.append(rows(spark, ("a", "1", 1), ("b", "2", 1)), 0, ["seq"])
    table.compact()
    found = table.read().filter("id = 'b'")
    assert "PushedFilters: [IsNotNull(id), EqualTo(id,b)]" in found._jdf.queryExecution().toString()
    assert [r.text for r in found.collect()] == ["2"]


def test_stage_latency_with_a_missing_stage(spark):
    log = spark.createDataFrame(
        [("a", "start", 0.0), ("a", "produced", 1.0), ("a", "embedded", 3.0), ("a", "finished", 4.5),
         ("b", "start", 0.0), ("b", "produced", 1.0), ("b", "finished", 2.0)],
        "id string, stage string, s double",
    ).withColumn("at", F.timestamp_seconds("s"))
    got = {r.id: tuple(r)[1:] for r in joins.stage_latency(log, "id", "stage", "at").collect()}
    assert got == {"a": (4500.0, 2000.0, 1500.0), "b": (2000.0, None, None)}


def test_grid_without_bursts(spark):
    df = spark.createDataFrame([("x",), ("y",)], "dataset string")
    assert joins.experiment_grid(df, [0.5, 1.0], [], 5).count() == 4
    assert joins.experiment_grid(df, [0.5, 1.0], [30, 60], 5).count() == 12


# --- registry -----------------------------------------------------------------------------
def inserted(spark, *items):
    schema = "id string, text string, embedding array<float>, source string, timestamp timestamp, metadata string"
    return spark.createDataFrame([(*i, None, None) for i in items], schema)


def test_catalog(spark, folder):
    catalog = Catalog(spark, folder)
    early, late = F.timestamp_seconds(F.lit(100)), F.timestamp_seconds(F.lit(200))
    catalog.create("second", 3, "m1", "first words", now=early)
    catalog.create("first", 2, now=early)
    catalog.create("second", 3, "m2", "other words", now=late)
    listed = catalog.list().collect()
    assert [r.table_name for r in listed] == ["first", "second"]
    assert listed[1].model_name == "m2" and listed[1].created_at == listed[0].created_at

    refused = catalog.insert("second", inserted(spark, ("a", "x", [1.0, 2.0, 3.0], "s"), ("b", "", [1.0, 2.0, 3.0], "s")), early)
    assert [(r.id, r.reject_reason) for r in refused.collect()] == [("b", "missing_text")]
    refused = catalog.insert("second", inserted(spark, ("a", "y", [3.0, 2.0, 1.0], None), ("c", "z", [1.0], "s")), late)
    assert [(r.id, r.reject_reason) for r in refused.collect()] == [("c", "wrong_dimension")]
    info = catalog.info("second")
    assert info["row_count"] == 1 and info["vector_dimension"] == 3
    sample = info["sample_data"]
    assert (sample.original_text, sample.model_name) == ("y", "cli")
    assert sample.created_at < sample.updated_at

    with pytest.raises(KeyError):
        catalog.info("absent")
    catalog.drop("first")
    assert [r.table_name for r in catalog.list().collect()] == ["second"]
    assert catalog.drop_all() == 0 and catalog.list().count() == 1
    assert catalog.drop_all(confirm=True) == 1 and catalog.list().count() == 0


def test_catalog_tables_keep_their_kind(spark, folder):
    """A writer's table fits vectors and is found again as such; it cannot become a managed one."""
    now = F.timestamp_seconds(F.lit(100))
    Catalog(spark, folder).create("w", 3, now=now, kind="writer")
    again = Catalog(spark, folder)
    items = inserted(spark, ("a", "x", [1.0], "s"), ("b", "y", [1.0, 2.0, 3.0, 4.0], None), ("c", "z", None, None), ("d", None, None, None))
    assert [(r.id, r.reject_reason) for r in again.insert("w", items, now).collect()] == [("d", "missing_text")]
    got = {r.id: (r.embedding, r.source, r.metadata) for r in again.table("w").read().collect()}
    assert got == {"a": ([1.0, 0.0, 0.0], "s", "{}"), "b": ([1.0, 2.0, 3.0], "cli", "{}"), "c": ([0.0, 0.0, 0.0], "cli", "{}")}
    with pytest.raises(ValueError):
        again.create("w", 3, now=now)
    with pytest.raises(ValueError):
        again.create("v", 3, now=now, kind="other")
    again.create("m", 3, now=now)
    info = {r.table_name: (r.kind, r.row_count, r.sample_id) for r in again.describe().collect()}
    assert info == {"w": ("writer", 3, "a"), "m": ("managed", 0, None)}
    assert again.info("w")["row_count"] == 3 and Catalog(spark, f"{folder}/none").describe().collect() == []


def test_unknown_table_shape_is_refused(spark):
    with pytest.raises(ValueError):
        keyed.adaptive_rows(inserted(spark, ("a", "x", [1.0], "s")), ["foo", "bar"], 3, F.current_timestamp())
    shaped = keyed.adaptive_rows(inserted(spark, ("a", "x", [1.0], "s")), MANAGED.fieldNames(), 3, F.current_timestamp())
    assert shaped.columns == MANAGED.fieldNames()
    assert set(TEXT_MESSAGES.fieldNames()) == {"id", "content", "source", "created_at", "processed_at"}
    assert INT.simpleString() == "int"
