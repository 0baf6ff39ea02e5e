import pytest
from pyspark.sql import functions as F

from vectrail.operators import search
from vectrail.operators.limits import first_rows


@pytest.mark.parametrize("n, skip", [(1, 0), (7, 0), (250, 0), (499, 0), (500, 0), (2000, 0), (10, 45), (500, 490), (5, 600)])
def test_first_rows_both_ways(spark, n, skip):
    """The distributed cut keeps just the rows a limit would."""
    df = spark.range(500).select(F.expr("cast(id * 37 % 500 / 3 as int)").alias("a"), F.col("id").alias("x"))
    df = df.repartition(6)
    want = sorted(tuple(r) for r in df.orderBy("a", "x").offset(skip).limit(n).collect())
    cut = first_rows(df, n, "a", "x", skip=skip, heap_rows=0)
    assert sorted(tuple(r) for r in cut.collect()) == want
    assert sorted(tuple(r) for r in first_rows(df, n, "a", "x", skip=skip).collect()) == want


@pytest.mark.parametrize("n, skip", [(15, 0), (15, 3), (3, 12), (40, 0), (9, 35), (5, 50), (1, 19)])
def test_limits_with_equal_keys_do_not_depend_on_the_way(spark, n, skip):
    """40 rows over 4 keys, some rows equal: exactly n rows, the same ones by heap and by sort."""
    df = spark.range(40).select((F.col("id") % 4).alias("k"), F.expr("cast(id / 3 as int) as x")).repartition(5)
    ways = [sorted(map(tuple, first_rows(df, n, "k", skip=skip, heap_rows=h).collect())) for h in (0, 100)]
    keys = sorted(r.k for r in df.collect())[skip : skip + n]
    assert ways[0] == ways[1] and [k for k, _ in ways[0]] == keys


@pytest.mark.parametrize("heap_rows", [0, 1000])
def test_pages_newest_first(spark, heap_rows):
    df = spark.range(100).select(
        F.format_string("m%03d", "id").alias("id"),
        F.when(F.col("id") > 2, F.timestamp_seconds(F.col("id") % 10)).alias("processed_at"),
    )
    ids = lambda **page: [r.id for r in search.newest(df, "processed_at", "id", heap_rows=heap_rows, **page).collect()]
    everything = ids(limit=200)
    assert everything[:3] == ["m009", "m019", "m029"] and everything[-3:] == ["m000", "m001", "m002"]
    assert ids(limit=10, offset=35) == everything[35:45]
    assert ids(limit=10, offset=95) == everything[95:]
    page, total = search.paginate(df, "processed_at", "id", 5, 10)
    assert [r.id for r in page.collect()] == everything[10:15] and total == 100


def test_text_search_ignores_case_and_honours_wildcards(spark):
    rows = [("a", "Machine Learning", 1), ("b", "machine", 2), ("c", "learn 100%", 3), ("d", None, 4)]
    df = spark.createDataFrame(rows, "id string, text string, s long").withColumn("at", F.timestamp_seconds("s"))
    ids = lambda q, n=10: [r.id for r in search.search_text(df, q, "text", "at", "id", n).collect()]
    assert ids("LEARN") == ["c", "a"] and ids("m%l_a") == ["a"] and ids("machine", 1) == ["b"] and ids("absent") == []


def test_recent_and_lookup(spark):
    df = spark.range(5).select("id", F.timestamp_seconds(F.col("id") * 1800).alias("processed_at"))
    now = F.timestamp_seconds(F.lit(2 * 3600))
    assert sorted(r.id for r in search.recent(df, now, "1 hour").collect()) == [3, 4]
    assert search.get_by_id(df, 9).count() == 0 and search.get_by_id(df, 2).count() == 1
    assert {r.distance for r in search.search_recent(df, "processed_at", "id", 2).collect()} == {0.5}


def test_rows_that_tie_in_time_and_id_come_alike_at_any_depth(spark):
    rows = spark.createDataFrame([("a", 1, f"t{k}") for k in range(9)], "id string, at long, text string")
    rows = rows.withColumn("at", F.timestamp_seconds("at"))
    shallow = [r.text for r in search.newest(rows, "at", "id", 4, 2).collect()]
    deep = [r.text for r in search.newest(rows, "at", "id", 4, 2, heap_rows=1).collect()]
    assert sorted(shallow) == sorted(deep)
