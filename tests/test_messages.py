import json

from pyspark.sql import functions as F

from vectrail.functions import messages as m

def now():
    return F.timestamp_seconds(F.lit(1_700_000_000))


def log(spark, *items):
    return spark.createDataFrame(list(items), "key string, value string")


def parsed(spark, *items):
    return [r.asDict() for r in m.parse_text_messages(log(spark, *items)).collect()]


def test_shapes_of_messages(spark):
    full, bare, number, broken, absent, null_id = parsed(
        spark,
        ("k", '{"id": "a", "text": "hi", "timestamp": 1.5, "source": "s", "model": "", "model_name": "mm"}'),
        ("k", '"just text"'),
        (None, "42"),
        ("k", '{"id": "a", "te'),
        ("", '{"text": "hi"}'),
        ("k", '{"id": 7, "text": "hi", "extra": {"deep": [1]}}'),
    )
    assert (full["id"], full["text"], full["input_timestamp"], full["model"]) == ("a", "hi", 1.5, "mm")
    assert (bare["id"], bare["text"], bare["has_id"]) == ("k", "just text", False)
    assert (number["id"], number["text"]) == ("unknown", "42")
    assert (broken["is_json"], broken["id"], broken["text"]) == (False, None, None)
    assert (absent["id"], absent["has_id"]) == ("unknown", False)
    assert null_id["id"] == "7"


def test_reject_reasons_take_the_first_failing_check(spark):
    rows = m.parse_text_messages(
        log(spark, ("k", "{"), ("k", '{"text": "x"}'), ("k", '{"id": "a"}'), ("k", '{"id": "a", "text": "x"}'))
    )
    checked = m.with_reject_reason(rows, m.required_field_checks())
    assert [r.reject_reason for r in checked.collect()] == ["malformed_json", "missing_id", "missing_text", None]
    assert m.good(checked).count() == 1 and m.rejected(checked).count() == 3


def normalized(spark, *values):
    rows = log(spark, *[("key", v if isinstance(v, str) else json.dumps(v)) for v in values])
    return [r.asDict() for r in m.normalize_embedding_messages(rows, now()).collect()]


def test_fallbacks_pass_over_empty_and_zero(spark):
    first, second, third = normalized(
        spark,
        {"id": "", "text": "", "original_text": "o", "source": "", "model_name": "m", "timestamp": 0,
         "processing_timestamp": 5, "embedding": [1, 2.5], "metadata": {"a": 1}, "table_name": None},
        {"id": 0, "embedding": [], "source": False, "input_source": "i", "table_name": "t"},
        {"id": "0", "timestamp": "not a time", "processing_timestamp": 5},
    )
    assert (first["id"], first["text"], first["source"], first["table_name"]) == ("key", "o", "m", "embeddings")
    assert first["timestamp"].timestamp() == 5 and first["embedding"] == [1.0, 2.5]
    assert json.loads(first["metadata"]) == {"a": 1}
    assert (second["id"], second["source"], second["table_name"]) == ("key", "i", "t")
    assert second["timestamp"].timestamp() == 1_700_000_000 and second["metadata"] == "{}"
    assert third["id"] == "0" and third["timestamp"].timestamp() == 1_700_000_000


def test_timestamps(spark):
    cases = [
        (12.25, 12.25), (1_700_000_001, 1_700_000_001), ("1970-01-01T00:00:10Z", 10),
        ("1970-01-01T02:00:10+02:00", 10), ("1970-01-01T00:00:10", 10), ("1970-01-02", 86400),
        ("1970-01-01 00:00:10.5", 10.5), ("12.25", 1_700_000_000), ("junk", 1_700_000_000),
        (None, 1_700_000_000), ([1], 1_700_000_000),
    ]
    df = log(spark, *[("k", json.dumps({"t": given})) for given, _ in cases])
    got = df.select(F.unix_micros(m.normalize_timestamp(m.parsed(F.col("value")), "$.t", now())) / 1e6)
    assert [r[0] for r in got.collect()] == [want for _, want in cases]


def test_embedding_checks(spark):
    rows = m.normalize_embedding_messages(
        log(spark, ("k", '{"id": "a"}'), ("k", '{"id": "a", "embedding": [1, 2]}'), ("k", "{"),
            ("k", '{"id": "a", "embedding": [1, 2, 3]}'), ("k", '{"id": "a", "embedding": []}')),
        now(),
    )
    reasons = [r.reject_reason for r in m.with_reject_reason(rows, m.embedding_checks(2)).collect()]
    assert reasons == ["missing_embedding", None, "malformed_json", "wrong_dimension", "missing_embedding"]


def test_envelope_leaves_out_what_is_absent(spark):
    value = m.envelope(
        F.lit("a"), F.lit("t"), F.lit(1.5), F.lit("s"), model=F.lit(None).cast("string"),
        metadata=F.struct(F.lit("d").alias("dataset"), F.lit(3).alias("tokens")),
    )
    got = json.loads(spark.range(1).select(value).first()[0])
    assert got == {"id": "a", "text": "t", "timestamp": 1.5, "source": "s", "metadata": {"dataset": "d", "tokens": 3}}


def test_times_out_of_range_and_text_metadata(spark):
    values = ['"timestamp": 1e13', '"timestamp": 1e300', '"timestamp": -1e12', '"timestamp": 1700000000.5', '"metadata": "x"', '"metadata": [1]', '"metadata": null']
    rows = [("k", '{"id": "%d", "embedding": [1.0], %s}' % (i, v)) for i, v in enumerate(values)]
    log = spark.createDataFrame(rows, "key string, value string")
    out = m.normalize_embedding_messages(log, F.timestamp_seconds(F.lit(5)))
    out = m.with_reject_reason(out, m.embedding_checks(1)).select("id", "reject_reason", "metadata", F.unix_micros("timestamp").alias("t"))
    got = {r.id: r for r in out.collect()}
    assert [got[str(i)].reject_reason for i in range(7)] == ["invalid_timestamp"] * 3 + [None] * 4
    assert got["3"].t == 1700000000500000 and got["4"].t == 5000000
    assert [got[str(i)].metadata for i in (4, 5, 6)] == ['"x"', "[1]", "{}"]


def test_values_that_are_no_objects_and_metadata_of_every_type(spark):
    values = [
        ' \n{"id": 7, "text": ["a", 1], "model": 0, "model_name": "m"}', '[{"id": "x"}]', '"{bare}"', "12.5", "null", '{"id": null}',
    ]
    rows = spark.createDataFrame([("k", v) for v in values], "key string, value string")
    got = [tuple(r)[2:] for r in m.parse_text_messages(rows).collect()]
    assert got[0] == (True, "7", '["a",1]', None, None, "m", True, True)
    assert [r[1:3] for r in got[1:5]] == [("k", '[{"id":"x"}]'), ("k", "{bare}"), ("k", "12.5"), ("k", None)]
    assert not any(r[6] or r[7] for r in got[1:5]) and got[5][1] is None and got[5][6] and not got[5][7]
    given = {'{"a": 1}': '{"a":1}', "[1, 2]": "[1,2]", '"s"': '"s"', "null": "{}", "false": "false", "0": "0"}
    rows = spark.createDataFrame([("k", f'{{"metadata": {g}}}') for g in given], "key string, value string")
    assert [r.metadata for r in m.normalize_embedding_messages(rows, now()).collect()] == list(given.values())
