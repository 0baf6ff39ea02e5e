"""Building, parsing and normalising JSON messages."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import is_blank

UNKNOWN = "unknown"
DEFAULT_TABLE = "embeddings"


# --- building ------------------------------------------------------------------
def envelope(
    id: Column,
    text: Column,
    timestamp: Column,
    source: Column,
    model: Column | None = None,
    metadata: Column | None = None,
    experiment_config: Column | None = None,
    table_name: Column | None = None,
) -> Column:
    """The JSON value of one text message; ``timestamp`` is epoch seconds.

    Absent and null parts are left out of the JSON.
    """
    parts = {
        "id": id,
        "text": text,
        "timestamp": timestamp,
        "source": source,
        "model": model,
        "metadata": metadata,
        "experiment_config": experiment_config,
        "table_name": table_name,
    }
    return F.to_json(F.struct(*[c.alias(name) for name, c in parts.items() if c is not None]))


def embedding_output(now: Column) -> Column:
    """The JSON value written after embedding.

    Expects columns id, text, embedding, model_name, input_timestamp (double), input_source;
    the two inputs appear only when they are neither empty nor zero.
    """
    epoch = F.unix_micros(now) / 1e6
    return F.to_json(
        F.struct(
            F.col("id"),
            F.col("text").alias("original_text"),
            F.col("embedding"),
            F.col("model_name"),
            epoch.alias("timestamp"),
            F.size("embedding").alias("embedding_dimension"),
            epoch.alias("processing_timestamp"),
            F.nullif(F.col("input_timestamp"), F.lit(0.0)).alias("input_timestamp"),
            F.nullif(F.col("input_source"), F.lit("")).alias("input_source"),
        )
    )


# --- reading JSON by key ----------------------------------------------------------
def parsed(value: Column) -> Column:
    """The JSON value as a variant; null when it does not parse."""
    return F.try_parse_json(value)


def json_type(v: Column, path: str) -> Column:
    return F.schema_of_variant(F.try_variant_get(v, path, "variant"))


def text_at(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "string")


def is_number(kind: Column) -> Column:
    return kind.isin("BIGINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL")


def unless_false(kind: Column, text: Column) -> Column:
    """A value's text, or null when Python would call the value false."""
    return (
        F.when(kind == "STRING", F.nullif(text, F.lit("")))
        .when(kind == "BOOLEAN", F.nullif(text, F.lit("false")))
        .when(is_number(kind), F.when(text.try_cast("double") != 0, text))
        .when(text.isin("[]", "{}"), None)
        .otherwise(text)
    )


def truthy_text(v: Column, path: str) -> Column:
    """The value under ``path`` as text, or null when Python would call it false."""
    return unless_false(json_type(v, path), text_at(v, path))


def parse_timestamp_text(text: Column) -> Column:
    """ISO-8601 text to a timestamp; text without a zone is UTC, junk is null."""
    dated = text.rlike(r"^\d{4}-\d{2}-\d{2}")
    zoned = text.rlike(r"(Z|[+-]\d{2}:?\d{2})$")
    return F.when(dated & zoned, F.try_to_timestamp(text)).when(
        dated,
        F.coalesce(
            F.try_to_timestamp(F.concat(text, F.lit("Z"))),
            F.try_to_timestamp(F.concat(text, F.lit("T00:00:00Z"))),
        ),
    )


# The first and last second of the years 1 to 9999.
FIRST_SECOND, LAST_SECOND = -62135596800, 253402300799


def instant(seconds: Column) -> Column:
    """Epoch seconds as a timestamp; null outside the years 1 to 9999."""
    inside = seconds.between(FIRST_SECOND, LAST_SECOND)
    return F.timestamp_micros(F.round(F.when(inside, seconds) * 1e6).try_cast("bigint"))


def time_of(kind: Column, text: Column, seconds: Column, now: Column) -> Column:
    """The time of a value of that JSON type, text and number, see ``normalize_timestamp``."""
    return F.when(is_number(kind), instant(seconds)).otherwise(
        F.coalesce(F.when(kind == "STRING", parse_timestamp_text(text)), now)
    )


def normalize_timestamp(v: Column, path: str, now: Column) -> Column:
    """JSON number -> epoch seconds, ISO text -> its instant, anything else -> now.

    A number outside the years 1 to 9999 is no time: null, for the writer to refuse.
    """
    return time_of(json_type(v, path), text_at(v, path), F.try_variant_get(v, path, "double"), now)


# --- parsing whole messages ------------------------------------------------------------
class Parts:
    """Columns that hold the parts of one message while it is read; names that no log has."""

    def __init__(self, **parts: str):
        """``parts`` are the keys to read and what is asked of each: k(ind), t(ext), d(ouble), v(ariant)."""
        self.parts, self.whole = parts, F.col("__value")

    def columns(self) -> list[Column]:
        ask = {
            "k": lambda path: json_type(self.whole, path),
            "t": lambda path: text_at(self.whole, path),
            "d": lambda path: F.try_variant_get(self.whole, path, "double"),
            "v": lambda path: F.try_variant_get(self.whole, path, "variant"),
        }
        return [ask[a](f"$.{key}").alias(f"__{a}_{key}") for key, asked in self.parts.items() for a in asked]

    def kind(self, key: str) -> Column:
        return F.col(f"__k_{key}")

    def text(self, key: str) -> Column:
        return F.col(f"__t_{key}")

    def double(self, key: str) -> Column:
        return F.col(f"__d_{key}")

    def variant(self, key: str) -> Column:
        return F.col(f"__v_{key}")

    def truthy(self, key: str) -> Column:
        return F.col(f"__truthy_{key}")

    def truths(self) -> list[Column]:
        """The texts that Python would not call false, of the keys read with kind and text."""
        both = [key for key, asked in self.parts.items() if "k" in asked and "t" in asked]
        return [unless_false(self.kind(key), self.text(key)).alias(f"__truthy_{key}") for key in both]


def _read_once(log: DataFrame, keep: list[Column], parts: Parts, fields: dict[str, Column]) -> DataFrame:
    """Kept columns and the fields read from each row's JSON value.

    The value is parsed in one generator of one row and the fields come out of another: filters
    on fields cannot be pushed below it; as a plain projection they would be parsed again for
    every such filter. Each part is looked up once, in projections between them, small enough to be
    compiled.
    """
    first_char = F.ltrim(F.col("value"), F.lit(" \t\r\n"))
    parsed_once = F.inline(F.array(F.struct(parsed(F.col("value")).alias("__value"))))
    opened = log.select("*", parsed_once)
    is_object = F.coalesce(parts.whole.isNotNull() & first_char.startswith("{"), F.lit(False))
    asked = opened.select("*", is_object.alias("__is_object"), *parts.columns()).select("*", *parts.truths())
    return asked.select(*keep, F.inline(F.array(F.struct(*[c.alias(name) for name, c in fields.items()]))))


def parse_text_messages(log: DataFrame) -> DataFrame:
    """Log rows (key, value, ...) to typed fields.

    A JSON object gives its fields, and its key stands in for an absent id. Any other
    JSON value is taken as the text itself. ``is_json`` is false for values that do not
    parse; such rows carry nulls and are rejected downstream.
    """
    fallback = F.coalesce(F.nullif(F.col("key"), F.lit("")), F.lit(UNKNOWN))
    part = Parts(id="vt", text="vt", timestamp="d", source="t", model="kt", model_name="kt")
    is_json, is_object = part.whole.isNotNull(), F.col("__is_object")
    has_id = is_object & part.variant("id").isNotNull()
    fields = {
        "is_json": is_json,
        "id": F.when(is_json, F.when(has_id, part.text("id")).otherwise(fallback)),
        "text": F.when(is_object, part.text("text")).otherwise(text_at(part.whole, "$")),
        "input_timestamp": part.double("timestamp"),
        "input_source": part.text("source"),
        "model": F.coalesce(part.truthy("model"), part.truthy("model_name")),
        "has_id": has_id,
        "has_text": is_object & part.variant("text").isNotNull(),
    }
    return _read_once(log, [F.col(c) for c in log.columns], part, fields)


def normalize_embedding_messages(log: DataFrame, now: Column) -> DataFrame:
    """Embedding messages to the columns of an embeddings table.

    Each field falls through its alternatives while they are empty, zero or absent. The
    key column and any log position columns are kept.
    """
    keep = [
        F.col(c).alias(f"log_{c}") if c in ("timestamp", "key") else F.col(c)
        for c in log.columns
        if c != "value"
    ]
    key = F.nullif(F.col("key"), F.lit(""))
    names = ("id", "text", "original_text", "source", "model_name", "input_source", "table_name")
    part = Parts(timestamp="ktd", processing_timestamp="ktd", metadata="ktv", **dict.fromkeys(names, "kt"))

    def first_of(*keys: str, last: Column) -> Column:
        return F.coalesce(*[part.truthy(key) for key in keys], last)

    def time(key: str) -> Column:
        return time_of(part.kind(key), part.text(key), part.double(key), now)

    fields = {
        "is_json": part.whole.isNotNull(),
        "id": first_of("id", last=F.coalesce(key, F.lit(UNKNOWN))),
        "text": first_of("text", "original_text", last=F.lit("")),
        "embedding": F.try_variant_get(part.whole, "$.embedding", "array<float>"),
        "timestamp": F.when(part.truthy("timestamp").isNotNull(), time("timestamp")).otherwise(time("processing_timestamp")),
        "source": first_of("source", "model_name", "input_source", last=F.lit(UNKNOWN)),
        "metadata": F.coalesce(
            F.when(part.kind("metadata") == "STRING", F.to_json(part.variant("metadata"))),
            part.text("metadata"),
            F.lit("{}"),
        ),
        "table_name": first_of("table_name", last=F.lit(DEFAULT_TABLE)),
    }
    return _read_once(log, keep, part, fields)


# --- rejecting ------------------------------------------------------------------------
def with_reject_reason(df: DataFrame, checks: Mapping[str, Column]) -> DataFrame:
    """``reject_reason`` names the first failing check; null marks a good row."""
    reason = F.lit(None).cast("string")
    for name, failed in reversed(list(checks.items())):
        reason = F.when(F.coalesce(failed, F.lit(True)), name).otherwise(reason)
    return df.withColumn("reject_reason", reason)


def good(df: DataFrame) -> DataFrame:
    return df.filter("reject_reason is null").drop("reject_reason")


def rejected(df: DataFrame) -> DataFrame:
    return df.filter("reject_reason is not null")


def text_message_checks() -> dict[str, Column]:
    """What the embedding job refuses (T1, T3): unreadable JSON, blank text."""
    return {"malformed_json": ~F.col("is_json"), "blank_text": is_blank(F.col("text"))}


def required_field_checks() -> dict[str, Column]:
    """the text writer needs both an id and a text."""
    return {
        "malformed_json": ~F.col("is_json"),
        "missing_id": ~F.col("has_id") | F.col("id").isNull(),
        "missing_text": ~F.col("has_text") | F.col("text").isNull(),
    }


def embedding_checks(dim: int | None) -> dict[str, Column]:
    """F8: the writer needs a vector, of the table's dimension when that is fixed."""
    size = F.coalesce(F.size("embedding"), F.lit(-1))
    checks = {"malformed_json": ~F.col("is_json"), "missing_embedding": size <= 0}
    if dim is not None:
        checks["wrong_dimension"] = size != dim
    checks["invalid_timestamp"] = F.col("timestamp").isNull()
    return checks
