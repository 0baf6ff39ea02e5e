"""Schemas of every table, file and message; reads never infer one.

Fixed values: all column and field names.
"""

from pyspark.sql import types as T

STRING, INT, LONG, DOUBLE = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType()
BOOLEAN, TIMESTAMP = T.BooleanType(), T.TimestampType()
STRINGS, DOUBLES, VECTOR = T.ArrayType(STRING), T.ArrayType(DOUBLE), T.ArrayType(T.FloatType())


def _struct(*fields) -> T.StructType:
    return T.StructType([T.StructField(name, type_) for name, type_ in fields])


# --- corpora -----------------------------------------------------------------
NEWS = _struct(
    ("title", STRING),
    ("article", STRING),
)
PAPER = _struct(
    ("id", STRING),
    ("submitter", STRING),
    ("authors", STRING),
    ("title", STRING),
    ("comments", STRING),
    ("journal-ref", STRING),
    ("doi", STRING),
    ("abstract", STRING),
    ("report-no", STRING),
    ("categories", STRINGS),
    ("versions", STRINGS),
)
ARTICLE = _struct(
    ("title", STRING),
    ("text", STRING),
    ("url", STRING),
)
PARTITIONED_ARTICLE = _struct(
    ("title", STRING),
    ("text", STRING),
    ("url", STRING),
    ("date", STRING),
    ("lang", STRING),
)
EMBEDDING_FILE = _struct(
    ("embedding", DOUBLES),
    ("model_name", STRING),
    ("metadata", _struct(("dimension", INT), ("timestamp", STRING))),
)

# --- message log ---------------------------------------------------------------
LOG = _struct(
    ("topic", STRING),
    ("partition", INT),
    ("offset", LONG),
    ("key", STRING),
    ("value", STRING),
    ("timestamp", TIMESTAMP),
)

POSITIONS = _struct(("topic", STRING), ("partition", INT), ("skipped", LONG))

# --- keyed tables ----------------------------------------------------------------
TEXT_MESSAGES = _struct(
    ("id", STRING),
    ("content", STRING),
    ("source", STRING),
    ("created_at", TIMESTAMP),
    ("processed_at", TIMESTAMP),
)
TEXT_EMBEDDINGS = _struct(
    ("text_message_id", STRING),
    ("text_content", STRING),
    ("embedding", VECTOR),
    ("created_at", TIMESTAMP),
)
EMBEDDINGS = _struct(
    ("id", STRING),
    ("text", STRING),
    ("embedding", VECTOR),
    ("timestamp", TIMESTAMP),
    ("source", STRING),
    ("metadata", STRING),
)
STREAM_EMBEDDINGS = _struct(
    ("id", STRING),
    ("text", STRING),
    ("embedding", VECTOR),
    ("created_at", TIMESTAMP),
    ("processed_at", TIMESTAMP),
)
MANAGED = _struct(
    ("message_id", STRING),
    ("original_text", STRING),
    ("embedding", VECTOR),
    ("model_name", STRING),
    ("created_at", TIMESTAMP),
    ("updated_at", TIMESTAMP),
)
REGISTRY = _struct(
    ("table_name", STRING),
    ("description", STRING),
    ("vector_dimension", INT),
    ("model_name", STRING),
    ("created_at", TIMESTAMP),
)
CATALOG = T.StructType([*REGISTRY.fields, T.StructField("kind", STRING)])

# --- run results ------------------------------------------------------------------
RUN_RESULT = _struct(
    ("architecture", STRING),
    ("model", STRING),
    ("dataset", STRING),
    ("chunk_size_kb", DOUBLE),
    ("burst_length_s", INT),
    ("result_ms", DOUBLE),
    ("chunk_size_tokens", INT),
    ("burst_enabled", BOOLEAN),
    ("burst_interval_s", INT),
    ("chunks_produced", LONG),
    ("chunks_processed", LONG),
    ("chunks_persisted", LONG),
    ("total_duration_ms", DOUBLE),
    ("throughput_chunks_per_s", DOUBLE),
    ("throughput_tokens_per_s", DOUBLE),
    ("success_rate", DOUBLE),
    ("status", STRING),
    ("error_message", STRING),
)
