"""Text to vectors: a reproducible stand-in and plug-in models."""

from __future__ import annotations

import hashlib
import sys
import time
from collections import OrderedDict
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from types import ModuleType

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import bind
from .vector import l2_normalize

# Moduli and multipliers of L'Ecuyer's combined linear congruential
# generator (CACM 31(6), 1988).
M1, A1 = 2147483563, 40014
M2, A2 = 2147483399, 40692

# Texts to as many vectors; an error may stand in the place of a text's vector.
Encoder = Callable[[Sequence[str]], np.ndarray | list]


def jump_multipliers(dim: int) -> tuple[list[int], list[int]]:
    """Multipliers that take the two seeds straight to outputs 1..dim."""
    return (
        [pow(A1, i, M1) for i in range(1, dim + 1)],
        [pow(A2, i, M2) for i in range(1, dim + 1)],
    )


def embed_hash(text: Column, dim: int = 384) -> Column:
    """uniform(-1, 1) components from a generator seeded by the text, then unit length.

    The seeds are two 32-bit words of the text's md5; output i is a closed form of the
    seeds, so a vector needs one digest and no loop over state.
    """
    first, second = jump_multipliers(dim)

    def word(digest, at, modulus):
        return F.conv(F.substring(digest, at, 8), 16, 10).cast("bigint") % (modulus - 1) + 1

    def seeds(digest):
        return F.struct(word(digest, 1, M1).alias("a"), word(digest, 9, M2).alias("b"))

    def components(seed):
        return F.zip_with(
            F.lit(first).cast("array<bigint>"),
            F.lit(second).cast("array<bigint>"),
            lambda x, y: F.pmod(seed["a"] * x % M1 - seed["b"] * y % M2, F.lit(M1 - 1).cast("bigint"))
            * (2.0 / (M1 - 1))
            - 1.0,
        )

    return l2_normalize(bind(bind(F.md5(text), seeds), components))


MODEL_RESULT = T.StructType(
    [T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("error", T.StringType())]
)


def model_udf(make_encoder: Callable[[], Encoder], batch_size: int = 64):
    """A Column function that runs a model on Arrow batches of text: (embedding, error).

    ``make_encoder`` loads the model, once per worker process and not once per task; a model that
    cannot be loaded is an error of every text. A text the model fails on has its error and no
    embedding, and costs the rest of its batch nothing. A null text has neither.
    """
    loader = hashlib.md5(cloudpickle.dumps(make_encoder)).hexdigest()

    @F.arrow_udf(MODEL_RESULT)
    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            vectors: list = [None] * len(texts)
            errors: list = [None] * len(texts)
            given = np.flatnonzero(np.asarray(texts.is_valid()))
            for begin in range(0, len(given), batch_size):
                part = given[begin : begin + batch_size]
                try:
                    encode = _held_model(loader, "", lambda _: make_encoder())
                    found = _encode_rows(encode, texts.take(pa.array(part)).to_pylist())
                except Exception as error:
                    found = [None] * len(part), [str(error) or type(error).__name__] * len(part)
                for i, vector, problem in zip(part, *found):
                    vectors[i], errors[i] = vector, problem
            columns = [pa.array(vectors, pa.list_(pa.float32())), pa.array(errors, pa.string())]
            yield pa.StructArray.from_arrays(columns, names=MODEL_RESULT.names)

    return predict


def with_model(df: DataFrame, make_encoder: Callable[[], Encoder], text: str = "text", batch_size: int = 64) -> DataFrame:
    """E1 over a table: adds ``embedding`` and ``embed_error`` (null when it worked, and for a null text)."""
    kept = [c for c in df.columns if c not in ("embedding", "embed_error")]
    ran = df.select(*kept, model_udf(make_encoder, batch_size)(F.col(text)).alias("_ran"))
    return ran.select(*kept, F.col("_ran.embedding").alias("embedding"), F.col("_ran.error").alias("embed_error"))


def embed_counts(embedded: DataFrame, *keys: str, text: str = "text") -> DataFrame:
    """Rows ``embedded``, ``failed`` and ``without_text``, in all or by some columns."""
    failed = F.col("embed_error").isNotNull()
    return embedded.groupBy(*keys).agg(
        F.count_if(F.col("embedding").isNotNull()).alias("embedded"),
        F.count_if(failed).alias("failed"),
        F.count_if(F.col(text).isNull() & ~failed).alias("without_text"),
    )


def _encode_rows(encode: Encoder, texts: list[str]) -> tuple[list, list]:
    """Vectors and errors of one batch; only a failing batch is retried row by row. An encoder that
    knows which text failed gives the error in the vector's place, and is not asked again."""
    try:
        vectors = encode(texts)
        if len(vectors) != len(texts):
            raise ValueError(f"model gave {len(vectors)} vectors for {len(texts)} texts")
        failed = [isinstance(v, Exception) for v in vectors]
        return (
            [None if bad else np.asarray(v, dtype=np.float32) for v, bad in zip(vectors, failed)],
            [(str(v) or type(v).__name__) if bad else None for v, bad in zip(vectors, failed)],
        )
    except Exception:
        vectors, errors = [], []
        for text in texts:
            try:
                vectors.append(np.asarray(encode([text])[0], dtype=np.float32))
                errors.append(None)
            except Exception as error:
                vectors.append(None)
                errors.append(str(error) or type(error).__name__)
        return vectors, errors


# Models that a worker process keeps between tasks and jobs, the least recently used going first.
MODELS_HELD = 4


def _held_models() -> OrderedDict[tuple[str, str], Encoder]:
    """The process's models. This package travels with each job by value, so its own globals would
    be new in every job; a module of that name outlasts them."""
    home = sys.modules.setdefault("vectrail_held_models", ModuleType("vectrail_held_models"))
    return home.__dict__.setdefault("models", OrderedDict())


def _held_model(loader: str, name: str, load_model: Callable[[str], Encoder]) -> Encoder:
    """The model of that name, loaded once per worker process; ``loader`` tells loaders apart."""
    held = _held_models()
    if (loader, name) not in held:
        encoder = load_model(name)
        while len(held) >= MODELS_HELD:
            held.popitem(last=False)
        held[loader, name] = encoder
    held.move_to_end((loader, name))
    return held[loader, name]


def embed_by_model(
    df: DataFrame,
    load_model: Callable[[str], Encoder],
    default_model: str,
    text: str = "text",
    model: str = "model",
    batch_rows: int = 256,
) -> DataFrame:
    """Embed each row with the model it names, or the default one.

    Adds ``embedding``, ``model_name`` and ``embed_error`` (null when it worked). Models
    are kept by name in the worker process, ``MODELS_HELD`` at most, also between tasks.
    Rows stay where they are: grouping them by model would put the most popular model's
    rows into one task.
    """
    schema = T.StructType(
        [f for f in df.schema.fields if f.name not in ("embedding", "model_name", "embed_error")]
        + [
            T.StructField("embedding", T.ArrayType(T.FloatType())),
            T.StructField("model_name", T.StringType()),
            T.StructField("embed_error", T.StringType()),
        ]
    )

    loader = hashlib.md5(cloudpickle.dumps(load_model)).hexdigest()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for begin in range(0, len(batch), batch_rows):
                part = batch.iloc[begin : begin + batch_rows].reset_index(drop=True)
                asked = part[model] if model in part else pd.Series([None] * len(part))
                names = asked.where(asked.notna() & (asked != ""), default_model)
                vectors: list = [None] * len(part)
                errors: list = [None] * len(part)
                for name, rows in part.groupby(names).groups.items():
                    try:
                        encoder = _held_model(loader, name, load_model)
                        got, failed = _encode_rows(encoder, part.loc[rows, text].tolist())
                    except Exception as error:
                        got, failed = [None] * len(rows), [str(error)] * len(rows)
                    for row, vector, problem in zip(rows, got, failed):
                        vectors[row], errors[row] = vector, problem
                yield part.assign(embedding=vectors, model_name=names, embed_error=errors)[
                    schema.names
                ]

    return df.mapInPandas(run, schema)


def remote_encoder(
    post: Callable[[dict], tuple[int, dict]], at_once: int = 8, retries: int = 3, wait: float = 0.2
) -> Encoder:
    """An encoder that asks a service; ``post`` sends one JSON body and gives back
    status and JSON. Anything but 200 with a list under ``embedding`` is an error.

    A task has at most ``at_once`` requests open, so tasks times ``at_once`` is what the service
    sees. A request that found the service busy or out of reach (429, 5xx, ``OSError``) is sent again up
    to ``retries`` times, after ``wait`` seconds that double each time. A request that fails for good
    costs only its own text; vectors come in the order of the texts.
    """

    def ask(text: str) -> np.ndarray:
        for attempt in range(retries + 1):
            try:
                status, body = post({"text": text})
                problem = OSError(f"embedding request failed with status {status}")
                again = status == 429 or status >= 500
            except OSError as error:
                status, problem, again = None, error, True
            if status == 200:
                if not isinstance(body.get("embedding"), list):
                    raise OSError("embedding response holds no list")
                return np.asarray(body["embedding"], dtype=np.float32)
            if not again or attempt == retries:
                break
            time.sleep(wait * 2**attempt)
        raise problem

    def answer(text: str) -> np.ndarray | Exception:
        try:
            return ask(text)
        except Exception as error:
            return error

    def encode(texts: Sequence[str]) -> list[np.ndarray | Exception]:
        with ThreadPoolExecutor(max_workers=max(1, min(at_once, len(texts)))) as pool:
            return list(pool.map(answer, texts))

    return encode


def hash_encoder(dim: int = 384) -> Encoder:
    """E3 as a plug-in encoder, giving the same vectors as :func:`embed_hash`."""
    first, second = (np.array(m, dtype=np.int64) for m in jump_multipliers(dim))

    def encode(texts: Sequence[str]) -> np.ndarray:
        digests = [hashlib.md5(t.encode()).hexdigest() for t in texts]
        a = np.array([int(d[:8], 16) % (M1 - 1) + 1 for d in digests], dtype=np.int64)[:, None]
        b = np.array([int(d[8:16], 16) % (M2 - 1) + 1 for d in digests], dtype=np.int64)[:, None]
        raw = ((a * first % M1 - b * second % M2) % (M1 - 1)) * (2.0 / (M1 - 1)) - 1.0
        length = np.sqrt((raw * raw).sum(axis=1, keepdims=True))
        return (raw / np.where(length > 0, length, 1.0)).astype(np.float32)

    return encode


def embed_query(spark, text: str, dim: int = 384) -> list[float]:
    """The stand-in vector of one query text, on the driver."""
    return [float(x) for x in spark.range(1).select(embed_hash(F.lit(text), dim)).first()[0]]
