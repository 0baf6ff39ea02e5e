"""Vectors as ``array<float>``; all arithmetic in double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import bind


def _double(v: Column) -> Column:
    return v.cast("array<double>")


def literal(values) -> Column:
    """A query vector as a constant; its length is the model's dimension."""
    return F.lit([float(x) for x in values]).cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(_double(a), _double(b), lambda x, y: x * y)
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(_double(v), F.lit(0.0), lambda total, x: total + x * x))


def cosine_distance(a: Column, b: Column, norm_b: Column | None = None) -> Column:
    """1 - cos; null when either vector is zero (undefined) or lengths differ."""
    return F.lit(1.0) - F.try_divide(dot(a, b), norm(a) * (norm(b) if norm_b is None else norm_b))


def l2_normalize(v: Column) -> Column:
    """Unit length; a zero vector stays as it is."""
    def divided(e: Column) -> Column:
        length = F.coalesce(F.nullif(norm(e), F.lit(0.0)), F.lit(1.0))
        return bind(length, lambda n: F.transform(e, lambda x: (x / n).cast("float")))

    return bind(_double(v), divided)


def fit_dimension(v: Column, dim: int) -> Column:
    """Pad with zeros or cut to ``dim``; null counts as empty."""
    padding = F.array_repeat(F.lit(0.0).cast("float"), dim)
    given = F.coalesce(v.cast("array<float>"), F.array().cast("array<float>"))
    return F.slice(F.concat(given, padding), 1, dim)


def encode_literal(v: Column) -> Column:
    """K6: ``[a,b,c]`` text."""
    return F.concat(F.lit("["), F.array_join(v.cast("array<string>"), ","), F.lit("]"))


def decode_literal(text: Column) -> Column:
    """K6 back: null when the text is no list of numbers."""
    return F.from_json(text, "array<float>")


def preview_vector(v: Column, n: int = 5) -> Column:
    """P20: the first ``n`` components."""
    return F.slice(v, 1, n)


def has_dimension(v: Column, dim: int) -> Column:
    """F8: a vector of exactly ``dim`` components."""
    return F.coalesce(F.size(v) == dim, F.lit(False))
