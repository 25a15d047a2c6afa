"""Numeric and vector column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CLAMP = 1e-6


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def logit(p: Column) -> Column:
    clamped = F.least(F.greatest(p, F.lit(CLAMP)), F.lit(1.0 - CLAMP))
    return F.ln(clamped / (F.lit(1.0) - clamped))


def ratio(num: Column, den: Column) -> Column:
    """Null, not zero, on an empty denominator."""
    return F.try_divide(num.cast("double"), den.cast("double"))


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def bind(value: Column, body) -> Column:
    """``body`` of a value evaluated once, also inside higher-order functions."""
    return F.transform(F.array(value), body)[0]


def unit(v: Column, *, zero: str = "null") -> Column:
    """L2-normalised vector; a zero or non-finite one gives null or zeros."""
    bad = F.transform(v, lambda x: F.lit(0.0)) if zero == "zeros" else F.lit(None)

    def divided(length):
        good = (length > 0) & ~F.isnan(length) & (length < F.lit(float("inf")))
        return F.when(good, F.transform(v, lambda x: x.cast("double") / length)).otherwise(bad)

    return bind(norm(v), divided)


def cosine(a: Column, b: Column, *, zero: str = "null") -> Column:
    size = norm(a) * norm(b)
    other = F.lit(0.0) if zero == "zero" else F.lit(None).cast("double")
    return F.when(size > 0, dot(a, b) / size).otherwise(other)


def lex(*parts: Column) -> Column:
    """Sort key compared part by part; same field names in every branch."""
    return F.struct(*[p.alias(f"k{i}") for i, p in enumerate(parts)])


def rounded(df, digits: int = 6):
    """Round every double column, for reports and comparisons."""
    kinds = dict(df.dtypes)
    return df.select(
        [F.round(c, digits).alias(c) if kinds[c] in ("double", "float") else F.col(c) for c in df.columns]
    )
