"""Column expressions shared by the operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def r6(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def finite(c: Column) -> Column:
    """True for values that are neither null, NaN nor infinite."""
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))


def share(condition: Column) -> Column:
    """Aggregate: the fraction of rows that meet a condition (null conditions are left out)."""
    return F.avg(condition.cast("double"))


def count_if(condition: Column) -> Column:
    return F.sum(F.when(condition, 1).otherwise(0)).cast("long")


def sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))


def percentile(c: Column | str, *at: float) -> Column:
    """Exact, linearly interpolated quantiles; one value, or an array for several."""
    return F.percentile(c, at[0] if len(at) == 1 else list(at))


def keyword_case(text: Column, cases: list[tuple[str, str]], default: str) -> Column:
    """The value of the first keyword that occurs in text; the order of cases decides."""
    out = F.when(F.lit(False), F.lit(None))
    for keyword, value in cases:
        out = out.when(F.contains(text, F.lit(keyword)), F.lit(value))
    return out.otherwise(F.lit(default))


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)


# The one random source that both Spark and other SQL engines can compute: 60 bits of a SHA-256.
TWO60 = float(1 << 60)


def draw(*parts: Column | str | int) -> Column:
    """A non-negative 60-bit number from the parts joined by '|'."""
    columns = [p if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    return F.conv(F.substr(F.sha2(F.concat_ws("|", *[c.cast("string") for c in columns]), 256), F.lit(1), F.lit(15)), 16, 10).cast("long")


def uniform(*parts: Column | str | int) -> Column:
    return draw(*parts) / F.lit(TWO60)


def rank_to_unsigned(hexadecimal: Column) -> Column:
    """A 16-digit hexadecimal hash as a signed 64-bit number."""
    return F.conv(hexadecimal, 16, -10).cast("long")


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))
