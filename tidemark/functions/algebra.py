"""Aggregates of a metric over an interval, as columns.

An aggregate is minimum, maximum, sum, count, integral and active_time. A value held for d ns that
counts n samples is (v, v, v*n, n, v*d, d); aggregates add up field by field. The empty one is
(+inf, -inf, 0, 0, 0, 0). Values may be doubles or decimals; decimals add up exactly, whatever
the order, which doubles don't.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

FIELDS = ("minimum", "maximum", "sum", "count", "integral", "active_time")
INF = float("inf")


def is_decimal(df: DataFrame, column: str = "value") -> bool:
    return isinstance(df.schema[column].dataType, T.DecimalType)


def as_number(whole: Column, decimal: bool) -> Column:
    """A whole number to multiply values by."""
    return whole.cast("decimal(18,0)") if decimal else whole.cast("double")


def held(value: Column, duration: Column, count: Column, decimal: bool = False) -> dict[str, Column]:
    """The aggregate of one value. A value that counts no sample adds 0 to the sum, whatever it is."""
    zero = F.lit(0).cast("decimal(18,0)") if decimal else F.lit(0.0)
    return {
        "minimum": value, "maximum": value, "sum": F.when(count > 0, value * as_number(count, decimal)).otherwise(zero),
        "count": count.cast("long"), "integral": value * as_number(duration, decimal), "active_time": duration.cast("long"),
    }


def added() -> list[Column]:
    """The aggregates of a group, added up."""
    return [F.min("minimum").alias("minimum"), F.max("maximum").alias("maximum"), *(F.sum(c).alias(c) for c in FIELDS[2:])]


def times(n: Column, decimal: bool = False) -> dict[str, Column]:
    """n equal aggregates one after another."""
    out = {c: F.col(c) for c in FIELDS[:2]}
    for c in ("sum", "integral"):
        out[c] = F.col(c) * as_number(n, decimal)
    return out | {c: F.col(c) * n for c in ("count", "active_time")}


def or_empty() -> dict[str, Column]:
    """The fields of an aggregate over no rows at all."""
    empty = {"minimum": F.lit(INF), "maximum": F.lit(-INF)}
    return {c: F.coalesce(F.col(c).cast("double") if c not in ("count", "active_time") else F.col(c), empty.get(c, F.lit(0))) for c in FIELDS}


def finite(value: Column) -> Column:
    return value.isNotNull() & ~F.isnan(value.cast("double")) & (F.abs(value.cast("double")) < F.lit(INF))


def means() -> dict[str, Column]:
    """Means that readers derive: of samples, and weighted by time; null where nothing counts."""
    return {
        "mean": F.when(F.col("count") > 0, F.col("sum").cast("double") / F.col("count")),
        "weighted_mean": F.when(F.col("active_time") > 0, F.col("integral").cast("double") / F.col("active_time")),
    }
