"""Distributions over value histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def histogram_of(df: DataFrame, groups: list, value: Column, weight: Column) -> DataFrame:
    """Weighted value counts per group: what every distribution below starts from."""
    return df.groupBy(*groups, value.alias("value")).agg(F.sum(weight).alias("n"))


def distribution(prefix: str = "") -> list[Column]:
    """n, median, quartiles, mean and share of values >= 2 over (value, n) rows. Exact."""
    v, n = F.col("value"), F.col("n")
    q = F.percentile(v, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), n)
    total = F.sum(n)
    return [
        total.alias(f"{prefix}n"),
        q[1].alias(f"{prefix}median"),
        q[0].alias(f"{prefix}p25"),
        q[2].alias(f"{prefix}p75"),
        F.try_divide(F.sum(v * n), total).alias(f"{prefix}mean"),
        F.try_divide(100.0 * F.sum(F.when(v >= 2, n).otherwise(0)), total).alias(f"{prefix}pct_ge2"),
    ]


def lag_distribution(value: str, weight: str) -> list[Column]:
    q = F.percentile(F.col(value), F.array(F.lit(0.5), F.lit(0.75), F.lit(0.9)), F.col(weight))
    return [
        F.sum(weight).alias("n"),
        q[0].alias("median"),
        q[1].alias("p75"),
        q[2].alias("p90"),
    ]


def zero_share() -> Column:
    zero = F.sum(F.when(F.col("value") == 0, F.col("n")).otherwise(0))
    return F.try_divide(100.0 * zero, F.sum("n"))


def gate_branch(short: Column, long: Column, need: float = 2.0) -> Column:
    """Decision from the medians at the short and the long look-back."""
    return (
        F.when(short >= need, "PASS").when(long >= need, "HOLD").otherwise("KILL")
    )


def floor_verdict(n: Column, floor: int = 30) -> Column:
    return F.when(n >= floor, "PASS").otherwise("DEGRADE")


def null_audit(df: DataFrame, columns: list[str]) -> DataFrame:
    """Per column: NULL rows and their share. One pass."""
    counts = df.agg(
        F.count("*").alias("_rows"), *[F.count_if(F.col(c).isNull()).alias(c) for c in columns]
    )
    return counts.select(
        "_rows",
        F.explode(
            F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("nulls")) for c in columns])
        ).alias("x"),
    ).select(
        "x.column", "x.nulls", F.try_divide(100.0 * F.col("x.nulls"), F.col("_rows")).alias("null_pct")
    )
