"""Group shares, common support, weighted means, histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelwake.operators.dedupe import keep_first


def zero_fill(universe: DataFrame, counts: DataFrame, key: str, n: str) -> DataFrame:
    """Counts on the universe with 0 where nothing was counted, and the zero/positive group."""
    out = universe.join(counts, key, "left").withColumn(n, F.coalesce(n, F.lit(0)))
    return out.withColumn("mass", F.when(F.col(n) == 0, "zero").otherwise("positive"))


def share_table(df: DataFrame, level: str, group: str = "mass") -> DataFrame:
    """Rows per level and their share inside each of the two groups."""
    counts = df.groupBy(level, group).agg(F.count("*").alias("n"))
    total = F.sum("n").over(W.partitionBy(group))  # one row per level and group
    wide = counts.withColumn("pct", 100.0 * F.col("n") / total)
    at = lambda g, c: F.max(F.when(F.col(group) == g, F.col(c)))
    return wide.groupBy(level).agg(
        F.coalesce(at("zero", "n"), F.lit(0)).alias("n_zero"),
        F.coalesce(at("zero", "pct"), F.lit(0.0)).alias("pct_zero"),
        F.coalesce(at("positive", "n"), F.lit(0)).alias("n_positive"),
        F.coalesce(at("positive", "pct"), F.lit(0.0)).alias("pct_positive"),
    )


def support_cells(df: DataFrame, cell: list[str], group: str = "mass") -> DataFrame:
    return df.groupBy(*cell).agg(
        F.count_if(F.col(group) == "zero").alias("n_zero"),
        F.count_if(F.col(group) == "positive").alias("n_pos"),
    )


def support_overlap(cells: DataFrame) -> DataFrame:
    """How much of each group sits in cells that also hold the other one."""
    z, p = F.col("n_zero"), F.col("n_pos")
    inside = lambda x, other, k: F.sum(F.when(other >= k, x).otherwise(0))
    share = lambda x, other, k: F.try_divide(100.0 * inside(x, other, k), F.sum(x))
    return cells.agg(
        F.count("*").alias("cells"),
        inside(z, p, 1).alias("zero_with_1_pos"),
        inside(p, z, 1).alias("pos_with_1_zero"),
        share(z, p, 1).alias("zero_with_1_pos_pct"),
        share(z, p, 10).alias("zero_with_10_pos_pct"),
        share(p, z, 1).alias("pos_with_1_zero_pct"),
        share(p, z, 10).alias("pos_with_10_zero_pct"),
        F.count_if((z > 0) & (p == 0)).alias("cells_zero_only"),
        F.count_if((p > 0) & (z == 0)).alias("cells_pos_only"),
        F.count_if((p > 0) & (z > 0)).alias("cells_both"),
    )


def dominant(df: DataFrame, of: list[str], category: str) -> DataFrame:
    """Most frequent category per group; equal counts go to the larger category."""
    counts = df.groupBy(*of, category).agg(F.count("*").alias("n"))
    return keep_first(counts, of, [F.desc("n"), F.desc(category)]).select(*of, category, "n")


def weighted_mean(value: Column, weight: Column) -> Column:
    ok = value.isNotNull() & (weight > 0)
    return F.try_divide(F.sum(F.when(ok, value * weight)), F.sum(F.when(ok, weight)))


def log_histogram(df: DataFrame, group: str, value: str, bins: int, top: Column) -> DataFrame:
    """Counts and densities on `bins` log-spaced bins over [1, top]; the last bin is closed."""
    width = F.log10(top) / F.lit(float(bins))
    df = df.withColumn("_w", width)
    at = F.least(F.floor(F.log10(F.col(value)) / F.col("_w")), F.lit(bins - 1)).cast("int")
    inside = df.where((F.col(value) >= 1) & (F.col(value) <= top))
    counts = inside.groupBy(group, at.alias("bin")).agg(F.count("*").alias("n"), F.max("_w").alias("_w"))
    total = F.sum("n").over(W.partitionBy(group))  # at most `bins` rows per group
    edge = lambda i: F.pow(F.lit(10.0), i * F.col("_w"))
    size = edge(F.col("bin") + 1) - edge(F.col("bin"))
    return counts.withColumn("density", F.try_divide(F.col("n"), total * size)).drop("_w")


def linear_histogram(df: DataFrame, group: str, value: str, bins: int, lo: Column, hi: Column) -> DataFrame:
    """Counts and densities on `bins` equal bins over [lo, hi] per group; the last bin is closed."""
    df = df.withColumn("_w", (hi - lo) / F.lit(float(bins)))
    at = F.least(F.floor(F.try_divide(F.col(value) - lo, F.col("_w"))), F.lit(bins - 1)).cast("int")
    counts = (
        df.where(F.col(value).isNotNull())
        .groupBy(group, at.alias("bin"))
        .agg(F.count("*").alias("n"), F.max("_w").alias("_w"))
    )
    total = F.sum("n").over(W.partitionBy(group))  # at most `bins` rows per group
    return counts.withColumn("density", F.try_divide(F.col("n"), total * F.col("_w"))).drop("_w")
