"""One row per key, copies and conflicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def keep_first(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """First row per key in a stated order.

    The filter on row_number() lets Spark cut every map task's output to one row per key before
    the shuffle, so a key with very many copies does not fill one task.
    """
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).drop("_rn")


def copies(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows collapsed on their identity with the number of copies."""
    return df.groupBy(*keys).agg(F.count("*").alias("copies"))


def shared_keys(df: DataFrame, key: str, member: list[str]) -> DataFrame:
    """Members of keys that hold more than one row."""
    n = df.groupBy(key).agg(F.count("*").alias("rows_on_key")).where(F.col("rows_on_key") > 1)
    return df.select(key, *member).join(n, key)


def single_valued(df: DataFrame, key: str, value: str) -> DataFrame:
    """Keys with one distinct value, and that value; conflicting keys are left out.

    min = max says 'one distinct value' without collecting the values.
    """
    return (
        df.where(F.col(key).isNotNull() & F.col(value).isNotNull())
        .groupBy(key)
        .agg(F.min(value).alias(value), F.max(value).alias("_max"))
        .where(F.col(value) == F.col("_max"))
        .drop("_max")
    )


def conflicts(df: DataFrame, key: str, value: str) -> DataFrame:
    """One row: keys seen, keys with conflicting values, keys usable, rows without key or value."""
    usable = F.col(key).isNotNull() & F.col(value).isNotNull()
    per_key = (
        df.groupBy(key)
        .agg(
            F.count_if(~usable).alias("unusable"),
            F.min(F.when(usable, F.col(value))).alias("lo"),
            F.max(F.when(usable, F.col(value))).alias("hi"),
        )
    )
    return per_key.agg(
        F.count_if(F.col("lo").isNotNull()).alias("keys"),
        F.count_if(F.col("lo") != F.col("hi")).alias("conflicting_keys"),
        F.count_if(F.col("lo") == F.col("hi")).alias("usable_keys"),
        F.coalesce(F.sum("unusable"), F.lit(0)).alias("unusable_rows"),
    )
