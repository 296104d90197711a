"""Matching records across sources by key, and membership lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwake.operators.dedupe import keep_first


def unambiguous(df: DataFrame, key: str, value: str) -> DataFrame:
    """Keys with exactly one row, as a resolver from key to value."""
    return (
        df.groupBy(key)
        .agg(F.count("*").alias("_n"), F.min(value).alias(value))
        .where(F.col("_n") == 1)
        .drop("_n")
    )


def resolve(records: DataFrame, resolver: DataFrame, key: str, official: str, found: str) -> DataFrame:
    """Add the resolved id, and the final id: the official one, else the resolved one."""
    out = records.join(resolver, key, "left")
    return out.withColumn("final_id", F.coalesce(official, found))


def agreement(resolved: DataFrame, official: str, found: str) -> DataFrame:
    """How often the resolver finds something and agrees with the official id."""
    both = F.col(official).isNotNull() & F.col(found).isNotNull()
    return resolved.agg(
        F.count("*").alias("records"),
        F.count(found).alias("resolved"),
        F.count(official).alias("official"),
        F.count_if(both).alias("both"),
        F.count_if(both & (F.col(official) == F.col(found))).alias("agree"),
        F.count_if(both & (F.col(official) != F.col(found))).alias("disagree"),
        F.count_if(F.col("final_id").isNull()).alias("unresolved"),
    )


def reconcile(left: DataFrame, right: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """Keys matched, only left and only right, per group.

    Both sides go through one aggregate on the key instead of a join.
    """
    marked = left.select(*keys, F.lit(1).alias("l"), F.lit(0).alias("r")).unionByName(
        right.select(*keys, F.lit(0).alias("l"), F.lit(1).alias("r"))
    )
    per_key = marked.groupBy(*keys).agg(F.max("l").alias("l"), F.max("r").alias("r"))
    return per_key.groupBy(*by).agg(
        F.count_if((F.col("l") == 1) & (F.col("r") == 1)).alias("matched"),
        F.count_if(F.col("r") == 0).alias("only_left"),
        F.count_if(F.col("l") == 0).alias("only_right"),
    )


def latest(df: DataFrame, key: str, when: str, number: str) -> DataFrame:
    """Latest row per key; equal times go to the larger number, missing times come last."""
    return keep_first(df, [key], [F.desc_nulls_last(when), F.desc_nulls_last(number)])


def best_contact(df: DataFrame, key: str, priority: Column, value: str) -> DataFrame:
    """Value of the best contact per key: smallest priority, then smallest value."""
    usable = df.where(F.col(value).isNotNull() & priority.isNotNull())
    return usable.groupBy(key).agg(F.min(F.struct(priority.alias("p"), F.col(value).alias("v"))).alias("b")).select(
        key, F.col("b.v").alias(value)
    )


def owner_of(registrations: DataFrame, contacts: DataFrame, entity: str, reg: str, value: str) -> DataFrame:
    """Owner per entity: one registration per entity, one contact per registration."""
    return registrations.select(entity, reg).join(contacts.select(reg, value), reg, "left").drop(reg)


def membership(rows: DataFrame, key: str, start: str, cohort: str) -> DataFrame:
    """Earliest start and the sorted list of cohorts per member."""
    per_cohort = rows.groupBy(key, cohort).agg(F.min(start).alias(start))
    return per_cohort.groupBy(key).agg(
        F.min(start).alias("first_start"),
        F.array_sort(F.collect_set(cohort)).alias("cohorts"),  # distinct cohorts only
        F.min(cohort).alias("first_cohort"),
    )
