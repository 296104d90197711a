"""Checks that stop a run: schema, emptiness, counts, fingerprints, closed domains."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class ContractError(RuntimeError):
    """A table is not what the job was told to expect."""


def require_columns(df: DataFrame, declared: Iterable[str], exact: bool = False) -> DataFrame:
    """Stop on columns outside the declared list; with exact, order and set must agree."""
    declared = list(declared)
    extra = [c for c in df.columns if c not in declared]
    if extra:
        raise ContractError(f"undeclared columns: {extra}")
    if exact and df.columns != declared:
        raise ContractError(f"columns {df.columns} are not {declared}")
    return df


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Declared columns in declared order; missing ones are NULL."""
    require_columns(df, schema.names)
    return df.select(
        *[
            (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in schema
        ]
    )


def require_rows(df: DataFrame, what: str) -> DataFrame:
    if df.isEmpty():
        raise ContractError(f"{what} is empty")
    return df


def require_zero(counts: DataFrame, what: str) -> None:
    """All cells of a one-row count table must be 0."""
    row = counts.first().asDict()
    bad = {k: v for k, v in row.items() if v}
    if bad:
        raise ContractError(f"{what}: {bad}")


def require_domain(df: DataFrame, column: str, allowed: Iterable) -> None:
    """Every value of a flag column must be listed; NULL is not."""
    allowed = list(allowed)
    outside = F.col(column).isNull() | ~F.col(column).isin(*allowed)
    require_zero(df.agg(F.count_if(outside).alias(column)), f"values of {column} outside {allowed}")


def require_lossless(df: DataFrame, casts: dict[str, Column]) -> None:
    """A cast must not turn a present value into NULL."""
    require_zero(
        df.agg(
            *[
                F.count_if(F.col(c).isNotNull() & typed.isNull()).alias(c)
                for c, typed in casts.items()
            ]
        ),
        "values lost by casting",
    )


def require_vocabulary(df: DataFrame, column: str, vocabulary: DataFrame) -> None:
    """Every present value must be in a one-column vocabulary table."""
    values = df.select(column).where(F.col(column).isNotNull()).distinct()
    novel = values.join(vocabulary.toDF(column), column, "left_anti")
    require_zero(novel.agg(F.count("*").alias(column)), "values outside the vocabulary")


def frame_invariants(
    df: DataFrame, keys: list[str], never_null: list[str], period: str
) -> DataFrame:
    """One row: rows, repeated keys, NULLs in columns that must be filled, last period."""
    per_key = df.groupBy(*keys).agg(
        F.count("*").alias("n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in never_null]
    )
    return per_key.agg(
        F.sum("n").alias("rows"),
        F.sum(F.col("n") - 1).alias("repeated_keys"),
        *[F.sum(c).alias(f"null_{c}") for c in never_null],
        F.max(period).alias("last_period"),
    )


def require_invariants(
    df: DataFrame, keys: list[str], never_null: list[str], period: str, last: int, rows: int
) -> None:
    got = frame_invariants(df, keys, never_null, period).first().asDict()
    nulls = sum(got[f"null_{c}"] or 0 for c in never_null)
    if got["rows"] != rows or got["repeated_keys"] or nulls or got["last_period"] > last:
        raise ContractError(f"frame invariants broken: {got}")


def fingerprint(df: DataFrame) -> DataFrame:
    """Order-free content fingerprint of a table; one row.

    A row's text lists its columns in name order, each value marked as present or NULL, so NULLs and
    values that move between columns are seen. Its hash is the first 60 bits of an MD5; sums cannot
    overflow below 10^20 rows.
    """
    marked = [F.coalesce(F.concat(F.lit("v"), F.col(f"`{c}`").cast("string")), F.lit("n")) for c in sorted(df.columns)]
    row = F.md5(F.concat_ws("\x1f", *marked).cast("binary"))
    h = F.conv(F.substring(row, 1, 15), 16, 10).cast("long")
    return df.select(h.alias("h")).agg(
        F.count("*").alias("rows"),
        F.coalesce(F.bit_xor("h"), F.lit(0)).alias("xor_hash"),
        F.coalesce(F.sum(F.col("h").cast("decimal(28,0)")), F.lit(0)).cast("string").alias("sum_hash"),
    )


def require_fingerprint(df: DataFrame, pinned: dict) -> None:
    got = fingerprint(df).first().asDict()
    if got != pinned:
        raise ContractError(f"fingerprint {got} is not {pinned}")


def fingerprints(tables: dict[str, DataFrame]) -> DataFrame:
    """One fingerprint row per table."""
    out = None
    for name, df in tables.items():
        row = fingerprint(df).select(F.lit(name).alias("table"), "rows", "xor_hash", "sum_hash")
        out = row if out is None else out.unionByName(row)
    return out


def changed_tables(before: DataFrame, after: DataFrame) -> DataFrame:
    """Tables whose fingerprint moved between two snapshots, or that exist in one only."""
    a, b = before.alias("a"), after.alias("b")
    same = (
        F.col("a.rows").eqNullSafe(F.col("b.rows"))
        & F.col("a.xor_hash").eqNullSafe(F.col("b.xor_hash"))
        & F.col("a.sum_hash").eqNullSafe(F.col("b.sum_hash"))
    )
    joined = a.join(b, F.col("a.table") == F.col("b.table"), "full_outer")
    return joined.where(~same).select(F.coalesce("a.table", "b.table").alias("table"))


def compare_counts(
    found: DataFrame, expected: DataFrame, keys: list[str], values: list[str]
) -> DataFrame:
    """Expected against found counts per key, with a match flag; missing sides count 0."""
    left = found.select(*keys, *[F.col(v).alias(f"found_{v}") for v in values])
    right = expected.select(*keys, *[F.col(v).alias(f"expected_{v}") for v in values])
    out = left.join(right, keys, "full_outer").na.fill(
        0, [f"{side}_{v}" for side in ("found", "expected") for v in values]
    )
    match = F.lit(True)
    for v in values:
        match = match & (F.col(f"found_{v}") == F.col(f"expected_{v}"))
    return out.withColumn("match", match)


def require_counts(
    found: DataFrame, expected: DataFrame, keys: list[str], values: list[str]
) -> None:
    bad = compare_counts(found, expected, keys, values).where(~F.col("match"))
    wrong = [r.asDict() for r in bad.limit(20).collect()]
    if wrong:
        raise ContractError(f"counts differ from expected: {wrong}")


def repeated_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row: surplus rows on a key that should be unique."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).agg(
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("surplus_rows"),
        F.count_if(F.col("n") > 1).alias("repeated_keys"),
    )


def alignment(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Keys missing on either side; both sides must hold every key once."""
    a = left.groupBy(*keys).agg(F.count("*").alias("n_left"))
    b = right.groupBy(*keys).agg(F.count("*").alias("n_right"))
    return (
        a.join(b, keys, "full_outer")
        .na.fill(0, ["n_left", "n_right"])
        .agg(
            F.count("*").alias("keys"),
            F.count_if(F.col("n_right") == 0).alias("only_left"),
            F.count_if(F.col("n_left") == 0).alias("only_right"),
            F.count_if((F.col("n_left") > 1) | (F.col("n_right") > 1)).alias("repeated"),
        )
    )
