"""Ordered exclusions where every lost row is counted once, at the first step that rejects it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwake.sources.contracts import ContractError

Step = tuple[str, Column]
KEPT = "kept"


def tag_reason(df: DataFrame, steps: Sequence[Step], column: str = "reason") -> DataFrame:
    """Name of the first step whose condition holds, NULL for survivors. Order matters."""
    reason = None
    for name, rejects in steps:
        hit = F.coalesce(rejects, F.lit(False))
        reason = F.when(hit, name) if reason is None else reason.when(hit, name)
    return df.withColumn(column, reason)


def survivors(df: DataFrame, steps: Sequence[Step]) -> DataFrame:
    return tag_reason(df, steps, "_reason").where(F.col("_reason").isNull()).drop("_reason")


def waterfall_counts(
    df: DataFrame, steps: Sequence[Step], weight: Column | None = None
) -> DataFrame:
    """Rows lost per step in step order, then the rows kept; steps that reject nothing show 0.

    All steps are counted in one aggregate, which is then turned into rows.
    """
    w = F.lit(1) if weight is None else weight
    names = [name for name, _ in steps] + [KEPT]
    tagged = tag_reason(df.withColumn("_w", w), steps).withColumn(
        "reason", F.coalesce("reason", F.lit(KEPT))
    )
    one_row = tagged.agg(
        *[
            F.coalesce(F.sum(F.when(F.col("reason") == n, F.col("_w"))), F.lit(0)).alias(f"c{i}")
            for i, n in enumerate(names)
        ]
    )
    return one_row.select(
        F.explode(
            F.array(
                *[
                    F.struct(
                        F.lit(i).alias("step"),
                        F.lit(n).alias("reason"),
                        F.col(f"c{i}").cast("long").alias("rows"),
                    )
                    for i, n in enumerate(names)
                ]
            )
        ).alias("x")
    ).select("x.*")


def trailing_slice(df: DataFrame, column: str, lo, hi, cutoff) -> DataFrame:
    """Events in [lo, hi). A window that reaches past the cutoff is refused before anything runs."""
    if hi > cutoff:
        raise ContractError(f"window end {hi} is after the cutoff {cutoff}")
    if lo >= hi:
        raise ContractError(f"empty window [{lo}, {hi})")
    return df.where((F.col(column) >= F.lit(lo)) & (F.col(column) < F.lit(hi)))


def guard_periods(
    df: DataFrame, period: str, site: str, allowed: Sequence[int], first_forbidden: int
) -> list[int]:
    """Periods a job touches must be allowed and before the forbidden one; returns them."""
    touched = sorted(r[0] for r in df.select(period).distinct().collect() if r[0] is not None)
    wrong = [p for p in touched if p not in set(allowed) or p >= first_forbidden]
    if wrong:
        raise ContractError(f"{site} touches periods {wrong}")
    return touched


def latest_before(df: DataFrame, ts: str, cutoff) -> None:
    """The data itself, not the request, must end before the cutoff."""
    last = df.agg(F.max(ts)).first()[0]
    if last is not None and last >= cutoff:
        raise ContractError(f"latest row {last} is not before {cutoff}")
