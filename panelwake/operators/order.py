"""Ranks, prefix sums and quantiles over a whole table without one giant task."""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelwake.session import durable

LEAST_SALTS = 64


def salts(spark: SparkSession) -> int:
    """Parts a heavy key is spread over; a key is heavy when it holds more than one such part of all
    rows. There are as many as shuffle tasks, so no key makes a task much longer than the others."""
    return max(LEAST_SALTS, int(spark.conf.get("spark.sql.shuffle.partitions")))


def join_groups(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on keys of which NULL is a value like any other; the left side's keys stay."""
    if not keys:
        return left.crossJoin(right)  # one group: `right` is its single row
    other = right.select(*[F.col(c).alias(f"_r_{c}") if c in keys else F.col(c) for c in right.columns])
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_r_{k}"))
    return left.join(other, same, how).drop(*[f"_r_{k}" for k in keys])


def split_points(df: DataFrame, value: str, slices: int | None = None) -> list[float]:
    """Values that cut a column into slices of about equal row counts, one slice per shuffle task.

    Only the balance of the work depends on them; results do not.
    """
    if slices is None:
        slices = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    probs = [i / slices for i in range(1, slices)]
    return sorted(set(df.approxQuantile(value, probs, 1.0 / (4 * slices))))


def with_slice(df: DataFrame, value: str, splits: list[float]) -> DataFrame:
    """Slice number of a value; a pure function of the value, so any retry gives the same slice."""
    if not splits:
        return df.withColumn("_slice", F.lit(0))
    edges = [float("-inf"), *splits, float("inf")]
    cut = Bucketizer(splits=edges, inputCol=value, outputCol="_slice", handleInvalid="keep")
    out = cut.transform(df)
    return out.withColumn("_slice", F.col("_slice").cast("int"))


def prefix_sums(
    df: DataFrame,
    groups: list[str],
    value: str,
    sums: list[str],
    splits: list[float],
    descending: bool = False,
) -> DataFrame:
    """Running totals per group in value order, this value included; totals as all_<name>.

    Rows without a value have no place in the order: they are left out of running and whole totals,
    however many slices there are. NULL is a group like any other.

    `df` has one row per (group, value). Rows are cut into slices by value; running sums inside a
    slice are shifted by the totals of the slices before it. A task sees one slice of one group. The
    slice totals have at most groups x slices rows.
    """
    sliced = with_slice(df.where(F.col(value).isNotNull()), value, splits)
    order = F.desc if descending else F.asc
    totals = sliced.groupBy(*groups, "_slice").agg(*[F.sum(s).alias(s) for s in sums])
    in_order = W.partitionBy(*groups).orderBy(order("_slice"))
    before = totals.select(
        *groups,
        "_slice",
        *[
            F.coalesce(
                F.sum(s).over(in_order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)
            ).alias(f"_before_{s}")
            for s in sums
        ],
        *[F.sum(s).over(W.partitionBy(*groups)).alias(f"all_{s}") for s in sums],
    )
    inside = W.partitionBy(*groups, "_slice").orderBy(order(value)).rowsBetween(
        W.unboundedPreceding, 0
    )
    local = sliced.withColumns({f"_cum_{s}": F.sum(s).over(inside) for s in sums})
    joined = join_groups(local, before, [*groups, "_slice"])
    out = joined.withColumns({f"cum_{s}": F.col(f"_cum_{s}") + F.col(f"_before_{s}") for s in sums})
    return out.drop("_slice", *[f"_cum_{s}" for s in sums], *[f"_before_{s}" for s in sums])


def row_numbers(df: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """Row number 1..N in a total order over the whole table, and N as all_rows.

    Range partitioning on the full order spreads ties too. The position inside a slice comes from
    the sort; the kept copy makes slice numbers facts that a retry cannot change.
    """
    sid = F.monotonically_increasing_id()
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", sid)
    kept = durable(ranged).withColumns(
        {
            "_slice": F.shiftright("_id", 33),
            "_at": F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)),
        }
    )
    sizes = kept.groupBy("_slice").agg(F.count("*").alias("_size"))
    starts = sizes.select(
        "_slice",
        (F.sum("_size").over(W.orderBy("_slice")) - F.col("_size")).alias("_start"),
        F.sum("_size").over(W.partitionBy()).alias("all_rows"),
    )
    out = kept.join(F.broadcast(starts), "_slice")  # one row per slice
    return out.withColumn(name, F.col("_start") + F.col("_at") + 1).drop(
        "_id", "_slice", "_at", "_start", "_size"
    )


def tercile(rank: Column, n: Column) -> Column:
    """Third of a 1-based rank; cuts at 1 + (n - 1) k / 3, upper edge included."""
    return (
        F.when(3 * (rank - 1) <= n - 1, 1).when(3 * (rank - 1) <= 2 * (n - 1), 2).otherwise(3)
    )


def quantiles(
    df: DataFrame, groups: list[str], value: str, probs: list[float], splits: list[float] | None = None
) -> DataFrame:
    """Exact linear-interpolation quantiles per group as columns q0, q1, ...

    Value counts, then prefix sums, then the two order statistics around each position: no task
    holds a whole group.
    """
    if splits is None:
        splits = split_points(df.where(F.col(value).isNotNull()), value)
    counts = (
        df.where(F.col(value).isNotNull()).groupBy(*groups, value).agg(F.count("*").alias("n"))
    )
    ranked = prefix_sums(counts, groups, value, ["n"], splits)
    first, last = F.col("cum_n") - F.col("n"), F.col("cum_n") - 1  # 0-based positions held
    aggs = []
    for i, p in enumerate(probs):
        pos = (F.col("all_n") - 1) * F.lit(float(p))
        lo, hi = F.floor(pos), F.ceil(pos)
        at = lambda k: F.min(F.when((first <= k) & (last >= k), F.col(value)))
        aggs += [at(lo).alias(f"_lo{i}"), at(hi).alias(f"_hi{i}")]
    out = ranked.groupBy(*groups).agg(F.max("all_n").alias("n"), *aggs)
    for i, p in enumerate(probs):
        pos = (F.col("n") - 1) * F.lit(float(p))
        frac = pos - F.floor(pos)
        out = out.withColumn(
            f"q{i}", F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * frac
        )
    return out.drop(*[f"_{s}{i}" for s in ("lo", "hi") for i in range(len(probs))])


def lookup_skewed(
    left: DataFrame, right: DataFrame, keys: list[str], weight: Column, rows: int, spread_on: Column
) -> DataFrame:
    """Left lookup in a table with one row per key, with busy keys spread over salts.

    `weight` is the number of left rows with a key of `right`, `rows` that of all of them. Keys that hold
    more than one salt's share are heavy; by counting there are at most as many heavy keys as salts,
    which is what makes their broadcast safe. Rows of a heavy key, and rows without a key, get a salt
    from `spread_on`; the heavy rows of `right` are copied once per salt.
    """
    parts = salts(left.sparkSession)
    heavy = F.coalesce(weight * parts > rows, F.lit(False))
    hot = right.where(heavy).select(*keys, F.lit(True).alias("_hot"))
    no_key = F.lit(False)
    for k in keys:
        no_key = no_key | F.col(k).isNull()
    salt = F.pmod(F.xxhash64(spread_on), F.lit(parts)).cast("int")
    tagged = left.join(F.broadcast(hot), keys, "left").withColumn(
        "_salt", F.when(F.col("_hot") | no_key, salt).otherwise(0)
    )
    copies = F.when(heavy, F.sequence(F.lit(0), F.lit(parts - 1))).otherwise(F.array(F.lit(0)))
    spread = right.withColumn("_salt", F.explode(copies))
    return tagged.drop("_hot").join(spread, [*keys, "_salt"], "left").drop("_salt")


BROADCAST_ROWS = 100_000


def join_small(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join with a durable side that is broadcast if it is counted to be small, else shuffled.

    NULL is a key like any other."""
    small = right.count() <= BROADCAST_ROWS
    return join_groups(left, F.broadcast(right) if small else right, keys)
