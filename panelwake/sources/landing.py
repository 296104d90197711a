"""Reading landed files, assembling feeds, comparing snapshots."""

from __future__ import annotations

import json as jsonlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelwake.functions import text
from panelwake.functions.keys import is_blank, to_number


def read_table(
    spark: SparkSession,
    folder: str,
    name: str,
    columns: list[str] | None = None,
    where: Column | None = None,
) -> DataFrame:
    """Projected and filtered parquet scan; both reach the reader."""
    df = spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")
    if where is not None:
        df = df.where(where)
    return df.select(*columns) if columns else df


def read_landed(
    spark: SparkSession, path: str, schema: T.StructType, fmt: str = "json", **options
) -> DataFrame:
    """Landed files with a declared string schema; absent fields come out NULL."""
    return spark.read.format(fmt).schema(schema).options(**options).load(path)


def read_up_to(
    spark: SparkSession, path: str, period: str, last: int, columns: list[str]
) -> DataFrame:
    """Read periods up to a bound only; on a table partitioned by period the rest is not opened."""
    return spark.read.parquet(path).where(F.col(period) <= last).select(*columns)


def contains_any(c: Column, parts: list[str]) -> Column:
    """Case-insensitive substring whitelist."""
    out = F.lit(False)
    for p in parts:
        out = out | F.upper(c).contains(p.upper())
    return out


def half_open(c: Column, lo, hi=None) -> Column:
    """lo <= c < hi; no hi leaves the range open."""
    cond = c >= F.lit(lo)
    return cond if hi is None else cond & (c < F.lit(hi))


def part_number(c: Column, bounds: list[tuple]) -> Column:
    """Number of the half-open part a value falls in; NULL outside all of them."""
    out = None
    for i, (lo, hi) in enumerate(bounds, start=1):
        cond = half_open(c, lo, hi)
        out = F.when(cond, i) if out is None else out.when(cond, i)
    return out


def parts_report(df: DataFrame, on: Column, bounds: list[tuple], key: list[str]) -> DataFrame:
    """Rows per part, part NULL for rows no part takes, and keys found in more than one part."""
    tagged = df.select(part_number(on, bounds).alias("part"), *key)
    per_key = tagged.groupBy(*key, "part").agg(F.count("*").alias("n"))
    spread = per_key.groupBy(*key).agg(
        F.count("*").alias("parts"), F.min("part").alias("first_part")
    )
    rows = per_key.groupBy("part").agg(F.sum("n").alias("rows"))
    crossing = (
        spread.where(F.col("parts") > 1)
        .groupBy(F.col("first_part").alias("part"))
        .agg(F.count("*").alias("crossing_keys"))
    )
    same = rows["part"].eqNullSafe(crossing["part"])
    return rows.join(crossing, same, "left").select(
        rows["part"], "rows", F.coalesce("crossing_keys", F.lit(0)).alias("crossing_keys")
    )


def write_parts(df: DataFrame, on: Column, bounds: list[tuple], path: str) -> None:
    """Land a feed as one folder per part."""
    df.withColumn("part", part_number(on, bounds)).write.mode("overwrite").partitionBy(
        "part"
    ).parquet(path)


def feed_union(feeds: list[DataFrame], key: list[str], order: list[Column]) -> DataFrame:
    """Union of feeds in priority order, first row per key kept."""
    from panelwake.operators.dedupe import keep_first

    tagged = None
    for rank, feed in enumerate(feeds):
        part = feed.withColumn("_feed", F.lit(rank))
        tagged = part if tagged is None else tagged.unionByName(part, allowMissingColumns=True)
    return keep_first(tagged, key, [F.col("_feed").asc(), *order])


def union_report(feeds: list[DataFrame], key: list[str], entity: str) -> DataFrame:
    """One row: rows before and after the union, surplus removed, rows without an entity key.

    Works on counts per key, so copies of one key never meet in one task.
    """
    tagged = None
    for rank, feed in enumerate(feeds):
        part = feed.select(*key, entity, F.lit(rank).alias("_feed"))
        tagged = part if tagged is None else tagged.unionByName(part)
    pick = F.min(F.struct("_feed", F.col(entity).cast("string").alias("e"))).getField("e")
    kept = tagged.groupBy(*key).agg(F.count("*").alias("n"), pick.alias("e"))
    return kept.agg(
        F.sum("n").alias("rows_before"),
        F.sum(F.col("n") - 1).alias("surplus_removed"),
        F.count("*").alias("rows_after"),
        F.count_if(is_blank("e")).alias("blank_entity"),
    )


def daily_counts(df: DataFrame, ts: Column, lo=None, hi=None, name: str = "n") -> DataFrame:
    """Rows per calendar day inside [lo, hi]."""
    day = F.to_date(ts)
    cond = F.lit(True)
    if lo is not None:
        cond = cond & (ts >= F.lit(lo))
    if hi is not None:
        cond = cond & (day <= F.lit(hi))
    return df.where(cond).groupBy(day.alias("day")).agg(F.count("*").alias(name))


def snapshot_daily(old: DataFrame, new: DataFrame, ts: str, days: int = 13) -> DataFrame:
    """Old and new counts per day from `days` days before the old snapshot's last day."""
    edge = old.agg(F.date_sub(F.to_date(F.max(ts)), days).alias("edge"))
    counts = lambda df, name: (
        df.where(F.to_date(ts) >= edge.scalar())
        .groupBy(F.to_date(ts).alias("day"))
        .agg(F.count("*").alias(name))
    )
    return (
        counts(old, "old_rows")
        .join(counts(new, "new_rows"), "day", "full_outer")
        .na.fill(0, ["old_rows", "new_rows"])
    )


def snapshot_diff(old: DataFrame, new: DataFrame, key: list[str], ts: str) -> DataFrame:
    """One row: keys that arrived late, keys that disappeared, size of the old snapshot, verdict."""
    last = old.agg(F.to_date(F.max(ts)).alias("last"))
    merged = (
        old.select(*key, ts, F.lit(1).alias("o"), F.lit(0).alias("n"))
        .unionByName(new.select(*key, ts, F.lit(0).alias("o"), F.lit(1).alias("n")))
        .groupBy(*key)
        .agg(
            F.sum("o").alias("o"),
            F.max("n").alias("n"),
            F.min(F.when(F.col("n") == 1, F.to_date(ts))).alias("day"),
        )
    )
    late = (F.col("n") == 1) & (F.col("o") == 0) & (F.col("day") <= last.scalar())
    gone = (F.col("o") > 0) & (F.col("n") == 0)
    out = merged.agg(
        F.count_if(late).alias("late_arrivals"),
        F.count_if(gone).alias("disappeared"),
        F.sum("o").alias("old_rows"),
    )
    stop = F.col("disappeared") > 0.01 * F.col("old_rows")
    return out.withColumn("verdict", F.when(stop, "STOP").otherwise("OK"))


def pre_counts(df: DataFrame, keys: list[Column]) -> DataFrame:
    """Counts per key combination: the compact table later steps use instead of the rows."""
    return df.groupBy(*keys).agg(F.count("*").alias("n"))


def rows_from_arrays(
    docs: DataFrame,
    body: str,
    columns: dict[str, str],
    keep: list[str] = (),
    numbers: list[str] = (),
    pad: dict[str, int] | None = None,
) -> DataFrame:
    """Documents holding [[header...], [row...], ...] as one table.

    `columns` maps header names to output names. Header positions are looked up per document, so
    files may differ in column order. Negative numbers are placeholders and become NULL.
    """
    rows = F.from_json(F.col(body), "array<array<string>>")
    lines = docs.select(*keep, rows.alias("_all")).select(
        *keep,
        F.element_at("_all", 1).alias("_head"),
        F.posexplode(F.slice("_all", F.lit(2), F.greatest(F.size("_all") - 1, F.lit(0)))).alias(
            "row_no", "_row"
        ),
    )
    cell = lambda name: F.try_element_at(
        F.col("_row"), F.array_position(F.col("_head"), name).cast("int")
    )
    at = lambda name: F.when(F.array_position(F.col("_head"), name) > 0, cell(name))
    out = []
    for source, target in columns.items():
        c = at(source)
        if source in numbers:
            n = to_number(c)
            c = F.when(n >= 0, n)
        elif pad and source in pad:
            c = F.lpad(c, pad[source], "0")
        out.append(c.alias(target))
    return lines.select(*keep, "row_no", *out)


def listing_lines(docs: DataFrame, body: str, keep: list[str]) -> DataFrame:
    """Lines of listing texts with the six captured fields and a kind: row, header, residue."""
    line = F.trim(F.col("_line"))
    lines = docs.select(
        *keep, F.posexplode(F.split(F.col(body), r"\r\n|\r|\n")).alias("line_no", "_line")
    ).select(*keep, "line_no", line.alias("line"))
    lines = lines.where(F.col("line") != "")
    header = F.lit(False)
    for word in text.LISTING_HEADERS:
        header = header | F.upper("line").contains(word)
    header = header | F.col("line").rlike(text.PAGE_COUNTER)
    is_row = F.col("line").rlike(text.LISTING_LINE)
    field = lambda i: F.when(
        F.col("kind") == "row", F.regexp_extract("line", text.LISTING_LINE, i)
    )
    return lines.withColumn(
        "kind", F.when(is_row, "row").when(header, "header").otherwise("residue")
    ).select(
        *keep,
        "line_no",
        "line",
        "kind",
        field(1).alias("boro"),
        field(2).alias("house_number"),
        F.upper(text.collapse_spaces(field(3))).alias("street"),
        field(6).cast("int").alias("units"),
    )


def profile(df: DataFrame, ts: str, nullable: list[str], key: list[str]) -> DataFrame:
    """One row: rows, first and last time, blanks per column, distinct keys."""
    return df.agg(
        F.count("*").alias("rows"),
        F.min(ts).alias("first_ts"),
        F.max(ts).alias("last_ts"),
        *[F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in nullable],
        F.count_distinct(*[F.col(k) for k in key]).alias("distinct_keys"),
    )


def write_sorted(df: DataFrame, path: str, order: list[str], partitions: int | None = None) -> None:
    """Deterministic deliverable: rows in key order across and inside the files."""
    cols = [F.col(c) for c in order]
    ranged = df.repartitionByRange(partitions, *cols) if partitions else df.repartitionByRange(*cols)
    ranged.sortWithinPartitions(*cols).write.mode("overwrite").parquet(path)


def write_metrics(metrics: DataFrame, path: str) -> None:
    metrics.write.mode("overwrite").json(path)


def append_audit(
    spark: SparkSession, path: str, site: str, touched: list[int], allowed: list[int]
) -> None:
    """One audit line per guard call."""
    row = [(site, sorted(touched), sorted(allowed))]
    spark.createDataFrame(row, "site string, touched array<int>, allowed array<int>").write.mode(
        "append"
    ).json(path)


def markdown_table(df: DataFrame) -> str:
    """A small result as a markdown table."""
    rows = [list(r) for r in df.collect()]
    fmt = lambda v: "—" if v is None else (f"{v:,.4f}" if isinstance(v, float) else str(v))
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join(fmt(v) for v in r) + " |" for r in rows])


def save_config(spark: SparkSession, path: str, config: dict) -> None:
    """Model configuration next to the saved weights."""
    spark.createDataFrame([(jsonlib.dumps(config, sort_keys=True),)], "config string").write.mode(
        "overwrite"
    ).parquet(path)


def load_config(spark: SparkSession, path: str) -> dict:
    return jsonlib.loads(spark.read.parquet(path).first()["config"])


def write_predictions(scored: DataFrame, path: str, season: str, label: str) -> None:
    """Scores at entity-season grain, every row labelled with the status of the run."""
    scored.withColumn("run_label", F.lit(label)).write.mode("overwrite").partitionBy(season).parquet(
        path
    )
