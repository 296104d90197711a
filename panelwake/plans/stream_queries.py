"""Queries that run a stream over the given files to its end and read what it wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwake.plans import standins as st
from panelwake.plans.registry import query
from panelwake.session import scratch_path
from panelwake.streaming import feeds


def ship_stream(spark, folder) -> DataFrame:
    """The table as a stream, whole in one batch: its files are not in order of time, so several batches
    would refuse rows as late."""
    schema = st.lineitem(spark, folder).schema
    raw = feeds.file_stream(spark, f"{folder.rstrip('/')}/lineitem.parquet", schema)
    return raw.withColumn("ts", feeds.event_time(F.col("l_shipdate")))


@query(
    "stream_dedupe",
    """SELECT l_returnflag, CAST(year(l_shipdate) AS INTEGER) AS year, CAST(count(*) AS BIGINT) AS rows, CAST(0 AS BIGINT) AS late_rows FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_returnflag FROM lineitem) GROUP BY ALL""",
)
def stream_dedupe(spark, folder):
    """Incremental ingest with one row per key, counted by source and year; rows the stream refused."""
    rows = ship_stream(spark, folder).select(*st.ROW_ID, "l_returnflag", "ts")
    landed, run = feeds.drain(feeds.dedupe(rows, "ts", [*st.ROW_ID, "l_returnflag"]), "dedupe")
    late = F.lit(feeds.dropped_late(run)).cast("long").alias("late_rows")
    return landed.groupBy("l_returnflag", F.year("l_shipdate").alias("year")).agg(F.count("*").alias("rows"), late)


SETTLED = 7  # days before the end of the stream after which results may still change


@query(
    "stream_assoc",
    st.with_base(
        """,
z AS (SELECT max(d) - 7 AS settled FROM li),
c AS (SELECT i.rid, i.d, count(e.rid) AS n FROM inc i LEFT JOIN evt e ON e.key = i.key AND e.d BETWEEN i.d - 30 AND i.d, z WHERE i.d <= settled GROUP BY i.rid, i.d)
SELECT CAST(year(d) AS INTEGER) AS year, CAST(count(*) AS BIGINT) AS incidents, CAST(sum(n) AS BIGINT) AS pairs, CAST(count(*) FILTER (n = 0) AS BIGINT) AS silent, CAST(0 AS BIGINT) AS late_rows FROM c GROUP BY 1"""
    ),
)
def stream_assoc(spark, folder):
    """Association of incidents with the events of the 30 days before, as a stream-stream join."""
    rows = ship_stream(spark, folder).withColumnRenamed("l_partkey", "key")
    side = lambda flag: rows.where(F.col("l_returnflag") == flag).select("key", "ts")
    landed, run = feeds.drain(feeds.associate(side("R"), side("N"), "key", "ts", 30), "assoc")
    late = F.lit(feeds.dropped_late(run)).cast("long").alias("late_rows")
    last = st.lineitem(spark, folder).agg(F.date_sub(F.to_date(F.max("l_shipdate")), SETTLED).alias("d"))
    per_day = (
        landed.where(F.col("day") <= last.scalar())
        .groupBy("key", "day")
        .agg(F.max("incidents").alias("incidents"), F.sum("events").alias("events"))
    )
    n = F.col("incidents")
    return per_day.groupBy(F.year("day").alias("year")).agg(
        F.sum(n).alias("incidents"),
        F.sum(n * F.col("events")).alias("pairs"),
        F.sum(F.when(F.col("events") == 0, n).otherwise(0)).alias("silent"),
        late,
    )


REPORT_DAYS = 60  # returned rows are reported this much later than they are shipped
DELAY_DAYS = 30
ASSOC_DELAY_DAYS = 2
REPORTED = f"CASE WHEN l_returnflag = 'R' THEN l_shipdate + INTERVAL {REPORT_DAYS} DAYS ELSE l_shipdate END"


def landings(rows: DataFrame, period: str, label: str):
    """Lands the rows of one period after another in one folder; yields the folder after each.

    Periods are calendar years, so there are as many as the table has years. The table is read once.
    """
    spark = rows.sparkSession
    parted, feed = scratch_path(spark, f"{label}-parts"), scratch_path(spark, f"{label}-feed")
    rows.write.partitionBy(period).parquet(parted)
    whole = spark.read.schema(rows.schema).parquet(parted)
    for p in sorted(r[period] for r in whole.select(period).distinct().collect()):
        whole.where(F.col(period) == p).drop(period).write.mode("append").parquet(feed)
        yield feed


@query(
    "stream_ingest_batches",
    f"""WITH li AS (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_returnflag, {REPORTED} AS reported FROM lineitem),
sent AS (SELECT *, year(reported) AS period FROM li UNION ALL SELECT *, year(reported) + 1 FROM li WHERE month(reported) = 12),
top AS (SELECT period, row_number() OVER (ORDER BY period) - 1 AS batch, max(max(l_shipdate)) OVER (ORDER BY period ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS mark FROM sent GROUP BY period),
judged AS (SELECT s.*, batch, coalesce(l_shipdate <= mark - INTERVAL {DELAY_DAYS} DAYS, false) AS is_late FROM sent s JOIN top USING (period)),
firsts AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_returnflag, is_late ORDER BY batch) AS nth FROM judged)
SELECT batch, CAST(count(*) AS BIGINT) AS landed, CAST(count(*) FILTER (NOT is_late AND nth = 1) AS BIGINT) AS taken, CAST(count(*) FILTER (NOT is_late AND nth > 1) AS BIGINT) AS repeated, CAST(count(*) FILTER (is_late) AS BIGINT) AS late_rows, min(CASE WHEN is_late THEN l_shipdate END)::DATE AS oldest_late FROM firsts GROUP BY batch""",
)
def stream_ingest_batches(spark, folder):
    """Yearly deliveries, each with the last month of the one before again, taken in one after another:
    rows taken, repeated and late per batch, and the oldest late row, from the side table."""
    key = [*st.ROW_ID, "l_returnflag"]
    once = st.lineitem(spark, folder).select(*key).distinct().withColumn("reported", F.expr(REPORTED))
    year = F.year("reported")
    periods = F.when(F.month("reported") == 12, F.array(year, year + 1)).otherwise(F.array(year))
    sent = once.withColumn("period", F.explode(periods)).drop("reported")
    intake = feeds.Intake(scratch_path(spark, "intake"), "ts", key, DELAY_DAYS)
    for feed in landings(sent, "period", "deliveries"):
        rows = feeds.file_stream(spark, feed, sent.drop("period").schema)
        rows = rows.withColumn("ts", feeds.event_time(F.col("l_shipdate")))
        intake.run(rows)
    late = intake.late(spark, rows.schema).groupBy("batch").agg(F.min(feeds.event_day(F.col("ts"))).alias("oldest_late"))
    return (
        intake.marks(spark)
        .join(late, "batch", "left")
        .select(
            "batch",
            F.col("rows").alias("landed"),
            "taken",
            (F.col("rows") - F.col("taken") - F.col("late")).alias("repeated"),
            F.col("late").alias("late_rows"),
            "oldest_late",
        )
    )


@query(
    "stream_assoc_batches",
    st.with_base(
        """,
z AS (SELECT max(d) - 7 AS settled, count(DISTINCT (year(d) - 1995) // 2) AS batches FROM (SELECT d FROM inc UNION ALL SELECT d FROM evt)),
c AS (SELECT i.rid, i.d, count(e.rid) AS n FROM inc i LEFT JOIN evt e ON e.key = i.key AND e.d BETWEEN i.d - 30 AND i.d, z WHERE i.d <= settled GROUP BY i.rid, i.d)
SELECT CAST(year(d) AS INTEGER) AS year, CAST(count(*) AS BIGINT) AS incidents, CAST(sum(n) AS BIGINT) AS pairs, CAST(count(*) FILTER (n = 0) AS BIGINT) AS silent, (SELECT batches FROM z) AS batches FROM c GROUP BY 1"""
    ),
)
def stream_assoc_batches(spark, folder):
    """The same association over landings of two years each, one run per landing, each from the
    days the one before kept: these are bounded by the look-back and the delay, and the results equal those of one batch."""
    rows = st.lineitem(spark, folder).where(F.col("l_returnflag").isin("R", "N"))
    rows = rows.select("l_partkey", "l_shipdate", "l_returnflag")
    rows = rows.withColumn("period", F.floor((F.year("l_shipdate") - 1995) / 2).cast("int"))
    assoc = feeds.Association(scratch_path(spark, "assoc"), "key", 30, ASSOC_DELAY_DAYS)
    count = lambda flag: (F.col("l_returnflag") == flag).cast("long")
    for feed in landings(rows, "period", "ships"):
        stream = feeds.file_stream(spark, feed, rows.drop("period").schema).select(
            F.col("l_partkey").alias("key"),
            F.to_date("l_shipdate").alias("day"),
            count("R").alias("incidents"),
            count("N").alias("events"),
        )
        assoc.run(stream)
    batches, late = assoc.marks(spark).where("rows > 0").agg(F.count("*"), F.sum("late")).first()
    if late:
        raise ValueError("landings are in order of time, and still rows were late")
    last = rows.agg(F.date_sub(F.to_date(F.max("l_shipdate")), SETTLED).alias("d"))
    n = F.col("incidents")
    per_day = assoc.found(stream).where(F.col("day") <= last.scalar())
    return per_day.groupBy(F.year("day").alias("year")).agg(
        F.sum(n).alias("incidents"),
        F.sum(n * F.col("events")).alias("pairs"),
        F.sum(F.when(F.col("events") == 0, n).otherwise(0)).alias("silent"),
        F.lit(batches).cast("long").alias("batches"),
    )
