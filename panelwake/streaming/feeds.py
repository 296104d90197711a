"""Incremental ingest and association on Structured Streaming."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from panelwake.functions.calendar import epoch_micros
from panelwake.operators.dedupe import keep_first
from panelwake.session import scratch_path


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def file_stream(spark: SparkSession, path: str, schema: T.StructType, per_batch: int | None = None) -> DataFrame:
    """A parquet table, one file or a folder of part files, as a stream; `per_batch` files a batch."""
    reader = spark.readStream.schema(schema)
    if per_batch:
        reader = reader.option("maxFilesPerTrigger", per_batch)
    # a stream takes a plain path for a folder; as a pattern that fits itself alone it may be a file too
    path = path.rstrip("/")
    return reader.parquet(f"{path[:-1]}[{path[-1]}]")


def event_time(ts: Column) -> Column:
    """A zone-less time as an event time; its clock is read as UTC, whatever the session zone."""
    return F.timestamp_micros(epoch_micros(ts))


def event_day(t: Column) -> Column:
    """Calendar day of such an event time."""
    return F.date_from_unix_date(F.floor(F.unix_micros(t) / 86400000000).cast("int"))


def dedupe(stream: DataFrame, ts: str, key: list[str], delay: str = "2 days") -> DataFrame:
    """First arrival per key; keys are remembered until the watermark passes them."""
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark(key)


def associate(
    incidents: DataFrame, events: DataFrame, key: str, ts: str, days: int, delay: str = "2 days"
) -> DataFrame:
    """Incident days joined to event days in [day - W, day], with the number of pairs.

    Both sides are counted per (key, day) first, so a busy key enters the join with one row per day.
    Incident days without events come out once the watermark has passed them.
    """

    def daily(stream: DataFrame, name: str) -> DataFrame:
        counted = (
            stream.withWatermark(ts, delay)
            .groupBy(F.window(ts, "1 day").alias("w"), F.col(key).alias(f"{name}_key"))
            .agg(F.count("*").alias(f"{name}_n"))
        )
        # window_time keeps the watermark; it is the last microsecond of the day
        return counted.select(F.window_time("w").alias(f"{name}_t"), f"{name}_key", f"{name}_n")

    inc, evt = daily(incidents, "i"), daily(events, "e")
    # whole seconds, because adding an interval to a time follows the session zone's clock changes
    second = lambda c: F.col(c).cast("long")
    near = (
        (F.col("i_key") == F.col("e_key"))
        & (second("e_t") <= second("i_t"))
        & (second("e_t") >= second("i_t") - days * 86400)
    )
    return inc.join(evt, near, "left_outer").select(
        F.col("i_key").alias("key"),
        event_day(F.col("i_t")).alias("day"),
        F.col("i_n").alias("incidents"),
        F.coalesce("e_n", F.lit(0)).alias("events"),
    )


def advance(stream: DataFrame, out: str, state: str) -> StreamingQuery:
    """Process what has landed since the last run under the same state, and add the results to `out`.

    State is kept outside the heap, so it may outgrow an executor's memory.
    """
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    query = (
        stream.writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", state)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return query


def drain(stream: DataFrame, label: str) -> tuple[DataFrame, StreamingQuery]:
    """Process everything that is there now; what was written, and the query for its late rows."""
    spark = stream.sparkSession
    out, state = scratch_path(spark, f"{label}-out"), scratch_path(spark, f"{label}-state")
    query = advance(stream, out, state)
    return spark.read.schema(stream.schema).parquet(out), query


class Intake:
    """Incremental ingest that keeps what it refuses.

    Under `home`, one folder a batch: `taken` has the first row of each key, `late` the rows behind the
    mark of the batches before (with that limit), `marks` the batch's latest event time and its counts.
    A batch only reads what earlier batches wrote and replaces its own folders, so one that is run again
    after a failure, even half written, leaves the same result. Repeated keys are looked for among taken
    rows that are not yet behind the mark: what a batch reads back is bounded by the delay.

    NULL event times are never late and are taken once per key; NULL keys are keys.
    """

    TAKEN, LATE, MARKS = "taken", "late", "marks"
    MARK = "latest timestamp, rows long, taken long, late long"

    def __init__(self, home: str, ts: str, key: list[str], delay_days: int):
        self.home, self.ts, self.key, self.delay = home.rstrip("/"), ts, key, delay_days

    def run(self, stream: DataFrame) -> StreamingQuery:
        """One run over what has landed since the last one."""
        query = (
            stream.writeStream.foreachBatch(self.take)
            .option("checkpointLocation", f"{self.home}/state")
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
        return query

    def take(self, rows: DataFrame, batch: int) -> None:
        spark = rows.sparkSession
        # the rows come by a source that may be read again; they are read for the split and for the mark
        limit = F.lit(None).cast("timestamp")
        seen = None
        if batch > 0:
            before = self.marks(spark).where(F.col("batch") < batch).agg(F.max("latest").alias("m")).first()["m"]
            if before is not None:
                limit = F.lit(before) - F.make_dt_interval(F.lit(self.delay))
            near = F.col(self.ts).isNull() | F.coalesce(F.col(self.ts) > limit, F.lit(True))
            seen = self.taken(spark, rows.schema).where((F.col("batch") < batch) & near)
        behind = F.coalesce(F.col(self.ts) <= limit, F.lit(False))
        late = rows.where(behind).withColumn("limit", limit)
        fresh = keep_first(rows.where(~behind), self.key, [F.col(self.ts), F.xxhash64(*rows.columns)])
        if seen is not None:
            known = seen.select(*[F.col(c).alias(f"_{i}") for i, c in enumerate(self.key)])
            same = [F.col(c).eqNullSafe(F.col(f"_{i}")) for i, c in enumerate(self.key)]
            fresh = fresh.join(known, same, "left_anti")
        self._put(fresh, self.TAKEN, batch)
        self._put(late, self.LATE, batch)
        n = lambda name, schema: F.lit(
            spark.read.schema(schema).parquet(self._at(name, batch)).count()
        ).cast("long")
        mark = rows.agg(F.max(self.ts).cast("timestamp").alias("latest"), F.count("*").alias("rows"))
        counts = mark.select("latest", "rows", n(self.TAKEN, fresh.schema).alias("taken"), n(self.LATE, late.schema).alias("late"))
        self._put(counts, self.MARKS, batch)

    def _at(self, name: str, batch: int) -> str:
        return f"{self.home}/{name}/batch={batch}"

    def _put(self, df: DataFrame, name: str, batch: int) -> None:
        df.write.mode("overwrite").parquet(self._at(name, batch))

    def _read(self, spark: SparkSession, name: str, schema: T.StructType) -> DataFrame:
        return spark.read.schema(schema.add("batch", "long")).parquet(f"{self.home}/{name}")

    def taken(self, spark: SparkSession, schema: T.StructType) -> DataFrame:
        """Rows taken, with their batch."""
        return self._read(spark, self.TAKEN, T.StructType(list(schema.fields)))

    def late(self, spark: SparkSession, schema: T.StructType) -> DataFrame:
        """Rows refused as late, with the limit they missed and their batch."""
        return self._read(spark, self.LATE, T.StructType([*schema.fields, T.StructField("limit", T.TimestampType())]))

    def marks(self, spark: SparkSession) -> DataFrame:
        """Per batch: latest event time, rows seen, taken and late; the rest were repeated keys."""
        return self._read(spark, self.MARKS, T.StructType.fromDDL(self.MARK))


class Association:
    """Incremental association that keeps no more than the look-back and the delay.

    A stream has key, day, incidents and events (numbers of a row, 0 or more). Days more than `delay` days before
    the latest one are settled: their incidents come out with the number of events of their key in
    [day - W, day]. Under `home`, one folder a batch: `days` has the (key, day) rows that came out or are needed
    later, `marks` the batch's latest day and its counts. Rows of settled days are late: counted, not taken.
    A batch only reads its rows and the days of the batch before, and replaces its own folders, so one that is
    run again after a failure leaves the same result. Counts per (key, day) enter one window by key.

    NULL days take no part; incidents with a NULL key have no events.
    """

    DAYS, MARKS = "days", "marks"
    DAY = "day date, incidents long, events long, near long, settled boolean, open boolean"
    MARK = "latest date, rows long, late long"

    def __init__(self, home: str, key: str, days: int, delay_days: int):
        self.home, self.key, self.days, self.delay = home.rstrip("/"), key, days, delay_days

    def run(self, stream: DataFrame) -> StreamingQuery:
        """One run over what has landed since the last one."""
        query = (
            stream.writeStream.foreachBatch(self.take)
            .option("checkpointLocation", f"{self.home}/state")
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
        return query

    def take(self, rows: DataFrame, batch: int) -> None:
        spark, day = rows.sparkSession, F.col("day")
        rows = rows.select(self.key, "day", "incidents", "events").where(day.isNotNull())
        before = last = None
        if batch > 0:
            marks = self.marks(spark).where(F.col("batch") < batch)
            before, last = marks.agg(F.max("latest"), F.max("batch")).first()
        settled = lambda latest: day < F.date_sub(F.lit(latest), self.delay)
        late = F.lit(False) if before is None else settled(before)
        latest, n, n_late = rows.agg(F.max("day"), F.count("*"), F.count_if(late)).first()
        latest = max((d for d in (before, latest) if d is not None), default=None)
        fresh = rows.where(~late)
        if last is not None:
            held = self._read(spark, rows).where((F.col("batch") == last) & F.col("open"))
            fresh = fresh.unionByName(held.select(*rows.columns))
        counted = fresh.groupBy(self.key, "day").agg(*[F.sum(c).alias(c) for c in ("incidents", "events")])
        back = Window.partitionBy(self.key).orderBy(F.unix_date("day")).rangeBetween(-self.days, 0)
        near = F.when(F.col(self.key).isNull(), F.lit(0)).otherwise(F.sum("events").over(back))
        done = settled(latest)
        out = counted.select(
            *rows.columns,
            near.cast("long").alias("near"),
            (done & ~late & (F.col("incidents") > 0)).alias("settled"),
            (~F.coalesce(day < F.date_sub(F.lit(latest), self.delay + self.days), F.lit(False))).alias("open"),
        )
        self._put(out.where("settled OR open"), self.DAYS, batch)
        self._put(spark.createDataFrame([(latest, n, n_late)], self.MARK), self.MARKS, batch)

    def _put(self, df: DataFrame, name: str, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.home}/{name}/batch={batch}")

    def _read(self, spark: SparkSession, rows: DataFrame) -> DataFrame:
        schema = T.StructType([rows.schema[self.key], *T.StructType.fromDDL(self.DAY), T.StructField("batch", T.LongType())])
        return spark.read.schema(schema).parquet(f"{self.home}/{self.DAYS}")

    def found(self, stream: DataFrame) -> DataFrame:
        """Settled incident days (key, day, incidents, events), with their batch."""
        rows = self._read(stream.sparkSession, stream).where("settled")
        return rows.select(self.key, "day", "incidents", F.col("near").alias("events"), "batch")

    def marks(self, spark: SparkSession) -> DataFrame:
        """Per batch: latest day so far, rows seen and late."""
        return spark.read.schema(f"{self.MARK}, batch long").parquet(f"{self.home}/{self.MARKS}")


def dropped_late(query: StreamingQuery) -> int:
    """Rows the watermark refused over all batches still in the progress log."""
    return sum(
        int(op.get("numRowsDroppedByWatermark", 0))
        for p in query.recentProgress
        for op in p["stateOperators"]
    )
