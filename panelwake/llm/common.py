"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelwake.session import scratch_path, tune

TOKENIZERS = "/opt/tokenizers"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Arrow batches to Python stay small, however long single texts are.
ARROW_SETTINGS = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20),
}


#: Bytes of a group after which a worker hands memory back.
LARGE_GROUP = 1 << 20


def prepared(spark: SparkSession) -> SparkSession:
    tune(spark)
    for name, value in ARROW_SETTINGS.items():
        if spark.conf.get(name, None) != value:
            spark.conf.set(name, value)
    return spark


def query(name: str, sql: str | None = None):
    """Register a query over a folder of tables."""

    def add(fn: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return fn(prepared(spark), folder)

        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def only(df: DataFrame, **columns: str) -> DataFrame:
    """The named columns under the operator's own names; whatever else the input has cannot clash."""
    return df.select(*[df[f"`{source}`"].alias(name) for name, source in columns.items()])


def unused(taken: Iterable[str], name: str) -> str:
    """The name, with underscores before it until no column of the input has it, in either case."""
    lower = {c.lower() for c in taken}
    while name.lower() in lower:
        name = f"_{name}"
    return name


def quoted(names: Iterable[str]) -> list[Column]:
    """Columns of any name, dots included."""
    return [F.col(f"`{c}`") for c in names]


def released() -> None:
    """Hand freed memory back to the system: Python workers live on beside those of later stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def in_batches(rows: DataFrame, function, schema: str) -> DataFrame:
    """mapInArrow whose tasks hand freed memory back when they end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from function(batches)
        released()

    return rows.mapInArrow(run, schema)


def on_groups(groups, function, schema: str) -> DataFrame:
    """applyInArrow that hands freed memory back after each group of some size."""

    def run(group: pa.Table) -> pa.Table:
        out, large = function(group), group.nbytes > LARGE_GROUP
        if large:
            del group
            released()
        return out

    return groups.applyInArrow(run, schema)


def mapped(rows: DataFrame, function, schema: T.StructType) -> DataFrame:
    """mapInArrow over columns of any name: they travel by position, under plain names."""
    names = [f"c{i}" for i in range(len(schema))]
    plain = T.StructType([T.StructField(n, f.dataType) for n, f in zip(names, schema)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in function(batches):
            yield pa.RecordBatch.from_arrays(b.columns, names=names)
        released()

    return rows.toDF(*[f"c{i}" for i in range(len(rows.columns))]).mapInArrow(run, plain).toDF(*schema.names)


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write a table into the shared folder and read it back: lineage ends on durable files."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(spark: SparkSession, path: str) -> None:
    """Remove a table of the shared folder that its operator wrote and reads no more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def freed_shuffles(spark: SparkSession):
    """Shuffle files go with the action that wrote them, not with the driver's garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def sha(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def row_key(doc_id: str = "doc_id", text: str = "text") -> list[Column]:
    """What tells documents apart: the id (nulls as one value) and a hash of the text.

    Rows that agree in both are equal in all that an operator reads, so they share one result.
    """
    return [
        F.coalesce(F.col(doc_id), F.lit(-(2**63))).alias("_id"),
        F.xxhash64(F.col(text)).alias("_h"),
    ]
