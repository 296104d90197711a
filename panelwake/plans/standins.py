"""How the given tables stand in for incidents, events, lots, owners and programme lists."""

from __future__ import annotations

import contextlib
import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwake.functions import calendar, numeric
from panelwake.operators import association
from panelwake.operators.panel import PanelSpec
from panelwake.session import scratch_path
from panelwake.sources.landing import read_table

LOOK_BACKS = [90, 180]
WIDEST = 180
FIRST_SEASON, LAST_SEASON = 1995, 2000
SPEC = PanelSpec(
    first_season=1994,
    context_first_year=1995,
    complaint_first_year=1996,
    complaint_floor=dt.date(1995, 6, 1),
    classes=("A", "N", "R"),
)
ROW_ID = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate"]
FLAGS = {"n_inc": "R", "n_evt": "N", "n_prb": "A"}


def streams(*names: str) -> dict[str, Column]:
    return {n: F.col("l_returnflag") == FLAGS[n] for n in names}


def ship_day() -> Column:
    return calendar.day_number("l_shipdate")


def date_of(day: Column | str) -> Column:
    return F.date_from_unix_date(F.col(day) if isinstance(day, str) else day)


def season_of_day(day: Column | str) -> Column:
    return calendar.season_of(date_of(day))


def lineitem(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "lineitem")


_KEPT: dict[str, DataFrame] = {}


@contextlib.contextmanager
def one_pass(spark: SparkSession, folder: str):
    """While a query is put together, count its events per entity and day once and keep the counts.

    Everything made from `events` inside reads them instead of scanning the raw table again.
    """
    if folder in _KEPT:
        yield
        return
    counts = events(spark, folder).groupBy("key", "day", "l_returnflag", "l_linestatus").agg(F.sum("n").alias("n"))
    path = scratch_path(spark, "days")
    counts.write.parquet(path)
    _KEPT[folder] = spark.read.schema(counts.schema).parquet(path)
    try:
        yield
    finally:
        del _KEPT[folder]


def events(spark: SparkSession, folder: str) -> DataFrame:
    """Events as (key, day, l_returnflag, l_linestatus, n): counted if they are kept, else one by one."""
    if folder in _KEPT:
        return _KEPT[folder]
    return lineitem(spark, folder).select(
        F.col("l_partkey").alias("key"),
        ship_day().alias("day"),
        "l_returnflag",
        "l_linestatus",
        F.lit(1).cast("long").alias("n"),
    )


def day_timeline(spark: SparkSession, folder: str, *names: str) -> DataFrame:
    return association.timeline(
        events(spark, folder), "key", F.col("day"), streams(*names), weight=F.col("n")
    )


def spans(spark: SparkSession, folder: str, *names: str) -> DataFrame:
    return association.coverage_span(lineitem(spark, folder), ship_day(), streams(*names))


def eligible(spark: SparkSession, folder: str, look: dict[str, int] | None = None, day: str = "day") -> Column:
    """In a listed season, and the widest look-back inside the observed span."""
    look = look or {"n_evt": WIDEST}
    left, right = association.edges(spans(spark, folder, *look), look, day)
    season = season_of_day(day)
    return ~left & ~right & season.between(FIRST_SEASON, LAST_SEASON)


def eligible_timeline(spark: SparkSession, folder: str) -> DataFrame:
    """Timeline whose incident counts are 0 on days that are not eligible."""
    tl = day_timeline(spark, folder, "n_inc", "n_evt")
    ok = F.coalesce(eligible(spark, folder), F.lit(False))
    return tl.withColumn("n_inc", F.when(ok, F.col("n_inc")).otherwise(0))


def parts(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "part")


def lots(spark: SparkSession, folder: str) -> DataFrame:
    """Entity attributes; the year of construction is read off the list price."""
    return parts(spark, folder).select(
        F.col("p_partkey").alias("key"),
        (F.lit(1000) + F.floor("p_retailprice")).cast("int").alias("yearbuilt"),
        F.col("p_size").alias("unitsres"),
        F.when(F.col("p_size") > 5, F.col("p_size")).alias("unitstotal"),
        F.length("p_name").alias("numfloors"),
        F.upper(F.substring("p_name", 1, 1)).alias("bldgclass_1"),
        F.col("p_type").alias("borough"),
    )


def owners(spark: SparkSession, folder: str) -> DataFrame:
    return parts(spark, folder).select(
        F.col("p_partkey").alias("key"), F.col("p_brand").alias("owner_key")
    )


def spine(spark: SparkSession, folder: str) -> DataFrame:
    """Parts shipped in a season; the label says whether one came back.

    A part without shipments in a season has no row, which leaves natural gaps.
    """
    back = F.col("l_returnflag") == "R"
    return (
        events(spark, folder)
        .withColumn("season", season_of_day("day"))
        .where(F.col("season").isNotNull())
        .groupBy("key", "season")
        .agg(
            F.max(F.when(back & (F.col("l_linestatus") == "O"), 1).otherwise(0)).alias("label_c"),
            F.max(F.when(back, 1).otherwise(0)).alias("label_bc"),
        )
    )


def season_counts(spark: SparkSession, folder: str) -> DataFrame:
    """In-season incidents of the counted class per (entity, season)."""
    back = (F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "O")
    return (
        events(spark, folder)
        .where(back)
        .groupBy("key", season_of_day("day").alias("season"))
        .agg(F.sum("n").alias("inc"))
        .where(F.col("season").isNotNull())
    )


def year_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Events per (entity, calendar year), by class and as complaints; the year sits in `season`."""
    year = F.year(date_of("day"))
    flag = F.col("l_returnflag")
    count = lambda cond: F.sum(F.when(cond, F.col("n")).otherwise(0))
    return (
        events(spark, folder)
        .where(year >= SPEC.context_first_year)
        .groupBy("key", year.alias("season"))
        .agg(
            *[count(flag == c).alias(f"ctx_{c.lower()}") for c in SPEC.classes],
            count((flag == "N") & (year >= SPEC.complaint_first_year)).alias("cmp"),
        )
    )


def program(spark: SparkSession, folder: str) -> DataFrame:
    """Programme list: promotional parts, starting on 1 July of a year set by their size."""
    year = (
        F.when(F.col("p_size") < 10, 1996)
        .when(F.col("p_size") < 20, 1997)
        .when(F.col("p_size") < 35, 1998)
        .otherwise(1999)
    )
    return (
        parts(spark, folder)
        .where(F.col("p_type") == "PROMO")
        .select(F.col("p_partkey").alias("key"), year.alias("cohort"))
        .withColumn("start", F.unix_date(F.make_date("cohort", F.lit(7), F.lit(1))))
    )


def unit_classes(spark: SparkSession, folder: str) -> DataFrame:
    return parts(spark, folder).select(
        F.col("p_partkey").alias("key"),
        F.col("p_size").alias("units"),
        numeric.unit_class("p_size").alias("unit_class"),
    )


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round floating-point columns so that summation order does not show."""
    return df.select(
        *[
            F.round(c, digits).alias(c) if t in ("double", "float") else F.col(c)
            for c, t in df.dtypes
        ]
    )


# -- the same stand-ins for the SQL texts --------------------------------------------------------

SEASON_SQL = (
    "CASE WHEN month({d}) >= 10 THEN year({d}) WHEN month({d}) <= 5 THEN year({d}) - 1 END"
)


def season_sql(d: str) -> str:
    return SEASON_SQL.format(d=d)


UNIT_CLASS_SQL = (
    "CASE WHEN {u} IS NULL THEN 'unmatched' WHEN {u} < 2 THEN '<2' WHEN {u} <= 5 THEN '2-5' "
    "WHEN {u} <= 19 THEN '6-19' WHEN {u} <= 49 THEN '20-49' ELSE '50+' END"
)


def unit_class_sql(u: str) -> str:
    return UNIT_CLASS_SQL.format(u=u)


SQL_BASE = f"""
li AS (
  SELECT l_partkey AS key, CAST(l_shipdate AS DATE) AS d, l_returnflag AS flag, l_linestatus AS status,
         {season_sql('CAST(l_shipdate AS DATE)')} AS season, row_number() OVER () AS rid
  FROM lineitem),
evt AS (SELECT key, d, season, rid FROM li WHERE flag = 'N'),
prb AS (SELECT key, d, season, rid FROM li WHERE flag = 'A'),
cov AS (SELECT min(d) AS lo, max(d) AS hi FROM evt),
inc AS (SELECT key, d, season, rid, status FROM li WHERE flag = 'R'),
elig AS (
  SELECT inc.* FROM inc, cov
  WHERE d - {WIDEST} >= lo AND d <= hi AND season BETWEEN {FIRST_SEASON} AND {LAST_SEASON}),
spine AS (
  SELECT key, season, max(CASE WHEN flag = 'R' AND status = 'O' THEN 1 ELSE 0 END) AS label_c,
         max(CASE WHEN flag = 'R' THEN 1 ELSE 0 END) AS label_bc
  FROM li WHERE season IS NOT NULL GROUP BY key, season),
program AS (
  SELECT p_partkey AS key, CASE WHEN p_size < 10 THEN 1996 WHEN p_size < 20 THEN 1997
         WHEN p_size < 35 THEN 1998 ELSE 1999 END AS cohort
  FROM part WHERE p_type = 'PROMO')
"""


def with_base(body: str) -> str:
    return f"WITH {SQL_BASE.strip()}{body}"
