"""Queries that write, read back and judge tables: reads, sinks, guards and contracts."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelwake.functions import text
from panelwake.functions.keys import to_number
from panelwake.operators import ranking, waterfall
from panelwake.operators.order import join_groups
from panelwake.plans import ranking_queries as rq
from panelwake.plans import standins as st
from panelwake.plans.registry import query
from panelwake.session import scratch_path
from panelwake.sources import contracts, landing
from panelwake.sources.contracts import ContractError

LAST_READ = 1998


@query(
    "period_read",
    st.with_base(
        f" SELECT CAST(season AS INTEGER) AS season, CAST(count(*) AS BIGINT) AS rows, CAST(count(DISTINCT key) AS BIGINT) AS keys FROM li WHERE season <= {LAST_READ} GROUP BY season"
    ),
)
def period_read(spark, folder):
    """Rows by season from a table partitioned by season, read up to a season only."""
    path = scratch_path(spark, "by-season")
    li = st.lineitem(spark, folder).withColumn("season", st.season_of_day(st.ship_day()))
    li.select("l_partkey", "season").write.partitionBy("season").parquet(path)
    rows = landing.read_up_to(spark, path, "season", LAST_READ, ["season", "l_partkey"])
    return rows.groupBy("season").agg(F.count("*").alias("rows"), F.count_distinct("l_partkey").alias("keys"))


@query(
    "sorted_deliverable",
    "SELECT CAST(count(*) AS BIGINT) AS rows, CAST(count(DISTINCT o_custkey) AS BIGINT) AS keys, CAST(0 AS BIGINT) AS out_of_order, CAST(0 AS BIGINT) AS overlapping_files FROM orders",
)
def sorted_deliverable(spark, folder):
    """Orders written in key order and read back: rows out of order inside files, files that overlap."""
    path = scratch_path(spark, "sorted")
    orders = landing.read_table(spark, folder, "orders", ["o_custkey", "o_orderkey"])
    landing.write_sorted(orders, path, ["o_custkey", "o_orderkey"])
    rows = spark.read.parquet(path).select(
        "o_custkey", "o_orderkey", F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("at")
    )
    key = F.struct("o_custkey", "o_orderkey")
    in_file = W.partitionBy("file").orderBy("at")
    files = (
        rows.withColumn("before", F.lag(key).over(in_file))
        .groupBy("file")
        .agg(
            F.count("*").alias("n"),
            F.count_if(F.col("before") > key).alias("bad"),
            F.min(key).alias("lo"),
            F.max(key).alias("hi"),
        )
    )
    by_file = W.orderBy("lo")  # one row per file
    return files.withColumn("prior", F.lag("hi").over(by_file)).agg(
        F.sum("n").alias("rows"),
        F.sum("bad").alias("out_of_order"),
        F.count_if(F.col("prior") > F.col("lo")).alias("overlapping_files"),
    ).crossJoin(rows.agg(F.count_distinct("o_custkey").alias("keys")))  # one row each


DECLARED = (
    T.StructType().add("c_custkey", "long").add("c_mktsegment", "string").add("c_region", "string").add("c_acctbal", "double")
)


@query(
    "conformed_columns",
    """SELECT 'c_custkey,c_mktsegment,c_region,c_acctbal' AS columns, CAST(count(*) AS BIGINT) AS rows, CAST(count(c_mktsegment) AS BIGINT) AS segments, CAST(0 AS BIGINT) AS regions, round(sum(c_acctbal), 2) AS balance FROM customer""",
)
def conformed_columns(spark, folder):
    """Customers brought to a declared schema: order as declared, an absent column as NULL."""
    given = landing.read_table(spark, folder, "customer", ["c_acctbal", "c_mktsegment", "c_custkey"])
    out = contracts.require_columns(contracts.conform(given, DECLARED), DECLARED.names, exact=True)
    return out.agg(
        F.lit(",".join(out.columns)).alias("columns"),
        F.count("*").alias("rows"),
        F.count("c_mktsegment").alias("segments"),
        F.count("c_region").alias("regions"),
        F.round(F.sum("c_acctbal"), 2).alias("balance"),
    )


def refused(check) -> bool:
    try:
        check()
    except ContractError:
        return True
    return False


@query(
    "refused_tables",
    """SELECT 'orders_empty' AS contract, count(*) = 0 AS refused FROM orders UNION ALL SELECT 'refunds_empty', count(*) = 0 FROM orders WHERE o_totalprice < 0
UNION ALL SELECT 'flag_domain', count(*) FILTER (l_returnflag IS NULL OR l_returnflag NOT IN ('A', 'N', 'R')) > 0 FROM lineitem UNION ALL SELECT 'status_domain', count(*) FILTER (o_orderstatus IS NULL OR o_orderstatus NOT IN ('F', 'O')) > 0 FROM orders
UNION ALL SELECT 'name_as_number', count(*) FILTER (c_name IS NOT NULL AND TRY_CAST(c_name AS DOUBLE) IS NULL) > 0 FROM customer UNION ALL SELECT 'key_as_number', false
UNION ALL SELECT 'segment_vocabulary', (SELECT count(*) FROM customer WHERE c_mktsegment NOT IN (SELECT c_mktsegment FROM customer WHERE c_acctbal > 9000)) > 0
UNION ALL SELECT 'extra_column', true UNION ALL SELECT 'window_past_cutoff', true""",
)
def refused_tables(spark, folder):
    """Which contracts the given tables break."""
    read = lambda name: landing.read_table(spark, folder, name)
    orders, customer, li = read("orders"), read("customer"), read("lineitem")
    rich = customer.where(F.col("c_acctbal") > 9000).select("c_mktsegment").distinct()
    cutoff = dt.datetime(1998, 10, 1)
    checks = {
        "orders_empty": lambda: contracts.require_rows(orders, "orders"),
        "refunds_empty": lambda: contracts.require_rows(orders.where("o_totalprice < 0"), "refunds"),
        "flag_domain": lambda: contracts.require_domain(li, "l_returnflag", ["A", "N", "R"]),
        "status_domain": lambda: contracts.require_domain(orders, "o_orderstatus", ["F", "O"]),
        "name_as_number": lambda: contracts.require_lossless(customer, {"c_name": to_number("c_name")}),
        "key_as_number": lambda: contracts.require_lossless(
            customer.select(F.col("c_custkey").cast("string").alias("k")), {"k": to_number("k")}
        ),
        "segment_vocabulary": lambda: contracts.require_vocabulary(customer, "c_mktsegment", rich),
        "extra_column": lambda: contracts.require_columns(customer, ["c_custkey"]),
        "window_past_cutoff": lambda: waterfall.trailing_slice(
            orders, "o_orderdate", dt.datetime(1998, 9, 1), dt.datetime(1998, 11, 1), cutoff
        ),
    }
    rows = [(name, refused(check)) for name, check in checks.items()]
    return spark.createDataFrame(rows, "contract string, refused boolean")


@query(
    "trailing_slice",
    """SELECT l_returnflag, CAST(count(*) AS BIGINT) AS rows, CAST(min(l_shipdate) AS DATE) AS first_day, CAST(max(l_shipdate) AS DATE) AS last_day FROM lineitem WHERE l_shipdate >= TIMESTAMP '1997-10-01' AND l_shipdate < TIMESTAMP '1998-10-01' GROUP BY 1""",
)
def trailing_slice(spark, folder):
    """Events of the year before a cutoff, by stream."""
    cutoff = dt.datetime(1998, 10, 1)
    rows = waterfall.trailing_slice(st.lineitem(spark, folder), "l_shipdate", dt.datetime(1997, 10, 1), cutoff, cutoff)
    return rows.groupBy("l_returnflag").agg(
        F.count("*").alias("rows"),
        F.to_date(F.min("l_shipdate")).alias("first_day"),
        F.to_date(F.max("l_shipdate")).alias("last_day"),
    )


@query(
    "prediction_sink",
    f"WITH {rq.PRICED_SQL} SELECT year, 'rehearsal' AS run_label, CAST(count(*) AS BIGINT) AS rows, round(sum(score), 2) AS score FROM priced GROUP BY year",
)
def prediction_sink(spark, folder):
    """Scores written by period with the status of the run, and read back."""
    path = scratch_path(spark, "predictions")
    scored = rq.priced_orders(spark, folder).select("o_orderkey", "year", "score", "y")
    landing.write_predictions(scored, path, "year", "rehearsal")
    return spark.read.parquet(path).groupBy("year", "run_label").agg(
        F.count("*").alias("rows"), F.round(F.sum("score"), 2).alias("score")
    )


@query(
    "count_contract",
    """WITH f AS (SELECT CAST(year(o_orderdate) AS INTEGER) AS year, count(*) AS n FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1), e AS (SELECT CAST(year(o_orderdate) AS INTEGER) AS year, count(*) AS n FROM orders GROUP BY 1)
SELECT coalesce(f.year, e.year) AS year, CAST(coalesce(f.n, 0) AS BIGINT) AS found_n, CAST(coalesce(e.n, 0) AS BIGINT) AS expected_n, coalesce(f.n, 0) = coalesce(e.n, 0) AS match FROM f FULL OUTER JOIN e ON f.year = e.year""",
)
def count_contract(spark, folder):
    """Settled orders per year against all orders per year."""
    orders = landing.read_table(spark, folder, "orders").withColumn("year", F.year("o_orderdate"))
    per_year = lambda df: df.groupBy("year").agg(F.count("*").alias("n"))
    settled = orders.where(F.col("o_orderstatus") != "P")
    return contracts.compare_counts(per_year(settled), per_year(orders), ["year"], ["n"])


@query(
    "apartment_rows",
    """SELECT p_type, CAST(count(*) AS BIGINT) AS rows, CAST(count(*) FILTER (p_size > 10 AND p_type NOT IN ('PROMO', 'STANDARD')) AS BIGINT) AS apartments FROM part GROUP BY 1""",
)
def apartment_rows(spark, folder):
    """Rows about one apartment; building-wide and blank values are not."""
    unit = F.when(F.col("p_size") > 10, " apartment ").otherwise("building")
    value = F.when(F.col("p_type") == "PROMO", " bldg").when(F.col("p_type") == "STANDARD", "  ").otherwise(F.col("p_brand"))
    part = landing.read_table(spark, folder, "part")
    return part.groupBy("p_type").agg(
        F.count("*").alias("rows"), F.count_if(text.is_apartment(unit, value)).alias("apartments")
    )


UNSCORED_SQL = f"""{rq.PRICED_SQL},
holes AS (SELECT CASE WHEN y = 1 OR year < 1997 THEN year END AS year, y, tie, CASE WHEN o_orderpriority = '1-URGENT' THEN NULL ELSE score END AS score FROM priced),
known AS (SELECT coalesce(year, -1) AS year, y, tie, score FROM holes WHERE score IS NOT NULL)"""


@query(
    "ranking_with_holes",
    f"""WITH {UNSCORED_SQL},{rq.areas_sql('known', 'year')},
u AS (SELECT coalesce(year, -1) AS year, count(*) AS rows, count(*) FILTER (score IS NULL) AS unscored FROM holes GROUP BY 1)
SELECT nullif(u.year, -1) AS year, CAST(u.rows AS BIGINT) AS rows, CAST(unscored AS BIGINT) AS unscored, {rq.METRICS_OUT} FROM u JOIN metrics ON metrics.year = u.year""",
)
def ranking_with_holes(spark, folder):
    """The ranking report where some scores and some groups are NULL; unplaced rows are counted."""
    priced = rq.priced_orders(spark, folder)
    urgent = F.col("o_orderpriority") == "1-URGENT"
    scored = priced.select(
        "o_orderkey",
        F.when((F.col("y") == 1) | (F.col("year") < 1997), F.col("year")).alias("year"),
        F.when(~F.coalesce(urgent, F.lit(False)), F.col("score")).alias("score"),
        "y",
    )
    counts = ranking.without_score(scored, ["year"], "score")
    report = ranking.report(scored, ["year"], "score", "y", ranking.tie_key(rq.SEED, "o_orderkey"))
    return st.rounded(join_groups(counts, report, ["year"]))


STAR = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem"]
# fixed values: the columns of the star schema, in name order
STAR_COLUMNS = {
    "region": "r_name r_regionkey",
    "nation": "n_name n_nationkey n_regionkey",
    "customer": "c_acctbal c_custkey c_mktsegment c_name c_nationkey",
    "supplier": "s_acctbal s_name s_nationkey s_suppkey",
    "part": "p_brand p_name p_partkey p_retailprice p_size p_type",
    "orders": "o_custkey o_orderdate o_orderkey o_orderpriority o_orderstatus o_totalprice",
    "lineitem": "l_discount l_extendedprice l_linenumber l_linestatus l_orderkey l_partkey l_quantity l_returnflag l_shipdate l_suppkey l_tax",
}


def fingerprint_sql(name: str, source: str, columns: str) -> str:
    """One fingerprint row of a relation; columns in name order."""
    parts = ", ".join(f"coalesce('v' || CAST({c} AS VARCHAR), 'n')" for c in columns.split())
    return f"""SELECT '{name}' AS "table", CAST(count(*) AS BIGINT) AS rows, coalesce(bit_xor(h), 0) AS xor_hash, CAST(coalesce(sum(CAST(h AS HUGEINT)), 0) AS VARCHAR) AS sum_hash
FROM (SELECT CAST('0x' || substr(md5(concat_ws(chr(31), {parts})), 1, 15) AS BIGINT) AS h FROM {source})"""


@query("table_fingerprint", " UNION ALL ".join(fingerprint_sql(n, n, STAR_COLUMNS[n]) for n in STAR))
def table_fingerprint(spark, folder):
    """Order-free fingerprints of the star schema."""
    return contracts.fingerprints({n: landing.read_table(spark, folder, n) for n in STAR})


MOVED = "(SELECT o_custkey, o_orderdate, o_orderkey, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderpriority END AS o_orderpriority, CASE WHEN o_orderstatus = 'P' THEN o_orderpriority ELSE o_orderstatus END AS o_orderstatus, o_totalprice FROM orders)"


@query(
    "changed_tables",
    f"""WITH a AS ({fingerprint_sql('orders', 'orders', STAR_COLUMNS['orders'])} UNION ALL {fingerprint_sql('part', 'part', STAR_COLUMNS['part'])}),
b AS ({fingerprint_sql('orders', MOVED, STAR_COLUMNS['orders'])} UNION ALL {fingerprint_sql('part', '(SELECT * FROM part ORDER BY p_size)', STAR_COLUMNS['part'])})
SELECT a."table" FROM a JOIN b ON a."table" = b."table" WHERE a.xor_hash <> b.xor_hash OR a.sum_hash <> b.sum_hash OR a.rows <> b.rows""",
)
def changed_tables(spark, folder):
    """Tables whose content moved: in one, values change columns; the other is only in another order."""
    orders, part = landing.read_table(spark, folder, "orders"), landing.read_table(spark, folder, "part")
    open_ = F.col("o_orderstatus") == "P"
    moved = orders.withColumns(
        {
            "o_orderpriority": F.when(~F.coalesce(open_, F.lit(False)), F.col("o_orderpriority")),
            "o_orderstatus": F.when(open_, F.col("o_orderpriority")).otherwise(F.col("o_orderstatus")),
        }
    )
    before = contracts.fingerprints({"orders": orders, "part": part})
    after = contracts.fingerprints({"orders": moved, "part": part.repartition(3, "p_size")})
    return contracts.changed_tables(before, after)
