"""Queries on groups with and without events, their covariates, and record matching."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwake.functions import keys, text
from panelwake.operators import dedupe, order, resolve, strata
from panelwake.plans import standins as st
from panelwake.plans.ingest_queries import BORO, BORO_SQL, street_sql
from panelwake.plans.registry import query
from panelwake.sources.landing import read_table

EARLY = dt.datetime(1996, 1, 1)
CELL = ["unit_class", "borough", "income_tercile", "share_tercile"]


def nations(spark, folder) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Dominant nation per part, weighted mean balance per nation, discount share per nation."""
    li = st.lineitem(spark, folder)
    pairs = li.groupBy("l_partkey", "l_suppkey").agg(
        F.count("*").alias("n"), F.count_if(F.col("l_discount") > 0.05).alias("cheap")
    )
    s = read_table(spark, folder, "supplier", ["s_suppkey", "s_nationkey", "s_acctbal"])
    rows = pairs.join(s, pairs["l_suppkey"] == s["s_suppkey"], "left")
    per_nation = rows.groupBy("l_partkey", "s_nationkey").agg(F.sum("n").alias("n"))
    dominant = dedupe.keep_first(per_nation, ["l_partkey"], [F.desc("n"), F.desc("s_nationkey")]).select(
        F.col("l_partkey").alias("key"), F.col("s_nationkey").alias("nation")
    )
    per_supplier = pairs.groupBy("l_suppkey").agg(F.sum("n").alias("n"), F.sum("cheap").alias("cheap"))
    by_supplier = per_supplier.join(s, per_supplier["l_suppkey"] == s["s_suppkey"])
    income = by_supplier.groupBy(F.col("s_nationkey").alias("nation")).agg(
        strata.weighted_mean(F.col("s_acctbal"), F.col("n")).alias("income"),
        (F.sum("cheap") / F.sum("n")).alias("share"),
    )
    return dominant, income.select("nation", "income"), income.select("nation", "share")


def universe(spark, folder) -> DataFrame:
    """Entities of the panel with their early event count and group."""
    everyone = st.spine(spark, folder).select("key").distinct()
    counts = (
        st.lineitem(spark, folder)
        .where((F.col("l_returnflag") == "N") & (F.col("l_shipdate") < F.lit(EARLY)))
        .groupBy(F.col("l_partkey").alias("key"))
        .agg(F.count("*").alias("n_events"))
    )
    return strata.zero_fill(everyone, counts, "key", "n_events")


def covariates(spark, folder) -> DataFrame:
    """Universe with unit class, borough, income, share, and their terciles."""
    dominant, income, share = nations(spark, folder)
    rows = (
        universe(spark, folder)
        .join(st.unit_classes(spark, folder), "key", "left")
        .join(st.parts(spark, folder).select(F.col("p_partkey").alias("key"), F.col("p_type").alias("borough")), "key", "left")
        .join(dominant, "key", "left")
        .join(income, "nation", "left")
        .join(share, "nation", "left")
    )
    for value in ("income", "share"):
        ranked = order.row_numbers(rows, [F.asc_nulls_last(value), F.asc("key")])
        n = ranked.agg(F.count(value).alias("n")).scalar()
        band = order.tercile(F.col("rank"), F.col("_n")).cast("string")
        rows = (
            ranked.withColumn("_n", n)
            .withColumn(f"{value}_tercile", F.when(F.col(value).isNotNull(), band).otherwise("(uncovered)"))
            .drop("rank", "all_rows", "_n")
        )
    return rows


COV_SQL = f"""
pairs AS (SELECT l_partkey AS key, s_nationkey AS nation, count(*) AS n FROM lineitem LEFT JOIN supplier ON s_suppkey = l_suppkey GROUP BY ALL),
dom AS (SELECT key, nation FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY n DESC, nation DESC) AS rn FROM pairs) WHERE rn = 1),
nat AS (SELECT s_nationkey AS nation, sum(s_acctbal) / count(*) AS income, count(*) FILTER (l_discount > 0.05)::DOUBLE / count(*) AS share FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1),
uni0 AS (SELECT DISTINCT key FROM spine),
uni AS (SELECT u.key, count(e.rid) AS n_events, CASE WHEN count(e.rid) = 0 THEN 'zero' ELSE 'positive' END AS mass FROM uni0 u LEFT JOIN evt e ON e.key = u.key AND e.d < DATE '1996-01-01' GROUP BY u.key),
cov0 AS (SELECT u.*, p_size AS units, {st.unit_class_sql('p_size')} AS unit_class, p_type AS borough, dom.nation, income, share FROM uni u LEFT JOIN part ON p_partkey = u.key LEFT JOIN dom ON dom.key = u.key LEFT JOIN nat ON nat.nation = dom.nation),
cov1 AS (SELECT *, row_number() OVER (ORDER BY income NULLS LAST, key) AS r1, count(income) OVER () AS n1, row_number() OVER (ORDER BY share NULLS LAST, key) AS r2, count(share) OVER () AS n2 FROM cov0),
covs AS (SELECT *, CASE WHEN income IS NULL THEN '(uncovered)' WHEN 3 * (r1 - 1) <= n1 - 1 THEN '1' WHEN 3 * (r1 - 1) <= 2 * (n1 - 1) THEN '2' ELSE '3' END AS income_tercile,
  CASE WHEN share IS NULL THEN '(uncovered)' WHEN 3 * (r2 - 1) <= n2 - 1 THEN '1' WHEN 3 * (r2 - 1) <= 2 * (n2 - 1) THEN '2' ELSE '3' END AS share_tercile FROM cov1)"""


@query(
    "rank_terciles",
    st.with_base(
        f""",{COV_SQL},
t AS (SELECT key, n_events, row_number() OVER (ORDER BY n_events, key) AS r, count(*) OVER () AS n FROM uni)
SELECT key, CAST(n_events AS BIGINT) AS n_events, CAST(r AS BIGINT) AS rank, CAST(CASE WHEN 3 * (r - 1) <= n - 1 THEN 1 WHEN 3 * (r - 1) <= 2 * (n - 1) THEN 2 ELSE 3 END AS INTEGER) AS tercile FROM t"""
    ),
)
def rank_terciles(spark, folder):
    """Terciles of a heavily tied count, ties split by entity key."""
    u = universe(spark, folder).select("key", "n_events")
    ranked = order.row_numbers(u, [F.asc("n_events"), F.asc("key")])
    return ranked.select("key", "n_events", "rank", order.tercile(F.col("rank"), F.col("all_rows")).alias("tercile"))


@query(
    "tercile_bands",
    st.with_base(
        f""",{COV_SQL}
SELECT income_tercile, CAST(count(*) AS BIGINT) AS n, round(min(income), 6) AS lo, round(max(income), 6) AS hi, round(min(share), 6) AS share_lo, round(max(share), 6) AS share_hi FROM covs GROUP BY income_tercile"""
    ),
)
def tercile_bands(spark, folder):
    """Smallest and largest value per tercile."""
    return st.rounded(
        covariates(spark, folder).groupBy("income_tercile").agg(
            F.count("*").alias("n"),
            F.min("income").alias("lo"),
            F.max("income").alias("hi"),
            F.min("share").alias("share_lo"),
            F.max("share").alias("share_hi"),
        )
    )


@query(
    "share_table",
    st.with_base(
        f""",{COV_SQL},
g AS (SELECT unit_class, count(*) FILTER (mass = 'zero') AS z, count(*) FILTER (mass = 'positive') AS p FROM covs GROUP BY 1)
SELECT unit_class, CAST(z AS BIGINT) AS n_zero, round(100.0 * z::DOUBLE / (SELECT sum(z) FROM g), 6) AS pct_zero, CAST(p AS BIGINT) AS n_positive, round(100.0 * p::DOUBLE / (SELECT sum(p) FROM g), 6) AS pct_positive FROM g"""
    ),
)
def share_table(spark, folder):
    """Unit classes of entities with and without early events."""
    rows = universe(spark, folder).join(st.unit_classes(spark, folder), "key", "left").withColumn(
        "unit_class", F.coalesce("unit_class", F.lit("unmatched"))
    )
    return st.rounded(strata.share_table(rows, "unit_class"))


@query(
    "zero_share_by_class",
    st.with_base(
        f""",{COV_SQL}
SELECT unit_class, round(100.0 * count(*) FILTER (mass = 'zero')::DOUBLE / count(*), 6) AS zero_pct FROM covs WHERE unit_class IN ('2-5', '6-19', '20-49', '50+') GROUP BY 1"""
    ),
)
def zero_share_by_class(spark, folder):
    """Share of entities without early events per unit class."""
    rows = universe(spark, folder).join(st.unit_classes(spark, folder), "key")
    known = rows.where(F.col("unit_class").isin("2-5", "6-19", "20-49", "50+"))
    share = 100.0 * F.count_if(F.col("mass") == "zero") / F.count("*")
    return st.rounded(known.groupBy("unit_class").agg(share.alias("zero_pct")))


@query(
    "group_quartiles",
    st.with_base(
        f""",{COV_SQL}
SELECT mass, CAST(count(units) AS BIGINT) AS n, round(CAST(quantile_cont(units, 0.25) AS DOUBLE), 6) AS p25, round(CAST(quantile_cont(units, 0.5) AS DOUBLE), 6) AS median, round(CAST(quantile_cont(units, 0.75) AS DOUBLE), 6) AS p75 FROM covs GROUP BY mass"""
    ),
)
def group_quartiles(spark, folder):
    """Quartiles of the unit count in both groups, by prefix sums over value counts."""
    rows = universe(spark, folder).join(st.unit_classes(spark, folder), "key").withColumn(
        "units", F.col("units").cast("double")
    )
    q = order.quantiles(rows, ["mass"], "units", [0.25, 0.5, 0.75])
    return st.rounded(
        q.select("mass", "n", F.col("q0").alias("p25"), F.col("q1").alias("median"), F.col("q2").alias("p75"))
    )


def cells(spark, folder) -> DataFrame:
    complete = covariates(spark, folder).where(
        F.col("unit_class").isin("2-5", "6-19", "20-49", "50+")
        & (F.col("income_tercile") != "(uncovered)")
        & (F.col("share_tercile") != "(uncovered)")
    )
    return strata.support_cells(complete, CELL)


CELLS_SQL = f"""{COV_SQL},
cells AS (SELECT unit_class, borough, income_tercile, share_tercile, count(*) FILTER (mass = 'zero') AS z, count(*) FILTER (mass = 'positive') AS p FROM covs
  WHERE unit_class IN ('2-5', '6-19', '20-49', '50+') AND income_tercile <> '(uncovered)' AND share_tercile <> '(uncovered)' GROUP BY ALL)"""


@query(
    "support_overlap",
    st.with_base(
        f""",{CELLS_SQL}
SELECT CAST(count(*) AS BIGINT) AS cells, CAST(sum(CASE WHEN p >= 1 THEN z ELSE 0 END) AS BIGINT) AS zero_with_1_pos, CAST(sum(CASE WHEN z >= 1 THEN p ELSE 0 END) AS BIGINT) AS pos_with_1_zero,
  round(100.0 * sum(CASE WHEN p >= 1 THEN z ELSE 0 END)::DOUBLE / sum(z), 6) AS zero_with_1_pos_pct, round(100.0 * sum(CASE WHEN p >= 10 THEN z ELSE 0 END)::DOUBLE / sum(z), 6) AS zero_with_10_pos_pct,
  round(100.0 * sum(CASE WHEN z >= 1 THEN p ELSE 0 END)::DOUBLE / sum(p), 6) AS pos_with_1_zero_pct, round(100.0 * sum(CASE WHEN z >= 10 THEN p ELSE 0 END)::DOUBLE / sum(p), 6) AS pos_with_10_zero_pct,
  CAST(count(*) FILTER (z > 0 AND p = 0) AS BIGINT) AS cells_zero_only, CAST(count(*) FILTER (p > 0 AND z = 0) AS BIGINT) AS cells_pos_only, CAST(count(*) FILTER (p > 0 AND z > 0) AS BIGINT) AS cells_both FROM cells"""
    ),
)
def support_overlap(spark, folder):
    """How far the two groups share covariate cells."""
    return st.rounded(strata.support_overlap(cells(spark, folder)))


@query(
    "support_top_cells",
    st.with_base(
        f""",{CELLS_SQL}
SELECT unit_class, borough, income_tercile, share_tercile, CAST(p AS BIGINT) AS n_pos FROM cells WHERE p > 0 AND z = 0 ORDER BY p DESC, unit_class, borough, income_tercile, share_tercile LIMIT 5"""
    ),
)
def support_top_cells(spark, folder):
    """Largest cells that hold one group only."""
    only = cells(spark, folder).where((F.col("n_pos") > 0) & (F.col("n_zero") == 0))
    return only.orderBy(F.desc("n_pos"), *CELL).limit(5).select(*CELL, "n_pos")


@query(
    "weighted_mean_dominant",
    st.with_base(
        f""",{COV_SQL}
SELECT CAST(d.nation AS INTEGER) AS nation, n_name, r_name, CAST(count(*) AS BIGINT) AS parts, round(max(income), 6) AS income, CAST(count(*) FILTER (income IS NULL) AS BIGINT) AS without_income
FROM dom d LEFT JOIN nat ON nat.nation = d.nation LEFT JOIN nation ON n_nationkey = d.nation LEFT JOIN region ON r_regionkey = n_regionkey GROUP BY 1, 2, 3"""
    ),
)
def weighted_mean_dominant(spark, folder):
    """Parts per dominant nation, with the nation's weighted mean and its region."""
    dominant, income, _ = nations(spark, folder)
    per = dominant.groupBy("nation").agg(F.count("*").alias("parts"))
    n = read_table(spark, folder, "nation")
    r = read_table(spark, folder, "region")
    out = (
        per.join(income, "nation", "left")
        .join(n, per["nation"] == n["n_nationkey"], "left")
        .join(r, n["n_regionkey"] == r["r_regionkey"], "left")
    )
    missing = F.when(F.col("income").isNull(), F.col("parts")).otherwise(0)
    return st.rounded(
        out.select(per["nation"], "n_name", "r_name", "parts", "income", missing.alias("without_income"))
    )


@query(
    "histogram_log",
    st.with_base(
        f""",{COV_SQL},
t AS (SELECT CAST(greatest(max(units), 10) AS DOUBLE) AS top FROM covs),
b AS (SELECT mass, CAST(least(floor(log10(units) / (log10(top) / 40.0)), 39) AS INTEGER) AS bin, count(*) AS n, max(log10(top) / 40.0) AS w FROM covs, t WHERE units >= 1 GROUP BY 1, 2)
SELECT mass, bin, CAST(n AS BIGINT) AS n, round(n / (sum(n) OVER (PARTITION BY mass) * (pow(10.0, (bin + 1) * w) - pow(10.0, bin * w))), 6) AS density FROM b"""
    ),
)
def histogram_log(spark, folder):
    """Log-binned unit counts with densities, per group."""
    rows = universe(spark, folder).join(st.unit_classes(spark, folder), "key")
    top = st.parts(spark, folder).join(
        st.spine(spark, folder).select(F.col("key").alias("p_partkey")), "p_partkey", "left_semi"
    ).agg(F.greatest(F.max("p_size"), F.lit(10)).cast("double").alias("top"))
    with_top = rows.withColumn("top", top.scalar())
    return st.rounded(strata.log_histogram(with_top, "mass", "units", 40, F.col("top")))


@query(
    "histogram_linear",
    """WITH e AS (SELECT min(value) AS lo, max(value) AS hi FROM events),
b AS (SELECT event_type, CAST(least(floor((value - lo) / ((hi - lo) / 40.0)), 39) AS INTEGER) AS bin, count(*) AS n, max((hi - lo) / 40.0) AS w FROM events, e WHERE value IS NOT NULL GROUP BY 1, 2)
SELECT event_type, bin, CAST(n AS BIGINT) AS n, round(n / (sum(n) OVER (PARTITION BY event_type) * w), 6) AS density FROM b""",
)
def histogram_linear(spark, folder):
    """Linear bins over the observed range, per group."""
    e = read_table(spark, folder, "events", ["event_type", "value"])
    span = e.agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    rows = e.withColumns({"lo": span.select("lo").scalar(), "hi": span.select("hi").scalar()})
    return st.rounded(strata.linear_histogram(rows, "event_type", "value", 40, F.col("lo"), F.col("hi")))


@query(
    "latest_row_per_key",
    """SELECT o_custkey, o_orderkey, CAST(o_orderdate AS DATE) AS order_day FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC NULLS LAST, o_orderkey DESC) AS rn FROM orders) WHERE rn = 1""",
)
def latest_row_per_key(spark, folder):
    """Latest order per customer; ties go to the larger order number."""
    o = read_table(spark, folder, "orders", ["o_custkey", "o_orderkey", "o_orderdate"])
    last = resolve.latest(o, "o_custkey", "o_orderdate", "o_orderkey")
    return last.select("o_custkey", "o_orderkey", F.to_date("o_orderdate").alias("order_day"))


PRIORITY = {"1-URGENT": 0, "2-HIGH": 1, "3-MEDIUM": 2}


def owner_contacts(spark, folder) -> DataFrame:
    """Orders as contacts: only three priorities count, the address text comes from clerk-like fields."""
    o = read_table(spark, folder, "orders")
    street = F.when(F.col("o_orderstatus") == "P", F.lit(" ")).otherwise(F.concat(F.lit(" st  "), F.col("o_custkey").cast("string")))
    return o.withColumn(
        "owner_key",
        text.owner_key(F.col("o_orderstatus"), street, F.col("o_orderpriority"), F.col("o_orderstatus")),
    )


CONTACT_SQL = """ct AS (SELECT o_custkey, CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 WHEN '3-MEDIUM' THEN 2 END AS prio,
  CASE WHEN o_orderstatus <> 'P' THEN 'ADDR:' || o_orderstatus || '|ST ' || o_custkey || '|' || o_orderpriority ELSE 'CORP:P' END AS owner_key FROM orders),
best AS (SELECT o_custkey, owner_key FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY prio, owner_key) AS rn FROM ct WHERE prio IS NOT NULL) WHERE rn = 1)"""


@query("best_row_by_priority", f"WITH {CONTACT_SQL} SELECT o_custkey, owner_key FROM best")
def best_row_by_priority(spark, folder):
    """Best contact per customer: priority first, then key."""
    c = owner_contacts(spark, folder)
    return resolve.best_contact(c, "o_custkey", keys.recode(F.col("o_orderpriority"), PRIORITY), "owner_key")


@query(
    "owner_join_chain",
    f"""WITH {CONTACT_SQL},
j AS (SELECT c_custkey, c_mktsegment, owner_key, count(*) OVER (PARTITION BY owner_key) AS size FROM customer LEFT JOIN best ON o_custkey = c_custkey)
SELECT c_mktsegment, CAST(count(*) AS BIGINT) AS customers, CAST(count(owner_key) AS BIGINT) AS with_owner, CAST(count(*) FILTER (owner_key LIKE 'CORP:%') AS BIGINT) AS by_company, CAST(max(CASE WHEN owner_key IS NOT NULL THEN size END) AS BIGINT) AS largest_portfolio FROM j GROUP BY 1""",
)
def owner_join_chain(spark, folder):
    """Customer to contact to owner, and portfolio sizes."""
    best = resolve.best_contact(
        owner_contacts(spark, folder), "o_custkey", keys.recode(F.col("o_orderpriority"), PRIORITY), "owner_key"
    )
    c = read_table(spark, folder, "customer", ["c_custkey", "c_mktsegment"]).withColumnRenamed("c_custkey", "o_custkey")
    linked = resolve.owner_of(c.withColumn("entity", F.col("o_custkey")), best, "entity", "o_custkey", "owner_key")
    sizes = linked.where(F.col("owner_key").isNotNull()).groupBy("owner_key").agg(F.count("*").alias("size"))
    out = linked.join(sizes, "owner_key", "left").join(c.withColumnRenamed("o_custkey", "entity"), "entity")
    return out.groupBy("c_mktsegment").agg(
        F.count("*").alias("customers"),
        F.count("owner_key").alias("with_owner"),
        F.count_if(F.col("owner_key").startswith("CORP:")).alias("by_company"),
        F.max("size").alias("largest_portfolio"),
    )


def addressed_parts(spark, folder) -> DataFrame:
    """Parts with a normalised address key made of type, brand number and name."""
    p = st.parts(spark, folder)
    number, street = text.split_address(F.concat(F.replace("p_brand", F.lit("#"), F.lit("")), F.lit(" "), "p_name", F.lit(" st.")))
    return p.select(
        F.col("p_partkey").alias("key"),
        "p_type",
        "p_size",
        text.address_key(keys.recode(F.col("p_type"), BORO), number, street).alias("akey"),
    )


ADDR_SQL = f"""addr AS (SELECT p_partkey AS key, p_type, p_size, {BORO_SQL} || '|' || upper(replace(p_brand, '#', '')) || '|' || {street_sql("(p_name || ' st.')")} AS akey FROM part)"""


@query(
    "resolve_by_key",
    f"""WITH {ADDR_SQL},
res AS (SELECT akey, min(key) AS found FROM addr GROUP BY akey HAVING count(*) = 1),
j AS (SELECT a.*, CASE WHEN p_size >= 10 THEN a.key END AS official, found, coalesce(CASE WHEN p_size >= 10 THEN a.key END, found) AS final_id FROM addr a LEFT JOIN res ON res.akey = a.akey WHERE p_type = 'PROMO')
SELECT CAST(count(*) AS BIGINT) AS records, CAST(count(found) AS BIGINT) AS resolved, CAST(count(official) AS BIGINT) AS official, CAST(count(*) FILTER (official IS NOT NULL AND found IS NOT NULL) AS BIGINT) AS both,
  CAST(count(*) FILTER (official = found) AS BIGINT) AS agree, CAST(count(*) FILTER (official <> found) AS BIGINT) AS disagree, CAST(count(*) FILTER (final_id IS NULL) AS BIGINT) AS unresolved FROM j""",
)
def resolve_by_key(spark, folder):
    """Programme records resolved by address key; ambiguous keys never resolve."""
    a = addressed_parts(spark, folder)
    resolver = resolve.unambiguous(a.select("akey", F.col("key").alias("found")), "akey", "found")
    records = a.where(F.col("p_type") == "PROMO").withColumn("official", F.when(F.col("p_size") >= 10, F.col("key")))
    return resolve.agreement(resolve.resolve(records, resolver, "akey", "official", "found"), "official", "found")


@query(
    "reconcile_lists",
    st.with_base(
        f""", {ADDR_SQL},
l AS (SELECT DISTINCT cohort, akey FROM program JOIN addr USING (key)), r AS (SELECT DISTINCT cohort, akey FROM program JOIN addr USING (key) WHERE key IN (SELECT key FROM inc WHERE d < DATE '1996-01-01')
  UNION SELECT DISTINCT CAST(1999 AS INTEGER), akey FROM addr WHERE p_type = 'LARGE' AND p_size > 40)
SELECT CAST(coalesce(l.cohort, r.cohort) AS INTEGER) AS cohort, CAST(count(*) FILTER (l.akey IS NOT NULL AND r.akey IS NOT NULL) AS BIGINT) AS matched, CAST(count(*) FILTER (r.akey IS NULL) AS BIGINT) AS only_left, CAST(count(*) FILTER (l.akey IS NULL) AS BIGINT) AS only_right
FROM l FULL OUTER JOIN r ON l.cohort = r.cohort AND l.akey = r.akey GROUP BY 1"""
    ),
)
def reconcile_lists(spark, folder):
    """Two membership lists compared per cohort on address keys."""
    a = addressed_parts(spark, folder)
    left = st.program(spark, folder).join(a, "key").select("cohort", "akey")
    early = (
        st.lineitem(spark, folder)
        .where((F.col("l_returnflag") == "R") & (F.col("l_shipdate") < F.lit(EARLY)))
        .select(F.col("l_partkey").alias("key"))
    )
    right = (
        st.program(spark, folder).join(early, "key", "left_semi").join(a, "key").select("cohort", "akey")
    ).unionByName(
        a.where((F.col("p_type") == "LARGE") & (F.col("p_size") > 40)).select(F.lit(1999).alias("cohort"), "akey")
    )
    return resolve.reconcile(left, right, ["cohort", "akey"], ["cohort"])


@query(
    "membership_rollup",
    st.with_base(
        f""", {ADDR_SQL},
m AS (SELECT akey, cohort, make_date(cohort, 7, 1) AS start FROM program JOIN addr USING (key)),
g AS (SELECT akey, min(start) AS first_start, list_sort(list(DISTINCT cohort)) AS cohorts, count(*) AS rows_on_key FROM m GROUP BY akey)
SELECT akey, first_start, array_to_string(cohorts, ',') AS cohorts, CAST(cohorts[1] AS INTEGER) AS first_cohort, CAST(rows_on_key AS BIGINT) AS rows_on_key FROM g"""
    ),
)
def membership_rollup(spark, folder):
    """Earliest start, cohorts and row count per address."""
    rows = st.program(spark, folder).join(addressed_parts(spark, folder), "key")
    rolled = resolve.membership(rows, "akey", "start", "cohort")
    counts = rows.groupBy("akey").agg(F.count("*").alias("rows_on_key"))
    return rolled.join(counts, "akey").select(
        "akey",
        st.date_of("first_start").alias("first_start"),
        F.array_join(F.transform("cohorts", lambda c: c.cast("string")), ",").alias("cohorts"),
        "first_cohort",
        "rows_on_key",
    )


@query(
    "shared_key_rows",
    st.with_base(
        f""", {ADDR_SQL},
k AS (SELECT akey, count(*) AS n FROM program JOIN addr USING (key) GROUP BY akey HAVING count(*) > 1)
SELECT a.akey, a.key, CAST(k.n AS BIGINT) AS rows_on_key FROM k JOIN addr a USING (akey) JOIN program p ON p.key = a.key"""
    ),
)
def shared_key_rows(spark, folder):
    """Programme rows that share one address."""
    rows = st.program(spark, folder).join(addressed_parts(spark, folder), "key")
    return dedupe.shared_keys(rows, "akey", ["key"])


@query(
    "stratified_partial_corr",
    f"""WITH x AS (SELECT {st.unit_class_sql('p_size')} AS u, l_quantity AS a, l_extendedprice AS b FROM lineitem JOIN part ON p_partkey = l_partkey),
r AS (SELECT a - avg(a) OVER (PARTITION BY u) AS ra, b - avg(b) OVER (PARTITION BY u) AS rb FROM x) SELECT CAST(count(*) AS BIGINT) AS n, round(corr(ra, rb), 6) AS partial_corr FROM r""",
)
def stratified_partial_corr(spark, folder):
    """Correlation of two columns after taking out the mean of each unit class.

    Within-class sums of squares and products add up over classes, so no class is held in one task.
    """
    li = st.lineitem(spark, folder).select(F.col("l_partkey").alias("key"), "l_quantity", "l_extendedprice")
    x = li.join(st.unit_classes(spark, folder), "key")
    n = F.count("*")
    per = x.groupBy("unit_class").agg(
        n.alias("n"),
        (F.covar_pop("l_quantity", "l_extendedprice") * n).alias("xy"),
        (F.var_pop("l_quantity") * n).alias("xx"),
        (F.var_pop("l_extendedprice") * n).alias("yy"),
    )
    return st.rounded(
        per.agg(
            F.sum("n").alias("n"), F.try_divide(F.sum("xy"), F.sqrt(F.sum("xx") * F.sum("yy"))).alias("partial_corr")
        )
    )
