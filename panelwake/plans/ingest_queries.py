"""Queries on reading, reconciling and checking feeds."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from panelwake.functions import calendar, keys, numeric, text
from panelwake.operators import dedupe, stats, waterfall
from panelwake.plans import standins as st
from panelwake.plans.registry import query
from panelwake.session import durable, scratch_path
from panelwake.sources import contracts, landing

OVERLAP_LO, OVERLAP_HI = dt.datetime(1998, 1, 1), dt.datetime(1998, 2, 1)
ROW_ID_SQL = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate"


def feeds(spark, folder):
    """An archive and a current feed that overlap by one month."""
    li = st.lineitem(spark, folder)
    return [
        li.where(F.col("l_shipdate") < F.lit(OVERLAP_HI)),
        li.where(F.col("l_shipdate") >= F.lit(OVERLAP_LO)),
    ]


FEEDS_SQL = f"""feeds AS (
  SELECT 0 AS feed, * FROM lineitem WHERE l_shipdate < TIMESTAMP '1998-02-01'
  UNION ALL SELECT 1, * FROM lineitem WHERE l_shipdate >= TIMESTAMP '1998-01-01'),
kept AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {ROW_ID_SQL} ORDER BY feed, l_extendedprice, l_returnflag) AS rn FROM feeds) WHERE rn = 1)"""


@query(
    "scan_whitelist",
    """SELECT o_orderkey, CAST(o_orderdate AS DATE) AS order_day, o_orderpriority, round(o_totalprice, 6) AS o_totalprice, CAST(NULL AS VARCHAR) AS o_comment
FROM orders WHERE (upper(o_orderpriority) LIKE '%URGENT%' OR upper(o_orderpriority) LIKE '%HIGH%') AND o_orderstatus IN ('O', 'P')
  AND upper(o_orderstatus) <> 'F' AND o_orderdate >= TIMESTAMP '1996-06-01' AND o_orderdate < TIMESTAMP '1999-01-01' AND o_orderdate <= TIMESTAMP '1998-10-15' AND month(o_orderdate) IN (10, 11, 12, 1)""",
)
def scan_whitelist(spark, folder):
    """Whitelisted, range-limited, capped and projected scan; a column the files lack is NULL."""
    o = landing.read_table(spark, folder, "orders")
    ts = F.col("o_orderdate")
    rows = o.where(
        landing.contains_any(F.col("o_orderpriority"), ["urgent", "high"])
        & F.col("o_orderstatus").isin("O", "P")
        & (F.upper("o_orderstatus") != "F")
        & landing.half_open(ts, dt.datetime(1996, 6, 1), dt.datetime(1999, 1, 1))
        & (ts <= F.lit(dt.datetime(1998, 10, 15)))
        & calendar.in_months(ts, [10, 11, 12, 1])
    )
    return rows.select(
        "o_orderkey",
        F.to_date(ts).alias("order_day"),
        "o_orderpriority",
        F.round("o_totalprice", 6).alias("o_totalprice"),
        F.lit(None).cast("string").alias("o_comment"),
    )


@query(
    "union_dedupe",
    f"""WITH {FEEDS_SQL}
SELECT CAST((SELECT count(*) FROM feeds) AS BIGINT) AS rows_before, CAST((SELECT count(*) FROM feeds) - count(*) AS BIGINT) AS surplus_removed,
  CAST(count(*) AS BIGINT) AS rows_after, CAST(sum(CASE WHEN l_returnflag IS NULL OR trim(l_returnflag) = '' THEN 1 ELSE 0 END) AS BIGINT) AS blank_entity FROM kept""",
)
def union_dedupe(spark, folder):
    """Archive and current feed united: rows before and after, surplus, rows without entity."""
    return landing.union_report(feeds(spark, folder), st.ROW_ID, "l_returnflag")


@query(
    "union_deliverable",
    f"""WITH {FEEDS_SQL}
SELECT CAST(feed AS INTEGER) AS feed, CAST(year(l_shipdate) AS INTEGER) AS year, CAST(count(*) AS BIGINT) AS rows, round(sum(l_quantity), 6) AS quantity FROM kept GROUP BY ALL""",
)
def union_deliverable(spark, folder):
    """The united rows themselves, the archive winning on equal keys, summed per feed and year."""
    rows = None
    for i, feed in enumerate(feeds(spark, folder)):
        part = feed.withColumn("feed", F.lit(i))
        rows = part if rows is None else rows.unionByName(part)
    kept = dedupe.keep_first(rows, st.ROW_ID, [F.asc("feed"), F.asc("l_extendedprice"), F.asc("l_returnflag")])
    out = kept.groupBy("feed", F.year("l_shipdate").alias("year")).agg(
        F.count("*").alias("rows"), F.sum("l_quantity").alias("quantity")
    )
    return st.rounded(out)


@query(
    "seam_daily",
    f"""WITH {FEEDS_SQL}
SELECT CAST(l_shipdate AS DATE) AS day, CAST(count(*) AS BIGINT) AS n FROM kept WHERE CAST(l_shipdate AS DATE) BETWEEN DATE '1997-12-25' AND DATE '1998-01-07' GROUP BY 1""",
)
def seam_daily(spark, folder):
    """Daily counts of the united feed around the seam."""
    near = [
        f.where(F.col("l_shipdate").between(F.lit(dt.datetime(1997, 12, 25)), F.lit(dt.datetime(1998, 1, 7, 23, 59, 59))))
        for f in feeds(spark, folder)
    ]
    once = near[0].unionByName(near[1]).groupBy(*st.ROW_ID).agg(F.count("*").alias("copies"))
    return landing.daily_counts(once, F.col("l_shipdate"), dt.datetime(1997, 12, 25), dt.date(1998, 1, 7))


def snapshots(spark, folder):
    """Two pulls of the order feed: one before pending orders landed, one without the lowest priority."""
    o = landing.read_table(spark, folder, "orders")
    return o.where(F.col("o_orderstatus") != "P"), o.where(F.col("o_orderpriority") != "5-LOW")


@query(
    "refresh_diff",
    """WITH o AS (SELECT * FROM orders WHERE o_orderstatus <> 'P'), n AS (SELECT * FROM orders WHERE o_orderpriority <> '5-LOW'),
x AS (SELECT (SELECT count(*) FROM n WHERE CAST(o_orderdate AS DATE) <= (SELECT CAST(max(o_orderdate) AS DATE) FROM o) AND o_orderkey NOT IN (SELECT o_orderkey FROM o)) AS late,
  (SELECT count(*) FROM o WHERE o_orderkey NOT IN (SELECT o_orderkey FROM n)) AS gone, (SELECT count(*) FROM o) AS old_rows)
SELECT CAST(late AS BIGINT) AS late_arrivals, CAST(gone AS BIGINT) AS disappeared, CAST(old_rows AS BIGINT) AS old_rows, CASE WHEN gone > 0.01 * old_rows THEN 'STOP' ELSE 'OK' END AS verdict FROM x""",
)
def refresh_diff(spark, folder):
    """Late arrivals and disappeared keys between two pulls, with the one-per-cent rule."""
    old, new = snapshots(spark, folder)
    return landing.snapshot_diff(old, new, ["o_orderkey"], "o_orderdate")


@query(
    "refresh_daily",
    """WITH o AS (SELECT CAST(o_orderdate AS DATE) AS day FROM orders WHERE o_orderstatus <> 'P'), n AS (SELECT CAST(o_orderdate AS DATE) AS day FROM orders WHERE o_orderpriority <> '5-LOW'),
e AS (SELECT max(day) - 13 AS lo FROM o),
a AS (SELECT day, count(*) AS c FROM o, e WHERE day >= lo GROUP BY day), b AS (SELECT day, count(*) AS c FROM n, e WHERE day >= lo GROUP BY day)
SELECT coalesce(a.day, b.day) AS day, CAST(coalesce(a.c, 0) AS BIGINT) AS old_rows, CAST(coalesce(b.c, 0) AS BIGINT) AS new_rows FROM a FULL OUTER JOIN b ON a.day = b.day""",
)
def refresh_daily(spark, folder):
    """Old and new daily counts over the last days of the old pull."""
    old, new = snapshots(spark, folder)
    return landing.snapshot_daily(old, new, "o_orderdate")


PARTS = [
    (dt.datetime(1995, 1, 1), dt.datetime(1996, 7, 1)),
    (dt.datetime(1996, 7, 1), dt.datetime(1998, 1, 1)),
    (dt.datetime(1998, 1, 1), dt.datetime(1999, 1, 1)),
    (dt.datetime(1999, 1, 1), None),
]


@query(
    "parts_assembly",
    """WITH t AS (SELECT l_orderkey, CASE WHEN l_shipdate < TIMESTAMP '1995-01-01' THEN NULL WHEN l_shipdate < TIMESTAMP '1996-07-01' THEN 1 WHEN l_shipdate < TIMESTAMP '1998-01-01' THEN 2 WHEN l_shipdate < TIMESTAMP '1999-01-01' THEN 3 ELSE 4 END AS part FROM lineitem),
r AS (SELECT part, count(*) AS n FROM t GROUP BY part), k AS (SELECT l_orderkey, min(part) AS part FROM t GROUP BY l_orderkey HAVING count(DISTINCT part) > 1),
c AS (SELECT part, count(*) AS n FROM k GROUP BY part)
SELECT CAST(r.part AS INTEGER) AS part, CAST(r.n AS BIGINT) AS rows, CAST(coalesce(c.n, 0) AS BIGINT) AS crossing_keys FROM r LEFT JOIN c ON r.part = c.part""",
)
def parts_assembly(spark, folder):
    """Half-open date parts, their sizes, and keys that appear in more than one."""
    return landing.parts_report(st.lineitem(spark, folder), F.col("l_shipdate"), PARTS, ["l_orderkey"])


@query(
    "source_profile",
    """SELECT l_returnflag, CAST(count(*) AS BIGINT) AS rows, CAST(min(l_shipdate) AS DATE) AS first_day, CAST(max(l_shipdate) AS DATE) AS last_day,
  CAST(count(*) FILTER (l_linestatus = 'O') AS BIGINT) AS open_rows, CAST(count(*) FILTER (l_partkey IS NULL) AS BIGINT) AS null_key, CAST(count(DISTINCT l_partkey) AS BIGINT) AS distinct_keys FROM lineitem GROUP BY l_returnflag""",
)
def source_profile(spark, folder):
    """Rows, first and last day, class split, missing and distinct keys per source."""
    return st.lineitem(spark, folder).groupBy("l_returnflag").agg(
        F.count("*").alias("rows"),
        F.to_date(F.min("l_shipdate")).alias("first_day"),
        F.to_date(F.max("l_shipdate")).alias("last_day"),
        F.count_if(F.col("l_linestatus") == "O").alias("open_rows"),
        F.count_if(F.col("l_partkey").isNull()).alias("null_key"),
        F.count_distinct("l_partkey").alias("distinct_keys"),
    )


@query(
    "panel_verify",
    st.with_base(
        """,
e AS (SELECT season, count(DISTINCT key) AS n, count(DISTINCT CASE WHEN flag = 'R' AND status = 'O' THEN key END) AS p FROM li WHERE season IS NOT NULL GROUP BY season),
f AS (SELECT season, count(*) AS n, sum(label_c) AS p FROM spine GROUP BY season)
SELECT CAST(e.season AS INTEGER) AS season, CAST(f.n AS BIGINT) AS found_rows, CAST(f.p AS BIGINT) AS found_positives, CAST(e.n AS BIGINT) AS expected_rows, CAST(e.p AS BIGINT) AS expected_positives, e.n = f.n AND e.p = f.p AS match FROM e JOIN f ON e.season = f.season"""
    ),
)
def panel_verify(spark, folder):
    """Rows and positives per season of the panel against counts taken from the events."""
    found = st.spine(spark, folder).groupBy("season").agg(
        F.count("*").alias("rows"), F.sum("label_c").alias("positives")
    )
    li = st.lineitem(spark, folder).withColumn("season", calendar.season_of(F.to_date("l_shipdate")))
    back = (F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "O")
    expected = (
        li.where(F.col("season").isNotNull())
        .groupBy("season", "l_partkey")
        .agg(F.max(back).alias("back"))
        .groupBy("season")
        .agg(F.count("*").alias("rows"), F.count_if("back").alias("positives"))
    )
    return contracts.compare_counts(found, expected, ["season"], ["rows", "positives"])


@query(
    "frame_invariants",
    st.with_base(
        """ SELECT CAST(count(*) AS BIGINT) AS rows, CAST(count(*) - count(DISTINCT (key, season)) AS BIGINT) AS repeated_keys, CAST(count(*) FILTER (label_c IS NULL) AS BIGINT) AS null_label_c,
 CAST(count(*) FILTER (label_bc IS NULL) AS BIGINT) AS null_label_bc, CAST(max(season) AS INTEGER) AS last_period FROM spine"""
    ),
)
def frame_invariants(spark, folder):
    """Row count, repeated keys, missing labels and last season of the panel."""
    return contracts.frame_invariants(st.spine(spark, folder), ["key", "season"], ["label_c", "label_bc"], "season")


@query(
    "conflict_exclusion",
    """WITH k AS (SELECT o_custkey, count(DISTINCT o_orderstatus) AS d FROM orders GROUP BY o_custkey)
SELECT CAST(count(*) AS BIGINT) AS keys, CAST(count(*) FILTER (d > 1) AS BIGINT) AS conflicting_keys, CAST(count(*) FILTER (d = 1) AS BIGINT) AS usable_keys,
  CAST((SELECT count(*) FROM orders WHERE o_custkey IS NULL OR o_orderstatus IS NULL) AS BIGINT) AS unusable_rows FROM k""",
)
def conflict_exclusion(spark, folder):
    """Keys with more than one distinct value of an attribute that should be unique."""
    return dedupe.conflicts(landing.read_table(spark, folder, "orders"), "o_custkey", "o_orderstatus")


@query(
    "array_rows_to_table",
    """SELECT s_suppkey AS doc, CAST(0 AS INTEGER) AS row_no, s_name AS name, CASE WHEN s_acctbal >= 0 THEN round(s_acctbal, 6) END AS balance, lpad(CAST(s_nationkey AS VARCHAR), 3, '0') AS county FROM supplier""",
)
def array_rows_to_table(spark, folder):
    """Documents of the form [[header], [row], ...]; columns found by header name, negatives NULL."""
    s = landing.read_table(spark, folder, "supplier")
    header = F.array(F.lit("NAME"), F.lit("county"), F.lit("B001E"))
    row = F.array("s_name", F.col("s_nationkey").cast("string"), F.col("s_acctbal").cast("string"))
    docs = s.select(F.col("s_suppkey").alias("doc"), F.to_json(F.array(header, row)).alias("body"))
    out = landing.rows_from_arrays(
        docs,
        "body",
        {"NAME": "name", "B001E": "balance", "county": "county"},
        keep=["doc"],
        numbers=["B001E"],
        pad={"county": 3},
    )
    return st.rounded(out)


BORO = {"SMALL": "MN", "MEDIUM": "BX", "LARGE": "BK", "ECONOMY": "QN", "PROMO": "SI", "STANDARD": "XX"}
BORO_SQL = "CASE p_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in BORO.items()) + " END"


@query(
    "extract_listing_rows",
    f"""WITH p AS (SELECT *, {BORO_SQL} AS boro FROM part),
l AS (
  SELECT p_partkey AS doc, 0 AS line_no, 'header' AS kind, NULL AS boro, NULL AS house_number, NULL AS street, NULL AS units FROM p
  UNION ALL SELECT p_partkey, 1, CASE WHEN boro = 'XX' THEN 'residue' ELSE 'row' END, CASE WHEN boro <> 'XX' THEN boro END, CASE WHEN boro <> 'XX' THEN CAST(p_partkey AS VARCHAR) || 'A' END,
    CASE WHEN boro <> 'XX' THEN upper(p_name) END, CASE WHEN boro <> 'XX' THEN p_size END FROM p
  UNION ALL SELECT p_partkey, 3, 'residue', NULL, NULL, NULL, NULL FROM p
  UNION ALL SELECT p_partkey, 4, 'header', NULL, NULL, NULL, NULL FROM p)
SELECT doc, CAST(line_no AS INTEGER) AS line_no, kind, boro, house_number, street, CAST(units AS INTEGER) AS units FROM l""",
)
def extract_listing_rows(spark, folder):
    """Listing texts cut into lines: captured rows, headers and residue."""
    p = st.parts(spark, folder)
    code = keys.recode(F.col("p_type"), BORO)
    row = F.concat_ws(
        " ", code, F.concat(F.col("p_partkey").cast("string"), F.lit("A")), F.replace("p_name", F.lit(" "), F.lit("  ")),
        F.lit("7"), F.lit("12"), F.concat(F.col("p_size").cast("string"), F.lit("  ")),
    )
    body = F.concat_ws("\n", F.lit("Borough  House  Street"), row, F.lit("  "), F.col("p_brand"), F.lit("1 of 4"))
    docs = p.select(F.col("p_partkey").alias("doc"), body.alias("body"))
    return landing.listing_lines(docs, "body", ["doc"]).drop("line")


SPACE_RE = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
UPPER_SQL = "upper(replace(coalesce({c}, ''), 'ß', 'ss'))"


@query(
    "normalize_text",
    f"""SELECT doc_id, md5(t) AS digest, CAST(length(t) AS INTEGER) AS chars FROM (SELECT doc_id, trim(regexp_replace({UPPER_SQL.format(c='text')}, '{SPACE_RE}', ' ', 'g')) AS t FROM documents)""",
)
def normalize_text(spark, folder):
    """Upper case, trimmed, single spaces, over whole texts."""
    d = landing.read_table(spark, folder, "documents")
    t = text.normalize_text("text")
    return d.select("doc_id", F.md5(t).alias("digest"), F.length(t).alias("chars"))


ORDINAL = r"(^|[^\p{L}\p{N}_])(\p{Nd}+)(ST|ND|RD|TH)($|[^\p{L}\p{N}_])"
WORDS_SQL = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in text.STREET_WORDS.items()) + "}"


def street_sql(c: str) -> str:
    upper = f"upper(replace({c}, 'ß', 'ss'))"
    flat = f"trim(regexp_replace(replace({upper}, '.', ' '), '{SPACE_RE}', ' ', 'g'))"
    once = rf"regexp_replace({flat}, '{ORDINAL}', '\1\2\4', 'g')"
    twice = rf"regexp_replace({once}, '{ORDINAL}', '\1\2\4', 'g')"
    return f"array_to_string(list_transform(string_split({twice}, ' '), lambda w: coalesce({WORDS_SQL}[w], w)), ' ')"


@query(
    "normalize_street",
    f"""SELECT conv_id, turn, md5({street_sql("t")}) AS digest, CAST(length({street_sql("t")}) AS INTEGER) AS chars
FROM (SELECT conv_id, turn, 'E. ' || conv_id || 'th St ' || turn || 'nd Av, ' || text AS t FROM conversations)""",
)
def normalize_street(spark, folder):
    """Ordinals stripped and street words expanded, over whole texts with an address in front."""
    c = landing.read_table(spark, folder, "conversations")
    raw = F.concat(F.lit("E. "), "conv_id", F.lit("th St "), "turn", F.lit("nd Av, "), "text")
    t = text.normalize_street(raw)
    return c.select("conv_id", "turn", F.md5(t).alias("digest"), F.length(t).alias("chars"))


@query(
    "season_calendar",
    f"""WITH d AS (SELECT CAST(l_shipdate AS DATE) AS d, count(*) AS n FROM lineitem GROUP BY 1)
SELECT d AS date, CAST(n AS BIGINT) AS rows, CAST(date_diff('day', DATE '1970-01-01', d) AS INTEGER) AS day_number, CAST({st.season_sql('d')} AS INTEGER) AS season,
  CASE WHEN {st.season_sql('d')} IS NOT NULL THEN CAST({st.season_sql('d')} AS VARCHAR) || '-' || lpad(CAST(({st.season_sql('d')} + 1) % 100 AS VARCHAR), 2, '0') END AS label,
  CAST(year(d) AS INTEGER) AS year, CAST(month(d) AS INTEGER) AS month,
  make_date({st.season_sql('d')}, 10, 1) AS cutoff, make_date({st.season_sql('d')}, 10, 1) - 365 AS edge365, make_date({st.season_sql('d')}, 10, 1) - 730 AS edge730, CAST({st.season_sql('d')} - 1994 AS INTEGER) AS horizon FROM d""",
)
def season_calendar(spark, folder):
    """Season, label, cutoff and trailing edges of every day that has rows."""
    d = st.lineitem(spark, folder).groupBy(F.to_date("l_shipdate").alias("date")).agg(F.count("*").alias("rows"))
    s = calendar.season_of("date")
    cut = calendar.cutoff(s)
    return d.select(
        "date",
        "rows",
        calendar.day_number("date").alias("day_number"),
        s.alias("season"),
        F.when(s.isNotNull(), calendar.season_label(s)).alias("label"),
        F.year("date").alias("year"),
        F.month("date").alias("month"),
        cut.alias("cutoff"),
        F.date_sub(cut, 365).alias("edge365"),
        F.date_sub(cut, 730).alias("edge730"),
        (s - 1994).alias("horizon"),
    )


@query(
    "entity_keys",
    f"""SELECT p_partkey, CAST(p_size AS BIGINT) AS key_plain, CASE WHEN p_size > 25 THEN CAST(p_size AS BIGINT) END AS key_positive,
  CAST('1' || lpad(CAST(p_size AS VARCHAR), 5, '0') || lpad(CAST(p_partkey % 10000 AS VARCHAR), 4, '0') AS BIGINT) AS composite,
  substr(p_name, 1, 1) AS letter, CAST(floor(p_partkey / 100) AS BIGINT) AS leading, {BORO_SQL} AS boro, {st.unit_class_sql('p_size')} AS unit_class,
  CASE WHEN p_size - 25 > 0 THEN round(p_retailprice / (p_size - 25), 6) END AS safe_ratio, CAST(1999 - (1000 + floor(p_retailprice)) AS INTEGER) AS age,
  CASE WHEN 1000 + floor(p_retailprice) < 1940 THEN 1 ELSE 0 END AS prewar, format('{{:.1f}}%', 100.0 * p_size / 50) AS pct FROM part""",
)
def entity_keys(spark, folder):
    """Key hygiene, composite keys, recodes, bins and guarded arithmetic on every entity."""
    p = st.parts(spark, folder)
    size = F.col("p_size")
    built = (F.lit(1000) + F.floor("p_retailprice")).cast("int")
    signed = F.concat(F.when(size > 25, F.lit("")).otherwise(F.lit("-")), size.cast("string"), F.lit(".00000000"))
    return p.select(
        "p_partkey",
        keys.normalize_key(F.concat(size.cast("string"), F.lit(".00000000")), False).alias("key_plain"),
        keys.normalize_key(signed).alias("key_positive"),
        keys.composite_key(F.lit("1"), size.cast("string"), (F.col("p_partkey") % 10000).cast("string")).alias("composite"),
        keys.first_letter("p_name").alias("letter"),
        keys.leading_part("p_partkey", 100).alias("leading"),
        keys.recode(F.col("p_type"), BORO).alias("boro"),
        numeric.unit_class("p_size").alias("unit_class"),
        F.round(numeric.ratio(F.col("p_retailprice"), size - 25), 6).alias("safe_ratio"),
        numeric.building_age(F.lit(1999), built).alias("age"),
        numeric.prewar(built).alias("prewar"),
        numeric.percent_text(size, F.lit(50)).alias("pct"),
    )


@query(
    "key_universe_diff",
    """WITH a AS (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY 1), b AS (SELECT c_custkey AS k, count(*) AS n FROM customer GROUP BY 1),
j AS (SELECT coalesce(a.k, b.k) AS k, coalesce(a.n, 0) AS l, coalesce(b.n, 0) AS r FROM a FULL OUTER JOIN b ON a.k = b.k)
SELECT CAST(count(*) AS BIGINT) AS keys, CAST(count(*) FILTER (r = 0) AS BIGINT) AS only_left, CAST(count(*) FILTER (l = 0) AS BIGINT) AS only_right, CAST(count(*) FILTER (l > 1 OR r > 1) AS BIGINT) AS repeated FROM j""",
)
def key_universe_diff(spark, folder):
    """Keys of the order feed against the customer universe, both ways."""
    o = landing.read_table(spark, folder, "orders").select(F.col("o_custkey").alias("k"))
    c = landing.read_table(spark, folder, "customer").select(F.col("c_custkey").alias("k"))
    return contracts.alignment(o, c, ["k"])


@query(
    "set_operations",
    """WITH a AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_returnflag = 'R'), b AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_returnflag = 'N')
SELECT 'minus' AS op, CAST(count(*) AS BIGINT) AS keys FROM (SELECT k FROM a EXCEPT SELECT k FROM b) UNION ALL SELECT 'intersect', CAST(count(*) AS BIGINT) FROM (SELECT k FROM a INTERSECT SELECT k FROM b)
UNION ALL SELECT 'union', CAST(count(*) AS BIGINT) FROM (SELECT k FROM a UNION SELECT k FROM b) UNION ALL SELECT 'symmetric', CAST(count(*) AS BIGINT) FROM ((SELECT k FROM a EXCEPT SELECT k FROM b) UNION ALL (SELECT k FROM b EXCEPT SELECT k FROM a))""",
)
def set_operations(spark, folder):
    """Difference, intersection, union and symmetric difference of two key sets, in one aggregate."""
    li = st.lineitem(spark, folder)
    side = lambda f: F.max((F.col("l_returnflag") == f).cast("int"))
    per_key = li.groupBy("l_partkey").agg(side("R").alias("a"), side("N").alias("b"))
    a, b = F.col("a") == 1, F.col("b") == 1
    one = per_key.agg(
        F.count_if(a & ~b).alias("minus"),
        F.count_if(a & b).alias("intersect"),
        F.count_if(a | b).alias("union"),
        F.count_if(a != b).alias("symmetric"),
    )
    return one.unpivot([], ["minus", "intersect", "union", "symmetric"], "op", "keys")


@query(
    "guard_rollup",
    st.with_base(
        """,
t AS (SELECT flag || status AS site, list_sort(list(DISTINCT season)) AS touched FROM li WHERE season IS NOT NULL GROUP BY 1)
SELECT CAST(count(*) AS BIGINT) AS passes, CAST(count(DISTINCT site) AS BIGINT) AS sites, CAST(max(list_max(touched)) AS INTEGER) AS last_touched, CAST(count(*) FILTER (list_max(touched) > 2000) AS BIGINT) AS beyond FROM t"""
    ),
)
def guard_rollup(spark, folder):
    """Seasons each source touches, guarded, logged, and rolled up from the log."""
    log = scratch_path(spark, "audit")
    li = st.lineitem(spark, folder).select(
        F.concat("l_returnflag", "l_linestatus").alias("site"),
        calendar.season_of(F.to_date("l_shipdate")).alias("season"),
    )
    per_site = durable(li.where(F.col("season").isNotNull()).distinct())
    allowed = list(range(1990, 2010))
    for r in per_site.select("site").distinct().orderBy("site").collect():  # a handful of streams
        own = per_site.where(F.col("site") == r["site"])
        touched = waterfall.guard_periods(own, "season", r["site"], allowed, allowed[-1] + 1)
        landing.append_audit(spark, log, r["site"], touched, allowed)
    per_site = spark.read.schema("site string, touched array<int>, allowed array<int>").json(log)
    last = F.array_max("touched")
    return per_site.agg(
        F.count("*").alias("passes"),
        F.count_distinct("site").alias("sites"),
        F.max(last).alias("last_touched"),
        F.count_if(last > st.LAST_SEASON).alias("beyond"),
    )


@query(
    "null_audit",
    """WITH j AS (SELECT o.*, c.c_mktsegment, c.c_acctbal FROM (SELECT o_orderkey, o_custkey FROM orders) o LEFT JOIN customer c ON c_custkey = o_custkey)
SELECT "column", CAST(nulls AS BIGINT) AS nulls, round(100.0 * nulls::DOUBLE / n, 6) AS null_pct FROM (
SELECT 'o_custkey' AS "column", count(*) FILTER (o_custkey IS NULL) AS nulls, count(*) AS n FROM j UNION ALL SELECT 'c_mktsegment', count(*) FILTER (c_mktsegment IS NULL), count(*) FROM j UNION ALL SELECT 'c_acctbal', count(*) FILTER (c_acctbal IS NULL), count(*) FROM j)""",
)
def null_audit(spark, folder):
    """NULL rows per column of a joined frame."""
    o = landing.read_table(spark, folder, "orders", ["o_orderkey", "o_custkey"])
    c = landing.read_table(spark, folder, "customer")
    j = o.join(c, o["o_custkey"] == c["c_custkey"], "left")
    return st.rounded(stats.null_audit(j, ["o_custkey", "c_mktsegment", "c_acctbal"]))
