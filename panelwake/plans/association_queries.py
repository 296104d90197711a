"""Queries on incidents and the events before them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwake.functions import calendar
from panelwake.operators import association as assoc
from panelwake.operators import stats, waterfall
from panelwake.plans import standins as st
from panelwake.plans.registry import query

DIST_SQL = """
  CAST(count(*) AS BIGINT) AS n, round(CAST(quantile_cont({v}, 0.5) AS DOUBLE), 6) AS median,
  round(CAST(quantile_cont({v}, 0.25) AS DOUBLE), 6) AS p25, round(CAST(quantile_cont({v}, 0.75) AS DOUBLE), 6) AS p75,
  round(avg({v}), 6) AS mean, round(100.0 * CAST(sum(CASE WHEN {v} >= 2 THEN 1 ELSE 0 END) AS DOUBLE) / count(*), 6) AS pct_ge2
""".strip()

COUNTS_SQL = """,
looks AS (SELECT unnest([90, 180]) AS days),
cnt AS (
  SELECT i.rid, i.key, i.d, i.season, w.days, count(e.rid) AS n
  FROM elig i CROSS JOIN looks w LEFT JOIN evt e ON e.key = i.key AND e.d BETWEEN i.d - w.days AND i.d
  GROUP BY ALL)
"""


def stacked(tl: DataFrame, windows: list[int], *keep: str | Column) -> DataFrame:
    """Incident days once per look-back: days, value, weight."""
    rows = assoc.associate(tl, "n_inc", "n_evt", windows)
    pairs = F.array(*[F.struct(F.lit(w).alias("days"), F.col(f"n_{w}").alias("value")) for w in windows])
    return rows.select(*keep, F.col("n_inc").alias("w"), F.explode(pairs).alias("x")).select(
        "*", "x.days", "x.value"
    ).drop("x")


@query(
    "assoc_counts_by_unit_class",
    st.with_base(
        COUNTS_SQL
        + f"""SELECT unit_class, CAST(days AS INTEGER) AS days, {DIST_SQL.format(v='n')}
FROM (SELECT cnt.*, {st.unit_class_sql('p_size')} AS unit_class FROM cnt LEFT JOIN part ON p_partkey = key)
GROUP BY unit_class, days"""
    ),
)
def assoc_counts_by_unit_class(spark, folder):
    """Events before an incident, per unit class and look-back."""
    rows = stacked(st.eligible_timeline(spark, folder), st.LOOK_BACKS, "key")
    hist = stats.histogram_of(rows, ["key", "days"], F.col("value"), F.col("w"))
    classed = hist.join(st.unit_classes(spark, folder), "key", "left").withColumn(
        "unit_class", F.coalesce("unit_class", F.lit("unmatched"))
    )
    merged = stats.histogram_of(classed, ["unit_class", "days"], F.col("value"), F.col("n"))
    return st.rounded(merged.groupBy("unit_class", "days").agg(*stats.distribution()))


@query(
    "assoc_grouping_sets",
    st.with_base(
        COUNTS_SQL
        + f"""SELECT CAST(days AS INTEGER) AS days, CASE WHEN grouping(unit_class) = 1 THEN 'all' ELSE unit_class END AS unit_class,
  CASE WHEN grouping(season) = 1 THEN 'all' ELSE CAST(season AS VARCHAR) || '-' || lpad(CAST((season + 1) % 100 AS VARCHAR), 2, '0') END AS season,
  {DIST_SQL.format(v='n')},
  round(100.0 * CAST(sum(CASE WHEN n = 0 THEN 1 ELSE 0 END) AS DOUBLE) / count(*), 6) AS pct_zero
FROM (SELECT cnt.*, {st.unit_class_sql('p_size')} AS unit_class FROM cnt LEFT JOIN part ON p_partkey = key)
GROUP BY GROUPING SETS ((days), (days, unit_class), (days, season), (days, unit_class, season))"""
    ),
)
def assoc_grouping_sets(spark, folder):
    """The same distribution pooled, by class, by season and by both, in one aggregate."""
    rows = stacked(st.eligible_timeline(spark, folder), st.LOOK_BACKS, "key", "day")
    season = st.season_of_day("day").alias("season")
    hist = stats.histogram_of(rows, ["key", season, "days"], F.col("value"), F.col("w"))
    classed = hist.join(st.unit_classes(spark, folder), "key", "left").withColumn(
        "unit_class", F.coalesce("unit_class", F.lit("unmatched"))
    )
    fine = stats.histogram_of(
        classed, ["days", "unit_class", "season"], F.col("value"), F.col("n")
    ).withColumn("season", calendar.season_label("season"))
    d, u, s = F.col("days"), F.col("unit_class"), F.col("season")
    sets = fine.groupingSets([[d], [d, u], [d, s], [d, u, s]], d, u, s).agg(
        *stats.distribution(), stats.zero_share().alias("pct_zero")
    )
    return st.rounded(sets.na.fill("all", ["unit_class", "season"]))


@query(
    "assoc_multiplicity",
    st.with_base(
        """,
looks AS (SELECT unnest([90, 180]) AS days),
a AS (SELECT e.rid, w.days, count(i.rid) AS m FROM evt e CROSS JOIN looks w
      LEFT JOIN elig i ON i.key = e.key AND i.d BETWEEN e.d AND e.d + w.days GROUP BY ALL),
b AS (SELECT w.days, count(*) AS pairs FROM elig i CROSS JOIN looks w JOIN evt e
      ON e.key = i.key AND e.d BETWEEN i.d - w.days AND i.d GROUP BY ALL)
SELECT CAST(a.days AS INTEGER) AS days, CAST(sum(CASE WHEN m >= 1 THEN 1 ELSE 0 END) AS BIGINT) AS matched_events,
  CAST(sum(CASE WHEN m >= 2 THEN 1 ELSE 0 END) AS BIGINT) AS matched_twice,
  round(100.0 * sum(CASE WHEN m >= 2 THEN 1 ELSE 0 END)::DOUBLE / greatest(sum(CASE WHEN m >= 1 THEN 1 ELSE 0 END), 1), 6) AS multiplicity_pct,
  CAST(max(b.pairs) AS BIGINT) AS pairs_incident_side, CAST(sum(m) AS BIGINT) AS pairs_event_side
FROM a JOIN b ON a.days = b.days GROUP BY a.days"""
    ),
)
def assoc_multiplicity(spark, folder):
    """How many incidents an event belongs to; pair totals counted from both sides."""
    tl = st.eligible_timeline(spark, folder)
    return st.rounded(assoc.multiplicity_rates(tl, "n_inc", "n_evt", st.LOOK_BACKS))


@query(
    "assoc_lag_quantiles",
    st.with_base(
        """,
p AS (SELECT i.season, date_diff('day', e.d, i.d) AS lag FROM elig i JOIN evt e ON e.key = i.key AND e.d BETWEEN i.d - 90 AND i.d)
SELECT CASE WHEN grouping(season) = 1 THEN 'all' ELSE CAST(season AS VARCHAR) END AS season, CAST(count(*) AS BIGINT) AS n,
  round(CAST(quantile_cont(lag, 0.5) AS DOUBLE), 6) AS median, round(CAST(quantile_cont(lag, 0.75) AS DOUBLE), 6) AS p75,
  round(CAST(quantile_cont(lag, 0.9) AS DOUBLE), 6) AS p90
FROM p GROUP BY GROUPING SETS ((), (season))"""
    ),
)
def assoc_lag_quantiles(spark, folder):
    """Days between events and the incidents they precede, from weights instead of pairs."""
    tl = st.eligible_timeline(spark, folder)
    inc = tl.where(F.col("n_inc") > 0).select(
        "key", "day", F.col("n_inc").alias("n"), st.season_of_day("day").alias("season")
    )
    evt = st.day_timeline(spark, folder, "n_evt").select("key", "day", F.col("n_evt").alias("n"))
    weights = assoc.lag_weights(inc, evt, 90, ["season"])
    s = F.col("season")
    out = weights.withColumn("season", s.cast("string"))
    sets = out.groupingSets([[], [s]], s).agg(*stats.lag_distribution("lag", "pairs"))
    return st.rounded(sets.na.fill("all", ["season"]))


@query(
    "first_incident_after_event",
    st.with_base(
        """,
f AS (SELECT e.rid, min(date_diff('day', e.d, i.d)) AS lag FROM evt e LEFT JOIN elig i ON i.key = e.key AND i.d BETWEEN e.d AND e.d + 90 GROUP BY e.rid)
SELECT CAST(lag AS INTEGER) AS lag, CAST(count(*) AS BIGINT) AS events FROM f GROUP BY lag"""
    ),
)
def first_incident_after_event(spark, folder):
    """Days from an event to the next incident within 90 days; NULL where none follows."""
    tl = st.eligible_timeline(spark, folder)
    rows = tl.withColumn("first", assoc.first_ahead("n_inc", 90)).where(F.col("n_evt") > 0)
    return rows.groupBy((F.col("first") - F.col("day")).alias("lag")).agg(
        F.sum("n_evt").alias("events")
    )


@query(
    "incident_rows_per_day",
    st.with_base(
        """,
g AS (SELECT key, d, count(*) AS n FROM elig GROUP BY key, d)
SELECT CAST(count(*) AS BIGINT) AS entity_days, round(avg(n), 6) AS mean,
  round(100.0 * sum(CASE WHEN n >= 2 THEN 1 ELSE 0 END)::DOUBLE / count(*), 6) AS pct_ge2, CAST(max(n) AS BIGINT) AS most FROM g"""
    ),
)
def incident_rows_per_day(spark, folder):
    """Incident rows per entity and day."""
    g = st.eligible_timeline(spark, folder).where(F.col("n_inc") > 0)
    n = F.col("n_inc")
    return st.rounded(
        g.agg(
            F.count("*").alias("entity_days"),
            F.avg(n).alias("mean"),
            (100.0 * F.count_if(n >= 2) / F.count("*")).alias("pct_ge2"),
            F.max(n).alias("most"),
        )
    )


@query(
    "gate_branch",
    st.with_base(
        COUNTS_SQL
        + """,
g AS (SELECT cnt.days, n FROM cnt JOIN part ON p_partkey = key WHERE p_size >= 10),
m AS (SELECT count(*) FILTER (days = 90) AS n, quantile_cont(n, 0.5) FILTER (days = 90) AS s, quantile_cont(n, 0.5) FILTER (days = 180) AS l FROM g)
SELECT CAST(n AS BIGINT) AS n, round(CAST(s AS DOUBLE), 6) AS median_short, round(CAST(l AS DOUBLE), 6) AS median_long,
  CASE WHEN s >= 2 THEN 'PASS' WHEN l >= 2 THEN 'HOLD' ELSE 'KILL' END AS branch,
  CASE WHEN n >= 30 THEN 'PASS' ELSE 'DEGRADE' END AS floor_verdict FROM m"""
    ),
)
def gate_branch(spark, folder):
    """Median events for entities with ten units or more, and the decision drawn from it."""
    rows = stacked(st.eligible_timeline(spark, folder), st.LOOK_BACKS, "key")
    hist = stats.histogram_of(rows, ["key", "days"], F.col("value"), F.col("w"))
    large = st.unit_classes(spark, folder).where(F.col("units") >= 10).select("key")
    h = stats.histogram_of(hist.join(large, "key", "left_semi"), ["days"], F.col("value"), F.col("n"))
    per = h.groupBy("days").agg(
        F.sum("n").alias("n"), F.percentile("value", F.lit(0.5), F.col("n")).alias("median")
    )
    at = lambda w, c: F.max(F.when(F.col("days") == w, F.col(c)))
    one = per.agg(
        at(90, "n").alias("n"), at(90, "median").alias("median_short"), at(180, "median").alias("median_long")
    )
    return st.rounded(
        one.withColumn("branch", stats.gate_branch(F.col("median_short"), F.col("median_long"))).withColumn(
            "floor_verdict", stats.floor_verdict(F.col("n"))
        )
    )


@query(
    "exclusion_waterfall",
    f"""WITH r AS (
  SELECT *, CAST(l_shipdate AS DATE) AS d, {st.season_sql('CAST(l_shipdate AS DATE)')} AS season,
    row_number() OVER (PARTITION BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_linestatus) AS copy
  FROM lineitem WHERE l_returnflag = 'R'),
cov AS (SELECT min(CAST(l_shipdate AS DATE)) AS lo, max(CAST(l_shipdate AS DATE)) AS hi FROM lineitem WHERE l_returnflag = 'N'),
t AS (SELECT CASE WHEN l_linestatus <> 'O' THEN 'not_in_class' WHEN copy > 1 THEN 'duplicate_id' WHEN l_partkey IS NULL OR l_partkey < 0 THEN 'bad_key'
  WHEN d - 180 < lo THEN 'coverage_left_edge' WHEN d > hi THEN 'coverage_right_edge' WHEN season IS NULL THEN 'off_season'
  WHEN season NOT BETWEEN 1995 AND 2000 THEN 'season_out_of_list' ELSE 'kept' END AS reason FROM r, cov),
names AS (SELECT unnest(range(8)) AS step, unnest(['not_in_class', 'duplicate_id', 'bad_key', 'coverage_left_edge', 'coverage_right_edge', 'off_season', 'season_out_of_list', 'kept']) AS reason)
SELECT CAST(step AS INTEGER) AS step, names.reason, CAST(count(t.reason) AS BIGINT) AS rows FROM names LEFT JOIN t ON t.reason = names.reason GROUP BY step, names.reason""",
)
def exclusion_waterfall(spark, folder):
    """Incident rows lost at each step, every row counted once."""
    rows = (
        st.lineitem(spark, folder)
        .where(F.col("l_returnflag") == "R")
        .groupBy(*st.ROW_ID, "l_linestatus")
        .agg(F.count("*").alias("copies"))
        .withColumn("day", st.ship_day())
    )
    once = F.struct(F.lit(1).cast("long").alias("w"), F.lit(False).alias("again"))
    more = F.struct((F.col("copies") - 1).alias("w"), F.lit(True).alias("again"))
    weighted = rows.select("*", F.explode(F.array(once, more)).alias("x")).where(F.col("x.w") > 0)
    left, right = assoc.edges(st.spans(spark, folder, "n_evt"), {"n_evt": st.WIDEST})
    season = st.season_of_day("day")
    flagged = weighted.withColumns({"left": left, "right": right, "season": season})
    steps = [
        ("not_in_class", F.col("l_linestatus") != "O"),
        ("duplicate_id", F.col("x.again")),
        ("bad_key", F.col("l_partkey").isNull() | (F.col("l_partkey") < 0)),
        ("coverage_left_edge", F.col("left")),
        ("coverage_right_edge", F.col("right")),
        ("off_season", F.col("season").isNull()),
        ("season_out_of_list", ~F.col("season").between(st.FIRST_SEASON, st.LAST_SEASON)),
    ]
    return waterfall.waterfall_counts(flagged, steps, F.col("x.w"))


PROGRAM_SQL = """,
h AS (SELECT inc.*, cohort, make_date(cohort, 7, 1) AS start FROM inc JOIN program USING (key)),
flags AS (SELECT h.*, d < start AS early, d - 90 < lo OR d > hi AS uncovered, season IS NULL AS off FROM h, cov)
"""


@query(
    "waterfall_order",
    st.with_base(
        PROGRAM_SQL
        + """,
t AS (
  SELECT 'start_first' AS variant, CASE WHEN early THEN 'before_start' WHEN uncovered THEN 'not_covered' WHEN off THEN 'off_season' ELSE 'kept' END AS reason FROM flags
  UNION ALL
  SELECT 'season_first', CASE WHEN off THEN 'off_season' WHEN early THEN 'before_start' WHEN uncovered THEN 'not_covered' ELSE 'kept' END FROM flags)
SELECT variant, reason, CAST(count(*) AS BIGINT) AS rows FROM t GROUP BY ALL"""
    ),
)
def waterfall_order(spark, folder):
    """The same exclusions in two orders: same survivors, different counts per step."""
    tl = st.day_timeline(spark, folder, "n_inc").join(st.program(spark, folder), "key")
    left, right = assoc.edges(st.spans(spark, folder, "n_evt"), {"n_evt": 90})
    rows = tl.withColumns(
        {"early": F.col("day") < F.col("start"), "uncovered": left | right, "off": st.season_of_day("day").isNull()}
    )
    early = ("before_start", F.col("early"))
    covered = ("not_covered", F.col("uncovered"))
    off = ("off_season", F.col("off"))
    a = waterfall.waterfall_counts(rows, [early, covered, off], F.col("n_inc"))
    b = waterfall.waterfall_counts(rows, [off, early, covered], F.col("n_inc"))
    return (
        a.withColumn("variant", F.lit("start_first"))
        .unionByName(b.withColumn("variant", F.lit("season_first")))
        .where(F.col("rows") > 0)
        .select("variant", "reason", "rows")
    )


@query(
    "silent_incidents",
    st.with_base(
        PROGRAM_SQL
        + """,
s AS (SELECT f.*, NOT EXISTS (SELECT 1 FROM evt e WHERE e.key = f.key AND e.d BETWEEN f.d - 90 AND f.d) AS silent
      FROM flags f WHERE NOT early AND NOT uncovered AND NOT off)
SELECT CASE WHEN grouping(cohort) = 1 THEN 'all' ELSE CAST(cohort AS VARCHAR) END AS cohort,
  CASE WHEN grouping(season) = 1 THEN 'all' ELSE CAST(season AS VARCHAR) END AS season,
  CAST(count(*) AS BIGINT) AS events, CAST(count(*) FILTER (silent) AS BIGINT) AS silent,
  CAST(count(*) FILTER (silent AND month(d) IN (10, 11, 12, 1)) AS BIGINT) AS silent_octjan,
  CAST(count(*) FILTER (month(d) IN (10, 11, 12, 1)) AS BIGINT) AS events_octjan,
  CAST(count(DISTINCT CASE WHEN silent THEN CAST(key AS VARCHAR) || '|' || CAST(d AS VARCHAR) END) AS BIGINT) AS silent_entity_days,
  CAST(count(DISTINCT CASE WHEN silent THEN key END) AS BIGINT) AS silent_entities
FROM s GROUP BY GROUPING SETS ((), (cohort), (cohort, season))"""
    ),
)
def silent_incidents(spark, folder):
    """Programme incidents without any event in the 90 days before, by cohort and season."""
    tl = st.day_timeline(spark, folder, "n_inc", "n_evt")
    members = st.program(spark, folder)
    # keep only members before the window runs
    rows = assoc.associate(tl.join(members, "key"), "n_inc", "n_evt", [90])
    left, right = assoc.edges(st.spans(spark, folder, "n_evt"), {"n_evt": 90})
    rows = rows.withColumns({"left": left, "right": right, "season": st.season_of_day("day")})
    ok = waterfall.survivors(
        rows,
        [
            ("before_start", F.col("day") < F.col("start")),
            ("not_covered", F.col("left") | F.col("right")),
            ("off_season", F.col("season").isNull()),
        ],
    )
    n, silent = F.col("n_inc"), F.col("n_90") == 0
    early = calendar.in_months(st.date_of("day"), [10, 11, 12, 1])
    per_entity = ok.groupBy("key", "cohort", "season").agg(
        F.sum(n).alias("events"),
        F.sum(F.when(silent, n).otherwise(0)).alias("silent"),
        F.sum(F.when(silent & early, n).otherwise(0)).alias("silent_octjan"),
        F.sum(F.when(early, n).otherwise(0)).alias("events_octjan"),
        F.count_if(silent).alias("silent_entity_days"),
    )
    c, s = F.col("cohort"), F.col("season")
    text = per_entity.withColumns({"cohort": c.cast("string"), "season": s.cast("string")})
    sums = [F.sum(x).alias(x) for x in ("events", "silent", "silent_octjan", "events_octjan", "silent_entity_days")]
    distinct = F.count_distinct(F.when(F.col("silent") > 0, F.col("key"))).alias("silent_entities")
    return text.groupingSets([[], [c], [c, s]], c, s).agg(*sums, distinct).na.fill("all", ["cohort", "season"])


@query(
    "silent_dual_screen",
    st.with_base(
        """,
cov2 AS (SELECT min(d) AS lo2, max(d) AS hi2 FROM prb),
s AS (SELECT i.*, NOT EXISTS (SELECT 1 FROM evt e WHERE e.key = i.key AND e.d BETWEEN i.d - 90 AND i.d) AS s1,
   NOT EXISTS (SELECT 1 FROM prb e WHERE e.key = i.key AND e.d BETWEEN i.d - 90 AND i.d) AS s2
   FROM inc i, cov, cov2 WHERE season IS NOT NULL AND d - 90 >= lo AND d <= hi AND d - 90 >= lo2 AND d <= hi2)
SELECT CAST(season AS INTEGER) AS season, CAST(count(*) AS BIGINT) AS eligible, CAST(count(*) FILTER (s1) AS BIGINT) AS silent_first,
  CAST(count(*) FILTER (s1 AND s2) AS BIGINT) AS silent_both, CAST(count(DISTINCT CASE WHEN s1 AND s2 THEN key END) AS BIGINT) AS entities_both
FROM s GROUP BY season"""
    ),
)
def silent_dual_screen(spark, folder):
    """Incidents silent in one stream and in both; eligible only where both are covered."""
    tl = st.day_timeline(spark, folder, "n_inc", "n_evt", "n_prb")
    rows = tl.withColumns({"a": assoc.count_back("n_evt", 90), "b": assoc.count_back("n_prb", 90)}).where(
        F.col("n_inc") > 0
    )
    look = {"n_evt": 90, "n_prb": 90}
    left, right = assoc.edges(st.spans(spark, folder, *look), look)
    ok = rows.withColumn("season", st.season_of_day("day")).where(
        F.col("season").isNotNull() & ~left & ~right
    )
    n, first, both = F.col("n_inc"), F.col("a") == 0, (F.col("a") == 0) & (F.col("b") == 0)
    per_entity = ok.groupBy("season", "key").agg(
        F.sum(n).alias("e"),
        F.sum(F.when(first, n).otherwise(0)).alias("s1"),
        F.sum(F.when(both, n).otherwise(0)).alias("s2"),
    )
    return per_entity.groupBy("season").agg(
        F.sum("e").alias("eligible"),
        F.sum("s1").alias("silent_first"),
        F.sum("s2").alias("silent_both"),
        F.count_if(F.col("s2") > 0).alias("entities_both"),
    )


@query(
    "events_per_unit",
    f"""WITH c AS (SELECT l_partkey AS key, count(*) AS n FROM lineitem WHERE l_returnflag = 'N' GROUP BY l_partkey),
j AS (SELECT {st.unit_class_sql('p_size')} AS unit_class, n::DOUBLE / p_size AS cpu FROM c JOIN part ON p_partkey = key WHERE p_size >= 2)
SELECT unit_class, CAST(count(*) AS BIGINT) AS entities, round(quantile_cont(cpu, 0.5), 6) AS median, round(avg(cpu), 6) AS mean FROM j GROUP BY unit_class""",
)
def events_per_unit(spark, folder):
    """Events per unit of entities that have events, by unit class."""
    from panelwake.operators.order import quantiles

    counts = st.lineitem(spark, folder).where(F.col("l_returnflag") == "N").groupBy(
        F.col("l_partkey").alias("key")
    ).agg(F.count("*").alias("n"))
    rows = (
        counts.join(st.unit_classes(spark, folder).where(F.col("units") >= 2), "key")
        .select("unit_class", (F.col("n") / F.col("units")).alias("cpu"))
    )
    med = quantiles(rows, ["unit_class"], "cpu", [0.5])
    mean = rows.groupBy("unit_class").agg(F.avg("cpu").alias("mean"))
    return st.rounded(
        med.join(mean, "unit_class").select(
            "unit_class", F.col("n").alias("entities"), F.col("q0").alias("median"), "mean"
        )
    )
