"""Queries on entity-by-season features."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwake.functions import calendar
from panelwake.operators import panel, stats
from panelwake.plans import standins as st
from panelwake.plans.registry import query
from panelwake.sources.landing import read_table

FLOOR_SQL = "DATE '1995-06-01'"


def base_features(spark, folder) -> DataFrame:
    return panel.history_features(
        st.spine(spark, folder),
        st.season_counts(spark, folder),
        st.year_counts(spark, folder),
        "key",
        st.SPEC,
    )


def complaint_events(spark, folder) -> DataFrame:
    li = st.lineitem(spark, folder).where(F.col("l_returnflag") == "N")
    return li.select(F.col("l_partkey").alias("key"), F.col("l_shipdate").alias("ts"))


def problem_events(spark, folder) -> DataFrame:
    li = st.lineitem(spark, folder).where(F.col("l_returnflag") == "A")
    return li.select(
        F.col("l_partkey").alias("key"),
        F.col("l_shipdate").alias("ts"),
        F.col("l_suppkey").cast("string").alias("sub_key"),
        (F.col("l_quantity") > 10).alias("is_sub"),
        F.when(F.col("l_linestatus") == "O", "N").otherwise("Y").alias("flag"),
    )


# Each family as SQL over the spine, written with self-joins and range conditions.
LABEL_SQL = """
fam_label AS (
  SELECT s.key, s.season,
    coalesce(max(CASE WHEN p.season = s.season - 1 THEN p.label_c END), 0) AS viol_lag1,
    coalesce(max(CASE WHEN p.season = s.season - 2 THEN p.label_c END), 0) AS viol_lag2,
    coalesce(max(CASE WHEN p.season = s.season - 3 THEN p.label_c END), 0) AS viol_lag3,
    s.season - 1994 AS hist_horizon,
    s.season - max(CASE WHEN p.label_c = 1 THEN p.season END) AS viol_recency,
    CASE WHEN count(p.season) > 0 THEN sum(p.label_c)::DOUBLE / count(p.season) END AS viol_chronicity
  FROM spine s LEFT JOIN spine p ON p.key = s.key AND p.season < s.season GROUP BY s.key, s.season)"""
COUNT_SQL = """
fam_count AS (
  SELECT s.key, s.season,
    CASE WHEN s.season > 1994 THEN count(i.rid) FILTER (i.season = s.season - 1) END AS viol_cnt_prior1,
    CASE WHEN s.season > 1994 THEN count(i.rid) END AS viol_cnt_prior_cum
  FROM spine s LEFT JOIN inc i ON i.key = s.key AND i.season < s.season AND i.status = 'O' GROUP BY s.key, s.season)"""


def _context_column(flag: str, name: str) -> str:
    match = f"c.flag = '{flag}' AND " if flag else "TRUE AND "
    return (
        f"count(c.rid) FILTER ({match}year(c.d) = s.season - 1) AS ctx_{name}_prior1, "
        f"count(c.rid) FILTER ({match}year(c.d) <= s.season - 1) AS ctx_{name}_cum"
    )


CONTEXT_SQL = f"""
fam_context AS (
  SELECT s.key, s.season, {', '.join(_context_column(f, n) for f, n in (('A', 'a'), ('N', 'n'), ('R', 'r'), ('', 'total')))}
  FROM spine s LEFT JOIN li c ON c.key = s.key AND year(c.d) < s.season AND year(c.d) >= 1995 GROUP BY s.key, s.season)"""
YEARLY_SQL = """
fam_yearly AS (
  SELECT s.key, s.season, CASE WHEN s.season - 1 >= 1996 THEN 1 ELSE 0 END AS c311_available,
    CASE WHEN s.season - 1 >= 1996 THEN count(e.rid) FILTER (year(e.d) = s.season - 1) END AS c311_prior1,
    CASE WHEN s.season - 1 >= 1996 THEN count(e.rid) END AS c311_prior_cum
  FROM spine s LEFT JOIN evt e ON e.key = s.key AND year(e.d) < s.season AND year(e.d) >= 1996 GROUP BY s.key, s.season)"""
OWNER_SQL = """
own AS (SELECT s.*, p_brand AS owner FROM spine s JOIN part ON p_partkey = s.key),
own_n AS (SELECT p_brand AS owner, count(*) AS portfolio_size FROM part GROUP BY 1),
own_by AS (SELECT owner, season, count(*) AS n, sum(label_c) AS p FROM own GROUP BY ALL),
fam_owner AS (
  SELECT o.key, o.season, o.owner AS owner_key, max(z.portfolio_size) AS portfolio_size,
    (SELECT sum(n) FROM own_by b WHERE b.owner = o.owner AND b.season < o.season) - (SELECT count(*) FROM spine q WHERE q.key = o.key AND q.season < o.season) AS den,
    (SELECT sum(p) FROM own_by b WHERE b.owner = o.owner AND b.season < o.season) - coalesce((SELECT sum(label_c) FROM spine q WHERE q.key = o.key AND q.season < o.season), 0) AS num
  FROM own o JOIN own_n z ON z.owner = o.owner GROUP BY o.key, o.season, o.owner)"""
WINDOW_SQL = f"""
cut AS (SELECT key, season, make_date(season, 10, 1) AS c, make_date(season - 1, 10, 1) AS ps_lo, make_date(season, 6, 1) AS ps_hi,
   make_date(season - 1, 10, 1) >= {FLOOR_SQL} AS av_ps, make_date(season, 10, 1) - 365 >= {FLOOR_SQL} AS av_365, make_date(season, 10, 1) - 730 >= {FLOOR_SQL} AS av_730 FROM spine),
fam_c6 AS (
  SELECT u.key, u.season, av_ps::INTEGER AS c6_available_ps, av_365::INTEGER AS c6_available_t365, av_730::INTEGER AS c6_available_t730,
    CASE WHEN av_ps THEN count(e.rid) FILTER (e.d >= ps_lo AND e.d < ps_hi)::DOUBLE END AS c6_evt_ps,
    CASE WHEN av_ps THEN count(DISTINCT e.d) FILTER (e.d >= ps_lo AND e.d < ps_hi)::DOUBLE END AS c6_days_ps,
    CASE WHEN av_ps THEN count(e.rid) FILTER (e.d >= ps_lo AND e.d < ps_hi)::DOUBLE / nullif(count(DISTINCT e.d) FILTER (e.d >= ps_lo AND e.d < ps_hi), 0) END AS c6_dup_intensity_ps,
    CASE WHEN av_365 THEN count(e.rid) FILTER (e.d >= c - 365)::DOUBLE END AS c6_evt_t365,
    CASE WHEN av_730 THEN count(e.rid) FILTER (e.d >= c - 730)::DOUBLE END AS c6_evt_t730
  FROM cut u LEFT JOIN evt e ON e.key = u.key AND e.d < c GROUP BY u.key, u.season, av_ps, av_365, av_730, ps_lo, ps_hi, c)"""
GAP_SQL = """
gap_rows AS (SELECT u.key, u.season, u.c, u.av_730, e.d, date_diff('day', lag(e.d) OVER (PARTITION BY u.key, u.season ORDER BY e.d), e.d) AS gap
  FROM cut u LEFT JOIN evt e ON e.key = u.key AND e.d < u.c AND e.d >= u.c - 730),
fam_gap AS (SELECT key, season, CASE WHEN av_730 THEN CAST(quantile_cont(gap, 0.5) AS DOUBLE) END AS c6_gap_median_t730, CASE WHEN av_730 THEN CAST(min(gap) AS DOUBLE) END AS c6_gap_min_t730,
  CASE WHEN av_730 THEN CAST(date_diff('day', max(d), c) AS DOUBLE) END AS c6_days_since_last_t730 FROM gap_rows GROUP BY key, season, c, av_730)"""
PROBLEM_SQL = """
pr AS (SELECT l_partkey AS key, CAST(l_shipdate AS DATE) AS d, l_suppkey AS sub, l_quantity > 10 AS is_sub, l_linestatus = 'O' AS unflagged, row_number() OVER () AS rid FROM lineitem WHERE l_returnflag = 'A'),
c7_raw AS (
  SELECT u.key, u.season, av_ps, av_730, count(e.rid) FILTER (e.d >= ps_lo AND e.d < ps_hi) AS evt_all, count(e.rid) FILTER (e.d >= ps_lo AND e.d < ps_hi AND unflagged) AS evt_n,
    count(DISTINCT sub) FILTER (e.d >= ps_lo AND e.d < ps_hi AND is_sub) AS apts, count(DISTINCT sub) FILTER (e.d >= c - 730 AND is_sub) AS apts730
  FROM cut u LEFT JOIN pr e ON e.key = u.key AND e.d < c GROUP BY ALL),
fam_c7 AS (
  SELECT r.key, r.season, av_ps::INTEGER AS c7_available_ps, av_730::INTEGER AS c7_available_t730, CASE WHEN av_ps THEN apts::DOUBLE END AS c7_apts_ps,
    CASE WHEN av_ps AND p_size > 5 THEN apts::DOUBLE / p_size END AS c7_apt_share_ps, CASE WHEN av_ps THEN evt_all::DOUBLE END AS c7_evt_all_ps, CASE WHEN av_ps THEN evt_n::DOUBLE END AS "c7_evt_dedupN_ps",
    CASE WHEN av_ps AND evt_all > 0 THEN 1.0 - evt_n::DOUBLE / evt_all END AS c7_dupflag_share_ps, CASE WHEN av_730 THEN apts730::DOUBLE END AS c7_apts_t730
  FROM c7_raw r JOIN part ON p_partkey = r.key)"""


@query(
    "panel_label_history",
    st.with_base(
        f""",{LABEL_SQL}
SELECT key, CAST(season AS INTEGER) AS season, CAST(viol_lag1 AS INTEGER) AS viol_lag1, CAST(viol_lag2 AS INTEGER) AS viol_lag2, CAST(viol_lag3 AS INTEGER) AS viol_lag3,
  CAST(hist_horizon AS INTEGER) AS hist_horizon, CAST(viol_recency AS INTEGER) AS viol_recency, round(viol_chronicity, 6) AS viol_chronicity FROM fam_label"""
    ),
)
def panel_label_history(spark, folder):
    """Label lags, recency and chronicity; a missing season counts as no label."""
    cols = panel.label_history("key", "season", "label_c", st.SPEC.first_season)
    return st.rounded(st.spine(spark, folder).select("key", "season", *[c.alias(n) for n, c in cols.items()]))


@query(
    "panel_event_counts",
    st.with_base(
        f""",{COUNT_SQL},{YEARLY_SQL}
SELECT a.key, CAST(a.season AS INTEGER) AS season, CAST(viol_cnt_prior1 AS BIGINT) AS viol_cnt_prior1, CAST(viol_cnt_prior_cum AS BIGINT) AS viol_cnt_prior_cum,
  CAST(c311_available AS INTEGER) AS c311_available, CAST(c311_prior1 AS BIGINT) AS c311_prior1, CAST(c311_prior_cum AS BIGINT) AS c311_prior_cum FROM fam_count a JOIN fam_yearly b ON a.key = b.key AND a.season = b.season"""
    ),
)
def panel_event_counts(spark, folder):
    """Incidents of the last and all earlier seasons, events of the last and all earlier years."""
    cols = ["viol_cnt_prior1", "viol_cnt_prior_cum", "c311_available", "c311_prior1", "c311_prior_cum"]
    return base_features(spark, folder).select("key", "season", *cols)


@query(
    "context_by_class_year",
    st.with_base(
        f""",{CONTEXT_SQL}
SELECT key, CAST(season AS INTEGER) AS season, {', '.join(f'CAST(ctx_{c}_{w} AS BIGINT) AS ctx_{c}_{w}' for c in ('a', 'n', 'r', 'total') for w in ('prior1', 'cum'))} FROM fam_context"""
    ),
)
def context_by_class_year(spark, folder):
    """Events per class in the year before the cutoff year and in all earlier years."""
    f = base_features(spark, folder)
    return f.select("key", "season", *[c for c in f.columns if c.startswith("ctx_")])


@query(
    "portfolio_loo",
    st.with_base(
        f""",{OWNER_SQL}
SELECT key, CAST(season AS INTEGER) AS season, owner_key, CAST(portfolio_size AS BIGINT) AS portfolio_size, CASE WHEN den > 0 THEN round(num::DOUBLE / den, 6) END AS portfolio_loo_rate FROM fam_owner"""
    ),
)
def portfolio_loo(spark, folder):
    """Owner's earlier positive rate without the entity itself."""
    return st.rounded(
        panel.owner_rates(st.spine(spark, folder), st.owners(spark, folder), "key", "season", "label_c", "owner_key")
    )


@query(
    "trailing_windows_masked",
    st.with_base(
        f""",{WINDOW_SQL}
SELECT * REPLACE (CAST(season AS INTEGER) AS season, round(c6_dup_intensity_ps, 6) AS c6_dup_intensity_ps) FROM fam_c6"""
    ),
)
def trailing_windows_masked(spark, folder):
    """Previous-season, 365-day and 730-day windows before every cutoff; NULL where not covered."""
    w = panel.complaint_windows(complaint_events(spark, folder), "key", "ts")
    spine = st.spine(spark, folder).select("key", "season")
    return st.rounded(panel.on_spine(spine, w, "key", panel.complaint_columns(st.SPEC.complaint_floor)))


@query(
    "gap_windows_masked",
    st.with_base(
        f""",{WINDOW_SQL},{GAP_SQL}
SELECT * REPLACE (CAST(season AS INTEGER) AS season) FROM fam_gap"""
    ),
)
def gap_windows_masked(spark, folder):
    """Gaps between events inside 730 days before every cutoff."""
    g = panel.gap_features(complaint_events(spark, folder), "key", "ts", panel.SEASONS, 730)
    spine = st.spine(spark, folder).select("key", "season")
    return st.rounded(panel.on_spine(spine, g, "key", panel.gap_columns(st.SPEC.complaint_floor)))


@query(
    "problem_windows_masked",
    st.with_base(
        f""",{WINDOW_SQL},{PROBLEM_SQL}
SELECT * REPLACE (CAST(season AS INTEGER) AS season, round(c7_apt_share_ps, 6) AS c7_apt_share_ps, round(c7_dupflag_share_ps, 6) AS c7_dupflag_share_ps) FROM fam_c7"""
    ),
)
def problem_windows_masked(spark, folder):
    """Distinct sub-units, repeat-flag share and both-ways event counts."""
    w = panel.problem_windows(
        problem_events(spark, folder), "key", "ts", "sub_key", F.col("is_sub"), F.col("flag") == "N"
    )
    units = st.spine(spark, folder).select("key", "season").join(
        st.lots(spark, folder).select("key", "unitstotal"), "key", "left"
    )
    return st.rounded(panel.on_spine(units, w, "key", panel.problem_columns(st.SPEC.complaint_floor, "unitstotal")))


WEEKS = panel.Cutoffs(
    first_target=lambda d: F.floor((F.unix_date(d) - F.unix_date(F.lit("2024-01-01").cast("date"))) / 7).cast("int") + 1,
    reach=2,
    cutoff=lambda p: F.date_add(F.lit("2024-01-01").cast("date"), p * 7),
)


@query(
    "gap_features",
    """WITH w AS (SELECT DISTINCT CAST(floor(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) / 7) AS INTEGER) + k AS week FROM events, (SELECT unnest([1, 2]) AS k)),
e AS (SELECT user_id, week, TIMESTAMP '2024-01-01' + INTERVAL (week * 7) DAY AS c, ts, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id, week ORDER BY ts) AS gap
  FROM w JOIN events ON ts < TIMESTAMP '2024-01-01' + INTERVAL (week * 7) DAY AND ts >= TIMESTAMP '2024-01-01' + INTERVAL (week * 7 - 14) DAY)
SELECT user_id, week, CAST(count(*) AS BIGINT) AS events, round((epoch_us(max(c)) - epoch_us(max(ts))) / 86400000000.0, 6) AS days_since_last,
  round(CAST(quantile_cont(gap, 0.5) AS DOUBLE) / 86400000000.0, 6) AS gap_median, round(min(gap) / 86400000000.0, 6) AS gap_min FROM e GROUP BY user_id, week""",
)
def gap_features(spark, folder):
    """Sub-day gaps per user in the 14 days before every week's start."""
    e = read_table(spark, folder, "events", ["user_id", "ts"])
    return st.rounded(panel.gap_features(e, "user_id", "ts", WEEKS, 14, "week"))


FRAME_TAIL = [
    "c6_available_ps", "c6_available_t365", "c6_available_t730", "c6_evt_ps", "c6_days_ps", "c6_dup_intensity_ps", "c6_evt_t365", "c6_evt_t730",
    "c6_gap_median_t730", "c6_gap_min_t730", "c6_days_since_last_t730", "c7_available_ps", "c7_available_t730", "c7_apts_ps", "c7_apt_share_ps",
    "c7_evt_all_ps", "c7_evt_dedupN_ps", "c7_dupflag_share_ps", "c7_apts_t730",
]


def _frame_sql() -> str:
    exprs = {
        "building_age": "a.season - (1000 + floor(p_retailprice))",
        "prewar": "CASE WHEN 1000 + floor(p_retailprice) < 1940 THEN 1 ELSE 0 END",
        "unitsres": "p_size",
        "unitstotal": "CASE WHEN p_size > 5 THEN p_size END",
        "numfloors": "length(p_name)",
        "bldgclass_1": "upper(substr(p_name, 1, 1))",
        "borough": "p_type",
        "portfolio_loo_rate": "CASE WHEN den > 0 THEN num::DOUBLE / den END",
    }
    out = []
    for c in panel.fixed_features(st.SPEC.classes) + FRAME_TAIL:
        e = exprs.get(c, f'"{c}"')
        if c in ("bldgclass_1", "borough"):
            out.append(f"{e} AS {c}")
        elif c == "prewar" or "available" in c:
            out.append(f"CAST({e} AS INTEGER) AS {c}")
        else:
            out.append(f'round(CAST({e} AS DOUBLE), 6) AS "{c}"')
    families = ["fam_count b", "fam_context c", "fam_yearly d", "fam_owner e", "fam_c6 f", "fam_gap g", "fam_c7 h"]
    joins = " ".join(f"JOIN {f} ON {f[-1]}.key = a.key AND {f[-1]}.season = a.season" for f in families)
    ctes = ",".join([LABEL_SQL, COUNT_SQL, CONTEXT_SQL, YEARLY_SQL, OWNER_SQL, WINDOW_SQL, GAP_SQL, PROBLEM_SQL])
    return st.with_base(
        f""",{ctes}
SELECT a.key, CAST(a.season AS INTEGER) AS season, {', '.join(out)}, s.label_c, s.label_bc
FROM fam_label a {joins} JOIN part ON p_partkey = a.key JOIN spine s ON s.key = a.key AND s.season = a.season"""
    )


def frame(spark, folder) -> DataFrame:
    with st.one_pass(spark, folder):
        spine, seasons, years = (f(spark, folder) for f in (st.spine, st.season_counts, st.year_counts))
    return panel.feature_frame(
        spine,
        seasons,
        years,
        complaint_events(spark, folder),
        problem_events(spark, folder),
        st.lots(spark, folder),
        st.owners(spark, folder),
        "key",
        st.SPEC,
    )


@query("feature_frame", _frame_sql())
def feature_frame(spark, folder):
    """All feature families on the panel, in the fixed column order."""
    return st.rounded(frame(spark, folder))


@query(
    "mask_coverage",
    st.with_base(
        f""",{WINDOW_SQL}
SELECT CAST(season AS INTEGER) AS season, CAST(CASE WHEN season - 1 >= 1996 THEN 1 ELSE 0 END AS INTEGER) AS yearly, CAST(max(av_ps::INTEGER) AS INTEGER) AS ps, CAST(max(av_365::INTEGER) AS INTEGER) AS t365, CAST(max(av_730::INTEGER) AS INTEGER) AS t730, CAST(count(*) AS BIGINT) AS rows FROM cut GROUP BY season"""
    ),
)
def mask_coverage(spark, folder):
    """Which windows are covered in which season."""
    av = panel.availability(F.col("season"), st.SPEC.complaint_floor)
    yearly = F.col("season") - 1 >= st.SPEC.complaint_first_year
    per = st.spine(spark, folder).groupBy("season").agg(F.count("*").alias("rows"))
    return per.select(
        "season", yearly.cast("int").alias("yearly"), *[c.cast("int").alias(n) for n, c in av.items()], "rows"
    )


@query(
    "persistence_and_trailing3",
    st.with_base(
        f""",{LABEL_SQL},{COUNT_SQL}
SELECT a.key, CAST(a.season AS INTEGER) AS season, a.viol_lag1 * 1e6 + coalesce(viol_cnt_prior_cum, 0) AS persistence,
  CAST((SELECT count(*) FROM inc i WHERE i.key = a.key AND i.status = 'O' AND i.season BETWEEN a.season - 3 AND a.season - 1) AS DOUBLE) AS trailing3
FROM fam_label a JOIN fam_count b ON a.key = b.key AND a.season = b.season"""
    ),
)
def persistence_and_trailing3(spark, folder):
    """Two baseline scores: last label plus history, and incidents of the last three seasons."""
    return baseline_scores(spark, folder)


def baseline_scores(spark, folder) -> DataFrame:
    spine = st.spine(spark, folder).select("key", "season", "label_c")
    rows = panel.history(spine, [st.season_counts(spark, folder)], "key", "season")
    lag1 = F.coalesce(F.max("label_c").over(panel.exactly("key", "season", 1)), F.lit(0))
    total = F.coalesce(F.sum("inc").over(panel.before("key", "season")), F.lit(0))
    scored = rows.withColumns(
        {
            "persistence": lag1 * F.lit(1e6) + total,
            "trailing3": panel.trailing_sum("key", "season", "inc", 3).cast("double"),
        }
    )
    return scored.where(F.col("in_spine") == 1).select("key", "season", "persistence", "trailing3")


@query(
    "zero_group_flag",
    st.with_base(
        """,
first AS (SELECT key, min(d) AS first_day FROM evt GROUP BY key)
SELECT CAST(s.season AS INTEGER) AS season, CAST(count(*) AS BIGINT) AS rows, CAST(count(*) FILTER (first_day IS NULL OR first_day >= make_date(s.season, 10, 1)) AS BIGINT) AS zero_rows FROM spine s LEFT JOIN first USING (key) GROUP BY s.season"""
    ),
)
def zero_group_flag(spark, folder):
    """Entities without any event before the cutoff, per season."""
    from panelwake.operators.ranking import zero_history

    flagged = zero_history(
        st.spine(spark, folder), first_events(spark, folder), "key", calendar.cutoff("season")
    )
    return flagged.groupBy("season").agg(
        F.count("*").alias("rows"), F.count_if("zero_history").alias("zero_rows")
    )


def first_events(spark, folder) -> DataFrame:
    complaints = st.events(spark, folder).where(F.col("l_returnflag") == "N")
    return complaints.groupBy("key").agg(st.date_of(F.min("day")).alias("first_ts"))


@query(
    "feature_null_audit",
    st.with_base(
        f""",{WINDOW_SQL}
SELECT "column", CAST(nulls AS BIGINT) AS nulls, round(100.0 * nulls::DOUBLE / n, 6) AS null_pct FROM ("""
        + " UNION ALL ".join(
            f"""SELECT '{c}' AS "column", count(*) FILTER ({c} IS NULL) AS nulls, count(*) AS n FROM fam_c6"""
            for c in ["c6_evt_ps", "c6_dup_intensity_ps", "c6_evt_t365", "c6_evt_t730"]
        )
        + ")"
    ),
)
def feature_null_audit(spark, folder):
    """NULLs per window feature: uncovered windows and empty denominators only."""
    w = panel.complaint_windows(complaint_events(spark, folder), "key", "ts")
    spine = st.spine(spark, folder).select("key", "season")
    masked = panel.on_spine(spine, w, "key", panel.complaint_columns(st.SPEC.complaint_floor))
    return st.rounded(
        stats.null_audit(masked, ["c6_evt_ps", "c6_dup_intensity_ps", "c6_evt_t365", "c6_evt_t730"])
    )
