"""Queries on ranking quality."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelwake.functions import calendar
from panelwake.operators import association as assoc
from panelwake.operators import order, ranking
from panelwake.plans import standins as st
from panelwake.plans.panel_queries import COUNT_SQL, LABEL_SQL, baseline_scores, first_events
from panelwake.plans.registry import query
from panelwake.session import durable
from panelwake.sources.landing import read_table

SEED = 42
KS_SQL = [100, 250, 500, 1000, 2500]


def areas_sql(source: str, groups: str) -> str:
    """Ranking metrics over a relation with <groups>, score, y and tie."""
    g = groups
    join = lambda a, b: " AND ".join(f"{a}.{c.strip()} = {b}.{c.strip()}" for c in g.split(","))
    top = ", ".join(
        f"CASE WHEN max(rn) >= {k} THEN round(sum(CASE WHEN rn <= {k} THEN y ELSE 0 END)::DOUBLE / {k}, 6) END AS p_at_{k}"
        for k in KS_SQL
    )
    return f"""
sg AS (SELECT {g}, score, count(*) AS n, sum(y) AS tp FROM {source} GROUP BY {g}, score),
cv AS (SELECT *, sum(tp) OVER w AS ctp, sum(n) OVER w AS cn, sum(tp) OVER (PARTITION BY {g}) AS p, sum(n) OVER (PARTITION BY {g}) AS m FROM sg WINDOW w AS (PARTITION BY {g} ORDER BY score DESC)),
ar AS (SELECT {g}, max(m) AS n, max(p) AS pos, max(p)::DOUBLE / max(m) AS prevalence,
  CASE WHEN max(p) > 0 AND max(p) < max(m) THEN sum(tp::DOUBLE * ctp / cn) / max(p) END AS pr_auc,
  CASE WHEN max(p) > 0 AND max(p) < max(m) THEN sum((n - tp) * (ctp - tp / 2.0))::DOUBLE / (max(p)::DOUBLE * (max(m) - max(p))) END AS roc_auc FROM cv GROUP BY {g}),
rn AS (SELECT {g}, y, row_number() OVER (PARTITION BY {g} ORDER BY score DESC, tie) AS rn FROM {source}),
tk AS (SELECT {g}, {top} FROM rn GROUP BY {g}),
metrics AS (SELECT ar.*, {', '.join(f'p_at_{k}' for k in KS_SQL)} FROM ar JOIN tk ON {join('ar', 'tk')})"""


METRICS_OUT = (
    "CAST(n AS BIGINT) AS n, CAST(pos AS BIGINT) AS pos, round(prevalence, 6) AS prevalence, round(pr_auc, 6) AS pr_auc, "
    "round(roc_auc, 6) AS roc_auc, " + ", ".join(f"p_at_{k}" for k in KS_SQL)
)


def priced_orders(spark, folder) -> DataFrame:
    """Orders ranked by their price in thousands; finished orders count as positives."""
    o = read_table(spark, folder, "orders")
    return o.select(
        "o_orderkey",
        "o_orderpriority",
        F.year("o_orderdate").alias("year"),
        F.round(F.col("o_totalprice") / 1000.0, 0).alias("score"),
        (F.col("o_orderstatus") == "F").cast("int").alias("y"),
    )


PRICED_SQL = f"""priced AS (SELECT o_orderkey, o_orderpriority, CAST(year(o_orderdate) AS INTEGER) AS year, round(o_totalprice / 1000.0, 0) AS score, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS y,
  md5('{SEED}|' || CAST(o_orderkey AS VARCHAR)) AS tie FROM orders)"""


@query(
    "rank_percentile",
    f"""WITH {PRICED_SQL},
r AS (SELECT *, rank() OVER (PARTITION BY year ORDER BY score DESC) + (count(*) OVER (PARTITION BY year, score) - 1) / 2.0 AS avg_rank, count(*) OVER (PARTITION BY year) AS m FROM priced)
SELECT o_orderkey, year, score, round(avg_rank, 6) AS avg_rank, round(1.0 - (avg_rank - 1.0) / (m - 1.0), 6) AS pct FROM r""",
)
def rank_percentile(spark, folder):
    """Average rank and rank percentile of every order inside its year."""
    scored = priced_orders(spark, folder).select("o_orderkey", "year", "score")
    pct = ranking.rank_percentiles(scored, ["year"], "score")
    out = order.lookup_skewed(scored, pct, ["year", "score"], F.col("n"), scored.count(), F.col("o_orderkey"))
    return st.rounded(out.select("o_orderkey", "year", "score", "avg_rank", "pct"))


@query(
    "ranking_report",
    f"WITH {PRICED_SQL},{areas_sql('priced', 'year')} SELECT year, {METRICS_OUT} FROM metrics",
)
def ranking_report(spark, folder):
    """Precision at k, average precision and ROC area per year."""
    scored = priced_orders(spark, folder)
    return st.rounded(ranking.report(scored, ["year"], "score", "y", ranking.tie_key(SEED, "o_orderkey")))


def panel_scores(spark, folder) -> DataFrame:
    """Two baseline scores with label and zero-history flag, one row per entity and season.

    Kept durable: split points and metrics read it several times.
    """
    with st.one_pass(spark, folder):
        flags = ranking.zero_history(
            st.spine(spark, folder).select("key", "season", F.col("label_c").alias("y")),
            first_events(spark, folder),
            "key",
            calendar.cutoff("season"),
        ).select("key", "season", "y", "zero_history")
        scores = baseline_scores(spark, folder)
    listed = F.col("season").between(st.FIRST_SEASON, st.LAST_SEASON)
    return durable(scores.where(listed).join(flags, ["key", "season"]))


def by_model(wide: DataFrame) -> DataFrame:
    """The scores in long form."""
    model = lambda m: F.struct(F.lit(m).alias("model"), F.col(m).alias("score"))
    both = F.explode(F.array(model("persistence"), model("trailing3"))).alias("m")
    return wide.select("key", "season", "y", "zero_history", both).select(
        "key", "season", "y", "zero_history", "m.*"
    )


PANEL_SCORES_SQL = f"""{LABEL_SQL},{COUNT_SQL},
first AS (SELECT key, min(d) AS first_day FROM evt GROUP BY key),
wide AS (SELECT a.key, a.season, s.label_c AS y, f.first_day IS NULL OR f.first_day >= make_date(a.season, 10, 1) AS zero, a.viol_lag1 * 1e6 + coalesce(viol_cnt_prior_cum, 0) AS persistence,
  (SELECT count(*) FROM inc i WHERE i.key = a.key AND i.status = 'O' AND i.season BETWEEN a.season - 3 AND a.season - 1)::DOUBLE AS trailing3
  FROM fam_label a JOIN fam_count b ON a.key = b.key AND a.season = b.season JOIN spine s ON s.key = a.key AND s.season = a.season LEFT JOIN first f ON f.key = a.key WHERE a.season BETWEEN {st.FIRST_SEASON} AND {st.LAST_SEASON}),
long AS (SELECT key, season, y, zero, 'persistence' AS model, persistence AS score, md5('{SEED}|' || season || '|' || key) AS tie FROM wide UNION ALL SELECT key, season, y, zero, 'trailing3', trailing3, md5('{SEED}|' || season || '|' || key) FROM wide),
strat AS (SELECT *, 'all' AS stratum FROM long UNION ALL SELECT *, CASE WHEN zero THEN 'zero' ELSE 'any' END FROM long)"""
GROUPS = ["model", "season", "stratum"]


def stratum_metrics(wide: DataFrame) -> DataFrame:
    rows = ranking.by_stratum(by_model(wide), "zero_history")
    return ranking.report(rows, GROUPS, "score", "y", ranking.tie_key(SEED, "season", "key"))


@query(
    "ranking_by_stratum",
    st.with_base(
        f",{PANEL_SCORES_SQL},{areas_sql('strat', 'model, season, stratum')} SELECT model, CAST(season AS INTEGER) AS season, stratum, {METRICS_OUT} FROM metrics"
    ),
)
def ranking_by_stratum(spark, folder):
    """All metrics per model, season and stratum in one grouped plan."""
    return st.rounded(stratum_metrics(panel_scores(spark, folder)))


@query(
    "model_deltas",
    st.with_base(
        f""",{PANEL_SCORES_SQL},{areas_sql('strat', 'model, season, stratum')}
SELECT stratum, CAST(count(*) FILTER (model = 'trailing3') AS BIGINT) AS folds, round(avg(pr_auc) FILTER (model = 'trailing3') - avg(pr_auc) FILTER (model = 'persistence'), 6) AS delta_ap,
  round(avg(p_at_250) FILTER (model = 'trailing3') - avg(p_at_250) FILTER (model = 'persistence'), 6) AS delta_p250 FROM metrics GROUP BY stratum"""
    ),
)
def model_deltas(spark, folder):
    """Mean metric over folds of one model minus the other, per stratum."""
    m = stratum_metrics(panel_scores(spark, folder))
    mean = lambda name, c: F.avg(F.when(F.col("model") == name, F.col(c)))
    delta = lambda c: mean("trailing3", c) - mean("persistence", c)
    return st.rounded(
        m.groupBy("stratum").agg(
            F.count_if(F.col("model") == "trailing3").alias("folds"),
            delta("pr_auc").alias("delta_ap"),
            delta("p_at_250").alias("delta_p250"),
        )
    )


SILENT_SQL = """
silent AS (SELECT DISTINCT i.key, i.season FROM inc i, cov WHERE i.season BETWEEN 1995 AND 2000 AND i.d - 90 >= lo AND i.d <= hi AND NOT EXISTS (SELECT 1 FROM evt e WHERE e.key = i.key AND e.d BETWEEN i.d - 90 AND i.d)),
pc AS (SELECT key, season, 1.0 - (rank() OVER (PARTITION BY season ORDER BY trailing3 DESC) + (count(*) OVER (PARTITION BY season, trailing3) - 1) / 2.0 - 1.0)::DOUBLE / (count(*) OVER (PARTITION BY season) - 1.0)::DOUBLE AS a,
  1.0 - (rank() OVER (PARTITION BY season ORDER BY persistence DESC) + (count(*) OVER (PARTITION BY season, persistence) - 1) / 2.0 - 1.0)::DOUBLE / (count(*) OVER (PARTITION BY season) - 1.0)::DOUBLE AS b FROM wide),
dl AS (SELECT s.season, s.key, pc.a - pc.b AS delta FROM silent s LEFT JOIN pc ON pc.key = s.key AND pc.season = s.season),
ft AS (SELECT season, count(*) AS n_screen, count(delta) AS realized_n, count(*) - count(delta) AS n_missing, count(*) FILTER (delta = 0) AS z, count(*) FILTER (delta <> 0) AS n, count(*) FILTER (delta > 0) AS k, quantile_cont(delta, 0.5) AS t FROM dl GROUP BY season),
pv AS (SELECT ft.season, sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) - n * ln(2.0))) AS p FROM ft, (SELECT unnest(range(0, 100000)) AS i) g WHERE i BETWEEN k AND n AND n > 0 GROUP BY ft.season)"""


def silent_entities(spark, folder) -> DataFrame:
    """Entities with an incident that no event preceded, per season."""
    tl = st.day_timeline(spark, folder, "n_inc", "n_evt")
    rows = assoc.associate(tl, "n_inc", "n_evt", [90]).where(F.col("n_90") == 0)
    ok = rows.where(st.eligible(spark, folder, {"n_evt": 90}))
    return ok.select("key", st.season_of_day("day").alias("season")).distinct()


def rank_improvement(spark, folder, wide: DataFrame) -> DataFrame:
    """Percentile under one model minus percentile under the other, on the screened entities."""
    wide = wide.select("key", "season", "persistence", "trailing3")
    rows = wide.count()  # the screen holds a part of them
    screen = silent_entities(spark, folder)
    out = screen.join(wide, ["key", "season"], "left")
    for model in ("persistence", "trailing3"):
        pct = ranking.rank_percentiles(wide.select("season", model), ["season"], model).withColumnRenamed(
            "pct", f"pct_{model}"
        ).drop("avg_rank")
        out = order.lookup_skewed(out, pct, ["season", model], F.col("n"), rows, F.col("key")).drop("n", "all_n")
    return durable(
        out.select("key", "season", (F.col("pct_trailing3") - F.col("pct_persistence")).alias("delta"))
    )


@query(
    "paired_rank_sign_test",
    st.with_base(
        f""",{PANEL_SCORES_SQL},{SILENT_SQL}
SELECT CAST(ft.season AS INTEGER) AS season, CAST(n_screen AS BIGINT) AS n_screen, CAST(n_missing AS BIGINT) AS n_missing, CAST(realized_n AS BIGINT) AS realized_n, CAST(z AS BIGINT) AS n_dropped_zero, CAST(n AS BIGINT) AS n_signtest, CAST(k AS BIGINT) AS n_positive,
  round(CAST(t AS DOUBLE), 6) AS median_delta, CASE WHEN n > 0 THEN round(coalesce(p, 0.0), 6) END AS p_one_sided, CASE WHEN n > 0 THEN coalesce(p, 0.0) < 0.05 END AS reject FROM ft LEFT JOIN pv ON pv.season = ft.season"""
    ),
)
def paired_rank_sign_test(spark, folder):
    """Exact one-sided sign test of rank improvement on silent entities, per season."""
    deltas = rank_improvement(spark, folder, panel_scores(spark, folder))
    test = ranking.sign_test(deltas, ["season"], "delta")
    cover = deltas.groupBy("season").agg(
        F.count("*").alias("n_screen"), F.count_if(F.col("delta").isNull()).alias("n_missing")
    )
    out = cover.join(test, "season")
    return st.rounded(
        out.select(
            "season", "n_screen", "n_missing", "realized_n", "n_dropped_zero", "n_signtest", "n_positive",
            "median_delta", "p_one_sided", "reject",
        )
    )


@query(
    "criteria_check",
    st.with_base(
        f""",{PANEL_SCORES_SQL},{areas_sql('strat', 'model, season, stratum')},{SILENT_SQL},
r AS (SELECT avg(p_at_250) FILTER (model = 'trailing3' AND stratum = 'zero') / avg(p_at_250) FILTER (model = 'persistence' AND stratum = 'zero') AS stratum_ratio,
  avg(p_at_250) FILTER (model = 'trailing3' AND stratum = 'all') / avg(p_at_250) FILTER (model = 'persistence' AND stratum = 'all') AS global_ratio FROM metrics),
t AS (SELECT count(*) FILTER (n > 0 AND t > 0 AND coalesce(p, 0.0) < 0.05) AS passed, count(*) AS tested FROM ft LEFT JOIN pv ON pv.season = ft.season)
SELECT round(stratum_ratio, 6) AS stratum_ratio, round(global_ratio, 6) AS global_ratio, CASE WHEN stratum_ratio >= 1.35 THEN 'PASS' ELSE 'FAIL' END AS stratum_verdict, CASE WHEN global_ratio >= 0.90 THEN 'PASS' ELSE 'FAIL' END AS global_verdict, CAST(passed AS BIGINT) AS sign_passed, CAST(tested AS BIGINT) AS sign_tested FROM r, t"""
    ),
)
def criteria_check(spark, folder):
    """Stratum and global precision ratios against their thresholds, and sign tests passed."""
    wide = panel_scores(spark, folder)
    m = stratum_metrics(wide)
    mean = lambda model, s: F.avg(
        F.when((F.col("model") == model) & (F.col("stratum") == s), F.col("p_at_250"))
    )
    ratios = m.agg(
        F.try_divide(mean("trailing3", "zero"), mean("persistence", "zero")).alias("stratum_ratio"),
        F.try_divide(mean("trailing3", "all"), mean("persistence", "all")).alias("global_ratio"),
    )
    test = ranking.sign_test(rank_improvement(spark, folder, wide), ["season"], "delta")
    passed = test.agg(
        F.count_if((F.col("median_delta") > 0) & F.col("reject")).alias("sign_passed"),
        F.count("*").alias("sign_tested"),
    )
    verdict = lambda c, t: F.when(F.col(c) >= t, "PASS").otherwise("FAIL")
    out = ratios.withColumns(
        {
            "stratum_verdict": verdict("stratum_ratio", 1.35),
            "global_verdict": verdict("global_ratio", 0.90),
            "sign_passed": passed.select("sign_passed").scalar(),
            "sign_tested": passed.select("sign_tested").scalar(),
        }
    )
    return st.rounded(out)


@query(
    "winner_runner_up",
    f"""WITH {PRICED_SQL},{areas_sql('priced', 'o_orderpriority')},
o AS (SELECT *, row_number() OVER (ORDER BY pr_auc DESC, p_at_250 DESC, o_orderpriority) AS place, pr_auc - lead(pr_auc) OVER (ORDER BY pr_auc DESC, p_at_250 DESC, o_orderpriority) AS margin FROM metrics)
SELECT CAST(place AS INTEGER) AS place, o_orderpriority, round(pr_auc, 6) AS pr_auc, p_at_250, CASE WHEN place = 1 THEN round(margin, 6) END AS margin FROM o WHERE place <= 2""",
)
def winner_runner_up(spark, folder):
    """Best and second configuration by average precision, then precision at 250, then name."""
    m = ranking.report(
        priced_orders(spark, folder), ["o_orderpriority"], "score", "y", ranking.tie_key(SEED, "o_orderkey")
    )
    top = ranking.lexicographic_best(
        m, [F.desc("pr_auc"), F.desc("p_at_250"), F.asc("o_orderpriority")], "pr_auc"
    )
    return st.rounded(top.select("place", "o_orderpriority", "pr_auc", "p_at_250", "margin"))


@query(
    "seed_spread",
    f"""WITH {PRICED_SQL},
s AS (SELECT *, md5(CAST(seed AS VARCHAR) || '|' || CAST(o_orderkey AS VARCHAR)) AS tie2 FROM priced, (SELECT unnest([1, 2, 3, 4, 5]) AS seed)),
r AS (SELECT seed, year, y, row_number() OVER (PARTITION BY seed, year ORDER BY score DESC, tie2) AS rn FROM s),
m AS (SELECT seed, year, CASE WHEN count(*) >= 250 THEN sum(y)::DOUBLE / 250 END AS p FROM r WHERE rn <= 250 GROUP BY seed, year)
SELECT year, CAST(count(p) AS BIGINT) AS runs, round(avg(p), 6) AS mean, round(min(p), 6) AS lo, round(max(p), 6) AS hi, round(stddev_pop(p), 6) AS std, round(max(p) - min(p), 6) AS range FROM m GROUP BY year""",
)
def seed_spread(spark, folder):
    """How precision at 250 moves with the tie-breaking seed."""
    seeds = F.explode(F.array(*[F.lit(i) for i in range(1, 6)])).alias("seed")
    rows = priced_orders(spark, folder).select("*", seeds)
    tie = F.md5(F.concat_ws("|", F.col("seed").cast("string"), F.col("o_orderkey").cast("string")))
    groups = ["seed", "year"]
    edges = durable(ranking.areas(ranking.curve(rows, groups, "score", "y"), groups, 250))
    per = ranking.top_k(rows, groups, "score", "y", tie, edges, [250])
    return st.rounded(ranking.spread(per, ["year"], "p_at_250"))


@query(
    "audit_sample",
    st.with_base(
        """,
a AS (SELECT * FROM spine ORDER BY season, key LIMIT 100), b AS (SELECT * FROM spine WHERE label_c = 1 ORDER BY season, key LIMIT 100)
SELECT key, CAST(season AS INTEGER) AS season, label_c FROM (SELECT * FROM a UNION SELECT * FROM b)"""
    ),
)
def audit_sample(spark, folder):
    """First hundred panel rows and first hundred positive ones, in key order."""
    s = st.spine(spark, folder).select("key", "season", "label_c")
    return ranking.audit_sample(s, F.col("label_c") == 1, ["season", "key"], 100)


@query(
    "ranking_by_tercile",
    st.with_base(
        f""",{PANEL_SCORES_SQL},
tc AS (SELECT p_partkey AS key, row_number() OVER (ORDER BY p_retailprice, p_partkey) AS r, count(*) OVER () AS m FROM part),
sl AS (SELECT long.model, long.score, long.y, long.tie, CASE WHEN 3 * (r - 1) <= m - 1 THEN 1 WHEN 3 * (r - 1) <= 2 * (m - 1) THEN 2 ELSE 3 END AS tercile FROM long JOIN tc ON tc.key = long.key),{areas_sql('sl', 'model, tercile')}
SELECT model, CAST(tercile AS INTEGER) AS tercile, {METRICS_OUT} FROM metrics"""
    ),
)
def ranking_by_tercile(spark, folder):
    """The same metrics on slices by a tercile of an entity attribute."""
    p = st.parts(spark, folder).select(F.col("p_partkey").alias("key"), "p_retailprice")
    ranked = order.row_numbers(p, [F.asc("p_retailprice"), F.asc("key")])
    slices = ranked.select("key", order.tercile(F.col("rank"), F.col("all_rows")).alias("tercile"))
    rows = by_model(panel_scores(spark, folder)).join(slices, "key")
    return st.rounded(
        ranking.report(rows, ["model", "tercile"], "score", "y", ranking.tie_key(SEED, "season", "key"))
    )


@query(
    "label_volume",
    st.with_base(
        """,
v AS (SELECT season, count(*) AS rows, sum(label_c) AS positives FROM spine GROUP BY season)
SELECT CAST(a.season AS INTEGER) AS season, CAST(a.rows AS BIGINT) AS rows, CAST(a.positives AS BIGINT) AS positives, CAST(b.positives AS BIGINT) AS positives_before, round(a.positives::DOUBLE / nullif(b.positives, 0), 6) AS ratio FROM v a LEFT JOIN v b ON b.season = a.season - 1"""
    ),
)
def label_volume(spark, folder):
    """Positives per season against the season before."""
    v = st.spine(spark, folder).groupBy("season").agg(
        F.count("*").alias("rows"), F.sum("label_c").alias("positives")
    )
    one_back = W.partitionBy(F.lit(0)).orderBy("season").rangeBetween(-1, -1)  # one row per season
    out = v.withColumn("positives_before", F.max("positives").over(one_back))
    return st.rounded(out.withColumn("ratio", F.try_divide("positives", "positives_before")))
