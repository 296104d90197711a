"""Queries on models with stated weights, which SQL can check, on bundles and on drawn configurations."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwake.functions import numeric
from panelwake.operators import compiled, models, twohead
from panelwake.operators.compiled import Node
from panelwake.plans import model_queries as mq
from panelwake.plans import standins as st
from panelwake.plans.panel_queries import COUNT_SQL, LABEL_SQL, YEARLY_SQL
from panelwake.plans.registry import query
from panelwake.session import durable, scratch_path

FROZEN_FEATURES = ["viol_lag1", "viol_recency", "viol_cnt_prior_cum", "c311_prior1", "borough"]
FROZEN_CATEGORIES = {"borough": mq.BOROUGHS}
FROZEN_TREES = 3
# Inputs in the order of the features: a number and its NULL flag each, then the level (0: any other).
FROZEN = [
    Node(0, 0, feature=0, threshold=0.5, low=1, high=2),
    Node(0, 1, feature=4, threshold=2.5, low=3, high=4),
    Node(0, 2, feature=6, threshold=1.5, low=5, high=6),
    Node(0, 3, -0.6), Node(0, 4, -0.2), Node(0, 5, 0.1), Node(0, 6, 0.5),
    Node(1, 0, weight=0.25, feature=8, levels=[0.0, 1.0, 2.0, 5.0], low=1, high=2),
    Node(1, 1, -0.3, weight=0.25),
    Node(1, 2, weight=0.25, feature=4, threshold=5.0, low=3, high=4),
    Node(1, 3, 0.2, weight=0.25), Node(1, 4, 0.4, weight=0.25),
    Node(2, 0, weight=0.5, feature=3, threshold=0.5, low=1, high=2),
    Node(2, 1, weight=0.5, feature=2, threshold=2.5, low=3, high=4),
    Node(2, 2, -0.45, weight=0.5), Node(2, 3, 0.35, weight=0.5), Node(2, 4, -0.15, weight=0.5),
]

FRAME_SQL = f"""{LABEL_SQL},{COUNT_SQL},{YEARLY_SQL},{mq.LABELLED_SQL},
b AS (SELECT lab.key, lab.season, lab.y, lab.k_raw, lab.u_raw, lab.eligible, lab.p_type, viol_lag1, viol_lag2, viol_recency, viol_cnt_prior_cum, c311_prior1 FROM lab
  JOIN fam_label a ON a.key = lab.key AND a.season = lab.season JOIN fam_count c ON c.key = lab.key AND c.season = lab.season JOIN fam_yearly d ON d.key = lab.key AND d.season = lab.season)"""


@query(
    "frozen_ensemble",
    st.with_base(
        f""",{FRAME_SQL},
t AS (SELECT key, season,
  CASE WHEN coalesce(viol_lag1, -1) <= 0.5 THEN CASE WHEN coalesce(viol_cnt_prior_cum, -1) <= 2.5 THEN -0.6 ELSE -0.2 END ELSE CASE WHEN coalesce(c311_prior1, -1) <= 1.5 THEN 0.1 ELSE 0.5 END END::DOUBLE AS t0,
  CASE WHEN coalesce(p_type, '') NOT IN ('MEDIUM', 'PROMO', 'STANDARD') THEN -0.3 WHEN coalesce(viol_cnt_prior_cum, -1) <= 5 THEN 0.2 ELSE 0.4 END::DOUBLE AS t1,
  CASE WHEN viol_recency IS NULL THEN -0.45 WHEN viol_recency <= 2.5 THEN 0.35 ELSE -0.15 END::DOUBLE AS t2 FROM b)
SELECT key, CAST(season AS INTEGER) AS season, CAST(3 AS INTEGER) AS trees, round(1 / (1 + exp(-2 * (t0 + 0.25 * t1 + 0.5 * t2))), 6) AS score FROM t"""
    ),
)
def frozen_ensemble(spark, folder):
    """A stated ensemble of trees scored on every panel row by column expressions; its tree count asserted."""
    compiled.require_nodes(FROZEN, FROZEN_TREES)
    scored = compiled.score_nodes(FROZEN, mq.model_frame(spark, folder), FROZEN_FEATURES, FROZEN_CATEGORIES, "score")
    trees = F.lit(len({n.tree for n in FROZEN})).alias("trees")
    return scored.select("key", "season", trees, F.round("score", 6).alias("score"))


@query("tree_bundle")
def tree_bundle(spark, folder, rounds: int = 5, depth: int = 3):
    """Per fold: trees fitted, saved as a bundle, loaded with all checks, and scored by column expressions
    beside the fitted model; the largest difference and rows without partner."""
    frame = mq.model_frame(spark, folder)
    out = None
    for fold in mq.FOLDS:
        train, valid = models.train_rows(frame, fold, mq.FIRST), models.validation_rows(frame, fold)
        inputs = train.select("key", "season", "y", *mq.TREE_FEATURES)
        fitted = models.fit_trees(train, mq.TREE_FEATURES, mq.CATEGORIES, "y", rounds=rounds, depth=depth)
        place = scratch_path(spark, "bundle")
        fitted.save(f"{place}/model")
        manifest = {"trees": rounds, "features": mq.TREE_FEATURES, "categories": mq.CATEGORIES, "fold": fold}
        compiled.save_bundle(place, compiled.saved_nodes(spark, f"{place}/model"), manifest, inputs)
        nodes, kept = compiled.load_bundle(spark, place, inputs)
        a = models.score_trees(fitted, valid, mq.TREE_FEATURES, mq.CATEGORIES, "score")
        b = compiled.score_nodes(nodes, valid, kept["features"], kept["categories"], "score")
        row = models.reload_difference(a, b, ["key", "season"], "score").select(
            F.lit(fold).alias("fold"),
            F.lit(kept["trees"]).alias("trees"),
            F.lit(kept["trained_on"]["rows"]).cast("long").alias("trained_on"),
            F.round("max_abs_diff", 9).alias("max_abs_diff"),
            "unpaired",
        )
        out = row if out is None else out.unionByName(row)
    return out


# -- two-head model with stated weights ----------------------------------------------------------

CAP = 25.0
D = 13  # design columns
WIDTH = 3
RATE, LAM, MU1, MU2 = 0.1, 0.3, 0.01, 0.1

DESIGN_SQL = f"""{FRAME_SQL},
m AS (SELECT avg(viol_recency) AS m1, stddev_pop(viol_recency) AS s1, avg(viol_cnt_prior_cum) AS m2, stddev_pop(viol_cnt_prior_cum) AS s2, avg(c311_prior1) AS m3, stddev_pop(c311_prior1) AS s3 FROM b WHERE season < 2000),
x AS (SELECT key, season, y::DOUBLE AS y, eligible, least(u_raw, 25.0) AS u, least(k_raw, least(u_raw, 25.0)) AS k,
  coalesce((viol_recency - m1) / s1, 0.0) AS x0, coalesce((viol_cnt_prior_cum - m2) / s2, 0.0) AS x1, coalesce((c311_prior1 - m3) / s3, 0.0) AS x2, viol_lag1::DOUBLE AS x3, viol_lag2::DOUBLE AS x4,
  (viol_recency IS NULL)::DOUBLE AS x5, (c311_prior1 IS NULL)::DOUBLE AS x6, {', '.join(f"(p_type = '{b}')::DOUBLE AS x{7 + i}" for i, b in enumerate(mq.BOROUGHS))} FROM b, m)"""


def stated(i: int, j: int) -> float:
    """Weights that any engine can write down: tenths between -0.5 and 0.5."""
    return ((7 * i + 3 * j) % 11 - 5) / 10


def design_rows(spark, folder, fold: int) -> tuple[DataFrame, list[str]]:
    """Design columns with capped units and reports; moments of the seasons before the fold."""
    frame = mq.model_frame(spark, folder)
    u, k = numeric.cap_units(F.col("u_raw"), F.col("k_raw").cast("double"), CAP)
    cols = mq.design(frame, mq.moments_of(frame, fold))
    rows = frame.select(
        "key", "season", F.array(*cols.values()).alias("x"), F.col("y").cast("double").alias("y"),
        u.alias("u"), k.alias("k"), "eligible",
    )
    return rows, list(cols)


def _sum_sql(names: list[str], weights: list[float], bias: float) -> str:
    return " + ".join([*[f"({w}) * {n}" for n, w in zip(names, weights)], f"({bias})"])


INPUTS = [f"x{i}" for i in range(D)]
HIDDEN = [f"h{j}" for j in range(WIDTH)]


@query(
    "two_head_stated",
    st.with_base(
        f""",{DESIGN_SQL},
h AS (SELECT *, {', '.join(f"greatest(0.0, {_sum_sql(INPUTS, [stated(i, j) for i in range(D)], stated(D, j))}) AS h{j}" for j in range(WIDTH))} FROM x),
z AS (SELECT *, 1 / (1 + exp(-({_sum_sql(HIDDEN, [stated(j, 1) for j in range(WIDTH)], -1.0)}))) AS f, greatest(1e-7, least(1 - 1e-7, 1 / (1 + exp(-({_sum_sql(HIDDEN, [stated(j, 2) for j in range(WIDTH)], -2.0)}))))) AS p FROM h)
SELECT key, CAST(season AS INTEGER) AS season, round(f, 6) AS f, round(p, 6) AS p, round(greatest(1e-7, least(1 - 1e-7, f * (1 - pow(1 - p, u)))), 6) AS q FROM z"""
    ),
)
def two_head_stated(spark, folder):
    """A two-head model with stated weights and one hidden layer, scored on every row inside the JVM."""
    rows, names = design_rows(spark, folder, 2000)
    parts = [
        [stated(i, j) for i in range(len(names)) for j in range(WIDTH)],
        [stated(D, j) for j in range(WIDTH)],
        [*[stated(j, 1) for j in range(WIDTH)], -1.0],
        [*[stated(j, 2) for j in range(WIDTH)], -2.0],
    ]
    scored = twohead.stated_scores(rows, np.concatenate(parts), twohead.Settings(width=WIDTH))
    return scored.select("key", "season", *[F.round(c, 6).alias(c) for c in ("f", "p", "q")])


def linear_weights() -> list[float]:
    """Weights of two linear heads: failure, its bias, reporting, its bias."""
    failure = [((3 * i) % 7 - 4) / 10 for i in range(D)]
    report = [((3 * i) % 5 - 2) / 10 for i in range(D)]
    return [*failure, -1.0, *report, -2.0]


def _step_sql() -> str:
    w = linear_weights()
    failure, report = w[:D], w[D + 1 : 2 * D + 1]
    shifted = [n if n != "x1" else "(x1 + 0.5)" for n in INPUTS]
    slopes = [
        *[f"avg(df * {a}) + {MU2} * avg(2 * drop_ * (f * (1 - f) * {a} - f2 * (1 - f2) * {b}))" for a, b in zip([*INPUTS, "1"], [*shifted, "1"])],
        *[f"avg(dp * {a}) + {LAM} * sum(de * {a}) / greatest(count(*) FILTER (eligible), 1) + {MU1} * avg(2 * gap * {a})" for a in [*INPUTS, "1"]],
    ]
    return f""",{DESIGN_SQL},
g0 AS (SELECT *, 1 / (1 + exp(-({_sum_sql(INPUTS, failure, w[D])}))) AS f, 1 / (1 + exp(-({_sum_sql(shifted, failure, w[D])}))) AS f2, greatest(1e-7, least(1 - 1e-7, 1 / (1 + exp(-({_sum_sql(INPUTS, report, w[-1])}))))) AS p,
  (SELECT sum(k) FILTER (eligible) / sum(u) FILTER (eligible) FROM x WHERE season < 2000) AS pbar FROM x WHERE season < 2000),
g1 AS (SELECT *, 1 - pow(1 - p, u) AS r, u * pow(1 - p, u - 1) AS rp, greatest(0, f - f2) AS drop_, ln(p) - ln(1 - p) - ln(pbar / (1 - pbar)) AS gap FROM g0),
g2 AS (SELECT *, greatest(1e-7, least(1 - 1e-7, f * r)) AS q FROM g1),
g3 AS (SELECT *, -(y / q - (1 - y) / (1 - q)) AS dq FROM g2),
g4 AS (SELECT *, dq * r * f * (1 - f) AS df, dq * f * rp * p * (1 - p) AS dp, CASE WHEN eligible THEN -(k / p - (u - k) / (1 - p) - rp / greatest(r, 1e-12)) * p * (1 - p) ELSE 0 END AS de FROM g3),
g5 AS (SELECT [{', '.join(slopes)}] AS g, {w}::DOUBLE[] AS w FROM g4)
SELECT CAST(i AS INTEGER) AS place, w[i + 1] AS weight, round(g[i + 1], 6) AS slope, round(w[i + 1] - {RATE} * g[i + 1], 6) AS stepped FROM g5, (SELECT unnest(range({len(w)})) AS i)"""


@query("two_head_step", st.with_base(_step_sql()))
def two_head_step(spark, folder):
    """One gradient step of two linear heads from stated weights on all training seasons."""
    rows, names = design_rows(spark, folder, 2000)
    rows = durable(models.train_rows(rows, 2000, mq.FIRST))
    sums = rows.where("eligible").agg(F.sum("k").alias("k"), F.sum("u").alias("u")).first()
    s = twohead.Settings(
        width=0, lam=LAM, mu1=MU1, mu2=MU2, pbar=sums["k"] / sums["u"], shift_index=names.index("viol_cnt_prior_cum")
    )
    theta = np.array(linear_weights())
    _, slope = twohead.evaluate(rows, theta, s)
    found = [(i, float(t), round(float(g), 6), round(float(t - RATE * g), 6)) for i, (t, g) in enumerate(zip(theta, slope))]
    return spark.createDataFrame(found, "place int, weight double, slope double, stepped double")


# -- drawn configurations ------------------------------------------------------------------------

DRAWS, DRAW_SEED = models.SAMPLED_CONFIGS, 42
FIT_SEEDS = [42, 43, 44]


def _draws_sql() -> str:
    sizes = [len(v) for _, v in models.RISK_DIMS]
    cut = len(sizes) // 2
    high, low = math.prod(sizes[:cut]), math.prod(sizes[cut:])
    text = f"d0 AS (SELECT n // {low} AS a, n % {low} AS b FROM (SELECT unnest(range({DRAWS})) AS n))"
    for turn in range(models.ROUNDS):
        moved, other, size = ("a", "b", high) if turn % 2 == 0 else ("b", "a", low)
        hashed = f"('0x' || substr(md5('{DRAW_SEED}|{turn}|' || {other}), 1, 8))::BIGINT"
        text += f",\nd{turn + 1} AS (SELECT ({moved} + {hashed}) % {size} AS {moved}, {other} FROM d{turn})"
    decoded, place = [], 1
    for name, values in reversed(models.RISK_DIMS):
        kind = {int: "INTEGER", float: "DOUBLE", str: "VARCHAR"}[type(values[0])]
        decoded.insert(0, f"CAST({values}[config // {place} % {len(values)} + 1] AS {kind}) AS {name}")
        place *= len(values)
    return f""",{mq.LABELLED_SQL}, {text},
c AS (SELECT a * {low} + b AS config FROM d{models.ROUNDS}),
n AS (SELECT fold, count(*) AS train_rows, sum(y) AS train_positives FROM lab, folds WHERE season < fold GROUP BY fold)
SELECT CAST(config AS BIGINT) AS config, {', '.join(decoded)}, CAST(fold AS INTEGER) AS fold, CAST(seed AS INTEGER) AS seed, CAST(train_rows AS BIGINT) AS train_rows, CAST(train_positives AS BIGINT) AS train_positives
FROM c, n, (SELECT unnest({FIT_SEEDS}) AS seed)"""


@query("grid_draws", st.with_base(_draws_sql()))
def grid_draws(spark, folder):
    """Work list of the risk search: every drawn configuration with every fold and seed, and what each
    fit would be trained on."""
    configs = models.sampled_configs(spark, models.RISK_DIMS, DRAWS, DRAW_SEED)
    work = models.work_list(configs, mq.FOLDS, FIT_SEEDS)
    per = mq.labelled(spark, folder).groupBy("season").agg(F.count("*").alias("rows"), F.sum("y").alias("positives"))
    sizes = models.fold_totals(per, mq.FOLDS, [], ["rows", "positives"]).where("split = 'train'")
    return work.join(
        sizes.select("fold", F.col("rows").alias("train_rows"), F.col("positives").alias("train_positives")), "fold", "left"
    )
