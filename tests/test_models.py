from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from panelwake.operators import models, ranking, twohead
from panelwake.plans import model_queries as mq


@pytest.fixture(scope="module")
def batch():
    rng = np.random.default_rng(0)
    n = 200
    u = rng.integers(1, 12, n).astype(float)
    k = np.minimum(rng.integers(0, 5, n), u).astype(float)
    y = rng.integers(0, 2, n).astype(float)
    return dict(y=y, u=u, k=k, el=(y == 1) & (k >= 1), f=rng.uniform(0.01, 0.99, n), p=rng.uniform(0.001, 0.6, n), fs=rng.uniform(0.01, 0.99, n))


def test_loss_terms_equal_numpy(spark, batch):
    b = batch
    cols = zip(*[b[c].tolist() for c in ("y", "f", "p", "u", "k", "el", "fs")])
    df = spark.createDataFrame(list(cols), "y double, f double, p double, u double, k double, eligible boolean, f_shifted double")
    got = twohead.loss_terms(df.withColumns({"pbar": F.lit(0.1), "g": F.lit(1)}), ["g"], 0.3, 0.01, 0.1).first()
    r = 1 - (1 - b["p"]) ** b["u"]
    q = np.clip(b["f"] * r, 1e-7, 1 - 1e-7)
    bce = -(b["y"] * np.log(q) + (1 - b["y"]) * np.log(1 - q)).mean()
    e = b["el"]
    lg = np.vectorize(math.lgamma)
    u, k, p = b["u"][e], b["k"][e], b["p"][e]
    nll = -(lg(u + 1) - lg(k + 1) - lg(u - k + 1) + k * np.log(p) + (u - k) * np.log(1 - p) - np.log(r[e])).mean()
    om1 = ((np.log(b["p"]) - np.log(1 - b["p"]) - math.log(0.1 / 0.9)) ** 2).mean()
    om2 = (np.maximum(0, b["f"] - b["fs"]) ** 2).mean()
    for name, want in (("bce", bce), ("nll", nll), ("omega1", om1), ("omega2", om2), ("total", bce + 0.3 * nll + 0.01 * om1 + 0.1 * om2)):
        assert got[name] == pytest.approx(want, abs=1e-12), name


@pytest.mark.parametrize("width", [0, 3])
def test_gradient_equals_differences(batch, width):
    b = batch
    s = twohead.Settings(width=width, shift_index=1, pbar=0.1)
    rng = np.random.default_rng(1)
    x = rng.normal(size=(len(b["y"]), 4))
    theta = twohead.initial(4, s) + rng.normal(scale=0.1, size=len(twohead.initial(4, s)))
    sums = lambda t: twohead.batch_sums(t, x, b["y"], b["u"], b["k"], b["el"], s)
    base = sums(theta)
    grads = base[6:].reshape(4, -1)
    for i in range(len(theta)):
        step = np.zeros_like(theta)
        step[i] = 1e-6
        slope = (sums(theta + step)[2:6] - sums(theta - step)[2:6]) / 2e-6
        assert np.allclose(grads[:, i], slope, rtol=1e-4, atol=1e-4)


def panel(spark, n=600):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(n, 2))
    y = (rng.random(n) < 1 / (1 + np.exp(-x[:, 0] * 2))).astype(int)
    rows = [(i, 1995 + i % 6, int(y[i]), float(x[i, 0]), None if i % 9 == 0 else float(x[i, 1]), "ABC"[i % 3], int(3 + i % 7), int(i % 4)) for i in range(n)]
    return spark.createDataFrame(rows, "key int, season int, y int, a double, b double, c string, u int, k int")


def test_fit_lowers_the_loss_and_scores_survive_a_reload(spark, tmp_path):
    df = panel(spark).select(
        "key", "season", F.array("a", F.coalesce("b", F.lit(0.0))).alias("x"), F.col("y").cast("double").alias("y"),
        F.col("u").cast("double").alias("u"), F.least("k", "u").cast("double").alias("k"), ((F.col("y") == 1) & (F.col("k") >= 1)).alias("eligible"),
    ).cache()
    s = twohead.Settings(width=4, epochs=12, patience=12, rate=0.1, shift_index=0)
    theta, log = twohead.fit(df.where("season < 2000"), df.where("season = 2000"), 2, s)
    assert min(r["valid"] for r in log) < log[0]["valid"] and log[-1]["train"] < log[0]["train"]
    twohead.save_weights(spark, theta, str(tmp_path / "w"))
    again = twohead.load_weights(spark, str(tmp_path / "w"))
    a, b = twohead.score(df, theta, s), twohead.score(df, again, s)
    row = models.reload_difference(a, b, ["key", "season"], "q").first()
    assert row["max_abs_diff"] == 0.0 and row["unpaired"] == 0
    assert a.where("q <= 0 or q >= 1 or f < 0 or p < 0").count() == 0


def test_trees_reload_and_count(spark, tmp_path):
    df = panel(spark)
    cats = {"c": ["A", "B", "C"]}
    fitted = models.fit_trees(df.where("season < 2000"), ["a", "b", "c"], cats, "y", rounds=3, depth=2)
    fitted.write().overwrite().save(str(tmp_path / "m"))
    loaded = PipelineModel.load(str(tmp_path / "m"))
    models.require_trees(loaded, 3)
    with pytest.raises(ValueError):
        models.require_trees(loaded, 343)
    a = models.score_trees(fitted, df, ["a", "b", "c"], cats, "s")
    b = models.score_trees(loaded, df, ["a", "b", "c"], cats, "s")
    assert models.reload_difference(a, b, ["key"], "s").first()["max_abs_diff"] == 0.0
    r = ranking.areas(ranking.curve(a.withColumn("g", F.lit(1)), ["g"], "s", "y"), ["g"]).first()
    assert r["roc_auc"] > 0.75


def test_logistic_equals_penalised_likelihood(spark):
    """The gradient of the summed loss plus half the squared weights vanishes at the fit."""
    df = panel(spark)
    fitted, facts = models.fit_logistic(df, "a", ["b"], "c", "y")
    lr = fitted.stages[-1]
    ready = models.standardised(models.logistic_inputs(df, "a", "c", facts), facts)
    names = fitted.stages[0].getInputCols()
    pdf = ready.select("y", *names).toPandas()
    x, w = pdf[names].to_numpy(), lr.coefficients.toArray()
    p = 1 / (1 + np.exp(-(x @ w + lr.intercept)))
    assert np.abs(x.T @ (p - pdf.y) + w).max() < 0.05
    assert abs((p - pdf.y).sum()) < 0.05
    scored = models.score_logistic(fitted, df, "a", "c", facts, "s")
    assert scored.columns == [*df.columns, "s"]


def test_fold_moments_leave_nulls_out(spark):
    pdf = panel(spark).toPandas()
    got = {(r["fold"], r["column"]): r for r in models.fold_moments(panel(spark), ["a", "b"], [1998, 2000]).collect()}
    for (fold, c), r in got.items():
        v = pdf[pdf.season < fold][c].dropna().to_numpy()
        assert r["mean"] == pytest.approx(v.mean(), abs=1e-12) and r["std"] == pytest.approx(v.std(), abs=1e-12)
    empty = models.fold_moments(panel(spark).withColumn("b", F.lit(None).cast("double")), ["b"], [1998]).first()
    assert (empty["mean"], empty["std"]) == (0.0, 1.0)
    flat = models.fold_moments(panel(spark).withColumn("b", F.lit(2.5)), ["b"], [1998]).first()
    assert (flat["mean"], flat["std"]) == (2.5, 1.0)


def test_design_columns(spark):
    df = spark.createDataFrame([(3.0, 1, "x"), (None, None, None)], "a double, b int, c string")
    cols = models.design_columns({"a": (1.0, 2.0)}, ["b"], ["a"], {"c": ["x", "y"]})
    rows = [tuple(r) for r in df.select(*[c.alias(n) for n, c in cols.items()]).collect()]
    assert list(cols) == ["a", "b", "a__isna", "c==x", "c==y"]
    assert rows == [(1.0, 1.0, 0.0, 1.0, 0.0), (0.0, 0.0, 1.0, 0.0, 0.0)]


def test_search_tables(spark):
    assert models.sampled_configs(spark, models.PROPENSITY_DIMS, 10**6, 1).count() == 6561
    a = models.sampled_configs(spark, models.RISK_DIMS, 60, 42).collect()
    b = models.sampled_configs(spark, models.RISK_DIMS, 60, 42).collect()
    assert a == b and len({r["config"] for r in a}) == 60
    assert [r["config"] for r in a] == sorted(r["config"] for r in a)
    small = models.sampled_configs(spark, [("x", [1, 2]), ("y", [1, 2, 3])], 6, 1)
    assert models.repeated_projections(small, ["y"]).count() == 2
    assert models.work_list(small, [2021, 2022], [1, 2, 3]).count() == 36
    rounds = spark.createDataFrame([(1, 10), (1, 13)], "config int, best_round int")
    assert models.refit_rounds(rounds).first()["rounds"] == 12


def test_weights(spark):
    df = spark.createDataFrame([(1, 0.5), (1, 0.01), (0, 0.01)], "y int, r double")
    got = [r[0] for r in df.select(models.propensity_weight(F.col("y"), F.col("r"), 0.05)).collect()]
    assert got == [2.0, 20.0, 1.0]
    row = models.class_ratio(df, "y").first()
    assert (row["one"], row["full"]) == (1.0, 0.5)
    assert models.positive_weight("sqrt", 4.0) == 2.0


def test_folds_do_not_touch_the_future(spark):
    df = panel(spark)
    assert models.train_rows(df, 1998, 1995).agg(F.max("season")).first()[0] == 1997
    assert models.validation_rows(df, 1998).select("season").distinct().count() == 1


def test_twin_models_rank_better_than_chance(spark):
    scored = mq.gbt_ipw_twin(spark, "/root/testdata/sf0.001")
    assert scored.where("score_weighted < 0 or score_plain > 1").count() == 0


@pytest.mark.parametrize("run", [mq.gbt_ipw_twin, mq.two_head_scores])
def test_every_fold_is_scored(spark, run):
    frame = mq.labelled(spark, "/root/testdata/sf0.001").where(F.col("season").isin(mq.FOLDS))
    want = {r["season"]: r["count"] for r in frame.groupBy("season").count().collect()}
    scored = run(spark, "/root/testdata/sf0.001")
    assert {r["season"]: r["count"] for r in scored.groupBy("season").count().collect()} == want
    assert set(want) == set(mq.FOLDS)


def model_rows(spark):
    """A few rows of each season with the columns that the model queries read."""
    rows = [
        (i, 1995 + i % 6, int(i % 3 > 0), i % 4, float(2 + i % 9), i % 3 > 0 and i % 4 > 0, i % 2, (i // 2) % 2, i % 5, i % 7, None if i % 8 == 0 else i % 6, "SMALL", i % 9 == 0)
        for i in range(240)
    ]
    return spark.createDataFrame(
        rows,
        "key long, season int, y int, k_raw int, u_raw double, eligible boolean, viol_lag1 int, viol_lag2 int, viol_recency int, "
        "viol_cnt_prior_cum int, c311_prior1 int, borough string, zero_history boolean",
    ).cache()


def test_two_head_scores_fits_the_whole_network(spark, monkeypatch):
    """Width, epochs and patience of each fold are the reference's, and every fold is scored."""
    seen = []

    def fit(train, valid, d, s):
        seen.append((s.width, s.epochs, s.patience))
        return twohead.initial(d, s), []

    monkeypatch.setattr(mq, "model_frame", lambda spark, folder: model_rows(spark))
    monkeypatch.setattr(mq.twohead, "fit", fit)
    assert mq.two_head_scores(spark, "").count() == 120
    assert seen == [(256, 200, 20)] * 3


def test_twin_fits_have_all_trees_of_the_reference(spark, monkeypatch):
    """Rounds and depth of each fold's three fits are those of the frozen models."""
    seen, inner = [], models.fit_trees

    def fit(train, features, categories, label, weight=None, **settings):
        seen.append((label, weight, settings["rounds"], settings["depth"], settings["rate"]))
        return inner(train, ["viol_lag1", "borough"], {"borough": mq.BOROUGHS}, label, weight, rounds=1, depth=1)

    rows = model_rows(spark).withColumn("dup", models.duplicate_target(F.col("k_raw")).cast("double"))
    monkeypatch.setattr(mq, "TREE_FEATURES", ["viol_lag1", "borough"])
    monkeypatch.setattr(mq, "CATEGORIES", {"borough": mq.BOROUGHS})
    monkeypatch.setattr(mq, "model_frame", lambda spark, folder: rows.drop("dup"))
    monkeypatch.setattr(models, "fit_trees", fit)
    assert mq.gbt_ipw_twin(spark, "").count() == 120
    assert sorted(seen, key=str) == sorted(
        [("dup", None, 90, 6, 0.05), ("y", "w", 332, 5, 0.02), ("y", None, 307, 5, 0.02)] * 3, key=str
    )


def test_search_picks_a_winner_with_rounds(spark):
    frame = panel(spark).withColumns({"zero_history": F.col("k") == 0, "_tie": F.col("key")}).cache()
    configs = [r.asDict() for r in models.sampled_configs(spark, models.PROPENSITY_DIMS, 2, 42).collect()]
    metrics = models.search_trees(
        frame, configs, [1999, 2000], 1995, ["a", "b", "c"], {"c": ["A", "B", "C"]}, "y", overrides={"rounds": 2, "depth": 2}
    )
    assert metrics.count() == 4 and metrics.where("best_round not between 1 and 2").count() == 0
    rows = models.search_winner(metrics).orderBy("place").collect()
    assert [r["place"] for r in rows] == [1, 2] and rows[0]["mean_ap"] >= rows[1]["mean_ap"]
    assert rows[0]["margin"] == pytest.approx(rows[0]["mean_ap"] - rows[1]["mean_ap"])


def test_tree_settings():
    config = {"num_leaves": 63, "max_depth": -1, "learning_rate": 0.1, "n_estimators": 400, "min_child_samples": 20, "subsample": 0.7, "colsample_bytree": 0.6}
    got = models.tree_settings(config)
    assert got["depth"] == 6 and got["columns"] == "0.6" and got["rounds"] == 400
    assert models.tree_settings(config | {"max_depth": 4})["depth"] == 4


def test_positive_weight_and_clip_floor_change_the_fit(spark):
    frame = panel(spark).withColumns({"zero_history": F.col("k") == 0, "_tie": F.col("key"), "rhat": F.lit(0.05)}).cache()
    base = models.sampled_configs(spark, models.RISK_DIMS, 1, 42).first().asDict()
    variants = [("1", 0.1), ("full", 0.1), ("1", 0.02)]
    configs = [base | {"config": i, "scale_pos_weight": w, "clip_floor": c} for i, (w, c) in enumerate(variants)]
    got = models.search_trees(
        frame, configs, [2000], 1995, ["a", "b", "c"], {"c": ["A", "B", "C"]}, "y", overrides={"rounds": 2, "depth": 2}
    )
    assert got.count() == 3 and got.where("pr_auc is null").count() == 0


def test_trees_part_categories_without_order(spark):
    """Levels A and C against B cannot be parted by one cut of an ordered number."""
    rows = [(i, "ABC"[i % 3], int(i % 3 == 1)) for i in range(600)]
    df = spark.createDataFrame(rows, "key int, c string, y int")
    fitted = models.fit_trees(df, ["c"], {"c": ["A", "B", "C"]}, "y", rounds=1, depth=1)
    scores = {r["c"]: r["s"] for r in models.score_trees(fitted, df, ["c"], {"c": ["A", "B", "C"]}, "s").select("c", "s").distinct().collect()}
    assert scores["A"] == scores["C"] < scores["B"]


def test_trees_are_fitted_in_bounded_tasks(spark, monkeypatch):
    monkeypatch.setattr(models, "TREE_ROWS", 100)
    rows = spark.range(0, 2000, 1, 2).select("id", (F.col("id") % 7).alias("x"), (F.col("id") % 7 > 3).cast("double").alias("y"))
    held = models.spread_rows(rows).rdd.glom().map(len).collect()
    assert sum(held) == 2000 and max(held) <= 110
    assert models.spread_rows(rows.limit(50)).rdd.getNumPartitions() == rows.limit(50).rdd.getNumPartitions()
    fitted = models.fit_trees(rows, ["x"], {}, "y", rounds=2, depth=2)
    assert fitted.stages[-1].getNumTrees == 2
