from __future__ import annotations

import random
from math import comb

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelwake.operators import ranking


def brute(y, s):
    order = sorted(range(len(y)), key=lambda i: -s[i])
    ap, seen, hits = 0.0, 0, 0
    i = 0
    while i < len(order):
        j = i
        while j < len(order) and s[order[j]] == s[order[i]]:
            j += 1
        tp = sum(y[k] for k in order[i:j])
        hits, seen = hits + tp, j
        ap += tp / sum(y) * hits / seen
        i = j
    pos, neg = [s[i] for i in range(len(y)) if y[i]], [s[i] for i in range(len(y)) if not y[i]]
    auc = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))
    return ap, auc


def test_areas_equal_brute_force(spark):
    rng = random.Random(1)
    y = [int(rng.random() < 0.2) for _ in range(300)]
    s = [round(rng.random() + 0.3 * v, 1) for v in y]
    df = spark.createDataFrame(list(zip(range(300), y, s)), "k int, y int, s double").withColumn("g", F.lit(1))
    r = ranking.report(df, ["g"], "s", "y", ranking.tie_key(42, "k"), [10, 250, 500]).first()
    ap, auc = brute(y, s)
    assert r["pr_auc"] == pytest.approx(ap, abs=1e-12) and r["roc_auc"] == pytest.approx(auc, abs=1e-12)
    assert r["p_at_500"] is None and r["n"] == 300 and r["pos"] == sum(y)


def test_one_class_has_no_areas(spark):
    df = spark.createDataFrame([(1, 1, 0.1), (2, 1, 0.2)], "k int, y int, s double").withColumn("g", F.lit(1))
    r = ranking.report(df, ["g"], "s", "y", F.col("k"), [1, 2]).first()
    assert r["pr_auc"] is None and r["roc_auc"] is None and r["p_at_2"] == 1.0


def test_all_scores_tied(spark):
    df = spark.createDataFrame([(i, int(i < 3), 0.5) for i in range(10)], "k int, y int, s double").withColumn("g", F.lit(1))
    r = ranking.report(df, ["g"], "s", "y", F.col("k"), [5]).first()
    assert r["pr_auc"] == pytest.approx(0.3) and r["roc_auc"] == pytest.approx(0.5) and r["p_at_5"] == 0.6


def test_top_k_with_a_third_of_the_rows_tied_at_the_edge(spark):
    df = spark.range(6000).select(
        "id", F.lit("a").alias("g"), F.when(F.col("id") % 3 == 0, 0.5).otherwise(F.col("id") / 6000).alias("s"), (F.col("id") % 7 == 0).cast("int").alias("y")
    ).unionByName(spark.range(50).select("id", F.lit("b").alias("g"), F.lit(0.5).alias("s"), F.lit(1).alias("y")))
    tie = ranking.tie_key(42, "id")
    got = {r["g"]: r for r in ranking.report(df, ["g"], "s", "y", tie, [100, 2500, 4000]).collect()}
    pdf = df.withColumn("t", tie).where("g = 'a'").toPandas().sort_values(["s", "t"], ascending=[False, True])
    for k in (100, 2500, 4000):
        assert got["a"][f"p_at_{k}"] == pytest.approx(pdf.y.head(k).sum() / k)
    assert got["b"]["p_at_100"] is None and got["b"]["n"] == 50


def test_top_k_is_cut_before_the_shuffle(spark):
    df = spark.range(5000).select("id", (F.col("id") % 2).alias("g"), (F.col("id") % 97).cast("double").alias("s"), (F.col("id") % 2).alias("y"))
    plan = ranking.report(df, ["g"], "s", "y", F.col("id"), [100, 2500])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 2


def test_rank_percentiles_average_ties(spark):
    df = spark.createDataFrame([(1, 3.0), (1, 2.0), (1, 2.0), (1, 1.0)], "g int, s double")
    r = {x["s"]: x for x in ranking.rank_percentiles(df, ["g"], "s").collect()}
    assert [r[s]["avg_rank"] for s in (3.0, 2.0, 1.0)] == [1.0, 2.5, 4.0]
    assert [r[s]["pct"] for s in (3.0, 2.0, 1.0)] == [1.0, 0.5, 0.0]


@pytest.mark.parametrize("n, k", [(35, 13), (35, 22), (10, 10), (10, 0), (1, 1), (400, 230)])
def test_sign_test_tail(spark, n, k):
    rows = [(0.1,)] * k + [(-0.1,)] * (n - k) + [(0.0,)] * 3
    r = ranking.sign_test(spark.createDataFrame(rows, "d double").withColumn("g", F.lit(1)), ["g"], "d").first()
    want = sum(comb(n, i) for i in range(k, n + 1)) / 2**n
    assert r["p_one_sided"] == pytest.approx(want, rel=1e-10)
    assert (r["n_signtest"], r["n_positive"], r["n_dropped_zero"], r["realized_n"]) == (n, k, 3, n + 3)
    if (n, k) == (35, 13):
        assert r["p_one_sided"] == pytest.approx(0.95523446053267, abs=1e-12)


def test_sign_test_without_movement(spark):
    df = spark.createDataFrame([(0.0,), (0.0,)], "d double").withColumn("g", F.lit(1))
    r = ranking.sign_test(df, ["g"], "d").first()
    assert r["p_one_sided"] is None and r["reject"] is None and r["median_delta"] == 0.0


def test_best_and_margin(spark):
    df = spark.createDataFrame([("a", 0.5, 0.1), ("b", 0.7, 0.2), ("c", 0.7, 0.3)], "c string, ap double, p double")
    rows = ranking.lexicographic_best(df, [F.desc("ap"), F.desc("p"), F.asc("c")], "ap").orderBy("place").collect()
    assert [r["c"] for r in rows] == ["c", "b"] and rows[0]["margin"] == 0.0


def test_tie_key_depends_on_the_row_only(spark):
    df = spark.createDataFrame([(i, 2000) for i in range(50)], "k int, season int")
    a = {r["k"]: r["t"] for r in df.select("k", ranking.tie_key(1, "season", "k").alias("t")).collect()}
    b = {r["k"]: r["t"] for r in df.where("k > 25").repartition(3).select("k", ranking.tie_key(1, "season", "k").alias("t")).collect()}
    assert all(a[k] == v for k, v in b.items()) and len(set(a.values())) == 50


def test_spread(spark):
    df = spark.createDataFrame([("m", 1.0), ("m", 3.0)], "m string, v double")
    r = ranking.spread(df, ["m"], "v").first()
    assert (r["mean"], r["std"], r["range"]) == (2.0, np.std([1.0, 3.0]), 2.0)


def test_sign_test_beyond_a_hundred_thousand_terms(spark):
    """The SQL text sums terms below 100,000 only; the operator sums whole tails."""
    rows = spark.range(500_000).select(F.lit("a").alias("g"), F.when(F.col("id") < 240_000, 1.0).otherwise(-1.0).alias("d"))
    (r,) = ranking.sign_test(rows, ["g"], "d").collect()
    assert (r["n_signtest"], r["n_positive"]) == (500_000, 240_000)
    assert r["p_one_sided"] > 0.999999 and not r["reject"]
