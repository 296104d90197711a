from __future__ import annotations

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelwake.operators import order


@pytest.fixture(scope="module")
def scores(spark):
    """A third of the rows share one score."""
    rng = random.Random(3)
    rows = [(g, i, 0.5 if rng.random() < 0.34 else round(rng.random(), 2)) for g in ("a", "b") for i in range(400)]
    return pd.DataFrame(rows, columns=["g", "k", "s"])


@pytest.mark.parametrize("splits", [None, [], [0.5], [0.1, 0.2, 0.5, 0.51]])
def test_prefix_sums_do_not_depend_on_splits(spark, scores, splits):
    df = spark.createDataFrame(scores)
    s = order.split_points(df, "s", 8) if splits is None else splits
    counts = df.groupBy("g", "s").agg(F.count("*").alias("n"))
    got = order.prefix_sums(counts, ["g"], "s", ["n"], s, descending=True).toPandas()
    for _, r in got.iterrows():
        rows = scores[(scores.g == r.g) & (scores.s >= r.s)]
        assert r.cum_n == len(rows) and r.all_n == 400


def test_quantiles_equal_numpy(spark, scores):
    got = order.quantiles(spark.createDataFrame(scores), ["g"], "s", [0.1, 0.5, 0.9]).toPandas().set_index("g")
    for g, part in scores.groupby("g"):
        want = np.percentile(part.s, [10, 50, 90])
        assert np.allclose(got.loc[g, ["q0", "q1", "q2"]].to_numpy(dtype=float), want)


def test_quantiles_without_groups(spark, scores):
    row = order.quantiles(spark.createDataFrame(scores), [], "s", [0.25]).first()
    assert row["q0"] == pytest.approx(np.percentile(scores.s, 25))


def test_row_numbers_are_a_total_order(spark, scores):
    df = spark.createDataFrame(scores).repartition(5)
    got = order.row_numbers(df, [F.desc("s"), F.asc("g"), F.asc("k")]).toPandas().sort_values("rank")
    want = scores.sort_values(["s", "g", "k"], ascending=[False, True, True])
    assert list(got["rank"]) == list(range(1, 801))
    assert list(zip(got.g, got.k)) == list(zip(want.g, want.k))
    assert set(got.all_rows) == {800}


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 9, 10, 11, 180])
def test_terciles(spark, n):
    rows = spark.range(1, n + 1).select(order.tercile(F.col("id"), F.lit(n)).alias("t")).toPandas().t
    edges = [1 + (n - 1) / 3, 1 + 2 * (n - 1) / 3]
    want = [1 if 3 * (r - 1) <= n - 1 else 2 if 3 * (r - 1) <= 2 * (n - 1) else 3 for r in range(1, n + 1)]
    assert sorted(rows) == want
    assert all(abs(sum(1 for w in want if w == k) - n / 3) < 1.5 for k in (1, 2, 3)), edges


def test_lookup_of_hot_keys(spark, scores):
    df = spark.createDataFrame(scores)
    facts = df.groupBy("g", "s").agg(F.count("*").alias("n")).withColumn("v", F.col("s") * 2)
    left = df.unionByName(spark.createDataFrame([("c", 1, 0.5)], "g string, k int, s double"))
    left = left.unionByName(spark.createDataFrame([(None, 7, 0.5)], "g string, k int, s double"))
    got = order.lookup_skewed(left, facts, ["g", "s"], F.col("n"), 800, F.col("k")).toPandas()
    assert len(got) == 802 and got[got.g.isna()].v.isna().all()
    got = got[got.g.notna()]
    assert got[got.g == "c"].v.isna().all()
    rest = got[got.g != "c"]
    assert (rest.v == rest.s * 2).all()


@pytest.mark.parametrize("slices", [0, 1, 8, 200])
def test_null_values_and_null_groups_do_not_depend_on_slices(spark, slices):
    rows = [(g, i, None if i % 5 == 0 else float(i % 7)) for g in ("a", None) for i in range(40)]
    df = spark.createDataFrame(rows, "g string, k int, s double")
    splits = [7.0 * i / slices for i in range(1, slices)]
    counts = df.groupBy("g", "s").agg(F.count("*").alias("n"))
    got = order.prefix_sums(counts, ["g"], "s", ["n"], splits).collect()
    assert {r["g"] for r in got} == {"a", None} and {r["all_n"] for r in got} == {32}
    assert all(r["s"] is not None for r in got)
    assert {(r["g"], r["s"]): r["cum_n"] for r in got} == {
        (g, float(v)): sum(1 for h, _, s in rows if h == g and s is not None and s <= v) for g in ("a", None) for v in range(7)
    }
    q = {r["g"]: r["q0"] for r in order.quantiles(df, ["g"], "s", [0.5], splits).collect()}
    want = np.median([s for g, _, s in rows if g == "a" and s is not None])
    assert q == {"a": want, None: want}
