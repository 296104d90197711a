"""Compiled trees, bundles, two-head scores inside the JVM, and the keyed permutation."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelwake.operators import compiled, models, twohead
from panelwake.operators.compiled import Node
from panelwake.plans import stated_queries as sq
from panelwake.sources.contracts import ContractError

CATS = {"c": ["A", "B", "C"]}
FEATURES = ["a", "b", "c"]


def rows(spark, n=900):
    rng = np.random.default_rng(11)
    a, b = rng.normal(size=n), rng.normal(size=n)
    y = (rng.random(n) < 1 / (1 + np.exp(-2 * a + b))).astype(float)
    data = [
        (i, float(y[i]), None if i % 7 == 0 else float(a[i]), float(b[i]), None if i % 5 == 0 else "ABCD"[i % 4])
        for i in range(n)
    ]
    return spark.createDataFrame(data, "key int, y double, a double, b double, c string").cache()


@pytest.fixture(scope="module")
def bundle(spark, tmp_path_factory):
    place = str(tmp_path_factory.mktemp("bundle"))
    df = rows(spark)
    fitted = models.fit_trees(df, FEATURES, CATS, "y", rounds=6, depth=4)
    fitted.save(f"{place}/model")
    manifest = {"trees": 6, "features": FEATURES, "categories": CATS}
    compiled.save_bundle(place, compiled.saved_nodes(spark, f"{place}/model"), manifest, df)
    return place, df, fitted


def test_compiled_trees_equal_the_fitted_model(spark, bundle):
    place, df, fitted = bundle
    nodes, kept = compiled.load_bundle(spark, place, df)
    assert any(n.levels for n in nodes) and len({n.tree for n in nodes}) == 6
    a = models.score_trees(fitted, df, FEATURES, CATS, "s")
    b = compiled.score_nodes(nodes, df, kept["features"], kept["categories"], "s")
    row = models.reload_difference(a, b, ["key"], "s").first()
    assert row["max_abs_diff"] < 1e-12 and row["unpaired"] == 0
    assert b.columns == [*df.columns, "s"]
    plan = b._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_a_changed_bundle_is_refused(spark, bundle, tmp_path):
    place, df, _ = bundle
    with pytest.raises(ContractError, match="training rows"):
        compiled.load_bundle(spark, place, df.where("key > 3"))
    nodes = spark.read.parquet(f"{place}/nodes")
    text = spark.read.parquet(f"{place}/manifest")
    other = str(tmp_path / "nodes")
    nodes.withColumn("value", F.col("value") + 0.001).write.parquet(f"{other}/nodes")
    text.write.parquet(f"{other}/manifest")
    with pytest.raises(ContractError, match="nodes"):
        compiled.load_bundle(spark, other)
    edited = str(tmp_path / "text")
    nodes.write.parquet(f"{edited}/nodes")
    text.withColumn("manifest", F.replace("manifest", F.lit('"trees": 6'), F.lit('"trees": 7'))).write.parquet(f"{edited}/manifest")
    with pytest.raises(ContractError, match="manifest"):
        compiled.load_bundle(spark, edited)


def test_tree_count_and_children_are_asserted():
    stump = [Node(0, 0, feature=0, threshold=1.0, low=1, high=2), Node(0, 1, 0.1), Node(0, 2, 0.2)]
    compiled.require_nodes(stump, 1)
    with pytest.raises(ContractError, match="1 trees"):
        compiled.require_nodes(stump, 343)
    with pytest.raises(ContractError, match="children"):
        compiled.require_nodes(stump[:2], 1)


def test_compiled_trees_on_an_empty_table(spark):
    df = rows(spark).where("key < 0")
    stump = [Node(0, 0, feature=0, threshold=1.0, low=1, high=2), Node(0, 1, 0.1), Node(0, 2, 0.2)]
    assert compiled.score_nodes(stump, df, FEATURES, CATS, "s").count() == 0


@pytest.mark.parametrize("width", [0, 5])
def test_two_head_scores_of_the_jvm_equal_those_of_numpy(spark, width):
    rng = np.random.default_rng(3)
    s = twohead.Settings(width=width)
    theta = rng.normal(size=sum(int(np.prod(shape)) for _, shape in twohead.shapes(4, s)))
    data = [(i, [float(v) for v in rng.normal(size=4)], float(1 + i % 30)) for i in range(200)]
    df = spark.createDataFrame(data, "key int, x array<double>, u double")
    a = twohead.score(df, theta, s).orderBy("key").collect()
    b = twohead.stated_scores(df, theta, s).orderBy("key").collect()
    for c in ("f", "p", "q"):
        assert np.allclose([r[c] for r in a], [r[c] for r in b], rtol=0, atol=1e-12)
    assert a[0].__fields__ == b[0].__fields__


@pytest.mark.parametrize("sizes", [[2, 3], [3, 3, 3, 2], [7], [1, 1]])
def test_permutation_visits_every_place_once(spark, sizes):
    n = int(np.prod(sizes))
    for seed in (1, 42):
        got = [r[0] for r in spark.range(n).select(models.permuted(F.col("id"), sizes, seed)).collect()]
        assert sorted(got) == list(range(n))


def test_draws_do_not_sort_the_space(spark):
    few = models.sampled_configs(spark, models.RISK_DIMS, 5, 42)
    more = models.sampled_configs(spark, models.RISK_DIMS, 60, 42)
    assert {r["config"] for r in few.collect()} < {r["config"] for r in more.collect()}
    other = models.sampled_configs(spark, models.RISK_DIMS, 60, 43)
    assert {r["config"] for r in other.collect()} != {r["config"] for r in more.collect()}


def test_bundles_of_every_fold_score_alike(spark):
    got = sq.tree_bundle(spark, "/root/testdata/sf0.001", rounds=3, depth=3).collect()
    assert [r["fold"] for r in got] == sq.mq.FOLDS
    assert all(r["trees"] == 3 and r["unpaired"] == 0 and r["max_abs_diff"] < 1e-9 and r["trained_on"] > 0 for r in got)
