"""Saved models scored as column expressions, and bundles whose parts are checked when they are loaded."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassificationModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwake.operators import models
from panelwake.sources.contracts import ContractError, fingerprint

NODES = "tree int, node int, weight double, feature int, threshold double, levels array<double>, low int, high int, value double"


@dataclass(frozen=True)
class Node:
    """A node of a tree: a leaf with a value, or a cut of one input by a threshold or by a set of levels.

    Rows at or under the threshold, or with a level of the set, go to `low`.
    """

    tree: int
    node: int
    value: float = 0.0
    weight: float = 1.0  # of its tree
    feature: int = -1
    threshold: float | None = None
    levels: list[float] = field(default_factory=list)
    low: int = -1
    high: int = -1


def saved_nodes(spark: SparkSession, path: str) -> DataFrame:
    """Node table of a saved pipeline of boosted trees, from its files alone."""
    stages = PipelineModel.load(path).stages
    at = next(i for i, s in enumerate(stages) if isinstance(s, GBTClassificationModel))
    folder = f"{path.rstrip('/')}/stages/{at}_{stages[at].uid}"
    weights = spark.read.parquet(f"{folder}/treesMetadata").toDF("tree", "_meta", "weight").select("tree", "weight")
    n = F.col("nodeData")
    cut = n["split"]
    numeric_cut = cut["numCategories"] < 0
    leaf = n["leftChild"] < 0
    nodes = spark.read.parquet(f"{folder}/data").select(
        F.col("treeID").alias("tree"),
        n["id"].alias("node"),
        cut["featureIndex"].alias("feature"),
        F.when(~leaf & numeric_cut, F.try_element_at(cut["leftCategoriesOrThreshold"], F.lit(1))).alias("threshold"),
        F.when(~leaf & ~numeric_cut, cut["leftCategoriesOrThreshold"]).otherwise(F.array().cast("array<double>")).alias("levels"),
        n["leftChild"].alias("low"),
        n["rightChild"].alias("high"),
        n["prediction"].alias("value"),
    )
    return nodes.join(weights, "tree").select(*[c.split()[0] for c in NODES.split(", ")])


def require_nodes(nodes: list[Node], trees: int) -> None:
    """Refuse an ensemble with another number of trees, or with nodes that lead nowhere."""
    got = len({n.tree for n in nodes})
    if got != trees:
        raise ContractError(f"ensemble has {got} trees, expected {trees}")
    known = {(n.tree, n.node) for n in nodes}
    lost = [n for n in nodes if n.low >= 0 and not {(n.tree, n.low), (n.tree, n.high)} <= known]
    if lost:
        raise ContractError(f"nodes without children: {lost[:3]}")


def margin(nodes: list[Node], inputs: list[Column]) -> Column:
    """Weighted sum of the trees as nested CASE expressions over the inputs; no vectors, no Python rows.

    Its size is that of the model, which its settings bound.
    """
    by_place = {(n.tree, n.node): n for n in nodes}

    def walk(n: Node) -> Column:
        if n.low < 0:
            return F.lit(n.value)
        x = inputs[n.feature]
        low = x <= n.threshold if n.threshold is not None else x.isin([float(v) for v in n.levels])
        return F.when(low, walk(by_place[n.tree, n.low])).otherwise(walk(by_place[n.tree, n.high]))

    terms = [F.lit(n.weight) * walk(n) for (_, number), n in sorted(by_place.items()) if number == 0]
    while len(terms) > 1:  # in pairs, so that the expression stays shallow
        terms = [a + b for a, b in zip(terms[::2], terms[1::2])] + terms[len(terms) & ~1 :]
    return terms[0] if terms else F.lit(0.0)


def score_nodes(
    nodes: list[Node], df: DataFrame, features: list[str], categories: dict[str, list[str]], name: str
) -> DataFrame:
    """Positive-class probability of a compiled ensemble as a plain column; other columns unchanged."""
    columns = models.tree_columns(features, categories)
    rows = models.tree_inputs(df, features, categories)
    total = margin(nodes, [F.col(c) for c in columns])
    return rows.withColumn(name, 1.0 / (1.0 + F.exp(-2.0 * total))).drop(*columns)


# -- bundles -------------------------------------------------------------------------------------


def _facts(table: DataFrame) -> dict:
    return fingerprint(table).first().asDict()


def save_bundle(path: str, nodes: DataFrame, manifest: dict, trained_on: DataFrame) -> dict:
    """Node table with a manifest: the given settings, fingerprints of the nodes and of the training rows.

    `manifest` holds what scoring needs besides the trees (inputs, categories, scaler, number of trees).
    """
    nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    spark = nodes.sparkSession
    full = manifest | {"nodes": _facts(spark.read.parquet(f"{path}/nodes")), "trained_on": _facts(trained_on)}
    text = json.dumps(full, sort_keys=True)
    row = spark.createDataFrame([(text,)], "manifest string").select("manifest", F.sha2("manifest", 256).alias("sha256"))
    row.write.mode("overwrite").parquet(f"{path}/manifest")
    return json.loads(text)


def load_bundle(spark: SparkSession, path: str, trained_on: DataFrame | None = None) -> tuple[list[Node], dict]:
    """Nodes and manifest of a bundle; refused if its text, its nodes, its number of trees or, where
    given, the training rows differ from what was saved."""
    row = spark.read.parquet(f"{path}/manifest").select("manifest", (F.sha2("manifest", 256) == F.col("sha256")).alias("ok")).first()
    if not row["ok"]:
        raise ContractError("the manifest is not the one that was saved")
    manifest = json.loads(row["manifest"])
    table = spark.read.parquet(f"{path}/nodes")
    if _facts(table) != manifest["nodes"]:
        raise ContractError("the nodes are not the ones that were saved")
    if trained_on is not None and _facts(trained_on) != manifest["trained_on"]:
        raise ContractError("the training rows are not those of the model")
    nodes = [Node(**r.asDict()) for r in table.collect()]  # the model itself
    require_nodes(nodes, manifest["trees"])
    return nodes, manifest
