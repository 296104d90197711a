"""Connected components of an edge table, as distributed union-find by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwake.llm.common import stored


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node with an edge; the component is its smallest node.

    Each round points every node at its smallest neighbour if that is smaller than itself, moves the
    edges to where their ends point, and drops those inside one node. Rounds shrink as the logarithm of
    the longest chain; a star takes one. Rounds end on tables in the shared folder. Edges with a null
    end, loops and repeated edges change nothing; no edges give no rows.
    """
    edges = edges.toDF("a", "b").where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    edges = stored(edges.distinct(), "edges")
    labels = None
    while not edges.isEmpty():
        # b > a in every edge: only b has a smaller neighbour by it
        to = stored(edges.groupBy("b").agg(F.min("a").alias("to")), "to")
        ends = edges.select(F.col("a").alias("b")).unionByName(edges.select("b")).distinct()
        if labels is None:
            labels = ends.join(to, "b", "left").select(
                F.col("b").alias("node"), F.coalesce("to", "b").alias("component")
            )
        else:
            moved = to.select(F.col("b").alias("component"), "to")
            labels = labels.join(moved, "component", "left").select(
                "node", F.coalesce("to", "component").alias("component")
            )
        labels = stored(labels, "labels")
        # a may point further down as well; an end without a smaller neighbour stays
        left = to.select(F.col("b").alias("a"), F.col("to").alias("a_to"))
        edges = (
            edges.join(to, "b")
            .join(left, "a", "left")
            .select(F.coalesce("a_to", "a").alias("a"), F.col("to").alias("b"))
            .where("a <> b")
            .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
            .distinct()
        )
        edges = stored(edges, "edges")
    if labels is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return labels
