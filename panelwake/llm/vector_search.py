"""Exact top-k by inner product with a pivot-distance index.

Every vector gets one more coordinate that brings all lengths to the longest one; then a larger inner
product is a smaller distance and the triangle inequality applies. A vector is keyed by its nearest
pivot and its distance to it. Equal steps of that distance are annuli. A query takes annuli in the order
of the least distance they can hold, until they hold k vectors; what it finds there bounds the rest, and
only annuli that can still hold something as near are looked at in a second wave.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelwake.llm.common import only, query, stored, table

#: Vectors and queries that meet in one group at most, about.
BLOCK = 2048
QUERY_BLOCK = 4096
SLACK = 1e-6  # relative; distances are floating point, scores are exact integers
#: Largest square length of a vector times 1024. No inner product of two such vectors, nor a part of its
#: sum, passes the square length of the longer one, so all scores are exact in 64 bits.
LONGEST = 2.0**61


@dataclass
class Plan:
    """Pivots, longest square length, and annuli, each by dimension; bounded by parameters."""

    pivots: dict[int, np.ndarray]
    longest: dict[int, int]
    step: dict[int, float]
    cells: dict[int, np.ndarray] | None = None  # rows: cell number, pivot, least and most distance, size, blocks


def _square(vector: Column) -> Column:
    return F.aggregate(vector, F.lit(0.0), lambda s, x: s + F.pow(x.cast("double") * 1024, F.lit(2.0)))


def _finite(vector: Column) -> Column:
    return F.forall(
        vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf"))
    )


def scaled(vector: Column) -> Column:
    """floor(1024 x) per component, as long; null for vectors that take no part."""
    short = F.when(_finite(vector), _square(vector) <= LONGEST)
    return F.when(short, F.transform(vector, lambda x: F.floor(x.cast("double") * 1024)))


def out_of_range(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id) of the finite vectors longer than about 1.48 million: their scores may not fit 64 bits."""
    rows = only(vectors, vec_id=vec_id, v=vector)
    return rows.where(F.when(_finite(F.col("v")), _square(F.col("v")) > LONGEST)).select("vec_id")


def _matrix(column, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _distances(v: np.ndarray, plan: Plan, dim: int, query: bool = False) -> np.ndarray:
    """From each vector to each pivot. The further coordinate brings vectors and pivots to the longest
    length and is 0 for queries, so that only the inner product tells a query's distances apart."""
    pivots = plan.pivots[dim].astype(float)
    top = float(plan.longest[dim])
    v = v.astype(float)
    rest = top - (pivots * pivots).sum(axis=1)
    own = (v * v).sum(axis=1)
    lift = np.zeros(len(v)) if query else np.sqrt(np.maximum(top - own, 0))
    square = own[:, None] + top - 2 * (v @ pivots.T) + (lift * lift)[:, None]
    square -= 2 * lift[:, None] * np.sqrt(np.maximum(rest, 0))[None, :]
    return np.sqrt(np.maximum(square, 0))


def _key_batches(batches: Iterator[pa.RecordBatch], sent):
    plan = sent.value
    for batch in batches:
        dims = batch.column("dim").to_numpy()
        pivot, ring = np.zeros(len(dims), np.int32), np.zeros(len(dims), np.int32)
        dist = np.zeros(len(dims))
        for dim in np.unique(dims).tolist():
            at = np.flatnonzero(dims == dim)
            d = _distances(_matrix(batch.column("v").take(pa.array(at)), dim), plan, dim)
            pivot[at] = d.argmin(axis=1)
            dist[at] = d.min(axis=1)
            ring[at] = np.floor(dist[at] / plan.step[dim])
        keys = [pa.array(pivot), pa.array(ring), pa.array(dist)]
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, *keys], names=[*batch.schema.names, "pivot", "ring", "dist"]
        )


def build(
    vectors: DataFrame,
    pivots: int = 32,
    sample: int = 4096,
    rings: int = 16,
    vec_id: str = "vec_id",
    vector: str = "embedding",
) -> tuple[DataFrame, Plan]:
    """The index: every vector with its cell and block, stored, and the plan of its cells.

    Pivots are picked one after another from a hashed sample of `sample` vectors, each as far as it can
    be from those before it; the sample only places pivots, all vectors are indexed. Vectors of
    different lengths do not meet. Crowded cells are cut into blocks by a hash of the id, so equal
    vectors spread as well. Vectors that are null, empty or hold null or non-finite components, and
    rows without id, take no part; nor do vectors too long for scores of 64 bits, which `out_of_range`
    lists.
    """
    spark = vectors.sparkSession
    rows = only(vectors, vec_id=vec_id, v=vector).select(
        F.col("vec_id").cast("long").alias("vec_id"), scaled(F.col("v")).alias("v")
    )
    rows = rows.where("vec_id is not null and size(v) > 0").withColumn("dim", F.size("v"))
    square = F.aggregate("v", F.lit(0).cast("long"), lambda s, x: s + x * x)  # within 2**62
    longest = {r["dim"]: r["top"] for r in rows.groupBy("dim").agg(F.max(square).alias("top")).collect()}
    drawn: dict[int, list] = {}
    for r in rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).collect():
        drawn.setdefault(r["dim"], []).append(r["v"])
    plan = Plan({}, longest, {})
    for dim, top in longest.items():
        seen = np.array(drawn.get(dim, [[0] * dim]), np.int64).reshape(-1, dim)
        plan.pivots[dim] = seen[:1]
        plan.step[dim] = max(2 * top**0.5 / rings, 1.0)
        near = _distances(seen, plan, dim)[:, 0]
        while len(plan.pivots[dim]) < min(pivots, len(seen)) and near.max() > 0:
            far = seen[near.argmax()][None, :]
            one = Plan({dim: far}, longest, {})
            near = np.minimum(near, _distances(seen, one, dim)[:, 0])
            plan.pivots[dim] = np.concatenate([plan.pivots[dim], far])
    sent = spark.sparkContext.broadcast(plan)
    schema = "vec_id long, v array<long>, dim int, pivot int, ring int, dist double"
    keyed = stored(rows.mapInArrow(lambda b: _key_batches(b, sent), schema), "vectors")
    cells = (
        keyed.groupBy("dim", "pivot", "ring")
        .agg(F.count("*").alias("n"), F.min("dist").alias("least"), F.max("dist").alias("most"))
        .orderBy("dim", "pivot", "ring")
        .collect()  # at most pivots x rings of them per dimension
    )
    plan.cells = {}
    for i, c in enumerate(cells):
        row = (i, c["pivot"], c["least"], c["most"], c["n"], -(-c["n"] // BLOCK))
        plan.cells.setdefault(c["dim"], []).append(row)
    plan.cells = {d: np.array(x, float) for d, x in plan.cells.items()}
    numbered = spark.createDataFrame(
        [(c["dim"], c["pivot"], c["ring"], i, -(-c["n"] // BLOCK)) for i, c in enumerate(cells)],
        "dim int, pivot int, ring int, cell int, blocks long",
    )
    block = F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int")
    index = keyed.join(F.broadcast(numbered), ["dim", "pivot", "ring"])
    return index.select("cell", block.alias("block"), "blocks", "dim", "vec_id", "v"), plan


def _visit_batches(batches: Iterator[pa.RecordBatch], sent, k: int, wave: int):
    plan = sent.value
    for batch in batches:
        names = ["query_id", "cell", "blocks"]
        dims, picked, cells, blocks = batch.column("dim").to_numpy(), [], [], []
        known = batch.column("floor").to_numpy(zero_copy_only=False)
        for dim in np.unique(dims).tolist():
            at = np.flatnonzero(dims == dim)
            there = plan.cells[dim]
            v = _matrix(batch.column("v").take(pa.array(at)), dim)
            to = _distances(v, plan, dim, query=True)[:, there[:, 1].astype(int)]
            least = np.maximum(np.maximum(to - there[:, 3], there[:, 2] - to), 0)
            own = (v.astype(float) ** 2).sum(axis=1)
            for i, row in enumerate(at.tolist()):
                order = np.argsort(least[i], kind="stable")
                # the query itself may be one of the vectors, so one more is needed
                first = np.searchsorted(np.cumsum(there[order, 4]), k + 1) + 1
                if wave == 1:
                    take = order[:first]
                else:
                    take = order[first:]
                    if not np.isnan(known[row]):
                        square = own[i] + plan.longest[dim] - 2 * known[row]
                        reach = max(square, 0.0) ** 0.5
                        slack = SLACK * (1 + reach + plan.longest[dim] ** 0.5)
                        take = take[least[i][take] <= reach + slack]
                picked += [row] * len(take)
                cells.append(there[take, 0].astype(np.int32))
                blocks.append(there[take, 5].astype(np.int64))
        asking = batch.column("query_id").take(pa.array(picked, pa.int64()))
        flat = lambda x, t: pa.array(np.concatenate(x) if x else [], t)
        yield pa.RecordBatch.from_arrays(
            [asking, flat(cells, pa.int32()), flat(blocks, pa.int64())], names=names
        )


def _best(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores; ids are ascending, so a stable order breaks ties."""
    if len(score) > k:
        floor = np.partition(score, len(score) - k)[len(score) - k]
        at = np.flatnonzero(score >= floor)
    else:
        at = np.arange(len(score))
    return at[np.argsort(-score[at], kind="stable")[:k]]


def _meet(vectors: pa.Table, queries: pa.Table, k: int) -> pa.Table:
    out: list[list] = [[], [], []]
    if len(vectors) and len(queries):
        dim = vectors["dim"][0].as_py()
        ids = vectors["vec_id"].to_numpy()
        order = np.argsort(ids, kind="stable")
        ids, v = ids[order], _matrix(vectors["v"], dim)[order]
        q, names = _matrix(queries["v"], dim), queries["query_id"].to_numpy()
        small = dim * float(np.abs(v).max(initial=0)) * float(np.abs(q).max(initial=0)) < 2**53
        v = v.T.astype(float) if small else v.T
        floors = queries["floor"].to_numpy()
        for a in range(0, len(q), 256):
            part = q[a : a + 256]
            scores = (part.astype(float) @ v).astype(np.int64) if small else part @ v
            for i, (name, floor) in enumerate(zip(names[a : a + 256].tolist(), floors[a : a + 256].tolist())):
                rows = np.flatnonzero(ids != name)
                if floor is not None and floor == floor:
                    rows = rows[scores[i][rows] >= floor]
                best = rows[_best(scores[i][rows], ids[rows], k)]
                out[0].append(np.full(len(best), name))
                out[1].append(ids[best])
                out[2].append(scores[i][best])
    flat = [pa.array(np.concatenate(x) if x else [], pa.int64()) for x in out]
    return pa.Table.from_arrays(flat, names=["query_id", "vec_id", "score"])


def search(
    index: DataFrame, plan: Plan, queries: DataFrame, k: int = 10
) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k highest inner products, ties to the smaller id.

    `queries` has (query_id, v, dim) with scaled components; `query_id` names the vector a query must not
    find. Ids that repeat: one of the vectors, the first in order, is the query, and no vector with its id
    is found. Fewer than k candidates: all of them. No cell is left out unless the triangle inequality
    shows that it holds nothing among the k best.
    """
    spark = index.sparkSession
    queries = queries.groupBy("query_id").agg(F.min("v").alias("v")).withColumn("dim", F.size("v"))
    queries = stored(queries, "queries")
    parts = max(1, -(-queries.count() // QUERY_BLOCK))
    sent = spark.sparkContext.broadcast(plan)
    share = F.pmod(F.xxhash64("query_id"), F.lit(parts)).cast("int")
    keys = ["cell", "block", "part"]

    def found(asked: DataFrame, wave: int) -> DataFrame:
        visits = asked.select("query_id", "v", "dim", "floor").mapInArrow(
            lambda b: _visit_batches(b, sent, k, wave), "query_id long, cell int, blocks long"
        )
        visits = stored(visits, "visits").select(
            "query_id",
            "cell",
            F.explode(F.sequence(F.lit(0), (F.col("blocks") - 1).cast("int"))).alias("block"),
            share.alias("part"),
        )
        # a vector travels once per part of the queries that visits its cell, to no other
        vectors = index.select("cell", "block", "vec_id", "v", "dim").join(
            visits.select(*keys).distinct().toDF(*keys), ["cell", "block"]
        )
        spread = visits.join(asked.select("query_id", "v", "floor"), "query_id")
        return (
            vectors.groupBy(*keys)
            .cogroup(spread.groupBy(*keys))
            .applyInArrow(lambda a, b: _meet(a, b, k), "query_id long, vec_id long, score long")
        )

    def ranked(rows: DataFrame) -> DataFrame:
        order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    first = stored(ranked(found(queries.withColumn("floor", F.lit(None).cast("double")), 1)), "near")
    floors = first.where(F.col("rank") == k).select("query_id", F.col("score").cast("double").alias("floor"))
    second = found(queries.join(floors, "query_id", "left"), 2)
    both = first.select("query_id", "vec_id", "score").unionByName(second)
    return ranked(both).select("query_id", "rank", "vec_id", "score")


SQL = """
WITH v AS (
  SELECT vec_id, [CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT) for x in embedding] AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0
), p AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
    CAST(list_sum([q.v[i] * c.v[i] for i in range(1, len(q.v) + 1)]) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id AND len(q.v) = len(c.v)
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM p
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""


@query("op6_vector_search", SQL)
def op6_vector_search(spark: SparkSession, folder: str) -> DataFrame:
    """The ten best partners of every hundredth vector among all vectors."""
    index, plan = build(table(spark, folder, "embeddings"))
    asked = index.where(F.col("vec_id") % 100 == 0).select(F.col("vec_id").alias("query_id"), "v", "dim")
    return search(index, plan, asked, 10)
