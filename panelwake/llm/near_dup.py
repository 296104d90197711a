"""Near-duplicate documents by a chosen-path similarity join over word shingles.

Documents with equal shingle sets become one. Each independent tree picks one of the minwise values of a
set; sets that agree in it share a node. A node with many sets branches again: it picks further
coordinates, the same for all its sets, and hands each set to the child of its values. Small nodes are
compared exhaustively, on sketches; what may be linked there is put together into clusters, in which
full sets are compared. So a link is lost only if no tree keeps its pair together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwake.llm.common import in_batches, on_groups, only, partitions, query, stored, table
from panelwake.llm.components import components
from panelwake.llm.interning import (
    hash_words,
    lowered,
    mixed,
    shingle_hashes,
    split_at,
    text_bytes,
    text_of,
)

COORDINATES = 128
TREES = 12
BRANCHES = 2
NODE = 128  # nodes up to this size are compared exhaustively
DENSE = 0.7  # a large node that keeps this share of its parent has no unlike sets to part
CLUSTER = 256  # clusters up to this size are compared in one go, larger ones in pairs of halves of it
BROADCAST_ROWS = 1_000_000
SALTS = 16

_random = np.random.default_rng(85)
_XOR = _random.integers(0, 2**63, COORDINATES, dtype=np.uint64)
_TIMES = _random.integers(0, 2**63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_INSIDE = np.array([not (b == 0x20 or 9 <= b <= 13) for b in range(256)])


def text_shingles(column: pa.Array, k: int) -> list[np.ndarray]:
    """Distinct shingle hashes of each text: k words, lower case, parted by ASCII white space."""
    raw, offsets = text_bytes(column)
    data = lowered(np.frombuffer(raw, np.uint8))
    starts, sizes = split_at(data, offsets, _INSIDE)
    words = hash_words(data, starts, sizes)[0]
    first = np.searchsorted(text_of(offsets, starts), np.arange(len(offsets)))
    return shingle_hashes(words, first, k)


def minwise(shingles: np.ndarray) -> np.ndarray:
    out = np.full(COORDINATES, 0xFFFFFFFF, np.uint64)
    for i in range(0, len(shingles), 4096):
        h = ((shingles[i : i + 4096, None] ^ _XOR) * _TIMES) >> np.uint64(32)
        np.minimum(out, h.min(axis=0), out=out)
    return out.astype(np.uint32).view(np.int32)


def set_name(shingles: np.ndarray) -> int:
    """One number for a whole set."""
    h = mixed(np.append(shingles, np.uint64(len(shingles)))).sum(dtype=np.uint64)
    return int(mixed(np.array([h]))[0].view(np.int64))


def _sketch_batches(batches: Iterator[pa.RecordBatch], k: int):
    for batch in batches:
        sets = text_shingles(batch.column(1), k)
        sizes = [len(s) for s in sets]
        names = [set_name(s) if len(s) else None for s in sets]
        flat = np.concatenate([minwise(s) if len(s) else np.zeros(COORDINATES, np.int32) for s in sets])
        offsets = np.arange(len(sets) + 1, dtype=np.int32) * COORDINATES
        sketches = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(sizes, pa.int64()), pa.array(names, pa.int64()), sketches, batch.column(2)],
            names=["doc_id", "n_shingles", "name", "sketch", "h"],
        )


def _grouped(rows: DataFrame) -> DataFrame:
    """(node, name, n) of nodes with at least two sets; sizes are counted map side first."""
    sizes = rows.groupBy("node").agg(F.count("*").alias("n")).where("n > 1")
    return rows.join(sizes, "node")


def _leaves(sets: DataFrame, roots: DataFrame, seed: int) -> tuple[DataFrame, DataFrame]:
    """Small nodes of all trees as (node, name), and nodes that cannot be parted further."""
    level = stored(_grouped(roots), "level")
    small, dense = [], []
    depth = 0
    while True:
        small.append(level.where(F.col("n") <= NODE).select("node", "name"))
        if "parent_n" in level.columns:
            stuck = (F.col("n") > NODE) & (F.col("n") >= DENSE * F.col("parent_n"))
            dense.append(level.where(stuck).select("node", "name"))
            over = level.where((F.col("n") > NODE) & ~stuck)
        else:
            over = level.where(F.col("n") > NODE)
        if over.isEmpty():
            break
        depth += 1
        chosen = F.explode(F.sequence(F.lit(0), F.lit(BRANCHES - 1))).alias("branch")
        here = over.join(sets, "name").select("node", "name", "n", "sketch", chosen)
        coordinate = F.pmod(F.xxhash64(F.lit(seed + depth), "node", "branch"), F.lit(COORDINATES))
        value = F.element_at("sketch", coordinate.cast("int") + 1)
        rows = here.select(
            F.xxhash64("node", "branch", value).alias("node"), "name", F.col("n").alias("parent_n")
        )
        level = stored(_grouped(rows), "level")
    union = lambda parts: parts[0] if len(parts) == 1 else parts[0].unionByName(union(parts[1:]))
    return union(small), union(dense) if dense else level.limit(0).select("node", "name")


def star(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest member of each one's component, for the links a-b among n."""
    to = np.arange(n)
    while True:
        low = np.minimum(to[a], to[b])
        before = to.copy()
        np.minimum.at(to, a, low)
        np.minimum.at(to, b, low)
        to = to[to]
        if (to == before).all():
            return to


def _node_edges(batches: Iterator[pa.RecordBatch], least: float):
    """Within each small node, link what the sketches allow, as stars."""
    for batch in batches:
        a, b = [], []
        for row in batch.column(0).to_pylist():
            row.sort(key=lambda m: m["rep"])
            reps = np.array([m["rep"] for m in row], np.int64)
            bits = np.frombuffer(b"".join(m["bits"] for m in row), np.uint8).reshape(len(row), -1)
            alike = (bits[:, None, :] == bits[None, :, :]).mean(axis=2) >= least
            to = star(len(row), *np.nonzero(np.triu(alike, 1)))
            moved = to != np.arange(len(row))
            a.append(reps[to[moved]])
            b.append(reps[moved])
        flat = lambda x: pa.array(np.concatenate(x) if x else [], pa.int64())
        yield pa.RecordBatch.from_arrays([flat(a), flat(b)], names=["a", "b"])


def _low_bytes(batches: Iterator[pa.RecordBatch]):
    for batch in batches:
        flat = batch.column("sketch").flatten().to_numpy().view(np.uint32)
        bits = (flat & 0xFF).astype(np.uint8).reshape(-1, COORDINATES)
        column = pa.array([r.tobytes() for r in bits], pa.binary())
        yield pa.RecordBatch.from_arrays(
            [batch.column("name"), batch.column("name"), column], names=["name", "rep", "bits"]
        )


def _set_batches(batches: Iterator[pa.RecordBatch], k: int):
    """Full sets of the wanted documents, as bytes."""
    for batch in batches:
        sets = text_shingles(batch.column(0), k)
        names = batch.column("name").to_pylist()
        right = [i for i, s in enumerate(sets) if len(s) and set_name(s) == names[i]]
        rest = batch.select(["rep", "cluster", "n"]).take(pa.array(right, pa.int64()))
        column = pa.array([sets[i].tobytes() for i in right], pa.binary())
        yield pa.RecordBatch.from_arrays([*rest.columns, column], names=["rep", "cluster", "n", "shingles"])


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections."""
    sizes = np.array([len(s) for s in sets])
    _, at, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    own = np.repeat(np.arange(len(sets)), sizes)
    shared = count[at] > 1
    own, at = own[shared], np.unique(at[shared], return_inverse=True)[1]
    out = np.zeros((len(sets), len(sets)), np.float32)
    order = np.argsort(at, kind="stable")
    own, at = own[order], at[order]
    width = 4096
    cuts = np.searchsorted(at, np.arange(0, (int(at[-1]) if len(at) else -1) + width + 1, width))
    for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])):
        m = np.zeros((len(sets), width), np.float32)
        m[own[a:b], at[a:b] - i * width] = 1
        out += m @ m.T
    out[np.arange(len(sets)), np.arange(len(sets))] = sizes
    return out.astype(np.int64)


def _exact_links(group: pa.Table, percent: int) -> pa.Table:
    """Stars of true links inside each cluster (or pair of parts of a cluster) of a group."""
    a, b = [], []
    clusters = group["cluster"].to_numpy()
    reps, shingles = group["rep"].to_numpy(), group["shingles"].to_pylist()
    order = np.lexsort((reps, clusters))
    cuts = np.flatnonzero(np.diff(clusters[order], prepend=clusters[order][:1] - 1, append=clusters[order][-1:] + 1))
    for s, e in zip(cuts[:-1], cuts[1:]):
        at = order[s:e]
        at = at[np.unique(reps[at], return_index=True)[1]]
        if len(at) < 2:
            continue
        sets = [np.frombuffer(shingles[i], np.uint64) for i in at]
        sizes = np.array([len(x) for x in sets])
        both = intersections(sets)
        linked = 100 * both >= percent * (sizes[:, None] + sizes[None, :] - both)
        to = star(len(at), *np.nonzero(np.triu(linked, 1)))
        moved = to != np.arange(len(at))
        a.append(reps[at[to[moved]]])
        b.append(reps[at[moved]])
    flat = lambda x: pa.array(np.concatenate(x) if x else [], pa.int64())
    return pa.Table.from_arrays([flat(a), flat(b)], names=["a", "b"])


def near_duplicates(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    k: int = 5,
    percent: int = 80,
    seed: int = 0,
) -> DataFrame:
    """(doc_id, h, n_shingles, component_id, kept) for every row; h is xxhash64 of the text.

    Documents are linked if their intersection holds at least `percent` of their union; a component's id
    is its smallest doc_id, and that document is kept. Every link is confirmed on full sets. A pair at the
    threshold stays together in one tree with a probability of about 0.8, so twelve trees miss one in
    some hundred million; more alike pairs are safer still.

    Texts with fewer than k words are one shingle; null, empty and blank texts have none and are linked
    with nothing. Rows without doc_id are not compared: their component is null and they are kept.
    Sets are linked, not ids: rows that repeat an id with unlike texts have a component each, told apart by
    h, and rows that repeat in full have one. Other input columns are not read. Empty tables give no rows. Texts of any length are taken
    whole. No group is collected: nodes branch until they are small, and clusters larger than one
    comparison are compared in pairs of parts.
    """
    spark = docs.sparkSession
    rows = only(docs, doc_id=doc_id, text=text)
    rows = rows.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("h"))
    schema = "doc_id long, n_shingles long, name long, sketch array<int>, h long"
    sk = stored(in_batches(rows, lambda b: _sketch_batches(b, k), schema), "sketches")
    usable = sk.where("name is not null and doc_id is not null")
    groups = stored(
        usable.groupBy("name").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")), "groups"
    )
    draws = [int(c) for c in np.random.default_rng(seed).choice(COORDINATES, TREES, replace=False)]
    values = F.array(*[F.xxhash64(F.lit(c), F.col("sketch")[c]) for c in draws])
    roots = usable.select("name", F.explode(values).alias("node")).groupBy("node", "name").agg(F.lit(1)).select("node", "name")
    first = stored(_grouped(roots), "roots")
    near = first.select("name").distinct()
    sets = usable.join(near, "name", "left_semi").dropDuplicates(["name"]).join(groups, "name")
    sets = stored(sets.select("name", "rep", "sketch"), "sets")
    leaves, dense = _leaves(sets.select("name", "sketch"), first.select("node", "name"), seed)

    # equal member lists, as those of most small groups, are compared once
    lists = leaves.groupBy("node").agg(F.sort_array(F.collect_list("name")).alias("names"))
    lists = lists.groupBy("names").agg(F.min("node").alias("node"))
    bits = in_batches(sets, _low_bytes, "name long, rep long, bits binary")
    members = (
        lists.select("node", F.explode("names").alias("name"))
        .join(bits, "name")
        .groupBy("node")
        .agg(F.collect_list(F.struct("rep", "bits")).alias("members"))
        .select("members")
    )
    share = percent / 100
    least = share - 5 * (share * (1 - share) / COORDINATES) ** 0.5
    maybe = in_batches(members, lambda b: _node_edges(b, least), "a long, b long")
    heads = dense.groupBy("node").agg(F.min("name").alias("a"))
    maybe = maybe.unionByName(dense.join(heads, "node").select("a", F.col("name").alias("b")))

    clusters = components(maybe)
    sizes = clusters.groupBy("component").agg(F.count("*").alias("n"))
    wanted = (
        clusters.join(sizes, "component")
        .select(F.col("node").alias("name"), F.col("component").alias("cluster"), "n")
        .join(sets.select("name", F.col("rep").alias("id")), "name")
    )
    wanted = stored(wanted, "wanted")
    count = wanted.count()
    small = F.broadcast(wanted) if count <= BROADCAST_ROWS else wanted
    texts = rows.join(small, rows["doc_id"] == wanted["id"])
    texts = texts.select("text", F.col("name").alias("rep"), "name", "cluster", "n")
    full = in_batches(texts, lambda b: _set_batches(b, k), "rep long, cluster long, n long, shingles binary")
    parts = F.ceil(F.col("n") / (CLUSTER // 2)).cast("int")
    part = F.pmod(F.xxhash64("rep"), parts).cast("int")
    group = F.pmod(F.xxhash64("cluster"), F.lit(max(partitions(spark), count // 1000 + 1)))
    alone = full.where(F.col("n") <= CLUSTER).select(
        group.alias("g"), F.lit(-1).alias("i"), F.lit(-1).alias("j"), "cluster", "rep", "shingles"
    )
    paired = (
        full.where(F.col("n") > CLUSTER)
        .select("*", part.alias("p"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("q"))
        .select(
            F.col("cluster").alias("g"),
            F.least("p", "q").alias("i"),
            F.greatest("p", "q").alias("j"),
            "cluster",
            "rep",
            "shingles",
        )
    )
    nodes = alone.unionByName(paired).groupBy("g", "i", "j")
    links = on_groups(nodes, lambda t: _exact_links(t, percent), "a long, b long")
    found = components(links).withColumnRenamed("node", "name")
    heads = found.join(groups, "name").groupBy("component").agg(F.min("rep").alias("component_id"))
    joined = found.join(heads, "component").select("name", "component_id")

    # only sets with copies or links change anything
    changed = (
        groups.join(joined, "name", "left")
        .where("copies > 1 or component_id is not null")
        .select("name", F.coalesce("component_id", "rep").alias("component_id"))
    )
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")
    spread = changed.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    out = sk.select("doc_id", "h", "n_shingles", "name", salt.alias("salt")).join(spread, ["name", "salt"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select(
        "doc_id",
        "h",
        "n_shingles",
        component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"),
    )


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(ws) < 5 THEN array_to_string(ws, ' ')
    ELSE array_to_string(ws[i : i + 4], ' ') END AS sh
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM w WHERE len(ws) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), e AS (
  SELECT a.doc_id AS a, b.doc_id AS b
  FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id
    JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, x.n, y.n
  HAVING 100 * count(*) >= 85 * (x.n + y.n - count(*))
), r AS (
  SELECT doc_id AS a, doc_id AS c FROM documents
  UNION
  SELECT e.b, r.c FROM r JOIN e ON e.a = r.a
)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, min(r.c) AS component_id,
  d.doc_id = min(r.c) AS kept
FROM documents d JOIN r ON r.a = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
GROUP BY d.doc_id, n.n
"""


@query("op5_near_duplicates", SQL)
def op5_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    """Components of documents whose five-word shingle sets agree to 85 percent."""
    return near_duplicates(table(spark, folder, "documents"), percent=85).drop("h")
