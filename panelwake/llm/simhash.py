"""Near-duplicate documents by SimHash: an inverted index of fingerprint bytes by position.

A fingerprint has eight bytes. Two of them that differ in at most four bits share at least four bytes at
their positions, since every differing bit spoils one byte at most: four is the guaranteed count. The
index files each distinct fingerprint under every set of four positional bytes it holds, so a pair
reaches the count exactly if a posting list holds both. In a list the shared bytes of each pair are
tallied, and pairs with the count are verified on all 64 bits.

Posting lists too long for that are not compared. What the tally of a pair may be decides where its
members go instead, and nothing is lost by it:

* exactly four shared bytes leave one differing bit in each other byte, so one half of each of those
  bytes agrees as well: sixteen lists by 48 equal bits;
* five or more are shared: lists by five bytes, handled in the same way (with exactly five, two of the
  other three bytes differ in one bit each: twelve lists by 48 equal bits);
* six or more are shared: lists by six bytes.

Lists by 48 equal bits cannot hold more than 65,536 fingerprints, however large the corpus is.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations, product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwake.llm.common import only, partitions, query, stored, table
from panelwake.llm.components import components
from panelwake.llm.interning import text_bytes
from panelwake.llm.near_dup import star

BYTES = 8
#: Most differing bits of a link, and the fewest bytes that such a pair shares.
DISTANCE = 4
SHARED = BYTES - DISTANCE
#: Fixed value: the hash's seed.
SEED = 42
#: Longer posting lists are parted by what the tally allows.
LIST = 512
#: Shingles counted at a time, and pairs kept before they become stars.
PIECE, PAIRS = 1 << 15, 1 << 20
BROADCAST_ROWS = 500_000
SALTS = 16


def fingerprint(text: bytes, k: int = 4) -> int:
    """Bit by bit, what more than half of the hashes of k words in a row have set; 0 without words."""
    words = text.lower().split()  # bytes: A-Z only, and ASCII white space only
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(words) - k + 1)
    starts, ends = starts[:n], ends[-n:]
    counts = np.zeros(64, np.int64)
    for i in range(0, n, PIECE):
        cut = zip(starts[i : i + PIECE].tolist(), ends[i : i + PIECE].tolist())
        hashes = np.array([xxhash.xxh64_intdigest(line[a:b], SEED) for a, b in cut], ">u8")
        counts += np.unpackbits(hashes.view(np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big", signed=True)


def _fingerprints(batches: Iterator[pa.RecordBatch], k: int):
    for batch in batches:
        raw, offsets = text_bytes(batch.column(1))
        cuts = offsets.tolist()
        prints = [fingerprint(raw[a:b], k) for a, b in zip(cuts[:-1], cuts[1:])]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(prints, pa.int64())], names=["doc_id", "print"]
        )


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = 4) -> DataFrame:
    """(doc_id, print): the fingerprint of every row's whole text as a signed number."""
    rows = only(docs, doc_id=doc_id, text=text).select(F.col("doc_id").cast("long"), "text")
    return rows.mapInArrow(lambda b: _fingerprints(b, k), "doc_id long, print long")


def _signed(bits: int) -> int:
    return bits - (1 << 64) if bits >> 63 else bits


def _bytes_mask(positions) -> int:
    return reduce(lambda m, p: m | 0xFF << 8 * p, positions, 0)


def byte_masks(n: int) -> list[int]:
    """Masks of all sets of n byte positions."""
    return [_bytes_mask(c) for c in combinations(range(BYTES), n)]


def half_masks(mask: int, halves: int) -> list[int]:
    """The mask with one half more of each of `halves` of the bytes outside it."""
    outside = [p for p in range(BYTES) if not mask >> 8 * p & 1]
    return [
        reduce(lambda m, ph: m | 0xF << 8 * ph[0] + 4 * ph[1], zip(chosen, sides), mask)
        for chosen in combinations(outside, halves)
        for sides in product((0, 1), repeat=halves)
    ]


def _key(mask: Column, print_: Column) -> Column:
    return F.xxhash64(mask, print_.bitwiseAND(mask))


def _postings(prints: DataFrame, masks: list[int]) -> DataFrame:
    """(print, mask, list) of every fingerprint under every mask."""
    entry = lambda m: F.struct(m.alias("mask"), _key(m, F.col("print")).alias("list"))
    entries = F.array(*[entry(F.lit(_signed(m)).cast("long")) for m in masks])
    # a small table, but each row becomes many
    prints = prints.repartition(partitions(prints.sparkSession), "print")
    return prints.select("print", F.inline(entries))


def _parted(postings: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Postings of short lists, and (stored) those of long ones if there are any."""
    long = stored(postings.groupBy("list").agg(F.count("*").alias("n")).where(F.col("n") > LIST).select("list"), "long")
    count = long.count()
    if count == 0:
        return postings, None
    small = F.broadcast(long) if count <= BROADCAST_ROWS else long
    return postings.join(small, "list", "left_anti"), stored(postings.join(small, "list", "left_semi"), "crowded")


def _branched(crowded: DataFrame, masks: list[int], halves: int) -> DataFrame:
    """Postings of long lists under what else agrees where no further byte is shared."""
    rows = [(_signed(m), _signed(h)) for m in masks for h in half_masks(m, halves)]
    choices = crowded.sparkSession.createDataFrame(rows, "mask long, longer long")  # 1,120 rows at most
    cut = crowded.join(F.broadcast(choices), "mask")
    return cut.select("print", _key(F.col("longer"), F.col("print")).alias("list"))


def _close(a: np.ndarray, b: np.ndarray, distance: int) -> np.ndarray:
    """Pairs that share enough positional bytes and differ in few bits."""
    x = a ^ b
    shared = (x.view(np.uint8).reshape(len(x), BYTES) == 0).sum(axis=1)
    near = np.flatnonzero(shared >= SHARED)
    return near[np.bitwise_count(x[near]) <= distance]


class _Stars:
    """Links among n members, kept as stars whenever there are many."""

    def __init__(self, n: int):
        self.n, self.a, self.b, self.held = n, [], [], 0

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        self.a.append(a)
        self.b.append(b)
        self.held += len(a)
        if self.held > PAIRS:
            self.links()

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.held:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        to = star(self.n, np.concatenate(self.a), np.concatenate(self.b))
        b = np.flatnonzero(to != np.arange(self.n))
        self.a, self.b, self.held = [to[b]], [b], 0
        return to[b], b


def _list_links(batches: Iterator[pa.RecordBatch], distance: int):
    """Compare the members of each list; links come out as stars."""
    for batch in batches:
        lists = batch.column(0)
        flat = lists.flatten().to_numpy().view(np.uint64)
        ends = np.cumsum(np.diff(lists.offsets.to_numpy()))
        sizes = np.diff(ends, prepend=0)
        stars = _Stars(len(flat))
        last = np.repeat(ends, sizes)  # end of each member's list
        at = np.flatnonzero(np.repeat(sizes <= LIST, sizes))
        step = 1
        while len(at := at[at + step < last[at]]):
            close = at[_close(flat[at], flat[at + step], distance)]
            stars.add(close, close + step)
            step += 1
        for i in np.flatnonzero(sizes > LIST).tolist():  # by 48 equal bits: 65,536 at most
            for first in range(int(ends[i] - sizes[i]), int(ends[i])):
                rest = np.arange(first + 1, ends[i])
                close = rest[_close(np.broadcast_to(flat[first], rest.shape), flat[rest], distance)]
                stars.add(np.full(len(close), first), close)
        a, b = stars.links()
        signed = flat.view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(signed[a]), pa.array(signed[b])], names=["a", "b"])


def _compared(postings: DataFrame, distance: int) -> DataFrame:
    """Links (a, b) within posting lists of bounded length."""
    lists = postings.groupBy("list").agg(F.collect_set("print").alias("prints")).where(F.size("prints") > 1)
    return lists.select("prints").mapInArrow(lambda b: _list_links(b, distance), "a long, b long")


def links(prints: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(a, b) that connect all distinct fingerprints at `distance` or fewer differing bits."""
    four, five = byte_masks(SHARED), byte_masks(SHARED + 1)
    short, crowded = _parted(_postings(prints, four))
    found = [_compared(short, distance)]
    if crowded is not None:
        found.append(_compared(_branched(crowded, four, 4), distance))
        short, crowded = _parted(_postings(stored(crowded.select("print").distinct(), "five"), five))
        found.append(_compared(short, distance))
        if crowded is not None:
            found.append(_compared(_branched(crowded, five, 2), distance))
            six = _postings(crowded.select("print").distinct(), byte_masks(SHARED + 2))
            found.append(_compared(six, distance))
    return reduce(DataFrame.unionByName, found)


def _spread_join(rows: DataFrame, per_key: DataFrame, key: str, by: str) -> DataFrame:
    """Left join of rows to one row per key; rows of one key spread over several tasks."""
    salted = rows.withColumn("salt", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int"))
    copies = per_key.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(copies, [key, "salt"], "left").drop("salt")


def simhash_components(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = 4, distance: int = DISTANCE
) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row.

    Fingerprints come from all k-word shingles of the whole text, lower case, repeats included; shorter
    texts are one shingle. Rows are linked if their fingerprints differ in `distance` (0 to 4) bits or
    fewer; a component's id is the smallest doc_id in it. Null, empty and blank texts have fingerprint
    zero, which is linked like any other. Rows without doc_id take part; a component of such rows alone
    has a null id. Repeated ids and rows keep their own fingerprints and components, and further columns
    of the input are not looked at. An empty table gives no rows.
    """
    if not 0 <= distance <= DISTANCE:
        raise ValueError(f"distance is 0 to {DISTANCE}")
    rows = stored(fingerprints(docs, doc_id, text, k), "prints")
    groups = rows.groupBy("print").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies"))
    groups = stored(groups, "groups")
    joined = components(links(groups.select("print"), distance))
    labels = groups.join(joined.toDF("print", "component"), "print", "left")
    labels = stored(labels.withColumn("component", F.coalesce("component", "print")), "labels")
    heads = labels.groupBy("component").agg(
        F.min("first").alias("component_id"), F.sum("copies").alias("rows")
    )
    heads = heads.where("rows > 1").select("component", "component_id")
    named = _spread_join(labels, heads, "component", "print")
    named = named.where("component_id is not null").select("print", "component_id")
    out = _spread_join(rows, named, "print", "doc_id")
    return out.select(
        "doc_id",
        F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"),
        F.coalesce("component_id", "doc_id").alias("component_id"),
    )


@query("op13_simhash")
def op13_simhash(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprints of all documents, and components of those at four or fewer differing bits."""
    return simhash_components(table(spark, folder, "documents"))
