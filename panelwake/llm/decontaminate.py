"""Benchmark decontamination by a positional inverted index of the corpus.

The index holds a posting (term, document, positions) for every term of the test set that a document
holds. Each window of a test item asks for its rarest terms: their lists, moved back by the term's place
in the item, meet where the item may lie in a document. There the lists of all terms of the item decide.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelwake.llm.common import in_batches, only, query, sha, stored, table
from panelwake.llm.interning import hash_words, lowered, split_at, text_bytes, text_of

WINDOW = 13
BROADCAST_TERMS = 2_000_000  # distinct test terms, 8 bytes each
BROADCAST_ROWS = 500_000
ANCHORS = 2

# [^\x00-\x2F\x3A-\x60\x7B-\x7F] after lower-casing: digits, a-z, and all beyond ASCII
_INSIDE = np.array([48 <= b <= 57 or 97 <= b <= 122 or b >= 128 for b in range(256)])


def text_terms(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Terms of all texts as 64-bit hashes, the text of each, and its position in it."""
    raw, offsets = text_bytes(column)
    data = lowered(np.frombuffer(raw, np.uint8))
    starts, sizes = split_at(data, offsets, _INSIDE)
    first, second = hash_words(data, starts, sizes)
    text = text_of(offsets, starts)
    begin = np.searchsorted(text, np.arange(len(offsets)))
    at = np.arange(len(starts)) - begin[text]
    return (first ^ (second << np.uint64(1))).view(np.int64), text, at.astype(np.int32)


def _item_batches(batches: Iterator[pa.RecordBatch]):
    for batch in batches:
        term, text, at = text_terms(batch.column("text"))
        item = batch.column("item").take(pa.array(text))
        size = np.bincount(text, minlength=batch.num_rows)[text]
        yield pa.RecordBatch.from_arrays(
            [item, pa.array(term), pa.array(at), pa.array(size.astype(np.int32))], names=["item", "term", "at", "size"]
        )


def _posting_batches(batches: Iterator[pa.RecordBatch], sent):
    """Per document: its length under no term, and the positions of every test term."""
    terms = sent.value
    for batch in batches:
        term, text, at = text_terms(batch.column("text"))
        lengths = np.bincount(text, minlength=batch.num_rows)
        if len(terms):
            place = np.minimum(np.searchsorted(terms, term), len(terms) - 1)
            known = terms[place] == term
        else:
            place, known = np.zeros(len(term), np.int64), np.zeros(len(term), bool)
        text, at, place = text[known], at[known], place[known]
        order = np.argsort(text * np.int64(max(1, len(terms))) + place, kind="stable")
        text, at, place = text[order], at[order], place[order]
        opens = np.flatnonzero((np.diff(text, prepend=-1) != 0) | (np.diff(place, prepend=-1) != 0))
        offsets = np.append(opens, len(at))
        n = batch.num_rows
        doc = np.concatenate([np.arange(n), text[opens]])
        named = pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array(terms[place[opens]])])
        flat = np.concatenate([lengths.astype(np.int32), at])
        lists = pa.ListArray.from_arrays(
            pa.array(np.concatenate([np.arange(n), n + offsets]).astype(np.int32)), pa.array(flat)
        )
        take = pa.array(doc)
        yield pa.RecordBatch.from_arrays(
            [named, batch.column("doc_id").take(take), batch.column("h").take(take), lists],
            names=["term", "doc_id", "h", "positions"],
        )


def build_index(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The stored index: (term, doc_id, h, positions), and one row without term per document whose only
    position is its number of words. `items` has (item, term, at, size)."""
    spark = docs.sparkSession
    terms = items.select("term").distinct()
    n = terms.count()
    if n > BROADCAST_TERMS:
        raise ValueError(f"{n} distinct test terms; build the index for parts of the test set")
    sent = spark.sparkContext.broadcast(np.sort(terms.toArrow()["term"].to_numpy()))
    schema = "term long, doc_id long, h long, positions array<int>"
    rows = in_batches(docs.select("doc_id", "h", "text"), lambda b: _posting_batches(b, sent), schema)
    return stored(rows, "postings")


def _anchors(items: DataFrame, frequency: DataFrame) -> DataFrame:
    """(item, window, at): the places of each window's rarest terms."""
    last = F.greatest(F.col("size") - WINDOW, F.lit(0))
    ranked = items.join(frequency, "term", "left").fillna(0, ["df"])
    opened = ranked.withColumn(
        "window", F.explode(F.sequence(F.greatest(F.col("at") - WINDOW + 1, F.lit(0)), F.least("at", last)))
    )
    order = W.partitionBy("item", "window").orderBy("df", "at")
    return opened.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= ANCHORS)


def _hit_intervals(found: DataFrame) -> DataFrame:
    """Matched places of an item laid over a document, as (item, doc_id, h, start, end) of full windows."""
    runs = W.partitionBy("item", "doc_id", "h", "shift").orderBy("at")
    run = found.withColumn("run", F.col("at") - F.row_number().over(runs))
    whole = run.groupBy("item", "doc_id", "h", "shift", "size", "run").agg(
        F.min("at").alias("a"), F.max("at").alias("b")
    )
    long = F.col("b") - F.col("a") + 1 >= F.least(F.lit(WINDOW), F.col("size"))
    return whole.where(long).select(
        "item",
        "doc_id",
        "h",
        (F.col("shift") + F.col("a")).alias("start"),
        (F.col("shift") + F.col("b") + 1).alias("end"),
    )


def phrase_matches(index: DataFrame, items: DataFrame) -> DataFrame:
    """(item, doc_id, h, start, end): every stretch of a document covered by windows of an item.

    A window is WINDOW words of an item, or all of a shorter one. Lists of the ANCHORS rarest terms of
    each window are intersected first; only where they agree are the lists of all the item's terms
    brought in, by (term, document).
    """
    postings = index.where("term is not null")
    frequency = postings.groupBy("term").agg(F.count("*").alias("df"))
    anchors = stored(_anchors(items, frequency), "anchors")
    asked = anchors.select("item", "term", "at").distinct()
    few = asked.count() <= BROADCAST_ROWS
    near = postings.join(F.broadcast(asked) if few else asked, "term").select(
        "item", "doc_id", "h", "at", F.explode("positions").alias("position")
    )
    laid = near.groupBy("item", "doc_id", "h", (F.col("position") - F.col("at")).alias("shift")).agg(
        F.collect_set("at").alias("places")
    )
    # at most as many places as an item has words; windows whose anchors are all there
    windows = anchors.groupBy("item", "window").agg(F.collect_set("at").alias("need"))
    needs = windows.groupBy("item").agg(F.collect_set("need").alias("needs"))
    needs = F.broadcast(needs) if few else needs
    full = F.exists("needs", lambda need: F.size(F.array_except(need, F.col("places"))) == 0)
    candidates = laid.join(needs, "item").where(full).select("item", "doc_id", "h", "shift")
    candidates = stored(candidates, "candidates")
    in_docs = candidates.select("doc_id", "h").distinct()
    whole = items.groupBy("item").agg(
        F.collect_list(F.struct("term", "at")).alias("words"), F.max("size").alias("size")
    )
    whole = F.broadcast(whole) if few else whole
    required = candidates.join(whole, "item").select(
        "item", "doc_id", "h", "shift", "size", F.inline("words")
    )
    some = F.broadcast(in_docs) if in_docs.count() <= BROADCAST_ROWS else in_docs
    lists = postings.join(some, ["doc_id", "h"], "left_semi").groupBy("term", "doc_id", "h").agg(
        F.first("positions").alias("positions")
    )
    found = required.join(lists, ["term", "doc_id", "h"]).where(
        F.array_contains("positions", F.col("shift") + F.col("at"))
    )
    return _hit_intervals(found.select("item", "doc_id", "h", "shift", "size", "at").distinct())


def proximity_matches(index: DataFrame, items: DataFrame, terms: int = 3, within: int = 30) -> DataFrame:
    """(item, doc_id, h, start, end): the item's rarest terms, in any order, inside `within` words.

    One row per place where such a stretch ends. Items with fewer distinct terms ask for those they have.
    """
    postings = index.where("term is not null")
    frequency = postings.groupBy("term").agg(F.count("*").alias("df"))
    distinct = items.select("item", "term").distinct().join(frequency, "term", "left").fillna(0, ["df"])
    order = W.partitionBy("item").orderBy("df", "term")
    rare = distinct.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= terms)
    rare = rare.withColumn("need", F.count("*").over(W.partitionBy("item"))).select("item", "term", "need")
    at = postings.join(rare, "term").select(
        "item", "need", "doc_id", "h", "term", F.explode("positions").alias("position")
    )
    near = W.partitionBy("item", "doc_id", "h").orderBy("position").rangeBetween(-(within - 1), 0)
    seen = at.withColumn("terms", F.size(F.collect_set("term").over(near))).withColumn(
        "start", F.min("position").over(near)
    )
    return seen.where(F.col("terms") == F.col("need")).select(
        "item", "doc_id", "h", "start", (F.col("position") + 1).alias("end")
    )


def judge(
    docs: DataFrame,
    benchmark: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """Per row: (doc_id, h, n_words, n_hit, items, contaminated).

    A word is hit if it lies inside an occurrence of a window of any item; `items` lists the items with
    occurring windows, sorted as strings. Contaminated: at least one word in twenty is hit.

    Null and empty texts have no words and are clean. Items without words, text or id ask for nothing;
    repeated items count once. `h` is a hash of the text: rows that repeat an id are told apart by it,
    and rows that repeat in full get equal results. A null doc_id is judged like any other. Empty tables:
    no documents give no rows, no items leave all clean.
    """
    given = only(benchmark, item=item_id, text=item_text).where("item is not null and text is not null")
    given = given.select(F.col("item").cast("string"), "text").distinct()
    # one number per item text, as an id may come with more than one
    numbered = given.select(F.xxhash64("item", "text").alias("item"), F.col("item").alias("name"), "text")
    numbered = stored(numbered, "items")
    schema = "item long, term long, at int, size int"
    items = stored(in_batches(numbered.select("item", "text"), _item_batches, schema), "item-terms")
    rows = only(docs, doc_id=doc_id, text=text).select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("doc_id"), F.xxhash64("text").alias("h"), "text"
    )
    index = build_index(rows, items)
    matches = stored(phrase_matches(index, items), "matches")
    names = numbered.select("item", "name")
    named = matches.join(F.broadcast(names) if names.count() <= BROADCAST_ROWS else names, "item")
    # stretches of one document, merged in order; a document holds a bounded number of them
    spans = named.groupBy("doc_id", "h").agg(
        F.array_sort(F.collect_set(F.struct("start", "end"))).alias("spans"),
        F.array_sort(F.collect_set("name")).alias("items"),
    )
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("upto"))
    covered = F.aggregate(
        "spans",
        start,
        lambda s, x: F.struct(
            (s["n"] + F.greatest(x["end"] - F.greatest(x["start"], s["upto"]), F.lit(0))).cast("long").alias("n"),
            F.greatest(s["upto"], x["end"]).alias("upto"),
        ),
        lambda s: s["n"],
    )
    hits = spans.select("doc_id", "h", covered.alias("n_hit"), "items")
    lengths = index.where("term is null").select(
        "doc_id", "h", F.col("positions")[0].cast("long").alias("n_words")
    )
    hits = F.broadcast(hits) if matches.select("doc_id", "h").distinct().count() <= BROADCAST_ROWS else hits
    out = lengths.join(hits, ["doc_id", "h"], "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return out.select(
        F.when(F.col("doc_id") != -(2**63), F.col("doc_id")).alias("doc_id"),
        "h",
        "n_words",
        n_hit.alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"),
    )


SQL = r"""
WITH b AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark
), bw AS (
  SELECT DISTINCT item, least(13, len(ws)) AS n, array_to_string(ws[i : i + least(13, len(ws)) - 1], ' ') AS w
  FROM (SELECT item, ws, unnest(range(1, greatest(len(ws) - 12, 1) + 1)) AS i FROM b WHERE len(ws) > 0)
), d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents
), dw AS (
  SELECT doc_id, n, i, array_to_string(ws[i : i + n - 1], ' ') AS w
  FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i
    FROM d, (SELECT DISTINCT n FROM bw) WHERE len(ws) >= n)
), m AS (
  SELECT dw.doc_id, dw.i, dw.n, bw.item FROM dw JOIN bw ON dw.n = bw.n AND dw.w = bw.w
), h AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM m) GROUP BY doc_id
), t AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, item FROM m) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.ws) AS contaminated
FROM d LEFT JOIN h ON h.doc_id = d.doc_id LEFT JOIN t ON t.doc_id = d.doc_id
"""


@query("op2_decontaminate", SQL)
def op2_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    """Every document held against all benchmark windows."""
    judged = judge(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return judged.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        sha(F.array_join("items", ",")).alias("items_sha256"),
        "contaminated",
    )
