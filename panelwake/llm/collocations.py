"""Phrase collocations by dynamic itemset counting over cyclic scans of shards.

The rows are dealt to shards, and each scan reads one of them, round and round. A scan counts phrases of
all lengths that are active: words during the first round, and a longer phrase from the first stop after
which both its subphrases (without its last and without its first word) have reached the threshold, for
one full cycle. So a phrase meets every shard once, whenever it starts, and its count is exact; a phrase
with a subphrase below the threshold is below it too and never has to be counted.

The scans count hashes of phrases, packed into one value per task and bucket of hashes. What has reached
the threshold goes to the tasks as a Bloom filter of bounded size. Filters only grow and decide alike in
every task, so a phrase that one lets in by mistake is counted for one full cycle like any other. Hashes
that meet, and counts cut off at the threshold, can only let more phrases through; a last scan counts
the phrases that are left by their words.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelwake.llm.common import (
    dropped,
    freed_shuffles,
    in_batches,
    on_groups,
    only,
    partitions,
    query,
    scratch_path,
    stored,
    table,
)
from panelwake.llm.interning import hash_runs, hash_words, mixed, split_at, text_bytes, text_of
from panelwake.llm.packed import unpack

SHARDS = 3
#: Bytes of text counted at a time in a task; one longer text is counted at once.
FLUSH = 4 << 20
#: Documents per bucket of hashes.
BUCKET_ROWS = 5000
#: Bits of a filter per phrase, and their logarithm at least and at most (128 MB).
BITS_EACH, LEAST_BITS, MOST_BITS = 32, 16, 30
#: Logarithm of the bits in one part of a filter.
PART = 16
#: Parts of a filter sent to the driver at a time (8 kB each).
PARTS_SENT = 4096

# fixed values: signs that end a piece, blanks between words
_ENDS, _BLANKS = b".,;:!?\n\x0b\x0c\r", b" \t"
_TABLE = bytes(
    10 if b in _ENDS else 32 if b in _BLANKS else b | 32 if 65 <= b <= 90 else b for b in range(256)
)
_INSIDE = np.array([b not in (10, 32) for b in range(256)])
_random = np.random.default_rng(12)
_STEPS = _random.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SPOTS = _random.integers(1, 2**63, 3, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

COUNTS = "lang string, words int, phrase string, a long"


def _label_hashes(labels: list[str]) -> np.ndarray:
    raw, offsets = text_bytes(pa.array(["\x01" + x for x in labels], pa.string()))
    return hash_words(np.frombuffer(raw, np.uint8), offsets[:-1], np.diff(offsets))[0]


def _keys(words: np.ndarray, labels: np.ndarray, n: int) -> np.ndarray:
    """A hash of the n words from each word on, and of a label."""
    count = max(0, len(words) - n + 1)
    out = labels[:count] * _STEPS[-1]
    for i in range(n):
        out = out + words[i : i + count] * _STEPS[i]
    return mixed(out)


def _spots(keys: np.ndarray, log_bits: int) -> np.ndarray:
    return ((mixed(keys)[None, :] * _SPOTS[:, None]) >> np.uint64(64 - log_bits)).astype(np.int64)


class Filter:
    """A Bloom filter of the keys of phrases of one length."""

    def __init__(self, log_bits: int):
        self.log_bits, self.bits = log_bits, np.zeros(1 << log_bits - 3, np.uint8)

    def has(self, keys: np.ndarray) -> np.ndarray:
        out = np.ones(len(keys), bool)
        for i in range(0, len(keys), 1 << 17):
            for spot in _spots(keys[i : i + (1 << 17)], self.log_bits):
                out[i : i + (1 << 17)] &= (self.bits[spot >> 3] >> (spot & 7).astype(np.uint8) & 1).astype(bool)
        return out


def _filter_spots(batches: Iterator[pa.RecordBatch], log_bits: int):
    """(part, bit) of every key in the filter."""
    for batch in batches:
        spots = _spots(batch.column(0).to_numpy().view(np.uint64), log_bits).ravel()
        yield pa.RecordBatch.from_arrays(
            [pa.array((spots >> PART).astype(np.int32)), pa.array((spots & (1 << PART) - 1).astype(np.int32))],
            names=["part", "bit"],
        )


def _filter_part(group: pa.Table) -> pa.Table:
    bits = np.zeros(1 << PART, np.uint8)
    bits[group["bit"].to_numpy()] = 1
    packed = np.packbits(bits, bitorder="little").tobytes()
    return pa.Table.from_arrays([group["part"].slice(0, 1), pa.array([packed], pa.binary())], names=["part", "bits"])


def _grown(before: Filter | None, reached: DataFrame, shards: int) -> Filter | None:
    """The filter with the keys of a table; its parts are set in tasks."""
    n = reached.count()
    if not n:
        return before
    log_bits = min(MOST_BITS, max(LEAST_BITS, (BITS_EACH * shards * n).bit_length()))
    out = Filter(before.log_bits if before else log_bits)
    if before:
        out.bits[:] = before.bits
    spots = in_batches(reached, lambda b: _filter_spots(b, out.log_bits), "part int, bit int")
    parts = on_groups(spots.groupBy("part"), _filter_part, "part int, bits binary")
    n_parts = 1 << out.log_bits - PART
    if n_parts > PARTS_SENT:
        parts = stored(parts, "filter")
    for first in range(0, n_parts, PARTS_SENT):  # the filter's own size, whatever the table's
        some = parts.where(F.col("part").between(first, first + PARTS_SENT - 1)) if n_parts > PARTS_SENT else parts
        for part, bits in zip(*some.toArrow().to_pydict().values()):
            at = part << PART - 3
            out.bits[at : at + (1 << PART - 3)] |= np.frombuffer(bits, np.uint8)
    return out


class _Words:
    """The words of some texts: their places, pieces, hashes, and the keys of phrases of them."""

    def __init__(self, column: pa.Array, langs: pa.Array, buckets: int):
        self.buckets = np.uint64(buckets)
        labels = langs.dictionary_encode()
        self.names, code = labels.dictionary, labels.indices.to_numpy()
        raw, offsets = text_bytes(column)
        self.raw = raw.translate(_TABLE)
        data = np.frombuffer(self.raw, np.uint8)
        self.starts, self.sizes = split_at(data, offsets, _INSIDE)
        text = text_of(offsets, self.starts)
        self.lang = code[text]
        lines = np.cumsum(data == 10, dtype=np.int32)[self.starts]
        self.follows = (text[1:] == text[:-1]) & (lines[1:] == lines[:-1])
        self.data, self.hashes = data, hash_runs(data, self.starts, self.sizes)
        self.labels = _label_hashes(self.names.to_pylist())[self.lang]

    def keys(self, n: int) -> np.ndarray:
        """A key of the n words from each word on: a bucket and four bytes inside it."""
        h = _keys(self.hashes, self.labels, n)
        return (h >> np.uint64(32)) % self.buckets << np.uint64(32) | h & np.uint64(0xFFFFFFFF)

    def whole(self, n: int) -> np.ndarray:
        """Whether the n words from each word on are in one piece."""
        out = np.ones(max(0, len(self.starts) - n + 1), bool)
        for i in range(n - 1):
            out &= self.follows[i : i + len(out)]
        return out

    def phrases(self, places: np.ndarray, n: int) -> list[bytes]:
        last = places + n - 1
        a, b = self.starts[places], self.starts[last] + self.sizes[last]
        out = [self.raw[x:y] for x, y in zip(a.tolist(), b.tolist())]
        ends = np.cumsum(self.sizes)
        tight = b - a == ends[last] - ends[places] + self.sizes[places] + n - 1
        for i in np.flatnonzero(~tight).tolist():
            out[i] = b" ".join(out[i].split())
        return out


def _scan(w: _Words, longest: int, words_active: bool, now: list, done: list, counts: str, most: int):
    """Packed counts of the active phrases of some texts; `now` and `done` are filters by length."""
    for n in range(1, longest + 1):
        if n == 1:
            keys = w.keys(1) if words_active else w.labels[:0]
        elif now[n - 2] is None:
            continue
        else:
            shorter = w.keys(n - 1)
            there = now[n - 2].value.has(shorter)
            active = w.whole(n) & there[:-1] & there[1:]
            if done[n - 2] is not None:
                there = done[n - 2].value.has(shorter)
                active &= ~(there[:-1] & there[1:])
            keys = w.keys(n)[active]
        if not len(keys):
            continue
        keys = np.sort(keys)
        begin = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        times = np.minimum(np.diff(np.append(begin, len(keys))), most).astype(counts)
        bucket, low = (keys[begin] >> np.uint64(32)).astype(np.int64), keys[begin].astype("<u4")
        first = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
        cuts = [*first.tolist(), len(bucket)]
        blobs = [low[i:j].tobytes() + times[i:j].tobytes() for i, j in zip(cuts[:-1], cuts[1:])]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.full(len(first), n, np.int32)),
                pa.array(bucket[first].astype(np.int32)),
                pa.array(blobs, pa.binary()),
            ],
            names=["words", "bucket", "blob"],
        )


def _distinct(first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the distinct (first, second) pairs, and how often each occurs."""
    order = np.argsort(first, kind="stable")
    a, b = first[order], second[order]
    if ((a[1:] == a[:-1]) & (b[1:] != b[:-1])).any():  # one hash agrees by chance
        order = np.lexsort((second, first))
        a, b = first[order], second[order]
    begin = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))[: len(a)])
    return order[begin], np.diff(np.append(begin, len(a)))


def _recount(w: _Words, wanted: list):
    """Phrases let through by the filters, with their words, and the number of words as those of none."""
    lang, words, phrases, counts = [], [], [], []
    second = hash_words(w.data, w.starts, w.sizes)[0]
    for code, n in enumerate(np.bincount(w.lang, minlength=len(w.names)).tolist()):
        lang.append(np.array([code]))
        words.append(np.zeros(1, np.int32))
        phrases.append(b"")
        counts.append(np.array([n]))
    for n, known in enumerate(wanted, 1):
        if known is None or len(w.starts) < n:
            continue
        at = np.flatnonzero(w.whole(n) & known.value.has(w.keys(n)))
        places, times = _distinct(*(_keys(h, w.labels, n)[at] for h in (w.hashes, second)))
        places = at[places]
        lang.append(w.lang[places])
        words.append(np.full(len(places), n, np.int32))
        phrases += w.phrases(places, n)
        counts.append(times)
    yield pa.RecordBatch.from_arrays(
        [
            w.names.take(pa.array(np.concatenate(lang))),
            pa.array(np.concatenate(words)),
            pa.array(phrases, pa.binary()).cast(pa.string()),
            pa.array(np.concatenate(counts).astype(np.int64)),
        ],
        names=["lang", "words", "phrase", "a"],
    )


def _texts(batches: Iterator[pa.RecordBatch], buckets: int, each, *how):
    """Apply a function to the words of some megabytes of text at a time."""
    held, size = [], 0

    def out():
        both = pa.Table.from_batches(held).combine_chunks()
        w = _Words(both["text"].chunk(0), both["lang"].chunk(0), buckets)
        return each(w, *how) if len(w.starts) else ()

    for batch in batches:
        held.append(batch)
        size += batch.column(1).nbytes
        if size >= FLUSH:
            yield from out()
            held, size = [], 0
    if sum(b.num_rows for b in held):
        yield from out()


def _merged(group: pa.Table, counts: str, least: int) -> pa.Table:
    """Keys of a bucket whose counts reach the threshold."""
    keys, times = unpack(group["blob"], ["<u4", counts])
    both = np.sort(keys.astype(np.uint64) << np.uint64(32) | times)
    keys, times = both >> np.uint64(32), (both & np.uint64(0xFFFFFFFF)).astype(np.int64)
    begin = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[: len(keys)])
    reached = keys[begin[np.add.reduceat(times, begin) >= least]]
    out = reached.astype(np.int64) | group["bucket"][0].as_py() << 32
    return pa.Table.from_arrays([pa.array(out)], names=["key"])


def phrase_counts(
    docs: DataFrame,
    longest: int = 3,
    least: int = 10,
    shards: int = SHARDS,
    text: str = "text",
    lang: str = "lang",
) -> tuple[DataFrame, DataFrame]:
    """(lang, words, phrase, a) of the phrases of up to `longest` words that occur at least `least` times,
    and (lang, n) of all word occurrences.

    Null texts are empty and null languages 'und'. Empty tables and texts give no rows. Each scan and stop
    ends on tables in the shared folder.
    """
    spark = docs.sparkSession
    rows = only(docs, lang=lang, text=text).where("text <> ''").select(
        F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"),
        F.col("text").cast("string").alias("text"),
        F.pmod(F.monotonically_increasing_id(), F.lit(shards)).cast("int").alias("shard"),
    )
    dealt = scratch_path(spark, "shards")
    rows.write.partitionBy("shard").option("compression", "zstd").parquet(dealt)
    source = spark.read.schema("lang string, text string, shard int").parquet(dealt)
    buckets = max(partitions(spark), source.count() // BUCKET_ROWS)
    counts = "u1" if least < 256 else "<u4"

    scans: list[list[DataFrame | None]] = [[] for _ in range(longest)]
    paths: list[str] = []
    filters: list[list] = [[None] for _ in range(longest)]  # by length and stop, broadcast
    stop = 0
    while True:
        back = max(0, stop - shards)
        now, done = [f[stop] for f in filters[:-1]], [f[back] for f in filters[:-1]]
        counted = [stop < shards] + [a is not None and a is not b for a, b in zip(now, done)]
        if not any(counted):
            break
        shard = source.where(F.col("shard") == stop % shards).select("lang", "text")
        use = [a if c else None for a, c in zip(now, counted[1:])]
        path = scratch_path(spark, "scan")
        paths.append(path)
        how = (buckets, _scan, longest, counted[0], use, done, counts, least)
        found = in_batches(shard, lambda b, how=how: _texts(b, *how), "words int, bucket int, blob binary")
        found.write.partitionBy("words").parquet(path)
        found = spark.read.schema("bucket int, blob binary, words int").parquet(path)
        stop += 1
        for i in range(longest):
            scans[i].append(found.where(F.col("words") == i + 1).select("bucket", "blob") if counted[i] else None)
            latest = filters[i][-1]
            if counted[i]:
                # a phrase that is still being counted started in one of these scans
                cycle = reduce(DataFrame.unionByName, [x for x in scans[i][-shards:] if x is not None])
                merged = on_groups(cycle.groupBy("bucket"), lambda g: _merged(g, counts, least), "key long")
                grown = _grown(latest and latest.value, stored(merged, "reached"), shards)
                if grown and (latest is None or (grown.bits != latest.value.bits).any()):
                    latest = spark.sparkContext.broadcast(grown)
            filters[i].append(latest)
        if stop >= shards:  # later cycles begin after this scan
            dropped(spark, paths[stop - shards])

    for path in paths[max(0, stop - shards + 1) :]:
        dropped(spark, path)
    how = (buckets, _recount, [f[-1] for f in filters])
    by = ["lang", "words", "phrase"]
    parts = []
    for i in range(shards):  # one after another: the shuffle files of one go before the next
        shard = source.where(F.col("shard") == i).select("lang", "text")
        part = in_batches(shard, lambda b: _texts(b, *how), COUNTS)
        parts.append(stored(part.groupBy(*by).agg(F.sum("a").alias("a")), "recount"))
    exact = reduce(DataFrame.unionByName, parts).groupBy(*by).agg(F.sum("a").alias("a"))
    exact = stored(exact.where((F.col("words") == 0) | (F.col("a") >= least)), "phrases")
    n_words = exact.where("words = 0").select("lang", F.col("a").alias("n"))
    return exact.where("words > 0"), n_words


#: floor(1000000 a a / (l r)) in decimals: exact for counts of up to fifteen digits.
SCORE = (
    "cast(a as decimal(15, 0)) * cast(a as decimal(15, 0)) * cast(1000000 as decimal(7, 0))"
    " div (cast(l as decimal(15, 0)) * cast(r as decimal(15, 0)))"
)


def _inner(phrases: DataFrame, n: int) -> DataFrame:
    """(lang, a, phrase) of the phrases of n words inside longer ones."""
    words = F.split("phrase", " ")
    starts = F.sequence(F.lit(1), F.col("words") - n + 1)
    parts = F.transform(starts, lambda i: F.array_join(F.slice(words, i, n), " "))
    return phrases.where(F.col("words") > n).select("lang", "a", F.explode(parts).alias("phrase"))


def collocations(
    docs: DataFrame,
    longest: int = 3,
    least: int = 10,
    top: int = 2000,
    inside_percent: int = 50,
    shards: int = SHARDS,
    text: str = "text",
    lang: str = "lang",
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's `top` phrases of 2 to `longest` words.

    The score of a cut of a phrase into two parts is floor(1000000 a a / (l r)) with the counts of the
    phrase and its parts; the lowest-scoring cut counts, of equal ones that after fewest words. A phrase
    gives way to a longer one around it that has `inside_percent` of its count. Order is by score and
    count from high to low, then by phrase. Arithmetic is decimal: counts may have fifteen digits.

    Null texts are empty, null languages 'und'; rows repeated in the input count as often as they are
    there. Empty tables give no rows. Columns of the input other than the two named are not looked at.
    """
    with freed_shuffles(docs.sparkSession):
        counts, n_words = phrase_counts(docs, longest, least, shards, text, lang)
    phrases = counts.where("words > 1")
    words, cut = F.split("phrase", " "), F.explode(F.sequence(F.lit(1), F.col("words") - 1))
    cuts = phrases.select("lang", "phrase", "a", cut.alias("k"), words.alias("w")).select(
        "lang",
        "phrase",
        "a",
        "k",
        F.array_join(F.slice("w", F.lit(1), F.col("k")), " ").alias("head"),
        F.array_join(F.slice("w", F.col("k") + 1, F.size("w")), " ").alias("rest"),
    )
    heads = counts.select("lang", F.col("phrase").alias("head"), F.col("a").alias("l"))
    rests = counts.select("lang", F.col("phrase").alias("rest"), F.col("a").alias("r"))
    scored = (
        cuts.join(heads, ["lang", "head"])
        .join(rests, ["lang", "rest"])
        .groupBy("lang", "phrase", "a")
        .agg(F.min(F.struct(F.expr(SCORE).alias("score"), "k", "l", "r")).alias("best"))
    )
    inner = [_inner(phrases, n) for n in range(2, longest)]
    if inner:
        around = reduce(DataFrame.unionByName, inner).groupBy("lang", "phrase").agg(F.max("a").alias("around"))
        scored = scored.join(around, ["lang", "phrase"], "left").where(
            F.col("around").isNull() | (100 * F.col("around") < inside_percent * F.col("a"))
        )
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = (
        scored.select("lang", "phrase", "a", "best.l", "best.r", "best.score")
        .withColumn("rank", F.row_number().over(order).cast("long"))
        .where(F.col("rank") <= top)
    )
    return ranked.join(n_words, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


SQL = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), w AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p
), f AS (
  SELECT lang, m, phrase, count(*) AS a
  FROM (
    SELECT lang, 1 AS m, unnest(ws) AS phrase FROM w
    UNION ALL
    SELECT lang, 2, unnest(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) FROM w
    UNION ALL
    SELECT lang, 3, unnest(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]))
    FROM w
  ) GROUP BY ALL
), c AS (
  SELECT *, string_split(phrase, ' ') AS ws FROM f WHERE m > 1 AND a >= 10
), cuts AS (
  SELECT lang, phrase, a, 1 AS k, ws[1] AS head, array_to_string(ws[2:], ' ') AS rest FROM c
  UNION ALL
  SELECT lang, phrase, a, 2, ws[1] || ' ' || ws[2], ws[3] FROM c WHERE m = 3
), scored AS (
  SELECT cuts.lang, cuts.phrase, cuts.a, k, x.a AS l, y.a AS r,
    CAST(CAST(1000000 AS HUGEINT) * cuts.a * cuts.a // (CAST(x.a AS HUGEINT) * y.a) AS BIGINT) AS score
  FROM cuts JOIN f x ON x.lang = cuts.lang AND x.phrase = head JOIN f y ON y.lang = cuts.lang AND y.phrase = rest
), best AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), kept AS (
  SELECT * FROM best b WHERE NOT EXISTS (
    SELECT 1 FROM (
      SELECT lang, a, ws[1] || ' ' || ws[2] AS part FROM c WHERE m = 3
      UNION ALL SELECT lang, a, ws[2] || ' ' || ws[3] FROM c WHERE m = 3
    ) o WHERE o.lang = b.lang AND o.part = b.phrase AND 100 * o.a >= 50 * b.a)
), n AS (
  SELECT lang, CAST(sum(a) AS BIGINT) AS n FROM f WHERE m = 1 GROUP BY lang
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept
)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN n USING (lang) WHERE rank <= 2000
"""


@query("op12_collocations", SQL)
def op12_collocations(spark: SparkSession, folder: str) -> DataFrame:
    """The first 2,000 phrases of two and three words of each language."""
    return collocations(table(spark, folder, "documents"))
