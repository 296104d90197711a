"""Alignment of two tokenisers' tokens, window by window between white-space anchors.

Both tokenisers run over the whole text first. Byte offsets where a token of each ends are shared ends; a
shared end that is followed by a space-marked token on both sides, and the end of a text, is an anchor.
Anchors cut a text into windows of token ids. The same words give the same windows again and again, so
the alignment of a window is worked out once per worker and looked up by its tuple of ids afterwards.

Inside a window, shared ends close groups. Between two ends in a row, of whichever tokeniser, lies one
token of each: that is a link, and every overlapping pair of tokens has exactly one such stretch.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer, pre_tokenizers

from panelwake.llm.bpe import Encoder
from panelwake.llm.common import only, query, scratch_path, stored, table
from panelwake.llm.interning import Rows, text_bytes

BYTE_BPE, PIECE_BPE = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Windows kept with their alignment by one Python worker.
WINDOWS_KEPT = 300_000
#: Id pairs whose counts are sent to the tasks at a time (16 bytes each).
PAIRS_SENT = 2_000_000

ALIGNED = (
    "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, "
    "pairs array<long>, times array<int>"
)


def _runs(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """All places from each start to its end, one after another."""
    sizes = ends - starts
    out = np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)
    return out + np.arange(len(out))


def _spelled(tokens: list[bytes]) -> tuple[Rows, np.ndarray, np.ndarray]:
    """Bytes of all tokens, their sizes, and which begin with a space."""
    rows = Rows(np.uint8)
    sizes = np.array([len(t) for t in tokens], np.int64)
    rows.add(np.frombuffer(b"".join(tokens), np.uint8), sizes)
    return rows, sizes, np.array([t[:1] == b" " for t in tokens])


class _Numbers(dict):
    """Keys numbered in the order in which they are first asked for."""

    def __missing__(self, key) -> int:
        self[key] = n = len(self)
        return n


class _Merges:
    """Ids of distinct words by the tokenizers library's own merges; a word is cut no further."""

    def __init__(self, path: str):
        self.words = Tokenizer(Tokenizer.from_file(path).model)
        self.words.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)

    def __call__(self, words: Iterable[bytes]) -> dict[bytes, list[int]]:
        words = list(words)
        found = self.words.encode_batch_fast([w.decode() for w in words], add_special_tokens=False)
        return {w: e.ids for w, e in zip(words, found)}


class Aligner:
    """Two tokenisers and the windows a worker has met."""

    def __init__(self, a: str, b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.a = Encoder(public_tokenizers.path(a))
        self.a.vocabulary.encode_words = _Merges(public_tokenizers.path(a))
        self.a.cut, self.a.cut_bytes = re.compile("(?!)"), re.compile(b"(?!)")  # no special tokens in texts
        self.b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(b))
        self.a_spelled, self.a_sizes, self.a_marked = _spelled(self.a.vocabulary.bytes)
        pieces = []
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            pieces.append(bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode())
        self.b_spelled, self.b_sizes, self.b_marked = _spelled(pieces)
        self.shift = pair_bits(len(pieces))
        self.decimal = Rows(np.uint8)
        digits = [b"%d," % i for i in range(max(len(self.a_sizes), len(pieces)))]
        self.decimal.add(np.frombuffer(b"".join(digits), np.uint8), np.array([len(d) for d in digits]))
        self.clear()

    def clear(self) -> None:
        self.numbers = _Numbers()
        self.strings: list[bytes] = []
        self.pairs = Rows(np.int64)
        self.groups: list[int] = []

    def tokens(self, column: pa.Array):
        """Ids of both sides and how many each text has; texts that one side does not spell have none."""
        column = pc.fill_null(column.cast(pa.string()), "")
        raw, offsets = text_bytes(
            pc.if_else(pc.equal(column, ""), "", pc.binary_join_element_wise("", column, " "))
        )
        data = np.frombuffer(raw, np.uint8)
        a, n_a = self.a.encode(raw, offsets)
        found = self.b.encode(column.to_pylist(), num_threads=1)
        n_b = np.fromiter(map(len, found), np.int64, len(found))
        b = np.fromiter(chain.from_iterable(found), np.int64, int(n_b.sum()))
        a, n_a = a.astype(np.int64), n_a.astype(np.int64)
        text = np.arange(len(column))
        size = np.diff(offsets)
        fine = np.bincount(np.repeat(text, n_a), self.a_sizes[a], len(text)) == size
        fine &= np.bincount(np.repeat(text, n_b), self.b_sizes[b], len(text)) == size
        of = np.repeat(text, size)
        for spelled, ids, n in ((self.a_spelled, a, n_a), (self.b_spelled, b, n_b)):
            ok = fine.copy()
            joined = spelled.gather(ids[np.repeat(ok, n)])[0]
            bytes_ok = np.repeat(ok, size)
            fine[of[bytes_ok][joined != data[bytes_ok]]] = False
        return a[np.repeat(fine, n_a)], n_a * fine, b[np.repeat(fine, n_b)], n_b * fine

    def _shared(self, a: np.ndarray, b: np.ndarray):
        """Ends of the tokens of both sides, and the places of the tokens that end together."""
        end_a, end_b = np.cumsum(self.a_sizes[a]), np.cumsum(self.b_sizes[b])
        at = np.searchsorted(end_b, end_a)
        both = np.flatnonzero(end_b[np.minimum(at, len(end_b) - 1)] == end_a)
        return end_a, end_b, both, at[both]

    def windows(self, a: np.ndarray, n_a: np.ndarray, b: np.ndarray, n_b: np.ndarray):
        """Ends of the windows among the tokens of both sides."""
        _, _, in_a, in_b = self._shared(a, b)
        last = np.zeros(len(a), bool)
        last[np.cumsum(n_a)[n_a > 0] - 1] = True
        next_a, next_b = np.minimum(in_a + 1, len(a) - 1), np.minimum(in_b + 1, len(b) - 1)
        anchor = last[in_a] | (self.a_marked[a[next_a]] & self.b_marked[b[next_b]])
        return in_a[anchor] + 1, in_b[anchor] + 1

    def learn(self, a: np.ndarray, b: np.ndarray, ends_a: np.ndarray, ends_b: np.ndarray) -> None:
        """Align windows that are new; the tokens of one stand behind those of the one before."""
        end_a, end_b, in_a, in_b = self._shared(a, b)
        close = end_a[ends_a - 1]  # last byte of each window
        links = np.union1d(end_a, end_b)
        pairs = a[np.searchsorted(end_a, links)] << self.shift | b[np.searchsorted(end_b, links)]
        self.pairs.add(pairs, np.diff(np.searchsorted(links, close, side="right"), prepend=0))
        shared = end_a[in_a]
        self.groups += np.diff(np.searchsorted(shared, close, side="right"), prepend=0).tolist()
        # ids in the order of the groups, those of the first tokeniser before those of the second
        side = np.concatenate([2 * np.searchsorted(shared, end_a), 2 * np.searchsorted(shared, end_b) + 1])
        order = np.argsort(side, kind="stable")
        text, sizes = self.decimal.gather(np.concatenate([a, b])[order])
        ends = np.cumsum(sizes)
        side = side[order]
        turn = np.flatnonzero(np.append(side[1:] != side[:-1], True))
        text[ends[turn] - 1] = np.where(side[turn] % 2, ord(";"), ord("|"))
        cuts = [0, *ends[ends_a + ends_b - 1].tolist()]
        raw = text.tobytes()
        self.strings += [raw[x : y - 1] for x, y in zip(cuts[:-1], cuts[1:])]

    def align(self, column: pa.Array):
        """Per text: token counts, groups as text, and id pairs with the times each is linked."""
        if len(self.numbers) > WINDOWS_KEPT:
            self.clear()
        a, n_a, b, n_b = self.tokens(column)
        ends_a, ends_b = self.windows(a, n_a, b, n_b) if len(a) else (np.zeros(0, np.int64),) * 2
        begins_a, begins_b = np.append(0, ends_a)[:-1], np.append(0, ends_b)[:-1]
        # the ids of each window in a row, those of the second tokeniser marked by a high bit
        both = np.empty(len(a) + len(b), np.uint32)
        both[np.arange(len(a)) + np.repeat(begins_b, ends_a - begins_a)] = a
        both[np.arange(len(b)) + np.repeat(ends_a, ends_b - begins_b)] = b | 1 << 31
        raw, ends = both.tobytes(), (4 * (ends_a + ends_b)).tolist()
        numbers, before = self.numbers, len(self.numbers)
        keys = (raw[x:y] for x, y in zip([0, *ends[:-1]], ends))
        at = np.fromiter(map(numbers.__getitem__, keys), np.int64, len(ends_a))
        new = np.flatnonzero(at >= before)
        new = new[np.unique(at[new], return_index=True)[1]]
        if len(new):
            self.learn(
                a[_runs(begins_a[new], ends_a[new])],
                b[_runs(begins_b[new], ends_b[new])],
                np.cumsum(ends_a[new] - begins_a[new]),
                np.cumsum(ends_b[new] - begins_b[new]),
            )
        per_text = np.searchsorted(ends_a, np.cumsum(n_a), side="right")  # windows up to each text's end
        cuts = [0, *per_text.tolist()]
        strings = list(map(self.strings.__getitem__, at.tolist()))
        groups = [b";".join(strings[x:y]) for x, y in zip(cuts[:-1], cuts[1:])]
        text = np.repeat(np.arange(len(n_a)), np.diff(cuts))
        n_groups = np.bincount(text, np.array(self.groups, np.int64)[at], len(n_a)).astype(np.int64)
        pairs, sizes = self.pairs.gather(at)
        n_links = np.bincount(text, sizes, len(n_a)).astype(np.int64)
        return n_a, n_b, n_groups, n_links, groups, *_counted(pairs, n_links)


def pair_bits(n_b: int) -> int:
    """Bits that the second id takes in a pair."""
    return max(1, (n_b - 1).bit_length())


def _counted(pairs: np.ndarray, sizes: np.ndarray):
    """Distinct pairs of each text in order, the times of each, and how many there are."""
    bits = int(pairs.max(initial=0)).bit_length()
    both = np.sort(np.repeat(np.arange(len(sizes)), sizes) << bits | pairs)
    begin = np.flatnonzero(np.append(True, both[1:] != both[:-1])[: len(both)])
    times = np.diff(np.append(begin, len(both)))
    text = both[begin] >> bits
    return both[begin] & (1 << bits) - 1, times, np.bincount(text, minlength=len(sizes))


@lru_cache(maxsize=2)
def _aligner(a: str, b: str) -> Aligner:
    return Aligner(a, b)


def _align_batches(batches: Iterator[pa.RecordBatch], a: str, b: str):
    aligner = _aligner(a, b)
    for batch in batches:
        n_a, n_b, n_groups, n_links, groups, pairs, times, n = aligner.align(batch.column(1))
        offsets = pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32))
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                *(pa.array(x) for x in (n_a, n_b, n_groups, n_links)),
                pa.array(groups, pa.binary()).cast(pa.string()),
                pa.ListArray.from_arrays(offsets, pa.array(pairs)),
                pa.ListArray.from_arrays(offsets, pa.array(times.astype(np.int32))),
            ],
            names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "pairs", "times"],
        )


def align(
    docs: DataFrame, a: str = BYTE_BPE, b: str = PIECE_BPE, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, groups, pairs, times) for every row.

    `a` names a byte-level BPE and `b` a piece model of the public tokenisers. `groups` spells the
    alignment, as `a1,a2|b1;a3|b2,b3` in ids; `pairs` are the distinct linked id pairs in order, the first
    id shifted by `pair_bits` of the second vocabulary, and `times` says how often each is linked.

    A null or empty text, and one that either tokeniser does not spell byte by byte (as a text with U+2581
    in it), has no tokens. Strings of special tokens are plain text. Rows stay where they are: no shuffle,
    no state between texts but the windows kept. Repeated rows and null ids come back as they went in.
    """
    rows = only(docs, doc_id=doc_id, text=text).select(F.col("doc_id").cast("long"), "text")
    return rows.mapInArrow(lambda batches: _align_batches(batches, a, b), ALIGNED)


def pair_counts(aligned: DataFrame, bits: int) -> DataFrame:
    """(pair, n, best): how many rows hold each id pair linked, and whether no pair of its first id has more."""
    counts = aligned.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n"))
    counts = stored(counts, "pairs").withColumn("a", F.shiftright("pair", bits))
    most = counts.groupBy("a").agg(F.max("n").alias("most"))  # a row per id of the first vocabulary
    return counts.join(F.broadcast(most), "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def _sum_batches(batches: Iterator[pa.RecordBatch], sent):
    """Add what the counts sent along say about each row."""
    known, n, best = sent.value
    for batch in batches:
        lists = batch.column("pairs")
        pairs, times = lists.flatten().to_numpy(), batch.column("times").flatten().to_numpy().astype(np.int64)
        at = np.minimum(np.searchsorted(known, pairs), len(known) - 1)
        there = (known[at] == pairs) * times
        text = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
        sums = np.zeros((2, len(lists)), np.int64)
        np.add.at(sums[0], text, there * best[at])
        np.add.at(sums[1], text, there * n[at])
        columns = {name: batch.column(name) for name in batch.schema.names}
        for name, values in zip(("n_best", "count_sum"), sums):
            columns[name] = pc.add(columns[name], pa.array(values))
        yield pa.RecordBatch.from_pydict(columns, schema=batch.schema)


def with_counts(aligned: DataFrame, bits: int, sent: int = PAIRS_SENT) -> DataFrame:
    """The stored alignment with n_best (links whose pair is the best of its first id) and count_sum.

    The counts of `sent` pairs at a time go to all tasks, in as many passes as it takes. Between passes
    rows end on tables in the shared folder. Rows without links have zeros.
    """
    counts = stored(pair_counts(aligned, bits), "counts")
    blocks = max(1, -(-counts.count() // sent))
    rows = aligned.select("*", F.lit(0).cast("long").alias("n_best"), F.lit(0).cast("long").alias("count_sum"))
    for i in range(blocks):
        block = counts.where(F.pmod(F.xxhash64("pair"), F.lit(blocks)) == i).toArrow()
        if not block.num_rows:
            continue
        order = np.argsort(block["pair"].to_numpy())
        columns = [block[c].to_numpy()[order] for c in ("pair", "n", "best")]
        known = aligned.sparkSession.sparkContext.broadcast(columns)
        rows = rows.mapInArrow(lambda batches, known=known: _sum_batches(batches, known), rows.schema)
        if i < blocks - 1:
            rows = _stored_sorted(rows)
    return rows


def _stored_sorted(df: DataFrame) -> DataFrame:
    """A stored table whose ascending numbers are written as differences."""
    path = scratch_path(df.sparkSession, "aligned")
    df.write.option("parquet.enable.dictionary", "false").option("parquet.writer.version", "PARQUET_2_0").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def digests(docs: DataFrame, a: str = BYTE_BPE, b: str = PIECE_BPE) -> DataFrame:
    """The alignment of every row with corpus-wide counts, groups as a hash."""
    sha = F.when(F.col("n_a") == 0, "").otherwise(F.sha2("groups", 256))
    aligned = align(docs, a, b).withColumn("groups_sha256", sha).drop("groups")
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(b))
    counted = with_counts(_stored_sorted(aligned), pair_bits(model.get_piece_size()))
    return counted.drop("pairs", "times")


@query("op11_alignment")
def op11_alignment(spark: SparkSession, folder: str) -> DataFrame:
    """Tokens of two tokenisers aligned in every document, with corpus-wide counts of linked ids."""
    return digests(table(spark, folder, "documents"))
