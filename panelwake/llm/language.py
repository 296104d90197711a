"""Language ID by segmentation-marginalised unigrams over a fixed public vocabulary.

A language is a probability per piece. A word's probability is the sum over all ways to cut it into
pieces, found by a forward pass over its lattice. No piece crosses white space, so a text's probability
is the product over its words and the sum over all segmentations of the text stays exact.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelwake.llm.common import TOKENIZERS, in_batches, mapped, only, query, quoted, stored, table, unused

#: Scores of words kept by one task: this many words of eight languages, fewer words of more.
WORDS_KEPT = 200_000
#: Languages fitted together; their pieces do not depend on each other.
TOGETHER = 32
UNDETERMINED = "und"
_LETTER = re.compile(r"[^\W\d_]")
_MARK = "▁"  # opens each word in the vocabulary


class Pieces:
    """The vocabulary as a trie in sorted arrays, small enough to send to every task."""

    def __init__(self, pieces: list[str]):
        nodes, ends = [{}], [-1]
        for i, piece in enumerate(pieces):
            at = 0
            for c in piece:
                if c not in nodes[at]:
                    nodes[at][c] = len(nodes)
                    nodes.append({})
                    ends.append(-1)
                at = nodes[at][c]
            ends[at] = i
        edges = sorted(((n << 21) | ord(c), to) for n, d in enumerate(nodes) for c, to in d.items())
        self.keys = np.array([k for k, _ in edges] or [-1], np.int64)
        self.to = np.array([t for _, t in edges] or [0], np.int64)
        self.ends = np.array(ends, np.int64)
        self.unknown = len(pieces)  # stands for any one character that is no piece itself
        self.size = len(pieces) + 1

    @staticmethod
    def load(path: str) -> Pieces:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(sp.get_piece_size())
        odd = lambda i: sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i)
        return Pieces([sp.id_to_piece(i) for i in ids if not odd(i)])


class Lattice:
    """All pieces in all words: edges from a node to a later node of the same word."""

    def __init__(self, words: list[str], pieces: Pieces):
        sizes = np.fromiter((len(w) + 1 for w in words), np.int64, len(words))
        text = "".join(chain.from_iterable((_MARK, w) for w in words))
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        self.first = np.cumsum(sizes) - sizes
        word = np.repeat(np.arange(len(words)), sizes)
        end = np.repeat(self.first + sizes, sizes)
        at, node, depth = np.arange(len(codes)), np.zeros(len(codes), np.int64), 0
        found, single = [], np.zeros(len(codes), bool)
        while len(at):
            key = (node << 21) | codes[at + depth]
            j = np.minimum(np.searchsorted(pieces.keys, key), len(pieces.keys) - 1)
            hit = pieces.keys[j] == key
            at, node, depth = at[hit], pieces.to[j[hit]], depth + 1
            whole = pieces.ends[node] >= 0
            if depth == 1:
                single[at[whole]] = True
            found.append((at[whole], np.full(int(whole.sum()), depth), pieces.ends[node[whole]]))
            more = at + depth < end[at]
            at, node = at[more], node[more]
        rest = np.flatnonzero(~single)
        found.append((rest, np.ones(len(rest), np.int64), np.full(len(rest), pieces.unknown)))
        start, size, self.piece = (np.concatenate(x) for x in zip(*found))
        # a word of n characters has n + 1 nodes
        self.source = start + word[start]
        self.target = self.source + size
        self.word = word[start]
        self.nodes = len(codes) + len(words)
        self.begin = self.first + np.arange(len(words))
        self.final = self.begin + sizes

    def _sweep(self, values: np.ndarray, come: np.ndarray, go: np.ndarray, depth: np.ndarray, origin):
        """Sums of path products in log space, from `origin`, edges in order of the depth of `go`."""
        out = np.full((self.nodes, values.shape[1]), -np.inf)
        out[origin] = 0.0
        order = np.lexsort((go, depth))
        cuts = np.flatnonzero(np.diff(depth[order], prepend=-1, append=-1))
        for a, b in zip(cuts[:-1], cuts[1:]):
            e = order[a:b]
            to, first = np.unique(go[e], return_index=True)
            v = out[come[e]] + values[e]
            top = np.maximum.reduceat(v, first)
            share = np.exp(v - np.repeat(top, np.diff(np.append(first, len(e))), axis=0))
            out[to] = top + np.log(np.add.reduceat(share, first))
        return out

    def forward(self, values: np.ndarray) -> np.ndarray:
        depth = self.target - self.begin[self.word]
        return self._sweep(values, self.source, self.target, depth, self.begin)

    def backward(self, values: np.ndarray) -> np.ndarray:
        depth = self.final[self.word] - self.source
        return self._sweep(values, self.target, self.source, depth, self.final)


def word_scores(words: list[str], pieces: Pieces, log_p: np.ndarray) -> np.ndarray:
    """Log probability of each word (row) in each language (column), over all segmentations."""
    lattice = Lattice(words, pieces)
    return lattice.forward(log_p[lattice.piece])[lattice.final]


def expected_counts(words: list[str], counts: np.ndarray, pieces: Pieces, log_p: np.ndarray) -> np.ndarray:
    """How often each piece is expected in words seen `counts` times per language."""
    lattice = Lattice(words, pieces)
    values = log_p[lattice.piece]
    ahead, behind = lattice.forward(values), lattice.backward(values)
    total = ahead[lattice.final][lattice.word]
    share = np.exp(ahead[lattice.source] + values + behind[lattice.target] - total)
    share *= counts[lattice.word]
    out = np.zeros((pieces.size, counts.shape[1]))
    for language in range(counts.shape[1]):
        out[:, language] = np.bincount(lattice.piece, share[:, language], pieces.size)
    return out


@dataclass
class Model:
    languages: list[str]
    log_prior: np.ndarray
    log_p: np.ndarray  # piece x language
    pieces: Pieces


def _count_words(batches: Iterator[pa.RecordBatch]):
    for batch in batches:
        seen: dict[int, Counter] = {}
        texts, languages = batch.column("text").to_pylist(), batch.column("language").to_pylist()
        for text, language in zip(texts, languages):
            seen.setdefault(language, Counter()).update(text.split())
        rows = [(k, w, n) for k, c in seen.items() for w, n in c.items()]
        languages, words, n = zip(*rows) if rows else ((), (), ())
        yield pa.RecordBatch.from_arrays(
            [pa.array(languages, pa.int32()), pa.array(words, pa.string()), pa.array(n, pa.int64())],
            names=["language", "word", "n"],
        )


def fit(
    labelled: DataFrame,
    text: str = "text",
    lang: str = "lang",
    vocabulary: str = f"{TOKENIZERS}/piece_bpe_32k.model",
    docs_per_language: int = 2000,
    rounds: int = 3,
    smoothing: float = 0.1,
) -> Model:
    """Piece probabilities per language by expectation maximisation.

    The model is fitted on about `docs_per_language` rows of every label that occurs, drawn by a hash of
    the text; that bound is a parameter. Rows without text or label take no part. Counts per round are
    sums by Spark, for `TOGETHER` labels at a time; only one number per piece and label reaches the
    driver (a quarter of a megabyte per label). Without labelled rows the model knows no language.
    """
    spark = labelled.sparkSession
    pieces = Pieces.load(vocabulary)
    rows = only(labelled, text=text, lang=lang).where("text is not null and lang is not null")
    tops = sorted(rows.groupBy("lang").count().collect(), key=lambda r: r["lang"])
    if not tops:
        return Model([], np.zeros(0), np.zeros((pieces.size, 0)), pieces)
    totals = np.array([r["count"] for r in tops], float)
    log_p = np.empty((pieces.size, len(tops)))
    for first in range(0, len(tops), TOGETHER):
        part = [(r["lang"], r["count"]) for r in tops[first : first + TOGETHER]]
        log_p[:, first : first + len(part)] = _fit_part(rows, part, pieces, docs_per_language, rounds, smoothing)
    return Model([r["lang"] for r in tops], np.log(totals / totals.sum()), log_p, pieces)


def _fit_part(
    rows: DataFrame,
    labels: list[tuple[str, int]],
    pieces: Pieces,
    docs_per_language: int,
    rounds: int,
    smoothing: float,
) -> np.ndarray:
    """Log probability of each piece (row) in each of these labels (column)."""
    spark = rows.sparkSession
    shares = spark.createDataFrame(
        [(name, i, min(1.0, docs_per_language / n)) for i, (name, n) in enumerate(labels)],
        "lang string, language int, share double",
    )
    draw = F.pmod(F.xxhash64(F.lit("sample"), "text"), F.lit(1 << 30)) / (1 << 30)
    sample = rows.join(F.broadcast(shares), "lang").where(draw < F.col("share"))
    count = lambda i: F.sum(F.when(F.col("language") == i, F.col("n")).otherwise(0))
    counted = (
        in_batches(sample.select("language", "text"), _count_words, "language int, word string, n long")
        .groupBy("word")
        .agg(*[count(i).alias(f"n{i}") for i in range(len(labels))])
    )
    counted = stored(counted, "words")
    log_p = np.full((pieces.size, len(labels)), -np.log(pieces.size))
    for _ in range(rounds):
        sent = spark.sparkContext.broadcast((pieces, log_p))
        summed = (
            in_batches(counted, lambda b: _expect(b, sent), "piece int, language int, n double")
            .groupBy("piece", "language")
            .agg(F.sum("n").alias("n"))
            .toArrow()
        )
        counts = np.zeros_like(log_p)
        counts[summed["piece"].to_numpy(), summed["language"].to_numpy()] = summed["n"].to_numpy()
        counts += smoothing
        log_p = np.log(counts / counts.sum(axis=0))
        sent.unpersist()
    return log_p


def _expect(batches: Iterator[pa.RecordBatch], sent):
    pieces, log_p = sent.value
    total = np.zeros_like(log_p)
    for batch in batches:
        words = batch.column(0).to_pylist()
        counts = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[1:]], axis=1)
        total += expected_counts(words, counts.astype(float), pieces, log_p)
    piece, language = np.nonzero(total)
    yield pa.RecordBatch.from_arrays(
        [pa.array(piece.astype(np.int32)), pa.array(language.astype(np.int32)), pa.array(total[piece, language])],
        names=["piece", "language", "n"],
    )


class _Scorer:
    def __init__(self, model: Model):
        self.model = model
        blocks = max(1, -(-len(model.languages) // 8))
        self.kept, self.step = max(1000, WORDS_KEPT // blocks), max(100, 5000 // blocks)
        self.clear()

    def clear(self) -> None:
        self.rows: dict[str, int] = {}
        self.table = np.zeros((0, len(self.model.languages)))

    def add(self, words: list[str]) -> None:
        at = len(self.rows)
        if at + len(words) > len(self.table):
            grown = np.zeros((2 * (at + len(words)), self.table.shape[1]))
            grown[:at] = self.table[:at]
            self.table = grown
        for i in range(0, len(words), self.step):
            part = words[i : i + self.step]
            self.table[at + i : at + i + len(part)] = word_scores(part, self.model.pieces, self.model.log_p)
        self.rows.update(zip(words, range(at, at + len(words))))

    def score(self, texts: list[str]) -> tuple[list[str], list[float]]:
        model = self.model
        if len(self.rows) > self.kept:
            self.clear()
        split = [t.split() if _LETTER.search(t) and model.languages else [] for t in texts]
        self.add(list(set(chain.from_iterable(split)).difference(self.rows)))
        names, scores = [], []
        get = self.rows.__getitem__
        for words in split:
            if not words:
                names.append(UNDETERMINED)
                scores.append(0.0)
                continue
            at = np.fromiter(map(get, words), np.int64, len(words))
            v = model.log_prior + self.table[at].sum(axis=0)
            best = int(np.argmax(v))  # of equal scores, the first label in order
            names.append(model.languages[best])
            scores.append(float(1 / np.exp(v - v[best]).sum()))
        return names, scores


def _predict(batches: Iterator[pa.RecordBatch], sent):
    scorer = _Scorer(sent.value)
    for batch in batches:
        names, scores = scorer.score([t or "" for t in batch.column(0).to_pylist()])
        columns = [*batch.columns[1:], pa.array(names, pa.string()), pa.array(scores, pa.float64())]
        yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[1:], "lang_pred", "score"])


def predict(
    docs: DataFrame,
    model: Model,
    text: str = "text",
    keep: list[str] | None = None,
    names: tuple[str, str] = ("lang_pred", "score"),
) -> DataFrame:
    """The kept columns of every row, with `lang_pred` and `score`, or what `names` calls them.

    Only the text is looked at. The score is the share of the predicted language in the probability of
    the text over all learned languages. Texts that are null, empty or without any letter get 'und' and
    0. Rows stay where they are, repeated rows included; an input column of either name gives
    way, any other stays as it is. Empty tables give no rows.
    """
    keep = [c for c in keep or docs.columns if c not in names]
    rows = docs.select(docs[f"`{text}`"].alias(unused(keep, "_text")), *[docs[f"`{c}`"] for c in keep])
    schema = T.StructType(
        [*rows.schema.fields[1:], T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType())]
    )
    sent = docs.sparkSession.sparkContext.broadcast(model)
    return mapped(rows, lambda b: _predict(b, sent), schema)


def held_out(doc_id: str = "doc_id") -> Column:
    remainder = F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(4))
    return F.coalesce(remainder == 2, F.lit(False))


def confident(docs: DataFrame, model: Model, text: str = "text", least: float = 0.5) -> DataFrame:
    """The rows, columns unchanged, whose language is known with at least the stated score.

    Input columns of any name stay as they are.
    """
    names = (unused(docs.columns, "lang_pred"), unused(docs.columns, "score"))
    scored = predict(docs, model, text, names=names)
    fine = scored.where((F.col(names[0]) != UNDETERMINED) & (F.col(names[1]) >= least))
    return fine.select(*quoted(docs.columns))


@query("op1_language")
def op1_language(spark: SparkSession, folder: str) -> DataFrame:
    """Language of every document; learned from the documents that are not held out."""
    docs = table(spark, folder, "documents")
    model = fit(docs.where(~held_out()))
    return predict(docs.withColumn("held_out", held_out()), model, keep=["doc_id", "held_out"])
