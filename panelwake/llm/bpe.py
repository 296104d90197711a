"""Byte-level BPE by last-token states over a trie of distinct words.

The encoding of a word ends in one certain token for each of its prefixes, and what comes before that
token is the encoding of a shorter prefix. So a node of the trie needs one number, the last token of
the path so far; words that share a prefix share those nodes. Sorted words are the trie's depth-first
order, and the current path is a stack cut back to the common prefix of each word with the one before.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwake.llm.common import TOKENIZERS, only, query, sha, table
from panelwake.llm.interning import Known, Rows, hash_words, split_spaced, text_bytes, text_of, with_rows

#: Distinct words kept with their ids by one Python worker.
WORDS_KEPT = 300_000
#: Pairs of tokens whose verdict is kept.
PAIRS_KEPT = 150_000

# white space beyond ASCII, as UTF-8; texts that hold any are cut by the full pattern
_RARE_BYTES = re.compile(rb"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")

# fixed values: the word pattern of the public vocabulary file
_PIECE = regex.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
)


def byte_alphabet() -> dict[str, int]:
    """Printable stand-ins of the 256 bytes in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    odd = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(odd)}


class Vocabulary:
    """Tokens as bytes, merge ranks, and the special tokens of a tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        letters = byte_alphabet()
        raw = lambda s: bytes(letters[c] for c in s)
        vocab = data["model"]["vocab"]
        self.ids = {raw(s): i for s, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        size = max([*self.ids.values(), *self.special.values()]) + 1
        self.bytes: list[bytes] = [b""] * size
        for b, i in self.ids.items():
            self.bytes[i] = b
        for s, i in self.special.items():
            self.bytes[i] = s.encode()
        self.ranks: dict[tuple[int, int], int] = {}
        self.merged: dict[tuple[int, int], int] = {}
        for rank, pair in enumerate(data["model"]["merges"]):
            left, right = (raw(s) for s in (pair if isinstance(pair, list) else pair.split(" ")))
            key = (self.ids[left], self.ids[right])
            self.ranks[key] = rank
            self.merged[key] = self.ids[left + right]
        self.longest = max(map(len, self.ids))
        self._spines: dict[int, tuple[list, list] | None] = {}
        self._pairs: dict[int, bool] = {}
        self._alone: dict[int, bool] = {}

    def _history(self, token: int):
        """How merges build a token: pieces at its left and at its right edge, each with the rank of
        the merge that ends it; None if merging the token's bytes does not give the token."""
        if token not in self._spines:
            parts = [self.ids[bytes([b])] for b in self.bytes[token]]
            left, right = [], []
            while len(parts) > 1:
                ranked = [(self.ranks.get(p, 1 << 60), i) for i, p in enumerate(zip(parts, parts[1:]))]
                rank, i = min(ranked)
                if rank == 1 << 60:
                    break
                if i == 0:
                    left.append((parts[0], rank))
                if i == len(parts) - 2:
                    right.append((parts[-1], rank))
                parts[i : i + 2] = [self.merged[parts[i], parts[i + 1]]]
            end = (parts[0], 1 << 60)
            self._spines[token] = ([*left, end], [*right, end]) if parts == [token] else None
        return self._spines[token]

    def alone(self, token: int) -> bool:
        """Merging the token's bytes gives the token back."""
        if token not in self._alone:
            self._alone[token] = self._history(token) is not None
        return self._alone[token]

    def follows(self, first: int, second: int) -> bool:
        """Merging the bytes of both gives just these two tokens.

        That holds if no merge across the border comes up before one of its two pieces is merged
        away from it. Of equal ranks the leftmost is merged first.
        """
        key = first << 24 | second
        known = self._pairs.get(key)
        if known is None:
            known = self._pairs[key] = self._meet(first, second)
        return known

    def _meet(self, first: int, second: int) -> bool:
        if not (self.alone(first) and self.alone(second)):
            return False
        pieces, others = self._history(first)[1], self._history(second)[0]
        i = j = 0
        while True:
            (a, a_until), (b, b_until) = pieces[i], others[j]
            rank = self.ranks.get((a, b))
            if rank is not None and rank < a_until and rank <= b_until:
                return False
            if a_until == b_until == 1 << 60:
                return True
            if a_until <= b_until:
                i += 1
            else:
                j += 1

    def encode_words(self, words: Iterator[bytes]) -> dict[bytes, tuple[int, ...]]:
        """Ids of distinct words, each shared prefix computed once."""
        out: dict[bytes, tuple[int, ...]] = {}
        ids, longest, follows, alone = self.ids, self.longest, self.follows, self.alone
        last: list[int] = []  # last[i]: last token of the path's first i + 1 bytes
        before = b""
        for word in sorted(words):
            shared, limit = 0, min(len(word), len(before), len(last))
            while shared < limit and word[shared] == before[shared]:
                shared += 1
            del last[shared:]
            for end in range(shared + 1, len(word) + 1):
                for start in range(max(0, end - longest), end):
                    token = ids.get(word[start:end])
                    if token is None:
                        continue
                    if follows(last[start - 1], token) if start else alone(token):
                        last.append(token)
                        break
            found, end = [], len(word)
            while end:
                found.append(last[end - 1])
                end -= len(self.bytes[found[-1]])
            out[word] = tuple(reversed(found))
            before = word
        if len(self._pairs) > PAIRS_KEPT:
            self._pairs.clear()
        return out


class Encoder:
    """A worker's vocabulary and the words it has met; tasks that follow use them again."""

    def __init__(self, path: str):
        self.vocabulary = Vocabulary(path)
        names = sorted(self.vocabulary.special, key=len, reverse=True)
        self.cut = re.compile("|".join(map(re.escape, names)) or "(?!)")
        self.cut_bytes = re.compile(self.cut.pattern.encode())
        sizes = np.array([len(b) for b in self.vocabulary.bytes])
        self.spelled = Rows(np.uint8)
        self.spelled.add(np.frombuffer(b"".join(self.vocabulary.bytes), np.uint8), sizes)
        self.clear()

    def clear(self) -> None:
        self.known, self.rows, self.second = Known(bits=20), Rows(), np.zeros(0, np.uint64)

    def _words(self, words: list[bytes]) -> list[tuple[int, ...]]:
        """Ids of chunks of text that the word pattern may cut further."""
        pieces = []
        for w in words:
            plain = w[1:] if w[:1] == b" " else w
            pieces.append([w] if plain.isalpha() else [p.encode() for p in _PIECE.findall(w.decode())])
        ids = self.vocabulary.encode_words(set(chain.from_iterable(pieces)))
        return [ids[ps[0]] if len(ps) == 1 else tuple(chain.from_iterable(map(ids.get, ps))) for ps in pieces]

    def whole(self, text: str) -> np.ndarray:
        """Ids of a text, control strings and rare white space included."""
        out, at = [], 0
        for m in self.cut.finditer(text):
            out += [*self._plain(text[at : m.start()]), self.vocabulary.special[m[0]]]
            at = m.end()
        return np.array([*out, *self._plain(text[at:])], np.int32)

    def _plain(self, text: str) -> list[int]:
        pieces = [p.encode() for p in _PIECE.findall(text)]
        ids = self.vocabulary.encode_words(set(pieces))
        return list(chain.from_iterable(map(ids.get, pieces)))

    def encode(self, raw: bytes, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and how many each text has."""
        if self.known.size > WORDS_KEPT:
            self.clear()
        starts, sizes = split_spaced(np.frombuffer(raw, np.uint8), offsets)
        first, second = hash_words(np.frombuffer(raw, np.uint8), starts, sizes)
        at = self.known.find(first)
        if (at < 0).any():
            new = np.flatnonzero(at < 0)
            new = new[np.unique(first[new], return_index=True)[1]]
            cut = zip(starts[new].tolist(), sizes[new].tolist())
            ids = self._words([raw[a : a + n] for a, n in cut])
            lengths = np.fromiter(map(len, ids), np.int64, len(ids))
            self.rows.add(np.fromiter(chain.from_iterable(ids), np.int32, int(lengths.sum())), lengths)
            self.known.add(first[new])
            self.second = np.append(self.second, second[new])
            at = self.known.find(first)
        text = text_of(offsets, starts)
        # words that share a first hash with another, control strings, rare white space
        alone = set(text[self.second[at] != second].tolist())
        for m in chain(self.cut_bytes.finditer(raw), _RARE_BYTES.finditer(raw)):
            alone.add(int(text_of(offsets, np.array([m.start()]))[0]))
        if alone:
            use = ~np.isin(text, list(alone))
            at, text = at[use], text[use]
        flat, counts = self.rows.gather(at)
        per_text = np.bincount(text, counts, len(offsets) - 1).astype(np.int64)
        if alone:
            texts = {t: self.whole(raw[offsets[t] : offsets[t + 1]].decode()) for t in sorted(alone)}
            flat, per_text = with_rows(flat, per_text, texts)
        return flat, per_text

    def decode(self, ids: np.ndarray, sizes: np.ndarray) -> pa.Array:
        """Texts of ids that stand in a row, `sizes` of them each."""
        data, lengths = self.spelled.gather(ids)
        ends = np.concatenate([[0], np.cumsum(lengths)])[np.concatenate([[0], np.cumsum(sizes)])]
        raw = data.tobytes()
        texts = [raw[a:b].decode("utf-8", "replace") for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
        return pa.array(texts, pa.string())


@lru_cache(maxsize=2)
def _encoder(path: str) -> Encoder:
    return Encoder(path)


def _encode_batches(batches: Iterator[pa.RecordBatch], path: str):
    encoder = _encoder(path)
    for batch in batches:
        flat, sizes = encoder.encode(*text_bytes(batch.column(1)))
        offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
        column = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
        yield pa.RecordBatch.from_arrays([batch.column(0), column], names=["doc_id", "ids"])


def _decode_batches(batches: Iterator[pa.RecordBatch], path: str):
    encoder = _encoder(path)
    for batch in batches:
        ids = batch.column("ids")
        sizes = np.diff(ids.offsets.to_numpy())
        decoded = encoder.decode(ids.flatten().to_numpy(), sizes)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), ids, decoded], names=["doc_id", "ids", "decoded"]
        )


def encode(
    docs: DataFrame,
    vocabulary: str = f"{TOKENIZERS}/byte_bpe_50k.json",
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """(doc_id, ids) for every row: the ids of the whole text.

    Rows stay where they are; there is no shuffle. Null and empty texts have no ids; strings of special
    tokens in a text become those tokens. Repeated rows and null ids come back as they went in.
    """
    rows = only(docs, doc_id=doc_id, text=text).select(F.col("doc_id").cast("long"), "text")
    return rows.mapInArrow(lambda b: _encode_batches(b, vocabulary), "doc_id long, ids array<int>")


def decode(encoded: DataFrame, vocabulary: str = f"{TOKENIZERS}/byte_bpe_50k.json") -> DataFrame:
    """(doc_id, ids, decoded): the text of the ids, special tokens included."""
    schema = "doc_id long, ids array<int>, decoded string"
    rows = encoded.select("doc_id", "ids")
    return rows.mapInArrow(lambda b: _decode_batches(b, vocabulary), schema)


def digests(decoded: DataFrame) -> DataFrame:
    return decoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        sha(F.array_join(F.col("ids").cast("array<string>"), ",")).alias("ids_sha256"),
        sha(F.col("decoded")).alias("decoded_sha256"),
    )


@query("op4_bpe")
def op4_bpe(spark: SparkSession, folder: str) -> DataFrame:
    """Every document encoded and decoded again, as digests."""
    return digests(decode(encode(table(spark, folder, "documents"))))
