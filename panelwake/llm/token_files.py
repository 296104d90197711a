"""Token ids as Parquet list columns in ascending document order, with selective reads.

The ids column is dictionary encoded: a vocabulary is a small closed set, so an id costs at most its
bit width before compression. Monotone metadata (ids, positions, counts) is delta encoded. Row groups
and pages have stated sizes, and the writer adds page indexes, so a reader of a few documents or of
metadata alone skips the token pages.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelwake.llm.common import TOKENIZERS, only, partitions, query, table
from panelwake.llm.bpe import byte_alphabet
from panelwake.llm.interning import LONGEST, Known, Rows, hash_words, lowered, split_words, text_bytes, text_of, with_rows
from panelwake.session import scratch_path

#: Distinct words kept with their ids by one Python worker.
WORDS_KEPT = 2_000_000

_FILE_SCHEMA = "doc_id long, part int, at long, n_tokens long, ids array<int>"
_ARROW_SCHEMA = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("part", pa.int32()),
        ("at", pa.int64()),
        ("n_tokens", pa.int64()),
        ("ids", pa.list_(pa.int32())),
    ]
)


_BYTES = {b: c for c, b in byte_alphabet().items()}
_CASED_ODDLY = re.compile("[\u03a3\u0130]")  # lower case depends on what is around, or is two letters


class WordEncoder:
    """Ids of whole texts from a tokenizer that lowers case and never joins text across white space.

    Its word pattern also ends words between ASCII letters, digits and other signs, so texts are cut
    there and each distinct word, in lower case, goes to the library once while it is kept. Texts that
    hold one of the tokenizer's own control strings go to the library whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        controls = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.control = re.compile("|".join(map(re.escape, controls)).encode() or b"(?!)")
        self.clear()

    def clear(self) -> None:
        self.known, self.rows = Known(), Rows()
        self.second = np.zeros(0, np.uint64)

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        encoded = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, np.int32) for e in encoded]

    def words(self, words: list[bytes]) -> list[np.ndarray]:
        """Ids of words whose ASCII letters are lower case.

        A word of letters alone is one piece for the merges, which take it byte by byte; anything else
        goes through the library's normaliser and word pattern as well.
        """
        out: list[np.ndarray | None] = []
        merge = self.tokenizer.model.tokenize
        for w in words:
            letters = None
            if w.isalpha():  # ASCII letters
                letters = w.decode()
            elif w[0] >= 128 or w[-1] >= 128 or w[0] >= 97:
                text = w.decode()
                lower = text.lower()
                if text.isalpha() and not _CASED_ODDLY.search(text) and is_normalized("NFC", text) and is_normalized("NFC", lower):
                    letters = lower.encode().decode("latin-1").translate(_BYTES)
            out.append(None if letters is None else np.array([t.id for t in merge(letters)], np.int32))
        rest = [i for i, x in enumerate(out) if x is None]
        for i, ids in zip(rest, self.whole([words[i].decode() for i in rest])):
            out[i] = ids
        return out

    def _learn(self, data: bytes, starts, sizes, first, second) -> None:
        """Encode words not known yet; `first` and `second` are their hashes."""
        for i in range(0, len(starts), 5000):
            part = slice(i, i + 5000)
            cut = zip(starts[part].tolist(), sizes[part].tolist())
            words = [data[a : a + n] for a, n in cut]
            ids = self.words(words)
            self.rows.add(np.concatenate(ids), np.array([len(x) for x in ids]))
        self.second = np.append(self.second, second)
        self.known.add(first)

    def encode(self, raw: bytes, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and how many each text has."""
        if self.known.size > WORDS_KEPT:
            self.clear()
        data = lowered(np.frombuffer(raw, np.uint8))
        starts, sizes = split_words(data, offsets)
        short = sizes <= LONGEST
        at = np.full(len(starts), -1, np.int32)
        first, second = hash_words(data, starts[short], sizes[short])
        found = self.known.find(first)
        if (found < 0).any():
            new = np.flatnonzero(found < 0)
            new = new[np.unique(first[new], return_index=True)[1]]
            s, n = starts[short][new], sizes[short][new]
            self._learn(data.tobytes(), s, n, first[new], second[new])
            found = self.known.find(first)
        found[self.second[found] != second] = -1  # another word with the same first hash
        at[short] = found
        text = text_of(offsets, starts)
        alone = {int(t) for t in text[at < 0]}
        for m in self.control.finditer(raw):
            alone.add(int(text_of(offsets, np.array([m.start()]))[0]))
        if alone:
            use = ~np.isin(text, list(alone))
            at, text = at[use], text[use]
        flat, counts = self.rows.gather(at)
        per_text = np.bincount(text, counts, len(offsets) - 1).astype(np.int64)
        if alone:
            texts = [raw[offsets[t] : offsets[t + 1]].decode() for t in sorted(alone)]
            flat, per_text = with_rows(flat, per_text, dict(zip(sorted(alone), self.whole(texts))))
        return flat, per_text


@lru_cache(maxsize=1)
def _encoder(path: str) -> WordEncoder:
    """One per Python worker; tasks that follow in the same worker use its words again."""
    return WordEncoder(path)


def _encode_batches(batches: Iterator[pa.RecordBatch], path: str, end_id: int):
    encoder, at = _encoder(path), 0
    part = TaskContext.get().partitionId()
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        flat, sizes = encoder.encode(*text_bytes(batch.column("text")))
        flat = np.insert(flat, np.cumsum(sizes), np.int32(end_id))
        sizes = sizes + 1
        offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                pa.array(np.full(n, part, np.int32)),
                pa.array(np.arange(at, at + n, dtype=np.int64)),
                pa.array(sizes),
                pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)),
            ],
            schema=_ARROW_SCHEMA,
        )
        at += n


def write_token_files(
    docs: DataFrame,
    path: str,
    tokenizer: str = f"{TOKENIZERS}/word_bpe_49k.json",
    end_id: int = 1,
    doc_id: str = "doc_id",
    text: str = "text",
    row_group_bytes: int = 32 << 20,
    page_bytes: int = 256 << 10,
) -> None:
    """Encode whole texts and write them in ascending document order, one end id after each.

    Files are numbered in document order and rows are ordered inside a file; `part` and `at` say so in
    the data. Texts are range partitioned before they are encoded, so token lists never go through a
    shuffle. Null text: empty. Null ids come first; repeated ids are ordered by text, and rows that
    repeat in full are all written. An empty table gives files without rows.
    """
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    n = partitions(docs.sparkSession)
    rows = only(docs, doc_id=doc_id, text=text).select(F.col("doc_id").cast("long"), "text")
    ranged = rows.repartitionByRange(n, *order).sortWithinPartitions(*order)
    encoded = ranged.mapInArrow(lambda b: _encode_batches(b, tokenizer, end_id), _FILE_SCHEMA)
    options = {
        "compression": "zstd",
        "parquet.writer.version": "v2",
        "parquet.enable.dictionary": "false",
        "parquet.enable.dictionary#ids.list.element": "true",
        "parquet.dictionary.page.size": str(1 << 20),
        "parquet.block.size": str(row_group_bytes),
        "parquet.page.size": str(page_bytes),
    }
    encoded.write.options(**options).parquet(path)


def read_tokens(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """Rows of the token files; only the named columns' pages are read."""
    rows = spark.read.schema(_FILE_SCHEMA).parquet(path)
    return rows.select(*columns) if columns else rows


def starts(rows: DataFrame, meta: DataFrame) -> DataFrame:
    """`rows` of the token files with the place of each document's first id in the whole run of ids.

    Totals per file (as many rows as files) come from `meta`, a read of metadata pages alone; rows
    inside a file are summed up after them.
    """
    totals = meta.groupBy("part").agg(F.sum("n_tokens").alias("_total"))
    before = totals.select(
        "part", (F.sum("_total").over(W.orderBy("part")) - F.col("_total")).alias("_before")
    )
    inside = W.partitionBy("part").orderBy("at").rowsBetween(W.unboundedPreceding, 0)
    local = rows.withColumn("_upto", F.sum("n_tokens").over(inside))
    out = local.join(F.broadcast(before), "part")  # one row per file
    return out.withColumn("start", F.col("_before") + F.col("_upto") - F.col("n_tokens")).drop(
        "_before", "_upto"
    )


def _checksums(batches: Iterator[pa.RecordBatch]):
    for batch in batches:
        ids = batch.column("ids")
        flat = ids.values.to_numpy(zero_copy_only=False).astype("<u4")
        offsets = ids.offsets.to_numpy()
        sums = [zlib.crc32(flat[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
        keep = [batch.column(c) for c in ("doc_id", "part", "at")]
        sizes = pa.array(np.diff(offsets).astype(np.int64))
        yield pa.RecordBatch.from_arrays(
            [*keep, sizes, pa.array(sums, pa.int64())],
            names=["doc_id", "part", "at", "n_tokens", "ids_crc32"],
        )


def checksums(tokens: DataFrame) -> DataFrame:
    """Length and unsigned CRC-32 of each row's ids as little-endian 32-bit numbers."""
    schema = "doc_id long, part int, at long, n_tokens long, ids_crc32 long"
    return tokens.select("doc_id", "part", "at", "ids").mapInArrow(_checksums, schema)


@query("op8_token_files")
def op8_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's place, length and checksum, from the token files read back."""
    path = scratch_path(spark, "tokens")
    write_token_files(table(spark, folder, "documents"), path)
    rows = starts(checksums(read_tokens(spark, path)), read_tokens(spark, path, ["part", "n_tokens"]))
    return rows.select("doc_id", "start", "n_tokens", "ids_crc32")
