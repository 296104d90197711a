"""A training-corpus pipeline: language ID, line dedup, near-dedup, decontamination, BPE."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwake.llm import bpe, decontaminate, language, line_dedup, near_dup
from panelwake.llm.common import prepared, quoted, stored, table, unused

BROADCAST_ROWS = 500_000


def _without(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows whose (doc_id, hash of text) is not among the keys; a null id matches a null id."""
    key, h = unused(docs.columns, "_id"), unused(docs.columns, "_h")
    keys = stored(keys.distinct().toDF(key, h), "dropped")
    small = F.broadcast(keys) if keys.count() <= BROADCAST_ROWS else keys
    same = docs["doc_id"].eqNullSafe(F.col(key)) & (F.xxhash64(docs["text"]) == F.col(h))
    return docs.join(small, same, "left_anti")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language; those without letters or without a clear language go.

    Null and empty texts have no letters. Rows that repeat share their fate. Columns of any name stay as
    they are. An empty table, or one without labels, gives no rows.
    """
    prepared(spark)
    return language.confident(docs, language.fit(docs))


def line_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Alike lines once in the corpus; documents left with nothing but blanks by it go.

    Null texts, and rows without doc_id, stay as they are. Of lines that tie, the one with the smallest
    (doc_id, text, number) stays; rows that repeat in full are cut alike. `n_chars`, where there is one,
    follows the text; columns of any other name stay as they are. An empty table gives no rows.
    """
    prepared(spark)
    counts = (unused(docs.columns, "lines"), unused(docs.columns, "lines_removed"))
    cut = line_dedup.dedup_lines(docs, counts=counts)
    left = cut.where((F.col(counts[1]) == 0) | F.col("text").rlike(r"\S"))
    if "n_chars" in docs.columns:
        left = left.withColumn("n_chars", F.length("text").cast("long"))
    return left.select(*quoted(docs.columns))


def near_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest id, of each group of near copies.

    Rows without doc_id, and null and empty texts, stay. A row goes by its id and its text, so another
    text under the same id is judged by itself; rows of one id that are near copies of each other stay
    together. Columns of any name stay as they are. An empty table gives no rows.
    """
    prepared(spark)
    found = near_dup.near_duplicates(docs, percent=80)
    return _without(docs, found.where(~F.col("kept")).select("doc_id", "h"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which benchmark passages are less than a twentieth.

    Null and empty texts have no words and stay. Rows that repeat share their fate, a null id included.
    Columns of any name stay as they are. An empty table gives no rows; an empty benchmark removes none.
    """
    prepared(spark)
    judged = decontaminate.judge(docs, table(spark, sf_dir, "benchmark"))
    return _without(docs, judged.where("contaminated").select("doc_id", "h"))


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and a digest of the text they decode to.

    One row per input row, repeated rows included; null and empty texts have no ids and the digest of the
    empty text. Other columns are left out. An empty table gives no rows.
    """
    prepared(spark)
    decoded = bpe.decode(bpe.encode(docs))
    return decoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        "ids",
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


STAGES = [
    ("language ID", language_id),
    ("line dedup", line_deduplication),
    ("MinHash near-dedup", near_deduplication),
    ("benchmark decontamination", decontamination),
    ("BPE encoding and decoding", bpe_encoding),
]

#: SQL cannot say language scores and token ids.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each reads what the one before has written."""
    out = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        out = stage(spark, out, sf_dir)
        if i < len(STAGES) - 1:
            out = stored(out, f"stage-{i + 1}")
    return out
