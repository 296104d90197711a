"""Columns and ids of the user stay theirs, through the operators and through all stages."""

from __future__ import annotations

import tempfile

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from panelwake.llm import language, line_dedup, near_dup
from panelwake.llm.common import unused

from .conftest import words

OTHERS = [
    "score", "lang_pred", "_kept", "kept", "lines", "lines_removed", "_lines", "_id", "_h", "h", "_gone", "_gone_id",
    "_gone_h", "gone", "_n", "n", "_cut", "_text", "name", "rep", "cluster", "component_id", "node", "a.b", "_Score",
]


@pytest.fixture(scope="module")
def table(lake):
    """Rows of (doc_id, text) with a column of every internal name, each with a value of its own."""

    def build(rows):
        fields = ", ".join(["doc_id long", "text string", "lang string", "source string", "n_chars long", *[f"`{c}` string" for c in OTHERS]])
        full = [(i, t, "en", "s", len(t or ""), *[f"{c} of {i}" for c in OTHERS]) for i, t in rows]
        return lake.createDataFrame(full, fields)

    return build


@pytest.fixture(scope="module")
def base(lake):
    folder = tempfile.mkdtemp(prefix="bench-")
    item = lake.createDataFrame([(1, words(30, 7))], "item_id long, text string")
    item.write.parquet(f"{folder}/benchmark.parquet")
    return folder


def theirs(df) -> dict:
    return {(r["doc_id"], r["text"]): [r[c] for c in OTHERS] for r in df.collect()}


def test_unused_names():
    assert unused(["a"], "b") == "b"
    assert unused(["_B", "b"], "b") == "__b"


def test_every_stage_leaves_columns_as_they_are(lake, table, base):
    rows = [(i, "\n".join([words(20, 200 + i), words(25, 600 + i)])) for i in range(12)]
    docs = table(rows)
    before = {i: [f"{c} of {i}" for c in OTHERS] for i, _ in rows}
    for _, stage in corpus_pipeline.STAGES[:4]:
        docs = stage(lake, docs, base)
        assert docs.columns[5:] == OTHERS
        got = docs.select("doc_id", *[F.col(f"`{c}`") for c in OTHERS]).collect()
        assert {r[0]: list(r)[1:] for r in got} == before
    last = corpus_pipeline.STAGES[4][1](lake, docs, base)
    assert {r["doc_id"] for r in last.collect()} == set(before)


def test_operators_with_results_of_the_same_name(table):
    docs = table([(1, words(30, 1)), (2, words(30, 2)), (3, None), (4, "")])
    model = language.fit(docs)
    assert theirs(language.confident(docs, model)).keys() == {(1, words(30, 1)), (2, words(30, 2))}
    said = language.predict(docs, model)
    assert said.columns.count("score") == 1 and dict(said.dtypes)["score"] == "double"
    cut = line_dedup.dedup_lines(docs)
    assert dict(cut.dtypes)["lines"] == "bigint" and cut.count() == 4
    named = line_dedup.dedup_lines(docs, counts=("n_all", "n_gone"))
    assert theirs(named) == theirs(docs) and {r["n_gone"] for r in named.collect()} == {0}


def test_one_id_with_two_texts(lake, table):
    """A text under an id that another text shares is neither linked by it nor dropped with it."""
    a, b = words(80, 21), words(80, 22)
    docs = table([(1, a), (2, a + " end"), (2, b), (3, b + " end"), (4, words(80, 23))])
    got = {(r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in near_dup.near_duplicates(docs).collect()}
    assert {(i, c, k) for i, _, c, k in got} == {(1, 1, True), (2, 1, False), (2, 2, True), (3, 2, False), (4, 4, True)}
    left = corpus_pipeline.near_deduplication(lake, docs, "")
    assert {(r["doc_id"], r["text"]) for r in left.collect()} == {(1, a), (2, b), (4, words(80, 23))}


def test_repeated_rows_in_stages(lake, table, base):
    a = words(60, 31)
    docs = table([(1, a), (1, a), (2, a + " end"), (None, words(60, 32)), (None, None)])
    left = corpus_pipeline.near_deduplication(lake, docs, base)
    assert sorted((r["doc_id"] or 0) for r in left.collect()) == [0, 0, 1, 1]
    clean = corpus_pipeline.decontamination(lake, table([(5, words(30, 7)), (5, a), (None, words(30, 7))]), base)
    assert [(r["doc_id"], r["text"]) for r in clean.collect()] == [(5, a)]


def test_all_stages_of_nothing(lake, table, base):
    out = table([])
    for _, stage in corpus_pipeline.STAGES:
        out = stage(lake, out, base)
        assert out.collect() == []
