"""Token files, BPE, language ID: against the libraries and by definition."""

from __future__ import annotations

import hashlib
import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from panelwake.llm import bpe, language, token_files
from panelwake.llm.common import TOKENIZERS
from panelwake.llm.interning import Known, Rows, hash_runs, hash_words, split_at, text_bytes
from panelwake.session import scratch_path

ATOMS = [
    "the", "The", " ", "  ", "\n", "\t", "\r\n", "\x0b", "\x1c", "\x85", "\xa0", " ", "it's", "'", "''",
    "don't", "1", "23", "4²", "é", "é", "Σ", "İ", "ß", "...", ".", "-", "_",
    "<|endoftext|>", "<|startoftext|>", "<|", "日本", "\U0001f642", "ﬁ", "zz" * 200, "​", "\x00",
]


def odd_texts(n: int, seed: int) -> list[str]:
    r = random.Random(seed)
    return ["".join(r.choice(ATOMS) for _ in range(r.randrange(0, 14))) for _ in range(n)]


@pytest.mark.parametrize("name", ["byte_bpe_50k", "word_bpe_49k"])
def test_ids_equal_the_library(name):
    path = f"{TOKENIZERS}/{name}.json"
    made = bpe.Encoder(path) if name.startswith("byte") else token_files.WordEncoder(path)
    library = Tokenizer.from_file(path)
    texts = [*odd_texts(1500, 7), "", "x" * 50_000]
    for i in range(0, len(texts), 500):
        part = texts[i : i + 500]
        flat, sizes = made.encode(*text_bytes(pa.array(part)))
        ends = np.cumsum(sizes)
        for t, a, b, e in zip(part, ends - sizes, ends, library.encode_batch(part, add_special_tokens=False)):
            assert flat[a:b].tolist() == e.ids, repr(t)


def test_two_words_with_one_first_hash_are_told_apart():
    encoder = bpe.Encoder(f"{TOKENIZERS}/byte_bpe_50k.json")
    encoder.encode(*text_bytes(pa.array(["alpha beta"])))
    encoder.second[:] ^= np.uint64(1)  # as if the words kept were others
    flat, sizes = encoder.encode(*text_bytes(pa.array(["alpha beta", "gamma"])))
    want = Tokenizer.from_file(f"{TOKENIZERS}/byte_bpe_50k.json").encode("alpha beta").ids
    assert flat[: sizes[0]].tolist() == want


def test_bpe_rows(make):
    docs = make([(1, "It's here.\n"), (1, "It's here.\n"), (None, None), (3, ""), (4, "<|endoftext|>a")])
    rows = bpe.decode(bpe.encode(docs)).collect()
    assert len(rows) == 5
    assert sorted(r["decoded"] for r in rows) == ["", "", "<|endoftext|>a", "It's here.\n", "It's here.\n"]
    assert [r["ids"] for r in rows if r["doc_id"] == 4][0][0] == 50256
    assert bpe.digests(bpe.decode(bpe.encode(docs.limit(0)))).collect() == []


def test_known_words_grow_and_are_found():
    known, rows = Known(bits=4), Rows()
    keys = np.unique(np.random.default_rng(1).integers(1, 2**63, 500).astype(np.uint64))
    for part in np.array_split(keys, 7):
        known.add(part)
        rows.add(np.arange(len(part) * 2, dtype=np.int32), np.full(len(part), 2))
    assert (known.find(keys) == np.arange(len(keys))).all()
    assert known.find(keys + np.uint64(1)).max() == -1
    assert len(rows.gather(known.find(keys))[0]) == 2 * len(keys)


def test_word_hashes_depend_on_the_word_alone():
    raw = b"aa bb aa " + b"q" * 700 + b" " + b"q" * 700 + b" " + b"q" * 701
    data = np.frombuffer(raw, np.uint8)
    starts, sizes = split_at(data, np.array([0, len(raw)]), np.arange(256) != 32)
    h = hash_words(data, starts, sizes)[0].tolist()
    assert h[0] == h[2] != h[1] and h[3] == h[4] != h[5]


def test_run_hashes_depend_on_the_run_alone():
    r = np.random.default_rng(5)
    runs = [r.integers(97, 100, n).astype(np.uint8).tobytes() for n in [*range(1, 40), 2048, 2049, 5000] for _ in range(3)]
    runs += [runs[50], runs[-1], runs[-1][:-1], runs[-1] + b"a"]
    data = np.frombuffer(b"\n".join(runs), np.uint8)
    sizes = np.array([len(x) for x in runs])
    h = hash_runs(data, np.cumsum(sizes + 1) - sizes - 1, sizes)
    assert len(set(zip(runs, h.tolist()))) == len(set(runs)) == len(set(h.tolist()))
    alone = hash_runs(np.frombuffer(runs[50], np.uint8), np.array([0]), np.array([len(runs[50])]))
    assert alone[0] == h[50]


def test_token_files_read_back(lake, make):
    texts = [(5, "later words"), (None, "no id"), (2, None), (2, ""), (7, "The END <|endoftext|>"), (7, "The END <|endoftext|>")]
    path = scratch_path(lake, "t")
    token_files.write_token_files(make(texts), path)
    rows = token_files.read_tokens(lake, path).orderBy("part", "at").collect()
    assert [r["doc_id"] for r in rows] == [None, 2, 2, 5, 7, 7]
    library = Tokenizer.from_file(f"{TOKENIZERS}/word_bpe_49k.json")
    by_id = {i: [*library.encode(t or "", add_special_tokens=False).ids, 1] for i, t in texts}
    assert all(r["ids"] == by_id[r["doc_id"]] for r in rows)
    got = token_files.starts(token_files.checksums(token_files.read_tokens(lake, path)), token_files.read_tokens(lake, path, ["part", "n_tokens"]))
    at = 0
    for r in sorted(got.collect(), key=lambda r: r["start"]):
        ids = by_id[r["doc_id"]]
        assert (r["start"], r["n_tokens"]) == (at, len(ids))
        assert r["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
        at += len(ids)
    empty = scratch_path(lake, "t")
    token_files.write_token_files(make(texts).limit(0), empty)
    assert token_files.read_tokens(lake, empty).count() == 0


def test_token_files_have_dictionary_and_page_index(lake, make, tmp_path):
    import glob

    import pyarrow.parquet as pq

    path = str(tmp_path / "tokens")
    token_files.write_token_files(make([(i, "some words here " * 50) for i in range(50)]), path)
    meta = pq.ParquetFile(max(glob.glob(f"{path}/*.parquet"))).metadata.row_group(0)
    columns = {meta.column(i).path_in_schema: meta.column(i) for i in range(meta.num_columns)}
    assert any("DICTIONARY" in e for e in columns["ids.list.element"].encodings)
    assert any("DELTA" in e for e in columns["doc_id"].encodings)
    assert columns["doc_id"].has_column_index and columns["ids.list.element"].has_offset_index


def test_word_score_is_the_sum_over_all_segmentations():
    pieces = language.Pieces(["▁", "a", "b", "ab", "▁a", "ba", "bab"])
    r = np.random.default_rng(3)
    p = r.random((pieces.size, 2))
    names = ["▁", "a", "b", "ab", "▁a", "ba", "bab"]

    def total(text, lang):
        if not text:
            return 1.0
        out = sum(p[i, lang] * total(text[len(n) :], lang) for i, n in enumerate(names) if text.startswith(n))
        return out + (p[-1, lang] * total(text[1:], lang) if text[0] not in names else 0.0)

    words = ["", "a", "abab", "babab", "xaxb", "aaaaab"]
    got = language.word_scores(words, pieces, np.log(p))
    for w, row in zip(words, got):
        for lang in (0, 1):
            assert math.isclose(row[lang], math.log(total("▁" + w, lang)), rel_tol=1e-9)
    counts = language.expected_counts(["abab"], np.array([[1.0, 2.0]]), pieces, np.log(p))
    sizes = np.array([len(n) for n in names] + [1])
    assert np.allclose((counts * sizes[:, None]).sum(axis=0), [5.0, 10.0])  # every character once


def test_language_held_out_accuracy(lake, folder):
    docs = lake.read.parquet(f"{folder}/documents.parquet")
    model = language.fit(docs.where(~language.held_out()), docs_per_language=200)
    rows = language.predict(docs.withColumn("own", language.held_out()), model).where("own").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in rows) >= 0.97 * len(rows)


def test_language_edges(make):
    docs = make([(1, "the the and", "en"), (2, "der die das", "de"), (3, None, "en"), (4, "", None), (5, "12 ?!", "en"), (1, "the the and", "en"), (None, "und das die", None)])
    model = language.fit(docs)
    out = language.predict(docs, model)
    rows = out.collect()
    by = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in rows}
    assert len(rows) == 7 and by[1][0] == "en" and by[2][0] == by[None][0] == "de"
    assert by[3] == by[4] == by[5] == ("und", 0.0)
    assert all(0 <= r["score"] <= 1 for r in rows)
    assert set(docs.columns) == set(out.columns)  # clashing names give way
    assert language.confident(docs, model).count() == 4
    nothing = language.fit(docs.limit(0))
    assert {r["lang_pred"] for r in language.predict(docs, nothing).collect()} == {"und"}
    assert language.predict(docs.limit(0), model).collect() == []


def test_every_label_is_learned(make, monkeypatch):
    monkeypatch.setattr(language, "TOGETHER", 16)
    letters = "abcdefghijklmnopqrstuvwxyz"
    own = lambda i: " ".join(3 * [f"{letters[i % 26] * 3}{letters[i // 26] * 4}q"])
    docs = make([(i, own(i), f"l{i:02d}") for i in range(70)])
    model = language.fit(docs, rounds=2)
    assert model.languages == [f"l{i:02d}" for i in range(70)] and model.log_p.shape[1] == 70
    rows = language.predict(docs, model, names=("found", "sure")).collect()
    assert sum(r["found"] == r["lang"] for r in rows) >= 68
    alone = language.fit(docs.where("lang = 'l20'"), rounds=2)
    np.testing.assert_allclose(model.log_p[:, 20], alone.log_p[:, 0])


def test_digest_of_no_text(make):
    row = bpe.digests(bpe.decode(bpe.encode(make([(1, None)])))).first()
    assert row["n_tokens"] == 0 and row["ids_sha256"] == hashlib.sha256(b"").hexdigest()
