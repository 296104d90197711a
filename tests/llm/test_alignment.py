"""Token alignment against both libraries and a plain walk over bytes."""

from __future__ import annotations

import hashlib
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from panelwake.llm import alignment
from panelwake.llm.bpe import Vocabulary, byte_alphabet
from panelwake.llm.common import QUERIES, table

from .conftest import words

A = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
A.encode_special_tokens = True
B = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
LETTERS = byte_alphabet()


def ranges(ids, spelled):
    out, at = [], 0
    for i, s in zip(ids, spelled):
        out.append((i, at, at + len(s)))
        at += len(s)
    return out, b"".join(spelled)


def piece_bytes(i):
    p = B.id_to_piece(i)
    return bytes([int(p[3:5], 16)]) if B.is_byte(i) else p.replace("▁", " ").encode()


def plain(rows):
    parsed, held = [], Counter()
    for doc_id, text in rows:
        groups, links, n_a, n_b = [], [], 0, 0
        if text:
            ids = A.encode(" " + text, add_special_tokens=False).ids
            a, joined_a = ranges(ids, [bytes(LETTERS[c] for c in A.id_to_token(i)) for i in ids])
            ids = B.encode(text)
            b, joined_b = ranges(ids, [piece_bytes(i) for i in ids])
            if joined_a == joined_b == (" " + text).encode():
                n_a, n_b = len(a), len(b)
                ends = sorted({e for *_, e in a} & {e for *_, e in b})
                for s, e in zip([0, *ends], ends):
                    inside = lambda ts: [t for t in ts if s <= t[1] and t[2] <= e]
                    x, y = inside(a), inside(b)
                    groups.append(",".join(str(t[0]) for t in x) + "|" + ",".join(str(t[0]) for t in y))
                    links += [(i[0], j[0]) for i in x for j in y if i[1] < j[2] and j[1] < i[2]]
        held.update(set(links))
        parsed.append((doc_id, n_a, n_b, groups, links))
    most = Counter()
    for (a, _), n in held.items():
        most[a] = max(most[a], n)
    return sorted(
        (
            (
                d,
                n_a,
                n_b,
                len(groups),
                len(links),
                sum(held[x] == most[x[0]] for x in links),
                sum(held[x] for x in links),
                hashlib.sha256(";".join(groups).encode()).hexdigest() if n_a else "",
            )
            for d, n_a, n_b, groups, links in parsed
        ),
        key=str,
    )


def got(df):
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    return sorted((tuple(r) for r in df.select(*names).collect()), key=str)


ODD = [
    "", None, " ", "  ", "\n", "a", "a  b\tc\n\nd ", " lead", "ﬁ ² é é ＡＢ", "▁x y", "x ▁",
    "<|endoftext|> and <s> </s> <unk>", "日本語 text 😀 😀", " nbsp em", "\x00zero \x7f", "it's 12,345.67 don't",
    "word " * 3000, "x" * 5000, "a" + " " * 40 + "b",
]


def test_equal_to_plain_walk(make):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(100 + i, words(60, i % 20)) for i in range(40)]
    rows += [(None, "a b"), (3, "again"), (3, "again"), (4, words(30, 2).upper())]
    assert got(alignment.digests(make(rows))) == plain(rows)


def test_counts_in_several_passes(make):
    rows = [(i, words(50, i)) for i in range(30)]
    aligned = alignment._stored_sorted(alignment.align(make(rows)))
    bits = alignment.pair_bits(B.get_piece_size())
    counted = alignment.with_counts(aligned, bits, sent=100)
    got_sums = {r["doc_id"]: (r["n_best"], r["count_sum"]) for r in counted.collect()}
    assert got_sums == {r[0]: (r[5], r[6]) for r in plain(rows)}


def test_kept_windows_do_not_change_results():
    import pyarrow as pa

    texts = [words(40, i % 7) for i in range(30)]
    once = alignment.Aligner("byte_bpe_50k.json", "piece_bpe_32k.model")
    whole = once.align(pa.array(texts))
    assert 0 < len(once.numbers) < 7 * 40
    again = once.align(pa.array(texts))
    assert whole[4] == again[4] and (whole[5] == again[5]).all()
    once.clear()
    assert once.align(pa.array(texts))[4] == whole[4]


@pytest.mark.parametrize("rows", [[], [(1, None)], [(None, "")]])
def test_nothing_to_align(make, rows):
    assert got(alignment.digests(make(rows))) == [(d, 0, 0, 0, 0, 0, 0, "") for d, _ in rows]


def test_query_over_the_whole_table(lake, folder):
    rows = [(r["doc_id"], r["text"]) for r in table(lake, folder, "documents").collect()]
    assert got(QUERIES["op11_alignment"](lake, folder)) == plain(rows)


def test_words_by_the_librarys_merges():
    """Words are cut no further, and strings of special tokens are plain letters."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    said = [" the", "aligning", "<|endoftext|>", "é", "日本語", " " * 9, "x" * 300, "don't", "12,345", "\x00", "😀"]
    raw = [s.encode() for s in said]
    assert {k: tuple(v) for k, v in alignment._Merges(path)(iter(raw)).items()} == Vocabulary(path).encode_words(raw)
