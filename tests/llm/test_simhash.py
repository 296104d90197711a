"""SimHash components against brute force, crowded posting lists, and edges."""

from __future__ import annotations

import random

import numpy as np
import pytest
import xxhash

from panelwake.llm import simhash
from panelwake.llm.common import QUERIES, table

from .conftest import words
from .test_copies import closed, edited


def plain_print(text):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        w = w.replace(c, " ")
    w = [x for x in w.split(" ") if x]
    if not w:
        return 0
    hs = [xxhash.xxh64(" ".join(w[i : i + 4]).encode(), seed=42).intdigest() for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def plain_components(rows, distance=4):
    prints = [plain_print(t) for _, t in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= distance]
    of = closed(len(rows), links)
    ids = {}
    for (d, _), c in zip(rows, of):
        if d is not None:
            ids[c] = min(d, ids.get(c, d))
    return sorted(((d, f"{p:016x}", ids.get(c)) for (d, _), p, c in zip(rows, prints, of)), key=str)


def got(df):
    return sorted((tuple(r) for r in df.select("doc_id", "fingerprint", "component_id").collect()), key=str)


@pytest.mark.parametrize("distance", [0, 2, 4])
def test_equal_to_brute_force(make, distance):
    base = words(150, 3)
    texts = [edited(base, 0.004 * (i % 6), i) for i in range(120)] + [words(80, 500 + i) for i in range(40)]
    texts += [base, base.upper(), "a b", "A  b", "a b c d", "a\tb\nc d", "", None, " \n ", "Ä x   y", "x" * 100_000]
    rows = [(1000 - i, t) for i, t in enumerate(texts)]
    rows += [(7, base), (7, "a b"), (None, base), (None, "alone and without an id"), (1000, texts[0])]
    assert got(simhash.simhash_components(make(rows), distance=distance)) == plain_components(rows, distance)


def test_empty_table(make):
    df = simhash.simhash_components(make([]))
    assert df.columns == ["doc_id", "fingerprint", "component_id"] and df.count() == 0


def test_distance_outside_the_guarantee(make):
    with pytest.raises(ValueError):
        simhash.simhash_components(make([]), distance=5)


def test_masks():
    assert [len(simhash.byte_masks(n)) for n in (4, 5, 6)] == [70, 56, 28]
    for n, halves, lists in ((4, 4, 16), (5, 2, 12)):
        for m in simhash.byte_masks(n):
            longer = simhash.half_masks(m, halves)
            assert len(set(longer)) == lists and all(x.bit_count() == 48 and x & m == m for x in longer)


@pytest.mark.parametrize("limit", [4, 40])
def test_crowded_lists_lose_nothing(lake, monkeypatch, limit):
    """Fingerprints around a few centres, so that lists of all kinds are longer than the limit."""
    monkeypatch.setattr(simhash, "LIST", limit)
    r = random.Random(limit)
    prints = set()
    for _ in range(3):
        centre = r.getrandbits(64)
        for _ in range(250):
            x = centre
            for _ in range(r.randint(0, 9)):
                x ^= 1 << r.randrange(64)
            prints.add(x)
    prints = sorted(prints)
    df = lake.createDataFrame([(simhash._signed(p),) for p in prints], "print long")
    found = {(row["a"], row["b"]) for row in simhash.links(df).collect()}
    at = {simhash._signed(p): i for i, p in enumerate(prints)}
    assert all((a ^ b) & (2**64 - 1) for a, b in found)
    pairs = [(i, j) for i in range(len(prints)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 4]
    assert len(pairs) > 100
    assert closed(len(prints), [(at[a], at[b]) for a, b in found]) == closed(len(prints), pairs)


def test_full_lists_of_48_equal_bits():
    """One long list: every neighbour is found, and few links stand for all."""
    import pyarrow as pa

    values = np.arange(3000, dtype=np.int64)
    batch = pa.RecordBatch.from_arrays([pa.array([values.tolist()], pa.list_(pa.int64()))], names=["prints"])
    (out,) = simhash._list_links(iter([batch]), 4)
    assert out.num_rows == 2999


def test_query_over_the_whole_table(lake, folder):
    rows = [(r["doc_id"], r["text"]) for r in table(lake, folder, "documents").collect()]
    assert got(QUERIES["op13_simhash"](lake, folder)) == plain_components(rows)
