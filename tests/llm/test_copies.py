"""Near-duplicates, repeats, line dedup, decontamination: brute force and edges."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from panelwake.llm import decontaminate, line_dedup, near_dup, repeats
from panelwake.llm.components import components

from .conftest import words


def closed(n, links):
    to = list(range(n))

    def find(x):
        while to[x] != x:
            x = to[x]
        return x

    for a, b in links:
        to[max(find(a), find(b))] = min(find(a), find(b))
    return [find(i) for i in range(n)]


def edited(text: str, share: float, seed: int) -> str:
    r = random.Random(seed)
    return " ".join(w if r.random() > share else words(1, seed * 1000 + i) for i, w in enumerate(text.split()))


@pytest.mark.parametrize("edges", [[], [(1, 1), (None, 2)], [(i, i + 1) for i in range(60)], [(0, i) for i in range(1, 40)] + [(50, 51), (51, 52), (52, 50)]])
def test_components(lake, edges):
    got = {r["node"]: r["component"] for r in components(lake.createDataFrame(edges, "x long, y long")).collect()}
    real = [(a, b) for a, b in edges if a is not None and b is not None and a != b]
    want = closed(100, real)
    assert got == {x: want[x] for e in real for x in e}


def shingles(text, k=5):
    w = [x.lower() for x in (text or "").replace("\n", " ").split(" ") if x]
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


@pytest.mark.parametrize("percent", [80, 85])
def test_near_duplicates_equal_brute_force(make, percent):
    base = words(120, 1)
    texts = [edited(base, 0.03 * (i % 4), i) for i in range(150)] + [words(90, 200 + i) for i in range(40)]
    texts += [base, base.upper(), "a b", "A  b", "a b c", "", None, " \n "]
    docs = [(1000 - i, t) for i, t in enumerate(texts)]
    order = sorted(docs)
    sets = [shingles(t) for _, t in order]
    links = [
        (i, j)
        for i in range(len(order))
        for j in range(i)
        if sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])
    ]
    want = closed(len(order), links)
    got = {r["doc_id"]: r for r in near_dup.near_duplicates(make(docs), percent=percent).collect()}
    for i, (doc_id, _) in enumerate(order):
        r = got[doc_id]
        assert (r["n_shingles"], r["component_id"]) == (len(sets[i]), order[want[i]][0]), doc_id
        assert r["kept"] == (doc_id == r["component_id"])


def test_large_nodes_branch_and_large_clusters_are_cut(make, monkeypatch):
    monkeypatch.setattr(near_dup, "NODE", 8)
    monkeypatch.setattr(near_dup, "CLUSTER", 16)
    base = words(200, 5)
    docs = [(i, edited(base, 0.01, i)) for i in range(80)] + [(100 + i, base + " " + words(60, 300 + i)) for i in range(30)]
    got = {r["doc_id"]: r["component_id"] for r in near_dup.near_duplicates(make(docs)).collect()}
    sets = [shingles(t) for _, t in docs]
    links = [(i, j) for i in range(len(docs)) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    want = closed(len(docs), links)
    assert got == {docs[i][0]: docs[want[i]][0] for i in range(len(docs))}


def test_near_duplicate_edges(make):
    t = words(30, 9)
    rows = near_dup.near_duplicates(make([(None, t), (5, t), (5, t), (9, t + " " + "y" * 200_000)])).collect()
    assert sorted((r["doc_id"] or 0, r["component_id"], r["kept"]) for r in rows if r["doc_id"] != 9) == [(0, None, True), (5, 5, True), (5, 5, True)]
    assert near_dup.near_duplicates(make([])).collect() == []


def brute_repeats(docs):
    low = {}
    raw = [(i, (t or "").encode()) for i, t in docs]
    for i, b in raw:
        for p in range(len(b) - 49):
            s = b[p : p + 50]
            low[s] = min(low.get(s, i), i)
    out = {}
    for i, b in raw:
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - 49):
            if low[b[p : p + 50]] < i:
                gone[p : p + 50] = True
        out[i] = (len(b), bytes(np.frombuffer(b, np.uint8)[~gone]), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()))
    return out


@pytest.mark.parametrize("together", [2000, 3, 0])
def test_repeats_equal_brute_force(make, together):
    r = random.Random(4)
    passages = [words(n, 50 + n) for n in (9, 12, 20, 40, 80)]
    docs = []
    for i in range(60):
        parts = [r.choice([*passages, words(15, 900 + i), r.choice(passages)[3:], "ab" * 40, "é" * 30]) for _ in range(r.randint(0, 5))]
        docs.append((i * 3, "\n".join(parts)))
    docs += [(500, docs[7][1]), (501, docs[7][1][1:-1]), (502, None), (503, "x" * 5000), (504, "x" * 49), (505, "x" * 50)]
    r.shuffle(docs)
    got = {x["doc_id"]: (x["n_bytes"], bytes(x["kept"]), len(x["spans"])) for x in repeats.remove_repeats(make(docs), together=together).collect()}
    assert got == brute_repeats(docs)


def test_maximal_repeats_of_one_array():
    strings = [words(40, 1).encode(), words(40, 1)[3:150].encode() + b"Q" * 40, b"Z" + words(40, 1)[10:].encode()]
    data = np.frombuffer(b"".join(strings), np.uint8)
    sizes = np.array([len(s) for s in strings])
    array = repeats.SuffixArray(data, np.cumsum(sizes) - sizes, sizes, np.zeros(3, np.int64))
    found = list(array.maximal_repeats(np.array([1, 2, 3])))
    assert found
    for length, a, b, low in found:
        at = array.at[array.order[a : b + 1]]
        texts = {data[x : x + length].tobytes() for x in at}
        assert len(texts) == 1 and length >= 50 and len(set(at)) == b - a + 1
        s = texts.pop()
        assert len(at) == sum(x.count(s) for x in strings)  # all occurrences
        assert low == min(i + 1 for i, x in enumerate(strings) if s in x)
        before = {x[x.find(s) - 1 : x.find(s)] or i for i, x in enumerate(strings) if s in x}
        after = {x[x.find(s) + length : x.find(s) + length + 1] or i for i, x in enumerate(strings) if s in x}
        assert len(before) > 1 and len(after) > 1  # cannot grow on either side


def test_places_of_two_are_taken_at_once(monkeypatch):
    """Only classes of more than two places go through the tree, and reaches are those of the whole tree."""
    r = random.Random(6)
    pool = [words(30, i).encode() for i in range(8)]
    strings = [b"".join(r.choice(pool)[r.randint(0, 40):] for _ in range(4)) + b"z" * r.choice([0, 90, 400]) for _ in range(40)]
    data, sizes = np.frombuffer(b"".join(strings), np.uint8), np.array([len(s) for s in strings])
    made = lambda: repeats.SuffixArray(data, np.cumsum(sizes) - sizes, sizes, np.zeros(40, np.int64))
    array, doc, walked = made(), np.array([r.randint(0, 30) for _ in range(40)]), []
    want = np.zeros(len(array.order), np.int64)
    for length, a, b, low in array.maximal_repeats(doc):
        part = want[a : b + 1]
        part[(part == 0) & (doc[array.owner[array.order[a : b + 1]]] > low)] = length
    inner = repeats.SuffixArray.maximal_repeats
    monkeypatch.setattr(repeats.SuffixArray, "maximal_repeats", lambda self, doc, at: walked.append(len(at)) or inner(self, doc, at))
    assert (array.reaches(doc) == want).all() and want.any()
    pairs = [2 for k in np.split(array.shared, np.flatnonzero(array.shared == 0)[1:]) if len(k) == 2]
    assert pairs and walked == [len(want) - sum(pairs)]
    monkeypatch.setattr(repeats, "FEW", 0)  # word by word to the end
    assert (made().shared == array.shared).all()
    lone = repeats.SuffixArray(data[:0], np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    assert len(lone.reaches(doc[:0])) == 0


def test_repeat_edges(make):
    t = words(40, 3)
    rows = repeats.remove_repeats(make([(None, t), (4, t), (4, t), (2, t[:80])])).collect()
    kept = sorted((r["doc_id"] or 0, bytes(r["kept"]).decode()) for r in rows)
    assert kept == [(0, t), (2, t[:80]), (4, t[80:]), (4, t[80:])]
    assert repeats.remove_repeats(make([])).collect() == []


def brute_lines(docs, percent=80):
    seen = [(i, n, x) for i, t in docs for n, x in enumerate((t or "").split("\n")) if x.strip(" \t\n\r\x0b\x0c")]
    sets = [set(line_dedup.line_shingles(x).tolist()) for _, _, x in seen]
    links = [(a, b) for a in range(len(seen)) for b in range(a) if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    head = closed(len(seen), links)
    first = {}
    for k, (i, n, _) in enumerate(seen):
        first[head[k]] = min(first.get(head[k], (i, n)), (i, n))
    gone = {(i, n) for k, (i, n, _) in enumerate(seen) if first[head[k]] != (i, n)}
    return {i: None if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if (i, n) not in gone) for i, t in docs}


def test_line_dedup_equals_brute_force(make):
    r = random.Random(8)
    pool = [words(r.randint(1, 60), 70 + i) for i in range(25)]
    pool += [edited(p, 0.02, 5 + i) for i, p in enumerate(pool)]
    docs = [(i, "\n".join(r.choice([*pool, "", " ", "ab", "Ab"]) for _ in range(r.randint(1, 9)))) for i in range(40)]
    docs += [(90, None), (91, ""), (92, "\n\n")]
    out = line_dedup.dedup_lines(make(docs))
    want = brute_lines(docs)
    rows = out.collect()
    assert {x["doc_id"]: x["text"] for x in rows} == want
    before = dict(docs)
    for x in rows:
        t = before[x["doc_id"]]
        assert x["lines"] == (0 if t is None else t.count("\n") + 1)
        if want[x["doc_id"]]:
            assert x["lines_removed"] == x["lines"] - want[x["doc_id"]].count("\n") - 1


def test_line_dedup_edges(make):
    t = words(20, 1)
    rows = line_dedup.dedup_lines(make([(None, t), (3, t), (3, t), (4, t + "\n" + "z" * 300_000)])).collect()
    assert sorted((r["doc_id"] or 0, r["text"][:5]) for r in rows) == [(0, t[:5]), (3, t[:5]), (3, t[:5]), (4, "zzzzz")]
    assert line_dedup.dedup_lines(make([])).collect() == []


def test_lines_on_both_sides_of_the_border_meet(make):
    r = random.Random(6)
    lines = ["-" * 50, "-" * 120, "-" * 5000, "=-" * 40, "=-" * 90]
    for n in (*range(88, 125, 3), 96, 96, 96):
        said = "".join(r.choice("abcdefghij klmnop") for _ in range(n)).replace(" ", "x", 1)
        lines += [said, said + "q", said + "".join(r.choice("rstuv") for _ in range((n - 7) // 5))]
    docs = [(i, x) for i, x in enumerate(lines)]
    got = {x["doc_id"]: x["text"] for x in line_dedup.dedup_lines(make(docs)).collect()}
    assert got == brute_lines(docs)
    for percent in (80, 50, 100):
        few, _, many, _ = line_dedup.schemes(lines, percent)
        few, many = set(few.tolist()), set(many.tolist())
        sets = [len(line_dedup.line_shingles(x)) for x in lines]
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                assert 100 * a < percent * b or 100 * b < percent * a or {i, j} <= few or {i, j} <= many


def templated(n: int, seed: int) -> list[str]:
    """Lines that share most of their text and are alike in pairs hidden among unlike ones."""
    r = random.Random(seed)
    frame = "the quick terms of this licence text are as they have been laid down in part and as are to be seen by all who read it "
    lines = []
    for i in range(n // 2):
        own = "".join(r.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(r.randint(14, 20)))
        lines += [frame + own, f"{frame}{own}{r.randint(1000, 9999)}"]
    return lines


@pytest.mark.parametrize("limits", [{}, {"NODE": 16, "PART": 32}, {"NODE": 16, "PART": 32, "BLOCKS": 64}])
def test_line_dedup_compares_all_lines_of_crowded_buckets(make, monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(line_dedup, name, value)
    lines = templated(500, 3)
    random.Random(4).shuffle(lines)
    docs = [(i, "\n".join(lines[i * 5 : i * 5 + 5])) for i in range(100)]
    got = {x["doc_id"]: x["text"] for x in line_dedup.dedup_lines(make(docs)).collect()}
    assert got == brute_lines(docs)


def test_long_lines_are_confirmed_pair_by_pair(make, monkeypatch):
    monkeypatch.setattr(line_dedup, "LONG", 50)
    lines = templated(60, 5) + [words(5, i) for i in range(20)]
    docs = [(i, x) for i, x in enumerate(lines)]
    got = {x["doc_id"]: x["text"] for x in line_dedup.dedup_lines(make(docs)).collect()}
    assert got == brute_lines(docs)


def test_line_signatures_meet_as_often_as_sets_overlap():
    agree, real = [], []
    for i in range(150):
        a = words(12 if i % 2 else 60, i)
        b = edited(a, 0.05, i)
        s = line_dedup.signatures([a, b])
        agree.append((s[0] == s[1]).mean())
        p, q = line_dedup.line_shingles(a), line_dedup.line_shingles(b)
        real.append(len(np.intersect1d(p, q)) / len(np.union1d(p, q)))
    assert abs(np.mean(agree) - np.mean(real)) < 0.03


def node_group(said: list[str]):
    """One node of all lines, as the tasks that compare nodes get it."""
    n = len(said)
    drawn = [x.tobytes() for x in line_dedup.sketches(said)]
    zero, names = np.zeros(n, np.int64), np.arange(n) * 7
    return pa.table({"node": zero, "side": zero, "line": names, "said": pa.array(said), "sketch": pa.array(drawn, pa.binary())})


@pytest.mark.parametrize("n", [20, 80])
def test_shingles_of_compared_lines_are_hashed_together(monkeypatch, n):
    said = [x + "\u00e9\u4e16" * (i % 2) for i, x in enumerate(templated(n, 9))] + ["ab", "ab"]
    sets = [set(line_dedup.line_shingles(x).tolist()) for x in said]
    links = [(a, b) for a in range(n) for b in range(a) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    real, calls = line_dedup.line_shingles, []
    monkeypatch.setattr(line_dedup, "line_shingles", lambda x: calls.append(x) or real(x))
    found = line_dedup._node_links(node_group(said), 80).to_pylist()
    got = closed(len(said), [(x["a"] // 7, x["b"] // 7) for x in found])
    want = closed(len(said), [*links, (n, n + 1)])
    assert got == want and all(x["sure"] for x in found)
    assert set(calls) <= {"ab"}  # short lines only


def test_lines_take_little_memory():
    import tracemalloc

    texts = ["\n".join(["some words of a line " * 15, " \t", "", "  x"] * 40)] * 300 + ["", "\n", "a\n"]
    raw = "".join(texts).encode()
    offsets = np.cumsum([0, *map(len, texts)])
    tracemalloc.start()
    lines = line_dedup.Lines(raw, offsets)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    want = [(t, i, x) for t, text in enumerate(texts) for i, x in enumerate(text.split("\n")) if x.strip(" \t")]
    said = [raw[a : a + n].decode() for a, n in zip(lines.starts.tolist(), lines.sizes.tolist())]
    assert list(zip(lines.text.tolist(), lines.number.tolist(), said)) == want
    assert peak < 8 * len(raw)


def terms(text):
    import re

    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute_contamination(docs, items):
    windows = set()
    for i, t in items:
        w = terms(t)
        n = min(13, len(w))
        windows |= {(str(i), tuple(w[k : k + n])) for k in range(len(w) - n + 1) if n and i is not None}
    out = {}
    for d, t in docs:
        w, hit, names = terms(t), set(), set()
        for name, x in windows:
            for k in range(len(w) - len(x) + 1):
                if tuple(w[k : k + len(x)]) == x:
                    hit |= set(range(k, k + len(x)))
                    names.add(name)
        out[d] = (len(w), len(hit), sorted(names), bool(hit) and 20 * len(hit) >= len(w))
    return out


def test_decontamination_equals_brute_force(lake, make):
    r = random.Random(2)
    items = [(i, words(r.randint(14, 50), i)) for i in range(25)] + [(30, "The the THE"), (31, "the the the the"), (32, ""), (33, None), (None, words(20, 77)), (34, " ".join(["on"] * 20)), (2, words(20, 99)), (2, words(20, 99))]
    docs = []
    for i in range(80):
        parts = [words(r.randint(0, 60), 500 + i)]
        for _ in range(r.randint(0, 3)):
            w = (r.choice(items)[1] or "x").split()
            a = r.randint(0, max(0, len(w) - 5))
            parts += [", ".join(w[a : a + r.randint(5, 60)]).upper(), words(r.randint(0, 9), i)]
        docs.append((i, " ".join(parts)))
    docs += [(200, None), (201, ""), (202, " ".join(["on"] * 31)), (203, "the " * 3)]
    bench = lake.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, term string")
    got = {x["doc_id"]: (x["n_words"], x["n_hit"], x["items"], x["contaminated"]) for x in decontaminate.judge(make(docs), bench).collect()}
    assert got == brute_contamination(docs, items)


def test_decontamination_edges(lake, make):
    t = words(20, 1)
    bench = lake.createDataFrame([(1, t)], "item_id long, text string")
    rows = decontaminate.judge(make([(None, t), (1, t), (1, "clean words"), (1, t)]), bench).collect()
    assert sorted((r["doc_id"] or 0, r["contaminated"]) for r in rows) == [(0, True), (1, False), (1, True), (1, True)]
    assert [r["contaminated"] for r in decontaminate.judge(make([(1, t)]), bench.limit(0)).collect()] == [False]
    assert decontaminate.judge(make([]), bench).collect() == []


def test_proximity(lake, make):
    schema = "item long, term long, at int, size int"
    bench = lake.createDataFrame([(1, "alpha beta gamma")], "item long, text string")
    items = bench.mapInArrow(decontaminate._item_batches, schema)
    docs = make([(1, "gamma x alpha x beta"), (2, "alpha " + "x " * 50 + "beta gamma"), (3, "alpha beta")])
    rows = docs.selectExpr("doc_id", "xxhash64(text) as h", "text")
    index = decontaminate.build_index(rows, items)
    got = decontaminate.proximity_matches(index, items, terms=3, within=10).collect()
    assert [(r["doc_id"], r["start"], r["end"]) for r in got] == [(1, 0, 5)]


def test_text_shingles_of_short_texts():
    sets = near_dup.text_shingles(pa.array(["a b", "A\tB", "b a", None]), 5)
    assert [len(s) for s in sets] == [1, 1, 1, 0]
    assert sets[0] == sets[1] != sets[2]
    assert Counter(map(bytes, sets[:2])) == {sets[0].tobytes(): 2}
