"""Collocations against brute force: counts, scores, order, and edges."""

from __future__ import annotations

import random
import re
import uuid
from collections import Counter

import numpy as np
import pytest

from panelwake.llm import collocations
from panelwake.llm.collocations import phrase_counts


def plain_counts(rows, longest=3):
    out = [Counter() for _ in range(longest)]
    for _, text, lang in rows:
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", lower):
            w = re.findall("[^\x20\x09]+", piece)
            for m in range(longest):
                for i in range(len(w) - m):
                    out[m]["und" if lang is None else lang, " ".join(w[i : i + m + 1])] += 1
    return out


def plain_collocations(rows, longest=3, least=10, top=2000):
    counts = plain_counts(rows, longest)
    f = {k: v for c in counts for k, v in c.items()}
    found, inside = {}, Counter()
    for m in range(1, longest):
        for (lang, phrase), a in counts[m].items():
            if a < least:
                continue
            w = phrase.split(" ")
            cuts = []
            for k in range(1, len(w)):
                l, r = f[lang, " ".join(w[:k])], f[lang, " ".join(w[k:])]
                cuts.append((1000000 * a * a // (l * r), k, l, r))
            found[lang, phrase] = (a, *min(cuts))
            for n in range(2, len(w)):
                for i in range(len(w) - n + 1):
                    part = lang, " ".join(w[i : i + n])
                    inside[part] = max(inside[part], a)
    kept = [(k, v) for k, v in found.items() if 100 * inside[k] < 50 * v[0]]
    out = []
    for lang in {k[0] for k, _ in kept}:
        mine = [(phrase, *v) for (l, phrase), v in kept if l == lang]
        mine.sort(key=lambda x: (-x[2], -x[1], x[0].encode()))
        n = sum(v for (l, _), v in counts[0].items() if l == lang)
        out += [(lang, i + 1, p, a, l, r, n, s) for i, (p, a, s, _, l, r) in enumerate(mine[:top])]
    return sorted(out)


def got(df):
    assert df.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    return sorted(tuple(r) for r in df.collect())


def exact(found):
    return {(r["lang"], r["phrase"]): r["a"] for r in found.collect()}


def rows_of(seed, n=400):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(30)] + ["Ab", "aB", "é", "ß", "it's", "x" * 300]
    fixed = ["of the people", "new york city", "one two three four"]
    out = []
    for i in range(n):
        w = []
        for _ in range(r.randint(0, 60)):
            w.append(r.choice(fixed) if r.random() < 0.1 else vocabulary[min(int(r.expovariate(0.15)), 35)])
            w.append(r.choice([" ", " ", " ", "  ", "\t", ", ", ".\n", "\x0b", " \r "]))
        out.append((i, "".join(w), r.choice(["en", "en", "de", None, "und", ""])))
    return out


@pytest.mark.parametrize("longest,shards", [(3, 3), (2, 1), (4, 2)])
def test_equal_to_brute_force(make, longest, shards):
    rows = rows_of(longest) + [(1, None, "en"), (2, "", "en"), (3, " \t.\n", None), (4, "Aa " * 20_000, "xx")]
    rows += rows[:50]
    df = collocations.collocations(make(rows), longest=longest, shards=shards)
    want = plain_collocations(rows, longest)
    assert len(want) > 100 and got(df) == want


def test_every_phrase_meets_every_shard_once(make):
    """Words that only reach the threshold late start their phrases late; counts are whole all the same."""
    rows = rows_of(9, 600)
    found, n_words = phrase_counts(make(rows), shards=7)
    assert exact(found) == {k: v for c in plain_counts(rows) for k, v in c.items() if v >= 10}
    assert sum(r["n"] for r in n_words.collect()) == sum(plain_counts(rows)[0].values())


def test_filters_that_let_all_in(make, monkeypatch):
    """A filter far too small lets phrases in by mistake; no result changes."""
    monkeypatch.setattr(collocations, "MOST_BITS", 16)
    rows = rows_of(5) + [(i, f"u{i} v{i} w{i}", "en") for i in range(20_000)]
    found, _ = phrase_counts(make(rows), least=1)
    assert exact(found) == {k: v for c in plain_counts(rows) for k, v in c.items()}


def test_threshold_above_a_byte(make):
    rows = [(i, "a b c. b c", "en") for i in range(300)] + [(i, "a b", "en") for i in range(99)]
    found, _ = phrase_counts(make(rows), least=600)
    assert exact(found) == {("en", "b c"): 600, ("en", "b"): 699, ("en", "c"): 600}


def test_ties_and_top(make):
    rows = [(i, f"{a} {b}.", "en") for i in range(10) for a, b in [("zz", "yy"), ("é", "q"), ("m", "n")]]
    assert got(collocations.collocations(make(rows), top=2)) == plain_collocations(rows, top=2)


def test_large_counts_are_exact(lake):
    """Products beyond 64 bits: the arithmetic of the score alone."""
    a, l, r = 900_000_000_001, 900_000_000_007, 999_999_999_989
    row = lake.createDataFrame([(a, l, r)], "a long, l long, r long").selectExpr(f"{collocations.SCORE} as s").first()
    assert row["s"] == 1_000_000 * a * a // (l * r)


@pytest.mark.parametrize("rows", [[], [(1, None, None)], [(1, "a b c", "en")]])
def test_nothing_to_find(make, rows):
    assert got(collocations.collocations(make(rows))) == []


def test_a_run_leaves_few_files_and_jobs(make, tmp_path, monkeypatch):
    at = lambda spark, label: f"{tmp_path}/{label}-{uuid.uuid4().hex}"
    monkeypatch.setattr(collocations, "scratch_path", at)
    df = make(rows_of(6))
    spark = df.sparkSession
    settings = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {name: spark.conf.get(name) for name in settings}
    keys = spark.range(500).selectExpr("xxhash64(id) as key")
    try:
        for name, value in settings.items():
            spark.conf.set(name, value)
        spark.sparkContext.setJobGroup("one filter", "")
        grown = collocations._grown(None, keys, 3)
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("one filter"))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        for name, value in before.items():
            spark.conf.set(name, value)
    assert grown.has(keys.toArrow()["key"].to_numpy().view(np.uint64)).all() and jobs < 20
    monkeypatch.setattr(collocations, "PARTS_SENT", 1)
    assert (collocations._grown(grown, keys.limit(9), 3).bits == grown.bits).all()
    found, _ = phrase_counts(df)
    assert found.count() > 0 and list(tmp_path.glob("shards-*")) and not list(tmp_path.glob("scan-*"))
