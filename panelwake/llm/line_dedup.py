"""Fuzzy line deduplication: MinHash bands find candidates, exact Jaccard confirms, one line stays.

A line's signature is a one-permutation MinHash of its character shingles, or has one hash function per
value if there are few; lines near the border have both. Lines that agree in all bins of a band share a node, and every pair of a node is compared: small nodes in one go, larger ones in pairs
of parts; very large ones branch by further minwise values first. Pairs that short sketches allow are
confirmed on their full shingle sets, links are closed by distributed union-find, and of each component
the first line in order of (doc_id, line number) stays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelwake.llm import packed
from panelwake.llm.common import in_batches, mapped, on_groups, only, partitions, query, stored, table, unused
from panelwake.llm.components import components
from panelwake.llm.interning import hash_runs, mixed, text_bytes, text_of
from panelwake.llm.near_dup import intersections, star

SHINGLE = 8
BINS, ROWS = 36, 3
FEW = 90  # different shingles from which a line's shingles may be dealt out to the bins
WIDE = 256  # different shingles from which they are not counted further
SPOTS = 1024
LOOK = 256  # places of a line that are looked at before its different shingles are counted
PIECE = 1 << 18  # characters hashed at a time, so that their arrays stay in cache
SKETCH = 32  # minwise values of a sketch, a byte of each
LEAST = 15  # a pair at the threshold has 25.6 +- 2.3 of them in common
NODE = 256  # nodes up to this size are compared in one go
SMALL = 32  # pairs of nodes up to this size are pooled
ELEMENTS = 1 << 19  # shingles of pooled pairs compared at a time
PART = 512  # larger ones are compared in pairs of parts of about this size
BLOCKS = 16_384  # nodes above this size branch first
BRANCHES = 2
DENSE = 0.7  # a branch that keeps this share of its node has not parted it
TRIES = 3  # nodes that so many branches in a row have not parted do not branch again
LONG = 10_000  # longer lines (in characters) are confirmed pair by pair
PAIRS = 4  # pairs per line above which intersections are counted together
BROADCAST_ROWS = 500_000
SALTS = 16
_EMPTY = np.uint64(2**64 - 1)
_random = np.random.default_rng(1010)
_WEIGHTS = _random.integers(1, 2**63, 128, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_other = np.random.default_rng(1011)
_XOR = _other.integers(0, 2**32, SKETCH, dtype=np.uint32)
_TIMES = _other.integers(0, 2**31, SKETCH, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_BLANKS = b" \t\n\x0b\x0c\r"
_BLANK = np.isin(np.arange(256), list(_BLANKS))


class Lines:
    """The lines of a batch that are not blank: text number, line number, place, hash."""

    def __init__(self, raw: bytes, offsets: np.ndarray):
        data = np.frombuffer(raw, np.uint8)
        breaks = np.flatnonzero(data == 10)
        starts = np.sort(np.concatenate([offsets[:-1], breaks + 1]))
        sizes = np.sort(np.concatenate([offsets[1:], breaks])) - starts
        starts, sizes = starts[sizes > 0], sizes[sizes > 0]
        seen = ~_BLANK[data[starts]]
        for i in np.flatnonzero(~seen).tolist():  # lines that begin with a blank
            seen[i] = bool(raw[starts[i] : starts[i] + sizes[i]].strip(_BLANKS))
        self.starts, self.sizes = starts[seen], sizes[seen]
        self.text = text_of(offsets, self.starts)
        self.number = np.searchsorted(breaks, self.starts) - np.searchsorted(breaks, offsets[self.text])
        self.hash = hash_runs(data, self.starts, self.sizes)


def _codes(text: str) -> np.ndarray:
    """The code points of a text, in bytes if all are ASCII."""
    if text.isascii():
        return np.frombuffer(text.encode(), np.uint8)
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def shingle_values(codes: np.ndarray) -> np.ndarray:
    """Hash of the SHINGLE characters that begin at each place.

    ASCII characters are a byte each of a number; others add a multiple of a weight of their place.
    """
    n = max(0, len(codes) - SHINGLE + 1)
    low = codes.astype(np.uint8)
    high = np.flatnonzero(codes >= 128)
    low[high] = 0
    out = np.ndarray((n,), "<u8", low, 0, (1,)).copy() if n else np.zeros(0, np.uint64)
    for i in range(SHINGLE):
        at = high[np.searchsorted(high, i) : np.searchsorted(high, n + i)]
        out[at - i] += codes[at].astype(np.uint64) * _WEIGHTS[i]
    return mixed(out)


def line_shingles(line: str) -> np.ndarray:
    codes = _codes(line)
    if len(codes) < SHINGLE:
        return mixed(np.array([(codes.astype(np.uint64) * _WEIGHTS[SHINGLE : SHINGLE + len(codes)]).sum(dtype=np.uint64)]))
    return np.unique(shingle_values(codes))


def _values(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Shingle values of all lines one after another, and how many each has."""
    sizes = np.fromiter(map(len, lines), np.int64, len(lines))
    values = shingle_values(_codes("".join(lines)))
    ends = np.cumsum(sizes)
    inside = np.ones(len(values), bool)  # not across the end of a line
    for i in range(1, SHINGLE):
        over = ends[sizes >= i] - i
        inside[over[over < len(inside)]] = False
    return values[inside], np.maximum(sizes - SHINGLE + 1, 0)


def _runs(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of all runs, one after another."""
    out = np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)
    out += np.arange(len(out))
    return out


def _places(lines: list[str], wide: int = WIDE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shingle values of all lines one after another, how many each has, and how many differ.

    Counts of `wide` and more different values are only said to be that many.
    """
    values, runs = _values(lines)
    begin = np.cumsum(runs) - runs
    distinct = runs.copy()  # lines with few places have few different values
    large = np.flatnonzero(runs >= FEW)
    if len(large):
        some = np.minimum(runs[large], LOOK)
        v = values[_runs(begin[large], some)]
        spots = np.zeros((len(large), SPOTS), np.uint8)  # no more spots than different values
        spots.reshape(-1)[np.repeat(np.arange(len(large)) * SPOTS, some) + (v & np.uint64(SPOTS - 1)).astype(np.int64)] = 1
        # eight spots to a number; sums of LOOK places fit into its bytes
        found = spots.view("<u8").sum(axis=1).view(np.uint8).reshape(len(large), 8).sum(axis=1, dtype=np.int64)
        distinct[large] = wide
        close = large[found < wide]
        v, owner = values[_runs(begin[close], runs[close])], np.repeat(np.arange(len(close)), runs[close])
        order = np.lexsort((v, owner))
        v, owner = v[order], owner[order]
        new = np.ones(len(v), bool)
        new[1:] = (v[1:] != v[:-1]) | (owner[1:] != owner[:-1])
        distinct[close] = np.minimum(np.bincount(owner[new], minlength=len(close)), wide)
    return values, runs, distinct


def _hashed(values: np.ndarray, runs: np.ndarray) -> np.ndarray:
    """The smallest value of each line by one hash function per bin."""
    begin = np.cumsum(runs) - runs
    out = np.zeros((len(runs), BINS), np.uint64)
    for i in range(BINS):
        out[:, i] = np.minimum.reduceat((values ^ _WEIGHTS[64 + i]) * _WEIGHTS[i], begin)
    return out


def _dealt(values: np.ndarray, runs: np.ndarray) -> np.ndarray:
    """The smallest value of each line in each bin its shingles are dealt to; empty bins borrow."""
    out = np.full((len(runs), BINS), _EMPTY, np.uint64)
    owner = np.repeat(np.arange(len(runs)), runs)
    at = owner * BINS + ((values >> np.uint64(32)) * np.uint64(BINS) >> np.uint64(32)).astype(np.int64)
    np.minimum.at(out.reshape(-1), at, values >> np.uint64(1))
    while (empty := out == _EMPTY).any():
        near = np.roll(out, -1, axis=1)
        out = np.where(empty & (near != _EMPTY), near + _WEIGHTS[1], out)
    return out


def schemes(lines: list[str], percent: int = 80) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Minwise values per bin under two schemes: numbers of lines and values of each.

    Lines with few different shingles have one hash function per bin. Lines with many deal their shingles
    out to the bins, keep the smallest value of each, and let an empty bin borrow from the next full one.
    Lines from FEW to FEW * 100 / percent different shingles have both, so any two lines whose sets
    differ in size by no more than the threshold allows have one in common.
    """
    high = min(max(FEW + 1, -(-FEW * 100 // percent)), WIDE) if percent > 0 else WIDE
    values, runs, distinct = _places(lines, high)
    few = distinct < high
    many = distinct >= FEW
    some = few & (runs > 0)
    of_few = np.zeros((len(lines), BINS), np.uint64)
    if some.any():
        of_few[some] = _hashed(values[np.repeat(some, runs)], runs[some])
    for i in np.flatnonzero(runs == 0):
        of_few[i] = line_shingles(lines[i])[0] ^ _WEIGHTS[:BINS]
    of_many = _dealt(values[np.repeat(many, runs)], runs[many])
    return np.flatnonzero(few), of_few[few], np.flatnonzero(many), of_many


def signatures(lines: list[str]) -> np.ndarray:
    """A minwise value per bin and line, by hash functions if the line has them."""
    few, of_few, many, of_many = schemes(lines)
    out = np.zeros((len(lines), BINS), np.uint64)
    out[many] = of_many
    out[few] = of_few
    return out


def band_keys(lines: list[str], percent: int = 80) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of lines, once per scheme they have, and a hash per row of these and band (column)."""
    few, of_few, many, of_many = schemes(lines, percent)
    sig = np.concatenate([of_few, of_many])
    bands = [
        mixed(sum(sig[:, b * ROWS + r] * _WEIGHTS[2 + r] for r in range(ROWS)) + np.uint64(b))
        for b in range(BINS // ROWS)
    ]
    return np.concatenate([few, many]), np.stack(bands, axis=1)


def _line_batches(batches: Iterator[pa.RecordBatch]):
    """Every line that is not blank, as (hash, doc_id, h, number)."""
    for batch in batches:
        lines = Lines(*text_bytes(batch.column("text")))
        at = pa.array(lines.text)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(lines.hash.view(np.int64)),
                batch.column("doc_id").take(at),
                batch.column("h").take(at),
                pa.array(lines.number.astype(np.int32)),
            ],
            names=["line", "doc_id", "h", "number"],
        )


def _band_batches(batches: Iterator[pa.RecordBatch], buckets: int, percent: int):
    """(band hash, line hash) of the distinct lines of a task's batch, packed by bucket."""
    for batch in batches:
        raw, offsets = text_bytes(batch.column("text"))
        lines = Lines(raw, offsets)
        _, once = np.unique(lines.hash, return_index=True)
        if not len(once):
            continue
        keys, owners = [], []
        begin = 0
        total = np.cumsum(lines.sizes[once])
        while begin < len(once):
            end = max(begin + 1, int(np.searchsorted(total, (total[begin - 1] if begin else 0) + PIECE)))
            part = once[begin:end]
            spans = zip(lines.starts[part].tolist(), lines.sizes[part].tolist())
            which, found = band_keys([raw[a : a + n].decode() for a, n in spans], percent)
            keys.append(found)
            owners.append(part[which])
            begin = end
        key = np.concatenate(keys)
        line = np.repeat(lines.hash[np.concatenate(owners)], key.shape[1])
        yield from packed.pack(key.ravel(), [key.ravel(), line], buckets)


def _crowds(group: pa.Table, node: int) -> pa.Table:
    """Band buckets with at least two lines: the whole list of up to `node` lines, or pieces of it."""
    key, line = packed.unpack(group["blob"], [np.uint64, np.uint64])
    order = np.lexsort((line, key))
    key, line = key[order], line[order]
    fresh = np.ones(len(key), bool)
    fresh[1:] = (key[1:] != key[:-1]) | (line[1:] != line[:-1])
    key, line = key[fresh], line[fresh]
    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    sizes = np.diff(np.append(starts, len(key)))
    crowd = np.repeat(sizes, sizes) > 1
    starts, sizes = starts[sizes > 1], sizes[sizes > 1]
    pieces = -(-sizes // node)
    nth = np.arange(int(pieces.sum())) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    begins = np.repeat(np.cumsum(sizes) - sizes, pieces) + nth * node
    names = pa.ListArray.from_arrays(
        pa.array(np.append(begins, int(sizes.sum())).astype(np.int32)), pa.array(line[crowd].view(np.int64))
    )
    return pa.Table.from_arrays(
        [pa.array(np.repeat(key[starts], pieces).view(np.int64)), pa.array(np.repeat(sizes, pieces)), names],
        names=["node", "n", "names"],
    )


def sketches(lines: list[str]) -> np.ndarray:
    """A byte per line and hash function: of the smallest value of the line's shingles."""
    values, runs = _values(lines)
    values = (values >> np.uint64(32)).astype(np.uint32)
    some = np.flatnonzero(runs)
    out = np.zeros((len(lines), SKETCH), np.uint8)
    if len(some):
        begin = (np.cumsum(runs) - runs)[some]
        for i in range(SKETCH):
            out[some, i] = np.minimum.reduceat((values ^ _XOR[i]) * _TIMES[i], begin) & np.uint32(255)
    return out


def _line_texts(batches: Iterator[pa.RecordBatch]):
    """The wanted lines of each text, and their sketches."""
    for batch in batches:
        names, texts = [], []
        for text, wanted in zip(batch.column("text").to_pylist(), batch.column("wanted").to_pylist()):
            lines = text.split("\n")
            names += [w["line"] for w in wanted]
            texts += [lines[w["number"]] for w in wanted]
        drawn: list[bytes] = []
        total = np.cumsum([len(x) for x in texts])
        while (begin := len(drawn)) < len(texts):
            end = max(begin + 1, int(np.searchsorted(total, (total[begin - 1] if begin else 0) + PIECE)))
            drawn += [r.tobytes() for r in sketches(texts[begin:end])]
        yield pa.RecordBatch.from_arrays(
            [pa.array(names, pa.int64()), pa.array(texts, pa.string()), pa.array(drawn, pa.binary())],
            names=["line", "said", "sketch"],
        )


def agreement(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """In how many values each sketch of x agrees with each of y."""
    if len(x) * len(y) <= 1024:
        return (x[:, None, :] == y[None, :, :]).sum(axis=2)
    out = np.zeros((len(x), len(y)), np.uint8)
    for i in range(SKETCH):
        out += x[:, i, None] == y[None, :, i]
    return out


def _alike(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
    """Which of the many pairs (i, j) of sets reach the Jaccard index."""
    sizes = np.array([len(x) for x in sets])
    both = intersections(sets)[i, j]
    return 100 * both >= percent * (sizes[i] + sizes[j] - both)


class _Sets:
    """Shingle sets of numbered lines, worked out for many lines at once.

    The sets are one sorted array of (line, shingle), a line's number in as few of the high bits as it
    takes; the rest holds the first bits of the shingle's hash.
    """

    def __init__(self, said: list[str], wanted: np.ndarray):
        self.bits = np.uint64(max(1, (len(said) - 1).bit_length()))
        parts, held, size = [np.zeros(0, np.uint64)], [], 0
        for k in wanted.tolist():
            held.append(k)
            size += len(said[k])
            if size >= PIECE or k == wanted[-1]:
                parts.append(self._part(said, held))
                held, size = [], 0
        self.flat = np.concatenate(parts)
        edges = np.arange(len(said) + 1).astype(object) * (1 << 64 - int(self.bits))
        edges = np.array([min(e, 2**64 - 1) for e in edges.tolist()], np.uint64)
        cuts = np.searchsorted(self.flat, edges)
        cuts[-1] = len(self.flat)
        self.begin, self.sizes = cuts[:-1], np.diff(cuts)

    def _part(self, said: list[str], held: list[int]) -> np.ndarray:
        values, runs = _values([said[k] for k in held])
        short = [k for k, n in zip(held, runs.tolist()) if not n]
        owner = np.concatenate([np.repeat(np.array(held, np.uint64), runs), np.array(short, np.uint64)])
        values = np.concatenate([values, *(line_shingles(said[k]) for k in short)])
        both = np.sort(owner << (np.uint64(64) - self.bits) | values >> self.bits)
        return both[np.append(True, both[1:] != both[:-1])[: len(both)]]

    def of(self, k: int) -> np.ndarray:
        return self.flat[self.begin[k] : self.begin[k] + self.sizes[k]] << self.bits

    def alike(self, i: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
        """Which of the pairs (i, j) reach the Jaccard index."""
        small, large = np.minimum(self.sizes[i], self.sizes[j]), np.maximum(self.sizes[i], self.sizes[j])
        out = 100 * small >= percent * large
        at = np.flatnonzero(out)
        ends = np.cumsum(self.sizes[i[at]] + self.sizes[j[at]])
        begin = 0
        while begin < len(at):
            end = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + ELEMENTS)))
            end = min(end, begin + (1 << int(self.bits)))  # a pair's number takes the place of a line's
            part = at[begin:end]
            nth = np.arange(len(part), dtype=np.uint64) << (np.uint64(64) - self.bits)
            sides = []
            for side in (i[part], j[part]):
                n = self.sizes[side]
                sides.append(np.repeat(nth, n) | self.flat[_runs(self.begin[side], n)] << self.bits >> self.bits)
            both = np.sort(np.concatenate(sides))
            common = both[1:][both[1:] == both[:-1]] >> (np.uint64(64) - self.bits)
            shared = np.bincount(common.astype(np.int64), minlength=len(part))
            total = self.sizes[i[part]] + self.sizes[j[part]] - shared
            out[part] = 100 * shared >= percent * total
            begin = end
        return out


def _small_pairs(begin: np.ndarray, size: np.ndarray, drawn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs inside each of the runs whose sketches allow it, as places."""
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for n in np.unique(size).tolist():
        p, q = np.triu_indices(n, 1)
        first = begin[size == n]
        step = max(1, (1 << 16) // max(1, len(p)))
        for k in range(0, len(first), step):
            i = (first[k : k + step, None] + p[None, :]).ravel()
            j = (first[k : k + step, None] + q[None, :]).ravel()
            fine = (drawn[i] == drawn[j]).sum(axis=1) >= LEAST
            left.append(i[fine])
            right.append(j[fine])
    return np.concatenate(left), np.concatenate(right)


def _node_links(group: pa.Table, percent: int) -> pa.Table:
    """Links inside each node (or between two parts of one); pairs with a long line are not sure.

    Links of larger nodes are stars. Lines are numbered within the group, and the pairs of all small nodes
    are confirmed together, each once.
    """
    node, side, line = (group[c].to_numpy() for c in ("node", "side", "line"))
    order = np.lexsort((line, side, node))
    node, side, line = node[order], side[order], line[order]
    name, first, number = np.unique(line, return_index=True, return_inverse=True)
    said = group["said"].take(pa.array(order[first])).to_pylist()
    drawn = np.frombuffer(b"".join(group["sketch"].take(pa.array(order[first])).to_pylist()), np.uint8).reshape(-1, SKETCH)
    long = np.array([x is None for x in said], bool)
    cuts = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1], [True]]))
    begin, size = cuts[:-1], np.diff(cuts)
    one = np.add.reduceat(side, begin) == 0 if len(begin) else np.zeros(0, bool)
    small = one & (size <= SMALL)
    i, j = _small_pairs(begin[small], size[small], drawn[number])
    pair = np.unique(number[i] * len(name) + number[j])
    pooled = [(pair // max(1, len(name)), pair % max(1, len(name)))]
    larger = []
    for s, e in zip(begin[~small].tolist(), cuts[1:][~small].tolist()):
        at = number[s:e]
        left = int(np.count_nonzero(side[s:e] == 0))
        if left == len(at):  # one part
            i, j = np.nonzero(np.triu(agreement(drawn[at], drawn[at]) >= LEAST, 1))
        else:
            i, j = np.nonzero(agreement(drawn[at[:left]], drawn[at[left:]]) >= LEAST)
            j = j + left
        larger.append((at[i], at[j]))
    sure = [(i[fine], j[fine]) for i, j in pooled + larger for fine in [~(long[i] | long[j])]]
    unsure = [(i[not_fine], j[not_fine]) for i, j in pooled + larger for not_fine in [long[i] | long[j]]]
    sets = _Sets(said, np.unique(np.concatenate([x for pairs in sure for x in pairs])))
    out: list[tuple[np.ndarray, np.ndarray, bool]] = [(i, j, False) for i, j in unsure]
    fine = sets.alike(*sure[0], percent)
    out.append((sure[0][0][fine], sure[0][1][fine], True))
    for i, j in sure[1:]:
        if not len(i):
            continue
        some, back = np.unique(np.concatenate([i, j]), return_inverse=True)
        a, b = back[: len(i)], back[len(i) :]
        if len(i) > PAIRS * len(some):
            fine = _alike([sets.of(k) for k in some.tolist()], a, b, percent)
        else:
            fine = sets.alike(i, j, percent)
        to = star(len(some), a[fine], b[fine])
        moved = to != np.arange(len(some))
        out.append((some[to[moved]], some[moved], True))
    flat = lambda k: name[np.concatenate([o[k] for o in out])]
    return pa.Table.from_arrays(
        [pa.array(flat(0)), pa.array(flat(1)), pa.array(np.repeat([o[2] for o in out], [len(o[0]) for o in out]), pa.bool_())],
        names=["a", "b", "sure"],
    )


def _confirm(batches: Iterator[pa.RecordBatch], percent: int):
    for batch in batches:
        sets: dict[int, np.ndarray] = {}  # of this batch's lines; heads of groups come again and again

        def of(name: int, said: str) -> np.ndarray:
            if name not in sets:
                sets[name] = line_shingles(said)
            return sets[name]

        fine = []
        for a, b, x, y in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "x", "y"))):
            p, q = of(a, x), of(b, y)
            if 100 * min(len(p), len(q)) < percent * max(len(p), len(q)):
                fine.append(False)
                continue
            both = len(np.intersect1d(p, q, assume_unique=True))
            fine.append(100 * both >= percent * (len(p) + len(q) - both))
        yield batch.select(["a", "b"]).filter(pa.array(fine, pa.bool_()))


def _cut_batches(batches: Iterator[pa.RecordBatch]):
    """Texts without the named lines, and how many lines they had. Texts that lose none pass as they are."""
    for batch in batches:
        text, gone = batch.column(0), batch.column(1)
        cut = pc.is_valid(gone)
        short = []
        for said, numbers in zip(text.filter(cut).to_pylist(), gone.filter(cut).to_pylist()):
            drop = set(numbers)
            short.append("\n".join(x for i, x in enumerate(said.split("\n")) if i not in drop))
        count = pc.fill_null(pc.add(pc.count_substring(text, "\n"), 1), 0).cast(pa.int64())
        left = pc.replace_with_mask(text, cut, pa.array(short, text.type))
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[1:], left, count], names=[*batch.schema.names[1:], "_cut", "_lines"]
        )


def _parted(crowds: DataFrame, drawn: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes to compare in one go as (names), and larger ones to compare in parts as (node, n, line).

    A node above BLOCKS hands each line to two branches, each by a minwise value that its path has not
    used before. A pair at a Jaccard of 0.8 stays together in a branch with a probability of 0.9375 at
    any depth.
    """
    leaves = [crowds.where(F.col("n") <= NODE).select("names")]
    start = F.col("node").alias("root")
    level = crowds.where(F.col("n") > NODE).select("node", start, "n", F.lit(0).alias("tries"), F.explode("names").alias("line"))
    level = stored(level, "level")
    blocks = []
    for depth in range(SKETCH // BRANCHES + 1):
        ends = (F.col("n") <= BLOCKS) | (F.col("tries") >= TRIES) | F.lit(depth == SKETCH // BRANCHES)
        blocks.append(level.where((F.col("n") > NODE) & ends).select("node", "n", "line"))
        over = level.where(~ends)
        if over.isEmpty():
            break
        branch = F.explode(F.sequence(F.lit(0), F.lit(BRANCHES - 1))).alias("branch")
        here = over.join(drawn, "line").select("*", branch)
        place = F.pmod(F.xxhash64("root") + BRANCHES * depth + F.col("branch"), F.lit(SKETCH)).cast("int") + 1
        rows = here.select(
            F.xxhash64("node", "branch", F.substring("sketch", place, F.lit(1))).alias("node"),
            "root",
            F.col("n").alias("parent_n"),
            "tries",
            "line",
        )
        sizes = rows.groupBy("node").agg(F.count("*").alias("n")).where("n > 1")
        failed = F.col("n") >= DENSE * F.col("parent_n")
        tries = F.when(failed, F.col("tries") + 1).otherwise(0).alias("tries")
        level = stored(rows.join(sizes, "node").select("node", "root", "n", tries, "line"), "level")
        few = level.where(F.col("n") <= NODE)
        leaves.append(few.groupBy("node").agg(F.sort_array(F.collect_list("line")).alias("names")).select("names"))
    union = lambda parts: parts[0] if len(parts) == 1 else parts[0].unionByName(union(parts[1:]))
    return union(leaves), union(blocks)


def _links(crowds: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """(a, b) of lines that reach the Jaccard index, as far as their nodes need to be one component."""
    leaves, blocks = _parted(crowds, texts.select("line", "sketch"))
    # equal member lists, as those of most small nodes, are compared once
    alone = leaves.dropDuplicates(["names"]).select(F.xxhash64("names").alias("node"), F.explode("names").alias("line"))
    group = F.pmod(F.xxhash64("node"), F.lit(max(partitions(texts.sparkSession), texts.count() // 1000)))
    zero = F.lit(0)
    alone = alone.select(group.alias("g"), zero.alias("i"), zero.alias("j"), "node", zero.alias("side"), "line")
    parts = F.ceil(F.col("n") / PART).cast("int")
    part = F.pmod(F.xxhash64("line"), parts).cast("int")
    paired = blocks.select("*", part.alias("p"), F.explode(F.sequence(zero, parts - 1)).alias("q")).select(
        F.col("node").alias("g"),
        F.least("p", "q").alias("i"),
        F.greatest("p", "q").alias("j"),
        "node",
        F.when(F.col("p") > F.col("q"), 1).otherwise(0).alias("side"),
        "line",
    )
    short = F.when(F.length("said") <= LONG, F.col("said")).alias("said")
    nodes = alone.unionByName(paired).join(texts.select("line", short, "sketch"), "line")
    found = on_groups(
        nodes.groupBy("g", "i", "j"), lambda t: _node_links(t, percent), "a long, b long, sure boolean"
    )
    found = stored(found.distinct(), "found")
    left = texts.select(F.col("line").alias("a"), F.col("said").alias("x"))
    right = texts.select(F.col("line").alias("b"), F.col("said").alias("y"))
    both = found.where(~F.col("sure")).join(left, "a").join(right, "b").select("a", "b", "x", "y")
    sure = found.where("sure").select("a", "b")
    return sure.unionByName(in_batches(both, lambda b: _confirm(b, percent), "a long, b long"))


def removed_lines(rows: DataFrame, percent: int) -> DataFrame:
    """(doc_id, h, gone): numbers of the lines that go, per document that loses any."""
    spark = rows.sparkSession
    rows = rows.where("doc_id is not null and text is not null")
    buckets = max(partitions(spark), rows.count() // 5000)
    schema = "line long, doc_id long, h long, number int"
    lines = stored(in_batches(rows, _line_batches, schema).groupBy("line", "doc_id", "h").agg(F.sort_array(F.collect_set("number")).alias("numbers")), "lines")
    place = F.struct("doc_id", "h", F.col("numbers")[0].alias("number"))
    firsts = lines.groupBy("line").agg(F.min(place).alias("first"), F.sum(F.size("numbers")).alias("n"))
    firsts = stored(firsts, "firsts")
    bands = in_batches(rows.select("text"), lambda b: _band_batches(b, buckets, percent), packed.SCHEMA)
    size = NODE
    crowds = on_groups(bands.groupBy("bucket"), lambda t: _crowds(t, size), "node long, n long, names array<long>")
    crowds = stored(crowds, "crowds")
    wanted = crowds.select(F.explode("names").alias("line")).distinct()
    wanted = wanted.join(firsts, "line").select("line", "first.*")
    wanted = wanted.groupBy("doc_id", "h").agg(F.collect_list(F.struct("line", "number")).alias("wanted"))
    wanted = stored(wanted, "wanted")
    small = F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS else wanted
    texts = rows.join(small, ["doc_id", "h"]).select("text", "wanted")
    schema = "line long, said string, sketch binary"
    texts = stored(in_batches(texts, _line_texts, schema).dropDuplicates(["line"]), "said")
    links = _links(crowds, texts, percent)
    groups = components(links).withColumnRenamed("node", "line")
    in_group = groups.join(firsts, "line")
    kept = in_group.groupBy("component").agg(F.min("first").alias("kept"))
    by_group = groups.join(kept, "component").select("line", "kept")
    # lines with copies or in a component; any other line stays
    judged = (
        firsts.join(by_group, "line", "left")
        .where("n > 1 or kept is not null")
        .select("line", F.coalesce("kept", "first").alias("kept"))
    )
    salt = F.pmod(F.xxhash64("doc_id", "h"), F.lit(SALTS)).cast("int").alias("salt")
    spread = judged.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    mine = (F.col("kept.doc_id") == F.col("doc_id")) & (F.col("kept.h") == F.col("h"))
    gone = F.when(mine, F.filter("numbers", lambda n: n != F.col("kept.number"))).otherwise(F.col("numbers"))
    out = lines.select("*", salt).join(spread, ["line", "salt"]).select("doc_id", "h", gone.alias("gone"))
    return out.where(F.size("gone") > 0).groupBy("doc_id", "h").agg(F.flatten(F.collect_list("gone")).alias("gone"))


def dedup_lines(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    percent: int = 80,
    counts: tuple[str, str] = ("lines", "lines_removed"),
) -> DataFrame:
    """The rows with `text` cut, and `lines` and `lines_removed` (long), or what `counts` calls them, added.

    Lines end at line feeds. Two lines are alike if the Jaccard index of their sets of 8-character
    shingles is at least `percent`; a line of fewer characters is one shingle. Of a component of alike
    lines the first in order of (doc_id, text, line number) stays and all others go, equal lines
    included. Blank lines stay and are not compared.

    Null text stays null. Rows without doc_id stay as they are and are not compared. Rows that repeat in
    full are cut alike. Empty tables give no rows. Input columns with a name of `counts` give way;
    any other stays as it is.
    A pair at the threshold is compared with a probability above 0.999, as every pair of a node is (a
    branching node keeps 0.94 of them per shared band); what is linked is exact.
    """
    spark = docs.sparkSession
    kept = [c for c in docs.columns if c not in counts]
    rest = [c for c in kept if c != text]
    own = lambda name: unused([*docs.columns, *counts], name)
    gone_id, gone_h, gone_at, whole, n, short, n_lines = map(own, ("_gone_id", "_gone_h", "_gone", "_text", "_n", "_cut", "_lines"))
    rows = only(docs, doc_id=doc_id, text=text)
    rows = rows.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("h"))
    gone = stored(removed_lines(rows, percent), "gone")
    lean = gone.select(F.col("doc_id").alias(gone_id), F.col("h").alias(gone_h), F.col("gone").alias(gone_at))
    lean = F.broadcast(lean) if gone.count() <= BROADCAST_ROWS else lean
    key = docs[f"`{doc_id}`"].cast("long")
    hit = (key == F.col(gone_id)) & (F.xxhash64(docs[f"`{text}`"]) == F.col(gone_h))
    count = F.coalesce(F.size(gone_at), F.lit(0)).cast("long")
    both = docs.join(lean, hit, "left").select(
        docs[f"`{text}`"].alias(whole), F.col(gone_at), *[docs[f"`{c}`"] for c in rest], count.alias(n)
    )
    schema = T.StructType(
        [
            T.StructField(gone_at, T.ArrayType(T.IntegerType())),
            *both.schema.fields[2:-1],
            T.StructField(n, T.LongType()),
            T.StructField(short, T.StringType()),
            T.StructField(n_lines, T.LongType()),
        ]
    )
    cut = mapped(both, _cut_batches, schema)
    return cut.select(
        *[F.col(short).alias(text) if c == text else F.col(f"`{c}`") for c in kept],
        F.col(n_lines).alias(counts[0]),
        F.when(F.col(gone_at).isNull(), 0).otherwise(F.col(n)).cast("long").alias(counts[1]),
    )


@query("op10_line_dedup")
def op10_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """What is left of every document once alike lines are gone."""
    cut = dedup_lines(table(spark, folder, "documents").select("doc_id", "text"))
    return cut.select(
        "doc_id", "lines", "lines_removed", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256")
    )
