"""Words of many texts as small numbers, found and looked up by array operations."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Longer words are not kept; they are handed out as they are.
LONGEST = 256
#: Bytes worked on at a time where several numbers per byte are needed.
PIECE = 1 << 19

SPACE, LETTER, DIGIT, MARK, QUOTE, OTHER = range(6)


def _classes() -> np.ndarray:
    """Class of each byte; bytes of characters beyond ASCII are OTHER."""
    out = np.full(256, OTHER, np.uint8)
    for b in range(128):
        c = chr(b)
        if c in "\t\n\x0b\x0c\r ":
            out[b] = SPACE
        elif c.isalpha():
            out[b] = LETTER
        elif c.isdigit():
            out[b] = DIGIT
        else:
            out[b] = QUOTE if c == "'" else MARK
    return out


CLASS = _classes()
_CUTS = np.zeros((6, 6), bool)  # a word may end between these classes
_CUTS[SPACE, 1:] = _CUTS[1:, SPACE] = True
for _a in (LETTER, DIGIT, MARK):
    for _b in (LETTER, DIGIT, MARK):
        _CUTS[_a, _b] = _a != _b
_CUTS = _CUTS.ravel()

_random = np.random.default_rng(20240229)
_BYTE = _random.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE = _random.integers(1, 2**63, (2, LONGEST), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z as a-z; other bytes as they are."""
    return np.where((data >= 65) & (data <= 90), data | 32, data).astype(np.uint8)


def split_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and sizes (in bytes) of the words of all texts.

    Words end at ASCII white space and between ASCII letters, digits and other signs; they do not end
    beside an apostrophe or a character beyond ASCII, whose role depends on what is around it.
    """
    return _split(data, offsets, CLASS, _CUTS)


def split_at(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and sizes of the runs of bytes for which `inside` (of 256 values) is true."""
    return _split(data, offsets, np.where(inside, LETTER, SPACE).astype(np.uint8), _CUTS)


def _split(data, offsets, classes, cuts):
    n = len(data)
    kind = classes[data]
    cut = np.ones(n, bool)
    cut[1:] = cuts[kind[:-1] * np.uint8(6) + kind[1:]]
    cut[offsets[:-1][offsets[:-1] < n]] = True
    starts = np.flatnonzero(cut)
    sizes = np.diff(np.append(starts, n))
    word = kind[starts] != SPACE
    return starts[word], sizes[word]


def split_spaced(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and sizes of words that keep one space in front, and of the white space left over.

    Cuts as `split_words`. Of white space before a word, a last space goes with the word and another
    last character stands alone; what is left stands together, as does all of it at a text's end.
    """
    n = len(data)
    kind = CLASS[data]
    cut = np.ones(n + 1, bool)
    cut[1:n] = _CUTS[kind[:-1] * np.uint8(6) + kind[1:]]
    edge = np.zeros(n + 1, bool)  # a text begins here
    edge[offsets] = True
    cut |= edge
    begins = cut[:n] & (kind != SPACE)  # words, and parts of words after a cut inside
    opened = np.flatnonzero(begins & ~edge[:n])
    opened = opened[kind[opened - 1] == SPACE]  # words with white space before them
    spaced = data[opened - 1] == 32
    cut[opened[spaced]] = False
    cut[opened - 1] = True
    starts = np.flatnonzero(cut[:n])
    return starts, np.diff(np.append(starts, n))


def hash_words(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of each word."""
    out = np.zeros((2, len(starts)), np.uint64)
    ends = np.cumsum(sizes)
    begin = 0
    while begin < len(starts):  # some hundred thousand bytes at a time, or one long word
        end = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + PIECE)))
        out[:, begin:end] = _hash_piece(data, starts[begin:end], sizes[begin:end])
        begin = end
    return np.maximum(out[0], 1), out[1]


def _hash_piece(data, starts, sizes):
    first = np.cumsum(sizes) - sizes
    place = np.arange(int(sizes.sum())) - np.repeat(first, sizes)
    value = _BYTE[data[place + np.repeat(starts, sizes)]]
    if sizes.max() > LONGEST:  # weights repeat, times another odd number each round
        value *= (2 * (place // LONGEST) + 1).astype(np.uint64)
        place %= LONGEST
    out = []
    for weights in _PLACE:
        h = np.add.reduceat(value * weights[place], first)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
        out.append(h)
    return out


def hash_runs(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run of bytes, eight bytes at a time; for runs longer than words."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    words = np.ndarray((len(data) + 1,), "<u8", padded, 0, (1,))
    steps = -(-sizes // 8)
    ends = np.cumsum(steps)
    out = np.zeros(len(starts), np.uint64)
    begin = 0
    while begin < len(starts):
        end = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + PIECE // 8)))
        n, size, start = steps[begin:end], sizes[begin:end], starts[begin:end]
        first = np.cumsum(n) - n
        place = np.arange(int(n.sum())) - np.repeat(first, n)
        w = words[np.repeat(start, n) + 8 * place]
        rest = ((8 - (size - 8 * (n - 1))) * 8).astype(np.uint64)  # bits of the last word beyond the run
        last = first + n - 1
        w[last] = (w[last] << rest) >> rest
        w = mixed(w + _PLACE[0, place % LONGEST]) * (_PLACE[1, place % LONGEST] + (2 * (place // LONGEST)).astype(np.uint64))
        out[begin:end] = mixed(np.add.reduceat(w, first) + size.astype(np.uint64) * _BYTE[1])
        begin = end
    return out


class Known:
    """Hash of a word to its number, as an open table in two arrays."""

    def __init__(self, bits: int = 21):
        self.bits, self.size = bits, 0
        self.keys = np.zeros(1 << bits, np.uint64)
        self.values = np.zeros(1 << bits, np.int32)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return (keys >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Number of each key, -1 where it is not known."""
        out = np.full(len(keys), -1, np.int32)
        slot, open_ = self._slots(keys), np.arange(len(keys))
        while len(open_):
            there = self.keys[slot]
            hit = there == keys[open_]
            out[open_[hit]] = self.values[slot[hit]]
            on = ~hit & (there != 0)
            open_ = open_[on]
            slot = (slot[on] + 1) & (len(self.keys) - 1)
        return out

    def add(self, keys: np.ndarray) -> None:
        """New distinct keys get the next numbers in order."""
        if (self.size + len(keys)) * 2 > len(self.keys):
            old = self.keys[self.keys != 0], self.values[self.keys != 0]
            while (self.size + len(keys)) * 2 > 1 << self.bits:
                self.bits += 1
            self.keys = np.zeros(1 << self.bits, np.uint64)
            self.values = np.zeros(1 << self.bits, np.int32)
            self._put(*old)
        self._put(keys, np.arange(self.size, self.size + len(keys), dtype=np.int32))
        self.size += len(keys)

    def _put(self, keys: np.ndarray, values: np.ndarray) -> None:
        slot = self._slots(keys)
        while len(keys):
            free = self.keys[slot] == 0
            self.keys[slot[free]] = keys[free]
            placed = self.keys[slot] == keys
            self.values[slot[placed]] = values[placed]
            keys, values = keys[~placed], values[~placed]
            slot = (slot[~placed] + 1) & (len(self.keys) - 1)


class Rows:
    """Variable-length rows of numbers, one per known word, gathered for many words at once."""

    def __init__(self, dtype=np.int32):
        self.flat, self.used = np.zeros(1 << 16, dtype), 0
        self.starts, self.sizes, self.n = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int32), 0

    def add(self, rows: np.ndarray, sizes: np.ndarray) -> None:
        while self.used + len(rows) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while self.n + len(sizes) > len(self.starts):
            self.starts = np.concatenate([self.starts, np.zeros_like(self.starts)])
            self.sizes = np.concatenate([self.sizes, np.zeros_like(self.sizes)])
        self.flat[self.used : self.used + len(rows)] = rows
        self.starts[self.n : self.n + len(sizes)] = self.used + np.cumsum(sizes) - sizes
        self.sizes[self.n : self.n + len(sizes)] = sizes
        self.used += len(rows)
        self.n += len(sizes)

    def gather(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sizes = self.sizes[at].astype(np.int64)
        out = np.empty(int(sizes.sum()), self.flat.dtype)
        done = 0
        for i in range(0, len(at), 100_000):
            n = sizes[i : i + 100_000]
            ends = np.cumsum(n)
            places = np.repeat(self.starts[at[i : i + 100_000]] - (ends - n), n)
            places += np.arange(len(places))
            out[done : done + len(places)] = self.flat[places]
            done += len(places)
        return out, sizes


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(30))


_STEPS = _random.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def text_of(offsets: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Number of the text each start lies in."""
    return np.searchsorted(offsets, starts, side="right") - 1


def shingle_hashes(words: np.ndarray, first: np.ndarray, k: int) -> list[np.ndarray]:
    """Sorted distinct hashes of k words in a row per text; a shorter text is one shingle by itself.

    `words` holds the word hashes of all texts, `first` the place where each text begins, and the end.
    """
    n = len(words)
    runs = np.zeros(max(0, n - k + 1), np.uint64)
    for i in range(k):
        runs += words[i : i + len(runs)] * _STEPS[i]
    runs = mixed(runs)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= k:
            out.append(np.unique(runs[a : b - k + 1]))
        elif b > a:
            whole = (words[a:b] * _STEPS[: b - a]).sum(dtype=np.uint64) + np.uint64(b - a)
            out.append(mixed(np.array([whole], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def text_bytes(column: pa.Array) -> tuple[bytes, np.ndarray]:
    """The texts of a column in a row, nulls as nothing, and where each begins and ends."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = raw.to_pybytes()[offsets[0] : offsets[-1]] if raw is not None else b""
    return data, offsets - offsets[0]


def with_rows(flat: np.ndarray, sizes: np.ndarray, rows: dict[int, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Put rows of their own in place of the (empty) rows of the named texts, in order."""
    ends, pieces, at = np.cumsum(sizes), [], 0
    for t, row in rows.items():
        pieces += [flat[at : ends[t]], row]
        at = int(ends[t])
        sizes[t] = len(row)
    return np.concatenate([*pieces, flat[at:]]), sizes
