"""Fixed-size records packed into one binary value per bucket, so a shuffle moves few large rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SCHEMA = "bucket int, blob binary"


def buckets_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    return (keys % np.uint64(buckets)).astype(np.int64)


def pack(keys: np.ndarray, columns: list[np.ndarray], buckets: int) -> Iterator[pa.RecordBatch]:
    """Rows (bucket, blob); a blob holds the columns of its records one after another."""
    bucket = buckets_of(keys, buckets)
    order = np.argsort(bucket, kind="stable")
    cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
    columns = [c[order] for c in columns]
    full = np.flatnonzero(np.diff(cuts))
    blobs = [b"".join(c[cuts[i] : cuts[i + 1]].tobytes() for c in columns) for i in full.tolist()]
    yield pa.RecordBatch.from_arrays(
        [pa.array(full.astype(np.int32)), pa.array(blobs, pa.binary())], names=["bucket", "blob"]
    )


def unpack(blobs: pa.ChunkedArray, dtypes: list) -> list[np.ndarray]:
    """The columns of all records of a group's blobs."""
    dtypes = [np.dtype(d) for d in dtypes]
    width = sum(d.itemsize for d in dtypes)
    parts: list[list[np.ndarray]] = [[] for _ in dtypes]
    for blob in blobs.to_pylist():
        n, at = len(blob) // width, 0
        for part, d in zip(parts, dtypes):
            part.append(np.frombuffer(blob, d, n, at))
            at += n * d.itemsize
    return [np.concatenate(p) if p else np.zeros(0, d) for p, d in zip(parts, dtypes)]
