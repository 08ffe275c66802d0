"""Arrow and numpy helpers shared by the operators on texts."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

#: Bytes of text that a Python worker takes up at a time. One longer text is taken alone.
SLICE_BYTES = 1 << 20

#: Rows that Spark sends to a Python worker at once, where the session leaves its own default: whole texts are long rows.
BATCH_ROWS = 500
_ROWS_OF_A_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"

_U = np.uint64


def small_batches(docs: DataFrame) -> DataFrame:
    """``docs`` itself; lowers the session's number of rows in an Arrow batch from Spark's default to BATCH_ROWS. A number that the user set stays."""
    conf = docs.sparkSession.conf
    if conf.get(_ROWS_OF_A_BATCH) == "10000":
        conf.set(_ROWS_OF_A_BATCH, str(BATCH_ROWS))
    return docs


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts batches so that each holds at most ``most`` bytes of text, or one row."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        col = batch.column(batch.schema.get_field_index(column))
        sizes = np.asarray(pc.fill_null(pc.binary_length(col), 0), dtype=np.int64)
        ends = np.cumsum(sizes)
        at = 0
        while at < n:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + most, side="right")))
            yield batch.slice(at, to - at)
            at = to


def utf8(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column, each text followed by one space, and the texts' starts (one more at the end)."""
    texts = [b"" if x is None else x for x in col.cast(pa.binary()).to_pylist()]
    starts = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum([len(x) + 1 for x in texts], out=starts[1:])
    return np.frombuffer(b" ".join(texts) + b" ", dtype=np.uint8), starts


_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words ``[^\\x20\\x09-\\x0D]+`` in bytes that end with a space."""
    space = _SPACE[data]
    edge = np.flatnonzero(np.diff(space, prepend=True))
    return edge[0::2], edge[1::2]


#: Two odd multipliers; any odd values serve.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
#: Spans of more bytes are hashed by BLAKE2b.
SHORT = 64

def mix(h: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64."""
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of two hashes, in order. It is mixed, so that nested ones have no linear form."""
    return mix(a * _U(BASES[0]) + b)


def lane(h: np.ndarray, n: int) -> np.ndarray:
    """The n-th of several hashes that look independent, from one."""
    return mix(h ^ _U(BASES[n % 2])) if n else h


def span_array(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The bytes of spans that do not overlap, in order, as an Arrow column."""
    edge = np.zeros(len(data) + 1, dtype=np.int8)
    edge[starts] += 1
    edge[ends] -= 1
    offsets = np.zeros(len(starts) + 1, dtype=np.int64)
    np.cumsum(ends - starts, out=offsets[1:])
    return pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data[np.cumsum(edge[:-1], dtype=np.int8).view(bool)])])


_MASK = np.array([(1 << 8 * i) - 1 for i in range(9)], dtype=np.uint64)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the bytes of spans: their length and then eight bytes at a time, each mixed in; BLAKE2b for those over SHORT bytes."""
    size = ends - starts
    out = mix(size.astype(np.uint64))
    if not len(starts):
        return out
    padded = np.concatenate([data, np.zeros(16, dtype=np.uint8)])
    eight = np.empty(len(data) + 8, dtype=np.uint64)  # the eight bytes from each place on
    for o in range(8):
        part = eight[o::8]
        part[:] = padded[o : o + 8 * len(part)].view("<u8")
    short = size <= SHORT
    rows = np.arange(len(starts)) if short.all() else np.flatnonzero(short)
    for at in range(0, SHORT, 8):
        if at:
            rows = rows[size[rows] > at]
        if not len(rows):
            break
        out[rows] = pair(out[rows], eight[starts[rows] + at] & _MASK[np.minimum(size[rows] - at, 8)])
    for i in np.flatnonzero(~short).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    return out


def window_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all windows of ``k`` consecutive items, from hashes of spans of 1, 2, 4, ... items."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out, done, level, size = None, 0, hashes, 1
    while size <= k:
        if k & size:
            out = level[:n] if out is None else pair(out, level[done : done + n])
            done += size
        if 2 * size <= k:
            level = pair(level[:-size], level[size:])
        size *= 2
    return mix(out ^ _U(k))
