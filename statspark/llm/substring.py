"""Removal of repeated word windows, with a count-min prefilter.

A window's *anchor* is the least hash among its sub-windows of half its length. Equal windows have equal anchors, and
neighbours share theirs, so a text has about one anchor for thirteen windows of 50 words.

Pass 1: every task sketches the anchors of its documents (once for each document). A sketch has ROWS rows of counters; tasks send only
the counters they touched, cut into shards, and the shards are merged by addition. Count-min never
underestimates: a window of two documents has an anchor of two documents, whose counters all are at two or more.

Pass 2: windows whose estimate is two or more are grouped by the 128-bit BLAKE2b of their words, in one
shuffle; all others are in one document only and are never shuffled. A task first settles what it can: where it
holds a window of two documents, the larger doc_id needs no group any more. So a group has at most
one document for each gather of GATHER windows, however many share the window.

The merged sketch keeps one bit for each counter ("two or more") and is broadcast. Its width follows the corpus, up to ``max_width``,
which bounds the broadcast at ROWS * max_width / 8 bytes (128 MB by default). Its size only decides how many windows are
grouped in pass 2, never the result.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import store, text

WINDOW = 50
ROWS = 2
#: Counters in a shard: merging holds one byte for each in memory.
SHARD = 1 << 22
MAX_WIDTH = 1 << 29
#: Anchors that a task gathers before it sends a partial sketch, and windows before it settles and sends them.
GATHER = 1 << 20
#: Bytes of text taken up at a time.
SLICE = 1 << 20

_U = np.uint64


@dataclass
class Windows:
    """The windows of one text: a hash and the anchor of each, and the words, one space apart, with their starts (one more at the end)."""

    row: int
    hashes: np.ndarray
    anchors: np.ndarray
    words: bytes
    starts: np.ndarray

    def digest(self, at: int, k: int) -> bytes:
        return hashlib.blake2b(self.words[self.starts[at] : self.starts[at + k] - 1], digest_size=16).digest()

    def distinct(self, at: np.ndarray, k: int) -> dict[bytes, int]:
        """The windows at these starts by digest, each with its first start."""
        found: dict[bytes, int] = {}
        for i in at.tolist():
            found.setdefault(self.digest(i, k), i)
        return found


def _least(h: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours."""
    size = 1
    n = len(h) - width + 1
    while 2 * size <= width:
        h = np.minimum(h[:-size], h[size:])
        size *= 2
    return np.minimum(h[:n], h[width - size : width - size + n])


def windows(column: pa.Array, k: int) -> Iterator[Windows]:
    """The texts that have a window of ``k`` words."""
    data, at = text.utf8(column)
    starts, ends = text.words(data)
    if len(starts) < k:
        return
    hashes = text.span_hashes(data, starts, ends)
    whole = text.window_hashes(hashes, k)
    half = max(1, k // 2)
    anchors = _least(text.window_hashes(hashes, half), k - half + 1)
    first = np.searchsorted(starts, at)
    for i in np.flatnonzero(np.diff(first) >= k).tolist():
        a, b = first[i], first[i + 1]
        raw = data[at[i] : at[i + 1]].tobytes().split()
        lengths = np.zeros(b - a + 1, dtype=np.int64)
        np.cumsum(ends[a:b] - starts[a:b] + 1, out=lengths[1:])
        yield Windows(i, whole[a : b - k + 1], anchors[a : b - k + 1], b" ".join(raw), lengths)


def slots(anchors: np.ndarray, bits: int) -> list[np.ndarray]:
    """The counters of an anchor in each row of the sketch."""
    return [(text.lane(text.mix(anchors), n) >> _U(64 - bits)).astype(np.int64) for n in range(ROWS)]


def _pack(values: np.ndarray) -> bytes:
    """Sorted slots as compressed byte planes of their gaps."""
    gaps = np.diff(values, prepend=0).astype("<u4")
    return zlib.compress(gaps.view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def _unpack(packed: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(packed), dtype=np.uint8).reshape(4, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int64))


def sketch(docs: DataFrame, column: str, k: int, bits: int) -> DataFrame:
    """A written table (shard, twice): merged shards as packed bits of the counters that reach two.

    Shard numbers run over the rows of the sketch one after the other.
    """
    per_row = max(1, (1 << bits) // SHARD)
    size = min(SHARD, 1 << bits)

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = [[] for _ in range(ROWS)]

        def flush() -> Iterator[pa.RecordBatch]:
            for row in range(ROWS):
                values, counts = np.unique(np.concatenate(held[row]), return_counts=True)
                held[row].clear()
                cuts = np.searchsorted(values, np.arange(per_row + 1) * size)
                rows = []
                for s in range(per_row):
                    v, c = values[cuts[s] : cuts[s + 1]] - s * size, counts[cuts[s] : cuts[s + 1]]
                    if len(v):
                        many = c > 1
                        rows.append((row * per_row + s, _pack(v), _pack(v[many]), zlib.compress((c[many] - 1).astype("<u4").tobytes(), 1)))
                if rows:
                    cols = list(zip(*rows, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), *(pa.array(c, pa.binary()) for c in cols[1:])], names=["shard", "touched", "more", "extra"])

        n = 0
        for b in text.slices(batches, most=SLICE):
            for w in windows(b.column(0), k):
                once = np.unique(w.anchors)
                for row, s in enumerate(slots(once, bits)):
                    held[row].append(s.astype(np.uint32))
                n += len(once)
            if n >= GATHER:
                yield from flush()
                n = 0
        if n:
            yield from flush()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, counters = None, np.zeros(0, dtype=np.uint32)

        def done() -> pa.RecordBatch:
            bits_of = np.packbits(counters >= 2, bitorder="little").tobytes()
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([bits_of], pa.binary())], names=["shard", "twice"])

        for b in batches:
            for shard, touched, more, extra in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if shard != now:
                    if now is not None:
                        yield done()
                    now, counters = shard, np.zeros(size, dtype=np.uint32)
                counters[_unpack(touched)] += 1
                counters[_unpack(more)] += np.frombuffer(zlib.decompress(extra), dtype="<u4")
        if now is not None:
            yield done()

    parts = docs.select(F.col(column).cast("string").alias("text")).mapInArrow(local, "shard int, touched binary, more binary, extra binary")
    n = min(ROWS * per_row, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    merged = parts.repartition(n, "shard").sortWithinPartitions("shard").mapInArrow(merge, "shard int, twice binary")
    return store.table(merged, "sketch")


class Sketch:
    """The merged sketch, as tasks look anchors up in it."""

    def __init__(self, merged: DataFrame, bits: int):
        per_row, size = max(1, (1 << bits) // SHARD), min(SHARD, 1 << bits)
        self.bits = bits
        self.twice = np.zeros((ROWS, per_row * size // 8), dtype=np.uint8)
        for r in merged.toLocalIterator():
            row, s = divmod(r["shard"], per_row)
            self.twice[row, s * size // 8 : (s + 1) * size // 8] = np.frombuffer(r["twice"], dtype=np.uint8)

    def repeated(self, anchors: np.ndarray) -> np.ndarray:
        out = np.ones(len(anchors), dtype=bool)
        for row, s in enumerate(slots(anchors, self.bits)):
            out &= (self.twice[row][s >> 3] >> (s & 7).astype(np.uint8) & 1).astype(bool)
        return out


def settle(a: np.ndarray, b: np.ndarray, d: np.ndarray, th: np.ndarray, pos: np.ndarray) -> list[np.ndarray]:
    """Marks the windows, given by their digests a and b, that a smaller doc_id among these has too.

    Their positions become complements and their digests a hash of their place, so that they spread over all tasks.
    """
    order = np.lexsort((d, b, a))
    a, b, d, th, pos = (x[order] for x in (a, b, d, th, pos))
    new = np.ones(len(a), dtype=bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    least = d[new][np.cumsum(new) - 1]
    known = d > least
    spread = text.mix(th.view(np.uint64) ^ text.mix(pos.astype(np.uint64)))
    return [np.where(known, spread.view(np.int64), a), b, d, th, np.where(known, ~pos, pos)]


def covered(rows: DataFrame, k: int, max_width: int) -> DataFrame:
    """(d, th, gone): window starts whose words a smaller doc_id has too, for each row that has some.

    ``rows``: d (doc_id), th (hash of the text) and text. Rows of the same d and
    th, which are repeated rows, are one. Of equal windows of one text only the first start is given.
    """
    spark = rows.sparkSession
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # About six bytes make a word, and 2 / (k - k // 2 + 2) of the windows bring a new anchor; the next power of two from four counters for each.
    bits = min(max(16, int(size // 6 * 8 // (k - k // 2 + 2)).bit_length()), max_width.bit_length() - 1)
    merged = sketch(rows, "text", k, bits)
    sent = spark.sparkContext.broadcast(Sketch(merged, bits))
    store.drop(merged)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = sent.value
        held: list[list[np.ndarray]] = [[] for _ in range(5)]

        def flush() -> pa.RecordBatch:
            cols = settle(*(np.concatenate(c) for c in held))
            for c in held:
                c.clear()
            return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["a", "b", "d", "th", "pos"])

        n = 0
        for batch in text.slices(batches, most=SLICE):
            d, th = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for w in windows(batch.column(2), k):
                change = np.flatnonzero(np.concatenate([[True], w.anchors[1:] != w.anchors[:-1]]))
                times = np.diff(np.append(change, len(w.anchors)))
                at = np.flatnonzero(np.repeat(s.repeated(w.anchors[change]), times))
                if not len(at):
                    continue
                found = w.distinct(at, k)
                key, at = np.frombuffer(b"".join(found), dtype="<i8").reshape(-1, 2), np.fromiter(found.values(), dtype=np.int64, count=len(found))
                for col, v in zip(held, (key[:, 0], key[:, 1], np.full(len(at), d[w.row]), np.full(len(at), th[w.row]), at.astype(np.int32)), strict=True):
                    col.append(v)
                n += len(at)
                if n >= GATHER:
                    yield flush()
                    n = 0
        if n:
            yield flush()

    hits = rows.mapInArrow(emit, "a long, b long, d long, th long, pos int")
    same = Window.partitionBy("a", "b")
    cover = hits.withColumn("m", F.min("d").over(same)).filter((F.col("pos") < 0) | (F.col("d") > F.col("m")))
    at = F.when(F.col("pos") < 0, F.bitwise_not("pos")).otherwise(F.col("pos"))
    return cover.select("d", "th", at.alias("pos")).groupBy("d", "th").agg(F.collect_set("pos").alias("gone"))


def _cut(raw: bytes | None, gone: np.ndarray | None, k: int) -> tuple[int, int, bytes]:
    """Number of words, of removed ones, and the kept words, one space apart."""
    parts = (raw or b"").split()
    if gone is None:
        return len(parts), 0, b" ".join(parts)
    (w,) = windows(pa.array([raw], pa.binary()), k)
    at = np.flatnonzero(np.isin(w.hashes, w.hashes[gone]))
    if len(at) > len(gone):  # the windows that repeat inside the text
        same = w.distinct(gone, k)
        at = np.array([i for i in at.tolist() if w.digest(i, k) in same])
    edge = np.zeros(len(parts) + 1, dtype=np.int64)
    edge[at] += 1
    np.add.at(edge, at + k, -1)
    inside = np.cumsum(edge[:-1]) > 0
    return len(parts), int(inside.sum()), b" ".join(p for p, c in zip(parts, inside.tolist(), strict=True) if not c)


def dedup(docs: DataFrame, doc_id: str = "doc_id", column: str = "text", k: int = WINDOW, max_width: int = MAX_WIDTH) -> DataFrame:
    """One row for each input row: (doc_id, n_words, n_removed, kept_text).

    A word is removed if a window of ``k`` words that covers it, as it stands in
    the input, also starts in a document with a smaller doc_id. Kept words are
    joined by one space. Words are ``[^\\x20\\x09-\\x0D]+``, unchanged. Null texts
    have no words. A null doc_id counts as larger than all others; rows that
    repeat a doc_id do not remove each other's words. Texts of fewer than ``k``
    words are kept whole. A text of any length is taken whole, in one task. An empty table gives an empty result. Other
    columns are ignored.
    """
    t = F.col(column).cast("string")
    d = F.coalesce(F.col(doc_id).cast("long"), F.lit((1 << 63) - 1)).alias("d")
    gone = covered(text.small_batches(docs).select(d, F.xxhash64(t).alias("th"), t.alias("text")), k, max_width).withColumnsRenamed({"d": "gd", "th": "gt"})
    whole = docs.select(F.col(doc_id).cast("long").alias("doc_id"), d, F.xxhash64(t).alias("th"), t.alias("text"))
    both = whole.join(gone, (F.col("d") == F.col("gd")) & (F.col("th") == F.col("gt")), "left").select("doc_id", "text", "gone")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text.slices(batches, most=SLICE):
            rows = [_cut(raw, g.values.to_numpy() if g.is_valid else None, k) for raw, g in zip(b.column(1).cast(pa.binary()).to_pylist(), b.column(2), strict=True)]
            n_words, removed, kept = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n_words, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "n_removed", "kept_text"])

    return both.mapInArrow(cut, "doc_id long, n_words long, n_removed long, kept_text string")


def brute_force(rows: list[tuple[int, str]], k: int = WINDOW) -> list[tuple[int, int, int, str]]:
    """What :func:`dedup` must return, by a plain loop (for tests)."""
    least: dict[tuple[str, ...], int] = {}
    split = [(d, (t or "").encode().split()) for d, t in rows]
    for d, w in split:
        for i in range(len(w) - k + 1):
            key = tuple(w[i : i + k])
            least[key] = min(least.get(key, d), d)
    out = []
    for d, w in split:
        gone = {j for i in range(len(w) - k + 1) if least[tuple(w[i : i + k])] < d for j in range(i, i + k)}
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return out
