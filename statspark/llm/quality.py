"""A generalised additive model with pairwise interactions for text quality.

Shape functions are lookup tables over binned features, one for each feature
and one for each chosen pair. They are learnt by cyclic boosting: in turn, each
feature gets one shallow tree (up to three cuts over its bins) fitted to the
gradient of the log loss, at a small learning rate. Then the pairs with the
largest gain on the residuals get trees of one cut on either axis in the same way.
Scoring adds up table entries by bins, for whole batches at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import store, text

#: The model is fitted on at most so many labelled rows, those of the least hash of doc_id.
MAX_TRAIN_ROWS = 20_000
BINS = 32
ROUNDS = 120
PAIRS = 6
PAIR_ROUNDS = 40
RATE = 0.15
PENALTY = 1.0

FEATURES = (
    "log_words", "mean_word", "upper", "digit", "symbol", "exclaim", "pipe", "stop_mark", "comma", "newline",
    "distinct_words", "repeated_windows", "repeated_lines", "longest_word", "non_ascii", "lower_words",
)

_CLASSES = np.zeros(256, dtype=np.uint8)
for _i, _chars in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"#*$%&<>@^~_=+\\/", b"!", b"|", b".", b",", b"\n"), 1):
    _CLASSES[list(_chars)] = _i
_CLASSES[128:] = 9
_CLASSES[ord("a") : ord("z") + 1] = 10


def features(column: pa.Array) -> np.ndarray:
    """(n, len(FEATURES)) measurements of whole texts; null and empty texts give zeros."""
    data, at = text.utf8(column)
    n = len(at) - 1
    out = np.zeros((n, len(FEATURES)))
    doc = np.repeat(np.arange(n, dtype=np.int64), np.diff(at))
    counts = np.bincount(doc * 16 + _CLASSES[data], minlength=16 * n).reshape(n, 16)
    starts, ends = text.words(data)
    first = np.searchsorted(starts, at)
    n_words = np.diff(first)
    of = np.repeat(np.arange(n, dtype=np.int64), n_words)
    size = ends - starts
    chars = np.bincount(of, weights=size, minlength=n)
    safe_w, safe_c = np.maximum(n_words, 1), np.maximum(chars, 1)
    out[:, 0] = np.log1p(n_words)
    out[:, 1] = chars / safe_w
    for j, c in ((2, 1), (3, 2), (14, 9)):
        out[:, j] = counts[:, c] / safe_c
    for j, c in ((4, 3), (5, 4), (6, 5), (7, 6), (8, 7), (9, 8)):
        out[:, j] = counts[:, c] / safe_w
    hashes = text.span_hashes(data, starts, ends)

    def distinct(of: np.ndarray, values: np.ndarray) -> np.ndarray:
        order = np.lexsort((values, of))
        o, v = of[order], values[order]
        new = np.ones(len(o), dtype=bool)
        new[1:] = (o[1:] != o[:-1]) | (v[1:] != v[:-1])
        return np.bincount(o[new], minlength=n)

    out[:, 10] = distinct(of, hashes) / safe_w
    if len(hashes) > 2:
        win = text.window_hashes(hashes, 3)
        whole = of[2:] == of[:-2]
        n_win = np.bincount(of[:-2][whole], minlength=n)
        out[:, 11] = 1 - distinct(of[:-2][whole], win[whole]) / np.maximum(n_win, 1)
        out[n_win == 0, 11] = 0
    breaks = np.flatnonzero(data == 10)
    line_starts = np.union1d(at[:-1], breaks + 1)
    line_starts = line_starts[line_starts < len(data)]
    line_ends = np.append(line_starts[1:] - 1, len(data) - 1)
    long = line_ends - line_starts > 1
    if long.any():
        a, b = line_starts[long], line_ends[long]
        lines_of = np.searchsorted(at, a, side="right") - 1
        n_lines = np.bincount(lines_of, minlength=n)
        out[:, 12] = 1 - distinct(lines_of, text.span_hashes(data, a, b)) / np.maximum(n_lines, 1)
        out[n_lines == 0, 12] = 0
    if len(size):
        full = n_words > 0
        out[full, 13] = np.log1p(np.maximum.reduceat(size, first[:-1][full]))
        out[:, 15] = np.bincount(of, weights=_CLASSES[data[starts]] == 10, minlength=n) / safe_w
    return out


@dataclass
class Model:
    """Bias, cut points of each feature, and lookup tables of features and pairs of features."""

    bias: float
    cuts: list[np.ndarray]
    mains: list[np.ndarray]
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, j], side="right") for j, c in enumerate(self.cuts)], axis=1) if len(x) else np.zeros((0, len(self.cuts)), dtype=np.int64)

    def logit(self, x: np.ndarray) -> np.ndarray:
        b = self.bins(x)
        out = np.full(len(x), self.bias)
        for j, t in enumerate(self.mains):
            out += t[b[:, j]]
        for i, j, t in self.pairs:
            out += t[b[:, i], b[:, j]]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x), -30, 30)))


def _tree(g: np.ndarray, h: np.ndarray, leaves: int = 4) -> np.ndarray:
    """Best-first tree of up to ``leaves`` leaves over ordered bins with gradient and curvature sums; a value for each bin."""
    out = np.zeros(len(g))
    gain_of = lambda a, b: a * a / (b + PENALTY)

    def best(lo: int, hi: int) -> tuple[float, int]:
        if hi - lo < 2:
            return 0.0, lo
        gl, hl = np.cumsum(g[lo:hi])[:-1], np.cumsum(h[lo:hi])[:-1]
        gain = gain_of(gl, hl) + gain_of(g[lo:hi].sum() - gl, h[lo:hi].sum() - hl) - gain_of(g[lo:hi].sum(), h[lo:hi].sum())
        k = int(np.argmax(gain))
        return float(gain[k]), lo + k + 1

    parts = [(0, len(g), *best(0, len(g)))]
    while len(parts) < leaves:
        k = max(range(len(parts)), key=lambda i: parts[i][2])
        lo, hi, gain, cut = parts[k]
        if gain <= 1e-9:
            break
        parts[k : k + 1] = [(lo, cut, *best(lo, cut)), (cut, hi, *best(cut, hi))]
    for lo, hi, _, _ in parts:
        out[lo:hi] = g[lo:hi].sum() / (h[lo:hi].sum() + PENALTY)
    return out


def _pair_tree(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """Four quadrants at the best cut of either axis: gain and values."""
    cum = lambda a: np.pad(a.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    cg, ch = cum(g), cum(h)
    n, m = g.shape
    i, j = np.arange(1, n)[:, None], np.arange(1, m)[None, :]
    total = 0.0
    for a, b, c, d in ((0, i, 0, j), (0, i, j, m), (i, n, 0, j), (i, n, j, m)):
        box = lambda s, a=a, b=b, c=c, d=d: s[b, d] - s[a, d] - s[b, c] + s[a, c]
        total = total + box(cg) ** 2 / (box(ch) + PENALTY)
    k = np.unravel_index(int(np.argmax(total)), total.shape)
    x, y = int(k[0]) + 1, int(k[1]) + 1
    out = np.zeros_like(g)
    for s in ((slice(0, x), slice(0, y)), (slice(0, x), slice(y, m)), (slice(x, n), slice(0, y)), (slice(x, n), slice(y, m))):
        out[s] = g[s].sum() / (h[s].sum() + PENALTY)
    return float(total[k]), out


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """Fits the model; with no rows, or labels of one kind only, tables stay zero and the bias holds the smoothed prior."""
    prior = (y.sum() + 1) / (len(y) + 2)
    d = x.shape[1] if x.ndim == 2 else len(FEATURES)
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) if len(x) else np.zeros(0) for j in range(d)]
    model = Model(float(np.log(prior / (1 - prior))), cuts, [np.zeros(len(c) + 1) for c in cuts])
    if len(np.unique(y)) < 2:
        return model
    b = model.bins(x)
    f = np.full(len(y), model.bias)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-f))
        return y - p, p * (1 - p)

    for _ in range(ROUNDS):
        for j, t in enumerate(model.mains):
            g, h = slopes()
            step = RATE * _tree(np.bincount(b[:, j], g, len(t)), np.bincount(b[:, j], h, len(t)))
            t += step
            f += step[b[:, j]]

    def sums(i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
        g, h = slopes()
        shape = (len(model.mains[i]), len(model.mains[j]))
        at = b[:, i] * shape[1] + b[:, j]
        return np.bincount(at, g, shape[0] * shape[1]).reshape(shape), np.bincount(at, h, shape[0] * shape[1]).reshape(shape)

    wide = [j for j in range(d) if len(model.mains[j]) > 1]
    ranked = sorted(((_pair_tree(*sums(i, j))[0], i, j) for i, j in combinations(wide, 2)), key=lambda r: (-r[0], r[1], r[2]))
    model.pairs = [(i, j, np.zeros((len(model.mains[i]), len(model.mains[j])))) for _, i, j in ranked[:PAIRS]]
    for _ in range(PAIR_ROUNDS):
        for i, j, t in model.pairs:
            step = RATE * _pair_tree(*sums(i, j))[1]
            t += step
            f += step[b[:, i], b[:, j]]
    return model


def held_out(doc_id: str) -> Column:
    """True where the CRC-32 of the id as text leaves 1 modulo 3; false for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def measured(docs: DataFrame, doc_id: str, column: str) -> DataFrame:
    """(doc_id, rid, x): features of each row, written once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text.slices(batches):
            x = features(b.column(2))
            offsets = pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.float32).ravel()))], names=["rid", "doc_id", "x"])

    rows = text.small_batches(docs).select(F.monotonically_increasing_id().alias("rid"), F.col(doc_id).cast("long").alias("doc_id"), F.col(column).cast("string").alias("text"))
    return store.table(rows.mapInArrow(run, "rid long, doc_id long, x array<float>"), "features")


def train(rows: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAIN_ROWS) -> Model:
    """Fits on rows of :func:`measured` that have a label and are not held out.

    Null labels are left out; of several labels of one document, and of
    repeated rows, the least counts. The sample of at most ``max_rows`` is by a
    hash of doc_id, so it does not depend on partitions.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("l"), F.col("quality").cast("int").alias("y")).filter("l IS NOT NULL AND y IS NOT NULL").groupBy("l").agg(F.min("y").alias("y"))
    known = known.filter(~held_out("l"))
    own = rows.join(known, rows.doc_id == known.l).groupBy("l").agg(F.min("x").alias("x"), F.min("y").alias("y"))
    # A histogram of the hash's upper 16 bits bounds what the tasks send to the driver by about the sample.
    own = store.table(own.withColumn("h", F.shiftrightunsigned(F.xxhash64("l"), 24)), "labelled")
    total, last = 0, 0
    for r in sorted(own.groupBy(F.shiftright("h", 24).alias("b")).agg(F.count("*").alias("n")).collect()):
        total, last = total + r["n"], r["b"]
        if total >= max_rows:
            break
    sample = own.filter(F.shiftright("h", 24) <= last).orderBy("h", "l").limit(max_rows).select("x", "y").toPandas()
    store.drop(own)
    x = np.array(sample["x"].tolist(), dtype=np.float32).reshape(len(sample), len(FEATURES))
    return fit(x.astype(float), sample["y"].to_numpy(dtype=float))


def score(rows: DataFrame, model: Model) -> DataFrame:
    """Adds ``score`` to rows of :func:`measured`."""
    sent = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column(2).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sent.value.score(x))], names=["rid", "doc_id", "score"])

    return rows.mapInArrow(run, "rid long, doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", column: str = "text", max_rows: int = MAX_TRAIN_ROWS) -> DataFrame:
    """One row for each input row: (doc_id, held_out, score, predicted).

    Labels are learnt from rows that are not held out only; id, source, language
    and labels are no inputs of a score. Null texts count as empty. With no usable
    labels the score is the smoothed prior (0.5). Null ids and repeated rows are
    scored as any other; an empty table gives an empty result; other columns
    are ignored.
    """
    rows = measured(docs, doc_id, column)
    out = score(rows, train(rows, labels, max_rows))
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", column: str = "text", threshold: float = 0.5, max_rows: int = MAX_TRAIN_ROWS) -> DataFrame:
    """The rows that score ``threshold`` or more, with all their columns as they are."""
    rows = measured(docs, doc_id, column)
    model = train(rows, labels, max_rows)
    store.drop(rows)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text.slices(batches, column):
            x = features(b.column(b.schema.get_field_index(column))).astype(np.float32).astype(float)
            yield b.filter(pa.array(sent.value.score(x) >= threshold))

    return text.small_batches(docs).mapInArrow(run, schema)
