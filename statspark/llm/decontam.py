"""Benchmark decontamination by greedy string tiling.

1. Karp-Rabin hashes of all windows of ``MIN_MATCH`` words of the benchmark are
   seeds. The seeds of one block of items are broadcast; the block's size
   bounds them, and larger benchmarks take more blocks.
2. Windows of whole documents are joined with the seeds. A document and an item
   that share one are compared. An item of fewer words is a seed as a whole.
3. Tiling: seed matches are grown to maximal matches by comparing words; the
   longest that overlaps no marked words of either side is marked as a tile; this
   is repeated until none of MIN_MATCH words is left. So passages are
   found in any order.
4. Coverage is the share of an item's words in tiles. From THRESHOLD on, the
   document is contaminated.
"""

from __future__ import annotations

import heapq
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text

MIN_MATCH = 5
THRESHOLD = 0.5
#: Benchmark words in a block: about 20 MB of seeds.
BLOCK_WORDS = 1_000_000

_U = np.uint64
_WORD = re.compile(r"\w+")


def normal_words(t: str | None) -> list[str]:
    """Words for comparison: lowered runs of letters, digits and underscores."""
    return _WORD.findall((t or "").lower())


def _hashes(batch: list[list[str]], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Window hashes of all word lists (windows over a border are to be left out), and the lists' starts."""
    joined = " ".join(" ".join(w) for w in batch).encode("utf-8", "surrogatepass") + b" "
    data = np.frombuffer(joined, dtype=np.uint8)
    space = data == 32
    edge = np.flatnonzero(np.diff(space, prepend=True))
    h = text.span_hashes(data, edge[0::2], edge[1::2])
    starts = np.concatenate([[0], np.cumsum([len(w) for w in batch])])
    return text.window_hashes(h, k), starts


@dataclass
class Seeds:
    """One block of the benchmark: item ids and words, and sorted seed hashes of ``k`` words with their item and position."""

    ids: list[int]
    words: list[list[str]]
    hashes: np.ndarray
    item: np.ndarray
    pos: np.ndarray
    k: int = MIN_MATCH
    shorter: tuple[Seeds, ...] = ()

    @classmethod
    def of(cls, items: list[tuple[int, list[str]]], k: int = MIN_MATCH) -> Seeds:
        """Items of fewer than ``k`` words make seeds of their own length in ``shorter``; items without a word are left out."""
        lengths = sorted({len(w) for _, w in items if 0 < len(w) < k})
        shorter = tuple(cls.of([(i, w) for i, w in items if len(w) == n], n) for n in lengths)
        items = [(i, w) for i, w in items if len(w) >= k]
        ids, words = [i for i, _ in items], [w for _, w in items]
        h, starts = _hashes(words, k) if words else (np.zeros(0, dtype=np.uint64), np.zeros(1, dtype=np.int64))
        own = np.concatenate([np.arange(a, b - k + 1) for a, b in zip(starts, starts[1:])]) if words else np.zeros(0, dtype=np.int64)
        item = np.searchsorted(starts, own, side="right") - 1
        order = np.argsort(h[own], kind="stable")
        return cls(ids, words, h[own][order], item[order], (own - starts[item])[order], k, shorter)


def tiles(doc: list[str], item: list[str], seeds: list[tuple[int, int]], k: int = MIN_MATCH) -> list[tuple[int, int, int]]:
    """Greedy string tiling from seed positions (in document, in item): tiles (document, item, length), longest first.

    Hits on one diagonal that follow each other are one maximal match. A match that
    overlaps marked words is cut to its unmarked runs and tried again, as
    the repeated search for the longest free match would do. Ties go to the earlier
    place in the document, then in the item.
    """
    by_diagonal = defaultdict(list)
    for d, i in seeds:
        if doc[d : d + k] == item[i : i + k]:
            by_diagonal[d - i].append(d)
    heap: list[tuple[int, int, int]] = []
    for diagonal, at in by_diagonal.items():
        at.sort()
        begin = last = at[0]
        for d in [*at[1:], None]:
            if d is None or d > last + 1:
                heap.append((-(last + k - begin), begin, begin - diagonal))
                begin = d
            last = d
    heapq.heapify(heap)
    taken_doc: set[int] = set()
    free_item = np.ones(len(item), dtype=bool)
    out = []
    while heap and free_item.any():
        n, d, i = heapq.heappop(heap)
        n = -n
        ok = [free_item[i + x] and (d + x) not in taken_doc for x in range(n)]
        if all(ok):
            out.append((d, i, n))
            free_item[i : i + n] = False
            taken_doc.update(range(d, d + n))
            continue
        run = 0
        for x in range(n + 1):
            if x < n and ok[x]:
                run += 1
            else:
                if run >= k:
                    heapq.heappush(heap, (-run, d + x - run, i + x - run))
                run = 0
    return out


def pairs(texts: list[str | None], s: Seeds, threshold: float = THRESHOLD) -> list[tuple[int, int, int, int, float, int]]:
    """Contaminating pairs of a batch of texts: (row, item_id, covered, n_words, coverage, n_tiles)."""
    lists = [normal_words(t) for t in texts]
    return [p for one in (s, *s.shorter) for p in _pairs(lists, one, threshold)]


def _pairs(lists: list[list[str]], s: Seeds, threshold: float) -> list[tuple[int, int, int, int, float, int]]:
    if sum(map(len, lists)) < s.k or not len(s.hashes):
        return []
    k = s.k
    h, starts = _hashes(lists, k)
    lo = np.searchsorted(s.hashes, h, side="left")
    hit = np.flatnonzero(s.hashes[np.minimum(lo, len(s.hashes) - 1)] == h)
    hi = np.searchsorted(s.hashes, h[hit], side="right")
    of = np.searchsorted(starts, hit, side="right") - 1
    inside = hit + k <= starts[of + 1]
    found: dict[tuple[int, int], list[tuple[int, int]]] = defaultdict(list)
    for w, a, z, r in zip(hit[inside].tolist(), lo[hit[inside]].tolist(), hi[inside].tolist(), of[inside].tolist(), strict=True):
        for x in range(a, z):
            found[r, int(s.item[x])].append((w - int(starts[r]), int(s.pos[x])))
    out = []
    for (r, i), hits in found.items():
        item = s.words[i]
        if len({p + x for _, p in hits for x in range(k)}) < threshold * len(item):
            continue  # seeds alone bound the coverage from above
        t = tiles(lists[r], item, hits, k)
        covered = sum(n for *_, n in t)
        if covered >= threshold * len(item):
            out.append((r, s.ids[i], covered, len(item), covered / len(item), len(t)))
    return out


def _blocks(benchmark: DataFrame, item_id: str, column: str, most: int) -> Iterator[list[tuple[int, list[str]]]]:
    block, n = [], 0
    for r in benchmark.select(F.col(item_id).cast("long").alias("i"), F.col(column).cast("string").alias("t")).orderBy("i", "t").toLocalIterator():
        w = normal_words(r["t"])
        if block and n + len(w) > most:
            yield block
            block, n = [], 0
        block.append((r["i"], w))
        n += len(w)
    if block:
        yield block


def tile_block(docs: DataFrame, seeds: Seeds, threshold: float) -> DataFrame:
    """(rid, doc_id, item_id, covered, n_words, coverage, n_tiles) of contaminating pairs; ``docs``: rid, doc_id, text."""
    sent = docs.sparkSession.sparkContext.broadcast(seeds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = sent.value
        for b in text.slices(batches):
            rows = [(b.column(0)[r].as_py(), b.column(1)[r].as_py(), *rest) for r, *rest in pairs(b.column(2).to_pylist(), s, threshold)]
            cols = list(zip(*rows, strict=True)) if rows else [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(cols, (pa.int64(),) * 5 + (pa.float64(), pa.int64()), strict=True)], names=["rid", "doc_id", "item_id", "covered", "n_words", "coverage", "n_tiles"])

    return docs.mapInArrow(run, "rid long, doc_id long, item_id long, covered long, n_words long, coverage double, n_tiles long")


def contaminated(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", column: str = "text", item_id: str = "item_id", item_text: str = "text", k: int = MIN_MATCH, threshold: float = THRESHOLD, block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row for each contaminated document and item: (rid, doc_id, item_id, covered, n_words, coverage, n_tiles).

    Documents without a contaminating item have no row. Words are lowered runs of
    letters, digits and underscores. Null texts have no words; items of fewer than
    ``k`` words match where they occur as a whole; null ids stay null; repeated rows are compared
    each; an empty table on either side gives an empty result; other
    columns are ignored. rid is the row's monotonically_increasing_id().
    """
    rows = text.small_batches(docs).select(F.monotonically_increasing_id().alias("rid"), F.col(doc_id).cast("long").alias("doc_id"), F.col(column).cast("string").alias("text"))
    out = None
    for block in _blocks(benchmark, item_id, item_text, block_words):
        part = tile_block(rows, Seeds.of(block, k), threshold)
        out = part if out is None else out.unionByName(part)
    return tile_block(rows, Seeds.of([], k), threshold) if out is None else out


def remove(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", column: str = "text", k: int = MIN_MATCH, threshold: float = THRESHOLD, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The rows that no benchmark item contaminates, with all their columns as they are.

    One narrow pass for each block of the benchmark: a row is dropped where it stands.
    """
    out = text.small_batches(docs)
    at = docs.columns.index(column)
    for block in _blocks(benchmark, "item_id", "text", block_words):
        sent = docs.sparkSession.sparkContext.broadcast(Seeds.of(block, k))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            for b in text.slices(batches, column):
                bad = {r for r, *_ in pairs(b.column(at).to_pylist(), sent.value, threshold)}
                yield b.filter(pa.array([r not in bad for r in range(b.num_rows)]))

        out = out.mapInArrow(run, docs.schema)
    return out
