"""Links between texts whose sets of word shingles are similar, whole at any similarity.

SimHash fingerprints of similar texts differ in more bits than selective Golay keys can bridge: at a Jaccard
similarity of 0.8 about 10 of 64. So :func:`components` takes the pairs that the Golay search finds as a start
and completes them by prefix keys, which miss no pair:

1. All tasks count shingles in a count-min sketch, merged by addition. It orders shingles, rare ones first.
2. Two sets of similarity s share one of the first ``m - ceil(s * m) + 1`` shingles of either of them in any order that both
   use, and one of the first ``m - ceil(2 * s / (1 + s) * m) + 1`` of the smaller. Passages that many texts
   share are frequent, so they are no keys unless a text holds little else.
3. Members of a key are compared by size and by their places in the order, which bound the similarity from
   above, then by the parities of 1,024 parts of their sets, which differ in no more places than the sets have elements that they do not share, and then by their whole sets.

While there are many pairs to compare, as thousands of near copies make, members of a key are first compared with one of them, another in each of ROUNDS
rounds. It saves comparisons within components and drops none.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import graph, store, text

#: Counters of the sketch that orders shingles. More only order them better.
COUNTERS = 1 << 22
#: Parts of the sketch that are merged apart.
PARTS = 16
#: Longs of parities for each set, and in the rows of keys.
PARITIES, FOLDED = 16, 8
#: Ids up to which a list of them is broadcast (8 bytes each); longer lists are joined by a shuffle.
BROADCAST_IDS = 2_000_000
#: Pairs for each member of a key up to which all pairs are compared at once.
PAIRWISE = 8
#: Rounds in which members of keys are compared with one or two of them only.
ROUNDS = 2

_U = np.uint64


def normal(raw: bytes | None) -> bytes:
    """The words of a text's UTF-8 bytes, one space apart; as in SimHash, only A-Z are lowered, only 0x20 and 0x09-0x0D split."""
    return b" ".join((raw or b"").lower().split())


def shingles(texts: list[bytes], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of normal texts and the texts' starts (one more at the end). A text of 1 to ``k`` words has one, an empty one none."""
    data = np.frombuffer(b" ".join(texts) + b" ", dtype=np.uint8)
    begin, end = text.words(data)
    words = text.span_hashes(data, begin, end)
    n = np.array([t.count(b" ") + 1 if t else 0 for t in texts], dtype=np.int64)
    first = np.cumsum(n) - n
    count = np.where(n > 0, np.maximum(n - k + 1, 1), 0)
    starts = np.concatenate([[0], np.cumsum(count)])
    at = np.arange(starts[-1]) - np.repeat(starts[:-1] - first, count)
    whole = text.window_hashes(words, k)
    out = whole[np.minimum(at, len(whole) - 1)] if len(whole) else np.zeros(len(at), dtype=np.uint64)
    for size in range(1, k):
        few = np.flatnonzero(n == size)
        h = words[first[few]]
        for j in range(1, size):
            h = text.pair(h, words[first[few] + j])
        out[starts[few]] = text.mix(h ^ _U(size))
    return out, starts


def fingerprints(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """SimHash of each text's shingles, repeats included; 0 without a shingle."""
    n = np.diff(starts)
    out = np.zeros(len(n), dtype=np.uint64)
    some = np.flatnonzero(n)
    if not len(some):
        return out
    # Bits j, j + 8, ... of blocks of at most 255 hashes are counted at once, a byte for each.
    blocks = -(-n[some] // 255)
    first = np.cumsum(blocks) - blocks
    at = np.repeat(starts[:-1][some], blocks) + 255 * (np.arange(blocks.sum()) - np.repeat(first, blocks))
    for j in range(8):
        counts = np.add.reduceat((hashes >> _U(j)) & _U(0x0101010101010101), at)
        ones = np.add.reduceat(counts.astype("<u8").view(np.uint8).reshape(-1, 8).astype(np.int64), first, axis=0)
        for byte in range(8):
            out[some] |= (2 * ones[:, byte] > n[some]).astype(np.uint64) << _U(8 * byte + j)
    return out


def frequencies(docs: DataFrame, k: int, counters: int = COUNTERS) -> np.ndarray:
    """Classes of shingle counts by hash, from rows (node, text): 16 for each factor of two."""
    size = counters // PARTS

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(counters, dtype=np.uint32)
        for b in text.slices(batches):
            h, _ = shingles([normal(x) for x in b.column(1).cast(pa.binary()).to_pylist()], k)
            np.add.at(held, (h & _U(counters - 1)).astype(np.int64), np.uint32(1))
        if held.any():
            rows = [zlib.compress(held[p * size : (p + 1) * size].astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), 1) for p in range(PARTS)]
            yield pa.RecordBatch.from_arrays([pa.array(range(PARTS), pa.int32()), pa.array(rows, pa.binary())], names=["part", "counts"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for part, packed in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                planes = np.frombuffer(zlib.decompress(packed), dtype=np.uint8).reshape(4, -1)
                sums.setdefault(part, np.zeros(size, dtype=np.uint64))[:] += np.ascontiguousarray(planes.T).view("<u4").ravel()
        for part, total in sums.items():
            classes = (16 * np.log2(total + 1.0)).astype("<u2")
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([zlib.compress(classes.tobytes(), 1)], pa.binary())], names=["part", "classes"])

    parts = docs.select("node", "text").mapInArrow(local, "part int, counts binary")
    out = np.zeros(counters, dtype=np.uint16)
    for r in parts.repartition(PARTS, "part").mapInArrow(merge, "part int, classes binary").toLocalIterator():
        out[r["part"] * size : (r["part"] + 1) * size] = np.frombuffer(zlib.decompress(r["classes"]), dtype="<u2")
    return out


def _first(m: np.ndarray, share: float) -> np.ndarray:
    return m - np.ceil(share * m - 1e-9).astype(np.int64) + 1


def prefix_keys(docs: DataFrame, k: int, similarity: float, classes: np.ndarray) -> DataFrame:
    """(key, v, m, pos) from rows (node, text): the first shingles of each set; m is its size, pos the place in the order."""
    sent = docs.sparkSession.sparkContext.broadcast(classes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank = sent.value
        for b in text.slices(batches):
            h, starts = shingles([normal(x) for x in b.column(1).cast(pa.binary()).to_pylist()], k)
            of = np.repeat(np.arange(b.num_rows), np.diff(starts))
            order = np.lexsort((h, rank[(h & _U(len(rank) - 1)).astype(np.int64)], of))
            h, of = h[order], of[order]
            new = np.ones(len(h), dtype=bool)
            new[1:] = (h[1:] != h[:-1]) | (of[1:] != of[:-1])
            h, of = h[new], of[new]
            m = np.bincount(of, minlength=b.num_rows)
            pos = np.arange(len(h)) - np.repeat(np.cumsum(m) - m, m)
            own = pos < _first(m, similarity)[of]
            node = b.column(0).to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(h[own].view(np.int64)), pa.array(node[of[own]]), pa.array(m[of[own]].astype(np.int32)), pa.array(pos[own].astype(np.int32))], names=["key", "v", "m", "pos"])

    return docs.select("node", "text").mapInArrow(run, "key long, v long, m int, pos int")


def parities(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """(texts, PARITIES) bits that tell whether a part of each set of distinct hashes has an odd number of them."""
    n, bits = len(starts) - 1, 64 * PARITIES
    part = np.repeat(np.arange(n), np.diff(starts)) * bits + (hashes >> _U(64 - bits.bit_length() + 1)).astype(np.int64)
    odd = (np.bincount(part, minlength=n * bits) & 1).astype(np.uint8).reshape(n, bits)
    return np.packbits(odd, axis=1, bitorder="little").view("<i8")


def folded(docs: DataFrame, k: int) -> DataFrame:
    """(node, y0, y1, ...) from (node, text): the parities folded to FOLDED longs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text.slices(batches):
            h, starts = shingles([normal(x) for x in b.column(1).cast(pa.binary()).to_pylist()], k)
            sets = [np.unique(h[a:z]) for a, z in zip(starts, starts[1:])]
            odd = parities(np.concatenate(sets), np.concatenate([[0], np.cumsum([len(x) for x in sets])]))
            odd = np.bitwise_xor.reduce(odd.reshape(len(sets), -1, FOLDED), axis=1)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(np.ascontiguousarray(odd[:, j])) for j in range(FOLDED))], names=["node", *(f"y{j}" for j in range(FOLDED))])

    return docs.select("node", "text").mapInArrow(run, "node long, " + ", ".join(f"y{j} long" for j in range(FOLDED)))


def shingle_sets(docs: DataFrame, k: int) -> DataFrame:
    """(node, m, x0, x1, ..., shingles) from (node, text): size, parities and each distinct shingle once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text.slices(batches):
            h, starts = shingles([normal(x) for x in b.column(1).cast(pa.binary()).to_pylist()], k)
            sets = [np.unique(h[a:z]) for a, z in zip(starts, starts[1:])]
            m = np.array([len(x) for x in sets])
            odd = parities(np.concatenate(sets), np.concatenate([[0], np.cumsum(m)]))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(m.astype(np.int32)), *(pa.array(np.ascontiguousarray(odd[:, j])) for j in range(PARITIES)), pa.array([x.view(np.int64) for x in sets], pa.list_(pa.int64()))],
                names=["node", "m", *(f"x{j}" for j in range(PARITIES)), "shingles"],
            )

    return docs.select("node", "text").mapInArrow(run, "node long, m int, " + "".join(f"x{j} long, " for j in range(PARITIES)) + "shingles array<long>")


def by_ids(docs: DataFrame, ids: DataFrame, how: str, node: str = "node") -> DataFrame:
    """Rows of ``docs`` whose node is (left_semi) or is not (left_anti) in the written list ``ids`` (q)."""
    few = ids.count() <= BROADCAST_IDS
    return docs.join(F.broadcast(ids) if few else ids, docs[node] == ids["q"], how)


def _near(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """A written table of the pairs (u, v) whose sizes and parities allow the similarity."""
    odd = [f"x{j}" for j in range(PARITIES)]
    a, b = (sets.select(F.col("node").alias(x), *(F.col(c).alias(f"{x}_{c}") for c in ("m", *odd))) for x in "ab")
    m, n = F.col("a_m"), F.col("b_m")
    differ = sum((F.bit_count(F.col(f"a_{c}").bitwiseXOR(F.col(f"b_{c}"))) for c in odd), F.lit(0))
    near = (F.least(m, n) >= similarity * F.greatest(m, n) - 1e-9) & (differ <= (1 - similarity) / (1 + similarity) * (m + n) + 1e-9)
    return store.table(pairs.join(a, F.col("u") == F.col("a")).join(b, (F.col("v") == F.col("b")) & near).select("u", "v"), "near")


def _similar(near: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """A written table of the pairs (u, v) whose whole sets are as similar.

    Pairs of up to BROADCAST_IDS ids are broadcast, so that only sets of these pairs are shuffled, to meet at v.
    """
    a, b = (sets.select(F.col("node").alias(x), F.col("shingles").alias(f"of_{x}")) for x in "ab")
    if 2 * near.count() <= BROADCAST_IDS:
        b = b.join(F.broadcast(near.select(F.col("v").alias("q")).distinct()), F.col("b") == F.col("q"), "left_semi")
        near = F.broadcast(near)
    both = near.join(a, F.col("u") == F.col("a")).join(b, F.col("v") == F.col("b"))
    common = F.size(F.array_intersect("of_a", "of_b"))
    both = both.select("u", "v", common.alias("common"), (F.size("of_a") + F.size("of_b")).alias("total"))
    return store.table(both.filter(F.col("common") >= similarity * (F.col("total") - F.col("common")) - 1e-9).select("u", "v"), "links")


def _may(similarity: float) -> Column:
    """Whether the sizes, the places of the first shared shingle and the folded parities of a row and another one allow the similarity."""
    m, n, i, j = (F.col(c) for c in ("m", "m2", "pos", "pos2"))
    sizes = F.least(m, n) >= similarity * F.greatest(m, n) - 1e-9
    differ = sum((F.bit_count(F.col(f"y{j}").bitwiseXOR(F.col(f"y{j}_2"))) for j in range(FOLDED)), F.lit(0))
    return sizes & (differ <= (1 - similarity) / (1 + similarity) * (m + n) + 1e-9) & (F.least(m - i, n - j) >= similarity / (1 + similarity) * (m + n) - 1e-9)


def components(docs: DataFrame, start: DataFrame | None, k: int, similarity: float) -> DataFrame | None:
    """(node, component) of linked nodes of rows (node, text) with distinct texts; None if nothing is linked.

    ``start``: pairs (u, v) of nodes to be compared besides those of the prefix keys.
    """
    links = comp = None
    made: list[DataFrame] = []

    def verify(near: DataFrame, sets: DataFrame) -> None:
        nonlocal links, comp
        new = _similar(near, sets, similarity)
        if not new.isEmpty():
            links = new if links is None else links.unionByName(new)
            store.drop(comp)
            comp = graph.components(links)
            made.append(new)
        else:
            store.drop(new)

    def link(pairs: DataFrame) -> None:
        nonlocal start
        pairs = store.table((pairs if start is None else pairs.unionByName(start)).distinct(), "pairs")
        start = None
        members = store.table(pairs.select(F.col("u").alias("q")).distinct().unionByName(pairs.select(F.col("v").alias("q")).distinct()).distinct(), "members")
        sets = store.table(shingle_sets(by_ids(docs, members, "left_semi"), k), "sets")
        near = _near(pairs, sets, similarity)
        # One pair for each member first, and then what is not yet in one component.
        first = store.table(near.groupBy("v").agg(F.min("u").alias("u")).select("u", "v"), "near")
        verify(first, sets)
        rest = first
        if comp is not None:
            of = [comp.select(F.col("node").alias(f"n{x}"), F.col("component").alias(f"c{x}")) for x in "uv"]
            rest = near.join(of[0], F.col("u") == F.col("nu"), "left").join(of[1], F.col("v") == F.col("nv"), "left")
            rest = store.table(rest.filter(F.coalesce("cu", "u") != F.coalesce("cv", "v")).select("u", "v"), "near")
            verify(rest, sets)
        else:
            verify(near, sets)
        store.drop(pairs, members, sets, near, first, rest)

    keys = store.table(prefix_keys(docs, k, similarity, frequencies(docs, k)), "keys")
    # A key is of use from two members on, of which one has it among the first of a smaller set.
    early = F.col("pos") <= F.col("m") - F.ceil(2 * similarity / (1 + similarity) * F.col("m") - 1e-9)
    sizes = keys.groupBy("key").agg(F.count("*").alias("n"), F.max(early).alias("e")).filter("n > 1 AND e").select(F.col("key").alias("q"))
    bare = store.table(keys.join(sizes, F.col("key") == F.col("q"), "left_semi").withColumn("early", early), "bare")
    members = store.table(bare.select(F.col("v").alias("q")).distinct(), "members")
    odd = store.table(folded(by_ids(docs, members, "left_semi"), k), "odd")
    ys = [f"y{j}" for j in range(FOLDED)]
    shared = store.table(bare.join(odd, F.col("v") == F.col("node")).select("key", "v", "m", "pos", "early", *ys), "shared")
    store.drop(keys, bare, members, odd)
    n_rows, turn = shared.count(), 1
    while True:
        label = shared.withColumn("c", F.col("v")) if comp is None else shared.join(comp, shared.v == comp.node, "left").select("key", "v", "m", "pos", "early", *ys, F.coalesce("component", "v").alias("c"))
        by = label.groupBy("key", "c").agg(F.count("*").alias("n"), F.sum(F.col("early").cast("long")).alias("e"))
        counts = by.groupBy("key").agg(F.sum("n").alias("n"), F.sum("e").alias("e"), F.sum(F.col("n").cast("double") * F.col("e")).alias("own"), F.count("*").alias("comps"))
        # A key whose members are in one component needs no more comparison.
        open_ = store.table(counts.filter("comps > 1 AND e > 0").select(F.col("key").alias("q"), (F.col("n").cast("double") * F.col("e") - F.col("own")).alias("left")), "open")
        left = open_.agg(F.sum("left")).first()[0] or 0
        if not left:
            if start is not None:
                link(start.limit(0))
            store.drop(open_)
            break
        last = left <= PAIRWISE * n_rows or turn > ROUNDS
        # Before the first link every key is open.
        some = label if comp is None else store.table(label.join(open_, F.col("key") == F.col("q"), "left_semi"), "label")
        if last:
            other = some.select(F.col("key").alias("q"), F.col("v").alias("v2"), F.col("m").alias("m2"), F.col("pos").alias("pos2"), F.col("c").alias("c2"), *(F.col(y).alias(f"{y}_2") for y in ys))
            smaller = (F.col("m") < F.col("m2")) | (F.col("m") == F.col("m2")) & (F.col("v") < F.col("v2"))
            pairs = some.filter("early").join(other, (F.col("key") == F.col("q")) & (F.col("c") != F.col("c2")) & smaller & _may(similarity))
            pairs = pairs.select(F.least("v", "v2").alias("u"), F.greatest("v", "v2").alias("v"))
        else:
            pivot = some.groupBy("key").agg(F.min_by(F.struct("v", "m", "pos", "c", *ys), F.struct(F.xxhash64("v", F.lit(turn)), "v")).alias("p")).select(F.col("key").alias("q"), F.col("p.v").alias("v2"), F.col("p.m").alias("m2"), F.col("p.pos").alias("pos2"), F.col("p.c").alias("c2"), *(F.col(f"p.{y}").alias(f"{y}_2") for y in ys))
            tied = some.join(pivot, (F.col("key") == F.col("q")) & (F.col("c") != F.col("c2")) & _may(similarity))
            # Two comparisons for each member and round.
            order = F.struct(F.xxhash64("v2", F.lit(turn)), "v2")
            pairs = tied.groupBy("v").agg(F.array(F.min_by("v2", order), F.max_by("v2", order)).alias("w")).select("v", F.explode("w").alias("w")).select(F.least("v", "w").alias("u"), F.greatest("v", "w").alias("v"))
        link(pairs)
        turn += 1
        store.drop(open_, some)
        if last:
            break
    store.drop(shared, *made)
    return comp
