"""Near duplicates by SimHash fingerprints, searched with Golay-code keys.

A 64-bit fingerprint is cut into segments of 23, 23 and 18 bits. Where two
fingerprints differ in at most 2 bits, the pigeonhole principle gives a cyclic
pair of neighbouring segments of which the first is equal and the second
differs in at most one bit:

    errors (2,0,0) (1,0,1): segments 2, 3   (0,0,2) (0,1,1) (0,0,0): 1, 2
    errors (0,2,0) (1,1,0): segments 3, 1

So each fingerprint gets, for each of the three pairs, the first segment along
with the indices of all Golay codewords near the second. Two fingerprints to be
linked share one of these keys. Members of a key are joined and verified.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import golay, graph, similar, store, text

SHINGLE = 3
SEED = 42
DISTANCE = 2
#: Members of a key that are compared pairwise; larger keys are settled by midpoints.
PAIRWISE = 32


def fingerprint(raw: bytes, k: int = SHINGLE, seed: int = SEED) -> int:
    """Unsigned SimHash of a text's UTF-8 bytes; 0 if it has no word."""
    parts = raw.lower().split()  # bytes: only A-Z are lowered, only 0x20 and 0x09-0x0D split
    if not parts:
        return 0
    joined = b" ".join(parts)
    digest = xxhash.xxh64_intdigest
    if len(parts) <= k:
        hashes = np.array([digest(joined, seed)], dtype=np.uint64)
    else:
        gaps = np.flatnonzero(np.frombuffer(joined, dtype=np.uint8) == 32)
        starts = [0, *(gaps + 1).tolist()]
        ends = [*gaps.tolist(), len(joined)]
        hashes = np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts, ends[k - 1 :])), dtype=np.uint64, count=len(parts) - k + 1)
    n = len(hashes)
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, n, 1 << 16):
        part = hashes[at : at + (1 << 16)]
        ones += np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(sum(1 << i for i in np.flatnonzero(2 * ones > n).tolist()))


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", column: str = "text") -> DataFrame:
    """(doc_id, fp) for each row; fp is the fingerprint as a signed long. Null texts count as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text.slices(batches):
            fps = [fingerprint(x or b"") for x in b.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.array(fps, dtype=np.uint64).view(np.int64))], names=["doc_id", "fp"])

    rows = text.small_batches(docs).select(F.col(doc_id).cast("long").alias("doc_id"), F.col(column).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, fp long")


def golay_keys(fps: DataFrame) -> DataFrame:
    """(fp, pair, code) for each distinct fingerprint and key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = b.column(0).to_numpy()
            u = fp.view(np.uint64)
            seg = [(u >> np.uint64(a) & np.uint64((1 << n) - 1)).astype(np.int64) for a, n in ((0, 23), (23, 23), (46, 18))]
            for pair, (i, j) in enumerate(((0, 1), (1, 2), (2, 0))):
                codes = golay.near(seg[j])
                for k in range(codes.shape[1]):
                    has = codes[:, k] != golay.NONE
                    code = seg[i][has] << 14 | codes[has, k] << 2 | pair
                    yield pa.RecordBatch.from_arrays([pa.array(fp[has]), pa.array(code)], names=["fp", "key"])

    return fps.select("fp").mapInArrow(run, "fp long, key long")


def links(fps: DataFrame) -> DataFrame:
    """Edges (u, v) between distinct fingerprints that connect exactly those within DISTANCE bits.

    Keys of at most PAIRWISE members are compared pairwise. Larger keys, as
    thousands of near copies make, are settled without pairs: two fingerprints
    are within 2 bits if and only if both are within 1 bit of some word, so all
    members are tied to the least member around each such word. No link is
    dropped and none is added in either way.
    """
    keys = store.table(golay_keys(fps), "golay")
    sizes = keys.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").withColumnRenamed("key", "k")
    shared = store.table(keys.join(sizes, keys.key == sizes.k).select("fp", "key", "n"), "golay")
    store.drop(keys)
    near = F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= DISTANCE
    lists = shared.filter(F.col("n") <= PAIRWISE).groupBy("key").agg(F.sort_array(F.collect_list("fp")).alias("f"))
    pairs = (
        lists.select("f", F.posexplode("f").alias("i", "u"))
        .select("u", F.explode(F.filter(F.slice("f", F.col("i") + 2, PAIRWISE), lambda v: F.bit_count(F.col("u").bitwiseXOR(v)) <= DISTANCE)).alias("v"))
        .filter(near)
    )
    large = shared.filter(F.col("n") > PAIRWISE).select("fp").distinct()
    around = F.concat(F.array("fp"), F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.col("fp").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i))))
    spots = large.select("fp", F.explode(around).alias("spot"))
    least = spots.groupBy("spot").agg(F.min("fp").alias("u"))
    stars = spots.join(least, "spot").select("u", F.col("fp").alias("v")).filter("u <> v").filter(near)
    out = store.table(pairs.unionByName(stars).distinct(), "links")
    store.drop(shared)
    return out


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", column: str = "text") -> DataFrame:
    """One row for each input row: (doc_id, fingerprint, fp, component_id).

    component_id is the least doc_id that is reachable over links of
    fingerprints within DISTANCE bits. Rows with equal texts, equal
    fingerprints or no words (fingerprint zero) are linked. Null texts count as
    empty; rows with a null doc_id take part but name no component unless
    alone (then null). Repeated rows are kept. An empty table gives an empty one.
    Other columns are ignored.
    """
    rows = store.table(fingerprints(docs, doc_id, column), "fingerprints")
    distinct = store.table(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    comp = graph.components(links(distinct))
    named = distinct.join(comp, distinct.fp == comp.node, "left").select(F.col("fp").alias("f"), "least", F.coalesce("component", "fp").alias("c"))
    ids = named.groupBy("c").agg(F.min("least").alias("component_id")).withColumnRenamed("c", "c2")
    label = named.join(ids, named.c == ids.c2).select("f", "component_id")
    out = rows.join(label, rows.fp == label.f)
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "fp", "component_id")


def _kept_by_fingerprint(base: DataFrame, rid: str, doc_id: str, column: str) -> DataFrame:
    """(kept): the first row of each component of near fingerprints."""
    rows = near_duplicates(base.select(F.col(rid).alias("doc_id"), F.col(column).alias("text")), "doc_id", "text")
    rank = F.struct(F.col(doc_id).isNull().alias("a"), F.col(doc_id).alias("b"), F.col(rid).alias("c"))
    member = base.select(rid, rank.alias("r")).join(rows.select(F.col("doc_id").alias("f"), F.col("component_id").alias("comp")), F.col(rid) == F.col("f"))
    return member.groupBy("comp").agg(F.min("r").alias("r")).select(F.col("r.c").alias("kept"))


def _signed(rows: DataFrame, k: int) -> DataFrame:
    """(rid, same, fp) from (rid, text): a digest of the words and the fingerprint of the k-word shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text.slices(batches):
            texts = [similar.normal(x) for x in b.column(1).cast(pa.binary()).to_pylist()]
            fp = similar.fingerprints(*similar.shingles(texts, k))
            same = pa.array([hashlib.blake2b(t, digest_size=16).digest() for t in texts], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), same, pa.array(fp.view(np.int64))], names=["rid", "same", "fp"])

    return rows.mapInArrow(run, "rid long, same binary, fp long")


def _kept_by_similarity(base: DataFrame, rid: str, doc_id: str, column: str, k: int, similarity: float) -> DataFrame:
    """(kept): the first row of each component of texts whose k-word shingles have this Jaccard similarity."""
    rows = base.select(F.col(rid).alias("rid"), F.col(column).cast("string").alias("text"))
    signed = store.table(_signed(rows, k), "signed")
    rank = base.select(F.col(rid).alias("r0"), F.struct(F.col(doc_id).isNull().alias("a"), F.col(doc_id).alias("b"), F.col(rid).alias("c")).alias("r"))
    groups = signed.join(rank, F.col("rid") == F.col("r0")).groupBy("same").agg(F.min("rid").alias("node"), F.min("r").alias("r"), F.min("fp").alias("fp"))
    distinct = store.table(groups.select("node", "r", "fp"), "distinct")
    copies = store.table(signed.select(F.col("rid").alias("q")).join(distinct, F.col("q") == F.col("node"), "left_anti"), "copies")
    store.drop(signed)
    unique = similar.by_ids(rows.withColumnRenamed("rid", "node"), copies, "left_anti")
    # The Golay search: texts whose fingerprints are near, as pairs of texts.
    own = store.table(distinct.groupBy("fp").agg(F.min("node").alias("least")), "own")
    near = links(own)
    a, b = (own.select(F.col("fp").alias(f"f{x}"), F.col("least").alias(x)) for x in "uv")
    found = near.select(F.col("u").alias("x"), F.col("v").alias("y")).join(a, F.col("x") == F.col("fu")).join(b, F.col("y") == F.col("fv")).select("u", "v")
    equal = distinct.select("node", F.col("fp").alias("f")).join(own, (F.col("f") == F.col("fp")) & (F.col("node") != F.col("least"))).select(F.col("least").alias("u"), F.col("node").alias("v"))
    comp = similar.components(unique, found.unionByName(equal).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")), k, similarity)
    first = distinct.select("node", "r")
    if comp is not None:
        label = comp.select(F.col("node").alias("q"), "component")
        first = first.join(label, F.col("node") == F.col("q"), "left").groupBy(F.coalesce("component", "node").alias("c")).agg(F.min("r").alias("r"))
    out = store.table(first.select(F.col("r.c").alias("kept")), "kept")
    store.drop(copies, own, near, distinct, comp)
    return out


def keep_one(docs: DataFrame, doc_id: str = "doc_id", column: str = "text", k: int = SHINGLE, similarity: float | None = None) -> DataFrame:
    """Keeps one row of each component of near duplicates: the first by doc_id, and any of those with equal ids.

    Without ``similarity`` rows are linked as in :func:`near_duplicates` (k is SHINGLE there). With it they are linked if their
    sets of ``k``-word shingles have that Jaccard similarity or more, which is verified on whole sets: pairs
    found by Golay keys come first, and :mod:`similar` finds all others.
    All columns are returned as they are. Rows with equal words, or without any, are
    near duplicates; null texts count as empty. Rows with a null doc_id come last
    within a component. Repeated rows are one component. A text of any length is taken whole, in one task. An empty table gives an empty one.
    """
    rid = "__nd_rid"
    base = store.table(text.small_batches(docs).withColumn(rid, F.monotonically_increasing_id()), "docs")
    if similarity is None:
        if k != SHINGLE:
            raise ValueError("fingerprints alone take SHINGLE words")
        kept = _kept_by_fingerprint(base, rid, doc_id, column)
    else:
        kept = _kept_by_similarity(base, rid, doc_id, column, k, similarity)
    # The rows to be left out are fewer than those kept, and a broadcast list of them spares the texts a shuffle.
    out = store.table(base.select(F.col(rid).alias("q")).join(kept, F.col("q") == F.col("kept"), "left_anti"), "out")
    store.drop(kept)
    return similar.by_ids(base, out, "left_anti", rid).drop(rid)
