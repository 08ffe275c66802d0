"""Cost-balanced packing of token sequences.

Each task packs its documents in groups of about ``GROUP_TOKENS`` tokens, so
there is no shuffle and memory is bounded by a group and one document. In a
group:

1. Each document is cut into pieces of a whole sequence and a remainder.
2. A remainder of n tokens costs ``linear * n + quadratic * n * n``, as attention
   does.
3. There are as many sequences as the tokens need, rounded up. Remainders, from
   the costliest down, each go to the sequence of the lowest cost that has
   room. What fits nowhere whole is cut over the sequences with most room.

So all but one sequence of a group are full, and less than one sequence is padding.
"""

from __future__ import annotations

import heapq
import json
import os
import re
import zlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text

CAPACITY = 1024
GROUP_TOKENS = 1 << 20
END_ID = 0
#: Cost of a piece of n tokens: LINEAR * n + QUADRATIC * n * n. The linear term stands for the layers besides attention.
LINEAR, QUADRATIC = 1.0, 1.0 / 512
#: Bytes of text whose chunks are looked up together.
SLICE = 2 << 20
#: Chunks whose ids are put in place together.
PART = 1 << 16
#: Distinct chunks of text whose ids a worker remembers; beyond it, it starts anew.
REMEMBER = 1 << 17

#: White space followed by a space: there, not every space starts a chunk.
_UNEVEN = "[\\s\\x{0B}\\x{1C}-\\x{1F}\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}] "
_BREAK = re.compile(r"(?<=\S) (?=\S)")
#: How the vocabulary cuts a text before merging (fixed values of byte-level BPE).
_PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _ranks(path: str) -> dict[bytes, int]:
    """Merge ranks of the byte-level vocabulary in a tokenizers file: its ids, without added tokens."""
    held = json.loads(Path(path).read_text(encoding="utf-8"))
    added = {x["content"] for x in held["added_tokens"]}
    # Byte-level vocabularies write printable bytes as themselves and the others as code points from 256 on.
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}
    return {bytes(byte[c] for c in token): i for token, i in held["model"]["vocab"].items() if token not in added}


class Encoder:
    """Token ids of whole texts, as the tokenizers library gives them.

    A byte-level BPE never merges over the start of white space that follows
    other text. So texts are cut there, each distinct chunk of a batch is looked up
    once, and the ids of chunks are remembered. Chunks that are not known are
    encoded with the same merges by tiktoken, which is several times as fast for
    short strings; those that may hold a special token by tokenizers itself.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.ordinary = tiktoken.Encoding("chunks", pat_str=_PIECES, mergeable_ranks=_ranks(path), special_tokens={}).encode_ordinary
        self.known: dict[str, bytes] = {}

    def chunk(self, value: str) -> bytes:
        ids = self.known.get(value)
        if ids is None:
            if len(self.known) >= REMEMBER:
                self.known.clear()
            found = self.tokenizer.encode(value, add_special_tokens=False).ids if "<|" in value else self.ordinary(value)
            ids = np.array(found, dtype="<u4").tobytes()
            if len(value) <= 64:
                self.known[value] = ids
        return ids

    def __call__(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, each text followed by END_ID, and the texts' ends."""
        column = pc.fill_null(column.cast(pa.large_string()), "")
        uneven = pc.match_substring_regex(column, _UNEVEN).to_numpy(zero_copy_only=False)
        split = pc.split_pattern(column, " ")
        for_even = pc.dictionary_encode(split.flatten())
        codes = for_even.indices.to_numpy()
        bounds = split.offsets.to_numpy() - split.offsets[0].as_py()
        del split
        table: list[bytes] = [self.chunk(" " + x) for x in for_even.dictionary.to_pylist()]
        heads: dict[str, int] = {}

        def own(value: str) -> int:
            if value not in heads:
                heads[value] = len(table)
                table.append(self.chunk(value) if value else b"")
            return heads[value]

        end = len(table)
        table.append(np.array([END_ID], dtype="<u4").tobytes())
        parts, ends = [], np.zeros(len(column), dtype=np.int64)
        firsts = for_even.dictionary.take(pa.array(codes[bounds[:-1]])).to_pylist()
        for i, head in enumerate(firsts):
            if uneven[i]:
                first, *later = _BREAK.split(column[i].as_py())
                parts.append(np.array([own(first), *(own(" " + x) for x in later)], dtype=np.int32))
            else:
                seg = codes[bounds[i] : bounds[i + 1]].copy()
                seg[0] = own(head)
                parts.append(seg)
            parts.append(np.array([end], dtype=np.int32))
            ends[i] = len(parts[-2]) + 1
        order = np.concatenate(parts)
        stops = np.cumsum(ends)
        del parts, codes, for_even
        sizes = np.fromiter(map(len, table), dtype=np.int64, count=len(table)) // 4
        flat = np.frombuffer(b"".join(table), dtype="<u4")
        del table
        at = np.cumsum(sizes) - sizes
        n = sizes[order]
        stop = np.cumsum(n)
        # A part at a time: places take twice the bytes of ids.
        ids, edges = np.empty(stop[-1], dtype="<u4"), [*range(0, len(order), PART), len(order)]
        for a, z in zip(edges, edges[1:]):
            first, last = stop[a] - n[a], stop[z - 1]
            place = np.repeat(at[order[a:z]] - (stop[a:z] - n[a:z]), n[a:z])
            place += np.arange(first, last)
            ids[first:last] = flat[place]
        return ids, stop[stops - 1]


def pack(lengths: list[int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Packs documents of these lengths (each 1 or more): pieces (document, start, length, sequence, offset)."""
    pieces: list[tuple[int, int, int, int, int]] = []
    total = sum(lengths)
    n_seq = -(-total // capacity)
    rest: list[tuple[int, int, int]] = []
    seq = 0
    for i, n in enumerate(lengths):
        whole = n // capacity * capacity
        for at in range(0, whole, capacity):
            pieces.append((i, at, capacity, seq, 0))
            seq += 1
        if n > whole:
            rest.append((n - whole, i, whole))
    rest.sort(key=lambda r: (-r[0], r[1]))
    first = seq
    used = [0] * (n_seq - first)
    heap = [(0.0, s) for s in range(len(used))]
    late: list[tuple[int, int, int]] = []
    for n, i, start in rest:
        aside = []
        while heap and used[heap[0][1]] + n > capacity:
            aside.append(heapq.heappop(heap))
        if heap:
            cost, s = heapq.heappop(heap)
            pieces.append((i, start, n, first + s, used[s]))
            used[s] += n
            if used[s] < capacity:
                heapq.heappush(heap, (cost + LINEAR * n + QUADRATIC * n * n, s))
        else:
            late.append((n, i, start))
        for x in aside:
            # Remainders come in descending order: a sequence without room for this one may have room for a later one.
            heapq.heappush(heap, x)
    room = [(used[s] - capacity, s) for s in range(len(used)) if used[s] < capacity]
    heapq.heapify(room)
    for n, i, start in late:
        while n:
            free, s = heapq.heappop(room)
            take = min(n, -free)
            pieces.append((i, start, take, first + s, used[s]))
            used[s] += take
            n, start = n - take, start + take
            if used[s] < capacity:
                heapq.heappush(room, (used[s] - capacity, s))
    return pieces


_SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def pack_documents(docs: DataFrame, tokenizer_path: str, doc_id: str = "doc_id", column: str = "text", capacity: int = CAPACITY, group_tokens: int = GROUP_TOKENS) -> DataFrame:
    """Packs all documents; one row for each piece.

    Columns: doc_id, start (ids of the document before the piece), length, ids
    (little-endian unsigned 32-bit), doc_tokens (with the end id),
    sequence_id, offset (in the sequence, gapless from 0). Null texts count as
    empty: one end id. A null doc_id stays null; repeated rows are packed once
    each. An empty table gives an empty result. Other columns are ignored.
    sequence_id holds the task's partition in its upper bits.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer_path)
        base, n_seq = TaskContext.get().partitionId() << 40, 0
        names: list[int | None] = []
        ids: list[bytes] = []
        held = 0

        def flush() -> pa.RecordBatch:
            nonlocal n_seq, held
            lengths = [len(x) // 4 for x in ids]
            found = pack(lengths, capacity)
            cols = list(zip(*found, strict=True))
            out = pa.RecordBatch.from_arrays(
                [
                    pa.array([names[i] for i in cols[0]], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()),
                    pa.array([ids[i][4 * a : 4 * (a + n)] for i, a, n, _, _ in found], pa.binary()),
                    pa.array([lengths[i] for i in cols[0]], pa.int64()), pa.array(base + n_seq + np.array(cols[3], dtype=np.int64)), pa.array(cols[4], pa.int64()),
                ],
                names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"],
            )
            n_seq += max(cols[3]) + 1
            names.clear()
            ids.clear()
            held = 0
            return out

        for b in text.slices(batches, most=SLICE):
            every, ends = encoder(b.column(1))
            raw, begin = every.tobytes(), 0
            for d, stop in zip(b.column(0).to_pylist(), ends.tolist(), strict=True):
                names.append(d)
                ids.append(raw[4 * begin : 4 * stop])
                held += stop - begin
                begin = stop
                if held >= group_tokens:
                    yield flush()
        if held:
            yield flush()

    return text.small_batches(docs).select(F.col(doc_id).cast("long").alias("doc_id"), F.col(column).cast("string").alias("text")).mapInArrow(run, _SCHEMA)


_ENCODERS: dict[str, Encoder] = {}


def _encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _ENCODERS.clear()
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def digest(pieces: DataFrame) -> DataFrame:
    """Replaces ids by their CRC-32 (unsigned)."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def crc(ids: bytes) -> int:
    return zlib.crc32(ids)
