"""Secrets: base patterns, and values in credential contexts that are costly to guess.

The guess cost of a value is the cheapest way to write it as a row of segments:
known words, years and dates, repeats, keyboard walks and brute-force
characters. It is a dynamic program over positions, in log10 of guesses. Known words are
common parts of passwords and then the most frequent words of the corpus, by rank. A value after a
credential name that costs MIN_COST or more is a secret, whether or not the base patterns match (a part of) it.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import store, text

KINDS = ("assign", "access", "hex")
ADDED = "guess"
#: log10 of guesses: a hundred million.
MIN_COST = 8.0
#: Words of the corpus that are known, the most frequent ones: about 2 MB are broadcast.
CORPUS_WORDS = 50_000

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
#: Names of credentials, beyond those of the base pattern, with a separator and a value of printable characters.
_CONTEXT = re.compile(
    r"""(?<![A-Za-z0-9])(?:pass(?:word|wd|phrase|code)?|pwd|pw|secret(?:_?key)?|token|auth(?:_?(?:key|token))?|bearer|api[_-]?key|access[_-]?key|private[_-]?key|client[_-]?secret|credentials?|login|pin)["']?(?:\x20*(?:[:=]|=>)\x20*|\x20+is\x20+)["']?([\x21-\x7E]{6,})""",
    re.I | re.A,
)
_HINT = re.compile(r"pass|pwd|pw|secret|token|auth|bearer|key|credential|login|pin", re.I | re.A)

#: Common parts of passwords, the most common first.
WORDS = (
    "password pass the and for you love admin user root test demo guest login welcome hello master monkey dragon shadow sunshine princess "
    "football baseball soccer hockey summer winter spring autumn monday friday sunday january march april june july august october december "
    "secret token key access server system change default public private home work office house money power happy lucky angel star super "
    "computer internet network windows linux apple google orange banana cookie flower purple yellow green blue black white silver golden "
    "tiger lion eagle wolf horse cat dog bird fish bear king queen prince baby girl boy man woman mother father brother sister family friend "
    "michael jordan daniel thomas robert william charlie andrew joshua matthew jennifer jessica ashley nicole george maggie ginger pepper "
    "example sample changeme letmein iloveyou trustno qwerty abc"
).split()
#: Rows of a keyboard.
ROWS = ("`1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./", "abcdefghijklmnopqrstuvwxyz", "0123456789")
_NEXT = frozenset(p for row in ROWS for a, b in zip(row, row[1:]) for p in (a + b, b + a))
_PLAIN = str.maketrans("@430$5!17", "aaeossiit")
_DATE = re.compile(r"(?:19|20)\d\d(?:[-/.]?(?:0[1-9]|1[0-2])(?:[-/.]?(?:0[1-9]|[12]\d|3[01]))?)?", re.A)


def _brute(c: str) -> float:
    if c.isdigit():
        return 1.0
    return math.log10(26) if c.isascii() and c.isalpha() else math.log10(33)


class _Runs:
    """The cheapest start of a run that ends here: least best[a] + log10(end - a) over all starts a of three items or more.

    A start is given up once another one is cheaper at this and every later end; few are left at any time.
    """

    def __init__(self) -> None:
        self.starts: list[tuple[int, float]] = []

    def add(self, a: int, cost: float) -> None:
        if all(c + math.log10((a + 3 - x) / 3) > cost for x, c in self.starts):
            self.starts = [(x, c) for x, c in self.starts if c < cost]
            self.starts.append((a, cost))

    def least(self, end: int) -> float:
        return min((c + math.log10(end - a) for a, c in self.starts), default=math.inf)


class Guesser:
    """Guess costs with known words, the easiest to guess first."""

    def __init__(self, words: Sequence[str] = ()):
        self.rank = {w: i + 1 for i, w in enumerate(dict.fromkeys([*WORDS, *words]))}
        self.longest = max(map(len, self.rank))

    def word(self, value: str, low: str, plain: str, a: int, i: int) -> float:
        """Cost of value[a:i] as a known word; letters written as digits or marks take four times the guesses, upper case twice."""
        rank = self.rank.get(low[a:i])
        if rank is None and (rank := self.rank.get(plain[a:i])) is not None:
            rank *= 4
        return math.inf if rank is None else math.log10(rank * (2 if value[a:i] != low[a:i] else 1) + 1)

    def cost(self, value: str) -> float:
        """log10 of the guesses that the cheapest segmentation needs; 0 for an empty value.

        Mixed case in a brute-force span costs twice the guesses for each letter.
        Each segment costs one more decision (a factor of four).
        """
        n = len(value)
        low = value.lower()
        plain = low.translate(_PLAIN)
        mixed = math.log10(2) if value != low and value != value.upper() else 0.0
        start, walked = math.log10(4), math.log10(len(ROWS) * 12 * 2)
        best = [0.0] + [math.inf] * n
        run = [math.inf] * (n + 1)  # the cheapest way whose last segment is brute force
        repeats, walks = _Runs(), _Runs()
        since_repeat = since_walk = 0  # where the longest repeat and walk that end here began
        for i in range(1, n + 1):
            c = value[i - 1]
            run[i] = min(run[i - 1], best[i - 1] + start) + _brute(c) + (mixed if c.isalpha() else 0.0)
            cost = run[i]
            if i > 1 and low[i - 1] != low[i - 2]:
                repeats, since_repeat = _Runs(), i - 1
            if i > 1 and low[i - 2 : i] not in _NEXT:
                walks, since_walk = _Runs(), i - 1
            if i - 3 >= since_repeat:
                repeats.add(i - 3, best[i - 3])
                cost = min(cost, start + _brute(c) + repeats.least(i))
            if i - 3 >= since_walk:
                walks.add(i - 3, best[i - 3])
                cost = min(cost, start + walked + walks.least(i))
            for a in range(max(0, i - self.longest), i - 2):
                cost = min(cost, best[a] + start + self.word(value, low, plain, a, i))
            for a in (i - 4, i - 6, i - 7, i - 8, i - 9, i - 10):
                if a >= 0 and _DATE.fullmatch(value, a, i):
                    cost = min(cost, best[a] + start + _date(i - a))
            best[i] = cost
        return best[n]


def _date(size: int) -> float:
    return 2.1 if size == 4 else 3.2 if size <= 7 else 4.7


_PLAIN_GUESSER = Guesser()


def guess_cost(value: str) -> float:
    """:meth:`Guesser.cost` with the fixed words only."""
    return _PLAIN_GUESSER.cost(value)


def common_words(docs: DataFrame, column: str = "text", most: int = CORPUS_WORDS) -> list[str]:
    """The most frequent lowered runs of 3 to 24 letters a-z in all whole texts, by count and then by name.

    All words of a count are known or none, so there are at most ``most``: those from the least count on for which that holds.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text.slices(batches):
            data = np.frombuffer(text.utf8(b.column(0))[0].tobytes().lower(), dtype=np.uint8)
            edge = np.flatnonzero(np.diff((data >= 97) & (data <= 122), prepend=False, append=False))
            a, z = edge[0::2], edge[1::2]
            own = (z - a >= 3) & (z - a <= 24)
            found = text.span_array(data, a[own], z[own]).value_counts()
            yield pa.RecordBatch.from_arrays([found.field(0).cast(pa.large_string()).cast(pa.string()), found.field(1)], names=["word", "n"])

    counts = store.table(docs.select(F.col(column).cast("string").alias("text")).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")), "words")
    total, least = 0, None
    for r in counts.groupBy("n").agg(F.count("*").alias("words")).orderBy(F.desc("n")).limit(most).collect():
        total += r["words"]
        if total > most:
            break
        least = r["n"]
    found = [] if least is None else [(-r["n"], r["word"]) for r in counts.filter(F.col("n") >= least).collect()]
    store.drop(counts)
    return [w for _, w in sorted(found)]


def base_spans(t: str) -> list[tuple[str, int, int]]:
    """All base spans (kind, start, end) by start, then kind as in KINDS."""
    out = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(t) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in t:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(t)]
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(t)]
    return [(KINDS[k], a, b) for a, k, b in sorted(out)]


def context_values(t: str, guesser: Guesser = _PLAIN_GUESSER) -> Iterator[tuple[int, int, float]]:
    """Values in credential contexts: start, end and guess cost. Closing quotes and marks are no part of a value."""
    if not _HINT.search(t):
        return
    for m in _CONTEXT.finditer(t):
        value = m[1].rstrip("\"'`,;)]}>")
        if value.endswith((".", "?", "!")):
            value = value[:-1]
        if len(value) >= 6:
            yield m.start(1), m.start(1) + len(value), guesser.cost(value)


def scan(docs: DataFrame, doc_id: str = "doc_id", column: str = "text", min_cost: float = MIN_COST, corpus_words: int = CORPUS_WORDS) -> DataFrame:
    """One row for each input row: (doc_id, base, added, weakest, strongest).

    ``base``: (kind, start, end) by start, then kind. ``added``: values in credential contexts whose
    guess cost reaches ``min_cost``, as (guess, start, end, cost) by start; they may lie inside base spans, and name the value alone.
    ``weakest`` and ``strongest``: least and largest guess cost among all values in
    credential contexts, null without one. Offsets are code points, ends
    exclusive. Null texts count as empty; a null doc_id stays null; repeated rows are
    scanned each and all alike; an empty table gives an empty result; other columns are ignored. A text of any length is taken whole, in one
    task. Known words are counted over all texts first (one shuffle of distinct words); the scan itself has no shuffle.
    """
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
    costed = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("cost", pa.float64())]))
    sent = docs.sparkSession.sparkContext.broadcast(Guesser(common_words(docs, column, corpus_words)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        guesser = sent.value
        for b in text.slices(batches):
            base, added, least, most = [], [], [], []
            for t in b.column(1).to_pylist():
                values = list(context_values(t or "", guesser))
                base.append([{"kind": k, "start": a, "end": z} for k, a, z in base_spans(t or "")])
                added.append([{"kind": ADDED, "start": a, "end": z, "cost": cost} for a, z, cost in values if cost >= min_cost])
                least.append(min((c for *_, c in values), default=None))
                most.append(max((c for *_, c in values), default=None))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(base, span), pa.array(added, costed), pa.array(least, pa.float64()), pa.array(most, pa.float64())], names=["doc_id", "base", "added", "weakest", "strongest"])

    rows = text.small_batches(docs).select(F.col(doc_id).cast("long").alias("doc_id"), F.col(column).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, base array<struct<kind:string,start:int,end:int>>, added array<struct<kind:string,start:int,end:int,cost:double>>, weakest double, strongest double")


def digest(rows: DataFrame) -> DataFrame:
    joined = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    order = F.create_map(*(x for i, k in enumerate((*KINDS, ADDED)) for x in (F.lit(k), F.lit(i))))
    keyed = lambda c: F.transform(c, lambda s: F.struct(s["start"].alias("start"), F.element_at(order, s["kind"]).alias("o"), s["kind"].alias("kind"), s["end"].alias("end")))
    every = F.sort_array(F.concat(keyed("base"), keyed("added")))
    added = F.size("added").cast("long").alias("n_guess")
    return rows.select("doc_id", *(count(k) for k in KINDS), F.sha2(joined("base"), 256).alias("base_sha256"), joined(every).alias("spans"), added, "weakest", "strongest")


def sha(spans: list[tuple[str, int, int]]) -> str:
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()
