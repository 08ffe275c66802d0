"""Personal data: base patterns, and identifiers found by bootstrapped contexts.

1. Base spans (email, ip, card, phone) are found in whole texts; they are the seeds.
2. Identifier-shaped tokens (four digits or more, or an at sign) that no base
   span touches are candidates. Seeds and candidates give edges of a graph between
   instances (hashed tokens, with the kinds that their characters allow) and lexical patterns (hashed words to the left
   and right).
3. Spark scores the graph in rounds. The confidence of a pattern for a kind is the mean score, over the pattern's instances that the
   kind allows, of those that have this kind; it is trusted from a total score of MIN_SEEDS and a confidence of MIN_CONFIDENCE on. An
   unseen instance scores, for each kind that it allows and for which MIN_PATTERNS of its patterns are trusted, the noisy-or of these, and takes the best kind.
   From ACCEPT on it is accepted, and counts with its score among the instances of that kind from then on, so
   that new patterns are induced next to it. This ends with the first round that accepts nothing.
4. Accepted candidates become spans of kind ``ctx_<kind>``.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import store, text

KINDS = ("email", "ip", "card", "phone")
MIN_SEEDS = 4
MIN_CONFIDENCE = 0.8
MIN_PATTERNS = 2
ACCEPT = 0.85
#: Parts into which the rows of one pattern or instance are dealt in joins.
SALT = 16

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A match can only begin where a run of digits begins, so later digits of a run need not be tried.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_CANDIDATE = re.compile(r"[^\x20\x09-\x0D]*[0-9@][^\x20\x09-\x0D]*")
_EDGE = "\"'()[]{}<>,;:!?."
_SPACE = frozenset("\x20\t\n\x0b\x0c\r")
_FIRST = re.compile(r"[\x20\x09-\x0D]*([^\x20\x09-\x0D]{0,40})")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _emails(t: str) -> Iterator[tuple[int, int]]:
    # Each run of local characters ends at one at sign, so it is walked through once.
    done = 0
    at = t.find("@")
    while at >= 0:
        start = at
        while start > done and t[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(t, at) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        at = t.find("@", max(at + 1, done))


def base_spans(t: str) -> list[tuple[str, int, int]]:
    """All base spans (kind, start, end) by kind, then start."""
    out = [("email", a, b) for a, b in _emails(t)]
    if not _DIGIT.search(t):
        return out
    out += [("ip", *m.span()) for m in _IP.finditer(t) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(t):
        if m.end() - m.start() <= 37 and 13 <= len(digits := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in _PHONE.finditer(t) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


def spans_text(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def _hash(*parts: str) -> int:
    return int.from_bytes(xxhash.xxh64_digest("\x1f".join(parts).encode("utf-8", "surrogatepass")), "big", signed=True)


def _last_words(t: str, end: int) -> list[str]:
    """The last two words before ``end``, lowered. Of a word of over 40 characters the last 40 count, and nothing before it."""
    out: list[str] = []
    while len(out) < 2:
        while end and t[end - 1] in _SPACE:
            end -= 1
        start = end
        while start and end - start < 40 and t[start - 1] not in _SPACE:
            start -= 1
        if start == end:
            break
        out.insert(0, t[start:end].lower())
        if start and t[start - 1] not in _SPACE:
            break
        end = start
    return out


def contexts(t: str, start: int, end: int) -> list[int]:
    """Pattern hashes around a span: two words before, one before, and one before with one after (its first 40 characters)."""
    left = _last_words(t, start)
    right = _FIRST.match(t, end)[1].lower()
    one = left[-1] if left else ""
    return [_hash("L2", *left), _hash("L1", one), _hash("LR", one, right)]


def allowed(token: str, kind: str | None = None) -> int:
    """Bits, in the order of KINDS, of the kinds that a token's characters allow; a seed's own kind is always among them."""
    digits = sum("0" <= c <= "9" for c in token)
    letters = any(c.isalpha() for c in token)
    marks = set(token) - set("0123456789")
    out = int("@" in token or letters)
    out |= (not letters and marks <= set(".:") and bool(marks)) << 1
    out |= (12 <= digits <= 19 and marks <= set(" -")) << 2
    out |= (7 <= digits <= 15 and marks <= set(" +()-./")) << 3
    return out if kind is None else out | 1 << KINDS.index(kind)


def candidates(t: str, taken: list[tuple[str, int, int]]) -> list[tuple[int, int]]:
    """Identifier-shaped tokens that touch no base span."""
    out, marks, k = [], sorted((a, b) for _, a, b in taken), 0
    for m in _CANDIDATE.finditer(t) if _DIGIT.search(t) or "@" in t else ():
        token = m[0]
        a = m.start() + len(token) - len(token.lstrip(_EDGE))
        b = m.end() - (len(token) - len(token.rstrip(_EDGE)))
        while k < len(marks) and marks[k][1] <= m.start():
            k += 1
        touched = k < len(marks) and marks[k][0] < m.end()
        if b - a >= 6 and not touched and (sum("0" <= c <= "9" for c in t[a:b]) >= 4 or "@" in t[a:b]):
            out.append((a, b))
    return out


def extract(docs: DataFrame, doc_id: str = "doc_id", column: str = "text") -> DataFrame:
    """A written table of (rid, doc_id, base, found): base spans, and graph rows of seeds and candidates."""
    span = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])
    node = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("instance", pa.int64()), ("allows", pa.int32()), ("patterns", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text.slices(batches):
            base, found = [], []
            for t in b.column(2).to_pylist():
                t = t or ""
                spans = base_spans(t)
                base.append([{"kind": k, "start": a, "end": z} for k, a, z in spans])
                every = [*spans, *((None, a, z) for a, z in candidates(t, spans))]
                found.append([{"kind": k, "start": a, "end": z, "instance": _hash(t[a:z].lower()), "allows": allowed(t[a:z], k), "patterns": contexts(t, a, z)} for k, a, z in every])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(base, pa.list_(span)), pa.array(found, pa.list_(node))], names=["rid", "doc_id", "base", "found"])

    rows = text.small_batches(docs).select(F.monotonically_increasing_id().alias("rid"), F.col(doc_id).cast("long").alias("doc_id"), F.col(column).cast("string").alias("text"))
    schema = "rid long, doc_id long, base array<struct<kind:string,start:int,end:int>>, found array<struct<kind:string,start:int,end:int,instance:long,allows:int,patterns:array<long>>>"
    return store.table(rows.mapInArrow(run, schema), "pii")


def _dealt(big: DataFrame, small: DataFrame, key: str, other: str, by: str, how: str = "inner") -> DataFrame:
    """Joins big.key to small.other with the rows of one key dealt over SALT parts by column ``by``, as a key may be hot."""
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("__t")
    dealt = big.withColumn("__s", F.pmod(F.xxhash64(by), F.lit(SALT)).cast("int"))
    return dealt.join(small.select("*", salts), (F.col(key) == F.col(other)) & (F.col("__s") == F.col("__t")), how).drop("__s", "__t")


def score_graph(found: DataFrame) -> DataFrame:
    """A written table (instance, kind, score) of accepted instances, from rows (instance, kind or null, allows, patterns).

    Repeated texts count once: the graph has one edge for each distinct
    instance, kind and pattern. All steps are aggregations and equi-joins over edges. Ties between kinds go to the earlier in KINDS.
    """
    edges = store.table(found.select("instance", "kind", "allows", F.explode("patterns").alias("pattern")).distinct(), "edges")
    accepted: DataFrame | None = None
    while True:
        if accepted is None:
            now = edges.withColumns({"as": F.col("kind"), "w": F.col("kind").isNotNull().cast("double")})
        else:
            known = accepted.select(F.col("instance").alias("i"), F.col("kind").alias("k"), F.col("score").alias("s"))
            now = _dealt(edges, known, "instance", "i", "pattern", "left").withColumns({"as": F.coalesce("kind", "k"), "w": F.when(F.col("kind").isNotNull(), 1.0).otherwise(F.coalesce("s", F.lit(0.0)))}).drop("i", "k", "s")
        bit = lambda k: F.col("allows").bitwiseAND(F.lit(1 << k)) != 0
        sums = now.groupBy("pattern").agg(*(F.sum(F.when(F.col("as") == k, F.col("w")).otherwise(0.0)).alias(f"w{i}") for i, k in enumerate(KINDS)), *(F.sum(bit(i).cast("double")).alias(f"n{i}") for i in range(len(KINDS))))
        each = F.explode(F.array(*(F.struct(F.lit(i).alias("k"), F.col(f"w{i}").alias("w"), F.try_divide(F.col(f"w{i}"), F.col(f"n{i}")).alias("confidence")) for i in range(len(KINDS)))))
        trust = sums.select(F.col("pattern").alias("p"), each.alias("t")).select("p", "t.*").filter((F.col("w") >= MIN_SEEDS - 1e-9) & (F.col("confidence") >= MIN_CONFIDENCE - 1e-9)).drop("w")
        votes = _dealt(now.filter("`as` IS NULL").select("instance", "allows", "pattern"), trust, "pattern", "p", "instance").filter(F.expr("shiftright(allows, k) & 1 = 1"))
        score = F.round(1.0 - F.exp(-F.sum(-F.log(1.0 - F.least(F.col("confidence"), F.lit(0.999))))), 9).alias("score")
        best = votes.groupBy("instance", "k").agg(score, F.count_distinct("pattern").alias("many")).filter(F.col("many") >= MIN_PATTERNS).groupBy("instance").agg(F.max_by("k", F.struct("score", -F.col("k"))).alias("k"), F.max("score").alias("score"))
        kind = F.element_at(F.array(*(F.lit(k) for k in KINDS)), F.col("k") + 1)
        new = store.table(best.filter(F.col("score") >= ACCEPT).select("instance", kind.alias("kind"), "score"), "accepted")
        done = new.isEmpty()
        if accepted is not None:
            every = store.table(accepted.unionByName(new), "accepted")
            store.drop(accepted, new)
            new = every
        accepted = new
        if done:
            store.drop(edges)
            return accepted


def find(docs: DataFrame, doc_id: str = "doc_id", column: str = "text") -> DataFrame:
    """One row for each input row: (rid, doc_id, base, added), arrays of (kind, start, end).

    Offsets are code points, ends exclusive. Base spans are by kind as in KINDS,
    then start; added spans touch none of them. Null texts count as empty; a
    null doc_id stays null; repeated rows are searched each and all alike; an empty
    table gives an empty result; other columns are ignored. A text of any length is taken whole, in one task.
    """
    rows = extract(docs, doc_id, column)
    found = rows.select("rid", F.explode("found").alias("f")).select("rid", "f.*")
    accepted = score_graph(found).select(F.col("instance").alias("i"), F.concat(F.lit("ctx_"), "kind").alias("as"))
    spans = _dealt(found.filter("kind IS NULL"), accepted, "instance", "i", "rid").groupBy("rid").agg(F.sort_array(F.collect_list(F.struct(F.col("as").alias("kind"), "start", "end"))).alias("added"))
    out = rows.join(spans.withColumnRenamed("rid", "r"), F.col("rid") == F.col("r"), "left")
    return out.select("rid", "doc_id", "base", F.coalesce("added", F.array().cast("array<struct<kind:string,start:int,end:int>>")).alias("added"))


def digest(rows: DataFrame) -> DataFrame:
    joined = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return rows.select("doc_id", *(count(k) for k in KINDS), F.sha2(joined("base"), 256).alias("base_sha256"), joined(F.concat("base", "added")).alias("spans"))


def redact(docs: DataFrame, doc_id: str = "doc_id", column: str = "text", length: str | None = "n_chars") -> DataFrame:
    """The input rows with every span replaced by ``[kind]``; all columns stay.

    Overlapping spans are replaced as one, under the name of the first.
    Null texts stay null. Where ``length`` names a column, it becomes the new
    number of code points.
    """
    rid = "__pii_rid"
    base = store.table(docs.withColumn(rid, F.monotonically_increasing_id()), "docs")
    rows = find(base.select(F.col(rid).alias("doc_id"), F.col(column).alias("text")), "doc_id", "text")
    spans = rows.select(F.col("doc_id").alias("__pii_d"), F.concat("base", "added").alias("__pii_s")).filter(F.size("__pii_s") > 0)
    joined = base.join(spans, base[rid] == spans["__pii_d"], "left")
    ends = F.sort_array(F.transform("__pii_s", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(a, s):  # noqa: ANN001, ANN202
        t = F.col(column)
        fresh = F.concat(a["out"], t.substr(a["at"] + 1, s["start"] - a["at"]), F.lit("["), s["kind"], F.lit("]"))
        return F.struct(F.when(s["start"] >= a["at"], fresh).otherwise(a["out"]).alias("out"), F.greatest(a["at"], s["end"]).alias("at"))

    new = F.aggregate(ends, start, step, lambda a: F.concat(a["out"], F.col(column).substr(a["at"] + 1, F.length(column))))
    changed = F.col("__pii_s").isNotNull()
    out = joined.withColumn("__pii_new", F.when(changed, new).otherwise(F.col(column)))
    columns = {c: F.col(c) for c in docs.columns} | {column: F.col("__pii_new")}
    if length in columns:
        columns[length] = F.when(changed, F.length("__pii_new")).otherwise(F.col(length)).cast(docs.schema[length].dataType)
    return out.select(*(e.alias(c) for c, e in columns.items()))


def sha(spans: list[tuple[str, int, int]]) -> str:
    return hashlib.sha256(spans_text(spans).encode()).hexdigest()
