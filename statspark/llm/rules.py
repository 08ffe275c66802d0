"""Quality rules as a bitmask ledger.

Every rule is evaluated once for each document. The ledger keeps its
measurements and one failure bit per rule. Policies are versioned masks over
these bits, so they are applied, compared and ablated by bitwise operations on
the ledger, without the texts. Only DataFrame expressions are used.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = "[\\x20\\x09-\\x0D]+"
SYMBOLS = "#*$%&|<>"
REPEAT_WINDOW = 3


@dataclass(frozen=True)
class Rule:
    """Fails where ``condition``, an expression over measurements, is true."""

    name: str
    condition: str


#: In the order of their bits; new rules are added at the end, so that old ledgers stay valid.
RULES = (
    Rule("few_words", "n_words < 50"),
    Rule("repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    Rule("symbols", "5 * n_symbols > n_words"),
    Rule("repeated_lines", "2 * n_dup_lines > n_lines"),
    Rule("short_words", "word_chars < 2 * n_words"),
    Rule("long_words", "word_chars > 20 * n_words"),
)

#: Version to names of the rules that reject.
POLICIES = {
    1: ("few_words", "repeated_windows"),
    2: ("few_words", "repeated_windows", "symbols", "repeated_lines", "short_words", "long_words"),
}
LATEST = max(POLICIES)
BASE = POLICIES[1]


def mask(names: tuple[str, ...]) -> int:
    """Bits of the named rules; an unknown name raises ValueError."""
    order = [r.name for r in RULES]
    return sum(1 << order.index(n) for n in dict.fromkeys(names))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluates ``value`` once and binds it in ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def repeat_words(words: Column, k: int = REPEAT_WINDOW) -> Column:
    """Words that are covered by windows of ``k`` words that occur twice or more in the array.

    Windows are ordered so that equal ones are neighbours; the starts of these
    then cover at most ``k`` words each up to the next start. Arrays
    without a pair of equal hashes, which most are, skip the words' own windows and their sort.
    """

    def covered(windows: Column) -> Column:
        pairs = F.sort_array(F.transform(windows, lambda w, i: F.struct(w.alias("w"), i.alias("i"))))

        def starts(s: Column) -> Column:
            same = F.filter(s, lambda x, j: (x["w"] == F.get(s, j - 1)["w"]) | (x["w"] == F.get(s, j + 1)["w"]))
            return F.sort_array(F.transform(same, lambda x: x["i"]))

        def total(p: Column) -> Column:
            gaps = F.transform(p, lambda x, j: F.least(F.lit(k), F.coalesce(F.get(p, j + 1) - x, F.lit(k))))
            return F.aggregate(gaps, F.lit(0).cast("long"), lambda a, x: a + x)

        return let(pairs, lambda s: let(starts(s), total))

    def body(w: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(w) - k)
        hashes = F.transform(at, lambda i: F.xxhash64(*(F.get(w, i + j) for j in range(k))))
        windows = F.transform(at, lambda i: F.concat_ws(" ", *(F.get(w, i + j) for j in range(k))))
        found = let(hashes, lambda x: F.when(F.size(F.array_distinct(x)) < F.size(x), let(windows, covered)).otherwise(F.lit(0).cast("long")))
        return F.when(F.size(w) < k, F.lit(0).cast("long")).otherwise(found)

    return let(words, body)


def measure(docs: DataFrame, doc_id: str = "doc_id", column: str = "text") -> DataFrame:
    """(doc_id, measurements) for each row; a null text has no words and no lines."""
    t = F.coalesce(F.col(column).cast("string"), F.lit(""))
    has = F.regexp_replace(t, SPACE, "") != ""
    words = F.filter(F.split(t, SPACE), lambda w: w != "")
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    n_lines = F.struct(F.size(lines).cast("long").alias("n"), (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("dup"))
    per_word = let(words, lambda w: F.struct(F.size(w).cast("long").alias("n"), repeat_words(w).alias("r")))
    zero = F.lit(0).cast("long")
    out = docs.select(F.col(doc_id).cast("long").alias("doc_id"), t.alias("t"), has.alias("has"), per_word.alias("w"), n_lines.alias("l"))
    return out.select(
        "doc_id",
        F.when(F.col("has"), F.col("w.n")).otherwise(zero).alias("n_words"),
        F.length(F.translate("t", " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        (F.length("t") - F.length(F.translate("t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.col("l.n").alias("n_lines"),
        F.col("l.dup").alias("n_dup_lines"),
        F.when(F.col("has"), F.col("w.r")).otherwise(zero).alias("n_repeat_words"),
    )


def ledger(docs: DataFrame, doc_id: str = "doc_id", column: str = "text") -> DataFrame:
    """One row for each input row: doc_id, measurements, and ``failed`` (long, a bit for each rule).

    Null and empty texts fail ``few_words`` only. A null doc_id stays null,
    repeated rows are measured each, an empty table gives an empty ledger, other
    columns are ignored.
    """
    bits = None
    for i, rule in enumerate(RULES):
        bit = F.when(F.expr(rule.condition), F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long"))
        bits = bit if bits is None else bits.bitwiseOR(bit)
    return measure(docs, doc_id, column).withColumn("failed", bits)


def apply_policy(rows: DataFrame, version: int = LATEST, out: str = "kept") -> DataFrame:
    """Adds the verdict of a policy to a ledger."""
    return rows.withColumn(out, F.col("failed").bitwiseAND(F.lit(mask(POLICIES[version])).cast("long")) == 0)


def ablations(rows: DataFrame, version: int = LATEST) -> DataFrame:
    """(rule, failed, alone, kept_without) for each rule of a policy, in the order of bits.

    The ledger is first counted by failure bits (at most 2**len(RULES) rows, by
    map-side aggregation): ``failed`` rows fail the rule, ``alone`` fail no other
    rule of the policy, and ``kept_without`` would be kept if it were dropped.
    """
    m = mask(POLICIES[version])
    counts = rows.select(F.col("failed").bitwiseAND(F.lit(m).cast("long")).alias("bits")).groupBy("bits").agg(F.count("*").alias("n"))
    rules = [(i, r.name, 1 << i) for i, r in enumerate(RULES) if m >> i & 1]
    each = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(n).alias("rule"), F.lit(b).cast("long").alias("b")) for i, n, b in rules))).alias("r")
    has = F.col("bits").bitwiseAND(F.col("r.b")) != 0
    alone = F.col("bits") == F.col("r.b")
    total = lambda c: F.sum(F.when(c, F.col("n")).otherwise(F.lit(0).cast("long")))
    out = counts.select("bits", "n", each).groupBy("r.i", "r.rule").agg(total(has).alias("failed"), total(alone).alias("alone"), total(alone | (F.col("bits") == 0)).alias("kept_without"))
    return out.orderBy("i").select("rule", "failed", "alone", "kept_without")


#: DuckDB SQL for the digest of the ledger and the latest policy.
ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT rid, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM d
), g AS (
  SELECT rid, i, concat_ws(' ', ws[i], ws[i + 1], ws[i + 2]) AS win
  FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)
), rep AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, win) AS n FROM g) WHERE n > 1
), cov AS (
  SELECT rid, count(DISTINCT i + j) AS n FROM rep, (VALUES (0), (1), (2)) AS o(j) GROUP BY rid
), m AS (
  SELECT doc_id, len(ws)::BIGINT AS n_words,
         length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         len(ls)::BIGINT AS n_lines, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
         coalesce(cov.n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN cov USING (rid)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR 5 * n_symbols > n_words
            OR 2 * n_dup_lines > n_lines OR word_chars < 2 * n_words OR word_chars > 20 * n_words) AS kept,
       ((n_words < 50)::BIGINT + 2 * (100 * n_repeat_words > 50 * n_words)::BIGINT + 4 * (5 * n_symbols > n_words)::BIGINT + 8 * (2 * n_dup_lines > n_lines)::BIGINT
        + 16 * (word_chars < 2 * n_words)::BIGINT + 32 * (word_chars > 20 * n_words)::BIGINT)::BIGINT AS failed
FROM m
"""
