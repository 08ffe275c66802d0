"""Conversations from reply trees, with a reversible template and a loss mask.

Only DataFrame expressions are used.

Template: ``<s>`` once, then for each turn ``[INST]role[/INST]text</s>``. Any
control string inside a role or text gets one more backslash after its first
character (``</s>`` becomes ``<\\/s>``, ``<\\/s>`` becomes ``<\\\\/s>``), so
it never reads as control, and taking one backslash away restores the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import store

OPEN, ROLE, TEXT, CLOSE = "<s>", "[INST]", "[/INST]", "</s>"
#: A control string of the template, also one that is escaped already.
_ESCAPE = r"([<\[])(\\*)(/?s>|/?INST\])"
_UNESCAPE = r"([<\[])\\(\\*)(/?s>|/?INST\])"
TRAINED = "assistant"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPE, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _UNESCAPE, "$1$2$3")


def paths(nodes: DataFrame) -> DataFrame:
    """All root-to-leaf paths of reply trees: (tree, leaf, depth, node), depth 0 at the root.

    ``nodes``: tree, node and parent (long; a null parent marks a root, as does
    one that is no node of the tree). Self-joins double the distance in each
    round: jump tables of 1, 2, 4, ... steps, then every path is filled in from
    its leaf by the same tables, largest steps first. So a chain of n turns takes
    about 2 log2(n) joins, and rows never outnumber the paths' nodes. A null tree is a tree.
    A loop raises ValueError: it leaves jumps of more steps than the largest tree has nodes.
    """
    base = store.table(nodes.select("tree", "node", "parent"), "nodes")
    own = base.select(F.col("tree").alias("t"), F.col("node").alias("p"))
    up = base.join(own, F.col("tree").eqNullSafe(F.col("t")) & (F.col("parent") == F.col("p"))).select("tree", "node", F.col("p").alias("to"))
    jumps = [store.table(up, "jump")]
    largest = base.groupBy("tree").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    for _ in range(largest.bit_length() + 1):
        a = jumps[-1]
        b = a.select(F.col("tree").alias("t"), F.col("node").alias("n"), F.col("to").alias("far"))
        new = store.table(a.join(b, F.col("tree").eqNullSafe(F.col("t")) & (F.col("to") == F.col("n"))).select("tree", "node", F.col("far").alias("to")), "jump")
        if new.isEmpty():
            store.drop(new)
            break
        jumps.append(new)
    else:
        store.drop(base, *jumps)
        raise ValueError("replies form a loop")
    has_child = jumps[0].select(F.col("tree").alias("t"), F.col("to").alias("p")).distinct()
    leaves = base.join(has_child, F.col("tree").eqNullSafe(F.col("t")) & (F.col("node") == F.col("p")), "left_anti")
    found = store.table(leaves.select("tree", F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("up")), "paths")
    for k in range(len(jumps) - 1, -1, -1):
        j = jumps[k].select(F.col("tree").alias("t"), F.col("node").alias("n"), "to")
        more = found.join(j, F.col("tree").eqNullSafe(F.col("t")) & (F.col("node") == F.col("n"))).select("tree", "leaf", F.col("to").alias("node"), (F.col("up") + (1 << k)).alias("up"))
        old, found = found, store.table(found.unionByName(more), "paths")
        store.drop(old)
    store.drop(base, *jumps)
    length = found.groupBy("tree", "leaf").agg(F.max("up").alias("last")).select(F.col("tree").alias("t"), F.col("leaf").alias("f"), "last")
    out = found.join(length, F.col("tree").eqNullSafe(F.col("t")) & (F.col("leaf") == F.col("f")))
    return out.select("tree", "leaf", (F.col("last") - F.col("up")).alias("depth"), "node")


def rank_branches(found: DataFrame, scores: DataFrame) -> DataFrame:
    """(tree, leaf, score, rank): paths by their mean score, best first; ties go to the smaller leaf.

    ``scores``: tree, node, score; null scores count as 0. Ranks count, for each
    path, those before it, by a running number over one row for each path.
    """
    from pyspark.sql import Window

    s = scores.select(F.col("tree").alias("t"), F.col("node").alias("n"), F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("s"))
    means = found.join(s, F.col("tree").eqNullSafe(F.col("t")) & (F.col("node") == F.col("n"))).groupBy("tree", "leaf").agg(F.avg("s").alias("score"))
    return means.withColumn("rank", F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("score"), "leaf")))


def format_turns(turns: DataFrame) -> DataFrame:
    """Formats ordered turns: (tree, leaf, formatted, loss_spans).

    ``turns``: tree, leaf, depth, role, text. Null roles and texts count as empty.
    ``loss_spans`` holds [start, end) in code points of ``formatted`` for each
    text of role TRAINED, escapes included.
    """
    role = escape(F.coalesce(F.col("role").cast("string"), F.lit("")))
    text = escape(F.coalesce(F.col("text").cast("string"), F.lit("")))
    turn = F.struct("depth", role.alias("role"), text.alias("text"), (F.coalesce("role", F.lit("")) == TRAINED).alias("trained"))
    rows = turns.select("tree", "leaf", turn.alias("turn")).groupBy("tree", "leaf").agg(F.sort_array(F.collect_list("turn")).alias("turns"))
    marks = len(ROLE) + len(TEXT) + len(CLOSE)
    formatted = F.concat(F.lit(OPEN), F.array_join(F.transform("turns", lambda t: F.concat(F.lit(ROLE), t["role"], F.lit(TEXT), t["text"], F.lit(CLOSE))), ""))
    start = F.struct(F.lit(len(OPEN)).cast("long").alias("at"), F.array().cast("array<struct<start:long,end:long>>").alias("spans"))

    def step(a: Column, t: Column) -> Column:
        begin = a["at"] + len(ROLE) + F.length(t["role"]) + len(TEXT)
        span = F.array(F.struct(begin.cast("long").alias("start"), (begin + F.length(t["text"])).cast("long").alias("end")))
        return F.struct((a["at"] + F.length(t["role"]) + F.length(t["text"]) + marks).cast("long").alias("at"), F.when(t["trained"], F.concat(a["spans"], span)).otherwise(a["spans"]).alias("spans"))

    return rows.select("tree", "leaf", formatted.alias("formatted"), F.aggregate("turns", start, step, lambda a: a["spans"]).alias("loss_spans"))


def format_trees(messages: DataFrame, best: int | None = None) -> DataFrame:
    """Formats each chosen root-to-leaf path of reply trees as one conversation.

    ``messages``: tree, node, parent, role, text, score. ``best`` keeps the paths of the best ranks of each tree; None keeps all.
    Returns (tree, leaf, rank, score, formatted, loss_spans). Rows with a null tree are one tree. Rows with a null
    node are left out, as nothing can reply to them. Rows that repeat a node of a tree are one node: the least by parent, role, text and score,
    nulls first. Loops raise ValueError. Null scores count as 0; other columns are ignored; an empty table gives an empty result. A
    conversation is formatted in one task, which has to hold it.
    """
    base = store.table(messages.select("tree", "node", "parent", "role", "text", "score").filter("node IS NOT NULL"), "messages")
    if not base.groupBy("tree", "node").agg(F.count("*").alias("n")).filter("n > 1").isEmpty():
        least = base.groupBy("tree", "node").agg(F.min(F.struct("parent", "role", "text", "score")).alias("x"))
        old, base = base, store.table(least.select("tree", "node", "x.*"), "messages")
        store.drop(old)
    found = store.table(paths(base), "paths")
    ranked = rank_branches(found, base).select(F.col("tree").alias("t"), F.col("leaf").alias("f"), "rank", "score")
    if best is not None:
        ranked = ranked.filter(F.col("rank") <= best)
    ranked = store.table(ranked, "ranked")
    chosen = found.join(ranked, F.col("tree").eqNullSafe(F.col("t")) & (F.col("leaf") == F.col("f")), "left_semi")
    said = base.select(F.col("tree").alias("t"), F.col("node").alias("n"), "role", "text")
    turns = chosen.join(said, F.col("tree").eqNullSafe(F.col("t")) & (F.col("node") == F.col("n"))).select("tree", "leaf", "depth", "role", "text")
    out = format_turns(turns)
    return out.join(ranked, F.col("tree").eqNullSafe(F.col("t")) & (F.col("leaf") == F.col("f"))).select("tree", "leaf", "rank", "score", "formatted", "loss_spans")


def chain(rows: DataFrame, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """Linear conversations as reply trees: each turn replies to the one before.

    Turns are ordered by turn, role and text, nulls first, so ties and repeated
    rows are separate turns in a fixed order. Their numbers in this order
    are the nodes. Rows with a null conversation id are one conversation.
    """
    from pyspark.sql import Window

    order = Window.partitionBy("tree").orderBy("turn", "role", "text")
    base = rows.select(F.col(conv).cast("long").alias("tree"), F.col(turn).cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    out = base.withColumn("node", F.row_number().over(order).cast("long"))
    return out.select("tree", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(None).cast("double").alias("score"))


def read_back(formatted: DataFrame) -> DataFrame:
    """Parses formatted conversations: adds ``turns`` (array of role and text, unescaped) and ``loss_text``.

    loss_text joins the unescaped texts under the loss mask, in order.
    """
    body = F.substring(F.col("formatted"), len(OPEN) + 1, 2**31 - 1)
    pieces = F.filter(F.split(body, r"\Q" + CLOSE + r"\E"), lambda p: p != "")
    turn = lambda p: F.split(p, r"\Q" + TEXT + r"\E")
    turns = F.transform(pieces, lambda p: F.struct(unescape(F.substring(F.get(turn(p), F.lit(0)), len(ROLE) + 1, 2**31 - 1)).alias("role"), unescape(F.get(turn(p), F.lit(1))).alias("text")))
    masked = F.transform("loss_spans", lambda s: unescape(F.col("formatted").substr((s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))))
    return formatted.withColumns({"turns": turns, "loss_text": F.array_join(masked, "")})


#: DuckDB SQL for the digest of linear conversations and the one with control strings.
ORACLE = r"""
WITH c AS (
  SELECT conv_id, turn::BIGINT AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')
), e AS (
  SELECT *, length(regexp_replace(role, '([<\[])(\\*)(/?s>|/?INST\])', '\1\\\2\3', 'g')) + length(regexp_replace(text, '([<\[])(\\*)(/?s>|/?INST\])', '\1\\\2\3', 'g')) + 17 AS n
  FROM c
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       (3 + sum(n))::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""
