from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from statspark.llm import chat, rules


def test_template_is_reversible(spark):
    texts = ["", "</s>", r"<\/s> <\\s>", "[INST] x [/INST]", "a<", "[", "\\", "<s>[/INST]</s>", "é\n</s>[INST] ok [/INST]", None]
    rows = [(1, i, None if i == 0 else i - 1, "assistant" if i % 2 else "us</s>er", t, None) for i, t in enumerate(texts)]
    out = chat.read_back(chat.format_trees(spark.createDataFrame(rows, "tree long, node long, parent long, role string, text string, score double").withColumn("t", F.lit(1)))).first()
    assert [(t.role, t.text) for t in out.turns] == [(r[3], r[4] or "") for r in rows]
    assert out.loss_text == "".join(r[4] or "" for r in rows if r[3] == "assistant")
    assert out.formatted.count("</s>") == len(texts)


def test_trees_are_ranked(spark):
    rows = [(1, 1, None, "user", "q", None), (1, 2, 1, "assistant", "bad", 0.1), (1, 3, 1, "assistant", "good", 0.9), (1, 4, 3, "user", "more", 0.8), (1, 5, 3, "user", "other", 0.7), (2, 1, None, "user", "alone", None), (3, 7, 99, "user", "orphan", 1.0), (None, 1, None, "user", "x", 1.0)]
    df = spark.createDataFrame(rows, "tree long, node long, parent long, role string, text string, score double")
    found = {(r.tree, r.leaf): r for r in chat.format_trees(df).collect()}
    assert set(found) == {(1, 2), (1, 4), (1, 5), (2, 1), (3, 7), (None, 1)}
    assert [found[1, k]["rank"] for k in (4, 5, 2)] == [1, 2, 3]
    assert found[1, 4].formatted == "<s>[INST]user[/INST]q</s>[INST]assistant[/INST]good</s>[INST]user[/INST]more</s>"
    best = chat.format_trees(df, best=1).collect()
    assert {(r.tree, r.leaf) for r in best} == {(1, 4), (2, 1), (3, 7), (None, 1)}


def test_long_chain_and_empty(spark):
    df = spark.range(300).select(F.lit(5).alias("conv_id"), "id", F.col("id").alias("turn"), F.lit("user").alias("role"), F.col("id").cast("string").alias("text"))
    assert [t.text for t in chat.read_back(chat.format_trees(chat.chain(df))).first().turns] == [str(i) for i in range(300)]
    assert chat.format_trees(chat.chain(df.limit(0))).count() == 0


def test_loops_repeated_nodes_and_null_ids(spark):
    schema = "tree long, node long, parent long, role string, text string, score double"
    for loop in ([(1, 1, 2, "u", "a", None), (1, 2, 1, "u", "b", None)], [(1, 1, 1, "u", "a", None)], [(1, 0, None, "u", "x", None), (1, 1, 3, "u", "a", None), (1, 2, 1, "u", "b", None), (1, 3, 2, "u", "c", None)]):
        with pytest.raises(ValueError):
            chat.format_trees(spark.createDataFrame(loop, schema)).count()
    rows = [(None, 1, None, "user", "q", None), (None, 2, 1, "assistant", "z", 0.5), (None, 2, 1, "assistant", "a", 0.5), (None, 2, 1, "assistant", "a", 0.5), (1, None, None, "user", "lost", None), (2, 1, None, None, None, None)]
    df = spark.createDataFrame(rows, schema).withColumns({"leaf": F.lit("x"), "depth": F.lit(1), "rank": F.lit(2), "formatted": F.lit("y"), "up": F.lit(3)})
    got = {(r.tree, r.leaf): r.formatted for r in chat.format_trees(df).collect()}
    assert got == {(None, 2): "<s>[INST]user[/INST]q</s>[INST]assistant[/INST]a</s>", (2, 1): "<s>[INST][/INST]</s>"}
    said = [(None, 1, "assistant", "y" * 1_000_000), (None, 0, "user", "x"), (3, 0, "user", "same"), (3, 0, "user", "same")]
    out = {r.tree: [(t.role, t.text) for t in r.turns] for r in chat.read_back(chat.format_trees(chat.chain(spark.createDataFrame(said, "conv_id long, turn long, role string, text string").withColumn("node", F.lit("x"))))).collect()}
    assert out == {None: [("user", "x"), ("assistant", "y" * 1_000_000)], 3: [("user", "same")] * 2}


def brute_rules(t):
    t = t or ""
    words = t.encode().split()
    wins = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    many = {w for w, n in Counter(wins).items() if n > 1}
    covered = {j for i, w in enumerate(wins) if w in many for j in range(i, i + 3)}
    lines = [x for x in t.split("\n") if x.encode().split()]
    return len(words), sum(len(w.decode()) for w in words), sum(c in rules.SYMBOLS for c in t), len(lines) - len(set(lines)), len(covered)


TEXTS = ["", None, "   ", "\n\n", "a", "a b", "a b c", "a b c a b c", "a a a a a", "x\ny\nx\n \nx", "é# $ | <b>", "one\ttwo\x0bthree\x0cfour\rfive", "a b c", "w " * 3000, " ".join(f"w{i}" for i in range(60)), " ".join(f"w{i % 40}" for i in range(100))]


def test_ledger_equals_brute_force_and_sql(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)) + [(3, "a b c"), (None, "z")], "doc_id long, text string").withColumns({"t": F.lit(1), "failed": F.lit("x"), "w": F.lit(2)})
    rows = rules.apply_policy(rules.ledger(df))
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in rows.collect() if r.doc_id is not None and r.doc_id != 3}
    assert got == {i: brute_rules(t) for i, t in enumerate(TEXTS) if i != 3}
    con = duckdb.connect()
    con.register("documents", df.select("doc_id", "text").toPandas().astype({"doc_id": "Int64"}))
    sql = con.execute(rules.ORACLE).fetchall()
    base = F.col("failed").bitwiseAND(F.lit(rules.mask(rules.BASE)).cast("long")) != 0
    own = rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base, "kept", "failed").collect()
    assert sorted(map(str, sql)) == sorted(str(tuple(r)) for r in own)
    assert rules.ledger(df.limit(0)).count() == 0


def test_ablations(spark):
    rows = spark.createDataFrame([(0,), (1,), (1,), (3,), (4,)], "failed long")
    got = {r.rule: (r.failed, r.alone, r.kept_without) for r in rules.ablations(rows).collect()}
    assert got["few_words"] == (3, 2, 3) and got["repeated_windows"] == (1, 0, 1) and got["symbols"] == (1, 1, 2)
