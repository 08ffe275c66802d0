"""The corpus pipeline against plain Python on a small table with planted cases."""

import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from statspark.llm import decontam, pii, quality
from statspark.llm.queries import tokenizer_path

from test_near_duplicates import brute_first
from test_scans import brute_graph

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, n):
    words = [f"w{rng.randrange(900)}" for _ in range(n)]
    return " ".join(w + ("." if i % 12 == 11 else "") for i, w in enumerate(words))


def corpus():
    rng = random.Random(21)
    items = [(i, " ".join(f"b{i}x{j}" for j in range(24))) for i in range(4)]
    good = {i: prose(rng, rng.randint(60, 160)) for i in range(90)}
    good |= {200 + i: f"{prose(rng, 60)} write to staff{i}@mail.example.com now {prose(rng, 20)}" for i in range(30)}
    good |= {240 + i: f"{prose(rng, 60)} write to staff{i}_at_mail_{7000 + i} now {prose(rng, 20)}" for i in range(3)}
    bad = {300 + i: " ".join(rng.choice(["$$$", "###", "!!", "BUY", "|"]) for _ in range(rng.randint(40, 120))) for i in range(60)}
    copies = {400 + i: good[i] for i in range(5)}
    for i in range(5, 10):  # one changed word in a long text: similar above 0.8
        w = good[i].split()
        w[len(w) // 2] = "changed"
        copies[400 + i] = " ".join(w)
    reordered = lambda t: " ".join(t.split()[12:] + t.split()[:12])
    leaks = {500: prose(rng, 50) + " " + items[0][1] + " " + prose(rng, 30), 501: prose(rng, 50) + " " + reordered(items[1][1]), 502: prose(rng, 60) + " " + " ".join(items[2][1].split()[:8])}
    docs = {**good, **bad, **copies, **leaks, 600: "", 601: None}
    labels = [(i, 1) for i in good if i < 90] + [(i, 0) for i in bad]
    return [(i, t) for i, t in docs.items()], labels, items


def kept_by_quality(docs, labels):
    measured = {i: quality.features(pa.array([t], pa.string()))[0].astype(np.float32).astype(float) for i, t in docs}
    learn = [(measured[i], y) for i, y in labels if __import__("zlib").crc32(str(i).encode()) % 3 != 1]
    model = quality.fit(np.array([x for x, _ in learn]), np.array([float(y) for _, y in learn]))
    return [(i, t) for i, t in docs if model.score(measured[i][None, :])[0] >= 0.5]


def holds_item(t, item):
    """Greedy tiling by searching the longest free match again and again."""
    doc, words = decontam.normal_words(t), decontam.normal_words(item)
    free_d, free_i, covered = [True] * len(doc), [True] * len(words), 0
    while True:
        best = (0, 0, 0)
        for a in range(len(doc)):
            for b in range(len(words)):
                n = 0
                while a + n < len(doc) and b + n < len(words) and doc[a + n] == words[b + n] and free_d[a + n] and free_i[b + n]:
                    n += 1
                best = max(best, (n, -a, -b))
        n, a, b = best[0], -best[1], -best[2]
        if n < decontam.MIN_MATCH:
            return 2 * covered >= len(words)
        free_d[a : a + n], free_i[b : b + n] = [False] * n, [False] * n
        covered += n


def redacted(docs):
    found, spans = [], {}
    for i, t in docs:
        base = pii.base_spans(t)
        every = [*base, *((None, a, z) for a, z in pii.candidates(t, base))]
        spans[i] = every
        found += [(t[a:z].lower(), k, pii.allowed(t[a:z], k), pii.contexts(t, a, z)) for k, a, z in every]
    accepted = brute_graph([(i, k, w, tuple(p)) for i, k, w, p in found])
    out = []
    for i, t in docs:
        named = sorted((a, z, k or f"ctx_{accepted[t[a:z].lower()][0]}") for k, a, z in spans[i] if k or t[a:z].lower() in accepted)
        for a, z, k in reversed(named):
            t = f"{t[:a]}[{k}]{t[z:]}"
        out.append((i, t))
    return out


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("sf"))
    docs, labels, items = corpus()
    rows = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in docs], COLUMNS)
    rows.withColumns({"rid": F.lit("clash"), "base": F.lit(1.5)}).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, y, 0) for i, y in labels], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, docs, labels, items


def test_every_stage_and_the_whole_equal_plain_python(spark, tables):
    from tokenizers import Tokenizer

    folder, docs, labels, items = tables
    want = [kept_by_quality(docs, labels)]
    first = {d for d, _ in [(i, n) for i, n in brute_first(want[0])]}
    want.append([(i, t) for i, t in want[0] if i in first])
    want.append([(i, t) for i, t in want[1] if not any(holds_item(t, x) for _, x in items)])
    want.append(redacted(want[2]))
    assert len(want[0]) > len(want[1]) > len(want[2]) > 80
    assert not {500, 501} & {i for i, _ in want[2]} and 502 in {i for i, _ in want[2]} and not {400, 405} & {i for i, _ in want[1]}
    assert any("[ctx_email]" in t for _, t in want[3]) and any("[email]" in t for _, t in want[3])
    now = spark.read.parquet(f"{folder}/documents.parquet")
    columns = now.columns
    for (name, stage), rows in zip(corpus_pipeline.STAGES[:-1], want, strict=True):
        now = stage(spark, now, folder)
        assert now.columns == columns, name
        got = now.collect()
        assert sorted((r.doc_id, r.text) for r in got) == sorted(rows), name
        assert all(r.n_chars == len(r.text) and (r.rid, r.base) == ("clash", 1.5) for r in got)
        now = spark.createDataFrame(got, now.schema)
    tok = Tokenizer.from_file(tokenizer_path())
    pieces, pack = defaultdict(int), defaultdict(int)
    for r in corpus_pipeline.run(spark, folder).collect():
        pieces[r.doc_id] += r.length
        pack[r.sequence_id] += r.length
    assert dict(pieces) == {i: len(tok.encode(t, add_special_tokens=False).ids) + 1 for i, t in want[3]}
    assert max(pack.values()) <= 1024 and sum(1024 - n for n in pack.values()) < 1024 * 8


def test_stages_take_nulls_repeated_rows_and_empty_tables(spark, tables):
    folder, docs, *_ = tables
    text = docs[0][1]
    rows = [(None, text, None, None, None), (0, text, None, None, None), (0, text, None, None, None), (7, None, None, None, None), (None, None, None, None, None)]
    full = spark.createDataFrame(rows, COLUMNS)
    for df, n in ((full, None), (full.limit(0), 0)):
        for name, stage in corpus_pipeline.STAGES:
            df = stage(spark, df, folder)
            if name != "packing":
                assert df.columns == full.columns
        assert n is None or df.count() == n
    assert [r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, full, folder).collect() if r.text] == [0]
    assert corpus_pipeline.ORACLE_SQL is None
