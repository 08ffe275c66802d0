import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from statspark.llm import golay, graph, similar, simhash

SCHEMA = "doc_id long, text string"


def brute_components(rows):
    fp = [simhash.fingerprint((t or "").encode()) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fp[i] ^ fp[j]).bit_count() <= 2:
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return sorted(((d, f"{fp[i]:016x}", least.get(root(i))) for i, (d, _) in enumerate(rows)), key=str)


def corpus():
    rng = random.Random(2)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(300)]
    docs = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 120))) for _ in range(60)]
    near = []
    for d in docs[:20]:
        w = d.split()
        w[rng.randrange(len(w))] = "zzz"
        near += [" ".join(w), d]
    big = " ".join(rng.choice(vocabulary) for _ in range(400)).split()
    for i in range(60):
        w = list(big)
        w[rng.randrange(len(w))] = f"v{i}"
        near.append(" ".join(w))
    return [(i, t) for i, t in enumerate(docs + near + ["", "  \n", "One", "ONE", "a b", "É a"])] + [(500, None), (3, docs[0]), (3, docs[0]), (None, docs[1]), (None, "unlike any other text here")]


@pytest.mark.parametrize("pairwise", [2, 32])
def test_components_equal_brute_force(spark, monkeypatch, pairwise):
    monkeypatch.setattr(simhash, "PAIRWISE", pairwise)
    rows = corpus()
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"fp": F.lit("clash"), "component_id": F.lit(1.5), "node": F.lit(0)})
    got = simhash.near_duplicates(df).select("doc_id", "fingerprint", "component_id").collect()
    assert sorted(map(tuple, got), key=str) == brute_components(rows)


def test_empty_table(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    assert simhash.keep_one(spark.createDataFrame([], SCHEMA)).count() == 0


def test_keep_one_keeps_columns_and_the_least_id(spark):
    rows = [(9, "a b c d e", 1), (4, "a b c d e", 2), (None, "a b c d e", 3), (5, "something else entirely", 4)]
    out = simhash.keep_one(spark.createDataFrame(rows, SCHEMA + ", fp int"))
    assert sorted(map(tuple, out.collect())) == [(4, "a b c d e", 2), (5, "something else entirely", 4)]


def test_golay_shares_a_key_at_distance_one():
    rng = np.random.default_rng(1)
    words = rng.integers(0, 1 << 23, 2000)
    near = golay.near(words)
    assert set((near != golay.NONE).sum(axis=1)) == {1, 6}
    for bit in range(23):
        other = golay.near(words ^ (1 << bit))
        assert all(near[i, 0] in other[i] for i in range(len(words)))


def test_long_chains_and_loops(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000), (2000, 1999), (1999, 2000)]
    out = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert out == {i: 0 for i in range(201)} | {1999: 1999, 2000: 1999}


def shingle_set(t):
    w = (t or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def brute_first(rows):
    """(doc_id, text) of the least doc_id of each component of 5-word Jaccard similarity 0.8 or more."""
    sets = [shingle_set(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), (True, 0)), (d is None, d or 0))
    return sorted((d, n) for n, d in least.values())


@pytest.mark.parametrize("pairwise", [0, 1000])
def test_stage_keeps_one_of_five_word_neighbours(spark, monkeypatch, pairwise):
    import corpus_pipeline

    monkeypatch.setattr(similar, "PAIRWISE", pairwise)
    rng = random.Random(4)
    rows = corpus()
    for n in (30, 60, 110, 250, 900):
        base = [f"w{rng.randint(0, 5000)}" for _ in range(n)]
        for i in range(8):
            w = list(base)
            for _ in range(i * n // 220 + 1):
                w[rng.randrange(n)] = f"x{rng.randint(0, 5000)}"
            rows.append((1000 + 10 * n + i, " ".join(w)))
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"rid": F.lit("clash"), "c": F.lit(1.5), "node": F.lit(0)})
    out = corpus_pipeline.drop_near_duplicates(spark, df, "")
    assert out.columns == df.columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in out.collect()) == sorted((n, d or 0) for d, n in brute_first(rows))
    assert corpus_pipeline.drop_near_duplicates(spark, df.limit(0), "").count() == 0


def test_shingles_and_fingerprints_depend_on_the_text_alone():
    texts = [b"", b"a", b"a b c", b"a b c d e", b"a b c d e f", b"x a b c d e"]
    h, at = similar.shingles(texts, 5)
    assert at.tolist() == [0, 0, 1, 2, 3, 5, 7]
    assert h[2] == h[3] == h[6] and len(set(h.tolist())) == 5
    fp = similar.fingerprints(h, at)
    for i, t in enumerate(texts):
        alone = similar.shingles([t], 5)
        assert alone[0].tolist() == h[at[i] : at[i + 1]].tolist()
        assert similar.fingerprints(*alone)[0] == fp[i]
    bits = [(h >> np.uint64(b)) & np.uint64(1) for b in range(64)]
    assert int(fp[4]) == sum(1 << b for b, x in enumerate(bits) if 2 * x[3:5].sum() > 2)


def shuffled(spark, run):
    """The result of ``run()`` and the bytes that its stages shuffled."""
    sc = spark._jsc.sc()

    def stages():
        sc.listenerBus().waitUntilEmpty(30_000)
        held = sc.statusStore().stageList(None, False, False, spark._sc._gateway.new_array(spark._jvm.double, 0), None)
        return {(s.stageId(), s.attemptId()): s.shuffleWriteBytes() for s in (held.apply(i) for i in range(held.size()))}

    before = stages()
    out = run()
    return out, sum(n for k, n in stages().items() if k not in before)


@pytest.fixture
def no_small_tables(spark):
    """As on large tables: nothing is broadcast for its size."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("similarity", [None, 0.8])
def test_texts_are_not_shuffled_to_leave_some_out(spark, no_small_tables, similarity):
    rng = random.Random(6)
    texts = [" ".join(f"{rng.getrandbits(40):x}" for _ in range(200)) for _ in range(200)]
    rows = list(enumerate(texts + texts[:20]))
    kept = simhash.keep_one(spark.createDataFrame(rows, SCHEMA), k=simhash.SHINGLE, similarity=similarity)
    out, n = shuffled(spark, kept.collect)
    assert sorted(map(tuple, out)) == rows[:200]
    assert n < sum(map(len, texts)) / 10


@pytest.mark.parametrize("most", [0, 1000])
def test_only_sets_of_pairs_are_shuffled(spark, monkeypatch, no_small_tables, most):
    monkeypatch.setattr(similar, "BROADCAST_IDS", most)
    rng = random.Random(7)
    base = [[rng.getrandbits(62) for _ in range(200)] for _ in range(150)]
    near = [[*s[:-n], *(rng.getrandbits(62) for _ in range(n))] for s, n in zip(base, (10, 22, 23, 60))]
    sets = spark.createDataFrame(list(enumerate(base + near)), "node long, shingles array<long>")
    pairs = spark.createDataFrame([(0, 150), (1, 151), (2, 152), (3, 153), (4, 5)], "u long, v long")
    out, n = shuffled(spark, lambda: sorted(map(tuple, similar._similar(pairs, sets, 0.8).collect())))
    assert out == [(0, 150), (1, 151)]
    if most:
        assert n < 8 * 200 * 20


def test_lists_of_any_length_link_the_same(spark, monkeypatch, no_small_tables):
    import corpus_pipeline

    monkeypatch.setattr(similar, "BROADCAST_IDS", 0)
    rows = corpus()
    out = corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(rows, SCHEMA), "")
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in out.collect()) == sorted((n, d or 0) for d, n in brute_first(rows))


def test_few_texts_just_below_the_similarity_become_pairs(spark, monkeypatch):
    from statspark.llm import store

    rng = random.Random(9)
    base = [f"{rng.getrandbits(40):x}" for _ in range(300)]
    rows = []
    for i in range(40):
        w = list(base)
        for at in rng.sample(range(5, 295, 10), 5):
            w[at] = f"{rng.getrandbits(40):x}"
        rows.append((i, " ".join(w)))
    made, table = [], store.table
    monkeypatch.setattr(store, "table", lambda df, name: made.append((name, out := table(df, name), out.count())) or out)
    out = simhash.keep_one(spark.createDataFrame(rows, SCHEMA), k=5, similarity=0.8)
    assert sorted((r.doc_id, r.text) for r in out.collect()) == sorted((d, dict(rows)[d]) for d, _ in brute_first(rows))
    assert sum(n for name, _, n in made if name == "pairs") < 100
