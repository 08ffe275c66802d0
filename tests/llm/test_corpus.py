import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from statspark.llm import decontam, packing, quality, sharding, substring
from statspark.llm.queries import tokenizer_path

SCHEMA = "doc_id long, text string"


def words(rng, n):
    return [rng.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa".split()) + str(rng.randint(0, 400)) for _ in range(n)]


@pytest.mark.parametrize("gather", [2, 1 << 20])
def test_windows_equal_brute_force(spark, monkeypatch, gather):
    import hashlib

    monkeypatch.setattr(substring, "GATHER", gather)
    rng = random.Random(8)
    shared = words(rng, 80)
    rows = [(i, " ".join(words(rng, rng.randint(0, 150)))) for i in range(30)]
    rows += [(100 + i, " ".join([*words(rng, 20), *shared[rng.randint(0, 20) :], *words(rng, 5)])) for i in range(25)]
    # Words that collide under any polynomial hash modulo 2**64.
    morse = ["".join("ab"[(i.bit_count() + flip) % 2] for i in range(2048)) for flip in (0, 1)]
    rows += [(150 + i, " ".join([m, *shared[:49]])) for i, m in enumerate(morse)]
    rows += [(200, rows[3][1]), (200, rows[3][1]), (201, "\n".join(shared)), (202, ""), (203, "w " * 120), (204, "w " * 130)]
    df = spark.createDataFrame(rows + [(300, None)], SCHEMA).withColumns({"d": F.lit(1), "th": F.lit(2), "pos": F.lit("x")})
    got = sorted((r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.kept_text.encode()).hexdigest()) for r in substring.dedup(df, max_width=1 << 16).collect())
    assert got == sorted(substring.brute_force([*rows, (300, "")]))
    assert substring.dedup(df.limit(0)).count() == 0


@pytest.mark.parametrize("k", [1, 2, 3, 7])
def test_short_windows_and_very_long_texts_equal_brute_force(spark, k):
    import hashlib

    rng = random.Random(k)
    rows = [(i, "".join(rng.choice("ab") + rng.choice(" \t\n") for _ in range(rng.randint(0, 12)))) for i in range(40)] + [(50, "x y " * 100_000), (51, "y x " * 50_000 + "end")]
    got = sorted((r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.kept_text.encode()).hexdigest()) for r in substring.dedup(spark.createDataFrame(rows, SCHEMA), k=k).collect())
    assert got == sorted(substring.brute_force(rows, k))


def test_shards_are_even_and_gapless(spark):
    rows = [(i, "hot text") for i in range(300)] + [(i, f"t{i % 550}") for i in range(300, 900)] + [(900, None), (901, ""), (None, "x"), (5, "hot text")]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"shard": F.lit("x"), "rid": F.lit(1), "grp": F.lit(2)})
    out = sharding.shard(df).collect()
    by = defaultdict(list)
    for r in out:
        by[r.shard].append(r.slot)
    assert len(out) == len(rows) and set(by) == set(range(24))
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    copies = defaultdict(set)
    for r in out:
        copies[r.text_crc32].add(r.shard)
    assert sum(len(s) > 1 for s in copies.values()) <= 1 and len(copies[zlib.crc32(b"hot text")]) <= 10
    assert {r.size for r in out if r.text_crc32 == 0} == {8}
    assert sharding.shard(df.limit(0)).count() == 0


def test_pieces_hold_every_id_once(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path())
    rng = random.Random(3)
    texts = [" ".join(words(rng, rng.randint(0, 900))) for _ in range(40)] + ["", None, "a  b   c \n d", "<|endoftext|> x", "\x1c y", "don't", "x" * 5000]
    out = packing.pack_documents(spark.createDataFrame(list(enumerate(texts)), SCHEMA).withColumn("ids", F.lit(1)), tokenizer_path(), group_tokens=6000).collect()
    ids, seqs = defaultdict(list), defaultdict(list)
    for r in out:
        ids[r.doc_id].append((r.start, list(np.frombuffer(r.ids, dtype="<u4"))))
        seqs[r.sequence_id].append((r.offset, r.length))
    for i, t in enumerate(texts):
        whole = [x for _, part in sorted(ids[i]) for x in part]
        assert whole == [*tok.encode(t or "", add_special_tokens=False).ids, 0]
    for s in seqs.values():
        at = 0
        for offset, n in sorted(s):
            assert offset == at
            at += n
        assert at <= 1024
    total = sum(len(x) for parts in ids.values() for _, x in parts)
    assert len(seqs) <= total / 1024 + total / 6000 + 2


def test_packing_balances_cost():
    rng = random.Random(1)
    lengths = [rng.randint(1, 1500) for _ in range(3000)]
    cost = defaultdict(float)
    for _, _, n, s, _ in packing.pack(lengths):
        cost[s] += packing.LINEAR * n + packing.QUADRATIC * n * n
    seqs: list[list[int]] = []  # the same remainders, each to the first sequence with room
    for n in sorted((n % 1024 for n in lengths if n % 1024), reverse=True):
        for q in seqs:
            if sum(q) + n <= 1024:
                q.append(n)
                break
        else:
            seqs.append([n])
    first_fit = [sum(packing.LINEAR * n + packing.QUADRATIC * n * n for n in q) for q in seqs]
    balanced = [c for s, c in cost.items() if s >= sum(n >= 1024 for n in lengths)]
    assert len(balanced) <= len(seqs) and np.std(balanced) < np.std(first_fit)


def test_model_beats_the_prior_on_held_out_rows(spark):
    rng = random.Random(6)
    good = lambda: " ".join(words(rng, 120))
    bad = lambda: " ".join(w + "###" for w in words(rng, 120))
    rows = [(i, good() if i % 3 else bad(), int(bool(i % 3))) for i in range(300)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(1000, None), (None, ""), (1001, "x" * 200_000)], SCHEMA).withColumns({"score": F.lit("x"), "x": F.lit(1)})
    labels = spark.createDataFrame([(i, y, 0) for i, _, y in rows] + [(1, 1, 0), (None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    out = {r.doc_id: r for r in quality.classify(docs, labels).collect()}
    held = [(out[i].predicted, y) for i, _, y in rows if out[i].held_out]
    assert len(out) == 303 and len(held) > 60 and sum(p == y for p, y in held) / len(held) > 0.95
    assert all(out[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, _, _ in rows)
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and 180 < kept.count() < 210
    none = quality.classify(docs, labels.limit(0)).select("score").distinct().collect()
    assert [r.score for r in none] == [0.5] and quality.classify(docs.limit(0), labels).count() == 0


def test_features_against_plain_python():
    texts = ["", None, "Ab cd ab cd\nx\nx", "A!! b| 12 é.", "a b c d a b c"]
    x = quality.features(pa.array(texts))
    name = {n: i for i, n in enumerate(quality.FEATURES)}
    assert x[0].tolist() == x[1].tolist() == [0.0] * len(quality.FEATURES)
    assert x[2, name["distinct_words"]] == pytest.approx(4 / 6) and x[4, name["repeated_windows"]] == pytest.approx(1 / 5)
    assert x[3, name["exclaim"]] == pytest.approx(2 / 4) and x[3, name["pipe"]] == pytest.approx(1 / 4)


def naive_tiles(doc, item, k):
    """The textbook loop: the longest free match, earliest first, again and again."""
    used_d, used_i, out = set(), set(), []
    while True:
        best = None
        for d in range(len(doc)):
            for i in range(len(item)):
                n = 0
                while d + n < len(doc) and i + n < len(item) and doc[d + n] == item[i + n] and d + n not in used_d and i + n not in used_i:
                    n += 1
                if n >= k and (best is None or (-n, d, i) < best):
                    best = (-n, d, i)
        if best is None:
            return out
        n, d, i = -best[0], best[1], best[2]
        out.append((d, i, n))
        used_d.update(range(d, d + n))
        used_i.update(range(i, i + n))


def test_tiling_equals_the_plain_loop():
    rng = random.Random(9)
    for _ in range(60):
        item = [rng.choice("abc") for _ in range(rng.randint(5, 25))]
        doc = [rng.choice("abc") for _ in range(30)] + item[10:] + ["x"] + item[:10]
        seeds = [(d, i) for d in range(len(doc) - 4) for i in range(len(item) - 4) if doc[d : d + 5] == item[i : i + 5]]
        assert sum(n for *_, n in decontam.tiles(doc, item, seeds)) == sum(n for *_, n in naive_tiles(doc, item, 5))


def test_reordered_passages_are_found(spark):
    rng = random.Random(7)
    item = words(rng, 40)
    clean = words(rng, 300)
    docs = [(1, " ".join(clean[:50] + item[20:] + clean[50:60] + item[:20])), (2, " ".join(clean)), (3, " ".join(item[:12] + clean)), (4, " ".join(item).upper() + "!"), (5, None), (6, ""), (None, " ".join(item)), (4, " ".join(item))]
    df = spark.createDataFrame(docs, SCHEMA).withColumns({"rid": F.lit("x"), "item_id": F.lit(5)})
    bench = spark.createDataFrame([(10, " ".join(item)), (11, "too short"), (12, None), (13, " ".join(words(rng, 30)))], "item_id long, text string")
    for block in (10, 1000):
        out = decontam.contaminated(df, bench, block_words=block).collect()
        assert sorted(((r.doc_id, r.item_id) for r in out), key=str) == [(1, 10), (4, 10), (4, 10), (None, 10)]
        assert {r.n_tiles for r in out if r.doc_id == 1} == {2}
    left = decontam.remove(df, bench)
    assert left.columns == df.columns and sorted(r.doc_id for r in left.collect()) == [2, 3, 5, 6]
    assert decontam.contaminated(df.limit(0), bench).count() == 0 and decontam.contaminated(df, bench.limit(0)).count() == 0


def test_items_shorter_than_a_seed_are_found(spark):
    docs = [(1, "so Call me, Ishmael! he said"), (2, "call him ishmael me"), (3, "one"), (4, "zero"), (5, None), (6, "call me"), (None, "x a b c d y")]
    df = spark.createDataFrame(docs, SCHEMA)
    bench = spark.createDataFrame([(10, "call me Ishmael"), (11, "zero"), (12, ""), (13, None), (14, "a b c d"), (15, "zero one two three four five six")], "item_id long, text string")
    for block in (3, 1000):
        out = decontam.contaminated(df, bench, block_words=block).collect()
        assert sorted(((r.doc_id, r.item_id, r.covered, r.n_words, r.coverage, r.n_tiles) for r in out), key=str) == [(1, 10, 3, 3, 1.0, 1), (4, 11, 1, 1, 1.0, 1), (None, 14, 4, 4, 1.0, 1)]
    assert sorted(r.doc_id for r in decontam.remove(df, bench).collect()) == [2, 3, 5, 6]


def cut(out):
    """Texts in more than one shard; counts and slots have to be even and gapless."""
    by, copies = defaultdict(list), defaultdict(set)
    for r in out:
        by[r.shard].append(r.slot)
        copies[r.text_crc32].add(r.shard)
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    return sum(len(s) > 1 for s in copies.values())


def test_groups_are_joined_whatever_the_rounds(spark):
    rows = [(i, f"pair {i // 2}") for i in range(2900)] + [(i, f"one {i}") for i in range(2900, 3000)]
    for rounds in (0, 2):
        out = sharding.shard(spark.createDataFrame(rows, SCHEMA), max_rounds=rounds).collect()
        assert sorted(r.doc_id for r in out) == list(range(3000)) and cut(out) == 0


def test_groups_are_joined_without_unlinked_rows(spark):
    out = sharding.shard(spark.createDataFrame([(i, f"pair {i // 2}") for i in range(2976)], SCHEMA)).collect()
    assert sorted(r.doc_id for r in out) == list(range(2976)) and cut(out) == 0


def test_encoder_takes_few_times_the_bytes_of_its_ids():
    import tracemalloc

    rng = random.Random(8)
    words = [f"w{rng.getrandbits(24):x}" for _ in range(5000)]
    column = pa.array([" ".join(rng.choices(words, k=1000)) for _ in range(200)])
    encoder = packing.Encoder(tokenizer_path())
    encoder(column)
    tracemalloc.start()
    ids, ends = encoder(column)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 4.5 * ids.nbytes
    for t, a, z in zip(column.to_pylist()[:3], [0, *ends], ends):
        assert ids[a : z - 1].tolist() == encoder.tokenizer.encode(t, add_special_tokens=False).ids and ids[z - 1] == packing.END_ID
