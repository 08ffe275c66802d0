import math
import random
import re

import pytest
from pyspark.sql import functions as F

from statspark.llm import pii, queries, secrets

SCHEMA = "doc_id long, text string"


def naive_pii(t):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        digits = re.sub("[^0-9]", "", m[0])
        if 13 <= len(digits) <= 19 and pii.luhn(digits):
            out.append(("card", *m.span()))
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]


def naive_secrets(t):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t, re.I | re.A) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
    return [(secrets.KINDS[k], a, b) for a, k, b in sorted(out)]


def test_base_spans_equal_plain_patterns():
    rng = random.Random(4)
    for _ in range(3000):
        t = "".join(rng.choice("ab1234.@+ -()é") for _ in range(70))
        assert pii.base_spans(t) == naive_pii(t)
        u = "".join(rng.choice(["token", "=", ":", "'", " ", "abc1", "AKIA", "0123456789abcdef", "Z9", "é", "PassWord"]) for _ in range(25))
        assert secrets.base_spans(u) == naive_secrets(u)
    assert pii.base_spans("4111 1111-1111 1111") == [("card", 0, 19)]


def test_long_runs_are_linear():
    n = 300_000
    for t in ("1" * n, "a" * n, "a." * (n // 2), "1 " * (n // 2), "+" + "1" * n, "f" * n, "@" * n):
        pii.base_spans(t)
        secrets.base_spans(t)


def rows():
    # 'reach me via' goes before many emails and cards; then it finds what no base pattern matches.
    known = [(i, f"words here reach me via user{i}@mail.example.com and more") for i in range(12)]
    return [*known, (50, "reach me via user_at_mail_99887766 and more"), (51, "version 20260101 and more"), (52, ""), (53, None), (None, "x@y.zz"), (54, "a@b.cc"), (54, "a@b.cc")]


def test_contexts_find_unseen_identifiers(spark):
    df = spark.createDataFrame(rows(), SCHEMA).withColumns({"rid": F.lit(0), "base": F.lit("x"), "kind": F.lit(1)})
    out = pii.digest(pii.find(df))
    got = {r.doc_id: r for r in out.collect() if r.doc_id is not None}
    assert out.count() == len(rows())
    assert got[50].spans == "ctx_email:13:34" and got[51].spans == "" and got[52].spans == got[53].spans == ""
    assert (got[54].n_email, got[54].base_sha256) == (1, pii.sha([("email", 0, 6)]))


def brute_graph(found):
    """The rounds of the graph by plain loops: {instance: (kind, score)}."""
    edges = {(i, k, a, p) for i, k, a, ps in found for p in ps}
    accepted = {}
    while True:
        total, conf = {}, {}
        for i, kind, allows, p in edges:
            own, w = (kind, 1.0) if kind else accepted.get(i, (None, 0.0))
            for j, name in enumerate(pii.KINDS):
                s = total.setdefault((p, j), [0.0, 0])
                s[0] += w * (own == name)
                s[1] += allows >> j & 1
        for key, (w, n) in total.items():
            if w >= pii.MIN_SEEDS and n and w / n >= pii.MIN_CONFIDENCE - 1e-9:
                conf[key] = w / n
        votes = {}
        for i, kind, allows, p in edges:
            if kind is None and i not in accepted:
                for j in range(4):
                    if allows >> j & 1 and (p, j) in conf:
                        votes.setdefault(i, {}).setdefault(j, []).append(min(conf[p, j], 0.999))
        new = {}
        for i, by in votes.items():
            scores = {j: 1 - math.prod(1 - c for c in cs) for j, cs in by.items() if len(cs) >= pii.MIN_PATTERNS}
            if not scores:
                continue
            j = min(scores, key=lambda x: (-round(scores[x], 9), x))
            if scores[j] >= pii.ACCEPT:
                new[i] = (pii.KINDS[j], scores[j])
        if not new:
            return accepted
        accepted |= new


def test_score_graph_equals_plain_loops(spark):
    rng = random.Random(12)
    found = []
    for _ in range(900):
        topic = rng.randrange(8)
        i = topic * 100 + rng.randrange(40 if topic < 4 else 4)
        kind = pii.KINDS[topic % 4] if topic < 4 and i % 100 < 35 else None
        found.append((i, kind, 1 << topic % 4 | (i % 16 if kind is None and i % 3 == 0 else 0), [topic * 10 + rng.randrange(3), 200 + topic // 4, 300 + topic % 4 * 5 + rng.randrange(2)]))
    got = pii.score_graph(spark.createDataFrame(found, "instance long, kind string, allows int, patterns array<long>")).collect()
    want = brute_graph(found)
    assert {r.instance: r.kind for r in got} == {i: k for i, (k, _) in want.items()} and len(want) >= 8
    assert all(abs(r.score - want[r.instance][1]) < 1e-6 for r in got)


def test_discovery_goes_on_from_accepted_identifiers(spark):
    """Tokens in contexts that only discovered identifiers share, and never a seed."""
    rows = [f"write to staff{i + 100}@mail.example.com now" for i in range(40)]
    rows += [f"write to staff{i}_at_mail_{1000 + i} now" for i in range(8)]
    rows += [f"alias: staff{i}_at_mail_{1000 + i} ok" for i in range(8)] + ["alias: someone_at_home_4321 ok", "width: someone_at_home_4322 ok"]
    out = pii.digest(pii.find(spark.createDataFrame(list(enumerate(rows)), SCHEMA))).collect()
    got = {r.doc_id: r.spans for r in out}
    assert all(got[40 + i].startswith("ctx_email:9:") and got[48 + i].startswith("ctx_email:7:") for i in range(8))
    assert got[56].startswith("ctx_email:7:") and got[57] == ""


def planted(rng):
    """(text, kind of an identifier that no base pattern takes, or None, its start and end), with seeds in the same contexts."""
    leads = {"email": ["reach me via", "send mail to", "mailbox:"], "ip": ["host at", "address is", "pinged"], "card": ["charged to card", "visa number", "paid by"], "phone": ["call me on", "tel.", "dial"]}
    d = lambda n: "".join(rng.choice("0123456789") for _ in range(n))

    def luhn_card(ok):
        while True:
            x = "4" + d(15)
            if pii.luhn(x) == ok:
                return x

    seed = {"email": lambda: f"u{d(6)}@mail.example.org", "ip": lambda: ".".join(str(rng.randrange(256)) for _ in range(4)), "card": lambda: luhn_card(True), "phone": lambda: f"+44 {d(4)} {d(6)}"}
    odd = {"email": lambda: f"u{d(6)}_at_mail_org", "ip": lambda: ":".join(d(4) for _ in range(8)), "card": lambda: luhn_card(False), "phone": lambda: f"0{d(4)}-{d(6)}"}
    rows = []
    for _ in range(1600):
        kind = rng.choice(list(leads))
        lead = rng.choice(leads[kind])
        fill = " ".join(rng.choice(["some", "plain", "words", "of", "prose"]) for _ in range(rng.randrange(1, 9)))
        what = rng.random()
        if what < 0.8:
            rows.append((f"{fill} {lead} {seed[kind]()} thanks {fill}", None, 0, 0))
        elif what < 0.9:
            token = odd[kind]()
            at = len(f"{fill} {lead} ")
            rows.append((f"{fill} {lead} {token} thanks {fill}", kind, at, at + len(token)))
        else:
            rows.append((f"{fill} {rng.choice(['order no.', 'version', 'built on', 'part'])} {rng.choice([d(8), d(16), 'x' + d(9), d(2) + '.' + d(4)])} {fill}", None, 0, 0))
    return rows


def test_precision_and_recall_of_planted_identifiers(spark):
    rows = planted(random.Random(5))
    out = {r.doc_id: r.added for r in pii.find(spark.createDataFrame([(i, t) for i, (t, *_) in enumerate(rows)], SCHEMA)).collect()}
    for kind in pii.KINDS:
        want = {(i, a, z) for i, (_, k, a, z) in enumerate(rows) if k == kind}
        got = {(i, s.start, s.end) for i, added in out.items() for s in added if s.kind == f"ctx_{kind}"}
        assert len(want & got) >= 0.9 * len(want) and len(want & got) >= 0.9 * len(got), (kind, len(want), len(got), len(want & got))


def test_very_long_texts_and_equal_rows(spark):
    long = "pad " * 300_000 + "write to a@b.cc now " + "z" * 100_000 + " 1234567890123456"
    df = spark.createDataFrame([(1, long), (1, long), (2, "tie a@b.cc"), (3, "tie a@b.cc")], SCHEMA)
    got = [(r.doc_id, r.spans) for r in pii.digest(pii.find(df)).collect()]
    at = long.index("a@b.cc")
    assert sorted(got) == [(1, f"email:{at}:{at + 6}")] * 2 + [(2, "email:4:10"), (3, "email:4:10")]


def test_redaction_keeps_columns(spark):
    df = spark.createDataFrame([(d, t, "s", len(t or "")) for d, t in rows()], SCHEMA + ", source string, n_chars long")
    out = pii.redact(df)
    assert out.schema.simpleString() == df.schema.simpleString() and out.count() == len(rows())
    text = {r.doc_id: (r.text, r.n_chars) for r in out.collect()}
    assert text[0] == ("words here reach me via [email] and more", 40) and text[50][0] == "reach me via [ctx_email] and more" and text[53][0] is None


def test_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert pii.find(empty).count() == 0 and secrets.scan(empty).count() == 0


def test_guess_cost_orders_values():
    cost = secrets.guess_cost
    assert cost("") == 0
    assert cost("password") < cost("password2019") < cost("hunter2") < cost("X9$kQ2!vLp")
    assert cost("aaaaaaaaaaaa") < 6 and cost("qwertyuiop") < 6 and cost("2019-12-04") < 8
    assert cost("x" * 20_000) < 8 and cost("Zq7&" * 2000) > 100


def all_segmentations(value, words):
    """The least cost over all segmentations, each segment of each kind, by plain recursion."""
    low, plain = value.lower(), value.lower().translate(secrets._PLAIN)
    mixed = math.log10(2) if value != low and value != value.upper() else 0.0
    rank = {w: i + 1 for i, w in enumerate(dict.fromkeys([*secrets.WORDS, *words]))}

    def segment(a, z):
        part, n = low[a:z], z - a
        costs = [sum(secrets._brute(c) + (mixed if c.isalpha() else 0.0) for c in value[a:z])]
        if n >= 3 and len(set(part)) == 1:
            costs.append(min(secrets._brute(c) for c in value[z - 1]) + math.log10(n))
        if n >= 3 and all(part[j : j + 2] in secrets._NEXT for j in range(n - 1)):
            costs.append(math.log10(len(secrets.ROWS) * 12 * 2 * n))
        if n >= 3:
            own = [rank[part]] if part in rank else [4 * rank[plain[a:z]]] if plain[a:z] in rank else []
            costs += [math.log10(r * (2 if value[a:z] != part else 1) + 1) for r in own]
        if secrets._DATE.fullmatch(value, a, z):
            costs.append(secrets._date(n))
        return math.log10(4) + min(costs)

    best = [0.0]
    for z in range(1, len(value) + 1):
        best.append(min(best[a] + segment(a, z) for a in range(z)))
    return best[-1]


def test_guess_cost_is_the_minimum_over_all_segmentations():
    rng = random.Random(6)
    guesser = secrets.Guesser(["tulip", "lip", "dddd"])
    parts = ["password", "p@ss", "dddd", "d", "2000", "1234", "qwer", "Tulip", "lip", "X", "9", "$", "20001234", "2020-0101", "aaa", "AAAA", "fds", "0", "é"]
    for value in ["passworddddd", "20001234", "aaaabcd", "111123", *("".join(rng.choice(parts) for _ in range(rng.randint(1, 6))) for _ in range(1500))]:
        assert guesser.cost(value) == pytest.approx(all_segmentations(value, ["tulip", "lip", "dddd"])), value


def test_secret_scan(spark):
    data = [
        (1, "pwd: X9$kQ2!vLp end"), (2, "pwd: password"), (3, "the token = abcdef123456"), (4, None), (5, ""), (6, "PASSWORD IS X9$kQ2!vLp"), (7, "secret=Zq8#Lm2@Wx and secret=Zq8#Lm2@Wx"),
        (8, "x " * 500_000 + "login: v7R!m4Kd$"), (9, "token: kT5vB8nM3qLx"),
    ]
    df = spark.createDataFrame([*data, data[0], (None, data[0][1])], SCHEMA).withColumns({"base": F.lit(1), "word": F.lit("x"), "added": F.lit(2)})
    out = secrets.digest(secrets.scan(df)).collect()
    got = {r.doc_id: r.spans for r in out if r.doc_id}
    assert got == {
        1: "guess:5:15", 2: "", 3: "assign:4:24", 4: "", 5: "", 6: "guess:12:22", 7: "guess:7:17,guess:29:39", 8: "guess:1000007:1000016", 9: "assign:0:19,guess:7:19",
    }
    assert sorted(r.spans for r in out if r.doc_id in (1, None)) == ["guess:5:15"] * 3
    assert {r.doc_id: r.n_guess for r in out}[9] == 1 and {r.doc_id: r.weakest for r in out}[2] < 3


def test_corpus_words_are_counted_over_all_texts(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(["Tulip tulip, rose", "tulip rose oak", None, "", "ab a1oak oak " * 3])], SCHEMA)
    assert secrets.common_words(df, most=3) == ["oak", "tulip", "rose"]
    assert secrets.common_words(df.limit(0)) == []


def test_planted_secrets_are_found(spark):
    """Random values of eight characters and more in credential contexts, none of which a base pattern takes."""
    rng = random.Random(9)
    names = ["password", "pwd", "login", "auth_key", "client-secret", "Bearer", "passphrase", "api-key"]
    texts = [f"see {rng.choice(names)}{rng.choice([': ', '=', ' is ', ' => '])}{''.join(rng.choice('aZ9kQ2vLpR7mX4') + rng.choice('!$#%&*') for _ in range(rng.randint(4, 8)))} here" for _ in range(300)]
    plain = [f"the {rng.choice(names)} is {rng.choice(['required', 'password', 'qwertyuiop', '12345678', 'summer2019', 'aaaaaaaa'])} here" for _ in range(300)]
    out = secrets.scan(spark.createDataFrame(list(enumerate(texts + plain)), SCHEMA)).collect()
    assert sum(len(r.added) == 1 for r in out if r.doc_id < 300) >= 295
    assert sum(len(r.added) > 0 for r in out if r.doc_id >= 300) == 0


def test_every_operator_has_a_query():
    assert sorted(int(k[2:].split("_")[0]) for k in queries.QUERIES) == list(range(1, 11))
