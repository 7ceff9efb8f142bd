import hashlib
import random
import re

from linkweave.llm.pii import KINDS, op2_pii

FORMS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0


def valid(kind, m):
    d = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(x) <= 255 for x in m.split("."))
    return {"email": True, "card": 16 <= len(d) <= 19 and luhn(d), "phone": 8 <= len(d) <= 15}[kind]


def brute(t):
    return [(k, m.start(), m.end()) for k in KINDS for m in re.finditer(FORMS[k], t or "") if valid(k, m.group(0))]


def test_base_spans_match_brute_force(spark):
    rng = random.Random(6)
    parts = ["a@b.c", "a@b", "_x", "@d.e", ".", "-", " ", "\n", "1.2.3.4", ".5", "256.1.1.1", "0001.2.3.255", "4532015112830366", "4532 0151 1283 0366", "4532015112830367", "+1 (743) 555-3824", "+", "1", "12", "+44 20 7946 0958", "é", "😀", "(", "x%y@z-w.org", "99999999999999999999.1.1.1", "a.b+c@d.e.f"]
    texts = [None, "", " "] + ["".join(rng.choice(parts) for _ in range(rng.randint(1, 14))) for _ in range(400)]
    texts += ["a" * 100_000, "1" * 100_000, "1." * 5_000, "a." * 50_000 + "@", "+1" * 5_000, "word " * 20_000 + "q@r.st"]
    rows = list(enumerate(texts))
    docs = spark.createDataFrame([(i, t, "m") for i, t in rows], "doc_id long, text string, candidates string").repartition(4)
    got = {r.doc_id: r for r in op2_pii(docs).collect()}
    for i, t in rows:
        want = brute(t)
        assert [got[i][f"n_{k}"] for k in KINDS] == [sum(x[0] == k for x in want) for k in KINDS], t
        joined = ",".join(f"{k}:{s}:{e}" for k, s, e in want)
        assert got[i].base_sha256 == hashlib.sha256(joined.encode()).hexdigest(), t
        assert set(filter(None, joined.split(","))) <= set(got[i].spans.split(",")), t


def test_contexts_discover_unseen_identifiers(spark):
    texts = [f"please bill to account {4000 + i}@pay{i}.example.org today" for i in range(8)]
    texts += ["please bill to account 77-8842-AX today", "the year 2024-2025 was long", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.spans for r in op2_pii(docs).collect()}
    at = texts[8].index("77-")
    assert got[8] == f"email:{at}:{at + 10}"
    assert got[9] == "" and got[10] == ""


def test_unseen_identifiers_of_any_form(spark):
    unseen = ["AB123456", "DE89370400440532013000", "DE89 3704 0044 0532 0130 00", "jane.doe[at]host", "0170 1234567", "(555) 123-4567", "é-77", "77-8842-AX", "7"]
    texts = [f"please bill to account {'abcdefgh'[i % 8] * (1 + i // 8)}@pay{i}.example.org today" for i in range(60)]
    texts += [f"please bill to account {x} today" for x in unseen] + ["account id:AB123456 4@b.c 99", "bill to account holders", "see AB123456 there"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.spans for r in op2_pii(docs).collect()}
    for i, x in enumerate(unseen):
        at = texts[60 + i].index(x)
        assert got[60 + i] == f"email:{at}:{at + len(x)}", x
    assert got[69].startswith("email:20:25") and got[70] == "" and got[71] == ""


def test_empty_and_repeated_rows(spark):
    docs = spark.createDataFrame([(1, "a@b.c"), (1, "a@b.c"), (None, "a@b.c")], "doc_id long, text string")
    assert [r.spans for r in op2_pii(docs).collect()] == ["email:0:5"] * 3
    assert op2_pii(docs.limit(0)).count() == 0


def test_secrets_seed_their_context(spark):
    rng = random.Random(4)
    digits = lambda n, of="0123456789abcdef": "".join(rng.choice(of) for _ in range(n))
    texts = [f'some words and token = "{digits(40)}" more {i}' for i in range(20)] + [f'TOKEN = "{digits(40).upper()}"!! MORE', "a token = 'qz-81-live' here", "commit " + digits(40) + " went in", "AKIA" + digits(16, "ABC123")]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in op2_pii(docs).collect()}
    for i, t in enumerate(texts[:20]):
        assert got[i].spans == f"secret:{t.index('"') + 1}:{t.index('"') + 41}"
    assert got[20].spans == "secret:9:49" and got[21].spans == "secret:11:21" and got[22].spans == "" and got[23].spans == "secret:0:20"
    assert all(r.n_spans == len(r.spans.split(",")) if r.spans else r.n_spans == 0 for r in got.values())


def test_scores_match_a_plain_scorer(spark):
    from linkweave.llm import pii

    rng = random.Random(9)
    rows = []
    for v in range(150):
        kind = rng.choice([None, None, 0, 2])
        at = [f"l w{rng.randrange(6) if kind is None else kind * 2 + rng.randrange(3)}" for _ in range(2)] + [f"r x{rng.randrange(12)}"]
        rows += [(kind, f"v{v}", [p]) for p in set(at)]
    got = {(r.pattern, r.kind): r.confidence for r in pii.score_graph(spark.createDataFrame(rows, "kind int, value string, patterns array<string>")).collect()}

    values, kinds = {}, {}
    for kind, v, ps in rows:
        kinds[v] = kind
        for p in ps:
            values.setdefault(p, set()).add(v)
    values = {p: v for p, v in values.items() if len(v) >= pii.SUPPORT}
    seeds = {(p, k): n for p, v in values.items() for k in (0, 2) if (n := sum(kinds[x] == k for x in v))}
    conf = {(p, k): n / (len(values[p]) - pii.KEEP * sum(kinds[x] is None for x in values[p]) + pii.PRIOR) for (p, k), n in seeds.items()}
    for _ in range(pii.ROUNDS):
        was = dict(conf)
        for p, vs in values.items():
            for k in (0, 2):
                best = [max([was.get((q, k), 0) for q, w in values.items() if x in w]) for x in vs if kinds[x] is None]
                gained = sum(pii.KEEP * b for b in best if b >= pii.CONFIDENCE / 10)
                if seeds.get((p, k)) or gained:
                    conf[p, k] = max(was.get((p, k), 0), (seeds.get((p, k), 0) + gained) / (len(vs) + pii.PRIOR))
        if all(c - was.get(x, 0) <= pii.CHANGE for x, c in conf.items()):
            break
    want = {x: c for x, c in conf.items() if c >= pii.CONFIDENCE}
    assert want and got.keys() == want.keys() and all(abs(got[x] - want[x]) < 1e-9 for x in want)


def test_a_text_with_very_many_spans(spark):
    import time

    text = " ".join(f"u{i}@pay.example.org code {i}" for i in range(10_000))
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    began = time.time()
    row = op2_pii(docs).first()
    assert row.n_email == 10_000 and time.time() - began < 60
