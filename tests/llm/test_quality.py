import random
from collections import Counter

import pytest

from linkweave.llm.quality import SYMBOLS, keep_good, op8_quality_rules


def words(t):
    return [w.decode() for w in (t or "").encode().split()]


def brute(t):
    t, w = t or "", words(t)
    seen, dup = set(), 0
    for line in t.split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    hit = {j for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    return len(w), sum(map(len, w)), sum(c in SYMBOLS for c in t), dup, len(hit), len(w) < 50 or 100 * len(hit) > 50 * len(w)


def texts():
    rng = random.Random(4)
    out = [None, "", " \t\n", "a", "a b", "a b c", "a a a a", "é x 😀 |", "x\ny\nx\n\n \nx", "a b c d a b c", "\x0b\x0ca\rb"]
    out += [" ".join(rng.choice("ab cd ef gh # $x".split()) for _ in range(n)) for n in (5, 49, 50, 51, 300)]
    out += ["\n".join(" ".join(f"w{rng.randrange(k)}" for _ in range(12)) for _ in range(30)) for k in (3, 30, 900, 90_000)]
    return [*out, " ".join(f"v{rng.randrange(10**6)}" for _ in range(60_000)), out[-1]]


def test_base_rules_match_brute_force(spark):
    rows = list(enumerate(texts()))
    docs = spark.createDataFrame([(i, t, 1, "a") for i, t in rows], "doc_id long, text string, target int, bucket string")
    labels = spark.createDataFrame([(16, 1), (None, 1), (3, 0)], "doc_id long, quality int")
    got = {r.doc_id: r for r in op8_quality_rules(docs, labels).collect()}
    for i, t in rows:
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute(t), (i, t)
        assert not (r.base_failed and r.kept)


@pytest.mark.parametrize("place_bits", [3, 8, 60])
def test_repeats_by_packed_hash_or_by_text(spark, place_bits):
    """3 and 8: texts too long for the places go by text; 60: four bits of the hash, so that different windows meet as neighbours."""
    from pyspark.sql import functions as F

    from linkweave.llm.common import WORD
    from linkweave.llm.quality import _repeat_words

    rng = random.Random(5)
    rows = [*texts()[:-2], *[" ".join(rng.choice("abcdefgh") for _ in range(n)) for n in range(3, 120)]]
    frame = spark.createDataFrame([(i, t or "") for i, t in enumerate(rows)], "i long, text string")
    got = dict(map(tuple, frame.select("i", _repeat_words(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), place_bits)).collect()))
    assert got == {i: brute(t)[4] for i, t in enumerate(rows)}


def test_ratio_matches_brute_force_and_separates(spark):
    import math
    import re

    import xxhash

    from linkweave.llm.quality import BUCKETS

    rng = random.Random(8)
    good = [" ".join(rng.choice("the of and river stone house".split()) + (f"x{rng.randrange(99)}" if rng.random() < 0.3 else "") for _ in range(80)) for _ in range(30)]
    bad = [" | ".join(f"x{rng.randrange(99)}&&&" for _ in range(80)) for _ in range(10)]
    rows = list(enumerate(good + bad + [None]))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i in range(20)] + [(35, 0)], "doc_id long, quality int")
    got = {r.doc_id: r for r in op8_quality_rules(docs, labels).collect()}

    def spark_hash(*values):
        h = 42
        for v in values:
            h = xxhash.xxh64_intdigest(v.encode(), h & (1 << 64) - 1)
        return (h - (1 << 64) if h >> 63 else h) % BUCKETS

    def grams(t):
        w = re.findall(r"[^\W]+|[^\w\s]+", (t or "").lower())
        return [spark_hash(x) for x in w] + [spark_hash(a, b) for a, b in zip(w, w[1:])]

    raw, target = [1] * BUCKETS, [1] * BUCKETS
    for i, t in rows:
        for g in grams(t):
            raw[g] += 1
            target[g] += i < 20
    weight = [math.log(b / sum(target)) - math.log(a / sum(raw)) for a, b in zip(raw, target)]
    for i, t in rows:
        g = grams(t)
        assert got[i].log_ratio == pytest.approx(sum(weight[x] for x in g) / len(g) if g else 0, abs=1e-9)
    kept = keep_good(docs, labels.where("quality = 1"))
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.kept} == set(range(30))


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert op8_quality_rules(docs, labels).count() == 0
