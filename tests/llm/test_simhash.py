import random

import numpy as np
import pytest
import xxhash

from linkweave.llm import simhash
from linkweave.llm.components import connected_components


def roots(n, links):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    return [find(i) for i in range(n)]


def brute_fingerprint(text, width=3):
    words = (text or "").encode().lower().split()
    shingles = [words[i : i + width] for i in range(len(words) - width + 1)] or ([words] if words else [])
    h = [xxhash.xxh64_intdigest(b" ".join(s), 42) for s in shingles]
    return sum(1 << i for i in range(64) if 2 * sum(x >> i & 1 for x in h) > len(h)) if h else 0


def make_docs(seed=1):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 5)))
    texts = [None, "", " \n\t", "One", "one two", "ONE two"]
    for _ in range(40):
        base = [word() for _ in range(rng.choice([3, 10, 60, 200]))]
        texts.append(" ".join(base))
        for _ in range(rng.choice([0, 0, 1, 4])):
            copy = list(base)
            if rng.random() < 0.6:
                copy[rng.randrange(len(copy))] = word()
            texts.append("\n".join(copy).upper() if rng.random() < 0.2 else " ".join(copy))
    texts.append(" ".join(word() for _ in range(40_000)))
    return list(enumerate(texts))


def test_fingerprints_and_components_match_brute_force(spark):
    rows = make_docs()
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, fp string, component_id int")
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.op1_simhash_near_dedup(docs).collect()}
    prints = [brute_fingerprint(t) for _, t in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 2]
    assert got == {i: (f"{p:016x}", r) for (i, _), p, r in zip(rows, prints, roots(len(rows), links))}


def test_repeated_and_null_ids_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "a b c"), (1, "x y z"), (None, "a b c"), (2, "x y z"), (None, "q r s t")], "doc_id long, text string")
    got = sorted(((r.doc_id, r.component_id) for r in simhash.op1_simhash_near_dedup(docs).collect()), key=str)
    assert got == sorted([(1, 1), (1, 1), (None, 1), (2, 1), (None, None)], key=str)
    assert simhash.op1_simhash_near_dedup(docs.limit(0)).count() == 0
    assert simhash.drop_near_duplicates(docs.limit(0)).count() == 0


@pytest.mark.parametrize("size", [2, 16, 17, 300, 5000])
def test_index_finds_every_pair(size):
    rng = np.random.default_rng(size)
    base = rng.integers(0, 1 << 63, max(1, size // 20), dtype=np.uint64)
    fps = rng.choice(base, size)
    for _ in range(2):
        fps = fps ^ np.where(rng.random(size) < 0.7, np.uint64(1) << rng.integers(0, 64, size).astype(np.uint64), np.uint64(0))
    rank = fps.copy()
    for s in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(s)
    fps = fps[np.argsort(rank)]
    q, m = simhash.GrayIndex(fps).search(fps, 2)
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 2
    assert sorted(zip(q.tolist(), m.tolist())) == sorted(zip(*map(np.ndarray.tolist, np.nonzero(near))))


def test_split_nodes_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SPLIT_ABOVE", 8)
    rng = np.random.default_rng(3)
    fps = np.unique((rng.integers(0, 1 << 10, 400) << 20) | 5)
    fps = [int(f) for f in fps]
    links = simhash.hamming_links(spark.createDataFrame([(f,) for f in fps], "fp long"))
    got = {r.node: r.component for r in connected_components(links).collect()}
    want = roots(len(fps), [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 2])
    assert [got.get(f, f) for f in fps] == [fps[r] for r in want]


def test_components_of_long_paths(spark):
    rng = random.Random(5)
    links = [(i, i + 1) for i in range(60)] + [(100, 107), (107, 103), (5, 5)]
    rng.shuffle(links)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame([*links, (None, 3)], "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 103: 100, 107: 100}


def test_one_document_of_each_group_stays(spark):
    rows = [(i, t) for i, t in make_docs(9)]
    rng = random.Random(2)
    base = [f"w{rng.randrange(5000)}" for _ in range(120)]
    for k in range(120):  # a large group whose copies are nearer to the original than to each other
        copy = list(base)
        for _ in range(rng.choice([0, 1, 2])):
            copy[rng.randrange(120)] = f"n{k}"
        rows.append((len(rows), " ".join(copy)))
    rows += [(3, rows[3][1]), (None, "null id"), (None, "null id")]
    docs = spark.createDataFrame([(i, t, f"s{k}") for k, (i, t) in enumerate(rows)], "doc_id long, text string, source string")
    out = simhash.drop_near_duplicates(docs)
    assert out.columns == docs.columns

    def shingles(t):
        w = (t or "").encode().lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    known = [(i, shingles(t)) for i, t in rows if i is not None]
    same = lambda x, y: x == y or len(x & y) >= 0.8 * len(x | y)
    want = roots(len(known), [(p, q) for p in range(len(known)) for q in range(p) if known[p][0] == known[q][0] or same(known[p][1], known[q][1])])
    keep = sorted({known[r][0] for r in want})
    assert sorted(r.doc_id for r in out.where("doc_id is not null").collect()) == keep
    assert out.where("doc_id is null").count() == 2
