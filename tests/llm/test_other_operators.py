import gzip
import hashlib
import io
import random

import pyarrow.fs as pafs
import pytest
from pyspark.sql import functions as F

from linkweave.llm import chat, decontam, license, linedup, mixing, tokens, warc
from linkweave.llm.common import new_path


def test_counts_match_the_library_s_greedy_word_pieces(spark):
    from tokenizers import models

    rng = random.Random(3)
    pieces = sorted({"".join(rng.choice("abé") for _ in range(rng.randint(1, 5))) + rng.choice(["", tokens.END]) for _ in range(60)} | {"a", "b"} - {tokens.END})
    model = models.WordPiece({p: i for i, p in enumerate([*pieces, "?"])}, unk_token="?", max_input_chars_per_word=10**9, continuing_subword_prefix="")
    automaton = tokens.Automaton(pieces)
    for _ in range(3000):
        word = "".join(rng.choice("abébac") for _ in range(rng.randint(1, 30))) + tokens.END
        got = [t.value for t in model.tokenize(word)]
        assert automaton.count(word) == (-1 if got == ["?"] else len(got)), word
    docs = spark.createDataFrame([(1, None, 5), (2, "", 5), (3, "Ab ab!\nb", 5), (3, "Ab ab!\nb", 5), (None, "a" * 200_000, 5)], "doc_id long, text string, n_words int")
    got = tokens.token_counts(docs, ["a", "b", "ab" + tokens.END, "b" + tokens.END, "a" + tokens.END]).collect()
    assert [tuple(r) for r in got] == [(1, 0, 0, 0), (2, 0, 0, 0), (3, 4, 4, 1), (3, 4, 4, 1), (None, 1, 200_000, 0)]
    assert tokens.token_counts(docs.limit(0), ["a"]).count() == 0


def test_archives_round_trip_and_refer(spark):
    big = "<p>é</p>" * 40
    rows = [(3, "u", big), (1, "a b\r\nx", big), (2, None, "tiny"), (4, "u", "tiny"), (5, "u", None), (6, "u", ""), (None, "u", big), (7, "u", "WARC/1.1\r\n\r\n" * 30), (8, "u", "x" * 300_000)]
    pages = spark.createDataFrame([(*r, "k") for r in rows], "page_id long, url string, html string, payload string")
    got = {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.op4_warc(pages).collect()}
    size = lambda t: len((t or "").encode())
    sha = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    assert got == {i: (size(t), sha(t), "revisit" if i in (3, None) else "response", 1 if i in (3, None) else None) for i, _, t in rows}
    path = new_path(spark, "warc")
    files = warc.write_archives(warc.plan_records(pages), path, compress=False)
    back = warc.read_archives(files, path).where("record_type = 'response'").collect()
    assert {r.page_id: bytes(r.payload).decode() for r in back} == {i: t or "" for i, _, t in rows if i not in (3, None)}
    assert warc.op4_warc(pages.limit(0)).count() == 0


@pytest.mark.parametrize("compress", [True, False])
def test_headers_of_any_length_are_read(compress):
    records = [warc._record(i, u, b"page", hashlib.sha256(b"page").hexdigest(), "response", None) for i, u in enumerate(["u" * 70_000, " " * 900_000, "v"])]
    out = list(warc.salvage(io.BytesIO(b"".join(map(gzip.compress, records) if compress else records))))
    assert [(f[0], f[2]["x-page-id"], len(f[2]["warc-target-uri"])) for f in out] == [("record", "0", 70_000), ("record", "1", 2_700_000), ("record", "2", 1)]


def test_a_page_with_a_long_url_has_its_row(spark):
    pages = spark.createDataFrame([(1, "u" * 70_000, "x"), (2, "v", None)], "page_id long, url string, html string")
    assert sorted(r.page_id for r in warc.op4_warc(pages).collect()) == [1, 2]


@pytest.mark.parametrize("compress", [True, False])
def test_salvage_recovers_later_records_and_logs_gaps(compress):
    rng = random.Random(11)
    payloads = [bytes(rng.choice(b"abc WARC/1.1\r\n") for _ in range(rng.randint(0, 3000))) for _ in range(12)]
    records = [warc._record(i, "u", p, hashlib.sha256(p).hexdigest(), "response", None) for i, p in enumerate(payloads)]
    if compress:
        records = [gzip.compress(r) for r in records]
    starts = [sum(map(len, records[:i])) for i in range(13)]
    whole = b"".join(records)

    def read(data):
        out = list(warc.salvage(io.BytesIO(data)))
        return {int(f[2]["x-page-id"]): warc._payload(f[2], f[3])[0] for f in out if f[0] == "record"}, [f for f in out if f[0] == "gap"]

    assert read(whole) == (dict(enumerate(payloads)), [])
    for _ in range(15):
        hit = rng.randrange(12)
        at = starts[hit] + len(records[hit]) // 2
        kind = rng.choice(["flip", "cut", "junk"])
        bad = {"flip": whole[:at] + bytes([whole[at] ^ 0x55]) + whole[at + 1 :], "cut": whole[:at] + whole[at + 5 :], "junk": whole[: starts[hit]] + b"\x1f\x8b\x08WARC/1.1 junk" + whole[starts[hit] :]}[kind]
        got, gaps = read(bad)
        lost = set() if kind == "junk" else {hit}
        assert lost >= set(range(12)) - set(got)
        assert all(got[i] == payloads[i] for i in got)
        if set(got) != set(range(12)) or kind == "junk":
            assert gaps and gaps[0][1] == starts[hit]
            assert sum(g[2] for g in gaps) == len(bad) - sum(len(records[i]) for i in got)
    got, gaps = read(whole[: starts[11] + 20])
    assert set(got) == set(range(11)) and gaps[0][1:3] == (starts[11], 20)
    assert read(b"") == ({}, []) and read(b"not an archive")[1][0][2] == 14


def test_licence_lines(spark):
    gpl = license.NOTICES["GPL-3.0"][0]
    rows = [(1, f"some text here\n{gpl.upper()}"), (2, "Released under the MIT License."), (3, "Released today under MIT"), (4, None), (5, ""), (6, "word"), (2, "Released under the MIT License."), (7, license.NOTICES["MIT"][2].replace(", ", ",\n"))]
    docs = spark.createDataFrame([(*r, "z") for r in rows], "doc_id long, text string, licence string")
    got = sorted(tuple(r) for r in license.op3_license_scan(docs).collect())
    assert got == [(1, -1, "GPL-3.0", 0.88), (1, 0, "GPL-3.0", 0.88), (1, 2, "GPL-3.0", 1.0), (2, 0, "MIT", 1.0), (2, 1, "MIT", 1.0), (7, -1, "MIT", 1.0), (7, 0, "MIT", 1.0)]
    assert license.op3_license_scan(docs.limit(0)).count() == 0


def test_wrapped_licences_in_longer_texts(spark):
    import textwrap

    whole = license.NOTICES["MIT"][-1]
    cut = whole.index("The above copyright")
    wrapped = "\n\n".join(textwrap.fill(x, 78) for x in ("Copyright 2020 The Someone", whole[:cut], whole[cut:]))
    prose = "\n".join(" ".join(f"w{i * 12 + j}" for j in range(12)) for i in range(60))
    apache = textwrap.indent(textwrap.fill(license.NOTICES["Apache-2.0"][1], 70), "# ")
    rows = [(1, f"{prose}\n\n{wrapped}\n\n{prose}"), (2, f"{prose}\n\n{apache}\n\n{prose}"), (3, prose), (4, "\n" * 50_000 + "x y\n" * 50_000)]
    got = {(r.doc_id, r.licence): r.dice for r in license.licence_matches(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r.unit < 0}
    assert got.keys() == {(1, "MIT"), (2, "Apache-2.0")} and min(got.values()) > 0.95


@pytest.mark.parametrize("threshold", [0.3, 0.8, 0.95])
def test_each_match_of_a_licence_has_a_key_word(threshold):
    """The fewest bigrams that a match can share with a template are more than those without a key word."""
    rows = license.templates()
    words = set(license.key_words(rows, threshold))
    bare, sizes = {}, {}
    for lic, form, size, bigram, n in rows:
        sizes[lic, form] = size
        bare[lic, form] = bare.get((lic, form), 0) + n * (not words & set(bigram.split()))
    for at, b in sizes.items():
        shared = [s for s in range(1, b + 1) if round(2 * s / (s + b), 6) >= threshold]
        assert bare[at] < min(shared), at


def test_damaged_licences_agree_with_sql(spark):
    import duckdb

    rng = random.Random(8)
    rows = [(None, "Released under the MIT License."), (0, None), (1, "licensed"), (2, "a unlicensed b licensedx c"), (3, "\u212aicensed under CC BY 4.0"), (4, "\U0001f600Licensed\x00under-the/MIT\u00a0LICENSE"), (5, "\n \n software \n\n \n")]
    for _ in range(8):
        for notice in [x for forms in license.NOTICES.values() for x in forms]:
            kept = [w for w in notice.split() if rng.random() > rng.choice([0, 0.05, 0.15])]
            kept = [rng.choice([w, w.upper(), w, f"{w}\u00e9", f"({w}"]) for w in kept]
            text = "".join(w + rng.choice([" ", " ", " ", " ", "\n", " \n\t", "\r\n", "--"] + ["\n\n"] * (rng.random() < 0.1)) for w in kept)
            rows.append((len(rows), rng.choice(["", "some prose\n", "more\n\n"]) + text + rng.choice(["", "\nsome more", " x"])))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    con = duckdb.connect()
    documents = docs.toArrow()
    con.register("documents", documents)
    want = con.execute(license.OP3_SQL).fetchall()
    order = lambda rows: sorted(map(tuple, rows), key=repr)
    assert len(want) > 200 and order(license.op3_license_scan(docs).collect()) == order(want)
    table = license.key_words(license.templates())
    plain = [any(w in table for w in "".join(c if c.isascii() and c.isalnum() else " " for c in t or "").lower().split()) for _, t in rows]
    found = [r.has for r in docs.select(license.has_word(F.coalesce("text", F.lit("")), table).alias("has")).collect()]
    assert all(f or not p for f, p in zip(found, plain)) and found[1:4] == [False, True, False]


def test_boilerplate_lines_go_and_copies_stay(spark):
    rows = [(i, f"own {i} words of this page here\nSITE NAV\n\nmore {i} of it", f"s{i % 7}") for i in range(14)]
    rows += [(100 + i, "a copied page\nof two lines", f"s{i % 9}") for i in range(9)] + [(200, None, "s1"), (201, "", None), (202, "SITE NAV", None)]
    rows += [(300 + i, "often but\nSITE NAV\non few sites and long enough", f"s{i % 2}") for i in range(9)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, source string, pos int")
    out = linedup.drop_boilerplate_lines(docs)
    assert out.columns == docs.columns
    got = {r.doc_id: r.text for r in out.collect()}
    for i, t, _ in rows:
        want = t.replace("SITE NAV\n", "") if i < 100 or i >= 300 else t
        assert got[i] == want, i
    assert linedup.op5_line_dedup(docs.limit(0)).count() == 0


def test_pages_mostly_of_boilerplate_lose_it(spark):
    nav = "home news shop about contact help\nall rights reserved by the site"
    rows = [(i, f"{nav}\nown {i}", f"s{i}") for i in range(6)] + [(10, f"{nav}\nsame page", "s1"), (11, f"{nav}\nsame page", "s2"), (12, f"{nav}\n", "s3"), (13, f"{nav}\ntwice told", "s4"), (13, f"{nav}\ntwice told", "s4")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r.text for r in linedup.drop_boilerplate_lines(docs).collect()}
    # Exact copies and pages of nothing else stay; rows that repeat a document are no copies.
    assert got == {i: t if i in (10, 11, 12) else t.removeprefix(f"{nav}\n") for i, t, _ in rows}


def test_mix_reaches_targets(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(["w"] * rng.randint(0, 40)), rng.choice(["a"] * 20 + ["b"] * 5 + ["c", None])) for i in range(3000)] + [(None, None, "d"), (None, "", "d")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, source string, size int").repartition(3)
    got = mixing.op6_mixing(docs).collect()
    assert len(got) == len(rows)
    sizes, total = {}, 0
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weights, total = {s: i % 3 + 1 for i, s in enumerate(order)}, sum(sizes.values())
    target, free = {}, set(order)
    while True:  # as told: share, stop at the cap, share the excess again
        rest = total - sum(target.values())
        share = {s: rest * weights[s] / sum(weights[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 3 * sizes[s]}
        target |= {s: 3.0 * sizes[s] for s in over}
        free -= over
        if not over:
            target |= {s: share[s] for s in free}
            break
    by_id = {i: s for i, _, s in rows}
    taken = dict.fromkeys(order, 0)
    for r in got:
        s = by_id[r.doc_id] if r.doc_id is not None else "d"
        assert r.target == pytest.approx(target[s]) and r.taken <= 3 * r.size and r.source_size == sizes[s]
        taken[s] += r.taken
    for s in order:
        assert taken[s] == pytest.approx(target[s], rel=0.12, abs=60)
    again = mixing.op6_mixing(docs.repartition(5)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    mixed = mixing.mix_sources(docs)
    assert mixed.columns == docs.columns
    assert sum(len((r.text or "").split()) for r in mixed.collect()) == sum(taken.values())
    assert mixing.op6_mixing(docs.limit(0)).count() == 0


def test_contained_items_match_brute_force(spark):
    rng = random.Random(12)
    word = lambda: f"w{rng.randrange(3000)}"
    items = [(i, " ".join(word() for _ in range(rng.choice([3, 5, 15, 30, 59])))) for i in range(30)] + [(30, None)]
    rows = []
    for k in range(150):
        body = [word() for _ in range(rng.choice([0, 4, 50, 500, 5000]))]
        for _ in range(rng.choice([0, 1, 2])):
            part = (items[rng.randrange(30)][1]).split()
            if rng.random() < 0.3:
                part[rng.randrange(len(part))] = "changed"
            at = rng.randint(0, len(body))
            body[at:at] = part
        rows.append((k, " ".join(body)))
    items += [(40, "short one"), (41, "a b c d"), (42, "Solo"), (43, "five words make one shingle")]
    rows += [(500, f"x y Short\nOne z {items[7][1]}"), (501, "a b c e d"), (502, "it is a b c d"), (503, "solo"), (504, "five words make one shingle")]
    rows += [(3, rows[3][1]), (3, rows[5][1]), (None, rows[7][1]), (900, None)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, item_id int")

    def shingles(t, k=5):
        w = (t or "").lower().split()
        return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}

    of = [(i, k, shingles(t, k)) for i, t in items if (k := min(5, len((t or "").split())))]
    hits = [(n, d, i) for n, (d, t) in enumerate(rows) for i, k, x in of if len(x & shingles(t, k)) >= 0.8 * len(x)]
    want = {(d, i) for _, d, i in hits}
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontam.op10_decontamination(docs, bench).collect()}
    assert got == want and len(want) > 40
    left = decontam.drop_contaminated(docs, bench)
    assert left.columns == docs.columns
    assert sorted(map(str, (r.doc_id for r in left.collect()))) == sorted(str(d) for n, (d, _) in enumerate(rows) if n not in {x for x, _, _ in hits})
    assert decontam.op10_decontamination(docs, bench.limit(0)).count() == 0


def test_preferences_share_the_prompt_once(spark):
    chosen = [(1, 0, "user", "q"), (1, 1, "assistant", "good"), (2, 0, "user", "x"), (2, 1, "assistant", "y"), (3, 0, "user", None), (3, 0, "user", None), (None, 0, "user", "z"), (4, 0, "a", "only")]
    rejected = [(1, 0, "user", "q"), (1, 1, "assistant", "bad"), (1, 2, "user", "?"), (2, 0, "user", "x"), (3, 0, "user", "")]
    kind = "conv_id long, turn long, role string, text string"
    got = {r.pair: r for r in chat.format_preferences(spark.createDataFrame(chosen, kind), spark.createDataFrame(rejected, kind)).collect()}
    t = lambda role, text: f"<|{role}|>\n{text}<|end|>\n"
    assert tuple(got[1])[1:4] == (t("user", "q"), t("assistant", "good"), t("assistant", "bad") + t("user", "?"))
    assert tuple(got[2])[1:4] == (t("user", "x"), t("assistant", "y"), "")
    assert tuple(got[3])[1:4] == (t("user", ""), "", "")
    assert tuple(got[4])[1:4] == ("", t("a", "only"), "")
    assert chat.op7_preferences(spark.createDataFrame(chosen, kind).limit(0)).count() == 0


def test_files_are_where_the_manifest_says(spark):
    path = new_path(spark, "warc")
    pages = spark.createDataFrame([(i, "u", f"page {i} " * 30) for i in range(20)], "page_id long, url string, html string").repartition(3)
    files = warc.write_archives(warc.plan_records(pages), path).collect()
    fs, root = pafs.FileSystem.from_uri(path)
    assert sum(f.records for f in files) == 20
    assert all(fs.get_file_info(f"{root}/{f.file}").size == f.bytes for f in files)
