"""Nulls, ties, repeated rows, clashing names and ids that are no numbers, against the queries' own SQL or plain Python."""

import math
import random

import duckdb
import pandas as pd
import pytest

from linkweave.llm import chat, decontam, linedup, mixing, quality, simhash, tokens, warc

CLASH = ["__id", "__doc", "__key", "__copies", "__source", "__tie", "__rank", "row", "id", "key", "rank", "hits", "size", "site", "node", "left", "lines", "n"]


def rows():
    rng = random.Random(3)
    word = lambda: f"w{rng.randrange(200)}"
    out = [(None, None, None), (None, "", "a"), (1, "x", "a"), (1, "x", "a"), (2, "nav bar\n\n\nnav bar", "b")]
    out += [(10 + i, "\n".join([" ".join(word() for _ in range(30)), "nav bar", "all rights reserved"]), "abcdefg"[i % 7]) for i in range(30)]
    out += [(50, "the same row of several words", "c")] * 200 + [(51 + i, out[6][1], "d") for i in range(4)]
    return out


def frame(spark, ids="long"):
    kind = f"doc_id {ids}, text string, source string, " + ", ".join(f"`{c}` string" for c in CLASH)
    return spark.createDataFrame([(d if d is None or ids == "long" else f"d{d:03}", t, s, *["z"] * len(CLASH)) for d, t, s in rows()], kind)


def against_sql(spark_rows, sql, **tables):
    con = duckdb.connect()
    for name, rows_ in tables.items():
        con.register(name, rows_)
    got = con.sql(sql)
    order = sorted(got.columns)
    plain = lambda v: None if v is None or v != v else round(v, 6) if isinstance(v, float) else v
    want = sorted((tuple(plain(x) for x in r) for r in got.project(", ".join(order)).fetchall()), key=str)
    assert sorted((tuple(plain(r[c]) for c in order) for r in spark_rows), key=str) == want


def documents():
    return pd.DataFrame(rows(), columns=["doc_id", "text", "source"]).astype({"doc_id": "Int64"})


def test_line_dedup_and_mixing_agree_with_their_sql(spark):
    docs = frame(spark)
    against_sql(linedup.op5_line_dedup(docs).collect(), linedup.OP5_SQL, documents=documents())
    mixed = mixing.op6_mixing(docs).collect()
    against_sql(mixed, mixing.OP6_SQL, documents=documents())
    # 200 equal rows draw each for itself.
    repeated = [r for r in mixed if r.doc_id == 50]
    assert len(repeated) == 200 and sum(r.taken for r in repeated) == pytest.approx(repeated[0].target, rel=0.25)


def test_repeated_pages_have_one_response(spark):
    big = "<p>page</p>" * 20
    pages = [(1, "u", big), (1, "u", big), (1, "b", big), (2, "u", big), (None, "u", big), (3, "u", "small"), (3, "u", "small"), (4, None, "y" * 200), (4, None, "y" * 200), (5, "u", None)]
    got = warc.op4_warc(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    against_sql(got, warc.OP4_SQL, pages=pd.DataFrame(pages, columns=["page_id", "url", "html"]).astype({"page_id": "Int64"}))
    assert sum(r.record_type == "response" for r in got if r.page_id in (1, 4)) == 2


def test_preferences_agree_with_their_sql(spark):
    rng = random.Random(5)
    turns = [(c, t, ["user", "assistant"][t % 2], rng.choice([None, "", "same", f"text {rng.randrange(9)}"])) for c in range(40) for t in range(rng.randint(1, 8))]
    turns += turns[:5] + [(None, 1, "user", "x"), (3, None, "user", "x"), (77, 4, "user", "alone")]
    kind = "conv_id long, turn long, role string, text string, pair string, body string"
    got = chat.op7_preferences(spark.createDataFrame([(*t, "z", "z") for t in turns], kind)).collect()
    against_sql(got, chat.OP7_SQL, conversations=pd.DataFrame(turns, columns=["conv_id", "turn", "role", "text"]).astype({"conv_id": "Int64", "turn": "Int64"}))
    assert len({r.prompt_turns for r in got}) > 3 and any(r.chosen and r.rejected for r in got)


def test_stages_pass_any_other_columns_through(spark):
    docs = frame(spark, "string").persist()
    labels = spark.createDataFrame([("d010", 1)], "doc_id string, quality int")
    items = spark.createDataFrame([("i1", "same row of several words", "z"), ("i2", None, "z")], "item_id string, text string, h string")
    n = docs.count()
    stages = {
        "quality": (quality.keep_good(docs, labels), 0, n),
        "lines": (linedup.drop_boilerplate_lines(docs), n, n),
        "near": (simhash.drop_near_duplicates(docs), 1, n - 199),
        "bench": (decontam.drop_contaminated(docs, items), n - 200, n - 200),
        "mix": (mixing.mix_sources(docs), 1, 3 * n),
    }
    for name, (out, least, most) in stages.items():
        assert out.columns == docs.columns, name
        found = out.collect()
        assert least <= len(found) <= most, name
        assert all(r[c] == "z" for r in found for c in CLASH), name
    assert tokens.token_counts(docs, ["x"]).count() == n
    docs.unpersist()


def test_stages_over_empty_tables(spark):
    docs = frame(spark).limit(0)
    labels, items = spark.createDataFrame([], "doc_id long, quality int"), spark.createDataFrame([], "item_id long, text string")
    for out in (quality.keep_good(docs, labels), linedup.drop_boilerplate_lines(docs), decontam.drop_contaminated(docs, items), mixing.mix_sources(docs)):
        assert out.columns == docs.columns and out.count() == 0


def test_long_texts_of_repeated_lines(spark):
    long = "nav bar\n" * 100_000 + "end"
    docs = spark.createDataFrame([(i, long if i == 0 else f"nav bar\nown {i}", f"s{i}") for i in range(8)], "doc_id long, text string, source string")
    got = {r.doc_id: r for r in linedup.op5_line_dedup(docs).collect()}
    assert got[0].n_removed == 100_000 and got[1].n_removed == 1
    assert math.isclose(sum(r.n_lines for r in got.values()), 100_001 + 14)
