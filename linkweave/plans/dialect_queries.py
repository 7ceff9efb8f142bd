"""Queries of the second dialect of normal forms. The forms of fixed strings are held against values worked out by hand."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkweave.functions import dialect

#: raw: core, full, legal, flags, domain, n_ind, n_fb
NAMES = {
    "Shri Lotus Mills Pvt. Ltd.": ("lotus mills", "lotus mills ltd pvt", 33280, 0, "", 0, 0),
    "L.L.P. Harbour Co Foods": ("harbour co foods", "harbour co foods llp", 128, 0, "", 0, 0),
    "Harbour Foods SAS & Co": ("harbour foods", "harbour foods co sas", 262145, 0, "", 0, 0),
    "Tide Care | www.tide-care.com": ("tide care", "tide care", 0, 0, "tidecare", 0, 0),
    "tide-care.com": ("tidecare", "tidecare", 0, 1, "tidecare", 0, 0),
    "Tide Care - 9876543210 (ID: 77)": ("tide care", "tide care", 0, 6, "", 0, 0),
    "Tide Labs formerly known as Reef Reef": ("tide labs reef", "tide labs reef", 0, 8, "", 0, 0),
    "The Company Ltd": ("the", "the co ltd", 513, 0, "", 0, 0),
    "Private Limited": ("private limited", "private limited ltd pvt", 33280, 0, "", 0, 0),
    "सूर्य Mills": ("soory mills", "soory mills", 0, 0, "", 1, 1),
    "": ("", "", 0, 0, "", 0, 0),
}
#: raw: addr, alpha, nums, n_ind
ADDRESSES = {
    "12 Elm Road, null, Po Box 55, Mount Hill": ("12 elm rd po box mt hill", "elm rd mt hill", "12", 0),
    "No. 007/41st Cross, n/a": ("no 7 41st cross", "cross", "7 41", 0),
    "N°8 R. Élan": ("8 rue elan", "rue elan", "8", 0),
    "४ राम Nagar": ("4 raam ngr", "raam ngr", "4", 2),
    "Flat 1 2 3 4 5 6 7 8 9": ("flat 1 2 3 4 5 6 7 8 9", "", "1 2 3 4 5 6 7 8", 0),
    "": ("", "", "", 0),
}
#: word: Latin letters
WORDS = {"राम": "raam", "कमल": "kamal", "सूर्य": "soory", "இந்தியா": "intiyaa", "९क": "9k", "कa": "kaa", "अंश": "ansh", "abc": "abc"}


def _strings(spark: SparkSession, raw) -> DataFrame:
    return spark.createDataFrame([(x,) for x in raw], "raw string")


def q_dialect_names(spark, sf):
    return dialect.dialect_names(_strings(spark, NAMES), "raw").select("raw", "core", "full", "legal", "flags", "domain", "n_ind", "n_fb")


def q_dialect_addresses(spark, sf):
    return dialect.dialect_addresses(_strings(spark, ADDRESSES), "raw").select("raw", "addr", "alpha", F.array_join("nums", " ").alias("nums"), "n_ind")


def q_romanize(spark, sf):
    return _strings(spark, WORDS).select("raw", F.pandas_udf(lambda s: s.map(dialect.romanize), "string")("raw").alias("latin"))


def q_dialect_skeletons(spark, sf):
    words = spark.read.parquet(f"{sf}/part.parquet").select(F.explode(F.split(F.concat_ws(" ", F.lower("p_name"), F.lower("p_type")), "[^a-z]+")).alias("word")).where("word <> ''").distinct()
    return words.select("word", dialect.skeleton(F.col("word")).alias("skeleton"))


def q_golden_folds(spark, sf):
    far = F.col("o_orderkey").cast("decimal(20,0)") * F.lit(1_000_003_000_007).cast("decimal(13,0)")  # beyond a long from the key 9,223,345 on
    return spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", dialect.fold_of(F.col("o_orderkey")).alias("fold"), dialect.fold_of(far).alias("far_fold"))


def _rows(columns: str, table: dict, casts: str) -> str:
    quote = lambda x: f"'{x}'" if isinstance(x, str) else str(x)
    rows = ", ".join(f"({', '.join(map(quote, (k, *(v if isinstance(v, tuple) else (v,)))))})" for k, v in table.items())
    return f"select {casts} from (values {rows}) as v({columns})"


def _replaced(column: str) -> str:
    for old, new in dialect.DIGRAPHS.items():
        column = f"replace({column}, '{old}', '{new}')"
    return column


_FOLD = "((({0})::hugeint * 11400714819323198485::hugeint % 18446744073709551616::hugeint) // 8589934592 % 5)::int"

SQL = {
    "dialect_names": _rows("raw, core, \"full\", legal, flags, domain, n_ind, n_fb", NAMES, 'raw, core, "full", legal::bigint as legal, flags::int as flags, domain, n_ind::int as n_ind, n_fb::int as n_fb'),
    "dialect_addresses": _rows("raw, addr, alpha, nums, n_ind", ADDRESSES, "raw, addr, alpha, nums, n_ind::int as n_ind"),
    "romanize": _rows("raw, latin", WORDS, "raw, latin"),
    "dialect_skeletons": f"""with w as (select distinct unnest(regexp_split_to_array(lower(p_name) || ' ' || lower(p_type), '[^a-z]+')) as word from part), x as (select word, {_replaced("word")} as short from w where word <> ''),
      y as (select word, string_split(substr(short, 1, 1) || translate(substr(short, 2), 'aeiouyh', ''), '') as c from x)
      select word, array_to_string([c[i] for i in range(1, len(c) + 1) if i = 1 or c[i] <> c[i - 1]], '') as skeleton from y""",
    "golden_folds": f"select o_orderkey, {_FOLD.format('o_orderkey')} as fold, {_FOLD.format('o_orderkey::hugeint * 1000003000007')} as far_fold from orders",
}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "dialect_names": q_dialect_names, "dialect_addresses": q_dialect_addresses, "romanize": q_romanize, "dialect_skeletons": q_dialect_skeletons, "golden_folds": q_golden_folds,
}
