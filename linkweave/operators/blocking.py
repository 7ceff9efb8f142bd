"""Candidate generation: all passes as one tagged key table, capped by target block size, joined once."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkweave.functions.normalize import STRUCTURAL
from linkweave.functions.similarity import tokens

EXACT, RARE, ADDRESS, CONCAT, WORD, SKELETON = "exact", "rare", "addr", "concat", "a2", "sk"


@dataclass(frozen=True)
class Caps:
    """Largest target block of each pass, and how many pairs an entity keeps."""

    exact: int = 300
    rare: int = 500
    addr: int = 300
    concat: int = 300
    a2: int = 300
    sk_full: int = 1000
    sk_pair: int = 500
    numbers: int = 2
    words: int = 6
    concat_len: int = 6
    top_pass: int = 25
    top: int = 50


#: Caps of the wider union that a learned ranker cuts down.
RANKER = Caps(exact=1000, rare=1000, numbers=3, words=10)


def address_words(toks: str | Column) -> Column:
    return F.filter(tokens(toks), lambda x: (F.char_length(x) >= 3) & ~x.isin(*sorted(STRUCTURAL)))


def exact_keys(df: DataFrame) -> DataFrame:
    return df.where("core_key <> ''").select("id", F.lit(EXACT).alias("pass"), "country", F.col("core_key").alias("key"))


def name_tokens(df: DataFrame) -> DataFrame:
    return df.select("id", F.lit(RARE).alias("pass"), "country", F.explode(F.array_distinct(tokens("core"))).alias("key"))


def address_keys(df: DataFrame, caps: Caps = Caps()) -> DataFrame:
    """House number with the first five letters of a street word."""
    pairs = df.select("id", "country", F.explode(F.slice(tokens("addr_nums"), 1, caps.numbers)).alias("num"), "addr_toks")
    pairs = pairs.select("id", "country", "num", F.explode(F.slice(address_words("addr_toks"), 1, caps.words)).alias("tok"))
    return pairs.select("id", F.lit(ADDRESS).alias("pass"), "country", F.concat_ws("\x1f", "num", F.substring("tok", 1, 5)).alias("key")).distinct()


def address_word_keys(df: DataFrame) -> DataFrame:
    return df.select("id", F.lit(WORD).alias("pass"), "country", F.explode(F.array_distinct(address_words("addr_toks"))).alias("key"))


def concat_keys(df: DataFrame, columns: list[str], length: int = 6) -> DataFrame:
    """The first letters of joined names of five letters or more."""
    values = F.explode(F.array_distinct(F.transform(F.filter(F.array(*columns), lambda x: F.char_length(x) >= 5), lambda x: F.substring(x, 1, length))))
    return df.select("id", F.lit(CONCAT).alias("pass"), "country", values.alias("key"))


def skeleton_keys(df: DataFrame) -> DataFrame:
    """All skeleton words together, and each pair of the first six in order."""
    words = F.array_sort(F.array_distinct(F.filter(tokens("name_sk"), lambda x: F.char_length(x) >= 2)))
    few = F.slice(words, 1, 6)
    pairs = F.flatten(F.transform(few, lambda a: F.transform(F.filter(few, lambda b: b > a), lambda b: F.concat(F.lit("P:"), a, F.lit("|"), b))))
    whole = F.when(F.size(words) > 0, F.array(F.concat(F.lit("F:"), F.array_join(words, " ")))).otherwise(F.array().cast("array<string>"))
    return df.select("id", F.lit(SKELETON).alias("pass"), "country", F.explode(F.concat(whole, pairs)).alias("key"))


def cap_of(caps: Caps) -> Column:
    limits = {EXACT: caps.exact, RARE: caps.rare, ADDRESS: caps.addr, CONCAT: caps.concat, WORD: caps.a2}
    full = F.when(F.col("key").startswith("F:"), caps.sk_full).otherwise(caps.sk_pair)
    for name, n in limits.items():
        full = F.when(F.col("pass") == name, n).otherwise(full)
    return full


def with_block_size(keys: DataFrame, caps: Caps) -> DataFrame:
    """Target keys of blocks within the cap, with their block size bs.

    Block sizes are summed before they move; the keys then meet them by a join, which can
    split a large block, and blocks beyond the cap end there.
    """
    sizes = keys.groupBy("pass", "country", "key").agg(F.count("*").alias("bs")).where(F.col("bs") <= cap_of(caps))
    return keys.join(sizes, ["pass", "country", "key"])


def token_idf(targets: DataFrame, caps: Caps = Caps(), keys: DataFrame | None = None) -> DataFrame:
    """(country, key, df, idf): ln(N / df) of the tokens that at most ``caps.rare`` targets of a country have."""
    pool = targets.groupBy("country").agg(F.count("*").alias("n"))
    counts = (name_tokens(targets) if keys is None else keys).groupBy("country", "key").agg(F.count("*").alias("df"))
    return counts.where(F.col("df") <= caps.rare).join(pool, "country").select("country", "key", "df", F.ln(F.col("n") / F.col("df")).alias("idf"))


def _passes(df: DataFrame, caps: Caps, target: bool, wide: bool) -> DataFrame:
    parts = [exact_keys(df), name_tokens(df), address_keys(df, caps), concat_keys(df, ["concat", "domain"] if target else ["concat"], caps.concat_len)]
    if wide:
        parts += [address_word_keys(df), skeleton_keys(df.where("script in ('indic', 'mixed')") if target else df)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def pass_pairs(s: DataFrame, t: DataFrame, caps: Caps = Caps(), wide: bool = False) -> DataFrame:
    """One row for each pair that shares a key of a capped block, with what each pass says of it.

    All passes go through one join on (pass, country, key) and one aggregation by pair. Targets first
    lose the keys that no entity has. Countries never mix.
    """
    mine = _passes(s, caps, False, wide)
    theirs = with_block_size(_passes(t, caps, True, wide), caps)
    theirs = theirs.join(mine.select("pass", "country", "key").distinct(), ["pass", "country", "key"], "left_semi")
    pool = t.groupBy("country").agg(F.count("*").alias("n"))
    met = mine.withColumnRenamed("id", "s1").join(theirs.withColumnRenamed("id", "t"), ["pass", "country", "key"]).join(pool, "country")
    idf = F.ln(F.col("n") / F.col("bs"))
    of = lambda name, value: F.when(F.col("pass") == name, value)
    aggs = [
        F.max(of(EXACT, 1)).alias("f_exact"), F.sum(of(RARE, idf)).alias("rare_idf"), F.count(of(RARE, 1)).alias("rare_n"),
        F.count(of(ADDRESS, 1)).alias("addr_n"), F.max(of(CONCAT, 1)).alias("f_concat"),
    ]
    if wide:
        aggs += [F.max(of(RARE, idf)).alias("rare_max"), F.count(of(WORD, 1)).alias("a2_n"), F.sum(of(WORD, idf)).alias("a2_idf"), F.count(of(SKELETON, 1)).alias("sk_n"), F.sum(of(SKELETON, idf)).alias("sk_idf")]
        aggs += [F.min(of(p, F.col("bs"))).alias(f"{p}_bs") for p in (EXACT, ADDRESS, CONCAT)]
    return met.groupBy("s1", "t").agg(*aggs).na.fill(0)


def top_per_entity(df: DataFrame, score: Column, k: int) -> DataFrame:
    """The ``k`` best rows of each s1; of equals the smaller t."""
    w = Window.partitionBy("s1").orderBy(score.desc(), "t")
    return df.withColumn("__rank", F.row_number().over(w)).where(F.col("__rank") <= k).drop("__rank")


def cheap_score() -> Column:
    return 2.0 * F.col("f_exact") + F.col("rare_idf") / 10 + 0.8 * F.least("addr_n", F.lit(3)) + 1.5 * F.col("f_concat")


def build_candidates(s: DataFrame, t: DataFrame, caps: Caps = Caps()) -> DataFrame:
    """Pairs of the four lexical passes, the best ``caps.top`` of each entity by cheap score.

    The rare-token and address passes count only for an entity's best ``caps.top_pass``
    pairs of that pass. All windows share one partitioning by s1.
    """
    pairs = pass_pairs(s, t, caps)
    rank = lambda c: F.row_number().over(Window.partitionBy("s1").orderBy(F.col(c).desc(), "t"))
    ranked = pairs.withColumn("r", rank("rare_idf")).withColumn("a", rank("addr_n"))
    # Ranks above the limit with a count of zero don't matter: they have nothing to lose.
    cut = ranked.withColumns({
        "rare_idf": F.when(F.col("r") <= caps.top_pass, F.col("rare_idf")).otherwise(0.0),
        "rare_n": F.when(F.col("r") <= caps.top_pass, F.col("rare_n")).otherwise(0),
        "addr_n": F.when(F.col("a") <= caps.top_pass, F.col("addr_n")).otherwise(0),
    })
    some = cut.where("f_exact + rare_n + addr_n + f_concat > 0").drop("r", "a").withColumn("cheap", cheap_score())
    return top_per_entity(some, F.col("cheap"), caps.top)


def ranker_union(s: DataFrame, t: DataFrame, caps: Caps = RANKER) -> DataFrame:
    """The wide union with its list context: n_pass, n_union, dense ranks and shares of the list's maxima."""
    pairs = pass_pairs(s, t, caps, wide=True)
    w = Window.partitionBy("s1")
    passes = sum((F.col(c) > 0).cast("int") for c in ("f_exact", "rare_n", "addr_n", "f_concat", "a2_n", "sk_n"))
    ranks = {f"rk_{c}": F.dense_rank().over(w.orderBy(F.col(c).desc())) for c in ("rare_idf", "addr_n", "a2_idf", "sk_idf")}
    shares = {f"rel_{c}": F.coalesce(F.try_divide(F.col(c), F.max(c).over(w)), F.lit(0.0)) for c in ("rare_idf", "a2_idf", "sk_idf")}
    return pairs.withColumns({"n_pass": passes, "n_union": F.count("*").over(w)} | ranks | shares | {f"log_{p}_bs": F.log1p(F.col(f"{p}_bs")) for p in (EXACT, ADDRESS, CONCAT)})
