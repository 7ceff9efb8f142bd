"""Record statistics for a ranker, and reports on how much of the truth a candidate list holds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkweave.functions.similarity import tokens
from linkweave.operators.features import name_frequencies

PASSES = ("f_exact", "rare_n", "addr_n", "f_concat")
CUTS = (10, 20, 30, 40, 50, 60)


def record_stats(s: DataFrame, t: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(s1, s_*) and (t, t_*): token and number counts, blank addresses, how common a name is, flags of targets."""

    def sizes(side):
        counts = {"n_ctok": "core", "n_atok": "addr_toks", "n_nums": "addr_nums"}
        return [F.size(tokens(c)).alias(f"{side}_{name}") for name, c in counts.items()] + [F.col("addr_blank").cast("int").alias(f"{side}_blank")]

    named = name_frequencies(s.withColumn("s_core_key", F.col("core_key")), s, t)
    mine = named.select(F.col("id").alias("s1"), *sizes("s"), F.log1p("name_rep").alias("s_name_rep"), F.log1p("name_tdf").alias("s_name_tdf"))
    flags = {"t_domain": F.col("is_domain"), "t_indic": F.col("script").isin("indic", "mixed"), "t_src3": F.col("src") == 3, "t_acro": F.col("acro_self") != ""}
    return mine, t.select(F.col("id").alias("t"), *sizes("t"), *[c.cast("int").alias(name) for name, c in flags.items()])


def _found(entities: DataFrame, candidates: DataFrame, truth: DataFrame, targets: DataFrame) -> DataFrame:
    """The true pairs with both records' strata, hit, and what each pass says (0 where the pair was not found)."""
    met = candidates.select("s1", "t", F.lit(1).alias("hit"), *PASSES)
    return truth.select("s1", "t").join(met, ["s1", "t"], "left").na.fill(0).join(targets, "t").join(entities.select("s1", "country"), "s1")


def candidate_report(entities: DataFrame, candidates: DataFrame, truth: DataFrame, targets: DataFrame, strata: tuple[str, ...] = ("src", "script", "addr_blank")) -> DataFrame:
    """(dimension, country, value, recall, n): recall of true pairs by each stratum of the target.

    All dimensions come from one pass over the true pairs; ``targets`` has t and ``strata``.
    """
    rows = _found(entities, candidates, truth, targets.select("t", *strata))
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("dimension"), F.col(c).cast("string").alias("value")) for c in strata])).alias("of")
    return rows.select("country", "hit", each).groupBy("of.dimension", "country", "of.value").agg(F.avg("hit").alias("recall"), F.count("*").alias("n"))


def pass_shares(entities: DataFrame, candidates: DataFrame, truth: DataFrame, targets: DataFrame) -> DataFrame:
    """One row: the share of true pairs that each pass finds."""
    return _found(entities, candidates, truth, targets.select("t")).agg(*[F.avg((F.col(c) > 0).cast("int")).alias(c) for c in PASSES])


def ranked_report(entities: DataFrame, ranked: DataFrame, truth: DataFrame, targets: DataFrame, cuts: tuple[int, ...] = CUTS) -> DataFrame:
    """(country, k, ...) for lists cut at each of ``cuts``; country '' is all of them.

    Recall, recall of targets in Indic scripts, entities covered in full, the macro F0.5 of
    an oracle that picks the true ones of each list, and the mean length. ``ranked`` has s1, t
    and rrank (from 1). All cuts share one aggregation by entity and one by country.
    """
    indic = targets.select("t", F.col("script").isin("indic", "mixed").alias("indic"))
    true = truth.select("s1", "t").join(indic, "t", "left").withColumn("true", F.lit(1))
    pairs = ranked.select("s1", "t", "rrank").join(true, ["s1", "t"], "full")
    at = lambda k: F.col("rrank") <= k
    is_true, is_indic = F.col("true") == 1, F.coalesce("indic", F.lit(False))
    counts = [F.count_if(is_true).alias("n_true"), F.count_if(is_indic).alias("n_indic")]
    for k in cuts:
        counts += [F.count_if(at(k)).alias(f"c{k}"), F.count_if(at(k) & is_true).alias(f"h{k}"), F.count_if(at(k) & is_indic).alias(f"i{k}")]
    lists = entities.select("s1", "country").join(pairs.groupBy("s1").agg(*counts), "s1", "left").na.fill(0)
    cut = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"c{k}").alias("c"), F.col(f"h{k}").alias("h"), F.col(f"i{k}").alias("i")) for k in cuts])).alias("at")
    long = lists.select(F.explode(F.array(F.lit(""), "country")).alias("country"), "n_true", "n_indic", cut).select("country", "n_true", "n_indic", "at.*")
    share = F.try_divide("h", "n_true")
    oracle = F.when(F.col("n_true") == 0, 1.0).otherwise(1.25 * share / (0.25 + share))
    part = lambda a, b: F.sum(a) / F.greatest(F.sum(b), F.lit(1))
    return long.groupBy("country", "k").agg(
        part("h", "n_true").alias("recall"), part("i", "n_indic").alias("indic_recall"), F.avg(F.when(F.col("n_true") > 0, (F.col("h") == F.col("n_true")).cast("int"))).alias("full_cover"),
        F.avg(oracle).alias("oracle_macro_f05"), F.avg("c").alias("mean_len"),
    )
