"""Second-level features: each pair's score beside its list, its target's other claims and its sibling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkweave.functions.similarity import token_set_udf
from linkweave.operators.features import decoy_features, list_scores, source_features, token_df, vocab_features

CONTEXT = ["p1", "p1_logit", "c_other_max", "c_gap", "c_sum_others", "c_n_conf_others", "s_best_other", "s_p_sum", "s_n_conf", "s_rank", "p1_rel", "sib_p", "sib_name", "sib_addr", "sib_dup"]
DECOY = ["leg_swap", "leg_added", "leg_extra", "leg_lost", "leg_drop", "num_s_only", "num_t_only", "num_off", "sup_num_p", "sup_core_p", "sup_leg_p", "sup_num_share", "t_num_mode", "s_num_share"]
VOCAB = ["nw_n_new", "nw_n_gone", "nw_new_df_min", "nw_new_df_max", "nw_gone_df_min"]
SOURCE = ["src_mass_same", "src_mass_other", "src_n_conf_same", "src_n_conf_other", "src_rank", "src_gap"]


def claim_context(scores: DataFrame) -> DataFrame:
    """(s1, t, p) with what the other claims on t say, from sums and the two best claims of each target.

    Claims are reduced by target before they move, and pairs meet the result by a join, so that a
    target that very many entities claim is never gathered or sorted in one task.
    """
    own = scores.groupBy("t").agg(F.max(F.struct("p", (-F.col("s1")).alias("s"))).alias("best"), F.sum("p").alias("total"), F.count_if(F.col("p") > 0.5).alias("sure"))
    met = scores.join(own, "t")
    second = met.where(F.col("s1") != -F.col("best.s")).groupBy("t").agg(F.max("p").alias("second"))
    met = met.join(second, "t", "left")
    other = F.when(F.col("p") >= F.col("best.p"), F.coalesce("second", F.lit(0.0))).otherwise(F.col("best.p"))
    return met.select(*scores.columns, other.alias("c_other_max"), (F.col("p") - other).alias("c_gap"), (F.col("total") - F.col("p")).alias("c_sum_others"), (F.col("sure") - (F.col("p") > 0.5).cast("int")).alias("c_n_conf_others"))


def logit(p: str) -> Column:
    bounded = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), F.col(p)))
    return F.ln(bounded / (1 - bounded))


def siblings(x: DataFrame) -> DataFrame:
    """``x`` (s1, t, p, s_rank, t_core, t_core_key, t_addr_toks) with its sibling: the list's first pair, or the second for the first itself.

    sib_p, similarity of the names and addresses of both targets, and whether they agree in
    all words; zeros without a sibling. The two first pairs of a list are one row for each entity.
    """
    w = Window.partitionBy("s1")
    pair = F.struct("p", F.col("t_core").alias("core"), F.col("t_core_key").alias("key"), F.col("t_addr_toks").alias("addr"))
    at = lambda n: F.max(F.when(F.col("s_rank") == n, pair)).over(w)
    out = x.withColumn("sib", F.when(F.col("s_rank") == 0, at(1)).otherwise(at(0)))
    like = lambda a, b: F.when((a != "") & (b != ""), token_set_udf(F.coalesce(a, F.lit("")), F.coalesce(b, F.lit(""))) / 100).otherwise(0.0)
    return out.withColumns({
        "sib_p": F.coalesce("sib.p", F.lit(0.0)), "sib_name": like(F.col("t_core"), F.col("sib.core")), "sib_addr": like(F.col("t_addr_toks"), F.col("sib.addr")),
        "sib_dup": F.coalesce((F.col("t_core_key") == F.col("sib.key")) & (F.col("t_addr_toks") == F.col("sib.addr")), F.lit(False)).cast("int"),
    }).drop("sib")


def build_stack_features(scores: DataFrame, pairs: DataFrame, targets: DataFrame) -> DataFrame:
    """(s1, t, context, decoy, vocabulary and source features): the second-level columns of every scored pair.

    ``scores`` is (s1, t, p) of the level below, ``pairs`` the same pairs with both sides' columns (s_*, t_*,
    country) as :func:`attach_sides` gives them. A pair without a score raises.
    """
    rows = claim_context(scores).join(pairs, ["s1", "t"], "right")
    rows = rows.withColumn("p", F.coalesce("p", F.raise_error("a pair has no score").cast("double")))
    rows = siblings(list_scores(rows)).withColumns({"p1": F.col("p"), "p1_logit": logit("p"), "s_leg": F.col("s_legal"), "t_leg": F.col("t_legal"), "s_nums": F.col("s_addr_nums"), "t_nums": F.col("t_addr_nums")})
    rows = vocab_features(source_features(decoy_features(rows)), token_df(targets))
    return rows.select("s1", "t", *CONTEXT, *DECOY, *VOCAB, *SOURCE)
