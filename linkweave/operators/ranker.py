"""Ranking the wide candidate union: record statistics and similarities, a learned score, a cut per entity."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkweave.functions.similarity import containment, first_number, jaccard, tokens
from linkweave.operators.blocking import RANKER, Caps, ranker_union
from linkweave.operators.features import attach_sides, name_frequencies


def record_columns(side: str) -> dict[str, Column]:
    """What one record says of itself, from its ``side`` (s or t) of a pair."""
    c = lambda name: F.col(f"{side}_{name}")
    return {
        f"{side}_n_tok": F.size(tokens(c("core"))), f"{side}_n_addr": F.size(tokens(c("addr_toks"))), f"{side}_n_num": F.size(tokens(c("addr_nums"))),
        f"{side}_blank": ((c("addr_toks") == "") & (c("addr_nums") == "")).cast("int"), f"{side}_indic": c("script").isin("indic", "mixed").cast("int"),
    }


def similarity_columns() -> dict[str, Column]:
    """Name Jaccard, address Jaccard and containment, and whether the first house numbers are equal."""
    s, t = (lambda c: tokens(f"s_{c}")), (lambda c: tokens(f"t_{c}"))
    same = F.coalesce(first_number(F.col("s_addr_nums")) == first_number(F.col("t_addr_nums")), F.lit(False))
    return {"sim_name": jaccard(s("core"), t("core")), "sim_addr": jaccard(s("addr_toks"), t("addr_toks")), "sim_cont": containment(s("addr_toks"), t("addr_toks")), "sim_num": same.cast("int")}


def ranker_features(s: DataFrame, t: DataFrame, caps: Caps = RANKER) -> DataFrame:
    """The wide union with list context, record statistics of both sides, name frequencies and similarities."""
    rows = name_frequencies(attach_sides(ranker_union(s, t, caps), s, t), s, t)
    return rows.withColumns(record_columns("s") | record_columns("t") | similarity_columns() | {"t_src3": (F.col("t_src") == 3).cast("int")})


def rank_split(rows: DataFrame, score: Callable[[DataFrame], DataFrame], keep: int = 60) -> DataFrame:
    """``rows`` with rk_p, the score that ``score`` adds as p, and rrank from 0, cut to each entity's ``keep`` best.

    Of equal scores the smaller t comes first. ``score`` is such as :func:`linkweave.plans.models.cross_scores`
    with its models, by which no row is scored by a model that has seen its fold.
    """
    best = Window.partitionBy("s1").orderBy(F.col("rk_p").desc(), "t")
    return score(rows).withColumnRenamed("p", "rk_p").withColumn("rrank", F.row_number().over(best) - 1).where(F.col("rrank") < keep)
