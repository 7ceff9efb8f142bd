"""Choosing thresholds and policies by macro F0.5 on scores that are already there."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkweave.operators.decide import apply_policy
from linkweave.operators.evaluate import per_entity


def threshold_grid(scores: DataFrame, truth: DataFrame, entities: DataFrame, taus: list[float], rhos: list[float], exclusive: tuple[bool, ...] = (False, True), most: int = 11) -> DataFrame:
    """(exclusive, rho, tau, macro_f05) of every setting, in one pass over the pairs.

    A pair is unfolded into the settings that select it, with the same rules as
    threshold_select: p of tau or more, of rho times the entity's best or more, the target's best
    claim where exclusive, ``most`` for each entity. Entities without any selected pair come in through
    two sums over all entities instead of a row for each setting.
    """
    best_claim = scores.groupBy("t").agg(F.max("p").alias("top"))
    rows = scores.join(best_claim, "t").join(truth.select("s1", "t", F.lit(1).alias("hit")), ["s1", "t"], "left")
    grid = F.array(*[F.struct(F.lit(e).alias("exclusive"), F.lit(r).alias("rho"), F.lit(x).alias("tau")) for e in exclusive for r in rhos for x in taus])
    met = rows.select("s1", "t", "p", "top", F.coalesce("hit", F.lit(0)).alias("hit"), F.explode(grid).alias("g")).select("s1", "t", "p", "top", "hit", "g.*")
    met = met.where((F.col("p") >= F.col("tau")) & (~F.col("exclusive") | (F.col("p") == F.col("top"))))
    setting = ["exclusive", "rho", "tau"]
    own = Window.partitionBy("s1", *setting)
    met = met.withColumn("best", F.max("p").over(own)).where(F.col("p") >= F.col("rho") * F.col("best"))
    met = met.withColumn("place", F.row_number().over(own.orderBy(F.col("p").desc(), "t"))).where(F.col("place") <= most)
    found = met.groupBy("s1", *setting).agg(F.count("*").alias("n_pred"), F.sum("hit").alias("tp"))
    sizes = entities.select("s1").join(truth.groupBy("s1").agg(F.count("*").alias("n_true")), "s1", "left").na.fill(0)
    precision, recall = F.col("tp") / F.col("n_pred"), F.col("tp") / F.col("n_true")
    f = F.when((F.col("n_true") == 0) | (F.col("tp") == 0), 0.0).otherwise(1.25 * precision * recall / (0.25 * precision + recall))
    # Of the entities without matches, those with no selected pair score 1.
    scored = found.join(sizes, "s1").groupBy(*setting).agg(F.sum(f).alias("f"), F.count_if(F.col("n_true") == 0).alias("missed"))
    every = entities.sparkSession.range(1).select(F.explode(grid).alias("g")).select("g.*")
    totals = sizes.agg(F.count("*").alias("n"), F.count_if(F.col("n_true") == 0).alias("alone"))
    return every.join(scored, setting, "left").join(F.broadcast(totals), F.lit(True)).select(*setting, ((F.coalesce("f", F.lit(0.0)) + F.col("alone") - F.coalesce("missed", F.lit(0))) / F.col("n")).alias("macro_f05"))


def best_threshold(scores: DataFrame, truth: DataFrame, entities: DataFrame, taus: list[float], rhos: list[float], step: float = 0.02, reach: float = 0.08) -> dict:
    """The best setting of a coarse grid, then of a fine one around its tau; of equals the first."""
    pick = lambda df: df.orderBy(F.col("macro_f05").desc(), "exclusive", "rho", "tau").first().asDict()
    coarse = pick(threshold_grid(scores, truth, entities, taus, rhos))
    n = round(reach / step)
    near = [round(coarse["tau"] + i * step, 6) for i in range(-n, n + 1)]
    return pick(threshold_grid(scores, truth, entities, near, [coarse["rho"]], (coarse["exclusive"],)))


def policy_grid(scores: DataFrame, truth: DataFrame, entities: DataFrame, policies: list[dict]) -> DataFrame:
    """(policy, macro_f05) of each of ``policies``, keyword arguments of apply_policy; a plan for each, run as one query."""
    out = None
    for options in policies:
        label = ",".join(f"{k}={v}" for k, v in options.items())
        f = per_entity(entities, apply_policy(scores, **options).select("s1", "t"), truth).agg(F.avg("f").alias("macro_f05")).select(F.lit(label).alias("policy"), "macro_f05")
        out = f if out is None else out.unionByName(f)
    return out
