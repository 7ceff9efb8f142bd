"""Folds and exact macro-F0.5 evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def f05(predicted: set, true: set) -> float:
    """F0.5 of one entity; 1 if both sets are empty."""
    if not true:
        return float(not predicted)
    hit = len(predicted & true)
    if not hit:
        return 0.0
    precision, recall = hit / len(predicted), hit / len(true)
    return 1.25 * precision * recall / (0.25 * precision + recall)


def make_folds(entities: DataFrame, truth: DataFrame, targets: DataFrame, n_folds: int = 5, seed: int = 2026) -> DataFrame:
    """(s1, fold, stratum, n_true): entities dealt round within strata in the order of an MD5 of their id.

    Strata are country, number of matches (0, 1, 2-3, 4-5, 6+) and whether one is in an Indic script.
    """
    own = truth.join(targets.select("t", "script"), "t", "left").groupBy("s1").agg(F.count("*").alias("n_true"), F.bool_or(F.coalesce(F.col("script").isin("indic", "mixed"), F.lit(False))).alias("indic"))
    n = F.col("n_true")
    bucket = F.when(n == 0, "0").when(n == 1, "1").when(n <= 3, "2-3").when(n <= 5, "4-5").otherwise("6+")
    rows = entities.join(own, "s1", "left").withColumns({"n_true": F.coalesce("n_true", F.lit(0)), "indic": F.coalesce("indic", F.lit(False))})
    rows = rows.withColumn("stratum", F.concat_ws("|", "country", bucket, F.col("indic").cast("string")))
    order = Window.partitionBy("stratum").orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("s1").cast("string"))), "s1")
    return rows.select("s1", ((F.row_number().over(order) - 1) % n_folds).alias("fold"), "stratum", F.col("n_true").cast("long").alias("n_true"))


def per_entity(entities: DataFrame, predicted: DataFrame, truth: DataFrame) -> DataFrame:
    """(s1, n_true, n_pred, tp, f) for every entity, in one aggregation of tagged pairs."""
    tagged = predicted.select("s1", "t", F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(truth.select("s1", "t", F.lit(0).alias("a"), F.lit(1).alias("b")))
    pairs = tagged.groupBy("s1", "t").agg(F.max("a").alias("a"), F.sum("b").alias("b"))
    counts = pairs.groupBy("s1").agg(F.sum("b").alias("n_true"), F.sum("a").alias("n_pred"), F.sum(F.least("a", "b")).alias("tp"))
    out = entities.select("s1").join(counts, "s1", "left").na.fill(0, ["n_true", "n_pred", "tp"])
    precision, recall = F.col("tp") / F.col("n_pred"), F.col("tp") / F.col("n_true")
    f = F.when(F.col("n_true") == 0, (F.col("n_pred") == 0).cast("double")).when(F.col("tp") == 0, 0.0).otherwise(1.25 * precision * recall / (0.25 * precision + recall))
    return out.withColumn("f", f)


def summarize(entities: DataFrame) -> DataFrame:
    """One row of headline metrics of :func:`per_entity` rows."""
    fp = F.col("n_pred") - F.col("tp")
    share = lambda a, b: F.sum(a) / F.greatest(F.sum(b), F.lit(1))
    multi = lambda c: F.when(F.col("n_true") >= 2, F.col(c)).otherwise(0)
    return entities.agg(
        F.count("*").alias("n_s1"), F.avg("f").alias("macro_f05"),
        (1.96 * F.coalesce(F.stddev_samp("f"), F.lit(0.0)) / F.sqrt(F.greatest(F.count("*"), F.lit(1)))).alias("ci95"),
        F.avg(F.when(F.col("n_true") == 0, (F.col("n_pred") == 0).cast("double"))).alias("singleton_acc"),
        F.sum(fp).alias("fp_pairs"), F.avg((fp > 0).cast("double")).alias("s1_with_fp"), share(multi("tp"), multi("n_true")).alias("multi_recall"),
        share("tp", "n_pred").alias("pair_precision"), share("tp", "n_true").alias("pair_recall"),
        F.avg("n_pred").alias("mean_pred_len"), F.avg("n_true").alias("mean_true_len"),
    )


def candidate_metrics(entities: DataFrame, candidates: DataFrame, truth: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    """Recall ceiling, oracle macro F0.5, list lengths and, given ``targets`` (country), the reduction ratio."""
    ids = entities.select("s1")
    mine, own = candidates.select("s1", "t").join(ids, "s1", "left_semi").distinct(), truth.join(ids, "s1", "left_semi")
    scored = per_entity(ids, mine, own)
    ideal = per_entity(ids, mine.join(own, ["s1", "t"], "left_semi"), own).select("s1", F.col("f").alias("oracle"))
    out = scored.join(ideal, "s1").agg(
        F.sum("n_true").alias("pairs_true"), (F.sum("tp") / F.greatest(F.sum("n_true"), F.lit(1))).alias("pair_recall"),
        F.avg(F.when(F.col("n_true") > 0, (F.col("tp") == F.col("n_true")).cast("double"))).alias("s1_full_cover"), F.avg("oracle").alias("oracle_macro_f05"),
        F.sum("n_pred").alias("cand_pairs"), F.avg("n_pred").alias("cand_per_s1_mean"), F.expr("percentile_disc(0.9) within group (order by n_pred)").alias("cand_per_s1_p90"), F.max("n_pred").alias("cand_per_s1_max"),
    )
    if targets is None:
        return out
    space = entities.groupBy("country").agg(F.count("*").alias("n")).join(targets.groupBy("country").agg(F.count("*").alias("m")), "country").agg(F.coalesce(F.sum(F.col("n") * F.col("m")), F.lit(0)).alias("space"))
    # Both sides are one row.
    return out.join(space, F.lit(True)).withColumn("reduction_ratio", 1 - F.col("cand_pairs") / F.greatest("space", F.lit(1))).drop("space")


def strata_report(entities: DataFrame, columns: list[str]) -> DataFrame:
    """n, macro F0.5, loss, its share of all loss, false positives and negatives by each of ``columns``, in one pass."""
    sets = [[F.col(c)] for c in columns] + [[]]
    out = entities.groupingSets(sets, *[F.col(c) for c in columns]).agg(
        F.grouping_id(*columns).alias("level"), F.count("*").alias("n"), F.avg("f").alias("macro_f05"), F.sum(1 - F.col("f")).alias("loss"),
        F.sum(F.col("n_pred") - F.col("tp")).alias("fp"), F.sum(F.col("n_true") - F.col("tp")).alias("fn"),
    )
    value = F.coalesce(*[F.col(c).cast("string") for c in columns], F.lit(""))
    every = (1 << len(columns)) - 1
    kind = F.lit("all")
    for i, c in enumerate(columns):
        kind = F.when(F.col("level") == every - (1 << (len(columns) - 1 - i)), c).otherwise(kind)
    total = F.max(F.when(F.col("level") == every, F.col("loss"))).over(Window.partitionBy())
    return out.select(kind.alias("dimension"), value.alias("value"), "n", "macro_f05", "loss", F.coalesce(F.try_divide("loss", total), F.lit(0.0)).alias("share_of_loss"), "fp", "fn")


def reliability(scores: DataFrame) -> DataFrame:
    """(decile, mean_p, rate, n) of scores with a 0/1 label y."""
    return scores.groupBy(F.least(F.floor(10 * F.col("p")), F.lit(9)).cast("int").alias("decile")).agg(F.avg("p").alias("mean_p"), F.avg("y").alias("rate"), F.count("*").alias("n"))
