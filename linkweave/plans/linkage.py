"""The linkage query end to end: normalise, block, describe, score, decide."""

from __future__ import annotations

from dataclasses import dataclass, fields
from hashlib import sha256

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkweave.functions.normalize import normalize_frame
from linkweave.operators.blocking import Caps, build_candidates, ranker_union, top_per_entity
from linkweave.operators.decide import apply_policy
from linkweave.operators.evaluate import make_folds
from linkweave.operators.features import attach_sides, competition, list_context, name_frequencies, native_features, string_features
from linkweave.plans import models

FEATURES = (
    "name_jac name_exact name_ratio name_tset concat_lvl name_jw acro legal_match legal_conflict addr_jac addr_tset num_match num_conflict "
    "num_first_eq num_near num_suffix log_name_tdf log_name_rep rare_idf rare_n addr_n f_exact f_concat cheap_rank cheap_rel log_n_cand"
).split()


@dataclass(frozen=True)
class Settings:
    """Every choice of a run; :meth:`fingerprint` names it."""

    n_folds: int = 5
    seed: int = 2026
    caps: Caps = Caps()
    wide: bool = False
    keep: int = 60
    policy: str = "dta_own"
    missed: float = 0.1
    shift: float = 0.6
    negative_rate: float = 0.2

    def fingerprint(self) -> str:
        return sha256(repr([(f.name, getattr(self, f.name)) for f in fields(self)]).encode()).hexdigest()[:12]


def prepare(source: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Records (entity_id, business_name, business_address, country) as normalised (id, ...)."""
    return normalize_frame(source).withColumnRenamed("entity_id", "id").drop("business_name", "business_address")


def describe(pairs: DataFrame, s: DataFrame, t: DataFrame) -> DataFrame:
    rows = list_context(string_features(native_features(name_frequencies(attach_sides(pairs, s, t), s, t))))
    return rows.withColumns({"log_name_tdf": F.log1p("name_tdf"), "log_name_rep": F.log1p("name_rep")})


def candidates(s: DataFrame, t: DataFrame, settings: Settings = Settings()) -> DataFrame:
    if not settings.wide:
        return build_candidates(s, t, settings.caps)
    union = ranker_union(s, t)
    score = 2.0 * F.col("f_exact") + F.col("rare_idf") / 10 + 0.8 * F.least("addr_n", F.lit(3)) + 1.5 * F.col("f_concat") + F.col("a2_idf") / 20 + F.col("sk_idf") / 10
    return top_per_entity(union.withColumn("cheap", score), F.col("cheap"), settings.keep)


def link(s: DataFrame, t: DataFrame, truth: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(s1, t): the matches of every entity, by a cross-fitted, calibrated logistic model."""
    rows = describe(candidates(s, t, settings), s, t)
    folds = make_folds(s.select(F.col("id").alias("s1"), "country"), truth, t.select(F.col("id").alias("t"), "script"), settings.n_folds, settings.seed)
    labelled = rows.join(truth.withColumn("label", F.lit(1)), ["s1", "t"], "left").na.fill(0, ["label"]).join(folds.select("s1", "fold"), "s1")
    fitted = models.cross_fit(models.logistic(FEATURES), labelled, settings.negative_rate)
    scores = models.calibrate(models.cross_scores(fitted, labelled))
    return apply_policy(scores.select("s1", "t", "p"), settings.policy, missed=settings.missed, shift=settings.shift)


def claims(scores: DataFrame) -> DataFrame:
    """Scores with the competition for their target."""
    return scores.join(competition(scores), "t")
