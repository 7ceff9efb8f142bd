"""Decisions on scored pairs (s1, t, p): owners, shifts, thresholds and expected-F0.5 sets."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_MATCHES = 11


def _best_first() -> Window:
    return Window.partitionBy("s1").orderBy(F.col("p").desc(), "t")


def through_odds(scores: DataFrame, r: float) -> DataFrame:
    """Odds times r; at r = 1 p comes back, but for its last bits."""
    p = F.col("p")
    odds = r * p / F.greatest(1 - p, F.lit(1e-12))
    return scores.withColumn("p", odds / (1 + odds))


def prior_shift(scores: DataFrame, r: float) -> DataFrame:
    """Odds times r; p as it is at r = 1."""
    return scores if r == 1 else through_odds(scores, r)


def single_owner(scores: DataFrame) -> DataFrame:
    """p given that at most one of a target's claimants owns it: odds / (1 + sum of odds)."""
    p = F.least(F.greatest(F.col("p"), F.lit(0.0)), F.lit(1 - 1e-6))
    odds = p / (1 - p)
    return scores.withColumn("__odds", odds).withColumn("p", F.col("__odds") / (1 + F.sum("__odds").over(Window.partitionBy("t")))).drop("__odds")


def hard_owner(scores: DataFrame) -> DataFrame:
    """Zero for all but the strongest claim on a target; equal strongest claims all stay."""
    return scores.withColumn("p", F.when(F.col("p") == F.max("p").over(Window.partitionBy("t")), F.col("p")).otherwise(0.0))


def threshold_select(scores: DataFrame, tau: float, rho: float = 0.0, exclusive: bool = False, cap: int = MAX_MATCHES) -> DataFrame:
    """(s1, t) with p >= tau, optionally the target's best claim, within rho of the entity's best kept p, at most ``cap``."""
    kept = scores.where(F.col("p") >= tau)
    if exclusive:
        kept = kept.withColumn("__max", F.max("p").over(Window.partitionBy("t"))).where("p = __max").drop("__max")
    ranked = kept.withColumn("__best", F.max("p").over(Window.partitionBy("s1"))).where(F.col("p") >= rho * F.col("__best"))
    return ranked.withColumn("__rank", F.row_number().over(_best_first())).where(F.col("__rank") <= cap).select("s1", "t")


def _counts(p: np.ndarray) -> np.ndarray:
    """Distributions of the number of hits among the first 0..n items: row k has k items."""
    out = np.zeros((len(p) + 1, len(p) + 1))
    out[0, 0] = 1
    for k, q in enumerate(p):
        out[k + 1] = out[k] * (1 - q)
        out[k + 1, 1:] += out[k, :-1] * q
    return out


def expected_f(p: np.ndarray, lam: float, max_k: int = MAX_MATCHES, more: int = 25) -> np.ndarray:
    """Expected F0.5 of predicting the first k of the descending ``p``, for k = 0..max_k.

    Labels are independent; a Poisson number of further true matches, of mean ``lam``, lies
    outside. Predicting nothing scores 1 only when nothing is true.
    """
    p = np.asarray(p, float)
    pois = np.array([math.exp(-lam) * lam**j / math.factorial(j) for j in range(more + 1)])
    front, back = _counts(p), _counts(p[::-1])
    out = np.zeros(min(max_k, len(p)) + 1)
    out[0] = front[len(p), 0] * pois[0]
    for k in range(1, len(out)):
        rest = np.convolve(back[len(p) - k], pois)
        hits = np.arange(k + 1)
        gain = 1.25 * hits[:, None] / (k + 0.25 * (hits[:, None] + np.arange(len(rest))[None, :]))
        out[k] = front[k, : k + 1] @ gain @ rest
    return out


@F.pandas_udf(T.IntegerType())
def _best_k(p: pd.Series, lam: pd.Series) -> pd.Series:
    return pd.Series([int(np.argmax(expected_f(x, y))) for x, y in zip(p, lam)], dtype="int32")


def expected_f_select(scores: DataFrame, missed: float, top: int = 12) -> DataFrame:
    """(s1, t, k): each entity's k best pairs, k maximising expected F0.5 over its ``top`` best.

    The others, and ``missed`` matches that blocking lost, are the Poisson rest.
    """
    ranked = scores.withColumn("__rank", F.row_number().over(_best_first()))
    lists = ranked.groupBy("s1").agg(
        F.sort_array(F.collect_list(F.when(F.col("__rank") <= top, F.col("p"))), asc=False).alias("p"),
        (F.coalesce(F.sum(F.when(F.col("__rank") > top, F.col("p"))), F.lit(0.0)) + missed).alias("lam"),
    )
    chosen = lists.select("s1", _best_k("p", "lam").alias("k"))
    return ranked.join(chosen, "s1").where("__rank <= k").select("s1", "t", "k")


def apply_policy(scores: DataFrame, kind: str, tau: float = 0.5, rho: float = 0.0, missed: float = 0.0, shift: float = 1.0) -> DataFrame:
    """Drop p <= 1e-4, shift, then eum (hard owner, threshold), dta, dta_own or dta_hard."""
    return select_by(prior_shift(scores.where("p > 1e-4"), shift), kind, tau, rho, missed)


def select_by(shifted: DataFrame, kind: str, tau: float = 0.5, rho: float = 0.0, missed: float = 0.0) -> DataFrame:
    """The policies of :func:`apply_policy` on scores that are shifted already."""
    if kind == "eum":
        return threshold_select(hard_owner(shifted), tau, rho)
    owned = {"dta": lambda d: d, "dta_own": single_owner, "dta_hard": hard_owner}[kind](shifted)
    return expected_f_select(owned, missed).select("s1", "t")


def cross_fitted(a: Column, b: Column, fold: Column) -> Column:
    """Score of the model that has not seen a row's fold; the mean for sealed and new rows."""
    return F.when(fold.isin(2, 3), a).when(fold.isin(0, 1), b).otherwise((a + b) / 2)
