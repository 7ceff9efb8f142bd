"""Distractor injection: hide a share of the entities and decide again for a fixed rest."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkweave.operators.decide import select_by, through_odds
from linkweave.operators.evaluate import per_entity


def hash_share(key: str, seed: int) -> Column:
    """A number in [0, 1) from the MD5 of a key."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string"))), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))


def injection(
    scores: DataFrame, truth: DataFrame, entities: DataFrame, levels=(0.0, 0.2, 0.3), evaluate_share: float = 0.3, shifts=(1.0,), seed: int = 2026,
    rescore: Callable[[DataFrame], DataFrame] | None = None, policy: str = "dta_own", **options,
) -> DataFrame:
    """(level, shift, s1, n_true, n_pred, tp, f) of the evaluated entities at each hide level and shift.

    With part of the entities hidden, ``rescore`` gives the claims that are left new scores: for a model whose
    features count competition, they have to be computed again (as competition and claim_context do)
    from what is left. Owners are settled over all these claims; only then are the evaluated entities chosen.
    At every shift, 1 included, p goes through its odds: where a score lies at just ``rho`` of the best,
    its last bits decide, and so shifts are compared under one rounding.
    """
    chosen = entities.where(hash_share("s1", seed + 7) < evaluate_share)
    out = None
    for level in levels:
        hidden = entities.join(chosen, "s1", "left_anti").where(hash_share("s1", seed + 8) < level)
        left = scores.join(hidden, "s1", "left_anti")
        left = rescore(left) if rescore else left
        for shift in shifts:
            picked = select_by(through_odds(left.where("p > 1e-4"), shift), policy, **options).join(chosen, "s1", "left_semi")
            rows = per_entity(chosen, picked.select("s1", "t"), truth.join(chosen, "s1", "left_semi"))
            rows = rows.withColumns({"level": F.lit(level), "shift": F.lit(shift)})
            out = rows if out is None else out.unionByName(rows)
    return out
