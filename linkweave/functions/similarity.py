"""String similarities that Spark lacks, as Arrow functions, and native set similarities."""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _common(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bits of one integer for all of ``a``."""
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    free = full
    for c in b:
        hit = free & where.get(c, 0)
        free = (free + hit | free - hit) & full
    return len(a) - free.bit_count()


@lru_cache(1 << 16)
def indel_ratio(a: str, b: str) -> float:
    """2 LCS / (len a + len b) in percent; 0 if a side is empty."""
    return 200.0 * _common(a, b) / (len(a) + len(b)) if a and b else 0.0


@lru_cache(1 << 16)
def token_set_ratio(a: str, b: str) -> float:
    """Best indel ratio among shared tokens and shared tokens with either rest."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both = " ".join(sorted(x & y))
    if both and (x <= y or y <= x):
        return 100.0
    left, right = " ".join(sorted(x - y)), " ".join(sorted(y - x))
    p, q = f"{both} {left}".strip(), f"{both} {right}".strip()
    rests = 200.0 * (len(both) + bool(both) + _common(left, right)) / (len(p) + len(q))
    return max(rests, indel_ratio(both, p), indel_ratio(both, q))


@lru_cache(1 << 16)
def partial_ratio(a: str, b: str) -> float:
    """Best indel ratio of the shorter string against windows of the longer one, cut at its ends."""
    if not a or not b:
        return 0.0
    a, b = sorted((a, b), key=len)
    n = len(a)
    windows = {b[max(0, i) : i + n] for i in range(1 - n, len(b))}
    best = max(indel_ratio(a, w) for w in windows)
    return max(best, max(indel_ratio(b, a[max(0, i) : i + n]) for i in range(1 - n, n))) if len(a) == len(b) else best


@lru_cache(1 << 16)
def jaro_winkler(a: str, b: str) -> float:
    """Jaro similarity with 0.1 for each of up to four common first letters, above 0.7."""
    if not a or not b:
        return 0.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    taken, mine = [False] * len(b), []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not taken[j] and b[j] == c:
                taken[j] = True
                mine.append(c)
                break
    m = len(mine)
    if not m:
        return 0.0
    swaps = sum(x != y for x, y in zip(mine, (c for c, t in zip(b, taken) if t))) // 2
    jaro = (m / len(a) + m / len(b) + (m - swaps) / m) / 3
    prefix = 0
    while prefix < min(4, len(a), len(b)) and a[prefix] == b[prefix]:
        prefix += 1
    return jaro + 0.1 * prefix * (1 - jaro) if jaro > 0.7 else jaro


def _pairwise(function):
    return F.pandas_udf(lambda a, b: pd.Series([function(x or "", y or "") for x, y in zip(a, b)], dtype="float64"), T.DoubleType())


indel_udf, token_set_udf, partial_udf, jaro_winkler_udf = map(_pairwise, (indel_ratio, token_set_ratio, partial_ratio, jaro_winkler))


def tokens(c: str | Column) -> Column:
    """Space-separated tokens of a string; none of an empty or null one."""
    c = F.col(c) if isinstance(c, str) else c
    return F.filter(F.split(F.coalesce(c, F.lit("")), " "), lambda x: x != "")


def jaccard(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))), F.lit(0.0))


def containment(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.least(F.size(F.array_distinct(a)), F.size(F.array_distinct(b)))), F.lit(0.0))


def prefix_levels(a: Column, b: Column) -> Column:
    """How many of the prefixes of 4, 6, 8 and 12 characters agree, each side being that long."""
    return sum(((F.char_length(a) >= n) & (F.char_length(b) >= n) & (F.substring(a, 1, n) == F.substring(b, 1, n))).cast("int") for n in (4, 6, 8, 12))


def first_number(nums: Column) -> Column:
    return F.regexp_extract(nums, r"([0-9]+)", 1).try_cast("double")
