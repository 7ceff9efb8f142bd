"""Quality rules: counted base rules, then a hashed n-gram log-likelihood ratio. Native functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, filled, let

#: Hash buckets of the multinomials; what the driver reads of the corpus is this many pairs of counts.
BUCKETS = 4096
#: A document whose mean log ratio for each n-gram lies below is rejected.
THRESHOLD = -0.15
#: Target documents the target multinomial is fitted on, at most: those whose ids hash lowest. Bounds what is broadcast.
MAX_TRUSTED = 20_000
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
SYMBOLS = "#*$%&|<>"
_SPACE = "\t\n\x0b\f\r "
#: N-gram tokens: runs of letters and digits, and runs of other signs.
TOKEN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\x20\x09-\x0D]+"


#: A window's place takes so many low bits beside the high ones of its hash. Longer texts, and texts with windows of equal high bits that differ, are searched by the windows themselves.
PLACE_BITS = 20


def _covered(starts: Column) -> Column:
    """Number of words in the 3-word windows that start at these places."""
    return F.size(F.array_distinct(F.flatten(F.transform(F.array_distinct(starts), lambda i: F.array(i, i + 1, i + 2)))))


def _repeat_words(words: Column, place_bits: int = PLACE_BITS) -> Column:
    """Words covered by 3-word windows that occur twice or more.

    Windows are told apart by a 64-bit hash first; only in texts with equal hashes are they sorted,
    as one long each, and compared with their neighbours: with all windows of equal high bits
    the same, these are all repeats. Else the windows are sorted as text, hash first.
    """
    at = lambda w: F.sequence(F.lit(1), F.size(w) - 2)
    hash_at = lambda w, i: F.xxhash64(F.element_at(w, i), F.element_at(w, i + 1), F.element_at(w, i + 2))
    hashes = lambda w: F.transform(at(w), lambda i: hash_at(w, i))
    next_to = lambda s, both: F.zip_with(F.slice(s, 1, F.size(s) - 1), F.slice(s, 2, F.size(s)), both)
    windows = lambda w: F.sort_array(F.transform(at(w), lambda i: F.struct(hash_at(w, i).alias("h"), F.concat_ws(" ", F.slice(w, i, 3)).alias("w"), i.alias("i"))))
    equals = lambda s: next_to(s, lambda x, y: F.when((x["h"] == y["h"]) & (x["w"] == y["w"]), F.array(x["i"], y["i"])).otherwise(F.array().cast("array<int>")))
    by_text = lambda w: _covered(F.flatten(let(windows(w), equals)))

    places = F.lit((1 << place_bits) - 1).cast("long")
    place = lambda x: x.bitwiseAND(places).cast("int")
    packed = lambda w: F.sort_array(F.transform(at(w), lambda i: hash_at(w, i).bitwiseAND(F.bitwise_not(places)).bitwiseOR(i.cast("long"))))
    near = lambda s: F.filter(next_to(s, lambda x, y: F.when(x.bitwiseXOR(y).between(F.lit(0), places), F.array(place(x), place(y)))), lambda p: p.isNotNull())
    word = lambda w, p, k, j: F.element_at(w, F.element_at(p, k) + j)
    differ = lambda w, p: (word(w, p, 1, 0) != word(w, p, 2, 0)) | (word(w, p, 1, 1) != word(w, p, 2, 1)) | (word(w, p, 1, 2) != word(w, p, 2, 2))
    by_hash = lambda w: let(let(packed(w), near), lambda n: F.when(F.exists(n, lambda p: differ(w, p)), by_text(w)).otherwise(_covered(F.flatten(n))))
    return let(words, lambda w: F.when(F.size(w) < 4, 0).when(F.size(F.array_distinct(hashes(w))) == F.size(w) - 2, 0).when(F.size(w) >= 1 << place_bits, by_text(w)).otherwise(by_hash(w)))


def base_columns(text: Column) -> dict[str, Column]:
    """The counts of the base rules over a whole text (null: empty)."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    n = F.size(words)
    lines = F.filter(F.split(text, "\n", -1), lambda line: F.ltrim(line, F.lit(_SPACE)) != "")
    return {
        "n_words": n.cast("long"),
        "word_chars": F.length(F.array_join(words, "")).cast("long"),
        "n_symbols": F.regexp_count(text, F.lit(f"[{SYMBOLS}]")).cast("long"),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
        "n_repeat_words": _repeat_words(words).cast("long"),
    }


def grams(text: Column, buckets: int = BUCKETS) -> Column:
    """Buckets 1..``buckets`` of the hashed unigrams and bigrams of a text."""
    tokens = F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))
    bucket = lambda *x: (F.pmod(F.xxhash64(*x), F.lit(buckets)) + 1).cast("int")
    pairs = lambda t: F.zip_with(F.slice(t, 1, F.greatest(F.size(t) - 1, F.lit(0))), F.slice(t, 2, F.size(t)), lambda a, b: bucket(a, b))
    return let(tokens, lambda t: F.concat(F.transform(t, lambda x: bucket(x)), pairs(t)))


def bucket_weights(docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS, text: str = "text") -> list[float]:
    """log(p_target / p_raw) of each bucket, add-one smoothed.

    ``trusted`` (doc_id) names the target documents; MAX_TRUSTED of them are fitted on, chosen by
    a hash of their ids, and broadcast, so that no text moves. The raw counts are those of all
    documents, summed into at most ``buckets`` rows before they leave a task.
    """
    marks = trusted.select("doc_id").where("doc_id is not null").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_TRUSTED)
    rows = docs.select("doc_id", filled(text).alias("__text")).join(F.broadcast(marks.withColumn("__target", F.lit(1))), "doc_id", "left")
    each = rows.select(F.coalesce("__target", F.lit(0)).alias("target"), F.explode(grams(F.col("__text"), buckets)).alias("bucket"))
    counts = each.groupBy("bucket").agg(F.count("*").alias("raw"), F.sum("target").alias("target"))
    raw, target = [1] * buckets, [1] * buckets
    for bucket, n, t in counts.collect():  # at most ``buckets`` rows
        raw[bucket - 1] += n
        target[bucket - 1] += t
    all_raw, all_target = sum(raw), sum(target)
    return [math.log(t / all_target) - math.log(r / all_raw) for r, t in zip(raw, target)]


def log_ratio(text: Column, weights: list[float]) -> Column:
    """Mean weight of a text's n-grams; 0 without any."""
    table = F.split(F.lit(",".join(f"{w:.12g}" for w in weights)), ",").cast("array<double>")
    mean = lambda g: F.try_divide(F.aggregate(g, F.lit(0.0), lambda a, b: a + F.element_at(table, b)), F.size(g))
    return F.coalesce(let(grams(text, len(weights)), mean), F.lit(0.0))


def quality_scores(docs: DataFrame, trusted: DataFrame, threshold: float = THRESHOLD, text: str = "text") -> DataFrame:
    """Base counts, base_failed, log ratio and kept for every row, beside doc_id.

    A null text counts as empty: no words, base_failed. Repeated rows each get their own
    result; with no trusted document all ratios are those of the smoothed prior. Deterministic:
    the ratio is summed in text order from weights that depend on counts alone.
    """
    weights = bucket_weights(docs, trusted, text=text)
    rows = docs.select("doc_id", filled(text).alias("__text"))
    base = rows.select("doc_id", *[c.alias(k) for k, c in base_columns(F.col("__text")).items()], log_ratio(F.col("__text"), weights).alias("log_ratio"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return base.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("log_ratio") >= threshold))


def keep_good(docs: DataFrame, trusted: DataFrame, threshold: float = THRESHOLD, text: str = "text") -> DataFrame:
    """``docs`` without the rows that the base rules or the ratio reject; same columns."""
    weights = bucket_weights(docs, trusted, text=text)
    body = filled(text)
    base = base_columns(body)
    failed = (base["n_words"] < MIN_WORDS) | (100 * base["n_repeat_words"] > MAX_REPEAT_PERCENT * base["n_words"])
    return docs.where(~failed & (log_ratio(body, weights) >= threshold))


def op8_quality_rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    scored = quality_scores(docs, labels.where("quality = 1"))
    return scored.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "log_ratio")
