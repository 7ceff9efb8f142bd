"""Mixing sources to target weights by repetition rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, filled, written

#: No document is repeated more often.
MAX_REPEATS = 3
#: Ordinals of equal rows that one task unfolds at once.
BLOCK = 4096
#: Weights of the sources in code-point order, repeating; a null source comes last.
WEIGHTS = (1, 2, 3)


def source_targets(sizes: DataFrame, share: float = 1.0, max_repeats: int = MAX_REPEATS, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(source, source_size, weight, target) from (source, source_size), one row for each source.

    Targets are in the ratio of the weights and sum to ``share`` of all sizes; a target
    stops at ``max_repeats`` times its source's size and the excess is shared again by
    weight until none is above. That is a water level: target = least(cap, level * weight).
    Sources fill up in the order of cap / weight, so one pass over running sums of the
    per-source totals finds the level.
    """
    # One row for each source: an ordered window over them, never over documents.
    place = F.row_number().over(Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))) - 1
    kinds = F.array(*[F.lit(w) for w in weights])
    ranked = sizes.withColumn("weight", F.get(kinds, (place % len(weights)).cast("int"))).withColumn("cap", max_repeats * F.col("source_size"))
    fill = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), F.col("source").cast("binary")).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    total = F.sum("source_size").over(everything) * F.lit(share)
    ranked = ranked.withColumn("level", F.try_divide(total - F.coalesce(F.sum("cap").over(fill), F.lit(0)), F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(fill), F.lit(0))))
    # The first source, in that order, whose cap is above its share sets the level of it and all after it.
    level = F.min(F.when(F.col("cap") >= F.col("level") * F.col("weight"), F.struct(F.col("cap") / F.col("weight"), F.col("level").alias("level")))).over(everything)["level"]
    return ranked.withColumn("at", level).select("source", "source_size", "weight", F.when(F.col("at").isNull(), F.col("cap").cast("double")).otherwise(F.least(F.col("cap").cast("double"), F.col("at") * F.col("weight"))).alias("target"))


def uniform(seed: str, *cols: Column) -> Column:
    """A number in [0, 1) from 52 bits of MD5, the same on every run and engine."""
    digest = F.md5(F.concat_ws("|", F.lit(seed), *[c.cast("string") for c in cols]))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def _numbered(repeated: DataFrame) -> DataFrame:
    """Each row of ``repeated``, which has a count n, n times with ordinals 1..n.

    Equal rows can't be told apart, so they are counted and made anew instead of being
    numbered in one task: blocks of BLOCK ordinals are spread before they are unfolded.
    """
    blocks = repeated.select("*", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / BLOCK))).alias("block")).repartition("block", "id", "key")
    upto = F.least(F.lit(BLOCK), F.col("n") - F.col("block") * BLOCK)
    return blocks.withColumn("ordinal", F.explode(F.sequence(F.lit(1), upto))).withColumn("ordinal", F.col("block") * BLOCK + F.col("ordinal")).drop("block", "n")


def _copies(size: Column, rate: Column, seed: str, *parts: Column) -> Column:
    """floor(rate), plus one with probability rate - floor(rate); none for a text of no words."""
    whole = F.floor(rate)
    return F.when(size == 0, 0).otherwise(whole + (uniform(seed, *parts) < rate - whole).cast("int"))


def _rates(totals: DataFrame) -> DataFrame:
    rate = F.coalesce(F.try_divide(F.col("target"), F.col("source_size")), F.lit(0.0))
    return totals.select(F.col("source").alias("of"), "source_size", "target", rate.alias("rate"))


def _split(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``rows`` (id, key, ...) whose id and text occur once, and the others."""
    often = written(rows.groupBy("id", "key").agg(F.count("*").alias("n")).where("n > 1").select(F.col("id").alias("often_id"), F.col("key").alias("often_key")), "repeated")
    if not often.take(1):
        return rows, rows.limit(0)
    same = F.col("id").eqNullSafe(F.col("often_id")) & (F.col("key") == F.col("often_key"))
    return rows.join(often, same, "left_anti"), rows.join(often, same, "left_semi")


def repetition_counts(docs: DataFrame, seed: str = "mix", text: str = "text", **options) -> DataFrame:
    """Each row of ``docs`` reduced to doc_id, source, key, size, source_size, target, copies.

    copies = floor(rate) plus one with probability rate - floor(rate), rate being the
    target over the size of the source. The draw depends on seed, doc_id and the text's MD5; rows that
    repeat both draw each for itself, by source and ordinal.
    Documents of no words, and sources of size 0, have no copies and take nothing; a null text has size 0.
    Sizes are summed in each task before they move, so a hot source is no burden. Other columns are not read. An empty table has no rows.
    """
    body = filled(text)
    sized = written(docs.select(F.col("doc_id").alias("id"), "source", F.md5(body).alias("key"), F.regexp_count(body, F.lit(WORD)).cast("long").alias("size")), "sizes")
    totals = written(source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), **options), "targets")
    once, often = _split(sized)
    often = _numbered(often.groupBy("id", "source", "key", "size").agg(F.count("*").alias("n")))
    id_part = F.coalesce(F.col("id").cast("string"), F.lit(""))
    copies = F.when(F.col("ordinal").isNull(), _copies(F.col("size"), F.col("rate"), seed, id_part, F.col("key"))).otherwise(_copies(F.col("size"), F.col("rate"), seed, id_part, F.col("key"), F.coalesce("source", F.lit("")), F.col("ordinal")))
    joined = once.withColumn("ordinal", F.lit(None).cast("long")).unionByName(often).join(_rates(totals), F.col("source").eqNullSafe(F.col("of")))
    return joined.select(F.col("id").alias("doc_id"), "source", "key", "size", "source_size", "target", copies.cast("long").alias("copies"))


def mix_sources(docs: DataFrame, seed: str = "mix", text: str = "text", **options) -> DataFrame:
    """``docs`` with every row emitted as often as the mix takes it; same columns, whatever their names.

    The copies of a row are made where it is; only ids, sizes and counts are shuffled
    to find the rates, and rows meet their source's rate by a join on the source. Rows that repeat a
    doc_id with the same text are counted by the hash of all their columns and draw each for itself. An empty table stays empty.
    """
    body = filled(text)
    sized = docs.groupBy("source").agg(F.sum(F.regexp_count(body, F.lit(WORD)).cast("long")).alias("source_size"))
    totals = _rates(written(source_targets(sized, **options), "targets"))
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("id"), F.md5(body).alias("key"), body.rlike(WORD).cast("int").alias("size"), F.col("source").alias("site"))
    once, often = _split(rows)
    id_part = F.coalesce(F.col("id").cast("string"), F.lit(""))
    rated = once.join(totals, F.col("site").eqNullSafe(F.col("of")))
    parts = [rated.select("row", _copies(F.col("size"), F.col("rate"), seed, id_part, F.col("key")).alias("copies"))]
    if often.take(1):
        hashed = often.withColumn("hash", F.md5(F.to_json("row")))
        counted = hashed.groupBy("id", "key", "hash").agg(F.count("*").alias("n"), F.first("row").alias("row"), F.first("size").alias("size"), F.first("site").alias("site"))
        each = _numbered(counted).join(totals, F.col("site").eqNullSafe(F.col("of")))
        parts.append(each.select("row", _copies(F.col("size"), F.col("rate"), seed, id_part, F.col("key"), F.col("hash"), F.col("ordinal")).alias("copies")))
    taken = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return taken.select("row", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int")))).select("row.*")


def op6_mixing(docs: DataFrame) -> DataFrame:
    found = repetition_counts(docs)
    return found.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def mixing_sql(rows: str) -> str:
    """DuckDB common table expressions over ``rows`` (doc_id, source, text): ``mixed`` has copies."""
    return f"""
z as (select *, len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::bigint as size from {rows}),
t as (select source, sum(size)::bigint as source_size from z group by source),
p as (select *, ((row_number() over (order by source is null, encode(source)) - 1) % 3 + 1)::int as weight, {MAX_REPEATS} * source_size as cap from t),
l as (select *, (sum(source_size) over () * 1.0::double - coalesce(sum(cap) over f, 0))
        / (sum(weight) over () - coalesce(sum(weight) over f, 0)) as level from p
      window f as (order by cap / weight, source is null, encode(source) rows between unbounded preceding and 1 preceding)),
v as (select min(level) filter (cap >= level * weight) as lo, arg_min(level, cap / weight) filter (cap >= level * weight) as lvl from l),
g as (select source, source_size, least(cap::double, coalesce(lvl * weight, cap::double)) as target from l, v),
o as (select *, count(*) over same as n, row_number() over (partition by doc_id, md5(coalesce(text, '')), source) as ordinal from z
      window same as (partition by doc_id, md5(coalesce(text, '')))),
r as (select o.*, g.source_size, g.target, case when g.source_size = 0 then 0.0 else g.target / g.source_size end as rate,
        ('0x' || substr(md5('mix|' || coalesce(doc_id::varchar, '') || '|' || md5(coalesce(text, '')) || case when n > 1 then '|' || coalesce(o.source, '') || '|' || ordinal else '' end), 1, 13))::bigint / 4503599627370496.0::double as draw
      from o join g on o.source is not distinct from g.source),
mixed as (select *, case when size = 0 then 0 else floor(rate)::bigint + (draw < rate - floor(rate))::int end as copies from r)"""


OP6_SQL = f"with {mixing_sql('documents')} select doc_id, size, source_size, target, (size * copies)::bigint as taken from mixed"
