"""Cross-site boilerplate lines by distinct-site spread. Native functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, filled, row_key, written

#: A line on this many sites or more is boilerplate.
MIN_SITES = 5
#: Sketch size (2^12 registers, standard error 1.6 %) and the band around MIN_SITES that is counted exactly.
LG_K, MARGIN = 12, 0.2


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _keyed(line: str = "line") -> list[Column]:
    """128 bits of hash, so that the lines of a corpus don't collide."""
    return [F.xxhash64(line).alias("h"), F.xxhash64(F.lit(7), line).alias("g")]


def spread_lines(docs: DataFrame, min_sites: int = MIN_SITES, text: str = "text", site: str = "source") -> DataFrame:
    """(h, g, n_sites) of the lines with a word that stand on ``min_sites`` or more distinct sites.

    A line on that many sites has at least as many rows and two different sites, which
    a plain count decides before anything else. The sites of the rest go into one
    HyperLogLog sketch for each line hash, merged by aggregation. Lines whose estimate lies within
    MARGIN of the limit get an exact distinct count, and only those. A null site is none.
    """
    lines = docs.select(F.col(site).alias("site"), F.explode(_lines(filled(text))).alias("line"))
    lines = lines.where(F.col("site").isNotNull() & F.col("line").rlike(WORD)).select("site", *_keyed())
    counted = lines.groupBy("h", "g").agg(F.count("*").alias("n"), F.min("site").alias("lo"), F.max("site").alias("hi"))
    often = written(counted.where((F.col("n") >= min_sites) & (F.col("lo") <= F.col("hi")) & ((F.col("lo") < F.col("hi")) | (min_sites < 2))).select("h", "g"), "often")
    some = lines.join(often, ["h", "g"], "left_semi")
    sketched = some.groupBy("h", "g").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", LG_K)).alias("n_sites"))
    spread = written(sketched.where(F.col("n_sites") >= min_sites * (1 - MARGIN)), "spread")
    near = spread.where(F.col("n_sites") <= min_sites * (1 + MARGIN)).select("h", "g")
    exact = lines.join(near, ["h", "g"], "left_semi").groupBy("h", "g").agg(F.count_distinct("site").alias("n_sites"))
    sure = spread.where(F.col("n_sites") > min_sites * (1 + MARGIN))
    return written(sure.unionByName(exact.where(F.col("n_sites") >= min_sites)), "boilerplate")


def _copied(docs: DataFrame, text: str) -> DataFrame:
    """(key, other): hashes of the whole texts that stand under two doc_ids or more; null is one doc_id."""
    texts = docs.select("doc_id", row_key(filled(text)).alias("key"), F.xxhash64(F.lit(7), filled(text)).alias("other"))
    found = texts.groupBy("key", "other").agg(F.count("*").alias("n"), F.count("doc_id").alias("ids"), F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"))
    return written(found.where((F.col("lo") < F.col("hi")) | (F.col("ids").between(1, F.col("n") - 1))).select("key", "other"), "copied")


def _words_in(lines: Column) -> Column:
    return F.regexp_count(F.array_join(lines, "\n"), F.lit(WORD))


def _stripped(docs: DataFrame, min_sites: int, text: str, site: str) -> DataFrame:
    """(row, lines, left): every row as one struct, its lines, and those that stay."""
    spread = spread_lines(docs, min_sites, text, site).select("h", "g")
    at = docs.select(F.col("doc_id").alias("doc"), row_key(filled(text)).alias("key"), F.xxhash64(F.lit(7), filled(text)).alias("other"), F.posexplode(_lines(filled(text))).alias("pos", "line"))
    hits = at.where(F.col("line").rlike(WORD)).select("doc", "key", "other", "pos", *_keyed()).join(spread, ["h", "g"])
    hits = hits.groupBy("doc", "key").agg(F.min("other").alias("other"), F.collect_set("pos").alias("hits"))
    hits = hits.join(_copied(docs, text).withColumn("copied", F.lit(True)), ["key", "other"], "left").select("doc", F.col("key").alias("hit_key"), "hits", "copied")
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("id"), row_key(filled(text)).alias("key"), _lines(filled(text)).alias("lines"))
    joined = rows.join(hits.hint("merge"), F.col("id").eqNullSafe(F.col("doc")) & (F.col("key") == F.col("hit_key")), "left")
    places = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("hits"))
    rest = joined.select("row", "lines", "hits", "copied", F.when(F.col("hits").isNull(), F.col("lines")).otherwise(F.transform(places, lambda i: F.get("lines", i))).alias("rest"))
    words = _words_in(F.col("rest"))
    whole = (words == 0) | (F.col("copied").isNotNull() & (2 * words < _words_in(F.col("lines"))))
    return rest.select("row", "lines", F.when(F.col("hits").isNull() | whole, F.col("lines")).otherwise(F.col("rest")).alias("left"))


def drop_boilerplate_lines(docs: DataFrame, min_sites: int = MIN_SITES, text: str = "text", site: str = "source") -> DataFrame:
    """``docs`` with their cross-site boilerplate lines taken out of the text; no row goes.

    Only known copies are left whole, which near-duplicate removal decides on: a document
    all of whose words stand in such lines, and one with most of them there whose whole text
    is also that of another document. A null text stays null, an empty one empty, an empty table empty. Rows that
    repeat a document are treated alike. Other columns pass through, whatever their names.
    """
    found = _stripped(docs, min_sites, text, site)
    joined = F.when(F.col("row")[text].isNotNull(), F.array_join("left", "\n"))
    return found.select(F.col("row").withField(text, joined).alias("row")).select("row.*")


def op5_line_dedup(docs: DataFrame) -> DataFrame:
    return _stripped(docs, MIN_SITES, "text", "source").select(
        F.col("row.doc_id").alias("doc_id"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size("left")).cast("long").alias("n_removed"),
        F.md5(F.array_join("left", "\n")).alias("text_md5"),
    )


OP5_SQL = f"""
with d as (select row_number() over () as r, doc_id, source, coalesce(text, '') as body, string_split(coalesce(text, ''), chr(10)) as ls from documents),
c as (select body from d group by body having min(doc_id) < max(doc_id) or count(doc_id) between 1 and count(*) - 1),
l as (select r, source, unnest(ls) as line, generate_subscripts(ls, 1) as pos from d),
b as (select line from l where regexp_matches(line, '{WORD}') group by line having count(distinct source) >= {MIN_SITES}),
k as (select l.r, l.pos, l.line, b.line is not null as hit, len(regexp_extract_all(l.line, '{WORD}')) as w from l left join b using (line)),
s as (select r, sum(w) as w_all, sum(case when hit then 0 else w end) as w_left,
        count(*) as n, sum(hit::int) as n_hit,
        coalesce(string_agg(line, chr(10) order by pos) filter (not hit), '') as t_left,
        string_agg(line, chr(10) order by pos) as t_all from k group by r),
v as (select s.*, d.doc_id, w_left = 0 or (c.body is not null and 2 * w_left < w_all) as whole from s join d using (r) left join c using (body))
select doc_id, n::bigint as n_lines, (case when whole then 0 else n_hit end)::bigint as n_removed, md5(case when whole then t_all else t_left end) as text_md5
from v
"""
