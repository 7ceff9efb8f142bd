"""Queries of record statistics, candidate reports and list consensus, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from linkweave.operators import blocking, features, reports
from linkweave.plans.queries import _CUT, _ENT, _rounded, sides


def _records(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """The sides with the flags that normalised records have."""
    flags = {"addr_blank": F.col("addr_nums") == "50", "is_domain": F.col("core").contains("b"), "acro_self": F.when(F.col("src") == 2, F.lit("")).otherwise(F.col("core_key"))}
    s, t = sides(spark, sf)
    return s.withColumns(flags), t.withColumns(flags)


def _truth(s: DataFrame, t: DataFrame) -> DataFrame:
    """Pairs of one name and one street word, whatever their country."""
    mine = s.select(F.col("id").alias("s1"), "core_key", "addr_toks")
    return mine.join(t.select(F.col("id").alias("t"), "core_key", "addr_toks"), ["core_key", "addr_toks"]).select("s1", "t")


def _named(s: DataFrame, t: DataFrame) -> tuple[DataFrame, DataFrame]:
    return s.select(F.col("id").alias("s1"), "country"), t.withColumnRenamed("id", "t")


def q_record_stats_s(spark, sf):
    return _rounded(reports.record_stats(*_records(spark, sf))[0], "s_name_rep", "s_name_tdf")


def q_record_stats_t(spark, sf):
    return reports.record_stats(*_records(spark, sf))[1]


def q_candidate_report(spark, sf):
    s, t = _records(spark, sf)
    entities, targets = _named(s, t)
    return _rounded(reports.candidate_report(entities, blocking.build_candidates(s, t), _truth(s, t), targets), "recall")


def q_pass_shares(spark, sf):
    s, t = _records(spark, sf)
    entities, targets = _named(s, t)
    return _rounded(reports.pass_shares(entities, blocking.build_candidates(s, t), _truth(s, t), targets), *reports.PASSES)


def q_ranked_report(spark, sf):
    s, t = _records(spark, sf)
    entities, targets = _named(s, t)
    targets = targets.withColumn("script", F.when(F.col("src") == 3, "indic").otherwise("latin"))
    order = Window.partitionBy("s1").orderBy(F.round("cheap", 6).desc(), "t")
    ranked = blocking.build_candidates(s, t).withColumn("rrank", F.row_number().over(order))
    return _rounded(reports.ranked_report(entities, ranked, _truth(s, t), targets, (1, 5, 10, 20)), "recall", "indic_recall", "full_cover", "oracle_macro_f05", "mean_len")


def q_decoy_features(spark, sf):
    s, t = sides(spark, sf)
    x = features.attach_sides(blocking.build_candidates(s, t).select("s1", "t", F.round("cheap", 3).alias("cheap")), s.select("id", "country", "addr_toks", "addr_nums"), t.select("id", "addr_toks", "addr_nums", "core"))
    # Scores in steps of 1/64 add up to the same sum in any order.
    x = x.select("s1", "t", (F.floor(64 * F.col("cheap") / (1 + F.col("cheap"))) / 64).alias("p"), F.col("s_addr_toks").alias("s_leg"), F.col("t_addr_toks").alias("t_leg"), F.col("s_addr_nums").alias("s_nums"), F.col("t_addr_nums").alias("t_nums"), "t_core")
    out = features.decoy_features(x.withColumn("s_p_sum", F.sum("p").over(Window.partitionBy("s1"))))
    return _rounded(out.drop("s_leg", "t_leg", "s_nums", "t_nums", "t_core"), "num_off", "sup_num_share", "s_num_share")


_TRUE = "tr as (select s.id as s1, t.id as t, s.country, t.src from s join t on s.core_key = t.core_key and s.addr_toks = t.addr_toks)"
_SIZES = "len(string_split(core, ' '))::int as {0}_n_ctok, len(string_split(addr_toks, ' '))::int as {0}_n_atok, 1::int as {0}_n_nums, (addr_nums = '50')::int as {0}_blank"

SQL = {
    "record_stats_s": f"""with {_ENT}, x as (select country, core_key, count(*) filter (src > 1) as tdf, count(*) filter (src = 1) as rep from ent group by all)
      select id as s1, {_SIZES.format("s")}, round(ln(1 + rep), 6) as s_name_rep, round(ln(1 + tdf), 6) as s_name_tdf from s join x using (country, core_key)""",
    "record_stats_t": f"with {_ENT} select id as t, {_SIZES.format('t')}, contains(core, 'b')::int as t_domain, 0::int as t_indic, (src = 3)::int as t_src3, (src <> 2)::int as t_acro from t",
    "candidate_report": f"""with {_CUT}, {_TRUE}, h as (select tr.country, tr.src::varchar as src, 'latin' as script, (t.addr_nums = '50')::varchar as addr_blank, (f_exact is not null)::int as hit
        from tr join t on t.id = tr.t left join cand on cand.s1 = tr.s1 and cand.t = tr.t),
      g as (select 'src' as dimension, country, src as value, hit from h union all select 'script', country, script, hit from h union all select 'addr_blank', country, addr_blank, hit from h)
      select dimension, country, value, round(avg(hit), 6) as recall, count(*) as n from g group by all""",
    "pass_shares": f"""with {_CUT}, {_TRUE} select round(avg((coalesce(f_exact, 0) > 0)::int), 6) as f_exact, round(avg((coalesce(rare_n, 0) > 0)::int), 6) as rare_n, round(avg((coalesce(addr_n, 0) > 0)::int), 6) as addr_n,
      round(avg((coalesce(f_concat, 0) > 0)::int), 6) as f_concat from tr left join cand on cand.s1 = tr.s1 and cand.t = tr.t""",
    "ranked_report": f"""with {_CUT}, {_TRUE}, r as (select s1, t, row_number() over (partition by s1 order by round(cheap, 6) desc, t) as rrank from cand), cuts as (select unnest([1, 5, 10, 20])::int as k),
      p as (select coalesce(r.s1, tr.s1) as s1, rrank, tr.s1 is not null as own, coalesce(tr.src = 3, false) as indic from r full join tr on r.s1 = tr.s1 and r.t = tr.t),
      e as (select s1, k, count(*) filter (own) as n, count(*) filter (indic) as ni, count(*) filter (rrank <= k) as c, count(*) filter (rrank <= k and own) as h, count(*) filter (rrank <= k and indic) as i from p, cuts group by all),
      l as (select s.country, cuts.k, coalesce(n, 0) as n, coalesce(ni, 0) as ni, coalesce(c, 0) as c, coalesce(h, 0) as h, coalesce(i, 0) as i from s cross join cuts left join e on e.s1 = s.id and e.k = cuts.k),
      a as (select * from l union all select '', k, n, ni, c, h, i from l)
      select country, k, round(sum(h) / greatest(sum(n), 1), 6) as recall, round(sum(i) / greatest(sum(ni), 1), 6) as indic_recall, round(avg((h = n)::int) filter (n > 0), 6) as full_cover,
      round(avg(case when n = 0 then 1.0::double else 1.25::double * (h / n) / (0.25::double + h / n) end), 6) as oracle_macro_f05, round(avg(c), 6) as mean_len from a group by country, k""",
    "decoy_features": f"""with {_CUT}, x as (select s1, cand.t, floor(64 * round(cheap, 3) / (1 + round(cheap, 3))) / 64 as p, s.addr_toks <> z.addr_toks as swap, s.addr_nums <> z.addr_nums as off, s.addr_nums::int as a, z.addr_nums::int as b, z.core, z.addr_toks as leg
        from cand join s on s.id = s1 join t z on z.id = cand.t),
      y as (select *, sum(p) over w as total, sum(p) over (partition by s1, b) as mass, sum(p) over (partition by s1, core) as cores, sum(p) over (partition by s1, leg) as legs, coalesce(sum(p) filter (a = b) over w, 0) as own from x window w as (partition by s1))
      select s1, t, p, total as s_p_sum, swap as leg_swap, false as leg_added, false as leg_extra, false as leg_lost, false as leg_drop, off::int as num_s_only, off::int as num_t_only, round(case when off then ln(1 + abs(a - b)) else -1 end, 6) as num_off,
      mass - p as sup_num_p, cores - p as sup_core_p, legs - p as sup_leg_p, round((mass - p) / greatest(total - p, 1e-9), 6) as sup_num_share, mass >= max(mass) over (partition by s1) as t_num_mode, round(own / greatest(total, 1e-9), 6) as s_num_share from y""",
}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "record_stats_s": q_record_stats_s, "record_stats_t": q_record_stats_t, "candidate_report": q_candidate_report, "pass_shares": q_pass_shares, "ranked_report": q_ranked_report, "decoy_features": q_decoy_features,
}
