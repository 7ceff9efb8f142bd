"""Queries over the synthetic tables, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkweave.functions.normalize import normalize_frame
from linkweave.functions.similarity import indel_udf, jaro_winkler_udf
from linkweave.operators import blocking, decide, evaluate, features, ranker, stack
from linkweave.plans import models, stress, tuning
from linkweave.sources.tsv import id_lists


def entities(spark: SparkSession, sf: str) -> DataFrame:
    """Records made of parts: source 1 is every fourth, sources 2 and 3 the rest."""
    p = spark.read.parquet(f"{sf}/part.parquet")
    k = F.col("p_partkey") % 4
    return p.select(
        F.col("p_partkey").alias("id"), F.when(k == 0, 1).when(k < 3, 2).otherwise(3).alias("src"), F.col("p_type").alias("country"), F.col("p_name").alias("core"),
        F.array_join(F.array_sort(F.array_distinct(F.split("p_name", " "))), " ").alias("core_key"), F.replace("p_name", F.lit(" "), F.lit("")).alias("concat"), F.lit("").alias("domain"),
        F.col("p_size").cast("string").alias("addr_nums"), F.replace(F.lower("p_brand"), F.lit("#"), F.lit(" ")).alias("addr_toks"), F.lit("latin").alias("script"), F.col("p_name").alias("name_sk"),
    )


def sides(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    e = entities(spark, sf)
    return e.where("src = 1"), e.where("src > 1")


def scores(spark: SparkSession, sf: str) -> DataFrame:
    """Scored pairs made of line items."""
    li = spark.read.parquet(f"{sf}/lineitem.parquet")
    return li.groupBy(F.col("l_orderkey").alias("s1"), F.col("l_partkey").alias("t")).agg(F.max(F.col("l_quantity") / 51).alias("p"), F.max((F.col("l_returnflag") == "R").cast("int")).alias("y"))


def truth(spark: SparkSession, sf: str) -> DataFrame:
    return scores(spark, sf).where("y = 1").select("s1", "t")


def _s1(spark, sf):
    return spark.read.parquet(f"{sf}/orders.parquet").select(F.col("o_orderkey").alias("s1"), F.col("o_orderstatus").alias("country"), F.col("o_orderpriority").alias("priority"))


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


_ENT = """ent as (select p_partkey as id, case when p_partkey % 4 = 0 then 1 when p_partkey % 4 < 3 then 2 else 3 end as src, p_type as country, p_name as core,
  array_to_string(list_sort(list_distinct(string_split(p_name, ' '))), ' ') as core_key, replace(p_name, ' ', '') as concat, p_size::varchar as addr_nums,
  replace(lower(p_brand), '#', ' ') as addr_toks from part), s as (select * from ent where src = 1), t as (select * from ent where src > 1)"""
_SCORES = "sc as (select l_orderkey as s1, l_partkey as t, max(l_quantity / 51) as p, max((l_returnflag = 'R')::int) as y from lineitem group by all)"
_KEYS = """
k as (select id, src, country, 'exact' as pass, core_key as key from ent
  union select id, src, country, 'rare', unnest(string_split(core, ' ')) from ent
  union select id, src, country, 'addr', addr_nums || chr(31) || substr(w, 1, 5) from (select *, unnest(string_split(addr_toks, ' ')) as w from ent) where length(w) >= 3
  union select id, src, country, 'concat', substr(concat, 1, 6) from ent where length(concat) >= 5),
b as (select pass, country, key, count(*) as bs from k where src > 1 group by all having count(*) <= case pass when 'rare' then 500 else 300 end),
n as (select country, count(*) as n from t group by all),
m as (select a.id as s1, z.id as t, a.pass, ln(n / bs) as idf from k a join b using (pass, country, key) join k z using (pass, country, key) join n on n.country = a.country where a.src = 1 and z.src > 1),
pairs as (select s1, t, max((pass = 'exact')::int) as f_exact, coalesce(sum(idf) filter (pass = 'rare'), 0) as rare_idf, count(*) filter (pass = 'rare') as rare_n,
  count(*) filter (pass = 'addr') as addr_n, max((pass = 'concat')::int) as f_concat from m group by all)"""


def q_candidates(spark, sf):
    return _rounded(blocking.build_candidates(*sides(spark, sf)), "rare_idf", "cheap")


def q_pass_pairs(spark, sf):
    return _rounded(blocking.pass_pairs(*sides(spark, sf)), "rare_idf")


def q_ranker_union(spark, sf):
    out = blocking.ranker_union(*sides(spark, sf))
    return _rounded(out, *[c for c, k in out.dtypes if k == "double"])


def q_token_idf(spark, sf):
    return _rounded(blocking.token_idf(sides(spark, sf)[1]), "idf")


def q_pair_features(spark, sf):
    s, t = sides(spark, sf)
    rows = features.native_features(features.name_frequencies(features.attach_sides(blocking.build_candidates(s, t).select("s1", "t"), s, t), s, t))
    return _rounded(rows.select("s1", "t", "name_tdf", "name_rep", "name_jac", "name_exact", "addr_jac", "num_match", "num_conflict", "num_near", "concat_lvl"), "name_jac", "addr_jac")


def q_string_features(spark, sf):
    d = spark.read.parquet(f"{sf}/part.parquet").select("p_partkey", F.substring_index("p_name", " ", 1).alias("a"), F.substring_index("p_name", " ", -1).alias("b"))
    return d.select("p_partkey", F.round(jaro_winkler_udf("a", "b"), 6).alias("jw"), F.levenshtein("a", "b").alias("lev"))


def q_indel(spark, sf):
    d = spark.read.parquet(f"{sf}/customer.parquet")
    return d.select("c_custkey", F.round(indel_udf("c_name", "c_mktsegment"), 6).alias("ratio"))


def q_list_context(spark, sf):
    return _rounded(features.list_context(scores(spark, sf), "p"), "cheap_rel", "log_n_cand", "p")


def q_target_context(spark, sf):
    return _rounded(features.target_context(scores(spark, sf).drop("y")), "p", "c_other_max", "c_sum_others", "c_gap")


def q_list_scores(spark, sf):
    return _rounded(features.list_scores(scores(spark, sf).drop("y")), "p", "s_best_other", "s_p_sum", "p1_rel")


def q_source_features(spark, sf):
    return _rounded(features.source_features(scores(spark, sf).drop("y").withColumn("t_src", F.col("t") % 2 + 2)), "p", "src_mass_same", "src_mass_other", "src_gap")


def q_token_df(spark, sf):
    return features.token_df(sides(spark, sf)[1])


def q_vocab_features(spark, sf):
    s, t = sides(spark, sf)
    x = features.attach_sides(blocking.build_candidates(s, t).select("s1", "t"), s.select("id", "country", "core"), t.select("id", "core"))
    return _rounded(features.vocab_features(x, features.token_df(t)), "nw_new_df_min", "nw_new_df_max", "nw_gone_df_min")


def q_competition(spark, sf):
    return _rounded(features.competition(scores(spark, sf)), "t_best")


def q_threshold(spark, sf):
    return decide.threshold_select(scores(spark, sf), 0.5, 0.8)


def q_exclusive(spark, sf):
    return decide.threshold_select(scores(spark, sf), 0.5, 0.0, exclusive=True)


def q_single_owner(spark, sf):
    return _rounded(decide.single_owner(scores(spark, sf)), "p")


def q_hard_owner(spark, sf):
    return _rounded(decide.hard_owner(scores(spark, sf)), "p")


def q_prior_shift(spark, sf):
    return _rounded(decide.prior_shift(scores(spark, sf), 0.6), "p")


def q_expected_f(spark, sf):
    return decide.expected_f_select(scores(spark, sf), 0.1)


def q_policy(spark, sf):
    return decide.apply_policy(scores(spark, sf), "dta_own", missed=0.1, shift=0.6)


def q_folds(spark, sf):
    t = spark.read.parquet(f"{sf}/part.parquet").select(F.col("p_partkey").alias("t"), F.when(F.col("p_partkey") % 5 == 0, "indic").otherwise("latin").alias("script"))
    return evaluate.make_folds(_s1(spark, sf), truth(spark, sf), t)


def q_per_entity(spark, sf):
    return _rounded(evaluate.per_entity(_s1(spark, sf), q_threshold(spark, sf), truth(spark, sf)), "f")


def q_summary(spark, sf):
    out = evaluate.summarize(evaluate.per_entity(_s1(spark, sf), q_threshold(spark, sf), truth(spark, sf)))
    return _rounded(out, *[c for c, k in out.dtypes if k == "double"])


def q_candidate_metrics(spark, sf):
    out = evaluate.candidate_metrics(_s1(spark, sf), scores(spark, sf).where("p > 0.3"), truth(spark, sf))
    return _rounded(out, *[c for c, k in out.dtypes if k == "double"])


def q_strata(spark, sf):
    ent = evaluate.per_entity(_s1(spark, sf), q_threshold(spark, sf), truth(spark, sf)).join(_s1(spark, sf), "s1")
    return _rounded(evaluate.strata_report(ent, ["country", "priority"]), "macro_f05", "loss", "share_of_loss")


def q_reliability(spark, sf):
    return _rounded(evaluate.reliability(scores(spark, sf)), "mean_p", "rate")


def q_id_lists(spark, sf):
    pairs = q_threshold(spark, sf).select(F.concat(F.lit("S1-"), F.col("s1")).alias("s1_id"), F.concat(F.lit("S2-"), F.col("t")).alias("t_id"))
    return id_lists(_s1(spark, sf).select(F.concat(F.lit("S1-"), F.col("s1")).alias("s1_id")), pairs)


def q_injection(spark, sf):
    out = stress.injection(scores(spark, sf).drop("y"), truth(spark, sf), _s1(spark, sf).select("s1"), (0.0, 0.2), policy="eum", tau=0.5, rho=0.8, shifts=(1.0, 0.6))
    return _rounded(out, "f")


def q_policy_eum(spark, sf):
    return decide.apply_policy(scores(spark, sf), "eum", tau=0.5, rho=0.8, shift=0.6).select("s1", "t")


def q_claim_context(spark, sf):
    return _rounded(stack.claim_context(scores(spark, sf).drop("y")), "p", "c_other_max", "c_sum_others", "c_gap")


def q_threshold_grid(spark, sf):
    return _rounded(tuning.threshold_grid(scores(spark, sf).drop("y"), truth(spark, sf), _s1(spark, sf), [0.4, 0.5, 0.7], [0.0, 0.8]), "macro_f05")


def q_ranker_features(spark, sf):
    out = ranker.ranker_features(*sides(spark, sf))
    return _rounded(out.select("s1", "t", "s_n_tok", "t_n_addr", "t_n_num", "t_blank", "t_indic", "t_src3", "name_tdf", "name_rep", "sim_name", "sim_addr", "sim_cont", "sim_num"), "sim_name", "sim_addr", "sim_cont")


def q_ranked(spark, sf):
    """The union cut by a score that SQL can give too, in place of a fitted model."""
    rows = ranker.ranker_features(*sides(spark, sf))
    return ranker.rank_split(rows, lambda x: x.withColumn("p", F.round(F.col("f_exact") + F.col("sim_name") + F.col("sim_addr") / 2, 6)), 5).select("s1", "t", "rk_p", "rrank")


def _stack_input(spark, sf):
    s, t = (x.withColumn("legal", F.lit("")) for x in sides(spark, sf))
    pairs = features.attach_sides(blocking.build_candidates(s, t).select("s1", "t"), s, t)
    return pairs.select("s1", "t", (F.pmod(F.col("s1") * 31 + F.col("t") * 17, F.lit(97)) / 100).alias("p")), pairs, t


def q_stack_features(spark, sf):
    out = stack.build_stack_features(*_stack_input(spark, sf))
    return _rounded(out, *[c for c, k in out.dtypes if k == "double"])


def q_siblings(spark, sf):
    out = stack.build_stack_features(*_stack_input(spark, sf))
    return _rounded(out.select("s1", "t", "p1", "p1_logit", "s_rank", "sib_p", "sib_dup"), "p1", "p1_logit", "sib_p")


#: Records with each kind of noise, and their normal forms: core, legal, domain, script, numbers, words, skeleton.
NORMAL_FORMS = [
    ("Verdé Kitchens of Norwick Inc", "0042 Amber Hollow Lane, Apt 7, West Hill Town", "verde kitchens norwick", "inc", "", "accented", "42 7", "amber hollow ln west hill", "prt ktns nrk"),
    ("Blue Heron Heron Trading Company | https://www.blue-heron.co.in", "18 Rue du Moulin, B.P. 42, Lyon", "blue heron trading", "co", "blueheronco", "latin", "18", "rue moulin lyon", None),
    ("shop.tinsmith.org", "", "", "", "shoptinsmith", "latin", "", "", None),
    ("C0tton M0tors Ltd #10077", "3rd Cross, 21st Main", "cotton motors", "ltd", "", "latin", "3 21", "cross main", None),
    ("M/s Fern & Moss L.L.C. (id: 4471)", "7 Elm Ave, P.O. Box No. 881", "fern moss", "llc", "", "latin", "7", "elm av", None),
    ("<template> नीला सागर", "४क road", "नीला सागर", "", "", "mixed", "4", "rd", "nl skr"),
]


def q_normal_forms(spark, sf):
    """The normal forms of the records above and of all parts' names."""
    fixed = spark.createDataFrame([r[:2] for r in NORMAL_FORMS], "business_name string, business_address string")
    parts = spark.read.parquet(f"{sf}/part.parquet").select(F.col("p_name").alias("business_name"), F.concat(F.lit("00"), F.col("p_partkey"), F.lit("th "), F.col("p_name"), F.lit(" Street, PO Box 9")).alias("business_address"))
    out = normalize_frame(fixed.unionByName(parts))
    return out.select("business_name", "business_address", "core", "legal", "domain", "script", "addr_nums", "addr_toks")


def q_cross_fit(spark, sf):
    pairs = scores(spark, sf).withColumn("n", F.col("t") % 7).withColumn("label", F.col("y")).withColumn("fold", F.col("s1") % 5).withColumnRenamed("p", "x")
    return models.calibrate(models.cross_scores(models.cross_fit(models.logistic(["x", "n"], 20), pairs, 0.5), pairs)).select("s1", "t", F.round("p", 6).alias("p"))


def q_trees(spark, sf):
    pairs = scores(spark, sf).withColumn("n", F.col("t") % 7).withColumn("label", F.col("y")).withColumn("fold", F.col("s1") % 5).withColumnRenamed("p", "x")
    return models.cross_scores(models.cross_fit(models.trees(["x", "n"], 5, 3), pairs, 0.5), pairs).select("s1", "t", F.round("p", 6).alias("p"))


_CUT = f"""{_ENT}, {_KEYS},
c as (select *, row_number() over (partition by s1 order by rare_idf desc, t) as r, row_number() over (partition by s1 order by addr_n desc, t) as a from pairs),
d as (select s1, t, f_exact, case when r <= 25 then rare_idf else 0 end as rare_idf, case when r <= 25 then rare_n else 0 end as rare_n, case when a <= 25 then addr_n else 0 end as addr_n, f_concat from c),
cand as (select *, 2.0 * f_exact + rare_idf / 10 + 0.8 * least(addr_n, 3) + 1.5 * f_concat as cheap from d where f_exact + rare_n + addr_n + f_concat > 0
  qualify row_number() over (partition by s1 order by 2.0 * f_exact + rare_idf / 10 + 0.8 * least(addr_n, 3) + 1.5 * f_concat desc, t) <= 50)"""
_THRESHOLD = f"""{_SCORES}, th as (select s1, t from (select *, max(p) over (partition by s1) as best from sc where p >= 0.5) where p >= 0.8 * best
  qualify row_number() over (partition by s1 order by p desc, t) <= 11)"""
_ENTITY = f"""{_THRESHOLD}, tr as (select s1, t from sc where y = 1),
pe as (select o_orderkey as s1, o_orderstatus as country, o_orderpriority as priority, coalesce(n_true, 0) as n_true, coalesce(n_pred, 0) as n_pred, coalesce(tp, 0) as tp from orders
  left join (select s1, count(*) as n_true from tr group by 1) a on a.s1 = o_orderkey left join (select s1, count(*) as n_pred from th group by 1) b on b.s1 = o_orderkey
  left join (select s1, count(*) as tp from th join tr using (s1, t) group by 1) c on c.s1 = o_orderkey),
pf as (select *, case when n_true = 0 then (n_pred = 0)::int::double when tp = 0 then 0.0 else 1.25 * (tp / n_pred) * (tp / n_true) / (0.25 * (tp / n_pred) + tp / n_true) end as f from pe)"""

_WIDE = """
wk as (select id, src, country, 'exact' as pass, core_key as key from ent
  union select id, src, country, 'rare', unnest(string_split(core, ' ')) from ent
  union select id, src, country, 'addr', addr_nums || chr(31) || substr(w, 1, 5) from (select *, unnest(string_split(addr_toks, ' ')) as w from ent) where length(w) >= 3
  union select id, src, country, 'concat', substr(concat, 1, 6) from ent where length(concat) >= 5
  union select id, src, country, 'a2', w from (select *, unnest(string_split(addr_toks, ' ')) as w from ent) where length(w) >= 3),
wb as (select pass, country, key, count(*) as bs from wk where src > 1 group by all having count(*) <= case when pass in ('exact', 'rare') then 1000 else 300 end),
wn as (select country, count(*) as n from t group by all),
wm as (select a.id as s1, z.id as t, a.pass, bs, ln(n / bs) as idf from wk a join wb using (pass, country, key) join wk z using (pass, country, key) join wn on wn.country = a.country where a.src = 1 and z.src > 1),
wp as (select s1, t, coalesce(max(1) filter (pass = 'exact'), 0) as f_exact, coalesce(sum(idf) filter (pass = 'rare'), 0) as rare_idf, count(*) filter (pass = 'rare') as rare_n, count(*) filter (pass = 'addr') as addr_n,
  coalesce(max(1) filter (pass = 'concat'), 0) as f_concat, coalesce(max(idf) filter (pass = 'rare'), 0) as rare_max, count(*) filter (pass = 'a2') as a2_n, coalesce(sum(idf) filter (pass = 'a2'), 0) as a2_idf, 0 as sk_n, 0.0::double as sk_idf,
  coalesce(min(bs) filter (pass = 'exact'), 0) as exact_bs, coalesce(min(bs) filter (pass = 'addr'), 0) as addr_bs, coalesce(min(bs) filter (pass = 'concat'), 0) as concat_bs from wm group by all)"""
_PAIR_SIMS = """
wx as (select wp.*, s.country, s.core as a, z.core as b, s.core_key as ak, s.addr_toks as aa, z.addr_toks as ba, s.addr_nums as an, z.addr_nums as bn, z.src from wp join s on s.id = s1 join t z on z.id = wp.t),
wf as (select country, core_key, count(*) filter (src > 1) as name_tdf, count(*) filter (src = 1) as name_rep from ent group by all),
ws as (select *, len(list_intersect(string_split(a, ' '), string_split(b, ' '))) / len(list_distinct(string_split(a || ' ' || b, ' '))) as sim_name, len(list_intersect(string_split(aa, ' '), string_split(ba, ' '))) as ov,
  len(list_distinct(string_split(aa || ' ' || ba, ' '))) as un, least(len(list_distinct(string_split(aa, ' '))), len(list_distinct(string_split(ba, ' ')))) as lo from wx)"""
_EUM = """select s1, t from (select *, max(q) over (partition by s1) as best from (select *, case when p = max(p) over (partition by t) then p else 0 end as q from {}) where q >= 0.5) where q >= 0.8 * best
  qualify row_number() over (partition by s1 order by q desc, t) <= 11"""
_SHARE = "('0x' || substr(md5('{}|' || s1), 1, 8))::bigint / 4294967296.0::double"


def _injection_sql() -> str:
    parts = []
    for level in (0.0, 0.2):
        for shift in (1.0, 0.6):
            n = len(parts)
            parts.append(f"""select {level}::double as level, {shift}::double as shift, c.s1, coalesce(n_true, 0) as n_true, coalesce(n_pred, 0) as n_pred, coalesce(tp, 0) as tp from ch c
      left join (select s1, count(*) as n_true from tr group by 1) a using (s1) left join (select s1, count(*) as n_pred from e{n} group by 1) b using (s1) left join (select s1, count(*) as tp from e{n} join tr using (s1, t) group by 1) d using (s1)""")
    ctes = []
    for n, (level, shift) in enumerate((x, y) for x in (0.0, 0.2) for y in (1.0, 0.6)):
        hidden = f"select s1 from en where s1 not in (select s1 from ch) and {_SHARE.format(2034)} < {level}"
        ctes.append(f"l{n} as (select s1, t, {shift} * p / (1 - p) / (1 + {shift} * p / (1 - p)) as p from sc where p > 1e-4 and s1 not in ({hidden})), e{n} as ({_EUM.format(f'l{n}')})")
    f = "case when n_true = 0 then (n_pred = 0)::int::double when tp = 0 then 0.0 else 1.25 * (tp / n_pred) * (tp / n_true) / (0.25 * (tp / n_pred) + tp / n_true) end"
    return f"with {_SCORES}, en as (select o_orderkey as s1 from orders), ch as (select s1 from en where {_SHARE.format(2033)} < 0.3), tr as (select s1, t from sc where y = 1), {', '.join(ctes)}, u as ({' union all '.join(parts)}) select level, shift, s1, n_true, n_pred, tp, round({f}, 6) as f from u"


def _grid_sql() -> str:
    f = "case when n_true = 0 then (n_pred = 0)::int::double when tp = 0 then 0.0 else 1.25 * (tp / n_pred) * (tp / n_true) / (0.25 * (tp / n_pred) + tp / n_true) end"
    return f"""with {_SCORES}, g as (select * from (values (false), (true)) x(exclusive), (values (0.0::double), (0.8::double)) y(rho), (values (0.4::double), (0.5::double), (0.7::double)) z(tau)),
      a as (select sc.*, max(p) over (partition by t) as top from sc), b as (select a.*, g.*, max(p) over (partition by s1, exclusive, rho, tau) as best from a, g where p >= tau and (not exclusive or p = top)),
      c as (select * from b where p >= rho * best qualify row_number() over (partition by s1, exclusive, rho, tau order by p desc, t) <= 11),
      d as (select s1, exclusive, rho, tau, count(*) as n_pred, sum(y) as tp from c group by all), e as (select o_orderkey as s1, coalesce(n_true, 0) as n_true from orders left join (select s1, count(*) as n_true from sc where y = 1 group by 1) q on q.s1 = o_orderkey),
      h as (select g.*, e.n_true, coalesce(d.n_pred, 0) as n_pred, coalesce(d.tp, 0) as tp from e cross join g left join d using (s1, exclusive, rho, tau))
      select exclusive, rho, tau, round(avg({f}), 6) as macro_f05 from h group by all"""


def _normal_sql() -> str:
    quoted = ", ".join("(" + ", ".join("'" + x.replace("'", "''") + "'" for x in r[:8]) + ")" for r in NORMAL_FORMS)
    return f"""select * from (values {quoted}) v(business_name, business_address, core, legal, domain, script, addr_nums, addr_toks)
      union all select p_name, '00' || p_partkey || 'th ' || p_name || ' Street, PO Box 9', lower(p_name), '', '', 'latin', case when p_partkey = 0 then '' else p_partkey::varchar end, lower(p_name) || ' st' from part"""


SQL = {
    "ranker_union": f"""with {_ENT}, {_WIDE} select s1, t, f_exact, round(rare_idf, 6) as rare_idf, rare_n, addr_n, f_concat, round(rare_max, 6) as rare_max, a2_n, round(a2_idf, 6) as a2_idf, sk_n, sk_idf, exact_bs, addr_bs, concat_bs,
      (f_exact > 0)::int + (rare_n > 0)::int + (addr_n > 0)::int + (f_concat > 0)::int + (a2_n > 0)::int as n_pass, count(*) over w as n_union,
      dense_rank() over (partition by s1 order by rare_idf desc) as rk_rare_idf, dense_rank() over (partition by s1 order by addr_n desc) as rk_addr_n, dense_rank() over (partition by s1 order by a2_idf desc) as rk_a2_idf, 1 as rk_sk_idf,
      round(case when max(rare_idf) over w = 0 then 0 else rare_idf / max(rare_idf) over w end, 6) as rel_rare_idf, round(case when max(a2_idf) over w = 0 then 0 else a2_idf / max(a2_idf) over w end, 6) as rel_a2_idf, 0.0::double as rel_sk_idf,
      round(ln(1 + exact_bs), 6) as log_exact_bs, round(ln(1 + addr_bs), 6) as log_addr_bs, round(ln(1 + concat_bs), 6) as log_concat_bs from wp window w as (partition by s1)""",
    "ranker_features": f"""with {_ENT}, {_WIDE}, {_PAIR_SIMS} select s1, ws.t, len(string_split(a, ' ')) as s_n_tok, len(string_split(ba, ' ')) as t_n_addr, 1 as t_n_num, 0 as t_blank, 0 as t_indic, (src = 3)::int as t_src3, coalesce(name_tdf, 0) as name_tdf, coalesce(name_rep, 0) as name_rep,
      round(sim_name, 6) as sim_name, round(ov / un, 6) as sim_addr, round(ov / lo, 6) as sim_cont, (an = bn)::int as sim_num from ws left join wf on wf.country = ws.country and wf.core_key = ak""",
    "rank_split": f"""with {_ENT}, {_WIDE}, {_PAIR_SIMS}, r as (select s1, t, round(f_exact + sim_name + ov / un / 2, 6) as rk_p from ws) select s1, t, rk_p, row_number() over (partition by s1 order by rk_p desc, t) - 1 as rrank from r qualify rrank < 5""",
    "siblings": f"""with {_CUT}, p as (select s1, cand.t, ((s1 * 31 + cand.t * 17) % 97) / 100 as p, z.core_key as k, z.addr_toks as a from cand join t z on z.id = cand.t), r as (select *, row_number() over (partition by s1 order by p desc, t) - 1 as s_rank from p),
      f as (select * from r where s_rank < 2) select r.s1, r.t, round(r.p, 6) as p1, round(ln(greatest(1e-6, least(1 - 1e-6, r.p)) / (1 - greatest(1e-6, least(1 - 1e-6, r.p)))), 6) as p1_logit, r.s_rank, round(coalesce(f.p, 0), 6) as sib_p, coalesce(r.k = f.k and r.a = f.a, false)::int as sib_dup
      from r left join f on f.s1 = r.s1 and f.s_rank = case when r.s_rank = 0 then 1 else 0 end""",
    "policy_eum": f"with {_SCORES}, x as (select s1, t, 0.6 * p / (1 - p) / (1 + 0.6 * p / (1 - p)) as p from sc where p > 1e-4) {_EUM.format('x')}",
    "injection": _injection_sql(),
    "threshold_grid": _grid_sql(),
    "normal_forms": _normal_sql(),
    "candidate_metrics": f"""with {_SCORES}, c as (select s1, t from sc where p > 0.3), tr as (select s1, t from sc where y = 1),
      e as (select o_orderkey as s1, coalesce(n_true, 0) as n_true, coalesce(n_pred, 0) as n_pred, coalesce(tp, 0) as tp from orders left join (select s1, count(*) as n_true from tr group by 1) a on a.s1 = o_orderkey left join (select s1, count(*) as n_pred from c group by 1) b on b.s1 = o_orderkey
        left join (select s1, count(*) as tp from c join tr using (s1, t) group by 1) d on d.s1 = o_orderkey),
      f as (select *, case when n_true = 0 then 1.0 when tp = 0 then 0.0 else 1.25 * tp / n_true / (0.25 + tp / n_true) end as oracle from e)
      select sum(n_true)::bigint as pairs_true, round(sum(tp) / greatest(sum(n_true), 1), 6) as pair_recall, round(avg((tp = n_true)::int) filter (n_true > 0), 6) as s1_full_cover, round(avg(oracle), 6) as oracle_macro_f05, sum(n_pred)::bigint as cand_pairs, round(avg(n_pred), 6) as cand_per_s1_mean,
        quantile_disc(n_pred, 0.9)::double as cand_per_s1_p90, max(n_pred) as cand_per_s1_max from f""",
    "candidates": f"with {_CUT} select s1, t, f_exact, round(rare_idf, 6) as rare_idf, rare_n, addr_n, f_concat, round(cheap, 6) as cheap from cand",
    "pass_pairs": f"with {_ENT}, {_KEYS} select s1, t, f_exact, round(rare_idf, 6) as rare_idf, rare_n, addr_n, f_concat from pairs",
    "token_idf": f"with {_ENT}, {_KEYS} select k.country, key, bs as df, round(ln(n / bs), 6) as idf from b k join n using (country) where pass = 'rare'",
    "string_features": "select p_partkey, round(jaro_winkler_similarity(split_part(p_name, ' ', 1), split_part(p_name, ' ', -1)), 6) as jw, levenshtein(split_part(p_name, ' ', 1), split_part(p_name, ' ', -1))::int as lev from part",
    "pair_features": f"""with {_CUT}, f as (select s1, cand.t, s.core as a, z.core as b, s.core_key as ak, z.core_key as bk, s.addr_toks as aa, z.addr_toks as ba, s.addr_nums as an, z.addr_nums as bn, s.concat as ac, z.concat as bc, s.country as country from cand join s on s.id = s1 join t z on z.id = cand.t),
      x as (select country, core_key, count(*) filter (src > 1) as name_tdf, count(*) filter (src = 1) as name_rep from ent group by all)
      select s1, t, name_tdf, name_rep, round(len(list_intersect(string_split(a, ' '), string_split(b, ' '))) / len(list_distinct(string_split(a || ' ' || b, ' '))), 6) as name_jac, (ak = bk)::int as name_exact,
      round(len(list_intersect(string_split(aa, ' '), string_split(ba, ' '))) / len(list_distinct(string_split(aa || ' ' || ba, ' '))), 6) as addr_jac, (an = bn)::int as num_match, (an <> bn)::int as num_conflict, (levenshtein(an, bn) = 1)::int as num_near,
      list_sum(list_transform([4, 6, 8, 12], lambda n: (length(ac) >= n and length(bc) >= n and substr(ac, 1, n) = substr(bc, 1, n))::int))::int as concat_lvl from f join x on x.country = f.country and x.core_key = f.ak""",
    "list_context": f"with {_SCORES} select s1, t, round(p, 6) as p, y, rank() over w as cheap_rank, round(p / max(p) over (partition by s1), 6) as cheap_rel, round(ln(1 + count(*) over (partition by s1)), 6) as log_n_cand from sc window w as (partition by s1 order by p desc)",
    "target_context": f"""with {_SCORES}, a as (select *, row_number() over (partition by t order by p desc, s1) as k, max(p) over (partition by t) as best, sum(p) over (partition by t) as total, count(*) filter (p > 0.5) over (partition by t) as sure from sc),
      b as (select *, coalesce(max(p) filter (k = 2) over (partition by t), 0) as second from a), c as (select *, case when p >= best then second else best end as o from b)
      select s1, t, round(p, 6) as p, round(o, 6) as c_other_max, round(total - p, 6) as c_sum_others, sure - (p > 0.5)::int as c_n_conf_others, round(p - o, 6) as c_gap from c""",
    "claim_context": f"""with {_SCORES}, a as (select *, row_number() over (partition by t order by p desc, s1) as k, max(p) over (partition by t) as best, sum(p) over (partition by t) as total, count(*) filter (p > 0.5) over (partition by t) as sure from sc),
      b as (select *, coalesce(max(p) filter (k = 2) over (partition by t), 0) as second from a), c as (select *, case when p >= best then second else best end as o from b)
      select s1, t, round(p, 6) as p, round(o, 6) as c_other_max, round(total - p, 6) as c_sum_others, sure - (p > 0.5)::int as c_n_conf_others, round(p - o, 6) as c_gap from c""",
    "list_scores": f"""with {_SCORES}, a as (select *, row_number() over (partition by s1 order by p desc, t) - 1 as s_rank from sc), b as (select *, max(p) over w as top, coalesce(max(p) filter (s_rank = 1) over w, 0) as nxt, sum(p) over w as total, count(*) filter (p > 0.5) over w as sure from a window w as (partition by s1))
      select s1, t, round(p, 6) as p, s_rank, round(case when s_rank = 0 then nxt else top end, 6) as s_best_other, round(total, 6) as s_p_sum, sure as s_n_conf, round(p / top, 6) as p1_rel from b""",
    "source_features": f"""with {_SCORES}, a as (select s1, t, p, t % 2 + 2 as t_src from sc)
      select s1, t, round(p, 6) as p, t_src, round(sum(p) over m - p, 6) as src_mass_same, round(sum(p) over w - sum(p) over m, 6) as src_mass_other, count(*) filter (p > 0.5) over m - (p > 0.5)::int as src_n_conf_same,
      count(*) filter (p > 0.5) over w - count(*) filter (p > 0.5) over m as src_n_conf_other, row_number() over (partition by s1, t_src order by p desc, t) as src_rank, round(p - max(p) over m, 6) as src_gap from a window w as (partition by s1), m as (partition by s1, t_src)""",
    "token_df": f"with {_ENT} select country, tok, count(distinct id) as df from (select id, country, unnest(string_split(core, ' ')) as tok from t) group by all",
    "vocab_features": f"""with {_CUT}, tdf as (select country, tok, count(distinct id) as df from (select id, country, unnest(string_split(core, ' ')) as tok from t) group by all),
      x as (select s1, cand.t, s.country, s.core as s_core, z.core as t_core from cand join s on s.id = s1 join t z on z.id = cand.t),
      w as (select s1, t, country, true as nw, unnest(list_distinct(list_filter(string_split(t_core, ' '), lambda w: not list_contains(string_split(s_core, ' '), w)))) as tok from x
        union all select s1, t, country, false, unnest(list_distinct(list_filter(string_split(s_core, ' '), lambda w: not list_contains(string_split(t_core, ' '), w)))) from x),
      g as (select s1, t, count(*) filter (nw) as a, count(*) filter (not nw) as b, min(ln(1 + coalesce(df, 0))) filter (nw) as c, max(ln(1 + coalesce(df, 0))) filter (nw) as e, min(ln(1 + coalesce(df, 0))) filter (not nw) as f from w left join tdf using (country, tok) group by all)
      select s1, t, country, s_core, t_core, coalesce(a, 0) as nw_n_new, coalesce(b, 0) as nw_n_gone, round(coalesce(c, -1), 6) as nw_new_df_min, round(coalesce(e, -1), 6) as nw_new_df_max, round(coalesce(f, -1), 6) as nw_gone_df_min from x left join g using (s1, t)""",
    "competition": f"with {_SCORES} select t, count(*) as t_n_s1, round(max(p), 6) as t_best from sc group by t",
    "threshold_select": f"with {_THRESHOLD} select s1, t from th",
    "exclusive_select": f"with {_SCORES} select s1, t from (select *, max(p) over (partition by t) as best from sc where p >= 0.5) where p = best qualify row_number() over (partition by s1 order by p desc, t) <= 11",
    "single_owner": f"with {_SCORES}, o as (select *, least(p, 1 - 1e-6) / (1 - least(p, 1 - 1e-6)) as odds from sc) select s1, t, y, round(odds / (1 + sum(odds) over (partition by t)), 6) as p from o",
    "hard_owner": f"with {_SCORES} select s1, t, y, round(case when p = max(p) over (partition by t) then p else 0 end, 6) as p from sc",
    "prior_shift": f"with {_SCORES} select s1, t, y, round(0.6 * p / (1 - p) / (1 + 0.6 * p / (1 - p)), 6) as p from sc",
    "folds": f"""with {_SCORES}, g as (select s1, count(*) as n_true, bool_or(t % 5 = 0) as indic from sc where y = 1 group by 1),
      a as (select o_orderkey as s1, coalesce(n_true, 0) as n_true, o_orderstatus || '|' || case when coalesce(n_true, 0) = 0 then '0' when n_true = 1 then '1' when n_true <= 3 then '2-3' when n_true <= 5 then '4-5' else '6+' end || '|' || coalesce(indic, false) as stratum from orders left join g on g.s1 = o_orderkey)
      select s1, ((row_number() over (partition by stratum order by md5('2026|' || s1), s1) - 1) % 5)::int as fold, stratum, n_true from a""",
    "per_entity": f"with {_ENTITY} select s1, n_true, n_pred, tp, round(f, 6) as f from pf",
    "summary": f"""with {_ENTITY} select count(*) as n_s1, round(avg(f), 6) as macro_f05, round(1.96 * stddev_samp(f) / sqrt(count(*)), 6) as ci95, round(avg((n_pred = 0)::int) filter (n_true = 0), 6) as singleton_acc, sum(n_pred - tp)::bigint as fp_pairs, round(avg((n_pred > tp)::int), 6) as s1_with_fp,
      round(sum(tp) filter (n_true >= 2) / sum(n_true) filter (n_true >= 2), 6) as multi_recall, round(sum(tp) / sum(n_pred), 6) as pair_precision, round(sum(tp) / sum(n_true), 6) as pair_recall, round(avg(n_pred), 6) as mean_pred_len, round(avg(n_true), 6) as mean_true_len from pf""",
    "strata_report": f"""with {_ENTITY}, g as (select 'country' as dimension, country as value, * from pf union all select 'priority', priority, * from pf union all select 'all', '', * from pf)
      select dimension, value, count(*) as n, round(avg(f), 6) as macro_f05, round(sum(1 - f), 6) as loss, round(sum(1 - f) / (select sum(1 - f) from pf), 6) as share_of_loss, sum(n_pred - tp)::bigint as fp, sum(n_true - tp)::bigint as fn from g group by dimension, value""",
    "reliability": f"with {_SCORES} select least(floor(10 * p), 9)::int as decile, round(avg(p), 6) as mean_p, round(avg(y), 6) as rate, count(*) as n from sc group by 1",
    "id_lists": f"with {_THRESHOLD} select 'S1-' || o_orderkey as s1_id, coalesce(string_agg(distinct 'S2-' || t, ',' order by 'S2-' || t), '') as ids from orders left join th on s1 = o_orderkey group by 1",
}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "candidates": q_candidates, "pass_pairs": q_pass_pairs, "ranker_union": q_ranker_union, "token_idf": q_token_idf, "pair_features": q_pair_features, "string_features": q_string_features, "indel_ratio": q_indel,
    "list_context": q_list_context, "target_context": q_target_context, "list_scores": q_list_scores, "source_features": q_source_features, "token_df": q_token_df, "vocab_features": q_vocab_features, "competition": q_competition,
    "threshold_select": q_threshold, "exclusive_select": q_exclusive, "single_owner": q_single_owner, "hard_owner": q_hard_owner, "prior_shift": q_prior_shift, "expected_f_select": q_expected_f, "policy": q_policy,
    "folds": q_folds, "per_entity": q_per_entity, "summary": q_summary, "candidate_metrics": q_candidate_metrics, "strata_report": q_strata, "reliability": q_reliability, "id_lists": q_id_lists, "injection": q_injection,
    "cross_fit": q_cross_fit, "boosted_trees": q_trees, "policy_eum": q_policy_eum, "claim_context": q_claim_context, "threshold_grid": q_threshold_grid, "ranker_features": q_ranker_features,
    "rank_split": q_ranked, "stack_features": q_stack_features, "siblings": q_siblings, "normal_forms": q_normal_forms,
}
