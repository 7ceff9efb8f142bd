"""Pair features and group context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkweave.functions.similarity import containment, first_number, indel_udf, jaccard, jaro_winkler_udf, partial_udf, prefix_levels, token_set_udf, tokens


def name_frequencies(pairs: DataFrame, s: DataFrame, t: DataFrame) -> DataFrame:
    """``pairs`` with name_tdf and name_rep: targets and entities of the country that share s_core_key."""
    count = lambda df, name: df.where("core_key <> ''").groupBy("country", "core_key").agg(F.count("*").alias(name)).withColumnRenamed("core_key", "s_core_key")
    out = pairs.join(count(t, "name_tdf"), ["country", "s_core_key"], "left").join(count(s, "name_rep"), ["country", "s_core_key"], "left")
    return out.na.fill(0, ["name_tdf", "name_rep"])


def competition(scores: DataFrame) -> DataFrame:
    """(t, t_n_s1, t_best): how many entities list a target, and the best score among them."""
    return scores.groupBy("t").agg(F.count("*").alias("t_n_s1"), F.max("p").alias("t_best"))


def list_context(pairs: DataFrame, score: str = "cheap") -> DataFrame:
    w = Window.partitionBy("s1")
    return pairs.withColumns({
        "cheap_rank": F.rank().over(w.orderBy(F.col(score).desc())),
        "cheap_rel": F.coalesce(F.try_divide(F.col(score), F.max(score).over(w)), F.lit(0.0)),
        "log_n_cand": F.log1p(F.count("*").over(w)),
    })


def attach_sides(pairs: DataFrame, s: DataFrame, t: DataFrame) -> DataFrame:
    """``pairs`` (s1, t, ...) with the columns of both records, as s_* and t_*, and country."""
    left = s.select(F.col("id").alias("s1"), "country", *[F.col(c).alias(f"s_{c}") for c in s.columns if c not in ("id", "country")])
    right = t.select(F.col("id").alias("t"), *[F.col(c).alias(f"t_{c}") for c in t.columns if c not in ("id", "country")])
    return pairs.join(left, "s1").join(right, "t")


def _flag(c: Column) -> Column:
    return F.coalesce(c, F.lit(False)).cast("int")


def native_features(pairs: DataFrame) -> DataFrame:
    """The features that need no Python: sets, prefixes, numbers, flags."""
    s, t = (lambda c: tokens(f"s_{c}")), (lambda c: tokens(f"t_{c}"))
    both = lambda a, b: (F.size(a) > 0) & (F.size(b) > 0)
    out = {
        "name_jac": jaccard(s("core"), t("core")),
        "name_exact": _flag((F.col("s_core_key") == F.col("t_core_key")) & (F.col("s_core_key") != "")),
        "addr_jac": jaccard(s("addr_toks"), t("addr_toks")),
        "addr_cont": containment(s("addr_toks"), t("addr_toks")),
        "num_match": _flag(F.arrays_overlap(s("addr_nums"), t("addr_nums"))),
        "num_conflict": _flag(both(s("addr_nums"), t("addr_nums")) & ~F.arrays_overlap(s("addr_nums"), t("addr_nums"))),
        "num_first_eq": _flag(F.get(s("addr_nums"), F.lit(0)) == F.get(t("addr_nums"), F.lit(0))),
        "num_near": _flag(F.levenshtein(F.get(s("addr_nums"), F.lit(0)), F.get(t("addr_nums"), F.lit(0))) == 1),
    }
    a, b = F.get(s("addr_nums"), F.lit(0)), F.get(t("addr_nums"), F.lit(0))
    out["num_suffix"] = _flag((a != b) & (a.endswith(b) | b.endswith(a)))
    if "s_concat" in pairs.columns:
        out["concat_lvl"] = F.greatest(prefix_levels(F.col("s_concat"), F.col("t_concat")), prefix_levels(F.col("s_concat"), F.col("t_domain")))
    if "s_legal" in pairs.columns:
        out["legal_match"] = _flag(F.arrays_overlap(s("legal"), t("legal")))
        out["legal_conflict"] = _flag(both(s("legal"), t("legal")) & ~F.arrays_overlap(s("legal"), t("legal")))
    if "s_initials" in pairs.columns:
        out["acro"] = _flag((F.col("t_acro_self") != "") & (F.col("t_acro_self") == F.col("s_initials")))
    return pairs.withColumns(out)


def string_features(pairs: DataFrame) -> DataFrame:
    """Indel, token-set, partial and Jaro-Winkler similarities, between 0 and 1, in Arrow batches."""
    of = lambda f, c: f(F.col(f"s_{c}"), F.col(f"t_{c}"))
    return pairs.withColumns({
        "name_ratio": of(indel_udf, "core") / 100, "name_tset": of(token_set_udf, "core") / 100, "name_pratio": of(partial_udf, "core") / 100,
        "name_jw": of(jaro_winkler_udf, "core"), "addr_tset": of(token_set_udf, "addr_toks") / 100, "addr_ratio": of(indel_udf, "addr_toks") / 100,
    })


# ---------------------------------------------------------------- second level: scores in context


def target_context(scores: DataFrame) -> DataFrame:
    """(s1, t, p) with what the other claims on t say; one shuffle by t."""
    w = Window.partitionBy("t")
    order = w.orderBy(F.col("p").desc(), "s1")
    best, second = F.max("p").over(w), F.max(F.when(F.col("__place") == 2, F.col("p"))).over(w)
    out = scores.withColumn("__place", F.row_number().over(order))
    return out.withColumns({
        "c_other_max": F.when(F.col("p") >= best, F.coalesce(second, F.lit(0.0))).otherwise(best),
        "c_sum_others": F.sum("p").over(w) - F.col("p"),
        "c_n_conf_others": F.count_if(F.col("p") > 0.5).over(w) - (F.col("p") > 0.5).cast("int"),
    }).withColumn("c_gap", F.col("p") - F.col("c_other_max")).drop("__place")


def list_scores(scores: DataFrame) -> DataFrame:
    """What the rest of an entity's list says; one shuffle by s1."""
    w = Window.partitionBy("s1")
    place = F.row_number().over(w.orderBy(F.col("p").desc(), "t"))
    out = scores.withColumn("s_rank", place - 1)
    top, next_ = F.max("p").over(w), F.max(F.when(F.col("s_rank") == 1, F.col("p"))).over(w)
    return out.withColumns({
        "s_best_other": F.when(F.col("s_rank") == 0, F.coalesce(next_, F.lit(0.0))).otherwise(top),
        "s_p_sum": F.sum("p").over(w), "s_n_conf": F.count_if(F.col("p") > 0.5).over(w),
        "p1_rel": F.coalesce(F.try_divide(F.col("p"), top), F.lit(0.0)),
    })


def decoy_features(x: DataFrame) -> DataFrame:
    """Legal-form swaps, one-sided numbers and the list's consensus on t's numbers, core and forms.

    Needs s1, t, p, s_leg, t_leg, s_nums, t_nums, t_core and s_p_sum.
    """
    plain = lambda c: F.array_except(tokens(c), F.array(F.lit("group"), F.lit("co")))
    s_leg, t_leg, s_num, t_num = plain("s_leg"), plain("t_leg"), tokens("s_nums"), tokens("t_nums")
    gone, new = F.size(F.array_except(s_leg, t_leg)) > 0, F.size(F.array_except(t_leg, s_leg)) > 0
    has_s, has_t = F.size(s_leg) > 0, F.size(t_leg) > 0
    s_only, t_only = F.array_except(s_num, t_num), F.array_except(t_num, s_num)
    first = lambda a: F.get(a, F.lit(0)).try_cast("double")
    out = x.withColumn("__n", first_number(F.col("t_nums"))).withColumn("__own", first_number(F.col("s_nums")))
    mass = lambda *keys: F.sum("p").over(Window.partitionBy("s1", *keys)) - F.col("p")
    rest = F.greatest(F.col("s_p_sum") - F.col("p"), F.lit(1e-9))
    every = Window.partitionBy("s1")
    out = out.withColumns({
        "leg_swap": gone & new, "leg_added": ~has_s & has_t, "leg_extra": has_s & new & ~gone, "leg_lost": has_s & ~has_t, "leg_drop": has_t & gone & ~new,
        "num_s_only": F.size(s_only), "num_t_only": F.size(t_only),
        "num_off": F.coalesce(F.log1p(F.abs(first(s_only) - first(t_only))), F.lit(-1.0)),
        "sup_num_p": F.when(F.col("__n").isNull(), 0.0).otherwise(mass("__n")), "sup_core_p": F.when(F.col("t_core") == "", 0.0).otherwise(mass("t_core")),
        "sup_leg_p": mass("t_leg"), "__mass": F.when(F.col("__n").isNotNull(), F.sum("p").over(Window.partitionBy("s1", "__n"))),
    })
    own = F.sum(F.when(F.col("__n") == F.col("__own"), F.col("p")).otherwise(0.0)).over(every)
    return out.withColumns({
        "sup_num_share": F.col("sup_num_p") / rest,
        "t_num_mode": F.coalesce(F.col("__mass") >= F.max("__mass").over(every), F.lit(False)),
        "s_num_share": own / F.greatest(F.col("s_p_sum"), F.lit(1e-9)),
    }).drop("__n", "__own", "__mass")


def source_features(x: DataFrame) -> DataFrame:
    """Mass, confident claims, rank and gap within and outside the source of t (t_src)."""
    all_, same = Window.partitionBy("s1"), Window.partitionBy("s1", "t_src")
    sure = F.count_if(F.col("p") > 0.5)
    mine = (F.col("p") > 0.5).cast("int")
    return x.withColumns({
        "src_mass_same": F.sum("p").over(same) - F.col("p"), "src_mass_other": F.sum("p").over(all_) - F.sum("p").over(same),
        "src_n_conf_same": sure.over(same) - mine, "src_n_conf_other": sure.over(all_) - sure.over(same),
        "src_rank": F.row_number().over(same.orderBy(F.col("p").desc(), "t")), "src_gap": F.col("p") - F.max("p").over(same),
    })


def token_df(targets: DataFrame) -> DataFrame:
    """(country, tok, df): targets of a country with a name token."""
    return targets.select("country", F.explode(F.array_distinct(tokens("core"))).alias("tok")).groupBy("country", "tok").agg(F.count("*").alias("df"))


def vocab_features(x: DataFrame, df: DataFrame) -> DataFrame:
    """Name words new in t and gone from s1, and their log frequencies; -1 where there are none. Needs s1, t, country, s_core, t_core."""
    new, gone = F.array_except(tokens("t_core"), tokens("s_core")), F.array_except(tokens("s_core"), tokens("t_core"))
    words = x.select("s1", "t", "country", F.explode(F.concat(F.transform(new, lambda w: F.struct(F.lit(True).alias("new"), w.alias("tok"))), F.transform(gone, lambda w: F.struct(F.lit(False).alias("new"), w.alias("tok"))))).alias("w"))
    rare = words.select("s1", "t", "country", "w.new", "w.tok").join(df, ["country", "tok"], "left").withColumn("l", F.log1p(F.coalesce("df", F.lit(0))))
    of = lambda flag: F.when(F.col("new") == flag, F.col("l"))
    stats = rare.groupBy("s1", "t").agg(F.count(of(True)).alias("nw_n_new"), F.count(of(False)).alias("nw_n_gone"), F.min(of(True)).alias("nw_new_df_min"), F.max(of(True)).alias("nw_new_df_max"), F.min(of(False)).alias("nw_gone_df_min"))
    return x.join(stats, ["s1", "t"], "left").na.fill(0, ["nw_n_new", "nw_n_gone"]).na.fill(-1.0, ["nw_new_df_min", "nw_new_df_max", "nw_gone_df_min"])
