import math

import pytest

from linkweave.operators.evaluate import f05
from linkweave.operators.reports import candidate_report, pass_shares, ranked_report, record_stats


def test_record_stats(spark):
    kind = "id long, src int, country string, core string, core_key string, addr_toks string, addr_nums string, addr_blank boolean, is_domain boolean, script string, acro_self string"
    s = spark.createDataFrame([(1, 1, "IN", "acme steel", "acme steel", "main st", "5 7", False, False, "latin", ""), (2, 1, "IN", "", "", "", "", True, False, "latin", "")], kind)
    t = spark.createDataFrame([(8, 2, "IN", "acme steel", "acme steel", "", "", True, False, "latin", ""), (9, 3, "IN", "abc", "abc", "main", "5", False, True, "mixed", "abc")], kind)
    mine, theirs = ({r[0]: r for r in x.collect()} for x in record_stats(s, t))
    assert (mine[1].s_n_ctok, mine[1].s_n_atok, mine[1].s_n_nums, mine[1].s_blank) == (2, 2, 2, 0)
    assert mine[1].s_name_tdf == pytest.approx(math.log1p(1)) and mine[1].s_name_rep == pytest.approx(math.log1p(1))
    assert tuple(mine[2])[1:] == (0, 0, 0, 1, 0.0, 0.0)
    assert (theirs[9].t_domain, theirs[9].t_indic, theirs[9].t_src3, theirs[9].t_acro) == (1, 1, 1, 1) and theirs[8].t_blank == 1


def _case(spark):
    entities = spark.createDataFrame([(0, "A"), (1, "A"), (2, "B"), (3, "B")], "s1 long, country string")
    found = spark.createDataFrame([(0, 10, 1, 1, 0, 0, 1), (0, 11, 0, 2, 1, 0, 2), (1, 12, 0, 0, 1, 0, 1), (2, 10, 0, 1, 0, 1, 1)], "s1 long, t long, f_exact int, rare_n long, addr_n long, f_concat int, rrank int")
    truth = spark.createDataFrame([(0, 10), (0, 11), (0, 13), (1, 13)], "s1 long, t long")
    targets = spark.createDataFrame([(10, 2, "latin", False), (11, 3, "indic", False), (12, 2, "latin", True), (13, 3, "latin", True)], "t long, src int, script string, addr_blank boolean")
    return entities, found, truth, targets


def test_candidate_report(spark):
    entities, found, truth, targets = _case(spark)
    out = {(r.dimension, r.country, r.value): (r.recall, r.n) for r in candidate_report(entities, found, truth, targets).collect()}
    assert out[("src", "A", "2")] == (1.0, 1) and out[("src", "A", "3")] == (pytest.approx(1 / 3), 3)
    assert out[("addr_blank", "A", "true")] == (0.0, 2) and out[("script", "A", "indic")] == (1.0, 1)
    shares = pass_shares(entities, found, truth, targets).first()
    assert tuple(shares) == (0.25, 0.5, 0.25, 0.0)


def test_ranked_report(spark):
    entities, found, truth, targets = _case(spark)
    out = {(r.country, r.k): r for r in ranked_report(entities, found, truth, targets, (1, 2)).collect()}
    assert out[("", 1)].recall == 0.25 and out[("", 2)].recall == 0.5 and out[("", 2)].indic_recall == 1.0 and out[("A", 1)].indic_recall == 0.0
    ideal = (f05({10, 11}, {10, 11, 13}) + 0 + 1 + 1) / 4
    assert out[("", 2)].oracle_macro_f05 == pytest.approx(ideal)
    assert out[("", 2)].mean_len == 1.0 and out[("B", 1)].mean_len == 0.5 and out[("A", 2)].full_cover == 0.0 and out[("B", 2)].full_cover is None
    empty = ranked_report(entities, found.where("false"), truth, targets, (1,)).collect()
    assert {r.recall for r in empty} == {0.0}
