import random

import duckdb
import pytest

from linkweave.operators import stack
from linkweave.plans import models, stress, tuning
from linkweave.plans.queries import QUERIES, SQL
from linkweave.sources import submission
from linkweave.sources.tsv import CANDIDATE_COLUMNS, TRUTH_COLUMNS


def test_submission_round_trip(spark, tmp_path):
    order = spark.createDataFrame([("S1-2", "X"), ("S1-10", "Y"), ("S1-1", "X")], "s1_id string, country string")
    candidates = spark.createDataFrame([("S1-1", "S2-9"), ("S1-1", "S2-10"), ("S1-2", "S3-1")], "s1_id string, t_id string")
    targets = spark.createDataFrame([("S2-9",), ("S2-10",), ("S3-1",)], "t_id string")
    matches = candidates.where("t_id <> 'S3-1'")
    folder = f"file://{tmp_path}/out"
    manifest = {r.name: r.value for r in submission.make_submission(spark, folder, order, matches, candidates, targets, "abc").collect()}
    assert manifest["settings"] == "abc" and manifest["matching_results.tsv rows"] == "3" and manifest["candidate_pairs.tsv pairs"] == "3"
    assert (manifest["X matches"], manifest["X without"], manifest["Y without"]) == ("1.0", "0.5", "1.0")
    lines = [r.value for r in spark.read.text(f"{folder}/matching_results.tsv", lineSep="\n").collect()]
    assert lines == ["\t".join(TRUTH_COLUMNS), "S1-1\tS2-10,S2-9", "S1-10\t", "S1-2\t"]
    with pytest.raises(ValueError, match="not among the candidates"):
        submission.make_submission(spark, folder, order, candidates, matches, targets)
    with pytest.raises(ValueError, match="unknown id"):
        submission.read_back(spark, f"{folder}/candidate_pairs.tsv", CANDIDATE_COLUMNS, order.select("s1_id"), targets.where("t_id <> 'S3-1'"))


def test_validator_tells_faults_apart(spark, tmp_path):
    entities = spark.createDataFrame([(f"S1-{i}",) for i in range(1, 9)], "s1_id string")

    def check(name, text):
        (tmp_path / name).write_text(text)
        return submission.validate_file(spark, f"file://{tmp_path}/{name}", TRUTH_COLUMNS, entities)

    head = "\t".join(TRUTH_COLUMNS) + "\n"
    assert "missing file" in submission.validate_file(spark, f"file://{tmp_path}/none.tsv", TRUTH_COLUMNS, entities)[0]
    assert "empty file" in check("empty.tsv", "")[0] and "commas" in check("commas.tsv", ",".join(TRUTH_COLUMNS) + "\n")[0] and "wrong header" in check("head.tsv", "a\tb\n")[0]
    rows = "".join(f"S1-{i}\t\n" for i in range(1, 9))
    assert check("sound.tsv", head + rows) == []
    found = check("bad.tsv", head + "S1-8\tS2-1,S2-1,S1-3,Q\nS1-8\t\nS1-99\t\nnothing\n")
    assert [x.split(": ")[1] for x in found] == ["S1 id as match", "bad prefix", "extra entity", "missing entity", "repeated entity", "repeated id in list", "row without tab"]
    assert "missing entity: 7, such as S1-1, S1-2, S1-3, S1-4, S1-5" in found[3]
    report = submission.validate(spark, f"file://{tmp_path}/sound.tsv", f"file://{tmp_path}/none.tsv", entities, [f"file://{tmp_path}/none2.tsv"])
    assert report.status == 1 and "ids are not checked" in report.warnings[0]


def labelled(spark):
    rng = random.Random(2)
    rows = [(s, t, rng.random(), s % 5) for s in range(400) for t in range(5)]
    return spark.createDataFrame([(s, t, x, int(x + rng.gauss(0, 0.15) > 0.7), f) for s, t, x, f in rows], "s1 long, t long, x double, label int, fold int")


@pytest.mark.parametrize("pipeline", [lambda: models.logistic(["x"], 30), lambda: models.trees(["x"], 4, 2)])
def test_cross_fitted_models_rank_unseen_folds(spark, pipeline):
    rows = labelled(spark)
    got = models.calibrate(models.cross_scores(models.cross_fit(pipeline(), rows, 0.5), rows)).collect()
    assert len(got) == 2000 and all(0 <= r.p <= 1 for r in got)
    for fold in range(5):
        yes, no = ([r.p for r in got if r.fold == fold and r.label == y] for y in (1, 0))
        assert sum(yes) / len(yes) > 0.5 > 0.3 > sum(no) / len(no)
    assert abs(sum(r.p for r in got) / len(got) - sum(r.label for r in got) / len(got)) < 0.05


def test_grid_and_injection(spark):
    rows = labelled(spark).select("s1", "t", "x", "label")
    scores, truth = rows.select("s1", "t", rows.x.alias("p")), rows.where("label = 1").select("s1", "t")
    entities = rows.select("s1").distinct()
    best = tuning.best_threshold(scores, truth, entities, [0.3, 0.7, 0.9], [0.0], reach=0.04)
    assert not best["exclusive"] and 0.66 <= best["tau"] <= 0.86
    both = {r.policy: r.macro_f05 for r in tuning.policy_grid(scores, truth, entities, [{"kind": "eum", "tau": 0.7}, {"kind": "dta"}]).collect()}
    assert set(both) == {"kind=eum,tau=0.7", "kind=dta"} and all(0 <= f <= 1 for f in both.values())
    halved = stress.injection(scores, truth, entities, (0.0, 0.3), rescore=lambda x: x.selectExpr("s1", "t", "p / 2 as p"), policy="eum", tau=0.5)
    assert halved.agg({"n_pred": "sum"}).first()[0] == 0


def test_injection_agrees_with_sql_at_the_bound(spark, tmp_path):
    """Orders whose second quantity is at just 0.8 of the first, where the last bits of p decide."""
    lines = [(k, 2 * k + i, float(q), "R") for k in range(200) for i, q in enumerate((5 * (k % 4 + 7), 4 * (k % 4 + 7)))]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_quantity double, l_returnflag string").coalesce(1).write.parquet(f"file://{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(k, "O", "1") for k in range(200)], "o_orderkey long, o_orderstatus string, o_orderpriority string").coalesce(1).write.parquet(f"file://{tmp_path}/orders.parquet")
    con = duckdb.connect()
    for table in ("lineitem", "orders"):
        con.execute(f"create view {table} as select * from '{tmp_path}/{table}.parquet/*.parquet'")
    want = con.execute(SQL["injection"])
    columns = [d[0] for d in want.description]
    assert sorted(map(tuple, QUERIES["injection"](spark, f"file://{tmp_path}").select(*columns).collect())) == sorted(want.fetchall())


def test_siblings_by_hand(spark):
    rows = [(1, 10, 0.9, 0, "oak dairy", "dairy oak", "elm"), (1, 11, 0.5, 1, "oak dairy", "dairy oak", "elm"), (1, 12, 0.1, 2, "fern", "fern", ""), (2, 10, 0.4, 0, "oak dairy", "dairy oak", "elm")]
    out = stack.siblings(spark.createDataFrame(rows, "s1 long, t long, p double, s_rank int, t_core string, t_core_key string, t_addr_toks string"))
    got = {(r.s1, r.t): (r.sib_p, r.sib_name, r.sib_addr, r.sib_dup) for r in out.collect()}
    assert got[1, 10] == (0.5, 1.0, 1.0, 1) and got[1, 11] == (0.9, 1.0, 1.0, 1) and got[2, 10] == (0.0, 0.0, 0.0, 0)
    assert got[1, 12][0] == 0.9 and got[1, 12][1] < 0.5 and got[1, 12][2:] == (0.0, 0)


def test_every_sql_has_its_query():
    assert set(SQL) <= set(QUERIES)
