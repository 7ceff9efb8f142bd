"""Strict tab-separated sources and sinks: no quoting, every field a string, violations raise or are reported."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SOURCE_COLUMNS = ["entity_id", "business_name", "business_address", "country"]
TRUTH_COLUMNS = ["source1_entity_id", "matched_entity_ids"]
CANDIDATE_COLUMNS = ["source1_entity_id", "candidate_entity_ids"]
_PLAIN = {"sep": "\t", "quote": "", "escape": "", "lineSep": "\n", "header": True}


def source_path(folder: str, split: str, n: int) -> str:
    return f"{folder}/{split}/{split}_source{n}.tsv"


def read_tsv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """All strings, missing is empty; a header other than ``columns`` or a row of another width fails."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    return spark.read.csv(path, schema=schema, enforceSchema=False, mode="FAILFAST", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, **_PLAIN).na.fill("")


def count_data_lines(spark: SparkSession, path: str) -> int:
    """Lines after the header, an unterminated last one included."""
    return spark.read.text(path, lineSep="\n").count() - 1


def read_source(spark: SparkSession, path: str, n: int) -> DataFrame:
    """Source ``n``, checked: as many rows as lines, unique ids, ids that start with S<n>-."""
    df = read_tsv(spark, path, SOURCE_COLUMNS)
    rows, ids, foreign = df.agg(F.count("*"), F.count_distinct("entity_id"), F.count_if(~F.col("entity_id").startswith(f"S{n}-"))).first()
    lines = count_data_lines(spark, path)
    if rows != lines or ids != rows or foreign:
        raise ValueError(f"{path}: {rows} rows of {lines} lines, {ids} distinct ids, {foreign} ids of another source")
    return df


def read_ground_truth(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(s1_id) of every row and (s1_id, t_id) of every match; repeated entities or matches raise."""
    df = read_tsv(spark, path, TRUTH_COLUMNS)
    pairs = df.select(F.col("source1_entity_id").alias("s1_id"), F.explode(F.split("matched_entity_ids", ",")).alias("t_id")).where("t_id <> ''")
    rows, ids = df.agg(F.count("*"), F.count_distinct("source1_entity_id")).first()
    n, distinct = pairs.agg(F.count("*"), F.count_distinct("s1_id", "t_id")).first()
    lines = count_data_lines(spark, path)
    if rows != lines:
        raise ValueError(f"{path}: {rows} rows of {lines} lines")
    if rows != ids or n != distinct:
        raise ValueError(f"{path}: {rows - ids} repeated entities, {n - distinct} repeated matches")
    return df.select(F.col("source1_entity_id").alias("s1_id")), pairs


def id_lists(order: DataFrame, pairs: DataFrame) -> DataFrame:
    """(s1_id, ids): each entity of ``order`` with its distinct targets, sorted as strings and joined by commas."""
    lists = pairs.groupBy("s1_id").agg(F.array_join(F.array_sort(F.collect_set("t_id")), ",").alias("ids"))
    return order.join(lists, "s1_id", "left").withColumn("ids", F.coalesce("ids", F.lit("")))


def write_id_lists(path: str, header: list[str], order: DataFrame, pairs: DataFrame, position: str | None = None) -> None:
    """A TSV folder of one file, in the order of ``position``, or of s1_id."""
    out = id_lists(order, pairs).orderBy(position or "s1_id").select(F.col("s1_id").alias(header[0]), F.col("ids").alias(header[1]))
    out.coalesce(1).write.mode("overwrite").csv(path, emptyValue="", nullValue="", **_PLAIN)


def violations(spark: SparkSession, path: str, header: list[str], entities: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    """(rule, id) of everything wrong with an id-list file; empty if it is sound.

    Rules: wrong header, row without tab, repeated entity, repeated id in a list, an S1 id as match,
    an id with another prefix, an unknown id (given ``targets``), missing and extra entities.
    """
    lines = spark.read.text(path, lineSep="\n")
    head, want = "\t".join(header), lit_rule
    body = lines.where(F.col("value") != head)
    rows = body.where(F.col("value").contains("\t")).select(F.split("value", "\t").alias("f")).select(F.get("f", F.lit(0)).alias("s1_id"), F.coalesce(F.get("f", F.lit(1)), F.lit("")).alias("ids"))
    ids = rows.select("s1_id", F.explode(F.split("ids", ",")).alias("t_id")).where("t_id <> ''")
    found = [
        want("row without tab", body.where(~F.col("value").contains("\t")), "value"),
        want("repeated entity", rows.groupBy("s1_id").count().where("count > 1"), "s1_id"),
        want("repeated id in list", ids.groupBy("s1_id", "t_id").count().where("count > 1"), "t_id"),
        want("S1 id as match", ids.where("t_id like 'S1-%'"), "t_id"),
        want("bad prefix", ids.where("not t_id rlike '^S[123]-'"), "t_id"),
        want("missing entity", entities.join(rows, "s1_id", "left_anti"), "s1_id"),
        want("extra entity", rows.join(entities, "s1_id", "left_anti"), "s1_id"),
    ]
    if not lines.where(F.col("value") == head).take(1):
        found.append(spark.createDataFrame([("wrong header", head)], "rule string, id string"))
    if targets is not None:
        known = targets.select("t_id").distinct()
        found.append(want("unknown id", ids.where("t_id rlike '^S[23]-'").join(known, "t_id", "left_anti"), "t_id"))
    out = found[0]
    for df in found[1:]:
        out = out.unionByName(df)
    return out.distinct()


def lit_rule(rule: str, df: DataFrame, column: str) -> DataFrame:
    return df.select(F.lit(rule).alias("rule"), F.col(column).alias("id"))


def not_candidates(matches: DataFrame, candidates: DataFrame) -> DataFrame:
    """Matches (s1_id, t_id) that are not among the candidates: a warning of the validator."""
    return matches.join(candidates, ["s1_id", "t_id"], "left_anti")
