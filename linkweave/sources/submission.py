"""The output side: both id-list files, read back and checked, and a manifest of what was written."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkweave.sources.tsv import CANDIDATE_COLUMNS, TRUTH_COLUMNS, not_candidates, violations, write_id_lists


@dataclass(frozen=True)
class Report:
    """Outcome of a validation: errors fail it, warnings don't."""

    errors: list[str]
    warnings: list[str]

    @property
    def status(self) -> int:
        return int(bool(self.errors))


def examples(found: DataFrame, most: int = 5) -> list[str]:
    """A line for each rule of (rule, id): how many, and the first ``most`` in order."""
    places = found.groupBy("rule").agg(F.count("*").alias("n"), F.slice(F.array_sort(F.collect_set(F.when(F.col("place") <= most, F.col("id")))), 1, most).alias("ids")) if "place" in found.columns else None
    if places is None:
        ranked = found.selectExpr("*", "row_number() over (partition by rule order by id) as place")
        return examples(ranked, most)
    return [f"{r.rule}: {r.n}, such as {', '.join(r.ids)}" for r in places.orderBy("rule").collect()]


def _first_line(spark: SparkSession, path: str) -> str | None:
    """The header of a file, "" of an empty one, None where there is none."""
    try:
        rows = spark.read.text(path, lineSep="\n").take(1)
    except AnalysisException:
        return None
    return rows[0].value if rows else ""


def match_targets(spark: SparkSession, paths: list[str]) -> tuple[DataFrame | None, list[str]]:
    """Ids (t_id) of all target files, or None and a warning for each that is missing."""
    missing = [p for p in paths if _first_line(spark, p) is None]
    if missing:
        return None, [f"{p}: missing, ids are not checked" for p in missing]
    out = None
    for p in paths:
        first = spark.read.text(p, lineSep="\n").where("value <> '' and value not like 'entity_id\t%'").select(F.split("value", "\t")[0].alias("t_id"))
        out = first if out is None else out.unionByName(first)
    return out, []


def validate_file(spark: SparkSession, path: str, header: list[str], entities: DataFrame, targets: DataFrame | None = None) -> list[str]:
    """Everything wrong with an id-list file, one line for each rule; none if it is sound."""
    head = _first_line(spark, path)
    if head is None:
        return [f"{path}: missing file"]
    if head == "":
        return [f"{path}: empty file"]
    if head != "\t".join(header):
        return [f"{path}: " + ("header is separated by commas" if head == ",".join(header) else f"wrong header {head!r}")]
    return [f"{path}: {x}" for x in examples(violations(spark, path, header, entities, targets))]


def _pairs(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.text(path, lineSep="\n").where(F.col("value").contains("\t")).select(F.split("value", "\t").alias("f"))
    return rows.select(F.col("f")[0].alias("s1_id"), F.explode(F.split(F.col("f")[1], ",")).alias("t_id")).where("t_id <> '' and s1_id <> 'source1_entity_id'")


def validate(spark: SparkSession, matches: str, candidates: str, entities: DataFrame, target_paths: list[str] | None = None) -> Report:
    """Both files against the required entities; ids against the targets where their files are given; matches off the candidates are a warning."""
    targets, warnings = match_targets(spark, target_paths) if target_paths else (None, [])
    errors = validate_file(spark, matches, TRUTH_COLUMNS, entities, targets) + validate_file(spark, candidates, CANDIDATE_COLUMNS, entities, targets)
    if not errors:
        off = not_candidates(_pairs(spark, matches), _pairs(spark, candidates)).count()
        warnings = warnings + [f"{off} matches are not among the candidates"] * bool(off)
    return Report(errors, warnings)


def read_back(spark: SparkSession, path: str, header: list[str], order: DataFrame, targets: DataFrame) -> int:
    """Rows of a written file, which must be sound: no carriage return, the header, every entity once, known ids. Raises else."""
    lines = spark.read.text(path, lineSep="\n")
    returns = lines.where(F.col("value").contains("\r")).count()
    found = validate_file(spark, path, header, order, targets)
    if returns or found:
        raise ValueError(f"{path}: {returns} carriage returns; " + "; ".join(found))
    return lines.count() - 1


def make_submission(spark: SparkSession, folder: str, order: DataFrame, matches: DataFrame, candidates: DataFrame, targets: DataFrame, settings: str = "") -> DataFrame:
    """Write both files below ``folder`` and read them back; returns and writes the manifest (name, value).

    ``order`` is (s1_id, country); matches and candidates are (s1_id, t_id). Matches have to be candidates. The manifest has rows, pairs, a hash
    of the content that doesn't depend on file boundaries, ``settings``, and for each country the mean number of matches and the share of entities without any.
    """
    off = not_candidates(matches, candidates).count()
    if off:
        raise ValueError(f"{off} matches are not among the candidates")
    entries = [("settings", settings)]
    for name, header, pairs in (("matching_results.tsv", TRUTH_COLUMNS, matches), ("candidate_pairs.tsv", CANDIDATE_COLUMNS, candidates)):
        path = f"{folder}/{name}"
        write_id_lists(path, header, order.select("s1_id"), pairs)
        rows = read_back(spark, path, header, order.select("s1_id"), targets)
        digest = spark.read.text(path, lineSep="\n").agg(F.sum(F.conv(F.substring(F.sha2("value", 256), 1, 15), 16, 10).cast("decimal(38,0)"))).first()[0]
        entries += [(f"{name} rows", str(rows)), (f"{name} pairs", str(pairs.distinct().count())), (f"{name} digest", str(digest))]
    counts = order.join(matches.distinct().groupBy("s1_id").agg(F.count("*").alias("n")), "s1_id", "left").na.fill(0, ["n"])
    monitors = counts.groupBy("country").agg(F.round(F.avg("n"), 6).alias("mean"), F.round(F.avg((F.col("n") == 0).cast("int")), 6).alias("none"))
    monitors = monitors.select(F.explode(F.array(F.struct(F.concat_ws(" ", "country", F.lit("matches")).alias("name"), F.col("mean").cast("string").alias("value")), F.struct(F.concat_ws(" ", "country", F.lit("without")).alias("name"), F.col("none").cast("string").alias("value")))).alias("m")).select("m.*")
    manifest = spark.createDataFrame(entries, "name string, value string").unionByName(monitors)
    manifest.write.mode("overwrite").json(f"{folder}/manifest")
    return spark.read.schema("name string, value string").json(f"{folder}/manifest")
