"""The driver's queries over the synthetic tables, one for each operator, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .chat import OP7_SQL, op7_preferences
from .decontam import op10_decontamination
from .license import OP3_SQL, op3_license_scan
from .linedup import OP5_SQL, op5_line_dedup
from .mixing import OP6_SQL, op6_mixing
from .pii import op2_pii
from .quality import op8_quality_rules
from .simhash import op1_simhash_near_dedup
from .tokens import op9_token_counts
from .warc import OP4_SQL, op4_warc


def _over(op: Callable[..., DataFrame], *tables: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return op(*[spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables])

    return query


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_simhash_near_dedup": _over(op1_simhash_near_dedup, "documents"),
        "op2_pii": _over(op2_pii, "documents"),
        "op3_license_scan": _over(op3_license_scan, "documents"),
        "op4_warc": _over(op4_warc, "pages"),
        "op5_line_dedup": _over(op5_line_dedup, "documents"),
        "op6_mixing": _over(op6_mixing, "documents"),
        "op7_preferences": _over(op7_preferences, "conversations"),
        "op8_quality_rules": _over(op8_quality_rules, "documents", "labels"),
        "op9_token_counts": _over(op9_token_counts, "documents"),
        "op10_decontamination": _over(op10_decontamination, "documents", "benchmark"),
        "pipeline": pipeline,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_license_scan": OP3_SQL,
        "op4_warc": OP4_SQL,
        "op5_line_dedup": OP5_SQL,
        "op6_mixing": OP6_SQL,
        "op7_preferences": OP7_SQL,
    }
