"""Shared pieces of the training-data operators: intermediate tables and text kernels."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SEED = 42
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir.

    Where that is unset, a session in one JVM (local[...]) gets a folder in its warehouse, which
    its only executor sees; on a cluster it is an error, as no local folder can serve there.
    """
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir is not set: intermediate tables need a folder that all executors share")
        base = f"{spark.conf.get('spark.sql.warehouse.dir')}/checkpoints"
    if base.startswith("file:/") and not base.startswith("file://"):
        base = f"file://{base[5:]}"
    return base.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/linkweave/{label}-{uuid.uuid4().hex}"


_scratch: list[list[tuple[SparkSession, str]]] = []


@contextmanager
def scratch() -> Iterator[None]:
    """Tables written in this block are deleted at its end, but those written with ``keep``."""
    made: list[tuple[SparkSession, str]] = []
    _scratch.append(made)
    try:
        yield
    finally:
        _scratch[:] = [x for x in _scratch if x is not made]
        for spark, path in made:
            remove(spark, path)


def written(df: DataFrame, label: str, keep: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage: the rows survive the loss of any executor, and each consumer
    starts from a table whose size the planner knows. With ``keep``, the table outlives the
    innermost :func:`scratch` block and belongs to the next one, if any.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    if _scratch[: len(_scratch) - keep]:
        _scratch[-1 - keep].append((spark, path))
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def discard(df: DataFrame) -> None:
    """Delete the files of a table made by :func:`written` that nothing reads any more."""
    for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
        remove(df.sparkSession, path)


def ascii_lower(text: Column) -> Column:
    return F.translate(text, _UPPER, _UPPER.lower())


def filled(text: str | Column) -> Column:
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def let(value: Column, body) -> Column:
    """``body`` with ``value`` bound: a lambda that used the expression itself would compute it for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_of(data: bytes | None) -> list[bytes]:
    """Words with A-Z lower-cased; bytes.lower and bytes.split are ASCII-only, as wanted."""
    return data.lower().split() if data else []


def shingle_hashes(words: list[bytes], width: int, lo: int = 0, hi: int | None = None) -> np.ndarray:
    """XXH64 of the space-joined shingles lo..hi; fewer words than ``width`` give one shingle."""
    if not words:
        return np.empty(0, np.uint64)
    total = max(1, len(words) - width + 1)
    hi = total if hi is None else min(hi, total)
    digest, join = xxhash.xxh64_intdigest, b" ".join
    return np.fromiter((digest(join(words[i : i + width]), SEED) for i in range(lo, hi)), np.uint64, hi - lo)


def row_key(text: Column) -> Column:
    """With doc_id, tells rows apart that repeat an id with another text."""
    return F.xxhash64(text)
