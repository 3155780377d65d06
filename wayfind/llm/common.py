"""Reading tables and keeping intermediate tables."""

from __future__ import annotations

import re
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfind.sources.kept import discard, kept, shared_folder

__all__ = ["all_columns", "batch_rows", "column", "discard", "documents", "fold", "kept", "labelled_sample", "new_name", "restore_batches", "sampled", "shared_folder", "shuffle_partitions", "small_batches", "table"]


_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def new_name(columns: list[str], name: str) -> str:
    """name, or it with underscores, so that no column is called so (Spark tells no upper from lower case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"{name}_"
    return name


def column(name: str) -> Column:
    """The column of this very name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def all_columns(df: DataFrame) -> list[Column]:
    return [column(c) for c in df.columns]


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fold(doc_id: Column) -> Column:
    """crc32 of the id's decimal text, modulo 3: remainder 1 is held out of training. 0 for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3, F.lit(0))


def sampled(hash64: Column, share: float) -> Column:
    """Whether a hash lies in the first share of the 64-bit range."""
    return hash64 < F.lit(int(share * 2**64) - 2**63)


def labelled_sample(docs: DataFrame, labels: DataFrame, most: int) -> DataFrame:
    """docs joined with (doc_id, label) rows, of which a hash of the id keeps at most about ``most``; so the
    labels are few enough to broadcast and the texts are not shuffled."""
    labels = labels.filter(F.col("label").isNotNull())
    n = labels.count()
    if n > most:
        labels = labels.filter(sampled(F.xxhash64("doc_id"), 0.95 * most / n))
    return docs.join(F.broadcast(labels), "doc_id")


_UNITS = {"": 1, "b": 1, "k": 1 << 10, "kb": 1 << 10, "m": 1 << 20, "mb": 1 << 20, "g": 1 << 30, "gb": 1 << 30, "t": 1 << 40, "tb": 1 << 40, "p": 1 << 50, "pb": 1 << 50}


def byte_size(text: str) -> int:
    """Bytes of a size as Spark writes them: ``64m``, ``4194304b``, ``1 GB``."""
    number, unit = re.fullmatch(r"(-?\d+)\s*([a-z]*)", text.strip().lower()).groups()
    return int(number) * _UNITS[unit]


def small_batches(spark: SparkSession, size: int = 4 << 20) -> str:
    """From now on the session passes at most so many bytes at a time to Python, so that long texts or many of
    them do not add up in the executors' memory. Returns the setting as it was, for ``restore_batches``: results that
    are still to be evaluated need the small one until then. No limit (-1) counts as a large one."""
    before = spark.conf.get(_BATCH)
    old = byte_size(before)
    spark.conf.set(_BATCH, str(min(size, old) if old > 0 else size))
    return before


def restore_batches(spark: SparkSession, before: str) -> None:
    spark.conf.set(_BATCH, before)


@contextmanager
def batch_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """While this lasts, actions pass at most so many rows at a time to Python: for rows that are large."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)
