"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from itertools import accumulate
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share. Where the session names none, one process gets a temporary one (tests);
    a cluster is refused, for its executors would not see each other's files."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[[^\]]*\])?", master):
            raise ValueError(f"spark.checkpoint.dir is not set; on {master} it must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="wayfind-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


_places: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()
_runs: list[list[str]] = []


def kept(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: later steps read files, not the lineage."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _places[out] = path
    for run in _runs:
        run.append(path)
    return out


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Delete at the end all tables that ``kept`` makes meanwhile. Results that are lazy are to be written inside:

    with scratch(spark):
        apply_rules(rooms, jobs).write.parquet(path)
    """
    run: list[str] = []
    _runs.append(run)
    try:
        yield
    finally:
        _runs.remove(run)
        for path in run:
            _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def place_of(df: DataFrame) -> str:
    """Where ``kept`` wrote this table."""
    return _places[df]


def read_from(table: DataFrame, df: DataFrame) -> DataFrame:
    """df, which reads nothing but this table of ``kept``: it has the table's place."""
    _places[df] = _places[table]
    return df


def stamp(spark: SparkSession, path: str) -> tuple:
    """Names, sizes and times of the files of a table, so that one that changed under the same path is told apart; () if
    there is none."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(place):
        return ()
    return tuple(sorted((f.getPath().toString(), f.getLen(), f.getModificationTime()) for f in fs.listStatus(place)))


def let_go(spark: SparkSession) -> None:
    """Have Spark delete the shuffle files of finished steps. It does so once the driver collects its garbage, which may be after
    later steps have filled the disk as well."""
    spark.sparkContext._jvm.System.gc()


def bytes_read(df: DataFrame) -> int:
    """Bytes of the files that df reads, so far as Spark knows them; no data is read for it."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = (int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    return sum(n for n in sizes if n < 1 << 60)


def discard(*tables: DataFrame) -> None:
    """Delete tables of ``kept`` of which nothing more will be read."""
    for df in tables:
        _delete(df.sparkSession, _places.pop(df))


def numbered(df: DataFrame, order: list[str], name: str = "seq", parts: int = 0, drop: tuple = ()) -> DataFrame:
    """df with a running number, 1 and up in this order, without a window over all rows.

    The range partitioning is written before its partitions are counted: its bounds are sampled, so a second
    evaluation could deal the rows otherwise. parts: as many partitions at least as the session's setting or this. drop:
    columns that only the order needs.
    """
    n = max(parts, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    placed = kept(df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()).drop(*drop), "numbered")
    part = F.shiftright("_at", 33)
    # as many rows as there are partitions; as a constant they need no join, so Spark still knows the table's size
    counts = dict(placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n")).collect())
    let_go(df.sparkSession)
    ahead = [0, *accumulate(counts.get(i, 0) for i in range(n))]
    return read_from(placed, placed.withColumn(name, F.get(F.lit(ahead).cast("array<bigint>"), part.cast("int")) + F.col("_at").bitwiseAND((1 << 33) - 1) + 1).drop("_at"))
