"""Sharding along a Hilbert curve, in DataFrame operations only.

Metadata columns are quantised to a few bits each; the Hilbert index of the cell puts rows that are close in
every dimension close in order. The order (index, then tie-breaking columns) is cut into runs of equal row
counts, so each shard holds a compact region and files can be pruned on several columns at once. A range
partitioning and the position in each partition give every row its global rank; only the partitions' counts
are gathered, so no window spans the table.

Defined cases: null metadata takes cell 0 and null texts size 1; null ids come first among ties; ties are broken by
the columns named last, repeated rows take neighbouring slots; an empty table gives no rows; columns other than those
named are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfind.llm.common import discard, kept, shuffle_partitions

BITS = 6


def quantised(df: DataFrame, key: Column, bits: int = BITS) -> Column:
    """A number's cell. Cells follow the order and, as far as the numbers differ, hold equally many rows of df; a
    frequent number takes the last of the cells that are its share."""
    shares = [k / (1 << bits) for k in range(1, 1 << bits)]
    bounds = df.agg(F.percentile_approx(key.cast("long"), shares, 2000)).first()[0] or []
    cell = F.size(F.filter(F.array(*map(F.lit, bounds)).cast("array<bigint>"), lambda b: b <= key))
    return F.when(key.isNull(), 0).otherwise(cell).cast("int")


def text_bounds(df: DataFrame, name: str, bits: int = BITS) -> list[tuple[str, int]]:
    """(least text, cell) of the cells above 0 that hold a value, at most 2 ** bits: whole values, each counted with its rows.

    A distinct value is one row here, whatever its frequency. They are put in order by a range partitioning, and a value
    is a bound where the rows up to it pass a cell's share; only partitions' totals and the bounds are gathered.
    """
    n, cells = shuffle_partitions(df.sparkSession), 1 << bits
    counts = df.filter(F.col(name).isNotNull()).groupBy(F.col(name).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    placed = kept(counts.repartitionByRange(n, "value").withColumn("part", F.spark_partition_id()), "values")
    # as many rows as there are partitions
    of_part = placed.groupBy("part").agg(F.sum("n").alias("_n"))
    ahead = of_part.select("part", (F.sum("_n").over(Window.orderBy("part")) - F.col("_n")).alias("ahead"), F.sum("_n").over(Window.partitionBy()).alias("total"))
    upto = F.col("ahead") + F.sum("n").over(Window.partitionBy("part").orderBy("value"))
    share = placed.join(F.broadcast(ahead), "part").select("value", "total", upto.alias("upto"), (upto - F.col("n")).alias("before"))
    passed = share.select("value", F.expr(f"(upto * {cells}) div total").alias("cell"), F.expr(f"(before * {cells}) div total").alias("cell_before"))
    found = passed.filter("cell > cell_before").select("value", F.least("cell", F.lit(cells - 1)).cast("int").alias("cell")).collect()
    discard(placed)
    return sorted(map(tuple, found), key=lambda r: r[0].encode())


def quantised_text(df: DataFrame, name: str, bits: int = BITS) -> Column:
    """A text's cell, in byte order. Values that begin alike are told apart at any length; a frequent value takes the last of
    the cells that are its share."""
    bounds = text_bounds(df, name, bits)
    known = F.array(*(F.struct(F.lit(v).alias("value"), F.lit(c).alias("cell")) for v, c in bounds)).cast("array<struct<value:string,cell:int>>")
    cell = F.array_max(F.transform(F.filter(known, lambda b: b["value"] <= F.col(name)), lambda b: b["cell"]))
    return F.coalesce(cell, F.lit(0))


def hilbert_index(cells: list[Column], bits: int = BITS) -> Column:
    """Index on the Hilbert curve of the cell with these coordinates, each below 2 ** bits.

    The usual transposed form: undo the excess rotation bit by bit, Gray-encode, then interleave the bits.
    """
    n = len(cells)
    if n * bits > 62:
        raise ValueError("the index must fit 62 bits")
    steps = F.array(*(F.struct(F.lit(1 << b).alias("q"), F.lit(i).alias("i")) for b in range(bits - 1, 0, -1) for i in range(n)))

    def turn(x: Column, step: Column) -> Column:
        q, i = step["q"], step["i"]
        p = q - 1
        own, head = F.get(x, i), F.get(x, F.lit(0))
        swap = F.when(own.bitwiseAND(q) != 0, F.lit(0)).otherwise(head.bitwiseXOR(own).bitwiseAND(p))
        flip = F.when(own.bitwiseAND(q) != 0, p).otherwise(F.lit(0))
        return F.transform(x, lambda v, k: v.bitwiseXOR(F.when(k == 0, flip.bitwiseXOR(F.when(i == 0, F.lit(0)).otherwise(swap))).when(k == i, swap).otherwise(F.lit(0))))

    turned = F.aggregate(steps, F.array(*cells), turn)
    lasts = F.array(*(F.lit(1 << b) for b in range(bits - 1, 0, -1)))

    def rest(g: Column) -> Column:
        t = F.aggregate(lasts, F.lit(0), lambda a, q: F.when(F.get(g, F.lit(n - 1)).bitwiseAND(q) != 0, a.bitwiseXOR(q - 1)).otherwise(a))
        return F.transform(g, lambda v: v.bitwiseXOR(t))

    order = F.array(*(F.struct(F.lit(1 << b).alias("q"), F.lit(i).alias("i")) for b in range(bits - 1, -1, -1) for i in range(n)))
    # Gray code: every coordinate takes in those before it. One-element arrays bind the intermediate values, so that none is computed twice
    gray = F.get(F.transform(F.array(turned), lambda x: F.transform(x, lambda v, k: F.aggregate(F.slice(x, F.lit(1), k + 1), F.lit(0), lambda a, y: a.bitwiseXOR(y)))), F.lit(0))
    final = F.get(F.transform(F.array(gray), rest), F.lit(0))
    return F.get(F.transform(F.array(final), lambda x: F.aggregate(order, F.lit(0).cast("long"), lambda a, s: a * 2 + F.when(F.get(x, s["i"]).bitwiseAND(s["q"]) != 0, F.lit(1)).otherwise(F.lit(0)))), F.lit(0))


def ranked(df: DataFrame, order: list[str]) -> DataFrame:
    """df with rank (0, 1, ... in this order) and total, the number of rows."""
    n = shuffle_partitions(df.sparkSession)
    placed = kept(df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "ranked")
    part = F.shiftright("_at", 33).alias("_part")
    counts = placed.groupBy(part).agg(F.count(F.lit(1)).alias("_n"))
    # as many rows as there are partitions
    ahead = counts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_ahead"), F.sum("_n").over(Window.partitionBy()).alias("total"))
    joined = placed.withColumn("_part", part).join(F.broadcast(ahead), "_part")
    return joined.withColumn("rank", F.col("_ahead") + F.col("_at").bitwiseAND((1 << 33) - 1)).drop("_part", "_at", "_ahead")


def equal_runs(df: DataFrame, order: list[str], shards: int) -> DataFrame:
    """df with shard and slot: runs of the order whose lengths differ by one at most."""
    found = ranked(df, order)
    shard = F.expr(f"(rank * {shards}) div total")
    return found.withColumn("shard", shard.cast("int")).withColumn("slot", F.col("rank") - F.expr(f"(shard * total + {shards - 1}) div {shards}")).drop("rank", "total")


def shard_documents(docs: DataFrame, shards: int = 16, bits: int = BITS) -> DataFrame:
    """Documents by language, source and size along the curve; equal texts follow each other within a cell."""
    slim = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
        F.col("lang").cast("string").alias("lang"),
        F.col("source").cast("string").alias("source"),
    )
    slim = kept(slim, "shard-metadata")
    cells = [F.col("cell_lang"), F.col("cell_source"), F.col("cell_size")]
    placed = slim.withColumns({"cell_lang": quantised_text(slim, "lang", bits), "cell_source": quantised_text(slim, "source", bits), "cell_size": quantised(slim, F.col("size"), bits)})
    placed = placed.withColumn("curve", hilbert_index(cells, bits))
    return equal_runs(placed, ["curve", "text_crc32", "doc_id"], shards)


def write_shards(rows: DataFrame, path: str, files: int | None = None) -> None:
    """One folder for each shard, its rows in curve order, so that statistics of files and row groups prune.

    Ranges of shard and slot are dealt to so many tasks (as many as the session shuffles with, unless said), so a shard of any
    size is written as several files of consecutive slots, and no task holds a whole one.
    """
    n = files or shuffle_partitions(rows.sparkSession)
    rows.repartitionByRange(n, "shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def extents(rows: DataFrame, columns: list[str]) -> DataFrame:
    """The range of each column in each shard: what a reader can prune by."""
    return rows.groupBy("shard").agg(F.count(F.lit(1)).alias("n"), *(f(c).alias(f"{f.__name__}_{c}") for c in columns for f in (F.min, F.max)))
