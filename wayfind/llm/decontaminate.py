"""Benchmark decontamination by size-partitioned MinHash containment search, in DataFrame operations only.

An item is contained in a document if the document has at least ``LEAST`` of the item's distinct k-word
shingles (k is 5; a shorter item is one shingle of its own length). Items are partitioned by the size of their
shingle sets, each partition up to twice the size of the one before. A partition's items are indexed by their
bottom-m MinHash sketches: an item of n shingles may lack n - ceil(LEAST * n) of them, so with one more a document
that contains it, however long, has one of its sketch, and with j more hashes it has j more. ``hits_needed`` gives
each partition its number: larger items must be hit several times, so a phrase that they share with a document makes no
candidate. ``sketch_length`` gives the longest sketch of a partition. The order of hashes is the same for all items and puts those that many items share last, so that a phrase of many
items is in a sketch only where it must be. Documents are searched with all their shingle hashes, each text in one
pass; the pairs found are then verified on the shingles themselves.

Defined cases: null texts and texts without words contain nothing, and items without words are contained in
nothing; repeated items and documents appear as often as they occur (ids that repeat are joined into one);
rows with a null id, documents or items, take no part; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfind.llm.common import column, kept

WORDS = 5
LEAST = 0.75
#: Index rows and candidate documents up to this many are broadcast; more are joined by a shuffle.
MAX_BROADCAST_ROWS = 200_000
_SPACE = "[\\x20\\x09-\\x0D]+"


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), _SPACE), "")


def _runs(w: Column, width: int) -> Column:
    """All runs of ``width`` words, as arrays."""
    runs = F.transform(F.sequence(F.lit(1), F.size(w) - (width - 1)), lambda i: F.slice(w, i, width))
    return F.when(F.size(w) >= width, runs).otherwise(F.array().cast("array<array<string>>"))


def _all_runs(w: Column, widths: list[int], of) -> Column:
    """``of`` each run of these widths."""
    return F.flatten(F.array(*(F.transform(_runs(w, k), of) for k in widths)))


#: Hits that a document needs for items of the size partitions from this one on, the first entry that is reached.
HITS_FROM = ((5, 4), (4, 3), (3, 2), (0, 1))


def hits_needed(part: Column) -> Column:
    """How many hashes of an item's sketch a document that contains it has at least, by the item's size partition."""
    return F.coalesce(*(F.when(part >= p, F.lit(h)) for p, h in HITS_FROM))


def sketch_length(part: int, least: float = LEAST) -> int:
    """Hashes in the longest sketch of the partition of items with 2 ** part to 2 ** (part + 1) - 1 shingles."""
    n, hits = range(1 << part, 2 << part), next(h for p, h in HITS_FROM if part >= p)
    return max(k - max(1, math.ceil(k * least)) + hits for k in n)


def _small(df: DataFrame) -> DataFrame:
    """df, marked for broadcast if its size allows."""
    return F.broadcast(df) if df.count() <= MAX_BROADCAST_ROWS else df


def item_index(items: DataFrame, id_col: str = "item_id", text_col: str = "text", least: float = LEAST) -> DataFrame:
    """(item_id, width, n, needed, part, shingle, hash, place): an item's distinct shingles in MinHash order.

    n: the item's distinct shingles; needed: how many a document must have; part: the size partition (n's
    power of two); rows with place <= n - needed + hits_needed(part) are the item's sketch.
    """
    w = items.select(column(id_col).alias("item_id"), words(column(text_col)).alias("w")).filter(F.col("item_id").isNotNull() & (F.size("w") > 0))
    w = w.withColumn("width", F.least(F.size("w"), F.lit(WORDS)))
    all_runs = F.transform(F.sequence(F.lit(1), F.size("w") - F.col("width") + 1), lambda i: F.slice("w", i, F.col("width")))
    sets = w.select("item_id", "width", F.array_distinct(all_runs).alias("runs"))
    merged = sets.select("item_id", "width", F.explode("runs").alias("run")).distinct()
    hashed = kept(merged.select("item_id", "width", F.array_join("run", " ").alias("shingle"), F.xxhash64("run").alias("hash")), "benchmark-shingles")
    many = hashed.groupBy("hash").agg(F.count(F.lit(1)).alias("items"))
    grouped = hashed.join(many, "hash").groupBy("item_id", "width").agg(F.array_sort(F.collect_list(F.struct("items", "hash", "shingle"))).alias("s"))
    n = F.size("s")
    out = grouped.withColumn("n", n).withColumn("needed", F.greatest(F.ceil(n * F.lit(least)), F.lit(1)).cast("int")).withColumn("part", F.floor(F.log2(n)).cast("int"))
    return out.select("item_id", "width", "n", "needed", "part", F.posexplode("s").alias("place", "s")).select("item_id", "width", "n", "needed", "part", F.col("s.shingle").alias("shingle"), F.col("s.hash").alias("hash"), (F.col("place") + 1).alias("place"))


def candidates(docs: DataFrame, index: DataFrame, widths: list[int], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, item_id) where the document has enough of the item's sketch hashes, by its size partition, and enough words."""
    sketch = index.withColumn("hits", hits_needed(F.col("part"))).filter(F.col("place") <= F.col("n") - F.col("needed") + F.col("hits"))
    own = _small(sketch.select("item_id", "hash", "needed", "width", "hits"))
    w = docs.select(column(id_col).alias("doc_id"), words(column(text_col)).alias("w"))
    rows = w.select("doc_id", F.size("w").alias("size"), F.explode(_all_runs(F.col("w"), widths, lambda x: F.xxhash64(x))).alias("hash"))
    met = rows.join(own, "hash").filter(F.col("size") - (F.col("width") - 1) >= F.col("needed"))
    # each hash counts once, however often the document has it
    found = met.select("doc_id", "item_id", "hits", "hash").distinct().groupBy("doc_id", "item_id", "hits").agg(F.count(F.lit(1)).alias("n"))
    return found.filter(F.col("n") >= F.col("hits")).select("doc_id", "item_id")


def contained(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", doc_text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, shared, item_shingles, containment) of every contained item."""
    index = kept(item_index(items, item_id, item_text), "benchmark-index")
    widths = sorted(r[0] for r in index.select("width").distinct().collect())  # at most five
    slim = docs.select(column(doc_id).alias("doc_id"), column(doc_text).alias("text")).filter("doc_id is not null")
    pairs = kept(candidates(slim, index, widths or [WORDS]), "benchmark-pairs")
    ids = pairs.select("doc_id").distinct()
    w = slim.join(_small(ids), "doc_id", "left_semi").select("doc_id", words(F.col("text")).alias("w"))
    rows = w.select("doc_id", F.explode(_all_runs(F.col("w"), widths or [WORDS], lambda x: F.array_join(x, " "))).alias("shingle"))
    own = _small(index.select("item_id", "n", "needed", "shingle"))
    shared = rows.join(own, "shingle").distinct().groupBy("doc_id", "item_id", "n", "needed").agg(F.count(F.lit(1)).alias("shared"))
    verified = shared.filter(F.col("shared") >= F.col("needed")).join(pairs, ["doc_id", "item_id"], "left_semi")
    return verified.select("doc_id", "item_id", "shared", F.col("n").alias("item_shingles"), (F.col("shared") / F.col("n")).alias("containment"))


ORACLE_SQL = r"""
WITH items AS (SELECT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM benchmark),
docs AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
item_s AS (SELECT DISTINCT item_id, least(len(w), 5) AS width, array_to_string(w[i:i + least(len(w), 5) - 1], ' ') AS s
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 5) + 2)) AS i FROM items WHERE len(w) > 0)),
sizes AS (SELECT item_id, count(*) AS n FROM item_s GROUP BY item_id),
widths AS (SELECT DISTINCT width FROM item_s),
doc_s AS (SELECT DISTINCT doc_id, width, array_to_string(w[i:i + width - 1], ' ') AS s
  FROM (SELECT doc_id, w, width, unnest(range(1, len(w) - width + 2)) AS i FROM docs, widths WHERE len(w) >= width)),
hits AS (SELECT d.doc_id, t.item_id, count(*) AS shared FROM doc_s d JOIN item_s t ON d.s = t.s AND d.width = t.width GROUP BY 1, 2)
SELECT doc_id, item_id, shared, CAST(n AS INTEGER) AS item_shingles, shared / n AS containment
FROM hits JOIN sizes USING (item_id) WHERE shared >= ceil(n * 0.75)
"""
