"""Five-stage cleaning of documents: quality, near duplicates, benchmark passages, personal data, packing.

Every stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept. All but the last
return the columns of docs, whatever their names; the last returns the packed pieces. Of rows that repeat with id and
text, stage 2 keeps the one whose other columns come first; different texts under one id all stay or go together, as that id does. A null id is never
dropped as a copy or for a benchmark passage. Stages pass texts to Python a few MB at a time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfind.llm import decontaminate, jaccard_join, packing, pii, quality
from wayfind.llm.common import all_columns, column, discard, kept, labelled_sample, restore_batches, small_batches, table


def _few(ids: DataFrame) -> DataFrame:
    return F.broadcast(ids) if ids.count() <= jaccard_join.MAX_BROADCAST_IDS else ids


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """docs but those with these ids. Few ids are broadcast, many are joined by a shuffle."""
    ids = kept(ids.filter("doc_id is not null").distinct(), "dropped")
    return docs.join(_few(ids), "doc_id", "left_anti").select(*all_columns(docs))


def _least(docs: DataFrame) -> DataFrame:
    """Of rows that repeat with id and text, the one whose other columns come first as JSON (columns by name, nulls told
    from absent ones), so that repeating the job keeps the same row."""
    others = [c for c in sorted(docs.columns) if c not in ("doc_id", "text")]
    if not others:
        return docs.distinct()
    rest = F.struct(*(column(c).alias(f"c{i}") for i, c in enumerate(others)))
    best = docs.groupBy("doc_id", "text").agg(F.min_by(rest, F.to_json(rest, {"ignoreNullFields": "false"})).alias("_rest"))
    back = [F.col(c) if c in ("doc_id", "text") else F.col("_rest")[f"c{others.index(c)}"].alias(c) for c in docs.columns]
    return best.select(*back)


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hierarchical empirical Bayes does not reject."""
    small_batches(spark)
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    model = quality.fit(labelled_sample(docs.select("doc_id", "text"), labels, quality.MAX_FIT_ROWS))
    return quality.accepted(docs, model)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of texts that links connect."""
    small_batches(spark)
    found = kept(jaccard_join.join(docs.select("doc_id", "text")), "near-copies")
    out = _without(docs, found.filter("doc_id <> component_id").select("doc_id"))
    repeated = kept(found.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").select("doc_id"), "repeated")
    if repeated.isEmpty():
        return out
    repeated = _few(repeated)
    single = out.join(repeated, "doc_id", "left_anti").select(*all_columns(docs))
    return single.unionByName(_least(out.join(repeated, "doc_id", "left_semi").select(*all_columns(docs))))


def no_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    return _without(docs, decontaminate.contained(docs, table(spark, sf_dir, "benchmark")).select("doc_id"))


def no_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data replaced by its kind."""
    small_batches(spark)
    return pii.redact(docs, pii.learn(kept(pii.candidates(docs), "candidates")))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training sequences."""
    return packing.pack_texts(docs)


STAGES = [
    ("quality", good_quality),
    ("near_copies", one_of_each),
    ("benchmark", no_benchmark),
    ("personal_data", no_personal_data),
    ("packing", packed),
]

#: Not in SQL: tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, setting = table(spark, sf_dir, "documents"), small_batches(spark)
    for k, (name, stage) in enumerate(STAGES[:-1]):
        before, docs = docs, kept(stage(spark, docs, sf_dir), f"stage-{name}")
        if k:
            discard(before)
    restore_batches(spark, setting)
    return STAGES[-1][1](spark, docs, sf_dir)
