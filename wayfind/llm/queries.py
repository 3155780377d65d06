"""The registered queries of this package."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfind.llm import alignment, chat, codebooks, decontaminate, gif, jaccard_join, language, licenses, packing, pii, quality, sharding, toxicity
from wayfind.llm.common import documents, fold, labelled_sample, table


def op1_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(documents(spark, sf_dir))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(documents(spark, sf_dir))


def op3_gif(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gif.digests(documents(spark, sf_dir))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learned from documents that are not held out; a null id is never held out, and its document trains."""
    docs = documents(spark, sf_dir)
    model = language.fit(docs, fold(F.col("doc_id")) != 1)
    found = language.predict(docs, model)
    return found.select(F.col("id").alias("doc_id"), (fold(F.col("id")) == 1).alias("held_out"), "lang_pred", "score")


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(documents(spark, sf_dir))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.shard_documents(documents(spark, sf_dir))
    return rows.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve")


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contained(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learned from labelled documents that are not held out; a null id is never held out, and has no label."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("label"))
    model = toxicity.fit(labelled_sample(docs, labels.filter(fold(F.col("doc_id")) != 1), toxicity.MAX_FIT_ROWS))
    found = toxicity.score(docs, model)
    return found.select(F.col("id").alias("doc_id"), (fold(F.col("id")) == 1).alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    model = quality.fit(labelled_sample(docs.select("doc_id", "text"), labels.filter(fold(F.col("doc_id")) != 1), quality.MAX_FIT_ROWS))
    return quality.classify(docs, model, columns=["doc_id"])


def pages_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Web pages by the evidence of their text, their host and the first path segment below it."""
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    model = quality.fit(labelled_sample(documents(spark, sf_dir).select("doc_id", "text"), labels, quality.MAX_FIT_ROWS))
    pages = quality.page_texts(table(spark, sf_dir, "pages"))
    return quality.classify(pages, model, host_col="host", path_col="path", columns=["id", "host", "path"])


def conversations_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole conversations under limits on tokens, conversations and the assistant's tokens."""
    return packing.pack_conversations(table(spark, sf_dir, "conversations"))


def media_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The timed frames of every stored text with a column for each colour bin."""
    return gif.frames_table(gif.read_media(gif.store_texts(documents(spark, sf_dir))).select("id", "frames"))


def license_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The confirmed licence families of each document that has any."""
    return licenses.families(licenses.scan(documents(spark, sf_dir)))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_texts(documents(spark, sf_dir))


def op11_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    return chat.read_back(chat.kept_format(chat.with_probe(turns)))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.report(documents(spark, sf_dir))


def op13_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codebooks.report(table(spark, sf_dir, "embeddings"))


def queries():
    more = {"pages_quality": pages_quality, "conversations_packing": conversations_packing, "media_frames": media_frames, "license_families": license_families}
    return more | {"op1_licenses": op1_licenses, "op2_pii": op2_pii, "op3_gif": op3_gif, "op4_language": op4_language, "op5_jaccard_join": op5_jaccard_join, "op6_sharding": op6_sharding, "op7_toxicity": op7_toxicity, "op8_decontaminate": op8_decontaminate, "op9_quality": op9_quality, "op10_packing": op10_packing, "op11_chat": op11_chat, "op12_alignment": op12_alignment, "op13_codes": op13_codes}


def oracle_sql():
    return {"op8_decontaminate": decontaminate.ORACLE_SQL, "op13_codes": codebooks.ORACLE_SQL}
