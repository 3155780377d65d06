"""Aggregates of jobs: counts, histograms, levels of sheets, allow-lists, validation, outliers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayfind import vocab
from wayfind.functions import text
from wayfind.operators.rules import JOB
from wayfind.operators.schedules import is_type_code


def _live(signs: DataFrame) -> DataFrame:
    """Signs that count: not deleted, not exterior, not of a dismissed room (the room's status is on the row)."""
    return signs.filter(~F.col("is_deleted") & (F.coalesce("source", F.lit("")) != "exterior") & ~(F.col("room_seq").isNotNull() & (F.coalesce("review_status", F.lit("")) == "dismissed")))


def live_sign_counts(signs: DataFrame) -> DataFrame:
    """Per job: quantity of all live signs, of confident ones, of the rest."""
    qty, high = F.coalesce("qty", F.lit(1)), F.coalesce("confidence", F.lit(0.5)) >= vocab.HIGH_CONFIDENCE
    return _live(signs).groupBy(*JOB).agg(F.sum(qty).alias("total_signs"), F.sum(F.when(high, qty).otherwise(0)).alias("high_confidence"), F.sum(F.when(high, 0).otherwise(qty)).alias("needs_review"))


def sign_type_distribution(signs: DataFrame) -> DataFrame:
    return signs.filter(~F.col("is_deleted")).groupBy(*JOB, "sign_type").agg(F.sum("qty").alias("qty"))


#: Buckets of room confidence: upper bounds (the last one has none) and names, in order: fixed values.
BUCKETS = [(0.50, "< 50%"), (0.60, "50–59%"), (0.80, "60–79%"), (None, "80–100%")]


def confidence_histogram(rooms: DataFrame) -> DataFrame:
    """Rooms found by vision in each of four buckets, empty ones too, for jobs that have such rooms. A missing
    confidence counts as 1."""
    confidence = F.coalesce("confidence", F.lit(1.0))
    bucket = text.first_of(*((confidence < high if high else F.lit(True), name) for high, name in BUCKETS))
    counts = rooms.filter("source = 'ai_vision'").groupBy(*JOB).agg(*(F.count_if(bucket == name).alias(name) for _, name in BUCKETS))
    return counts.unpivot(JOB, [name for _, name in BUCKETS], "bucket", "n_rooms")


def sign_type_summary(signs: DataFrame) -> DataFrame:
    """Per job and sign type: quantity, distinct floors and sources, most first."""
    return signs.filter(~F.col("is_deleted")).groupBy(*JOB, "sign_type").agg(F.sum("qty").alias("qty"), F.count_distinct("floor_label").alias("n_levels"), F.count_distinct("source").alias("n_sources"))


def sign_outliers(signs: DataFrame, most: int = 3) -> DataFrame:
    """Rooms (by number) with more than three signs."""
    number = F.upper(F.trim("room_number"))
    return signs.filter(number != "").groupBy(*JOB, number.alias("number")).agg(F.count(F.lit(1)).alias("n_signs")).filter(F.col("n_signs") > most)


def backfill_sheet_level(rooms: DataFrame) -> DataFrame:
    """(tenant_id, job_id, sheet_id, level): the level that most of a sheet's rooms have; ties go to the one seen first."""
    counts = rooms.filter(F.trim("level") != "").groupBy(*JOB, "sheet_id", "level").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("first"))
    return counts.groupBy(*JOB, "sheet_id").agg(F.min_by("level", F.struct(-F.col("n"), "first")).alias("level"))


def correct_sheet_level(rooms: DataFrame, least: int = 3, share: float = 0.6) -> DataFrame:
    """Sheets whose room numbers agree on another level than 1: three rooms and 60 % of all rooms at least."""
    by_number = text.level_from_room_number(F.col("room_number"))
    counts = rooms.groupBy(*JOB, "sheet_id", by_number.alias("level")).agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("first"))
    sheets = counts.groupBy(*JOB, "sheet_id").agg(F.sum("n").alias("rooms"), F.min(F.when(F.col("level").isNotNull() & (F.col("level") != "LEVEL 1"), F.struct((-F.col("n")).alias("n"), "first", "level"))).alias("top"))
    return sheets.filter((-F.col("top.n") >= least) & (-F.col("top.n") / F.col("rooms") >= share)).select(*JOB, "sheet_id", F.col("top.level").alias("level"))


def apply_allowlist(rooms: DataFrame, jobs: DataFrame) -> DataFrame:
    """Rooms whose number their building type allows. Enforced in jobs with five numbered rooms and more, half of
    which match; rooms without a number stay."""
    pattern = vocab.ALLOWED_NUMBER
    kind, number = F.lower(F.trim("building_type")), F.trim("room_number")
    typed = rooms.join(jobs.select(*JOB, "building_type"), JOB)
    listed, fits = kind.isin(*vocab.ALLOWLIST_TYPES), number.rlike(pattern)
    w = Window.partitionBy(*JOB)
    numbered, matching = F.count_if(number != "").over(w), F.count_if((number != "") & fits).over(w)
    strict = listed & (numbered >= 5) & (matching / numbered >= 0.5)
    return typed.withColumn("_drop", F.coalesce(strict, F.lit(False)) & (number != "") & ~fits).filter(~F.col("_drop")).select(*rooms.columns)


def suppress_stray_units(rooms: DataFrame, jobs: DataFrame) -> DataFrame:
    """Rooms without UNIT and APT names where these are neither the building's kind nor dominant in the job."""
    unit = F.upper(F.trim("room_name")).rlike(vocab.UNIT_OR_APT)
    w = Window.partitionBy(*JOB)
    n, all_rooms = F.count_if(unit).over(w), F.count(F.lit(1)).over(w)
    typed = rooms.join(jobs.select(*JOB, "building_type"), JOB)
    marked = typed.withColumn("_stray", unit & ~F.col("building_type").isin(*vocab.UNIT_SIGN_TYPES) & ~((n >= 5) & (n / all_rooms >= 0.3)))
    return marked.filter(~F.col("_stray")).select(*rooms.columns)


def reconcile_jobs(rooms: DataFrame, signs: DataFrame, least_coverage: float = 0.7) -> DataFrame:
    """Per job: rooms, rooms with a sign, coverage, and a warning below 70 %."""
    have = signs.filter("room_seq is not null and not is_deleted").select(*JOB, F.col("room_seq").alias("seq")).distinct().withColumn("_has", F.lit(1))
    out = rooms.join(have, [*JOB, "seq"], "left").groupBy(*JOB).agg(F.count(F.lit(1)).alias("n_rooms"), F.count("_has").alias("with_sign"))
    coverage = F.col("with_sign") / F.col("n_rooms")
    return out.withColumn("coverage", coverage).withColumn("warning", F.when(coverage < least_coverage, "low room coverage"))


def list_jobs(jobs: DataFrame, types: list[str], limit: int, offset: int = 0) -> DataFrame:
    """Jobs of these building types, newest first, one page."""
    return jobs.filter(F.lower("building_type").isin(*(t.lower() for t in types))).orderBy(F.desc("created_at"), "job_id").offset(offset).limit(limit)


def dashboard(jobs: DataFrame, signs: DataFrame) -> DataFrame:
    """Per tenant: jobs by status, live signs."""
    counts = jobs.groupBy("tenant_id").agg(F.count(F.lit(1)).alias("n_jobs"), *(F.count_if(F.col("status") == s).alias(s) for s in ("pending", "processing", "completed")))
    live = live_sign_counts(signs).groupBy("tenant_id").agg(F.sum("total_signs").alias("signs"), F.sum("needs_review").alias("needs_review"))
    return counts.join(live, "tenant_id", "left").fillna(0, ["signs", "needs_review"])


def recent_jobs(jobs: DataFrame, k: int = 5) -> DataFrame:
    """The jobs of each tenant that changed last."""
    place = F.row_number().over(Window.partitionBy("tenant_id").orderBy(F.desc("updated_at"), "job_id"))
    return jobs.withColumn("place", place).filter(F.col("place") <= k).select(*JOB, "status", "updated_at", "place")


def reconcile_benchmarks(rooms: DataFrame, schedule: DataFrame, signs: DataFrame, benchmarks: DataFrame, least_coverage: float = 0.7, least_signs: float = 0.6) -> DataFrame:
    """Per job: rooms against rows of its schedule, signs against its benchmark, and a warning for each that falls
    short. benchmarks: tenant_id, job_id, benchmark."""
    n = lambda df, name: df.groupBy(*JOB).agg(F.count(F.lit(1)).alias(name))
    counted = n(rooms, "n_rooms").join(n(schedule, "n_scheduled"), JOB, "full_outer").join(n(signs, "n_signs"), JOB, "full_outer").join(benchmarks, JOB, "left").fillna(0, ["n_rooms", "n_scheduled", "n_signs"])
    coverage = F.when(F.col("n_scheduled") > 0, F.col("n_rooms") / F.col("n_scheduled"))
    short = F.array(F.when(coverage < least_coverage, "room coverage"), F.when(F.col("n_signs") < F.col("benchmark") * least_signs, "sign count"))
    return counted.withColumn("coverage", coverage).withColumn("warnings", F.array_join(F.array_compact(short), ", "))


def sign_type_lists(signs: DataFrame) -> DataFrame:
    """Per job and sign type: quantity, the levels and rules that it has, sorted, and its place by quantity.

    A type has a few levels and rules: distinct ones are found before they are gathered, so a type with very many signs
    gathers no more than others.
    """
    key = [*JOB, "sign_type"]
    live = signs.filter(~F.col("is_deleted"))
    small = live.groupBy(*key, "floor_label", "rule_ref").agg(F.sum("qty").alias("qty"))
    out = small.groupBy(*key).agg(F.sum("qty").alias("qty"), F.array_sort(F.collect_set("floor_label")).alias("levels"), F.array_sort(F.collect_set("rule_ref")).alias("rules"))
    return out.withColumn("place", F.row_number().over(Window.partitionBy(*JOB).orderBy(F.desc("qty"), "sign_type")))


def rules_of_types(signs: DataFrame) -> DataFrame:
    """Per job and sign type: quantity, distinct floors and rules. Needs floor_label and rule_ref."""
    return signs.groupBy(*JOB, "sign_type").agg(F.sum("qty").alias("qty"), F.count_distinct("floor_label").alias("n_levels"), F.count_distinct("rule_ref").alias("n_rules"))


def unrecognised_codes(signs: DataFrame, definitions: DataFrame) -> DataFrame:
    """Distinct project type codes of signs that no definition (type_code) of their job has."""
    known = definitions.select(*JOB, F.upper(F.concat(F.lit("Type "), "type_code")).alias("_code")).distinct()
    coded = signs.filter(is_type_code(F.col("sign_type"))).select(*JOB, F.trim("sign_type").alias("sign_type")).distinct().withColumn("_code", F.upper("sign_type"))
    return coded.join(known, [*JOB, "_code"], "left_anti").select(*JOB, "sign_type")
