"""Filters of extracted rooms and schedules, scope and strategy of jobs, suppression by definitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfind import vocab
from wayfind.functions import text
from wayfind.operators.rules import JOB


def is_junk_room_name(name: Column) -> Column:
    """Whether a text is a note, a table row, a dimension or garbage instead of a room's name. Empty is not junk."""
    u = F.upper(F.trim(F.coalesce(name, F.lit(""))))
    words = F.filter(F.split(u, r"\s+"), lambda w: w != "")
    share = F.size(F.filter(words, lambda w: w.rlike("^[A-Z0-9]$") | w.isin(*vocab.JUNK_WORDS))) / F.size(words)
    table = F.size(F.filter(words, lambda w: w.isin(*vocab.TABLE_WORDS))) >= 3
    stubs = (F.size(words) >= 3) & ~F.exists(words, lambda w: (F.length(w) > 2) | w.isin(*vocab.SHORT_WORDS))
    dense = F.regexp_replace(u, r"\s+", "")
    sparse = (F.length(dense) > 3) & (F.length(F.regexp_replace(dense, "[^A-Z]", "")) / F.length(dense) < 0.5)
    late = (share > 0.40) | table | u.rlike(vocab.JUNK_ROW) | u.rlike(vocab.NOT_A_NAME) | stubs | sparse | u.rlike(vocab.GARBLED)
    return F.when(u == "", False).when((F.length(u) > 60) | u.rlike(vocab.NOTE_PHRASES), True).when(u.rlike(vocab.EXEMPT_UNIT), False).otherwise(late)


def hard_reject_rooms(rooms: DataFrame) -> DataFrame:
    """rooms without those of a short number and an annotation for a name."""
    number, name = F.upper(F.trim(F.coalesce("room_number", F.lit("")))), F.upper(F.trim(F.coalesce("room_name", F.lit(""))))
    return rooms.filter(~(number.rlike(vocab.SHORT_NUMBER) & name.rlike(vocab.ANNOTATION)))


def drop_corridor_schedule(schedule: DataFrame) -> DataFrame:
    """schedule without plain corridor rows that carry no message."""
    plain = F.upper(F.trim(F.coalesce("room_name", F.lit("")))).rlike(vocab.PLAIN_CORRIDOR)
    return schedule.filter(~plain | (F.trim(F.coalesce("message", F.lit(""))) != ""))


def keep_egress_rooms(rooms: DataFrame) -> DataFrame:
    """Rooms with an egress name that are no corridors: all that schedule-first jobs take from plans."""
    name = F.upper("room_name")
    return rooms.filter(name.rlike(vocab.EGRESS_NAMES) & ~name.rlike(vocab.CORRIDOR))


def resolve_room_level(rooms: DataFrame, sheet_levels: DataFrame) -> DataFrame:
    """rooms with the level of their number, else their sheet's (sheet_id, level), else their own."""
    known = sheet_levels.select(*JOB, "sheet_id", F.col("level").alias("_sheet"))
    joined = rooms.join(known, [*JOB, "sheet_id"], "left")
    return joined.withColumn("level", F.coalesce(text.level_from_room_number(F.col("room_number")), "_sheet", "level")).drop("_sheet")


def job_scope(schedule: DataFrame, sheets: DataFrame) -> DataFrame:
    """Jobs about restrooms only: every scheduled type is one, or 80 % of the A-series sheets are and none is general."""
    by_types = schedule.groupBy(*JOB).agg(F.bool_and(F.upper("sign_type").rlike(vocab.RESTROOM_SCOPE)).alias("ok")).filter("ok").select(*JOB)
    title = F.upper(F.coalesce("title", F.lit("")))
    a_series = F.upper("sheet_no").rlike(r"^A-?\d")
    sheets_of = sheets.groupBy(*JOB).agg(F.count_if(a_series).alias("a"), F.count_if(a_series & title.rlike(vocab.RESTROOM_TITLE)).alias("r"), F.bool_or(title.rlike(vocab.GENERAL_TITLE)).alias("general"))
    by_sheets = sheets_of.filter("a > 0 and not general and r / a >= 0.8").select(*JOB)
    return by_types.unionByName(by_sheets).distinct()


def job_strategy(jobs: DataFrame, schedule: DataFrame, files: DataFrame) -> DataFrame:
    """(tenant_id, job_id, strategy) from rows of the schedule and kinds of files (file_category)."""
    rows = schedule.groupBy(*JOB).agg(F.count(F.lit(1)).alias("rows"))
    kinds = files.groupBy(*JOB).agg(F.count_if(F.col("file_category") == "floor_plan").alias("plans"), F.bool_or(F.col("file_category") == "sign_schedule").alias("dedicated"))
    j = jobs.select(*JOB).join(rows, JOB, "left").join(kinds, JOB, "left").fillna(0, ["rows", "plans"])
    strategy = text.first_of((F.coalesce("dedicated", F.lit(False)) | (F.col("rows") >= 100), "schedule_primary"), (F.col("plans") == 0, "egress_only"), (F.col("rows") > 0, "hybrid"), (F.lit(True), "floor_plan_primary"))
    return j.select(*JOB, strategy.alias("strategy"))


def suppress_undefined(signs: DataFrame, definitions: DataFrame) -> DataFrame:
    """signs without types that the job's definitions (code, description) do not name. Jobs without any keep all."""
    told = F.upper(F.concat_ws(" ", F.col("type_code"), F.col("description")))
    named = definitions.groupBy(*JOB).agg(*(F.bool_or(told.rlike(p)).alias(f"_has{i}") for i, (_, p) in enumerate(vocab.SUPPRESSED_UNLESS)))
    joined = signs.join(named, JOB, "left")
    gone = F.lit(False)
    for i, (types, _) in enumerate(vocab.SUPPRESSED_UNLESS):
        gone = gone | (F.col("sign_type").isin(*types) & ~F.coalesce(f"_has{i}", F.lit(True)))
    return joined.filter(~gone).select(*signs.columns)


def canonical_guard(signs: DataFrame) -> DataFrame:
    """signs (sign_type; detected and is_assembly of the room) without types outside the canonical list, unit signs where
    the building has no units, and occupancy limits of rooms that are no assembly rooms."""
    kind, sign = F.col("detected"), F.col("sign_type")
    units = kind.isin(*vocab.UNIT_SIGN_TYPES) | text.building_type_group(kind).isin(*vocab.UNIT_SIGN_TYPES)
    wrong = ((sign == "Unit ID") & ~F.coalesce(units, F.lit(False))) | ((sign == "Max Occupancy") & ~F.coalesce("is_assembly", F.lit(False)))
    return signs.filter(sign.isin(*vocab.CANONICAL) & ~wrong)


def alias_types(signs: DataFrame, definitions: DataFrame) -> DataFrame:
    """signs whose Room ID is called as the job's definitions call it: the last one (by position) that describes it.

    definitions: tenant_id, job_id, position, type_code, description. To be applied after ``canonical_guard``.
    """
    told = definitions.filter(F.lower(F.trim("description")).rlike(vocab.ROOM_ID_DESCRIPTION))
    named = told.groupBy(*JOB).agg(F.max_by(F.concat(F.lit("Type "), "type_code"), "position").alias("_alias"))
    own = F.when(F.col("sign_type") == "Room ID", F.col("_alias"))
    return signs.join(named, JOB, "left").withColumn("sign_type", F.coalesce(own, "sign_type")).drop("_alias")


def rerule(stored: DataFrame, made: DataFrame) -> DataFrame:
    """Stored signs with those of the rules engine replaced by freshly made ones (same columns, source added)."""
    rest = stored.filter(F.coalesce("source", F.lit("")) != "rules_engine")
    return rest.select(*JOB, "room_seq", "sign_type", "qty", "source").unionByName(made.select(*JOB, "room_seq", "sign_type", "qty", F.lit("rules_engine").alias("source")))


def place_on_sheets(signs: DataFrame, rooms: DataFrame) -> DataFrame:
    """signs (room_seq) with sheet_id: the room's, else the first of the room's level, else the job's first, in the order of
    the rooms (seq, sheet_id, level). A sign without a known room gets the job's first sheet; a job without any has none."""
    sheet = F.when(F.trim("sheet_id") != "", F.col("sheet_id"))
    r = rooms.select(*JOB, "seq", sheet.alias("_own"), F.col("level").alias("_level"))
    told = r.filter("_own is not null")
    by_level = told.groupBy(*JOB, "_level").agg(F.min_by("_own", "seq").alias("_of_level")).withColumnsRenamed({c: f"_{c}" for c in JOB} | {"_level": "_at"})
    first = told.groupBy(*JOB).agg(F.min_by("_own", "seq").alias("_first"))
    same = F.col("_level").eqNullSafe(F.col("_at"))
    for c in JOB:
        same = same & (F.col(c) == F.col(f"_{c}"))
    placed = r.join(by_level, same, "left").select(*JOB, F.col("seq").alias("room_seq"), F.coalesce("_own", "_of_level").alias("_sheet"))
    joined = signs.join(placed, [*JOB, "room_seq"], "left").join(first, JOB, "left")
    return joined.withColumn("sheet_id", F.coalesce("_sheet", "_first")).drop("_sheet", "_first")


def assemble_signs(made: DataFrame, rooms: DataFrame, egress: DataFrame) -> DataFrame:
    """Per-room signs without what the egress generator makes (stairs, maps, areas of rescue, exits of stair rooms),
    and the egress signs: (tenant_id, job_id, sign_type, qty). Signs that carry their room's is_stair meet no rooms."""
    if "is_stair" in made.columns:
        joined = made.withColumnRenamed("is_stair", "_stair")
    else:
        stairs = rooms.filter("is_stair").select(*JOB, F.col("seq").alias("room_seq"), F.lit(True).alias("_stair"))
        joined = made.join(stairs, [*JOB, "room_seq"], "left")
    generated = F.col("sign_type").isin("Stair(Corridor)", "Stair(Landing)", "Evacuation Map", "Area of Rescue") | ((F.col("sign_type") == "Exit") & F.coalesce("_stair", F.lit(False)))
    return joined.filter(~generated).select(*JOB, "sign_type", "qty").unionByName(egress.select(*JOB, "sign_type", "qty"))
