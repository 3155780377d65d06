"""Deduplication: the first row of a key in the order of seq, unless said otherwise. The key starts with tenant
and job, so one partitioning by these serves every step of a workflow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfind.operators.rules import JOB
from wayfind.sources.kept import kept


def first_per_key(df: DataFrame, key: list[Column | str], *order: Column) -> DataFrame:
    """The rows that come first in their key by this order (seq if none is given)."""
    w = Window.partitionBy(*key).orderBy(*(order or (F.col("seq"),)))
    return df.withColumn("_place", F.row_number().over(w)).filter("_place = 1").drop("_place")


def _folded(c: str) -> Column:
    return F.lower(F.trim(F.coalesce(F.col(c), F.lit(""))))


def dedup_schedule(schedule: DataFrame) -> DataFrame:
    """By sheet, room number, sign type and mark."""
    return first_per_key(schedule, [*JOB, *map(_folded, ("sheet_id", "room_number", "sign_type", "type_mark"))])


def dedup_schedule_rooms(schedule: DataFrame) -> DataFrame:
    """By room number, sign type and mark."""
    return first_per_key(schedule, [*JOB, *map(_folded, ("room_number", "sign_type", "type_mark"))])


def dedup_schedule_global(schedule: DataFrame) -> DataFrame:
    """By number, name, type and mark without the empty ones; a row without any goes."""
    key = F.concat_ws("|", *(F.nullif(_folded(c), F.lit("")) for c in ("room_number", "room_name", "sign_type", "type_mark")))
    return first_per_key(schedule.withColumn("_key", key).filter("_key <> ''"), [*JOB, "_key"]).drop("_key")


def dedup_tile_rooms(rooms: DataFrame) -> DataFrame:
    """Rooms seen on overlapping tiles of a sheet."""
    return first_per_key(rooms, [*JOB, "sheet_id", F.lower("room_number"), F.lower("room_name")])


def dedup_sheets(sheets: DataFrame) -> DataFrame:
    return first_per_key(sheets, [*JOB, "sheet_id", "pdf_page", "file_id"])


#: Source priority in the final dedup (a learned rule has 4): fixed values.
PRIORITY = {"schedule": 3, "rules_engine": 2, "ai_vision": 1}


def dedup_signs(signs: DataFrame) -> DataFrame:
    """One sign of each room, type and floor, or of each type, floor and note where no room is linked: the most
    confident, then by source, then the first. Needs room_number, room_name, floor_label and notes."""
    up = lambda c: F.upper(F.trim(F.coalesce(F.col(c), F.lit(""))))
    linked = F.col("room_seq").isNotNull() & ((up("room_number") != "") | (up("room_name") != ""))
    part = lambda c: F.when(linked, up(c)).otherwise("")
    note = F.when(linked, "").otherwise(F.upper(F.substring(F.coalesce("notes", F.lit("")), 1, 40)))
    priority = F.coalesce(F.create_map(*(F.lit(x) for p in PRIORITY.items() for x in p))[F.col("source")], F.lit(0))
    if "rule_ref" in signs.columns:
        priority = F.when(F.col("rule_ref").rlike("^training_correction(:|$)"), 4).otherwise(priority)
    return first_per_key(signs, [*JOB, linked, part("room_number"), part("room_name"), up("sign_type"), up("floor_label"), note], F.desc("confidence"), F.desc(priority), F.col("seq"))


#: Shortest name that is compared by containment.
LEAST_NAME = 4
#: Words of restroom names: fixed values.
RESTROOM_WORDS = "restroom|bathroom|washroom|lavatory|toilet|shower"


def _threes(name: Column) -> Column:
    """The distinct runs of three characters of a name of at least three."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(name) - 2), lambda i: F.substring(name, i, F.lit(3))))


def _inside(parts: DataFrame, wholes: DataFrame) -> DataFrame:
    """Pairs (job, part, whole) of distinct names of at least four characters where whole contains part.

    A whole that contains part has all of part's runs of three characters: wholes are listed by each of theirs, and a part
    is looked up by the one that the fewest wholes of the job have. The tables are joined by shuffles: Spark would judge them by
    their small files, and the driver would hold many times as much.
    """
    listed = wholes.filter(F.length("whole") >= LEAST_NAME).select(*JOB, "whole", F.explode(_threes(F.col("whole"))).alias("three"))
    asked = parts.filter(F.length("part") >= LEAST_NAME).select(*JOB, "part", F.explode(_threes(F.col("part"))).alias("three"))
    counts = listed.groupBy(*JOB, "three").agg(F.count(F.lit(1)).alias("n"))
    # a run of three that no whole has: the part is in none
    rare = asked.join(counts.hint("merge"), [*JOB, "three"], "left").groupBy(*JOB, "part").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "three")).alias("m"))
    probe = rare.filter("m.n > 0").select(*JOB, "part", F.col("m.three").alias("three"))
    return probe.join(listed.hint("merge"), [*JOB, "three"]).filter(F.contains("whole", F.col("part"))).select(*JOB, "part", "whole")


def dedup_rooms(rooms: DataFrame) -> DataFrame:
    """Across sheets: the first room of each number and level; of the unnumbered ones the first of each name and
    level, without those that a numbered room covers: one of the same name, one whose name contains theirs, one
    of several words that theirs contains, or, for restrooms and corridors, any of that kind."""
    low = lambda c: F.lower(F.trim(F.coalesce(F.col(c), F.lit(""))))
    base = rooms.withColumns({"_number": low("room_number"), "_name": low("room_name"), "_level": low("level")})
    numbered = first_per_key(base.filter("_number <> ''"), [*JOB, "_number", "_level"])
    plain = first_per_key(base.filter("_number = ''"), [*JOB, "_name", "_level"])
    has = kept(numbered.select(*JOB, "_name").distinct(), "numbered-names")
    asks = kept(plain.select(*JOB, "_name").distinct(), "plain-names")
    kinds = has.groupBy(*JOB).agg(F.bool_or(F.col("_name").rlike(RESTROOM_WORDS)).alias("_restroom"), F.bool_or(F.col("_name").rlike("corridor|hallway")).alias("_corridor"))
    within = _inside(asks.withColumnRenamed("_name", "part"), has.withColumnRenamed("_name", "whole")).select(*JOB, F.col("part").alias("_name"))
    around = _inside(has.filter(F.contains("_name", F.lit(" "))).withColumnRenamed("_name", "part"), asks.withColumnRenamed("_name", "whole")).select(*JOB, F.col("whole").alias("_name"))
    name = F.col("_name")
    of_kind = asks.filter(name.rlike(RESTROOM_WORDS) | name.isin("hallway", "hall", "corridor")).join(kinds.hint("merge"), JOB)
    of_kind = of_kind.filter((F.col("_restroom") & name.rlike(RESTROOM_WORDS)) | (F.col("_corridor") & name.isin("hallway", "hall", "corridor"))).select(*JOB, "_name")
    covered = asks.join(has.hint("merge"), [*JOB, "_name"], "left_semi").unionByName(within).unionByName(around).unionByName(of_kind).distinct()
    return numbered.select(*rooms.columns).unionByName(plain.join(covered.hint("merge"), [*JOB, "_name"], "left_anti").select(*rooms.columns))
