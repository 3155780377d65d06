"""The whole rules engine: rooms and jobs with a tenant's overrides and door keywords and the job's own type definitions, in
one fold that keeps what it drops; and re-ruling of stored jobs.

Rooms that are alike are one kind, and a kind's signs are one array of structs from the first rule to the last override; what
an override, the definitions or the canonical list take away stays with its reason, so signs and suppression log are two
filters of one table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfind import vocab
from wayfind.functions import text
from wayfind.operators.cleaning import place_on_sheets
from wayfind.operators.egress import DROPPED, overridden
from wayfind.operators.rules import JOB, aggregate_signs, asked, kinds_of_rooms, prepared_once, signed_rooms, with_kinds
from wayfind.sources.kept import discard, kept

_HAS = [f"_has{i}" for i in range(len(vocab.SUPPRESSED_UNLESS))]


def _told(definitions: DataFrame) -> DataFrame:
    """One row a job: which kinds of signs its definitions name, and what they call a Room ID (the last one that does).

    definitions: tenant_id, job_id, position, type_code, description.
    """
    said = F.upper(F.concat_ws(" ", F.col("type_code"), F.col("description")))
    room_id = F.lower(F.trim("description")).rlike(vocab.ROOM_ID_DESCRIPTION)
    alias = F.max(F.when(room_id, F.struct("position", F.concat(F.lit("Type "), "type_code").alias("alias"))))
    return definitions.groupBy(*JOB).agg(*(F.bool_or(said.rlike(p)).alias(h) for h, (_, p) in zip(_HAS, vocab.SUPPRESSED_UNLESS)), alias["alias"].alias("_alias"))


def _reason(sign: Column, units: Column, assembly: Column) -> Column:
    """Why a type may not stand, or null: the job's definitions first, then the canonical list."""
    unnamed = F.lit(False)
    for h, (types, _) in zip(_HAS, vocab.SUPPRESSED_UNLESS):
        unnamed = unnamed | (sign.isin(*types) & ~F.coalesce(h, F.lit(True)))
    return text.first_of((unnamed, "not in definitions"), (~F.coalesce(sign.isin(*vocab.CANONICAL), F.lit(False)), "not canonical"), ((sign == "Unit ID") & ~units, "no units here"), ((sign == "Max Occupancy") & ~assembly, "no assembly room"))


def _called(sign: Column) -> Column:
    """A sign's name in the job's own terms."""
    return F.coalesce(F.when(sign == "Room ID", F.col("_alias")), sign)


def rule_jobs(ready: DataFrame, overrides: DataFrame | None = None, definitions: DataFrame | None = None, exits: bool = True) -> DataFrame:
    """(tenant_id, job_id, room_seq, sign_type, qty, rule_ref, confidence, reason) of every sign that rules or overrides make;
    those with a reason do not stand. ready: prepared rooms (kept, for each kind of rule reads them).

    Order as in the field: rules, overrides, definitions, canonical list, then the job's own names.
    """
    numbers = kept(overrides.filter("c_number is not null").select("tenant_id", F.upper("c_number").alias("_number")).distinct(), "numbers") if overrides is not None else None
    if numbers is None or numbers.isEmpty():
        rooms, kinds = kinds_of_rooms(ready)
        kinds = kinds.withColumn("room_number", F.lit(None).cast("string"))
    else:
        # a room's number tells its kind only where an override asks for it
        numbered = ready.withColumn("_number", F.upper("room_number")).join(numbers.withColumn("_asked", F.lit(True)), ["tenant_id", "_number"], "left")
        rooms, kinds = kinds_of_rooms(numbered, {"room_number": F.when(F.col("_asked"), F.col("_number"))})
    kinds = signed_rooms(kinds).withColumn("job_id", F.lit(""))
    kinds = overridden(kinds, overrides) if overrides is not None else kinds.withColumn("dropped", F.array().cast(DROPPED))
    kind = F.col("detected")
    units = F.coalesce(kind.isin(*vocab.UNIT_SIGN_TYPES) | text.building_type_group(kind).isin(*vocab.UNIT_SIGN_TYPES), F.lit(False))
    stays = F.transform("signs", lambda x: F.struct(x["sign_type"].alias("sign_type"), x["qty"].alias("qty"), x["rule_ref"].alias("rule_ref"), x["confidence"].alias("confidence"), F.lit(None).cast("string").alias("reason")))
    kinds = kinds.withColumns({"_every": F.concat(stays.cast(DROPPED), "dropped"), "_units": units, "_assembly": F.coalesce("is_assembly", F.lit(False))})
    aggregate = aggregate_signs(ready, exits).withColumns({"_units": F.lit(True), "_assembly": F.lit(True), "reason": F.lit(None).cast("string")})
    if definitions is not None:
        told = kept(_told(definitions), "definitions")
        rooms, aggregate = rooms.join(told, JOB, "left"), aggregate.join(told, JOB, "left")
    else:
        none = {h: F.lit(None).cast("boolean") for h in _HAS} | {"_alias": F.lit(None).cast("string")}
        rooms, aggregate = rooms.withColumns(none), aggregate.withColumns(none)
    own = [*JOB, "room_seq", "sign_type", "qty", "rule_ref", "confidence", "reason"]
    per_room = with_kinds(rooms, kinds, "_every", "_units", "_assembly").select(*JOB, F.col("seq").alias("room_seq"), F.inline("_every"), "_units", "_assembly", *_HAS, "_alias")
    every = per_room.unionByName(aggregate.select(*own, "_units", "_assembly", *_HAS, "_alias"))
    every = every.withColumn("reason", F.coalesce("reason", _reason(F.col("sign_type"), F.col("_units"), F.col("_assembly"))))
    return every.withColumn("sign_type", F.when(F.col("reason").isNull(), _called(F.col("sign_type"))).otherwise(F.col("sign_type"))).select(*own)


def standing(ruled: DataFrame) -> DataFrame:
    """The signs that stand."""
    return ruled.filter("reason is null").drop("reason")


def suppressed(ruled: DataFrame) -> DataFrame:
    """The log of what does not: (tenant_id, job_id, room_seq, rule_ref, sign_type, reason)."""
    return ruled.filter("reason is not null").select(*JOB, "room_seq", "rule_ref", "sign_type", "reason")


# ---- re-ruling of stored jobs ----


def reruled(rooms: DataFrame, jobs: DataFrame, overrides: DataFrame, keywords: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(jobs that are ruled again, their new signs with sheet_id).

    Jobs that wait or run are left alone, and so are jobs without rooms. jobs: building_type, status; rooms: sheet_id and the
    level as stored, which finds the sheet. Exits by formula are no part of it.
    """
    again = kept(jobs.filter(~F.col("status").isin("processing", "pending")).join(rooms.select(*JOB).distinct(), JOB, "left_semi").select(*JOB, "building_type"), "jobs-again")
    own = rooms.join(again.select(*JOB), JOB, "left_semi")
    ready = prepared_once(asked(own), again, keywords, detect=False)
    made = kept(standing(rule_jobs(ready, overrides, exits=False)), "reruled")
    discard(ready)
    return again.select(*JOB), place_on_sheets(made, own)


STORED = [*JOB, "room_seq", "sign_type", "qty", "rule_ref", "confidence", "sheet_id", "source", "generation"]


def merge_ruled(stored: DataFrame, again: DataFrame, made: DataFrame, generation: int) -> DataFrame:
    """The stored signs (``STORED``) with those of the rules engine replaced, for the jobs in again, by made.

    Rows carry the number of the run that made them. What other sources gave stays. A job that has this generation already
    keeps its rows, so doing it twice changes nothing; older ones go, even where nothing new is made.
    """
    mine = F.coalesce("source", F.lit("")) == "rules_engine"
    done = stored.filter(mine & (F.col("generation") == generation)).select(*JOB).distinct()
    now = again.join(done, JOB, "left_anti").withColumn("_now", F.lit(True))
    rest = stored.join(now, JOB, "left").filter(~(mine & F.coalesce("_now", F.lit(False)))).select(*STORED)
    new = made.join(now, JOB, "left_semi").withColumns({"source": F.lit("rules_engine"), "generation": F.lit(generation).cast("long")})
    return rest.unionByName(new.select(*STORED))


def rerule_totals(again: DataFrame, made: DataFrame) -> DataFrame:
    """(tenant_id, job_id, signs_updated, total_qty) of the jobs that were ruled again."""
    sums = made.groupBy(*JOB).agg(F.count(F.lit(1)).alias("signs_updated"), F.sum(F.coalesce("qty", F.lit(1))).alias("total_qty"))
    return again.join(sums, JOB, "left").fillna(0, ["signs_updated", "total_qty"])
