"""Registered queries of classification and rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from wayfind import vocab
from wayfind.functions import text
from wayfind.operators import rules
from wayfind.sources import views
from wayfind.sources.views import Views


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def has(column: str, pattern: str) -> str:
    return f"regexp_matches({column}, {quoted(pattern)})"


def sql_in(values) -> str:
    return "(" + ", ".join(quoted(v) for v in values) + ")"


def sql_map(column: str, table: dict, default: str) -> str:
    value = lambda v: quoted(v) if isinstance(v, str) else str(v).lower()
    return f"CASE {column} " + " ".join(f"WHEN {quoted(k)} THEN {value(v)}" for k, v in table.items()) + f" ELSE {default} END"


LEVEL = f"""CASE WHEN coalesce(level, '') = '' THEN 'LEVEL 1'
 WHEN {has("upper(trim(level))", r"^LEVEL\s+\S+$|^(?:MEZZANINE|ROOF|PARKING|LEVEL B\d+)$")} THEN upper(trim(level))
 WHEN regexp_extract(upper(trim(level)), '^(?:LEVEL|FLOOR|FL|L)\\s*[-–]?\\s*(\\w+)$', 1) <> '' THEN concat('LEVEL ', regexp_extract(upper(trim(level)), '^(?:LEVEL|FLOOR|FL|L)\\s*[-–]?\\s*(\\w+)$', 1))
 WHEN {has("trim(level)", r"^\d+$")} THEN concat('LEVEL ', trim(level))
 WHEN {has("upper(trim(level))", "^FIRST|^1ST|^GROUND")} THEN 'LEVEL 1' WHEN {has("upper(trim(level))", "^SECOND|^2ND")} THEN 'LEVEL 2'
 WHEN {has("upper(trim(level))", "BASEMENT|LOWER LEVEL|^B1$")} THEN 'LEVEL B1' ELSE upper(trim(level)) END"""

NAME = "upper(room_name)"
FLAGS = f"""flagged AS (SELECT * REPLACE ({LEVEL} AS level), {has("trim(room_name)", vocab.DOOR_ENTRY)} AS is_door_schedule_entry,
 {has(NAME, vocab.RESTROOM)} AS is_restroom,
 {has(NAME, vocab.STAIR)} AND NOT ({has(NAME, vocab.STAIR_LAST_WORD)} AND NOT {has(NAME, vocab.STAIR_QUALIFIED)} OR {has(NAME, vocab.STAIR_AFTER_OTHER)}) AS is_stair,
 {has(NAME, vocab.ELEVATOR)} AS is_elevator, {has(NAME, vocab.VESTIBULE)} AS is_vestibule, {has(NAME, vocab.CORRIDOR)} AS is_corridor,
 {has(NAME, vocab.VEHICLE_BAY)} AS is_vehicle_bay, {has(NAME, vocab.MEP)} AS is_mep, {has(NAME, vocab.VARIABLE_USE)} AS is_variable_use,
 {has(NAME, vocab.PUBLIC_FACING)} AS is_public, {has(NAME, vocab.ASSEMBLY)} AS is_assembly,
 NOT {has("trim(room_name)", vocab.DOOR_ENTRY)} AND NOT {has("upper(trim(room_name))", vocab.UNIT_DOOR_CODE)} AND {has(NAME, vocab.RESIDENTIAL_UNIT)} AS is_unit
 FROM rooms)"""

_KNOWN = sql_in(t for t in vocab.TRAITS if t != "unknown")
DETECTED = f"""name_facts AS (SELECT tenant_id, job_id, avg(CASE WHEN {has(NAME, vocab.UNIT_NAMED)} THEN 1.0 ELSE 0.0 END) AS units,
 bool_or({has(NAME, vocab.HOTEL_ROOM)}) AND bool_or({has(NAME, vocab.HOTEL_LOBBY)}) AND bool_or({has(NAME, vocab.HOTEL_DESK)}) AS hotel,
 {", ".join(f"bool_or({has(NAME, p)}) AS by_{k}" for k, p in vocab.TYPE_WORDS)} FROM rooms GROUP BY 1, 2),
detected AS (SELECT j.tenant_id, j.job_id, CASE WHEN lower(trim(building_type)) IN {_KNOWN} THEN lower(trim(building_type))
 WHEN units > 0.3 THEN 'residential' WHEN hotel THEN 'hotel' {" ".join(f"WHEN by_{k} THEN '{k}'" for k, _ in vocab.TYPE_WORDS)} ELSE 'commercial' END AS detected
 FROM jobs j LEFT JOIN name_facts USING (tenant_id, job_id))"""

_TRAITS = ("has_units", "mep_policy", "assembly_rules", "has_directory", "elevator_mode", "area_of_rescue")
_DEFAULT = ("false", "'occupied_only'", "true", "true", "'per_building'", "false")
UNIT = f"(is_unit OR (detected IN {sql_in(vocab.UNIT_SIGN_TYPES)} AND {has('upper(trim(room_number))', '^[0-9]{2,4}[A-Z]$')}) OR (detected = 'residential' AND {has('trim(room_number)', '^[0-9]{3,4}$')}))"
PREPARED = f"""typed AS (SELECT f.*, d.detected, {", ".join(f"{sql_map('d.detected', {t: v[i] for t, v in vocab.TRAITS.items()}, _DEFAULT[i])} AS {n}" for i, n in enumerate(_TRAITS))},
 {sql_map("d.detected", vocab.ALIASES, "d.detected")} AS type_group FROM flagged f JOIN detected d USING (tenant_id, job_id)),
facts AS (SELECT tenant_id, job_id, greatest(count(DISTINCT CASE WHEN trim(level) <> '' THEN level END), 1) AS floors, count(*) AS n_rooms,
 any_value(has_directory) AND (count(CASE WHEN {has("upper(trim(room_name))", vocab.SUITE)} THEN 1 END) >= 3 OR count(CASE WHEN NOT is_mep AND NOT is_door_schedule_entry THEN 1 END) > 30 AND bool_or({has("upper(trim(room_name))", vocab.LOBBY_OR_ENTRY)})) AS directory_eligible,
 count(CASE WHEN {has("upper(trim(room_name))", vocab.UNIT_OR_APT)} THEN 1 END) >= 5 AND count(CASE WHEN {has("upper(trim(room_name))", vocab.UNIT_OR_APT)} THEN 1 END) / count(*) >= 0.3 AS unit_dominant,
 any_value(detected) IN {sql_in(vocab.RESIDENTIAL_TYPES)} AND count(CASE WHEN {UNIT} THEN 1 END) >= 5 AND count(CASE WHEN {UNIT} THEN 1 END) / count(*) >= 0.3 AS residential_scope
 FROM typed GROUP BY 1, 2),
ready AS (SELECT * FROM typed JOIN facts USING (tenant_id, job_id))"""

_DOORS = f"(CASE WHEN {has(NAME, vocab.MULTI_ENTRY)} THEN 3 ELSE 1 END)"
_LOAD = "coalesce(occupant_load, 0)"
_PLACE = f"directory_eligible AND {has(NAME, chr(92) + 'bLOBBY' + chr(92) + 'b')} AND NOT {has(NAME, 'CORRIDOR|HALL|VEST|OFFICE|JAN')}"
_MAIN = f"(upper(trim(room_name)) = 'LOBBY' OR (is_public AND {has('upper(trim(room_name))', '^LOBBY' + chr(92) + 'b')}))"
_CAPACITY = f"assembly_rules AND is_assembly AND {has('lower(room_name)', vocab.CAPACITY)} AND {_LOAD} >= 50"
_EXIT_OPEN = "NOT is_mep AND (assembly_rules OR is_vestibule OR is_public)"
ROOM_SIGNS = f"""open_rooms AS (SELECT * FROM ready WHERE NOT is_door_schedule_entry AND NOT {has(NAME, vocab.SCHEDULE_ROW)} AND NOT ({has("upper(level)", vocab.MEZZANINE)} AND is_mep)
 AND NOT ({has("upper(trim(room_name))", vocab.UNIT_OR_APT)} AND NOT (detected IN {sql_in(vocab.UNIT_SIGN_TYPES)} OR type_group IN {sql_in(vocab.UNIT_SIGN_TYPES)}) AND NOT unit_dominant)),
room_id AS (SELECT *, CASE WHEN is_corridor THEN NULL WHEN residential_scope AND NOT {UNIT} AND NOT {has(NAME, vocab.RESIDENTIAL_COMMON)} AND NOT is_mep THEN NULL
 WHEN is_vehicle_bay AND {_DOORS} >= 3 THEN 'R3' WHEN is_vehicle_bay THEN NULL
 WHEN is_mep AND (mep_policy = 'minimal' OR mep_policy = 'occupied_only' AND {_LOAD} = 0) THEN NULL WHEN is_stair OR is_elevator THEN NULL
 WHEN NOT {has(NAME, vocab.DORM)} AND NOT is_variable_use AND {_DOORS} > 1 THEN 'R3'
 WHEN is_variable_use AND NOT {has(NAME, vocab.DORM)} AND assembly_rules THEN 'R2'
 WHEN {UNIT} AND has_units AND detected IN {sql_in(vocab.UNIT_SIGN_TYPES)} THEN 'R16' ELSE 'R1' END AS own_rule FROM open_rooms),
inserted AS (SELECT *, coalesce(own_rule = 'R2', false) AS insert_own, {_CAPACITY} AS insert_capacity FROM room_id),
room_signs AS (
 SELECT tenant_id, job_id, seq, 'Room ID' AS sign_type, CASE own_rule WHEN 'R3' THEN {_DOORS} ELSE 1 END AS qty, own_rule AS rule_ref, CASE own_rule WHEN 'R3' THEN 0.6 ELSE 0.85 END AS confidence FROM inserted WHERE own_rule IN ('R1', 'R3', 'R16') AND NOT insert_capacity
 UNION ALL SELECT tenant_id, job_id, seq, 'Room ID w/insert', CASE WHEN room_name LIKE '%/%' OR {has(NAME, vocab.ASSEMBLY)} THEN 2 ELSE 1 END, 'R2', 0.8 FROM inserted WHERE insert_own
 UNION ALL SELECT tenant_id, job_id, seq, 'Room ID w/insert', CASE WHEN is_variable_use THEN 2 ELSE 1 END, 'R2', 0.8 FROM inserted WHERE insert_capacity AND NOT insert_own
 UNION ALL SELECT tenant_id, job_id, seq, 'Max Occupancy', CASE WHEN is_variable_use THEN 2 ELSE 1 END, 'R10', 0.8 FROM inserted WHERE insert_capacity
 UNION ALL SELECT tenant_id, job_id, seq, CASE WHEN {has(NAME, vocab.WOMENS)} THEN 'Restroom(Women)' WHEN {has(NAME, vocab.MENS)} THEN 'Restroom(Men)' ELSE 'Restroom' END, 1, 'R8', 0.9 FROM inserted WHERE is_restroom AND NOT is_corridor
 UNION ALL SELECT tenant_id, job_id, seq, t.sign_type, 1, 'R9', 0.8 FROM inserted, (VALUES ('Exit'), ('Exit(Tactile)')) AS t(sign_type) WHERE {_EXIT_OPEN} AND is_vestibule
 UNION ALL SELECT tenant_id, job_id, seq, 'Exit', 1, 'R9', 0.75 FROM inserted WHERE {_EXIT_OPEN} AND NOT is_vestibule AND is_public AND NOT is_corridor
 UNION ALL SELECT tenant_id, job_id, seq, 'Exit', 2, 'R9', 0.8 FROM inserted WHERE {_EXIT_OPEN} AND NOT is_vestibule AND NOT (is_public AND NOT is_corridor) AND is_assembly AND {_LOAD} >= 50
 UNION ALL SELECT tenant_id, job_id, seq, 'Office Directory', 1, 'R14', 0.75 FROM inserted WHERE {_PLACE}
 UNION ALL SELECT tenant_id, job_id, seq, t.sign_type, 1, 'R14', 0.75 FROM inserted, (VALUES ('Building ID'), ('Accessible Entrance')) AS t(sign_type) WHERE {_PLACE} AND {_MAIN})"""

_STAIR = f"(is_stair OR {'CASE type_group ' + ' '.join(f'WHEN {quoted(k)} THEN ' + has('upper(trim(room_number))', p) for k, p in vocab.STAIR_NUMBER.items()) + ' ELSE false END'})"
STAIRS = f"""cores AS (SELECT tenant_id, job_id, upper(coalesce(nullif(trim(room_number), ''), substring(room_name, 1, 30))) AS core, any_value(floors) AS floors, any_value(has_directory) AS d, any_value(area_of_rescue) AS a FROM ready WHERE {_STAIR} GROUP BY 1, 2, 3),
stair_signs AS (SELECT tenant_id, job_id, core, t.sign_type, floors AS qty, 'R11' AS rule_ref, t.confidence FROM cores, (VALUES ('Stair(Corridor)', 0.8), ('Stair(Landing)', 0.85), ('Exit(Tactile)', 0.8)) AS t(sign_type, confidence)
 UNION ALL SELECT tenant_id, job_id, core, 'Office Directory', 1, 'R14', 0.75 FROM cores WHERE d UNION ALL SELECT tenant_id, job_id, core, 'Area of Rescue', floors, 'R16', 0.85 FROM cores WHERE a)"""
ELEVATORS = """cabs AS (SELECT tenant_id, job_id, upper(room_number) AS cab, count(DISTINCT level) AS levels, min(seq) AS first_seq, arg_min(level, seq) AS first_level, any_value(elevator_mode) AS mode FROM ready WHERE is_elevator GROUP BY 1, 2, 3),
elevator_signs AS (SELECT tenant_id, job_id, '' AS cab, 'Elevator' AS sign_type, CAST(count(*) AS INT) AS qty, 'R12' AS rule_ref, 0.85 AS confidence, arg_min(first_level, first_seq) AS floor_label FROM cabs WHERE mode = 'per_building' GROUP BY 1, 2
 UNION ALL SELECT tenant_id, job_id, cab, 'Elevator', CAST(levels AS INT), 'R12', 0.8, CASE WHEN levels = 1 THEN first_level ELSE '' END FROM cabs WHERE mode <> 'per_building')"""
MAPS = f"""evac AS (SELECT tenant_id, job_id, detected, type_group, floors, n_rooms, count(DISTINCT CASE WHEN {has(NAME, vocab.EDUCATION_ANCHOR)} OR is_corridor THEN level END) AS anchored,
 count(DISTINCT CASE WHEN {has(NAME, vocab.EXIT_CLUSTER)} THEN level END) AS clustered FROM ready GROUP BY ALL),
maps AS (SELECT tenant_id, job_id, CAST(least(CASE WHEN detected IN {sql_in(vocab.RESIDENTIAL_TYPES)} THEN least(floors, ceil(n_rooms / 20)) WHEN detected IN {sql_in(vocab.EDUCATION_TYPES)} THEN least(floors * 2, 4)
 ELSE floors * coalesce({sql_map("type_group", vocab.EVAC_MAPS_PER_FLOOR, "NULL")}, CASE WHEN floors >= 6 THEN 2 ELSE 1 END) END,
 CASE WHEN detected IN {sql_in(vocab.EDUCATION_TYPES)} AND anchored > 0 THEN anchored ELSE clustered END) AS INT) AS maps FROM evac WHERE floors >= 2 OR n_rooms >= 20)"""
EXITS = f"""stair_rooms AS (SELECT tenant_id, job_id, type_group, floors, count(CASE WHEN {_STAIR} THEN 1 END) AS stairs FROM ready GROUP BY ALL),
exit_signs AS (SELECT tenant_id, job_id, 'Exit' AS sign_type, CAST(stairs * floors AS INT) AS qty, 'R9' AS rule_ref, 0.8 AS confidence FROM stair_rooms WHERE stairs > 0
 UNION ALL SELECT tenant_id, job_id, 'Exit', {sql_map("type_group", vocab.EXTERIOR_EXITS, "4")}, 'R9', 0.65 FROM stair_rooms)"""
ALL = f"{views.SQL}, {FLAGS}, {DETECTED}, {PREPARED}"
_STATUS = f"CASE WHEN confidence >= 0.7 THEN 'auto' ELSE 'needs_review' END AS status, sign_type IN {sql_in(vocab.ADA_REQUIRED)} AS ada_required"


def _ready(spark, sf_dir):
    v = Views(spark, sf_dir)
    return rules.prepared(v.rooms, v.jobs)


FLAG_NAMES = ["is_door_schedule_entry", "is_restroom", "is_stair", "is_elevator", "is_vestibule", "is_corridor", "is_vehicle_bay", "is_mep", "is_variable_use", "is_public", "is_assembly", "is_unit"]


def _quantities(spark, sf_dir):
    v = Views(spark, sf_dir)
    return rules.sign_quantities(rules.apply_rules(v.rooms, v.jobs))


def _doors(spark, sf_dir):
    """Every thirteenth room states its doors; tenants list a few words of their own."""
    v, seq = Views(spark, sf_dir), F.col("seq")
    rooms = v.rooms.withColumn("public_door_count", F.when(seq % 13 == 0, 2).when(seq % 13 == 1, 1).when(seq % 13 == 2, 0))
    words = v.jobs.select("tenant_id", F.explode(F.when(F.col("tenant_id") < "t3", F.array(F.lit(" office "), F.lit("/ Comm"))).otherwise(F.array(F.lit(""), F.lit("X2")))).alias("keyword"))
    return rules.door_counts(rooms, words).select("seq", F.col("_doors").alias("doors"))


QUERIES = {
    "b1_room_flags": (lambda s, d: rules.classify_rooms(Views(s, d).rooms).select("seq", "level", *FLAG_NAMES), f"WITH {views.SQL}, {FLAGS} SELECT seq, level, {', '.join(FLAG_NAMES)} FROM flagged"),
    "d8_building_type": (lambda s, d: rules.detect_building_type(Views(s, d).rooms, Views(s, d).jobs), f"WITH {views.SQL}, {DETECTED} SELECT * FROM detected"),
    "e2_e9_room_signs": (lambda s, d: rules.room_signs(_ready(s, d)), f"WITH {ALL}, {ROOM_SIGNS} SELECT tenant_id, job_id, seq, sign_type, CAST(qty AS INT) AS qty, rule_ref, CAST(confidence AS DOUBLE) AS confidence, {_STATUS} FROM room_signs"),
    "e3_doors": (
        _doors,
        f"""WITH {views.SQL} SELECT seq, CAST(CASE WHEN seq % 13 = 0 THEN 2 WHEN seq % 13 = 1 THEN 1 WHEN {has(NAME, vocab.MULTI_ENTRY)} THEN 3
 WHEN tenant_id < 't3' AND {has(NAME, chr(92) + 'bOFFICE' + chr(92) + 'b|/ COMM' + chr(92) + 'b')} THEN 3 ELSE 1 END AS INT) AS doors FROM rooms""",
    ),
    "e12_stair_signs": (lambda s, d: rules.stair_signs(_ready(s, d)), f"WITH {ALL}, {STAIRS} SELECT tenant_id, job_id, core, sign_type, CAST(qty AS INT) AS qty, rule_ref, CAST(confidence AS DOUBLE) AS confidence, {_STATUS} FROM stair_signs"),
    "e13_elevator_signs": (lambda s, d: rules.elevator_signs(_ready(s, d)), f"WITH {ALL}, {ELEVATORS} SELECT tenant_id, job_id, cab, sign_type, qty, rule_ref, CAST(confidence AS DOUBLE) AS confidence, floor_label, {_STATUS} FROM elevator_signs"),
    "e14_evacuation_maps": (lambda s, d: rules.evacuation_maps(_ready(s, d)), f"WITH {ALL}, {MAPS} SELECT * FROM maps WHERE maps > 0"),
    "e15_formula_exits": (lambda s, d: rules.formula_exits(_ready(s, d)), f"WITH {ALL}, {EXITS} SELECT tenant_id, job_id, sign_type, qty, rule_ref, CAST(confidence AS DOUBLE) AS confidence, {_STATUS} FROM exit_signs"),
    "e16_apply_rules": (
        _quantities,
        f"""WITH {ALL}, {ROOM_SIGNS}, {STAIRS}, {ELEVATORS}, {MAPS}, {EXITS},
every_sign AS (SELECT tenant_id, job_id, sign_type, qty FROM room_signs UNION ALL SELECT tenant_id, job_id, sign_type, qty FROM stair_signs UNION ALL SELECT tenant_id, job_id, sign_type, qty FROM elevator_signs
 UNION ALL SELECT tenant_id, job_id, 'Evacuation Map', 1 FROM (SELECT tenant_id, job_id, unnest(range(1, maps + 1)) FROM maps WHERE maps > 0) UNION ALL SELECT tenant_id, job_id, sign_type, qty FROM exit_signs)
SELECT tenant_id, job_id, sign_type, CAST(sum(qty) AS BIGINT) AS qty, count(*) AS n_lines FROM every_sign GROUP BY 1, 2, 3""",
    ),
}
