"""Registered queries of schedule tables, takeoff files and rows of schedules.

The cell tables are made of the schedule's rows; the SQL twins state the flat result from the same rows.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from wayfind import vocab
from wayfind.operators import pricing, rules, schedules
from wayfind.plans.rules import has, quoted, sql_map
from wayfind.sources import views
from wayfind.sources.views import Views


def _run(f):
    return lambda s, d: f(Views(s, d))


def _seq() -> F.Column:
    return F.col("seq")


def _pick(values: list[str], by) -> F.Column:
    return F.get(F.array(*map(F.lit, values)), by.cast("int"))


def _sql_pick(values: list[str], by: str) -> str:
    return f"CASE {by} " + " ".join(f"WHEN {i} THEN {quoted(v)}" for i, v in enumerate(values)) + " END"


def _table(rows, *heads: list[str]):
    """A table for each sheet: a title row, the heads from row 1 on, the schedule's rows from row 5 on."""
    keys = rows.select(*rules.JOB, "sheet_id").distinct()
    every = [["a title over the table"], *heads]
    top = keys.select("*", F.posexplode(F.array(*(F.array(*map(F.lit, h)) for h in every))).alias("row_idx", "cells"))
    both = top.unionByName(rows.select(*rules.JOB, "sheet_id", (_seq() + 5).alias("row_idx"), "cells"))
    return both.withColumn("table_idx", F.lit(0)).withColumn("row_idx", F.col("row_idx").cast("long"))


CODES = ["BB2A", " bb 3 ", "Custom", ""]
COUNTS = ["1,204", "12", "0", "x", " 7 "]
KINDS = ["Room ID", "GRAND TOTAL", "Exit", "Sub-total row"]


def _by_room(v):
    s = v.schedule.withColumn("cells", F.array(F.concat(F.lit("S"), _seq().cast("string")), "room_number", "room_name", F.lit("hello"), _pick(CODES, _seq() % 4), F.when(_seq() % 3 == 0, "sign").otherwise(F.concat(F.lit("T"), _seq().cast("string"))), F.lit(None).cast("string"), F.lower("room_name"), F.lit("m"), _pick(CODES, (_seq() + 1) % 4)))
    cells = _table(s, ["SIGN", "ROOM NO.", "ROOM NAME", "VERBAGE", "TYPE", "SIGN NO.", "ROOM\nNUMBER", "ROOM NAME", "MESSAGE", "TYPE NO."])
    return schedules.schedule_from_tables(cells).select(*rules.JOB, "sheet_id", "part", "sign_id", "room_number", "room_name", "sign_type", "message")


def _counted(v):
    s = v.schedule.withColumn("cells", F.array(_pick(KINDS, _seq() % 4), F.when(_seq() % 3 != 0, "M").otherwise(""), _pick(COUNTS, _seq() % 5)))
    cells = _table(s, ["ROOM", "TYPE", "COUNT"], ["Signage\nType", "Type  Mark", "Count"])
    return schedules.schedule_from_count_tables(cells).select(*rules.JOB, "sheet_id", "row_idx", "sign_type", "type_mark", "quantity")


def _loose(v):
    s = v.schedule.withColumn("cells", F.array(F.lit("hall"), "room_name", "room_number", F.when(_seq() % 7 == 0, "").otherwise(F.col("sign_type")), F.when(_seq() % 5 == 0, "n/a").otherwise(F.concat("quantity", F.lit(" ea")))))
    cells = _table(s, ["Location", "Room Name", "Room #", "Sign Type", "Qty"])
    return schedules.schedule_from_loose_tables(cells).select(*rules.JOB, "sheet_id", "row_idx", "room_number", "room_name", "sign_type", "quantity", "notes")


def _finishes(v):
    s = v.rooms.withColumn("cells", F.array("room_number", F.concat("room_name", _pick(["", " TILE-3 P-1", " match ex", " LVT-"], _seq() % 4))))
    return schedules.rooms_from_finish_schedule(_table(s, ["NO.", "ROOM NAME"], ["ROOM FINISH SCHEDULE"])).select(*rules.JOB, "sheet_id", "row_idx", "room_number", "room_name")


def _lines(v):
    return pricing.room_lines(v.signs.drop("room_number", "room_name"), v.rooms)


def _exported(v):
    rows = schedules.export_rows(_lines(v)).withColumn("Qty", F.when(_seq() % 9 == 0, "—").otherwise(F.col("Qty").cast("string")))
    total = rows.filter(_seq() % 10 == 0).withColumns({"Room #": F.lit("Subtotal"), "seq": -_seq()})
    return schedules.rooms_and_signs_of_export(rows.unionByName(total))


DESCRIBED = ["GIRLS TOILET SIGN", "BOYS RESTROOM", "UNISEX RESTROOM", "ACCESSIBLE TOILET", "STAFF RESTROOM", "ROOM ID", "ENTRANCE SIGN", "STAIR SIGN", "ELEVATOR", "EXIT", "NOTHING KNOWN"]


def _definitions(v):
    """One definition a job and code; plain schedule rows (with numbers) beside them are no definitions."""
    job = F.substring("job_id", 2, 20).cast("long")
    coded = v.jobs.select(*rules.JOB, F.explode(F.array(F.lit(0), F.lit(1))).alias("k")).select(*rules.JOB, (job * 2 + F.col("k")).alias("seq"), F.lit("").alias("room_number"), _pick(DESCRIBED, (job * 2 + F.col("k")) % 11).alias("room_name"), F.when(F.col("k") == 0, "a").otherwise("B1").alias("sign_type"))
    return coded.unionByName(v.schedule.filter("room_number <> ''").select(*rules.JOB, "seq", "room_number", "room_name", "sign_type"))


_ROOM = "upper(room_name)"
_CLASSES = {
    "girls": f"{has(_ROOM, vocab.DEF_GIRLS)} AND {has(_ROOM, vocab.DEF_RESTROOM)}",
    "boys": f"{has(_ROOM, vocab.DEF_BOYS)} AND {has(_ROOM, vocab.DEF_RESTROOM)}",
    "unisex": f"({has(_ROOM, vocab.DEF_UNISEX)} OR {has(_ROOM, vocab.DEF_RESTROOM)} AND NOT {has(_ROOM, vocab.DEF_GIRLS)} AND NOT {has(_ROOM, vocab.DEF_BOYS)})",
    "restroom": has(_ROOM, vocab.DEF_RESTROOM),
    "room": f"NOT {has(_ROOM, vocab.DEF_RESTROOM)} AND NOT {has(_ROOM, vocab.DEF_NOT_ROOM)}",
    "entrance": has(_ROOM, vocab.DEF_ENTRANCE_ROOM),
    "stair": has(_ROOM, r"\bSTAIR\b"),
    "elevator": has(_ROOM, r"\b(?:ELEVATOR|LIFT)\b"),
    "exit": has(_ROOM, r"\bEXIT\b"),
}
#: What each description of the list means, told literally.
_MEANS = dict(zip(DESCRIBED, ["girls", "boys", "unisex", "unisex", "restroom", "room", "entrance", "stair", "elevator", "exit"]))
_CODE = lambda column: f"CASE {column} WHEN 'BB2A' THEN 'Room ID' WHEN ' bb 3 ' THEN 'Stair(Landing)' ELSE trim({column}) END"
_LINES = """lines AS (SELECT s.tenant_id, s.job_id, s.seq, s.sign_type, coalesce(s.qty, 1) AS qty, coalesce(nullif(r.level, ''), s.floor_label) AS raw_level, coalesce(r.room_number, '') AS room_number, coalesce(r.room_name, '') AS room_name
 FROM (SELECT tenant_id, job_id, seq, room_seq, sign_type, qty, floor_label FROM signs WHERE NOT is_deleted) s LEFT JOIN rooms r ON r.seq = s.room_seq)"""
_SHOWN = "CASE WHEN coalesce(raw_level, '') = '' THEN 'Unspecified Floor' WHEN lower(trim(raw_level)) = 'basement' THEN 'Basement' ELSE upper(trim(raw_level)) END"

QUERIES = {
    "a6_schedule_tables": (
        _run(_by_room),
        f"""WITH {views.SQL}, c AS (SELECT *, {_sql_pick(CODES, "seq % 4")} AS one, {_sql_pick(CODES, "(seq + 1) % 4")} AS two FROM schedule)
SELECT tenant_id, job_id, sheet_id, 0 AS part, concat('S', seq) AS sign_id, trim(room_number) AS room_number, trim(room_name) AS room_name, {_CODE("one")} AS sign_type, 'hello' AS message FROM c WHERE one <> ''
UNION ALL SELECT tenant_id, job_id, sheet_id, 1, concat('T', seq), '', lower(trim(room_name)), {_CODE("two")}, 'm' FROM c WHERE two <> '' AND seq % 3 <> 0""",
    ),
    "a7_count_tables": (
        _run(_counted),
        f"""WITH {views.SQL}, c AS (SELECT *, {_sql_pick(KINDS, "seq % 4")} AS kind, CASE seq % 5 WHEN 0 THEN 1204 WHEN 1 THEN 12 WHEN 4 THEN 7 END AS n FROM schedule)
SELECT tenant_id, job_id, sheet_id, seq + 5 AS row_idx, kind AS sign_type, CASE WHEN seq % 3 <> 0 THEN 'M' END AS type_mark, n AS quantity FROM c WHERE kind IN ('Room ID', 'Exit') AND n IS NOT NULL""",
    ),
    "a8_loose_tables": (
        _run(_loose),
        f"WITH {views.SQL} SELECT tenant_id, job_id, sheet_id, seq + 5 AS row_idx, trim(room_number) AS room_number, trim(room_name) AS room_name, sign_type, CASE WHEN seq % 5 = 0 THEN 1 ELSE quantity END AS quantity, 'hall' AS notes FROM schedule WHERE seq % 7 <> 0",
    ),
    "a9_finish_schedule": (
        _run(_finishes),
        f"WITH {views.SQL} SELECT tenant_id, job_id, sheet_id, seq + 5 AS row_idx, room_number, concat(room_name, CASE WHEN seq % 4 = 3 THEN ' LVT-' ELSE '' END) AS room_name FROM rooms WHERE regexp_matches(room_number, '^[0-9]')",
    ),
    "f1_room_lines": (_run(lambda v: _lines(v).select("seq", "level", "room_number", "room_name", "qty")), f"WITH {views.SQL}, {_LINES} SELECT seq, {_SHOWN} AS level, room_number, room_name, qty FROM lines"),
    "a10_export_rooms": (
        _run(lambda v: _exported(v)[0]),
        f"WITH {views.SQL}, {_LINES}, t AS (SELECT *, {_SHOWN} AS level FROM lines WHERE room_number <> '') SELECT tenant_id, job_id, room_number, arg_min(room_name, seq) AS room_name, arg_min(level, seq) AS level FROM t GROUP BY 1, 2, 3",
    ),
    "a10_export_signs": (
        _run(lambda v: _exported(v)[1]),
        f"WITH {views.SQL}, {_LINES} SELECT tenant_id, job_id, seq, room_number, room_name, sign_type, CASE WHEN seq % 9 = 0 THEN 1 ELSE qty END AS qty, {_SHOWN} AS level FROM lines WHERE room_number <> ''",
    ),
    "c7_schedule_floors": (
        _run(lambda v: schedules.fill_schedule_floor(v.schedule.withColumns({"floor": F.when(_seq() % 3 == 0, F.col("floor")), "sign_type": F.when(_seq() % 11 == 0, "STAIR 1 LEVEL 04").when(_seq() % 13 == 0, "Unit b302").otherwise(F.col("sign_type"))}), v.rooms.filter(_seq() % 17 == 0)).select("seq", "floor")),
        f"""WITH {views.SQL}, f AS (SELECT tenant_id, job_id, upper(trim(room_number)) AS n, arg_min(level, seq) AS found FROM rooms WHERE seq % 17 = 0 AND level IS NOT NULL AND room_number <> '' GROUP BY 1, 2, 3)
SELECT seq, coalesce(CASE WHEN seq % 3 = 0 THEN nullif(floor, '') END, found, CASE WHEN seq % 11 = 0 THEN 'LEVEL 4' WHEN seq % 13 = 0 THEN 'LEVEL 3' END, 'LEVEL ' || nullif(regexp_extract(upper(trim(room_number)), '^[A-Z]([1-9])[0-9]', 1), '')) AS floor
FROM schedule s LEFT JOIN f ON s.tenant_id = f.tenant_id AND s.job_id = f.job_id AND f.n = upper(trim(s.room_number))""",
    ),
    "c9_type_definitions": (
        _run(lambda v: schedules.expand_type_definitions(_definitions(v), v.rooms).select("def_seq", "room_seq", "sign_type", "rule_ref")),
        f"""WITH {views.SQL}, d AS (SELECT tenant_id, job_id, CAST(substring(job_id, 2) AS BIGINT) * 2 + k AS def_seq, k FROM jobs, (VALUES (0), (1)) AS t(k)),
n AS (SELECT *, {_sql_pick(DESCRIBED, "def_seq % 11")} AS sign_type FROM d), m AS (SELECT *, {sql_map("sign_type", _MEANS, "NULL")} AS means FROM n)
SELECT def_seq, seq AS room_seq, sign_type, CASE k WHEN 0 THEN 'type_code_match:A' ELSE 'type_code_match:B1' END AS rule_ref FROM m JOIN rooms USING (tenant_id, job_id)
WHERE CASE means {" ".join(f"WHEN '{k}' THEN {c}" for k, c in _CLASSES.items())} ELSE false END""",
    ),
    "b24_type_codes": (_run(lambda v: v.schedule.select("seq", schedules.is_type_code(F.when(_seq() % 4 == 0, F.concat(F.lit(" type "), F.lit("B.1"))).when(_seq() % 4 == 1, F.lit("Type")).when(_seq() % 4 == 2, F.lit("Type A sign")).otherwise(F.concat(F.lit("TYPE "), "type_mark"))).alias("is_code"))), f"WITH {views.SQL} SELECT seq, seq % 4 = 0 OR seq % 4 = 3 AND type_mark IS NOT NULL AS is_code FROM schedule"),
}
