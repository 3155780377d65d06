"""Registered queries of sheet types, categories, rescue and sign scopes."""

from __future__ import annotations

from pyspark.sql import functions as F

from wayfind import vocab
from wayfind.operators import dedup, drawings, rules, sheets
from wayfind.plans.rules import has, quoted, sql_in
from wayfind.plans.sheets import SHEETS_SQL, _files, _sheets
from wayfind.sources import views
from wayfind.sources.views import Views


def _run(f):
    return lambda s, d: f(Views(s, d))


NUMBERS = ["E-101", "A-102", "A0.1", "A-710", "3.9.51", "I-601", "IN-12", "A-405", "A-003", "S121", "A1", "X-9"]
TITLES = ["FLOOR PLAN LEVEL 2", "SIGN SCHEDULE", "REFLECTED CEILING PLAN", "TOILET ROOM PLANS", "ELUDEHCS NGIS", "DOOR SCHEDULE", "ROOM FINISH SCHEDULE", "BUILDING SECTION", "WALL DETAIL", "SIGNAGE DETAILS", "SITE PLAN", "LIFE SAFETY PLAN", "SIGNAGE AND GENERAL NOTES", "ENLARGED RESTROOM RCP", "IN116 ADMIN", "", "SIGNAGE PLAN", "EXTERIOR ELEVATION"]
KINDS = ["floor_plan", "signage_schedule", "other", None]
SLOTS = ["floor_plan", "room_schedule", "sign_schedule", "other", None]


def _title(t: F.Column) -> F.Column:
    return F.get(F.array(*map(F.lit, TITLES)), t.cast("int"))


def _drawn(v):
    """Sheets with numbers, titles and types of all sorts; every eighth job's titles are all of restrooms."""
    job, fl = F.substring("job_id", 2, 20).cast("long"), F.col("page") - 1
    title = F.when(job % 8 == 0, F.when(fl % 2 == 0, "TOILET ROOM PLANS").otherwise("ENLARGED RESTROOM RCP")).otherwise(_title((job * 3 + fl) % len(TITLES)))
    number = F.get(F.array(*map(F.lit, NUMBERS)), ((job + fl * 5) % len(NUMBERS)).cast("int"))
    kind = F.get(F.array(*(F.lit(k) for k in KINDS)), ((job + fl) % 4).cast("int"))
    return _sheets(v).withColumns({"title": title, "sheet_no": F.when(job % 8 == 0, F.concat(F.lit("A"), (job + fl).cast("string"))).otherwise(number), "sheet_type": kind})


def _slotted(v):
    job = F.substring("job_id", 2, 20).cast("long")
    return _files(v).withColumns({"file_category": F.get(F.array(*(F.lit(k) for k in SLOTS)), (job % 5).cast("int")), "floor_label": F.when(job % 2 == 0, "Floor 2")})


def _sql_list(values, by):
    return f"CASE {by} " + " ".join(f"WHEN {i} THEN {quoted(v)}" for i, v in enumerate(values) if v is not None) + " END"


def _any(c: str, words) -> str:
    return "(" + " OR ".join(f"contains({c}, {quoted(w)})" for w in words) + ")"


def _said(words) -> str:
    return f"({_any('lower(title)', words)} OR {_any('reverse(lower(title))', words)})"


_DRAWN = f"""drawn AS (SELECT tenant_id, job_id, sheet_id, file_id, page, CASE WHEN job % 8 = 0 THEN concat('A', job + page - 1) ELSE {_sql_list(NUMBERS, f"(job + (page - 1) * 5) % {len(NUMBERS)}")} END AS sheet_no,
 CASE WHEN job % 8 = 0 THEN CASE WHEN page % 2 = 1 THEN 'TOILET ROOM PLANS' ELSE 'ENLARGED RESTROOM RCP' END ELSE {_sql_list(TITLES, f"(job * 3 + page - 1) % {len(TITLES)}")} END AS title, {_sql_list(KINDS, "(job + page - 1) % 4")} AS sheet_type,
 {_sql_list(SLOTS, "job % 5")} AS file_category, job % 2 = 0 AS labelled FROM (SELECT *, CAST(substring(job_id, 2) AS BIGINT) AS job FROM sheets) x)"""
_TYPE = f"""CASE WHEN {_said(vocab.TITLE_SIGN_DETAILS)} THEN 'sign_details' WHEN {_said(vocab.TITLE_SIGN_SCHEDULE)} THEN 'signage_schedule' WHEN {_said(vocab.TITLE_EGRESS)} OR sheet_no = 'A-003' THEN 'egress'
 WHEN sheet_no = 'A-710' THEN 'signage_schedule' WHEN sheet_no = 'A-102' OR {has("sheet_no", "^A[123][0-9][0-9]")} THEN 'floor_plan' WHEN sheet_no = 'A-405' OR {has("sheet_no", "^A4[0-9][0-9]")} THEN 'interior_elevation' WHEN {has("sheet_no", "^A7[0-9][0-9]")} THEN 'signage_schedule' WHEN sheet_no LIKE 'A%' THEN 'other'
 WHEN sheet_no = '3.9.51' THEN CASE WHEN {_said(vocab.TITLE_NEVER_PLAN)} OR {_said(vocab.TITLE_OTHER_PLAN)} THEN 'other' ELSE 'floor_plan' END WHEN sheet_no = 'I-601' THEN 'signage_schedule' WHEN sheet_no = 'IN-12' THEN 'floor_plan'
 WHEN sheet_no = 'S121' AND title = 'IN116 ADMIN' THEN 'floor_plan' WHEN sheet_no IN ('S121', 'E-101') OR {_said(vocab.TITLE_NEVER_PLAN)} OR {_said(vocab.TITLE_OTHER_PLAN)} THEN 'other' WHEN {_said(vocab.TITLE_PLAN)} THEN 'floor_plan' ELSE 'other' END"""
_PLAN = "coalesce(sheet_type = 'floor_plan', false)"
_CATEGORY = f"""CASE WHEN {has("sheet_no", vocab.SHEET_DISCIPLINE)} THEN 'skip|discipline' WHEN {_any("title", vocab.SHEET_ROOM_SCHEDULE)} THEN 'room_schedule|title' WHEN {has("sheet_no", "^A-?7[0-9][0-9]$")} THEN 'room_schedule|number' WHEN {_any("title", vocab.SHEET_SKIP)} THEN 'skip|title'
 WHEN title = 'BUILDING SECTION' AND NOT {_PLAN} THEN 'skip|section' WHEN {_any("title", vocab.SHEET_SPECIALTY)} THEN 'sign_details|title' WHEN {_PLAN} THEN 'interior|type' WHEN coalesce(sheet_type = 'signage_schedule', false) THEN 'sign_docs|type' WHEN title = 'WALL DETAIL' THEN 'skip|detail'
 WHEN {has("sheet_no", "^A0")} THEN 'sign_docs|number' WHEN {_any("title", vocab.SHEET_SIGN_DOCS)} THEN 'sign_docs|title' WHEN {_any("title", vocab.SHEET_EXTERIOR)} THEN 'exterior|title' WHEN {has("sheet_no", "^A[-.]?[4-9][0-9][0-9]")} AND NOT {_any("title", vocab.SHEET_PLAN)} THEN 'skip|number'
 WHEN {has("sheet_no", "^A[-.]?[0-9]")} THEN 'interior|number' WHEN {_any("title", vocab.SHEET_PLAN)} THEN 'interior|title' ELSE 'skip|none' END"""
_CLASSIFIED = f"""classified AS (SELECT *, CASE WHEN file_category = 'room_schedule' THEN 'room_schedule|slot' WHEN file_category = 'sign_schedule' THEN 'sign_docs|slot' WHEN file_category = 'floor_plan' AND labelled THEN 'interior|slot' ELSE {_CATEGORY} END AS pair FROM drawn),
categories AS (SELECT *, split_part(pair, '|', 1) AS category, split_part(pair, '|', 2) AS reason FROM classified)"""
_RESCUED = f"""sets AS (SELECT tenant_id, job_id FROM drawn WHERE {has("sheet_no", "^A[0-9]")} GROUP BY 1, 2 HAVING avg(CASE WHEN {has("title", r"\b(?:TOILET|RESTROOM|LAVATORY|RR)\b")} THEN 1.0 ELSE 0.0 END) >= 0.5)"""


def _classified(v):
    return drawings.classify_sheets(_drawn(v), _slotted(v))


def _embedded(v):
    """First rows of each sheet's table: every third sheet's names sign columns."""
    n = F.col("page") % 3
    return _drawn(v).select(*rules.JOB, "sheet_id", F.lit(0).alias("table_idx"), F.lit(0).alias("row_idx"), F.when(n == 0, F.array(F.lit("Room #"), F.lit("the sign type"))).when(n == 1, F.array(F.lit("MESSAGE"), F.lit("x"))).otherwise(F.array(F.lit("a"))).alias("cells"))


def _scopes(v):
    job = F.substring("job_id", 2, 20).cast("long")
    return v.jobs.select(*rules.JOB, (job % 4 == 0).alias("restroom_only"), (job % 5 == 0).alias("schedule_first"), (job % 10 == 0).alias("dedicated_schedule"))


RULES = ["R1", "R9", "R16", "training_correction:7", None]


def _judged(v):
    signs = v.signs.select(*rules.JOB, "seq", "room_seq", F.when(F.col("seq") % 8 == 0, "Type B.1").otherwise(F.col("sign_type")).alias("sign_type"), F.get(F.array(*(F.lit(r) for r in RULES)), (F.col("seq") % 5).cast("int")).alias("rule_ref"))
    job = F.substring("job_id", 2, 20).cast("long")
    listed = v.jobs.filter(job % 3 == 0).select(*rules.JOB, F.explode(F.array(F.lit("Exit"), F.lit("Restroom"))).alias("sign_type"))
    flagged = rules.classify_rooms(v.rooms)
    return drawings.filter_signs(signs, flagged, _scopes(v), listed).select("seq")


def _notes(v):
    """A line of notes for each sign of every third job: its type in other letters and marks, or inside a longer word."""
    seq, kind = F.col("seq"), F.col("sign_type")
    line = F.when(seq % 5 == 0, F.concat(F.lit("1. provide "), F.lower(kind), F.lit(" signs, see A-101."))).when(seq % 5 == 1, F.concat(F.lit("TYPE: "), F.regexp_replace(kind, "[ (]", "-"))).when(seq % 5 == 2, F.concat(kind, F.lit("S AND MAPS"))).when(seq % 5 == 3, F.concat(kind, F.lit(" (Tactile)"))).otherwise(F.lit(None))
    return v.signs.filter(F.substring("job_id", 2, 20).cast("long") % 3 == 0).select(*rules.JOB, F.lit("n").alias("sheet_id"), seq.alias("line_no"), line.alias("line"))


def _noted(v):
    dictionary = v.spark.createDataFrame([(t,) for t in vocab.CANONICAL], "sign_type string")
    return drawings.types_in_notes(_notes(v), dictionary)


def _judged_by_notes(v):
    signs = v.signs.select(*rules.JOB, "seq", "room_seq", F.when(F.col("seq") % 8 == 0, "Type B.1").otherwise(F.col("sign_type")).alias("sign_type"), F.get(F.array(*(F.lit(r) for r in RULES)), (F.col("seq") % 5).cast("int")).alias("rule_ref"))
    return drawings.filter_signs(signs, rules.classify_rooms(v.rooms), _scopes(v), _noted(v)).select("seq")


_PHRASE = lambda c: f"concat(' ', trim(regexp_replace(upper({c}), '[^A-Z0-9]+', ' ', 'g')), ' ')"
_LONGEST = sorted(vocab.CANONICAL, key=lambda t: -len(t))
_NOTED = f"""notes AS (SELECT tenant_id, job_id, {_PHRASE("CASE seq % 5 WHEN 0 THEN concat('1. provide ', lower(sign_type), ' signs, see A-101.') WHEN 1 THEN concat('TYPE: ', regexp_replace(sign_type, '[ (]', '-', 'g')) WHEN 2 THEN concat(sign_type, 'S AND MAPS') WHEN 3 THEN concat(sign_type, ' (Tactile)') END")} AS line FROM signs WHERE CAST(substring(job_id, 2) AS BIGINT) % 3 = 0),
phrases AS (SELECT t, {_PHRASE("t")} AS p FROM (VALUES {", ".join(f"({quoted(t)})" for t in vocab.CANONICAL)}) AS c(t)),
inside AS (SELECT tenant_id, job_id, line, t, p FROM notes JOIN phrases ON contains(line, p)),
noted AS (SELECT DISTINCT tenant_id, job_id, t AS sign_type FROM inside i WHERE contains(replace(line, coalesce((SELECT max(o.p) FROM phrases o WHERE length(o.p) > length(i.p) AND contains(o.p, i.p) AND contains(i.line, o.p)), '#'), ' # '), p))"""

QUERIES = {
    "d7_note_types": (_run(_noted), f"WITH {views.SQL}, {_NOTED} SELECT * FROM noted"),
    "d7_noted_scope": (
        _run(_judged_by_notes),
        f"""WITH {views.SQL}, {_NOTED}, s AS (SELECT tenant_id, job_id, seq, room_seq, CAST(substring(job_id, 2) AS BIGINT) AS job, CASE WHEN seq % 8 = 0 THEN 'Type B.1' ELSE sign_type END AS sign_type, CASE seq % 5 WHEN 0 THEN 'R1' WHEN 1 THEN 'R9' WHEN 2 THEN 'R16' WHEN 3 THEN 'training_correction:7' ELSE '' END AS rule_ref FROM signs),
j AS (SELECT s.*, upper(r.room_name) AS room, {has("upper(r.room_name)", vocab.ELEVATOR)} AS is_elevator, jobs.job_id IS NOT NULL AS known, EXISTS (SELECT 1 FROM noted n WHERE n.tenant_id = s.tenant_id AND n.job_id = s.job_id) AS bound, EXISTS (SELECT 1 FROM noted n WHERE n.tenant_id = s.tenant_id AND n.job_id = s.job_id AND n.sign_type = s.sign_type) AS listed
 FROM s LEFT JOIN rooms r ON r.seq = s.room_seq LEFT JOIN jobs ON jobs.tenant_id = s.tenant_id AND jobs.job_id = s.job_id)
SELECT seq FROM j WHERE NOT (known AND job % 4 = 0 AND (sign_type IN ('Room ID', 'Exit', 'Evacuation Map', 'Elevator') OR coalesce({has("room", vocab.NOT_RESTROOM_ROOMS)}, false)))
 AND NOT (sign_type = 'Evacuation Map' AND coalesce({has("room", vocab.NO_EVAC_ROOMS)}, false)) AND NOT (bound AND rule_ref NOT LIKE 'training%' AND sign_type <> 'Type B.1' AND NOT listed)
 AND NOT (known AND job % 5 = 0 AND NOT CASE WHEN rule_ref LIKE 'training%' THEN job % 10 <> 0 OR sign_type IN ('Exit', 'Evacuation Map') ELSE rule_ref = 'R9' OR job % 10 <> 0 AND rule_ref = 'R16' END)
 AND NOT (sign_type = 'Exit' AND room_seq IS NOT NULL) AND NOT (sign_type = 'Elevator' AND coalesce(NOT is_elevator, false))""",
    ),
    "b18_sheet_types": (_run(lambda v: _drawn(v).select("sheet_id", drawings.detect_sheet_type(F.col("sheet_no"), F.col("title")).alias("sheet_type"))), f"WITH {views.SQL}, {SHEETS_SQL}, {_DRAWN} SELECT sheet_id, {_TYPE} AS sheet_type FROM drawn"),
    "b17_b19_sheet_categories": (_run(lambda v: _classified(v).select("sheet_id", "category", "reason")), f"WITH {views.SQL}, {SHEETS_SQL}, {_DRAWN}, {_CLASSIFIED} SELECT sheet_id, category, reason FROM categories"),
    "d22_restroom_sets": (
        _run(lambda v: sheets.restroom_sets(_drawn(v))),
        f"WITH {views.SQL}, {SHEETS_SQL}, {_DRAWN} SELECT tenant_id, job_id FROM drawn WHERE {has('sheet_no', '^A-?[0-9]')} GROUP BY 1, 2 HAVING avg(CASE WHEN {has('title', vocab.RESTROOM_TITLE)} THEN 1.0 ELSE 0.0 END) >= 0.5",
    ),
    "d22_restroom_rescue": (
        _run(lambda v: drawings.rescue_restroom_sheets(_classified(v)).select("sheet_id", "category", "reason")),
        f"""WITH {views.SQL}, {SHEETS_SQL}, {_DRAWN}, {_CLASSIFIED}, {_RESCUED}, r AS (SELECT c.*, s.job_id IS NOT NULL AND category = 'skip' AND {has("title", vocab.RESTROOM_RESCUE)} AS hit FROM categories c LEFT JOIN sets s USING (tenant_id, job_id))
SELECT sheet_id, CASE WHEN hit THEN 'interior' ELSE category END AS category, CASE WHEN hit THEN 'rescue' ELSE reason END AS reason FROM r""",
    ),
    "d23_embedded_tables": (
        _run(lambda v: drawings.reclassify_by_tables(_classified(v), _embedded(v)).select("sheet_id", "category", "reason")),
        f"""WITH {views.SQL}, {SHEETS_SQL}, {_DRAWN}, {_CLASSIFIED}, r AS (SELECT *, page % 3 = 0 AND category NOT IN ('skip', 'sign_docs', 'sign_details') AS hit FROM categories)
SELECT sheet_id, CASE WHEN hit THEN 'sign_docs' ELSE category END AS category, CASE WHEN hit THEN 'table' ELSE reason END AS reason FROM r""",
    ),
    "b33_signage_sheets": (
        _run(lambda v: drawings.promote_signage_sheets(_drawn(v)).select("sheet_id", "sheet_type", "is_relevant")),
        f"""WITH {views.SQL}, {SHEETS_SQL}, {_DRAWN}, p AS (SELECT sheet_id, sheet_no, title, CASE WHEN ({has("title", vocab.SIGN_NOTES_TITLE)} OR {has("sheet_no", "^A0[.-]|^A[-.]0")}) AND coalesce(sheet_type, '') <> 'signage_schedule' THEN 'signage_schedule' ELSE sheet_type END AS sheet_type FROM drawn)
SELECT sheet_id, sheet_type, CASE WHEN sheet_no IN {sql_in(vocab.ADMIN_SHEETS)} OR {has("sheet_no", vocab.OTHER_DISCIPLINES)} THEN false WHEN {has("title", vocab.RESTROOM_TITLE)} AND NOT {has("title", "BATHROOM FINISH|FINISH PLAN")} THEN true WHEN {has("title", vocab.NO_PLAN_TITLES)} OR {has("title", vocab.PLAN_ONLY_TITLES)} AND NOT contains(title, 'PLAN') THEN false ELSE true END
 OR coalesce(sheet_type IN ('signage_schedule', 'floor_plan', 'room_schedule'), false) AS is_relevant FROM p""",
    ),
    "d21_sheets": (
        _run(lambda v: dedup.dedup_sheets(v.rooms.select(*rules.JOB, "seq", "sheet_id", (F.col("coord_x") % 3).alias("pdf_page"), (F.col("coord_y") % 2).alias("file_id"))).select("seq")),
        f"WITH {views.SQL} SELECT min(seq) AS seq FROM rooms GROUP BY tenant_id, job_id, sheet_id, coord_x % 3, coord_y % 2",
    ),
    "d7_sign_scope": (
        _run(_judged),
        f"""WITH {views.SQL}, s AS (SELECT tenant_id, job_id, seq, room_seq, CAST(substring(job_id, 2) AS BIGINT) AS job, CASE WHEN seq % 8 = 0 THEN 'Type B.1' ELSE sign_type END AS sign_type, CASE seq % 5 WHEN 0 THEN 'R1' WHEN 1 THEN 'R9' WHEN 2 THEN 'R16' WHEN 3 THEN 'training_correction:7' ELSE '' END AS rule_ref FROM signs),
j AS (SELECT s.*, upper(r.room_name) AS room, {has("upper(r.room_name)", vocab.ELEVATOR)} AS is_elevator, jobs.job_id IS NOT NULL AS known FROM s LEFT JOIN rooms r ON r.seq = s.room_seq LEFT JOIN jobs ON jobs.tenant_id = s.tenant_id AND jobs.job_id = s.job_id)
SELECT seq FROM j WHERE NOT (known AND job % 4 = 0 AND (sign_type IN ('Room ID', 'Exit', 'Evacuation Map', 'Elevator') OR coalesce({has("room", vocab.NOT_RESTROOM_ROOMS)}, false)))
 AND NOT (sign_type = 'Evacuation Map' AND coalesce({has("room", vocab.NO_EVAC_ROOMS)}, false)) AND NOT (known AND job % 3 = 0 AND rule_ref NOT LIKE 'training%' AND sign_type NOT IN ('Type B.1', 'Exit', 'Restroom'))
 AND NOT (known AND job % 5 = 0 AND NOT CASE WHEN rule_ref LIKE 'training%' THEN job % 10 <> 0 OR sign_type IN ('Exit', 'Evacuation Map') ELSE rule_ref = 'R9' OR job % 10 <> 0 AND rule_ref = 'R16' END)
 AND NOT (sign_type = 'Exit' AND room_seq IS NOT NULL) AND NOT (sign_type = 'Elevator' AND coalesce(NOT is_elevator, false))""",
    ),
}
