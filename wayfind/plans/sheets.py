"""Registered queries of sheets, files, names and validation."""

from __future__ import annotations

from pyspark.sql import functions as F

from wayfind import vocab
from wayfind.operators import rules, sheets
from wayfind.plans.rules import ALL, ELEVATORS, MAPS, ROOM_SIGNS, STAIRS, has, quoted, sql_in
from wayfind.plans.rules import _ready as ready
from wayfind.sources import views
from wayfind.sources.kept import kept
from wayfind.sources.views import Views

TITLES = ["FLOOR PLAN LEVEL 2", "SIGN SCHEDULE", "REFLECTED CEILING PLAN", "SECOND FLOOR PLAN", "TOILET ELEVATIONS", "DOOR SCHEDULE", "12TH FLOOR - ROOF"]
FILENAMES = ["set-LEVELS-03-06.pdf", "FL_2.pdf", "plans.pdf", "floor 01 to 03.pdf", "LEVEL-9-4.pdf"]

SHEETS_SQL = f"""job_keys AS (SELECT DISTINCT tenant_id, job_id, sheet_id, CAST(substring(job_id, 2) AS BIGINT) AS job, CAST(regexp_extract(sheet_id, '-([0-9]+)$', 1) AS BIGINT) AS fl FROM rooms),
titles AS (SELECT * FROM (VALUES {", ".join(f"({i}, {quoted(t)})" for i, t in enumerate(TITLES))}) AS t(i, title)),
names AS (SELECT * FROM (VALUES {", ".join(f"({i}, {quoted(t)})" for i, t in enumerate(FILENAMES))}) AS t(i, filename)),
sheets AS (SELECT tenant_id, job_id, sheet_id, concat(CASE (job + fl) % 5 WHEN 0 THEN 'S-' ELSE 'A-' END, fl + 1 + CASE WHEN job % 3 = 0 THEN 100 ELSE 0 END) AS sheet_no, title, concat('f', job) AS file_id, fl + 1 AS page FROM job_keys JOIN titles ON i = (job + fl) % 7),
files AS (SELECT DISTINCT tenant_id, job_id, concat('f', job) AS file_id, filename, job % 6 + 1 AS page_count FROM job_keys JOIN names ON i = job % 5)"""


def _sheets(v):
    job, fl = F.substring("job_id", 2, 20).cast("long"), F.regexp_extract("sheet_id", "-([0-9]+)$", 1).cast("long")
    keys = v.rooms.select(*rules.JOB, "sheet_id").distinct().withColumns({"job": job, "fl": fl})
    number = F.concat(F.when((F.col("job") + F.col("fl")) % 5 == 0, "S-").otherwise("A-"), (F.col("fl") + 1 + F.when(F.col("job") % 3 == 0, 100).otherwise(0)).cast("string"))
    title = F.get(F.array(*map(F.lit, TITLES)), ((F.col("job") + F.col("fl")) % 7).cast("int"))
    return keys.select(*rules.JOB, "sheet_id", number.alias("sheet_no"), title.alias("title"), F.concat(F.lit("f"), F.col("job").cast("string")).alias("file_id"), (F.col("fl") + 1).alias("page"))


def _files(v):
    job = F.substring("job_id", 2, 20).cast("long")
    keys = v.rooms.select(*rules.JOB).distinct().withColumn("job", job)
    return keys.select(*rules.JOB, F.concat(F.lit("f"), F.col("job").cast("string")).alias("file_id"), F.get(F.array(*map(F.lit, FILENAMES)), (F.col("job") % 5).cast("int")).alias("filename"), (F.col("job") % 6 + 1).alias("page_count"))


#: Second files of jobs: name, pages, bytes. Every third one belongs to a job that has no sheet.
MORE_FILES = [("2nd Floor Plans.pdf", 1, 1000), ("set.PDF", 40, None), ("notes.txt", 9, 5_000_000), ("addendum.pdf", None, 30_000_000), ("site.pdf", None, None), ("annex.pdf", 2, 200_000_000), ("garage.pdf", None, 110_000_000)]


def _more_files(v):
    job = F.col("job")
    of = lambda i, kind: F.get(F.array(*(F.lit(f[i]).cast(kind) for f in MORE_FILES)), (job % 7).cast("int"))
    first = _files(v).withColumn("size_bytes", F.lit(None).cast("long"))
    more = v.rooms.select(*rules.JOB).distinct().withColumn("job", F.substring("job_id", 2, 20).cast("long"))
    more = more.select("tenant_id", F.when(job % 3 == 0, F.concat("job_id", F.lit("x"))).otherwise(F.col("job_id")).alias("job_id"), F.concat(F.lit("g"), job.cast("string")).alias("file_id"), of(0, "string").alias("filename"), of(1, "long").alias("page_count"), of(2, "long").alias("size_bytes"))
    return first.unionByName(more)


def _run(f):
    return lambda s, d: f(Views(s, d))


_TITLE_LEVEL = "CASE " + " ".join(f"WHEN {has('lower(title)', p)} THEN {quoted(v)}" for p, v in vocab.TITLE_FLOORS) + " WHEN regexp_extract(lower(title), '([0-9]+)(?:st|nd|rd|th)?\\s+floor', 1) <> '' THEN concat('LEVEL ', regexp_extract(lower(title), '([0-9]+)(?:st|nd|rd|th)?\\s+floor', 1)) END"
_WHY = f"CASE WHEN sheet_no IN {sql_in(vocab.ADMIN_SHEETS)} THEN 'administrative' WHEN {has('sheet_no', vocab.OTHER_DISCIPLINES)} THEN 'discipline' WHEN {has('title', vocab.RESTROOM_TITLE)} AND NOT {has('title', 'BATHROOM FINISH|FINISH PLAN')} THEN NULL WHEN {has('title', vocab.NO_PLAN_TITLES)} THEN 'no plan view' WHEN {has('title', vocab.PLAN_ONLY_TITLES)} AND NOT contains(title, 'PLAN') THEN 'table' END"
_LABELS = {"set-LEVELS-03-06.pdf": "Floors 3-6", "FL_2.pdf": "Floor 2", "plans.pdf": None, "floor 01 to 03.pdf": "Floors 1-3", "LEVEL-9-4.pdf": "Floors 9-4"}
_NR = "upper(trim(room_number))"
_DIGIT = lambda x: f"CASE WHEN {x} = '0' THEN 'LEVEL B1' ELSE concat('LEVEL ', {x}) END"
_AT = lambda p: f"regexp_extract({_NR}, '{p}', 1)"
_NUMBER_LEVEL = f"""CASE WHEN {_AT("^[A-Z]{1,3}([0-9])[0-9][0-9]")} <> '' THEN {_DIGIT(_AT("^[A-Z]{1,3}([0-9])[0-9][0-9]"))} WHEN {_AT("^([0-9])[0-9][0-9][A-Z]?$")} <> '' THEN {_DIGIT(_AT("^([0-9])[0-9][0-9][A-Z]?$"))}
 WHEN regexp_matches({_NR}, '^[0-4][0-9][0-9]') THEN {_DIGIT(f"substring({_NR}, 1, 1)")} WHEN regexp_matches({_NR}, '^[BS]-?[0-9]') THEN 'LEVEL B1' WHEN regexp_matches({_NR}, '^P-?[0-9]') THEN 'PARKING' END"""
_FIRST = "CASE filename WHEN 'set-LEVELS-03-06.pdf' THEN 3 WHEN 'FL_2.pdf' THEN 2 WHEN 'floor 01 to 03.pdf' THEN 1 WHEN 'LEVEL-9-4.pdf' THEN 9 END"
_LEXICON = [("commercial", "is_public", "Reception"), ("commercial", "is_public", "lobby"), ("education", "is_assembly", "CLASSROOM"), ("hospital", "is_assembly", "exam room"), ("education", "is_mep", "STORAGE"), ("unknown", "is_mep", "OFFICE")]
_SYN = " ".join(f"WHEN {quoted(k)} THEN {quoted(v)}" for k, v in vocab.SYNONYMS.items())


def _checks(spark, sf_dir):
    v = Views(spark, sf_dir)
    return sheets.validate_jobs(rules.prepared_once(rules.asked(v.rooms), v.jobs))


_TOKENS = "list_distinct(list_filter(string_split_regex(regexp_replace(upper(room_name), '[^A-Z0-9 ]', ' ', 'g'), ' +'), lambda t: t <> ''))"
_FREE = "list_filter(c.found, lambda x: NOT list_contains(h.used, x.r))[1:1]"
_GREEDY = f"""WITH RECURSIVE {views.SQL}, s AS (SELECT tenant_id, job_id, seq, {_TOKENS} AS a FROM schedule WHERE room_number <> ''), r AS (SELECT tenant_id, job_id, seq, {_TOKENS} AS b FROM rooms WHERE room_number = ''),
scored AS (SELECT s.tenant_id, s.job_id, s.seq AS s_seq, r.seq AS r_seq, len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) AS score FROM s JOIN r USING (tenant_id, job_id) WHERE len(list_intersect(a, b)) > 0),
c AS (SELECT tenant_id, job_id, s_seq, row_number() OVER (PARTITION BY tenant_id, job_id ORDER BY s_seq) AS k, list({{'score': score, 'r': r_seq}} ORDER BY score DESC, r_seq) AS found FROM scored WHERE score >= 0.25 GROUP BY 1, 2, 3),
chosen AS (SELECT tenant_id, job_id, CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS s_seq, CAST([] AS BIGINT[]) AS used, CAST(NULL AS STRUCT(score DOUBLE, r BIGINT)) AS pick FROM c GROUP BY 1, 2
 UNION ALL SELECT h.tenant_id, h.job_id, c.k, c.s_seq, list_concat(h.used, list_transform({_FREE}, lambda x: x.r)), {_FREE}[1] FROM chosen h JOIN c ON c.tenant_id = h.tenant_id AND c.job_id = h.job_id AND c.k = h.k + 1)
SELECT tenant_id, job_id, s_seq, pick.r AS r_seq, pick.score AS score FROM chosen WHERE pick IS NOT NULL"""

LEVEL_FILES = ["1st Floor Union.pdf", "plans.pdf", "B1 plan.pdf", "set-LEVELS-03-06.pdf", "north.pdf", "Ground.pdf", "FL_2.pdf"]
LEVEL_LABELS = [None, "Second floor", " Level 7b", "", "Floors 4-5", "12th floor", "north"]
SCHEDULE_FLOORS = ["LEVEL 02", "Floor 3", "BASEMENT", "B", "roof", None, "B-1"]


def _labelled_files(v):
    job = F.substring("job_id", 2, 20).cast("long")
    pick = lambda told: F.get(F.array(*(F.lit(x) for x in told)), (job % 7).cast("int"))
    label = F.get(F.array(*(F.lit(x) for x in LEVEL_LABELS)), (F.floor(job / 7) % 7).cast("int"))
    return _files(v).withColumns({"filename": pick(LEVEL_FILES), "floor_label": label, "file_category": F.when(job % 5 != 0, "floor_plan").otherwise("other")})


def _titled(v):
    """Every second sheet's title tells a level; others are called after their place."""
    return _sheets(v).withColumn("title", F.when(F.col("page") % 2 == 0, F.col("title")).otherwise("NORTH"))


def _chained(v):
    """Rooms of which every fourth has a level of its own, some of these a page's name; the schedule tells floors."""
    seq = F.col("seq")
    own = F.when(seq % 4 == 0, F.when(seq % 12 == 0, "PLAN 2").when(seq % 20 == 0, " level 14 ").otherwise(F.col("level")))
    rooms = v.rooms.select(*rules.JOB, "seq", F.when(seq % 9 != 1, F.col("sheet_id")).alias("sheet_id"), "room_number", own.alias("level"))
    schedule = v.schedule.withColumn("floor", F.get(F.array(*(F.lit(x) for x in SCHEDULE_FLOORS)), (seq % 7).cast("int")))
    return sheets.room_level_chain(rooms, sheets.sheet_level_chain(_titled(v), _labelled_files(v)), schedule).select("seq", "level", "level_source")


_PICK = lambda told, by: f"CASE {by} " + " ".join(f"WHEN {i} THEN {quoted(x)}" for i, x in enumerate(told) if x is not None) + " END"
_CHAIN = f"""lf AS (SELECT *, {_PICK(LEVEL_FILES, "job % 7")} AS fname, {_PICK(LEVEL_LABELS, "job // 7 % 7")} AS label FROM (SELECT tenant_id, job_id, file_id, CAST(substring(job_id, 2) AS BIGINT) AS job FROM files)),
leveled AS (SELECT s.tenant_id, s.job_id, s.sheet_id, CASE WHEN page % 2 = 0 THEN {_TITLE_LEVEL} END AS by_title, CASE fname WHEN '1st Floor Union.pdf' THEN 'LEVEL 1' WHEN 'B1 plan.pdf' THEN 'LEVEL B1' WHEN 'Ground.pdf' THEN 'LEVEL 1' END AS by_name,
 CASE WHEN job % 5 <> 0 THEN CASE label WHEN 'Second floor' THEN 'LEVEL 2' WHEN ' Level 7b' THEN 'LEVEL 7B' WHEN 'Floors 4-5' THEN 'LEVEL 4' WHEN '12th floor' THEN 'LEVEL 12' END END AS by_slot, CASE fname WHEN 'set-LEVELS-03-06.pdf' THEN 'LEVEL 3' WHEN 'FL_2.pdf' THEN 'LEVEL 2' END AS by_range FROM sheets s JOIN lf USING (tenant_id, job_id, file_id)),
told AS (SELECT tenant_id, job_id, upper(trim(room_number)) AS n, seq, CASE seq % 7 WHEN 0 THEN 'LEVEL 2' WHEN 1 THEN 'LEVEL 3' WHEN 2 THEN 'LEVEL B1' WHEN 3 THEN 'LEVEL B1' WHEN 6 THEN 'LEVEL B1' END AS lv FROM schedule),
floors_of AS (SELECT tenant_id, job_id, n, arg_min(lv, seq) AS lv FROM told WHERE n <> '' AND lv IS NOT NULL GROUP BY 1, 2, 3),
r AS (SELECT tenant_id, job_id, seq, CASE WHEN seq % 9 <> 1 THEN sheet_id END AS sheet_id, room_number, CASE WHEN seq % 4 = 0 THEN CASE WHEN seq % 12 = 0 THEN 'PLAN 2' WHEN seq % 20 = 0 THEN 'level 14' ELSE nullif(trim(level), '') END END AS own FROM rooms),
c AS (SELECT r.*, by_title, by_name, by_slot, by_range, f.lv, coalesce(own, by_title, by_name, by_slot, by_range, f.lv) AS level, CASE WHEN own IS NOT NULL THEN 'own' WHEN by_title IS NOT NULL THEN 'title' WHEN by_name IS NOT NULL THEN 'file name' WHEN by_slot IS NOT NULL THEN 'slot' WHEN by_range IS NOT NULL THEN 'file range' WHEN f.lv IS NOT NULL THEN 'schedule' END AS source
 FROM r LEFT JOIN leveled l ON l.tenant_id = r.tenant_id AND l.job_id = r.job_id AND l.sheet_id = r.sheet_id LEFT JOIN floors_of f ON f.tenant_id = r.tenant_id AND f.job_id = r.job_id AND f.n = upper(trim(r.room_number)))"""

QUERIES = {
    "b4_synonyms": (_run(lambda v: v.rooms.select("seq", sheets.expand_synonyms(F.col("room_name")).alias("name"))), f"WITH {views.SQL} SELECT seq, array_to_string(list_transform(string_split_regex(upper(room_name), '\\s+'), lambda t: CASE t {_SYN} ELSE t END), ' ') AS name FROM rooms"),
    "b2_lexicon": (
        _run(lambda v: sheets.apply_lexicon(v.rooms, v.jobs, _LEXICON)),
        f"""WITH {views.SQL} SELECT tenant_id, job_id, seq, building_type = 'commercial' AND {has("room_name", r"\bRECEPTION\b|\bLOBBY\b")} AS is_public, building_type = 'education' AND {has("room_name", r"\bCLASSROOM\b")} OR building_type = 'hospital' AND {has("room_name", r"\bEXAM ROOM\b")} AS is_assembly, building_type = 'education' AND {has("room_name", r"\bSTORAGE\b")} AS is_mep FROM rooms JOIN jobs USING (tenant_id, job_id)""",
    ),
    "b9_b32_sheet_levels": (_run(lambda v: sheets.fill_sheet_level(_sheets(v), _files(v)).select("sheet_id", "level")), f"WITH {views.SQL}, {SHEETS_SQL} SELECT sheet_id, coalesce({_TITLE_LEVEL}, concat('LEVEL ', {_FIRST})) AS level FROM sheets JOIN files USING (tenant_id, job_id, file_id)".replace("concat('LEVEL ', CASE", "'LEVEL ' || CASE").replace("THEN 9 END)) AS level", "THEN 9 END) AS level")),
    "b9_level_chain": (
        _run(_chained),
        f"""WITH {views.SQL}, {SHEETS_SQL}, {_CHAIN}, d AS (SELECT *, (level IS NULL OR contains(upper(level), 'PLAN') OR contains(upper(level), 'PAGE') OR regexp_matches(upper(trim(level)), '^LEVEL\\s+[0-9]{{2,}}$')) AND by_number IS NOT NULL AS net FROM (SELECT *, {_NUMBER_LEVEL} AS by_number FROM c))
SELECT seq, CASE WHEN net THEN by_number ELSE level END AS level, CASE WHEN net THEN 'number' ELSE source END AS level_source FROM d""",
    ),
    "b10_file_labels": (
        _run(lambda v: _files(v).select("file_id", sheets.label_from_filename(F.col("filename")).alias("label"), sheets.floor_range(sheets.label_from_filename(F.col("filename")))["replicate"].alias("replicate"))),
        f"WITH {views.SQL}, {SHEETS_SQL} SELECT file_id, CASE filename {' '.join(f'WHEN {quoted(k)} THEN {quoted(v)}' for k, v in _LABELS.items() if v)} END AS label, filename IN ('set-LEVELS-03-06.pdf', 'floor 01 to 03.pdf') AS replicate FROM files",
    ),
    "b16_d24_coverage": (
        _run(lambda v: sheets.sheet_coverage(_sheets(v))),
        f"WITH {views.SQL}, {SHEETS_SQL}, w AS (SELECT *, {_WHY} AS why FROM sheets) SELECT tenant_id, job_id, file_id, count(*) AS n_sheets, count(*) - count(why) AS scanned, count(CASE WHEN why = 'administrative' THEN 1 END) AS administrative, count(CASE WHEN why = 'discipline' THEN 1 END) AS discipline, count(CASE WHEN why = 'no plan view' THEN 1 END) AS no_plan, count(CASE WHEN why = 'table' THEN 1 END) AS tables FROM w GROUP BY 1, 2, 3",
    ),
    "c8_replicate_floors": (
        _run(lambda v: sheets.replicate_floors(v.rooms.select(*rules.JOB, "seq", "sheet_id", "level", "coord_x", "coord_y"), _sheets(v), _files(v)).select("seq", "level", "coord_x", "coord_y")),
        f"""WITH {views.SQL}, {SHEETS_SQL}, lv AS (SELECT * FROM (VALUES ('set-LEVELS-03-06.pdf', 3), ('set-LEVELS-03-06.pdf', 4), ('set-LEVELS-03-06.pdf', 5), ('set-LEVELS-03-06.pdf', 6), ('floor 01 to 03.pdf', 1), ('floor 01 to 03.pdf', 2), ('floor 01 to 03.pdf', 3)) AS l(filename, n))
SELECT seq, CASE WHEN n IS NULL THEN level ELSE concat('LEVEL ', n) END AS level, CASE WHEN n IS NULL OR n IN (1, 3) AND n = {_FIRST} THEN coord_x END AS coord_x, CASE WHEN n IS NULL OR n IN (1, 3) AND n = {_FIRST} THEN coord_y END AS coord_y FROM rooms JOIN files USING (tenant_id, job_id) LEFT JOIN lv USING (filename)""",
    ),
    "c23_missing_sheets": (_run(lambda v: sheets.synthesize_missing_sheets(_files(v), _sheets(v))), f"WITH {views.SQL}, {SHEETS_SQL}, p AS (SELECT tenant_id, job_id, file_id, CAST(unnest(range(1, page_count + 1)) AS INT) AS page FROM files WHERE page_count > 1) SELECT * FROM p WHERE NOT EXISTS (SELECT 1 FROM sheets s WHERE s.tenant_id = p.tenant_id AND s.job_id = p.job_id AND s.page = p.page)"),
    "c23_synthesized": (
        _run(lambda v: sheets.synthesize_sheets(_more_files(v), _sheets(v))),
        f"""WITH {views.SQL}, {SHEETS_SQL}, more AS (SELECT * FROM (VALUES {", ".join(f"({i}, {quoted(n)}, {'NULL' if p is None else p}, {'NULL' if b is None else b})" for i, (n, p, b) in enumerate(MORE_FILES))}) AS t(i, filename, page_count, size_bytes)),
f AS (SELECT tenant_id, job_id, file_id, filename, page_count, NULL AS size_bytes FROM files UNION ALL
 SELECT tenant_id, CASE WHEN job % 3 = 0 THEN concat(job_id, 'x') ELSE job_id END, concat('g', job), filename, page_count, size_bytes FROM (SELECT DISTINCT tenant_id, job_id, job FROM job_keys) JOIN more ON i = job % 7),
bare AS (SELECT *, EXISTS (SELECT 1 FROM sheets s WHERE s.tenant_id = f.tenant_id AND s.job_id = f.job_id) AS listed, max(coalesce(size_bytes, 0)) OVER (PARTITION BY tenant_id, job_id) / 1048576.0 AS mb FROM f),
sized AS (SELECT *, CASE WHEN listed THEN greatest(1, least(coalesce(page_count, 1), 30)) ELSE greatest(3, least(coalesce(page_count, CASE WHEN mb > 100 THEN 15 WHEN mb > 20 THEN 8 ELSE 5 END), 30)) END AS pages, regexp_replace(filename, '[.][Pp][Dd][Ff]$', '') AS title FROM bare
 WHERE lower(filename) LIKE '%.pdf' AND NOT EXISTS (SELECT 1 FROM sheets s WHERE s.tenant_id = bare.tenant_id AND s.job_id = bare.job_id AND s.file_id = bare.file_id)),
made AS (SELECT tenant_id, job_id, file_id, page, CASE WHEN NOT listed THEN concat('FLOOR PLAN LEVEL ', page) WHEN pages > 1 THEN concat(title, ' — Page ', page) ELSE title END AS title, CASE WHEN listed THEN coalesce({_TITLE_LEVEL}, concat('LEVEL ', page)) ELSE concat('LEVEL ', page) END AS level FROM (SELECT *, unnest(range(1, pages + 1)) AS page FROM sized)),
rest AS (SELECT tenant_id, job_id, file_id, unnest(range(1, page_count + 1)) AS page FROM f WHERE page_count > 1)
SELECT tenant_id, job_id, file_id, CAST(page AS INT) AS page, title, level FROM made UNION ALL SELECT tenant_id, job_id, file_id, CAST(page AS INT), concat('Floor Plan Level ', page), concat('LEVEL ', page) FROM rest r
WHERE NOT EXISTS (SELECT 1 FROM made m WHERE m.tenant_id = r.tenant_id AND m.job_id = r.job_id AND m.file_id = r.file_id AND m.page = r.page) AND NOT EXISTS (SELECT 1 FROM sheets s WHERE s.tenant_id = r.tenant_id AND s.job_id = r.job_id AND s.file_id = r.file_id AND s.page = r.page)""",
    ),
    "c11_fuzzy_rooms": (_run(lambda v: sheets.fuzzy_match_rooms(v.schedule.filter("room_number <> ''"), v.rooms.filter("room_number = ''"))), _GREEDY),
    "d19_details": (
        lambda s, d: _checks(s, d).drop("status"),
        f"""WITH {ALL}, {ROOM_SIGNS}, {STAIRS}, {ELEVATORS}, {MAPS},
pr AS (SELECT seq, count(*) AS n, count(DISTINCT sign_type) AS types, count(CASE WHEN sign_type = 'Exit' THEN 1 END) AS exits, count(CASE WHEN sign_type = 'Restroom' THEN 1 END) AS rs, count(CASE WHEN confidence < 0.5 THEN 1 END) AS low FROM room_signs GROUP BY 1),
m AS (SELECT r.*, coalesce(exits, 0) AS x, coalesce(rs, 0) AS rs, coalesce(low, 0) AS low, n IS NULL AND NOT is_stair AND NOT is_elevator AND NOT is_corridor AND NOT is_mep AS bare, coalesce(types < n AND NOT is_vestibule, false) AS twice, is_mep AND coalesce(occupant_load, 0) > 0 AS loaded FROM ready r LEFT JOIN pr USING (seq)),
f AS (SELECT tenant_id, job_id, any_value(detected) AS detected, count(CASE WHEN bare THEN 1 END) AS without, count(CASE WHEN twice THEN 1 END) AS twice, sum(x) AS exits, count(CASE WHEN is_restroom THEN 1 END) AS restrooms, sum(rs) AS rs, count(CASE WHEN is_stair THEN 1 END) AS stairs, count(CASE WHEN is_elevator THEN 1 END) AS elevators, sum(low) AS low, count(DISTINCT level) AS levels, count(CASE WHEN loaded THEN 1 END) AS loaded,
 array_to_string((list(room_number ORDER BY seq) FILTER (WHERE bare))[1:5], ', ') AS bare_rooms, array_to_string((list(room_number ORDER BY seq) FILTER (WHERE loaded))[1:5], ', ') AS loaded_rooms FROM m GROUP BY 1, 2),
a AS (SELECT f.*, coalesce(s.n, 0) AS ss, coalesce(e.n, 0) AS es, coalesce(g.maps, 0) AS m FROM f LEFT JOIN (SELECT tenant_id, job_id, count(*) AS n FROM stair_signs GROUP BY 1, 2) s USING (tenant_id, job_id) LEFT JOIN (SELECT tenant_id, job_id, count(*) AS n FROM elevator_signs GROUP BY 1, 2) e USING (tenant_id, job_id) LEFT JOIN (SELECT * FROM maps WHERE maps > 0) g USING (tenant_id, job_id))
SELECT tenant_id, job_id, 'occupied_rooms_have_signs' AS "check", CASE WHEN without = 0 THEN 'All occupied rooms have at least one sign.' ELSE concat(without, ' occupied rooms have no signs: ', bare_rooms) END AS details FROM a
UNION ALL SELECT tenant_id, job_id, 'no_duplicate_signs_per_room', CASE WHEN twice = 0 THEN 'No duplicate sign types per room.' ELSE concat(twice, ' rooms have duplicate sign types.') END FROM a
UNION ALL SELECT tenant_id, job_id, 'exit_signs_present', CASE WHEN exits > 0 THEN concat(exits, ' Exit sign(s) assigned.') ELSE 'No Exit signs assigned — verify egress doors.' END FROM a
UNION ALL SELECT tenant_id, job_id, 'restroom_signs_match_restrooms', CASE WHEN restrooms = rs THEN concat(rs, ' Restroom sign(s) match ', restrooms, ' restroom(s).') ELSE concat(restrooms, ' restrooms but ', rs, ' Restroom signs — review.') END FROM a
UNION ALL SELECT tenant_id, job_id, 'stair_signs_present', CASE WHEN stairs = 0 THEN 'No stairs detected.' WHEN ss > 0 THEN concat(ss, ' stair sign(s) for ', stairs, ' stair(s).') ELSE 'Stairs detected but no stair signs assigned.' END FROM a
UNION ALL SELECT tenant_id, job_id, 'elevator_signs_present', CASE WHEN elevators = 0 THEN 'No elevators detected.' WHEN es > 0 THEN concat(es, ' elevator sign(s) for ', elevators, ' elevator(s).') ELSE 'Elevators detected but no elevator signs assigned.' END FROM a
UNION ALL SELECT tenant_id, job_id, 'low_confidence_signs', CASE WHEN low = 0 THEN 'All signs have confidence >= 0.5.' ELSE concat(low, ' sign(s) have low confidence (<0.5) — review required.') END FROM a
UNION ALL SELECT tenant_id, job_id, 'building_type_detected', CASE WHEN detected <> 'commercial' THEN concat('Building type detected: ', detected, '.') ELSE 'Building type defaulted to ''commercial'' — verify and update if needed.' END FROM a
UNION ALL SELECT tenant_id, job_id, 'multi_level_coverage', concat('Signs assigned across ', levels, ' level(s).') FROM a
UNION ALL SELECT tenant_id, job_id, 'evac_maps_present', CASE WHEN levels < 2 THEN 'Single-level building — evac maps optional.' WHEN m > 0 THEN concat(m, ' Evacuation Map(s) assigned.') ELSE 'Multi-level building detected but no Evacuation Maps assigned — check lobby/elevator lobbies.' END FROM a
UNION ALL SELECT tenant_id, job_id, 'unoccupied_rooms_with_occupant_load', CASE WHEN loaded = 0 THEN 'No MEP-unoccupied rooms carry a non-zero occupant load.' ELSE concat(loaded, ' room(s) marked unoccupied but have an occupant load — verify source data: ', loaded_rooms) END FROM a""",
    ),
    "d19_validation": (
        lambda s, d: _checks(s, d).drop("details"),
        f"""WITH {ALL}, {ROOM_SIGNS}, {STAIRS}, {ELEVATORS}, {MAPS},
pr AS (SELECT seq, count(*) AS n, count(DISTINCT sign_type) AS types, count(CASE WHEN sign_type = 'Exit' THEN 1 END) AS exits, count(CASE WHEN sign_type = 'Restroom' THEN 1 END) AS rs, count(CASE WHEN confidence < 0.5 THEN 1 END) AS low FROM room_signs GROUP BY 1),
f AS (SELECT tenant_id, job_id, any_value(detected) AS detected, count(CASE WHEN n IS NULL AND NOT is_stair AND NOT is_elevator AND NOT is_corridor AND NOT is_mep THEN 1 END) AS without, count(CASE WHEN types < n AND NOT is_vestibule THEN 1 END) AS twice, coalesce(sum(exits), 0) AS exits,
 count(CASE WHEN is_restroom THEN 1 END) AS restrooms, coalesce(sum(rs), 0) AS rs, count(CASE WHEN is_stair THEN 1 END) AS stairs, count(CASE WHEN is_elevator THEN 1 END) AS elevators, coalesce(sum(low), 0) AS low, count(DISTINCT level) AS levels, count(CASE WHEN is_mep AND coalesce(occupant_load, 0) > 0 THEN 1 END) AS loaded FROM ready LEFT JOIN pr USING (seq) GROUP BY 1, 2),
a AS (SELECT f.*, coalesce(s.n, 0) AS ss, coalesce(e.n, 0) AS es, coalesce(m.maps, 0) AS m FROM f LEFT JOIN (SELECT tenant_id, job_id, count(*) AS n FROM stair_signs GROUP BY 1, 2) s USING (tenant_id, job_id) LEFT JOIN (SELECT tenant_id, job_id, count(*) AS n FROM elevator_signs GROUP BY 1, 2) e USING (tenant_id, job_id) LEFT JOIN (SELECT * FROM maps WHERE maps > 0) m USING (tenant_id, job_id))
SELECT tenant_id, job_id, c.name AS "check", CASE WHEN CASE c.name WHEN 'occupied_rooms_have_signs' THEN without = 0 WHEN 'no_duplicate_signs_per_room' THEN twice = 0 WHEN 'exit_signs_present' THEN exits > 0 WHEN 'restroom_signs_match_restrooms' THEN restrooms = rs WHEN 'stair_signs_present' THEN stairs = 0 OR ss > 0
 WHEN 'elevator_signs_present' THEN elevators = 0 OR es > 0 WHEN 'low_confidence_signs' THEN low = 0 WHEN 'building_type_detected' THEN detected <> 'commercial' WHEN 'multi_level_coverage' THEN levels > 0 WHEN 'evac_maps_present' THEN levels < 2 OR m > 0 ELSE loaded = 0 END THEN 'pass' WHEN c.name = 'multi_level_coverage' THEN 'fail' ELSE 'warning' END AS status
FROM a, (VALUES ('occupied_rooms_have_signs'), ('no_duplicate_signs_per_room'), ('exit_signs_present'), ('restroom_signs_match_restrooms'), ('stair_signs_present'), ('elevator_signs_present'), ('low_confidence_signs'), ('building_type_detected'), ('multi_level_coverage'), ('evac_maps_present'), ('unoccupied_rooms_with_occupant_load')) AS c(name)""",
    ),
}
