"""Registered queries of texts, dedup and matching."""

from __future__ import annotations

from pyspark.sql import functions as F

from wayfind import vocab
from wayfind.functions import text
from wayfind.operators import dedup, matching, rules
from wayfind.plans.rules import LEVEL, has, quoted, sql_map
from wayfind.sources import views
from wayfind.sources.views import Views

_KEY = "coalesce(nullif(regexp_replace(upper(trim(room_number)), '\\s+', '', 'g'), ''), lower(trim(room_name)))"
_PREDICT = """CASE WHEN regexp_matches(lower(room_name), 'exit|egress') THEN 'Exit' WHEN regexp_matches(lower(room_name), 'stair') AND NOT regexp_matches(lower(room_name), 'corridor|hall') AND regexp_matches(lower(room_name), 'landing') THEN 'Stair(Landing)'
 WHEN regexp_matches(lower(room_name), 'stair') THEN 'Stair(Corridor)' WHEN regexp_matches(lower(room_name), 'restroom|bathroom|toilet| wc|lavatory|women|men''s|female|male|gender neutral') THEN 'Restroom'
 WHEN regexp_matches(lower(room_name), 'evac') THEN 'Evac Map' WHEN regexp_matches(lower(room_name), 'in case of fire|fire instruction') THEN 'In case of fire' WHEN regexp_matches(lower(room_name), 'directory') THEN 'Office Directory'
 WHEN regexp_matches(lower(room_name), 'occupanc|capacity') THEN 'Max Occupancy' WHEN regexp_matches(lower(room_name), 'insert|suite|office') THEN 'Room ID w/insert' ELSE 'Room ID' END"""


def _floor(x: str) -> str:
    return f"CASE WHEN {x} = '0' THEN 'LEVEL B1' ELSE concat('LEVEL ', {x}) END"


_N = "upper(trim(room_number))"
_LETTERED, _PLAIN = f"regexp_extract({_N}, '^[A-Z]{{1,3}}([0-9])\\d{{2}}', 1)", f"regexp_extract({_N}, '^([0-9])\\d{{2}}[A-Z]?$', 1)"
_BY_NUMBER = f"CASE WHEN {_LETTERED} <> '' THEN {_floor(_LETTERED)} WHEN {_PLAIN} <> '' THEN {_floor(_PLAIN)} END"
_WORDS = lambda c: "CASE " + " ".join(f"WHEN {has(f'upper({c})', p)} THEN {quoted(v)}" for p, v in text.LEVEL_WORDS) + " END"
_CONTEXT = f"""coalesce(CASE WHEN {has("upper(trim(coalesce(level, '')))", "^$|^LEVEL 1$|^FIRST|^GROUND|^GRADE")} THEN {_BY_NUMBER} END, {_WORDS("level")}, {_WORDS("sheet_id")},
 CASE WHEN {_LETTERED} <> '' THEN {_floor(_LETTERED)} WHEN {has(_N, "^[0-4][0-9]{2}")} THEN {_floor(f"substring({_N}, 1, 1)")} WHEN {has(_N, "^[BS]-?[0-9]")} THEN 'LEVEL B1' WHEN {has(_N, "^P-?[0-9]")} THEN 'PARKING' END)"""
_DENSE = "regexp_replace(trim(room_name), '\\s+', '', 'g')"
_VALID_NAME = f"length(trim(room_name)) >= 2 AND NOT {has('trim(room_name)', vocab.GARBLED)} AND (length({_DENSE}) <= 3 OR length(regexp_replace({_DENSE}, '[^A-Za-z]', '', 'g')) / length({_DENSE}) >= 0.4)"
_VALID_NUMBER = "CASE building_type " + " ".join(f"WHEN {quoted(k)} THEN {has('room_number', p)}" for k, p in vocab.VALID_NUMBER.items()) + f" ELSE {has('room_number', vocab.ANY_NUMBER)} END"
_DIGITS = lambda p: f"lpad(regexp_extract({_N}, '{p}', 1), 8, '0')"
_WING = f"CASE WHEN room_number = '' THEN 'Zÿ' WHEN {has(_N, '^W[0-9]')} THEN concat('A', {_DIGITS('^W([0-9]+)')}) WHEN {has(_N, '^E[0-9]')} THEN concat('B', {_DIGITS('^E([0-9]+)')}) WHEN {has(_N, '^[0-9]')} THEN concat('C', {_DIGITS('^([0-9]+)')}) ELSE concat('D', {_N}) END"
_FLOORKEY = "CASE WHEN coalesce(level, '') = '' THEN 'zzz' WHEN lower(trim(level)) IN ('b', 'basement', 'b1') THEN '000' WHEN lower(trim(level)) IN ('g', 'ground', 'ground floor') THEN '001' WHEN regexp_matches(trim(level), '^[0-9]+$') THEN lpad(lower(trim(level)), 10, '0') ELSE lower(trim(level)) END"
_SHOWN = "CASE WHEN coalesce(level, '') = '' THEN 'Unspecified Floor' WHEN lower(trim(level)) IN ('g', 'ground', 'ground floor') THEN 'Ground Floor' WHEN lower(trim(level)) IN ('b', 'basement', 'b1') THEN 'Basement' WHEN regexp_matches(trim(level), '^[0-9]+$') THEN concat('Level ', trim(level)) ELSE upper(trim(level)) END"


def _first(table: str, key: str, order: str = "seq", where: str = "true") -> str:
    return f"SELECT * EXCLUDE (_place) FROM (SELECT *, row_number() OVER (PARTITION BY tenant_id, job_id, {key} ORDER BY {order}) AS _place FROM {table} WHERE {where}) WHERE _place = 1"


def _room_texts(spark, sf_dir):
    r, c = Views(spark, sf_dir).rooms, F.col
    return r.select(
        "seq",
        text.normalize_level(c("level")).alias("level"),
        text.level_from_room_number(c("room_number")).alias("number_level"),
        text.building_from_room_number(c("room_number")).alias("building"),
        text.level_from_context(c("level"), c("sheet_id"), c("room_number")).alias("context_level"),
        text.valid_room_name(c("room_name")).alias("valid_name"),
        text.is_schedule_row_name(c("room_name")).alias("schedule_row"),
        text.room_key(c("room_number"), c("room_name")).alias("room_key"),
        text.predict_sign_type(c("room_name")).alias("predicted"),
        text.wing_sort_key(c("room_number")).alias("wing_key"),
        text.floor_sort_key(c("level")).alias("floor_key"),
        text.format_level(c("level")).alias("shown_level"),
    )


def _numbers(spark, sf_dir):
    v, c = Views(spark, sf_dir), F.col
    return v.rooms.join(v.jobs.select(*rules.JOB, "building_type"), rules.JOB).select("seq", text.valid_room_number(c("room_number"), c("building_type")).alias("valid_number"), text.building_type_group(c("building_type")).alias("type_group"), text.stair_by_number(c("room_number"), c("building_type")).alias("stair_number"))


def _signs_for_dedup(spark, sf_dir):
    v = Views(spark, sf_dir)
    return dedup.dedup_signs(v.signs.withColumn("notes", F.col("sign_type"))).select("seq")


def _delta(spark, sf_dir):
    v = Views(spark, sf_dir)
    return matching.takeoff_delta(v.takeoff, v.rooms, v.signs)


def _actual(v):
    return v.signs.filter("room_seq is not null").select(*rules.JOB, "room_number", "sign_type", "qty")


def _expected(v):
    seq = F.col("seq")
    return v.signs.filter("seq % 3 <> 0").select(*rules.JOB, F.when(seq % 11 == 0, F.concat(F.lit("9"), "room_number")).otherwise(F.col("room_number")).alias("room_number"), "sign_type", (F.col("qty") + (seq % 2).cast("int")).alias("qty"))


_PRESENT = """expected AS (SELECT tenant_id, job_id, CASE WHEN seq % 11 = 0 THEN concat('9', room_number) ELSE room_number END AS room_number, sign_type, qty + CAST(seq % 2 AS INT) AS qty FROM signs WHERE seq % 3 <> 0),
actual AS (SELECT tenant_id, job_id, room_number, sign_type, qty FROM signs WHERE room_seq IS NOT NULL)"""


def _run(f):
    return lambda s, d: f(Views(s, d))


def _corridors(v):
    r = v.rooms.filter(F.upper("room_name").rlike(vocab.CORRIDOR)).select(*rules.JOB, "seq", "sheet_id", "coord_x", "coord_y")
    return matching.offset_to_corridor(v.rooms.filter(~F.upper("room_name").rlike(vocab.CORRIDOR)).select(*rules.JOB, "seq", "sheet_id", "coord_x", "coord_y"), r)


QUERIES = {
    "b5_b25_room_texts": (
        _room_texts,
        f"WITH {views.SQL} SELECT seq, {LEVEL} AS level, {_BY_NUMBER} AS number_level, coalesce(nullif(regexp_extract({_N}, '^[0-9]{{3,4}}([A-Z])$', 1), ''), nullif(regexp_extract({_N}, '^([A-Z])[0-9]{{3,4}}$', 1), '')) AS building, {_CONTEXT} AS context_level, {_VALID_NAME} AS valid_name, {has('upper(room_name)', vocab.SCHEDULE_ROW)} AS schedule_row, {_KEY} AS room_key, {_PREDICT} AS predicted, {_WING} AS wing_key, {_FLOORKEY} AS floor_key, {_SHOWN} AS shown_level FROM rooms",
    ),
    "b11_b21_numbers": (
        _numbers,
        f"WITH {views.SQL} SELECT seq, {_VALID_NUMBER} AS valid_number, {sql_map('building_type', vocab.ALIASES, 'building_type')} AS type_group, {_N} <> '' AND CASE {sql_map('building_type', vocab.ALIASES, 'building_type')} {' '.join(f'WHEN {quoted(k)} THEN ' + has(_N, p) for k, p in vocab.STAIR_NUMBER.items())} ELSE false END AS stair_number FROM rooms JOIN jobs USING (tenant_id, job_id)",
    ),
    "d1_schedule_sheet": (_run(lambda v: dedup.dedup_schedule(v.schedule).select("seq")), f"WITH {views.SQL} SELECT seq FROM ({_first('schedule', 'lower(trim(sheet_id)), lower(trim(room_number)), lower(trim(sign_type)), coalesce(lower(trim(type_mark)), chr(32))')})"),
    "d2_schedule_rooms": (_run(lambda v: dedup.dedup_schedule_rooms(v.schedule).select("seq")), f"WITH {views.SQL} SELECT seq FROM ({_first('schedule', 'lower(trim(room_number)), lower(trim(sign_type)), coalesce(lower(trim(type_mark)), chr(32))')})"),
    "d3_schedule_global": (
        _run(lambda v: dedup.dedup_schedule_global(v.schedule).select("seq")),
        f"""WITH {views.SQL}, keyed AS (SELECT *, concat_ws('|', nullif(lower(trim(room_number)), ''), nullif(lower(trim(room_name)), ''), nullif(lower(trim(sign_type)), ''), nullif(lower(trim(type_mark)), '')) AS k FROM schedule) SELECT seq FROM ({_first("keyed", "k", where="k <> ''")})""",
    ),
    "d4_dedup_rooms": (
        _run(lambda v: dedup.dedup_rooms(v.rooms).select("seq")),
        f"""WITH {views.SQL}, base AS (SELECT *, lower(trim(room_number)) AS n, lower(trim(room_name)) AS nm, lower(trim(coalesce(level, ''))) AS lv FROM rooms),
numbered AS ({_first("base", "n, lv", where="n <> ''")}), plain AS ({_first("base", "nm, lv", where="n = ''")}),
facts AS (SELECT tenant_id, job_id, list(DISTINCT nm) AS names, bool_or(regexp_matches(nm, '{dedup.RESTROOM_WORDS}')) AS r, bool_or(regexp_matches(nm, 'corridor|hallway')) AS c FROM numbered GROUP BY 1, 2)
SELECT seq FROM numbered UNION ALL SELECT seq FROM plain LEFT JOIN facts USING (tenant_id, job_id)
WHERE NOT coalesce(len(list_filter(names, lambda x: x = nm OR length(x) >= 4 AND length(nm) >= 4 AND (contains(x, nm) OR contains(x, ' ') AND contains(nm, x)))) > 0 OR r AND regexp_matches(nm, '{dedup.RESTROOM_WORDS}') OR c AND nm IN ('hallway', 'hall', 'corridor'), false)""",
    ),
    "d5_tile_rooms": (_run(lambda v: dedup.dedup_tile_rooms(v.rooms).select("seq")), f"WITH {views.SQL} SELECT seq FROM ({_first('rooms', 'sheet_id, lower(room_number), lower(room_name)')})"),
    "d6_dedup_signs": (
        _signs_for_dedup,
        f"""WITH {views.SQL} SELECT seq FROM ({_first("signs", "room_seq IS NOT NULL, CASE WHEN room_seq IS NOT NULL THEN upper(trim(room_number)) END, CASE WHEN room_seq IS NOT NULL THEN upper(trim(room_name)) END, upper(sign_type), upper(trim(coalesce(floor_label, '')))", "confidence DESC, CASE source WHEN 'schedule' THEN 3 WHEN 'rules_engine' THEN 2 ELSE 0 END DESC, seq")})""",
    ),
    "c1_takeoff_delta": (
        _delta,
        f"""WITH {views.SQL}, human AS (SELECT *, {_KEY} AS room_key FROM takeoff), found AS (SELECT *, {_KEY} AS room_key FROM rooms),
first_sign AS (SELECT room_seq, arg_min(sign_type, seq) AS t FROM signs WHERE room_seq IS NOT NULL GROUP BY 1)
SELECT tenant_id, job_id, 'matched' AS kind, seq, room_key, CAST(NULL AS VARCHAR) AS sign_type FROM human WHERE EXISTS (SELECT 1 FROM found f WHERE f.tenant_id = human.tenant_id AND f.job_id = human.job_id AND f.room_key = human.room_key)
UNION ALL SELECT tenant_id, job_id, 'missed', seq, room_key, {_PREDICT} FROM human WHERE NOT EXISTS (SELECT 1 FROM found f WHERE f.tenant_id = human.tenant_id AND f.job_id = human.job_id AND f.room_key = human.room_key)
UNION ALL SELECT tenant_id, job_id, 'extra', seq, room_key, coalesce(t, {_PREDICT}) FROM found LEFT JOIN first_sign ON room_seq = seq WHERE confidence >= 0.8 AND NOT EXISTS (SELECT 1 FROM human h WHERE h.tenant_id = found.tenant_id AND h.job_id = found.job_id AND h.room_key = found.room_key)""",
    ),
    "c3_score_presence": (
        _run(lambda v: matching.score_presence(_expected(v), _actual(v), ["room_number", "sign_type"])),
        f"""WITH {views.SQL}, {_PRESENT}, e AS (SELECT DISTINCT tenant_id, job_id, room_number, sign_type, 1 AS e FROM expected), a AS (SELECT DISTINCT tenant_id, job_id, room_number, sign_type, 1 AS a FROM actual),
c AS (SELECT tenant_id, job_id, count(e + a) AS tp, count(a) - count(e + a) AS fp, count(e) - count(e + a) AS fn FROM e FULL JOIN a USING (tenant_id, job_id, room_number, sign_type) GROUP BY 1, 2),
p AS (SELECT *, CASE WHEN tp + fp = 0 THEN 1.0 ELSE tp / (tp + fp) END AS precision, CASE WHEN tp + fn = 0 THEN 1.0 ELSE tp / (tp + fn) END AS recall FROM c)
SELECT *, CASE WHEN precision + recall = 0 THEN 0.0 ELSE 2 * precision * recall / (precision + recall) END AS f1 FROM p""",
    ),
    "c4_score_quantities": (
        _run(lambda v: matching.score_quantities(_expected(v), _actual(v), ["room_number", "sign_type"])),
        f"""WITH {views.SQL}, {_PRESENT}, e AS (SELECT tenant_id, job_id, room_number, sign_type, sum(qty) AS e FROM expected GROUP BY ALL), a AS (SELECT tenant_id, job_id, room_number, sign_type, sum(qty) AS a FROM actual GROUP BY ALL)
SELECT tenant_id, job_id, count(CASE WHEN e = a THEN 1 END) AS exact, count(CASE WHEN e <> a THEN 1 END) AS off, CAST(sum(e) AS BIGINT) AS expected_qty, CAST(sum(a) AS BIGINT) AS actual_qty, CAST(sum(abs(a - e)) AS BIGINT) AS abs_delta FROM e JOIN a USING (tenant_id, job_id, room_number, sign_type) GROUP BY 1, 2""",
    ),
    "c4_mismatches": (
        _run(lambda v: matching.quantity_mismatches(_expected(v), _actual(v), ["room_number", "sign_type"], 7)),
        f"""WITH {views.SQL}, {_PRESENT}, e AS (SELECT tenant_id, job_id, room_number, sign_type, sum(qty) AS e FROM expected GROUP BY ALL), a AS (SELECT tenant_id, job_id, room_number, sign_type, sum(qty) AS a FROM actual GROUP BY ALL),
m AS (SELECT *, row_number() OVER (PARTITION BY tenant_id, job_id ORDER BY abs(a - e) DESC, room_number, sign_type) AS i FROM e JOIN a USING (tenant_id, job_id, room_number, sign_type) WHERE a <> e)
SELECT tenant_id, job_id, count(*) AS n_mismatches, list(concat(upper(trim(room_number)), '|', upper(trim(sign_type)), ' expected ', e, ', got ', a, ' (', CASE WHEN a >= e THEN '+' ELSE '' END, a - e, ')') ORDER BY i) FILTER (WHERE i <= 7) AS mismatches FROM m GROUP BY 1, 2""",
    ),
    "c5_score_by_type": (
        _run(lambda v: matching.score_by_type(_expected(v), _actual(v))),
        f"""WITH {views.SQL}, {_PRESENT}, e AS (SELECT tenant_id, job_id, sign_type, sum(qty) AS e FROM expected GROUP BY ALL), a AS (SELECT tenant_id, job_id, sign_type, sum(qty) AS a FROM actual GROUP BY ALL)
SELECT tenant_id, job_id, sign_type, CAST(coalesce(e, 0) AS BIGINT) AS expected, CAST(coalesce(a, 0) AS BIGINT) AS got, CAST(coalesce(a, 0) - coalesce(e, 0) AS BIGINT) AS delta FROM e FULL JOIN a USING (tenant_id, job_id, sign_type)""",
    ),
    "c6_locate_schedule": (
        _run(lambda v: matching.locate_schedule(v.schedule, v.rooms).select("seq", "coord_x", "coord_y", "level")),
        f"""WITH {views.SQL}, base AS (SELECT *, {_N} AS n, regexp_replace({_N}, '^([A-Z]+)[0-9]([0-9]{{2,}})$', '\\1\\2') AS l FROM rooms WHERE {_N} <> ''),
e AS (SELECT tenant_id, job_id, n, min(seq) AS k FROM base GROUP BY ALL), m AS (SELECT tenant_id, job_id, l, min(seq) AS k FROM base GROUP BY ALL),
s AS (SELECT *, {_N} AS n, regexp_replace({_N}, '^([A-Z]+)[0-9]([0-9]{{2,}})$', '\\1\\2') AS l FROM schedule WHERE {_N} <> '')
SELECT s.seq, r.coord_x, r.coord_y, coalesce({_BY_NUMBER.replace('room_number', 's.room_number')}, r.level, nullif(trim(s.floor), ''), 'LEVEL 1') AS level
FROM s LEFT JOIN e ON e.tenant_id = s.tenant_id AND e.job_id = s.job_id AND e.n = s.n LEFT JOIN m ON m.tenant_id = s.tenant_id AND m.job_id = s.job_id AND m.l = s.l LEFT JOIN rooms r ON r.seq = coalesce(e.k, m.k)""",
    ),
    "c12_route_signs": (
        _run(lambda v: matching.route_schedule_signs(v.schedule.withColumn("sign_type", F.when(F.col("seq") % 4 == 0, F.col("room_name")).otherwise(F.col("room_number"))), v.rooms)),
        f"""WITH {views.SQL}, s AS (SELECT tenant_id, job_id, seq, upper(trim(CASE WHEN seq % 4 = 0 THEN room_name ELSE room_number END)) AS k FROM schedule),
r AS (SELECT tenant_id, job_id, upper(trim(room_number)) AS k, 1 AS p, coord_x, seq AS room_seq FROM rooms UNION ALL SELECT tenant_id, job_id, upper(trim(room_name)), 2, coord_x, seq FROM rooms)
SELECT tenant_id, job_id, seq, room_seq FROM (SELECT s.*, room_seq, row_number() OVER (PARTITION BY s.seq ORDER BY p, coord_x, room_seq) AS i FROM s JOIN r USING (tenant_id, job_id, k) WHERE k <> '') WHERE i = 1""",
    ),
    "c14_corridor_offset": (
        _run(_corridors),
        f"""WITH {views.SQL}, c AS (SELECT * FROM rooms WHERE {has("upper(room_name)", vocab.CORRIDOR)}), s AS (SELECT * FROM rooms WHERE NOT {has("upper(room_name)", vocab.CORRIDOR)}),
d AS (SELECT s.seq, c.coord_x AS cx, c.coord_y AS cy, row_number() OVER (PARTITION BY s.seq ORDER BY (c.coord_x - s.coord_x) * (c.coord_x - s.coord_x) + (c.coord_y - s.coord_y) * (c.coord_y - s.coord_y), c.seq) AS i FROM s JOIN c USING (tenant_id, job_id, sheet_id)
 WHERE (c.coord_x - s.coord_x) * (c.coord_x - s.coord_x) + (c.coord_y - s.coord_y) * (c.coord_y - s.coord_y) <= 900000000)
SELECT s.tenant_id, s.job_id, s.seq, CASE WHEN cx IS NULL THEN s.coord_x ELSE CAST(floor(s.coord_x + (cx - s.coord_x) * CAST(0.2 AS DOUBLE) + CAST(0.5 AS DOUBLE)) AS BIGINT) END AS coord_x, CASE WHEN cy IS NULL THEN s.coord_y ELSE CAST(floor(s.coord_y + (cy - s.coord_y) * CAST(0.2 AS DOUBLE) + CAST(0.5 AS DOUBLE)) AS BIGINT) END AS coord_y, cx IS NOT NULL AS moved FROM s LEFT JOIN d ON d.seq = s.seq AND i = 1""",
    ),
    "c16_occupant_load": (
        _run(lambda v: matching.join_occupant_load(v.rooms.select(*rules.JOB, "seq", "room_number"), v.rooms).select("seq", "load")),
        f"WITH {views.SQL}, l AS (SELECT tenant_id, job_id, {_N} AS n, arg_max(occupant_load, seq) AS load FROM rooms WHERE occupant_load IS NOT NULL GROUP BY ALL) SELECT seq, load FROM rooms r LEFT JOIN l ON l.tenant_id = r.tenant_id AND l.job_id = r.job_id AND l.n = upper(trim(r.room_number))",
    ),
    "c17_unseen_rooms": (
        _run(lambda v: matching.add_unseen_rooms(v.rooms.filter("seq % 2 = 0").select(*rules.JOB, "seq", "room_number"), v.rooms.filter("seq % 2 = 1")).select("seq")),
        f"WITH {views.SQL}, seen AS (SELECT DISTINCT tenant_id, job_id, {_N} AS n FROM rooms WHERE seq % 2 = 0), more AS (SELECT *, {_N} AS n FROM rooms WHERE seq % 2 = 1 AND {_N} <> ''), f AS ({_first('more', 'n')}) SELECT seq FROM rooms WHERE seq % 2 = 0 UNION ALL SELECT seq FROM f ANTI JOIN seen USING (tenant_id, job_id, n)",
    ),
}
