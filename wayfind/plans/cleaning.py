"""Registered queries of room and schedule filters, scope, strategy and final assembly."""

from __future__ import annotations

from pyspark.sql import functions as F

from wayfind import vocab
from wayfind.operators import cleaning, egress, rules
from wayfind.plans.buildings import _CORES, _EGRESS, _EVAC, _FLOORS
from wayfind.plans.drawings import _DRAWN, _drawn
from wayfind.plans.matching import _BY_NUMBER
from wayfind.plans.rules import ALL, ELEVATORS, EXITS, MAPS, ROOM_SIGNS, STAIRS, has, sql_in
from wayfind.plans.rules import _ready as ready
from wayfind.plans.sheets import SHEETS_SQL, _files, _sheets
from wayfind.sources import views
from wayfind.sources.views import Views


def _run(f):
    return lambda s, d: f(Views(s, d))


_U = "upper(trim(nm))"
_W = f"list_filter(string_split_regex({_U}, '\\s+'), lambda w: w <> '')"
_D = f"regexp_replace({_U}, '\\s+', '', 'g')"
_NAMES = "names_in AS (SELECT seq, CASE seq % 6 WHEN 0 THEN room_name WHEN 1 THEN concat(room_name, ' FLOOR BASE NAME') WHEN 2 THEN concat('A B ', room_name) WHEN 3 THEN concat(room_name, ' V.I.F.') WHEN 4 THEN concat('8''-4 ', room_name) ELSE concat('-', room_name, ' ', seq) END AS nm FROM rooms)"
_JUNK = f"""CASE WHEN {_U} = '' THEN false WHEN length({_U}) > 60 OR {has(_U, vocab.NOTE_PHRASES)} THEN true WHEN {has(_U, vocab.EXEMPT_UNIT)} THEN false
 ELSE len(list_filter({_W}, lambda w: regexp_matches(w, '^[A-Z0-9]$') OR w IN {sql_in(vocab.JUNK_WORDS)})) / len({_W}) > 0.4 OR len(list_filter({_W}, lambda w: w IN {sql_in(vocab.TABLE_WORDS)})) >= 3 OR {has(_U, vocab.JUNK_ROW)} OR {has(_U, vocab.NOT_A_NAME)}
 OR len({_W}) >= 3 AND len(list_filter({_W}, lambda w: length(w) > 2 OR w IN {sql_in(vocab.SHORT_WORDS)})) = 0 OR length({_D}) > 3 AND length(regexp_replace({_D}, '[^A-Z]', '', 'g')) / length({_D}) < 0.5 OR {has(_U, vocab.GARBLED)} END"""


def _junk(v):
    seq, name = F.col("seq"), F.col("room_name")
    told = F.when(seq % 6 == 0, name).when(seq % 6 == 1, F.concat(name, F.lit(" FLOOR BASE NAME"))).when(seq % 6 == 2, F.concat(F.lit("A B "), name)).when(seq % 6 == 3, F.concat(name, F.lit(" V.I.F."))).when(seq % 6 == 4, F.concat(F.lit("8'-4 "), name)).otherwise(F.concat(F.lit("-"), name, F.lit(" "), seq.cast("string")))
    return v.rooms.select("seq", cleaning.is_junk_room_name(told).alias("junk"))


def _categories(v):
    return _files(v).withColumn("file_category", F.when(F.col("page_count") % 3 == 0, "floor_plan").when(F.col("page_count") == 5, "sign_schedule").otherwise("other"))


def _strategy(v):
    return cleaning.job_strategy(v.jobs, v.schedule, _categories(v))


def _typed_by_job(v):
    """The whole schedule; in every fourth job all types are restrooms, so that both scopes occur."""
    return v.schedule.withColumn("sign_type", F.when(F.substring("job_id", 2, 20).cast("long") % 4 == 0, "Restroom").otherwise(F.col("sign_type")))


def _definitions(v):
    return v.jobs.select(*rules.JOB, F.when(F.col("status") == "pending", "EX").otherwise("D1").alias("type_code"), F.when(F.col("status") == "pending", "exit sign").otherwise("Office directory").alias("description"))


def _suppressed(v):
    return cleaning.suppress_undefined(v.signs.select(*rules.JOB, "seq", "sign_type"), _definitions(v)).select("seq")


def _guarded(spark, sf_dir):
    """Signs of all rooms, some of types that a building or room may not have, under the names of the job's definitions."""
    v, seq, job = Views(spark, sf_dir), F.col("seq"), F.substring("job_id", 2, 20).cast("long")
    given = v.signs.select("seq", F.when(seq % 7 == 0, "Unit ID").when(seq % 7 == 1, "Plaque").otherwise(F.col("sign_type")).alias("sign_type"))
    signs = ready(spark, sf_dir).select(*rules.JOB, "seq", "detected", "is_assembly").join(given, "seq")
    line = lambda n, code, told, when: F.when(when, F.struct(F.lit(n).alias("position"), F.lit(code).alias("type_code"), F.lit(told).alias("description")))
    lines = F.array(line(2, "B.2", "ROOM-ID plaque", job % 4 == 0), line(1, "A", " Room Identification", job % 2 == 0), line(3, "C", "Exit", job >= 0))
    definitions = v.jobs.select(*rules.JOB, F.explode(lines).alias("d")).filter("d is not null").select(*rules.JOB, "d.*")
    return cleaning.alias_types(cleaning.canonical_guard(signs), definitions).select("seq", "sign_type")


def _assembled(spark, sf_dir):
    v = Views(spark, sf_dir)
    r = rules.prepared_once(rules.asked(v.rooms), v.jobs)
    made = rules.signs_by_kind(r, "is_stair").select(*rules.JOB, "room_seq", "sign_type", "qty", "is_stair")
    out = cleaning.assemble_signs(made, r, egress.egress_signs(r))
    return out.groupBy(*rules.JOB, "sign_type").agg(F.sum("qty").alias("qty"))


def _reruled(v):
    made = rules.apply_rules(v.rooms, v.jobs)
    return cleaning.rerule(v.signs, made).groupBy("tenant_id", "source").agg(F.sum("qty").alias("qty"), F.count(F.lit(1)).alias("n"))


QUERIES = {
    "b13_junk_names": (_run(_junk), f"WITH {views.SQL}, {_NAMES} SELECT seq, {_JUNK} AS junk FROM names_in"),
    "b15_hard_rejects": (_run(lambda v: cleaning.hard_reject_rooms(v.rooms.withColumn("room_number", F.substring("room_number", -2, 2))).select("seq")), f"WITH {views.SQL} SELECT seq FROM rooms WHERE NOT ({has('upper(trim(right(room_number, 2)))', vocab.SHORT_NUMBER)} AND {has('upper(trim(room_name))', vocab.ANNOTATION)})"),
    "b28_corridor_rows": (_run(lambda v: cleaning.drop_corridor_schedule(v.schedule.withColumns({"room_name": F.regexp_replace(F.upper("room_name"), "^CORR$", "CORRIDOR"), "message": F.when(F.col("seq") % 4 == 0, "x")})).select("seq")), f"WITH {views.SQL} SELECT seq FROM schedule WHERE NOT ({has('''regexp_replace(upper(trim(room_name)), '^CORR$', 'CORRIDOR')''', vocab.PLAIN_CORRIDOR)} AND seq % 4 <> 0)"),
    "b30_egress_rooms": (_run(lambda v: cleaning.keep_egress_rooms(v.rooms).select("seq")), f"WITH {views.SQL} SELECT seq FROM rooms WHERE {has('upper(room_name)', vocab.EGRESS_NAMES)} AND NOT {has('upper(room_name)', vocab.CORRIDOR)}"),
    "b31_room_levels": (
        _run(lambda v: cleaning.resolve_room_level(v.rooms, _sheets(v).select(*rules.JOB, "sheet_id", F.when(F.col("page") % 2 == 0, F.concat(F.lit("LEVEL "), F.col("page").cast("string"))).alias("level"))).select("seq", "level")),
        f"WITH {views.SQL}, {SHEETS_SQL} SELECT seq, coalesce({_BY_NUMBER}, CASE WHEN page % 2 = 0 THEN concat('LEVEL ', page) END, level) AS level FROM rooms JOIN (SELECT sheet_id, page FROM sheets) USING (sheet_id)",
    ),
    "d13_scope": (
        _run(lambda v: cleaning.job_scope(v.schedule, _drawn(v))),
        f"""WITH {views.SQL}, {SHEETS_SQL}, {_DRAWN} SELECT tenant_id, job_id FROM schedule GROUP BY 1, 2 HAVING bool_and({has("upper(sign_type)", vocab.RESTROOM_SCOPE)})
UNION SELECT tenant_id, job_id FROM drawn GROUP BY 1, 2 HAVING count(CASE WHEN {has("sheet_no", "^A-?[0-9]")} THEN 1 END) > 0 AND NOT bool_or({has("title", vocab.GENERAL_TITLE)}) AND count(CASE WHEN {has("sheet_no", "^A-?[0-9]")} AND {has("title", vocab.RESTROOM_TITLE)} THEN 1 END) / count(CASE WHEN {has("sheet_no", "^A-?[0-9]")} THEN 1 END) >= 0.8""",
    ),
    "d13_scope_whole": (
        _run(lambda v: cleaning.job_scope(_typed_by_job(v), _sheets(v))),
        f"""WITH {views.SQL}, {SHEETS_SQL}, s AS (SELECT tenant_id, job_id, CASE WHEN CAST(substring(job_id, 2) AS BIGINT) % 4 = 0 THEN 'Restroom' ELSE sign_type END AS sign_type FROM schedule)
SELECT tenant_id, job_id FROM s GROUP BY 1, 2 HAVING bool_and({has("upper(sign_type)", vocab.RESTROOM_SCOPE)})
UNION SELECT tenant_id, job_id FROM sheets GROUP BY 1, 2 HAVING count(CASE WHEN {has("sheet_no", "^A-?[0-9]")} THEN 1 END) > 0 AND NOT bool_or({has("title", vocab.GENERAL_TITLE)}) AND count(CASE WHEN {has("sheet_no", "^A-?[0-9]")} AND {has("title", vocab.RESTROOM_TITLE)} THEN 1 END) / count(CASE WHEN {has("sheet_no", "^A-?[0-9]")} THEN 1 END) >= 0.8""",
    ),
    "d13_strategy": (
        _run(_strategy),
        f"""WITH {views.SQL}, {SHEETS_SQL}, r AS (SELECT tenant_id, job_id, count(*) AS n FROM schedule GROUP BY 1, 2)
SELECT j.tenant_id, j.job_id, CASE WHEN coalesce(page_count = 5, false) OR coalesce(n, 0) >= 100 THEN 'schedule_primary' WHEN coalesce(page_count, 0) % 3 <> 0 OR page_count IS NULL THEN 'egress_only' WHEN coalesce(n, 0) > 0 THEN 'hybrid' ELSE 'floor_plan_primary' END AS strategy FROM jobs j LEFT JOIN r USING (tenant_id, job_id) LEFT JOIN files USING (tenant_id, job_id)""",
    ),
    "d13_strategy_whole": (
        _run(lambda v: cleaning.job_strategy(v.jobs, v.schedule.filter("type_mark is null"), _categories(v))),
        f"""WITH {views.SQL}, {SHEETS_SQL}, r AS (SELECT tenant_id, job_id, count(*) AS n FROM schedule WHERE type_mark IS NULL GROUP BY 1, 2)
SELECT j.tenant_id, j.job_id, CASE WHEN coalesce(page_count = 5, false) OR coalesce(n, 0) >= 100 THEN 'schedule_primary' WHEN coalesce(page_count, 0) % 3 <> 0 OR page_count IS NULL THEN 'egress_only' WHEN coalesce(n, 0) > 0 THEN 'hybrid' ELSE 'floor_plan_primary' END AS strategy FROM jobs j LEFT JOIN r USING (tenant_id, job_id) LEFT JOIN files USING (tenant_id, job_id)""",
    ),
    "e11_suppressed": (_run(_suppressed), f"WITH {views.SQL} SELECT seq FROM signs LEFT JOIN jobs USING (tenant_id, job_id) WHERE NOT (status IS NOT NULL AND (sign_type = 'Exit' AND status <> 'pending' OR sign_type = 'Evacuation Map'))"),
    "e11_guarded": (
        _guarded,
        f"""WITH {ALL}, g AS (SELECT s.seq, CASE s.seq % 7 WHEN 0 THEN 'Unit ID' WHEN 1 THEN 'Plaque' ELSE s.sign_type END AS sign_type, r.detected, r.type_group, r.is_assembly, CAST(substring(r.job_id, 2) AS BIGINT) AS job FROM signs s JOIN ready r USING (seq))
SELECT seq, CASE WHEN sign_type = 'Room ID' AND job % 4 = 0 THEN 'Type B.2' WHEN sign_type = 'Room ID' AND job % 2 = 0 THEN 'Type A' ELSE sign_type END AS sign_type FROM g
WHERE sign_type IN {sql_in(vocab.CANONICAL)} AND NOT (sign_type = 'Unit ID' AND NOT (detected IN {sql_in(vocab.UNIT_SIGN_TYPES)} OR type_group IN {sql_in(vocab.UNIT_SIGN_TYPES)})) AND NOT (sign_type = 'Max Occupancy' AND NOT is_assembly)""",
    ),
    "e22_rerule": (
        _run(_reruled),
        f"""WITH {ALL}, {ROOM_SIGNS}, {STAIRS}, {ELEVATORS}, {MAPS}, {EXITS},
every AS (SELECT tenant_id, qty, source FROM signs WHERE source <> 'rules_engine' UNION ALL SELECT tenant_id, qty, 'rules_engine' FROM room_signs UNION ALL SELECT tenant_id, qty, 'rules_engine' FROM stair_signs
 UNION ALL SELECT tenant_id, qty, 'rules_engine' FROM elevator_signs UNION ALL SELECT tenant_id, 1, 'rules_engine' FROM (SELECT tenant_id, unnest(range(1, maps + 1)) FROM maps WHERE maps > 0) UNION ALL SELECT tenant_id, qty, 'rules_engine' FROM exit_signs)
SELECT tenant_id, source, CAST(sum(qty) AS BIGINT) AS qty, count(*) AS n FROM every GROUP BY 1, 2""",
    ),
    "e22_sign_sheets": (
        _run(lambda v: cleaning.place_on_sheets(v.signs.select(*rules.JOB, "seq", "room_seq"), v.rooms.withColumn("sheet_id", F.when(F.col("seq") % 3 == 0, F.col("sheet_id")))).select("seq", "sheet_id")),
        f"""WITH {views.SQL}, r AS (SELECT tenant_id, job_id, seq, level, CASE WHEN seq % 3 = 0 THEN sheet_id END AS own FROM rooms),
l AS (SELECT tenant_id, job_id, level, arg_min(own, seq) AS s FROM r WHERE own IS NOT NULL GROUP BY ALL), f AS (SELECT tenant_id, job_id, arg_min(own, seq) AS s FROM r WHERE own IS NOT NULL GROUP BY ALL)
SELECT g.seq, coalesce(r.own, l.s, f.s) AS sheet_id FROM signs g LEFT JOIN r ON r.seq = g.room_seq LEFT JOIN l ON r.seq IS NOT NULL AND l.tenant_id = r.tenant_id AND l.job_id = r.job_id AND l.level IS NOT DISTINCT FROM r.level
 LEFT JOIN f ON f.tenant_id = g.tenant_id AND f.job_id = g.job_id""",
    ),
    "e23_assembly": (
        _assembled,
        f"""WITH {ALL}, {ROOM_SIGNS}, {_FLOORS}, {_CORES}, {_EVAC}, {_EGRESS},
a AS (SELECT s.tenant_id, s.job_id, sign_type, qty FROM room_signs s JOIN ready r USING (seq) WHERE NOT (sign_type IN ('Stair(Corridor)', 'Stair(Landing)', 'Evacuation Map', 'Area of Rescue') OR sign_type = 'Exit' AND is_stair) UNION ALL SELECT tenant_id, job_id, sign_type, qty FROM egress)
SELECT tenant_id, job_id, sign_type, CAST(sum(qty) AS BIGINT) AS qty FROM a GROUP BY 1, 2, 3""",
    ),
}
