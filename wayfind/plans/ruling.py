"""Registered queries of the whole rules engine and of re-ruled jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from wayfind import vocab
from wayfind.operators import rules, ruling
from wayfind.plans.reviews import _learned
from wayfind.plans.rules import _DOORS, DETECTED, ELEVATORS, EXITS, FLAGS, MAPS, NAME, PREPARED, ROOM_SIGNS, STAIRS, has, sql_in
from wayfind.sources import views
from wayfind.sources.views import Views


def _run(f):
    return lambda s, d: f(Views(s, d))


def _overrides(v):
    """Tenants up to t3 have overrides, one for each distinct correction."""
    return _learned(v).filter("tenant_id < 't4'")


def _keywords(v):
    """Tenants up to t2 list words of their own."""
    return v.jobs.filter("tenant_id < 't3'").select("tenant_id", F.explode(F.array(F.lit(" office "), F.lit("/ Comm"))).alias("keyword"))


def _definitions(v):
    """Half of the jobs define types: exits or directories, and their own name of a Room ID; some define none."""
    job = F.substring("job_id", 2, 20).cast("long")
    line = lambda n, code, told, when: F.when(when, F.struct(F.lit(n).alias("position"), F.lit(code).alias("type_code"), F.lit(told).alias("description")))
    lines = F.array(line(1, "EX", "exit sign", job % 3 == 1), line(1, "D1", "Office directory", job % 3 == 2), line(2, "B.2", "ROOM-ID plaque", job % 4 == 0), line(3, "B.3", "Room Identification", job % 8 == 0))
    return v.jobs.select(*rules.JOB, F.explode(lines).alias("d")).filter("d is not null").select(*rules.JOB, "d.*")


def _ruled(v):
    rooms = v.rooms.withColumn("occupancy_group", F.lit(None).cast("string"))
    ready = rules.prepared_once(rules.asked(rooms), v.jobs, _keywords(v))
    return ruling.rule_jobs(ready, _overrides(v), _definitions(v))


def _quantities(v):
    return rules.sign_quantities(ruling.standing(_ruled(v)))


def _stored(v):
    return v.signs.select(*rules.JOB, "room_seq", "sign_type", "qty", F.lit(None).cast("string").alias("rule_ref"), F.col("confidence"), F.lit(None).cast("string").alias("sheet_id"), "source", F.lit(0).cast("long").alias("generation"))


def _again(v):
    """Every third room has a sheet, so that the level's and the job's first ones are needed."""
    rooms = v.rooms.withColumns({"occupancy_group": F.lit(None).cast("string"), "sheet_id": F.when(F.col("seq") % 3 == 0, F.col("sheet_id"))})
    return ruling.reruled(rooms, v.jobs, _overrides(v), _keywords(v))


def _merged(v):
    out = ruling.merge_ruled(_stored(v), *_again(v), 1)
    return out.groupBy(*rules.JOB, "source", "generation", "sheet_id", "sign_type").agg(F.sum("qty").alias("qty"), F.count(F.lit(1)).alias("n"))


_OWN_DOORS = f"(CASE WHEN {has(NAME, vocab.MULTI_ENTRY)} OR tenant_id < 't3' AND {has(NAME, chr(92) + 'bOFFICE' + chr(92) + 'b|/ COMM' + chr(92) + 'b')} THEN 3 ELSE 1 END)"
_VALID = f"(x.sign_type IN {sql_in(vocab.CANONICAL)} AND (x.sign_type <> 'Max Occupancy' OR f.is_assembly))"
_STATED = "detected AS (SELECT tenant_id, job_id, coalesce(nullif(building_type, ''), 'commercial') AS detected FROM jobs)"


def _folded(detected: str = DETECTED) -> str:
    """Rooms' signs after the overrides, as lists of kept and dropped ones, from one fold for each distinct start."""
    return f"""{views.SQL}, {FLAGS}, {detected}, {PREPARED}, {ROOM_SIGNS.replace(_DOORS, _OWN_DOORS)},
learned AS (SELECT tenant_id, lower(trim(room_name_pattern)) AS p, sign_type, CASE correction_type WHEN 'ai_missed' THEN 'add' WHEN 'ai_extra' THEN 'exclude' WHEN 'edit' THEN 'modify_qty' ELSE 'sign_type' END AS kind, min(seq) AS o, least(CAST(0.99 AS DOUBLE), CAST(0.75 AS DOUBLE) + count(*) * CAST(0.05 AS DOUBLE)) AS confidence
 FROM corrections WHERE tenant_id < 't4' GROUP BY tenant_id, room_name_pattern, sign_type, correction_type),
kinds AS (SELECT DISTINCT tenant_id, room_name FROM open_rooms),
met AS (SELECT k.tenant_id, k.room_name, l.sign_type, l.kind, l.o, CASE l.kind WHEN 'modify_qty' THEN l.o % 3 + 1 ELSE 1 END AS qty, row_number() OVER (PARTITION BY k.tenant_id, k.room_name, l.kind IN ('add', 'sign_type') ORDER BY l.confidence DESC, l.o) AS place
 FROM kinds k JOIN learned l ON l.tenant_id = k.tenant_id AND l.p <> '' AND (lower(trim(k.room_name)) = l.p OR length(l.p) >= 3 AND contains(lower(trim(k.room_name)), l.p)
  OR len(list_filter(string_split_regex(l.p, '\\s+'), lambda w: length(w) > 2)) > 0 AND len(list_filter(string_split_regex(l.p, '\\s+'), lambda w: length(w) > 2 AND NOT contains(lower(trim(k.room_name)), w))) = 0)),
steps AS (SELECT *, row_number() OVER (PARTITION BY tenant_id, room_name ORDER BY o) AS k FROM met WHERE kind NOT IN ('add', 'sign_type') OR place <= 2),
lists AS (SELECT r.tenant_id, r.job_id, r.seq, r.room_name, r.is_assembly, r.detected, r.type_group, coalesce(list({{'t': s.sign_type, 'q': CAST(s.qty AS BIGINT), 'r': s.rule_ref}} ORDER BY s.sign_type) FILTER (WHERE s.seq IS NOT NULL), []) AS s FROM open_rooms r LEFT JOIN room_signs s ON s.seq = r.seq GROUP BY ALL),
starts AS (SELECT DISTINCT tenant_id, room_name, is_assembly, s FROM lists),
fold AS (SELECT tenant_id, room_name, is_assembly, s AS start, CAST(0 AS BIGINT) AS k, s, s[1:0] AS dropped, false AS done FROM starts
 UNION ALL SELECT f.tenant_id, f.room_name, f.is_assembly, f.start, x.k, CASE WHEN f.done THEN f.s WHEN x.kind = 'add' THEN list_append(f.s, {{'t': x.sign_type, 'q': x.qty, 'r': concat('learned:', x.o)}}) WHEN x.kind = 'exclude' THEN list_filter(f.s, lambda e: e.t <> x.sign_type)
  WHEN x.kind = 'modify_qty' THEN list_transform(f.s, lambda e: {{'t': e.t, 'q': CASE WHEN e.t = x.sign_type THEN x.qty ELSE e.q END, 'r': e.r}}) WHEN {_VALID} THEN [{{'t': x.sign_type, 'q': x.qty, 'r': concat('learned:', x.o)}}] ELSE f.s END,
  CASE WHEN f.done THEN f.dropped WHEN x.kind = 'exclude' THEN list_concat(f.dropped, list_transform(list_filter(f.s, lambda e: e.t = x.sign_type), lambda e: {{'t': e.t, 'q': -1, 'r': e.r}})) WHEN x.kind = 'sign_type' AND {_VALID} THEN list_concat(f.dropped, list_transform(f.s, lambda e: {{'t': e.t, 'q': -2, 'r': e.r}})) ELSE f.dropped END,
  f.done OR x.kind = 'sign_type' AND {_VALID} FROM fold f JOIN steps x ON x.tenant_id = f.tenant_id AND x.room_name = f.room_name AND x.k = f.k + 1),
last AS (SELECT tenant_id, room_name, is_assembly, start, arg_max(s, k) AS s, arg_max(dropped, k) AS dropped FROM fold GROUP BY ALL),
met_rooms AS (SELECT l.tenant_id, l.job_id, l.seq, l.detected, l.type_group, l.is_assembly, unnest(list_concat(f.s, f.dropped)) AS e FROM lists l JOIN last f ON f.tenant_id = l.tenant_id AND f.room_name = l.room_name AND f.is_assembly = l.is_assembly AND f.start = l.s),
room_lines AS (SELECT tenant_id, job_id, seq AS room_seq, e.t AS sign_type, CASE WHEN e.q > 0 THEN e.q END AS qty, e.r AS rule_ref, CASE WHEN e.q = -1 THEN 'excluded' WHEN e.q = -2 THEN 'replaced' END AS gone, is_assembly, detected IN {sql_in(vocab.UNIT_SIGN_TYPES)} OR type_group IN {sql_in(vocab.UNIT_SIGN_TYPES)} AS units FROM met_rooms),
{STAIRS}, {ELEVATORS}, {MAPS}"""


_JOB_LINES = """ UNION ALL SELECT tenant_id, job_id, NULL, sign_type, qty, rule_ref, NULL, true, true FROM stair_signs UNION ALL SELECT tenant_id, job_id, NULL, sign_type, qty, rule_ref, NULL, true, true FROM elevator_signs
 UNION ALL SELECT tenant_id, job_id, NULL, 'Evacuation Map', 1, 'R13', NULL, true, true FROM (SELECT tenant_id, job_id, unnest(range(1, maps + 1)) FROM maps WHERE maps > 0)"""
_J = "CAST(substring(job_id, 2) AS BIGINT)"
_WHY = f"""coalesce(gone, CASE WHEN {{defined}} AND (sign_type IN ('Exit', 'Exit(Tactile)') AND {_J} % 3 <> 1 OR sign_type = 'Evacuation Map' OR sign_type IN ('Office Directory', 'Building ID') AND {_J} % 3 <> 2) THEN 'not in definitions'
 WHEN sign_type NOT IN {sql_in(vocab.CANONICAL)} THEN 'not canonical' WHEN sign_type = 'Unit ID' AND NOT units THEN 'no units here' WHEN sign_type = 'Max Occupancy' AND NOT is_assembly THEN 'no assembly room' END)"""
_DEFINED = f"EXISTS (SELECT 1 FROM jobs j WHERE j.tenant_id = every_line.tenant_id AND j.job_id = every_line.job_id) AND ({_J} % 3 <> 0 OR {_J} % 4 = 0)"
_ALL_LINES = f"""WITH RECURSIVE {_folded()}, {EXITS},
every_line AS (SELECT * FROM room_lines{_JOB_LINES} UNION ALL SELECT tenant_id, job_id, NULL, sign_type, qty, rule_ref, NULL, true, true FROM exit_signs),
judged AS (SELECT *, {_WHY.format(defined=_DEFINED)} AS reason FROM every_line)"""

QUERIES = {
    "e16_ruled": (
        _run(_quantities),
        f"""{_ALL_LINES} SELECT tenant_id, job_id, CASE WHEN sign_type = 'Room ID' AND {_J} % 8 = 0 THEN 'Type B.3' WHEN sign_type = 'Room ID' AND {_J} % 4 = 0 THEN 'Type B.2' ELSE sign_type END AS sign_type, CAST(sum(qty) AS BIGINT) AS qty, count(*) AS n_lines FROM judged WHERE reason IS NULL GROUP BY 1, 2, 3""",
    ),
    "e16_suppressed": (_run(lambda v: ruling.suppressed(_ruled(v))), f"{_ALL_LINES} SELECT tenant_id, job_id, room_seq, rule_ref, sign_type, reason FROM judged WHERE reason IS NOT NULL"),
    "e22_merged": (
        _run(_merged),
        f"""WITH RECURSIVE {_folded(_STATED)},
every_line AS (SELECT * FROM room_lines{_JOB_LINES}), judged AS (SELECT *, {_WHY.format(defined="false")} AS reason FROM every_line),
again AS (SELECT tenant_id, job_id FROM jobs WHERE status NOT IN ('processing', 'pending') AND EXISTS (SELECT 1 FROM rooms r WHERE r.tenant_id = jobs.tenant_id AND r.job_id = jobs.job_id)),
r AS (SELECT tenant_id, job_id, seq, level, CASE WHEN seq % 3 = 0 THEN sheet_id END AS own FROM rooms),
l AS (SELECT tenant_id, job_id, level, arg_min(own, seq) AS s FROM r WHERE own IS NOT NULL GROUP BY ALL), f AS (SELECT tenant_id, job_id, arg_min(own, seq) AS s FROM r WHERE own IS NOT NULL GROUP BY ALL),
new AS (SELECT g.tenant_id, g.job_id, 'rules_engine' AS source, 1 AS generation, coalesce(r.own, l.s, f.s) AS sheet_id, g.sign_type, g.qty FROM judged g JOIN again USING (tenant_id, job_id) LEFT JOIN r ON r.seq = g.room_seq
 LEFT JOIN l ON r.seq IS NOT NULL AND l.tenant_id = g.tenant_id AND l.job_id = g.job_id AND l.level IS NOT DISTINCT FROM r.level LEFT JOIN f ON f.tenant_id = g.tenant_id AND f.job_id = g.job_id WHERE reason IS NULL),
old AS (SELECT tenant_id, job_id, source, 0 AS generation, CAST(NULL AS VARCHAR) AS sheet_id, sign_type, qty FROM signs WHERE source <> 'rules_engine' OR (tenant_id, job_id) NOT IN (SELECT (tenant_id, job_id) FROM again))
SELECT tenant_id, job_id, source, CAST(generation AS BIGINT) AS generation, sheet_id, sign_type, CAST(sum(qty) AS BIGINT) AS qty, count(*) AS n FROM (SELECT * FROM new UNION ALL SELECT * FROM old) GROUP BY ALL""",
    ),
    "e22_totals": (
        _run(lambda v: ruling.rerule_totals(*_again(v))),
        f"""WITH RECURSIVE {_folded(_STATED)},
every_line AS (SELECT * FROM room_lines{_JOB_LINES}), judged AS (SELECT *, {_WHY.format(defined="false")} AS reason FROM every_line),
again AS (SELECT tenant_id, job_id FROM jobs WHERE status NOT IN ('processing', 'pending') AND EXISTS (SELECT 1 FROM rooms r WHERE r.tenant_id = jobs.tenant_id AND r.job_id = jobs.job_id))
SELECT tenant_id, job_id, count(sign_type) AS signs_updated, CAST(coalesce(sum(qty), 0) AS BIGINT) AS total_qty FROM again LEFT JOIN (SELECT * FROM judged WHERE reason IS NULL) g USING (tenant_id, job_id) GROUP BY 1, 2""",
    ),
}
