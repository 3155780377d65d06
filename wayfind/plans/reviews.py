"""Registered queries of corrections, reviews, markers and overrides."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from wayfind import vocab
from wayfind.operators import egress, learning, matching, rules
from wayfind.plans.matching import _PREDICT
from wayfind.plans.rules import ALL, sql_in
from wayfind.sources import views
from wayfind.sources.views import Views


def _run(f):
    return lambda s, d: f(Views(s, d))


def _human(v):
    return v.signs.filter("seq % 3 <> 0").select(*rules.JOB, "seq", "room_name", "sign_type")


def _messages(v):
    seq = F.col("seq")
    return v.signs.select(*rules.JOB, "seq", F.when(seq % 3 == 0, F.col("room_seq")).alias("room_seq"), F.when(seq % 5 == 0, "").otherwise(F.col("room_number")).alias("room_number"), F.when(seq % 3 == 1, F.concat(F.lit("Exit | "), "room_number", F.lit(" | x"))).alias("message"), F.when(seq % 2 == 0, F.lit("s")).alias("sheet_id"))


def _review(v):
    actions = v.jobs.filter("status = 'completed'").select(*rules.JOB, F.when(F.substring("job_id", 2, 20).cast("long") % 2 == 0, "First Floor").alias("level"), F.when(F.substring("job_id", 2, 20).cast("long") % 3 == 0, "pending").alias("from_status"), F.lit("dismissed").alias("to_status"))
    return matching.apply_review(v.rooms, actions)


def _patterns(v):
    mined = learning.mine_patterns(v.corrections)
    old = learning.mine_patterns(v.corrections.filter("seq % 2 = 0")).select("tenant_id", "correction_type", F.concat("pattern", F.when(F.col("evidence") % 2 == 0, "").otherwise(" OLD")).alias("pattern"), "sign_type", "evidence", "status")
    return mined, old


#: What each kind of correction does to the signs of the rooms it names.
_OVERRIDE = {"ai_missed": "add", "ai_extra": "exclude", "edit": "modify_qty", "sign_type_override": "sign_type"}


def _learned(v):
    """An override for each distinct (tenant, pattern, sign type, kind) of all corrections."""
    key = ["tenant_id", "room_name_pattern", "sign_type", "correction_type"]
    found = v.corrections.groupBy(*key).agg(F.min("seq").alias("seq"), F.count(F.lit(1)).alias("n"))
    kind = F.coalesce(*(F.when(F.col("correction_type") == c, F.lit(k)) for c, k in _OVERRIDE.items()))
    none = lambda kind: F.lit(None).cast(kind)
    qty = F.when(kind == "modify_qty", F.col("seq") % 3 + 1).otherwise(1).cast("int")
    return found.select("tenant_id", "seq", F.concat(F.lit("learned:"), F.col("seq").cast("string")).alias("rule_ref"), kind.alias("override_type"), "sign_type", qty.alias("qty"), F.least(F.lit(0.99), 0.75 + F.col("n") * 0.05).alias("confidence"), none("string").alias("c_contains"), F.col("room_name_pattern").alias("c_pattern"), none("string").alias("c_number"), none("string").alias("c_group"), *(none("boolean").alias(f"c_{k}") for k in egress._FLAGS))


def _overridden(v):
    """Room signs after the overrides that all corrections of a tenant give."""
    ready = rules.prepared(v.rooms, v.jobs).withColumn("occupancy_group", F.lit(None).cast("string"))
    one = F.array(F.struct(F.lit("Room ID").alias("sign_type"), F.lit(1).alias("qty"), F.lit("R1").alias("rule_ref"), F.lit(0.85).alias("confidence")))
    out = egress.apply_overrides(ready.withColumn("signs", one), _learned(v))
    return out.select(*rules.JOB, "seq", F.inline("signs")).groupBy(*rules.JOB, "sign_type").agg(F.sum("qty").alias("qty"))


def _located(v):
    """Signs with the place of their room; those whose deletion flag is set count as moved by hand."""
    at = v.rooms.select("seq", "coord_x", "coord_y")
    return v.signs.select(*rules.JOB, "seq", "room_number", F.col("floor_label").alias("level"), "sign_type", F.col("is_deleted").alias("moved")).join(at, "seq")


_HUMAN = "human AS (SELECT tenant_id, job_id, seq, room_name, sign_type FROM signs WHERE seq % 3 <> 0)"
_DIFFS = f"""{_HUMAN}, known AS (SELECT tenant_id, room_name_pattern AS room_name, arg_max(sign_type, seq) AS known_type FROM corrections GROUP BY 1, 2),
diffs AS (SELECT h.tenant_id, h.job_id, h.seq, room_name, sign_type, {_PREDICT} AS suggested, known_type, CASE WHEN known_type IS NULL THEN 'new' WHEN known_type = sign_type THEN 'duplicate' ELSE 'conflict' END AS category FROM human h LEFT JOIN known USING (tenant_id, room_name) WHERE {_PREDICT} <> sign_type)"""
_MINED = "SELECT tenant_id, correction_type, upper(room_name_pattern) AS pattern, sign_type, count(*) AS evidence, CASE WHEN count(*) >= 3 THEN 'approved' ELSE 'pending' END AS status FROM corrections WHERE is_active AND length(room_name_pattern) >= 3 AND NOT regexp_matches(room_name_pattern, 'FINISH.?SCHEDULE') AND {} GROUP BY 1, 2, 3, 4 HAVING count(*) >= 2"

_VALID = f"(x.sign_type IN {sql_in(vocab.CANONICAL)} AND (x.sign_type <> 'Max Occupancy' OR f.is_assembly))"

QUERIES = {
    "c2_takeoff_diffs": (_run(lambda v: matching.takeoff_diffs(_human(v), v.corrections)), f"WITH {views.SQL}, {_DIFFS} SELECT * FROM diffs"),
    "c2_collisions": (_run(lambda v: matching.diff_collisions(matching.takeoff_diffs(_human(v), v.corrections), v.corrections)), f"WITH {views.SQL}, {_DIFFS} SELECT DISTINCT d.tenant_id, d.room_name, d.sign_type FROM diffs d JOIN corrections c ON c.tenant_id = d.tenant_id AND c.room_name_pattern = d.room_name AND c.sign_type = d.sign_type"),
    "c13_markers": (
        _run(lambda v: matching.fill_markers(_messages(v), v.rooms)),
        f"""WITH {views.SQL}, m AS (SELECT tenant_id, job_id, seq, CASE WHEN seq % 3 = 0 THEN room_seq END AS room_seq, CASE WHEN seq % 5 = 0 THEN '' ELSE room_number END AS n, CASE WHEN seq % 3 = 1 THEN trim(room_number) END AS told FROM signs),
l AS (SELECT tenant_id, job_id, room_number AS n, max(seq) AS k FROM rooms WHERE room_number <> '' GROUP BY ALL)
SELECT m.tenant_id, m.job_id, m.seq, coalesce(m.room_seq, a.k, b.k) AS room_seq, CASE WHEN r.seq IS NOT NULL THEN least(100000, greatest(0, r.coord_x)) WHEN m.seq % 2 = 0 THEN 50000 END AS marker_x, CASE WHEN r.seq IS NOT NULL THEN least(100000, greatest(0, r.coord_y)) WHEN m.seq % 2 = 0 THEN 50000 END AS marker_y
FROM m LEFT JOIN l a ON a.tenant_id = m.tenant_id AND a.job_id = m.job_id AND a.n = m.told LEFT JOIN l b ON b.tenant_id = m.tenant_id AND b.job_id = m.job_id AND b.n = m.n LEFT JOIN rooms r ON r.seq = coalesce(m.room_seq, a.k, b.k)""",
    ),
    "c19_placements": (
        _run(lambda v: matching.restore_placements(v.rooms.filter("room_number <> '' and level is not null"), v.rooms.filter("seq % 4 = 0 and level is not null")).select("seq", "coord_x", "coord_y")),
        f"WITH {views.SQL}, p AS (SELECT tenant_id, job_id, room_number, level, min(seq) AS k FROM rooms WHERE seq % 4 = 0 AND level IS NOT NULL GROUP BY ALL) SELECT r.seq, coalesce(q.coord_x, r.coord_x) AS coord_x, coalesce(q.coord_y, r.coord_y) AS coord_y FROM rooms r LEFT JOIN p USING (tenant_id, job_id, room_number, level) LEFT JOIN rooms q ON q.seq = k WHERE r.room_number <> '' AND r.level IS NOT NULL",
    ),
    "c19_sign_placements": (
        _run(lambda v: matching.restore_sign_placements(_located(v), _located(v).filter("moved")).select("seq", "coord_x", "coord_y")),
        f"""WITH {views.SQL}, s AS (SELECT g.seq, g.tenant_id, g.job_id, coalesce(g.room_number, '') AS nr, coalesce(g.floor_label, '') AS lv, g.sign_type, r.coord_x, r.coord_y, g.is_deleted AS moved FROM signs g JOIN rooms r ON r.seq = g.seq),
p AS (SELECT tenant_id, job_id, nr, lv, sign_type, min(seq) AS k FROM s WHERE moved GROUP BY ALL)
SELECT s.seq, coalesce(q.coord_x, s.coord_x) AS coord_x, coalesce(q.coord_y, s.coord_y) AS coord_y FROM s LEFT JOIN p USING (tenant_id, job_id, nr, lv, sign_type) LEFT JOIN s q ON q.seq = k""",
    ),
    "c20_review": (
        _run(lambda v: matching.cascade_review(v.signs.select(*rules.JOB, "seq", "room_seq", "is_deleted"), _review(v))),
        f"""WITH {views.SQL}, a AS (SELECT tenant_id, job_id, CAST(substring(job_id, 2) AS BIGINT) AS j FROM jobs WHERE status = 'completed'),
d AS (SELECT seq FROM rooms r LEFT JOIN a USING (tenant_id, job_id) WHERE CASE WHEN j IS NOT NULL AND source = 'ai_vision' AND (j % 2 <> 0 OR level = 'First Floor') AND (j % 3 <> 0 OR review_status = 'pending') THEN 'dismissed' ELSE review_status END = 'dismissed')
SELECT s.tenant_id, s.job_id, s.seq, s.room_seq, CASE WHEN d.seq IS NOT NULL THEN true ELSE s.is_deleted END AS is_deleted FROM signs s LEFT JOIN d ON d.seq = s.room_seq""",
    ),
    "c22_schedule_signs": (
        _run(lambda v: matching.schedule_to_signs(v.schedule, v.rooms)),
        f"""WITH {views.SQL}, f AS (SELECT tenant_id, job_id, upper(trim(room_number)) AS n, arg_min_null(level, seq) AS lv FROM rooms WHERE trim(room_number) <> '' GROUP BY ALL)
SELECT s.tenant_id, s.job_id, s.seq, s.sign_type, s.quantity AS qty, coalesce(lv, s.floor) AS floor_label, concat_ws(' | ', nullif(trim(s.sign_type), ''), nullif(trim(s.room_number), ''), nullif(trim(s.room_name), '')) AS message, CASE WHEN type_mark IS NOT NULL THEN concat('Type Mark: ', type_mark) END AS notes
FROM schedule s LEFT JOIN f ON f.tenant_id = s.tenant_id AND f.job_id = s.job_id AND f.n = upper(trim(s.room_number))""",
    ),
    "e10_overrides": (
        _run(_overridden),
        f"""WITH RECURSIVE {ALL},
learned AS (SELECT tenant_id, lower(trim(room_name_pattern)) AS p, sign_type, CASE correction_type WHEN 'ai_missed' THEN 'add' WHEN 'ai_extra' THEN 'exclude' WHEN 'edit' THEN 'modify_qty' ELSE 'sign_type' END AS kind, min(seq) AS o, least(CAST(0.99 AS DOUBLE), CAST(0.75 AS DOUBLE) + count(*) * CAST(0.05 AS DOUBLE)) AS confidence
 FROM corrections GROUP BY tenant_id, room_name_pattern, sign_type, correction_type),
kinds AS (SELECT DISTINCT tenant_id, room_name, is_assembly FROM ready),
met AS (SELECT k.tenant_id, k.room_name, l.sign_type, l.kind, l.o, CASE l.kind WHEN 'modify_qty' THEN l.o % 3 + 1 ELSE 1 END AS qty, row_number() OVER (PARTITION BY k.tenant_id, k.room_name, l.kind IN ('add', 'sign_type') ORDER BY l.confidence DESC, l.o) AS place
 FROM kinds k JOIN learned l ON l.tenant_id = k.tenant_id AND l.p <> '' AND (lower(trim(k.room_name)) = l.p OR length(l.p) >= 3 AND contains(lower(trim(k.room_name)), l.p)
  OR len(list_filter(string_split_regex(l.p, '\\s+'), lambda w: length(w) > 2)) > 0 AND len(list_filter(string_split_regex(l.p, '\\s+'), lambda w: length(w) > 2 AND NOT contains(lower(trim(k.room_name)), w))) = 0)),
steps AS (SELECT *, row_number() OVER (PARTITION BY tenant_id, room_name ORDER BY o) AS k FROM met WHERE kind NOT IN ('add', 'sign_type') OR place <= 2),
fold AS (SELECT tenant_id, room_name, is_assembly, CAST(0 AS BIGINT) AS k, [{{'t': 'Room ID', 'q': CAST(1 AS BIGINT)}}] AS s, false AS done FROM kinds
 UNION ALL SELECT f.tenant_id, f.room_name, f.is_assembly, x.k, CASE WHEN f.done THEN f.s WHEN x.kind = 'add' THEN list_append(f.s, {{'t': x.sign_type, 'q': x.qty}}) WHEN x.kind = 'exclude' THEN list_filter(f.s, lambda e: e.t <> x.sign_type)
  WHEN x.kind = 'modify_qty' THEN list_transform(f.s, lambda e: {{'t': e.t, 'q': CASE WHEN e.t = x.sign_type THEN x.qty ELSE e.q END}}) WHEN {_VALID} THEN [{{'t': x.sign_type, 'q': x.qty}}] ELSE f.s END, f.done OR x.kind = 'sign_type' AND {_VALID}
  FROM fold f JOIN steps x ON x.tenant_id = f.tenant_id AND x.room_name = f.room_name AND x.k = f.k + 1),
last AS (SELECT tenant_id, room_name, arg_max(s, k) AS s FROM fold GROUP BY 1, 2),
lines AS (SELECT r.tenant_id, r.job_id, unnest(l.s) AS e FROM rooms r JOIN last l ON l.tenant_id = r.tenant_id AND l.room_name = r.room_name)
SELECT tenant_id, job_id, e.t AS sign_type, CAST(sum(e.q) AS BIGINT) AS qty FROM lines GROUP BY 1, 2, 3""",
    ),
    "g2_upsert_patterns": (
        _run(lambda v: learning.upsert_patterns(*_patterns(v))),
        f"""WITH {views.SQL}, m AS ({_MINED.format("true")}), o AS (SELECT * REPLACE (concat(pattern, CASE WHEN evidence % 2 = 0 THEN '' ELSE ' OLD' END) AS pattern) FROM ({_MINED.format("seq % 2 = 0")}))
SELECT tenant_id, correction_type, pattern, sign_type, coalesce(m.evidence, o.evidence) AS evidence, CASE WHEN o.status = 'approved' THEN 'approved' ELSE coalesce(m.status, o.status) END AS status, CASE WHEN o.evidence IS NULL THEN 'inserted' WHEN m.evidence IS NULL THEN 'kept' ELSE 'updated' END AS outcome FROM m FULL JOIN o USING (tenant_id, correction_type, pattern, sign_type)""",
    ),
    "g8_context": (
        _run(lambda v: learning.training_context(learning.mine_patterns(v.corrections))),
        f"WITH {views.SQL}, m AS ({_MINED.format('true')}) SELECT * FROM (SELECT tenant_id, correction_type, pattern, sign_type, evidence, CAST(row_number() OVER (PARTITION BY tenant_id ORDER BY evidence DESC, pattern, correction_type, sign_type) AS INT) AS place FROM m WHERE status = 'approved') WHERE place <= 15",
    ),
    "g16_list_corrections": (
        _run(lambda v: learning.list_corrections(v.corrections, datetime.datetime(2024, 1, 5), datetime.datetime(2024, 1, 25), 100, 20)),
        f"WITH {views.SQL} SELECT * FROM corrections WHERE created_at BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-25' ORDER BY created_at DESC, seq LIMIT 100 OFFSET 20",
    ),
}
