"""Registered queries of cell tables, egress signs and validation."""

from __future__ import annotations

from pyspark.sql import functions as F

from wayfind import vocab
from wayfind.operators import cells, egress, rules
from wayfind.plans.rules import ALL, has, sql_map
from wayfind.plans.rules import _ready as ready
from wayfind.sources import views
from wayfind.sources.views import Views


def _sheets(v):
    """Cell tables of rooms: tall sheets for even jobs; wide ones, with floor rows between, for odd jobs."""
    r = v.rooms.withColumn("odd", F.substring("job_id", 2, 20).cast("long") % 2 == 1)
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    mark = F.when(F.col("seq") % 4 == 0, "X").when(F.col("seq") % 4 == 1, "0").when(F.col("seq") % 4 == 2, "2.6").otherwise("no")
    wide = F.when(F.col("seq") % 9 == 0, F.array(F.concat(F.lit("Floor "), (F.col("seq") % 5).cast("string")), F.lit(""), F.lit(""), F.lit(""))).otherwise(F.array(F.col("room_number"), F.col("room_name"), mark, F.when(F.col("seq") % 3 == 0, "yes").otherwise("")))
    tall = F.array(F.lit("Room ID"), F.col("room_name"), F.col("room_number"), text("level"), F.when(F.col("seq") % 2 == 0, F.concat((F.col("seq") % 6).cast("string"), F.lit(" ea"))).otherwise(""))
    body = r.select(F.col("job_id").alias("workbook"), F.col("sheet_id").alias("sheet"), F.col("seq").alias("row_idx"), F.when(F.col("odd"), wide).otherwise(tall).alias("cells"), "odd")
    head = body.select("workbook", "sheet", "odd").distinct().select("workbook", "sheet", F.lit(0).cast("long").alias("row_idx"), F.when(F.col("odd"), F.array(*map(F.lit, ("Room #", "Room Name", "Exit BB2A", "Restroom")))).otherwise(F.array(*map(F.lit, ("Sign Type", "Room Name", "Room #", "Level", "Qty")))).alias("cells"))
    return body.drop("odd").unionByName(head)


_CELLS = f"""WITH {views.SQL}, r AS (SELECT *, CAST(substring(job_id, 2) AS BIGINT) % 2 = 1 AS odd, count(*) OVER (PARTITION BY job_id, sheet_id) AS c FROM rooms),
n AS (SELECT job_id, count(DISTINCT sheet_id) AS sheets FROM rooms GROUP BY 1),
s AS (SELECT *, last_value(CASE WHEN odd AND seq % 9 = 0 THEN concat('Floor ', seq % 5) END IGNORE NULLS) OVER (PARTITION BY job_id, sheet_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS above FROM r),
w AS (SELECT job_id, sheet_id, seq, 'Exit' AS sign_type, room_number, room_name, coalesce(above, '') AS level, CASE seq % 4 WHEN 0 THEN 1 WHEN 2 THEN 3 ELSE 0 END AS qty FROM s WHERE odd AND seq % 9 <> 0
 UNION ALL SELECT job_id, sheet_id, seq, 'Restroom', room_number, room_name, coalesce(above, ''), CASE WHEN seq % 3 = 0 THEN 1 ELSE 0 END FROM s WHERE odd AND seq % 9 <> 0
 UNION ALL SELECT job_id, sheet_id, seq, 'Room ID', room_number, room_name, coalesce(level, ''), CASE WHEN seq % 2 = 0 AND seq % 6 <> 0 THEN CAST(seq % 6 AS INT) ELSE 1 END FROM s WHERE NOT odd)
SELECT job_id AS workbook, sheet_id AS sheet, seq AS row_idx, sign_type, CASE WHEN sheets > 1 AND room_number <> '' THEN concat(sheet_id, ':', room_number) ELSE room_number END AS room_number, room_name, level, qty FROM w JOIN n USING (job_id) WHERE qty > 0"""

_FLOORS = f"""keyed AS (SELECT tenant_id, job_id, regexp_extract(level, '([0-9]+)', 1) AS k, arg_min(trim(level), seq) AS label FROM ready WHERE regexp_extract(coalesce(level, ''), '([0-9]+)', 1) <> '' AND NOT {has("upper(trim(room_number))", vocab.EGRESS_NUMBER)} GROUP BY 1, 2, 3),
named AS (SELECT tenant_id, job_id, list(label ORDER BY CAST(k AS BIGINT), k) AS floors FROM keyed GROUP BY 1, 2),
job_floors AS (SELECT j.tenant_id, j.job_id, coalesce(floors, ['LEVEL 1']) AS floors FROM (SELECT DISTINCT tenant_id, job_id FROM ready) j LEFT JOIN named USING (tenant_id, job_id))"""
_N = "upper(trim(room_number))"
_X = lambda c, p: f"nullif(regexp_extract({c}, '{p}', 1), '')"
_BARE = f"coalesce(nullif(trim(regexp_replace({_N}, '[0-9]+$', '')), ''), {_N})"
_CORE = f"coalesce({_X(_N, '^S([A-F])[0-9]')}, {_X(_N, '^S([0-9]{1,2})$')}, {_X(_N, '^STAIR[-\\s]?([A-Z0-9]+)')}, {_X('upper(trim(room_name))', 'STAIR(?:WAY|WELL)?\\s+([A-Z0-9]+)')}, CASE WHEN {has('upper(trim(room_name))', '^STAIR(?:WAY|WELL)?$')} THEN coalesce(nullif({_BARE}, ''), 'STAIR-1') ELSE {_BARE} END)"
_LEAST = sql_map("type_group", {k: v[2] for k, v in vocab.PROFILES.items()}, "2")
_CORES = f"""det AS (SELECT tenant_id, job_id, type_group, coalesce(list(DISTINCT {_CORE}) FILTER (WHERE is_stair OR {has(_N, vocab.EGRESS_STAIR_NUMBER)} OR {has("upper(trim(room_name))", vocab.EGRESS_STAIR_NAME)}), CAST([] AS VARCHAR[])) AS found FROM ready GROUP BY 1, 2, 3),
job_cores AS (SELECT tenant_id, job_id, type_group, list_sort(list_concat(found, list_filter(['A', 'B'][1:{_LEAST}], lambda x: NOT list_contains(found, x))[1:greatest({_LEAST} - len(found), 0)])) AS cores, len(found) < {_LEAST} AS estimated FROM det)"""
_EVAC = f"""shown AS (SELECT tenant_id, job_id, unnest(floors) AS floor_label, unnest(range(1, len(floors) + 1)) AS i FROM job_floors JOIN (SELECT tenant_id, job_id, count(CASE WHEN NOT is_mep THEN 1 END) AS occupied FROM ready GROUP BY 1, 2) o USING (tenant_id, job_id) WHERE len(floors) > 1 OR occupied >= 10),
points AS (SELECT tenant_id, job_id, seq, level AS floor_label, row_number() OVER (PARTITION BY tenant_id, job_id, level ORDER BY seq) AS nth, {sql_map("type_group", {k: v[0] for k, v in vocab.PROFILES.items()}, "4")} AS most FROM ready WHERE is_corridor OR {has("upper(trim(room_name))", vocab.DECISION_POINT)}),
evac_places AS (SELECT s.tenant_id, s.job_id, s.floor_label, 'Evacuation Map' AS sign_type, 'R13' AS rule_ref, 1 AS qty, CASE WHEN seq IS NULL THEN 0.6 ELSE 0.85 END AS confidence, CASE WHEN seq IS NULL THEN concat('EVAC-L', i) ELSE CAST(seq AS VARCHAR) END AS place FROM shown s LEFT JOIN points p ON p.tenant_id = s.tenant_id AND p.job_id = s.job_id AND p.floor_label = s.floor_label AND nth <= most)"""
_RESCUE = sql_map("type_group", {k: v[1] for k, v in vocab.PROFILES.items()}, "false")
_EGRESS = f"""per_job AS (SELECT * FROM job_cores JOIN job_floors USING (tenant_id, job_id)),
pc AS (SELECT *, unnest(cores) AS core FROM per_job), pf AS (SELECT *, unnest(floors) AS floor_label, unnest(range(1, len(floors) + 1)) AS i FROM pc),
egress AS (SELECT tenant_id, job_id, floor_label, t.sign_type, 'R11' AS rule_ref, 1 AS qty, CASE WHEN estimated THEN 0.7 ELSE 1.0 END AS confidence, concat('STAIR-', core, '-L', i) AS place FROM pf, (VALUES ('Stair (Corridor)'), ('Stair (Landing)')) AS t(sign_type)
 UNION ALL SELECT tenant_id, job_id, floor_label, 'Exit', 'R9', 1, 0.9, concat('EXIT-STAIR-', core, '-L', i) FROM pf
 UNION ALL SELECT tenant_id, job_id, floor_label, 'Area of Rescue', 'R16', 2, 0.85, concat('AOR-STAIR-', core, '-L', i) FROM pf WHERE {_RESCUE}
 UNION ALL SELECT tenant_id, job_id, floors[1], 'Exit', 'R9', 1, 0.7, concat('EXIT-EXT-', e) FROM (SELECT *, unnest(range(1, {sql_map("type_group", vocab.EGRESS_EXITS, "2")} + 1)) AS e FROM per_job)
 UNION ALL SELECT tenant_id, job_id, level, 'Max Occupancy', 'R10', 1, 0.85, NULL FROM ready WHERE is_assembly AND NOT is_mep UNION ALL SELECT * FROM evac_places)"""

QUERIES = {
    "a1_a5_takeoff_rows": (lambda s, d: cells.takeoff_rows(_sheets(Views(s, d))), _CELLS),
    "e17_floors": (lambda s, d: egress.floors(ready(s, d)).select(*rules.JOB, F.array_join("floors", "|").alias("floors")), f"WITH {ALL}, {_FLOORS} SELECT tenant_id, job_id, array_to_string(floors, '|') AS floors FROM job_floors"),
    "e18_stair_cores": (lambda s, d: egress.stair_cores(ready(s, d)).select(*rules.JOB, F.array_join("cores", "|").alias("cores"), "estimated"), f"WITH {ALL}, {_CORES} SELECT tenant_id, job_id, array_to_string(cores, '|') AS cores, estimated FROM job_cores"),
    "e19_e21_egress_signs": (lambda s, d: egress.egress_signs(ready(s, d)), f"WITH {ALL}, {_FLOORS}, {_CORES}, {_EVAC}, {_EGRESS} SELECT tenant_id, job_id, floor_label, sign_type, rule_ref, CAST(qty AS INT) AS qty, CAST(confidence AS DOUBLE) AS confidence, place FROM egress"),
}
