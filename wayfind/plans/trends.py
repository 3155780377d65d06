"""Registered queries of snapshots, overrides, reviews, cached rooms, payloads and sign sheets."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from wayfind import vocab
from wayfind.operators import jobs, learning, matching, rules, sheets
from wayfind.plans.cleaning import _JUNK
from wayfind.plans.rules import has
from wayfind.plans.sheets import _SYN, SHEETS_SQL, _sheets
from wayfind.sources import views
from wayfind.sources.views import Views


def _run(f):
    return lambda s, d: f(Views(s, d))


def _seq() -> F.Column:
    return F.col("seq")


def _job() -> F.Column:
    return F.substring("job_id", 2, 20).cast("long")


SNAPSHOTS = """snap AS (SELECT CAST(floor(o_orderkey / 50) AS BIGINT) AS job, count(CASE WHEN o_orderstatus = 'O' THEN 1 END) AS matched, count(*) AS total FROM orders GROUP BY 1),
snapshots AS (SELECT concat('t', job % 7) AS tenant_id, concat('j', job) AS job_id, job AS seq, DATE '2024-01-01' + CAST(job % 28 AS INT) AS snapshot_date, CASE WHEN job % 9 <> 0 THEN matched / total END AS accuracy,
 floor((CAST(0.5 AS DOUBLE) + matched / (2 * total)) * 1000) / 1000 AS confidence FROM snap)"""


def _snapshots(v):
    """One snapshot a job: its orders' states as what an import matched."""
    counted = v.table("orders").groupBy(F.floor(F.col("o_orderkey") / 50).alias("job")).agg(F.count_if(F.col("o_orderstatus") == "O").alias("matched"), F.count(F.lit(1)).alias("total"))
    job = F.col("job")
    return counted.select(
        F.concat(F.lit("t"), (job % 7).cast("string")).alias("tenant_id"),
        F.concat(F.lit("j"), job.cast("string")).alias("job_id"),
        job.alias("seq"),
        F.date_add(F.lit(datetime.date(2024, 1, 1)), (job % 28).cast("int")).alias("snapshot_date"),
        F.when(job % 9 != 0, F.col("matched") / F.col("total")).alias("accuracy"),
        (F.floor((F.lit(0.5) + F.col("matched") / (2 * F.col("total"))) * 1000) / 1000).alias("confidence"),
    )


def _overrides(v):
    return v.corrections.groupBy("tenant_id", "room_name_pattern", "sign_type").agg(F.bool_or("is_active").alias("is_active"))


def _coded(v):
    return v.signs.withColumn("sign_type", F.when(_seq() % 8 == 0, "Type A").when(_seq() % 8 == 1, " type b.1").otherwise(F.col("sign_type")))


def _plans(v):
    return _sheets(v).select(*rules.JOB, "sheet_id", "sheet_no", F.concat(F.lit("WING "), F.when(F.col("page") <= 2, "A").otherwise("W")).alias("title"), F.when(F.col("page") != 3, F.when(F.col("page") % 2 == 0, "LEVEL 1").otherwise("LEVEL 2")).alias("level"), "page")


def _levelled(v):
    level = F.when(_seq() % 4 == 0, "LEVEL 1").when(_seq() % 4 == 1, "LEVEL 2").when(_seq() % 4 == 2, "LEVEL 9")
    return v.rooms.withColumns({"sheet_id": F.when(_seq() % 3 != 0, F.col("sheet_id")), "level": level})


def _reused(v):
    rooms = v.rooms.withColumn("pipeline_version", F.when(_seq() % 3 == 0, "v2").when(_seq() % 3 == 1, "v1"))
    old = _sheets(v)
    new = old.filter("page % 2 = 0").withColumn("sheet_id", F.concat(F.lit("n"), "sheet_id"))
    return matching.reuse_cached_rooms(rooms, old, new, "v2", old.filter("page = 4 and file_id like '%3'")).select("seq", "new_sheet_id")


def _specialties(v):
    entry = lambda code, name, category, qty: F.struct(F.lit(code).alias("code"), F.lit(name).alias("name"), category.alias("category"), qty.alias("qty"))
    dictionary = v.jobs.select(*rules.JOB, F.array(entry("S1", "Stair", F.lit("stair"), _job()), entry("R1", "Room", F.lit("room_id"), F.lit(2).cast("long")), entry("X1", "Thing", F.when(_job() % 2 == 0, "other"), F.lit(None).cast("long"))).alias("sign_types"))
    return matching.specialty_from_dictionary(dictionary, _sheets(v).filter("title = 'SIGN SCHEDULE'"), vocab.SPECIALTY_EXAMPLE)


def _restored(v):
    after = v.rooms.withColumn("review_status", F.when(_seq() % 2 == 0, "pending").otherwise(F.col("review_status")))
    return matching.restore_review(v.signs, v.rooms, after).select("seq", "is_deleted")


def _payloads(v):
    """Each room as an answer of two items, the second of the same room in other letters; names in both manners."""
    camel, seq = _seq() % 2 == 0, _seq()
    x = F.when(seq % 5 == 0, F.lit(None)).when(seq % 7 == 0, "150").otherwise((F.col("coord_x") / 1000).cast("string"))
    item = lambda name: F.struct(F.when(camel, F.col("room_number")).alias("roomNumber"), F.when(~camel, F.col("room_number")).alias("room_number"), F.when(camel, name).alias("roomName"), F.when(~camel, name).alias("room_name"), x.alias("x"), F.when(seq % 5 != 0, F.lit("none")).alias("y"), F.when(seq % 4 == 0, 1.5).otherwise(F.col("confidence")).alias("confidence"), F.col("level").alias("level"))
    return v.rooms.select(*rules.JOB, "sheet_id", "seq", F.to_json(F.array(item(F.col("room_name")), item(F.lower("room_name")))).alias("payload"))


def _restrooms(v):
    flags = rules.classify_rooms(v.rooms.withColumn("room_name", F.when(_seq() % 7 == 0, "R1").otherwise(F.col("room_name"))))
    return flags.select("seq", sheets.merged_restroom_flag(F.col("room_name"), F.col("is_restroom"), F.col("source") == "ai_vision", _seq() % 3 == 0).alias("is_restroom"))


def _history(v):
    """Every correction is a change of the override of its pattern and sign type: a confidence, active or not."""
    c = v.corrections
    return c.select("tenant_id", F.concat_ws("|", "room_name_pattern", "sign_type").alias("rule_ref"), F.col("created_at").alias("at"), "seq", (0.6 + (_seq() % 40) / 100).alias("confidence"), "is_active")


def _moments(v):
    """A snapshot of each job, at an hour of its day."""
    hours = F.make_dt_interval(F.lit(0), (_seq() % 24).cast("int"))
    return _snapshots(v).select("tenant_id", "job_id", "seq", (F.col("snapshot_date").cast("timestamp") + hours).alias("at"))


_AS_OF = f"""snaps AS (SELECT tenant_id, job_id, seq, CAST(snapshot_date AS TIMESTAMP) + to_hours(seq % 24) AS at FROM snapshots),
state AS (SELECT s.tenant_id, s.seq AS s_seq, c.room_name_pattern, c.sign_type, arg_max({{'on': c.is_active, 'm': CAST(round((CAST(0.6 AS DOUBLE) + c.seq % 40 / CAST(100 AS DOUBLE)) * 1000000) AS BIGINT)}}, (c.created_at, c.seq)) AS last FROM snaps s JOIN corrections c ON c.tenant_id = s.tenant_id AND c.created_at <= s.at GROUP BY ALL),
summed AS (SELECT tenant_id, s_seq, count(CASE WHEN last.on THEN 1 END) AS n, sum(CASE WHEN last.on THEN last.m END) AS m FROM state GROUP BY 1, 2),
as_of AS (SELECT s.*, coalesce(n, 0) AS active_overrides, CASE WHEN n > 0 THEN round(CAST(m AS DOUBLE) / n / 1000000, 4) ELSE CAST(0 AS DOUBLE) END AS avg_confidence FROM snaps s LEFT JOIN summed u ON u.tenant_id = s.tenant_id AND s_seq = seq)"""


_NAMED = "array_to_string(list_transform(string_split_regex(upper(nm), '\\s+'), lambda t: CASE t " + _SYN + " ELSE t END), ' ')"

QUERIES = {
    "b3_restroom_flags": (
        _run(_restrooms),
        f"""WITH {views.SQL}, r AS (SELECT seq, source, CASE WHEN seq % 7 = 0 THEN 'R1' ELSE room_name END AS nm FROM rooms) SELECT seq, {has("upper(nm)", vocab.RESTROOM)} OR source = 'ai_vision' AND seq % 3 = 0 AND nm = 'R1' AS is_restroom FROM r""",
    ),
    "b29_payload_rooms": (
        _run(lambda v: sheets.rooms_from_payload(_payloads(v)).select("seq", "item", "room_number", "room_name", "level", "coord_x", "coord_y", "confidence")),
        f"""WITH {views.SQL}, r AS (SELECT *, room_name AS nm, row_number() OVER (PARTITION BY tenant_id, job_id, sheet_id, lower(room_number), lower(room_name) ORDER BY seq) AS i FROM rooms)
SELECT seq, 0 AS item, room_number, {_NAMED} AS room_name, nullif(trim(level), '') AS level, CASE WHEN seq % 5 = 0 THEN NULL WHEN seq % 7 = 0 THEN 100000 ELSE CAST(floor(CAST(coord_x AS DOUBLE) / 1000 + 0.5) * 1000 AS BIGINT) END AS coord_x, CAST(NULL AS BIGINT) AS coord_y,
 CASE WHEN seq % 4 = 0 OR confidence < 0 THEN 0.75 ELSE confidence END AS confidence FROM r WHERE i = 1 AND NOT ({_JUNK})""",
    ),
    "c3_presence_lists": (
        _run(lambda v: matching.presence_lists(v.takeoff, v.rooms, ["room_number"])),
        f"""WITH {views.SQL}, e AS (SELECT DISTINCT tenant_id, job_id, room_number FROM takeoff), a AS (SELECT DISTINCT tenant_id, job_id, room_number FROM rooms)
SELECT *, 'missed' AS kind FROM (SELECT * FROM e EXCEPT SELECT * FROM a) UNION ALL SELECT *, 'extra' FROM (SELECT * FROM a EXCEPT SELECT * FROM e)""",
    ),
    "c15_sign_sheets": (
        _run(lambda v: matching.resolve_sign_sheet(v.signs, _levelled(v), _plans(v)).select("seq", "resolved")),
        f"""WITH {views.SQL}, {SHEETS_SQL}, p AS (SELECT tenant_id, job_id, sheet_id, sheet_no, CASE WHEN page <= 2 THEN 'A' ELSE 'W' END AS wing, CASE WHEN page = 3 THEN NULL WHEN page % 2 = 0 THEN 'LEVEL 1' ELSE 'LEVEL 2' END AS level, page FROM sheets),
r AS (SELECT s.tenant_id, s.job_id, s.seq, CASE WHEN r.seq % 3 <> 0 THEN r.sheet_id END AS own, CASE r.seq % 4 WHEN 0 THEN 'LEVEL 1' WHEN 1 THEN 'LEVEL 2' WHEN 2 THEN 'LEVEL 9' END AS level,
 coalesce(nullif(regexp_extract(r.room_number, '^[0-9]{{3,4}}([A-Z])$', 1), ''), nullif(regexp_extract(r.room_number, '^([A-Z])[0-9]{{3,4}}$', 1), '')) AS letter FROM signs s LEFT JOIN rooms r ON r.seq = s.room_seq),
n AS (SELECT own, count(*) AS n FROM r WHERE own IS NOT NULL GROUP BY 1), b AS (SELECT p.*, coalesce(n, 0) AS n FROM p LEFT JOIN n ON own = sheet_id),
best AS (SELECT tenant_id, job_id, level, sheet_id FROM (SELECT *, row_number() OVER (PARTITION BY tenant_id, job_id, level ORDER BY n DESC, sheet_no, sheet_id) AS i FROM b WHERE level IS NOT NULL) WHERE i = 1),
many AS (SELECT tenant_id, job_id, level FROM p WHERE level IS NOT NULL GROUP BY 1, 2, 3 HAVING count(*) >= 2), lettered AS (SELECT tenant_id, job_id, level, page, sheet_id, CASE WHEN regexp_extract(sheet_no, '^([A-Z])-', 1) <> '' THEN regexp_extract(sheet_no, '^([A-Z])-', 1) ELSE wing END AS letter FROM p WHERE level IS NOT NULL),
wings AS (SELECT tenant_id, job_id, level, letter, arg_min(sheet_id, page) AS sheet_id FROM lettered JOIN many USING (tenant_id, job_id, level) GROUP BY 1, 2, 3, 4), f AS (SELECT tenant_id, job_id, arg_min(sheet_id, page) AS sheet_id FROM p GROUP BY 1, 2)
SELECT r.seq, coalesce(own, w.sheet_id, best.sheet_id, f.sheet_id) AS resolved FROM r LEFT JOIN wings w USING (tenant_id, job_id, level, letter) LEFT JOIN best USING (tenant_id, job_id, level) LEFT JOIN f USING (tenant_id, job_id)""",
    ),
    "c18_cached_rooms": (
        _run(_reused),
        f"""WITH {views.SQL}, {SHEETS_SQL} SELECT seq, concat('n', sheet_id) AS new_sheet_id FROM rooms JOIN (SELECT sheet_id, page, file_id FROM sheets) s USING (sheet_id)
WHERE source = 'ai_vision' AND seq % 3 <> 1 AND page % 2 = 0 AND NOT (page = 4 AND file_id LIKE '%3')""",
    ),
    "c20_restored_signs": (
        _run(_restored),
        f"WITH {views.SQL} SELECT s.seq, CASE WHEN r.review_status = 'dismissed' AND r.seq % 2 = 0 THEN false ELSE s.is_deleted END AS is_deleted FROM signs s LEFT JOIN rooms r ON r.seq = s.room_seq",
    ),
    "c21_confidence_trend": (
        _run(lambda v: learning.confidence_trend(_snapshots(v), v.jobs, datetime.date(2024, 1, 5), datetime.date(2024, 1, 20))),
        f"WITH {views.SQL}, {SNAPSHOTS} SELECT s.*, building_type FROM snapshots s LEFT JOIN jobs j ON j.job_id = s.job_id WHERE snapshot_date BETWEEN DATE '2024-01-05' AND DATE '2024-01-20' AND confidence > 0",
    ),
    "c24_cached_sheets": (
        _run(lambda v: matching.flag_cached_sheets(_sheets(v), v.rooms.filter("confidence > 0.9")).select("sheet_id", "is_cached")),
        f"WITH {views.SQL}, {SHEETS_SQL} SELECT sheet_id, EXISTS (SELECT 1 FROM rooms r WHERE r.sheet_id = sheets.sheet_id AND r.source = 'ai_vision' AND r.confidence > 0.9) AS is_cached FROM sheets",
    ),
    "c25_specialties": (
        _run(_specialties),
        f"""WITH {views.SQL}, {SHEETS_SQL}, o AS (SELECT tenant_id, job_id, CAST(substring(job_id, 2) AS BIGINT) AS job FROM jobs WHERE job_id NOT IN (SELECT job_id FROM sheets WHERE title = 'SIGN SCHEDULE'))
SELECT tenant_id, job_id, 'S1' AS sign_code, 'Stair' AS description, job AS qty, 'Category: stair' AS notes FROM o UNION ALL SELECT tenant_id, job_id, 'X1', 'Thing', NULL, 'Category: other' FROM o WHERE job % 2 = 0""",
    ),
    "d14_benchmarks": (
        _run(lambda v: jobs.reconcile_benchmarks(v.rooms, v.schedule.filter("type_mark is null or seq % 4 = 0"), v.signs, v.jobs.filter(_job() % 3 == 0).select(*rules.JOB, (100 * (_job() % 5 + 1)).alias("benchmark")))),
        f"""WITH {views.SQL}, r AS (SELECT tenant_id, job_id, count(*) AS n_rooms, count(*) AS n_signs FROM rooms GROUP BY 1, 2), s AS (SELECT tenant_id, job_id, count(*) AS n_scheduled FROM schedule WHERE type_mark IS NULL OR seq % 4 = 0 GROUP BY 1, 2),
b AS (SELECT tenant_id, job_id, 100 * (CAST(substring(job_id, 2) AS BIGINT) % 5 + 1) AS benchmark FROM jobs WHERE CAST(substring(job_id, 2) AS BIGINT) % 3 = 0), a AS (SELECT r.tenant_id, r.job_id, n_rooms, coalesce(n_scheduled, 0) AS n_scheduled, n_signs, benchmark FROM r LEFT JOIN s USING (tenant_id, job_id) LEFT JOIN b USING (tenant_id, job_id))
SELECT *, CASE WHEN n_scheduled > 0 THEN n_rooms / n_scheduled END AS coverage, CASE WHEN n_scheduled > 0 AND n_rooms / n_scheduled < 0.7 THEN 'room coverage' || CASE WHEN coalesce(n_signs < benchmark * 0.6, false) THEN ', sign count' ELSE '' END WHEN coalesce(n_signs < benchmark * 0.6, false) THEN 'sign count' ELSE '' END AS warnings FROM a""",
    ),
    "d18_type_lists": (
        _run(lambda v: jobs.sign_type_lists(v.signs.withColumn("rule_ref", F.when(_seq() % 4 != 3, F.concat(F.lit("R"), (_seq() % 4).cast("string")))))),
        f"""WITH {views.SQL}, t AS (SELECT tenant_id, job_id, sign_type, CAST(sum(qty) AS BIGINT) AS qty, coalesce(list_sort(list(DISTINCT floor_label) FILTER (WHERE floor_label IS NOT NULL)), []) AS levels, coalesce(list_sort(list(DISTINCT concat('R', seq % 4)) FILTER (WHERE seq % 4 <> 3)), []) AS rules FROM signs WHERE NOT is_deleted GROUP BY 1, 2, 3)
SELECT *, CAST(row_number() OVER (PARTITION BY tenant_id, job_id ORDER BY qty DESC, sign_type) AS INT) AS place FROM t""",
    ),
    "d18_type_rules": (
        _run(lambda v: jobs.rules_of_types(v.signs.withColumn("rule_ref", F.concat(F.lit("R"), (_seq() % 3).cast("string"))))),
        f"WITH {views.SQL} SELECT tenant_id, job_id, sign_type, CAST(sum(qty) AS BIGINT) AS qty, count(DISTINCT floor_label) AS n_levels, count(DISTINCT seq % 3) AS n_rules FROM signs GROUP BY 1, 2, 3",
    ),
    "d20_type_codes": (
        _run(lambda v: jobs.unrecognised_codes(_coded(v), v.jobs.filter(_job() % 2 == 0).select(*rules.JOB, F.lit("a").alias("type_code")))),
        f"""WITH {views.SQL}, s AS (SELECT DISTINCT tenant_id, job_id, CASE seq % 8 WHEN 0 THEN 'Type A' ELSE 'type b.1' END AS sign_type FROM signs WHERE seq % 8 < 2)
SELECT s.* FROM s LEFT JOIN jobs USING (tenant_id, job_id) WHERE NOT (sign_type = 'Type A' AND jobs.building_type IS NOT NULL AND CAST(substring(job_id, 2) AS BIGINT) % 2 = 0)""",
    ),
    "g5_as_of": (_run(lambda v: learning.snapshots_as_of(_moments(v), _history(v))), f"WITH {views.SQL}, {SNAPSHOTS}, {_AS_OF} SELECT * FROM as_of"),
    "g6_snapshot_weeks": (
        _run(lambda v: learning.snapshots_with_weeks(learning.snapshots_as_of(_moments(v), _history(v)), v.corrections, datetime.datetime(2024, 1, 3), datetime.datetime(2024, 1, 25))),
        f"""WITH {views.SQL}, {SNAPSHOTS}, {_AS_OF}, w AS (SELECT tenant_id, date_trunc('week', created_at) AS week, count(*) AS n FROM corrections WHERE created_at BETWEEN TIMESTAMP '2024-01-03' AND TIMESTAMP '2024-01-25' GROUP BY 1, 2)
SELECT a.*, coalesce(w.n, 0) AS correction_count FROM as_of a LEFT JOIN w ON w.tenant_id = a.tenant_id AND w.week = date_trunc('week', a.at) WHERE a."at" BETWEEN TIMESTAMP '2024-01-03' AND TIMESTAMP '2024-01-25' AND avg_confidence > 0""",
    ),
    "g5_g10_previous": (
        _run(lambda v: learning.with_previous(_snapshots(v))),
        f"WITH {SNAPSHOTS}, p AS (SELECT *, lag(confidence) OVER (PARTITION BY tenant_id ORDER BY snapshot_date, seq) AS previous FROM snapshots) SELECT *, round(confidence - previous, 6) AS change FROM p",
    ),
    "g7_impact": (
        _run(lambda v: learning.override_impact(_overrides(v), v.corrections, datetime.datetime(2024, 1, 10))),
        f"""WITH {views.SQL}, o AS (SELECT tenant_id, room_name_pattern, sign_type, bool_or(is_active) AS a FROM corrections GROUP BY 1, 2, 3), t AS (SELECT tenant_id, count(*) AS overrides, count(CASE WHEN a THEN 1 END) AS active_overrides FROM o GROUP BY 1)
SELECT t.*, c.n AS corrections_this_month FROM t JOIN (SELECT tenant_id, count(CASE WHEN created_at >= TIMESTAMP '2024-01-10' THEN 1 END) AS n FROM corrections GROUP BY 1) c USING (tenant_id)""",
    ),
    "g8_health": (
        _run(lambda v: learning.training_health(_snapshots(v), v.corrections.select("tenant_id", F.when(_seq() % 4 == 0, "approved").otherwise("pending").alias("status")))),
        f"""WITH {views.SQL}, {SNAPSHOTS}, a AS (SELECT tenant_id, count(accuracy) AS validated_jobs, avg(accuracy) AS mean_accuracy FROM snapshots WHERE accuracy IS NOT NULL GROUP BY 1), p AS (SELECT tenant_id, count(*) AS n FROM corrections WHERE seq % 4 = 0 GROUP BY 1)
SELECT tenant_id, coalesce(validated_jobs, 0) AS validated_jobs, coalesce(mean_accuracy, 0) AS mean_accuracy, coalesce(n, 0) AS patterns_active FROM a FULL JOIN p USING (tenant_id)""",
    ),
    "g8_examples": (
        _run(lambda v: learning.example_jobs(_snapshots(v), v.jobs)),
        f"WITH {views.SQL}, {SNAPSHOTS} SELECT * FROM (SELECT s.tenant_id, building_type, s.job_id, accuracy, CAST(row_number() OVER (PARTITION BY s.tenant_id, building_type ORDER BY accuracy DESC, seq) AS INT) AS place FROM snapshots s JOIN jobs j ON j.job_id = s.job_id WHERE accuracy IS NOT NULL) WHERE place <= 3",
    ),
    "g9_cost_since": (
        _run(lambda v: learning.cost_since_first_snapshot(v.ai_scans, _snapshots(v))),
        f"""WITH {views.SQL}, {SNAPSHOTS}, f AS (SELECT tenant_id, min(snapshot_date) AS first_date FROM snapshots GROUP BY 1),
s AS (SELECT a.tenant_id, count(DISTINCT job_id) AS jobs, any_value(first_date) AS first_date, round(CAST(sum(input_tokens) AS DOUBLE) / 1000000 * CAST({vocab.TOKEN_PRICES[0]} AS DOUBLE) + CAST(sum(output_tokens) AS DOUBLE) / 1000000 * CAST({vocab.TOKEN_PRICES[1]} AS DOUBLE), 6) AS cost FROM ai_scans a LEFT JOIN f USING (tenant_id) WHERE first_date IS NULL OR created_at >= first_date GROUP BY 1)
SELECT tenant_id, jobs, cost, round(cost / jobs, 6) AS cost_per_job, first_date FROM s""",
    ),
    "g11_recent_jobs": (
        _run(lambda v: jobs.recent_jobs(v.jobs)),
        f"WITH {views.SQL} SELECT * FROM (SELECT tenant_id, job_id, status, updated_at, CAST(row_number() OVER (PARTITION BY tenant_id ORDER BY updated_at DESC, job_id) AS INT) AS place FROM jobs) WHERE place <= 5",
    ),
    "g14_history_totals": (
        _run(lambda v: learning.history_totals(v.corrections.withColumn("removed", _seq() % 10))),
        f"WITH {views.SQL} SELECT tenant_id, count(*) AS n_runs, CAST(sum(seq % 10) AS BIGINT) AS removed, max(created_at) AS last_run FROM corrections GROUP BY 1",
    ),
}
