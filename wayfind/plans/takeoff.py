"""Registered queries of job aggregates, prices and the learning loop."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from wayfind import vocab
from wayfind.operators import jobs, learning, matching, pricing
from wayfind.plans.matching import _BY_NUMBER, _FLOORKEY, _KEY, _SHOWN, _WING
from wayfind.plans.rules import has, quoted, sql_in
from wayfind.sources import views
from wayfind.sources.views import Views


def _run(f):
    return lambda s, d: f(Views(s, d))


_LIVE = "NOT is_deleted AND source <> 'exterior' AND NOT (room_seq IS NOT NULL AND review_status = 'dismissed')"
_SLUG = "regexp_replace(regexp_replace(lower(sign_type), '[^a-z0-9]+', '_', 'g'), '^_|_$', '')"
_SIZE = f"CASE WHEN sign_type IN {sql_in(vocab.LARGE_SIGNS)} THEN '18 × 24' ELSE '6 × 8' END"


def _list(i: int) -> str:
    return f"CAST(CASE {_SLUG} " + " ".join(f"WHEN {quoted(k)} THEN {v[i]}" for k, v in vocab.LIST_PRICES.items()) + f" ELSE {vocab.OTHER_PRICE[i]} END AS DOUBLE)"


_SIDES = f"(CASE WHEN sign_type IN {sql_in(vocab.LARGE_SIGNS)} THEN 18.0 * 24.0 ELSE 6.0 * 8.0 END)"
_UNIT = f"(floor(CASE WHEN {_SLUG} = 'evacuation_map' THEN CAST(45 AS DOUBLE) ELSE greatest({_list(4)}, ({_list(0)} + {_list(1)}) * CAST({_SIDES} AS DOUBLE)) END * 100 + CAST(0.5 AS DOUBLE)) / 100)"
_LINES = f"lines AS (SELECT tenant_id, job_id, seq, sign_type, qty, {_SHOWN.replace('level', 'floor_label')} AS level, {_FLOORKEY.replace('level', 'floor_label')} AS floor_key, {_WING} AS room_key, {_UNIT} AS unit_price, floor({_UNIT} * qty * 100 + CAST(0.5 AS DOUBLE)) / 100 AS extended FROM signs WHERE NOT is_deleted)"
_TYPES = f"types AS (SELECT tenant_id, job_id, sign_type, CAST(sum(qty) AS BIGINT) AS qty, any_value({_SIZE}) AS size, sign_type IN {sql_in(vocab.ADA_REQUIRED)} AS ada FROM signs WHERE NOT is_deleted GROUP BY 1, 2, 3)"
_TAB = f"tab AS (SELECT *, {_UNIT} AS unit_price, round({_UNIT} * qty, 2) AS extended, round(qty * CAST(CASE WHEN sign_type IN ('Elevator', 'Evacuation Map') THEN 25 ELSE 18 END AS DOUBLE), 2) AS installation FROM types)"
_COST = "(input_tokens / 1000000 * CAST(1.25 AS DOUBLE) + output_tokens / 1000000 * CAST(5.0 AS DOUBLE))"


def _tenants(v):
    c = v.table("customer")
    return c.select(F.when(F.col("c_custkey") % 7 == 0, F.concat(F.lit("guest-"), F.col("c_custkey").cast("string"))).otherwise(F.concat(F.lit("t"), F.col("c_custkey").cast("string"))).alias("tenant_id"), F.when(F.col("c_custkey") % 3 != 0, F.make_date(F.lit(2024), F.lit(1), F.lit(1)) + (F.col("c_custkey") % 300).cast("int")).alias("last_active_at"), F.lit(datetime.date(2024, 3, 1)).alias("created_at"))


def _guests(v):
    children = v.table("orders").select(F.concat(F.lit("guest-"), F.col("o_custkey").cast("string")).alias("tenant_id"), F.col("o_orderkey").alias("seq"))
    return learning.expired_guests(_tenants(v), children, datetime.date(2024, 5, 1))


def _timings(v):
    return v.table("events").select(F.col("event_type").alias("op"), F.floor(F.col("value") * 10).alias("ms"), (F.col("event_id") % 13 != 0).alias("ok"))


def _overrides(v, new):
    c = v.corrections
    old = c.filter("is_active and seq % 3 = 0").select("tenant_id", F.concat(F.lit("learned:"), F.regexp_replace(F.regexp_replace(F.lower(F.concat_ws("_", "sign_type", "room_name_pattern")), "[^a-z0-9]+", "_"), "^_|_$", "")).alias("rule_ref")).distinct()
    return learning.upsert_overrides(new, old.withColumns({"confidence": F.lit(0.96), "source_corrections": F.lit(1)}))


def _kept_overrides(v):
    """All corrections over overrides that exist for every correction, under another name where its length is odd."""
    rule = F.concat(F.lit("learned:"), F.regexp_replace(F.regexp_replace(F.lower(F.concat_ws("_", "sign_type", "room_name_pattern")), "[^a-z0-9]+", "_"), "^_|_$", ""))
    old = v.corrections.select("tenant_id", F.when(F.length(rule) % 2 == 0, rule).otherwise(F.concat(rule, F.lit("_old"))).alias("rule_ref")).distinct()
    return learning.upsert_overrides(v.corrections, old.withColumns({"confidence": F.lit(0.96), "source_corrections": F.lit(1)}))


_RULE = "concat('learned:', regexp_replace(regexp_replace(lower(concat(sign_type, '_', room_name_pattern)), '[^a-z0-9]+', '_', 'g'), '^_|_$', ''))"

QUERIES = {
    "d9_sheet_level": (
        _run(lambda v: jobs.backfill_sheet_level(v.rooms)),
        f"WITH {views.SQL}, c AS (SELECT tenant_id, job_id, sheet_id, level, count(*) AS n, min(seq) AS f FROM rooms WHERE trim(level) <> '' GROUP BY ALL) SELECT tenant_id, job_id, sheet_id, level FROM (SELECT *, row_number() OVER (PARTITION BY tenant_id, job_id, sheet_id ORDER BY n DESC, f) AS i FROM c) WHERE i = 1",
    ),
    "d10_correct_sheet_level": (
        _run(lambda v: jobs.correct_sheet_level(v.rooms)),
        f"""WITH {views.SQL}, c AS (SELECT tenant_id, job_id, sheet_id, {_BY_NUMBER} AS lv, count(*) AS n, min(seq) AS f FROM rooms GROUP BY ALL), t AS (SELECT tenant_id, job_id, sheet_id, sum(n) AS rooms FROM c GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY tenant_id, job_id, sheet_id ORDER BY n DESC, f) AS i FROM c WHERE lv <> 'LEVEL 1')
SELECT tenant_id, job_id, sheet_id, lv AS level FROM r JOIN t USING (tenant_id, job_id, sheet_id) WHERE i = 1 AND n >= 3 AND n / rooms >= 0.6""",
    ),
    "d11_allowlist": (
        _run(lambda v: jobs.apply_allowlist(v.rooms.withColumn("room_number", F.when(F.col("seq") % 5 != 0, F.concat(F.lit("W"), F.lpad((F.col("seq") % 900).cast("string"), 3, "1"))).otherwise(F.col("room_number"))), v.jobs).select("seq")),
        f"""WITH {views.SQL}, r AS (SELECT tenant_id, job_id, seq, CASE WHEN seq % 5 <> 0 THEN concat('W', lpad(CAST(seq % 900 AS VARCHAR), 3, '1')) ELSE room_number END AS nr, building_type FROM rooms JOIN jobs USING (tenant_id, job_id)),
w AS (SELECT *, {has("trim(nr)", vocab.ALLOWED_NUMBER)} AS fits, count(CASE WHEN trim(nr) <> '' THEN 1 END) OVER (PARTITION BY tenant_id, job_id) AS numbered, count(CASE WHEN trim(nr) <> '' AND {has("trim(nr)", vocab.ALLOWED_NUMBER)} THEN 1 END) OVER (PARTITION BY tenant_id, job_id) AS m FROM r)
SELECT seq FROM w WHERE NOT (building_type IN ('education', 'school') AND numbered >= 5 AND m / numbered >= 0.5 AND trim(nr) <> '' AND NOT fits)""",
    ),
    "d12_stray_units": (
        _run(lambda v: jobs.suppress_stray_units(v.rooms, v.jobs).select("seq")),
        f"""WITH {views.SQL}, w AS (SELECT seq, building_type, {has("upper(trim(room_name))", vocab.UNIT_OR_APT)} AS u, count(CASE WHEN {has("upper(trim(room_name))", vocab.UNIT_OR_APT)} THEN 1 END) OVER (PARTITION BY tenant_id, job_id) AS n, count(*) OVER (PARTITION BY tenant_id, job_id) AS a FROM rooms JOIN jobs USING (tenant_id, job_id))
SELECT seq FROM w WHERE NOT (u AND building_type NOT IN {sql_in(vocab.UNIT_SIGN_TYPES)} AND NOT (n >= 5 AND n / a >= 0.3))""",
    ),
    "d14_reconcile": (
        _run(lambda v: jobs.reconcile_jobs(v.rooms, v.signs)),
        f"""WITH {views.SQL}, h AS (SELECT DISTINCT room_seq FROM signs WHERE room_seq IS NOT NULL AND NOT is_deleted), c AS (SELECT tenant_id, job_id, count(*) AS n_rooms, count(room_seq) AS with_sign FROM rooms LEFT JOIN h ON room_seq = seq GROUP BY 1, 2)
SELECT *, with_sign / n_rooms AS coverage, CASE WHEN with_sign / n_rooms < 0.7 THEN 'low room coverage' END AS warning FROM c""",
    ),
    "d15_live_counts": (
        _run(lambda v: jobs.live_sign_counts(v.signs)),
        f"WITH {views.SQL} SELECT tenant_id, job_id, CAST(sum(qty) AS BIGINT) AS total_signs, CAST(sum(CASE WHEN confidence >= 0.75 THEN qty ELSE 0 END) AS BIGINT) AS high_confidence, CAST(sum(CASE WHEN confidence >= 0.75 THEN 0 ELSE qty END) AS BIGINT) AS needs_review FROM signs WHERE {_LIVE} GROUP BY 1, 2",
    ),
    "d16_sign_types": (_run(lambda v: jobs.sign_type_distribution(v.signs)), f"WITH {views.SQL} SELECT tenant_id, job_id, sign_type, CAST(sum(qty) AS BIGINT) AS qty FROM signs WHERE NOT is_deleted GROUP BY 1, 2, 3"),
    "d17_confidence_histogram": (
        _run(lambda v: jobs.confidence_histogram(v.rooms)),
        f"""WITH {views.SQL}, b AS (SELECT * FROM (VALUES ('< 50%', -100.0, 0.5), ('50–59%', 0.5, 0.6), ('60–79%', 0.6, 0.8), ('80–100%', 0.8, 100.0)) AS b(bucket, low, high)), j AS (SELECT DISTINCT tenant_id, job_id FROM rooms WHERE source = 'ai_vision')
SELECT j.tenant_id, j.job_id, bucket, count(seq) AS n_rooms FROM j CROSS JOIN b LEFT JOIN rooms r ON r.tenant_id = j.tenant_id AND r.job_id = j.job_id AND r.source = 'ai_vision' AND r.confidence >= CAST(low AS DOUBLE) AND r.confidence < CAST(high AS DOUBLE) GROUP BY 1, 2, 3""",
    ),
    "d18_type_summary": (_run(lambda v: jobs.sign_type_summary(v.signs)), f"WITH {views.SQL} SELECT tenant_id, job_id, sign_type, CAST(sum(qty) AS BIGINT) AS qty, count(DISTINCT floor_label) AS n_levels, count(DISTINCT source) AS n_sources FROM signs WHERE NOT is_deleted GROUP BY 1, 2, 3"),
    "d20_outliers": (_run(lambda v: jobs.sign_outliers(v.signs)), f"WITH {views.SQL} SELECT tenant_id, job_id, upper(trim(room_number)) AS number, count(*) AS n_signs FROM signs WHERE trim(room_number) <> '' GROUP BY 1, 2, 3 HAVING count(*) > 3"),
    "b26_list_jobs": (_run(lambda v: jobs.list_jobs(v.jobs, ["Commercial", "hospital"], 50, 10)), f"WITH {views.SQL} SELECT * FROM jobs WHERE building_type IN ('commercial', 'hospital') ORDER BY created_at DESC, job_id LIMIT 50 OFFSET 10"),
    "g11_dashboard": (
        _run(lambda v: jobs.dashboard(v.jobs, v.signs)),
        f"""WITH {views.SQL}, l AS (SELECT tenant_id, sum(qty) AS signs, sum(CASE WHEN confidence >= 0.75 THEN 0 ELSE qty END) AS nr FROM signs WHERE {_LIVE} GROUP BY 1),
c AS (SELECT tenant_id, count(*) AS n_jobs, count(CASE WHEN status = 'pending' THEN 1 END) AS pending, count(CASE WHEN status = 'processing' THEN 1 END) AS processing, count(CASE WHEN status = 'completed' THEN 1 END) AS completed FROM jobs GROUP BY 1)
SELECT c.*, CAST(coalesce(signs, 0) AS BIGINT) AS signs, CAST(coalesce(nr, 0) AS BIGINT) AS needs_review FROM c LEFT JOIN l USING (tenant_id)""",
    ),
    "f1_takeoff_lines": (_run(lambda v: pricing.takeoff_lines(v.signs)), f"WITH {views.SQL}, {_LINES} SELECT * FROM lines"),
    "f3_floor_totals": (_run(lambda v: pricing.floor_totals(pricing.takeoff_lines(v.signs))), f"WITH {views.SQL}, {_LINES} SELECT tenant_id, job_id, level, CAST(sum(qty) AS BIGINT) AS qty, round(sum(extended), 2) AS extended FROM lines GROUP BY GROUPING SETS ((tenant_id, job_id, level), (tenant_id, job_id))"),
    "f4_type_summary": (_run(lambda v: pricing.type_summary(v.signs)), f"WITH {views.SQL}, {_TYPES} SELECT * FROM types"),
    "f5_pricing_tab": (_run(lambda v: pricing.pricing_tab(v.signs)), f"WITH {views.SQL}, {_TYPES}, {_TAB} SELECT * FROM tab"),
    "f5_job_totals": (_run(lambda v: pricing.job_totals(v.signs)), f"WITH {views.SQL}, {_TYPES}, {_TAB} SELECT tenant_id, job_id, round(sum(extended), 2) AS material, round(sum(installation), 2) AS installation, round(sum(extended) + sum(installation), 2) AS total FROM tab GROUP BY 1, 2"),
    "f6_flat_price": (
        _run(lambda v: v.corrections.select("seq", pricing.flat_price(F.concat(F.lit("typical "), F.lower("sign_type"), F.lit(" sign at "), F.when(F.col("seq") % 3 == 0, "elevator").when(F.col("seq") % 3 == 1, "unit").otherwise("door"))).alias("price"))),
        f"WITH {views.SQL} SELECT seq, CAST(CASE WHEN sign_type = 'Max Occupancy' THEN 95 WHEN seq % 3 = 0 THEN 165 WHEN seq % 3 = 1 THEN 95 ELSE 150 END AS DOUBLE) AS price FROM corrections",
    ),
    "f7_handoff": (_run(lambda v: pricing.handoff_pricing(v.signs)), f"WITH {views.SQL}, {_TYPES} SELECT tenant_id, job_id, sign_type, size, qty, floor({_UNIT} * qty * 100 + CAST(0.5 AS DOUBLE)) / 100 AS price FROM types"),
    "f8_legend": (_run(lambda v: pricing.legend(v.signs)), f"WITH {views.SQL} SELECT tenant_id, job_id, sign_type, count(*) AS n_rows, CAST(sum(qty) AS BIGINT) AS qty, CAST(sum(CASE WHEN confidence >= 0.75 AND review_status <> 'pending' THEN qty ELSE 0 END) AS BIGINT) AS sure_qty FROM signs WHERE NOT is_deleted GROUP BY 1, 2, 3"),
    "f8_legend_levels": (
        _run(lambda v: pricing.legend_levels(v.signs.drop("review_status").join(v.rooms.select(F.col("seq").alias("room_seq"), F.col("source").alias("room_source"), "review_status"), "room_seq", "left"))),
        f"""WITH {views.SQL}, l AS (SELECT s.tenant_id, s.job_id, coalesce(s.floor_label, 'Unassigned') AS level, count(*) AS n_rows, CAST(sum(s.qty) AS BIGINT) AS qty, CAST(sum(CASE WHEN r.source = 'ai_vision' AND r.review_status = 'pending' THEN 0 ELSE s.qty END) AS BIGINT) AS sure_qty
 FROM signs s LEFT JOIN rooms r ON r.seq = s.room_seq WHERE NOT s.is_deleted GROUP BY 1, 2, 3)
SELECT *, CAST(row_number() OVER (PARTITION BY tenant_id, job_id ORDER BY CASE {" ".join(f"WHEN contains(lower(level), '{w}') THEN {i}" for i, w in enumerate(vocab.LEGEND_LEVELS))} END NULLS LAST, level) AS INT) AS position FROM l""",
    ),
    "g1_mine_patterns": (
        _run(lambda v: learning.mine_patterns(v.corrections)),
        f"""WITH {views.SQL}, r AS (SELECT *, upper(trim(room_name_pattern)) AS pattern FROM corrections WHERE is_active AND length(trim(room_name_pattern)) >= 3 AND NOT {has("upper(room_name_pattern)", vocab.SCHEDULE_ROW)})
SELECT tenant_id, correction_type, pattern, sign_type, count(*) AS evidence, list_sort(list(DISTINCT job_id))[1:5] AS example_jobs, CASE WHEN count(*) >= 3 THEN 'approved' ELSE 'pending' END AS status FROM r GROUP BY 1, 2, 3, 4 HAVING count(*) >= 2""",
    ),
    "g1_pattern_texts": (
        _run(lambda v: learning.pattern_texts(learning.mine_patterns(v.corrections)).select("tenant_id", "correction_type", "pattern", "sign_type", "description", "suggested_fix")),
        f"""WITH {views.SQL}, r AS (SELECT *, upper(trim(room_name_pattern)) AS pattern, chr(39) AS q FROM corrections WHERE is_active AND length(trim(room_name_pattern)) >= 3 AND NOT {has("upper(room_name_pattern)", vocab.SCHEDULE_ROW)})
SELECT tenant_id, correction_type, pattern, sign_type, concat(q, pattern, q, ' \u2192 ', sign_type, ' (', count(*), ' occurrences)') AS description,
 CASE correction_type WHEN 'ai_missed' THEN concat('Room pattern ', q, pattern, q, ' requires a ', q, sign_type, q, ' sign \u2014 add to extraction rules') WHEN 'ai_extra' THEN concat('Room pattern ', q, pattern, q, ' is being over-detected \u2014 exclude from ', q, sign_type, q, ' assignment')
 ELSE concat('When room name is ', q, pattern, q, ', assign ', q, sign_type, q, ' instead of pipeline default') END AS suggested_fix FROM r GROUP BY tenant_id, correction_type, pattern, sign_type, q HAVING count(*) >= 2""",
    ),
    "g4_overrides": (
        _run(_kept_overrides),
        f"""WITH {views.SQL}, n AS (SELECT tenant_id, {_RULE} AS rule_ref, count(*) AS n FROM corrections WHERE is_active GROUP BY 1, 2), e AS (SELECT DISTINCT tenant_id, {_RULE} || CASE WHEN length({_RULE}) % 2 = 0 THEN '' ELSE '_old' END AS rule_ref, 1 AS e FROM corrections)
SELECT tenant_id, rule_ref, CAST(CASE WHEN e IS NULL THEN 0.8 WHEN n IS NULL THEN 0.96 ELSE 0.99 END AS DOUBLE) AS confidence, coalesce(e, 0) + coalesce(n, 0) AS source_corrections FROM e FULL JOIN n USING (tenant_id, rule_ref)""",
    ),
    "g4_overrides_whole": (
        _run(lambda v: _overrides(v, v.corrections)),
        f"""WITH {views.SQL}, n AS (SELECT tenant_id, {_RULE} AS rule_ref, count(*) AS n FROM corrections WHERE is_active GROUP BY 1, 2), e AS (SELECT DISTINCT tenant_id, {_RULE} AS rule_ref, 1 AS e FROM corrections WHERE is_active AND seq % 3 = 0)
SELECT tenant_id, rule_ref, CAST(CASE WHEN e IS NULL THEN 0.8 WHEN n IS NULL THEN 0.96 ELSE 0.99 END AS DOUBLE) AS confidence, coalesce(e, 0) + coalesce(n, 0) AS source_corrections FROM e FULL JOIN n USING (tenant_id, rule_ref)""",
    ),
    "g5_snapshots": (
        _run(lambda v: learning.accuracy_snapshots(matching.takeoff_delta(v.takeoff, v.rooms, v.signs))),
        f"""WITH {views.SQL}, human AS (SELECT *, {_KEY} AS room_key FROM takeoff), found AS (SELECT *, {_KEY} AS room_key FROM rooms), k AS (
SELECT tenant_id, job_id, CASE WHEN EXISTS (SELECT 1 FROM found f WHERE f.tenant_id = human.tenant_id AND f.job_id = human.job_id AND f.room_key = human.room_key) THEN 'matched' ELSE 'missed' END AS kind FROM human
UNION ALL SELECT tenant_id, job_id, 'extra' FROM found WHERE confidence >= 0.8 AND NOT EXISTS (SELECT 1 FROM human h WHERE h.tenant_id = found.tenant_id AND h.job_id = found.job_id AND h.room_key = found.room_key)),
j AS (SELECT tenant_id, job_id, count(CASE WHEN kind = 'matched' THEN 1 END) AS matched, count(CASE WHEN kind = 'missed' THEN 1 END) AS missed, count(CASE WHEN kind = 'extra' THEN 1 END) AS extra FROM k GROUP BY 1, 2)
SELECT *, matched / (matched + missed + extra) AS accuracy, avg(matched / (matched + missed + extra)) OVER (PARTITION BY tenant_id) AS tenant_accuracy FROM j""",
    ),
    "g6_weeks": (
        _run(lambda v: learning.corrections_per_week(v.corrections)),
        f"WITH {views.SQL}, w AS (SELECT tenant_id, CAST(date_trunc('week', created_at) AS DATE) AS week, count(*) AS n FROM corrections GROUP BY 1, 2) SELECT *, n - lag(n) OVER (PARTITION BY tenant_id ORDER BY week) AS change FROM w",
    ),
    "g7_top_corrections": (
        _run(lambda v: learning.top_corrections(v.corrections)),
        f"WITH {views.SQL}, c AS (SELECT tenant_id, correction_type, sign_type, room_name_pattern, count(*) AS n FROM corrections GROUP BY ALL) SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY tenant_id ORDER BY n DESC, correction_type, sign_type, room_name_pattern) AS INT) AS place FROM c) WHERE place <= 10",
    ),
    "g9_model_cost": (
        _run(lambda v: learning.model_cost(v.ai_scans)),
        f"""WITH {views.SQL}, s AS (SELECT tenant_id, call_type, count(*) AS calls, count(DISTINCT job_id) AS jobs, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens FROM ai_scans GROUP BY 1, 2)
SELECT *, round({_COST}, 6) AS cost, round(round({_COST}, 6) / jobs, 6) AS cost_per_job FROM s""",
    ),
    "g12_timings": (_run(lambda v: learning.timing_summary(_timings(v))), "SELECT event_type AS op, count(*) AS n, CAST(sum(CAST(floor(value * 10) AS BIGINT)) AS BIGINT) AS total_ms, avg(CAST(floor(value * 10) AS BIGINT)) AS mean_ms, max(CAST(floor(value * 10) AS BIGINT)) AS max_ms, count(CASE WHEN event_id % 13 = 0 THEN 1 END) AS failures FROM events GROUP BY 1"),
    "g13_guests": (
        _run(_guests),
        "SELECT concat('guest-', o_custkey) AS tenant_id, o_orderkey AS seq FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_custkey % 7 = 0 AND coalesce(CASE WHEN c_custkey % 3 <> 0 THEN DATE '2024-01-01' + CAST(c_custkey % 300 AS INT) END, DATE '2024-03-01') < DATE '2024-05-01')",
    ),
    "g14_retention": (
        _run(lambda v: learning.retained(v.corrections.select("tenant_id", "seq", "created_at"), datetime.datetime(2024, 1, 10), 20).select("tenant_id", "seq", "place")),
        f"WITH {views.SQL} SELECT * FROM (SELECT tenant_id, seq, CAST(row_number() OVER (PARTITION BY tenant_id ORDER BY created_at DESC, seq DESC) AS INT) AS place FROM corrections WHERE created_at >= TIMESTAMP '2024-01-10') WHERE place <= 20",
    ),
    "g15_short_patterns": (_run(lambda v: learning.short_patterns(v.corrections, 5).select("seq")), f"WITH {views.SQL} SELECT seq FROM corrections WHERE is_active AND length(trim(room_name_pattern)) < 5"),
}
