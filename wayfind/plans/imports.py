"""Registered queries of what users bring in: price lists, diffs of human takeoffs, drawing indexes, type-code rows."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from wayfind import vocab
from wayfind.operators import drawings, learning, pricing, rules, schedules
from wayfind.plans.drawings import _DRAWN, _drawn
from wayfind.plans.matching import _FLOORKEY, _SHOWN, _WING
from wayfind.plans.rules import quoted, sql_in
from wayfind.plans.sheets import SHEETS_SQL, _files
from wayfind.plans.takeoff import _TYPES, _UNIT
from wayfind.sources import views
from wayfind.sources.kept import kept, shared_folder
from wayfind.sources.views import Views


def _run(f):
    return lambda s, d: f(Views(s, d))


# ---- price lists: two of three tenants have one ----

MATERIALS = '[{"id": "m1", "bid_price": 0.5, "name": "Acrylic"}, {"id": "m2", "msrp": 0.75, "name": "Photopolymer"}]'
FINISHINGS = '[{"id": "f1", "unit": "sqin", "bid_price": 0.25, "name": "Paint"}, {"id": "f2", "unit": "each", "bid_price": 9.0, "name": "Studs"}, {"id": "f3", "bid_price": 0.5, "name": "Braille"}]'
DEFAULTS = """[{"seq": 1, "sign_type": "Room ID", "material_id": "m1", "finishing_ids": ["f1", "f2"], "width": 8, "height": 4, "min_price": 15},
 {"seq": 2, "sign_type": "exit", "material_id": "m2", "finishing_ids": ["f1", "f3"]}, {"seq": 3, "sign_type": "EXIT", "material_id": "m1", "finishing_ids": []},
 {"seq": 4, "sign_type": "Evacuation Map", "material_id": "m1", "finishing_ids": []}, {"seq": 5, "sign_type": "Elevator", "material_id": "m9", "finishing_ids": ["f1"], "width": 0, "height": 2, "min_price": 3}]"""


def _price_lists(v):
    """(rates, dictionary, installs) of the tenants."""
    k = F.substring("tenant_id", 2, 9).cast("int")
    tenants = v.jobs.select("tenant_id").distinct()
    own = tenants.filter(k % 3 != 0)
    each = lambda told, fields: own.select("tenant_id", F.inline(F.from_json(F.lit(told), f"array<struct<{fields}>>")))
    rates = pricing.tenant_rates(
        each(MATERIALS, "id string, bid_price double, msrp double, name string"),
        each(FINISHINGS, "id string, unit string, bid_price double, name string"),
        each(DEFAULTS, "seq long, sign_type string, material_id string, finishing_ids array<string>, width double, height double, min_price double"),
    )
    dictionary = tenants.filter(k % 2 == 0).select("tenant_id", F.lit("room id").alias("code"), F.lit("10 x 10").alias("size"), F.when(k % 4 == 0, "Brass").alias("material"))
    installs = tenants.select("tenant_id", F.when(k % 4 == 1, 20.0).alias("default_per_sign"), F.when(k % 4 == 1, F.create_map(F.lit("Exit"), F.lit(30.0))).alias("overrides"))
    return rates, dictionary, installs


def _priced(v):
    return pricing.tenant_pricing_tab(v.signs, *_price_lists(v)).drop("material", "finishing")


def _own_lines(v):
    rates, dictionary, _ = _price_lists(v)
    return pricing.tenant_lines(pricing.room_lines(v.signs, v.rooms), rates, dictionary)


def _exported(v, kind):
    """The rows of one export as lines of text, written by job and read back; every second job is written twice."""
    make = {
        "takeoff": lambda: schedules.export_rows(pricing.room_lines(v.signs, v.rooms)).select(*rules.JOB, F.struct("floor_key", "room_key", "seq").alias("position"), *schedules.EXPORT_COLUMNS),
        "summary": lambda: schedules.summary_export(v.signs),
        "pricing": lambda: schedules.pricing_export(pricing.tenant_pricing_tab(v.signs, *_price_lists(v))),
        "specialty": lambda: schedules.specialty_export(_special(v)),
    }
    rows = kept(make[kind](), "export")
    path = f"{shared_folder(v.spark)}/export-{kind}-{uuid.uuid4().hex}"
    schedules.write_jobs(rows, path)
    schedules.write_jobs(rows.filter(F.substring("job_id", 2, 20).cast("long") % 2 == 0), path)
    back = v.spark.read.parquet(path)
    cells = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in rows.columns if c not in (*rules.JOB, "position")]
    place = F.row_number().over(Window.partitionBy(*rules.JOB).orderBy("position"))
    return back.select(*rules.JOB, place.alias("place"), F.concat_ws(" | ", *cells).alias("line"))


def _special(v):
    """Specialty signs of jobs: codes of letters and numbers, a few for each."""
    return v.signs.select(*rules.JOB, F.concat(F.when(F.col("seq") % 2 == 0, "S-").otherwise("A"), (F.col("seq") % 113).cast("string"), F.when(F.col("seq") % 3 == 0, "b").otherwise("")).alias("sign_code"), F.col("sign_type").alias("description"), F.when(F.col("seq") % 5 != 0, F.col("qty")).alias("qty"), F.lit(None).cast("string").alias("notes")).distinct()


_OWN_UNIT = f"""CASE WHEN sign_type = 'Evacuation Map' THEN 45.0 WHEN k % 3 <> 0 AND sign_type = 'Room ID' THEN CASE WHEN k % 2 = 0 THEN 75.0 ELSE 24.0 END
 WHEN k % 3 <> 0 AND sign_type = 'Exit' THEN 72.0 WHEN k % 3 <> 0 AND sign_type = 'Elevator' THEN 12.0 WHEN k % 2 = 0 AND sign_type = 'Room ID' THEN 126.0 ELSE {_UNIT} END"""


def _job_prices(v):
    own = F.create_map(*(F.lit(x) for p in {"Sign at Unit": 99.0, "default": 120.0, "Restroom": 77.0}.items() for x in p))
    place = F.when(F.col("seq") % 3 == 0, "elevator").when(F.col("seq") % 3 == 1, "unit").otherwise("door")
    return v.corrections.select("seq", pricing.flat_price(F.concat(F.lit("typical "), F.lower("sign_type"), F.lit(" sign at "), place), own).alias("price"))


# ---- diffs: known names and types, known names with another type, new names, rows without a type ----


def _diffs(v):
    seq, name = F.col("seq"), F.col("room_name")
    new = (seq % 3 == 1) | (name == "STORAGE")
    return v.signs.select("tenant_id", "seq", F.when(new, F.concat(name, F.lit(" NEW "), (seq % 40).cast("string"))).otherwise(F.concat(F.lit(" "), name)).alias("room_name"), F.when(seq % 17 == 0, "").when(seq % 3 == 2, "Blade Sign").otherwise(F.col("sign_type")).alias("human_sign_type"), (seq % 5 == 0).alias("skip_overwrite"))


def _decided(v, update: bool):
    return learning.import_decisions(_diffs(v), v.corrections, update)


def _decisions(update: bool) -> str:
    known, conflict = ("CASE WHEN skip THEN 'skipped' ELSE 'refreshed' END", "'conflict_updated'") if update else ("'skipped'", "'conflict_kept'")
    return f"""diffs AS (SELECT tenant_id, seq, CASE WHEN seq % 3 = 1 OR room_name = 'STORAGE' THEN concat(room_name, ' NEW ', seq % 40) ELSE room_name END AS room_name_pattern, CASE WHEN seq % 3 = 2 THEN 'Blade Sign' ELSE sign_type END AS sign_type, seq % 5 = 0 AS skip FROM signs WHERE seq % 17 <> 0),
firsts AS (SELECT tenant_id, room_name_pattern, sign_type, min(seq) AS seq, arg_min(skip, seq) AS skip FROM diffs GROUP BY 1, 2, 3),
pairs AS (SELECT DISTINCT tenant_id, room_name_pattern, sign_type, 1 AS pair FROM corrections), patterns AS (SELECT DISTINCT tenant_id, room_name_pattern, 1 AS pattern FROM corrections),
decisions AS (SELECT tenant_id, room_name_pattern, sign_type, seq, CASE WHEN pair = 1 THEN {known} WHEN pattern = 1 THEN {conflict} ELSE 'inserted' END AS outcome FROM firsts LEFT JOIN pairs USING (tenant_id, room_name_pattern, sign_type) LEFT JOIN patterns USING (tenant_id, room_name_pattern))"""


# ---- drawing indexes and type-code rows ----


def _index_lines(d):
    key = [*rules.JOB, "file_id", F.lit(1).alias("index_page")]
    line = F.when(F.col("page") % 3 == 0, F.concat("sheet_no", F.lit(" - "), "title")).when(F.col("page") % 3 == 1, F.concat("title", F.lit(" | "), "sheet_no")).otherwise(F.concat(F.lit(" "), "sheet_no", F.lit(" ")))
    return d.select(*key, F.col("page").alias("line_no"), line.alias("line")).unionByName(d.select(*key, (F.col("page") + 10).alias("line_no"), F.concat("sheet_no", F.lit(" AGAIN")).alias("line")))


def _index(v):
    # few rows, and told once: rooms are read for them a single time
    d, job = kept(_drawn(v), "drawn"), F.substring("job_id", 2, 20).cast("long")
    # the index page itself bears every number
    found = d.filter((F.col("page") + job) % 2 == 0).select(*rules.JOB, "file_id", "sheet_no", F.explode(F.array(F.lit(1), F.col("page") + 3, F.col("page") + 4)).alias("page"))
    return drawings.sheets_from_index(_index_lines(d), found, _files(v).withColumn("page_count", F.col("page_count") + 2)).select(*rules.JOB, "sheet_no", "title", "page", "page_source")


def _page_words(d):
    """Words of a sheet's page, three after it: its number in the title block, or in the text beside another number there,
    or split at its hyphen, or after a number that no index lists. The index page bears all numbers."""
    case = (F.col("page") + F.substring("job_id", 2, 20).cast("long")) % 4
    word = lambda t, x, y: F.struct(t.alias("text"), F.lit(float(x)).alias("x0"), F.lit(float(y)).alias("top"))
    n, lit = F.col("sheet_no"), F.lit
    split = F.array(word(F.regexp_replace(n, "-.*", "-"), 100, 100), word(F.when(n.contains("-"), F.regexp_replace(n, ".*-", "")).otherwise(F.concat(lit("x"), n)), 120, 100))
    words = (
        F.when(case == 0, F.array(word(lit("SCALE"), 720, 760), word(n, 900, 800), word(lit("ROOM"), 10, 10)))
        .when(case == 1, F.array(word(F.concat(lit("(see:"), F.lower(n), lit(")")), 200, 300), word(lit("Z-999"), 900, 800)))
        .when(case == 2, F.when(n.contains("-"), split).otherwise(F.array(word(F.concat(lit("x"), n), 120, 100))))
        .otherwise(F.array(word(n, 900, 800), word(lit("QQ9"), 950, 770)))
    )
    body = d.select(*rules.JOB, "file_id", (F.col("page") + 3).alias("page"), F.posexplode(words).alias("word_no", "w"))
    head = d.select(*rules.JOB, "file_id", F.lit(1).cast("long").alias("page"), F.col("page").cast("int").alias("word_no"), word(n, 10, 10).alias("w"))
    return body.unionByName(head).select(*rules.JOB, "file_id", "page", "word_no", "w.*", F.lit(1000.0).alias("page_width"), F.lit(1000.0).alias("page_height"))


def _searched(v):
    d = kept(_drawn(v), "drawn")
    found = drawings.sheets_from_pages(_index_lines(d), _page_words(d), _files(v).withColumn("page_count", F.col("page_count") + 2))
    return found.select(*rules.JOB, "sheet_no", "title", "page", "page_source")


_EDGE = lambda c: f"nullif(regexp_replace({c}, '^[ .|-]+|[ .|-]+$', '', 'g'), '')"
_PART = lambda i: f"regexp_extract(trim(line), {quoted(vocab.INDEX_LINE)}, {i})"


def _coded(v):
    """The schedule with codes on every fourth row, of those a third with units of another floor and a third with
    leading zeros; every second job describes its code, as do coded rows without a number."""
    seq, number, job = F.col("seq"), F.col("room_number"), F.substring("job_id", 2, 20).cast("long")
    rows = v.schedule.select(*rules.JOB, "seq", "room_name", "quantity", F.when(seq % 4 == 0, "B1").otherwise(F.col("sign_type")).alias("sign_type"), F.when(number == "", "").when(seq % 12 == 0, F.concat(F.lit("W9"), F.right(number, F.lit(2)))).when(seq % 12 == 4, F.concat(F.lit("00"), number)).otherwise(number).alias("room_number"))
    told = v.jobs.filter(job % 2 == 0).select(*rules.JOB, F.lit(0).cast("long").alias("seq"), F.lit("STAFF SIGN").alias("room_name"), F.lit(0).alias("quantity"), F.lit(" b1").alias("sign_type"), F.lit("").alias("room_number"))
    return rows.unionByName(told)


_BARE = lambda c: f"regexp_replace(upper(trim({c})), '^0+', '')"
_BASE = lambda c: f"regexp_replace(upper(trim({c})), '^([A-Z])[0-9]([0-9][0-9]+)$', '\\1\\2')"

_K = "CAST(substring(tenant_id, 2) AS INT)"
_LISTED = f"{_K} % 3 <> 0"
_MATERIAL = f"""CASE WHEN sign_type = 'Room ID' AND {_K} % 4 = 0 THEN 'Brass' WHEN NOT {_LISTED} THEN NULL WHEN sign_type IN ('Room ID', 'Evacuation Map') THEN 'Acrylic' WHEN sign_type = 'Exit' THEN 'Photopolymer' WHEN sign_type = 'Elevator' THEN '—' END"""
_FINISHING = f"CASE WHEN NOT {_LISTED} THEN NULL WHEN sign_type = 'Room ID' THEN 'Paint, Studs' WHEN sign_type = 'Exit' THEN 'Paint, Braille' WHEN sign_type = 'Elevator' THEN 'Paint' WHEN sign_type = 'Evacuation Map' THEN '—' END"
_OWN_LINES = f"""ol AS (SELECT s.tenant_id, s.job_id, s.seq, coalesce(r.room_number, '') AS room_number, coalesce(r.room_name, '') AS room_name, s.sign_type, s.qty, coalesce(nullif(r.level, ''), s.floor_label) AS lv, {_K.replace('tenant_id', 's.tenant_id')} AS k FROM signs s LEFT JOIN rooms r ON r.seq = s.room_seq WHERE NOT s.is_deleted),
shown AS (SELECT *, {_SHOWN.replace("level", "lv")} AS level, {_FLOORKEY.replace("level", "lv")} AS floor_key, {_WING} AS room_key, CAST({_OWN_UNIT} AS DOUBLE) AS unit_price FROM ol)"""

QUERIES = {
    "f1_tenant_lines": (
        _run(_own_lines),
        f"""WITH {views.SQL}, {_OWN_LINES} SELECT tenant_id, job_id, seq, room_number, room_name, sign_type, qty, level, floor_key, room_key, unit_price, floor(unit_price * qty * 100 + CAST(0.5 AS DOUBLE)) / 100 AS extended, {_MATERIAL} AS material FROM shown""",
    ),
    "f3_tenant_totals": (
        _run(lambda v: pricing.floor_totals(_own_lines(v))),
        f"""WITH {views.SQL}, {_OWN_LINES} SELECT tenant_id, job_id, level, CAST(sum(qty) AS BIGINT) AS qty, round(sum(floor(unit_price * qty * 100 + CAST(0.5 AS DOUBLE)) / 100), 2) AS extended FROM shown GROUP BY GROUPING SETS ((tenant_id, job_id, level), (tenant_id, job_id))""",
    ),
    "a11_takeoff": (
        _run(lambda v: _exported(v, "takeoff")),
        f"""WITH {views.SQL}, {_OWN_LINES} SELECT tenant_id, job_id, CAST(row_number() OVER (PARTITION BY tenant_id, job_id ORDER BY floor_key, room_key, seq) AS INT) AS place, concat_ws(' | ', level, room_number, room_name, sign_type, CAST(qty AS VARCHAR)) AS line FROM shown""",
    ),
    "a11_summary": (
        _run(lambda v: _exported(v, "summary")),
        f"""WITH {views.SQL}, t AS (SELECT tenant_id, job_id, sign_type, min(seq) AS f, sum(qty) AS q FROM signs WHERE NOT is_deleted GROUP BY 1, 2, 3)
SELECT tenant_id, job_id, CAST(row_number() OVER (PARTITION BY tenant_id, job_id ORDER BY f) AS INT) AS place, concat_ws(' | ', sign_type, CASE WHEN sign_type IN {sql_in(vocab.LARGE_SIGNS)} THEN '18 × 24' ELSE '6 × 8' END, CAST(q AS VARCHAR), CASE WHEN sign_type IN {sql_in(vocab.ADA_REQUIRED)} THEN 'Yes' ELSE 'No' END) AS line FROM t""",
    ),
    "a11_pricing": (
        _run(lambda v: _exported(v, "pricing").select(*rules.JOB, "place", F.regexp_replace("line", r"\.0\b", "").alias("line"))),
        f"""WITH {views.SQL}, {_TYPES}, k AS (SELECT *, CAST(substring(tenant_id, 2) AS INT) AS k FROM types), u AS (SELECT *, CAST({_OWN_UNIT} AS DOUBLE) AS unit_price FROM k)
SELECT tenant_id, job_id, CAST(row_number() OVER (PARTITION BY tenant_id, job_id ORDER BY sign_type) AS INT) AS place, regexp_replace(concat_ws(' | ', sign_type, CAST(qty AS VARCHAR), coalesce({_MATERIAL}, ''), coalesce({_FINISHING}, ''), CAST(unit_price AS VARCHAR), CAST(round(unit_price * qty, 2) AS VARCHAR), CAST(round(qty * CAST(CASE WHEN k % 4 = 1 THEN CASE sign_type WHEN 'Exit' THEN 30 ELSE 20 END WHEN sign_type IN ('Elevator', 'Evacuation Map') THEN 25 ELSE 18 END AS DOUBLE), 2) AS VARCHAR)), '[.]0( |$)', '\\1', 'g') AS line FROM u""",
    ),
    "a11_specialty": (
        _run(lambda v: _exported(v, "specialty")),
        f"""WITH {views.SQL}, s AS (SELECT DISTINCT tenant_id, job_id, seq % 2 AS odd, seq % 113 AS n, CASE WHEN seq % 3 = 0 THEN 'b' ELSE '' END AS tail, sign_type, CASE WHEN seq % 5 <> 0 THEN qty END AS qty FROM signs)
SELECT tenant_id, job_id, CAST(row_number() OVER (PARTITION BY tenant_id, job_id ORDER BY odd DESC, n, tail, sign_type, coalesce(qty, 1)) AS INT) AS place, concat(CASE odd WHEN 0 THEN 'S-' ELSE 'A' END, n, tail, ' | ', sign_type, ' | ', coalesce(qty, 1), ' | ') AS line FROM s""",
    ),
    "f2_tenant_prices": (
        _run(_priced),
        f"""WITH {views.SQL}, {_TYPES}, k AS (SELECT *, CAST(substring(tenant_id, 2) AS INT) AS k FROM types), u AS (SELECT *, CAST({_OWN_UNIT} AS DOUBLE) AS unit_price FROM k)
SELECT tenant_id, job_id, sign_type, qty, unit_price, round(unit_price * qty, 2) AS extended, round(qty * CAST(CASE WHEN k % 4 = 1 THEN CASE sign_type WHEN 'Exit' THEN 30 ELSE 20 END WHEN sign_type IN ('Elevator', 'Evacuation Map') THEN 25 ELSE 18 END AS DOUBLE), 2) AS installation FROM u""",
    ),
    "f6_job_prices": (
        _run(_job_prices),
        f"WITH {views.SQL} SELECT seq, CAST(CASE WHEN sign_type = 'Max Occupancy' THEN 95 WHEN seq % 3 = 0 THEN 165 WHEN seq % 3 = 1 THEN 99 WHEN sign_type = 'Restroom' THEN 77 ELSE 120 END AS DOUBLE) AS price FROM corrections",
    ),
    "g3_import_decisions": (_run(lambda v: _decided(v, True)), f"WITH {views.SQL}, {_decisions(True)} SELECT * FROM decisions"),
    "g3_import_counts": (
        _run(lambda v: learning.import_counts(_decided(v, False))),
        f"WITH {views.SQL}, {_decisions(False)} SELECT tenant_id, " + ", ".join(f"count(CASE WHEN outcome = '{o}' THEN 1 END) AS {o}" for o in ("inserted", "refreshed", "skipped", "conflict_updated", "conflict_kept")) + " FROM decisions GROUP BY 1",
    ),
    "g3_confirm_import": (
        _run(lambda v: learning.confirm_import(_decided(v, True), v.corrections)),
        f"""WITH {views.SQL}, {_decisions(True)}, w AS (SELECT * FROM decisions WHERE outcome <> 'skipped'), n AS (SELECT DISTINCT tenant_id, room_name_pattern, 1 AS off FROM w),
l AS (SELECT tenant_id, room_name_pattern, sign_type, max(c.seq) AS seq, 1 AS back FROM corrections c JOIN w USING (tenant_id, room_name_pattern, sign_type) WHERE outcome = 'refreshed' GROUP BY 1, 2, 3)
SELECT tenant_id, room_name_pattern, sign_type, seq, CASE WHEN back = 1 THEN true WHEN off = 1 THEN false ELSE is_active END AS is_active, CASE WHEN back = 1 THEN 'refreshed' WHEN off = 1 AND is_active THEN 'deactivated' ELSE 'kept' END AS outcome
FROM corrections LEFT JOIN n USING (tenant_id, room_name_pattern) LEFT JOIN l USING (tenant_id, room_name_pattern, sign_type, seq)
UNION ALL SELECT tenant_id, room_name_pattern, sign_type, seq, true, 'inserted' FROM w WHERE outcome <> 'refreshed'""",
    ),
    "a12_index_pages": (
        _run(_searched),
        f"""WITH {views.SQL}, {SHEETS_SQL}, {_DRAWN}, l AS (SELECT tenant_id, job_id, file_id, page AS line_no, CASE page % 3 WHEN 0 THEN concat(sheet_no, ' - ', title) WHEN 1 THEN concat(title, ' | ', sheet_no) ELSE sheet_no END AS line FROM drawn UNION ALL SELECT tenant_id, job_id, file_id, page + 10, concat(sheet_no, ' AGAIN') FROM drawn),
p AS (SELECT *, {_PART(2)} AS sheet_no, upper(coalesce({_EDGE(_PART(3))}, {_EDGE(_PART(1))}, {_PART(2)})) AS title FROM l),
f AS (SELECT tenant_id, job_id, file_id, sheet_no, min(line_no) AS line_no, arg_min(title, line_no) AS title FROM p WHERE sheet_no <> '' GROUP BY 1, 2, 3, 4),
n AS (SELECT *, row_number() OVER (PARTITION BY tenant_id, job_id, file_id ORDER BY line_no) AS place FROM f),
s AS (SELECT tenant_id, job_id, sheet_no, min(page) + 3 AS found FROM drawn WHERE (page + CAST(substring(job_id, 2) AS BIGINT)) % 4 <> 2 OR contains(sheet_no, '-') GROUP BY 1, 2, 3)
SELECT tenant_id, job_id, sheet_no, title, CAST(coalesce(found, least(1 + place, page_count + 2)) AS INT) AS page, CASE WHEN found IS NULL THEN 'estimated' ELSE 'scanned' END AS page_source FROM n LEFT JOIN s USING (tenant_id, job_id, sheet_no) JOIN files USING (tenant_id, job_id, file_id)""",
    ),
    "a12_drawing_index": (
        _run(_index),
        f"""WITH {views.SQL}, {SHEETS_SQL}, {_DRAWN}, l AS (SELECT tenant_id, job_id, file_id, page AS line_no, CASE page % 3 WHEN 0 THEN concat(sheet_no, ' - ', title) WHEN 1 THEN concat(title, ' | ', sheet_no) ELSE sheet_no END AS line FROM drawn UNION ALL SELECT tenant_id, job_id, file_id, page + 10, concat(sheet_no, ' AGAIN') FROM drawn),
p AS (SELECT *, {_PART(2)} AS sheet_no, upper(coalesce({_EDGE(_PART(3))}, {_EDGE(_PART(1))}, {_PART(2)})) AS title FROM l),
f AS (SELECT tenant_id, job_id, file_id, sheet_no, min(line_no) AS line_no, arg_min(title, line_no) AS title FROM p WHERE sheet_no <> '' GROUP BY 1, 2, 3, 4),
n AS (SELECT *, row_number() OVER (PARTITION BY tenant_id, job_id, file_id ORDER BY line_no) AS place FROM f),
s AS (SELECT tenant_id, job_id, sheet_no, min(page) + 3 AS found FROM drawn WHERE (page + CAST(substring(job_id, 2) AS BIGINT)) % 2 = 0 GROUP BY 1, 2, 3)
SELECT tenant_id, job_id, sheet_no, title, CAST(coalesce(found, least(1 + place, page_count + 2)) AS INT) AS page, CASE WHEN found IS NULL THEN 'estimated' ELSE 'scanned' END AS page_source FROM n LEFT JOIN s USING (tenant_id, job_id, sheet_no) JOIN files USING (tenant_id, job_id, file_id)""",
    ),
    "c10_type_code_rows": (
        _run(lambda v: schedules.match_type_code_rows(_coded(v), v.rooms, v.jobs).select("schedule_seq", "room_seq", "sign_type", "qty", "rule_ref")),
        f"""WITH {views.SQL}, t AS (SELECT tenant_id, job_id, arg_max(room_name, seq) AS named FROM schedule WHERE seq % 4 = 0 AND room_number = '' GROUP BY 1, 2),
c AS (SELECT tenant_id, job_id, seq, quantity, CASE WHEN room_number = '' THEN '' WHEN seq % 12 = 0 THEN concat('W9', right(room_number, 2)) WHEN seq % 12 = 4 THEN concat('00', room_number) ELSE room_number END AS nr, coalesce(named, CASE WHEN CAST(substring(job_id, 2) AS BIGINT) % 2 = 0 THEN 'STAFF SIGN' ELSE 'B1' END) AS told FROM schedule LEFT JOIN t USING (tenant_id, job_id) WHERE seq % 4 = 0),
e AS (SELECT *, {_BARE("nr")} AS bare, {_BASE("nr")} AS base FROM c WHERE nr <> ''), l AS (SELECT tenant_id, job_id, {_BARE("room_number")} AS bare, max(seq) AS room_seq FROM rooms WHERE room_number <> '' GROUP BY 1, 2, 3),
m AS (SELECT * FROM e LEFT JOIN l USING (tenant_id, job_id, bare)),
u AS (SELECT tenant_id, job_id, seq AS unit_seq, {_BASE("room_number")} AS base FROM rooms JOIN jobs USING (tenant_id, job_id) WHERE building_type = 'residential' AND room_number <> '' AND {_BASE("room_number")} <> upper(trim(room_number)))
SELECT seq AS schedule_seq, room_seq, told AS sign_type, quantity AS qty, 'schedule_room_match:B1' AS rule_ref FROM m WHERE room_seq IS NOT NULL
UNION ALL SELECT seq, unit_seq, told, quantity, 'schedule_room_match:B1' FROM m JOIN u USING (tenant_id, job_id, base) WHERE room_seq IS NULL""",
    ),
}
