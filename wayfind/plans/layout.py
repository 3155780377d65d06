"""Registered queries of page layout. In SQL, segments and pairing are recursive: one word, one pair a step for all pages at once."""

from __future__ import annotations

from pyspark.sql import functions as F

from wayfind import vocab
from wayfind.operators import layout
from wayfind.plans.cleaning import _JUNK
from wayfind.plans.rules import has, quoted, sql_in
from wayfind.plans.sheets import _SYN
from wayfind.sources import views
from wayfind.sources.views import Views


def _words(v):
    """Every room as its number and, just below, its name."""
    r = v.rooms.withColumns({"x": F.col("coord_x") / 10, "y": F.col("coord_y") / 10})
    word = lambda t, dy, w: F.struct(t.alias("text"), F.col("x").alias("x0"), (F.col("y") + dy).alias("y0"), (F.col("x") + w).alias("x1"), (F.col("y") + dy + 8).alias("y1"))
    each = F.explode(F.array(word(F.col("room_number"), 0, 30), word(F.col("room_name"), 12, 60)))
    return r.select("tenant_id", "job_id", "sheet_id", each.alias("w")).select("tenant_id", "job_id", "sheet_id", "w.*", F.lit(10_000.0).alias("page_width"), F.lit(10_000.0).alias("page_height"))


_TEXTS = ["MB", "19A", "8'-4", "2.5", "N", "MAIN ST", "2024", "DRAWING", "C4", "12"]


def _dense_words(v):
    """Rooms on pages of 1,000 by 800 points: number, the words of the name below it, and for some a code or note beside."""
    r = v.rooms.withColumns({"x": F.col("coord_x").cast("double") / 100, "y": F.col("coord_y").cast("double") / 125})
    extra = F.when(F.col("seq") % 3 == 0, F.get(F.array(*map(F.lit, _TEXTS)), (F.col("seq") % 10).cast("int")))
    every = r.select(*layout.PAGE, "x", "y", F.concat(F.array("room_number"), F.split("room_name", " "), F.array(extra)).alias("texts"))
    # the first text is the number, the last the code or note; the inner posexplode would make the texts twice more, to see whether there are some
    each = every.select(*layout.PAGE, "x", "y", F.size("texts").alias("n"), "texts").select(*layout.PAGE, "x", "y", "n", F.posexplode_outer("texts").alias("i", "text")).filter("i is not null")
    i, last = F.col("i"), F.col("i") == F.col("n") - 1
    x0 = F.col("x") + F.when(i == 0, 0).when(last, 30).otherwise(25 * (i - 1))
    y0 = F.col("y") + F.when((i == 0) | last, 0).otherwise(12)
    return each.select(*layout.PAGE, "text", x0.alias("x0"), y0.alias("y0"), (x0 + 20).alias("x1"), (y0 + 8).alias("y1"), F.lit(1000.0).alias("page_width"), F.lit(800.0).alias("page_height"))


def _tags(spark, sf_dir):
    words = _dense_words(Views(spark, sf_dir))
    tags = words.filter(F.col("text").rlike(vocab.ROOM_NUMBER)).select(*layout.PAGE, F.col("text").alias("tag"), ((F.col("x0") + F.col("x1")) / 2).alias("x"), ((F.col("y0") + F.col("y1")) / 2).alias("y"), "page_width", "page_height")
    return layout.tag_rooms(tags, words)


_P = "tenant_id, job_id, sheet_id"
_WORDS = f"""placed AS (SELECT *, CAST(coord_x AS DOUBLE) / 100 AS x, CAST(coord_y AS DOUBLE) / 125 AS y FROM rooms),
parts AS (SELECT {_P}, x, y, unnest(string_split(room_name, ' ')) AS text, unnest(range(len(string_split(room_name, ' ')))) AS i FROM placed),
raw AS (SELECT {_P}, room_number AS text, x AS x0, y AS y0 FROM placed UNION ALL SELECT {_P}, text, x + 25 * i, y + 12 FROM parts
 UNION ALL SELECT {_P}, CASE seq % 10 {" ".join(f"WHEN {i} THEN {quoted(t)}" for i, t in enumerate(_TEXTS))} END, x + 30, y FROM placed WHERE seq % 3 = 0),
words AS (SELECT DISTINCT {_P}, text, x0, y0, x0 + 20 AS x1, y0 + 8 AS y1 FROM raw WHERE text <> '')"""
_MAY = lambda t: f"""NOT ({has(f"upper({t})", r"^[A-Z]$|^[0-9]+[.][0-9]+$|^[0-9]{1,2}$")} OR {has(t, "^[0-9]+['" + chr(34) + "/-]")} OR upper({t}) IN {sql_in(vocab.IGNORED_WORDS)} OR length({t}) > 30)"""
_SAME = lambda a, b: f"{a}.tenant_id = {b}.tenant_id AND {a}.job_id = {b}.job_id AND {a}.sheet_id = {b}.sheet_id"
_LIST = "array_to_string(list_transform(list_sort(list({{'x': {x}, 'y': {y}, 'word': {w}}}))[1:5], lambda e: e.word), ' ')"

_NUM = lambda t: f"(NOT {has(t, vocab.YEAR)} AND ({has(t, vocab.ROOM_NUMBER)} OR {has(t, '^[0-9]{2,4}$|^[A-Z]-?[0-9]{2,4}[A-Z]?$|^[A-Z][0-9][A-Z]?$')}))"
#: raws (…, room_number, rawname, u) with final names, without those that are none.
_NAMED = f"""own AS (SELECT *, CASE WHEN rawname <> '' THEN array_to_string(list_transform(string_split_regex(rawname, '\\s+'), lambda t: CASE t {_SYN} ELSE t END), ' ') WHEN u THEN concat('UNIT ', room_number) ELSE concat('ROOM ', room_number) END AS nm FROM raws),
final AS (SELECT *, CASE WHEN {has("rawname", vocab.ADDRESS)} THEN NULL WHEN {has("rawname", vocab.FINISH_CODES)} AND length(rawname) < 25 OR u AND len(string_split_regex(rawname, '\\s+')) > 4 THEN CASE WHEN u THEN concat('UNIT ', room_number) END WHEN NOT ({_JUNK}) THEN nm END AS room_name FROM own)"""
_AS_UNIT = has("room_number", vocab.NUMBER_OF_UNIT)


def _proximity(width: int, height: int) -> str:
    """Rooms of the pages in words, each number with the words near it."""
    return f"""numbers AS (SELECT * FROM words WHERE {has("text", vocab.ROOM_NUMBER)} AND NOT {has("text", vocab.YEAR)} AND x0 <= {width} * CAST(0.78 AS DOUBLE) AND y0 <= {height} * CAST(0.88 AS DOUBLE)),
names AS (SELECT *, {has("upper(text)", vocab.RESTROOM_LABEL)} AS restroom FROM words WHERE NOT {has("text", vocab.ROOM_NUMBER)} AND NOT {has("text", vocab.YEAR)} AND {_MAY("text")} AND upper(text) NOT IN {sql_in(vocab.IGNORED_UNITS)}),
found AS (SELECT n.tenant_id, n.job_id, n.sheet_id, n.text AS room_number, n.x0, n.y0, n.x1, n.y1, count(w.text) AS k, {_LIST.format(x="w.x0", y="w.y0", w="upper(w.text)")} AS told,
  min(least(n.x0, w.x0)) AS l, max(greatest(n.x1, w.x1)) AS r, min(least(n.y0, w.y0)) AS t, max(greatest(n.y1, w.y1)) AS b
  FROM numbers n LEFT JOIN names w ON {_SAME("n", "w")} AND (abs(n.x0 - w.x0) < 80 AND abs(n.y0 - w.y0) < CASE WHEN w.restroom THEN 80 ELSE 40 END OR abs(n.x0 - w.x0) < 200 AND abs(n.y0 - w.y0) < 15) GROUP BY ALL),
raws AS (SELECT *, CASE WHEN k = 0 THEN '' ELSE told END AS rawname, {_AS_UNIT} AS u FROM found),
{_NAMED}
SELECT {_P}, room_number, room_name, CAST(greatest(1000, least(99000, floor((l + r) / 2 / {width} * 100000 + 0.5))) AS BIGINT) AS coord_x,
 CAST(greatest(1000, least(99000, floor(((t + b) / 2 + CASE WHEN b > t THEN (b - t) * CAST(0.35 AS DOUBLE) ELSE {height} * CAST(0.025 AS DOUBLE) END) / {height} * 100000 + 0.5))) AS BIGINT) AS coord_y FROM final WHERE room_name IS NOT NULL"""


def _paired(width: int, height: int) -> str:
    """Rooms of the pages in raw: words in reading order join the run before them or start one; then pairs of number and name,
    nearest first, are taken while both are free. Pages without such a room get theirs by proximity."""
    gap, joins = "w.x0 - s.x1", f"{has('s.text', '^[A-Z]{1,2}$')} AND {has('w.text', '^[0-9]{3,4}[A-Z]?$')} AND w.x0 - s.x1 <= 10"
    goes_on = f"abs(s.y0 - w.y0) <= 4 AND {gap} >= 0 AND {gap} <= 40 AND ({_NUM('s.text')} = {_NUM('w.text')} OR {joins})"
    return f"""drawn AS (SELECT *, row_number() OVER (PARTITION BY {_P} ORDER BY round_even(y0 / 4, 0), x0, text, y0, x1, y1) AS k FROM raw WHERE text <> '' AND x0 <= {width} * CAST(0.78 AS DOUBLE) AND y0 <= {height} * CAST(0.88 AS DOUBLE)),
runs AS (SELECT {_P}, k, k AS run, text, x0, y0, x1, y1 FROM drawn WHERE k = 1
 UNION ALL SELECT {", ".join(f"CASE WHEN goes_on THEN {a} ELSE {b} END AS {n}" if a != b else a for n, a, b in (("tenant_id", "tenant_id", "tenant_id"), ("job_id", "job_id", "job_id"), ("sheet_id", "sheet_id", "sheet_id"), ("k", "k", "k"), ("run", "run", "k"), ("text", "CASE WHEN joins THEN concat(before, text) ELSE concat(before, ' ', text) END", "text"), ("x0", "bx0", "x0"), ("y0", "by0", "y0"), ("x1", "x1", "x1"), ("y1", "greatest(by1, y1)", "y1")))}
 FROM (SELECT w.*, s.run, s.text AS before, s.x0 AS bx0, s.y0 AS by0, s.y1 AS by1, {goes_on} AS goes_on, {joins} AS joins FROM runs s JOIN drawn w ON {_SAME("s", "w")} AND w.k = s.k + 1)),
segs AS (SELECT {_P}, run, arg_max(text, k) AS text, (min(x0) + arg_max(x1, k)) / 2 AS x, (arg_max(y0, k) + arg_max(y1, k)) / 2 AS y FROM runs GROUP BY ALL),
edges AS (SELECT n.*, m.run AS other, upper(m.text) AS name, row_number() OVER (PARTITION BY n.tenant_id, n.job_id, n.sheet_id ORDER BY abs(n.x - m.x) + 2 * abs(n.y - m.y), n.run, m.run) AS e
 FROM segs n JOIN segs m ON {_SAME("n", "m")} AND {_NUM("n.text")} AND NOT {_NUM("m.text")} AND {has("upper(m.text)", "[A-Z]{2}")} AND abs(n.x - m.x) <= 120 AND abs(n.y - m.y) <= 60),
taken AS (SELECT {_P}, CAST(0 AS BIGINT) AS e, [CAST(0 AS BIGINT)] AS served, [CAST(0 AS BIGINT)] AS used, false AS is_pair FROM edges WHERE e = 1
 UNION ALL SELECT {_P}, e, CASE WHEN free THEN list_append(served, run) ELSE served END, CASE WHEN free THEN list_append(used, other) ELSE used END, free
 FROM (SELECT g.*, t.served, t.used, NOT list_contains(t.served, g.run) AND NOT list_contains(t.used, g.other) AS free FROM taken t JOIN edges g ON {_SAME("t", "g")} AND g.e = t.e + 1)),
raws AS (SELECT DISTINCT {_P}, text AS room_number, name AS rawname, CAST(round_even(x / {width} * 100000, 0) AS BIGINT) AS coord_x, CAST(round_even(y / {height} * 100000, 0) AS BIGINT) AS coord_y, {has("text", vocab.NUMBER_OF_UNIT)} AS u FROM edges JOIN taken USING ({_P}, e) WHERE is_pair),
{_NAMED}, rooms_of_pairs AS (SELECT {_P}, room_number, room_name, coord_x, coord_y FROM final WHERE room_name IS NOT NULL),
bare AS (SELECT * FROM (SELECT DISTINCT {_P}, text, x0, y0, x1, y1 FROM raw WHERE text <> '') b WHERE NOT EXISTS (SELECT 1 FROM rooms_of_pairs p WHERE {_SAME("p", "b")}))
SELECT * FROM rooms_of_pairs UNION ALL SELECT * FROM (WITH words AS (SELECT * FROM bare), {_proximity(width, height)})"""


_SPARSE = f"""placed AS (SELECT *, CAST(coord_x AS DOUBLE) / 10 AS x, CAST(coord_y AS DOUBLE) / 10 AS y FROM rooms),
raw AS (SELECT {_P}, room_number AS text, x AS x0, y AS y0, x + 30 AS x1, y + 8 AS y1 FROM placed UNION ALL SELECT {_P}, room_name, x, y + 12, x + 60, y + 12 + 8 FROM placed)"""

QUERIES = {
    "h1_h2_rooms_from_words": (lambda s, d: layout.rooms_from_words(_words(Views(s, d))), f"WITH RECURSIVE {views.SQL}, {_SPARSE}, {_paired(10_000, 10_000)}"),
    "h1_h2_dense_pages": (
        lambda s, d: layout.rooms_from_words(_dense_words(Views(s, d))),
        f"WITH RECURSIVE {views.SQL}, {_WORDS.replace('raw AS', 'thin AS').replace('FROM raw', 'FROM thin')}, raw AS (SELECT *, x0 + 20 AS x1, y0 + 8 AS y1 FROM thin), {_paired(1000, 800)}",
    ),
    "h3_proximity_rooms": (lambda s, d: layout.proximity_rooms(_dense_words(Views(s, d))), f"WITH {views.SQL}, {_WORDS}, {_proximity(1000, 800)}"),
    "h4_tag_rooms": (
        _tags,
        f"""WITH {views.SQL}, {_WORDS}, mid AS (SELECT {_P}, text, upper(trim(text)) AS word, (x0 + x1) / 2 AS x, (y0 + y1) / 2 AS y FROM words WHERE (x0 + x1) / 2 <= 800 AND (y0 + y1) / 2 <= 720),
first_tags AS (SELECT {_P}, text AS tag, arg_min((x0 + x1) / 2, {{'y': y0, 'x': x0}}) AS x, arg_min((y0 + y1) / 2, {{'y': y0, 'x': x0}}) AS y FROM words WHERE {has("text", vocab.ROOM_NUMBER)} GROUP BY ALL),
tags AS (SELECT * FROM first_tags WHERE x <= 800 AND y <= 720),
legends AS (SELECT a.tenant_id, a.job_id, a.sheet_id, a.x, a.y FROM (SELECT DISTINCT {_P}, x, y FROM mid) a JOIN mid b ON {_SAME("a", "b")} AND abs(a.x - b.x) < 120 AND abs(a.y - b.y) < 40
 GROUP BY ALL HAVING count(*) >= 3 AND count(CASE WHEN {has("b.word", vocab.LEGEND_CODE)} THEN 1 END) / count(*) > 0.3),
clean AS (SELECT * FROM mid m WHERE {_MAY("word")} AND NOT EXISTS (SELECT 1 FROM legends l WHERE {_SAME("l", "m")} AND l.x = m.x AND l.y = m.y)),
named AS (SELECT t.tenant_id, t.job_id, t.sheet_id, t.tag, t.x, t.y, count(w.word) AS k, {_LIST.format(x="w.x", y="w.y", w="w.word")} AS told FROM tags t LEFT JOIN clean w ON {_SAME("t", "w")} AND w.word <> t.tag
 AND (abs(t.x - w.x) < 80 AND abs(t.y - w.y) < 40 OR abs(t.x - w.x) < 200 AND abs(t.y - w.y) < 15) GROUP BY ALL)
SELECT {_P}, tag AS room_number, CASE WHEN k > 0 AND NOT {has("told", vocab.TAG_ADDRESS)} THEN told WHEN {has("tag", vocab.NUMBER_OF_UNIT)} THEN concat('UNIT ', tag) ELSE concat('ROOM ', tag) END AS room_name, x, y FROM named""",
    ),
}
