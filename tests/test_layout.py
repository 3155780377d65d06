import re

from pyspark.sql import functions as F

from wayfind.operators import layout

SCHEMA = "tenant_id string, job_id string, sheet_id string, text string, x0 double, y0 double, x1 double, y1 double, page_width double, page_height double"


def page(spark, *words):
    """Words of (text, x, y), 20 by 8 points, on one page of 1,000 by 1,000."""
    return spark.createDataFrame([("t", "j", "s", t, float(x), float(y), x + 20.0, y + 8.0, 1000.0, 1000.0) for t, x, y in words], SCHEMA)


def test_segments_join_prefixes_and_lines():
    words = [("B", 0, 0, 5, 8), ("225", 8, 0, 20, 8), ("MEETING", 0, 20, 40, 28), ("ROOM", 44, 21, 70, 28), ("FAR", 200, 20, 220, 28)]
    assert [s[0] for s in layout.segments(words)] == ["B225", "MEETING ROOM", "FAR"]


def test_pairs_take_the_nearest_free_name():
    found = [("101", 0.0, 0.0), ("102", 100.0, 0.0), ("OFFICE", 5.0, 10.0), ("LOBBY", 95.0, 10.0), ("REMOTE", 900.0, 0.0)]
    assert sorted(layout.pair(found)) == [("101", "OFFICE", 0.0, 0.0), ("102", "LOBBY", 100.0, 0.0)]
    assert layout.pair([]) == []


def test_pages_do_not_depend_on_word_order(spark):
    words = [("t", "j", f"s{p}", t, float(x), float(y), x + 20.0, y + 8.0, 1000.0, 1000.0) for p in range(3) for t, x, y in (("101", 10, 10), ("OFFICE", 10, 22), ("102", 300, 10), ("LOBBY", 300, 22), (None, 5, 5), ("", 1, 1))]
    schema = "tenant_id string, job_id string, sheet_id string, text string, x0 double, y0 double, x1 double, y1 double, page_width double, page_height double"
    got = [sorted(tuple(r) for r in layout.rooms_from_words(spark.createDataFrame(w, schema).repartition(3)).collect()) for w in (words, words[::-1])]
    assert got[0] == got[1] and len(got[0]) == 6
    assert got[0][0][3:] == ("101", "OFFICE", 2000, 1400)
    assert layout.rooms_from_words(spark.createDataFrame([], schema)).count() == 0


def test_title_blocks_addresses_codes_and_junk_are_no_rooms(spark):
    words = page(spark, ("1101", 100, 100), ("OFFICE", 100, 115), ("1102", 900, 100), ("LOBBY", 900, 115), ("1103", 300, 950), ("STORAGE", 300, 960), ("1104", 300, 300), ("MAIN ST", 300, 315), ("1105", 500, 300), ("WD1 C4", 500, 315), ("105", 100, 500), ("WD1 C4", 100, 515), ("2024", 600, 600), ("CONF", 600, 615))
    assert sorted((r["room_number"], r["room_name"]) for r in layout.rooms_from_words(words).collect()) == [("105", "UNIT 105"), ("1101", "OFFICE")]


def test_pages_without_pairs_fall_back_to_proximity(spark):
    # the name lies 130 points beside its number, on the same line: too far for a pair, near enough here
    words = page(spark, ("1101", 100, 100), ("N", 110, 110), ("BREAK", 230, 104), ("CONF", 260, 104), ("A.B", 299, 112))
    assert layout.rooms_from_words(words.filter("text in ('1101', 'BREAK', 'CONF')")).first()["room_name"] == "BREAK CONFERENCE"
    got = layout.proximity_rooms(words.filter("text <> 'A.B'")).first()
    assert (got["room_number"], got["room_name"], got["coord_x"], got["coord_y"]) == ("1101", "BREAK CONFERENCE", 19000, 11020)
    # no name at all: called by the number; the place sinks by 35 % of the number's height
    assert [tuple(r)[3:] for r in layout.proximity_rooms(page(spark, ("101", 0, 0))).collect()] == [("101", "UNIT 101", 1000, 1000)]
    assert [r["room_name"] for r in layout.proximity_rooms(page(spark, ("1204", 50, 50), ("TOILET", 50, 120))).collect()] == ["TOILET"]
    assert [r["room_name"] for r in layout.proximity_rooms(page(spark, ("1204", 50, 50), ("OFFICE", 50, 120))).collect()] == ["ROOM 1204"]
    assert layout.proximity_rooms(page(spark).union(page(spark, ("", 1, 1), ("2024", 5, 5)))).count() == 0


def test_tags_take_words_outside_legends(spark):
    tags = spark.createDataFrame([("t", "j", "s", t, x, y, 1000.0, 1000.0) for t, x, y in (("1101", 110.0, 104.0), ("1101", 500.0, 500.0), ("102", 400.0, 400.0), ("103", 900.0, 100.0), ("1204", 600.0, 104.0))], "tenant_id string, job_id string, sheet_id string, tag string, x double, y double, page_width double, page_height double")
    words = page(spark, *((w, 100 + 20 * i, 112) for i, w in enumerate(["ONE", "TWO", "THREE", "FOUR", "OF", "FIVE", "SIX"])), ("MB", 400, 400), ("19A", 420, 400), ("LOBBY", 410, 410), ("MAIN", 600, 112), ("AVE", 620, 112))
    got = {r["room_number"]: r["room_name"] for r in layout.tag_rooms(tags, words).collect()}
    assert got == {"1101": "ONE TWO THREE FOUR FIVE", "102": "UNIT 102", "1204": "ROOM 1204"}
    assert layout.tag_rooms(tags, words.limit(0)).filter(F.col("room_name") == "ROOM 1101").count() == 1


def test_words_are_dealt_out_by_page_once(spark):
    """No word is copied to the cells around it, and pairs are not shuffled again."""
    words = page(spark, ("101", 100, 100), ("OFFICE", 100, 112))
    tags = spark.createDataFrame([("t", "j", "s", "101", 110.0, 104.0, 1000.0, 1000.0)], "tenant_id string, job_id string, sheet_id string, tag string, x double, y double, page_width double, page_height double")
    for found in (layout.proximity_rooms(words), layout.tag_rooms(tags, words)):
        plan = found._jdf.queryExecution().executedPlan().toString()
        dealt = {re.sub(r"#\d+", "", x) for x in re.findall(r"hashpartitioning\(([^)]*), \d+\)", plan)}
        assert {x.replace("_tenant", "tenant").replace("_job", "job").replace("_sheet", "sheet") for x in dealt} == {"tenant_id, job_id, sheet_id"} and "Generate" not in plan


def test_names_are_told_once_each(spark, monkeypatch):
    texts, tell = [], layout.looked_up

    def counted(df, key, columns):
        texts.append(df.select(key).distinct().count())
        return tell(df, key, columns)

    monkeypatch.setattr(layout, "looked_up", counted)
    rows = [("t", "j", "s", str(n), name, n, n) for n in range(100, 120) for name in ("OFFICE", "CORR")] + [("t", "j", "s", "7", "", 1, 1), ("t", "j", "s", "8", None, 1, 1)]
    found = layout._named(spark.createDataFrame(rows, layout.OUT)).collect()
    assert sum(r["room_name"] == "OFFICE" for r in found) == 20
    assert texts[0] == 3 and texts[1] <= 4
