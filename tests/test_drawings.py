"""Literal rows of sheets, schedule tables and sign scopes: values that do not come from the shared word lists."""

import pytest
from pyspark.sql import functions as F

from wayfind.operators import drawings, jobs, learning, matching, rules, schedules
from wayfind.sources.kept import numbered
from wayfind.sources.views import Views

SHEETS = [
    # number, title, type by number and title, category for that type
    ("A-101", "FIRST FLOOR PLAN", "floor_plan", "interior"),
    ("A-710", "ANYTHING", "signage_schedule", "room_schedule"),
    ("A-003", "OCCUPANT LOADS", "egress", "interior"),
    ("A-450", "TOILET ELEVATIONS", "interior_elevation", "skip"),
    ("E-201", "POWER", "other", "skip"),
    ("A0.1", "NOTES", "other", "sign_docs"),
    ("X-1", "SIGNAGE DETAILS", "sign_details", "sign_details"),
    ("X-1", "SIGN SCHEDULE", "signage_schedule", "sign_docs"),
    ("X-1", "ELUDEHCS NGIS", "signage_schedule", "sign_docs"),
    ("3.9.51", "WEST WING", "floor_plan", "interior"),
    ("3.9.52", "WALL SECTION", "other", "skip"),
    ("I-601", "", "signage_schedule", "sign_docs"),
    ("IN-12", "", "floor_plan", "interior"),
    ("S121", "PLAN IN116", "floor_plan", "skip"),
    ("X-1", "SITE PLAN", "other", "exterior"),
    ("X-1", "BASEMENT", "other", "interior"),
    ("X-1", "ROOM FINISH SCHEDULE", "other", "room_schedule"),
    ("X-1", None, "other", "skip"),
]


def test_sheet_types_and_categories(spark):
    df = spark.createDataFrame([(i, n, t, k) for i, (n, t, k, _) in enumerate(SHEETS)], "i int, n string, t string, k string")
    found = df.select("i", drawings.detect_sheet_type(F.col("n"), F.col("t")).alias("type"), drawings.sheet_category(F.col("n"), F.col("t"), F.col("k"))["category"].alias("category")).orderBy("i").collect()
    for r, (n, t, kind, category) in zip(found, SHEETS):
        assert (r["type"], r["category"]) == (kind, category), (n, t)


def _cells(spark, *tables):
    rows = [("t", "j", "s", k, i, row) for k, table in enumerate(tables) for i, row in enumerate(table)]
    return spark.createDataFrame(rows, "tenant_id string, job_id string, sheet_id string, table_idx int, row_idx int, cells array<string>")


def test_schedule_tables(spark):
    two = [
        ["LEVEL 1"],
        ["Sign", "Room No.", "Room Name", "Message", "Type", "SIGN NO", "ROOM", "TYPE"],
        ["1", "101", "Office", "hi", "bb2a", "2", "102", "Type A"],
        ["SIGN", "101", "x", "x", "BB3", "", "103", "BB3"],
        ["3", None, None, None, "", "4", "104", "LED"],
    ]
    late = [["a"], ["b"], ["c"], ["d"], ["e"], ["SIGN", "TYPE"], ["1", "BB3"]]
    got = schedules.schedule_from_tables(_cells(spark, two, late, [])).orderBy("row_idx", "part").collect()
    assert [(r["part"], r["sign_id"], r["room_number"], r["room_name"], r["sign_type"], r["message"]) for r in got] == [(0, "1", "101", "Office", "Room ID", "hi"), (1, "2", "102", "", "Type A", ""), (1, "4", "104", "", "LED(Programmable)", "")]


def test_count_tables(spark):
    table = [["SIGNAGE\nTYPE", "TYPE MARK", "COUNT"], ["Room ID", "A", "1,100"], ["Exit", "", "3"], ["Exit", "B", "0"], ["Stair", "C", "two"], ["", "D", "4"], ["GRAND TOTAL", "", "1103"]]
    by_room = [["ROOM #", "SIGN TYPE", "QTY"], ["101", "Room ID", "1"]]
    got = schedules.schedule_from_count_tables(_cells(spark, table, by_room)).orderBy("row_idx").collect()
    assert [(r["sign_type"], r["type_mark"], r["quantity"]) for r in got] == [("Room ID", "A", 1100), ("Exit", None, 3)]


def test_loose_tables_and_finish_schedules(spark):
    table = [["Room Number", "Room", "Sign Type", "Quantity"], ["101", "Office", "Room ID", "2 ea"], ["102", "Lab", "", "1"], ["103", "Hall", "Exit", "none"]]
    got = schedules.schedule_from_loose_tables(_cells(spark, table, [["ROOM", "X"], ["1", "2"]])).orderBy("row_idx").collect()
    # a column that only holds ROOM in its name stands for the name where none is called so
    assert [(r["room_number"], r["room_name"], r["sign_type"], r["quantity"]) for r in got] == [("101", "101", "Room ID", 2), ("103", "103", "Exit", 1)]
    rooms = schedules.rooms_from_finish_schedule(_cells(spark, [["NO.", "NAME"], ["101", "LOBBY TILE-1 P-2"], ["102A", "OFFICE"], ["A1", "X"], ["103"], ["104", "  "]])).orderBy("row_idx").collect()
    assert [(r["room_number"], r["room_name"]) for r in rooms] == [("101", "LOBBY"), ("102A", "OFFICE")]


def test_takeoff_file_round_trip(spark, tmp_path):
    lines = spark.createDataFrame([("t1", "j1", i, f"k{9 - i}", "r", "LEVEL 1", f"10{i % 3}", f"ROOM {i}", "Exit", i + 1) for i in range(9)], "tenant_id string, job_id string, seq long, floor_key string, room_key string, level string, room_number string, room_name string, sign_type string, qty int")
    schedules.write_takeoff(schedules.export_rows(lines), str(tmp_path / "out"), "csv")
    back = spark.read.option("header", True).csv(str(tmp_path / "out"))
    rooms, signs = schedules.rooms_and_signs_of_export(back.withColumn("seq", F.col("seq").cast("long")))
    assert {(r["room_number"], r["room_name"]) for r in rooms.collect()} == {("100", "ROOM 0"), ("101", "ROOM 1"), ("102", "ROOM 2")}
    assert sorted((r["seq"], r["qty"]) for r in signs.collect()) == [(i, i + 1) for i in range(9)]


def test_type_definitions_meet_rooms_by_class(spark):
    schedule = spark.createDataFrame([("t", "j", 1, "", "GIRLS TOILET", "A"), ("t", "j", 2, None, "ROOM ID", "b2"), ("t", "j", 3, "101", "GIRLS TOILET", "A"), ("t", "j", 4, "", "", "EXIT SIGN")], "tenant_id string, job_id string, seq long, room_number string, room_name string, sign_type string")
    rooms = spark.createDataFrame([("t", "j", 10, "1", "GIRLS RR"), ("t", "j", 11, "2", "BOYS TOILET"), ("t", "j", 12, "3", "OFFICE"), ("t", "j", 13, "4", None), ("u", "j", 14, "5", "GIRLS RR")], "tenant_id string, job_id string, seq long, room_number string, room_name string")
    got = schedules.expand_type_definitions(schedule, rooms).collect()
    assert sorted((r["def_seq"], r["room_seq"], r["rule_ref"]) for r in got) == [(1, 10, "type_code_match:A"), (2, 12, "type_code_match:B2"), (2, 13, "type_code_match:B2")]


@pytest.mark.parametrize(("kind", "rule", "room", "stays"), [("Exit", "R9", 1, False), ("Exit", "R9", None, True), ("Room ID", "R1", 1, False), ("Room ID", "training_correction", 1, True), ("Type B.1", "R9", 1, True), ("Elevator", "R9", 1, False), ("Evacuation Map", "R13", 1, False)])
def test_sign_scope(spark, kind, rule, room, stays):
    signs = spark.createDataFrame([("t", "j", 1, room, kind, rule)], "tenant_id string, job_id string, seq long, room_seq long, sign_type string, rule_ref string")
    rooms = rules.classify_rooms(spark.createDataFrame([("t", "j", 1, "1", "STORAGE", "LEVEL 1")], "tenant_id string, job_id string, seq long, room_number string, room_name string, level string"))
    scopes = spark.createDataFrame([("t", "j", False, True, False)], "tenant_id string, job_id string, restroom_only boolean, schedule_first boolean, dedicated_schedule boolean")
    listed = spark.createDataFrame([("t", "j", "Exit")], "tenant_id string, job_id string, sign_type string")
    assert drawings.filter_signs(signs, rooms, scopes, listed).count() == int(stays)


def test_sheet_of_a_sign(spark):
    rooms = spark.createDataFrame([("t", "j", 1, "s9", "LEVEL 1", "101"), ("t", "j", 2, None, "LEVEL 1", "102B"), ("t", "j", 3, None, "LEVEL 1", "103"), ("t", "j", 4, None, None, "")], "tenant_id string, job_id string, seq long, sheet_id string, level string, room_number string")
    sheets = spark.createDataFrame([("t", "j", "s1", "1.1", "WING A", "LEVEL 1", 1), ("t", "j", "s2", "1.2", "WING B", "LEVEL 1", 2)], "tenant_id string, job_id string, sheet_id string, sheet_no string, title string, level string, page int")
    signs = spark.createDataFrame([("t", "j", i, i) for i in (1, 2, 3, 4)] + [("t", "j", 5, None)], "tenant_id string, job_id string, seq long, room_seq long")
    got = {r["seq"]: r["resolved"] for r in matching.resolve_sign_sheet(signs, rooms, sheets).collect()}
    assert got == {1: "s9", 2: "s2", 3: "s1", 4: "s1", 5: "s1"}


def test_previous_snapshot_is_the_tenants_own(spark):
    rows = [("a", "j1", 1, 3, 0.5), ("a", "j2", 2, 1, 0.7), ("b", "j3", 3, 2, 0.9), ("a", "j4", 4, 3, None)]
    df = spark.createDataFrame(rows, "tenant_id string, job_id string, seq long, snapshot_date int, confidence double")
    got = {r["seq"]: (r["previous"], r["change"]) for r in learning.with_previous(df).collect()}
    assert got == {2: (None, None), 1: (0.7, -0.2), 4: (0.5, None), 3: (None, None)}


def test_unrecognised_codes(spark):
    signs = spark.createDataFrame([("t", "j", "Type A"), ("t", "j", "type b.1 "), ("t", "k", "Type A"), ("t", "j", "Typewriter")], "tenant_id string, job_id string, sign_type string")
    known = spark.createDataFrame([("t", "j", "a")], "tenant_id string, job_id string, type_code string")
    assert sorted(tuple(r) for r in jobs.unrecognised_codes(signs, known).collect()) == [("t", "j", "type b.1"), ("t", "k", "Type A")]


def test_running_numbers_without_reused_exchanges(spark):
    before = spark.conf.get("spark.sql.exchange.reuse")
    spark.conf.set("spark.sql.exchange.reuse", "false")
    try:
        rows = numbered(spark.range(50_000).select(F.xxhash64("id").alias("x"), "id"), ["x", "id"])
        found = rows.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("seq").alias("d"), F.min("seq").alias("a"), F.max("seq").alias("b")).first()
        assert tuple(found) == (50_000, 50_000, 1, 50_000)
    finally:
        spark.conf.set("spark.sql.exchange.reuse", before)


def test_rules_shuffle_rooms_by_job_at_most_a_few_times(spark):
    """The exchanges of the whole rule set, as planned."""
    v = Views(spark, "/root/testdata/sf0.001")
    plan = rules.apply_rules(v.rooms, v.jobs)._jdf.queryExecution().sparkPlan().toString()
    full = rules.apply_rules(v.rooms, v.jobs)._jdf.queryExecution().executedPlan().toString()
    assert "RangePartitioning" not in plan and full.count("Exchange hashpartitioning") <= 12
