"""Literal rows of price lists, imports of diffs, drawing indexes and type-code rows."""

from pyspark.sql import functions as F

from wayfind.operators import drawings, learning, pricing, schedules


def _rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_tenant_prices_go_before_the_list(spark):
    signs = spark.createDataFrame([("t1", "j", i, t, 2, False) for i, t in enumerate(["Room ID", "Exit", "Elevator", "Evacuation Map", "Restroom"])] + [("t2", "j", 9, "Room ID", 1, False)], "tenant_id string, job_id string, seq long, sign_type string, qty int, is_deleted boolean")
    materials = spark.createDataFrame([("t1", "m1", 0.5, None), ("t1", "m2", None, 0.75)], "tenant_id string, id string, bid_price double, msrp double")
    finishings = spark.createDataFrame([("t1", "f1", "sqin", 0.25), ("t1", "f2", "each", 9.0), ("t1", "f3", None, 0.5)], "tenant_id string, id string, unit string, bid_price double")
    defaults = spark.createDataFrame(
        [("t1", 1, "room-id", "m1", ["f1", "f2"], 8, 4, 30.0), ("t1", 2, "Exit", "m2", ["f1", "f3"], None, None, None), ("t1", 3, "EXIT", "m1", [], 1, 1, 1.0), ("t1", 4, "Elevator", None, None, 0, 2, None), ("t2", 5, "Room ID", "m1", ["f1"], 50, 50, None)],
        "tenant_id string, seq long, sign_type string, material_id string, finishing_ids array<string>, width int, height int, min_price double",
    )
    dictionary = spark.createDataFrame([("t2", "ROOM id", "10 X 10")], "tenant_id string, code string, size string")
    installs = spark.createDataFrame([("t1", None, {"Exit": 30.0})], "tenant_id string, default_per_sign double, overrides map<string,double>")
    found = pricing.tenant_pricing_tab(signs, pricing.tenant_rates(materials, finishings, defaults), dictionary, installs)
    assert _rows(found, "tenant_id", "sign_type", "unit_price", "extended", "installation") == [
        ("t1", "Elevator", 0.0, 0.0, 36.0),  # no material, no finishing, no least price
        ("t1", "Evacuation Map", 45.0, 90.0, 36.0),
        ("t1", "Exit", 72.0, 144.0, 60.0),  # 1.5 x 6 x 8; a tenant's list of installation replaces the built-in one
        ("t1", "Restroom", 60.48, 120.96, 36.0),
        ("t1", "Room ID", 30.0, 60.0, 36.0),  # 0.75 x 8 x 4 is less than the least price
        ("t2", "Room ID", 126.0, 126.0, 18.0),  # without materials the built-in rates, at the dictionary's size
    ]


def test_installation_without_a_tenant_list(spark):
    kinds = spark.createDataFrame([("Elevator",), ("Evacuation Map",), ("Exit",)], "t string")
    assert _rows(kinds, "t", pricing.install_price(F.col("t"))) == [("Elevator", 25.0), ("Evacuation Map", 25.0), ("Exit", 18.0)]


def test_job_prices(spark):
    kinds = spark.createDataFrame([("A sign at unit 5",), ("Emergency Exit, Blue",), ("Blue thing",), ("other",)], "t string")
    own = F.create_map(F.lit("Sign at Unit"), F.lit(1.0), F.lit("BLUE"), F.lit(2.0), F.lit("default"), F.lit(3.0))
    assert _rows(kinds, "t", pricing.flat_price(F.col("t"), own)) == [("A sign at unit 5", 1.0), ("Blue thing", 2.0), ("Emergency Exit, Blue", 145.0), ("other", 3.0)]


def test_import_of_diffs(spark):
    stored = spark.createDataFrame([("t", 1, "LOBBY", "Exit", True), ("t", 2, "LOBBY", "Exit", True), ("t", 3, "LOBBY", "Room ID", True), ("t", 4, "STAIR", "Exit", True), ("t", 5, "HALL", "Exit", False), ("u", 6, "NEW", "Exit", True)], "tenant_id string, seq long, room_name_pattern string, sign_type string, is_active boolean")
    diffs = spark.createDataFrame(
        [("t", 10, " LOBBY ", "Exit", False), ("t", 11, "LOBBY", "Exit", True), ("t", 12, "STAIR", "Exit", True), ("t", 13, "HALL", "Blade", None), ("t", 14, "NEW", "Exit", None), ("t", 15, "", "Exit", None), ("t", 16, "X", None, None)],
        "tenant_id string, seq long, room_name string, human_sign_type string, skip_overwrite boolean",
    )
    update = learning.import_decisions(diffs, stored, True)
    assert _rows(update, "seq", "outcome") == [(10, "refreshed"), (12, "skipped"), (13, "conflict_updated"), (14, "inserted")]
    assert _rows(learning.import_decisions(diffs, stored, False), "seq", "outcome") == [(10, "skipped"), (12, "skipped"), (13, "conflict_kept"), (14, "inserted")]
    assert _rows(learning.import_counts(update), "tenant_id", "inserted", "refreshed", "skipped", "conflict_updated", "conflict_kept") == [("t", 1, 1, 1, 1, 0)]
    assert _rows(learning.confirm_import(update, stored), "seq", "is_active", "outcome") == [(1, False, "deactivated"), (2, True, "refreshed"), (3, False, "deactivated"), (4, True, "kept"), (5, False, "kept"), (6, True, "kept"), (13, True, "inserted"), (14, True, "inserted")]


def test_sheets_of_an_index(spark):
    told = ["DRAWING INDEX", "A-101 - First floor plan", "Sign schedule | A-701", " 3.9.51 ", "A-101 again", "see A-102.1B."]
    lines = spark.createDataFrame([("t", "j", "f", 2, i, x) for i, x in enumerate(told)], "tenant_id string, job_id string, file_id string, index_page int, line_no int, line string")
    ids = spark.createDataFrame([("t", "j", "f", p, n) for p, n in [(2, "A-701"), (7, "A-701"), (6, "A-701"), (2, "A-101"), (4, "Z-9")]], "tenant_id string, job_id string, file_id string, page int, sheet_no string")
    files = spark.createDataFrame([("t", "j", "f", 5)], "tenant_id string, job_id string, file_id string, page_count int")
    assert _rows(drawings.sheets_from_index(lines, ids, files), "sheet_no", "title", "page", "page_source", "sheet_type", "level") == [
        ("3.9.51", "3.9.51", 5, "estimated", "floor_plan", None),
        ("A-101", "FIRST FLOOR PLAN", 3, "estimated", "floor_plan", "LEVEL 1"),
        ("A-102.1B", "SEE", 5, "estimated", "floor_plan", None),
        ("A-701", "SIGN SCHEDULE", 6, "scanned", "signage_schedule", None),
    ]


def test_type_code_rows(spark):
    rooms = spark.createDataFrame([("t", j, i, n) for j in ("home", "school") for i, n in enumerate(["0101", "101", "A407", "A507", "B201", ""])], "tenant_id string, job_id string, seq long, room_number string")
    jobs = spark.createDataFrame([("t", "home", " Residential"), ("t", "school", "education")], "tenant_id string, job_id string, building_type string")
    rows = [(1, "", "OLD", "a", 1), (2, None, "UNIT SIGN", "A", 1), (3, "101", "", "a", 0), (4, "00101", "x", "B2", 3), (5, "a307", "y", "A", 1), (6, "Z9", "z", "A", 1), (7, "101", "w", "Exit", 1)]
    schedule = spark.createDataFrame([("t", j, *r) for j in ("home", "school") for r in rows], "tenant_id string, job_id string, seq long, room_number string, room_name string, sign_type string, quantity int")
    found = schedules.match_type_code_rows(schedule, rooms, jobs)
    direct = [(3, 1, "UNIT SIGN", 1, "schedule_room_match:a"), (4, 1, "B2", 3, "schedule_room_match:B2")]
    spread = [(5, 2, "UNIT SIGN", 1, "schedule_room_match:A"), (5, 3, "UNIT SIGN", 1, "schedule_room_match:A")]
    columns = ("schedule_seq", "room_seq", "sign_type", "qty", "rule_ref")
    assert _rows(found.filter("job_id = 'home'"), *columns) == direct + spread
    assert _rows(found.filter("job_id = 'school'"), *columns) == direct
    assert _rows(found.filter("job_id = 'home' and room_seq = 2"), "message") == [("Type A | a307 A407 y",)]
