"""Own literal rows for operators: odd values, order of rows, and values that SQL twins do not cover."""

import pytest
from pyspark.sql import functions as F

from wayfind.functions import text
from wayfind.operators import cells, cleaning, dedup, egress, jobs, learning, matching, pricing, rules, sheets

ROOM = "tenant_id string, job_id string, seq long, sheet_id string, room_number string, room_name string, level string, coord_x long, coord_y long, occupant_load int, confidence double, source string, review_status string"


def rooms(spark, *rows):
    """Rows of (number, name[, level[, load]]) of one job."""
    full = [("t", "j", i + 1, "s", r[0], r[1], r[2] if len(r) > 2 else "LEVEL 1", 0, 0, r[3] if len(r) > 3 else None, 0.9, "pdf", "pending") for i, r in enumerate(rows)]
    return spark.createDataFrame(full, ROOM)


def values(spark, column, *inputs):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], "i int, x string")
    return [r[0] for r in df.orderBy("i").select(column(F.col("x"))).collect()]


@pytest.mark.parametrize(
    "flag, yes, no",
    [
        ("is_restroom", ["men's toilet", "WC 2", "Girls Locker", "SHOWERLOCKER"], ["STOREROOM", "SENSORY ROOM", "WOMENFOLK", None, ""]),
        ("is_stair", ["STAIR A", "EXIT STAIR", "EMERGENCY STAIR", "STAIRWELL 2"], ["JANITOR STAIR", "TRAINING BREAK STAIR", "MEN'S STAIR MECHANICAL", "UPSTAIRS"]),
        ("is_corridor", ["CORR", "Main Hallway", "HALL"], ["HALLMARK", "SHALL"]),
        ("is_mep", ["MECH ROOM", "IT ROOM", "PUMP ROOM"], ["KITCHEN", "ELECTIVE"]),
        ("is_unit", ["UNIT 101", "APT 5", "X UNIT 2A", "SUITE 200"], ["UNIT 106A", "106A", "STORAGE UNIT"]),
        ("is_door_schedule_entry", ["106A", " 12 "], ["106AB", "ROOM 106A"]),
        ("is_assembly", ["GYM", "LECTURE HALL", "ASSEMBLY"], ["GYMKHANA", "OFFICE"]),
    ],
)
def test_room_flags(spark, flag, yes, no):
    assert values(spark, lambda c: text.room_flags(c)[flag], *yes) == [True] * len(yes)
    assert values(spark, lambda c: text.room_flags(c)[flag], *no) == [False] * len(no)


def test_levels(spark):
    assert values(spark, text.normalize_level, None, "", "level 3", "L2", "FL-4", "7", "Ground", "2nd floor", "basement", "b1", "mezz", "low roof", "Attic") == ["LEVEL 1", "LEVEL 1", "LEVEL 3", "LEVEL 2", "LEVEL 4", "LEVEL 7", "LEVEL 1", "LEVEL 2", "LEVEL B1", "LEVEL B1", "MEZZANINE", "ROOF", "ATTIC"]
    assert values(spark, text.level_from_room_number, "A307", "012", "12", "1234", "205B", None) == ["LEVEL 3", "LEVEL B1", None, None, "LEVEL 2", None]
    assert values(spark, text.building_from_room_number, "123A", "B1234", "12A", None) == ["A", "B", None, None]
    assert values(spark, text.wing_sort_key, "W139", "e12", "7", "X1", None) == ["A00000139", "B00000012", "C00000007", "DX1", "Zÿ"]
    assert values(spark, text.format_level, None, "g", "B1", "3", "Level 2") == ["Unspecified Floor", "Ground Floor", "Basement", "Level 3", "LEVEL 2"]


def test_names(spark):
    assert values(spark, text.valid_room_name, "OFFICE", "A", None, "60X21 CASEWORK", "12345", "AB1", "8'-0 X") == [True, False, False, False, False, True, False]
    assert values(spark, text.predict_sign_type, "Exit door", "stair landing", "stair hall", "Men's room", "Tenant directory", "Suite 4", "Closet") == ["Exit", "Stair(Landing)", "Stair(Corridor)", "Restroom", "Office Directory", "Room ID w/insert", "Room ID"]


def test_dedup_keeps_the_first_whatever_the_partitions(spark):
    rows = [("t", "j", s, "s1", n, "ROOM", t, m) for s, n, t, m in [(3, "101", "Exit", None), (1, " 101 ", "exit", ""), (2, "101", "Exit", "A"), (4, "", "", None)]]
    df = spark.createDataFrame(rows, "tenant_id string, job_id string, seq long, sheet_id string, room_number string, room_name string, sign_type string, type_mark string")
    for parts in (1, 3):
        d = df.repartition(parts)
        assert sorted(r["seq"] for r in dedup.dedup_schedule(d).collect()) == [1, 2, 4]
        assert sorted(r["seq"] for r in dedup.dedup_schedule_global(d.withColumn("room_name", F.lit(" "))).collect()) == [1, 2]
        once = dedup.dedup_schedule_rooms(d)
        assert sorted(r["seq"] for r in dedup.dedup_schedule_rooms(once).collect()) == sorted(r["seq"] for r in once.collect())
    assert dedup.dedup_schedule(df.limit(0)).count() == 0


def test_dedup_rooms(spark):
    df = rooms(spark, ("101", "MEN'S TOILET"), ("101", "AGAIN"), ("101", "OTHER FLOOR", "LEVEL 2"), ("", "toilet"), ("", "MAIN OFFICE"), ("", "MAIN OFFICE"), ("102", "OPEN OFFICE AREA"), ("", "OFFICE"), ("", "DEN"), ("103", "MAIN CORRIDOR"), ("", "HALL"), ("", "THE MAIN CORRIDOR EAST"))
    assert sorted(r["seq"] for r in dedup.dedup_rooms(df).collect()) == [1, 3, 5, 7, 9, 10]


def test_final_sign_dedup(spark):
    rows = [(1, 10, "101", "A", "Exit", 0.8, "rules_engine", None, "n1"), (2, 10, "101", "A", "exit ", 0.9, "ai_vision", None, "n2"), (3, 11, "101", "A", "Exit", 0.9, "schedule", None, ""), (4, None, "", "", "Exit", 0.5, "x", "L1", "note"), (5, None, "", "", "Exit", 0.5, "rules_engine", "L1", "NOTE"), (6, None, "", "", "Exit", 0.5, "x", "L2", "note")]
    df = spark.createDataFrame([("t", "j", *r) for r in rows], "tenant_id string, job_id string, seq long, room_seq long, room_number string, room_name string, sign_type string, confidence double, source string, floor_label string, notes string")
    assert sorted(r["seq"] for r in dedup.dedup_signs(df).collect()) == [3, 5, 6]


def jobs_of(spark, kind):
    return spark.createDataFrame([("t", "j", kind)], "tenant_id string, job_id string, building_type string")


def signs_of(spark, kind, *rows):
    ready = rules.prepared(rooms(spark, *rows), jobs_of(spark, kind))
    return sorted((r["seq"], r["sign_type"], r["qty"], r["rule_ref"]) for r in rules.room_signs(ready).collect())


def test_room_rules(spark):
    assert signs_of(spark, "commercial", ("101", "OFFICE"), ("102", "CORR"), ("103", "MEN'S TOILET"), ("104", "ENTRY VESTIBULE"), ("105", "106A"), ("106", "GYMNASIUM", "LEVEL 1", 80), ("107", "MECH ROOM"), ("108", "TRAINING / COMMUNITY")) == [
        (1, "Room ID", 1, "R1"),
        (3, "Restroom(Men)", 1, "R8"),
        (3, "Room ID", 1, "R1"),
        (4, "Exit", 1, "R9"),
        (4, "Exit(Tactile)", 1, "R9"),
        (4, "Room ID", 1, "R1"),
        (6, "Exit", 2, "R9"),
        (6, "Max Occupancy", 1, "R10"),
        (6, "Room ID w/insert", 1, "R2"),
        (8, "Room ID w/insert", 2, "R2"),
    ]
    assert signs_of(spark, "residential", ("101A", "UNIT 1"), ("102", "CLOSET"))[0] == (1, "Room ID", 1, "R16")
    assert signs_of(spark, "commercial", ("1", "UNIT 5"), ("2", "LEGEND")) == []
    assert signs_of(spark, "unknown") == []


def test_aggregate_rules(spark):
    ready = rules.prepared(rooms(spark, ("S1", "STAIR A", "LEVEL 1"), ("S1", "STAIR A", "LEVEL 2"), ("E1", "ELEVATOR", "LEVEL 1"), ("E1", "ELEVATOR", "LEVEL 2"), ("E2", "LIFT", "LEVEL 2")), jobs_of(spark, "government"))
    assert sorted((r["sign_type"], r["qty"]) for r in rules.stair_signs(ready).collect()) == [("Area of Rescue", 2), ("Exit(Tactile)", 2), ("Office Directory", 1), ("Stair(Corridor)", 2), ("Stair(Landing)", 2)]
    assert [(r["qty"], r["floor_label"]) for r in rules.elevator_signs(ready).collect()] == [(2, "LEVEL 1")]
    assert sorted(r["qty"] for r in rules.formula_exits(ready).collect()) == [4, 4]
    assert [r["maps"] for r in rules.evacuation_maps(ready).collect()] == [2]


def test_building_type(spark):
    detect = lambda kind, *names: rules.detect_building_type(rooms(spark, *(("1", n) for n in names)), jobs_of(spark, kind)).first()["detected"]
    assert detect("unknown", "UNIT 1", "UNIT 2", "X") == "residential"
    assert detect(None, "ROOM 1", "LOBBY", "RECEPTION", "GYM") == "hotel"
    assert detect("UNKNOWN", "EXAM ROOM", "GYM") == "healthcare"
    assert detect("Retail", "EXAM ROOM") == "retail"
    assert detect("unknown", "CLOSET") == "commercial"


def test_overrides_fold_in_order(spark):
    base = rules.classify_rooms(rooms(spark, ("101", "OFFICE"), ("102", "GYM"), ("103", "OPEN OFFICE EAST"))).withColumn("occupancy_group", F.lit(None).cast("string"))
    base = base.withColumn("signs", F.array(F.struct(F.lit("Room ID").alias("sign_type"), F.lit(1).alias("qty"), F.lit("R1").alias("rule_ref"), F.lit(0.85).alias("confidence"))))
    flags = [f"c_{k}" for k in egress._FLAGS]

    def over(seq, kind, sign, qty=1, confidence=0.8, tenant="t", **conditions):
        return (tenant, seq, f"o{seq}", kind, sign, qty, confidence, *(conditions.get(k) for k in ("contains", "pattern", "number", "group")), *(conditions.get(k[2:]) for k in flags))

    schema = "tenant_id string, seq long, rule_ref string, override_type string, sign_type string, qty int, confidence double, c_contains string, c_pattern string, c_number string, c_group string, " + ", ".join(f"{k} boolean" for k in flags)

    def run(*rows):
        out = egress.apply_overrides(base, spark.createDataFrame(list(rows), schema)).collect()
        return {r["seq"]: [(s["sign_type"], s["qty"]) for s in r["signs"]] for r in out}

    plain = [("Room ID", 1)]
    assert run(over(1, "add", "Exit", pattern="office")) == {1: [*plain, ("Exit", 1)], 2: plain, 3: [*plain, ("Exit", 1)]}
    assert run(over(1, "add", "Exit", 2, number="101"), over(2, "modify_qty", "Exit", 5, contains="off"), over(3, "exclude", "Room ID", number="101")) == {1: [("Exit", 5)], 2: plain, 3: plain}
    assert run(over(1, "sign_type", "Directional", pattern="office east"), over(2, "add", "Exit", pattern="office")) == {1: [*plain, ("Exit", 1)], 2: plain, 3: [("Directional", 1)]}
    assert run(*(over(i, "add", f"S{i}", confidence=0.1 * i, number="101") for i in range(1, 5))) == {1: [*plain, ("S3", 1), ("S4", 1)], 2: plain, 3: plain}
    assert run(over(1, "sign_type", "Max Occupancy", number="101"), over(2, "sign_type", "Max Occupancy", number="102"), over(3, "sign_type", "Nonsense", number="103"), over(4, "add", "X", tenant="other", number="101")) == {1: plain, 2: [("Max Occupancy", 1)], 3: plain}


def test_alike_rooms_are_folded_once(spark):
    """The fold is the costly step: it runs for each kind of room, not for each room."""
    import glob

    base = rules.classify_rooms(rooms(spark, *[("101", "OFFICE")] * 20, *[("102", "GYM")] * 20)).withColumn("occupancy_group", F.lit(None).cast("string"))
    base = base.withColumn("signs", F.array(F.struct(F.lit("Room ID").alias("sign_type"), F.lit(1).alias("qty"), F.lit("R1").alias("rule_ref"), F.lit(0.85).alias("confidence"))))
    none = [F.lit(None).cast(kind).alias(c) for c, kind in [("c_contains", "string"), ("c_group", "string"), *((f"c_{k}", "boolean") for k in egress._FLAGS)]]
    given = spark.createDataFrame([("t", 1, "o1", "add", "Exit", 1, 0.8, "office", None), ("t", 2, "o2", "exclude", "Room ID", 1, 0.8, None, "102")], "tenant_id string, seq long, rule_ref string, override_type string, sign_type string, qty int, confidence double, c_pattern string, c_number string").select("*", *none)
    folded = lambda: set(glob.glob(f"{spark.conf.get('spark.checkpoint.dir')}/overridden-*"))
    before = folded()
    out = egress.apply_overrides(base, given).collect()
    assert sorted((r["seq"], [s["sign_type"] for s in r["signs"]]) for r in out) == [(i, ["Room ID", "Exit"] if i <= 20 else []) for i in range(1, 41)]
    (new,) = folded() - before
    assert spark.read.parquet(new).count() == 2


def test_overrides_come_from_all_corrections(spark):
    from types import SimpleNamespace

    from wayfind.plans import reviews

    kinds = ["ai_missed", "ai_extra", "edit", "sign_type_override"]
    rows = [("t", i, kinds[i % 4], f"ROOM {i}", "Exit") for i in range(12)]
    v = SimpleNamespace(corrections=spark.createDataFrame([*rows, *rows[:1]], "tenant_id string, seq long, correction_type string, room_name_pattern string, sign_type string"))
    out = reviews._learned(v).collect()
    assert sorted((r["seq"], r["override_type"], r["c_pattern"]) for r in out) == [(i, ["add", "exclude", "modify_qty", "sign_type"][i % 4], f"ROOM {i}") for i in range(12)]


def test_cells(spark):
    tall = [["", "note"], ["Sign Type", "Room Name", "Qty", "Floor"], ["Exit", "Lobby", "3 ea", "2"], ["", "x", "1", ""], ["Exit", "Hall", "", None]]
    wide = [["Room #", "Text on Sign", "Exit AA1", "Notes", "Total", "Restroom"], ["First Floor", "", "", "", "", ""], ["101", "Lobby", "x", "hello", "9", "-"], ["102", "", "2.4", "", "", "maybe"], ["", "", "x", "", "", ""]]
    none = [["a", "b"]]
    rows = [("w1", "s", i, r) for i, r in enumerate(tall)] + [("w2", "a", i, r) for i, r in enumerate(wide)] + [("w2", "b", i, r) for i, r in enumerate(none)]
    out = cells.takeoff_rows(spark.createDataFrame(rows, "workbook string, sheet string, row_idx long, cells array<string>")).collect()
    assert sorted((r["workbook"], r["sign_type"], r["room_number"], r["room_name"], r["level"], r["qty"]) for r in out) == [
        ("w1", "Exit", "", "Hall", "", 1),
        ("w1", "Exit", "", "Lobby", "2", 3),
        ("w2", "Exit", "a:101", "Lobby", "First Floor", 1),
        ("w2", "Exit", "a:102", "102", "First Floor", 2),
        ("w2", "Restroom", "a:102", "102", "First Floor", 1),
    ]


def test_scores_are_symmetric_and_empty_sides_count(spark):
    schema = "tenant_id string, job_id string, k string"
    a, b = spark.createDataFrame([("t", "j", x) for x in "abcd"], schema), spark.createDataFrame([("t", "j", x) for x in "bcx"], schema)
    x, y = matching.score_presence(a, b, ["k"]).first(), matching.score_presence(b, a, ["k"]).first()
    assert (x["tp"], x["fp"], x["fn"]) == (2, 1, 2) and x["precision"] == y["recall"] and x["f1"] == y["f1"]
    z = matching.score_presence(a, b.limit(0), ["k"]).first()
    assert (z["precision"], z["recall"], z["f1"]) == (1.0, 0.0, 0.0)


def test_presence_lists_meet_nulls_in_one_shuffle(spark):
    schema = "tenant_id string, job_id string, k string"
    a, b = spark.createDataFrame([("t", "j", x) for x in ("a", "a", "b", None)], schema), spark.createDataFrame([("t", "j", x) for x in ("b", None, "x")], schema)
    out = matching.presence_lists(a, b, ["k"])
    assert sorted((r["k"], r["kind"]) for r in out.collect()) == [("a", "missed"), ("x", "extra")]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan
    score = matching.score_presence(a, b, ["k"]).first()
    assert (score["tp"], score["fp"], score["fn"]) == (1, 2, 2)


def test_floor_totals_add_up(spark):
    rows = [("t", "j", i, None, "Exit" if i % 2 else "Evacuation Map", i % 3 + 1, 0.9, "x", False, f"{i % 4}", str(i), "n", None) for i in range(40)]
    signs = spark.createDataFrame(rows, "tenant_id string, job_id string, seq long, room_seq long, sign_type string, qty int, confidence double, source string, is_deleted boolean, floor_label string, room_number string, room_name string, review_status string")
    out = pricing.floor_totals(pricing.takeoff_lines(signs)).collect()
    total = [r for r in out if r["level"] is None][0]
    assert total["qty"] == sum(r["qty"] for r in out if r["level"] is not None)
    assert abs(total["extended"] - sum(r["extended"] for r in out if r["level"] is not None)) < 0.01
    assert jobs.live_sign_counts(signs).first()["total_signs"] == total["qty"]


def test_hot_patterns_gather_five_jobs(spark):
    rows = [("t", f"j{i:03d}", i, "edit", "OFFICE", "Exit", None, True) for i in range(300)] + [("t", "j1", 900, "edit", "AB", "Exit", None, True), ("t", "j1", 901, "edit", "LEGEND", "Exit", None, True)]
    df = spark.createDataFrame(rows, "tenant_id string, job_id string, seq long, correction_type string, room_name_pattern string, sign_type string, created_at timestamp, is_active boolean")
    out = learning.mine_patterns(df).collect()
    assert [(r["evidence"], r["status"], r["example_jobs"]) for r in out] == [(300, "approved", [f"j{i:03d}" for i in range(5)])]


def test_scope_reads_the_whole_schedule(spark):
    from types import SimpleNamespace

    from wayfind.plans import cleaning as plans

    schema = "tenant_id string, job_id string, seq long, sign_type string"
    v = SimpleNamespace(schedule=spark.createDataFrame([("t", "j4", 211, "Exit"), ("t", "j4", 212, "Exit"), ("t", "j5", 211, "Restroom"), ("t", "j5", 212, "Exit")], schema))
    sheets = spark.createDataFrame([], "tenant_id string, job_id string, sheet_no string, title string")
    assert [r["job_id"] for r in plans.cleaning.job_scope(plans._typed_by_job(v), sheets).collect()] == ["j4"]


def test_doors_are_stated_or_told_by_names_and_keywords(spark):
    rows = rooms(spark, ("1", "Great Room"), ("2", "GYMNASIUM"), ("3", "BREAK (A+B)"), ("4", "GREATROOM"), ("5", None), ("6", "GYMNASIUM"), ("7", "GYMNASIUM"), ("8", "OFFICE"))
    rows = rows.withColumn("public_door_count", F.when(F.col("seq") == 6, 1).when(F.col("seq") == 7, 0).when(F.col("seq") == 8, 5))
    words = spark.createDataFrame([("t", " great room "), ("t", "(a+b)"), ("t", ""), ("t", None), ("u", "OFFICE")], "tenant_id string, keyword string")
    told = lambda w: [r["_doors"] for r in rules.door_counts(rows, w).orderBy("seq").collect()]
    assert told(words) == [3, 3, 3, 1, 1, 1, 3, 5]
    assert told(None) == told(words.limit(0)) == [1, 3, 1, 1, 1, 1, 3, 5]
    assert signs_of(spark, "commercial", ("1", "APPARATUS BAY")) == [(1, "Room ID", 3, "R3")]


def test_guards_and_aliases(spark):
    kinds = [("Unit ID", "hotel", False), ("Unit ID", "commercial", False), ("Max Occupancy", "commercial", True), ("Max Occupancy", "commercial", None), ("Plaque", "hotel", True), ("Room ID", None, False), (None, "hotel", False)]
    df = spark.createDataFrame([("t", "j", i, *k) for i, k in enumerate(kinds)], "tenant_id string, job_id string, seq long, sign_type string, detected string, is_assembly boolean")
    assert sorted(r["seq"] for r in cleaning.canonical_guard(df).collect()) == [0, 2, 5]
    told = spark.createDataFrame([("t", "j", 2, "B", "room-id, wall"), ("t", "j", 1, "A", "Room Number"), ("t", "j", 3, "C", "bedroom identity"), ("t", "k", 1, "D", None)], "tenant_id string, job_id string, position int, type_code string, description string")
    assert [r["sign_type"] for r in cleaning.alias_types(df, told).orderBy("seq").collect()][4:] == ["Plaque", "Type B", None]
    assert cleaning.alias_types(df, told.limit(0)).filter("sign_type = 'Room ID'").count() == 1


def test_legend_orders_levels(spark):
    rows = [("t", "j", level, qty, gone, source, status) for level, qty, gone, source, status in (("ROOF", 1, False, "pdf", "pending"), ("LEVEL 2", 2, False, "ai_vision", "pending"), ("LEVEL 2", 3, False, "ai_vision", "confirmed"), ("Ground", None, False, None, None), (None, 4, False, "pdf", "pending"), ("ATTIC", 9, True, "pdf", "pending"), ("LEVEL 12", 1, False, "pdf", "pending"))]
    df = spark.createDataFrame(rows, "tenant_id string, job_id string, floor_label string, qty int, is_deleted boolean, room_source string, review_status string")
    got = [tuple(r)[2:] for r in pricing.legend_levels(df).orderBy("position").select("tenant_id", "job_id", "level", "n_rows", "qty", "sure_qty", "position").collect()]
    assert got == [("Ground", 1, 1, 1, 1), ("LEVEL 12", 1, 1, 1, 2), ("LEVEL 2", 2, 5, 3, 3), ("ROOF", 1, 1, 1, 4), ("Unassigned", 1, 4, 4, 5)]


def test_sheets_are_made_for_pages_that_no_index_told(spark):
    files = spark.createDataFrame([("t", "j", "a", "a.pdf", 3, None), ("t", "j", "b", "2nd Floor.PDF", None, None), ("t", "j", "c", "c.txt", None, None), ("t", "k", "d", "d.pdf", None, 30 << 20), ("t", "k", "e", "e.pdf", 2, None), ("t", "l", "f", "f.pdf", 35, None)], "tenant_id string, job_id string, file_id string, filename string, page_count int, size_bytes long")
    told = spark.createDataFrame([("t", "j", "a", 2), ("t", "j", "a", 2)], "tenant_id string, job_id string, file_id string, page int")
    out = sheets.synthesize_sheets(files, told)
    pages = {}
    for r in out.collect():
        pages.setdefault(r["file_id"], []).append((r["page"], r["title"], r["level"]))
    assert sorted(pages["a"]) == [(1, "Floor Plan Level 1", "LEVEL 1"), (3, "Floor Plan Level 3", "LEVEL 3")]
    assert pages["b"] == [(1, "2nd Floor", "LEVEL 2")]
    assert {k: len(v) for k, v in pages.items()} == {"a": 2, "b": 1, "d": 8, "e": 3, "f": 35}
    assert sorted(pages["e"])[2] == (3, "FLOOR PLAN LEVEL 3", "LEVEL 3")


def test_names_of_rooms_are_not_broadcast(spark):
    """Names of all jobs are a small file and a large table: the driver must not hold it."""
    plan = dedup.dedup_rooms(rooms(spark, ("101", "MEN'S TOILET"), ("", "TOILET"), ("", "STORAGE")))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
