"""The whole rules engine on literal rows: reasons, order of the guards, and runs that repeat."""

from pyspark.sql import functions as F

from tests.test_operators import rooms
from wayfind.operators import egress, rules, ruling
from wayfind.sources.kept import kept, place_of

JOBS = "tenant_id string, job_id string, building_type string, status string"


def override(spark, *rows):
    """Rows of (seq, kind, sign type, pattern, qty, confidence)."""
    full = [("t", s, f"o{s}", k, t, q, c, None, p, None, None, *[None] * len(egress._FLAGS)) for s, k, t, p, q, c in rows]
    flags = ", ".join(f"c_{k} boolean" for k in egress._FLAGS)
    return spark.createDataFrame(full, f"tenant_id string, seq long, rule_ref string, override_type string, sign_type string, qty int, confidence double, c_contains string, c_pattern string, c_number string, c_group string, {flags}")


def ready(spark, own, kind="commercial", keywords=None):
    jobs = spark.createDataFrame([("t", "j", kind, "completed")], JOBS)
    return kept(rules.prepared(own.withColumn("occupancy_group", F.lit(None).cast("string")), jobs, keywords), "prepared")


def found(df):
    return sorted((r["room_seq"] or 0, r["sign_type"], r["qty"] or 0, r["rule_ref"], r["reason"]) for r in df.filter("room_seq is not null").collect())


def test_reasons(spark):
    own = rooms(spark, ("101", "OFFICE"), ("102", "MEN'S TOILET"), ("103", "LOBBY VESTIBULE"), ("104", "STORAGE"))
    overrides = override(spark, (1, "exclude", "Room ID", "TOILET", 1, 0.9), (2, "sign_type", "Max Occupancy", "STORAGE", 1, 0.9), (3, "add", "Plaque", "OFFICE", 2, 0.8), (4, "add", "Unit ID", "OFFICE", 1, 0.8), (5, "sign_type", "Exit", "VESTIBULE", 4, 0.9))
    definitions = spark.createDataFrame([("t", "j", 1, "D", "directory"), ("t", "j", 2, "A", "Room Identification")], "tenant_id string, job_id string, position int, type_code string, description string")
    lines = found(ruling.rule_jobs(ready(spark, own), overrides, definitions))
    assert (1, "Type A", 1, "R1", None) in lines
    assert (1, "Plaque", 2, "o3", "not canonical") in lines and (1, "Unit ID", 1, "o4", "no units here") in lines
    assert (2, "Room ID", 1, "R1", "excluded") in lines and (2, "Restroom(Men)", 1, "R8", None) in lines
    # the correction takes the place of all signs, and the definitions then know no exit
    assert (3, "Exit", 4, "o5", "not in definitions") in lines and (3, "Exit", 1, "R9", "replaced") in lines
    # Max Occupancy is no correction outside assembly rooms
    assert (4, "Type A", 1, "R1", None) in lines and not any(r[1] == "Max Occupancy" for r in lines)
    log = ruling.suppressed(ruling.rule_jobs(ready(spark, own), overrides, definitions))
    assert log.columns == ["tenant_id", "job_id", "room_seq", "rule_ref", "sign_type", "reason"]
    # exits by formula and signs of stairs are judged too
    assert log.filter("room_seq is null and sign_type = 'Exit' and reason = 'not in definitions'").count() > 0


def test_own_door_keywords(spark):
    own = rooms(spark, ("101", "PLAY LAB"), ("102", "OFFICE"))
    words = spark.createDataFrame([("t", " play lab "), ("t", " ")], "tenant_id string, keyword string")
    lines = found(ruling.rule_jobs(ready(spark, own, keywords=words)))
    assert (1, "Room ID", 3, "R3", None) in lines and (2, "Room ID", 1, "R1", None) in lines


def test_reruled_jobs_repeat_without_change(spark):
    own = rooms(spark, ("101", "OFFICE"), ("", "MEN'S TOILET", "LEVEL 2"), ("A", "STAIR A")).withColumn("sheet_id", F.when(F.col("seq") == 2, "s2"))
    other = own.withColumn("job_id", F.lit("busy"))
    every = own.unionByName(other).withColumn("occupancy_group", F.lit(None).cast("string"))
    jobs = spark.createDataFrame([("t", "j", "", "completed"), ("t", "busy", "commercial", "processing"), ("t", "bare", "commercial", "completed")], JOBS)
    stored = spark.createDataFrame(
        [("t", "j", 1, "Old", 1, None, 0.5, None, "rules_engine", 3), ("t", "j", 1, "Hand", 1, None, 0.5, "s9", "manual", None), ("t", "busy", 1, "Stays", 1, None, 0.5, None, "rules_engine", 3)],
        "tenant_id string, job_id string, room_seq long, sign_type string, qty int, rule_ref string, confidence double, sheet_id string, source string, generation long",
    )
    again, made = ruling.reruled(every, jobs, override(spark, (1, "add", "Exit", "OFFICE", 7, 0.9)))
    once = kept(ruling.merge_ruled(stored, again, made, 4), "merged")
    rows = sorted(map(str, once.collect()))
    assert sorted(map(str, ruling.merge_ruled(once, again, made, 4).collect())) == rows
    assert {r["sign_type"] for r in once.filter("job_id = 'busy' or source = 'manual'").collect()} == {"Stays", "Hand"}
    new = {(r["room_seq"], r["sign_type"], r["qty"], r["sheet_id"]) for r in once.filter("generation = 4").collect()}
    assert {(1, "Room ID", 1, "s2"), (1, "Exit", 7, "s2"), (2, "Restroom(Men)", 1, "s2"), (None, "Stair(Corridor)", 2, "s2")} <= new
    assert once.filter("sign_type = 'Old'").count() == 0
    # a later run takes the place of this one
    assert ruling.merge_ruled(once, again, made, 5).filter("generation = 4").count() == 0
    total = {r["job_id"]: (r["signs_updated"], r["total_qty"]) for r in ruling.rerule_totals(again, made).collect()}
    assert total == {"j": (len([r for r in rows if "generation=4" in r]), once.filter("generation = 4").agg(F.sum("qty")).first()[0])}


def test_signs_are_made_once_a_kind(spark):
    own = rooms(spark, *[(str(n), name) for n in range(101, 121) for name in ("OFFICE", "MECH ROOM")])
    of = ready(spark, own)
    _, kinds = rules.kinds_of_rooms(of)
    assert kinds.count() == 2
    # an override that asks for a number concerns that room alone
    number = override(spark, (1, "add", "Plaque", None, 2, 0.9)).withColumn("c_number", F.lit("105"))
    lines = found(ruling.rule_jobs(of, number))
    alone = rules.room_signs(of).filter("sign_type = 'Room ID'").count()
    assert [(r[1], r[2]) for r in lines if r[1] == "Plaque"] == [("Plaque", 2)] * 2
    assert sum(r[1] == "Room ID" for r in lines) == alone >= 20


def test_prepared_rooms_are_written_without_what_names_tell(spark):
    own = rooms(spark, ("101", "OFFICE"), ("102", None), ("S1", "STAIR A", "LEVEL 2")).withColumn("occupancy_group", F.lit(None).cast("string"))
    jobs = spark.createDataFrame([("t", "j", "education", "completed")], JOBS)
    once, whole = rules.prepared_once(own, jobs), rules.prepared(own, jobs)
    assert once.columns == whole.columns and sorted(map(str, once.collect())) == sorted(map(str, whole.collect()))
    written = spark.read.parquet(place_of(once)).columns
    assert "is_stair" not in written and "mep_policy" not in written and "_doors" in written
