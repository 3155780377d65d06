"""Intermediate tables, and lines of tables that change under the same path."""

import os
import shutil

from pyspark.sql import functions as F

from wayfind.operators import pricing, schedules, sheets
from wayfind.sources.kept import kept, numbered, place_of, scratch, stamp
from wayfind.sources.views import Views

SF = "/root/testdata/sf0.001"


def test_scratch_deletes_what_is_kept_meanwhile(spark):
    before = kept(spark.range(3), "stays")
    with scratch(spark):
        inner = kept(spark.range(5), "goes")
        place = place_of(inner)
        assert inner.count() == 5 and stamp(spark, place)
    assert not stamp(spark, place) and before.count() == 3


def test_lines_follow_the_files(spark, tmp_path):
    for name in ("lineitem", "orders", "events"):
        shutil.copy(f"{SF}/{name}.parquet", tmp_path / f"{name}.parquet")
    one = Views(spark, str(tmp_path)).rooms.count()
    whole = spark.read.parquet(f"{SF}/lineitem.parquet")
    whole.limit(100).coalesce(1).write.parquet(str(tmp_path / "new"))
    part = next(f for f in os.listdir(tmp_path / "new") if f.endswith(".parquet"))
    shutil.copy(tmp_path / "new" / part, tmp_path / "lineitem.parquet")
    assert one == whole.count() and Views(spark, str(tmp_path)).rooms.count() == 100
    # a cleaned folder is written again
    shutil.rmtree(place_of(Views(spark, str(tmp_path)).lines).removeprefix("file:"))
    assert Views(spark, str(tmp_path)).rooms.count() == 100


def test_exports_replace_one_job(spark, tmp_path):
    rows = spark.createDataFrame([("t", "a", 2, "x"), ("t", "a", 1, "y"), ("t", "b", 1, "z"), ("u", "a", 1, "w")], "tenant_id string, job_id string, position int, line string")
    path = str(tmp_path / "out")
    schedules.write_jobs(rows, path)
    others = sorted(str(r) for r in spark.read.parquet(path).filter("not (tenant_id = 't' and job_id = 'a')").collect())
    schedules.write_jobs(spark.createDataFrame([("t", "a", 7, "new")], rows.schema), path)
    back = spark.read.parquet(path)
    assert [r["line"] for r in back.filter("tenant_id = 't' and job_id = 'a'").collect()] == ["new"]
    assert sorted(str(r) for r in back.filter("not (tenant_id = 't' and job_id = 'a')").collect()) == others
    schedules.write_jobs(rows, str(tmp_path / "csv"), "csv")
    assert sorted(r["line"] for r in spark.read.option("header", True).csv(str(tmp_path / "csv")).collect()) == ["w", "x", "y", "z"]


def test_codes_in_natural_order(spark):
    codes = ["S-10", "S-2", "A2", "A10b", "A10", "A010a", None, "", "s-3", "A" + "9" * 40]
    df = spark.createDataFrame([(c,) for c in codes], "c string")
    got = [r["c"] for r in df.orderBy(schedules.code_key(F.col("c")), F.coalesce("c", F.lit(""))).collect()]
    assert got == [None, "", "A2", "A10", "A010a", "A10b", "A" + "9" * 40, "S-2", "s-3", "S-10"]


def test_lines_of_tenants_without_a_list_keep_list_prices(spark):
    signs = spark.createDataFrame([("t", "j", 1, "Exit", 2, "L1", "101", False), ("u", "j", 1, "Exit", 2, "L1", "101", False)], "tenant_id string, job_id string, seq long, sign_type string, qty int, floor_label string, room_number string, is_deleted boolean")
    rates = pricing.tenant_rates(
        spark.createDataFrame([("t", "m", 1.0, None, "Brass")], "tenant_id string, id string, bid_price double, msrp double, name string"),
        spark.createDataFrame([], "tenant_id string, id string, unit string, bid_price double"),
        spark.createDataFrame([("t", 1, "EXIT", "m", [], 10.0, 10.0, 5.0)], "tenant_id string, seq long, sign_type string, material_id string, finishing_ids array<string>, width double, height double, min_price double"),
    )
    lines = pricing.takeoff_lines(signs)
    own = {r["tenant_id"]: (r["unit_price"], r["extended"], r["material"]) for r in pricing.tenant_lines(lines, rates, spark.createDataFrame([], "tenant_id string, code string, size string")).collect()}
    assert own == {"t": (100.0, 200.0, "Brass"), "u": (59.04, 118.08, None)}


def test_files_of_an_export_do_not_grow_with_its_jobs(spark, tmp_path):
    rows = spark.range(2000).selectExpr("concat('t', id % 3) tenant_id", "concat('j', id) job_id", "id position", "'old' line")
    path = str(tmp_path / "many")
    schedules.write_jobs(rows, path)
    schedules.write_jobs(rows.filter("id % 4 = 0").withColumn("line", F.lit("new")), path)
    back = spark.read.parquet(path)
    assert sorted((r["position"], r["line"]) for r in back.collect()) == [(i, "new" if i % 4 == 0 else "old") for i in range(2000)]
    assert len(back.inputFiles()) < 2 * schedules.FOLDERS


def test_an_export_replaces_jobs_without_a_name(spark, tmp_path):
    path, kind = str(tmp_path / "null"), "tenant_id string, job_id string, position int, line string"
    schedules.write_jobs(spark.createDataFrame([("t", None, 1, "x"), (None, "a", 1, "y"), ("", "a", 1, "z")], kind), path)
    schedules.write_jobs(spark.createDataFrame([("t", None, 1, "u"), (None, "a", 2, "v")], kind), path)
    assert sorted(r["line"] for r in spark.read.parquet(path).collect()) == ["u", "v", "z"]


def test_numbering_writes_once_and_drops_what_only_orders(spark):
    """The numbers come from the partitions' counts when the table is read: it is not written a second time with them."""
    folder = spark.conf.get("spark.checkpoint.dir")
    before = set(os.listdir(folder))
    rows = numbered(spark.range(1000).select((F.col("id") * 7919 % 1009).alias("x"), "id"), ["x"], parts=9, drop=("x",))
    assert rows.columns == ["id", "seq"]
    assert [r["id"] for r in rows.orderBy("seq").collect()] == sorted(range(1000), key=lambda i: i * 7919 % 1009)
    assert sorted(r["seq"] for r in rows.collect()) == list(range(1, 1001))
    assert len(set(os.listdir(folder)) - before) == 1
    before = set(os.listdir(folder))
    Views(spark, SF.replace("sf0.001", "sf0.001/")).lines
    assert len(set(os.listdir(folder)) - before) == 1


def test_file_names_are_read_once_each(spark):
    """A range of floors is told by a file's name, once for each name and not for each row that files come from."""
    folder = spark.conf.get("spark.checkpoint.dir")
    rooms = spark.createDataFrame([("t", "j", i, "s", "L1", i, i) for i in range(4)], "tenant_id string, job_id string, seq long, sheet_id string, level string, coord_x long, coord_y long")
    sheets_of = spark.createDataFrame([("t", "j", "s", "f")], "tenant_id string, job_id string, sheet_id string, file_id string")
    files = spark.createDataFrame([("t", "j", "f", "set-LEVELS-03-04.pdf"), ("t", "k", "g", "set-LEVELS-03-04.pdf"), ("t", "k", "h", "plans.pdf")], "tenant_id string, job_id string, file_id string, filename string")
    before = set(os.listdir(folder))
    out = sheets.replicate_floors(rooms, sheets_of, files).collect()
    assert sorted((r["seq"], r["level"], r["coord_x"]) for r in out) == sorted((i, f"LEVEL {n}", i if n == 3 else None) for i in range(4) for n in (3, 4))
    (new,) = set(os.listdir(folder)) - before
    assert spark.read.parquet(f"{folder}/{new}").count() == 2
