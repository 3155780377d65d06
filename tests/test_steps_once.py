"""What depends on a kind of room, a name or a sheet is told once for each, and rooms are read a single time for it."""

from wayfind import catalog
from wayfind.operators import sheets
from wayfind.plans import imports
from wayfind.sources.views import Views

SF = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def _reads_of_lines(df):
    return sum("Relation" in line and "l_partkey" in line for line in _plan(df).splitlines())


def test_assembly_reads_prepared_rooms(spark):
    assert _reads_of_lines(catalog.queries()["e23_assembly"](spark, SF)) == 0


def test_index_reads_rooms_for_its_files_only(spark):
    assert _reads_of_lines(catalog.queries()["a12_drawing_index"](spark, SF)) == 1


def test_index_pages_read_rooms_for_their_files_only(spark):
    assert _reads_of_lines(imports.QUERIES["a12_index_pages"][0](spark, SF)) == 1


def test_checks_sign_kinds_of_rooms(spark, monkeypatch):
    given = []
    signed = sheets.signed_rooms
    monkeypatch.setattr(sheets, "signed_rooms", lambda rooms, every_room=False: given.append(rooms.count()) or signed(rooms, every_room))
    catalog.queries()["d19_details"](spark, SF)
    assert 2 * given[0] < Views(spark, SF).rooms.count()


def test_sheets_tell_their_columns_once(spark):
    assert "explode(_columns#" in _plan(catalog.queries()["a1_a5_takeoff_rows"](spark, SF))


def test_payload_names_are_judged_once(spark):
    plan = _plan(catalog.queries()["b29_payload_rooms"](spark, SF))
    assert any("Relation" in line and "_junk" in line for line in plan.splitlines())


def test_payloads_without_items_leave_no_row(spark):
    rows = [("t", "j", "s", 1, '[{"roomNumber": "1", "roomName": "OFFICE"}, null]'), ("t", "j", "s", 2, "[]"), ("t", "j", "s", 3, None), ("t", "j", "s", 4, "no json"), ("t", "j", "s", 5, '[{"room_number": "1", "room_name": "office"}]')]
    out = sheets.rooms_from_payload(spark.createDataFrame(rows, "tenant_id string, job_id string, sheet_id string, seq long, payload string"))
    assert [(r["seq"], r["item"], r["room_name"]) for r in out.collect()] == [(1, 0, "OFFICE")]
