"""Rooms, jobs, signs and the rest, derived from the order tables.

The tables at hand have no rooms or signs; these views are deterministic functions of them. ``SQL`` states them
for the SQL twins of the queries; ``Views`` builds the same in Spark, where the running number comes from a
range partitioning instead of a window over the whole table. The numbered lines are written once a session and
folder, in job order, and all queries read that table, as long as the folder's files are the same.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfind.sources.kept import numbered, place_of, read_from, stamp

ROOM_NAMES = ["OFFICE", "CORR", "MEN'S TOILET", "WOMEN'S TOILET", "STAIR A", "ELEV LOBBY", "CONFERENCE", "MECH ROOM", "JANITOR", "LOBBY", "ENTRY VESTIBULE", "TRAINING / COMMUNITY", "UNIT 101", "106A", "STORAGE", "FINISH SCHEDULE", "60X21 CASEWORK", "GYMNASIUM", "CLASSROOM", "APPARATUS BAY", "UNISEX RR", "SUITE 200", "JANITOR STAIR", "GIRLS PASSAGE", "EXAM ROOM", "RECEPTION"]
SIGN_TYPES = ["Room ID", "Restroom", "Exit", "Stair(Corridor)", "Elevator", "Evacuation Map", "Max Occupancy"]
ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice", "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]
TYPES = ["commercial", "education", "residential", "government", "hospital", "unknown"]


def _values(names: list[str]) -> str:
    quoted = [(i, n.replace("'", "''")) for i, n in enumerate(names)]
    return ", ".join(f"({i}, '{n}')" for i, n in quoted)


SQL = f"""
vocab AS (SELECT * FROM (VALUES {_values(ROOM_NAMES)}) AS v(idx, room_name)),
signvocab AS (SELECT * FROM (VALUES {_values(SIGN_TYPES)}) AS s(idx, sign_type)),
li AS (SELECT CAST(row_number() OVER (ORDER BY {", ".join(ORDER)}) AS BIGINT) AS seq, CAST(floor(l_orderkey / 50) AS BIGINT) AS job,
  CAST(l_linenumber % 4 AS BIGINT) AS fl, CAST(l_partkey % 60 AS BIGINT) AS num, lineitem.* FROM lineitem),
rooms AS (SELECT li.seq, concat('t', job % 7) AS tenant_id, concat('j', job) AS job_id, concat('s', job, '-', fl) AS sheet_id,
  CASE l_suppkey % 10 WHEN 0 THEN '' WHEN 1 THEN concat('W', 100 * (fl + 1) + num) WHEN 2 THEN concat(100 * (fl + 1) + num, 'A') ELSE concat('', 100 * (fl + 1) + num) END AS room_number,
  v.room_name,
  CASE l_partkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 'First Floor' WHEN 2 THEN concat('L', fl + 1) WHEN 3 THEN 'BASEMENT' ELSE concat('LEVEL ', fl + 1) END AS level,
  CAST(floor(l_extendedprice) AS BIGINT) % 98000 + 1000 AS coord_x, CAST(floor(l_extendedprice * 7) AS BIGINT) % 98000 + 1000 AS coord_y,
  CASE WHEN l_tax > 0.04 THEN CAST(floor(l_quantity) AS INT) * 4 END AS occupant_load,
  round(1 - l_discount * 5, 3) AS confidence,
  CASE l_linestatus WHEN 'O' THEN 'ai_vision' ELSE 'pdf' END AS source,
  CASE l_returnflag WHEN 'R' THEN 'dismissed' WHEN 'A' THEN 'confirmed' ELSE 'pending' END AS review_status
  FROM li JOIN vocab v ON v.idx = (l_partkey * 7 + l_linenumber) % 26),
jobs AS (SELECT concat('t', job % 7) AS tenant_id, concat('j', job) AS job_id,
  CASE job % 6 WHEN 0 THEN 'commercial' WHEN 1 THEN 'education' WHEN 2 THEN 'residential' WHEN 3 THEN 'government' WHEN 4 THEN 'hospital' ELSE 'unknown' END AS building_type,
  CASE max(o_orderstatus) WHEN 'P' THEN 'processing' WHEN 'O' THEN 'pending' ELSE 'completed' END AS status,
  min(o_orderdate) AS created_at, max(o_orderdate) AS updated_at
  FROM (SELECT CAST(floor(o_orderkey / 50) AS BIGINT) AS job, orders.* FROM orders) o GROUP BY job),
signs AS (SELECT r.seq, r.tenant_id, r.job_id, CASE WHEN li.l_suppkey % 9 = 0 THEN NULL ELSE r.seq END AS room_seq, s.sign_type,
  CAST(floor(li.l_quantity) AS INT) % 3 + 1 AS qty, r.confidence,
  CASE li.l_suppkey % 4 WHEN 0 THEN 'exterior' WHEN 1 THEN 'schedule' ELSE 'rules_engine' END AS source,
  li.l_tax > 0.07 AS is_deleted, r.level AS floor_label, r.room_number, r.room_name, r.review_status
  FROM li JOIN rooms r ON r.seq = li.seq JOIN signvocab s ON s.idx = li.l_partkey % 7),
corrections AS (SELECT event_id AS seq, concat('t', user_id % 7) AS tenant_id, concat('j', user_id) AS job_id,
  CASE event_type WHEN 'click' THEN 'edit' WHEN 'view' THEN 'ai_missed' WHEN 'error' THEN 'ai_extra' ELSE 'sign_type_override' END AS correction_type,
  v.room_name AS room_name_pattern, s.sign_type, ts AS created_at, event_id % 4 <> 0 AS is_active
  FROM events JOIN vocab v ON v.idx = event_id % 26 JOIN signvocab s ON s.idx = event_id % 7),
ai_scans AS (SELECT event_id AS seq, concat('t', user_id % 7) AS tenant_id, concat('j', user_id) AS job_id, event_type AS call_type,
  CAST(floor(value * 1000) AS BIGINT) AS input_tokens, CAST(floor(value * 100) AS BIGINT) AS output_tokens, ts AS created_at FROM events),
takeoff AS (SELECT seq, tenant_id, job_id, room_number, room_name, level, confidence FROM rooms WHERE seq % 3 <> 0
  UNION ALL SELECT seq, tenant_id, job_id, concat('9', room_number) AS room_number, room_name, level, confidence FROM rooms WHERE seq % 11 = 0),
schedule AS (SELECT r.seq, r.tenant_id, r.job_id, r.sheet_id, CASE WHEN r.seq % 5 = 1 THEN concat(' ', lower(r.room_number)) ELSE r.room_number END AS room_number,
  CASE WHEN r.seq % 5 = 2 THEN lower(r.room_name) ELSE r.room_name END AS room_name, s.sign_type,
  CASE WHEN r.seq % 3 = 0 THEN NULL ELSE 'A' END AS type_mark, r.level AS floor, CAST(r.seq % 4 + 1 AS INT) AS quantity
  FROM rooms r JOIN signvocab s ON s.idx = r.seq % 7 WHERE r.seq % 2 = 0)
"""


#: Lines a partition of their sort has at most, about: so it fits a task's memory, whatever the session's setting.
ROWS_A_PART = 500_000
_lines: dict[tuple, DataFrame] = {}


def _word(names: list[str], index) -> F.Column:
    return F.get(F.array(*map(F.lit, names)), index.cast("int"))


class Views:
    """The derived tables over the Parquet files of one folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def lines(self) -> DataFrame:
        key = (self.spark.sparkContext.applicationId, self.sf_dir, stamp(self.spark, f"{self.sf_dir}/lineitem.parquet"))
        if key in _lines and not stamp(self.spark, place_of(_lines[key])):
            del _lines[key]  # its folder was cleaned
        if key not in _lines:
            d = self.table("lineitem").select(*ORDER)
            # files tell their rows, so this reads no data
            lines = numbered(d, ORDER, parts=d.count() // ROWS_A_PART, drop=("l_shipdate",))
            _lines[key] = read_from(lines, lines.withColumns({"job": F.floor(F.col("l_orderkey") / 50), "fl": F.col("l_linenumber").cast("long") % 4, "num": F.col("l_partkey").cast("long") % 60}))
        return _lines[key]

    def _room_columns(self) -> dict:
        whole = (100 * (F.col("fl") + 1) + F.col("num")).cast("string")
        digit, part = F.col("l_suppkey") % 10, F.col("l_partkey") % 5
        floor = (F.col("fl") + 1).cast("string")
        return {
            "tenant_id": F.concat(F.lit("t"), (F.col("job") % 7).cast("string")),
            "job_id": F.concat(F.lit("j"), F.col("job").cast("string")),
            "sheet_id": F.concat(F.lit("s"), F.col("job").cast("string"), F.lit("-"), F.col("fl").cast("string")),
            "room_number": F.when(digit == 0, "").when(digit == 1, F.concat(F.lit("W"), whole)).when(digit == 2, F.concat(whole, F.lit("A"))).otherwise(whole),
            "room_name": _word(ROOM_NAMES, (F.col("l_partkey").cast("long") * 7 + F.col("l_linenumber")) % 26),
            "level": F.when(part == 0, F.lit(None)).when(part == 1, "First Floor").when(part == 2, F.concat(F.lit("L"), floor)).when(part == 3, "BASEMENT").otherwise(F.concat(F.lit("LEVEL "), floor)),
            "coord_x": F.floor("l_extendedprice") % 98000 + 1000,
            "coord_y": F.floor(F.col("l_extendedprice") * 7) % 98000 + 1000,
            "occupant_load": F.when(F.col("l_tax") > 0.04, F.floor("l_quantity").cast("int") * 4),
            "confidence": F.round(1 - F.col("l_discount") * 5, 3),
            "source": F.when(F.col("l_linestatus") == "O", "ai_vision").otherwise("pdf"),
            "review_status": F.when(F.col("l_returnflag") == "R", "dismissed").when(F.col("l_returnflag") == "A", "confirmed").otherwise("pending"),
        }

    @cached_property
    def rooms(self) -> DataFrame:
        return self.lines.select("seq", *(c.alias(n) for n, c in self._room_columns().items()))

    @cached_property
    def jobs(self) -> DataFrame:
        job = F.floor(F.col("o_orderkey") / 50)
        d = self.table("orders").groupBy(job.alias("job")).agg(F.max("o_orderstatus").alias("s"), F.min("o_orderdate").alias("created_at"), F.max("o_orderdate").alias("updated_at"))
        return d.select(
            F.concat(F.lit("t"), (F.col("job") % 7).cast("string")).alias("tenant_id"),
            F.concat(F.lit("j"), F.col("job").cast("string")).alias("job_id"),
            _word(TYPES, F.col("job") % 6).alias("building_type"),
            F.when(F.col("s") == "P", "processing").when(F.col("s") == "O", "pending").otherwise("completed").alias("status"),
            "created_at",
            "updated_at",
        )

    @cached_property
    def signs(self) -> DataFrame:
        r, supp = self._room_columns(), F.col("l_suppkey")
        return self.lines.select(
            "seq",
            r["tenant_id"].alias("tenant_id"),
            r["job_id"].alias("job_id"),
            F.when(supp % 9 != 0, F.col("seq")).alias("room_seq"),
            _word(SIGN_TYPES, F.col("l_partkey") % 7).alias("sign_type"),
            (F.floor("l_quantity").cast("int") % 3 + 1).alias("qty"),
            r["confidence"].alias("confidence"),
            F.when(supp % 4 == 0, "exterior").when(supp % 4 == 1, "schedule").otherwise("rules_engine").alias("source"),
            (F.col("l_tax") > 0.07).alias("is_deleted"),
            r["level"].alias("floor_label"),
            *(r[c].alias(c) for c in ("room_number", "room_name", "review_status")),
        )

    @cached_property
    def corrections(self) -> DataFrame:
        kind, event = F.col("event_type"), F.col("event_id")
        return self.table("events").select(
            event.alias("seq"),
            F.concat(F.lit("t"), (F.col("user_id") % 7).cast("string")).alias("tenant_id"),
            F.concat(F.lit("j"), F.col("user_id").cast("string")).alias("job_id"),
            F.when(kind == "click", "edit").when(kind == "view", "ai_missed").when(kind == "error", "ai_extra").otherwise("sign_type_override").alias("correction_type"),
            _word(ROOM_NAMES, event % 26).alias("room_name_pattern"),
            _word(SIGN_TYPES, event % 7).alias("sign_type"),
            F.col("ts").alias("created_at"),
            (event % 4 != 0).alias("is_active"),
        )

    @cached_property
    def ai_scans(self) -> DataFrame:
        return self.table("events").select(
            F.col("event_id").alias("seq"),
            F.concat(F.lit("t"), (F.col("user_id") % 7).cast("string")).alias("tenant_id"),
            F.concat(F.lit("j"), F.col("user_id").cast("string")).alias("job_id"),
            F.col("event_type").alias("call_type"),
            F.floor(F.col("value") * 1000).alias("input_tokens"),
            F.floor(F.col("value") * 100).alias("output_tokens"),
            F.col("ts").alias("created_at"),
        )

    @cached_property
    def takeoff(self) -> DataFrame:
        names = ["seq", "tenant_id", "job_id", "room_number", "room_name", "level", "confidence"]
        both = self.rooms.select(*names)
        return both.filter("seq % 3 <> 0").unionByName(both.filter("seq % 11 = 0").withColumn("room_number", F.concat(F.lit("9"), "room_number")))

    @cached_property
    def schedule(self) -> DataFrame:
        seq = F.col("seq")
        return self.rooms.filter("seq % 2 = 0").select(
            "seq",
            "tenant_id",
            "job_id",
            "sheet_id",
            F.when(seq % 5 == 1, F.concat(F.lit(" "), F.lower("room_number"))).otherwise(F.col("room_number")).alias("room_number"),
            F.when(seq % 5 == 2, F.lower("room_name")).otherwise(F.col("room_name")).alias("room_name"),
            _word(SIGN_TYPES, seq % 7).alias("sign_type"),
            F.when(seq % 3 != 0, "A").alias("type_mark"),
            F.col("level").alias("floor"),
            (seq % 4 + 1).cast("int").alias("quantity"),
        )
