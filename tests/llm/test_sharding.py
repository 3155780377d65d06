from pyspark.sql import functions as F

from wayfind.llm import sharding

SCHEMA = "doc_id long, text string, lang string, source string, rank long, total long"


def test_curve_steps_to_neighbours(spark):
    bits = 3
    side = 1 << bits
    cells = spark.range(side**3).select((F.col("id") % side).cast("int").alias("x"), ((F.col("id") / side).cast("int") % side).cast("int").alias("y"), (F.col("id") / side**2).cast("int").alias("z"))
    rows = cells.withColumn("h", sharding.hilbert_index([F.col("x"), F.col("y"), F.col("z")], bits)).orderBy("h").collect()
    assert [r["h"] for r in rows] == list(range(side**3))
    assert all(abs(a["x"] - b["x"]) + abs(a["y"] - b["y"]) + abs(a["z"] - b["z"]) == 1 for a, b in zip(rows, rows[1:]))


def test_equal_counts_and_gapless_slots(spark):
    # a third of all rows is one text; columns clash with the operator's own
    rows = [(i, None if i % 17 == 0 else "" if i % 13 == 0 else "copy" if i % 3 == 0 else f"text {i} " * (i % 50), None if i % 11 == 0 else "en", "s", 5, 6) for i in range(1003)]
    out = sharding.shard_documents(spark.createDataFrame([*rows, rows[0]], SCHEMA)).collect()
    assert sorted(r["doc_id"] for r in out) == sorted([*range(1003), 0])
    by = {}
    for r in out:
        by.setdefault(r["shard"], []).append(r["slot"])
    assert sorted(by) == list(range(16))
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert all(sorted(x) == list(range(len(x))) for x in by.values())


def test_few_rows_and_none(spark):
    assert sharding.shard_documents(spark.createDataFrame([], SCHEMA)).count() == 0
    out = sharding.shard_documents(spark.createDataFrame([(i, "a", "en", "s", 0, 0) for i in range(3)], SCHEMA)).collect()
    assert sorted(r["slot"] for r in out) == [0, 0, 0]


def test_slots_against_a_plain_sort(spark):
    rows = [(i * 7 % 211, f"text {i} " * (i % 9), f"l{i % 3}", f"s{i % 5}", 0, 0) for i in range(211)]
    out = sharding.shard_documents(spark.createDataFrame(rows, SCHEMA)).collect()
    order = sorted(out, key=lambda r: (r["curve"], r["text_crc32"], r["doc_id"]))
    for i, r in enumerate(order):
        shard = i * 16 // len(order)
        assert (r["shard"], r["slot"]) == (shard, i - -(-shard * len(order) // 16))


def test_cells_follow_the_order_of_texts(spark):
    names = ["http://a.com", "http://ab.com", "http://b.com", "http://z.com/x", "http://é.com"]
    df = spark.createDataFrame([(n,) for n in names * 20] + [(None,)], "source string")
    cells = {r[0]: r[1] for r in df.select("source", sharding.quantised_text(df, "source")).distinct().collect()}
    known = [cells[n] for n in sorted(names, key=str.encode)]
    assert known == sorted(set(known)) and cells[None] == 0


def plain_cells(values, bits):
    """Bounds from a loop over the sorted values with their counts."""
    known, total, upto, bounds = sorted(v.encode() for v in values if v is not None), sum(v is not None for v in values), 0, []
    for v in sorted(set(known)):
        before, upto = upto, upto + known.count(v)
        if upto * (1 << bits) // total > before * (1 << bits) // total:
            bounds.append((v, min(upto * (1 << bits) // total, (1 << bits) - 1)))
    return {v: 0 if v is None else max([c for b, c in bounds if b <= v.encode()], default=0) for v in values}


def test_cells_of_texts_against_a_plain_loop(spark):
    start = "https://one.host.example/a/long/common/path/"
    several = {
        "long common beginnings": [f"{start}{i % 37:03d}" for i in range(500)] + ["a", "é", "\U0001f600", "", None, None],
        "one holds a third": ["hot"] * 200 + [f"s{i}" for i in range(400)],
        "one value": ["x"] * 9,
        "only nulls": [None] * 3,
    }
    for case, values in several.items():
        df = spark.createDataFrame([(v,) for v in values], "source string")
        for bits in (3, 6):
            found = {r[0]: r[1] for r in df.select("source", sharding.quantised_text(df, "source", bits)).distinct().collect()}
            assert found == plain_cells(values, bits), (case, bits)
    # of the 37 addresses that begin alike, every one has a cell of its own
    urls = [v for v in several["long common beginnings"] if v and v.startswith(start)]
    assert len(set(plain_cells(urls, 6).values())) == 37


def test_written_files_prune(spark, tmp_path):
    """Statistics of the files written in curve order exclude most files for a value of each column."""
    rows = [(i, "x" * (1 + i * 31 % 97 * 40), f"l{i * 13 % 4}", f"s{i * 17 % 20:02d}", 0, 0) for i in range(4000)]
    out = sharding.shard_documents(spark.createDataFrame(rows, SCHEMA))
    sharding.write_shards(out, str(tmp_path / "shards"))
    found = sharding.extents(spark.read.parquet(str(tmp_path / "shards")), ["lang", "source", "size"]).collect()
    assert len(found) == 16
    for column, value in (("lang", "l2"), ("source", "s07"), ("size", 1601)):
        assert sum(r[f"min_{column}"] <= value <= r[f"max_{column}"] for r in found) <= 12, column


def test_shards_are_compact(spark):
    rows = [(i, "x" * (1 + i % 97 * 40), f"l{i % 4}", f"s{i % 20}", 0, 0) for i in range(4000)]
    out = sharding.shard_documents(spark.createDataFrame(rows, SCHEMA))
    spread = sharding.extents(out, ["cell_size"]).select(F.avg(F.col("max_cell_size") - F.col("min_cell_size")).alias("w"), F.max("max_cell_size").alias("m")).first()
    assert spread["w"] < 0.8 * spread["m"]
