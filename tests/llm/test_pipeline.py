import pyarrow as pa
import pyarrow.parquet as pq

import corpus_pipeline
from tests.llm.test_decontaminate import brute as contained
from tests.llm.test_jaccard_join import brute as components
from wayfind.llm import pii
from wayfind.llm.common import kept

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r["doc_id"]: r for r in docs.collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    (_, one), (_, two), (_, three), (_, four), (_, five) = corpus_pipeline.STAGES

    good = kept(one(spark, docs, SF), "t1")
    ids = {r["doc_id"] for r in good.select("doc_id").collect()}
    known = [i for i in labels if i in rows]
    assert sum((i in ids) == bool(labels[i]) for i in known) >= 0.97 * len(known)
    assert good.columns == docs.columns

    single = kept(two(spark, good, SF), "t2")
    want = components([(i, rows[i]["text"]) for i in ids])
    left = {r["doc_id"] for r in single.collect()}
    assert left == {i for i in ids if want[i][1] == i}

    clean = kept(three(spark, single, SF), "t3")
    bad = {d for d, _ in contained([(i, rows[i]["text"]) for i in left], items)}
    assert {r["doc_id"] for r in clean.collect()} == left - bad

    masked = kept(four(spark, clean, SF), "t4")
    for r in masked.collect():
        assert not any(x[3] for x in pii.spans_of(r["text"]))
        before = rows[r["doc_id"]]["text"]
        assert r["text"] == before or pii.spans_of(before)
        assert (r["lang"], r["source"], r["n_chars"]) == (rows[r["doc_id"]]["lang"], rows[r["doc_id"]]["source"], rows[r["doc_id"]]["n_chars"])
    assert masked.count() == clean.count()

    pieces = five(spark, masked, SF).collect()
    assert {p["doc_id"] for p in pieces} == left - bad
    assert len({(p["doc_id"], p["start"]) for p in pieces}) == len(pieces)
    assert sum(p["length"] for p in pieces) == sum({p["doc_id"]: p["doc_tokens"] for p in pieces}.values())


def test_odd_rows(spark, tmp_path):
    """Nulls everywhere, repeated rows, extra columns with the operators' own names."""
    text = "A line of plain words that goes on for a while and then stops. "
    rows = [(1, text * 4, "en", "s", 1, "x"), (1, text * 4, "en", "s", 1, "x"), (2, None, None, None, None, None), (3, "", "en", "s", 0, ""), (None, text * 5, "en", "s", 1, "y"), (4, text * 4, "fr", "s", 1, "z"), (5, "write to a.b@c.org now " + text, "en", "t", 1, "w")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, component_id string"
    for name, kinds in (("labels", [("doc_id", pa.int64()), ("quality", pa.int32()), ("toxic", pa.int32())]), ("benchmark", [("item_id", pa.int64()), ("text", pa.string())])):
        pq.write_table(pa.schema(kinds).empty_table(), tmp_path / f"{name}.parquet")
    for source in (rows, []):
        docs = spark.createDataFrame(source, schema)
        for name, stage in corpus_pipeline.STAGES:
            docs = kept(stage(spark, docs, str(tmp_path)), f"odd-{name}")
            if name == "near_copies" and source:
                assert sorted((r["doc_id"] for r in docs.collect()), key=str) == [1, 5, None]
        assert (docs.count() > 0) == bool(source)


def test_null_ids_beside_a_repeated_id_all_stay(spark):
    text = "Plain words that go on for a while and then stop at last number "
    docs = spark.createDataFrame([(1, text + "one"), (1, text + "one"), (None, "quite another text"), (None, "and a third one"), (None, None)], "doc_id long, text string")
    left = corpus_pipeline.one_of_each(spark, docs, "").collect()
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in left) == [(0, ""), (0, "and a third one"), (0, "quite another text"), (1, text + "one")]


def test_columns_of_any_name_pass(spark, tmp_path):
    text = "Plain words that go on for a while and then stop at last, number "
    schema = "doc_id long, text string, lang string, source string, quality_posterior double, _key string, _group string, _prior int, `a.b` string, id long, spans string, count int"
    rows = [(i, text + str(i) * 30, "en", "s", 0.123, "k", "g", 1, "dot", 5, "x", 2) for i in range(3)] + [(None, text + x, None, None, None, None, None, None, None, None, None, None) for x in ("one", "two two", "three")]
    for name, kinds in (("labels", [("doc_id", pa.int64()), ("quality", pa.int32()), ("toxic", pa.int32())]), ("benchmark", [("item_id", pa.int64()), ("text", pa.string())])):
        pq.write_table(pa.schema(kinds).empty_table(), tmp_path / f"{name}.parquet")
    docs = spark.createDataFrame(rows, schema)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = kept(stage(spark, docs, str(tmp_path)), f"names-{name}")
        assert docs.columns == spark.createDataFrame([], schema).columns
    left = [tuple(r) for r in docs.collect()]
    # the three with an id are near copies of each other; of those without one nothing is dropped
    assert sorted(left, key=str) == sorted([r for r in rows if r[0] in (0, None)], key=str)


def test_two_texts_under_one_id_both_stay(spark):
    rows = [(1, "quite one text", "a"), (1, "and another text", "b"), (1, "quite one text", "c"), (2, "and another text", "d"), (3, "a third text", "e"), (None, "quite one text", "f")]
    left = corpus_pipeline.one_of_each(spark, spark.createDataFrame(rows, "doc_id long, text string, extra string"), "").collect()
    assert sorted((r["doc_id"] or 0, r["text"]) for r in left) == [(0, "quite one text"), (1, "and another text"), (1, "quite one text"), (3, "a third text")]


def test_of_repeated_rows_the_least_stays(spark):
    """Whatever the order and number of rows; also with nulls, lists and maps in other columns."""
    schema = "doc_id long, text string, source string, n_chars long, tags array<string>, more map<string,int>, `a.b` string"
    text = "some words under one id"
    rows = [(1, text, "t", 1, ["x"], {"k": 1}, "d"), (1, text, "s", 2, None, None, "d"), (1, text, "s", 1, ["y"], {"k": 2}, "c"), (1, text, "s", 1, ["y"], {"k": 2}, "c"), (2, None, "s", 2, None, None, None), (2, None, "r", 1, None, None, None)]
    for order in (rows, rows[::-1], rows[3:] + rows[:3]):
        left = corpus_pipeline.one_of_each(spark, spark.createDataFrame(order, schema).repartition(3, "n_chars"), "").collect()
        assert sorted(map(tuple, left), key=lambda r: r[0]) == [rows[2], (2, None, "r", 1, None, None, None)]
    bare = [(1, text), (1, text), (2, "other words here")]
    assert corpus_pipeline.one_of_each(spark, spark.createDataFrame(bare, "doc_id long, text string"), "").count() == 2
