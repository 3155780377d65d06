"""Words near numbers and tags against plain loops over random pages."""

import random
import re

import pyarrow as pa
import pytest

from wayfind import vocab
from wayfind.operators import layout, pages
from wayfind.operators.layout import PAGE

WORDS = "tenant_id string, job_id string, sheet_id string, text string, x0 double, y0 double, x1 double, y1 double, page_width double, page_height double"
TAGS = "tenant_id string, job_id string, sheet_id string, tag string, x double, y double, page_width double, page_height double"
TEXTS = ["1101", "102", "1101", "Office", "OFFICE", "LOBBY", "toilet", "MB", "19A", "12", "2024", "THE", "", None, " EXAM ", "CONF", "TYP"]


def made(seed):
    """Words and tags of some pages, with repeated rows, nulls, and pages without an id."""
    r = random.Random(seed)
    places = [float(v) for v in range(0, 300, 20)] + [-0.0, 0.0, float("nan"), None, 39.9, 850.0]
    words, tags = [], []
    for ids in [("t", "j", "s1"), ("t", "j", "s2"), ("t", "k", "s1"), ("t", "j", None), (None, "j", "s1")]:
        for _ in range(r.randrange(40)):
            x, y = r.choice(places), r.choice(places)
            far = [None if v is None else v + d for v, d in ((x, 20.0), (y, 8.0))]
            words += [(*ids, r.choice(TEXTS), x, y, *far, 1000.0, 800.0)] * r.choice([1, 1, 1, 2])
        for _ in range(r.randrange(12)):
            tags.append((*ids, r.choice(["1101", "102", "OFFICE", "EXAM", None]), r.choice(places), r.choice(places), 1000.0, r.choice([800.0, 800.0, None])))
    return words, tags


def least(v):
    """Nulls first, NaN last."""
    return (v is not None, v is not None and v != v, v if v is not None and v == v else 0.0)


def same(a, b):
    return None not in a[:3] and a[:3] == b[:3]


def may(word):
    up = word.upper()
    return not (re.search(r"^[A-Z]$|^\d+\.\d+$|^\d{1,2}$", up) or re.search(r"^\d+['\"\-/]", word) or up in vocab.IGNORED_WORDS or len(word) > 30)


def whole(words):
    return {tuple(0.0 if v == 0 else "nan" if v != v else v for v in w): w for w in words if w[3] and None not in w[4:8]}.values()


def named(found):
    return " ".join(w for *_, w in sorted(found)[:5])


def plain_numbers(words):
    words = whole(words)
    for n in words:
        if not re.search(vocab.ROOM_NUMBER, n[3]) or re.search(vocab.YEAR, n[3]) or not (n[4] <= 780 and n[5] <= 704):
            continue
        near = []
        for w in words:
            dx, dy = abs(n[4] - w[4]), abs(n[5] - w[5])
            high = 80 if re.search(vocab.RESTROOM_LABEL, w[3].upper()) else 40
            name = not re.search(vocab.ROOM_NUMBER, w[3]) and not re.search(vocab.YEAR, w[3]) and may(w[3]) and w[3].upper() not in vocab.IGNORED_UNITS
            if same(n, w) and name and (dx < 80 and dy < high or dy < 15 and dx < 200):
                near.append((w[4], w[5], w[3].upper()))
        yield (*n[:4], named(near))


def plain_tags(tags, words):
    words = [(*w[:3], w[3].strip(" ").upper(), (w[4] + w[6]) / 2, (w[5] + w[7]) / 2) for w in whole(words)]
    words = [w for w in words if w[4] <= 800 and w[5] <= 720]
    close = lambda a, b, x, y: same(a, b) and abs(a[4] - b[4]) < x and abs(a[5] - b[5]) < y
    code = [bool(re.search(vocab.LEGEND_CODE, w[3])) for w in words]
    around = [[c for o, c in zip(words, code) if close(w, o, 120, 40)] for w in words]
    clean = [w for w, a in zip(words, around) if may(w[3]) and not (len(a) >= 3 and sum(a) / len(a) > 0.3)]
    for key in {t[:4] for t in tags}:
        t = min((t for t in tags if t[:4] == key), key=lambda t: [least(t[i]) for i in (5, 4, 6, 7)])
        if None in t[4:] or not (t[4] <= 800 and t[5] <= 720):
            continue
        near = [(w[4], w[5], w[3]) for w in clean if t[3] is not None and w[3] != t[3] and (close(t, w, 80, 40) or close(t, w, 200, 15))]
        own = None if t[3] is None else ("UNIT " if re.search(vocab.NUMBER_OF_UNIT, t[3]) else "ROOM ") + t[3]
        yield (*t[:4], named(near) if near else own, t[4] + 0.0, t[5] + 0.0)


def ordered(rows):
    return sorted(map(tuple, rows), key=str)


@pytest.mark.parametrize("seed", range(6))
def test_numbers_take_the_words_near_them(spark, seed):
    words, _ = made(seed)
    got = layout._placed(spark.createDataFrame(words, WORDS).repartition(3)).select(*PAGE, "room_number", "room_name").collect()
    assert ordered(got) == ordered(plain_numbers(words))


@pytest.mark.parametrize("seed", range(6))
def test_tags_take_the_words_near_them(spark, seed):
    words, tags = made(seed)
    got = layout.tag_rooms(spark.createDataFrame(tags, TAGS), spark.createDataFrame(words, WORDS).repartition(3)).collect()
    assert ordered(got) == ordered(plain_tags(tags, words))


def test_words_are_sent_once(spark):
    """Not once for each step that looks at them; tags come with them."""
    words, tags = made(1)
    words, tags = spark.createDataFrame(words, WORDS), spark.createDataFrame(tags, TAGS)
    for found in (layout.proximity_rooms(words), layout.tag_rooms(tags, words)):
        assert found._jdf.queryExecution().executedPlan().toString().count("Exchange ") == 1


def test_parts_grow_with_the_input(spark, tmp_path, monkeypatch):
    words = spark.createDataFrame(made(1)[0], WORDS)
    words.write.parquet(str(tmp_path / "words"))
    monkeypatch.setattr(layout, "BYTES_A_PART", 100)
    assert layout.dealt(spark.read.parquet(str(tmp_path / "words"))).rdd.getNumPartitions() > 20


def test_pages_are_not_parted(monkeypatch):
    monkeypatch.setattr(pages, "ROWS_AT_ONCE", 4)
    keys = [1, 1, 1, 2, 2, 3, 3, 3, 3, 3, 3, 3, 3, 3, 4]
    batches = pa.table({pages.KEY: keys}).to_batches(max_chunksize=2)
    tables = [t.column(pages.KEY).to_pylist() for t in pages._whole_pages(batches)]
    assert sum(tables, []) == keys and len(tables) > 1
    assert all(a[-1] != b[0] for a, b in zip(tables, tables[1:]))


def test_pairs_are_bounded(spark, monkeypatch):
    words, tags = made(3)
    told = [dict(zip(("tenant_id", "job_id", "sheet_id", "text", "x0", "y0", "x1", "y1", "page_width", "page_height"), w)) for w in words if w[3] and None not in w[:8]]
    table = pa.Table.from_pylist([w | {"_page": hash(w["sheet_id"] + w["job_id"]), "kind": 0 if re.search(vocab.ROOM_NUMBER, w["text"]) else 1, "word": w["text"].upper()} for w in told]).sort_by("_page")
    out = []
    for most in (1 << 20, 3):
        monkeypatch.setattr(pages, "PAIRS_AT_ONCE", most)
        out.append([r for b in pages.numbers_with_words(table.to_batches()) for r in b.to_pylist()])
    assert str(out[0]) == str(out[1]) and any(r["found"] for r in out[0])


def told(spark, names):
    """(name as found, final name or None) as found for each room."""
    rooms = spark.createDataFrame([("t", "j", "s", "1101", n, 1, 1) for n in names], layout.OUT)
    rows = rooms.select(*rooms.columns, rooms.room_name.alias("raw"))
    return {r["raw"]: r["room_name"] for r in layout._named(rows, layout._in_place).select("raw", "room_name").collect()}


def test_sure_names_are_names(spark):
    r = random.Random(5)
    parts = ["OFFICE", "RR", "CORR", "MRR", "19A", "60X21", "MB", "7", "A", "TO", "EAST", "FINISH", "SCHEDULE", "FLOOR", "BASE", "MAIN ST", "DRAWING", "C4", "WD1", "IT", "12'-4", "NOTE:", "DEMOLISH", "LOBBY", "É", "CAF", "ERIA", " X", "A  B", "UNIT", "101", "FIELD MEASURE", "X" * 25, "S-1.2.3", "SCALE", "FEET", "", "GWB", ",", "GYMNASIUM"]
    names = [[r.choice(parts) for _ in range(r.randrange(1, 6))] for _ in range(1500)] + [[p] for p in parts]
    words, index = pa.array(sorted(set(parts))), {w: i for i, w in enumerate(sorted(set(parts)))}
    raw = [" ".join(n) for n in names]
    import numpy as np

    sure = pages.sure_names(pa.array(raw), words, np.array([index[w] for n in names for w in n]), np.array([len(n) for n in names])).to_pylist()
    final = told(spark, raw)
    assert all(s is None or s == final[n] for n, s in zip(raw, sure) if n)
    assert 200 < sum(s is not None for s in sure) < 1500


def test_sure_names_are_not_judged_again(spark, monkeypatch):
    """Nor are the others judged twice, for the filter and for the name."""
    monkeypatch.setattr(layout, "is_junk_room_name", lambda c: layout.F.raise_error(layout.F.lit("judged")).cast("boolean"))
    words = spark.createDataFrame([("t", "j", "s", t, 100.0, y, 120.0, y + 8, 1000.0, 800.0) for t, y in (("1101", 100.0), ("OFFICE", 112.0))], WORDS)
    assert [r["room_name"] for r in layout.proximity_rooms(words).collect()] == ["OFFICE"]
    monkeypatch.undo()
    assert layout.proximity_rooms(words)._jdf.queryExecution().optimizedPlan().toString().count("COPYRIGHT") == 1
