import math
import random
import re

from wayfind.llm import decontaminate


def brute(docs, items):
    def sets(text):
        return re.split(r"[\x20\x09-\x0D]+", (text or "").lower().strip(" \t\n\r\x0b\x0c"))

    out = {}
    for d, text in docs:
        dw = [x for x in sets(text) if x]
        for i, item in items:
            iw = [x for x in sets(item) if x]
            k = min(5, len(iw))
            if not k:
                continue
            want = {tuple(iw[j : j + k]) for j in range(len(iw) - k + 1)}
            have = {tuple(dw[j : j + k]) for j in range(len(dw) - k + 1)}
            if len(want & have) * 100 >= 75 * len(want):
                out[d, i] = len(want & have) / len(want)
    return out


WORDS = [f"w{i}" for i in range(400)]
LONG = " ".join(WORDS)


def test_against_brute_force(spark):
    items = [(1, " ".join(WORDS[50:90])), (2, "only three words"), (3, None), (4, " \t "), (5, "w300 W301 w302 w303 w304"), (6, "x"), (7, " ".join(WORDS[50:90]))]
    near = WORDS[50:90]
    near[20] = "changed"
    docs = [
        (10, LONG),
        (11, "before " + " ".join(WORDS[50:90]).upper() + " after"),
        (12, " ".join(near)),
        (13, " ".join(WORDS[50:70]) + " other " + " ".join(WORDS[95:120])),
        (14, "these are only  three\twords here"),
        (15, None),
        (16, ""),
        (17, "x"),
        (18, LONG * 40),
        (10, LONG),
    ]
    d = spark.createDataFrame([(i, t, 7, "h") for i, t in docs], "doc_id long, text string, item_id long, hash string")
    found = decontaminate.contained(d, spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id int")).collect()
    assert len(found) == len({(r["doc_id"], r["item_id"]) for r in found})
    assert {(r["doc_id"], r["item_id"]): r["containment"] for r in found} == brute(docs, items)


def test_empty_tables(spark):
    d = spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string")
    i = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    assert decontaminate.contained(d.limit(0), i).count() == 0
    assert decontaminate.contained(d, i.limit(0)).count() == 0


def test_size_partitions_lose_nothing(spark):
    """Items of every size partition in documents that have just enough of them, or one shingle less."""
    r = random.Random(4)
    items, docs = [], []
    for i, n in enumerate([1, 2, 3, 4, 6, 7, 8, 9, 15, 16, 31, 32, 33, 63, 64, 120]):
        own = [f"i{i}w{j}" for j in range(n + 4)]
        items.append((i, " ".join(own)))
        for k, lost in enumerate({n - math.ceil(n * 0.75), n - math.ceil(n * 0.75) + 1, 0}):
            # a foreign word after a shingle's first one loses it; those at the end lose one each
            kept = own[: len(own) - lost] if k % 2 else own[lost:]
            docs.append((100 * i + k, " ".join([f"f{r.randrange(9)}" for _ in range(r.randrange(8))] + kept)))
    d, t = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert {(x["doc_id"], x["item_id"]): x["containment"] for x in decontaminate.contained(d, t).collect()} == brute(docs, items)


def test_large_items_need_several_hits(spark):
    """A phrase of an item is no candidate for it, whichever phrase."""
    item = [f"w{j}" for j in range(60)]
    docs = [(j, " ".join(["x"] * 60 + item[j : j + 5] + ["y"] * 60)) for j in range(55)]
    index = decontaminate.item_index(spark.createDataFrame([(1, " ".join(item))], "item_id long, text string"))
    assert index.filter("part = 5").count() == 56
    assert decontaminate.candidates(spark.createDataFrame(docs, "doc_id long, text string"), index, [5]).count() == 0
    assert decontaminate.candidates(spark.createDataFrame([(1, " ".join(item))], "doc_id long, text string"), index, [5]).count() == 1
    assert [decontaminate.sketch_length(p) for p in range(6)] == [1, 1, 2, 5, 10, 19]
