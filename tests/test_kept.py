"""Files of steps that are done."""

import time

from wayfind.sources import kept


def _shuffle_files(spark):
    files = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles()
    found = [files.apply(i) for i in range(files.size())]
    return {f.getName(): f.length() for f in found if f.getName().startswith("shuffle_") and f.getName().endswith(".data")}


def test_numbering_leaves_no_rows_in_shuffle_files(spark, monkeypatch):
    before, asked, let_go = _shuffle_files(spark), [], kept.let_go
    monkeypatch.setattr(kept, "let_go", lambda s: asked.append(s) or let_go(s))
    rows = kept.numbered(spark.range(5000).selectExpr("id * 7919 % 5000 AS v"), ["v"])
    # what is left is the shuffle of the partitions' counts
    for _ in range(50):
        if (left := sum(n for f, n in _shuffle_files(spark).items() if f not in before)) < 2000:
            break
        time.sleep(0.2)
    # Spark may also have collected garbage by itself
    assert left < 2000 and asked == [spark]
    assert rows.filter("v + 1 <> seq").count() == 0 and rows.count() == 5000
