"""Codes against a search of all entries in plain numpy and Python integers."""

import hashlib
from collections import Counter

import numpy as np
import pytest

from tests.compare import differences, duck
from wayfind.llm import codebooks, queries

SF = "/root/testdata/sf0.001"


def plain(rows):
    """(vec_id, code, error, label_error, digest) of (vec_id, vector, label) rows, with Python's integers."""
    rows = [r for r in rows if r[1] is not None and all(x is not None and np.isfinite(x) for x in r[1])]
    rows.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = -(-max((len(r[1]) for r in rows), default=0) // 8)
    ints = [[int(np.floor(4096 * float(x))) for x in r[1]] + [0] * (8 * width - len(r[1])) for r in rows]
    codes, errors, books = [""] * len(rows), [0] * len(rows), []
    for p in range(8):
        parts = [tuple(v[p * width : (p + 1) * width]) for v in ints]
        book = parts[:16]
        best = lambda x: min((sum((a - b) ** 2 for a, b in zip(x, c)), e) for e, c in enumerate(book))
        for _ in range(6):
            own = [best(x)[1] for x in parts]
            for e in range(len(book)):
                if mine := [x for x, o in zip(parts, own) if o == e]:
                    book[e] = tuple(sum(c) // len(mine) for c in zip(*mine))
        for i, x in enumerate(parts):
            d, e = best(x)
            codes[i], errors[i] = codes[i] + f"{e:02x}", errors[i] + d
        books += [str(c) for entry in book for c in entry]
    totals = Counter()
    for r, e in zip(rows, errors):
        totals[r[2]] += e
    digest = hashlib.sha256(",".join(books).encode()).hexdigest()
    return Counter((r[0], c, e, totals[r[2]], digest) for r, c, e in zip(rows, codes, errors))


SCHEMA = "vec_id long, embedding array<float>, label int, SLOT string"


def check(spark, rows, schema=SCHEMA):
    df = spark.createDataFrame([(*r, "x") for r in rows], schema)
    kept = [tuple(r)[:3] for r in df.collect()]
    got = Counter(tuple(r) for r in codebooks.report(df).select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect())
    want = plain(kept)
    assert got == Counter({(*k[:2], *(x if x < 2**63 else None for x in k[2:4]), k[4]): n for k, n in want.items()})
    return got


def test_against_sql(spark):
    assert differences(spark, duck(SF), queries.op13_codes, codebooks.ORACLE_SQL, SF) is None


def test_ties_repeats_and_nulls(spark):
    rng = np.random.default_rng(3)
    rows = [(i // 2, (rng.integers(-2, 3, 16) / 4096).tolist(), i % 3 or None) for i in range(200)]
    rows += [(None, rows[0][1], 1), (-5, None, 1), (-6, [None] * 16, 1), (-7, [float("nan")] * 16, 1), (-8, [float("inf")] + [0.0] * 15, None), *rows[:40]]
    assert sum(check(spark, rows).values()) == 241


@pytest.mark.parametrize("scale", [1.0, 1e5, 1e12, 3e38])
def test_large_components(spark, scale):
    rng = np.random.default_rng(4)
    check(spark, [(i, (rng.normal(size=16) * scale / 4).tolist(), 1) for i in range(60)])


def test_lengths_and_few_rows(spark):
    check(spark, [(3, [0.5, -0.25, 1.0], 1), (1, [0.1] * 11, 2), (2, [], 2)])
    check(spark, [(1, [], 2)])
    assert codebooks.report(spark.createDataFrame([], SCHEMA)).count() == 0
    check(spark, [(i, [i / 3, -i / 7] * 4, 0) for i in range(40)], SCHEMA.replace("float", "double"))


def test_balls_skip_work():
    """Well-parted balls: after the first round few distances beyond a part's own are computed, and codes are those of a search of all."""
    rng = np.random.default_rng(5)
    centers = rng.integers(-4000, 4000, (8, 16, 8))
    own = rng.integers(0, 16, (3000, 8))
    parts = centers[np.arange(8), own] + rng.integers(-300, 300, (3000, 8, 8))
    reach = np.zeros((8, 16))
    d = ((parts[:, :, None, :] - centers[None]) ** 2).sum(-1)
    np.maximum.at(reach, (np.arange(8), own), np.sqrt(np.take_along_axis(d, own[..., None], 2)[..., 0]))
    book = codebooks.book_of(centers, reach)
    code, least, computed = codebooks.nearest(parts, own, book)
    assert (code == d.argmin(-1)).all() and (least == d.min(-1)).all()
    assert computed < 3000 * 8 * 3
