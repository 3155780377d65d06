"""Alignment of two tokenisations against encoders called on whole texts and plain loops over tokens."""

import hashlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from wayfind.llm import alignment, queries

SF = "/root/testdata/sf0.001"
TEXTS = ["Hello  world", "", None, " ", "  two ", "end ", "a\nb\t c\r\n\r\n  d", "<|endoftext|> </s> <s>x <unk> <0x0A>", "ab▁c", "é 中文字 😀😀 ﬁ", "nul\x00 x", "Hello  world", "x" * 3000 + " " * 50 + "😀" * 400, "don't  12345 3.14 __init__(self):\n    return {}", "word " * 700]


def plain(texts):
    """Rows of the contract by whole encodings and loops."""
    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    chars = {chr(x): x for x in keep} | {chr(256 + i): x for i, x in enumerate(x for x in range(256) if x not in keep)}
    docs = []
    for t in texts:
        if not t:
            docs.append([])
            continue
        ia, ib = a.encode(" " + t, add_special_tokens=False).ids, b.encode(t)
        ta = [bytes(chars[c] for c in a.id_to_token(i)) for i in ia]
        tb = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, b.id_to_piece(i)) for i in ib)]
        if b"".join(ta) != (" " + t).encode() or b"".join(tb) != (" " + t).encode():
            docs.append([])
            continue
        groups, x, y, ends_a, ends_b = [([], [])], 0, 0, set(np.cumsum([len(v) for v in ta])), set(np.cumsum([len(v) for v in tb]))
        cuts = sorted(ends_a & ends_b)
        i = j = 0
        groups = []
        for cut in cuts:
            ga, gb = [], []
            while x < cut:
                x, i = x + len(ta[i]), i + 1
                ga.append(ia[i - 1])
            while y < cut:
                y, j = y + len(tb[j]), j + 1
                gb.append(ib[j - 1])
            groups.append((ga, gb))
        docs.append(groups)
    links = [Counter((p, q) for ga, gb in d for p in ga for q in gb) for d in docs]
    counts = Counter(p for found in links for p in found)
    most = Counter()
    for (p, _), n in counts.items():
        most[p] = max(most[p], n)
    out = []
    for d, found in zip(docs, links):
        told = ";".join(f"{','.join(map(str, ga))}|{','.join(map(str, gb))}" for ga, gb in d)
        out.append((sum(len(g[0]) for g in d), sum(len(g[1]) for g in d), len(d), sum(found.values()), sum(n for k, n in found.items() if counts[k] == most[k[0]]), sum(n * counts[k] for k, n in found.items()), hashlib.sha256(told.encode()).hexdigest() if d else ""))
    return out


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.mark.parametrize("frequent", [1 << 20, 40, 0])
def test_against_plain_loops(spark, frequent):
    df = spark.createDataFrame([(i if i != 5 else None, t, "x") for i, t in enumerate(TEXTS)], "doc_id long, text string, KEY string")
    found = {r.doc_id: tuple(r[c] for c in COLUMNS) for r in alignment.report(df, frequent).collect()}
    assert found == {i if i != 5 else None: row for i, row in enumerate(plain(TEXTS))}


def test_whole_table(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    found = {r.doc_id: tuple(r[c] for c in COLUMNS) for r in queries.op12_alignment(spark, SF).collect()}
    assert found == dict(zip([r.doc_id for r in rows], plain([r.text for r in rows])))


def test_broken_bytes_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "x")], "doc_id long, text string").selectExpr("doc_id", "cast(unhex('6120FF20C3A9') as string) AS text")
    assert [tuple(r) for r in alignment.report(df).collect()] == [(1, 0, 0, 0, 0, 0, 0, "")]
    assert alignment.report(df.filter("doc_id = 0")).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.sets(st.integers(0, 300)), st.sets(st.integers(0, 300)))
def test_gallop(a, b):
    x, y = np.array(sorted(a), np.int64), np.array(sorted(b), np.int64)
    assert alignment.gallop(x, y).tolist() == [y.tolist().index(v) if v in b else -1 for v in x.tolist()]
    i, j = alignment.common_ends(x, y)
    assert x[i].tolist() == y[j].tolist() == sorted(a & b)


def test_large_groups(monkeypatch):
    """Groups beyond the limit of links give the same pairs."""
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 9, 60), rng.integers(0, 9, 80)
    args = a, b, np.array([5, 30, 60]), np.array([4, 44, 80]), np.array([0, 0, 1])
    whole = alignment._linked(*args)
    monkeypatch.setattr(alignment, "LINKS", 7)
    for x, y in zip(whole, alignment._linked(*args)):
        assert x.tolist() == y.tolist()
