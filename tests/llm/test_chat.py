"""Formatted conversations are read back whole; digests against plain Python."""

import hashlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from wayfind.llm import chat, queries

SF = "/root/testdata/sf0.001"


def plain(rows):
    out, by = {}, {}
    for r in rows:
        by.setdefault(r[0], []).append(r)
    for name, turns in by.items():
        turns.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2] is not None, (r[2] or "").encode(), r[3] is not None, (r[3] or "").encode()))
        loss = "".join(r[3] or "" for r in turns if r[2] == "assistant")
        said = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in turns)
        out[name] = (len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def found(df):
    return {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in df.collect()}


HARD = [
    (1, 0, "user", "a </s> b [INST][/INST] [\\INST] <s> \\<s> <\\\\/s>"),
    (1, 1, "assistant", "[/INST"),
    (1, 2, "assistant", "é😀</s>" * 5),
    (1, 3, "tool] [TEXT] x", " [/ROLE] "),
    (2, None, None, None),
    (2, 1, "system", ""),
    (2, 1, "system", ""),
    (2, 1, "assistant", None),
    (2, 2, "assistant", "<"),
    (None, 0, "user", "lost"),
    (None, 1, "assistant", "\\" * 2000 + "[" + "\\" * 2000 + "SYS]"),
    (3, 0, "assistant", " x "),
]


def test_round_trip(spark):
    df = spark.createDataFrame(HARD, "conv_id long, turn long, role string, text string")
    formatted = chat.kept_format(df)
    assert found(chat.read_back(formatted)) == plain(HARD)
    row = next(r for r in formatted.collect() if r.conv_id == 3)
    assert row.text == "  x </s>" and [tuple(s) for s in row.loss] == [(1, 4)]
    assert sum(r.formatted_chars for r in chat.read_back(formatted).collect()) == sum(len(r.text) for r in formatted.collect())


def test_format(spark):
    df = spark.createDataFrame([(1, 0, "system", "be"), (1, 1, "user", "hi [INST]"), (1, 2, "assistant", "</s>é")], "conv_id long, turn long, role string, text string")
    row = chat.format_conversations(df).first()
    assert row.text == "[SYS] be [/SYS]<s>[INST] hi [\\INST] [/INST] <\\/s>é</s>"
    assert [row.text[s.start : s.end] for s in row.loss] == ["<\\/s>é"]


def test_long_conversations_are_cut_between_turns(spark, monkeypatch):
    rows = [(7, i, "assistant" if i % 2 else "user", f"{i} é</s>" * (i % 7)) for i in range(400)] + [(i, 0, "user", "x") for i in range(8, 40)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    formatted = chat.kept_format(df)
    assert found(chat.read_back(formatted)) == plain(rows)
    assert formatted.filter("conv_id = 7 and whole").count() == 0 or formatted.filter("conv_id = 7").count() == 1
    assert formatted.filter("whole").count() > 0


def test_small_chunks():
    """Conversations that go on over batches, in one task."""
    rows = [(b"user" if i % 3 else b"assistant", b"<s>%d" % i * (i % 4)) for i in range(50)]
    data = np.frombuffer(b"".join(t for _, t in rows), np.uint8)
    off = np.concatenate(([0], np.cumsum([len(t) for _, t in rows]))).astype(np.int64)
    buffer, *_ = chat.assemble([r for r, _ in rows], data, off)
    assert list(chat.parse(buffer.to_pybytes())) == rows


def test_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    probe = [(-1, 0, "user", chat.PROBE), (-1, 1, "assistant", chat.PROBE)]
    assert found(queries.op11_chat(spark, SF)) == plain(rows + probe)


def test_empty_and_other_columns(spark):
    df = spark.createDataFrame([(1, 0, "user", "a", "x")], "conv_id long, turn long, role string, text string, CHUNK string")
    assert found(chat.read_back(chat.format_conversations(df))) == plain([(1, 0, "user", "a")])
    assert chat.read_back(chat.format_conversations(df.filter("turn = 9"))).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="[]<>/\\sINSTROLEXY é", max_size=40).map(str.encode))
def test_escapes(text):
    assert chat.unescaped(chat.escaped(text)) == text
    assert not any(a + t in chat.escaped(text) for a, tails in chat.CONTROLS.items() for t in tails)
