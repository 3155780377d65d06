"""Chat formatting: conversations, given by turn, as training texts with a loss mask.

    user       <s>[INST] text [/INST]
    assistant   text</s>
    system     [SYS] text [/SYS]
    any other  [ROLE] role [TEXT] text [/ROLE]

Inside roles of the last kind and texts, a control string gets one backslash more after its first character (``[\\INST]``, and
``[\\\\INST]`` for what already has one), so no text can end its turn, and taking one away restores it.

A batch is assembled as bytes: escapes are found in the texts' buffer; lengths of header, text, escapes and footer give every
turn's offset; texts are scattered to their places in one preallocated Arrow buffer, headers and footers are copied to theirs.
A conversation is one row; it is cut between turns where it passes ``CHUNK_BYTES`` or a task's range of rows ends. Rows are
ranges of (conv_id, turn, role), so a huge conversation is spread over tasks. ``read_back`` parses the texts again; only the
rows of a conversation that has several go through a shuffle, and are hashed as a stream.

Defined cases: null texts and roles are empty; turns go by number (null first), then role, then text, so repeated rows stand
beside each other; turns without conv_id make one conversation; bytes that are no UTF-8 are kept as they are; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfind.llm import textnum
from wayfind.llm.common import column, kept

#: Control strings by their first byte; the rest follows any number of backslashes in a text.
CONTROLS = {b"<": (b"s>", b"/s>"), b"[": (b"INST]", b"/INST]", b"SYS]", b"/SYS]", b"ROLE]", b"/ROLE]", b"TEXT]")}
MARKS = {b"user": (b"<s>[INST] ", b" [/INST]"), b"assistant": (b" ", b"</s>"), b"system": (b"[SYS] ", b" [/SYS]")}
CHUNK_BYTES = 4 << 20
FORMATTED = "conv_id {id}, chunk long, whole boolean, text string, n_turns int, loss array<struct<start:int,end:int>>"
PROBE = "</s>[INST] ok [/INST]"


def escapes(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Ascending positions after which a backslash goes in."""
    opens = np.flatnonzero((data == 60) | (data == 91))
    if not len(opens):
        return opens
    last = off[np.searchsorted(off, opens, side="right")]
    rest = opens + 1
    if (data[np.minimum(rest, len(data) - 1)] == 92).any():
        other = np.append(np.flatnonzero(data != 92), len(data))
        rest = other[np.searchsorted(other, rest)]
    found = np.zeros(len(opens), bool)
    for first, tails in CONTROLS.items():
        for tail in tails:
            k = np.flatnonzero((data[opens] == first[0]) & (rest + len(tail) <= last))
            for i, byte in enumerate(tail):
                k = k[data[rest[k] + i] == byte]
            found[k] = True
    return opens[found]


def escaped(text: bytes) -> bytes:
    data = np.frombuffer(text, np.uint8)
    return np.insert(data, escapes(data, np.array([0, len(data)])) + 1, 92).tobytes()


def unescaped(text: bytes) -> bytes:
    """The text before ``escapes``: in plain Python, as a check of the numpy code."""
    import re

    tails = [(re.escape(a), b"|".join(map(re.escape, t))) for a, t in CONTROLS.items()]
    return re.sub(b"|".join(rb"(?<=%s)\\(?=\\*(?:%s))" % x for x in tails), b"", text)


def assemble(roles: list[bytes], data: np.ndarray, off: np.ndarray) -> tuple[pa.Buffer, np.ndarray, np.ndarray, np.ndarray]:
    """The formatted turns in one buffer, their offsets, and where each turn's text starts and ends in it."""
    kinds: dict[bytes, int] = {}
    code = np.array([kinds.setdefault(r, len(kinds)) for r in roles], np.int64)
    marks = [MARKS.get(r) or (b"[ROLE] " + escaped(r) + b" [TEXT] ", b" [/ROLE]") for r in kinds]
    head, foot = (np.array([len(m[i]) for m in marks], np.int64)[code] for i in (0, 1))
    points = escapes(data, off)
    owner = np.searchsorted(off, points, side="right") - 1
    added = np.bincount(owner, minlength=len(roles))
    size = np.diff(off)
    out_off = np.concatenate(([0], np.cumsum(head + size + added + foot)))
    start = out_off[:-1] + head
    end = start + size + added
    buffer = pa.allocate_buffer(int(out_off[-1]))
    out = np.frombuffer(buffer, np.uint8)
    # between escapes a text's bytes move by one distance: the turn's, and one for each escape before
    begin = np.sort(np.concatenate((off[:-1][size > 0], points + 1)))
    begin = begin[begin < len(data)]
    begin = begin[np.append(True, begin[1:] != begin[:-1])] if len(begin) else begin
    turn = np.searchsorted(off, begin, side="right") - 1
    shift = (start - off[:-1])[turn] + np.searchsorted(points, begin) - np.searchsorted(points, off[:-1])[turn]
    out[np.arange(len(data)) + np.repeat(shift, np.diff(begin, append=len(data)))] = data
    out[points + 1 + (start - off[:-1])[owner] + np.arange(len(points)) - np.searchsorted(points, off[:-1])[owner]] = 92
    for i, (h, f) in enumerate(marks):
        rows = np.flatnonzero(code == i)
        out[start[rows, None] - np.arange(len(h), 0, -1)] = np.frombuffer(h, np.uint8)
        out[end[rows, None] + np.arange(len(f))] = np.frombuffer(f, np.uint8)
    return buffer, out_off, start, end


def _points_before(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many code points begin before these byte positions."""
    return np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))[at]


def _rows(batch: pa.RecordBatch, cuts: list[int]) -> tuple[list[pa.Array], list]:
    """(texts, turns, loss) of a batch of turns that is cut at these rows into conversations."""
    roles = [r or b"" for r in batch.column(1).to_pylist()]
    data, off = textnum.view(batch.column(2))
    buffer, out_off, start, end = assemble(roles, data, off)
    edges = np.array(cuts + [len(roles)])
    text_off = out_off[edges].astype(np.int32)
    texts = pa.Array.from_buffers(pa.string(), len(cuts), [None, pa.py_buffer(text_off.tobytes()), buffer])
    bears = np.flatnonzero(np.array([r == b"assistant" for r in roles], bool))
    out = np.frombuffer(buffer, np.uint8)
    chunk = np.searchsorted(edges, bears, side="right") - 1
    zero = _points_before(out, out_off[edges[chunk]])
    spans = pa.StructArray.from_arrays([pa.array((_points_before(out, x[bears]) - zero).astype(np.int32)) for x in (start, end)], ["start", "end"])
    loss = pa.ListArray.from_arrays(pa.array(np.searchsorted(bears, edges).astype(np.int32)), spans)
    return [texts, pa.array(np.diff(edges).astype(np.int32)), loss], [batch.column(0)[i] for i in cuts]


def format_conversations(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Rows (``FORMATTED``): texts of conversations, in ``chunk`` order where one has several (then ``whole`` is false in
    all of them), with their turns and the spans of code points that bear loss."""
    rows = turns.select(column(id_col).alias("conv_id"), column(role_col).cast("binary").alias("role"), column(text_col).cast("binary").alias("text"), column(turn_col).alias("turn"))
    rows = rows.repartitionByRange("conv_id", "turn", "role").sortWithinPartitions("conv_id", "turn", "role", "text")
    kind = dict(rows.dtypes)["conv_id"]
    names = ["conv_id", "chunk", "whole", "text", "n_turns", "loss"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, first, opened = TaskContext.get().partitionId() << 32, True, False
        waiting: pa.RecordBatch | None = None  # turns of a conversation that may go on

        def emit(batch: pa.RecordBatch, cuts: list[int], last_goes_on: bool) -> pa.RecordBatch:
            nonlocal number, first, opened
            columns, ids = _rows(batch, cuts)
            whole = [True] * len(cuts)
            # what stands first or last in a task may have rows in another one
            whole[0] &= not (first or opened)
            whole[-1] &= not last_goes_on
            first, opened = False, last_goes_on
            chunks = pa.array(range(number, number + len(cuts)), pa.int64())
            number += len(cuts)
            return pa.RecordBatch.from_arrays([pa.array(ids, batch.schema.field(0).type), chunks, pa.array(whole), *columns], names=names)

        for batch in textnum.slices(batches, 2, CHUNK_BYTES // 2):
            if waiting is not None:
                batch = pa.Table.from_batches([waiting, batch]).combine_chunks().to_batches()[0]
            ids = batch.column(0).to_pylist()
            cuts = [i for i in range(len(ids)) if not i or ids[i] != ids[i - 1]]
            tail = batch.slice(cuts[-1])
            if cuts[-1]:
                yield emit(batch.slice(0, cuts[-1]), cuts[:-1], False)
            if tail.column(2).nbytes > CHUNK_BYTES:
                yield emit(tail, [0], True)
                tail = None
            waiting = tail
        if waiting is not None:
            yield emit(waiting, [0], True)

    return rows.select("conv_id", "role", "text").mapInArrow(run, FORMATTED.format(id=kind))


def with_probe(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text), and conversation -1, whose texts are control strings."""
    own = turns.select("conv_id", "turn", "role", "text")
    probe = own.sparkSession.createDataFrame([(-1, 0, "user", PROBE), (-1, 1, "assistant", PROBE)], "conv_id long, turn long, role string, text string")
    return own.unionByName(probe)


def kept_format(turns: DataFrame) -> DataFrame:
    """The formatted conversations as a table."""
    return kept(format_conversations(turns), "formatted")


def parse(text: bytes) -> Iterator[tuple[bytes, bytes]]:
    """Role and text of each turn of a formatted text."""
    at = 0
    while at < len(text):
        if text.startswith(b"[ROLE] ", at):
            mid = text.index(b" [TEXT] ", at)
            to = text.index(b" [/ROLE]", mid + 8)
            yield unescaped(text[at + 7 : mid]), unescaped(text[mid + 8 : to])
            at = to + 8
            continue
        role, (head, foot) = next(x for x in MARKS.items() if text.startswith(x[1][0], at))
        to = text.index(foot, at + len(head))
        yield role, unescaped(text[at + len(head) : to])
        at = to + len(foot)


class _Digest:
    """Running digests of one conversation."""

    def __init__(self, name):
        self.name, self.turns, self.loss_chars, self.chars = name, 0, 0, 0
        self.all, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, text: bytes, spans: list[dict]) -> None:
        data = np.frombuffer(text, np.uint8)
        points = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
        self.chars += len(points) - 1
        for role, own in parse(text):
            self.turns += 1
            self.all.update(role + b"\n" + own + b"\n")
        for s in spans:
            own = unescaped(text[points[s["start"]] : points[s["end"]]])
            self.loss.update(own)
            self.loss_chars += int(((np.frombuffer(own, np.uint8) & 0xC0) != 0x80).sum())

    def row(self) -> tuple:
        return self.name, self.turns, self.all.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


def _digests(formatted: DataFrame) -> DataFrame:
    """Digests of consecutive rows of the same conversation, as a stream."""
    kind = dict(formatted.dtypes)["conv_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: _Digest | None = None
        for batch in batches:
            done = []
            for name, text, spans in zip(*(c.to_pylist() for c in batch.columns)):
                if now is None or now.name != name:
                    if now is not None:
                        done.append(now.row())
                    now = _Digest(name)
                now.add(text, spans)
            if done:
                yield _table(done, batch.schema.field(0).type)
        if now is not None:
            yield _table([now.row()], batch.schema.field(0).type)

    return formatted.select("conv_id", F.col("text").cast("binary").alias("text"), "loss").mapInArrow(run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def _table(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    types = (kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), types)], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])


def read_back(formatted: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) of every conversation, from its
    formatted texts and their loss spans alone."""
    pieces = formatted.filter(~F.col("whole")).repartition("conv_id").sortWithinPartitions("conv_id", "chunk")
    return _digests(formatted.filter("whole")).unionByName(_digests(pieces))
