"""Compression of vectors to codes: integer ball k-means in every part of the vectors.

A vector's components become integers, ``floor(4096 * x)``, and the vector is cut into 8 equal parts. The codebook of a
part position has 16 entries; an entry and the parts assigned to it are a ball, whose radius is the distance of its
farthest part. Two entries are neighbours if half their distance does not pass the ball's radius. A part nearer to its
entry than half the way to the nearest neighbour lies in the ball's stable core and is skipped. Any other lies in a ring
between half the distances to two successive neighbours, and only the neighbours up to its ring are computed. A
neighbour farther than twice a part's own distance cannot be nearer (triangle inequality), so the result is that of a
search of all entries; distances are squared integers, and ties, which need equality, stay candidates.

Every round is one pass: tasks read vectors with their codes of the round before, write them with new ones, and add at
the end one row for each entry used (count, sums, radius), which a grouped sum merges. What the driver sees is 128 rows
of sums, whatever the table. Radii after an entry moves are the old ones plus the way it moved.

Defined cases: vectors that are null, hold nulls, or components that are not finite (or beyond the range of a float)
are left out; shorter vectors count as padded with zeros to the longest one, and that to a multiple of 8; a null id
comes last when the first entries are chosen, equal ids go by their vectors; with fewer than 16 rows the codebooks are
shorter; repeated rows count as often as they occur; components too large for 64-bit squares are computed with Python's
integers, and an error that passes a long is null; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfind.llm.common import column, discard, kept

PARTS = 8
ENTRIES = 16
ROUNDS = 6
SCALE = 4096
#: Labels' sums are broadcast up to so many labels.
MAX_BROADCAST_LABELS = 100_000
_LIMB = 60
_FLOAT_MAX = 3.4028234663852886e38


@dataclass
class Vectors:
    """How the components are stored: rows of ``width`` integers in each part, of so many bytes (0: as decimal text)."""

    width: int
    bytes: int
    limbs: int

    @property
    def kind(self):
        return np.dtype("int64") if self.bytes else np.dtype(object)

    def pack(self, values: np.ndarray) -> list[bytes]:
        if self.bytes:
            return [r.tobytes() for r in values.astype(f"<i{self.bytes}")]
        return [",".join(map(str, r)).encode() for r in values.tolist()]

    def unpack(self, packed: pa.Array) -> np.ndarray:
        """(rows, parts, width) integers."""
        n, size = len(packed), PARTS * self.width
        if not self.bytes:
            return np.array([list(map(int, r.split(b","))) for r in packed.to_pylist()], object).reshape(n, PARTS, self.width)
        if not size:
            return np.zeros((n, PARTS, 0), np.int64)
        first = np.frombuffer(packed.buffers()[1], np.int32)[packed.offset]
        flat = np.frombuffer(packed.buffers()[2], f"<i{self.bytes}", n * size, int(first))
        return flat.astype(np.int64).reshape(n, PARTS, self.width)


@dataclass
class Book:
    """Entries of all parts (part, entry, component) and, for each, its neighbours in order of distance."""

    entries: np.ndarray
    near: np.ndarray  # (part * entry, rank) entry, -1 beyond the last neighbour
    edges: np.ndarray  # their squared distances

    @property
    def size(self) -> int:
        return self.entries.shape[1]


def _squares(a: np.ndarray) -> np.ndarray:
    return (a * a).sum(-1) if a.shape[-1] else np.zeros(a.shape[:-1], a.dtype)


def book_of(entries: np.ndarray, reach: np.ndarray | None) -> Book:
    """reach: the balls' radii (part, entry); None, where nothing is assigned yet, makes all entries neighbours."""
    parts, k, _ = entries.shape
    near, edges = np.full((parts * k, max(k - 1, 0)), -1, np.int64), np.zeros((parts * k, max(k - 1, 0)), entries.dtype)
    for p in range(parts):
        for e in range(k):
            apart = _squares(entries[p] - entries[p, e])
            found = [j for j in sorted(range(k), key=lambda j: (apart[j], j)) if j != e]
            if reach is not None:
                # the slack is far above the rounding of the square roots
                found = [j for j in found if float(apart[j]) ** 0.5 <= 2 * reach[p, e] * (1 + 1e-9)]
            near[p * k + e, : len(found)], edges[p * k + e, : len(found)] = found, apart[found]
    return Book(entries, near, edges)


def nearest(parts: np.ndarray, own: np.ndarray, book: Book) -> tuple[np.ndarray, np.ndarray, int]:
    """Nearest entry of every part, its squared distance, and how many distances were computed.

    parts: (n, part, width); own: (n, part) entries to start from.
    """
    n, k = len(parts), book.size
    x, home = parts.reshape(n * PARTS, -1), (own + np.arange(PARTS) * k).reshape(-1)
    entries = book.entries.reshape(PARTS * k, -1)
    base = home - home % k
    start = _squares(x - entries[home])
    code, least, computed = home % k, start.copy(), len(x)
    active = np.arange(len(x))
    for rank in range(book.near.shape[1]):
        # parts whose ring reaches the neighbour of this rank; cores leave at once, each ring's parts after its last
        h = home[active]
        active = active[(book.near[h, rank] >= 0) & (book.edges[h, rank] <= 4 * start[active]).astype(bool)]
        if not len(active):
            break
        other = book.near[home[active], rank]
        d = _squares(x[active] - entries[base[active] + other])
        computed += len(active)
        better = ((d < least[active]) | ((d == least[active]) & (other < code[active]))).astype(bool)
        code[active[better]], least[active[better]] = other[better], d[better]
    return code.reshape(n, PARTS), least.reshape(n, PARTS), computed


def _finite(vector: Column) -> Column:
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) <= _FLOAT_MAX))


def _integers(rows: list, shape: Vectors) -> np.ndarray:
    out = np.zeros((len(rows), PARTS * shape.width), shape.kind)
    for i, r in enumerate(rows):
        v = np.floor(SCALE * np.asarray(r, np.float64))
        out[i, : len(v)] = v.astype(np.int64) if shape.bytes else [int(x) for x in v]
    return out


def _limbs(sums: np.ndarray, limbs: int) -> list[int]:
    """Integers as limbs of 60 bits, the last one signed, so that a sum of longs adds up sums of any size."""
    if limbs == 1:
        return [int(v) for v in sums]
    mask = (1 << _LIMB) - 1
    return [(int(v) >> _LIMB * i) & mask if i < limbs - 1 else int(v) >> _LIMB * i for v in sums for i in range(limbs)]


def _assigned(state: DataFrame, shape: Vectors, book: Book, first: bool) -> DataFrame:
    """state's vectors with the nearest entries, and after those of a task one row for each entry it used."""
    kinds = dict(state.dtypes)
    names = ["id", "label", "packed", "codes", "error", "slot", "radius", "sums"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots, k = PARTS * book.size, book.size
        count, radius, sums = np.zeros(slots, np.int64), np.zeros(slots, shape.kind), np.zeros((slots, shape.width), shape.kind)
        types = None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            types = [batch.schema.field(0).type, batch.schema.field(1).type]
            parts = shape.unpack(batch.column(2))
            own = np.zeros((n, PARTS), np.int64) if first else np.array([list(c) for c in batch.column(3).to_pylist()], np.int64)
            code, least, _ = nearest(parts, own, book)
            slot = (code + np.arange(PARTS) * k).reshape(-1)
            np.add.at(count, slot, 1)
            np.maximum.at(radius, slot, least.reshape(-1))
            np.add.at(sums, slot, parts.reshape(n * PARTS, -1))
            error = [e if e < 2**63 else None for e in least.sum(1).tolist()]
            blank = [pa.nulls(n, t) for t in (pa.int32(), pa.float64(), pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([r.tobytes() for r in code.astype(np.uint8)], pa.binary()), pa.array(error, pa.int64()), *blank], names=names)
        used = np.flatnonzero(count).tolist()
        if used:
            own_sums = [[int(count[s]), *_limbs(sums[s], shape.limbs)] for s in used]
            blank = [pa.nulls(len(used), t) for t in (*types, pa.binary(), pa.binary(), pa.int64())]
            yield pa.RecordBatch.from_arrays([*blank, pa.array(used, pa.int32()), pa.array([float(radius[s]) ** 0.5 for s in used], pa.float64()), pa.array(own_sums, pa.list_(pa.int64()))], names=names)

    rows = state if first else state.filter("slot is null")
    schema = f"id {kinds['id']}, label {kinds['label']}, packed binary, codes binary, error long, slot int, radius double, sums array<long>"
    return rows.select("id", "label", "packed", *([] if first else ["codes"])).mapInArrow(run, schema)


def _moved(state: DataFrame, shape: Vectors, book: Book) -> Book:
    """The codebooks after the entries moved to their parts' means; entries without parts stay."""
    merged = state.filter("slot is not null").select("slot", "radius", F.posexplode("sums").alias("pos", "value"))
    merged = merged.groupBy("slot", "pos").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("total"), F.max("radius").alias("radius"))
    k, entries, reach = book.size, book.entries.copy(), np.zeros((PARTS, book.size))
    found: dict[int, dict[int, int]] = {}
    # as many rows as codebooks have entries and components
    for r in merged.collect():
        found.setdefault(r.slot, {})[r.pos] = int(r.total)
        reach[r.slot // k, r.slot % k] = r.radius
    for slot, totals in found.items():
        limb = lambda i: sum(totals[1 + i * shape.limbs + j] << _LIMB * j for j in range(shape.limbs))
        entries[slot // k, slot % k] = [limb(i) // totals[0] for i in range(shape.width)]
    way = _squares(entries - book.entries).astype(float) ** 0.5
    return book_of(entries, reach + way)


def compress(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", rounds: int = ROUNDS, entries: int = ENTRIES) -> tuple[DataFrame, np.ndarray]:
    """(id, label, codes, error) of every kept row, codes with a byte for each part, and the final codebooks
    (part, entry, component)."""
    vector = column(vector_col)
    rows = df.select(column(id_col).alias("id"), column(label_col).alias("label"), vector.alias("vector")).filter(_finite(F.col("vector")))
    most = F.array_max(F.transform("vector", lambda x: F.abs(x.cast("double"))))
    facts = rows.agg(F.max(F.size("vector")).alias("length"), F.max(most).alias("most")).first()
    seeds = rows.orderBy(F.col("id").asc_nulls_last(), "vector").limit(entries).select("vector").collect()
    width = -(-(facts.length or 0) // PARTS)
    largest = int(SCALE * (facts.most or 0)) + 1
    small = 32 * max(width, 1) * largest**2 < 2**63
    limbs = 1 if small else -(-(largest.bit_length() + 50) // _LIMB)
    shape = Vectors(width, (2 if largest < 2**15 else 4) if small else 0, limbs)
    first = _integers([r.vector for r in seeds], shape).reshape(len(seeds), PARTS, width).swapaxes(0, 1)
    book = book_of(first, None)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                vectors = batch.column(2)
                if shape.bytes and len(vectors.flatten()) == batch.num_rows * PARTS * width:
                    values = np.floor(SCALE * vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)).reshape(batch.num_rows, -1)
                else:
                    values = _integers(vectors.to_pylist(), shape)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(shape.pack(values), pa.binary())], names=["id", "label", "packed"])

    kinds = dict(rows.dtypes)
    packed = rows.mapInArrow(pack, f"id {kinds['id']}, label {kinds['label']}, packed binary")
    state = None
    for turn in range(rounds + 1):
        before, state = state, kept(_assigned(packed if state is None else state, shape, book, state is None), f"codes-{turn}")
        if before is not None:
            discard(before)
        if turn < rounds:
            book = _moved(state, shape, book)
    return state.filter("slot is null").select("id", "label", "codes", "error"), book.entries


def books_sha256(entries: np.ndarray) -> str:
    """Digest of all components by part, entry and position, comma-joined."""
    return hashlib.sha256(",".join(map(str, entries.reshape(-1).tolist())).encode()).hexdigest()


def report(df: DataFrame) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of every kept row."""
    rows, entries = compress(df)
    sums = kept(rows.groupBy(F.col("label").alias("_label")).agg(F.sum(F.col("error").cast("decimal(38,0)")).try_cast("long").alias("label_error")), "label-errors")
    # a frequent label's rows are many: few labels are broadcast, else the join's large partitions are split
    few = F.broadcast(sums) if sums.count() <= MAX_BROADCAST_LABELS else sums
    found = rows.join(few, F.col("label").eqNullSafe(F.col("_label")), "left")
    return found.select(F.col("id").alias("vec_id"), F.lower(F.hex("codes")).alias("code"), "error", "label_error", F.lit(books_sha256(entries)).alias("codebooks_sha256"))


def _oracle() -> str:
    d = "list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    steps = [
        "kept AS (SELECT vec_id, label, list_transform(embedding, lambda v: CAST(floor(4096 * CAST(v AS DOUBLE)) AS BIGINT)) AS v, row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS rid FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0)",
        "parts AS (SELECT rid, p, v[p * len(v) // 8 + 1 : (p + 1) * len(v) // 8] AS x FROM kept, (SELECT unnest(range(8)) AS p))",
        "book0 AS (SELECT p, rid - 1 AS e, x AS c FROM parts WHERE rid <= 16)",
    ]
    for t in range(ROUNDS + 1):
        steps.append(f"near{t} AS (SELECT rid, p, any_value(x) AS x, min((d, e)) AS best FROM (SELECT rid, p, x, e, {d} AS d FROM parts JOIN book{t} USING (p)) GROUP BY rid, p)")
        if t < ROUNDS:
            mean = "CAST((s - ((s % n) + n) % n) // n AS BIGINT)"
            each = f"SELECT p, best[2] AS e, i, sum(CAST(x[i] AS HUGEINT)) AS s, count(*) AS n FROM near{t}, (SELECT unnest(range(1, (SELECT max(len(x)) FROM parts) + 1)) AS i) GROUP BY ALL"
            steps.append(f"sums{t} AS (SELECT p, e, list({mean} ORDER BY i) AS c FROM ({each}) GROUP BY p, e)")
            steps.append(f"book{t + 1} AS (SELECT p, e, coalesce(s.c, b.c) AS c FROM book{t} b LEFT JOIN sums{t} s USING (p, e))")
    steps.append(f"rows AS (SELECT rid, string_agg(printf('%02x', best[2]), '' ORDER BY p) AS code, CAST(sum(best[1]) AS BIGINT) AS error FROM near{ROUNDS} GROUP BY rid)")
    steps.append(f"digest AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM book{ROUNDS})")
    return f"WITH {', '.join(s.replace(' AS (', ' AS MATERIALIZED (', 1) for s in steps)} SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM rows JOIN kept USING (rid), digest"


ORACLE_SQL = _oracle()
