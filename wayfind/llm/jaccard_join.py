"""N-gram Jaccard join as a blocked sparse matrix product of the document by n-gram incidence.

Every text is the set of its distinct 5-word shingles, as 64-bit hashes. Two texts link if the Jaccard
similarity of their sets is at least 3/4. Texts with equal sets form a class and only its smallest id takes part.

1. Shingle frequencies: the hashes are dealt out by value and counted; the frequent ones (a bounded list) go
   last in a common order of all shingles, the others follow their hash.
2. Of each set only the first part in that order enters the incidence matrix. How long it is follows from the
   set's size: two sets that link share a known least number of entries there. The matrix is dealt out in
   blocks of shingles; a block's product with itself gives overlap counts of pairs, which are added up over
   the blocks, and pairs below the bound that their sizes give are discarded. What remains is verified on
   the whole sets.
3. Rows of the matrix that are still long (families of near copies) are not expanded into pairs. Each document
   of a family is first held against the family's pivot, the one in most of its rows; those that link with it
   are connected already. The others are dealt out in blocks against each other and against the connected ones,
   each block pair is multiplied densely over all shingles, and only a spanning forest of its links is returned.
4. Connected components by alternating stars.

Defined cases: null texts and texts without words have an empty set and link with nothing; a text of 1 to 4
words is one shingle, its whole sequence; repeated rows are of one class; rows with a null id take part in
nothing and get a null component; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfind.llm import textnum
from wayfind.llm.common import batch_rows, column, discard, kept, shuffle_partitions

WORDS = 5
#: A shingle is frequent from so many documents on ...
FREQUENT = 32
#: ... or from so many more that the list stays within this length.
MOST_FREQUENT = 1 << 20
#: Bytes of a hash that the counting keeps.
KEY_BYTES = 5
#: Part of a set by which its prefix is longer than the least, so that links share many entries.
EXTRA = 0.1
#: Longer matrix rows are handled as families.
LONG = 64
#: Documents of a family's block, and bytes of their sets, about.
FAMILY_BLOCK, FAMILY_BYTES = 384, 12 << 20
#: Text that a task holds in expanded form at a time.
GROUP_BYTES = 4 << 20
#: Bytes that a task reads of the dealt incidence matrix, at most about; a fourth or less of it is one block.
TASK_BYTES = 64 << 20
#: Rows that pass to Python at a time: texts, and pairs of sets.
TEXT_ROWS, PAIR_ROWS = 1_000, 200
#: Ids up to this many are broadcast to find their texts; more are joined by a shuffle.
MAX_BROADCAST_IDS = 500_000


def least_overlap(a, b):
    """Shared shingles that two sets of these sizes need: 100 * i >= 75 * (a + b - i)."""
    return -(-3 * (a + b) // 7)


def prefix_length(n):
    return np.where(n > 0, n - -(-3 * n // 4) + 1 + (EXTRA * n).astype(np.int64), 0)


# ---- tasks ----


def _sets(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Ranges of documents with their shingle sets and offsets."""
    data, off = textnum.view(column)
    for i, j in textnum.parts(off):
        yield i, j, *textnum.shingle_sets(textnum.words(data[off[i] : off[j]], off[i : j + 1] - off[i]), WORDS)


def _profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """n_shingles and a 128-bit digest of each set."""
    for batch in batches:
        n, high, low = (np.zeros(batch.num_rows, np.int64) for _ in range(3))
        for i, j, h, at in _sets(batch.column(1)):
            n[i:j] = np.diff(at)
            for k in range(i, j):
                d = np.frombuffer(xxhash.xxh3_128_digest(h[at[k - i] : at[k - i + 1]].tobytes()), np.int64)
                high[k], low[k] = d
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(high), pa.array(low)], names=["doc_id", "n_shingles", "high", "low"])


def _dealt(bucket: np.ndarray, *columns: np.ndarray) -> Iterator[tuple]:
    """The columns' values of each bucket."""
    order = np.argsort(bucket, kind="stable")
    b = bucket[order]
    cut = np.flatnonzero(np.diff(b, prepend=-1, append=-1))
    columns = [c[order] for c in columns]
    for s, e in zip(cut[:-1], cut[1:]):
        yield int(b[s]), *(c[s:e] for c in columns)


def _by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[list[list[bytes]]]:
    """The blobs of one bucket after the other, from rows in the order of buckets."""
    at, held = None, []
    for batch in batches:
        for b, *blobs in zip(*(c.to_pylist() for c in batch.columns)):
            if b != at and held:
                yield held
                held = []
            at = b
            held.append(blobs)
    if held:
        yield held


def _deal_keys(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in textnum.slices(batches, 0, GROUP_BYTES):
            keys = np.concatenate([h >> np.uint64(64 - 8 * KEY_BYTES) for _, _, h, _ in _sets(batch.column(0))])
            # a group tells no more than that a key is frequent
            keys = np.sort(keys)
            first = np.concatenate(([True], keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, bool)
            start = np.flatnonzero(first)
            place = np.arange(len(keys)) - np.repeat(start, np.diff(np.append(start, len(keys))))
            keys = keys[place <= FREQUENT * 64]
            rows = [(b, np.ascontiguousarray(k.view(np.uint8).reshape(-1, 8)[:, :KEY_BYTES]).tobytes()) for b, k in _dealt((keys & np.uint64(buckets - 1)).astype(np.int64), keys)]
            yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in rows], pa.int32()), pa.array([k for _, k in rows], pa.binary())], names=["bucket", "keys"])

    return run


def _count_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for blobs in _by_bucket(batches):
        raw = np.frombuffer(b"".join(x[0] for x in blobs), np.uint8).reshape(-1, KEY_BYTES)
        keys = np.zeros((len(raw), 8), np.uint8)
        keys[:, :KEY_BYTES] = raw
        k, n = np.unique(keys.view(np.int64).ravel(), return_counts=True)
        many = n > FREQUENT
        yield pa.RecordBatch.from_arrays([pa.array(k[many]), pa.array(n[many])], names=["key", "n"])


def _deal_prefixes(buckets: int, shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = shared.value
        for batch in textnum.slices(batches, 1, GROUP_BYTES):
            ids = batch.column(0).to_numpy()
            hashes, docs, sizes, digests, seen = [], [], [], [], {}
            for i, j, h, at in _sets(batch.column(1)):
                n = np.diff(at)
                digest = np.array([xxhash.xxh3_64_intdigest(h[at[k] : at[k + 1]].tobytes()) for k in range(j - i)], np.uint64)
                # a class enters a group's rows once
                take = np.zeros(j - i, bool)
                for k in np.flatnonzero(n).tolist():
                    first = seen.setdefault(int(digest[k]), (len(hashes), k, ids[i + k]))
                    take[k] = first[:2] == (len(hashes), k)
                    if ids[i + k] < first[2]:
                        seen[int(digest[k])] = (*first[:2], ids[i + k])
                doc = np.repeat(np.arange(j - i), n)
                key = h >> np.uint64(64 - 8 * KEY_BYTES)
                often = np.zeros(len(h), bool)
                if len(frequent) and len(h):
                    often = frequent[np.minimum(np.searchsorted(frequent, key), len(frequent) - 1)] == key
                order = np.lexsort((h, often, doc))
                rank = np.arange(len(h)) - at[doc]
                chosen = (rank < prefix_length(n)[doc]) & take[doc]
                hashes.append(h[order][chosen])
                docs.append(doc[chosen] + i)
                sizes.append(n[doc[chosen]])
                digests.append(digest[doc[chosen]])
            h, digest = np.concatenate(hashes), np.concatenate(digests)
            least = {d: x[2] for d, x in seen.items()}
            names, back = np.unique(digest, return_inverse=True)
            owner = np.array([least[int(d)] for d in names], np.int64)[back] if len(names) else np.zeros(0, np.int64)
            rows = list(_dealt((h & np.uint64(buckets - 1)).astype(np.int64), h, owner, np.concatenate(sizes).astype(np.int32), digest))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), *(pa.array([r[k].tobytes() for r in rows], pa.binary()) for k in range(1, 5))], names=["bucket", "hashes", "ids", "sizes", "digests"])

    return run


def _multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Overlap counts of pairs from the blocks' short rows; the members of long rows with the row's first as list."""
    pairs: list[np.ndarray] = []
    waiting = 0
    for blobs in _by_bucket(batches):
        h, ids, n, digest = (np.frombuffer(b"".join(x[k] for x in blobs), t) for k, t in enumerate((np.uint64, np.int64, np.int32, np.uint64)))
        order = np.lexsort((ids, digest, h))
        h, ids, n, digest = h[order], ids[order], n[order].astype(np.int64), digest[order]
        first = np.ones(len(h), bool)
        first[1:] = (h[1:] != h[:-1]) | (digest[1:] != digest[:-1])  # the class's smallest id
        h, ids, n = h[first], ids[first], n[first]
        start = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
        length = np.diff(np.append(start, len(h)))
        for m in np.unique(length[(length > 1) & (length <= LONG)]).tolist():
            at = start[length == m][:, None]
            for s in range(0, len(at), max(1, 200_000 // (m * m))):
                rows = at[s : s + max(1, 200_000 // (m * m))] + np.arange(m)
                x, y = np.triu_indices(m, 1)
                a, b, na, nb = ids[rows[:, x]].ravel(), ids[rows[:, y]].ravel(), n[rows[:, x]].ravel(), n[rows[:, y]].ravel()
                near = 4 * np.minimum(na, nb) >= 3 * np.maximum(na, nb)
                a, b, na, nb = a[near], b[near], na[near], nb[near]
                swap = a > b
                pairs.append(np.stack([np.where(swap, b, a), np.where(swap, a, b), np.where(swap, nb, na), np.where(swap, na, nb)], axis=1))
                waiting += len(a)
        if waiting > 250_000:
            yield _counted(pairs)
            pairs, waiting = [], 0
        for s, m in zip(start[length > LONG].tolist(), length[length > LONG].tolist()):
            own = ids[s : s + m]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(m, own.min())), pa.array(own), pa.array(n[s : s + m]), pa.array(n[s : s + m]), pa.array(np.zeros(m, np.int64))], names=_PAIR)
    if pairs:
        yield _counted(pairs)


_PAIR = ["a", "b", "na", "nb", "shared"]


def _counted(pairs: list[np.ndarray]) -> pa.RecordBatch:
    p = np.concatenate(pairs)
    p = p[np.lexsort((p[:, 1], p[:, 0]))]
    start = np.flatnonzero(np.concatenate(([True], (p[1:, :2] != p[:-1, :2]).any(axis=1)))) if len(p) else np.zeros(0, np.int64)
    return pa.RecordBatch.from_arrays([*(pa.array(np.ascontiguousarray(p[start, k])) for k in range(4)), pa.array(np.diff(np.append(start, len(p))))], names=_PAIR)


def _whole_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, j, h, at in _sets(batch.column(1)):
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array([h[at[k] : at[k + 1]].tobytes() for k in range(j - i)], pa.binary())], names=["id", "hashes"])


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        good = np.zeros(batch.num_rows, bool)
        for k, (x, y) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())):
            good[k] = _linked(x, y)
        yield pa.RecordBatch.from_arrays([c.filter(pa.array(good)) for c in batch.columns[:2]], names=["a", "b"])


def _forest(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Those links that join what was apart before them."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for x, y in zip(a.tolist(), b.tolist()):
        p, q = find(x), find(y)
        if p != q:
            root[max(p, q)] = min(p, q)
            out.append((min(x, y), max(x, y)))
    return out


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Shared values of every two sets, as dense products over runs of the values that repeat."""
    size = [len(s) for s in sets]
    value, row = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
    _, column, n = np.unique(value, return_inverse=True, return_counts=True)
    place = np.cumsum(n > 1) - 1
    many = n[column] > 1
    row, column = row[many], place[column[many]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    out, width = np.zeros((len(sets), len(sets)), np.float32), 4096
    for first in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        s, e = np.searchsorted(column, (first, first + width))
        block = np.zeros((len(sets), width), np.float32)
        block[row[s:e], column[s:e] - first] = 1
        out += block @ block.T
    return np.rint(out).astype(np.int64)


def _beside_pivot(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whether each document links with its family's pivot (or is it)."""
    for batch in batches:
        ids, pivots = batch.column(0).to_numpy(), batch.column(2).to_numpy()
        near = ids == pivots
        for k, (x, y) in enumerate(zip(batch.column(3).to_pylist(), batch.column(4).to_pylist())):
            if not near[k]:
                near[k] = _linked(x, y)
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(near)], names=["id", "family", "pivot", "near"])


def _linked(x: bytes, y: bytes) -> bool:
    """Whether two sorted sets share enough."""
    x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
    if 4 * min(len(x), len(y)) < 3 * max(len(x), len(y)):
        return False
    both = np.sort(np.concatenate((x, y)), kind="stable")
    return int((both[1:] == both[:-1]).sum()) >= least_overlap(len(x), len(y))


def _block_pair(key: tuple, table: pa.Table) -> pa.Table:
    ids, part = table.column("id").to_numpy(), table.column("part").to_numpy()
    sets = [np.frombuffer(x, np.uint64) for x in table.column("hashes").to_pylist()]
    n = np.array([len(s) for s in sets], np.int64)
    links = overlaps(sets) >= least_overlap(n[:, None], n[None, :])
    x, y = np.nonzero(np.triu(links, 1))
    if key[1].as_py() != key[2].as_py():
        cross = part[x] != part[y]
        x, y = x[cross], y[cross]
    found = _forest(ids[x], ids[y])
    return pa.table({"a": pa.array([p for p, _ in found], pa.int64()), "b": pa.array([q for _, q in found], pa.int64())})


# ---- Spark ----


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node in (a, b) rows: the smallest node that links reach. Alternating large
    and small stars; the edge list is written anew in each round."""
    edges = kept(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "edges")

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    seen = state(edges)
    done: list[DataFrame] = []

    def parted(df: DataFrame) -> DataFrame:
        """Large tables are written: Spark splits a hot centre's rows in a join of tables, not of aggregates."""
        if seen[0] <= MAX_BROADCAST_IDS:
            return df
        done.append(kept(df, "edges"))
        return done[-1]

    while seen[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = parted(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = parted(both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        least_of_large = parted(large.groupBy("u").agg(F.min("v").alias("m")))
        joined = large.join(least_of_large, "u")
        small = joined.select("u", F.col("m").alias("v")).unionByName(joined.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct()
        before, edges = edges, kept(small, "edges")
        discard(before, *done)
        done.clear()
        now = state(edges)
        if now == seen:
            break
        seen = now
    ends = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return ends.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component"))).groupBy("node").agg(F.min("component").alias("component"))


def _few(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= MAX_BROADCAST_IDS else df


def frequent_keys(texts: DataFrame, n: int, buckets: int) -> np.ndarray:
    """The most frequent shingles' keys in order, at most MOST_FREQUENT."""
    dealt = texts.select("text").mapInArrow(_deal_keys(buckets), "bucket int, keys binary").repartition(n, "bucket").sortWithinPartitions("bucket")
    counts = kept(dealt.mapInArrow(_count_keys, "key long, n long"), "frequent")
    least = FREQUENT
    while counts.filter(F.col("n") > least).count() > MOST_FREQUENT:
        least *= 2
    found = np.array(sorted(r[0] for r in counts.filter(F.col("n") > least).select("key").collect()), np.uint64)
    discard(counts)
    return found


def links(texts: DataFrame, shingles: int) -> DataFrame:
    """(a, b): links between class representatives, enough of them to connect what is connected.

    texts: (doc_id, text); shingles: about how many their sets have.
    """
    spark = texts.sparkSession
    n = max(shuffle_partitions(spark), -(-shingles * 12 // TASK_BYTES))
    buckets = 1 << (4 * n - 1).bit_length()
    frequent = spark.sparkContext.broadcast(frequent_keys(texts, n, buckets))
    matrix = texts.mapInArrow(_deal_prefixes(buckets, frequent), "bucket int, hashes binary, ids binary, sizes binary, digests binary")
    product = kept(matrix.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(_multiply, "a long, b long, na long, nb long, shared long"), "product")
    # shared is 0 in the rows of families
    lacking = "greatest({0} - {1}, {2} - {3})"
    prefix = "({0} - ceil(3 * {0} / 4) + 1 + floor({1} * {0}))"
    need = F.expr("ceil(3 * (na + nb) / 7) - " + lacking.format("na", prefix.format("na", EXTRA), "nb", prefix.format("nb", EXTRA)))
    pairs = product.filter("shared > 0").groupBy("a", "b", "na", "nb").agg(F.sum("shared").alias("shared")).filter(F.col("shared") >= need).select("a", "b")
    pairs = kept(pairs, "pairs")
    members = product.filter("shared = 0").select("a", "b")
    family = kept(components(members).select(F.col("node").alias("id"), F.col("component").alias("family")), "families")
    wanted = pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).unionByName(family.select(F.col("id").alias("doc_id"))).distinct()
    wanted = kept(wanted, "wanted")
    sets = kept(texts.join(_few(wanted), "doc_id", "left_semi").select("doc_id", "text").mapInArrow(_whole_sets, "id long, hashes binary"), "sets")
    left = pairs.join(sets.select(F.col("id").alias("a"), F.col("hashes").alias("x")), "a")
    full = left.join(sets.select(F.col("id").alias("b"), F.col("hashes").alias("y")), "b").select("a", "b", "x", "y")
    verified = full.mapInArrow(_verify, "a long, b long")
    with batch_rows(spark, PAIR_ROWS):
        out = kept(verified.unionByName(_family_links(family, members, sets)), "links")
    discard(product, pairs, family, wanted, sets)
    return out


def _family_links(family: DataFrame, members: DataFrame, sets: DataFrame) -> DataFrame:
    """Links in families, from (id, family), the (row's first, member) rows and (id, hashes)."""
    rows = members.groupBy(F.col("b").alias("id")).agg(F.count(F.lit(1)).alias("rows"))
    pivots = family.join(rows, "id").groupBy("family").agg(F.max_by("id", F.struct("rows", -F.col("id"))).alias("pivot"))
    pivots = kept(pivots.join(sets.select(F.col("id").alias("pivot"), F.col("hashes").alias("pivot_hashes")), "pivot"), "pivots")
    beside = family.join(sets, "id").join(pivots, "family").select("id", "family", "pivot", "hashes", "pivot_hashes")
    placed = kept(beside.mapInArrow(_beside_pivot, "id long, family long, pivot long, near boolean"), "placed")
    # blocks of those apart from the pivot: 0, 1, ...; of those connected with it: -1, -2, ...
    size = F.greatest(F.octet_length("hashes"), F.lit(FAMILY_BYTES // FAMILY_BLOCK))
    full = placed.join(sets, "id").select("id", "family", "near", "hashes")
    parts = lambda near: F.ceil(F.coalesce(F.sum(F.when(F.col("near") == near, size)), F.lit(0)) / FAMILY_BYTES).cast("int")
    sizes = kept(full.groupBy("family").agg(parts(False).alias("apart"), parts(True).alias("connected")).filter("apart > 0"), "sizes")
    full = full.join(sizes, "family")
    own = F.when(F.col("near"), -1 - F.pmod(F.xxhash64("id"), F.col("connected"))).otherwise(F.pmod(F.xxhash64("id"), F.col("apart"))).cast("int")
    others = F.when(F.col("near"), F.sequence(F.lit(0), F.col("apart") - 1)).otherwise(F.sequence(-F.col("connected"), F.col("apart") - 1))
    each = full.withColumn("part", own).withColumn("other", F.explode(others))
    dealt = each.select("family", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "id", "part", "hashes")
    blocks = dealt.groupBy("family", "i", "j").applyInArrow(_block_pair, "a long, b long")
    return placed.filter("near and id <> pivot").select(F.least("id", "pivot").alias("a"), F.greatest("id", "pivot").alias("b")).unionByName(blocks)


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row."""
    texts = docs.select(column(id_col).cast("long").alias("doc_id"), column(text_col).alias("text"))
    with batch_rows(docs.sparkSession, TEXT_ROWS):
        profile = kept(texts.mapInArrow(_profile, "doc_id long, n_shingles long, high long, low long"), "profile")
        total = profile.agg(F.sum("n_shingles")).first()[0] or 0
        linked = links(texts.filter("doc_id is not null"), total)
        found = kept(components(linked), "components")
    classes = profile.filter("n_shingles > 0").groupBy("high", "low").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("copies")).filter("copies > 1").drop("copies")
    # a table of its own, so that Spark can split the rows of a text with very many copies in the join
    classes = kept(classes, "classes")
    first = F.when(F.col("n_shingles") > 0, F.least("first", "doc_id")).otherwise(F.col("doc_id"))
    named = profile.join(classes, ["high", "low"], "left").select("doc_id", "n_shingles", first.alias("first"))
    out = named.join(found, F.col("first") == F.col("node"), "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "first")).alias("component_id"))
