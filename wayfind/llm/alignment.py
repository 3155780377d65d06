"""Alignment of two tokenisations of the same texts by galloping intersection of their tokens' end offsets.

Tokeniser A is a byte-level BPE, B a piece BPE with byte fallback. The ascending end offsets of the two are intersected:
each end of the shorter list is looked up in the longer one, by steps that double from a guess and then by binary
search, all ends in lockstep. The common ends cut both token lists into groups; the differences of their ranks are the
groups' sizes, so a group's A tokens and B tokens are ranges of the two lists. All A-B pairs of a group are links.

Neither vocabulary has a token that continues over a space after a visible character, so texts are cut there, both
tokenisers and the alignment work on chunks, and each distinct chunk is aligned once while a worker's cache lasts. The
number of documents that link a pair of ids is a grouped count of each document's distinct pairs. The most frequent
pairs (``frequent``, 2^20 at most) are looked up in a broadcast; those beyond are rare by construction and meet their
counts in a shuffle join, so that no key of that join is hot. Nothing is dropped: the two sums are added.

Defined cases: null and empty texts, texts that are no UTF-8, and texts that the tokens of A or B do not spell out (those
with U+2581) have no tokens; repeated rows and null ids are documents of their own; an empty table gives no rows; columns
other than id and text are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfind.llm import packing, textnum
from wayfind.llm.common import column, kept

BATCH_BYTES = 1 << 20
#: Pairs that are looked up in a broadcast (20 bytes each); the others are joined.
FREQUENT = 1 << 20
#: A worker forgets its chunks beyond so many links.
CACHED_LINKS = 1_000_000
#: Links that are made at a time; the pairs of a larger group are made of its distinct ids.
LINKS = 1 << 20
FACTS = "key long, id {id}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<long>"
_RANGE = np.int64(1) << 32


def gallop(short: np.ndarray, long: np.ndarray) -> np.ndarray:
    """Where long holds each element of short, or -1. Both ascend strictly.

    From a guess in proportion, steps that double bracket each element, then binary search narrows the bracket.
    """
    n = len(long)
    if not n or not len(short):
        return np.full(len(short), -1, np.int64)
    guess = np.arange(len(short)) * n // len(short)
    # invariant: long[low] < short <= long[high], with -infinity and infinity beyond the ends
    low, high = np.full(len(short), -1, np.int64), np.full(len(short), n, np.int64)
    ahead = long[guess] < short
    for rows, sign in ((np.flatnonzero(ahead), 1), (np.flatnonzero(~ahead), -1)):
        at, step = guess[rows], 1
        (low if sign > 0 else high)[rows] = at
        while len(rows):
            at = at + sign * step
            inside = (at >= 0) & (at < n)
            rows, at = rows[inside], at[inside]
            on = (long[at] < short[rows]) == (sign > 0)
            (high if sign > 0 else low)[rows[~on]] = at[~on]
            rows, at = rows[on], at[on]
            (low if sign > 0 else high)[rows] = at
            step *= 2
    rows = np.flatnonzero(high - low > 1)
    while len(rows):
        mid = (low[rows] + high[rows]) >> 1
        below = long[mid] < short[rows]
        low[rows[below]], high[rows[~below]] = mid[below], mid[~below]
        rows = rows[high[rows] - low[rows] > 1]
    return np.where((high < n) & (long[np.minimum(high, n - 1)] == short), high, -1)


def common_ends(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranks in a and b of the ends that both have; the shorter list drives the search."""
    if len(a) > len(b):
        return common_ends(b, a)[::-1]
    found = gallop(a, b)
    own = np.flatnonzero(found >= 0)
    return own, found[own]


def _linked(ids_a: np.ndarray, ids_b: np.ndarray, ends_a: np.ndarray, ends_b: np.ndarray, group_owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, pair, times) of the distinct id pairs that each owner's groups link; ends are the groups' end ranks."""
    size_a, size_b = np.diff(ends_a, prepend=0), np.diff(ends_b, prepend=0)
    links, out = size_a * size_b, []
    if not len(links):
        return (np.zeros(0, np.int64),) * 3
    at, total = 0, np.cumsum(links)
    while at < len(links):
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + LINKS, side="right")))
        if links[at] > LINKS:
            to = at + 1
            a, na = np.unique(ids_a[ends_a[at] - size_a[at] : ends_a[at]], return_counts=True)
            b, nb = np.unique(ids_b[ends_b[at] - size_b[at] : ends_b[at]], return_counts=True)
            rows = max(1, LINKS // len(b))
            for i in range(0, len(a), rows):
                out.append((np.full(len(a[i : i + rows]) * len(b), group_owner[at]), (a[i : i + rows, None] * _RANGE + b).ravel(), np.outer(na[i : i + rows], nb).ravel()))
        else:
            n = links[at:to]
            k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            wide = np.repeat(size_b[at:to], n)
            a = ids_a[np.repeat((ends_a - size_a)[at:to], n) + k // wide]
            b = ids_b[np.repeat((ends_b - size_b)[at:to], n) + k % wide]
            out.append((np.repeat(group_owner[at:to], n), a * _RANGE + b, np.ones(len(k), np.int64)))
        at = to
    return _summed(*(np.concatenate(x) for x in zip(*out)))


def _summed(owner: np.ndarray, pair: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of the same owner and pair added up, by owner, then pair."""
    if not len(owner):
        return owner, pair, times
    order = np.lexsort((pair, owner))
    owner, pair, times = owner[order], pair[order], times[order]
    first = np.flatnonzero(np.append(True, (owner[1:] != owner[:-1]) | (pair[1:] != pair[:-1])))
    return owner[first], pair[first], np.add.reduceat(times, first)


def _spelled(tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The tokens' bytes one after another, and their offsets."""
    return np.frombuffer(b"".join(tokens), np.uint8), np.concatenate(([0], np.cumsum([len(t) for t in tokens]))).astype(np.int64)


class Tokens:
    """One tokeniser's ids of chunks and the bytes that each id stands for."""

    def __init__(self, encode, spelling: list[bytes]):
        self.encode = encode
        self.bytes, self.off = _spelled(spelling)
        self.width = np.diff(self.off)

    def of(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all chunks, each chunk's number of ids, and whether its ids spell it out."""
        ids, count = self.encode(data, start, end)
        ids = ids.astype(np.int64)
        width = self.width[ids]
        spelled = np.concatenate(([0], np.cumsum(width)))[np.concatenate(([0], np.cumsum(count)))]
        good = np.diff(spelled) == end - start
        # the bytes of those with the right length, one by one
        chunk, token = np.repeat(np.arange(len(count)), count), np.flatnonzero(np.repeat(good, count))
        w = width[token]
        k = np.arange(w.sum()) - np.repeat(np.cumsum(w) - w, w)
        within = (np.cumsum(width) - width)[token] - spelled[chunk[token]]
        same = self.bytes[np.repeat(self.off[ids[token]], w) + k] == data[np.repeat(start[chunk[token]] + within, w) + k]
        good[np.repeat(chunk[token], w)[~same]] = False
        return ids, count, good


def byte_level(vocabulary: str, ranks: str) -> Tokens:
    """Ids of a byte-level BPE, given as a tokenizers file and as tiktoken ranks."""
    import base64

    exact = packing.Tokeniser(vocabulary, ranks)
    table = {int(b): base64.b64decode(a) for a, b in map(bytes.split, open(ranks, "rb"))}
    return Tokens(exact._encode_chunks, [table.get(i, b"") for i in range(exact.exact.get_vocab_size())])


def pieces(model: str) -> Tokens:
    """Ids of a sentencepiece model that adds a space before each text: a chunk is encoded without its first space."""
    import sentencepiece

    found = sentencepiece.SentencePieceProcessor(model_file=model)
    names = [found.id_to_piece(i) for i in range(found.get_piece_size())]
    assert not any(re.search("[^▁]▁", n) for n in names), "a piece goes on over a space: chunks would not be exact"
    spelling = [bytes([int(n[3:5], 16)]) if found.is_byte(i) else n.replace("▁", " ").encode() for i, n in enumerate(names)]

    def encode(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        raw = data.tobytes()
        ids = found.encode([raw[s + 1 : e].decode("utf-8", "replace") for s, e in zip(start.tolist(), end.tolist())], num_threads=1)
        return np.array([i for x in ids for i in x], np.int64), np.array([len(x) for x in ids], np.int64)

    return Tokens(encode, spelling)


@dataclass
class _Known:
    """What is known of chunks, by sorted hash: rows of numbers, their links and their groups as text."""

    hash: np.ndarray
    row: np.ndarray
    numbers: np.ndarray  # n_a, n_b, n_groups, n_links, whether spelled out
    links: np.ndarray  # offsets into pair and times
    pair: np.ndarray
    times: np.ndarray
    text: list[str]


class Aligner:
    def __init__(self, a: Tokens, b: Tokens):
        self.a, self.b = a, b
        self.forget()

    def forget(self) -> None:
        z = np.zeros(0, np.int64)
        self.known = _Known(np.zeros(0, np.uint64), z, np.zeros((0, 5), np.int64), np.zeros(1, np.int64), z, z, [])

    def _learn(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, h: np.ndarray) -> None:
        """Tokenise and align chunks that are not known yet."""
        n, known = len(start), self.known
        ids_a, count_a, good_a = self.a.of(data, start, end)
        ids_b, count_b, good_b = self.b.of(data, start, end)
        good = good_a & good_b
        ids_a, ids_b = ids_a[np.repeat(good, count_a)], ids_b[np.repeat(good, count_b)]
        count_a, count_b = count_a * good, count_b * good
        # all chunks' ends in one ascending list: chunks stand one after another
        rank_a, rank_b = common_ends(np.cumsum(self.a.width[ids_a]), np.cumsum(self.b.width[ids_b]))
        owner = np.repeat(np.arange(n), count_a)[rank_a]
        rank_a, rank_b = rank_a + 1, rank_b + 1
        who, pair, times = _linked(ids_a, ids_b, rank_a, rank_b, owner)
        groups, links = np.bincount(owner, minlength=n), np.zeros(n, np.int64)
        np.add.at(links, owner, np.diff(rank_a, prepend=0) * np.diff(rank_b, prepend=0))
        text_a, text_b = list(map(str, ids_a.tolist())), list(map(str, ids_b.tolist()))
        told, i, j = [], 0, 0
        for x, y in zip(rank_a.tolist(), rank_b.tolist()):
            told.append(f"{','.join(text_a[i:x])}|{','.join(text_b[j:y])}")
            i, j = x, y
        cut = np.concatenate(([0], np.cumsum(groups))).tolist()
        numbers = np.stack([count_a, count_b, groups, links, good.astype(np.int64)], 1)
        order = np.argsort(h)
        k = np.searchsorted(known.hash, h[order])
        self.known = _Known(
            np.insert(known.hash, k, h[order]),
            np.insert(known.row, k, len(known.text) + order),
            np.concatenate((known.numbers, numbers)),
            np.concatenate((known.links, known.links[-1] + np.cumsum(np.bincount(who, minlength=n)))),
            np.concatenate((known.pair, pair)),
            np.concatenate((known.times, times)),
            known.text + [";".join(told[x:y]) for x, y in zip(cut, cut[1:])],
        )

    def align(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Of each text (which begins with the added space): n_a, n_b, n_groups, n_links and whether tokens spell it out;
        its groups as text; the owners, pairs and times of all links."""
        docs, n = len(off) - 1, len(data)
        cut = np.zeros(n, bool)
        # a space after a visible character, unless it is the text's last byte
        cut[1:] = (data[1:] == 32) & (data[:-1] > 32) & (data[:-1] < 127)
        cut[off[1:] - 1] = False
        cut[off[:-1]] = True
        start = np.flatnonzero(cut)
        end = np.append(start[1:], n)
        h, first, back = np.unique(textnum.span_hashes(data, start, end), return_index=True, return_inverse=True)
        if len(self.known.pair) > CACHED_LINKS:
            self.forget()
        at = np.searchsorted(self.known.hash, h)
        hit = np.append(self.known.hash, np.uint64(0))[at] == h
        hit[at == len(self.known.hash)] = False
        new = np.flatnonzero(~hit)
        if len(new):
            self._learn(data, *(x[np.sort(first[new])] for x in (start, end)), h[new[np.argsort(first[new])]])
        known = self.known
        row = known.row[np.searchsorted(known.hash, h)][back]
        doc = np.searchsorted(off, start, side="right") - 1
        numbers = np.stack([np.bincount(doc, weights=known.numbers[row, i], minlength=docs) for i in range(4)], 1).astype(np.int64)
        good = np.ones(docs, bool)
        good[doc[known.numbers[row, 4] == 0]] = False
        numbers[~good] = 0
        at = np.concatenate(([0], np.cumsum(np.bincount(doc, minlength=docs)))).tolist()
        rows = row.tolist()
        told = [";".join([known.text[r] for r in rows[i:j]]) if ok else "" for i, j, ok in zip(at, at[1:], good.tolist())]
        # a document's repeated chunks count once here
        keep = good[doc]
        each, times = np.unique(doc[keep] * (len(known.text) + 1) + row[keep], return_counts=True)
        who, each = np.divmod(each, len(known.text) + 1)
        m = known.links[each + 1] - known.links[each]
        k = np.repeat(known.links[each] - (np.cumsum(m) - m), m) + np.arange(m.sum())
        return numbers, told, *_summed(np.repeat(who, m), known.pair[k], known.times[k] * np.repeat(times, m))


_aligners: dict[tuple, Aligner] = {}


def aligner_of(a: tuple[str, str], b: str) -> Aligner:
    """One aligner, with its chunks, for all tasks of a Python worker."""
    if (a, b) not in _aligners:
        _aligners[a, b] = Aligner(byte_level(*a), pieces(b))
    return _aligners[a, b]


def public_models() -> tuple[tuple[str, str], str]:
    import public_tokenizers

    return packing.public_vocabulary(), public_tokenizers.path("piece_bpe_32k.model")


def _spaced(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same texts with a space before each."""
    docs = len(off) - 1
    out = np.full(len(data) + docs, 32, np.uint8)
    out[np.arange(len(data)) + np.repeat(np.arange(1, docs + 1), np.diff(off))] = data
    return out, off + np.arange(docs + 1)


def facts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", a: tuple[str, str] | None = None, b: str | None = None) -> DataFrame:
    """One row of every document (``FACTS``): its token and group numbers, the digest of its groups, its distinct pairs
    of linked ids (A id * 2^32 + B id) and how many links each has. key tells rows apart."""
    if a is None:
        a, b = public_models()
    names = [x.split()[0] for x in FACTS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = aligner_of(a, b)
        for batch in textnum.slices(batches, 2, BATCH_BYTES):
            data, off = textnum.view(batch.column(2))
            empty = np.diff(off) == 0
            numbers, told, who, pair, times = aligner.align(*_spaced(data, off))
            numbers[empty] = 0
            digest = ["" if not g or e else hashlib.sha256(g.encode()).hexdigest() for g, e in zip(told, empty.tolist())]
            keep = ~empty[who]
            cut = np.concatenate(([0], np.cumsum(np.bincount(who[keep], minlength=batch.num_rows)))).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(cut), pa.array(x[keep])) for x in (pair, times)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(x) for x in numbers.T), pa.array(digest, pa.string()), *lists], names=names)

    rows = df.select(F.monotonically_increasing_id().alias("key"), column(id_col).alias("id"), column(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(run, FACTS.format(id=dict(rows.dtypes)["id"]))


def pair_counts(found: DataFrame) -> DataFrame:
    """(pair, count, best): how many documents link each pair, and whether no pair of its A id has more."""
    counts = kept(found.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("count")), "pairs")
    # one row for each id of A's vocabulary at most
    most = counts.groupBy(F.shiftright("pair", 32).alias("_a")).agg(F.max("count").alias("_most"))
    joined = counts.join(F.broadcast(most), F.shiftright("pair", 32) == F.col("_a"))
    return kept(joined.select("pair", "count", (F.col("count") == F.col("_most")).alias("best")), "pair-counts")


def _least_frequent(counts: DataFrame, frequent: int) -> int:
    """The smallest power of two such that at most so many pairs have this count or more."""
    # a row for each power of two
    sizes = dict(counts.groupBy(F.length(F.bin("count")).alias("bits")).count().collect())
    bits, total = max(sizes, default=0) + 1, 0
    while bits > 1 and total + sizes.get(bits - 1, 0) <= frequent:
        bits, total = bits - 1, total + sizes.get(bits - 1, 0)
    return 1 << (bits - 1)


def scored(found: DataFrame, counts: DataFrame, frequent: int = FREQUENT) -> DataFrame:
    """facts with n_best and count_sum."""
    spark, least = found.sparkSession, _least_frequent(counts, frequent)
    top = counts.filter(F.col("count") >= least).toArrow().sort_by("pair")
    shared = spark.sparkContext.broadcast(tuple(top[c].to_numpy() for c in ("pair", "count", "best")))
    plain = ["key", "id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, count, best = shared.value
        for batch in batches:
            pairs, times = batch.column(7), batch.column(8)
            cut = pairs.offsets.to_numpy().astype(np.int64)
            p, t = pairs.values.to_numpy()[cut[0] : cut[-1]], times.values.to_numpy()[cut[0] : cut[-1]]
            who = np.repeat(np.arange(batch.num_rows), np.diff(cut))
            k = np.minimum(np.searchsorted(known, p), max(len(known) - 1, 0))
            hit = known[k] == p if len(known) else np.zeros(len(p), bool)
            sums, firsts = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            np.add.at(sums, who[hit], t[hit] * count[k[hit]])
            np.add.at(firsts, who[hit], t[hit] * best[k[hit]])
            rest = np.concatenate(([0], np.cumsum(np.bincount(who[~hit], minlength=batch.num_rows)))).astype(np.int32)
            rare = [pa.ListArray.from_arrays(pa.array(rest), pa.array(x[~hit])) for x in (p, t)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:7], pa.array(firsts), pa.array(sums), *rare], names=[*plain, "n_best", "count_sum", "pairs", "times"])

    kind = dict(found.dtypes)["id"]
    schema = f"key long, id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long, pairs array<long>, times array<long>"
    looked = found.select(*plain, "pairs", "times").mapInArrow(run, schema)
    if least <= 1:
        return looked.drop("pairs", "times")
    looked = kept(looked, "looked-up")
    rare = looked.select("key", F.explode(F.arrays_zip("pairs", "times")).alias("z")).select("key", "z.pairs", "z.times")
    rare = rare.join(counts.filter(F.col("count") < least), rare.pairs == counts.pair)
    more = rare.groupBy("key").agg(F.sum(F.col("times") * F.col("count")).alias("_sum"), F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("_best"))
    added = looked.drop("pairs", "times").join(more, "key", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return added.select(*plain, (F.col("n_best") + zero("_best")).alias("n_best"), (F.col("count_sum") + zero("_sum")).alias("count_sum"))


def report(df: DataFrame, frequent: int = FREQUENT) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every document."""
    found = kept(facts(df), "alignment")
    rows = scored(found, pair_counts(found), frequent)
    return rows.select(F.col("id").alias("doc_id"), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
