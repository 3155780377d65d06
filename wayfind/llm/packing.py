"""Vector bin packing of tokenised examples into fixed-length training sequences.

Every example has a demand vector (tokens, one segment, loss-bearing tokens) and every sequence a capacity
vector. A sequence is filled from a bounded pool of waiting pieces: of those that still fit, the piece whose
demand has the largest dot product with the remaining capacity goes in, both scaled by the capacity. Whole
multiples of the sequence length are cut off first and stand alone. Where nothing fits and at least
``min_cut`` tokens are free, a waiting piece is cut. Each task packs its own input partition with a pool of
fixed size, so no shuffle is needed and nothing gathers.

Defined cases: null and empty texts count as the end token alone; repeated rows are packed as often as they
occur; null ids are carried along; bytes that are no UTF-8 count as U+FFFD; an empty table gives no rows; columns
other than the id and text are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfind.llm import textnum
from wayfind.llm.common import column, kept

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, segment int, loss_tokens long"
BATCH_BYTES = 2 << 20
#: The chunk cache of a worker is emptied beyond this size (some 40 bytes each).
CACHED_CHUNKS = 500_000
_FIELDS = [x.split()[0] for x in PIECES.split(", ")]
_ARROW = pa.schema([(n, pa.int32() if n == "segment" else pa.int64()) for n in _FIELDS])


class Tokeniser:
    """Ids of byte-level BPE texts. Texts are cut before white space that follows a visible character, which
    no pre-token of this vocabulary spans; each distinct chunk is encoded once, as long as it is cached."""

    def __init__(self, vocabulary: str, ranks: str | None = None):
        from tokenizers import Tokenizer

        self.exact = Tokenizer.from_file(vocabulary)
        self.exact.encode_special_tokens = True
        self.fast = None
        self._forget()
        if ranks:
            import base64

            import public_tokenizers
            import tiktoken

            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(ranks, "rb"))}
            self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
            self.width = np.zeros(max(table.values()) + 1, np.int64)
            for k, v in table.items():
                self.width[v] = len(k)

    def _chunks(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the chunks; no chunk crosses documents."""
        n = len(data)
        blank = (data == 32) | (data == 10)
        visible = (data > 32) & (data < 127)
        # the second byte of U+00C0..U+00FF is visible too
        visible[1:] |= (data[1:] >= 128) & (data[:-1] == 0xC3)
        cut = np.zeros(n, bool)
        cut[1:] = blank[1:] & visible[:-1]
        begin = off[:-1][off[:-1] < off[1:]]
        cut[begin] = True
        start = np.flatnonzero(cut)
        return start, np.append(start[1:], n)

    def encode(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another, and each document's number of ids."""
        docs = len(off) - 1
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(docs, np.int64)
        start, end = self._chunks(data, off)
        h, first, back = np.unique(textnum.span_hashes(data, start, end), return_index=True, return_inverse=True)
        at, size = self._found(h)
        new = np.flatnonzero(size < 0)
        if len(new):
            at[new], size[new] = self._learn(h[new], *self._encode_chunks(data, start[first[new]], end[first[new]]))
        n = size[back]
        ids = self.pool[np.repeat(at[back] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        doc = np.searchsorted(off, start, side="right") - 1
        counts = np.bincount(doc, weights=n, minlength=docs).astype(np.int64)
        if len(self.known) > CACHED_CHUNKS:
            self._forget()
        return ids, counts

    def _forget(self) -> None:
        self.known, self.at, self.size, self.pool = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def _found(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at, size = np.zeros(len(h), np.int64), np.full(len(h), -1, np.int64)
        if len(self.known):
            k = np.minimum(np.searchsorted(self.known, h), len(self.known) - 1)
            hit = self.known[k] == h
            at[hit], size[hit] = self.at[k[hit]], self.size[k[hit]]
        return at, size

    def _learn(self, h: np.ndarray, ids: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = len(self.pool) + np.cumsum(size) - size
        self.pool = np.concatenate((self.pool, ids))
        k = np.searchsorted(self.known, h)
        self.known, self.at, self.size = np.insert(self.known, k, h), np.insert(self.at, k, at), np.insert(self.size, k, size)
        return at, size

    def _encode_chunks(self, data: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the chunks [s, e), one after another, and each chunk's number of ids."""
        raw = data.tobytes()
        # bytes that are not ASCII or a whole character of two bytes up to U+00FF
        lead, inner = (data == 0xC2) | (data == 0xC3), (data & 0xC0) == 0x80
        wide = (data >= 128) & ~lead
        wide[1:] &= ~(inner[1:] & lead[:-1])
        wide |= lead & ~np.append(inner[1:], False)
        wide = np.concatenate((np.zeros(1, np.int32), np.cumsum(wide, dtype=np.int32)))
        last, before = data[e - 1], data[np.maximum(e - 2, s)]
        blank = (data[s] == 32) | (data[s] == 10)
        joined = blank & (((last > 32) & (last < 127)) | ((last >= 128) & (before == 0xC3))) & (wide[e] == wide[s])
        if self.fast is None:
            joined[:] = False
        one, rest = np.flatnonzero(joined), np.flatnonzero(~joined)
        size = np.zeros(len(s), np.int64)
        groups = [np.zeros(0, np.uint32)]
        if len(one):
            text = b"".join([raw[a:b] for a, b in zip(s[one].tolist(), e[one].tolist())]).decode()
            ids = np.array(self.fast.encode_ordinary(text), np.uint32)
            size[one] = np.diff(np.searchsorted(np.cumsum(self.width[ids]), np.cumsum(e[one] - s[one]), side="right"), prepend=0)
            groups.append(ids)
        for i in range(0, len(rest), 4096):
            k = rest[i : i + 4096]
            found = [x.ids for x in self.exact.encode_batch([raw[a:b].decode("utf-8", "replace") for a, b in zip(s[k].tolist(), e[k].tolist())], add_special_tokens=False)]
            size[k] = [len(x) for x in found]
            groups.append(np.array([y for x in found for y in x], np.uint32))
        ids = np.concatenate(groups)
        order = np.concatenate((one, rest))
        at = np.zeros(len(s), np.int64)
        at[order] = np.cumsum(size[order]) - size[order]
        return ids[np.repeat(at - (np.cumsum(size) - size), size) + np.arange(size.sum())], size


_tokenisers: dict[tuple, Tokeniser] = {}


def tokeniser_of(vocabulary: str, ranks: str | None) -> Tokeniser:
    """One tokeniser, with its chunk cache, for all tasks of a Python worker."""
    if (vocabulary, ranks) not in _tokenisers:
        _tokenisers[vocabulary, ranks] = Tokeniser(vocabulary, ranks)
    return _tokenisers[vocabulary, ranks]


class Packer:
    """Fills sequences from a pool of at most ``pool`` waiting pieces: (tokens, loss tokens, payload)."""

    def __init__(self, tokens: int, segments: int, loss: int, pool: int = 256, min_cut: int = 16):
        self.capacity = (tokens, segments, loss)
        self.pool, self.min_cut = pool, min_cut
        self.tokens, self.loss = np.zeros(pool + 1, np.int64), np.zeros(pool + 1, np.int64)
        self.payload: list = []

    def _drop(self, k: int) -> None:
        n = len(self.payload) - 1
        self.tokens[k], self.loss[k], self.payload[k] = self.tokens[n], self.loss[n], self.payload[n]
        self.payload.pop()

    def add(self, tokens: int, loss: int, payload) -> list | None:
        """The finished sequence, if the pool was full: (payload, tokens, loss tokens) of each piece."""
        n = len(self.payload)
        self.tokens[n], self.loss[n] = tokens, loss
        self.payload.append(payload)
        return self.fill() if n >= self.pool else None

    def fill(self) -> list:
        (most, segments, most_loss), out = self.capacity, []
        left, left_loss = most, most_loss
        while self.payload and left and len(out) < segments:
            n = len(self.payload)
            t, m = self.tokens[:n], self.loss[:n]
            # dot product of demand and remaining capacity; the segment's share is the same for every piece
            value = t * (left / most**2) + m * (left_loss / most_loss**2)
            value[(t > left) | (m > left_loss)] = -1
            k = int(value.argmax())
            take, loss = int(t[k]), int(m[k])
            if value[k] >= 0:
                out.append((self.payload[k], take, loss))
                self._drop(k)
                left, left_loss = left - take, left_loss - loss
                continue
            k = int(t.argmax())
            take = min(left, int(t[k]) - 1)
            # loss-bearing tokens stand at an example's end
            loss = max(0, int(m[k]) - (int(t[k]) - take))
            if left >= self.min_cut and take >= 1 and loss <= left_loss:
                out.append((self.payload[k], take, loss))
                t[k], m[k] = t[k] - take, m[k] - loss
            break
        return out


def public_vocabulary() -> tuple[str, str]:
    """The 50k byte-level BPE as a tokenizers file and as tiktoken ranks."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


def token_counts(df: DataFrame, columns: list[str], text_col: str = "text", vocabulary: str | None = None, ranks: str | None = None) -> DataFrame:
    """These columns and n_tokens, the number of ids of each text (0 for null)."""
    if vocabulary is None:
        vocabulary, ranks = public_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokeniser = tokeniser_of(vocabulary, ranks)
        for batch in textnum.slices(batches, len(columns), BATCH_BYTES):
            _, count = tokeniser.encode(*textnum.view(batch.column(len(columns))))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(count)], names=[*columns, "n_tokens"])

    kinds = dict(df.dtypes)
    return df.select(*map(column, columns), column(text_col).alias("text")).mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in columns) + ", n_tokens long")


def pack_conversations(turns: DataFrame, tokens: int = 1024, segments: int = 16, loss: int = 768) -> DataFrame:
    """Instruction data: whole conversations into sequences under limits on tokens, conversations and the tokens
    that bear loss, which are those of the assistant's turns. turns: conv_id, role, text.

    (conv_id, n_tokens, n_loss, sequence_id, offset, segment); a turn ends in one more token. Turns without a conv_id are one
    conversation; null texts count as the end token alone.
    """
    counted = token_counts(turns, ["conv_id", "role"])
    size = F.col("n_tokens") + 1
    sums = counted.groupBy("conv_id").agg(F.sum(size).alias("n_tokens"), F.sum(F.when(F.col("role") == "assistant", size).otherwise(0)).alias("n_loss"))
    placed = pack_lengths(sums, "conv_id", "n_tokens", "n_loss", tokens, segments, loss)
    return placed.withColumnRenamed("id", "conv_id")


def pack_texts(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    vocabulary: str | None = None,
    ranks: str | None = None,
    end_id: int = 0,
    tokens: int = 1024,
    segments: int = 128,
    loss: int = 1024,
    pool: int = 256,
    min_cut: int = 16,
) -> DataFrame:
    """Tokenise and pack every text, with ``end_id`` after each. One row per piece (``PIECES``).

    ``vocabulary`` is a tokenizers file; ``ranks``, if given, the same vocabulary as tiktoken ranks, used for
    chunks of ASCII and Latin-1 text. By default both are the public 50k byte-level BPE. In plain text every
    token bears loss.
    """
    if vocabulary is None:
        vocabulary, ranks = public_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokeniser, packer = tokeniser_of(vocabulary, ranks), Packer(tokens, segments, loss, pool, min_cut)
        sequence = TaskContext.get().partitionId() << 40
        rows: list[tuple] = []

        def close(filled: list) -> None:
            nonlocal sequence
            at = 0
            for k, (piece, take, bearing) in enumerate(filled):
                doc, start, ids, total = piece
                rows.append((doc, start, take, zlib.crc32(ids[:take].tobytes()), total, sequence, at, k, bearing))
                piece[1], piece[2] = start + take, ids[take:]
                at += take
            sequence += 1

        def flush() -> Iterator[pa.RecordBatch]:
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), _ARROW.types)], schema=_ARROW)
                rows.clear()

        for batch in batches:
            data, off = textnum.view(batch.column(1))
            names = batch.column(0).to_pylist()
            for i, j in textnum.parts(off, BATCH_BYTES):
                ids, count = tokeniser.encode(data[off[i] : off[j]], off[i : j + 1] - off[i])
                at = 0
                for doc, n in zip(names[i:j], count.tolist()):
                    own = np.append(ids[at : at + n], np.uint32(end_id)).astype("<u4")
                    at += n
                    total, whole = n + 1, (n + 1) // tokens * tokens if tokens <= loss else 0
                    for k in range(0, whole, tokens):
                        close([([doc, k, own[k : k + tokens], total], tokens, tokens)])
                    for k in range(whole, total, tokens):
                        piece = own[k : k + tokens].copy()
                        if filled := packer.add(len(piece), len(piece), [doc, k, piece, total]):
                            close(filled)
                yield from flush()
        while packer.payload:
            close(packer.fill())
        yield from flush()

    return df.select(column(id_col).cast("long").alias("doc_id"), column(text_col).alias("text")).mapInArrow(run, PIECES)


def pack_lengths(df: DataFrame, id_col: str, tokens_col: str, loss_col: str, tokens: int, segments: int, loss: int, pool: int = 256) -> DataFrame:
    """Place instruction examples whole (no cuts): rows (id, n_tokens, n_loss, sequence_id, offset, segment).

    An example over a limit on its own stands alone in a sequence; null lengths count as 0.
    """
    name = dict(df.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(tokens, segments, loss, pool, min_cut=tokens + 1)
        sequence = TaskContext.get().partitionId() << 40
        rows: list[tuple] = []

        def close(filled: list) -> None:
            nonlocal sequence
            at = 0
            for k, (example, take, bearing) in enumerate(filled):
                rows.append((example, take, bearing, sequence, at, k))
                at += take
            sequence += 1

        for batch in batches:
            for example, n, m in zip(*(c.to_pylist() for c in batch.columns)):
                n, m = n or 0, m or 0
                if n > tokens or m > loss:
                    close([(example, n, m)])
                elif filled := packer.add(n, m, example):
                    close(filled)
            while len(rows) > 50_000:
                yield _placed(rows, batch.schema.field(0).type)
                rows.clear()
        while packer.payload:
            close(packer.fill())
        if rows:
            yield _placed(rows, batch.schema.field(0).type)

    return df.select(column(id_col).alias("id"), column(tokens_col).cast("long"), column(loss_col).cast("long")).mapInArrow(run, f"id {name}, n_tokens long, n_loss long, sequence_id long, offset long, segment int")


def _placed(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    types = (kind, pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32())
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), types)], names=["id", "n_tokens", "n_loss", "sequence_id", "offset", "segment"])
