"""Language identification: multinomial naive Bayes over hashed character n-grams.

n-grams of 1 to 3 characters (letters, lower case where one character stays one; anything else counts as one
space) fall into a fixed number of buckets. Training counts every labelled text in its own task and adds the
counts up by language and bucket; the matrix of log probabilities (buckets x languages, so bounded) is
broadcast, and a batch is scored by gathering its rows and adding them up by document.

Defined cases: a null text and a text without letters are ``und`` with score 0; so is every text if no
labelled row exists; rows with a null language do not train; repeated rows train as often as they occur;
bytes that are no UTF-8 count as U+FFFD; null ids are carried along; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfind.llm import textnum
from wayfind.llm.common import column

#: The model has so many rows of one float for each language; the number never depends on the data.
BUCKETS = 1 << 15
SIZES = (1, 2, 3)
#: A text's evidence counts as that of at most this many n-grams in its score, not in its prediction.
EVIDENCE = 40
_FOLDED = 0x250
_LOW = np.array([ord(c.lower()) if (c := chr(i)).isalpha() and len(c.lower()) == 1 else i if c.isalpha() else 32 for i in range(_FOLDED)], np.uint32)
_STEP = np.uint32(0x9E3779B1)


@dataclass
class Model:
    languages: list[str]
    matrix: np.ndarray  # buckets x languages, log probabilities
    prior: np.ndarray


def _valid(raw: bytes, off: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The texts with U+FFFD for bytes that are no UTF-8."""
    inner = (np.frombuffer(raw, np.uint8)[off[:-1][off[:-1] < off[1:]]] & 0xC0) == 0x80
    try:
        if not inner.any():
            raw.decode()
            return raw, off
    except UnicodeDecodeError:
        pass
    own = [raw[i:j].decode("utf-8", "replace").encode() for i, j in zip(off[:-1].tolist(), off[1:].tolist())]
    return b"".join(own), np.cumsum([0, *map(len, own)])


def grams(raw: bytes, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets and documents of all n-grams, and whether each document has a letter."""
    raw, off = _valid(raw, off)
    chars = np.frombuffer(raw.decode().encode("utf-32-le"), np.uint32)
    lead = np.concatenate(([0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)))
    at = lead[off]
    wide = chars >= _FOLDED
    c = _LOW[np.where(wide, 32, chars)]
    if wide.any():
        c[wide] = chars[wide]
    letter = textnum.doc_sums((c != 32) & ~wide, at) > 0
    for d in np.flatnonzero(~letter & (textnum.doc_sums(wide, at) > 0)):
        letter[d] = any(chr(x).isalpha() for x in chars[at[d] : at[d + 1]])
    doc = np.repeat(np.arange(len(off) - 1), np.diff(at))
    h = np.zeros(len(c), np.uint32)
    buckets, docs = [], []
    with np.errstate(over="ignore"):
        for n in range(1, max(SIZES) + 1):
            m = len(c) - n + 1
            if m <= 0:
                break
            h = (h[:m] ^ c[n - 1 :]) * _STEP
            h ^= h >> np.uint32(15)
            ok = doc[:m] == doc[n - 1 :]
            buckets.append((h[ok] * np.uint32(0x85EBCA6B) >> np.uint32(17)) & np.uint32(BUCKETS - 1))
            docs.append(doc[:m][ok])
    if not buckets:
        return np.zeros(0, np.uint32), np.zeros(0, np.int64), letter
    return np.concatenate(buckets), np.concatenate(docs), letter


def fit(docs: DataFrame, keep: Column | None = None, text_col: str = "text", lang_col: str = "lang", buckets: int = BUCKETS) -> Model | None:
    """Counts over all rows that ``keep`` admits and that have a language. buckets: a power of two, BUCKETS at most; the
    broadcast matrix takes 4 bytes for each bucket and language, 134 MB for a thousand languages at the default."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        rows: dict[str, int] = {}
        for batch in batches:
            data, off = textnum.view(batch.column(0))
            lang = np.array(batch.column(1).to_pylist(), object)
            for i, j in textnum.parts(off):
                b, d, _ = grams(data[off[i] : off[j]].tobytes(), off[i : j + 1] - off[i])
                names, code = np.unique(lang[i:j].astype(str), return_inverse=True)
                found = np.bincount(code[d] * BUCKETS + b, minlength=len(names) * BUCKETS).reshape(-1, BUCKETS)
                for k, name in enumerate(names.tolist()):
                    sums[name] = sums.get(name, 0) + found[k]
                    rows[name] = rows.get(name, 0) + int((code == k).sum())
        for name, x in sums.items():
            b = np.flatnonzero(x)
            yield pa.RecordBatch.from_arrays([pa.array([name] * (len(b) + 1)), pa.array(np.append(b, -1).astype(np.int32)), pa.array(np.append(x[b], rows[name]))], names=["lang", "bucket", "n"])

    known = docs.filter(column(lang_col).isNotNull()) if keep is None else docs.filter(column(lang_col).isNotNull() & keep)
    parts = known.select(column(text_col).alias("text"), column(lang_col).cast("string").alias("lang")).mapInArrow(count, "lang string, bucket int, n long")
    found = parts.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    if not len(found):
        return None
    names, code = np.unique(found["lang"].to_numpy().astype(str), return_inverse=True)
    counts, rows = np.zeros((buckets, len(names)), np.float32), np.zeros(len(names))
    bucket, n = found["bucket"].to_numpy(), found["n"].to_numpy().astype(float)
    rows[code[bucket < 0]] = n[bucket < 0]
    np.add.at(counts, (bucket[bucket >= 0] & (buckets - 1), code[bucket >= 0]), n[bucket >= 0])
    counts += 0.5
    return Model(names.tolist(), np.log(counts / counts.sum(axis=0, dtype=float)).astype(np.float32), np.log(rows / rows.sum()))


def predict(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score): the likeliest language and its tempered posterior probability."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            data, off = textnum.view(batch.column(1))
            best, prob = np.full(batch.num_rows, "und", object), np.zeros(batch.num_rows)
            for i, j in textnum.parts(off) if m else []:
                b, d, letter = grams(data[off[i] : off[j]].tobytes(), off[i : j + 1] - off[i])
                b &= np.uint32(len(m.matrix) - 1)
                n = np.bincount(d, minlength=j - i)
                log = np.stack([np.bincount(d, weights=m.matrix[:, k][b], minlength=j - i) for k in range(len(m.languages))], axis=1)
                best[i:j] = np.where(letter, np.array(m.languages, object)[(log + m.prior).argmax(axis=1)], "und")
                log = log * np.minimum(1, EVIDENCE / np.maximum(n, 1))[:, None] + m.prior
                p = np.exp(log - log.max(axis=1, keepdims=True))
                prob[i:j] = np.where(letter, p.max(axis=1) / p.sum(axis=1), 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(best.tolist(), pa.string()), pa.array(prob)], names=["id", "lang_pred", "score"])

    kind = dict(docs.dtypes)[id_col]
    return docs.select(column(id_col).alias("id"), column(text_col).alias("text")).mapInArrow(score, f"id {kind}, lang_pred string, score double")
