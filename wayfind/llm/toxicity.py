"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A text's features are the distinct words, pairs of neighbours and pairs over a gap of one or two words, hashed
to a fixed number of coordinates. Each shard of some thousand rows runs FTRL-proximal (a learning rate for
every coordinate, L1 for sparsity) over its share of a bounded labelled sample; the shards' weights are averaged
and a two-parameter logistic calibration on the sample's margins turns the sum into a probability. Only the
non-zero weights are broadcast.

Defined cases: null and empty texts get the bias's score; without labelled rows every score is 0; labels that are
null do not train; a document labelled twice trains twice; a null id is carried along; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfind.llm import textnum
from wayfind.llm.common import sampled

COORDINATES = 1 << 20
#: Word groups: single words, neighbours, and skips over one and two words.
GROUPS = ((), (1,), (2,), (3,))
#: At most about so many labelled rows are used to fit (a hash of the text decides which).
MAX_FIT_ROWS = 24_000
#: Rows of a shard, about.
SHARD_ROWS = 6_000
EPOCHS = 4
#: A coordinate takes part in a shard's fit once so many of its rows have it.
LEAST_ROWS = 6
ALPHA, BETA, L1, L2 = 1.0, 1.0, 6.0, 1.0
THRESHOLD = 0.7


@dataclass
class Model:
    index: np.ndarray  # coordinates with a weight, in order
    weight: np.ndarray
    slope: float
    shift: float


def features(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Coordinates and documents of every word group, as often as it occurs."""
    w = textnum.words(data, off, space=textnum.SYMBOLS)
    found = [textnum.ngrams(w, g, seed=7919 * (k + 1)) for k, g in enumerate(GROUPS)]
    return np.concatenate([h >> np.uint64(44) for h, _ in found]).astype(np.int64), np.concatenate([d for _, d in found])


def distinct(index: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    both = np.unique(doc * COORDINATES + index)
    return both % COORDINATES, both // COORDINATES


def ftrl(index: np.ndarray, at: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Coordinates and weights; a row's coordinates are index[at[i]:at[i + 1]]. Coordinate COORDINATES is the bias."""
    z, n = np.zeros(COORDINATES + 1), np.zeros(COORDINATES + 1)
    order = np.random.default_rng(11)

    def weights(k: np.ndarray) -> np.ndarray:
        w = -(z[k] - np.sign(z[k]) * L1) / ((BETA + np.sqrt(n[k])) / ALPHA + L2)
        return np.where(np.abs(z[k]) <= L1, 0, w)

    for _ in range(EPOCHS):
        for i in order.permutation(len(y)):
            k = np.append(index[at[i] : at[i + 1]], COORDINATES)
            w = weights(k)
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - y[i]
            sigma = (np.sqrt(n[k] + g * g) - np.sqrt(n[k])) / ALPHA
            z[k] += g - sigma * w
            n[k] += g * g
    k = np.flatnonzero(n)
    w = weights(k)
    return k[w != 0], w[w != 0]


def fit(labelled: DataFrame, text_col: str = "text", label_col: str = "label") -> Model | None:
    """Fit on a bounded sample of the labelled rows."""
    rows = labelled.filter(F.col(label_col).isNotNull()).select(F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.col(label_col).cast("double").alias("label"))
    total = rows.count()
    if not total:
        return None
    where = F.xxhash64("text", F.lit(3))
    if total > MAX_FIT_ROWS:
        rows = rows.filter(sampled(where, MAX_FIT_ROWS / total))
    shards = -(-min(total, MAX_FIT_ROWS) // SHARD_ROWS)
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("text", F.lit(5)), F.lit(shards)).cast("int"))

    def train(table: pa.Table) -> pa.Table:
        data, off = textnum.view(table.column("text"))
        found, rows_of = [], []
        for i, j in textnum.parts(off):
            k, d = distinct(*features(data[off[i] : off[j]], off[i : j + 1] - off[i]))
            found.append(k.astype(np.int32))
            rows_of.append(np.bincount(d, minlength=j - i))
        k = np.concatenate(found)
        enough = np.bincount(k, minlength=COORDINATES)[k] >= LEAST_ROWS
        at = np.concatenate(([0], np.cumsum(enough)))[np.concatenate(([0], np.cumsum(np.concatenate(rows_of))))]
        k, w = ftrl(k[enough].astype(np.int64), at, table.column("label").to_numpy())
        return pa.table({"k": pa.array(k, pa.int64()), "w": pa.array(w, pa.float64())})

    fitted = rows.groupBy("shard").applyInArrow(train, "k long, w double")
    used = rows.select("shard").distinct().count()
    mean = fitted.groupBy("k").agg((F.sum("w") / used).alias("w")).filter(F.abs("w") > 1e-4).orderBy("k").toPandas()
    model = Model(mean["k"].to_numpy(), mean["w"].to_numpy(), 1.0, 0.0)
    sample = score(rows.withColumn("id", F.col("label")), model, id_col="id").select("id", "margin").toPandas()
    model.slope, model.shift = _calibrated(sample["margin"].to_numpy(), sample["id"].to_numpy())
    return model


def _calibrated(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve through the margins (labels drawn in as Platt does)."""
    pos, neg = (y > 0).sum(), (y <= 0).sum()
    if not pos or not neg:
        return 1.0, 0.0
    t = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    x = np.stack([margin, np.ones_like(margin)], axis=1)
    b = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -35, 35)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2), x.T @ (p - t))
        b -= np.clip(step, -1, 1)
        if np.abs(step).max() < 1e-9:
            break
    return float(max(b[0], 1e-3)), float(b[1])


def score(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, margin, score) of every text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        if m is not None:
            table = np.zeros(COORDINATES + 1, np.float32)
            table[m.index] = m.weight
            bias = float(table[COORDINATES])
        for batch in batches:
            data, off = textnum.view(batch.column(1))
            margin, p = np.zeros(batch.num_rows), np.zeros(batch.num_rows)
            if m is not None:
                for i, j in textnum.parts(off):
                    k, d = features(data[off[i] : off[j]], off[i : j + 1] - off[i])
                    hit = table[k] != 0
                    k, d = distinct(k[hit], d[hit])
                    margin[i:j] = np.bincount(d, weights=table[k], minlength=j - i) + bias
                p = 1 / (1 + np.exp(-np.clip(m.slope * margin + m.shift, -35, 35)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(margin), pa.array(p)], names=["id", "margin", "score"])

    kind = dict(docs.dtypes)[id_col]
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, margin double, score double")
