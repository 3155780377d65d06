"""Document quality by hierarchical empirical Bayes.

A logistic classifier over shares of character and word kinds gives each document's own evidence. Hosts and
the paths below them get Beta posteriors of the share of good documents: a path's counts are shrunk toward its
host's, a host's toward the global share, each with a strength that the method of moments finds from how much
the groups really differ. A document's final odds are its own times those of its path against the global odds,
with its own contribution taken out of the path first. Everything but the fitted weights is grouped
aggregation, so a hot host is summed up in many tasks.

The levels are whatever two columns are named: for web pages the host and the first path segment of the address
(``page_texts``), for documents, which have no address, their source and, below it, its language.

Defined cases: texts that are null or have no word are rejected; null hosts and paths are groups of their own;
without labels every text with words is kept with posterior 0.5; repeated rows count as often as they occur; ids
play no part, so null ones are like others; other columns, whatever their names, pass through untouched.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfind.llm import textnum
from wayfind.llm.common import column, kept, new_name, sampled

#: At most about so many labelled rows are used to fit (a hash of the text decides which).
MAX_FIT_ROWS = 40_000
#: Groups up to this many are broadcast; more are joined by a shuffle, whose hot groups AQE splits.
MAX_BROADCAST_GROUPS = 100_000
REJECT_BELOW = 0.5
LEAST_STRENGTH, MOST_STRENGTH = 10.0, 1e6
NAMES = ("symbols", "digits", "stops", "capitals", "space", "lines", "word_length", "repeats", "distinct", "length")

_SIGNS = np.zeros(256, bool)
_SIGNS[[ord(c) for c in "|#$%&*<>{}[]\\/^~_=+@`"]] = True
_STOPS = np.zeros(256, bool)
_STOPS[[ord(c) for c in ".,;:!?"]] = True
_CLASS = np.stack([_SIGNS, (np.arange(256) >= 48) & (np.arange(256) < 58), _STOPS, (np.arange(256) >= 65) & (np.arange(256) < 91), np.isin(np.arange(256), [9, 10, 13, 32]), np.arange(256) == 10])


def features(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One row of shares for each text, and its number of words."""
    size = np.maximum(np.diff(off), 1)
    w = textnum.words(data, off)
    at = np.concatenate(([0], np.cumsum(w.count)))
    many = np.maximum(w.count, 1)
    same = np.zeros(len(w.hash), bool)
    if len(same):
        same[1:] = (w.hash[1:] == w.hash[:-1]) & (w.doc[1:] == w.doc[:-1])
    key = np.lexsort((w.hash, w.doc))
    h, d = w.hash[key], w.doc[key]
    first = np.ones(len(h), bool)
    if len(h):
        first[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    kinds = [textnum.doc_sums(c[data], off) / size for c in _CLASS]
    return np.stack([*kinds, (size - textnum.doc_sums(_CLASS[4][data], off)) / many, textnum.doc_sums(same, at) / many, np.bincount(d[first], minlength=len(size)) / np.sqrt(many), np.log1p(many)], axis=1), w.count


@dataclass
class Classifier:
    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray  # the last one is the constant
    share: float  # of good rows


def fit(labelled: DataFrame, text_col: str = "text", label_col: str = "label") -> Classifier | None:
    """Logistic regression by Newton steps on the features of a bounded sample of labelled rows."""
    rows = labelled.filter(F.col(label_col).isNotNull()).select(F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.col(label_col).cast("double").alias("label"))
    total = rows.count()
    if total > MAX_FIT_ROWS:
        rows = rows.filter(sampled(F.xxhash64("text", F.lit(3)), MAX_FIT_ROWS / total))
    sample = rows.select("label", _features_of()(F.col("text")).alias("x")).toPandas()
    y = sample["label"].to_numpy()
    if not len(y) or y.min() == y.max():
        return None
    x = np.stack(sample["x"].to_numpy())
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    a = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    b = np.zeros(a.shape[1])
    ridge = np.diag(np.append(np.full(len(b) - 1, 1.0), 1e-6))
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(a @ b, -35, 35)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + ridge, a.T @ (p - y) + ridge @ b)
        b -= step * min(1, 5 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-8:
            break
    return Classifier(mean, scale, b, float(y.mean()))


def _features_of():
    @F.arrow_udf("array<double>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            data, off = textnum.view(column)
            x = np.concatenate([features(data[off[i] : off[j]], off[i : j + 1] - off[i])[0] for i, j in textnum.parts(off)] or [np.zeros((0, len(NAMES)))])
            yield pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * len(NAMES), pa.int32()), pa.array(x.ravel()))

    return run


def evidence(text: Column, model: Classifier | None) -> Column:
    """Log odds of a good document from its text alone; 0 without a model, -30 without a word."""

    @F.arrow_udf("double")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            data, off = textnum.view(column)
            out = np.zeros(len(column))
            for i, j in textnum.parts(off):
                x, count = features(data[off[i] : off[j]], off[i : j + 1] - off[i])
                if model is not None:
                    out[i:j] = np.clip((x - model.mean) / model.scale @ model.weight[:-1] + model.weight[-1], -30, 30)
                out[i:j][count == 0] = -30
            yield pa.array(out)

    return run(text)


def _logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def posteriors(scored: DataFrame, host_col: str = "host", path_col: str = "path") -> DataFrame:
    """(host, path, n, total, host_share, share, global_share, strength): shrunk shares of good documents.

    scored has host, path and p (each document's own probability).
    """
    paths = kept(scored.groupBy(F.col(host_col).alias("host"), F.col(path_col).alias("path")).agg(F.count("p").alias("n"), F.sum("p").alias("total")), "quality-paths")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("host_n"), F.sum("total").alias("host_total"))

    def spread(groups: DataFrame, n: str, total: str) -> tuple[float, float, float]:
        """Global share, and mean and variance of the groups' shares weighted by n, less what chance gives."""
        r = groups.agg(F.sum(total).alias("t"), F.sum(n).alias("n"), F.sum(F.col(total) * F.col(total) / F.col(n)).alias("q"), F.count(F.lit(1)).alias("g")).first()
        if not r["n"]:
            return 0.5, 0.0, 1.0
        mean = r["t"] / r["n"]
        return mean, max(0.0, r["q"] / r["n"] - mean * mean), r["n"] / r["g"]

    mean, between, size = spread(hosts, "host_n", "host_total")
    mean = min(max(mean, 1e-6), 1 - 1e-6)
    _, path_between, path_size = spread(paths, "n", "total")

    def strength(between: float, size: float) -> float:
        real = max(between - mean * (1 - mean) / size, 1e-9)
        return min(max(mean * (1 - mean) / real - 1, LEAST_STRENGTH), MOST_STRENGTH)

    k_host, k_path = strength(between, size), strength(path_between - between, path_size)
    hosts = hosts.withColumn("host_share", (F.col("host_total") + k_host * mean) / (F.col("host_n") + k_host)).select(F.col("host").alias("h"), "host_share")
    joined = paths.join(hosts, paths["host"].eqNullSafe(F.col("h")), "inner").drop("h")
    return joined.withColumn("global_share", F.lit(mean)).withColumn("strength", F.lit(k_path))


def classify(docs: DataFrame, model: Classifier | None, text_col: str = "text", host_col: str = "source", path_col: str = "lang", columns: list[str] | None = None) -> DataFrame:
    """docs, or these columns of it, with quality_evidence (log odds of the text), quality_posterior and quality_kept.

    The three get underscores at their end if docs has columns of their names.
    """
    own = docs.columns if columns is None else columns
    name = lambda n: new_name([*docs.columns, *own], n)
    odds_, posterior, keep, host, path, group, prior_ = map(name, ("quality_evidence", "quality_posterior", "quality_kept", "_host", "_path", "_group", "_prior"))
    # written once, so that the texts pass through Python once
    scored = kept(docs.select(*map(column, own), column(host_col).alias(host), column(path_col).alias(path), evidence(column(text_col), model).alias(odds_)), "quality-evidence")
    p = 1 / (1 + F.exp(-F.col(odds_)))
    groups = kept(posteriors(scored.select(F.col(host).alias("host"), F.col(path).alias("path"), p.alias("p"))), "quality-groups")
    groups = groups.select(F.struct("host", "path").alias(group), F.struct("n", "total", "host_share", "global_share", "strength").alias(prior_))
    few = groups.count() <= MAX_BROADCAST_GROUPS
    joined = scored.join(F.broadcast(groups) if few else groups, F.struct(F.col(host).alias("host"), F.col(path).alias("path")).eqNullSafe(F.col(group)), "left")
    prior = F.col(prior_)
    share = (F.greatest(prior["total"] - p, F.lit(0.0)) + prior["strength"] * prior["host_share"]) / (prior["n"] - 1 + prior["strength"])
    share = F.least(F.greatest(share, F.lit(1e-6)), F.lit(1 - 1e-6))
    odds = F.col(odds_) + _logit(share) - _logit(prior["global_share"])
    out = joined.withColumn(posterior, 1 / (1 + F.exp(-odds)))
    return out.select(*map(column, own), odds_, posterior, (F.col(posterior) >= REJECT_BELOW).alias(keep))


def accepted(docs: DataFrame, model: Classifier | None, text_col: str = "text", host_col: str = "source", path_col: str = "lang") -> DataFrame:
    """The rows of docs that are not rejected, with its columns."""
    found = classify(docs, model, text_col, host_col, path_col)
    return found.filter(F.col(found.columns[-1])).select(*map(column, docs.columns))


def page_texts(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, host, path, text): the host and first path segment of each page's address, and its text without markup."""
    url = F.col(url_col)
    bare = F.regexp_replace(F.regexp_replace(F.coalesce(html_col, F.lit("")), r"(?is)<(script|style|head)\b.*?</\1\s*>", " "), r"(?s)<[^>]*>", "\n")
    return pages.select(F.col(id_col).alias("id"), F.lower(F.nullif(F.regexp_extract(url, "^[a-zA-Z]+://([^/?#:]+)", 1), F.lit(""))).alias("host"), F.nullif(F.regexp_extract(url, "^[a-zA-Z]+://[^/?#]+/([^/?#]+)", 1), F.lit("")).alias("path"), bare.alias("text"))
