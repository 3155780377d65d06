"""Personal data by weak supervision: labelers vote on candidate spans, EM weighs them, a classifier decides.

Candidates are the base spans (email, ip, card, phone) and looser ones: digit groups that fail the base tests
(number) and values after credential words (secret). Regex, gazetteer and context labelers each vote for,
against or not at all on every candidate. The vote patterns of all documents are counted in Spark; there are
boundedly many, and expectation-maximisation on their counts estimates each labeler's reliability and each
pattern's probability. These probabilities are the soft labels of a logistic span classifier over traits of the
span that no labeler sees (make-up of its characters, neighbours, the word before it), so it also scores
candidates whose votes or traits never stood together. Base spans stay whatever it says; other candidates are
kept from probability ``KEEP_FROM`` on, if they do not overlap a base span.

Defined cases: null texts count as empty and stay null when redacted; repeated rows count as often as they
occur; null ids are carried along; an empty table gives no rows and a model that keeps base spans only; other
columns, whatever their names, pass through ``redact`` and are ignored elsewhere.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfind.llm import textnum
from wayfind.llm.common import column, kept, sampled

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "number", "secret")
LABELERS = ("shape", "gazetteer", "cue", "border", "check", "counter_cue")
KEEP_FROM = 0.5
WINDOW = 32
#: At most about so many different candidates fit the classifier.
MAX_FIT_ROWS = 50_000
#: Text that is taken apart at a time.
SLICE_BYTES = 1 << 20

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_SECRET = re.compile(r"(?i)(?<![a-z])(?:pass(?:word|wd|phrase)?|pwd|secret|token|api[_-]?key|access[_-]?key|auth|bearer)[\x20\"']{0,3}[:=][\x20]?[\"']?([A-Za-z0-9+/_.-]{8,})")
_DIGITS = re.compile(r"[0-9]")

# Gazetteers: fixed values.
_TOP_DOMAINS = frozenset("com org net edu gov info io de fr es it uk eu us ca jp cn in br nl ch at be se".split())
_CALLING_CODES = ("1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "52", "54", "55", "61", "62", "64", "65", "81", "82", "86", "90", "91")
_ISSUERS = ("3", "4", "5", "6")
_CUES = {
    "email": re.compile(r"(?i)\b(?:e-?mail|mail|contact|write|address|from|to|cc)\b"),
    "ip": re.compile(r"(?i)\b(?:ip|host|server|address|client|login|from)\b"),
    "card": re.compile(r"(?i)\b(?:card|visa|master|credit|debit|account|pay(?:ment)?)\b"),
    "phone": re.compile(r"(?i)\b(?:phone|tel|call|fax|mobile|cell|contact)\b"),
    "number": re.compile(r"(?i)\b(?:card|account|iban|ssn|passport|phone|tel)\b"),
    "secret": re.compile(r"(?i)\b(?:user|login|key|credential|config|export|set)\b"),
}
_COUNTER_CUES = re.compile(r"(?i)\b(?:version|isbn|issn|doi|order|invoice|page|chapter|section|build|example|dummy|sample)\b")


def _luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of local part, @ and dotted domain, found from each @ so that long runs cost nothing."""
    done = 0
    at = text.find("@")
    while at >= 0:
        s = at
        while s > done and text[s - 1] in _LOCAL:
            s -= 1
        found = _DOMAIN.match(text, at + 1) if s < at else None
        if found:
            yield s, found.end()
            done = found.end()
        else:
            done = at + 1
        at = text.find("@", done)


def spans_of(text: str) -> list[tuple[str, int, int, bool]]:
    """Candidates (kind, start, end, whether base) by kind, then start."""
    out: dict[str, list] = {k: [] for k in KINDS}
    if "@" in text:
        out["email"] = [(s, e, True) for s, e in _emails(text)]
    if _DIGITS.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p[-9:]) <= 255 for p in m.group().split(".")):
                out["ip"].append((*m.span(), True))
        for m in _CARD.finditer(text):
            digits = m.group().replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and _luhn(digits):
                out["card"].append((*m.span(), True))
            elif 13 <= len(digits) <= 19:
                out["number"].append((*m.span(), False))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 8 <= len(_DIGITS.findall(m.group())) <= 15:
                    out["phone"].append((*m.span(), True))
    if "=" in text or ":" in text:
        out["secret"] = [(*m.span(1), False) for m in _SECRET.finditer(text)]
    taken = [x[:2] for k in BASE for x in out[k]]
    for k in KINDS[len(BASE) :]:
        out[k] = _apart(out[k], taken)
        taken += [x[:2] for x in out[k]]
    return [(k, s, e, base) for k in KINDS for s, e, base in out[k]]


def _apart(spans: list, taken: list[tuple[int, int]]) -> list:
    """Those of the spans, which stand in order and do not overlap, that overlap none of the others."""
    out, others, i = [], [], 0
    for s, e in sorted(taken):  # runs of overlapping ones become one
        if others and s < others[-1][1]:
            others[-1][1] = max(others[-1][1], e)
        else:
            others.append([s, e])
    for x in spans:
        while i < len(others) and others[i][1] <= x[0]:
            i += 1
        if i == len(others) or others[i][0] >= x[1]:
            out.append(x)
    return out


def votes(text: str, kind: str, start: int, end: int) -> tuple[int, ...]:
    """1 for, -1 against, 0 no opinion, in the order of LABELERS."""
    span, before = text[start:end], text[max(0, start - WINDOW) : start]
    digits = "".join(_DIGITS.findall(span))
    last = span.rpartition(".")[2].lower()
    shape = {
        "email": len(last) >= 2 and last.isalpha(),
        "ip": all(p == "0" or not p.startswith("0") for p in span.split(".")),
        "card": len(digits) == 16,
        "phone": len(digits) >= 10,
        "number": False,
        "secret": len(span) >= 12 and bool(digits) and not span.isdigit(),
    }[kind]
    known = {
        "email": last in _TOP_DOMAINS,
        "ip": not span.startswith(("0.", "127.", "255.")),
        "card": digits[:1] in _ISSUERS,
        "phone": digits.startswith(_CALLING_CODES),
        "number": digits[:1] in _ISSUERS and len(digits) >= 15,
        "secret": True,
    }[kind]
    check = {"card": 1, "number": 1 if _luhn(digits) else -1, "secret": 1 if len(set(span)) >= 6 else -1}.get(kind, 0)
    edge = text[start - 1 : start] + text[end : end + 1] if start else text[end : end + 1]
    return (1 if shape else -1, 1 if known else -1, 1 if _CUES[kind].search(before) else 0, -1 if any(c.isalnum() or c == "_" for c in edge) else 1, check, -1 if _COUNTER_CUES.search(before) else 0)


def pattern(text: str, kind: str, start: int, end: int) -> str:
    """What EM knows of a candidate: kind and votes."""
    return f"{kind}|" + "".join("-0+"[v + 1] for v in votes(text, kind, start, end))


#: Trait groups of the span classifier and how many values each has.
TRAITS = {"kind": len(KINDS), "length": 8, "digits": 5, "capitals": 3, "marks": 3, "changes": 5, "left": 4, "right": 4, "word": 32}
_FIRST = dict(zip(TRAITS, np.cumsum([0, *TRAITS.values()]).tolist()))
WIDTH = sum(TRAITS.values())


def _side(c: str) -> int:
    return 0 if not c else 1 if c.isspace() else 2 if c.isalnum() else 3


def traits(text: str, kind: str, start: int, end: int) -> list[int]:
    """What the classifier knows of a candidate: one place of its weights for each trait group."""
    span, n = text[start:end], end - start
    sort = [2 if c.isdigit() else 1 if c.isalpha() else 0 for c in span]
    word = re.findall(r"[^\W\d_]+", text[max(0, start - WINDOW) : start])
    found = {
        "kind": KINDS.index(kind),
        "length": min((end - start).bit_length(), 7),
        "digits": sort.count(2) * 4 // n,
        "capitals": min(2, sum(c.isupper() for c in span)),
        "marks": min(2, sort.count(0)),
        "changes": min(4, sum(x != y for x, y in zip(sort, sort[1:])) * 8 // n),
        "left": _side(text[start - 1 : start] if start else ""),
        "right": _side(text[end : end + 1]),
        "word": zlib.crc32(word[-1].lower().encode()) % 31 + 1 if word else 0,
    }
    return [_FIRST[k] + v for k, v in found.items()]


@dataclass
class Model:
    weights: np.ndarray  # of every trait value, the constant last
    probability: dict[str, float] = field(default_factory=dict)  # of each vote pattern seen, by EM
    reliability: dict[str, tuple[float, float]] = field(default_factory=dict)  # a labeler's chance to vote for a true and a false span

    def score(self, places: list[int]) -> float:
        """Log odds of a candidate with these traits."""
        return float(self.weights[places].sum() + self.weights[-1])


#: A model without candidates: nothing but base spans.
def no_model() -> Model:
    return Model(np.append(np.zeros(WIDTH), -30.0))


def reliabilities(patterns: dict[str, int]) -> tuple[dict[str, float], dict[str, tuple[float, float]]]:
    """EM over counted vote patterns: each pattern's probability, each labeler's chances."""
    names = sorted(patterns)
    if not names:
        return {}, {}
    n = np.array([patterns[x] for x in names], float)
    kind = np.array([KINDS.index(x.split("|")[0]) for x in names])
    v = np.array([["-0+".index(c) for c in x.split("|")[1]] for x in names])
    q = np.clip(0.5 + 0.18 * (v - 1).sum(axis=1), 0.02, 0.98)  # majority to begin with
    eye = np.eye(3)[v]
    for _ in range(200):
        chance = {}
        for c, w in ((1, n * q), (0, n * (1 - q))):
            # every labeler is taken to be right somewhat more often than wrong
            prior = np.array([0.5, 1.0, 2.0]) if c else np.array([2.0, 1.0, 0.5])
            counts = (eye * w[:, None, None]).sum(axis=0) + 2 * prior
            chance[c] = counts / counts.sum(axis=1, keepdims=True)
        share = np.bincount(kind, weights=n * q, minlength=len(KINDS)) + 1
        share /= np.bincount(kind, weights=n, minlength=len(KINDS)) + 2
        log = np.log(share / (1 - share))[kind]
        for j in range(v.shape[1]):
            log = log + np.log(chance[1][j, v[:, j]] / chance[0][j, v[:, j]])
        new = 1 / (1 + np.exp(-np.clip(log, -30, 30)))
        change, q = np.abs(new - q).max(), new
        if change < 1e-7:
            break
    return dict(zip(names, q.tolist())), {x: (float(chance[1][j, 2]), float(chance[0][j, 2])) for j, x in enumerate(LABELERS)}


def classifier(places: np.ndarray, n: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Weights of a logistic regression on soft labels: rows of trait places, how often they occur, probabilities."""
    a = np.zeros((len(n), WIDTH + 1))
    np.put_along_axis(a, places, 1.0, axis=1)
    a[:, -1] = 1
    b = np.zeros(WIDTH + 1)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a @ b, -30, 30)))
        step = np.linalg.solve((a * (n * p * (1 - p))[:, None]).T @ a + np.eye(len(b)), a.T @ (n * (p - q)) + b)
        b -= step * min(1, 4 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-8:
            break
    return b


# ---- Spark ----

_WANTED = np.zeros(256, bool)
_WANTED[[ord(c) for c in "@=:0123456789"]] = True
_CANDIDATE = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_()), ("pattern", pa.string()), ("traits", pa.list_(pa.int32()))])


def candidates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, spans): every text's candidates with their vote patterns and traits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in textnum.slices(batches, 1, SLICE_BYTES):
            data, off = textnum.view(batch.column(1))
            may = textnum.doc_sums(_WANTED[data], off) > 0
            out: list[list] = [[] for _ in range(batch.num_rows)]
            for i in np.flatnonzero(may).tolist():
                text = data[off[i] : off[i + 1]].tobytes().decode("utf-8", "replace")
                out[i] = [{"kind": k, "start": s, "end": e, "base": base, "pattern": pattern(text, k, s, e), "traits": traits(text, k, s, e)} for k, s, e, base in spans_of(text)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(_CANDIDATE))], names=["id", "spans"])

    kind = dict(df.dtypes)[id_col]
    return df.select(column(id_col).alias("id"), column(text_col).alias("text")).mapInArrow(run, f"id {kind}, spans array<struct<kind: string, start: long, end: long, base: boolean, pattern: string, traits: array<int>>>")


def learn(found: DataFrame) -> Model:
    """The model from all candidates of ``candidates``: EM sees all vote patterns, the classifier all traits, or a
    sample by hash of MAX_FIT_ROWS of their different combinations."""
    each = found.select(F.explode("spans").alias("s")).groupBy("s.pattern", "s.traits").agg(F.count(F.lit(1)).alias("n"))
    counts = kept(each, "pii-counts")
    patterns = {r["pattern"]: r["n"] for r in counts.groupBy("pattern").agg(F.sum("n").alias("n")).toLocalIterator()}
    if not patterns:
        return no_model()
    probability, reliability = reliabilities(patterns)
    total = counts.count()
    if total > MAX_FIT_ROWS:
        counts = counts.filter(sampled(F.xxhash64("pattern", "traits"), MAX_FIT_ROWS / total))
    rows = counts.orderBy("pattern", "traits").toPandas()
    weights = classifier(np.array(rows["traits"].tolist(), np.int64).reshape(-1, len(TRAITS)), rows["n"].to_numpy(float), rows["pattern"].map(probability).to_numpy(float))
    return Model(weights, probability, reliability)


_KEEP_ODDS = float(np.log(KEEP_FROM / (1 - KEEP_FROM)))


def decided(spans: Column, model: Model) -> Column:
    """The base spans and those others that the classifier accepts."""
    weights = F.array(*(F.lit(float(w)) for w in model.weights[:-1]))
    odds = lambda s: F.aggregate(s["traits"], F.lit(float(model.weights[-1])), lambda a, i: a + F.get(weights, i))
    return F.filter(spans, lambda s: s["base"] | (odds(s) >= _KEEP_ODDS))


def _text_of(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: counts of base spans, their digest, and all spans."""
    found = kept(candidates(df, id_col, text_col), "pii-candidates")
    model = learn(found)
    base = F.filter("spans", lambda s: s["base"])
    count = lambda k: F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == k))).cast("long").alias(f"n_{k}")
    all_spans = decided(F.col("spans"), model)
    return found.select(F.col("id").alias("doc_id"), *(count(k) for k in BASE), F.sha2(_text_of(base).cast("binary"), 256).alias("base_sha256"), _text_of(all_spans).alias("spans"), (F.size(all_spans) - F.size(base)).cast("long").alias("n_added"), F.size(all_spans).cast("long").alias("n_spans"))


def redact(df: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """df with every decided span of the text replaced by its kind in brackets; other columns as they were."""
    @F.arrow_udf("string")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for strings in batches:
            data, off = textnum.view(strings)
            out = strings.to_pylist()
            for i in np.flatnonzero(textnum.doc_sums(_WANTED[data], off) > 0).tolist():
                out[i] = masked(out[i], model)
            yield pa.array(out, pa.string())

    return df.select(*(run(column(c)).alias(c) if c == text_col else column(c) for c in df.columns))


def masked(text: str, model: Model) -> str:
    """Spans that overlap are replaced as one, by the kind listed first."""
    spans = sorted((s, -e, k) for k, s, e, base in spans_of(text) if base or model.score(traits(text, k, s, e)) >= _KEEP_ODDS)
    out, done, i = [], 0, 0
    while i < len(spans):
        s, e, kinds = spans[i][0], -spans[i][1], [spans[i][2]]
        i += 1
        while i < len(spans) and spans[i][0] < e:
            e = max(e, -spans[i][1])
            kinds.append(spans[i][2])
            i += 1
        out += [text[done:s], f"[{min(kinds, key=KINDS.index).upper()}]"]
        done = e
    return "".join([*out, text[done:]])


def base_digest(text: str) -> str:
    """The digest of a text's base spans, as ``report`` gives it."""
    return hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e, base in spans_of(text) if base).encode()).hexdigest()
