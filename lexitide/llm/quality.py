"""Quality of texts by positive-unlabelled learning: a small network minimises the non-negative unbiased risk from
trusted positives, unlabelled web text and an estimated class prior."""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Batches, held_out, named, prepare, task, uniform

NAMES = ("log_bytes", "log_words", "word_length", "upper", "digits", "blank", "marks", "symbols", "beyond_ascii", "shout", "bars", "doubled", "distinct_words", "top_word", "repeated_lines", "line_length", "repeated_runs", "lone_words", "stops", "capital_words", "echoes")
#: Bytes of each kind.
_UPPER = bytes(range(65, 91))
_DIGIT = bytes(range(48, 58))
_BLANK = b" \t\n\r\x0b\x0c"
_PLAIN = b".,;:'\"!?-()"
_ASCII = bytes(range(128))
_ALNUM = bytes([*range(48, 58), *range(65, 91), *range(97, 123)])
_SYMBOL = bytes(b for b in range(33, 127) if b not in _ALNUM + _PLAIN)
_MARK = bytes(b for b in range(33, 127) if b not in _ALNUM)
_DOUBLED = re.compile(rb"([!-/:-@\[-`{-~])\1")


def features(text: str) -> list[float]:
    """Figures of a whole text; of an empty one all are 0."""
    raw = text.encode("utf-8", "replace")
    n = len(raw)
    words = text.split()
    if not words:
        return [0.0] * len(NAMES)
    count = lambda kind: n - len(raw.translate(None, kind))
    m = len(words)
    tally = Counter(words)
    lines = [x for x in text.split("\n") if x.strip()]
    distinct_lines = set(lines)
    runs = {hash(x) for x in zip(words, words[1:], words[2:])}
    upper, marks = count(_UPPER), count(_MARK)
    letters = max(1, n - count(_BLANK) - marks - count(_DIGIT))
    return [
        np.log1p(n), np.log1p(m), n / m, upper / letters, count(_DIGIT) / n, count(_BLANK) / n, marks / n, count(_SYMBOL) / n, 1 - (n - len(raw.translate(None, _ASCII))) / n,
        raw.count(b"!") / m, raw.count(b"|") / m, len(_DOUBLED.findall(raw)) / m, len(tally) / m, max(tally.values()) / m,
        1 - sum(map(len, distinct_lines)) / max(1, sum(map(len, lines))), np.log1p(n / len(lines)), 1 - len(runs) / max(1, m - 2), sum(1 for v in tally.values() if v == 1) / m, raw.count(b".") / m, sum(w[0].isupper() for w in words) / m,
        sum(a == b for a, b in zip(words, words[1:])) / m,
    ]


def _squeeze(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Distances from the trusted texts' middle in units of their spread on a logarithmic scale, with their sign and without."""
    z = (x - mean) / scale
    far = np.log1p(np.abs(z))
    return np.concatenate([np.sign(z) * far, far], axis=-1)


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    layers: list[np.ndarray]
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        W, b, w, c = self.layers
        return 1 / (1 + np.exp(-np.clip(np.tanh(_squeeze(x, self.mean, self.scale) @ W + b) @ w + c, -30, 30)))


def _learn(z: np.ndarray, weight: np.ndarray, kind: np.ndarray, prior: float | None, steps: int, seed: int, hidden: int = 24, rate: float = 0.02, decay: float = 1e-4) -> list[np.ndarray]:
    """kind 1: positives, 0: unlabelled. With prior None it tells the two apart (logistic loss); else it minimises
    prior * R_p(+) + max(0, R_u(-) - prior * R_p(-)), stepping back along a risk that went below 0."""
    rng = np.random.default_rng(seed)
    x = [rng.normal(size=(z.shape[1], hidden)) / np.sqrt(z.shape[1]), np.zeros(hidden), rng.normal(size=hidden) / np.sqrt(hidden), np.zeros(())]
    m, v = [np.zeros_like(a) for a in x], [np.zeros_like(a) for a in x]
    pos, unl = kind == 1, kind == 0
    wp, wu = pos * weight / max(1e-9, (pos * weight).sum()), unl * weight / max(1e-9, (unl * weight).sum())
    for step in range(1, steps + 1):
        h = np.tanh(z @ x[0] + x[1])
        f = h @ x[2] + x[3]
        p = 1 / (1 + np.exp(-np.clip(f, -30, 30)))
        as_pos, as_neg = -(1 - p), p  # slopes of the logistic loss for label 1 and for label 0
        if prior is None:
            slope = (wp * as_pos + wu * as_neg) / 2
        else:
            loss_neg = np.logaddexp(0, f)
            negative = (wu * loss_neg).sum() - prior * (wp * loss_neg).sum()
            inner = wu * as_neg - prior * wp * as_neg
            slope = prior * wp * as_pos + inner if negative >= 0 else -inner
        back = np.outer(slope, x[2]) * (1 - h * h)
        for i, g in enumerate((z.T @ back + decay * x[0], back.sum(axis=0), h.T @ slope + decay * x[2], slope.sum())):
            m[i] = 0.9 * m[i] + 0.1 * g
            v[i] = 0.999 * v[i] + 0.001 * g * g
            x[i] = x[i] - rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    return x


def class_prior(pos: np.ndarray, unl: np.ndarray) -> float:
    """The share of positives in unlabelled text: among the best scores of a classifier of trusted against unlabelled
    rows, the least ratio of the unlabelled tail to the trusted tail. Tails of under 0.3 of the trusted rows are left
    out for their noise; an estimate somewhat low is the safe side of the non-negative risk."""
    best = 1.0
    for q in np.linspace(0.3, 0.98, 69):
        c = np.quantile(pos, 1 - q)
        best = min(best, (unl >= c).mean() / max((pos >= c).mean(), 1e-9))
    return float(np.clip(best, 0.05, 0.95))


def fit(positives: np.ndarray, unlabelled: np.ndarray, steps: int = 600, seed: int = 9) -> Model:
    """Feature rows of trusted positives and of unlabelled texts; without either of them every score is the prior's."""
    k = len(NAMES)
    if not len(positives) or not len(unlabelled):
        p = 0.5
        return Model(np.zeros(k), np.ones(k), [np.zeros((2 * k, 1)), np.zeros(1), np.zeros(1), np.zeros(())], p)
    mean = np.median(positives, axis=0)
    scale = np.maximum(np.abs(positives - mean).mean(axis=0), 1e-3)
    zp, zu = _squeeze(positives, mean, scale), _squeeze(unlabelled, mean, scale)
    fold = lambda z: (z[0::2], z[1::2])
    (pa_, pb), (ua, ub) = fold(zp), fold(zu)
    z, kind = np.concatenate([pa_, ua]), np.concatenate([np.ones(len(pa_)), np.zeros(len(ua))])
    apart = _learn(z, np.ones(len(z)), kind, None, steps // 2, seed, decay=3e-3)
    f = lambda z: np.tanh(z @ apart[0] + apart[1]) @ apart[2] + apart[3]
    prior = class_prior(f(pb), f(ub)) if len(pb) and len(ub) else 0.5
    z, kind = np.concatenate([zp, zu]), np.concatenate([np.ones(len(zp)), np.zeros(len(zu))])
    return Model(mean, scale, _learn(z, np.ones(len(z)), kind, prior, steps, seed), prior)


def with_features(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs without the text, with features array<double> of the whole text, in place of a column of that name. A null
    text is an empty one, of zeros; no rows give no rows."""
    prepare(docs.sparkSession)
    docs = named(docs, "features", needs=(text_col,))
    kept = [f for f in docs.schema.fields if f.name != text_col]
    schema = T.StructType([*kept, T.StructField("features", T.ArrayType(T.DoubleType()))])

    def run(batches: Batches) -> Batches:
        for batch in batches:
            i = batch.schema.get_field_index(text_col)
            rows = [features(t or "") for t in batch.column(i).to_pylist()]
            yield pa.RecordBatch.from_arrays([*[c for j, c in enumerate(batch.columns) if j != i], pa.array(rows, pa.list_(pa.float64()))], names=schema.names)

    return docs.mapInArrow(task("quality", run), schema)


def sample(docs: DataFrame, labels: DataFrame, learn: Column, n_positive: int = 4000, n_unlabelled: int = 6000) -> tuple[np.ndarray, np.ndarray]:
    """Feature rows of about n_positive texts with a trusted label and about n_unlabelled texts of any kind, by the
    hash of the id: the bound on what is fitted. Labels other than the trusted ones are not used."""
    trusted = labels.where(learn & (F.col("quality") == 1)).select("doc_id").distinct()
    n = trusted.count()
    ids = trusted.where(uniform(F.col("doc_id").cast("string"), seed=21) < F.lit(n_positive / max(n, 1)))
    total = docs.where(learn).count()
    some = docs.where(learn).select("doc_id", "text")
    pos = some.join(F.broadcast(ids), "doc_id", "left_semi")  # about n_positive ids
    unl = some.where(uniform(F.col("doc_id").cast("string"), seed=22) < F.lit(n_unlabelled / max(total, 1)))
    both = with_features(pos.withColumn("kind", F.lit(1)).unionByName(unl.withColumn("kind", F.lit(0)))).collect()
    both.sort(key=lambda r: (r["kind"], r["doc_id"], r["features"]))  # ids to learn from are never null
    make = lambda k: np.array([r["features"] for r in both if r["kind"] == k], dtype=float).reshape(-1, len(NAMES))
    return make(1), make(0)


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs with score double added, in place of a column of that name: the probability that a text is good. A null text
    is an empty one; empty texts get the score of their (zero) features. Rows are judged alone, by whole texts, so equal
    texts have equal scores; no rows give no rows."""
    prepare(docs.sparkSession)
    docs = named(docs, "score", needs=(text_col,))
    schema = T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType())])

    def run(batches: Batches) -> Batches:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text_col)).to_pylist()
            x = np.array([features(t or "") for t in texts]).reshape(-1, len(NAMES))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(model.score(x), pa.float64())], names=schema.names)

    return docs.mapInArrow(task("quality", run), schema)


def score_documents(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score and predicted of every document; learned from rows whose crc32(doc_id) mod 5 is not 0. A
    null text is an empty one; a row without an id counts as held out; rows with equal or null ids are documents of
    their own. Of an id with several labels a trusted one counts. Without trusted labels or without documents to learn
    from every score is one half. An empty table gives no rows; other columns are not returned."""
    model = fit(*sample(docs, labels, ~held_out()))
    out = score(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
