"""Quality classifier: Bradley-Terry scores from preference pairs.

A pair is a labelled document of quality 1 preferred to one of quality 0. The score is linear in the text's features, and
the logistic loss on the pairs' feature differences fits it. A quantile of the labelled scores sets the threshold, and a
logistic curve through it gives the score its 0-to-1 scale.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import BLANK, LOWER, buffers, hash_spans, pieces, words

#: Score at which a document counts as quality 1.
CUT = 0.3
_KINDS = {
    "upper": [range(0x41, 0x5B)], "lower": [range(0x61, 0x7B)], "digit": [range(0x30, 0x3A)], "high": [range(0x80, 0x100)],
    "blank": [range(0x09, 0x0E), range(0x20, 0x21)], "stop": [(0x2E, 0x2C)], "other": [range(0x21, 0x2C), (0x2D, 0x2F), range(0x3A, 0x41), range(0x5B, 0x61), range(0x7B, 0x7F)], "control": [range(0, 9), range(14, 32), (127,)],
}
_CLASS = np.zeros(256, np.int64)
for _k, _parts in enumerate(_KINDS.values()):
    for _p in _parts:
        _CLASS[list(_p)] = _k
_NC = len(_KINDS)


def features(texts: pa.Array) -> np.ndarray:
    """A row of figures for each whole text: shares of character kinds and of their transitions, each printable
    punctuation mark's share, word lengths, repetition of words, and the length. No label, language or source."""
    data, offs = buffers(texts)
    n = len(offs) - 1
    size = np.diff(offs)
    owner = np.repeat(np.arange(n), size)
    raw = data[: len(data) - 8]
    per = 1 / np.maximum(size, 1)[:, None]
    kind = _CLASS[raw]
    out = [np.bincount(owner * _NC + kind, minlength=n * _NC).reshape(n, _NC) * per]
    if len(raw):
        pair = owner[1:] * (_NC * _NC) + kind[:-1] * _NC + kind[1:]
        out.append(np.bincount(pair[owner[1:] == owner[:-1]], minlength=n * _NC * _NC).reshape(n, -1) * per)
    else:
        out.append(np.zeros((n, _NC * _NC)))
    marks = np.flatnonzero(_CLASS == list(_KINDS).index("other"))
    place = np.full(256, -1)
    place[marks] = np.arange(len(marks))
    at = np.flatnonzero(place[raw] >= 0)
    out.append(np.bincount(owner[at] * len(marks) + place[raw[at]], minlength=n * len(marks)).reshape(n, -1) * per)
    starts, lens, first = words(data, offs, BLANK)
    count = np.diff(first)
    each = 1 / np.maximum(count, 1)
    h = hash_spans(LOWER[data], starts, lens)
    whose = np.repeat(np.arange(n), count)
    order = np.lexsort((h, whose))
    s, w = h[order], whose[order]
    fresh = np.r_[True, (s[1:] != s[:-1]) | (w[1:] != w[:-1])] if len(s) else np.zeros(0, bool)
    distinct = np.bincount(w[fresh], minlength=n)
    runs = np.diff(np.r_[np.flatnonzero(fresh), len(s)])
    most = np.zeros(n)
    np.maximum.at(most, w[fresh], runs)
    same = (h[1:] == h[:-1]) & (whose[1:] == whose[:-1]) if len(h) else np.zeros(0, bool)
    again = np.bincount(whose[1:][same], minlength=n) if len(h) else np.zeros(n)
    log = np.log1p(count)
    out.append(np.stack([np.bincount(whose, lens, n) * each / 10, np.bincount(whose, np.minimum(lens, 100) ** 2.0, n) * each / 100, distinct * each, distinct * each * log / 5, most * each, again * each, log / 5, (count == 0).astype(float)], 1))
    x = np.concatenate(out, 1)
    return np.concatenate([x, np.sqrt(np.maximum(x[:, : _NC + _NC * _NC + len(marks)], 0))], 1)


class QualityModel:
    """weights over standardised features; ``scale`` and ``threshold`` put the score on 0 to 1."""

    def __init__(self, mean, spread, weights, threshold, scale):
        self.mean, self.spread, self.weights, self.threshold, self.scale = mean, spread, weights, threshold, scale

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.spread, -8, 8) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip((self.raw(x) - self.threshold) * self.scale + np.log(CUT / (1 - CUT)), -40, 40)))


def fit_pairs(x: np.ndarray, y: np.ndarray, pairs: int = 12_000, penalty: float = 1e-3, steps: int = 300, seed: int = 11) -> QualityModel:
    """Bradley-Terry weights by full-batch accelerated descent on the pairs' logistic loss, then the quantile threshold."""
    mean, spread = x.mean(0), x.std(0)
    spread = np.where(spread > 1e-9, spread, np.inf)
    z = np.clip((x - mean) / spread, -8, 8)
    rng = np.random.default_rng(seed)
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    d = z[rng.choice(good, pairs)] - z[rng.choice(bad, pairs)]
    w, v = np.zeros(x.shape[1]), np.zeros(x.shape[1])
    rate = 1 / (0.25 * np.linalg.eigvalsh(d.T @ d / pairs)[-1] + penalty)
    for k in range(steps):
        ahead = w + k / (k + 3) * (w - v)
        gradient = -(d.T @ (1 / (1 + np.exp(np.clip(d @ ahead, -40, 40))))) / pairs + penalty * ahead
        w, v = ahead - rate * gradient, w
    s = z @ w
    # The quantile of all labelled scores that misjudges fewest, classes weighing alike; between its neighbours.
    order = np.argsort(s, kind="stable")
    low = np.r_[0, np.cumsum(y[order] == 0)] / max(1, len(bad))
    high = np.r_[0, np.cumsum(y[order] == 1)] / max(1, len(good))
    right = low - high
    best = np.flatnonzero(right >= right.max() - 1e-12)
    k = int(best[len(best) // 2])
    ends = np.r_[s[order][0] - 1, s[order], s[order][-1] + 1]
    threshold = (ends[k] + ends[k + 1]) / 2
    return QualityModel(mean, spread, w, threshold, 1.0)


def fit(docs: DataFrame, labels: DataFrame, max_labels: int = 6000) -> QualityModel | None:
    """A model from ``labels`` (doc_id, quality 0 or 1) and the whole texts of ``docs``.

    Null ids and labels are left out, and so is a doc_id with both labels; a label that is repeated counts once. Of rows
    of ``docs`` that share a labelled doc_id one is learned from, that with the smallest features. The bound of the fit:
    ``max_labels`` labelled rows, those with the smallest hashes of doc_id. None if they lack one of the two labels.
    """
    from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

    # A bounded number of rows: max_labels.
    clear = labels.where("quality IN (0, 1) AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("other")).where("quality = other").drop("other")
    chosen = clear.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labels)
    rows = docs.select(F.col("doc_id"), F.col("text")).join(F.broadcast(chosen), "doc_id").select("doc_id", "quality", "text")

    def extract(batches):
        for batch in pieces(batches, 1 << 20):
            x = features(batch.column(2))
            flat = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1]), pa.int32()), pa.array(x.ravel(), pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), flat], names=["doc_id", "quality", "x"])

    schema = StructType([rows.schema["doc_id"], rows.schema["quality"], StructField("x", ArrayType(DoubleType()))])
    one = rows.mapInArrow(extract, schema).groupBy("doc_id", "quality").agg(F.min("x").alias("x"))
    got = sorted(one.toLocalIterator(), key=lambda r: r["doc_id"])
    y = np.array([r["quality"] for r in got])
    if not len(y) or len(set(y.tolist())) < 2:
        return None
    return fit_pairs(np.array([r["x"] for r in got]), y)


def score(docs: DataFrame, model: QualityModel | None) -> DataFrame:
    """The columns of ``docs`` with score (0 to 1) and predicted (1 from a score of 0.3) added.

    A null text counts as empty; without a model every score is 0.5. Null and repeated ids change nothing: rows are judged each for itself; ``docs`` columns
    named score or predicted give way.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few hundred numbers
    out = docs.drop("score", "predicted").withColumns({"score": F.lit(0.5), "predicted": F.lit(1)})
    schema = out.schema

    def judge(batches):
        model = shared.value
        for batch in pieces(batches, 1 << 20):
            names = batch.schema.names
            s = model.score(features(batch.column(names.index("text")))) if model else np.full(batch.num_rows, 0.5)
            new = {"score": pa.array(s, pa.float64()), "predicted": pa.array((s >= CUT).astype(np.int32), pa.int32())}
            yield pa.RecordBatch.from_arrays([new.get(n, batch.column(i)) for i, n in enumerate(names)], schema=batch.schema)

    return out.mapInArrow(judge, schema)
