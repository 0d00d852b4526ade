"""Quality classifier: histogram gradient-boosted trees over document statistics.

The trees are grown on binned statistics of a bounded sample of labelled documents and flattened into arrays;
scoring walks all documents of a piece down all trees at once. Labels, language, source and id are no inputs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hostweave.llm.quality_rules import COUNTS, RULES, statistics
from hostweave.llm.substring_dedup import _arrow
from hostweave.llm.tokens import flat, pieces
from hostweave.llm.training import SAMPLE_ROWS, held_out, labelled_sample

TREES, DEPTH, RATE, BINS, RIDGE = 80, 4, 0.15, 64, 1.0


def features(texts: pa.Array) -> np.ndarray:
    """One row of statistics per text; not a number where a statistic has nothing to look at."""
    s = statistics(texts)
    data, offsets = flat(texts)
    size = np.maximum(np.diff(offsets), 1)

    def share(mask: np.ndarray) -> np.ndarray:
        return np.diff(np.append(0, np.cumsum(mask))[offsets]) / size

    columns = [np.log1p(s[c]) for c in COUNTS] + [s[r[0]] for r in RULES]
    columns += [
        share((data >= 48) & (data <= 57)),
        share(data == 10),
        share((data == 44) | (data == 46)),
        share(data >= 0x80),
        share((data == 64) | (data == 47) | (data == 58)),
        np.log1p(np.diff(offsets)),
    ]
    return np.stack(columns, axis=1).astype(np.float64)


@dataclass
class Trees:
    """All trees as arrays: node k of a tree has children 2k+1 and 2k+2; after DEPTH steps a leaf is reached."""

    base: float
    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for f, t, leaf in zip(self.feature, self.threshold, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[rows, f[node]] > t[node])  # not a number goes left
            z += leaf[node - len(f)]
        return 1 / (1 + np.exp(-np.clip(z, -700, 700)))


def grow(x: np.ndarray, y: np.ndarray) -> Trees:
    """Fit by second-order boosting of the logistic loss. Fewer than two classes give a constant score."""
    inner = (1 << DEPTH) - 1
    rate = (y.sum() + 0.5) / (len(y) + 1.0)
    base = float(np.log(rate / (1 - rate)))
    if len(np.unique(y)) < 2:
        return Trees(base, np.zeros((0, inner), int), np.zeros((0, inner)), np.zeros((0, inner + 1)))
    cuts = [np.unique(np.quantile(c[np.isfinite(c)], np.linspace(0, 1, BINS + 1)[1:-1])) if np.isfinite(c).any() else np.zeros(1) for c in x.T]
    bins = np.stack([np.where(np.isfinite(c), np.searchsorted(k, c, "left") + 1, 0) for c, k in zip(x.T, cuts, strict=True)])  # x <= cut[b-1] in bins <= b
    out_f, out_t, out_v = [], [], []
    z = np.full(len(y), base)
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-z))
        g, h = p - y, np.maximum(p * (1 - p), 1e-9)
        node = np.zeros(len(y), np.int64)
        f_of, t_of = np.zeros(inner, np.int64), np.full(inner, np.inf)
        for level in range(DEPTH):
            first, n = (1 << level) - 1, 1 << level
            best, where, cut = np.full(n, 1e-6), np.zeros(n, np.int64), np.full(n, np.inf)
            for j, b in enumerate(bins):
                width = len(cuts[j]) + 2
                at = (node - first) * width + b
                gs, hs = (np.bincount(at, w, n * width).reshape(n, width) for w in (g, h))
                gl, hl = gs.cumsum(1)[:, 1:-1], hs.cumsum(1)[:, 1:-1]
                gt, ht = gs.sum(1, keepdims=True), hs.sum(1, keepdims=True)
                gain = gl**2 / (hl + RIDGE) + (gt - gl) ** 2 / (ht - hl + RIDGE) - gt**2 / (ht + RIDGE)
                gain[(hl < 1e-3) | (ht - hl < 1e-3)] = 0
                top = gain.argmax(1)
                value = gain[np.arange(n), top]
                better = value > best
                best[better], where[better], cut[better] = value[better], j, cuts[j][top[better]]
            f_of[first : first + n], t_of[first : first + n] = where, cut
            node = 2 * node + 1 + (x[np.arange(len(y)), f_of[node]] > t_of[node])
        leaf = node - inner
        value = -RATE * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + RIDGE)
        z += value[leaf]
        out_f.append(f_of)
        out_t.append(t_of)
        out_v.append(value)
    return Trees(base, np.array(out_f), np.array(out_t), np.array(out_v))


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for p in pieces(batches, "_text"):
        yield pa.RecordBatch.from_arrays([pa.array(features(p.column("_text")).tolist(), pa.list_(pa.float64())), p.column("_y")], ["x", "y"])


def fit_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text") -> Trees:
    """Trees learnt from at most ``rows`` labelled documents that are not held out; their statistics come to the driver."""
    sample = labelled_sample(docs, labels, label, id_col, text_col, rows).mapInArrow(_sampled, "x array<double>, y double").collect()
    sample.sort(key=lambda r: (r["y"], [(v != v, v) for v in r["x"]]))
    width = len(COUNTS) + len(RULES) + 6
    x = np.array([r["x"] for r in sample], float).reshape(-1, width)
    return grow(x, np.array([r["y"] for r in sample], float))


def scored(docs: DataFrame, trees: Trees, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: (id_col, held_out, score). Null and empty texts get the score of their (empty)
    statistics; repeated rows are scored one by one; a null id is never held out; other columns are ignored."""
    base = docs.select(F.col(id_col).alias("_id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("_text"))
    kind = base.schema["_id"].dataType
    arrow = _arrow(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p in pieces(batches, "_text"):
            yield pa.RecordBatch.from_arrays([p.column("_id").cast(arrow), p.column("held_out"), pa.array(trees.score(features(p.column("_text"))))], ["_id", "held_out", "score"])

    return base.mapInArrow(run, f"_id {kind.simpleString()}, held_out boolean, score double").withColumnRenamed("_id", id_col)
