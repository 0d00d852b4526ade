"""Toxicity by weak supervision.

1. Lexicon: words of a bounded labelled sample (held-out rows left out) that mark toxic documents.
2. Voters: the lexicon dealt out to several voters, and patterns (density, distinct words, insults, shouting).
3. Label model: over the votes of ALL documents, expectation-maximisation estimates how often each voter fires on
   toxic and on other documents. Votes of voters that fire together within a class say the same thing twice:
   their log-odds are divided by the voter's summed correlation.
4. A linear classifier over lexicon words and hit counts is trained on the sample with the model's posteriors as labels.

Only counts of vote patterns (at most 2 ** VOTERS), LEXICON_WORDS words and the signals of the bounded sample reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hostweave.llm.substring_dedup import _arrow
from hostweave.llm.tables import stored
from hostweave.llm.tokens import pieces
from hostweave.llm.training import SAMPLE_ROWS, held_out, labelled_sample

LEXICON_VOTERS = 6
VOTERS = LEXICON_VOTERS + 4
LEXICON_WORDS = 400
LEAST_Z, LEAST_SHARE = 6.0, 0.6
# Plain English insults, one voter that knows nothing of the labels.
INSULTS = frozenset("idiot idiots moron morons stupid scum trash loser losers pathetic worthless disgusting clown dumb bastard bitch".split())
_WORD = regex.compile(r"[\p{L}\p{M}]+")


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def _marked_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for p in pieces(batches, "_text"):
        y = p.column("_y").to_pylist()
        found = [(w, v) for t, v in zip(p.column("_text").to_pylist(), y, strict=True) for w in sorted(set(words_of(t)))]
        yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in found], pa.string()), pa.array([v for _, v in found], pa.float64())], ["w", "y"])


def lexicon(sample: DataFrame) -> list[str]:
    """Words whose share of toxic documents is far above the base rate, the LEXICON_WORDS strongest; counted in the tasks."""
    n1, n = sample.agg(F.coalesce(F.sum("_y"), F.lit(0.0)), F.count("*").cast("double")).first()
    if not 0 < n1 < n:
        return []
    counted = sample.mapInArrow(_marked_words, "w string, y double").groupBy("w").agg(F.sum("y").alias("k"), F.count("*").alias("every"))
    rate = n1 / n
    z = (F.col("k") - F.col("every") * rate) / F.sqrt(F.col("every") * rate * (1 - rate))
    strong = counted.withColumn("z", z).filter((F.col("k") > 0) & (F.col("z") >= LEAST_Z) & (F.col("k") >= LEAST_SHARE * F.col("every")))
    return [r["w"] for r in strong.orderBy(F.desc("z"), "w").limit(LEXICON_WORDS).collect()]


@dataclass
class Signals:
    """What the voters and the classifier look at in some texts."""

    hits: np.ndarray  # (texts, lexicon words): whether the word occurs
    counts: np.ndarray  # (texts, 4): hits, words, insults, capital letters per letter

    @property
    def votes(self) -> np.ndarray:
        total, n, insults, upper = self.counts.T
        group = [self.hits[:, i::LEXICON_VOTERS].any(1) for i in range(LEXICON_VOTERS)]
        return np.stack([*group, total > 0.005 * np.maximum(n, 1), self.hits.sum(1) >= 2, insults > 0, upper > 0.5], axis=1)

    @property
    def inputs(self) -> np.ndarray:
        total, n, insults, _ = self.counts.T
        more = np.stack([np.log1p(total), np.log1p(self.hits.sum(1)), np.minimum(100 * total / np.maximum(n, 1), 5), np.log1p(insults)], axis=1)
        return np.concatenate([self.hits, more], axis=1).astype(float)


def signals(texts: list[str | None], words: dict[str, int]) -> Signals:
    hits = np.zeros((len(texts), len(words)), bool)
    counts = np.zeros((len(texts), 4))
    for i, t in enumerate(texts):
        found = words_of(t)
        at = [words[w] for w in found if w in words]
        hits[i, at] = True
        letters = sum(map(len, found))
        upper = sum(map(str.isupper, t)) if t and t != t.lower() else 0
        counts[i] = len(at), len(found), sum(w in INSULTS for w in found), upper / max(letters, 1)
    return Signals(hits, counts)


@dataclass
class LabelModel:
    prior: float
    fire: np.ndarray  # (2, voters): how often each voter fires on other and on toxic documents
    discount: np.ndarray  # summed correlation of each voter with all voters, at least 1

    def probability(self, votes: np.ndarray) -> np.ndarray:
        clean, toxic = self.fire
        yes, no = np.log(toxic / clean) / self.discount, np.log((1 - toxic) / (1 - clean)) / self.discount
        z = np.log(self.prior / (1 - self.prior)) + votes @ yes + (~votes) @ no
        return 1 / (1 + np.exp(-np.clip(z, -700, 700)))


def fit_label_model(patterns: np.ndarray, counts: np.ndarray, rounds: int = 50) -> LabelModel:
    """EM from vote patterns; pseudo-counts (one document in a hundred) keep toxic the class in which voters fire."""
    v = patterns.astype(float)
    total = max(counts.sum(), 1.0)
    weak = total / 100
    start = np.array([np.full(VOTERS, 0.01), np.full(VOTERS, 0.5)])
    model = LabelModel(0.1, start.copy(), np.ones(VOTERS))
    for _ in range(rounds):
        p = model.probability(patterns)
        fire, shared = [], np.zeros((VOTERS, VOTERS))
        for cls, w in enumerate((counts * (1 - p), counts * p)):
            rate = (w @ v + start[cls] * weak) / (w.sum() + weak)
            fire.append(np.clip(rate, 1e-4, 1 - 1e-4))
            d = v - rate
            cov = (d * w[:, None]).T @ d / (w.sum() + weak)
            sd = np.sqrt(np.maximum(np.diag(cov), 1e-6))
            shared += w.sum() / total * np.clip(cov / np.outer(sd, sd), 0, 1)
        np.fill_diagonal(shared, 1)
        model = LabelModel((counts @ p + 0.1 * weak) / (total + weak), np.array(fire), np.maximum(shared.sum(0), 1))
    return model


@dataclass
class Toxicity:
    words: dict[str, int]
    model: LabelModel
    weights: np.ndarray
    bias: float

    def score(self, texts: list[str | None]) -> np.ndarray:
        z = signals(texts, self.words).inputs @ self.weights + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -700, 700)))


def logistic(x: np.ndarray, y: np.ndarray, rounds: int = 300, ridge: float = 1e-3) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels by Nesterov's gradient method."""
    if not len(y):
        return np.zeros(x.shape[1]), -3.0
    w, b = np.zeros(x.shape[1]), float(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)))
    step = 4.0 / max(float((x**2).sum(1).mean()) + 1, 1.0)
    vw, vb, lw, lb = w.copy(), b, w.copy(), b
    for k in range(rounds):
        g = 1 / (1 + np.exp(-np.clip(x @ vw + vb, -700, 700))) - y
        w, b = vw - step * (x.T @ g / len(y) + ridge * vw), vb - step * g.mean()
        vw, vb = w + k / (k + 3) * (w - lw), b + k / (k + 3) * (b - lb)
        lw, lb = w, b
    return w, b


def _pattern_votes(words: dict[str, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p in pieces(batches, "_text"):
            code = signals(p.column("_text").to_pylist(), words).votes @ (1 << np.arange(VOTERS))
            value, n = np.unique(code, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(value, pa.int32()), pa.array(n, pa.int64())], ["votes", "n"])

    return run


def _sample_signals(sample: DataFrame, words: dict[str, int]) -> Signals:
    """The signals of the sample, computed in the tasks; rows of one size each reach the driver, in a fixed order."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p in pieces(batches, "_text"):
            s = signals(p.column("_text").to_pylist(), words)
            packed = np.packbits(s.hits, axis=1) if words else np.zeros((p.num_rows, 0), np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array([h.tobytes() + c.tobytes() for h, c in zip(packed, s.counts, strict=True)], pa.binary())], ["row"])

    width = -(-len(words) // 8)
    got = sorted(bytes(r["row"]) for r in sample.mapInArrow(run, "row binary").toLocalIterator())
    hits = np.array([np.frombuffer(r, np.uint8, width) for r in got], np.uint8).reshape(len(got), width)
    counts = np.array([np.frombuffer(r, float, 4, width) for r in got], float).reshape(len(got), 4)
    return Signals(np.unpackbits(hits, axis=1, count=len(words)).astype(bool) if words else np.zeros((len(got), 0), bool), counts)


def fit_toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", rows: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text") -> Toxicity:
    """Lexicon and classifier from at most ``rows`` labelled documents that are not held out, the label model from all
    documents. Without labels of both kinds only the fixed insults speak."""
    sample = stored(labelled_sample(docs, labels, label, id_col, text_col, rows))
    words = {w: i for i, w in enumerate(lexicon(sample))}
    seen = docs.select(F.col(text_col).alias("_text")).mapInArrow(_pattern_votes(words), "votes int, n long")
    patterns = sorted(tuple(r) for r in seen.groupBy("votes").agg(F.sum("n")).collect())  # at most 2 ** VOTERS
    code = np.array([c for c, _ in patterns], np.int64)
    model = fit_label_model((code[:, None] >> np.arange(VOTERS) & 1).astype(bool), np.array([n for _, n in patterns], float))
    s = _sample_signals(sample, words)
    return Toxicity(words, model, *logistic(s.inputs, model.probability(s.votes)))


def scored(docs: DataFrame, fitted: Toxicity, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: (id_col, held_out, score). Null and empty texts get the score of a text without
    words; repeated rows are scored one by one; a null id is never held out; other columns are ignored."""
    base = docs.select(F.col(id_col).alias("_id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("_text"))
    kind = base.schema["_id"].dataType
    arrow = _arrow(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p in pieces(batches, "_text"):
            yield pa.RecordBatch.from_arrays([p.column("_id").cast(arrow), p.column("held_out"), pa.array(fitted.score(p.column("_text").to_pylist()))], ["_id", "held_out", "score"])

    return base.mapInArrow(run, f"_id {kind.simpleString()}, held_out boolean, score double").withColumnRenamed("_id", id_col)
