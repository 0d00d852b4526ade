"""Quality rules as weak supervision.

Each rule looks at one statistic of a document and votes good, bad or abstains. Expectation-maximisation over all
documents' votes (two classes, rules independent given the class) estimates how often each rule votes good or
bad in either class, without labels. A document is kept by its posterior probability of being good,
instead of having to satisfy every rule.

Only counts of vote patterns reach the driver: at most 3 ** len(RULES) of them, however large the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hostweave.llm.substring_dedup import _arrow
from hostweave.llm.tokens import SPACE, flat, pieces, split_words, window_hashes, windows_inside

# (statistic, bad below, good from, good up to, bad above); None: no such limit. Abstains in between.
RULES = (
    ("symbols_per_word", None, None, 0.02, 0.1),
    ("marks_per_word", None, None, 0.05, 0.25),
    ("upper_share", None, None, 0.15, 0.4),
    ("word_length", 2.0, 3.0, 9.0, 14.0),
    ("letter_words", 0.7, 0.85, None, None),
    ("plain_words", 0.6, 0.8, None, None),
    ("repeat_share", None, None, 0.02, 0.25),
    ("dup_line_share", None, None, 0.05, 0.3),
    ("distinct_share", 0.15, 0.3, None, None),
)
RIGHT_GOOD, RIGHT_BAD = 0.995, 0.15  # before EM: share of good votes in good documents, of bad votes in bad ones


def _sums(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return np.diff(np.append(0, np.cumsum(mask))[offsets])


def _again(doc: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(occurs twice or more in its text, occurred before in its text) for each hash."""
    order = np.lexsort((h, doc))  # stable: earlier ones stay first
    same = (doc[order][1:] == doc[order][:-1]) & (h[order][1:] == h[order][:-1])
    several, later = np.zeros(len(h), bool), np.zeros(len(h), bool)
    several[order[1:][same]] = several[order[:-1][same]] = True
    later[order[1:][same]] = True
    return several, later


def statistics(texts: pa.Array) -> dict[str, np.ndarray]:
    """Counts of each text, and what the rules look at."""
    data, offsets = flat(texts)
    words = split_words(data, offsets)
    n, first = words.counts, words.first
    space = SPACE[data]
    out = {
        "n_words": n,
        "word_chars": _sums(~space & ((data & 0xC0) != 0x80), offsets),
        "n_symbols": _sums(np.isin(data, np.frombuffer(b"#*$%&|<>", np.uint8)), offsets),
    }
    # lines: runs of bytes between line feeds, as words with the line feed as the only space
    lines = _lines(data, offsets)
    has_word = np.append(0, np.cumsum(~space))
    real = has_word[lines.end] > has_word[lines.start]
    ld, lh = lines.doc[real], lines.hash[real]
    out["n_dup_lines"] = np.bincount(ld[_again(ld, lh)[1]], minlength=words.n_texts)
    inside = np.flatnonzero(windows_inside(words, 8))
    twice, _ = _again(words.doc[inside], window_hashes(words.hash, 8, 4)[inside])
    marks = np.zeros(len(words.doc) + 1, np.int32)
    np.add.at(marks, inside[twice], 1)
    np.add.at(marks, inside[twice] + 8, -1)
    out["n_repeat_words"] = np.bincount(words.doc[np.cumsum(marks)[:-1] > 0], minlength=words.n_texts)
    with np.errstate(divide="ignore", invalid="ignore"):
        letter = ((data | 0x20) >= 97) & ((data | 0x20) <= 122)
        upper = (data >= 65) & (data <= 90)
        plain = letter | (data >= 0x80) | ((data >= 48) & (data <= 57)) | np.isin(data, np.frombuffer(b".,;:'\"()-", np.uint8))
        odd = np.append(0, np.cumsum(~plain))
        letter_sum = np.append(0, np.cumsum(letter | (data >= 0x80)))
        n_letters = _sums(letter, offsets)
        lettered = letter_sum[words.end] > letter_sum[words.start]
        _, later = _again(words.doc, words.hash)
        out |= {
            "symbols_per_word": out["n_symbols"] / n,
            "marks_per_word": _sums((data == 33) | (data == 63), offsets) / n,
            "upper_share": _sums(upper, offsets) / n_letters,
            "word_length": out["word_chars"] / n,
            "plain_words": np.bincount(words.doc[odd[words.end] == odd[words.start]], minlength=words.n_texts) / n,
            "letter_words": np.bincount(words.doc[lettered], minlength=words.n_texts) / n,
            "repeat_share": np.where(n >= 16, out["n_repeat_words"] / n, np.nan),
            "dup_line_share": np.where(np.bincount(ld, minlength=words.n_texts) > 1, out["n_dup_lines"] / np.bincount(ld, minlength=words.n_texts), np.nan),
            # over the first occurrence of each word; long texts repeat words anyway
            "distinct_share": np.where((n >= 20) & (n <= 2000), 1 - np.bincount(words.doc[later], minlength=words.n_texts) / n, np.nan),
        }
    del first
    return out


def _lines(data: np.ndarray, offsets: np.ndarray):
    """Lines as if they were words: other white space is lifted out of the way first."""
    held = data.copy()
    held[SPACE[data] & (data != 10)] = 0xFF  # no byte of UTF-8
    kind = data[SPACE[data] & (data != 10)]
    held[held == 0xFF] = 0xF8 + np.searchsorted(np.array([9, 11, 12, 13, 32]), kind)  # 0xF8..0xFC: no bytes of UTF-8 either
    return split_words(held, offsets)


def votes(stats: dict[str, np.ndarray]) -> np.ndarray:
    """One column per rule: 1 good, -1 bad, 0 abstains (also where there is nothing to look at)."""
    out = np.zeros((len(stats["n_words"]), len(RULES)), np.int8)
    for i, (name, bad_below, good_from, good_to, bad_above) in enumerate(RULES):
        x = stats[name]
        good = np.isfinite(x)
        good &= (x >= good_from) if good_from is not None else True
        good &= (x <= good_to) if good_to is not None else True
        bad = np.zeros(len(x), bool)
        if bad_below is not None:
            bad |= x < bad_below
        if bad_above is not None:
            bad |= x > bad_above
        out[good, i] = 1
        out[bad, i] = -1
    return out


@dataclass
class LabelModel:
    """log-odds of good: a prior, and what each rule's vote adds."""

    prior: float
    good: np.ndarray
    bad: np.ndarray

    def probability(self, v: np.ndarray) -> np.ndarray:
        z = self.prior + (v == 1) @ self.good + (v == -1) @ self.bad
        return 1 / (1 + np.exp(-np.clip(z, -700, 700)))


def fit(patterns: np.ndarray, counts: np.ndarray, rounds: int = 100) -> LabelModel:
    """Maximum a posteriori EM from vote patterns and their counts. Pseudo-counts keep the classes named.
    A rule seldom votes bad on a good document (ten times the corpus says so, or the larger class would take in every kind
    of flaw that comes alone); how many rules a bad document breaks is left to the data (one document in fifty)."""
    total = max(float(counts.sum()), 1.0)
    weak, strong = total / 50, total * 10
    g, b = patterns == 1, patterns == -1
    prior, right_good, right_bad = 0.8, np.full(patterns.shape[1], RIGHT_GOOD), np.full(patterns.shape[1], RIGHT_BAD)

    def model() -> LabelModel:
        return LabelModel(np.log(prior / (1 - prior)), np.log(right_good / (1 - right_bad)), np.log((1 - right_good) / right_bad))

    for _ in range(rounds):
        p = model().probability(patterns)
        w1, w0 = counts * p, counts * (1 - p)
        prior = (w1.sum() + 0.8 * weak) / (total + weak)
        right_good = (w1 @ g + RIGHT_GOOD * strong) / (w1 @ (g | b) + strong)
        right_bad = (w0 @ b + RIGHT_BAD * weak) / (w0 @ (g | b) + weak)
    return model()


def _pattern_votes(text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p in pieces(batches, text):
            rows, n = np.unique(votes(statistics(p.column(text))), axis=0, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(rows.tolist(), pa.list_(pa.int8())), pa.array(n, pa.int64())], ["votes", "n"])

    return run


def fit_rules(docs: DataFrame, text_col: str = "text") -> LabelModel:
    """The label model of all documents. No document: the starting values."""
    seen = docs.select(F.col(text_col).alias("_text")).mapInArrow(_pattern_votes("_text"), "votes array<tinyint>, n long")
    rows = seen.groupBy("votes").agg(F.sum("n").alias("n")).collect()  # at most 3 ** len(RULES)
    rows.sort(key=lambda r: r[0])
    return fit(np.array([r[0] for r in rows], np.int8).reshape(-1, len(RULES)), np.array([r[1] for r in rows], float))


def _verdict(stats: dict[str, np.ndarray], model: LabelModel, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    failed = (stats["n_words"] < 20) | (100 * stats["n_repeat_words"] > 30 * stats["n_words"])
    p = model.probability(votes(stats))
    return failed, p, ~failed & (p >= least)


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def judged(docs: DataFrame, model: LabelModel, least: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: (id_col, the five counts, base_failed, quality, kept).

    A null or empty text has no words and fails the base rules. Repeated rows and ids are judged one by one; null
    ids are allowed; other columns are ignored.
    """
    base = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    kind = base.schema["_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p in pieces(batches, "_text"):
            stats = statistics(p.column("_text"))
            failed, quality, kept = _verdict(stats, model, least)
            yield pa.RecordBatch.from_arrays(
                [p.column("_id").cast(arrow), *[pa.array(stats[c], pa.int64()) for c in COUNTS], pa.array(failed), pa.array(quality), pa.array(kept)],
                ["_id", *COUNTS, "base_failed", "quality", "kept"],
            )

    arrow = _arrow(kind)
    ddl = f"_id {kind.simpleString()}, {', '.join(f'{c} long' for c in COUNTS)}, base_failed boolean, quality double, kept boolean"
    return base.mapInArrow(run, ddl).withColumnRenamed("_id", id_col)


def kept_documents(docs: DataFrame, model: LabelModel, least: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are kept, unchanged."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p in pieces(batches, text_col):
            yield p.filter(pa.array(_verdict(statistics(p.column(text_col)), model, least)[2]))

    return docs.mapInArrow(run, docs.schema)
