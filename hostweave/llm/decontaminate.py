"""Benchmark decontamination with spaced seeds.

A seed mask picks fixed positions of a run of words and ignores the others, so one substituted word spoils only
the masks that look at it. Hashes of every benchmark run under every mask meet the hashes of every document
run under the same mask. A hit fixes a diagonal (document word minus item word); the stretch of that diagonal with most
agreeing words, among those in which at least ``share`` of the words agree, is an overlap.

The benchmark is handled in blocks of at most BLOCK_WORDS words, the only thing sent to all tasks. Each block is
one pass over the documents, without a shuffle; no document, item or hit is left out at any size.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hostweave.llm.substring_dedup import _arrow
from hostweave.llm.tokens import Words, flat, mix, pieces, powers, split_words, window_hashes, windows_inside

# 1 is looked at, 0 is ignored.
MASKS = ("1101101", "11001011", "110100101", "1110011")
SHORTEST = min(map(len, MASKS))
BLOCK_WORDS = 1 << 18
_FILTER_BITS = 22


def mask_hashes(words: Words, mask: str) -> tuple[np.ndarray, np.ndarray]:
    """(number of the first word, hash) of every run of len(mask) words inside one text."""
    at = np.flatnonzero(windows_inside(words, len(mask)))
    total = np.zeros(len(at), np.uint64)
    up, _ = powers(0xD6E8FEB86659FD93, len(mask) + 1)
    for i, c in enumerate(mask):
        if c == "1":
            total += words.hash[at + i] * up[i]
    return at, mix(total ^ np.uint64(int(mask, 2) + len(mask) * 0x9E3779B97F4A7C15 % (1 << 64)))


def best_stretch(equal: np.ndarray, share: float) -> tuple[int, int, int]:
    """(begin, end, agreeing words) of the stretch that gains most when a word that differs costs share/(1-share)."""
    score = np.append(0.0, np.cumsum(np.where(equal, 1.0, -share / (1 - share))))
    low = np.minimum.accumulate(score)
    end = int(np.argmax(score - low))
    begin = int(np.flatnonzero(score[: end + 1] == low[end])[-1])
    return begin, end, int(equal[begin:end].sum())


def longest_stretch(equal: np.ndarray, share: float) -> tuple[int, int, int]:
    """(begin, end, agreeing words) of the stretch with most agreeing words among those in which at least ``share`` of
    the words agree; of several the shortest, then the first."""
    part = Fraction(str(share))
    score = np.append(0, np.cumsum(np.where(equal, part.denominator - part.numerator, -part.numerator)))
    high = np.maximum.accumulate(score[::-1])
    # the last place from which on the score is no lower than at each place
    last = len(equal) - np.searchsorted(high, score)
    long = last - np.arange(len(score))
    if not (most := int(long.max())):
        return 0, 0, 0
    # a stretch with most agreeing words can be widened to the greatest length, so the longest ones hold it
    begin = np.flatnonzero(long == most)
    place, same = np.flatnonzero(equal), np.append(0, np.cumsum(equal))
    begin = begin[same[begin + most] - same[begin] == (same[begin + most] - same[begin]).max()]
    first, end = place[same[begin]], place[same[begin + most] - 1] + 1
    k = int(np.argmin(end - first))
    return int(first[k]), int(end[k]), int(same[end[k]] - same[first[k]])


class _Block:
    """Hashes and words of some benchmark items, ready for look-up."""

    def __init__(self, ids: list, texts: list[str]):
        words = split_words(*flat(pa.array(texts, pa.string())), lower=True)
        counts, first = words.counts, words.first
        self.ids = ids
        self.items = [words.hash[first[i] : first[i + 1]] for i in range(len(ids))]
        self.masks: dict[str, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}
        for mask in [*MASKS, *("1" * n for n in range(1, SHORTEST))]:
            at, h = mask_hashes(words, mask)
            if len(mask) < SHORTEST:  # only for items too short for any mask: the whole item
                whole = counts[words.doc[at]] == len(mask)
                at, h = at[whole], h[whole]
            if len(h):
                order = np.argsort(h)
                at, h = at[order], h[order]
                table = np.zeros(1 << _FILTER_BITS, bool)
                table[h >> np.uint64(64 - _FILTER_BITS)] = True
                self.masks[mask] = (table, h, words.doc[at], words.place[at])

    def find(self, words: Words, least: int, share: float) -> dict[tuple[int, int], tuple[int, int, int]]:
        """(text number, item number) -> best (first word, words, agreeing words)."""
        found: set[tuple[int, int, int]] = set()
        first, counts = words.first, words.counts
        for mask, (table, keys, item, place) in self.masks.items():
            at, h = mask_hashes(words, mask)
            maybe = table[h >> np.uint64(64 - _FILTER_BITS)]
            at, h = at[maybe], h[maybe]
            low, high = np.searchsorted(keys, h, "left"), np.searchsorted(keys, h, "right")
            for a, x, y in zip(at.tolist(), low.tolist(), high.tolist(), strict=True):
                d = int(words.doc[a])
                found.update((d, int(item[k]), a - int(first[d]) - int(place[k])) for k in range(x, y))
        out: dict[tuple[int, int], tuple[int, int, int]] = {}
        for d, t, shift in sorted(found):
            own = self.items[t]
            a, z = max(0, -shift), min(len(own), int(counts[d]) - shift)
            begin, end, same = longest_stretch(own[a:z] == words.hash[first[d] + shift + a : first[d] + shift + z], share)
            if same >= min(least, -(-len(own) * share // 1)) and same > out.get((d, t), (0, 0, 0))[2]:
                out[d, t] = (shift + a + begin, end - begin, same)
        return out


def _blocks(benchmark: DataFrame, id_col: str, text_col: str) -> Iterator[_Block]:
    ids, texts, size = [], [], 0
    for row in benchmark.select(id_col, text_col).filter(F.col(text_col).isNotNull()).toLocalIterator():
        n = len(row[1].split())
        if ids and size + n > BLOCK_WORDS:
            yield _Block(ids, texts)
            ids, texts, size = [], [], 0
        ids.append(row[0])
        texts.append(row[1])
        size += n
    if ids:
        yield _Block(ids, texts)


def _hits(shared, least: int, share: float, types: list[pa.DataType]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        for p in pieces(batches, "_text"):
            found = block.find(split_words(*flat(p.column("_text")), lower=True), least, share)
            if found:
                spans = np.array(list(found.values()), np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        p.column("_id").take(pa.array([d for d, _ in found])).cast(types[0]),
                        pa.array([block.ids[t] for _, t in found], types[1]),
                        pa.array([len(block.items[t]) for _, t in found], pa.int64()),
                        *[pa.array(spans[:, i]) for i in range(3)],
                    ],
                    ["_id", "_item", "item_words", "first_word", "n_words", "n_equal"],
                )

    return run


def overlaps(
    docs: DataFrame, benchmark: DataFrame, least: int = 13, share: float = 0.75,
    id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """One row per document row and benchmark item that overlap, with the longest overlap:
    (id_col, item_col, item_words, first_word, n_words, n_equal).

    Words are compared with A-Z lower-cased. An overlap needs ``least`` agreeing words, or that share of a
    shorter item, in a stretch of which at least ``share`` agree. Null and empty texts and items overlap with nothing; repeated rows
    and items give repeated rows; other columns are ignored.
    """
    base = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    kinds = [base.schema["_id"].dataType, benchmark.schema[item_col].dataType]
    ddl = f"_id {kinds[0].simpleString()}, _item {kinds[1].simpleString()}, item_words long, first_word long, n_words long, n_equal long"
    out = docs.sparkSession.createDataFrame([], ddl)
    for block in _blocks(benchmark, item_col, item_text):
        shared = docs.sparkSession.sparkContext.broadcast(block)
        out = out.unionByName(base.mapInArrow(_hits(shared, least, share, [_arrow(k) for k in kinds]), ddl))
    doc_name = id_col if id_col != item_col else f"doc_{id_col}"
    return out.withColumnsRenamed({"_id": doc_name, "_item": item_col})


def decontaminated(
    docs: DataFrame, benchmark: DataFrame, least: int = 13, share: float = 0.75,
    text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """The rows of ``docs`` that overlap with no item, unchanged (see overlaps)."""
    def clean(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for p in pieces(batches, text_col):
                found = shared.value.find(split_words(*flat(p.column(text_col)), lower=True), least, share)
                keep = np.ones(p.num_rows, bool)
                keep[[d for d, _ in found]] = False
                yield p.filter(pa.array(keep))

        return run

    out = docs
    for block in _blocks(benchmark, item_col, item_text):
        out = out.mapInArrow(clean(docs.sparkSession.sparkContext.broadcast(block)), docs.schema)
    return out
