"""Words and word windows of whole text batches as numpy arrays, straight from Arrow buffers.

A word is a longest run of bytes other than space, tab, line feed, vertical tab, form feed and carriage
return. Those are ASCII, so working on UTF-8 bytes gives the same words as working on characters.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
PIECE_BYTES = 1 << 20
_CHUNK = 1 << 17
_BYTE_BASE, _WORD_BASE = 0x9E3779B97F4A7C15 | 1, 0xD6E8FEB86659FD93 | 1


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@cache
def _byte_values(lower: bool) -> np.ndarray:
    values = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x2545F4914F6CDD1D)) | np.uint64(1)
    return values[LOWER] if lower else values


@cache
def _powers(base: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < size (an odd base has an inverse)."""
    inverse = pow(base, -1, 1 << 64)
    out = []
    for b in (base, inverse):
        p = np.full(size, b, np.uint64)
        p[0] = 1
        out.append(np.cumprod(p, dtype=np.uint64))
    return out[0], out[1]


def powers(base: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    rounded = 1 << max(16, int(size).bit_length())
    if rounded > 1 << 21:  # a giant word or document: not worth keeping
        return _powers.__wrapped__(base, rounded)
    return _powers(base, rounded)


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts one after another, and where each begins (and the last ends); null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    _, offsets, data = texts.buffers()
    off = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


@dataclass
class Words:
    """Words in text order: number of the text, first byte, byte after the last, 64-bit hash."""

    n_texts: int
    doc: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray

    @property
    def first(self) -> np.ndarray:
        """Number of the first word of each text, and the number of words at the end."""
        return np.searchsorted(self.doc, np.arange(self.n_texts + 1))

    @property
    def counts(self) -> np.ndarray:
        return np.bincount(self.doc, minlength=self.n_texts)

    @property
    def place(self) -> np.ndarray:
        """Position of each word in its text."""
        return np.arange(len(self.doc)) - self.first[self.doc]


def split_words(data: np.ndarray, offsets: np.ndarray, lower: bool = False) -> Words:
    n = len(offsets) - 1
    if not len(data):
        z = np.zeros(0, np.int64)
        return Words(n, z, z, z, z.astype(np.uint64))
    word = ~SPACE[data]
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    cut = offsets[1:-1]
    begins, ends = cut[cut < len(data)], cut[cut > 0]
    first[begins] = word[begins]
    last[ends - 1] = word[ends - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    doc = np.searchsorted(offsets, start, "right") - 1
    return Words(n, doc, start, end, _word_hashes(data, start, end, lower))


def _word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, lower: bool) -> np.ndarray:
    """Polynomial hash of each word from running sums, in chunks of bounded size that end at word ends."""
    out, values, i = np.empty(len(start), np.uint64), _byte_values(lower), 0
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(end, start[i] + _CHUNK, "right")))
        a, z = int(start[i]), int(end[j - 1])
        up, down = powers(_BYTE_BASE, z - a + 1)
        sums = np.zeros(z - a + 1, np.uint64)
        np.cumsum(values[data[a:z]] * up[: z - a], out=sums[1:])
        s = start[i:j] - a
        out[i:j] = mix((sums[end[i:j] - a] - sums[s]) * down[s])
        i = j
    return out


def window_hashes(hashes: np.ndarray, size: int, seed: int = 0) -> np.ndarray:
    """Hash of each run of ``size`` consecutive values (``len - size + 1`` of them)."""
    n = len(hashes)
    if n < size:
        return np.zeros(0, np.uint64)
    up, down = powers(_WORD_BASE, n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(mix(hashes ^ np.uint64((seed * 0xA24BAED4963EE407 + 0x9FB21C651E98DF25) % (1 << 64))) * up[:n], out=sums[1:])
    return mix((sums[size:] - sums[:-size]) * down[: n - size + 1])


def windows_inside(words: Words, size: int) -> np.ndarray:
    """Whether the run of ``size`` words that begins at each word stays in one text (as window_hashes)."""
    n = len(words.doc) - size + 1
    return words.doc[:n] == words.doc[size - 1 :] if n > 0 else np.zeros(0, bool)


def pieces(batches: Iterator[pa.RecordBatch], text: str, limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of bounded text size (a longer text comes alone), so that memory stays small."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends, i = np.cumsum(size), 0
        while i < batch.num_rows:
            before = ends[i - 1] if i else 0
            j = max(i + 1, int(np.searchsorted(ends, before + limit, "right")))
            yield batch.slice(i, j - i)
            i = j


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(_id, _h, _text): what identifies a row. _h tells rows apart that share an id but not the text."""
    return docs.select(F.col(id_col).alias("_id"), F.hash(F.col(text_col)).alias("_h"), F.col(text_col).alias("_text"))


def same_doc(a: DataFrame, b: DataFrame) -> Column:
    """Join condition on the row's identity; null ids meet each other."""
    return a["_id"].eqNullSafe(b["_id"]) & (a["_h"] == b["_h"])
