"""Tokenizing whole columns: texts are cut at spaces into segments, each distinct segment is encoded once.

A segment begins at a space, tab or line feed that follows a visible character, and at a mark of ``.,;:!?`` that follows an ASCII letter. None of
the tokenizers used here joins such a pair of characters in one token (tests look through their vocabularies), so the
ids of a text are those of its segments one after another.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable
from functools import cache

import numpy as np
import pyarrow as pa

CACHE_ENTRIES = 500_000
CACHE_VALUES = 4_000_000
ENCODED = 8192  # segments encoded at a time: the tokenizers' own records of them are large


def byte_letters() -> dict[str, int]:
    """Byte-level vocabularies write a byte as a printable letter: itself, or the next free code point from 256."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {chr(b): b for b in own}
    out.update((chr(256 + i), b) for i, b in enumerate(b for b in range(256) if b not in set(own)))
    return out


PLAIN = re.compile("[a-zß-öø-ÿ]+")


def plain_letters() -> dict[int, str]:
    """Translation of the letters of ``PLAIN`` to byte-level ones. Such a word is its own lower case and composed form and one
    word to the tokenizers' patterns, so their model can take it directly."""
    letters = {b: c for c, b in byte_letters().items()}
    return {i: "".join(letters[b] for b in chr(i).encode()) for i in [*range(97, 123), *range(0xDF, 0x100)]}


def _cuts() -> np.ndarray:
    """Whether a segment begins between two bytes, both in ASCII: table over 256 * first + second."""
    out = np.zeros((256, 256), bool)
    out[33:127, [9, 10, 32]] = True
    letters = [*range(65, 91), *range(97, 123)]
    out[np.ix_(letters, [ord(c) for c in ".,;:!?"])] = True
    return out.reshape(-1)


CUT = _cuts()
BLANK = np.isin(np.arange(256), (9, 10, 32))


def vocabulary(name: str) -> str:
    """Path of an installed public vocabulary file."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


@cache
def word_tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def segments(data: np.ndarray, offsets: np.ndarray, fold: bool = False) -> tuple[np.ndarray, pa.LargeBinaryArray]:
    """(text number, bytes) of each segment of the texts that lie one after another in ``data``. ``fold`` is for tokenizers that drop
    white space and case: segments lose the blank they begin with, and ASCII capitals."""
    if not len(data):
        return np.zeros(0, np.int64), pa.array([], pa.large_binary())
    cut = np.zeros(len(data), bool)
    cut[1:] = CUT[data[:-1].astype(np.int64) * 256 + data[1:]]
    # after a character beyond ASCII: white space among these (and the sign a piece model writes for a space) has one of a few
    # bytes before its last; none of those is cut
    at = np.flatnonzero(BLANK[data[1:]] & (data[:-1] >= 128)) + 1
    at = at[at > 1]
    one, two = data[at - 1], data[at - 2]
    blank = ((two == 0xC2) & ((one == 0x85) | (one == 0xA0))) | np.isin(two, (0x80, 0x81, 0x96, 0x9A))
    cut[at[~blank]] = True
    cut[offsets[:-1][np.diff(offsets) > 0]] = True
    at = np.flatnonzero(cut)
    doc = np.searchsorted(offsets, at, "right") - 1
    if fold:
        data = _folded(data)
        keep = np.ones(len(data), bool)
        keep[at] = ~BLANK[data[at]]
        at = at - np.cumsum(~keep[at]) + ~keep[at]
        data = data[keep]
    ends = np.append(at, len(data)).astype(np.int64)
    raw = np.ascontiguousarray(data)
    return doc, pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(ends), pa.py_buffer(raw)])


def _folded(data: np.ndarray) -> np.ndarray:
    """ASCII capitals in lower case, but for those before a character beyond ASCII (which may combine with the capital only) and
    where strings of special tokens, in which case matters, could stand."""
    if ((data[:-1] == ord("<")) & (data[1:] == ord("|"))).any():
        return data
    capital = (data >= 65) & (data <= 90)
    capital[:-1] &= data[1:] < 128
    return np.where(capital, data + np.uint8(32), data)


def gather(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of all elements of the runs (start, length), one run after another."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    skip = np.cumsum(lengths) - lengths
    return np.arange(total) + np.repeat(starts - skip, lengths)


class Memo:
    """Values of segments, kept from batch to batch in bounded space: some numbers and a run of integers each, and a string."""

    def __init__(self, encode: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray, np.ndarray, list[str]]], limit: int = CACHE_ENTRIES):
        self.encode, self.limit = encode, limit
        self._clear()

    def _clear(self) -> None:
        self.entry: dict[bytes, int] = {}
        self.facts = np.zeros((0, 0), np.int64)
        self.lengths = np.zeros(0, np.int64)
        self.starts = np.zeros(0, np.int64)
        self.values = np.zeros(0, np.int64)
        self.strings: list[str] = []

    def look_up(self, segment: pa.LargeBinaryArray) -> np.ndarray:
        """Number of the entry of each segment; valid until the next call."""
        if len(self.entry) > self.limit or len(self.values) > CACHE_VALUES:
            self._clear()
        coded = segment.dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        new = [s for s in distinct if s not in self.entry]
        if new:
            parts = [self.encode(new[i : i + ENCODED]) for i in range(0, len(new), ENCODED)]
            facts, lengths, values = (np.concatenate([x[k] for x in parts]) for k in range(3))
            strings = [s for x in parts for s in x[3]]
            self.entry.update(zip(new, range(len(self.entry), len(self.entry) + len(new)), strict=True))
            self.facts = np.concatenate([self.facts, facts]) if len(self.facts) else facts
            self.starts = np.concatenate([self.starts, len(self.values) + np.cumsum(lengths) - lengths])
            self.lengths = np.concatenate([self.lengths, lengths])
            self.values = np.concatenate([self.values, values.astype(np.int64)])
            self.strings.extend(strings)
        of = np.fromiter(map(self.entry.__getitem__, distinct), np.int64, len(distinct))
        return of[coded.indices.to_numpy()] if len(of) else np.zeros(0, np.int64)
