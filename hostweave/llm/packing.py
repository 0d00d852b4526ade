"""Packing of tokenized documents into sequences: first-fit decreasing in randomised groups.

A document's ids are cut into full sequences from its start; what is left is an item. Items are dealt into groups of about
``GROUP`` by a hash, and each group is packed alone: items from long to short, each into the first open sequence
with room. A tournament tree over the sequences' free places (each inner node holds the larger of its two) finds that
one in logarithmic time. Groups have one size whatever the corpus, so a task's memory does too.

What first fit leaves open in a group is at the sequences that were opened last. They are dissolved and their items cut to
fill the gaps of the others, as long as that saves a whole sequence.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hostweave.llm.subwords import PLAIN, Memo, gather, plain_letters, segments, vocabulary, word_tokenizer
from hostweave.llm.tables import stored
from hostweave.llm.tokens import flat, pieces

SEQUENCE = 4096
END = 2
GROUP = 4096
ITEMS = 1 << 62  # sequences of packed items are numbered from here, full ones by their row
PIECE_TYPE = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class OpenPlaces:
    """Tournament tree over the free places of sequences 0, 1, 2, ..."""

    def __init__(self, n: int, size: int):
        self.base = 1 << max(0, (n - 1).bit_length())
        self.tree = [size] * (2 * self.base)

    def first(self, need: int) -> int:
        """The first sequence with ``need`` free places, which are then taken."""
        tree, i = self.tree, 1
        while i < self.base:
            i *= 2
            if tree[i] < need:
                i += 1
        found = i - self.base
        tree[i] -= need
        while i > 1:
            i >>= 1
            left, right = tree[2 * i], tree[2 * i + 1]
            most = left if left > right else right
            if tree[i] == most:
                break
            tree[i] = most
        return found


def first_fit(sizes: np.ndarray, size: int = SEQUENCE) -> np.ndarray:
    """Sequence of each item, items taken from long to short (equal ones in the given order)."""
    out = np.zeros(len(sizes), np.int64)
    places = OpenPlaces(max(1, len(sizes)), size)
    for i in np.argsort(-sizes, kind="stable").tolist():
        out[i] = places.first(int(sizes[i]))
    return out


def packed_items(sizes: np.ndarray, size: int = SEQUENCE) -> list[tuple[int, int, int, int, int]]:
    """(item, first id of the piece within the item, length, sequence, offset) of items of 1 to ``size`` ids. The fewest sequences
    that could hold them are filled; only items of dissolved sequences are cut."""
    if not len(sizes):
        return []
    at = first_fit(sizes, size)
    used = np.bincount(at, weights=sizes).astype(np.int64)
    least = -(-int(sizes.sum()) // size)
    # the fullest ``least`` sequences stay, the others fill their gaps
    order = np.argsort(-used, kind="stable")
    number = np.full(len(used), -1)
    number[np.sort(order[:least])] = np.arange(least)
    fill, out = np.zeros(least, np.int64), []
    for i in np.argsort(at, kind="stable").tolist():
        b = number[at[i]]
        if b >= 0:
            out.append((i, 0, int(sizes[i]), int(b), int(fill[b])))
            fill[b] += sizes[i]
    b = 0
    for i in np.flatnonzero(number[at] < 0).tolist():
        done = 0
        while done < sizes[i]:
            while fill[b] == size:
                b += 1
            n = int(min(size - fill[b], sizes[i] - done))
            out.append((i, done, n, b, int(fill[b])))
            fill[b] += n
            done += n
    return out


def _encoder(path: str):
    tokenizer, letters = word_tokenizer(path), plain_letters()
    word = tokenizer.model.tokenize

    def encode(new: list[bytes]):
        texts = [s.decode() for s in new]
        plain = [PLAIN.fullmatch(t) is not None for t in texts]
        other = iter(tokenizer.encode_batch_fast([t for t, p in zip(texts, plain, strict=True) if not p], add_special_tokens=False))
        ids = [[x.id for x in word(t.translate(letters))] if p else next(other).ids for t, p in zip(texts, plain, strict=True)]
        lengths = np.fromiter(map(len, ids), np.int64, len(ids))
        values = np.fromiter((x for one in ids for x in one), np.int64, int(lengths.sum()))
        return np.zeros((len(new), 0), np.int64), lengths, values, []

    return encode


@cache
def _memo(path: str) -> Memo:
    """Kept as long as the Python worker, over its tasks."""
    return Memo(_encoder(path))


def _pieces(path: str, end: int, size: int):
    """Documents cut at the multiples of ``size``; the ids of a piece are little-endian 32-bit numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = _memo(path)
        for p in pieces(batches, "_text"):
            doc, segment = segments(*flat(p.column("_text")), fold=True)
            entry = memo.look_up(segment)
            n = np.bincount(doc, weights=memo.lengths[entry], minlength=p.num_rows).astype(np.int64)
            ids = memo.values[gather(memo.starts[entry], memo.lengths[entry])]
            # every document's ids, then its end id
            stops = np.cumsum(n + 1)
            out = np.full(int(stops[-1]), end, "<u4")
            out[np.arange(len(ids)) + np.repeat(np.arange(p.num_rows), n)] = ids
            cuts = -(-(n + 1) // size)
            of = np.repeat(np.arange(p.num_rows), cuts)
            start = (np.arange(len(of)) - np.repeat(np.cumsum(cuts) - cuts, cuts)) * size
            length = np.minimum(size, n[of] + 1 - start)
            begin = stops[of] - n[of] - 1 + start
            raw = pa.LargeBinaryArray.from_buffers(
                pa.large_binary(), len(of), [None, pa.py_buffer(np.append(begin, len(out)).astype(np.int64) * 4), pa.py_buffer(out)]
            )
            yield pa.RecordBatch.from_arrays(
                [p.column("_id").take(pa.array(of)), pa.array(start), pa.array(length), pa.array(n[of] + 1), raw.cast(pa.binary())],
                ["_id", "start", "length", "doc_tokens", "ids"],
            )

    return run


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Full pieces: one sequence each."""
    for b in batches:
        yield _placed(b, np.arange(b.num_rows), b.column("start").to_numpy(), b.column("length").to_numpy(), b.column("_row").to_numpy(), np.zeros(b.num_rows, np.int64))


def _placed(b: pa.RecordBatch, row, start, length, sequence, offset) -> pa.RecordBatch:
    """Output rows: row of ``b``, start in the document, length, sequence, offset."""
    ids = b.column("ids").cast(pa.large_binary())
    off = np.frombuffer(ids.buffers()[1], np.int64)[ids.offset : ids.offset + len(ids) + 1] // 4
    data = ids.buffers()[2]
    values = np.frombuffer(data, "<u4", count=len(data) // 4) if data is not None else np.zeros(0, "<u4")
    begin = off[row] + start - b.column("start").to_numpy()[row]
    crc = [zlib.crc32(values[a : a + m]) for a, m in zip(begin.tolist(), length.tolist(), strict=True)]
    own = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(length)), pa.int32()), pa.array(values[gather(begin, length)].astype(np.int32)))
    take = pa.array(row)
    return pa.RecordBatch.from_arrays(
        [b.column("_id").take(take), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), b.column("doc_tokens").take(take), pa.array(sequence), pa.array(offset), own],
        ["_id", *[c.split()[0] for c in PIECE_TYPE.split(", ")], "ids"],
    )


def _packed(size: int):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        b = table.combine_chunks().to_batches()[0]
        # the order of a group's rows must not depend on how the shuffle delivered them
        b = b.take(pa.array(np.argsort(b.column("_row").to_numpy())))
        found = np.array(packed_items(b.column("length").to_numpy(), size), np.int64)
        row, start, length, at, offset = found.T
        first = b.column("start").to_numpy()[row]
        return pa.Table.from_batches([_placed(b, row, first + start, length, ITEMS + (key[0].as_py() << 32) + at, offset)])

    return run


def packed(docs: DataFrame, path: str | None = None, size: int = SEQUENCE, end: int = END, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: (id_col, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids).

    A row's text becomes its token ids (vocabulary file ``path``, no special ids added) and ``end``; a null text is empty
    and so holds ``end`` alone. Every id lies in one piece. ``start`` counts the ids of the document before the piece, ``offset``
    those of the sequence, which are gapless from 0. ids_crc32 is the CRC-32 of the ids as little-endian 32-bit
    numbers. Rows that repeat an id, or have none, are documents of their own. Other columns are ignored.
    """
    base = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    ddl = base.schema["_id"].dataType.simpleString()
    cut = base.mapInArrow(_pieces(path or vocabulary("word_bpe_49k.json"), end, size), f"_id {ddl}, start long, length long, doc_tokens long, ids binary")
    # the number of a row stays the same once it is written, so groups do too
    cut = stored(cut.withColumn("_row", F.monotonically_increasing_id()))
    short = cut.filter(F.col("length") < size)
    groups = max(1, -(-short.count() // GROUP))
    schema = f"_id {ddl}, {PIECE_TYPE}, ids array<int>"
    items = short.groupBy(F.pmod(F.xxhash64("_row"), F.lit(groups)).alias("_group")).applyInArrow(_packed(size), schema)
    whole = cut.filter(F.col("length") == size).mapInArrow(_numbered, schema)
    return whole.unionByName(items).withColumnRenamed("_id", id_col)


def sequences(pieces_: DataFrame, size: int = SEQUENCE, pad: int = 0) -> DataFrame:
    """(sequence_id, ids, lengths): the ids of each sequence of ``packed``, padded to ``size`` unless their number is a power of
    two, and the lengths of its pieces in order. A sequence holds at most ``size`` ids, so a group is small."""
    rows = pieces_.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "length", "ids"))).alias("p"))
    ids = F.flatten(F.col("p.ids"))
    n = F.size(ids)
    padding = F.when(F.bit_count(n) == 1, 0).otherwise(F.lit(size) - n)
    return rows.select("sequence_id", F.concat(ids, F.array_repeat(F.lit(pad), padding)).alias("ids"), F.col("p.length").alias("lengths"))
