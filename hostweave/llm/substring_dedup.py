"""Exact substring deduplication with difference-cover anchors.

A set D of residues modulo a period P is a difference cover when every difference modulo P occurs between
two members. For any two positions i and j there is then a shift d < P with i+d and j+d both in D modulo P.
So if the same W words begin at i and at j, the anchor of A = W-P+1 words that begins at i+d also begins at
j+d and both are hashed, though only |D| of P positions are. Anchors seen once end there. Around the others
each window of W words is compared as a whole (128 bits of hash), which extends the anchor to the long match.

Hot passages: equal keys are first folded inside each task's batch. A key found several times in one batch is
known to repeat at once: only one notice of it is shuffled, and its places travel under a spread key. No key
gets more than one row from a batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hostweave.llm.tables import stored
from hostweave.llm.tokens import flat, keyed, mix, pieces, same_doc, signed, split_words, window_hashes, windows_inside

# Perfect difference sets (fixed values): every non-zero difference modulo the period occurs exactly once.
COVERS = {1: (0,), 7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (0, 1, 4, 14, 16), 31: (0, 1, 3, 8, 12, 18)}
MIN_ANCHOR = 12
SINGLE, NOTICE, KNOWN = 0, 1, 2
FOLD_BYTES = 8 << 20


def cover_for(window: int) -> tuple[int, tuple[int, ...]]:
    """The longest period that leaves anchors of at least MIN_ANCHOR words."""
    period = max(p for p in COVERS if p == 1 or window - p + 1 >= MIN_ANCHOR)
    return period, COVERS[period]


def fold_keys(keys: np.ndarray, *more: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(kind, notices): SINGLE or KNOWN for each key of the batch, and one row number of each KNOWN key."""
    order = np.lexsort((*more, keys)) if more else np.argsort(keys, kind="stable")
    same = np.ones(max(len(keys) - 1, 0), bool)
    for k in (keys, *more):
        k = k[order]
        same &= k[1:] == k[:-1]
    repeats = np.zeros(len(keys), bool)
    repeats[order[1:][same]] = True
    repeats[order[:-1][same]] = True
    begins = np.ones(len(keys), bool)
    begins[1:] = ~same
    heads = order[begins]
    return np.where(repeats, KNOWN, SINGLE).astype(np.int8), heads[repeats[heads]]


def _spread(place: np.ndarray, doc: np.ndarray) -> np.ndarray:
    return signed(mix(place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + doc.astype(np.uint64)))


def _anchors(window: int, types: list[pa.DataType]):
    period, cover = cover_for(window)
    size = window - period + 1
    covered = np.zeros(period, bool)
    covered[list(cover)] = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "_text", FOLD_BYTES):
            parts = []
            for k, p in enumerate(_sub(b)):
                words = split_words(*flat(p[1].column("_text")))
                at = np.flatnonzero(covered[words.place[: len(words.doc) - size + 1] % period] & windows_inside(words, size)) if len(words.doc) >= size else np.zeros(0, np.int64)
                h = window_hashes(words.hash, size)[at] if len(at) else np.zeros(0, np.uint64)
                parts.append((h, words.doc[at] + p[0], words.place[at].astype(np.int32)))
            key, doc, place = (np.concatenate(x) for x in zip(*parts, strict=True))
            kind, notices = fold_keys(key)
            shown = np.where(kind == KNOWN, _spread(place, doc), signed(key))
            rows = pa.array(np.concatenate([doc, doc[notices]]))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([shown, signed(key)[notices]])),
                    b.column("_id").take(rows).cast(types[0]),
                    b.column("_h").take(rows),
                    pa.array(np.concatenate([place, place[notices]])),
                    pa.array(np.concatenate([kind, np.full(len(notices), NOTICE, np.int8)])),
                ],
                ["key", "_id", "_h", "place", "kind"],
            )

    return run


def _sub(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Slices of one batch with the number of their first row."""
    row = 0
    for p in pieces(iter([batch]), "_text"):
        yield row, p
        row += p.num_rows


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values of a list column one after another, and the row of each."""
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values, np.repeat(np.arange(len(column)), column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))


def _windows(window: int, types: list[pa.DataType]):
    period, _ = cover_for(window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "_text", FOLD_BYTES):
            parts = []
            for row, p in _sub(b):
                words = split_words(*flat(p.column("_text")))
                if len(words.doc) < window:
                    continue
                place, doc = _lists(p.column("places"))
                anchor = words.first[doc] + place
                # a window holds the anchor if it begins at most period-1 words before it
                marks = np.zeros(len(words.doc) + 1, np.int32)
                np.add.at(marks, np.maximum(anchor - period + 1, 0), 1)
                np.add.at(marks, anchor + 1, -1)
                near = np.cumsum(marks)[: len(words.doc) - window + 1] > 0
                at = np.flatnonzero(near & windows_inside(words, window))
                parts.append((window_hashes(words.hash, window, 1)[at], window_hashes(words.hash, window, 2)[at], words.doc[at] + row, words.place[at].astype(np.int32)))
            if not parts:
                continue
            k1, k2, doc, place = (np.concatenate(x) for x in zip(*parts, strict=True))
            kind, notices = fold_keys(k1, k2)
            single = np.flatnonzero(kind == SINGLE)
            known = np.flatnonzero(kind == KNOWN)
            # neighbouring windows known to repeat are one range
            starts = np.ones(len(known), bool)
            starts[1:] = (doc[known][1:] != doc[known][:-1]) | (place[known][1:] != place[known][:-1] + 1)
            head = known[starts]
            ends = np.append(np.flatnonzero(starts)[1:], len(known)) - 1 if len(known) else np.zeros(0, np.int64)
            until = place[known[ends]].astype(np.int64) + 1
            rows = np.concatenate([single, notices, head])
            take = pa.array(doc[rows])
            spread = _spread(place[head], doc[head])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([signed(k1)[single], signed(k1)[notices], spread])),
                    pa.array(np.concatenate([signed(k2)[single], signed(k2)[notices], until])),
                    b.column("_id").take(take).cast(types[0]),
                    b.column("_h").take(take),
                    pa.array(place[rows]),
                    pa.array(np.repeat(np.array([SINGLE, NOTICE, KNOWN], np.int8), [len(single), len(notices), len(head)])),
                ],
                ["k1", "k2", "_id", "_h", "begin", "kind"],
            )

    return run


def _clean(window: int, types: list[pa.DataType]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "_text"):
            data, offsets = flat(b.column("_text"))
            words = split_words(data, offsets)
            first, counts = words.first, words.counts
            starts, doc = _lists(b.column("begins"))
            untils, _ = _lists(b.column("untils"))
            marks = np.zeros(len(words.doc) + 1, np.int32)
            np.add.at(marks, first[doc] + starts, 1)
            np.add.at(marks, first[doc] + untils + window - 1, -1)
            gone = np.cumsum(marks)[:-1] > 0
            removed = np.bincount(words.doc[gone], minlength=words.n_texts)
            raw, joined, cleaned = data.tobytes(), [], []
            for i in range(words.n_texts):
                text = raw[offsets[i] : offsets[i + 1]]
                if not removed[i]:
                    joined.append(b" ".join(text.split()))
                    cleaned.append(text)
                    continue
                keep = np.flatnonzero(~gone[first[i] : first[i + 1]]) + first[i]
                ends = words.end[keep]
                before = np.where(keep > first[i], words.end[keep - 1], offsets[i]) if len(keep) else ends
                joined.append(b" ".join(raw[s:e] for s, e in zip(words.start[keep].tolist(), ends.tolist(), strict=True)))
                cleaned.append(b"".join(raw[s:e] for s, e in zip(before.tolist(), ends.tolist(), strict=True)).strip(b" \t\n\r\v\f"))
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("_id").cast(types[0]),
                    b.column("_h"),
                    pa.array(counts, pa.int64()),
                    pa.array(removed, pa.int64()),
                    pa.array(joined, pa.binary()).cast(pa.string()),
                    pa.array(cleaned, pa.binary()).cast(pa.string()),
                ],
                ["_id", "_h", "n_words", "n_removed", "kept_words", "clean_text"],
            )

    return run


def repeated_spans(docs: DataFrame, window: int = 35, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(_id, _h, begin, until): windows of ``window`` words that begin at words begin..until-1 of a document and
    whose words also begin somewhere else, in any document."""
    base = keyed(docs, id_col, text_col)
    kind = base.schema["_id"].dataType
    arrow = [_arrow(kind)]
    ddl = kind.simpleString()
    anchors = base.mapInArrow(_anchors(window, arrow), f"key long, _id {ddl}, _h int, place int, kind tinyint")
    several = F.count("*").over(W.partitionBy("key")) > 1
    found = anchors.withColumn("_n", several).filter(f"kind = {KNOWN} OR (_n AND kind = {SINGLE})")
    per_doc = stored(found.groupBy("_id", "_h").agg(F.collect_set("place").alias("places")))
    near = base.join(per_doc, same_doc(base, per_doc)).select(base["_id"], base["_h"], "_text", "places")
    rows = near.mapInArrow(_windows(window, arrow), f"k1 long, k2 long, _id {ddl}, _h int, begin int, kind tinyint")
    again = F.count("*").over(W.partitionBy("k1", "k2")) > 1
    found = rows.withColumn("_n", again).filter(f"kind = {KNOWN} OR (_n AND kind = {SINGLE})")
    # a range carries its end where a single window has the second half of its key
    until = F.when(F.col("kind") == KNOWN, F.col("k2").cast("int")).otherwise(F.col("begin") + 1)
    return found.select("_id", "_h", "begin", until.alias("until"))


def _arrow(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def remove_repeats(docs: DataFrame, window: int = 35, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: (id_col, n_words, n_removed, kept_words, clean_text).

    Each word that a repeated window covers goes, at every place. ``kept_words`` is the rest joined by one
    space; ``clean_text`` keeps the white space before each kept word and is the text itself where nothing goes.
    A null or empty text has no words and an empty result. Repeated rows are separate documents, so their
    windows repeat; rows that share an id but not the text are told apart; null ids are allowed. Other columns
    are ignored.
    """
    base = keyed(docs, id_col, text_col)
    kind = base.schema["_id"].dataType
    spans = repeated_spans(docs, window, id_col, text_col)
    gone = spans.groupBy("_id", "_h").agg(F.collect_set(F.struct("begin", "until")).alias("s"))
    gone = gone.select("_id", "_h", F.col("s.begin").alias("begins"), F.col("s.until").alias("untils"))
    both = base.join(gone, same_doc(base, gone), "left").select(base["_id"], base["_h"], "_text", "begins", "untils")
    out = both.mapInArrow(
        _clean(window, [_arrow(kind)]),
        f"_id {kind.simpleString()}, _h int, n_words long, n_removed long, kept_words string, clean_text string",
    )
    return out.select(F.col("_id").alias(id_col), "n_words", "n_removed", "kept_words", "clean_text")


def without_repeats(docs: DataFrame, window: int = 35, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with the words of repeated windows cut out of the text. Rows that lose all their words go."""
    base = docs.withColumn("_h", F.hash(F.col(text_col)))
    spans = repeated_spans(docs, window, id_col, text_col)
    gone = spans.groupBy("_id", "_h").agg(F.collect_set(F.struct("begin", "until")).alias("s"))
    gone = gone.select("_id", F.col("_h").alias("_g"), F.col("s.begin").alias("begins"), F.col("s.until").alias("untils"))
    both = base.join(gone, base[id_col].eqNullSafe(gone["_id"]) & (base["_h"] == gone["_g"]), "left").drop("_id", "_g", "_h")
    clean = _clean(window, [pa.int64()])
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p in pieces(batches, text_col):
            no = pa.array(np.arange(p.num_rows))
            short = pa.RecordBatch.from_arrays([no, no.cast(pa.int32()), p.column(text_col), p.column("begins"), p.column("untils")], ["_id", "_h", "_text", "begins", "untils"])
            done = pa.Table.from_batches(clean(iter([short])))
            text = done.column("clean_text").combine_chunks()
            keep = np.array(done.column("n_removed")) < np.maximum(np.array(done.column("n_words")), 1)
            cut = np.array(done.column("n_removed")) > 0
            mixed = pc.if_else(pa.array(cut), text, p.column(text_col).cast(pa.string()))
            yield pa.RecordBatch.from_arrays([mixed if n == text_col else p.column(n) for n in schema.names], schema.names).filter(pa.array(keep))

    return both.mapInArrow(run, schema)
