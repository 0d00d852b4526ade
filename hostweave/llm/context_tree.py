"""Language-model scores by context-tree weighting over bytes.

A byte is eight binary decisions; the tree node of a decision is the context (the last 0 to DEPTH bytes) and the bits decided
so far. Each node estimates its bit by Krichevsky-Trofimov counts. Bottom-up, a node's weighted probability of the
training bits is the mean of its own estimate and the product of its children's; the share of its own estimate in
that is how much the node counts against deeper contexts when a new byte is scored.

* Training: counts of all DEPTH+1 byte runs of all training texts, combined in each task, then by hash.
* Depths of HELD and more are worked out where all runs with the same last HELD bytes meet (at most 256**3 of them, as
  two more context bytes and the next byte are free); lower depths have at most 256**2 contexts, a bounded table.
* Scoring: no task gets the whole model. Documents go to blocks of about BLOCK_BYTES; each block asks for the runs and
  words it holds, the model joins on them, and the answers come back to the block.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hostweave.llm.substring_dedup import _arrow
from hostweave.llm.tables import stored
from hostweave.llm.tokens import LOWER, flat, pieces, signed, split_words
from hostweave.llm.training import held_out

DEPTH, HELD = 5, 3
BLOCK_BYTES = 16 << 20
RUN, WORD = 0, 1
END_WORD = 0x0123456789ABCDEF  # stands for the end of a text among the words' hashes
_MERGE = 1 << 21
_STEP = 1 << 16


def byte_runs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(run of each byte and of the end byte 0 of each text, where each text begins among them).

    A run holds the previous byte first, then the one before it and so on, and last the byte itself; before a text
    there are zero bytes. So runs in numeric order keep every context of every depth together."""
    n = len(offsets) - 1
    size = np.diff(offsets) + 1
    first = np.append(0, np.cumsum(size))
    shift = np.repeat(np.arange(n) * (DEPTH + 1) + DEPTH, np.diff(offsets))
    padded = np.zeros(len(data) + n * (DEPTH + 1), np.uint64)
    padded[np.arange(len(data)) + shift] = LOWER[data]
    at = np.arange(first[-1]) + np.repeat(np.arange(n) * DEPTH + DEPTH, size)
    run = padded.copy()
    for i in range(1, DEPTH + 1):
        run[i:] |= padded[:-i] << np.uint64(8 * (DEPTH + 1 - i))
    return run[at].astype(np.int64), first


def _sum_by(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys in order, and the sums of each value over them."""
    if not len(keys):
        return (keys, *values)
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    at = np.flatnonzero(np.append(True, k[1:] != k[:-1]))
    return (k[at], *[np.add.reduceat(v[order], at) for v in values])


def _unique(keys: np.ndarray) -> np.ndarray:
    """Distinct keys in order."""
    k = np.sort(keys)
    return k[np.append(True, k[1:] != k[:-1])] if len(k) else k


def _run_scores(key: np.ndarray, value: np.ndarray, runs: np.ndarray) -> np.ndarray:
    """The value of each run, all of which are among the sorted keys.

    They are looked up in order, _STEP at a time: a search in a large table that jumps about waits for memory at every step.
    A run has 48 bits, so its place in the step fits below it and plain numbers are sorted."""
    out, place = np.empty(len(runs), value.dtype), np.arange(_STEP)
    for i in range(0, len(runs), _STEP):
        part = runs[i : i + _STEP]
        both = np.sort(part.astype(np.uint64) << np.uint64(16) | place[: len(part)].astype(np.uint64))
        out[i + (both & np.uint64(_STEP - 1)).astype(np.int64)] = value[np.searchsorted(key, (both >> np.uint64(16)).astype(np.int64))]
    return out


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Logarithm of the gamma function for x >= 1/2 (Stirling's series after eight steps of recurrence)."""
    x = np.asarray(x, float)
    low = np.zeros_like(x)
    for i in range(8):
        low += np.log(x + i)
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - low


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    return log_gamma(zeros + 0.5) + log_gamma(ones + 0.5) - log_gamma(zeros + ones + 1.0) - np.log(np.pi)


def _bits(runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the node among the bits decided so far, next bit), both with 8 rows of len(runs)."""
    k = np.arange(8)[:, None]
    byte = runs & 255
    return (1 << k) | (byte >> (8 - k)), (byte >> (7 - k)) & 1


@dataclass
class Level:
    """The nodes of one depth: key (context and bits), counts, weighted log-probability, own share."""

    key: np.ndarray
    zeros: np.ndarray
    ones: np.ndarray
    weighted: np.ndarray
    own: np.ndarray

    @classmethod
    def leaf(cls, key: np.ndarray, zeros: np.ndarray, ones: np.ndarray) -> Level:
        return cls(key, zeros, ones, log_kt(zeros, ones), np.ones(len(key)))

    @classmethod
    def inner(cls, key: np.ndarray, zeros: np.ndarray, ones: np.ndarray, children: np.ndarray) -> Level:
        kt = log_kt(zeros, ones) - np.log(2)
        weighted = np.logaddexp(kt, children - np.log(2))
        return cls(key, zeros, ones, weighted, np.exp(kt - weighted))

    def parent(self) -> Level:
        """The level of contexts one byte shorter (the oldest byte of the key's context goes)."""
        return Level.inner(*_sum_by(self.key >> 16 << 8 | self.key & 255, self.zeros, self.ones, self.weighted))

    def mixed(self, key: np.ndarray, bit: np.ndarray, deeper: np.ndarray | None) -> np.ndarray:
        """Probability of the bits at the nodes ``key``; ``deeper`` is that of one more byte of context."""
        if not len(self.key):
            return np.full(key.shape, 0.5) if deeper is None else deeper
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        known = self.key[at] == key
        z, o = np.where(known, self.zeros[at], 0), np.where(known, self.ones[at], 0)
        p = (np.where(bit == 1, o, z) + 0.5) / (z + o + 1.0)
        return p if deeper is None else np.where(known, self.own[at] * p + (1 - self.own[at]) * deeper, deeper)


def _deep(runs: np.ndarray, n: np.ndarray) -> list[Level]:
    """Levels HELD to DEPTH of complete groups of runs."""
    bits, bit = _bits(runs)
    key, count, one = ((runs >> 8) << 8 | bits).ravel(), np.tile(n, 8), bit.ravel()
    levels = [Level.leaf(*_sum_by(key, count * (1 - one), count * one))]
    for _ in range(DEPTH - HELD):
        levels.insert(0, levels[0].parent())
    return levels


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Sorted (runs, counts) in stretches that end between groups of the same last HELD bytes."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    cut = 8 * (DEPTH + 1 - HELD)
    for b in batches:
        k, n = b.column("key").to_numpy(), b.column("n").to_numpy()
        if not len(k):
            continue
        last = np.searchsorted(k >> cut, k[-1] >> cut)  # the last group may go on
        if last or (held and held[0][0][0] >> cut != k[0] >> cut):
            held.append((k[:last], n[:last]))
            yield tuple(np.concatenate(x) for x in zip(*held, strict=True))
            held = []
        held.append((k[last:], n[last:]))
    if held:
        yield tuple(np.concatenate(x) for x in zip(*held, strict=True))


def _held_nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for runs, n in _groups(batches):
        if len(runs):
            top = _deep(runs, n)[0]
            yield pa.RecordBatch.from_arrays([pa.array(top.key), pa.array(top.zeros), pa.array(top.ones), pa.array(top.weighted)], ["key", "zeros", "ones", "weighted"])


def _run_values(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        upper = shared.value
        for runs, n in _groups(batches):
            if not len(runs):
                continue
            bits, bit = _bits(runs)
            levels = [*upper, *_deep(runs, n)]
            p = None
            for depth in range(DEPTH, -1, -1):
                p = levels[depth].mixed((runs >> 8 * (DEPTH + 1 - depth)) << 8 | bits, bit, p)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(runs), RUN, np.int8)), pa.array(runs), pa.array(np.log10(p).sum(0), pa.float32()), pa.array(np.zeros(len(runs), np.int64))], ["kind", "key", "value", "n"])

    return run


class _Keys:
    """Distinct keys gathered in one task, merged as they grow."""

    def __init__(self):
        self.parts: list[np.ndarray] = []
        self.size = 0

    def add(self, keys: np.ndarray) -> None:
        self.parts.append(_unique(keys))
        self.size += len(self.parts[-1])
        if self.size > _MERGE and len(self.parts) > 1:
            self.parts = [self.total()]
            self.size = len(self.parts[0])

    def total(self) -> np.ndarray:
        return _unique(np.concatenate(self.parts)) if self.parts else np.zeros(0, np.int64)


class _Counter:
    """Keys and counts gathered in one task, merged as they grow."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, keys: np.ndarray, n: np.ndarray) -> None:
        self.parts.append((keys, n))
        self.size += len(keys)
        if self.size > _MERGE and len(self.parts) > 1:
            self.parts = [self.total()]
            self.size = len(self.parts[0][0])

    def total(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.parts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return _sum_by(*(np.concatenate(x) for x in zip(*self.parts, strict=True)))


def _text_keys(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(runs, first run of each text, words and one end for each text, text of each of those)."""
    data, offsets = flat(texts)
    runs, first = byte_runs(data, offsets)
    words = split_words(data, offsets, lower=True)
    n = words.n_texts
    return runs, first, np.append(signed(words.hash), np.full(n, END_WORD, np.int64)), np.append(words.doc, np.arange(n))


def _distinct(keys: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, counted where ``weight`` is true."""
    seen, n = np.unique(keys[weight], return_counts=True)
    rest = _unique(keys[~weight])
    return np.append(seen, rest), np.append(n, np.zeros(len(rest), np.int64))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = {RUN: _Counter(), WORD: _Counter()}
    for p in pieces(batches, "_text"):
        runs, first, words, doc = _text_keys(p.column("_text"))
        train = ~p.column("held_out").to_numpy(zero_copy_only=False)
        total[RUN].add(*_distinct(runs, np.repeat(train, np.diff(first))))
        total[WORD].add(*_distinct(words, train[doc]))
    for kind, c in total.items():
        keys, n = c.total()
        for i in range(0, len(keys), 1 << 18):
            k = keys[i : i + (1 << 18)]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), kind, np.int8)), pa.array(k), pa.array(n[i : i + (1 << 18)])], ["kind", "key", "n"])


def _asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct keys of each block; the rows come block by block."""
    block, total = None, {}

    def told() -> Iterator[pa.RecordBatch]:
        for kind, c in total.items():
            k = c.total()
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), block, np.int32)), pa.array(np.full(len(k), kind, np.int8)), pa.array(k)], ["block", "kind", "key"])

    for b in batches:
        of = b.column("block").to_numpy()
        for x in np.unique(of):
            if x != block:
                yield from told()
                block, total = x, {RUN: _Keys(), WORD: _Keys()}
            part = b.filter(pa.array(of == x))
            for p in pieces(iter([part]), "_text"):
                runs, _, words, _ = _text_keys(p.column("_text"))
                total[RUN].add(runs)
                total[WORD].add(words)
    yield from told()


def _scored(tokens: int, distinct: int, kind: pa.DataType):
    def run(docs: pa.Table, model: pa.Table) -> pa.Table:
        what = model.column("kind").to_numpy()
        known = {}
        for k, c in ((RUN, "value"), (WORD, "n")):
            key, value = model.column("key").to_numpy()[what == k], model.column(c).to_numpy()[what == k]
            order = np.argsort(key)
            known[k] = key[order], value[order]
        out = []
        for p in pieces(iter(docs.combine_chunks().to_batches()), "_text"):
            runs, first, words, doc = _text_keys(p.column("_text"))
            key, value = known[RUN]
            score = np.add.reduceat(_run_scores(key, value, runs), first[:-1], dtype=float)
            key, value = known[WORD]
            ordered, c = np.argsort(words), np.empty(len(words), value.dtype)
            c[ordered] = value[np.searchsorted(key, words[ordered])]
            n = p.num_rows
            out.append(
                pa.table(
                    [
                        p.column("_id").cast(kind),
                        p.column("held_out"),
                        pa.array(np.bincount(doc, minlength=n)),
                        pa.array(np.bincount(doc, c > 0, n).astype(np.int64)),
                        pa.array(np.bincount(doc, np.log10((c + 1) / (tokens + distinct + 1)), n)),
                        pa.array(score),
                        pa.array(np.diff(first)),
                    ],
                    ["_id", "held_out", "n_tokens", "n_known", "base_score", "score", "n_bytes"],
                )
            )
        return pa.concat_tables(out)

    return run


def scored(docs: DataFrame, modulus: int = 7, remainder: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: (id_col, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte).

    ``score`` is the log10 probability of the text's bytes (A-Z lower-cased) and its end under the tree, ``bits_per_byte``
    its code length; ``base_score`` the add-one unigram score of its words and its end. Null is empty: one token, the
    end. Rows with a null id are training rows; repeated rows count and are scored one by one. Without any training
    row every bit has probability 1/2. Other columns are ignored.
    """
    base = docs.select(F.col(id_col).alias("_id"), held_out(id_col, modulus, remainder).alias("held_out"), F.col(text_col).alias("_text"))
    spark, kind = docs.sparkSession, base.schema["_id"].dataType
    counts = base.select("held_out", "_text").mapInArrow(_counted, "kind tinyint, key long, n long")
    counts = stored(counts.groupBy("kind", "key").agg(F.sum("n").alias("n")))
    facts = {r["kind"]: r for r in counts.groupBy("kind").agg(F.sum("n").alias("n"), F.count(F.when(F.col("n") > 0, 1)).alias("distinct")).collect()}
    tokens, distinct = (facts[WORD]["n"], facts[WORD]["distinct"]) if WORD in facts else (0, 0)

    runs = counts.filter(f"kind = {RUN}").select("key", "n", F.shiftright("key", 8 * (DEPTH + 1 - HELD)).alias("group"))
    runs = runs.repartition("group").sortWithinPartitions("key").select("key", "n")
    nodes = runs.mapInArrow(_held_nodes, "key long, zeros long, ones long, weighted double")
    above = (F.shiftleft(F.shiftright("key", 16), 8).bitwiseOR(F.col("key").bitwiseAND(F.lit(255)))).alias("key")
    # contexts of HELD-1 = 2 bytes: at most 256**2 * 255 rows
    table = nodes.groupBy(above).agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"), F.sum("weighted").alias("weighted")).orderBy("key").toArrow()
    level = Level.inner(*(table.column(c).to_numpy() for c in ("key", "zeros", "ones", "weighted")))
    upper = [level]
    while len(upper) < HELD:
        upper.insert(0, upper[0].parent())
    values = runs.mapInArrow(_run_values(spark.sparkContext.broadcast(upper)), "kind tinyint, key long, value float, n long")
    words = counts.filter(f"kind = {WORD}").select("kind", "key", F.lit(0.0).cast("float").alias("value"), "n")
    model = stored(values.unionByName(words))

    size = (facts[RUN]["n"] if RUN in facts else 0) * modulus // max(modulus - 1, 1)
    blocks = int(size // BLOCK_BYTES) + 1
    placed = base.withColumn("block", F.pmod(F.xxhash64("_id", "_text"), F.lit(blocks)).cast("int"))
    placed = placed.repartition(blocks, "block").sortWithinPartitions("block")
    asked = placed.mapInArrow(_asked, "block int, kind tinyint, key long")
    answers = asked.join(model, ["kind", "key"])
    out = placed.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(
        _scored(tokens, distinct, _arrow(kind)),
        f"_id {kind.simpleString()}, held_out boolean, n_tokens long, n_known long, base_score double, score double, n_bytes long",
    )
    bits = -F.col("score") * float(np.log2(10)) / F.col("n_bytes")
    return out.select(F.col("_id").alias(id_col), "held_out", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score", bits.alias("bits_per_byte"))
