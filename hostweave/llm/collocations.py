"""Collocations: frequent phrases of two to four words, counted in HAT-tries.

Texts become units: about ``Sizes.unit_bytes`` of one language's words as numbers of the unit's own words, the most frequent word first. The larger
units are, the fewer rows leave them: a task fills one for each language side by side. A unit's phrases are counted in a
HAT-trie: the root leads by first word to hash containers of the remaining words; a container that grows beyond ``burst``
entries bursts into a node of containers by the next word. When the trie holds ``held`` entries its largest subtrees are
spilled as sorted runs. Runs meet in partitions by prefix (two words, a prefix's children dealt into ``CHILDREN`` parts, so
that no hot prefix is one task's) and are merged there.

A phrase that occurs ``least`` times has only parts that do. So words come first, then pairs of frequent words, then phrases of three
and more words all of whose pairs are frequent; before each step a unit fetches what it holds of the frequent ones. From
words on, phrases travel as numbers: a word's is the place of its first occurrence among the units' words.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hostweave.llm.tables import stored
from hostweave.llm.tokens import LOWER, flat, pieces

BITS = 21  # of a word's number in its unit; three of them make one key
PLANES = 3  # bytes of a packed one
LONGEST = 4
CHILDREN = 16
UNIT_BITS = 20  # of a unit's number in its task
WORD, PAIR = 0, 1


@dataclass(frozen=True)
class Sizes:
    """Bounds of memory; the result is the same for any. ``unit_words`` must fit ``BITS``."""

    unit_bytes: int = 16 << 20  # of a language's words with their offsets
    unit_words: int = (1 << BITS) - 8
    burst: int = 4096
    held: int = 1_500_000
    chunk: int = 1 << 18
    all_bytes: int = 64 << 20  # as ``unit_bytes``, of all languages of a task


SIZES = Sizes()

_BREAK = np.zeros(256, bool)
_BREAK[[ord(c) for c in ".,;:!?"] + [10, 11, 12, 13]] = True
_GAP = _BREAK.copy()
_GAP[[9, 32]] = True


def phrase_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, pa.LargeBinaryArray, np.ndarray]:
    """(text number, word in lower case, whether a new piece begins there) of the words of texts that lie one after another."""
    data = LOWER[data]
    word = ~_GAP[data]
    begin, stop = word.copy(), word.copy()
    begin[1:] &= ~word[:-1]
    stop[:-1] &= ~word[1:]
    cut = offsets[1:-1]
    a, z = cut[cut < len(data)], cut[cut > 0]
    begin[a] = word[a]
    stop[z - 1] = word[z - 1]
    start, end = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    doc = np.searchsorted(offsets, start, "right") - 1
    pieces_before = np.append(0, np.cumsum(_BREAK[data]))[start]
    new = np.ones(len(start), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (pieces_before[1:] != pieces_before[:-1])
    ends = np.append(0, np.cumsum(end - start)).astype(np.int64)
    raw = np.ascontiguousarray(data[word])
    return doc, pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(ends), pa.py_buffer(raw)]), new


class HatTrie:
    """Counts of paths of word numbers: hash containers under a trie of the first words that bursts where it is full."""

    def __init__(self, depth: int, sizes: Sizes = SIZES):
        self.depth = depth  # words of a path
        self.burst, self.chunk = sizes.burst, sizes.chunk
        self.root: dict[int, Counter | dict] = {}
        self.sizes: dict[int, int] = {}
        self.held = 0

    def add(self, paths: np.ndarray) -> None:
        """Count paths given as rows of word numbers."""
        if not len(paths):
            return
        rest = np.zeros(len(paths), np.int64)
        for c in range(1, self.depth):
            rest = rest << BITS | paths[:, c]
        order = np.argsort(paths[:, 0], kind="stable")
        first, rest = paths[order, 0], rest[order].tolist()
        at = np.append(0, np.append(np.flatnonzero(np.diff(first)) + 1, len(first))).tolist()
        for word, a, z in zip(first[at[:-1]].tolist(), at[:-1], at[1:], strict=True):
            node = self.root.get(word)
            if node is None:
                node = self.root[word] = Counter()
            self.root[word], more = self._count(node, rest[a:z], self.depth - 1)
            self.sizes[word] = self.sizes.get(word, 0) + more
            self.held += more

    def _count(self, node: Counter | dict, rest: list[int], words: int) -> tuple[Counter | dict, int]:
        """The node with the paths counted (a full container bursts), and how many entries that added."""
        if isinstance(node, Counter):
            before = len(node)
            node.update(rest)
            return (self._burst(node, words) if words > 1 and len(node) > self.burst else node), len(node) - before
        shift, groups, more = BITS * (words - 1), {}, 0
        for r in rest:
            groups.setdefault(r >> shift, []).append(r & (1 << shift) - 1)
        for word, below in groups.items():
            node[word], added = self._count(node.get(word, Counter()), below, words - 1)
            more += added
        return node, more

    def _burst(self, full: Counter, words: int) -> dict:
        shift, node = BITS * (words - 1), {}
        for r, n in full.items():
            node.setdefault(r >> shift, Counter())[r & (1 << shift) - 1] = n
        return node

    def _run(self, node: Counter | dict, words: int, above: int, keys: list[int], counts: list[int]) -> None:
        if isinstance(node, Counter):
            found = sorted(node)
            keys.extend([above | k for k in found] if above else found)
            counts.extend(map(node.__getitem__, found))
            return
        shift = BITS * (words - 1)
        for word in sorted(node):
            self._run(node[word], words - 1, above | word << shift, keys, counts)

    def spill(self, keep: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Sorted runs (paths, counts) of the largest subtrees, until at most ``keep`` entries are left."""
        words, keys, counts, lengths = [], [], [], []
        for word in sorted(self.root, key=self.sizes.__getitem__, reverse=True) if keep else sorted(self.root):
            if self.held <= keep:
                break
            before = len(keys)
            self._run(self.root.pop(word), self.depth - 1, 0, keys, counts)
            self.held -= self.sizes.pop(word)
            words.append(word)
            lengths.append(len(keys) - before)
            if len(keys) > self.chunk:
                yield self._paths(words, lengths, keys), np.array(counts, np.int64)
                words, keys, counts, lengths = [], [], [], []
        if keys:
            yield self._paths(words, lengths, keys), np.array(counts, np.int64)

    def _paths(self, words: list[int], lengths: list[int], keys: list[int]) -> np.ndarray:
        rest, out = np.array(keys, np.int64), np.empty((len(keys), self.depth), np.int64)
        out[:, 0] = np.repeat(words, lengths)
        for c in range(self.depth - 1, 0, -1):
            out[:, c] = rest & (1 << BITS) - 1
            rest = rest >> BITS
        return out


def _packed(codes: np.ndarray) -> bytes:
    """Codes from -1 in three byte planes: most of the two upper ones is zero, so that they compress well."""
    low = (codes + 1).astype("<u4").view(np.uint8).reshape(-1, 4)
    return np.ascontiguousarray(low[:, :PLANES].T).tobytes()


def _unpacked(data: pa.Buffer) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(PLANES, -1)
    out = np.full(planes.shape[1], -1, np.int32)
    for i, plane in enumerate(planes):
        out += plane.astype(np.int32) << 8 * i
    return out


def _units(sizes: Sizes):
    """(unit, lang, own, codes, words, counts): word numbers of a unit's texts, -1 before each piece. Words are counted, and phrases
    begin, at the first ``own`` places; what follows are words that such a phrase may need."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, size = TaskContext.get().partitionId() << UNIT_BITS, {}, {}

        def rows(lang: str) -> Iterator[pa.RecordBatch]:
            nonlocal number
            text, new = (pa.concat_arrays([x[i] for x in held[lang]]) for i in (0, 1))
            del held[lang], size[lang]
            new = np.flatnonzero(new.to_numpy(zero_copy_only=False))
            place = np.arange(len(text)) + np.searchsorted(new, np.arange(len(text)), "right")
            for a in range(0, len(text) + len(new), sizes.unit_words):
                z = a + sizes.unit_words + LONGEST - 1
                x, y = np.searchsorted(place, (a, z))
                coded = text[int(x) : int(y)].dictionary_encode()
                codes = np.full(min(z, len(text) + len(new)) - a, -1, np.int32)
                codes[place[x:y] - a] = coded.indices.to_numpy()
                mine = codes[: sizes.unit_words]
                counts = np.bincount(mine[mine >= 0], minlength=len(coded.dictionary))
                order = np.argsort(-counts, kind="stable")
                ranks = np.full(len(order) + 1, -1, np.int32)  # the last one is that of -1
                ranks[order] = np.arange(len(order))
                words = coded.dictionary.take(pa.array(order)).cast(pa.large_string()).cast(pa.string())
                ends = pa.array([0, len(words)], pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([number]), pa.array([lang]), pa.array([len(mine)], pa.int64()), pa.array([_packed(ranks[codes])], pa.binary()),
                        pa.ListArray.from_arrays(ends, words), pa.ListArray.from_arrays(ends, pa.array(counts[order], pa.int64())),
                    ],
                    ["unit", "lang", "own", "codes", "words", "counts"],
                )
                number += 1

        for p in pieces(batches, "_text"):
            data, offsets = flat(p.column("_text"))
            doc, words, new = phrase_words(data, offsets)
            langs = p.column("lang").to_pylist()
            kinds = {x: i for i, x in enumerate(dict.fromkeys(langs))}
            of = np.array([kinds[x] for x in langs])[doc] if len(doc) else np.zeros(0, np.int64)
            for lang, i in kinds.items():
                mine = np.flatnonzero(of == i)
                if len(mine):
                    part = words.take(pa.array(mine))
                    held.setdefault(lang, []).append((part, pa.array(new[mine])))
                    size[lang] = size.get(lang, 0) + part.nbytes
            while size and (max(size.values()) > sizes.unit_bytes or sum(size.values()) > sizes.all_bytes):
                yield from rows(max(size, key=size.__getitem__))
        for lang in sorted(held):
            yield from rows(lang)

    return run


def _counted(codes: np.ndarray, depth: int, at: np.ndarray, sizes: Sizes) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Runs (paths, counts) of the phrases of ``depth`` words that begin at the places ``at``."""
    trie = HatTrie(depth, sizes)
    for i in range(0, len(at), sizes.chunk):
        trie.add(np.stack([codes[at[i : i + sizes.chunk] + c] for c in range(depth)], axis=1).astype(np.int64))
        if trie.held > sizes.held:
            yield from trie.spill(sizes.held // 2)
    yield from trie.spill(0)


def _unit_codes(unit: pa.Table, facts: pa.Table) -> tuple[np.ndarray, int, np.ndarray, np.ndarray]:
    """(codes with -1 for words that are not frequent, own, number of each code's word, frequent pairs as codes) of one unit."""
    codes = _unpacked(unit.column("codes")[0].as_buffer())
    kind, x, y = (facts.column(c).to_numpy() for c in ("kind", "x", "y"))
    words, pairs = kind == WORD, kind == PAIR
    number = np.full(int(codes.max(initial=-1)) + 2, -1, np.int64)  # the last one is that of -1
    number[x[words]] = y[words]
    order = np.argsort(y[words])
    known = y[words][order]
    both = [x[words][order][np.searchsorted(known, v[pairs])] for v in (x, y)] if pairs.any() else [np.zeros(0, np.int64)] * 2
    return np.where(number[codes] >= 0, codes, -1), unit.column("own")[0].as_py(), number, np.stack(both, axis=1)


def _pair_runs(sizes: Sizes):
    """Counts of the pairs of frequent words of a unit."""

    def run(key: tuple[pa.Scalar, ...], unit: pa.Table, facts: pa.Table) -> pa.Table:
        found = []
        if unit.num_rows and facts.num_rows:
            codes, own, number, _ = _unit_codes(unit, facts)
            n = max(0, min(own, len(codes) - 1))
            at = np.flatnonzero((codes[:n] >= 0) & (codes[1 : n + 1] >= 0))
            found = [(number[paths], counts) for paths, counts in _counted(codes, 2, at, sizes)]
        paths = np.concatenate([p for p, _ in found]) if found else np.zeros((0, 2), np.int64)
        counts = np.concatenate([c for _, c in found]) if found else np.zeros(0, np.int64)
        return pa.table({"unit": np.full(len(counts), key[0].as_py()), "w1": paths[:, 0], "w2": paths[:, 1], "n": counts})

    return run


def _longer_runs(sizes: Sizes):
    """Counts of a unit's phrases of three and more words whose pairs are all frequent; words that a phrase does not have are -1."""

    def run(key: tuple[pa.Scalar, ...], unit: pa.Table, facts: pa.Table) -> pa.Table:
        found = []
        if unit.num_rows and facts.num_rows:
            codes, own, number, pairs = _unit_codes(unit, facts)
            known = np.sort(pairs[:, 0] << BITS | pairs[:, 1])
            both = np.where((codes[:-1] >= 0) & (codes[1:] >= 0), codes[:-1].astype(np.int64) << BITS | codes[1:], -1)
            good = known[np.minimum(np.searchsorted(known, both), len(known) - 1)] == both if len(known) else np.zeros(len(both), bool)
            for depth in range(3, LONGEST + 1):
                n = max(0, min(own, len(codes) - depth + 1))
                at = np.flatnonzero(np.logical_and.reduce([good[c : c + n] for c in range(depth - 1)]))
                for paths, counts in _counted(codes, depth, at, sizes):
                    wide = np.full((len(counts), LONGEST), -1, np.int64)
                    wide[:, :depth] = number[paths]
                    found.append((wide, counts))
        paths = np.concatenate([p for p, _ in found]) if found else np.zeros((0, LONGEST), np.int64)
        counts = np.concatenate([c for _, c in found]) if found else np.zeros(0, np.int64)
        return pa.table({**{f"w{c + 1}": paths[:, c] for c in range(LONGEST)}, "n": counts})

    return run


def phrase_counts(docs: DataFrame, least: int = 30, lang_col: str = "lang", text_col: str = "text", sizes: Sizes = SIZES) -> tuple[DataFrame, DataFrame]:
    """((lang, phrase, words, f), (lang, n)): phrases of one to four words that occur ``least`` times or more in a language, and the
    words of each language. Overlapping occurrences count; null languages are ``und``, null texts empty."""
    base = docs.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), F.col(text_col).alias("_text"))
    units = stored(base.mapInArrow(_units(sizes), "unit long, lang string, own long, codes binary, words array<string>, counts array<long>"))
    totals = units.groupBy("lang").agg(F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda x, y: x + y)).alias("n"))

    words = units.select("unit", "lang", F.posexplode(F.arrays_zip("words", "counts")).alias("code", "w"))
    words = words.select("unit", "lang", "code", F.col("w.words").alias("word"), F.col("w.counts").alias("n"))
    w = W.partitionBy("word", "lang")
    place = F.shiftleft("unit", BITS).bitwiseOR(F.col("code").cast("long"))
    words = words.withColumn("f", F.sum("n").over(w)).withColumn("place", place).withColumn("number", F.min("place").over(w))
    # a word's number is the place of one of its rows, which alone tells what the word is
    spelling = [F.when(F.col("place") == F.col("number"), F.col(c)).alias(c) for c in ("lang", "word", "f")]
    words = stored(words.filter(F.col("f") >= least).select("unit", "code", "number", *spelling))
    known = words.select("unit", F.lit(WORD).alias("kind"), F.col("code").cast("long").alias("x"), F.col("number").alias("y"))

    held = units.select("unit", "own", "codes").groupBy("unit")
    pairs = held.cogroup(known.groupBy("unit")).applyInArrow(_pair_runs(sizes), "unit long, w1 long, w2 long, n long")
    w = W.partitionBy("w1", "w2")
    pairs = pairs.repartition("w1", "w2").withColumn("f", F.sum("n").over(w)).withColumn("first", F.min("unit").over(w))
    pairs = stored(pairs.filter(F.col("f") >= least).select("unit", "w1", "w2", F.when(F.col("unit") == F.col("first"), F.col("f")).alias("f")))
    facts = known.unionByName(pairs.select("unit", F.lit(PAIR).alias("kind"), F.col("w1").alias("x"), F.col("w2").alias("y")))

    columns = [f"w{c + 1}" for c in range(LONGEST)]
    long = held.cogroup(facts.groupBy("unit")).applyInArrow(_longer_runs(sizes), ", ".join(f"{c} long" for c in columns) + ", n long")
    long = long.withColumn("child", F.pmod("w3", F.lit(CHILDREN))).repartition("w1", "w2", "child")
    long = long.groupBy("w1", "w2", "child", *columns[2:]).agg(F.sum("n").alias("f")).filter(F.col("f") >= least)
    none = F.lit(-1).cast("long")
    # a unit that spilled a pair early has it in several rows
    two = pairs.filter("f is not null").select("w1", "w2", "f").distinct().select("w1", "w2", none.alias("w3"), none.alias("w4"), "f")
    every = two.unionByName(long.select(*columns, "f"))
    spelled = words.filter("word is not null").select("number", "lang", "word", "f")
    for c in columns:
        one = spelled.select(F.col("number").alias(c), F.col("word").alias(f"{c}_word"), *([F.col("lang")] if c == "w1" else []))
        every = every.join(one, c, "inner" if c in columns[:2] else "left")
    phrase = F.concat_ws(" ", *[f"{c}_word" for c in columns])
    size = sum((F.when(F.col(c) >= 0, 1).otherwise(0) for c in columns), F.lit(0))
    every = every.select("lang", phrase.alias("phrase"), size.alias("words"), "f")
    return stored(every.unionByName(spelled.select("lang", F.col("word").alias("phrase"), F.lit(1).alias("words"), "f"))), totals


def collocations(
    docs: DataFrame, least: int = 30, inside: int = 80, top: int = 2000, lang_col: str = "lang", text_col: str = "text", sizes: Sizes = SIZES
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's best phrases of two to four words.

    Texts are lower-cased (A-Z), split into pieces at ``.,;:!?`` and line ends, and these into words at spaces and tabs. A phrase
    that occurs a >= ``least`` times is cut into a first part (l occurrences) and the rest (r); its score is
    floor(2000000 a / (l + r)) of its lowest-scoring cut, the one with the shortest first part among equals. Phrases whose words
    lie inside a longer one that occurs ``inside`` per cent as often or more are left out. Ties in score go by a, then by the phrase's bytes.
    Null languages are ``und``; null and empty texts hold nothing; repeated rows count again; a table without frequent phrases
    gives no rows. Other columns are ignored.
    """
    counts, totals = phrase_counts(docs, least, lang_col, text_col, sizes)
    found = counts.filter("words > 1").withColumnRenamed("f", "a").withColumn("w", F.split("phrase", " "))

    def run(first, length):
        return F.array_join(F.slice("w", first, length), " ")

    cuts = found.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    cuts = cuts.select("lang", "phrase", "a", "k", run(F.lit(1), F.col("k")).alias("left"), run(F.col("k") + 1, F.col("words") - F.col("k")).alias("right"))
    part = counts.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l"))
    rest = counts.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r"))
    cuts = cuts.join(part, ["lang", "left"]).join(rest, ["lang", "right"])
    score = F.expr("(cast(a AS decimal(20, 0)) * 2000000) div (cast(l AS decimal(20, 0)) + r)")
    scored = cuts.withColumn("score", score.cast("long")).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("c"))

    # contiguous runs of two and more words inside each longer phrase
    inner = found.filter("words > 2").withColumn("m", F.explode(F.sequence(F.lit(2), F.col("words") - 1)))
    inner = inner.withColumn("s", F.explode(F.sequence(F.lit(1), F.col("words") - F.col("m") + 1)))
    inner = inner.select("lang", run(F.col("s"), F.col("m")).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("f"))
    scored = scored.join(inner, ["lang", "phrase"], "left")
    scored = scored.filter(F.col("f").isNull() | F.expr(f"cast(f AS decimal(20, 0)) * 100 < cast(a AS decimal(20, 0)) * {inside}"))
    scored = scored.select("lang", "phrase", "a", "c.l", "c.r", "c.score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # the first of each part, then the first of those: no language is one task's before it is cut to ``top`` rows a part
    salted = scored.withColumn("_part", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    salted = salted.withColumn("rank", F.row_number().over(W.partitionBy("lang", "_part").orderBy(*order))).filter(F.col("rank") <= top)
    ranked = salted.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
