"""Near-duplicate texts by n-gram Jaccard similarity, joined on parity sketches.

A document is its set of distinct word 5-shingles (64-bit hashes). XOR-hashing a set into bits, each shingle
flipping one bit, gives a sketch whose Hamming distance to another sketch never exceeds the size of the
symmetric difference of the two sets. With J = 0.8, two sets of sizes a and b may differ in at most
D = (a+b)/9 shingles. If the sketch is cut into n > D blocks by shingle, at least n-D blocks agree
(pigeonhole). Blocks are widened to 64 bits, so that blocks of different shingles do not agree by chance.

* Size bands: a+b gives D and so n, a power of two; a document uses the one or two bands its partners can be in.
* An empty block says nothing. A document with as many empty blocks as might have to agree takes further
  seeds until one has fewer; a pair needs that of one side only, and both sides go through the same seeds.
* Sets that are equal are one node from the start.
* Keys that several documents of a batch share are folded there (see substring_dedup.fold_keys), so no key
  brings more than one row from a batch together.
* A block held by more than HOT nodes (a line that many texts share) says little. Since n-D blocks must agree, a
  document may leave out its hot blocks as long as fewer than that are empty or hot; hot keys then hold only documents
  that are mostly made of them, such as large groups of near copies. As above, one side suffices.
* Each node is first compared with one representative it shares most blocks with, then STARS times with one of the
  largest component it shares a key with. Then the nodes of each key that still holds different components are dealt, anew in
  each of DEALS rounds, into hands of about HAND, and compared in those: linear work, in which a node of a large group of near
  copies meets as many of its partners as one of a small group.
* Only keys that still hold nodes of different components are spelled out, their minority against the rest, and of a node's
  only the rarest: as above, it may leave out fewer than n-D of its blocks. All nodes leave out from the same end of one order of
  the keys (by nodes), so the first key that two linked ones share stays with both.

Every pair is verified on the whole sets. Nothing is capped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hostweave.llm.substring_dedup import KNOWN, NOTICE, SINGLE, FOLD_BYTES, _arrow, _spread, _sub, fold_keys
from hostweave.llm.tables import stored
from hostweave.llm.tokens import Words, flat, keyed, mix, pieces, same_doc, signed, split_words, window_hashes, windows_inside
from hostweave.operators.components import component_labels

SEEDS = 8
HOT = 8
STARS = 1
DEALS = 2
HAND = 16
SHORT = tuple(f"s{i}" for i in range(8))
_EMPTY_SET = np.uint64(0x5851F42D4C957F2D)


def shingles(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles: (text number, hash), ordered by both. A text of fewer words is one shingle."""
    inside = np.flatnonzero(windows_inside(words, size))
    docs, hashes = [words.doc[inside]], [window_hashes(words.hash, size, 3)[inside]]
    counts, first = words.counts, words.first
    for few in range(1, size):
        d = np.flatnonzero(counts == few)
        if len(d):
            docs.append(d)
            hashes.append(mix(window_hashes(words.hash, few, 3 + few)[first[d]]))
    doc, h = np.concatenate(docs), np.concatenate(hashes)
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return doc[new], h[new]


def set_nodes(doc: np.ndarray, h: np.ndarray, n_texts: int) -> tuple[np.ndarray, np.ndarray]:
    """(size, fingerprint) of each text's set; equal sets have equal fingerprints."""
    size = np.bincount(doc, minlength=n_texts)
    total = np.zeros(n_texts, np.uint64)
    np.add.at(total, doc, mix(h ^ _EMPTY_SET))
    return size, mix(total + size.astype(np.uint64))


def band(limit: np.ndarray) -> np.ndarray:
    """Smallest level whose 2**level blocks exceed ``limit`` differences with a margin for empty blocks."""
    levels = np.arange(2, 40)
    return levels[np.searchsorted(np.floor(0.85 * 2.0**levels) - 1, limit)]


def _limit(size: np.ndarray, other: np.ndarray, num: int, den: int) -> np.ndarray:
    """Most shingles in which sets of these sizes may differ at similarity num/den."""
    return (size + other) * (den - num) // (den + num)


def block_keys(doc: np.ndarray, h: np.ndarray, size: np.ndarray, num: int, den: int) -> tuple[np.ndarray, ...]:
    """(text number, key, scheme, room): the sketch blocks of each text in the bands of its possible partners. A scheme is a
    level and a seed; of a text's blocks in a scheme, fewer than ``room`` may be left out."""
    low, high = _limit(size, -(-size * num // den), num, den), _limit(size, size * den // num, num, den)
    out_doc, out_key, out_scheme, out_room = [], [], [], []
    first, last = band(low), band(high)
    for level in (first, last):
        active = (high > 0) & (size > 0)
        if level is last:
            active &= last != first
        most = np.minimum(high, (np.floor(0.85 * 2.0**level) - 1).astype(np.int64))
        for seed in range(SEEDS):
            mine = active[doc]
            d, t = doc[mine], h[mine]
            if not len(d):
                break
            value = mix(t ^ np.uint64(seed * 0x9E3779B97F4A7C15 % (1 << 64)))
            part = (value >> np.uint64(20)).astype(np.int64) & ((1 << level[d]) - 1)
            order = np.argsort(d << 32 | part, kind="stable")
            d, part, value = d[order], part[order], mix(value[order])
            begin = np.ones(len(d), bool)
            begin[1:] = (d[1:] != d[:-1]) | (part[1:] != part[:-1])
            at = np.flatnonzero(begin)
            content = np.bitwise_xor.reduceat(value, at)
            d, part = d[at], part[at]
            tag = (level[d].astype(np.uint64) << np.uint64(56)) | np.uint64(seed << 48) | part.astype(np.uint64)
            out_doc.append(d)
            out_key.append(mix(content ^ mix(tag)))
            filled = np.bincount(d, minlength=len(size))
            out_scheme.append(level[d] * 16 + seed)
            out_room.append((filled - most)[d])
            active = active & ((1 << level) - filled >= (1 << level) - most)
        if active.any():  # never filled enough: the empty blocks count as keys too
            for x in np.flatnonzero(active):
                empty = np.setdiff1d(np.arange(1 << level[x]), part[d == x])
                out_doc.append(np.full(len(empty), x))
                out_key.append(mix(mix((np.uint64(int(level[x]) << 56 | (SEEDS - 1) << 48)) | empty.astype(np.uint64))))
                out_scheme.append(np.full(len(empty), level[x] * 16 + SEEDS - 1))
                out_room.append(np.zeros(len(empty), np.int64))
    if not out_doc:
        z = np.zeros(0, np.int64)
        return z, z.astype(np.uint64), z, z
    return tuple(np.concatenate(x) for x in (out_doc, out_key, out_scheme, out_room))


def parity_bits(doc: np.ndarray, h: np.ndarray, size: np.ndarray) -> list[bytes]:
    """Bit sketch of each text: 4 bits for each shingle, rounded up to a power of two, at least 64."""
    bits = 1 << np.ceil(np.log2(np.maximum(4 * size, 64))).astype(np.int64)
    base = np.append(0, np.cumsum(bits))
    where = base[doc] + ((h >> np.uint64(8)).astype(np.int64) & (bits[doc] - 1))
    flat_bits = np.bincount(where, minlength=base[-1]).astype(np.uint8) & 1
    packed = np.packbits(flat_bits, bitorder="little").tobytes()
    return [packed[a // 8 : z // 8] for a, z in zip(base[:-1], base[1:], strict=True)]


def short_sketches(doc: np.ndarray, h: np.ndarray, n_texts: int) -> np.ndarray:
    """Sketches of 512 bits as eight 64-bit columns, for comparisons inside joins."""
    where = doc * 512 + (h >> np.uint64(40)).astype(np.int64) % 512
    bits = np.bincount(where, minlength=n_texts * 512).astype(np.uint8) & 1
    return np.packbits(bits.reshape(n_texts, 512), axis=1, bitorder="little").view(np.int64)


def hamming(a: bytes, b: bytes) -> int:
    """Distance of two parity sketches; the longer one is folded first (XOR of its halves)."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def _sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p in pieces(batches, "_text"):
            words = split_words(*flat(p.column("_text")), lower=True)
            n, node = set_nodes(*shingles(words, size), words.n_texts)
            yield pa.RecordBatch.from_arrays(
                [p.column("_id"), p.column("_h"), pa.array(n, pa.int64()), pa.array(signed(node))], ["_id", "_h", "n", "node"]
            )

    return run


def _keys(size: int, num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "_text", FOLD_BYTES):
            nodes, keys, more, seen = [], [], [], np.zeros(0, np.uint64)
            for _, p in _sub(b):
                words = split_words(*flat(p.column("_text")), lower=True)
                doc, h = shingles(words, size)
                n, node = set_nodes(doc, h, words.n_texts)
                new = np.zeros(words.n_texts, bool)
                new[np.unique(node, return_index=True)[1]] = True
                new &= ~np.isin(node, seen)
                seen = np.concatenate([seen, node[new]])
                d, k, *schemes = block_keys(doc[new[doc]], h[new[doc]], np.where(new, n, 0), num, den)
                nodes.append(node[d])
                keys.append(k)
                more.append(np.array(schemes, np.int32))
            node, key, (scheme, room) = np.concatenate(nodes), np.concatenate(keys), np.concatenate(more, axis=1)
            kind, notices = fold_keys(key)
            known = kind == KNOWN
            # the notice of a key stands for its least node
            order = np.lexsort((node, key))
            begin = np.ones(len(key), bool)
            begin[1:] = key[order][1:] != key[order][:-1]
            local = np.empty(len(key), np.uint64)
            local[order] = node[order][begin][np.cumsum(begin) - 1] if len(key) else node
            z = np.zeros(len(notices), np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([np.where(known, _spread(signed(key), signed(node)), signed(key)), signed(key)[notices]])),
                    pa.array(np.concatenate([signed(node), signed(local)[notices]])),
                    pa.array(np.concatenate([np.where(known, signed(key), 0), z])),
                    pa.array(np.concatenate([np.where(known, signed(local), 0), z])),
                    pa.array(np.concatenate([kind, np.full(len(notices), NOTICE, np.int8)])),
                    pa.array(np.concatenate([scheme, scheme[notices]])),
                    pa.array(np.concatenate([room, np.full(len(notices), np.iinfo(np.int32).max, np.int32)])),
                ],
                ["key", "node", "real", "local", "kind", "scheme", "room"],
            )

    return run


def _sketches(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p in pieces(batches, "_text"):
            words = split_words(*flat(p.column("_text")), lower=True)
            doc, h = shingles(words, size)
            n = np.bincount(doc, minlength=words.n_texts)
            yield pa.RecordBatch.from_arrays(
                [
                    p.column("node"), pa.array(n, pa.int64()), pa.array(parity_bits(doc, h, n), pa.binary()), p.column("_text"),
                    *[pa.array(c) for c in short_sketches(doc, h, words.n_texts).T.copy()],
                ],
                ["node", "n", "sketch", "text", *SHORT],
            )

    return run


def _near(num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, m = (b.column(c).to_numpy(zero_copy_only=False) for c in ("n", "m"))
            limit = _limit(n, m, num, den)
            s, t = b.column("sketch").to_pylist(), b.column("other").to_pylist()
            keep = [hamming(x, y) <= k for x, y, k in zip(s, t, limit.tolist(), strict=True)]
            yield b.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return run


def _verified(size: int, num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "text"):
            for p in pieces(iter([b]), "other"):
                (d1, h1), (d2, h2) = (shingles(split_words(*flat(p.column(c)), lower=True), size) for c in ("text", "other"))
                rows = np.arange(p.num_rows)
                a, b2 = np.bincount(d1, minlength=len(rows)), np.bincount(d2, minlength=len(rows))
                d, h = np.concatenate([d1, d2]), np.concatenate([h1, h2])
                order = np.lexsort((h, d))
                d, h = d[order], h[order]
                both = np.bincount(d[1:][(d[1:] == d[:-1]) & (h[1:] == h[:-1])], minlength=len(rows))
                yield p.select(["u", "v"]).filter(pa.array(den * both >= num * (a + b2 - both)))

    return run


def _similar(pairs: DataFrame, texts: DataFrame, size: int, num: int, den: int) -> DataFrame:
    """The pairs (u, v) of nodes whose sets reach the similarity: sketch distance first, then the sets."""
    s = texts.select(F.col("node").alias("u"), "n", "sketch")
    t = texts.select(F.col("node").alias("v"), F.col("n").alias("m"), F.col("sketch").alias("other"))
    near = pairs.select("u", "v").join(s, "u").join(t, "v").filter(f"{den} * least(n, m) >= {num} * greatest(n, m)")
    near = near.select("u", "v", "n", "m", "sketch", "other").mapInArrow(_near(num, den), "u long, v long")
    one = texts.select(F.col("node").alias("u"), "text")
    two = texts.select(F.col("node").alias("v"), F.col("text").alias("other"))
    return near.join(one, "u").join(two, "v").select("u", "v", "text", "other").mapInArrow(_verified(size, num, den), "u long, v long")


def _close(num: int, den: int) -> Column:
    """Whether rows ``a`` and ``b`` of a key are of different components and near enough by size and short sketch."""
    apart = sum((F.bit_count(F.col(f"a.{c}").bitwiseXOR(F.col(f"b.{c}"))) for c in SHORT), F.lit(0))
    limit = F.floor((F.col("a.n") + F.col("b.n")) * (den - num) / (den + num))
    sizes = F.expr(f"{den} * least(a.n, b.n) >= {num} * greatest(a.n, b.n)")
    return (F.col("a.key") == F.col("b.key")) & (F.col("a.scheme") == F.col("b.scheme")) & (F.col("a.label") != F.col("b.label")) & sizes & (apart <= limit)


def _dealt(open_keys: DataFrame, texts: DataFrame, round_: int, num: int, den: int) -> DataFrame:
    """Pairs (u, v) of near nodes that fall into one of the hands a key's nodes are dealt into."""
    hand = F.pmod(F.xxhash64("node", "key", F.lit(round_)), F.ceil(F.col("size") / HAND))
    rows = open_keys.withColumn("hand", hand).join(texts.select("node", "n", *SHORT), "node")
    on = (F.col("a.hand") == F.col("b.hand")) & (F.col("a.node") < F.col("b.node")) & _close(num, den)
    return rows.alias("a").join(rows.alias("b"), on).select(F.col("a.node").alias("u"), F.col("b.node").alias("v")).distinct()


def _labels(edges: DataFrame) -> DataFrame:
    return component_labels(edges).select("node", "label")


def near_duplicates(
    docs: DataFrame, size: int = 5, num: int = 4, den: int = 5, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per row of ``docs``: (id_col, _h, n_shingles, component_id).

    Texts are lower-cased (A-Z) and split at white space. Two of them are linked when their shingle sets have a
    Jaccard similarity of at least num/den. component_id is the least id reachable by links. Null, empty and
    blank texts have no shingles and are alone. Repeated rows are linked with each other like other copies;
    a null id never becomes the component id of others. _h is the hash of the text and tells rows apart that
    share an id. Other columns are ignored.
    """
    base = keyed(docs, id_col, text_col)
    ddl = base.schema["_id"].dataType.simpleString()
    sets = stored(base.mapInArrow(_sets(size), f"_id {ddl}, _h int, n long, node long"))
    heads = sets.filter("n > 0").groupBy("node").agg(F.min(F.struct(F.col("_id").isNull().alias("last"), "_id", "_h")).alias("head"))

    rows = base.mapInArrow(_keys(size, num, den), "key long, node long, real long, local long, kind tinyint, scheme int, room int")
    w = W.partitionBy("key")
    # one row of a node per key: batches that hold its copies bring one each (a notice, if any of them does)
    again = F.lag("node").over(w.orderBy("node", F.desc("kind")))
    rows = rows.withColumn("_again", again).filter("_again IS NULL OR _again != node").drop("_again")
    rows = rows.withColumn("_n", F.count("*").over(w)).withColumn("_rep", F.min("node").over(w))
    rows = rows.withColumn("_who", F.bit_xor("node").over(w)).withColumn("_more", F.max("kind").over(w) > SINGLE)
    known = F.col("kind") == KNOWN
    # keys with the same nodes are one: near copies share most of their blocks
    who = F.when(known, F.col("real")).when(F.col("_more"), F.col("key")).otherwise(F.xxhash64("_who", "_n"))
    members = rows.filter(known | (F.col("_n") > 1)).groupBy(who.alias("key"), "node", "scheme")
    members = stored(
        members.agg(
            F.min(F.when(known, F.col("local")).otherwise(F.col("_rep"))).alias("rep"), F.count(F.when(F.col("kind") != NOTICE, 1)).alias("count"), F.min("room").alias("room")
        )
    )
    members = members.join(members.groupBy("key").agg(F.count("*").alias("nodes")), "key")
    own = W.partitionBy("node", "scheme")
    last = F.sum("count").over(own.orderBy(F.desc("nodes"), "key").rowsBetween(W.unboundedPreceding, W.currentRow))
    members = members.withColumn("room", F.min("room").over(own)).withColumn("last", last)
    hot = F.coalesce(F.sum(F.when(F.col("nodes") > HOT, F.col("count"))).over(own), F.lit(0))
    members = members.withColumn("hot", hot).withColumn("late", F.col("last") < F.col("room"))
    members = members.withColumn("out", F.coalesce(F.max(F.when(F.col("late"), F.col("last"))).over(own), F.lit(0)))
    members = members.filter((F.col("nodes") <= HOT) | (F.col("hot") >= F.col("room")))
    members = stored(members.select("key", "node", "rep", "count", "scheme", "room", "late", "out"))
    wanted = members.select("node").distinct().join(heads, "node").select("node", "head._id", "head._h")
    # one text per node, however often its row is repeated
    texts = base.join(wanted, same_doc(base, wanted)).groupBy("node").agg(F.first("_text").alias("_text")).mapInArrow(
        _sketches(size), "node long, n long, sketch binary, text string, " + ", ".join(f"{c} long" for c in SHORT)
    )
    texts = stored(texts)

    star = members.filter("node != rep").groupBy("node", "rep").agg(F.sum("count").alias("count"))
    star = star.groupBy("node").agg(F.max_by("rep", F.struct("count", "rep")).alias("rep")).select(F.col("node").alias("u"), F.col("rep").alias("v"))
    edges = stored(_similar(star, texts, size, num, den))
    labels = _labels(edges) if not edges.isEmpty() else None

    open_keys = None
    for round_ in range(STARS + DEALS + 1):
        label: Column = F.col("node") if labels is None else F.coalesce("label", "node")
        now = (members if labels is None else members.join(labels, "node", "left")).select("key", "node", "count", "scheme", "room", "late", "out", label.alias("label"))
        main = now.groupBy("key", "label").count().groupBy("key")
        main = main.agg(F.count("*").alias("labels"), F.max_by("label", F.struct("count", "label")).alias("main"), F.sum("count").alias("size"))
        open_keys = stored(now.join(main.filter("labels > 1").select("key", "main", "size"), "key"))
        if round_ == STARS + DEALS:
            break
        if round_ < STARS:
            # one node of the main component answers for it, another one in every round
            order = F.xxhash64("node", F.lit(round_))
            rep = open_keys.filter("label = main").groupBy("key").agg(F.min_by("node", order).alias("rep"))
            star = open_keys.filter("label != main").join(rep, "key").groupBy("node", "rep").agg(F.sum("count").alias("count"))
            near = star.groupBy("node").agg(F.max_by("rep", F.struct("count", "rep")).alias("rep")).select(F.col("node").alias("u"), F.col("rep").alias("v"))
        else:
            near = _dealt(open_keys, texts, round_, num, den)
        found = stored(_similar(near, texts, size, num, den))
        if not found.isEmpty():
            edges = edges.unionByName(found)
            labels = _labels(edges)
    open_keys = stored(open_keys.filter("NOT late").join(texts.select("node", "n", *SHORT), "node"))
    few = open_keys.filter("label != main").alias("a")
    rest = open_keys.alias("b")
    # both may be in the minority: such a pair comes up from either side and counts once, from its lesser node's
    once = (F.col("b.label") == F.col("b.main")) | (F.col("a.node") < F.col("b.node"))
    pairs = few.join(rest, _close(num, den) & once).select(
        F.least("a.node", "b.node").alias("u"), F.greatest("a.node", "b.node").alias("v"), "a.scheme", "a.count",
        (F.greatest("a.room", "b.room") - F.greatest("a.out", "b.out")).alias("need"),
    )
    # linked sets agree in as many blocks as either side needs, less those that either left out
    pairs = pairs.groupBy("u", "v", "scheme").agg(F.sum("count").alias("shared"), F.max("need").alias("need"))
    pairs = pairs.filter("shared >= need").select("u", "v").distinct()
    more = stored(_similar(pairs, texts, size, num, den))
    if not more.isEmpty():
        edges = edges.unionByName(more)
        labels = _labels(edges)

    nodes = heads.select("node", "head._id")
    nodes = nodes.withColumn("label", F.col("node")) if labels is None else nodes.join(labels, "node", "left").select("node", "_id", F.coalesce("label", "node").alias("label"))
    least = nodes.groupBy("label").agg(F.min("_id").alias("component_id"))
    of = nodes.join(least, "label").select("node", "component_id")
    out = sets.join(of, "node", "left")
    component = F.when(F.col("n") == 0, F.col("_id")).otherwise(F.col("component_id"))
    return out.select(F.col("_id").alias(id_col), "_h", F.col("n").alias("n_shingles"), component.alias("component_id"))


def one_of_each(docs: DataFrame, size: int = 5, num: int = 4, den: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without near duplicates: of each component the row with the least id stays, unchanged.
    Rows without shingles all stay; of rows that repeat id and text, one stays."""
    found = near_duplicates(docs, size, num, den, id_col, text_col)
    heads = found.filter("n_shingles > 0").groupBy("component_id").agg(F.min(F.struct(F.col(id_col).isNull().alias("last"), F.col(id_col).alias("_id"), "_h")).alias("k"))
    blank = found.filter("n_shingles = 0").select(F.col(id_col).alias("_id"), "_h").distinct()
    keep = heads.select("k._id", "k._h").unionByName(blank)
    d = docs.withColumn("_hash", F.hash(F.col(text_col)))
    kept = d.join(keep, d[id_col].eqNullSafe(keep["_id"]) & (d["_hash"] == keep["_h"]), "left_semi")
    return kept.dropDuplicates([id_col, "_hash"]).drop("_hash")
