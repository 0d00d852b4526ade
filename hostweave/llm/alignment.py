"""Alignment of two tokenizers' tokens over the same bytes, by pointer jumping.

Both tokenizers cover the bytes of space + text. Tokens of the two that overlap belong together; a group is a connected
component of that relation, and groups meet where a token of either tokenizer ends. Every token points to the farthest-right
token that overlaps it: the other tokenizer's token over its last byte, or itself where both end there (then the first
tokenizer's one stands for both). Doubling the pointers, for all tokens of a batch at once, ends after a logarithmic number
of steps with every token at the terminal token of its group.

A link joins the two tokens that end a group together. How often a pair of ids is linked in the whole corpus is counted block by
block (about ``BLOCK_BYTES`` of text), summed by pair, and each block fetches the sums of the pairs it holds.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hostweave.llm.subwords import Memo, byte_letters, gather, segments, vocabulary, word_tokenizer
from hostweave.llm.tables import stored
from hostweave.llm.tokens import flat, pieces

BLOCK_BYTES = 4 << 20


def jump(succ: np.ndarray) -> np.ndarray:
    """Where the pointers lead in the end: successors are doubled until none moves."""
    while True:
        far = succ[succ]
        if np.array_equal(far, succ):
            return succ
        succ = far


def group_labels(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For the ascending end offsets of two token rows over the same bytes: per token, the number of the first row's token
    that ends its group."""
    n = len(a_ends)
    over = np.searchsorted(b_ends, a_ends)  # the second row's token over the last byte
    a_succ = np.where(b_ends[over] == a_ends, np.arange(n), n + over)
    label = jump(np.concatenate([a_succ, np.searchsorted(a_ends, b_ends)]))
    return label[:n], label[n:]


@cache
def _byte_level(path: str):
    """The tokenizer of a byte-level vocabulary and the bytes of each id."""
    tokenizer = word_tokenizer(path)
    tokenizer.encode_special_tokens = True
    letters = byte_letters()
    with open(path, encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    size = max(tokenizer.get_vocab_size(), max(vocab.values()) + 1)
    table = [b""] * size
    for token, i in vocab.items():
        table[i] = bytes(letters[c] for c in token)
    return tokenizer, table


JOINED = re.compile(r"[\x21-\x7e\x80-\U0010ffff](?<!▁)[\t\n▁]|[A-Za-z][.,;:!?]|\n")


@cache
def _piece_model(path: str):
    """The processor of a piece vocabulary and the bytes of each id."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    names = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    if any(JOINED.search(x) for x in names) or model.encode("\n", out_type=str) != ["▁", "<0x0A>"]:
        raise ValueError(f"{path}: pieces join characters that segments part")
    table = [bytes([int(x[3:5], 16)]) if model.is_byte(i) else x.replace("▁", " ").encode() for i, x in enumerate(names)]
    return model, table


def _piece_ids(model, texts: list[str]) -> list[list[int]]:
    """Ids of segments. The model puts a space first: it stands for the segment's own, or is cut off with a line feed after it,
    which no piece joins with anything."""
    own = [len(t) > 1 and t[0] == " " for t in texts]
    ids = model.encode([t[1:] if o else "\n" + t for t, o in zip(texts, own, strict=True)], num_threads=1)
    return [x if o else x[2:] for x, o in zip(ids, own, strict=True)]


def _encoder(a_path: str, b_path: str):
    """Segments to (facts: tokens of A, of B, whether both cover the bytes), links and the groups as text."""
    tokenizer, a_bytes = _byte_level(a_path)
    model, b_bytes = _piece_model(b_path)
    a_size, b_size = (np.array([len(x) for x in t], np.int64) for t in (a_bytes, b_bytes))

    def encode(new: list[bytes]):
        texts = [s.decode() for s in new]
        a_ids = [e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        b_ids = _piece_ids(model, texts)
        same = [b"".join([a_bytes[i] for i in a]) == s == b"".join([b_bytes[i] for i in b]) for s, a, b in zip(new, a_ids, b_ids, strict=True)]
        facts = np.array([(len(a), len(b), ok) for a, b, ok in zip(a_ids, b_ids, same, strict=True)], np.int64).reshape(-1, 3)
        ok = np.flatnonzero(facts[:, 2])
        a = np.fromiter((i for k in ok.tolist() for i in a_ids[k]), np.int64)
        b = np.fromiter((i for k in ok.tolist() for i in b_ids[k]), np.int64)
        lengths, links, strings = np.zeros(len(new), np.int64), np.zeros(0, np.int64), [""] * len(new)
        if len(a):
            a_label, b_label = group_labels(np.cumsum(a_size[a]), np.cumsum(b_size[b]))
            last = np.unique(a_label)  # the token of A that ends each group
            a_stop, b_stop = last + 1, np.searchsorted(b_label, last, "right")
            links = a[last] * len(b_bytes) + b[b_stop - 1]
            of = np.searchsorted(np.cumsum(facts[ok, 0]), last, "right")
            lengths[ok] = np.bincount(of, minlength=len(ok))
            a_text, b_text = [str(i) for i in a.tolist()], [str(i) for i in b.tolist()]
            parts, x, y = [], 0, 0
            for p, q in zip(a_stop.tolist(), b_stop.tolist(), strict=True):
                one = a_text[x] if p == x + 1 else ",".join(a_text[x:p])
                parts.append(f"{one}|{b_text[y] if q == y + 1 else ','.join(b_text[y:q])}")
                x, y = p, q
            at = 0
            for k, n in zip(ok.tolist(), lengths[ok].tolist(), strict=True):
                strings[k] = parts[at] if n == 1 else ";".join(parts[at : at + n])
                at += n
        return facts, lengths, links, strings

    return encode


@cache
def _memo(a_path: str, b_path: str) -> Memo:
    """Kept as long as the Python worker, over its tasks."""
    return Memo(_encoder(a_path, b_path), 150_000)


def _aligned(a_path: str, b_path: str, block_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = _memo(a_path, b_path)
        block, held = TaskContext.get().partitionId() << 32, 0
        for p in pieces(batches, "_text"):
            data, offsets = flat(p.column("_text"))
            n = p.num_rows
            # a space before every text that is not empty
            full = np.diff(offsets) > 0
            spaced = np.full(len(data) + int(full.sum()), 32, np.uint8)
            spaced[np.arange(len(data)) + np.repeat(np.cumsum(full), np.diff(offsets))] = data
            doc, segment = segments(spaced, offsets + np.append(0, np.cumsum(full)))
            entry = memo.look_up(segment)
            facts = memo.facts[entry].reshape(-1, 3)
            bad = np.bincount(doc, weights=facts[:, 2] == 0, minlength=n) > 0
            use = ~bad[doc]
            doc, entry, facts = doc[use], entry[use], facts[use]
            n_a, n_b, n_links = (np.bincount(doc, weights=w, minlength=n).astype(np.int64) for w in (facts[:, 0], facts[:, 1], memo.lengths[entry]))
            links = memo.values[gather(memo.starts[entry], memo.lengths[entry])]
            ends = np.searchsorted(doc, np.arange(n + 1)).tolist()
            say, number = memo.strings.__getitem__, entry.tolist()
            groups = [";".join(map(say, number[x:y])) for x, y in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    p.column("_id"), pa.array(n_a), pa.array(n_b), pa.array(n_links), pa.array(groups, pa.string()),
                    pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n_links)), pa.int32()), pa.array(links)),
                    pa.array(np.full(n, block)),
                ],
                ["_id", "n_a", "n_b", "n_groups", "groups", "links", "_block"],
            )
            held += len(data)
            if held > block_bytes:
                block, held = block + 1, 0

    return run


def aligned(
    docs: DataFrame, a_path: str | None = None, b_path: str | None = None, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """One row per row of ``docs``: (id_col, n_a, n_b, n_groups, groups, links, _block).

    ``a_path`` is a byte-level vocabulary file, ``b_path`` a piece model; strings of special tokens are plain text. ``groups`` lists the
    groups in order as ``a1,a2|b1;a3|b2,b3`` (ids of A, ids of B). ``links`` holds the linked pair of each group as A id times size
    of B's vocabulary plus B id. A text that is null, empty, or whose bytes the tokens of A or B do not give back has no
    tokens: zeros, an empty string, no links. Rows that repeat an id, or have none, stand for themselves; other columns are
    ignored. ``_block`` names a block of rows for ``with_link_counts``.
    """
    base = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    ddl = base.schema["_id"].dataType.simpleString()
    run = _aligned(a_path or vocabulary("byte_bpe_50k.json"), b_path or vocabulary("piece_bpe_32k.model"), block_bytes)
    out = base.mapInArrow(run, f"_id {ddl}, n_a long, n_b long, n_groups long, groups string, links array<long>, _block long")
    return out.withColumnRenamed("_id", id_col)


def _block_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(_block, pair, n): how often a block's rows hold each pair; rows of a block may give several parts."""
    held: dict[int, list[np.ndarray]] = {}

    def parts(block: int) -> pa.RecordBatch:
        pair, n = np.unique(np.concatenate(held.pop(block)), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(pair), block)), pa.array(pair), pa.array(n)], ["_block", "pair", "n"])

    for b in batches:
        blocks, lists = b.column("_block").to_numpy(), b.column("links")
        off, values = lists.offsets.to_numpy(), lists.values.to_numpy()
        cuts = np.append(0, np.append(np.flatnonzero(np.diff(blocks)) + 1, len(blocks)))
        for x, z in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            if x == z:
                continue
            block = int(blocks[x])
            for other in [k for k in held if k != block]:
                yield parts(other)
            held.setdefault(block, []).append(values[off[x] : off[z]].copy())
    for block in list(held):
        yield parts(block)


def _counted(names: list[str]):
    def run(key: tuple[pa.Scalar, ...], rows: pa.Table, sums: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        pair, total = sums.column("pair").to_numpy(), sums.column("total").to_numpy()
        order = np.argsort(pair)
        pair, total, best = pair[order], total[order], sums.column("best").to_numpy()[order]
        lists = rows.column("links").combine_chunks()
        off = lists.offsets.to_numpy().astype(np.int64)
        at = np.searchsorted(pair, lists.values.to_numpy()[off[0] : off[-1]])
        off = off - off[0]

        def summed(x: np.ndarray) -> pa.Array:
            run = np.append(0, np.cumsum(x))
            return pa.array(run[off[1:]] - run[off[:-1]])

        out = {c: rows.column(c) for c in names}
        out["n_links"] = pa.array(np.diff(off))
        out["n_best"] = summed((total[at] == best[at]).astype(np.int64))
        out["count_sum"] = summed(total[at])
        return pa.table(out)

    return run


def with_link_counts(rows: DataFrame, b_size: int) -> DataFrame:
    """``rows`` (any columns, with ``links`` and ``_block`` of ``aligned``) without those two, and with n_links, n_best (links whose pair
    is counted most among the pairs of its B id, ties included) and count_sum (sum of the pairs' counts in all rows)."""
    names = [c for c in rows.columns if c not in ("links", "_block")]
    rows = stored(rows)
    held = stored(rows.select("_block", "links").mapInArrow(_block_pairs, "_block long, pair long, n long"))
    sums = held.groupBy("pair").agg(F.sum("n").alias("total"))
    sums = stored(sums.withColumn("b", F.col("pair") % b_size))
    most = sums.groupBy("b").agg(F.max("total").alias("best"))
    back = held.select("_block", "pair").distinct().join(sums.join(most, "b"), "pair").select("_block", "pair", "total", "best")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name in names)
    out = rows.groupBy("_block").cogroup(back.groupBy("_block"))
    return out.applyInArrow(_counted(names), f"{schema}, n_links long, n_best long, count_sum long")


def piece_count(path: str | None = None) -> int:
    """Size of the piece vocabulary."""
    return len(_piece_model(path or vocabulary("piece_bpe_32k.model"))[1])
