"""Packing, token alignment and collocations against plain versions, and on awkward rows."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from hostweave.llm import alignment, collocations, packing, parity_join, subwords
from hostweave.llm.alignment import aligned, group_labels, piece_count, with_link_counts
from hostweave.llm.collocations import HatTrie, Sizes, phrase_counts
from hostweave.llm.packing import first_fit, packed, packed_items, sequences
from hostweave.llm.subwords import segments, vocabulary, word_tokenizer
from hostweave.llm.tokens import flat

SCHEMA = "doc_id long, text string, lang string, source string, sequence_id long, links string, _block int, phrase string, _row long"
STRANGE = [
    None, "", " ", " \t\n", "one", "one. two\r\n;\r\n three", "x   y　 z  w\u0085 v", "a  b   c \n\n d\t\te ", "é ́x café.",
    "<|endoftext|> <|startoftext|>.<|endoftext|>", "it's we'll. 'tis don't,can't", "▁piece ▁▁ x", "<s> <unk> <0x0A> </s>", "日本語。テキスト 한국어 ไทย",
    "\x00 a\x01\x0b\x0cb", "𝕏 😀😀 \U0001f468‍\U0001f469", "A.B;C: D!E?F", "ÀÉ İSTANBUL ΣΑΣ ß", "    lead", "trail    ", "12.50,30 3rd 4TH", "J\u030c T\u0308. H\u0331,W\u030a E\u0301 I\u0307", "<|EndOfText|> ABC", "\n\nUP\n Down\t\tX",
]


def table(spark, texts, langs=None):
    rows = [(i, t, (langs or ["en", "fr", None])[i % (len(langs) if langs else 3)], "s", 5, "l", 1, "p", 0) for i, t in enumerate(texts)]
    rows += [rows[4], (None, "no id here", None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


def noise(seed, n):
    r = random.Random(seed)
    parts = list("abcXYZéß0 9.,;:!?'\"\n\t\r|<>") + [" ", " ", "  ", " the", "ing ", ". ", " ", " ", "▁", "中", "😀"]
    return ["".join(r.choice(parts) for _ in range(r.randrange(1, 120))) for _ in range(n)]


def test_segments_give_a_texts_own_ids():
    word, byte = word_tokenizer(vocabulary("word_bpe_49k.json")), alignment._byte_level(vocabulary("byte_bpe_50k.json"))[0]
    model = alignment._piece_model(vocabulary("piece_bpe_32k.model"))[0]
    for text in [t for t in STRANGE if t] + noise(1, 400):
        for shown in (text, " " + text):
            doc, parts = segments(*flat(pa.array([shown])))
            parts = [x.decode() for x in parts.to_pylist()]
            assert "".join(parts) == shown and not doc.any()
            folded = [x.decode() for x in segments(*flat(pa.array([shown])), fold=True)[1].to_pylist()]
            assert [i for s in folded for i in word.encode(s, add_special_tokens=False).ids] == word.encode(shown, add_special_tokens=False).ids
        assert [i for s in parts for i in byte.encode(s, add_special_tokens=False).ids] == byte.encode(shown, add_special_tokens=False).ids
        assert [i for s in alignment._piece_ids(model, parts) for i in s] == model.encode(text)


def test_words_of_plain_letters_go_to_the_model_directly():
    r = random.Random(9)
    letters = [c for c in map(chr, range(97, 256)) if subwords.PLAIN.fullmatch(c)]
    words = ["".join(r.choice(letters[: r.choice([26, 60])]) for _ in range(r.randrange(1, 14))) for _ in range(3000)]
    path = vocabulary("word_bpe_49k.json")
    _, lengths, values, _ = packing._encoder(path)([w.encode() for w in words])
    ends = np.cumsum(lengths)
    got = [values[z - n : z].tolist() for z, n in zip(ends, lengths, strict=True)]
    assert got == [e.ids for e in word_tokenizer(path).encode_batch(words, add_special_tokens=False)]


def test_first_fit_takes_the_first_sequence_with_room():
    r = random.Random(2)
    for n in (0, 1, 2, 3, 7, 50, 300):
        sizes = np.array([r.randrange(1, 101) for _ in range(n)], np.int64)
        room, want = [], [0] * n
        for i in sorted(range(n), key=lambda i: (-sizes[i], i)):
            at = next((b for b, free in enumerate(room) if free >= sizes[i]), len(room))
            if at == len(room):
                room.append(100)
            room[at] -= sizes[i]
            want[i] = at
        assert first_fit(sizes, 100).tolist() == want


@pytest.mark.parametrize("sizes", [[], [1], [100], [60] * 9, [51, 51, 51, 49], [100, 99, 1, 1, 1], [34] * 30 + [67] * 7])
def test_packed_items_fill_the_fewest_sequences(sizes):
    found = packed_items(np.array(sizes, np.int64), 100)
    cover, fill = defaultdict(list), defaultdict(list)
    for item, start, length, at, offset in found:
        cover[item].append((start, length))
        fill[at].append((offset, length))
    for item, size in enumerate(sizes):
        assert sum(x for _, x in cover[item]) == size and len({s for s, _ in cover[item]}) == len(cover[item])
    for parts in fill.values():
        parts.sort()
        assert [o for o, _ in parts] == np.cumsum([0, *[n for _, n in parts]])[:-1].tolist() and sum(n for _, n in parts) <= 100
    assert len(fill) == -(-sum(sizes) // 100)


def check_packing(rows, texts, size):
    tokenizer = word_tokenizer(vocabulary("word_bpe_49k.json"))
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        ids = np.array(r.ids, "<u4")
        assert r.length == len(ids) and r.ids_crc32 == zlib.crc32(ids.tobytes())
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append((r.offset, r.length))
    for doc, text in texts.items():
        want = tokenizer.encode(text or "", add_special_tokens=False).ids + [2]
        parts = sorted(by_doc[doc], key=lambda r: r.start)
        assert [i for r in parts for i in r.ids] == want and {r.doc_tokens for r in parts} == {len(want)}
    for parts in by_seq.values():
        parts.sort()
        assert [o for o, _ in parts] == np.cumsum([0, *[n for _, n in parts]])[:-1].tolist() and sum(n for _, n in parts) <= size


def test_packing_round_trip(spark):
    r = random.Random(3)
    texts = STRANGE + noise(4, 40) + [" ".join(r.choice(["alpha", "beta", "Gamma,", "delta."]) for _ in range(n)) for n in (900, 63, 128, 20_000)]
    docs = table(spark, texts)
    out = packed(docs, size=64)
    rows = out.collect()
    own = {i: t for i, t in enumerate(texts) if i != 4}
    check_packing(rows, own, 64)
    # the repeated row and the two rows without an id are documents of their own
    assert sorted((x.start, x.doc_tokens) for x in rows if x.doc_id == 4) == [(0, 2), (0, 2)]
    assert sorted(x.doc_tokens for x in rows if x.doc_id is None) == [1, 4]
    padded = {x.sequence_id: x for x in sequences(out, 64).collect()}
    fill = Counter()
    for x in rows:
        fill[x.sequence_id] += x.length
    assert all(len(padded[s].ids) == (n if n & (n - 1) == 0 else 64) and sum(padded[s].lengths) == n for s, n in fill.items())
    assert sum(64 - n for n in fill.values()) < 64


def test_packing_in_several_groups(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP", 10)
    texts = noise(6, 120)
    rows = packed(table(spark, texts), size=128).collect()
    check_packing(rows, {i: t for i, t in enumerate(texts) if i != 4}, 128)
    assert len({x.sequence_id >> 32 for x in rows if x.sequence_id >= packing.ITEMS}) > 5


def plain_alignment(texts):
    byte, a_bytes = alignment._byte_level(vocabulary("byte_bpe_50k.json"))
    model, b_bytes = alignment._piece_model(vocabulary("piece_bpe_32k.model"))
    out, count = [], Counter()
    for text in texts:
        a = byte.encode(" " + (text or ""), add_special_tokens=False).ids
        b = model.encode(text or "")
        whole = (" " + (text or "")).encode()
        if not text or b"".join(a_bytes[i] for i in a) != whole or b"".join(b_bytes[i] for i in b) != whole:
            out.append((0, 0, [], []))
            continue
        x, y = (np.cumsum([len(t[i]) for i in ids]).tolist() for t, ids in ((a_bytes, a), (b_bytes, b)))
        groups, links, i, j = [], [], 0, 0
        for end in sorted(set(x) & set(y)):
            p, q = x.index(end) + 1, y.index(end) + 1
            groups.append(",".join(map(str, a[i:p])) + "|" + ",".join(map(str, b[j:q])))
            links.append((a[p - 1], b[q - 1]))
            i, j = p, q
        count.update(links)
        out.append((len(a), len(b), groups, links))
    best = defaultdict(int)
    for (_, b), n in count.items():
        best[b] = max(best[b], n)
    return [
        (n_a, n_b, len(g), len(k), sum(count[x] == best[x[1]] for x in k), sum(count[x] for x in k), hashlib.sha256(";".join(g).encode()).hexdigest() if g else "")
        for n_a, n_b, g, k in out
    ]


def test_alignment_equals_a_plain_version(spark):
    r = random.Random(8)
    texts = STRANGE + noise(7, 150) + [" ".join(r.choice(STRANGE[4:]) for _ in range(2000)).replace("▁", "")]
    docs = table(spark, texts).repartition(3)
    out = with_link_counts(aligned(docs, block_bytes=2000), piece_count())
    got = sorted(
        (x.doc_id is None, x.doc_id or 0, x.n_a, x.n_b, x.n_groups, x.n_links, x.n_best, x.count_sum, hashlib.sha256(x.groups.encode()).hexdigest() if x.groups else "") for x in out.collect()
    )
    every = [*texts, texts[4], "no id here", None]
    ids = [*range(len(texts)), 4, None, None]
    assert got == sorted((i is None, i or 0, *w) for i, w in zip(ids, plain_alignment(every), strict=True))


def test_pointers_of_long_chains():
    # tokens of 3 and of 4 bytes, shifted: one group of many tokens, then a common end
    a, b = np.append(np.arange(3, 3000, 3), 3001), np.append(np.arange(4, 3000, 3), 3001)
    x, y = group_labels(a, b)
    assert set(x) == set(y) == {len(a) - 1}


def plain_collocations(rows, least, inside, top):
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        n[lang] += 0
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for m in range(1, 5):
                f[lang].update(tuple(w[i : i + m]) for i in range(len(w) - m + 1))
    out = set()
    for lang, c in f.items():
        found = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        rank = []
        for p, a in found.items():
            longer = [b for q, b in found.items() if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))]
            if any(100 * b >= inside * a for b in longer):
                continue
            score, k = min((2000000 * a // (c[p[:k]] + c[p[k:]]), k) for k in range(1, len(p)))
            rank.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        for i, (s, a, p, left, right) in enumerate(sorted(rank)[:top]):
            out.add((lang, i + 1, p.decode(), -a, left, right, n[lang], -s))
    return out


# small: many units, cut inside texts; containers burst, subtrees are spilled early
@pytest.mark.parametrize("sizes", [Sizes(), Sizes(3000, 40, 3, 20, 16)])
def test_collocations_equal_a_plain_version(spark, sizes):
    r = random.Random(11)
    words = ["a", "B", "b", "new", "York", "zeit", "é", "x y", "\u000bv", "the"]
    line = lambda k: "".join(r.choice(words) + r.choice([" ", " ", "  ", "\t", ". ", "\n", "-"]) for _ in range(k))
    texts = [line(r.randrange(0, 60)) for _ in range(80)] + ["new york city hall, "] * 12 + ["a a a a a a", None, "", "! .,", line(3000)]
    docs = table(spark, texts, ["en", "fr", None, "und"])
    plain = [(x.text, x.lang) for x in docs.select("text", "lang").collect()]
    got = {tuple(x) for x in collocations.collocations(docs.repartition(2), 5, 80, 30, sizes=sizes).collect()}
    assert got == plain_collocations(plain, 5, 80, 30)


def test_units_of_mixed_languages_are_filled_one_by_one(spark):
    texts = [f"w{i % 7} x{i} the the. the" for i in range(600)]
    docs = spark.createDataFrame([(t, "abc"[i % 3]) for i, t in enumerate(texts)], "_text string, lang string").coalesce(1)
    schema = "unit long, lang string, own long, codes binary, words array<string>, counts array<long>"
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")
    try:
        full = docs.mapInArrow(collocations._units(Sizes(unit_bytes=1 << 20)), schema).collect()
        small = docs.mapInArrow(collocations._units(Sizes(unit_bytes=1 << 20, all_bytes=3000)), schema).collect()
        each = docs.mapInArrow(collocations._units(Sizes(unit_bytes=3000)), schema).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(u.lang for u in full) == ["a", "b", "c"]
    # a language's units end at their own size, not when all languages together have it
    assert max(sum(u.counts) for u in small) < min(sorted(sum(u.counts) for u in each if u.lang == "a")[1:])
    for units in (full, small, each):
        assert len({u.unit for u in units}) == len(units)
        for lang in "abc":
            mine = [u for u in units if u.lang == lang]
            want = Counter(w for i, t in enumerate(texts) if "abc"[i % 3] == lang for w in t.replace(".", " ").split())
            assert sum((Counter(dict(zip(u.words, u.counts, strict=True))) for u in mine), Counter()) == want
            spelled = [[u.words[c] if c >= 0 else "|" for c in collocations._unpacked(pa.py_buffer(u.codes))] for u in mine]
            assert " ".join(w for x in spelled for w in x) == " ".join("| " + t.replace(".", " |") for i, t in enumerate(texts) if "abc"[i % 3] == lang)
            assert all(u.words[0] == "the" and u.counts == sorted(u.counts, reverse=True) for u in mine)


def test_packed_codes():
    codes = np.array([-1, 0, 254, 255, 256, 65534, 65535, (1 << collocations.BITS) - 1], np.int32)
    assert collocations._unpacked(pa.py_buffer(collocations._packed(codes))).tolist() == codes.tolist()
    assert len(collocations._packed(codes)) == 3 * len(codes) and not collocations._packed(codes[:0])


def test_trie_counts_whatever_its_shape():
    r = random.Random(5)
    for depth in (1, 2, 3, 4):
        trie, want, got = HatTrie(depth, Sizes(burst=4, chunk=9)), Counter(), Counter()
        for _ in range(6):
            paths = [tuple(r.randrange(5) for _ in range(depth)) for _ in range(200)]
            want.update(paths)
            trie.add(np.array(paths, np.int64))
            for keys, counts in trie.spill(20):
                got.update(dict(zip(map(tuple, keys.tolist()), counts.tolist(), strict=True)))
        for keys, counts in trie.spill(0):
            for k, c in zip(map(tuple, keys.tolist()), counts.tolist(), strict=True):
                got[k] += c
        assert trie.held == 0 and got == want


def test_empty_tables(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert packed(docs).count() == 0
    assert with_link_counts(aligned(docs), piece_count()).count() == 0
    assert collocations.collocations(docs).count() == 0
    assert phrase_counts(docs)[0].count() == 0


def test_near_duplicates_of_repeated_rows_and_copies_in_many_batches(spark):
    r = random.Random(21)
    words = [f"w{i}" for i in range(300)]
    texts = [" ".join(r.choice(words) for _ in range(100)) for _ in range(25)]
    rows = [(1, texts[0])] * 60 + [(2, texts[0] + " end")] * 60
    # every other text twice, the copies dealt over the partitions: unrelated groups of two must stay apart
    rows += [(10 + 2 * i + c, t) for i, t in enumerate(texts[1:]) for c in (0, 1)]
    r.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(9)
    got = Counter((x.doc_id, x.component_id) for x in parity_join.near_duplicates(docs).collect())
    want = Counter({(1, 1): 60, (2, 1): 60})
    want.update({(10 + 2 * i + c, 10 + 2 * i): 1 for i in range(24) for c in (0, 1)})
    assert got == want
