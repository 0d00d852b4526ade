"""The training-data operators against brute force and SQL on small tables, and on awkward rows."""

import hashlib
import random
import re
import zlib
from collections import Counter
from pathlib import Path

import duckdb
import numpy as np
import pandas as pd
import pytest

import corpus_pipeline
from check_queries import TABLES, normal
from hostweave.llm import boosted_quality, catalog, context_tree, parity_join, quality_rules, substring_dedup, weak_toxicity
from hostweave.llm.decontaminate import best_stretch, decontaminated, longest_stretch, overlaps
from hostweave.llm.fair_mix import mixed, mixed_documents
from hostweave.llm.preferences import next_reply, preference_pairs
from hostweave.llm.tag_paths import article, extracted
from hostweave.llm.training import labelled_sample

SF = "/root/testdata/sf0.001"
SPLIT = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, quality string, _id int, key string"


def rows(texts, first=0):
    return [(first + i, t, "en", f"s{i % 3}", len(t or ""), "x", i, "k") for i, t in enumerate(texts)]


def awkward(spark):
    """Nulls, empty and blank texts, repeated rows, one long text, clashing extra columns."""
    r = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)]
    prose = " ".join(r.choice(vocabulary) for _ in range(120))
    long = " ".join(r.choice(vocabulary) for _ in range(30_000))
    data = rows([None, "", " \t\n", "one", prose, prose + " end", long, " x y \x0b z", "a b c d e f"])
    data += [data[4], (None, prose, None, None, None, None, None, None), (None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(data, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def corpus(seed, n=60):
    r = random.Random(seed)
    words = [f"{a}{b}" for a in "abcdef" for b in "uvwxyz"]
    passage = [r.choice(words) for _ in range(45)]
    out = []
    for i in range(n):
        t = [r.choice(words) for _ in range(r.choice([0, 3, 5, 30, 90, 150]))]
        if i % 5 == 1 and out:
            t = SPLIT.findall(r.choice(out))
            for _ in range(r.choice([0, 1, 3])):
                if t:
                    t[r.randrange(len(t))] = "zz"
        if i % 4 == 0:
            k = r.randrange(len(t) + 1)
            t[k:k] = passage
        out.append(r.choice([" ", "\n", "  "]).join(t))
    return out


def brute_repeats(texts, window):
    words = [SPLIT.findall(t or "") for t in texts]
    seen = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for w in words:
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        out.append((len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)))
    return out


@pytest.mark.parametrize("window", [5, 20, 35])
def test_substring_dedup_matches_brute_force(spark, window):
    texts = corpus(window)
    got = substring_dedup.remove_repeats(spark.createDataFrame(rows(texts), SCHEMA), window).orderBy("doc_id").collect()
    assert [(r.n_words, r.n_removed, r.kept_words) for r in got] == brute_repeats(texts, window)


@pytest.mark.parametrize("period", [p for p in substring_dedup.COVERS if p > 1])
def test_covers_hold_every_difference(period):
    cover = substring_dedup.COVERS[period]
    assert {(a - b) % period for a in cover for b in cover} == set(range(period))


def brute_components(texts):
    sets = []
    for t in texts:
        w = SPLIT.findall((t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
        sets.append({tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set())
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return [(len(s), find(i)) for i, s in enumerate(sets)]


@pytest.mark.parametrize("seed", range(3))
def test_near_duplicates_match_brute_force(spark, seed):
    texts = corpus(seed, 80)
    r = random.Random(seed)
    base = [f"v{r.randrange(50)}" for _ in range(100)]
    for k in range(40):  # a group of near copies around the limit of similarity, more than HOT
        t = list(base)
        for _ in range(r.randrange(5)):
            t[r.randrange(100)] = f"Q{k}"
        texts.append(" ".join(t))
    got = parity_join.near_duplicates(spark.createDataFrame(rows(texts), SCHEMA)).orderBy("doc_id").collect()
    assert [(x.n_shingles, x.component_id) for x in got] == brute_components(texts)


def test_large_group_of_near_copies_is_not_spelled_out(spark, monkeypatch):
    """Copies with one of two words at each of 12 places, linked where at most two differ: no copy is near all the others."""
    r, texts = random.Random(7), []
    for _ in range(400):
        words = [f"v{i}" for i in range(100)]
        for k in range(12):
            words[4 + 8 * k] = f"Q{k}{r.randrange(2)}"
        texts.append(" ".join(words))
    compared, similar = [], parity_join._similar

    def counted(pairs, *more):
        compared.append(pairs.count())
        return similar(pairs, *more)

    monkeypatch.setattr(parity_join, "_similar", counted)
    got = parity_join.near_duplicates(spark.createDataFrame(rows(texts), SCHEMA)).orderBy("doc_id").collect()
    assert [(x.n_shingles, x.component_id) for x in got] == brute_components(texts)
    assert compared[-1] < len(texts)  # pairs of the last step, where the rest is spelled out


def test_sketch_distance_is_a_lower_bound():
    r = np.random.default_rng(1)
    for _ in range(50):
        a, b = (np.unique(r.integers(0, 300, r.integers(1, 200)).astype(np.uint64)) for _ in "ab")
        h = [substring_dedup.mix(x) for x in (a, b)]
        s = [parity_join.parity_bits(np.zeros(len(x), int), x, np.array([len(x)]))[0] for x in h]
        assert parity_join.hamming(*s) <= len(np.setxor1d(a, b))


def test_equal_blocks_exist_whenever_sets_are_near():
    r = np.random.default_rng(2)
    for size in [4, 5, 9, 20, 60, 300]:
        for _ in range(20):
            a = substring_dedup.mix(r.integers(0, 1 << 60, size).astype(np.uint64))
            k = max(size // 9, 1) if size > 4 else 0
            b = np.unique(np.append(a[k:], substring_dedup.mix(r.integers(0, 1 << 60, k).astype(np.uint64)))) if size > 4 else np.append(a, np.uint64(7))
            n = np.array([len(a), len(b)])
            both = len(np.intersect1d(a, b))
            if 5 * both < 4 * (n.sum() - both):
                continue
            doc = np.repeat([0, 1], n)
            d, key, _, _ = parity_join.block_keys(doc, np.append(a, b), n, 4, 5)
            assert np.isin(key[d == 0], key[d == 1]).any()


def test_decontamination_finds_substituted_passages_only(spark):
    r = random.Random(3)
    words = [f"{a}{b}{c}" for a in "bcdfg" for b in "aeiou" for c in "lmnrs"]
    items = [(i, " ".join(r.choice(words) for _ in range(r.choice([4, 15, 40])))) for i in range(20)] + [(20, None), (21, "")]
    texts, want = [], set()
    for i in range(60):
        t = [r.choice(words) for _ in range(100)]
        if i % 3 == 0:
            p = items[i % 20][1].split()
            if len(p) > 4:
                for k in range(7, len(p), 12):
                    p[k] = "changed"
            t[50:50] = p
            want.add((i, i % 20))
        texts.append(" ".join(t).upper() if i % 2 else " ".join(t))
    docs = spark.createDataFrame(rows(texts), SCHEMA)
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert {(x.doc_id, x.item_id) for x in overlaps(docs, bench).collect()} == want
    clean = {x.doc_id for x in decontaminated(docs, bench).collect()}
    assert clean == set(range(60)) - {d for d, _ in want}


def test_best_stretch():
    assert best_stretch(np.array([1, 1, 0, 1, 0, 0, 0, 1], bool), 0.5) == (0, 2, 2)
    assert best_stretch(np.zeros(3, bool), 0.5)[2] == 0


def test_longest_stretch_matches_brute_force():
    r = np.random.default_rng(4)
    for _ in range(300):
        equal = r.random(r.integers(0, 30)) < r.choice([0.3, 0.6, 0.75, 0.9])
        num, den = [(3, 4), (4, 5), (1, 2), (1, 1)][r.integers(4)]
        want = max(
            ((int(equal[i:j].sum()), i - j, -i) for i in range(len(equal)) for j in range(i + 1, len(equal) + 1) if den * equal[i:j].sum() >= num * (j - i)),
            default=(0, 0, 0),
        )
        assert longest_stretch(equal, num / den) == (-want[2], -want[2] - want[1], want[0])


def test_decontamination_takes_the_longest_overlap_of_enough_words(spark):
    r = random.Random(7)
    items = [(i, " ".join(f"i{i}w{k}" for k in range(n))) for i, n in enumerate([40, 60, 20, 30, 59])]
    gone = [set(range(3, 40, 4)), set(range(3, 60, 4)), {12, *range(15, 20)}, {9, 10, 16, 20, 24, 28}, {5, 13, 14, 24, 25, 29, 39, 40, 44, 51, 52, 58}]
    filler = [f"f{k}" for k in range(50)]
    texts = []
    for (_, text), out in zip(items, gone, strict=True):
        copied = ["changed" if k in out else w for k, w in enumerate(text.split())]
        texts.append(" ".join([*r.sample(filler, 20), *copied, *r.sample(filler, 20)]))
    docs, bench = spark.createDataFrame(rows(texts), SCHEMA), spark.createDataFrame(items, "item_id long, text string")
    got = {(x.doc_id, x.item_id): (x.n_words, x.n_equal) for x in overlaps(docs, bench).collect()}
    # exactly 75% (the last word is a changed one), 12 equal + 1 changed + 2 equal, and irregular changes
    assert got == {(0, 0): (39, 30), (1, 1): (59, 45), (2, 2): (15, 14), (3, 3): (30, 24), (4, 4): (58, 47)}
    assert decontaminated(docs, bench).count() == 0


def brute_counts(text):
    t = text or ""
    w = SPLIT.findall(t)
    runs = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    again = {j for i in range(len(w) - 7) if runs[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in t.split("\n") if SPLIT.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(again)


def test_quality_counts_match_brute_force(spark):
    texts = corpus(9) + ["a\tb\na b\na\tb\n\n \n", "été # ** | ü", None, "x " * 50, "a b c d e f g h i a b c d e f g h"]
    docs = spark.createDataFrame(rows(texts), SCHEMA)
    got = quality_rules.judged(docs, quality_rules.fit_rules(docs)).orderBy("doc_id").collect()
    for r, t in zip(got, texts, strict=True):
        want = brute_counts(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert not (r.base_failed and r.kept)


def test_quality_model_separates_planted_classes():
    r = np.random.default_rng(0)
    good = r.random(4000) < 0.85
    v = np.where(good[:, None], np.where(r.random((4000, 9)) < 0.99, 1, -1), np.where(r.random((4000, 9)) < 0.5, 1, -1))
    patterns, n = np.unique(v, axis=0, return_counts=True)
    m = quality_rules.fit(patterns.astype(np.int8), n.astype(float))
    assert ((m.probability(v) >= 0.5) == good).mean() > 0.97


def test_boosted_trees_learn_and_are_walked_alike():
    r = np.random.default_rng(0)
    x = r.normal(size=(2000, 5))
    x[r.random((2000, 5)) < 0.05] = np.nan
    y = ((np.nan_to_num(x[:, 0]) > 0) ^ (np.nan_to_num(x[:, 1]) > 0.5)).astype(float)
    t = boosted_quality.grow(x, y)
    score = t.score(x)
    assert ((score > 0.5) == (y > 0.5)).mean() > 0.97
    for i in range(0, 2000, 400):  # one row at a time
        z = t.base
        for f, cut, leaf in zip(t.feature, t.threshold, t.leaf, strict=True):
            k = 0
            while k < len(f):
                k = 2 * k + 1 + bool(x[i, f[k]] > cut[k])
            z += leaf[k - len(f)]
        assert abs(1 / (1 + np.exp(-z)) - score[i]) < 1e-9


def held_out_quality(spark, name, label, threshold, least):
    sf = "/root/testdata/sf0.01"
    got = catalog.QUERIES[name](spark, sf).toPandas().merge(pd.read_parquet(f"{sf}/labels.parquet"), on="doc_id")
    assert (got.held_out == got.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 5 == 0)).all()
    assert got.score.between(0, 1).all() and (got.predicted == (got.score >= threshold)).all()
    got = got[got.held_out]
    assert (got.predicted == got[label]).mean() >= least


def test_quality_classifier_on_held_out_rows(spark):
    held_out_quality(spark, "op3_boosted_quality", "quality", 0.3, 0.93)


def test_toxicity_on_held_out_rows(spark):
    held_out_quality(spark, "op4_weak_toxicity", "toxic", 0.5, 0.9)


def test_capitals_count_over_the_whole_text():
    votes = weak_toxicity.signals(["a " * 300 + "SHOUT " * 200, "A" + "b" * 500, "a" * 600], {}).votes
    assert votes[:, -1].tolist() == [True, False, False]


def test_sample_holds_each_labelled_id_once(spark):
    docs = spark.createDataFrame(rows(["a b"] * 40) + rows(["c d"] * 40), SCHEMA)
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(40)], "doc_id long, quality int, toxic int")
    got = labelled_sample(docs, labels, "toxic", "doc_id", "text", 10).collect()
    assert len(got) == 10 and {r["_text"] for r in got} == {"a b"}


def test_label_model_discounts_voters_that_repeat_each_other():
    r = np.random.default_rng(1)
    toxic = r.random(20_000) < 0.1
    v = r.random((20_000, weak_toxicity.VOTERS)) < np.where(toxic[:, None], 0.6, 0.02)
    v[:, 1] = v[:, 0]
    patterns, n = np.unique(v, axis=0, return_counts=True)
    m = weak_toxicity.fit_label_model(patterns, n.astype(float))
    assert m.discount[0] > 1.5 and m.discount[1] > 1.5 and m.discount[4] < 1.5
    assert ((m.probability(v) >= 0.5) == toxic).mean() > 0.97


def brute_tree(train, depth):
    """Context-tree weighting node by node: {(context, bits): [zeros, ones]} and the recursion over them."""
    counts = {}
    for t in train:
        padded = bytes(depth) + t + b"\0"
        for i in range(depth, len(padded)):
            for d in range(depth + 1):
                for k in range(8):
                    bit = padded[i] >> (7 - k) & 1
                    counts.setdefault((padded[i - d : i], k, padded[i] >> (8 - k)), [0, 0])[bit] += 1
    def kt(z, o):
        return context_tree.log_kt(np.array([z]), np.array([o]))[0]
    memo = {}
    def weighted(node):
        if node not in memo:
            z, o = counts.get(node, (0, 0))
            c = node[0]
            if len(c) == depth or not z + o:
                memo[node] = kt(z, o)
            else:
                deeper = sum(weighted((bytes([b]) + c, *node[1:])) for b in range(256) if (bytes([b]) + c, *node[1:]) in counts)
                memo[node] = np.logaddexp(kt(z, o), deeper) - np.log(2)
        return memo[node]
    def score(t):
        padded, total = bytes(depth) + t + b"\0", 0.0
        for i in range(depth, len(padded)):
            for k in range(8):
                p, bit = None, padded[i] >> (7 - k) & 1
                for d in range(depth, -1, -1):
                    node = (padded[i - d : i], k, padded[i] >> (8 - k))
                    z, o = counts.get(node, (0, 0))
                    own = ((o if bit else z) + 0.5) / (z + o + 1)
                    share = 1.0 if d == depth else np.exp(kt(z, o) - np.log(2) - weighted(node)) if z + o else 0.0
                    p = own if p is None else share * own + (1 - share) * p
                total += np.log10(p)
        return total
    return score


def test_runs_are_looked_up_in_order_and_keys_gathered_by_sorting(monkeypatch):
    """No search in the model jumps about, and every place gets the value of its own run."""
    r = np.random.default_rng(3)
    key = np.unique(r.integers(0, 1 << 48, 5000))
    key[-1], value, search = (1 << 48) - 1, r.random(len(key)).astype(np.float32), np.searchsorted
    pick = r.integers(0, len(key), 150_000)  # more than two steps

    def ordered(table, wanted, *more):
        assert np.all(wanted[1:] >= wanted[:-1])
        return search(table, wanted, *more)

    monkeypatch.setattr(np, "searchsorted", ordered)
    assert np.array_equal(context_tree._run_scores(key, value, key[pick]), value[pick])
    assert len(context_tree._run_scores(key, value, key[:0])) == 0
    keys = context_tree._Keys()
    assert len(keys.total()) == 0
    for part in np.array_split(key[pick], 7):
        keys.add(part)
    assert np.array_equal(keys.total(), np.unique(key[pick]))


def test_context_tree_matches_brute_force(spark):
    texts = ["the cat sat", "The cat ran", None, "", "a cat été", "sat the cat", "dog", "the the the", "rat a tat", "cat"]
    got = {r.doc_id: r for r in context_tree.scored(spark.createDataFrame(rows(texts), SCHEMA)).collect()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in range(len(texts))}
    low = [(t or "").lower().encode() for t in texts]
    score = brute_tree([t for i, t in enumerate(low) if not held[i]], context_tree.DEPTH)
    words = [[*SPLIT.findall((t or "").lower()), None] for t in texts]
    c = Counter(w for i, ws in enumerate(words) if not held[i] for w in ws)
    n, v = sum(c.values()), len(c)
    for i in range(len(texts)):
        assert got[i].held_out == held[i] and got[i].n_tokens == len(words[i]) and got[i].train_tokens == n
        assert got[i].n_known == sum(w in c for w in words[i])
        assert abs(got[i].base_score - sum(np.log10((c[w] + 1) / (n + v + 1)) for w in words[i])) < 1e-9
        assert abs(got[i].score - score(low[i])) < 1e-4 * max(1, abs(got[i].score))


def test_log_gamma():
    from math import lgamma

    x = np.array([0.5, 1, 1.5, 7, 1000.5, 1e8])
    assert np.allclose(context_tree.log_gamma(x), [lgamma(v) for v in x], rtol=1e-12, atol=1e-9)


def test_pages():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><nav><ul><li><a href=x>Home</a></li></ul></nav>
    <div class="ad">Buy this, now. It is good.</div><div id="cookie-notice"><p>We use cookies, as all do.</p></div>
    <article><h1>A title</h1><p>First   <b>bold</b> text, with&nbsp;an &amp; sign.<p>Second<br>line, unclosed.<ul><li>an item</ul><script>var a = "</p>";</script></article>
    <form><p>Your name, please.</p></form><div class="comments"><p>A reader says that this is long, and good, and so on.</p></div>
    <aside>side</aside><footer>&copy; foot</footer></body></html>"""
    assert article(page) == "A title\nFirst bold text, with an & sign.\nSecond line, unclosed.\nan item"
    assert article(None) == article("") == article("<div></div>") == ""
    assert article("no tags, only text") == "no tags, only text"
    assert article("<a " * 50_000) != "" and article("<p>open <b>never closed") == "open never closed"


@pytest.mark.parametrize("name", ["svg", "math", "object", "select", "canvas", "audio", "video", "noscript", "template"])
def test_pages_go_on_after_elements_without_an_end(name):
    two, three = "<p>Two, of the text.</p>", "<p>Three, the end of it.</p>"
    want = "One, a start.\nTwo, of the text.\nThree, the end of it."
    for tag in (f"<{name} class='i'/>", f"<{name} class='i'>"):
        assert article(f"<article><p>One, a start.{tag}</p>{two}{three}</article>") == want
        assert article(f"<article><p>One, a start.</p>{tag}{two}{three}</article><footer>foot</footer>") == want
        inner = "x" if name == "math" else ""
        got = article(f"<article><p>One, {tag}a start.</p>{two}<p>Three, the <{name}>x</{name}>end of it.</p></article>")
        assert got.split() == want.replace("the end", f"the {inner}end").split()
    for raw in ("<title/>", "<style/>"):
        assert article(f"<article><p>One, a start.<svg>{raw}<path d='M0'/></svg></p>{two}{three}</article>") == want


def test_pages_keep_formulas_and_titles_as_ids():
    long = "Words that say something, at some length, and then more of it. They end here."
    page = f"""<body><article><h1 id="legal-basis">Title</h1><p>{long}</p><section id="social-impact"><h2 id="related-work">Two</h2><p>{long} Second.</p></section>
    <h3 id="side-effects">Three</h3><p>As <math><mi>a</mi><mo>=</mo><msup><mi>b</mi><mn>2</mn></msup></math> says.</p>
    <section id="related-links"><ul><li><a href=a>one</a></li><li><a href=b>two</a></li></ul></section><div id="comments"><p>{long} Third.</p></div></article></body>"""
    assert article(page) == f"Title\n{long}\nTwo\n{long} Second.\nThree\nAs a=b2 says."


def test_pages_without_telling_names_are_cut_by_ratio():
    long = "Words that say something, at some length, and then more of it, as texts do. They end here, after all."
    menu = "<ul>" + "".join(f"<li><a href=x>Link {i}</a></li>" for i in range(8)) + "</ul>"
    body = f"<h1>Title</h1><p>{long} 1.</p><p>{long} 2.</p><h2>Two</h2><p>Short.</p><ol><li>item</li></ol><p>{long} 3.</p><p>{long} 4.</p>"
    want = f"Title\n{long} 1.\n{long} 2.\nTwo\nShort.\nitem\n{long} 3.\n{long} 4."
    assert article(f"<body><div>{menu}</div><div>{menu}</div>{body}<div>{menu}</div><div>{menu}</div></body>") == want
    assert article(f"<article>{menu}{body}</article>").endswith(want)


def test_mix_reaches_targets(spark):
    r = random.Random(1)
    data = [(i, "w " * r.randrange(1, 60), "en", r.choice(["a"] * 8 + ["b", "c", None]), 0, "x", i, "k") for i in range(900)]
    data += [(9000, None, "en", "a", 0, "x", 0, "k"), (9001, "", "en", "only", 0, "x", 0, "k")]
    got = mixed(spark.createDataFrame(data, SCHEMA)).toPandas()
    total = got["size"].sum()
    assert (got.taken <= 3 * got["size"]).all() and (got.taken == got.copies * got["size"]).all()
    per = got.groupby(got.source.fillna("~")).agg(size=("size", "sum"), target=("target", "first"), taken=("taken", "sum"))
    assert abs(per.target.sum() - total) < 1e-6 * total and (per.target <= 3 * per["size"] + 1e-6).all()
    assert ((per.taken - per.target).abs() <= 120).all() and 0 <= total - per.taken.sum() <= 60
    again = mixed(spark.createDataFrame(list(reversed(data)), SCHEMA)).toPandas()
    assert sorted(zip(got.doc_id, got.taken)) == sorted(zip(again.doc_id, again.taken))


def turns(spark, data):
    return spark.createDataFrame(data, "conv_id long, turn long, role string, text string")


def test_preferences(spark):
    good = turns(spark, [(1, 0, "user", "q"), (1, 1, "assistant", "yes <|end|>"), (1, 2, "user", "more"), (2, 0, "user", "same"), (3, 0, None, None), (None, 0, "user", "x"), (4, 0, "user", "only here")])
    bad = turns(spark, [(1, 0, "user", "q"), (1, 1, "assistant", "no"), (2, 0, "user", "same"), (3, 0, "user", "other")])
    got = {r.conv_id: r for r in preference_pairs(good, bad).collect()}
    assert set(got) == {1, 2, 3}
    a = got[1]
    assert a.n_common == 1 and a.prompt == "<|user|>\nq<|end|>\n"
    assert a.chosen == "<|assistant|>\nyes <\\|end|><|end|>\n<|user|>\nmore<|end|>\n"
    assert [a.chosen[s.begin : s.end] for s in a.chosen_spans] == ["yes <\\|end|><|end|>\n"]
    assert [a.rejected[s.begin : s.end] for s in a.rejected_spans] == ["no<|end|>\n"]
    assert (got[2].n_common, got[2].chosen, got[2].chosen_spans) == (1, "", [])
    assert (got[3].n_common, got[3].prompt) == (0, "")
    none = turns(spark, [])
    assert preference_pairs(none, none).count() == 0 and next_reply(none).count() == 0


def test_next_reply_replaces_exactly_one_row_on_ties(spark, tmp_path):
    data = [(1, 0, "user", "q"), (1, 1, "assistant", "a"), (1, 1, "assistant", "m"), (1, 1, "assistant", "m"), (1, 1, "assistant", "m")]
    data += [(2, 0, "user", "x"), (2, 4, "Assistant", "zz"), (2, 4, "assistant", "b"), (3, 0, "user", "y"), (3, 1, "assistant", "z"), (4, 0, "assistant", "k"), (4, 0, "user", "end")]
    good = turns(spark, data)
    bad = sorted((r.conv_id, r.turn, r.role, r.text) for r in next_reply(good).collect())
    assert [r[3] for r in bad if r[0] == 1] == ["q", "a", "m", "m", "b"] and [r[3] for r in bad if r[0] == 2] == ["x", "zz", "z"]
    assert bad[8:] == [(3, 0, "user", "y"), (3, 1, "assistant", "m")]
    good.write.parquet(f"{tmp_path}/conversations.parquet")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    name = "op10_preference_pairs"
    assert normal(catalog.QUERIES[name](spark, str(tmp_path)).toPandas()) == normal(c.execute(catalog.ORACLES[name]).df())


def test_awkward_and_empty_tables(spark):
    bench = spark.createDataFrame([(1, "w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w11 w12 w13"), (None, None)], "item_id long, text string")
    labels = spark.createDataFrame([(0, 1, 0), (3, None, 1), (None, 1, 1), (4, 0, 1), (4, 1, 0)], "doc_id long, quality int, toxic int")
    for docs in (awkward(spark), empty(spark)):
        n = docs.count()
        assert substring_dedup.remove_repeats(docs).count() == n
        assert substring_dedup.without_repeats(docs).columns == docs.columns
        near = parity_join.near_duplicates(docs).collect()
        assert len(near) == n and all(r.component_id == r.doc_id for r in near if not r.n_shingles)
        assert parity_join.one_of_each(docs).columns == docs.columns
        assert overlaps(docs, bench).columns[:2] == ["doc_id", "item_id"]
        assert overlaps(docs, bench.limit(0)).count() == 0 and decontaminated(docs, bench).columns == docs.columns
        assert quality_rules.judged(docs, quality_rules.fit_rules(docs)).count() == n
        assert boosted_quality.scored(docs, boosted_quality.fit_quality(docs, labels)).filter("score between 0 and 1").count() == n
        assert weak_toxicity.scored(docs, weak_toxicity.fit_toxicity(docs, labels)).filter("score between 0 and 1").count() == n
        assert weak_toxicity.scored(docs, weak_toxicity.fit_toxicity(docs, labels.limit(0))).count() == n
        assert context_tree.scored(docs).count() == n
        assert mixed(docs).count() == n and mixed_documents(docs).columns[:5] == docs.columns[:5]
    pages = spark.createDataFrame([(1, "u", None, "x"), (None, None, "", "x"), (1, "u", "<p>a, b.</p>", "x")], "page_id long, url string, html string, text string")
    assert sorted(r.text for r in extracted(pages).collect()) == ["", "", "a, b."]
    assert extracted(pages.limit(0)).count() == 0


def test_repeated_rows_are_copies(spark):
    docs = awkward(spark)
    near = parity_join.near_duplicates(docs).filter("doc_id = 4").collect()
    assert len(near) == 2 and {r.component_id for r in near} == {4}
    assert parity_join.one_of_each(docs).filter("doc_id = 4").count() == 1
    gone = {(r.doc_id, r.n_removed) for r in substring_dedup.remove_repeats(docs).collect() if r.n_removed}
    assert {(4, 120), (5, 120), (None, 120)} <= gone


def test_pipeline_equals_brute_force(spark):
    sf = SF
    docs = pd.read_parquet(f"{sf}/documents.parquet")
    table = spark.read.parquet(f"{sf}/documents.parquet")
    kept = {r.doc_id for r in quality_rules.judged(table, quality_rules.fit_rules(table)).filter("kept").collect()}
    docs = docs[docs.doc_id.isin(kept)].sort_values("doc_id").reset_index(drop=True)
    alone = [c == i for i, (_, c) in enumerate(brute_components(docs.text))]
    docs = docs[alone].reset_index(drop=True)
    left = brute_repeats(docs.text, 35)
    docs["words"] = [SPLIT.findall(x[2]) for x in left]
    docs = docs[docs.words.map(len) > 0]
    items = [SPLIT.findall(t.lower()) for t in pd.read_parquet(f"{sf}/benchmark.parquet").text]
    def leaks(w):
        text = " ".join(w).lower()
        return any(" ".join(i) in text for i in items)
    exact = docs[docs.words.map(leaks)]
    out = corpus_pipeline.run(spark, sf).toPandas()
    assert not set(out.doc_id) & set(exact.doc_id) and set(out.doc_id) <= set(docs.doc_id) - set(exact.doc_id)
    words = dict(zip(docs.doc_id, docs.words, strict=True))
    assert all(SPLIT.findall(t) == words[i] for i, t in zip(out.doc_id, out.text, strict=True))
    assert (out.taken == out.copies * out.text.map(lambda t: len(SPLIT.findall(t)))).all() and (out.copies <= 3).all()
    assert list(out.columns) == ["doc_id", "text", "lang", "source", "n_chars", "taken", "copies"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")
@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_matches_sql(spark, con, name):
    assert normal(catalog.QUERIES[name](spark, SF).toPandas()) == normal(con.execute(catalog.ORACLES[name]).df())


def test_digest_is_of_the_kept_words(spark):
    out = catalog.QUERIES["op9_substring_dedup"](spark, SF).toPandas().set_index("doc_id")
    docs = pd.read_parquet(f"{SF}/documents.parquet")
    want = {i: hashlib.sha256(k[2].encode()).hexdigest() for i, k in zip(docs.doc_id, brute_repeats(docs.text, 35), strict=True)}
    assert out.kept_sha256.to_dict() == want
