"""MinHash groups and winnowing against brute force, and their edge cases."""

import random
from itertools import combinations

import numpy as np
import pytest

from lattica.llm import minhash, winnow
from lattica.llm._text import gram_hashes_of_words, grams, split_words, words

SCHEMA = "doc_id long, text string, _id string, group_id string, _bad string"


def table(spark, rows, schema=SCHEMA):
    return spark.createDataFrame([(*r, "x", "y", "z") for r in rows], schema)


def prose(r, n):
    return " ".join(r.choice(["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta", "theta", "iota", "kappa", "über", "mu"]) + str(r.randrange(40)) for _ in range(n))


def brute_groups(docs, threshold=minhash.THRESHOLD):
    sets = {}
    for i, t in docs:
        w = split_words(t)
        sets[i] = {tuple(w[j : j + 3]) for j in range(len(w) - 2)} or ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if (len(x & y) / len(x | y) if x | y else 1.0) >= threshold:
            a, b = sorted((find(a), find(b)))
            root[b] = a
    return {i: find(i) for i in sets}


@pytest.fixture(scope="module")
def near():
    r = random.Random(3)
    out = []
    for i in range(60):
        t = prose(r, r.choice([6, 30, 200]))
        out.append((len(out), t))
        for _ in range(r.choice([0, 0, 1, 3])):
            w = t.split()
            for _ in range(max(0, len(w) // 40)):
                w[r.randrange(len(w))] = "changed"
            out.append((len(out), " ".join(w)))
    return out


def test_groups_equal_brute_force(spark, near):
    got = {r.doc_id: r.group_id for r in minhash.groups(table(spark, near)).collect()}
    assert got == brute_groups(near)


def test_recall_near_the_threshold(spark):
    """Pairs of Jaccard 0.5 to 0.75: at least nine in ten are found."""
    r = random.Random(5)
    docs, pairs = [], []
    for i in range(150):
        t = prose(r, 120).split()
        cut = r.randrange(10, 35)
        u = t[:-cut] + prose(r, cut).split()
        docs += [(2 * i, " ".join(t)), (2 * i + 1, " ".join(u))]
        if minhash.jaccard(docs[-1][1], docs[-2][1]) >= minhash.THRESHOLD:
            pairs.append((2 * i, 2 * i + 1))
    got = {x.doc_id: x.group_id for x in minhash.groups(table(spark, docs)).collect()}
    assert len(pairs) > 50 and np.mean([got[a] == got[b] for a, b in pairs]) >= 0.9


def test_large_bucket_and_chains(spark):
    """Copies by the hundred, and a chain whose ends are not alike."""
    r = random.Random(7)
    base = prose(r, 60).split()
    docs = [(i, " ".join(base)) for i in range(300)]
    w = list(base)
    for step in range(8):
        w = w[6:] + prose(r, 6).split()
        docs.append((300 + step, " ".join(w)))
    got = {x.doc_id: x.group_id for x in minhash.groups(table(spark, docs)).collect()}
    assert got == brute_groups(docs)


def test_dedup_edges(spark):
    long = prose(random.Random(1), 60_000)
    rows = [(1, None), (2, ""), (3, " .. "), (4, "one two"), (5, "two one"), (6, "One, two!"), (None, "one two"), (None, None), (7, long), (8, long + " end"), (9, "same row here ok"), (9, "same row here ok")]
    docs = table(spark, rows)
    got = {r.doc_id: r.group_id for r in minhash.groups(docs).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 4, 7: 7, 8: 7, 9: 9}
    kept = minhash.dedup(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id is not None, r.doc_id or 0) for r in kept.collect()) == [(False, 0), (False, 0), (True, 1), (True, 4), (True, 5), (True, 7), (True, 9)]
    none = table(spark, [])
    assert minhash.groups(none).collect() == [] and minhash.dedup(none).collect() == []


def test_circulant_estimates_jaccard():
    """Shared coordinates of two signatures estimate their similarity."""
    c = minhash.Circulant(512)
    rng = np.random.default_rng(0)
    a = rng.integers(0, 2**63, 600).astype(np.uint64)
    b = np.concatenate((a[:400], rng.integers(0, 2**63, 200).astype(np.uint64)))
    sig = c(np.concatenate((a, b)), np.array([0, 600, 1200]))
    assert abs((sig[0] == sig[1]).mean() - 400 / 800) < 0.08


def test_vectorised_words_equal_plain_ones():
    texts = ["Hello, World_1 ünd ß!", None, "", "a  b\tc\0d", "ÀÉ x" * 50]
    w = words(texts)
    for i, t in enumerate(texts):
        assert w.first[i + 1] - w.first[i] == len(split_words(t))
        k, _, _ = grams(words([t]), 3)
        assert gram_hashes_of_words(words([t]).hash, 3) == k.tolist()
    assert words(["ab"]).hash[0] == words(["x ab y"]).hash[1] != words(["ba"]).hash[0]


def brute_spans(docs, items, least=winnow.K + winnow.WINDOW - 1):
    out = set()
    for i, t in docs:
        a = split_words(t)
        for j, u in items:
            b = split_words(u)
            for p in range(len(a)):
                for q in range(len(b)):
                    if a[p] == b[q] and not (p and q and a[p - 1] == b[q - 1]):
                        n = 0
                        while p + n < len(a) and q + n < len(b) and a[p + n] == b[q + n]:
                            n += 1
                        if n >= least:
                            out.add((i, j, p, q, n))
    return out


def test_spans_equal_brute_force(spark):
    r = random.Random(11)
    vocabulary = [f"w{i}" for i in range(12)]
    text = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    items = [(j, text(r.randint(3, 30))) for j in range(8)]
    docs = []
    for i in range(40):
        own = text(r.randint(0, 40))
        if i % 2:
            own += " " + " ".join(r.choice(items)[1].split()[: r.randint(5, 20)]) + " " + text(5)
        docs.append((i, own))
    bench = spark.createDataFrame(items, "item_id long, text string")
    for limit in (winnow.BROADCAST_ROWS, 0):
        got = {tuple(x) for x in winnow.spans(table(spark, docs), bench, broadcast_rows=limit).collect()}
        assert got == brute_spans(docs, items)


def test_every_window_has_a_fingerprint():
    rng = np.random.default_rng(2)
    h = rng.integers(0, 50, 500).astype(np.uint64)
    doc = np.sort(rng.integers(0, 20, 500))
    at = winnow.winnow(h, doc, 4)
    for d in range(20):
        own = np.flatnonzero(doc == d)
        for i in range(max(0, len(own) - 3)):
            assert np.isin(own[i : i + 4], at).any()


def test_decontamination_edges(spark):
    item = "one two three four five six seven eight nine ten"
    rows = [(1, None), (2, ""), (3, item), (4, item.upper()), (5, "one two three four five six seven"), (None, item), (6, "x " * 50_000 + item), (7, "clean"), (7, "clean")]
    docs = table(spark, rows)
    bench = spark.createDataFrame([(1, item, "q"), (1, "zzz", "q"), (2, None, None), (3, "", ""), (None, item, "n")], "item_id long, text string, _text string")
    got = {(r.doc_id, r.n_words) for r in winnow.spans(docs, bench).collect()}
    assert got == {(3, 10), (4, 10), (6, 10)}
    kept = winnow.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "2", "5", "7", "7"]
    assert winnow.drop_contaminated(docs, bench.limit(0)).count() == len(rows)
    assert winnow.spans(docs.limit(0), bench).count() == 0


def test_decontamination_of_repeated_ids(spark):
    """Rows of one doc_id with different texts: a short clean one and a long contaminated one, either the smallest."""
    item = "one two three four five six seven eight nine ten"
    rows = [(1, "a clean text"), (1, "z " * 500 + item), (2, "zz clean"), (2, "a " * 300 + item), (3, None), (3, item), (4, "clean"), (4, "clean")]
    docs = table(spark, rows)
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    for limit in (winnow.BROADCAST_ROWS, 0):
        got = {(r.doc_id, r.doc_start, r.item_start, r.n_words) for r in winnow.spans(docs, bench, broadcast_rows=limit).collect()}
        assert got == {(2, 300, 0, 10), (3, 0, 0, 10)}
        kept = winnow.drop_contaminated(docs, bench, broadcast_rows=limit)
        assert kept.columns == docs.columns
        assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr) == sorted([(1, "a clean text"), (2, "zz clean"), (3, None), (4, "clean"), (4, "clean")], key=repr)
    # a hit of q > 0 beyond the smallest text
    tail = table(spark, [(1, "clean"), (1, "z " * 500 + item.split(" ", 1)[1])])
    assert winnow.spans(tail, bench).count() == 0 and winnow.drop_contaminated(tail, bench).count() == 1


def test_dedup_of_repeated_ids(spark):
    """The smallest text stands for a repeated doc_id: it is signed, compared and kept, whichever row has the smallest keys."""
    r = random.Random(13)
    rows, want, left = [], {}, []
    for i in range(40):
        low, high = "a " + prose(r, 40), "z " + prose(r, 40)
        rows += [(i, low), (100 + i, high), (100 + i, low + " end"), (200 + i, high)] if i % 2 else [(i, low), (100 + i, low + " end"), (100 + i, high), (200 + i, high)]
        want |= {i: i, 100 + i: i, 200 + i: 200 + i}
        rows += [(300 + i, high + " own " + prose(r, 60)), (300 + i, "a own " + prose(r, 60)), (300 + i, None)]
        want[300 + i] = 300 + i
        left += [(i, low), (200 + i, high), (300 + i, rows[-2][1])]
    docs = table(spark, rows)
    assert {x.doc_id: x.group_id for x in minhash.groups(docs).collect()} == want
    assert sorted((x.doc_id, x.text) for x in minhash.dedup(docs).collect()) == sorted(left)


def test_every_benchmark_text_filters(spark):
    """Benchmark rows without item_id, and other texts of a repeated one, are searched too."""
    first, second, third = (" ".join(f"{x}{i}" for i in range(10)) for x in "abc")
    bench = spark.createDataFrame([(1, first), (1, second), (None, third), (3, None), (None, "")], "item_id long, text string")
    docs = table(spark, [(1, f"x {first}"), (2, f"x {second} y"), (3, f"{third} z"), (4, "clean"), (None, third)])
    for limit in (winnow.BROADCAST_ROWS, 0):
        assert sorted(str(r.doc_id) for r in winnow.drop_contaminated(docs, bench, broadcast_rows=limit).collect()) == ["4"]
    assert {(r.doc_id, r.item_id) for r in winnow.spans(docs, bench).collect()} == {(1, 1)}
