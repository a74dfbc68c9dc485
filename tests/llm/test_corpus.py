"""Mixing, sharding, the pipeline and the registered queries."""

import functools
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import corpus_pipeline
from lattica.llm import bytecnn, mixing, queries, shards
from lattica.llm._text import split_words

from .test_dedup import brute_groups, brute_spans

SMALL = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, source string, _s string, epoch int, shard_id string"


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "y") for r in rows], SCHEMA)


# Mixing


@given(st.lists(st.integers(1, 10**6), min_size=1, max_size=20), st.floats(0.1, 1.0), st.floats(1.0, 8.0))
@settings(deadline=None)
def test_exponent(tokens, entropy, repeats):
    a = mixing.exponent(tokens, sum(tokens), entropy, repeats)
    raw = [(t / sum(tokens)) ** a for t in tokens]
    w = [x / sum(raw) for x in raw]
    h = -sum(x * math.log(x) for x in w)
    most = max(x * sum(tokens) / t for x, t in zip(w, tokens, strict=True))
    assert 0 <= a <= 1 and most <= repeats * (1 + 1e-9)
    if most < repeats * (1 - 1e-6) and a < 1:
        assert abs(h - entropy * math.log(len(tokens))) < 1e-6


def brute_draws(rows, **options):
    """(doc_id, source, epoch) by sorting every epoch."""
    import hashlib

    o = mixing.OPTIONS | options
    count = lambda t: len((t or "").replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ")) - (t or "").replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ").count("")
    by = defaultdict(list)
    for i, t, s in rows:
        by[s].append((i, count(t)))
    by = {s: x for s, x in by.items() if sum(n for _, n in x)}
    plan, _ = mixing._plan(sorted(((s, sum(n for _, n in x)) for s, x in by.items()), key=lambda x: (x[0] is not None, x[0] or "")), o["budget"], o["entropy"], o["repeats"])
    out = []
    for p in plan:
        whole, rest = divmod(p["budget"], p["tokens"])
        for e in range(whole + 1):
            block = lambda i: i // o["block"]
            key = lambda i: hashlib.md5(f"{o['seed']}:{e}:{p['source'] or ''}:{block(i)}".encode()).hexdigest()[:16]  # noqa: E731, B023
            sofar = 0
            for i, n in sorted(by[p["source"]], key=lambda x: (key(x[0]), block(x[0]), x[0])):
                if e == whole and sofar >= rest:
                    break
                out.append((i, p["source"], e))
                sofar += n
    return sorted(out, key=repr)


@pytest.mark.parametrize("options", [{}, {"budget": 5000, "block": 4}, {"entropy": 1.0, "repeats": 1.5, "block": 1}, {"budget": 1}])
def test_draws_equal_brute_force(spark, options):
    r = random.Random(2)
    rows = [(i, " ".join(["w"] * r.randrange(0, 40)), r.choice(["a", "a", "a", "a", "b", "c", None])) for i in range(400)]
    docs = table(spark, rows)
    want = brute_draws(rows, **options)
    assert sorted(((x.doc_id, x.source, x.epoch) for x in mixing.draws(docs, **options).collect()), key=repr) == want
    mixed = mixing.mix(docs, **options)
    assert mixed.columns == docs.columns
    assert Counter(x.doc_id for x in mixed.collect()) == Counter(i for i, _, _ in want)


def test_mixing_edges(spark):
    rows = [(None, "a b", "s"), (1, None, "s"), (1, "x y z", "s"), (1, "x y z", "s"), (2, "", "only blanks"), (3, "q " * 50_000, None), (-5, "neg", "s")]
    docs = table(spark, rows)
    got = mixing.mix(docs).collect()
    assert len(got) >= 3 and "only blanks" not in {r.source for r in got}
    assert mixing.mix(docs.limit(0)).count() == 0 and mixing.draws(docs.where("text = ''")).count() == 0
    much = Counter(r.doc_id for r in mixing.mix(table(spark, [(1, "a b", "s"), (2, "c", "t")]), budget=10_000).collect())
    assert max(much.values()) == mixing.REPEATS  # a budget beyond all repeats
    one = mixing.mix(table(spark, [(i, "a b", "s") for i in range(10)]))
    assert sorted(r.doc_id for r in one.collect()) == list(range(10))


# Sharding


def brute_capacity(sizes, n):
    low, high = max(sizes), sum(sizes)

    def parts(c):
        k, fill = 1, 0
        for x in sizes:
            if fill + x > c:
                k, fill = k + 1, 0
            fill += x
        return k

    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if parts(mid) <= n else (mid + 1, high)
    return low


def ladder(sums, grains, finer, seen=None):
    """A Ladder over an array, as the table answers it."""

    def ask(windows, width):
        own = sums[sums > 0] if windows is None else np.concatenate([sums[np.searchsorted(sums, a) : np.searchsorted(sums, b, "right")] for a, b in windows])
        cut = np.flatnonzero(np.diff(own // width)) + 1
        out = np.stack([own[np.concatenate(([0], cut))], own[np.concatenate((cut - 1, [len(own) - 1]))]], 1)
        if seen is not None:
            seen.append(len(out))
        return out

    return shards.Ladder(ask, int(sums[-1]), grains, finer)


@given(st.lists(st.integers(0, 50), min_size=1, max_size=60), st.integers(1, 12), st.integers(1, 40), st.integers(2, 5))
@settings(deadline=None)
def test_smallest_capacity(sizes, n, grains, finer):
    if not sum(sizes):
        return
    cap, ends = shards.smallest(ladder(np.cumsum(sizes), grains, finer), n, max(sizes))
    assert cap == brute_capacity(sizes, n) and len(ends) <= n and max(np.diff([0, *ends])) <= cap


def test_what_the_driver_fetches_is_bounded():
    """Two million groups, one of them large: far fewer sums than groups are asked for, at most about 2000 stretches at a time after the first."""
    sizes = np.random.default_rng(1).integers(1, 4000, 2_000_000)
    sizes[777_777] = 3_000_000_000
    seen = []
    cap, ends = shards.smallest(ladder(np.cumsum(sizes), 4096, 16, seen), 64, int(sizes.max()))
    assert cap == brute_capacity_of(np.cumsum(sizes), 64, int(sizes.max())) and len(ends) <= 64
    assert seen[0] <= 4096 + 1 and max(seen[1:], default=0) < 40_000 and sum(seen) < 500_000


def brute_capacity_of(sums, n, largest):
    """brute_capacity by running sums."""
    def parts(c):
        k = at = 0
        while at < sums[-1]:
            at = sums[np.searchsorted(sums, at + c, "right") - 1]
            k += 1
        return k

    low = max(largest, -(-int(sums[-1]) // n))
    high = low + largest
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if parts(mid) <= n else (mid + 1, high)
    return low


@pytest.mark.parametrize("grains", [shards.GRAINS, 8])
def test_assign(spark, grains):
    r = random.Random(9)
    rows = [(r.randrange(150), "ü" * r.randrange(30), "s") for _ in range(300)]
    docs = table(spark, rows)
    got = shards.assign(docs, 7, grains=grains, finer=3)
    assert set(got.columns) == set(docs.columns)
    size, place = Counter(), {}
    for x in got.collect():
        size[x.shard_id] += len(x.text.encode())
        assert place.setdefault(x.doc_id, x.shard_id) == x.shard_id
    by = Counter()
    for i, t, _ in rows:
        by[i] += len(t.encode())
    assert max(size.values()) <= brute_capacity([by[i] for i in sorted(by)], 7)
    order = [place[i] for i in sorted(place)]
    assert order == sorted(order) and set(order) <= set(range(7))


def test_assign_edges(spark):
    rows = [(None, "abc", "s"), (None, "d", "s"), (1, None, "s"), (2, "", "s"), (3, "x" * 500_000, "s"), (4, "y", "s")]
    got = {(r.doc_id, r.text): r.shard_id for r in shards.assign(table(spark, rows), 3).collect()}
    assert got[None, "abc"] == got[None, "d"] == 0 and got[4, "y"] > got[3, "x" * 500_000]
    assert shards.assign(table(spark, []), 3).count() == 0
    assert {r.shard_id for r in shards.assign(table(spark, [(1, "", "s"), (2, None, "s")]), 3).collect()} == {0}


# Pipeline and queries


@pytest.fixture
def quick(monkeypatch):
    """A shorter training: these tests are about what follows from a model, whatever it is."""
    monkeypatch.setattr(bytecnn, "train", functools.partial(bytecnn.train, steps=120))


def test_pipeline_equals_brute_force(spark, quick):
    """Each stage by plain means on the kept documents of the one before."""
    docs = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    d, lab = spark.read.parquet(f"{SMALL}/documents.parquet"), spark.read.parquet(f"{SMALL}/labels.parquet")
    model = bytecnn.train(*bytecnn.sample(d, lab))
    kept = [x for x, p in zip(docs, model.score([t for _, t, _ in docs]), strict=True) if p >= model.threshold]
    assert 0 < len(kept) < len(docs)
    groups = brute_groups([(i, t) for i, t, _ in kept])
    kept = [x for x in kept if groups[x[0]] == x[0]]
    grams = {tuple(w[i : i + 8]) for _, t in items for w in [split_words(t)] for i in range(len(w) - 7)}
    dirty = {i for i, t, _ in kept for w in [split_words(t)] if any(tuple(w[j : j + 8]) in grams for j in range(len(w) - 7))}
    kept = [x for x in kept if x[0] not in dirty]
    drawn = brute_draws(kept)
    size = Counter()
    text = {i: t for i, t, _ in kept}
    for i, _, _ in drawn:
        size[i] += len((text[i] or "").encode())
    cap = brute_capacity([size[i] for i in sorted(size)], shards.SHARDS)
    shard, fill, at = {}, 0, 0
    for i in sorted(size):
        if fill + size[i] > cap:
            at, fill = at + 1, 0
        shard[i], fill = at, fill + size[i]
    got = corpus_pipeline.run(spark, SMALL).collect()
    assert Counter((r.doc_id, r.shard_id) for r in got) == Counter((i, shard[i]) for i, _, _ in drawn)


def test_stages_keep_columns(spark, quick):
    d = spark.read.parquet(f"{SMALL}/documents.parquet")
    for name, f in corpus_pipeline.STAGES[1:-1]:
        assert f(spark, d, SMALL).columns == d.columns, name
    assert corpus_pipeline.STAGES[-1][1](spark, d, SMALL).columns == [*d.columns, "shard_id"]


def plain_scores(m, texts):
    """The network over every byte of whole texts, chunk by chunk: embed, convolve, pool, combine, without any of its own methods."""
    out = []
    for t in texts:
        raw = (t or "").encode()
        most, total, n, at = np.zeros(bytecnn.HIDDEN), np.zeros(bytecnn.HIDDEN), 0, 0
        while raw:
            part = list(raw[at : at + bytecnn.CHUNK])
            part += [bytecnn.PAD] * (bytecnn.CHUNK - len(part))
            x = m.embed[part]
            windows = np.lib.stride_tricks.sliding_window_view(x, bytecnn.WIDTH, axis=0)[: bytecnn.CHUNK - bytecnn.SPAN + bytecnn.BLOCK]
            pooled = np.einsum("pew,wef->pf", windows, m.filters, optimize=True).max(0)
            h = np.maximum(np.maximum(pooled + m.bias, 0) @ m.dense + m.dense_bias, 0)
            most, total, n = np.maximum(most, h), total + h, n + 1
            if at + bytecnn.CHUNK - bytecnn.SPAN >= len(raw):
                break
            at += bytecnn.STRIDE
        z = most @ m.top[: bytecnn.HIDDEN] + total / max(n, 1) @ m.top[bytecnn.HIDDEN :] + m.top_bias[0]
        out.append(1 / (1 + math.exp(-z)) if raw else 0.0)
    return out


def test_queries_cover_whole_tables(spark, quick):
    """Queries without SQL, against brute force over the whole of the smallest tables."""
    d = spark.read.parquet(f"{SMALL}/documents.parquet")
    docs = [(r.doc_id, r.text) for r in d.collect()]
    assert {r.doc_id: r.group_id for r in queries.op9_minhash_dedup(spark, SMALL).collect()} == brute_groups(docs)
    lab = spark.read.parquet(f"{SMALL}/labels.parquet")
    model = bytecnn.train(*bytecnn.sample(d, lab))
    p = plain_scores(model, [t for _, t in docs])
    want = {i: x for (i, _), x in zip(docs, p, strict=True) if x >= model.threshold}
    got = {r.doc_id: r.p_accept for r in queries.op2_quality_classifier(spark, SMALL).collect()}
    assert set(got) == set(want) and all(abs(got[i] - want[i]) < 1e-4 for i in got)
    pages = {r.page_id: r for r in spark.read.parquet(f"{SMALL}/pages.parquet").collect()}
    got = {r.page_id: r for r in queries.op10_html_extraction(spark, SMALL).collect()}
    assert set(got) == set(pages)
    # what stands in <article> is the content of these pages
    from lattica.llm import dom

    for i, r in pages.items():
        assert got[i].text == "\n".join(b.text for b in dom.blocks(r.html) if "article" in b.tags)


def test_sql_agrees(spark):
    """Every query that has SQL, on the smallest tables."""
    import duckdb

    db = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "conversations"):
        db.execute(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    for name, sql in queries.ORACLE_SQL.items():
        a = queries.QUERIES[name](spark, SMALL)
        cols = sorted(a.columns)
        rows = sorted(repr(tuple(round(x, 6) if isinstance(x, float) else x for x in (r[c] for c in cols))) for r in a.collect())
        want = sorted(repr(tuple(round(float(x), 6) if type(x).__name__ in ("float", "Decimal") else x for x in r)) for r in db.execute(f"select {', '.join(cols)} from ({sql})").fetchall())
        assert rows == want, name


def test_spans_brute_force_on_tables(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect() if len(r.text) < 3000]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    ids = {i for i, _ in docs}
    got = {tuple(r) for r in queries.op3_decontamination(spark, SMALL).collect() if r.doc_id in ids}
    assert got == brute_spans(docs, items)
