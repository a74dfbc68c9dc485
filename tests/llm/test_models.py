"""Held-out accuracy of the two trained models, and their edge cases."""

import random
import time

import numpy as np
import pytest

from lattica.llm import bytecnn, crf, dom

from .pages import PAGES, labelled


def samples(n, seed):
    r = random.Random(seed)
    base = ["lorem", "ipsum", "dolor", "sit", "amet", "élan", "für", "más", "the", "and", "of"]
    out = []
    for _ in range(n):
        w = [r.choice(base) + r.choice(["", "a", "er"]) for _ in range(r.randint(20, 400))]
        kind = r.random()
        y = 1
        if kind < 0.2:
            y, w = 0, [x + r.choice(["***", "%%%", "&&&"]) for x in w]
        elif kind < 0.4:
            y = 0
            for _ in range(max(2, len(w) // 25)):
                w.insert(r.randrange(len(w)), r.choice(["grobnik", "zwurl"]))
        out.append((" ".join(w), y))
    return out


@pytest.fixture(scope="module")
def model():
    x = samples(400, 1)
    return bytecnn.train([t for t, _ in x], [y for _, y in x], steps=300)


def test_held_out_accuracy(model):
    x = samples(300, 2)
    p = model.score([t for t, _ in x])
    y = np.array([y for _, y in x])
    assert ((p >= model.threshold) == y).mean() > 0.95


def test_whole_text_counts(model):
    """Bad words at the very end of a long text are seen."""
    good = samples(400, 3)
    good = " ".join(t for t, y in good if y)[:60_000]
    bad = good + " " + " ".join(["grobnik zwurl"] * 12)
    a, b = model.score([good, bad])
    assert b < a


def test_gradients():
    """Against differences of the loss."""
    m = bytecnn.Model.fresh(1)
    chunks, first = bytecnn.chunked(["hello world, this is a text", "another one " * 80, "x"])
    y = np.array([1, 0, 1], np.float32)
    grads, _ = bytecnn._gradients(m, chunks, first, y)
    for part, g in list(zip(m.parts(), grads, strict=True))[1:]:
        i = np.unravel_index(np.abs(g).argmax(), g.shape)
        old, eps, loss = part[i], 1e-3, []
        for d in (eps, -eps):
            part[i] = old + d
            loss.append(bytecnn._gradients(m, chunks, first, y)[1])
        part[i] = old
        assert abs((loss[0] - loss[1]) / (2 * eps) - g[i]) < 0.02 * max(0.05, abs(g[i]))


def test_pooling_equals_plain_convolution():
    m = bytecnn.Model.fresh(2)
    chunks, _ = bytecnn.chunked(["some text of bytes é " * 60])
    got, at = m.pool(chunks, where=True)
    n = chunks.shape[1] - bytecnn.SPAN + bytecnn.BLOCK
    for c in range(len(chunks)):
        x = m.embed[chunks[c]]
        y = np.stack([np.einsum("we,wef->f", x[i : i + bytecnn.WIDTH], m.filters) for i in range(n)])
        assert np.allclose(y.max(0), got[c], atol=1e-4)
    covered = np.zeros(len("some text of bytes é " * 60) * 2, bool)
    for c in range(len(chunks)):
        covered[c * bytecnn.STRIDE : c * bytecnn.STRIDE + n] = True
    assert covered[: len(("some text of bytes é " * 60).encode()) - bytecnn.WIDTH].all()


def test_long_texts_in_parts(model, monkeypatch):
    """A text scored some chunks at a time has the probability of one that is laid out at once."""
    texts = [t * n for n in (1, 7, 40) for t, _ in samples(4, 9)] + ["", "x" * bytecnn.CHUNK, None]
    at_once = model.score(texts)
    monkeypatch.setattr(bytecnn, "MEMORY", 10 * bytecnn.STRIDE)
    assert np.abs(model.score(texts) - at_once).max() < 1e-5


def test_classifier_edges(spark, model):
    docs = spark.createDataFrame([(1, None, 1), (2, "", 2), (None, "lorem ipsum dolor sit amet " * 20, 3), (4, "lorem ipsum dolor sit amet " * 30_000, 4), (4, "lorem ipsum dolor sit amet " * 20, 4)], "doc_id long, text string, p_accept int")
    got = bytecnn.score(docs, model).collect()
    assert [r.p_accept for r in got if r.doc_id in (1, 2)] == [0.0, 0.0] and len(got) == 5
    kept = bytecnn.keep_good(docs, model)
    assert kept.columns == docs.columns and {r.p_accept for r in kept.collect()} == {3, 4}
    assert bytecnn.keep_good(docs.limit(0), model).count() == 0
    labels = spark.createDataFrame([(4, 1, None, "a"), (4, 0, 0, "b"), (None, 1, 0, "c"), (2, 1, 0, "d"), (9, 1, 1, "e"), (1, None, 0, "f")], "doc_id long, quality int, toxic int, text string")
    texts, y = bytecnn.sample(docs, labels)
    assert len(texts) == 1 and y == [0]
    assert bytecnn.train([], []).score(["a", "", None]).tolist() == [1.0, 0.0, 0.0]
    assert bytecnn.train(["a"], [0]).score(["a"]).tolist() == [0.0]


def test_crf_held_out():
    m = crf.train(crf.labelled_pages(150), steps=100)
    right = total = 0
    for html, y in crf.labelled_pages(80, 77):
        got = m.decode([crf.features(dom.blocks(html))])[0]
        right, total = right + (got == np.array(y)).sum(), total + len(y)
    assert right / total > 0.97


def test_crf_on_pages_labelled_by_hand():
    """Pages without <article> in layouts that the training pages do not have: all content is kept, and little else."""
    m = crf.train(crf.labelled_pages())
    right = total = 0
    for page in PAGES:
        html, y = labelled(page)
        assert "<article" not in html
        got = m.decode([crf.features(dom.blocks(html))])[0]
        assert all(a for a, b in zip(got, y, strict=True) if b)
        right, total = right + (got == np.array(y)).sum(), total + len(y)
    assert right / total > 0.93


def test_crf_likelihood_and_viterbi_equal_enumeration():
    r = np.random.default_rng(4)
    m = crf.Model(r.normal(size=crf.FEATURES), r.normal(size=(2, 2)), 0.3)
    pages = [r.normal(size=(n, crf.FEATURES)) for n in (1, 4, 6)]

    def score(x, y):
        s = m.start * y[0] + sum((x[i] @ m.weights) * y[i] for i in range(len(x)))
        return s + sum(m.step[y[i], y[i + 1]] for i in range(len(x) - 1))

    paths = [[tuple(int(b) for b in f"{i:0{len(x)}b}") for i in range(2 ** len(x))] for x in pages]
    for x, p, got in zip(pages, paths, m.decode(pages), strict=True):
        assert tuple(got) == max(p, key=lambda y: score(x, y))
    gold = [p[len(p) // 3] for p in paths]
    want = np.mean([score(x, y) - np.logaddexp.reduce([score(x, z) for z in p]) for x, y, p in zip(pages, gold, paths, strict=True)])
    ll, gw, gs, g0 = crf.log_likelihood(m, pages, [np.array(y) for y in gold])
    assert abs(ll - want) < 1e-9
    for eps in (1e-5,):
        m.weights[3] += eps
        assert abs((crf.log_likelihood(m, pages, [np.array(y) for y in gold])[0] - ll) / eps - gw[3]) < 1e-3
        m.weights[3] -= eps
        m.step[0, 1] += eps
        assert abs((crf.log_likelihood(m, pages, [np.array(y) for y in gold])[0] - ll) / eps - gs[0, 1]) < 1e-3
        m.step[0, 1] -= eps
        m.start += eps
        assert abs((crf.log_likelihood(m, pages, [np.array(y) for y in gold])[0] - ll) / eps - g0) < 1e-3


def test_dom_blocks():
    b = dom.blocks("<head><title>no</title></head>out<div class='A b'>x <b>y</b><p>one<p>two <a href='>'>link</a></div><!-- no --><script>no</script><ul><li>1<li>2</ul>&lt;end")
    assert [x.text for x in b] == ["out", "x y", "one", "two link", "1", "2", "<end"]
    assert b[1].tags == ("div",) and b[2].tags == ("div", "p") and b[3].tags == ("div", "p") and b[1].names == "a b"
    assert b[3].linked == 4 and b[4].tags == ("ul", "li") == b[5].tags and b[6].tags == ()
    assert [x.text for x in dom.blocks("<p>a < b and c<p")] == ["a < b and c<p"]
    assert dom.blocks(None) == dom.blocks("") == dom.blocks("<div></div><!--") == []


@pytest.mark.parametrize("html", ["<p " + "a" * 1_000_000 + "<b>x</b>", "<script" * 100_000, "<!" * 200_000, '<p "' * 100_000, "<!--" * 100_000, "<div>" * 50_000 + "x", "</p>" * 50_000])
def test_malformed_pages_take_no_time(html):
    """Tags without end, in texts that a backtracking pattern would never get through."""
    begin = time.monotonic()
    dom.blocks(html)
    assert time.monotonic() - begin < 10


def test_unfinished_tails():
    show = lambda h: [b.text for b in dom.blocks(h)]
    assert show("<p>a</p><!-- x > y") == ["a"] and show("<p>a</p>tail <b") == ["a", "tail <b"] and show("<p>a<script>x>1;") == ["a"] and show("<p>a</p>t<!-- c") == ["a", "t"]
    assert max(len(b.tags) for b in dom.blocks("<div>x" * 600)) == dom.DEPTH


def test_extraction_edges(spark):
    m = crf.train(crf.labelled_pages(100), steps=60)
    page = "<nav><a>x</a></nav><article><p>A sentence, long enough to be read as text by anyone.</p></article>"
    pages = spark.createDataFrame([(1, None, 0), (2, "", 0), (None, page, 0), (3, page * 3000, 0), (3, page, 0), (4, "<b><", 0)], "page_id long, html string, text int")
    got = {}
    for r in crf.extract(pages, m).collect():
        got.setdefault(r.page_id, []).append(r)
    assert got[1][0].n_blocks == got[2][0].n_blocks == 0 and got[1][0].text == ""
    assert "A sentence" in got[None][0].text and len(got[3]) == 2 and max(r.n_blocks for r in got[3]) >= 3000
    assert crf.extract(pages.limit(0), m).count() == 0
