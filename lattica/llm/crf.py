"""Operator 10: HTML extraction by a linear-chain conditional random field.

The leaf blocks of a page's DOM are a sequence; each is main content or
boilerplate. Features are the ancestor tags (and telling words in their classes
and ids), and the text's length, words, punctuation, links, digits and case,
also those of the blocks before and after. Weights of features and transitions
are found by maximum likelihood (forward-backward, gradient ascent with Adam) on
labelled pages; a page is decoded by Viterbi, and its text is that of its content
blocks, a line each.

Training pages. No table has labelled pages, so `labelled_pages` writes
`TRAIN_PAGES` pages of several layouts whose labels are known; `train` takes any
others. Class and id names are informative in some layouts only, and some have no
semantic elements at all, so that no single feature decides.

Defined results. A null, empty or text-less page has no block and an empty text.
Of equally likely labellings the one with boilerplate wins at the last place
where they differ. Malformed HTML is read as `dom` says; text outside any element
is a block. Repeated rows are extracted each; page_id may be null; other columns
are never read; an empty table gives an empty result.

Scale. One pass without shuffle; the model is a few hundred numbers.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache
from math import log1p

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _store
from .dom import Block, blocks

TRAIN_PAGES, STEPS, RATE, SEED, L2 = 400, 150, 0.1, 5, 1e-3
_TAGS = "article main section div nav header footer aside ul ol li dl table td th p h1 h2 h3 h4 h5 h6 blockquote pre form figure figcaption address".split()
_AT = {t: i for i, t in enumerate(_TAGS)}
_BAD = re.compile(r"\b(?:ads?|advert\w*|promo\w*|sponsor\w*|banner|side(?:bar)?|menu|nav\w*|breadcrumb\w*|share|social|related|cookie\w*|comments?|login|subscribe|newsletter|foot\w*|widget|pagination|tags?)\b")
_GOOD = re.compile(r"\b(?:content|article\w*|post|entry|story|main|text|body)\b")
_DIGIT, _MARK = re.compile("[0-9]"), re.compile("[©|»·®]")
_BASE = len(_TAGS) * 2 + 18
#: Own features, the text features of both neighbours, and the constant.
_TEXT = 14
FEATURES = _BASE + 2 * _TEXT + 1


@lru_cache(4096)
def _ancestors(tags: tuple[str, ...], names: str) -> tuple[list[int], tuple[bool, bool]]:
    """Columns of the ancestor tags and of the innermost one; whether names tell of boilerplate and of content."""
    on = sorted({_AT[x] for x in tags if x in _AT})
    if tags and tags[-1] in _AT:
        on.append(len(_TAGS) + _AT[tags[-1]])
    return on, (bool(_BAD.search(names)), bool(_GOOD.search(names)))


def features(page: Sequence[Block]) -> np.ndarray:
    """A row of features for each block."""
    n = len(page)
    out = np.zeros((n, FEATURES), np.float32)
    t = 2 * len(_TAGS)
    rows, columns, values = [], [], []
    for i, b in enumerate(page):
        on, named = _ancestors(b.tags, b.names)
        rows += [i] * len(on)
        columns += on
        text = b.text
        size, n_words = len(text), text.count(" ") + 1
        first = text[0]
        digits = 0 if size < 2 or not _DIGIT.search(text) else sum(map(text.count, "0123456789"))
        values.append((
            min(1.0, log1p(n_words) / 6), n_words < 4, 4 <= n_words < 12, 12 <= n_words < 40, n_words >= 40,
            b.linked / size, b.linked * 2 > size, text[-1] in ".!?:;…。", min(4, text.count(". ") + text.count(", ")) / 4,
            min(1.0, 10 * digits / size), text.isupper(), bool(_MARK.search(text)), first.isupper(), min(1.0, size / n_words / 12),
            *named, i / n, min(1.0, len(b.tags) / 10),
        ))
    if n:
        out[rows, columns] = 1
        out[:, t:_BASE] = values
        own = out[:, t : t + _TEXT]
        out[1:, _BASE : _BASE + _TEXT] = own[:-1]
        out[:-1, _BASE + _TEXT : _BASE + 2 * _TEXT] = own[1:]
        out[:, -1] = 1
    return out


@dataclass
class Model:
    weights: np.ndarray  # FEATURES: score of content over boilerplate
    step: np.ndarray  # 2, 2: score of a transition
    start: float = 0.0

    def decode(self, pages: Sequence[np.ndarray]) -> list[np.ndarray]:
        """Viterbi over each page; pages of like length are done together."""
        out: list[np.ndarray] = [np.empty(0, np.int8)] * len(pages)
        at = sorted((i for i in range(len(pages)) if len(pages[i])), key=lambda i: len(pages[i]))
        for low in range(0, len(at), 64):
            part = at[low : low + 64]
            size = np.array([len(pages[i]) for i in part])
            high = int(size.max())
            e = np.zeros((len(part), high), np.float64)
            score = np.concatenate([pages[i] for i in part]) @ self.weights
            e[np.arange(high) < size[:, None]] = score
            v = np.stack([np.zeros(len(part)), e[:, 0] + self.start], 1)
            back = np.zeros((high, len(part), 2), np.int8)
            for t in range(1, high):
                live = (t < size)[:, None]
                to = v[:, :, None] + self.step
                best = to.argmax(1)
                now = np.take_along_axis(to, best[:, None], 1)[:, 0]
                now[:, 1] += e[:, t]
                back[t] = np.where(live, best, [0, 1])
                v = np.where(live, now, v)
            label = v.argmax(1)
            path = np.zeros((len(part), high), np.int8)
            for t in range(high - 1, -1, -1):
                path[:, t] = label
                label = back[t, np.arange(len(part)), label]
            for k, i in enumerate(part):
                out[i] = path[k, : size[k]]
        return out

    def extract(self, htmls: Sequence[str | None]) -> list[tuple[int, int, str]]:
        """(blocks, content blocks, text) of each page."""
        out = []
        for low in range(0, len(htmls), 256):
            pages = [blocks(h) for h in htmls[low : low + 256]]
            for page, y in zip(pages, self.decode([features(p) for p in pages]), strict=True):
                good = [b.text for b, k in zip(page, y, strict=True) if k]
                out.append((len(page), len(good), "\n".join(good)))
        return out


def log_likelihood(model: Model, x: Sequence[np.ndarray], y: Sequence[np.ndarray]) -> tuple[float, np.ndarray, np.ndarray, float]:
    """The mean log-likelihood of labelled pages and its gradients, by forward and backward sums over padded sequences."""
    size = np.array([len(p) for p in x])
    high, n = int(size.max()), len(x)
    mask = np.arange(high) < size[:, None]
    flat = np.concatenate(x)
    e = np.zeros((n, high, 2))
    e[..., 1][mask] = flat @ model.weights
    e[:, 0, 1] += model.start
    labels = np.zeros((n, high), np.int64)
    labels[mask] = np.concatenate(y)
    a, b = np.zeros((n, high, 2)), np.zeros((n, high, 2))
    a[:, 0] = e[:, 0]
    for t in range(1, high):
        now = np.logaddexp.reduce(a[:, t - 1, :, None] + model.step, axis=1) + e[:, t]
        a[:, t] = np.where(mask[:, t, None], now, a[:, t - 1])
    total = np.logaddexp.reduce(a[:, -1], axis=1)
    for t in range(high - 2, -1, -1):
        now = np.logaddexp.reduce(model.step + (e[:, t + 1] + b[:, t + 1])[:, None, :], axis=2)
        b[:, t] = np.where(mask[:, t + 1, None], now, 0)
    p = np.exp(a + b - total[:, None, None])[..., 1] * mask
    gold = (e[..., 1] * labels * mask).sum(1)
    pair = mask[:, 1:]
    gold += (model.step[labels[:, :-1], labels[:, 1:]] * pair).sum(1)
    joint = np.exp(a[:, :-1, :, None] + model.step + (e[:, 1:] + b[:, 1:])[:, :, None, :] - total[:, None, None, None]) * pair[..., None, None]
    seen = np.zeros((2, 2))
    np.add.at(seen, (labels[:, :-1][pair], labels[:, 1:][pair]), 1)
    off = (labels - p) * mask
    return float((gold - total).mean()), (off[mask] @ flat) / n, (seen - joint.sum((0, 1))) / n, float(off[:, 0].sum() / n)


def train(pages: Sequence[tuple[str, Sequence[int]]], steps: int = STEPS, rate: float = RATE, l2: float = L2) -> Model:
    """Fit to (html, label of each leaf block); pages without blocks are left out."""
    x, y = [], []
    for html, labels in pages:
        page = blocks(html)
        if len(page) != len(labels):
            raise ValueError(f"{len(labels)} labels for {len(page)} blocks")
        if page:
            x.append(features(page).astype(np.float64))
            y.append(np.asarray(labels, np.int64))
    model = Model(np.zeros(FEATURES), np.zeros((2, 2)))
    if not x:
        return model
    theta = np.zeros(FEATURES + 5)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for i in range(1, steps + 1):
        _, gw, gs, g0 = log_likelihood(model, x, y)
        g = np.concatenate((gw, gs.ravel(), [g0])) - l2 * theta
        m, v = m + 0.1 * (g - m), v + 0.01 * (g * g - v)
        theta = theta + rate * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.99**i)) + 1e-8)
        model = Model(theta[:FEATURES], theta[FEATURES:-1].reshape(2, 2), float(theta[-1]))
    return model


def labelled_pages(n: int = TRAIN_PAGES, seed: int = SEED) -> list[tuple[str, list[int]]]:
    """Pages of invented words in several layouts, and the label of each leaf block."""
    r = random.Random(seed)
    syllables = ["ka", "ro", "mi", "ten", "sol", "ve", "dur", "an", "el", "ist", "pra", "ü", "né", "ció", "lo", "x", "th", "er", "ing"]
    word = lambda: "".join(r.choice(syllables) for _ in range(r.randint(1, 4)))
    phrase = lambda n: " ".join(word() for _ in range(n)).capitalize()

    def prose(low: int, high: int) -> str:
        out = []
        for _ in range(r.randint(low, high)):
            k = r.randint(1, 18)
            s = phrase(k)
            if k > 8 and r.random() < 0.5:
                s = s.replace(" ", ", ", 1)
            out.append(s + r.choice("....!?"))
        return " ".join(out)

    def messy() -> str:
        return " ".join(word() + r.choice(["***", "###", "%%%", "&amp;", "!!", ""]) for _ in range(r.randint(5, 60)))

    pages = []
    for _ in range(n):
        html: list[str] = ["<!DOCTYPE html><html><head><title>", phrase(5), "</title><style>p{}</style></head><body>"]
        labels: list[int] = []

        def put(before: str, text: str, after: str, label: int) -> None:
            html.append(f"{before}{text}{after}")
            labels.append(label)

        def links(k: int, tag: str) -> None:
            html.append(tag)
            for _ in range(k):
                put("<li>" + f'<a href="/{word()}">', phrase(r.randint(1, 3)), "</a></li>" if r.random() < 0.8 else "</a>", 0)
            html.append("</ul>")

        layout = r.randrange(6)
        semantic = layout < 3
        named = r.random() < 0.6
        if r.random() < 0.9:
            html.append("<nav>" if semantic else f"<div{' class=menu' if named else ''}>")
            links(r.randint(2, 9), "<ul>")
            html.append("</nav>" if semantic else "</div>")
        for _ in range(r.choice([0, 1, 1, 2])):
            put(f'<div class="{r.choice(["ad", "promo banner", "sponsor"])}">' if named or semantic else "<div>", prose(1, 2), "</div>", 0)
        html.append(["<article>", "<main>", "<main><section>", '<div id="content">' if named else "<div>", "<table><tr><td>", '<div class="post">' if named else "<div><div>"][layout])
        put("<h1>", phrase(r.randint(1, 9)) + r.choice(["", "."]), "</h1>", 1)
        for _ in range(r.randint(1, 14)):
            kind = r.random()
            if kind < 0.1:
                put("<h2>", phrase(r.randint(1, 7)), "</h2>", 1)
            elif kind < 0.2:
                put("<p><b>", prose(1, 1), "<br>", 1)
            elif kind < 0.28:
                html.append("<ul>")
                for _ in range(r.randint(1, 4)):
                    put("<li>", prose(1, 1), "</li>", 1)
                html.append("</ul>")
            elif kind < 0.33:
                put("<blockquote>", prose(1, 2), "</blockquote>", 1)
            elif kind < 0.38:
                put("<p>", messy(), "</p>", 1)
            elif kind < 0.43:
                put("<p>", prose(1, 2).upper(), "</p>", 1)
            elif kind < 0.47 and layout != 4:
                put("<p>", " | ".join(word() for _ in range(r.randint(3, 30))), "</p>", 1)
            else:
                put("<p>", prose(1, 5) + (f' <a href="#">{word()}</a> {word()}.' if r.random() < 0.2 else ""), "</p>" if r.random() < 0.8 else "", 1)
            if r.random() < 0.04:
                put(f'<div class="{r.choice(["share social", "related"])}"><a href="#">', phrase(2), "</a></div>", 0)
        html.append(["</article>", "</main>", "</section></main>", "</div>", "</td></tr></table>", "</div>" if named else "</div></div>"][layout])
        if r.random() < 0.3:
            html.append("<aside>" if semantic else f"<div{' class=sidebar' if named else ''}>")
            put("<h3>", phrase(2), "</h3>", 0)
            links(r.randint(2, 6), "<ul>")
            html.append("</aside>" if semantic else "</div>")
        if r.random() < 0.2:
            html.append(f"<div{' class=comments' if named else ''}>")
            for _ in range(r.randint(1, 3)):
                put("<div><b>", word() + "</b> " + phrase(r.randint(1, 6)), "</div>", 0)
            html.append("</div>")
        if r.random() < 0.9:
            put("<footer>" if semantic else f"<div{' class=footer' if named else ''}>", f"&copy; {word()}.example &middot; {prose(1, 1)}", "</footer>" if semantic else "</div>", 0)
        html.append("</body></html>")
        pages.append(("".join(html), labels))
    return pages


def extract(pages: DataFrame, model: Model) -> DataFrame:
    """(page_id, n_blocks, n_content, text) of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                cols = list(zip(*model.extract(part.column(1).to_pylist()), strict=True)) or [[]] * 3
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.string())], names=["page_id", "n_blocks", "n_content", "text"])

    plain = _store.pick(pages, page_id="page_id", _html="html").withColumn("page_id", F.col("page_id").cast("long"))
    return _store.arrow(plain, run, "page_id long, n_blocks int, n_content int, text string")
