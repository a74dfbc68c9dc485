"""Words: vectorised against plain, SQL against Python, long texts against short ones."""

import random

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from lattica.llm import _text as T
from lattica.llm import licenses, minhash, winnow

SIGNS = list("abcXYZ019_ .,\n-é ßÀςΣΟΦ“”’— 漢字かな。、ไทยİıﬁ😀‍한국어אבג;؟ ­") + ["\U00020001", "\U00010400"]


def some_text(r, most=60):
    return "".join(r.choice(SIGNS) for _ in range(r.randrange(most)))


def test_words_beyond_ascii():
    assert T.split_words("“Hello” stop。你好世界 don’t l’été a b—c ΟΔΟΣ x²") == ["hello", "stop", "你", "好", "世", "界", "don", "t", "l", "été", "a", "b", "c", "οδοσ", "x"]
    assert T.split_words(None) == T.split_words("") == T.split_words(" …“” ") == []


def test_vectorised_equals_plain():
    r = random.Random(1)
    for _ in range(150):
        texts = [some_text(r) for _ in range(r.randrange(1, 6))]
        w = T.words(texts)
        for i, t in enumerate(texts):
            own = w.hash[w.first[i] : w.first[i + 1]]
            assert own.tolist() == [int(T.words([x]).hash[0]) for x in T.split_words(t)]


@pytest.mark.parametrize("block", [4, 5, 13, 1000])
def test_long_texts_equal_short_ones(block):
    """Read block by block, wherever a block ends: inside a word, before a mark, between single signs."""
    r = random.Random(2)
    for _ in range(120):
        t = some_text(r)
        raw, w = t.encode(), T.words([t])
        parts = list(T.long_words(raw, block))
        assert [x for p in parts for x in p.tolist()] == w.hash.tolist()
        h, _, pos = T.grams(w, 3)
        assert [x for a, b in T.long_grams(raw, 3, 0, block) for x in zip(b.tolist(), a.tolist(), strict=True)] == list(zip(pos.tolist(), h.tolist(), strict=True))
        assert {x for a, b in T.long_grams(raw, 3, 2, block) for x in zip(b.tolist(), a.tolist(), strict=True)} == set(zip(pos.tolist(), h.tolist(), strict=True))
        assert T.at_places(raw, [(1, 3), (5, 9)], block) == {i: int(w.hash[i]) for i in (1, 2, 5, 6, 7, 8) if i < len(w.hash)}


def test_sql_splits_alike():
    r = random.Random(3)
    texts = [some_text(r) for _ in range(150)]
    db = duckdb.connect()
    db.register("t", pa.table({"i": range(len(texts)), "text": texts}))
    for i, words in db.execute(f"select i, {T.word_sql('text')} from t").fetchall():
        assert words == T.split_words(texts[i]), texts[i]


def test_operators_on_long_texts(monkeypatch):
    """Fingerprints, grams, signatures and similarities of a text do not depend on how it is read."""
    r = random.Random(4)
    t = " ".join(r.choice(["alpha", "beta", "über", "漢字"]) + str(r.randrange(300)) for _ in range(60_000))
    u = t[: len(t) // 2] + " other things " + t[len(t) // 2 : -2000]
    ids, texts = pa.array([1, 2, 3, 4]), pa.array(["a b c d", t, None, "x y z " * 10])

    def results():
        rows = lambda f, *cols: [x for b in f(iter([pa.RecordBatch.from_arrays(list(cols), names=[str(i) for i in range(len(cols))])])) for x in b.to_pylist()]
        prints = {(x["_id"], h["h"], h["p"]) for x in rows(winnow._prints(5, 4), ids, texts) for h in x["_f"]}
        grams = sorted((x["_id"], x["_h"], x["_p"]) for x in rows(licenses._grams([3, 4]), ids, texts))
        return prints, grams, rows(minhash._sign(3, 8, 4), ids, texts), rows(minhash._verify(3), pa.array([1, 2]), pa.array([1, 2]), pa.array([t, None]), pa.array([u, ""]))

    short = results()
    for module in (T, minhash):
        monkeypatch.setattr(module, "LONG", 1 << 16)
    assert results() == short and short[3][1]["_j"] == 1.0


def test_permutations_are_bijections():
    x = np.arange(1 << 16, dtype=np.uint32) * np.uint32(65537)
    for key in (0, 77, 0xFFFFFFFF):
        assert len(np.unique(minhash.Circulant.permute(x.copy(), np.uint32(key), np.empty_like(x)))) == len(x)
