"""Capture index, tool calls, Ogg and licenses: round trips, brute force and edge cases."""

import hashlib
import json
import random
import struct

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lattica.llm import licenses, ogg, toolcalls, warc
from lattica.llm import queries as llm_queries
from lattica.llm._text import split_words


# Capture index


@pytest.mark.parametrize(
    ("url", "key"),
    [
        ("http://www.Example.com/A?b=1#c", "com,example,www)/A?b=1"),
        ("https://user@a.b.org:8080", "org,b,a:8080)/"),
        ("https://a.org:443?x", "org,a)/?x"),
        ("//x.de/p", "de,x)/p"),
        ("mailto:me#z", "mailto:me"),
        ("", ""),
    ],
)
def test_url_key(spark, url, key):
    assert spark.createDataFrame([(url,)], "u string").select(warc.url_key(F.col("u"))).first()[0] == key


def test_index_round_trip(spark):
    r = random.Random(1)
    rows = [(i, f"http://h{r.randrange(9)}.example.{r.choice(['com', 'org'])}/{r.randrange(30)}", f"<p>{'é' * r.randrange(50)}{i}", "k") for i in range(600)]
    rows += [(1000 + i, "http://hot.example.com/x", f"hot {i}", "k") for i in range(100)]  # a key of many blocks
    rows += [(None, "http://n.example.com/", None, "k"), (7, None, "lost", "k"), (7, "", "empty url", "k"), (8, "http://big.example.com", "z" * 3_000_000, "k")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, _key string")
    index = warc.build(warc.write(pages.repartition(5)), block=16)
    assert index.first == sorted(index.first)
    keys = pages.select(warc.url_key(F.col("url")).alias("url_key"), F.lit("c").alias("_part"))
    got = {}
    for x in warc.lookup(keys.unionByName(spark.createDataFrame([("com,nowhere)/", "c"), ("", "c"), (None, "c")], "url_key string, _part string")), index).collect():
        got.setdefault(x.url_key, []).append((x.page_id, bytes(x.body).decode()))
    want = {}
    for (i, u, h, _), k in zip(rows, [x.k for x in pages.select(warc.url_key(F.col("url")).alias("k")).collect()], strict=True):
        if u is not None:
            want.setdefault(k, []).append((i, h or ""))
    assert index.n_bytes > 0 and warc.places(keys, index).count() == sum(map(len, got.values()))
    order = lambda x: sorted(x, key=repr)
    assert {k: order(v) for k, v in got.items()} == {k: order(v) for k, v in want.items()}


def test_reader_reads_few_blocks(spark):
    pages = spark.createDataFrame([(i, f"http://a.com/{i:05}", "") for i in range(2000)], "page_id long, url string, html string")
    index = warc.build(warc.write(pages).coalesce(1), block=50)
    reader = warc.Reader(index.files[0])
    assert len(reader.directory) > 5 and [x[1] for x in reader.find(b"com,a)/" + reader.first[2].split(b"/")[-1])]
    assert reader.reads <= 2


def test_empty_index(spark):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    index = warc.build(warc.write(none))
    assert index.files == [] and warc.lookup(none.select(F.col("url").alias("url_key")), index).count() == 0


# Tool calls


def _same(a, b):
    """Equal, but for whole numbers beyond 2**53 that stand for doubles."""
    if isinstance(b, dict):
        return set(a) == set(b) and all(_same(a[k], b[k]) for k in b)
    if isinstance(b, list):
        return len(a) == len(b) and all(map(_same, a, b))
    return float(a) == b if isinstance(b, float) else a == b


@given(st.recursive(st.none() | st.booleans() | st.integers(-(2**60), 2**60) | st.floats(allow_nan=False, allow_infinity=False) | st.text(), lambda x: st.lists(x, max_size=4) | st.dictionaries(st.text(), x, max_size=4), max_leaves=12))
@settings(max_examples=200, deadline=None)
def test_canonical_round_trip(x):
    text = toolcalls.canonical(x)
    back = json.loads(text)
    assert _same(back, x)
    assert toolcalls.canonical(back) == text


@pytest.mark.parametrize(("x", "text"), [(1e21, "1e+21"), (1e20, "100000000000000000000"), (1e-7, "1e-7"), (0.000001, "0.000001"), (-0.0, "0"), (1.5, "1.5"), (123456.789, "123456.789"), (5e-324, "5e-324"), (1.0, "1"), ({"b": 1, "a": [True, None]}, '{"a":[true,null],"b":1}')])
def test_canonical_forms(x, text):
    assert toolcalls.canonical(x) == text


def test_schema_rules():
    s = {"type": "object", "required": ["q"], "properties": {"q": {"type": "string", "minLength": 2, "pattern": "^a"}, "n": {"type": ["integer", "null"], "maximum": 5}, "k": {"enum": ["x"]}, "l": {"type": "array", "items": {"type": "number"}, "maxItems": 2}}, "additionalProperties": False}
    for x, want in [({"q": "ab"}, None), ({}, "$.q required"), ({"q": 1}, "$.q type"), ({"q": "a"}, "$.q minLength"), ({"q": "bb"}, "$.q pattern"), ({"q": "ab", "n": 6}, "$.n maximum"), ({"q": "ab", "n": True}, "$.n type"), ({"q": "ab", "k": "y"}, "$.k enum"), ({"q": "ab", "l": [1, "z"]}, "$.l[1] type"), ({"q": "ab", "l": [1, 2, 3]}, "$.l maxItems"), ({"q": "ab", "z": 1}, "$.z additionalProperties"), ([], "$ type")]:
        assert toolcalls.problem(x, s) == want


def test_more_schema_rules():
    for x, s, want in [([1, 1.0], {"uniqueItems": True}, "$ uniqueItems"), (3, {"anyOf": [{"type": "string"}, {"minimum": 4}]}, "$ anyOf"), (5, {"anyOf": [{"type": "string"}, {"minimum": 4}]}, None), (5, {"oneOf": [{"minimum": 1}, {"minimum": 4}]}, "$ oneOf"), (5, {"not": {"type": "integer"}}, "$ not"), (5, {"allOf": [{"minimum": 1}, {"maximum": 4}]}, "$ maximum"), ({"n": {"n": 3}}, {"$ref": "#/$defs/t", "$defs": {"t": {"type": "object", "properties": {"n": {"$ref": "#/$defs/t"}}}}}, "$.n.n type"), (7, {"multipleOf": 2}, "$ multipleOf"), ({}, {"minProperties": 1}, "$ minProperties"), (1, False, "$ false")]:
        toolcalls.check_schema(s)
        assert toolcalls.problem(x, s) == want
    with pytest.raises(ValueError, match="contains"):
        toolcalls.check_schema({"properties": {"a": {"contains": {}}}})


def test_surrogates_and_depth(spark):
    """Lone surrogates are written as escapes, arguments of any depth break nothing."""
    deep = ['{"prompt":' * 600 + "1" + "}" * 600, "[" * 100_000 + "]" * 100_000, "[" * 1200 + "]" * 1200]
    rows = [(i, 1, "a", "reply", x, None) for i, x in enumerate([r'{"prompt":"\ud800 \ud83d\ude00","turn":1}', *deep, '{"turn":1,"prompt":' + "[" * 60 + "]" * 60 + "}"])]
    calls = spark.createDataFrame(rows, "conv_id long, seq int, call_id string, name string, arguments string, after array<string>")
    got = {r.conv_id: json.loads(r.canonical)[0] for r in toolcalls.link(calls, spark.createDataFrame([], "conv_id long, seq int, call_id string, content string")).collect()}
    assert got[0]["status"] == "ok" and got[0]["arguments"]["prompt"] == "\ud800 😀"
    assert all(got[i]["status"] == "bad_json" and got[i]["arguments"] == deep[i - 1] for i in (1, 2, 3)) and got[4]["status"] == "invalid: $.prompt type"


@given(st.integers(1, 12).flatmap(lambda n: st.lists(st.lists(st.integers(0, n), max_size=3), min_size=n, max_size=n)))
@settings(deadline=None)
def test_topological_order(after):
    ids = [str(i) for i in range(len(after))]
    at, n_cycle = toolcalls.order(ids, [[str(a) for a in x] for x in after])
    assert sorted(at) == list(range(len(ids)))
    place = {i: p for p, i in enumerate(at)}
    for i in at[: len(at) - n_cycle]:
        assert all(place[a] < place[i] for a in after[i] if a < len(ids))


def test_link(spark):
    calls = spark.createDataFrame(
        [(1, 2, "b", "reply", '{"turn":1,"prompt":"p"}', ["a", "gone"], 0), (1, 1, "a", "reply", '{"prompt":""}', ["c"], 0), (1, 3, "c", "other", "{", None, 0), (1, 9, "c", "reply", "{}", None, 0), (2, 1, "x", "reply", "nope", ["y"], 0), (2, 2, "y", "reply", None, ["x"], 0), (2, None, "z", None, '{"turn":NaN}', [], 0), (None, 1, "q", "reply", "{}", None, 0), (3, 1, None, "reply", "{}", None, 0)],
        "conv_id long, seq int, call_id string, name string, arguments string, after array<string>, _c int",
    )
    results = spark.createDataFrame([(1, 5, "b", "late", 1), (1, 4, "b", "first", 1), (1, 4, "b", "first", 1), (1, 6, "nobody", "r", 1), (4, 1, "k", None, 1), (2, 1, "x", None, 1)], "conv_id long, seq int, call_id string, content string, _r int")
    got = {r.conv_id: r for r in toolcalls.link(calls, results).collect()}
    assert set(got) == {1, 2, 4}
    one = json.loads(got[1].canonical)
    assert [(c["id"], c["status"], c["result"]) for c in one] == [("c", "unknown_tool", None), ("a", "invalid: $.turn required", None), ("b", "ok", "first")]
    assert (got[1].n_calls, got[1].n_linked, got[1].n_invalid, got[1].n_orphans) == (3, 1, 2, 1)
    assert [(c["id"], c["status"]) for c in json.loads(got[2].canonical)] == [("z", "unknown_tool"), ("x", "cycle"), ("y", "cycle")] and got[2].n_linked == 1
    assert got[4].canonical == "[]" and got[4].n_orphans == 1
    assert toolcalls.link(calls.limit(0), results.limit(0)).count() == 0


def test_from_messages(spark):
    m = spark.createDataFrame(
        [(1, 0, "user", "hi", 0), (1, 1, "assistant", json.dumps({"tool_calls": [{"id": "b", "name": "reply", "arguments": "{}", "after": ["a"]}, {"id": "a", "name": "reply", "arguments": '{"prompt":"x","turn":0}'}]}), 0), (1, 2, "tool", json.dumps({"tool_call_id": "a", "content": "ü"}), 0), (1, 3, "assistant", "plain", 0), (1, 4, "tool", None, 0), (2, 0, None, None, 0)],
        "conv_id long, turn long, role string, text string, seq int",
    )
    got = toolcalls.link(*toolcalls.from_messages(m)).collect()
    assert len(got) == 1 and [c["id"] for c in json.loads(got[0].canonical)] == ["a", "b"] and got[0].n_linked == 1


def test_from_turns_edges(spark):
    rows = [(1, 0, "user", "x" * 401, 0), (1, 1, "assistant", "a", 0), (1, 1, "assistant", "b", 0), (1, 2, "user", "", 0), (1, 4, "user", None, 0), (1, 7, "assistant", None, 0), (None, 0, "user", "q", 0), (2, None, "user", "q", 0)]
    got = toolcalls.link(*toolcalls.from_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, _t int"))).collect()
    assert len(got) == 1
    assert [(c["id"], c["status"], c["result"]) for c in json.loads(got[0].canonical)] == [("c0", "invalid: $.prompt maxLength", "a"), ("c2", "invalid: $.prompt minLength", None), ("c4", "invalid: $.prompt required", None)]
    assert got[0].n_orphans == 1


# Ogg


def plain_crc(data):
    c = 0
    for b in data:
        c ^= b << 24
        for _ in range(8):
            c = (c << 1 ^ 0x04C11DB7 if c & 0x80000000 else c << 1) & 0xFFFFFFFF
    return c


@given(st.binary(max_size=300))
def test_crc(data):
    assert ogg.crc(data) == plain_crc(data)


@given(st.lists(st.lists(st.binary(max_size=1400), min_size=1, max_size=8), min_size=1, max_size=3), st.integers(1, 40))
@settings(max_examples=60, deadline=None)
def test_ogg_round_trip(streams, segments):
    pages = [ogg.pages_of(i + 5, [(p, 10 * (n + 1)) for n, p in enumerate(s)], 1, segments) for i, s in enumerate(streams)]
    data = b"".join(b"".join(p[i] for p in pages if i < len(p)) for i in range(max(map(len, pages))))
    got, bad = ogg.parse(data)
    assert bad == 0 and {s.serial: [p for p, _, _ in s.packets] for s in got} == {i + 5: s for i, s in enumerate(streams)}
    assert all(s.lost == 0 for s in got)


def test_ogg_damage():
    packets = [(bytes([i]) * 900, 48 * (i + 1)) for i in range(12)]
    pages = ogg.pages_of(9, packets, 1, 6)
    whole = b"".join(pages)
    flipped = bytearray(whole)
    flipped[len(b"".join(pages[:3])) + 60] ^= 1
    got, bad = ogg.parse(bytes(flipped))
    assert bad == 1 and got[0].lost >= 1
    assert set(p for p, _, _ in got[0].packets) < {p for p, _ in packets}
    got, bad = ogg.parse(b"junk" + whole + b"tail" + pages[-1][:20])
    assert bad == 3 and [p for p, _, _ in got[0].packets] == [p for p, _ in packets]
    got, bad = ogg.parse(b"".join(pages[:2] + pages[3:]))
    assert bad == 0 and got[0].lost >= 1
    assert ogg.parse(b"") == ogg.parse(None) == ([], 0) and ogg.parse(b"OggS") == ([], 1)


def test_ogg_chained():
    """A second stream of the same serial number begins anew."""
    head = b"OpusHead\x01\x01" + struct.pack("<IHhB", 0, 48000, 0, 0)
    one = b"".join(ogg.pages_of(1, [(head, 0), (b"OpusTags", 0), (b"a", 48000)], 2))
    two = b"".join(ogg.pages_of(1, [(head, 0), (b"OpusTags", 0), (b"b", 24000), (b"c", 96000)], 2))
    got, bad = ogg.parse(one + two)
    assert bad == 0 and [[p for p, _, _ in s.packets[s.headers :]] for s in got] == [[b"a"], [b"b", b"c"]]
    assert [s.packets[-1][2] for s in got] == [1.0, 2.0] and all(not s.lost for s in got)


def test_ogg_times():
    opus = b"OpusHead\x01\x01" + struct.pack("<HIhB", 312, 48000, 0, 0)
    data = b"".join(ogg.pages_of(1, [(opus, 0), (b"OpusTags", 0), (b"a", -1), (b"b", 312 + 4800), (b"c", 312 + 9600)], 2))
    (s,), _ = ogg.parse(data)
    assert s.codec == "opus" and [round(t, 4) for _, _, t in s.packets[:2]] == [0, 0]
    assert abs(s.packets[-1][2] - 0.2) < 1e-9 and s.packets[2][2] < s.packets[3][2] < s.packets[4][2]
    vorbis = b"\x01vorbis" + struct.pack("<IBI", 0, 2, 44100) + bytes(14)
    (s,), _ = ogg.parse(b"".join(ogg.pages_of(1, [(vorbis, 0), (b"2", 0), (b"3", 0), (b"x", 22050)], 3)))
    assert s.codec == "vorbis" and s.packets[-1][2] == 0.5
    theora = bytearray(42)
    theora[:7] = b"\x80theora"
    struct.pack_into(">II", theora, 22, 25, 1)
    theora[40:42] = (6 << 5).to_bytes(2, "big")
    (s,), _ = ogg.parse(b"".join(ogg.pages_of(1, [(bytes(theora), 0), (b"2", 0), (b"3", 0), (b"x", (100 << 6) | 25)], 3)))
    assert s.codec == "theora" and s.packets[-1][2] == 5.0


def test_ogg_tables(spark):
    rows = [(1, None, None, None), (2, "", "s", "l"), (3, "ü" * 40_000, "s", "l"), (None, "x", "s", "l"), (4, "y", "s", "l"), (4, "y", "s", "l")]
    docs = spark.createDataFrame([(*r, "m") for r in rows], "doc_id long, text string, source string, lang string, media string")
    got = ogg.summary(ogg.text_files(docs), "doc_id", "media").collect()
    assert sorted((r.id or 0, r.n_bytes, r.md5) for r in got) == sorted((i or 0, len((t or "").encode()), hashlib.md5((t or "").encode()).hexdigest()) for i, t, _, _ in rows)
    assert all(r.n_bad == r.n_lost == 0 and r.n_streams == 2 for r in got)
    p = ogg.packets(ogg.text_files(docs), "doc_id", "media").where("id = 3 and serial = 1 and packet > 1").orderBy("packet").collect()
    assert b"".join(bytes(r.data) for r in p).decode() == "ü" * 40_000 and p[-1].seconds == pytest.approx(0.02 * len(p))
    each = ogg.streams(ogg.text_files(docs), "doc_id", "media").where("id = 3").orderBy("stream").collect()
    assert [(r.serial, r.codec, r.n_bytes) for r in each] == [(1, "opus", 80_000), (2, "vorbis", 3)]
    raw = spark.createDataFrame([(1, None, 0), (2, bytearray(b"no ogg"), 0)], "id long, data binary, _data int")
    assert [r.n_streams for r in ogg.summary(raw, "id", "data").collect()] == [0, 0] and ogg.packets(raw, "id", "data").count() == 0
    assert ogg.summary(raw.limit(0), "id", "data").count() == 0 and ogg.streams(raw, "id", "data").count() == 0


def ogg_pages(data):
    """Pages by stream and number, in order."""
    at, out = 0, {}
    while at < len(data):
        end = at + 27 + data[at + 26] + sum(data[at + 27 : at + 27 + data[at + 26]])
        out[struct.unpack_from("<II", data, at + 14)] = data[at:end]
        at = end
    return out


@pytest.mark.parametrize("lost", [(1, 0), (1, 1), (2, 0), (2, 1), (2, 2)])
def test_ogg_header_lost(lost):
    """Whatever header is missing, no packet of the payload is taken for one."""
    pages = ogg_pages(ogg.from_text("OpusTags" + "x" * 20_000, "note"))
    got, bad = ogg.parse(b"".join(p for at, p in pages.items() if at != lost))
    assert bad == 0 and {s.serial: b"".join(p for p, _, _ in s.packets[s.headers :]) for s in got} == {1: b"OpusTags" + b"x" * 20_000, 2: b"note"}
    for s in got:
        begun = (s.serial, 0) != lost
        assert bool(s.codec) == begun and not s.lost and [t for _, _, t in s.packets[: s.headers]] == [0.0] * s.headers
        assert s.packets[-1][2] == ((0.14 if s.serial == 1 else 1.0) if begun else None)


def test_ogg_times_after_gap():
    """Behind a missing page only the last packet of a page has a time, until the next page."""
    pages = ogg_pages(ogg.from_text("x" * 60_000, ""))
    times = lambda lost: {round(g): t for _, g, t in ogg.parse(b"".join(p for at, p in pages.items() if at != lost))[0][0].packets[2:] if g >= 0}
    whole, torn = times(None), times((1, 4))
    assert torn.items() < whole.items() and len(torn) == len(whole) - 1
    s = ogg.parse(b"".join(p for at, p in pages.items() if at != (1, 4)))[0][0]
    unknown = [i for i, (_, _, t) in enumerate(s.packets) if t is None]
    assert unknown and s.packets[unknown[-1] + 1][2] in whole.values() and all(t is not None for _, _, t in s.packets[unknown[-1] + 1 :])


def test_ogg_chained_begin_lost():
    """What follows the end of a stream is another one."""
    one, two = (ogg.from_text(t, "n") for t in ("a" * 4000, "b" * 4000))
    pages = ogg_pages(two)
    got, _ = ogg.parse(one + b"".join(p for (_, n), p in pages.items() if n))
    assert [b"".join(p for p, _, _ in s.packets[s.headers :])[:1] for s in got] == [b"a", b"n", b"b", b"n"] and not any(s.lost for s in got)


@pytest.mark.parametrize("name", ["op7_ogg_media", "op7_packets", "op7_damaged"])
def test_ogg_queries_equal_sql(spark, tmp_path, name):
    duckdb = pytest.importorskip("duckdb")
    r = random.Random(7)
    sizes = [0, 1, 254, 255, 2999, 3000, 3001, 8039, 8040, 8041, 16_160, 24_000, 40_000]
    rows = [(i if i % 19 else None, r.choice([None, "x" * n, "é€" * (n // 5), "OggS" * (n // 4), "OpusTags" * (n // 8)]), r.choice([None, "s"]), r.choice([None, "de", "y" * 9000])) for i in range(-20, 120) for n in [r.choice(sizes)]]
    at = str(tmp_path / "documents.parquet")
    spark.createDataFrame([*rows, rows[5]], "doc_id long, text string, source string, lang string").write.parquet(at)
    df = llm_queries.QUERIES[name](spark, str(tmp_path))
    c = duckdb.connect()
    c.execute(f"create view documents as select * from '{at}/*.parquet'")
    want = c.execute(f"select {', '.join(df.columns)} from ({llm_queries.ORACLE_SQL[name]})").fetchall()
    rows_of = lambda got: sorted(repr(tuple(float(x) if k == "seconds" and x is not None else x for k, x in zip(df.columns, row, strict=True))) for row in got)
    assert rows_of(df.collect()) == rows_of(want)


# Licenses


def brute_scan(docs):
    out = set()
    for i, t in docs:
        a = split_words(t)
        for name, template in licenses.TEMPLATES.items():
            b = split_words(template)
            diagonals = sorted({p - q for p in range(len(a) - 3) for q in range(len(b) - 3) if a[p : p + 4] == b[q : q + 4]})
            groups = []
            for d in diagonals:
                if groups and d - groups[-1][-1] <= licenses.merging_gap(len(b)):
                    groups[-1].append(d)
                else:
                    groups.append([d])
            for g in groups:
                hit, first, last = licenses.covered(dict(enumerate(a)), b, g, licenses.K)
                if len(hit) >= licenses.SHARE * len(b):
                    out.add((i, name, first, last - first + 1, len(hit), round(len(hit) / len(b), 6)))
    return out


def test_scan_equals_brute_force(spark):
    r = random.Random(4)
    docs = []
    for i in range(60):
        own = [f"w{r.randrange(30)}" for _ in range(r.randrange(60))]
        for _ in range(r.randrange(3)):
            t = r.choice(list(licenses.TEMPLATES.values())).split()
            for _ in range(r.randrange(3)):
                if r.random() < 0.5:
                    t.insert(r.randrange(len(t)), "extra")
                else:
                    del t[r.randrange(len(t))]
            own[r.randrange(len(own) + 1) : 0] = t
        docs.append((i, " ".join(own)))
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, _t int")
    want = brute_scan(docs)
    assert len(want) > 30
    for limit in (licenses.BROADCAST_ROWS, 0):
        assert {tuple(x) for x in licenses.scan(df, broadcast_rows=limit).collect()} == want


def test_license_with_words_put_in(spark):
    """A longer insertion in the middle, parts of whole licenses, and other quotation marks."""
    bsd = licenses.TEMPLATES["bsd"].split()
    at = len(bsd) // 2
    rows = [(1, " ".join([*bsd[:at], *"in this position and unchanged".split(), *bsd[at:]])), (2, licenses.TEMPLATES["mit-disclaimer"]), (3, "\n".join(licenses.TEMPLATES[x] for x in ("bsd", "bsd-3-clause", "bsd-disclaimer"))), (4, licenses.TEMPLATES["mit"].replace('"Software"', "“Software”"))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.license) for r in licenses.scan(docs).collect()}
    assert got >= {(1, "bsd"), (2, "mit-disclaimer"), (3, "bsd"), (3, "bsd-3-clause"), (3, "bsd-disclaimer"), (4, "mit")}


def test_license_edges(spark):
    mit = licenses.TEMPLATES["mit"]
    rows = [(1, None), (2, ""), (3, mit.upper()), (4, "x " * 60_000 + mit), (5, mit + " between " + mit), (6, "Permission is hereby granted, free of charge"), (None, mit), (7, mit), (7, mit)]
    docs = spark.createDataFrame([(*r, "a", "b") for r in rows], "doc_id long, text string, license string, _id string")
    got = [r for r in licenses.scan(docs).collect() if r.license == "mit"]
    assert sorted(r.doc_id for r in got) == [3, 4, 5, 5, 7] and all(r.share == 1 for r in got)
    assert licenses.scan(docs.limit(0)).count() == 0


def test_every_planted_notice_is_found(spark):
    """Each form of a license line in the given documents, by one of the two queries."""
    planted = ["This work is licensed under the GNU General Public License, version 3.", "All rights reserved.", "Licensed under CC BY-NC 4.0.", "Released under the MIT License.", "Licensed under the Apache License, Version 2.0."]
    docs = spark.createDataFrame(list(enumerate(f"some words\n{x}" for x in planted)), "doc_id long, text string")
    found = licenses.scan(docs).unionByName(licenses.scan(docs, licenses.NOTICES)).collect()
    assert {(r.doc_id, r.start_word) for r in found} >= {(i, 2) for i in range(len(planted))}


def test_short_templates(spark):
    rows = [(1, "All rights reserved."), (2, "all rights"), (3, "ALL RIGHTS RESERVED all rights reserved"), (4, "all the rights reserved"), (5, None), (6, ""), (None, "all rights reserved"), (7, licenses.TEMPLATES["all-rights-reserved"])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    short = {(1, 0), (3, 0), (3, 3), (7, 0)}
    for limit in (licenses.BROADCAST_ROWS, 0):
        got = licenses.scan(docs, licenses.NOTICES, broadcast_rows=limit).collect()
        assert {(r.doc_id, r.start_word) for r in got} == short and all(r.n_words == r.n_covered == 3 and r.share == 1 for r in got)
    both = {(r.doc_id, r.license, r.start_word) for r in licenses.scan(docs, licenses.TEMPLATES | licenses.NOTICES).collect()}
    assert both == {(i, "all-rights-reserved-notice", p) for i, p in short} | {(7, "all-rights-reserved", 0)}
