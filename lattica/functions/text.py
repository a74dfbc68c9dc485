"""Column functions over source text: keywords, parameters, previews, lines."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Keyword to the words whose presence in a name or a text calls for it.
KEYWORDS = {
    "API": "api endpoint graphql grpc rest route",
    "CRUD": "create delete remove update",
    "HTTP": "http request response",
    "I/O": "input io output",
    "asynchronous": "async await future task",
    "authentication": "auth authentication credential jwt login logout oauth token",
    "authorization": "acl authorize permission role",
    "background processing": "background job queue worker",
    "caching": "cache caching memcache redis",
    "callbacks": "callback hook trigger",
    "cleanup": "cleanup close dispose shutdown",
    "collections": "array collection dict dictionary hash list map set",
    "concurrency": "concurrent lock mutex thread",
    "configuration": "config configuration env environment options settings variable",
    "data processing": "clean normalize sanitize",
    "data storage": "repo repository storage store",
    "data structures": "graph node tree",
    "database": "database db query sql",
    "error handling": "error exception fail fault",
    "event handling": "event listener publish subscriber",
    "exception handling": "catch raise throw",
    "factory pattern": "builder creator factory",
    "file I/O": "file read stream write",
    "handler": "handle handler",
    "initialization": "init initialize setup start",
    "logging": "log logger logging",
    "monitoring": "metric monitor telemetry trace",
    "networking": "client connection socket",
    "parsing": "format formatter parse parser",
    "security": "decrypt encrypt hash security",
    "serialization": "deserialize json serialize xml",
    "singleton pattern": "instance singleton",
    "testing": "assert expect fixture mock should spec stub test",
    "validation": "check valid validate validator",
}
SCOPES = {"test": "testing", "benchmark": "performance", "example": "documentation"}
PREVIEW = 300


_AUTOMATON: list = []


def keywords_of(text: str) -> list[str]:
    """Keywords whose triggers stand in a lower-cased text."""
    if not _AUTOMATON:
        import ahocorasick

        a = ahocorasick.Automaton()
        for w in _TRIGGERS_OF:
            a.add_word(w, _TRIGGERS_OF[w])
        a.make_automaton()
        _AUTOMATON.append(a)
    out: set[str] = set()
    for _, ks in _AUTOMATON[0].iter(text):
        out.update(ks)
        if len(out) == len(KEYWORDS):
            break
    return sorted(out)


_TRIGGERS_OF: dict[str, tuple[str, ...]] = {}
for _k, _ws in KEYWORDS.items():
    for _w in _ws.split():
        _TRIGGERS_OF[_w] = (*_TRIGGERS_OF.get(_w, ()), _k)


def keywords(name: Column, content: Column, scope: Column | None = None) -> Column:
    """Sorted keywords that the lower-cased name or content, or the scope, calls for. One automaton looks for all triggers at once."""

    @F.pandas_udf("array<string>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(keywords_of)

    found = run(F.concat_ws("\n", F.lower(name), F.lower(content)))
    if scope is not None:
        extra = F.when(scope == "test", F.array(F.lit(SCOPES["test"])))
        for s in [x for x in SCOPES if x != "test"]:
            extra = extra.when(scope == s, F.array(F.lit(SCOPES[s])))
        found = F.array_sort(F.array_union(found, F.coalesce(extra, F.array().cast("array<string>"))))
    return found


def parameters(content: Column) -> Column:
    """Up to ten parameter names between the first `(` and the first `)`, joined; null if there are none."""
    start, end = F.instr(content, "("), F.instr(content, ")")
    inner = F.when((start > 0) & (end > start + 1), F.substring(content, start + 1, end - start - 1))
    parts = F.filter(F.transform(F.split(inner, ","), lambda p: F.trim(p)), lambda p: (p != "") & ~F.lower(p).isin("cls", "self", "this"))
    names = F.transform(parts, lambda p: F.when(p.contains(":"), F.trim(F.substring_index(p, ":", 1))).when(p.contains("="), F.trim(F.substring_index(p, "=", 1))).otherwise(F.element_at(F.split(p, r"\s+"), -1)))
    names = F.slice(F.filter(names, lambda x: x != ""), 1, 10)
    return F.when(F.size(names) > 0, F.array_join(names, ", "))


def cut_bytes(text: str, n: int) -> str:
    """The longest beginning of at most n UTF-8 bytes."""
    raw = text.encode("utf-8", "surrogatepass")
    return text if len(raw) <= n else raw[:n].decode("utf-8", "ignore")


_SPACES = re.compile(r"\s+")


def preview_text(text: str | None, n: int = PREVIEW) -> str | None:
    """White space collapsed; what is longer than n bytes is cut at the last blank before, with `...`."""
    if text is None:
        return None
    return _shortened(_SPACES.sub(" ", text).strip(), n)


def _shortened(plain: str, n: int) -> str:
    cut = cut_bytes(plain, n)
    if cut == plain or not cut:
        return cut
    return f"{cut[: cut.rfind(' ')] if ' ' in cut else cut}..."


def preview(text: Column, n: int = PREVIEW) -> Column:
    """preview_text as a column; only texts that need a cut go through Python's bytes."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: _shortened(x, n), na_action="ignore")

    plain = F.trim(F.regexp_replace(text, r"\s+", " "))
    # n bytes are n characters at most; one more tells that something was cut
    return F.when(F.octet_length(plain) <= n, plain).otherwise(run(F.substring(plain, 1, n + 1)))


def snippet(text: Column, n: int = 200) -> Column:
    """At most n characters, with `...` if cut."""
    return F.when(F.char_length(text) > n, F.concat(F.substring(text, 1, n), F.lit("..."))).otherwise(text)


def lines(text: Column, first: Column, last: Column, context: int = 0, most: int | None = None) -> Column:
    """Lines first to last, counted from 1, `context` more on either side, at most `most`; empty if first lies beyond the end."""
    every = F.split(F.regexp_replace(text, r"\r?\n$", ""), r"\r?\n")
    low = F.greatest(F.lit(1), first - context)
    high = F.least(F.size(every), last + context)
    n = F.greatest(high - low + 1, F.lit(0))
    if most is not None:
        n = F.least(n, F.lit(most))
    return F.when(low > F.size(every), F.lit("")).otherwise(F.array_join(F.slice(every, low, n), "\n"))
