"""DOM leaf blocks of an HTML text, for the extractor.

A leaf block is a run of text between two boundaries of block elements; inline
elements do not end it. The open elements around it are its ancestors. Comments,
scripts, styles and the head are skipped. Unclosed paragraphs, list items, table
cells and the like are closed as HTML does; a stray end tag is ignored. Elements
more than `DEPTH` deep are not entered: what is in them belongs to the last one that
was, as browsers do. A tag whose `>` is missing is text. Reading takes time in
proportion to the text, whatever it holds.
"""

from __future__ import annotations

import re
from html import unescape
from typing import NamedTuple

DEPTH = 512
#: A tag whose end is missing is text; attribute values may hold `>`.
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|textarea|svg|iframe)\b[^>]*>.*?(?:</\1\s*>|\Z)|<(/?)([a-z][a-z0-9:-]*)((?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<[!?][^>]*>", re.S | re.I)
_INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr input select option button".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_CLOSES = {"p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"}}
_SCOPE = {"li": {"ul", "ol"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "p": {"article", "section", "div", "table", "td", "th", "li", "blockquote", "body", "main", "nav", "aside", "footer", "header"}}
_ENDS_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol pre section table ul".split())
_ATTR = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)


class Block(NamedTuple):
    text: str
    tags: tuple[str, ...]  # ancestors from the outside, without inline ones
    names: str  # their classes, ids and roles, lower case
    linked: int  # characters inside links


def _endless(m: re.Match) -> bool:
    """Whether a token is a comment or a raw element without its end."""
    if m[0].startswith("<!--"):
        return not m[0].endswith("-->")
    return bool(m[1]) and not re.search(r"</[^<>]*>\Z", m[0])


def blocks(html: str | None) -> list[Block]:
    out: list[Block] = []
    stack: list[tuple[str, str]] = []  # block elements and their class, id and role
    parts: list[str] = []
    link, linked, head, at = 0, 0, False, 0
    html = html or ""

    def flush() -> None:
        nonlocal linked
        if parts:
            text = "".join(parts)
            if "&" in text:
                text = unescape(text)
            text = " ".join(text.replace("\0", " ").split())
            if text:
                out.append(Block(text, tuple(t for t, _ in stack), " ".join(n for _, n in stack if n), min(linked, len(text))))
            parts.clear()
        linked = 0

    def text(piece: str) -> None:
        nonlocal linked
        if not head:
            parts.append(piece)
            if link:
                linked += len(piece.strip())

    # no tag ends behind the last `>`, so none is looked for there
    stop, m = html.rfind(">") + 1, None
    for m in _TOKEN.finditer(html, 0, stop):
        if m.start() > at:
            text(html[at : m.start()])
        at = m.end()
        name = m[3]
        if not name:
            continue
        name = name.lower()
        end = bool(m[2])
        if name in _INLINE:
            if name == "a":
                link = 0 if end else 1
            elif name in ("br", "img"):
                text(" ")
            continue
        if name == "head":
            head = not end
            flush()
            continue
        if name in ("html", "title", "meta", "link", "base"):
            continue
        if name == "body":
            head = False
        flush()
        if end:
            if any(t == name for t, _ in stack):
                while stack.pop()[0] != name:
                    pass
                link = 0
            continue
        closes = _CLOSES.get(name) or ({"p"} if name in _ENDS_P else None)
        if closes:
            scope = _SCOPE.get(name, _SCOPE["p"])
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in closes:
                    del stack[i:]
                    if name not in ("tr",) and not (stack and stack[-1][0] in closes):
                        break
                elif stack[i][0] in scope:
                    break
        if name not in _VOID and len(stack) < DEPTH:
            attrs = m[4]
            stack.append((name, " ".join("".join(x) for x in _ATTR.findall(attrs)).lower() if "=" in attrs else ""))
    if at < len(html) and not (m and m.end() == stop and _endless(m)):
        text(html[at:].partition("<!--")[0])
    flush()
    return out
