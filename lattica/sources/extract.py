"""Entities and references of one source file.

Python is read with `ast`, so its spans are exact. The other languages are read
by a scanner that blanks comments and strings, finds declarations by pattern and
their ends by matching braces; that is an approximation, good for well-formed
code: macros and code made by preprocessors are not understood.
"""

from __future__ import annotations

import ast
import heapq
import re
import tomllib
from collections.abc import Sequence
from pathlib import Path
from typing import NamedTuple


class Tag(NamedTuple):
    name: str
    node_type: str  # Container, Callable or Data; for references what is looked for
    kind: str | None
    subtype: str | None
    line: int
    span: tuple[int, int]
    definition: bool = True
    owner: str | None = None  # type that a method belongs to, if it is not around it
    decorators: tuple[str, ...] = ()
    head: str = ""  # the declaration's own line


class Rule(NamedTuple):
    """A declaration of a user's own: a pattern, by lines, whose group `n` is the name."""

    pattern: str
    node_type: str
    kind: str | None = None
    subtype: str | None = None


def load_rules(folder: str) -> dict[str, list[Rule]]:
    """Rules by language of all TOML files of a folder, in order of their names: tables [[rule]] with language, pattern, type, and kind and subtype if wanted."""
    out: dict[str, list[Rule]] = {}
    for path in sorted(Path(folder).glob("*.toml")):
        for r in tomllib.loads(path.read_text())["rule"]:
            if "n" not in re.compile(r["pattern"]).groupindex or r["type"] not in ("Container", "Callable", "Data"):
                raise ValueError(f"{path.name}: {r}")
            out.setdefault(r["language"], []).append(Rule(r["pattern"], r["type"], r.get("kind"), r.get("subtype")))
    return out


def _own(text: str, rules: Sequence[Rule]) -> list[Tag]:
    """What a user's rules find, a line each."""
    out = []
    for i, line in enumerate(text.split("\n") if rules else (), 1):
        for r in rules:
            for m in re.finditer(r.pattern, line):
                out.append(Tag(m["n"], r.node_type, r.kind, r.subtype, i, (i, i), head=line.strip()))
    return out


def extract(text: str, language: str, rules: Sequence[Rule] = ()) -> list[Tag]:
    """Tags in order of their place; broken Python is read by the scanner. What rules find comes after what the language declares."""
    return sorted([*_extract(text, language), *_own(text, rules)], key=lambda t: (t.span[0], -t.span[1], t.line))


def _extract(text: str, language: str) -> list[Tag]:
    if language == "python":
        try:
            return _python(text)
        except (SyntaxError, ValueError, RecursionError):
            pass
    return _scan(text, language)


def _python(text: str) -> list[Tag]:
    tree, lines, out = ast.parse(text), text.split("\n"), []
    head = lambda n: lines[n - 1].strip() if 0 < n <= len(lines) else ""

    def dotted(x: ast.expr) -> str:
        x = x.func if isinstance(x, ast.Call) else x
        return f"{dotted(x.value)}.{x.attr}" if isinstance(x, ast.Attribute) else x.id if isinstance(x, ast.Name) else ""

    def walk(x: ast.AST, where: str, seen: set[str]) -> None:
        for c in ast.iter_child_nodes(x):
            if isinstance(c, ast.ClassDef):
                out.append(Tag(c.name, "Container", "type", "class", c.lineno, (c.lineno, c.end_lineno), decorators=tuple(map(dotted, c.decorator_list)), head=head(c.lineno)))
                for b in c.bases:
                    if n := dotted(b).rpartition(".")[2]:
                        out.append(Tag(n, "Container", "type", None, b.lineno, (b.lineno, b.end_lineno), False))
                walk(c, "class", set())
            elif isinstance(c, (ast.FunctionDef, ast.AsyncFunctionDef)):
                kind = ("constructor" if c.name == "__init__" else "method") if where == "class" else "function"
                out.append(Tag(c.name, "Callable", kind, None, c.lineno, (c.lineno, c.end_lineno), decorators=tuple(map(dotted, c.decorator_list)), head=head(c.lineno)))
                a = c.args
                for p in [*a.posonlyargs, *a.args, *([a.vararg] if a.vararg else []), *a.kwonlyargs, *([a.kwarg] if a.kwarg else [])]:
                    if p.arg not in ("self", "cls"):
                        out.append(Tag(p.arg, "Data", "parameter", None, p.lineno, (p.lineno, p.end_lineno)))
                walk(c, "function", set())
            else:
                targets = c.targets if isinstance(c, ast.Assign) else [c.target] if isinstance(c, (ast.AnnAssign, ast.AugAssign)) else []
                for t in targets:
                    if isinstance(t, ast.Name) and where in ("module", "class") and t.id not in seen:
                        seen.add(t.id)
                        out.append(Tag(t.id, "Data", "constant" if t.id.isupper() or where == "module" else "field", None, t.lineno, (t.lineno, t.end_lineno)))
                    elif isinstance(t, ast.Attribute) and isinstance(t.value, ast.Name) and t.value.id == "self" and t.attr not in seen:
                        seen.add(t.attr)
                        out.append(Tag(t.attr, "Data", "field", None, t.lineno, (t.lineno, t.end_lineno)))
                if isinstance(c, ast.Call) and (n := dotted(c).rpartition(".")[2]):
                    out.append(Tag(n, "Callable", None, None, c.func.end_lineno, (c.lineno, c.end_lineno), False))
                walk(c, where, seen)

    walk(tree, "module", set())
    return out


_BLANK = {
    "c": re.compile(r"//[^\n]*|/\*.*?(?:\*/|\Z)|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'", re.S),
    "js": re.compile(r"//[^\n]*|/\*.*?(?:\*/|\Z)|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`", re.S),
    "go": re.compile(r"//[^\n]*|/\*.*?(?:\*/|\Z)|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`[^`]*`", re.S),
    "rust": re.compile(r"//[^\n]*|/\*.*?(?:\*/|\Z)|r#*\"(?:.*?)\"#*|b?\"(?:\\.|[^\"\\])*\"|b?'(?:\\.|[^'\\\n])'", re.S),
    "python": re.compile(r"#[^\n]*|\"\"\".*?(?:\"\"\"|\Z)|'''.*?(?:'''|\Z)|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'", re.S),
}
_N = r"(?P<n>[A-Za-z_$][\w$]*)"
_DEF = "(?:(?:export|default|declare|abstract|async|public|private|protected|internal|static|sealed|partial|virtual|override|readonly|pub(?:\\([^)]*\\))?|unsafe|extern|inline|constexpr|const|typedef|final|@[\\w.]+(?:\\([^()\n]*\\))?|#\\[[^\\]\n]*\\]|\\[[\\w.]+(?:\\([^()\n]*\\))?\\](?=\\s))\\s+)*"
#: (pattern, node type, kind, subtype, where): where is None, or the subtype or kind that must be directly around.
_RULES: dict[str, list[tuple[str, str, str, str | None, str | None]]] = {
    "js": [
        (rf"^[ \t]*{_DEF}class\s+{_N}", "Container", "type", "class", None),
        (rf"^[ \t]*{_DEF}interface\s+{_N}", "Container", "type", "interface", None),
        (rf"^[ \t]*{_DEF}enum\s+{_N}", "Container", "type", "enum", None),
        (rf"^[ \t]*{_DEF}type\s+{_N}\s*(?:<[^=]*>)?\s*=", "Container", "type", "alias", None),
        (rf"^[ \t]*{_DEF}(?:namespace|module)\s+{_N}\s*\{{", "Container", "namespace", None, None),
        (rf"^[ \t]*{_DEF}function\s*\*?\s*{_N}\s*[(<]", "Callable", "function", None, None),
        (rf"^[ \t]*{_DEF}(?:const|let|var)?\s*{_N}\s*(?::[^=\n]+)?=\s*(?:async\s*)?(?:function\b|\([^()\n]*\)\s*(?::[^=\n]+)?=>|[\w$]+\s*=>)", "Callable", "function", None, None),
        (r"^[ \t]*(?P<n>constructor)\s*\(", "Callable", "constructor", None, "class"),
        (rf"^[ \t]*{_DEF}(?:get\s+|set\s+|\*\s*|#)?{_N}\s*(?:<[^>\n]*>)?\([^;{{}}]{{0,2000}}\)\s*(?::[^={{;]{{1,500}})?\{{", "Callable", "method", None, "class"),
        (rf"^[ \t]*{_DEF}{_N}\s*(?:<[^>\n]*>)?\([^;{{}}]{{0,2000}}\)\s*:[^={{;]{{1,500}};", "Callable", "method", None, "interface"),
        (rf"^[ \t]*{_DEF}(?:#)?{_N}\s*[?!]?\s*(?::[^=;(]+)?(?:=[^=>]|;)", "Data", "field", None, "class"),
        (rf"^[ \t]*{_DEF}{_N}\s*\??\s*:", "Data", "field", None, "interface"),
        (rf"^[ \t]*{_N}\s*(?:=[^,\n]*)?,?[ \t]*$", "Data", "constant", None, "enum"),
        (rf"^(?:export\s+)?(?:const|let|var)\s+{_N}\s*(?::[^=\n]+)?=", "Data", "constant", None, "file"),
        (rf"\bthis\.{_N}\s*=[^=]", "Data", "field", None, "constructor"),
    ],
    "go": [
        (rf"^package\s+{_N}", "Container", "module", None, None),
        (rf"^[ \t]*type\s+{_N}(?:\[[^\]]*\])?\s+struct\b", "Container", "type", "struct", None),
        (rf"^[ \t]*type\s+{_N}(?:\[[^\]]*\])?\s+interface\b", "Container", "type", "interface", None),
        (rf"^[ \t]*type\s+{_N}\s+=?\s*(?!struct|interface)\S", "Container", "type", "alias", None),
        (rf"^func\s+\(\s*\w*\s*\*?(?P<o>\w+)[^)]*\)\s*{_N}\s*\(", "Callable", "method", None, None),
        (rf"^func\s+{_N}\s*[(\[]", "Callable", "function", None, None),
        (rf"^\s+{_N}\s+[\w*\[\].]+", "Data", "field", None, "struct"),
        (rf"^\s+{_N}\s*\(", "Callable", "method", None, "interface"),
        (rf"^(?:const|var)\s+{_N}", "Data", "constant", None, "file"),
    ],
    "rust": [
        (rf"^[ \t]*{_DEF}mod\s+{_N}", "Container", "module", None, None),
        (rf"^[ \t]*{_DEF}struct\s+{_N}", "Container", "type", "struct", None),
        (rf"^[ \t]*{_DEF}enum\s+{_N}", "Container", "type", "enum", None),
        (rf"^[ \t]*{_DEF}union\s+{_N}\s*\{{", "Container", "type", "union", None),
        (rf"^[ \t]*{_DEF}trait\s+{_N}", "Container", "type", "trait", None),
        (rf"^[ \t]*{_DEF}type\s+{_N}\s*(?:<[^=]*>)?\s*=", "Container", "type", "alias", None),
        (rf"^[ \t]*{_DEF}fn\s+{_N}", "Callable", "function", None, None),
        (rf"^[ \t]*macro_rules!\s*{_N}", "Callable", "macro", None, None),
        (rf"^[ \t]*{_DEF}(?:const|static)\s+(?:mut\s+)?{_N}\s*:", "Data", "constant", None, None),
        (rf"^[ \t]*{_DEF}{_N}\s*:[^:]", "Data", "field", None, "struct"),
        (rf"^[ \t]*{_N}\s*(?:[({{][^\n]*)?,?[ \t]*$", "Data", "constant", None, "enum"),
    ],
    "c": [
        (rf"^[ \t]*{_DEF}(?:inline\s+)?namespace\s+{_N}", "Container", "namespace", None, None),
        (rf"^[ \t]*(?:template\s*<[^\n]*>\s*)?{_DEF}class\s+{_N}[^;(){{}}]{{0,2000}}\{{", "Container", "type", "class", None),
        (rf"^[ \t]*(?:template\s*<[^\n]*>\s*)?{_DEF}struct\s+{_N}[^;(){{}}]{{0,2000}}\{{", "Container", "type", "struct", None),
        (rf"^[ \t]*{_DEF}union\s+{_N}\s*\{{", "Container", "type", "union", None),
        (rf"^[ \t]*{_DEF}enum\s+(?:class\s+|struct\s+)?{_N}[^;(){{}}]{{0,2000}}\{{", "Container", "type", "enum", None),
        (rf"^[ \t]*using\s+{_N}\s*=|^\}}\s*{_N.replace('?P<n>', '?P<m>')}\s*;", "Container", "type", "alias", None),
        (rf"^[ \t]*typedef\s+(?:struct\s+)?[^;{{}}()\n]{{1,500}}?[ \t*]{_N}\s*;", "Container", "type", "alias", None),
        (rf"^[ \t]*(?!(?:return|else|if|for|while|switch|case|new|delete|throw|do)\b)(?:[\w:<>,~*&]++[ \t]+)*?[*&]*(?:(?P<o>\w+)::)?(?P<n>~?\w+|operator\s*\S+)\s*\([^;{{}}]{{0,2000}}\)\s*(?:const|noexcept|override|final|\s)*(?::[^;{{]{{0,2000}})?\{{", "Callable", "function", None, None),
        (rf"^[ \t]*{_DEF}(?!(?:return|using|typedef|friend|case|goto)\b)[\w:<>, \t*&]+?[ \t*&]{_N}\s*(?:\[[^\]]*\])?\s*(?:=[^;\n]*)?;", "Data", "field", None, "struct class union"),
        (rf"^[ \t]*{_N}\s*(?:=[^,\n]*)?,?[ \t]*$", "Data", "constant", None, "enum"),
        (rf"^#\s*define\s+{_N}", "Data", "constant", None, None),
    ],
    "csharp": [
        (r"^[ \t]*namespace\s+(?P<n>[\w.]+)", "Container", "namespace", None, None),
        (rf"^[ \t]*{_DEF}class\s+{_N}", "Container", "type", "class", None),
        (rf"^[ \t]*{_DEF}struct\s+{_N}", "Container", "type", "struct", None),
        (rf"^[ \t]*{_DEF}record\s+(?:class\s+|struct\s+)?{_N}", "Container", "type", "record", None),
        (rf"^[ \t]*{_DEF}interface\s+{_N}", "Container", "type", "interface", None),
        (rf"^[ \t]*{_DEF}enum\s+{_N}", "Container", "type", "enum", None),
        (rf"^[ \t]*(?:public|private|protected|internal)\s+{_N}\s*\([^;{{}}]{{0,2000}}\)\s*(?::[^{{;]{{0,2000}})?\{{", "Callable", "constructor", None, "class struct record"),
        (rf"^[ \t]*{_DEF}(?!(?:return|new|else|if|for|while|switch|using|throw|await)\b)[\w<>\[\],.?]+\s+{_N}\s*(?:<[^>]*>)?\([^;{{}}]{{0,2000}}\)\s*(?:where[^{{;]*)?(?:\{{|=>|;)", "Callable", "method", None, "class struct record interface"),
        (rf"^[ \t]*{_DEF}[\w<>\[\],.?]+\s+{_N}\s*(?:\{{\s*(?:get|set|init|private|protected)|=>)", "Data", "property", None, "class struct record interface"),
        (rf"^[ \t]*(?:\w+\s+)*const\s+[\w<>\[\],.?]+\s+{_N}\s*=", "Data", "constant", None, "class struct record"),
        (rf"^[ \t]*(?:(?:public|private|protected|internal|static|readonly|volatile)\s+)+[\w<>\[\],.?]+\s+{_N}\s*(?:=[^>;][^;]*)?;", "Data", "field", None, "class struct record"),
        (rf"^[ \t]*{_N}\s*(?:=[^,\n]*)?,?[ \t]*$", "Data", "constant", None, "enum"),
    ],
    "python": [
        (rf"^[ \t]*class\s+{_N}", "Container", "type", "class", None),
        (rf"^[ \t]*(?:async\s+)?def\s+{_N}", "Callable", "function", None, None),
    ],
}
_FAMILY = {"javascript": "js", "typescript": "js", "tsx": "js", "cpp": "c"}
_KEYWORDS = frozenset("if for while switch catch return function new typeof sizeof else do match loop fn func def class struct enum impl await yield throw in of and or not using lock foreach case defer go select assert print super this self as mod use pub let const var static delete when base get set".split())
_CALL = re.compile(r"(?<![\w$.])(?:new\s+)?(?:[\w$]++(?:\.|::|->))*+([A-Za-z_$][\w$]*+)[ \t]*+(!?)[ \t]*+\(")
_TYPE = re.compile(r"\b(?:extends|implements|new|impl(?:<[^>]*>)?|:\s*public|:\s*private)\s+([A-Z][\w$]*)")
_IMPL = re.compile(r"^[ \t]*(?:unsafe\s+)?impl\b(?:<[^{]*?>)?\s*(?:[\w:<>, ']+?\s+for\s+)?(?P<n>[A-Za-z_]\w*)", re.M)


def _blank(m: re.Match) -> str:
    return re.sub(r"[^\n]", " ", m[0])


def _scan(text: str, language: str) -> list[Tag]:
    family = _FAMILY.get(language, language)
    if family not in _RULES:
        return []
    code = _BLANK.get(family, _BLANK["c"]).sub(_blank, text)
    starts = [0] + [m.end() for m in re.finditer("\n", code)]
    lines = text.split("\n")

    def line_of(pos: int) -> int:
        low, high = 0, len(starts)
        while low + 1 < high:
            mid = (low + high) // 2
            low, high = (mid, high) if starts[mid] <= pos else (low, mid)
        return low + 1

    close: dict[int, int] = {}
    stack: list[int] = []
    for m in re.finditer(r"[{}]", code):
        if m[0] == "{":
            stack.append(m.start())
        elif stack:
            close[stack.pop()] = m.start()

    def end_of(pos: int) -> tuple[int, int]:
        """Offsets of the body after pos: of its brace and of the brace's partner, or of the end of the statement twice."""
        m = re.compile(r"[{;]").search(code, pos)
        if m and m[0] == "{":
            return m.start(), close.get(m.start(), len(code) - 1)
        stop = m.start() if m else code.find("\n", pos)
        eol = code.find("\n", pos)
        stop = min(x for x in (stop, eol if eol >= 0 else len(code)) if x >= 0)
        return stop, stop

    found: list[tuple[int, int, int, str, str, str, str | None, str | None, str | None, int]] = []
    for pattern, node_type, kind, subtype, where in _RULES[family]:
        for m in re.finditer(pattern, code, re.M):
            group = "n" if m.groupdict().get("n") else "m"
            name = m[group]
            if not name or name in _KEYWORDS:
                continue
            body, end = end_of(m.end() - 1 if m[0].rstrip().endswith(("{", ";")) else m.end()) if node_type != "Data" and subtype != "alias" and where != "interface" else (m.end(), m.end())
            if family == "python" or (family == "go" and kind == "module") or (family == "csharp" and kind == "namespace" and ";" in code[m.end() : m.end() + 2]):
                end = len(code) - 1 if family != "python" else _indent_end(code, m.start())
            found.append((m.start(group), body, end, name, node_type, kind, subtype, where, m.groupdict().get("o"), m.start()))
    impls = [(*end_of(m.end()), m["n"]) for m in _IMPL.finditer(code)] if family == "rust" else []
    found.sort(key=lambda f: (f[0], -f[2], f[7] is not None))
    out: list[Tag] = []
    open_: list[tuple[int, int, str, str, str]] = []  # end, body, kind, subtype, name
    taken: set[int] = set()
    for pos, body, end, name, node_type, kind, subtype, where, owner, start in found:
        while open_ and open_[-1][0] < pos:
            open_.pop()
        around = (open_[-1][3] or open_[-1][2]) if open_ and open_[-1][1] < pos else "file"
        if pos in taken or (where and around not in where.split()) or (where is None and node_type == "Callable" and kind == "function" and around in ("interface",)):
            continue
        if family == "rust" and kind == "function":
            for low, high, target in impls:
                if low <= pos <= high:
                    kind, owner = "method", target
        if kind == "function" and around in ("class", "struct", "trait", "record", "interface", "union") and family != "go":
            kind = "method"
        if family == "c" and kind == "function" and owner:
            kind = "method"
        if family == "c" and kind == "method" and name == (owner or (open_[-1][4] if open_ else "")):
            kind = "constructor"
        taken.add(pos)
        line = line_of(pos)
        marks, head = _marks(lines, line_of(start), family, text[start : text.find("\n", pos) if "\n" in text[pos:] else len(text)])
        out.append(Tag(name, node_type, kind, subtype, line, (line, line_of(max(pos, end))), owner=owner, decorators=marks, head=head))
        if node_type != "Data" and end > pos:
            open_.append((end, body, kind, subtype or "", name))
        if node_type == "Callable" and family in ("js", "c") and code[body : body + 1] == "{":
            inside = re.search(r"\(([^()]*)\)", code[pos:body])
            for p in (inside[1].split(",") if inside else []):
                p = re.split(r"[:=]", p)[0] if family == "js" else p.split("=")[0]
                n = re.findall(r"[A-Za-z_$][\w$]*", p)
                if n and n[-1] not in ("void", "this") and (family == "js" or len(n) > 1):
                    out.append(Tag(n[-1], "Data", "parameter", None, line, (line, line)))
    names = {(t.name, t.line) for t in out if t.node_type == "Callable"}
    for m in _CALL.finditer(code):
        line = line_of(m.start(1))
        if m[1] not in _KEYWORDS and (m[1], line) not in names:
            out.append(Tag(m[1], "Callable", "macro" if m[2] else None, None, line, (line, line), False))
    for m in _TYPE.finditer(code):
        line = line_of(m.start(1))
        out.append(Tag(m[1], "Container", "type", None, line, (line, line), False))
    return out


_MARK = {"js": re.compile(r"@([\w.]+)(?:\((?:[^()]|\([^()]*\))*\))?\s*"), "rust": re.compile(r"#!?\[\s*([\w:]+)[^\]\n]*\]\s*"), "csharp": re.compile(r"\[\s*(?:\w+:\s*)?([\w.]+)[^\]\n]*\]\s*")}


def _marks(lines: list[str], line: int, family: str, head: str) -> tuple[tuple[str, ...], str]:
    """Decorators or attributes of a declaration that begins on a line, those above it and its own, and its head without them."""
    mark, out = _MARK.get(family), []
    if mark is None:
        return (), " ".join(head.split())
    head = head.lstrip()
    own = []
    while m := mark.match(head):
        own.append(m[1])
        head = head[m.end() :]
    i, below = line - 2, ""
    while i >= 0 and line - i < 60:
        t = lines[i].strip()
        whole = f"{t} {below}".strip()
        if t.startswith(("@", "#[", "[")) and (names := [m[1] for m in mark.finditer(whole)]) and not mark.sub("", whole):
            out, below = [*names, *out], ""
        elif t.startswith(("//", "*", "/*")) and not below:
            pass
        elif family == "js" and (below or t in (")", "})", "]})")):  # the last lines of a decorator's arguments
            below = whole
        else:
            break
        i -= 1
    return tuple(out + own), " ".join(head.split())


def _indent_end(code: str, start: int) -> int:
    """Where the block of an indented definition ends."""
    first = re.compile(r"[ \t]*").match(code, code.rfind("\n", 0, start + 1) + 1 if code[start : start + 1] != "\n" else start + 1)
    m = re.compile(rf"^[ \t]{{0,{len(first[0])}}}\S", re.M).search(code, code.find("\n", first.end()) if "\n" in code[first.end() :] else len(code))
    return m.start() - 1 if m else len(code) - 1


_PLAIN = {"c": {"static", "virtual", "inline", "const", "constexpr", "extern", "volatile", "explicit", "override"}, "csharp": {"sealed", "override", "readonly", "new"}, "rust": {"const", "mut", "unsafe", "extern"}}


def metadata(tag: Tag, language: str) -> dict:
    """What the name and the declaration tell: visibility, async, static, abstract, virtual, decorators, modifiers, scope."""
    head = tag.head.split("(")[0].split("{")[0].split("=")[0]
    words = set(re.findall(r"[a-z_]+", head))
    family = _FAMILY.get(language, language)
    out: dict = {"decorators": list(tag.decorators) or None}
    if language == "python":
        out["visibility"] = "public" if tag.name.startswith("__") and tag.name.endswith("__") else "private" if tag.name.startswith("__") else "protected" if tag.name.startswith("_") else "public"
        out["static"] = "staticmethod" in tag.decorators or None
    elif language == "go":
        out["visibility"] = "public" if tag.name[:1].isupper() else "private"
    elif language == "rust":
        out["visibility"] = "public" if "pub" in words else "private"
    else:
        out["visibility"] = next((w for w in ("public", "private", "protected", "internal") if w in words), None)
    for key in ("async", "static", "abstract", "virtual"):
        if key in words and not out.get(key):
            out[key] = True
    plain = sorted(words & _PLAIN.get(family, set()))
    out["modifiers"] = plain or None
    name = tag.name
    if language == "python" and (name.startswith(("test_", "Test")) or any("fixture" in d for d in tag.decorators)):
        out["scope"] = "fixture" if any("fixture" in d for d in tag.decorators) else "test"
    elif language == "go" and tag.node_type == "Callable":
        out["scope"] = next((s for p, s in (("Test", "test"), ("Benchmark", "benchmark"), ("Example", "example")) if name.startswith(p)), None)
    return {k: v for k, v in out.items() if v is not None}


def build_file(path: str, text: str, language: str, rules: Sequence[Rule] = ()) -> tuple[list[dict], list[dict], list[dict]]:
    """Nodes, CONTAINS and DEFINES edges, and references of a file."""
    lines = text.count("\n") + 1
    nodes = [{"id": path, "name": path.rsplit("/", 1)[-1], "node_type": "Container", "kind": "file", "subtype": None, "line": 1, "end_line": lines, "span": (1, lines), "metadata": {}}]
    edges, refs, seen = [], [], {path}
    stack: list[tuple[int, str, str]] = []  # last line, id, name
    tags = extract(text, language, rules)
    every = text.split("\n")
    spans = []
    by_name = {}
    for seq, t in enumerate(tags):
        if not t.definition:
            continue
        while stack and stack[-1][0] < t.span[0]:
            stack.pop()
        # a declaration may end on the line on which the next begins
        around = [s for s in stack if s[0] >= t.span[1]]
        parent = around[-1][1] if around else path
        if t.owner and not (around and around[-1][2] == t.owner):
            parent = by_name.get(t.owner, parent)
        id_ = f"{parent}:{t.name}"
        if re.fullmatch("<.*>", t.name):
            id_ = f"{id_}:{t.line}"
        if id_ in seen:
            continue
        seen.add(id_)
        if t.node_type == "Container":
            by_name.setdefault(t.name, id_)
        nodes.append({"id": id_, "name": t.name, "node_type": t.node_type, "kind": t.kind, "subtype": t.subtype, "line": t.line, "end_line": t.line, "span": t.span, "metadata": metadata(t, language), "seq": seq, "text": every[t.line - 1].rstrip("\r") if t.line <= len(every) else ""})
        edges.append((parent, id_, "CONTAINS"))
        if t.node_type == "Data":
            if parent != path:
                edges.append((parent, id_, "DEFINES"))
        else:
            stack = [*around, (t.span[1], id_, t.name)]
            spans.append((t.span[0], t.span[1], id_))
    # the narrowest span around each reference: spans open in order, the narrowest open one is on top
    spans.sort(key=lambda s: s[0])
    live: list[tuple[int, int, int, int, str]] = []
    i = 0
    for t in sorted((t for t in tags if not t.definition), key=lambda t: t.line):
        while i < len(spans) and spans[i][0] <= t.line:
            first, last, id_ = spans[i]
            heapq.heappush(live, (last - first, -first, i, last, id_))
            i += 1
        while live and live[0][3] < t.line:
            heapq.heappop(live)
        refs.append((t.name, live[0][4] if live else path, t.line))
    return nodes, edges, sorted(set(refs))
