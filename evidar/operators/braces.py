"""Elements and imports of languages with braces: JavaScript and Swift.

A text is first blanked: comments, strings and templates become spaces of the same
length, so that braces and words left over are code.  Definitions are then found by
their heads, and end where their braces do.
"""

from __future__ import annotations

import posixpath
import re
from bisect import bisect_left

_BLANK = {
    "javascript": re.compile(r"//[^\n]*|/\*[\s\S]*?\*/|'(?:[^'\\\n]|\\.)*'|\"(?:[^\"\\\n]|\\.)*\"|`(?:[^`\\]|\\[\s\S])*`"),
    "swift": re.compile(r'//[^\n]*|/\*[\s\S]*?\*/|"""[\s\S]*?"""|"(?:[^"\\\n]|\\.)*"'),
}
_WORDS = frozenset("if for while switch catch function return with guard else do repeat await typeof new in super".split())
_JS_CLASS = re.compile(r"\bclass\s+([A-Za-z_$][\w$]*)(?:\s+extends\s+([\w$.]+))?[^{;]*\{")
_JS_FUNCTION = re.compile(
    r"\b(?:async\s+)?function\s*\*?\s*([A-Za-z_$][\w$]*)\s*\("
    r"|\b(?:const|let|var)\s+([A-Za-z_$][\w$]*)\s*=\s*(?:async\s*)?(?:function\b[^(]*\(|\([^()]*\)\s*=>|[A-Za-z_$][\w$]*\s*=>)"
    r"|(?<![\w$.])([A-Za-z_$][\w$]*)\s*=\s*(?:async\s+)?function\b[^(]*\("
)
_JS_METHOD = re.compile(r"(?<![\w$.])(?:static\s+|async\s+|get\s+|set\s+|\*\s*|#)*([A-Za-z_$][\w$]*)\s*\(")
_JS_IMPORT = re.compile(r"\bimport\s+(?:[\w$*{},\s]+?\s+from\s+)?([\"'])([^\"'\n]+)\1|\brequire\(\s*([\"'])([^\"'\n]+)\3\s*\)|\bexport\s+[\w$*{},\s]+?\s+from\s+([\"'])([^\"'\n]+)\5")
_SWIFT_TYPE = re.compile(r"\b(?:class|struct|enum|protocol|extension|actor)\s+([A-Z][\w.]*)[^{};\n]*\{")
_SWIFT_FUNCTION = re.compile(r"\bfunc\s+([A-Za-z_]\w*|[-+*/=<>!&|^~%]+)|\b(init|deinit)\b\s*[?!]?\s*(?=[({<])")
_SWIFT_IMPORT = re.compile(r"(?m)^\s*import\s+(?:class\s+|struct\s+|func\s+)?([\w.]+)")


def blanked(text: str, language: str) -> str:
    """The text with comments and strings as spaces; line ends stay."""
    return _BLANK[language].sub(lambda m: re.sub(r"[^\n]", " ", m.group()), text)


def _pairs(code: str) -> dict[int, int]:
    """Where each opening bracket is closed."""
    opened: list[tuple[str, int]] = []
    ends: dict[int, int] = {}
    for m in re.finditer(r"[{}()\[\]]", code):
        c = m.group()
        if c in "{([":
            opened.append((c, m.start()))
        else:
            want = {"}": "{", ")": "(", "]": "["}[c]
            while opened and opened[-1][0] != want:
                opened.pop()
            if opened:
                ends[opened.pop()[1]] = m.start()
    return ends


def _read(path: str, text: str, module: str, language: str, types: re.Pattern, functions: list[re.Pattern]) -> tuple[list[tuple], list[tuple]]:
    code = blanked(text, language)
    ends, breaks = _pairs(code), [m.start() for m in re.finditer("\n", text)]
    line = lambda at: bisect_left(breaks, at) + 1
    found = []  # (begin, end, label, name, base)
    for m in types.finditer(code):
        end = ends.get(m.end() - 1)
        if end is not None:
            found.append((m.start(), end, "Class", m.group(1), m.group(2) if m.re.groups > 1 else None))
    for pattern in functions:
        for m in pattern.finditer(code):
            name = next((g for g in m.groups() if g), None)
            if not name or name in _WORDS:
                continue
            end = _body(code, m, ends, pattern is _JS_METHOD)
            if end is not None:
                found.append((m.start(), end, "Function", name, None))
    found = sorted({x[0]: x for x in reversed(found)}.values(), key=lambda x: (x[0], -x[1]))
    nodes: list[tuple] = [(module, "Module", path, path, 1, text.count("\n") + 1, None, None)]
    refs: list[tuple] = []
    stack: list[tuple[int, str, str]] = []
    for begin, end, label, name, base in found:
        while stack and stack[-1][0] < begin:
            stack.pop()
        outer, kind = (stack[-1][1], stack[-1][2]) if stack else (module, "Module")
        me = f"{module}:{name}" if label == "Class" else f"{outer}:{name}"
        start = line(begin)
        first = text.rfind("\n", 0, begin) + 1
        head = text[first:begin]
        nodes.append((me, label, name, path, start, line(end), start, len(head) - len(head.lstrip())))
        refs.append((outer, "defines", me, None, start))
        if base:
            refs.append((me, "inherits", base.rsplit(".", 1)[-1], None, start))
        stack.append((end, me, label))
    return nodes, list(dict.fromkeys(refs))


def _body(code: str, m: re.Match, ends: dict[int, int], method: bool) -> int | None:
    """Where a function's body ends; None for a call or a declaration without one."""
    at = m.end()
    if code[at - 1] == "(":
        close = ends.get(at - 1)
        if close is None:
            return None
        at = close + 1
    elif not code[m.start():at].rstrip().endswith("=>"):
        opened = re.compile(r"\s*(?:<[^>]*>)?\s*\(").match(code, at)
        if opened:
            close = ends.get(opened.end() - 1)
            at = close + 1 if close is not None else at
    rest = re.compile(r"\s*\{" if method else r"[^{};\n]*\{|\s*=>\s*\{").match(code, at)
    if rest:
        return ends.get(rest.end() - 1)
    if "=>" in m.group():  # an expression for a body
        stop = re.compile(r"[^;\n]*").match(code, at)
        return stop.end()
    return None


def read_javascript(path: str, text: str, module: str) -> tuple[list[tuple], list[tuple]]:
    """Elements and references of a JavaScript file: classes, functions, methods, imports of both kinds with relative paths made dotted."""
    nodes, refs = _read(path, text, module, "javascript", _JS_CLASS, [_JS_FUNCTION, _JS_METHOD])
    code = blanked(text, "javascript")
    for m in _JS_IMPORT.finditer(text):
        if code[m.start()] == " ":
            continue
        name = next(m.group(i) for i in (2, 4, 6) if m.group(i))
        if name.startswith("."):
            name = posixpath.normpath(posixpath.join(posixpath.dirname(path), name))
        refs.append((module, "imports", re.sub(r"\.m?js$", "", name).strip("/").replace("/", "."), None, text.count("\n", 0, m.start()) + 1))
    return nodes, list(dict.fromkeys(refs))


def read_swift(path: str, text: str, module: str) -> tuple[list[tuple], list[tuple]]:
    """Elements and imported modules of a Swift file; an extension counts as the type it extends."""
    nodes, refs = _read(path, text, module, "swift", _SWIFT_TYPE, [_SWIFT_FUNCTION])
    code = blanked(text, "swift")
    refs += [(module, "imports", m.group(1), None, text.count("\n", 0, m.start()) + 1) for m in _SWIFT_IMPORT.finditer(code)]
    return list(dict.fromkeys(nodes)), list(dict.fromkeys(refs))
