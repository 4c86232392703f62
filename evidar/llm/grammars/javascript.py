"""Validity of JavaScript text, as a script or as a module.

The text is cut into tokens, every token becomes one character, and a recursive
descent parser reads that string.  Statements that end in a semicolon and blocks
are remembered by their characters and what surrounds them: programs repeat few shapes, so most of them
are looked up instead of parsed.  Those with labels or jumps to them are always parsed, since characters don't tell names.  Scopes are not followed (a name declared twice
passes); everything the grammar itself forbids is an error.
"""

from __future__ import annotations

import re

_WORDS = (
    "async await break case catch class const continue debugger default delete do else export extends finally "
    "for from function get if import in instanceof let new of return set static super switch this throw try "
    "typeof var void while with yield null true false as enum"
).split()
_SIGNS = ">>>= ... === !== **= <<= >>= >>> &&= ||= ??= => == != <= >= && || ?? ?. ++ -- += -= *= /= %= &= |= ^= << >> **".split()
_KIND = {w: chr(0xE000 + i) for i, w in enumerate(_WORDS + _SIGNS)}
W = _KIND
#: single characters of the token string: i name, n number, s string, t whole template, r regular expression,
#: p private name, x anything illegal, a space at the end; signs of one character stand for themselves
_NAME, _NUM, _STR, _TEMPLATE, _REGEX, _PRIVATE, _BAD, _END = "i", "n", "s", "t", "r", "p", "x", " "

_SKIP = r"(?:\s+|//[^\n]*|/\*[^*]*\*+(?:[^/*][^*]*\*+)*/)*"
_TOKEN = (
    r"(?:[^\W\d]|\$)[\w$]*"
    r"|\d[\w.]*(?:(?<=[eE])[+-]\d+)?|\.\d[\w]*(?:(?<=[eE])[+-]\d+)?"
    r'|"(?:[^"\\\n]|\\[\s\S])*"' r"|'(?:[^'\\\n]|\\[\s\S])*'"
    r"|`(?:[^`\\$]|\\[\s\S]|\$(?!\{)|\$\{[^`{}]*\})*`"
    r"|\#[A-Za-z_$][\w$]*"
    r"|>>>=|\.\.\.|===|!==|\*\*=|<<=|>>=|>>>|&&=|\|\|=|\?\?=|=>|==|!=|<=|>=|&&|\|\||\?\?|\?\.(?!\d)|\+\+|--"
    r"|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|>>|\*\*"
    r"|[{}()\[\];,<>+\-*/%&|^!~?:=.@]|[\s\S]|\Z"
)
_FAST = re.compile(f"({_SKIP})({_TOKEN})")
_LITERAL = re.compile(r"/(?![*/])(?:[^/\\\[\n]|\\[^\n]|\[(?:[^\]\\\n]|\\[^\n])*\])+/[A-Za-z]*")
_NUMBER = re.compile(r"(?:0[xX][\da-fA-F_]+|0[bB][01_]+|0[oO][0-7_]+|(?:\d[\d_]*)?\.?\d*[\d_]*(?:[eE][+-]?\d[\d_]*)?)n?\Z|\d[\d_]*\.(?:[eE][+-]?\d+)?\Z")
_STRING = re.compile(r'"(?:[^"\\\n]|\\[\s\S])*"' r"|'(?:[^'\\\n]|\\[\s\S])*'")
_IDENT = re.compile(r"[\w$]+\Z")
_OPEN, _CLOSE = "([{", ")]}"
_PAIR = {")": "(", "]": "[", "}": "{"}
# a slash after one of these ends a value and so divides
_VALUE_END = {_NAME, _NUM, _STR, _TEMPLATE, _REGEX, _PRIVATE, ")", "]", "}", W["this"], W["super"], W["null"], W["true"], W["false"], W["++"], W["--"]}

_SOFT = {W[w] for w in "async await from get let of set static yield as".split()}
_NAMES = {_NAME} | _SOFT
_ANY_WORD = {_NAME} | {W[w] for w in _WORDS}
_BINARY = {W[s] for s in "=== !== >>> == != <= >= && || ?? << >> ** in instanceof".split()} | set("+-*/%&|^<>")
_ASSIGN = {"="} | {W[s] for s in ">>>= **= <<= >>= &&= ||= ??= += -= *= /= %= &= |= ^=".split()}
_PREFIX = {W[s] for s in "delete void typeof ++ --".split()} | set("+-!~")


class Wrong(Exception):
    """The text isn't valid."""


class _Tokens:
    __slots__ = ("k", "nl", "holes", "pairs")

    def __init__(self, text: str):
        if text.startswith("#!"):
            text = text[text.find("\n") if "\n" in text else len(text):]
        pairs = _FAST.findall(text)
        if any(t == "/" or t == "/=" or t == "`" for _, t in pairs):
            pairs = _slow(text)
        get = W.get
        kinds, holes = [], []
        for _, t in pairs:
            k = get(t)
            if k is None:
                c = t[:1]
                if not c:
                    k = _END
                elif c in "\"'":
                    k = _STR if len(t) > 1 else _BAD
                elif c == "`":
                    k = _TEMPLATE if len(t) > 1 else _BAD
                    if "${" in t:
                        holes.append(t)
                elif c.isdigit() or (c == "." and len(t) > 1):
                    k = _NUM if _NUMBER.match(t) else _BAD
                elif c == "#":
                    k = _PRIVATE if len(t) > 1 else _BAD
                elif c == "/" and len(t) > 1:
                    k = _REGEX
                elif c in "{}()[];,<>+-*/%&|^!~?:=.@":
                    k = c
                else:
                    k = _NAME if _IDENT.match(t) and not c.isdigit() else _BAD
            kinds.append(k)
            if k is _END:
                break
        self.k = "".join(kinds)
        self.nl = "".join(["1" if "\n" in s or " " in s else "0" for s, _ in pairs[: len(kinds)]])
        self.holes, self.pairs = holes, pairs


def _hole_end(text: str, i: int) -> int:
    """End of the hole whose first character is at i, strings and templates inside it skipped; -1 if it has none."""
    depth = 1
    while i < len(text):
        c = text[i]
        if c == "`":
            i = _template_end(text, i)
            if i < 0:
                return -1
            continue
        if c in "\"'":
            m = _STRING.match(text, i)
            if not m:
                return -1
            i = m.end()
            continue
        depth += {"{": 1, "}": -1}.get(c, 0)
        i += 1
        if not depth:
            return i
    return -1


def _template_end(text: str, i: int) -> int:
    """End of the template that begins at i, with nested ones inside its holes; -1 if it has none."""
    i += 1
    while i < len(text):
        if text[i] == "\\":
            i += 2
        elif text[i] == "`":
            return i + 1
        elif text.startswith("${", i):
            i = _hole_end(text, i + 2)
            if i < 0:
                return -1
        else:
            i += 1
    return -1


def _slow(text: str) -> list[tuple[str, str]]:
    """Tokens where a slash needs its context, or a template nests."""
    out, at, last = [], 0, ""
    while True:
        m = _FAST.match(text, at)
        skip, tok = m.groups()
        begin = m.start(2)
        at = m.end()
        if tok in ("/", "/=") and last not in _VALUE_END:
            if r := _LITERAL.match(text, begin):
                tok, at = r.group(), r.end()
        elif tok == "`" and (e := _template_end(text, begin)) > 0:
            tok, at = text[begin:e], e
        out.append((skip, tok))
        if not tok:
            return out
        c = tok[0]
        last = W.get(tok) or (_STR if c in "\"'`" else _NUM if c.isdigit() else _REGEX if c == "/" and len(tok) > 2 else tok if c in "{}()[];,<>+-*/%&|^!~?:=.@" and len(tok) == 1 else _NAME)


def _holes(template: str) -> list[str]:
    """The expressions inside a template."""
    out, i = [], 1
    while i < len(template) - 1:
        if template[i] == "\\":
            i += 2
        elif template.startswith("${", i):
            end = _hole_end(template, i + 2)
            if end < 0:
                raise Wrong
            out.append(template[i + 2: end - 1])
            i = end
        else:
            i += 1
    return out


_LIMIT = 200_000
_statements: set[str] = set()
_blocks: set[tuple] = set()
_expressions: dict[str, bool] = {}


class _Parser:
    def __init__(self, text: str):
        t = _Tokens(text)
        self.k, self.nl, self.pairs = t.k, t.nl, t.pairs
        if _BAD in self.k:
            raise Wrong
        for h in t.holes:
            for e in _holes(h):
                if not _expression_ok(e):
                    raise Wrong
        self.match: dict[int, int] = {}
        stack = []
        for i, c in enumerate(self.k):
            if c in _OPEN:
                stack.append(i)
            elif c in _CLOSE:
                if not stack or self.k[stack[-1]] != _PAIR[c]:
                    raise Wrong
                self.match[stack.pop()] = i
        if stack:
            raise Wrong
        self.cover = -1
        self.fn = self.loop = self.switch = 0
        #: open labels, and whether each is a loop's; labels and jumps to them read so far
        self.labels: dict[str, bool] = {}
        self.named = 0
        self.no_in = False

    # ---- helpers: every method takes a position and returns the one after what it read
    def want(self, i: int, c: str) -> int:
        if self.k[i] != c:
            raise Wrong
        return i + 1

    def name(self, i: int) -> int:
        if self.k[i] not in _NAMES:
            raise Wrong
        return i + 1

    def semi(self, i: int) -> int:
        c = self.k[i]
        if c == ";":
            return i + 1
        if c == "}" or c == _END or self.nl[i] == "1":
            return i
        raise Wrong

    def program(self) -> None:
        i, k = 0, self.k
        while k[i] != _END:
            i = self.item(i)

    def item(self, i: int) -> int:
        c, k = self.k[i], self.k
        if c == W["import"] and k[i + 1] not in "(.":
            return self.imports(i + 1)
        if c == W["export"]:
            return self.exports(i + 1)
        return self.statement(i, True)

    def imports(self, i: int) -> int:
        k = self.k
        if k[i] == _STR:
            return self.semi(i + 1)
        while True:
            if k[i] == "*":
                i = self.name(self.want(i + 1, W["as"]))
            elif k[i] == "{":
                i = self.specifiers(i, False)
            else:
                i = self.name(i)
            if k[i] != ",":
                break
            i += 1
        i = self.want(self.want(i, W["from"]), _STR)
        if k[i] == W["with"] and k[i + 1] == "{":
            i = self.match[i + 1] + 1
        return self.semi(i)

    def specifiers(self, i: int, strings: bool) -> int:
        k, i = self.k, i + 1
        while k[i] != "}":
            if k[i] not in _ANY_WORD and k[i] != _STR:
                raise Wrong
            i += 1
            if k[i] == W["as"]:
                i += 1
                if k[i] not in _ANY_WORD and k[i] != _STR:
                    raise Wrong
                i += 1
            if k[i] == ",":
                i += 1
            elif k[i] != "}":
                raise Wrong
        return i + 1

    def exports(self, i: int) -> int:
        k, c = self.k, self.k[i]
        if c == W["default"]:
            i += 1
            if k[i] == W["function"] or (k[i] == W["async"] and k[i + 1] == W["function"] and self.nl[i + 1] == "0"):
                return self.function(i + (k[i] == W["async"]), False)
            if k[i] == W["class"]:
                return self.klass(i, False)
            return self.semi(self.assign(i))
        if c == "*":
            i += 1
            if k[i] == W["as"]:
                i += 2
            return self.semi(self.want(self.want(i, W["from"]), _STR))
        if c == "{":
            i = self.specifiers(i, True)
            if k[i] == W["from"]:
                i = self.want(i + 1, _STR)
            return self.semi(i)
        if c in (W["var"], W["let"], W["const"], W["function"], W["class"], W["async"]):
            return self.statement(i, True)
        raise Wrong

    def block(self, i: int) -> int:
        k = self.k
        if k[i] != "{":
            raise Wrong
        end = self.match[i]
        key = (k[i + 1: end], self.nl[i + 1: end], self.fn > 0, self.loop > 0, self.switch > 0)
        if key not in _blocks:
            saved, self.no_in, named = self.no_in, False, self.named
            j = i + 1
            while j < end:
                j = self.statement(j, True)
            self.no_in = saved
            if j != end:
                raise Wrong
            if named == self.named:
                if len(_blocks) > _LIMIT:
                    _blocks.clear()
                _blocks.add(key)
        return end + 1

    def statement(self, i: int, declare: bool = False) -> int:
        k = self.k
        c = k[i]
        if c == "{":
            return self.block(i)
        if c == ";":
            return i + 1
        end = k.find(";", i)
        key = ""
        if 0 < end < i + 60:
            key = k[i: end + 1]
            if "{" not in key or self.balanced(i, end):
                key += self.nl[i + 1: end + 1] + ("f" if self.fn else "") + ("l" if self.loop else "") + ("s" if self.switch else "") + ("d" if declare else "")
                if key in _statements:
                    return end + 1
            else:
                key = ""
        named = self.named
        j = self.slow_statement(i, c, declare)
        if key and j == end + 1 and named == self.named:
            if len(_statements) > _LIMIT:
                _statements.clear()
            _statements.add(key)
        return j

    def balanced(self, i: int, end: int) -> bool:
        k = self.k
        while True:
            i = k.find("{", i, end)
            if i < 0:
                return True
            i = self.match[i]
            if i > end:
                return False

    def slow_statement(self, i: int, c: str, declare: bool) -> int:
        k = self.k
        if c == W["var"] or c == W["const"] or (c == W["let"] and (k[i + 1] in _NAMES or k[i + 1] in "[{")):
            if c != W["var"] and not declare:
                raise Wrong
            return self.semi(self.declarations(i + 1, c == W["const"]))
        if c == W["function"] or (c == W["async"] and k[i + 1] == W["function"] and self.nl[i + 1] == "0"):
            if not declare:
                raise Wrong
            return self.function(i + (c == W["async"]), True)
        if c == W["class"] or c == "@":
            if not declare:
                raise Wrong
            return self.klass(self.decorators(i), True)
        if c == W["if"]:
            i = self.statement(self.paren(i + 1))
            return self.statement(i + 1) if k[i] == W["else"] else i
        if c == W["for"]:
            return self.for_(i + 1)
        if c == W["while"]:
            return self.body(self.paren(i + 1))
        if c == W["do"]:
            i = self.paren(self.want(self.body(i + 1), W["while"]))
            return i + 1 if k[i] == ";" else i
        if c == W["return"]:
            if not self.fn:
                raise Wrong
            i += 1
            return i + 1 if k[i] == ";" else i if k[i] in "} " or self.nl[i] == "1" else self.semi(self.expression(i))
        if c == W["break"] or c == W["continue"]:
            i += 1
            if k[i] in _NAMES and self.nl[i] == "0":
                self.named += 1
                label = self.pairs[i][1]
                if label not in self.labels or (c == W["continue"] and not self.labels[label]):
                    raise Wrong
                return self.semi(i + 1)
            if not self.loop and not (c == W["break"] and self.switch):
                raise Wrong
            return self.semi(i)
        if c == W["throw"]:
            if self.nl[i + 1] == "1":
                raise Wrong
            return self.semi(self.expression(i + 1))
        if c == W["try"]:
            i = self.block(i + 1)
            if k[i] not in (W["catch"], W["finally"]):
                raise Wrong
            if k[i] == W["catch"]:
                i += 1
                if k[i] == "(":
                    i = self.want(self.binding(i + 1), ")")
                i = self.block(i)
            return self.block(i + 1) if k[i] == W["finally"] else i
        if c == W["switch"]:
            return self.switch_(i + 1)
        if c == W["debugger"]:
            return self.semi(i + 1)
        if c == W["with"]:
            return self.statement(self.paren(i + 1))
        if (c in _NAMES) and k[i + 1] == ":":
            self.named += 1
            label, j = self.pairs[i][1], i + 2
            if label in self.labels:
                raise Wrong
            while k[j] in _NAMES and k[j + 1] == ":":
                j += 2
            self.labels[label] = k[j] in (W["for"], W["while"], W["do"])
            i = self.statement(i + 2, declare)
            del self.labels[label]
            return i
        return self.semi(self.expression(i))

    def body(self, i: int) -> int:
        self.loop += 1
        i = self.statement(i)
        self.loop -= 1
        return i

    def paren(self, i: int) -> int:
        saved, self.no_in = self.no_in, False
        i = self.want(self.expression(self.want(i, "(")), ")")
        self.no_in = saved
        return i

    def switch_(self, i: int) -> int:
        k = self.k
        i = self.want(self.paren(i), "{")
        self.switch += 1
        defaults = 0
        while k[i] != "}":
            if k[i] == W["case"]:
                i = self.want(self.expression(i + 1), ":")
            elif k[i] == W["default"] and not defaults:
                defaults, i = 1, self.want(i + 1, ":")
            else:
                raise Wrong
            while k[i] not in (W["case"], W["default"], "}"):
                i = self.statement(i, True)
        self.switch -= 1
        return i + 1

    def for_(self, i: int) -> int:
        k = self.k
        if k[i] == W["await"]:
            i += 1
        i = self.want(i, "(")
        saved, self.no_in = self.no_in, True
        if k[i] == ";":
            pass
        elif k[i] in (W["var"], W["const"], W["let"]) and not (k[i] == W["let"] and k[i + 1] in (W["of"], W["in"], "=", ";", ".")):
            j = self.binding(i + 1)
            if k[j] in (W["of"], W["in"]):
                i = j
            else:
                i = self.declarations(i + 1, k[i] == W["const"])
        else:
            mark = self.cover
            i, kind = self.left(i)
            if k[i] in (W["of"], W["in"]):
                if kind not in ("ref", "pattern"):
                    raise Wrong
                self.cover = mark
            else:
                if k[i] in _ASSIGN:
                    i = self.after_left(i, kind, mark)
                while k[i] == ",":
                    i = self.assign(i + 1)
        self.no_in = False
        if k[i] in (W["of"], W["in"]):
            i = self.assign(i + 1) if k[i] == W["of"] else self.expression(i + 1)
        else:
            i = self.want(i, ";")
            if k[i] != ";":
                i = self.expression(i)
            i = self.want(i, ";")
            if k[i] != ")":
                i = self.expression(i)
        self.no_in = saved
        return self.body(self.want(i, ")"))

    def declarations(self, i: int, const: bool) -> int:
        k = self.k
        while True:
            pattern = k[i] in "[{"
            i = self.binding(i)
            if k[i] == "=":
                i = self.assign(i + 1)
            elif pattern or const:
                raise Wrong
            if k[i] != ",":
                return i
            i += 1

    def binding(self, i: int) -> int:
        """A name or a pattern that declares names."""
        k, c = self.k, self.k[i]
        if c == "[":
            i += 1
            while k[i] != "]":
                if k[i] == ",":
                    i += 1
                    continue
                rest = k[i] == W["..."]
                i = self.binding(i + rest)
                if k[i] == "=" and not rest:
                    i = self.assign(i + 1)
                if k[i] == "," and not rest:
                    i += 1
                elif k[i] != "]":
                    raise Wrong
            return i + 1
        if c == "{":
            i += 1
            while k[i] != "}":
                if k[i] == W["..."]:
                    i = self.name(i + 1)
                    if k[i] != "}":
                        raise Wrong
                    break
                first = k[i]
                i = self.key(i)
                if k[i] == ":":
                    i = self.binding(i + 1)
                elif first not in _NAMES:
                    raise Wrong
                if k[i] == "=":
                    i = self.assign(i + 1)
                if k[i] == ",":
                    i += 1
                elif k[i] != "}":
                    raise Wrong
            return i + 1
        return self.name(i)

    def key(self, i: int) -> int:
        k, c = self.k, self.k[i]
        if c == "[":
            saved, self.no_in = self.no_in, False
            i = self.want(self.assign(i + 1), "]")
            self.no_in = saved
            return i
        if c in _ANY_WORD or c == _STR or c == _NUM or c == _PRIVATE:
            return i + 1
        raise Wrong

    def params(self, i: int) -> int:
        k = self.k
        i = self.want(i, "(")
        saved, self.no_in = self.no_in, False
        while k[i] != ")":
            rest = k[i] == W["..."]
            i = self.binding(i + rest)
            if k[i] == "=" and not rest:
                i = self.assign(i + 1)
            if k[i] == "," and not rest:
                i += 1
            elif k[i] != ")":
                raise Wrong
        self.no_in = saved
        return i + 1

    def code(self, i: int) -> int:
        """A function's body."""
        saved = self.fn, self.loop, self.switch, self.labels
        self.fn, self.loop, self.switch, self.labels = 1, 0, 0, {}
        i = self.block(i)
        self.fn, self.loop, self.switch, self.labels = saved
        return i

    def function(self, i: int, named: bool) -> int:
        i = self.want(i, W["function"])
        if self.k[i] == "*":
            i += 1
        if named or self.k[i] in _NAMES:
            i = self.name(i)
        return self.code(self.params(i))

    def decorators(self, i: int) -> int:
        while self.k[i] == "@":
            i = self.unary(i + 1)[0]
        return i

    def klass(self, i: int, named: bool) -> int:
        k = self.k
        i = self.want(i, W["class"])
        if named or k[i] in _NAMES:
            i = self.name(i)
        if k[i] == W["extends"]:
            i = self.unary(i + 1)[0]
        end = self.match[self.want(i, "{") - 1]
        return self.members(i + 1, end) + 1

    def members(self, i: int, end: int) -> int:
        k = self.k
        saved, self.no_in = self.no_in, False
        while i < end:
            if k[i] == ";":
                i += 1
                continue
            i = self.decorators(i)
            stop = ("(", "=", ";", "}")
            if k[i] == W["static"] and k[i + 1] not in stop:
                i += 1
                if k[i] == "{":
                    i = self.code(i)
                    continue
            if k[i] == W["async"] and k[i + 1] not in stop and self.nl[i + 1] == "0":
                i += 1
                i += k[i] == "*"
            elif k[i] == "*" or (k[i] in (W["get"], W["set"]) and k[i + 1] not in stop):
                i += 1
            i = self.key(i)
            if k[i] == "(":
                i = self.code(self.params(i))
            else:
                if k[i] == "=":
                    fn, self.fn = self.fn, 0
                    i = self.assign(i + 1)
                    self.fn = fn
                i = self.semi(i)
        self.no_in = saved
        if i != end:
            raise Wrong
        return i

    # ---- expressions
    def expression(self, i: int) -> int:
        i = self.assign(i)
        while self.k[i] == ",":
            i = self.assign(i + 1)
        return i

    def assign(self, i: int) -> int:
        k, c = self.k, self.k[i]
        if c == W["yield"] and self.fn and k[i + 1] not in _ASSIGN:
            i += 1
            if k[i] == "*":
                return self.assign(i + 1)
            return i if k[i] in ")]},;: " or self.nl[i] == "1" else self.assign(i)
        # arrow functions
        j = i
        if c == W["async"] and self.nl[i + 1] == "0" and (k[i + 1] in _NAMES or k[i + 1] == "("):
            j = i + 1
        if k[j] in _NAMES and k[j + 1] == W["=>"]:
            return self.arrow(j + 2)
        if k[j] == "(" and k[self.match[j] + 1] == W["=>"]:
            return self.arrow(self.params(j) + 1)
        mark = self.cover
        i, kind = self.left(i)
        return self.after_left(i, kind, mark)

    def after_left(self, i: int, kind: str, mark: int) -> int:
        k = self.k
        if k[i] in _ASSIGN:
            if kind == "ref" or (kind == "pattern" and k[i] == "="):
                self.cover = mark
                return self.assign(i + 1)
            raise Wrong
        if self.cover != mark and not (kind == "pattern" and k[i] in ",)]}" or k[i] == W["of"] or k[i] == W["in"]):
            raise Wrong
        if kind != "pattern" and self.cover != mark:
            raise Wrong
        return i

    def arrow(self, i: int) -> int:
        if self.k[i] == "{":
            return self.code(i)
        saved = self.fn
        self.fn = 1
        i = self.assign(i)
        self.fn = saved
        return i

    def left(self, i: int) -> tuple[int, str]:
        """A conditional expression and what it is: ref, pattern or other."""
        k = self.k
        i, kind = self.unary(i)
        c = k[i]
        if c not in _BINARY and c != "?":
            return i, kind
        while c in _BINARY:
            if c == W["in"] and self.no_in:
                break
            i = self.unary(i + 1)[0]
            c, kind = k[i], "other"
        if c == "?":
            saved, self.no_in = self.no_in, False
            i = self.want(self.assign(i + 1), ":")
            self.no_in = saved
            i, kind = self.assign(i), "other"
        return i, kind

    def unary(self, i: int) -> tuple[int, str]:
        k, c = self.k, self.k[i]
        if c in _PREFIX:
            i, kind = self.unary(i + 1)
            if c in (W["++"], W["--"]) and kind != "ref":
                raise Wrong
            return i, "other"
        if c == W["await"] and (k[i + 1] not in ")]},;:=.? " and k[i + 1] not in _BINARY or k[i + 1] in "+-[("):
            return self.unary(i + 1)[0], "other"
        i, kind = self.postfix(i)
        if k[i] in (W["++"], W["--"]) and self.nl[i] == "0":
            if kind != "ref":
                raise Wrong
            return i + 1, "other"
        return i, kind

    def postfix(self, i: int) -> tuple[int, str]:
        k, c = self.k, self.k[i]
        if c == W["new"]:
            i, kind = self.new(i + 1)
        else:
            i, kind = self.primary(i)
        while True:
            c = k[i]
            if c == ".":
                if k[i + 1] not in _ANY_WORD and k[i + 1] != _PRIVATE:
                    raise Wrong
                i, kind = i + 2, "ref"
            elif c == "(":
                i, kind = self.arguments(i), "other"
            elif c == "[":
                i, kind = self.index(i), "ref"
            elif c == W["?."]:
                n = k[i + 1]
                i = self.arguments(i + 1) if n == "(" else self.index(i + 1) if n == "[" else i + 2
                if n not in "([" and n not in _ANY_WORD and n != _PRIVATE:
                    raise Wrong
                kind = "other"
            elif c == "t":
                i, kind = i + 1, "other"
            else:
                return i, kind

    def new(self, i: int) -> tuple[int, str]:
        k = self.k
        if k[i] == ".":
            return self.want(i + 1, _NAME), "other"
        i = self.new(i + 1)[0] if k[i] == W["new"] else self.primary(i)[0]
        while k[i] in ".[":
            if k[i] == "[":
                i = self.index(i)
            else:
                if k[i + 1] not in _ANY_WORD and k[i + 1] != _PRIVATE:
                    raise Wrong
                i += 2
        return (self.arguments(i) if k[i] == "(" else i), "other"

    def index(self, i: int) -> int:
        saved, self.no_in = self.no_in, False
        i = self.want(self.expression(i + 1), "]")
        self.no_in = saved
        return i

    def arguments(self, i: int) -> int:
        k, i = self.k, i + 1
        saved, self.no_in, mark = self.no_in, False, self.cover
        while k[i] != ")":
            i = self.assign(i + (k[i] == W["..."]))
            if k[i] == ",":
                i += 1
            elif k[i] != ")":
                raise Wrong
        if self.cover != mark:
            raise Wrong
        self.no_in = saved
        return i + 1

    def primary(self, i: int) -> tuple[int, str]:
        k, c = self.k, self.k[i]
        if c == W["async"] and k[i + 1] == W["function"] and self.nl[i + 1] == "0":
            return self.function(i + 1, False), "other"
        if c in _NAMES:
            return i + 1, "ref"
        if c in (_STR, _NUM, _TEMPLATE, _REGEX) or c in (W["this"], W["null"], W["true"], W["false"]):
            return i + 1, "other"
        if c == "(":
            mark = self.cover
            saved, self.no_in = self.no_in, False
            j, kind = self.left(i + 1) if k[i + 1] not in (W["async"], W["yield"], "(") and k[i + 2] != W["=>"] else (self.assign(i + 1), "other")
            if kind != "other" or k[j] in _ASSIGN:
                alone = k[j] == ")"
                j = self.after_left(j, kind, mark) if k[j] in _ASSIGN else j
                kind = kind if alone else "other"
            while k[j] == ",":
                j, kind = self.assign(j + 1), "other"
            self.no_in = saved
            if self.cover != mark:
                raise Wrong
            return self.want(j, ")"), "ref" if kind == "ref" else "other"
        if c == "[":
            saved, self.no_in = self.no_in, False
            i += 1
            while k[i] != "]":
                if k[i] == ",":
                    i += 1
                    continue
                i = self.assign(i + (k[i] == W["..."]))
                if k[i] == ",":
                    i += 1
                elif k[i] != "]":
                    raise Wrong
            self.no_in = saved
            return i + 1, "pattern"
        if c == "{":
            return self.object(i), "pattern"
        if c == W["function"]:
            return self.function(i, False), "other"
        if c == W["class"]:
            return self.klass(i, False), "other"
        if c == W["super"] and k[i + 1] in ".[(":
            return i + 1, "other"
        if c == W["import"] and k[i + 1] in "(.":
            return (i + 1 if k[i + 1] == "(" else i + 3), "other"
        if c == _PRIVATE and k[i + 1] == W["in"]:
            return i + 1, "other"
        if c == "@":
            return self.klass(self.decorators(i), False), "other"
        raise Wrong

    def object(self, i: int) -> int:
        k, i = self.k, i + 1
        saved, self.no_in = self.no_in, False
        while k[i] != "}":
            if k[i] == W["..."]:
                i = self.assign(i + 1)
            else:
                stop = ("(", ":", ",", "}", "=")
                method = False
                if k[i] == W["async"] and k[i + 1] not in stop and self.nl[i + 1] == "0":
                    i, method = i + 1, True
                    i += k[i] == "*"
                elif k[i] == "*" or (k[i] in (W["get"], W["set"]) and k[i + 1] not in stop):
                    i, method = i + 1, True
                first = k[i]
                i = self.key(i)
                if k[i] == "(":
                    i = self.code(self.params(i))
                elif method:
                    raise Wrong
                elif k[i] == ":":
                    i = self.assign(i + 1)
                elif first not in _NAMES:
                    raise Wrong
                elif k[i] == "=":
                    i = self.assign(i + 1)
                    self.cover = i
            if k[i] == ",":
                i += 1
            elif k[i] != "}":
                raise Wrong
        self.no_in = saved
        return i + 1


def _expression_ok(text: str) -> bool:
    known = _expressions.get(text)
    if known is None:
        try:
            p = _Parser(text)
            p.fn = 1
            known = p.k[p.expression(0)] == _END
        except (Wrong, IndexError):
            known = False
        if len(_expressions) > _LIMIT:
            _expressions.clear()
        _expressions[text] = known
    return known


def parses(text: str, member: bool = False, alone: bool = False) -> bool:
    """Whether ``text`` is a script or module; with ``member`` the body of a class."""
    try:
        p = _Parser(text)
        if member:
            p.members(0, len(p.k) - 1)
        else:
            p.program()
        return True
    except (Wrong, IndexError):
        return False
