"""Validity of Swift text under the grammar of the language's public reference.

Works as the checker for JavaScript does: tokens become characters, a recursive
descent parser reads them, and blocks seen before are looked up.  Types and
operators are read without resolving names or precedences.
"""

from __future__ import annotations

import re

_WORDS = (
    "import class struct enum protocol extension actor func var let init deinit subscript typealias associatedtype "
    "operator precedencegroup if else guard while repeat for in where switch case default return break continue "
    "fallthrough throw throws rethrows do catch defer try await async as is nil true false self Self super Any inout "
    "public private internal fileprivate open static final override mutating nonmutating lazy weak unowned required "
    "convenience dynamic optional indirect nonisolated isolated some any get set willSet didSet prefix postfix infix"
).split()
_SIGNS = "-> ... ..< ?? == != <= >= && || += -= *= /= %= === !== << >> &+ &- &* ~= |= &= ^=".split()
W = {w: chr(0xE000 + i) for i, w in enumerate(_WORDS + _SIGNS)}

_TOKEN = (
    r'"""[\s\S]*?(?<!\\)"""'
    r'|\#"[^\n]*?"\#'
    r'|"(?:[^"\\\n]|\\\((?:[^()"\n]|\((?:[^()\n])*\)|"[^"\n]*")*\)|\\[^(\n])*"'
    r"|`\w+`|[^\W\d]\w*|\$\d+|\d[\w]*(?:\.\d[\w]*)?(?:(?<=[eE])[+-]\d+)?|\#\w+"
    r"|->|\.\.\.|\.\.<|===|!==|==|!=|<=|>=|&&|\|\||\?\?|\+=|-=|\*=|/=|%=|~=|\|=|&=|\^=|<<|&\+|&-|&\*"
    r"|[{}()\[\];,:.@=<>+\-*/%&|^!~?\\]|[\s\S]|\Z"
)
_FAST = re.compile(rf"((?:\s+|//[^\n]*|/\*[^*]*\*+(?:[^/*][^*]*\*+)*/)*)({_TOKEN})")
_NAME, _NUM, _STR, _HASH, _BAD, _END = "i", "n", "s", "h", "x", " "
_PAIR = {")": "(", "]": "[", "}": "{"}
_MODIFIERS = {
    W[w] for w in "public private internal fileprivate open static final override mutating nonmutating lazy weak unowned required "
    "convenience dynamic optional indirect nonisolated isolated prefix postfix infix".split()
}
_SOFT = {
    W[w] for w in "actor associatedtype async await get set willSet didSet prefix postfix infix open final override mutating nonmutating "
    "lazy weak unowned required convenience dynamic optional indirect nonisolated isolated some any operator precedencegroup".split()
    if w not in ("associatedtype", "operator", "precedencegroup")
}
_NAMES = {_NAME} | _SOFT
_LABEL = _NAMES | {W[w] for w in _WORDS if w not in ("inout", "var", "let")}
_BINARY = {W[s] for s in _SIGNS if s != "->"} | set("+-*/%&|^<>~=")
_DECLARES = {W[w] for w in "import class struct enum protocol extension func var let init deinit subscript typealias associatedtype operator precedencegroup case".split()}
_NOT_STATEMENT = set(")]},:.=")


class Wrong(Exception):
    """The text isn't valid."""


_LIMIT = 100_000
_blocks: set[tuple] = set()


class _Parser:
    def __init__(self, text: str):
        get = W.get
        kinds, nl, glue = [], [], []
        for skip, t in _FAST.findall(text):
            k = get(t)
            if k is None:
                c = t[:1]
                if not c:
                    k = _END
                elif c == '"' or t.startswith('#"'):
                    k = _STR if len(t) > 1 else _BAD
                elif c.isdigit():
                    k = _NUM
                elif c == "#":
                    k = _HASH if len(t) > 1 else _BAD
                elif c in "{}()[];,:.@=<>+-*/%&|^!~?\\":
                    k = c
                elif c == "`" or c == "$" or c == "_" or c.isalpha():
                    k = _NAME if len(t) > 1 or c not in "`$" else _BAD
                else:
                    k = _BAD
            kinds.append(k)
            nl.append("2" if "\n" in skip else "1" if skip else "0")
            if k is _END:
                break
        self.k, self.nl = "".join(kinds), "".join(nl)
        if _BAD in self.k:
            raise Wrong
        self.match: dict[int, int] = {}
        stack = []
        for i, c in enumerate(self.k):
            if c in "([{":
                stack.append(i)
            elif c in ")]}":
                if not stack or self.k[stack[-1]] != _PAIR[c]:
                    raise Wrong
                self.match[stack.pop()] = i
        if stack:
            raise Wrong
        self.bare = False  # no trailing closures, as in the head of an if

    def want(self, i: int, c: str) -> int:
        if self.k[i] != c:
            raise Wrong
        return i + 1

    def name(self, i: int) -> int:
        if self.k[i] not in _NAMES:
            raise Wrong
        return i + 1

    def ends(self, i: int) -> int:
        """A statement ends here: a semicolon, a new line, a closing brace or the end."""
        c = self.k[i]
        if c == ";":
            return i + 1
        if c == "}" or c == _END or self.nl[i] == "2":
            return i
        raise Wrong

    def program(self) -> None:
        i = 0
        while self.k[i] != _END:
            i = self.ends(self.statement(i, "file"))

    def block(self, i: int, where: str = "code") -> int:
        k = self.k
        if k[i] != "{":
            raise Wrong
        end = self.match[i]
        key = (k[i:end], self.nl[i:end], where)
        if key not in _blocks:
            saved, self.bare = self.bare, False
            j = i + 1
            while j < end:
                j = self.ends(self.statement(j, where))
            self.bare = saved
            if j != end:
                raise Wrong
            if len(_blocks) > _LIMIT:
                _blocks.clear()
            _blocks.add(key)
        return end + 1

    def attributes(self, i: int) -> int:
        k = self.k
        while k[i] == "@":
            i = self.name(i + 1)
            if k[i] == "(" and self.nl[i] == "0":
                i = self.match[i] + 1
        return i

    def statement(self, i: int, where: str) -> int:
        k = self.k
        if k[i] == ";":
            return i
        i = self.attributes(i)
        c = k[i]
        if c == _HASH:
            return self.directive(i)
        start = i
        while k[i] in _MODIFIERS and (k[i + 1] in _MODIFIERS or k[i + 1] in _DECLARES or k[i + 1] == "@" or (k[i + 1] == "(" and k[i + 4] in _MODIFIERS | _DECLARES) or k[i + 1] == W["actor"]):
            i += 1
            if k[i] == "(":
                i = self.match[i] + 1
            i = self.attributes(i)
        c = k[i]
        if c == W["case"]:
            if where != "enum":
                raise Wrong
            return self.cases(i + 1)
        if c in _DECLARES and not (c == W["init"] and where not in ("type", "enum")):
            return self.declaration(i, c, where)
        if c == W["class"] or (c == W["actor"] and k[i + 1] in _NAMES and self.nl[i + 1] != "2"):
            return self.declaration(i, c, where)
        if i > start or where in ("type", "enum", "protocol"):
            raise Wrong
        return self.plain(i, c)

    def directive(self, i: int) -> int:
        k = self.k
        i += 1
        if k[i] == "(" and self.nl[i] == "0":
            i = self.match[i] + 1
        while k[i] != _END and self.nl[i] != "2":
            i += 1
        return i

    def cases(self, i: int) -> int:
        k = self.k
        while True:
            i = self.name(i)
            if k[i] == "(":
                i = self.match[i] + 1
            if k[i] == "=":
                i = self.expression(i + 1)
            if k[i] != ",":
                return i
            i += 1

    def declaration(self, i: int, c: str, where: str) -> int:
        k = self.k
        if c == W["import"]:
            i += 1
            if k[i] in _DECLARES:
                i += 1
            i = self.name(i)
            while k[i] == ".":
                i = self.name(i + 1)
            return i
        if c == W["class"] and (k[i + 1] in (W["func"], W["var"], W["subscript"]) or k[i + 1] in _MODIFIERS and k[i + 2] in _DECLARES):
            return self.declaration(i + 1, k[i + 1], where)
        if c in (W["class"], W["struct"], W["enum"], W["protocol"], W["extension"], W["actor"]):
            i += 1
            i = self.type(i) if c == W["extension"] else self.generics(self.name(i))
            if k[i] == ":":
                i = self.type(self.attributes(i + 1))
                while k[i] == ",":
                    i = self.type(self.attributes(i + 1))
            i = self.where_(i)
            return self.block(i, "enum" if c in (W["enum"],) else "protocol" if c == W["protocol"] else "type")
        if c in (W["let"], W["var"]):
            return self.variables(i + 1, c == W["var"], where)
        if c == W["typealias"] or c == W["associatedtype"]:
            i = self.generics(self.name(i + 1))
            if k[i] == ":":
                i = self.type(i + 1)
            if k[i] == "=":
                i = self.type(i + 1)
            return self.where_(i)
        if c in (W["operator"], W["precedencegroup"]):
            while self.nl[i + 1] != "2" and k[i + 1] not in "{" + _END:
                i += 1
            return self.match[i + 1] + 1 if k[i + 1] == "{" else i + 1
        if c == W["deinit"]:
            return self.block(i + 1)
        i += 1
        if c == W["func"]:
            if k[i] in _NAMES:
                i += 1
            elif k[i] in _BINARY or k[i] in "!?":
                while k[i] != "(" and (k[i] in _BINARY or k[i] in "!?"):
                    i += 1
            else:
                raise Wrong
        elif c == W["init"] and k[i] in "?!":
            i += 1
        i = self.params(self.generics(i))
        while k[i] in (W["async"], W["throws"], W["rethrows"]):
            i += 1
        if k[i] == W["->"]:
            i = self.type(self.attributes(i + 1))
        i = self.where_(i)
        if k[i] == "{":
            return self.accessors(i) if c == W["subscript"] else self.block(i)
        if where == "protocol":
            return i
        raise Wrong

    def where_(self, i: int) -> int:
        k = self.k
        if k[i] != W["where"]:
            return i
        while True:
            i = self.type(i + 1)
            if k[i] not in (":", W["=="]):
                raise Wrong
            i = self.type(i + 1)
            if k[i] != ",":
                return i

    def generics(self, i: int) -> int:
        k = self.k
        if k[i] != "<":
            return i
        while True:
            i = self.name(i + 1)
            if k[i] == ":":
                i = self.type(i + 1)
            if k[i] != ",":
                return self.want(i, ">")

    def params(self, i: int) -> int:
        k = self.k
        i = self.want(i, "(")
        while k[i] != ")":
            i = self.attributes(i)
            if k[i] not in _LABEL:
                raise Wrong
            i += 1
            if k[i] in _NAMES:
                i += 1
            i = self.want(i, ":")
            i = self.attributes(i)
            if k[i] == W["inout"]:
                i += 1
            i = self.type(i)
            if k[i] == W["..."]:
                i += 1
            if k[i] == "=":
                i = self.expression(i + 1)
            if k[i] == "," and k[i + 1] != ")":
                i += 1
            elif k[i] != ")":
                raise Wrong
        return i + 1

    def variables(self, i: int, mutable: bool, where: str) -> int:
        k = self.k
        while True:
            i = self.pattern(i, True)
            typed = k[i] == ":"
            if typed:
                i = self.type(self.attributes(i + 1))
            if k[i] == "=":
                i = self.expression(i + 1)
            if k[i] == "{" and self.nl[i] != "2" and (typed or mutable):
                return self.accessors(i)
            if k[i] != ",":
                return i
            i += 1

    def accessors(self, i: int) -> int:
        k, end = self.k, self.match[i]
        j = self.attributes(i + 1)
        while k[j] in _MODIFIERS:
            j += 1
        if k[j] not in (W["get"], W["set"], W["willSet"], W["didSet"]):
            return self.block(i)
        while j < end:
            j = self.attributes(j)
            while k[j] in _MODIFIERS:
                j += 1
            if k[j] not in (W["get"], W["set"], W["willSet"], W["didSet"]):
                raise Wrong
            j += 1
            if k[j] == "(":
                j = self.match[j] + 1
            while k[j] in (W["async"], W["throws"]):
                j += 1
            if k[j] == "{":
                j = self.block(j)
        return end + 1

    def pattern(self, i: int, names: bool = False) -> int:
        k = self.k
        if k[i] == "(":
            i += 1
            while k[i] != ")":
                if k[i] in _NAMES and k[i + 1] == ":":
                    i += 2
                i = self.pattern(i, names)
                if k[i] == ",":
                    i += 1
                elif k[i] != ")":
                    raise Wrong
            return i + 1
        return self.name(i)

    def type(self, i: int) -> int:
        k = self.k
        while k[i] in (W["some"], W["any"]) and k[i + 1] in _LABEL:
            i += 1
        c = k[i]
        if c == "(":
            i = self.type_list(i)
        elif c == "[":
            i = self.type(i + 1)
            if k[i] == ":":
                i = self.type(i + 1)
            i = self.want(i, "]")
        elif c in _NAMES or c in (W["Self"], W["Any"], W["self"]):
            i += 1
            while True:
                if k[i] == "<" and self.nl[i] == "0":
                    i = self.type(i + 1)
                    while k[i] == ",":
                        i = self.type(i + 1)
                    i = self.want(i, ">")
                elif k[i] == "." and k[i + 1] in _LABEL:
                    i += 2
                else:
                    break
        else:
            raise Wrong
        while True:
            if k[i] in "?!" and self.nl[i] == "0":
                i += 1
            elif k[i] == W["??"] and self.nl[i] == "0":
                i += 1
            elif k[i] == "." and k[i + 1] in _LABEL:
                i += 2
            elif k[i] == "&":
                i = self.type(i + 1)
            elif k[i] in (W["async"], W["throws"], W["->"]):
                while k[i] in (W["async"], W["throws"]):
                    i += 1
                if k[i] != W["->"]:
                    return i
                i = self.type(self.attributes(i + 1))
            else:
                return i

    def type_list(self, i: int) -> int:
        k, i = self.k, i + 1
        while k[i] != ")":
            if k[i] in _LABEL and (k[i + 1] == ":" or (k[i + 1] in _NAMES and k[i + 2] == ":")):
                i += 2 if k[i + 1] == ":" else 3
            i = self.attributes(i)
            if k[i] == W["inout"]:
                i += 1
            i = self.type(i)
            if k[i] == W["..."]:
                i += 1
            if k[i] == ",":
                i += 1
            elif k[i] != ")":
                raise Wrong
        return i + 1

    # ---- statements
    def plain(self, i: int, c: str) -> int:
        k = self.k
        if c in _NAMES and k[i + 1] == ":" and k[i + 2] in (W["for"], W["while"], W["repeat"], W["switch"], W["if"], W["do"]):
            i, c = i + 2, k[i + 2]
        if c == W["if"]:
            return self.if_(i)
        if c == W["guard"]:
            i = self.want(self.conditions(i + 1), W["else"])
            return self.block(i)
        if c == W["while"]:
            return self.block(self.conditions(i + 1))
        if c == W["repeat"]:
            return self.expression(self.want(self.block(i + 1), W["while"]))
        if c == W["for"]:
            i += 1
            while k[i] in (W["try"], W["await"]):
                i += 1
            if k[i] == W["case"]:
                i = self.match_pattern(i + 1)
            else:
                if k[i] in (W["var"], W["let"]):
                    i += 1
                i = self.pattern(i)
                if k[i] == ":":
                    i = self.type(i + 1)
            i = self.head(self.want(i, W["in"]))
            if k[i] == W["where"]:
                i = self.head(i + 1)
            return self.block(i)
        if c == W["switch"]:
            return self.switch_(i)
        if c == W["do"]:
            i = self.block(i + 1)
            while k[i] == W["catch"]:
                i += 1
                if k[i] != "{":
                    i = self.match_pattern(i)
                    if k[i] == W["where"]:
                        i = self.head(i + 1)
                i = self.block(i)
            return i
        if c == W["defer"]:
            return self.block(i + 1)
        if c == W["return"]:
            i += 1
            return i if k[i] in ";} " or (self.nl[i] == "2" and (k[i] in _NOT_STATEMENT or k[i] == W["case"] or k[i] == W["default"])) else self.expression(i)
        if c in (W["break"], W["continue"]):
            return i + 2 if k[i + 1] in _NAMES and self.nl[i + 1] != "2" else i + 1
        if c == W["fallthrough"]:
            return i + 1
        if c == W["throw"]:
            return self.expression(i + 1)
        return self.expression(i)

    def if_(self, i: int) -> int:
        k = self.k
        i = self.block(self.conditions(i + 1))
        if k[i] == W["else"]:
            i += 1
            return self.if_(i) if k[i] == W["if"] else self.block(i)
        return i

    def head(self, i: int) -> int:
        saved, self.bare = self.bare, True
        i = self.expression(i)
        self.bare = saved
        return i

    def conditions(self, i: int) -> int:
        k = self.k
        while True:
            if k[i] in (W["let"], W["var"]):
                i = self.pattern(i + 1)
                if k[i] == ":":
                    i = self.type(i + 1)
                if k[i] == "=":
                    i = self.head(i + 1)
            elif k[i] == W["case"]:
                i = self.match_pattern(i + 1)
                if k[i] == "=":
                    i = self.head(i + 1)
            elif k[i] == _HASH and k[i + 1] == "(":
                i = self.match[i + 1] + 1
            else:
                i = self.head(i)
            if k[i] != ",":
                return i
            i += 1

    def match_pattern(self, i: int) -> int:
        k = self.k
        if k[i] in (W["let"], W["var"]):
            i += 1
        if k[i] == W["is"]:
            return self.type(i + 1)
        saved, self.bare = self.bare, True
        i = self.binary(i, assign=False)
        self.bare = saved
        return i

    def switch_(self, i: int) -> int:
        k = self.k
        i = self.head(i + 1)
        end = self.match[self.want(i, "{") - 1]
        i += 1
        saved, self.bare = self.bare, False
        while i < end:
            i = self.attributes(i)
            if k[i] == _HASH:
                i = self.directive(i)
                continue
            if k[i] == W["case"]:
                while True:
                    i = self.match_pattern(i + 1)
                    if k[i] == W["where"]:
                        i = self.head(i + 1)
                    if k[i] != ",":
                        break
                i = self.want(i, ":")
            elif k[i] == W["default"]:
                i = self.want(i + 1, ":")
            else:
                raise Wrong
            n = 0
            while k[i] not in (W["case"], W["default"]) and i < end:
                if k[i] == "@" and k[i + 2] in (W["default"], W["case"]):
                    break
                i = self.statement(i, "code")
                n += 1
                if k[i] not in (W["case"], W["default"]) or self.nl[i] != "2":
                    i = self.ends(i)
            if not n:
                raise Wrong
        self.bare = saved
        return end + 1

    # ---- expressions
    def expression(self, i: int) -> int:
        return self.binary(i, True)

    def binary(self, i: int, assign: bool) -> int:
        k = self.k
        i = self.prefix(i)
        while True:
            c = k[i]
            if c in _BINARY:
                if c == "=" and not assign:
                    return i
                if c in "-&+" and self.nl[i] == "2" and self.nl[i + 1] == "0" and c != "+":
                    return i
                if c == "<" or c == ">" or c in "&|":
                    while k[i + 1] in "<>&|" and self.nl[i + 1] == "0":
                        i += 1
                if c in (W["..."], W["..<"]) and k[i + 1] in ")],:{" + _END:
                    i += 1
                    continue
                i = self.prefix(i + 1)
            elif c == "?" and self.nl[i] != "0":
                i = self.want(self.binary(i + 1, assign), ":")
                i = self.prefix(i)
            elif c == W["as"]:
                i += 1
                if k[i] in "?!" and self.nl[i] == "0":
                    i += 1
                i = self.type(i)
            elif c == W["is"]:
                i = self.type(i + 1)
            else:
                return i

    def prefix(self, i: int) -> int:
        k = self.k
        while True:
            c = k[i]
            if c == W["try"]:
                i += 1
                if k[i] in "?!" and self.nl[i] == "0":
                    i += 1
            elif c == W["await"] and k[i + 1] not in ")],.=;:} ":
                i += 1
            elif c in "-!~&+" or c in (W["..."], W["..<"]):
                if self.nl[i + 1] != "0":
                    raise Wrong
                i += 1
            elif c in (W["let"], W["var"]):
                i += 1
            else:
                return self.postfix(self.primary(i))

    def postfix(self, i: int) -> int:
        k = self.k
        while True:
            c, gap = k[i], self.nl[i]
            if c == ".":
                if k[i + 1] in _LABEL or k[i + 1] == _NUM:
                    i += 2
                    if k[i] == "<" and self.nl[i] == "0":
                        i = self.generic_call(i)
                elif k[i + 1] in "([":
                    i += 1
                else:
                    raise Wrong
            elif c == "(" and gap != "2":
                i = self.arguments(i, ")")
            elif c == "[" and gap != "2":
                i = self.arguments(i, "]")
            elif c in "?!" and gap == "0":
                i += 1
            elif c == "{" and not self.bare and gap != "2":
                i = self.closure(i)
                while k[i] in _NAMES and k[i + 1] == ":" and k[i + 2] == "{":
                    i = self.closure(i + 2)
            else:
                return i

    def generic_call(self, i: int) -> int:
        """Type arguments before a call; else the sign is an operator."""
        k = self.k
        try:
            j = self.type(i + 1)
            while k[j] == ",":
                j = self.type(j + 1)
            j = self.want(j, ">")
        except Wrong:
            return i
        return j if k[j] in "(.)],:;{} " or self.nl[j] == "2" else i

    def arguments(self, i: int, close: str) -> int:
        k, i = self.k, i + 1
        saved, self.bare = self.bare, False
        while k[i] != close:
            if k[i] in _LABEL and k[i + 1] == ":" :
                i += 2
            if k[i] in _BINARY and k[i + 1] in "," + close:
                i += 1
            else:
                i = self.binary(i, True)
            if k[i] == ",":
                i += 1
            elif k[i] != close:
                raise Wrong
        self.bare = saved
        return i + 1

    def closure(self, i: int) -> int:
        k, end = self.k, self.match[i]
        j = self.attributes(i + 1)
        if k[j] == "[":
            j = self.match[j] + 1
        head = j
        if k[j] == "(" :
            j = self.match[j] + 1
        else:
            while k[j] in _NAMES:
                j += 1
                if k[j] != ",":
                    break
                j += 1
        while k[j] in (W["async"], W["throws"]):
            j += 1
        if k[j] == W["->"]:
            j = self.type(j + 1)
        j = j + 1 if k[j] == W["in"] else i + 1 if head == i + 1 else -1
        if j < 0:
            raise Wrong
        saved, self.bare = self.bare, False
        while j < end:
            j = self.ends(self.statement(j, "code"))
        self.bare = saved
        if j != end:
            raise Wrong
        return end + 1

    def primary(self, i: int) -> int:
        k, c = self.k, self.k[i]
        if c in _NAMES or c in (W["Self"], W["Any"]):
            i += 1
            if k[i] == "<" and self.nl[i] == "0":
                return self.generic_call(i)
            return i
        if c in (_NUM, _STR) or c in (W["self"], W["super"], W["nil"], W["true"], W["false"], W["init"]):
            return i + 1
        if c == _HASH:
            return self.match[i + 1] + 1 if k[i + 1] == "(" else i + 1
        if c == "(":
            return self.arguments(i, ")")
        if c == "[":
            saved, self.bare = self.bare, False
            i += 1
            if k[i] == ":" and k[i + 1] == "]":
                i += 1
            while k[i] != "]":
                i = self.expression(i)
                if k[i] == ":":
                    i = self.expression(i + 1)
                if k[i] == ",":
                    i += 1
                elif k[i] != "]":
                    raise Wrong
            self.bare = saved
            return i + 1
        if c == "{":
            return self.closure(i)
        if c == ".":
            if k[i + 1] not in _LABEL:
                raise Wrong
            return i + 2
        if c == "\\" and k[i + 1] in _NAMES | {"."}:
            return self.type(i + 1) if k[i + 1] != "." else self.name(i + 2)
        if c == W["if"]:
            return self.if_(i)
        if c == W["switch"]:
            return self.switch_(i)
        raise Wrong


def parses(text: str, member: bool = False, alone: bool = False) -> bool:
    """Whether ``text`` is a Swift file; with ``member`` the body of a type."""
    try:
        p = _Parser(text)
        if member:
            i = 0
            while p.k[i] != _END:
                i = p.ends(p.statement(i, "type"))
        else:
            p.program()
        return True
    except (Wrong, IndexError):
        return False
