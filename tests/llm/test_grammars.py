import ast
import textwrap

import pytest

from evidar.llm.grammars import parses
from evidar.llm.syntax import ranked, verdict

GOOD_JS = [
    "", "'use strict';\nconst a = require('./b');", "({ a, b = 3 } = c);", "const f = async (x, ...y) => { return await g(x); };", "for (const [k, v] of m.entries()) if (v) continue; else break;",
    "class A extends B { #x = 1; static { y(); } get z() { return this.#x; } async *gen() { yield 1; } }", "export default function () {}", "import a, { b as c } from 'd'; export * from 'e';",
    "x = a / b / c; y = /[/]\"'/g.test(s);", "var s = `a ${b ? `c${d}` : '}'} e`;", "a\nb\nc", "label: for (;;) { break label; }", "switch (x) { case 1: y(); default: }",
    "try { a() } catch { b() } finally { c() }", "x = {...a, b, 'c': 1, [d]: 2, e() {}, get f() { return 1 }};", "if (a) function_call(); else { }", "(async () => { await x })();", "a ??= b ?? c?.d?.[e]?.(f);", "const {a: {b = 1}, ...c} = d;",
    "new Foo(1).bar", "x = y => ({ z: y })", "return_ = 1", "do x++; while (x < 5)\ny()", "let async; async = 1", "a = b ? (c, d) : e => f;",
]
BAD_JS = [
    "function f( {", "const x;", "return 1;", "a b", "{ \"a\": 1, \"b\": 2 }", "x = 'abc", "f(a,, b)", "<<<<<<< HEAD\nx\n=======\ny\n>>>>>>> z", "import os\nimport sys", "<html></html>", "def f(x):\n    pass", "({ a = 1 });", "class A { f() { }", "x = “y”;", "if x == 3", "break;", "}", "1 = x", "f() = 1",
]
GOOD_SWIFT = [
    "import Foundation\n", "final class A: B, C {\n    private var x = 1\n    let y: [String: Int]? = nil\n    init(_ a: Int = 3) { self.x = a }\n}", "func f<T: P>(_ a: [T], b: (Int) -> Void) throws -> T? where T: Q { return nil }",
    "guard let x = y, x > 3 else { return }", "switch x {\ncase .a(let b) where b > 1:\n  f()\ndefault:\n  break\n}", "let a = b.map { $0.c }.sorted()", "for i in 0..<10 where i % 2 == 0 { print(i) }",
    "enum E: String { case a = \"x\", b\n indirect case c(Int) }", "do { try f() } catch let e as X { g(e) } catch { }", "let s = \"a \\(b + \"c\") d\"", "if case .a = x { } else if let y { }", "var z: Int { get { 1 } set { } }",
    "extension A where B == C { static func g() {} }", "@objc public func h() async -> Int { await i() }", "let c = x ? y : z", "protocol P { func f() -> Int\n var g: Int { get } }", "x = a as? B ?? c!", "repeat { n += 1 } while n < 3", "let f: (Int, String) -> Bool = { (a, b) -> Bool in return true }",
]
BAD_SWIFT = ["func f() {", "class A { x.y() }", "let x = ", "}", "func f() -> { }", "a b", "<<<<<<< a\nlet x = 1\n=======\n>>>>>>> b", "import os\nimport sys\ndef f():\n  pass", "guard let x = y { }", "Title\n-----\n\nSome text here."]


@pytest.mark.parametrize("text", GOOD_JS)
def test_javascript_accepts(text):
    assert parses("javascript", text)


@pytest.mark.parametrize("text", BAD_JS)
def test_javascript_rejects(text):
    assert not parses("javascript", text)


@pytest.mark.parametrize("text", GOOD_SWIFT)
def test_swift_accepts(text):
    assert parses("swift", text)


@pytest.mark.parametrize("text", BAD_SWIFT)
def test_swift_rejects(text):
    assert not parses("swift", text)


def test_blocks_seen_before_change_nothing():
    for _ in range(2):
        assert parses("javascript", "function f() { return 1; }") and not parses("javascript", "{ return 1; }")
        assert parses("javascript", "for (;;) { continue; }") and not parses("javascript", "if (x) { continue; }")


def test_jumps_need_their_target_whatever_was_read_before():
    js = lambda text: parses("javascript", text)
    for _ in range(2):
        assert js("switch (x) { case 1: y(); break; default: break; }") and not js("y();\nbreak;\n") and not js("if (x) break;")
        assert not js("switch (x) { case 1: continue; }") and js("for (;;) switch (x) { case 1: continue; }")
        assert js("a: for (;;) { for (;;) { continue a; } }") and js("a: { f(); break a; }") and js("a: b: while (x) { continue a; }")
        for text in ("break a;", "for (;;) { break b; }", "a: for (;;) { continue b; }", "a: { continue a; }", "a: for (;;) { } break a;", "a: for (;;) { f(function () { break a; }); }", "a: { a: f(); }"):
            assert not js(text), text
        assert js("a: f(); a: g();") and js("a: { f(() => { a: for (;;) break a; }); }") and js("for (;;) { break\na; }")


def test_members_and_python():
    assert parses("javascript", "  async f(a) { return a; }", member=True) and not parses("javascript", "  async f(a) { return a; }")
    assert parses("python", "    def f(self):\n        return 1\n", alone=True) and not parses("python", "    def f(self):\n        return 1\n")
    for text in ("match x:\n    case 1: pass", "print 'a'", "x = 08", "def f(a, a): pass", "return 3", "f'{x!r:>{w}}'", "x: int = 1", "async def f():\n await x", "a = [", "\0", "if x:\npass", "nonlocal y", ""):
        try:
            ast.parse(textwrap.dedent(text))
            good = True
        except (SyntaxError, ValueError):
            good = False
        assert parses("python", text) == good, text


def test_verdicts():
    python = "import os\n\ndef f(x):\n    return None\n"
    assert verdict("m", "Module", "a.py", python) == "ok" and verdict("m", "Module", "a.js", python) == "python" and verdict("m", "Module", "a.swift", "func (") == "corrupt"
    assert ranked(python)[0] == "python" and ranked("const x = () => { return null; };")[0] == "javascript"
    assert verdict("m:a.js:A:f", "Function", "a.js", "f() { return 1; }") == "ok" and verdict("m:a.js:f", "Function", "a.js", "f() { return 1; }") != "ok"
