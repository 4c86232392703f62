"""Nothing is cut off: long values, long comments, deep nesting, values far outside the rest."""

import random
import sys

import pytest

from evidar.llm import credentials, fusion, grammars, handwritten, pairing, splitting, syntax


def find(text, path="a.py"):
    return [(c.value, c.name, c.place) for c in credentials.candidates(text, path)]


def test_long_values_and_odd_letters():
    long = "A1b2C3d4" * 900
    assert find(f'api_key = "{long}"') == [(long, "api_key", "pair")]
    assert find(f"secret = '''{long}\n{long}'''")[0][0] == f"{long}\n{long}"
    assert find('password = "a\\\\" + x')[0][0] == "a\\\\" and find('password = "open') == [] and find("password = 'it\\'s1'")[0][0] == "it\\'s1"
    assert [v for v, _, _ in find('# İ\nAPI_KEY = "Sm4ll!64x"\n')] == ["Sm4ll!64x"]
    assert [p for _, _, p in find('seed = "k3JxPq0ZrT5vWm8YbN2cHd6L"')] == ["opaque"]
    m = credentials.Markov(["abc" * 200 + "zz" * 200])
    assert m.mean("abc" * 300) > m.mean("abc" * 150 + "qx" * 225)


def test_remarks_of_any_length():
    filler = "word " * 60
    assert find(f"# {filler}the webhook secret {filler}: kst_D5Qo89DTLm3BTx") == [("kst_D5Qo89DTLm3BTx", "webhook secret", "comment")]
    assert find("x = 1  // password was Slow8735") == [("Slow8735", "password", "comment")] and find("x = 1  # see: the password of b") == []
    assert find("# old password:Slow8735") == [("Slow8735", "password", "comment")] or find("# old password:Slow8735")[0][0] == "Slow8735"


@pytest.mark.parametrize("n", [1, 5000])
def test_long_lines_take_time_in_proportion(n):
    assert find("# password " * n) == []


def test_terms_behind_long_headers_and_imports():
    terms = "Copyright (c) 2020 the panel contributors"
    docs = '"""' + "Some words of the file.\n" * 200 + terms + '"""\n'
    for text in (docs, "'use strict';\n" + "import a from 'b';\n" * 200 + f"// {terms}\n", "import os\nfrom a import (\n    b,\n    c,\n)\n" * 90 + f"# {terms}\n", "const a = require('a');\n" * 120 + f"/* {terms} */\n"):
        assert handwritten.copy_notice(text + "x = 1\n")
    assert not handwritten.copy_notice("x = 1\n" + docs + "y = 2\n") and not handwritten.copy_notice("")


def test_versions_of_a_copy_and_short_lines():
    body = [f"value_{i} = step_{i}(alpha, beta, {i})" for i in range(60)]
    versions = ["\n".join([*body[:k], f"changed = {k}", *body[k + 1:]]) for k in (3, 20, 40)]
    index = handwritten._Upstream(versions)
    assert all(index.copied(v) == 1.0 for v in versions) and index.copied("\n".join(body)) > 0.9
    short = "\n".join(f"a{i}\n=\n{i}" for i in range(80))
    assert handwritten._Upstream([short]).copied(short) == 1.0 and index.copied(short) == 0.0 and index.copied("") == 0.0 and handwritten._Upstream([]).copied(short) == 0.0
    words = [f"w{i % 37}" for i in range(400)]
    for drop in range(0, 400, 25):
        text = " ".join(words[:drop] + ["other"] + words[drop + 1:])
        a, b = ({tuple(x[i: i + 5]) for i in range(len(x) - 4)} for x in (text.split(), words))
        assert abs(handwritten._Upstream([" ".join(words)]).copied(text) - len(a & b) / min(len(a), len(b))) < 1e-9


def test_deep_texts():
    n = 3_000
    assert grammars.parses("javascript", "(" * n + "1" + ")" * n) and not grammars.parses("javascript", "(" * n + "1" + ")" * (n - 1))
    assert grammars.parses("javascript", "if (a) { b(); }" + " else if (a) { b(); }" * n) and grammars.parses("swift", "if a { b() }" + " else if a { b() }" * n)
    assert grammars.parses("javascript", "x = `" + "${`" * 60 + "`}" * 60 + "`") and grammars.parses("swift", "let x = " + "[" * n + "1" + "]" * n)
    assert grammars.parses("python", "+".join(["1"] * 20_000)) and grammars.parses("python", "a" + ".b" * 20_000) and not grammars.parses("python", "+".join(["1"] * 20_000) + "+")
    assert sys.getrecursionlimit() < 100_000


def test_every_text_is_ranked_and_foreign_endings_are_told():
    for path, text, want in (("a.py", "x = 1", "ok"), ("a.py", "const a = () => { return 1; };", "javascript"), ("a.js", "func f() -> Int { return 1 }", "swift"), ("a.js", "def (:", "corrupt"), ("a.swift", "import os\n\ndef f():\n    pass\n", "python")):
        assert syntax.verdict("p:" + path, "Module", path, text) == want


CAND = "n int, section string, id string, bm25 double, cos double, fused_score double"


def test_outliers_keep_their_order(spark):
    rows = [(1, "doc", f"d{i}", float(i % 7), float(i % 5), None) for i in range(30)] + [(1, "doc", f"far{k}", x, 4.0, None) for k, x in enumerate((5e3, 9e3, 1e7))] + [(1, "doc", "low", -1e9, 4.0, None)]
    got = {x.id: x for x in fusion.ranked(fusion.fused(spark.createDataFrame(rows, CAND))).collect()}
    assert [got[f"far{k}"].rank for k in (2, 1, 0)] == [1, 2, 3] and got["low"].rank == len(rows)
    assert all(0 <= x.combined <= 1 for x in got.values()) and got["far2"].combined < 1


def test_large_groups_give_the_same(spark):
    r = random.Random(21)
    v = lambda: r.choice((None, float(r.randrange(6)), r.random() * 10**r.randrange(6)))
    rows = [(r.choice((1, 1, 1, 2, None)), r.choice(("doc", "code")), f"i{i}", v(), v(), v()) for i in range(300)]
    df = spark.createDataFrame(rows + rows[:20], CAND)
    small = fusion.ranked(fusion.fused(df)).collect()
    large = fusion.ranked(fusion.fused(df, large=40), large=40).collect()
    told = lambda rows: sorted((str(x.n), x.section, x.id, x.rank, x.best_tenth, round(x.combined, 9) if x.combined is not None else -1.0) for x in rows)
    assert told(small) == told(large) and len(small) == 300


def test_first_piece_uses_its_whole_limit():
    spans = splitting.split("word " * 1000, 1600, 200)
    assert spans[0][2] == 1600 and all(c - a <= 1600 for a, _, c in spans)


def test_entries_go_on_below_their_bullets():
    text = "* `a.b.f`\n  Adds numbers\n  to a list.\n* `a.b.g` - Gives one\n  item back.\n\nOther words.\n"
    assert pairing.entries(None, text) == [("a.b.f", "Adds numbers\n  to a list."), ("a.b.g", "Gives one\n  item back.")]
