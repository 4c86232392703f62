from pyspark.sql import functions as F

from evidar.functions import text as X
from evidar.functions.porter import stem


def one(spark, value, expression):
    return spark.createDataFrame([(value,)], "x string").select(expression(F.col("x")).alias("y")).first()[0]


def test_tokens_split_camel_case(spark):
    assert one(spark, "getUserName_v2(x) QuerySet", X.tokenize_code) == ["get", "user", "name", "v2", "x", "query", "set"]
    assert one(spark, "", X.tokenize_code) == [] and one(spark, None, X.tokenize_code) is None


def test_query_text_drops_fences_and_is_cut(spark):
    assert one(spark, "a```b\nc```d", X.query_text) == "a d"
    assert len(one(spark, "x" * 5000, X.query_text)) == 2000


def test_names_links_and_paths(spark):
    assert one(spark, "The `foo` in src/a/models.py, QuerySet get_user None", X.identifiers) == ["QuerySet", "foo", "get_user", "models", "src/a/models.py"]
    assert one(spark, "Fixes #3, resolved: #12 and closes #3", X.closed_reports) == [3, 12]
    assert one(spark, "Merge pull request #7 from x", X.pr_of) == 7
    assert one(spark, "Fix it (#9)\nbody", X.pr_of) == 9 and one(spark, "nothing", X.pr_of) is None
    assert one(spark, "p:a/b.py:C:f", X.qualified) == "C.f" and one(spark, "p:a/b.py", X.qualified) == "a/b.py"
    assert one(spark, "src/flask/__init__.py", X.module_name) == "flask"
    assert one(spark, "x [C2] [D1, H3] [C2]", X.cited_items) == ["C2", "D1", "H3"]
    assert one(spark, "FILE: a/b.py and `c.js`", X.answered_files) == ["a/b.py", "c.js"]


def test_hunks_and_clips(spark):
    assert one(spark, "@@ -1 +1 @@\n-a\n+b\n c", X.hunk_body) == "a\nb\nc"
    assert one(spark, "@@\n-# x\n+\n y", X.comment_only) is True and one(spark, "@@\n+x = 1", X.comment_only) is False
    assert one(spark, "a" * 100, lambda c: X.clip(c, 10)) == "a" * 7 + " ... " + "a" * 3
    assert [p for p in ("app.py", "tests/a.py", "docs/x.py", "testing.py", "setup.py") if one(spark, p, X.kept_path)] == ["app.py", "testing.py"]


def test_stems():
    assert [stem(w) for w in ("running", "users", "relational", "ponies", "hopping", "agreed", "is")] == ["run", "user", "relat", "poni", "hop", "agre", "is"]
