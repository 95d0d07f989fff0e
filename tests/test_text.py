"""String functions and metrics on hand-derived cases."""

import pytest
from pyspark.sql import functions as F

from loomstone.functions import metrics as M
from loomstone.functions import text as X


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return row.select(column.alias("x")).first()[0]


@pytest.mark.parametrize(("text", "want"), [("a(b)", True), ("a", False), (")(", False), ("((", False), ("(())", True), ("", False)])
def test_enclosed(spark, text, want):
    assert one(spark, X.enclosed("t", "(", ")", 1), t=text) is want


def test_trimming_and_collapsing(spark):
    assert one(spark, X.trim_edges("t"), t="/** hi: */") == "hi"
    assert one(spark, X.trim_edges("t"), t=" *x　") == "x"
    assert one(spark, X.collapse_repeats("t"), t="a,,b  c\n\nd") == "a,b c\nd"
    assert one(spark, X.collapse_repeats("t"), t="a,,b    c") == "a,,b    c"
    assert one(spark, X.trim_lines("t"), t="* a *\n// b") == "a\nb"


def test_identifiers(spark):
    assert one(spark, X.variables("t"), t="the foo_bar uses myVar and _ and Foo_Bar") == ["foo_bar"]
    assert one(spark, X.parameters("t"), t="int f(int a, b) { g(c); }") == "int a, b"
    assert one(spark, X.parameters("t"), t="no call") == ""
    assert one(spark, X.has_body("t"), t="void f() { }") is False
    assert one(spark, X.has_body("t"), t="void f() { x; }") is True
    assert one(spark, X.has_body("t"), t="void f();") is False
    assert one(spark, X.keyboard_or_empty("t"), t="éa") is True
    assert one(spark, X.keyboard_or_empty("t"), t="é") is False
    assert one(spark, X.drop_name_prefix("d", "n"), d="f - does it", n="a::f") == "does it"
    assert one(spark, X.cut_signature("d", "c"), d="int f(int) adds", c="int f(int) { }") == " adds"
    assert one(spark, X.remove_comments("t"), t="a /* x */ b // y\nc") == "a  b \nc"
    assert one(spark, X.leaks_entity("d", "c", "x", "g"), d="sets my_flag", c="f()", x="", g="my_flag is set") is True
    assert one(spark, X.leaks_entity("d", "c", "x", "g"), d="sets my_flag", c="MY_FLAG = 1", x="", g="my_flag is set") is False


def test_last_window_is_not_looked_at(spark):
    text = "abcdefghij" * 4
    assert one(spark, X.shares_substring("a", "b", 40), a=text, b=text) is False
    assert one(spark, X.shares_substring("a", "b", 39), a=text, b=text) is True
    assert one(spark, X.shares_substring("a", "b", 50), a=text, b=text) is False


def distinct_text(n):
    return "".join(chr(0x4E00 + i) for i in range(n))  # no spaces, nothing recurs


@pytest.mark.parametrize(("n", "want"), [(250, 0), (400, 0.5), (549, 299 / 300), (550, 0), (551, 1)])
def test_verbosity_by_length(spark, n, want):
    assert one(spark, M.verbosity(F.col("t")), t=distinct_text(n)) == pytest.approx(want)


def test_verbosity_by_repetition(spark):
    part = "one two three four five six seven eight nine ten "
    assert one(spark, M.verbosity(F.col("t")), t=part * 3) == 1.0
    assert one(spark, M.verbosity(F.col("t")), t="only once and nothing more is said here at all") == 0.0


def test_triviality_and_ratio():
    forms, common = M.short_forms(), frozenset(M.COMMON_WORDS)
    score = lambda d, n, c: M.triviality_of(d, n, c, forms, common, M.STOPWORDS)
    assert score("Adds", "add", "int add(int a)") == 1
    assert score("Reads the buffer length", "read_buf_len", "int read_buf_len(char *b)") == 1
    assert score("x" * 151, "f", "int f()") == 0
    assert score("Walks every neighbour until exhausted", "f", "int f(int a)") == 0
    assert {"get", "http", "response", "2", "response2"} <= M.name_parts("getHTTPResponse2")
    assert M.partial_ratio_of("abc", "xxabcxx") == 100
    assert M.partial_ratio_of("abcd", "wxyz") == 0
    assert M.partial_ratio_of("", "x") == 0


def test_answers(spark):
    df = spark.createDataFrame([(["q1?", "q2?"], "Yes.\nNo, unclear")], "q array<string>, r string")
    assert df.select(X.answers_by_question("q", "r")).first()[0] == {"q1?": "Yes.", "q2?": "No, unclear"}
    assert df.select(X.yes_no("r")).first()[0] == ["Yes", "No"]
