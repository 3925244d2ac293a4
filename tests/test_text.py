"""Text expressions on small cases."""

import pytest
from pyspark.sql import functions as F

from wordloom.functions import text as T
from wordloom.operators import operations


def one(spark, value, expression, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expression.alias("r")).head()[0]


@pytest.mark.parametrize(
    "text, want",
    [
        ("Héllo_Wörld 42 ٣x", ["héllo", "wörld", "42", "٣x"]),
        (None, []), ("", []), ("__--", []), ("ÀB c", ["àb", "c"]),
    ],
)
def test_words(spark, text, want):
    assert one(spark, text, T.words("x")) == want


@pytest.mark.parametrize(
    "text, want",
    [
        ("  a\r\nb\rc\n", ["  a", "b", "c", ""]), (None, [""]), ("x\n\r\ny", ["x", "", "y"]),
    ],
)
def test_lines(spark, text, want):
    assert one(spark, text, T.lines("x")) == want


def test_index_tokens(spark):
    assert one(spark, "The state's STATE　of-it and ÉTÉ ab", T.index_tokens("x")) == ["states", "state", "ofit", "ÉtÉ"]
    assert one(spark, None, T.index_tokens("x")) == []


def test_content_hash_ignores_space_and_case(spark):
    a, b, c = (one(spark, t, T.content_hash("x")) for t in ("Don't  STOP\nnow", "don't stop now ", "dont stop now"))
    assert a == b != c


def test_shingles(spark):
    words = F.split("x", " ")
    assert len(one(spark, "a b c d a b c", T.shingles(words, 3))) == 4
    assert one(spark, "a b", T.shingles(words, 3)) == []
    assert len(one(spark, "a b", T.joined_shingles(words, 3))) == 1
    assert one(spark, "a b", T.joined_shingles(words, 3, short=False)) == []


@pytest.mark.parametrize("title, want", [("Hello, World!", "hello-world"), ("CON", "con_"), ("Straße 5", "straße-5"), ("--", "")])
def test_slug(spark, title, want):
    assert one(spark, title, T.slug("x")) == want


@pytest.mark.parametrize(
    "path, want",
    [("a/b.c", True), ("/a", False), ("a//b", False), ("a\\b", False), ("a:b", False), ("a/con.md", False), ("a/b.", False), ("a/b ", False), ("..", False)],
)
def test_safe_path(spark, path, want):
    assert one(spark, path, T.is_safe_path("x")) is want


@pytest.mark.parametrize("text", ["añb", "日本語テキスト", "a🚀b", "plain", "é", ""])
def test_cut_bytes(spark, text):
    for limit in range(1, 9):
        assert one(spark, text, T.cut_bytes(F.col("x"), limit)) == text.encode()[:limit].decode(errors="ignore")


def test_hashtags_and_lessons(spark):
    assert one(spark, "#Beta, x #alpha:1 #a_b #", T.hashtags("x")) == ["alpha:1", "beta"]
    assert one(spark, "- Lesson: keep it\nno\n* GOTCHA: mind\nlearned:  ", T.lessons("x")) == ["keep it", "mind"]
    assert one(spark, "  whole ", T.lessons("x")) == ["whole"]
    assert one(spark, " ", T.lessons("x")) == []


@pytest.mark.parametrize(
    "text, want",
    [("No, redo it", True), ("nothing", False), ("please try again", True), (None, False), ("Waiting", False), ("WRONG", True)],
)
def test_corrections(spark, text, want):
    assert one(spark, text, T.is_correction("x")) is want


@pytest.mark.parametrize(
    "text, want",
    [
        ("run `cargo test` now", True), ("use left-pad@1.3", True), ("pin `tokio = \"1.40\"`", True), ("plain words", False),
        ("mail me@home", False), ("`Git push`", True), ("@scope/name@2.0", True), (None, False),
    ],
)
def test_names_tool(spark, text, want):
    assert one(spark, text, T.names_tool("x")) is want


@pytest.mark.parametrize(
    "text, want",
    [
        ("see src/main", True), ("see ./x", True), ("http://a/b.c", False), ("/etc/passwd", False), ("a/b", False),
        ("lib/a.rs:12", True), ("x/y.z", True), ("and/or", False), (None, False),
    ],
)
def test_repository_path(spark, text, want):
    assert one(spark, text, T.has_repository_path("x")) is want


def test_body_links(spark):
    text = "[a](/x/y.md) ![i](/no.md) `[c](/no.md)` [b](/z.md \"t\") [a](/x/y.md) [e](http://h/q.md) [f](q.md)\n```\n[g](/no.md)\n```\n[h](/w.md)"
    assert one(spark, text, T.body_links("x")) == ["x/y", "z", "w"]
    assert one(spark, None, T.body_links("x")) == []


@pytest.mark.parametrize("text, want", [("90s", 90), ("2h", 7200), ("0s", None), ("-1m", None), ("1.5h", None), ("3d", 259200), ("", None)])
def test_durations(spark, text, want):
    assert one(spark, text, operations.duration_seconds(F.col("x"))) == want


@pytest.mark.parametrize("polls, want", [(None, 0), (0, 0), (1, 60), (3, 240), (7, 3600), (1000, 3600)])
def test_backoff(spark, polls, want):
    assert one(spark, polls, operations.backoff_seconds(F.col("x")), "int") == want
