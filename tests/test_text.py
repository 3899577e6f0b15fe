"""Column expressions on small, hand-written lines."""

import pytest
from pyspark.sql import functions as F

from palimpsest.functions import text as X
from palimpsest.operators import lines as L


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "v string").select(column.alias("r")).first()[0]


@pytest.mark.parametrize("text,lines", [
    ("a\nb\n", ["a", "b"]), ("a\nb", ["a", "b"]), ("a\n\n", ["a", ""]), ("\n", [""]), ("x", ["x"]),
])
def test_lines_drop_the_final_empty_one(spark, text, lines):
    assert one(spark, text, X.lines_of("v")) == lines


def test_words_carry_their_whitespace(spark):
    words = one(spark, "  a bb\n c", X.words_of("v"))
    assert words == ["  ", "a ", "bb\n ", "c"]
    assert "".join(words) == "  a bb\n c"


@pytest.mark.parametrize("raw,want", [
    ("/// \\rSec2[a.b]{Title}", (2, "a.b", "Title")), ("  //\\rSec10 [x] {}", (10, "x", "")),
    ("// \\rSec1[a.b] no braces", None), ("\\rSec1[a]{b}", None),
    ("//! \\rSec1[a]{One long\n//! title}", (1, "a", "One long title")),
])
def test_headings(spark, raw, want):
    got = one(spark, raw, X.heading_of("v"))
    assert (tuple(got) if got else None) == want


def test_a_tagged_heading_that_does_not_parse_is_not_silent(spark):
    lines = spark.createDataFrame([(1, 1, "// \\rSec1[a] x"), (1, 2, "prose")], "doc_id long, line_no long, raw string")
    assert [(r.line_no, r.malformed) for r in L.headings(lines).collect()] == [(1, True)]


def test_wrapped_headings_join_their_comment_lines(spark):
    lines = spark.createDataFrame(
        [(1, 1, "/// \\rSec1[a]{One"), (1, 2, "/// two}"), (1, 3, "/// prose")], "doc_id long, line_no long, raw string")
    joined = L.wrapped_headings(lines)
    heads = L.headings(joined).filter("NOT malformed").collect()
    assert [(h.line_no, h.stable, h.title) for h in heads] == [(1, "a", "One two")]
    assert sorted(r.line_no for r in joined.collect()) == [1, 3]


@pytest.mark.parametrize("raw,name", [
    ("/// END [a.b]", "a.b"), ("///END [a]  \r", "a"), ("// END [a]", None), ("/// END []", None), ("/// END [a] x", None),
])
def test_fences(spark, raw, name):
    assert one(spark, raw, X.fence_of("v")) == name


@pytest.mark.parametrize("raw,vocabulary,text", [
    ("//! \\effects x", "markup", "\\effects x"), ("/// x", "doxygen", "x"), ("  // x", "draft", "x"), ("int x;", None, "int x;"),
    ("/*! x", "markup", "x"), (" * x", None, "x"),
])
def test_vocabulary_and_decoration(spark, raw, vocabulary, text):
    assert one(spark, raw, X.vocabulary_of("v")) == vocabulary
    assert one(spark, raw, X.strip_decoration("v")) == text


@pytest.mark.parametrize("raw,want", [
    ("\\indexlibraryglobal{f}", ("global", "f", "")), ("\\indexlibrarymember{g}{c}", ("member", "g", "c")),
    ("\\indexlibrarymemberx{g}{c}", ("memberx", "g", "c")), ("\\indexlibrarymember{g}", None), ("\\indexlibraryother{g}", None),
    ("\\indexlibraryctor{c}{d}", ("constructor", "c", "")),
])
def test_index_entries(spark, raw, want):
    got = one(spark, raw, X.index_entry("v"))
    assert (tuple(got) if got else None) == want


@pytest.mark.parametrize("text,want", [
    ("a `b` c", [("text", "a "), ("code", "b"), ("text", " c")]),
    ("see \\iref{x.y} and \\placeholder{T}", [("text", "see "), ("iref", "x.y"), ("text", " and "), ("placeholder", "T")]),
    ("open `tail", [("text", "open "), ("open_code", "tail")]),
    ("50\\% of \\other{x}", [("text", "50% of \\other{x}")]),
])
def test_pieces(spark, text, want):
    assert [tuple(p) for p in one(spark, text, X.pieces_of("v"))] == want


def test_long_prose_does_not_overflow_the_matcher(spark):
    text = "word \\ " * 20000
    assert sum(len(p.text) for p in one(spark, text, X.pieces_of("v"))) == len(text)
    assert len(one(spark, "x" * 200000 + "% note", X.strip_comment("v"))) == 200000


def test_prose_lines_join_as_their_comments_say(spark):
    rows = [(1, 1, "a% flush"), (1, 2, "% nothing"), (1, 3, "b % spaced"), (1, 4, "c"), (1, 5, "d")]
    df = spark.createDataFrame(rows, "doc_id long, line_no long, text string")
    assert L.join_prose(df, ["doc_id"]).first().text == "ab c d"


@pytest.mark.parametrize("name,usable", [
    ("a.b-c_d+1", True), (".a", False), ("-a", False), ("a.", False), ("a..b", False), ("a/b", False), ("", False), ("é", False),
])
def test_file_names(spark, name, usable):
    assert one(spark, name, X.usable_as_file_name("v")) is usable


@pytest.mark.parametrize("parts,want", [
    ([], ""), (["a"], "a."), (["a", "b"], "a and b."), (["a", "b", "c"], "a, b, and c."),
])
def test_sentences(spark, parts, want):
    df = spark.createDataFrame([(parts,)], "p array<string>")
    assert df.select(X.sentence(F.col("p"))).first()[0] == want


def test_lists_turn_into_bullets_past_the_threshold(spark):
    df = spark.createDataFrame([(["a", "b", "c"],)], "p array<string>")
    assert df.select(X.render_list(F.col("p"), 2)).first()[0] == "- a,\n- b,\n- c."


def test_names_keep_their_qualifier(spark):
    df = spark.createDataFrame([(1, "std::foo::bar x::y z")], "k long, text string")
    got = {(r.name, r.qualifier, r.standard) for r in L.names_used(df, ["k"]).collect()}
    assert got == {("std", True, False), ("foo", True, True), ("bar", False, True), ("x", True, False), ("y", False, False),
                   ("z", False, False)}


def test_two_empty_sets_are_the_same_set(spark):
    df = spark.createDataFrame([("", "", "a b", "b c")], "a string, b string, c string, d string")
    r = df.select(X.jaccard(X.token_set("a"), X.token_set("b")), X.jaccard(X.token_set("c"), X.token_set("d"))).first()
    assert r[0] == 1.0 and abs(r[1] - 1 / 3) < 1e-12
