from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from quireflow.functions import text as T


def values(spark, texts, column):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r[0] for r in df.orderBy("i").select(column(F.col("t")).alias("v")).collect()]


# (line, is a heading, title)
HEADINGS = [
    ("", False, ""),
    ("1. Introduction", True, "Introduction"),
    ("I think so", True, "think so"),
    ("3 apples", True, "apples"),
    ("1. " + " ".join(["word"] * 13), False, None),
    ("2.1 A", True, "2.1 A"),
    ("RELATED WORK", True, "Related Work"),
    ("CNN", True, "Cnn"),
    ("results", True, "results"),
    ("We Show The results here", True, "We Show The results here"),
    ("We Show the results here", False, None),
    ("Hello World.", True, "Hello World."),
    ("This is a plain sentence.", False, None),
    ("x" * 121, False, None),
    ("ÉTUDE GÉNÉRALE", True, "Étude Générale"),
    ("DEF-GHI O'NEIL", True, "Def-Ghi O'Neil"),
]


def test_headings(spark):
    found = values(spark, [h[0] for h in HEADINGS], T.looks_like_heading)
    assert found == [h[1] for h in HEADINGS]
    titles = values(spark, [h[0] for h in HEADINGS], T.clean_heading)
    assert [t for t, h in zip(titles, HEADINGS, strict=True) if h[2] is not None] == [h[2] for h in HEADINGS if h[2] is not None]


def test_white_space(spark):
    texts = [None, "", "  a\t b\x1c\x1f c   ", "　", "a/nb"]
    assert values(spark, texts, T.normalize_space) == ["", "", "a b c", "", "a/nb"]
    assert values(spark, texts, T.word_count) == [0, 0, 3, 0, 1]
    assert values(spark, texts, T.clean_field) == ["", "", "a\t b\x1c\x1f c", "", "a\nb"]


def test_lines_of_every_end(spark):
    assert values(spark, ["a\r\nb\rc\x0bd\x0ce\x1cf\x85g h i"], T.lines) == [list("abcdefghi")]


def test_clean_list(spark):
    df = spark.createDataFrame([([" a ", None, "", "b"],), (None,)], "x array<string>")
    assert [r[0] for r in df.select(T.clean_list(F.col("x"), "|")).collect()] == ["a|None|b", ""]


def test_sentences(spark):
    assert values(spark, ["A b. C d! e? F. É g", None], T.split_sentences) == [["A b.", "C d! e?", "F. É g"], None]


@pytest.mark.parametrize(("paper", "index"), [("x", 1)])
def test_query_of_a_paper(spark, paper, index):
    assert values(spark, [paper], T.query_index) == [index]
    assert values(spark, [paper], lambda c: T.query_index(c, use_multiple=False)) == [0]


def test_identifiers(spark):
    assert values(spark, ["train_12", "odd", "a_b"], T.id_suffix) == [12, None, None]
    assert values(spark, ["p", None], lambda c: T.chunk_gid(c, F.lit(3))) == ["p_3", "unk_3"]
    assert values(spark, ["Intro", " ", None], lambda c: T.with_section_header(c, F.lit("x"))) == ["[Intro] x", "x", "x"]
    assert values(spark, ["0"], lambda c: T.pair_rate(F.lit(3), c.cast("int"))) == [300.0]
