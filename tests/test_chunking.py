from __future__ import annotations

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quireflow.config import ChunkConfig
from quireflow.operators import chunk_rows
from quireflow.operators import chunking as C


def bounds(spark, words, config):
    df = spark.createDataFrame([(words,)], "w array<int>")
    return [tuple(b) for b in df.select(C.window_bounds(F.col("w"), config)).first()[0]]


def folded(words, most, overlap):
    """The windows by a plain loop."""
    out, start = [], 0
    for i, w in enumerate(words):
        if sum(words[start:i]) + w > most and i > start:
            out.append((start, i))
            while sum(words[start:i]) > overlap:
                start += 1
    return [*out, (start, len(words))] if words else []


def test_worked_example(spark):
    assert bounds(spark, [6, 3, 4, 2, 9, 12, 1], ChunkConfig(max_words=10, overlap_words=4)) == [(0, 2), (1, 4), (3, 5), (5, 6), (6, 7)]


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(words=st.lists(st.integers(1, 40), max_size=30), most=st.integers(5, 60), overlap=st.integers(0, 30))
def test_windows_agree_with_a_loop(spark, words, most, overlap):
    assert bounds(spark, words, ChunkConfig(max_words=most, overlap_words=overlap)) == folded(words, most, overlap)


@settings(max_examples=300, deadline=None)
@given(words=st.lists(st.integers(1, 40), max_size=30), most=st.integers(5, 60), overlap=st.integers(0, 30))
def test_batch_windows_agree_with_a_loop(words, most, overlap):
    assert chunk_rows.windows(words, ChunkConfig(max_words=most, overlap_words=overlap)) == folded(words, most, overlap)


def test_batches_and_expressions_agree(spark):
    import random

    rng = random.Random(1)
    parts = ["1. Intro", "RESULTS OF X", "results", "A b c d. E f", "one two three four five six seven eight nine ten eleven.", "\x1c", "é É", "I think so", "2.1 A", "x" * 130, "Word " * 160 + "end."]
    texts = [rng.choice(["\n", "\r\n", "\u2028", " "]).join(rng.choice(parts) for _ in range(rng.randrange(12))) for _ in range(150)] + ["", " ", None]
    df = spark.createDataFrame(list(enumerate(texts)), "paper_id long, article string")
    fast = {r.paper_id: [] for r in df.collect()}
    for r in C.chunk_documents(df).orderBy("paper_id", "chunk_id").collect():
        fast[r.paper_id].append(tuple(r)[2:])
    slow = df.where("trim(article) <> ''").select("paper_id", C.chunk_array(F.col("article")).alias("c")).collect()
    assert {r.paper_id: [tuple(c) for c in r.c] for r in slow} == {k: v for k, v in fast.items() if v}


def test_sections(spark):
    ten = "one two three four five six seven eight nine ten"
    text = f"{ten}\n1. First\nMETHODS AND DATA\n{ten}.\r\n{ten}\nresults\ntoo short"
    rows = spark.createDataFrame([(text,)], "t string").select(F.explode(C.sections(F.col("t"))).alias("s")).select("s.*").collect()
    assert [(r.section_index, r.section, r.n_words) for r in rows] == [(0, "Body", 10), (1, "Methods And Data", 20)]


def test_fallback_keeps_the_raw_text(spark):
    rows = spark.createDataFrame([("1. Title\nshort  text",)], "t string").select(F.explode(C.sections_or_body(F.col("t"))).alias("s")).select("s.*").collect()
    assert [(r.section, r.content) for r in rows] == [("Body", "1. Title\nshort  text")]


def test_chunk_documents(spark):
    sentence = " ".join(["word"] * 39) + "."
    text = " ".join(sentence.capitalize() for _ in range(10))
    df = spark.createDataFrame([("a", text, 1), ("b", None, 2), ("c", " ", 3)], "paper_id string, article string, extra int")
    rows = C.chunk_documents(df).orderBy("chunk_id").collect()
    assert {r.paper_id for r in rows} == {"a"} and {r.extra for r in rows} == {1}
    assert [r.chunk_id for r in rows] == list(range(len(rows)))
    assert all(r.word_count == len(r.text.split()) <= 150 for r in rows)
    assert C.chunk_documents(df.limit(0)).count() == 0
    with pytest.raises(ValueError, match="text"):
        C.chunk_documents(df.withColumnRenamed("extra", "text"))


def test_long_sentence_stays_whole(spark):
    df = spark.createDataFrame([("a", " ".join(["word"] * 400))], "paper_id string, article string")
    assert [r.word_count for r in C.chunk_documents(df).collect()] == [400]


def test_numbering_does_not_depend_on_partitions(spark):
    rows = [(i, "ab"[i % 2]) for i in range(50)] + [(100, None)]
    df = spark.createDataFrame(rows, "id long, split string").repartition(7)
    found = {(r.split, r.id): r.idx for r in C.numbered(df, "split", "id", "idx").collect()}
    assert found == {("ab"[i % 2], i): i // 2 for i in range(50)} | {(None, 100): 0}


def test_rejects_name_the_empty_field(spark):
    df = spark.createDataFrame([(1, "x", "y"), (2, None, " "), (3, "x", None)], "id int, article string, abstract string")
    assert {r.id: r.reason for r in C.rejected_papers(df, "id").collect()} == {2: "empty article, empty abstract", 3: "empty abstract"}
