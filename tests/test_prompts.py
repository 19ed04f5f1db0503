from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from quireflow.config import PromptConfig
from quireflow.operators import metrics as M
from quireflow.operators import prompts as P


def one(spark, column, **values):
    kinds = {"c": "array<string>", "items": "array<struct<section:string,text:string>>", "q": "string", "t": "string"}
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {kinds[k]}" for k in values))
    return df.select(column.alias("v")).first()[0]


def test_contexts_by_hand(spark):
    texts = ["a b", " ", "c"]
    raw = P.format_contexts(F.col("c"), most=2)
    assert one(spark, P.rag_input(F.col("q"), raw), q="Q", c=texts) == "summarize: question: Q context: a b c"
    items = P.format_items(F.col("items"), most=2)
    assert one(spark, P.rag_input(F.col("q"), items), q="Q", items=[(None, t) for t in texts]) == "summarize: question: Q context: a b"
    assert one(spark, P.format_items(F.col("items"), headers=True), items=[("S", "x"), ("", "y"), (None, " ")]) == ["[S] x", "y"]


def test_prompts_without_parts(spark):
    assert one(spark, P.rag_input(F.col("q"), F.col("c")), q="Q", c=[]) == "summarize: question: Q"
    assert one(spark, P.rag_input(F.col("q"), F.col("c")), q=" ", c=[]) is None
    assert one(spark, P.rag_input(F.col("q"), F.col("c")), q=None, c=["x"]) == "summarize: context: x"
    assert one(spark, P.plain_input(F.col("t")), t=" x ") == "summarize: x"
    assert one(spark, P.plain_input(F.col("t")), t=" ") is None


def test_budget_stops_at_the_first_overflow(spark):
    config = PromptConfig(token_budget=5)
    assert one(spark, P.fit_to_budget(F.col("c"), config), c=["a b c", "d e f", "g"]) == ["a b c"]
    assert one(spark, P.fit_to_budget(F.col("c"), PromptConfig(token_budget=6)), c=["a b c", "d e f", "g"]) == ["a b c", "d e f"]
    assert one(spark, P.format_contexts(F.col("c"), PromptConfig(tokens_each=2)), c=["a  b c"]) == ["a b"]


class Words:
    def encode(self, text):
        return [len(w) for w in text.split()]

    def decode(self, ids):
        return " ".join("x" * i for i in ids)


def test_model_tokenizer_and_generator(spark):
    df = spark.createDataFrame([("ab c", "d"), (None, "e f")], "input_text string, target_text string")
    assert [tuple(r) for r in P.tokenized(df, Words, 1, 9).collect()] == [([2], [1], [1]), ([], [], [1, 1])]
    model = P.ModelTokenizer(Words)
    assert [tuple(r) for r in df.select(model.truncate(F.col("input_text"), 1), model.length(F.col("input_text"))).collect()] == [("xx", 2), ("", 0)]
    made = df.select(P.generated(lambda: lambda prompts: [p.upper() for p in prompts])("target_text")).collect()
    assert [r[0] for r in made] == ["D", "E F"]


def test_padding(spark):
    df = spark.createDataFrame([(1, [1, 2]), (1, [3] * 9), (2, [])], "b int, ids array<int>")
    assert [len(r.ids) for r in P.padded_batches(df, "b", {"ids": 0}).orderBy("b", F.desc(F.get("ids", F.lit(8)))).collect()] == [16, 16, 0]


@pytest.mark.parametrize(("word", "stem"), [("caresses", "caress"), ("ponies", "poni"), ("relational", "relat"), ("hopping", "hop"), ("hoping", "hope"), ("agreed", "agre"), ("happy", "happi"), ("adjustable", "adjust"), ("controlling", "control"), ("generalization", "gener"), ("sky", "sky"), ("at", "at")])
def test_stems(word, stem):
    assert M.stem(word) == stem


def lcs(a, b):
    table = np.zeros((len(a) + 1, len(b) + 1), dtype=int)
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1, j + 1] = table[i, j] + 1 if x == y else max(table[i, j + 1], table[i + 1, j])
    return table[-1, -1]


def test_common_subsequences():
    rng = np.random.default_rng(0)
    for _ in range(200):
        a, b = ([str(x) for x in rng.integers(0, 4, rng.integers(0, 12))] for _ in range(2))
        assert M._lcs(a, b) == lcs(a, b)


def test_scores_by_hand(spark):
    df = spark.createDataFrame([(1, "the cat sat", "The cat, the mat."), (2, None, "x"), (3, "", "")], "k int, prediction string, reference string")
    score = lambda f: {r.k: round(r.score, 4) for r in f.collect()}
    assert score(M.rouge_n(df, "k", 1)) == {1: 0.5714, 2: 0.0, 3: 0.0}
    assert score(M.rouge_n(df, "k", 2)) == {1: 0.4, 2: 0.0, 3: 0.0}
    assert score(M.rouge_l(df, "k")) == {1: 0.5714, 2: 0.0, 3: 0.0}
    lines = spark.createDataFrame([(1, "a b\nc d", "c d\na b")], "k int, prediction string, reference string")
    assert score(M.rouge_lsum(lines, "k")) == {1: 1.0} and score(M.rouge_l(lines, "k")) == {1: 0.5}
    stems = spark.createDataFrame([(1, "running", "runs runner running")], "k int, prediction string, reference string")
    assert score(M.rouge_n(stems, "k", 1, prepare=M.stemmed_tokens)) == {1: 0.5}


def test_labels(spark):
    df = spark.createDataFrame([([1, -100, 0],)], "l array<int>")
    assert tuple(df.select(M.unmasked(F.col("l"), 0), M.generated_length(M.unmasked(F.col("l"), 0), 0)).first()) == ([1, 0, 0], 1)
