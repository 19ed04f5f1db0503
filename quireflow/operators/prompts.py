"""Prompts under token budgets, and token arrays."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quireflow.config import PromptConfig
from quireflow.functions import text as T


class Tokenizer(Protocol):
    """What truncation and budgets need of a tokenizer."""

    def truncate(self, text: Column, most: int) -> Column: ...

    def length(self, text: Column) -> Column: ...


class WhitespaceTokenizer:
    """Words between white space; runs inside the engine."""

    def truncate(self, text: Column, most: int) -> Column:
        return F.array_join(F.slice(F.split(T.normalize_space(text), " "), 1, most), " ")

    def length(self, text: Column) -> Column:
        return T.word_count(text)


class ModelTokenizer:
    """A tokenizer object with encode(text) -> ids and decode(ids) -> text, made once a worker."""

    def __init__(self, make: Callable[[], object]) -> None:
        @F.arrow_udf("string")
        def truncated(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
            model = make()
            for texts, limits in batches:
                yield pa.array([model.decode(model.encode(t or "")[:n]) for t, n in zip(texts.to_pylist(), limits.to_pylist(), strict=True)], pa.string())

        @F.arrow_udf("int")
        def counted(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            model = make()
            for texts in batches:
                yield pa.array([len(model.encode(t or "")) for t in texts.to_pylist()], pa.int32())

        self._truncated, self._counted = truncated, counted

    def truncate(self, text: Column, most: int) -> Column:
        return self._truncated(text, F.lit(most))

    def length(self, text: Column) -> Column:
        return self._counted(text)


def format_contexts(contexts: Column, config: PromptConfig = PromptConfig(), most: int | None = None) -> Column:
    """Raw contexts: stripped, blank ones dropped, then cut to the first `most`, then each truncated by words."""
    clean = F.filter(F.transform(contexts, T.safe_strip), lambda c: c != "")
    first = clean if most is None else F.slice(clean, 1, most)
    return F.transform(first, lambda c: WhitespaceTokenizer().truncate(c, config.tokens_each))


def format_items(items: Column, config: PromptConfig = PromptConfig(), most: int | None = None, headers: bool = False) -> Column:
    """Retrieved items (section, text): cut to the first `most`, then blank ones dropped, headers added, truncated."""
    first = items if most is None else F.slice(items, 1, most)
    full = F.filter(first, lambda i: T.safe_strip(i["text"]) != "")

    def one(item: Column) -> Column:
        text = T.safe_strip(item["text"])
        return WhitespaceTokenizer().truncate(T.with_section_header(item["section"], text) if headers else text, config.tokens_each)

    return F.transform(full, one)


def fit_to_budget(contexts: Column, config: PromptConfig = PromptConfig()) -> Column:
    """The leading contexts whose words stay within the budget; it stops at the first that doesn't fit."""
    start = F.struct(F.lit(0).alias("used"), F.lit(True).alias("open"), F.lit(0).alias("n"))

    def step(acc: Column, context: Column) -> Column:
        size = F.least(T.word_count(context), F.lit(config.tokens_each))
        fits = acc["open"] & (acc["used"] + size <= config.token_budget)
        return F.struct((acc["used"] + F.when(fits, size).otherwise(0)).alias("used"), fits.alias("open"), (acc["n"] + F.when(fits, 1).otherwise(0)).alias("n"))

    return F.slice(contexts, F.lit(1), F.aggregate(contexts, start, step, lambda acc: acc["n"]))


def plain_input(text: Column, prefix: str = PromptConfig.task_prefix) -> Column:
    """prefix: text; null for a blank text, which has no prompt."""
    return T.let(T.safe_strip(text), lambda t: F.when(t != "", F.concat(F.lit(f"{prefix}: "), t)))


def rag_input(query: Column, contexts: Column, config: PromptConfig = PromptConfig()) -> Column:
    """prefix: question: Q context: C1 C2 of formatted contexts within the budget; null if there is neither."""
    asked = T.let(T.safe_strip(query), lambda q: F.when(q != "", F.concat(F.lit("question: "), q)))
    told = T.let(fit_to_budget(contexts, config), lambda c: F.when(F.size(c) > 0, F.concat(F.lit("context: "), F.array_join(c, " "))))
    parts = F.concat_ws(" ", asked, told)
    return F.when(parts != "", F.concat(F.lit(f"{config.task_prefix}: "), parts))


def token_ids(make: Callable[[], object], most: int) -> Callable[..., Column]:
    """An Arrow function text -> ids, truncated; the model is made once a worker."""

    @F.arrow_udf("array<int>")
    def ids(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = make()
        for texts in batches:
            yield pa.array([list(model.encode(t or ""))[:most] for t in texts.to_pylist()], pa.list_(pa.int32()))

    return ids


def tokenized(df: DataFrame, make: Callable[[], object], most_input: int = 512, most_target: int = 128) -> DataFrame:
    """(input_ids, attention_mask, labels) of (input_text, target_text); other columns are dropped."""
    ids = df.select(token_ids(make, most_input)(F.col("input_text")).alias("input_ids"), token_ids(make, most_target)(F.col("target_text")).alias("labels"))
    return ids.select("input_ids", F.transform("input_ids", lambda x: F.lit(1)).alias("attention_mask"), "labels")


def padded(array: Column, length: Column, pad: int) -> Column:
    """An array filled up to a length."""
    return F.concat(array, F.array_repeat(F.lit(pad), F.greatest(length - F.size(array), F.lit(0))))


def padded_batches(df: DataFrame, batch: str, columns: dict[str, int], multiple: int = 8) -> DataFrame:
    """Arrays of each batch padded to its longest, rounded up to a multiple; columns name their pad value."""
    longest = df.groupBy(batch).agg(*[(F.ceil(F.max(F.size(c)) / multiple) * multiple).cast("int").alias(f"__{c}") for c in columns])
    return df.join(longest, batch).select(*[padded(F.col(c), F.col(f"__{c}"), columns[c]).alias(c) if c in columns else F.col(c) for c in df.columns])


def generated(make: Callable[[], Callable[[list[str]], list[str]]], batch: int = 16) -> Callable[..., Column]:
    """An Arrow function text -> summary by a model made once a worker.

    `make` returns a function from a list of prompts to their summaries.
    """

    @F.arrow_udf("string")
    def generate(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = make()
        for texts in batches:
            prompts = [t or "" for t in texts.to_pylist()]
            yield pa.array([s for a in range(0, len(prompts), batch) for s in model(prompts[a : a + batch])], pa.string())

    return generate
