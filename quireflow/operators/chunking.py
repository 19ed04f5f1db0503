"""Sections and sentence-window chunks of documents.

As expressions everything happens within the row: a document becomes an array of sections and
each section an array of chunks, so no line or sentence is ever shuffled.  The
window is folded over indices and running word counts; texts are only joined at
the end.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quireflow.config import ChunkConfig
from quireflow.functions import text as T
from quireflow.operators import chunk_rows

BODY = chunk_rows.BODY


def sections(text: Column, config: ChunkConfig = ChunkConfig()) -> Column:
    """Array of (section_index, section, content, n_words) of a text, short sections left out.

    Lines that look like headings end a section and title the next; text before
    the first is titled Body.  A heading right after another replaces it.
    """

    def cut(rows: Column) -> Column:
        return T.let(F.transform(rows, lambda x: T.looks_like_heading(x, config)), lambda flags: pieces(rows, flags))

    def pieces(rows: Column, flags: Column) -> Column:
        places = F.filter(F.sequence(F.lit(1), F.greatest(F.size(rows), F.lit(1))), lambda i: F.coalesce(F.get(flags, i - 1), F.lit(False)))
        edges = F.concat(F.array(F.lit(0)), places, F.array(F.size(rows) + 1))
        return T.let(edges, lambda e: F.transform(F.sequence(F.lit(0), F.size(e) - 2), lambda k: piece(rows, F.get(e, k), F.get(e, k + 1))))

    def piece(rows: Column, head: Column, after: Column) -> Column:
        content = F.array_join(F.slice(rows, head + 1, after - head - 1), " ")
        title = F.when(head == 0, F.lit(BODY)).otherwise(T.clean_heading(F.get(rows, head - 1)))
        return T.let(content, lambda c: F.struct(title.alias("section"), c.alias("content"), T.words_of(c).alias("n_words")))

    rows = F.filter(F.transform(T.lines(text), T.normalize_space), lambda x: x != "")
    long = F.filter(T.let(rows, cut), lambda s: s["n_words"] >= config.min_section_words)
    return F.transform(long, lambda s, i: F.struct(i.alias("section_index"), s["section"].alias("section"), s["content"].alias("content"), s["n_words"].alias("n_words")))


def sections_or_body(text: Column, config: ChunkConfig = ChunkConfig()) -> Column:
    """As sections; if none is left, the whole raw text is one section."""
    whole = F.struct(F.lit(0).alias("section_index"), F.lit(BODY).alias("section"), text.alias("content"), T.word_count(text).alias("n_words"))
    return T.let(sections(text, config), lambda s: F.when(F.size(s) > 0, s).otherwise(F.array(whole)))


def window_bounds(words: Column, config: ChunkConfig = ChunkConfig()) -> Column:
    """Array of (first, after) of the windows over sentences with these word counts.

    A window is closed before a sentence that would exceed the limit; the next
    starts with the longest run of its last whole sentences within the overlap.
    A single sentence over the limit stays whole.
    """
    bounds = "array<struct<first:int,after:int>>"
    zero = F.struct(F.lit(0).alias("start"), F.array().cast(bounds).alias("done"))

    def fold(total: Column) -> Column:
        def step(acc: Column, i: Column) -> Column:
            full = (F.get(total, i + 1) - F.get(total, acc["start"]) > config.max_words) & (i > acc["start"])
            skipped = F.size(F.filter(F.slice(total, acc["start"] + 1, i - acc["start"] + 1), lambda c: F.get(total, i) - c > config.overlap_words))
            closed = F.struct((acc["start"] + skipped).alias("start"), F.concat(acc["done"], F.array(F.struct(acc["start"].alias("first"), i.alias("after")))).alias("done"))
            return F.when(full, closed).otherwise(acc)

        def finish(acc: Column) -> Column:
            return F.concat(acc["done"], F.array(F.struct(acc["start"].alias("first"), (F.size(total) - 1).alias("after"))))

        return F.aggregate(F.sequence(F.lit(0), F.size(total) - 2), zero, step, finish)

    totals = F.aggregate(words, F.array(F.lit(0)), lambda acc, w: F.concat(acc, F.array(F.element_at(acc, -1) + w)))
    return F.when(F.size(words) > 0, T.let(totals, fold)).otherwise(F.array().cast(bounds))


def section_chunks(content: Column, config: ChunkConfig = ChunkConfig()) -> Column:
    """Array of (text, word_count) of one section's chunks."""

    def cut(sentences: Column) -> Column:
        bounds = window_bounds(F.transform(sentences, T.word_count), config)
        return F.transform(bounds, lambda b: T.normalize_space(F.array_join(F.slice(sentences, b["first"] + 1, b["after"] - b["first"]), " ")))

    texts = T.let(T.split_sentences(content), cut)
    return F.transform(texts, lambda x: F.struct(x.alias("text"), T.words_of(x).alias("word_count")))


def chunk_array(text: Column, config: ChunkConfig = ChunkConfig()) -> Column:
    """Array of all chunks of a document with their section and places."""

    def of_section(s: Column) -> Column:
        made = section_chunks(s["content"], config)
        return F.transform(
            made,
            lambda c, k: F.struct(
                s["section"].alias("section"),
                c["text"].alias("text"),
                c["word_count"].alias("word_count"),
                s["section_index"].alias("section_index"),
                k.alias("chunk_index_in_section"),
            ),
        )

    return F.flatten(F.transform(sections_or_body(text, config), of_section))


def chunk_documents(papers: DataFrame, id_column: str = "paper_id", text_column: str = "article", config: ChunkConfig = ChunkConfig(), make: Callable[[], chunk_rows.Splitter] | None = None) -> DataFrame:
    """One row for each chunk: the id, chunk_id, section, text, word_count, section_index, chunk_index_in_section.

    Other columns of `papers` are kept.  Blank and null texts have no chunks.
    Batches are cut by the rules in quireflow.operators.chunk_rows; `make`
    returns another sentence splitter.
    """
    if id_column not in papers.columns:
        raise ValueError(f"no column {id_column}")
    return chunk_rows.chunk_documents(papers, text_column, config, make)


def process_documents(papers: DataFrame, id_column: str = "paper_id", text_column: str = "article", config: ChunkConfig = ChunkConfig()) -> DataFrame:
    """(id, num_sections, num_chunks, sections, chunks) of each document with text, as expressions."""
    rows = papers.where(T.safe_strip(F.col(text_column)) != "").select(F.col(id_column), F.col(text_column).alias("__t"))
    done = rows.select(id_column, sections_or_body(F.col("__t"), config).alias("sections"), chunk_array(F.col("__t"), config).alias("chunks"))
    return done.select(id_column, F.size("sections").alias("num_sections"), F.size("chunks").alias("num_chunks"), "sections", "chunks")


def with_min_chunks(chunks: DataFrame, id_column: str, least: int = ChunkConfig.min_chunks) -> DataFrame:
    """Chunks of documents that have at least so many, with their count as num_chunks."""
    counts = chunks.groupBy(id_column).agg(F.count(F.lit(1)).alias("num_chunks")).where(F.col("num_chunks") >= least)
    return chunks.join(counts, id_column)


def rejected_papers(papers: DataFrame, id_column: str, article: str = "article", abstract: str = "abstract") -> DataFrame:
    """(stage, id, reason) of the papers that give no chunks."""
    empty = [F.when(T.clean_field(F.col(c)) == "", F.lit(f"empty {c}")) for c in (article, abstract)]
    reasons = papers.select(F.lit("chunk").alias("stage"), F.col(id_column), F.concat_ws(", ", *empty).alias("reason"))
    return reasons.where(F.col("reason") != "")


def numbered(df: DataFrame, group: str, order: str, name: str) -> DataFrame:
    """Rows numbered from 0 within each group by a unique column, without one task a group.

    Rows are ordered by ranges; each range numbers its own rows and starts
    where the ranges before it, whose sizes are summed, ended.
    """
    from quireflow.session import checkpointed

    ranged = checkpointed(df.repartitionByRange(F.col(group), F.col(order)).withColumn("__part", F.spark_partition_id()))
    sizes = ranged.groupBy("__part", group).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("__start", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    local = F.row_number().over(Window.partitionBy("__part", group).orderBy(order)) - 1
    joined = ranged.withColumn("__at", local).join(starts.withColumnRenamed(group, "__g"), (F.col("__g").eqNullSafe(F.col(group))) & (starts["__part"] == ranged["__part"]))
    return joined.select(*df.columns, (F.col("__start") + F.col("__at")).cast("long").alias(name))
