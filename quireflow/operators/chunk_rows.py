"""Chunking of whole Arrow batches.

The same rules as the expressions in quireflow.operators.chunking, which one
can use inside a query.  A batch of documents is cut here several times faster:
expressions on arrays are interpreted element by element, and their regular
expressions test each character against a wide class of spaces.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quireflow.config import ChunkConfig
from quireflow.functions.text import SECTION_TITLES

BODY = "Body"
_NUMBERED = regex.compile(r"(?:\p{Nd}+(?:\.\p{Nd}+){0,3}|[IVXLCDM]+)[.):]? +([A-Za-z].+)")
_CAPITAL = regex.compile(r"\p{Lu}")
_SMALL = regex.compile(r"[\p{Ll}\p{Lt}]")
_CAPITALISED = regex.compile(r"(?:^| )\p{Lu}")
_RUN = regex.compile(r"\p{L}+")
_BETWEEN = regex.compile(r"(?<=[.!?])\s+(?=[A-Z])")
_TITLES = frozenset(SECTION_TITLES)


def heading(line: str, n_words: int, config: ChunkConfig) -> bool:
    """Whether a normalised line that isn't empty reads like a heading."""
    if len(line) > config.heading_max_chars or (n_words > 3 and line[-1] == "."):
        return False
    if match := _NUMBERED.fullmatch(line):
        return len(match[1].split()) <= config.heading_max_words
    if 2 <= n_words <= 10 and _CAPITAL.search(line) and not _SMALL.search(line):
        return True
    if line.lower() in _TITLES:
        return True
    return n_words <= 10 and len(_CAPITALISED.findall(line)) * 10 >= n_words * config.title_ratio_tenths


def heading_title(line: str) -> str:
    if match := _NUMBERED.fullmatch(line):
        return match[1].strip()
    if _CAPITAL.search(line) and not _SMALL.search(line):
        return _RUN.sub(lambda m: m[0][0].upper() + m[0][1:].lower(), line)
    return line


def parse_sections(text: str, config: ChunkConfig = ChunkConfig()) -> list[tuple[str, str, int]]:
    """(title, content, words) of the sections that are long enough."""
    found: list[tuple[str, str, int]] = []
    title, held, total = BODY, [], 0
    for raw in [*text.splitlines(), None]:
        words = raw.split() if raw is not None else []
        line = " ".join(words)
        if raw is not None and (not words or not heading(line, len(words), config)):
            if words:
                held.append(line)
                total += len(words)
            continue
        if held and total >= config.min_section_words:
            found.append((title, " ".join(held), total))
        held, total = [], 0
        title = heading_title(line) if raw is not None else title
    return found


def sections_or_body(text: str, config: ChunkConfig = ChunkConfig()) -> list[tuple[str, str, int]]:
    return parse_sections(text, config) or [(BODY, text, len(text.split()))]


def windows(words: list[int], config: ChunkConfig = ChunkConfig()) -> list[tuple[int, int]]:
    """First and after of the windows over sentences with these word counts."""
    out, first, held = [], 0, 0
    for i, size in enumerate(words):
        if held + size > config.max_words and i > first:
            out.append((first, i))
            while held > config.overlap_words:
                held -= words[first]
                first += 1
        held += size
    if words:
        out.append((first, len(words)))
    return out


Splitter = Callable[[str], list[str]]


def split_sentences(text: str) -> list[str]:
    """Parts between an end mark and white space before a Latin capital: the splitter where no other is given."""
    return _BETWEEN.split(text)


def chunk_text(text: str, config: ChunkConfig = ChunkConfig(), split: Splitter = split_sentences) -> Iterator[tuple[str, str, int, int, int]]:
    """(section, text, word_count, section_index, chunk_index_in_section) of a document's chunks."""
    for index, (title, content, _) in enumerate(sections_or_body(text, config)):
        sentences = [p for p in (s.split() for s in split(content)) if p]
        for k, (first, after) in enumerate(windows([len(p) for p in sentences], config)):
            words = [w for p in sentences[first:after] for w in p]
            yield title, " ".join(words), len(words), index, k


_COLUMNS = ("chunk_id", "section", "text", "word_count", "section_index", "chunk_index_in_section")
_TYPES = (pa.int32(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32())
_SCHEMA = "chunk_id int, section string, text string, word_count int, section_index int, chunk_index_in_section int"


def chunk_documents(papers: DataFrame, text_column: str, config: ChunkConfig = ChunkConfig(), make: Callable[[], Splitter] | None = None) -> DataFrame:
    """One row for each chunk with the other columns of its paper; `make` returns another sentence splitter, once a worker's task.

    If that splitter fails on a text, the text is split as without one.
    """
    kept = [c for c in papers.columns if c != text_column]
    if clash := set(_COLUMNS) & set(kept):
        raise ValueError(f"columns {sorted(clash)} would be overwritten")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = split_sentences if make is None else _or_plain(make())
        for batch in batches:
            owner, rows = [], []
            for i, text in enumerate(batch.column(len(kept)).to_pylist()):
                if not text.strip():
                    continue
                made = [(k, *c) for k, c in enumerate(chunk_text(text, config, split))]
                rows += made
                owner += [i] * len(made)
            same = pa.array(np.array(owner, dtype=np.int64))
            columns = zip(*rows, strict=True) if rows else ((),) * len(_COLUMNS)
            arrays = [pa.array(list(c), t) for c, t in zip(columns, _TYPES, strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(same) for k in range(len(kept))), *arrays], names=[*kept, *_COLUMNS])

    rows = papers.where(F.col(text_column).isNotNull()).select(*kept, text_column)
    fields = [f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in kept]
    return rows.mapInArrow(run, ", ".join([*fields, _SCHEMA]))


def _or_plain(split: Splitter) -> Splitter:
    def either(text: str) -> list[str]:
        try:
            return list(split(text))
        except Exception:  # whatever a foreign splitter raises
            return split_sentences(text)

    return either


def section_rows(papers: DataFrame, id_column: str, text_column: str, config: ChunkConfig = ChunkConfig(), fallback: bool = False) -> DataFrame:
    """(id, section_index, section, content, n_words); with `fallback` also the whole text of papers without any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, rows = [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                found = (sections_or_body if fallback else parse_sections)(text, config) if text.strip() else []
                rows += [(k, *s) for k, s in enumerate(found)]
                owner += [i] * len(found)
            columns = zip(*rows, strict=True) if rows else ((),) * 4
            arrays = [pa.array(list(c), t) for c, t in zip(columns, (pa.int32(), pa.string(), pa.string(), pa.int32()), strict=True)]
            ids = batch.column(0).take(pa.array(np.array(owner, dtype=np.int64)))
            yield pa.RecordBatch.from_arrays([ids, *arrays], names=[id_column, "section_index", "section", "content", "n_words"])

    rows = papers.where(F.col(text_column).isNotNull()).select(id_column, text_column)
    kind = rows.schema[0].dataType.simpleString()
    return rows.mapInArrow(run, f"`{id_column}` {kind}, section_index int, section string, content string, n_words int")


def document_counts(papers: DataFrame, id_column: str, text_column: str, config: ChunkConfig = ChunkConfig()) -> DataFrame:
    """(id, num_sections, num_chunks) of each paper with text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            keep = [i for i, t in enumerate(texts) if t.strip()]
            found = [(len(sections_or_body(texts[i], config)), sum(1 for _ in chunk_text(texts[i], config))) for i in keep]
            arrays = [pa.array([f[k] for f in found], pa.int32()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.array(keep, dtype=np.int64))), *arrays], names=[id_column, "num_sections", "num_chunks"])

    rows = papers.where(F.col(text_column).isNotNull()).select(id_column, text_column)
    kind = rows.schema[0].dataType.simpleString()
    return rows.mapInArrow(run, f"`{id_column}` {kind}, num_sections int, num_chunks int")
