"""Passages of held-out items inside corpus documents.

Every run of `least_run` tokens of an item is a pattern of one Aho-Corasick
automaton over token numbers, so texts are scanned once whatever the number of
items.  Token numbers come from hashes of whole batches; a token no item has
sends the automaton to its root, so only stretches of known tokens are fed to
it.  Hits are joined to passages and mapped back to positions in the text.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quireflow.llm.pairs import bounded, string_values
from quireflow.llm.tokens import code_points, token_hashes, token_spans

_MOST_PATTERNS = 400_000  # in one automaton, which bounds what is broadcast; more items are scanned for in blocks
_machines: dict[str, ahocorasick.Automaton] = {}  # the last one this worker compiled


@dataclass(frozen=True)
class Automaton:
    """Patterns of a block of items: sorted token hashes, their runs and the items that have each run."""

    vocabulary: np.ndarray
    runs: list[tuple[int, ...]]
    items: list[list[int]]
    width: int
    name: str = field(default_factory=lambda: str(uuid.uuid4()))

    @staticmethod
    def of(rows: list[tuple[int, str | None]], width: int) -> Automaton:
        hashes, offsets = token_hashes([text for _, text in rows])
        vocabulary = np.unique(hashes)
        numbers = np.searchsorted(vocabulary, hashes) + 1
        found: dict[tuple[int, ...], set[int]] = {}
        for k, (item, _) in enumerate(rows):
            mine = numbers[offsets[k] : offsets[k + 1]].tolist()
            for i in range(len(mine) - width + 1):
                found.setdefault(tuple(mine[i : i + width]), set()).add(item)
        return Automaton(vocabulary, list(found), [sorted(x) for x in found.values()], width)

    def compiled(self) -> ahocorasick.Automaton:
        """The automaton, which a worker compiles once, not once a task."""
        if self.name in _machines:
            return _machines[self.name]
        machine = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
        for k, run in enumerate(self.runs):
            machine.add_word(run, k)
        machine.make_automaton()
        _machines.clear()
        _machines[self.name] = machine
        return machine

    def scan(self, machine: ahocorasick.Automaton, texts: list[str | None]) -> Iterator[tuple[int, int, int, int]]:
        """(text, item, first token, token after the last) of every longest passage, tokens counted from the text's start."""
        if not self.runs:
            return
        hashes, offsets = token_hashes(texts)
        at = np.searchsorted(self.vocabulary, hashes)
        at[at == len(self.vocabulary)] = 0
        numbers = np.where(self.vocabulary[at] == hashes, at + 1, 0)
        # stretches of at least `width` known tokens that lie in one text
        known = np.zeros(len(numbers) + 2, dtype=np.int8)
        known[1:-1] = numbers > 0
        edges = np.unique(np.concatenate([np.flatnonzero(np.diff(known)), offsets]))
        stretch = np.flatnonzero((np.diff(edges) >= self.width) & (numbers[np.minimum(edges[:-1], len(numbers) - 1)] > 0)) if len(numbers) else []
        for k in stretch:
            start, stop = int(edges[k]), int(edges[k + 1])
            text = int(np.searchsorted(offsets, start, side="right")) - 1
            base = int(offsets[text])
            open_runs: dict[int, list[int]] = {}
            for end, run in machine.iter(tuple(numbers[start:stop].tolist())):
                last = start + end + 1
                first = last - self.width
                for item in self.items[run]:
                    passage = open_runs.get(item)
                    if passage and first == passage[1] - self.width + 1:
                        passage[1] = last
                    else:
                        if passage:
                            yield text, item, passage[0] - base, passage[1] - base
                        open_runs[item] = [first, last]
            for item, (first, last) in open_runs.items():
                yield text, item, first - base, last - base


def original_span(text: str, first: int, last: int) -> tuple[int, int]:
    """Positions in the text of the tokens first to last - 1 of its lower-cased form."""
    low = text.lower()
    starts, ends = token_spans(code_points(low))
    a, b = int(starts[first]), int(ends[last - 1])
    if len(low) == len(text):
        return a, b
    sizes = np.array([len(c.lower()) for c in text])
    begins = np.cumsum(sizes) - sizes
    return int(np.searchsorted(begins, a, side="right")) - 1, int(np.searchsorted(begins, b, side="left"))


def _blocks(items: DataFrame, width: int) -> Iterator[list[tuple[int, str | None]]]:
    """The items' texts in blocks of a bounded number of patterns."""
    block: list[tuple[int, str | None]] = []
    patterns = 0
    for row in items.toLocalIterator():
        n_tokens = np.diff(token_hashes(row[1:])[1]).tolist()
        for text, n in zip(row[1:], n_tokens, strict=True):
            size = max(0, n - width + 1)
            if block and patterns + size > _MOST_PATTERNS:
                yield block
                block, patterns = [], 0
            block.append((row[0], text))
            patterns += size
    if block:
        yield block


def leaks(
    documents: DataFrame,
    items: DataFrame,
    doc_id: str,
    text: str,
    item_id: str,
    item_texts: list[str],
    least_run: int = 12,
) -> DataFrame:
    """(doc, item, first, last, start_pos, end_pos) of every passage of an item in a document.

    A passage is a longest run of at least `least_run` consecutive tokens of
    one of the item's texts, side by side and in order in the document; first
    and last count its tokens (last is excluded), start_pos and end_pos are
    code points of the original text.  Null and empty texts, and items with
    fewer tokens, have none.  Repeated rows are found each.  The items, a
    held-out set, are read to the driver in blocks of a bounded number of
    patterns, each of which is one automaton and one scan.
    """
    source = documents.select(F.col(doc_id).cast("long").alias("doc"), F.col(text).alias("text")).where("doc is not null and text is not null")
    wanted = items.select(F.col(item_id).cast("long"), *item_texts).where(F.col(item_id).isNotNull())
    parts = [_scan(source, Automaton.of(block, least_run)) for block in _blocks(wanted, least_run)]
    if not parts:
        parts = [_scan(source, Automaton.of([], least_run))]
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out


def _scan(source: DataFrame, automaton: Automaton) -> DataFrame:
    shared = source.sparkSession.sparkContext.broadcast(automaton)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = shared.value.compiled()
        for batch in bounded(batches, 1):
            texts = string_values(batch.column(1))
            rows = sorted(shared.value.scan(machine, texts))
            spans = [original_span(texts[k] or "", first, last) for k, _, first, last in rows]
            columns = [[r[1] for r in rows], [r[2] for r in rows], [r[3] for r in rows], [x[0] for x in spans], [x[1] for x in spans]]
            docs = batch.column(0).take(pa.array([r[0] for r in rows], pa.int64()))
            yield pa.RecordBatch.from_arrays([docs, *(pa.array(x, pa.int64()) for x in columns)], names=["doc", "item", "first", "last", "start_pos", "end_pos"])

    return source.mapInArrow(run, "doc long, item long, first long, last long, start_pos long, end_pos long")
