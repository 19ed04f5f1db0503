"""The exact join of sets by rare shingles of their prefixes.

Shingles have one order, rarest first.  Two sets that reach the threshold share
a shingle among the first n - ceil(threshold * n) + 1 of each, and the first one
they share stands so early in the smaller set that the rest of it suffices.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quireflow.llm.pairs import bounded, string_values
from quireflow.llm.tokens import distinct_shingles

SKETCH = 1 << 24  # cells of one byte: 16 MB, whatever the number of texts
_SEGMENT = 1 << 16
_BLOCK_PAIRS = 1 << 20  # pairs of a shingle that are compared at once


def _packed(at: int, counts: np.ndarray) -> pa.RecordBatch:
    data = pa.compress(counts.tobytes(), "zstd", asbytes=True)
    return pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([data], pa.binary())], names=["segment", "counts"])


def shingle_ranks(texts: DataFrame, width: int, least_tokens: int) -> np.ndarray:
    """How common the shingles of each cell are: 0 for none, 1 for one text, and 8 more each time their number doubles.

    A fixed size.  Counts are exact until they are ranked at the end, so that
    the commonest shingles are last in the order.  Shingles that fall together
    only move later in it, which any total order may do without losing a pair.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(SKETCH, dtype=np.uint32)
        for batch in bounded(batches, 0):
            flat, _, _ = distinct_shingles(string_values(batch.column(0)), width, least_tokens)
            cells, n = np.unique(flat % np.uint64(SKETCH), return_counts=True)
            counts[cells.astype(np.int64)] += n.astype(np.uint32)
        parts = counts.reshape(-1, _SEGMENT)
        for at in np.flatnonzero(parts.any(axis=1)).tolist():
            yield _packed(at, parts[at])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for at, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                counts = np.frombuffer(pa.decompress(packed, 4 * _SEGMENT, "zstd", asbytes=True), dtype=np.uint32)
                held[at] = held.get(at, np.zeros(_SEGMENT, dtype=np.uint64)) + counts
        for at, counts in held.items():
            ranks = np.where(counts > 0, 1 + np.round(8 * np.log2(np.maximum(counts, 1))), 0)
            yield _packed(at, np.minimum(ranks, 255).astype(np.uint8))

    kind = "segment int, counts binary"
    rows = texts.select("text").mapInArrow(run, kind).repartition("segment").mapInArrow(add, kind).toArrow()  # at most 16 MB
    out = np.zeros(SKETCH, dtype=np.uint8)
    for at, packed in zip(rows["segment"].to_pylist(), rows["counts"].to_pylist(), strict=True):
        out[at * _SEGMENT : (at + 1) * _SEGMENT] = np.frombuffer(pa.decompress(packed, _SEGMENT, "zstd", asbytes=True), dtype=np.uint8)
    return out


def _largest_partner(n: np.ndarray, at: np.ndarray, threshold: float) -> np.ndarray:
    """The largest set that a set of n can reach the threshold with if the first shingle they share stands at this place."""
    return np.floor((n - at) * (1 + threshold) / threshold - n + 1e-9).astype(np.int64)


def _meetings(held: list[np.ndarray], asks: list[np.ndarray], threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (i of asks, j of held) that have a shingle in common, are in different groups and may be similar by size; j is not the larger.

    Both are lists (key, root, id, n, at).  Of a shingle's held rows only the
    range of sizes that fits is passed over, and where most of them are of the
    asking row's own group, only the others.
    """
    (key, root, _, n, _), (key_a, root_a, _, n_a, at_a) = held, asks
    order = np.lexsort((n, key))
    keys, segment = np.unique(key[order], return_inverse=True)
    if not len(keys) or not len(key_a):
        return
    where = np.minimum(np.searchsorted(keys, key_a), len(keys) - 1)
    there = keys[where] == key_a
    # the commonest group of each shingle's held rows
    runs, counts = np.unique(np.stack([segment, root[order]]), axis=1, return_counts=True)
    by_count = np.lexsort((counts, runs[0]))
    common = runs[1][by_count[np.append(np.flatnonzero(np.diff(runs[0][by_count])), len(by_count) - 1)]]
    low = np.ceil(threshold * n_a - 1e-9).astype(np.int64)
    high = np.minimum(_largest_partner(n_a, at_a, threshold), n_a)
    other = root[order] != common[segment]
    for rows, mine in ((order, there & (root_a != common[where])), (order[other], there & (root_a == common[where]))):
        place = (segment if len(rows) == len(order) else segment[other]) * (1 << 32) + n[rows]
        todo = np.flatnonzero(mine & (high >= low))
        first = np.searchsorted(place, where[todo] * (1 << 32) + low[todo])
        size = np.searchsorted(place, where[todo] * (1 << 32) + high[todo], side="right") - first
        total = np.concatenate([[0], np.cumsum(np.maximum(size, 0))])
        for at in range(0, int(total[-1]), _BLOCK_PAIRS):
            k = np.arange(at, min(at + _BLOCK_PAIRS, int(total[-1])))
            row = np.searchsorted(total, k, side="right") - 1
            yield todo[row], rows[first[row] + k - total[row]]


def prefix_join(entries: DataFrame, threshold: float) -> DataFrame:
    """Distinct pairs (a, b) of ids in different groups that may reach the threshold; none that does is missing.

    `entries` (key, root, id, n, at) are the shingles of the sets' prefixes
    with the set's group, size and the shingle's place.  a is of the lower root.
    A set asks for partners no larger than it is by all of its shingles and is
    held by those of the shorter prefix in which the first one it shares with a
    larger set must stand.  So a passage that very many texts share, which
    stands behind their own words, is asked for but hardly held.
    """
    names = ["key", "root", "id", "n", "at"]
    shorter = lambda n: n - np.ceil(2 * threshold / (1 + threshold) * n - 1e-9)

    def pairs(held: list[np.ndarray], asks: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        for i, j in _meetings(held, asks, threshold):
            near = (held[1][j] != asks[1][i]) & ((held[3][j] < asks[3][i]) | (held[2][j] < asks[2][i]))
            i, j = i[near], j[near]
            need = np.ceil(threshold / (1 + threshold) * (asks[3][i] + held[3][j]) - 1e-9)
            fits = np.minimum(asks[3][i] - asks[4][i], held[3][j] - held[4][j]) >= need
            i, j = i[fits], j[fits]
            lower = asks[1][i] < held[1][j]
            a, b = np.where(lower, asks[2][i], held[2][j]), np.where(lower, held[2][j], asks[2][i])
            order = np.lexsort((b, a))
            a, b = a[order], b[order]
            new = np.ones(len(a), dtype=bool)
            new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
            yield pa.RecordBatch.from_arrays([pa.array(a[new]), pa.array(b[new])], names=["a", "b"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # of a batch's last shingle held rows go on: those that still have to ask, once all are there, and those that have
        waiting, done = ([np.zeros(0, dtype=np.int64) for _ in names] for _ in range(2))
        for batch in batches:
            rows = [np.concatenate([w, batch.column(c).to_numpy()]) for c, w in zip(names, waiting, strict=True)]
            if not len(rows[0]):
                continue
            early = rows[4] <= shorter(rows[3])
            last = rows[0] == rows[0][-1]
            open_end = last & early if early[last].all() else np.zeros(len(last), dtype=bool)
            held = [np.concatenate([d, x[early & ~open_end]]) for d, x in zip(done, rows, strict=True)]
            yield from pairs(held, [x[~open_end] for x in rows])
            waiting = [x[open_end] for x in rows]
            same = held[0] == rows[0][-1]
            done = [x[same] for x in held]
        yield from pairs([np.concatenate([d, w]) for d, w in zip(done, waiting, strict=True)], waiting)

    late = F.col("at") > F.col("n") - F.ceil(F.lit(2 * threshold / (1 + threshold)) * F.col("n") - F.lit(1e-9))
    ordered = entries.select(*names).repartition("key").sortWithinPartitions(F.col("key"), late)
    return ordered.mapInArrow(meet, "a long, b long").distinct()
