"""What the operators on pairs of texts share: shingle sets, exact checks and components.

Ids are 64-bit integers.  Nothing here collects ids, links or components to the
driver; the one thing broadcast is a Bloom filter of a fixed size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quireflow.llm.tokens import distinct_shingles
from quireflow.session import checkpointed

_SLICE_BYTES = 8 << 20
_BLOOM_WORDS = 1 << 18  # 64-bit words; 2 MB, whatever the number of ids


class Bloom:
    """A blocked Bloom filter over ids: two bits in one word of a fixed table.

    With more ids it lets more through; what it lets through is checked later.
    """

    def __init__(self, words: np.ndarray) -> None:
        self.words = words

    @staticmethod
    def of(ids: DataFrame, column: str) -> Bloom:
        return Bloom.of_hashes(ids.select(F.xxhash64(column).alias("h")), "h")

    @staticmethod
    def of_hashes(ids: DataFrame, column: str) -> Bloom:
        """Of numbers that are hashes already."""
        hashed = ids.select(F.col(column).alias("h"))
        word = F.pmod("h", F.lit(_BLOOM_WORDS)).cast("int")
        bits = F.expr("shiftleft(1L, int(pmod(h >> 20, 64))) | shiftleft(1L, int(pmod(h >> 32, 64)))")
        rows = hashed.groupBy(word.alias("word")).agg(F.bit_or(bits).alias("bits")).toArrow()  # at most _BLOOM_WORDS rows
        words = np.zeros(_BLOOM_WORDS, dtype=np.int64)
        words[rows["word"].to_numpy()] = rows["bits"].to_numpy()
        return Bloom(words)

    def may_hold(self, hashed: np.ndarray) -> np.ndarray:
        word = self.words[np.mod(hashed, _BLOOM_WORDS)]
        return ((word >> np.mod(hashed >> 20, 64)) & (word >> np.mod(hashed >> 32, 64)) & 1).astype(bool)


def bounded(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    """The batches in slices of a bounded number of bytes in a column of texts; a longer text is a slice alone.

    What is computed for a slice at once takes many times its texts' memory.
    """
    for batch in batches:
        sizes = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        part = (np.cumsum(sizes) - sizes) // _SLICE_BYTES
        cuts = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            yield batch.slice(a, b - a)


def string_values(column: pa.Array) -> list[str | None]:
    return column.to_pylist()


def shingle_sets(df: DataFrame, width: int, least_tokens: int, ids: DataFrame | None = None) -> DataFrame:
    """(id, shingles) of the rows of df(id, text) that have any.

    With `ids`, a frame of one column `id`, only rows whose id is in it are
    sure to come out; a few others may.
    """
    shared = df.sparkSession.sparkContext.broadcast(Bloom.of(ids, "id")) if ids is not None else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, 2):
            if shared is not None:
                keep = shared.value.may_hold(batch.column(1).to_numpy(zero_copy_only=False))
                batch = batch.filter(pa.array(keep))
            flat, offsets, _ = distinct_shingles(string_values(batch.column(2)), width, least_tokens)
            sets = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat.view(np.int64)))
            out = pa.RecordBatch.from_arrays([batch.column(0), sets], names=["id", "shingles"])
            yield out.filter(pa.array(np.diff(offsets) > 0))

    return df.select("id", F.xxhash64("id").alias("h"), "text").mapInArrow(run, "id long, shingles array<long>")


def similarity(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays without repeated elements."""
    both = F.size(F.array_intersect(a, b))
    return both / (F.size(a) + F.size(b) - both)


def verified(pairs: DataFrame, texts: DataFrame, width: int, least_tokens: int, threshold: float) -> DataFrame:
    """The pairs (a, b) whose texts' exact similarity reaches the threshold, with it.

    `pairs` should be checkpointed, as it is read three times.  Texts are read
    again and only those of candidate ids are hashed, so that sets of all
    texts are never stored.
    """
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id")))
    sets = shingle_sets(texts, width, least_tokens, ids)
    left = sets.select(F.col("id").alias("a"), F.col("shingles").alias("left"))
    right = sets.select(F.col("id").alias("b"), F.col("shingles").alias("right"))
    return (
        pairs.join(left, "a")
        .join(right, "b")
        .select("a", "b", similarity(F.col("left"), F.col("right")).alias("similarity"))
        .where(F.col("similarity") >= threshold)
    )


def components(links: DataFrame) -> DataFrame:
    """(id, root) of every id in links (a, b): root is the least id of its component.

    Alternates large-star and small-star rounds, which end after a number of
    rounds logarithmic in the largest component; each node's least neighbour
    comes from an aggregation and a join, so no neighbourhood is collected.
    """
    # an edge hangs a larger id `v` under a smaller id `u`
    edges = checkpointed(links.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).where("u < v").distinct())
    mark = _mark(edges)
    while mark[0]:
        both = edges.union(edges.select(F.col("u").alias("v"), F.col("v").alias("u")))
        least = both.groupBy("v").agg(F.min("u").alias("m")).select("v", F.least("v", "m").alias("m"))
        # large star: every larger neighbour of v hangs under the least of v's neighbours
        large = both.where("u > v").join(least, "v").select(F.col("u").alias("v"), F.col("m").alias("u")).distinct()
        # small star: v and its smaller neighbours hang under the least of them
        low = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(low, "v").where("u > m").select(F.col("u").alias("v"), F.col("m").alias("u"))
        edges = checkpointed(low.withColumnRenamed("m", "u").union(small).distinct())
        if (after := _mark(edges)) == mark:
            break
        mark = after
    roots = edges.select(F.col("v").alias("id"), F.col("u").alias("root"))
    return roots.union(roots.select(F.col("root").alias("id"), "root").distinct())


def _mark(edges: DataFrame) -> tuple[int, int]:
    """Count and checksum, by which a round that changes nothing is seen."""
    row = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("v", "u"))).first()
    return (row[0], row[1] or 0) if row else (0, 0)
