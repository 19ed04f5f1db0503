"""Texts of evaluation splits that recur in a training split.

An exact prefix-filter join of two sides.  Shingles are ordered by how many
evaluation texts hold them, rarest first, so a training text begins with the
shingles no evaluation text has.  Two texts of similarity t or more share a
shingle of their prefixes; evaluation prefixes are indexed, training prefixes
probe the index, and the length filter, the position filter and a bound from the
number of shared prefix shingles drop pairs before the overlap is counted on
whole sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quireflow.llm.pairs import bounded, string_values, verified
from quireflow.llm.prefixes import SKETCH, shingle_ranks
from quireflow.llm.tokens import distinct_shingles, mix, signatures, token_hashes
from quireflow.session import checkpointed

def _prefixes(texts: DataFrame, width: int, least_tokens: int, threshold: float, sketch: np.ndarray) -> DataFrame:
    """(id, held_out, sig, sig2, n, shingles, places) of each usable text.

    sig and sig2 hash its tokens, n is the size of its set, shingles are those
    of its prefix that the sketch knows and places where they stand in the set
    in the common order.  All hashes depend on `within`.
    """
    shared = texts.sparkSession.sparkContext.broadcast(sketch)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, 1):
            texts_here = string_values(batch.column(1))
            one, two = signatures(*token_hashes(texts_here))
            flat, offsets, _ = distinct_shingles(texts_here, width, least_tokens)
            within = mix(batch.column(3).to_numpy().view(np.uint64))
            sizes = np.diff(offsets)
            owner = np.repeat(np.arange(len(sizes)), sizes)
            rank = shared.value[(flat % np.uint64(SKETCH)).astype(np.int64)]
            order = np.lexsort((flat, rank, owner))
            flat, rank = flat[order], rank[order]
            place = np.arange(len(flat)) - np.repeat(offsets[:-1], sizes)
            prefix = sizes - np.ceil(threshold * sizes - 1e-9).astype(np.int64) + 1
            keep = np.flatnonzero((rank > 0) & (place < prefix[owner]))
            ends = np.concatenate([[0], np.cumsum(np.bincount(owner[keep], minlength=len(sizes)))]).astype(np.int32)
            shingles = pa.ListArray.from_arrays(pa.array(ends), pa.array((flat[keep] ^ within[owner[keep]]).view(np.int64)))
            places = pa.ListArray.from_arrays(pa.array(ends), pa.array(place[keep].astype(np.int32)))
            columns = [batch.column(0), batch.column(2), pa.array((one ^ within).view(np.int64)), pa.array((two ^ within).view(np.int64)), pa.array(sizes.astype(np.int32)), shingles, places]
            names = ["id", "held_out", "sig", "sig2", "n", "shingles", "places"]
            yield pa.RecordBatch.from_arrays(columns, names=names).filter(pa.array(sizes > 0))

    kind = "id long, held_out boolean, sig long, sig2 long, n int, shingles array<long>, places array<int>"
    return texts.select("id", "text", "held_out", "within").mapInArrow(run, kind)


def overlaps(
    df: DataFrame,
    id_column: str,
    text_column: str,
    held_out: Column,
    width: int = 5,
    threshold: float = 0.8,
    least_tokens: int = 20,
    within: Column | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Pairs (train, held_out, similarity) of distinct texts, and their members.

    `held_out` is true for evaluation rows and false for training rows; rows
    where it is null, like rows with a null id or text, take no part.  A pair
    holds the least ids of the rows with exactly these tokens on each side;
    members has (id, least, held_out) of every usable row, so copies are kept
    without expanding pairs.  The similarity is the Jaccard similarity of the
    sets of `width` consecutive tokens, 0 for a text of fewer than
    `least_tokens` tokens.  With `within`, a number, only rows that agree in it
    are compared.  Other columns are not read.
    """
    texts = df.select(
        F.col(id_column).cast("long").alias("id"),
        F.col(text_column).alias("text"),
        held_out.alias("held_out"),
        (F.lit(0) if within is None else within).cast("long").alias("within"),
    ).where("id is not null and text is not null and held_out is not null and within is not null")
    sketch = shingle_ranks(texts.where("held_out"), width, least_tokens)
    rows = checkpointed(_prefixes(texts, width, least_tokens, threshold, sketch))
    key = ["held_out", "sig", "sig2"]
    # copies have the same prefix; the least of them is indexed or probes for all
    repeated = rows.groupBy(*key).agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    copies = checkpointed(rows.select("id", *key).join(repeated, key).select("id", "least"))
    members = rows.select("id", "held_out").join(copies, "id", "left").select("id", F.coalesce("least", "id").alias("least"), "held_out")
    least = rows.join(copies.where("id > least"), "id", "left_anti").withColumnRenamed("id", "least")
    entries = least.select("held_out", "least", "n", F.explode(F.arrays_zip("shingles", "places")).alias("e")).select("held_out", "least", "n", F.col("e.shingles").alias("shingle"), F.col("e.places").alias("at"))
    index = entries.where("held_out").select("shingle", F.col("least").alias("b"), F.col("at").alias("at_b"), F.col("n").alias("n_b"))
    probe = entries.where("not held_out").select("shingle", F.col("least").alias("a"), F.col("at").alias("at_a"), F.col("n").alias("n_a"))
    # a shared prefix shingle leaves room for at most the rest of either set
    need = F.ceil(F.lit(threshold / (1 + threshold)) * (F.col("n_a") + F.col("n_b")) - F.lit(1e-9))
    room = F.least(F.col("n_a") - F.col("at_a"), F.col("n_b") - F.col("at_b"))
    # past the prefix of the set whose prefix ends first, only the rest of that set can be shared
    rest = F.greatest(*[F.ceil(F.lit(threshold) * F.col(n) - F.lit(1e-9)) - 1 for n in ("n_a", "n_b")])
    pairs = (
        probe.join(index, "shingle")
        .where(F.least("n_a", "n_b") >= F.lit(threshold) * F.greatest("n_a", "n_b") - F.lit(1e-9))
        .groupBy("a", "b", "n_a", "n_b")
        .agg(F.count(F.lit(1)).alias("shared"), F.max(room).alias("room"))
        .where((F.col("room") >= need) & (F.col("shared") + rest >= need))
        .select("a", "b")
    )
    links = verified(checkpointed(pairs), texts, width, least_tokens, threshold)
    return links.select(F.col("a").alias("train"), F.col("b").alias("held_out"), "similarity"), members
