"""Exact top-k retrieval, maximal marginal relevance and negatives.

Chunks are frames (paper_id, chunk_gid, vec) of unit vectors, queries are rows
with their own unit vector.  Equal scores are ordered by chunk_gid.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quireflow.config import RetrievalConfig
from quireflow.functions.vectors import dot_products


MOST_DRAWN = 10_000  # chunks that are broadcast for a random draw: what is drawn and the longest list of exclusions


def check_k(k: int) -> None:
    if k <= 0:
        raise ValueError("k must be positive")


def check_lambda(weight: float) -> None:
    if not 0 <= weight <= 1:
        raise ValueError("lambda must lie between 0 and 1")


def effective_k(count: Column, config: RetrievalConfig = RetrievalConfig()) -> Column:
    """How many chunks are kept of a paper with so many: room for noise is left in short ones."""
    return F.least(F.lit(config.final_k), F.greatest(F.lit(1), count - config.noise_k))


def candidate_k(count: Column, k: Column) -> Column:
    """How many candidates are re-ranked: five for each one kept, 50 at least, no more than there are."""
    return F.least(F.greatest(k * 5, F.lit(50)), count)


def scored(chunks: DataFrame, query: str, size: int) -> DataFrame:
    """Chunks with the score of the unit vector in column `query` against `vec`."""
    return chunks.withColumn("score", dot_products(size)(F.col("vec"), F.col(query)))


def ranked(scores: DataFrame, key: str | list[str], most: int) -> DataFrame:
    """The best `most` rows of each key with their rank from 1."""
    check_k(most)
    keys = [key] if isinstance(key, str) else key
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "chunk_gid")
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def mmr_positions(weight: float, size: int) -> Callable[..., Column]:
    """An Arrow function (scores, vectors, k) -> the places picked, in order.

    Each pick has the greatest weight * score - (1 - weight) * its greatest
    similarity to what is picked, the first of equals.  The first pick has no
    such term, and a negative similarity adds to the others.
    """
    check_lambda(weight)

    @F.arrow_udf("array<int>")
    def pick(scores: pa.Array, vectors: pa.Array, wanted: pa.Array) -> pa.Array:
        out = []
        for score, rows, k in zip(scores.to_pylist(), vectors, wanted.to_pylist(), strict=True):
            relevance = np.array(score, dtype=np.float64)
            matrix = rows.values.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)
            near = np.full(len(relevance), -np.inf)
            picked: list[int] = []
            while len(picked) < min(k, len(relevance)):
                value = weight * relevance - (1 - weight) * (near if picked else 0.0)
                value[picked] = -np.inf
                best = int(np.argmax(value))
                picked.append(best)
                near = np.maximum(near, matrix @ matrix[best])
            out.append(picked)
        return pa.array(out, pa.list_(pa.int32()))

    return pick


def mmr_rows(candidates: DataFrame, key: str | list[str], size: int, weight: float, k: str | int, keep: list[str] | None = None) -> DataFrame:
    """Picks among ranked candidates (key, chunk_gid, vec, score, rank, k): rows (key, chunk_gid, score, rank).

    rank counts picks from 1 and score is the relevance.  A key has a bounded
    number of candidates, so collecting them is safe.
    """
    keys = [key] if isinstance(key, str) else key
    wanted = F.lit(k).cast("int") if isinstance(k, int) else F.first(k).cast("int")
    lists = candidates.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("rank", "chunk_gid", "score", "vec"))).alias("c"), wanted.alias("k"))
    picks = lists.withColumn("at", mmr_positions(weight, size)(F.col("c.score"), F.col("c.vec"), F.col("k")))
    rows = picks.select(*keys, "c", F.posexplode_outer("at").alias("pos", "i")).withColumn("p", F.get("c", F.col("i")))
    return rows.select(*keys, "p.chunk_gid", "p.score", (F.col("pos") + 1).alias("rank"))


def clean_retrieval(chunks: DataFrame, query: str, config: RetrievalConfig = RetrievalConfig()) -> DataFrame:
    """(paper_id, chunk_gid, score, rank) of the chunks retrieved for each paper's own query.

    Vectors are scored where they lie.  Papers are counted by partial sums, and
    the rank's limit, which no rule of candidates exceeds, drops rows before
    the shuffle, so that a paper of very many chunks is no large task.
    """
    scores = scored(chunks, query, config.dimensions).select("paper_id", "chunk_gid", "vec", "score")
    counts = chunks.groupBy("paper_id").agg(F.count(F.lit(1)).alias("n")).withColumn("k", effective_k(F.col("n"), config))
    best = ranked(scores, "paper_id", max(50, 5 * config.final_k)).join(counts, "paper_id")
    return mmr_rows(best.where(F.col("rank") <= candidate_k(F.col("n"), F.col("k"))), "paper_id", config.dimensions, config.mmr_lambda, "k")


_QUERY_BLOCK = 1024  # queries that are compared with a block of chunks at once
_SLACK = 1e-9  # of products whose order of addition differs; the final score is added up in one order


def best_chunks(queries: DataFrame, chunks: DataFrame, most: int, size: int) -> DataFrame:
    """(query_id, chunk_gid, score, rank): the best `most` chunks of each query (query_id, qvec), of any number of queries.

    Blocks of queries meet blocks of chunks as matrices; of each meeting only
    a query's best rows go on, so what is shuffled follows queries times
    blocks, not queries times chunks.  Equal scores are ordered by chunk_gid.
    """
    check_k(most)
    kind = queries.schema["query_id"].dataType.simpleString()
    blocks = -(-max(1, queries.count()) // _QUERY_BLOCK)
    asked = queries.groupBy(F.pmod(F.xxhash64("query_id"), F.lit(blocks)).alias("block")).agg(F.collect_list("query_id").alias("query_ids"), F.flatten(F.collect_list("qvec")).alias("qvecs"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                one = np.array([0, batch.num_rows], dtype=np.int32)
                flat = batch.column(1).flatten()
                yield pa.RecordBatch.from_arrays(
                    [pa.ListArray.from_arrays(pa.array(one), batch.column(0)), pa.ListArray.from_arrays(pa.array(np.array([0, len(flat)], dtype=np.int32)), flat)], names=["gids", "vecs"]
                )

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                ids, gids = batch.column(0)[k].values, batch.column(2)[k].values
                asks, held = (batch.column(c)[k].values.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size) for c in (1, 3))
                near = asks @ held.T
                bar = np.partition(near, len(gids) - most, axis=1)[:, len(gids) - most] if most < len(gids) else np.full(len(asks), -np.inf)
                q, c = np.nonzero(near >= bar[:, None] - _SLACK)
                score = np.einsum("ij,ij->i", asks[q], held[c])
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(q)), gids.take(pa.array(c)), pa.array(score)], names=["query_id", "chunk_gid", "score"])

    packed = chunks.select("chunk_gid", "vec").mapInArrow(pack, "gids array<string>, vecs array<double>")
    met = asked.select("query_ids", "qvecs").crossJoin(packed).mapInArrow(meet, f"query_id {kind}, chunk_gid string, score double")
    return ranked(met, "query_id", most)


def search(queries: DataFrame, chunks: DataFrame, k: int, size: int, weight: float = 0.5, candidates: int | None = None) -> DataFrame:
    """(query_id, chunk_gid, score, rank): picks for each query (query_id, qvec) over all chunks."""
    check_k(k)
    check_lambda(weight)
    best = best_chunks(queries, chunks, max(5 * k, 50) if candidates is None else candidates, size)
    return mmr_rows(best.join(chunks.select("chunk_gid", "vec"), "chunk_gid"), "query_id", size, weight, k)


class Retriever:
    """Search over the chunks it was built with; an error before that, or for no chunks."""

    def __init__(self, size: int, weight: float = 0.5) -> None:
        check_lambda(weight)
        self.size, self.weight = size, weight
        self.chunks: DataFrame | None = None

    def build(self, chunks: DataFrame) -> Retriever:
        if chunks.isEmpty():
            raise ValueError("no documents to index")
        self.chunks = chunks
        return self

    def ready(self) -> DataFrame:
        if self.chunks is None:
            raise RuntimeError("build the index before searching")
        return self.chunks

    def search(self, queries: DataFrame, k: int, candidates: int | None = None) -> DataFrame:
        return search(queries, self.ready(), k, self.size, self.weight, candidates)

    def contexts(self, queries: DataFrame, final_k: int = 3, noise_k: int = 2, shuffle: bool = False, seed: int = 42, candidates: int | None = None, hard: bool = False) -> DataFrame:
        """(query_id, pos, chunk_gid, is_noise): picks and negatives of each query in one call.

        Hard negatives come from the ranks after final_k, random ones from all
        chunks; with `shuffle` both are put into one keyed order.
        """
        if noise_k < 0:
            raise ValueError("noise_k must not be negative")
        found = self.search(queries, final_k, candidates)
        taken = found.select("query_id", "chunk_gid")
        if hard and noise_k:
            best = best_chunks(queries, self.ready(), max(candidates or 50, 50), self.size)
            negatives = hard_negatives(best, taken, noise_k, seed, skip=final_k)
        else:
            negatives = random_negatives(queries, self.ready(), taken, noise_k, seed)
        rows = training_contexts(found, negatives)
        if not shuffle:
            return rows
        order = Window.partitionBy("query_id").orderBy(draw_key(seed, "order", F.col("query_id").cast("string"), F.col("chunk_gid")), "pos")
        return rows.withColumn("pos", F.row_number().over(order))


def pairwise(candidates: DataFrame, key: str, size: int) -> DataFrame:
    """(key, rank_a, rank_b, similarity) of each key's ranked candidates, which are few."""
    a = candidates.select(key, F.col("rank").alias("rank_a"), F.col("vec").alias("vec_a"))
    b = candidates.select(key, F.col("rank").alias("rank_b"), F.col("vec").alias("vec_b"))
    return a.join(b, key).select(key, "rank_a", "rank_b", dot_products(size)(F.col("vec_a"), F.col("vec_b")).alias("similarity"))


def draw_key(seed: int, *parts: Column | str) -> Column:
    """What a keyed draw is ordered by: the hash of the seed and the parts."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.lit(p) if isinstance(p, str) else p for p in parts]))


def random_negatives(queries: DataFrame, chunks: DataFrame, exclude: DataFrame, n: int, seed: int) -> DataFrame:
    """(query_id, chunk_gid, pos): n chunks for each query that aren't excluded (query_id, chunk_gid).

    The order of the draw is one order of the chunks by a keyed hash; each
    query takes the first n from it that it doesn't exclude, so that only as
    many are joined as it can need.
    """
    if n <= 0:
        return exclude.limit(0).select("query_id", "chunk_gid", F.lit(1).alias("pos"))
    most = exclude.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
    if n + most > MOST_DRAWN:
        raise ValueError(f"a query excludes more than {MOST_DRAWN - n} chunks")
    first = chunks.select("chunk_gid", draw_key(seed, F.col("chunk_gid")).alias("draw")).orderBy("draw", "chunk_gid").limit(n + most)
    pairs = queries.select("query_id").crossJoin(F.broadcast(first)).join(exclude, ["query_id", "chunk_gid"], "left_anti")
    order = Window.partitionBy("query_id").orderBy("draw", "chunk_gid")
    return pairs.withColumn("pos", F.row_number().over(order)).where(F.col("pos") <= n).select("query_id", "chunk_gid", "pos")


def hard_negatives(best: DataFrame, exclude: DataFrame, n: int, seed: int, skip: int = 5) -> DataFrame:
    """(query_id, chunk_gid, pos): n of each query's candidates (query_id, chunk_gid, rank) after the first `skip`.

    Excluded candidates count in the rank but aren't drawn.
    """
    left = best.where(F.col("rank") > skip).join(exclude, ["query_id", "chunk_gid"], "left_anti")
    order = Window.partitionBy("query_id").orderBy(draw_key(seed, F.col("query_id").cast("string"), F.col("chunk_gid")), "chunk_gid")
    return left.withColumn("pos", F.row_number().over(order)).where(F.col("pos") <= n).select("query_id", "chunk_gid", "pos")


def training_contexts(picks: DataFrame, negatives: DataFrame) -> DataFrame:
    """(query_id, pos, chunk_gid, is_noise): picks first, then the negatives."""
    clean = picks.select("query_id", F.col("rank").alias("pos"), "chunk_gid", F.lit(False).alias("is_noise"))
    counts = clean.groupBy("query_id").agg(F.max("pos").alias("m"))
    noise = negatives.join(counts, "query_id").select("query_id", (F.col("pos") + F.col("m")).alias("pos"), "chunk_gid", F.lit(True).alias("is_noise"))
    return clean.unionByName(noise)
