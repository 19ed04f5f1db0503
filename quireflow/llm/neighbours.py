"""The most similar vectors of every vector by an adaptive dimension scan.

Vectors are made unit length, rotated by one random orthogonal matrix and kept
in lists around centroids.  Within a probed list a block of columns at a time
is compared; after each block a hypothesis test on the partial distances drops
the candidates that can't come near the best known, so few pairs are computed
in full.  Each vector first scans its own list, which gives it the distance to
beat, and takes that to the other lists it probes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quireflow.session import checkpointed

MOST_SAMPLED = 400_000  # vectors the centroids are fitted on, chosen by a hash of their id
MOST_LISTS = 65_536  # about the square root of the number of vectors; a bound on what is broadcast
_LEAST = 256  # vectors a list has on average at least, as smaller ones save no work
_SAMPLE = 16  # sampled vectors a list
_ROUNDS = 6  # of k-means
_ROWS = 512  # vectors that are compared with all centroids at once
_BLOCK = 16_384  # a larger list is split, and its blocks are probed apart
_FIRST = 64  # candidates that are compared in full to begin with
_EPSILON = 2.4  # of the hypothesis test: how many deviations a partial distance may be off


def rotation(size: int) -> np.ndarray:
    """A fixed random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(7).standard_normal((size, size)))
    return q * np.sign(np.diag(r))


def usable(df: DataFrame, id_column: str, vector_column: str, size: int) -> DataFrame:
    """(id, vec) of the vectors that take part, as the bytes of 32-bit numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            flat = lists.flatten()
            values = flat.to_numpy(zero_copy_only=False).astype(np.float32).reshape(-1, size)
            values = values + np.float32(0)  # one zero
            keep = np.isfinite(values).all(axis=1) & values.any(axis=1) & np.isfinite(np.linalg.norm(values.astype(np.float64), axis=1))
            ids = batch.column(0).filter(pa.array(keep))
            yield pa.RecordBatch.from_arrays([ids, _packed(values[keep])], names=["id", "vec"])

    # a null number becomes NaN, which takes no part
    clean = F.transform(F.col(vector_column), lambda x: F.coalesce(x.cast("float"), F.lit(float("nan")).cast("float")))
    rows = df.select(F.col(id_column).cast("long").alias("id"), clean.alias("v")).where("id is not null").where(F.size(F.col(vector_column)) == size)
    return rows.mapInArrow(run, "id long, vec binary")


def _packed(values: np.ndarray) -> pa.Array:
    n, size = values.shape
    ends = np.arange(n + 1, dtype=np.int32) * (4 * size)
    data = np.ascontiguousarray(values, dtype=np.float32).tobytes()
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(data)])


def _unpacked(column: pa.Array, size: int) -> np.ndarray:
    """Unit vectors in double precision."""
    data = b"".join(column.to_pylist())
    values = np.frombuffer(data, dtype=np.float32).reshape(-1, size).astype(np.float64)
    return values / np.linalg.norm(values, axis=1, keepdims=True) if len(values) else values


def _nearest(units: np.ndarray, centre: np.ndarray, take: int) -> np.ndarray:
    """The `take` nearest centroids of each vector, the nearest first."""
    take = min(take, len(centre))
    out = np.zeros((len(units), take), dtype=np.int32)
    for a in range(0, len(units), _ROWS):
        near = units[a : a + _ROWS] @ centre.T
        some = np.argpartition(-near, take - 1, axis=1)[:, :take]
        out[a : a + _ROWS] = np.take_along_axis(some, np.argsort(-np.take_along_axis(near, some, axis=1), axis=1, kind="stable"), axis=1)
    return out


def _means(sample: np.ndarray, count: int) -> np.ndarray:
    """`count` centroids of a sample by a few rounds of spherical k-means."""
    if not len(sample):
        return np.ones((1, sample.shape[1]), dtype=np.float32)
    centre = sample[:count].copy()
    for _ in range(_ROUNDS):
        owner = _nearest(sample, centre, 1)[:, 0]
        sums = np.zeros_like(centre)
        np.add.at(sums, owner, sample)
        held = np.bincount(owner, minlength=len(centre)) > 0
        centre[held] = sums[held] / np.maximum(np.linalg.norm(sums[held], axis=1, keepdims=True), 1e-12)
    return centre


def _fitted(vectors: DataFrame, count: int, size: int, lists: int | None) -> np.ndarray:
    """Centroids fitted on a bounded sample."""
    wanted = int(np.clip(min(count**0.5, count / _LEAST) if lists is None else lists, 1, MOST_LISTS))
    rows = vectors.select("vec", F.xxhash64("id").alias("h"), "id").orderBy("h", "id").limit(min(MOST_SAMPLED, _SAMPLE * wanted)).select("vec").toArrow()
    return _means(_unpacked(rows["vec"].combine_chunks(), size).astype(np.float32).reshape(-1, size), wanted)


class _Scan:
    """Compares blocks of unit vectors by columns of their rotation."""

    def __init__(self, size: int, k: int) -> None:
        self.size, self.k = size, k
        self.turn = rotation(size)
        width = max(1, size // 4)
        self.edges = [*range(0, size, width)][:4] + [size]

    def turned(self, units: np.ndarray) -> np.ndarray:
        return (units @ self.turn).astype(np.float32)

    def beyond(self, query: np.ndarray, held: np.ndarray, turned_query: np.ndarray, turned: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, candidate, cosine) of the pairs whose squared distance may be within each query's limit."""
        low, high = self.edges[0], self.edges[1]
        a, b = turned_query[:, low:high], turned[:, low:high]
        part = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T)
        q, c = np.nonzero(part <= self._bar(limit, high)[:, None])
        part = part[q, c]
        for low, high in zip(self.edges[1:-1], self.edges[2:], strict=True):
            diff = turned_query[q, low:high] - turned[c, low:high]
            part = part + np.einsum("ij,ij->i", diff, diff)
            keep = part <= self._bar(limit, high)[q]
            q, c, part = q[keep], c[keep], part[keep]
        return q, c, np.einsum("ij,ij->i", query[q], held[c])

    def _bar(self, limit: np.ndarray, seen: int) -> np.ndarray:
        """The largest partial distance over `seen` of the columns that passes the test."""
        if seen == self.size:
            return limit + 1e-5
        return limit * (seen / self.size) * (1 + _EPSILON / np.sqrt(seen)) ** 2 + 1e-6

    def own(self, units: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Best pairs (query, candidate, cosine) within one block, and each query's squared distance to beat."""
        n = len(units)
        turned = self.turned(units)
        queries, found, cosines, limits = [], [], [], np.full(n, np.inf)
        for a in range(0, n, 512):
            part = slice(a, min(n, a + 512))
            rows = np.arange(part.start, part.stop)
            head = units[part] @ units[:_FIRST].T
            inside = rows < _FIRST
            head[np.flatnonzero(inside), rows[inside]] = -2.0
            limit = np.full(len(rows), np.inf)
            if head.shape[1] > self.k:
                kth = -np.partition(-head, self.k - 1, axis=1)[:, self.k - 1]
                limit = np.where(kth > -2, np.maximum(0.0, 2 - 2 * kth), np.inf)
            q, c, s = self.beyond(units[part], units, turned[part], turned, limit)
            q = q + part.start
            other = q != c
            q, c, s = _best(q[other], c[other], s[other], self.k)
            queries.append(q)
            found.append(c)
            cosines.append(s)
            full = np.bincount(q - part.start, minlength=len(rows)) >= self.k
            least = np.full(len(rows), np.inf)
            np.minimum.at(least, q - part.start, s)
            limits[part] = np.where(full, np.maximum(0.0, 2 - 2 * least), np.inf)
        return np.concatenate(queries), np.concatenate(found), np.concatenate(cosines), limits


def _best(q: np.ndarray, c: np.ndarray, s: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best candidates of each query; the candidates' order breaks ties."""
    order = np.lexsort((c, -s, q))
    q, c, s = q[order], c[order], s[order]
    rank = np.arange(len(q)) - np.searchsorted(q, q)
    keep = rank < k
    return q[keep], c[keep], s[keep]


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """Pieces of the batches with equal values in the first `keys` columns, rows being sorted by them."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        marks = np.stack([batch.column(i).to_numpy() for i in range(keys)])
        cut = np.concatenate([[0], np.flatnonzero((marks[:, 1:] != marks[:, :-1]).any(axis=0)) + 1, [n]])
        for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            yield tuple(marks[:, a].tolist()), batch.slice(a, b - a)


_PAIRS = "id long, other long, cosine double"


def _neighbours(vectors: DataFrame, size: int, k: int, probes: int, lists: int | None) -> DataFrame:
    """(id, other, cosine) of the k best of each of the distinct vectors (id, vec)."""
    spark = vectors.sparkSession
    shared = spark.sparkContext.broadcast(_fitted(vectors, vectors.count(), size, lists))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            some = _nearest(_unpacked(batch.column(1), size).astype(np.float32).reshape(-1, size), shared.value, probes)
            probed = pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1, dtype=np.int32) * some.shape[1]), pa.array(some.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(some[:, 0]), probed], names=["id", "vec", "list", "probes"])

    placed = checkpointed(vectors.mapInArrow(assign, "id long, vec binary, list int, probes array<int>"))
    sizes = {r["list"]: -(-r["n"] // _BLOCK) for r in placed.groupBy("list").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most MOST_LISTS rows
    split = F.create_map(*[F.lit(x) for pair in sizes.items() if pair[1] > 1 for x in pair]) if any(n > 1 for n in sizes.values()) else None
    blocks = lambda column: F.coalesce(F.try_element_at(split, column), F.lit(1)) if split is not None else F.lit(1)
    held = placed.withColumn("block", F.pmod(F.xxhash64("id"), blocks(F.col("list"))).cast("int"))

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = _Scan(size, k)

        def done(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
            rows = pa.Table.from_batches(parts).combine_chunks()
            order = np.argsort(rows["id"].to_numpy(), kind="stable")
            rows = rows.take(pa.array(order)).combine_chunks().to_batches()[0]
            q, c, s, limit = scan.own(_unpacked(rows.column("vec"), size))
            ids = rows.column("id").to_numpy()
            ends = np.searchsorted(q, np.arange(len(ids) + 1)).astype(np.int32)
            best = [pa.ListArray.from_arrays(pa.array(ends), x) for x in (pa.array(ids[c]), pa.array(s))]
            columns = [rows.column(x) for x in ("id", "vec", "list", "block", "probes")]
            return pa.RecordBatch.from_arrays([*columns, pa.array(limit), *best], names=["id", "vec", "list", "block", "probes", "far", "others", "cosines"])

        key, parts = None, []
        for here, piece in _groups(batches, 2):
            if here != key and parts:
                yield done(parts)
                parts = []
            key = here
            parts.append(piece)
        if parts:
            yield done(parts)

    ordered = held.select("list", "block", "id", "vec", "probes").repartition("list", "block").sortWithinPartitions("list", "block")
    first = checkpointed(ordered.mapInArrow(own, "id long, vec binary, list int, block int, probes array<int>, far double, others array<long>, cosines array<double>"))

    kept = first.select("list", "block", F.lit(0).alias("role"), "id", "vec", F.lit(0.0).alias("far"))
    asked = first.select("id", "vec", "far", F.col("list").alias("own"), F.col("block").alias("home"), F.explode("probes").alias("list"))
    asked = asked.withColumn("block", F.explode(F.sequence(F.lit(0), blocks(F.col("list")) - 1))).where("list != own or block != home")
    asked = asked.select("list", F.col("block").cast("int").alias("block"), F.lit(1).alias("role"), "id", "vec", "far")

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = _Scan(size, k)
        key, ids, units, turned = None, np.zeros(0, dtype=np.int64), np.zeros((0, size)), np.zeros((0, size), dtype=np.float32)
        for (at, block, role), piece in _groups(batches, 3):
            if (at, block) != key:
                key, ids, units, turned = (at, block), ids[:0], units[:0], turned[:0]
            mine, here = piece.column(3).to_numpy(), _unpacked(piece.column(4), size)
            if role == 0:
                ids, units = np.concatenate([ids, mine]), np.concatenate([units, here])
                turned = scan.turned(units)
                continue
            if not len(ids):
                continue
            far = piece.column(5).to_numpy()
            for a in range(0, len(mine), 512):
                part = slice(a, a + 512)
                q, c, s = scan.beyond(here[part], units, scan.turned(here[part]), turned, far[part])
                order = np.argsort(ids[c], kind="stable")
                q, c, s = _best(q[order], ids[c[order]], s[order], k)
                yield pa.RecordBatch.from_arrays([pa.array(mine[part][q]), pa.array(c), pa.array(s)], names=["id", "other", "cosine"])

    rows = kept.union(asked).repartition("list", "block").sortWithinPartitions("list", "block", "role")
    more = rows.mapInArrow(probe, _PAIRS)
    zipped = first.select("id", F.explode(F.arrays_zip("others", "cosines")).alias("p")).select("id", F.col("p.others").alias("other"), F.col("p.cosines").alias("cosine"))
    return _top(zipped.union(more), k)


def _top(pairs: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("id").orderBy(F.desc("cosine"), "other")
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("id", "other", "cosine", "rank")


def nearest(df: DataFrame, id_column: str, vector_column: str, size: int, k: int = 10, probes: int = 4, lists: int | None = None) -> DataFrame:
    """(id, other, cosine, rank): the k most similar other vectors of every usable one.

    Similarity is the cosine in double precision; of equals the smaller id
    comes first.  A vector that is null, has another length than `size`, a null,
    NaN or infinite number or only zeros takes no part.  Fewer than k come out
    where there are no more.  Centroids are fitted on a bounded sample, every
    vector is indexed and asked; what lies in lists that aren't probed can be
    missed.  `lists` is about the square root of the number of vectors, or fewer so
    that a list has enough of them, unless given.  Equal vectors are searched once: at most k + 1 of the least ids of
    a group of copies can be anyone's neighbours, and each copy gets its own
    rows.  Ids must be unique; other columns are not read.
    """
    vectors = checkpointed(usable(df, id_column, vector_column, size))
    distinct = checkpointed(vectors.groupBy("vec").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies")).select("id", "vec", "copies"))
    found = _neighbours(distinct.select("id", "vec"), size, k, probes, lists).select("id", "other", "cosine")
    many = distinct.where("copies > 1").select("vec", F.col("id").alias("least"))
    copies = vectors.join(many, "vec").select("least", "id")
    # the least copies of each group, which stand beside it wherever it is found
    order = Window.partitionBy("least").orderBy("id")
    near = copies.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k + 1).select(F.col("least").alias("other"), F.col("id").alias("copy"))
    spread = found.join(near, "other", "left").select("id", F.coalesce("copy", "other").alias("other"), "cosine")
    itself = near.select(F.col("other").alias("id"), F.col("copy").alias("other"), F.lit(1.0).alias("cosine"))
    best = _top(spread.union(itself), k + 1).select(F.col("id").alias("least"), "other", "cosine")
    # every copy gets the rows of the least one
    own = best.join(copies, "least", "left").select(F.coalesce("id", "least").alias("id"), "other", "cosine").where("id != other")
    return _top(own, k)
