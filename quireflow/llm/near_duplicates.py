"""Groups of near-duplicate texts by meet-in-the-middle ball hashing.

A text has several fingerprints of four symbols, each symbol being the least of
its shingles under one of many hash functions, so two texts agree in a symbol
with a probability equal to their similarity.  Two fingerprints within radius 2
(the number of symbols that differ) meet in the middle: each emits every variant
within half the radius, that is with one symbol masked.  Variants are shuffled,
and texts that collide twice become candidate pairs.  A pair that agrees in far
too few of all symbols is dropped; each other one is verified on its whole
shingle sets.

A crowded bucket pairs its members with a few of them only.  The members of
those crowded buckets that then still belong to more than one group go through
an exact prefix-filter join, so that no link is lost to a bucket's size.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quireflow.llm.pairs import Bloom, bounded, components, string_values, verified
from quireflow.llm.prefixes import prefix_join, shingle_ranks
from quireflow.llm.tokens import distinct_shingles, mix, signatures, token_hashes
from quireflow.session import checkpointed, released

_NEAR = 12  # a bucket of more than one beyond it is crowded
_SYMBOLS = 4  # of a fingerprint
_MEETINGS = 2  # variants that a candidate pair shares at least
_DEVIATIONS = 4.5  # below the expected agreement of symbols at which a pair is dropped
_KEY_BYTES = 6  # of a variant; keys that fall together only make candidates that fail later
_PART_ENTRIES = 1_000_000  # of variants that a task sorts at once
_LEAST_SLICE = 1_000_000  # pairs that are compared at once, also of fewer rows
_SHARE = 32  # one in so many rows tells how many shingles there are
_ROW_MEETINGS = 40  # meetings, or shingles of the exact join, that are shuffled at once for each row


def _multipliers(n: int) -> np.ndarray:
    return np.random.default_rng(11).integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def fingerprints(df: DataFrame, width: int, least_tokens: int, prints: int) -> DataFrame:
    """(id, sig, sig2, fp) of the rows of df(id, text, within) with enough tokens.

    sig and sig2 hash the whole token sequence and `within`; fp has the symbols
    of all fingerprints, two bytes each.  Symbols of different shingles agree
    by chance once in 65,536, which only makes candidates that fail later.
    """
    factors = _multipliers(prints * _SYMBOLS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, 1):
            texts = string_values(batch.column(1))
            one, two = signatures(*token_hashes(texts))
            flat, at, n_tokens = distinct_shingles(texts, width, least_tokens)
            within = mix(batch.column(2).to_numpy().view(np.uint64))
            keep = np.flatnonzero(np.diff(at) > 0)
            symbols = np.zeros((len(keep), len(factors)), dtype=np.uint16)
            edges = at[keep]
            for k, factor in enumerate(factors) if len(keep) else ():
                symbols[:, k] = mix(np.minimum.reduceat(flat * factor, edges)).astype(np.uint16)
            columns = [batch.column(0).take(pa.array(keep)), *(pa.array((x[keep] ^ within[keep]).view(np.int64)) for x in (one, two)), _fixed(symbols)]
            yield pa.RecordBatch.from_arrays([*columns, batch.column(2).take(pa.array(keep))], names=["id", "sig", "sig2", "fp", "within"])

    return df.select("id", "text", "within").mapInArrow(run, "id long, sig long, sig2 long, fp binary, within long")


def _fixed(rows: np.ndarray) -> pa.Array:
    """Rows of a matrix as binary values."""
    size = rows.shape[1] * rows.itemsize
    ends = np.arange(len(rows) + 1, dtype=np.int32) * size
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(np.ascontiguousarray(rows).tobytes())])


def _variants(fp: pa.Array, within: np.ndarray, most: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all variants of each row's fingerprints, or of the first `most` of these, and the row each belongs to."""
    n = len(fp)
    symbols = np.frombuffer(b"".join(fp.to_pylist()), dtype=np.uint16).reshape(n, -1, _SYMBOLS).astype(np.uint64) if n else np.zeros((0, 1, _SYMBOLS), dtype=np.uint64)
    out = []
    for p in range(symbols.shape[1] if most is None else most):
        for masked in range(_SYMBOLS):
            key = np.full(n, p * _SYMBOLS + masked, dtype=np.uint64)
            for k in range(_SYMBOLS):
                if k != masked:
                    key = mix(key ^ symbols[:, p, k]) * np.uint64(0x9E3779B97F4A7C15)
            out.append(mix(key ^ within) >> np.uint64(64 - 8 * _KEY_BYTES))
    return np.concatenate(out), np.tile(np.arange(n), len(out))


def _bucket_pairs(bucket: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs within buckets and how many buckets each comes from, rows being ordered by bucket and member: each
    with the bucket's first and with the _NEAR before it.  Linear in the rows."""
    n = len(bucket)
    if not n:
        return member, member, np.zeros(0, dtype=np.int64)
    first = np.ones(n, dtype=bool)
    first[1:] = bucket[1:] != bucket[:-1]
    head = np.flatnonzero(first)[np.cumsum(first) - 1]
    place = np.arange(n) - head
    far = place > _NEAR
    a, b = [member[head[far]]], [member[far]]
    for k in range(1, _NEAR + 1):
        later = np.flatnonzero(place >= k)
        a.append(member[later - k])
        b.append(member[later])
    left, right = np.concatenate(a), np.concatenate(b)
    order = np.lexsort((right, left))
    left, right = left[order], right[order]
    new = np.ones(len(left), dtype=bool)
    new[1:] = (left[1:] != left[:-1]) | (right[1:] != right[:-1])
    at = np.flatnonzero(new)
    return left[at], right[at], np.diff(np.append(at, len(left)))


def _pack(columns: list[np.ndarray], widths: tuple[int, ...]) -> bytes:
    """Columns of 64-bit numbers by planes of their lower bytes, compressed."""
    planes = [np.ascontiguousarray(np.ascontiguousarray(c).view(np.uint8).reshape(-1, 8)[:, :w].T).tobytes() for c, w in zip(columns, widths, strict=True)]
    return pa.compress(b"".join(planes), "zstd", asbytes=True)


def _unpack(data: bytes, n: int, widths: tuple[int, ...]) -> list[np.ndarray]:
    flat = np.frombuffer(pa.decompress(data, n * sum(widths), "zstd", asbytes=True), dtype=np.uint8)
    out, at = [], 0
    for width in widths:
        rows = np.zeros((n, 8), dtype=np.uint8)
        rows[:, :width] = flat[at : at + n * width].reshape(width, n).T
        out.append(rows.view(np.uint64).ravel())
        at += n * width
    return out


def _ranges(keys: np.ndarray, parts: int) -> list[tuple[int, int, int]]:
    """(part, start, end) of the ranges that ascending keys fall into; equal shares of all keys."""
    part = ((keys >> np.uint64(8 * _KEY_BYTES - 32)) * np.uint64(parts)) >> np.uint64(32)
    cuts = np.concatenate([[0], np.flatnonzero(part[1:] != part[:-1]) + 1, [len(part)]]).tolist() if len(part) else [0]
    return [(int(part[x]), x, y) for x, y in zip(cuts[:-1], cuts[1:], strict=True)]


def _steps(ascending: np.ndarray) -> np.ndarray:
    """Differences of ascending numbers, the first one whole; they take fewer bytes than the numbers."""
    return np.diff(ascending, prepend=np.zeros(1, dtype=np.uint64))


def _groups_of(keys: np.ndarray, members: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Keys and members in order, whether a row is the first of its bucket, and the size of its bucket."""
    order = np.lexsort((members, keys))
    keys, members = keys[order], members[order]
    first = np.ones(len(keys), dtype=bool)
    first[1:] = keys[1:] != keys[:-1]
    group = np.cumsum(first) - 1
    return keys, members, first, np.bincount(group)[group] if len(keys) else group


def _meetings(texts: DataFrame, parts: int, slices: int = 1, here_of: int = 0, most: int | None = None) -> DataFrame:
    """(a, b, n): pairs of ids, a < b, that share n variants in one part or block, and crowded buckets' keys as (key, null, null).

    Only pairs of one slice come out, and the keys with the first; with `most`
    only variants of so many fingerprints are made.  A task first combines its own buckets: of a crowded one only the least
    member goes on, paired with the others at once, and the key is marked.  So
    a variant that a third of all texts share reaches one reducer once a
    block, not once a text.  What goes on is packed by parts of the keys.
    """

    def sliced(a: np.ndarray, b: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if slices == 1:
            return a, b, times
        low, high = (f(a, b).astype(np.uint64) for f in (np.minimum, np.maximum))
        keep = mix(mix(low) ^ high) % np.uint64(slices) == here_of
        return a[keep], b[keep], times[keep]

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            keys, rows = _variants(batch.column(1), mix(batch.column(2).to_numpy().view(np.uint64)), most)
            keys, members, first, size = _groups_of(keys, ids[rows])
            many = size > _NEAR + 1
            a, b, times = sliced(*_bucket_pairs(keys[many], members[many]))
            on = first | ~many
            keys, members, marked = keys[on], members[on], many[on]
            # crowded keys are told once a block; they come with the pairs
            out = [(part, 0, y - x, _pack([_steps(keys[x:y]), members[x:y]], (_KEY_BYTES, 8))) for part, x, y in _ranges(keys, parts)]
            if len(a):
                out.append((int(a[0] % parts), 1, len(a), _pack([a, b, times], (8, 8, 4))))
            if marked.any() and here_of == 0:
                crowded = np.unique(keys[marked])
                out.append((int(crowded[0] % np.uint64(parts)), 2, len(crowded), _pack([_steps(crowded)], (_KEY_BYTES,))))
            columns = zip(*out, strict=True) if out else ((),) * 4
            yield pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(columns, (pa.int32(), pa.int32(), pa.int32(), pa.binary()), strict=True)], names=["part", "kind", "n", "data"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        here = None

        def done() -> Iterator[pa.RecordBatch]:
            if held:
                keys, members, first, size = _groups_of(*(np.concatenate(x) for x in zip(*held, strict=True)))
                more = size > 1
                yield _pairs(*sliced(*_bucket_pairs(keys[more], members[more].view(np.int64))))
                if here_of == 0:
                    yield _pairs(np.unique(keys[size > _NEAR + 1]).view(np.int64))

        for batch in batches:
            for part, kind, n, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if kind == 1:
                    yield _pairs(*(x.view(np.int64) for x in _unpack(data, n, (8, 8, 4))))
                elif kind == 2:
                    yield _pairs(np.cumsum(_unpack(data, n, (_KEY_BYTES,))[0]).view(np.int64))
                else:
                    if part != here:
                        yield from done()
                        here, held = part, []
                    steps, members = _unpack(data, n, (_KEY_BYTES, 8))
                    held.append([np.cumsum(steps), members])
        yield from done()

    rows = texts.select("id", "fp", "within").mapInArrow(local, "part int, kind int, n int, data binary")
    met = rows.repartition("part").sortWithinPartitions("part").mapInArrow(meet, "a long, b long, n long")
    lone = F.col("b").isNull()
    return met.select(F.when(lone, F.col("a")).otherwise(F.least("a", "b")).alias("a"), F.when(~lone, F.greatest("a", "b")).alias("b"), "n")


def candidate_pairs(texts: DataFrame, rows: int, prints: int, parts: int) -> DataFrame:
    """Distinct pairs (a, b), a < b, of ids whose fingerprints share variants; a crowded bucket's key comes as (key, null).

    Pairs that meet once by chance grow as the square of the rows.  How many
    there are is seen from one fingerprint; then as many slices of them are
    counted one after another as keep the disk in proportion to the rows.
    """
    seen = _meetings(texts, -(-parts // prints), most=1).where("b is not null").count()
    slices = max(1, -(-seen * prints // max(10 * _LEAST_SLICE, _ROW_MEETINGS * rows)))
    out = None
    for k in range(slices):
        counted = _meetings(texts, parts, slices, k).groupBy("a", "b").agg(F.sum("n").alias("n"))
        found = checkpointed(counted.where(F.col("b").isNull() | (F.col("n") >= _MEETINGS)).select("a", "b"))
        out = found if out is None else out.union(found)
        released(texts.sparkSession)
    return out


def _pairs(a: np.ndarray, b: np.ndarray | None = None, n: np.ndarray | None = None) -> pa.RecordBatch:
    other, times = (pa.nulls(len(a), pa.int64()),) * 2 if b is None else (pa.array(b, pa.int64()), pa.array(n, pa.int64()))
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), other, times], names=["a", "b", "n"])


def agreeing(pairs: DataFrame, prints: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) that agree in about as many symbols as the threshold lets expect.

    Of each symbol four bits are compared, which agree by chance once in 16;
    so a row takes a quarter of its fingerprints to every pair it is in.
    """
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id")))
    wanted = pairs.sparkSession.sparkContext.broadcast(Bloom.of(ids, "id"))
    expected = threshold + (1 - threshold) / 16

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(wanted.value.may_hold(batch.column(2).to_numpy(zero_copy_only=False))))
            low = np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype=np.uint16).reshape(batch.num_rows, -1).astype(np.uint8) & 15 if batch.num_rows else np.zeros((0, 2), dtype=np.uint8)
            yield pa.RecordBatch.from_arrays([batch.column(0), _fixed(low[:, ::2] | low[:, 1::2] << 4)], names=["id", "fp"])

    def agree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = (np.frombuffer(b"".join(batch.column(k).to_pylist()), dtype=np.uint8).reshape(batch.num_rows, -1) for k in (2, 3)) if batch.num_rows else (np.zeros((0, 1), dtype=np.uint8),) * 2
            n = 2 * left.shape[1]
            least = expected * n - _DEVIATIONS * np.sqrt(expected * (1 - expected) * n)
            other = left ^ right
            keep = pa.array((other & 15 == 0).sum(axis=1) + (other >> 4 == 0).sum(axis=1) >= least)
            yield pa.RecordBatch.from_arrays([batch.column(k).filter(keep) for k in (0, 1)], names=["a", "b"])

    held = prints.select("id", "fp", F.xxhash64("id").alias("h")).mapInArrow(asked, "id long, fp binary")
    joined = pairs.join(held.select(F.col("id").alias("a"), F.col("fp").alias("left")), "a").join(held.select(F.col("id").alias("b"), F.col("fp").alias("right")), "b")
    return joined.select("a", "b", "left", "right").mapInArrow(agree, "a long, b long")


def _short_sets(texts: DataFrame, ids: DataFrame, width: int, least_tokens: int) -> DataFrame:
    """(id, n, short) of the texts of `ids` and perhaps a few others: how many shingles, and two bytes of each without repetition."""
    wanted = texts.sparkSession.sparkContext.broadcast(Bloom.of(ids, "id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, 2):
            batch = batch.filter(pa.array(wanted.value.may_hold(batch.column(1).to_numpy(zero_copy_only=False))))
            flat, offsets, _ = distinct_shingles(string_values(batch.column(2)), width, least_tokens)
            sizes = np.diff(offsets)
            owner = np.repeat(np.arange(len(sizes), dtype=np.uint64), sizes)
            both = np.unique(owner << np.uint64(16) | flat >> np.uint64(48))
            ends = np.concatenate([[0], np.cumsum(np.bincount((both >> np.uint64(16)).astype(np.int64), minlength=len(sizes)))]).astype(np.int32)
            short = pa.ListArray.from_arrays(pa.array(ends), pa.array(both.astype(np.uint16).view(np.int16)))
            out = pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes.astype(np.int32)), short], names=["id", "n", "short"])
            yield out.filter(pa.array(sizes > 0))

    return texts.select("id", F.xxhash64("id").alias("h"), "text").mapInArrow(run, "id long, n int, short array<short>")


def _possible(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose short sets (id, n, short) don't rule out the threshold; none that reaches it is missing.

    What two sets share is at most what their short sets share and what the
    one that has lost fewer shingles to repetition has lost.
    """
    left, right = (sets.select(F.col("id").alias(x), F.col("n").alias(f"n_{x}"), F.col("short").alias(f"s_{x}")) for x in "ab")
    size = lambda x: F.size(F.col(x))
    shared = F.size(F.array_intersect("s_a", "s_b")) + F.least(F.col("n_a") - size("s_a"), F.col("n_b") - size("s_b"))
    joined = pairs.join(left, "a").join(right, "b").select("a", "b", "n_a", "n_b", shared.alias("shared"))
    return joined.where(F.col("shared") >= F.lit(threshold) * (F.col("n_a") + F.col("n_b") - F.col("shared")) - F.lit(1e-9)).select("a", "b")


def _in_slices(pairs: DataFrame, most: int, step: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """`step` of the pairs (a, b), of about `most` at once; what it shuffles is removed before the next slice."""
    slices = max(1, -(-pairs.count() // most))
    out = None
    for k in range(slices):
        done = checkpointed(step(pairs if slices == 1 else pairs.where(F.pmod(F.xxhash64("a", "b"), F.lit(slices)) == k)))
        out = done if out is None else out.union(done)
        released(pairs.sparkSession)
    return out


def similar(pairs: DataFrame, texts: DataFrame, rows: int, width: int, least_tokens: int, threshold: float) -> DataFrame:
    """Links (a, b) among the pairs whose exact similarity reaches the threshold, enough to connect whatever they connect.

    `pairs` should be checkpointed.  Slices follow the number of `rows`, so
    that the disk follows the rows and not the pairs.
    """
    if pairs.isEmpty():
        return pairs
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id")))
    sets = checkpointed(_short_sets(texts, ids, width, least_tokens))
    most = max(_LEAST_SLICE, rows)
    possible = _in_slices(pairs, most, lambda some: _possible(some, sets, threshold))
    del sets
    released(texts.sparkSession)
    exact = lambda some: verified(some, texts, width, least_tokens, threshold).select("a", "b")
    if possible.count() <= most // 2:
        return checkpointed(exact(possible))
    # one link of each row first: pairs that those connect needn't be compared
    first = checkpointed(possible.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"))
    links = _in_slices(first, most // 2, exact)
    roots = checkpointed(components(links))
    for x in "ab":
        possible = possible.join(roots.select(F.col("id").alias(x), F.col("root").alias(f"root_{x}")), x, "left")
    apart = possible.where(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).select("a", "b")
    return links.union(_in_slices(checkpointed(apart.join(first, ["a", "b"], "left_anti")), most // 2, exact))


def _without(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows whose id isn't among `ids`; only those that a filter takes for one of them are shuffled, so the others keep their order."""
    maybe = rows.sparkSession.sparkContext.broadcast(Bloom.of(ids, "id"))
    names = rows.columns

    def side(there: bool) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                held = maybe.value.may_hold(batch.column(0).to_numpy(zero_copy_only=False))
                yield batch.filter(pa.array(held == there)).select(names)

        return rows.select(F.xxhash64("id").alias("h"), "*").mapInArrow(run, rows.schema)

    return side(False).union(side(True).join(ids, "id", "left_anti"))


def _mixed_members(texts: DataFrame, crowded: DataFrame, roots: DataFrame, parts: int) -> DataFrame:
    """The ids (id) in crowded buckets (key) whose members belong to more than one group.

    A task tells the groups of its buckets' members first and the members after
    them, so that a bucket of very many is never held at once.
    """
    context = texts.sparkSession.sparkContext
    wanted = context.broadcast(Bloom.of_hashes(crowded, "key"))

    def asked(fp: pa.Array, within: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        keys, rows = _variants(fp, mix(within.to_numpy(zero_copy_only=False).view(np.uint64)))
        keep = wanted.value.may_hold(keys.view(np.int64))
        return keys[keep], rows[keep]

    def inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.take(pa.array(np.unique(asked(batch.column(1), batch.column(2))[1])))

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, rows = asked(batch.column(1), batch.column(2))
            keys, rows, first, _ = _groups_of(keys, rows)
            ids, roots = (batch.column(c).to_numpy().view(np.uint64)[rows] for c in (0, 3))
            starts = np.flatnonzero(first)
            counts = np.diff(np.append(starts, len(keys)))
            low, high = (f.reduceat(roots, starts) if len(starts) else roots for f in (np.minimum, np.maximum))
            block, keys, at = uuid.uuid4().bytes, keys[starts], np.append(starts, len(ids))
            out = []
            for part, x, y in _ranges(keys, parts):
                columns = [_steps(keys[x:y]), counts[x:y].astype(np.uint64), low[x:y], high[x:y] - low[x:y]]
                out.append((part, 0, block, y - x, _pack(columns, (_KEY_BYTES, 4, 8, 8))))
                out.append((part, 1, block, int(at[y] - at[x]), _pack([ids[at[x] : at[y]]], (8,))))
            columns = zip(*out, strict=True) if out else ((),) * 5
            kinds = (pa.int32(), pa.int32(), pa.binary(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(columns, kinds, strict=True)], names=["part", "kind", "block", "n", "data"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a part's keys come first; its members, which may be many of one key, pass by
        blocks: dict[bytes, list[np.ndarray]] = {}
        mixed: np.ndarray | None = None
        here = None
        for batch in batches:
            for part, kind, block, n, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if part != here:
                    here, blocks, mixed = part, {}, None
                if kind == 0:
                    steps, counts, low, wide = _unpack(data, n, (_KEY_BYTES, 4, 8, 8))
                    blocks[block] = [np.cumsum(steps), counts.astype(np.int64), low, low + wide]
                    continue
                if mixed is None:
                    keys, counts, low, high = (np.concatenate(x) for x in zip(*blocks.values(), strict=True))
                    order = np.argsort(keys, kind="stable")
                    keys = keys[order]
                    starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
                    several = np.minimum.reduceat(low[order], starts) < np.maximum.reduceat(high[order], starts)
                    mixed = keys[starts][several & (np.add.reduceat(counts[order], starts) > _NEAR + 1)]
                keys, counts = blocks[block][:2]
                ids = _unpack(data, n, (8,))[0][np.repeat(np.isin(keys, mixed), counts)]
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(ids).view(np.int64))], names=["id"])

    few = texts.select("id", "fp", "within").mapInArrow(inside, "id long, fp binary, within long")
    rooted = few.join(roots, "id", "left").select("id", "fp", "within", F.coalesce("root", "id").alias("root"))
    rows = rooted.mapInArrow(local, "part int, kind int, block binary, n int, data binary")
    return rows.repartition("part").sortWithinPartitions("part", "kind").mapInArrow(meet, "id long").distinct()


def _prefixes(texts: DataFrame, ids: DataFrame, width: int, least_tokens: int, threshold: float) -> Callable[[DataFrame, int, int], DataFrame]:
    """Makes (id, n, shingles, places) of the texts whose prefix has a shingle that another text may hold, of ids and of a slice of the shingles.

    Shingles are ordered by how many texts hold them, rarest first; two texts
    that reach the threshold share one of their first n - ceil(threshold * n) + 1.
    Only rows of `ids` are sure to come out and are sure to be counted; a few others may be.
    """
    context = texts.sparkSession.sparkContext
    wanted = context.broadcast(Bloom.of(ids, "id"))
    rows = texts.select("id", F.xxhash64("id").alias("h"), "text", "within")

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(wanted.value.may_hold(batch.column(1).to_numpy(zero_copy_only=False)))).select(["text"])

    some = texts.select("text", F.xxhash64("id").alias("h")).mapInArrow(asked, "text string")
    counts = context.broadcast(shingle_ranks(some, width, least_tokens))

    def run(slices: int, k: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, 2):
            batch = batch.filter(pa.array(wanted.value.may_hold(batch.column(1).to_numpy(zero_copy_only=False))))
            flat, offsets, _ = distinct_shingles(string_values(batch.column(2)), width, least_tokens)
            within = mix(batch.column(3).to_numpy(zero_copy_only=False).view(np.uint64))
            sizes = np.diff(offsets)
            owner = np.repeat(np.arange(len(sizes)), sizes)
            rank = counts.value[(flat % np.uint64(len(counts.value))).astype(np.int64)]
            order = np.lexsort((flat, rank, owner))
            flat, rank = flat[order], rank[order]
            place = np.arange(len(flat)) - np.repeat(offsets[:-1], sizes)
            prefix = sizes - np.ceil(threshold * sizes - 1e-9).astype(np.int64) + 1
            keep = np.flatnonzero((rank > 1) & (place < prefix[owner]) & ((flat >> np.uint64(32)) % np.uint64(slices) == k))
            held = np.bincount(owner[keep], minlength=len(sizes))
            ends = np.concatenate([[0], np.cumsum(held)]).astype(np.int32)
            shingles = pa.ListArray.from_arrays(pa.array(ends), pa.array((flat[keep] ^ within[owner[keep]]).view(np.int64)))
            places = pa.ListArray.from_arrays(pa.array(ends), pa.array(place[keep].astype(np.int32)))
            columns = [batch.column(0), pa.array(sizes.astype(np.int32)), shingles, places]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "n", "shingles", "places"]).filter(pa.array(held > 0))

    def of(some: DataFrame, slices: int, k: int) -> DataFrame:
        return some.mapInArrow(lambda batches: run(slices, k, batches), "id long, n int, shingles array<long>, places array<int>")

    return lambda share, slices, k: of(rows.where(F.pmod("h", F.lit(share)) == 0), slices, k)


def unproven_pairs(texts: DataFrame, ids: DataFrame, roots: DataFrame, width: int, least_tokens: int, threshold: float, most: int = 10 * _LEAST_SLICE) -> DataFrame:
    """Pairs (a, b) of `ids` in different groups that may reach the threshold; none that does is missing.

    `roots` (id, root) are the groups so far; an id without one is its own.
    Shingles are joined in slices of about `most`, as counted in a part of the rows.
    """
    prefixes = _prefixes(texts, ids, width, least_tokens, threshold)
    seen = prefixes(_SHARE, 1, 0).agg(F.sum(F.size("shingles"))).first()[0] or 0
    slices = max(1, -(-seen * _SHARE // most))
    out = None
    for k in range(slices):
        rows = prefixes(1, slices, k).join(ids, "id", "left_semi").join(roots, "id", "left")
        entries = rows.select("id", F.coalesce("root", "id").alias("root"), F.col("n").cast("long").alias("n"), F.explode(F.arrays_zip("shingles", "places")).alias("e"))
        found = prefix_join(entries.select(F.col("e.shingles").alias("key"), "root", "id", "n", F.col("e.places").cast("long").alias("at")), threshold)
        if slices > 1:
            found = checkpointed(found)
            released(texts.sparkSession)
        out = found if out is None else out.union(found)
    return out if slices == 1 else out.distinct()


def near_duplicates(
    df: DataFrame,
    id_column: str,
    text_column: str,
    width: int = 5,
    threshold: float = 0.8,
    least_tokens: int = 20,
    prints: int = 36,
    within: Column | None = None,
) -> DataFrame:
    """(id, group) of every row that has a near-duplicate; group is the least id.

    Two texts are near-duplicates if the Jaccard similarity of their sets of
    `width` consecutive tokens reaches the threshold; groups are the connected
    components.  A null text or one of fewer than `least_tokens` tokens is in
    no group, also if it is repeated.  Rows with a null id are left out.
    Exact copies share a group and take part in the search once.  Only the
    two named columns are read.  With `within`, a number, only rows that agree
    in it are compared, so that one pass serves several tables.

    Two fingerprints of texts of similarity s meet with probability
    4 s^3 (1 - s) + s^4.  With 36 of them a pair of exactly 0.5 collides less than
    twice in 24 of a million cases, one of 0.6 never in practice, and then is
    missed unless other texts link it.
    """
    texts = df.select(
        F.col(id_column).cast("long").alias("id"),
        F.col(text_column).alias("text"),
        (F.lit(0) if within is None else within).cast("long").alias("within"),
    ).where("id is not null and text is not null and within is not null")
    prints_of = checkpointed(fingerprints(texts, width, least_tokens, prints))
    groups = prints_of.groupBy("sig", "sig2").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies"))
    # copies hang under the least of them, which alone takes part
    repeated = checkpointed(groups.where("copies > 1").select("sig", "sig2", F.col("id").alias("least")))
    copies = checkpointed(prints_of.select("id", "sig", "sig2").join(repeated, ["sig", "sig2"]).select("id", "least"))
    distinct = _without(prints_of.select("id", "fp", "within"), copies.where("id > least").select("id"))
    spark = texts.sparkSession
    released(spark)
    rows = prints_of.count()
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows * prints * _SYMBOLS // _PART_ENTRIES))
    found = candidate_pairs(distinct, rows, prints, parts)
    likely = _in_slices(found.where("b is not null"), max(_LEAST_SLICE, 2 * rows), lambda some: agreeing(some, distinct, threshold))
    roots = components(similar(likely, texts, rows, width, least_tokens, threshold))
    del likely
    crowded = found.where("b is null").select(F.col("a").alias("key"))
    if not crowded.isEmpty():
        roots = checkpointed(roots)
        ids = checkpointed(_mixed_members(distinct, crowded, roots, parts))
        del found, crowded, distinct, prints_of, groups
        released(spark)
        if not ids.isEmpty():
            rest = checkpointed(unproven_pairs(texts, ids, roots, width, least_tokens, threshold, max(10 * _LEAST_SLICE, _ROW_MEETINGS * rows)))
            released(spark)
            more = similar(rest, texts, rows, width, least_tokens, threshold)
            # a group so far is one link from each member to its root
            roots = components(roots.select(F.col("id").alias("a"), F.col("root").alias("b")).union(more))
    of_copies = copies.join(roots.withColumnRenamed("id", "least"), "least", "left").select("id", F.coalesce("root", "least").alias("group"))
    return of_copies.union(roots.select("id", F.col("root").alias("group"))).distinct()
