"""Vector arithmetic as Column expressions and as Arrow functions for hot paths."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quireflow.functions import text as T


def usable(vector: Column, size: int) -> Column:
    """Whether a vector has the length, no null or NaN, and is not zero."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x))
    return vector.isNotNull() & (F.size(vector) == size) & ~bad & F.exists(vector, lambda x: x != 0)


def doubles(vector: Column) -> Column:
    return vector.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(vector: Column) -> Column:
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x * x))


def l2_normalize(vector: Column) -> Column:
    """The vector with length one; lengths under 1e-12 count as that."""
    return T.let(F.greatest(norm(vector), F.lit(1e-12)), lambda n: F.transform(vector, lambda x: x / n))


def masked_mean(tokens: Column, mask: Column) -> Column:
    """Mean of the token vectors whose mask is 1: their sum over the mask's, 1e-9 at least."""
    first = F.transform(F.get(tokens, F.lit(0)), lambda x: F.lit(0.0))
    pairs = F.arrays_zip(tokens.alias("v"), mask.alias("m"))
    total = F.aggregate(pairs, first, lambda acc, p: F.zip_with(acc, p["v"], lambda a, x: a + x * p["m"]))
    weight = F.greatest(F.aggregate(mask, F.lit(0.0), lambda s, m: s + m), F.lit(1e-9))
    return F.transform(total, lambda x: x / weight)


def masked_means(df: DataFrame, key: str, vector: str, mask: Column) -> DataFrame:
    """(key, pos, x): by position the mean of each key's vectors whose mask is 1, by partial sums; 0 where none is."""
    rows = df.select(key, mask.cast("double").alias("__m"), F.posexplode(doubles(F.col(vector))).alias("pos", "__x"))
    sums = rows.groupBy(key, "pos").agg(F.sum(F.when(F.col("__m") != 0, F.col("__x") * F.col("__m")).otherwise(0.0)).alias("__s"), F.sum("__m").alias("__w"))
    return sums.select(key, "pos", (F.col("__s") / F.greatest("__w", F.lit(1e-9))).alias("x"))


def _rows(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)


def unit_vectors(size: int) -> Callable[..., Column]:
    """An Arrow function: l2_normalize of vectors of this size, none of which is null."""

    @F.arrow_udf("array<double>")
    def unit(column: pa.Array) -> pa.Array:
        rows = _rows(column, size)
        rows = rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * size), pa.array(rows.ravel()))

    return unit


def dot_products(size: int) -> Callable[..., Column]:
    """An Arrow function: dot of two columns of vectors of this size, none of which is null."""

    @F.arrow_udf("double")
    def product(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array(np.einsum("ij,ij->i", _rows(a, size), _rows(b, size)))

    return product


Encoder = Callable[[list[str]], np.ndarray]


def encoding(make: Callable[[], Encoder], batch: int = 32) -> Callable[..., Column]:
    """An Arrow function that encodes texts with a model made once a worker.

    `make` returns a function from a list of texts to a matrix of rows; rows
    are normalised.  Null texts count as empty.
    """

    @F.arrow_udf("array<float>")
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = make()
        for column in batches:
            texts = [t or "" for t in column.to_pylist()]
            parts = [np.asarray(model(texts[a : a + batch]), dtype=np.float32) for a in range(0, len(texts), batch)]
            rows = np.concatenate(parts) if parts else np.zeros((0, 1), dtype=np.float32)
            rows = rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)
            yield pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]), pa.array(rows.ravel()))

    return encode


def hashing_encoder(size: int = 64) -> Encoder:
    """The same stand-in as hashing_vector for `encoding`, linear in the number of words; words are split at spaces."""

    def encode(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), size), dtype=np.float64)
        known: dict[str, tuple[int, float]] = {}
        for row, text in enumerate(texts):
            for word in text.lower().split():
                if word not in known:
                    code = int(hashlib.md5(word.encode()).hexdigest()[:8], 16)
                    known[word] = (code % size, -1.0 if code // 65536 % 2 else 1.0)
                place, sign = known[word]
                out[row, place] += sign
        return out

    return encode


def hashing_vector(text: Column, size: int = 64) -> Column:
    """A deterministic stand-in for a model: signed counts of hashed words, of unit length.

    The hash of each distinct lower-case word names a place and a sign.  It
    needs no model and says little about meaning.
    """
    words = F.filter(F.split(F.lower(T.normalize_space(text)), " "), lambda w: w != "")

    def spread(codes: Column) -> Column:
        places = F.sequence(F.lit(0), F.lit(size - 1))
        value = lambda i: F.aggregate(F.filter(codes, lambda c: F.pmod(c, F.lit(size)) == i), F.lit(0.0), lambda s, c: s + F.when(F.pmod(F.floor(c / 65536), F.lit(2)) == 0, 1.0).otherwise(-1.0))
        return F.transform(places, value)

    codes = F.transform(words, lambda w: F.conv(F.substring(F.md5(w), 1, 8), 16, 10).cast("long"))
    return l2_normalize(T.let(codes, spread))
