"""Vectorised tokens and shingles.

A token is a maximal run of Unicode letters, marks and numbers of the
lower-cased text.  A whole Arrow batch is hashed at once: the texts become one
array of code points, a token's hash is the sum of its characters each mixed
with its place, and shingles are mixed from neighbouring token hashes.  Nothing
loops over tokens or characters in Python.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator, Sequence
from functools import cache

import numpy as np

_BASE = 0x9E3779B97F4A7C15 | 1
_PLACE, _SPREAD = np.uint64(0xD1342543DE82EF95), np.uint64(0xBF58476D1CE4E5B9)
_BLOCK = 1 << 20


@cache
def word_table() -> np.ndarray:
    """True for each code point that is a letter, a mark or a number."""
    kinds = [unicodedata.category(chr(c))[0] in "LMN" for c in range(sys.maxunicode + 1)]
    return np.array(kinds, dtype=bool)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that every bit of the result depends on all bits."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def token_spans(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the tokens of one array of code points."""
    inside = np.zeros(len(points) + 2, dtype=np.int8)
    inside[1:-1] = word_table()[points]
    step = np.diff(inside)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def range_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each range of an array of numbers; no range is empty.

    A sum of values mixed with their place.  A polynomial modulo 2**64 would be
    cheaper, but it gives some texts of two letters the same hash whatever its base.
    """
    sizes = ends - starts
    at = np.cumsum(sizes) - sizes
    if not len(sizes):
        return np.zeros(0, dtype=np.uint64)
    take = np.arange(int(sizes.sum())) + np.repeat(starts - at, sizes)
    place = take - np.repeat(starts, sizes)
    h = values[take].astype(np.uint64) * np.uint64(_BASE)
    h += place.astype(np.uint64) * _PLACE
    h ^= h >> np.uint64(32)
    h *= _SPREAD
    h ^= h >> np.uint64(29)
    return mix(np.add.reduceat(h, at) + sizes.astype(np.uint64))


def _block_hashes(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of each token; the array must not cut a token."""
    starts, ends = token_spans(points)
    return starts, range_hashes(points, starts, ends)


def token_hashes(texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens in order, and the offsets of each text's tokens.

    A null text has no tokens.  Offsets have one entry more than there are texts.
    """
    hashes: list[np.ndarray] = []
    offsets = np.zeros(len(texts) + 1, dtype=np.int64)
    done = 0
    for block in _blocks(texts):
        starts, found = _block_hashes(code_points("\n".join(part for _, part in block) + "\n"))
        hashes.append(found)
        ends = np.searchsorted(starts, np.cumsum([len(part) + 1 for _, part in block]), side="left")
        for (k, _), end in zip(block, (done + ends).tolist(), strict=True):
            offsets[k + 1] = end
        done += len(found)
    return (np.concatenate(hashes) if hashes else np.zeros(0, dtype=np.uint64)), np.maximum.accumulate(offsets)


def _blocks(texts: Sequence[str | None]) -> Iterator[list[tuple[int, str]]]:
    """Lower-cased texts with their places in blocks of a bounded size; a longer text is cut at spaces."""
    block: list[tuple[int, str]] = []
    total = 0
    for k, text in enumerate(texts):
        low = (text or "").lower()
        at = 0
        while at == 0 or at < len(low):
            stop = len(low)
            if stop - at > _BLOCK:
                space = low.rfind(" ", at + 1, at + _BLOCK)
                stop = space if space > at else stop  # without a space it stays whole
            block.append((k, low[at:stop]))
            total += stop - at + 1
            at = max(stop, 1)
            if total >= _BLOCK:
                yield block
                block, total = [], 0
    if block:
        yield block


def shingle_hashes(hashes: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of `width` tokens, and the offsets of each text's runs."""
    counts = np.maximum(np.diff(offsets) - (width - 1), 0)
    out = np.zeros(len(counts) + 1, dtype=np.int64)
    np.cumsum(counts, out=out[1:])
    if len(hashes) < width:
        return np.zeros(0, dtype=np.uint64), np.zeros_like(out)
    whole = np.zeros(len(hashes) - width + 1, dtype=np.uint64)
    for k in range(width):
        whole = whole * np.uint64(_BASE) + hashes[k : k + len(whole)]
    take = np.arange(out[-1]) + np.repeat(offsets[:-1] - out[:-1], counts)
    return mix(whole[take]), out


def distinct_shingles(texts: Sequence[str | None], width: int, least_tokens: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text, ascending within it.

    Returns the shingles, their offsets by text and each text's number of
    tokens.  A text of fewer than `least_tokens` tokens has none.
    """
    hashes, offsets = token_hashes(texts)
    n_tokens = np.diff(offsets)
    flat, at = shingle_hashes(hashes, offsets, width)
    owner = np.repeat(np.arange(len(n_tokens)), np.diff(at))
    keep = n_tokens[owner] >= least_tokens
    flat, owner = flat[keep], owner[keep]
    order = np.lexsort((flat, owner))
    flat, owner = flat[order], owner[order]
    if len(flat):
        new = np.ones(len(flat), dtype=bool)
        new[1:] = (flat[1:] != flat[:-1]) | (owner[1:] != owner[:-1])
        flat, owner = flat[new], owner[new]
    out = np.zeros(len(n_tokens) + 1, dtype=np.int64)
    np.cumsum(np.bincount(owner, minlength=len(n_tokens)), out=out[1:])
    return flat, out, n_tokens


def signatures(hashes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of each text's whole token sequence."""
    counts = np.diff(offsets)
    within = (np.arange(len(hashes)) - np.repeat(offsets[:-1], counts)).astype(np.uint64)
    out = []
    for salt in (0x1234567F, 0x7F4A7C15):
        sums = np.zeros(len(hashes) + 1, dtype=np.uint64)
        np.cumsum(mix(hashes ^ mix(within * _PLACE + np.uint64(salt))), out=sums[1:])
        out.append(mix(sums[offsets[1:]] - sums[offsets[:-1]] + counts.astype(np.uint64) * np.uint64(salt)))
    return out[0], out[1]
