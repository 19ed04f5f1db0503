"""Byte-level BPE encoding of a whole corpus.

Two tiers.  A minimal perfect hash over the vocabulary resolves every
pre-token that is itself an entry; the rest are merged one by one with a heap
of candidate pairs over a linked list of bytes, once for each distinct
pre-token of a worker.  Pre-tokens are found, hashed and looked up for a whole
block of texts at once.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quireflow.llm.tokens import mix, range_hashes

DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
_BLOCK_BYTES = 1 << 20
_MOST_KNOWN = 1_000_000  # pieces a worker remembers; forgotten ones are merged again
_LETTER, _NUMBER, _OTHER, _SPACE = 0, 1, 2, 3
# Fixed values of the public pre-tokenisation rule: contractions that form a piece.
_ONE_LETTER = "stmd"
_TWO_LETTERS = ("re", "ve", "ll")
# Code points with the Unicode property White_Space.
_WHITE_SPACE = [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


@cache
def _class_table() -> np.ndarray:
    import sys
    import unicodedata

    table = np.full(sys.maxunicode + 1, _OTHER, dtype=np.uint8)
    kinds = np.array([ord(unicodedata.category(chr(c))[0]) for c in range(sys.maxunicode + 1)], dtype=np.uint8)
    table[kinds == ord("L")] = _LETTER
    table[kinds == ord("N")] = _NUMBER
    table[_WHITE_SPACE] = _SPACE
    return table


def _words(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place of a buffer as one number; the buffer is padded behind."""
    padded = np.concatenate([data, np.zeros(8, dtype=np.uint8)])
    return np.ndarray(shape=(len(data) + 1,), dtype="<u8", buffer=padded, strides=(1,))


def _same_bytes(words: np.ndarray, starts: np.ndarray, sizes: np.ndarray, others: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the ranges of two buffers, given as _words, that begin at `starts` and `at` hold the same bytes."""
    same = np.ones(len(starts), dtype=bool)
    open_rows = np.arange(len(starts))
    done = 0
    while len(open_rows):
        left = np.minimum(sizes[open_rows] - done, 8)
        mask = np.where(left == 8, np.uint64(0xFFFFFFFFFFFFFFFF), (np.uint64(1) << (left.astype(np.uint64) * np.uint64(8))) - np.uint64(1))
        differ = ((words[starts[open_rows] + done] ^ others[at[open_rows] + done]) & mask) != 0
        same[open_rows[differ]] = False
        done += 8
        open_rows = open_rows[~differ & (sizes[open_rows] > done)]
    return same


def _second(hashes: np.ndarray) -> np.ndarray:
    return mix(hashes ^ np.uint64(0xD6E8FEB86659FD93))


@dataclass(frozen=True)
class PerfectHash:
    """A minimal perfect hash: n keys in n slots, found with one displacement a bucket."""

    pilots: np.ndarray
    keys: np.ndarray
    values: np.ndarray

    @staticmethod
    def build(hashes: np.ndarray, values: np.ndarray) -> PerfectHash:
        n = len(hashes)
        buckets = max(1, n // 3)
        pilots = np.zeros(buckets, dtype=np.int64)
        bucket = (hashes % np.uint64(buckets)).astype(np.int64)
        second = _second(hashes)
        order = np.argsort(bucket, kind="stable")
        sizes = np.bincount(bucket, minlength=buckets)
        first = np.cumsum(sizes) - sizes
        taken = np.zeros(n, dtype=bool)
        slots = np.zeros(n, dtype=np.int64)
        free: Iterator[int] | None = None
        tries = np.arange(64, dtype=np.uint64)
        for b in np.argsort(-sizes, kind="stable").tolist():
            size = sizes[b]
            if size == 0:
                break
            mine = order[first[b] : first[b] + size]
            if size == 1:  # any free slot: a negative pilot names it
                free = free or iter(np.flatnonzero(~taken).tolist())
                slot = next(free)
                pilots[b] = -slot - 1
                slots[mine[0]] = slot
                continue
            low = 0
            while True:
                spots = _spread(hashes[mine][None, :], second[mine][None, :], (tries + np.uint64(low))[:, None], n)
                clear = ~taken[spots].any(axis=1)
                for k in np.flatnonzero(clear).tolist():
                    if len(np.unique(spots[k])) == size:
                        break
                else:
                    low += len(tries)
                    continue
                taken[spots[k]] = True
                slots[mine] = spots[k]
                pilots[b] = low + k
                break
        keys, held = np.zeros(n, dtype=np.uint64), np.zeros(n, dtype=np.int32)
        keys[slots], held[slots] = hashes, values
        return PerfectHash(pilots, keys, held)

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The value of each hash, and whether it is a key."""
        pilot = self.pilots[(hashes % np.uint64(len(self.pilots))).astype(np.int64)]
        spread = _spread(hashes, _second(hashes), np.maximum(pilot, 0).astype(np.uint64), len(self.keys))
        slot = np.where(pilot < 0, -pilot - 1, spread)
        return self.values[slot], self.keys[slot] == hashes


def _spread(first: np.ndarray, second: np.ndarray, pilot: np.ndarray, n: int) -> np.ndarray:
    return (mix(first + pilot * (second | np.uint64(1))) % np.uint64(n)).astype(np.int64)


@dataclass(frozen=True)
class Vocabulary:
    """The entries of a byte-level BPE vocabulary, their perfect hash, and their bytes in one buffer.

    The hash gives an entry's place; that its bytes are the pre-token's is checked.
    """

    ranks: dict[bytes, int]
    table: PerfectHash
    data: np.ndarray
    ends: np.ndarray
    ids: np.ndarray

    @staticmethod
    def load(path: str) -> Vocabulary:
        """Read a file with one base64 entry and its rank a line."""
        with open(path, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in file if line.strip())}
        entries = list(ranks)
        lengths = np.array([len(e) for e in entries])
        ends = np.cumsum(lengths)
        data = np.frombuffer(b"".join(entries), dtype=np.uint8)
        hashes = range_hashes(data, ends - lengths, ends)
        if len(np.unique(hashes)) != len(hashes):
            raise ValueError("two entries of the vocabulary have the same hash")
        table = PerfectHash.build(hashes, np.arange(len(entries), dtype=np.int32))
        return Vocabulary(ranks, table, data, np.concatenate([[0], ends]), np.array(list(ranks.values()), dtype=np.int32))

    def find(self, words: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The id of each byte range, and whether it is an entry."""
        place, hit = self.table.find(range_hashes(data, starts, ends))
        sizes = ends - starts
        hit &= sizes == self.ends[place + 1] - self.ends[place]
        rows = np.flatnonzero(hit)
        hit[rows] = _same_bytes(words, starts[rows], sizes[rows], _words(self.data), self.ends[place[rows]])
        return self.ids[place], hit


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one piece: the pair with the least rank is merged first, the leftmost of equals.

    Pairs wait in a heap; bytes are a linked list in which a merged part keeps
    the place of its left half.  An entry whose parts have changed is skipped.
    """
    n = len(piece)
    end = list(range(1, n + 1))  # end of the part that starts here, 0 once it is merged away
    before = list(range(-1, n - 1))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = end[i]
        if not j or j >= n or end[j] != stop:
            continue
        end[i], end[j] = stop, 0
        if stop < n:
            before[stop] = i
            if (r := ranks.get(piece[i : end[stop]])) is not None:
                heapq.heappush(heap, (r, i, end[stop]))
        if (k := before[i]) >= 0 and (r := ranks.get(piece[k:stop])) is not None:
            heapq.heappush(heap, (r, k, stop))
    ids, i = [], 0
    while i < n:
        ids.append(ranks[piece[i : end[i]]])
        i = end[i]
    return ids


def piece_starts(points: np.ndarray, text_starts: np.ndarray) -> np.ndarray:
    """Where pre-tokens start in joined texts.

    Runs of letters, numbers, other characters and white space are pieces.  A
    single space joins the run after it, a longer white space run leaves its
    last character over, and a contraction takes letters of the next run.
    """
    n = len(points)
    if not n:
        return np.zeros(0, dtype=np.int64)
    kind = _class_table()[points]
    fresh = np.zeros(n + 1, dtype=bool)  # a text starts, or all end
    fresh[text_starts[text_starts < n]] = True
    fresh[0] = fresh[n] = True
    start = fresh[:n].copy()
    start[1:] |= kind[1:] != kind[:-1]
    # the last white space before something else of the same text
    last = np.flatnonzero((kind[:-1] == _SPACE) & (kind[1:] != _SPACE) & ~fresh[1:n])
    start[last] = True
    start[last[points[last] == 0x20] + 1] = False
    # contractions: an apostrophe that is a piece of its own
    quote = np.flatnonzero((points[:-1] == 0x27) & start[:-1] & (kind[1:] == _LETTER) & ~fresh[1:n])
    for p in quote.tolist():
        after = points[p + 1]
        size = 0
        if chr(after) in _ONE_LETTER:
            size = 1
        elif p + 2 < n and not fresh[p + 2] and chr(after) + chr(points[p + 2]) in _TWO_LETTERS:
            size = 2
        if size:
            start[p + 1] = False
            if p + 1 + size < n:
                start[p + 1 + size] = True
    return np.flatnonzero(start)


class Encoder:
    """Encodes blocks of UTF-8 texts; keeps the ids of pieces it had to merge."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.vocabulary = vocabulary
        self.known: dict[bytes, int] = {}
        self.pieces: list[np.ndarray] = []

    def _missing(self, data: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row of each piece in the flat ids of this call, and the places of those ids."""
        rows: dict[int, int] = {}
        inverse = np.empty(len(starts), dtype=np.int64)
        for k, (a, b) in enumerate(zip(starts.tolist(), ends.tolist(), strict=True)):
            piece = data[a:b]
            at = self.known.get(piece)
            if at is None:
                at = self.known[piece] = len(self.pieces)
                self.pieces.append(np.array(merge(piece, self.vocabulary.ranks), dtype=np.int32))
            inverse[k] = rows.setdefault(at, len(rows))
        return inverse, np.fromiter(rows, dtype=np.int64, count=len(rows))

    def block(self, data: np.ndarray, text_bytes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of joined texts and the number of ids of each; text_bytes has each text's length."""
        if len(self.known) > _MOST_KNOWN:
            self.known.clear()
            self.pieces.clear()
        raw = data.tobytes()
        points = np.frombuffer(raw.decode("utf-8").encode("utf-32-le"), dtype=np.uint32)
        if not len(points):
            return np.zeros(0, dtype=np.int32), np.zeros(len(text_bytes), dtype=np.int64)
        at = np.zeros(len(points) + 1, dtype=np.int64)
        np.cumsum(1 + (points > 0x7F).astype(np.int8) + (points > 0x7FF) + (points > 0xFFFF), out=at[1:])
        byte_ends = np.cumsum(text_bytes)
        text_starts = np.searchsorted(at, byte_ends - text_bytes)
        first = piece_starts(points, text_starts)
        starts = at[first]
        ends = np.append(starts[1:], len(data))
        ids, hit = self.vocabulary.find(_words(data), data, starts, ends)
        counts = np.ones(len(starts), dtype=np.int64)
        miss = np.flatnonzero(~hit)
        if len(miss):
            inverse, rows = self._missing(raw, starts[miss], ends[miss])
            sizes = np.array([len(self.pieces[r]) for r in rows.tolist()])
            counts[miss] = sizes[inverse]
        out_at = np.zeros(len(starts) + 1, dtype=np.int64)
        np.cumsum(counts, out=out_at[1:])
        out = np.empty(out_at[-1], dtype=np.int32)
        out[out_at[:-1][hit]] = ids[hit]
        if len(miss):
            flat = np.concatenate([self.pieces[r] for r in rows.tolist()])
            base = np.cumsum(sizes) - sizes
            size = counts[miss]
            within = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            out[np.repeat(out_at[miss], size) + within] = flat[np.repeat(base[inverse], size) + within]
        edges = out_at[np.searchsorted(starts, np.append(byte_ends - text_bytes, len(data)), side="left")]
        return out, np.diff(edges)

    @staticmethod
    def _cuts(data: np.ndarray, low: int, high: int) -> list[int]:
        """Places to cut a long text so that no piece is cut: before a space between two ASCII letters."""
        cuts = []
        at = low + _BLOCK_BYTES
        while at < high - 1:
            part = data[at - 1 : min(high, at + _BLOCK_BYTES)]
            letter = ((part | 0x20) >= ord("a")) & ((part | 0x20) <= ord("z"))
            hit = np.flatnonzero(letter[:-2] & (part[1:-1] == 0x20) & letter[2:])
            if len(hit):
                at += int(hit[0])
                cuts.append(at)
            at += _BLOCK_BYTES
        return cuts

    def encode(self, texts: pa.Array) -> pa.ListArray:
        """Ids of each text; an empty list for a null or an empty one."""
        texts = texts.cast(pa.large_string()).fill_null("")
        offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)
        flat, counts = [np.zeros(0, dtype=np.int32)], np.zeros(len(texts), dtype=np.int64)
        at = 0
        while at < len(texts):
            stop = max(at + 1, int(np.searchsorted(offsets, offsets[at] + _BLOCK_BYTES, side="right")) - 1)
            cuts = self._cuts(data, int(offsets[at]), int(offsets[stop])) if stop == at + 1 else []
            for low, high in zip([offsets[at], *cuts], [*cuts, offsets[stop]], strict=True):
                ids, sizes = self.block(data[low:high], np.diff(offsets[at : stop + 1]) if not cuts else np.array([high - low]))
                flat.append(ids)
                counts[at:stop] += sizes
            at = stop
        ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(flat)))


def encode(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """(id, ids) of every row: the text's byte-level BPE ids without special tokens.

    A null or empty text has an empty list; strings of special tokens are
    ordinary text.  Repeated rows and ids are kept.  Other columns are not read.
    The vocabulary, a fixed file, is read on the driver and broadcast.
    """
    shared = df.sparkSession.sparkContext.broadcast(Vocabulary.load(vocabulary))
    source = df.select(F.col(id_column), F.col(text_column).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), encoder.encode(batch.column(1))], names=[id_column, "ids"])

    kind = source.schema[0].dataType.simpleString()
    return source.mapInArrow(run, f"`{id_column}` {kind}, ids array<int>")
