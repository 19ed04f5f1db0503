"""Pages of repeated keywords, links, tags and offers instead of sentences.

A trigram model of function words and word classes is trained on prose.  Links,
link texts, tags, prices and words that repeat what stood shortly before are
classes of their own, which prose hardly has.  The model scores every stretch of
a page; a stretch without enough function words whose perplexity lies outside
the band of prose of its kind of script is abnormal, and a page is spam if more
than half of its words lie in abnormal stretches.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quireflow.llm.pairs import bounded, string_values
from quireflow.llm.tokens import code_points, mix, range_hashes

# Common function words of several languages, each a class of its own.
FUNCTION_WORDS = (
    "the of and a an in on at to for with by from as is are was were be it its that this which or not we our no than but so if can every "
    "der die das den dem des und ist ein eine von für mit auf im bei nicht wird werden zu als "
    "le la les de du et est un une dans en à par pour que qui sur ne pas "
    "el los las del y es con por para se su al sin "
    "и в не на что с по для от из к о как же это при "
    "και το η ο του της τη τα για με από δεν που "
    "في من على أن هل إلى عن و "
    "को का के की में है और से ने क्या"
).split()
_TRIGRAMS = 200_000  # most frequent class trigrams that are kept; a bound on what is broadcast
_FEW = 10  # a stretch with more function words than one in so many is a sentence's
_STRETCH = 16  # tokens scored together
_RECENT = 256  # tokens within which a pair of words counts as repeated
_CLASSES = 512
_MOST_BITS = 5.0  # a token counts no more, so that a few odd characters don't make a sentence abnormal
_BINS, _BIN_WIDTH = 1024, 0.025  # of bits a token
_LOWEST, _HIGHEST = 0.001, 0.98  # shares of prose that bound its band
_PRIVATE = {0xE100 + k: "�" for k in range(8)}
_OWN = regex.compile("[\ue100-\ue107]")
_LINK, _TAG, _MARKUP, _PRICE, _ANCHOR = (chr(0xE100 + k) for k in range(5))
# classes: function words, then shapes, then masks, then other characters
_SHAPE = 200  # more than there are function words
_LOWER, _TITLE, _UPPER, _DIGITS, _MIXED, _WIDE, _CASELESS, _LINE, _REPEATED = range(_SHAPE, _SHAPE + 9)
_MASK = _SHAPE + 16
_OTHER = _SHAPE + 24
_SCRIPTS = 3  # with case, without, and wide

_ANCHORED = regex.compile(r"<a\s[^<>]*+>((?:(?!<a\s).)*?)</a>", regex.S | regex.I)
_BRACKETED = regex.compile(r"!?\[([^\[\]\n]*+)\]\([^()\s]++\)")
_URL = regex.compile(r"(?:https?://|www\.)\S++")
_HTML = regex.compile(r"<[^<>]++>")
_HASH = regex.compile(r"(?<!\w)#\w{2,}+")
# Currencies of offers.
_AMOUNT = regex.compile(r"\b\d++(?:[.,]\d{2})?\s?(?:EUR|USD|GBP|CHF|€|\$|£)|[€$£]\s?\d++(?:[.,]\d++)*+|\b\d++\.\d{2}\b(?=\s*+(?:$|[/|;·•]))")


def _mask(text: str | None) -> str:
    """The text with links, link texts, tags and prices as one private character each; link texts keep their number of words."""
    text = text or ""
    if _OWN.search(text):
        text = text.translate(_PRIVATE)

    def anchor(match: regex.Match) -> str:
        return " " + f"{_ANCHOR} " * max(1, len(_HTML.sub(" ", match[1]).split()))

    if "<" in text:
        text = _ANCHORED.sub(anchor, text)
    if "](" in text:
        text = _BRACKETED.sub(anchor, text)
    if "://" in text or "www." in text:
        text = _URL.sub(_LINK, text)
    if "<" in text:
        text = _HTML.sub(_MARKUP, text)
    if "#" in text:
        text = _HASH.sub(_TAG, text)
    return _AMOUNT.sub(_PRICE, text)


@cache
def _kind_table() -> np.ndarray:
    """1 upper case, 2 lower case, 3 letters and marks without case, 4 numbers, 5 wide letters, 8 spaces, 32 line ends, 16 others."""
    kinds = {"Lu": 1, "Lt": 1, "Ll": 2, "Lo": 3, "Lm": 3, "Mn": 3, "Mc": 3, "Me": 3, "Nd": 4, "Nl": 4, "No": 4, "Zs": 8}
    out = np.array([kinds.get(unicodedata.category(chr(c)), 16) for c in range(sys.maxunicode + 1)], dtype=np.uint8)
    out[[9, 11, 12]] = 8
    out[[10, 13, 0x85, 0x2028, 0x2029]] = 32
    wide = out[0x2E80:0x30000]
    wide[wide == 3] = 5
    return out


@cache
def _words_sorted() -> np.ndarray:
    found = [code_points(w) for w in FUNCTION_WORDS]
    ends = np.cumsum([len(p) for p in found])
    return np.sort(range_hashes(np.concatenate(found), ends - [len(p) for p in found], ends))


def _spans(kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words: runs of letters, marks and numbers, cut where letters without spaces between words meet others."""
    group = np.select([(kind == 1) | (kind == 2) | (kind == 4), kind == 3, kind == 5], [1, 2, 3], 0)
    edge = np.concatenate([[0], np.flatnonzero(group[1:] != group[:-1]) + 1, [len(group)]]) if len(group) else np.zeros(1, dtype=np.int64)
    inside = group[edge[:-1]] > 0 if len(group) else np.zeros(0, dtype=bool)
    return edge[:-1][inside], edge[1:][inside]


@dataclass(frozen=True)
class Tokens:
    """Class and script of the tokens of some texts, and the offsets of each text's tokens; script is -1 for what is no word."""

    classes: np.ndarray
    script: np.ndarray
    offsets: np.ndarray


def tokens(texts: list[str | None]) -> Tokens:
    """Tokens are words, runs of one other character, and line ends; white space is none."""
    masked = [_mask(t) for t in texts]
    points = code_points("\n".join(masked) + "\n")
    low = code_points("\n".join(m.lower() if len(m.lower()) == len(m) else m for m in masked) + "\n")
    kind = _kind_table()[points]
    edges = np.concatenate([[0], np.cumsum([len(m) + 1 for m in masked], dtype=np.int64)])
    starts, ends = _spans(kind)
    hashes = range_hashes(low, starts, ends)
    words = _words_sorted()
    at = np.minimum(np.searchsorted(words, hashes), len(words) - 1)
    function = np.where(words[at] == hashes, at, -1)
    counted = np.concatenate([np.zeros((3, 1), dtype=np.int32), np.cumsum([kind == 1, kind == 4, (kind == 3) | (kind == 5)], axis=1, dtype=np.int32)], axis=1)
    upper, digit, other = counted[:, ends] - counted[:, starts]
    size = ends - starts
    script = np.where(other > 0, np.where(kind[starts] == 5, 2, 1), 0) if len(starts) else np.zeros(0, dtype=np.int64)
    shape = np.select(
        [function >= 0, _repeated(hashes, np.searchsorted(edges, starts, side="right")), script == 2, script == 1, digit == size, digit > 0, (upper == size) & (size > 1), upper > 0],
        [function, _REPEATED, _WIDE, _CASELESS, _DIGITS, _MIXED, _UPPER, _TITLE],
        _LOWER,
    )
    single = np.flatnonzero((kind == 16) | (kind == 32))
    again = np.zeros(len(single), dtype=bool)
    masks = (points[single] >= 0xE100) & (points[single] < 0xE108)
    again[1:] = (single[1:] == single[:-1] + 1) & (points[single[1:]] == points[single[:-1]]) & ~masks[1:]
    single, masks = single[~again], masks[~again]
    value = points[single].astype(np.int64)
    mark = np.where(kind[single] == 32, _LINE, np.where(masks, _MASK + value - 0xE100, _OTHER + value % (_CLASSES - _OTHER)))
    place = np.concatenate([starts, single])
    order = np.argsort(place, kind="stable")
    found = np.concatenate([shape, mark])[order].astype(np.int64)
    scripts = np.concatenate([script, np.where(masks, 0, -1)])[order].astype(np.int64)
    return Tokens(found, scripts, np.searchsorted(place[order], edges))


def _repeated(hashes: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Whether each word and the one before it stood together shortly before in the same text."""
    out = np.zeros(len(hashes), dtype=bool)
    if len(hashes) < 2:
        return out
    pair = np.where(owner[1:] == owner[:-1], mix(hashes[1:] * np.uint64(3) + hashes[:-1]) ^ mix(owner[1:].astype(np.uint64)), np.arange(len(hashes) - 1).astype(np.uint64))
    order = np.argsort(pair, kind="stable")
    near = (pair[order][1:] == pair[order][:-1]) & (order[1:] - order[:-1] <= _RECENT)
    out[order[1:][near] + 1] = True
    return out


def _before(found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The classes two and one before each token."""
    return np.concatenate([[_LINE, _LINE], found[:-2]])[: len(found)], np.concatenate([[_LINE], found[:-1]])[: len(found)]


@dataclass(frozen=True)
class Model:
    """Interpolated trigram model over classes, and the band of prose in bits a token for each kind of script."""

    trigrams: np.ndarray
    bits: np.ndarray  # of each kept trigram
    back: np.ndarray  # bits of class pairs, for the other trigrams
    low: np.ndarray
    high: np.ndarray

    def stretches(self, texts: list[str | None]) -> tuple[np.ndarray, ...]:
        """Bits a token, words, function words, script and text of each stretch of up to _STRETCH tokens."""
        read = tokens(texts)
        found, offsets, n = read.classes, read.offsets, len(read.classes)
        two, one = _before(found)
        code = (two * _CLASSES + one) * _CLASSES + found
        at = np.minimum(np.searchsorted(self.trigrams, code), max(0, len(self.trigrams) - 1))
        bits = np.where(self.trigrams[at] == code, self.bits[at], self.back[one, found] + 1.0) if len(self.trigrams) else self.back[one, found]
        bits = np.minimum(bits, _MOST_BITS)
        owner = np.repeat(np.arange(len(texts)), np.diff(offsets))
        within = np.arange(n) - np.repeat(offsets[:-1], np.diff(offsets))
        stretch = np.cumsum(within % _STRETCH == 0) - 1
        count = int(stretch[-1]) + 1 if n else 0
        per = [np.bincount(stretch, read.script == k, count) for k in range(_SCRIPTS)]
        script = np.where(per[1] + per[2] > per[0] / 2, np.where(per[2] > per[1], 2, 1), 0)
        words, function = np.bincount(stretch, read.script >= 0, count), np.bincount(stretch, found < _SHAPE, count)
        return np.bincount(stretch, bits, count) / np.maximum(np.bincount(stretch, minlength=count), 1), words, function, script, owner[np.searchsorted(stretch, np.arange(count))] if n else owner

    def abnormal(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Share of each text's words that lie in abnormal stretches, and its bits a word; 0 for a text without words."""
        bits, words, function, script, owner = self.stretches(texts)
        odd = ((bits > self.high[script]) | (bits < self.low[script])) & (function * _FEW <= words)
        total = np.maximum(np.bincount(owner, words, len(texts)), 1)
        return np.bincount(owner, words * odd, len(texts)) / total, np.bincount(owner, words * bits, len(texts)) / total


def _surprise(codes: np.ndarray, n: np.ndarray, less: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """Bits of the trigrams and of all pairs by their counts, each made smaller by `less`."""
    pairs = np.bincount(codes % (_CLASSES * _CLASSES), n, _CLASSES * _CLASSES).reshape(_CLASSES, _CLASSES)
    single = pairs.sum(axis=0)
    smooth = (single + 0.5) / (single.sum() + 0.5 * _CLASSES)
    given_one = (np.maximum(pairs - less, 0.0) + 2.0 * smooth[None, :]) / (pairs.sum(axis=1, keepdims=True) + 2.0)
    before = np.bincount(codes // _CLASSES, n, _CLASSES * _CLASSES)
    given_two = (np.maximum(n - less, 0.0) + 2.0 * given_one.ravel()[codes % (_CLASSES * _CLASSES)]) / (before[codes // _CLASSES] + 2.0)
    return -np.log2(given_two), -np.log2(given_one)


def train(prose: DataFrame) -> Model:
    """The model of prose(text), counted over all of its rows.

    Two passes: class trigrams, and the spread of the scores by kind of script,
    which bounds the band.  The driver gets a bounded number of the most
    frequent trigrams and one histogram a script.  A script that prose does
    not have has an unbounded band.
    """

    def count_trigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, 0):
            found = tokens(string_values(batch.column(0))).classes
            two, one = _before(found)
            codes, n = np.unique((two * _CLASSES + one) * _CLASSES + found, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(codes, pa.int64()), pa.array(n, pa.int64())], names=["code", "n"])

    counted = prose.select("text").mapInArrow(count_trigrams, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))
    rows = counted.orderBy(F.desc("n"), "code").limit(_TRIGRAMS).toArrow()
    codes, n = rows["code"].to_numpy().astype(np.int64), rows["n"].to_numpy().astype(np.float64)
    order = np.argsort(codes)
    codes, n = codes[order], n[order]
    trigram_bits, pair_bits = _surprise(codes, n)
    nowhere = np.zeros(_SCRIPTS)
    # prose is scored as if each of its trigrams had not been counted itself, as pages were not
    shared = prose.sparkSession.sparkContext.broadcast(Model(codes, *_surprise(codes, n, 1.0), nowhere, nowhere + np.inf))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, 0):
            bits, words, _, script, _ = shared.value.stretches(string_values(batch.column(0)))
            cell = np.minimum(bits / _BIN_WIDTH, _BINS - 1).astype(np.int64) + script * _BINS
            cells, n = np.unique(cell[words > 0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int64()), pa.array(n, pa.int64())], names=["cell", "n"])

    seen = prose.select("text").mapInArrow(spread, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    histogram = np.zeros(_SCRIPTS * _BINS)
    histogram[seen["cell"].to_numpy().astype(np.int64)] = seen["n"].to_numpy()
    low, high = nowhere.copy(), nowhere + np.inf
    for k, part in enumerate(histogram.reshape(_SCRIPTS, _BINS)):
        if part.sum():
            share = np.cumsum(part) / part.sum()
            low[k], high[k] = np.searchsorted(share, _LOWEST) * _BIN_WIDTH, (np.searchsorted(share, _HIGHEST) + 1) * _BIN_WIDTH
    return Model(codes, trigram_bits, pair_bits, low, high)


def spam_pages(documents: DataFrame, id_column: str, text_column: str, model: Model, least_share: float = 0.5) -> DataFrame:
    """(id, share, bits) of the pages that are spam.

    `share` is that of the words in abnormal stretches, which
    exceeds `least_share`, and `bits` their mean surprise, the logarithm of the
    perplexity.  Null, empty and blank texts are none.  Repeated rows come out
    each.  Other columns are not read.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)
    source = documents.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")).where(F.col("text").isNotNull())
    kind = source.schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, 1):
            share, bits = shared.value.abnormal(string_values(batch.column(1)))
            keep = pa.array(share > least_share)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), pa.array(share).filter(keep), pa.array(bits).filter(keep)], names=["id", "share", "bits"])

    return source.mapInArrow(run, f"id {kind}, share double, bits double").withColumnRenamed("id", id_column)
