"""Scores of predictions against references.

Tokens are runs of ASCII letters and digits of the lower-cased text.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types


MOST_SETS = 100  # evaluation sets of one report


def tokens(text: Column) -> Column:
    words = F.split(F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", " ")), " ")
    return F.filter(words, lambda w: w != "")


def _measures(common: Column, predicted: Column, expected: Column) -> Column:
    precision = F.when(predicted > 0, common / predicted).otherwise(0.0)
    recall = F.when(expected > 0, common / expected).otherwise(0.0)
    return F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).otherwise(0.0)


def _shared(predicted: list[str], expected: list[str], n: int) -> int:
    """Runs of n words that both have, counted with repeats."""
    grams = lambda words: Counter(words if n == 1 else zip(*(words[k:] for k in range(n)), strict=False))
    return (grams(predicted) & grams(expected)).total()


def shared_ngrams(n: int) -> Callable[..., Column]:
    """An Arrow function: n-grams shared by two arrays of words, linear in their length."""

    @F.arrow_udf(types.IntegerType())
    def count(predicted: pa.Array, expected: pa.Array) -> pa.Array:
        return pa.array([_shared(p or [], r or [], n) for p, r in zip(predicted.to_pylist(), expected.to_pylist(), strict=True)], pa.int32())

    return count


def rouge_n_score(predicted: Column, expected: Column, n: int) -> Column:
    """F1 of the n-grams shared by two arrays of words, counted with repeats."""
    size = lambda words: F.greatest(F.size(words) - (n - 1), F.lit(0))
    return _measures(shared_ngrams(n)(predicted, expected), size(predicted), size(expected))


def rouge_n(pairs: DataFrame, key: str, n: int, prediction: str = "prediction", reference: str = "reference", prepare=tokens) -> DataFrame:
    """(key, score) of each pair by rouge_n_score; words are made once, and nothing is shuffled."""
    sides = pairs.select(key, prepare(F.col(prediction)).alias("p"), prepare(F.col(reference)).alias("r"))
    return sides.select(key, rouge_n_score(F.col("p"), F.col("r"), n).alias("score"))


def _lcs(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, by bit-parallel rows."""
    places: dict[str, int] = {}
    for i, word in enumerate(a):
        places[word] = places.get(word, 0) | 1 << i
    row = (1 << len(a)) - 1
    full = row
    for word in b:
        matched = row & places.get(word, 0)
        row = ((row + matched) | (row - matched)) & full
    return len(a) - row.bit_count()


@F.arrow_udf(types.IntegerType())
def lcs_length(a: pa.Array, b: pa.Array) -> pa.Array:
    """Length of the longest common subsequence of two arrays of words."""
    return pa.array([_lcs(x or [], y or []) for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True)], pa.int32())


def rouge_l(pairs: DataFrame, key: str, prediction: str = "prediction", reference: str = "reference", prepare=tokens) -> DataFrame:
    """(key, score): F1 of the longest common subsequence."""
    sides = pairs.select(key, prepare(F.col(prediction)).alias("p"), prepare(F.col(reference)).alias("r"))
    return sides.select(key, _measures(lcs_length("p", "r"), F.size("p"), F.size("r")).alias("score"))


def _lcs_places(reference: list[str], candidate: list[str]) -> set[int]:
    """Places in the reference of one longest common subsequence.

    Row j has a zero bit at i where the length for the first j words of the
    candidate grows with word i of the reference; the way back reads the rows.
    """
    bits: dict[str, int] = {}
    for i, word in enumerate(reference):
        bits[word] = bits.get(word, 0) | 1 << i
    full = (1 << len(reference)) - 1
    rows = [full]
    row = full
    for word in candidate:
        if matched := row & bits.get(word, 0):
            row = ((row + matched) | (row - matched)) & full
        rows.append(row)
    places, i, j = set(), len(reference), len(candidate)
    while i and j:
        if reference[i - 1] == candidate[j - 1]:
            places.add(i - 1)
            i, j = i - 1, j - 1
        elif rows[j] >> (i - 1) & 1:
            i -= 1
        else:
            j -= 1
    return places


def _union_hits(predicted: list[list[str]], expected: list[list[str]]) -> int:
    """Words of the expected lines hit by the union of subsequences with the predicted lines."""
    left_p: dict[str, int] = {}
    left_r: dict[str, int] = {}
    for lines, left in ((predicted, left_p), (expected, left_r)):
        for line in lines:
            for word in line:
                left[word] = left.get(word, 0) + 1
    hits = 0
    for line in expected:
        union = set().union(*[_lcs_places(line, p) for p in predicted]) if predicted else set()
        for place in sorted(union):
            word = line[place]
            if left_p.get(word, 0) > 0 and left_r.get(word, 0) > 0:
                hits += 1
                left_p[word] -= 1
                left_r[word] -= 1
    return hits


@F.arrow_udf(types.IntegerType())
def union_lcs(predicted: pa.Array, expected: pa.Array) -> pa.Array:
    """Hits of the line-wise score for two arrays of lines of words."""
    return pa.array([_union_hits(p or [], r or []) for p, r in zip(predicted.to_pylist(), expected.to_pylist(), strict=True)], pa.int32())


def rouge_lsum(pairs: DataFrame, key: str, prediction: str = "prediction", reference: str = "reference", prepare=tokens) -> DataFrame:
    """(key, score): F1 of the union of common subsequences of lines."""
    rows = lambda c: F.filter(F.transform(F.split(F.coalesce(F.col(c), F.lit("")), "\n"), prepare), lambda w: F.size(w) > 0)
    sides = pairs.select(key, rows(prediction).alias("p"), rows(reference).alias("r"))
    total = lambda c: F.aggregate(c, F.lit(0), lambda s, line: s + F.size(line))
    return sides.select(key, _measures(union_lcs("p", "r"), total("p"), total("r")).alias("score"))


class _Stemmer:
    """The suffix-stripping algorithm published by Porter in 1980.

    Rules are data: each step lists suffix, replacement and the condition on
    what is before the suffix.
    """

    # The suffix tables of the published steps.
    STEP_2 = (
        ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"),
        ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"),
        ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"),
    )
    STEP_3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
    STEP_4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")

    @staticmethod
    def shape(word: str) -> str:
        """c for each consonant and v for each vowel; y after a consonant is a vowel."""
        out = ""
        for i, c in enumerate(word):
            out += "v" if c in "aeiou" or (c == "y" and i > 0 and out[-1] == "c") else "c"
        return out

    @classmethod
    def measure(cls, stem: str) -> int:
        return len(re.findall("v+c+", cls.shape(stem)))

    @classmethod
    def short(cls, stem: str) -> bool:
        return cls.shape(stem)[-3:] == "cvc" and stem[-1] not in "wxy"

    @classmethod
    def longest(cls, word: str, suffixes) -> str | None:
        return max((s for s in suffixes if word.endswith(s)), key=len, default=None)

    @classmethod
    def stem(cls, word: str) -> str:
        if len(word) <= 2:
            return word
        for suffix, by in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):
            if word.endswith(suffix):
                word = word[: len(word) - len(suffix)] + by
                break
        if word.endswith("eed"):
            word = word[:-1] if cls.measure(word[:-3]) > 0 else word
        else:
            for suffix in ("ed", "ing"):
                base = word[: -len(suffix)]
                if word.endswith(suffix) and "v" in cls.shape(base):
                    if base.endswith(("at", "bl", "iz")):
                        base += "e"
                    elif len(base) > 1 and base[-1] == base[-2] and cls.shape(base)[-1] == "c" and base[-1] not in "lsz":
                        base = base[:-1]
                    elif cls.measure(base) == 1 and cls.short(base):
                        base += "e"
                    word = base
                    break
        if word.endswith("y") and "v" in cls.shape(word[:-1]):
            word = word[:-1] + "i"
        for table in (cls.STEP_2, cls.STEP_3):
            rules = dict(table)
            suffix = cls.longest(word, rules)
            if suffix and cls.measure(word[: -len(suffix)]) > 0:
                word = word[: -len(suffix)] + rules[suffix]
        suffix = cls.longest(word, cls.STEP_4)
        if suffix:
            base = word[: -len(suffix)]
            if cls.measure(base) > 1 and (suffix != "ion" or base[-1:] in ("s", "t")):
                word = base
        if word.endswith("e"):
            base = word[:-1]
            if cls.measure(base) > 1 or (cls.measure(base) == 1 and not cls.short(base)):
                word = base
        if word.endswith("ll") and cls.measure(word[:-1]) > 1:
            word = word[:-1]
        return word


@lru_cache(maxsize=100_000)
def stem(word: str) -> str:
    """A lower-case word's stem."""
    return _Stemmer.stem(word)


@F.arrow_udf(types.ArrayType(types.StringType()))
def _stems(words: pa.Array) -> pa.Array:
    return pa.array([[stem(w) if len(w) > 3 else w for w in row or []] for row in words.to_pylist()], pa.list_(pa.string()))


def stemmed_tokens(text: Column) -> Column:
    """Tokens, those of more than three characters stemmed."""
    return _stems(tokens(text))


def unmasked(labels: Column, pad: int, masked: int = -100) -> Column:
    """Label ids with the masked ones as pad ids."""
    return F.transform(labels, lambda x: F.when(x == masked, F.lit(pad)).otherwise(x))


def generated_length(ids: Column, pad: int) -> Column:
    """Number of ids that aren't pads."""
    return F.size(F.filter(ids, lambda x: x != pad))


def rounded(value: Column) -> Column:
    return F.round(value, 4)


def rouge_scores(pairs: DataFrame, keep: list[str | Column], prediction: str = "prediction", reference: str = "reference", prepare=tokens) -> DataFrame:
    """The columns `keep` with rouge1, rouge2, rougeL and rougeLsum of each pair, in one pass over the texts."""
    lines = lambda c: F.filter(F.transform(F.split(F.coalesce(F.col(c), F.lit("")), "\n"), prepare), lambda w: F.size(w) > 0)
    rows = pairs.select(*keep, prepare(F.col(prediction)).alias("__p"), prepare(F.col(reference)).alias("__r"), lines(prediction).alias("__pl"), lines(reference).alias("__rl"))
    p, r = F.col("__p"), F.col("__r")
    return rows.select(
        *rows.columns[: len(keep)],
        rouge_n_score(p, r, 1).alias("rouge1"),
        rouge_n_score(p, r, 2).alias("rouge2"),
        _measures(lcs_length(p, r), F.size(p), F.size(r)).alias("rougeL"),
        _measures(union_lcs(F.col("__pl"), F.col("__rl")), F.size(p), F.size(r)).alias("rougeLsum"),
    )


def metrics_summary(scores: DataFrame, names: list[str], by: str = "eval_set") -> DataFrame:
    """One row for each evaluation set: the mean of each score, rounded, and the number of pairs."""
    return scores.groupBy(by).agg(*[rounded(F.avg(n)).alias(n) for n in names], F.count(F.lit(1)).alias("n_pairs"))


def decoded(ids: Column, vocabulary: Column, skip: tuple[int, ...] = ()) -> Column:
    """Texts of arrays of ids by a map from id to token; ids to skip and unknown ones are left out, as special tokens are."""
    kept = F.filter(ids, lambda x: ~x.isin(*skip)) if skip else ids
    return F.array_join(F.transform(kept, lambda x: F.try_element_at(vocabulary, x)), " ")


def combined_metrics(summary: DataFrame, by: str = "eval_set") -> DataFrame:
    """One row with every set's scores under <set>_<score>, in the order of the sets' names.

    The sets are few; their names are read first.
    """
    names = [c for c in summary.columns if c != by]
    sets = [r[0] for r in summary.select(by).distinct().orderBy(by).limit(MOST_SETS + 1).collect()]
    if len(sets) > MOST_SETS:
        raise ValueError(f"more than {MOST_SETS} evaluation sets")
    pick = lambda s, n: F.max(F.when(F.col(by) == s, F.col(n))).alias(f"{s}_{n}")
    return summary.agg(*[pick(s, n) for s in sets for n in names]) if sets else summary.limit(0)


def report_line(combined: DataFrame, sets: list[str], score: str = "rougeL") -> DataFrame:
    """(eval_set, score) of the sets asked for: <set>_<score>, else <score>, else N/A; four decimals."""
    columns = combined.columns

    def shown(name: str) -> Column:
        found = [c for c in (f"{name}_{score}", score) if c in columns]
        values = [F.format_string("%.4f", F.col(c).cast("double")) for c in found]
        return F.coalesce(*[F.when(F.col(c).isNotNull(), v) for c, v in zip(found, values, strict=True)], F.lit("N/A"))

    rows = F.array(*[F.struct(F.lit(s).alias("eval_set"), shown(s).alias("score")) for s in sets])
    return combined.select(F.explode(rows).alias("r")).select("r.eval_set", "r.score")
