"""Queries that must read whole texts, against brute force."""

from __future__ import annotations

import random
import re
from collections import Counter

import __spark_entry__ as entry
from quireflow.operators import metrics as M

SMALL = "/root/testdata/sf0.001"


def words(text):
    return re.findall("[a-z0-9]+", text.lower())


def table(a, b):
    out = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            out[i + 1][j + 1] = out[i][j] + 1 if x == y else max(out[i][j + 1], out[i + 1][j])
    return out


def places(reference, candidate):
    t, found, i, j = table(reference, candidate), set(), len(reference), len(candidate)
    while i and j:
        if reference[i - 1] == candidate[j - 1]:
            found.add(i - 1)
            i, j = i - 1, j - 1
        elif t[i][j - 1] > t[i - 1][j]:
            j -= 1
        else:
            i -= 1
    return found


def f1(common, predicted, expected):
    return 2 * common / (predicted + expected) if common else 0.0


def line_score(prediction, reference):
    p, r = [[w for line in text.split("\n") if (w := words(line))] for text in (prediction, reference)]
    left_p, left_r = (Counter(w for line in lines for w in line) for lines in (p, r))
    hits = 0
    for line in r:
        for place in sorted(set().union(*[places(line, x) for x in p])):
            if left_p[line[place]] and left_r[line[place]]:
                hits += 1
                left_p[line[place]] -= 1
                left_r[line[place]] -= 1
    return f1(hits, sum(map(len, p)), sum(map(len, r)))


def stems_score(prediction, reference):
    p, r = ([M.stem(w) if len(w) > 3 else w for w in words(t)] for t in (prediction, reference))
    return f1((Counter(p) & Counter(r)).total(), len(p), len(r))


def longest_score(prediction, reference):
    p, r = words(prediction), words(reference)
    return f1(table(p, r)[-1][-1], len(p), len(r))


def test_places_of_a_subsequence_agree_with_the_table():
    rng = random.Random(1)
    for _ in range(300):
        a, b = ([rng.choice("abcde") for _ in range(rng.randrange(90))] for _ in range(2))
        assert M._lcs_places(a, b) == places(a, b)


def test_scores_are_of_whole_articles(spark):
    papers = entry.queries()["clean_field"](spark, SMALL).collect()
    texts = {r.row_id: (r.article, r.abstract) for r in papers if r.article and r.abstract}
    for name, score in (("rouge_l", longest_score), ("rouge_lsum", line_score), ("rouge_stemmed", stems_score)):
        found = {r.row_id: r.score for r in entry.queries()[name](spark, SMALL).collect()}
        assert found.keys() == texts.keys()
        assert all(abs(found[k] - score(*texts[k])) < 1e-6 for k in texts), name
