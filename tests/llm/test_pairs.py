from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from quireflow.llm import near_duplicates as near_duplicates_module
from quireflow.llm import pairs, tokens
from quireflow.llm.cross_split import overlaps
from quireflow.llm.near_duplicates import near_duplicates

from . import texts as X


def frame(spark, values):
    """Rows with columns whose names the operators use themselves."""
    rows = [(i, t, "noise", -1) for i, t in enumerate(values)]
    return spark.createDataFrame(rows, "key long, body string, text string, id int")


def test_tokens_and_shingles_agree_with_a_loop():
    odd = ["İstanbul’s ÇA, va? ñ́ 3.5\n", None, "", "日本 語x", "a" * 5000, *X.family(3, 2)]
    hashes, offsets = tokens.token_hashes(odd)
    names = {}
    for k, text in enumerate(odd):
        mine = X.tokens(text)
        assert len(mine) == offsets[k + 1] - offsets[k]
        for h, t in zip(hashes[offsets[k] : offsets[k + 1]].tolist(), mine, strict=True):
            assert names.setdefault(t, h) == h
    assert len(set(names.values())) == len(names)
    flat, at, n = tokens.distinct_shingles(odd, 3, 20)
    assert [int(b - a) for a, b in zip(at[:-1], at[1:], strict=True)] == [len(X.shingles(t, 3)) for t in odd]
    assert n.tolist() == [len(X.tokens(t)) for t in odd]


@pytest.mark.parametrize(("width", "threshold"), [(3, 0.5), (5, 0.8)])
def test_groups_agree_with_all_pairs(spark, width, threshold):
    values = X.family(1)
    found = {r.id: r.group for r in near_duplicates(frame(spark, values), "key", "body", width, threshold).collect()}
    assert found == X.groups(values, threshold, width)


def test_groups_do_not_depend_on_partitions_and_keep_fields_apart(spark):
    values = X.family(2, 4)
    df = frame(spark, values).repartition(5).withColumn("field", F.pmod("key", F.lit(2)))
    found = {r.id: r.group for r in near_duplicates(df, "key", "body", 3, 0.5, within=F.col("field")).collect()}
    want = {}
    for side in (0, 1):
        mine = [i for i in range(len(values)) if i % 2 == side]
        want |= {mine[a]: mine[b] for a, b in X.groups([values[i] for i in mine], 0.5).items()}
    assert found == want


def test_a_hot_group_of_near_copies(spark):
    rng = random.Random(5)
    base = X.prose(rng, 80)
    values = [X.edited(rng, base, 1) for _ in range(300)] + [base] * 200 + [X.prose(rng) for _ in range(300)]
    rows = near_duplicates(frame(spark, values).repartition(6), "key", "body", 3, 0.5).collect()
    assert {r.id for r in rows} == set(range(500)) and {r.group for r in rows} == {0}


def test_links_that_meet_only_in_crowded_buckets(spark):
    rng = random.Random(8)
    shared = X.prose(rng, 62)
    own = [X.prose(rng, 10) for _ in range(100)]
    values = [f"{shared} {mine} {X.prose(rng, 28)}" for _ in range(2) for mine in own]  # partners' ids are far apart
    found = {r.id: r.group for r in near_duplicates(frame(spark, values).repartition(3), "key", "body", 3, 0.5).collect()}
    assert found == X.groups(values, 0.5)


def test_texts_contained_in_another(spark):
    rng = random.Random(9)
    values = []
    for _ in range(200):
        base = X.prose(rng, 60)
        values += [base, f"{base} {X.prose(rng, 56)}"]
    linked = {i for i in range(0, 400, 2) if X.similarity(values[i], values[i + 1]) >= 0.5}
    assert len(linked) > 150
    found = {r.id: r.group for r in near_duplicates(frame(spark, values), "key", "body", 3, 0.5).collect()}
    assert found == {i + k: i for i in linked for k in (0, 1)}


def test_nothing_to_group(spark):
    assert near_duplicates(frame(spark, []), "key", "body").count() == 0
    assert near_duplicates(frame(spark, [None, "", "x"]), "key", "body").count() == 0


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 90), (7, 7)], "a long, b long")
    assert {r.id: r.root for r in pairs.components(links).collect()} == {i: 0 for i in range(41)} | {90: 90, 100: 90}
    assert pairs.components(links.limit(0)).count() == 0


def test_overlaps_agree_with_all_pairs(spark):
    values = X.family(4)
    df = frame(spark, values).withColumn("side", F.when(F.pmod("key", F.lit(3)) == 0, True).when(F.pmod("key", F.lit(7)) != 0, False))
    held = {i for i in range(len(values)) if i % 3 == 0}
    train = {i for i in range(len(values)) if i % 3 and i % 7}
    found, members = overlaps(df, "key", "body", F.col("side"), 3, 0.5)
    least = {r.id: r.least for r in members.collect()}
    linked = {(r.train, r.held_out): r.similarity for r in found.collect()}
    want = {(a, b) for a in train for b in held if X.similarity(values[a], values[b]) >= 0.5}
    assert {(a, b) for a in train for b in held if (least.get(a), least.get(b)) in linked} == want
    assert all(abs(s - X.similarity(values[a], values[b])) < 1e-12 for (a, b), s in linked.items())


def test_no_overlaps(spark):
    df = frame(spark, []).withColumn("side", F.lit(True))
    assert [x.count() for x in overlaps(df, "key", "body", F.col("side"))] == [0, 0]


def half_alike(seed, families, members=12, words=300):
    """Texts of families whose members have two fifths of their shingles in common, and a near copy of every seventh."""
    rng = random.Random(seed)
    values = []
    for _ in range(families):
        shared = X.prose(rng, words * 23 // 20)
        values += [f"{shared} {X.prose(rng, words * 17 // 20)}" for _ in range(members)]
    return values + [X.edited(rng, v, 3) for v in values[::7]]


def test_disk_follows_the_rows_and_not_the_pairs_that_fail(spark):
    values = half_alike(14, 60)
    df = frame(spark, values).repartition(3).select("key", "body").cache()
    df.count()

    def written():
        executors = spark.sparkContext._jsc.sc().statusStore().executorList(True)
        return sum(executors.apply(i).totalShuffleWrite() for i in range(executors.size()))

    # as on a table of many partitions, where nothing is sent whole and a text's pairs lie apart
    conf = {"spark.sql.shuffle.partitions": "40", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    kept = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    before = written()
    found = {r.id: r.group for r in near_duplicates(df, "key", "body", 3, 0.5).collect()}
    for k, v in kept.items():
        spark.conf.set(k, v)
    assert found == {i: i for i in range(0, 720, 7)} | {720 + k: 7 * k for k in range(103)}
    assert written() - before < 10 * sum(map(len, values))


def test_slices_lose_nothing(spark, monkeypatch):
    rng = random.Random(16)
    shared = X.prose(rng, 62)
    own = [X.prose(rng, 10) for _ in range(60)]
    values = X.family(6, 8) + half_alike(15, 5, words=60) + [f"{shared} {mine} {X.prose(rng, 28)}" for _ in range(2) for mine in own]
    steps = []
    monkeypatch.setattr(near_duplicates_module, "released", lambda session: steps.append(1))
    rows = frame(spark, values).repartition(3)
    want = X.groups(values, 0.5)
    assert {r.id: r.group for r in near_duplicates(rows, "key", "body", 3, 0.5).collect()} == want
    whole = len(steps)
    monkeypatch.setattr(near_duplicates_module, "_LEAST_SLICE", 60)
    monkeypatch.setattr(near_duplicates_module, "_ROW_MEETINGS", 8)
    assert {r.id: r.group for r in near_duplicates(rows, "key", "body", 3, 0.5).collect()} == want
    assert len(steps) > 2 * whole + 20
