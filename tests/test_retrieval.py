from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from quireflow.config import NoiseConfig, RetrievalConfig
from quireflow.functions import vectors as V
from quireflow.operators import noise as N
from quireflow.operators import retrieval as R


def test_picks_by_hand(spark):
    # unit vectors with the worked similarities are approximated by scores given apart
    sims = np.array([[1, 0.95, -0.2], [0.95, 1, 0.1], [-0.2, 0.1, 1]])
    root = np.linalg.cholesky(sims + 1e-9 * np.eye(3))
    df = spark.createDataFrame([([0.9, 0.8, 0.7], root.tolist())], "s array<double>, v array<array<double>>")
    pick = R.mmr_positions(0.5, 3)
    assert [list(r) for r in df.select(pick("s", "v", F.lit(2)), pick("s", "v", F.lit(3))).first()] == [[0, 2], [0, 2, 1]]


def test_without_redundancy_the_best_are_picked(spark):
    df = spark.createDataFrame([([0.1, 0.9, 0.5], np.eye(3).tolist())], "s array<double>, v array<array<double>>")
    assert df.select(R.mmr_positions(1.0, 3)("s", "v", F.lit(5))).first()[0] == [1, 2, 0]


@pytest.mark.parametrize(("n", "noise", "kept", "candidates"), [(1, 2, 1, 1), (3, 2, 1, 3), (4, 2, 2, 4), (5, 2, 3, 5), (3, 0, 3, 3), (80, 2, 3, 50)])
def test_numbers_kept(spark, n, noise, kept, candidates):
    k = R.effective_k(F.lit(n), RetrievalConfig(noise_k=noise))
    assert tuple(spark.range(1).select(k, R.candidate_k(F.lit(n), k)).first()) == (kept, candidates)


def test_arguments(spark):
    df = spark.createDataFrame([(1, "a", [1.0])], "query_id int, chunk_gid string, vec array<double>")
    with pytest.raises(ValueError):
        R.search(df, df, 0, 1)
    with pytest.raises(ValueError):
        R.search(df, df, 1, 1, weight=2)
    with pytest.raises(ValueError):
        RetrievalConfig(mmr_lambda=-1)
    with pytest.raises(ValueError):
        N.check_mode("else")


def test_usable_vectors(spark):
    rows = [([1.0, 2.0],), (None,), ([1.0],), ([float("nan"), 1.0],), ([0.0, 0.0],), ([None, 1.0],)]
    df = spark.createDataFrame(rows, "v array<float>")
    assert [bool(r[0]) for r in df.select(V.usable(F.col("v"), 2)).collect()] == [True, False, False, False, False, False]


def test_vector_functions(spark):
    df = spark.createDataFrame([([3.0, 4.0], [[1.0, 1.0], [3.0, 5.0]], [1.0, 0.0])], "v array<double>, t array<array<double>>, m array<double>")
    row = df.select(V.l2_normalize(F.col("v")), V.unit_vectors(2)("v"), V.dot(F.col("v"), F.col("v")), V.dot_products(2)("v", "v"), V.masked_mean(F.col("t"), F.col("m"))).first()
    assert row[0] == row[1] == [0.6, 0.8] and row[2] == row[3] == 25.0 and row[4] == [1.0, 1.0]


def test_encoder_is_made_once_a_worker(spark):
    encode = V.encoding(lambda: lambda texts: np.array([[len(t), 1.0] for t in texts]))
    rows = spark.createDataFrame([("abc",), (None,)], "t string").select(encode("t").alias("v")).collect()
    assert np.allclose([r.v for r in rows], [[3 / np.sqrt(10), 1 / np.sqrt(10)], [0, 1]], atol=1e-6)


def pool(spark, sims, paper="other"):
    return spark.createDataFrame([(0, f"{paper}", f"{paper}_{i}", float(s)) for i, s in enumerate(sims)], "query int, paper_id string, chunk_gid string, sim double")


def test_bands_by_hand(spark):
    candidates, _ = N.scoped(pool(spark, [0, 0.1, 0.2, 0.3, 0.4]), spark.createDataFrame([("p", 0)], "paper_id string, query int"))
    levels = N.percentiles(candidates).first()
    assert np.allclose([levels.p25, levels.p50, levels.p90], [0.1, 0.2, 0.36])
    easy = {r.sim for r in N.banded(candidates, "cross_doc_easy").where("in_band").collect()}
    hard = {r.sim for r in N.banded(candidates, "cross_doc_hard").where("in_band").collect()}
    assert easy == {0.2, 0.3} and hard == {0.0, 0.1}
    for mode in ("cross_doc_easy", "cross_doc_hard"):
        rows = N.with_fallback(N.banded(candidates, mode), mode, 3).collect()
        assert len(rows) == 5 and {r.noise_source for r in rows} == {f"{mode}_fallback_random"}


def test_noise_never_comes_from_the_own_paper(spark):
    sims = pool(spark, np.linspace(0, 1, 12), "a").union(pool(spark, np.linspace(0.2, 0.8, 8), "b"))
    papers = spark.createDataFrame([("a", 0), ("b", 0), ("c", 0)], "paper_id string, query int")
    for mode in ("cross_doc_easy", "cross_doc_hard", "cross_document"):
        rows = N.draw_noise(sims, papers, mode, 2).collect()
        assert sorted(r.paper_id for r in rows) == ["a", "a", "b", "b", "c", "c"]
        assert all(not r.chunk_gid.startswith(r.paper_id) for r in rows)
        assert len({(r.paper_id, r.chunk_gid) for r in rows}) == 6
    loose = N.draw_noise(sims, papers, "cross_doc_easy", 2, NoiseConfig(strict_exclusion=False)).collect()
    assert len(loose) == 6


def test_small_pool_gives_what_it_has(spark):
    papers = spark.createDataFrame([("p", 0)], "paper_id string, query int")
    assert len(N.draw_noise(pool(spark, [0.5]), papers, "cross_doc_easy", 2).collect()) == 1
    assert N.draw_noise(pool(spark, [0.5]).limit(0), papers, "cross_doc_easy", 2).count() == 0


def test_negatives(spark):
    queries = spark.createDataFrame([(0,), (1,)], "query_id int")
    chunks = spark.createDataFrame([(f"c{i}",) for i in range(6)], "chunk_gid string")
    exclude = spark.createDataFrame([(0, "c0"), (0, "c1"), (0, "c2"), (0, "c3")], "query_id int, chunk_gid string")
    rows = R.random_negatives(queries, chunks, exclude, 2, 1).collect()
    assert {r.chunk_gid for r in rows if r.query_id == 0} == {"c4", "c5"} and sum(r.query_id == 1 for r in rows) == 2
    assert R.random_negatives(queries, chunks, exclude, 0, 1).count() == 0
    best = spark.createDataFrame([(0, f"c{i}", i + 1) for i in range(6)], "query_id int, chunk_gid string, rank int")
    assert {r.chunk_gid for r in R.hard_negatives(best, exclude, 5, 1, skip=2).collect()} == {"c4", "c5"}
