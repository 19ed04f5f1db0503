"""From papers to example sets, the command line, the retriever and the report."""

from __future__ import annotations

import json
from functools import partial

import numpy as np
import pytest
from pyspark.sql import functions as F

from quireflow import cli
from quireflow.functions import vectors as V
from quireflow.operators import chunking as C
from quireflow.operators import metrics as M
from quireflow.operators import retrieval as R
from quireflow.plans import build as B
from quireflow.session import few
from quireflow.sources import models, readers, sinks


def article(k):
    words = [f"w{(k * 7 + i * i) % 97}" for i in range(700)]
    return "Introduction\n" + " ".join(w + ("." if i % 11 == 10 else "") + (" The" if i % 11 == 10 else "") for i, w in enumerate(words))


def papers(spark, counts):
    rows = [(f"{s}_{i}", s, i, article(100 * j + i), f"Summary {s} {i}.") for j, (s, n) in enumerate(counts.items()) for i in range(n)]
    return spark.createDataFrame(rows, "paper_id string, split string, idx int, article string, abstract string")


def test_examples_of_all_sets(spark):
    options = B.BuildOptions(train_limit=2, test_limit=1, pool_limit=4)
    rows = B.examples_from_papers(papers(spark, {"train": 6, "validation": 2, "test": 3}), partial(V.hashing_encoder, 32), 32, options).collect()
    sets = {}
    for r in rows:
        sets.setdefault(r.output_set, set()).add(r.paper_id)
        assert r.input_text.startswith("summarize: question: ") and r.target_text.startswith("Summary")
    assert sets == {"train": {"train_0", "train_1"}, "valid": {"validation_0", "validation_1"}, "test_clean": {"test_0"}, "test_noisy_easy": {"test_0"}, "test_noisy_hard": {"test_0"}}
    drawn = [r for r in rows if r.sample_type == "noisy"]
    assert drawn and all(r.num_contexts == 5 for r in drawn)


def test_no_papers(spark):
    none = papers(spark, {"train": 1}).limit(0)
    assert B.examples_from_papers(none, partial(V.hashing_encoder, 8), 8).count() == 0


def test_options_are_checked():
    with pytest.raises(ValueError):
        B.BuildOptions(train_mode="loud")
    with pytest.raises(ValueError):
        B.BuildOptions(train_limit=-1)
    with pytest.raises(SystemExit):
        cli.parser().parse_args(["build", "--papers", "a", "--out", "b", "--train-mode", "loud"])
    with pytest.raises(ValueError):
        cli.factory("module")


def test_command_line(spark, tmp_path, capsys):
    source = tmp_path / "papers"
    papers(spark, {"train": 3, "validation": 1, "test": 1}).select("split", "article", "abstract").write.partitionBy("split").parquet(str(source))
    cli.main(["build", "--papers", str(source), "--format", "parquet", "--out", str(tmp_path / "out"), "--dimensions", "16", "--encoder", "tests.test_build:encoder", "--pool-limit", "2"])
    shown = capsys.readouterr().out
    assert "rate test_noisy_easy" in shown and "1/1 (100.0%)" in shown
    assert {p.name for p in (tmp_path / "out").iterdir() if p.is_dir()} == {f"output_set={s}" for s in sinks.OUTPUT_SETS}
    pairs = tmp_path / "pairs.jsonl"
    pairs.write_text("\n".join(json.dumps({"eval_set": s, "prediction": p, "reference": "the cat sat"}) for s, p in (("a", "the cat sat"), ("b", "dogs"))), encoding="utf-8")
    cli.main(["score", "--pairs", str(pairs), "--out", str(tmp_path / "scores")])
    found = json.loads((tmp_path / "scores" / "metrics.json").read_text())
    assert found["a_rougeL"] == 1.0 and found["b_rouge1"] == 0.0 and found["a_n_pairs"] == 1


def encoder():
    return V.hashing_encoder(16)


def test_models_by_path(tmp_path):
    models.save_model(str(tmp_path / "m"), "quireflow.functions.vectors:hashing_encoder", size=16)
    made = models.load_model(str(tmp_path / "m"))()
    assert (made(["a b"]) == V.hashing_encoder(16)(["a b"])).all()
    with pytest.raises(ValueError):
        models.save_model(str(tmp_path / "n"), "nowhere")
    with pytest.raises(FileNotFoundError):
        models.load_model(str(tmp_path / "n"))


def test_arrow_and_tsv_papers_by_command_line(spark, tmp_path):
    rows = papers(spark, {"train": 2, "validation": 1, "test": 1})
    for split in cli.SPLITS:
        assert sinks.write_arrow_shards(rows.where(F.col("split") == split).select("article", "abstract"), f"{tmp_path}/a/{split}") >= 1
        rows.where(F.col("split") == split).select(F.concat_ws("\t", F.regexp_replace("article", "\n", " "), "abstract")).write.text(f"{tmp_path}/t/{split}.tsv")
    for kind in ("arrow", "tsv"):
        found = cli.read_papers(spark, f"{tmp_path}/{kind[0]}", kind)
        assert sorted(r.paper_id for r in found.collect()) == ["test_0", "train_0", "train_1", "validation_0"]
    with pytest.raises(FileNotFoundError):
        readers.read_arrow_papers(spark, f"{tmp_path}/a", "dev")


def test_another_splitter(spark):
    df = spark.createDataFrame([(1, "one; two; " + "three " * 20)], "paper_id int, article string")
    plain = C.chunk_documents(df).count()
    made = C.chunk_documents(df, make=lambda: lambda text: text.split(";")).collect()
    assert plain == 1 and made[0].text.startswith("one two three")
    broken = C.chunk_documents(df, make=lambda: lambda text: 1 / 0).collect()
    assert len(broken) == 1 and broken[0].text.startswith("one; two;")


def vectors(spark, n=40, size=8):
    rng = np.random.default_rng(1)
    values = rng.standard_normal((n, size))
    values[5] = values[3]
    values /= np.linalg.norm(values, axis=1, keepdims=True)
    return values, spark.createDataFrame([(f"c{i:02d}", v.tolist()) for i, v in enumerate(values)], "chunk_gid string, vec array<double>")


def test_blocks_agree_with_all_scores(spark, monkeypatch):
    monkeypatch.setattr(R, "_QUERY_BLOCK", 3)
    values, chunks = vectors(spark)
    asked = spark.createDataFrame([(i, values[i].tolist()) for i in range(8)], "query_id int, qvec array<double>")
    found = {}
    for r in R.best_chunks(asked, chunks.repartition(4), 6, 8).orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append(int(r.chunk_gid[1:]))
    for q in range(8):
        s = np.round(values @ values[q], 12)
        assert found[q] == np.lexsort((np.arange(40), -s))[:6].tolist()
    assert R.best_chunks(asked.limit(0), chunks, 3, 8).count() == 0
    assert R.best_chunks(asked, chunks.limit(0), 3, 8).count() == 0


def test_retriever(spark):
    values, chunks = vectors(spark)
    asked = spark.createDataFrame([(0, values[0].tolist())], "query_id int, qvec array<double>")
    with pytest.raises(RuntimeError):
        R.Retriever(8).search(asked, 3)
    with pytest.raises(ValueError):
        R.Retriever(8).build(chunks.limit(0))
    with pytest.raises(ValueError):
        R.Retriever(8, weight=2.0)
    retriever = R.Retriever(8).build(chunks)
    picks = [r.chunk_gid for r in retriever.search(asked, 3).orderBy("rank").collect()]
    for hard in (False, True):
        rows = retriever.contexts(asked, 3, 2, shuffle=True, hard=hard).orderBy("pos").collect()
        assert [r.pos for r in rows] == [1, 2, 3, 4, 5]
        assert {r.chunk_gid for r in rows if not r.is_noise} == set(picks)
        assert len({r.chunk_gid for r in rows}) == 5
    assert retriever.contexts(asked, 2, 0).count() == 2
    with pytest.raises(ValueError):
        retriever.contexts(asked, 2, -1)


def test_few(spark):
    assert few(spark.range(5), 5).count() == 5
    with pytest.raises(ValueError):
        few(spark.range(6), 5)


def test_report(spark):
    summary = spark.createDataFrame([("a", 0.5, 3), ("b", 0.25, 1)], "eval_set string, rougeL double, n_pairs int")
    combined = M.combined_metrics(summary)
    assert combined.first().asDict() == {"a_rougeL": 0.5, "a_n_pairs": 3, "b_rougeL": 0.25, "b_n_pairs": 1}
    assert {r.eval_set: r.score for r in M.report_line(combined, ["a", "c"]).collect()} == {"a": "0.5000", "c": "N/A"}
    alone = spark.createDataFrame([(0.125,)], "rougeL double")
    assert M.report_line(alone, ["x"]).first().score == "0.1250"
    assert M.combined_metrics(summary.limit(0)).count() == 0


def test_decoding(spark):
    df = spark.createDataFrame([([0, 2, 1, 9],), ([],), (None,)], "ids array<int>").withColumn("v", F.create_map(F.lit(1), F.lit("one"), F.lit(2), F.lit("two")))
    assert [r.t for r in df.select(M.decoded(F.col("ids"), F.col("v"), (0,)).alias("t")).collect()] == ["two one", "", None]


def test_scores_of_long_texts_are_linear(spark):
    text = " ".join(f"w{i % 50}" for i in range(60_000))
    df = spark.createDataFrame([(1, text, text), (2, text, ""), (3, None, "a b")], "k int, prediction string, reference string")
    assert {r.k: r.score for r in M.rouge_n(df, "k", 2).collect()} == {1: 1.0, 2: 0.0, 3: 0.0}


def test_number_of_a_bad_line(spark, tmp_path):
    path = tmp_path / "x.jsonl"
    lines = [json.dumps({"input_text": "y" * (k % 37)}) for k in range(500)]
    for bad in (0, 123, 499):
        path.write_text("\n".join([*lines[:bad], "{oops", *lines[bad:]]), encoding="utf-8")
        with pytest.raises(ValueError, match=f":{bad + 1}:"):
            readers.read_jsonl(spark, str(path))
        for size in (7, 100, 4096):
            assert readers.line_number(spark, str(path), "{oops", size) == bad + 1
    assert readers.line_number(spark, str(path), "absent") == 0


def test_masked_means(spark):
    df = spark.createDataFrame([("a", [1.0, 2.0], 1), ("a", [3.0, 4.0], 1), ("a", [9.0, 9.0], 0), ("b", [5.0, 5.0], 0)], "k string, v array<double>, m int")
    found = {(r.k, r.pos): r.x for r in V.masked_means(df, "k", "v", F.col("m")).collect()}
    assert found == {("a", 0): 2.0, ("a", 1): 3.0, ("b", 0): 0.0, ("b", 1): 0.0}
