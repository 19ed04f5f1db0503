from __future__ import annotations

import json

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quireflow.sources import readers, sinks
from quireflow.streaming.chunks import stream_chunks, write_chunks


def test_tsv(spark, tmp_path):
    (tmp_path / "p.txt").write_text(' a "x\t b \tc\nonly\n\tq\tr\n \t \n', encoding="utf-8")
    assert [tuple(r) for r in readers.read_tsv_papers(spark, str(tmp_path / "p.txt")).collect()] == [('a "x', "b"), ("q", "r")]


@pytest.mark.parametrize("kind", ["stream", "file"])
def test_arrow_shards(spark, tmp_path, kind):
    (tmp_path / "train").mkdir()
    table = pa.table({"article": ["a/nb", " ", None, "c"], "abstract": ["x", "y", "z", "w"]})
    for shard in ("data-0.arrow", "data-1.arrow"):
        with pa.OSFile(str(tmp_path / "train" / shard), "wb") as out, getattr(pa.ipc, f"new_{kind}")(out, table.schema) as writer:
            writer.write_table(table)
    for split, directory in (("train", tmp_path), (None, tmp_path / "train")):
        rows = readers.read_arrow_papers(spark, str(directory), split).collect()
        assert sorted(tuple(r) for r in rows) == [("a\nb", "x")] * 2 + [("c", "w")] * 2


def test_parquet_split(spark, tmp_path):
    spark.createDataFrame([("a", "b", "train"), ("c", "d", "test")], "article string, abstract string, split string").write.partitionBy("split").parquet(str(tmp_path / "p"))
    assert [r.article for r in readers.read_parquet_papers(spark, str(tmp_path / "p"), "test").collect()] == ["c"]


def test_jsonl(spark, tmp_path):
    good = tmp_path / "good.jsonl"
    good.write_text(json.dumps({"input_text": "é", "target_text": None}, ensure_ascii=False) + "\n\n", encoding="utf-8")
    assert [r.input_text for r in readers.read_jsonl(spark, str(good)).collect()] == ["é"]
    readers.ensure_required_fields(spark, str(good))
    bad = tmp_path / "bad.jsonl"
    bad.write_text('{"input_text": "a"}\nnot json\n', encoding="utf-8")
    with pytest.raises(ValueError, match="bad.jsonl:2"):
        readers.read_jsonl(spark, str(bad))
    bad.write_text('{"input_text": "a"}\n', encoding="utf-8")
    with pytest.raises(ValueError, match="target_text"):
        readers.ensure_required_fields(spark, str(bad))
    sets = readers.read_example_sets(spark, str(good), str(good), {"test_clean": str(tmp_path / "none"), "test_noisy": None})
    assert set(sets) == {"train", "valid"}


def test_rows_and_sinks(spark, tmp_path):
    df = readers.from_rows(spark, [{"input_text": "ü", "target_text": "t"}, {"input_text": "v", "num_chunks": 3}])
    sinks.write_jsonl(df, str(tmp_path / "out"), files=1)
    lines = "".join(p.read_text(encoding="utf-8") for p in (tmp_path / "out").glob("part*"))
    assert lines == '{"input_text":"ü","target_text":"t"}\n{"input_text":"v","num_chunks":3}\n'
    sinks.write_output_sets(df.withColumn("output_set", F.lit("train")), str(tmp_path / "sets"))
    assert [p.name for p in (tmp_path / "sets").glob("output_set=*")] == ["output_set=train"]
    path = sinks.write_metrics(spark.createDataFrame([(0.5,)], "rougeL double"), str(tmp_path / "m"), "valid")
    assert json.load(open(path)) == {"rougeL": 0.5}
    with pytest.raises(ValueError):
        sinks.write_metrics(df, str(tmp_path), "x")


def test_stream(spark, tmp_path):
    schema = T.StructType([T.StructField(n, T.StringType()) for n in ("paper_id", "article", "abstract")])
    text = "Word " * 20
    spark.createDataFrame([("a", text, "x"), ("b", "", "y")], schema).write.parquet(str(tmp_path / "in"))
    query = write_chunks(stream_chunks(spark, str(tmp_path / "in"), schema), str(tmp_path / "out"), str(tmp_path / "state"))
    query.awaitTermination(120)
    assert [(r.paper_id, r.word_count) for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [("a", 20)]
