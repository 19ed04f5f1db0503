"""Readers of papers, examples and optional sets.  No schema is inferred."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quireflow.functions.text import clean_field, strip

PAPER = T.StructType([T.StructField("article", T.StringType()), T.StructField("abstract", T.StringType())])
EXAMPLE = T.StructType(
    [
        *[T.StructField(n, T.StringType()) for n in ("input_text", "target_text", "paper_id", "split", "sample_type")],
        T.StructField("num_contexts", T.IntegerType()),
        T.StructField("noise_mode", T.StringType()),
        T.StructField("noise_source", T.StringType()),
        T.StructField("num_chunks", T.IntegerType()),
        T.StructField("num_documents", T.IntegerType()),
    ]
)


def _system(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def exists(path: str) -> bool:
    """Whether a file or directory is there, on any file system that is known by its URI."""
    system, name = _system(path)
    return system.get_file_info(name).type != pafs.FileType.NotFound


def arrow_shards(path: str) -> list[str]:
    """The Arrow files of a data set's directory, in order."""
    system, name = _system(path)
    found = system.get_file_info(pafs.FileSelector(name, recursive=False))
    prefix = path[: len(path) - len(name)] if path.endswith(name) else ""
    return sorted(prefix + f.path for f in found if f.path.endswith(".arrow"))


def read_arrow_papers(spark: SparkSession, directory: str, split: str | None = None) -> DataFrame:
    """Papers of a directory of Arrow stream or file shards; with `split`, of its sub-directory, which must be there.

    Each shard is one task and is read batch by batch.
    """
    if split is not None:
        directory = f"{directory}/{split}"
        if not exists(directory):
            raise FileNotFoundError(f"no split {split}: {directory}")
    shards = arrow_shards(directory)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard in batch.column(0).to_pylist():
                system, name = _system(shard)
                with system.open_input_file(name) as file:
                    magic = file.read(6)
                    file.seek(0)
                    reader = pa.ipc.open_file(file) if magic == b"ARROW1" else pa.ipc.open_stream(file)
                    parts = (reader.get_batch(i) for i in range(reader.num_record_batches)) if magic == b"ARROW1" else iter(reader)
                    for part in parts:
                        yield pa.RecordBatch.from_arrays([part.column(n).cast(pa.string()) for n in ("article", "abstract")], names=["article", "abstract"])

    paths = spark.createDataFrame([(s,) for s in shards], "path string").repartition(max(1, len(shards)))
    return cleaned_papers(paths.mapInArrow(read, PAPER))


def read_parquet_papers(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    """Papers of Parquet files; with `split`, only its rows, which prunes partitions."""
    rows = spark.read.parquet(path)
    return cleaned_papers(rows if split is None else rows.where(F.col("split") == split))


def cleaned_papers(papers: DataFrame) -> DataFrame:
    """Papers whose cleaned article and abstract are both not empty."""
    fields = {c: clean_field(F.col(c)) for c in ("article", "abstract")}
    return papers.where(F.col("article").isNotNull() & F.col("abstract").isNotNull()).withColumns(fields).where("article <> '' and abstract <> ''")


def read_tsv_papers(spark: SparkSession, path: str) -> DataFrame:
    """Papers of lines with an article and an abstract between tabs.

    Lines are stripped first; further parts are ignored, and lines without two
    parts that aren't blank are dropped.
    """
    parts = F.split(strip(F.col("value")), "\t")
    rows = spark.read.text(path).select(parts.alias("p")).where(F.size("p") >= 2)
    return rows.select(strip(F.get("p", F.lit(0))).alias("article"), strip(F.get("p", F.lit(1))).alias("abstract")).where("article <> '' and abstract <> ''")


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType = EXAMPLE) -> DataFrame:
    """Rows of a JSON-lines file; blank lines are skipped and a bad line is an error that names file and line."""
    bad = first_bad_line(spark, path)
    if bad is not None:
        raise ValueError(f"{bad[0]}:{bad[1]}: not a JSON object")
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def first_bad_line(spark: SparkSession, path: str) -> tuple[str, int] | None:
    """File and number of the first line that isn't a JSON object, if there is one."""
    rows = spark.read.text(path, wholetext=False).select("value", F.col("_metadata.file_path").alias("file"))
    wrong = rows.where(strip(F.col("value")) != "").where(F.from_json("value", "map<string,string>").isNull())
    hit = wrong.select("file", "value").limit(1).collect()
    if not hit:
        return None
    return hit[0]["file"], line_number(spark, hit[0]["file"], hit[0]["value"])


def line_number(spark: SparkSession, file: str, line: str, range_bytes: int = 64 << 20) -> int:
    """The number from 1 of the first line of a file that reads so, 0 if none does; workers read ranges of bytes."""
    system, name = _system(file)
    size = system.get_file_info(name).size
    ranges = spark.range(0, max(size, 1), range_bytes).repartition(max(1, min(1000, -(-size // range_bytes))))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for low in batch.column(0).to_pylist():
                system, name = _system(file)
                with system.open_input_file(name) as source:
                    data = source.read_at(min(range_bytes, size - low), low)
                    # the line that begins here may end beyond
                    while low + len(data) < size and not data.endswith(b"\n") and (more := source.read_at(min(1 << 20, size - low - len(data)), low + len(data))):
                        end = more.find(b"\n") + 1
                        data += more[:end] if end else more
                    before = source.read_at(1, low - 1) if low else b"\n"
                lines = data[: min(len(data), range_bytes)].count(b"\n")
                begun = data if before == b"\n" else data[data.find(b"\n") + 1 :] if b"\n" in data else b""
                skipped = data[: len(data) - len(begun)].count(b"\n")
                found = next((k for k, x in enumerate(begun.split(b"\n")) if x.decode("utf-8", "replace").rstrip("\r") == line), None)
                rows.append((low, lines, None if found is None else skipped + found))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(3)], names=["low", "lines", "found"])

    rows = ranges.mapInArrow(look, "low long, lines long, found long")
    hit = rows.where("found is not null").orderBy("low").limit(1).collect()
    if not hit:
        return 0
    return (rows.where(F.col("low") < hit[0]["low"]).agg(F.sum("lines")).first()[0] or 0) + hit[0]["found"] + 1


def missing_fields(lines: DataFrame, required: tuple[str, ...] = ("input_text", "target_text")) -> DataFrame:
    """Lines (value) of JSON objects without all required keys, with the missing ones; a null value is there."""
    parsed = lines.withColumn("__m", F.from_json("value", "map<string,string>"))
    names = [F.when(~F.map_contains_key("__m", F.lit(n)), F.lit(n)) for n in required]
    return parsed.withColumn("missing", F.concat_ws(", ", *names)).where("missing <> ''").drop("__m")


def ensure_required_fields(spark: SparkSession, path: str, required: tuple[str, ...] = ("input_text", "target_text")) -> None:
    """An error that names the missing fields of the file's first line that lacks any."""
    hit = missing_fields(spark.read.text(path).where(strip(F.col("value")) != ""), required).limit(1).collect()
    if hit:
        raise ValueError(f"{path}: missing {hit[0]['missing']}")


def read_example_sets(spark: SparkSession, train: str, valid: str, optional: dict[str, str | None] | None = None) -> dict[str, DataFrame]:
    """Examples by set name; train and valid must be there, optional sets only if their path is given and exists."""
    paths = {"train": train, "valid": valid} | {k: v for k, v in (optional or {}).items() if v and exists(v)}
    for path in paths.values():
        ensure_required_fields(spark, path)
    return {name: read_jsonl(spark, path) for name, path in paths.items()}


def from_rows(spark: SparkSession, rows: list[dict], schema: T.StructType = EXAMPLE) -> DataFrame:
    """A frame of dictionaries by an explicit schema; absent keys are null."""
    return spark.createDataFrame([tuple(r.get(f.name) for f in schema.fields) for r in rows], schema)
