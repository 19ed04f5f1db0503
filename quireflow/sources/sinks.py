"""Writers of examples and metrics."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame

from quireflow.sources.readers import _system

# The names of the output sets.
OUTPUT_SETS = ("train", "valid", "test_clean", "test_noisy_easy", "test_noisy_hard")


def write_jsonl(df: DataFrame, path: str, files: int | None = None) -> None:
    """JSON lines in a directory, UTF-8, null fields left out; `files` limits their number."""
    (df if files is None else df.coalesce(files)).write.mode("overwrite").json(path)


def write_output_sets(examples: DataFrame, path: str) -> None:
    """Examples with a column output_set, one sub-directory a set, written in one pass."""
    examples.write.mode("overwrite").partitionBy("output_set").json(path)


def write_arrow_shards(df: DataFrame, directory: str) -> int:
    """Arrow stream shards in a directory, one for each task that has rows; returns their number."""
    schema = df.schema

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, name = _system(f"{directory.rstrip('/')}/data-{uuid.uuid4()}.arrow")
        out = writer = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if writer is None:
                system.create_dir(name.rsplit("/", 1)[0], recursive=True)
                out = system.open_output_stream(name)
                writer = pa.ipc.new_stream(out, batch.schema)
            writer.write_batch(batch)
        if writer is not None:
            writer.close()
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([name])], names=["shard"])

    return len(df.select(*schema.names).mapInArrow(write, "shard string").collect())  # one row a task


def write_metrics(metrics: DataFrame, directory: str, name: str) -> str:
    """A frame of one row as indented JSON; returns the file."""
    rows = metrics.limit(2).collect()
    if len(rows) != 1:
        raise ValueError("metrics must be one row")
    path = f"{directory.rstrip('/')}/{name}.json"
    write_text(path, json.dumps(rows[0].asDict(), indent=2))
    return path


def write_text(path: str, text: str) -> None:
    """A small file on any file system that is known by its URI; its directory is made."""
    system, name = _system(path)
    if isinstance(system, pafs.LocalFileSystem) or "/" in name:
        system.create_dir(name.rsplit("/", 1)[0] or "/", recursive=True)
    with system.open_output_stream(name) as file:
        file.write(text.encode())
