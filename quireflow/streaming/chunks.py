"""Chunking of a stream of papers.

Chunking works within a row, so the batch operators run on a stream unchanged
and keep no state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from quireflow.config import ChunkConfig
from quireflow.operators.chunking import chunk_documents
from quireflow.sources.readers import cleaned_papers


def stream_chunks(spark: SparkSession, path: str, schema: T.StructType, config: ChunkConfig = ChunkConfig()) -> DataFrame:
    """Chunks of the papers in files that arrive in a directory; the schema has paper_id, article and abstract."""
    papers = spark.readStream.schema(schema).parquet(path)
    return chunk_documents(cleaned_papers(papers), "paper_id", "article", config)


def write_chunks(chunks: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append chunks to Parquet files, each input row exactly once; runs until what is there is done."""
    return chunks.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start(path)
