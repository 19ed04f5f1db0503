"""Command line: build example sets from papers, and score predictions.

    python -m quireflow.cli build --papers DIR --format parquet --out DIR --encoder module:factory --dimensions 384
    python -m quireflow.cli score --pairs FILE --out DIR --name run1
"""

from __future__ import annotations

import argparse
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quireflow.config import NOISE_MODES
from quireflow.functions.vectors import hashing_encoder
from quireflow.operators import metrics as M
from quireflow.plans.build import BuildOptions, build_report, examples_from_papers, numbered_papers
from quireflow.sources import readers, sinks
from quireflow.sources.models import factory, load_model

SPLITS = ("train", "validation", "test")
FORMATS = ("arrow", "parquet", "tsv")


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="quireflow")
    commands = top.add_subparsers(dest="command", required=True)
    build = commands.add_parser("build", help="papers to example sets as JSON lines")
    build.add_argument("--papers", required=True, help="a directory with one sub-directory or file for each split")
    build.add_argument("--format", choices=FORMATS, default="arrow")
    build.add_argument("--out", required=True)
    build.add_argument("--encoder", help="a saved model's directory or module:factory, which returns a function from texts to a matrix. Without it words are hashed")
    build.add_argument("--dimensions", type=int, default=64)
    for name in ("train", "valid", "test"):
        build.add_argument(f"--{name}-limit", type=int)
    build.add_argument("--final-k", type=int, default=3)
    build.add_argument("--noise-k", type=int, default=2)
    build.add_argument("--min-chunks", type=int, default=3)
    build.add_argument("--pool-limit", type=int, default=500)
    build.add_argument("--train-mode", choices=NOISE_MODES, default="cross_doc_easy")
    build.add_argument("--single-query", action="store_true")
    build.add_argument("--no-shuffle", action="store_true")
    build.add_argument("--seed", type=int, default=42)
    build.add_argument("--encode-batch", type=int, default=64)
    score = commands.add_parser("score", help="scores of predictions by evaluation set")
    score.add_argument("--pairs", required=True, help="JSON lines of eval_set, prediction and reference")
    score.add_argument("--out", required=True)
    score.add_argument("--name", default="metrics")
    score.add_argument("--stem", action="store_true")
    return top


def read_papers(spark: SparkSession, directory: str, kind: str) -> DataFrame:
    """Numbered papers of all splits."""
    parts = []
    for split in SPLITS:
        if kind == "arrow":
            rows = readers.read_arrow_papers(spark, directory, split)
        elif kind == "tsv":
            rows = readers.read_tsv_papers(spark, f"{directory.rstrip('/')}/{split}.tsv")
        else:
            rows = readers.read_parquet_papers(spark, directory, split)
        parts.append(rows.select(F.lit(split).alias("split"), "article", "abstract"))
    every = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return numbered_papers(every.withColumn("__order", F.monotonically_increasing_id()), "__order")


def build(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    options = BuildOptions(
        args.train_limit, args.valid_limit, args.test_limit, args.final_k, args.noise_k, args.min_chunks, args.single_query, not args.no_shuffle, args.pool_limit, args.train_mode, args.seed, args.encode_batch
    )
    make = partial(hashing_encoder, args.dimensions)
    if args.encoder:
        make = load_model(args.encoder) if readers.exists(f"{args.encoder.rstrip('/')}/model.json") else factory(args.encoder)
    sinks.write_output_sets(examples_from_papers(read_papers(spark, args.papers, args.format), make, args.dimensions, options), args.out)
    written = spark.read.schema(T.StructType([*readers.EXAMPLE.fields, T.StructField("output_set", T.StringType())])).json(args.out)
    return build_report(written).orderBy("line")


def score(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    pairs = readers.read_jsonl(spark, args.pairs, T.StructType([T.StructField(n, T.StringType()) for n in ("eval_set", "prediction", "reference")]))
    scores = M.rouge_scores(pairs, ["eval_set"], prepare=M.stemmed_tokens if args.stem else M.tokens)
    combined = M.combined_metrics(M.metrics_summary(scores, ["rouge1", "rouge2", "rougeL", "rougeLsum"]))
    sinks.write_metrics(combined, args.out, args.name)
    return combined


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    {"build": build, "score": score}[args.command](spark, args).show(100, truncate=False)


if __name__ == "__main__":
    main()
