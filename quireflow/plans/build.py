"""From papers to training examples in one plan."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quireflow.config import QUERY_TEMPLATES, ChunkConfig, NoiseConfig, PromptConfig, RetrievalConfig
from quireflow.functions import text as T
from quireflow.functions import vectors as V
from quireflow.operators import chunk_rows
from quireflow.operators import chunking as C
from quireflow.operators.noise import check_mode
from quireflow.plans import pipeline
from quireflow.session import stored


@dataclass(frozen=True)
class BuildOptions:
    """What a build can be told; a limit keeps the first papers of a split by their number."""

    train_limit: int | None = None
    valid_limit: int | None = None
    test_limit: int | None = None
    final_k: int = 3
    noise_k: int = 2
    min_chunks: int = 3
    single_query: bool = False
    shuffle: bool = True
    pool_limit: int = 500
    train_mode: str = "cross_doc_easy"
    seed: int = 42
    encode_batch: int = 64

    def __post_init__(self) -> None:
        check_mode(self.train_mode)
        if any(x is not None and x < 0 for x in (self.train_limit, self.valid_limit, self.test_limit, self.pool_limit)):
            raise ValueError("limits must not be negative")

    def settings(self, dimensions: int) -> pipeline.Settings:
        return pipeline.Settings(
            replace(ChunkConfig(), min_chunks=self.min_chunks),
            RetrievalConfig(self.final_k, self.noise_k, dimensions=dimensions),
            NoiseConfig(self.pool_limit, self.seed, shuffle=self.shuffle),
            PromptConfig(),
            self.single_query,
        )

    def limited(self, papers: DataFrame) -> DataFrame:
        """Papers (split, idx) within the limits; of train also those of the noise pool."""
        train = None if self.train_limit is None else max(self.train_limit, self.pool_limit)
        for split, n in {"train": train, "validation": self.valid_limit, "test": self.test_limit}.items():
            if n is not None:
                papers = papers.where((F.col("split") != split) | (F.col("idx") < n))
        return papers


def numbered_papers(papers: DataFrame, order: str) -> DataFrame:
    """(paper_id, split, idx, article, abstract) of valid papers (split, article, abstract), numbered in their split by a unique column."""
    rows = C.numbered(papers.select(order, "split", "article", "abstract"), "split", order, "idx")
    return rows.select(F.concat_ws("_", "split", F.col("idx").cast("string")).alias("paper_id"), "split", "idx", "article", "abstract")


def corpus_of(
    papers: DataFrame,
    make: Callable[[], V.Encoder],
    options: BuildOptions = BuildOptions(),
    templates: tuple[str, ...] = QUERY_TEMPLATES,
    splitter: Callable[[], chunk_rows.Splitter] | None = None,
) -> pipeline.Corpus:
    """Chunks, their unit vectors, texts, targets and encoded templates of papers (paper_id, split, idx, article, abstract).

    Papers are cut and encoded once and written as Parquet to the shared
    folder, from which later steps take ids, vectors or texts alone.
    """
    encode = V.encoding(make, options.encode_batch)
    cut = C.chunk_documents(papers.select("paper_id", "split", "idx", "article"), "paper_id", "article", make=splitter)
    chunks = cut.select("paper_id", "split", "idx", T.chunk_gid(F.col("paper_id"), F.col("chunk_id")).alias("chunk_gid"), "section", "text")
    held = stored(chunks.withColumn("vec", encode(F.col("text")).cast("array<double>")))
    asked = papers.sparkSession.createDataFrame(list(enumerate(templates)), "query int, text string")
    targets = papers.select("paper_id", "abstract")
    return pipeline.Corpus(
        held.select("paper_id", "split", "idx", "chunk_gid", "vec"), held.select("chunk_gid", "section", "text"), targets, asked.withColumn("qvec", encode(F.col("text")).cast("array<double>"))
    )


def examples_from_papers(papers: DataFrame, make: Callable[[], V.Encoder], dimensions: int, options: BuildOptions = BuildOptions(), splitter: Callable[[], chunk_rows.Splitter] | None = None) -> DataFrame:
    """Examples of all output sets (output_set and the fields of an example) of papers (paper_id, split, idx, article, abstract).

    The pool of noise is taken from the first train papers whether or not the
    train split itself is limited.
    """
    corpus = corpus_of(options.limited(papers), make, options, splitter=splitter)
    made = pipeline.output_sets(corpus, options.settings(dimensions), options.train_mode)
    if options.train_limit is None:
        return made
    return made.where((F.col("output_set") != "train") | (T.id_suffix(F.col("paper_id")) < options.train_limit))


def build_report(examples: DataFrame) -> DataFrame:
    """(line, n, rate): examples by set and kind, and the rates of noisy test examples as n/m (p%)."""
    kinds = examples.groupBy("output_set", "sample_type").agg(F.count(F.lit(1)).alias("n"))
    tested = examples.where(F.col("split") == "test").agg(
        *[F.count_if(F.col("output_set") == s).alias(s) for s in ("test_clean", "test_noisy_easy", "test_noisy_hard")]
    )
    rates = tested.select(F.explode(F.array(*[F.struct(F.lit(s).alias("s"), F.col(s).alias("n"), F.col("test_clean").alias("m")) for s in ("test_noisy_easy", "test_noisy_hard")])).alias("r"))
    lines = kinds.select(F.concat_ws(" ", "output_set", "sample_type").alias("line"), "n", F.lit(None).cast("string").alias("rate"))
    text = F.format_string("%d/%d (%.1f%%)", F.col("r.n"), F.col("r.m"), T.pair_rate(F.col("r.n"), F.col("r.m")))
    return lines.unionByName(rates.select(F.concat(F.lit("rate "), F.col("r.s")).alias("line"), F.col("r.n").alias("n"), text.alias("rate")))
