"""The pipeline from chunks and vectors to training examples.

Inputs are frames: chunks (paper_id, split, idx, chunk_gid, vec) with unit
vectors, texts (chunk_gid, section, text), targets (paper_id, abstract) and
templates (query, text, qvec), of which there are a handful.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quireflow.config import ChunkConfig, NoiseConfig, PromptConfig, RetrievalConfig
from quireflow.functions import text as T
from quireflow.functions.vectors import dot_products
from quireflow.operators import noise as N
from quireflow.operators import prompts as P
from quireflow.operators import retrieval as R
from quireflow.session import checkpointed, few, stored


MOST_TEMPLATES = 1000  # templates of queries, which are broadcast


@dataclass(frozen=True)
class Corpus:
    """The input frames; `chunks` may hold several splits."""

    chunks: DataFrame
    texts: DataFrame
    targets: DataFrame
    templates: DataFrame


@dataclass(frozen=True)
class Settings:
    chunk: ChunkConfig = ChunkConfig()
    retrieval: RetrievalConfig = RetrievalConfig()
    noise: NoiseConfig = NoiseConfig()
    prompt: PromptConfig = PromptConfig()
    single_query: bool = False


def documents(corpus: Corpus) -> DataFrame:
    """Chunks whose text isn't blank; texts themselves are joined at the end, for the few contexts of a prompt."""
    full = corpus.texts.where(T.safe_strip(F.col("text")) != "").select("chunk_gid")
    return corpus.chunks.join(full, "chunk_gid", "left_semi")


def papers(docs: DataFrame, chunks: DataFrame, settings: Settings, min_chunks: int) -> DataFrame:
    """(paper_id, split, query, num_chunks, num_documents) of the papers that are used."""
    counts = chunks.groupBy("paper_id").agg(F.first("split").alias("split"), F.count(F.lit(1)).alias("num_chunks")).where(F.col("num_chunks") >= min_chunks)
    full = docs.groupBy("paper_id").agg(F.count(F.lit(1)).alias("num_documents"))
    query = T.query_index(F.col("paper_id"), not settings.single_query)
    return counts.join(full, "paper_id").withColumn("query", query)


def similarities(pool: DataFrame, templates: DataFrame, size: int) -> DataFrame:
    """(query, paper_id, chunk_gid, sim) of each template against the pool."""
    pairs = pool.select("paper_id", "chunk_gid", "vec").crossJoin(few(templates.select("query", "qvec"), MOST_TEMPLATES))
    return pairs.select("query", "paper_id", "chunk_gid", dot_products(size)(F.col("vec"), F.col("qvec")).alias("sim"))


def _examples(contexts: DataFrame, used: DataFrame, corpus: Corpus, settings: Settings, kind: str, mode: str | None) -> DataFrame:
    """Examples of contexts (paper_id, pos, chunk_gid, is_noise, noise_source)."""
    texts = corpus.texts.select("chunk_gid", "text")
    lists = contexts.join(texts, "chunk_gid").groupBy("paper_id").agg(
        F.array_sort(F.collect_list(F.struct("pos", "text", "is_noise"))).alias("c"), F.min("noise_source").alias("noise_source")
    )
    rows = lists.join(used, "paper_id").join(corpus.targets, "paper_id").join(few(corpus.templates.select("query", F.col("text").alias("question")), MOST_TEMPLATES), "query")
    most = settings.prompt.max_contexts
    prompt = P.rag_input(F.col("question"), P.format_contexts(F.col("c.text"), settings.prompt, most), settings.prompt)
    return rows.select(
        prompt.alias("input_text"),
        T.safe_strip(F.col("abstract")).alias("target_text"),
        "paper_id",
        "split",
        F.lit(kind).alias("sample_type"),
        F.size("c").alias("num_contexts"),
        F.lit(mode).cast("string").alias("noise_mode"),
        "noise_source",
        F.col("num_chunks").cast("int").alias("num_chunks"),
        F.col("num_documents").cast("int").alias("num_documents"),
        F.size(F.filter(F.slice("c", 1, most), lambda x: x["is_noise"])).alias("n_noise_used"),
    ).where("input_text is not null and target_text <> ''")


def clean_picks(docs: DataFrame, used: DataFrame, corpus: Corpus, config: RetrievalConfig) -> DataFrame:
    """(paper_id, chunk_gid, score, rank) for each paper's template."""
    asked = docs.join(used.select("paper_id", "query"), "paper_id").join(few(corpus.templates.select("query", "qvec"), MOST_TEMPLATES), "query")
    return R.clean_retrieval(asked.select("paper_id", "chunk_gid", "vec", "qvec"), "qvec", config)


def build_split(corpus: Corpus, split: str, modes: tuple[str, ...], settings: Settings = Settings()) -> DataFrame:
    """Clean examples of a split and, for each mode, noisy ones of papers that got noise.

    The least number of chunks holds for all splits but test; without modes
    no room is left for noise.  Picks are found once for all modes.
    """
    for mode in modes:
        N.check_mode(mode)
    own = Corpus(corpus.chunks.where(F.col("split") == split), corpus.texts, corpus.targets, corpus.templates)
    # each is read several times below; cut here, the plans stay small
    docs = stored(documents(own))
    used = checkpointed(papers(docs, own.chunks, settings, 1 if split == "test" else settings.chunk.min_chunks))
    config = settings.retrieval if modes else RetrievalConfig(settings.retrieval.final_k, 0, settings.retrieval.mmr_lambda, settings.retrieval.dimensions)
    picks = clean_picks(docs, used, corpus, config)
    if modes:
        picks = checkpointed(picks)
    clean = picks.select("paper_id", F.col("rank").alias("pos"), "chunk_gid", F.lit(False).alias("is_noise"), F.lit(None).cast("string").alias("noise_source"))
    out = _examples(clean, used, corpus, settings, "clean", None)
    if not modes:
        return out
    pool = pool_of(corpus, settings)
    sims = checkpointed(similarities(pool, corpus.templates, settings.retrieval.dimensions))
    for mode in modes:
        drawn = checkpointed(N.draw_noise(sims, used.select("paper_id", "query"), mode, settings.retrieval.noise_k, settings.noise))
        mixed = N.noisy_contexts(picks, drawn, mode, settings.noise)
        out = out.unionByName(_examples(mixed, used, corpus, settings, "noisy", mode))
    return out


def pool_of(corpus: Corpus, settings: Settings = Settings()) -> DataFrame:
    """The noise pool: documents of the first train papers, taken from the same chunks as training."""
    train = documents(corpus).where("split = 'train'")
    first = train.select("paper_id", "idx").distinct()
    return N.noise_pool(train, first, settings.noise.pool_limit, settings.chunk.min_chunks)


def output_sets(corpus: Corpus, settings: Settings = Settings(), train_mode: str = "cross_doc_easy") -> DataFrame:
    """All examples with output_set: train, valid, test_clean, test_noisy_easy or test_noisy_hard."""
    train = build_split(corpus, "train", (train_mode,), settings).withColumn("output_set", F.lit("train"))
    valid = build_split(corpus, "validation", (), settings).withColumn("output_set", F.lit("valid"))
    name = F.when(F.col("noise_mode") == "cross_doc_easy", "test_noisy_easy").when(F.col("noise_mode") == "cross_doc_hard", "test_noisy_hard").otherwise("test_clean")
    test = build_split(corpus, "test", ("cross_doc_easy", "cross_doc_hard"), settings).withColumn("output_set", name)
    return train.unionByName(valid).unionByName(test)


def clean_where_no_noise(clean: DataFrame, noisy: DataFrame, papers: DataFrame) -> DataFrame:
    """(paper_id, pos, chunk_gid, is_noise, noise_source, has_true_noise) of every paper: noisy contexts, or the clean ones where no noise was drawn.

    So a split whose pool is empty still has a bundle for each paper, with the source none.
    """
    drawn = noisy.select("paper_id").distinct()
    plain = clean.join(drawn, "paper_id", "left_anti").select("paper_id", F.col("rank").alias("pos"), "chunk_gid", F.lit(False).alias("is_noise"), F.lit("none").alias("noise_source"))
    rows = noisy.withColumn("has_true_noise", F.lit(True)).unionByName(plain.withColumn("has_true_noise", F.lit(False)))
    return rows.join(papers.select("paper_id"), "paper_id", "left_semi")


def sample_type_counts(examples: DataFrame) -> DataFrame:
    return examples.groupBy("sample_type").agg(F.count(F.lit(1)).alias("n"))


def pair_rates(examples: DataFrame) -> DataFrame:
    """(split, n_clean, n_noisy, rate): noisy examples in percent of the clean ones."""
    counts = examples.groupBy("split").agg(F.count_if(_is("clean")).alias("n_clean"), F.count_if(_is("noisy")).alias("n_noisy"))
    return counts.withColumn("rate", T.pair_rate(F.col("n_noisy"), F.col("n_clean")))


def _is(kind: str) -> Column:
    return F.col("sample_type") == kind


def summary(examples: DataFrame) -> DataFrame:
    """One row for each output set: examples, papers and mean number of contexts."""
    return examples.groupBy("output_set").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("paper_id").alias("n_papers"), F.avg("num_contexts").alias("mean_contexts"))


