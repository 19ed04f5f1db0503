"""Queries of the library's own operators over the test tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from quireflow.config import QUERY_TEMPLATES, NoiseConfig, PromptConfig
from quireflow.functions import text as T
from quireflow.functions import vectors as V
from quireflow.operators import chunk_rows
from quireflow.operators import chunking as C
from quireflow.operators import metrics as M
from quireflow.operators import noise as N
from quireflow.operators import prompts as P
from quireflow.operators import retrieval as R
from quireflow.plans import build as B
from quireflow.plans import pipeline as plan
from quireflow.session import checkpointed, ensure_checkpoint_dir, table
from quireflow.sources import readers, sinks
from quireflow.sources.readers import cleaned_papers

Query = Callable[[SparkSession, str], DataFrame]
SIZE = 96


def _papers(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "dataset_info")


def _valid(spark: SparkSession, folder: str) -> DataFrame:
    return cleaned_papers(_papers(spark, folder).select("row_id", "paper_id", "split", "article", "abstract"))


def _lines(spark: SparkSession, folder: str) -> DataFrame:
    """(row_id, pos, line) of every article line that isn't blank, normalised."""
    rows = _papers(spark, folder).select("row_id", F.posexplode(T.lines(T.clean_field(F.col("article")))).alias("pos", "line"))
    return rows.withColumn("line", T.normalize_space(F.col("line"))).where("line <> ''")


# --- text


def clean_field(spark: SparkSession, folder: str) -> DataFrame:
    return _papers(spark, folder).select("row_id", T.clean_field(F.col("article")).alias("article"), T.clean_field(F.col("abstract")).alias("abstract"))


def valid_papers(spark: SparkSession, folder: str) -> DataFrame:
    return _valid(spark, folder).select("row_id", "split")


def normalize_space(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", T.normalize_space(F.col("text")).alias("text"))


def safe_strip(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "retrieval_tokenizer").select("id", T.safe_strip(F.col("text")).alias("text"))


def word_count(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", T.word_count(F.col("text")).alias("n_words"))


def token_estimate(spark: SparkSession, folder: str) -> DataFrame:
    return _papers(spark, folder).select("row_id", F.coalesce(T.token_estimate_exceeds(F.col("article"), PromptConfig.max_input_length), F.lit(False)).alias("truncated"))


def line_split(spark: SparkSession, folder: str) -> DataFrame:
    return _lines(spark, folder)


def heading_flag(spark: SparkSession, folder: str) -> DataFrame:
    return _lines(spark, folder).select("row_id", "pos", T.looks_like_heading(F.col("line")).alias("is_heading"))


def heading_title(spark: SparkSession, folder: str) -> DataFrame:
    return _lines(spark, folder).where(T.looks_like_heading(F.col("line"))).select("row_id", "pos", T.clean_heading(F.col("line")).alias("title"))


def sentence_split(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "rulebase_chunkforpdf").select("row_id", F.posexplode(T.split_sentences(F.col("text"))).alias("pos", "sentence"))
    return rows


def choose_query(spark: SparkSession, folder: str) -> DataFrame:
    return _papers(spark, folder).select("row_id", "paper_id", T.choose_query(F.col("paper_id")).alias("query"))


def chunk_gid(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "rulebase_chunkforpdf").select("row_id", T.chunk_gid(F.col("source_doc_id"), F.col("chunk_id")).alias("gid"))


def id_suffix(spark: SparkSession, folder: str) -> DataFrame:
    return _papers(spark, folder).select("row_id", T.id_suffix(F.col("paper_id")).alias("suffix"))


def section_header_prefix(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "rulebase_chunkforpdf").select("row_id", T.with_section_header(F.col("section"), F.col("text")).alias("text"))


# --- sections and chunks


def sections(spark: SparkSession, folder: str) -> DataFrame:
    return chunk_rows.section_rows(_valid(spark, folder), "row_id", "article")


def section_fallback(spark: SparkSession, folder: str) -> DataFrame:
    """The papers without a section long enough, whose whole text is one."""
    rows = _valid(spark, folder).where(F.size(C.sections(F.col("article"))) == 0)
    return rows.select("row_id", F.explode(C.sections_or_body(F.col("article"))).alias("s")).select("row_id", "s.section", "s.content")


def chunks(spark: SparkSession, folder: str) -> DataFrame:
    return C.chunk_documents(_valid(spark, folder).select("row_id", "article"), "row_id")


def chunk_overlap(spark: SparkSession, folder: str) -> DataFrame:
    """Words of each section's windows: their sum less the section's words is what overlaps."""
    made = chunks(spark, folder)
    return made.groupBy("row_id", "section_index").agg(F.count(F.lit(1)).alias("n_chunks"), F.sum("word_count").alias("n_words"), F.max("word_count").alias("longest"))


def document_counts(spark: SparkSession, folder: str) -> DataFrame:
    return chunk_rows.document_counts(_valid(spark, folder), "row_id", "article")


def document_counts_sql(spark: SparkSession, folder: str) -> DataFrame:
    """The same by expressions alone."""
    return C.process_documents(_valid(spark, folder), "row_id").select("row_id", "num_sections", "num_chunks")


def min_chunks_filter(spark: SparkSession, folder: str) -> DataFrame:
    return C.with_min_chunks(chunks(spark, folder).select("row_id", "chunk_id"), "row_id").select("row_id", "chunk_id", "num_chunks")


def paper_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Papers numbered within their split in row order."""
    rows = C.numbered(_valid(spark, folder).select("row_id", "split"), "split", "row_id", "idx")
    return rows.select("row_id", F.concat_ws("_", "split", F.col("idx").cast("string")).alias("made_id"))


def make_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks as documents: id and text, blank texts dropped."""
    rows = table(spark, folder, "rulebase_chunkforpdf").where(T.safe_strip(F.col("text")) != "")
    return rows.select("row_id", T.chunk_gid(F.col("source_doc_id"), F.col("chunk_id")).alias("id"), "text")


def rejected_papers(spark: SparkSession, folder: str) -> DataFrame:
    return C.rejected_papers(_papers(spark, folder), "row_id").select("row_id", "stage", "reason")


# --- vectors


def _vectors(spark: SparkSession, folder: str) -> DataFrame:
    """(vec_id, paper_id, split, chunk_gid, vec): unit vectors, the first of each chunk."""
    rows = table(spark, folder, "databuildt").where(V.usable(F.col("embeddings"), SIZE))
    first = rows.groupBy("chunk_gid").agg(F.min_by(F.struct("vec_id", "paper_id", "split", "embeddings"), "vec_id").alias("r"))
    return first.select("r.vec_id", "r.paper_id", "r.split", "chunk_gid", V.unit_vectors(SIZE)(F.col("r.embeddings")).alias("vec"))


def _templates(spark: SparkSession, folder: str) -> DataFrame:
    """(query, text, qvec): the first vectors, reversed, stand for the encoded templates."""
    return _template_rows(_vectors(spark, folder))


def _template_rows(vectors: DataFrame) -> DataFrame:
    first = vectors.orderBy("vec_id").limit(len(QUERY_TEMPLATES))
    places = first.select(F.explode(F.transform(F.array_sort(F.collect_list(F.struct("vec_id", "vec"))), lambda x, i: F.struct(i.alias("query"), F.reverse(x["vec"]).alias("qvec")))).alias("t"))
    return places.select("t.query", F.get(F.array(*[F.lit(t) for t in QUERY_TEMPLATES]), F.col("t.query")).alias("text"), "t.qvec")


def _corpus(spark: SparkSession, folder: str) -> plan.Corpus:
    vectors = checkpointed(_vectors(spark, folder))
    chunk = vectors.select("paper_id", "split", T.id_suffix(F.col("paper_id")).alias("idx"), "chunk_gid", "vec")
    # of a document that is there repeatedly one row counts, the least text with its own section
    pool = table(spark, folder, "retrieval_tokenizer").where("text is not null").groupBy(F.col("id").alias("chunk_gid")).agg(F.min(F.struct("text", "metadata.section")).alias("r"))
    texts = pool.select("chunk_gid", "r.section", "r.text")
    targets = _valid(spark, folder).groupBy("paper_id").agg(F.min_by("abstract", "row_id").alias("abstract"))
    return plan.Corpus(chunk, texts, targets, checkpointed(_template_rows(vectors)))


def l2_normalize(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "databuildt").where(V.usable(F.col("embeddings"), SIZE))
    return rows.select("vec_id", F.posexplode(V.l2_normalize(V.doubles(F.col("embeddings")))).alias("pos", "x")).select("vec_id", "pos", F.round("x", 6).alias("x"))


def all_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Every vector's score against every template."""
    pairs = _vectors(spark, folder).select("vec_id", "vec").crossJoin(F.broadcast(_templates(spark, folder).select("query", "qvec")))
    return pairs.select("vec_id", "query", F.round(V.dot_products(SIZE)(F.col("vec"), F.col("qvec")), 6).alias("score"))


def masked_mean_pool(spark: SparkSession, folder: str) -> DataFrame:
    """Each split's mean of its vectors of the right length, those with NaN or only zeros being masked."""
    rows = table(spark, folder, "databuildt").where(F.size("embeddings") == SIZE).withColumn("v", F.transform("embeddings", lambda x: F.coalesce(x, F.lit(0.0).cast("float"))))
    means = V.masked_means(rows, "split", "v", V.usable(F.col("embeddings"), SIZE).cast("int"))
    return means.withColumn("x", F.round("x", 6))


def hashing_encode(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "heldout_examples").select("item_id", F.posexplode(V.hashing_vector(F.col("target_text"))).alias("pos", "x"))
    return rows.select("item_id", "pos", F.round("x", 6).alias("x"))


# --- retrieval


def _asked(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks with their paper's query vector."""
    rows = _vectors(spark, folder).withColumn("query", T.query_index(F.col("paper_id")))
    return rows.join(F.broadcast(_templates(spark, folder).select("query", "qvec")), "query")


def candidate_k_rule(spark: SparkSession, folder: str) -> DataFrame:
    counts = _vectors(spark, folder).groupBy("paper_id").agg(F.count(F.lit(1)).alias("n"))
    kept = counts.withColumn("k", R.effective_k(F.col("n")))
    return kept.withColumn("candidates", R.candidate_k(F.col("n"), F.col("k")))


def _candidates(spark: SparkSession, folder: str) -> DataFrame:
    return R.ranked(R.scored(_asked(spark, folder), "qvec", SIZE), "paper_id", 50)


def topk_candidates(spark: SparkSession, folder: str) -> DataFrame:
    return _candidates(spark, folder).select("paper_id", "chunk_gid", "rank", F.round("score", 6).alias("score"))


def pairwise_sim(spark: SparkSession, folder: str) -> DataFrame:
    return R.pairwise(_candidates(spark, folder), "paper_id", SIZE).withColumn("similarity", F.round("similarity", 6))


def mmr_select(spark: SparkSession, folder: str) -> DataFrame:
    """What is retrieved for each paper by its own query."""
    return R.clean_retrieval(_asked(spark, folder), "qvec").withColumn("score", F.round("score", 6))


def _questions(spark: SparkSession, folder: str) -> DataFrame:
    return _templates(spark, folder).select(F.col("query").alias("query_id"), "qvec")


def mmr_search(spark: SparkSession, folder: str) -> DataFrame:
    """Three picks for each template over all chunks."""
    return R.search(_questions(spark, folder), _vectors(spark, folder), 3, SIZE).withColumn("score", F.round("score", 6))


def negatives_random(spark: SparkSession, folder: str) -> DataFrame:
    found = R.search(_questions(spark, folder), _vectors(spark, folder), 3, SIZE).select("query_id", "chunk_gid")
    return R.random_negatives(_questions(spark, folder), _vectors(spark, folder), found, 2, 42)


def search_hundredth(spark: SparkSession, folder: str) -> DataFrame:
    """The ten best chunks for every vector whose id is divisible by 100, over all chunks, itself among them."""
    vectors = _vectors(spark, folder)
    asked = vectors.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("vec").alias("qvec"))
    return R.best_chunks(asked, vectors, 10, SIZE).withColumn("score", F.round("score", 6))


def _best_chunks(spark: SparkSession, folder: str) -> DataFrame:
    return R.best_chunks(_questions(spark, folder), _vectors(spark, folder), 50, SIZE)


def negatives_hard(spark: SparkSession, folder: str) -> DataFrame:
    found = R.search(_questions(spark, folder), _vectors(spark, folder), 3, SIZE).select("query_id", "chunk_gid")
    return R.hard_negatives(_best_chunks(spark, folder), found, 2, 42, skip=3)


def training_contexts(spark: SparkSession, folder: str) -> DataFrame:
    found = R.search(_questions(spark, folder), _vectors(spark, folder), 3, SIZE)
    hard = R.hard_negatives(_best_chunks(spark, folder), found.select("query_id", "chunk_gid"), 2, 42, skip=3)
    return R.training_contexts(found, hard)


def retriever_contexts(spark: SparkSession, folder: str) -> DataFrame:
    """Picks and hard negatives of each template in one shuffled list."""
    retriever = R.Retriever(SIZE).build(checkpointed(_vectors(spark, folder)))
    return retriever.contexts(_questions(spark, folder), 3, 2, shuffle=True, seed=42, hard=True)


# --- noise


def noise_pool(spark: SparkSession, folder: str) -> DataFrame:
    return plan.pool_of(_corpus(spark, folder)).select("paper_id", "chunk_gid")


def _scopes(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    corpus = _corpus(spark, folder)
    sims = checkpointed(plan.similarities(plan.pool_of(corpus), corpus.templates, SIZE))
    used = plan.papers(plan.documents(corpus), corpus.chunks, plan.Settings(), 1)
    return N.scoped(sims, used.select("paper_id", "query"))


def noise_percentiles(spark: SparkSession, folder: str) -> DataFrame:
    found = N.percentiles(_scopes(spark, folder)[0])
    return found.select("scope", *[F.round(c, 6).alias(c) for c in ("p25", "p50", "p90")], "n")


def noise_bands(spark: SparkSession, folder: str) -> DataFrame:
    """How many candidates each scope has in the bands."""
    candidates = _scopes(spark, folder)[0]
    out = None
    for mode in ("cross_doc_easy", "cross_doc_hard"):
        part = N.banded(candidates, mode).groupBy("scope").agg(F.count_if("in_band").alias("inside")).select("scope", F.lit(mode).alias("mode"), "inside")
        out = part if out is None else out.union(part)
    return out


def noise_fallback(spark: SparkSession, folder: str) -> DataFrame:
    """Candidates and source if a thousand draws are asked, which no band has."""
    rows = N.with_fallback(N.banded(_scopes(spark, folder)[0], "cross_doc_hard"), "cross_doc_hard", 100_000)
    return rows.groupBy("scope", "noise_source").agg(F.count(F.lit(1)).alias("n"))


def _draws(spark: SparkSession, folder: str, mode: str) -> DataFrame:
    candidates, scopes = _scopes(spark, folder)
    return N.sampled(N.with_fallback(N.banded(candidates, mode), mode, 2), scopes, mode, 2, 42)


def noise_sample(spark: SparkSession, folder: str) -> DataFrame:
    return _draws(spark, folder, "cross_doc_easy")


def noise_random(spark: SparkSession, folder: str) -> DataFrame:
    return _draws(spark, folder, "cross_document")


def noisy_contexts(spark: SparkSession, folder: str) -> DataFrame:
    corpus = _corpus(spark, folder)
    docs = plan.documents(corpus)
    used = plan.papers(docs, corpus.chunks, plan.Settings(), 1)
    picks = plan.clean_picks(docs, used, corpus, plan.Settings().retrieval)
    return N.noisy_contexts(picks, _draws(spark, folder, "cross_doc_hard"), "cross_doc_hard", NoiseConfig())


def noise_empty_pool(spark: SparkSession, folder: str) -> DataFrame:
    """Every paper's bundle if the pool has no paper: the clean contexts, with the source none."""
    corpus = _corpus(spark, folder)
    docs = plan.documents(corpus)
    used = plan.papers(docs, corpus.chunks, plan.Settings(), 1)
    picks = plan.clean_picks(docs, used, corpus, plan.Settings().retrieval)
    pool = plan.pool_of(corpus, plan.Settings(noise=NoiseConfig(pool_limit=0)))
    sims = plan.similarities(pool, corpus.templates, SIZE)
    drawn = N.draw_noise(sims, used.select("paper_id", "query"), "cross_doc_hard", 2)
    return plan.clean_where_no_noise(picks, N.noisy_contexts(picks, drawn, "cross_doc_hard"), used)


# --- prompts


def _chunk_rows(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "rulebase_chunkforpdf").where("source_doc_id is not null")


def _first(rows: DataFrame, most: int) -> DataFrame:
    """(source_doc_id, c): each document's first chunks in order; what comes later is dropped before the shuffle."""
    order = Window.partitionBy("source_doc_id").orderBy("chunk_id", "row_id")
    placed = rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)
    return placed.groupBy("source_doc_id").agg(F.array_sort(F.collect_list(F.struct("place", "section", "text"))).alias("c"))


def _contexts(spark: SparkSession, folder: str, most: int) -> DataFrame:
    """(source_doc_id, n, c) of every document: how many chunks aren't blank, and the first of them."""
    rows = _chunk_rows(spark, folder).withColumn("full", T.safe_strip(F.col("text")) != "")
    counts = rows.groupBy("source_doc_id").agg(F.count_if("full").alias("n"))
    empty = F.array().cast("array<struct<place:int,section:string,text:string>>")
    return counts.join(_first(rows.where("full"), most), "source_doc_id", "left").withColumn("c", F.coalesce("c", empty))


def _joined(contexts: Column) -> Column:
    return F.array_join(contexts, " || ")


def format_contexts(spark: SparkSession, folder: str) -> DataFrame:
    return _contexts(spark, folder, 3).select("source_doc_id", _joined(P.format_contexts(F.col("c.text"), most=3)).alias("contexts"))


def format_items(spark: SparkSession, folder: str) -> DataFrame:
    return _first(_chunk_rows(spark, folder), 3).select("source_doc_id", _joined(P.format_items(F.col("c"), most=3, headers=True)).alias("contexts"))


def truncate_context(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", P.WhitespaceTokenizer().truncate(F.col("text"), 20).alias("text"))


def budget_prefix(spark: SparkSession, folder: str) -> DataFrame:
    """How many of a document's contexts fit the budget; each has a word at least, which bounds how many can."""
    rows = _contexts(spark, folder, PromptConfig.token_budget + 1)
    return rows.select("source_doc_id", "n", F.size(P.fit_to_budget(P.format_contexts(F.col("c.text")))).alias("kept"))


def build_input_plain(spark: SparkSession, folder: str) -> DataFrame:
    return _papers(spark, folder).select("row_id", P.plain_input(F.col("abstract")).alias("input_text"))


def build_input_rag(spark: SparkSession, folder: str) -> DataFrame:
    rows = _contexts(spark, folder, 6)
    return rows.select("source_doc_id", P.rag_input(T.choose_query(F.col("source_doc_id")), P.format_contexts(F.col("c.text"), most=6)).alias("input_text"))


# --- examples

_EXAMPLE = ("input_text", "target_text", "paper_id", "split", "sample_type", "num_contexts", "noise_mode", "noise_source", "num_chunks", "num_documents", "n_noise_used")


def training_examples(spark: SparkSession, folder: str) -> DataFrame:
    return plan.build_split(_corpus(spark, folder), "train", ("cross_doc_easy",)).select(*_EXAMPLE)


def validation_examples(spark: SparkSession, folder: str) -> DataFrame:
    return plan.build_split(_corpus(spark, folder), "validation", ()).select(*_EXAMPLE)


def test_examples(spark: SparkSession, folder: str) -> DataFrame:
    return plan.build_split(_corpus(spark, folder), "test", ("cross_doc_easy", "cross_doc_hard")).select(*_EXAMPLE)


def sample_type_counts(spark: SparkSession, folder: str) -> DataFrame:
    return plan.sample_type_counts(training_examples(spark, folder))


def pair_rates(spark: SparkSession, folder: str) -> DataFrame:
    return plan.pair_rates(training_examples(spark, folder)).withColumn("rate", F.round("rate", 4))


def output_sets(spark: SparkSession, folder: str) -> DataFrame:
    """The five sets written as JSON lines, read again and summed up."""
    path = _scratch(spark)
    sinks.write_output_sets(plan.output_sets(_corpus(spark, folder)), path)
    schema = StructType([*readers.EXAMPLE.fields, StructField("output_set", StringType())])
    return plan.summary(spark.read.schema(schema).json(path)).withColumn("mean_contexts", F.round("mean_contexts", 6))


def _own_papers(spark: SparkSession, folder: str) -> DataFrame:
    """(paper_id, split, idx, article, abstract) of valid papers; of one delivered again the first row."""
    first = _valid(spark, folder).groupBy("paper_id").agg(F.min_by(F.struct("split", "article", "abstract"), "row_id").alias("r"))
    return first.select("paper_id", "r.split", T.id_suffix(F.col("paper_id")).alias("idx"), "r.article", "r.abstract")


def examples_from_papers(spark: SparkSession, folder: str) -> DataFrame:
    """Examples of all sets from articles alone: cut, encoded by hashed words, retrieved, mixed with noise."""
    return B.examples_from_papers(_own_papers(spark, folder), V.hashing_encoder, 64).select("output_set", *_EXAMPLE)


def build_report(spark: SparkSession, folder: str) -> DataFrame:
    """Examples by set and rates of the sets that training_examples and the others make."""
    return B.build_report(plan.output_sets(_corpus(spark, folder)))


# --- sources and sinks: written by the sink, read by the source


def _scratch(spark: SparkSession) -> str:
    """A new path in the shared folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/written-{uuid.uuid4()}"


def required_fields(spark: SparkSession, folder: str) -> DataFrame:
    """Rows written as JSON whose target is missing, as null fields are left out."""
    rows = table(spark, folder, "retrieval_tokenizer").select(F.to_json(F.struct(F.col("id").alias("input_text"), F.col("text").alias("target_text"))).alias("value"), "id")
    return readers.missing_fields(rows).select("id", "missing")


def jsonl_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "heldout_examples").select(F.col("text").alias("input_text"), "target_text", F.col("item_id").cast("string").alias("paper_id"), "split")
    path = _scratch(spark)
    sinks.write_jsonl(rows, path)
    return readers.read_jsonl(spark, path).select("paper_id", "split", "input_text", "target_text", "noise_mode")


def tsv_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    path = _scratch(spark)
    _valid(spark, folder).select(F.concat_ws("\t", T.normalize_space(F.col("article")), T.normalize_space(F.col("abstract")), F.lit("more"))).write.text(path)
    return readers.read_tsv_papers(spark, path)


def parquet_split(spark: SparkSession, folder: str) -> DataFrame:
    path = _scratch(spark)
    _papers(spark, folder).select("split", "article", "abstract").write.partitionBy("split").parquet(path)
    return readers.read_parquet_papers(spark, path, "validation").select("article", "abstract")


def arrow_split(spark: SparkSession, folder: str) -> DataFrame:
    path = _scratch(spark)
    for split in ("validation", "test"):
        sinks.write_arrow_shards(_papers(spark, folder).where(F.col("split") == split).select("article", "abstract"), f"{path}/{split}")
    return readers.read_arrow_papers(spark, path, "test").select("article", "abstract")


def optional_sets(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of the sets that are there, of which one is named but missing."""
    path = _scratch(spark)
    for split in ("validation", "test"):
        rows = table(spark, folder, "heldout_examples").where(F.col("split") == split)
        sinks.write_jsonl(rows.select(F.col("text").alias("input_text"), "target_text"), f"{path}/{split}")
    found = readers.read_example_sets(spark, f"{path}/validation", f"{path}/test", {"more": f"{path}/none", "again": f"{path}/test"})
    out = None
    for name, rows in found.items():
        part = rows.select(F.lit(name).alias("name"), "input_text")
        out = part if out is None else out.union(part)
    return out.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("input_text").alias("n_texts"))


def from_rows(spark: SparkSession, folder: str) -> DataFrame:
    return readers.from_rows(spark, [{"input_text": "a", "num_chunks": 2}, {"target_text": "b"}, {}]).select("input_text", "target_text", "num_chunks")


# --- metrics


def _whole_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Predictions are whole articles with their line ends, references the abstracts."""
    return _valid(spark, folder).select("row_id", "split", F.col("article").alias("prediction"), F.col("abstract").alias("reference"))


def _rouge(n: int) -> Query:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return M.rouge_n(_whole_pairs(spark, folder), "row_id", n).withColumn("score", F.round("score", 6))

    return run


def rouge_l(spark: SparkSession, folder: str) -> DataFrame:
    return M.rouge_l(_whole_pairs(spark, folder), "row_id").withColumn("score", F.round("score", 6))


def rouge_lsum(spark: SparkSession, folder: str) -> DataFrame:
    return M.rouge_lsum(_whole_pairs(spark, folder), "row_id").withColumn("score", F.round("score", 6))


def rouge_stemmed(spark: SparkSession, folder: str) -> DataFrame:
    return M.rouge_n(_whole_pairs(spark, folder), "row_id", 1, prepare=M.stemmed_tokens).withColumn("score", F.round("score", 6))


def _summary(spark: SparkSession, folder: str, names: tuple[str, ...]) -> DataFrame:
    scores = M.rouge_scores(_whole_pairs(spark, folder), ["row_id", F.col("split").alias("eval_set")])
    return M.metrics_summary(scores, list(names))


def metrics_summary(spark: SparkSession, folder: str) -> DataFrame:
    return _summary(spark, folder, ("rouge1", "rouge2"))


def metrics_whole(spark: SparkSession, folder: str) -> DataFrame:
    """All four scores by evaluation set."""
    return _summary(spark, folder, ("rouge1", "rouge2", "rougeL", "rougeLsum"))


def metrics_report(spark: SparkSession, folder: str) -> DataFrame:
    """One line for each set asked for; one of them was not evaluated."""
    return M.report_line(M.combined_metrics(_summary(spark, folder, ("rouge1",))), ["validation", "test", "noisy"], "rouge1")


def decoded_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Texts of ids, which number the words of all held-out summaries in order."""
    words = F.split(T.normalize_space(F.col("target_text")), " ")
    rows = table(spark, folder, "heldout_examples").select("item_id", words.alias("w"))
    known = rows.select(F.explode("w").alias("w")).agg(F.array_sort(F.collect_set("w")).alias("all"))
    full = rows.join(F.broadcast(known))  # one row
    ids = F.transform("w", lambda w: F.array_position("all", w).cast("int"))
    vocabulary = F.map_from_arrays(F.sequence(F.lit(1), F.size("all")), F.col("all"))
    return full.select("item_id", M.decoded(F.concat(F.array(F.lit(0)), ids, F.array(F.lit(-1))), vocabulary, skip=(0,)).alias("text"))


class _Lengths:
    """A tokenizer whose ids are the words' lengths."""

    def encode(self, text: str) -> list[int]:
        return [len(w) for w in text.split()]


def tokenized_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Ids of passages and summaries, truncated to 40 and 10."""
    rows = table(spark, folder, "heldout_examples").select(T.normalize_space(F.col("text")).alias("input_text"), T.normalize_space(F.col("target_text")).alias("target_text"), "item_id")
    done = P.tokenized(rows, _Lengths, 40, 10)
    return done.select(F.array_join("input_ids", " ").alias("input_ids"), F.size("attention_mask").alias("n"), F.array_join("labels", " ").alias("labels"))


def _ids() -> Column:
    """Word lengths stand for ids; 0 pads and -100 masks every fifth."""
    return F.transform(F.split(T.normalize_space(F.col("target_text")), " "), lambda w, i: F.when(i % 5 == 4, F.lit(-100)).otherwise(F.length(w)))


def label_unmask(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "heldout_examples").select("item_id", F.posexplode(M.unmasked(_ids(), 0)).alias("pos", "label"))
    return rows


def gen_len(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "heldout_examples").select("split", M.generated_length(M.unmasked(_ids(), 0), 0).alias("n"))
    return rows.groupBy("split").agg(M.rounded(F.avg("n")).alias("gen_len"))


def padded_batches(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "heldout_examples").select("item_id", "source", _ids().alias("labels"))
    done = P.padded_batches(rows, "source", {"labels": -100})
    return done.select("item_id", F.size("labels").alias("padded"), F.size(F.filter("labels", lambda x: x == -100)).alias("masked"))


_QUERIES: tuple[Query, ...] = (
    clean_field, valid_papers, normalize_space, safe_strip, word_count, token_estimate, line_split, heading_flag, heading_title, sentence_split,
    choose_query, chunk_gid, id_suffix, section_header_prefix, sections, section_fallback, chunks, chunk_overlap, document_counts, document_counts_sql, min_chunks_filter,
    paper_ids, make_documents, rejected_papers, l2_normalize, all_scores, masked_mean_pool, hashing_encode, candidate_k_rule, topk_candidates,
    pairwise_sim, mmr_select, mmr_search, negatives_random, negatives_hard, training_contexts, noise_pool, noise_percentiles, noise_bands,
    noise_fallback, noise_sample, noise_random, noisy_contexts, format_contexts, format_items, truncate_context, budget_prefix, build_input_plain,
    build_input_rag, training_examples, validation_examples, test_examples, sample_type_counts, pair_rates, required_fields, rouge_l, rouge_lsum,
    rouge_stemmed, metrics_summary, label_unmask, gen_len, padded_batches, search_hundredth, retriever_contexts, noise_empty_pool, output_sets,
    examples_from_papers, build_report, jsonl_round_trip, tsv_round_trip, parquet_split, arrow_split, optional_sets, from_rows, metrics_whole,
    metrics_report, decoded_ids, tokenized_pairs,
)


def _wide(query: Query) -> Query:
    """The query with 32-bit integers as 64-bit ones, so that types agree with the SQL."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        df = query(spark, folder)
        return df.select(*[F.col(f"`{c}`").cast("long").alias(c) if kind == "int" else F.col(f"`{c}`") for c, kind in df.dtypes])

    return run


def queries() -> dict[str, Query]:
    named = {q.__name__: q for q in _QUERIES} | {"rouge1": _rouge(1), "rouge2": _rouge(2)}
    return {name: _wide(q) for name, q in named.items()}


def oracle_sql() -> dict[str, str]:
    from quireflow.oracle import sql

    return sql()
