"""Cross-document noise from bands of similarity between queries and a pool.

A pool is a frame (paper_id, chunk_gid, vec) of train chunks.  Similarities
depend on the query template alone, so bands are found once a template; only
papers that are in the pool themselves, of which there are a bounded number,
get bands without their own chunks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quireflow.config import NOISE_MODES, NoiseConfig
from quireflow.functions.text import keyed_number
from quireflow.operators.retrieval import draw_key


def check_mode(mode: str) -> None:
    if mode not in NOISE_MODES:
        raise ValueError(f"mode must be one of {NOISE_MODES}")


def noise_pool(chunks: DataFrame, papers: DataFrame, limit: int, min_chunks: int) -> DataFrame:
    """Chunks of the first `limit` papers (paper_id, idx) that have enough of them."""
    first = papers.where(F.col("idx") < limit).select("paper_id")
    counts = chunks.groupBy("paper_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_chunks).select("paper_id")
    return chunks.join(first.join(counts, "paper_id", "left_semi"), "paper_id", "left_semi")


def scoped(similarities: DataFrame, papers: DataFrame, strict: bool = True) -> tuple[DataFrame, DataFrame]:
    """Candidates (scope, paper_id, chunk_gid, sim) and the scope of each paper (paper_id, scope).

    `similarities` has (query, paper_id, chunk_gid, sim) of the pool, `papers`
    (paper_id, query).  A scope is a template, or a paper in the pool, which
    must not draw its own chunks unless `strict` is off.
    """
    template = F.concat(F.lit("template:"), F.col("query").cast("string"))
    common = similarities.withColumn("scope", template)
    if not strict:
        return common.select("scope", "paper_id", "chunk_gid", "sim"), papers.select("paper_id", template.alias("scope"))
    members = similarities.select("paper_id").distinct()
    own = F.concat(F.lit("paper:"), F.col("reader"))
    inside = papers.join(members, "paper_id", "left_semi").select(F.col("paper_id").alias("reader"), "query")
    apart = similarities.join(inside, "query").where("paper_id != reader").withColumn("scope", own)
    outside = papers.join(members, "paper_id", "left_anti").select("paper_id", template.alias("scope"))
    scopes = outside.union(inside.select(F.col("reader").alias("paper_id"), own.alias("scope")))
    return common.select("scope", "paper_id", "chunk_gid", "sim").union(apart.select("scope", "paper_id", "chunk_gid", "sim")), scopes


def percentiles(candidates: DataFrame) -> DataFrame:
    """(scope, p25, p50, p90, n): exact percentiles with linear interpolation."""
    return candidates.groupBy("scope").agg(
        F.percentile("sim", F.lit(0.25)).alias("p25"),
        F.percentile("sim", F.lit(0.5)).alias("p50"),
        F.percentile("sim", F.lit(0.9)).alias("p90"),
        F.count(F.lit(1)).alias("n"),
    )


def banded(candidates: DataFrame, mode: str) -> DataFrame:
    """Candidates with in_band: from p50 to below p90 for easy, up to p25 for hard, all for random."""
    check_mode(mode)
    if mode == "cross_document":
        return candidates.withColumn("in_band", F.lit(True))
    known = candidates.join(percentiles(candidates).drop("n"), "scope")
    inside = F.col("sim").between(F.col("p50"), F.col("p90")) & (F.col("sim") < F.col("p90")) if mode == "cross_doc_easy" else F.col("sim") <= F.col("p25")
    return known.withColumn("in_band", inside).drop("p25", "p50", "p90")


def with_fallback(rows: DataFrame, mode: str, noise_k: int) -> DataFrame:
    """Eligible candidates with noise_source: the band, or all of the scope if the band has too few."""
    counts = rows.groupBy("scope").agg(F.count_if("in_band").alias("inside"))
    few = F.col("inside") < noise_k
    source = F.when(few & F.lit(mode != "cross_document"), F.lit(f"{mode}_fallback_random")).otherwise(F.lit(mode))
    joined = rows.join(counts, "scope").withColumn("noise_source", source)
    return joined.where(F.col("in_band") | few).drop("inside", "in_band")


def sampled(eligible: DataFrame, scopes: DataFrame, mode: str, noise_k: int, seed: int) -> DataFrame:
    """(paper_id, chunk_gid, pos, noise_source): noise_k draws for each paper without replacement.

    Each scope's candidates get one random order by a keyed hash; a paper takes
    neighbours in that order from an offset hashed of its id.  Work follows
    papers * noise_k, not papers * candidates, and no draw depends on another
    paper's.
    """
    order = Window.partitionBy("scope").orderBy(draw_key(seed, mode, F.col("chunk_gid")), "chunk_gid")
    placed = eligible.withColumn("at", (F.row_number().over(order) - 1).cast("long"))
    sizes = placed.groupBy("scope").agg(F.count(F.lit(1)).alias("m"))
    asked = scopes.join(sizes, "scope").withColumn("start", keyed_number(F.concat_ws("|", F.lit(str(seed)), F.col("paper_id"), F.lit(mode)), F.col("m")))
    asked = asked.select("paper_id", "scope", "m", "start", F.explode(F.sequence(F.lit(1), F.lit(noise_k))).alias("pos")).where("pos <= m")
    asked = asked.withColumn("at", F.pmod(F.col("start") + F.col("pos") - 1, F.col("m")))
    return asked.join(placed.select("scope", "at", "chunk_gid", "noise_source"), ["scope", "at"]).select("paper_id", "chunk_gid", "pos", "noise_source")


def draw_noise(similarities: DataFrame, papers: DataFrame, mode: str, noise_k: int, config: NoiseConfig = NoiseConfig()) -> DataFrame:
    """Noise of one mode for every paper (paper_id, query)."""
    candidates, scopes = scoped(similarities, papers, config.strict_exclusion)
    return sampled(with_fallback(banded(candidates, mode), mode, noise_k), scopes, mode, noise_k, config.seed)


def noisy_contexts(clean: DataFrame, noise: DataFrame, mode: str, config: NoiseConfig = NoiseConfig()) -> DataFrame:
    """(paper_id, pos, chunk_gid, is_noise, noise_source) of papers that got noise.

    Clean picks (paper_id, chunk_gid, rank), then noise; shuffled by a keyed hash if asked.
    """
    first = clean.select("paper_id", "chunk_gid", F.col("rank").alias("pos"), F.lit(False).alias("is_noise"))
    counts = clean.groupBy("paper_id").agg(F.max("rank").alias("m"))
    source = noise.groupBy("paper_id").agg(F.min("noise_source").alias("noise_source"))
    after = noise.join(counts, "paper_id").select("paper_id", "chunk_gid", (F.col("pos") + F.col("m")).alias("pos"), F.lit(True).alias("is_noise"))
    rows = first.unionByName(after).join(source, "paper_id")
    if not config.shuffle:
        return rows
    order = Window.partitionBy("paper_id").orderBy(draw_key(config.seed, "order", mode, F.col("paper_id"), F.col("chunk_gid")), "pos")
    return rows.withColumn("pos", F.row_number().over(order))
