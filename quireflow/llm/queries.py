"""Queries of the training-data operators, by name, and their SQL where SQL can say them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quireflow.llm import tokenizer
from quireflow.llm.cross_split import overlaps
from quireflow.llm.leakage import leaks
from quireflow.llm.markup import clean_texts
from quireflow.llm.near_duplicates import near_duplicates
from quireflow.llm.neighbours import nearest
from quireflow.llm.sentences import sentence_rows
from quireflow.llm.spam import spam_pages, train
from quireflow.llm.splitting import split_texts
from quireflow.session import table

Query = Callable[[SparkSession, str], DataFrame]


# TESTDATA.md: the limit of each field in code points.
P1_LIMITS = (("dataset_info", "article", 8000), ("rulebase_chunkforpdf", "text", 1200), ("rulebase_chunkforpdf", "section", 120))


def p1_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """The pieces of every article, chunk text and section title."""
    out = None
    for name, column, limit in P1_LIMITS:
        part = split_texts(table(spark, folder, name), "row_id", column, limit).select(F.lit(f"{name}.{column}").alias("field"), "*")
        out = part if out is None else out.union(part)
    return out


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return p1_pieces(spark, folder).where("n_pieces > 1 and piece = 0").select("field", "row_id")


def p2_sentences(spark: SparkSession, folder: str) -> DataFrame:
    """Every sentence of every article and chunk text, with its place."""
    out = None
    for name, column in P3_FIELDS:
        part = sentence_rows(table(spark, folder, name), "row_id", column).select(F.lit(f"{name}.{column}").alias("field"), "*")
        out = part if out is None else out.union(part)
    return out


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    papers = table(spark, folder, "dataset_info").where(F.col("split") == "validation")
    out = None
    for rows, name, column in ((papers, "dataset_info", "article"), (table(spark, folder, "rulebase_chunkforpdf"), "rulebase_chunkforpdf", "text")):
        part = sentence_rows(rows, "row_id", column, texts=False).select(F.lit(f"{name}.{column}").alias("field"), "row_id", "end_pos")
        out = part if out is None else out.union(part)
    return out


# TESTDATA.md: three consecutive tokens, at least 20 tokens, similarity 0.5.
WIDTH, LEAST_TOKENS, THRESHOLD = 3, 20, 0.5
P3_FIELDS = (("dataset_info", "article"), ("rulebase_chunkforpdf", "text"))


def p3_groups(spark: SparkSession, folder: str) -> DataFrame:
    """(field, row_id, group): one row for each text that has a near-duplicate in its table."""
    both = None
    for tag, (name, column) in enumerate(P3_FIELDS):
        part = table(spark, folder, name).select((F.col("row_id") * 2 + tag).alias("id"), F.col(column).alias("text"), F.lit(tag).alias("tag"))
        both = part if both is None else both.union(part)
    groups = near_duplicates(both, "id", "text", WIDTH, THRESHOLD, LEAST_TOKENS, within=F.col("tag"))
    names = F.array(*[F.lit(f"{name}.{column}") for name, column in P3_FIELDS])
    return groups.select(
        F.get(names, F.expr("int(id & 1)")).alias("field"),
        F.expr("shiftright(id, 1)").alias("row_id"),
        F.expr("shiftright(`group`, 1)").alias("group"),
    )


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    groups = p3_groups(spark, folder)
    a = groups.select("field", "group", F.col("row_id").alias("row_a"))
    b = groups.select("field", "group", F.col("row_id").alias("row_b"))
    return a.join(b, ["field", "group"]).where("row_a < row_b").select("field", "row_a", "row_b")


def p4_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    """The ten most similar vectors of every usable vector, with cosine and rank."""
    found = nearest(table(spark, folder, "databuildt"), "vec_id", "embeddings", 96)
    return found.select(F.col("id").alias("vec_id"), F.col("other").alias("neighbour_id"), "cosine", "rank")


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    pairs = p4_neighbours(spark, folder)
    a, b = F.least("vec_id", "neighbour_id"), F.greatest("vec_id", "neighbour_id")
    return pairs.select(a.alias("vec_a"), b.alias("vec_b")).distinct()


def p5_clean(spark: SparkSession, folder: str) -> DataFrame:
    """(row_id, field, kinds, clean) of every article and abstract."""
    papers = table(spark, folder, "dataset_info")
    texts = papers.select(F.posexplode(F.array(*P6_FIELDS)).alias("tag", "text"), "row_id")
    done = clean_texts(texts.select((F.col("row_id") * 2 + F.col("tag")).alias("id"), "text"), "id", "text")
    return done.select(F.expr("shiftright(id, 1)").alias("row_id"), _field("id").alias("field"), "kinds", "clean")


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return p5_clean(spark, folder).select("row_id", "field", F.explode("kinds").alias("kind"))


P6_FIELDS = ("article", "abstract")


def _p6(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Overlaps of both fields in one pass; ids are row_id * 2 + the field's place."""
    papers = table(spark, folder, "dataset_info")
    held_out = F.when(F.col("split") == "train", False).when(F.col("split").isin("validation", "test"), True)
    texts = papers.select("row_id", held_out.alias("held_out"), F.posexplode(F.array(*P6_FIELDS)).alias("tag", "text"))
    texts = texts.select((F.col("row_id") * 2 + F.col("tag")).alias("id"), "text", "held_out", "tag")
    return overlaps(texts, "id", "text", F.col("held_out"), WIDTH, THRESHOLD, LEAST_TOKENS, within=F.col("tag"))


def _field(column: str) -> Column:
    return F.get(F.array(*[F.lit(x) for x in P6_FIELDS]), F.expr(f"int({column} & 1)"))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    pairs, members = _p6(spark, folder)
    train = members.where("not held_out").select(F.col("id").alias("a"), F.col("least").alias("train"))
    other = members.where("held_out").select(F.col("id").alias("b"), F.col("least").alias("held_out"))
    rows = pairs.select("train", "held_out").join(train, "train").join(other, "held_out")
    a, b = F.expr("shiftright(a, 1)"), F.expr("shiftright(b, 1)")
    return rows.select(F.least(a, b).alias("row_a"), F.greatest(a, b).alias("row_b"), _field("a").alias("field"))


def p6_counts(spark: SparkSession, folder: str) -> DataFrame:
    """(field, split, source, n_rows, n_links): held-out rows with an overlap, and pairs of rows, by split and source.

    Copies on the training side are counted, not expanded.
    """
    pairs, members = _p6(spark, folder)
    copies = members.where("not held_out").groupBy(F.col("least").alias("train")).agg(F.count(F.lit(1)).alias("copies"))
    linked = pairs.join(copies, "train").groupBy(F.col("held_out").alias("least")).agg(F.sum("copies").alias("links"))
    rows = members.where("held_out").select("id", "least").join(linked, "least").select("id", "links", F.expr("shiftright(id, 1)").alias("row_id"))
    sources = table(spark, folder, "dataset_info").where(F.col("split") != "train").select("row_id", "split", "source")
    return (
        rows.join(sources, "row_id")
        .groupBy(_field("id").alias("field"), "split", "source")
        .agg(F.count(F.lit(1)).alias("n_rows"), F.sum("links").alias("n_links"))
    )


def p7_ids(spark: SparkSession, folder: str) -> DataFrame:
    return tokenizer.encode(table(spark, folder, "documents"))


def p8_passages(spark: SparkSession, folder: str) -> DataFrame:
    """Every passage of a held-out item in a document, with its place."""
    items = table(spark, folder, "heldout_examples")
    return leaks(table(spark, folder, "documents"), items, "doc_id", "text", "item_id", ["text", "target_text"])


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return p8_passages(spark, folder).select(F.col("doc").alias("doc_id"), F.col("item").alias("item_id")).distinct()


def p9_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Spam pages with the share of abnormal words and their mean bits; articles, abstracts and chunks are the prose."""
    papers, parts = table(spark, folder, "dataset_info"), table(spark, folder, "rulebase_chunkforpdf")
    prose = papers.select(F.explode(F.array(*P6_FIELDS)).alias("text")).union(parts.select("text")).where("text is not null")
    return spam_pages(table(spark, folder, "documents"), "doc_id", "text", train(prose))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return p9_pages(spark, folder).select("doc_id")


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (p1_pieces, p1_found, p2_sentences, p2_found, p3_groups, p3_found, p4_neighbours, p4_found, p5_clean, p5_found, p6_found, p6_counts, p7_ids, p8_passages, p8_found, p9_pages, p9_found)}


P1_SQL = " UNION ALL ".join(f"SELECT '{t}.{c}' AS field, row_id FROM {t} WHERE length({c}) > {n}" for t, c, n in P1_LIMITS)

_TOKENS = "list_filter(string_split(regexp_replace(lower(coalesce(text, '')), '[^\\p{L}\\p{M}\\p{N}]+', ' ', 'g'), ' '), lambda w: w <> '')"


def _runs(source: str, keys: str, width: int, least: int) -> str:
    """Distinct runs of tokens of source(keys, text): tables tokens, runs (keys, run) and sizes (keys, n)."""
    return f"""source AS ({source}), tokens AS (SELECT {keys}, {_TOKENS} AS t FROM source),
 runs AS (SELECT DISTINCT {keys}, array_to_string(t[i:i + {width - 1}], ' ') AS run FROM (SELECT *, unnest(range(1, len(t) - {width - 2})) AS i FROM tokens WHERE len(t) >= {least})),
 sizes AS (SELECT {keys}, count(*) AS n FROM runs GROUP BY ALL)"""


_P3_SOURCE = " UNION ALL ".join(f"SELECT '{t}.{c}' AS field, row_id, {c} AS text FROM {t}" for t, c in P3_FIELDS)
_P3_REACH = f"""WITH RECURSIVE {_runs(_P3_SOURCE, "field, row_id", WIDTH, LEAST_TOKENS)},
 shared AS (SELECT a.field, a.row_id AS a, b.row_id AS b, count(*) AS c FROM runs a JOIN runs b ON a.field = b.field AND a.run = b.run AND a.row_id < b.row_id GROUP BY ALL),
 links AS (SELECT s.field, a, b FROM shared s JOIN sizes x ON x.field = s.field AND x.row_id = a JOIN sizes y ON y.field = s.field AND y.row_id = b WHERE c >= {THRESHOLD} * (x.n + y.n - c)),
 both_ways AS (SELECT field, a, b FROM links UNION SELECT field, b, a FROM links),
 reach AS (SELECT field, a, b FROM both_ways UNION SELECT r.field, r.a, l.b FROM reach r JOIN both_ways l ON r.field = l.field AND r.b = l.a)"""
P3_SQL = f"{_P3_REACH} SELECT DISTINCT field, a AS row_a, b AS row_b FROM reach WHERE a < b"
P3_GROUPS_SQL = f'{_P3_REACH} SELECT field, a AS row_id, min(b) AS "group" FROM reach GROUP BY field, a'

P4_SQL = """WITH usable AS (SELECT vec_id, embeddings::DOUBLE[] AS e FROM databuildt
   WHERE embeddings IS NOT NULL AND len(embeddings) = 96 AND len(list_filter(embeddings, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embeddings, lambda x: x <> 0)) > 0),
 pairs AS (SELECT a.vec_id AS a, b.vec_id AS b, list_cosine_similarity(a.e, b.e) AS s FROM usable a JOIN usable b ON a.vec_id <> b.vec_id),
 best AS (SELECT a, b FROM pairs QUALIFY row_number() OVER (PARTITION BY a ORDER BY s DESC, b) <= 10)
 SELECT DISTINCT least(a, b) AS vec_a, greatest(a, b) AS vec_b FROM best"""

_P6_SOURCE = " UNION ALL ".join(f"SELECT '{c}' AS field, row_id, split, {c} AS text FROM dataset_info" for c in P6_FIELDS)
_P6_LINKS = f"""WITH {_runs(_P6_SOURCE, "field, row_id, split", WIDTH, LEAST_TOKENS)},
 shared AS (SELECT a.field, a.row_id AS a, b.row_id AS b, count(*) AS c FROM runs a JOIN runs b USING (field, run) WHERE a.split = 'train' AND b.split IN ('validation', 'test') GROUP BY ALL),
 links AS (SELECT a, b, s.field FROM shared s JOIN sizes x ON x.field = s.field AND x.row_id = a JOIN sizes y ON y.field = s.field AND y.row_id = b
 WHERE c >= {THRESHOLD} * (x.n + y.n - c))"""
P6_SQL = f"{_P6_LINKS} SELECT least(a, b) AS row_a, greatest(a, b) AS row_b, field FROM links"
P6_COUNTS_SQL = f"{_P6_LINKS} SELECT field, split, source, count(DISTINCT b) AS n_rows, count(*) AS n_links FROM links JOIN dataset_info ON row_id = b GROUP BY field, split, source"

P8_SQL = f"""WITH source AS (SELECT 'd' AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 'i', item_id, text FROM heldout_examples UNION ALL SELECT 'i', item_id, target_text FROM heldout_examples),
 tokens AS (SELECT kind, id, {_TOKENS} AS t FROM source),
 runs AS (SELECT kind, id, array_to_string(t[i:i + 11], ' ') AS run FROM (SELECT *, unnest(range(1, len(t) - 10)) AS i FROM tokens WHERE len(t) >= 12))
 SELECT DISTINCT a.id AS doc_id, b.id AS item_id FROM runs a JOIN runs b USING (run) WHERE a.kind = 'd' AND b.kind = 'i'"""

_WORD = "[\\p{L}\\p{M}\\p{N}]+"
P8_PASSAGES_SQL = f"""WITH tokens AS (SELECT doc_id AS doc, {_TOKENS} AS t FROM documents),
 items AS (SELECT item_id AS item, text FROM heldout_examples UNION ALL SELECT item_id, target_text FROM heldout_examples),
 wanted AS (SELECT DISTINCT item, array_to_string(t[i:i + 11], ' ') AS run FROM (SELECT item, t, unnest(range(1, len(t) - 10)) AS i FROM (SELECT item, {_TOKENS} AS t FROM items) WHERE len(t) >= 12)),
 runs AS (SELECT doc, i - 1 AS k, array_to_string(t[i:i + 11], ' ') AS run FROM (SELECT doc, t, unnest(range(1, len(t) - 10)) AS i FROM tokens WHERE len(t) >= 12)),
 hits AS (SELECT DISTINCT doc, item, k FROM runs JOIN wanted USING (run)),
 islands AS (SELECT *, k - row_number() OVER (PARTITION BY doc, item ORDER BY k) AS g FROM hits),
 passages AS (SELECT doc, item, min(k) AS first, max(k) + 12 AS last FROM islands GROUP BY doc, item, g),
 cut AS (SELECT doc_id AS doc, list_transform(string_split_regex(lower(text), '{_WORD}'), lambda x: length(x)) AS gaps, list_transform(regexp_extract_all(lower(text), '{_WORD}'), lambda x: length(x)) AS words FROM documents WHERE doc_id IN (SELECT doc FROM passages))
 SELECT doc, item, first, last, (list_sum(gaps[1:first + 1]) + coalesce(list_sum(words[1:first]), 0))::BIGINT AS start_pos, (list_sum(gaps[1:last]) + list_sum(words[1:last]))::BIGINT AS end_pos FROM passages JOIN cut USING (doc)"""


def oracle_sql() -> dict[str, str]:
    """The neighbours' SQL is exact; the query can miss a neighbour in a list that isn't probed."""
    return {"p1_found": P1_SQL, "p3_found": P3_SQL, "p3_groups": P3_GROUPS_SQL, "p4_found": P4_SQL, "p6_found": P6_SQL, "p6_counts": P6_COUNTS_SQL, "p8_found": P8_SQL, "p8_passages": P8_PASSAGES_SQL}
