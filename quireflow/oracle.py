"""DuckDB SQL that says the same as the queries, for checking them."""

from __future__ import annotations

from quireflow.config import QUERY_TEMPLATES
from quireflow.functions.text import LINE_END, NUMBERED, SECTION_TITLES, SPACE

_TITLES = ", ".join(f"'{t}'" for t in SECTION_TITLES)
_CASES = " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(QUERY_TEMPLATES))


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{SPACE}+|{SPACE}+$', '', 'g')"


def safe(x: str) -> str:
    return f"coalesce({strip(x)}, '')"


def clean(x: str) -> str:
    return f"coalesce({strip(f'''replace({x}, '/n', chr(10))''')}, '')"


def norm(x: str) -> str:
    return f"coalesce(trim(regexp_replace({x}, '{SPACE}+', ' ', 'g'), ' '), '')"


def words(n: str) -> str:
    """Words of a normalised text."""
    return f"(CASE WHEN {n} = '' THEN 0 ELSE len(string_split({n}, ' ')) END)::BIGINT"


def keyed(x: str, below: str) -> str:
    return f"(('0x' || substr(md5({x}), 1, 8))::BIGINT % {below})"


def template(i: str) -> str:
    return f"CASE {i} {_CASES} END"


def sentences(x: str) -> str:
    """A list of stripped sentences."""
    marked = rf"regexp_replace({x}, '([.!?]){SPACE}+([A-Z])', '\1' || chr(1) || '\2', 'g')"
    return f"list_filter(list_transform(string_split({marked}, chr(1)), lambda s: {strip('s')}), lambda s: s <> '')"


_VALID = f"""valid AS (
  SELECT row_id, paper_id, split, {clean("article")} AS article, {clean("abstract")} AS abstract
  FROM dataset_info WHERE article IS NOT NULL AND abstract IS NOT NULL AND {clean("article")} <> '' AND {clean("abstract")} <> '')"""


def _lines(source: str) -> str:
    """lines: (row_id, pos, line) of normalised lines that aren't blank."""
    return f"""split_lines AS (SELECT row_id, string_split_regex(article, '{LINE_END}') AS l FROM {source}),
 raw_lines AS (SELECT row_id, unnest(range(0, len(l))) AS pos, unnest(l) AS line FROM split_lines),
 lines AS (SELECT row_id, pos::BIGINT AS pos, {norm("line")} AS line FROM raw_lines WHERE {norm("line")} <> '')"""


_ALL_ARTICLES = f"articles AS (SELECT row_id, {clean('article')} AS article FROM dataset_info)"
_TITLE = f"regexp_extract(line, '{NUMBERED}', 5)"
_CAPITALS = r"(regexp_matches(line, '\p{Lu}') AND NOT regexp_matches(line, '[\p{Ll}\p{Lt}]'))"
_W = words("line")
_HEADING = f"""CASE WHEN line = '' OR length(line) > 120 OR (ends_with(line, '.') AND {_W} > 3) THEN false
  WHEN {_TITLE} <> '' THEN {words(f"trim({_TITLE})")} BETWEEN 1 AND 12
  WHEN {_W} BETWEEN 2 AND 10 AND {_CAPITALS} THEN true
  WHEN lower(line) IN ({_TITLES}) THEN true
  ELSE {_W} BETWEEN 1 AND 10 AND len(list_filter(string_split(line, ' '), lambda w: regexp_matches(w, '^\\p{{Lu}}'))) * 10 >= {_W} * 6 END"""
_TITLED = r"array_to_string(list_transform(regexp_extract_all(line, '\p{L}+|[^\p{L}]'), lambda r: upper(substr(r, 1, 1)) || lower(substr(r, 2))), '')"
_CLEAN_HEADING = f"CASE WHEN {_TITLE} <> '' THEN trim({_TITLE}) WHEN {_CAPITALS} THEN {_TITLED} ELSE line END"

_SECTIONS = f"""{_VALID}, {_lines("valid")},
 flagged AS (SELECT row_id, pos, line, {_HEADING} AS h FROM lines),
 islands AS (SELECT *, sum(CASE WHEN h THEN 1 ELSE 0 END) OVER (PARTITION BY row_id ORDER BY pos) AS g FROM flagged),
 joined AS (SELECT row_id, g, max(CASE WHEN h THEN {_CLEAN_HEADING} END) AS title, string_agg(line, ' ' ORDER BY pos) FILTER (NOT h) AS content FROM islands GROUP BY row_id, g),
 long AS (SELECT row_id, g, coalesce(title, 'Body') AS section, content, {words("content")} AS n_words FROM joined WHERE content IS NOT NULL),
 sections AS (SELECT row_id, row_number() OVER (PARTITION BY row_id ORDER BY g) - 1 AS section_index, section, content, n_words FROM long WHERE n_words >= 10)"""
_BODY = f"""{_SECTIONS},
 bodies AS (SELECT row_id, section_index, section, content FROM sections
   UNION ALL SELECT row_id, 0, 'Body', article FROM valid WHERE row_id NOT IN (SELECT row_id FROM sections))"""
_CHUNKS = f"""{_BODY},
 split_up AS (SELECT row_id, section_index, section, {sentences("content")} AS s FROM bodies),
 counted AS (SELECT *, list_transform(s, lambda x: {words(norm("x"))}) AS w FROM split_up),
 summed AS (SELECT *, list_transform(range(0, len(s) + 1), lambda i: coalesce(list_sum(w[1:i]), 0)::BIGINT) AS c FROM counted WHERE len(s) > 0),
 fold AS (
   SELECT row_id, section_index, 0::BIGINT AS i, 0::BIGINT AS f, NULL::BIGINT AS a, NULL::BIGINT AS b FROM summed
   UNION ALL
   SELECT t.row_id, t.section_index, i + 1,
     CASE WHEN c[i + 2] - c[f + 1] > 150 AND i > f THEN f + len(list_filter(c[f + 1:i + 1], lambda x: c[i + 1] - x > 30)) ELSE f END,
     CASE WHEN c[i + 2] - c[f + 1] > 150 AND i > f THEN f END,
     CASE WHEN c[i + 2] - c[f + 1] > 150 AND i > f THEN i END
   FROM fold JOIN summed t USING (row_id, section_index) WHERE i < len(s)),
 windows AS (SELECT row_id, section_index, a, b FROM fold WHERE a IS NOT NULL
   UNION ALL SELECT fold.row_id, fold.section_index, f, i FROM fold JOIN summed t USING (row_id, section_index) WHERE i = len(s)),
 cut AS (SELECT row_id, section_index, section, a, {norm("array_to_string(s[a + 1:b], ' ')")} AS text FROM windows JOIN summed USING (row_id, section_index)),
 chunked AS (SELECT row_id, row_number() OVER (PARTITION BY row_id ORDER BY section_index, a) - 1 AS chunk_id, section, text, {words("text")} AS word_count,
   section_index::BIGINT AS section_index, row_number() OVER (PARTITION BY row_id, section_index ORDER BY a) - 1 AS chunk_index_in_section FROM cut)"""

_UNIT = """usable AS (SELECT vec_id, paper_id, split, chunk_gid, embeddings::DOUBLE[] AS e FROM databuildt
   WHERE embeddings IS NOT NULL AND len(embeddings) = 96 AND len(list_filter(embeddings, lambda x: x IS NULL OR isnan(x))) = 0 AND len(list_filter(embeddings, lambda x: x <> 0)) > 0),
 normed AS (SELECT *, greatest(sqrt(list_dot_product(e, e)), 1e-12) AS n FROM usable),
 everyone AS (SELECT vec_id, paper_id, split, chunk_gid, list_transform(e, lambda x: x / n) AS vec FROM normed),
 unit AS (SELECT * FROM everyone QUALIFY row_number() OVER (PARTITION BY chunk_gid ORDER BY vec_id) = 1),
 templates AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS query, list_reverse(vec) AS qvec FROM (SELECT * FROM unit ORDER BY vec_id LIMIT 3))"""
_ASKED = f"""{_UNIT},
 asked AS (SELECT u.*, {keyed("u.paper_id", "3")} AS query FROM unit u),
 scored AS (SELECT a.paper_id, a.chunk_gid, a.vec, list_dot_product(a.vec, t.qvec) AS score FROM asked a JOIN templates t USING (query)),
 ranked AS (SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY score DESC, chunk_gid) AS rank, count(*) OVER (PARTITION BY paper_id) AS n FROM scored)"""


def _mmr(source: str, key: str, k: str) -> str:
    """Three unrolled picks among source (key, chunk_gid, vec, score, rank); picks has (key, chunk_gid, score, pick)."""
    return f"""p1 AS (SELECT {key}, chunk_gid, vec, score, {k} AS k FROM {source} QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY score DESC, rank) = 1),
 m1 AS (SELECT c.{key}, c.chunk_gid, c.vec, c.score, c.rank, list_dot_product(c.vec, p1.vec) AS near FROM {source} c JOIN p1 ON c.{key} = p1.{key} WHERE c.chunk_gid <> p1.chunk_gid),
 p2 AS (SELECT * FROM m1 QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY 0.5 * score - 0.5 * near DESC, rank) = 1),
 m2 AS (SELECT c.{key}, c.chunk_gid, c.score, c.rank, greatest(c.near, list_dot_product(c.vec, p2.vec)) AS near FROM m1 c JOIN p2 ON c.{key} = p2.{key} WHERE c.chunk_gid <> p2.chunk_gid),
 p3 AS (SELECT * FROM m2 QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY 0.5 * score - 0.5 * near DESC, rank) = 1),
 picks AS (SELECT {key}, chunk_gid, score, 1::BIGINT AS pick FROM p1
   UNION ALL SELECT p2.{key}, p2.chunk_gid, p2.score, 2 FROM p2 JOIN p1 ON p1.{key} = p2.{key} WHERE p1.k >= 2
   UNION ALL SELECT p3.{key}, p3.chunk_gid, p3.score, 3 FROM p3 JOIN p1 ON p1.{key} = p3.{key} WHERE p1.k >= 3)"""


_K = "least(3, greatest(1, n - 2))"
_CLEAN_PICKS = f"{_ASKED}, cand AS (SELECT * FROM ranked WHERE rank <= least(greatest(5 * {_K}, 50), n)), {_mmr('cand', 'paper_id', _K)}"
_SEARCH = f"""{_UNIT}, pairs AS (SELECT query AS query_id, chunk_gid, vec, list_dot_product(vec, qvec) AS score FROM unit, templates),
 best AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_gid) AS rank FROM pairs QUALIFY rank <= 50), {_mmr("best", "query_id", "3")}"""
_HUNDREDTH = f"""{_UNIT}, asked AS (SELECT vec_id AS query_id, vec AS qvec FROM unit WHERE vec_id % 100 = 0),
 pairs AS (SELECT query_id, chunk_gid, vec, list_dot_product(vec, qvec) AS score FROM unit, asked),
 picks AS (SELECT query_id, chunk_gid, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_gid) AS pick FROM pairs QUALIFY pick <= 10)"""
_HARD = f"""{_SEARCH}, hard AS (SELECT query_id, chunk_gid, row_number() OVER (PARTITION BY query_id ORDER BY md5('42|' || query_id || '|' || chunk_gid), chunk_gid) AS pos
   FROM best b WHERE rank > 3 AND NOT EXISTS (SELECT 1 FROM picks p WHERE p.query_id = b.query_id AND p.chunk_gid = b.chunk_gid) QUALIFY pos <= 2)"""

_TEXTS = """texts AS (SELECT id AS chunk_gid, min(text) AS text FROM retrieval_tokenizer GROUP BY id)"""
_CORPUS = f"""{_UNIT}, {_TEXTS},
 chunks AS (SELECT *, TRY_CAST(string_split(paper_id, '_')[-1] AS INTEGER) AS idx FROM unit),
 docs AS (SELECT c.*, t.text FROM chunks c JOIN texts t USING (chunk_gid) WHERE {safe("t.text")} <> ''),
 first_papers AS (SELECT paper_id FROM docs WHERE split = 'train' AND idx < 500 GROUP BY paper_id HAVING count(*) >= 3),
 pool AS (SELECT paper_id, chunk_gid, vec FROM docs WHERE split = 'train' AND paper_id IN (SELECT paper_id FROM first_papers)),
 used AS (SELECT paper_id, min(split) AS split, count(*) AS num_chunks, count(text) AS num_documents, {keyed("paper_id", "3")} AS query
   FROM (SELECT c.paper_id, c.split, d.text FROM chunks c LEFT JOIN docs d USING (chunk_gid)) GROUP BY paper_id
   HAVING count(text) > 0 AND count(*) >= CASE WHEN min(split) IN ('train', 'validation') THEN {{least}} ELSE 1 END),
 sims AS (SELECT query, paper_id, chunk_gid, list_dot_product(vec, qvec) AS sim FROM pool, templates),
 members AS (SELECT DISTINCT paper_id FROM pool),
 scopes AS (SELECT paper_id, CASE WHEN paper_id IN (SELECT paper_id FROM members) THEN 'paper:' || paper_id ELSE 'template:' || query END AS scope FROM used),
 candidates AS (SELECT 'template:' || query AS scope, paper_id, chunk_gid, sim FROM sims
   UNION ALL SELECT 'paper:' || u.paper_id, s.paper_id, s.chunk_gid, s.sim FROM used u JOIN sims s USING (query) WHERE u.paper_id IN (SELECT paper_id FROM members) AND u.paper_id <> s.paper_id),
 levels AS (SELECT scope, quantile_cont(sim, 0.25) AS p25, quantile_cont(sim, 0.5) AS p50, quantile_cont(sim, 0.9) AS p90, count(*) AS n FROM candidates GROUP BY scope)"""
_ANY = _CORPUS.replace("{least}", "1")
_ENOUGH = _CORPUS.replace("{least}", "3")
_BANDS = {"cross_doc_easy": "sim >= p50 AND sim < p90", "cross_doc_hard": "sim <= p25", "cross_document": "true"}


def _draw(mode: str, name: str) -> str:
    fallback = f"CASE WHEN m < 2 THEN '{mode}_fallback_random' ELSE '{mode}' END" if mode != "cross_document" else f"'{mode}'"
    return f"""{name}_band AS (SELECT c.*, ({_BANDS[mode]}) AS inside FROM candidates c JOIN levels USING (scope)),
 {name}_count AS (SELECT *, count(*) FILTER (inside) OVER (PARTITION BY scope) AS m FROM {name}_band),
 {name}_placed AS (SELECT scope, chunk_gid, {fallback} AS noise_source, row_number() OVER (PARTITION BY scope ORDER BY md5('42|{mode}|' || chunk_gid), chunk_gid) - 1 AS at,
   count(*) OVER (PARTITION BY scope) AS size FROM {name}_count WHERE inside OR m < 2),
 {name}_sizes AS (SELECT scope, max(size) AS size FROM {name}_placed GROUP BY scope),
 {name}_asked AS (SELECT paper_id, scope, size, {keyed(f"'42|' || paper_id || '|{mode}'", "size")} AS start, unnest([1, 2]) AS pos FROM scopes JOIN {name}_sizes USING (scope)),
 {name} AS (SELECT a.paper_id, p.chunk_gid, a.pos::BIGINT AS pos, p.noise_source FROM {name}_asked a JOIN {name}_placed p ON p.scope = a.scope AND p.at = (a.start + a.pos - 1) % a.size WHERE a.pos <= a.size)"""


def _retrieved(noise_k: int) -> str:
    k = f"least(3, greatest(1, n - {noise_k}))"
    return f"""doc_scored AS (SELECT d.paper_id, d.chunk_gid, d.vec, list_dot_product(d.vec, t.qvec) AS score FROM docs d JOIN used u USING (paper_id) JOIN templates t USING (query)),
 doc_ranked AS (SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY score DESC, chunk_gid) AS rank, count(*) OVER (PARTITION BY paper_id) AS n FROM doc_scored),
 cand AS (SELECT * FROM doc_ranked WHERE rank <= least(greatest(5 * {k}, 50), n)), {_mmr("cand", "paper_id", k)}"""


def _mixed(mode: str, noise: str, name: str) -> str:
    return f"""{name}_all AS (SELECT paper_id, chunk_gid, pick AS pos, false AS is_noise FROM picks WHERE paper_id IN (SELECT paper_id FROM {noise})
   UNION ALL SELECT d.paper_id, d.chunk_gid, d.pos + m.n, true FROM {noise} d JOIN (SELECT paper_id, max(pick) AS n FROM picks GROUP BY paper_id) m USING (paper_id)),
 {name} AS (SELECT a.paper_id, row_number() OVER (PARTITION BY a.paper_id ORDER BY md5('42|order|{mode}|' || a.paper_id || '|' || a.chunk_gid), a.pos) AS pos, a.chunk_gid, a.is_noise, s.noise_source
   FROM {name}_all a JOIN (SELECT paper_id, min(noise_source) AS noise_source FROM {noise} GROUP BY paper_id) s USING (paper_id))"""


def _truncated(x: str, n: int = 256) -> str:
    return f"array_to_string(string_split({norm(x)}, ' ')[1:{n}], ' ')"


_TARGETS = f"{_VALID}, targets AS (SELECT paper_id, abstract FROM valid QUALIFY row_number() OVER (PARTITION BY paper_id ORDER BY row_id) = 1)"


def _example(rows: str, kind: str, mode: str | None, splits: str) -> str:
    shown = "NULL::VARCHAR" if mode is None else f"'{mode}'"
    return f"""SELECT 'summarize: question: ' || {template("u.query")} || ' context: ' || string_agg({_truncated("t.text")}, ' ' ORDER BY r.pos) FILTER (r.pos <= 3) AS input_text,
   any_value(g.abstract) AS target_text, r.paper_id, any_value(u.split) AS split, '{kind}' AS sample_type, count(*) AS num_contexts, {shown} AS noise_mode,
   {"NULL::VARCHAR" if mode is None else "min(r.noise_source)"} AS noise_source, any_value(u.num_chunks) AS num_chunks, any_value(u.num_documents) AS num_documents,
   count(*) FILTER (r.is_noise AND r.pos <= 3) AS n_noise_used
 FROM {rows} r JOIN used u USING (paper_id) JOIN texts t USING (chunk_gid) JOIN targets g USING (paper_id) WHERE u.split = {splits} GROUP BY r.paper_id, u.query"""


_CLEAN_ROWS = "clean_rows AS (SELECT paper_id, chunk_gid, pick AS pos, false AS is_noise, NULL::VARCHAR AS noise_source FROM picks)"
_TRAIN = f"""WITH {_ENOUGH}, {_TARGETS}, {_retrieved(2)}, {_draw("cross_doc_easy", "easy")}, {_mixed("cross_doc_easy", "easy", "easy_rows")}, {_CLEAN_ROWS},
 examples AS ({_example("clean_rows", "clean", None, "'train'")} UNION ALL {_example("easy_rows", "noisy", "cross_doc_easy", "'train'")})"""
_EXAMPLE = "input_text, target_text, paper_id, split, sample_type, num_contexts, noise_mode, noise_source, num_chunks, num_documents, n_noise_used"

_CONTEXTS = f"""items AS (SELECT source_doc_id, chunk_id, row_id, section, text, row_number() OVER (PARTITION BY source_doc_id ORDER BY chunk_id, row_id) AS place FROM rulebase_chunkforpdf WHERE source_doc_id IS NOT NULL),
 raw AS (SELECT source_doc_id, row_number() OVER (PARTITION BY source_doc_id ORDER BY place) AS pos, {_truncated("text")} AS context FROM items WHERE {safe("text")} <> ''),
 ids AS (SELECT DISTINCT source_doc_id FROM items)"""
_BUDGET = "least(" + words(norm("context")) + ", 256)"

_PAIRS = f"{_VALID}, scored_pairs AS (SELECT row_id, split, article AS prediction, abstract AS reference FROM valid)"


def _tokens(x: str) -> str:
    return f"list_filter(string_split(trim(regexp_replace(lower({x}), '[^a-z0-9]+', ' ', 'g'), ' '), ' '), lambda w: w <> '')"


def _f1(c: str, p: str, r: str) -> str:
    precision, recall = f"(CASE WHEN {p} > 0 THEN {c} / {p} ELSE 0 END)", f"(CASE WHEN {r} > 0 THEN {c} / {r} ELSE 0 END)"
    return f"CASE WHEN {precision} + {recall} > 0 THEN 2 * {precision} * {recall} / ({precision} + {recall}) ELSE 0 END"


def _rouge(n: int, name: str) -> str:
    grams = lambda t: t if n == 1 else f"list_transform(range(1, len({t})), lambda i: {t}[i] || ' ' || {t}[i + 1])"
    return f"""{name}_t AS (SELECT row_id, {_tokens("prediction")} AS pt, {_tokens("reference")} AS rt FROM scored_pairs),
 {name}_g AS (SELECT row_id, {grams("pt")} AS p, {grams("rt")} AS r FROM {name}_t),
 {name}_p AS (SELECT row_id, g, count(*) AS n FROM (SELECT row_id, unnest(p) AS g FROM {name}_g) GROUP BY ALL),
 {name}_r AS (SELECT row_id, g, count(*) AS n FROM (SELECT row_id, unnest(r) AS g FROM {name}_g) GROUP BY ALL),
 {name}_c AS (SELECT row_id, sum(least(a.n, b.n))::DOUBLE AS c FROM {name}_p a JOIN {name}_r b USING (row_id, g) GROUP BY row_id),
 {name} AS (SELECT row_id, {_f1("coalesce(c, 0)::DOUBLE", "len(p)", "len(r)")} AS score FROM {name}_g LEFT JOIN {name}_c USING (row_id))"""


_LABELS = f"list_transform(string_split({norm('target_text')}, ' '), lambda w, i: CASE WHEN (i - 1) % 5 = 4 THEN -100 ELSE length(w) END)"


# The output sets and the queries whose examples they hold.
_SETS = (
    ("'train'", "training_examples"),
    ("'valid'", "validation_examples"),
    ("CASE noise_mode WHEN 'cross_doc_easy' THEN 'test_noisy_easy' WHEN 'cross_doc_hard' THEN 'test_noisy_hard' ELSE 'test_clean' END", "test_examples"),
)


def sql() -> dict[str, str]:
    """SQL by the name of the query."""
    out = {
        "clean_field": f"SELECT row_id, {clean('article')} AS article, {clean('abstract')} AS abstract FROM dataset_info",
        "valid_papers": f"WITH {_VALID} SELECT row_id, split FROM valid",
        "normalize_space": f"SELECT doc_id, {norm('text')} AS text FROM documents",
        "safe_strip": f"SELECT id, {safe('text')} AS text FROM retrieval_tokenizer",
        "word_count": f"SELECT doc_id, {words(norm('text'))} AS n_words FROM documents",
        "token_estimate": f"SELECT row_id, {words(norm('article'))} * 1.3 > 1536 AS truncated FROM dataset_info",
        "line_split": f"WITH {_ALL_ARTICLES}, {_lines('articles')} SELECT row_id, pos, line FROM lines",
        "heading_flag": f"WITH {_ALL_ARTICLES}, {_lines('articles')} SELECT row_id, pos, {_HEADING} AS is_heading FROM lines",
        "heading_title": f"WITH {_ALL_ARTICLES}, {_lines('articles')} SELECT row_id, pos, {_CLEAN_HEADING} AS title FROM lines WHERE {_HEADING}",
        "sentence_split": f"WITH s AS (SELECT row_id, {sentences('text')} AS l FROM rulebase_chunkforpdf WHERE text IS NOT NULL) SELECT row_id, unnest(range(0, len(l)))::BIGINT AS pos, unnest(l) AS sentence FROM s",
        "choose_query": f"SELECT row_id, paper_id, {template(keyed('paper_id', '3'))} AS query FROM dataset_info",
        "chunk_gid": "SELECT row_id, coalesce(source_doc_id, 'unk') || CASE WHEN chunk_id IS NULL THEN '' ELSE '_' || chunk_id END AS gid FROM rulebase_chunkforpdf",
        "id_suffix": "SELECT row_id, TRY_CAST(string_split(paper_id, '_')[-1] AS BIGINT) AS suffix FROM dataset_info",
        "section_header_prefix": f"SELECT row_id, CASE WHEN {safe('section')} <> '' THEN '[' || {safe('section')} || '] ' || text ELSE text END AS text FROM rulebase_chunkforpdf",
        "sections": f"WITH {_SECTIONS} SELECT row_id, section_index, section, content, n_words FROM sections",
        "section_fallback": f"WITH {_SECTIONS} SELECT row_id, 'Body' AS section, article AS content FROM valid WHERE row_id NOT IN (SELECT row_id FROM sections)",
        "chunks": f"WITH RECURSIVE {_CHUNKS} SELECT row_id, chunk_id, section, text, word_count, section_index, chunk_index_in_section FROM chunked",
        "chunk_overlap": f"WITH RECURSIVE {_CHUNKS} SELECT row_id, section_index, count(*) AS n_chunks, sum(word_count)::BIGINT AS n_words, max(word_count) AS longest FROM chunked GROUP BY ALL",
        "document_counts": f"WITH RECURSIVE {_CHUNKS} SELECT v.row_id, (SELECT count(*) FROM bodies b WHERE b.row_id = v.row_id) AS num_sections, (SELECT count(*) FROM chunked c WHERE c.row_id = v.row_id) AS num_chunks FROM valid v",
        "min_chunks_filter": f"WITH RECURSIVE {_CHUNKS} SELECT row_id, chunk_id, num_chunks FROM (SELECT row_id, chunk_id, count(*) OVER (PARTITION BY row_id) AS num_chunks FROM chunked) WHERE num_chunks >= 3",
        "paper_ids": f"WITH {_VALID} SELECT row_id, split || '_' || (row_number() OVER (PARTITION BY split ORDER BY row_id) - 1) AS made_id FROM valid",
        "make_documents": f"SELECT row_id, coalesce(source_doc_id, 'unk') || CASE WHEN chunk_id IS NULL THEN '' ELSE '_' || chunk_id END AS id, text FROM rulebase_chunkforpdf WHERE {safe('text')} <> ''",
        "rejected_papers": f"SELECT row_id, 'chunk' AS stage, concat_ws(', ', CASE WHEN {clean('article')} = '' THEN 'empty article' END, CASE WHEN {clean('abstract')} = '' THEN 'empty abstract' END) AS reason FROM dataset_info WHERE {clean('article')} = '' OR {clean('abstract')} = ''",
        "l2_normalize": f"WITH {_UNIT} SELECT vec_id, unnest(range(0, 96))::BIGINT AS pos, round(unnest(vec), 6) AS x FROM everyone",
        "all_scores": f"WITH {_UNIT} SELECT vec_id, query, round(list_dot_product(vec, qvec), 6) AS score FROM unit, templates",
        "masked_mean_pool": "WITH r AS (SELECT split, list_transform(embeddings, lambda x: coalesce(x, 0)::DOUBLE) AS e, len(list_filter(embeddings, lambda x: x IS NULL OR isnan(x))) = 0 AND len(list_filter(embeddings, lambda x: x <> 0)) > 0 AS ok FROM databuildt WHERE len(embeddings) = 96), d AS (SELECT split, ok, unnest(range(0, 96)) AS pos, unnest(e) AS x FROM r) SELECT split, pos::BIGINT AS pos, round(sum(CASE WHEN ok THEN x ELSE 0 END) / greatest(count(*) FILTER (ok), 1e-9), 6) AS x FROM d GROUP BY split, pos",
        "hashing_encode": f"WITH w AS (SELECT item_id, unnest(list_filter(string_split(lower({norm('target_text')}), ' '), lambda w: w <> '')) AS w FROM heldout_examples), h AS (SELECT item_id, ('0x' || substr(md5(w), 1, 8))::BIGINT AS h FROM w), s AS (SELECT item_id, h % 64 AS pos, sum(CASE WHEN (h // 65536) % 2 = 0 THEN 1.0 ELSE -1.0 END)::DOUBLE AS x FROM h GROUP BY ALL), g AS (SELECT i.item_id, p.pos, coalesce(x, 0) AS x FROM heldout_examples i CROSS JOIN (SELECT unnest(range(0, 64)) AS pos) p LEFT JOIN s ON s.item_id = i.item_id AND s.pos = p.pos) SELECT item_id, pos::BIGINT AS pos, round(x / greatest(sqrt(sum(x * x) OVER (PARTITION BY item_id)), 1e-12), 6) AS x FROM g",
        "candidate_k_rule": f"WITH {_UNIT}, c AS (SELECT paper_id, count(*) AS n FROM unit GROUP BY paper_id) SELECT paper_id, n, {_K} AS k, least(greatest(5 * {_K}, 50), n) AS candidates FROM c",
        "topk_candidates": f"WITH {_ASKED} SELECT paper_id, chunk_gid, rank, round(score, 6) AS score FROM ranked WHERE rank <= 50",
        "pairwise_sim": f"WITH {_ASKED}, c AS (SELECT * FROM ranked WHERE rank <= 50) SELECT a.paper_id, a.rank AS rank_a, b.rank AS rank_b, round(list_dot_product(a.vec, b.vec), 6) AS similarity FROM c a JOIN c b USING (paper_id)",
        "mmr_select": f"WITH {_CLEAN_PICKS} SELECT paper_id, chunk_gid, round(score, 6) AS score, pick AS rank FROM picks",
        "mmr_search": f"WITH {_SEARCH} SELECT query_id, chunk_gid, round(score, 6) AS score, pick AS rank FROM picks",
        "negatives_random": f"WITH {_SEARCH}, d AS (SELECT q.query AS query_id, u.chunk_gid, row_number() OVER (PARTITION BY q.query ORDER BY md5('42|' || u.chunk_gid), u.chunk_gid) AS pos FROM templates q, unit u WHERE NOT EXISTS (SELECT 1 FROM picks p WHERE p.query_id = q.query AND p.chunk_gid = u.chunk_gid)) SELECT query_id, chunk_gid, pos FROM d WHERE pos <= 2",
        "negatives_hard": f"WITH {_HARD} SELECT query_id, chunk_gid, pos FROM hard",
        "training_contexts": f"WITH {_HARD} SELECT query_id, pick AS pos, chunk_gid, false AS is_noise FROM picks UNION ALL SELECT query_id, pos + 3, chunk_gid, true FROM hard",
        "noise_pool": f"WITH {_ANY} SELECT paper_id, chunk_gid FROM pool",
        "noise_percentiles": f"WITH {_ANY} SELECT scope, round(p25, 6) AS p25, round(p50, 6) AS p50, round(p90, 6) AS p90, n FROM levels",
        "noise_bands": f"WITH {_ANY} SELECT scope, 'cross_doc_easy' AS mode, count(*) FILTER (sim >= p50 AND sim < p90) AS inside FROM candidates JOIN levels USING (scope) GROUP BY scope UNION ALL SELECT scope, 'cross_doc_hard', count(*) FILTER (sim <= p25) FROM candidates JOIN levels USING (scope) GROUP BY scope",
        "noise_fallback": f"WITH {_ANY} SELECT scope, 'cross_doc_hard_fallback_random' AS noise_source, count(*) AS n FROM candidates GROUP BY scope",
        "noise_sample": f"WITH {_ANY}, {_draw('cross_doc_easy', 'easy')} SELECT paper_id, chunk_gid, pos, noise_source FROM easy",
        "noise_random": f"WITH {_ANY}, {_draw('cross_document', 'any_noise')} SELECT paper_id, chunk_gid, pos, noise_source FROM any_noise",
        "noisy_contexts": f"WITH {_ANY}, {_retrieved(2)}, {_draw('cross_doc_hard', 'hard')}, {_mixed('cross_doc_hard', 'hard', 'hard_rows')} SELECT paper_id, pos, chunk_gid, is_noise, noise_source FROM hard_rows",
        "format_contexts": f"WITH {_CONTEXTS} SELECT source_doc_id, coalesce(string_agg(context, ' || ' ORDER BY pos), '') AS contexts FROM ids LEFT JOIN (SELECT * FROM raw WHERE pos <= 3) USING (source_doc_id) GROUP BY source_doc_id",
        "format_items": f"WITH {_CONTEXTS}, f AS (SELECT source_doc_id, place, CASE WHEN {safe('section')} <> '' THEN '[' || {safe('section')} || '] ' || {safe('text')} ELSE {safe('text')} END AS x FROM items WHERE place <= 3 AND {safe('text')} <> '') SELECT source_doc_id, coalesce(string_agg({_truncated('x')}, ' || ' ORDER BY place), '') AS contexts FROM ids LEFT JOIN f USING (source_doc_id) GROUP BY source_doc_id",
        "truncate_context": f"SELECT doc_id, {_truncated('text', 20)} AS text FROM documents",
        "budget_prefix": f"WITH {_CONTEXTS}, r AS (SELECT source_doc_id, sum({_BUDGET}) OVER (PARTITION BY source_doc_id ORDER BY pos) AS used FROM raw) SELECT source_doc_id, count(used) AS n, count(*) FILTER (used <= 1200) AS kept FROM ids LEFT JOIN r USING (source_doc_id) GROUP BY source_doc_id",
        "build_input_plain": f"SELECT row_id, CASE WHEN {safe('abstract')} <> '' THEN 'summarize: ' || {safe('abstract')} END AS input_text FROM dataset_info",
        "build_input_rag": f"WITH {_CONTEXTS}, r AS (SELECT source_doc_id, pos, context, sum({_BUDGET}) OVER (PARTITION BY source_doc_id ORDER BY pos) AS used FROM raw WHERE pos <= 6) SELECT source_doc_id, 'summarize: question: ' || {template(keyed('source_doc_id', '3'))} || coalesce(' context: ' || string_agg(context, ' ' ORDER BY pos) FILTER (used <= 1200), '') AS input_text FROM ids LEFT JOIN r USING (source_doc_id) GROUP BY source_doc_id",
        "training_examples": f"{_TRAIN} SELECT {_EXAMPLE} FROM examples",
        "validation_examples": f"WITH {_ENOUGH}, {_TARGETS}, {_retrieved(0)}, {_CLEAN_ROWS} {_example('clean_rows', 'clean', None, chr(39) + 'validation' + chr(39))}",
        "test_examples": f"WITH {_ANY}, {_TARGETS}, {_retrieved(2)}, {_draw('cross_doc_easy', 'easy')}, {_mixed('cross_doc_easy', 'easy', 'easy_rows')}, {_draw('cross_doc_hard', 'hard')}, {_mixed('cross_doc_hard', 'hard', 'hard_rows')}, {_CLEAN_ROWS} {_example('clean_rows', 'clean', None, chr(39) + 'test' + chr(39))} UNION ALL {_example('easy_rows', 'noisy', 'cross_doc_easy', chr(39) + 'test' + chr(39))} UNION ALL {_example('hard_rows', 'noisy', 'cross_doc_hard', chr(39) + 'test' + chr(39))}",
        "sample_type_counts": f"{_TRAIN} SELECT sample_type, count(*) AS n FROM examples GROUP BY sample_type",
        "pair_rates": f"{_TRAIN} SELECT split, count(*) FILTER (sample_type = 'clean') AS n_clean, count(*) FILTER (sample_type = 'noisy') AS n_noisy, round(100.0::DOUBLE * n_noisy / greatest(n_clean, 1), 4) AS rate FROM examples GROUP BY split",
        "required_fields": "SELECT id, 'target_text' AS missing FROM retrieval_tokenizer WHERE text IS NULL",
        "rouge1": f"WITH {_PAIRS}, {_rouge(1, 'one')} SELECT row_id, round(score, 6) AS score FROM one",
        "rouge2": f"WITH {_PAIRS}, {_rouge(2, 'two')} SELECT row_id, round(score, 6) AS score FROM two",
        "metrics_summary": f"WITH {_PAIRS}, {_rouge(1, 'one')}, {_rouge(2, 'two')} SELECT split AS eval_set, round(avg(one.score), 4) AS rouge1, round(avg(two.score), 4) AS rouge2, count(*) AS n_pairs FROM scored_pairs JOIN one USING (row_id) JOIN two USING (row_id) GROUP BY split",
        "label_unmask": f"WITH l AS (SELECT item_id, list_transform({_LABELS}, lambda x: CASE WHEN x = -100 THEN 0 ELSE x END) AS l FROM heldout_examples) SELECT item_id, unnest(range(0, len(l)))::BIGINT AS pos, unnest(l)::BIGINT AS label FROM l",
        "gen_len": f"SELECT split, round(avg(len(list_filter({_LABELS}, lambda x: x <> -100 AND x <> 0))), 4) AS gen_len FROM heldout_examples GROUP BY split",
        "padded_batches": f"WITH l AS (SELECT item_id, source, {_LABELS} AS l FROM heldout_examples), m AS (SELECT source, ceil(max(len(l)) / 8.0)::BIGINT * 8 AS n FROM l GROUP BY source) SELECT item_id, n AS padded, (len(list_filter(l, lambda x: x = -100)) + n - len(l))::BIGINT AS masked FROM l JOIN m USING (source)",
        "search_hundredth": f"WITH {_HUNDREDTH} SELECT query_id, chunk_gid, round(score, 6) AS score, pick AS rank FROM picks",
        "retriever_contexts": f"WITH {_HARD}, every AS (SELECT query_id, pick AS pos, chunk_gid, false AS is_noise FROM picks UNION ALL SELECT query_id, pos + 3, chunk_gid, true FROM hard) SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY md5('42|order|' || query_id || '|' || chunk_gid), pos) AS pos, chunk_gid, is_noise FROM every",
        "noise_empty_pool": f"WITH {_ANY}, {_retrieved(2)} SELECT paper_id, pick AS pos, chunk_gid, false AS is_noise, 'none' AS noise_source, false AS has_true_noise FROM picks",
        "jsonl_round_trip": "SELECT item_id::VARCHAR AS paper_id, split, text AS input_text, target_text, NULL::VARCHAR AS noise_mode FROM heldout_examples",
        "tsv_round_trip": f"WITH {_VALID} SELECT {norm('article')} AS article, {norm('abstract')} AS abstract FROM valid",
        "parquet_split": f"WITH {_VALID} SELECT article, abstract FROM valid WHERE split = 'validation'",
        "arrow_split": f"WITH {_VALID} SELECT article, abstract FROM valid WHERE split = 'test'",
        "optional_sets": "SELECT name, count(*) AS n, count(DISTINCT text) AS n_texts FROM heldout_examples h JOIN (VALUES ('train', 'validation'), ('valid', 'test'), ('again', 'test')) s(name, split) ON s.split = h.split GROUP BY name",
        "from_rows": "SELECT * FROM (VALUES ('a', NULL, 2::BIGINT), (NULL, 'b', NULL), (NULL, NULL, NULL)) t(input_text, target_text, num_chunks)",
        "metrics_report": f"WITH {_PAIRS}, {_rouge(1, 'one')}, m AS (SELECT split, round(avg(score), 4) AS s FROM scored_pairs JOIN one USING (row_id) GROUP BY split) SELECT eval_set, coalesce(printf('%.4f', s), 'N/A') AS score FROM (VALUES ('validation'), ('test'), ('noisy')) e(eval_set) LEFT JOIN m ON m.split = e.eval_set",
        "decoded_ids": f"SELECT item_id, {norm('target_text')} AS text FROM heldout_examples",
        "tokenized_pairs": f"SELECT array_to_string(list_transform(string_split({norm('text')}, ' ')[1:40], lambda w: length(w)), ' ') AS input_ids, least(40, {words(norm('text'))}) AS n, array_to_string(list_transform(string_split({norm('target_text')}, ' ')[1:10], lambda w: length(w)), ' ') AS labels FROM heldout_examples",
    }
    sets = " UNION ALL ".join(f"SELECT {name} AS output_set, paper_id, num_contexts, sample_type, split FROM ({out[query]})" for name, query in _SETS)
    out["output_sets"] = f"SELECT output_set, count(*) AS n, count(DISTINCT paper_id) AS n_papers, round(avg(num_contexts), 6) AS mean_contexts FROM ({sets}) GROUP BY output_set"
    out["build_report"] = f"""WITH every AS ({sets}), tested AS (SELECT count(*) FILTER (output_set = 'test_clean') AS m, count(*) FILTER (output_set = 'test_noisy_easy') AS e, count(*) FILTER (output_set = 'test_noisy_hard') AS h FROM every)
      SELECT output_set || ' ' || sample_type AS line, count(*) AS n, NULL::VARCHAR AS rate FROM every GROUP BY ALL
      UNION ALL SELECT 'rate test_noisy_easy', e, printf('%d/%d (%.1f%%)', e, m, 100.0::DOUBLE * e / greatest(m, 1)) FROM tested
      UNION ALL SELECT 'rate test_noisy_hard', h, printf('%d/%d (%.1f%%)', h, m, 100.0::DOUBLE * h / greatest(m, 1)) FROM tested"""
    return out | {"document_counts_sql": out["document_counts"]}
