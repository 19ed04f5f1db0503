"""Text functions as Column expressions.

White space means what a Unicode-aware trim removes: the ASCII controls 9 to 13
and 28 to 31, the space, and the wider Unicode spaces.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from quireflow.config import QUERY_TEMPLATES, ChunkConfig

SPACE = r"[\x{9}-\x{d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_SPACES = "".join(map(chr, [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
LINE_END = r"\r\n|[\n\x{b}\x{c}\r\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}]"
# Fixed value: how a numbered heading is written.
NUMBERED = r"^((\p{Nd}+(\.\p{Nd}+){0,3})|([IVXLCDM]+))[\.\)\:]?\s+([A-Za-z].+)$"
# Titles that are headings by themselves.
SECTION_TITLES = (
    "abstract", "introduction", "background", "related work", "literature review", "method", "methods", "methodology",
    "experiments", "results", "discussion", "conclusion", "limitations", "future work", "references", "appendix",
)


def let(column: Column, then: Callable[[Column], Column]) -> Column:
    """then(column) with the column computed once, however often `then` names it."""
    return F.get(F.transform(F.array(column), then), F.lit(0))


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(_SPACES))


def safe_strip(text: Column) -> Column:
    """Stripped text; empty for null."""
    return F.coalesce(strip(text), F.lit(""))


def clean_field(text: Column) -> Column:
    """A field with the two-character mark `/n` as a line feed, stripped; empty for null."""
    return F.coalesce(strip(F.replace(text, F.lit("/n"), F.lit("\n"))), F.lit(""))


def clean_list(items: Column, join_with: str = "\n") -> Column:
    """Items of an array stripped and joined without empty ones; a null item reads None, a null array is empty."""
    texts = F.transform(items, lambda x: strip(F.coalesce(x, F.lit("None"))))
    return F.coalesce(F.array_join(F.filter(texts, lambda x: x != ""), join_with), F.lit(""))


def normalize_space(text: Column) -> Column:
    """White space runs as one space, none at the ends; empty for null."""
    plain = F.translate(text, _SPACES, " " * len(_SPACES))  # far cheaper than a regular expression over all spaces
    return F.coalesce(F.trim(F.regexp_replace(plain, "  +", " ")), F.lit(""))


def words_of(normalized: Column) -> Column:
    """Words of a text that normalize_space returned."""
    return F.when(normalized == "", F.lit(0)).otherwise(F.length(normalized) - F.length(F.replace(normalized, F.lit(" "), F.lit(""))) + 1)


def word_count(text: Column) -> Column:
    return let(normalize_space(text), words_of)


def lines(text: Column) -> Column:
    """Lines of a text without their ends."""
    return F.split(text, LINE_END)


def numbered_title(line: Column) -> Column:
    """The title of a numbered heading line, or an empty string."""
    return F.regexp_extract(line, NUMBERED, 5)


def looks_like_heading(line: Column, config: ChunkConfig = ChunkConfig()) -> Column:
    """Whether a line that normalize_space returned reads like a heading."""

    def decide(n: Column) -> Column:
        words, title = words_of(n), numbered_title(n)
        capital = F.size(F.filter(F.split(n, " "), lambda w: w.rlike(r"^\p{Lu}")))
        return (
            F.when((n == "") | (F.length(n) > config.heading_max_chars) | (n.endswith(".") & (words > 3)), False)
            .when(title != "", words_of(F.trim(title)).between(1, config.heading_max_words))
            .when(words.between(2, 10) & all_capitals(n), True)
            .when(F.lower(n).isin(*SECTION_TITLES), True)
            .otherwise(words.between(1, 10) & (capital * 10 >= words * config.title_ratio_tenths))
        )

    return let(line, decide)


def all_capitals(text: Column) -> Column:
    """Cased letters are there and all upper case."""
    return text.rlike(r"\p{Lu}") & ~text.rlike(r"[\p{Ll}\p{Lt}]")


def title_case(text: Column) -> Column:
    """Each run of letters with a capital and small letters after it."""
    runs = F.regexp_extract_all(text, F.lit(r"(\p{L}+|[^\p{L}])"), 1)
    return F.array_join(F.transform(runs, lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.lower(F.substr(x, F.lit(2))))), "")


def clean_heading(line: Column) -> Column:
    """A heading's title: without its number, or in title case if it is all capitals."""

    def decide(n: Column) -> Column:
        title = numbered_title(n)
        return F.when(title != "", F.trim(title)).when(all_capitals(n), title_case(n)).otherwise(n)

    return let(line, decide)


def split_sentences(text: Column) -> Column:
    """Parts between an end mark and white space before a Latin capital, stripped, without empty ones."""
    parts = F.split(text, rf"(?<=[.!?]){SPACE}+(?=[A-Z])")
    return F.filter(F.transform(parts, strip), lambda x: x != "")


def token_estimate_exceeds(text: Column, most: int) -> Column:
    """Whether a text is likely to be truncated: 1.3 tokens a word."""
    return word_count(text) * F.lit(1.3) > most


def choose_query(paper_id: Column, use_multiple: bool = True, templates: Sequence[str] = QUERY_TEMPLATES) -> Column:
    """A template for a paper, by the hash of its id; the first one if only one is used."""
    return F.get(F.array(*[F.lit(t) for t in templates]), query_index(paper_id, use_multiple, len(templates)))


def query_index(paper_id: Column, use_multiple: bool = True, count: int = len(QUERY_TEMPLATES)) -> Column:
    return keyed_number(paper_id, count).cast("int") if use_multiple else F.lit(0)


def keyed_number(key: Column, below: Column | int) -> Column:
    """A number from 0 that depends only on the key: the start of its hash modulo `below`."""
    return F.pmod(F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long"), F.lit(below) if isinstance(below, int) else below)


def chunk_gid(source_doc_id: Column, chunk_id: Column) -> Column:
    return F.concat_ws("_", F.coalesce(source_doc_id, F.lit("unk")), chunk_id.cast("string"))


def id_suffix(identifier: Column) -> Column:
    """The number after the last underscore; null if there is none."""
    return F.substring_index(identifier, "_", -1).try_cast("int")


def pair_rate(part: Column, whole: Column) -> Column:
    """part / whole in percent, whole being at least one."""
    return F.lit(100.0) * part / F.greatest(whole, F.lit(1))


def with_section_header(section: Column, text: Column) -> Column:
    """[section] text, or the text alone if the section is blank."""
    return let(safe_strip(section), lambda s: F.when(s != "", F.concat(F.lit("["), s, F.lit("] "), text)).otherwise(text))
