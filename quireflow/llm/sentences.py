"""Sentence units of texts in many languages and scripts, as SQL expressions.

Characters that look like ends but aren't (decimals, URLs, initials,
abbreviations, list numbers, ends inside quotes and brackets) are masked with
private-use placeholders, one for each masked character; ends are marked by
expressions for the scripts with spaces, those without and those without end
marks, the marked text is split, and units are restored from the placeholders.
Masks change no position.  Nothing is bounded by a length, and the work follows
the length of the text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Placeholders of masked ends, the Greek question marks, the mark after a unit and those around a quoted or bracketed span.
_MASKED = {c: chr(0xE000 + k) for k, c in enumerate(".!?…。！？｡．")}
_QUESTION = {";": "\ue010", "\u037e": "\ue011"}
_DOT, _GREEK = _MASKED["."], "".join(_QUESTION.values())
_END, _FROM, _TO = "\ue0ff", "\ue0f0", "\ue0f1"
_OWN = "".join(_MASKED.values()) + _GREEK + _END + _FROM + _TO
_SPACES = "".join(map(chr, [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
_BLOCK = 256  # units whose lengths are added up together
_LINE_ENDS = "\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029"
# Ends of sentences that always end one, and those of scripts written without spaces.
_SURE = "؟۔।॥።፧፨។៕။"
_WIDE = "。！？｡．"
_OPEN, _CLOSE = "“«„\"'(\\[{（「『《〈【‹¿¡", "”»“\"'’)\\]}）」』》〉】›"
# Abbreviations whose stop never ends a sentence.
_ALWAYS = (
    "Dr Prof Mr Mrs Ms Mme Mlle St Sr Sra Srta Dra Hr Fr Frau Herr Jr vs cf al eds viz bzw ca resp usf evtl ggf inkl "
    "ex ej env проф г-н акад доц см βλ κ Δρ डॉ श्री د أ lic ing approx aprox Messrs Gen Col Lt Rev Hon"
).split()
# Abbreviations before a number or a bracket.
_BEFORE_NUMBER = "Fig Figs fig figs Eq Eqs eq Sec Secs sec Tab Tabs Tbl No Nos no Nr nr Nº núm art Art Abb Kap Bd S pág págs pag p pp vol Vol ch Ch Ref Refs ref рис Рис табл стр гл σελ εικ Thm Lem Def Prop Alg App".split()
# German months, after which an ordinal's stop is no end.
_MONTHS = "Januar Februar März April Mai Juni Juli August September Oktober November Dezember".split()
# Scripts without end marks: Thai and Lao.
_BARE = "\u0e00-\u0eff"


def _let(column: Column, then: Callable[[Column], Column]) -> Column:
    """then(column) with the column computed once, however often `then` names it."""
    return F.get(F.transform(F.array(column), then), F.lit(0))


def _replace(column: Column, pattern: str, by: str, only_if: str | None = None) -> Column:
    """Replace a pattern, which is only looked for in texts that hold the string only_if."""
    if only_if is None:
        return F.regexp_replace(column, pattern, by)
    return _let(column, lambda c: F.when(F.contains(c, F.lit(only_if)), F.regexp_replace(c, pattern, by)).otherwise(c))


def _replace_where(column: Column, where: str, pattern: str, by: str) -> Column:
    """Replace a pattern, which is only looked for in texts that match another, cheaper one."""
    return _let(column, lambda c: F.when(c.rlike(where), F.regexp_replace(c, pattern, by)).otherwise(c))


def _inside(column: Column, opener: str, closer: str, plain: bool = False) -> Column:
    """Mask ends inside a pair; in scripts with spaces the last one before the closing mark stays."""
    pair = "".join(f"\\{c}" for c in {opener, closer})
    close = f"\\{closer}"
    closing = f"(?<!\\s){close}(?=[\\s,.;:)]|$)" if plain else (f"(?<=\\S){close}" if closer == "“" else close)
    wide = not plain and closer != "“"  # which opens a quote in scripts without spaces

    def mask(span: Column) -> Column:
        for c, by in list(_MASKED.items())[:4]:
            span = _replace(span, f"(?U)\\{c}(?=\\s+[^\\s{pair}])", by, only_if=c)
        others = list(_MASKED)[3:]
        return F.translate(span, "".join(others), "".join(_MASKED[c] for c in others)) if wide else span

    def parts(text: Column) -> Column:
        marked = F.regexp_replace(text, f"(?U)\\{opener}[^{pair}\\n]*+{closing}", f"{_FROM}$0{_TO}")
        spans = F.transform(F.split(marked, _FROM), lambda p: F.when(F.contains(p, F.lit(_TO)), F.concat(mask(F.substring_index(p, _TO, 1)), F.substring_index(p, _TO, -1))).otherwise(p))
        return F.array_join(spans, "")

    return _let(column, lambda c: F.when(F.contains(c, F.lit(closer)), parts(c)).otherwise(c))


def masked(text: Column) -> Column:
    """The text with line ends unified and false ends masked; as long as the text."""
    out = F.translate(text, _OWN, "�" * len(_OWN))
    out = F.translate(out, _LINE_ENDS, "\n" * len(_LINE_ENDS))
    out = _replace(out, "/n", "\n\n", only_if="/n")
    # decimals, URLs, file names and spelled abbreviations: a letter or digit follows at once
    out = F.regexp_replace(out, r"(?U)(?<!\p{Ll}{3})\.(?=[\p{Ll}\p{N}_])|\.(?=[\p{Ll}_]|\p{N}+(?!\p{N}|\s\p{Ll}))|[.](?=[/=&#%,])", _DOT)
    for c in "!?":
        out = _replace(out, rf"(?U)[{c}](?=[\p{{Ll}}\p{{N}}/=&#%])", _MASKED[c], only_if=c)
    # list and section numbers at the start of a line
    out = F.regexp_replace(out, rf"(?m)^([^\S\n]*+(?:[0-9]{{1,3}}(?:{_DOT}[0-9]{{1,3}})*|[IVXLCDM]{{1,6}}|[A-Za-z]))\.(?=\s)", "$1" + _DOT)
    # single letters: initials and parts of abbreviations, but not units after a number
    out = F.regexp_replace(out, r"(?<![\p{L}\p{M}\p{N}])(?<!\p{N}[\s ])(\p{L})\.", "$1" + _DOT)
    names = "|".join(_ALWAYS)
    out = F.regexp_replace(out, rf"(?<![\p{{L}}\p{{M}}\p{{N}}])({names})\.(?!$)", "$1" + _DOT)
    numbered = "|".join(_BEFORE_NUMBER)
    out = F.regexp_replace(out, rf"(?U)(?<![\p{{L}}\p{{M}}\p{{N}}])({numbered})\.(?=\s?[\p{{N}}(\[])", "$1" + _DOT)
    out = _replace(out, rf"(?U)(\d)\.(?=\s(?:{'|'.join(_MONTHS)})\b)", "$1" + _DOT)
    for opener, closer in (("“", "”"), ("«", "»"), ("„", "“"), ("(", ")"), ("（", "）"), ("「", "」"), ("『", "』"), ("《", "》")):
        out = _inside(out, opener, closer)
    out = _inside(out, '"', '"', plain=True)
    # a Greek question mark after Greek letters of the same clause; each clause is read once
    for c, by in _QUESTION.items():
        greek = rf"(?U)((?<![^;.!?\n])(?>[^;.!?\n]*?\p{{IsGreek}}{{2}})[^;.!?\n{_QUESTION[';']}\u037e]*+){c}(?=\s*(?:[\p{{IsGreek}}\p{{Lu}}«“\n]|$))"
        out = _replace_where(out, rf"\p{{IsGreek}}{{2}}[^\n]*{c}", greek, "$1" + by)
    return out


def marked(text: Column) -> Column:
    """The masked text with a mark after each unit."""
    out = masked(text)
    closers = f"(?:[{_CLOSE}]|\\s?»)*+"
    # scripts with spaces: after the end comes white space and no lower-case word or dash
    later = r"(?=\s+(?:[^\s\p{Ll}—–-]|\p{Ll}{1,2}\p{Lu}))"
    # or, where the space is missing, the start of a sentence
    missing = r"(?<=[\p{Ll}\p{Lo}\p{M}\p{N})\]”»\"%{G}][.!?…]{1,3}[”»\")]{0,2}|\p{N}\s\p{Lu}\.)(?=\p{Lu}[\p{Ll}\s]|(?<!…)\p{Lo}|[¿¡«„“]|(?<=\p{Ll}\.)\p{N}+\s\p{Ll}|\p{Lu}\p{Lu}+\p{N})".replace("{G}", _GREEK)
    out = F.regexp_replace(out, f"(?U)[.!?…{_GREEK}]++{closers}(?:{later}|{missing})|[{_SURE}]+{closers}", "$0" + _END)
    out = _replace_where(out, f"[{_WIDE}]", f"[{_WIDE}]+[{_CLOSE}]*", "$0" + _END)
    # a word of a script without end marks, before another one
    bare = rf"(?U)((?<!\S)[^\s{_BARE}]*+[{_BARE}]\S*+)(?<!{_END})(?=\s+[^\s{_BARE}]*+[{_BARE}])"
    out = _replace_where(out, f"[{_BARE}]", bare, "$1" + _END)
    return _replace(out, rf"(?U)([^\s{_END}])(?=\s*\n)(?!\S)", "$1" + _END, only_if="\n")


def _starts(sizes: Column) -> Column:
    """The sum of the sizes before each, by blocks, so that a long array isn't copied for each element."""
    running = lambda start, values: F.aggregate(values, F.array(start), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))
    places = lambda n: F.sequence(F.lit(0), F.greatest(F.floor((n - 1) / _BLOCK), F.lit(0)).cast("int"))
    blocks = _let(sizes, lambda s: F.transform(places(F.size(s)), lambda b: F.slice(s, b * _BLOCK + 1, F.lit(_BLOCK))))

    def summed(parts: Column) -> Column:
        totals = running(F.lit(0).cast("long"), F.transform(parts, lambda p: F.aggregate(p, F.lit(0).cast("long"), lambda acc, x: acc + x)))
        return _let(totals, lambda t: F.flatten(F.transform(parts, lambda p, b: F.slice(running(F.get(t, b), p), 1, F.size(p)))))

    return _let(blocks, summed)


def units(text: Column) -> Column:
    """An array of (unit, start_pos, end_pos) of the text's sentence units, in order; null for a null text.

    Positions count code points from 0; end_pos includes closing marks and
    excludes white space.  A line end, also the mark `/n`, ends a unit.  A blank
    text has none.  The units cover every character that isn't white space.
    Units still have their placeholders.
    """

    def spans(parts: Column) -> Column:
        sizes = F.transform(parts, lambda p: F.length(p).cast("long"))
        return F.transform(
            F.arrays_zip(parts.alias("part"), _starts(sizes).alias("at")),
            lambda s: _let(
                F.ltrim(s["part"], F.lit(_SPACES)),
                lambda left: F.struct(
                    F.rtrim(left, F.lit(_SPACES)).alias("unit"),
                    (s["at"] + F.length(s["part"]) - F.length(left)).alias("start_pos"),
                    (s["at"] + F.length(F.rtrim(s["part"], F.lit(_SPACES)))).alias("end_pos"),
                ),
            ),
        )

    found = _let(F.split(marked(text), _END), spans)
    return F.when(text.isNotNull(), F.filter(found, lambda s: s["end_pos"] > s["start_pos"]))


def sentences(text: Column) -> Column:
    """An array of (start_pos, end_pos), as units."""
    return F.transform(units(text), lambda s: F.struct(s["start_pos"].alias("start_pos"), s["end_pos"].alias("end_pos")))


def restored(text: Column) -> Column:
    """An array of (sentence, start_pos, end_pos): the units with what their placeholders stand for.

    The units of a text that itself holds one of the private marks are cut by position.
    """
    back = {**_MASKED, **_QUESTION}
    whole = lambda s: F.translate(s["unit"], "".join(back.values()), "".join(back))
    cut = lambda s: F.substring(text, (s["start_pos"] + 1).cast("int"), (s["end_pos"] - s["start_pos"]).cast("int"))
    made = lambda part: lambda s: F.struct(part(s).alias("sentence"), s["start_pos"].alias("start_pos"), s["end_pos"].alias("end_pos"))
    return _let(units(text), lambda found: F.when(text.rlike(f"[{_OWN}]"), F.transform(found, made(cut))).otherwise(F.transform(found, made(whole))))


def sentence_rows(df: DataFrame, id_column: str, text_column: str, texts: bool = True) -> DataFrame:
    """(id, position, start_pos, end_pos, sentence), one row for each sentence of every text; without `texts` no sentence.

    Null and blank texts have no rows; repeated rows come out each.  Other
    columns are not read.
    """
    rows = df.select(F.col(id_column).alias("__id"), F.col(text_column).alias("__text"))
    found = (restored if texts else sentences)(F.col("__text"))
    out = rows.select("__id", F.posexplode(found).alias("position", "s"))
    return out.select(F.col("__id").alias(id_column), "position", "s.start_pos", "s.end_pos", *(["s.sentence"] if texts else []))
