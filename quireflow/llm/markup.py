"""Clean text of documents that hold HTML, Markdown, wiki or LaTeX markup.

A text is parsed to one tree in which the constructs of all four formats are
nodes: elements, headings, lists, code, formulas, links, templates.  Paragraphs
pass points for length and commas to their ancestors, discounted by link
density; the best container stays with all that stands beside it but
navigation and blocks of links.  What stays is rendered as lines in which
headings, lists, code and formulas can be told apart.
"""

from __future__ import annotations

import html
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("html", "markdown", "wiki", "latex")
# Element names of HTML.
_ELEMENTS = (
    "a abbr acronym address article aside b big blockquote body br button caption center cite code col colgroup dd del details dfn div dl dt em "
    "figcaption figure font footer form h1 h2 h3 h4 h5 h6 head header hr html i iframe img input ins kbd label li link main mark math meta nav "
    "ol option p pre q s samp script section select small span strike strong style sub summary sup svg table tbody td textarea tfoot th thead "
    "time title tr tt u ul var video"
).split()
_VOID = frozenset("br hr img input link meta col".split())
_SILENT = frozenset("script style head title iframe svg select textarea button".split())
_BLOCKS = frozenset("address article aside blockquote body center dd details div dl dt figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section table tbody td tfoot th thead tr ul".split())
_CONTAINERS = frozenset("article aside blockquote body div footer form header html main nav section table td ul ol dl".split())
_SELF_CLOSING = frozenset("p li tr td th dt dd".split())
_ASIDE = frozenset("nav footer aside".split())
_HEADINGS = {f"h{k}": k for k in range(1, 7)}
_DEEPEST = 200  # elements nested deeper hang under the last one, which loses no text
_DENSE = 0.5  # share of link text beyond which a block beside the content is navigation
_SHORT = 25  # characters under which a paragraph passes no points on

_LINE_END = regex.compile(r"\r\n?|/n|[\x0b\x0c\x85\u2028\u2029]")
_MARK, _AFTER = "\ue200", "\ue201"
_OWN = regex.compile(f"[{_MARK}{_AFTER}]")
_PLACE = regex.compile(f"{_MARK}(\\d+){_AFTER}")

_BRACES = r"(?P<b>\{(?:[^{}]++|(?&b))*+\})"
_TAG = regex.compile(rf"<(/?)({'|'.join(sorted(_ELEMENTS, key=len, reverse=True))})(\s[^<>]*+)?(?<!/)/?>|<!doctype[^<>]*+>", regex.I)
_COMMENT = regex.compile(r"<!--(?:[^-<]++|-(?!->)|<(?!!--))*+-->")
_REFERENCE = regex.compile(r"&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,30});")
_ATTRIBUTE = regex.compile(r"([\w:-]++)\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++))")
_FENCE = regex.compile(r"(?m)^[ \t]*+(```|~~~)[^\n`]*+$\n?(.*?)(?:^[ \t]*+\1[ \t]*+$|\Z)", regex.S)
_TICKS = regex.compile(r"(?<![`\\])`(?![`\s])([^`\n]++)`(?!`)")
_ATX = regex.compile(r"(?m)^ {0,3}(#{1,6})[ \t]++(\S[^\n]*+)$")
_SETEXT = regex.compile(r"(?m)^(?![ \t]*+[|>=-])(?=[^\n]*?\w)([^\n]++)\n[ \t]*+(={3,}+|-{3,}+)[ \t]*+$")
_STRONG = regex.compile(r"(?<![\w*\\])(\*{2,3})(?=[^\s*])([^*\n]++)(?<=[^\s*])\1(?![\w*])")
_EMPHASIS = regex.compile(r"(?<![\w*\\])\*(?=[^\s*])([^*\n]++)(?<=[^\s*])\*(?![\w*])")
_LINK = regex.compile(r"(!?)\[([^\[\]\n]*+)\]\(((?:[^()\s]++|\([^()\s]*+\))++)(?:[ \t]++[\"'][^\"'\n]*+[\"'])?\)")
_RULE_ROW = regex.compile(r"(?m)^[ \t]*+\|?(?:[ \t]*+:?-{3,}+:?[ \t]*+\|)++[ \t]*+(?::?-{3,}+:?)?[ \t]*+$\n?")
_PIPE_ROW = regex.compile(r"(?m)^[ \t]*+\|(?![-+}|])(.*)\|[ \t]*+$")
_WIKI_LINK = regex.compile(r"\[\[([^\[\]\n]++)\]\]")
_CURLY = regex.compile(r"(?<![\\\w}{])\{\{(?=\s*+[\w#:])|\{\{|\}\}")
_QUOTES = regex.compile(r"(?<![\w'`])('{2,5})(?=[^\s'])((?:[^\n']++|'(?!'))++)(?<=[^\s'])\1(?!')")
_WIKI_HEADING = regex.compile(r"(?m)^[ \t]*+(={2,6})[ \t]*+([^=\s][^=\n]*?)[ \t]*+\1[ \t]*+$")
_WIKI_TABLE = regex.compile(r"(?m)^[ \t]*+\{\|[^\n]*+$(.*?)(?:\|\}|\Z)", regex.S)
_COMMAND = regex.compile(r"(?<![\w\\:/.])\\([A-Za-z]{2,}+)(?![\\\w/])\*?[ \t]?")
_ENVIRONMENT = regex.compile(r"\\(begin|end)\s*+\{([A-Za-z]++\*?)\}(?:\[[^\]\n]*+\])?")
# a formula holds no empty line
_DISPLAY = regex.compile(r"(?<![\\$])\$\$((?:[^$\n]++|\$(?!\$)|\n(?![ \t]*\n))++)\$\$|(?<!\\)\\\[((?:[^\\\n]++|\\(?![\[\]])|\n(?![ \t]*\n))++)\\\]")
_PAREN = regex.compile(r"(?<!\\)\\\(((?:[^\\\n]++|\\(?![()])|\n(?![ \t]*\n))++)\\\)")
_INLINE = regex.compile(r"(?<![\\$\w])\$(?=[^\s$])([^$\n]++)(?<=[^\s\\])\$(?![\w$])")
_MATH = regex.compile(r"[\\^_{}=<>+]|^[A-Za-z]'?$|^[A-Za-z]\([A-Za-z]\)$|^\d+[A-Za-z]$")
_VERBATIM = regex.compile(r"\\begin\{(verbatim|lstlisting)\}(.*?)\\end\{\1\}", regex.S)
_EQUATION = regex.compile(r"\\begin\{(equation|align|gather|multline|displaymath|eqnarray|math)(\*?)\}(.*?)\\end\{\1\2\}", regex.S)
_LABEL = regex.compile(r"\\label\{[^{}]*+\}")
_SECTION = regex.compile(rf"\\(part|chapter|section|subsection|subsubsection|paragraph)\*?\s*+(?:\[[^\]\n]*+\])?{_BRACES}")
_LEVELS = {"part": 1, "chapter": 1, "section": 1, "subsection": 2, "subsubsection": 3, "paragraph": 4}
_ARGUMENT = regex.compile(rf"\\(?:text|math)?(?:bf|it|emph|tt|sc|rm|sf|underline|textbf|textit|texttt|textsc|emph|mbox|text|title|author|caption|footnote)\*?\s*+{_BRACES}")
_DROPPED = regex.compile(r"\\(?:label|ref|eqref|cite[a-z]*|bibliography|bibliographystyle|usepackage|documentclass|includegraphics|input|vspace|hspace)\*?\s*+(?:\[[^\]\n]*+\])?\{[^{}]*+\}")
_ITEM = regex.compile(r"(?<![\w\\:/.])\\item\b[ \t]*+")
_REMARK = regex.compile(r"(?m)^[ \t]*+%[^\n]*+\n?|(?<=\S)~(?=\S)|~(?=\s)")
_CATEGORY = regex.compile(r"(?:Category|Categoría|Kategorie|Catégorie|Категория)\s*+:")


@dataclass
class Node:
    """A construct of the parsed text; children are nodes and strings.

    `kind` is its format, empty for the root; `fixed` the text of what isn't
    parsed further (code, formulas, references), `attributes` those of an element.
    """

    name: str
    kind: str = ""
    children: list[Node | str] = field(default_factory=list)
    fixed: str | None = None
    attributes: dict[str, str] = field(default_factory=dict)
    parent: Node | None = None
    score: float = 0.0
    size: int = 0
    linked: int = 0

    def nodes(self) -> list[Node]:
        return [c for c in self.children if isinstance(c, Node)]


def _walk(node: Node) -> Iterator[Node]:
    stack = [node]
    while stack:
        here = stack.pop()
        yield here
        stack.extend(here.nodes())


Build = Callable[[regex.Match], Node | None]


def _split(node: Node, pattern: regex.Pattern, hint: str, build: Build) -> None:
    """Parse the strings under a node by one more pattern; a match for which `build` gives None stays text."""
    for here in list(_walk(node)):
        if here.fixed is not None or not any(isinstance(c, str) and hint in c for c in here.children):
            continue
        out: list[Node | str] = []
        for child in here.children:
            if isinstance(child, Node) or hint not in child:
                out.append(child)
                continue
            at = 0
            for match in pattern.finditer(child):
                made = build(match)
                if made is not None:
                    made.parent = here
                    out += [child[at : match.start()], made] if match.start() > at else [made]
                    at = match.end()
            out += [child[at:]] if at < len(child) else []
        here.children = out


def _code(text: str, block: bool) -> str:
    return f"\n```\n{text.strip(chr(10))}\n```\n" if block else f"`{text}`"


class _Fixed:
    """What isn't parsed further is taken out of the text first, and set into the tree as nodes."""

    def __init__(self) -> None:
        self.kept: list[Node] = []

    def take(self, text: str, pattern: regex.Pattern, hint: str, build: Build) -> str:
        def put(match: regex.Match) -> str:
            node = build(match)
            if node is None:
                return match[0]
            self.kept.append(node)
            return f"{_MARK}{len(self.kept) - 1}{_AFTER}"

        return pattern.sub(put, text) if hint in text else text

    def plain(self, text: str) -> str:
        """A text with what was taken out of it; such a text may itself hold some."""
        while _MARK in text and (new := _PLACE.sub(lambda m: self.kept[int(m[1])].attributes["source"], text)) != text:
            text = new
        return text


def _math(inner: str, display: bool) -> str:
    words = " ".join(inner.split())
    return f"$$ {words} $$" if display else f"${words}$"


def parse(text: str) -> Node:
    """The tree of a text with plain line ends."""
    held = _Fixed()

    def fixed(name: str, kind: str, shown: Callable[[regex.Match], str | None]) -> Build:
        def build(match: regex.Match) -> Node | None:
            out = shown(match)
            return None if out is None else Node(name, kind, fixed=out, attributes={"source": match[0]})

        return build

    # the marks themselves, where a text holds them, are kept like what isn't parsed
    text = held.take(text, _OWN, _MARK if _MARK in text else _AFTER, fixed("character", "", lambda m: m[0]))
    text = held.take(text, _FENCE, "```" if "```" in text else "~~~", fixed("code", "markdown", lambda m: _code(m[2], True)))
    text = held.take(text, _TICKS, "`", fixed("code", "markdown", lambda m: _code(m[1], False)))
    text = held.take(text, _VERBATIM, "\\begin", fixed("code", "latex", lambda m: _code(m[2], True)))
    text = held.take(text, _EQUATION, "\\begin", fixed("formula", "latex", lambda m: f"\n{_math(_LABEL.sub('', m[3]), True)}\n"))
    text = held.take(text, _DISPLAY, "$$" if "$$" in text else "\\[", fixed("formula", "latex", lambda m: _math(m[1] or m[2], True)))
    text = held.take(text, _PAREN, "\\(", fixed("formula", "latex", lambda m: _math(m[1], False)))
    text = held.take(text, _INLINE, "$", fixed("formula", "latex", lambda m: m[0] if _MATH.search(m[1]) else None))
    text = held.take(text, _COMMENT, "<!--", fixed("comment", "html", lambda m: ""))
    text = held.take(text, _REFERENCE, "&", fixed("reference", "html", lambda m: html.unescape(m[0]) if m[0][1] == "#" or m[0][1:] in html.entities.html5 else None))
    root = _elements(text)
    _constructs(root)
    if held.kept:
        def place(match: regex.Match) -> Node | None:
            return held.kept[int(match[1])]

        _split(root, _PLACE, _MARK, place)
        for node in held.kept:
            node.fixed = held.plain(node.fixed or "")
    return root


def _elements(text: str) -> Node:
    """The tree of the HTML elements; an end tag without its start is a node without text."""
    root = here = Node("body")
    depth, at = 0, 0
    for match in _TAG.finditer(text) if "<" in text else ():
        if match.start() > at:
            here.children.append(text[at : match.start()])
        at = match.end()
        name = (match[2] or "!doctype").lower()
        if match[1]:
            node, up = here, 0
            while node is not root and node.name != name:
                node, up = node.parent or root, up + 1
            if node is root:
                here.children.append(Node("!end", "html", parent=here))
            else:
                here, depth = node.parent or root, depth - up - 1
            continue
        if name in _SELF_CLOSING and here.name == name:
            here, depth = here.parent or root, depth - 1  # an end tag that was left out
        attributes = {k.lower(): a or b or c or "" for k, a, b, c in _ATTRIBUTE.findall(match[3] or "")}
        node = Node(name, "html", attributes=attributes, parent=here)
        here.children.append(node)
        if name not in _VOID and name != "!doctype" and depth < _DEEPEST:
            here, depth = node, depth + 1
    if at < len(text):
        here.children.append(text[at:])
    return root


def _constructs(root: Node) -> None:
    """Set the constructs of the other formats into the tree."""

    def inner(name: str, kind: str, group: int | str, **attributes: str) -> Build:
        return lambda m: Node(name, kind, [m[group]] if m[group] else [], attributes=attributes)

    # LaTeX; an argument may hold further commands, so it is parsed until nothing is new
    _split(root, _SECTION, "\\", lambda m: Node(f"h{_LEVELS[m[1]]}", "latex", [m["b"][1:-1]]))
    _split(root, _DROPPED, "\\", lambda m: Node("dropped", "latex", fixed="") if _COMMAND.match(m[0]) else None)
    before = -1
    while before != (before := sum(1 for _ in _walk(root))):
        _split(root, _ARGUMENT, "\\", lambda m: Node("argument", "latex", [m["b"][1:-1]]))
    _split(root, _ITEM, "\\item", lambda m: Node("item", "latex", fixed="\n- "))
    _split(root, _ENVIRONMENT, "\\", lambda m: Node("environment", "latex", fixed="\n"))
    _split(root, _COMMAND, "\\", lambda m: Node("command", "latex", fixed=""))
    # wiki
    _split(root, _WIKI_TABLE, "{|", lambda m: Node("wiki-table", "wiki", [_wiki_rows(m[1])]))
    _templates(root)
    _split(root, _WIKI_HEADING, "==", lambda m: Node(f"h{len(m[1]) - 1}" if len(m[1]) > 1 else "h1", "wiki", [m[2]]))
    _split(root, _WIKI_LINK, "[[", lambda m: Node("link", "wiki", [label] if (label := _wiki_label(m[1])) else []))
    _split(root, _QUOTES, "''", inner("emphasis", "wiki", 2))
    # Markdown
    _split(root, _ATX, "#", lambda m: Node(f"h{len(m[1])}", "markdown", [title] if (title := m[2].rstrip(" \t#")) else []))
    for rule in ("---", "==="):
        _split(root, _SETEXT, rule, lambda m: Node("h1" if m[2][0] == "=" else "h2", "markdown", [m[1].strip()]))
    _split(root, _RULE_ROW, "---", lambda m: Node("rule", "markdown", fixed=""))
    _split(root, _LINK, "](", lambda m: Node("link", "markdown" if m[1] or regex.search(r"[/.#:]", m[3]) else "", [m[2]] if m[2] else []))
    _split(root, _STRONG, "**", inner("strong", "markdown", 2))
    _split(root, _EMPHASIS, "*", inner("emphasis", "markdown", 1))


def _templates(root: Node) -> None:
    """Templates as nodes, found by matching doubled braces in one pass; what holds a template is one too."""
    for here in list(_walk(root)):
        if here.fixed is not None or not any(isinstance(c, str) and "{{" in c for c in here.children):
            continue
        out: list[Node | str] = []
        for child in here.children:
            if isinstance(child, Node) or "{{" not in child:
                out.append(child)
                continue
            spans: list[tuple[int, int]] = []
            open_at: list[tuple[int, bool]] = []
            for match in _CURLY.finditer(child):
                if match[0] == "{{":
                    named = regex.match(r"\s*+[\w#:]", child, pos=match.end()) is not None and not (match.start() and regex.match(r"[\\\w}{]", child[match.start() - 1]))
                    open_at.append((match.start(), named))
                elif open_at:
                    start, named = open_at.pop()
                    if named and not regex.search(r"[{}]", _bare(child[start + 2 : match.start()], spans, start + 2)):
                        while spans and spans[-1][0] > start:
                            spans.pop()
                        spans.append((start, match.end()))
            at = 0
            for start, stop in spans:
                out += [child[at:start]] if start > at else []
                out.append(Node("template", "wiki", fixed="", parent=here))
                at = stop
            out += [child[at:]] if at < len(child) else []
        here.children = out


def _bare(text: str, spans: list[tuple[int, int]], offset: int) -> str:
    """The text without the spans that lie in it."""
    out, at = [], 0
    first = len(spans)
    while first and spans[first - 1][0] >= offset:
        first -= 1
    for start, stop in spans[first:]:
        out.append(text[at : start - offset])
        at = stop - offset
    return "".join(out) + text[at:]


def _wiki_label(inner: str) -> str:
    target, _, label = inner.rpartition("|")
    return "" if _CATEGORY.match(inner) else regex.sub(r"^\w+:", "", label) if target else inner


def _wiki_rows(inner: str) -> str:
    lines = regex.split(r"\n[ \t]*+\|-[^\n]*+", inner)
    cells = [[c.strip() for c in regex.split(r"\|\||!!|\n[ \t]*+[|!]", "\n" + row.strip()) if c.strip()] for row in lines]
    return "\n" + "\n".join(" | ".join(c) for c in cells if c) + "\n"


def kinds_of(root: Node) -> list[str]:
    """The formats of the tree's nodes, in the order of KINDS."""
    there = {node.kind for node in _walk(root)}
    return [kind for kind in KINDS if kind in there]


# --- scoring


def _measure(root: Node) -> None:
    """Characters of each node, and how many of them lie in links; silent elements have none."""
    for node in reversed(list(_walk(root))):
        node.size = len(node.fixed) if node.fixed is not None else sum(len(c) if isinstance(c, str) else c.size for c in node.children)
        node.linked = node.size if node.name in ("a", "link") else sum(c.linked for c in node.nodes())
        if node.name in _SILENT:
            node.size = node.linked = 0


def link_density(node: Node) -> float:
    """Share of a measured element's characters that lie in links."""
    return node.linked / node.size if node.size else 0.0


def points(text: str) -> float:
    """What a paragraph passes on: one, one for each comma, and up to three for its length."""
    return 1.0 + sum(text.count(c) for c in ",，、،") + min(len(text) / 100.0, 3.0)


def _flat(node: Node | str) -> str:
    if isinstance(node, str):
        return node
    if node.fixed is not None:
        return node.fixed
    return "" if node.name in _SILENT else "".join(_flat(c) for c in node.children)


def _paragraphs(node: Node) -> Iterator[str]:
    """Runs of strings and inline nodes of an element, each of which is a paragraph."""
    run: list[str] = []
    for child in node.children:
        if isinstance(child, Node) and child.name in _BLOCKS:
            yield "".join(run).strip()
            run = []
        else:
            run.append(_flat(child))
    yield "".join(run).strip()


def dropped(root: Node) -> set[int]:
    """Identities of the nodes beside the best content that are navigation, or blocks of links that score far less.

    A paragraph's element, or its parent if it is no container, gets its
    points, the next ancestor half, older ones a third by level.  Nothing else
    is dropped, so loose text beside the content stays whatever its length.
    """
    _measure(root)
    everyone = list(_walk(root))
    for node in everyone:
        if node.name not in _BLOCKS or node.name in _SILENT:
            continue
        for text in _paragraphs(node):
            if len(text) < _SHORT:
                continue
            up, level = (node if node.name in _CONTAINERS and node.name not in ("td", "blockquote") else node.parent), 0
            while up is not None:
                up.score += points(text) / (1 if level == 0 else 2 if level == 1 else level * 3)
                up, level = up.parent, level + 1
    for node in everyone:
        node.score *= 1.0 - link_density(node)
    best = max(everyone, key=lambda n: n.score)
    if best.score <= 0:
        return set()
    out: set[int] = set()
    path, node = {id(best)}, best
    while node.parent is not None:
        node = node.parent
        path.add(id(node))
    node = root
    while node is not None:
        for child in node.nodes():
            if id(child) not in path and child.name in _BLOCKS and (child.name in _ASIDE or (link_density(child) >= _DENSE and child.score < best.score * 0.2)):
                out.add(id(child))
        node = next((c for c in node.nodes() if id(c) in path), None)
    return out


# --- rendering


def _render(node: Node | str, out: list[str], without: set[int], depth: int = 0) -> None:
    """Append the lines of a node: headings get #, list items -, code a fence."""
    if isinstance(node, str):
        out.append(node)
        return
    if node.fixed is not None:
        out.append(node.fixed)
        return
    if node.name in _SILENT or id(node) in without:
        return
    if node.name in ("br", "hr", "img"):
        out.append({"br": "\n", "hr": "\n\n"}.get(node.name) or node.attributes.get("alt", ""))
        return
    inner: list[str] = []
    for child in node.children:
        _render(child, inner, without, depth + (node.name in ("ul", "ol")))
    text = "".join(inner)
    if node.name == "pre":
        out.append(f"\n\n```\n{text.strip()}\n```\n\n")
    elif node.name in _HEADINGS:
        out.append(f"\n\n{'#' * _HEADINGS[node.name]} {' '.join(text.split())}\n\n")
    elif node.name == "li":
        out.append(f"\n{'  ' * max(0, depth - 1)}- {text.strip()}")
    elif node.name in ("td", "th"):
        out.append(f"{' '.join(text.split())} | ")
    elif node.name == "tr":
        out.append(f"\n{text.strip().strip('|').strip()}")
    elif node.name in ("code", "kbd", "samp", "tt"):
        out.append(f"`{text.strip()}`" if text.strip() else "")
    elif node.name in _BLOCKS:
        out.append(f"\n\n{text.strip(' ')}\n\n")
    else:
        out.append(text)


def plain_lines(text: str) -> str:
    """The text with every line end, also the mark `/n`, as a line feed."""
    return _LINE_END.sub("\n", text)


def clean(text: str | None) -> tuple[str | None, list[str]]:
    """The clean text and the kinds of markup it held; a text without markup stays as it is."""
    if not text:
        return text, []
    root = parse(plain_lines(text))
    kinds = kinds_of(root)
    if not kinds:
        return text, kinds
    if "latex" in kinds:
        _plain_strings(root, lambda s: regex.sub(r"\\([%&#_{}$])", r"\1", _REMARK.sub(lambda m: " " if m[0] == "~" else "", s)))
    if "markdown" in kinds:
        _plain_strings(root, lambda s: _PIPE_ROW.sub(lambda m: " | ".join(c.strip() for c in m[1].split("|")), s))
    out: list[str] = []
    without = dropped(root) if "html" in kinds else set()
    for child in root.children:
        _render(child, out, without)
    made = regex.sub(r"[ \t]++(?=\n)", "", "".join(out))
    return regex.sub(r"\n{3,}+", "\n\n", made).strip(), kinds


def _plain_strings(root: Node, change: Callable[[str], str]) -> None:
    for node in _walk(root):
        if node.fixed is None:
            node.children = [change(c) if isinstance(c, str) else c for c in node.children]


def clean_texts(df: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """(id, kinds, clean) of every row.

    kinds has the formats (html, markdown, wiki, latex) of the text's nodes,
    none for plain, empty and null texts, whose clean text is the text itself.
    In a clean text headings are lines that start with #, list items with -,
    code stands between back-ticks and formulas between dollar signs; tables
    are lines of cells.  Repeated rows come out each; other columns are not read.
    """
    source = df.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    kind = source.schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [clean(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([k for _, k in done], pa.list_(pa.string())), pa.array([c for c, _ in done], pa.string())], names=["id", "kinds", "clean"])

    return source.mapInArrow(run, f"id {kind}, kinds array<string>, clean string").withColumnRenamed("id", id_column)
