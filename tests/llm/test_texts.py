from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quireflow.llm import markup, spam, splitting, tokenizer
from quireflow.llm.leakage import leaks
from quireflow.llm.sentences import sentence_rows
from quireflow.llm.tokens import code_points

from . import texts as X

# --- splitting

ODD = st.text(alphabet=st.sampled_from(list("ab .\n!?。é́'\"/n\r\t\U0001f600")), max_size=400)


@settings(max_examples=200, deadline=None)
@given(text=ODD, limit=st.integers(8, 60))
def test_pieces_are_whole_and_within_the_limit(text, limit):
    plan = splitting.Plan.of(limit)
    starts, ends, kinds = splitting.split_points(code_points(text), plan)
    assert (ends - starts).max() <= limit and ends[-1] == len(text) and starts[0] == 0
    before = np.concatenate([[0], ends[:-1]])
    assert "".join(text[a:b] for a, b in zip(before, ends, strict=True)) == text
    assert all(b - a == min(plan.overlap, b) for a, b in zip(starts[1:], before[1:], strict=True))
    assert len(starts) == 1 or len(text) > limit


def test_pieces_end_at_boundaries(spark):
    text = "\n\n".join("Word word. Word word word. " * 2 for _ in range(24))
    df = spark.createDataFrame([(1, text, 0), (1, "short", 0), (2, None, 0), (3, "", 0), (4, "x" * 900, 0)], "k int, body string, piece int")
    rows = splitting.split_texts(df, "k", "body", 300).collect()
    long = sorted((r for r in rows if r.n_pieces > 1 and r.k == 1), key=lambda r: r.piece)
    assert {r.boundary for r in long[:-1]} == {"paragraph"} and all(text[r.start_pos : r.end_pos] == r.text for r in long)
    assert {(r.k, r.text) for r in rows if r.n_pieces == 1} == {(1, "short"), (3, "")}
    assert {r.boundary for r in rows if r.k == 4} == {"anywhere", "end"}
    assert splitting.split_texts(df.limit(0), "k", "body", 300).count() == 0
    with pytest.raises(ValueError):
        splitting.Plan.of(10, overlap=9)


def test_file_ranges_agree_with_the_whole_text(spark, tmp_path):
    rng = random.Random(1)
    text = "\n".join(X.prose(rng, rng.randrange(1, 40)).replace("w1", "é語\U0001f600") + rng.choice([".", "", "\n"]) for _ in range(600))
    path = tmp_path / "a.txt"
    path.write_bytes(text.encode("utf-8"))
    (tmp_path / "empty.txt").touch()
    rows = splitting.split_files(spark, [str(path), str(tmp_path / "empty.txt")], 700, range_bytes=5001).orderBy("path", "piece").collect()
    starts, ends, kinds = splitting.split_points(code_points(text), splitting.Plan.of(700))
    mine = [r for r in rows if r.path == str(path)]
    assert [(r.start_pos, r.end_pos, r.boundary) for r in mine] == [(a, b, splitting.KINDS[k]) for a, b, k in zip(starts, ends, kinds, strict=True)]
    assert all(r.text == text[r.start_pos : r.end_pos] for r in mine)
    assert [r.text for r in rows if r.path != str(path)] == [""]


# --- sentences

SENTENCES = [
    (["The x includes y, etc.", "Near the x, e.g. A or B, T. N. Ilolin (ed.) saw 5.22 K and above."], " "),
    (["“It is. It never was,” the log of A. S. Q reads.", "He wrote: \"It ends!\"", "(See Sec. 7 of it.)", "Is it?!"], " "),
    (["« La seuil ! » note l'équipe.", "On note env. 640 unités (cf. fig. 73).", "Selon M. Pell, p. ex., la onde."], " "),
    (["Am 3. Mai wurde es geprüft.", "Dies gilt z. B. für X, d. h. für Y bzw. Zeit.", "In Abb. 11 zeigt Prof. Q bei ca. 625 Grad."], ""),
    (["作者写道：“相位不会匹配先验！”但X例外。", "样本……确切地说是线性的。", "图2.5（含。）是！"], ""),
    (["「境界は解決する。空洞も同じだ。」とAは述べた。", "なぜ？"], ""),
    (["การทดลอง24ครั้งแสดงว่าเกณฑ์TRIB32", "เราพบว่าแบบจำลอง"], " "),
    (["На рис. 43 при 625 К.", "«Сеть не меняет!» — пишет автор.", "По данным проф. Q, т. е. группы."], " "),
    (["Γιατί η KONK81;", "Αυτό ισχύει π.χ. για τη, βλ. σελ. 56."], " "),
    (["हल QUIT9 ने 79.08 देखा।", "क्या है?"], " "),
    (["كتب د. CYRF91 أن الحد!", "هل يغير في PRON16؟", "يقلل عند 20.68."], " "),
    (["2. Background", "The end", "• item"], "/n"),
    (["pH is five.", "mRNA-like x tracks.", "See http://a.example/b.html?id=5."], "\r\n"),
]


def test_sentences(spark):
    df = spark.createDataFrame([(i, f"  {gap.join(s)} ", 1) for i, (s, gap) in enumerate(SENTENCES)] + [(90, None, 1), (91, "", 1), (92, " \n ", 1)], "k int, body string, position int")
    found = {}
    for r in sentence_rows(df, "k", "body").orderBy("k", "position").collect():
        found.setdefault(r.k, []).append(r.sentence)
    assert found == {i: s for i, (s, _) in enumerate(SENTENCES)}


def test_sentences_cover_the_text(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice("aB. !?\n。“”()1สé") for _ in range(rng.randrange(80))) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, body string")
    left = dict(enumerate(texts))
    last = {}
    for r in sentence_rows(df, "k", "body").orderBy("k", "position").collect():
        assert r.sentence == texts[r.k][r.start_pos : r.end_pos] == r.sentence.strip() != ""
        assert texts[r.k][last.get(r.k, 0) : r.start_pos].strip() == ""
        last[r.k] = r.end_pos
        left[r.k] = texts[r.k][r.end_pos :]
    assert not any(x.strip() for x in left.values())


# --- tokenizer


@pytest.fixture(scope="module")
def vocabulary():
    return tokenizer.Vocabulary.load(tokenizer.DEFAULT_VOCABULARY)


def test_perfect_hash_is_minimal(vocabulary):
    table = vocabulary.table
    assert len(table.keys) == len(set(table.keys.tolist())) == len(vocabulary.ranks)
    values, hit = table.find(table.keys)
    assert hit.all() and sorted(values.tolist()) == sorted(vocabulary.ranks.values())
    assert not table.find(table.keys ^ np.uint64(1))[1].any()


def test_ids_agree_with_a_public_library(vocabulary):
    import base64

    import tiktoken

    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    with open(tokenizer.DEFAULT_VOCABULARY, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    other = tiktoken.Encoding("test", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(0)
    parts = list("ab 's\n\t.!1é語กำ\U0001f600'") + [" don't", "we'll ", "<|endoftext|>", "  \n ", "zanlovane", "###", "123456"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(12))) for _ in range(3000)] + [None, "", " ", "a" * 3000, "x" + " " * 3000]
    found = tokenizer.Encoder(vocabulary).encode(pa.array(texts)).to_pylist()
    assert found == [other.encode_ordinary(t or "") for t in texts]


def test_long_texts_are_cut_without_a_trace(vocabulary, monkeypatch):
    from quireflow.llm import tokens as tokens_module

    rng = random.Random(9)
    texts = [" ".join(rng.choice(["don't", "zanlovane", "a", "  ", "é", "1.5", "x\n"]) for _ in range(n)) for n in (0, 3, 900, 5, 2000)]
    whole = tokenizer.Encoder(vocabulary).encode(pa.array(texts)).to_pylist(), [x.tolist() for x in tokens_module.token_hashes(texts)]
    monkeypatch.setattr(tokenizer, "_BLOCK_BYTES", 100)
    monkeypatch.setattr(tokens_module, "_BLOCK", 64)
    assert whole == (tokenizer.Encoder(vocabulary).encode(pa.array(texts)).to_pylist(), [x.tolist() for x in tokens_module.token_hashes(texts)])


def test_encoding_a_table(spark):
    df = spark.createDataFrame([(1, "hello world", "x"), (1, "hello world", "x"), (2, None, "x"), (3, "", "x")], "doc_id long, text string, ids string")
    rows = sorted((r.doc_id, r.ids) for r in tokenizer.encode(df).collect())
    assert rows == [(1, [31373, 995]), (1, [31373, 995]), (2, []), (3, [])]
    assert tokenizer.encode(df.limit(0)).count() == 0


# --- leakage


def test_passages_agree_with_a_loop(spark):
    rng = random.Random(2)
    items = [(i, X.prose(rng, 40), X.prose(rng, 15)) for i in range(8)] + [(50, None, "too short"), (51, "", None)]
    docs = []
    for i in range(60):
        words = X.prose(rng, 50).split()
        item = rng.choice(items[:8])[rng.choice([1, 2])].split()
        n, at = rng.randrange(8, min(len(item), 30)), rng.randrange(40)
        docs.append((i, f"{' '.join(words[:at])} — {'  İ, '.join([' '.join(item[:n]).upper()])}! {' '.join(words[at:])}"))
    docs += [(90, None), (91, ""), (92, docs[0][1])]
    source = spark.createDataFrame([(*d, 1, 2) for d in docs], "doc_id long, text string, item int, first int")
    held = spark.createDataFrame(items, "item_id long, text string, target string")
    rows = leaks(source, held, "doc_id", "text", "item_id", ["text", "target"]).collect()
    want = set()
    for doc, text in docs:
        t = X.tokens(text)
        runs = {tuple(t[i : i + 12]) for i in range(len(t) - 11)}
        for item, *texts in items:
            for x in texts:
                w = X.tokens(x)
                want |= {(doc, item) for i in range(len(w) - 11) if tuple(w[i : i + 12]) in runs}
    assert {(r.doc, r.item) for r in rows} == want and want
    by_id = dict(docs)
    assert all(len(X.tokens(by_id[r.doc][r.start_pos : r.end_pos])) == r["last"] - r["first"] >= 12 for r in rows)
    assert leaks(source, held.limit(0), "doc_id", "text", "item_id", ["text"]).count() == 0
    assert leaks(source.limit(0), held, "doc_id", "text", "item_id", ["text"]).count() == 0


def test_items_in_blocks_give_the_same(spark, monkeypatch):
    rng = random.Random(4)
    items = [(i, X.prose(rng, 30)) for i in range(6)]
    source = spark.createDataFrame([(i, f"start {t} end") for i, t in items], "doc_id long, text string")
    held = spark.createDataFrame(items, "item_id long, text string")
    whole = leaks(source, held, "doc_id", "text", "item_id", ["text"]).collect()
    monkeypatch.setattr("quireflow.llm.leakage._MOST_PATTERNS", 40)
    assert sorted(leaks(source, held, "doc_id", "text", "item_id", ["text"]).collect()) == sorted(whole) and len(whole) == 6


# --- markup

MARKED = [
    ("<p>Some <b>bold</b> text &amp; more</p><h2>Title</h2><ul><li>one</li><li>two</li></ul>", ["html"], ["Some bold text & more", "## Title", "- one", "- two"]),
    ("# Head\n\nSome **bold** and `code` with [a link](http://x.example/a).\n\n```py\nx = 1\n```", ["markdown"], ["# Head", "Some bold and `code` with a link.", "x = 1"]),
    ("Head\n----\n\n| a | b |\n|---|---|\n| 1 | 2 |", ["markdown"], ["## Head", "a | b", "1 | 2"]),
    ("== Head ==\n'''Bold''' and [[page|label]] {{cite|x=1}} [[other]]\n{| class=\"x\"\n|-\n| a || b\n|}", ["wiki"], ["# Head", "Bold and label", "other", "a | b"]),
    ("\\section{Head}\nText \\emph{it} with $x_1 = 2$ and\n\\begin{equation}\na^2\n\\end{equation}\n\\item one", ["latex"], ["# Head", "Text it with $x_1 = 2$ and", "$$ a^2 $$", "- one"]),
    ("Inline \\(a + b\\) and \\[ c \\le d \\]", ["latex"], ["$a + b$", "$$ c \\le d $$"]),
]
PLAIN = ["cost fell from $65 to $730 per item", "Logs sit in D:\\data\\new on host #98", "a < 27.1 and b > 8.89 & R&D", "57 * 97 cells * more", "• item\n* item\n- item", "the file a_b_c keeps [79] (see)", "1. Heading", "x^2 < 62.59", None, "", " "]


@pytest.mark.parametrize(("text", "kinds", "parts"), MARKED)
def test_marked(text, kinds, parts):
    clean, found = markup.clean(text)
    assert found == kinds and all(p in clean for p in parts)
    assert not any(x in clean for x in ("<p>", "**", "'''", "[[", "{{", "\\emph", "\\section"))


@pytest.mark.parametrize("text", PLAIN)
def test_plain_texts_stay(text):
    assert markup.clean(text) == (text, [])


def test_best_container_is_kept():
    story = "".join(f"<p>Sentence {i}, with commas, and enough words to count as content, indeed.</p>" for i in range(6))
    links = "".join(f'<li><a href="/{i}">Menu entry number {i} of the page</a></li>' for i in range(9))
    clean, _ = markup.clean(f"<html><body><nav><ul>{links}</ul></nav><div id='main'><h1>Story</h1>{story}<pre>a  = b</pre></div><footer>About, contact and more links</footer></body></html>")
    assert "# Story" in clean and "Sentence 5" in clean and "```\na  = b\n```" in clean
    assert "Menu entry" not in clean and "contact" not in clean


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab<>/p &;#*`|[](){}'=$\\\n!-")), max_size=120))
def test_any_text_is_cleaned(text):
    clean, kinds = markup.clean(text)
    assert isinstance(clean, str) and set(kinds) <= set(markup.KINDS)


def test_cleaning_a_table(spark):
    df = spark.createDataFrame([(1, "<p>x</p>", "a"), (1, "<p>x</p>", "a"), (2, None, "a")], "k long, body string, clean string")
    rows = sorted((r.k, r.kinds, r.clean) for r in markup.clean_texts(df, "k", "body").collect())
    assert rows == [(1, ["html"], "x"), (1, ["html"], "x"), (2, [], None)]
    assert markup.clean_texts(df.limit(0), "k", "body").count() == 0


# --- spam


def prose_pages(rng, n):
    nouns = ["filter", "channel", "margin", "surface", "kernel", "vector", "branch", "orbit"]
    names = [a + b for a in ("zan", "mel", "tor", "syn", "cyr") for b in ("lovane", "fagon", "rubex", "nuplex", "tidon")]
    pick = rng.choice
    forms = [
        lambda: f"The {pick(nouns)} of {pick(names)} stays near {rng.randrange(99)}.{rng.randrange(99)} for every {pick(nouns)}.",
        lambda: f"In contrast to {pick(names)}, the {pick(nouns)} limits the {pick(nouns)}, and neither {pick(names)} nor {pick(names)} tracks it.",
        lambda: f"When the {pick(names)} resolves, we align the {pick(nouns)} against {pick(names)} (see Tab. {rng.randrange(99)}).",
    ]
    return [" ".join(pick(forms)() for _ in range(rng.randrange(3, 9))) for _ in range(n)], nouns, names


def test_spam_pages(spark):
    rng = random.Random(6)
    good, nouns, names = prose_pages(rng, 300)
    pick = rng.choice
    url = lambda: f"http://www.{pick(names)}.example/{pick(names)}.html"
    words = [f"buy {pick(names)} {pick(nouns)}" for _ in range(4)]
    bad = [
        " ".join(pick(words) for _ in range(40)),
        " | ".join(pick(words) for _ in range(40)),
        "\n".join(url() for _ in range(20)),
        "\n".join(f"* {pick(names)} {pick(nouns)} {url()}" for _ in range(20)),
        "".join(f'<a href="{url()}">{pick(words)}</a><br>' for _ in range(20)),
        " ".join(f"#{pick(names)}{pick(nouns)}" for _ in range(30)),
        "\n".join(f"{pick(names).title()} {pick(nouns)} {rng.randrange(99)}mm - {rng.randrange(999)} EUR sale" for _ in range(15)),
        "Home > Files > Index > Login > Shop\n" + " • ".join(f"{pick(names).title()} {pick(nouns).title()}" for _ in range(30)),
    ]
    bad += [f"{good[0][:80]}\n\n{x}" for x in bad]
    fine = [
        "References\n" + "\n".join(f"[{i}] A. S. Kell, M. E. Ilis. On the {pick(nouns)} of {pick(names)} in shallow manifolds. Annals of {pick(names)} {i}(3), 177, 1995. {url()}" for i in range(12)),
        "\n".join(f"{pick(names)}: the {pick(nouns)} that limits the {pick(nouns)} of a {pick(names)}" for _ in range(15)),
        "\n".join(f"def {pick(names)}(x, y):\n    return {pick(names)}[x] + y" for _ in range(12)),
        f"Keywords: {', '.join(names[:5])}\n\n{good[1]} {good[2]} {good[3]} See {url()}.",
        " ".join(f"The {names[0]} masks the {names[0]} of {pick(names)}, so every {names[0]} tracks one more {pick(nouns)}." for _ in range(9)),
    ]
    model = spam.train(spark.createDataFrame([(t,) for t in [*good, None, ""]], "text string"))
    rows = [(i, t, 0.0) for i, t in enumerate(bad + fine + good[:50] + [None, "", "  "])]
    found = {r.k for r in spam.spam_pages(spark.createDataFrame(rows, "k long, body string, share double"), "k", "body", model).collect()}
    assert found == set(range(len(bad)))


def test_spam_of_nothing(spark):
    nothing = spark.createDataFrame([], "k long, text string")
    model = spam.train(nothing.select("text"))
    assert spam.spam_pages(nothing, "k", "text", model).count() == 0
    some = spark.createDataFrame([(1, "plain words and more of them")], "k long, text string")
    assert spam.spam_pages(some, "k", "text", model).where(F.col("share") > 1).count() == 0
