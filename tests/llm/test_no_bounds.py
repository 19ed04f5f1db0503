"""Long constructs, hot buckets and odd characters: nothing depends on a length, a size or a batch."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quireflow.llm import markup, spam, splitting, tokenizer, tokens
from quireflow.llm.near_duplicates import near_duplicates
from quireflow.llm.neighbours import nearest
from quireflow.llm.sentences import sentence_rows

from . import texts as X

# --- sentences


def units(spark, *values):
    rows = sentence_rows(spark.createDataFrame(list(enumerate(values)), "k int, t string"), "k", "t")
    out = [[] for _ in values]
    for r in rows.orderBy("k", "position").collect():
        assert values[r.k][r.start_pos : r.end_pos] == r.sentence
        out[r.k].append(r.sentence)
    return out


def test_long_quotations_and_brackets_are_one_unit(spark):
    inner = "This goes on and on. " * 200 + "It ends."
    for a, b in ("“”", "«»", "()", '""'):
        assert units(spark, f"He said {a}{inner}{b}. Next one.") == [[f"He said {a}{inner}{b}.", "Next one."]]


def test_long_words_of_a_script_without_end_marks(spark):
    words = ["ก" * 300, "ข" * 5, "x" * 400 + "ค"]
    assert units(spark, " ".join(words)) == [words]


def test_private_characters_come_back(spark):
    text = "One  thing. Two e.g. 3.5 here. End"
    found = units(spark, text)[0]
    assert " ".join(found) == text and found[0] == "One  thing."


def test_many_sentences_with_masked_ends(spark):
    many = [f"Number {i} costs 3.{i} e.g. here (see no. {i}. Or not)." for i in range(1000)]
    assert units(spark, " ".join(many)) == [many]


# --- markup


@pytest.mark.parametrize(
    ("text", "kind"),
    [
        ("**" + "x y " * 1500 + "z** rest", "markdown"),
        ("*" + "word, " * 1500 + "z* rest", "markdown"),
        ("`" + "code " * 1000 + "x`", "markdown"),
        ("[" + "label " * 1000 + "](http://a.example/b)", "markdown"),
        ("{{cite " + "a" * 10_000 + "}} t", "wiki"),
        ("[[" + "target " * 1000 + "]]", "wiki"),
        ("''" + "italic " * 1000 + "x''", "wiki"),
        ("$$ " + "a+b " * 6000 + "$$", "latex"),
        ("$" + "a^2+b " * 1000 + "c$", "latex"),
        ("\\(" + "a+b " * 3000 + "\\)", "latex"),
        ('<div title="' + "q" * 20_000 + '">x</div>', "html"),
        ("<!--" + " - note" * 3000 + "-->", "html"),
    ],
)
def test_constructs_of_any_length(text, kind):
    assert markup.clean(text)[1] == [kind]


def test_nesting_of_any_depth():
    assert markup.clean("\\emph{a " * 60 + "x" + "}" * 60)[0] == "a " * 60 + "x"
    assert markup.clean("t {{a|" * 500 + "x" + "}}" * 500)[0] == "t"


def test_no_word_is_lost_beside_the_content():
    page = (
        "Start here.\n<b>Key result: 42 wins</b> and <i>italic note</i>\n<div><p>" + "A long paragraph, with commas, " * 20 + "</p><ul><li>one</li></ul></div>"
        "<h2>Short</h2><code>x = 1</code><pre>y = 2</pre>\nTail text, brief."
        '<nav><a href="a">Gone</a></nav><footer>Gone</footer><script>Gone</script><div><a href="a">Gone</a> <a href="b">Gone</a></div>'
    )
    clean, kinds = markup.clean(page)
    assert kinds == ["html"] and "Gone" not in clean
    for part in ("Start here.", "Key result: 42 wins and italic note", "with commas,", "- one", "## Short", "`x = 1`", "```\ny = 2\n```", "Tail text, brief."):
        assert part in clean


def test_own_marks_in_a_text():
    assert markup.clean("0 and **bold** ")[0] == "0 and bold "


def test_constructs_without_an_end():
    for part in ("<!--", "''a ", "**a ", "$a ", "{{a ", "[[a ", "<a href=x>", "\\[ ", "`a ", "&a;", "<div "):
        markup.clean(part * 5000)


# --- spam


def test_the_model_decides(spark):
    rng = random.Random(4)
    common = "the of and in with for by is that from".split()
    good = [". ".join(" ".join(rng.choice(common) if i % 2 else rng.choice(X.WORDS) for i in range(12)) for _ in range(20)) + "." for _ in range(300)]
    bad = ["\n".join(f"https://a{rng.randrange(99)}.example/x {rng.choice(X.WORDS)} {rng.choice(X.WORDS)}" for _ in range(60)) for _ in range(20)]
    model = spam.train(spark.createDataFrame([(t,) for t in good], "text string"))
    share, bits = model.abnormal(good + bad)
    assert (share[:300] <= 0.5).all() and (share[300:] > 0.5).all() and bits[:300].max() < bits[300:].min()
    # with the same surprise everywhere nothing is abnormal, whatever a page holds
    flat = spam.Model(model.trigrams, model.bits * 0 + 2.0, model.back * 0 + 2.0, model.low, np.maximum(model.high, 3.0))
    assert (flat.abnormal(bad)[0] <= 0.5).all()


def test_long_anchors_and_own_marks(spark):
    anchor = f'<a href="http://a.example">{"word " * 3000}</a>'
    found = spam.tokens([anchor, "  plain"])
    assert (found.classes[: found.offsets[1]] == spam._MASK + 4).sum() == 3000
    assert not ((found.classes[found.offsets[1] :] >= spam._MASK) & (found.classes[found.offsets[1] :] < spam._OTHER)).any()


# --- splitting


def test_ranges_agree_with_the_whole_text(spark):
    rng = random.Random(3)
    parts = ["word ", "End. ", "Zeile\n", "\n\n", "/n", "/n/n", "”", '") ', "。", "é́", "𝒳 ", "Satz! “Q.” "]
    values = ["".join(rng.choice([*parts, " " * rng.randint(1, 1500), "\n" * rng.randint(1, 300), ")" * rng.randint(1, 400), "x" * rng.randint(1, 900)]) for _ in range(60)) for _ in range(6)]
    values += ["a. " + " " * 10_000 + "b. " * 3000 + "\n" * 10_000 + "c " * 4000, "short", ""]
    df = spark.createDataFrame(list(enumerate(values)), "k int, t string")
    found = {}
    for r in splitting.split_texts(df, "k", "t", 700, range_bytes=1501).orderBy("k", "piece").collect():
        found.setdefault(r.k, []).append((r.start_pos, r.end_pos, r.boundary, r.text))
    for k, text in enumerate(values):
        starts, ends, kinds = splitting.split_points(tokens.code_points(text), splitting.Plan.of(700))
        assert found[k] == [(a, b, splitting.KINDS[c], text[a:b]) for a, b, c in zip(starts.tolist(), ends.tolist(), kinds.tolist(), strict=True)]


# --- hashes


def doubling(n):
    word = "a"
    for _ in range(n):
        word += word.translate(str.maketrans("ab", "ba"))
    return word, word.translate(str.maketrans("ab", "ba"))


def test_words_that_polynomials_confuse():
    one, two = doubling(12)
    assert len(one) == 4096
    h, _ = tokens.token_hashes([one, two])
    assert h[0] != h[1]
    sig = tokens.signatures(*tokens.token_hashes([" ".join(one), " ".join(two)]))
    assert sig[0][0] != sig[0][1] and sig[1][0] != sig[1][1]
    vocabulary = tokenizer.Vocabulary.load(tokenizer.DEFAULT_VOCABULARY)
    together = tokenizer.Encoder(vocabulary).encode(pa.array([one, two])).to_pylist()
    alone = [tokenizer.Encoder(vocabulary).encode(pa.array([t])).to_pylist()[0] for t in (one, two)]
    assert together == alone and alone[0] != alone[1]


def test_a_hit_of_the_hash_is_checked_by_bytes(monkeypatch):
    vocabulary = tokenizer.Vocabulary.load(tokenizer.DEFAULT_VOCABULARY)
    monkeypatch.setattr(tokenizer.PerfectHash, "find", lambda self, hashes: (np.full(len(hashes), 300, dtype=np.int32), np.ones(len(hashes), dtype=bool)))
    encoder = tokenizer.Encoder(vocabulary)
    text = "never mind which entry the table names, words come back"
    ids = encoder.encode(pa.array([text])).to_pylist()[0]
    entries = list(vocabulary.ranks)
    assert b"".join(entries[list(vocabulary.ranks.values()).index(i)] for i in ids).decode() == text


# --- pairs and vectors


def test_a_hot_bucket_of_many_groups(spark):
    """A third of a text is shared by all, which alone links none; each also has a partner."""
    rng = random.Random(12)
    shared = X.prose(rng, 40)
    own = [X.prose(rng, 30) for _ in range(500)]
    values = [f"{shared} {mine} {X.prose(rng, 12)}" for _ in range(2) for mine in own]
    df = spark.createDataFrame(list(enumerate(values)), "k long, t string").repartition(4)
    found = {r.id: r.group for r in near_duplicates(df, "k", "t", 3, 0.5).collect()}
    linked = {i for i in range(500) if X.similarity(values[i], values[i + 500]) >= 0.5}
    assert len(linked) > 400
    missed = [i for i in linked if found.get(i) is None or found[i] != found.get(i + 500)]
    assert len(missed) <= len(linked) // 100


def test_recall_with_a_thousand_lists(spark):
    rng = np.random.default_rng(2)
    centre = rng.standard_normal((300, 32))
    values = centre[rng.integers(0, 300, 12_000)] + 0.35 * rng.standard_normal((12_000, 32))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(values)], "k long, v array<float>")
    found = {}
    for r in nearest(df, "k", "v", 32, lists=1024).where(F.col("id") % 100 == 0).select("id", "other").collect():
        found.setdefault(r.id, set()).add(r.other)
    units_ = values / np.linalg.norm(values, axis=1, keepdims=True)
    hits = 0
    for i in range(0, 12_000, 100):
        s = units_ @ units_[i]
        s[i] = -2
        hits += len(set(np.argsort(-s)[:10].tolist()) & found[i])
    assert hits >= 0.9 * 1200


def test_the_exact_join_misses_nothing_and_passes_over_a_common_passage(spark):
    from quireflow.llm.near_duplicates import unproven_pairs
    from quireflow.llm.pairs import verified

    rng = random.Random(21)
    values = X.family(1, 6)
    for _ in range(30):
        base = X.prose(rng, 60)
        values += [base, f"{base} {X.prose(rng, rng.randrange(10, 60))}"]
    shared = X.prose(rng, 62)
    values += [f"{shared} {X.prose(rng, 30)}" for _ in range(30)]
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(values)], "id long, text string, within long").where("text is not null")
    none = spark.createDataFrame([], "id long, root long")
    for threshold, width, rows in ((0.5, 3, 10_000), (0.8, 5, 10_000), (0.5, 3, 7)):
        # shingles that go on over several batches
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
        found = unproven_pairs(df, df.select("id"), none, width, 20, threshold)
        sure = {(r.a, r.b) for r in verified(found, df, width, 20, threshold).collect()}
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10_000)
        assert sure == {(i, j) for j in range(len(values)) for i in range(j) if X.similarity(values[i], values[j], width) >= threshold}
    # half of each of these texts is one passage, which alone is too little; no pair is made of it
    passage = X.prose(rng, 200)
    many = spark.createDataFrame([(i, f"{passage} {X.prose(rng, 190)}", 0) for i in range(500)], "id long, text string, within long")
    assert unproven_pairs(many, many.select("id"), none, 3, 20, 0.5).count() == 0
