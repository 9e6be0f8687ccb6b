import random

import numpy as np
import pytest

from ticketloom.llm import corpus_tokens as C
from ticketloom.llm import markup, markup_model
from ticketloom.llm import mixing as M
from ticketloom.llm import shared_spans as S
from ticketloom.llm.markup_blocks import Block, blocks

TEXTS = [
    None, "", " ", "\n\n  \t x", "Hello hello world's we'll \u00a0\u3000x", "日本語テキスト 12345 ١٢٣ ½", "😀😀 e\u0301 ñ\u200d\ufeff", "a" * 30_000, "x y " * 5_000, "  leading", "tabs\t\t\tand   runs\r\n\r\n", "<|endoftext|> is text",
    "'s't'LL don't", "\u0000\u0001 ctl", "ab\n  cd\n", "!!! ... ((()))",
]


def documents(spark, texts):
    return spark.createDataFrame([(k, t, "en", "s", "clash") for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, word string")


def test_ids_equal_the_tokenizer(spark):
    from pathlib import Path

    from tokenizers import Tokenizer

    t = Tokenizer.from_file(str(Path(C.BYTE_BPE_50K).with_name("byte_bpe_50k.json")))
    t.encode_special_tokens = True
    docs = documents(spark, TEXTS)
    got = {r.doc_id: r.ids for r in C.encode_corpus(docs.unionByName(docs.limit(6))).collect()}
    want = {k: e.ids for k, e in enumerate(t.encode_batch([x or "" for x in TEXTS], add_special_tokens=False))}
    assert got == want
    assert C.encode_corpus(docs.unionByName(docs)).count() == len(TEXTS)


@pytest.mark.parametrize("hot", [1, 20_000])
def test_round_trip_and_hot_words(spark, monkeypatch, hot):
    monkeypatch.setattr(C, "HOT_WORDS", hot)
    docs = documents(spark, TEXTS)
    back = {r.doc_id: r.text for r in C.decode_corpus(C.encode_corpus(docs)).collect()}
    assert back == {k: t or "" for k, t in enumerate(TEXTS)}
    counts = {r.doc_id: r.n_tokens for r in C.token_counts(docs, keep=("source",)).collect()}
    assert counts == {r.doc_id: len(r.ids) for r in C.encode_corpus(docs).collect()}


def test_no_documents(spark):
    assert C.encode_corpus(documents(spark, TEXTS).limit(0)).count() == 0


def test_flight_keeps_totals():
    rng = np.random.default_rng(5)
    size = rng.integers(1, 4000, 3000).astype(float)
    pi = np.full(3000, 0.37)
    end = M.flight(pi, size, rng)
    assert ((end > 0) & (end < 1)).sum() <= 2 and end.sum() == pytest.approx(pi.sum()) and (end * size).sum() == pytest.approx((pi * size).sum())
    last = M.landing(end, size)
    assert set(last) <= {0.0, 1.0} and abs(last.sum() - pi.sum()) <= 2


def test_flight_is_unbiased():
    size, taken = np.array([1.0, 2, 3, 4, 50, 6, 7, 8]), np.zeros(8)
    for seed in range(3000):
        taken += M.landing(M.flight(np.full(8, 0.5), size, np.random.default_rng(seed)), size)
    assert np.abs(taken[[0, 1, 2, 3, 5, 6, 7]] / 3000 - 0.5).max() < 0.15


@pytest.mark.parametrize("block_rows", [20_000, 40])
def test_mix_meets_weights_and_caps(spark, block_rows):
    rnd = random.Random(1)
    rows = [(k, ["big", "mid", "small", "unweighted", None][k % 20 and (1 if k % 5 else 2) or 0] if k % 37 else None, rnd.randint(0, 300)) for k in range(2000)]
    counted = spark.createDataFrame(rows, "doc_id long, source string, n_tokens long")
    weights = spark.createDataFrame([("big", 0.2, 3), ("mid", 0.5, 1), ("small", 0.2, 2), ("small", 0.2, 2), ("absent", 0.1, 9), (None, 0.5, 1)], "source string, target_weight double, max_repeats int")
    chosen, plan = M.mix(counted, weights, block_rows=block_rows)
    got = {r.source: r for r in M.shares(chosen, plan).collect()}
    for s, w in (("big", 0.2), ("mid", 0.5), ("small", 0.2)):
        assert got[s].reached_share == pytest.approx(w / 0.9, abs=0.01) and got[s].most_repeats <= got[s].max_repeats
    assert got["absent"].tokens_drawn == 0 and chosen.groupBy("doc_id").count().where("count > 1").count() == 0
    capped = {r.source: r for r in M.shares(*M.mix(counted, weights, total_tokens=10**9)).collect()}
    assert all(capped[s].most_repeats == capped[s].max_repeats for s in ("big", "mid", "small"))


def test_landing_uses_repeats():
    """Few long documents: a total between their sums is met by using some once more and others once less."""
    rng = np.random.default_rng(3)
    for _ in range(40):
        size = rng.integers(200, 900, 30).astype(float)
        cap, uses = np.full(30, 4), rng.integers(0, 2, 30).astype(float)
        total = float(size.sum() * rng.uniform(0.5, 2.5))
        got = M.even_out(uses, size, cap, total)
        assert (got >= 0).all() and (got <= cap).all() and abs((got * size).sum() - total) <= 0.01 * total


def test_promises_are_judged(spark):
    plan = spark.createDataFrame([("a", 0.5, 2, 2, 100, 1.0), ("b", 0.5, 1, 3, 300, 0.5)], "source string, target_weight double, max_repeats int, n_docs long, n_tokens long, uses double")
    chosen = spark.createDataFrame([(1, "a", 50, 2), (2, "b", 100, 2), (3, "b", 100, 1)], "doc_id long, source string, n_tokens long, repeats int")
    assert {r.source: (r.cap_kept, r.share_met) for r in M.kept_promises(chosen, plan).collect()} == {"a": (True, True), "b": (False, False)}


def test_mix_of_nothing(spark):
    counted = spark.createDataFrame([], "doc_id long, source string, n_tokens long")
    weights = spark.createDataFrame([("a", 1.0, 1)], "source string, target_weight double, max_repeats int")
    chosen, plan = M.mix(counted, weights)
    assert chosen.count() == 0 and plan.count() == 1


def brute_spans(docs, least):
    seen = {}
    for d, t in docs:
        for k in range(len(t or "") - least + 1):
            seen.setdefault(t[k:k + least], set()).add(d)
    out = []
    for d, t in dict(docs).items():
        runs = []
        for k in range(len(t or "") - least + 1):
            if len(seen[t[k:k + least]]) > 1:
                if runs and k <= runs[-1][1]:
                    runs[-1][1] = k + least
                else:
                    runs.append([k, k + least])
        out += [(d, a, b) for a, b in runs]
    return sorted(out)


def test_longer_anchors_stand_for_every_window():
    for least in (200, 137):
        length = S.ANCHOR
        while length < least:
            step, more = S.longer(length, least)
            starts = set(range(length - least, 1))  # of the windows around an anchor at 0
            assert starts == {s for at in (-step, 0) for s in range(at + more - least, at + 1)} & starts and more > length
            length = more
        assert length == least


@pytest.mark.parametrize("shard_chars", [150_000, 3_000, 0])
def test_spans_against_brute_force(spark, shard_chars):
    """Shards of any size, routed by longer anchors where they are too large: quoted passages of lengths around the limit, periodic and repeated text, non-BMP characters."""
    rnd = random.Random(4)
    noise = lambda n: "".join(rnd.choice("abcdefgh 😀é\n") for _ in range(n))
    passages = [noise(n) for n in (199, 200, 201, 260, 600)]
    docs = [(k, noise(rnd.randint(0, 400)) + rnd.choice(passages) + noise(rnd.randint(0, 300)) + (rnd.choice(passages) if k % 3 else "")) for k in range(40)]
    docs += [(40, "ab" * 300), (41, "x" + "ab" * 200), (42, passages[4] + passages[4]), (43, None), (44, ""), (45, "short"), (46, docs[0][1]), (46, docs[0][1]), (47, "q" * 5000), (48, "q" * 230)]
    df = spark.createDataFrame([(*d, "clash") for d in docs], "doc_id long, text string, shard string")
    found = S.shared_spans(df, 200, shard_chars=shard_chars)
    assert sorted(map(tuple, found.collect())) == brute_spans(docs, 200)
    parts = {r.doc_id: r for r in S.shared_parts(df, found).collect()}
    assert parts[46].shared_part > 0 and parts[44].shared_part is None and parts[43].n_spans == 0


def test_spans_of_nothing(spark):
    assert S.shared_spans(spark.createDataFrame([], "doc_id long, text string")).count() == 0


HTML = '<html><body><h2 id=a>Title <b>of</b> A &amp; B</h2>\n<p>5 &lt; 6 <code>x</code>\n<ul><li>one<li>two <a href="u">link</a></ul><pre><code>a &lt; b\n  # c</code></pre><p>is <span class="math">\\(x^2\\)</span></body></html>'
MARKDOWN = "Setext **head**\n=====\n\n# Real `one` #\n#77 is none\n\n- a *b*\n* c\n    + d\n1) e\n\n```py\n# code\n- code\n```\n$5 or $7, $HOME, we have $a_1$ and\n\n$$\nx\n$$\n----\n<widget> typed"
WIKI = "h3. {color:red}Head{color} {{x}}\n\n* a [t|http://u]\n** b ??c??\n{code:java}\n* no item\n{code}\nis {math}a+b{math} in {curly}\n{noformat}raw{noformat}"
LATEX = "\\begin{document}\n\\subsection*{Head \\emph{x \\textbf{y}}}\n\\begin{itemize}\n  \\item a \\& \\href{u}{b}\n\\item c\n\\end{itemize}\n\\begin{lstlisting}[language=C]\n\\item no\n\\end{lstlisting}\n\\[ a \\] and \\begin{equation}\nb\n\\end{equation}\n\\end{document}"


@pytest.fixture(scope="module")
def weights():
    return markup.trained()


def found(text, weights):
    bs = blocks(text)
    return [(k, markup._content(k, b)) for k, b in zip(markup.label(weights, [bs])[0], bs) if k != "none"]


def test_notations(weights):
    assert found(HTML, weights) == [("heading", "Title of A & B"), ("list_item", "one"), ("list_item", "two link"), ("code_block", "a < b # c"), ("formula", "x^2")]
    assert found(MARKDOWN, weights) == [("heading", "Setext head"), ("heading", "Real one"), ("list_item", "a b"), ("list_item", "c"), ("list_item", "d"), ("list_item", "e"), ("code_block", "# code - code"), ("formula", "a_1"), ("formula", "x")]
    assert found(WIKI, weights) == [("heading", "Head x"), ("list_item", "a t"), ("list_item", "b c"), ("code_block", "* no item"), ("formula", "a+b"), ("code_block", "raw")]
    assert found(LATEX, weights) == [("heading", "Head x y"), ("list_item", "a & b"), ("list_item", "c"), ("code_block", "\\item no"), ("formula", "a"), ("formula", "b")]


def test_look_alikes(weights):
    for text in ("#77 blocks", "#!x", ">y", "$5 or $7 per x", "+1 for it", "=> gone", "--token=off", "{curly} words", "<widget> was typed", "C:\\temp\\new", "a < b && c > d", "5 * 3 * 2", "", "Map<Key, List<Item>>"):
        assert found(text, weights) == []


def test_labels_are_the_network_s():
    """No rule stands behind the labels: random weights give other ones, and every kind may be given to every block."""
    docs = [blocks(t) for t in (HTML, MARKDOWN, WIKI, LATEX)]
    got = {k for seed in range(3) for d in markup.label(markup_model.init(np.random.default_rng(seed)), docs) for k in d}
    assert len(got) > 3


def test_features_read_the_whole_block():
    a, b = (markup_model.features([Block("p", "word " * 5_000 + last, False)]) for last in ("x", "y"))
    assert a[0] == b[0] and a[1][0][:-1] == b[1][0][:-1] and a[1][0][-1] != b[1][0][-1] and len(a[1][0]) == 5_001


def test_broken_markup_never_fails(weights):
    rnd = random.Random(2)
    pieces = ["<li>", "</ul>", "<pre>", "```", "{code}", "\\begin{verbatim}", "$", "$$", "h1. x", "\n", "# ", "- ", "\0", "\\item ", "\\section{", "}", "<h2>", "</h3>", "word ", "&lt;", "é", "\\(", "\\]", "====\n"]
    for _ in range(400):
        found("".join(rnd.choice(pieces) for _ in range(rnd.randint(0, 40))), weights)
    found("- x\n" * 20_000, weights)


def test_held_out_accuracy(weights):
    held = markup_model.labelled_sample(300, 12345)
    scores = markup_model.scores(weights, [markup_model.features(b) for b, _ in held])
    right = sum(int((s.argmax(1) == np.array(y)).sum()) for s, (_, y) in zip(scores, held))
    assert right / sum(len(y) for _, y in held) > 0.99


def test_gradients_are_right():
    rng = np.random.default_rng(1)
    w = markup_model.init(rng)
    path, mask, words, cell = markup_model._pad([([(3, 30), (9, 31), (4, 32)], [[1, 2], [], [7]]), ([(5, 33)], [[8]])])
    labels = np.array([[1, 2], [0, 0], [3, 0]])

    def loss():
        z = markup_model._logits(w, markup_model._inputs(w, path, words, cell)[0], mask)[0]
        logp = z - np.log(np.exp(z).sum(2, keepdims=True))
        return -(np.take_along_axis(logp, labels[..., None], 2)[..., 0] * mask).sum() / mask.sum()

    g = markup_model._gradients(w, path, mask, words, cell, labels)
    for name, at in (("out", (3, 1)), ("fx", (2, 5)), ("bh", (1, 30)), ("fb", (18,)), ("out", (35, 2)), ("path", (9, 2)), ("word", (2, 1))):
        keep, eps = w[name][at], 1e-6
        w[name][at] = keep + eps
        up = loss()
        w[name][at] = keep - eps
        down = loss()
        w[name][at] = keep
        assert g[name][at] == pytest.approx((up - down) / (2 * eps), rel=1e-4, abs=1e-8)


def test_elements_and_clean_text(spark, weights):
    tracker = spark.createDataFrame([(1, MARKDOWN, "c"), (1, MARKDOWN, "d"), (2, None, "e"), (3, "", "f"), (None, "- a\n- b", "g")], "issue_id long, description_text string, kind string")
    issues = spark.createDataFrame([(9, [None, "plain", HTML]), (9, [None, "plain", HTML]), (8, None), (7, [])], "issue_id long, comments array<string>")
    texts = markup.issue_texts(tracker, issues)
    got = [tuple(r) for r in markup.elements(texts, ["field_name", "issue_id", "item_no"], weights=weights).collect()]
    assert len(got) == len(set(got)) == 9 + 2 + 5 and ("comments", 9, 2, "heading", "Title of A & B") in got and ("description_text", None, 0, "list_item", "a") in got
    clean = {(r.field_name, r.issue_id, r.item_no): r.clean_text for r in markup.clean_text(texts, ["field_name", "issue_id", "item_no"], weights=weights).collect()}
    assert clean["comments", 9, 0] is None and clean["comments", 9, 1] == "plain" and clean["description_text", 3, 0] == "" and clean["comments", 9, 2].startswith("# Title of A & B\n")
    assert markup.elements(texts.limit(0), ["issue_id"], weights=weights).count() == 0


def test_every_notation_alone_is_read(spark):
    texts = ["Overview\n=\nplain", "Overview\n==\nplain", "{CODE}\nx = 1\n{CODE}", "{Noformat}\nraw\n{Noformat}", "{MATH}a + b{MATH}"]
    rows = spark.createDataFrame(list(enumerate(texts)), "k long, text string")
    got = sorted((r.k, r.kind, r.content) for r in markup.elements(rows, ["k"]).collect())
    assert got == [(0, "heading", "Overview"), (1, "heading", "Overview"), (2, "code_block", "x = 1"), (3, "code_block", "raw"), (4, "formula", "a + b")]


def test_paths_the_training_never_saw(weights):
    """Deeper nestings of known tags are labelled by their last tag."""
    cases = [
        ("<table><tr><td><ul><li>alpha beta</li><li>gamma</li></ul></td></tr></table>", ["list_item"] * 2), ("<div><div><h2>Big title</h2><p>text here</p></div></div>", ["heading"]),
        ("<ul><li>a<ol><li>b</li><li>c</li></ol></li><li>d</li></ul>", ["list_item"] * 4), ("<table><tr><td><h3>Cell head</h3></td><td>plain</td></tr></table>", ["heading"]),
        ("<div><table><tbody><tr><td>x1</td><td>y1</td></tr></tbody></table></div>", []), ("<dl><dt>term</dt><dd><ul><li>in dd</li></ul></dd></dl>", ["list_item"]),
        ("<html><body><div><div><h5>fifth</h5><pre>code()</pre></div></div></body></html>", ["heading", "code_block"]), ("*** three stars\n**** four", ["list_item"] * 2),
    ]
    for text, kinds in cases:
        assert [k for k, _ in found(text, weights)] == kinds, text
