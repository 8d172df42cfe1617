"""Operators on single documents and pages against plain versions of the same rules."""

import time
import random
import re

import numpy as np
import public_tokenizers
import pytest
from helpers import by_id, documents, odd
from tokenizers import Tokenizer

from citemill.llm import bpe, html_main, language, pii, repetition, weak_quality

PATH = public_tokenizers.path("word_bpe_49k.json")


def longest(words):
    out = []
    for i in range(len(words)):
        best = 0
        for j in range(len(words)):
            k = 0
            while i != j and i + k < len(words) and j + k < len(words) and words[i + k] == words[j + k]:
                k += 1
            best = max(best, k)
        out.append(best)
    return out


def test_longest_repeats():
    draw = random.Random(1)
    for _ in range(150):
        docs = [[draw.randrange(3) for _ in range(draw.randrange(25))] for _ in range(draw.randrange(1, 6))]
        docs.append([1] * draw.randrange(30))
        got = repetition.longest_repeats(np.array(sum(docs, []), dtype=np.int64), np.repeat(np.arange(len(docs)), [len(d) for d in docs]))
        assert got.tolist() == sum(map(longest, docs), [])


def test_repetition_rules(spark):
    fresh = " ".join(f"a{i}" for i in range(100))
    again = fresh + " " + " ".join(f"a{i}" for i in range(20, 40))
    long = " ".join(f"b{i}" for i in range(120)) + " " + fresh + " c " + " ".join(f"b{i}" for i in range(120)) + " " + " ".join(
        f"d{i}" for i in range(300))
    rows = by_id(repetition.repetition(documents(spark, [fresh, again, long, "few words", "a b c\na b c\n#\n"])))
    assert rows[0].kept and rows[0].spans == [] and rows[0].longest_repeat == 0
    assert rows[1].kept and rows[1].spans == [[20, 40], [100, 120]] and rows[1].n_repeat_words == 40
    assert not rows[2].base_failed and rows[2].longest_repeat == 120 and not rows[2].kept
    assert rows[3].base_failed and not rows[3].kept
    assert (rows[4].n_dup_lines, rows[4].n_symbols, rows[4].n_repeat_words) == (1, 1, 6)


def test_repetition_odd(spark):
    rows = repetition.repetition(odd(spark)).collect()
    assert len(rows) == 10 and all(r.n_words == 0 and r.base_failed for r in rows if r.doc_id in (1, 2, 3))
    assert repetition.repetition(odd(spark).limit(0)).collect() == []


FORMS = (
    re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
)


def plain_forms(text):
    out = [(0, m.start(), m.end()) for m in FORMS[0].finditer(text)]
    out += [(1, m.start(), m.end()) for m in FORMS[1].finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in FORMS[2].finditer(text):
        digits = [int(c) for c in m[0] if c.isdigit()]
        total = sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(reversed(digits)))
        if 16 <= len(digits) <= 19 and total % 10 == 0:
            out.append((2, m.start(), m.end()))
    return out + [(3, m.start(), m.end()) for m in FORMS[3].finditer(text) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]


def test_forms():
    draw = random.Random(2)
    pieces = ["a", "b@", "@", "1", "23", "456", ".", "-", " ", "+", "(", ")", "4041894974608795", "1.2.3.4", "x.y", "\n", "%", "٣"]
    for _ in range(20_000):
        text = "".join(draw.choice(pieces) for _ in range(draw.randrange(25)))
        assert pii.formed(text) == plain_forms(text)


def test_contexts_discover_identifiers(spark):
    texts = [f"noise {i} my staff contact line reaches {'user%d@mail.example.com' % i} during office hours" for i in range(12)]
    texts += ["the staff contact line reaches ZX81-44512-Q during office hours", "they sold 20000123 bricks in the year"]
    rows = by_id(pii.personal_data(documents(spark, texts)))
    assert [rows[i].n_email for i in range(14)] == [1] * 12 + [0, 0]
    start = texts[12].index("ZX81")
    assert rows[12].spans == f"context:{start}:{start + 12}" and rows[12].n_context == 1
    assert rows[13].spans == "" and rows[13].base_sha256 == rows[12].base_sha256
    masked = by_id(pii.masked_texts(documents(spark, texts)))
    assert masked[12].text == "the staff contact line reaches <CONTEXT> during office hours" and masked[13].text == texts[13]
    assert masked[3].text == "noise 3 my staff contact line reaches <EMAIL> during office hours"


def test_personal_data_odd(spark):
    df = odd(spark)
    assert len(pii.personal_data(df).collect()) == 10
    masked = pii.masked_texts(df)
    assert masked.columns == df.columns and sorted(map(str, masked.collect())) == sorted(map(str, df.collect()))
    assert pii.personal_data(df.limit(0)).collect() == []


PAGE = """<html><head><title>T</title><style>p{}</style></head><body><header class=site><div>Site</div></header><nav><a href=/>Home</a></nav>
<div id="cookie-notice">We use cookies, please accept, thanks, all of you.</div>
<div class="wrapper sidebar-right"><div class="content"><h1>Title here</h1><p>First paragraph, with several words, and more &amp; more.</p>
<div class=ad>Buy now, cheap, fast, great offers, amazing!</div><p>Second para.</p><ul><li>one<li>two</ul>
<p>Third &lt;b&gt; paragraph, <a href=x>link</a>,  text<br>more.</p></div>
<div class="sidebar"><h3>Related</h3><ul><li><a>a b</a><li><a>c d</a></ul></div></div>
<section class="comments"><p>I think, this, is, a, long, comment, with commas, yes, yes, yes, yes, and more of it, and more</p></section>
<form><label>Subscribe</label><input></form><script>var x="</p>";</script><footer>c 2020</footer></body></html>"""


TEXT = "A paragraph of an article, with commas, and with enough words to be taken for one."

LINKS = "<ul>" + "".join(f"<li><a href=/{i}>Ref {i}</a></li>" for i in (1, 2, 3)) + "</ul>"

# Blocks that are put into articles.
ADDED = (
    "div class='share-buttons'", "div class=newsletter-signup", "div class=related-posts", "div class=cookie-notice", "div class='promo-box'",
    "div class=banner", "div id=respond", "div class=reader-comments", "ul class=social-links", "aside", "section class='RelatedArticles'",
)


@pytest.mark.parametrize("page, text", [
    (None, ""), ("", ""), ("plain text", "plain text"), ("<p>a<p>b", "a\nb"), ("<div>x < y &amp; z</div>", "x < y & z"),
    ("<nav>menu</nav><article>short</article><footer>f</footer>", "short"), ("<script>x", ""), ("<!-- a", ""), ('<a "b', ""),
    ("<article><p><b>bold<br><p>next</p></article>", "bold\nnext"), ("<b>1</b>2<i>3</i>", "123"),
    ("<main><table><tr><td>a<td>b<tr><td>c</table></main>", "a\nb\nc"), ("<body><div hidden>no</div><p>yes  it is</p></body>", "yes it is"),
    *[(f"<nav>menu</nav><article class='{c}'>{h}<p>{TEXT}</p></article>", f"{t}{TEXT}")
      for c in ("post category-social", "post comments-open", "sidebar widget") for h, t in (("", ""), ("<h1>Head</h1>", "Head\n"))],
    (f"<div class='entry-content has-sidebar'><p>{TEXT}</p><p>{TEXT}</p></div><div class=sidebar>Some notes</div>", f"{TEXT}\n{TEXT}"),
    (f"<article><h2 id='market-share'>Share</h2><p>{TEXT}</p><section id='discussion'><p>Short end.</p></section><p class='notice'>Note.</p>"
     f"<div class='ad-slot'>Buy</div><div id=comments>{TEXT}</div></article>", f"Share\n{TEXT}\nShort end.\nNote."),
    (f"<body><form id=aspnetForm><div class=page><h2>Head</h2><p>{TEXT}</p></div></form><form>Your name</form></body>", f"Head\n{TEXT}"),
    (f"<article><form><p>{TEXT}</p></form><form>Mail address</form></article>", TEXT),
    (f"<main><h2 class='section-header'>Head</h2><p class=notice>{TEXT}</p><div class=share>Tell friends</div></main>", f"Head\n{TEXT}"),
    (f"<p>{TEXT}</p><div class=cookie-notice>We use cookies</div>", TEXT),
    (f"<div class=content><p>{TEXT}</p><p>{TEXT}</p></div><div class=related><article>{TEXT}</article></div>", f"{TEXT}\n{TEXT}"),
    *[(f"<{tag}><p>{TEXT}</p>{LINKS}<p>{TEXT}</p>{LINKS}</{tag}>{LINKS}", f"{TEXT}\nRef 1\nRef 2\nRef 3\n{TEXT}\nRef 1\nRef 2\nRef 3")
      for tag in ("article", "main")],
    (f"<article><section><h2>Sources</h2>{LINKS}</section></article>", "Sources\nRef 1\nRef 2\nRef 3"),
    (f"<div class=content>{LINKS}<p>{TEXT}</p>{LINKS}<p>{TEXT}</p>{LINKS}</div>", f"{TEXT}\nRef 1\nRef 2\nRef 3\n{TEXT}"),
    (f"<body>{LINKS}<p>{TEXT}</p>{LINKS}<p>{TEXT}</p></body>", f"{TEXT}\n{TEXT}"),
    *[(f"<{tag}><h1>Head</h1><p>{TEXT}</p><{added}>Some words to drop.</{added.split()[0]}><p>{TEXT}</p></{tag.split()[0]}>", f"Head\n{TEXT}\n{TEXT}")
      for tag in ("article", "main", "div class='post'") for added in ADDED],
    (f"<article><p>{TEXT}</p><div class=newsletter-signup><h3>News</h3><p>{TEXT}</p><form>Mail</form></div><p>{TEXT}</p><p>{TEXT}</p></article>",
     f"{TEXT}\n{TEXT}\n{TEXT}"),
    (f"<article><div class='banner promo-box'><p>{TEXT}</p><p>{TEXT}</p></div><p>{TEXT}</p></article>", f"{TEXT}\n{TEXT}\n{TEXT}"),
    (f"<article><section id=banner><p>{TEXT}</p></section><h2 class=related-posts>On it</h2><p class=promo>{TEXT}</p></article>",
     f"{TEXT}\nOn it\n{TEXT}"),
    (f"<div class=post><p>{TEXT}</p><div class='reader-comments'><p>{TEXT} {TEXT}</p></div></div>", TEXT),
    (PAGE, "Title here\nFirst paragraph, with several words, and more & more.\nSecond para.\none\ntwo\nThird <b> paragraph, link, text more."),
])
def test_main_text(page, text):
    assert html_main.main_text(page) == text


def test_main_text_of_hostile_pages():
    for page in ("<div>x" * 20_000, "<p " * 20_000, "</div>" * 20_000, '<a "' * 20_000, "<table><tr>" * 5_000, "&amp" * 50_000):
        assert isinstance(html_main.main_text(page), str)


@pytest.mark.parametrize("unit, n", [
    ("<div>", 20_000), ("<b>", 20_000), ("<div><h1></h1>", 10_000), ("<li>", 20_000), ("<td><p>", 12_000), ("</b>", 20_000),
])
def test_main_text_in_linear_time(unit, n):
    """Twice the page takes about twice the time, whatever stays open."""
    def seconds(page):
        start = time.process_time()
        html_main.main_text(page)
        return time.process_time() - start

    for head, tail in (("<p><button>", ""), ("", "<hr>x" * n)):
        half, whole = (seconds(head + unit * k + tail[: 5 * k]) for k in (n // 2, n))
        assert whole < 3 * half + 0.5


def test_main_texts_frame(spark):
    pages = spark.createDataFrame([(1, "u", PAGE, "x"), (None, None, None, "x"), (1, "u", PAGE, "x")], "page_id long, url string, html string, text string")
    rows = html_main.main_texts(pages).collect()
    assert len(rows) == 3 and all(r.n_chars == len(r.text) for r in rows)
    assert html_main.main_texts(pages.limit(0)).collect() == []


def test_bpe_as_the_library():
    library, own = Tokenizer.from_file(PATH), bpe.vocabulary(PATH)
    draw = random.Random(3)
    signs = "aaeeiinnsstth r'éßΣσİǅ五\U0001f389!?.<|>\x1c\x85 ́　K12½Ⅷ\n"
    texts = ["".join(draw.choice(signs) for _ in range(draw.randrange(60))) for _ in range(3000)]
    texts += ["a<|endoftext|>World's<|startoftext|>'ll", "a" * 3000, "ab" * 2000, "in" * 2000 + "g", "", "\x01\x02"]
    for text in texts:
        want = library.encode(text, add_special_tokens=False).ids
        ids = own.encode(text)
        assert ids.tolist() == want
        assert own.decode(ids).decode() == library.decode(want, skip_special_tokens=False)


def test_bpe_frame(spark):
    df = odd(spark)
    coded = bpe.encode_texts(df, PATH)
    rows = coded.collect()
    empty = {r.ids_sha256 for r in rows if r.doc_id in (1, 2, 3)}
    assert len(rows) == 10 and len(empty) == 1 and all(r.n_tokens == len(r.ids) for r in rows)
    decoded = bpe.decode_texts(coded, PATH)
    assert {r.decoded for r in decoded.where("doc_id = 4").collect()} == {"x</w>"}
    assert bpe.encode_texts(df.limit(0), PATH).collect() == []


def test_language_against_plain_counts(spark):
    texts = ["the cat and the dog", "der Hund und die Katze", "the bird is there", "das ist der Vogel", "12 34", None, "the ä ist"]
    langs = ["en", "de", "en", "de", "en", "de", None]
    df = documents(spark, texts, langs)
    names, matrix = language.train(df)
    assert names == ["de", "en"]
    counts = {n: np.zeros(language.BUCKETS) for n in names}
    for t, x in zip(texts, langs):
        if t is not None and x is not None:
            np.add.at(counts[x], language.grams([t])[0], 1)
    for k, n in enumerate(names):
        assert np.allclose(matrix[k, :-1], np.log((counts[n] + 0.5) / (counts[n] + 0.5).sum()))
    rows = df.select("doc_id", language.predict((names, matrix), df).alias("p")).select("doc_id", "p.*").collect()
    for r in rows:
        text = texts[r.doc_id]
        if text is None or not any(c.isalpha() for c in text):
            assert (r.lang_pred, r.score) == ("und", 0.0)
        else:
            logs = matrix[:, :-1].astype(np.float32).astype(float)[:, language.grams([text])[0]].sum(axis=1) + matrix[:, -1]
            assert r.lang_pred == names[int(np.argmax(logs))] and abs(r.score - 1 / np.exp(logs - logs.max()).sum()) < 1e-6


def test_language_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = language.held_out_languages(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(rows) > 100 and sum(r.lang == r.lang_pred for r in rows) >= 0.97 * len(rows)


def test_language_odd(spark):
    rows = language.held_out_languages(odd(spark)).collect()
    assert len(rows) == 10 and all(r.lang_pred == "und" for r in rows if r.doc_id in (1, 2, 3))
    assert language.held_out_languages(odd(spark).limit(0)).collect() == []


def test_estimate_recovers_accuracies():
    draw = np.random.default_rng(5)
    truth = draw.random(20_000) < 0.7
    right = np.array([0.9, 0.8, 0.75, 0.85, 0.7])
    votes = np.where(draw.random((20_000, 5)) < right, truth[:, None], ~truth[:, None]).astype(int)
    votes[draw.random(votes.shape) < 0.2] = weak_quality.NONE
    combinations, counts = np.unique(votes, axis=0, return_counts=True)
    posterior, chances, share = weak_quality.estimate(combinations, counts.astype(float))
    assert abs(share - 0.7) < 0.03
    assert np.allclose(chances[1, :, 2] / (1 - chances[1, :, 0]), right, atol=0.04)


def test_quality_against_labels(spark):
    folder = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    rows = weak_quality.quality(spark.read.parquet(f"{folder}/documents.parquet")).join(labels, "doc_id").collect()
    good = [r.kept for r in rows if r.quality == 1]
    bad = [r.kept for r in rows if r.quality == 0]
    assert sum(good) >= 0.98 * len(good) and sum(bad) <= 0.1 * len(bad)


def test_quality_odd(spark):
    rows = weak_quality.quality(odd(spark)).collect()
    assert len(rows) == 10 and all(r.votes is None and not r.kept for r in rows if r.doc_id in (1, 2, 3))
    assert weak_quality.quality(odd(spark).limit(0)).collect() == []
