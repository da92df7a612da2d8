"""Weights decide what a page's main text is; markup that names the article only labels pages."""

import html
import random

import pyarrow.parquet as pq
import pytest

from framelore.llm import html_text

BODY = "<p>" + "the body of the page has many words in it " * 5 + "</p>"
PAGE = """<body><nav><ul><li><a href=/>Home page of ours</a></ul></nav><div class="ad">Buy now, it is cheap</div>{open}<h1>A title of some words</h1>{body}
<div class="promo box">Our offer of the day</div>{body}{close}<section class="comments"><article class="comment"><p>Nice post, thank you</article></section><footer>Our company</footer></body>"""
BODY_TEXT = "the body of the page has many words in it " * 4 + "the body of the page has many words in it"
TEXT = "A title of some words\n" + "\n".join([BODY_TEXT] * 2)


def page(open_="<article>", close="</article>", body=BODY):
    return PAGE.format(open=open_, close=close, body=body)


@pytest.fixture(scope="module")
def weight():
    counts = {}
    for _ in range(30):
        for key, inside, outside in html_text.count_labels(page()):
            a, b = counts.get(key, (0, 0))
            counts[key] = a + inside, b + outside
    return html_text.weights([(k, *v) for k, v in counts.items()])


def test_pages_with_and_without_an_article(weight):
    assert html_text.extract(page(), weight) == TEXT
    assert html_text.extract(page("", ""), weight) == TEXT
    assert html_text.extract(page("<div><div>", "</div></div>"), weight) == TEXT


def test_a_class_word_on_the_article_deletes_nothing(weight):
    assert html_text.extract(page('<article class="related-social-notice">'), weight) == TEXT
    assert html_text.extract(page('<main id="social-promo-ad">', "</main>"), weight) == TEXT


@pytest.mark.parametrize(
    "inner",
    ['<p class="ad">Buy it</p>', '<ul class="related"><li>See this<li>and <a href=x>that</a></ul>', "<p hidden>Hidden words</p>", "<aside>A side note</aside>", "<form>Sign up <input></form>", '<div style="display:none">Hid</div>', '<div class="cookie-notice">We use cookies</div>', '<section class="comments"><article class="comment"><p>Nice post</p></article></section>'],
)
def test_what_is_set_apart_goes_and_what_is_around_stays(weight, inner):
    for open_, close in (("<article>", "</article>"), ("<main>", "</main>"), ("<div>", "</div>"), ('<div class="post"><div>', "</div></div>")):
        assert html_text.extract(page(open_, close, BODY + inner + BODY), weight) == TEXT.replace(BODY_TEXT, BODY_TEXT + "\n" + BODY_TEXT)
    assert html_text.extract(page(body=BODY + '<p>keep <span style="display:none">not this</span>this'), weight).count("keep this") == 2


def test_the_weights_decide(weight):
    """With the signs of the weights turned round, the same page gives other text; with none, its boilerplate comes along."""
    assert html_text.extract(page(), {k: -v for k, v in weight.items()}) != TEXT
    assert html_text.extract(page(), {k: v for k, v in weight.items() if k != "apart"}) != TEXT
    assert html_text.extract(page(), {}) == ""


def driver_pages():
    return [r["html"] for r in pq.read_table("/root/testdata/sf0.001/pages.parquet", columns=["html"]).to_pylist()]


def test_scan_and_weights_both_change_whole_pages(weight, monkeypatch):
    pages = driver_pages()
    texts = [html_text.extract(p, weight) for p in pages]
    assert all(html_text.extract(p, {}) != t for p, t in zip(pages, texts, strict=True))
    monkeypatch.setattr(html_text, "best_region", lambda scores: (0, len(scores)))
    assert all(html_text.extract(p, weight) != t for p, t in zip(pages, texts, strict=True))


def brute_text(found, scores):
    """All regions compared, then every token of the best held against the words around it."""
    n = len(scores)
    sums = {(i, j): sum(scores[i:j]) for i in range(n) for j in range(i + 1, n + 1)}
    if not sums or max(sums.values()) <= 0:
        return ""
    most = max(sums.values())
    i, j = min((x for x, s in sums.items() if s > most - 1e-9), key=lambda x: (x[1], -x[0]))
    words = [k for k in range(i, j) if scores[k] > 0]
    blocks = [[]]
    for k in range(i, j):
        before, after = [w for w in words if w < k], [w for w in words if w > k]
        between = sum(scores[m] for m in range(before[-1] + 1, after[0]) if found[m].kind == "text") if before and after else 0
        if found[k].kind == "tag":
            blocks.append([])
        elif scores[k] > 0 or found[k].kind == "space" or between > -html_text.LEAST_CUT:
            blocks[-1].append(found[k].text)
    return "\n".join(x for x in (" ".join(html.unescape("".join(b)).split()) for b in blocks) if x)


def test_extraction_against_all_regions(weight):
    pages = [p for p in driver_pages() if len(p) < 6000][:40] + [page(body="<p>a few <i>words</i> &amp; a sign<br>more" + '<p class="ad">x y z' + BODY)]
    for p in pages:
        assert html_text.extract(p, weight) == brute_text(*html_text.token_scores(p, weight))


def test_the_region_is_the_best_of_all():
    rng = random.Random(4)
    for _ in range(300):
        scores = [rng.randrange(-5, 5) / 2 for _ in range(rng.randrange(0, 14))]
        begin, end = html_text.best_region(scores)
        assert sum(scores[begin:end]) == max(sum(scores[i:j]) for i in range(len(scores) + 1) for j in range(i, len(scores) + 1))


def test_text_outside_a_teaser_is_kept(weight):
    got = html_text.extract(f"<body><article><p>A short teaser.</article><div>{BODY}</div></body>", weight)
    assert "A short teaser." in got and BODY_TEXT in got


def test_labels_of_a_page_in_all_views():
    counts = {frozenset(k.split()): (i, o) for k, i, o in html_text.count_labels('<div class="ad">Buy now</div><article><p>One two</article>')}
    assert counts[frozenset(["element:body", "element:div", "class:ad", "apart", "outside:article", "length:2", "links:0"])] == (0, 2)
    assert counts[frozenset(["element:article", "element:p", "in:article", "length:2", "links:0"])] == (2, 0)
    assert counts[frozenset(["class:ad", "apart", "in:article", "length:2", "links:0"])] == (0, 2)
    assert counts[frozenset(["element:body", "element:div", "element:p", "no:article", "length:2", "links:0"])] == (2, 0)
    assert list(html_text.count_labels("<p>No article here")) == []


def test_very_long_pages(weight):
    long = page(body=BODY * 4000)
    assert html_text.extract(long, weight).count("\n") == 8000
    assert html_text.extract("<div>" * 3000 + "words in the deep " + "</div>" * 3000, weight) == "words in the deep"
    assert html_text.extract("<" * 100_000, weight) is not None
