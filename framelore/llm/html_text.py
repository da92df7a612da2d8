"""Main text of web pages by a maximum-scoring subsequence.

A page is a sequence of tokens: runs of words and tags. A word scores the log odds that it is the article's, by a logistic model of
its features: the names and class words of all open elements, what holds it, whether it is a link, how long its block is and how
much of that is links. Tags score below zero. One linear scan finds the contiguous region of the highest sum, and inside it runs of
words that score below zero, an advert in an article say, are cut once more. Nothing but scores decides.

The weights are learned from labelled pages, those whose own markup names the article. Each is read in four views: as it is, with
no element that names the article, with an article around all of it, and so without names of elements; what is left has to tell
the article's words in pages of each kind. The fixed lists below label those pages, and are one feature among others, ``apart``,
whose weight is learned.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from math import log
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_rows, table

FIT_PAGES = 500
#: Most distinct sets of features that the fit takes to the driver; more raise an error.
FIT_SETS = 200_000
PENALTY = 1e-3
#: Names of elements and lengths of blocks say how a page is laid out; they are penalised as many times more.
LAYOUT = 10.0
#: A word's score lies between -MOST and MOST. Scores below zero and a tag's, -MOST_TAG_COST to -LEAST_TAG_COST, are small beside
#: those above, so that an advert of a hundred words doesn't outweigh the article's last line behind it.
MOST, COST = 4.0, 0.02
LEAST_TAG_COST, MOST_TAG_COST = 0.001, 0.02
#: Sum of scores below zero from which a run of words inside the region is cut.
LEAST_CUT = 0.01

#: Element names.
RAW = "script|style|noscript|template|textarea|title|iframe|svg|select|button|canvas|object|audio|video|math"
BLOCKS = frozenset("address article aside blockquote body center caption dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Elements that hold others of their own; the rest of the blocks ends where another of these or its own kind begins.
HOLDERS = BLOCKS - VOID - frozenset("p h1 h2 h3 h4 h5 h6 li dd dt option td th tr".split())
NEVER = frozenset("head nav footer aside form menu dialog search fieldset".split())
MAIN = frozenset(("article", "main"))
#: Words in class, id and role that name what is no article, and those among them that name comments.
NEVER_WORDS = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs sidebar aside footer masthead topbar toolbar cookie cookies consent gdpr notice notices alert banner popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended comments comment disqus replies respond widget pagination pager skip complementary contentinfo".split())
COMMENTS = frozenset("comments comment disqus replies respond".split())

_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(?P<raw>{RAW})\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)|<(?P<end>/?)(?P<name>[a-z][a-z0-9:-]*+)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|</?[a-z][^>]*(?:>|\Z)|<[!?/][^>]*(?:>|\Z)",
    re.S | re.I,
)
_NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)
_PART = re.compile(r"[a-z]+")

Features = frozenset[str]


@lru_cache(maxsize=20_000)
def _attributes(attrs: str) -> tuple[frozenset[str], bool]:
    """Words in class, id and role, and whether the element is hidden."""
    return frozenset(word for groups in _NAMED.findall(attrs) for value in groups for word in _PART.findall(value.lower())), bool(_HIDDEN.search(attrs))


class Open:
    """An open element. ``features`` are the names of those open since the innermost article, class words of others than it too."""

    def __init__(self, name: str, attrs: str, around: Open | None, plain: bool) -> None:
        words, hidden = _attributes(attrs) if attrs else (frozenset(), False)
        self.name = "div" if plain and name in MAIN else name
        own_main = self.name in MAIN
        self.in_main = own_main or (around is not None and around.in_main)
        self.comments = bool(around and around.comments) or not words.isdisjoint(COMMENTS)
        set_apart = name in NEVER or hidden or not words.isdisjoint(NEVER_WORDS) or (name == "header" and not (around and around.in_main))
        if name in MAIN:  # what is open around an article was not closed, but for comments
            self.apart = self.comments
            self.features: Features = frozenset((f"element {self.name}",))
        else:
            self.apart = self.comments or set_apart or bool(around and around.apart)
            self.features = (around.features if around else frozenset()) | {f"element {name}", *(f"class {w}" for w in words), *(["hidden"] if hidden else [])}


class Token(NamedTuple):
    """kind: text, tag (a block begins or ends) or space."""

    kind: str
    holder: str
    link: bool
    element: Open
    text: str


def tokens(page: str, plain: bool = False) -> Iterator[Token]:
    """The page's tokens in order; ``plain``: as if no element named an article."""
    body = Open("body", "", None, plain)
    stack: list[Open] = [body]
    link, at = False, 0

    def close(name: str) -> None:
        """Ends the element of that name, with what is open in it. One that holds no others can't end one that does."""
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].name == name:
                del stack[i:]
                return
            if name not in HOLDERS and stack[i].name in HOLDERS:
                return

    for m in _TOKEN.finditer(page):
        if m.start() > at:
            yield Token("text", stack[-1].name, link, stack[-1], page[at : m.start()])
        at = m.end()
        name = (m["name"] or "").lower()
        if plain and name in MAIN:
            name = "div"
        if name == "a":
            link = not m["end"]
        if name == "br":
            yield Token("space", stack[-1].name, link, stack[-1], " ")
        elif name in BLOCKS:
            link = False
            if m["end"]:
                close(name)
            elif name not in VOID:
                for ended in ("p", name) if name not in HOLDERS else ("p",):
                    close(ended)
                if not m["attrs"].endswith("/"):
                    stack.append(Open(name, m["attrs"], stack[-1], plain))
            yield Token("tag", name, False, stack[-1], "")
        elif name and name not in VOID:
            # An inline element counts where its attributes say something.
            if m["end"]:
                close(name)
            elif m["attrs"] and not m["attrs"].endswith("/"):
                words, hidden = _attributes(m["attrs"])
                if words or hidden:
                    stack.append(Open(name, m["attrs"], stack[-1], plain))
    if at < len(page):
        yield Token("text", stack[-1].name, link, stack[-1], page[at:])


def _bucket(n: int) -> int:
    return min(7, n.bit_length())


def described(page: str, plain: bool = False, around: bool = False, layout: bool = True) -> Iterator[tuple[Token, int, Features]]:
    """Tokens, their numbers of words, and the features of text; ``around``: as if an article held the whole page; without
    ``layout`` elements have no names."""
    found = list(tokens(page, plain))
    sizes = [len(t.text.split()) if t.kind == "text" else 0 for t in found]
    inside = outside = 0
    for t, n in zip(found, sizes, strict=True):
        if not t.element.apart:
            inside, outside = inside + n * t.element.in_main, outside + n * (not t.element.in_main)
    named = inside >= max(1, outside)  # else articles are teasers of others
    begin = 0
    for i in range(len(found) + 1):
        if i < len(found) and found[i].kind != "tag":
            continue
        whole = sum(sizes[begin:i])
        linked = sum(n for t, n in zip(found[begin:i], sizes[begin:i], strict=True) if t.link)
        block = {f"length {_bucket(whole)}", f"links {round(2 * linked / whole) if whole else 0}"}
        memo: dict[tuple, Features] = {}
        for t, n in zip(found[begin:i], sizes[begin:i], strict=True):
            key = (id(t.element), t.link)
            if key not in memo:
                place = "in article" if around or (named and t.element.in_main) else "outside article" if named else "no article"
                names = t.element.features if layout else frozenset(f for f in t.element.features if not f.startswith("element "))
                memo[key] = names | block | {place, *(["apart"] if t.element.apart else []), *(["link"] if t.link else [])}
            yield t, n, memo[key]
        if i < len(found):
            yield found[i], 0, frozenset()
        begin = i + 1


def count_labels(page: str) -> Iterator[tuple[str, int, int]]:
    """(features, words inside, words outside) of the four views of a page whose markup names its article, and counts of tags.

    Inside are the words of the article that are not set apart. Nothing for another page.
    """
    labels = [t.element.in_main and not t.element.apart for t in tokens(page)]
    if not any(labels):
        return
    inside: Counter[str] = Counter()
    outside: Counter[str] = Counter()
    for view in ((False, False, True), (True, False, True), (True, True, True), (True, True, False)):
        for is_in, (t, n, features) in zip(labels, described(page, *view), strict=True):
            into = inside if is_in else outside
            if t.kind == "text" and n:
                into[" ".join(sorted(x.replace(" ", ":") for x in features))] += n
            elif t.kind == "tag" and not view[0]:
                into["tag:" + t.holder] += 1
    yield from ((k, inside[k], outside[k]) for k in inside | outside)


def weights(counts: list[tuple[str, int, int]], penalty: float = PENALTY) -> dict[str, float]:
    """A weight for each feature and the constant "", from counts by set of features; and for each tag."""
    tags = [x for x in counts if x[0].startswith("tag:")]
    words = [x for x in counts if not x[0].startswith("tag:")]
    out = {}
    all_in, all_out = sum(i for _, i, _ in tags) + 1, sum(o for *_, o in tags) + 1
    for key, i, o in tags:
        odds = log((i + 1) / all_in) - log((o + 1) / all_out)
        out[key] = min(-LEAST_TAG_COST, max(-MOST_TAG_COST, COST * odds))
    names = sorted({x for key, *_ in words for x in key.split()})
    place = {x: i for i, x in enumerate(names)}
    x = np.zeros((len(words), len(names) + 1))
    for row, (key, *_) in enumerate(words):
        x[row, [place[f] for f in key.split()]] = 1
    x[:, -1] = 1
    # Both kinds of words count alike in all, so that long articles don't outweigh what lies around them.
    n = np.array([c for _, *c in words], float).reshape(-1, 2)
    n /= 2 * np.maximum(n.sum(0), 1)
    w = np.zeros(x.shape[1])
    each = penalty * np.array([LAYOUT if f.startswith(("element:", "length:")) else 1.0 for f in names] + [1.0])
    for _ in range(100):  # Newton's steps to the least penalised loss
        p = 1 / (1 + np.exp(-x @ w))
        gradient = x.T @ (n.sum(1) * p - n[:, 0]) + each * w
        step = np.linalg.solve((x.T * (n.sum(1) * p * (1 - p))) @ x + np.diag(each), gradient)
        w -= step
        if np.abs(step).max(initial=0) < 1e-9:
            break
    return out | dict(zip([*names, ""], w.tolist(), strict=True)) if words else out


def best_region(scores: list[float]) -> tuple[int, int]:
    """Begin and end of the contiguous stretch of the highest sum above zero, of a tie the first to reach it; (0, 0) if none."""
    best, begin, end, run, start = 0.0, 0, 0, 0.0, 0
    for i, x in enumerate(scores):
        run += x
        if run > best:
            best, begin, end = run, start, i + 1
        elif run <= 0:
            run, start = 0.0, i + 1
    return begin, end


def token_scores(page: str, weight: dict[str, float]) -> tuple[list[Token], list[float]]:
    """The page's tokens and their scores: a run of words has the sum of its words'."""
    found, scores = [], []
    memo: dict[Features, float] = {}
    for t, n, features in described(page):
        if t.kind == "tag":
            score = weight.get("tag:" + t.holder, -LEAST_TAG_COST)
        elif not n:
            score = 0.0
        else:
            if features not in memo:
                memo[features] = min(MOST, max(-MOST, weight.get("", 0.0) + sum(weight.get(f.replace(" ", ":"), 0.0) for f in sorted(features))))
            score = n * memo[features] * (COST if memo[features] < 0 else 1)
        found.append(t)
        scores.append(score)
    return found, scores


def kept_tokens(found: list[Token], scores: list[float]) -> list[Token]:
    """Tokens of the best region, less the text of runs below zero, LEAST_CUT or more in sum, between words above zero."""
    begin, end = best_region(scores)
    out: list[Token] = []
    below: list[Token] = []
    lost = 0.0
    above = False
    for t, score in zip(found[begin:end], scores[begin:end], strict=True):
        if score > 0:
            cut = above and lost <= -LEAST_CUT
            out += [x for x in below if x.kind != "text"] if cut else below
            out.append(t)
            below, lost, above = [], 0.0, True
        else:
            below.append(t)
            lost += score if t.kind == "text" else 0.0
    return out + below


def extract(page: str | None, weight: dict[str, float]) -> str:
    """The main text of a page: white space runs as one space, blocks in page order joined by a line feed."""
    if not page:
        return ""
    blocks, block = [], []
    for t in kept_tokens(*token_scores(page, weight)):
        if t.kind == "tag":
            blocks.append("".join(block))
            block = []
        else:
            block.append(t.text)
    blocks.append("".join(block))
    whole = (" ".join(html.unescape(x).split()) for x in blocks)
    return "\n".join(x for x in whole if x)


def learn(pages: DataFrame, fit_pages: int = FIT_PAGES) -> dict[str, float]:
    """Weights from at most ``fit_pages`` pages, drawn by a hash of page_id, whose markup names the article."""
    named = F.col("html").rlike(r"(?i)<(article|main)\b")
    ids = pages.where(named & F.col("page_id").isNotNull()).select("page_id").orderBy(F.xxhash64("page_id"), "page_id").limit(fit_pages)
    drawn = pages.select("page_id", "html").join(F.broadcast(ids.distinct()), "page_id")

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        for (page,) in rows:
            yield from count_labels(page or "")

    counts = map_rows(drawn, ["html"], "key string, inside long, outside long", run).groupBy("key").agg(F.sum("inside").alias("inside"), F.sum("outside").alias("outside"))
    found = sorted(tuple(r) for r in counts.limit(FIT_SETS + 1).collect())
    if len(found) > FIT_SETS:
        raise ValueError(f"over {FIT_SETS} sets of features in {fit_pages} pages")
    return weights(found)


def extract_pages(pages: DataFrame, weight: dict[str, float]) -> DataFrame:
    """page_id, url, text, n_chars for every row. A null or empty page, or one without content, has empty text.

    Very long pages are read whole, each in its task. Repeated rows and null ids or urls pass through; an empty table gives no
    rows, and other columns are ignored.
    """

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        for page_id, url, page in rows:
            text = extract(page, weight)
            yield page_id, url, text, len(text)

    return map_rows(pages, ["page_id", "url", "html"], "page_id long, url string, text string, n_chars long", run)


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return extract_pages(pages, learn(pages))
