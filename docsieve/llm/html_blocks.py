"""Main text of web pages: flat text blocks, classified by a decision tree.

A page becomes a flat list of text blocks (cut at block-level tags). A block's features are its word count and link
density, the same of the block before and of the one after it, and what its place says: how surely it lies in boilerplate
(0 nothing, 1 an ambiguous name, a form; 2 a name such as ``sidebar``; 3 navigation, footer, aside, hidden parts), whether
it lies in a part that announces the article, and whether it is the text of a paragraph, heading, list item or cell. A
decision tree keeps or drops each block. It is grown on the labelled table ``LABELLED``: the blocks of small pages of many
layouts (articles in <article>, in plain <div>s, in one cell of a table, in a page-wide form, under ambiguous names; with
menus, adverts, teasers, readers' comments and footers, named or not), whose words tell which blocks are the text. No
feature decides alone: long blocks of text among their like stay under an ambiguous name and without any, short ones
between links go.

Defined results: null and empty pages give an empty text; scripts, styles, comments and form controls never count;
references are decoded; white space becomes one space; an empty table gives none; repeated rows are done each.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TAG = re.compile(r"</?([a-zA-Z][^\s/>]*)")
RAW = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in ("script", "style", "title", "textarea")}
STOPS = re.compile(r"[\"'>]")
ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
#: Skipped up to their end tag; without one only the tag itself is, since the rest of the page would go with it.
SKIPPED = {t: re.compile(rf"</{t}\s*>", re.I) for t in "noscript template select button option svg iframe object canvas math datalist".split()}
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark meter nobr output progress q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
FRAMES = frozenset("div section article main nav header footer aside form ul ol dl table td th tr tbody figure figcaption details dialog fieldset menu body html center blockquote".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BOILER_TAGS = frozenset("nav footer aside menu dialog".split())
HINTS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promos promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup nav navbar "
    "navigation menu breadcrumb breadcrumbs sidebar sidebars aside widget widgets related recommended recommendations share sharing social footer copyright legal disclaimer comment comments commentlist reply replies respond disqus discussion login search toolbar "
    "pagination pager contentinfo complementary skip paywall masthead topbar feedback teaser teasers rail rightcol leftcol sidecol".split()
)
#: Names that articles and their parts carry too: alone they make a place doubtful, no more.
AMBIGUOUS = frozenset("legal notice notices alert banner promotion promo promos discussion respond reply replies social search disclaimer copyright overlay signup login rail rightcol leftcol sidecol col teaser skip".split())
#: Words of a name that speak of content: with them a boilerplate word beside is doubtful.
CONTENT = frozenset("content main article story body text page entry".split())
#: Names of side columns that are written in two words.
COLUMNS = frozenset("right-col left-col side-col right-column left-column side-column".split())
#: Names that a paragraph of an article may well carry: there they say nothing.
SOFT = frozenset("social search login legal notice notices alert discussion reply replies respond skip banner disclaimer copyright footer menu comment comments topbar pager toolbar share sharing".split())
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th pre blockquote figcaption caption".split())
ARTICLE_HINTS = frozenset("articlebody article-body article-content article-text post-body post-content entry-content story-body main-content maincontent".split())
#: Tokens that speak of a post's subject or state, or of a page's layout, not of the element's own part in the page.
_NO_HINT = re.compile(r"(?:^|[-_])(?:has|with|no|without|is)[-_]|^(?:category|tag|layout)[-_]|[-_](?:open|closed|wrap|wrapper|container|layout)$")
#: How sure a boilerplate mark is: an ambiguous name or a form, a name, the tag itself or a hidden element.
WEAK, STRONG, SURE = 1, 2, 3
WORD = re.compile(r"\w+")

class Tree:
    """A CART tree by Gini impurity."""

    def __init__(self, x: np.ndarray, y: np.ndarray, depth: int = 10):
        self.keep = bool(2 * y.sum() > len(y))
        self.feature = None
        if depth == 0 or y.min() == y.max():
            return
        best = (1e-9, None, 0.0)
        base = self._impurity(y) * len(y)
        for f in range(x.shape[1]):
            values = np.unique(x[:, f])
            for cut in (values[1:] + values[:-1]) / 2:
                left = x[:, f] < cut
                gain = base - self._impurity(y[left]) * left.sum() - self._impurity(y[~left]) * (~left).sum()
                if gain > best[0] + 1e-12:
                    best = (gain, f, cut)
        if best[1] is not None:
            self.feature, self.cut = best[1], best[2]
            left = x[:, self.feature] < self.cut
            self.low, self.high = Tree(x[left], y[left], depth - 1), Tree(x[~left], y[~left], depth - 1)

    @staticmethod
    def _impurity(y: np.ndarray) -> float:
        p = y.mean() if len(y) else 0.0
        return 2 * p * (1 - p)

    def predict(self, x: np.ndarray) -> np.ndarray:
        if self.feature is None:
            return np.full(len(x), self.keep)
        left = x[:, self.feature] < self.cut
        out = np.empty(len(x), bool)
        out[left], out[~left] = self.low.predict(x[left]), self.high.predict(x[~left])
        return out


def _mark_of(token: str) -> int:
    """How surely a name is one of boilerplate."""
    if token in HINTS:
        return WEAK if token in AMBIGUOUS else STRONG
    if token in COLUMNS:
        return WEAK
    parts = frozenset(re.split(r"[-_]+", token))
    if HINTS.isdisjoint(parts) or _NO_HINT.search(token):
        return 0
    sure = not (HINTS & parts) <= AMBIGUOUS
    if CONTENT.isdisjoint(parts):
        return STRONG if sure else WEAK
    return WEAK if sure else 0


def _place(tag: str, rest: str, in_article: bool) -> tuple[int, bool]:
    """(how surely it starts boilerplate, starts the article) of an opening tag."""
    boiler = SURE if tag in BOILER_TAGS or (tag == "header" and not in_article) else WEAK if tag == "form" else 0
    article = tag in ("article", "main")
    if rest and tag not in ("html", "body", "main"):
        for name, a, b, c in ATTRIBUTE.findall(rest):
            name, value = name.lower(), (a or b or c).lower()
            if name == "hidden" or (name == "aria-hidden" and value == "true"):
                boiler = SURE
            elif name == "style":
                boiler = SURE if "display:none" in value.replace(" ", "") else boiler
            elif name in ("class", "id", "role", "itemprop"):
                for token in value.split():
                    if in_article and tag in PROSE and token in SOFT:
                        continue
                    if token in ARTICLE_HINTS:
                        article = True
                    elif token == "header" and tag != "article" or token == "masthead":
                        boiler = boiler if in_article else max(boiler, STRONG)
                    elif tag != "article":
                        boiler = max(boiler, _mark_of(token))
        if article:
            boiler = boiler if boiler == SURE else 0
    return boiler, article


def _inherited(tag: str, article: bool, outer: int) -> int:
    """The outer boilerplate mark as far as it holds here: an article ends a weak one, <main> any that comes from a name."""
    return 0 if outer <= (STRONG if tag == "main" else WEAK if article else 0) else outer


def tag_end(page: str, at: int, last_quote: dict[str, int]) -> int:
    """The place after the ``>`` that ends a tag. Quoted values are passed over, unless their quote is the page's last one.
    A tag that never ends takes the rest of the page with it, as in a browser."""
    while True:
        m = STOPS.search(page, at)
        if not m:
            return len(page)
        k, at, c = m.start() - 1, m.end(), m.group()
        if c == ">":
            return at
        while page[k].isspace():
            k -= 1
        if page[k] == "=" and last_quote[c] >= at:
            at = page.find(c, at) + 1


def blocks(page: str) -> list[tuple[str, int, float, int, bool, bool]]:
    """(text, words, link density, boilerplate mark, article place, prose) of the text blocks in page order."""
    out: list[tuple[str, int, float, int, bool, bool]] = []
    stack: list[tuple[str, int, bool]] = []  # tag, boilerplate, article; what is inside inherits
    parts: list[str] = []
    linked, in_link, place, kind = 0, 0, (0, False), ""

    def close() -> None:
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                words = len(text.split())
                out.append((text, words, min(1.0, linked / words), place[0], place[1], kind in PROSE))
            parts.clear()
        linked = 0

    def say(text: str) -> None:
        nonlocal linked
        text = html.unescape(text)
        parts.append(text)
        if in_link:
            linked += len(text.split())

    opened: Counter[str] = Counter()  # how many of a tag the stack holds
    at, endless, last_quote = 0, set(), {c: page.rfind(c) for c in "\"'"}
    while at < len(page):
        lt = page.find("<", at)
        if lt != at:
            lt = len(page) if lt < 0 else lt
            say(page[at:lt])
            at = lt
            continue
        if page.startswith(("<!", "<?"), at):
            end = page.find("-->", at + 4) if page.startswith("<!--", at) else page.find(">", at)
            at = len(page) if end < 0 else end + (3 if page.startswith("<!--", at) else 1)
            continue
        m = TAG.match(page, at)
        if not m:
            say("<")
            at += 1
            continue
        begin, at = m.end(), tag_end(page, m.end(), last_quote)
        tag, ending = m.group(1).lower(), page[m.start() + 1] == "/"
        rest = page[begin : at - 1]
        if tag in RAW and not ending:
            end = RAW[tag].search(page, at)
            at = tag_end(page, end.end(), last_quote) if end else len(page)
            continue
        if tag in SKIPPED:
            if not ending and tag not in endless and not (tag in ("svg", "math") and rest.endswith("/")):
                end = SKIPPED[tag].search(page, at)
                if end:
                    at = end.end()
                else:
                    endless.add(tag)
            continue
        if tag == "a":
            in_link = 0 if ending else 1
        if tag == "br":
            parts.append(" ")
            continue
        if tag not in INLINE:
            close()
            kind = "" if ending else tag
            if tag in VOID:
                continue
        if ending:
            for k in range(len(stack) - 1, -1, -1) if opened[tag] else ():
                if stack[k][0] == tag:
                    if tag not in INLINE or k == len(stack) - 1:
                        close()
                    opened.subtract(x[0] for x in stack[k:])
                    del stack[k:]
                    break
                if stack[k][0] in FRAMES and tag not in FRAMES:
                    break
            place = stack[-1][1:] if stack else (0, False)
            continue
        if tag in ("p", "li", "tr", "td", "th", "dt", "dd") and stack and stack[-1][0] == tag:
            opened[stack.pop()[0]] -= 1  # an open one ends where the next begins
            place = stack[-1][1:] if stack else (0, False)
        if tag in VOID or rest.endswith("/"):
            continue
        boiler, article = _place(tag, rest, place[1])
        if tag in FRAMES or boiler or article or tag == "p":
            if tag in INLINE:
                close()
            stack.append((tag, max(_inherited(tag, article, place[0]), boiler), place[1] or article))
            place = stack[-1][1:]
            opened[tag] += 1
    close()
    return out


def features(found: list[tuple[str, int, float, int, bool, bool]]) -> np.ndarray:
    """A row per block: words and link density of the block, of the one before and of the one after, then its place."""
    own = np.array([(w, d) for _, w, d, *_ in found], float)
    pad = np.zeros((1, 2))
    return np.hstack([own, np.vstack([pad, own[:-1]]), np.vstack([own[1:], pad]), np.array([f[3:] for f in found], float)])


NAMES_OF_FEATURES = ("words", "links", "words before", "links before", "words after", "links after", "mark", "article", "prose")
# The parts of which the labelled pages are made.
_ARTICLES = (
    ("<article>", "</article>"), ("<article class='post'>", "</article>"), ("<main>", "</main>"), ("<div class='post-content'>", "</div>"), ("<div class='entry-content social-share-below'>", "</div>"), ("<div>", "</div>"), ("<div id='c1'>", "</div>"), ("<table><tr><td>", "</td></tr></table>"),
    ("<form id='f'><div>", "</div></form>"), ("<form><article>", "</article></form>"), ("<div class='legal'>", "</div>"), ("<section class='banner-story'>", "</section>"), ("<div id='related-content-main'>", "</div>"), ("<div class='notice'>", "</div>"),
)
_COMMENTS = ("comments", "user-feedback", "comment-list", "commentlist", "discussion comments", "reader-comments")


def labelled(seed: int, pages: int = 800) -> np.ndarray:
    """The labelled table: the features of all blocks of made-up pages, then 1 where the block is text of the article. A word's
    first letter tells its label: K is kept, D is dropped."""
    rng = np.random.default_rng(seed)
    pick = lambda x: x[int(rng.integers(len(x)))]
    say = lambda kind, low, high: " ".join([f"{kind}w"] * int(rng.integers(low, high)))
    link = lambda kind, low, high: f"<a href='/x'>{say(kind, low, high)}</a>"
    wrap = lambda tag, inside: f"<{tag}>{inside}</{tag.split()[0]}>"

    def links(n: int) -> str:
        return pick(("<ul>{}</ul>", "<div>{}</div>")).format("".join(wrap("li", link("D", 1, 5)) for _ in range(n))) if rng.random() < 0.6 else wrap("div", " | ".join(link("D", 1, 3) for _ in range(n)))

    def text(tag: str) -> str:
        size = pick(((25, 130), (25, 130), (15, 60), (5, 15), (1, 6)))
        inside = say("K", *size)
        return wrap(tag, f"{inside} {link('K', 1, 4)} {say('K', 3, 20)}" if rng.random() < 0.2 else inside)

    rows = []
    for _ in range(pages):
        begin, end = _ARTICLES[int(rng.integers(len(_ARTICLES)))]
        tag = "div" if rng.random() < 0.35 and "article" not in begin and "td" not in begin else "p"
        body = [text(tag) for _ in range(int(pick((1, 1, 2, 3, 4, 5, 6, 8))))]
        if tag == "div" or "class" in begin or "id=" in begin or len(body) < 3:
            body[0] = wrap(tag, say("K", 18, 110))
        if (tag == "div" or "class" in begin) and len(body) > 1:
            body[-1] = wrap(tag, say("K", 18, 110))
        if rng.random() < 0.3 and tag == "p":
            body.insert(len(body) // 2, wrap("ul", "".join(wrap("li", say("K", 1, 12)) for _ in range(3))) if rng.random() < 0.7 else wrap("h2", say("K", 1, 6)))
        if rng.random() < 0.3:
            body.insert(int(rng.integers(1, len(body) + 1)), pick((f"<div class='advert'>{say('D', 3, 20)}</div>", f"<div class='share'>{link('D', 1, 2)} {link('D', 1, 2)}</div>", f"<aside>{say('D', 3, 30)}</aside>", f"<div class='newsletter-signup'>{say('D', 5, 25)}</div>")))
        top = [
            pick((f"<nav>{links(5)}</nav>", links(4), f"<header class='site-header'>{link('D', 1, 3)}</header>", f"<div id='menu'>{links(4)}</div>")),
            pick(("", "", f"<div class='cookie-notice'>{say('D', 8, 25)}</div>", f"<div class='ad'>{say('D', 4, 20)}</div>", wrap("div", say("D", 1, 5)), links(3))),
        ]
        top = [] if rng.random() < 0.2 else top
        title = pick((wrap("h1", say("K", 2, 12)), wrap("h1", say("K", 2, 12)), ""))
        after = []
        if rng.random() < 0.4:
            after.append(f"<div class='{pick(_COMMENTS)}'>{''.join(wrap('p', say('D', 2, 70)) for _ in range(int(rng.integers(1, 4))))}</div>")
        if rng.random() < 0.4:
            after.append(pick((links(4), f"<div class='right-col'>{''.join(wrap('h3', link('D', 3, 9)) + wrap('p', say('D', 4, 15)) for _ in range(2))}</div>", f"<div class='sidebar'>{wrap('p', say('D', 5, 60))}</div>", f"<div class='related-posts'>{wrap('p', say('D', 5, 40))}</div>")))
        after.append(pick((f"<footer>{say('D', 3, 40)}</footer>", f"<div id='footer'>{say('D', 3, 30)} {link('D', 1, 3)}</div>", wrap("div", f"{say('D', 1, 4)} {link('D', 1, 3)} {link('D', 1, 3)}"), f"<form>{say('D', 1, 4)}</form>", "")))
        after = [] if rng.random() < 0.2 else after
        inside = rng.random() < 0.7
        found = blocks("".join(top) + ("" if inside else title) + begin + (title if inside else "") + "".join(body) + end + "".join(after))
        rows.append(np.hstack([features(found), np.array([[f[0].startswith("K")] for f in found], float)]))
    return np.vstack(rows)


LABELLED = labelled(seed=6)


@lru_cache(maxsize=1)
def trained_tree() -> Tree:
    return Tree(LABELLED[:, :-1], LABELLED[:, -1])


def main_text(page: str | None) -> str:
    found = blocks(page) if page else []
    if not found:
        return ""
    return " ".join(f[0] for f, keep in zip(found, trained_tree().predict(features(found)), strict=True) if keep)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: page_id, url, text, n_chars."""
    slim = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    id_type, url_type = (slim.schema[c].dataType.simpleString() for c in ("page_id", "url"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(p) for p in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return slim.mapInArrow(run, f"page_id {id_type}, url {url_type}, text string, n_chars long")
