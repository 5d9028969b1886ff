from __future__ import annotations

import time

import pytest

from docsieve.llm import html_blocks, queries

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><header class="site-header"><a href="/">Home</a></header>
<nav><ul><li><a href=1>One</a></li><li><a href=2>Two</a></li></ul></nav><div class="cookie-notice">We use cookies to make this site work for you, our readers.</div>
<article><h1>The title &amp; more</h1><p>First   paragraph with a <a href=x>link</a> and <b>bold</b>&nbsp;words, caf&eacute; &#8364;5.</p><script>var p = "<p>no</p>";</script>
<p>Second paragraph, which goes on for a while so that it has enough words to count.</p><div class="advert">Buy this thing now, today only, for a very low price.</div><ul><li>an item</li></ul></article>
<section class="comments"><p>I am a reader and this is my long comment on the article that I have just read.</p></section><aside>Related</aside><footer>&copy; 2024</footer></body></html>"""


def test_main_text():
    assert html_blocks.main_text(PAGE) == "The title & more First paragraph with a link and bold words, café €5. Second paragraph, which goes on for a while so that it has enough words to count. an item"


def test_edges(spark):
    rows = [(1, "u", PAGE), (1, "u", PAGE), (2, None, None), (3, "u", ""), (4, "u", "<div><<p>< a"), (5, "u", "<p>" + "word " * 60_000), (None, "u", "<!-- open")]
    df = spark.createDataFrame([(*r, "t", 1) for r in rows], "page_id long, url string, html string, text string, n_chars int")
    got = html_blocks.extract(df).collect()
    assert len(got) == len(rows) and all(r["n_chars"] == len(r["text"]) for r in got)
    text = {r["page_id"]: r["text"] for r in got}
    assert text[2] == text[3] == text[None] == "" and text[5] == ("word " * 60_000).strip()
    assert html_blocks.extract(df.limit(0)).count() == 0


def test_query(spark, sf_dir):
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    rows = queries.op6_html_extraction(spark, sf_dir).collect()
    assert sorted(r["page_id"] for r in rows) == sorted(pages)
    assert all(r["text"] == " ".join(r["text"].split()) for r in rows)
    assert sum(bool(r["text"]) for r in rows) > 0.9 * len(rows)


def test_tree_fits_its_table():
    t = html_blocks.LABELLED
    assert (html_blocks.trained_tree().predict(t[:, :-1]) == t[:, -1]).mean() > 0.95


BODY = "The harbour was quiet in the early morning, and the first boats came back with little to show for a long night."


@pytest.mark.parametrize(
    "page",
    [
        f"<article class='post category-legal tag-social comments-open'><p>{BODY}</p></article>",
        f"<div id='content-sidebar-wrap'><article><p>{BODY}</p></article></div>",
        f"<div class='layout-sidebar-right'><article><p>{BODY}</p></article></div>",
        f"<div class='page-with-sidebar'><p>{BODY}</p></div>",
        f"<div class='right-sidebar'><main><p>{BODY}</p></main></div>",
        f"<div class='sidebar-left-page'><article><p>{BODY}</p></article></div>",
    ],
)
def test_names_do_not_overrule_the_article(page):
    assert html_blocks.main_text(page) == BODY


def test_names_still_mark_boilerplate():
    for name in ("sidebar", "cookie-notice", "related-posts", "widget-area", "right-sidebar"):
        assert html_blocks.main_text(f"<article><p>{BODY}</p></article><div class='{name}'><p>{BODY}</p></div>") == BODY


@pytest.mark.parametrize(
    "start",
    [
        "<svg class='icon' viewBox='0 0 1 1'/>",
        "<math/>",
        "<button-group></button-group>",
        "<title-bar>",
        "<template-part></template-part>",
        "<button>",
        "<canvas id=c>",
        "<svg><title>Icon</title><path d='M0 0'/></svg>",
        "<select><option>One<option>Two</select>",
        "<noscript>Turn it on.</noscript>",
    ],
)
def test_skipped_elements_end_where_they_end(start):
    assert html_blocks.main_text(f"<article>{start}<p>{BODY}</p></article>") == BODY


def test_scripts_without_an_end_run_to_the_end():
    assert html_blocks.main_text(f"<article><p>{BODY}</p><script>var a = 1; <p>no</p></article>") == BODY


def test_names_of_other_attributes_say_nothing():
    assert html_blocks.main_text(f"<div data-id='ad-12'><p>{BODY}</p></div>") == BODY
    assert html_blocks.main_text(f"<article><div data-role='share-text'><p>{BODY}</p></div><p class='social'>{BODY}</p></article>") == f"{BODY} {BODY}"


def test_short_blocks_outside_an_article_stay():
    page = f"<h1>Title</h1><p>{BODY}</p><p>Yes.</p><p>{BODY}<br>No.<br>{BODY}</p>"
    assert html_blocks.main_text(page) == f"Title {BODY} Yes. {BODY} No. {BODY}"


@pytest.mark.parametrize("part", ["<a ", "<script ", "<!", "<", "</", "<a x=\"", "<a x='>'", "<svg>", "<title>", "<p class=\"x", "<div>", "</div>", "&", "<a b   "])
def test_malformed_pages_take_linear_time(part):
    began = time.perf_counter()
    html_blocks.main_text(part * (1_000_000 // len(part)))
    assert time.perf_counter() - began < 20


def test_stray_end_tags_take_linear_time():
    began = time.perf_counter()
    html_blocks.main_text("<div>" * 50_000 + "</section>" * 50_000)
    assert time.perf_counter() - began < 20


def test_unquoted_apostrophes_end_with_the_tag():
    assert html_blocks.main_text(f"<article><p title=it's>{BODY}</p><p>It's {BODY}</p></article>") == f"{BODY} It's {BODY}"


def test_held_out_pages(spark):
    """Blocks of real pages, labelled by the element that holds them: what is in <article> is the text."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("html").collect()
    right = total = 0
    for (page,) in pages:
        inner = page[page.index("<article>") + 9 : page.index("</article>")] if "</article>" in page else None
        if inner is None:
            continue
        expected = " ".join(b[0] for b in html_blocks.blocks(inner))
        for form in (page, page.replace("<article>", "<div>").replace("</article>", "</div>")):
            right += html_blocks.main_text(form) == expected
            total += 1
    assert total and right >= 0.95 * total


LONG = "On the second day the wind turned, and those who had waited were glad of it, though none of them said so aloud at the quay."


@pytest.mark.parametrize(
    "begin",
    [
        "<div>", "<div class='entry-content social-share-below'>", "<div class='post-body widget-area-left'>", "<form id='aspnetForm'><div>", "<form id='aspnetForm'><article>", "<div class='legal'>", "<section class='banner-story'>",
        "<div id='related-content-main'>", "<table><tr><td>", "<div class='notice'>",
    ],
)
@pytest.mark.parametrize("tag", ["p", "div"])
def test_articles_in_any_frame_stay(begin, tag):
    nav, foot = "<nav><ul><li><a href=1>One</a><li><a href=2>Two</a></ul></nav>", "<footer>&copy; 2024 <a href=3>Us</a></footer>"
    page = f"{nav}{begin}<{tag}>{BODY}</{tag}><{tag}>{LONG}</{tag}>"
    assert html_blocks.main_text(f"{page}{foot}") == f"{BODY} {LONG}"


def test_text_without_any_tag_of_prose():
    assert html_blocks.main_text(f"<div>{BODY}<br>{LONG}</div>") == f"{BODY} {LONG}"
    assert html_blocks.main_text(f"<nav><a href=1>One</a> <a href=2>Two</a></nav><div>{BODY}</div><div>{LONG}</div><div>{BODY}</div>") == f"{BODY} {LONG} {BODY}"


@pytest.mark.parametrize(
    "after",
    [
        f"<div class='user-feedback'><p>{LONG}</p><p>{BODY}</p></div>",
        "<div class='right-col'><h3><a href=1>Read this story too</a></h3><p>A short teaser of another story from here.</p><h3><a href=2>And this one</a></h3><p>Another teaser, as short as the first one.</p></div>",
        f"<section class='comment-list'><p>{LONG}</p><p>Yes!</p></section>",
    ],
)
def test_comments_and_teasers_go(after):
    assert html_blocks.main_text(f"<article><p>{BODY}</p><p>{LONG}</p></article>{after}") == f"{BODY} {LONG}"


def test_the_tree_asks_for_words_and_neighbours():
    asked = set()

    def walk(tree):
        if tree.feature is not None:
            asked.add(html_blocks.NAMES_OF_FEATURES[tree.feature])
            walk(tree.low)
            walk(tree.high)

    walk(html_blocks.trained_tree())
    assert {"words", "links", "words after"} <= asked and asked & {"words before", "links before"}


def test_a_second_draw_of_the_table():
    t = html_blocks.labelled(seed=99)
    kept = html_blocks.trained_tree().predict(t[:, :-1])
    assert (kept == t[:, -1]).mean() > 0.99 and kept[t[:, -1] == 1].mean() > 0.99


def test_whole_query_against_the_articles(spark, sf_dir):
    """Every given page, not a sample: the text is that of all blocks in its article, in order."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    html = {r["page_id"]: r["html"] or "" for r in pages.collect()}
    got = {r["page_id"]: r["text"] for r in queries.op6_html_extraction(spark, sf_dir).collect()}
    for k, page in html.items():
        inner = page[page.index("<article>") + 9 : page.index("</article>")]
        assert got[k] == " ".join(b[0] for b in html_blocks.blocks(inner))
