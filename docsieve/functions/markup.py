"""Text of HTML: the text nodes outside of scripts, styles and noscript parts, one a line."""

from __future__ import annotations

import re
from html import unescape

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Elements whose content is no text of the page, and those whose content holds no tags.
DROPPED, RAW = ("script", "style", "noscript"), ("script", "style", "textarea", "title")
_NAME = re.compile(r"/?([A-Za-z][^\s/>]*)")
_EDGE = re.compile("[>\"']")


def _tag_end(html: str, at: int, dead: set[str]) -> int:
    """Where the tag that begins at ``at`` ends, a > in a quoted value aside; a quote that is never closed is none. ``dead``
    keeps the quotes that do not occur again, so that no stretch is searched twice for them."""
    while m := _EDGE.search(html, at):
        mark = m.group()
        if mark == ">":
            return m.end()
        close = -1 if mark in dead else html.find(mark, m.end())
        if close < 0:
            dead.add(mark)
        at = close + 1 if close >= 0 else m.end()
    return -1


def html_lines(html: str) -> list[str]:
    """The text nodes, stripped, character references decoded, empty ones left out; one pass, each character once."""
    nodes: list[str] = []
    node: list[str] = []  # pieces of the text node that is read: only a tag or a comment ends it
    at, dead, dropped, depth = 0, set(), "", 0
    while True:
        mark = html.find("<", at)
        if not dropped:
            node.append(html[at : mark if mark >= 0 else len(html)])
        if mark < 0:
            break
        m = _NAME.match(html, mark + 1)
        if m is None and not html.startswith(("<!", "<?", "</"), mark):
            node += [] if dropped else ["<"]  # it opens nothing
            at = mark + 1
            continue
        nodes.append("".join(node))
        node = []
        if m is None:
            close = "-->" if html.startswith("<!--", mark) else ">"
            end = html.find(close, mark + 2)
            if end < 0:
                break
            at = end + len(close)
            continue
        at = _tag_end(html, m.end(), dead)
        if at < 0:
            break
        name, closing = m.group(1).lower(), html[mark + 1] == "/"
        if dropped:
            depth += (name == dropped) * (-1 if closing else 1)
            dropped = dropped if depth else ""
        elif not closing and name in RAW:
            end = re.compile(rf"</{name}(?=[\s/>])", re.IGNORECASE).search(html, at)
            stop = end.start() if end else len(html)
            nodes += [] if name in DROPPED else [html[at:stop]]
            at = stop
        elif not closing and name in DROPPED:
            dropped, depth = name, 1
    nodes.append("".join(node))
    return [t for x in nodes if (t := unescape(x).strip())]


@F.pandas_udf(T.StringType())
def _text(pages: pd.Series) -> pd.Series:
    return pd.Series(["\n".join(html_lines(p)) for p in pages], dtype=object)


def html_text(html: Column) -> Column:
    """The page's text, a line for each text node; empty for a null page."""
    return _text(F.coalesce(html, F.lit("")))
