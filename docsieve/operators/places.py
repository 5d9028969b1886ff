"""Where a hit is: file, page, sheet, line and surroundings. A text is read once for its markers and line ends, then each
hit is a binary search, so the time does not grow with the text in front of it."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right

from docsieve.functions.text import CONTEXT, LINE_LIMIT

# White space, what ends a line, and how a text marks its file, its pages and its sheets.
SPACE = re.compile("[\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]+")
ENDS = "\\n\\r\\x85\\u2028\\u2029"
PAGE = re.compile("\\[第([0-9]+)页\\]")
SHEET, FILE = (re.compile(f"(?:\\A|(?<=[{ENDS}])){head}[ \\t-\\r]*([^{ENDS}]+?)[ \\t-\\r]*(?=[{ENDS}]|\\Z)") for head in ("#[ \\t-\\r]*工作表：", "file:"))


def collapse(text: str) -> str:
    return SPACE.sub(" ", text).strip(" ")


def shorten(line: str, term: str, limit: int = LINE_LIMIT) -> str:
    """At most ``limit`` characters around the term; without the term the first ones."""
    if len(line) <= limit:
        return line
    found = line.find(term)
    if found < 0:
        return line[: limit - 3].rstrip(" ") + "..."
    end = min(len(line), max(0, found - limit // 2) + limit)
    start = max(0, end - limit)
    return "..." * (start > 0) + line[start:end].strip(" ") + "..." * (end < len(line))


class Places:
    """The places of one text; positions count from 0. A marker counts from its line on, also for hits before it there."""

    def __init__(self, text: str):
        self.text = text
        self.breaks = [m.start() for m in re.finditer("\n", text)]
        self.pages = [(m.end(), m[1]) for m in PAGE.finditer(text)] if "[第" in text else []
        self.sheets = [(m.end(1), m[1].strip(" ")) for m in SHEET.finditer(text)] if "工作表：" in text else []
        named = FILE.search(text) if "file:" in text else None
        self.file = named[1] if named else ""
        self._line = (-1, "")

    def _last(self, marks: list[tuple[int, str]], end: int) -> str:
        k = bisect_right(marks, end, key=lambda m: m[0])
        return marks[k - 1][1] if k else ""

    def location(self, at: int, term: str) -> str:
        k = bisect_left(self.breaks, at)
        end = self.breaks[k] if k < len(self.breaks) else len(self.text)
        if self._line[0] != k:
            self._line = (k, collapse(self.text[self.breaks[k - 1] + 1 if k else 0 : end]))
        page, sheet, line = self._last(self.pages, end), self._last(self.sheets, end), self._line[1]
        parts = [("文件：", self.file, ""), ("页码：第", page, "页"), ("工作表：", sheet, ""), ("行：", str(k + 1), ""), ("附近线索：", line and shorten(line, term), "")]
        return "，".join(a + b + c for a, b, c in parts if b)

    def excerpt(self, at: int, length: int, context: int = CONTEXT) -> str:
        """The surroundings of a hit, with dots where the text goes on."""
        start, end = max(0, at - context), min(len(self.text), at + length + context)
        return "..." * (start > 0) + collapse(self.text[start:end]) + "..." * (end < len(self.text))

    def of(self, positions: list[int], term: str) -> tuple[str, str]:
        """(locations, excerpts) of some hits, each as one text."""
        return "；".join(self.location(p, term) for p in positions), "；".join(self.excerpt(p, len(term)) for p in positions)
