"""How alike two finding descriptions are."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docsieve.functions import text as X

# Synonyms, replaced in this order, and the similarity that counts as the same finding.
REPLACEMENTS = (
    ("不统一", "不一致"),
    ("不相同", "不一致"),
    ("存在差异", "不一致"),
    ("矛盾", "冲突"),
    ("有误", "错误"),
    ("不正确", "错误"),
    ("没有提供", "缺失"),
    ("未提供", "缺失"),
    ("没有说明", "缺失"),
    ("未说明", "缺失"),
    ("缺少", "缺失"),
    ("遗留", "保留"),
    ("残留", "保留"),
    ("资料", "文档"),
)
THRESHOLD = 0.56
COMMON_FROM = 200  # fixed value: characters from which on common ones begin no block


def normalised(value: Column) -> Column:
    """Lower case, synonyms unified, nothing but letters and digits."""
    out = F.lower(F.trim(X.text_of(value)))
    for source, target in REPLACEMENTS:
        out = F.replace(out, F.lit(source), F.lit(target))
    return F.regexp_replace(out, "(?U)[\\W_]+", "")


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _run_lengths(equal: np.ndarray) -> np.ndarray:
    """For each cell, how many cells up its diagonal, itself included, are set without a gap."""
    out = equal.astype(np.int32)
    for i in range(1, len(out)):
        out[i, 1:] *= out[i - 1, :-1] + 1
    return out


def matched_characters(a: str, b: str) -> int:
    """Characters in common blocks: the longest block (of several the one that ends first in a, then in b), then the same
    left and right of it. In a second text of COMMON_FROM characters or more, characters that fill over a hundredth of it
    (and one more) begin no block, they only lengthen one."""
    x, y = _codes(a), _codes(b)
    if not len(x) or not len(y):
        return 0
    equal = x[:, None] == y[None, :]
    rare = equal
    if len(y) >= COMMON_FROM:
        _, inverse, count = np.unique(y, return_inverse=True, return_counts=True)
        rare = equal & (count[inverse] <= len(y) // 100 + 1)[None, :]
    ends, anywhere = _run_lengths(rare), _run_lengths(equal)
    onward = _run_lengths(equal[::-1, ::-1])[::-1, ::-1]
    total, parts = 0, [(0, len(x), 0, len(y))]
    while parts:
        i0, i1, j0, j1 = parts.pop()
        if i0 == i1 or j0 == j1:
            continue
        inside = np.minimum(ends[i0:i1, j0:j1], np.minimum(np.arange(1, i1 - i0 + 1)[:, None], np.arange(1, j1 - j0 + 1)[None, :]))
        at = int(inside.argmax())  # the first of the largest, row by row
        i, j = (i0 + at // (j1 - j0), j0 + at % (j1 - j0)) if inside.flat[at] else (i0, j0)  # without a block the part's begin may be one
        before = max(1, min(int(anywhere[i, j]), i - i0 + 1, j - j0 + 1))
        after = min(int(onward[i, j]), i1 - i, j1 - j)
        begin_i, begin_j, size = i - before + 1, j - before + 1, before + after - 1
        if not size:
            continue
        total += size
        parts += [(i0, begin_i, j0, begin_j), (begin_i + size, i1, begin_j + size, j1)]
    return total


@F.pandas_udf(T.DoubleType())
def matching_ratio(left: pd.Series, right: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp ratio; the order of the two matters. Null where it is not asked for."""
    return pd.Series([None if a is None or b is None else 2.0 * matched_characters(a, b) / (len(a) + len(b)) if a or b else 1.0 for a, b in zip(left, right, strict=True)], dtype="float64")


def similarity_bound(left: Column, right: Column) -> Column:
    """At least ``similarity``, from built-in functions alone: blocks never match more characters than both texts hold of
    each, so the ratio is at most the share of those."""
    a, b = normalised(left), normalised(right)
    total, shorter = F.length(a) + F.length(b), F.least(F.length(a), F.length(b))
    inside = (shorter >= 6) & F.when(F.length(a) <= F.length(b), F.contains(b, a)).otherwise(F.contains(a, b))
    held = lambda text, c: F.length(text) - F.length(F.replace(text, c, F.lit("")))
    shared = F.aggregate(F.transform(X.characters(a), lambda c: F.least(held(a, c), held(b, c))), F.lit(0), lambda x, y: x + y)
    ratio = F.when(2.0 * shorter / total < THRESHOLD, 2.0 * shorter / total).otherwise(2.0 * shared / total)
    measures = F.greatest(ratio, 0.9 * X.dice(X.characters(a), X.characters(b)), X.dice(X.shifted_pairs(a), X.shifted_pairs(b)))
    return F.when((a == "") | (b == ""), 0.0).when((a == b) | inside, 1.0).when(shorter < 4, 0.0).otherwise(measures)


def similarity(left: Column, right: Column) -> Column:
    """1 for equal texts, 0.95 for a contained one of 6 characters or more, else the best of three measures.

    Built-in functions decide all clear cases; the sequence ratio is asked for only where it can matter."""
    a, b = normalised(left), normalised(right)
    shorter = F.when(F.length(a) <= F.length(b), a).otherwise(b)
    longer = F.when(F.length(a) <= F.length(b), b).otherwise(a)
    inside = (F.length(shorter) >= 6) & longer.contains(shorter)
    clear = (a == "") | (b == "") | (a == b) | inside | (F.length(shorter) < 4)
    ratio = matching_ratio(F.when(~clear, a), F.when(~clear, b))
    grams = X.dice(X.shifted_pairs(a), X.shifted_pairs(b))
    return (
        F.when((a == "") | (b == ""), 0.0)
        .when(a == b, 1.0)
        .when(inside, 0.95)
        .when(F.length(shorter) < 4, 0.0)
        .otherwise(F.greatest(ratio, 0.9 * X.dice(X.characters(a), X.characters(b)), grams))
    )
