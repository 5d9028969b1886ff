"""Which pages and moments of a long document are looked at."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docsieve.functions import text as X
from docsieve.functions import values as V

# Words that announce a figure or a table.
SIGNALS = ("图", "表", "Figure", "Fig.", "Table", "接线", "示意", "流程", "截图", "参数", "安装")


def sampled_pages(total: Column, limit: Column, candidates: Column) -> Column:
    """All pages if they fit; else the first three, the last two, the candidates, evenly spaced pages (half-even
    rounding), then pages from the front, in order, cut to the limit."""
    total, limit = F.greatest(total, F.lit(0)).cast("int"), F.greatest(limit, F.lit(1)).cast("int")
    # What is read of the front never goes beyond the limit: fewer pages than that are asked for, and those taken before fill the rest.
    front = F.when(total > 0, F.sequence(F.lit(1), F.greatest(F.least(total, limit), F.lit(1)))).otherwise(F.array().cast("array<int>"))
    asked = F.filter(F.coalesce(candidates, F.array().cast("array<int>")), lambda p: (p >= 1) & (p <= total))
    edges = F.array_union(F.sequence(F.lit(1), F.least(F.lit(3), F.greatest(total, F.lit(1)))), F.sequence(F.greatest(F.lit(1), total - 1), F.greatest(total, F.lit(1))))

    def spaced(base: Column) -> Column:
        """Spaced pages are added until the limit is reached; the first one is added in any case."""
        parts = F.greatest(F.lit(1), limit - F.size(base))
        pages = F.transform(F.sequence(F.lit(0), parts - 1), lambda i: (1 + F.bround(i.cast("long") * (total - 1) / F.greatest(F.lit(1), parts - 1), 0)).cast("int"))
        fresh = F.filter(F.array_distinct(pages), lambda p: ~F.array_contains(base, p))
        return F.concat(base, F.slice(fresh, 1, F.greatest(limit - F.size(base), F.lit(1))))

    def filled(some: Column) -> Column:
        rest = F.filter(front, lambda p: ~F.array_contains(some, p))
        return F.slice(F.array_sort(F.concat(some, F.slice(rest, 1, F.greatest(limit - F.size(some), F.lit(0))))), 1, limit)

    chosen = X.let(X.let(F.array_distinct(F.array_union(edges, asked)), spaced), filled)
    return F.when(total <= limit, front).otherwise(chosen)


def sampled_times(duration: Column, most: Column) -> Column:
    """Evenly spaced moments from 0 to 0.1 s before the end, about one per two seconds."""
    n = F.greatest(F.lit(1), F.least(most.cast("int"), F.ceil(duration / 2).cast("int") + 1))
    last = F.greatest(F.lit(0.0), duration - 0.1)
    step = F.when(n > 1, last / (n - 1)).otherwise(0.0)
    moments = F.transform(F.sequence(F.lit(0), n - 1), lambda i: V.decimals(F.least(last, i * step), 3).cast("double"))
    return F.array_distinct(moments)


def page_sections(text: Column) -> Column:
    """(page, section) by lines ``[第N页]``; what follows the list of extracted images is left out."""
    marker = "(?m)^\\[第(\\d+)页\\](?=[^\\S\\n]*$)"

    def cut(body: Column, parts: Column) -> Column:
        return F.transform(
            F.regexp_extract_all(body, F.lit(marker), 1),
            lambda n, i: F.struct(n.try_cast("int").alias("page"), F.trim(F.regexp_replace(F.concat(F.lit("[第"), n, F.lit("页]"), F.coalesce(F.try_element_at(parts, i + 2), F.lit(""))), "(?U)^\\s+|\\s+$", "")).alias("section")),
        )

    # the text is split once, not for each of its pages
    whole = F.try_element_at(F.split(X.text_of(text), "\\n\\nextracted_images:", 2), F.lit(1))
    return X.let(whole, lambda body: X.let(F.split(body, marker), lambda parts: cut(body, parts)))


def shows_figure(section: Column) -> Column:
    """A signal word, or at least 8 lines of which 5 are short."""
    flat = X.collapse(section)
    word = F.lit(False)
    for s in SIGNALS:
        word = word | flat.contains(s)
    kept = F.filter(F.transform(X.lines(section), lambda x: F.trim(F.regexp_replace(x, "(?U)^\\s+|\\s+$", ""))), lambda x: x != "")
    return (flat != "") & (word | ((F.size(kept) >= 8) & (F.size(F.filter(kept, lambda x: F.length(x) <= 40)) >= 5)))


def candidate_pages(text: Column, image_pages: Column) -> Column:
    marked = F.transform(F.filter(page_sections(text), lambda s: shows_figure(s["section"])), lambda s: s["page"])
    return F.array_sort(F.array_distinct(F.concat(marked, F.coalesce(image_pages, F.array().cast("array<int>")))))


def page_text_quality(text: Column) -> Column:
    """(useful, bad_ratio, tokens) of an extracted page."""
    visible = F.regexp_replace(X.text_of(text), "(?U)\\s+", "")
    bad = X.count(visible, "[\\x{fffd}\\p{Cc}\\p{Cs}\\p{Co}\\p{Cn}]")
    tokens = F.array_distinct(F.regexp_extract_all(F.lower(X.text_of(text)), F.lit("(?U)\\w+"), 0))
    return F.struct((F.length(visible) - bad).alias("useful"), (bad / F.greatest(F.length(visible), F.lit(1))).alias("bad"), tokens.alias("tokens"))


def covered_share(primary: Column, other: Column) -> Column:
    return F.when(F.size(primary) == 0, 1.0).otherwise(F.size(F.array_intersect(primary, other)) / F.size(primary))


def better_page_text(first: Column, second: Column) -> Column:
    """Of two extractions of one page, the second unless the first is clearly cleaner or more complete."""
    a, b = page_text_quality(first), page_text_quality(second)
    b_in_a, a_in_b = covered_share(b["tokens"], a["tokens"]), covered_share(a["tokens"], b["tokens"])
    extra = a["useful"] - b["useful"]
    return (
        F.when(X.collapse(second) == "", X.text_of(first))
        .when(X.collapse(first) == "", second)
        .when((b["bad"] >= 0.01) & (a["bad"] <= b["bad"] * 0.5) & (a["useful"] >= b["useful"] * 0.7), first)
        .when(a["bad"] > F.greatest(F.lit(0.01), b["bad"] * 2), second)
        .when((F.size(a["tokens"]) > 0) & (F.size(b["tokens"]) > 0) & (b_in_a < 0.3) & (a_in_b < 0.3), first)
        .when((extra >= F.greatest(F.lit(20), F.floor(b["useful"] * 0.15))) & (a["useful"] / F.greatest(b["useful"], F.lit(1)) >= 1.15) & (b_in_a >= 0.8), first)
        .otherwise(second)
    )
