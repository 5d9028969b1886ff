"""Text functions as column expressions. Java patterns are Unicode-aware here ((?U)), as the rules ask for."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Labels of the language estimate.
LANGUAGE_LABELS = {"zh": "中文为主", "mixed": "中英混合", "latin": "拉丁语系为主", "other": "其他语种为主", "uncertain": "语种特征较少，需人工确认", "unknown": "未识别"}
CONTEXT, LINE_LIMIT = 45, 80

# The scripts' ranges.
HAN = "[\\x{4e00}-\\x{9fff}]"
KANA = "[\\x{3040}-\\x{30ff}\\x{31f0}-\\x{31ff}]"
HANGUL = "[\\x{1100}-\\x{11ff}\\x{3130}-\\x{318f}\\x{ac00}-\\x{d7af}]"
OTHER_LETTER = "[\\p{L}&&[^\\p{IsLatin}]&&[^\\x{4e00}-\\x{9fff}\\x{3040}-\\x{30ff}\\x{31f0}-\\x{31ff}\\x{1100}-\\x{11ff}\\x{3130}-\\x{318f}\\x{ac00}-\\x{d7af}]]"
#: A run of technical characters that holds both a digit and an ASCII letter (a model number, not prose), or, in the group,
#: any other such run. Each run is read once from its start, so the time grows with the text only.
IDENTIFIER = "(?:[A-Za-z][A-Za-z_.:/+#-]*+[0-9]|[0-9][0-9_.:/+#-]*+[A-Za-z])[A-Za-z0-9_.:/+#-]*+|([A-Za-z0-9][A-Za-z0-9_.:/+#-]*+)"
#: Whatever may be a letter of another script than Latin; texts without any need no closer look.
MAYBE_OTHER = "[\\x{b5}\\x{2b9}-\\x{2df}\\x{2e5}-\\x{10ffff}]"

# Patterns of hard tokens and of headings, and what is stripped from a token.
TOKEN_EDGE = " \t\r\n,.;:，。；：、()（）[]【】<>《》\"'“”‘’"
TOKENS = (
    "https?://[^\\s<>\\]\\)\"']+"
    "|[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}"
    "|\\b\\d{1,3}(?:\\.\\d{1,3}){3}\\b"
    "|\\bv?\\d+(?:\\.\\d+){1,4}\\b"
    "|\\b\\d{4}[-/年]\\d{1,2}(?:[-/月]\\d{1,2}日?)?\\b"
    "|\\b\\d+(?:[.,]\\d+)*(?:\\s?(?:%|ms|s|m|mm|cm|km|kg|g|KB|MB|GB|TB|V|A|W|Hz|kHz|MHz|GHz|°C|℃))?\\b"
)
HEADING = "^\\s*(?:#{1,6}\\s+|第[一二三四五六七八九十百千万\\d]+[章节篇部]\\s*|(?:\\d+|[A-Z])(?:[.\\-、)]\\d*){0,5}[.\\-、)]?\\s+|[一二三四五六七八九十]+[、.]\\s*)\\S"
#: The line ends of Unicode text: \\r\\n, LF, VT, FF, CR, FS, GS, RS, NEL, LS, PS.
LINE_END = "\\r\\n|[\\n\\x0b\\x0c\\r\\x1c\\x1d\\x1e\\x{85}\\x{2028}\\x{2029}]"


def text_of(value: Column) -> Column:
    return F.coalesce(value, F.lit(""))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often ``body`` names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def with_computed(rows: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """``rows`` with more (or other) columns that are computed inside a higher-order function, so not as generated code: long
    lists of conditions become methods too large for the JIT compiler, which then run many times slower."""
    made = let(F.lit(0), lambda _: F.struct(*[c.alias(name) for name, c in columns.items()]))
    return rows.withColumn("_made", made).select(*[c for c in rows.columns if c not in columns], "_made.*")


def collapse(value: Column) -> Column:
    """White space to single spaces, trimmed."""
    return F.trim(F.regexp_replace(text_of(value), "(?U)\\s+", " "))


def count(value: Column, pattern: str) -> Column:
    return F.coalesce(F.regexp_count(value, F.lit(pattern)), F.lit(0))


def language_counts(text: Column) -> dict[str, Column]:
    """Character counts by script; Latin letters of model numbers do not count."""
    value = text_of(text)
    prose = F.when(value.rlike("[0-9]"), F.regexp_replace(value, IDENTIFIER, "$1")).otherwise(value)
    others = (F.octet_length(value) > F.length(value)) & value.rlike(MAYBE_OTHER)

    def letters(pattern: str) -> Column:
        return F.when(others, count(value, pattern)).otherwise(0)

    return {
        "cjk": letters(HAN),
        "latin": F.length(F.regexp_replace(prose, "\\P{IsLatin}+", "")),
        "japanese": letters(KANA),
        "hangul": letters(HANGUL),
        "other": letters(OTHER_LETTER),
    }


def language_from_counts(cjk: Column, latin: Column, japanese: Column, hangul: Column, other: Column) -> Column:
    """zh, mixed, latin, other, uncertain or unknown, by thresholds in a fixed order."""
    kana_share = japanese / F.greatest(cjk + japanese, F.lit(1))
    return (
        F.when((japanese >= 10) & (kana_share >= 0.08) & (cjk + japanese >= F.greatest(F.lit(20), latin)), "other")
        .when(hangul >= F.greatest(F.lit(20), cjk, latin), "other")
        .when(other >= F.greatest(F.lit(40), cjk, latin), "other")
        .when((cjk >= 40) & (latin >= 80) & (F.least(cjk, latin) / F.greatest(cjk, latin) >= 0.2), "mixed")
        .when(cjk >= F.greatest(F.lit(20), latin), "zh")
        .when(latin >= F.greatest(F.lit(40), cjk), "latin")
        .when((cjk > 0) | (latin > 0), "uncertain")
        .otherwise("unknown")
    )


def estimate_language(text: Column) -> Column:
    return language_from_counts(**language_counts(text))


def language_label(language: Column) -> Column:
    labels = F.create_map(*[F.lit(x) for pair in LANGUAGE_LABELS.items() for x in pair])
    return F.coalesce(labels[language], F.lit(LANGUAGE_LABELS["unknown"]))


def excerpt(text: Column, position: Column, length: Column, context: int = CONTEXT) -> Column:
    """The surroundings of a hit at 0-based ``position``, with dots where the text goes on."""
    start = F.greatest(F.lit(0), position - context)
    end = F.least(F.length(text), position + length + context)
    return F.concat(F.when(start > 0, "...").otherwise(""), collapse(text.substr(start + 1, end - start)), F.when(end < F.length(text), "...").otherwise(""))




def has_case(term: Column) -> Column:
    return F.lower(term) != F.upper(term)


def quoted(term: Column) -> Column:
    """The term as a literal pattern."""
    return F.concat(F.lit("\\Q"), F.replace(term, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))



def literal_hits(text: Column, term: Column) -> Column:
    """Non-overlapping, case-sensitive occurrences."""
    return F.when(term == "", 0).otherwise((F.length(text) - F.length(F.replace(text, term, F.lit("")))) / F.length(term)).cast("long")


def line_number(text: Column, position: Column) -> Column:
    """1-based line of a 0-based position (lines end at LF)."""
    before = text.substr(F.lit(1), position)
    return (F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1).cast("long")



def lines(text: Column) -> Column:
    """Lines at any Unicode line end, without an empty last one."""
    cut = lambda split: F.when(F.try_element_at(split, F.lit(-1)) == "", F.slice(split, 1, F.greatest(F.size(split) - 1, F.lit(1)))).otherwise(split)
    return F.when(text_of(text) == "", F.array().cast("array<string>")).otherwise(let(F.split(text_of(text), LINE_END), cut))


def headings(text: Column, limit: int = 12) -> Column:
    """The first distinct headings: lines of at most 120 characters that look like one."""
    stripped = F.transform(lines(text), lambda x: F.trim(F.regexp_replace(x, "(?U)\\s+", " ")))
    found = F.filter(stripped, lambda x: (F.length(x) > 0) & (F.length(x) <= 120) & x.rlike("(?U)" + HEADING))
    return F.slice(F.array_distinct(found), 1, limit)


def hard_tokens(text: Column) -> Column:
    """Distinct URLs, addresses, versions, dates and measures, lower-cased, without trailing punctuation."""
    found = F.regexp_extract_all(text_of(text), F.lit("(?iU)" + TOKENS), 0)
    cleaned = F.transform(found, lambda t: F.lower(F.btrim(t, F.lit(TOKEN_EDGE))))
    return F.array_distinct(F.filter(cleaned, lambda t: t != ""))


def by_length(values: Column, limit: int = 40) -> Column:
    """The first values by (length, value)."""
    keyed = F.array_sort(F.transform(values, lambda v: F.struct(F.length(v).alias("n"), v.alias("v"))))
    return F.slice(F.transform(keyed, lambda k: k["v"]), 1, limit)


def paragraphs(text: Column) -> Column:
    return F.size(F.filter(F.split(text_of(text), "(?U)\\n\\s*\\n"), lambda p: F.trim(F.regexp_replace(p, "(?U)\\s+", " ")) != "")).cast("long")


def visible_length(text: Column) -> Column:
    return F.length(F.regexp_replace(text_of(text), "(?U)\\s+", "")).cast("long")


def shifted_pairs(text: Column, size: int = 2) -> Column:
    """Distinct character n-grams; a shorter text is its own."""
    n = F.length(text)
    grams = F.transform(F.sequence(F.lit(1), F.greatest(n - (size - 1), F.lit(1))), lambda i: F.substring(text, i, F.lit(size)))
    return F.when(n == 0, F.array().cast("array<string>")).otherwise(F.array_distinct(grams))


def characters(text: Column) -> Column:
    return F.when(F.length(text) == 0, F.array().cast("array<string>")).otherwise(F.array_distinct(F.split(text, "")))


def dice(left: Column, right: Column) -> Column:
    total = F.size(left) + F.size(right)
    return F.when((F.size(left) == 0) | (F.size(right) == 0), 0.0).otherwise(2.0 * F.size(F.array_intersect(left, right)) / total)
