"""Rule lists from the cells of people's tables: find the header, read the rules, unify repeated ones."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docsieve.functions import text as X

# Header texts, placeholders of empty cells and words for the language scope.
STANDARD_HEADERS = ("常用词", "正确写法", "规范写法", "标准写法", "推荐写法")
DISCOURAGED_HEADERS = ("常见错误/不推荐用法", "常见错误／不推荐用法", "常见错误和不推荐用法", "常见错误及不推荐用法", "常见错误", "错误用法", "不推荐用法")
DISCOURAGED_PARTS = ("常见错误", "不推荐用法")
LANGUAGE_HEADERS = ("适用语种", "适用语言", "文档语种", "规则适用语种")
PLACEHOLDERS = ("", "-", "--", "—", "/", "无", "不涉及", "na", "n/a")
SCOPE_ALL = ("", "*", "all", "any", "全部", "所有", "不限", "通用", "全部/all", "all/全部")
SCOPE_CHINESE = ("zh", "zh-cn", "zh-hans", "zh-hant", "中文", "中文为主", "中文文档", "仅中文", "简体中文", "繁体中文", "中文/zh", "zh/中文")


def header_kind(cell: Column) -> Column:
    """standard, discouraged, language, or null."""
    name = F.regexp_replace(X.text_of(cell), "(?U)[\\s:：*＊（）()【】\\[\\]<>《》]+", "")
    wrong = name.isin(*DISCOURAGED_HEADERS) | reduce(lambda a, b: a | b, [name.contains(p) for p in DISCOURAGED_PARTS])
    return F.when(wrong, "discouraged").when(name.isin(*STANDARD_HEADERS), "standard").when(name.isin(*LANGUAGE_HEADERS), "language")


def split_terms(cell: Column) -> Column:
    """The distinct terms of a cell, in order, without placeholders."""
    parts = F.transform(F.split(X.text_of(cell), "[\\r\\n,，;；、]+"), lambda t: F.regexp_replace(t, "(?U)^\\s+|\\s+$", ""))
    return F.array_distinct(F.filter(parts, lambda t: ~F.lower(t).isin(*PLACEHOLDERS)))


def language_scope(cell: Column, sheet: Column, row_number: Column) -> Column:
    """all or zh; any other text stops the query with the sheet and the row."""
    low = F.regexp_replace(F.lower(F.trim(X.text_of(cell))), "(?U)[_\\s]+", "-")
    wrong = F.raise_error(F.concat(F.lit("language scope "), X.text_of(cell), F.lit(" in sheet "), sheet, F.lit(", row "), row_number.cast("string"), F.lit(" is not known")))
    return F.when(low.isin(*SCOPE_ALL), "all").when(low.isin(*SCOPE_CHINESE), "zh").otherwise(wrong.cast("string"))


def rules_of(cells: DataFrame) -> DataFrame:
    """(sheet, row_number, cells) -> one row per rule row: standard, discouraged, language_scope, sheet, row_number.

    A sheet's header is its first row that names both required columns; rows before it, and rows without a standard term,
    are no rules. Only one row per sheet crosses to the others, so the join is small on that side."""
    kinds = cells.withColumn("_kinds", F.transform("cells", header_kind))
    places = [F.array_position("_kinds", F.lit(k)).cast("int").alias(k) for k in ("standard", "discouraged", "language")]
    headers = kinds.select("sheet", "row_number", *places).filter("standard > 0 and discouraged > 0")
    first = headers.groupBy("sheet").agg(F.min_by(F.struct("row_number", "standard", "discouraged", "language"), "row_number").alias("head"))
    rows = cells.join(first, "sheet").filter(F.col("row_number") > F.col("head.row_number"))

    def cell(name: str) -> Column:
        return F.when(F.col(f"head.{name}") > 0, F.trim(X.text_of(F.try_element_at("cells", F.col(f"head.{name}"))))).otherwise("")

    rules = rows.select("sheet", "row_number", cell("standard").alias("standard"), split_terms(cell("discouraged")).alias("discouraged"), cell("language").alias("_scope")).filter("standard <> ''")
    return rules.withColumn("language_scope", language_scope(F.col("_scope"), F.col("sheet"), F.col("row_number"))).drop("_scope")


def united(rules: DataFrame) -> DataFrame:
    """One rule for each standard term and scope, with the discouraged terms of all in order of their rows."""
    seen = F.array_sort(F.collect_list(F.struct("sheet", "row_number", "discouraged")))
    out = rules.groupBy("standard", "language_scope").agg(seen.alias("seen"))
    first = F.try_element_at("seen", F.lit(1))
    return out.select("standard", F.array_distinct(F.flatten(F.transform("seen", lambda s: s["discouraged"]))).alias("discouraged"), "language_scope", first["sheet"].alias("sheet"), first["row_number"].alias("row_number"))


def first_of_each(rules: DataFrame, keys: list[str]) -> DataFrame:
    """The first rule of each key, by sheet and row."""
    return rules.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy("sheet", "row_number"))).filter("_n = 1").drop("_n")
