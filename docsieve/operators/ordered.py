"""What depends on the rows before: as-of lookups, heading paths, numbers of equal lines and numbers in order.

A group (a document, a task) may be large, so none is ever sorted in one piece: rows are dealt by stretches of ``width``
places of the ordering column, each stretch is worked on by itself, and what the stretches before hand on (one row each)
is added. Rows whose place is null see nothing and hand on nothing."""

from __future__ import annotations

import re
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

WIDTH = 100_000
# How a document's text marks its pages and its sheets.
MARKERS = {"page": r"\[第(\d+)页\]", "sheet": r"(?m)^#\s*工作表：(.+?)\s*$"}


def _meet(rows: DataFrame, starts: DataFrame, by: Sequence[str]) -> DataFrame:
    """``rows`` with what was handed on to their group and stretch."""
    renamed = starts.withColumnsRenamed({c: f"_by{k}" for k, c in enumerate(by)} | {"_part": "_of"})
    return rows.join(renamed, [F.col("_part").eqNullSafe(F.col("_of")), *[F.col(c).eqNullSafe(F.col(f"_by{k}")) for k, c in enumerate(by)]])


def carried(rows: DataFrame, by: Sequence[str], on: str, values: Sequence[str], width: int = WIDTH, tie: Sequence[str] = ()) -> DataFrame:
    """``last_<v>`` for each v of ``values``: the last value that is not null at or before the row, in the order of ``on``,
    then ``tie``, within ``by``."""
    placed = F.col(on).isNotNull()
    dealt = rows.withColumns({f"_v_{v}": F.when(placed, F.col(v)) for v in values} | {"_part": F.floor(F.col(on) / width).cast("long")})
    order = [on, *tie]
    here = Window.partitionBy(*by, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    ends = dealt.groupBy(*by, "_part").agg(*[F.max_by(f"_v_{v}", F.when(F.col(f"_v_{v}").isNotNull(), F.struct(*order))).alias(f"_end_{v}") for v in values])
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = ends.select(*by, "_part", *[F.last(f"_end_{v}", ignorenulls=True).over(before).alias(f"_before_{v}") for v in values])
    near = dealt.withColumns({f"_near_{v}": F.last(f"_v_{v}", ignorenulls=True).over(here) for v in values})
    done = _meet(near, starts, by)
    return done.select(*rows.columns, *[F.when(placed, F.coalesce(f"_near_{v}", f"_before_{v}")).alias(f"last_{v}") for v in values])


def asof(left: DataFrame, right: DataFrame, by: Sequence[str], on: str, values: Sequence[str], width: int = WIDTH) -> DataFrame:
    """Every row of ``left`` with the ``values`` of the last row of ``right`` in its group at or before its place; nulls where
    there is none. Of rows of ``right`` at one place, the one with the largest values counts."""
    if clash := set(values) & set(left.columns):
        raise ValueError(f"columns of both sides: {sorted(clash)}")
    row, value = F.struct(*left.columns), F.struct(*values)
    row_type, value_type = left.select(row.alias("x")).schema["x"].dataType, right.select(value.alias("x")).schema["x"].dataType
    one = left.select(*by, on, F.lit(1).alias("_side"), row.alias("_row"), F.lit(None).cast(value_type).alias("_value"))
    other = right.select(*by, on, F.lit(0).alias("_side"), F.lit(None).cast(row_type).alias("_row"), value.alias("_value"))
    done = carried(one.unionByName(other), by, on, ["_value"], width, tie=("_side", "_value")).filter("_side = 1")
    return done.select("_row.*", *[F.col("last__value")[v].alias(v) for v in values])


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("pos", T.LongType()), T.StructField("label", T.StringType())])))
def _found(texts: pd.Series, patterns: pd.Series) -> pd.Series:
    """Place and first group of each match. A column expression can give the matches, but not where they are."""
    return pd.Series([[{"pos": m.start(), "label": (m.group(m.re.groups and 1) or "").strip()} for m in re.finditer(p, t)] for t, p in zip(texts, patterns, strict=True)])


def marker_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, kind, pos, label): the page and sheet markers of each text that are not blank."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    kinds = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(p).alias("pattern")) for k, p in MARKERS.items()])).alias("m")
    some = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), kinds).filter(F.contains("text", F.when(F.col("m.kind") == "page", "[第").otherwise("工作表：")))
    return some.select("doc_id", F.col("m.kind").alias("kind"), F.inline(_found("text", "m.pattern"))).filter("label <> ''")


def hit_rows(docs: DataFrame, terms: Sequence[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, term, pos): every occurrence of each term, from left to right without overlap."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.explode(F.array(*[F.lit(t) for t in terms])).alias("term")).filter(F.contains("text", F.col("term")))
    literal = F.regexp_replace("term", r"([^\w\s])", r"\\$1")
    return rows.select("doc_id", "term", F.inline(_found("text", literal))).select("doc_id", "term", "pos")


def marked_hits(hits: DataFrame, markers: DataFrame, kinds: Sequence[str] = tuple(MARKERS), width: int = WIDTH) -> DataFrame:
    """``hits`` (doc_id, pos, …) with the label of the last marker of each kind at or before them, as columns named by kind:
    one as-of join for all kinds."""
    slots = {k: F.when(F.col("kind") == k, F.col("label")) for k in kinds}
    row = F.struct(*hits.columns)
    one = hits.select("doc_id", "pos", F.lit(1).alias("_side"), row.alias("_row"), *[F.lit(None).cast("string").alias(k) for k in kinds])
    row_type = one.schema["_row"].dataType
    other = markers.select("doc_id", "pos", F.lit(0).alias("_side"), F.lit(None).cast(row_type).alias("_row"), *[v.alias(k) for k, v in slots.items()])
    done = carried(one.unionByName(other), ["doc_id"], "pos", list(kinds), width, tie=("_side", *kinds)).filter("_side = 1")
    return done.select("_row.*", *[F.col(f"last_{k}").alias(k) for k in kinds])


def heading_paths(lines: DataFrame, by: Sequence[str], on: str, level: str, label: str, levels: int = 9, width: int = WIDTH) -> DataFrame:
    """``path``: the headings above each line, outermost first; a heading is in its own path. A heading (its level is not
    null; levels are brought into 1 to ``levels``) ends all of its level and below. What a stretch hands on is the last
    heading of each level with its place: one of a level above that comes later makes it void, whoever compares."""
    deep = F.greatest(F.lit(1), F.least(F.lit(levels), F.col(level).cast("int")))
    slots = {f"_h{k}": F.when(F.col(level).isNotNull() & (deep == k), F.struct(F.col(on).cast("long").alias("at"), F.col(label).alias("label"))) for k in range(1, levels + 1)}
    done = carried(lines.withColumns(slots), by, on, list(slots), width)
    live, above = [], F.lit(None).cast("long")
    for k in range(1, levels + 1):
        mine = F.col(f"last__h{k}")
        live.append(F.when(mine.isNotNull() & (above.isNull() | (mine["at"] > above)), F.coalesce(mine["label"], F.lit(""))))
        above = F.greatest(above, mine["at"])
    return done.select(*lines.columns, F.filter(F.array(*live), lambda x: x.isNotNull()).alias("path"))


def occurrences(lines: DataFrame, by: Sequence[str], line: str, on: str, width: int = WIDTH) -> DataFrame:
    """``n``: the how many-th of its equals in the group a line is. A line that fills a group is counted by stretches."""
    dealt = lines.withColumn("_part", F.floor(F.col(on) / width).cast("long"))
    keys = [*by, line]
    counts = dealt.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*keys).orderBy("_part")) - F.col("_n")
    here = F.row_number().over(Window.partitionBy(*keys, "_part").orderBy(on))
    done = _meet(dealt.withColumn("_here", here), counts.select(*keys, "_part", before.alias("_before")), keys)
    return done.select(*lines.columns, (F.col("_before") + F.col("_here")).alias("n"))


def aligned(a: DataFrame, b: DataFrame, by: Sequence[str], line: str, on: str, width: int = WIDTH) -> DataFrame:
    """The lines of two texts side by side, the n-th of one with the n-th equal line of the other: by, line, n, ``<on>_a``,
    ``<on>_b``; one of these is null where a line has no partner."""
    left, right = (occurrences(x.select(*by, line, on), by, line, on, width).withColumnRenamed(on, f"{on}_{s}") for x, s in ((a, "a"), (b, "b")))
    return left.join(right, [*by, line, "n"], "full")


def replaced_lines(text_lines: DataFrame, changes: DataFrame, by: Sequence[str], line: str, on: str, new: str, width: int = WIDTH) -> DataFrame:
    """``text_lines`` with the n-th equal line of ``changes`` put in place of each (``changes``: by, line, on, new)."""
    numbered = occurrences(text_lines, by, line, on, width)
    other = occurrences(changes.select(*by, line, on, new), by, line, on, width).select(*by, line, "n", F.col(new).alias("_new"))
    done = numbered.join(other, [*by, line, "n"], "left")
    return done.select(*[F.coalesce("_new", line).alias(line) if c == line else F.col(c) for c in text_lines.columns])


def range_of(rows: DataFrame, key: Sequence[str]) -> Column:
    """The number of a row's range of ``key``: as many ranges as the session has shuffle partitions, parted by keys that are
    picked by their hash, so that every evaluation deals the rows alike. Only those keys come to the driver. A row looks for
    its range in two steps (which of about sqrt(n) blocks of cuts, then which cut of it), not among all cuts."""
    most = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) - 1)
    picked = rows.select(*key).orderBy(F.xxhash64(*key)).limit(most).orderBy(*key).collect()
    if not picked:
        return F.lit(0)
    cuts = [F.struct(*[F.lit(r[c]).cast(rows.schema[c].dataType).alias(c) for c in key]) for r in picked]
    wide = max(1, round(len(cuts) ** 0.5))
    blocks = [cuts[k : k + wide] for k in range(0, len(cuts), wide)]
    own = F.struct(*key)
    passed = F.size(F.filter(F.array(*[b[-1] for b in blocks]), lambda cut: cut <= own))
    block = F.get(F.array(*[F.array(*b) for b in blocks]), passed)
    return passed * wide + F.coalesce(F.size(F.filter(block, lambda cut: cut <= own)), F.lit(0))


def numbered(rows: DataFrame, by: Sequence[str], order: Sequence[str], name: str = "n") -> DataFrame:
    """The place of each row in its group (from 1), in the order of columns that tell its rows apart. Rows are numbered
    within ranges of (group, order); what a group has in the ranges before is added."""
    dealt = rows.withColumn("_part", range_of(rows, [*by, *order]))
    counts = dealt.groupBy(*by, "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*by).orderBy("_part")) - F.col("_n")
    here = F.row_number().over(Window.partitionBy("_part", *by).orderBy(*order))
    done = _meet(dealt.withColumn("_here", here), counts.select(*by, "_part", before.alias("_before")), by)
    return done.select(*rows.columns, (F.col("_before") + F.col("_here")).cast("long").alias(name))
