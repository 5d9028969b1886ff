"""How five filters act on each other, for every order in which they could be applied.

Each document gets a mask of the filters that it fails. Per part and label (all documents, those of quality 1, those that
are toxic) Spark sums the 32 signed parities of the masks, (-1)^bits(mask & s) for s from 0 to 31: a Walsh-Hadamard
spectrum that adds up over any split of the rows, so no row is moved for it but sums. The spectrum is inverted exactly (it
is its own inverse but for a factor of 32) into the number of documents of each mask; all 120 orders and the Shapley values
follow from these 32 numbers: of the orders, a document that fails k filters is removed by each of the k in 120 / k.

The filters: A under 100 words; B 100 * distinct words < 80 * words; C 100 * capitals A-Z > 10 * code points; D any of
``#$%&*|``; E equal to the text of a smaller doc_id anywhere in the table. Equal texts are told by their SHA-256. E is found
from sums too: per text, part and label only the number of rows and the smallest doc_id with its rows are kept, so a text
that a third of all rows share is one row per task.

Defined results: null text is empty (it fails A only, unless it repeats), null lang is the part ''; repeated rows count
each, and rows with equal text and equal doc_id do not fail E by each other; a row without doc_id neither fails E nor makes
others fail it, and has no label; of several labels of a doc_id the largest of each column counts; an empty table gives none.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsieve.llm.common import persist_table, scratch, whole_text

FILTERS = "ABCDE"
MASKS = 1 << len(FILTERS)
SPACES = " \\x09-\\x0D"


def _sign(a: Column, b: Column) -> Column:
    return F.lit(1) - F.bit_count(a.bitwiseAND(b)) % 2 * 2


def masks(docs: DataFrame) -> DataFrame:
    """doc_id, part, mask of A to D (bit 0 is A), and the text's digest."""
    text = whole_text("text")
    words = F.regexp_replace(text, f"^[{SPACES}]+|[{SPACES}]+$", "")
    split = F.when(words == "", F.array().cast("array<string>")).otherwise(F.split(words, f"[{SPACES}]+"))
    seen = docs.select("doc_id", F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), text.alias("text"), split.alias("words"))
    fails = (
        F.size("words") < 100,
        100 * F.size(F.array_distinct("words")).cast("long") < 80 * F.size("words").cast("long"),
        100 * F.regexp_count("text", F.lit("[A-Z]")).cast("long") > 10 * F.length("text").cast("long"),
        F.col("text").rlike("[#$%&*|]"),
    )
    mask = sum((f.cast("int") * (1 << k) for k, f in enumerate(fails)), F.lit(0))
    return seen.select("doc_id", "part", mask.alias("mask"), F.unhex(F.sha2("text", 256)).alias("digest"))


def spectra(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, label (0 all, 1 good, 2 toxic), w0 to w31: the signed parity sums of the masks."""
    rated = labels.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    rows = persist_table(masks(docs).groupBy("doc_id", "part", "mask", "digest").agg(F.count("*").alias("n")), "masks")
    flags = [F.coalesce(F.col(c), F.lit(0)).alias(c) for c in ("good", "toxic")]
    known = rows.filter(F.col("doc_id").isNotNull()).join(rated, "doc_id", "left").select("doc_id", "part", "mask", "digest", "n", *flags)
    bare = rows.filter(F.col("doc_id").isNull()).select("doc_id", "part", "mask", "digest", "n", F.lit(0).alias("good"), F.lit(0).alias("toxic"))
    kinds = ["digest", "mask", "part", "good", "toxic"]
    held = F.col("doc_id").isNotNull()
    # known has a row for each (doc_id, kinds), so the least struct has all rows of the least doc_id
    per_kind = known.unionByName(bare).groupBy(*kinds).agg(F.sum("n").alias("n"), F.sum(F.when(held, F.col("n")).otherwise(0)).alias("held"), F.min(F.when(held, F.struct("doc_id", "n"))).alias("least"))
    first = per_kind.groupBy("digest").agg(F.collect_list(F.struct("mask", "part", "good", "toxic", "n", "held", "least")).alias("kinds"), F.min("least.doc_id").alias("first"))  # a text has one entry for each part and label
    each = first.select(F.inline("kinds"), "first")
    unique = F.col("n") - F.col("held") + F.when(F.col("least.doc_id") == F.col("first"), F.col("least.n")).otherwise(0)
    both = each.select("part", "good", "toxic", F.inline(F.array(F.struct(F.col("mask").alias("m"), unique.alias("c")), F.struct((F.col("mask") + 16).alias("m"), (F.col("n") - unique).alias("c")))))
    label = F.explode(F.filter(F.array(F.lit(0), F.when(F.col("good") == 1, 1), F.when(F.col("toxic") == 1, 2)), lambda x: x.isNotNull())).alias("label")
    sums = [F.sum(_sign(F.col("m"), F.lit(s)) * F.col("c")).alias(f"w{s}") for s in range(MASKS)]
    return both.filter(F.col("c") > 0).select("part", label, "m", "c").groupBy("part", "label").agg(*sums)


def cells(spectrum: DataFrame) -> DataFrame:
    """part, and for all, good and toxic an array of the number of documents of each mask: the exact inverse."""
    w = F.array(*[F.col(f"w{s}") for s in range(MASKS)])
    places = F.sequence(F.lit(0), F.lit(MASKS - 1))
    back = F.transform(places, lambda m: F.aggregate(F.transform(places, lambda s: _sign(m, s) * F.element_at("w", s + 1)), F.lit(0).cast("long"), lambda a, b: a + b))
    exact = spectrum.select("part", "label", w.alias("w")).select("part", "label", F.transform(back, lambda c: F.shiftright(c, 5)).alias("cells"))  # always a multiple of 32
    none = F.array_repeat(F.lit(0).cast("long"), MASKS)
    return exact.groupBy("part").agg(*[F.coalesce(F.max(F.when(F.col("label") == k, F.col("cells"))), none).alias(name) for k, name in enumerate(("every", "good", "toxic"))])


def _where(cell: str, test) -> Column:
    """The sum of the cells whose mask passes the test."""
    return F.aggregate(F.filter(F.transform(cell, lambda c, m: F.struct(m.alias("m"), c.alias("c"))), lambda x: test(x["m"])), F.lit(0).cast("long"), lambda a, x: a + x["c"])


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order and step; see the module for the columns' meaning."""
    with scratch(docs.sparkSession):
        found = persist_table(cells(spectra(docs, labels)), "cells", keep=True)
    steps = [(order, k + 1, sum(1 << FILTERS.index(f) for f in order[:k]), 1 << FILTERS.index(order[k])) for order in map("".join, permutations(FILTERS)) for k in range(len(FILTERS))]
    plan = F.array(*[F.struct(F.lit(o).alias("filter_order"), F.lit(k).alias("step"), F.lit(before).alias("before"), F.lit(own).alias("own")) for o, k, before, own in steps])
    # what a step does depends on the set before it and its filter alone: 80 pairs for 600 steps
    pairs = found.select("*", F.inline(F.array(*[F.struct(F.lit(b).alias("before"), F.lit(o).alias("own")) for b, o in sorted({(b, o) for _, _, b, o in steps})])))
    before, own = F.col("before"), F.col("own")
    fails, gone = (lambda m: m.bitwiseAND(own) != 0), (lambda m: m.bitwiseAND(before) != 0)
    lost = lambda cell: _where(cell, lambda m: fails(m) & ~gone(m))
    done = pairs.select(
        "part", "before", "own", _where("every", lambda m: m.bitwiseAND(before.bitwiseOR(own)) == 0).alias("kept"), lost("every").alias("removed"), _where("every", lambda m: fails(m) & gone(m)).alias("redundant"),
        _where("every", lambda m: m == own).alias("unique_fails"), lost("good").alias("good_lost"), lost("toxic").alias("toxic_lost"),
        F.aggregate(F.transform("every", lambda c, m: F.when(fails(m), c * F.expr("120").cast("long") / F.bit_count(m)).otherwise(0)), F.lit(0.0), lambda a, x: a + x).cast("long").alias("shapley"),
    )
    numbers = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    by_part = done.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct(before * MASKS + own, F.struct(*numbers)))).alias("at"))
    rows = by_part.select("part", "at", F.inline(plan))
    hit = F.element_at("at", before * MASKS + own)
    return rows.select("part", "filter_order", F.col("step").cast("int").alias("step"), *[hit[c].alias(c) for c in numbers])
