"""Term checks whose rules are a table: read from files, or made by other queries.

All terms are looked for in one pass over each text with an Aho-Corasick automaton (pyahocorasick), so the work per text
does not grow with the number of rules. A table of more than ``CHUNK`` rules is taken in parts of that size, each with a
pass of its own; neither the driver nor an executor holds more than one part."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsieve.functions import text as X
from docsieve.operators.ordered import numbered
from docsieve.operators.terms import MAX_RULES, SAMPLES, CommonRule

CHUNK = 50_000


def _hits(docs: DataFrame, terms: list[str]) -> DataFrame:
    """doc_id, term, hits, first_pos, positions of the first hits, for the terms that occur."""
    held = docs.sparkSession.sparkContext.broadcast(terms)
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = ahocorasick.Automaton()
        for k, term in enumerate(held.value):
            automaton.add_word(term, k)
        automaton.make_automaton()
        sizes = [len(t) for t in held.value]
        for batch in batches:
            row, term, hits, places = [], [], [], []
            for i, text in enumerate(batch.column(1)):
                free: dict[int, int] = {}  # where the next hit of a term may begin: its hits do not overlap
                found: dict[int, list[int]] = {}
                for last, k in automaton.iter(text.as_py()):
                    begin = last - sizes[k] + 1
                    if begin >= free.get(k, 0):
                        free[k] = last + 1
                        at = found.setdefault(k, [0])
                        at[0] += 1
                        if len(at) <= SAMPLES:
                            at.append(begin)
                for k, at in found.items():
                    row.append(i)
                    term.append(held.value[k])
                    hits.append(at[0])
                    places.append(at[1:])
            ids = batch.column(0).take(pa.array(row, pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, pa.array(term, pa.string()), pa.array(hits, pa.int64()), pa.array(places, pa.list_(pa.int32()))], names=["doc_id", "term", "hits", "positions"])

    return docs.mapInArrow(run, f"doc_id {id_type}, term string, hits long, positions array<int>")


def term_matches(docs: DataFrame, rules: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK) -> DataFrame:
    """``rules`` (invalid, standard) -> doc_id, invalid, standard, hits, first_pos (0-based), positions of the first five, as
    ``terms.sensitive_matches``. Empty and null terms are no rules, equal pairs count once."""
    pairs = rules.select("invalid", F.coalesce("standard", F.lit("")).alias("standard")).filter("invalid <> ''").distinct()
    slim = docs.select(F.col(id_col).alias("doc_id"), X.text_of(F.col(text_col)).alias("text"))
    terms = numbered(pairs.select("invalid").distinct(), [], ["invalid"], "_n")
    count = terms.count()
    found = None
    for begin in range(0, max(count, 1), chunk):
        part = [r["invalid"] for r in terms.filter((F.col("_n") > begin) & (F.col("_n") <= begin + chunk)).collect()]
        hits = _hits(slim, part) if part else _hits(slim.limit(0), ["-"])
        found = hits if found is None else found.unionByName(hits)
    return found.join(pairs, found["term"] == pairs["invalid"]).select("doc_id", "invalid", "standard", "hits", F.try_element_at("positions", F.lit(1)).cast("long").alias("first_pos"), "positions")


def common_rules(rules: DataFrame) -> list[CommonRule]:
    """A rule table (standard, discouraged, language_scope) for the checks that take rules in the plan: MAX_RULES at most."""
    rows = rules.select("standard", "discouraged", "language_scope").orderBy("standard", "language_scope").limit(MAX_RULES + 1).collect()
    if len(rows) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules; literal terms of larger tables: term_matches")
    return [CommonRule(r["standard"], tuple(r["discouraged"]), r["language_scope"]) for r in rows]
