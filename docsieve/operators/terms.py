"""Term checks over documents: sensitive terms, common terms, locations and the static comparison of two documents.

Rules are a short list kept by people (at most ``MAX_RULES``), so no join is needed: sensitive terms travel inside the plan
as a literal array, common terms with the task that reads the texts. Every document is worked on by itself, in one pass
and without a shuffle; rows with one document id are read each for itself.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema, to_arrow_type

from docsieve.functions import text as X
from docsieve.functions import values as V
from docsieve.operators.places import Places

MAX_RULES, SAMPLES, FEW = 5000, 5, 64


@dataclass(frozen=True)
class SensitiveRule:
    invalid: str
    standard: str


@dataclass(frozen=True)
class CommonRule:
    standard: str
    discouraged: tuple[str, ...] = field(default=())
    scope: str = "all"


def _literal_rules(rows: list[tuple], names: list[str]) -> Column:
    if len(rows) > MAX_RULES:
        raise ValueError(f"{len(rows)} rules; {MAX_RULES} at most")
    structs = [F.struct(*[F.lit(v).alias(n) for v, n in zip(row, names, strict=True)]) for row in rows]
    kind = ", ".join(f"{n}: {'boolean' if n == 'ignore_case' else 'int' if n == 'rule' else 'string'}" for n in names)
    return F.array(*structs) if structs else F.array().cast(f"array<struct<{kind}>>")


def _rule_hits(text: Column, r: Column) -> Column:
    """A rule with hits, first_pos (0-based) and the positions of the first five."""
    parts = F.split(text, X.quoted(r["invalid"]), SAMPLES + 1)
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("seen"))
    step = F.length(r["invalid"])
    walk = F.aggregate(F.slice(parts, 1, F.size(parts) - 1), begin, lambda a, p: F.struct((a["at"] + F.length(p) + step).alias("at"), F.array_append(a["seen"], a["at"] + F.length(p)).alias("seen")))
    first = (F.instr(text, r["invalid"]) - 1).cast("long")
    return F.struct(r["invalid"].alias("invalid"), r["standard"].alias("standard"), X.literal_hits(text, r["invalid"]).alias("hits"), first.alias("first_pos"), walk["seen"].alias("positions"))


def _sensitive(docs: DataFrame, rules: Iterable[SensitiveRule], id_col: str, text_col: str) -> DataFrame:
    """doc_id, text, present: the rules that occur. Rules are independent; of equal (invalid, standard) pairs one counts."""
    rows = list(dict.fromkeys((r.invalid, r.standard) for r in rules if r.invalid))
    slim = docs.select(F.col(id_col).alias("doc_id"), X.text_of(F.col(text_col)).alias("text"))
    return slim.withColumn("present", F.filter(_literal_rules(rows, ["invalid", "standard"]), lambda r: F.contains(F.col("text"), r["invalid"])))


def sensitive_matches(docs: DataFrame, rules: Iterable[SensitiveRule], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document and rule that occurs: doc_id, invalid, standard, hits, first_pos (0-based), positions of the
    first five."""
    one = _sensitive(docs, rules, id_col, text_col).select("doc_id", "text", F.explode("present").alias("r"))
    return one.select("doc_id", _rule_hits(F.col("text"), F.col("r")).alias("m")).select("doc_id", "m.*")


_SPOTS = T.ArrayType(T.StructType([T.StructField("location", T.StringType()), T.StructField("excerpt", T.StringType())]))


#: So many documents are worked on at once in Python; what they give is in Arrow's memory before the next ones are read.
DOCUMENTS = 500


def _spots(texts: pa.Array, found: pa.Array) -> pa.Array:
    """Locations and excerpts of the terms found in each text. One text at a time is a Python string."""
    done = []
    for at in range(0, max(len(texts), 1), DOCUMENTS):
        rows = []
        for text, terms in zip(texts.slice(at, DOCUMENTS), found.slice(at, DOCUMENTS), strict=True):
            terms = terms.as_py()
            places = Places(text.as_py()) if terms else None
            rows.append([dict(zip(("location", "excerpt"), places.of(m["positions"], m["invalid"]), strict=True)) for m in terms])
        done.append(pa.array(rows, to_arrow_type(_SPOTS)))
    return pa.concat_arrays(done)


_spots = F.arrow_udf(_spots, _SPOTS)


def sensitive_items(docs: DataFrame, rules: Iterable[SensitiveRule], limit: int = 30, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Report items by first position, at most ``limit`` kinds per document."""
    keyed = F.array_sort(F.transform("found", lambda m: F.struct(m["first_pos"].alias("first_pos"), m["invalid"].alias("invalid"), m["standard"].alias("standard"), m["hits"].alias("hits"), m["positions"].alias("positions"))))
    kept = _sensitive(docs, rules, id_col, text_col).withColumn("found", F.transform("present", lambda r: _rule_hits(F.col("text"), r))).withColumn("found", F.slice(keyed, 1, max(1, limit))).filter(F.size("found") > 0)
    spots = kept.select("doc_id", "found", _spots("text", "found").alias("spots"))
    one = spots.select("doc_id", F.posexplode(F.arrays_zip("found", "spots")).alias("k", "m")).select("doc_id", "k", "m.found.*", "m.spots.*")
    term = F.col("invalid")
    return one.select(
        "doc_id",
        (F.col("k") + 1).alias("idx"),
        F.lit("敏感词/不规范用语").alias("category"),
        "location",
        "excerpt",
        F.concat(F.lit("文档中出现词表中的不规范用语“"), term, F.lit("”，共 "), F.col("hits").cast("string"), F.lit(" 处。")).alias("description"),
        F.lit("可能不符合公司统一表述、品牌口径或对外发布用语要求。").alias("impact"),
        F.concat(F.lit("建议统一替换为："), V.first_text(F.col("standard"), F.lit("请按公司词表补充规范用语")), F.lit("。")).alias("suggestion"),
        F.lit("issue").alias("type"),
    )


def sensitive_summary(docs: DataFrame, rules: Iterable[SensitiveRule], limit: int = 30, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: kinds found, hits in all, kinds beyond the limit; documents without a hit have zeros."""
    rules = list(rules)
    kinds = F.size("present").cast("long")
    total = F.aggregate("present", F.lit(0).cast("long"), lambda a, r: a + X.literal_hits(F.col("text"), r["invalid"]))
    return _sensitive(docs, rules, id_col, text_col).select("doc_id", kinds.alias("kinds"), total.alias("total_hits"), F.greatest(kinds - max(1, limit), F.lit(0)).alias("hidden_kinds"))


def _patterns(rules: Iterable[CommonRule]) -> list[tuple]:
    """(rule, term, standard, kind, scope, ignore_case) of every pattern to look for."""
    out = []
    for k, r in enumerate(rules):
        out += [(k, t, r.standard, "discouraged", r.scope, False) for t in r.discouraged if t and t != r.standard]
        if r.standard.lower() != r.standard.upper():
            out.append((k, r.standard, r.standard, "case", r.scope, True))
    return out


def rule_scopes(docs: DataFrame, rules: Iterable[CommonRule], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: its language, how many rules apply to it and how many are skipped because of their language scope."""
    per: dict[str, int] = {}
    for r in rules:
        per[r.scope] = per.get(r.scope, 0) + 1
    language = X.estimate_language(X.text_of(F.col(text_col)))
    out = docs.select(F.col(id_col).alias("doc_id"), language.alias("language"))
    own = F.lit(0)
    for scope, n in per.items():
        own = own + F.when(F.lit(scope == "all") | (F.col("language") == scope), n).otherwise(0)
    return out.withColumns({"applied": own.cast("long"), "skipped": (F.lit(sum(per.values())) - own).cast("long")})


class TermFinder:
    """All token-bounded hits of a set of rules in a text: no ASCII word character next to a side of the term that is one."""

    def __init__(self, rules: list[CommonRule]):
        self.patterns = []
        for rule, term, standard, kind, scope, ignore_case in _patterns(rules):
            left, right = ("(?<![A-Za-z0-9_])" * bool(re.match("[A-Za-z0-9_]", term)), "(?![A-Za-z0-9_])" * bool(re.search("[A-Za-z0-9_]\\Z", term)))
            compiled = re.compile(left + re.escape(term) + right, re.IGNORECASE if ignore_case else 0)
            self.patterns.append((rule, self.fold(term) if ignore_case else term, standard, kind, scope, ignore_case, compiled))
        self.automata = []
        if len(self.patterns) > FEW:
            for folded in (False, True):
                words: dict[str, list[int]] = {}
                for k, p in enumerate(self.patterns):
                    if p[5] == folded:
                        words.setdefault(p[1], []).append(k)
                automaton = ahocorasick.Automaton()
                for word, owners in words.items():
                    automaton.add_word(word, owners)
                automaton.make_automaton()
                self.automata.append((automaton, folded) if words else None)

    @staticmethod
    def fold(text: str) -> str:
        return text.lower().replace("ς", "σ")

    def _occurring(self, text: str) -> Iterable[tuple]:
        low = self.fold(text)
        if not self.automata:
            return [p for p in self.patterns if p[1] in (low if p[5] else text)]
        seen: set[int] = set()
        for automaton, folded in filter(None, self.automata):
            for _, owners in automaton.iter(low if folded else text):
                seen.update(owners)
        return [self.patterns[k] for k in sorted(seen)]

    def candidates(self, text: str, language: str) -> list[tuple]:
        """(start, -length, 0 for discouraged else 1, standard, stop, observed, kind, rule) of each hit."""
        out = []
        for rule, _, standard, kind, scope, _, pattern in self._occurring(text):
            if scope in ("all", language):
                order = 0 if kind == "discouraged" else 1
                out += [(m.start(), m.start() - m.end(), order, standard, m.end(), m[0], kind, rule) for m in pattern.finditer(text) if order == 0 or m[0] != standard]
        return out

    def selected(self, text: str, language: str) -> list[tuple]:
        """The hits of a left-to-right pass without overlap: by start, longer first, discouraged before case, then standard."""
        kept, last = [], -1
        for hit in sorted(self.candidates(text, language)):
            if hit[0] >= last:
                kept.append(hit)
                last = hit[4]
        return kept

    def matches(self, text: str, language: str) -> list[tuple]:
        """(first_pos, observed, standard, kind, hits, positions of the first five) of the selected hits, in this order."""
        found: dict[tuple, list[int]] = {}
        for start, _, _, standard, _, observed, kind, _ in self.selected(text, language):
            found.setdefault((observed, standard, kind), []).append(start)
        return sorted((at[0], *key, len(at), at[:SAMPLES]) for key, at in found.items())


def _per_document(docs: DataFrame, rules: Iterable[CommonRule], schema: str, rows_of: Callable[[TermFinder, str, str], list[tuple]], id_col: str, text_col: str) -> DataFrame:
    """doc_id and the columns of ``schema``: the rows that ``rows_of`` makes of each text and its language."""
    rules = list(rules)
    if len(_patterns(rules)) > MAX_RULES:
        raise ValueError(f"{len(_patterns(rules))} patterns; {MAX_RULES} at most")
    scoped = any(r.scope != "all" for r in rules)
    slim = docs.select(F.col(id_col).alias("doc_id"), X.text_of(F.col(text_col)).alias("text"))
    slim = slim.withColumn("language", X.estimate_language(F.col("text")) if scoped else F.lit("unknown"))
    kinds = to_arrow_schema(T.StructType.fromDDL(schema))
    id_type = slim.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = TermFinder(rules)
        for batch in (whole.slice(at, DOCUMENTS) for whole in batches for at in range(0, whole.num_rows, DOCUMENTS)):
            owner, rows = [], []
            for i, (text, language) in enumerate(zip(batch.column(1), batch.column(2), strict=True)):
                new = rows_of(finder, text.as_py(), language.as_py())
                owner += [i] * len(new)
                rows += new
            columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
            arrays = [pa.array(c, f.type) for c, f in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner, pa.int64())), *arrays], names=["doc_id", *kinds.names])

    return slim.mapInArrow(run, f"doc_id {id_type}, {schema}")


def term_candidates(docs: DataFrame, rules: Iterable[CommonRule], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All token-bounded hits: doc_id, rule, standard, kind, start (0-based), stop, observed. Rules with a language scope
    apply to documents of that language only."""
    return _per_document(docs, rules, "rule int, standard string, kind string, start int, stop int, observed string", lambda f, text, language: [(h[7], h[3], h[6], h[0], h[4], h[5]) for h in f.candidates(text, language)], id_col, text_col)


def common_selected(docs: DataFrame, rules: Iterable[CommonRule], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Candidates after greedy selection: by start, longer first, discouraged before case, then standard; no overlap."""
    return _per_document(docs, rules, "start int, stop int, observed string, standard string, kind string", lambda f, text, language: [(h[0], h[4], h[5], h[3], h[6]) for h in f.selected(text, language)], id_col, text_col)


def common_matches(docs: DataFrame, rules: Iterable[CommonRule], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, observed, standard, kind, hits, first_pos and the first five positions."""
    return _per_document(docs, rules, "observed string, standard string, kind string, hits long, first_pos int, positions array<int>", lambda f, text, language: [(*m[1:5], m[0], m[5]) for m in f.matches(text, language)], id_col, text_col)


def common_items(docs: DataFrame, rules: Iterable[CommonRule], limit: int = 30, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Report items by first position, at most ``limit`` kinds per document."""
    most = max(1, limit)

    def items(finder: TermFinder, text: str, language: str) -> list[tuple]:
        found = finder.matches(text, language)[:most]
        places = Places(text) if found else None
        return [(idx, observed, standard, kind, hits, *places.of(at, observed)) for idx, (_, observed, standard, kind, hits, at) in enumerate(found, 1)]

    kept = _per_document(docs, rules, "idx int, observed string, standard string, kind string, n long, location string, excerpt string", items, id_col, text_col)
    term, case = F.col("observed"), F.col("kind") == "case"
    hits = F.col("n").cast("string")
    return kept.select(
        "doc_id",
        "idx",
        F.when(case, "常用词/大小写不一致").otherwise("常用词/错误或不推荐用法").alias("category"),
        "location",
        "excerpt",
        F.when(case, F.concat(F.lit("文档中的“"), term, F.lit("”与常用词表规定的大小写“"), F.col("standard"), F.lit("”不一致，共 "), hits, F.lit(" 处。")))
        .otherwise(F.concat(F.lit("文档中出现常见错误或不推荐用法“"), term, F.lit("”，共 "), hits, F.lit(" 处。")))
        .alias("description"),
        F.when(case, "大小写不符合统一术语、产品名称或品牌写法要求。").otherwise("可能造成术语不统一、表达不规范或品牌写法不一致。").alias("impact"),
        F.concat(F.lit("请统一修改为词表中的正确写法："), F.col("standard"), F.lit("。")).alias("suggestion"),
        F.lit("issue").alias("type"),
    )


def static_profile(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Language, visible characters, paragraphs, hard tokens and headings of each document."""
    text = F.col(text_col)
    language = X.estimate_language(text)
    return docs.select(F.col(id_col).alias("doc_id"), X.language_label(language).alias("language"), X.visible_length(text).alias("nonspace_chars"), X.paragraphs(text).alias("paragraphs"), X.hard_tokens(text).alias("tokens"), X.headings(text).alias("headings"))


def profile_difference(pairs: DataFrame, profiles: DataFrame) -> DataFrame:
    """``pairs`` (a, b) of documents: length ratio and the tokens that only one of them has (40 by length, value)."""
    left, right = (profiles.select(*[F.col(c).alias(f"{c}_{s}") for c in profiles.columns]) for s in ("a", "b"))
    both = pairs.join(left, F.col("a") == F.col("doc_id_a")).join(right, F.col("b") == F.col("doc_id_b"))
    return both.select(
        "a",
        "b",
        F.col("language_a"),
        F.col("language_b"),
        V.ratio_label(F.col("nonspace_chars_b"), F.col("nonspace_chars_a")).alias("length_ratio"),
        X.by_length(F.array_except("tokens_a", "tokens_b")).alias("only_a"),
        X.by_length(F.array_except("tokens_b", "tokens_a")).alias("only_b"),
    )
