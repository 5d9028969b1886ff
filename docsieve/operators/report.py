"""The report pipeline over items: normalise, deduplicate, rank, suppress, limit, overlay reviews, count."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docsieve.functions import answers as A
from docsieve.functions import similarity as S
from docsieve.functions import text as X
from docsieve.functions import values as V

# Orders, labels and synonyms of the report's vocabulary.
TYPES = ("issue", "suggestion", "non_issue")
SEVERITIES = {"critical": "致命", "high": "高", "medium": "中", "low": "低"}
CONFIDENCES = {"high": "高", "medium": "中", "low": "低"}
SEVERITY_WORDS = {
    "critical": "critical", "fatal": "critical", "blocker": "critical", "致命": "critical", "灾难性": "critical", "极高": "critical",
    "high": "high", "严重": "high", "重大": "high", "高": "high",
    "medium": "medium", "middle": "medium", "moderate": "medium", "一般": "medium", "中": "medium",
    "low": "low", "minor": "low", "轻微": "low", "低": "low",
}
CONFIDENCE_WORDS = {
    "high": "high", "certain": "high", "明确": "high", "高": "high",
    "medium": "medium", "middle": "medium", "moderate": "medium", "较高": "medium", "中": "medium",
    "low": "low", "uncertain": "low", "较低": "low", "低": "low",
}
NO_IMPACT = (
    "无实质影响", "无实际影响", "没有实质影响", "没有实际影响", "无明显影响", "不造成实质影响", "影响不大", "影响较小", "影响很小", "无影响", "不影响理解", "不影响使用",
    "nosubstantiveimpact", "nomaterialimpact", "nosignificantimpact", "norealimpact", "noactualimpact", "doesnotaffect",
)
NO_ACTION = (
    "无需修改", "无须修改", "不需修改", "不需要修改", "无需处理", "无须处理", "不需处理", "不需要处理", "无需调整", "无须调整", "不需调整", "无需修正", "保持不变",
    "nomodificationrequired", "nomodificationneeded", "noneedtomodify", "noneedtochange", "nochangeneeded", "noactionrequired", "noactionneeded",
)
SUPPRESSING_REASONS = ("model_hallucination", "false_positive", "not_applicable")
KEY_FIELDS = ("type", "category", "excerpt", "description", "impact", "suggestion")
TEXT_FIELDS = ("severity_label", "confidence_label", "category", "location", "excerpt", "description", "impact", "suggestion")
TEXT_LABELS = ("严重程度", "证据可信度", "问题类型", "位置", "原文/证据", "问题描述", "影响", "修改建议")


def _lookup(words: dict[str, str], value: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in words.items() for x in pair])
    return F.coalesce(table[F.lower(F.trim(X.text_of(value)))], F.lit(""))


def severity(value: Column) -> Column:
    return _lookup(SEVERITY_WORDS, value)


def confidence(value: Column) -> Column:
    return _lookup(CONFIDENCE_WORDS, value)


def rank_of(value: Column, order: tuple[str, ...] | list[str]) -> Column:
    """Place in ``order``; anything else comes last."""
    return F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(v) for v in order]), value), F.lit(0)) - 1, F.lit(len(order))).cast("int")


def priority() -> list[Column]:
    """Type, then confidence, then severity, then the original index."""
    return [rank_of(F.col("type"), TYPES), rank_of(F.col("confidence"), list(CONFIDENCES)), rank_of(F.col("severity"), list(SEVERITIES)), F.col("idx")]


def _any_of(value: Column, markers: tuple[str, ...]) -> Column:
    return X.let(F.lower(X.text_of(value)), lambda low: reduce(lambda a, b: a | b, [low.contains(m) for m in markers]))


def no_action(impact: Column, suggestion: Column) -> Column:
    """A finding that names no impact and asks for nothing is not an issue."""
    return _any_of(impact, NO_IMPACT) & _any_of(suggestion, NO_ACTION)


def item_text() -> Column:
    """Labelled lines of the fields that are filled."""
    lines = [F.when(F.trim(X.text_of(F.col(f))) != "", F.concat(F.lit(f"{label}："), F.trim(F.col(f)))) for f, label in zip(TEXT_FIELDS, TEXT_LABELS, strict=True)]
    return F.concat_ws("\n", *lines)


def read_results(tasks: DataFrame) -> DataFrame:
    """(task_id, result_json) -> task_id, place, code, report (summary, items), result: the results of each task. A report is
    looked for in the fields made for it, then in the answer's text. What is no list has no results."""
    parsed = F.from_json("result_json", "array<map<string,string>>")
    out = tasks.select("task_id", F.posexplode(F.filter(parsed, lambda m: m.isNotNull())).alias("place", "m"))
    m = F.col("m")
    listed = F.when(m["structured_items"].isNotNull(), F.concat(F.lit('{"summary":'), V.json_string(X.text_of(m["summary"])), F.lit(',"items":'), m["structured_items"], F.lit("}")))
    return out.select("task_id", "place", m["code"].alias("code"), A.reports(m["structured_report"], m["report_json"], listed, m["result"]).alias("report"), m["result"].alias("result"))


def report_items(results: DataFrame) -> DataFrame:
    """(task_id, code, report, result) -> one row per item: task_id, code, idx, the fields, type, text and id. A result
    without a report is read as a plain one."""
    keys = [F.col("task_id"), F.col("code")]
    item = F.col("item")
    given = {f: A.named(item, k) for f, k in A.FIELD_KEYS.items()}
    told = F.when(item.isNotNull(), A.status_of(A.named(item, A.STATUS_KEYS)))
    # One pass: an answer is read once, and its items or the pieces of a plain report are unfolded by one generator.
    said = F.trim(X.text_of(F.col("result")))
    chunks = X.let(A.legacy_chunks(said), lambda c: F.when(F.size(c) > 0, c).when(said != "", F.array(said)))
    none, no_item = F.lit(None).cast("string"), F.lit(None).cast("map<string,string>")
    rows = F.when(F.col("report.items").isNotNull(), F.transform("report.items", lambda x: F.struct(x.alias("item"), none.alias("chunk")))).otherwise(F.transform(chunks, lambda c: F.struct(no_item.alias("item"), c.alias("chunk"))))
    found = results.select(*keys, rows.alias("rows")).select(*keys, F.posexplode("rows").alias("k", "row"))
    found = found.select(*keys, (F.col("k") + 1).alias("idx"), F.col("row.item").alias("item"), F.col("row.chunk").alias("chunk"))
    found = X.with_computed(found, {"parts": F.when(F.col("item").isNull(), A.legacy_parts(F.col("chunk")))})
    fields = A.legacy_fields(F.col("chunk"), F.col("parts"))
    from_items = F.col("item").isNotNull()
    both = {f: F.when(from_items, given[f]).otherwise(fields.get(f, F.lit(""))) for f in A.FIELD_KEYS}
    out = X.with_computed(found, both | {"told": told, "plain": F.size(item) == 1, "whole": item[""]}).drop("item", "parts")
    bare = F.col("chunk").isNull() & A.is_status_only(F.col("category"))
    out = X.with_computed(out, {"told": F.coalesce("told", F.when(bare, A.status_of(F.col("category")))), "category": F.when(bare, "").otherwise(F.col("category"))})
    empty = F.concat(*[F.col(f) for f in ("category", "location", "excerpt", "description", "impact", "suggestion")]) == ""
    out = out.withColumn("description", F.when(F.col("chunk").isNull() & empty, F.col("whole")).otherwise(F.col("description")))
    return normalise_items(out)


def normalise_items(items: DataFrame) -> DataFrame:
    """Vocabulary unified, labels added, the type told or inferred (a finding without impact or action is none), text and
    id of each item computed. Items have ``told``, ``plain``, ``whole`` and ``chunk`` as in ``report_items`` (a piece of a plain
    report is its text as it stands, which tells its type), or ``type`` alone."""
    labels = {"severity_label": (SEVERITIES, "severity"), "confidence_label": (CONFIDENCES, "confidence")}
    out = X.with_computed(items, {"severity": severity(F.col("severity")), "confidence": confidence(F.col("confidence"))})
    out = X.with_computed(out, {name: F.coalesce(F.create_map(*[F.lit(x) for p in table.items() for x in p])[F.col(source)], F.lit("")) for name, (table, source) in labels.items()})
    told = "told" in out.columns
    piece = F.col("chunk") if told else F.lit(None).cast("string")
    out = X.with_computed(out, {"text": F.coalesce(piece, item_text())})
    if told:
        kind = F.coalesce("told", A.inferred_type(F.when(F.col("plain"), F.col("whole")).otherwise(F.col("text"))))
    else:
        kind = F.when(F.col("type").isin(*TYPES), F.col("type")).otherwise("issue")
    out = X.with_computed(out, {"type": F.when(piece.isNull() & no_action(F.col("impact"), F.col("suggestion")), "non_issue").otherwise(kind)})
    return out.drop("told", "plain", "whole", "chunk").withColumn("id", V.item_id(F.col("code"), F.col("idx"), F.col("text")))


def media_text(item: dict[str, Column], labels: dict[str, str]) -> Column:
    """Description, then the labelled details that are filled, one a line."""
    return F.concat_ws("\n", F.nullif(F.trim(item["description"]), F.lit("")), *[F.when(F.trim(X.text_of(item[k])) != "", F.concat(F.lit(f"{v}："), F.trim(item[k]))) for k, v in labels.items()])


def deduplicate(items: DataFrame, by: tuple[str, ...] = ("task_id", "code")) -> DataFrame:
    """Items that agree in type and content are one: the first stays, takes the other places that are new to it, and the
    confidence and severity of the best. Items without content are never merged."""
    keys = [X.collapse(F.col(f)) for f in KEY_FIELDS]
    bare = F.array(F.lit("#"), F.col("idx").cast("string"))
    key = X.let(F.array(*keys), lambda k: F.when(F.concat_ws("", F.slice(k, 2, len(keys))) == "", bare).otherwise(k))
    carried = [c for c in items.columns if c not in (*by, "idx", "location", "severity", "confidence")]
    # A row holds a text once: where the key says what the fields say, they are read from it, and words of the vocabulary are
    # read from their rank. What is sorted and shuffled has neither twice.
    own = F.array(*[F.col(f) for f in KEY_FIELDS])
    kind, sure, grave, _ = priority()
    kept = {"_own": F.when(~own.eqNullSafe(F.col("_key")), own), "_rank": (kind * 100 + sure * 10 + grave).cast("int")}
    kept |= {"_severity": F.when(grave == len(SEVERITIES), F.col("severity")), "_confidence": F.when(sure == len(CONFIDENCES), F.col("confidence"))}
    extra = [c for c in carried if c not in KEY_FIELDS]
    lean = X.with_computed(items.withColumns({"_key": key, "_place": F.trim(X.text_of(F.col("location")))}), kept)
    lean = lean.select(*by, "_key", "_place", "idx", *kept, *extra)
    # Items of one place go first, on both sides of the shuffle: what a group gathers is its distinct places, not its items.
    placed = lean.groupBy(*by, "_key", "_place").agg(
        F.min(F.struct("idx", "_own", *extra)).alias("first"),
        F.min(F.struct("_rank", "idx", "_severity", "_confidence")).alias("best"),
        F.count(F.lit(1)).alias("merged"),
    )
    grouped = placed.groupBy(*by, "_key").agg(
        F.min("first").alias("first"),
        F.array_sort(F.collect_list(F.struct(F.col("first.idx").alias("idx"), F.col("_place").alias("location")))).alias("places"),
        F.min("best").alias("best"),
        F.sum("merged").alias("merged"),
    )
    joined = F.aggregate(
        F.transform("places", lambda p: p["location"]),
        F.lit(""),
        lambda a, b: F.when(a == "", b).when((b == "") | F.contains(a, b), a).otherwise(F.concat(a, F.lit("；"), b)),
    )
    fields = {f: F.when(F.col("first._own").isNull(), F.get("_key", F.lit(k))).otherwise(F.get("first._own", F.lit(k))).alias(f) for k, f in enumerate(KEY_FIELDS)}
    rank = F.col("best._rank")
    word = lambda words, place, other: F.coalesce(F.get(F.array(*[F.lit(w) for w in words]), place), other)
    levels = [word(SEVERITIES, rank % 10, F.col("best._severity")).alias("severity"), word(CONFIDENCES, F.floor(rank / 10).cast("int") % 10, F.col("best._confidence")).alias("confidence")]
    return grouped.select(*by, "first.idx", *[fields.get(c, F.col(f"first.{c}")) for c in carried], joined.alias("location"), *levels, "merged")


def rank_items(items: DataFrame, by: tuple[str, ...] = ("task_id", "code")) -> DataFrame:
    return items.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*priority())))


def limit_items(ranked: DataFrame, limit: Column | int = V.ISSUE_LIMIT, by: tuple[str, ...] = ("task_id", "code")) -> DataFrame:
    """The best items of each result: ``limit`` of them, but never more than the report shows at most (see ``issue_limit``)."""
    bound = F.lit(limit) if isinstance(limit, int) else limit
    return ranked.filter(F.col("rank") <= V.issue_limit(bound))


def limit_note(deduplicated: DataFrame, limit: int = V.ISSUE_LIMIT, by: tuple[str, ...] = ("task_id", "code")) -> DataFrame:
    """What merging and limiting left out, for the results where they did."""
    kept = F.count(F.lit(1))
    note = deduplicated.groupBy(*by).agg(F.sum("merged").alias("original_count"), kept.alias("deduplicated_count"))
    note = note.withColumn("duplicate_count", F.col("original_count") - F.col("deduplicated_count")).withColumn("displayed_count", F.least("deduplicated_count", V.issue_limit(F.lit(limit)).cast("long")))
    note = note.withColumn("omitted_count", F.col("deduplicated_count") - F.col("displayed_count"))
    return note.filter("duplicate_count > 0 or omitted_count > 0")


def suppress(items: DataFrame, rules: DataFrame) -> DataFrame:
    """``items`` with the best enabled rule of their task type and check, if it is similar enough (ties: smaller id).

    Items and rules meet by equality on (task_type, code); a hot pair is split by adaptive execution. Rules are a list kept by
    people, so what meets grows with the distinct texts; pairs that cannot be similar enough go before a score is computed."""
    active = rules.filter("enabled").select("task_type", F.col("check_code").alias("code"), F.col("id").alias("rule_id"), F.col("description").alias("rule_description"))
    said = X.collapse(F.coalesce(F.nullif(F.col("description"), F.lit("")), F.col("text")))
    texts = items.select("task_type", "code", said.alias("_said")).distinct()
    near_enough = texts.join(active, ["task_type", "code"]).filter(S.similarity_bound(F.col("_said"), F.col("rule_description")) >= S.THRESHOLD)
    scored = near_enough.withColumn("score", S.similarity(F.col("_said"), F.col("rule_description")))
    best = scored.groupBy("task_type", "code", "_said").agg(F.max_by(F.struct("rule_id", "score"), F.struct(F.col("score"), -F.col("rule_id"))).alias("hit"))
    near = best.filter(F.col("hit.score") >= S.THRESHOLD).select("task_type", "code", "_said", F.col("hit.rule_id").alias("rule_id"), F.col("hit.score").alias("similarity"))
    return items.withColumn("_said", said).join(near, ["task_type", "code", "_said"], "left").drop("_said")


def record_hits(rules: DataFrame, recorded: DataFrame, suppressed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rules, recorded hits) after a report: each (rule, task, check, item) is recorded once, however often the report is
    made, and a rule's ``hit_count`` grows by what was new. ``suppressed`` are items with a rule_id, ``recorded`` has rule_id,
    task_id, code, item_id; repeated rows of either are one."""
    key = ["rule_id", "task_id", "code", "item_id"]
    found = suppressed.filter("rule_id is not null").select("rule_id", "task_id", "code", F.col("id").alias("item_id")).distinct()
    same = [F.col(f"n.{k}").eqNullSafe(F.col(f"o.{k}")) for k in key]
    new = found.alias("n").join(recorded.select(*key).distinct().alias("o"), same, "left_anti")
    more = new.groupBy(F.col("rule_id").alias("id")).agg(F.count(F.lit(1)).alias("_new"))
    counted = rules.join(more, "id", "left").withColumn("hit_count", F.coalesce("hit_count", F.lit(0)) + F.coalesce("_new", F.lit(0))).drop("_new")
    return counted.select(rules.columns), recorded.select(*key).distinct().unionByName(new)


def rule_list(rules: DataFrame, checks: DataFrame) -> DataFrame:
    """The rules with the names of their checks (a rule whose check is gone stays, without one): those to decide on first,
    then the newest."""
    named = checks.groupBy(F.col("code").alias("check_code")).agg(F.min("name").alias("check_name"))
    return rules.join(named, "check_code", "left").orderBy(F.asc("enabled"), F.desc("updated_at"), F.desc("id"))


def changed_rules(rules: DataFrame, changes: DataFrame) -> DataFrame:
    """(seq, id, action) onto rules: of the changes of a rule the last counts: enable, disable (both set ``updated_at`` to
    its ``at``) or delete. Others change nothing."""
    last = changes.filter(F.col("action").isin("enable", "disable", "delete")).groupBy("id").agg(F.max_by(F.struct("action", "at"), "seq").alias("_last"), F.bool_or(F.col("action") == "delete").alias("_gone"))
    out = rules.join(last, "id", "left").filter(~F.coalesce("_gone", F.lit(False)))
    changed = F.col("_last").isNotNull()
    return out.withColumns({"enabled": F.when(changed, F.col("_last.action") == "enable").otherwise(F.col("enabled")), "updated_at": F.when(changed, F.col("_last.at")).otherwise(F.col("updated_at"))}).select(rules.columns)


def overlay_reviews(items: DataFrame, reviews: DataFrame) -> DataFrame:
    """Saved type and acceptance by (task, code, item id); a re-typed item keeps its rank."""
    saved = reviews.select("task_id", "code", F.col("item_id").alias("id"), "item_type", "acceptance", "rejection_reason")
    out = items.join(saved, ["task_id", "code", "id"], "left")
    return out.withColumn("type", F.coalesce("item_type", "type")).withColumn("acceptance", F.coalesce("acceptance", F.lit("pending"))).drop("item_type")


def latest_reviews(events: DataFrame) -> DataFrame:
    """The last valid review of each item. A rejection needs a reason, the reason ``other`` a note; ``pending`` takes the
    review back."""
    valid = (F.col("acceptance") != "rejected") | (F.col("rejection_reason").isNotNull() & ((F.col("rejection_reason") != "other") | (F.trim(X.text_of(F.col("rejection_note"))) != "")))
    last = Window.partitionBy("task_id", "code", "item_id").orderBy(F.col("seq").desc())
    return events.filter(valid).withColumn("_n", F.row_number().over(last)).filter("_n = 1 and acceptance <> 'pending'").drop("_n")


def counts(items: DataFrame, by: tuple[str, ...] = ("task_id", "code"), suppressed: DataFrame | None = None) -> DataFrame:
    """Items by type and acceptance, and with ``suppressed`` (the items that rules took out) how many of those there are, also
    where nothing else is left. Rates come from sums, never from other rates."""
    issue = F.col("type") == "issue"
    if suppressed is not None:
        shown = counts(items, by)
        gone = suppressed.groupBy(*by).agg(F.count(F.lit(1)).alias("suppressed"))
        both = shown.join(gone, list(by), "full")
        return both.select(*by, *[F.coalesce(c, F.lit(0)).alias(c) for c in [*shown.columns[len(by) :], "suppressed"]])
    return items.groupBy(*by).agg(
        *[F.count_if(F.col("type") == t).alias(t) for t in TYPES],
        F.count_if(issue & (F.col("acceptance") == "accepted")).alias("accepted_issue"),
        F.count_if(issue & (F.col("acceptance") == "rejected")).alias("rejected_issue"),
        F.count_if(issue & ~F.col("acceptance").isin("accepted", "rejected")).alias("pending_issue_acceptance"),
    )


def with_rates(totals: DataFrame) -> DataFrame:
    total = F.col("issue") + F.col("suggestion") + F.col("non_issue")
    return totals.withColumn("total", total).withColumn("issue_detection_rate", V.percent_label(F.col("issue"), total)).withColumn("issue_acceptance_rate", V.percent_label(F.col("accepted_issue"), F.col("accepted_issue") + F.col("rejected_issue")))


def rule_candidates(items: DataFrame) -> DataFrame:
    """Reviewed items that suggest a suppression rule: non-issues rejected for a reason that speaks against the model.
    Rules start disabled; of equal fingerprints the earliest counts."""
    found = items.filter((F.col("type") == "non_issue") & (F.col("acceptance") == "rejected") & F.col("rejection_reason").isin(*SUPPRESSING_REASONS))
    said = X.collapse(F.coalesce(F.nullif(F.col("description"), F.lit("")), F.col("text")))
    found = found.withColumn("said", said).filter("said <> ''").withColumn("fingerprint", V.rule_fingerprint(F.col("task_type"), F.col("code"), F.col("said")))
    first = Window.partitionBy("task_type", "code", "fingerprint").orderBy("task_id", "idx")
    return found.withColumn("_n", F.row_number().over(first)).filter("_n = 1").select("task_type", F.col("code").alias("check_code"), "fingerprint", F.col("said").alias("description"), F.col("rejection_reason").alias("reason"), F.lit(False).alias("enabled"))
