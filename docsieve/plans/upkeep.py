"""Registered queries of migrations, list reports, suppression hits, counts and small reads, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docsieve.functions import values as V
from docsieve.functions.markup import html_text
from docsieve.operators import operations as O
from docsieve.operators import report as R
from docsieve.operators import terms as T
from docsieve.operators import upkeep as U
from docsieve.plans import twins
from docsieve.plans.catalogue import ITEMS_SQL, TASKS_SQL, query
from docsieve.sources.tables import items, read, tasks

# ---------------------------------------------------------------- pages


@query(r"""WITH a AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>', chr(1), 'g'), '(?is)<style[^>]*>.*?</style>', chr(1), 'g'), '(?is)<noscript[^>]*>.*?</noscript>', chr(1), 'g'), '(?s)<!--.*?-->', chr(1), 'g') AS h FROM pages),
    b AS (SELECT page_id, list_transform(string_split_regex(h, '<[^>]*>|\x01'), lambda x: trim(replace(replace(replace(replace(x, '&copy;', '©'), '&middot;', '·'), '&quot;', '"'), '&amp;', '&'), ' ' || chr(9) || chr(10) || chr(13))) AS l FROM a)
    SELECT page_id, array_to_string(list_filter(l, lambda x: x <> ''), chr(10)) AS text FROM b""")
def op_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").select("page_id", html_text(F.col("html")).alias("text"))


SCOPED = [T.CommonRule("einen", ("eine", "der"), "latin"), T.CommonRule("Was", ("that",)), T.CommonRule("THE", (), "zh"), T.CommonRule("Con", ("con",), "zh"), T.CommonRule("Les", ("les",), "latin")]


@query(f"WITH {twins.LANGUAGES} SELECT doc_id, language, CAST(1 + CASE language WHEN 'latin' THEN 2 WHEN 'zh' THEN 2 ELSE 0 END AS BIGINT) AS applied, CAST(4 - CASE language WHEN 'latin' THEN 2 WHEN 'zh' THEN 2 ELSE 0 END AS BIGINT) AS skipped FROM languages")
def op_rule_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rules of several language scopes apply to each document, and how many are skipped."""
    return T.rule_scopes(read(spark, sf_dir, "documents"), SCOPED)


@query(f"""WITH {twins.LANGUAGES}, r(term, standard, scope) AS (VALUES ('eine', 'einen', 'latin'), ('der', 'einen', 'latin'), ('that', 'Was', 'all'), ('con', 'Con', 'zh'), ('les', 'Les', 'latin')),
    d AS (SELECT doc_id, documents.text, language FROM documents JOIN languages USING (doc_id)) SELECT doc_id, standard, term AS observed, CAST(len(regexp_extract_all(text, '\\b' || term || '\\b')) AS BIGINT) AS hits
    FROM d, r WHERE (scope = 'all' OR scope = language) AND regexp_matches(text, '\\b' || term || '\\b')""")
def op_scoped_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Discouraged terms of rules that apply to a document's language."""
    found = T.term_candidates(read(spark, sf_dir, "documents"), SCOPED).filter("kind = 'discouraged'")
    return found.groupBy("doc_id", "standard", "observed").agg(F.count(F.lit(1)).alias("hits"))


# ---------------------------------------------------------------- migrations


@query(f"""WITH {TASKS_SQL} SELECT task_id, CASE WHEN task_id % 3 = 0 THEN owner ELSE 'ip:10.0.0.' || CAST(task_id % 200 AS VARCHAR) END AS owner_subject, CASE WHEN task_id % 2 = 0 THEN 'n' || CAST(task_id AS VARCHAR) END AS owner_name,
    CASE WHEN task_id % 3 = 0 THEN 'sso' ELSE 'ip' END AS owner_source, CASE WHEN status NOT IN ('completed') THEN 'key' END AS api_key FROM tasks""")
def op_migrated_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Old tasks migrated twice; a step that was done before, and would empty the table, is not run."""
    t = tasks(spark, sf_dir)
    third = F.col("task_id") % 3 == 0
    old = t.select(
        "task_id", "status", F.concat(F.lit("10.0.0."), (F.col("task_id") % 200).cast("string")).alias("ip"), F.when(F.col("task_id") % 2 == 0, F.concat(F.lit("n"), F.col("task_id").cast("string"))).alias("username"),
        F.when(third, F.col("owner")).when(F.col("task_id") % 3 == 1, "").alias("owner_subject"), F.lit("").alias("owner_name"), F.when(third, "sso").alias("owner_source"), F.lit("key").alias("api_key"),
    )
    old = old.withColumn("owner_name", F.nullif("owner_name", F.lit("")))
    steps = [
        U.Step("empty", lambda x: {"tasks": x["tasks"].limit(0)}),
        U.Step("owners", lambda x: {"tasks": U.fill_owners(x["tasks"])}),
        U.Step("keys", lambda x: {"tasks": U.without_finished_keys(x["tasks"])}, always=True),
    ]
    once, done = U.migrate({"tasks": old}, spark.createDataFrame([("empty",)], "name string"), steps)
    twice, _ = U.migrate(once, done, steps)
    return twice["tasks"].select("task_id", "owner_subject", "owner_name", "owner_source", "api_key")


MODELS_SQL = "m AS (SELECT p_size AS provider_id, p_brand AS model_name, p_partkey % 3 = 0 AS off, p_partkey AS id FROM part)"


@query(f"""WITH {MODELS_SQL}, plain AS (SELECT DISTINCT provider_id, model_name FROM m WHERE NOT off)
    SELECT id, provider_id, model_name, FALSE AS force_disable_thinking, CASE WHEN off THEN 'now' ELSE 'then' END AS updated_at FROM m WHERE NOT off OR (provider_id, model_name) NOT IN (SELECT (provider_id, model_name) FROM plain)""")
def op_migrated_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").alias("provider_id"), F.col("p_brand").alias("model_name"), (F.col("p_partkey") % 3 == 0).alias("force_disable_thinking"), F.lit("then").alias("updated_at"))
    steps = [U.Step("thinking", lambda x: {"models": U.one_thinking_flag(x["models"], F.lit("now"))})]
    out, done = U.migrate({"models": p}, spark.createDataFrame([], "name string"), steps)
    later = {"models": out["models"].withColumn("force_disable_thinking", F.col("force_disable_thinking"))}
    return U.migrate(later, done, steps)[0]["models"]


@query("""SELECT c_custkey AS id, 'k' || CAST(c_nationkey AS VARCHAR) AS code, CASE WHEN c_custkey % 4 IN (0, 1) AND c_nationkey < 20 THEN n_name ELSE 'mine' END AS name, CASE c_custkey % 4 WHEN 0 THEN 'check all of ' || n_name WHEN 1 THEN CASE WHEN c_nationkey < 20 THEN 'check all of ' || n_name ELSE 'old rule: check' END
    WHEN 2 THEN 'old check' ELSE 'own words' END AS prompt, CASE WHEN c_custkey % 4 IN (0, 1) AND c_nationkey < 20 THEN c_nationkey * 10 ELSE 5 END AS sort_order, CASE WHEN c_custkey % 4 IN (0, 1) AND c_nationkey < 20 THEN 'now' ELSE 'then' END AS updated_at
    FROM customer JOIN nation ON n_nationkey = c_nationkey""")
def op_migrated_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checks with today's default prompt, a stock one of before, half of one, or one of their own; five codes have no default."""
    n = read(spark, sf_dir, "nation")
    code = lambda c: F.concat(F.lit("k"), F.col(c).cast("string")).alias("code")
    said = F.concat(F.lit("check all of "), F.col("n_name"))
    defaults = n.filter("n_nationkey < 20").select(code("n_nationkey"), F.col("n_name").alias("name"), F.lit("").alias("description"), said.alias("prompt"), (F.col("n_nationkey") * 10).alias("sort_order"))
    markers = n.select(code("n_nationkey"), F.explode(F.array(F.struct(F.lit(1).alias("set"), F.lit("old rule").alias("marker")), F.struct(F.lit(1).alias("set"), F.lit("check").alias("marker")), F.struct(F.lit(2).alias("set"), F.lit("nowhere").alias("marker")))).alias("m")).select("code", "m.*")
    k = F.col("c_custkey") % 4
    prompt = F.when(k == 0, said).when(k == 1, "old rule: check").when(k == 2, "old check").otherwise("own words")
    checks = read(spark, sf_dir, "customer").join(n, F.col("n_nationkey") == F.col("c_nationkey")).select(F.col("c_custkey").alias("id"), code("c_nationkey"), F.lit("mine").alias("name"), F.lit("").alias("description"), prompt.alias("prompt"), F.lit(5).alias("sort_order"), F.lit("then").alias("updated_at"))
    once = U.refreshed_prompts(checks, defaults, markers, F.lit("now"))
    return U.refreshed_prompts(once, defaults, markers, F.lit("later")).drop("description")


# ---------------------------------------------------------------- reports about lists, as text

_COMMON = U.LISTS["common"]


def _line_ends(text: str) -> str:
    return "'" + text.replace("\n", "' || chr(10) || '") + "'"


@query(f"""WITH t AS (SELECT o_orderkey AS task_id, o_orderkey % 4 AS k FROM orders WHERE o_orderkey % 4 < 3), r AS (SELECT task_id, k, CASE k WHEN 0 THEN '{_COMMON["missing"][4]}' ELSE {_line_ends(_COMMON["invalid"][4])} || 'list' || CAST(task_id % 5 AS VARCHAR) END AS summary,
    CASE k WHEN 0 THEN '{_COMMON["missing"][0]}' ELSE '{_COMMON["invalid"][0]}' END AS category, CASE k WHEN 0 THEN '本地词表文件' ELSE 'list' || CAST(task_id % 5 AS VARCHAR) END AS location,
    CASE k WHEN 0 THEN '{_COMMON["missing"][1]}' WHEN 1 THEN 'bad "header" of ' || CAST(task_id AS VARCHAR) ELSE '{_COMMON["empty"]}' END AS description, CASE k WHEN 0 THEN '{_COMMON["missing"][2]}' ELSE '{_COMMON["invalid"][2]}' END AS impact,
    CASE k WHEN 0 THEN {_line_ends(_COMMON["missing"][3])} || '- list' || CAST(task_id % 5 AS VARCHAR) || chr(10) || '- other' ELSE '{_COMMON["invalid"][3]}' END AS suggestion FROM t)
    SELECT task_id, '{{' || chr(10) || '  "summary": ' || CAST(to_json(summary) AS VARCHAR) || ',' || chr(10) || '  "items": [' || chr(10) || '    {{' || chr(10) || '      "category": ' || CAST(to_json(category) AS VARCHAR) || ',' || chr(10) || '      "location": ' || CAST(to_json(location) AS VARCHAR) || ',' || chr(10)
        || '      "excerpt": "",' || chr(10) || '      "description": ' || CAST(to_json(description) AS VARCHAR) || ',' || chr(10) || '      "impact": ' || CAST(to_json(impact) AS VARCHAR) || ',' || chr(10) || '      "suggestion": ' || CAST(to_json(suggestion) AS VARCHAR) || ',' || chr(10) || '      "type": "suggestion"' || chr(10)
        || '    }}' || chr(10) || '  ]' || chr(10) || '}}' AS body FROM r""")
def op_list_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tasks whose list is missing, cannot be read, is empty, or is in order, as report texts."""
    k = F.col("task_id") % 4
    t = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("task_id"))
    rules = F.when(k == 2, 0).when(k == 3, 7)
    error = F.when(k == 1, F.concat(F.lit('bad "header" of '), F.col("task_id").cast("string")))
    found = U.list_report(t, "common", rules, F.array(F.concat(F.lit("list"), (F.col("task_id") % 5).cast("string")), F.lit("other")), error)
    return U.report_json(found.select("task_id", "summary", F.array(F.struct(*U.REPORT_FIELDS)).alias("items")))


# ---------------------------------------------------------------- suppression and counts


@query("""WITH s AS (SELECT DISTINCT l_suppkey % 20 AS rule_id, l_orderkey AS task_id, 'c' || CAST(l_linenumber % 2 AS VARCHAR) AS code, CAST(l_linenumber AS VARCHAR) AS item_id FROM lineitem WHERE l_returnflag = 'R')
    SELECT n_nationkey AS id, CAST(n_regionkey AS BIGINT) + count(s.task_id) FILTER (s.task_id % 2 = 1) AS hit_count, (SELECT CAST(count(*) AS BIGINT) FROM s) AS recorded FROM nation LEFT JOIN s ON rule_id = n_nationkey GROUP BY n_nationkey, n_regionkey""")
def op_suppression_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same suppressed items reported twice, half of them recorded before: each hit counts once."""
    li = read(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'")
    found = li.select((F.col("l_suppkey") % 20).alias("rule_id"), F.col("l_orderkey").alias("task_id"), F.concat(F.lit("c"), (F.col("l_linenumber") % 2).cast("string")).alias("code"), F.col("l_linenumber").cast("string").alias("id"))
    rules = read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_regionkey").cast("long").alias("hit_count"))
    before = found.filter("task_id % 2 = 0").select("rule_id", "task_id", "code", F.col("id").alias("item_id"))
    first, recorded = R.record_hits(rules, before, found)
    second, recorded = R.record_hits(first, recorded, found)
    return second.crossJoin(recorded.agg(F.count(F.lit(1)).alias("recorded")))  # one row on the right


@query(f"""WITH {ITEMS_SQL}, k AS (SELECT task_id, code, type, CASE idx % 3 WHEN 0 THEN acceptance ELSE NULL END AS acceptance, idx % 7 = 0 AS gone FROM items),
    s AS (SELECT task_id, code, count(*) FILTER (NOT gone AND type = 'issue') AS issue, count(*) FILTER (NOT gone AND type = 'suggestion') AS suggestion, count(*) FILTER (NOT gone AND type = 'non_issue') AS non_issue, count(*) FILTER (NOT gone AND type = 'issue' AND acceptance = 'accepted') AS accepted_issue,
        count(*) FILTER (NOT gone AND type = 'issue' AND acceptance = 'rejected') AS rejected_issue, count(*) FILTER (NOT gone AND type = 'issue' AND acceptance IS NULL) AS pending_issue_acceptance, count(*) FILTER (gone) AS suppressed FROM k GROUP BY ALL) SELECT * FROM s""")
def op_all_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of accepted, rejected, pending and suppressed items; results whose items are all suppressed stay."""
    it = items(spark, sf_dir).withColumn("acceptance", F.when(F.col("idx") % 3 == 0, F.col("acceptance")).otherwise("pending"))
    return R.counts(it.filter("idx % 7 <> 0"), suppressed=it.filter("idx % 7 = 0"))


@query("""WITH lc AS (SELECT event_id % 40 AS id, arg_max(CASE event_type WHEN 'view' THEN TRUE ELSE FALSE END, event_id) AS enabled, max(event_id) AS at_seq FROM events WHERE event_type IN ('view', 'click') GROUP BY 1),
    g AS (SELECT DISTINCT event_id % 40 AS id FROM events WHERE event_type = 'error' AND event_id % 5 = 0 AND event_id % 40 < 10)
    SELECT n_nationkey AS id, 'c' || CAST(n_regionkey AS VARCHAR) AS check_code, CASE WHEN n_regionkey < 3 THEN 'check ' || CAST(n_regionkey AS VARCHAR) END AS check_name, coalesce(lc.enabled, n_nationkey % 2 = 0) AS enabled, coalesce(lc.at_seq, 0) AS updated_at
    FROM nation LEFT JOIN lc ON lc.id = n_nationkey WHERE n_nationkey NOT IN (SELECT id FROM g)""")
def op_rule_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules after a log of changes, with the names of their checks (two checks are gone)."""
    n = read(spark, sf_dir, "nation")
    rules = n.select(F.col("n_nationkey").cast("long").alias("id"), F.concat(F.lit("c"), F.col("n_regionkey").cast("string")).alias("check_code"), (F.col("n_nationkey") % 2 == 0).alias("enabled"), F.lit(0).cast("long").alias("updated_at"))
    kind, e = F.col("event_type"), read(spark, sf_dir, "events")
    gone = (kind == "error") & (F.col("event_id") % 5 == 0) & (F.col("event_id") % 40 < 10)
    changes = e.select(F.col("event_id").alias("seq"), (F.col("event_id") % 40).alias("id"), F.when(kind == "view", "enable").when(kind == "click", "disable").when(gone, "delete").otherwise("look").alias("action"), F.col("event_id").alias("at"))
    checks = read(spark, sf_dir, "region").filter("r_regionkey < 3").select(F.concat(F.lit("c"), F.col("r_regionkey").cast("string")).alias("code"), F.concat(F.lit("check "), F.col("r_regionkey").cast("string")).alias("name"))
    return R.rule_list(R.changed_rules(rules, changes), checks).select("id", "check_code", "check_name", "enabled", "updated_at")


# ---------------------------------------------------------------- reads around tasks

_TYPES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "none")
_OWNED_SQL = f"{TASKS_SQL}, o AS (SELECT *, CASE WHEN task_id % 4 <> 0 THEN owner END AS own, '10.0.0.' || CAST(task_id % 9 AS VARCHAR) AS ip, 'name' || CAST(task_id % 3 AS VARCHAR) AS username FROM tasks), s AS (SELECT *, coalesce(own, 'ip:' || ip) AS subject FROM o)"


def _owned(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tasks(spark, sf_dir)
    k = F.col("task_id")
    return t.withColumns({"owner": F.when(k % 4 != 0, F.col("owner")), "ip": F.concat(F.lit("10.0.0."), (k % 9).cast("string")), "username": F.concat(F.lit("name"), (k % 3).cast("string"))})


@query(f"""WITH {_OWNED_SQL} SELECT subject, min(ip) AS ip, max(username) AS username, CAST(count(*) AS BIGINT) AS tasks, {", ".join(f"CAST(count(*) FILTER (task_type = '{t}') AS BIGINT) AS type_{k}" for k, t in enumerate(_TYPES))}, max(created_at) AS last_task_at
    FROM s WHERE created_at >= TIMESTAMP '1992-02-01' AND created_at < TIMESTAMP '2030-01-02' GROUP BY subject ORDER BY tasks DESC, last_task_at DESC, subject LIMIT 10""")
def op_owner_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return U.owner_overview(_owned(spark, sf_dir), _TYPES, F.lit("2030-01-01").cast("date"), F.lit("1992-02-01").cast("date"))


@query(f"""WITH {_OWNED_SQL}, t(task_type) AS (VALUES {", ".join(f"('{t}')" for t in _TYPES)}) SELECT task_type, CAST(count(subject) AS BIGINT) AS tasks, CAST(count(*) FILTER (status = 'queued') AS BIGINT) AS queued, CAST(count(*) FILTER (status = 'running') AS BIGINT) AS running,
    CAST(count(*) FILTER (status = 'completed') AS BIGINT) AS completed, CAST(count(DISTINCT subject) AS BIGINT) AS users FROM t LEFT JOIN s USING (task_type) GROUP BY task_type""")
def op_type_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return U.type_totals(_owned(spark, sf_dir), _TYPES, ("queued", "running", "completed"))


@query(f"WITH {_OWNED_SQL} SELECT task_id, subject FROM s WHERE instr(subject, 'ip:10') = 1")
def op_mode_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return U.of_mode(_owned(spark, sf_dir), "ip:10").select("task_id", O.effective_owner(F.col("owner"), F.col("ip")).alias("subject"))


@query("""WITH t AS (SELECT o_custkey AS owner, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE CAST(o_orderkey % 10 AS VARCHAR) END AS token FROM orders)
    SELECT event_id, user_id AS owner, CAST(event_id % 10 AS VARCHAR) AS submission_token FROM events WHERE event_id % 5 <> 0 AND EXISTS (SELECT 1 FROM t WHERE t.owner = user_id AND t.token = CAST(event_id % 10 AS VARCHAR))""")
def op_submitted_before(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("owner"), F.when(F.col("o_orderkey") % 3 == 0, "").otherwise((F.col("o_orderkey") % 10).cast("string")).alias("submission_token"))
    e = read(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("owner"), F.when(F.col("event_id") % 5 == 0, "").otherwise((F.col("event_id") % 10).cast("string")).alias("submission_token"))
    return U.submitted(t, e).select("event_id", "owner", "submission_token")


@query(f"""WITH {TASKS_SQL}, f AS (SELECT l_orderkey AS task_id, count(*) AS file_count, sum(l_partkey) AS size_bytes FROM lineitem GROUP BY 1)
    SELECT task_id, CASE WHEN task_id % 2 = 0 THEN created_at + INTERVAL 1 DAY ELSE created_at END AS finished_at, CAST(size_bytes AS BIGINT) AS size_bytes, file_count FROM tasks JOIN f USING (task_id) WHERE status = 'completed' AND task_id % 5 <> 0""")
def op_file_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("task_id")
    t = tasks(spark, sf_dir).withColumns({"finished_at": F.when(k % 2 == 0, F.col("created_at") + F.expr("INTERVAL 1 DAY")), "updated_at": F.lit(None).cast("timestamp"), "cleaned_at": F.when(k % 5 == 0, F.col("created_at"))})
    files = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("task_id"), F.col("l_partkey").alias("bytes"))
    return U.file_cache(t, files)


@query("""SELECT o_orderkey AS task_id, CASE o_orderkey % 4 WHEN 0 THEN '文档:1,b ' || CAST(o_custkey AS VARCHAR) || ':2' WHEN 1 THEN '' WHEN 2 THEN '' ELSE '文档:1' END AS groups FROM orders""")
def op_document_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata texts: two groups, not JSON, a list, and groups of which only one has a file."""
    k = F.col("o_orderkey") % 4
    meta = (
        F.when(k == 0, F.concat(F.lit('{"groups":[{"files":[{"f":1}]},{"role":"r","label":"b '), F.col("o_custkey").cast("string"), F.lit('","files":[{"f":1},{"f":2},"x"]}]}')))
        .when(k == 1, F.concat(F.lit('{"groups":['), F.col("o_custkey").cast("string")))
        .when(k == 2, "[1]")
        .otherwise(F.lit('{"groups":[5,{"files":[]},{"files":"x"},{"label":"","files":[{}]},null]}'))
    )
    groups = F.transform(U.document_groups(meta), lambda g: F.concat(g["label"], F.lit(":"), F.size(g["files"]).cast("string")))
    return read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("task_id"), F.array_join(groups, ",").alias("groups"))


@query(r"""SELECT doc_id, sha256(regexp_replace(regexp_replace(replace('**' || replace(replace(text, '. ', ' ** **'), chr(10), chr(13)), chr(13) || chr(10), chr(10)), '\r\n?', chr(10), 'g'), '\*\*([^*\n]*?\S)[ \t]+\*\*', '**\1**', 'g')) AS tidy,
    CASE WHEN len(regexp_extract_all(text, '[0-9]{3,}')) > 0 THEN array_to_string(regexp_extract_all(text, '[0-9]{3,}'), '、') ELSE '未发现' END AS numbers FROM documents""")
def op_tidy_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = F.concat(F.lit("**"), F.replace(F.replace("text", F.lit(". "), F.lit(" ** **")), F.lit("\n"), F.lit("\r")))
    return read(spark, sf_dir, "documents").select("doc_id", F.sha2(U.tidy_markdown(marked), 256).alias("tidy"), U.preview(F.regexp_extract_all("text", F.lit("[0-9]{3,}"), 0)).alias("numbers"))


@query("""SELECT l_orderkey AS task_id, l_linenumber AS n, l_partkey AS p, CAST(5 + floor(l_linenumber / greatest(l_suppkey % 8, 1) * 85) AS INT) AS progress, CAST(greatest(l_suppkey % 40, 10 + floor(80 * least(1.0, l_quantity * 5 / least(greatest(l_suppkey * 20, 60), 300)))) AS INT) AS ramp,
    CAST(least(greatest(l_linenumber - 2, 1), greatest(1, ceil(l_quantity / 20))) AS BIGINT) AS page FROM lineitem""")
def op_progress_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, s, q = F.col("l_linenumber"), F.col("l_suppkey"), F.col("l_quantity")
    return read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("task_id"), n.alias("n"), F.col("l_partkey").alias("p"), V.progress(n, s % 8).alias("progress"), V.progress_ramp(F.lit(10), F.lit(90), q * 5, s * 20, s % 40).alias("ramp"), V.bounded_page(n - 2, q, 20).alias("page"))
