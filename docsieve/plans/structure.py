"""Registered queries of ordered lookups, rule files, batches, check registries, groups and composed texts, with SQL twins."""

from __future__ import annotations

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docsieve.functions import answers as A
from docsieve.operators import composed as CO
from docsieve.operators import lifecycle as L
from docsieve.operators import operations as O
from docsieve.operators import ordered as OR
from docsieve.operators import registry as RG
from docsieve.operators import report as R
from docsieve.operators import term_tables as TT
from docsieve.plans.catalogue import SENSITIVE, TASKS_SQL, query
from docsieve.sources import batch_insert as BI
from docsieve.sources.scratch import shared_folder
from docsieve.sources.tables import read, tasks
from docsieve.sources.term_files import ENCODINGS, read_rules, write_term_cells

# ---------------------------------------------------------------- ordered lookups


def _marked_sql(kind: str, pattern: str) -> str:
    """Place and label of each match of a pattern, from the pieces between the matches."""
    return f"""{kind}_cut AS (SELECT doc_id, string_split_regex(text, '{pattern}') AS pieces, regexp_extract_all(text, '{pattern}', 0) AS fulls, regexp_extract_all(text, '{pattern}', 1) AS labels FROM marked),
    {kind}_rows AS (SELECT doc_id, unnest(range(1, len(fulls) + 1)) AS k, unnest(pieces[:len(fulls)]) AS piece, unnest(fulls) AS hit, unnest(labels) AS label FROM {kind}_cut),
    {kind}s AS (SELECT doc_id, label, sum(length(piece) + length(hit)) OVER (PARTITION BY doc_id ORDER BY k) - length(hit) AS pos FROM {kind}_rows)"""


@query(rf"""WITH marked AS (SELECT doc_id, regexp_replace(regexp_replace(text, '(\d+)', '[第\1页]', 'g'), '\n(\S+)', chr(10) || '# 工作表：\1' || chr(10) || '\1', 'g') AS text FROM documents),
    {_marked_sql("page", r"\[第(\d+)页\]")}, {_marked_sql("sheet", r"(?m)^#\s*工作表：(.+?)\s*$")},
    terms(term) AS (VALUES ('worthless'), ('trash'), ('disgusting'), ('the'), ('und'), ('ción')),
    hit_cut AS (SELECT doc_id, term, string_split(text, term) AS pieces FROM marked, terms WHERE contains(text, term)),
    hit_rows AS (SELECT doc_id, term, unnest(range(1, len(pieces))) AS k, unnest(pieces[:len(pieces) - 1]) AS piece FROM hit_cut),
    hits AS (SELECT doc_id, term, sum(length(piece)) OVER (PARTITION BY doc_id, term ORDER BY k) + (k - 1) * length(term) AS pos FROM hit_rows),
    paged AS (SELECT h.*, p.label AS page FROM hits h ASOF LEFT JOIN pages p ON h.doc_id = p.doc_id AND h.pos >= p.pos)
    SELECT h.doc_id, h.term, CAST(h.pos AS BIGINT) AS pos, h.page, s.label AS sheet FROM paged h ASOF LEFT JOIN sheets s ON h.doc_id = s.doc_id AND h.pos >= s.pos""")
def op_marker_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every hit of the sensitive terms with the last page and sheet marker before it; numbers are the pages of a text and the
    first words of its lines the sheets."""
    text = F.regexp_replace(F.regexp_replace("text", r"(\d+)", "[第$1页]"), r"\n(\S+)", "\n# 工作表：$1\n$1")
    docs = read(spark, sf_dir, "documents").select("doc_id", text.alias("text"))
    hits = OR.hit_rows(docs, [r.invalid for r in SENSITIVE])
    return OR.marked_hits(hits, OR.marker_rows(docs), width=2_000)


@query("""WITH e AS (SELECT event_id, user_id, event_type, value FROM events)
    SELECT p.event_id, p.user_id, v.value AS seen, v.event_id AS seen_at FROM (SELECT * FROM e WHERE event_type = 'purchase') p
    ASOF LEFT JOIN (SELECT * FROM e WHERE event_type = 'view') v ON p.user_id = v.user_id AND p.event_id >= v.event_id""")
def op_asof_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each purchase with the user's last view before it."""
    e = read(spark, sf_dir, "events")
    views = e.filter("event_type = 'view'").select("event_id", "user_id", F.col("value").alias("seen"), F.col("event_id").alias("seen_at"))
    return OR.asof(e.filter("event_type = 'purchase'").select("event_id", "user_id"), views, ["user_id"], "event_id", ["seen", "seen_at"], width=1_000)


BLOCK = "(?s)<(?:h[1-6]|p)(?:\\s[^<>]*)?>.*?</(?:h[1-6]|p)>"


@query(f"""WITH b AS (SELECT page_id, unnest(regexp_extract_all(html, '{BLOCK}')) AS block, generate_subscripts(regexp_extract_all(html, '{BLOCK}'), 1) AS pos FROM pages),
    l AS (SELECT page_id, CAST(pos - 1 AS BIGINT) AS pos, TRY_CAST(regexp_extract(block, '^<h([1-6])', 1) AS INT) AS level, trim(regexp_replace(block, '<[^<>]*>', '', 'g')) AS said FROM b),
    h AS (SELECT *, {", ".join(f"max(CASE WHEN level = {k} THEN pos END) OVER w AS a{k}, last_value(CASE WHEN level = {k} THEN said END IGNORE NULLS) OVER w AS s{k}" for k in range(1, 7))}
        FROM l WINDOW w AS (PARTITION BY page_id ORDER BY pos ROWS UNBOUNDED PRECEDING))
    SELECT page_id, pos, array_to_string(list_filter([{", ".join(f"CASE WHEN a{k} > greatest({', '.join(['-1', *(f'coalesce(a{j}, -1)' for j in range(1, k))])}) THEN s{k} END" for k in range(1, 7))}], lambda x: x IS NOT NULL), ' > ') AS path FROM h""")
def op_heading_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The headings above each heading and paragraph of the pages."""
    pages = read(spark, sf_dir, "pages")
    blocks = pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(BLOCK), 0)).alias("at", "block"))
    level = F.regexp_extract("block", "^<h([1-6])", 1).try_cast("int")
    lines = blocks.select("page_id", F.col("at").cast("long").alias("at"), level.alias("level"), F.trim(F.regexp_replace("block", "<[^<>]*>", "")).alias("said"))
    return OR.heading_paths(lines, ["page_id"], "at", "level", "said", width=4).select("page_id", F.col("at").alias("pos"), F.array_join("path", " > ").alias("path"))


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
    n AS (SELECT *, row_number() OVER (PARTITION BY doc_id, line ORDER BY pos) AS n FROM l),
    a AS (SELECT doc_id AS pair, line, n, pos FROM n WHERE doc_id + 1 IN (SELECT doc_id FROM documents)), b AS (SELECT doc_id - 1 AS pair, line, n, pos FROM n WHERE doc_id - 1 IN (SELECT doc_id FROM documents)),
    j AS (SELECT pair, a.pos AS ra, b.pos AS rb FROM a FULL JOIN b USING (pair, line, n))
    SELECT pair, CAST(count(*) FILTER (ra IS NOT NULL AND rb IS NOT NULL) AS BIGINT) AS both_have, CAST(count(*) FILTER (rb IS NULL) AS BIGINT) AS only_a, CAST(count(*) FILTER (ra IS NULL) AS BIGINT) AS only_b,
        CAST(coalesce(sum(abs(ra - rb)), 0) AS BIGINT) AS moved FROM j GROUP BY pair""")
def op_line_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of each document beside those of the next one."""
    docs = read(spark, sf_dir, "documents")
    # a line goes by its digest of 16 bytes, and a document is told to have a neighbour before its lines are unfolded
    texts = docs.select("doc_id", F.transform(F.split("text", "\n"), lambda x: F.unhex(F.md5(x))).alias("lines"))
    ids = docs.select("doc_id").distinct()
    a = texts.join(ids.select((F.col("doc_id") - 1).alias("doc_id")), "doc_id", "left_semi").select(F.col("doc_id").alias("pair"), F.posexplode("lines").alias("at", "line"))
    b = texts.join(ids.select((F.col("doc_id") + 1).alias("doc_id")), "doc_id", "left_semi").select((F.col("doc_id") - 1).alias("pair"), F.posexplode("lines").alias("at", "line"))
    side = OR.aligned(a, b, ["pair"], "line", "at", width=50)
    both = F.col("at_a").isNotNull() & F.col("at_b").isNotNull()
    return side.groupBy("pair").agg(F.count_if(both).alias("both_have"), F.count_if(F.col("at_b").isNull()).alias("only_a"), F.count_if(F.col("at_a").isNull()).alias("only_b"), F.sum(F.when(both, F.abs(F.col("at_a") - F.col("at_b"))).otherwise(0)).cast("long").alias("moved"))


# ---------------------------------------------------------------- rule files and batches


@query("""SELECT 'T' || CAST(p_partkey % 50 AS VARCHAR) AS standard, CASE WHEN p_partkey % 50 % 3 = 0 THEN 'zh' ELSE 'all' END AS language_scope,
    CAST(count(DISTINCT lower(p_brand) || 'é') AS BIGINT) AS n_discouraged, sha256(string_agg(DISTINCT lower(p_brand) || 'é', ',' ORDER BY lower(p_brand) || 'é')) AS terms FROM part GROUP BY ALL""")
def op_term_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as CSV term lists in each of the encodings, read back as rules."""
    p = read(spark, sf_dir, "part")
    n = F.col("p_partkey") % 50
    cells = F.array(F.concat(F.lit("T"), n.cast("string")), F.concat(F.lower("p_brand"), F.lit("é、 "), F.lower("p_brand"), F.lit("é; n/a")), F.when(n % 3 == 0, "仅中文").otherwise("全部"))
    path = shared_folder(spark, "terms")
    for k, encoding in enumerate(ENCODINGS):
        write_term_cells(p.filter(F.col("p_partkey") % 3 == k).select(cells.alias("cells")), path, encoding, ["常用词 ", "常见错误/不推荐用法", "（适用语种）"])
    rules = read_rules(spark, path)
    return rules.select("standard", "language_scope", F.size("discouraged").cast("long").alias("n_discouraged"), F.sha2(F.array_join(F.array_sort("discouraged"), ","), 256).alias("terms"))


@query("""WITH r AS (SELECT DISTINCT regexp_extract(text, '[a-z]{4,}') AS invalid FROM benchmark), d AS (SELECT doc_id, text FROM documents)
    SELECT doc_id, invalid, upper(invalid) AS standard, CAST((length(text) - length(replace(text, invalid, ''))) / length(invalid) AS BIGINT) AS hits, CAST(instr(text, invalid) - 1 AS BIGINT) AS first_pos
    FROM d, r WHERE invalid <> '' AND contains(text, invalid)""")
def op_term_file_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms that were read from a file, in all documents: one pass for all of them, in chunks of 100 rules."""
    b = read(spark, sf_dir, "benchmark").select(F.regexp_extract("text", "[a-z]{4,}", 0).alias("t")).filter("t <> ''").distinct()
    path = shared_folder(spark, "terms")
    write_term_cells(b.select(F.array(F.upper("t"), F.col("t")).alias("cells")), path, "gb18030", ["规范写法", "错误用法"])
    rules = read_rules(spark, path).select(F.explode("discouraged").alias("invalid"), "standard")
    return TT.term_matches(read(spark, sf_dir, "documents"), rules, chunk=100).select("doc_id", "invalid", "standard", "hits", "first_pos")


@query(f"WITH {TASKS_SQL} SELECT status AS batch, CAST(count(*) AS BIGINT) AS n, CAST(sum(task_id) AS BIGINT) AS ids FROM tasks WHERE status <> 'running' GROUP BY status")
def op_batch_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tasks added by status: one batch twice, and one that is refused in the middle of its rows and leaves nothing."""
    t = tasks(spark, sf_dir).select("task_id", "owner", "status")
    path = shared_folder(spark, "tasks")
    for status in ("queued", "completed", "queued"):
        BI.insert_batch(t.filter(F.col("status") == status), path, status, ["task_id"], required=["owner"])
    broken = t.filter("status = 'running'").withColumn("owner", F.when(F.col("task_id") % 7 != 0, F.col("owner")))
    try:
        BI.insert_batch(broken, path, "running", ["task_id"], required=["owner"])
    except PySparkException as e:  # the caller of a refused batch goes on; what it left is read below
        if "column owner has no value" not in str(e):
            raise
    back = BI.read_batches(spark, path, t.schema)
    return back.groupBy(F.col("status").alias("batch")).agg(F.count(F.lit(1)).alias("n"), F.sum("task_id").alias("ids"))


@query("""WITH old AS (SELECT CASE WHEN c_custkey % 10 = 0 THEN NULL ELSE c_custkey END AS id, c_name AS name FROM customer WHERE c_custkey % 2 = 0 AND (c_custkey % 10 <> 0 OR c_custkey = 10)),
    new AS (SELECT CASE WHEN o_custkey % 10 = 0 THEN NULL ELSE o_custkey END AS id, o_orderkey AS seen FROM orders),
    last AS (SELECT id, max(seen) AS seen FROM new GROUP BY id)
    SELECT coalesce(o.id, l.id) AS id, CASE WHEN l.seen IS NOT NULL THEN 'order ' || CAST(l.seen AS VARCHAR) ELSE o.name END AS name FROM old o FULL JOIN last l ON o.id IS NOT DISTINCT FROM l.id""")
def op_upsert_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An upsert with keys that repeat and keys that are null on both sides."""
    key = lambda c: F.when(F.col(c) % 10 != 0, F.col(c)).alias("id")
    old = read(spark, sf_dir, "customer").filter("c_custkey % 2 = 0 and (c_custkey % 10 <> 0 or c_custkey = 10)").select(key("c_custkey"), F.col("c_name").alias("name"))
    new = read(spark, sf_dir, "orders").select(key("o_custkey"), F.concat(F.lit("order "), F.col("o_orderkey").cast("string")).alias("name"), F.col("o_orderkey").alias("at"))
    return O.upsert(old, new, ["id"], order=("at",))


@query(f"""WITH {TASKS_SQL}, e AS (SELECT l_orderkey AS task_id, CASE WHEN l_linenumber % 2 = 0 THEN 'failed' ELSE 'completed' END AS status, CASE l_linenumber % 3 WHEN 0 THEN 'stale' WHEN 1 THEN 't1' END AS token, l_shipdate AS ended_at FROM lineitem),
    f AS (SELECT task_id, arg_min(status, (ended_at, status)) AS ended, min(ended_at) AS first_at FROM e WHERE token IS DISTINCT FROM 'stale' GROUP BY task_id)
    SELECT t.task_id, CASE WHEN t.status = 'running' AND f.ended IS NOT NULL THEN f.ended ELSE t.status END AS status, CASE WHEN t.status = 'running' THEN f.first_at END AS finished_at FROM tasks t LEFT JOIN f USING (task_id)""")
def op_finish_twice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several ends for a task: the first that fits counts."""
    t = tasks(spark, sf_dir).select("task_id", "status", F.lit("t1").alias("claim_token"), F.lit(False).alias("cancel_requested"), F.lit(None).cast("timestamp").alias("finished_at"))
    n = F.col("l_linenumber")
    ends = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("task_id"), F.when(n % 2 == 0, "failed").otherwise("completed").alias("end_status"), F.when(n % 3 == 0, "stale").when(n % 3 == 1, "t1").alias("claim_token"), F.col("l_shipdate").alias("ended_at"))
    return L.finish(t, ends).select("task_id", "status", "finished_at")


@query("""WITH g AS (SELECT source, count(*) AS n FROM documents GROUP BY source) SELECT source AS code, CAST(n AS BIGINT) AS original_count, CAST(n AS BIGINT) AS deduplicated_count, CAST(0 AS BIGINT) AS duplicate_count,
    CAST(least(n, 30) AS BIGINT) AS displayed_count, CAST(n - least(n, 30) AS BIGINT) AS omitted_count FROM g WHERE n > 30""")
def op_limit_clamped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left out when more is asked for than a report shows."""
    docs = read(spark, sf_dir, "documents").select(F.lit(1).alias("task_id"), F.col("source").alias("code"), F.lit(1).alias("merged"))
    return R.limit_note(docs, limit=100).drop("task_id").select("code", F.col("original_count").cast("long").alias("original_count"), "deduplicated_count", F.col("duplicate_count").cast("long").alias("duplicate_count"), F.col("displayed_count").cast("long").alias("displayed_count"), F.col("omitted_count").cast("long").alias("omitted_count"))


@query("SELECT event_id, CAST(row_number() OVER (ORDER BY event_type, event_id) AS BIGINT) AS n FROM events")
def op_numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events in one order, numbered by ranges."""
    return OR.numbered(read(spark, sf_dir, "events").select("event_id", "event_type"), [], ["event_type", "event_id"]).select("event_id", "n")


# ---------------------------------------------------------------- the registry of checks

COMMANDS_SQL = """k AS (SELECT *, CAST(regexp_extract(props, '[0-9]+') AS INT) AS k FROM events),
    c0 AS (SELECT event_id AS seq, k, user_id, CASE event_type WHEN 'signup' THEN 'create' WHEN 'click' THEN 'edit' WHEN 'view' THEN CASE WHEN k % 2 = 0 THEN 'enable' ELSE 'disable' END
        WHEN 'error' THEN CASE k % 3 WHEN 0 THEN 'delete' WHEN 1 THEN 'reset' ELSE 'rename' END ELSE 'reorder' END AS action FROM k),
    c1 AS (SELECT seq, action, CASE WHEN action = 'reorder' THEN NULL WHEN k % 4 = 0 AND action <> 'create' THEN 'n' || CAST(k % 25 AS VARCHAR) ELSE 'c' || CAST((user_id * 7 + k) % 1500 AS VARCHAR) END AS code,
        CASE user_id % 3 WHEN 0 THEN 'document' WHEN 1 THEN 'image' ELSE 'document' END AS task_type, CASE WHEN k % 11 = 0 THEN '' ELSE 'name ' || CAST(seq AS VARCHAR) END AS name, 'd' || CAST(k AS VARCHAR) AS description,
        'prompt ' || CAST(seq AS VARCHAR) AS prompt, k % 2 = 1 AS enabled, CASE WHEN action <> 'reorder' THEN NULL WHEN k % 7 = 0 THEN [] ELSE ['c' || CAST(k * 13 % 1500 AS VARCHAR), 'n' || CAST(k % 25 AS VARCHAR), 'c' || CAST(user_id * 7 % 1500 AS VARCHAR)] END AS codes FROM c0),
    b AS (SELECT 'n' || CAST(n_nationkey AS VARCHAR) AS code, CASE n_regionkey % 2 WHEN 0 THEN 'document' ELSE 'image' END AS task_type, n_name AS name, 'built in' AS description, 'default ' || n_name AS prompt, n_regionkey <> 2 AS enabled, n_nationkey * 10 AS sort_order FROM nation),
    c2 AS (SELECT c1.*, b.code IS NOT NULL AS builtin, c1.action IN ('create', 'edit', 'enable', 'disable', 'reset', 'delete') AND NOT (c1.action IN ('create', 'edit') AND c1.name = '') AND NOT (c1.action = 'create' AND b.code IS NOT NULL)
        AND NOT (c1.action = 'delete' AND b.code IS NOT NULL) AND NOT (c1.action = 'reset' AND b.code IS NULL) AS fine FROM c1 LEFT JOIN b USING (code))"""
_OK = "(x.fine AND CASE WHEN x.action = 'create' THEN NOT a.made ELSE a.alive END)"


def _kept(field: str, actions: str, new: str) -> str:
    return f"{field} := CASE WHEN {_OK} AND x.action IN ({actions}) THEN {new} ELSE a.{field} END"


#: The log walked command by command: a fold over the commands of each check, and one over those of each type for the order.
FOLD_SQL = f"""{COMMANDS_SQL},
    steps AS (SELECT coalesce(c2.code, b.code) AS code, struct_pack(seq := 0, action := '', fine := FALSE, task_type := any_value(b.task_type), name := any_value(b.name), description := any_value(b.description), prompt := any_value(b.prompt),
            enabled := any_value(b.enabled), alive := any_value(b.code) IS NOT NULL, made := any_value(b.code) IS NOT NULL, base := any_value(b.prompt), good := CAST([] AS BIGINT[])) AS init,
        list(struct_pack(seq := seq, action := action, fine := fine, task_type := c2.task_type, name := c2.name, description := c2.description, prompt := c2.prompt, enabled := c2.enabled, alive := FALSE, made := FALSE, base := CAST(NULL AS VARCHAR), good := CAST([] AS BIGINT[])) ORDER BY seq)
            FILTER (c2.code IS NOT NULL) AS cs FROM (SELECT * FROM c2 WHERE code IS NOT NULL) c2 FULL JOIN b ON b.code = c2.code GROUP BY ALL),
    folded AS (SELECT code, list_reduce(list_prepend(init, coalesce(cs, [])), lambda a, x: struct_pack(seq := x.seq, action := x.action, fine := x.fine, {_kept("task_type", "'create'", "x.task_type")}, {_kept("name", "'create', 'edit'", "x.name")},
        {_kept("description", "'create', 'edit'", "x.description")}, prompt := CASE WHEN {_OK} AND x.action IN ('create', 'edit') THEN x.prompt WHEN {_OK} AND x.action = 'reset' THEN a.base ELSE a.prompt END,
        enabled := CASE WHEN {_OK} AND x.action IN ('create', 'edit') THEN x.enabled WHEN {_OK} AND x.action = 'enable' THEN TRUE WHEN {_OK} AND x.action = 'disable' THEN FALSE ELSE a.enabled END,
        alive := CASE WHEN {_OK} AND x.action = 'create' THEN TRUE WHEN {_OK} AND x.action = 'delete' THEN FALSE ELSE a.alive END, made := a.made OR ({_OK} AND x.action = 'create'), base := a.base,
        good := CASE WHEN {_OK} THEN list_append(a.good, x.seq) ELSE a.good END)) AS s FROM steps)"""


@query(f"""WITH {FOLD_SQL}, good AS (SELECT unnest(s.good) AS seq FROM folded),
    moves AS (SELECT seq, action, code, CASE WHEN action = 'delete' THEN (SELECT f.s.task_type FROM folded f WHERE f.code = c2.code) ELSE task_type END AS task_type, codes FROM c2
        WHERE (action IN ('create', 'delete') AND seq IN (SELECT seq FROM good)) OR (action = 'reorder' AND len(codes) > 0)),
    types AS (SELECT task_type, list(code ORDER BY sort_order) AS codes FROM b GROUP BY task_type),
    walks AS (SELECT t.task_type, list_reduce(list_prepend(struct_pack(action := '', code := '', codes := any_value(t.codes)), list(struct_pack(action := m.action, code := coalesce(m.code, ''), codes := coalesce(m.codes, [])) ORDER BY m.seq)),
        lambda a, x: struct_pack(action := '', code := '', codes := CASE x.action WHEN 'create' THEN list_prepend(x.code, a.codes) WHEN 'delete' THEN list_filter(a.codes, lambda y: y <> x.code)
            ELSE list_concat(list_filter(list_transform(range(1, len(x.codes) + 1), lambda i: CASE WHEN list_position(x.codes, x.codes[i]) = i AND list_contains(a.codes, x.codes[i]) THEN x.codes[i] END), lambda y: y IS NOT NULL),
                list_filter(a.codes, lambda y: NOT list_contains(x.codes, y))) END)).codes AS codes FROM types t JOIN moves m USING (task_type) GROUP BY t.task_type),
    places AS (SELECT unnest(codes) AS code, generate_subscripts(codes, 1) * 10 AS sort_order FROM walks)
    SELECT code, s.task_type AS task_type, s.name AS name, s.description AS description, s.prompt AS prompt, s.enabled AS enabled, s.base IS NOT NULL AS builtin, CAST(sort_order AS BIGINT) AS sort_order FROM folded JOIN places USING (code) WHERE s.alive""")
def op_check_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table of checks after a log of commands (events), starting from built-in ones (nations)."""
    return RG.current_checks(*_registry(spark, sf_dir))


@query(f"""WITH {FOLD_SQL}, good AS (SELECT unnest(s.good) AS seq FROM folded)
    SELECT seq, action, code, CASE WHEN action NOT IN ('create', 'edit', 'enable', 'disable', 'reset', 'delete', 'reorder') THEN 'unknown action' WHEN action = 'reorder' THEN 'empty order' WHEN action IN ('create', 'edit') AND name = '' THEN 'no name or prompt'
        WHEN action = 'create' THEN 'code is taken' WHEN action = 'delete' AND builtin THEN 'built-in' WHEN action = 'reset' AND NOT builtin THEN 'nothing to reset to' ELSE 'no such check' END AS problem
    FROM c2 WHERE CASE WHEN action = 'reorder' THEN len(codes) = 0 ELSE seq NOT IN (SELECT seq FROM good) END""")
def op_refused_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return RG.refused(*_registry(spark, sf_dir))


def _registry(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    n = read(spark, sf_dir, "nation")
    builtin = n.select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("code"), F.when(F.col("n_regionkey") % 2 == 0, "document").otherwise("image").alias("task_type"), F.col("n_name").alias("name"), F.lit("built in").alias("description"), F.concat(F.lit("default "), F.col("n_name")).alias("prompt"), (F.col("n_regionkey") != 2).alias("enabled"), (F.col("n_nationkey") * 10).alias("sort_order"))
    k, user = F.regexp_extract("props", "[0-9]+", 0).cast("int"), F.col("user_id")
    kind = F.col("event_type")
    action = F.when(kind == "signup", "create").when(kind == "click", "edit").when(kind == "view", F.when(k % 2 == 0, "enable").otherwise("disable")).when(kind == "error", F.when(k % 3 == 0, "delete").when(k % 3 == 1, "reset").otherwise("rename")).otherwise("reorder")
    e = read(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), action.alias("action"), k.alias("k"), user)
    text = lambda p, c: F.concat(F.lit(p), c.cast("string"))
    k = F.col("k")
    code = F.when(F.col("action") == "reorder", None).when((k % 4 == 0) & (F.col("action") != "create"), text("n", k % 25)).otherwise(text("c", (user * 7 + k) % 1500))
    codes = F.when(F.col("action") == "reorder", F.when(k % 7 == 0, F.array().cast("array<string>")).otherwise(F.array(text("c", k * 13 % 1500), text("n", k % 25), text("c", user * 7 % 1500))))
    commands = e.select(
        "seq", "action", code.alias("code"), F.when(user % 3 == 0, "document").when(user % 3 == 1, "image").otherwise("other").alias("task_type"), F.when(k % 11 == 0, " ").otherwise(text("name ", F.col("seq"))).alias("name"),
        text("d", k).alias("description"), text("prompt ", F.col("seq")).alias("prompt"), (k % 2 == 1).alias("enabled"), codes.alias("codes"),
    )
    return builtin, commands


# ---------------------------------------------------------------- groups, composed texts, reviews, names

_PAGE_CODES = ("image-text-correspondence", "image-ui-step-consistency", "image-figure-table-title-standard", "image-integrity-clarity")
_CODES = (*_PAGE_CODES, *CO.RESOURCE_CODES)
_CODES_SQL = "[" + ", ".join(f"'{c}'" for c in _CODES) + "]"
_RESOURCE_SQL = "(" + ", ".join(f"'{c}'" for c in CO.RESOURCE_CODES) + ")"


@query(f"""WITH checks AS (SELECT l_orderkey AS task_id, l_linenumber AS place, {_CODES_SQL}[CAST(l_partkey % 8 + 1 AS INT)] AS code FROM lineitem),
    t AS (SELECT *, CASE WHEN code IN {_RESOURCE_SQL} THEN 'resource' ELSE 'page' END AS target FROM checks),
    g AS (SELECT *, (row_number() OVER (PARTITION BY task_id, target ORDER BY place, code) - 1) // 2 AS grp FROM t),
    gg AS (SELECT task_id, target, grp, array_to_string(list(code ORDER BY place, code), ',') AS codes FROM g GROUP BY ALL),
    images AS (SELECT l_orderkey AS task_id, CASE l_returnflag WHEN 'N' THEN 'page' ELSE 'resource' END AS source, l_linenumber AS place, l_suppkey % 5 <> 0 AS good FROM lineitem WHERE l_orderkey % 4 <> 0),
    h AS (SELECT task_id, bool_or(source = 'page') AS p, bool_or(source = 'resource') AS r FROM images GROUP BY task_id),
    s AS (SELECT gg.*, CASE WHEN target = 'page' THEN CASE WHEN p THEN 'page' WHEN r THEN 'resource' END ELSE CASE WHEN r THEN 'resource' WHEN p THEN 'page' END END AS source FROM gg LEFT JOIN h USING (task_id)),
    n AS (SELECT task_id, source, count(*) FILTER (good) AS checkable, count(*) FILTER (NOT good) AS skipped FROM images GROUP BY ALL)
    SELECT s.task_id, target, CAST(grp AS BIGINT) AS "group", codes, s.source, coalesce(s.source <> target, FALSE) AS fallback, CAST(coalesce(checkable, 0) AS BIGINT) AS checkable, CAST(coalesce(skipped, 0) AS BIGINT) AS skipped, CAST(coalesce((checkable + 1) // 2, 0) AS BIGINT) AS batches,
        concat_ws('|', CASE WHEN target = 'page' AND s.task_id % 6 > 0 THEN 'PDF 共 ' || coalesce(CASE WHEN s.task_id % 5 > 0 THEN CAST(s.task_id % 6 + 9 AS VARCHAR) END, '-') || ' 页，本次页面级检查按长文档策略选取 9 页，未覆盖 ' || CAST(s.task_id % 6 AS VARCHAR) || ' 页；未覆盖页需要人工抽查或调高 image_page_check_max_pages 后重跑。' END,
            CASE WHEN target = 'resource' AND s.task_id % 3 = 0 THEN '{CO.ERROR_NOTE}bad xref' END, CASE WHEN s.source <> target THEN '{CO.FALLBACK_NOTE}' END) AS notes
    FROM s LEFT JOIN n ON n.task_id = s.task_id AND n.source = s.source""")
def op_check_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checks of each order in groups of two, with images of their own source, of the other one, or none."""
    li = read(spark, sf_dir, "lineitem")
    codes = F.array(*[F.lit(c) for c in _CODES])
    checks = li.select(F.col("l_orderkey").alias("task_id"), F.get(codes, (F.col("l_partkey") % 8).cast("int")).alias("code"), F.col("l_linenumber").alias("place"))
    images = li.filter("l_orderkey % 4 <> 0").select(F.col("l_orderkey").alias("task_id"), F.when(F.col("l_returnflag") == "N", "page").otherwise("resource").alias("source"), F.col("l_linenumber").alias("place"), F.when(F.col("l_suppkey") % 5 != 0, "image/png").alias("mime_type"))
    k = F.col("o_orderkey")
    meta = read(spark, sf_dir, "orders").select(k.alias("task_id"), F.when(k % 5 > 0, k % 6 + 9).alias("total_pages"), F.lit(9).alias("selected_pages"), (k % 6).alias("omitted_pages"), F.when(k % 3 == 0, " bad xref ").alias("image_error"))
    out = CO.check_groups(checks, images, meta, size=2, batch=2)
    return out.withColumns({"codes": F.array_join("codes", ","), "notes": F.array_join("notes", "|")})


ANSWERS_SQL = """i AS (SELECT l_orderkey AS task_id, 'c' || CAST(l_suppkey % 2 AS VARCHAR) AS code, l_linenumber AS idx, CASE l_returnflag WHEN 'R' THEN 'issue' WHEN 'A' THEN 'suggestion' ELSE 'non_issue' END AS status,
    CASE WHEN l_partkey % 3 = 0 THEN '' ELSE 'p' || CAST(l_partkey AS VARCHAR) END AS location, CASE WHEN l_partkey % 5 = 0 THEN '' ELSE '文字缺失。' END AS description, CASE WHEN l_partkey % 7 = 0 THEN '文字' ELSE '见 ' || CAST(l_suppkey AS VARCHAR) END AS excerpt, CASE WHEN l_tax < 0.04 THEN '补上' ELSE '' END AS suggestion FROM lineitem),
    f AS (SELECT *, coalesce(nullif(description, ''), nullif(suggestion, ''), excerpt) AS said FROM i), l0 AS (SELECT *, CASE WHEN location <> '' THEN location || '：' || said ELSE said END AS base FROM f),
    l1 AS (SELECT *, list_filter([CASE WHEN excerpt <> '' AND NOT contains(base, excerpt) THEN '证据：' || excerpt END, CASE WHEN suggestion <> '' AND NOT contains(base, suggestion) THEN '建议：' || suggestion END], lambda x: x IS NOT NULL) AS more FROM l0),
    l AS (SELECT *, CASE WHEN len(more) > 0 THEN rtrim(base, '；。') || '；' || array_to_string(more, '；') ELSE base END AS line FROM l1)"""
_SECTION = "coalesce('- ' || string_agg(line, chr(10) || '- ' ORDER BY idx, line) FILTER (status {}), '- {}')"


@query(f"""WITH {ANSWERS_SQL}, c AS (SELECT o_orderkey AS task_id, 'c' || CAST(k AS VARCHAR) AS code, 'check ' || CAST(k AS VARCHAR) AS name, CASE WHEN o_orderkey % 2 = 0 THEN 'said' ELSE '' END AS summary FROM orders, range(2) t(k))
    SELECT c.task_id, c.code, '### 检查项：' || c.code || '｜' || name || chr(10) || chr(10) || '#### 总体判断' || chr(10) || CASE WHEN summary <> '' THEN summary WHEN count(*) FILTER (status = 'issue') > 0 THEN '发现明确问题。' ELSE '未发现明确问题。' END
        || chr(10) || chr(10) || '#### 明确问题' || chr(10) || {_SECTION.format("= 'issue'", CO.NO_ISSUE)} || chr(10) || chr(10) || '#### 需人工确认' || chr(10) || {_SECTION.format("= 'suggestion'", CO.NO_MANUAL)}
        || chr(10) || chr(10) || '#### 未发现问题' || chr(10) || {_SECTION.format("= 'non_issue'", CO.NO_NORMAL)} AS body FROM c LEFT JOIN l USING (task_id, code) GROUP BY c.task_id, c.code, name, summary""")
def op_rendered_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return CO.rendered_checks(*_answers(spark, sf_dir))


def _answers(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two checks for each order and line items as their findings."""
    o, li = read(spark, sf_dir, "orders"), read(spark, sf_dir, "lineitem")
    checks = o.select(F.col("o_orderkey").alias("task_id"), F.explode(F.array(F.lit(0), F.lit(1))).alias("k")).select("task_id", F.concat(F.lit("c"), F.col("k").cast("string")).alias("code"), F.concat(F.lit("check "), F.col("k").cast("string")).alias("name"), F.when(F.col("task_id") % 2 == 0, "said").otherwise("").alias("summary"))
    part, number = F.col("l_partkey"), lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    items = li.select(
        F.col("l_orderkey").alias("task_id"), F.concat(F.lit("c"), (F.col("l_suppkey") % 2).cast("string")).alias("code"), F.col("l_linenumber").cast("int").alias("idx"), F.when(F.col("l_returnflag") == "R", "Issue ").when(F.col("l_returnflag") == "A", "suggestion").otherwise("non_issue").alias("status"),
        F.when(part % 3 == 0, "").otherwise(number("p", "l_partkey")).alias("location"), F.when(part % 5 == 0, "").otherwise("文字缺失。").alias("description"), F.when(part % 7 == 0, "文字").otherwise(number("见 ", "l_suppkey")).alias("excerpt"),
        F.when(F.col("l_tax") < 0.04, "补上").otherwise("").alias("suggestion"), F.lit(None).cast("string").alias("impact"),
    )
    return checks, items


@query("""WITH b AS (SELECT l_orderkey AS task_id, l_linenumber AS batch, min(l_partkey) % 4 AS form, min(l_suppkey) AS s FROM lineitem GROUP BY ALL), t AS (SELECT task_id, max(batch) AS n FROM b GROUP BY task_id),
    x AS (SELECT b.*, CASE WHEN n > 1 THEN '批次 ' || CAST(batch AS VARCHAR) || '/' || CAST(n AS VARCHAR) ELSE '批次 1' END || CASE WHEN s % 3 = 0 THEN '：' ELSE '（PDF第' || CAST(s AS VARCHAR) || '页）：' END || ' ' AS label FROM b JOIN t USING (task_id)),
    r AS (SELECT task_id, 'issue' AS kind, batch, 1 AS spot, label || '表格标题缺失 ' || CAST(s % 5 AS VARCHAR) AS line FROM x WHERE form IN (0, 1)
        UNION ALL SELECT task_id, 'manual', batch, 2, label || '截图较小，需人工确认' FROM x WHERE form = 0 UNION ALL SELECT task_id, 'manual', batch, 3, label || '第 2 项待核对' FROM x WHERE form = 1
        UNION ALL SELECT task_id, 'issue', batch, 1, label || '图片模糊' FROM x WHERE form = 2 UNION ALL SELECT o_orderkey, 'manual', 1 << 30, 0, 'note' FROM orders WHERE o_orderkey % 3 = 0 AND o_orderkey IN (SELECT task_id FROM b)),
    u AS (SELECT task_id, kind, line, min((batch, spot)) AS place FROM r GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY task_id, kind ORDER BY place) AS n FROM u)
    SELECT t.task_id, '### 检查汇总' || chr(10) || chr(10) || '#### 明确问题' || chr(10) || coalesce('- ' || string_agg(line, chr(10) || '- ' ORDER BY k.n) FILTER (kind = 'issue'), '- 未发现明确问题。')
        || chr(10) || chr(10) || '#### 需人工确认' || chr(10) || coalesce('- ' || string_agg(line, chr(10) || '- ' ORDER BY k.n) FILTER (kind = 'manual'), '- 未发现需人工确认项。') AS body FROM t LEFT JOIN k ON k.task_id = t.task_id AND k.n <= 30 GROUP BY t.task_id""")
def op_issue_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of answers of four kinds (sections, sections with text after the heading, loose text, nothing found)."""
    s = (F.col("l_suppkey") % 5).cast("string")
    form = F.col("l_partkey") % 4
    said = (
        F.when(form == 0, F.concat(F.lit("### 检查项：x｜y\n#### 总体判断\n有问题\n#### 明确问题\n- 页面显示正常，文字清晰。\n- 表格标题缺失  "), s, F.lit("\n- 截图较小，需人工确认\n#### 需人工确认\n- 未发现需人工确认项。")))
        .when(form == 1, F.concat(F.lit("总体判断：发现问题\n**明确问题：表格标题缺失 "), s, F.lit("\n\n需要人工确认\n1. 第 2 项待核对\n未发现问题\n- 图片清晰")))
        .when(form == 2, F.lit("# 标题错误\n覆盖内容\n图片模糊\n页面正常"))
        .otherwise(F.lit("#### 明确问题\n- 未发现明确问题。\n未见异常"))
    )
    label = F.when(F.col("l_suppkey") % 3 != 0, F.concat(F.lit("PDF第"), F.col("l_suppkey").cast("string"), F.lit("页")))
    dealt = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").repartition("l_orderkey")  # by order, for all that follows
    batches = dealt.groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("l_partkey"), F.min("l_suppkey").alias("l_suppkey")).select(F.col("l_orderkey").alias("task_id"), F.col("l_linenumber").alias("batch"), label.alias("label"), said.alias("content"))
    notes = read(spark, sf_dir, "orders").filter("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("task_id"), F.explode(F.array(F.lit(1), F.lit(2))).alias("at"), F.lit(" note ").alias("note"))
    return CO.issue_summary(batches, notes)


@query("""WITH i AS (SELECT l_orderkey AS task_id, 'c' || CAST(l_suppkey % 2 AS VARCHAR) AS code, 'i' || CAST(l_linenumber AS VARCHAR) AS item_id, 'check' || CAST(l_partkey % 2 AS VARCHAR) AS check_name, CAST(l_linenumber % 3 AS VARCHAR) AS idx FROM lineitem),
    r AS (SELECT l_orderkey AS task_id, l_linenumber AS row_number, l_partkey % 5 AS form, 'c' || CAST(l_suppkey % 2 AS VARCHAR) AS c, 'i' || CAST(l_linenumber AS VARCHAR) AS d, 'check' || CAST(l_partkey % 2 AS VARCHAR) AS name, '条目 ' || CAST(l_linenumber % 3 AS VARCHAR) AS marker FROM lineitem),
    o AS (SELECT task_id, check_name AS name, '条目 ' || idx AS marker, count(*) AS fits, min(code) AS code, min(item_id) AS item_id FROM i GROUP BY ALL),
    k AS (SELECT r.*, CASE WHEN form = 0 THEN 'half' WHEN form IN (1, 2) THEN 'exact' WHEN form = 3 THEN 'gone' ELSE 'older' END AS kind, o.fits, o.code AS oc, o.item_id AS oi FROM r LEFT JOIN o USING (task_id, name, marker)),
    m AS (SELECT *, CASE WHEN kind = 'exact' THEN c WHEN kind = 'older' AND fits = 1 THEN oc END AS code, CASE WHEN kind = 'exact' THEN d WHEN kind = 'older' AND fits = 1 THEN oi END AS item FROM k),
    p AS (SELECT *, rank() OVER (PARTITION BY task_id, code, item ORDER BY row_number) AS nth FROM m),
    q AS (SELECT *, CASE WHEN kind = 'half' THEN 'half an id' WHEN kind = 'older' AND item IS NULL THEN 'no single candidate' WHEN kind = 'gone' THEN 'item is gone' WHEN nth > 1 THEN 'item named before' END AS problem FROM p)
    SELECT task_id, row_number, CASE WHEN problem IS NULL THEN code END AS code, CASE WHEN problem IS NULL THEN item END AS item_id, problem FROM q""")
def op_legacy_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as rows of an imported table: with half an id, a whole one, one that is gone, or the older key."""
    li = read(spark, sf_dir, "lineitem")
    text = lambda p, c: F.concat(F.lit(p), c.cast("string"))
    code, item, name, idx = text("c", F.col("l_suppkey") % 2), text("i", F.col("l_linenumber")), text("check", F.col("l_partkey") % 2), F.col("l_linenumber") % 3
    items = li.select(F.col("l_orderkey").alias("task_id"), code.alias("code"), item.alias("item_id"), name.alias("check_name"), idx.alias("idx"))
    form = F.col("l_partkey") % 5
    rows = li.select(F.col("l_orderkey").alias("task_id"), F.col("l_linenumber").alias("row_number"), F.when(form < 4, code).alias("code"), F.when(form.isin(1, 2), item).when(form == 3, "i99").otherwise(" ").alias("item_id"), name.alias("check_name"), text("条目 ", idx).alias("marker"))
    return CO.matched_reviews(rows, items)


@query("""WITH RECURSIVE f AS (SELECT l_orderkey AS task_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS k, l_linenumber * 10000000000000 + l_partkey * 1000000 + l_suppkey AS n, 'd/f' || CAST(l_suppkey % 2 AS VARCHAR) || CASE WHEN l_partkey % 3 = 0 THEN '-2' ELSE '' END AS stem FROM lineitem),
    s AS (SELECT task_id, k, n, stem || '.txt' AS pick, [stem || '.txt'] AS used FROM f WHERE k = 1
        UNION ALL SELECT f.task_id, f.k, f.n, p.pick, list_append(s.used, p.pick) FROM s JOIN f ON f.task_id = s.task_id AND f.k = s.k + 1,
            LATERAL (SELECT CASE WHEN NOT list_contains(s.used, f.stem || '.txt') THEN f.stem || '.txt' ELSE list_filter(list_transform(range(2, 12), lambda i: f.stem || '-' || CAST(i AS VARCHAR) || '.txt'), lambda x: NOT list_contains(s.used, x))[1] END AS pick) p)
    SELECT task_id, n, pick AS unique_name FROM s""")
def op_unique_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of each order under names that repeat and that look like made ones."""
    li = read(spark, sf_dir, "lineitem")
    name = F.concat(F.lit("/d/f"), (F.col("l_suppkey") % 2).cast("string"), F.when(F.col("l_partkey") % 3 == 0, "-2").otherwise(""), F.lit(".txt"))
    files = li.select(F.col("l_orderkey").alias("task_id"), (F.col("l_linenumber") * F.lit(10000000000000) + F.col("l_partkey") * 1000000 + F.col("l_suppkey")).alias("n"), name.alias("name"))
    return CO.unique_names(files, ["task_id"], "n", "name").select("task_id", "n", "unique_name")


@query("""SELECT o_orderkey AS task_id, CAST(k + 1 AS INT) AS idx, 'line' || chr(10) || 'of ' || CAST(o_custkey AS VARCHAR) || ' item ' || CAST(k AS VARCHAR) AS description, '{"a": [1, {"b": null}], "k": ' || CAST(k AS VARCHAR) || '}' AS impact FROM orders, range(2) t(k)""")
def op_answer_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order as an answer of two items with raw line ends in its strings and nested values, then: whole in prose, encoded
    once or twice, or cut off inside a third, nested item."""
    o = read(spark, sf_dir, "orders")
    item = lambda k: F.concat(F.lit('{"status":"issue","problem":"line\nof '), F.col("o_custkey").cast("string"), F.lit(f' item {k}","risk":{{"k":{k},"a":[1,{{"b":null}}]}}}}'))
    two = F.concat(F.lit('{"summary":"s","problems":['), item(0), F.lit(","), item(1))
    whole = F.concat(two, F.lit("]}"))
    coded = F.regexp_replace(F.regexp_replace(whole, '(["\\\\])', "\\\\$1"), "\n", "\\\\n")
    once = F.concat(F.lit('"'), coded, F.lit('"'))
    twice = F.concat(F.lit('"'), F.regexp_replace(once, '(["\\\\])', "\\\\$1"), F.lit('"'))
    form = F.col("o_orderkey") % 4
    answer = F.when(form == 0, F.concat(F.lit("see [1]: "), whole, F.lit(" and [2]"))).when(form == 1, once).when(form == 2, twice).otherwise(F.concat(two, F.lit(',{"status":"issue","risk":{"a":[1,{"b":"cut')))
    results = o.select(F.col("o_orderkey").alias("task_id"), F.lit("c").alias("code"), A.reports(answer).alias("report"), answer.alias("result"))
    return R.report_items(results).select("task_id", "idx", "description", "impact")

