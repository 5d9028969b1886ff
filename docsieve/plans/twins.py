"""SQL twins (for DuckDB) of the queries whose rules take more than a line: locations, greedy terms, hard tokens, sampling."""

from __future__ import annotations

from docsieve.functions import text as X


def _flat(value: str) -> str:
    """White space to single spaces, trimmed."""
    return f"trim(regexp_replace({value}, '\\s+', ' ', 'g'))"


def _excerpt(at: str, width: str) -> str:
    start, end = f"greatest(0, {at} - 45)", f"least(length(text), {at} + {width} + 45)"
    return f"(CASE WHEN {start} > 0 THEN '...' ELSE '' END || {_flat(f'substr(text, {start} + 1, {end} - {start})')} || CASE WHEN {end} < length(text) THEN '...' ELSE '' END)"


def _places(found: str, term: str, order: str) -> str:
    """``found`` (a CTE: doc_id, text, term, positions, ...) -> CTE ``placed`` with the location and excerpt of each position."""
    end = "least(length(line), greatest(0, instr(line, term) - 1 - 40) + 80)"
    around = f"(CASE WHEN greatest(0, {end} - 80) > 0 THEN '...' ELSE '' END || trim(substr(line, greatest(0, {end} - 80) + 1, {end} - greatest(0, {end} - 80))) || CASE WHEN {end} < length(line) THEN '...' ELSE '' END)"
    return f"""one AS (SELECT doc_id, text, {term} AS term, unnest(positions) AS pos, generate_subscripts(positions, 1) AS k, {order} FROM {found}),
    cut AS (SELECT *, substr(text, 1, pos) AS before, split_part(substr(text, pos + 1), chr(10), 1) AS after FROM one),
    seen AS (SELECT *, before || after AS upto, {_flat("string_split(before, chr(10))[-1] || after")} AS line, length(before) - length(replace(before, chr(10), '')) + 1 AS line_no FROM cut),
    marks AS (SELECT *, regexp_extract(text, '(?m)^file:\\s*(.+?)\\s*$', 1) AS file_name, regexp_extract_all(upto, '\\[第(\\d+)页\\]', 1)[-1] AS page, regexp_extract_all(upto, '(?m)^#\\s*工作表：(.+?)\\s*$', 1)[-1] AS sheet,
        CASE WHEN length(line) <= 80 THEN line WHEN instr(line, term) = 0 THEN rtrim(substr(line, 1, 77)) || '...' ELSE {around} END AS clue FROM seen),
    placed AS (SELECT doc_id, {order},
        string_agg(concat_ws('，', CASE WHEN file_name <> '' THEN '文件：' || file_name END, CASE WHEN page IS NOT NULL THEN '页码：第' || page || '页' END, CASE WHEN trim(sheet) <> '' THEN '工作表：' || trim(sheet) END,
            '行：' || CAST(line_no AS VARCHAR), CASE WHEN line <> '' THEN '附近线索：' || clue END), '；' ORDER BY k) AS location,
        string_agg({_excerpt("pos", "length(term)")}, '；' ORDER BY k) AS excerpt FROM marks GROUP BY doc_id, {order})"""


def sensitive_items(rules: str) -> str:
    return f"""WITH {rules}, hit AS (SELECT doc_id, text, invalid, standard, string_split(text, invalid) AS parts FROM documents, rules WHERE contains(text, invalid)),
    found AS (SELECT doc_id, text, invalid, standard, len(parts) - 1 AS hits, list_transform(range(1, least(len(parts), 6)), lambda i: CAST(list_sum(list_transform(parts[1:i], lambda p: length(p))) + (i - 1) * length(invalid) AS BIGINT)) AS positions FROM hit),
    {_places("found", "invalid", "invalid, standard")}
    SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY f.positions[1], invalid, standard) AS INTEGER) AS idx, '敏感词/不规范用语' AS category, location, excerpt,
    '文档中出现词表中的不规范用语“' || invalid || '”，共 ' || CAST(hits AS VARCHAR) || ' 处。' AS description, '可能不符合公司统一表述、品牌口径或对外发布用语要求。' AS impact,
    '建议统一替换为：' || standard || '。' AS suggestion, 'issue' AS type FROM found f JOIN placed USING (doc_id, invalid, standard) QUALIFY idx <= 30"""


def _common(rules: list[tuple[str, str, str]]) -> str:
    """``rules`` (standard, term, kind) -> CTEs up to ``kinds``: the terms that a greedy pass from the left keeps. Where hits
    overlap they form a cluster, in which the pass goes on from the first hit to the next that begins after its end."""
    values = ", ".join(f"('{s}', '{t}', '{k}')" for s, t, k in rules)
    pattern = "CASE kind WHEN 'case' THEN '(?i)' ELSE '' END || '\\b' || term || '\\b'"
    return f"""RECURSIVE r(standard, term, kind) AS (VALUES {values}),
    hit AS (SELECT doc_id, standard, term, kind, regexp_extract_all(text, {pattern}) AS seen, string_split_regex(text, {pattern}) AS parts FROM documents, r WHERE regexp_matches(text, {pattern})),
    each AS (SELECT doc_id, standard, term, kind, unnest(seen) AS observed, unnest(parts[1:len(seen)]) AS part, generate_subscripts(seen, 1) AS k FROM hit),
    ends AS (SELECT *, sum(length(part) + length(observed)) OVER (PARTITION BY doc_id, standard, term, kind ORDER BY k) AS stop FROM each),
    candidates AS (SELECT DISTINCT doc_id, CAST(stop - length(observed) AS BIGINT) AS start, CAST(stop AS BIGINT) AS stop, observed, standard, kind FROM ends WHERE kind = 'discouraged' OR observed <> standard),
    first AS (SELECT * FROM candidates QUALIFY row_number() OVER (PARTITION BY doc_id, start ORDER BY stop DESC, CASE kind WHEN 'discouraged' THEN 0 ELSE 1 END, standard) = 1),
    apart AS (SELECT *, coalesce(max(stop) OVER (PARTITION BY doc_id ORDER BY start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) <= start, true) AS fresh FROM first),
    clusters AS (SELECT *, sum(CASE WHEN fresh THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY start) AS cluster FROM apart),
    chosen AS (SELECT doc_id, cluster, start, stop, observed, standard, kind FROM clusters WHERE fresh
        UNION ALL SELECT n.doc_id, n.cluster, n.start, n.stop, n.observed, n.standard, n.kind FROM chosen c JOIN clusters n ON n.doc_id = c.doc_id AND n.cluster = c.cluster AND n.start >= c.stop
        WHERE NOT EXISTS (SELECT 1 FROM clusters m WHERE m.doc_id = n.doc_id AND m.cluster = n.cluster AND m.start >= c.stop AND m.start < n.start)),
    kinds AS (SELECT doc_id, observed, standard, kind, count(*) AS hits, min(start) AS first_pos, list(start ORDER BY start)[1:5] AS positions FROM chosen GROUP BY doc_id, observed, standard, kind)"""


def common_terms(rules: list[tuple[str, str, str]]) -> str:
    return f"WITH {_common(rules)} SELECT doc_id, observed, standard, kind, hits, first_pos FROM kinds"


def common_items(rules: list[tuple[str, str, str]]) -> str:
    return f"""WITH {_common(rules)}, best AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY first_pos, observed, standard, kind) AS idx FROM kinds QUALIFY idx <= 5),
    found AS (SELECT b.*, d.text FROM best b JOIN documents d USING (doc_id)), {_places("found", "observed", "observed, standard, kind")}
    SELECT doc_id, CAST(idx AS INTEGER) AS idx, CASE kind WHEN 'case' THEN '常用词/大小写不一致' ELSE '常用词/错误或不推荐用法' END AS category, location, excerpt,
    CASE kind WHEN 'case' THEN '文档中的“' || observed || '”与常用词表规定的大小写“' || standard || '”不一致，共 ' || CAST(hits AS VARCHAR) || ' 处。' ELSE '文档中出现常见错误或不推荐用法“' || observed || '”，共 ' || CAST(hits AS VARCHAR) || ' 处。' END AS description,
    CASE kind WHEN 'case' THEN '大小写不符合统一术语、产品名称或品牌写法要求。' ELSE '可能造成术语不统一、表达不规范或品牌写法不一致。' END AS impact,
    '请统一修改为词表中的正确写法：' || standard || '。' AS suggestion, 'issue' AS type FROM found JOIN placed USING (doc_id, observed, standard, kind)"""


_PROSE = "array_to_string(list_transform(string_split_regex(text, '\\s'), lambda w: CASE WHEN regexp_matches(w, '[0-9]') THEN array_to_string(list_transform(regexp_extract_all(w, '[A-Za-z0-9][A-Za-z0-9_.:/+#-]*|[^A-Za-z0-9]'), lambda t: CASE WHEN regexp_matches(t, '[0-9]') AND regexp_matches(t, '[A-Za-z]') THEN '' ELSE t END), '') ELSE w END), ' ')"
_KANA, _HANGUL = "\\x{3040}-\\x{30ff}\\x{31f0}-\\x{31ff}", "\\x{1100}-\\x{11ff}\\x{3130}-\\x{318f}\\x{ac00}-\\x{d7af}"

#: CTE ``languages`` (doc_id, text, language).
LANGUAGES = f"""counted AS (SELECT doc_id, text, len(regexp_extract_all(text, '[\\x{{4e00}}-\\x{{9fff}}]')) AS cjk, length(regexp_replace({_PROSE}, '[^\\p{{Latin}}]', '', 'g')) AS latin,
      len(regexp_extract_all(text, '[{_KANA}]')) AS japanese, len(regexp_extract_all(text, '[{_HANGUL}]')) AS hangul,
      length(regexp_replace(regexp_replace(text, '\\P{{L}}', '', 'g'), '[\\p{{Latin}}\\x{{4e00}}-\\x{{9fff}}{_KANA}{_HANGUL}]', '', 'g')) AS other FROM documents),
    languages AS (SELECT doc_id, text, CASE WHEN japanese >= 10 AND japanese / greatest(cjk + japanese, 1) >= 0.08 AND cjk + japanese >= greatest(20, latin) THEN 'other'
      WHEN hangul >= greatest(20, cjk, latin) THEN 'other' WHEN other >= greatest(40, cjk, latin) THEN 'other'
      WHEN cjk >= 40 AND latin >= 80 AND least(cjk, latin) / greatest(cjk, latin) >= 0.2 THEN 'mixed' WHEN cjk >= greatest(20, latin) THEN 'zh' WHEN latin >= greatest(40, cjk) THEN 'latin'
      WHEN cjk > 0 OR latin > 0 THEN 'uncertain' ELSE 'unknown' END AS language FROM counted)"""

_LABEL = "CASE language " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in X.LANGUAGE_LABELS.items()) + " END"


def _quoted(value: str) -> str:
    return value.replace("'", "''")


#: CTE ``profiles`` (doc_id, language, tokens, headings, visible).
PROFILES = f"""{LANGUAGES}, profiles AS (SELECT doc_id, {_LABEL} AS language, length(regexp_replace(text, '\\s+', '', 'g')) AS visible,
    list_distinct(list_filter(list_transform(regexp_extract_all(text, '(?i){_quoted(X.TOKENS)}'), lambda t: lower(trim(t, '{_quoted(X.TOKEN_EDGE)}'))), lambda t: t <> '')) AS tokens,
    list_filter(list_transform(string_split_regex(text, '{X.LINE_END}'), lambda x: {_flat("x")}), lambda x: length(x) BETWEEN 1 AND 120 AND regexp_matches(x, '{X.HEADING}')) AS headings FROM languages)"""


def _by_length(values: str) -> str:
    keyed = f"list_sort(list_transform({values}, lambda v: {{'n': length(v), 'v': v}}))"
    return f"array_to_string(list_transform({keyed}[1:40], lambda s: s.v), '、')"


HARD_TOKENS = f"""WITH {PROFILES} SELECT doc_id, language, CAST(len(tokens) AS INTEGER) AS n_tokens, {_by_length("tokens")} AS preview,
    array_to_string(list_filter(headings, lambda x, i: list_position(headings, x) = i)[1:12], '、') AS headings FROM profiles"""

PROFILE_DIFFERENCE = f"""WITH {PROFILES} SELECT x.doc_id AS a, y.doc_id AS b, x.language AS language_a, y.language AS language_b,
    CASE WHEN x.visible <= 0 THEN '无法计算' ELSE printf('%.2f', y.visible / x.visible) END AS length_ratio,
    {_by_length("list_filter(x.tokens, lambda t: NOT list_contains(y.tokens, t))")} AS only_a, {_by_length("list_filter(y.tokens, lambda t: NOT list_contains(x.tokens, t))")} AS only_b
    FROM profiles x JOIN profiles y ON y.doc_id = x.doc_id + 1"""

PAGE_SAMPLING = """WITH d AS (SELECT doc_id, CAST(floor(length(text) / 40) AS INTEGER) AS total FROM documents),
    b AS (SELECT *, list_distinct(list_concat([1, 2, 3, total - 1, total], list_filter([doc_id * 3 % 50 + 1, doc_id * 7 % 50 + 1, doc_id * 11 % 50 + 1], lambda p: p BETWEEN 1 AND total))) AS base FROM d),
    p AS (SELECT *, greatest(1, 12 - len(base)) AS parts FROM b),
    s AS (SELECT *, list_sort(list_distinct(list_filter(list_transform(range(0, parts), lambda i: CAST(1 + round_even(i * (total - 1) / greatest(1, parts - 1), 0) AS BIGINT)), lambda q: NOT list_contains(base, q)))) AS fresh FROM p),
    w AS (SELECT *, list_concat(base, fresh[1:greatest(12 - len(base), 1)]) AS taken FROM s),
    r AS (SELECT *, list_filter(range(1, greatest(total, 0) + 1), lambda q: NOT list_contains(taken, q)) AS rest FROM w)
    SELECT doc_id, total, array_to_string(CASE WHEN total <= 12 THEN range(1, total + 1) ELSE list_sort(list_concat(taken, rest[1:greatest(12 - len(taken), 0)]))[1:12] END, ',') AS pages FROM r"""

TIME_SAMPLING = """WITH e AS (SELECT event_id, value AS s, greatest(1, least(16, CAST(ceil(value / 2) AS INTEGER) + 1)) AS n, greatest(0.0::DOUBLE, value - 0.1::DOUBLE) AS last FROM events),
    m AS (SELECT event_id, CAST(round_even(greatest(s, 0.0::DOUBLE) * 1000, 0) AS BIGINT) AS ms, list_transform(range(0, n), lambda i: CAST(printf('%.3f', least(last, i * CASE WHEN n > 1 THEN last / (n - 1) ELSE 0.0::DOUBLE END)) AS DOUBLE)) AS t FROM e)
    SELECT event_id, array_to_string(list_transform(list_sort(list_distinct(t)), lambda x: CAST(x AS VARCHAR)), ',') AS moments,
    CASE WHEN ms >= 3600000 THEN printf('%02d:', ms // 3600000) ELSE '' END || printf('%02d:%02d.%03d', ms // 1000 % 3600 // 60, ms // 1000 % 60, ms % 1000) AS label FROM m"""

REPEAT_TAIL = """WITH d AS (SELECT doc_id, text, length(text) AS n FROM documents),
    w AS (SELECT doc_id, n, size, substr(text, n - 3 * size + 1, size) AS a, substr(text, n - 2 * size + 1, size) AS b, substr(text, n - size + 1, size) AS c FROM d, (VALUES (16), (32), (64), (128), (256)) v(size) WHERE n >= 3 * size),
    s AS (SELECT doc_id, len(list_filter(range(1, size + 1), lambda i: a[i] = b[i])) / size >= 0.9 AND len(list_filter(range(1, size + 1), lambda i: a[i] = c[i])) / size >= 0.9 AS alike FROM w)
    SELECT doc_id, coalesce(bool_or(alike), false) AS repeats FROM d LEFT JOIN s USING (doc_id) GROUP BY doc_id"""


def similarity_of(pairs: str) -> str:
    """CTEs from pairs (a, b, ta, tb: plain texts) to ``scored`` (a, b, similarity). Blocks come from a recursion over parts
    of a pair: equal characters on one diagonal without a gap are a run; the longest run of characters that are not too
    common, with what lies next to it on its diagonal, parts the rest in two."""
    plain = "regexp_replace(lower({}), '[^a-z0-9äöüßéèêçñóíáúàâîôûëïÿœæ]+', '', 'g')"
    return f"""texts AS (SELECT a, b, {plain.format("ta")} AS x, {plain.format("tb")} AS y FROM ({pairs})),
    xs AS (SELECT a, b, unnest(range(length(x))) AS i, unnest(string_split(x, '')) AS c FROM texts WHERE x <> ''), ys AS (SELECT a, b, length(y) AS n, unnest(range(length(y))) AS j, unnest(string_split(y, '')) AS c FROM texts WHERE y <> ''),
    rare AS (SELECT *, n < 200 OR count(*) OVER (PARTITION BY a, b, c) <= n // 100 + 1 AS rare FROM ys),
    alike AS (SELECT a, b, i, j, rare FROM xs JOIN rare USING (a, b, c)),
    parts AS (SELECT a, b, CAST(0 AS BIGINT) AS i0, length(x) AS i1, CAST(0 AS BIGINT) AS j0, length(y) AS j1, CAST(0 AS BIGINT) AS size FROM texts
        UNION ALL SELECT a, b, CASE side WHEN 0 THEN i0 ELSE best.s + best.n END, CASE side WHEN 0 THEN best.s ELSE i1 END, CASE side WHEN 0 THEN j0 ELSE best.s - best.d + best.n END, CASE side WHEN 0 THEN best.s - best.d ELSE j1 END, CASE side WHEN 0 THEN best.n ELSE 0 END
        FROM (SELECT a, b, i0, i1, j0, j1, arg_min(struct_pack(s := s, n := n, d := i - j), CASE WHEN rare THEN struct_pack(n := -m, i := r, j := r - i + j) ELSE struct_pack(n := CAST(0 AS BIGINT), i := i, j := j) END) FILTER (rare OR (i = i0 AND j = j0)) AS best
            FROM (SELECT *, min(i) OVER run AS s, count(*) OVER run AS n, min(i) OVER rare_run AS r, count(*) OVER rare_run AS m
                FROM (SELECT p.*, e.i, e.j, e.rare, e.i - row_number() OVER (PARTITION BY p.a, p.b, p.i0, p.j0, p.i1, p.j1, e.i - e.j ORDER BY e.i) AS g, e.i - row_number() OVER (PARTITION BY p.a, p.b, p.i0, p.j0, p.i1, p.j1, e.i - e.j, e.rare ORDER BY e.i) AS h
                    FROM parts p JOIN alike e ON e.a = p.a AND e.b = p.b AND e.i >= p.i0 AND e.i < p.i1 AND e.j >= p.j0 AND e.j < p.j1)
                WINDOW run AS (PARTITION BY a, b, i0, j0, i1, j1, i - j, g), rare_run AS (PARTITION BY a, b, i0, j0, i1, j1, i - j, rare, h))
            GROUP BY a, b, i0, i1, j0, j1), (VALUES (0), (1)) sides(side) WHERE best IS NOT NULL),
    matched AS (SELECT a, b, sum(size) AS size FROM parts GROUP BY a, b),
    shares AS (SELECT *, list_distinct(string_split(x, '')) AS xc, list_distinct(string_split(y, '')) AS yc, list_distinct(list_transform(range(1, greatest(length(x), 2)), lambda i: substr(x, CAST(i AS BIGINT), 2))) AS xg,
        list_distinct(list_transform(range(1, greatest(length(y), 2)), lambda i: substr(y, CAST(i AS BIGINT), 2))) AS yg FROM texts),
    scored AS (SELECT a, b, CASE WHEN x = '' OR y = '' THEN 0.0 WHEN x = y THEN 1.0 WHEN least(length(x), length(y)) >= 6 AND (contains(x, y) OR contains(y, x)) THEN 0.95 WHEN least(length(x), length(y)) < 4 THEN 0.0
        ELSE greatest(2.0 * size / (length(x) + length(y)), 0.9 * (2.0 * len(list_intersect(xc, yc)) / (len(xc) + len(yc))), 2.0 * len(list_intersect(xg, yg)) / (len(xg) + len(yg))) END AS similarity FROM shares JOIN matched USING (a, b))"""
