"""DuckDB SQL with the same rows as the queries."""

# ruff: noqa: E501

from treescan.operators.text import KEYWORDS, TOKEN
from treescan.plans.bindings import KINDS

INC = """inc AS (SELECT '/work/src/t' || l_orderkey || '.cpp' AS tu,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) AS seq,
  CASE WHEN l_partkey % 20 < 12 THEN '/work/include/h' ELSE '/usr/include/h' END || (l_partkey % 20) || '.h' AS header,
  l_returnflag = 'R' AS direct, CASE WHEN l_linestatus = 'O' THEN 'C_User' ELSE 'C_System' END AS inclusion_kind FROM lineitem)"""
HDR = INC + """,
hdr AS (SELECT tu, header, bool_or(direct) AS direct, arg_min(inclusion_kind, seq) AS inclusion_kind, min(seq) AS seq FROM inc GROUP BY tu, header)"""
ERR = """err AS (SELECT tu, arg_min(message, err_seq) AS error FROM (SELECT '/work/src/t' || o_orderkey || '.cpp' AS tu, o_custkey AS err_seq, o_orderpriority AS message FROM orders WHERE o_orderstatus = 'F') GROUP BY tu)"""
REQ = """req AS (SELECT DISTINCT '/work/src/t' || (l_orderkey * 2) || '.cpp' AS file FROM lineitem WHERE l_quantity >= 49),
cmd AS (SELECT o_orderkey AS cmd_seq, '/work/src/t' || o_orderkey || '.cpp' AS file FROM orders)"""
PATHS = r"""p0 AS (SELECT page_id AS seq, '/' || regexp_replace(regexp_extract(url, '^[A-Za-z]+://([^?#]*)', 1), '/+$', '') AS path FROM pages),
p AS (SELECT seq, path, split_part(path, '/', 2) AS host, regexp_extract(split_part(path, '/', 2), '[^.]+[.][^.]+$', 0) AS project FROM p0)"""
TREE = """ln AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) AS rn FROM lineitem),
t AS (
  SELECT 'root' AS node_id, NULL::VARCHAR AS parent_id, 0::BIGINT AS ordinal, 'root' AS kind, 'root' AS name, NULL::VARCHAR AS segment, NULL::VARCHAR AS status, NULL::VARCHAR AS priority, NULL::VARCHAR AS flag, NULL::VARCHAR AS linestatus
  UNION ALL SELECT 'r' || r_regionkey, 'root', r_regionkey, 'region', r_name, NULL, NULL, NULL, NULL, NULL FROM region
  UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, n_nationkey, 'nation', n_name, NULL, NULL, NULL, NULL, NULL FROM nation
  UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, c_custkey, 'customer', c_name, c_mktsegment, NULL, NULL, NULL, NULL FROM customer
  UNION ALL SELECT 'o' || o_orderkey, 'c' || o_custkey, o_orderkey, 'order', CAST(o_orderkey AS VARCHAR), NULL, o_orderstatus, o_orderpriority, NULL, NULL FROM orders
  UNION ALL SELECT 'l' || l_orderkey || '_' || rn, 'o' || l_orderkey, rn, 'line', CAST(rn AS VARCHAR), NULL, NULL, NULL, l_returnflag, l_linestatus FROM ln)"""
UP = (
    TREE
    + """,
up AS (
  SELECT a.node_id, a.parent_id AS p1, b.parent_id AS p2, c.parent_id AS p3, d.parent_id AS p4, e.parent_id AS p5,
    a.kind, a.name, a.ordinal AS o1, b.ordinal AS o2, c.ordinal AS o3, d.ordinal AS o4, e.ordinal AS o5,
    CASE WHEN a.parent_id IS NULL THEN 0 WHEN b.parent_id IS NULL THEN 1 WHEN c.parent_id IS NULL THEN 2 WHEN d.parent_id IS NULL THEN 3 WHEN e.parent_id IS NULL THEN 4 ELSE 5 END AS depth,
    a.segment
  FROM t a LEFT JOIN t b ON b.node_id = a.parent_id LEFT JOIN t c ON c.node_id = b.parent_id LEFT JOIN t d ON d.node_id = c.parent_id LEFT JOIN t e ON e.node_id = d.parent_id),
k AS (SELECT node_id, p1, p2, p3, p4, p5, kind, name, depth, segment,
    CASE depth WHEN 0 THEN -1 WHEN 1 THEN o1 WHEN 2 THEN o2 WHEN 3 THEN o3 WHEN 4 THEN o4 ELSE o5 END AS k1,
    CASE depth WHEN 2 THEN o1 WHEN 3 THEN o2 WHEN 4 THEN o3 WHEN 5 THEN o4 ELSE -1 END AS k2,
    CASE depth WHEN 3 THEN o1 WHEN 4 THEN o2 WHEN 5 THEN o3 ELSE -1 END AS k3,
    CASE depth WHEN 4 THEN o1 WHEN 5 THEN o2 ELSE -1 END AS k4,
    CASE depth WHEN 5 THEN o1 ELSE -1 END AS k5 FROM up),
pre AS (SELECT *, row_number() OVER (ORDER BY k1, k2, k3, k4, k5) - 1 AS pre FROM k)"""
)
TAGS = r"""body AS (SELECT page_id AS tu, regexp_replace(html, '(?s)<!--.*?-->|<script.*?</script>|<style.*?</style>|<!DOCTYPE[^>]*>', '', 'g') AS h FROM pages),
lists AS (SELECT tu, regexp_extract_all(h, '</?[a-zA-Z][a-zA-Z0-9]*[^>]*>', 0) AS l FROM body),
each AS (SELECT tu, unnest(l) AS tag, generate_subscripts(l, 1) AS seq FROM lists),
nm AS (SELECT tu, seq, lower(regexp_extract(tag, '^</?([a-zA-Z][a-zA-Z0-9]*)', 1)) AS kind, starts_with(tag, '</') AS closing, trim(regexp_extract(tag, '^</?[a-zA-Z][a-zA-Z0-9]*([^>]*)>', 1), ' ') AS attrs FROM each),
pr AS (SELECT *, CASE WHEN lead(closing) OVER (PARTITION BY tu, kind ORDER BY seq) THEN lead(seq) OVER (PARTITION BY tu, kind ORDER BY seq) ELSE seq END AS stop FROM nm),
tags AS (SELECT tu, tu || '_' || seq AS node_id, seq AS pre, seq, stop, kind, attrs FROM pr WHERE NOT closing)"""
SYN = f"""syn AS (SELECT *, l_orderkey || '_' || row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) AS node_id,
  list_value({", ".join(f"'{k}'" for k in KINDS)})[l_partkey % {len(KINDS)} + 1] AS kind, l_quantity > 25 AS large FROM lineitem)"""
PTS = """pts AS (SELECT event_id AS point_id, event_id % (SELECT count(*) FROM pages) AS tu, 1 + event_id % 60 AS seq FROM events)"""
LOG = r"""raw AS (SELECT user_id AS source, event_id AS seq, ts, event_id % 2 = 0 AS is_stderr, event_type AS et, coalesce(props, '') AS props, event_id % 97 AS ln, event_id % 31 AS cl, CAST(floor(coalesce(value, 0)) AS BIGINT) AS v, user_id FROM events),
lg AS (SELECT source, seq, ts,
  CASE et WHEN 'error' THEN 'Error' WHEN 'signup' THEN 'Debug' WHEN 'view' THEN 'Info' WHEN 'click' THEN 'Warning'
    ELSE CASE WHEN seq % 3 = 0 THEN 'Error' WHEN is_stderr THEN 'Warning' ELSE 'Info' END END AS level,
  CASE WHEN et IN ('error', 'signup', 'view', 'click') THEN user_id || ':' || ln || ':' || cl || ': ' || props
    WHEN seq % 3 = 0 THEN 'purchase error: ' || v ELSE 'purchase ' || v END AS message FROM raw)"""
LINES = r"""dl AS (SELECT doc_id, string_split(regexp_replace(text, '(\r\n|\n|\r)$', ''), chr(10)) AS l FROM documents WHERE text IS NOT NULL),
lines AS (SELECT doc_id AS file, generate_subscripts(l, 1) AS line_no, unnest(l) AS line FROM dl)"""


def hits(term: str) -> str:
    n = len(term)
    return f"""hl AS (SELECT file, line_no, string_split(lower(line), '{term}') AS ps FROM lines WHERE contains(lower(line), '{term}')),
hp AS (SELECT file, line_no, unnest(ps) AS piece, generate_subscripts(ps, 1) AS i, len(ps) AS n FROM hl),
hits AS (SELECT file, line_no, CAST(1 + (i - 1) * {n} + sum(length(piece)) OVER (PARTITION BY file, line_no ORDER BY i) AS BIGINT) AS col FROM hp QUALIFY i < n)"""


CURSORS = """cur AS (SELECT event_id AS cursor_id, event_id % (SELECT count(*) FROM documents) AS file, 1 + event_id % 5 AS line, 1 + event_id % 40 AS c FROM events)"""
NAV = """nav AS (SELECT user_id AS session, epoch_us(ts) AS seq, CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'purchase' THEN 3 WHEN 'signup' THEN 4 ELSE 5 END AS file, event_id % 2 AS line FROM events)"""
REPLAY = """ev AS (SELECT user_id AS session, epoch_us(ts) AS seq, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS k, 2 * CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'purchase' THEN 3 WHEN 'signup' THEN 4 ELSE 5 END + event_id % 2 AS place,
  CASE WHEN event_id % 11 = 0 THEN -1 ELSE 0 END AS delta FROM events),
st AS (SELECT DISTINCT session, 0::BIGINT AS k, []::BIGINT[] AS entries, 0::BIGINT AS cur FROM ev
  UNION ALL SELECT session, k, CASE WHEN grows THEN grown[-500:] ELSE entries END, CASE WHEN grows THEN least(len(grown), 500) WHEN delta <> 0 AND len(entries) > 0 AND cur + delta BETWEEN 1 AND len(entries) THEN cur + delta ELSE cur END
  FROM (SELECT st.session, ev.k, st.entries, st.cur, ev.delta, list_append(st.entries[1:st.cur], ev.place) AS grown, ev.delta = 0 AND (len(st.entries) = 0 OR st.entries[st.cur] <> ev.place) AS grows FROM st JOIN ev ON ev.session = st.session AND ev.k = st.k + 1)),
fin AS (SELECT * FROM st QUALIFY row_number() OVER (PARTITION BY session ORDER BY k DESC) = 1)"""
ROLL = """seg AS (SELECT seq, project, path, list_filter(string_split(path, '/'), lambda x: x <> '') AS parts FROM p),
sd AS (SELECT seq, project, parts, unnest(range(1, len(parts) + 1)) AS depth FROM seg),
roll AS (SELECT project, '/' || array_to_string(parts[1:depth], '/') AS path, parts[depth] AS name, depth, arg_min(depth = len(parts), seq) AS is_file, count(*) AS n_files FROM sd GROUP BY 1, 2, 3, 4)"""
#: The line that each event makes
K1 = "SELECT event_id AS seq, user_id AS source, CAST(event_id % 2 = 0 AS INTEGER) AS fd, CASE WHEN event_type IN ('error', 'signup', 'view', 'click') THEN '@diag' || chr(9) || CASE event_type WHEN 'error' THEN 'error' WHEN 'signup' THEN 'note' WHEN 'view' THEN 'info' ELSE 'warning' END || chr(9) || user_id || chr(9) || (event_id % 97) || chr(9) || (event_id % 31) || chr(9) || coalesce(props, '') WHEN event_id % 3 = 0 THEN 'purchase error: ' || CAST(floor(coalesce(value, 0)) AS BIGINT) ELSE 'purchase ' || CAST(floor(coalesce(value, 0)) AS BIGINT) END AS line FROM events"
ROOTS = """sg AS (SELECT host, project, path, list_filter(string_split(path, '/'), lambda x: x <> '') AS parts FROM p)"""


def common(by: str, source: str = "sg") -> str:
    """Longest common prefix of parts: by, root, n_files."""
    return f"""(SELECT {by}, CASE WHEN k = 0 THEN '' ELSE '/' || array_to_string(lo[1:k], '/') END AS root, n_files FROM (
  SELECT *, coalesce(list_min(list_filter(range(1, m + 1), lambda i: lo[i] <> hi[i])) - 1, m) AS k FROM (
  SELECT {by}, min(parts) AS lo, max(parts) AS hi, min(len(parts)) - 1 AS m, count(*) AS n_files FROM {source} GROUP BY {by})))"""


def tokens(keywords: list[str]) -> str:
    """Token classes of documents."""
    words = ", ".join(f"'{w}'" for w in keywords)
    return f"""WITH x AS (SELECT doc_id AS file, unnest(regexp_extract_all(coalesce(text, ''), '({TOKEN.replace("'", "''")})', 0)) AS t FROM documents),
w AS (SELECT file, t, regexp_extract(t, '^[A-Za-z_][A-Za-z0-9_]*', 0) AS word FROM x),
k AS (SELECT file, CASE WHEN regexp_matches(t, '^/[/*]') THEN 'comment' WHEN left(t, 1) IN (chr(34), chr(39)) THEN 'literal' WHEN regexp_matches(t, '^\\s*#') THEN 'preprocessor' WHEN word IN ({words}) THEN 'keyword' WHEN word <> '' AND ends_with(t, '(') THEN 'function' END AS k FROM w)
SELECT file, count(*) FILTER (WHERE k = 'keyword') AS n_keyword, count(*) FILTER (WHERE k = 'function') AS n_function, count(*) FILTER (WHERE k = 'preprocessor') AS n_preprocessor, count(*) FILTER (WHERE k = 'literal') AS n_literal, count(*) FILTER (WHERE k = 'comment') AS n_comment FROM k WHERE k IS NOT NULL GROUP BY file"""


ORACLES = {
    "dependency_report": f"WITH {HDR}, {ERR}, per AS (SELECT tu, count(*) AS header_count, count(*) FILTER (WHERE direct) AS direct_count FROM hdr GROUP BY tu) SELECT per.tu, header_count, direct_count, error IS NOT NULL AS partial_data, error FROM per LEFT JOIN err ON per.tu = err.tu ORDER BY 1",
    "s1_read_compile_commands": "SELECT 't' || o_orderkey || '.cpp' AS file, '/work/build' AS directory, 'cc|-Ia b|t' || o_orderkey || '.cpp' AS line FROM orders",
    "s7_write_ast_export": f"""WITH {TREE} SELECT node_id AS tu, '0' AS node_id, 'order' AS kind, NULL AS flag FROM t WHERE kind = 'order'
UNION ALL SELECT parent_id, '0.' || (row_number() OVER (PARTITION BY parent_id ORDER BY ordinal) - 1), 'line', flag FROM t WHERE kind = 'line'""",
    "s4_source_lines": f"WITH {LINES} SELECT file, line_no, line FROM lines",
    "s8_project_key": f"WITH {PATHS} SELECT path, substr(sha256(path), 1, 16) AS project_key FROM p",
    "s9_tu_status": "SELECT 'c' || o_custkey AS tu, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) IN ('F', 'O') AS failed FROM orders GROUP BY o_custkey",
    "s10_cache_collisions": f"WITH {PATHS} SELECT project, regexp_extract(path, '[^/]*$', 0) AS cache_name, count(*) AS n_tus FROM p GROUP BY 1, 2 HAVING count(*) > 1",
    "s11_write_diagnostics": "SELECT '@diag' || chr(9) || event_type || chr(9) || 'f ' || user_id || chr(9) || CASE WHEN event_id % 97 > 0 THEN CAST(event_id % 97 AS VARCHAR) ELSE '' END || chr(9) || CASE WHEN event_id % 31 > 0 THEN CAST(event_id % 31 AS VARCHAR) ELSE '' END || chr(9) || coalesce(props, '') AS value FROM events",
    "s2_read_dependencies": f"WITH {HDR} SELECT hdr.tu, header, direct, inclusion_kind FROM hdr JOIN orders ON hdr.tu = '/work/src/t' || o_orderkey || '.cpp'",
    "s6_write_dependencies": f"""WITH {HDR}, n AS (SELECT tu, count(*) AS n FROM hdr GROUP BY tu), o AS (SELECT 'c' || o_custkey AS project, '/work/src/t' || o_orderkey || '.cpp' AS tu, o_orderstatus FROM orders)
SELECT project, count(*) AS total_count, count(n.n) AS success_count, count(*) FILTER (WHERE o_orderstatus = 'F') AS failure_count, CAST(coalesce(sum(n.n), 0) AS BIGINT) AS total_header_count, count(*) FILTER (WHERE o_orderstatus = 'F') > 0 AS has_errors FROM o LEFT JOIN n ON n.tu = o.tu GROUP BY project""",
    "s3_ast_export": f"""WITH {TREE}, o AS (SELECT parent_id AS tu, node_id, '0.' || (row_number() OVER (PARTITION BY parent_id ORDER BY ordinal) - 1) AS path FROM t WHERE kind = 'order'),
l AS (SELECT o.tu, o.path || '.' || (row_number() OVER (PARTITION BY t.parent_id ORDER BY ordinal) - 1) AS path FROM t JOIN o ON t.parent_id = o.node_id WHERE kind = 'line')
SELECT node_id AS tu, '0' AS node_id, 'customer' AS kind, 0 AS depth FROM t WHERE kind = 'customer' UNION ALL SELECT tu, path, 'order', 1 FROM o UNION ALL SELECT tu, path, 'line', 2 FROM l""",
    "s5_read_diagnostics": "SELECT CASE event_type WHEN 'view' THEN 'Info' WHEN 'click' THEN 'Warning' WHEN 'purchase' THEN 'Debug' ELSE 'Error' END AS level, 'f' || event_id || ':' || (1 + event_id % 97) || CASE WHEN event_id % 31 > 0 THEN ':' || (event_id % 31) ELSE '' END || ': ' || coalesce(props, '') AS message FROM events",
    "p7_macro_spelling_range": "SELECT o_orderkey AS node_id, o_custkey % 3 AS macro_begin_file, o_orderkey % 5 AS macro_begin_line, o_orderkey % 5 + 1 AS macro_end_line FROM orders WHERE o_custkey % 3 > 0 AND o_orderkey % 5 > 0",
    "p10_explode_params": "SELECT l_orderkey AS node_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) - 1 AS pos, CAST(l_partkey AS VARCHAR) AS name, l_returnflag AS type FROM lineitem",
    "p10_explode_bases": "SELECT l_orderkey AS node_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) - 1 AS pos, 'B' || l_partkey AS type, l_returnflag = 'R' AS isVirtual, l_linestatus AS accessSpecifier FROM lineitem",
    "p10_explode_template_args": """SELECT o_orderkey AS node_id, '0' AS path, 'Type' AS kindName, o_orderpriority AS value FROM orders UNION ALL SELECT o_orderkey, '1.0', 'Type', o_orderstatus FROM orders
UNION ALL SELECT o_orderkey, '1.1.0', 'Integral', CAST(o_custkey AS VARCHAR) FROM orders UNION ALL SELECT o_orderkey, '2', 'Pack', NULL FROM orders""",
    "p12_normalize_flags": "SELECT o_orderkey AS cmd_seq, 'cc -fmodule-file=m' || (o_orderkey % 3) || '=../m/' || o_orderkey || '.pcm @flags' || (o_custkey % 30) || ' t' || o_orderkey || '.cpp -resource-dir /R' AS line FROM orders",
    "p13_module_map": "SELECT 't' || o_orderkey || '.cpp' AS file, 'm' || (o_orderkey % 3) AS name, '/work/m/' || o_orderkey || '.pcm' AS path FROM orders",
    "p14_expand_response_files": "SELECT o_orderkey AS cmd_seq, 'cc|-resource-dir|/r' || o_orderkey || '|-fmodule-file=m' || (o_orderkey % 3) || '=../m/' || o_orderkey || '.pcm|-resource-dir=/s' || o_orderkey || '|' || CASE WHEN n_name IS NULL THEN '@flags' || (o_custkey % 30) ELSE '-D' || n_name || ' x|-I a|-O2' END || '|t' || o_orderkey || '.cpp' AS line FROM orders LEFT JOIN nation ON n_nationkey = o_custkey % 30",
    "p1_select_sources": f"WITH {REQ} SELECT cmd_seq, file FROM cmd WHERE file IN (SELECT file FROM req)",
    "p1_missing_count": f"WITH {REQ} SELECT (SELECT count(*) FROM req) AS requested, (SELECT count(*) FROM cmd WHERE file IN (SELECT file FROM req)) AS kept, (SELECT count(*) FROM req) - (SELECT count(*) FROM cmd WHERE file IN (SELECT file FROM req)) AS missing_count",
    "p2_search_nodes": f"WITH {TREE} SELECT node_id, kind FROM t WHERE regexp_matches(concat_ws(chr(10), kind, name, segment, status, priority, flag, linestatus), '1', 'i') AND regexp_matches(kind, '^(?:order|line)$', 'i') AND status IS NOT NULL AND regexp_matches(status, '^(?:F)$', 'i')",
    "p2_search_bare": f"WITH {TREE} SELECT node_id, kind FROM t WHERE regexp_matches(concat_ws(chr(10), kind, name, segment, status, priority, flag, linestatus), 'build.*|urgent', 'i')",
    "p2_search_project": f"WITH {TAGS}, {PATHS}, rt AS (SELECT regexp_replace(min(path), '/[^/]*$', '') AS root FROM p) SELECT tags.node_id, tags.kind FROM tags JOIN p ON p.seq = tags.tu, rt WHERE (p.path = rt.root OR starts_with(p.path, rt.root || '/')) AND regexp_matches(tags.kind, '^(?:p|a|div)$', 'i')",
    "p3_is_under_root": f"WITH {PATHS} SELECT seq, path, path = '/' || host || '/en' OR starts_with(path, '/' || host || '/en/') AS under_root FROM p",
    "p4_source_files": f"WITH {PATHS} SELECT path, regexp_matches(path, '[.](html)$', 'i') AS is_source FROM p",
    "p5_located_nodes": f"WITH {TAGS} SELECT node_id, kind FROM tags WHERE pre % 5 <> 0",
    "p6_files_in_tree": f"WITH {TAGS}, {PATHS} SELECT seq AS file_id, path, seq IN (SELECT tu FROM tags WHERE kind = 'table') AS in_tree FROM p",
    "p8_node_label": f"WITH {TREE}, x AS (SELECT node_id, kind, name, coalesce(segment, priority, '') AS type, coalesce(flag, '') AS v FROM t) SELECT node_id, kind || CASE WHEN name <> '' THEN ' [' || name || ']' ELSE '' END || CASE WHEN type <> '' THEN ' : ' || type ELSE '' END || CASE WHEN kind = 'order' THEN ' {{static}}' ELSE '' END || CASE WHEN v <> '' THEN ' = ' || v ELSE '' END AS label FROM x",
    "p9_typed_view": "SELECT event_id AS node_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, json_extract_string(props, '$.page') AS page, json_extract_string(props, '$.ref') AS ref FROM events WHERE event_type = 'click'",
    "p9_typed_families": f"""WITH {SYN} SELECT node_id, CASE kind WHEN 'TypedefDecl' THEN 'TypedefNameDecl' ELSE kind END AS family, CASE kind
  WHEN 'EnumConstantDecl' THEN 'n' || l_partkey || '|' || l_suppkey WHEN 'ClassTemplateSpecializationDecl' THEN 'n' || l_partkey || '|' || l_linenumber || '|' || CAST(floor(l_quantity) AS INTEGER)
  WHEN 'TypedefDecl' THEN 'n' || l_partkey || '|' || l_returnflag WHEN 'IfStmt' THEN large || '|null|' || (NOT large) || '|null' WHEN 'BinaryOperator' THEN l_linestatus || '|' || l_linenumber || '|' || large || '|null|null|null'
  WHEN 'CXXNewExpr' THEN l_returnflag || '|' || large || '|null' WHEN 'LambdaExpr' THEN (NOT large) || '|null|null|' || l_linenumber END AS shown
FROM syn WHERE kind IN ('EnumConstantDecl', 'ClassTemplateSpecializationDecl', 'TypedefDecl', 'IfStmt', 'BinaryOperator', 'CXXNewExpr', 'LambdaExpr')""",
    "p11_flatten_properties": "SELECT event_id, 'k' AS key, json_extract_string(props, '$.k') AS value FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL",
    "j1_nodes_at": f"WITH {TAGS}, {PTS} SELECT point_id, node_id FROM pts JOIN tags ON tags.tu = pts.tu AND pts.seq BETWEEN tags.seq AND tags.stop",
    "j2_most_specific": f"""WITH {TAGS}, {PTS}, dp AS (SELECT a.node_id, count(b.node_id) AS depth FROM tags a LEFT JOIN tags b ON a.tu = b.tu AND b.seq < a.seq AND b.stop >= a.seq GROUP BY a.node_id),
c AS (SELECT point_id, tags.node_id, (stop // 8) - (tags.seq // 8) AS lines, CASE WHEN stop // 8 = tags.seq // 8 THEN stop - tags.seq ELSE 0 END AS cols, depth, pre FROM pts JOIN tags ON tags.tu = pts.tu AND pts.seq BETWEEN tags.seq AND tags.stop JOIN dp ON dp.node_id = tags.node_id)
SELECT point_id, node_id FROM c QUALIFY row_number() OVER (PARTITION BY point_id ORDER BY lines, cols, depth DESC, pre) = 1""",
    "j3_first_contained": f"WITH {TAGS}, {PTS} SELECT point_id AS range_id, arg_min(node_id, tags.seq) AS node_id FROM pts JOIN tags ON tags.tu = pts.tu AND tags.seq >= pts.seq AND tags.stop <= pts.seq + 16 GROUP BY point_id",
    "j4_with_file_path": f"WITH {TAGS}, {PATHS} SELECT node_id, coalesce(path, '') AS path FROM tags LEFT JOIN p ON p.seq = tags.tu",
    "j5_attach_errors": f"WITH {INC}, {ERR}, tus AS (SELECT DISTINCT tu FROM inc) SELECT tus.tu, error IS NOT NULL AS partial_data, error FROM tus LEFT JOIN err ON tus.tu = err.tu",
    "j6_context_chain": f"""WITH {UP}, e AS (SELECT node_id, CASE kind WHEN 'root' THEN 'TranslationUnitDecl' WHEN 'region' THEN 'NamespaceDecl' WHEN 'nation' THEN 'CXXRecordDecl' WHEN 'customer' THEN 'EnumDecl' WHEN 'order' THEN 'FunctionDecl' ELSE 'ParmVarDecl' END || '=' || name AS s FROM t)
SELECT up.node_id, concat_ws('/', e5.s, e4.s, e3.s, e2.s, e1.s, e0.s) AS chain FROM up JOIN e e0 ON e0.node_id = up.node_id LEFT JOIN e e1 ON e1.node_id = up.p1 LEFT JOIN e e2 ON e2.node_id = up.p2 LEFT JOIN e e3 ON e3.node_id = up.p3 LEFT JOIN e e4 ON e4.node_id = up.p4 LEFT JOIN e e5 ON e5.node_id = up.p5""",
    "j7_contexts_of_kind": f"""WITH {UP} SELECT context_group, n FROM (SELECT 'TranslationUnit' AS context_group, count(*) AS n FROM up UNION ALL SELECT 'Namespace', count(*) FROM up WHERE depth >= 1 UNION ALL SELECT 'Record', count(*) FROM up WHERE depth >= 2
UNION ALL SELECT 'Enum', count(*) FROM up WHERE depth >= 3 UNION ALL SELECT 'Function', count(*) FROM up WHERE depth >= 4 UNION ALL SELECT 'Other', count(*) FROM up WHERE depth >= 5)""",
    "j8_highlight_text": f"""WITH {LINES}, r AS (SELECT event_id AS range_id, event_id % (SELECT count(*) FROM documents) AS file, 1 + event_id % 3 AS bl, 1 + event_id % 7 AS bc, 1 + event_id % 3 + event_id % 2 AS el, 9 + event_id % 5 AS ec FROM events),
b AS (SELECT range_id, bl, el, bc, ec, line AS l1 FROM r JOIN lines ON lines.file = r.file AND line_no = bl),
e AS (SELECT range_id, line AS l2 FROM r JOIN lines ON lines.file = r.file AND line_no = el)
SELECT b.range_id, CASE WHEN bl = el THEN substr(l1, bc, greatest(ec - bc, 0)) ELSE substr(l1, bc) || chr(10) || substr(l2, 1, ec - 1) END AS text FROM b JOIN e ON b.range_id = e.range_id""",
    "j9_headers_for": f"WITH {HDR} SELECT DISTINCT tu, 0 AS ord, tu AS path FROM inc UNION ALL SELECT tu, row_number() OVER (PARTITION BY tu ORDER BY seq, header), header FROM hdr",
    "a1_dedupe_headers": f"WITH {HDR} SELECT tu, header, direct, inclusion_kind, seq FROM hdr",
    "a2_dependency_stats": f"WITH {HDR} SELECT (SELECT count(*) FROM orders) AS total_count, (SELECT count(DISTINCT tu) FROM inc) AS success_count, (SELECT count(*) FROM orders WHERE o_orderstatus = 'F') AS failure_count, (SELECT count(*) FROM hdr) AS total_header_count",
    "a3_merge_stats": f"WITH {HDR}, {ERR}, x AS (SELECT hdr.tu, count(*) AS n FROM hdr GROUP BY hdr.tu) SELECT count(*) AS total_count, count(*) AS success_count, count(error) AS failure_count, CAST(sum(n) AS BIGINT) AS total_header_count FROM x LEFT JOIN err ON x.tu = err.tu",
    "a3_merge_readable_chunks": f"WITH {HDR}, {ERR}, x AS (SELECT hdr.tu, count(*) AS n FROM hdr GROUP BY hdr.tu), y AS (SELECT regexp_extract(x.tu, '([0-9])[.]cpp$', 1) AS chunk, n, error FROM x LEFT JOIN err ON x.tu = err.tu) SELECT count(*) AS total_count, count(*) AS success_count, count(error) AS failure_count, CAST(sum(n) AS BIGINT) AS total_header_count, count(DISTINCT chunk) AS chunks FROM y WHERE chunk <> '3'",
    "a4_node_statistics": f"""WITH {SYN}, c AS (SELECT 't' || l_orderkey AS tu, l_linenumber, CASE kind WHEN 'Attr' THEN 'attr' WHEN 'ConceptReference' THEN 'conceptRef' WHEN 'CXXBaseSpecifier' THEN 'cxxBaseSpec' WHEN 'CXXCtorInitializer' THEN 'ctorInit' WHEN 'LambdaCapture' THEN 'lambdaCapture'
  WHEN 'NestedNameSpecifier' THEN 'nestedNameSpec' WHEN 'NestedNameSpecifierLoc' THEN 'nestedNameSpecLoc' WHEN 'TemplateArgument' THEN 'tempArg' WHEN 'TemplateArgumentLoc' THEN 'tempArgLoc' WHEN 'TemplateName' THEN 'tempName'
  ELSE CASE WHEN ends_with(kind, 'Decl') THEN 'decl' WHEN ends_with(kind, 'Type') THEN CASE WHEN l_suppkey % 2 = 0 THEN 'typeLoc' ELSE 'type' END ELSE 'stmt' END END AS k FROM syn)
SELECT tu, {", ".join(f"count(*) FILTER (WHERE k = '{k}') AS n_{k}" for k in "decl stmt type typeLoc attr conceptRef cxxBaseSpec ctorInit lambdaCapture nestedNameSpec nestedNameSpecLoc tempArg tempArgLoc tempName".split())},
  count(*) FILTER (WHERE l_linenumber = 1) AS n_comments, count(*) AS total FROM c GROUP BY tu""",
    "a4_extraction_stats": "SELECT 'db' AS tu, (SELECT count(*) FROM region) AS n_region, (SELECT count(*) FROM nation) AS n_nation, (SELECT count(*) FROM customer) AS n_customer, (SELECT count(*) FROM orders) AS n_order, (SELECT count(*) FROM lineitem) AS n_line, 0 AS n_comments, (SELECT count(*) FROM region) + (SELECT count(*) FROM nation) + (SELECT count(*) FROM customer) + (SELECT count(*) FROM orders) + (SELECT count(*) FROM lineitem) AS total",
    "a4_fleet_stats": f"WITH {TAGS} SELECT tu, kind AS category, count(*) AS n FROM tags GROUP BY ROLLUP (tu, kind)",
    "a5_dedupe_types": f"WITH {TAGS} SELECT node_id, min(pre) OVER (PARTITION BY tu, kind, attrs) AS data_id FROM tags",
    "a6_type_sharing_stats": f"""WITH {TAGS}, u AS (SELECT tu, kind, attrs, count(*) AS refs, max(strlen(kind || attrs) + 64) AS b FROM tags GROUP BY tu, kind, attrs),
s AS (SELECT tu, count(*) AS unique_types, sum(refs) AS type_references, sum(b) AS node_bytes FROM u GROUP BY tu), a AS (SELECT *, node_bytes // unique_types AS av FROM s)
SELECT tu, unique_types, CAST(type_references AS BIGINT) AS type_references, CAST(type_references - unique_types AS BIGINT) AS saved_nodes, CAST((type_references - unique_types) * av AS BIGINT) AS saved_bytes, round(type_references * 1.0::DOUBLE / unique_types, 4) AS ratio, round(100.0::DOUBLE * (type_references * av - node_bytes) / (type_references * av), 4) AS saved_percent FROM a""",
    "a7_string_pool_stats": """WITH v AS (SELECT lang AS s FROM documents UNION ALL SELECT source FROM documents), u AS (SELECT s, count(*) AS refs, strlen(s) + 32 AS b FROM v WHERE s IS NOT NULL GROUP BY s)
SELECT count(*) AS unique_strings, CAST(sum(refs) AS BIGINT) AS "references", CAST(sum(b) AS BIGINT) AS shared_bytes, CAST(sum(refs * b) AS BIGINT) AS unshared_bytes, round(100.0::DOUBLE * (sum(refs * b) - sum(b)) / sum(refs * b), 4) AS saved_percent FROM u""",
    "a8_register_files": f"WITH {PATHS}, f AS (SELECT regexp_replace(path, '/[^/]*$', '') AS path, min(seq) AS s, count(*) AS ref_count FROM p GROUP BY 1) SELECT row_number() OVER (ORDER BY s, path) AS file_id, path, ref_count FROM f",
    "a9_common_root": f"WITH {PATHS}, {ROOTS} SELECT host, root, n_files FROM {common('host')}",
    "a10_project_root": f"""WITH {PATHS}, {ROOTS}, w AS (SELECT project, root FROM {common("project")}),
sg2 AS (SELECT project, parts[1] AS top, parts FROM sg), cl AS (SELECT project, top, CASE WHEN root = '' THEN '/' || top ELSE root END AS root, n_files FROM {common("project, top", "sg2")}),
best AS (SELECT project, root FROM cl QUALIFY row_number() OVER (PARTITION BY project ORDER BY n_files DESC, top) = 1)
SELECT w.project, CASE WHEN w.root <> '' THEN w.root ELSE best.root END AS root FROM w JOIN best ON w.project = best.project""",
    "a10_project_root_with_database": f"""WITH {PATHS}, {ROOTS}, w AS (SELECT project, root FROM {common("project")}),
sg2 AS (SELECT project, parts[1] AS top, parts FROM (SELECT DISTINCT project, path, parts FROM sg)), cl AS (SELECT project, top, CASE WHEN root = '' THEN '/' || top ELSE root END AS root, n_files FROM {common("project, top", "sg2")}),
db AS (SELECT project, '/' || max(host) || '/build' AS dir FROM p GROUP BY project),
best AS (SELECT cl.project, root FROM cl JOIN db ON cl.project = db.project QUALIFY row_number() OVER (PARTITION BY cl.project ORDER BY n_files DESC, CASE WHEN dir = root OR starts_with(dir, root || '/') THEN 0 ELSE 1 END, top) = 1)
SELECT w.project, CASE WHEN ends_with(w.project, '.net') THEN '/over/ride' WHEN w.root <> '' THEN w.root ELSE best.root END AS root FROM w JOIN best ON w.project = best.project""",
    "a11_classify_headers": f"WITH {HDR} SELECT tu, count(*) FILTER (WHERE starts_with(header, '/work/') AND direct) AS project_direct, count(*) FILTER (WHERE starts_with(header, '/work/') AND NOT direct) AS project_indirect, count(*) FILTER (WHERE NOT starts_with(header, '/work/') AND direct) AS external_direct, count(*) FILTER (WHERE NOT starts_with(header, '/work/') AND NOT direct) AS external_indirect FROM hdr GROUP BY tu",
    "a12_directory_rollup": f"WITH {PATHS}, {ROLL} SELECT project, path, name, depth, is_file, n_files FROM roll",
    "a13_log_tabs": f"WITH {LOG}, s AS (SELECT source, CASE level WHEN 'Warning' THEN 'Info' ELSE level END AS tab FROM lg) SELECT source, tab, count(*) AS n FROM s GROUP BY source, tab UNION ALL SELECT source, 'All', count(*) FROM s GROUP BY source",
    "a16_first_errors": "SELECT CAST(user_id AS VARCHAR) AS tu, min(event_id) AS seq, CASE WHEN min(event_id) % 2 = 0 THEN CAST(user_id AS VARCHAR) ELSE 'x.h' END AS file, arg_min(props, event_id) AS message FROM events WHERE event_type IN ('signup', 'error') GROUP BY user_id",
    "w1_child_ordinals": f"WITH {TREE} SELECT node_id, CASE WHEN parent_id IS NULL THEN 0 ELSE row_number() OVER (PARTITION BY parent_id ORDER BY ordinal) - 1 END AS row FROM t",
    "w2_match_cycle": f"""WITH {UP}, m AS (SELECT node_id, pre FROM pre WHERE segment IS NOT NULL AND regexp_matches(segment, '^(?:.*ing)$', 'i'))
SELECT node_id, pre, row_number() OVER (ORDER BY pre) AS i, count(*) OVER () AS n, coalesce(lead(node_id) OVER (ORDER BY pre), (SELECT arg_min(node_id, pre) FROM m)) AS next_id, coalesce(lag(node_id) OVER (ORDER BY pre), (SELECT arg_max(node_id, pre) FROM m)) AS previous_id FROM m""",
    "w3_nav_history": f"""WITH {NAV}, x AS (SELECT *, lag(file) OVER w AS lf, lag(line) OVER w AS ll FROM nav WINDOW w AS (PARTITION BY session ORDER BY seq)), y AS (SELECT session, seq, file, line FROM x WHERE lf IS NULL OR lf <> file OR ll <> line),
z AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY seq DESC) AS new FROM y) SELECT session, seq, file, line, row_number() OVER (PARTITION BY session ORDER BY seq) AS pos FROM z WHERE new <= 500""",
    "w4_nav_history_replay": f"WITH RECURSIVE {REPLAY}, x AS (SELECT session, cur, unnest(entries) AS place, generate_subscripts(entries, 1) AS pos FROM fin) SELECT session, pos, place // 2 AS file, place % 2 AS line, 1 AS col, 1 AS node, 1 AS version, pos = cur AS is_current FROM x",
    "k5_nav_history_stream": f"WITH RECURSIVE {REPLAY}, l AS (SELECT session, max(seq) AS last_seq FROM ev GROUP BY session) SELECT fin.session, len(entries) AS n_entries, cur - 1 AS cursor, coalesce(entries[cur] // 2, 0) AS file, coalesce(entries[cur] % 2, 0) AS line, CASE WHEN cur > 0 THEN 1 ELSE 0 END AS col, CASE WHEN cur > 0 THEN 1 ELSE 0 END AS node, CASE WHEN cur > 0 THEN 1 ELSE 0 END AS version, last_seq, 0 AS batch FROM fin JOIN l ON l.session = fin.session",
    "w5_recent_queries": """WITH q AS (SELECT user_id AS "user", event_type || ' ' || (event_id % 9) AS query, max(ts) AS ts FROM events GROUP BY 1, 2)
SELECT "user", query, ts, row_number() OVER (PARTITION BY "user" ORDER BY ts DESC, query) AS rank FROM q QUALIFY row_number() OVER (PARTITION BY "user" ORDER BY ts DESC, query) <= 20""",
    "w6_retain_log": f"""WITH {LOG}, s AS (SELECT *, CASE level WHEN 'Warning' THEN 'Info' ELSE level END AS tab FROM lg), b AS (SELECT 'All' AS tab, seq, ts, level, source, message FROM s UNION ALL SELECT tab, seq, ts, level, source, message FROM s),
r AS (SELECT *, row_number() OVER (PARTITION BY tab ORDER BY ts DESC, seq DESC) AS rank FROM b)
SELECT tab, seq, rank, '[' || strftime(ts, '%Y-%m-%d %H:%M:%S') || '] [' || upper(level) || '] [' || source || '] ' || message AS line FROM r WHERE rank <= 5000""",
    "o1_order_tus": f"WITH {INC} SELECT DISTINCT tu FROM inc ORDER BY tu",
    "o2_order_directory_children": f"WITH {PATHS}, {ROLL} SELECT project, path, row_number() OVER (PARTITION BY project, regexp_replace(path, '/[^/]*$', '') ORDER BY is_file, lower(name), name) AS ord FROM roll",
    "o3_preorder": f"WITH {UP} SELECT node_id, pre, depth FROM pre",
    "u1_union_chunks": f"WITH {INC} SELECT tu, seq, header, direct, inclusion_kind FROM inc UNION ALL SELECT tu, seq, header, direct, inclusion_kind FROM inc WHERE seq = 1",
    "u2_dedupe_tus": f"WITH {PATHS} SELECT min(seq) AS seq, regexp_replace(path, '/[^/]*$', '') || '/f' AS path FROM p GROUP BY 2",
    "u3_split_project_external": f"WITH {PATHS} SELECT path AS tu, path = '/' || host || '/en' OR starts_with(path, '/' || host || '/en/') AS is_project, CASE WHEN starts_with(path, '/' || host || '/en/') THEN '[project] ' || substr(path, length(host) + 6) ELSE '[external] ' || path END AS shown FROM p",
    "u4_missing_sources": f"WITH {REQ} SELECT file FROM req EXCEPT SELECT file FROM cmd",
    "g1_node_depth": f"WITH {UP} SELECT node_id, depth FROM up",
    "g2_path_to_root": f"WITH {UP} SELECT node_id, concat_ws('/', p5, p4, p3, p2, p1, node_id) AS path FROM up",
    "g3_subtree": f"""WITH {UP}, r AS (SELECT node_id AS root_id FROM t WHERE kind = 'nation' OR node_id = 'r1'), a AS (SELECT node_id, node_id AS a FROM up UNION ALL SELECT node_id, p1 FROM up UNION ALL SELECT node_id, p2 FROM up UNION ALL SELECT node_id, p3 FROM up UNION ALL SELECT node_id, p4 FROM up UNION ALL SELECT node_id, p5 FROM up)
SELECT root_id, node_id FROM a JOIN r ON a.a = r.root_id""",
    "g4_subtree_size": f"""WITH {UP}, a AS (SELECT p1 AS a FROM up UNION ALL SELECT p2 FROM up UNION ALL SELECT p3 FROM up UNION ALL SELECT p4 FROM up UNION ALL SELECT p5 FROM up), b AS (SELECT a, count(*) AS n FROM a WHERE a IS NOT NULL GROUP BY a), c AS (SELECT p1, count(*) AS n FROM up WHERE p1 IS NOT NULL GROUP BY p1)
SELECT up.node_id, coalesce(b.n, 0) AS n_below, coalesce(c.n, 0) AS n_children FROM up LEFT JOIN b ON b.a = up.node_id LEFT JOIN c ON c.p1 = up.node_id""",
    "g4_height": f"""WITH {UP}, a AS (SELECT node_id AS a, 0 AS h FROM up UNION ALL SELECT p1, 1 FROM up UNION ALL SELECT p2, 2 FROM up UNION ALL SELECT p3, 3 FROM up UNION ALL SELECT p4, 4 FROM up UNION ALL SELECT p5, 5 FROM up)
SELECT a AS node_id, max(h) AS height FROM a WHERE a IS NOT NULL GROUP BY a""",
    "g5_filter_tree": f"WITH {PATHS}, {ROLL}, h AS (SELECT project, path FROM roll WHERE contains(lower(name), '7')) SELECT DISTINCT roll.project, roll.path FROM roll JOIN h ON roll.project = h.project AND (h.path = roll.path OR starts_with(h.path, roll.path || '/'))",
    "g6_include_closure": """WITH RECURSIVE e AS (SELECT src, dst FROM (SELECT p_partkey AS src, unnest([p_partkey - p_partkey % 64 + (p_partkey % 64 * 7 + 1) % 64, p_partkey - p_partkey % 64 + (p_partkey % 64 * 3 + 2) % 64]) AS dst FROM part) WHERE dst IN (SELECT p_partkey FROM part)),
c AS (SELECT src AS main, dst AS header FROM e UNION SELECT c.main, e.dst FROM c JOIN e ON e.src = c.header)
SELECT c.main, c.header, (c.main, c.header) IN (SELECT (src, dst) FROM e) AS direct FROM c""",
    "g7_reverse_dependents": f"WITH {HDR} SELECT header, count(DISTINCT tu) AS n_tus, count(DISTINCT CASE WHEN direct THEN tu END) AS n_direct FROM hdr GROUP BY header",
    "x1_find_text": f"WITH {LINES}, {hits('er')} SELECT file, line_no, col FROM hits",
    "x2_find_next": f"""WITH {LINES}, {hits("the ")}, {CURSORS}, j AS (SELECT cursor_id, line_no, hits.col, line_no < line OR (line_no = line AND hits.col < c) AS wrapped FROM cur JOIN hits ON hits.file = cur.file)
SELECT cursor_id, line_no, col, wrapped FROM j QUALIFY row_number() OVER (PARTITION BY cursor_id ORDER BY wrapped, line_no, col) = 1""",
    "x2_find_previous": f"""WITH {LINES}, {hits("the ")}, {CURSORS}, j AS (SELECT cursor_id, line_no, hits.col, line_no > line OR (line_no = line AND hits.col >= c) AS wrapped FROM cur JOIN hits ON hits.file = cur.file)
SELECT cursor_id, line_no, col, wrapped FROM j QUALIFY row_number() OVER (PARTITION BY cursor_id ORDER BY wrapped, line_no DESC, col DESC) = 1""",
    "k1_reassemble_lines": f"SELECT source, fd, line FROM ({K1}) k1",
    "k2_parse_log": f"WITH {LOG} SELECT seq, level, message FROM lg",
    "k3_log_counts_stream": f"WITH {LOG}, s AS (SELECT source, CASE level WHEN 'Warning' THEN 'Info' ELSE level END AS tab FROM lg) SELECT source, tab, count(*) AS n FROM s GROUP BY source, tab UNION ALL SELECT source, 'All', count(*) FROM s GROUP BY source",
    "k4_run_progress": """WITH g AS (SELECT user_id AS run, count(*) FILTER (WHERE event_id % 5 <> 0) AS completed, count(*) FILTER (WHERE event_id % 5 = 0) AS failed, 60 AS total FROM events GROUP BY user_id)
SELECT run, completed, failed, total, CASE WHEN completed + failed < total THEN 'running' WHEN failed = total THEN 'error' ELSE 'merged' END AS status FROM g""",
    "a14_comment_text": r"""WITH x AS (SELECT conv_id, turn, role, text, CASE WHEN turn % 2 = 1 AND right(text, 1) <> chr(10) THEN chr(10) ELSE '' END AS tail FROM conversations),
y AS (SELECT *, lag(right(text || tail, 1)) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS before FROM x)
SELECT conv_id AS comment_id, string_agg(CASE WHEN before IS NULL OR regexp_matches(before, '^\s$') OR regexp_matches(left(text, 1), '^\s$') THEN '' ELSE ' ' END || text || tail, '' ORDER BY turn, role, text) AS text FROM y GROUP BY conv_id""",
    "a15_token_profile": tokens(["the", "and", "of", "de", "la", "que", "der", "en"]),
    "a15_token_keywords": tokens(KEYWORDS),
    "w6_bounded_queue_stream": f"""WITH RECURSIVE {LOG}, e AS (SELECT user_id AS source, event_id AS seq, (epoch_us(ts) // 1000) // 172800000 AS slot, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k, max((epoch_us(ts) // 1000)) OVER () // 172800000 AS stop FROM events),
l AS (SELECT e.*, k1.line FROM e JOIN ({K1}) k1 ON k1.seq = e.seq),
tl AS (SELECT g.source, g.t, count(*) FILTER (e.slot < g.t) AS tail FROM (SELECT source, unnest(range(min(slot) + 1, max(stop) + 1)) AS t FROM e GROUP BY source) g JOIN e ON e.source = g.source GROUP BY g.source, g.t),
q AS (SELECT source, min(slot) AS t, 0::BIGINT AS was, 0::BIGINT AS lost, 0::BIGINT AS head FROM e GROUP BY source
  UNION ALL SELECT q.source, tl.t, q.head, greatest(q.head, tl.tail - 6), least(tl.tail, greatest(q.head, tl.tail - 6) + 2) FROM q JOIN tl ON tl.source = q.source AND tl.t = q.t + 1),
z AS (SELECT source, max(head) AS head FROM q GROUP BY source), n AS (SELECT source, count(*) AS n FROM e GROUP BY source)
SELECT l.source, l.seq, l.line, q.t AS tick, false AS dropped FROM l JOIN q ON q.source = l.source AND l.k > q.lost AND l.k <= q.head AND q.head > q.lost
UNION ALL SELECT l.source, l.seq, l.line, NULL, true FROM l JOIN q ON q.source = l.source AND l.k > q.was AND l.k <= q.lost
UNION ALL SELECT l.source, l.seq, l.line, NULL, true FROM l JOIN z ON z.source = l.source JOIN n ON n.source = l.source WHERE l.k > z.head AND l.k <= n.n - 6""",
    "k4_finished_runs_stream": """WITH RECURSIVE e AS (SELECT user_id AS run, event_id AS seq, (epoch_us(ts) // 1000) AS ms, CAST(event_id % 5 <> 0 AS BIGINT) AS ok, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k, max((epoch_us(ts) // 1000)) OVER () AS w FROM events),
r AS (SELECT run, 0::BIGINT AS k, 0::BIGINT AS c, 0::BIGINT AS f, 0::BIGINT AS seq, 0::BIGINT AS ms, 0::BIGINT AS gc, 0::BIGINT AS gf, 0::BIGINT AS gseq, 0::BIGINT AS w FROM e GROUP BY run
  UNION ALL SELECT x.run, x.k, CASE WHEN fresh THEN 0 ELSE x.c END + x.ok, CASE WHEN fresh THEN 0 ELSE x.f END + 1 - x.ok, x.seq, x.ms, CASE WHEN gone THEN x.c ELSE 0 END, CASE WHEN gone THEN x.f ELSE 0 END, x.before, x.w
  FROM (SELECT e.run, e.k, e.seq, e.ms, e.ok, e.w, r.c, r.f, r.seq AS before, r.c + r.f >= 20 OR e.ms - r.ms > 172800000 AS fresh, r.c + r.f BETWEEN 1 AND 19 AND e.ms - r.ms > 172800000 AS gone FROM r JOIN e ON e.run = r.run AND e.k = r.k + 1) x),
l AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY run ORDER BY k DESC) = 1)
SELECT run, c AS completed, f AS failed, 20 AS total, CASE WHEN f = 20 THEN 'error' ELSE 'merged' END AS status, seq AS last_seq FROM r WHERE c + f >= 20
UNION ALL SELECT run, gc, gf, 20, 'abandoned', gseq FROM r WHERE gc + gf > 0
UNION ALL SELECT run, c, f, 20, 'abandoned', seq FROM l WHERE c + f BETWEEN 1 AND 19 AND w - ms > 172800001""",
    "k5_ended_sessions_stream": f"""WITH RECURSIVE gaps AS (SELECT *, CAST(coalesce((epoch_us(ts) // 1000) - lag((epoch_us(ts) // 1000)) OVER (PARTITION BY user_id ORDER BY ts) > 86400000, false) AS BIGINT) AS gap FROM events),
parted AS (SELECT *, user_id * 1000 + sum(gap) OVER (PARTITION BY user_id ORDER BY ts) AS session FROM gaps),
{REPLAY.replace("user_id AS session", "session").replace("PARTITION BY user_id", "PARTITION BY session").replace("FROM events)", "FROM parted)")},
b AS (SELECT session, user_id, min((epoch_us(ts) // 1000)) AS began, max((epoch_us(ts) // 1000)) AS ended, count(*) AS n_events FROM parted GROUP BY session, user_id),
o AS (SELECT *, session = max(session) OVER (PARTITION BY user_id) AS open, max(ended) OVER () AS w FROM b)
SELECT o.user_id AS session, began, ended, n_events, len(entries) AS n_entries, cur - 1 AS cursor, coalesce(entries[cur] // 2, 0) AS file, coalesce(entries[cur] % 2, 0) AS line FROM o JOIN fin ON fin.session = o.session WHERE NOT open OR w - ended > 86400001""",
    "s3_deep_export": """SELECT CAST(c_nationkey AS VARCHAR) AS tu, CAST(k AS VARCHAR) AS node_id, CASE WHEN k > 0 THEN CAST(k - 1 AS VARCHAR) END AS parent_id, k AS depth, o_orderpriority AS kind
FROM (SELECT c_nationkey, o_orderpriority, row_number() OVER (PARTITION BY c_nationkey ORDER BY o_orderkey) - 1 AS k FROM orders JOIN customer ON c_custkey = o_custkey)""",
    "a7_string_pool_estimate": f"WITH {LINES}, u AS (SELECT line, count(*) AS refs, strlen(line) + 32 AS b FROM lines GROUP BY line) SELECT CAST(sum(refs) AS BIGINT) AS \"references\", CAST(sum(refs * b) AS BIGINT) AS unshared_bytes, count(*) AS unique_strings, true AS unique_near, true AS shared_near FROM u",
    "s8_project_tables": f"""WITH {PATHS}, r AS (SELECT project, row_number() OVER (ORDER BY count(*) DESC, project) AS place FROM p GROUP BY project)
SELECT p.project, '/' || p.project || '/cc.json' AS path, CASE WHEN place = 1 THEN 'two' ELSE 'one' END AS commit, count(*) AS n_files, CAST(sum(seq) AS BIGINT) AS sum_seq FROM p JOIN r ON r.project = p.project WHERE place <= 3 AND (place > 1 OR seq % 2 = 0) GROUP BY p.project, place""",
    "k1_paced_chunks": f"SELECT source, fd, line FROM ({K1}) k1",
    "s5_diagnostics_stream": "SELECT CASE event_type WHEN 'error' THEN 'Error' WHEN 'click' THEN 'Warning' ELSE 'Info' END AS level, 'f' || event_id || ':' || (1 + event_id % 97) || ': ' || event_type AS message FROM events",
}
