"""Independent DuckDB statements for the registered queries.

Written from the rules, not from the Spark plans: windows over whole runs, chained
replacements with markers, running counts. Small building blocks return CTE text.
"""

from __future__ import annotations

from ..functions.fingerprint import TOKEN_SHAPES
from ..operators.intents import FAILURE_MARKS

AS_OF = "2024-01-30"


def q(text: str) -> str:
    """SQL string literal."""
    return "'" + text.replace("'", "''") + "'"


# --- inputs -----------------------------------------------------------------------

RUNS = """runs AS (
  SELECT CAST(event_id AS VARCHAR) AS id, [event_type, 'u' || user_id] AS argv,
         'proj' || (user_id % 8) AS cwd, ts AS started_at, CAST(floor(value) AS BIGINT) AS wall_ms,
         ts + to_milliseconds(CAST(floor(value) AS BIGINT)) AS finished_at,
         CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS exit_code,
         4 * (40 + 7 * CAST(regexp_extract(props, '[0-9]+') AS BIGINT) + CAST(floor(value) AS BIGINT)) AS raw_bytes,
         40 + 7 * CAST(regexp_extract(props, '[0-9]+') AS BIGINT) + CAST(floor(value) AS BIGINT) AS tokens_in,
         20 + (event_id * 37) % 200 AS tokens_out, 'logs/' || event_id || '.log' AS log_path,
         CASE WHEN event_type = 'error' THEN 'debug:test-failure' END AS intent,
         user_id % 10 = 0 AS is_tty
  FROM events)"""

LINES_LOG = """lines AS (
  SELECT user_id AS run_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS line_no,
         strftime(ts, '%Y-%m-%dT%H:%M:%SZ') || ' ' ||
         CASE event_type WHEN 'error' THEN 'ERROR upstream timeout' WHEN 'purchase' THEN 'INFO charge accepted'
              ELSE 'INFO ' || event_type END ||
         ' from 10.0.' || (user_id % 256) || '.' || (event_id % 256) || ':443 path /srv/app/' || event_type
         || ' id ' || event_id AS line
  FROM events)"""

LINES_ANSI = """lines AS (
  SELECT user_id AS run_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS line_no,
         chr(27) || CASE event_type WHEN 'error' THEN '[1;31m' ELSE '[32m' END || upper(event_type)
         || chr(27) || '[0m user ' || user_id
         || CASE WHEN event_id % 50 = 0 THEN chr(27) || '[2K' ELSE '' END
         || CASE WHEN event_id % 97 = 0 THEN chr(27) || ']0;t' || event_id || chr(7) ELSE '' END AS line
  FROM events)"""

LINES_TABLE = """lines AS (
  SELECT o_custkey AS run_id, 1 AS line_no, rpad('ORDER', 12, ' ') || rpad('PRIORITY', 20, ' ') || 'STATUS' AS line
  FROM (SELECT DISTINCT o_custkey FROM orders)
  UNION ALL
  SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) + 1,
         rpad(CAST(o_orderkey AS VARCHAR), 12, ' ') || rpad(o_orderpriority, 20, ' ') || o_orderstatus FROM orders)"""

LINES_TREE = """nodes AS (
  SELECT r_regionkey AS run_id, '' AS k, 0 AS depth, r_name AS label FROM region
  UNION ALL SELECT n_regionkey, n_name, 1, n_name FROM nation
  UNION ALL SELECT n_regionkey, n_name || '/' || lpad(CAST(s_suppkey AS VARCHAR), 9, '0'), 2, s_name
    FROM supplier JOIN nation ON s_nationkey = n_nationkey
  UNION ALL SELECT n_regionkey, n_name || '/' || lpad(CAST(s_suppkey AS VARCHAR), 9, '0') || '/' || i, 3,
                   'part ' || s_suppkey || '-' || i
    FROM supplier JOIN nation ON s_nationkey = n_nationkey, (SELECT unnest([1, 2]) AS i) WHERE s_suppkey % 2 = 0
  UNION ALL SELECT n_regionkey, n_name || '/' || lpad(CAST(s_suppkey AS VARCHAR), 9, '0') || '/2/0', 4,
                   'lot ' || s_suppkey
    FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_suppkey % 4 = 0),
lines AS (
  SELECT run_id, row_number() OVER (PARTITION BY run_id ORDER BY k) AS line_no,
         repeat('  ', depth) || label AS line FROM nodes)"""

LINES_DIFF = """numbered AS (
  SELECT l_orderkey // 50 AS run_id, row_number() OVER (PARTITION BY l_orderkey // 50
           ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) AS line_no, *
  FROM lineitem),
lines AS (
  SELECT run_id, line_no, CASE (line_no - 1) % 8
    WHEN 0 THEN 'diff --git a/f' || l_partkey || ' b/f' || l_partkey WHEN 1 THEN '--- a/f' || l_partkey
    WHEN 2 THEN '+++ b/f' || l_partkey WHEN 3 THEN '@@ -1,3 +1,4 @@' WHEN 4 THEN '-old ' || l_suppkey
    WHEN 5 THEN '+new ' || l_suppkey ELSE 'context ' || l_returnflag || l_linestatus END AS line
  FROM numbered)"""


def conversation_texts(gap: str) -> str:
    return f"""texts AS (SELECT conv_id AS doc_id, string_agg(text, {gap} ORDER BY turn) AS text
  FROM conversations GROUP BY conv_id)"""


DOCUMENTS = "texts AS (SELECT doc_id, text FROM documents)"


def lines_of(texts: str, key: str = "doc_id") -> str:
    """Lines of the CTE ``texts``; one trailing CR dropped, no final empty piece."""
    return f"""{texts},
pieces AS (SELECT {key} AS run_id, string_split(text, chr(10)) AS ps FROM texts),
trimmed AS (SELECT run_id, CASE WHEN ps[-1] = '' THEN ps[1:len(ps) - 1] ELSE ps END AS ps FROM pieces),
lines AS (SELECT run_id, unnest(range(1, len(ps) + 1)) AS line_no,
                 regexp_replace(unnest(ps), '\\r$', '') AS line FROM trimmed)"""


LINES_DOC = lines_of(DOCUMENTS)
LINES_GAPS = lines_of(conversation_texts("' ' || chr(10) || chr(10) || chr(10)"))

# --- scalar rules -----------------------------------------------------------------


def fp(x: str) -> str:
    """Fingerprint: mark every token, then name the marked pieces one shape at a time."""
    shapes = "|".join(s.replace("++", "+").replace("{2,}+", "{2,}") for s in TOKEN_SHAPES)
    marked = f"regexp_replace({x}, {q('(' + shapes + ')')}, chr(1) || '\\1' || chr(2), 'g')"
    for pattern, name in [
        (r"\x01(/|[A-Za-z]:\\)[^\x02]*\x02", "<PATH>"),
        (r"\x010x[^\x02]*\x02", "<HEX>"),
        (r"\x01\d{4}-\d{2}-\d{2}[T ][^\x02]*\x02", "<ISO8601>"),
        (r"\x01\d{1,3}\.[^\x02]*\x02", "<IP>"),
        (r"\x01\d+\x02", "<NUM>"),
        (r"\x01[^\x02]*\x02", "<UUID>"),
    ]:
        marked = f"regexp_replace({marked}, {q(pattern)}, {q(name)}, 'g')"
    return marked


def rtrim(x: str) -> str:
    return f"regexp_replace({x}, '\\s+$', '')"


def tokens(n: str) -> str:
    return f"CAST(({n} + 3) // 4 AS BIGINT)"


def pct(i: str, o: str) -> str:
    return (f"round(CASE WHEN {i} = 0 THEN 0e0 ELSE CAST(greatest({i} - {o}, 0) AS DOUBLE) "
            f"/ CAST({i} AS DOUBLE) * 100e0 END, 6)")


def size_text(n: str) -> str:
    return (f"CASE WHEN {n} < 1024 THEN {n} || ' B' WHEN {n} < 1048576 THEN printf('%.1f', {n} / 1024e0) || ' KB' "
            f"WHEN {n} < 1073741824 THEN printf('%.1f', {n} / 1048576e0) || ' MB' "
            f"ELSE printf('%.1f', {n} / 1073741824e0) || ' GB' END")


def gap_start(k: str) -> str:
    return (f"(list_sum(list_transform(pcs[1:{k}], lambda x: strlen(x))) "
            f"+ coalesce(list_sum(list_transform(gaps[1:{k} - 1], lambda x: strlen(x))), 0))")


# --- classification and compaction ------------------------------------------------

def classified(bytes_of: str | None = None, window: int = 20) -> str:
    """Scores and archetype per run of the CTE ``lines``.

    ``bytes_of`` is a CTE with (run_id, n_bytes, ends_newline) where the text is at hand.
    """
    if bytes_of is None:
        sizes = """sizes AS (SELECT run_id, CAST(sum(strlen(line)) + count(*) AS BIGINT) AS n_bytes,
                 true AS ends_newline FROM lines GROUP BY run_id)"""
    else:
        sizes = f"sizes AS ({bytes_of})"
    return f"""{sizes},
counts AS (SELECT run_id, count(*) AS n_lines FROM lines GROUP BY run_id),
smp AS (SELECT run_id, line_no, line, string_split_regex(line, ' {{2,}}') AS pcs,
               regexp_extract_all(line, ' {{2,}}') AS gaps FROM lines WHERE line_no <= {window}),
sig AS (SELECT run_id, line, strlen(line) >= 8 AS usable, {fp('line')} AS fp,
               list_transform(list_filter(range(1, len(gaps) + 1), lambda k: {gap_start('k')} > 0),
                              lambda k: {gap_start('k')} // 4) AS sig FROM smp),
tops AS (SELECT run_id, max(c) AS top FROM (SELECT run_id, sig, count(*) AS c FROM sig
           WHERE usable AND len(sig) > 0 GROUP BY run_id, sig) GROUP BY run_id),
raws AS (SELECT run_id, count(*) AS n, count(*) FILTER (usable) AS usable, count(DISTINCT fp) AS fps,
           count(*) FILTER (starts_with(line, '  ') OR starts_with(line, chr(9)) OR starts_with(line, '├')
                            OR starts_with(line, '└') OR starts_with(line, '│')) AS marked
         FROM sig GROUP BY run_id),
scores AS (SELECT run_id,
    CASE WHEN usable < 3 THEN 0e0 ELSE CAST(coalesce(top, 0) AS DOUBLE) / usable END AS tabular_score,
    CAST(marked AS DOUBLE) / n AS tree_score,
    CASE WHEN n < 4 THEN 0e0 ELSE (0.35e0 + 0.65e0 * (1e0 - CAST(fps AS DOUBLE) / n)) * (CAST(n AS DOUBLE) / 20e0) END AS linear_score
  FROM raws LEFT JOIN tops USING (run_id)),
kinds AS (SELECT *, greatest(tabular_score, tree_score, linear_score) AS best,
    CASE WHEN best < 0.55e0 THEN 'passthrough' WHEN linear_score = best THEN 'linear-log'
         WHEN tree_score = best THEN 'tree' ELSE 'tabular' END AS scored FROM scores),
facts AS (SELECT run_id, n_lines, n_bytes, ends_newline, tabular_score, tree_score, linear_score,
    n_bytes < 256 AS is_short, CASE WHEN n_bytes < 256 THEN 'passthrough' ELSE scored END AS archetype
  FROM kinds JOIN counts USING (run_id) JOIN sizes USING (run_id))"""


def compacted(force: str | None = None) -> str:
    """CTE ``outl(run_id, ord, line)`` and ``shape`` with the route of each run."""
    shape = f"""shape AS (SELECT * REPLACE ({q(force)} AS archetype, false AS is_short) FROM facts)""" if force \
        else "shape AS (SELECT * FROM facts)"
    return f"""{shape},
routed AS (SELECT *, CASE WHEN is_short OR (archetype = 'tabular' AND n_lines <= 7)
                            OR (archetype = 'linear-log' AND n_lines <= 5) THEN 'raw' ELSE archetype END AS route FROM shape),
j AS (SELECT l.run_id, l.line_no, l.line, r.n_lines AS n, r.route FROM lines l JOIN routed r ON l.run_id = r.run_id),
o_raw AS (SELECT run_id, line_no * 2 AS ord, line FROM j WHERE route = 'raw'),
tok AS (SELECT run_id, string_split_regex({rtrim('line')}, '\\s+')[-1] AS token FROM j
        WHERE route = 'tabular' AND line_no > 4 AND line_no <= n - 3),
tokn AS (SELECT run_id, token, count(*) AS c FROM tok WHERE token <> '' GROUP BY run_id, token),
notes AS (SELECT run_id, string_agg(c || ' ' || token, ', ' ORDER BY c DESC, token) AS note FROM tokn
          GROUP BY run_id HAVING count(*) <= 8),
o_tab AS (SELECT run_id, line_no * 2 AS ord, line FROM j WHERE route = 'tabular' AND (line_no <= 4 OR line_no > n - 3)
  UNION ALL SELECT r.run_id, 9, '... [' || (n_lines - 7) || ' rows folded' || coalesce(': ' || note, '') || '] ...'
            FROM routed r LEFT JOIN notes USING (run_id) WHERE route = 'tabular'),
tmpl AS (SELECT run_id, {fp('line')} AS fp, min(line_no) AS f, arg_min(line, line_no) AS s, count(*) AS c
         FROM j WHERE route = 'linear-log' AND line_no <= n - 5 GROUP BY run_id, fp),
o_log AS (SELECT run_id, f * 2 AS ord, s || CASE WHEN c > 1 THEN '  × ' || c ELSE '' END AS line FROM tmpl
  UNION ALL SELECT run_id, (n_lines - 5) * 2 + 1, '--- last 5 lines ---' FROM routed WHERE route = 'linear-log'
  UNION ALL SELECT run_id, line_no * 2, line FROM j WHERE route = 'linear-log' AND line_no > n - 5),
ind AS (SELECT run_id, line_no, line, n, regexp_extract(line, '^[ \\t│├└─]*') AS pre FROM j WHERE route = 'tree'),
dep AS (SELECT run_id, line_no, line, n,
          (length(pre) + 3 * length(regexp_replace(pre, '[ ─]', '', 'g'))) // 2 AS d FROM ind),
t1 AS (SELECT *, count(*) FILTER (d = 3) OVER w AS c3,
         last_value(CASE WHEN d <= 2 THEN d END IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev
       FROM dep WINDOW w AS (PARTITION BY run_id ORDER BY line_no)),
t2 AS (SELECT *, coalesce(d <= 2 AND prev = 2, false) AS fl FROM t1),
t3 AS (SELECT *, CASE WHEN fl THEN c3 - coalesce(max(CASE WHEN fl THEN c3 END) OVER
         (PARTITION BY run_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) END AS pend FROM t2),
o_tree AS (SELECT run_id, line_no * 2 AS ord, line FROM t3 WHERE d <= 2
  UNION ALL SELECT run_id, line_no * 2 - 1, '      ... [' || pend || ' more]' FROM t3 WHERE pend > 0
  UNION ALL SELECT run_id, 2 * n + d, repeat('  ', CAST(d - 1 AS INT)) || '... [' || c || ' more at depth ' || d || ']'
    FROM (SELECT run_id, n, d, count(*) - CASE WHEN d = 3 THEN coalesce((SELECT sum(pend) FROM t3 x WHERE x.run_id = y.run_id), 0)
                                          ELSE 0 END AS c
          FROM t3 y WHERE d > 2 GROUP BY run_id, n, d) WHERE c > 0),
bl AS (SELECT run_id, line_no, {rtrim('line')} AS t FROM j WHERE route = 'passthrough'),
o_pass AS (SELECT run_id, line_no * 2 AS ord, t AS line FROM
    (SELECT *, lag(t) OVER (PARTITION BY run_id ORDER BY line_no) AS before FROM bl)
  WHERE NOT (t = '' AND coalesce(before = '', false))),
outl AS (SELECT * FROM o_raw UNION ALL SELECT * FROM o_tab UNION ALL SELECT * FROM o_log
         UNION ALL SELECT * FROM o_tree UNION ALL SELECT * FROM o_pass)"""


NUMBERED = """numbered_out AS (
  SELECT run_id, CAST(row_number() OVER (PARTITION BY run_id ORDER BY ord) AS BIGINT) AS out_no, line FROM outl)"""


def focused(source: str) -> str:
    """CTE ``focus(run_id, out_no, line)``: failure context over ``source``."""
    hit = " OR ".join(f"contains(line, {q(m)})" for m in FAILURE_MARKS)
    return f"""f1 AS (SELECT *, CAST(({hit}) AS INT) AS hit FROM {source}),
f2 AS (SELECT *, max(hit) OVER (PARTITION BY run_id ORDER BY out_no ROWS BETWEEN 10 PRECEDING AND 10 FOLLOWING) AS keep,
              max(hit) OVER (PARTITION BY run_id) AS any_hit FROM f1),
f3 AS (SELECT *, coalesce(lag(keep) OVER (PARTITION BY run_id ORDER BY out_no), 0) AS kept_before FROM f2),
focus AS (SELECT run_id, out_no, CASE WHEN any_hit = 0 OR keep = 1 THEN line ELSE '...' END AS line
          FROM f3 WHERE any_hit = 0 OR keep = 1 OR kept_before = 1)"""


OUT_LINES = "SELECT run_id, out_no, line FROM numbered_out"


def out_lines(lines: str, force: str | None = None) -> str:
    return f"WITH {lines}, {classified()}, {compacted(force)}, {NUMBERED} {OUT_LINES}"


def report(lines: str) -> str:
    return f"""WITH {lines}, {classified()}, {compacted()},
sz AS (SELECT run_id, count(*) AS out_lines, CAST(sum(strlen(line)) + count(*) AS BIGINT) AS b FROM outl GROUP BY run_id),
b AS (SELECT run_id, archetype, n_lines, n_bytes, out_lines,
        b - CASE WHEN route = 'raw' AND NOT is_short THEN 1 ELSE 0 END AS out_bytes FROM routed JOIN sz USING (run_id))
SELECT run_id, archetype, n_lines, n_bytes, out_lines, out_bytes, {tokens('n_bytes')} AS tokens_in,
  {tokens('out_bytes')} AS tokens_out, greatest({tokens('n_bytes')} - {tokens('out_bytes')}, 0) AS tokens_saved,
  {pct(tokens('n_bytes'), tokens('out_bytes'))} AS savings_pct FROM b"""


def texts_compacted(texts: str, key: str = "doc_id") -> str:
    """CTE ``done(run_id, archetype, text, compacted)`` for one-text-per-row input."""
    size = f"""SELECT {key} AS run_id, CAST(strlen(text) AS BIGINT) AS n_bytes,
                      ends_with(text, chr(10)) AS ends_newline FROM texts"""
    return f"""{lines_of(texts, key)}, {classified(size)}, {compacted()},
glued AS (SELECT run_id, string_agg(line, chr(10) ORDER BY ord) AS t FROM outl GROUP BY run_id),
done AS (SELECT x.{key} AS run_id, coalesce(r.archetype, 'passthrough') AS archetype, x.text,
    CASE WHEN strlen(x.text) < 256 THEN x.text WHEN r.route = 'raw' THEN t ELSE t || chr(10) END AS compacted
  FROM texts x LEFT JOIN routed r ON r.run_id = x.{key} LEFT JOIN glued g ON g.run_id = x.{key})"""


TOKEN_COLUMNS = f"""{tokens('strlen(text)')} AS tokens_in, {tokens('strlen(compacted)')} AS tokens_out"""
