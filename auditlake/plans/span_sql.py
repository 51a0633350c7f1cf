"""DuckDB SQL for spans of definitions and the findings inside them."""

from __future__ import annotations

from ..operators.corpus import HEADER, TOKEN
from ..operators.rules import VIEW_AUTH
from .rule_sql import quoted

_BEFORE = "OVER (PARTITION BY path ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"


def _next(token: str, value: str, level: str) -> str:
    return f"(SELECT min(o.{value}) FROM run o WHERE o.path = h.path AND o.k > h.k AND o.token = '{token}' AND o.{level} = h.depth)"


#: Tables that end with spans (path, kind, name, start_line, end_line).
SPANS = f"""
heads AS (SELECT path, line_no, line, length(regexp_extract(line, '^(\\s*)', 1)) AS indent FROM code_lines WHERE trim(line) <> '' AND path LIKE '%.py'),
ends AS (SELECT h.path, h.line_no, h.line, (SELECT min(o.line_no) FROM heads o WHERE o.path = h.path AND o.line_no > h.line_no AND o.indent <= h.indent) AS stop
  FROM heads h WHERE regexp_matches(h.line, '^\\s*(async\\s+)?(def|class)\\s+\\w+')),
script AS (SELECT path, max(line_no) AS n_lines, regexp_extract_all(string_agg(line, chr(10) ORDER BY line_no), {quoted(TOKEN)}) AS t FROM code_lines WHERE path LIKE '%.js' OR path LIKE '%.ts' GROUP BY path),
token AS (SELECT path, n_lines, unnest(t) AS token, unnest(range(len(t))) AS k FROM script),
run AS (SELECT *, depth - CASE WHEN token = '}}' THEN 1 ELSE 0 END AS level FROM (SELECT *, coalesce(sum(CASE WHEN token IN ('{{', '(', '[') THEN 1 WHEN token IN ('}}', ')', ']') THEN -1 ELSE 0 END) {_BEFORE}, 0) AS depth,
  1 + coalesce(sum(length(token) - length(replace(token, chr(10), ''))) {_BEFORE}, 0) AS line_no FROM token) r),
declared AS (SELECT path, n_lines, regexp_extract(token, {quoted(HEADER)}, 1) AS kind, regexp_extract(token, {quoted(HEADER)}, 2) AS name, line_no, {_next('{', 'k', 'depth')} AS opened, {_next(';', 'k', 'depth')} AS ended, {_next('}', 'line_no', 'level')} AS closed
  FROM run h WHERE regexp_matches(token, {quoted(HEADER)}) AND token[1] NOT IN ('/', '''', '"', '`')),
spans AS (SELECT path, CASE WHEN regexp_matches(line, '^\\s*class\\s') THEN 'class' ELSE 'function' END AS kind, regexp_extract(line, '(?:def|class)\\s+(\\w+)', 1) AS name, line_no AS start_line,
    (SELECT max(o.line_no) FROM heads o WHERE o.path = e.path AND (e.stop IS NULL OR o.line_no < e.stop)) AS end_line FROM ends e
  UNION ALL SELECT path, kind, name, CAST(line_no AS BIGINT), CAST(coalesce(closed, n_lines) AS BIGINT) FROM declared WHERE opened IS NOT NULL AND (ended IS NULL OR opened < ended))
"""


def within(kind: str, path: str, line: str) -> str:
    """The name of the first span of a kind that holds a line."""
    return f"(SELECT arg_min(s.name, s.start_line) FROM spans s WHERE s.kind = '{kind}' AND s.path = {path} AND {line} BETWEEN s.start_line AND s.end_line)"


SPAN_RULES = f"""WITH {SPANS}, held AS (SELECT path, name, start_line,
    (SELECT string_agg(c.line, chr(10) ORDER BY c.line_no) FROM code_lines c WHERE c.path = s.path AND c.line_no BETWEEN s.start_line AND s.end_line) AS body,
    EXISTS (SELECT 1 FROM code_lines c WHERE c.path = s.path AND c.line_no BETWEEN s.start_line - 5 AND s.start_line - 1 AND regexp_matches(c.line, {quoted('^\\s*' + VIEW_AUTH)})) AS guarded
  FROM spans s WHERE kind = 'function' AND path LIKE '%.py')
SELECT path, name, start_line, 'R17' AS rule FROM held WHERE contains(body, '(request') AND NOT guarded
UNION ALL SELECT path, name, start_line, 'R18' FROM held WHERE contains(body, '.execute(') AND (contains(body, 'f"') OR contains(body, '".format('))
UNION ALL SELECT path, name, start_line, 'R19' FROM held WHERE contains(body, 'HttpResponse(') AND contains(body, '<html') AND (contains(body, 'f"') OR contains(body, '+'))"""
