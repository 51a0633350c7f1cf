"""DuckDB SQL for the line rules, by window frames over rows of lines."""

from __future__ import annotations

from ..operators import rules as R


def quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _m(column: str, pattern: str) -> str:
    return f"coalesce(regexp_matches({column}, {quoted(pattern)}), false)"


def _frame(low: int, high: int) -> str:
    bound = lambda n: "CURRENT ROW" if n == 0 else f"{abs(n)} {'PRECEDING' if n < 0 else 'FOLLOWING'}"
    return f"OVER (PARTITION BY file_id ORDER BY line_no ROWS BETWEEN {bound(low)} AND {bound(high)})"


def _near(low: int, high: int, glue: str = "' '") -> str:
    return f"coalesce(string_agg(line, {glue}) {_frame(low, high)}, '')"


_CODE = "NOT regexp_matches(t, '^(#|//)')"
_TEXT = "string_agg(line, chr(10)) OVER (PARTITION BY file_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"
_SECRET_WORD = "CASE " + " ".join(f"WHEN contains(lower(line), '{w}') THEN '{n}'" for w, n in R.LOG_WORDS) + " END"


def _guarded(auth: str) -> str:
    last = f"max(CASE WHEN {_m('line', auth)} THEN line_no END) {_frame(-5, -1)}"
    stop = f"max(CASE WHEN NOT {_m('line', auth)} AND NOT regexp_matches(t, '^(@|$)') THEN line_no END) {_frame(-5, -1)}"
    return f"coalesce({last} > coalesce({stop}, -1), false)"


#: (condition over a line with its windows, whether only the first hit of a file counts)
_WHEN = {
    "R1": (f"path LIKE '%.py' AND {_m('line', R.VIEW)} AND NOT starts_with(t, '#') AND NOT {_guarded(R.VIEW_AUTH)} AND NOT {_m(_near(0, 4), R.VIEW_INLINE)}", False),
    "R2": (f"{_m('line', R.FIXED_ID)} AND {_CODE} AND NOT regexp_matches(line, '(def |param|Expected\\[)') AND NOT {_m('path', R.TEST_FILE)}", False),
    "R3": (f"{_m('line', R.ADMIN)} AND NOT {_m(_near(0, 9, 'chr(10)'), R.PERMISSION)} AND NOT regexp_matches(path, '(test_|_test|spec_)')", False),
    "R4": (f"regexp_matches(path, '\\.(js|ts)$') AND {_m('line', R.EXPRESS)} AND {_m('line', R.EXPRESS_PATHS)} AND NOT {_m('line', R.EXPRESS_AUTH)} AND NOT {_m(_near(1, 1), R.EXPRESS_AUTH)}", False),
    "R5": (f"path LIKE '%.py' AND {_m('line', R.FASTAPI)} AND {_m('line', R.FASTAPI_PATHS)} AND string_agg(line, '') {_frame(1, 1)} IS NOT NULL AND NOT contains({_near(1, 1)}, 'Depends(')", False),
    "R6": (f"path LIKE '%.py' AND {_m('line', R.FLASK)} AND NOT {_m('line', R.FLASK_PUBLIC)} AND NOT {_guarded(R.FLASK_AUTH)} AND NOT {_m(_near(0, 9), R.FLASK_INLINE)}", False),
    "R7": (f"{_m('line', R.SECRET)} AND NOT {_m('line', R.NO_SECRET)} AND {_CODE}", False),
    "R8": (f"{_m('line', R.SENSITIVE)} AND {_CODE} AND NOT {_m(_near(-1, 2), R.LOGGED)}", False),
    "R9": (f"{_m('line', R.LOG_CALL)} AND {_CODE} AND {_SECRET_WORD} IS NOT NULL", False),
    "R10": (f"{_m('line', R.AUTH_EVENT)} AND {_CODE} AND NOT {_m(_near(1, 3), R.AUTH_LOGGED)}", False),
    "R11": (f"{_m('line', R.TRANSACTION)} AND NOT {_m(_TEXT, R.TRANSACTION_LOGGED)}", True),
    "R12": (f"{_m('line', R.EXTERNAL)} AND {_CODE} AND NOT (({_m(_near(-3, 4), R.TRIES)} AND {_m(_near(-3, 4), R.CATCHES)}) OR contains({_near(-3, 4)}, 'with '))", False),
    "R13": (f"{_m('line', R.REQUEST)} AND {_CODE} AND NOT {_m(_near(0, 2), R.TIMEOUT)}", False),
    "R14": (f"{_m('line', R.API_CALL)} AND {_CODE} AND NOT {_m(_TEXT, R.RETRIES)}", True),
    "R15": (f"{_m('line', R.DATABASE)} AND {_CODE} AND NOT {_m(_near(-1, 2), R.HANDLED)}", False),
    "R16": (f"{_m('line', R.SERVICE)} AND {_CODE} AND len(regexp_extract_all({_TEXT}, {quoted(R.SERVICE)})) > 1 AND NOT {_m(_TEXT, R.BREAKER)}", True),
}


def _hits(rule: str) -> str:
    r, (condition, first) = R.RULES[rule], _WHEN[rule]
    severity = f"'{r.severity}'"
    description = quoted(r.description)
    if rule == "R6":
        severity = "CASE WHEN regexp_matches(line, '(POST|PUT|DELETE)') THEN 'critical' ELSE 'high' END"
        description = f"'Flask route ''' || regexp_extract(line, {quoted(R.FLASK)}, 1) || ''' missing authentication decorator or check'"
    if rule == "R9":
        description = f"'Sensitive data (' || {_SECRET_WORD} || ') in logging statement'"
    marked = f"SELECT *, ({condition}) AS hit FROM (SELECT *, trim(line, ' ' || chr(9) || chr(10) || chr(13)) AS t FROM code_lines) l"
    keep = "QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY line_no) = 1" if first else ""
    lower = "CASE WHEN path LIKE '%/test%' OR path LIKE '%test/%' THEN CASE s WHEN 'critical' THEN 'high' WHEN 'high' THEN 'medium' ELSE 'low' END ELSE s END"
    return f"""SELECT file_id, path, '{rule}' AS rule, '{r.control}' AS control_id, {lower} AS severity, description, line_no AS line_number, t AS code_snippet
      FROM (SELECT file_id, path, line_no, t, {severity} AS s, {description} AS description FROM ({marked}) m WHERE hit {keep}) h"""


def select(rule: str) -> str:
    return f"SELECT path, severity, description, line_number, code_snippet FROM ({_hits(rule)}) r"


def union(sql: str, rules: tuple[str, ...] = tuple(R.RULES)) -> str:
    return f"WITH found AS ({' UNION ALL '.join(map(_hits, rules))}) {sql}"
