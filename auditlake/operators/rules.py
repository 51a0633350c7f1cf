"""Line-context rules over arrays of lines, of whole files or of blocks of them: only hits become rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.severity import downgrade, trimmed

# Patterns of the rules.
VIEW = r"^\s*def\s+\w+\s*\(\s*request"
VIEW_AUTH = r"@(login_required|permission_required|require_http_methods|csrf_exempt|require_permission)"
VIEW_INLINE = r"(is_authenticated|current_user|if not request\.user)"
FIXED_ID = r"""(user_?id|account_?id)\s*=\s*(\d+|['"][\d]+['"])"""
TEST_FILE = r"(test_|_test|spec_|mock|faker|fixture)"
ADMIN = r"^\s*(?:async\s+)?def\s+\w*(delete|remove|ban|suspend|promote|demote|admin|moderate|grant|revoke|archive|purge)\w*\s*\("
PERMISSION = r"(is_staff|is_superuser|is_admin|permission|role|authorize|check_permission|require_role)"
EXPRESS = r"""router\.(get|post|put|delete|patch)\s*\(\s*['"]([^'"]*)['"]\s*,\s*(?:async\s+)?\(req,\s*res"""
EXPRESS_AUTH = r"(authMiddleware|isAuthenticated|verifyToken|requireAuth|auth\()"
EXPRESS_PATHS = r"""['"]/(admin|user|account|profile|settings|api|private|protected)"""
FASTAPI = r"""@(?:app|router)\.(get|post|put|delete|patch)\s*\(['"]([^'"]*)['"]\)"""
FASTAPI_PATHS = r"""['"]/(admin|user|account|profile|settings|internal|private)"""
FLASK = r"""@(?:app|blueprint|bp)\s*\.\s*route\s*\(\s*['"]([^'"]*)['"]\s*"""
FLASK_AUTH = r"@(login_required|permission_required|auth_required|requires_auth|require_permission|jwt_required)"
FLASK_PUBLIC = r"""['"]/(login|register|signup|logout|public|health|ping|static)"""
FLASK_INLINE = r"""(request\.headers\.get\s*\(\s*['"](Authorization|auth|token)['"]|verify_jwt|verify_token|check_auth|is_authenticated|current_user)"""
SECRET = r"""((password|passwd|secret|token|api_?key|aws_\w+)["']?\s*[:=]\s*["'][^"'\s]{6,}["'])|["'](sk-[A-Za-z0-9]{8,}|AKIA[A-Z0-9]{16})["']"""
NO_SECRET = r"(os\.getenv|os\.environ|process\.env|\$\{|\{\{|<[^>]*>)"
SENSITIVE = r"(\.save\(\)|\.delete\(\)|\.create\(|\.update\(|\.remove\(|UPDATE\s+|INSERT\s+|DELETE\s+FROM)"
LOGGED = r"(logger|logging|log\(|console\.log|print\(|audit|syslog|trace|debug|info|warn)"
LOG_CALL = r"(logger|print|console|log)\s*(\.\w+)?\s*\("
LOG_WORDS = (
    ("password", "password"), ("pwd", "password"), ("secret", "secret"), ("api_key", "API key"), ("apikey", "API key"), ("token", "token"),
    ("ssn", "SSN"), ("social", "social security"), ("card_number", "credit card"), ("card", "credit card"), ("cvv", "CVV"),
)
AUTH_EVENT = r"^\s*def\s+(login|authenticate|verify_token|verify_password|validate_credentials)\b"
AUTH_LOGGED = r"(logger|logging|log\(|console\.log|print\(|audit)"
TRANSACTION = r"\b(BEGIN|COMMIT|ROLLBACK|START TRANSACTION|begin_transaction|commit|rollback)\b"
TRANSACTION_LOGGED = r"(logger|logging|log\(|console\.log|print\(|audit|transaction.log)"
EXTERNAL = r"(requests\.(get|post|put|delete|patch|request)|urllib\.|httpx\.|aiohttp\.|fetch\(|axios\.|\.query\()"
TRIES = r"(try:|try\s*\{|try\(|with\s+)"
CATCHES = r"(except|catch\s*\(|except\s+|\.catch\()"
REQUEST = r"(requests\.(get|post|put|delete|patch)|fetch|\.query|aiohttp\.get|axios\.(get|post)|httpx\.(get|post|AsyncClient)|http\.request)\s*\("
TIMEOUT = r"(timeout\s*=|timeout:|\.timeout\(|timeout\s*:|timeout\s*,)"
API_CALL = r"(requests\.(get|post)|\.query\(|http\.request|fetch|axios\.)"
RETRIES = r"(@retry|retry|Retry|@tenacity|backoff|exponential|max_retries|retry_count|attempt|retries\s*=)"
DATABASE = r"(\.execute\(|\.query\(|cursor\.execute|db\.query|connection\.execute|database\.query)"
HANDLED = r"(except|catch|try|error|Error)"
SERVICE = r"(requests\.(get|post)|http\.(get|post)|fetch|axios\.)"
BREAKER = r"(circuit_breaker|CircuitBreaker|@circuit_breaker|Hystrix|bulkhead|breaker)"


def _code(line: Column) -> Column:
    return ~trimmed(line).rlike("^(#|//)")


def _near(i: Column, low: int, high: int, glue: str = " ") -> Column:
    """Lines i + low to i + high of the file, those that exist, as one text; i counts from 0."""
    start = F.greatest(i + low, F.lit(0))
    return F.array_join(F.slice("lines", start + 1, F.greatest(i + high - start + 1, F.lit(0))), glue)


def _guarded_above(i: Column, auth: str) -> Column:
    """Whether one of the five lines above has an auth decorator, with only decorators and blank lines in between."""
    rows = F.filter(F.sequence(i - 5, i - 1), lambda k: k >= 0)
    line = lambda k: F.get("lines", k)
    last = F.array_max(F.filter(rows, lambda k: line(k).rlike(auth)))
    stop = F.array_max(F.filter(rows, lambda k: ~line(k).rlike(auth) & ~trimmed(line(k)).rlike("^(@|$)")))
    return F.coalesce(last > F.coalesce(stop, F.lit(-1)), F.lit(False))


@dataclass(frozen=True)
class Rule:
    id: str
    control: str
    severity: str
    description: str
    head: str  # each line where the rule fires matches this, so that texts without it needn't be looked at line by line
    hit: Callable[[Column, Column], Column]  # (line, i) -> whether the rule fires there
    gate: Callable[[Column], Column] | None = None  # of the path
    unless: str | None = None  # a rule with this reports the first hit of a file only, and none if this is anywhere in it
    at_least: int = 1  # matches of head that the file has to have
    severity_of: Callable[[Column], Column] | None = None  # of the line
    description_of: Callable[[Column], Column] | None = None  # of the line

    def hits(self) -> Column:
        """array<struct<line_number, rule, control_id, severity, description, code_snippet>> of a row of blocks(); null where it can't fire."""
        line = lambda i: F.get("lines", i)
        rows = F.filter(F.sequence(F.lit(0), F.size("lines") - 1), lambda i: (i >= F.col("lo")) & (i < F.col("hi")) & F.coalesce(self.hit(line(i), i), F.lit(False)))
        if self.unless:
            rows = F.slice(rows, 1, 1)
        found = F.transform(
            rows,
            lambda i: F.struct(
                (i + 1 + F.col("above")).cast("long").alias("line_number"),
                F.lit(self.id).alias("rule"),
                F.lit(self.control).alias("control_id"),
                (self.severity_of(line(i)) if self.severity_of else F.lit(self.severity)).alias("severity"),
                (self.description_of(line(i)) if self.description_of else F.lit(self.description)).alias("description"),
                trimmed(line(i)).alias("code_snippet"),
            ),
        )
        return F.when(self.allowed() & F.col("text").rlike(f"(?m){self.head}"), found)

    def allowed(self) -> Column:
        return (F.size("lines") > 0) & (self.gate(F.col("path")) if self.gate else F.lit(True))

    def of_file(self) -> Column:
        """What a block says of a rule with `unless`: its first hit there, matches of head in its own lines, whether `unless` is there."""
        own = F.array_join(F.slice("lines", F.col("lo") + 1, F.greatest(F.least(F.col("hi"), F.size("lines")) - F.col("lo"), F.lit(0))), "\n")
        n = F.regexp_count(own, F.lit(self.head)) if self.at_least > 1 else F.lit(1)
        told = F.struct(F.lit(self.id).alias("rule"), F.get(self.hits(), F.lit(0)).alias("hit"), n.alias("n"), F.lit(self.at_least).alias("at_least"), F.col("text").rlike(self.unless).alias("bad"))
        return F.when(self.allowed() & (F.col("text").rlike(self.head) | F.col("text").rlike(self.unless)), told)


FOUND = ("rule", "control_id", "severity", "description", "line_number", "code_snippet")
_HITS = "array<struct<line_number:bigint,rule:string,control_id:string,severity:string,description:string,code_snippet:string>>"


def _ends(*suffixes: str) -> Callable[[Column], Column]:
    return lambda path: path.rlike("(" + "|".join(s.replace(".", r"\.") for s in suffixes) + ")$")


def _secret_name(line: Column) -> Column:
    out = F.lit(None).cast("string")
    for word, name in reversed(LOG_WORDS):
        out = F.when(F.contains(F.lower(line), F.lit(word)), name).otherwise(out)
    return out


RULES = {
    r.id: r
    for r in (
        Rule("R1", "CC6.1", "high", "View function missing authentication decorator or check", VIEW, lambda x, i: x.rlike(VIEW) & ~trimmed(x).startswith("#") & ~_guarded_above(i, VIEW_AUTH) & ~_near(i, 0, 4).rlike(VIEW_INLINE), _ends(".py")),
        Rule("R2", "CC6.1", "high", "Hardcoded user ID should use request.user or current_user", FIXED_ID, lambda x, i: x.rlike(FIXED_ID) & _code(x) & ~x.rlike(r"(def |param|Expected\[)"), lambda p: ~p.rlike(TEST_FILE)),
        Rule("R3", "CC6.1", "critical", "Admin/sensitive operation missing permission check", ADMIN, lambda x, i: x.rlike(ADMIN) & ~_near(i, 0, 9, "\n").rlike(PERMISSION), lambda p: ~p.rlike("(test_|_test|spec_)")),
        Rule("R4", "CC6.1", "high", "Express route missing authentication middleware", EXPRESS, lambda x, i: x.rlike(EXPRESS) & x.rlike(EXPRESS_PATHS) & ~x.rlike(EXPRESS_AUTH) & ~F.coalesce(F.get("lines", i + 1).rlike(EXPRESS_AUTH), F.lit(False)), _ends(".js", ".ts")),
        Rule("R5", "CC6.1", "high", "FastAPI endpoint missing Depends(permission) check", FASTAPI, lambda x, i: x.rlike(FASTAPI) & x.rlike(FASTAPI_PATHS) & ~F.get("lines", i + 1).rlike(r"Depends\("), _ends(".py")),
        Rule("R6", "CC6.1", "high", "Flask route missing authentication decorator or check", FLASK, lambda x, i: x.rlike(FLASK) & ~x.rlike(FLASK_PUBLIC) & ~_guarded_above(i, FLASK_AUTH) & ~_near(i, 0, 9).rlike(FLASK_INLINE), _ends(".py"),
             severity_of=lambda x: F.when(x.rlike("(POST|PUT|DELETE)"), "critical").otherwise("high"), description_of=lambda x: F.concat(F.lit("Flask route '"), F.regexp_extract(x, FLASK, 1), F.lit("' missing authentication decorator or check"))),
        Rule("R7", "CC6.7", "critical", "Hardcoded secret", SECRET, lambda x, i: x.rlike(SECRET) & ~x.rlike(NO_SECRET) & _code(x)),
        Rule("R8", "CC7.2", "medium", "Sensitive operation without audit logging", SENSITIVE, lambda x, i: x.rlike(SENSITIVE) & _code(x) & ~_near(i, -1, 2).rlike(LOGGED)),
        Rule("R9", "CC7.2", "critical", "Sensitive data in logging statement", LOG_CALL, lambda x, i: x.rlike(LOG_CALL) & _code(x) & _secret_name(x).isNotNull(),
             description_of=lambda x: F.concat(F.lit("Sensitive data ("), _secret_name(x), F.lit(") in logging statement"))),
        Rule("R10", "CC7.2", "high", "Authentication event without logging", AUTH_EVENT, lambda x, i: x.rlike(AUTH_EVENT) & _code(x) & ~_near(i, 1, 3).rlike(AUTH_LOGGED)),
        Rule("R11", "CC7.2", "medium", "Database transaction without logging mechanism", TRANSACTION, lambda x, i: x.rlike(TRANSACTION), unless=TRANSACTION_LOGGED),
        Rule("R12", "A1.2", "high", "External service call without error handling", EXTERNAL, lambda x, i: x.rlike(EXTERNAL) & _code(x) & ~((_near(i, -3, 4).rlike(TRIES) & _near(i, -3, 4).rlike(CATCHES)) | F.contains(_near(i, -3, 4), F.lit("with ")))),
        Rule("R13", "A1.2", "high", "External request without timeout configuration", REQUEST, lambda x, i: x.rlike(REQUEST) & _code(x) & ~_near(i, 0, 2).rlike(TIMEOUT)),
        Rule("R14", "A1.2", "medium", "No retry logic for transient failures", API_CALL, lambda x, i: x.rlike(API_CALL) & _code(x), unless=RETRIES),
        Rule("R15", "A1.2", "high", "Database operation without error handling", DATABASE, lambda x, i: x.rlike(DATABASE) & _code(x) & ~_near(i, -1, 2).rlike(HANDLED)),
        Rule("R16", "A1.2", "medium", "Multiple external calls without circuit breaker pattern", SERVICE, lambda x, i: x.rlike(SERVICE) & _code(x), unless=BREAKER, at_least=2),
    )
}


#: Lines of a block, and the lines above and below that the frames of rules reach.
BLOCK, ABOVE, BELOW = 1000, 5, 9


def blocks(lines: DataFrame, keys: tuple[str, ...], size: int = BLOCK) -> DataFrame:
    """Blocks (*keys, block, lines, lo, hi, above) of rows (*keys, line_no, line): own lines and those that frames reach.

    The own lines are lines[lo:hi], `above` lines of the file come before the first; so a file of any length is dealt to
    rows of `size + ABOVE + BELOW` lines at most.  Lines are numbered from 1 without gaps.
    """
    at = F.col("line_no") - 1
    near = F.sequence(F.greatest(F.floor((at - BELOW) / size), F.lit(0)), F.floor((at + ABOVE) / size))
    dealt = lines.select(*keys, "line_no", "line", F.explode(near).alias("block"))
    held = dealt.groupBy(*keys, "block").agg(F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("held")).where(F.element_at("held", -1)["line_no"] > F.col("block") * size)
    above = F.get("held", F.lit(0))["line_no"] - 1
    lo = (F.col("block") * size - above).cast("int")
    return held.select(*keys, "block", F.transform("held", lambda s: s["line"]).alias("lines"), lo.alias("lo"), (lo + size).alias("hi"), above.alias("above"))


def _chosen(rules, controls: tuple[str, ...] | None) -> list[Rule]:
    return [RULES[r] for r in rules if controls is None or RULES[r].control in controls]


def _reported(hits: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    return hits.select(*keep, *FOUND).withColumn("severity", downgrade(F.col("severity"), F.col("path")))


def scan(files: DataFrame, rules=tuple(RULES), controls: tuple[str, ...] | None = None, keep: tuple[str, ...] = ("path",)) -> DataFrame:
    """Findings of all rules (or those of some controls) over files (path, lines, ...), with severities lowered in test code.

    Without a shuffle, for files that are rows already; scan_lines() takes files of any length.
    """
    rows = files.withColumns({"text": F.array_join("lines", "\n"), "lo": F.lit(0), "hi": F.size("lines"), "above": F.lit(0)})
    none = F.expr(f"cast(array() as {_HITS})")

    def of(rule: Rule) -> Column:
        if not rule.unless:
            return rule.hits()
        enough = F.regexp_count("text", F.lit(rule.head)) >= rule.at_least if rule.at_least > 1 else F.lit(True)
        return F.when(enough & ~F.col("text").rlike(rule.unless), rule.hits())

    every = F.concat(*(F.coalesce(of(r), none) for r in _chosen(rules, controls)), none)
    return _reported(rows.select(*keep, F.inline(every)), keep)


def scan_lines(lines: DataFrame, rules=tuple(RULES), controls: tuple[str, ...] | None = None, keep: tuple[str, ...] = ("path",), size: int = BLOCK) -> DataFrame:
    """scan() over rows (*keep, line_no, line) of files of any length, path among keep: by blocks of lines.

    Rules that depend on a whole file add up what its blocks say: the first hit, the matches, whether a word is anywhere.
    """
    rows = blocks(lines, keep, size).withColumn("text", F.array_join("lines", "\n"))
    chosen, none = _chosen(rules, controls), F.expr(f"cast(array() as {_HITS})")
    single, whole = [r for r in chosen if not r.unless], [r for r in chosen if r.unless]
    found = rows.select(*keep, F.inline(F.concat(*(F.coalesce(r.hits(), none) for r in single), none))).select(*keep, *FOUND)
    if whole:
        told = rows.select(*keep, F.inline(F.array_compact(F.array(*(r.of_file() for r in whole)))))
        told = told.groupBy(*keep, "rule").agg(F.min("hit").alias("hit"), F.sum("n").alias("n"), F.bool_or("bad").alias("bad"), F.max("at_least").alias("at_least"))
        found = found.unionByName(told.where("hit IS NOT NULL AND NOT bad AND n >= at_least").select(*keep, "hit.*").select(*keep, *FOUND))
    return _reported(found, keep)


def secret_hits(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Lines of any text table that hold a hardcoded secret, by the rule R7."""
    lines = texts.where(F.col(text_col).rlike(SECRET)).select(id_col, F.posexplode(F.split(text_col, "\r?\n")).alias("at", "line"))
    return lines.where(F.col("line").rlike(SECRET) & ~F.col("line").rlike(NO_SECRET) & _code(F.col("line"))).select(id_col, (F.col("at") + 1).cast("long").alias("line_number"))
