"""Severities, statuses, paths and other scalar expressions over findings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Severities from the most severe, and directories that scans pass over.
SEVERITIES = ("critical", "high", "medium", "low")
STATUSES = ("open", "fixed", "dismissed")
SKIP_DIRECTORIES = (
    "node_modules", "vendor", "assets", "public", "static", ".git", "venv", ".venv", "__pycache__", ".pytest_cache", ".tox",
    ".coverage", "dist", "build", "out", "target", ".cargo", ".next", ".babel_cache", ".cache", "coverage",
)
WATCHED = ("py", "js", "jsx", "ts", "tsx")
SYSTEM_DIRECTORIES = (
    "/", "/etc", "/private/etc", "/usr", "/bin", "/sbin", "/var", "/private/var", "/sys", "/proc", "/boot", "/dev", "/root",
    "/tmp", "/private/tmp",
)


def rank(severity: Column) -> Column:
    """0 for critical to 3 for low, 4 for anything else: the order of lists."""
    out = F.lit(len(SEVERITIES))
    for i, name in enumerate(SEVERITIES):
        out = F.when(severity == name, i).otherwise(out)
    return out


def weight(severity: Column) -> Column:
    """4 for critical to 1 for low, null for anything else."""
    return F.when(severity.isin(*SEVERITIES), 4 - rank(severity))


def parse_status(status: Column) -> Column:
    return F.when(status.isin(*STATUSES), status).otherwise("open")


def language(path: Column) -> Column:
    extension = F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1)
    return F.when(extension == "py", "python").when(extension.isin("js", "jsx"), "javascript").when(extension.isin("ts", "tsx"), "typescript")


def skip_path(path: Column) -> Column:
    """Whether a scan passes over a path: a component is listed or starts with a dot."""
    return F.exists(F.split(path, "/"), lambda c: c.isin(*SKIP_DIRECTORIES) | c.startswith("."))


def watch_path(path: Column, ignore=SKIP_DIRECTORIES, extensions=WATCHED) -> Column:
    """Whether a watcher follows a path: no ignored name anywhere in it, and a known extension."""
    ignored = F.exists(F.array(*map(F.lit, ignore)), lambda p: F.contains(path, p))
    return ~ignored & F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1).isin(*extensions)


def is_test_path(path: Column) -> Column:
    low = F.lower(path)
    inside = [F.contains(low, F.lit(x)) for x in ("/test", "test/", "__tests__", "cypress")]
    ends = [F.endswith(low, F.lit(x)) for x in (".spec.ts", ".spec.js", ".test.ts", ".test.js")]
    out = F.lit(False)
    for x in (*inside, *ends):
        out = out | x
    return out


def downgrade(severity: Column, path: Column) -> Column:
    """One level less for findings in test code; low stays."""
    less = F.when(severity == "critical", "high").when(severity == "high", "medium").otherwise("low")
    return F.when(is_test_path(path), less).otherwise(severity)


def path_flags(path: Column) -> dict[str, Column]:
    """Why a path is unsafe, by name of the reason."""
    near = F.exists(F.array(*map(F.lit, SYSTEM_DIRECTORIES)), lambda d: F.startswith(path, d) & (F.char_length(path) - F.char_length(d) <= 10))
    return {"absolute": F.startswith(path, F.lit("/")), "traversal": F.contains(path, F.lit("..")), "nul": F.contains(path, F.lit("\0")), "system": near}


def progress(scanned: Column, total: Column) -> Column:
    return F.when(total > 0, F.round(100 * scanned / total)).otherwise(0.0)


def audit_label(kind: Column) -> Column:
    out = kind
    for name in ("violation", "fix", "scan"):
        out = F.when(F.contains(kind, F.lit(name)), name).otherwise(out)
    return out


def parse_time(text: Column) -> Column:
    """An instant from text with a zone (Z, +hh:mm, +hhmm) or without, which then is UTC; null for anything else."""
    zoned = text.rlike(r"([zZ]|[+-]\d{2}:?\d{2})$")
    whole = F.replace(F.btrim(F.when(zoned, text).otherwise(F.concat(text, F.lit("Z")))), F.lit("T"), F.lit(" "))
    return F.regexp_replace(F.regexp_replace(whole, r"[zZ]$", "+00:00"), r"([+-]\d{2})(\d{2})$", "$1:$2").try_cast("timestamp")


def relative_age(then: Column, now: Column) -> Column:
    seconds = F.unix_timestamp(now) - F.unix_timestamp(then)
    unit = lambda size, name: F.concat(F.floor(seconds / size).cast("string"), F.when(F.floor(seconds / size) == 1, f" {name} ago").otherwise(f" {name}s ago"))
    return F.when(seconds < 60, "just now").when(seconds < 3600, unit(60, "minute")).when(seconds < 86400, unit(3600, "hour")).otherwise(unit(86400, "day"))


def trimmed(line: Column) -> Column:
    return F.btrim(line, F.lit(" \t\r\n"))
