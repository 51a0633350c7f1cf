"""Requests to a model as tables of prompts: fixes of findings, and analyses of files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bookkeeping import CONTROLS
from .corpus import join_shared

# What a fix of a control is called, and what its request ends with.
FIXES = {
    "CC6.1": ("access control", ""),
    "CC6.7": ("secrets/cryptography", "Move hardcoded secrets to environment variables. "),
    "CC7.2": ("logging", "Add proper audit logging without logging sensitive data. "),
    "A1.2": ("resilience", "Add error handling, timeouts, and retry logic. "),
}
END = "Provide the fixed code only, no explanation."
# The parts of an analysis request.
SYSTEM_HEAD = "You are a SOC 2 compliance expert analyzing application code for security violations.\n\nYour task is to identify violations of the following SOC 2 controls:\n\n"
SYSTEM_TAIL = """
**Analysis Guidelines**:
1. Focus on semantic violations that regex patterns might miss
2. Consider context and intent, not just keywords
3. Assign confidence scores (0-100) based on certainty
4. Provide clear, actionable reasoning
5. Avoid duplicate findings with existing regex detections

**Response Format**:
Respond with a JSON array of violations only, no explanation:
```json
[
  {
    "control_id": "CC6.1",
    "severity": "high",
    "description": "Brief description",
    "line_number": 42,
    "code_snippet": "relevant code",
    "confidence_score": 85,
    "reasoning": "Why this is a violation"
  }
]
```
If no violations found, respond with: `[]`"""
FILE_HEAD = "Analyze this file for SOC 2 compliance violations:\n\n"
FOUND_HEAD, FOUND_TAIL = "**Regex Pattern Detections** (already found):\n", "\nFocus on finding violations that regex patterns missed.\n\n"
FILE_TAIL = "Respond with JSON array of violations (or [] if none found). Consider semantic issues, not just keyword matching."


def _or_empty(value: Column, before: str, after: str) -> Column:
    return F.when(value.isNotNull(), F.concat(F.lit(before), value, F.lit(after))).otherwise("")


def fix_prompt(control: Column, description: Column, code: Column, framework: Column, function: Column, class_: Column) -> Column:
    """The request for a fix, by control; a null framework is unknown, null names leave no line."""
    names = F.concat(F.lit("Context:\n"), _or_empty(function, "- Function: ", "\n"), _or_empty(class_, "- Class: ", "\n"), F.lit("\n"))
    context = F.when(function.isNotNull() | class_.isNotNull(), names).otherwise("")
    body = F.concat(F.lit("Violation: "), description, F.lit("\n\n"), context, F.lit("Original code:\n```\n"), code, F.lit("\n```"))
    out = F.concat(F.lit("Fix the following compliance violation:\n\n"), body)
    for name, (kind, advice) in FIXES.items():
        head = F.concat(F.lit(f"Fix the following {kind} violation in "), F.coalesce(framework, F.lit("unknown")), F.lit(" code:\n\n"))
        out = F.when(control == name, F.concat(head, body, F.lit(f"\n\n{advice}{END}"))).otherwise(out)
    return out


def fix_requests(violations: DataFrame, frameworks: DataFrame) -> DataFrame:
    """(violation_id, prompt) of violations (id, project_id, control_id, description, code_snippet, function_name, class_name)."""
    joined = violations.join(frameworks.select("project_id", "framework"), "project_id", "left")
    prompt = fix_prompt(F.col("control_id"), F.col("description"), F.col("code_snippet"), F.col("framework"), F.col("function_name"), F.col("class_name"))
    return joined.select(F.col("id").alias("violation_id"), prompt.alias("prompt"))


def system_prompt() -> str:
    """What a model is told about the controls."""
    each = (f"## {i} - {name}\n**Description**: {description}\n**Requirement**: {requirement}\n**Category**: {category}\n\n" for i, name, description, requirement, category in CONTROLS)
    return SYSTEM_HEAD + "".join(each) + SYSTEM_TAIL


def analysis_requests(files: DataFrame, findings: DataFrame, keys: list[str], contents: DataFrame | None = None) -> DataFrame:
    """(keys, system, prompt) of files (keys, path, content), with the pattern findings (keys, line_number, description, control_id) of each.

    Findings are listed by line; a file without findings has no list.  With contents (path, content; each path once), files have no
    content: requests meet that of their path last, wherever they are, and those whose path has none are left out.
    """
    bullet = lambda s: F.format_string("- Line %d: %s (%s)\n", s["line_number"], s["description"], s["control_id"])
    each = F.array_sort(F.collect_list(F.struct("line_number", "control_id", "description")))
    lists = findings.groupBy(*keys).agg(F.array_join(F.transform(each, bullet), "").alias("found"))
    joined = files.join(lists, keys, "left")
    if contents is not None:
        joined = join_shared(joined, contents.select("path", "content"), ["path"], "content", keys)
    head = F.concat(F.lit(f"{FILE_HEAD}**File**: "), F.col("path"), F.lit("\n\n**Code**:\n```\n"), F.col("content"), F.lit("\n```\n\n"))
    prompt = F.concat(head, _or_empty(F.col("found"), FOUND_HEAD, FOUND_TAIL), F.lit(FILE_TAIL))
    return joined.select(*keys, F.lit(system_prompt()).alias("system"), prompt.alias("prompt"))
