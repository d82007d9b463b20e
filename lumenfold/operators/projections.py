"""Projections of findings, tools, shapes and commands, with their defaults."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import policy
from .config import glob_regex


def tool_policy(tools: DataFrame, overrides: DataFrame) -> DataFrame:
    """(tool, enabled, severity, required) of tools(tool) under overrides(tool, enabled, severity, required), defaults where none is set."""
    o = overrides.select("tool", *[F.col(c).alias(f"_{c}") for c in ("enabled", "severity", "required")])
    j = tools.select("tool").join(o, "tool", "left")
    return j.select("tool", F.coalesce("_enabled", F.lit(True)).alias("enabled"), F.coalesce("_severity", F.lit("error")).alias("severity"), F.coalesce("_required", F.lit(False)).alias("required"))


def strongest(findings: DataFrame, by: str) -> DataFrame:
    """(by, severity): the strongest severity among enabled findings of each group, `info` if none is enabled."""
    rank = F.when(F.col("enabled"), policy.severity_rank(F.col("severity")))
    return findings.groupBy(by).agg(F.coalesce(F.max_by("severity", rank), F.lit("info")).alias("severity"))


def normalised(findings: DataFrame) -> DataFrame:
    """findings(file, line string, rule_id, severity, detail) with a whole positive line number, else 1, and no nulls."""
    line = F.when(F.col("line").rlike(r"^[0-9]{1,9}$"), F.col("line").cast("long"))
    return findings.select(F.coalesce("file", F.lit(".")).alias("file"), F.coalesce(line, F.lit(1)).alias("line"), F.coalesce("rule_id", F.lit("unknown")).alias("rule_id"), F.coalesce("severity", F.lit("error")).alias("severity"), F.coalesce("detail", F.lit("")).alias("detail"))


def doc_of(rule_id: Column, doc: Column, page: str = "docs/RustRules.md") -> Column:
    """A rule's doc, else its anchor on the page: the id in lower case without its first dot."""
    return F.coalesce(doc, F.concat(F.lit(page + "#"), F.regexp_replace(F.lower(rule_id), r"^([^.]*)\.", "$1")))


def compact(findings: DataFrame) -> DataFrame:
    """What a compact report shows of a finding."""
    return findings.select("rule_id", "severity", F.concat_ws(":", "rel", F.col("line_no").cast("string")).alias("at"), "detail")


def remapped(findings: DataFrame, ids: dict[str, str]) -> DataFrame:
    """findings with rule ids replaced as the map says; others stay."""
    pairs = F.create_map(*[F.lit(x) for pair in ids.items() for x in pair])
    return findings.withColumn("rule_id", F.coalesce(F.element_at(pairs, F.col("rule_id")), F.col("rule_id")))


def expanded(command: Column, values: dict[str, Column]) -> Column:
    """A command's words with `$name` placeholders filled in."""
    def fill(word: Column) -> Column:
        for name, value in values.items():
            word = F.replace(word, F.lit("$" + name), value)
        return word
    return F.transform(command, fill)


def language_of_tool(tool: Column) -> Column:
    """Language by tool name, as run summaries have it: case counts."""
    t = tool
    return F.when(t.rlike("cargo|rust|clippy"), "rust").when(t.rlike("eslint|tsc|vitest|jest|npm|pnpm|yarn"), "typescript").when(t.rlike("pytest|ruff|pyright|mypy|python"), "python").otherwise("common")


def language_of_diagnostic(tool: Column) -> Column:
    """Language by tool name, as diagnostics have it: by parts of the name in any case, so that some tools differ; a null tool is common."""
    t = F.lower(tool)
    return F.when(t.contains("cargo") | t.contains("rust"), "rust").when(t.contains("ts") | t.contains("eslint") | t.contains("vite"), "typescript").when(t.contains("py") | t.contains("ruff"), "python").otherwise("common")


def shape_limits(files: DataFrame, base: dict[str, int], overrides: list[tuple[str, dict[str, int]]]) -> DataFrame:
    """files(rel) with the limits that hold: of the overrides (glob, limits) that match, the last one that sets a limit."""
    out = files
    for key, value in base.items():
        limit = F.lit(value)
        for glob, limits in overrides:
            if key in limits:
                limit = F.when(F.col("rel").rlike(glob_regex(glob)), F.lit(limits[key])).otherwise(limit)
        out = out.withColumn(key, limit)
    return out


def next_step(blocked: Column, stale: Column, unread: Column) -> Column:
    """What to do next: the first that applies."""
    return F.when(blocked, "wait for the owner").when(stale, "repair stale claims").when(unread, "read the inbox").otherwise("go on")
