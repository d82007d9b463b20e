"""Rule policy: registry defaults, overrides, and waivers in the order of their configuration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfold.functions.text import ascii_boundaries
from lumenfold.operators import globs


def severity_rank(severity: Column) -> Column:
    return F.when(severity == "error", 3).when(severity == "warning", 2).when(severity == "info", 1)


def enrich(findings: DataFrame, registry: DataFrame) -> DataFrame:
    """findings with severity, title and doc of their own, else of registry(rule_id, severity, title, doc), else defaults."""
    known = registry.select(F.upper("rule_id").alias("rule_id"), *[F.col(c).alias(f"_{c}") for c in ("severity", "title", "doc")])
    out = findings.withColumn("rule_id", F.upper("rule_id")).join(known, "rule_id", "left")
    have = lambda c: F.col(c) if c in findings.columns else F.lit(None)
    defaults = {"severity": "error", "title": "Unknown rule", "doc": ""}
    return out.withColumns({c: F.coalesce(have(c), F.col(f"_{c}"), F.lit(d)) for c, d in defaults.items()}).drop(*[f"_{c}" for c in defaults])


def effective_policy(registry: DataFrame, overrides: DataFrame) -> DataFrame:
    """(rule_id, enabled, severity) of each rule under overrides(rule_id, enabled, severity).

    A rule that can't be disabled stays enabled; a severity below the registry's of a rule that can't be
    downgraded has no effect.
    """
    o = overrides.select(F.upper("rule_id").alias("rule_id"), F.col("enabled").alias("_enabled"), F.col("severity").alias("_severity"))
    r = registry.select(F.upper("rule_id").alias("rule_id"), "severity", "can_disable", "can_downgrade").join(o, "rule_id", "left")
    lower = severity_rank(F.col("_severity")) < severity_rank(F.col("severity"))
    return r.select(
        "rule_id",
        (F.coalesce("_enabled", F.lit(True)) | ~F.col("can_disable")).alias("enabled"),
        F.when(~(lower & ~F.col("can_downgrade")), F.col("_severity")).alias("severity"),
    )


def apply_policy(findings: DataFrame, policy: DataFrame) -> DataFrame:
    """findings of enabled rules, with the policy's severity where it has one; unknown rules pass."""
    p = policy.select("rule_id", "enabled", F.col("severity").alias("_severity"))
    out = findings.join(p, "rule_id", "left").where(F.coalesce("enabled", F.lit(True)))
    return out.withColumn("severity", F.coalesce("_severity", "severity")).drop("enabled", "_severity")


def scope_regex(scope: Column) -> Column:
    """A waiver's scope as a pattern: `dir/**` is dir and all below, `**` any characters, `*` any but a slash."""
    return globs.pattern(scope, globs.SCOPE)


#: Scopes that are too wide to waive anything, and words that name no accountable owner.
BROAD_SCOPES = ("", ".", "/", "**", "**/*", "src/**", "crates/**", "packages/**", "apps/**")
MACHINE_OWNERS = r"(?i)\b(?:ai|agent|codex|llm)\b"
_DATE = r"^\d{4}(?:-\d{2}(?:-\d{2})?)?\z"


def waivable(registry: DataFrame) -> Column:
    """Whether a rule of registry(severity, lock_level, waivable) can be waived: by its own mark, or as its lock level requires waivers."""
    have = lambda c: F.col(c) if c in registry.columns else F.lit(None)
    level = F.coalesce(have("lock_level").cast("string"), F.when(F.col("severity") == "error", "immutable").otherwise("advisory"))
    return F.coalesce(have("waivable").cast("boolean"), F.lit(False)) | (level == "waiver-required")


def last_moment(day: Column) -> Column:
    """The end of the day that a waiver names, null where it names none: a text that is no date is no error."""
    full = F.concat(day, F.when(F.length(day) == 4, "-01-01").when(F.length(day) == 7, "-01").otherwise(""))
    return F.when(day.rlike(_DATE), F.try_to_timestamp(F.concat(full, F.lit(" 23:59:59.999"))))


def policy_path(path: Column) -> Column:
    """A path as scopes have it: slashes forward, one leading `./` off, without white space around it."""
    return F.regexp_replace(F.regexp_replace(F.translate(path, "\\", "/"), r"^\./+", ""), r"^\s+|\s+$", "")


def narrow_scopes(scopes: Column) -> Column:
    """Scopes as relative paths, without the broad ones."""
    return F.filter(F.transform(F.coalesce(scopes, F.array().cast("array<string>")), policy_path), lambda s: s.isNotNull() & ~s.isin(*BROAD_SCOPES))


def valid_waivers(waivers: DataFrame, as_of: str, in_ci: bool = False, registry: DataFrame | None = None) -> DataFrame:
    """waivers(ordinal, rule_id, waiver_id, owner, issue, reason, scope, expires, ci_allowed, visible) that may apply, with narrow scopes.

    A broad scope is left out of its waiver, the others hold; a waiver without a scope left is none. An `expires` that
    is no date counts as expired. With a registry(rule_id, severity, lock_level, waivable), only rules that it lets be waived.
    """
    filled = F.lit(True)
    for c in ("waiver_id", "owner", "issue", "reason"):
        filled &= F.coalesce(F.col(c), F.lit("")) != ""
    ok = filled & ~F.col("owner").rlike(ascii_boundaries(MACHINE_OWNERS)) & F.coalesce("visible", F.lit(True))
    ok &= F.coalesce(last_moment(F.col("expires")) >= F.to_timestamp(F.lit(as_of)), F.lit(False))
    out = waivers.where(ok & F.coalesce("ci_allowed", F.lit(False)) if in_ci else ok).withColumn("scope", narrow_scopes(F.col("scope"))).where(F.size("scope") > 0)
    if registry is None:
        return out
    allowed = registry.where(waivable(registry)).select(F.upper("rule_id").alias("_id")).distinct()
    return out.join(allowed, F.upper("rule_id") == F.col("_id"), "left_semi")


def split_by_waiver(findings: DataFrame, waivers: DataFrame) -> DataFrame:
    """findings(rule_id, rel, ...) with waiver_id of the first of valid waivers(ordinal, rule_id, waiver_id, scope) that applies, null if active.

    Scopes are an index over folders, names and extensions (see globs), so neither table is held against the other whole.
    """
    w = waivers.select("ordinal", F.upper("rule_id").alias("_rule"), "waiver_id", F.explode("scope").alias("glob"))
    f = findings.withColumns({"_rule": F.upper("rule_id"), "_file": F.coalesce(policy_path(F.col("rel")), F.lit(""))})
    return globs.first_match(f, w, ["_rule"], ["waiver_id"], "_file", globs.SCOPE).select(*findings.columns, "waiver_id")


def severity_summary(findings: DataFrame) -> DataFrame:
    return findings.where(F.col("severity").isNotNull()).groupBy("severity").agg(F.count("*").alias("n"))


def count_by(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(F.coalesce(F.col(key).cast("string"), F.lit("unknown")).alias("key")).agg(F.count("*").alias("n"))


def group_findings(findings: DataFrame, key: Column) -> DataFrame:
    """(key, n, by_severity, rule_ids, docs, first_finding), most findings first; arrays as sorted, joined text."""
    f = findings.withColumns({"key": key, "severity": F.coalesce("severity", F.lit("error"))})
    per = f.groupBy("key", "severity").agg(F.count("*").alias("c"), F.collect_set("rule_id").alias("ids"), F.collect_set(F.when(F.col("doc") != "", F.col("doc"))).alias("d"), F.min("finding_id").alias("first"))
    out = per.groupBy("key").agg(
        F.sum("c").alias("n"),
        F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "severity", "c"))), ",").alias("by_severity"),
        F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), ",").alias("rule_ids"),
        F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list("d")))), ",").alias("docs"),
        F.min("first").alias("first_finding"),
    )
    return out.orderBy(F.desc("n"), "key")


def routed(rules: DataFrame, keys: DataFrame) -> DataFrame:
    """rules whose language:family, or language:*, is among keys(key)."""
    exact, whole = F.concat_ws(":", "language", "family"), F.concat(F.col("language"), F.lit(":*"))
    both = rules.withColumn("key", F.explode(F.array(exact, whole)))
    return both.join(keys.select("key").distinct(), "key", "left_semi").drop("key").distinct()


def routed_compat(rules: DataFrame, languages: list[str], families: list[str]) -> DataFrame:
    """Any language with any family, then the common rules of these families; repeated rules stay."""
    own = rules.where(F.col("language").isin(languages) & F.col("family").isin(families))
    return own.withColumn("pass", F.lit(1)).unionByName(rules.where((F.col("language") == "common") & F.col("family").isin(families)).withColumn("pass", F.lit(2)))


def completeness(reports: DataFrame, required: list[str]) -> DataFrame:
    """(report_id, missing): required keys that reports(report_id, fields map) lack."""
    missing = F.array_except(F.array(*map(F.lit, required)), F.map_keys("fields"))
    return reports.select("report_id", F.array_join(F.array_sort(missing), ",").alias("missing"))
