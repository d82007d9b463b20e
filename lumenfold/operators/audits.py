"""Audits of configuration, waivers, manifests, workflows, documents and registries."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import policy


def _codes(rows: DataFrame, keys: list[str], checks: dict[str, Column]) -> DataFrame:
    """(keys, code): a row for each check that holds; nulls count as no."""
    hits = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(code)) for code, c in checks.items()]))
    return rows.select(*keys, F.explode(hits).alias("code"))


def _text(rows: DataFrame, c: str) -> Column:
    return F.col(c).cast("string") if c in rows.columns else F.lit(None).cast("string")


def _blank(c: str) -> Column:
    return F.coalesce(F.trim(F.col(c)), F.lit("")) == ""


def config_lockdown(configs: DataFrame, known_keys: list[str], known_profiles: list[str]) -> DataFrame:
    """(config_id, code) of configs(config_id, settings map<string,string>): what a locked-down configuration may not have."""
    s = F.col("settings")
    get = lambda k: F.try_element_at(s, F.lit(k))
    strict = get("profileName") == "strict"
    return _codes(configs, ["config_id"], {
        "CFG-1.9": F.size(F.array_except(F.map_keys(s), F.array(*map(F.lit, known_keys)))) > 0,
        "CFG-1.10": get("schemaVersion").isNull() | get("profileName").isNull(),
        "CFG-1.11": get("profileName").isNotNull() & ~get("profileName").isin(known_profiles),
        "CFG-1.1": strict & ~F.coalesce(get("failOn").contains("error"), F.lit(False)),
        "CFG-1.4": (get("allowUnsafeCode") == "true") & get("waiverId").isNull(),
        "CFG-1.5": strict & (get("publicReexportPolicy") == "allow") & get("waiverId").isNull(),
    })


def override_audit(overrides: DataFrame, registry: DataFrame) -> DataFrame:
    """(rule_id, code) of overrides(rule_id, enabled, severity, waiver_id): unregistered, blocked, or without a waiver."""
    r = registry.select(F.upper("rule_id").alias("rule_id"), F.col("severity").alias("_severity"), "can_disable", "can_downgrade", F.lit(True).alias("_known"))
    j = overrides.withColumn("rule_id", F.upper("rule_id")).join(r, "rule_id", "left")
    off = F.col("enabled") == F.lit(False)
    return _codes(j, ["rule_id"], {
        "ENF-1.3": F.col("_known").isNull(),
        "CFG-1.2": off & ~F.col("can_disable"),
        "CFG-1.3": (policy.severity_rank(F.col("severity")) < policy.severity_rank(F.col("_severity"))) & ~F.col("can_downgrade"),
        "CFG-1.8": off & F.col("can_disable") & _blank("waiver_id"),
    })


def waiver_audit(waivers: DataFrame, registry: DataFrame, today: str, max_days: int = 90, max_active: int | None = None, in_ci: bool = False) -> DataFrame:
    """(waiver_id, code) of waivers(rule_id, waiver_id, owner, issue, reason, scope array, expires, remediation, ci_allowed, visible): what makes a waiver bad.

    registry(rule_id, severity, lock_level, waivable) says what can be waived. A date that isn't one is expired (WAIVER-1.3).
    More waivers than max_active give one row for all of them, WAIVER-1.7 without a waiver_id.
    """
    rules = registry.select(F.upper("rule_id").alias("_rule"), F.coalesce(_text(registry, "lock_level"), F.when(F.col("severity") == "error", "immutable").otherwise("advisory")).alias("_level"), policy.waivable(registry).alias("_waivable"))
    w = waivers.join(rules, F.upper("rule_id") == F.col("_rule"), "left")
    expires = F.when(F.col("expires").rlike(r"^\d{4}-\d{2}-\d{2}\z"), F.try_to_date("expires", "yyyy-MM-dd"))
    days = F.datediff(expires, F.lit(today).cast("date"))
    scope = F.transform(F.coalesce("scope", F.array().cast("array<string>")), lambda s: F.coalesce(F.regexp_replace(F.translate(s, "\\", "/"), r"^\s+|\s+$", ""), F.lit("")))
    blank = F.lit(False)
    for c in ("rule_id", "waiver_id", "owner", "issue", "reason", "expires", "remediation"):
        blank |= _blank(c)
    rows = _codes(w, ["waiver_id"], {
        "WAIVER-1.1": blank | (F.size(scope) == 0) | F.col("ci_allowed").isNull(),
        "WAIVER-1.2": F.exists(scope, lambda s: s.isin(*policy.BROAD_SCOPES)),
        "WAIVER-1.3": days.isNull() | (days < 0),
        "WAIVER-1.4": (F.col("_level") == "immutable") & ~F.col("_waivable"),
        "WAIVER-1.5": F.lit(in_ci) & ~F.coalesce("ci_allowed", F.lit(False)),
        "WAIVER-1.6": ~F.col("visible"),
        "WAIVER-1.8": days > max_days,
        "WAIVER-1.9": F.trim("owner").rlike(r"(?i)^(?:ai|codex|agent|llm)\z"),
        "WAIVER-1.10": _blank("remediation"),
    })
    if max_active is None:
        return rows
    return rows.unionByName(waivers.agg(F.count("*").alias("n")).where(F.col("n") > max_active).select(F.lit(None).cast(rows.schema["waiver_id"].dataType).alias("waiver_id"), F.lit("WAIVER-1.7").alias("code")))


# The only versions that an install can't resolve otherwise, and names whose look-alikes are suspicious.
EXACT_VERSION = r"^(?:npm:[@A-Za-z0-9._/-]+@)?\d+\.\d+\.\d+(?:[-+][0-9A-Za-z.-]+)?\z"
KNOWN_NAMES = ("openai", "effect", "typescript", "eslint", "vitest", "playwright", "duckdb")


def version_determinism(deps: DataFrame, known: tuple[str, ...] = KNOWN_NAMES) -> DataFrame:
    """(item_id, name, code) of deps(item_id, name, version): `not-exact` versions, and `suspicious-name` for a known package's name with a suffix."""
    look_alike = rf"(?:{'|'.join(known)})[_-](?:js|lib|safe|new|next)\z"
    return _codes(deps, ["item_id", "name"], {
        "not-exact": ~F.regexp_replace(F.coalesce("version", F.lit("")), r"^\s+|\s+$", "").rlike(EXACT_VERSION),
        "suspicious-name": F.lower("name").rlike(look_alike),
    })


def pinned_actions(lines: DataFrame) -> DataFrame:
    """(rel, line_no, action) of workflow lines(rel, line_no, line) that use an action not pinned to a whole commit hash."""
    action = F.regexp_extract("line", r"^\s*(?:-\s*)?uses:\s*([^\s#]+)", 1)
    return lines.withColumn("action", action).where((F.col("action") != "") & ~F.startswith("action", F.lit("./")) & ~F.col("action").rlike(r"@[0-9a-f]{40}$")).select("rel", "line_no", "action")


def workflow_integrity(files: DataFrame, required: dict[str, str], forbidden: dict[str, str]) -> DataFrame:
    """(rel, code): required patterns that a workflow's text lacks and forbidden ones that it has."""
    t = F.col("text")
    return _codes(files.where(t.isNotNull()), ["rel"], {**{k: ~t.rlike(p) for k, p in required.items()}, **{k: t.rlike(p) for k, p in forbidden.items()}})


def strict_flags(manifests: DataFrame, required: list[str], not_false: list[str]) -> DataFrame:
    """(rel, flag): compiler flags of manifests(rel, text) that must be true and aren't, or must not be false and are.

    A text that isn't JSON gives nothing.
    """
    v = F.try_parse_json("text")
    flag = lambda k: F.try_variant_get(v, f"$.compilerOptions.{k}", "boolean")
    bad = [F.when(~F.coalesce(flag(k), F.lit(False)), F.lit(k)) for k in required] + [F.when(~F.coalesce(flag(k), F.lit(True)), F.lit(k)) for k in not_false]
    return manifests.where(v.isNotNull()).select("rel", F.explode(F.array_compact(F.array(*bad))).alias("flag"))


def lockfile_policy(manifests: DataFrame, files: DataFrame, lockfiles: list[str]) -> DataFrame:
    """(rel, n, code): package manifests(rel) with no lockfile of files(rel) beside them, or several."""
    folder = lambda c: F.regexp_replace(c, r"/?[^/]*$", "")
    beside = files.where(F.element_at(F.split("rel", "/"), -1).isin(lockfiles)).groupBy(folder(F.col("rel")).alias("dir")).agg(F.count("*").alias("n"))
    j = manifests.select("rel", folder(F.col("rel")).alias("dir")).join(beside, "dir", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return j.where("n <> 1").select("rel", "n", F.when(F.col("n") == 0, "no-lockfile").otherwise("several-lockfiles").alias("code"))


# Bytes of texts that are read at once, and entries in a batch that is given back.
BLOCK, ENTRIES = 8 << 20, 10_000
# Fixed values, for RE2: white space, and the end of a line that may have one more line end, or none, within it.
_WS, _EOL = r"[ \t\n\x0B\f\r]", r"(?:\r\n|[\n\r\x{85}\x{2028}\x{2029}])?\z"
_HEAD = rf"\A{_WS}*\[+{_WS}*(?P<section>[^\]]+?){_WS}*\]+{_WS}*{_EOL}"
_PAIR = rf"\A{_WS}*(?P<key>[A-Za-z0-9_.\"-]+){_WS}*={_WS}*(?P<value>[^\n\r\x{{85}}\x{{2028}}\x{{2029}}]*?){_WS}*{_EOL}"


def _matches(lines: pa.Array, char: str, pattern: str) -> tuple[np.ndarray, pa.Array]:
    """Positions of the lines that match, and what the pattern's groups hold there; only lines with `char` can match."""
    at = np.flatnonzero(pc.match_substring(lines, char).to_numpy(zero_copy_only=False))
    groups = pc.extract_regex(lines.take(pa.array(at)), pattern)
    ok = groups.is_valid()
    return at[ok.to_numpy(zero_copy_only=False)], groups.filter(ok)


def _sections(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        block = np.cumsum(pc.binary_length(batch.column(1)).to_numpy().astype(np.int64)) // BLOCK
        cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(batch)]
        for rel, text in (batch.slice(i, j - i).columns for i, j in zip(cuts, cuts[1:])):
            split = pc.split_pattern_regex(text, r"\r?\n")
            lines, file, first = split.flatten(), split.value_parent_indices().to_numpy(), split.offsets.to_numpy()
            heads, names = _matches(lines, "[", _HEAD)
            pairs, found = _matches(lines, "=", _PAIR)
            above = np.searchsorted(heads, pairs) - 1  # -1: none, which stands for the file -1
            other = np.append(file[heads], -1)[above] != file[pairs]
            names = names.field("section")
            for i in range(0, len(pairs), ENTRIES):
                of, at, rows = file[pairs[i : i + ENTRIES]], pairs[i : i + ENTRIES], found.slice(i, ENTRIES).flatten()
                section = names.take(pa.array(above[i : i + ENTRIES], mask=other[i : i + ENTRIES])).fill_null("")
                columns = [rel.take(pa.array(of)), pa.array(at - first[of] + 1, pa.int64()), section, *rows]
                yield pa.RecordBatch.from_arrays(columns, names=["rel", "line_no", "section", "key", "value"])


def section_entries(files: DataFrame) -> DataFrame:
    """(rel, line_no, section, key, value) of manifests with `[section]` lines above their `key = value` lines.

    The section of a line is the last one above it in its file. A task holds one block of texts, or one longer text, and finds
    the last heads of all its lines at once.
    """
    rows = files.where(F.col("text").isNotNull()).select("rel", F.make_valid_utf8("text").alias("text"))
    return rows.mapInArrow(_sections, f"rel {rows.schema['rel'].dataType.simpleString()}, line_no long, section string, key string, value string")


def overlapping_sections(entries: DataFrame, one: str, other: str) -> DataFrame:
    """(rel, key): names that are in both sections of a manifest."""
    a, b = (entries.where(F.col("section") == s).select("rel", "key").distinct() for s in (one, other))
    return a.intersect(b)


def requirement_categories(lines: DataFrame) -> DataFrame:
    """(rel, line_no, category) of requirement lines(rel, line_no, line): the first category that fits, none for pinned ones."""
    t = F.trim("line")
    category = F.when(t.rlike(r"^(?:#|$)"), None).when(t.rlike(r"(?i)git\+|\.git(?:@|$)"), "git").when(t.rlike(r"^(?:\.|/|file:|-e\s)"), "path").when(~t.rlike("=="), "unpinned")
    return lines.withColumn("category", category).where("category IS NOT NULL").select("rel", "line_no", "category")


def policy_critical(changed: DataFrame, globs: list[str]) -> DataFrame:
    """changed(rel) files that match a policy-critical glob."""
    from .config import matches_any

    return changed.where(matches_any(F.col("rel"), globs))


def uncovered_roots(roots: DataFrame, covered: DataFrame) -> DataFrame:
    """roots(root) below which no path of covered(rel) lies."""
    from lumenfold.functions.text import ancestors

    above = covered.select(F.explode(ancestors(F.col("rel"))).alias("root")).distinct()
    return roots.join(above, "root", "left_anti")


def first_existing(wanted: DataFrame, files: DataFrame) -> DataFrame:
    """(item_id, path): of wanted(item_id, ordinal, path), the first path of each item that is among files(rel)."""
    have = files.select(F.col("rel").alias("path")).distinct()
    return wanted.join(have, "path", "left_semi").groupBy("item_id").agg(F.min_by("path", "ordinal").alias("path"))


def dependency_sets(deps: DataFrame, blocked: DataFrame, test_only: DataFrame) -> DataFrame:
    """(package, name, code) of deps(package, name, kind): blocked names, and test-only names outside dev dependencies."""
    b = blocked.select("name", F.lit(True).alias("_b")).distinct()
    t = test_only.select("name", F.lit(True).alias("_t")).distinct()
    j = deps.join(b, "name", "left").join(t, "name", "left")
    return _codes(j, ["package", "name"], {"blocked": F.col("_b"), "test-only": F.col("_t") & (F.col("kind") != "dev")}).distinct()


def licence_violations(packages: DataFrame, allowed: DataFrame) -> DataFrame:
    """packages(name, licence) whose licence isn't among allowed(licence); no licence is none of them."""
    a = allowed.select("licence").distinct()
    return packages.join(a, packages["licence"].eqNullSafe(a["licence"]), "left_anti")


def unsorted_groups(rows: DataFrame, by: str, order: str, value: str) -> DataFrame:
    """(by, breaks): groups whose values, in order, don't rise; a neighbour is compared with the one before."""
    from pyspark.sql import Window

    before = F.lag(value).over(Window.partitionBy(by).orderBy(order))
    return rows.withColumn("_down", F.col(value) < before).groupBy(by).agg(F.count_if("_down").alias("breaks")).where("breaks > 0")


def all_any_none(rows: DataFrame, by: str, flag: Column) -> DataFrame:
    """(by, all_ok, any_ok, none_ok)."""
    return rows.groupBy(by).agg(F.bool_and(flag).alias("all_ok"), F.bool_or(flag).alias("any_ok"), (~F.bool_or(flag)).alias("none_ok"))


def missing_sections(files: DataFrame, headings: list[str]) -> DataFrame:
    """(rel, missing): required headings, at any level, that a Markdown text lacks."""
    has = lambda h: F.col("text").rlike(rf"(?im)^#+\s+{h}\s*$")
    missing = F.array_compact(F.array(*[F.when(~has(h), F.lit(h)) for h in headings]))
    return files.where(F.col("text").isNotNull()).select("rel", F.array_join(missing, ",").alias("missing")).where("missing <> ''")


def index_links(entries: DataFrame, index: DataFrame) -> DataFrame:
    """entries(rel, link) whose link stands nowhere in the index: index(link) is the links that its text has."""
    return entries.join(index.select("link").distinct(), "link", "left_anti").select("rel", "link")


def report_fields(reports: DataFrame, required: dict[str, list[str]]) -> DataFrame:
    """(report_id, kind, missing) of reports(report_id, text): the first line's kind, and the keys that its `key: value` lines lack.

    An unknown kind is reported with a null `missing`.
    """
    lines = F.split("text", r"\r?\n", -1)
    kind = F.trim(F.get(lines, F.lit(0)))
    keys = F.filter(F.transform(lines, lambda x: F.lower(F.regexp_extract(x, r"^\s*-?\s*([A-Za-z_ ]+?)\s*:\s*\S", 1))), lambda k: k != "")
    wanted = F.lit(None)
    for k, names in required.items():
        wanted = F.when(kind == k, F.array(*map(F.lit, names))).otherwise(wanted)
    out = reports.select("report_id", kind.alias("kind"), F.array_join(F.array_except(wanted, keys), ",").alias("missing"))
    return out.where("missing IS NULL OR missing <> ''")


def leaf_folders(files: DataFrame) -> DataFrame:
    """(dir): folders of files(rel) that have no folder below them."""
    from lumenfold.functions.text import ancestors

    dirs = files.select(F.regexp_replace("rel", r"/[^/]*$", "").alias("dir")).where(F.col("dir") != "").distinct()
    above = dirs.select(F.explode(ancestors(F.col("dir"))).alias("up"), "dir").where("up <> dir").select(F.col("up").alias("dir")).distinct()
    return dirs.join(above, "dir", "left_anti")


def without_tests(files: DataFrame, depth: int = 2) -> DataFrame:
    """(package): packages, the first `depth` parts of a path, of which no file is a test."""
    test = F.col("rel").rlike(r"(?i)(?:^|/)(?:test|tests|__tests__)/|(?:^|/)test_[^/]*$|\.(?:test|spec)\.[^/]*$")
    package = F.array_join(F.slice(F.split("rel", "/"), 1, depth), "/")
    return files.select(package.alias("package"), test.alias("t")).groupBy("package").agg(F.bool_or("t").alias("any")).where("NOT any").select("package")


def generated_artifacts(files: DataFrame) -> DataFrame:
    """(rel, code): generated marks in source files, and files that lie in output folders."""
    marked = F.col("text").rlike(r"@generated|<auto-generated>|Generated by")
    output = F.col("rel").rlike(r"(?i)(?:^|/)(?:output|test-results|playwright-report)/")
    return _codes(files, ["rel"], {"GEN-1.1": marked & ~output, "GEN-1.2": output})
