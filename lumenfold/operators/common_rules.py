"""Rules that hold for files of any language: tooling commands, secrets by place, generated code, weak tests, placeholders.

A rule is a row: a pattern over a line or its comment, what it must not match, and a condition on the file, worked out
once a file before lines are cut. A rule without a pattern holds for each line of such a file. What is told of a whole
file, of its text or its folder, comes with line 1.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfold.functions.text import ascii_boundaries
from lumenfold.operators import rules


@dataclass(frozen=True)
class LineRule:
    rule_id: str
    detail: str
    pattern: str | None
    unless: str | None = None
    subject: str = "line"
    when: str = "any"


_SCRIPT, _PYTHON, _SOURCE = r"\.(?:ts|tsx|js|jsx|mjs|cjs|mts|cts)$", r"\.py$", r"\.(?:ts|tsx|js|jsx|mjs|cjs|mts|cts|py|rs)$"
_TESTS = r"(?i)(?:^|/)(?:test|tests|__tests__)/|(?:\.test|\.spec)\.[cm]?[jt]sx?$"
_PYTHON_TESTS = r"(?i)(?:^|/)tests?/|(?:^|/)test_[^/]+\.py$|_test\.py$"
_ROOTS = r"^(?:src|apps|packages|crates|tools|scripts)/"
# File conditions as patterns over a relative path; `tooling` files are a caller's own.
FILE_CONDITIONS = {
    "any": r"", "env_sample": r"(?i)\.env\.(?:example|sample)$", "env_template": r"(?i)\.env\.template$", "test": f"{_TESTS}|{_PYTHON_TESTS.removeprefix('(?i)')}", "fixture": r"(?i)fixtures?/",
    "ssh_key": r"(?i)(?:^|/)(?:id_rsa|id_ed25519|id_ecdsa|id_dsa)(?:\.pub)?$", "mobile_config": r"(?:^|/)(?:google-services\.json|GoogleService-Info\.plist)$", "output": r"(?i)^(?:coverage|playwright-report|test-results|output)(?:/|$)",
    "generated_folder": r"(?i)(?:^|/)generated(?:/|$)", "generated_domain": r"(?i)(?:^|/)(?:domain|domains|core)/.*(?:generated|auto-generated)|(?:^|/)generated/.*(?:domain|domains)/",
    "generated_like": r"(?i)(?:^|/)(?:generated|__generated__|snapshots?|__snapshots__|test-results|output)/|(?:^|/)[^/]*snapshot[^/]*\.(?:[cm]?[jt]sx?|json|txt|md|snap)$|\.(?:snap|snapshot)$",
}
_COMMAND = r"(?i)^\s*(?:run:\s*)?(?:-\s+|>\s+)?(?:npx\s+|npm\s+|pnpm\s+|yarn\s+|node\s+|python(?:3)?\s+|uv\s+run\s+|cargo\s+|ruff\s+|pyright\b|mypy\b|gitleaks\b|trufflehog\b|\./|[A-Za-z]:[\\/])|\b(?:execSync|spawnSync|spawn|exec)\s*\(\s*[\"'`][^\"'`]*(?:gitleaks|trufflehog|ruff|pyright|mypy|npm\s+install)"
_ASSIGNED = r"(?i)\b(?:[A-Z0-9_/-]*(?:api[_-]?key|secret|token|password|private[_-]?key))\b\s*[:=]\s*[\"'][A-Za-z0-9_./+=:@-]{16,}[\"']"
_ALLOWED = r"(?i)(?:example|placeholder|changeme|replace_me|dummy|fake|test|<[^>]+>|\$\{[^}]+\})"
_MARKER = r"(?i)@generated|<auto-generated>|Generated by"
# Commands whose output must be structured.
COMMAND_RULES = (
    LineRule("SEC-2.16", "Gitleaks command does not emit SARIF.", r"(?i)\bgitleaks\s+(?:detect|protect|dir|git)\b", r"(?i)\bsarif\b|--report-format\s+sarif"),
    LineRule("SEC-2.17", "Gitleaks command is not normalized through SARIF.", r"(?i)\bgitleaks\s+(?:detect|protect|dir|git)\b", r"(?i)--report-format\s+sarif"),
    LineRule("SEC-2.18", "TruffleHog command is not normalized through JSON.", r"(?i)\btrufflehog\b", r"(?i)--json\b|\bjson\b"),
    LineRule("PY-5.5", "Ruff command does not emit JSON diagnostics.", r"(?i)\bruff\s+check\b", r"(?i)--output-format\s+json|--format\s+json"),
    LineRule("PY-5.6", "Pyright command does not emit JSON diagnostics.", r"(?i)\bpyright\b", r"(?i)--outputjson\b"),
    LineRule("PY-5.6", "mypy command does not emit structured diagnostics.", r"(?i)\bmypy\b", r"(?i)--junit-xml\b|--json-report\b|\bjson\b"),
)
# Rules over lines and comments, in the order in which they are told.
LINE_RULES = (
    LineRule("SEC-1.1", "OpenAI key found.", r"\bsk-(?:proj-)?[A-Za-z0-9_-]{20,}\b"),
    LineRule("SEC-1.1", "Inline secret-like assignment found.", _ASSIGNED),
    LineRule("SEC-2.11", ".env.example contains a real-looking secret.", _ASSIGNED, _ALLOWED, when="env_sample"),
    LineRule("SEC-2.12", ".env.template contains a real-looking secret.", _ASSIGNED, _ALLOWED, when="env_template"),
    LineRule("SEC-2.19", "SSH key file found in source scope.", None, when="ssh_key"),
    LineRule("SEC-2.20", "mobile secret config file found in source scope.", None, when="mobile_config"),
    LineRule("GEN-1.1", "Generated artifact marker found in tracked source scope.", _MARKER, subject="comment", when="marker_source"),
    LineRule("GEN-2.3", "generated file marker found; regenerate instead of editing manually.", _MARKER, subject="comment", when="marker_source"),
    LineRule("GEN-2.6", "runtime output path is in source scope.", None, when="output"),
    LineRule("GEN-2.1", "generated directory file is in source scope.", None, when="generated_folder"),
    LineRule("GEN-2.8", "generated code contains validation suppression.", r"(?i)(?:@ts-(?:ignore|expect-error|nocheck)|eslint-disable|allow\(|noqa|type:\s*ignore)", when="generated_folder"),
    LineRule("GEN-2.9", "generated code is under a domain module path.", _MARKER, subject="comment", when="generated_domain"),
    LineRule("GEN-2.10", "generated snapshot contains volatile value.", r"(?i)(?:\.snap$|snapshot).*?(?:\d{4}-\d{2}-\d{2}T|[0-9a-f]{8}-[0-9a-f]{4}|random|uuid|timestamp)", subject="path_and_line", when="generated_like"),
    LineRule("TEST-1.2", "toBeDefined() is too weak.", r"\.toBeDefined\s*\(", when="test"),
    LineRule("TEST-1.2", "toBeTruthy() is too weak.", r"\.toBeTruthy\s*\(", when="test"),
    LineRule("TEST-1.2", "toBeFalsy() is too weak.", r"\.toBeFalsy\s*\(", when="test"),
    LineRule("TEST-1.2", "not.toThrow() is too weak.", r"\.not\.toThrow\s*\(", when="test"),
    LineRule("TEST-1.2", "empty toMatchObject({}) is too weak.", r"\.toMatchObject\s*\(\s*\{\s*\}\s*\)", when="test"),
    LineRule("TEST-1.2", "expect.anything() is too weak.", r"expect\.anything\s*\(\s*\)", when="test"),
    LineRule("TEST-1.2", "expect.any(String|Number) is too weak.", r"expect\.any\s*\(\s*(?:String|Number)\s*\)", when="test"),
    LineRule("TEST-1.2", "assert!(value.is_some()) is too weak.", r"assert!\(\s*.*\.is_some\(\).*?\)", when="test"),
    LineRule("TEST-1.2", "assert!(result.is_ok()) is too weak.", r"assert!\(\s*.*\.is_ok\(\).*?\)", when="test"),
    LineRule("TEST-1.2", "assert!(result.is_err()) is too weak.", r"assert!\(\s*.*\.is_err\(\).*?\)", when="test"),
    LineRule("TEST-1.2", "length > 0 assertion is too weak.", r"assert!\(\s*[^)]+\.len\(\)\s*>\s*0\s*\)", when="test"),
    LineRule("TEST-1.2", "!is_empty() assertion is too weak.", r"assert!\(\s*!\s*[^)]+\.is_empty\(\)\s*\)", when="test"),
    LineRule("TEST-1.2", "contains() assertion is too weak without checking meaning.", r"assert!\(\s*[^)]+\.contains\([^)]+\)\s*\)", when="test"),
    LineRule("TEST-1.2", "literal Python assert is too weak.", r"^\s*assert\s+(?:True|False)\b", when="test"),
    LineRule("TEST-1.2", "is not None assertion is too weak.", r"^\s*assert\s+[^#\n]+\s+is\s+not\s+None\b", when="test"),
    LineRule("TEST-1.2", "len(...) > 0 assertion is too weak.", r"^\s*assert\s+len\([^)]+\)\s*>\s*0\b", when="test"),
    LineRule("TEST-1.3", "Rust #[ignore] test found.", r"#\s*\[\s*ignore\s*\]", when="rust_test"),
    *(
        LineRule(rule_id, detail, pattern, when="production")
        for detail, pattern in (
            ("not implemented throw found.", r"(?i)throw new Error\(\s*['\"`]not implemented['\"`]\s*\)"), ("NotImplementedError found.", r"raise\s+NotImplementedError\b"), ("return null as any found.", r"return\s+null\s+as\s+any"),
            ("return {} as any found.", r"return\s+\{\s*\}\s+as\s+any"), ("todo!() found.", r"\btodo!\s*\(\s*\)"), ("unimplemented!() found.", r"\bunimplemented!\s*\(\s*\)"), ("not implemented panic found.", r"(?i)panic!\(\s*['\"`]not implemented['\"`]\s*\)"),
            ("dbg!() found.", r"\bdbg!\s*\("), ("println!() found.", r"\bprintln!\s*\("), ("eprintln!() found.", r"\beprintln!\s*\("), ("bare unreachable!() found.", r"\bunreachable!\s*\(\s*\)"),
        )
        for rule_id in ("SRC-1.2", "SRC-2.10")
    ),
    *(
        LineRule("SRC-1.2", f"{name} marker found in production source.", pattern, subject="comment", when="production")
        for name, pattern in (
            ("TODO", r"\bTODO\b"), ("FIXME", r"\bFIXME\b"), ("TBD", r"\bTBD\b"), ("placeholder", r"(?i)\bplaceholder\b"), ("stub", r"(?i)\bstub\b"), ("fake", r"(?i)\bfake\b"), ("temporary", r"(?i)\btemporary\b"), ("for now", r"(?i)\bfor now\b"),
            ("scaffold-only", r"(?i)\bscaffold[- ]only\b"),
        )
    ),
    *(LineRule("SRC-2.9", f"{name} comment marker found.", rf"(?i)\b{name}\b", subject="comment", when="production") for name in ("temporary", "for now", "hack", "quick fix")),
    LineRule("SRC-2.8", "dumping-ground source filename found.", None, when="dumping_ground"),
)
# What a generated file must say, and what it must not.
GENERATED_PATH = r"(?i)(?:^|/)generated(?:/|$)|(?:generated|auto-generated|contracts?|schemas?)\.(?:ts|tsx|js|json|rs|py)$"
PROVENANCE = r"(?i)(?:@generated|<auto-generated>|generated by|source(?:Owner| owner|):|generator:)"
CONTENT_HASH = r"(?i)(?:sourceHash|schemaHash|contractHash|templateHash|sha256)\s*[:=]"
OWNERSHIP_FILES = ("OWNERS", "CODEOWNERS", "README.md")


def _is(pattern: str, column: str = "rel") -> Column:
    return F.coalesce(F.col(column).rlike(ascii_boundaries(pattern)), F.lit(False))


def conditions(tooling: str | None = None) -> dict[str, Column]:
    """The file conditions over rel; files whose path matches `tooling` are not production source."""
    production = _is(_SOURCE) & ~_is(_TESTS) & ~_is(_PYTHON_TESTS) & _is(_ROOTS)
    out = {name: _is(pattern) for name, pattern in FILE_CONDITIONS.items()}
    out["rust_test"] = _is(r"\.rs$") & _is(_TESTS)
    out["marker_source"] = production & ~_is(r"(?i)\.d\.ts$")
    out["production"] = production & ~_is(r"(?i)(?:^|/)(?:build\.rs|fixtures?|__fixtures__)/") & ~(_is(tooling) if tooling else F.lit(False))
    out["dumping_ground"] = out["production"] & _is(r"(?i)(?:^|/)(?:utils?|helpers?|common|misc|shared|stuff)\.(?:ts|tsx|js|jsx|mjs|cjs|rs|py)$")
    return out


def comment_of(rel: Column, line: Column) -> Column:
    """What a line's comment begins with and all after it, empty without one; in files of other kinds the whole line."""
    script = F.regexp_extract(line, r"(?s)((?://|/\*).*)$", 1)
    return F.when(rel.rlike(_SCRIPT + r"|\.rs$"), script).when(rel.rlike(_PYTHON), F.regexp_extract(line, r"(?s)(#.*)$", 1)).otherwise(line)


def _told(hits: list[Column]) -> Column:
    return F.array_compact(F.array(*hits))


def _hit(holds: Column, rule_id: str, detail: str) -> Column:
    return F.when(holds, F.struct(F.lit(rule_id).alias("rule_id"), F.lit(detail).alias("detail")))


def line_findings(files: DataFrame, wrapper: str | None = None, tooling: str | None = None) -> DataFrame:
    """(rule_id, rel, line_no, detail) of the lines of files(rel, text).

    wrapper: a pattern for a command that structures the output of others, so that the command rules let it pass.
    """
    held = conditions(tooling)
    secret = F.lit(False)
    for _, pattern, _ in rules.SECRET_RULES:
        secret |= _is(pattern, "line")
    names = sorted({r.when for r in LINE_RULES} | {"test", "fixture"})
    f = files.where(F.col("text").isNotNull()).select("rel", "text", F.struct(*[held[n].alias(n) for n in names]).alias("is"))
    lines = f.select("rel", "is", F.posexplode(F.split("text", r"\r?\n", -1)).alias("pos", "line"))
    lines = lines.withColumns({"comment": comment_of(F.col("rel"), F.col("line")), "path_and_line": F.concat_ws(" ", "rel", "line"), "secret": secret, "command": _is(_COMMAND, "line")})
    hits = []
    for r in COMMAND_RULES:
        unless = f"{r.unless}|(?:{wrapper})" if wrapper and r.rule_id != "SEC-2.16" else r.unless
        hits.append(_hit(F.col("command") & _is(r.pattern, "line") & ~_is(unless, "line"), r.rule_id, r.detail))
    for r in LINE_RULES:
        holds = F.col(f"is.{r.when}")
        if r.pattern:
            holds = holds & _is(r.pattern, r.subject)
        if r.unless:
            holds = holds & ~_is(r.unless, r.subject)
        hits.append(_hit(holds, r.rule_id, r.detail))
    hits.append(_hit(F.col("is.test") & F.col("secret"), "SEC-2.13", "secret-looking value found in snapshot/test artifact."))
    hits.append(_hit(F.col("is.fixture") & F.col("secret") & ~_is(r"(?i)\bfake\b|\bfixture\b|\bexample\b", "line"), "SEC-2.14", "fixture secret lacks explicit fake marker."))
    # an outer explode: the inner one would have its array worked out a second time, for a filter below it
    found = lines.select("rel", (F.col("pos") + 1).cast("long").alias("line_no"), F.explode_outer(_told(hits)).alias("hit"))
    return found.where("hit IS NOT NULL").select("hit.rule_id", "rel", "line_no", "hit.detail")


def file_findings(files: DataFrame) -> DataFrame:
    """(rule_id, rel, line_no 1, detail) of whole files(rel, text): what generated files must say, and packages without an owner.

    A package's folder has an owner if one of OWNERSHIP_FILES is in it among files(rel), by a join on folders.
    """
    text, made = F.col("text"), _is(GENERATED_PATH)
    hash_missing = made & ~_is(CONTENT_HASH, "text")
    hits = [
        _hit(made & ~_is(PROVENANCE, "text"), "GEN-2.2", "generated file lacks source owner or generator provenance."),
        _hit(hash_missing & _is(r"(?i)contract"), "GEN-2.4", "generated contract artifact lacks source schema hash."),
        _hit(hash_missing & _is(r"(?i)schema|\.json$"), "GEN-2.5", "generated schema artifact lacks reproducibility hash."),
        _hit(made & _is(r"(?i)\b(?:single source of truth|SOURCE_OF_TRUTH|authoritative)\b", "text"), "GEN-2.7", "generated file claims to be source of truth."),
    ]
    told = files.where(text.isNotNull()).select("rel", F.explode_outer(_told(hits)).alias("hit")).where("hit IS NOT NULL").select("hit.rule_id", "rel", "hit.detail")
    folder, name = F.regexp_replace("rel", "/?[^/]*$", ""), F.regexp_extract("rel", "([^/]*)$", 1)
    owned = files.where(name.isin(*OWNERSHIP_FILES)).select(folder.alias("folder")).distinct()
    packages = files.where(name.isin("package.json", "Cargo.toml")).select("rel", folder.alias("folder")).join(owned, "folder", "left_anti")
    orphans = packages.select(F.lit("ARCH-1.15").alias("rule_id"), "rel", F.lit("package/crate has no OWNERS, CODEOWNERS, or ownership README.").alias("detail"))
    return told.unionByName(orphans).select("rule_id", "rel", F.lit(1).cast("long").alias("line_no"), "detail")


def toolchain_findings(files: DataFrame) -> DataFrame:
    """(rule_id, rel, line_no, detail) of pyproject.toml and requirements.txt among files(rel, text), the files beside them included."""
    folder, name = F.regexp_replace("rel", "/?[^/]*$", ""), F.lower(F.regexp_extract("rel", "([^/]*)$", 1))
    here = files.select("rel", "text", folder.alias("folder"), name.alias("name"))
    beside = here.where(F.col("name").isin("uv.lock", "poetry.lock", "pdm.lock", "pyproject.toml")).select("folder", (F.col("name") == "pyproject.toml").alias("project")).groupBy("folder").agg(F.bool_or("project").alias("project"), F.bool_or(~F.col("project")).alias("lock"))
    own = here.where(F.col("name").isin("pyproject.toml", "requirements.txt") & F.col("text").isNotNull()).join(beside, "folder", "left")
    project = F.col("name") == "pyproject.toml"
    pyright, mypy = _is(r"\[tool\.pyright]", "text"), _is(r"\[tool\.mypy]", "text")
    strict = (pyright & ~_is(r"typeCheckingMode\s*=\s*[\"']strict[\"']", "text")) | (mypy & ~_is(r"strict\s*=\s*true", "text"))
    whole = [
        _hit(project & ~_is(r"\[tool\.ruff(?:\.|])", "text"), "PY-5.2", "pyproject.toml is missing Ruff configuration."),
        _hit(project & ~pyright & ~mypy, "PY-5.3", "pyproject.toml is missing Pyright or mypy configuration."),
        _hit(project & ((~pyright & ~mypy) | strict), "PY-5.4", "Python type checker strict mode is not enabled."),
        _hit(project & ~F.coalesce("lock", F.lit(False)), "PY-5.7", "Python lockfile is missing."),
        _hit(~project & ~F.coalesce("project", F.lit(False)), "PY-5.1", "requirements.txt has no pyproject.toml owner."),
    ]
    told = own.select("rel", F.lit(1).cast("long").alias("line_no"), F.explode_outer(_told(whole)).alias("hit"))
    lines = own.select("rel", project.alias("project"), F.posexplode(F.split("text", r"\r?\n", -1)).alias("pos", "line")).withColumn("trimmed", F.regexp_replace("line", r"^\s+|\s+$", ""))
    listed = ~F.col("project") & (F.col("trimmed") != "") & ~F.startswith(F.col("trimmed"), F.lit("#"))
    git = _is(r"(?i)git\+|https://github\.com", "trimmed")
    local = _is(r"(?:^|-e\s+)(?:\.{1,2}/|file:)", "trimmed")
    each = [
        _hit(F.col("project") & _is(r"(?i)git\+|@\s*git(?:hub|lab)?\.com|https://github\.com", "line"), "PY-5.9", "Python git dependency found."),
        _hit(F.col("project") & _is(r"(?:path|file)\s*=\s*[\"'][^\"']+[\"']|(?:\.\./|\./)", "line"), "PY-5.10", "Python local path dependency found."),
        _hit(listed & git, "PY-5.9", "Python git dependency found."),
        _hit(listed & ~git & local, "PY-5.10", "Python local path dependency found."),
        _hit(listed & ~git & ~local & ~_is(r"==[^=\s]+", "trimmed") & ~_is("--hash=", "trimmed"), "PY-5.8", "unpinned Python requirement found."),
    ]
    told = told.unionByName(lines.select("rel", (F.col("pos") + 1).cast("long").alias("line_no"), F.explode_outer(_told(each)).alias("hit")))
    return told.where("hit IS NOT NULL").select("hit.rule_id", "rel", "line_no", "hit.detail")


def common_findings(files: DataFrame, wrapper: str | None = None, tooling: str | None = None) -> DataFrame:
    """All of this module over files(rel, text): lines, whole files and Python toolchains."""
    return line_findings(files, wrapper, tooling).unionByName(file_findings(files)).unionByName(toolchain_findings(files))
