"""Rules as rows: what a line, a file or a path must look like, and where a rule holds.

A rule is (rule_id, pattern, unless, guard, gate, detail). It fires on a line that matches `pattern` and not `unless`,
in files whose path class `guard` holds. `gate` has literals of which any match needs one: a file without them
is not cut into lines for that rule, so a table of many rules costs little on files that have nothing to find.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfold.functions.text import ascii_boundaries


@dataclass(frozen=True)
class Rule:
    rule_id: str
    pattern: str
    detail: str
    gate: tuple[str, ...]
    unless: str | None = None
    guard: str | None = None


# The path classes, as patterns over a relative path.
PATH_CLASSES = {
    "is_test": r"(?i)(?:^|/)(?:test|tests|__tests__)/|(?:\.test|\.spec)\.[cm]?[jt]sx?$",
    "is_python_test": r"(?i)(?:^|/)tests?/|(?:^|/)test_[^/]+\.py$|_test\.py$",
    "is_config": r"(?i)(?:^|/)(?:config|settings|env)(?:/|_|\.py$)|(?:^|/)(?:config|settings)\.py$",
    "is_generated": r"(?i)(?:^|/)(?:generated|__generated__|snapshots?|__snapshots__|test-results|output)/|(?:^|/)[^/]*snapshot[^/]*\.(?:[cm]?[jt]sx?|json|txt|md|snap)$|\.(?:snap|snapshot)$",
    "is_source_root": r"^(?:src|apps|packages|crates|tools|scripts)/",
    "is_sensitive": r"(?i)(?:^|/)(?:google-services\.json|googleservice-info\.plist|id_rsa(?:\.pub)?|\.env(?:\.[^/]+)?)$|\.(?:pem|p12|pfx|key)$",
    "is_output": r"(?i)(?:^|/)(?:output|test-results|playwright-report)/",
    "is_index": r"(?:^|/)index\.[cm]?[jt]sx?$",
}
# Rules over lines of Python.
PYTHON_RULES = (
    Rule("PY-4.7", r"\bTypedDict\b", "TypedDict domain model found.", ("TypedDict",)),
    Rule("PY-4.8", r"\bBaseModel\b", "Pydantic BaseModel domain model found.", ("BaseModel",)),
    Rule("PY-4.9", r"^\s*[A-Za-z_]\w*\s*:.*\b(?:Optional\s*\[|None\s*\|)", "Optional field found in domain model.", ("Optional", "None")),
    Rule("PY-4.11", r"^\s*except\s+Exception\s*(?:as\s+\w+)?\s*:", "Broad except Exception handler found.", ("except",)),
    Rule("PY-4.12", r"^\s*except\s*:", "Bare except handler found.", ("except",)),
    Rule("PY-4.14", r"^\s*print\s*\(", "print debugging found in Python source.", ("print",), guard="production"),
    Rule("PY-4.15", r"^\s*assert\s+.+", "runtime assert found in Python source.", ("assert",), guard="production"),
    Rule("PY-4.16", r"\b(?:eval|exec|compile)\s*\(", "eval/exec/compile found.", ("eval", "exec", "compile")),
    Rule("PY-4.17", r"\bsubprocess\.(?:run|call|check_call|check_output|Popen)\s*\([^#\n]*\bshell\s*=\s*True", "subprocess shell=True found.", ("subprocess",)),
    Rule("PY-4.18", r"\bos\.system\s*\(", "os.system found.", ("os.system",)),
    Rule("PY-4.19", r"\bpickle\.loads\s*\(", "pickle.loads found.", ("pickle.loads",)),
    Rule("PY-4.20", r"\byaml\.load\s*\(", "yaml.load without SafeLoader found.", ("yaml.load",), unless=r"\byaml\.load\s*\([^)]*(?:SafeLoader|safe_load)"),
    Rule("PY-4.22", r"\b(?:importlib\.import_module|__import__)\s*\(", "dynamic import found.", ("import",)),
    Rule("PY-4.23", r"\bdatetime\.(?:now|utcnow)\s*\(\s*\)", "naive datetime call found.", ("datetime",)),
    Rule("PY-4.25", r"\brequests\.(?:get|post|put|patch|delete|head|options)\s*\(", "requests call without timeout found.", ("requests.",), unless=r"\btimeout\s*="),
    Rule("PY-4.26", r"\basyncio\.create_task\s*\(", "asyncio.create_task result is not tracked.", ("create_task",), unless=r"^\s*(?:\w+\s*=|return\s+|await\s+)"),
    Rule("PY-4.28", r"^\s*from\s+\.\.", "parent-relative import found.", ("from",)),
    Rule("PY-4.29", r"^\s*from\s+[\w.]+\s+import\s+\*", "wildcard import found.", ("import",)),
    Rule("PY-4.30", r"^\s*from\s+[\w.]+\s+import\s+\*", "from-module wildcard import found.", ("import",)),
    Rule("PY-4.33", r"\b(?:NamedTuple|typing\.NamedTuple|collections\.namedtuple)\b", "NamedTuple or tuple domain record found.", ("amed",)),
    Rule("PY-4.35", r"\bos\.environ(?:\.|\[)|\bos\.getenv\s*\(", "environment read found outside config boundary.", ("os.",), guard="outside_config"),
    Rule("PY-2.1", r"@pytest\.mark\.(?:skip|skipif|xfail|focus)|pytest\.skip\s*\(|unittest\.skip", "Skipped or focused Python test found.", ("test.",), guard="test"),
    Rule("PY-6.5", r"\b(?:monkeypatch|unittest\.mock|mock\.|Mock\s*\(|patch\s*\()", "monkeypatch/mock usage found in Python test.", ("mock", "Mock", "patch"), guard="test"),
    Rule("PY-6.6", r"\b(?:requests\.|httpx\.|urllib\.request|socket\.)", "network API found in Python unit test.", ("requests.", "httpx.", "urllib", "socket."), guard="test"),
)
# Rules over lines of TypeScript.
TYPESCRIPT_RULES = (
    Rule("TS-6.1", r"(?::\s*any\b|<\s*any\s*>|\bArray\s*<\s*any\s*>|\bRecord\s*<\s*string\s*,\s*any\s*>|\bas\s+any\b)", "any type usage found", ("any",), guard="hand_written"),
    Rule("TS-6.4", r"\bas\s+unknown\s+as\s+[A-Za-z_$][\w$]*", "double type assertion found", ("unknown",), guard="hand_written"),
    Rule("TS-6.6", r"^\s*(?:public|private|protected|readonly|\s)*[A-Za-z_$][\w$]*!\s*:", "definite assignment assertion found", ("!",), guard="hand_written"),
    Rule("TS-6.10", r"\bRecord\s*<\s*string\s*,\s*[A-Z][A-Za-z0-9_]*(?:\[\])?\s*>", "Record<string, domain> API found", ("Record",), guard="hand_written"),
    Rule("TS-6.11", r"\bMap\s*<\s*string\s*,\s*[A-Z][A-Za-z0-9_]*(?:\[\])?\s*>", "Map<string, domain> API found", ("Map",), guard="hand_written"),
    Rule("TS-6.13", r"^\s*export\s+default\b", "default export found", ("default",), guard="hand_written"),
    Rule("TS-6.14", r"""^\s*export\s+(?:\*\s*(?:as\s+\w+\s*)?|(?:type\s+)?\{[^}]+\})\s+from\s+['"][^'"]+['"]""", "index barrel re-export found", ("export",), guard="index"),
    Rule("TS-6.15", r"^\s*(?:export\s+)?namespace\s+[A-Za-z_$][\w$]*", "namespace declaration found", ("namespace",), guard="hand_written"),
    Rule("TS-6.16", r"^\s*(?:export\s+)?(?:const\s+)?enum\s+[A-Za-z_$][\w$]*", "enum declaration found", ("enum",), guard="hand_written"),
    Rule("TS-6.18", r"\bprocess\.env(?:\.|\[)", "process.env read outside config boundary", ("process.env",), guard="outside_config"),
    Rule("TS-6.21", r"\bPromise\s*<\s*(?:any|unknown)\s*>", "Promise<any|unknown> found", ("Promise",), guard="hand_written"),
    Rule("TS-6.23", r"\.catch\s*\(\s*(?:\(\s*\)|[A-Za-z_$][\w$]*)\s*=>\s*\{\s*\}\s*\)", "empty promise catch handler found", ("catch",), guard="hand_written"),
    Rule("TS-6.24", r"\bconsole\.(?:log|debug|info|warn|error|trace)\s*\(", "console logging found", ("console",), guard="hand_written"),
    Rule("TS-6.26", r"\breturn\s+null\s*;", "return null found", ("null",), guard="hand_written"),
    Rule("TS-6.29", r"\bPartial\s*<\s*[A-Z][A-Za-z0-9_$]*\s*>", "Partial<T> domain value found", ("Partial",), guard="hand_written"),
    Rule("TS-6.30", r"\bRecord\s*<\s*string\s*,\s*unknown\s*>", "Record<string, unknown> payload found", ("unknown",), guard="hand_written"),
    Rule("TS-6.32", r"\bimport\s*\(", "dynamic import found", ("import",), guard="hand_written"),
    Rule("TS-6.34", r"\b(?:eval|Function)\s*\(", "dynamic code execution found", ("eval", "Function"), guard="hand_written"),
    Rule("TS-8.1", r"\b(?:describe|it|test)\s*\.\s*(?:skip|only|todo)\s*\(", "skipped/focused TypeScript test found", ("skip", "only", "todo"), guard="test"),
    Rule("TS-8.2", r"expect\.(?:anything|any)\s*\(", "expect.any assertion found", ("expect",), guard="test"),
    Rule("TS-8.3", r"\.(?:toBeTruthy|toBeDefined|not\.toThrow)\s*\(", "weak TypeScript assertion found", ("toBe", "toThrow"), guard="test"),
    Rule("TS-8.6", r"\b(?:fetch|axios\.|request\.|supertest\(|http\.|https\.)", "network call in unit test found", ("fetch", "axios", "request", "supertest", "http"), guard="test"),
)
# Gates of the secret rules; those of rules that ignore case are in lower case.
SECRET_GATES = {
    "SEC-2.1": ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), "SEC-2.2": ("AKIA",), "SEC-2.3": ("service_account", "private_key_id"), "SEC-2.4": ("azure_",),
    "SEC-2.5": ("xox", "discord"), "SEC-2.6": ("eyJ",), "SEC-2.7": ("-----BEGIN ",), "SEC-2.8": ("npm_", "pypi-", "CARGO_REGISTRY_TOKEN"),
    "SEC-2.9": ("_live_", "_test_"), "SEC-2.10": ("secret", "token", "password", "key"),
}


def with_path_classes(files: DataFrame) -> DataFrame:
    """files(rel, ...) with a boolean column for each path class, worked out once a file."""
    return files.withColumns({name: F.coalesce(F.col("rel").rlike(p), F.lit(False)) for name, p in PATH_CLASSES.items()})


def _holds(guard: str | None) -> Column:
    test = F.col("is_test") | F.col("is_python_test")
    return {
        None: F.lit(True), "production": ~test, "test": test, "outside_config": ~F.col("is_config") & ~F.col("is_generated"),
        "hand_written": ~F.col("is_generated"), "index": F.col("is_index") & ~F.col("is_generated"),
    }[guard]


def rule_findings(files: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(rule_id, rel, line_no, detail) of files(rel, text): guards and gates once a file, patterns on the lines of what is left."""
    f = with_path_classes(files.select("rel", "text"))
    folded = any(r.pattern.startswith("(?i)") for r in rules)
    f = f.withColumn("folded", F.lower("text")) if folded else f

    def may(rule: Rule) -> Column:
        where = F.col("folded" if rule.pattern.startswith("(?i)") else "text")
        out = F.lit(False)
        for literal in rule.gate:
            out |= where.contains(literal)
        return out & _holds(rule.guard)

    f = f.select("rel", "text", F.array(*map(may, rules)).alias("may")).where(F.exists("may", lambda m: m))
    lines = f.select("rel", "may", F.posexplode(F.split("text", r"\r?\n", -1)).alias("pos", "line"))

    def fires(k: int, rule: Rule) -> Column:
        hit = F.col("may")[k] & F.col("line").rlike(ascii_boundaries(rule.pattern))
        return hit & ~F.col("line").rlike(ascii_boundaries(rule.unless)) if rule.unless else hit

    hits = F.array_compact(F.array(*[F.when(fires(k, r), F.struct(F.lit(r.rule_id).alias("rule_id"), F.lit(r.detail).alias("detail"))) for k, r in enumerate(rules)]))
    # an outer explode: below an inner one a filter would work the array out a second time
    found = lines.select("rel", (F.col("pos") + 1).cast("long").alias("line_no"), F.explode_outer(hits).alias("hit"))
    return found.where("hit IS NOT NULL").select("hit.rule_id", "rel", "line_no", "hit.detail")


# --- rules that look at lines around a line, on the array of a file's lines: no shuffle puts files together again ---


def _lines(files: DataFrame) -> DataFrame:
    return files.where(F.col("text").isNotNull()).select("rel", F.split("text", r"\r?\n", -1).alias("a"))


def _each(files: DataFrame, start: str, picked) -> DataFrame:
    """(rel, line_no, line, around) of lines that match `start`; picked(array, index) is computed for those alone."""
    at = F.filter(F.transform("a", lambda line, i: F.when(line.rlike(start), i)), lambda i: i.isNotNull())
    rows = _lines(files).select("rel", "a", F.explode(at).alias("i"))
    return rows.select("rel", (F.col("i") + 1).cast("long").alias("line_no"), F.get("a", F.col("i")).alias("line"), picked(F.col("a"), F.col("i")).alias("around"))


def _before(a: Column, i: Column, distance: int) -> Column:
    """The `distance` lines before line i, and itself."""
    return F.slice(a, F.greatest(i - distance + 1, F.lit(1)), F.least(i, F.lit(distance)) + 1)


def unguarded(files: DataFrame, pattern: str, token: str, distance: int = 4) -> DataFrame:
    """(rel, line_no, line): lines that match pattern unless token is in them or in the `distance` lines before."""
    rows = _each(files, ascii_boundaries(pattern), lambda a, i: F.exists(_before(a, i, distance), lambda x: x.contains(token)))
    return rows.where(~F.col("around")).select("rel", "line_no", "line")


def sleeps(files: DataFrame, distance: int = 12) -> DataFrame:
    """(rule_id, rel, line_no, line) of sleeps: PY-6.7 in tests, PY-4.24 elsewhere if an async function begins in the line or in the `distance` lines before."""
    rows = _each(files, ascii_boundaries(r"\b(?:time\.sleep|asyncio\.sleep)\s*\("), lambda a, i: F.exists(_before(a, i, distance), lambda x: x.rlike(r"async\s+def")))
    test = F.col("rel").rlike(PATH_CLASSES["is_test"]) | F.col("rel").rlike(PATH_CLASSES["is_python_test"])
    return rows.where(test | F.col("around")).select(F.when(test, "PY-6.7").otherwise("PY-4.24").alias("rule_id"), "rel", "line_no", "line")


def documented_before(before: Column) -> Column:
    """Whether the nearest line before is, or ends, a documentation comment."""
    return F.coalesce(F.startswith(before, F.lit("/**")) | F.endswith(before, F.lit("*/")), F.lit(False))


def without_docstring(files: DataFrame) -> DataFrame:
    """(rel, line_no) of top-level Python functions and classes whose next line with anything on it begins no docstring."""
    rows = nearest_filled(files, r"^(?:async\s+)?def\s+[A-Za-z_]\w*\s*\(|^class\s+[A-Za-z_]\w*")
    quoted = F.startswith("after", F.lit('"' * 3)) | F.startswith("after", F.lit("'" * 3))
    return rows.where(~F.coalesce(quoted, F.lit(False))).select("rel", "line_no")


def followed_by(files: DataFrame, pattern: str, first: str, within: int = 3, insignificant: str = r"^\s*(#|$)") -> DataFrame:
    """(rel, line_no, line, after): lines that match pattern whose first significant line among the next `within` matches `first`."""
    rows = _each(files, pattern, lambda a, i: F.get(F.filter(F.slice(a, i + 2, within), lambda x: ~x.rlike(insignificant)), F.lit(0)))
    return rows.where(F.col("around").rlike(first)).select("rel", "line_no", "line", F.col("around").alias("after"))


def nearest_filled(files: DataFrame, pattern: str) -> DataFrame:
    """(rel, line_no, before, after): lines that match pattern with the nearest lines around them that aren't blank, trimmed."""
    filled = lambda part: F.filter(F.transform(part, lambda x: F.trim(x)), lambda x: x != "")
    rows = _each(files, pattern, lambda a, i: F.struct(
        F.try_element_at(filled(F.slice(a, F.lit(1), i)), F.lit(-1)).alias("before"),
        F.get(filled(F.slice(a, i + 2, F.greatest(F.size(a) - i - 1, F.lit(0)))), F.lit(0)).alias("after")))
    return rows.select("rel", "line_no", "around.before", "around.after")


def multi_line_matches(files: DataFrame, pattern: str) -> DataFrame:
    """(rel, line_no, match): matches of a pattern over whole texts, with the line each starts on.

    A text's parts before its matches are what a split by the pattern leaves; one fold with a running line number goes
    over both, and the matches it has passed are kept in chunks.
    """
    kind = "array<struct<line_no:long,match:string>>"
    rows = files.where(F.col("text").isNotNull()).select("rel", F.regexp_extract_all("text", F.lit(f"({pattern})"), 1).alias("m"), F.split("text", pattern, -1).alias("gap")).where(F.size("m") > 0)
    feeds = lambda s: (F.length(s) - F.length(F.replace(s, F.lit("\n"), F.lit("")))).cast("long")
    steps = F.zip_with("m", "gap", lambda m, g: F.struct(feeds(g).alias("gap"), F.coalesce(feeds(m), F.lit(0)).cast("long").alias("own"), m.alias("match")))
    first = F.struct(F.lit(1).cast("long").alias("line"), F.array().cast(f"array<{kind}>").alias("full"), F.array().cast(kind).alias("out"))

    def step(acc, x):
        at, full = acc["line"] + x["gap"], F.size(acc["out"]) >= 256
        one = F.when(x["match"].isNotNull(), F.array(F.struct(at.alias("line_no"), x["match"].alias("match")))).otherwise(F.array().cast(kind)).cast(kind)
        kept, out = F.when(full, F.concat(acc["full"], F.array(acc["out"]))).otherwise(acc["full"]), F.when(full, one).otherwise(F.concat(acc["out"], one))
        return F.struct((at + x["own"]).alias("line"), kept.alias("full"), out.cast(kind).alias("out"))

    found = F.aggregate(steps, first, step, lambda acc: F.concat(F.flatten(acc["full"]), acc["out"]))
    return rows.select("rel", F.inline(found))


def untyped_functions(files: DataFrame) -> DataFrame:
    """(rel, line_no, missing_param, missing_return) of one-line Python definitions outside tests that lack annotations."""
    head = r"^\s*(?:async\s+)?def\s+([A-Za-z_]\w*)\s*\(([^)]*)\)\s*(?:->\s*([^:]+))?:"
    f = with_path_classes(files.select("rel", "text")).where(~F.col("is_test") & ~F.col("is_python_test"))
    rows = f.select("rel", F.posexplode(F.split("text", r"\r?\n", -1)).alias("pos", "line")).where(F.col("line").rlike(head))
    params = F.filter(F.transform(F.split(F.regexp_extract("line", head, 2), ","), lambda p: F.trim(p)), lambda p: (p != "") & ~p.rlike(r"^(?:self|cls)(?:\s|$)"))
    rows = rows.select("rel", (F.col("pos") + 1).cast("long").alias("line_no"), F.exists(params, lambda p: ~p.contains(":")).alias("missing_param"), (F.regexp_extract("line", head, 3) == "").alias("missing_return"))
    return rows.where("missing_param OR missing_return")


def missing_markers(files: DataFrame, specs: DataFrame) -> DataFrame:
    """(rule_id, rel, missing): patterns of specs(rule_id, rel, patterns array) that the file's text lacks; an absent file lacks all."""
    j = specs.join(files.select("rel", "text"), "rel", "left")
    missing = F.filter("patterns", lambda p: ~F.coalesce(F.regexp_like(F.col("text"), p), F.lit(False)))
    return j.select("rule_id", "rel", F.array_join(missing, ",").alias("missing")).where("missing <> ''")
