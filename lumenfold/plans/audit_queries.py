"""Queries of audits, projections and inventory over configurations, manifests and scripts that Spark derives from the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.functions import text as T
from lumenfold.operators import audits, globs, inventory, policy, projections
from lumenfold.plans import catalog as C
from lumenfold.plans import rule_queries as R


def _pick(values: tuple[str, ...], index) -> F:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index % len(values) + 1).cast("int"))


def _pick_sql(values: tuple[str, ...], index: str) -> str:
    return "[" + ", ".join("NULL" if v is None else "'" + v.replace("'", "''") + "'" for v in values) + f"][{index} % {len(values)} + 1]"


# --- configuration and waivers -------------------------------------------------------------------

_SETTINGS = {"schemaVersion": ("1", None, "2"), "profileName": ("strict", "loose", "odd", None), "failOn": ("error", "warning", None), "allowUnsafeCode": ("true", "false"), "publicReexportPolicy": ("allow", "deny", None), "waiverId": (None, "W1", None, None, None), "extra": (None, None, None, "x")}


@C.query("WITH s AS (SELECT user_id * 100000 + event_id AS config_id, " + ", ".join(f'{_pick_sql(v, f"(event_id // {k + 1})")} AS "{n}"' for k, (n, v) in enumerate(_SETTINGS.items())) + """ FROM events), x AS (
SELECT config_id, 'CFG-1.9' AS code FROM s WHERE extra IS NOT NULL UNION ALL SELECT config_id, 'CFG-1.10' FROM s WHERE "schemaVersion" IS NULL OR "profileName" IS NULL UNION ALL SELECT config_id, 'CFG-1.11' FROM s WHERE "profileName" = 'odd'
UNION ALL SELECT config_id, 'CFG-1.1' FROM s WHERE "profileName" = 'strict' AND "failOn" IS DISTINCT FROM 'error' UNION ALL SELECT config_id, 'CFG-1.4' FROM s WHERE "allowUnsafeCode" = 'true' AND "waiverId" IS NULL
UNION ALL SELECT config_id, 'CFG-1.5' FROM s WHERE "profileName" = 'strict' AND "publicReexportPolicy" = 'allow' AND "waiverId" IS NULL) SELECT * FROM x""")
def config_lockdown(spark, d):
    e = C.table(spark, d, "events")
    entries = F.array(*[F.struct(F.lit(n).alias("key"), _pick(v, F.floor(F.col("event_id") / (k + 1))).alias("value")) for k, (n, v) in enumerate(_SETTINGS.items())])
    configs = e.select((F.col("user_id") * 100000 + F.col("event_id")).alias("config_id"), F.map_from_entries(F.filter(entries, lambda x: x["value"].isNotNull())).alias("settings"))
    return audits.config_lockdown(configs, [n for n in _SETTINGS if n != "extra"], ["strict", "loose"])


_OVERRIDE_IDS = ("txt-1.1", "TXT-1.2", "TXT-1.3", "TXT-1.4", "TXT-9.9")


@C.query(f"WITH {C._REG}, o AS (SELECT event_id, upper({_pick_sql(_OVERRIDE_IDS, 'event_id')}) AS rule_id, event_id % 3 = 0 AS off, {_pick_sql(('info', 'warning', 'error', None), '(event_id // 5)')} AS sev, {_pick_sql((None, '', 'W'), '(event_id // 7)')} AS w FROM events), " + """
r AS (SELECT reg.*, CASE severity WHEN 'error' THEN 3 WHEN 'warning' THEN 2 ELSE 1 END AS rank FROM reg), j AS (SELECT o.*, r.rule_id AS known, r.can_disable, r.can_downgrade, r.rank, CASE o.sev WHEN 'error' THEN 3 WHEN 'warning' THEN 2 WHEN 'info' THEN 1 END AS new_rank FROM o LEFT JOIN r ON o.rule_id = r.rule_id),
x AS (SELECT rule_id, 'ENF-1.3' AS code FROM j WHERE known IS NULL UNION ALL SELECT rule_id, 'CFG-1.2' FROM j WHERE off AND NOT can_disable UNION ALL SELECT rule_id, 'CFG-1.3' FROM j WHERE new_rank < rank AND NOT can_downgrade UNION ALL SELECT rule_id, 'CFG-1.8' FROM j WHERE off AND can_disable AND coalesce(trim(w), '') = '')
SELECT rule_id, code, count(*) AS n FROM x GROUP BY ALL""")
def override_audit(spark, d):
    i = F.col("event_id")
    o = C.table(spark, d, "events").select(_pick(_OVERRIDE_IDS, i).alias("rule_id"), (i % 3 != 0).alias("enabled"), _pick(("info", "warning", "error", None), F.floor(i / 5)).alias("severity"), _pick((None, "", "W"), F.floor(i / 7)).alias("waiver_id"))
    return audits.override_audit(o, C.registry(spark)).groupBy("rule_id", "code").agg(F.count("*").alias("n"))


_OWNERS = ("dana", "", "codex", "Agent", "build agent liaison", None, " ai ", "lina")
_EXPIRES = (None, "soon", "", "1998-02-30x", "98-01-01", "2024-01-01T00:00:00Z")
_SCOPES = ("src/a/**", "**", "src\\**", "/", "*", "src/**", " . ", "docs/x.md")
_SCOPE_SQL = ("src/a/**", "**", "src/**", "/", "*", "src/**", ".", "docs/x.md")
_LEVELS = "VALUES ('1-URGENT', 'error', NULL, NULL), ('2-HIGH', 'error', NULL, true), ('3-MEDIUM', 'error', 'waiver-required', NULL), ('4-NOT SPECIFIED', 'info', 'immutable', false)"


@C.query(f"""WITH reg(rule_id, severity, lock_level, waivable) AS ({_LEVELS}), w AS (SELECT o_orderkey AS waiver_id, o_orderpriority AS rule_id, {_pick_sql(_OWNERS, 'o_orderkey')} AS owner, CASE WHEN o_orderkey % 10 <> 0 THEN 'I' END AS issue,
CASE WHEN o_orderkey % 11 < 2 THEN {_pick_sql(_EXPIRES, 'o_orderkey')} ELSE strftime(o_orderdate + INTERVAL (o_orderkey % 400) DAY, '%Y-%m-%d') END AS expires, {_pick_sql(_SCOPE_SQL, 'o_orderkey')} AS scope, o_orderkey % 13 = 0 AS no_scope,
CASE WHEN o_orderkey % 5 > 0 THEN o_orderkey % 5 > 1 END AS ci, CASE WHEN o_orderkey % 7 > 0 THEN o_orderkey % 7 > 1 END AS visible, CASE WHEN o_orderkey % 9 > 0 THEN 'plan' ELSE ' ' END AS remediation FROM orders),
d AS (SELECT w.*, date_diff('day', DATE '1998-01-01', CASE WHEN regexp_full_match(expires, '\\d{{4}}-\\d{{2}}-\\d{{2}}') THEN try_cast(expires AS DATE) END) AS days, coalesce(reg.lock_level, CASE WHEN reg.severity = 'error' THEN 'immutable' WHEN reg.severity IS NOT NULL THEN 'advisory' END) AS level, coalesce(reg.waivable, false) AS waivable FROM w LEFT JOIN reg ON upper(w.rule_id) = reg.rule_id),
x AS (SELECT waiver_id, 'WAIVER-1.1' AS code FROM d WHERE trim(coalesce(owner, '')) = '' OR issue IS NULL OR trim(coalesce(expires, '')) = '' OR remediation = ' ' OR no_scope OR ci IS NULL
UNION ALL SELECT waiver_id, 'WAIVER-1.2' FROM d WHERE NOT no_scope AND scope IN ('', '.', '/', '**', '**/*', 'src/**', 'crates/**', 'packages/**', 'apps/**') UNION ALL SELECT waiver_id, 'WAIVER-1.3' FROM d WHERE days IS NULL OR days < 0
UNION ALL SELECT waiver_id, 'WAIVER-1.4' FROM d WHERE level = 'immutable' AND NOT waivable UNION ALL SELECT waiver_id, 'WAIVER-1.5' FROM d WHERE NOT coalesce(ci, false) UNION ALL SELECT waiver_id, 'WAIVER-1.6' FROM d WHERE NOT visible
UNION ALL SELECT waiver_id, 'WAIVER-1.8' FROM d WHERE days > 90 UNION ALL SELECT waiver_id, 'WAIVER-1.9' FROM d WHERE lower(trim(owner)) IN ('ai', 'codex', 'agent', 'llm') UNION ALL SELECT waiver_id, 'WAIVER-1.10' FROM d WHERE remediation = ' '
UNION ALL SELECT NULL, 'WAIVER-1.7' FROM (SELECT count(*) AS n FROM w) WHERE n > 250) SELECT * FROM x""")
def waiver_audit(spark, d):
    k = F.col("o_orderkey")
    expires = F.when(k % 11 < 2, _pick(_EXPIRES, k)).otherwise(F.date_format(F.date_add(F.to_date("o_orderdate"), (k % 400).cast("int")), "yyyy-MM-dd"))
    w = C.table(spark, d, "orders").select(
        k.alias("waiver_id"), F.col("o_orderpriority").alias("rule_id"), _pick(_OWNERS, k).alias("owner"), F.when(k % 10 != 0, "I").alias("issue"), F.lit("why").alias("reason"), F.when(k % 13 != 0, F.array(_pick(_SCOPES, k))).otherwise(F.array().cast("array<string>")).alias("scope"),
        expires.alias("expires"), F.when(k % 9 > 0, "plan").otherwise(" ").alias("remediation"), F.when(k % 5 > 0, k % 5 > 1).alias("ci_allowed"), F.when(k % 7 > 0, k % 7 > 1).alias("visible"),
    )
    registry = spark.sql(f"SELECT * FROM ({_LEVELS}) AS t(rule_id, severity, lock_level, waivable)")
    return audits.waiver_audit(w, registry, "1998-01-01", max_active=250, in_ci=True)


# every line rule's finding beside waivers that the documents themselves name: a folder, a name, an extension or a pattern
_SCOPE_OF = "CASE doc_id % 5 WHEN 0 THEN source || '/' || doc_id || '.' || lang WHEN 1 THEN source || '/' || left(doc_id::VARCHAR, 2) || '*' WHEN 2 THEN '*/' || doc_id || '*.' || lang WHEN 3 THEN './' || source || '/' || doc_id || '.*' ELSE 'src/**' END"


@C.query(f"""WITH {C.TEXT_FINDINGS}, w AS (SELECT doc_id AS ordinal, 'TXT-1.' || (doc_id % 5 + 1) AS rule_id, {_SCOPE_OF} AS scope FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL),
p AS (SELECT ordinal, rule_id, '^' || replace(replace(regexp_replace(scope, '^[.]/', ''), '.', '[.]'), '*', '[^/]*') || '$' AS pattern FROM w WHERE scope <> 'src/**')
SELECT finding_id, (SELECT 'W' || min(ordinal) FROM p WHERE p.rule_id = x1.rule_id AND regexp_matches(x1.rel, p.pattern)) AS waiver_id FROM x1""")
def waiver_index_join(spark, d):
    i, s, lang = F.col("doc_id"), F.col("source"), F.col("lang")
    n = i.cast("string")
    scope = F.when(i % 5 == 0, F.concat(s, F.lit("/"), n, F.lit("."), lang)).when(i % 5 == 1, F.concat(s, F.lit("/"), F.left(n, F.lit(2)), F.lit("*"))).when(i % 5 == 2, F.concat(F.lit("*/"), n, F.lit("*."), lang)).when(i % 5 == 3, F.concat(F.lit("./"), s, F.lit("/"), n, F.lit(".*"))).otherwise("src/**")
    docs = C.table(spark, d, "documents").where("lang IS NOT NULL AND source IS NOT NULL")
    w = docs.select(i.alias("ordinal"), F.concat(F.lit("TXT-1."), (i % 5 + 1).cast("string")).alias("rule_id"), F.concat(F.lit("W"), n).alias("waiver_id"), F.lit("dana").alias("owner"), F.lit("I").alias("issue"), F.lit("why").alias("reason"), F.array(scope).alias("scope"),
        F.lit("2030-01-01").alias("expires"), F.lit(True).alias("ci_allowed"), F.lit(None).cast("boolean").alias("visible"))
    return policy.split_by_waiver(C.text_findings(spark, d), policy.valid_waivers(w, C.AS_OF)).select("finding_id", "waiver_id")


# limits of pages' paths that the hosts of other pages relax: the last one that names a limit holds
@C.query(f"""WITH {C.PATHS}, o AS (SELECT page_id AS ordinal, CASE page_id % 3 WHEN 0 THEN split_part(path, '/', 1) || '/**' WHEN 1 THEN split_part(path, '/', 1) || '/*/' || (page_id % 10) || '*' ELSE '**/' || split_part(path, '/', -1) END AS gl,
CASE WHEN page_id % 2 = 0 THEN 'max_lines' ELSE 'max_depth' END AS key, CASE WHEN page_id % 7 > 0 THEN page_id % 500 END AS value FROM pq WHERE split_part(path, '/', -1) <> ''),
g AS (SELECT *, '^' || replace(replace(replace(replace(gl, '.', '[.]'), '**', chr(1)), '*', '[^/]*'), chr(1), '.*') || '$' AS pattern FROM o WHERE value IS NOT NULL)
SELECT p.path AS rel, g.key, arg_max(g.value, g.ordinal) AS value FROM (SELECT DISTINCT path FROM pq) p JOIN g ON regexp_matches(p.path, g.pattern) GROUP BY 1, 2""")
def shape_override_index(spark, d):
    p = C.page_paths(spark, d).select("page_id", F.col("path").alias("rel"))
    i, host, last = F.col("page_id"), F.element_at(F.split("rel", "/"), 1), F.element_at(F.split("rel", "/"), -1)
    glob = F.when(i % 3 == 0, F.concat(host, F.lit("/**"))).when(i % 3 == 1, F.concat(host, F.lit("/*/"), (i % 10).cast("string"), F.lit("*"))).otherwise(F.concat(F.lit("**/"), last))
    o = p.where(last != "").select(i.alias("ordinal"), glob.alias("glob"), F.when(i % 2 == 0, "max_lines").otherwise("max_depth").alias("key"), F.when(i % 7 > 0, i % 500).alias("value"))
    return globs.last_values(p, o)


# --- manifests -----------------------------------------------------------------------------------

_VERSIONS = ("1.2.3", "^1.2.0", "latest", " 1.0.0-rc.1 ", "git+https://h/x.git", "npm:@a/b@1.2.3", ">=2", "1.2", "v1.0.0", "workspace:*", "1.0.0+build.5", "npm:b@^1", "", None)
_PACKAGES = ("eslint-js", "my-eslint_next", "Vitest-Lib", "eslint", "duckdb-wasm", "effect-safe2", "typescript_new")
_DEPS = f"d AS (SELECT l_orderkey * 10 + l_linenumber AS item_id, {_pick_sql(_PACKAGES, 'l_suppkey')} AS name, {_pick_sql(_VERSIONS, 'l_partkey')} AS version FROM lineitem)"


@C.query(f"""WITH {_DEPS} SELECT item_id, name, 'not-exact' AS code FROM d WHERE NOT regexp_full_match(trim(coalesce(version, '')), '(npm:[@A-Za-z0-9._/-]+@)?[0-9]+[.][0-9]+[.][0-9]+([-+][0-9A-Za-z.-]+)?')
UNION ALL SELECT item_id, name, 'suspicious-name' FROM d WHERE name IN ('eslint-js', 'my-eslint_next', 'Vitest-Lib', 'typescript_new')""")
def version_determinism(spark, d):
    l = C.table(spark, d, "lineitem")
    return audits.version_determinism(l.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("item_id"), _pick(_PACKAGES, F.col("l_suppkey")).alias("name"), _pick(_VERSIONS, F.col("l_partkey")).alias("version")))


@C.query("""WITH d AS (SELECT DISTINCT 'k' || l_suppkey % 97 AS package, 'p' || l_partkey AS name, CASE WHEN l_returnflag = 'A' THEN 'dev' ELSE 'normal' END AS kind, l_partkey FROM lineitem)
SELECT package, name, 'blocked' AS code FROM d WHERE l_partkey % 10 = 0 UNION SELECT package, name, 'test-only' FROM d WHERE l_partkey % 15 = 3 AND kind <> 'dev'""")
def dependency_sets(spark, d):
    p = C.table(spark, d, "lineitem").select("l_partkey").distinct()
    name = F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("name")
    deps = C.table(spark, d, "lineitem").select(F.concat(F.lit("k"), (F.col("l_suppkey") % 97).cast("string")).alias("package"), name, F.when(F.col("l_returnflag") == "A", "dev").otherwise("normal").alias("kind")).distinct()
    return audits.dependency_sets(deps, p.where("l_partkey % 10 = 0").select(name), p.where("l_partkey % 15 = 3").select(name))


@C.query("SELECT p_partkey AS name, p_brand AS licence FROM part WHERE p_brand NOT IN (SELECT p_brand FROM part WHERE p_size = 1)")
def licence_violations(spark, d):
    p = C.table(spark, d, "part")
    return audits.licence_violations(p.select(F.col("p_partkey").alias("name"), F.col("p_brand").alias("licence")), p.where("p_size = 1").select(F.col("p_brand").alias("licence")))


_FLAGS = ("strict", "noImplicitAny", "strictNullChecks"), ("alwaysStrict", "noImplicitThis")


@C.query("""WITH c AS (SELECT c_custkey AS rel, c_custkey % 2 = 0 AS strict, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_custkey % 5 <> 0 END AS nia, c_custkey % 7 = 0 AS snc, CASE WHEN c_custkey % 4 = 0 THEN false END AS always FROM customer WHERE c_custkey % 11 <> 0)
SELECT rel, 'strict' AS flag FROM c WHERE NOT strict UNION ALL SELECT rel, 'noImplicitAny' FROM c WHERE NOT coalesce(nia, false) UNION ALL SELECT rel, 'strictNullChecks' FROM c WHERE NOT snc UNION ALL SELECT rel, 'alwaysStrict' FROM c WHERE always = false""")
def tsconfig_strictness(spark, d):
    k = F.col("c_custkey")
    flags = F.struct((k % 2 == 0).alias("strict"), F.when(k % 3 != 0, k % 5 != 0).alias("noImplicitAny"), (k % 7 == 0).alias("strictNullChecks"), F.when(k % 4 == 0, F.lit(False)).alias("alwaysStrict"))
    text = F.when(k % 11 == 0, '{"compilerOptions": {').otherwise(F.to_json(F.struct(flags.alias("compilerOptions"))))
    return audits.strict_flags(C.table(spark, d, "customer").select(k.alias("rel"), text.alias("text")), *map(list, _FLAGS))


@C.query("""WITH m AS (SELECT DISTINCT 'k/' || l_suppkey AS dir FROM lineitem), f AS (SELECT DISTINCT 'k/' || l_suppkey AS dir, ['yarn.lock', 'package-lock.json', 'README.md', 'a.ts'][l_partkey % 4 + 1] AS name FROM lineitem WHERE l_quantity < 3 AND l_suppkey % 3 <> 0),
n AS (SELECT dir, count(*) AS n FROM f WHERE name IN ('yarn.lock', 'package-lock.json') GROUP BY 1) SELECT m.dir || '/package.json' AS rel, coalesce(n, 0) AS n, CASE WHEN n IS NULL THEN 'no-lockfile' ELSE 'several-lockfiles' END AS code FROM m LEFT JOIN n ON m.dir = n.dir WHERE coalesce(n, 0) <> 1""")
def lockfile_policy(spark, d):
    l = C.table(spark, d, "lineitem")
    dir_ = F.concat(F.lit("k/"), F.col("l_suppkey").cast("string"))
    name = _pick(("yarn.lock", "package-lock.json", "README.md", "a.ts"), F.col("l_partkey"))
    have = l.where("l_quantity < 3 AND l_suppkey % 3 <> 0").select(F.concat_ws("/", dir_, name).alias("rel")).distinct()
    return audits.lockfile_policy(l.select(F.concat(dir_, F.lit("/package.json")).alias("rel")).distinct(), have, ["yarn.lock", "package-lock.json", "pnpm-lock.yaml"])


# a manifest an order: one line an item, with section lines between
_TOML = """t AS (SELECT l_orderkey AS k, CASE WHEN l_linenumber % 3 = 1 THEN '[' || CASE WHEN l_linenumber % 2 = 1 THEN 'dependencies' ELSE 'dev-dependencies' END || ']' || chr(10) ELSE '' END || 'p' || l_partkey % 5 || ' = "' || l_suppkey || '"' AS part, l_linenumber AS n FROM lineitem),
f AS (SELECT k AS rel, string_agg(part, chr(10) ORDER BY n, part) AS text FROM t GROUP BY k), l AS (SELECT rel, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line_no FROM f),
s AS (SELECT rel, line_no, line, coalesce(last_value(nullif(regexp_extract(line, '^\\[(.*)\\]$', 1), '') IGNORE NULLS) OVER (PARTITION BY rel ORDER BY line_no), '') AS section FROM l),
e AS (SELECT rel, line_no, section, regexp_extract(line, '^(\\S+) = (.*)$', 1) AS key, regexp_extract(line, '^(\\S+) = (.*)$', 2) AS value FROM s WHERE contains(line, ' = '))"""


def manifests(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("l_linenumber")
    head = F.when(n % 3 == 1, F.concat(F.lit("["), F.when(n % 2 == 1, "dependencies").otherwise("dev-dependencies"), F.lit("]\n"))).otherwise("")
    part = F.concat(head, F.lit("p"), (F.col("l_partkey") % 5).cast("string"), F.lit(' = "'), F.col("l_suppkey").cast("string"), F.lit('"'))
    rows = C.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("rel")).agg(F.sort_array(F.collect_list(F.struct(n.alias("n"), part.alias("part")))).alias("x"))  # an order has few items
    return rows.select("rel", F.array_join("x.part", "\n").alias("text"))


@C.query(f"WITH {_TOML} SELECT * FROM e")
def manifest_sections(spark, d):
    return audits.section_entries(manifests(spark, d))


@C.query(f"WITH {_TOML} SELECT rel, key FROM e WHERE section = 'dependencies' INTERSECT SELECT rel, key FROM e WHERE section = 'dev-dependencies'")
def manifest_section_overlap(spark, d):
    return audits.overlapping_sections(audits.section_entries(manifests(spark, d)), "dependencies", "dev-dependencies")


_REQS = ("numpy==1.0", "pandas>=2", "git+https://h/x.git", "# note", "", "-e .", "./local", "flask")


@C.query(f"WITH r AS (SELECT event_id // 50 AS rel, event_id % 50 AS line_no, {_pick_sql(_REQS, '(event_id // 3)')} AS line FROM events), c AS (SELECT rel, line_no, CASE WHEN regexp_matches(trim(line), '^(?:#|$)') THEN NULL WHEN regexp_matches(line, '(?i)git\\+|\\.git(?:@|$)') THEN 'git' WHEN regexp_matches(trim(line), '^(?:\\.|/|file:|-e\\s)') THEN 'path' WHEN NOT contains(line, '==') THEN 'unpinned' END AS category FROM r) SELECT * FROM c WHERE category IS NOT NULL")
def python_requirements(spark, d):
    i = F.col("event_id")
    return audits.requirement_categories(C.table(spark, d, "events").select(F.floor(i / 50).alias("rel"), (i % 50).alias("line_no"), _pick(_REQS, F.floor(i / 3)).alias("line")))


# --- workflows and documents ---------------------------------------------------------------------

_STEPS = ("      - uses: actions/checkout@v4", "      - uses: actions/setup@" + "a" * 40, "        run: npm ci", "        run: npm test", "      - uses: ./local", "        continue-on-error: true", "permissions:", "  contents: read", "on: [push, pull_request]", "        run: npm install")
_FLOW = f"w AS (SELECT event_id // 12 AS rel, event_id % 12 AS line_no, {_pick_sql(_STEPS, '(event_id * 3 + event_id // 12)')} AS line FROM events)"


def workflow_lines(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("event_id")
    return C.table(spark, d, "events").select(F.floor(i / 12).alias("rel"), (i % 12).alias("line_no"), _pick(_STEPS, i * 3 + F.floor(i / 12)).alias("line"))


@C.query(f"WITH {_FLOW}, a AS (SELECT rel, line_no, regexp_extract(line, '^\\s*(?:-\\s*)?uses:\\s*([^\\s#]+)', 1) AS action FROM w) SELECT * FROM a WHERE action <> '' AND NOT starts_with(action, './') AND NOT regexp_matches(action, '@[0-9a-f]{{40}}$')")
def pinned_actions(spark, d):
    return audits.pinned_actions(workflow_lines(spark, d))


_NEED, _BAN = {"CI-1.1": r"\bnpm ci\b", "CI-1.2": r"\bnpm test\b", "CI-1.14": r"(?m)^permissions:"}, {"CI-1.11": r"continue-on-error:\s*true", "CI-1.13": r"@v[0-9]"}


@C.query(f"WITH {_FLOW}, t AS (SELECT rel, string_agg(line, chr(10) ORDER BY line_no) AS text FROM w GROUP BY 1) " + " UNION ALL ".join([f"SELECT rel, '{k}' AS code FROM t WHERE NOT regexp_matches(text, '{p}')" for k, p in _NEED.items()] + [f"SELECT rel, '{k}' FROM t WHERE regexp_matches(text, '{p}')" for k, p in _BAN.items()]))
def workflow_integrity(spark, d):
    rows = workflow_lines(spark, d).groupBy("rel").agg(F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("x"))  # twelve lines
    return audits.workflow_integrity(rows.select("rel", F.array_join(F.transform("x", lambda r: r["line"]), "\n").alias("text")), _NEED, _BAN)


_DOC = ("# Why", "## Fix", "- claim one", "text here", "### Evidence", "* claim two", "  - claim three", "")
_MD = f"w AS (SELECT event_id // 10 AS rel, event_id % 10 + 1 AS line_no, {_pick_sql(_DOC, '(event_id + event_id // 10)')} AS line FROM events)"


def markdown_files(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("event_id")
    rows = C.table(spark, d, "events").groupBy(F.floor(i / 10).alias("rel")).agg(F.array_sort(F.collect_list(F.struct((i % 10).alias("n"), _pick(_DOC, i + F.floor(i / 10)).alias("line")))).alias("x"))  # ten lines
    return rows.select("rel", F.array_join(F.transform("x", lambda r: r["line"]), "\n").alias("text"))


@C.query(f"""WITH {_MD}, h AS (SELECT *, last_value(CASE WHEN regexp_matches(line, '^#+\\s') THEN line END IGNORE NULLS) OVER (PARTITION BY rel ORDER BY line_no) AS head FROM w)
SELECT rel, line_no, regexp_extract(line, '^\\s*[-*]\\s+(.*?)\\s*$', 1) AS claim FROM h WHERE regexp_matches(head, 'Evidence|Fix') AND regexp_matches(line, '^\\s*[-*]\\s+')""")
def markdown_claims(spark, d):
    return inventory.markdown_claims(markdown_files(spark, d), "Evidence|Fix")


@C.query(f"WITH {_MD}, t AS (SELECT rel, string_agg(line, chr(10) ORDER BY line_no) AS text FROM w GROUP BY 1), m AS (SELECT rel, array_to_string(list_filter(['Why', 'Fix', 'Evidence', 'Limits'], lambda h: NOT regexp_matches(text, '(?im)^#+\\s+' || h || '\\s*$')), ',') AS missing FROM t) SELECT * FROM m WHERE missing <> ''")
def docs_completeness(spark, d):
    return audits.missing_sections(markdown_files(spark, d), ["Why", "Fix", "Evidence", "Limits"])


@C.query("""WITH r AS (SELECT event_id AS report_id, ['handoff', 'status', 'strange'][event_id % 3 + 1] AS kind, event_id FROM events), k AS (SELECT *, list_concat(CASE WHEN event_id % 2 = 0 THEN ['lane'] ELSE [] END, CASE WHEN event_id % 5 > 1 THEN ['next step'] ELSE [] END) AS have FROM r),
m AS (SELECT report_id, kind, CASE kind WHEN 'handoff' THEN array_to_string(list_filter(['lane', 'next step', 'owner'], lambda x: NOT list_contains(have, x)), ',') WHEN 'status' THEN array_to_string(list_filter(['lane'], lambda x: NOT list_contains(have, x)), ',') END AS missing FROM k) SELECT * FROM m WHERE missing IS NULL OR missing <> ''""")
def lifecycle_reports(spark, d):
    i = F.col("event_id")
    text = F.concat_ws("\n", _pick(("handoff", "status", "strange"), i), F.when(i % 2 == 0, "Lane: blue"), F.when(i % 5 > 1, "- Next step: go"), F.lit("Owner:"))
    return audits.report_fields(C.table(spark, d, "events").select(i.alias("report_id"), text.alias("text")), {"handoff": ["lane", "next step", "owner"], "status": ["lane"]})


@C.query("SELECT doc_id AS rel, '/' || lang || '/' || doc_id % 40 AS link FROM documents WHERE '/' || lang || '/' || doc_id % 40 NOT IN (SELECT '/' || regexp_extract(url, '^[a-z]+://[^/]*/([a-z]+)', 1) || '/' || page_id % 40 FROM pages)")
def index_links(spark, d):
    link = lambda a, b: F.concat(F.lit("/"), a, F.lit("/"), (b % 40).cast("string")).alias("link")
    docs = C.table(spark, d, "documents").select(F.col("doc_id").alias("rel"), link(F.col("lang"), F.col("doc_id")))
    return audits.index_links(docs, C.table(spark, d, "pages").select(link(F.regexp_extract("url", "^[a-z]+://[^/]*/([a-z]+)", 1), F.col("page_id"))))


# --- files, folders and orders -------------------------------------------------------------------


@C.query(f"WITH {R.PY}, f AS (SELECT DISTINCT rel FROM cl) SELECT array_to_string(string_split(rel, '/')[1:3], '/') AS package FROM f GROUP BY 1 HAVING NOT bool_or(regexp_matches(rel, '(?i)(?:^|/)(?:test|tests|__tests__)/|(?:^|/)test_[^/]*$|\\.(?:test|spec)\\.[^/]*$'))")
def packages_without_tests(spark, d):
    return audits.without_tests(R.code_files(spark, d, "py"), 3)


@C.query(f"WITH {C.PATHS}, d AS (SELECT DISTINCT regexp_replace(path, '/[^/]*$', '') AS dir FROM pq WHERE regexp_replace(path, '/[^/]*$', '') <> '') SELECT dir FROM d WHERE NOT EXISTS (SELECT 1 FROM d b WHERE starts_with(b.dir, d.dir || '/'))")
def leaf_folders(spark, d):
    return audits.leaf_folders(C.page_paths(spark, d).select(F.col("path").alias("rel")))


@C.query(f"WITH {C.PATHS}, r AS (SELECT DISTINCT split_part(path, '/', 1) || '/x' || page_id % 3 AS root FROM pq UNION SELECT DISTINCT split_part(path, '/', 1) FROM pq) SELECT root FROM r WHERE NOT EXISTS (SELECT 1 FROM pq WHERE page_id % 2 = 0 AND (path = root OR starts_with(path, root || '/')))")
def uncovered_mirror_roots(spark, d):
    p = C.page_paths(spark, d)
    host = F.split("path", "/")[0]
    roots = p.select(F.concat(host, F.lit("/x"), (F.col("page_id") % 3).cast("string")).alias("root")).union(p.select(host)).distinct()
    return audits.uncovered_roots(roots, p.where("page_id % 2 = 0").select(F.col("path").alias("rel")))


@C.query("WITH f AS (SELECT DISTINCT l_suppkey AS s, l_partkey % 40 AS p FROM lineitem), w AS (SELECT s_suppkey AS item_id, k, s_suppkey * (k + 1) % 40 AS p FROM supplier, (SELECT unnest([0, 1, 2]) AS k)) SELECT item_id, arg_min('p/' || item_id || '/' || w.p, k) AS path FROM w JOIN f ON f.s = w.item_id AND f.p = w.p GROUP BY 1")
def first_existing_owner_file(spark, d):
    path = lambda s, p: F.concat_ws("/", F.lit("p"), s.cast("string"), p.cast("string"))
    files = C.table(spark, d, "lineitem").select(path(F.col("l_suppkey"), F.col("l_partkey") % 40).alias("rel"))
    w = C.table(spark, d, "supplier").select(F.col("s_suppkey").alias("item_id"), F.explode(F.array(*map(F.lit, range(3)))).alias("ordinal"))
    return audits.first_existing(w.withColumn("path", path(F.col("item_id"), F.col("item_id") * (F.col("ordinal") + 1) % 40)), files)


@C.query("WITH k AS (SELECT conv_id, turn, length(text) AS n, lag(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM conversations) SELECT conv_id, count(*) FILTER (n < b) AS breaks FROM k GROUP BY 1 HAVING count(*) FILTER (n < b) > 0")
def sortedness(spark, d):
    return audits.unsorted_groups(C.table(spark, d, "conversations").withColumn("n", F.length("text")), "conv_id", "turn", "n")


@C.query("SELECT source, bool_and(length(text) > 200) AS all_ok, bool_or(length(text) > 200) AS any_ok, NOT bool_or(length(text) > 200) AS none_ok FROM documents WHERE text IS NOT NULL GROUP BY 1")
def all_any_none(spark, d):
    return audits.all_any_none(C.table(spark, d, "documents").where("text IS NOT NULL"), "source", F.length("text") > 200)


@C.query(f"WITH {C.PATHS} SELECT path AS rel, count(*) AS n FROM pq WHERE regexp_matches(path, '^[^/]*/en/[^/]*$') OR regexp_matches(path, '^.*/7[^/]*$') GROUP BY 1")
def policy_critical_changes(spark, d):
    return audits.policy_critical(C.page_paths(spark, d).select(F.col("path").alias("rel")), ["*/en/*", "**/7*"]).groupBy("rel").agg(F.count("*").alias("n"))


@C.query("SELECT page_id AS rel, 'GEN-1.1' AS code FROM pages WHERE contains(html, 'track(0)') AND page_id % 3 <> 0 AND NOT page_id % 5 = 0 UNION ALL SELECT page_id, 'GEN-1.2' FROM pages WHERE page_id % 5 = 0")
def generated_artifacts(spark, d):
    i = F.col("page_id")
    rel = F.concat(F.when(i % 5 == 0, "a/output/").otherwise("a/src/"), i.cast("string"))
    text = F.when((i % 3 != 0) & F.contains("html", F.lit("track(0)")), F.concat(F.lit("// @generated\n"), "html")).otherwise(F.col("html"))
    out = audits.generated_artifacts(C.table(spark, d, "pages").select(rel.alias("rel"), text.alias("text")))
    return out.withColumn("rel", F.element_at(F.split("rel", "/"), -1).cast("long"))


# --- projections ---------------------------------------------------------------------------------


@C.query("WITH t AS (SELECT DISTINCT event_type AS tool FROM events), o AS (SELECT event_type AS tool, bool_and(event_id % 50 <> 0) AS enabled, CASE WHEN event_type < 'p' THEN 'warning' END AS severity FROM events WHERE event_type <> 'click' GROUP BY 1) SELECT t.tool, coalesce(enabled, true) AS enabled, coalesce(severity, 'error') AS severity, false AS required FROM t LEFT JOIN o USING (tool)")
def tool_policy(spark, d):
    e = C.table(spark, d, "events")
    o = e.where("event_type <> 'click'").groupBy(F.col("event_type").alias("tool")).agg(F.bool_and(F.col("event_id") % 50 != 0).alias("enabled"))
    o = o.select("tool", "enabled", F.when(F.col("tool") < "p", "warning").alias("severity"), F.lit(None).cast("boolean").alias("required"))
    return projections.tool_policy(e.select(F.col("event_type").alias("tool")).distinct(), o)


@C.query("WITH f AS (SELECT user_id, event_id % 4 <> 1 AS enabled, ['info', 'warning', 'error'][event_id % 3 + 1] AS severity FROM events WHERE event_type = 'error') SELECT user_id, coalesce(arg_max(severity, CASE severity WHEN 'error' THEN 3 WHEN 'warning' THEN 2 ELSE 1 END) FILTER (enabled), 'info') AS severity FROM f GROUP BY 1")
def strongest_severity(spark, d):
    i = F.col("event_id")
    return projections.strongest(C.table(spark, d, "events").where("event_type = 'error'").select("user_id", (i % 4 != 1).alias("enabled"), _pick(("info", "warning", "error"), i).alias("severity")), "user_id")


_LINE_TEXTS = ("12", "x", None, "-3", "0", "7.5", "123456789")


@C.query(f"SELECT coalesce(CASE WHEN event_id % 6 = 0 THEN NULL ELSE event_type END, '.') AS file, coalesce(CASE WHEN regexp_matches({_pick_sql(_LINE_TEXTS, 'event_id')}, '^[0-9]{{1,9}}$') THEN {_pick_sql(_LINE_TEXTS, 'event_id')}::BIGINT END, 1) AS line, coalesce(CASE WHEN event_id % 4 = 0 THEN NULL ELSE 'R' || event_id END, 'unknown') AS rule_id, 'error' AS severity, '' AS detail FROM events")
def normalised_findings(spark, d):
    i, none = F.col("event_id"), F.lit(None).cast("string")
    return projections.normalised(C.table(spark, d, "events").select(F.when(i % 6 != 0, F.col("event_type")).alias("file"), _pick(_LINE_TEXTS, i).alias("line"), F.when(i % 4 != 0, F.concat(F.lit("R"), i.cast("string"))).alias("rule_id"), none.alias("severity"), none.alias("detail")))


@C.query(f"WITH {C.TEXT_FINDINGS}, {C._REG}, y AS (SELECT CASE rule_id WHEN 'TXT-1.1' THEN 'REPO-1.1' WHEN 'TXT-1.2' THEN 'REPO-1.2' ELSE rule_id END AS rule_id, rel || ':' || line_no AS \"at\", detail FROM x1) SELECT y.rule_id, coalesce(reg.severity, 'error') AS severity, y.\"at\", y.detail, coalesce(reg.doc, 'docs/RustRules.md#' || regexp_replace(lower(y.rule_id), '^([^.]*)\\.', '\\1')) AS doc FROM y LEFT JOIN reg ON y.rule_id = reg.rule_id")
def remapped_compact_findings(spark, d):
    f = projections.remapped(C.text_findings(spark, d), {"TXT-1.1": "REPO-1.1", "TXT-1.2": "REPO-1.2"})
    known = C.registry(spark).select("rule_id", F.col("severity").alias("s"), F.col("doc").alias("known_doc"))
    f = f.join(known, "rule_id", "left").withColumn("severity", F.coalesce("s", F.lit("error")))
    at = projections.compact(f).columns
    return f.select("*", F.concat_ws(":", "rel", F.col("line_no").cast("string")).alias("at")).select(*at, projections.doc_of(F.col("rule_id"), F.col("known_doc")).alias("doc"))


_COMMANDS = ("$node $root/a.mjs", "$root/$node/b", "cargo test")


@C.query(f"WITH c AS (SELECT event_id AS run_id, 'n' || user_id AS node, {_pick_sql(_COMMANDS, 'event_id')} AS command FROM events) SELECT run_id, replace(replace(command, '$node', node), '$root', '/r') AS command FROM c")
def expanded_commands(spark, d):
    words = F.split(_pick(_COMMANDS, F.col("event_id")), " ")
    node = F.concat(F.lit("n"), F.col("user_id").cast("string"))
    return C.table(spark, d, "events").select(F.col("event_id").alias("run_id"), F.array_join(projections.expanded(words, {"node": node, "root": F.lit("/r")}), " ").alias("command"))


_TOOLS = ("cargo", "clippy", "eslint", "ESLint", "jest", "npm", "ruff", "mypy", "make", "yarn", "vite", "ts-node", "pylint", "pytest", "python3", "pyright", "Cargo", "pnpm", "vitest", "scripts", None)


@C.query(f"""WITH t AS (SELECT {_pick_sql(_TOOLS, 'event_id')} AS tool FROM events) SELECT tool, CASE WHEN regexp_matches(tool, 'cargo|rust|clippy') THEN 'rust' WHEN regexp_matches(tool, 'eslint|tsc|vitest|jest|npm|yarn') THEN 'typescript' WHEN regexp_matches(tool, 'pytest|ruff|pyright|mypy|python') THEN 'python' ELSE 'common' END AS of_run,
CASE WHEN regexp_matches(lower(tool), 'cargo|rust') THEN 'rust' WHEN regexp_matches(lower(tool), 'ts|eslint|vite') THEN 'typescript' WHEN regexp_matches(lower(tool), 'py|ruff') THEN 'python' ELSE 'common' END AS of_diagnostic, count(*) AS n FROM t GROUP BY ALL""")
def tool_languages(spark, d):
    t = C.table(spark, d, "events").select(_pick(_TOOLS, F.col("event_id")).alias("tool"))
    return t.groupBy("tool", projections.language_of_tool(F.col("tool")).alias("of_run"), projections.language_of_diagnostic(F.col("tool")).alias("of_diagnostic")).agg(F.count("*").alias("n"))


@C.query(f"WITH {C.PATHS} SELECT page_id, path AS rel, CASE WHEN regexp_matches(path, '^.*/7[^/]*$') THEN 900 WHEN regexp_matches(path, '^[^/]*/en/.*$') THEN 500 ELSE 300 END AS max_lines, CASE WHEN regexp_matches(path, '^[^/]*/en/.*$') THEN 9 ELSE 4 END AS max_depth FROM pq")
def shape_overrides(spark, d):
    f = C.page_paths(spark, d).select("page_id", F.col("path").alias("rel"))
    return projections.shape_limits(f, {"max_lines": 300, "max_depth": 4}, [("*/en/**", {"max_lines": 500, "max_depth": 9}), ("**/7*", {"max_lines": 900})])


@C.query("WITH s AS (SELECT user_id, bool_or(event_type = 'error' AND event_id % 31 = 0) AS b, max(ts) < TIMESTAMP '2024-01-25 00:00:00' AS st, bool_or(event_type = 'view' AND event_id % 17 = 0) AS u FROM events GROUP BY 1) SELECT user_id, CASE WHEN b THEN 'wait for the owner' WHEN st THEN 'repair stale claims' WHEN u THEN 'read the inbox' ELSE 'go on' END AS next_step FROM s")
def next_steps(spark, d):
    i, t = F.col("event_id"), F.col("event_type")
    s = C.table(spark, d, "events").groupBy("user_id").agg(F.bool_or((t == "error") & (i % 31 == 0)).alias("b"), (F.max("ts") < F.to_timestamp(F.lit("2024-01-25 00:00:00"))).alias("s"), F.bool_or((t == "view") & (i % 17 == 0)).alias("u"))
    return s.select("user_id", projections.next_step(F.col("b"), F.col("s"), F.col("u")).alias("next_step"))


@C.query(f"WITH {C.POLICY} SELECT count(*) AS n, count(*) FILTER (severity = 'error') AS errors, count(*) FILTER (severity = 'warning') AS warnings, count(*) > 20 AS truncated FROM a")
def compact_counts(spark, d):
    s = F.col("severity")
    return C.applied(spark, d).agg(F.count("*").alias("n"), F.count_if(s == "error").alias("errors"), F.count_if(s == "warning").alias("warnings"), (F.count("*") > 20).alias("truncated"))


@C.query("SELECT coalesce(CASE WHEN event_type = 'view' THEN NULL ELSE event_type END, 'unknown') AS key, count(*) AS n FROM events GROUP BY 1")
def count_by_key(spark, d):
    return policy.count_by(C.table(spark, d, "events").withColumn("k", F.when(F.col("event_type") != "view", F.col("event_type"))), "k")


# --- scalar functions ----------------------------------------------------------------------------

_NAMES = ("userId", "HTTPServer_ref", "event_type", "commandType", "plain", "order-IDs", "widType")


@C.query(f"WITH n AS (SELECT event_id, {_pick_sql(_NAMES, 'event_id')} || CASE WHEN event_id % 4 = 0 THEN 'Ids' ELSE '' END AS name FROM events), t AS (SELECT event_id, name, list_filter(string_split_regex(lower(regexp_replace(name, '([a-z0-9])([A-Z])', '\\1_\\2', 'g')), '[^a-z0-9]+'), lambda x: x <> '') AS t FROM n) SELECT event_id, array_to_string(t, '.') AS tokens, coalesce(t[-1] IN ('id', 'ids', 'ref', 'refs') OR (t[-1] = 'type' AND t[-2] IN ('event', 'command')), false) AS suspicious, trim(regexp_replace(lower(name), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM t")
def field_names(spark, d):
    i = F.col("event_id")
    name = F.concat(_pick(_NAMES, i), F.when(i % 4 == 0, "Ids").otherwise(""))
    return C.table(spark, d, "events").select("event_id", F.array_join(T.name_tokens(name), ".").alias("tokens"), T.suspicious_field(name).alias("suspicious"), T.slug(name).alias("slug"))


@C.query("""SELECT doc_id, md5(regexp_replace(regexp_replace(trim(lower(string_split(text, '.')[1])), '[^a-z0-9 _-]', '', 'g'), ' ', '-', 'g')) AS anchor, array_to_string(list_filter(list_transform(string_split_regex(text, '[,\\n]'), lambda x: trim(x)), lambda x: x <> ''), '|') = '' AS empty, len(list_filter(list_transform(string_split_regex(text, '[,\\n]'), lambda x: trim(x)), lambda x: x <> '')) AS items FROM documents WHERE text IS NOT NULL""")
def text_slugs(spark, d):
    t = F.col("text")
    items = F.size(T.split_list(t))
    return C.table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.md5(T.markdown_anchor(F.split(t, r"\.")[0])).alias("anchor"), (items == 0).alias("empty"), items.cast("long").alias("items"))


_PATHS = ("./a/b.ts", ".\\.\\c\\d.ts", "e/f", " ././g ", "")


@C.query(f"WITH p AS (SELECT event_id, {_pick_sql(_PATHS, 'event_id')} || user_id AS p FROM events) SELECT event_id, translate(p, '\\', '/') AS posix, trim(regexp_replace(translate(trim(p), '\\', '/'), '^(?:\\./)+', '')) AS waiver_path FROM p")
def path_forms(spark, d):
    p = F.concat(_pick(_PATHS, F.col("event_id")), F.col("user_id").cast("string"))
    return C.table(spark, d, "events").select("event_id", T.to_posix(p).alias("posix"), T.waiver_path(p).alias("waiver_path"))


@C.query("SELECT event_id, strftime(ts, '%Y%m%d%H%M%S') AS stamp, CASE WHEN length(event_type) > 4 THEN left(event_type, 4) || chr(10) || '[truncated]' ELSE event_type END AS cut, props IS NOT NULL AS has FROM events")
def stamps_and_cuts(spark, d):
    from lumenfold.operators.diagnostics import truncated

    return C.table(spark, d, "events").select("event_id", T.run_stamp(F.col("ts")).alias("stamp"), truncated(F.col("event_type"), 4).alias("cut"), F.col("props").isNotNull().alias("has"))


_BRACES = ("f(a[1], {b})", "(]", "((x)", "a)b(", "{[()]}", "plain", "}{")


@C.query(f"WITH b AS (SELECT event_id, event_id % {len(_BRACES)} IN (0, 4, 5) AS ok FROM events) SELECT event_id, ok FROM b")
def balanced_delimiters(spark, d):
    return C.table(spark, d, "events").select("event_id", T.balanced(_pick(_BRACES, F.col("event_id"))).alias("ok"))


_JSON = ('{"a": {"b": "x", "c": ["y", {"d": "z"}]}}', '{\n "k": 1,\n "name": "n"\n}', '["only"]', '{"name": "p \\"q\\" r"}')


@C.query(f"SELECT event_id, ['x|y|z', 'n', 'only', 'p \\\"q\\\" r'][event_id % 4 + 1] AS strings, CASE WHEN event_id % 4 = 1 THEN 3 ELSE 1 END::BIGINT AS name_line FROM events")
def json_strings_and_lines(spark, d):
    j = _pick(_JSON, F.col("event_id"))
    return C.table(spark, d, "events").select("event_id", F.array_join(T.nested_strings(j), "|").alias("strings"), T.key_line(j, "name").alias("name_line"))


_OUTPUTS = ("ok ghp_" + "a" * 24 + " end", "token = abcdefgh12", "plain text", "key AKIA" + "B" * 16)


@C.query("SELECT event_id, ['ok [REDACTED] end', '[REDACTED]', 'plain text', 'key [REDACTED]'][event_id % 4 + 1] || ' ' || event_type AS redacted FROM events")
def redacted_output(spark, d):
    return C.table(spark, d, "events").select("event_id", T.redact_output(F.concat_ws(" ", _pick(_OUTPUTS, F.col("event_id")), "event_type")).alias("redacted"))


_COMMENTS = ((".py", "x = 1  # why", "# why"), (".ts", "f(); // note", "// note"), (".ts", "plain();", ""), (".toml", "a = 1", ""), (".rs", " * doc", "* doc"))


@C.query("SELECT event_id, [" + ", ".join(f"'{c}'" for *_, c in _COMMENTS) + f"][event_id % {len(_COMMENTS)} + 1] AS comment FROM events")
def comment_texts(spark, d):
    i = F.col("event_id")
    return C.table(spark, d, "events").select("event_id", T.comment_text(_pick(tuple(c[0] for c in _COMMENTS), i), _pick(tuple(c[1] for c in _COMMENTS), i)).alias("comment"))


# --- inventory -----------------------------------------------------------------------------------

_SCRIPTS = ("writeFile(out)", "adb shell && playwright", "const claimsProved = []; windows-latest", "sarif upload; cloud", "schema parity on linux", "nothing", "ios simulator; rowsCovered", "android emulator in ci")
_SCRIPT_SQL = f"s AS (SELECT 'scripts/' || CASE WHEN event_id % 5 = 0 THEN 'release-' ELSE 'check-' END || event_id || '.mjs' AS rel, {_pick_sql(_SCRIPTS, 'event_id')} AS text FROM events), w AS (SELECT *, lower(string_split(rel, '/')[-1] || chr(10) || text) AS whole FROM s)"


@C.query(f"WITH {_SCRIPT_SQL} SELECT rel, CASE " + " ".join(f"WHEN regexp_matches(whole, '{p}') THEN '{n}'" for n, p in inventory.FAMILIES) + " ELSE 'command' END AS family, array_to_string(list_sort(list_filter(['local', CASE WHEN contains(whole, 'android') THEN CASE WHEN contains(whole, 'emulator') THEN 'android-emulator' ELSE 'android-device' END END, CASE WHEN contains(whole, 'ios') THEN CASE WHEN contains(whole, 'device') THEN 'ios-device' ELSE 'ios-simulator' END END, "
    + ", ".join(f"CASE WHEN regexp_matches(whole, '{p}') THEN '{n}' END" for n, p in inventory.CAPABILITIES) + "], lambda x: x IS NOT NULL)), ',') AS capabilities, array_to_string(list_sort(list_filter([" + ", ".join(f"CASE WHEN regexp_matches(text, '{p}') THEN '{n}' END" for n, p in inventory.CLAIM_KINDS) + "], lambda x: x IS NOT NULL)), ',') AS claim_kinds FROM w")
def script_inventory(spark, d):
    i = F.col("event_id")
    rel = F.concat(F.lit("scripts/"), F.when(i % 5 == 0, "release-").otherwise("check-"), i.cast("string"), F.lit(".mjs"))
    return inventory.classified(C.table(spark, d, "events").select(rel.alias("rel"), _pick(_SCRIPTS, i).alias("text")))


_ARTIFACTS = {
    '{"ok": false}': "failed", '{"status": "PASSED"}': "passed", '{"status": "manual-required"}': "manual-required", '{"result": "failed"}': "failed", '{"status": "unavailable"}': "unavailable", "not json": "present",
    '{"ok": true}': "passed", '{"status": "odd"}': "present", '{"passed": false, "ok": true}': "failed", '{"success": true}': "passed", "a Manual-Required step": "manual-required", '{"status": "manually checked"}': "present",
    '{"ok": "true"}': "present", '{"status": "failed-over"}': "present", '{"status": "Error"}': "failed", '{"result": "skipped", "success": true}': "unavailable", '[{"ok": false}]': "present", '{"status": "manual_required"}': "manual-required", '{"status": null, "result": "ok"}': "passed", "": "present", None: "present",
}


@C.query(f"SELECT event_id AS artifact_id, {_pick_sql(tuple(_ARTIFACTS.values()), 'event_id')} AS status FROM events")
def artifact_status(spark, d):
    return inventory.artifact_status(C.table(spark, d, "events").select(F.col("event_id").alias("artifact_id"), _pick(tuple(_ARTIFACTS), F.col("event_id")).alias("text")))


@C.query("""WITH df AS (SELECT DISTINCT event_type || user_id % 3 AS id, event_type AS family FROM events), cap AS (SELECT DISTINCT event_type || user_id % 3 AS id, event_type AS family, unnest(CASE user_id % 3 WHEN 0 THEN ['ci', 'linux'] WHEN 1 THEN ['ci'] ELSE ['windows'] END) AS capability FROM events),
r AS (SELECT doc_id AS request_id, CASE WHEN doc_id % 3 <> 0 THEN ['view', 'click', 'none'][doc_id % 3 + 1] END AS family, CASE WHEN doc_id % 4 <> 0 THEN ['ci', 'windows', 'mac'][doc_id % 3 + 1] END AS capability FROM documents)
SELECT request_id, cap.id FROM r JOIN cap ON r.family = cap.family AND r.capability = cap.capability UNION ALL SELECT request_id, df.id FROM r JOIN df ON r.family = df.family WHERE r.capability IS NULL UNION ALL SELECT request_id, c.id FROM r JOIN (SELECT DISTINCT id, capability FROM cap) c ON r.capability = c.capability WHERE r.family IS NULL""")
def evidence_routes(spark, d):
    u, i = F.col("user_id") % 3, F.col("doc_id")
    can = F.when(u == 0, F.array(F.lit("ci"), F.lit("linux"))).when(u == 1, F.array(F.lit("ci"))).otherwise(F.array(F.lit("windows")))
    definitions = C.table(spark, d, "events").select(F.concat("event_type", u.cast("string")).alias("id"), F.col("event_type").alias("family"), can.alias("capabilities")).distinct()
    requests = C.table(spark, d, "documents").select(i.alias("request_id"), F.when(i % 3 != 0, _pick(("view", "click", "none"), i)).alias("family"), F.when(i % 4 != 0, _pick(("ci", "windows", "mac"), i)).alias("capability"))
    return inventory.routed_evidence(definitions, requests)
