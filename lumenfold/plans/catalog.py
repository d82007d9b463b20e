"""The registered queries over the driver's tables, with their SQL.

Adapters: documents stand for source files, events for tool runs and ownership events, conversations for
ledger streams, pages for paths, benchmark for contract literals, labels for evidence.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.functions import text as T
from lumenfold.operators import config, evidence, ledger, paths, policy, rulebook, rules, runs
from lumenfold.sources import files as files_source
from lumenfold.streaming import ownership

AS_OF = "2024-01-31 00:00:00"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
FLAGSHIP = "group_by_slice"


def query(sql: str):
    """Register a query with its SQL."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql.strip()
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def as_of():
    return F.to_timestamp(F.lit(AS_OF))


# --- adapters ------------------------------------------------------------------------------------


def files(spark: SparkSession, d: str) -> DataFrame:
    return files_source.documents_as_files(table(spark, d, "documents"))


def lines(spark: SparkSession, d: str) -> DataFrame:
    return files_source.lines(files(spark, d))


FILES = "f AS (SELECT coalesce(source, 'unknown') || '/' || doc_id || '.' || coalesce(lang, 'unknown') AS rel, text, lang, source, doc_id FROM documents)"
LINES = FILES + ", l0 AS (SELECT rel, string_split_regex(text, '\\r?\\n') AS a FROM f WHERE text IS NOT NULL), l AS (SELECT rel, unnest(range(1, len(a) + 1)) AS line_no, unnest(a) AS line FROM l0)"

#: A registry of our own over invented prose: id, pattern, detail.
TEXT_RULES = (
    ("TXT-1.1", r"!!", "shouting"),
    ("TXT-1.2", r"\$\$\$", "money signs"),
    ("TXT-1.3", r" \| ", "table row"),
    ("TXT-1.4", r"Licensed under|licensed under", "license line"),
    ("TXT-1.5", r"(?:token|secret|password|key) = ", "assignment"),
)
TEXT_GATES = (("!!",), ("$$$",), (" | ",), ("icensed under",), (" = ",))
REGISTRY = (
    "VALUES ('TXT-1.1','error','Shouting','docs/txt.md#1','common','style',true,true), ('TXT-1.2','warning','Money','docs/txt.md#2','common','style',false,false), "
    "('TXT-1.3','info','Table','','en','layout',true,true), ('TXT-1.4','warning','License','docs/txt.md#4','fr','legal',true,false), ('TXT-1.6','error','Unused','','de','legal',true,true)"
)
REGISTRY_COLUMNS = "rule_id, severity, title, doc, language, family, can_disable, can_downgrade"
OVERRIDES = "VALUES ('txt-1.1', true, 'info'), ('TXT-1.2', false, CAST(NULL AS STRING)), ('TXT-1.4', true, 'info'), ('TXT-1.3', false, 'error')"
WAIVERS = (
    "VALUES (1,'TXT-1.1','W1','dana','I-1','noise',array('src1/**','src2/1*'),'2024-01-31',true,true), (2,'TXT-1.1','W2','kim','I-2','noise',array('src1/**','src3/**'),'2024-12-31',true,true), "
    "(3,'TXT-1.2','W3','lee','I-3','noise',array('src5/**'),'2024-01-30',true,true), (4,'TXT-1.2','W4','an agent','I-4','noise',array('src6/**'),'2024-12-31',true,true), "
    "(5,'TXT-1.4','W5','sam','I-5','noise',array('**'),'2024-12-31',true,true), (6,'txt-1.4','W6','sam','I-6','noise',array('*/*7.en'),'2024-12-31',true,true), "
    "(7,'TXT-1.5','W7','sam','I-7','noise',array('src9/**'),'2024-12-31',true,false)"
)
WAIVER_COLUMNS = "ordinal, rule_id, waiver_id, owner, issue, reason, scope, expires, ci_allowed, visible"


def registry(spark: SparkSession) -> DataFrame:
    return spark.sql(f"SELECT * FROM {REGISTRY} AS t({REGISTRY_COLUMNS})")


def overrides(spark: SparkSession) -> DataFrame:
    return spark.sql(f"SELECT * FROM {OVERRIDES} AS t(rule_id, enabled, severity)")


def waivers(spark: SparkSession) -> DataFrame:
    return spark.sql(f"SELECT * FROM {WAIVERS} AS t({WAIVER_COLUMNS})")


def text_findings(spark: SparkSession, d: str) -> DataFrame:
    found = rulebook.rule_findings(files(spark, d), tuple(rulebook.Rule(i, p, t, g) for (i, p, t), g in zip(TEXT_RULES, TEXT_GATES)))
    return found.withColumn("finding_id", F.concat_ws("#", "rel", "line_no", "rule_id"))


TEXT_FINDINGS = LINES + ", x AS (" + " UNION ALL ".join(
    f"SELECT '{i}' AS rule_id, rel, line_no, '{t}' AS detail FROM l WHERE regexp_matches(line, '{p}')" for i, p, t in TEXT_RULES
) + "), x1 AS (SELECT *, rel || '#' || line_no || '#' || rule_id AS finding_id FROM x)"
_REG = f"reg AS (SELECT * FROM ({REGISTRY}) AS t({REGISTRY_COLUMNS}))"
_OVR = f"ovr AS (SELECT upper(rule_id) AS rule_id, enabled, severity FROM ({OVERRIDES}) AS t(rule_id, enabled, severity))"
_RANK = "CASE {} WHEN 'error' THEN 3 WHEN 'warning' THEN 2 WHEN 'info' THEN 1 END"
ENRICHED = TEXT_FINDINGS + ", " + _REG + """, e AS (SELECT x1.*, coalesce(reg.severity, 'error') AS severity, coalesce(reg.title, 'Unknown rule') AS title, coalesce(reg.doc, '') AS doc
  FROM x1 LEFT JOIN reg ON x1.rule_id = reg.rule_id)"""
POLICY = ENRICHED + ", " + _OVR + f""", p AS (SELECT reg.rule_id, coalesce(ovr.enabled, true) OR NOT reg.can_disable AS enabled,
  CASE WHEN NOT coalesce({_RANK.format('ovr.severity')} < {_RANK.format('reg.severity')} AND NOT reg.can_downgrade, false) THEN ovr.severity END AS sev FROM reg LEFT JOIN ovr ON reg.rule_id = ovr.rule_id),
a AS (SELECT e.finding_id, e.rule_id, e.rel, e.line_no, e.detail, coalesce(p.sev, e.severity) AS severity, e.title, e.doc FROM e LEFT JOIN p ON e.rule_id = p.rule_id WHERE coalesce(p.enabled, true))"""
# the waivers that may apply, with their scopes as patterns, by hand
SPLIT = POLICY + """, w(ordinal, rule_id, waiver_id, pattern) AS (VALUES (1,'TXT-1.1','W1','^src1(/.*)?$'), (1,'TXT-1.1','W1','^src2/1[^/]*$'), (2,'TXT-1.1','W2','^src1(/.*)?$'), (2,'TXT-1.1','W2','^src3(/.*)?$'), (6,'TXT-1.4','W6','^[^/]*/[^/]*7\\.en$')),
s AS (SELECT a.*, (SELECT arg_min(w.waiver_id, w.ordinal) FROM w WHERE w.rule_id = a.rule_id AND regexp_matches(a.rel, w.pattern)) AS waiver_id FROM a)"""


def applied(spark: SparkSession, d: str) -> DataFrame:
    enriched = policy.enrich(text_findings(spark, d), registry(spark))
    return policy.apply_policy(enriched, policy.effective_policy(registry(spark), overrides(spark)))


def split(spark: SparkSession, d: str) -> DataFrame:
    return policy.split_by_waiver(applied(spark, d), policy.valid_waivers(waivers(spark), AS_OF))


# --- lines, rules and policy ---------------------------------------------------------------------


@query(f"WITH {LINES} SELECT split_part(rel, '/', 1) AS source, count(DISTINCT rel) AS n_files, count(*) AS n_lines, count(*) FILTER (trim(line) = '') AS n_blank FROM l GROUP BY 1")
def line_scan_counts(spark, d):
    rows = lines(spark, d).withColumn("source", F.substring_index("rel", "/", 1))
    per = rows.groupBy("source", "rel").agg(F.count("*").alias("n"), F.count_if(F.trim("line") == "").alias("b"))
    return per.groupBy("source").agg(F.count("*").alias("n_files"), F.sum("n").alias("n_lines"), F.sum("b").alias("n_blank"))


_SECRET_SQL = " UNION ALL ".join("SELECT '{}' AS rule_id, rel, line_no, '{}' AS detail FROM l WHERE regexp_matches(line, '{}')".format(i, t, p.replace("'", "''")) for i, p, t in rules.SECRET_RULES)


@query(f"WITH {LINES} {_SECRET_SQL}")
def secret_findings(spark, d):
    return rulebook.rule_findings(files(spark, d), tuple(rulebook.Rule(i, p, t, rulebook.SECRET_GATES[i]) for i, p, t in rules.SECRET_RULES))


def _redacted_sql(column: str) -> str:
    for p, label in T.FINDING_REDACTIONS:
        column = "regexp_replace({}, '{}', '{}', 'g')".format(column, p.replace("'", "''"), label.replace("'", "''"))
    return column


@query(f"WITH {FILES}, r AS (SELECT rel, text, {_redacted_sql('text')} AS redacted FROM f) SELECT rel, sha256(redacted) AS redacted_sha, strlen(redacted)::BIGINT AS n_bytes FROM r WHERE redacted <> text")
def redacted_sources(spark, d):
    r = files(spark, d).withColumn("redacted", T.redact(F.col("text"))).where("redacted <> text")
    return r.select("rel", F.sha2(F.col("redacted").cast("binary"), 256).alias("redacted_sha"), F.octet_length("redacted").cast("long").alias("n_bytes"))


@query(f"WITH {POLICY} SELECT finding_id, rule_id, severity, title, doc FROM a")
def finding_policy(spark, d):
    return applied(spark, d).select("finding_id", "rule_id", "severity", "title", "doc")


@query(f"WITH {SPLIT} SELECT finding_id, waiver_id FROM s WHERE waiver_id IS NOT NULL")
def waiver_first_match(spark, d):
    return split(spark, d).where("waiver_id IS NOT NULL").select("finding_id", "waiver_id")


@query(f"WITH {SPLIT} SELECT rule_id, CASE WHEN waiver_id IS NULL THEN 'active' ELSE 'waived' END AS status, count(*) AS n FROM s GROUP BY ALL")
def waived_vs_active(spark, d):
    return split(spark, d).groupBy("rule_id", F.when(F.col("waiver_id").isNull(), "active").otherwise("waived").alias("status")).agg(F.count("*").alias("n"))


@query(f"WITH {POLICY} SELECT severity, count(*) AS n FROM a GROUP BY 1")
def severity_summary(spark, d):
    return policy.severity_summary(applied(spark, d))


@query(f"WITH {POLICY} SELECT severity IN ('error', 'warning') AS fails, count(*) AS n, count(DISTINCT rel) AS n_files FROM a GROUP BY 1")
def fail_on_split(spark, d):
    per = applied(spark, d).groupBy(F.col("severity").isin("error", "warning").alias("fails"), "rel").agg(F.count("*").alias("n"))
    return per.groupBy("fails").agg(F.sum("n").alias("n"), F.count("*").alias("n_files"))


@query(f"""WITH {ENRICHED}, k AS (SELECT *, split_part(rel, '/', 1) AS key FROM e), b AS (SELECT key, string_agg(severity || '=' || c, ',' ORDER BY severity || '=' || c) AS by_severity FROM (SELECT key, severity, count(*) AS c FROM k GROUP BY ALL) GROUP BY key)
SELECT k.key, count(*) AS n, any_value(b.by_severity) AS by_severity, string_agg(DISTINCT rule_id, ',' ORDER BY rule_id) AS rule_ids, coalesce(string_agg(DISTINCT nullif(doc, ''), ',' ORDER BY nullif(doc, '')), '') AS docs, min(finding_id) AS first_finding FROM k JOIN b USING (key) GROUP BY k.key""")
def group_by_slice(spark, d):
    return policy.group_findings(policy.enrich(text_findings(spark, d), registry(spark)), T.slice_key(F.col("rel")))


@query(f"WITH {FILES}, {_REG}, k AS (SELECT DISTINCT CASE WHEN lang = 'en' THEN 'en:layout' WHEN lang = 'fr' THEN 'fr:*' ELSE 'common:style' END AS key FROM f) SELECT rule_id, language, family FROM reg WHERE language || ':' || family IN (SELECT key FROM k) OR language || ':*' IN (SELECT key FROM k)")
def route_semi_join(spark, d):
    keys = files(spark, d).select(F.when(F.col("lang") == "en", "en:layout").when(F.col("lang") == "fr", "fr:*").otherwise("common:style").alias("key"))
    return policy.routed(registry(spark).select("rule_id", "language", "family"), keys)


@query(f"WITH {_REG}, q AS (SELECT DISTINCT lang FROM documents) SELECT 1 AS pass, rule_id FROM reg WHERE language IN (SELECT lang FROM q) AND family IN ('layout', 'legal') UNION ALL SELECT 2, rule_id FROM reg WHERE language = 'common' AND family IN ('layout', 'legal', 'style')")
def route_compat_cross(spark, d):
    r, langs = registry(spark), table(spark, d, "documents").select(F.col("lang").alias("language")).distinct()
    own = r.where(F.col("family").isin("layout", "legal")).join(langs, "language", "left_semi").select(F.lit(1).alias("pass"), "rule_id")
    return own.unionByName(policy.routed_compat(r, [], ["layout", "legal", "style"]).select("pass", "rule_id"))


# --- context, repetition and shape ---------------------------------------------------------------


@query(f"WITH {LINES}, g AS (SELECT *, bool_or(contains(line, ',')) OVER (PARTITION BY rel ORDER BY line_no ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS guarded FROM l) SELECT rel, line_no, line FROM g WHERE regexp_matches(line, '\\.$') AND NOT guarded")
def context_window_guard(spark, d):
    return rulebook.unguarded(files(spark, d), r"\.\z", ",", 2)


@query(f"WITH {LINES}, g AS (SELECT *, first_value(CASE WHEN NOT regexp_matches(line, '^\\s*(#|$)') THEN line END IGNORE NULLS) OVER (PARTITION BY rel ORDER BY line_no ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING) AS after FROM l) SELECT rel, line_no, md5(line) AS line_md5, md5(after) AS after_md5 FROM g WHERE regexp_matches(line, ',') AND regexp_matches(after, '^[A-E]')")
def lookahead_first_significant(spark, d):
    rows = rulebook.followed_by(files(spark, d), ",", "^[A-E]")
    return rows.select("rel", "line_no", F.md5("line").alias("line_md5"), F.md5("after").alias("after_md5"))


@query(f"WITH {LINES}, b AS (SELECT rel, line_no, trim(line, ' ') AS t, CASE WHEN lag(trim(line, ' ')) OVER (PARTITION BY rel ORDER BY line_no) IS NOT DISTINCT FROM trim(line, ' ') THEN 0 ELSE 1 END AS k FROM l), i AS (SELECT *, sum(k) OVER (PARTITION BY rel ORDER BY line_no) AS island FROM b) SELECT rel, min(line_no) AS first_line, count(*) AS run, min(t) AS line FROM i WHERE length(t) >= 20 GROUP BY rel, island HAVING count(*) >= 3")
def repeated_line_islands(spark, d):
    return rules.repeated_islands(files(spark, d), 3)


@query(f"WITH {LINES}, t AS (SELECT rel, line_no, regexp_extract(line, '^([A-Za-z]+)', 1) AS token FROM l), r AS (SELECT *, row_number() OVER (PARTITION BY rel, token ORDER BY line_no) AS k FROM t WHERE token <> '') SELECT rel, arg_min(token, line_no) AS token, min(line_no) AS line_no FROM r WHERE k = 2 GROUP BY rel")
def first_duplicate_token(spark, d):
    return rules.first_duplicate(lines(spark, d), F.regexp_extract("line", "^([A-Za-z]+)", 1))


@query(f"""WITH {FILES}, m AS (SELECT rel, len(string_split_regex(text, '\\r?\\n')) AS lines, strlen(text) AS bytes, len(text) - len(replace(text, '|', '')) AS bars FROM f), u AS (
SELECT rel, 'lines' AS metric, lines AS value, 20 AS most FROM m UNION ALL SELECT rel, 'bytes', bytes, 4000 FROM m UNION ALL SELECT rel, 'bars', bars, 12 FROM m) SELECT rel, metric, value::BIGINT AS value, most::BIGINT AS most FROM u WHERE value > most""")
def shape_metrics_unpivot(spark, d):
    t = F.col("text")
    limits = {"lines": (F.size(F.split(t, r"\r?\n", -1)), 20), "bytes": (F.octet_length(t), 4000), "bars": (F.length(t) - F.length(F.replace(t, F.lit("|"), F.lit(""))), 12)}
    return rules.shape_findings(files(spark, d), limits)


@query("""WITH c AS (SELECT page_id, unnest(string_split(regexp_replace(html, '[^{}<>]', '', 'g'), '')) AS ch, unnest(range(1, length(regexp_replace(html, '[^{}<>]', '', 'g')) + 1)) AS i FROM pages),
s AS (SELECT page_id, i, sum(CASE ch WHEN '{' THEN 1 WHEN '}' THEN -1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY i) AS s FROM c),
r AS (SELECT page_id, s, least(0, min(s) OVER (PARTITION BY page_id ORDER BY i)) AS low FROM s)
SELECT p.page_id, coalesce(max(r.s - r.low), 0)::BIGINT AS depth FROM pages p LEFT JOIN r USING (page_id) GROUP BY p.page_id""")
def nesting_depth_clamped(spark, d):
    pages = table(spark, d, "pages").select(F.col("page_id").alias("rel"), F.col("html").alias("text"))
    return rules.nesting_depth(pages).withColumnRenamed("rel", "page_id")


# --- runs ----------------------------------------------------------------------------------------


def tool_runs(spark: SparkSession, d: str) -> DataFrame:
    status = F.when(F.col("event_type") == "error", "failed").otherwise("passed")
    return table(spark, d, "events").select(F.col("event_id").alias("run_id"), F.col("event_type").alias("tool"), status.alias("status"), F.col("ts").alias("started_at"), (F.col("event_id") % 97 == 0).alias("pinned"), "user_id", "props")


RUNS = "r AS (SELECT event_id AS run_id, event_type AS tool, CASE WHEN event_type = 'error' THEN 'failed' ELSE 'passed' END AS status, ts AS started_at, event_id % 97 = 0 AS pinned, user_id, props FROM events)"


@query(f"WITH {RUNS} SELECT run_id, tool, started_at FROM r WHERE tool = 'click' ORDER BY started_at DESC, run_id LIMIT 20")
def run_query_topk(spark, d):
    return runs.newest(runs.matching_runs(tool_runs(spark, d), tool="click"), 20).select("run_id", "tool", "started_at")


@query(f"WITH {RUNS}, n AS (SELECT * FROM r ORDER BY started_at DESC, run_id LIMIT 50) SELECT run_id, started_at FROM n WHERE status = 'failed' ORDER BY started_at DESC, run_id LIMIT 1")
def last_failure_first50(spark, d):
    return runs.last_failure(tool_runs(spark, d)).select("run_id", "started_at")


@query(f"WITH {RUNS} SELECT user_id, tool, run_id FROM r QUALIFY row_number() OVER (PARTITION BY user_id, tool ORDER BY started_at DESC, run_id) = 1")
def latest_per_key(spark, d):
    return runs.newest_per(tool_runs(spark, d), ["user_id", "tool"]).select("user_id", "tool", "run_id")


@query(f"""WITH {RUNS}, k AS (SELECT *, row_number() OVER (ORDER BY started_at DESC, run_id) AS n, row_number() OVER (PARTITION BY tool ORDER BY started_at DESC, run_id) AS nt, row_number() OVER (PARTITION BY status ORDER BY started_at DESC, run_id) AS ns FROM r)
SELECT run_id, CASE WHEN (n > 50 OR started_at < TIMESTAMP '{AS_OF}' - INTERVAL 14 DAY) AND NOT (pinned OR (status = 'failed' AND ns <= 20) OR nt <= 20) THEN 'delete' ELSE 'keep' END AS action FROM k""")
def retention_prune_runs(spark, d):
    return runs.prune_runs(tool_runs(spark, d), as_of())


@query(f"""WITH {RUNS}, k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY started_at DESC, run_id) AS n, CASE WHEN status <> 'passed' THEN row_number() OVER (PARTITION BY user_id, status <> 'passed' ORDER BY started_at DESC, run_id) END AS nf FROM r)
SELECT run_id, CASE WHEN (n > 20 OR started_at < TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY) AND NOT (pinned OR n <= 20 OR coalesce(nf <= 20, false)) THEN 'delete' ELSE 'keep' END AS action FROM k""")
def retention_prune_evidence(spark, d):
    return runs.prune_evidence(tool_runs(spark, d).withColumnRenamed("user_id", "proof_id"), as_of())


@query(f"WITH {RUNS} SELECT user_id, run_id, started_at FROM r QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY started_at DESC, run_id) <= 20")
def history_newest20(spark, d):
    return runs.newest_per(tool_runs(spark, d), ["user_id"], 20).select("user_id", "run_id", "started_at")


@query(f"WITH {LINES} SELECT rel, md5(line) AS line_md5, min(line_no) AS line_no FROM l GROUP BY rel, line")
def dedupe_first(spark, d):
    rows = lines(spark, d).select("rel", F.md5("line").alias("line_md5"), "line_no", F.col("line_no").alias("ordinal"))
    return runs.first_of_each(rows, ["rel", "line_md5"], "ordinal").select("rel", "line_md5", "line_no")


@query(f"WITH {RUNS} SELECT run_id, status, 0 AS slice FROM r WHERE run_id % 3 <> 1 AND run_id % 2 <> 0 UNION ALL SELECT run_id, 'rerun', 1 FROM r WHERE run_id % 2 = 0")
def upsert_manifest(spark, d):
    r = tool_runs(spark, d)
    old = r.where("run_id % 3 <> 1").select("run_id", "status", F.lit(0).alias("slice"))
    return runs.upsert(old, r.where("run_id % 2 = 0").select("run_id", F.lit("rerun").alias("status"), F.lit(1).alias("slice")), "run_id")


@query("WITH k AS (SELECT props, unnest(json_keys(props)) AS key FROM events) SELECT key, json_extract_string(props, '$.' || key) AS value, count(*) AS n FROM k GROUP BY ALL")
def props_json_extract(spark, d):
    rows = table(spark, d, "events").select(F.explode(F.from_json("props", "map<string,string>")).alias("key", "value"))
    return rows.groupBy("key", "value").agg(F.count("*").alias("n"))


@query("WITH b AS (SELECT event_id, event_type, CASE WHEN event_id % 11 = 0 THEN left(props, length(props) - 1) ELSE props END AS p FROM events) SELECT event_type, count(*) AS n, count(*) FILTER (NOT json_valid(p)) AS malformed FROM b GROUP BY 1")
def malformed_json_rows(spark, d):
    p = F.when(F.col("event_id") % 11 == 0, F.expr("left(props, length(props) - 1)")).otherwise(F.col("props"))
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(F.try_parse_json(p).isNull() & p.isNotNull()).alias("malformed"))


# --- evidence ------------------------------------------------------------------------------------


@query("SELECT l_partkey, count(DISTINCT l_suppkey) AS n_versions, string_agg(DISTINCT l_suppkey::VARCHAR, ',' ORDER BY l_suppkey::VARCHAR) AS versions FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_suppkey) > 1")
def distinct_having(spark, d):
    g = table(spark, d, "lineitem").groupBy("l_partkey").agg(F.collect_set(F.col("l_suppkey").cast("string")).alias("v"))
    return g.where(F.size("v") > 1).select("l_partkey", F.size("v").cast("long").alias("n_versions"), F.array_join(F.array_sort("v"), ",").alias("versions"))


_LABELS = {"symbols": "[#$%&]", "table": r" \| ", "shout": "!!", "license": "[Ll]icensed", "digits": "[0-9]{4}"}


@query("SELECT label, count(*) AS n FROM (" + " UNION ALL ".join(f"SELECT '{k}' AS label FROM documents WHERE regexp_matches(text, '{p}')" for k, p in _LABELS.items()) + ") GROUP BY 1")
def count_array_values(spark, d):
    labels = F.array_compact(F.array(*[F.when(F.col("text").rlike(p), F.lit(k)) for k, p in _LABELS.items()]))
    return evidence.count_labels(table(spark, d, "documents"), labels)


@query("SELECT source, count(*) AS n, " + ", ".join(f"count(*) FILTER (regexp_matches(text, '{p}')) AS n_{k}" for k, p in _LABELS.items()) + " FROM documents GROUP BY 1")
def claim_signals(spark, d):
    return table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n"), *[F.count_if(F.col("text").rlike(p)).alias(f"n_{k}") for k, p in _LABELS.items()])


@query(f"""WITH {FILES}, b AS (SELECT lang, CASE WHEN length(text) < 500 THEN 'small' WHEN length(text) < 5000 THEN 'medium' ELSE 'large' END AS size, source, rel FROM f)
SELECT lang, size, count(*) AS n, count(DISTINCT source) AS n_sources, array_to_string(list_sort(list(rel))[1:5], ',') AS sample FROM b GROUP BY 1, 2""")
def migration_matrix(spark, d):
    n = F.length("text")
    b = files(spark, d).select("lang", F.when(n < 500, "small").when(n < 5000, "medium").otherwise("large").alias("size"), "source", "rel")
    return _matrix(b)


def _matrix(b: DataFrame) -> DataFrame:
    sizes = b.groupBy("lang", "size", "source").agg(F.count("*").alias("c")).groupBy("lang", "size").agg(F.sum("c").alias("n"), F.count("*").alias("n_sources"))
    first = runs.newest_per(b.withColumn("zero", F.lit(0)), ["lang", "size"], 5, "zero", "rel")
    sample = first.groupBy("lang", "size").agg(F.array_join(F.array_sort(F.collect_list("rel")), ",").alias("sample"))
    return sizes.join(sample, ["lang", "size"])


_OLD, _NEW = "SELECT rel, sha256(text) AS sha256 FROM f WHERE doc_id % 5 <> 0", "SELECT rel, sha256(CASE WHEN doc_id % 7 = 0 THEN text || '!' ELSE text END) AS sha256 FROM f WHERE doc_id % 3 <> 0"


@query(f"WITH {FILES}, o AS ({_OLD}), n AS ({_NEW}) SELECT coalesce(o.rel, n.rel) AS rel, CASE WHEN n.rel IS NULL THEN 'missing' WHEN o.rel IS NULL THEN 'extra' ELSE 'changed' END AS status FROM o FULL JOIN n ON o.rel = n.rel WHERE n.rel IS NULL OR o.rel IS NULL OR o.sha256 IS DISTINCT FROM n.sha256")
def hash_diff_full_outer(spark, d):
    f = files(spark, d)
    sha = lambda c: F.sha2(c.cast("binary"), 256).alias("sha256")
    new = F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    return evidence.hash_diff(f.where("doc_id % 5 <> 0").select("rel", sha(F.col("text"))), f.where("doc_id % 3 <> 0").select("rel", sha(new)))


@query("SELECT doc_id, 'left' AS side FROM (SELECT doc_id FROM labels WHERE quality = 1 EXCEPT SELECT doc_id FROM documents WHERE lang = 'en') UNION ALL SELECT doc_id, 'right' FROM (SELECT doc_id FROM documents WHERE lang = 'en' EXCEPT SELECT doc_id FROM labels WHERE quality = 1)")
def registry_symmetric_diff(spark, d):
    return evidence.symmetric_difference(table(spark, d, "labels").where("quality = 1"), table(spark, d, "documents").where("lang = 'en'"), "doc_id")


@query("""WITH c AS (SELECT c_nationkey AS k, count(*) AS n, round(max(c_acctbal), 2)::VARCHAR AS top FROM customer GROUP BY 1), s AS (SELECT s_nationkey AS k, count(*) AS n, round(max(s_acctbal), 2)::VARCHAR AS top FROM supplier GROUP BY 1)
SELECT n_name, field, l AS "left", r AS "right" FROM (SELECT k, 'n' AS field, c.n::VARCHAR AS l, s.n::VARCHAR AS r FROM c JOIN s USING (k) UNION ALL SELECT k, 'top', c.top, s.top FROM c JOIN s USING (k)) JOIN nation ON k = n_nationkey WHERE l IS DISTINCT FROM r""")
def metadata_drift(spark, d):
    def side(name: str, p: str) -> DataFrame:
        t = table(spark, d, name).groupBy(F.col(f"{p}_nationkey").alias("n_nationkey")).agg(F.count("*").alias("n"), F.round(F.max(f"{p}_acctbal"), 2).alias("top"))
        return t.join(table(spark, d, "nation").select("n_nationkey", "n_name"), "n_nationkey")

    return evidence.drift(side("customer", "c"), side("supplier", "s"), ["n_name"], ["n", "top"])


@query("""WITH c AS (SELECT DISTINCT doc_id AS id FROM documents UNION SELECT doc_id + 1000000 FROM documents WHERE doc_id % 200 = 0), d AS (SELECT doc_id AS id, md5(text) AS want FROM documents),
r AS (SELECT l.doc_id AS id, CASE WHEN l.toxic = 1 THEN 'failed' ELSE 'passed' END AS status, CASE WHEN l.doc_id % 8 = 0 THEN 'old' ELSE md5(x.text) END AS have FROM labels l JOIN documents x USING (doc_id)),
j AS (SELECT c.id, d.id IS NULL AS nodef, r.id IS NULL AS norun, status, want, have FROM c LEFT JOIN d USING (id) LEFT JOIN r USING (id))
SELECT id AS claim_id, 'undefined' AS code FROM j WHERE nodef UNION ALL SELECT id, 'never-run' FROM j WHERE norun UNION ALL SELECT id, 'not-passed' FROM j WHERE NOT norun AND status <> 'passed'
UNION ALL SELECT id, 'stale' FROM j WHERE NOT norun AND NOT nodef AND want IS DISTINCT FROM have UNION ALL SELECT id, 'accepted' FROM j WHERE NOT norun""")
def claim_validity(spark, d):
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    claims = docs.select(F.col("doc_id").alias("claim_id")).union(docs.where("doc_id % 200 = 0").select(F.col("doc_id") + 1_000_000))
    want = F.md5("text")
    definitions = docs.select(F.col("doc_id").alias("claim_id"), want.alias("required_sha"))
    status = F.when(F.col("toxic") == 1, "failed").otherwise("passed")
    latest = labels.join(docs, "doc_id").select(F.col("doc_id").alias("claim_id"), status.alias("status"), F.when(F.col("doc_id") % 8 == 0, "old").otherwise(want).alias("sha"))
    return evidence.claim_violations(claims, definitions, latest)


@query(f"WITH {FILES}, x AS (SELECT source, lang, doc_id // 64 AS part, rel || chr(1) || sha256(text) || chr(1) || strlen(text) || chr(10) AS row FROM f) SELECT source, lang, part, count(*) AS n, 'sha256:' || sha256(string_agg(row, '' ORDER BY row)) AS fingerprint FROM x GROUP BY ALL")
def content_fingerprint(spark, d):
    return evidence.content_fingerprint(files(spark, d).withColumn("part", F.floor(F.col("doc_id") / 64)), ["source", "lang", "part"])


@query(f"WITH {FILES} SELECT b.item_id, f.rel FROM benchmark b JOIN f ON contains(f.text, b.text)")
def contract_literal_search(spark, d):
    return evidence.literal_owners(table(spark, d, "benchmark"), files(spark, d))


# --- paths ---------------------------------------------------------------------------------------

PATHS = "pp AS (SELECT page_id, lower(regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '')) AS path FROM pages), pq AS (SELECT page_id, regexp_replace(path, '/+$', '') AS path FROM pp)"


def page_paths(spark: SparkSession, d: str) -> DataFrame:
    p = F.lower(F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "[?#].*$", ""))
    return table(spark, d, "pages").select("page_id", F.regexp_replace(p, "/+$", "").alias("path"))


@query(f"""WITH {PATHS}, o AS (SELECT DISTINCT split_part(path, '/', 1) || CASE WHEN page_id % 2 = 0 THEN '' ELSE '/' || split_part(path, '/', 2) END AS path FROM pq)
SELECT q.page_id AS left_id, q.path AS left_path, md5(o.path) AS right_id, o.path AS right_path FROM pq q JOIN o ON q.path = o.path OR starts_with(q.path, o.path || '/') OR starts_with(o.path, q.path || '/')""")
def path_overlap_join(spark, d):
    p = page_paths(spark, d)
    head = F.when(F.col("page_id") % 2 == 0, F.split("path", "/")[0]).otherwise(F.array_join(F.slice(F.split("path", "/"), 1, 2), "/"))
    owners = p.select(head.alias("right_path")).distinct().withColumn("right_id", F.md5("right_path"))
    return paths.overlapping(p.select(F.col("page_id").alias("left_id"), F.col("path").alias("left_path")), owners).select("left_id", "left_path", "right_id", "right_path")


@query(f"""WITH {PATHS}, o AS (SELECT DISTINCT split_part(path, '/', 1) || CASE WHEN page_id % 2 = 0 THEN '' ELSE '/' || split_part(path, '/', 2) END AS path FROM pq)
SELECT q.page_id AS item_id, q.path, (SELECT arg_max(o.path, length(o.path)) FROM o WHERE q.path = o.path OR starts_with(q.path, o.path || '/')) AS owner FROM pq q""")
def nearest_ancestor(spark, d):
    p = page_paths(spark, d)
    head = F.when(F.col("page_id") % 2 == 0, F.split("path", "/")[0]).otherwise(F.array_join(F.slice(F.split("path", "/"), 1, 2), "/"))
    return paths.nearest_ancestor(p.select(F.col("page_id").alias("item_id"), "path"), p.select(head.alias("path")))


@query("""WITH c AS (SELECT event_id AS claim_id, user_id AS writer, user_id % 3 AS worktree, event_type AS branch, date_trunc('hour', ts)::VARCHAR AS path FROM events WHERE event_type IN ('error', 'signup'))
SELECT a.claim_id, CASE WHEN a.worktree = b.worktree THEN 'write-lock-conflict' WHEN a.branch = b.branch THEN 'branch-write-conflict' ELSE 'merge-risk' END AS kind, count(*) AS others FROM c a JOIN c b ON a.path = b.path AND a.writer <> b.writer GROUP BY ALL""")
def conflict_self_join(spark, d):
    e = table(spark, d, "events").where(F.col("event_type").isin("error", "signup"))
    return paths.conflicts(e.select(F.col("event_id").alias("claim_id"), F.col("user_id").alias("writer"), (F.col("user_id") % 3).alias("worktree"), F.col("event_type").alias("branch"), F.date_trunc("hour", "ts").alias("path")))


# --- ledger --------------------------------------------------------------------------------------


def ledger_events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").select(F.col("conv_id").alias("stream"), F.col("turn").alias("seq"), F.col("role").alias("writer"), F.col("text").alias("payload"))


LEDGER = "e AS (SELECT conv_id AS stream, turn AS seq, role AS writer, text AS payload FROM conversations)"


@query(f"WITH {LEDGER}, k AS (SELECT stream, seq, lag(seq) OVER (PARTITION BY stream ORDER BY seq) + 1 AS expected FROM e WHERE (stream + seq) % 7 <> 0) SELECT * FROM k WHERE seq <> expected")
def stream_chain_check(spark, d):
    return ledger.chain_breaks(ledger_events(spark, d).where("(stream + seq) % 7 <> 0"))


@query(f"WITH {LEDGER} SELECT stream, count(*) AS events, sum(strlen(payload))::BIGINT AS bytes, min(seq) AS first_seq, max(seq) AS last_seq, arg_max(sha256(payload), seq) AS tail FROM e GROUP BY 1")
def stream_manifest(spark, d):
    return ledger.manifest(ledger_events(spark, d))


@query(f"""WITH {LEDGER}, l AS (SELECT stream, seq, sha256(CASE WHEN stream % 5 = 0 AND seq >= 1 THEN payload || '!' ELSE payload END) AS h FROM e WHERE seq < 2), r AS (SELECT stream, seq, sha256(payload) AS h FROM e),
d AS (SELECT r.stream, min(r.seq) AS s FROM r JOIN l ON r.stream = l.stream AND r.seq = l.seq WHERE r.h <> l.h GROUP BY 1)
SELECT r.stream, r.seq, CASE WHEN r.seq >= d.s THEN 'conflict' ELSE 'append' END AS action FROM r LEFT JOIN l ON r.stream = l.stream AND r.seq = l.seq LEFT JOIN d ON r.stream = d.stream WHERE l.seq IS NULL OR l.h <> r.h""")
def suffix_sync(spark, d):
    e = ledger_events(spark, d)
    sha = lambda c: F.sha2(c.cast("binary"), 256).alias("hash")
    local = F.when((F.col("stream") % 5 == 0) & (F.col("seq") >= 1), F.concat("payload", F.lit("!"))).otherwise(F.col("payload"))
    return ledger.suffix_sync(e.where("seq < 2").select("stream", "seq", sha(local)), e.select("stream", "seq", sha(F.col("payload"))))


@query(f"WITH {LEDGER} SELECT stream, seq FROM e m WHERE writer = 'user' AND NOT EXISTS (SELECT 1 FROM e a WHERE a.stream = m.stream AND a.writer = 'assistant' AND a.seq > m.seq)")
def unread_inbox(spark, d):
    e = ledger_events(spark, d)
    return ledger.unread(e.where("writer = 'user'"), e.where("writer = 'assistant'"), ["stream"], "seq").select("stream", "seq")


def ownership_events(spark: SparkSession, d: str, events: DataFrame | None = None) -> DataFrame:
    events = table(spark, d, "events") if events is None else events
    kind = F.when(F.col("event_type") == "signup", "claim").when(F.col("event_type") == "view", "release").when(F.col("event_type") == "error", "resolve")
    return events.select("event_id", "ts", kind.alias("kind"), F.col("user_id").cast("string").alias("writer"), F.concat(F.lit("p/"), F.floor(F.col("event_id") / 97).cast("string")).alias("path")).where("kind IS NOT NULL")


@query("""WITH o AS (SELECT event_id, ts, CASE event_type WHEN 'signup' THEN 'claim' WHEN 'view' THEN 'release' WHEN 'error' THEN 'resolve' END AS kind, user_id::VARCHAR AS writer, 'p/' || event_id // 97 AS path FROM events),
c AS (SELECT writer, path, max({'a': ts, 'b': event_id}) AS at FROM o WHERE kind = 'claim' GROUP BY ALL)
SELECT c.writer, c.path, c.at.a AS since FROM c WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.path = c.path AND ((o.kind = 'release' AND o.writer = c.writer) OR o.kind = 'resolve') AND (o.ts > c.at.a OR (o.ts = c.at.a AND o.event_id >= c.at.b)))""")
def ownership_fold(spark, d):
    return ledger.owned(ownership_events(spark, d), ["ts", "event_id"])


@query(ORACLES["ownership_fold"])
def ownership_stream(spark, d):
    schema = table(spark, d, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", True).option("maxFilesPerTrigger", 8).parquet(f"{d}/events.parquet")
    return ownership.fold_available(ownership_events(spark, d, stream))


@query(f"WITH s AS (SELECT user_id AS session, max(ts) AS last_seen FROM events GROUP BY 1) SELECT session, last_seen + INTERVAL 7200 SECOND AS expires_at FROM s WHERE last_seen + INTERVAL 7200 SECOND < TIMESTAMP '2024-01-30 12:00:00'")
def lease_expiry(spark, d):
    seen = table(spark, d, "events").groupBy(F.col("user_id").alias("session")).agg(F.max("ts").alias("last_seen"))
    return ledger.expired_leases(seen, F.to_timestamp(F.lit("2024-01-30 12:00:00")), F.lit(7200)).select("session", "expires_at")


@query("SELECT user_id, event_type, count(*) AS events, max(ts) AS last_seen, max(ts) < TIMESTAMP '2024-01-28 00:00:00' AS stale FROM events GROUP BY 1, 2")
def presence_matrix(spark, d):
    return ledger.presence(table(spark, d, "events"), ["user_id", "event_type"], "ts", F.to_timestamp(F.lit("2024-01-28 00:00:00")))


@query("WITH k AS (SELECT conv_id AS stream, turn AS seq, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS new_seq FROM conversations WHERE (conv_id + turn) % 7 <> 0) SELECT stream, seq, new_seq FROM k WHERE seq <> new_seq")
def sequence_repair(spark, d):
    e = ledger_events(spark, d).where("(stream + seq) % 7 <> 0").withColumn("ordinal", F.col("seq"))
    return ledger.renumbered(e).where("changed").select("stream", "seq", "new_seq")


@query("SELECT conv_id AS stream, turn AS seq, CASE WHEN row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 3 THEN 'live' ELSE 'archive' END AS part FROM conversations")
def ledger_compaction(spark, d):
    return ledger.compacted(ledger_events(spark, d), 3).select("stream", "seq", "part")


@query("SELECT o_orderkey, date_diff('day', o_orderdate::DATE, DATE '2024-01-31') AS days, CASE WHEN date_diff('day', o_orderdate::DATE, DATE '2024-01-31') > 90 THEN 'too-long' ELSE 'ok' END AS verdict FROM orders")
def policy_days(spark, d):
    days = F.datediff(F.lit("2024-01-31").cast("date"), F.to_date("o_orderdate")).cast("long")
    return table(spark, d, "orders").select("o_orderkey", days.alias("days"), F.when(days > 90, "too-long").otherwise("ok").alias("verdict"))


@query(f"WITH {LINES}, u AS (SELECT 'secrets' AS \"check\", rel FROM ({_SECRET_SQL}) UNION ALL SELECT 'text', rel FROM (" + TEXT_FINDINGS.split(", x AS (", 1)[1].split("), x1", 1)[0] + ")) SELECT \"check\", count(*) AS n, count(DISTINCT rel) AS n_files FROM u GROUP BY 1")
def verify_union(spark, d):
    both = secret_findings(spark, d).select(F.lit("secrets").alias("check"), "rel").unionByName(text_findings(spark, d).select(F.lit("text").alias("check"), "rel"))
    per = both.groupBy("check", "rel").agg(F.count("*").alias("n"))
    return per.groupBy("check").agg(F.sum("n").alias("n"), F.count("*").alias("n_files"))


@query("WITH k AS (SELECT event_id AS report_id, json_keys(props) AS k FROM events) SELECT report_id, array_to_string(list_sort(list_filter(['file', 'line', 'k', 'v', 'ruleId'], lambda x: NOT list_contains(k, x))), ',') AS missing FROM k")
def report_completeness(spark, d):
    r = table(spark, d, "events").select(F.col("event_id").alias("report_id"), F.from_json("props", "map<string,string>").alias("fields"))
    return policy.completeness(r, ["file", "line", "k", "v", "ruleId"])


# --- configuration, boundaries and views ---------------------------------------------------------


@query(f"WITH {PATHS} SELECT page_id, path FROM pq WHERE regexp_matches(path, '^.*/en/[^/]*$') OR regexp_matches(path, '^m\\.[^/]*/[^/][^/]/.*$')")
def glob_filter(spark, d):
    return page_paths(spark, d).where(config.matches_any(F.col("path"), ["**/en/*", "m.*/??/**"])).select("page_id", "path")


@query("""WITH i AS (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/]*/([a-z]+)', 1) || '/' || page_id AS rel, unnest(regexp_extract_all(html, 'href="/([^"]+)"', 1)) AS specifier FROM pages)
SELECT rel, specifier, 'English pages keep out' AS message FROM i WHERE starts_with(rel, 'en/') AND regexp_matches(specifier, '^[Tt][^/]*$') AND NOT regexp_matches(specifier, '^[Tt]h[^/]*$')
UNION ALL SELECT rel, specifier, 'no capitals' FROM i WHERE (starts_with(rel, 'de/') OR starts_with(rel, 'fr/')) AND regexp_matches(specifier, '^D[^/]*$')""")
def import_boundary(spark, d):
    rel = F.concat(F.regexp_extract("url", "^[a-z]+://[^/]*/([a-z]+)", 1), F.lit("/"), F.col("page_id").cast("string"))
    imports = table(spark, d, "pages").select(rel.alias("rel"), F.explode(F.regexp_extract_all("html", F.lit('href="/([^"]+)"'), 1)).alias("specifier"))
    return config.boundary_violations(imports, [
        {"roots": ["en"], "forbidden": ["T*", "t*"], "allowed": ["Th*", "th*"], "message": "English pages keep out"},
        {"roots": ["de", "fr/"], "forbidden": ["D*"], "message": "no capitals"},
    ])


@query("SELECT n_nationkey, CASE WHEN n_nationkey % 3 = 0 THEN lower(n_name) ELSE n_name END AS n_name, n_regionkey FROM nation UNION ALL SELECT n_nationkey + 100, lower(n_name), n_regionkey FROM nation WHERE n_nationkey % 3 = 0 AND n_nationkey > 12")
def registry_overlay(spark, d):
    base = table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey")
    changed = base.where("n_nationkey % 3 = 0").withColumn("n_name", F.lower("n_name"))
    new = changed.where("n_nationkey > 12").withColumn("n_nationkey", F.col("n_nationkey") + 100)
    return config.overlaid(base, changed.unionByName(new), "n_nationkey")


@query("SELECT user_id, event_type AS key, arg_max(round(value, 4), event_id) AS value FROM events WHERE event_id % 3 <> 0 GROUP BY ALL")
def config_layers(spark, d):
    value = F.when(F.col("event_id") % 3 != 0, F.round("value", 4))
    return config.merged(table(spark, d, "events").select("user_id", "event_id", F.col("event_type").alias("key"), value.alias("value")), ["user_id"], F.col("event_id"))


@query(f"WITH {TEXT_FINDINGS} SELECT finding_id, rule_id FROM x1 WHERE rel <= (SELECT min(rel) FROM x1)")
def fail_fast_scan(spark, d):
    return config.fail_fast(text_findings(spark, d)).select("finding_id", "rule_id")


@query(f"WITH {TEXT_FINDINGS} SELECT rel, line_no, rule_id, detail FROM x1 ORDER BY rel, line_no, rule_id, detail LIMIT 20")
def sorted_findings_top20(spark, d):
    return text_findings(spark, d).select("rel", "line_no", "rule_id", "detail").orderBy("rel", "line_no", "rule_id", "detail").limit(20)


@query("WITH o AS (SELECT DISTINCT user_id::VARCHAR AS w, 'p/' || event_id // 97 AS path FROM events WHERE event_type = 'signup') SELECT path, count(*) AS n, array_to_string(list_sort(list(w))[1:3], ',') AS owners FROM o GROUP BY 1")
def claimed_path_view(spark, d):
    o = ownership_events(spark, d).where("kind = 'claim'").select("path", "writer").distinct()
    few = runs.newest_per(o.withColumn("zero", F.lit(0)), ["path"], 3, "zero", "writer").groupBy("path").agg(F.array_join(F.array_sort(F.collect_list("writer")), ",").alias("owners"))
    return o.groupBy("path").agg(F.count("*").alias("n")).join(few, "path")


@query(f"WITH {LEDGER} SELECT stream, writer, seq FROM e WHERE writer <> 'system' QUALIFY row_number() OVER (PARTITION BY stream, writer ORDER BY seq) = 1")
def next_intent_per_lane(spark, d):
    e = ledger_events(spark, d).where("writer <> 'system'")
    return e.groupBy("stream", "writer").agg(F.min("seq").alias("seq"))


@query("SELECT conv_id AS stream, role AS writer, arg_max(md5(text), turn) AS last FROM conversations GROUP BY ALL")
def blocking_owner_last(spark, d):
    return ledger_events(spark, d).groupBy("stream", "writer").agg(F.max_by(F.md5("payload"), "seq").alias("last"))


@query("SELECT sha256(text) AS sha, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY text HAVING count(*) > 1")
def duplicate_ids(spark, d):
    g = table(spark, d, "documents").groupBy(F.sha2(F.col("text").cast("binary"), 256).alias("sha")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"))
    return g.where("n > 1")


@query(f"WITH {FILES} SELECT l.doc_id FROM labels l WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.doc_id = l.doc_id AND f.lang = 'en')")
def expected_files_missing(spark, d):
    return table(spark, d, "labels").select("doc_id").join(files(spark, d).where("lang = 'en'"), "doc_id", "left_anti")


@query("SELECT p_brand, p_type, count(*) FILTER (p_size > 25) AS n_fail, count(*) FILTER (p_size <= 25) AS n_pass FROM part GROUP BY 1, 2 HAVING count(*) FILTER (p_size > 25) = 0 OR count(*) FILTER (p_size <= 25) = 0")
def fixture_evidence_gaps(spark, d):
    g = table(spark, d, "part").groupBy("p_brand", "p_type").agg(F.count_if(F.col("p_size") > 25).alias("n_fail"), F.count_if(F.col("p_size") <= 25).alias("n_pass"))
    return g.where("n_fail = 0 OR n_pass = 0")


@query(f"WITH {LINES}, d AS (SELECT rel, count(DISTINCT regexp_extract(line, '^([A-Z])', 1)) FILTER (regexp_matches(line, '^[A-Z]')) AS n FROM l GROUP BY 1) SELECT rel, n FROM d WHERE n >= 6")
def distinct_layers(spark, d):
    first = F.regexp_extract("line", "^([A-Z])", 1)
    per = lines(spark, d).where(F.col("line").rlike("^[A-Z]")).groupBy("rel", first.alias("layer")).agg(F.count("*").alias("c"))
    return per.groupBy("rel").agg(F.count("*").alias("n")).where("n >= 6")


@query(f"WITH {LINES} SELECT rel, max(length(replace(regexp_extract(line, '^([ \t]*)', 1), chr(9), '    ')) // 4)::BIGINT AS depth, count(*) FILTER (regexp_matches(line, '^[ \t]')) AS n_indented FROM l GROUP BY 1")
def indent_depth(spark, d):
    width = F.length(F.replace(F.regexp_extract("line", r"^([ \t]*)", 1), F.lit("\t"), F.lit("    ")))
    return lines(spark, d).groupBy("rel").agg(F.max(F.floor(width / 4)).alias("depth"), F.count_if(F.col("line").rlike(r"^[ \t]")).alias("n_indented"))


# the other modules of this folder register their queries here as well
from lumenfold.plans import audit_queries, block_queries, chain_queries, common_queries, coordination_queries, rule_queries, scope_queries, state_queries, store_queries, stream_queries  # noqa: E402, F401
