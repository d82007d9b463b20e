"""Queries of scopes, registries, presence and definitions."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenfold.functions import text as T
from lumenfold.operators import config, evidence, inventory, ledger, literals
from lumenfold.plans import audit_queries as A
from lumenfold.plans import catalog as C
from lumenfold.plans import rule_queries as R
from lumenfold.sources import stores


@C.query(f"WITH {C.PATHS}, d AS (SELECT page_id, path AS rel FROM pq) SELECT 'all' AS mode, count(*) AS n FROM d UNION ALL SELECT 'files', count(*) FROM d WHERE EXISTS (SELECT 1 FROM d e WHERE e.page_id % 5 = 0 AND (d.rel = e.rel OR starts_with(d.rel, e.rel || '/'))) UNION ALL SELECT 'diff', count(*) FROM d WHERE EXISTS (SELECT 1 FROM d e WHERE e.rel = d.rel AND e.page_id % 3 = 0)")
def scope_modes(spark, d):
    p = C.page_paths(spark, d).withColumnRenamed("path", "rel")
    parts = {"all": p, "files": stores.scoped(p, "files", p.where("page_id % 5 = 0")), "diff": stores.scoped(p, "diff", p.select("rel", F.when(F.col("page_id") % 3 == 0, "M").otherwise("D").alias("kind")))}
    out = None
    for mode, rows in parts.items():
        one = rows.agg(F.count("*").alias("n")).select(F.lit(mode).alias("mode"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@C.query(f"WITH {C.PATHS}, d AS (SELECT path || CASE page_id % 4 WHEN 0 THEN '.json' WHEN 1 THEN '.md' WHEN 2 THEN '.mjs' ELSE '' END AS rel FROM pq) SELECT rel FROM d WHERE regexp_extract(rel, '(\\.[^./]+)$', 1) IN ('.json', '.mjs') ORDER BY rel LIMIT 500")
def legacy_artifact_files(spark, d):
    ext = F.when(F.col("page_id") % 4 == 0, ".json").when(F.col("page_id") % 4 == 1, ".md").when(F.col("page_id") % 4 == 2, ".mjs").otherwise("")
    return stores.artifact_files(C.page_paths(spark, d).select(F.concat("path", ext).alias("rel")), (".json", ".mjs"))


@C.query(f"""WITH {C.FILES}, e AS (SELECT doc_id // 16 AS part, rel || CASE WHEN doc_id % 9 = 0 THEN '.gone' ELSE '' END AS rel FROM f), j AS (SELECT e.part, e.rel, sha256(f.text) AS s, strlen(f.text) AS b FROM e LEFT JOIN f ON e.rel = f.rel)
SELECT part, count(*) AS n, count(*) FILTER (s IS NULL) AS missing, sha256('[' || string_agg('{{"rel":"' || rel || '","sha256":' || coalesce('"' || s || '"', 'null') || ',"bytes":' || coalesce(b::VARCHAR, 'null') || '}}', ',' ORDER BY rel) || ']') AS fingerprint FROM j GROUP BY 1""")
def expected_fingerprints(spark, d):
    f = C.files(spark, d)
    expected = f.select(F.floor(F.col("doc_id") / 16).alias("part"), F.concat("rel", F.when(F.col("doc_id") % 9 == 0, ".gone").otherwise("")).alias("rel"))
    return stores.expected_fingerprint(expected, f, "part")


@C.query(f"WITH {C.RUNS} SELECT run_id, status, tool FROM r")
def run_files_round_trip(spark, d):
    path = stores.shared_folder(spark, "runs")
    stores.write_runs(C.tool_runs(spark, d).select("run_id", "status", "tool"), path)
    return spark.read.schema("run_id long, status string, tool string").option("basePath", path).json(path)


@C.query("WITH s AS (SELECT user_id, event_type AS key, unnest(['d' || event_id % 4, 'e' || event_id % 3]) AS v FROM events) SELECT user_id, key, array_to_string(list_sort(list(DISTINCT v)), ',') AS \"values\" FROM s GROUP BY ALL")
def config_set_union(spark, d):
    i = F.col("event_id")
    v = F.array(F.concat(F.lit("d"), (i % 4).cast("string")), F.concat(F.lit("e"), (i % 3).cast("string")))
    out = config.merged_sets(C.table(spark, d, "events").select("user_id", F.col("event_type").alias("key"), v.alias("values")), ["user_id"])
    return out.withColumn("values", F.array_join("values", ","))


@C.query("""WITH l AS (SELECT 0 AS layer, n_nationkey AS ordinal, 1 AS v, n_nationkey AS id, n_name AS title FROM nation UNION ALL SELECT 1, n_nationkey + 100, 3, n_nationkey, lower(n_name) FROM nation WHERE n_nationkey % 3 = 0 UNION ALL SELECT 1, c_custkey + 1000, 2, c_custkey + 100, c_name FROM customer)
SELECT id, arg_min(ordinal, layer) AS ordinal, arg_max(title, layer) AS title, (SELECT max(v) FROM l) AS schema_version FROM l GROUP BY id""")
def registry_versions(spark, d):
    n, c = C.table(spark, d, "nation"), C.table(spark, d, "customer")
    row = lambda t, layer, at, v, id_, title: t.select(F.lit(layer).alias("layer"), at.cast("long").alias("ordinal"), F.lit(v).alias("schema_version"), id_.cast("long").alias("id"), title.alias("title"))
    key = F.col("n_nationkey")
    layers = row(n, 0, key, 1, key, F.col("n_name")).unionByName(row(n.where("n_nationkey % 3 = 0"), 1, key + 100, 3, key, F.lower("n_name"))).unionByName(row(c, 1, F.col("c_custkey") + 1000, 2, F.col("c_custkey") + 100, F.col("c_name")))
    rows, version = config.merged_registry(layers, "id")
    return rows.join(version, F.lit(True))  # one row


@C.query(f"WITH {R.PY}, x AS ({R._rules_sql(R.rulebook.PYTHON_RULES)}) SELECT rule_id, count(*) AS n FROM x WHERE rule_id IN ('PY-4.11', 'PY-4.18', 'PY-2.1') GROUP BY 1")
def scanner_backed_check(spark, d):
    return R.python_rule_findings(spark, d).where(F.col("rule_id").isin("PY-4.11", "PY-4.18", "PY-2.1")).groupBy("rule_id").agg(F.count("*").alias("n"))


@C.query("""SELECT p_partkey AS id, p_name AS title, p_type AS family, CASE WHEN p_size > 25 THEN 'error' ELSE 'info' END AS severity, CASE p_size % 3 WHEN 0 THEN 'ci,local' WHEN 1 THEN 'local' ELSE 'cloud,linux' END AS capabilities, p_size % 4 AS commands FROM part""")
def compact_definitions(spark, d):
    s = F.col("p_size")
    can = F.when(s % 3 == 0, F.array(F.lit("local"), F.lit("ci"))).when(s % 3 == 1, F.array(F.lit("local"))).otherwise(F.array(F.lit("linux"), F.lit("cloud")))
    commands = F.filter(F.array(*map(F.lit, range(4))), lambda k: k < s % 4)
    return inventory.compact_definitions(C.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.col("p_type").alias("family"), F.when(s > 25, "error").otherwise("info").alias("severity"), can.alias("capabilities"), commands.alias("commands")))


@C.query(f"WITH {A._SCRIPT_SQL} SELECT 'legacy.' || regexp_extract(rel, '([^/]+)\\.mjs$', 1) AS id, CASE WHEN contains(rel, 'release-') THEN 'Release ' ELSE 'Check ' END || regexp_extract(rel, '(\\d+)\\.mjs$', 1) AS title, CASE " + " ".join(f"WHEN regexp_matches(whole, '{p}') THEN '{n}'" for n, p in inventory.FAMILIES) + " ELSE 'command' END AS family, 'node ' || rel AS command FROM w")
def script_definitions(spark, d):
    return inventory.script_definitions(A.script_inventory(spark, d))


@C.query("""WITH l AS (SELECT event_type AS lane, arg_max(CASE WHEN event_id % 2 = 0 THEN 'busy' END, event_id) AS state, max(event_id) AS thread FROM events WHERE event_type <> 'view' GROUP BY 1), w AS (SELECT DISTINCT user_id AS worker, event_type AS lane FROM events)
SELECT w.worker, w.lane, coalesce(state, 'unknown') AS state, thread, CASE WHEN l.lane IS NULL THEN 0 ELSE 1 END AS paths FROM w LEFT JOIN l ON w.lane = l.lane""")
def presence_rows(spark, d):
    e = C.table(spark, d, "events")
    i = F.col("event_id")
    lanes = e.where("event_type <> 'view'").groupBy(F.col("event_type").alias("lane")).agg(F.max_by(F.when(i % 2 == 0, "busy"), F.when(i % 2 == 0, i)).alias("state"), F.max(i).alias("thread"))
    return ledger.presence_rows(e.select(F.col("user_id").alias("worker"), F.col("event_type").alias("lane")).distinct(), lanes.withColumn("paths", F.array(F.lit("a"), F.lit(""))))


@C.query("WITH b AS (SELECT event_id // 30 AS request_id, event_id, CASE WHEN user_id % 5 = 0 THEN 'request' ELSE 'w' || user_id % 5 END AS writer, event_type AS owner FROM events) SELECT request_id, writer, arg_max(owner, event_id) AS owner FROM b WHERE writer <> 'request' GROUP BY 1, 2")
def blocking_owners(spark, d):
    u = F.col("user_id") % 5
    return ledger.blocking_owners(C.table(spark, d, "events").select(F.floor(F.col("event_id") / 30).alias("request_id"), F.col("event_id").alias("ordinal"), F.when(u == 0, "request").otherwise(F.concat(F.lit("w"), u.cast("string"))).alias("writer"), F.col("event_type").alias("owner")))


@C.query("WITH i AS (SELECT 'p/' || event_id // 97 AS path, event_type AS lane, 'w' || user_id % 7 AS writer, event_id FROM events) SELECT path, lane, arg_min(writer, event_id) AS writer FROM i WHERE writer <> 'w3' GROUP BY 1, 2")
def release_recipients(spark, d):
    i = F.col("event_id")
    rows = C.table(spark, d, "events").select(F.concat(F.lit("p/"), F.floor(i / 97).cast("string")).alias("path"), F.col("event_type").alias("lane"), F.concat(F.lit("w"), (F.col("user_id") % 7).cast("string")).alias("writer"), i.alias("ordinal"))
    return ledger.next_recipients(rows, F.lit("w3"))


@C.query("SELECT event_id, left(translate(replace(base64(encode(event_type || '|' || user_id || '|' || event_id || '|' || 'a longer message than that')), chr(10), ''), '+/=', '-_'), 24) AS fingerprint FROM events")
def diagnostic_fingerprints(spark, d):
    return C.table(spark, d, "events").select("event_id", T.diagnostic_fingerprint(F.col("event_type"), F.col("user_id"), F.col("event_id"), F.lit("a longer message than that")).alias("fingerprint"))


@C.query("""WITH c AS (SELECT l_orderkey AS pkg, string_agg(l_partkey::VARCHAR, ',' ORDER BY l_partkey) AS names, count(*) AS n FROM lineitem GROUP BY 1) SELECT pkg, n, names FROM c""")
def captured_metadata(spark, d):
    l = C.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("pkg")).agg(F.array_sort(F.collect_list("l_partkey")).alias("deps"))  # an order has few items
    text = F.to_json(F.struct(F.transform("deps", lambda x: F.struct(x.alias("name"))).alias("dependencies")))
    v = F.from_json(text, "struct<dependencies:array<struct<name:bigint>>>")
    return l.select("pkg", F.size(v["dependencies"]).cast("long").alias("n"), F.array_join(F.transform(v["dependencies"], lambda x: x["name"].cast("string")), ",").alias("names"))


@C.query(f"""WITH {C.FILES}, w AS (SELECT item_id, string_split(text, ' ') AS a FROM benchmark), p AS (SELECT DISTINCT array_to_string(a[k:k + 2], ' ') AS literal FROM (SELECT a, unnest(range(1, len(a) - 1)) AS k FROM w)), q AS (SELECT literal FROM p WHERE literal <> '')
SELECT f.rel, literal, strlen(f.text[:strpos(f.text, literal) - 1])::BIGINT AS first FROM f JOIN q ON contains(f.text, literal)""")
def phrase_occurrences(spark, d):
    """Every run of three words of the benchmark in every document."""
    words = F.split("text", " ")
    runs = F.transform(F.sequence(F.lit(1), F.size(words) - 2), lambda k: F.array_join(F.slice(words, k, 3), " "))
    phrases = C.table(spark, d, "benchmark").where(F.size(words) > 2).select(F.explode(runs).alias("literal")).distinct().where("literal <> ''")
    keyed = phrases.select(F.xxhash64("literal").alias("literal_id"), "literal")
    return literals.occurrences(C.files(spark, d), keyed).join(keyed, "literal_id").select("rel", "literal", "first")


# values of our own tables as contract values: each word beside which no letter, digit or one of @._/- stands
@C.query(f"""WITH {C.FILES}, v AS (SELECT n_nationkey AS item_id, lower(n_name) AS text FROM nation UNION ALL SELECT 1000 + p_partkey, split_part(p_name, ' ', 1) FROM part UNION ALL SELECT 100000 + item_id, array_to_string(string_split(text, ' ')[2:3], ' ') FROM benchmark)
SELECT v.item_id, f.rel FROM v JOIN f ON v.text <> '' AND regexp_matches(f.text, '(?s)(?:^|[^A-Za-z0-9@._/-])' || regexp_escape(v.text) || '(?:$|[^A-Za-z0-9@._/-])')""")
def contract_value_tokens(spark, d):
    values = C.table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("item_id"), F.lower("n_name").alias("text"))
    values = values.unionByName(C.table(spark, d, "part").select((F.col("p_partkey") + 1000).cast("long").alias("item_id"), F.split_part("p_name", F.lit(" "), F.lit(1)).alias("text")))
    values = values.unionByName(C.table(spark, d, "benchmark").select((F.col("item_id") + 100000).cast("long").alias("item_id"), F.array_join(F.slice(F.split("text", " "), 2, 2), " ").alias("text")))
    return evidence.literal_owners(values, C.files(spark, d), tokens=True)
