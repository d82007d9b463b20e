"""Queries of tool outputs and stores: texts and runs that Spark derives from events, written and read back where that is the point."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.operators import diagnostics
from lumenfold.plans import audit_queries as A
from lumenfold.plans import catalog as C
from lumenfold.sources import stores


# --- tool outputs --------------------------------------------------------------------------------
# an event is a run; its id picks the tool and puts numbers into the output

_I = "event_id"


def tool_outputs(spark: SparkSession, d: str) -> DataFrame:
    """outputs(run_id, tool, text)."""
    i = F.col(_I)
    n = i.cast("string")
    line = (i % 50 + 1).cast("string")
    c = lambda *parts: F.concat(*[p if not isinstance(p, str) else F.lit(p) for p in parts])
    rust = c('{"reason": "compiler-message", "message": {"level": "', F.when(i % 3 == 0, "error").otherwise("warning"), '", "message": "m', n, '", "code": ', F.when(i % 2 == 0, '{"code": "E1"}').otherwise("null"), ', "spans": [{"file_name": "a.rs", "line_start": 2, "is_primary": false}, {"file_name": "b.rs", "line_start": ', line, ', "is_primary": true}]}}')
    texts = (
        c(rust, "\n", rust, "\n", '{"reason": "other"}', "\n{broken"),
        c('[{"filePath": "a.ts", "messages": [{"ruleId": null, "severity": 2, "message": "m', n, '", "line": null}, {"ruleId": "x", "severity": 1, "message": "k", "line": ', line, "}]}]"),
        c('[{"filename": "a.py", "code": "E5", "message": "m', n, '", "location": {"row": ', line, "}}]"),
        c('{"generalDiagnostics": [{"file": "a.py", "severity": "warning", "message": "m', n, '", "range": {"start": {"line": ', line, "}}}]}"),
        c('{"runs": [{"results": [{"ruleId": "S', n, '", "level": "note", "message": {"text": "m"}, "locations": [{"physicalLocation": {"artifactLocation": {"uri": "u"}, "region": {"startLine": ', line, '}}}]}, {"message": {"text": "k"}, "locations": []}]}]}'),
        c("src/a.ts(", line, ",7): error TS22: no ", n, "\nFAILED t/x.py::test_a - boom\nother\nFAILED t/none.py::test_b\nFAILED t/y.py::A::test_c  -  twice\nsrc/b.ts(1,2):\twarning TS9:   spaced\nsrc/c.ts(1,2): error TS9: "),
        F.lit("[1, 2"), F.lit("all good"))
    text = texts[-1]
    for k in range(7):  # only the text that is taken is put together
        text = F.when(i % 8 == k, texts[k]).otherwise(text)
    # parsing costs more than reading, so ids are dealt out before texts are made: a small file is one task
    events = C.table(spark, d, "events").select(_I).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), _I)
    return events.select(i.alias("run_id"), F.concat(F.lit("t"), (i % 8).cast("string")).alias("tool"), text.alias("text"))


_ROWS = """r AS (SELECT event_id AS run_id, 't' || event_id % 8 AS tool, event_id % 8 AS k, event_id AS i, event_id % 50 + 1 AS line FROM events), x AS (
SELECT run_id, tool, CASE WHEN i % 3 = 0 THEN 'error' ELSE 'warning' END AS severity, CASE WHEN i % 2 = 0 THEN 'E1' ELSE 'rustc' END AS rule_id, 'b.rs' AS file, line, 'm' || i AS message FROM r WHERE k = 0
UNION ALL SELECT run_id, tool, 'warning', 'HAR-2.4', '.', 1, 'malformed JSON line' FROM r WHERE k = 0 UNION ALL SELECT run_id, tool, 'warning', 'HAR-2.4', '.', 1, 'malformed JSON payload' FROM r WHERE k = 0
UNION ALL SELECT run_id, tool, 'error', 'eslint', 'a.ts', 1, 'm' || i FROM r WHERE k = 1 UNION ALL SELECT run_id, tool, 'warning', 'x', 'a.ts', line, 'k' FROM r WHERE k = 1
UNION ALL SELECT run_id, tool, 'error', 'E5', 'a.py', line, 'm' || i FROM r WHERE k = 2
UNION ALL SELECT run_id, tool, 'warning', 'pyright', 'a.py', line + 1, 'm' || i FROM r WHERE k = 3
UNION ALL SELECT run_id, tool, 'info', 'S' || i, 'u', line, 'm' FROM r WHERE k = 4 UNION ALL SELECT run_id, tool, 'warning', 'sarif', '.', 1, 'k' FROM r WHERE k = 4
UNION ALL SELECT run_id, tool, 'error', 'TS22', 'src/a.ts', line, 'no ' || i FROM r WHERE k = 5 UNION ALL SELECT run_id, tool, 'error', 'pytest', 't/x.py', 1, 'boom' FROM r WHERE k = 5 UNION ALL SELECT run_id, tool, 'error', 'pytest', 't/y.py', 1, 'twice' FROM r WHERE k = 5 UNION ALL SELECT run_id, tool, 'warning', 'TS9', 'src/b.ts', 1, 'spaced' FROM r WHERE k = 5
UNION ALL SELECT run_id, tool, 'warning', 'HAR-2.4', '.', 1, 'malformed JSON payload' FROM r WHERE k = 6)"""


def parsed(spark: SparkSession, d: str) -> DataFrame:
    return diagnostics.parse(tool_outputs(spark, d))


@C.query(f"WITH {_ROWS} SELECT * FROM x")
def diagnostics_parse(spark, d):
    return parsed(spark, d)


@C.query(f"WITH {_ROWS} SELECT * FROM x WHERE tool = 't0' AND rule_id <> 'HAR-2.4'")
def diagnostics_compiler(spark, d):
    return diagnostics.json_lines(tool_outputs(spark, d).where("tool = 't0'")).where("rule_id <> 'HAR-2.4'").drop("ordinal").distinct()


@C.query(f"WITH {_ROWS} SELECT tool, rule_id, message, count(*) AS n FROM x WHERE rule_id = 'HAR-2.4' GROUP BY ALL")
def diagnostics_malformed(spark, d):
    return parsed(spark, d).where("rule_id = 'HAR-2.4'").groupBy("tool", "rule_id", "message").agg(F.count("*").alias("n"))


@C.query(f"WITH {_ROWS} SELECT * FROM x WHERE tool IN ('t1', 't2', 't3', 't4')")
def diagnostics_payloads(spark, d):
    return diagnostics.payloads(tool_outputs(spark, d).where("tool IN ('t1', 't2', 't3', 't4')")).drop("ordinal")


@C.query(f"WITH {_ROWS} SELECT * FROM x WHERE tool = 't5'")
def diagnostics_text(spark, d):
    return diagnostics.text_lines(tool_outputs(spark, d)).drop("ordinal")


@C.query(f"WITH {_ROWS}, c AS (SELECT run_id, severity || '=' || count(*) AS s, count(*) AS c FROM x GROUP BY run_id, severity) SELECT run_id, sum(c)::BIGINT AS n, string_agg(s, ',' ORDER BY s) AS by_severity FROM c GROUP BY 1")
def diagnostics_summary(spark, d):
    return diagnostics.summary(parsed(spark, d))


@C.query(f"WITH {_ROWS} SELECT run_id, rule_id, file, line, message FROM x WHERE severity = 'error' AND file = 'src/a.ts' ORDER BY file, line, rule_id, message LIMIT 50")
def diagnostics_query(spark, d):
    return diagnostics.matching(parsed(spark, d), "error", "src/a.ts").select("run_id", "rule_id", "file", "line", "message")


@C.query("SELECT event_id AS run_id, event_type AS tool, 'error' AS severity, 'HAR-1.1' AS rule_id, '.' AS file, 1 AS line, 'command exited with ' || event_id % 4 AS message, CASE WHEN event_id % 5 = 0 THEN 'out ' || event_id ELSE array_to_string(list_transform(range(1, least(event_id % 12 + 1, 8) + 1), lambda k: 'e' || k), chr(10)) END AS source FROM events WHERE event_id % 4 <> 0")
def failed_commands(spark, d):
    i = F.col(_I)
    err = F.when(i % 5 == 0, "  ").otherwise(F.array_join(F.transform(F.sequence(F.lit(1), (i % 12 + 1).cast("int")), lambda k: F.concat(F.lit("e"), k.cast("string"))), "\n"))
    rows = C.table(spark, d, "events").select(i.alias("run_id"), F.col("event_type").alias("tool"), (i % 4).alias("exit_code"), F.concat(F.lit("out "), i.cast("string")).alias("stdout"), err.alias("stderr"))
    return diagnostics.failed_commands(rows)


# --- stores --------------------------------------------------------------------------------------

_STORE = "run_id long, tool string, status string, storage string"


def _runs(spark: SparkSession, d: str) -> DataFrame:
    r = C.tool_runs(spark, d)
    return r.select("run_id", "tool", "status", F.when(F.col("run_id") % 3 == 0, "proof").alias("storage"))


@C.query(f"WITH {C.RUNS} SELECT run_id, tool, status, CASE WHEN run_id % 3 = 0 THEN 'proof' END AS storage FROM r")
def ndjson_round_trip(spark, d):
    path = stores.shared_folder(spark, "ndjson")
    stores.write_ndjson(_runs(spark, d), path)
    return stores.read_ndjson(spark, path, _STORE)


@C.query(f"WITH {C.RUNS}, a AS (SELECT run_id, tool, 'first' AS status, CASE WHEN run_id % 3 = 0 THEN 'proof' END AS storage FROM r WHERE run_id % 4 = 0), b AS (SELECT run_id, tool, status, CASE WHEN run_id % 3 = 0 THEN 'proof' END AS storage FROM r WHERE run_id % 2 = 0) SELECT run_id, tool, status, coalesce(storage, 'runs') AS storage FROM (SELECT * FROM a UNION ALL SELECT * FROM b WHERE run_id NOT IN (SELECT run_id FROM a))")
def first_root_wins(spark, d):
    r = _runs(spark, d)
    first, second = r.where("run_id % 4 = 0").withColumn("status", F.lit("first")), r.where("run_id % 2 = 0")
    paths = [stores.shared_folder(spark, f"root{k}") for k in range(2)]
    for rows, path in zip((first, second), paths):
        stores.write_ndjson(rows, path)
    return stores.first_root_wins([stores.read_ndjson(spark, p, _STORE) for p in paths], "run_id").select("run_id", "tool", "status", "storage")


@C.query(f"WITH {C.RUNS} SELECT run_id, -run_id AS ordinal, tool, status FROM r WHERE run_id % 2 = 0 AND run_id % 5 <> 0")
def runs_by_manifest(spark, d):
    r = C.tool_runs(spark, d)
    manifest = r.where("run_id % 2 = 0").select("run_id", (-F.col("run_id")).alias("ordinal"))
    return stores.by_manifest(manifest, r.where("run_id % 5 <> 0").select("run_id", "tool", "status"), "run_id")


@C.query(f"WITH {C.RUNS} SELECT run_id, row_number() OVER (ORDER BY started_at DESC, run_id) AS ordinal FROM r WHERE run_id % 2 = 0 ORDER BY ordinal LIMIT 20")
def manifest_export(spark, d):
    from lumenfold.operators import runs

    top = runs.newest(C.tool_runs(spark, d).where("run_id % 2 = 0"), 20)
    newest = top.agg(F.array_sort(F.collect_list(F.struct((-F.unix_micros(F.col("started_at").cast("timestamp"))).alias("t"), "run_id"))).alias("x"))  # twenty rows
    return stores.exported(newest.select(F.posexplode("x").alias("pos", "r")).select("r.run_id", (F.col("pos") + 1).cast("long").alias("ordinal")))


@C.query(f"WITH {C.RUNS}, m AS (SELECT run_id, status, started_at FROM r WHERE run_id % 3 <> 1 AND run_id % 2 <> 0 UNION ALL SELECT run_id, 'rerun', started_at FROM r WHERE run_id % 2 = 0) SELECT run_id, status, started_at, started_at::DATE AS day, row_number() OVER (PARTITION BY started_at::DATE ORDER BY started_at DESC, run_id) AS ordinal FROM m")
def sorted_evidence_manifest(spark, d):
    r = C.tool_runs(spark, d).select("run_id", "status", "started_at")
    return stores.sorted_manifest(r.where("run_id % 3 <> 1"), r.where("run_id % 2 = 0").withColumn("status", F.lit("rerun")), "run_id", "started_at")


@C.query("""WITH r AS (SELECT event_id AS run_id, CASE WHEN event_type = 'error' THEN 'failed' ELSE 'passed' END AS status FROM events) SELECT run_id, '{"schemaVersion":1,"runId":' || run_id || ',"status":"' || status || '","digest":"' || sha256(run_id || '|' || status) || '"}' AS document FROM r""")
def attestations(spark, d):
    return stores.attestation(C.tool_runs(spark, d))


@C.query(f"""WITH {C.POLICY}, s AS (SELECT count(*) AS n, count(*) FILTER (severity = 'error') AS errors, count(*) FILTER (severity = 'warning') AS warnings FROM a) SELECT errors = 0 AS ok, n, errors, warnings, '{{"ok":' || CASE WHEN errors = 0 THEN 'true' ELSE 'false' END || ',"n":' || n || ',"errors":' || errors || ',"warnings":' || warnings || '}}' AS document FROM s""")
def json_report(spark, d):
    return stores.report(C.applied(spark, d))


@C.query("WITH c AS (SELECT 'src/' || (event_id // 97) AS path, user_id FROM events) SELECT path, count(DISTINCT user_id) AS writers, count(*) AS claims FROM c GROUP BY 1")
def read_index(spark, d):
    path = F.concat(F.lit("src/"), F.floor(F.col("event_id") / 97).cast("string"))
    return stores.read_index(C.table(spark, d, "events").select(path.alias("path"), F.col("user_id").alias("writer")))


@C.query(f"WITH {C.FILES}, b AS (SELECT rel, 'second' AS origin FROM f WHERE doc_id % 3 <> 1), a AS (SELECT rel, 'first' AS origin FROM f WHERE doc_id % 2 = 0) SELECT * FROM a UNION ALL SELECT * FROM b WHERE rel NOT IN (SELECT rel FROM a WHERE rel IS NOT NULL)")
def collected_files(spark, d):
    f = C.files(spark, d).where("rel IS NOT NULL")
    return stores.collected(f.where("doc_id % 2 = 0").select("rel", F.lit("first").alias("origin")), f.where("doc_id % 3 <> 1").select("rel", F.lit("second").alias("origin")))


@C.query(f"WITH {C.PATHS}, r AS (SELECT DISTINCT split_part(path, '/', 1) || '/' || split_part(path, '/', 2) AS root FROM pq WHERE page_id % 7 = 0) SELECT page_id, path AS rel FROM pq WHERE EXISTS (SELECT 1 FROM r WHERE path = root OR starts_with(path, root || '/'))")
def files_below_roots(spark, d):
    p = C.page_paths(spark, d).withColumnRenamed("path", "rel")
    roots = p.where("page_id % 7 = 0").select(F.array_join(F.slice(F.split("rel", "/"), 1, 2), "/").alias("root"))
    return stores.below(p, roots)


@C.query(f"WITH {C.FILES} SELECT rel FROM f WHERE rel IS NOT NULL AND ['A', 'D', 'M', 'R100', 'T'][doc_id % 5 + 1][1] IN ('A', 'C', 'M', 'R')")
def changed_files(spark, d):
    f = C.files(spark, d).where("rel IS NOT NULL")
    changes = f.select("rel", A._pick(("A", "D", "M", "R100", "T"), F.col("doc_id")).alias("kind"))
    return stores.changed_files(f.select("rel"), changes)


@C.query("""WITH f AS (SELECT 'c' || l_suppkey || '/src/' || l_partkey || '.rs' AS rel, l_suppkey FROM lineitem) SELECT rel, count(*) AS n FROM f WHERE l_suppkey = 3 GROUP BY 1""")
def package_scope(spark, d):
    l = C.table(spark, d, "lineitem")
    crate = F.concat(F.lit("c"), F.col("l_suppkey").cast("string"))
    files = l.select(F.concat(crate, F.lit("/src/"), F.col("l_partkey").cast("string"), F.lit(".rs")).alias("rel"))
    text = F.concat(F.lit('[package]\nversion = "1"\nname = "crate-'), F.col("l_suppkey").cast("string"), F.lit('"\n[dependencies]\nname = "x"\n'))
    manifests = l.select(F.concat(crate, F.lit("/Cargo.toml")).alias("rel"), text.alias("text")).distinct()
    return stores.package_scope(files, manifests, "crate-3").groupBy("rel").agg(F.count("*").alias("n"))


@C.query("SELECT l_orderkey % 100 AS k FROM lineitem UNION SELECT o_orderkey % 130 FROM orders")
def union_distinct(spark, d):
    return C.table(spark, d, "lineitem").select((F.col("l_orderkey") % 100).alias("k")).union(C.table(spark, d, "orders").select(F.col("o_orderkey") % 130)).distinct()


@C.query("SELECT l_partkey AS k FROM lineitem WHERE l_quantity > 40 INTERSECT SELECT p_partkey FROM part WHERE p_size < 20")
def intersection(spark, d):
    return C.table(spark, d, "lineitem").where("l_quantity > 40").select(F.col("l_partkey").alias("k")).intersect(C.table(spark, d, "part").where("p_size < 20").select("p_partkey"))


@C.query("SELECT source, count(*) AS n, count(DISTINCT lang) AS n_langs, array_to_string(list_sort(list(doc_id::VARCHAR))[1:20], ',') AS sample FROM documents GROUP BY 1")
def sample_files(spark, d):
    from lumenfold.operators import runs

    f = C.table(spark, d, "documents").select("source", "lang", F.col("doc_id").cast("string").alias("rel"), F.lit(0).alias("zero"))
    first = runs.newest_per(f, ["source"], 20, "zero", "rel").groupBy("source").agg(F.array_join(F.array_sort(F.collect_list("rel")), ",").alias("sample"))
    langs = f.groupBy("source", "lang").agg(F.count("*").alias("c")).groupBy("source").agg(F.sum("c").alias("n"), F.count("lang").alias("n_langs"))
    return langs.join(first, "source")
