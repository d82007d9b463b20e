"""Queries of block spans over files that Spark makes of events: a user's events are the lines of a file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.operators import blocks
from lumenfold.plans import catalog as C

_INDENT = "repeat(' ', (event_id * 7 // 3 % 4 * 4)::INT)"
_PY = f"""s AS (SELECT user_id, event_id, CASE event_type WHEN 'signup' THEN {_INDENT} || 'def test_u' || event_id || '():' WHEN 'purchase' THEN {_INDENT} || CASE WHEN event_id % 3 = 0 THEN 'assert x' || event_id ELSE 'pass' END
WHEN 'click' THEN CASE WHEN event_id % 4 = 0 THEN '' ELSE {_INDENT} || '# note ' || event_id END WHEN 'error' THEN {_INDENT} || 'class K' || event_id || ':' ELSE {_INDENT} || 'y = ' || props END AS line FROM events),
l AS (SELECT 'pkg/u' || user_id || '.py' AS rel, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n, line FROM s)"""
_TS = """s AS (SELECT user_id, event_id, CASE event_type WHEN 'signup' THEN 'function f' || event_id || '()' || CASE WHEN event_id % 3 > 0 THEN ' {' ELSE '' END WHEN 'purchase' THEN '}' WHEN 'click' THEN 'if (x) {' WHEN 'error' THEN repeat('}', (event_id % 3)::INT) ELSE 'y ' || props END AS line FROM events),
l AS (SELECT 'src/u' || user_id || '.ts' AS rel, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n, line FROM s)"""


def _files(spark: SparkSession, d: str, line: F, rel: tuple[str, str]) -> DataFrame:
    e = C.table(spark, d, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", line.alias("line")))).alias("s"))
    return e.select(F.concat(F.lit(rel[0]), F.col("user_id").cast("string"), F.lit(rel[1])).alias("rel"), F.array_join(F.col("s.line"), "\n").alias("text"))


def python_files(spark: SparkSession, d: str) -> DataFrame:
    i, t = F.col("event_id"), F.col("event_type")
    n, indent = i.cast("string"), F.repeat(F.lit(" "), (F.floor(i * 7 / 3) % 4 * 4).cast("int"))
    line = (
        F.when(t == "signup", F.concat(indent, F.lit("def test_u"), n, F.lit("():"))).when(t == "purchase", F.concat(indent, F.when(i % 3 == 0, F.concat(F.lit("assert x"), n)).otherwise("pass")))
        .when(t == "click", F.when(i % 4 == 0, "").otherwise(F.concat(indent, F.lit("# note "), n))).when(t == "error", F.concat(indent, F.lit("class K"), n, F.lit(":"))).otherwise(F.concat(indent, F.lit("y = "), F.col("props")))
    )
    return _files(spark, d, line, ("pkg/u", ".py"))


def script_files(spark: SparkSession, d: str) -> DataFrame:
    i, t = F.col("event_id"), F.col("event_type")
    line = (
        F.when(t == "signup", F.concat(F.lit("function f"), i.cast("string"), F.lit("()"), F.when(i % 3 > 0, " {").otherwise(""))).when(t == "purchase", "}").when(t == "click", "if (x) {")
        .when(t == "error", F.repeat(F.lit("}"), (i % 3).cast("int"))).otherwise(F.concat(F.lit("y "), F.col("props")))
    )
    return _files(spark, d, line, ("src/u", ".ts"))


@C.query(f"""WITH {_PY}, c AS (SELECT rel, n, line, length(line) - length(ltrim(line)) AS w, NOT regexp_matches(line, '^\\s*(#|$)') AS code, max(n) OVER (PARTITION BY rel) AS last FROM l)
SELECT rel, n AS line_no, coalesce((SELECT min(e.n) - 1 FROM c e WHERE e.rel = c.rel AND e.n > c.n AND e.code AND e.w <= c.w), last) AS end_line FROM c WHERE regexp_matches(line, '^\\s*(def|class) ')""")
def indented_block_spans(spark, d):
    return blocks.dedent_spans(python_files(spark, d), r"^\s*(?:def|class) ")


@C.query(f"""WITH {_TS}, c AS (SELECT rel, n, line, length(line) - length(replace(line, '{{', '')) AS o, length(line) - length(replace(line, '}}', '')) AS k FROM l), d AS (SELECT *, coalesce(sum(o - k) OVER w, 0) AS depth FROM c WINDOW w AS (PARTITION BY rel ORDER BY n))
SELECT rel, n AS line_no, coalesce((SELECT min(e.n) FROM d e WHERE e.rel = d.rel AND e.n >= (SELECT min(b.n) FROM d b WHERE b.rel = d.rel AND b.n >= d.n AND b.o > 0) AND e.depth <= d.depth - d.o + d.k), n) AS end_line FROM d WHERE regexp_matches(line, '^(function|if)')""")
def brace_block_spans(spark, d):
    return blocks.brace_spans(script_files(spark, d), "^(?:function|if)")


@C.query(f"""WITH {_PY}, c AS (SELECT *, regexp_matches(line, '^\\s*def test_') AS t, regexp_matches(line, '^\\s*def test_|^\\S') AS stop FROM l), b AS (SELECT *, (SELECT coalesce(min(e.n), 1000000) FROM c e WHERE e.rel = c.rel AND e.n > c.n AND e.stop) AS next FROM c WHERE t),
k AS (SELECT b.rel, b.n, regexp_extract(b.line, 'def (\\w+)', 1) AS name, count(*) FILTER (trim(e.line) <> '' AND NOT starts_with(trim(e.line), '#')) AS st, count(*) FILTER (trim(e.line) = 'pass') AS ps, count(*) FILTER (starts_with(trim(e.line), 'assert ')) AS asr FROM b LEFT JOIN l e ON e.rel = b.rel AND e.n > b.n AND e.n < b.next GROUP BY ALL)
SELECT CASE WHEN st = ps THEN 'PY-6.3' ELSE 'PY-6.4' END AS rule_id, rel, n AS line_no, CASE WHEN st = ps THEN 'empty Python test ' || name || ' found.' ELSE 'Python test ' || name || ' has no assertion.' END AS detail FROM k WHERE st = ps OR asr = 0""")
def test_block_findings(spark, d):
    return blocks.test_findings(python_files(spark, d))
