"""Queries of the rule tables over lines of code that Spark derives from the events table.

A file is 64 events in a row; an event is one line, picked from a table of lines by its id, so that files, lines
and findings grow with the table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.operators import rulebook, rules
from lumenfold.plans import catalog as C

PY_LINES = (
    "except Exception:", "    pass", "# note", "", "print(total)", "    assert total > 0", "value = eval(source)", "subprocess.run(cmd, shell=True)", "os.system(cmd)",
    "data = pickle.loads(raw)", "doc = yaml.load(raw)", "doc = yaml.load(raw, SafeLoader)", "mod = importlib.import_module(name)", "now = datetime.now()", "requests.get(url)",
    "requests.get(url, timeout=3)", "from ..core import thing", "from core.base import *", "home = os.environ[name]", "def f(self, a, b: int) -> int:", "def g(user_id: str, tags=[]):",
    "except:", "class Row(TypedDict):", "limit: Optional[int] = None", "class Model(BaseModel):", "Point = collections.namedtuple(name, fields)", "time.sleep(1)", "async def run(x: int) -> None:",
    "@pytest.mark.skip", "mock.patch(target)", "    x = 2", "asyncio.create_task(run())", "task = asyncio.create_task(run())", "assert True", "    # later", "class Base:", '    """Docs."""', "    total += 1", "return total",
)
TS_LINES = (
    "const x: any = 1;", "const y = z as unknown as Row;", "  name!: string;", "type A = Record<string, Row>;", "const m: Map<string, Row> = load();", "export default run;", "export * from './a';",
    "namespace Old {", "export enum Kind {", "const k = process.env.KEY;", "async function f(): Promise<any> {", "run().catch(() => {});", "console.log(x);", "  return null;", "let p: Partial<Row>;",
    "type B = Record<string, unknown>;", "const lib = await import(name);", "new Function(body);", "describe.skip('a', run);", "expect.anything();", "expect(x).toBeTruthy();", "await fetch(url);",
    "", "// note", "/** Docs. */", "const a = 1;", "}", "setTimeout(run, 10);", "// timer: needed", "export function run(): number {", "import { a } from './b';",
)


def code_files(spark: SparkSession, d: str, kind: str) -> DataFrame:
    """files(rel, text) of Python or TypeScript lines."""
    lines, folders, ext = (PY_LINES, ("src/app", "src/tests", "src/config", "tools"), "py") if kind == "py" else (TS_LINES, ("src/app", "src/__tests__", "src/generated", "src/env"), "ts")
    e = C.table(spark, d, "events").select("event_id", F.floor(F.col("event_id") / 64).alias("file"))
    line = F.element_at(F.array(*map(F.lit, lines)), ((F.col("event_id") + F.floor(F.col("event_id") / 11) + F.col("file")) % len(lines) + 1).cast("int"))
    folder = F.element_at(F.array(*map(F.lit, folders)), (F.col("file") % len(folders) + 1).cast("int"))
    name = F.when(F.col("file") % 5 == 0, "index").otherwise(F.concat(F.lit("m"), F.col("file").cast("string")))
    rel = F.concat(folder, F.lit("/p"), F.col("file").cast("string"), F.lit("/"), name, F.lit("." + ext))
    rows = e.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("event_id", line.alias("line")))).alias("x"))  # 64 lines at most
    return rows.select(rel.alias("rel"), F.array_join(F.transform("x", lambda r: r["line"]), "\n").alias("text"))


def _quoted(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def _code(kind: str) -> str:
    lines, folders, ext = (PY_LINES, ("src/app", "src/tests", "src/config", "tools"), "py") if kind == "py" else (TS_LINES, ("src/app", "src/__tests__", "src/generated", "src/env"), "ts")
    return f"""e0 AS (SELECT event_id, event_id // 64 AS file FROM events),
cl AS (SELECT {_quoted(folders)}[file % {len(folders)} + 1] || '/p' || file || '/' || CASE WHEN file % 5 = 0 THEN 'index' ELSE 'm' || file END || '.{ext}' AS rel,
row_number() OVER (PARTITION BY file ORDER BY event_id) AS line_no, {_quoted(lines)}[(event_id + event_id // 11 + file) % {len(lines)} + 1] AS line FROM e0)"""


PY, TS = _code("py"), _code("ts")
_CLASS = {name: f"regexp_matches(rel, '{p}')" for name, p in rulebook.PATH_CLASSES.items()}
_TEST = f"({_CLASS['is_test']} OR {_CLASS['is_python_test']})"
_GUARDS = {
    None: "true", "production": f"NOT {_TEST}", "test": _TEST, "outside_config": f"NOT {_CLASS['is_config']} AND NOT {_CLASS['is_generated']}",
    "hand_written": f"NOT {_CLASS['is_generated']}", "index": f"{_CLASS['is_index']} AND NOT {_CLASS['is_generated']}",
}


def _rules_sql(rows: tuple[rulebook.Rule, ...]) -> str:
    q = lambda p: p.replace("'", "''")
    unless = lambda r: f" AND NOT regexp_matches(line, '{q(r.unless)}')" if r.unless else ""
    return " UNION ALL ".join(f"SELECT '{r.rule_id}' AS rule_id, rel, line_no, '{q(r.detail)}' AS detail FROM cl WHERE regexp_matches(line, '{q(r.pattern)}'){unless(r)} AND {_GUARDS[r.guard]}" for r in rows)


@C.query(f"WITH {PY} {_rules_sql(rulebook.PYTHON_RULES)}")
def python_rule_findings(spark, d):
    return rulebook.rule_findings(code_files(spark, d, "py"), rulebook.PYTHON_RULES)


@C.query(f"WITH {TS} {_rules_sql(rulebook.TYPESCRIPT_RULES)}")
def typescript_rule_findings(spark, d):
    return rulebook.rule_findings(code_files(spark, d, "ts"), rulebook.TYPESCRIPT_RULES)


@C.query(f"WITH {PY}, {TS.replace('e0 AS', 'e1 AS').replace('FROM e0', 'FROM e1').replace('cl AS', 'ct AS')}, u AS (SELECT 'python' AS scanner, rule_id, rel FROM ({_rules_sql(rulebook.PYTHON_RULES)}) UNION ALL SELECT 'typescript', rule_id, rel FROM ({_rules_sql(rulebook.TYPESCRIPT_RULES).replace('FROM cl', 'FROM ct')})) SELECT scanner, rule_id, count(*) AS n, count(DISTINCT rel) AS n_files FROM u GROUP BY ALL")
def scan_driver_summary(spark, d):
    both = python_rule_findings(spark, d).withColumn("scanner", F.lit("python")).unionByName(typescript_rule_findings(spark, d).withColumn("scanner", F.lit("typescript")))
    per = both.groupBy("scanner", "rule_id", "rel").agg(F.count("*").alias("c"))
    return per.groupBy("scanner", "rule_id").agg(F.sum("c").alias("n"), F.count("*").alias("n_files"))


@C.query(f"WITH {PY}, f AS (SELECT DISTINCT rel FROM cl) SELECT rel, " + ", ".join(f"{p} AS {n}" for n, p in _CLASS.items()) + " FROM f")
def path_classes(spark, d):
    return rulebook.with_path_classes(code_files(spark, d, "py").select("rel"))


_EXCEPT = r"^\s*except(?:\s+Exception\s*(?:as\s+\w+)?)?\s*:"


@C.query(f"""WITH {PY}, g AS (SELECT *, first_value(CASE WHEN NOT regexp_matches(line, '^\\s*(#|$)') THEN line END IGNORE NULLS) OVER (PARTITION BY rel ORDER BY line_no ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING) AS after FROM cl)
SELECT rel, line_no + 1 AS line_no, after AS line FROM g WHERE regexp_matches(line, '{_EXCEPT}') AND regexp_matches(after, '^\\s*pass\\s*(?:#.*)?$')""")
def except_followed_by_pass(spark, d):
    """Handlers that swallow what they catch, told at the line after the handler."""
    found = rulebook.followed_by(code_files(spark, d, "py"), _EXCEPT, r"^\s*pass\s*(?:#.*)?$")
    return found.select("rel", (F.col("line_no") + 1).alias("line_no"), F.col("after").alias("line"))


@C.query(f"""WITH {PY}, g AS (SELECT *, bool_or(regexp_matches(line, 'async\\s+def')) OVER (PARTITION BY rel ORDER BY line_no ROWS BETWEEN 12 PRECEDING AND CURRENT ROW) AS inside, {_TEST} AS test FROM cl)
SELECT CASE WHEN test THEN 'PY-6.7' ELSE 'PY-4.24' END AS rule_id, rel, line_no, line FROM g WHERE regexp_matches(line, '\\b(?:time[.]sleep|asyncio[.]sleep)\\s*\\(') AND (test OR inside)""")
def sleep_findings(spark, d):
    return rulebook.sleeps(code_files(spark, d, "py"))


@C.query(f"WITH {TS}, g AS (SELECT *, bool_or(contains(line, 'timer:')) OVER (PARTITION BY rel ORDER BY line_no ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS guarded FROM cl) SELECT rel, line_no, line FROM g WHERE regexp_matches(line, '\\b(?:setTimeout|setInterval)\\s*\\(') AND NOT guarded")
def timer_without_reason(spark, d):
    return rulebook.unguarded(code_files(spark, d, "ts"), r"\b(?:setTimeout|setInterval)\s*\(", "timer:", 4)


@C.query(f"""WITH {TS}, g AS (SELECT rel, line_no, line, last_value(nullif(trim(line), '') IGNORE NULLS) OVER (PARTITION BY rel ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before,
first_value(nullif(trim(line), '') IGNORE NULLS) OVER (PARTITION BY rel ORDER BY line_no ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS after FROM cl) SELECT rel, line_no, before, after FROM g WHERE regexp_matches(line, '^export function')""")
def exported_with_neighbours(spark, d):
    return rulebook.nearest_filled(code_files(spark, d, "ts"), "^export function")


@C.query(f"""WITH {TS}, g AS (SELECT rel, line_no, line, last_value(nullif(trim(line), '') IGNORE NULLS) OVER (PARTITION BY rel ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM cl)
SELECT rel, line_no FROM g WHERE regexp_matches(line, '^export (?:function|enum|default)') AND NOT coalesce(starts_with(before, '/**') OR ends_with(before, '*/'), false)""")
def exported_without_comment(spark, d):
    rows = rulebook.nearest_filled(code_files(spark, d, "ts"), "^export (?:function|enum|default)")
    return rows.where(~rulebook.documented_before(F.col("before"))).select("rel", "line_no")


@C.query(f"""WITH {PY}, g AS (SELECT rel, line_no, line, first_value(nullif(trim(line), '') IGNORE NULLS) OVER (PARTITION BY rel ORDER BY line_no ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS after FROM cl)
SELECT rel, line_no FROM g WHERE regexp_matches(line, '^(?:async\\s+)?def\\s+[A-Za-z_]\\w*\\s*\\(|^class\\s+[A-Za-z_]\\w*') AND NOT coalesce(left(after, 3) IN (repeat(chr(34), 3), repeat(chr(39), 3)), false)""")
def python_without_docstring(spark, d):
    return rulebook.without_docstring(code_files(spark, d, "py"))


@C.query(f"""WITH {PY}, h AS (SELECT rel, line_no, regexp_extract(line, '^\\s*(?:async\\s+)?def\\s+([A-Za-z_]\\w*)\\s*\\(([^)]*)\\)\\s*(?:->\\s*([^:]+))?:', ['n', 'p', 'r']) AS x FROM cl WHERE NOT {_TEST} AND regexp_matches(line, '^\\s*(?:async\\s+)?def\\s+([A-Za-z_]\\w*)\\s*\\(([^)]*)\\)\\s*(?:->\\s*([^:]+))?:')),
m AS (SELECT rel, line_no, len(list_filter(list_transform(string_split(x.p, ','), lambda p: trim(p)), lambda p: p <> '' AND NOT regexp_matches(p, '^(?:self|cls)(?:\\s|$)') AND NOT contains(p, ':'))) > 0 AS missing_param, x.r = '' AS missing_return FROM h)
SELECT * FROM m WHERE missing_param OR missing_return""")
def untyped_functions(spark, d):
    return rulebook.untyped_functions(code_files(spark, d, "py"))


_PAIR = r"except[^\n]*:\n+ *(?:#[^\n]*\n)*"


@C.query(f"""WITH {PY}, t AS (SELECT rel, string_agg(line, chr(10) ORDER BY line_no) AS text FROM cl GROUP BY rel), m AS (SELECT rel, text, regexp_extract_all(text, '{_PAIR}') AS ms, string_split_regex(text, '{_PAIR}') AS gaps FROM t),
u AS (SELECT rel, unnest(range(1, len(ms) + 1)) AS k, ms, gaps FROM m) SELECT rel, 1 + len(s) - len(replace(s, chr(10), '')) AS line_no, ms[k] AS match FROM (SELECT rel, k, ms, array_to_string(gaps[1:k], '') || coalesce(array_to_string(ms[1:k-1], ''), '') AS s FROM u)""")
def multi_line_handlers(spark, d):
    return rulebook.multi_line_matches(code_files(spark, d, "py"), _PAIR)


_SPECS = (("HAR-2.2", "os.system", "eval"), ("HAR-2.3", "asyncio", "SafeLoader"), ("HAR-2.4", "class Base", "namedtuple"))


@C.query(f"WITH {PY}, t AS (SELECT rel, string_agg(line, chr(10) ORDER BY line_no) AS text FROM cl GROUP BY rel), s AS (" + " UNION ALL ".join(f"SELECT '{i}' AS rule_id, rel || CASE WHEN length(rel) % 7 = 0 THEN '.gone' ELSE '' END AS rel, ['{a}', '{b}'] AS patterns FROM t" for i, a, b in _SPECS) + """),
j AS (SELECT s.rule_id, s.rel, array_to_string(list_filter(s.patterns, lambda p: NOT coalesce(contains(t.text, p), false)), ',') AS missing FROM s LEFT JOIN t ON s.rel = t.rel) SELECT * FROM j WHERE missing <> ''""")
def required_markers(spark, d):
    f = code_files(spark, d, "py")
    rel = F.concat("rel", F.when(F.length("rel") % 7 == 0, ".gone").otherwise(""))
    specs = F.explode(F.array(*[F.struct(F.lit(i).alias("rule_id"), F.array(F.lit(a), F.lit(b)).alias("patterns")) for i, a, b in _SPECS]))
    return rulebook.missing_markers(f, f.select(rel.alias("rel"), specs.alias("s")).select("rel", "s.rule_id", "s.patterns"))


@C.query(f"WITH {PY}, m AS (SELECT rel, min(line_no) FILTER (regexp_matches(line, '^class')) AS first_at, bool_or(contains(line, 'SafeLoader')) AS has FROM cl GROUP BY rel) SELECT rel, coalesce(first_at, 1) AS line_no FROM m WHERE NOT has")
def marker_missing_in_file(spark, d):
    return rules.missing_marker(code_files(spark, d, "py"), "SafeLoader", "^class")
