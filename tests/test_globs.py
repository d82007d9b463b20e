"""The glob index and waivers against each glob on each path."""

import re

import pytest
from pyspark.sql import functions as F

from lumenfold.operators import globs, policy

GLOBS = ["src/**", "src/*.ts", "**/*.test.ts", "**/package.json", "a.b", "*", "**", "*/x/*", "src/lib", "src/l?b/*", "**/x", "s*/**", "src/**/deep.ts", "no.end.", "d[1].ts", "**/.env", "*.t(s)", "src/lib/**", "", "a/**b"]
PATHS = ["src", "src/a.ts", "src/lib", "src/lib/a.ts", "src/lab/q", "x/x/x", "a.b", "axb", "package.json", "p/package.json", "q/a.test.ts", "src/u/v/deep.ts", "s*/k", "d[1].ts", ".env", "e/.env", "m.t(s)", "src/lib/x", "a//b", "é/x", "", "a/bb"]


def plain(glob, path, dialect):
    if dialect == globs.SCOPE and glob.endswith("/**"):
        return path == glob[:-3] or path.startswith(glob[:-2])
    parts = re.split(r"(\*\*|\*|\?)", glob)
    words = {"**": ".*", "*": "[^/]*", "?": "[^/]" if dialect == globs.PLAIN else r"\?"}
    return re.fullmatch("".join(words.get(p, re.escape(p)) for p in parts), path) is not None


@pytest.mark.parametrize("dialect", [globs.PLAIN, globs.SCOPE])
def test_every_glob_on_every_path(spark, dialect):
    p = spark.createDataFrame([("r", x) for x in PATHS * 2] + [("r", None), (None, "src")], "rule string, rel string")
    g = spark.createDataFrame([("r", i, x) for i, x in enumerate(GLOBS)] + [("other", 99, "src"), ("r", 100, None)], "rule string, ordinal int, glob string")
    found = [tuple(r) for r in globs.matches(p, g, ["rule"], dialect=dialect).collect()]
    assert len(found) == len(set(found))
    assert set(found) == {("r", x, i) for x in PATHS for i, y in enumerate(GLOBS) if plain(y, x, dialect)}


def test_first_and_last_match(spark):
    p = spark.createDataFrame([(k, x) for k, x in enumerate([*PATHS, "src/a.ts", None])], "id int, rel string")
    g = spark.createDataFrame([(i, x, f"v{i}") for i, x in enumerate(GLOBS)], "ordinal int, glob string, name string")
    got = {r.id: r.name for r in globs.first_match(p, g, [], ["name"]).collect()}
    assert got == {k: next((f"v{i}" for i, y in enumerate(GLOBS) if x is not None and plain(y, x, globs.PLAIN)), None) for k, x in enumerate([*PATHS, "src/a.ts", None])}
    o = spark.createDataFrame([(0, "src/**", "lines", 5), (1, "src/lib/**", "lines", 6), (2, "src/**", "depth", None), (3, "src/*.ts", "depth", 2), (4, "src/lib/*", "lines", 7)], "ordinal int, glob string, key string, value int")
    last = {(r.rel, r.key): r.value for r in globs.last_values(p, o).collect()}
    assert last["src/lib/a.ts", "lines"] == 7 and last["src/a.ts", "lines"] == 5 and last["src/a.ts", "depth"] == 2 and ("src/lib/a.ts", "depth") not in last


def test_ten_thousand_globs_without_a_nested_loop(spark):
    p = spark.range(20_000).select(F.concat(F.lit("d"), (F.col("id") % 500).cast("string"), F.lit("/f"), F.col("id").cast("string"), F.lit(".ts")).alias("rel"))
    g = spark.range(10_000).select(F.col("id").alias("ordinal"), F.when(F.col("id") % 2 == 0, F.concat(F.lit("d"), (F.col("id") / 2 % 500).cast("int").cast("string"), F.lit("/**"))).otherwise(F.concat(F.lit("**/f"), F.col("id").cast("string"), F.lit(".ts"))).alias("glob"), F.col("id").alias("w"))
    matched = globs.matches(p, g.drop("w"), [])
    plan = matched._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    out = globs.first_match(p, g, [], ["w"])
    assert out.count() == 20_000 and out.where("w IS NULL").isEmpty()


def test_equal_globs_and_beginnings_of_names_meet_few_paths(spark, monkeypatch):
    p = spark.range(2000).select(F.concat(F.lit("src/"), F.col("id").cast("string"), F.lit(".ts")).alias("rel"))
    g = spark.range(2000).selectExpr("id AS ordinal", "CASE id % 3 WHEN 0 THEN 'src/' || id || '.*' WHEN 1 THEN '*/' || id || '*.ts' ELSE 'src/**' END AS glob", "id AS value", "'k' AS key")
    seen, real = [], globs.matches
    monkeypatch.setattr(globs, "matches", lambda paths, once, *a: seen.append(once.count()) or real(paths, once, *a))
    got = {r.rel: r.value for r in globs.last_values(p, g).collect()}
    assert seen == [667 + 667 + 1] and (got["src/5.ts"], got["src/1999.ts"]) == (1997, 1999)
    _, anchored = globs.anchor(F.col("glob"))
    keys = g.where("glob <> 'src/**'").select(anchored.alias("_key")).groupBy("_key").count()
    assert keys.agg(F.max("count")).first()[0] == 1  # no anchor has more than its own glob


W = "ordinal int, rule_id string, waiver_id string, owner string, issue string, reason string, scope array<string>, expires string, ci_allowed boolean, visible boolean"


def waiver(**x):
    base = dict(ordinal=1, rule_id="R-1", waiver_id="W", owner="dana", issue="I", reason="why", scope=["src/a/**"], expires="2030-01-01", ci_allowed=True, visible=True)
    return tuple({**base, **x}.values())


@pytest.mark.parametrize(
    "change, holds",
    [
        ({}, True), ({"expires": "soon"}, False), ({"expires": None}, False), ({"expires": ""}, False), ({"expires": "2030-13-01"}, False), ({"expires": "2030-01-01T00:00:00Z"}, False), ({"expires": "2024-01-31"}, True), ({"expires": "2024-01-30"}, False),
        ({"owner": "codex"}, False), ({"owner": "The AI team"}, False), ({"owner": "agent"}, False), ({"owner": "build agent liaison"}, False), ({"owner": "magenta"}, True), ({"owner": "said"}, True), ({"owner": None}, False),
        ({"scope": ["src/**"]}, False), ({"scope": ["/"]}, False), ({"scope": ["**", "src/a/**"]}, True), ({"scope": ["./src/a/x.ts"]}, True), ({"scope": ["src\\a\\**"]}, True), ({"scope": ["apps/**", None]}, False), ({"scope": None}, False), ({"scope": ["*"]}, False),
        ({"visible": False}, False), ({"visible": None}, True), ({"ci_allowed": None}, True), ({"reason": ""}, False), ({"rule_id": "r-1"}, True), ({"rule_id": None}, False),
    ],
)
def test_one_waiver(spark, change, holds):
    valid = policy.valid_waivers(spark.createDataFrame([waiver(**change)], W), "2024-01-31 12:00:00")
    findings = spark.createDataFrame([(1, "r-1", "src/a/x.ts")], "finding_id int, rule_id string, rel string")
    assert (policy.split_by_waiver(findings, valid).first().waiver_id == "W") == holds


def test_waivers_in_ci_and_by_registry(spark):
    w = spark.createDataFrame([waiver(), waiver(ordinal=2, waiver_id="W2", ci_allowed=False), waiver(ordinal=0, waiver_id="W0", rule_id="R-2"), waiver(waiver_id="W3", rule_id="R-3")], W)
    ids = lambda df: sorted(r.waiver_id for r in df.collect())
    assert ids(policy.valid_waivers(w, "2024-01-31")) == ["W", "W0", "W2", "W3"]
    assert ids(policy.valid_waivers(w, "2024-01-31", in_ci=True)) == ["W", "W0", "W3"]
    registry = spark.createDataFrame([("r-1", "error", "waiver-required", None), ("R-2", "error", None, None), ("R-3", "info", None, True)], "rule_id string, severity string, lock_level string, waivable boolean")
    assert ids(policy.valid_waivers(w, "2024-01-31", registry=registry)) == ["W", "W2", "W3"]


def test_the_star_scope_waives_top_level_files_and_findings_without_a_file(spark):
    valid = policy.valid_waivers(spark.createDataFrame([waiver(scope=["*"])], W), "2024-01-31")
    findings = spark.createDataFrame([(1, "R-1", "top.ts"), (2, "R-1", "src/a.ts"), (3, "R-1", None), (4, None, "top.ts")], "finding_id int, rule_id string, rel string")
    assert {r.finding_id: r.waiver_id for r in policy.split_by_waiver(findings, valid).collect()} == {1: "W", 2: None, 3: "W", 4: None}
