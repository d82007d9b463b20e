"""Operators on small planted tables, odd rows included."""

import json

from pyspark.sql import functions as F

from lumenfold.functions import text as T
from lumenfold.operators import audits, diagnostics, evidence, ledger, paths, policy, rulebook, rules, runs
from lumenfold.sources import files, stores
from lumenfold.streaming import ownership

OUT = "run_id string, tool string, text string"


def parsed(spark, text):
    rows = diagnostics.parse(spark.createDataFrame([("r", "t", text)], OUT)).collect()
    return sorted((r.severity, r.rule_id, r.file, r.line, r.message) for r in rows)


def test_compiler_messages_once_each(spark):
    m = {"reason": "compiler-message", "message": {"level": "error", "message": "bad", "code": {"code": "E1"}, "spans": [{"file_name": "a.rs", "line_start": 2, "is_primary": False}, {"file_name": "b.rs", "line_start": 9, "is_primary": True}]}}
    line = json.dumps(m)
    bare = json.dumps({"reason": "compiler-message", "message": {"level": "note", "message": "hm", "code": None, "spans": []}})
    got = parsed(spark, f"{line}\n{line}\n{bare}\n{{broken")
    assert ("error", "E1", "b.rs", 9, "bad") in got and ("warning", "rustc", ".", 1, "hm") in got
    assert sum(r[1] == "HAR-2.4" for r in got) == 2 and len(got) == 4


def test_payloads(spark):
    lint = [{"filePath": "a.ts", "messages": [{"ruleId": None, "severity": 2, "message": "m", "line": None}, {"ruleId": "x", "severity": 1, "message": "n", "line": 4}]}]
    assert parsed(spark, json.dumps(lint)) == [("error", "eslint", "a.ts", 1, "m"), ("warning", "x", "a.ts", 4, "n")]
    assert parsed(spark, "[]") == []
    assert parsed(spark, json.dumps([{"filename": "a.py", "code": "E5", "message": "m", "location": {"row": 3}}])) == [("error", "E5", "a.py", 3, "m")]
    types = {"generalDiagnostics": [{"file": "a.py", "severity": "warning", "message": "m", "range": {"start": {"line": 6}}}]}
    assert parsed(spark, json.dumps(types)) == [("warning", "pyright", "a.py", 7, "m")]
    sarif = {"runs": [{"results": [{"ruleId": "S", "level": "note", "message": {"text": "m"}, "locations": [{"physicalLocation": {"artifactLocation": {"uri": "u"}, "region": {"startLine": 5}}}]}, {"ruleId": "S2", "message": {"text": "k"}, "locations": []}]}]}
    assert parsed(spark, json.dumps(sarif)) == [("info", "S", "u", 5, "m"), ("warning", "S2", ".", 1, "k")]
    text = "src/a.ts(3,7): error TS22: no\nFAILED t/x.py::test_a - boom\nother"
    assert parsed(spark, text) == [("error", "TS22", "src/a.ts", 3, "no"), ("error", "pytest", "t/x.py", 1, "boom")]
    assert parsed(spark, None) == [] and parsed(spark, "") == []


def test_text_functions(spark):
    row = spark.range(1).select(
        T.redact(F.lit("k = \"abcdefgh1\" and 'short' café-ghp_" + "a" * 20)).alias("r"), T.repo_path(F.lit(".\\./Src\\A.rs")).alias("p"), T.slice_key(F.lit("apps/web/x")).alias("s1"), T.slice_key(F.lit("apps/")).alias("s2"),
        T.slice_key(F.lit("")).alias("s3"), T.ancestors(F.lit("a/b/c")).alias("a"), T.diagnostic_fingerprint(F.lit("eslint"), F.lit("no-x"), F.lit("a.ts"), F.lit(1), F.lit("m")).alias("f"),
    ).first()
    assert row.r == "k = \"[REDACTED]\" and 'short' café-[REDACTED_GITHUB_TOKEN]" and row.p == "src/a.rs"
    assert (row.s1, row.s2, row.s3) == ("apps/web", "apps", ".") and row.a == ["a", "a/b", "a/b/c"] and len(row.f) == 24


def test_lines_and_shape(spark):
    f = spark.createDataFrame([("a", "x\r\ny\n"), ("b", ""), ("c", None)], "rel string, text string")
    assert sorted(tuple(r) for r in files.lines(f).collect()) == [("a", 1, "x"), ("a", 2, "y"), ("a", 3, ""), ("b", 1, "")]
    nest = spark.createDataFrame([("a", "}}{{}{"), ("b", "none"), ("c", None), ("d", "{{{")], "rel string, text string")
    assert {r.rel: r.depth for r in rules.nesting_depth(nest).collect()} == {"a": 2, "b": 0, "c": None, "d": 3}
    marker = rules.missing_marker(spark.createDataFrame([("a", "1\nfn x"), ("b", "safe"), ("c", "zz")], "rel string, text string"), "safe", "^fn")
    assert {r.rel: r.line_no for r in marker.collect()} == {"a": 2, "c": 1}


def test_files_from_a_folder(spark, tmp_path):
    for p, t in {"a.py": "x", "node_modules/b.py": "y", "src/c.ts": "z"}.items():
        (tmp_path / p).parent.mkdir(exist_ok=True)
        (tmp_path / p).write_text(t)
    assert {(r.rel, r.ext) for r in files.read_files(spark, str(tmp_path)).collect()} == {("a.py", ".py"), ("src/c.ts", ".ts")}
    forced = files.read_files(spark, str(tmp_path), forced="node_modules/")
    assert forced.count() == 3
    status = spark.createDataFrame([(' M a.py',), ('R  old.py -> "src/c.ts"',), ("x",)], "line string")
    assert {r.rel for r in files.only_changed(forced, files.status_paths(status)).collect()} == {"a.py", "src/c.ts"}


def test_policy_and_waivers(spark):
    registry = spark.createDataFrame([("A", "error", False, False), ("B", "warning", True, False), ("C", "info", True, True)], "rule_id string, severity string, can_disable boolean, can_downgrade boolean")
    overrides = spark.createDataFrame([("a", False, "info"), ("b", False, "error"), ("c", True, "error")], "rule_id string, enabled boolean, severity string")
    got = {r.rule_id: (r.enabled, r.severity) for r in policy.effective_policy(registry, overrides).collect()}
    assert got == {"A": (True, None), "B": (False, "error"), "C": (True, "error")}
    paths = ["a", "a/b", "a/b/c", "ab", "x.rs", "xyrs", "d/e.ts"]
    scopes = {"a/**": {"a", "a/b", "a/b/c"}, "a/*": {"a/b"}, "x.rs": {"x.rs"}, "**/*.ts": {"d/e.ts"}, "?": set()}
    df = spark.createDataFrame([(p,) for p in paths], "p string").crossJoin(spark.createDataFrame([(s,) for s in scopes], "s string"))
    hits = {s: set() for s in scopes}
    for r in df.withColumn("pattern", policy.scope_regex(F.col("s"))).where("p RLIKE pattern").collect():
        hits[r.s].add(r.p)
    assert hits == scopes


def test_retention_without_limits(spark):
    rows = [(i, "t", "failed" if i == 0 else "passed", i == 1) for i in range(6)]
    r = spark.createDataFrame(rows, "run_id int, tool string, status string, pinned boolean").withColumn("started_at", F.timestamp_seconds(F.col("run_id") * 86400))
    when = F.timestamp_seconds(F.lit(5 * 86400))
    got = {x.run_id: x.action for x in runs.prune_runs(r, when, 2, 1, 1, None).collect()}
    assert got == {0: "keep", 1: "keep", 2: "delete", 3: "delete", 4: "keep", 5: "keep"}
    assert {x.action for x in runs.prune_runs(r, when, None, None, None, None).collect()} == {"keep"}


def test_ledger_folds(spark):
    e = spark.createDataFrame([("s", 1), ("s", 2), ("s", 5), ("t", 9)], "stream string, seq long")
    assert [tuple(r) for r in ledger.chain_breaks(e).collect()] == [("s", 5, 3)]
    own = [("claim", "w1", "p", 1), ("claim", "w2", "p", 2), ("release", "w1", "p", 3), ("claim", "w1", "q", 1), ("resolve", "x", "q", 2), ("claim", "w2", "q", 3), ("release", "w9", "z", 1)]
    held = ledger.owned(spark.createDataFrame(own, "kind string, writer string, path string, t long"), ["t"])
    assert sorted(tuple(r) for r in held.collect()) == [("w2", "p", 2), ("w2", "q", 3)]


def test_streamed_ownership_equals_the_batch_on_ties_and_on_nothing(spark, tmp_path):
    schema = "event_id long, ts timestamp, kind string, writer string, path string"
    rows = [(1, 5, "resolve", "x", "p"), (2, 5, "claim", "w", "p"), (3, 5, "claim", "w", "q"), (4, 5, "resolve", "x", "q"), (6, 5, "release", "v", "r"), (5, 5, "claim", "v", "r"), (7, 4, "claim", "w", "r")]
    events = spark.createDataFrame([(i, None, k, w, p, t) for i, t, k, w, p in rows], schema + ", t long").withColumn("ts", F.timestamp_seconds("t")).drop("t")
    want = sorted(tuple(r)[:2] for r in ledger.owned(events, ["ts", "event_id"]).collect())
    assert want == [("w", "p"), ("w", "r")]
    events.repartition(3).write.parquet(f"{tmp_path}/events")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/events")
    assert sorted(tuple(r)[:2] for r in ownership.fold_available(stream).collect()) == want
    (tmp_path / "none").mkdir()
    assert ownership.fold_available(spark.readStream.schema(events.schema).parquet(f"{tmp_path}/none")).collect() == []


def test_rules_look_around_lines(spark):
    f = spark.createDataFrame([("a.py", "x\nexcept:\n  # c\n\n  pass\nexcept:"), ("t/tests/b.py", "print(1)"), ("b.py", "print(1)\nassert x"), ("c", None), ("d", "")], "rel string, text string")
    assert [(r.rel, r.line_no, r.after) for r in rulebook.followed_by(f, "^except:", "pass").collect()] == [("a.py", 2, "  pass")]
    assert [(r.rel, r.line_no) for r in rulebook.unguarded(f, "^except:", "x\n", 1).collect()] == [("a.py", 2), ("a.py", 6)]
    near = {(r.rel, r.line_no): (r.before, r.after) for r in rulebook.nearest_filled(f, "^except:").collect()}
    assert near == {("a.py", 2): ("x", "# c"), ("a.py", 6): ("pass", None)}
    found = sorted((r.rule_id, r.rel, r.line_no) for r in rulebook.rule_findings(f, rulebook.PYTHON_RULES).collect())
    assert found == [("PY-4.12", "a.py", 2), ("PY-4.12", "a.py", 6), ("PY-4.14", "b.py", 1), ("PY-4.15", "b.py", 2)]
    m = sorted((r.line_no, r.match) for r in rulebook.multi_line_matches(f, r"except:\n[^\n]*").collect())
    assert m == [(2, "except:\n  # c")]
    same = spark.createDataFrame([("a", "\n".join(["short", "k" * 20, "k" * 20, " " + "k" * 20, "z"])), ("b", None)], "rel string, text string")
    assert [tuple(r) for r in rules.repeated_islands(same, 3).collect()] == [("a", 2, 3, "k" * 20)]


def test_links_and_resolve_forms(spark):
    e = spark.createDataFrame([("s", 1, 1, "a", None, "h1", None), ("s", 2, 2, "b", "a", "h2", "h1"), ("s", 3, 4, "c", "a", "h3", "x")], "stream string, ordinal long, seq long, id string, prev_id string, hash string, prev_hash string")
    assert sorted((r.ordinal, r.code) for r in ledger.link_breaks(e).collect()) == [(3, "previous-hash"), (3, "previous-id"), (3, "sequence")]
    rows = [(1, "claim", "a", "p", None, None), (2, "claim", "b", "p", None, None), (3, "resolve", "x", "p", "a", None), (4, "claim", "c", "p", None, None), (5, "resolve", "x", "p", None, ["c"]), (6, "claim", "d", "q", None, None), (7, "resolve", "x", "q", None, None)]
    events = spark.createDataFrame(rows, "t long, kind string, writer string, path string, owner string, owners array<string>")
    assert [tuple(r) for r in ledger.owned_by_form(events, ["t"]).collect()] == [("a", "p")]


def test_literals_of_any_length(spark):
    c = spark.createDataFrame([(1, "a"), (2, "bc"), (3, "one two"), (4, "one two three"), (5, "one two three four five six seven"), (6, ""), (7, None)], "item_id long, text string")
    f = spark.createDataFrame([("x", "zone two threes bc"), ("y", "one two three four five six seven"), ("z", None), ("w", "")], "rel string, text string")
    got = sorted(tuple(r) for r in evidence.literal_owners(c, f).collect())
    want = sorted((i, rel) for i, t in [(r.item_id, r.text) for r in c.collect()] if t for rel, text in [(r.rel, r.text) for r in f.collect()] if text and t in text)
    assert got == want
    assert evidence.literal_owners(c.limit(0), f).collect() == []


def test_stores_and_scopes(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a", None), (2, None, "x")], "run_id long, status string, storage string")
    stores.write_ndjson(rows, f"file://{tmp_path}/r")
    back = stores.read_ndjson(spark, f"file://{tmp_path}/r", "run_id long, status string, storage string")
    assert sorted(tuple(r) for r in back.collect()) == sorted(tuple(r) for r in rows.collect())
    won = stores.first_root_wins([rows, rows.withColumn("status", F.lit("later")).unionByName(spark.createDataFrame([(3, "c", None)], rows.schema))], "run_id")
    assert sorted((r.run_id, r.status, r.storage) for r in won.collect()) == [(1, "a", "runs"), (2, None, "x"), (3, "c", "runs")]
    assert stores.reset(spark, f"file://{tmp_path}/r") and not stores.reset(spark, f"file://{tmp_path}/r")
    f = spark.createDataFrame([("a/b/c.rs",), ("a/d.rs",), ("ab/c.rs",)], "rel string")
    assert {r.rel for r in stores.below(f, spark.createDataFrame([("a",)], "root string")).collect()} == {"a/b/c.rs", "a/d.rs"}
    m = spark.createDataFrame([("a/b/Cargo.toml", '[package]\nname = "k"\n'), ("ab/Cargo.toml", '[dependencies]\nname = "k"')], "rel string, text string")
    assert [r.rel for r in stores.package_scope(f, m, "k").collect()] == ["a/b/c.rs"]


def test_conflicts_are_counted_and_guarded(spark):
    c = spark.createDataFrame([(1, "a", 1, "m", "p"), (2, "b", 1, "m", "p"), (3, "b", 2, "m", "p"), (4, "c", 2, "n", "p"), (5, "a", 1, "m", "q")], "claim_id long, writer string, worktree int, branch string, path string")
    got = {(r.claim_id, r.kind): r.others for r in paths.conflicts(c).collect()}
    assert got == {(1, "write-lock-conflict"): 1, (1, "branch-write-conflict"): 1, (1, "merge-risk"): 1, (2, "write-lock-conflict"): 1, (2, "merge-risk"): 1, (3, "branch-write-conflict"): 1, (3, "write-lock-conflict"): 1, (4, "write-lock-conflict"): 1, (4, "merge-risk"): 2}
    assert audits.first_existing(spark.createDataFrame([(1, 0, "x"), (1, 1, "y"), (2, 0, "z")], "item_id long, ordinal int, path string"), spark.createDataFrame([("y",)], "rel string")).collect()[0].path == "y"
