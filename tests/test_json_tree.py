"""JSON leaves against Python's parser."""

import json

from pyspark.sql import functions as F

from lumenfold.operators import json_tree

TEXTS = [
    '{"a": "b", "c": [1, "two", {"d": null, "e\\"f": "x: {\\"y\\": 1}"}], "g": true, "h": {}, "i": [], "j": 1.5}', '"lone"', "7", "null", "[]", "[[[[[\"deep\"]]]]]", '{"k": "a\\\\"}', "é", '{"ü": "日本"}', "{", "", '{"a": 1, "a": 2}', '["{", "]]]", "\\"["]',
]


def plain(value, path="$"):
    if isinstance(value, dict) and value:
        for k, v in value.items():
            yield from plain(v, f"{path}.{k}")
    elif isinstance(value, list) and value:
        for k, v in enumerate(value):
            yield from plain(v, f"{path}[{k}]")
    else:
        kind = {dict: "object", list: "array", bool: "boolean", str: "string", type(None): "null"}.get(type(value), "number")
        yield path, kind, value if isinstance(value, str) else None if value is None else json.dumps(value)


def test_leaves(spark):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)] + [(99, None)], "id int, t string")
    want = set()
    for i, t in enumerate(TEXTS):
        try:
            value = json.loads(t, object_pairs_hook=lambda pairs: dict(pairs) if len(dict(pairs)) == len(pairs) else 1 / 0)
        except (ValueError, ZeroDivisionError):
            want.add((i, "$", "malformed", t))
        else:
            want |= {(i, *leaf) for leaf in plain(value)}
    assert {tuple(r) for r in json_tree.leaves(rows, "t", ["id"]).collect()} == want
    assert json_tree.leaves(rows.limit(0), "t", ["id"]).collect() == []
    assert {(r.id, r.value) for r in json_tree.strings(rows, "t", ["id"]).collect() if r.id < 2} == {(0, "b"), (0, "two"), (0, 'x: {"y": 1}'), (1, "lone")}


def test_depth_and_paths(spark):
    rows = spark.createDataFrame([(t,) for t in TEXTS if t], "t string")
    assert [r[0] for r in rows.select(json_tree.depth(F.col("t"))).collect()] == [3, 0, 0, 0, 1, 5, 1, 0, 1, 1, 1, 1]
    got = spark.createDataFrame([(TEXTS[0],), ("{",), (None,)], "t string").select(json_tree.at_path(F.col("t"), "$.c[1]"), json_tree.at_path(F.col("t"), "$.c[2].d"), json_tree.at_path(F.col("t"), "$.h"), json_tree.at_path(F.col("t"), "$.none.x")).collect()
    assert [tuple(r) for r in got] == [("two", None, "{}", None), (None,) * 4, (None,) * 4]


def test_export_targets(spark):
    packages = [("a", json.dumps({"exports": {".": {"import": "./dist/a.mjs", "types": "./dist/a.d.ts"}, "./b": ["./b.js", {"x": {"y": "./b.js"}}], "./no": "pkg"}, "main": "./main.js"})), ("b", json.dumps({"exports": "./only.js"})), ("c", "{}"), ("d", "broken"), ("e", None)]
    got = {tuple(r) for r in json_tree.export_targets(spark.createDataFrame(packages, "package string, text string")).collect()}
    assert got == {("a", "dist/a.mjs"), ("a", "dist/a.d.ts"), ("a", "b.js"), ("b", "only.js")}
