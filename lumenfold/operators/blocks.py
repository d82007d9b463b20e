"""Spans of blocks in files: by braces, by indentation, and of test functions.

Each is one fold over a file's array of lines, with a stack of the blocks that are open: a block ends at the first line
whose depth or indentation is no greater than at its start, the next smaller value. The stack is as deep as blocks nest,
so the work follows the number of lines; ended blocks are kept in chunks, so that none is copied once for each later one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHUNK = 256
_SPAN = "array<struct<start:int,end:int>>"
# What a test function looks like, and what ends the one before.
TEST_DEF = r"^\s*def\s+(test_[A-Za-z_]\w*)\s*\([^)]*\)\s*(?:->\s*[^:]+)?\s*:"
NEXT_TEST = r"^\s*def\s+test_"


def _none(kind: str) -> Column:
    return F.array().cast(kind)


def _chunked(acc, more: Column, kind: str) -> tuple[Column, Column]:
    """(full, out) of acc with `more` added: a full chunk is put away before."""
    full = F.size(acc["out"]) >= CHUNK
    return F.when(full, F.concat(acc["full"], F.array(acc["out"]))).otherwise(acc["full"]), F.when(full, more).otherwise(F.concat(acc["out"], more)).cast(kind)


def _all(acc, rest: Column) -> Column:
    return F.concat(F.flatten(acc["full"]), acc["out"], rest)


def _spans(files: DataFrame, spans: Column) -> DataFrame:
    rows = files.where(F.col("text").isNotNull()).select("rel", F.split("text", r"\r?\n", -1).alias("lines"))
    return rows.select("rel", F.inline(spans)).select("rel", F.col("start").cast("long").alias("line_no"), F.col("end").cast("long").alias("end_line"))


def _count(line: Column, char: str) -> Column:
    return F.length(line) - F.length(F.replace(line, F.lit(char), F.lit("")))


def brace_spans(files: DataFrame, start: str) -> DataFrame:
    """(rel, line_no, end_line) of the blocks that start at a line of files(rel, text) matching `start`.

    A block ends at the first line, from its first opening brace on, after which no more braces are open than before
    it; braces in strings and comments count. A block that never ends, or has no brace, is its first line alone.
    """
    entry = "array<struct<line:int,base:int>>"
    lines = F.transform("lines", lambda x: F.struct(x.rlike(start).alias("start"), _count(x, "{").alias("opens"), _count(x, "}").alias("closes")))
    first = F.struct(F.lit(0).alias("at"), F.lit(0).alias("depth"), _none(entry).alias("waiting"), _none(entry).alias("open"), _none(f"array<{_SPAN}>").alias("full"), _none(_SPAN).alias("out"))

    def step(acc, x):
        at, depth, opens = acc["at"] + 1, acc["depth"] + x["opens"] - x["closes"], x["opens"] > 0
        waiting = F.when(x["start"], F.concat(acc["waiting"], F.array(F.struct(at.alias("line"), acc["depth"].alias("base"))))).otherwise(acc["waiting"])
        held = F.when(opens, F.concat(acc["open"], waiting)).otherwise(acc["open"])
        ended = F.transform(F.filter(held, lambda e: e["base"] >= depth), lambda e: F.struct(e["line"].alias("start"), at.alias("end")))
        full, out = _chunked(acc, ended, _SPAN)
        return F.struct(at.alias("at"), depth.alias("depth"), F.when(opens, _none(entry)).otherwise(waiting).alias("waiting"), F.filter(held, lambda e: e["base"] < depth).alias("open"), full.alias("full"), out.alias("out"))

    def finish(acc):
        return _all(acc, F.transform(F.concat(acc["open"], acc["waiting"]), lambda e: F.struct(e["line"].alias("start"), e["line"].alias("end"))))

    return _spans(files, F.aggregate(lines, first, step, finish))


def dedent_spans(files: DataFrame, start: str) -> DataFrame:
    """(rel, line_no, end_line) of the indented blocks that start at a line of files(rel, text) matching `start`.

    A block goes on to the line before the first one that is indented no more than its start; blank lines and lines
    that are comments end nothing. A tab is one character of indentation, as is a blank.
    """
    entry = "array<struct<line:int,indent:int>>"
    lines = F.transform("lines", lambda x: F.struct((x.rlike(start)).alias("start"), F.when(~x.rlike(r"^\s*(?:#|\z)"), F.length(F.regexp_extract(x, r"^(\s*)", 1))).alias("indent"), F.length(F.regexp_extract(x, r"^(\s*)", 1)).alias("own")))
    first = F.struct(F.lit(0).alias("at"), _none(entry).alias("open"), _none(f"array<{_SPAN}>").alias("full"), _none(_SPAN).alias("out"))

    def step(acc, x):
        at = acc["at"] + 1
        ends = lambda e: x["indent"].isNotNull() & (e["indent"] >= x["indent"])
        ended = F.transform(F.filter(acc["open"], ends), lambda e: F.struct(e["line"].alias("start"), acc["at"].alias("end")))
        held = F.filter(acc["open"], lambda e: ~ends(e))
        full, out = _chunked(acc, ended, _SPAN)
        return F.struct(at.alias("at"), F.when(x["start"], F.concat(held, F.array(F.struct(at.alias("line"), x["own"].alias("indent"))))).otherwise(held).alias("open"), full.alias("full"), out.alias("out"))

    def finish(acc):
        return _all(acc, F.transform(acc["open"], lambda e: F.struct(e["line"].alias("start"), acc["at"].alias("end"))))

    return _spans(files, F.aggregate(lines, first, step, finish))


def test_blocks(files: DataFrame) -> DataFrame:
    """(rel, line_no, name, statements, passes, asserts) of the test functions of Python files(rel, text).

    A body goes on to the next test or to a line that isn't indented; blank lines and comments are no statements.
    """
    kind = "array<struct<line:int,name:string,statements:int,passes:int,asserts:int>>"
    one = kind[6:-1]
    first = F.struct(F.lit(0).alias("at"), F.lit(None).cast(one).alias("now"), _none(f"array<{kind}>").alias("full"), _none(kind).alias("out"))

    def step(acc, x):
        at, trimmed, now = acc["at"] + 1, F.regexp_replace(x, r"^\s+|\s+$", ""), acc["now"]
        ends = x.rlike(NEXT_TEST) | x.rlike(r"^\S")
        counts = lambda c: c.cast("int")
        inside = F.when((trimmed == "") | trimmed.startswith("#"), now).otherwise(
            F.struct(now["line"].alias("line"), now["name"].alias("name"), (now["statements"] + 1).alias("statements"), (now["passes"] + counts(trimmed == "pass")).alias("passes"), (now["asserts"] + counts(x.rlike(r"^\s*assert(?![A-Za-z0-9_])"))).alias("asserts"))
        )
        begun = F.struct(at.alias("line"), F.regexp_extract(x, TEST_DEF, 1).alias("name"), F.lit(0).alias("statements"), F.lit(0).alias("passes"), F.lit(0).alias("asserts"))
        after = F.when(x.rlike(TEST_DEF), begun).when(ends | now.isNull(), F.lit(None).cast(one)).otherwise(inside)
        full, out = _chunked(acc, F.when(ends & now.isNotNull(), F.array(now)).otherwise(_none(kind)), kind)
        return F.struct(at.alias("at"), after.cast(one).alias("now"), full.alias("full"), out.alias("out"))

    def finish(acc):
        return _all(acc, F.when(acc["now"].isNotNull(), F.array(acc["now"])).otherwise(_none(kind)))

    rows = files.where(F.col("text").isNotNull()).select("rel", F.inline(F.aggregate(F.split("text", r"\r?\n", -1), first, step, finish)))
    return rows.select("rel", F.col("line").cast("long").alias("line_no"), "name", "statements", "passes", "asserts")


def test_findings(files: DataFrame) -> DataFrame:
    """(rule_id, rel, line_no, detail): tests without a statement but `pass`, and tests that assert nothing."""
    empty = F.col("statements") == F.col("passes")
    found = test_blocks(files).withColumn("rule_id", F.when(empty, "PY-6.3").when(F.col("asserts") == 0, "PY-6.4")).where("rule_id IS NOT NULL")
    return found.select("rule_id", "rel", "line_no", F.when(empty, F.format_string("empty Python test %s found.", "name")).otherwise(F.format_string("Python test %s has no assertion.", "name")).alias("detail"))


def test_file_gaps(files: DataFrame) -> DataFrame:
    """(rule_id, rel): test files(rel, text) whose name promises cases that their text doesn't have."""
    def lacks(name: str, words: str) -> Column:
        return F.col("rel").rlike(f"(?i)(?:{name})") & ~F.col("text").rlike(words)

    word = r"(?<![A-Za-z0-9_])(?:%s)(?![A-Za-z0-9_])"
    gaps = {
        "PY-6.8": lacks("validator|parser|decoder|normalizer", "(?i)" + word % r"invalid|malformed|bad input|reject|raises|pytest\.raises"),
        "PY-6.9": lacks("exception|error|failure|raises", word % r"pytest\.raises"),
        "PY-6.10": lacks("parser|normalizer", r"(?i)(?<![A-Za-z0-9_])hypothesis(?![A-Za-z0-9_])|[A-Za-z0-9_]@given(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])given\s*\((?=[A-Za-z0-9_])"),
    }
    hits = F.array_compact(F.array(*[F.when(c, F.lit(code)) for code, c in gaps.items()]))
    return files.where(F.col("text").isNotNull()).select(F.explode(hits).alias("rule_id"), "rel")
