"""Rules over lines and files: patterns, context windows, repetition and shape."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.functions.text import ascii_boundaries

# Id, pattern and detail of the secret rules that look at one line.
SECRET_RULES = (
    ("SEC-2.1", r"\bgh[pousr]_[A-Za-z0-9_]{20,}\b", "GitHub token found."),
    ("SEC-2.2", r"\bAKIA[0-9A-Z]{16}\b", "AWS access key found."),
    ("SEC-2.3", r'"type"\s*:\s*"service_account"|"private_key_id"\s*:', "Google service account JSON marker found."),
    ("SEC-2.4", r"(?i)\bAZURE_(?:CLIENT_SECRET|TENANT_ID|CLIENT_ID)\b\s*[:=]", "Azure credential assignment found."),
    ("SEC-2.5", r"(?i)\bxox[baprs]-[A-Za-z0-9-]{10,}\b|discord(?:app)?\.[A-Za-z0-9_-]{20,}", "Slack or Discord token found."),
    ("SEC-2.6", r"\beyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\b", "JWT-looking token found."),
    ("SEC-2.7", r"-----BEGIN (?:RSA |OPENSSH |EC |DSA |)?PRIVATE KEY-----", "private key block found."),
    ("SEC-2.8", r"\b(?:npm_[A-Za-z0-9]{20,}|pypi-[A-Za-z0-9_-]{20,}|CARGO_REGISTRY_TOKEN\s*=)", "package registry token found."),
    ("SEC-2.9", r"\b(?:sk|pk)_(?:live|test)_[A-Za-z0-9]{20,}\b", "Stripe key found."),
    ("SEC-2.10", r"""(?i)\b(?:secret|token|password|key)\b\s*[:=]\s*["'][A-Za-z0-9+/=_-]{32,}["']""", "high-entropy secret assignment found."),
)


def line_findings(lines: DataFrame, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    """(rule_id, rel, line_no, detail): one row for each line and rule that matches, in one pass over lines."""
    hits = [F.when(F.col("line").rlike(ascii_boundaries(p)), F.struct(F.lit(i).alias("rule_id"), F.lit(d).alias("detail"))) for i, p, d in rules]
    found = lines.select("rel", "line_no", F.array_compact(F.array(*hits)).alias("hits")).where(F.size("hits") > 0)
    return found.select("rel", "line_no", F.explode("hits").alias("hit")).select("hit.rule_id", "rel", "line_no", "hit.detail")


def missing_marker(files: DataFrame, required: str, anchor: str) -> DataFrame:
    """Files without the required pattern; line_no is the first line that matches anchor, else 1."""
    rows = F.filter(F.transform(F.split("text", r"\r?\n", -1), lambda l, i: F.when(l.rlike(anchor), i + 1)), lambda i: i.isNotNull())
    return files.where(~F.col("text").rlike(required)).select("rel", F.coalesce(F.get(rows, F.lit(0)), F.lit(1)).cast("long").alias("line_no"))


def repeated_islands(files: DataFrame, at_least: int = 8, length: int = 20) -> DataFrame:
    """(rel, first_line, run, line): runs of `at_least` equal trimmed lines of `length` characters or more.

    Folded over the array of a file's lines: the state is the run so far and the runs that ended.
    """
    row = "struct<first_line:long,run:long,line:string>"
    lines = F.transform(F.split("text", r"\r?\n", -1), lambda x, i: F.struct((i + 1).cast("long").alias("n"), F.trim(x).alias("t")))
    start = F.struct(F.lit(None).cast(row).alias("now"), F.array().cast(f"array<{row}>").alias("ended"))
    whole = lambda acc: F.when(acc["now"]["run"] >= at_least, F.concat(acc["ended"], F.array(acc["now"]))).otherwise(acc["ended"])

    def step(acc: Column, x: Column) -> Column:
        same = F.coalesce(acc["now"]["line"] == x["t"], F.lit(False))
        new = lambda first, run: F.struct(first.alias("first_line"), run.alias("run"), x["t"].alias("line"))
        now = F.when(same, new(acc["now"]["first_line"], acc["now"]["run"] + 1)).otherwise(new(x["n"], F.lit(1).cast("long")))
        return F.struct(now.alias("now"), F.when(same, acc["ended"]).otherwise(whole(acc)).alias("ended"))

    found = files.where(F.col("text").isNotNull()).select("rel", F.explode(F.aggregate(lines, start, step, whole)).alias("r"))
    return found.select("rel", "r.first_line", "r.run", "r.line").where(F.length("line") >= length)


def first_duplicate(lines: DataFrame, token: Column) -> DataFrame:
    """(rel, line_no, token): in each file, the first line whose token an earlier line has."""
    named = lines.withColumn("token", token).where(F.coalesce("token", F.lit("")) != "")
    again = named.withColumn("k", F.row_number().over(Window.partitionBy("rel", "token").orderBy("line_no"))).where("k = 2")
    return again.groupBy("rel").agg(F.min_by("token", "line_no").alias("token"), F.min("line_no").alias("line_no"))


def nesting_depth(files: DataFrame, open: str = "{", close: str = "}") -> DataFrame:
    """(rel, depth): deepest nesting of a text, its running sum held at 0 from below.

    S minus its running minimum, capped at 0, is the held sum; both are folded over the text's brackets alone.
    """
    marks = F.split(F.regexp_replace("text", f"[^{open}{close}]", ""), "")
    step = F.transform(F.filter(marks, lambda m: m != ""), lambda m: F.when(m == open, 1).otherwise(-1))
    start = F.struct(F.lit(0).alias("held"), F.lit(0).alias("most"))

    def fold(acc: Column, d: Column) -> Column:
        held = F.greatest(acc["held"] + d, F.lit(0))
        return F.struct(held.alias("held"), F.greatest(acc["most"], held).alias("most"))

    return files.select("rel", F.aggregate(step, start, fold, lambda acc: acc["most"]).cast("long").alias("depth"))


def shape_findings(files: DataFrame, limits: dict[str, tuple[Column, int]]) -> DataFrame:
    """(rel, metric, value, most): the measures of a file above their limits, one row each."""
    measures = F.array(*[F.struct(F.lit(k).alias("metric"), v.cast("long").alias("value"), F.lit(most).cast("long").alias("most")) for k, (v, most) in limits.items()])
    return files.select("rel", F.inline(F.filter(measures, lambda m: m["value"] > m["most"])))
