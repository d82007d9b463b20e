"""Tool outputs parsed into one diagnostics schema: run_id, tool, severity, rule_id, file, line, message."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import runs

COMPILER = "struct<reason:string,message:struct<level:string,message:string,code:struct<code:string>,spans:array<struct<file_name:string,line_start:long,is_primary:boolean>>>>"
LINTER = "array<struct<filePath:string,messages:array<struct<ruleId:string,severity:int,message:string,line:long>>>>"
CODED = "array<struct<filename:string,code:string,message:string,location:struct<row:long>>>"
TYPE_CHECKER = "struct<generalDiagnostics:array<struct<file:string,severity:string,message:string,range:struct<start:struct<line:long>>>>>"
SARIF = (
    "struct<runs:array<struct<results:array<struct<ruleId:string,level:string,message:struct<text:string>,"
    "locations:array<struct<physicalLocation:struct<artifactLocation:struct<uri:string>,region:struct<startLine:long>>>>>>>>>"
)
MALFORMED = "HAR-2.4"


def _rows(df: DataFrame, severity: Column, rule: Column, file: Column, line: Column, message: Column) -> DataFrame:
    return df.select("run_id", "tool", severity.alias("severity"), rule.alias("rule_id"), F.coalesce(file, F.lit(".")).alias("file"), F.coalesce(line, F.lit(1)).cast("long").alias("line"), F.coalesce(message, F.lit("")).alias("message"), "ordinal")


def is_json(text: Column) -> Column:
    """Whether a text is one JSON value; the parser by itself overlooks what follows the first one."""
    one = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    return one.isNotNull() & F.try_variant_get(one, "$[1]", "variant").isNull()


def output_lines(outputs: DataFrame) -> DataFrame:
    """Lines of outputs(run_id, tool, text), trimmed, without empty ones."""
    rows = outputs.select("run_id", "tool", F.posexplode(F.split("text", r"\r?\n")).alias("ordinal", "line"))
    return rows.withColumn("line", F.trim("line")).where("line <> ''")


def json_lines(outputs: DataFrame) -> DataFrame:
    """Compiler messages of lines that start with `{`, and a warning for each such line that isn't JSON."""
    rows = output_lines(outputs).where(F.startswith("line", F.lit("{"))).withColumn("ok", is_json(F.col("line")))
    m = rows.withColumn("j", F.when(F.col("ok"), F.from_json("line", COMPILER))).where("NOT ok OR (j.reason = 'compiler-message' AND j.message IS NOT NULL)")
    spans = F.coalesce("j.message.spans", F.array().cast("array<struct<file_name:string,line_start:long,is_primary:boolean>>"))
    span = F.coalesce(F.get(F.filter(spans, lambda s: s["is_primary"]), F.lit(0)), F.get(spans, F.lit(0)))
    m, ok = m.withColumn("span", span), F.col("ok")
    rule, message = F.coalesce("j.message.code.code", F.lit("rustc")), F.col("j.message.message")
    return _rows(m, F.when(F.col("j.message.level") == "error", "error").otherwise("warning"), F.when(ok, rule).otherwise(MALFORMED), F.col("span.file_name"), F.col("span.line_start"), F.when(ok, message).otherwise("malformed JSON line"))


def _found(severity: Column, rule: Column, file: Column, line: Column, message: Column, ordinal: Column) -> Column:
    return F.struct(severity.alias("severity"), rule.alias("rule"), file.alias("file"), line.cast("long").alias("line"), message.alias("message"), ordinal.cast("int").alias("ordinal"))


def payloads(outputs: DataFrame) -> DataFrame:
    """Whole texts that are JSON: linter arrays, coded arrays, type-checker objects and SARIF; the first that fits counts.

    One pass: each text is parsed as what its first character lets it be, and gives an array of what it tells.
    """
    t = outputs.withColumn("text", F.trim("text")).where(F.substring("text", 1, 1).isin("{", "["))
    t = t.withColumn("ok", is_json(F.col("text")))
    array = F.col("ok") & F.startswith("text", F.lit("["))
    object_ = F.col("ok") & ~F.startswith("text", F.lit("["))
    parsed = {"lint": (array, LINTER), "coded": (array, CODED), "types": (object_, TYPE_CHECKER), "sarif": (object_, SARIF)}
    t = t.withColumns({name: F.when(when, F.from_json("text", schema)) for name, (when, schema) in parsed.items()})
    lint = F.flatten(F.transform("lint", lambda f: F.transform(f["messages"], lambda m, i: _found(F.when(m["severity"] == 2, "error").otherwise("warning"), F.coalesce(m["ruleId"], F.lit("eslint")), f["filePath"], m["line"], m["message"], i))))
    coded = F.transform("coded", lambda m, i: _found(F.lit("error"), m["code"], m["filename"], m["location"]["row"], m["message"], i))
    types = F.transform("types.generalDiagnostics", lambda m, i: _found(F.coalesce(m["severity"], F.lit("error")), F.lit("pyright"), m["file"], m["range"]["start"]["line"] + 1, m["message"], i))

    def result(m: Column, i: Column) -> Column:
        where = F.get(m["locations"], F.lit(0))["physicalLocation"]
        level = F.when(m["level"].isin("error", "warning"), m["level"]).when(m["level"].isin("note", "none"), "info").otherwise("warning")
        return _found(level, F.coalesce(m["ruleId"], F.lit("sarif")), where["artifactLocation"]["uri"], where["region"]["startLine"], m["message"]["text"], i)

    none = F.array().cast("array<struct<severity:string,rule:string,file:string,line:long,message:string,ordinal:int>>")
    sarif = F.flatten(F.transform("sarif.runs", lambda r: F.coalesce(F.transform(r["results"], result), none)))
    malformed = F.array(_found(F.lit("warning"), F.lit(MALFORMED), F.lit("."), F.lit(1), F.lit("malformed JSON payload"), F.lit(0)))
    is_lint = F.forall("lint", lambda x: x["filePath"].isNotNull() & x["messages"].isNotNull())
    is_coded = ~is_lint & F.forall("coded", lambda x: x["filename"].isNotNull() & x["code"].isNotNull())
    found = F.when(~F.col("ok"), malformed).when(array & is_lint, lint).when(array & is_coded, coded).when(object_ & F.col("types.generalDiagnostics").isNotNull(), types).when(object_, sarif)
    rows = t.select("run_id", "tool", F.explode(found).alias("m")).select("run_id", "tool", F.col("m.ordinal").alias("ordinal"), "m")
    return _rows(rows, F.col("m.severity"), F.col("m.rule"), F.col("m.file"), F.col("m.line"), F.col("m.message"))


def text_lines(outputs: DataFrame) -> DataFrame:
    """Type-checker lines `file(l,c): error TSn: text` and test lines `FAILED file::name - text`; a line without a text is neither."""
    rows = output_lines(outputs)
    tsc, failed = r"^(.+?)\((\d+),\d+\):\s+(error|warning)\s+(TS\d+):\s+(.+)$", r"^FAILED\s+([^:\s]+)(?:::[^\s]+)*\s+-\s+(.+)$"
    line, zero = F.col("line"), F.lit(0)
    g = lambda p, k: F.regexp_extract("line", p, k)
    a = F.when(line.contains("):"), F.when(line.rlike(tsc), _found(g(tsc, 3), g(tsc, 4), g(tsc, 1), g(tsc, 2).cast("long"), g(tsc, 5), zero)))
    b = F.when(F.startswith(line, F.lit("FAILED")), F.when(line.rlike(failed), _found(F.lit("error"), F.lit("pytest"), g(failed, 1), F.lit(1), g(failed, 2), zero)))
    rows = rows.select("run_id", "tool", "ordinal", F.explode(F.array_compact(F.array(a, b))).alias("m"))
    return _rows(rows, F.col("m.severity"), F.col("m.rule"), F.col("m.file"), F.col("m.line"), F.col("m.message"))


def parse(outputs: DataFrame) -> DataFrame:
    """All parsers over outputs(run_id, tool, text), each diagnostic once, the first in order."""
    found = json_lines(outputs).withColumn("pass", F.lit(0)).unionByName(payloads(outputs).withColumn("pass", F.lit(1))).unionByName(text_lines(outputs).withColumn("pass", F.lit(2)))
    found = found.withColumn("ordinal", F.col("pass") * F.lit(1 << 40) + F.col("ordinal"))
    return runs.first_of_each(found.drop("pass"), ["run_id", "tool", "rule_id", "file", "line", "message"], "ordinal").drop("ordinal")


def failed_commands(runs_: DataFrame) -> DataFrame:
    """A row for each run(run_id, tool, exit_code, stdout, stderr) that didn't exit with 0; source is the first eight lines of stderr, else of stdout."""
    text = F.when(F.coalesce(F.trim("stderr"), F.lit("")) != "", F.col("stderr")).otherwise(F.coalesce("stdout", F.lit("")))
    head = F.array_join(F.slice(F.split(text, r"\r?\n", -1), 1, 8), "\n")
    message = F.concat(F.lit("command exited with "), F.col("exit_code").cast("string"))
    return runs_.where("exit_code <> 0").select("run_id", "tool", F.lit("error").alias("severity"), F.lit("HAR-1.1").alias("rule_id"), F.lit(".").alias("file"), F.lit(1).cast("long").alias("line"), message.alias("message"), head.alias("source"))


def summary(found: DataFrame) -> DataFrame:
    """(run_id, n, by_severity) of diagnostics."""
    per = found.groupBy("run_id", "severity").agg(F.count("*").alias("c"))
    return per.groupBy("run_id").agg(F.sum("c").alias("n"), F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "severity", "c"))), ",").alias("by_severity"))


def ordered(found: DataFrame) -> DataFrame:
    """Diagnostics by file, line, rule and message, names in dictionary order."""
    return found.orderBy(F.collate("file", "UNICODE"), "line", F.collate("rule_id", "UNICODE"), F.collate("message", "UNICODE"))


def matching(found: DataFrame, severity: str | None = None, file: str | None = None, most: int = 50) -> DataFrame:
    """The first `most` diagnostics, in order, of a severity and a file if asked."""
    for column, value in (("severity", severity), ("file", file)):
        if value is not None:
            found = found.where(F.col(column) == value)
    return ordered(found).limit(most)


def truncated(text: Column, most: int = 8000) -> Column:
    """A text's first `most` characters, with a mark if that isn't all."""
    return F.when(F.length(text) > most, F.concat(F.left(text, F.lit(most)), F.lit("\n[truncated]"))).otherwise(text)
