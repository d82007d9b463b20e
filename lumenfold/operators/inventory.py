"""Inventory of older evidence: what scripts do, what their artifacts say, and what claims documents make."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Families of scripts by what their name and text have, the first that fits; `command` if none does.
FAMILIES = (
    ("device-manual", "android|ios|device|physical|simulator|xcode|adb"), ("test-report", "junit|pytest|vitest|jest|playwright|test-results"), ("security-report", "sarif|codeql|security|secret|audit"),
    ("contract-parity", "parity|contract|boundary|schema"), ("event-network", "event|network|lan|message|codec"), ("logging-custody", "logging|tracking|custody"),
    ("release-package", "release|package|install|billing|payment|production"),
)
# Claim kinds, all that fit.
CLAIM_KINDS = (
    ("explicit-claims-proved", "claimsProved"), ("explicit-non-claims", "claimsNotProved|mustNotClaim|notProved"), ("expectation-row-coverage", "rowsCovered|matrixRows|docs/expectations"),
    ("artifact-producing", r"\b(?:writeFile|writeFileSync|appendFile|appendFileSync|writeJson)\s*\("), ("capability-gated", r"(?i)manual-required|physical|ANDROID_SERIAL|\badb\b|ios|simulator|device"),
)
# Capabilities by a word in the lower-cased name and text; every script is `local`.
CAPABILITIES = (("ci", "ci"), ("windows", "windows"), ("linux", "linux"), ("macos", "macos"), ("wsl", "wsl"), ("browser", "browser|playwright"), ("network", "network|lan"), ("cloud", "cloud"), ("manual-required", "manual-required|physical"))


def classified(scripts: DataFrame) -> DataFrame:
    """(rel, family, capabilities, claim_kinds) of scripts(rel, text); the lists are sorted and joined."""
    whole = F.lower(F.concat_ws("\n", F.element_at(F.split("rel", "/"), -1), "text"))
    family = F.lit("command")
    for name, pattern in reversed(FAMILIES):
        family = F.when(F.col("whole").rlike(pattern), name).otherwise(family)
    device = F.when(F.col("whole").contains("android"), F.when(F.col("whole").contains("emulator"), "android-emulator").otherwise("android-device"))
    phone = F.when(F.col("whole").contains("ios"), F.when(F.col("whole").contains("device"), "ios-device").otherwise("ios-simulator"))
    can = F.array(F.lit("local"), device, phone, *[F.when(F.col("whole").rlike(p), n) for n, p in CAPABILITIES])
    kinds = F.array(*[F.when(F.col("text").rlike(p), n) for n, p in CLAIM_KINDS])
    joined = lambda a: F.array_join(F.array_sort(F.array_distinct(F.array_compact(a))), ",")
    return scripts.where(F.col("text").isNotNull()).withColumn("whole", whole).select("rel", family.alias("family"), joined(can).alias("capabilities"), joined(kinds).alias("claim_kinds"))


def artifact_status(artifacts: DataFrame) -> DataFrame:
    """(artifact_id, status) of artifacts(artifact_id, text): failed, manual-required, unavailable, passed or present, the first that its JSON or text tells.

    JSON tells by `ok`, `passed` and `success`, if these are booleans, and by `status`, else `result`, as whole words in any
    case; a text tells of manual-required wherever it stands. What is no JSON object has none of these fields.
    """
    v = F.try_parse_json("text")
    said = F.lower(F.coalesce(F.try_variant_get(v, "$.status", "string"), F.try_variant_get(v, "$.result", "string"), F.lit("")))

    def any_is(value: bool) -> Column:
        hit = F.lit(False)
        for name in ("ok", "passed", "success"):
            got = F.try_variant_get(v, f"$.{name}", "variant")
            hit |= F.coalesce((F.schema_of_variant(got) == "BOOLEAN") & (F.try_variant_get(v, f"$.{name}", "boolean") == F.lit(value)), F.lit(False))
        return hit

    status = F.when(any_is(False) | said.isin("failed", "fail", "error"), "failed")
    status = status.when(said.isin("manual-required", "manual_required") | F.coalesce(F.col("text").rlike("(?i)manual-required"), F.lit(False)), "manual-required")
    status = status.when(said.isin("unavailable", "skipped"), "unavailable").when(any_is(True) | said.isin("passed", "pass", "ok"), "passed")
    return artifacts.select("artifact_id", status.otherwise("present").alias("status"))


def routed_evidence(definitions: DataFrame, requests: DataFrame) -> DataFrame:
    """(request_id, id) of definitions(id, family, capabilities array) that fit requests(request_id, family, capability); a null asks for anything.

    Definitions are few and are grouped before the join, requests are many: each side is joined on what it asks for.
    """
    one = definitions.select("id", "family", F.explode("capabilities").alias("capability"))
    exact = requests.where("family IS NOT NULL AND capability IS NOT NULL").join(one, ["family", "capability"]).select("request_id", "id")
    by_family = requests.where("family IS NOT NULL AND capability IS NULL").join(definitions.select("id", "family"), "family").select("request_id", "id")
    by_capability = requests.where("family IS NULL AND capability IS NOT NULL").join(one.select("id", "capability").distinct(), "capability").select("request_id", "id")
    return exact.unionByName(by_family).unionByName(by_capability)


def markdown_claims(files: DataFrame, header: str) -> DataFrame:
    """(rel, line_no, claim): bullets below a heading that matches, up to the next heading; the state is folded over the file's lines."""
    lines = F.transform(F.split("text", r"\r?\n", -1), lambda line, i: F.struct((i + 1).cast("long").alias("n"), line.alias("line")))
    start = F.struct(F.lit(False).alias("on"), F.array().cast("array<struct<line_no:long,claim:string>>").alias("rows"))
    bullet = r"^\s*[-*]\s+(.*?)\s*$"

    def step(acc: Column, x: Column) -> Column:
        head = x["line"].rlike(r"^#+\s")
        on = F.when(head, x["line"].rlike(header)).otherwise(acc["on"])
        row = F.struct(x["n"].alias("line_no"), F.regexp_extract(x["line"], bullet, 1).alias("claim"))
        return F.struct(on.alias("on"), F.when(acc["on"] & ~head & x["line"].rlike(bullet), F.concat(acc["rows"], F.array(row))).otherwise(acc["rows"]).alias("rows"))

    return files.where(F.col("text").isNotNull()).select("rel", F.inline(F.aggregate(lines, start, step, lambda acc: acc["rows"])))


def compact_definitions(definitions: DataFrame) -> DataFrame:
    """What a list shows of definitions(id, title, family, severity, capabilities array, commands array)."""
    return definitions.select("id", "title", "family", "severity", F.array_join(F.array_sort("capabilities"), ",").alias("capabilities"), F.size("commands").alias("commands"))


def script_definitions(scripts: DataFrame) -> DataFrame:
    """(id, title, family, command) of classified scripts(rel, family): an evidence definition for each, named by its file."""
    name = F.regexp_replace(F.element_at(F.split("rel", "/"), -1), r"\.[^.]+$", "")
    return scripts.select(F.concat(F.lit("legacy."), name).alias("id"), F.initcap(F.replace(name, F.lit("-"), F.lit(" "))).alias("title"), "family", F.concat(F.lit("node "), F.col("rel")).alias("command"))
