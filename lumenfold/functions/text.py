"""Column functions for source text and repository paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Replacements of finding sources, in order. Quoted values come first.
FINDING_REDACTIONS = (
    (r'"[A-Za-z0-9_./+=:@-]{8,}"', '"[REDACTED]"'),
    (r"'[A-Za-z0-9_./+=:@-]{8,}'", "'[REDACTED]'"),
    (r"\bgh[pousr]_[A-Za-z0-9_]{20,}\b", "[REDACTED_GITHUB_TOKEN]"),
    (r"\bAKIA[0-9A-Z]{16}\b", "[REDACTED_AWS_KEY]"),
    (r"\b(?:sk|pk)_(?:live|test)_[A-Za-z0-9]{20,}\b", "[REDACTED_STRIPE_KEY]"),
    (r"\beyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\b", "[REDACTED_JWT]"),
)


def ascii_boundaries(pattern: str) -> str:
    """The pattern with `\\b` read as a boundary of ASCII word characters, whatever stands beside it."""
    return pattern.replace(r"\b", r"(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))")


#: Literals without which a redaction has nothing to replace.
_REDACTION_GATES = {"gh[pousr]_": ("gh",), "AKIA": ("AKIA",), "_(?:live|test)_": ("_live_", "_test_"), "beyJ": ("eyJ",), '"[': ('"',), "'[": ("'",)}


def _replaced(pattern: str, label: str, gate: tuple[str, ...]):
    def step(text: Column) -> Column:
        out = F.regexp_replace(text, ascii_boundaries(pattern), F.lit(label.replace("$", r"\$")))
        may = F.lit(not gate)
        for literal in gate:
            may |= text.contains(literal)
        return F.when(may, out).otherwise(text)

    return step


def redact(text: Column, replacements=FINDING_REDACTIONS) -> Column:
    """text with each pattern replaced by its label, in order; a text without a pattern's literals isn't searched for it."""
    for pattern, label in replacements:
        gate = next((g for part, g in _REDACTION_GATES.items() if part in pattern), ())
        # by way of an array, so that the text so far stands once in the expression
        text = F.element_at(F.transform(F.array(text), _replaced(pattern, label, gate)), 1)
    return text


def repo_path(path: Column) -> Column:
    """Slashes forward, no leading `./`, lower case; an empty path is null."""
    p = F.lower(F.regexp_replace(F.translate(path, "\\", "/"), r"^(\./)+", ""))
    return F.when(p != "", p)


def ancestors(path: Column) -> Column:
    """All leading parts of a path, itself included."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))


def slice_key(path: Column, roots=("apps", "packages", "crates", "tools")) -> Column:
    """Two segments below a workspace root, else the first one, else `.`."""
    parts = F.split(path, "/")
    first, second = F.get(parts, F.lit(0)), F.get(parts, F.lit(1))
    return F.when(first.isin(*roots) & (F.coalesce(second, F.lit("")) != ""), F.concat_ws("/", first, second)).when(first != "", first).otherwise(F.lit("."))


def diagnostic_fingerprint(*parts: Column) -> Column:
    """The first 24 characters of the base64url form of the joined parts: their first 18 bytes."""
    joined = F.encode(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), "UTF-8")
    return F.translate(F.base64(F.substring(joined, 1, 18)), "+/=", "-_")


# Replacements of captured tool output, in order.
OUTPUT_REDACTIONS = (
    r"\bgh[pousr]_[A-Za-z0-9_]{20,}\b", r"\bAKIA[0-9A-Z]{16}\b", r"\b(?:sk|pk)_(?:live|test)_[A-Za-z0-9]{20,}\b", r"\bsk-[A-Za-z0-9_-]{20,}\b",
    r"\beyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\b", r"(?i)\b(?:token|secret|password|api[_-]?key)\b\s*[:=]\s*[^\s]{8,}",
)


def redact_output(text: Column) -> Column:
    """Captured output with `[REDACTED]` in place of what looks like a secret."""
    return redact(text, tuple((p, "[REDACTED]") for p in OUTPUT_REDACTIONS))


def to_posix(path: Column) -> Column:
    return F.translate(path, "\\", "/")


def waiver_path(path: Column) -> Column:
    """Slashes forward, without any leading `./`, trimmed."""
    return F.trim(F.regexp_replace(to_posix(F.trim(path)), r"^(?:\./)+", ""))


def split_list(text: Column) -> Column:
    """Items between commas or line ends, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(text, r"[,\n]"), lambda x: F.trim(x)), lambda x: x != "")


def comment_text(ext: Column, line: Column) -> Column:
    """What a line says in a comment: after `#` in Python, TOML and YAML, else after `//` or from `/*` or a leading `*` on."""
    hashed = F.regexp_extract(line, r"#(.*)$", 0)
    slashed = F.regexp_extract(line, r"(?://|/\*|^\s*\*)(.*)$", 0)
    return F.trim(F.when(ext.isin(".py", ".toml", ".yml", ".yaml"), hashed).otherwise(slashed))


def name_tokens(name: Column) -> Column:
    """Words of an identifier: camel humps and underscores part them, in lower case."""
    snake = F.lower(F.regexp_replace(name, r"([a-z0-9])([A-Z])", "$1_$2"))
    return F.filter(F.split(snake, r"[^a-z0-9]+"), lambda x: x != "")


def suspicious_field(name: Column) -> Column:
    """Whether a serialized field names an id or a reference, or an event's or a command's type."""
    t = name_tokens(name)
    last, before = F.try_element_at(t, F.lit(-1)), F.try_element_at(t, F.lit(-2))
    return F.coalesce(last.isin("id", "ids", "ref", "refs") | ((last == "type") & before.isin("event", "command")), F.lit(False))


def slug(text: Column) -> Column:
    """Lower case, runs of other characters as one hyphen, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")


def markdown_anchor(heading: Column) -> Column:
    """The anchor of a heading: lower case, without other characters than letters, digits, spaces, underscores and hyphens; spaces as hyphens."""
    return F.regexp_replace(F.regexp_replace(F.trim(F.lower(heading)), r"[^a-z0-9 _-]", ""), r" ", "-")


def balanced(text: Column, pairs=("()", "[]", "{}")) -> Column:
    """Whether the delimiters of a text close in order: a stack is folded over them, and stays broken once it is."""
    opens, closes = "".join(p[0] for p in pairs), "".join(p[1] for p in pairs)
    marks = F.filter(F.split(F.regexp_replace(text, r"[^\(\)\[\]\{\}]", ""), ""), lambda m: m != "")
    last = lambda s: F.right(s, F.lit(1))
    step = lambda s, m: F.when(s == "!", s).when(F.instr(F.lit(opens), m) > 0, F.concat(s, m)).when(last(s) == F.translate(m, closes, opens), F.left(s, F.length(s) - 1)).otherwise(F.lit("!"))
    return F.aggregate(marks, F.lit(""), step) == ""


def run_stamp(ts: Column) -> Column:
    """A run id's time part."""
    return F.date_format(ts, "yyyyMMddHHmmss")


def key_line(text: Column, key: str) -> Column:
    """The first line of a JSON text that has the key, else 1."""
    at = F.array_position(F.transform(F.split(text, r"\r?\n", -1), lambda line: line.rlike(rf'"{key}"\s*:')), F.lit(True))
    return F.when(at > 0, at).otherwise(F.lit(1)).cast("long")


def nested_strings(json: Column) -> Column:
    """All string values of a JSON text that stand as values, at any depth, in order."""
    return F.regexp_extract_all(F.regexp_replace(json, r'"(?:[^"\\]|\\.)*"\s*:', ":"), F.lit(r'"((?:[^"\\]|\\.)*)"'), 1)
