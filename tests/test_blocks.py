"""Block spans against a walk over the lines."""

import random
import re

from lumenfold.operators import blocks

FILES = "rel string, text string"


def got(df):
    return sorted(tuple(r) for r in df.collect())


def plain_braces(text, start):
    lines = re.split(r"\r?\n", text)
    for s, line in enumerate(lines):
        if re.search(start, line):
            depth, seen, end = 0, False, s
            for k in range(s, len(lines)):
                depth += lines[k].count("{") - lines[k].count("}")
                seen |= "{" in lines[k]
                if seen and depth <= 0:
                    end = k
                    break
            yield s + 1, end + 1


def plain_dedent(text, start):
    lines = re.split(r"\r?\n", text)
    width = lambda x: len(re.match(r"\s*", x, re.A).group())
    for s, line in enumerate(lines):
        if re.search(start, line):
            after = [k for k in range(s + 1, len(lines)) if lines[k].strip() and not lines[k].strip().startswith("#") and width(lines[k]) <= width(line)]
            yield s + 1, after[0] if after else len(lines)


def test_braces_on_random_files(spark):
    pick = random.Random(1)
    words = ["fn a() {", "fn b()", "{", "}", "}}", "x", "", "fn c() { y }", "} else {", "fn d() {{"]
    texts = ["\n".join(pick.choice(words) for _ in range(pick.randint(0, 60))) for _ in range(60)] + ["", "fn x", "fn a() {\r\n}\r\n"]
    files = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)] + [("null", None)], FILES)
    assert got(blocks.brace_spans(files, "^fn")) == sorted((str(i), *s) for i, t in enumerate(texts) for s in plain_braces(t, "^fn"))


def test_indents_on_random_files(spark):
    pick = random.Random(2)
    words = ["def a():", "  def b():", "    x", "  y", "z", "", "   ", "# c", "      # d", "\tdef e():", "    def f():"]
    texts = ["\n".join(pick.choice(words) for _ in range(pick.randint(0, 60))) for _ in range(60)] + ["", "def x():", "def a():\r\n  b\r\n\r\nc"]
    files = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)] + [("null", None)], FILES)
    assert got(blocks.dedent_spans(files, r"^\s*def ")) == sorted((str(i), *s) for i, t in enumerate(texts) for s in plain_dedent(t, r"^\s*def "))


def test_more_blocks_than_a_chunk(spark):
    text = "\n".join("def f():\n    pass" for _ in range(2000))
    files = spark.createDataFrame([("a", text)], FILES)
    assert got(blocks.dedent_spans(files, "^def")) == [("a", 2 * k + 1, 2 * k + 2) for k in range(2000)]
    assert blocks.brace_spans(spark.createDataFrame([("a", "fn {\n}\n" * 1500)], FILES), "^fn").count() == 1500


def test_test_functions(spark):
    text = """import x
def test_empty():
    # only words

def test_pass() -> None:
    pass
    pass
class T:
    def test_no_assert(self):
        assertion = 1
        run()

    def test_asserts(self, a):
        if a:
            assert a
    async def test_inside(self):
        x
@mark
def test_last():
  assert(1)
def test_broken(
    x
"""
    files = spark.createDataFrame([("t.py", text), ("none", None), ("empty", "")], FILES)
    assert got(blocks.test_blocks(files)) == [("t.py", 2, "test_empty", 0, 0, 0), ("t.py", 5, "test_pass", 2, 2, 0), ("t.py", 9, "test_no_assert", 2, 0, 0), ("t.py", 13, "test_asserts", 4, 0, 1), ("t.py", 19, "test_last", 1, 0, 1)]
    assert got(blocks.test_findings(files)) == [
        ("PY-6.3", "t.py", 2, "empty Python test test_empty found."), ("PY-6.3", "t.py", 5, "empty Python test test_pass found."), ("PY-6.4", "t.py", 9, "Python test test_no_assert has no assertion."),
    ]


def test_gaps_of_test_files(spark):
    rows = [("tests/test_parser.py", "assert x"), ("tests/test_parser_ok.py", "malformed @given"), ("tests/test_error.py", "with pytest.raises(X)"), ("tests/test_failure.py", "x"), ("tests/test_normalizer.py", "invalid, hypothesis"), ("other.py", "x"), ("parser.py", None)]
    assert got(blocks.test_file_gaps(spark.createDataFrame(rows, FILES))) == [("PY-6.10", "tests/test_parser.py"), ("PY-6.10", "tests/test_parser_ok.py"), ("PY-6.8", "tests/test_parser.py"), ("PY-6.9", "tests/test_failure.py")]
