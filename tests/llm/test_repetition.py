import re
from collections import Counter

from lumenfold.llm import repetition as R


def brute(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    out = {"n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": sum(t.count(c) for c in "#*$%&|<>"), "n_dup_lines": 0, "dup_line_chars": 0, "n_lines": 0}
    seen = set()
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            out["n_lines"] += 1
            if line in seen:
                out["n_dup_lines"] += 1
                out["dup_line_chars"] += sum(map(len, re.findall(r"[^\x20\x09-\x0D]+", line)))
            seen.add(line)
    for n in (3, *R.COVERAGE_LIMITS):
        count = Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
        hit = [any(count[tuple(w[j : j + n])] > 1 for j in range(max(0, i - n + 1), min(i, len(w) - n) + 1)) for i in range(len(w))]
        if n == 3:
            out["n_repeat_words"] = sum(hit)
        else:
            out[f"dup_chars_{n}"] = sum(len(x) for x, h in zip(w, hit) if h)
    out["base_failed"] = len(w) < 50 or 100 * out["n_repeat_words"] > 50 * len(w)
    ok = out["dup_line_chars"] <= R.LINE_CHAR_LIMIT * out["word_chars"] and out["n_dup_lines"] <= R.LINE_LIMIT * out["n_lines"]
    out["kept"] = not out["base_failed"] and ok and all(out[f"dup_chars_{n}"] <= most * out["word_chars"] for n, most in R.COVERAGE_LIMITS.items())
    return out


def test_whole_table_and_odd_texts(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    odd = ["", None, "\n\n", "a", "a a a a", "x\ny\nx\nx ", "é日本 \U0001f600\n" * 30, "the cat sat on the mat. " * 20 + "end", " ".join(map(str, range(100))), "word " * 30_000, "|<>&%$*# " * 60, "a\rb\x0bc\x85d\u2003e\n" * 3]
    rows = docs + [(10_000 + i, t) for i, t in enumerate(odd)] + [(None, "some text")]
    got = {r.doc_id: r for r in R.repetition_quality(spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, kept string")).collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        if t is None or len(t) < 20_000:
            assert {k: got[i][k] for k in brute(t)} == brute(t), (i, t and t[:50])
    assert not got[10_009].kept and got[10_009].n_words == 30_000
    assert sum(got[i].kept for i, _ in docs) > 0.8 * len(docs)


def test_repeated_rows_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "a b")], "doc_id long, text string")
    assert [r.n_words for r in R.repetition_quality(docs).collect()] == [2, 2]
    assert R.repetition_quality(docs.limit(0)).collect() == []
