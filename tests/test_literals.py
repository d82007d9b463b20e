"""The literal automaton against a plain search."""

import random
import re
import time

import pytest

from lumenfold.operators import literals


def plain(texts, words, tokens=False):
    side = rb"A-Za-z0-9@._/\-"
    out = set()
    for i, t in enumerate(texts):
        for j, w in enumerate(words):
            shape = rb"(?<![" + side + rb"])" + re.escape(w) + rb"(?![" + side + rb"])" if tokens else re.escape(w)
            out |= {(i, j, m.start()) for m in re.finditer(b"(?=" + shape + b")", t)}
    return out


@pytest.mark.parametrize("tokens", [False, True])
def test_random_texts_and_literals(tokens):
    pick = random.Random(3)
    for alphabet in (b"ab", b"ab ./", bytes(range(256))):
        for _ in range(60):
            texts = [bytes(pick.choice(alphabet) for _ in range(pick.choice([0, 1, 5, 40, 700]))) for _ in range(pick.randint(0, 6))]
            words = [bytes(pick.choice(alphabet) for _ in range(pick.choice([1, 2, 3, 11, 12, 13, 30]))) for _ in range(pick.randint(1, 12))]
            words += [t[3:40] for t in texts if len(t) > 40] + words[:1]
            found = list(zip(*(x.tolist() for x in literals.Automaton(words).find(texts, tokens))))
            assert len(found) == len(set(found)) and set(found) == {(i, j, b) for i, j, b in plain(texts, words, tokens)}


def test_occurrences(spark):
    files = spark.createDataFrame([("a", "the cat, the cat sat"), ("b", "été the\0cat"), ("c", ""), ("d", None), ("e", "x" * 5000 + "the cat sat on the mat"), (None, "cat")], "rel string, text string")
    words = spark.createDataFrame([(1, "the cat"), (2, "cat"), (3, "the cat sat on the mat"), (4, ""), (5, None), (6, "é"), (7, "cat"), (8, "\0")], "literal_id long, literal string")
    got = sorted((str(r.rel), r.literal_id, r.n, r.first) for r in literals.occurrences(files, words).collect())
    assert got == [("None", 2, 1, 0), ("None", 7, 1, 0), ("a", 1, 2, 0), ("a", 2, 2, 4), ("a", 7, 2, 4), ("b", 2, 1, 10), ("b", 6, 2, 0), ("b", 7, 1, 10), ("b", 8, 1, 9), ("e", 1, 1, 5000), ("e", 2, 1, 5004), ("e", 3, 1, 5000), ("e", 7, 1, 5004)]
    assert literals.occurrences(files.limit(0), words).collect() == [] and literals.occurrences(files, words.limit(0)).collect() == []
    assert sorted(r.literal_id for r in literals.occurrences(files, words, tokens=True).where("rel = 'a'").collect()) == [1, 2, 7]


def test_one_scan_of_the_texts(spark, tmp_path):
    spark.createDataFrame([(str(i), f"text {i} of many") for i in range(50)], "rel string, text string").write.parquet(f"{tmp_path}/f")
    words = spark.createDataFrame([(i, f"text {i} of") for i in range(60)], "literal_id long, literal string")
    found = literals.occurrences(spark.read.parquet(f"{tmp_path}/f"), words)
    assert found.count() == 50 and found._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 1


def test_slices_give_the_same(spark, monkeypatch):
    files = spark.createDataFrame([(str(i), f"text {i} of many") for i in range(30)], "rel string, text string")
    words = spark.createDataFrame([(i, f"text {i}") for i in range(40)], "literal_id long, literal string")
    want = sorted(tuple(r) for r in literals.occurrences(files, words).collect())
    monkeypatch.setattr(literals, "SLICE_ROWS", 7)
    assert sorted(tuple(r) for r in literals.occurrences(files, words).collect()) == want


def test_cost_does_not_follow_the_number_of_literals():
    pick = random.Random(4)
    vocabulary = ["".join(pick.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(2000)]
    texts = [" ".join(pick.choice(vocabulary) for _ in range(4000)).encode() for _ in range(60)]
    took = []
    for n in (20, 2000):
        automaton = literals.Automaton([" ".join(pick.choice(vocabulary) for _ in range(8)).encode() for _ in range(n)])
        automaton.find(texts)
        began = time.perf_counter()
        automaton.find(texts)
        took.append(time.perf_counter() - began)
    assert took[1] < 4 * took[0]


def test_equal_literals_are_in_the_automaton_once(spark, monkeypatch):
    made, real = [], literals._slices
    monkeypatch.setattr(literals, "_slices", lambda held: made.append(held.count()) or real(held))
    files = spark.createDataFrame([("a", "red green"), ("b", "infrared"), ("c", "blue")], "rel string, text string")
    words = spark.range(600).selectExpr("id AS literal_id", "CASE WHEN id % 2 = 0 THEN 'red' ELSE 'grey' END AS literal")
    got = literals.occurrences(files, words, tokens=True).collect()
    assert made == [2] and sorted(tuple(r) for r in got) == [("a", k, 1, 0) for k in range(0, 600, 2)]
