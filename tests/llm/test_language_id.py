import math
import zlib
from collections import Counter, defaultdict

import numpy as np

from lumenfold.llm import language_id as L

DOCS = "doc_id long, text string, lang string, source string, score string"


class BruteTree:
    """PPM, method C with exclusion, by dictionaries."""

    def __init__(self, texts, order):
        self.order, self.tree = order, defaultdict(Counter)
        for t in texts:
            raw = bytes(order) + t.encode()
            for i in range(order, len(raw)):
                for k in range(order + 1):
                    self.tree[raw[i - k : i]][raw[i]] += 1

    def bits(self, ctx, byte):
        cost, excluded = 0.0, set()
        for k in range(self.order, -1, -1):
            followers = self.tree.get(ctx[len(ctx) - k :])
            if not followers:
                continue
            left = {s: n for s, n in followers.items() if s not in excluded}
            total = sum(left.values()) + len(left)
            if byte in left:
                return cost + math.log2(total / left[byte])
            if left:
                cost += math.log2(total / len(left))
            excluded |= set(left)
        return cost + math.log2(256 - len(excluded))


def _model(texts, order=3):
    trees = []
    for group in texts:
        keys = np.concatenate([L.grams(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())]), order) for t in group])
        seen, n = np.unique(keys, return_counts=True)
        trees.append(L.Tree.grown(seen, n.astype(float), order))
    return L.Model([str(i) for i in range(len(texts))], trees, order).prepared()


def test_code_lengths_match_brute_force_and_keep_krafts_equality():
    texts = [["the cat sat on the mat", "a cat", "banana bandana"], ["der hund läuft", "das haus ist groß"]]
    model = _model(texts)
    for t in ["the hund", "x", "", "ähm…", "the the the", "banana"]:
        raw = t.encode()
        got = model.text_bits(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))[0]
        for k, group in enumerate(texts):
            brute, padded = BruteTree(group, 3), bytes(3) + raw
            want = sum(brute.bits(padded[i - 3 : i], padded[i]) for i in range(3, len(padded)))
            assert abs(got[k] - want) < 1e-4 * max(1, want)
    for ctx in (b"the", b" ca", b"\0\0\0", b"zzz", b"an\xff"):
        keys = np.array([int.from_bytes(ctx + bytes([s]), "big") for s in range(256)], np.uint64)
        assert abs(np.exp2(-model.trees[0].bits(keys)).sum() - 1) < 1e-9


def test_blocks_keep_texts_apart():
    model = _model([["abc abd abe"], ["xyz xyw"]])
    texts = [b"abc", b"", b"x", b"abd abe", b"yw"]
    off = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    together = model.text_bits(np.frombuffer(b"".join(texts), np.uint8), off)
    for i, t in enumerate(texts):
        assert np.allclose(together[i], model.text_bits(np.frombuffer(t, np.uint8), np.array([0, len(t)]))[0])


def test_query_learns_languages_of_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = {r.doc_id: r for r in L.language_id(docs).collect()}
    truth = {r.doc_id: r for r in docs.collect()}
    assert rows.keys() == truth.keys()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in rows.items())
    held = [i for i, r in rows.items() if r.held_out and r.lang_pred != "und"]
    assert len(held) > 100 and sum(rows[i].lang_pred == truth[i].lang for i in held) / len(held) > 0.95


def test_odd_rows(spark):
    rows = [(i, "hello there my friend " * 3, "en", "s", "x") for i in range(20)] + [(i, "guten tag mein freund " * 3, "de", "s", "x") for i in range(20, 40)]
    odd = [(100, None, "en", "s", "x"), (101, "", "en", "s", "x"), (102, "123 456", "en", "s", "x"), (None, "mein freund", None, None, None), (103, "my friend " * 50_000, None, "s", "x"), (103, "my friend", None, "s", "x")]
    got = L.language_id(spark.createDataFrame(rows + odd, DOCS)).collect()
    pred = [(r.doc_id, r.lang_pred) for r in got if r.doc_id is None or r.doc_id >= 100]
    assert sorted(pred, key=str) == sorted([(100, "und"), (101, "und"), (102, "und"), (None, "de"), (103, "en"), (103, "en")], key=str)
    assert all(0 <= r.score <= 1 for r in got)
    kept = L.accepted(spark.createDataFrame(rows + odd, DOCS))
    assert kept.columns == ["doc_id", "text", "lang", "source", "score"] and {r.doc_id for r in kept.collect()} == {*range(40), 103, None}


def test_no_training_rows_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "abc", None, None, None)], DOCS)
    assert [r.lang_pred for r in L.language_id(docs).collect()] == ["und"]
    assert L.language_id(docs.limit(0)).collect() == []
