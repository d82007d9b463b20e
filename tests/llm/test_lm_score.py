import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from lumenfold.llm import lm_score as M


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


def held(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2


def base(rows):
    counts = Counter(w for i, t in rows if not held(i) for w in [*words(t), None])
    n, v = sum(counts.values()), len(counts)
    out = []
    for i, t in rows:
        ws = [*words(t), None]
        out.append((i, held(i), len(ws), sum(counts[w] > 0 for w in ws), n, sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws)))
    return out


def same(got, want):
    got = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got), key=str)
    for g, w in zip(got, sorted(want, key=str), strict=True):
        assert g[:5] == w[:5] and abs(g[5] - w[5]) < 1e-6 * max(1, abs(w[5]))


@pytest.mark.parametrize("chunk", [1 << 23, 20_000])
def test_base_and_a_better_model_on_held_out_rows(spark, monkeypatch, chunk):
    monkeypatch.setattr(M, "CHUNK_BYTES", chunk)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = M.lm_scores(docs).collect()
    same(got, base([(r.doc_id, r.text) for r in docs.collect()]))
    out = [r for r in got if r.held_out]
    assert len(out) > 10 and sum(r.score for r in out) > sum(r.base_score for r in out)


def a_model(texts, seed=3):
    """(model, counts of words by hash): a model over the words of texts with random weights."""
    raw = [t.encode() for t in texts]
    buf, off = np.frombuffer(b"".join(raw), np.uint8), np.concatenate(([0], np.cumsum([len(t) for t in raw])))
    hashes, suffix, first = M.tokens(buf, off)
    seen, index, counts = np.unique(hashes, return_index=True, return_counts=True)
    order = np.lexsort((seen, -counts))[:40]
    share, rest = np.ones(M.SUFFIX_CLASSES), np.delete(np.arange(len(seen)), order)
    np.add.at(share, suffix[index[rest]], counts[rest] + 1)
    class_counts = np.zeros(M.CLASSES, np.int64)
    model = M.start(seen[order], counts[order], class_counts, -np.log10(share))
    weights = model.weights + np.random.default_rng(seed).normal(size=M._SIZE).astype(np.float32)
    return M.Model(model.words, model.edges, model.share, weights), dict(zip(seen.tolist(), counts.tolist())), (hashes, suffix, first)


TEXTS = ["a b a c", "", "b c " * 30, "end in x", *(f"word{k % 50} and{k % 7} a the{k % 3}" for k in range(200))]


def plain_log10(model, counts, words, suffixes):
    """log10 probability of one text, token by token, with loops and dictionaries."""
    place = {int(h): k for k, h in enumerate(model.words)}
    edges = [*model.edges.tolist(), len(model.words)]
    of = lambda k: max(c for c in range(M.WORD_CLASSES) if edges[c] <= k < edges[c + 1])
    names, total = [], 0.0
    for h, x in [*zip(words, suffixes), (None, None)]:
        at = place.get(h)
        kind = M.END_CLASS if h is None else of(at) if at is not None else M.WORD_CLASSES + x
        back = [names[-k] if len(names) >= k else 0 for k in (1, 2, 3)]
        keys = [*back, back[0] * (1 << 20) + back[1]]
        features = [int(M.S.mix(np.array([key + (k << 50)], np.uint64))[0] % np.uint64(M.BUCKETS)) + k * M.BUCKETS for k, key in enumerate(keys)]
        logits = [math.fsum([model.class_weights[-1][c], *(model.class_weights[f][c] for f in features)]) for c in range(M.CLASSES)]
        total += logits[kind] - math.log(math.fsum(map(math.exp, logits)))
        if at is not None:
            own = {w: math.fsum([model.word_bias[w], *(model.word_weights[M.word_cells(np.array([f]), w, w + 1)[0, 0]] for f in features)]) for w in range(edges[kind], edges[kind + 1])}
            total += own[at] - math.log(math.fsum(map(math.exp, own.values())))
        elif h is not None:
            total += math.log(counts.get(h, 0) + 1) + model.share[x] * math.log(10)
        names.append(0 if h is None else 1 + (at + M.SUFFIX_CLASSES if at is not None else x))
    return total / math.log(10)


def test_scores_equal_plain_ones_and_do_not_depend_on_how_texts_are_cut(monkeypatch):
    model, counts, (hashes, suffix, first) = a_model(TEXTS)
    c = np.array([counts[h] for h in hashes.tolist()])
    got = M.text_scores(model, hashes, suffix, first, c)
    for i in (0, 1, 2, 3, 17, 100):
        s = slice(first[i], first[i + 1])
        assert abs(got[i] - plain_log10(model, counts, hashes[s].tolist(), suffix[s].tolist())) < 1e-3
    monkeypatch.setattr(M, "TOKENS_AT_ONCE", 13)
    assert np.allclose(M.text_scores(model, hashes, suffix, first, c), got, atol=1e-4)


def test_probabilities_sum_to_one():
    model, counts, (hashes, suffix, first) = a_model(TEXTS)
    seen, index = np.unique(hashes, return_index=True)
    history = hashes[:2].tolist()
    t = M.histories(model, np.array(history, np.uint64), suffix[:2], np.array([0, 2]))
    features = t.features[:, 2:3]  # what the end of a text of two words has before it
    p = M._softmax(M.class_logits(model, features).astype(float))[0][0]
    edges = [*model.edges.tolist(), len(model.words)]
    total = p[M.END_CLASS] + sum(p[M.WORD_CLASSES + k] * 10 ** model.share[k] for k in range(M.SUFFIX_CLASSES))  # the end, and unknown words
    for k in range(M.WORD_CLASSES):
        total += p[k]  # the words of a class, or none if it is empty
        if edges[k + 1] > edges[k]:
            x = M.word_logits(model, features, edges[k], edges[k + 1])
            assert abs(M._softmax(x.astype(float))[0].sum() - 1) < 1e-9
    for h, x in zip(seen.tolist(), suffix[index].tolist()):
        if h not in set(model.words.tolist()):
            total += p[M.WORD_CLASSES + x] * (counts[h] + 1) * 10 ** model.share[x]
    assert abs(total - 1) < 1e-6


def test_gradient_is_that_of_the_log_likelihood(spark):
    model, _, (hashes, suffix, first) = a_model(TEXTS)
    frame = spark.createDataFrame([(t,) for t in TEXTS], "text string").repartition(5)
    observed, expected, n, likelihood = M.gathered(frame, model)
    t = M.histories(model, hashes, suffix, first)
    assert n == len(t.kind) and abs(likelihood - M.log_probabilities(model, t).sum()) < 1e-2
    rng = np.random.default_rng(1)
    active = np.flatnonzero(np.abs(observed - expected) > 0.05)
    for k in [*rng.choice(active[active < M._CLASS_TABLE], 12), *rng.choice(active[active >= M._CLASS_TABLE], 12)]:
        moved = []
        for by in (-0.05, 0.05):
            weights = model.weights.astype(np.float64)
            weights[k] += by
            moved.append(M.log_probabilities(M.Model(model.words, model.edges, model.share, weights), t).sum())
        assert abs((moved[1] - moved[0]) / 0.1 - (observed - expected)[k]) < 0.01 + 0.01 * abs((observed - expected)[k])


def test_training_brings_most_of_the_gain(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = []
    for batches in (0, M.BATCHES):
        held_out = [r for r in M.lm_scores(docs, batches).collect() if r.held_out]
        n = sum(r.n_tokens for r in held_out)
        out.append((sum(r.base_score for r in held_out) / n, sum(r.score for r in held_out) / n))
    (base_, untrained), (_, trained) = out
    assert trained > untrained and trained - untrained >= 0.5 * (trained - base_) and trained - base_ > 0.1


def test_equal_rows_are_dealt_to_several_chunks(spark, monkeypatch):
    monkeypatch.setattr(M, "CHUNK_BYTES", 2_000)
    docs = spark.createDataFrame([(7, "the same text again and again")] * 400, "doc_id long, text string").repartition(4)
    got = M.lm_scores(docs).collect()
    assert len(got) == 400 and len({(r.n_tokens, r.train_tokens, round(r.score, 6)) for r in got}) == 1 and got[0].train_tokens == 400 * 7


def test_odd_rows(spark):
    rows = [(1, "a b a", "x"), (1, "a b a", "x"), (2, None, "x"), (3, "", "x"), (None, "A c", "x"), (5, "zz " * 100_000, "x"), (6, " \t\n", "x"), (9, "unseen here", "x"), (16, "a", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    got = M.lm_scores(docs).collect()
    same(got, base([(i, t) for i, t, _ in rows]))
    assert all(math.isfinite(r.score) and r.score <= 0 for r in got)
    assert M.lm_scores(docs.limit(0)).collect() == []
    alone = next(i for i in range(100) if held(i))
    only = M.lm_scores(spark.createDataFrame([(alone, "a b")], "doc_id long, text string")).collect()
    assert [(r.n_tokens, r.n_known, r.train_tokens) for r in only] == [(3, 0, 0)]


def test_at_least_48_classes():
    assert M.CLASSES >= 48
