import math
import re

import numpy as np

from lumenfold.llm import toxicity as T

DOCS = "doc_id long, text string, lang string, toxic int, score double"


def test_held_out_labels(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    rows = T.toxicity(docs, labels)
    got = rows.join(labels, "doc_id").where("held_out").toPandas()
    hit, alarm = got[got.toxic == 1].predicted.mean(), got[got.toxic == 0].predicted.mean()
    order = got.score.rank()
    n1, n0 = (got.toxic == 1).sum(), (got.toxic == 0).sum()
    auc = (order[got.toxic == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * n0)
    assert hit > 0.9 and alarm < 0.02 and auc > 0.95
    assert rows.count() == docs.count()


def test_fit_follows_the_prior_and_never_below_zero_risk():
    rng = np.random.default_rng(3)
    toxic = rng.normal(2, 1, (400, 2))
    unlabelled = np.vstack([rng.normal(2, 1, (200, 2)), rng.normal(-2, 1, (1800, 2))])
    w, b = T.fit(toxic, unlabelled, 0.1)
    share = ((unlabelled @ w + b) > 0).mean()
    assert 0.07 < share < 0.13 and ((toxic @ w + b) > 0).mean() > 0.9


def test_odd_rows(spark):
    rows = [(i, "you stupid clown go away " * 2 if i % 4 == 0 else "what a lovely sunny morning " * 2, "en", 1, 0.5) for i in range(80)]
    rows += [(200, None, None, None, None), (201, "", None, 1, None), (None, "stupid clown", None, None, None), (203, "lovely " * 200_000, None, None, None), (204, "clown", None, None, None), (204, "clown", None, None, None)]
    docs = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame([(i, int(i % 4 == 0), i) for i in range(0, 80, 2)] + [(3, None, 1), (None, 1, 1)], "doc_id long, toxic int, text long")
    got = T.toxicity(docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r.predicted)
    assert all(by[i] == [int(i % 4 == 0)] for i in range(80)) and by[200] == [0] and by[203] == [0] and len(by[204]) == 2
    assert T.toxicity(docs.limit(0), labels.limit(0)).collect() == []
    assert {r.predicted for r in T.toxicity(docs, labels.where("toxic = 0")).collect()} == {0}


def test_gradients_are_those_of_the_risks():
    rng = np.random.default_rng(5)
    x, toxic = rng.normal(size=(60, 4)), np.arange(60) < 12
    for scale in (0.1, 1.0):
        w = rng.normal(size=5) * scale
        of_toxic, of_clean, whole, clean = T.risk(x, toxic, w, 0.2)
        p = [1 / (1 + math.exp(-(sum(a * b for a, b in zip(r, w)) + w[-1]))) for r in x]
        assert abs(of_toxic - 0.2 * sum(1 - q for q in p[:12]) / 12) < 1e-12
        assert abs(of_clean - (sum(p[12:]) / 48 - 0.2 * sum(p[:12]) / 12)) < 1e-12
        for k in range(5):
            step = np.eye(5)[k] * 1e-5
            up, down = T.risk(x, toxic, w + step, 0.2), T.risk(x, toxic, w - step, 0.2)
            assert abs((up[0] + up[1] - down[0] - down[1]) / 2e-5 - whole[k]) < 1e-7 and abs((up[1] - down[1]) / 2e-5 - clean[k]) < 1e-7


def test_scores_equal_plain_ones(spark):
    rows = [(i, ("you stupid clown go away " * (1 + i % 3) if i % 4 == 0 else "what a lovely sunny morning Stupidly ") + "x" * (i % 9)) for i in range(80)] + [(90, ""), (91, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(0, 80, 2)], "doc_id long, toxic int")
    model = T.train(docs, labels)
    weight = dict(zip(model.features.tolist(), model.weights.tolist()))
    got = {r.doc_id: r.score for r in T.score(docs.selectExpr("doc_id", "text", "false AS held_out"), model).collect()}
    assert len(weight) > 5
    for i, text in rows:
        words, counts = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower()), {}
        for word in words:
            raw = word.encode()
            for part, salt in [(raw, 0x5555), *((raw[:n], 0) for n in T.BEGINNINGS if len(raw) > n)]:
                h = int(T.S.range_hash(np.frombuffer(part, np.uint8), np.array([0]), np.array([len(part)]))[0]) ^ salt
                counts[h] = counts.get(h, 0) + 1
        margin = model.bias + sum(weight[h] * math.log1p(100 * n / (len(words) + T.SMOOTH_WORDS)) for h, n in counts.items() if h in weight)
        assert abs(got[i] - 1 / (1 + math.exp(-margin))) < 1e-6


def test_repeated_ids_do_not_multiply_the_sample(spark, monkeypatch):
    monkeypatch.setattr(T, "TOXIC_TEXTS", 10)
    docs = spark.createDataFrame([(1, f"you stupid clown {k}") for k in range(300)] + [(2, "a lovely morning")] * 20, "doc_id long, text string")
    model = T.train(docs, spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int"))
    assert len(model.features)
