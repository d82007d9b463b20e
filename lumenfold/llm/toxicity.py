"""Toxicity by non-negative positive-unlabelled learning.

A linear classifier in numpy learns from texts confirmed toxic and from unlabelled texts. Its risk estimate
subtracts the toxic share of the unlabelled texts, known as the class prior; where that makes the estimated
risk of the clean class negative, which only overfitting can, the step goes the other way.

Features are the rates of word beginnings and whole words, picked by how much commoner they are in the toxic
sample. The samples, and with them all that reaches the driver, are bounded by parameters; scoring covers
every whole text, block by block, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared as S

#: Bounds of the training sample: toxic texts, unlabelled texts, and the bytes of any of them.
TOXIC_TEXTS, UNLABELLED_TEXTS, LONGEST = 2000, 4000, 32 << 10
FEATURES, LEAST_TEXTS = 1500, 4
#: Word beginnings of so many bytes are features, beside whole words.
BEGINNINGS = (4, 5, 6, 7, 8)
SMOOTH_WORDS = 10
STEPS, RATE, DECAY = 400, 0.05, 1e-4
SCHEMA = "doc_id long, held_out boolean, score double, predicted int"


def word_features(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(feature hash, text number) of all features in a block, and the words of each text."""
    starts, ends, first = S.word_ranges(buf, off)
    owner = np.repeat(np.arange(len(off) - 1), np.diff(first))
    low = S._LOWER[buf]
    hashes, owners = [S.range_hash(low, starts, ends) ^ np.uint64(0x5555)], [owner]
    for n in BEGINNINGS:
        long = ends - starts > n
        hashes.append(S.range_hash(low, starts[long], starts[long] + n))
        owners.append(owner[long])
    return np.concatenate(hashes), np.concatenate(owners), np.diff(first)


@dataclass
class Model:
    """Sorted feature hashes with their weights."""

    features: np.ndarray
    weights: np.ndarray
    bias: float

    def _table(self) -> tuple[np.ndarray, np.uint64]:
        if not hasattr(self, "seen"):
            self.seen = np.zeros(1 << 20, bool)
            self.seen[self.features & np.uint64((1 << 20) - 1)] = True
        return self.seen, np.uint64((1 << 20) - 1)

    def rates(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text number, feature number, value) of the model's features in a block."""
        if not len(buf) or not len(self.features):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        hashes, owner, n_words = word_features(buf, off)
        seen, low = self._table()
        maybe = seen[hashes & low]
        hashes, owner = hashes[maybe], owner[maybe]
        at = np.minimum(np.searchsorted(self.features, hashes), len(self.features) - 1)
        hit = self.features[at] == hashes
        pair, n = np.unique(owner[hit] * len(self.features) + at[hit], return_counts=True)
        text, feature = pair // len(self.features), pair % len(self.features)
        return text, feature, np.log1p(100.0 * n / (n_words[text] + SMOOTH_WORDS))

    def margins(self, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
        text, feature, value = self.rates(buf, off)
        return self.bias + np.bincount(text, value * self.weights[feature], len(off) - 1)


def risk(x: np.ndarray, toxic: np.ndarray, w: np.ndarray, prior: float) -> tuple[float, float, np.ndarray, np.ndarray]:
    """(toxic risk, clean risk, gradient of their sum, gradient of the clean risk) of weights and bias w, with the sigmoid loss.

    The toxic risk is that of calling the toxic texts clean, times the prior; the clean one that of calling unlabelled
    texts toxic, less the prior times that of toxic ones, as so many of the unlabelled are toxic.
    """
    z = x @ w[:-1].astype(x.dtype) + w[-1]
    p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    slope = p * (1 - p)  # of the loss p of calling a clean text toxic; minus that of calling a toxic one clean
    as_clean = np.where(toxic, -prior / toxic.sum(), 1 / (~toxic).sum()) * slope
    as_toxic = np.where(toxic, -prior / toxic.sum(), 0) * slope
    of = lambda g: np.append(x.T @ g.astype(x.dtype), g.sum())
    return prior * (1 - p[toxic]).mean(), p[~toxic].mean() - prior * p[toxic].mean(), of(as_toxic + as_clean), of(as_clean)


def fit(x_toxic: np.ndarray, x_unlabelled: np.ndarray, prior: float) -> tuple[np.ndarray, float]:
    """Weights and bias by the non-negative risk estimate with the sigmoid loss and full-batch Adam steps."""
    x = np.vstack([x_toxic, x_unlabelled]).astype(np.float32)
    toxic = np.arange(len(x)) < len(x_toxic)
    w = np.zeros(x.shape[1] + 1)
    w[-1] = -1.0
    first, second = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, STEPS + 1):
        _, clean_risk, whole, of_clean = risk(x, toxic, w, prior)
        grad = (whole if clean_risk >= 0 else -of_clean) + DECAY * np.append(w[:-1], 0)
        first, second = 0.9 * first + 0.1 * grad, 0.999 * second + 0.001 * grad**2
        w -= RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return w[:-1], float(w[-1])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many toxic and unlabelled texts each feature is."""
    for b in S.blocks(batches):
        toxic = np.asarray(S.fields(b.rows, "toxic")[0]).astype(bool)
        hashes, owner, _ = word_features(b.buf, b.off)
        order = np.lexsort((owner, hashes))
        hashes, owner = hashes[order], owner[order]
        new = np.ones(len(hashes), bool)
        new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
        seen, place = np.unique(hashes[new], return_inverse=True)
        of_toxic = np.bincount(place, toxic[owner[new]], len(seen)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int64)), pa.array(of_toxic), pa.array(np.bincount(place, minlength=len(seen)) - of_toxic)], names=["feature", "toxic", "unlabelled"])


def _draw(column: Column, most: int, of: int) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(1 << 30)) / float(1 << 30) < min(1.0, 1.2 * most / max(of, 1))


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit on docs(doc_id, text) and labels(doc_id, toxic); rows with null labels count as unlabelled.

    The toxic sample is drawn from the ids labelled 1, at most 1.2 * TOXIC_TEXTS or so of them, which bounds
    the broadcast; the unlabelled one from all docs. Without toxic texts the model calls nothing toxic.
    """
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n, n_toxic = known.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if not n_toxic:
        return Model(np.zeros(0, np.uint64), np.zeros(0), -5.0)
    prior = min(0.9, n_toxic / n)
    short = docs.where(F.octet_length("text").between(1, LONGEST)).select("doc_id", "text")
    ids = known.where((F.col("toxic") == 1) & _draw(F.col("doc_id"), TOXIC_TEXTS, n_toxic)).select("doc_id").limit(2 * TOXIC_TEXTS)
    toxic = short.join(F.broadcast(ids), "doc_id").select("text", F.lit(True).alias("toxic")).limit(2 * TOXIC_TEXTS)  # ids may repeat
    unlabelled = short.where(_draw(F.struct("doc_id", "text"), UNLABELLED_TEXTS, docs.count())).select("text", F.lit(False).alias("toxic")).limit(2 * UNLABELLED_TEXTS)
    sample = S.settle(toxic.unionByName(unlabelled), "toxicity-sample")
    counts = sample.mapInArrow(_counted, "feature long, toxic long, unlabelled long").groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("unlabelled").alias("unlabelled"))
    sizes = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    if not sizes.get(True):
        return Model(np.zeros(0, np.uint64), np.zeros(0), -5.0)
    lift = F.log((F.col("toxic") + 0.5) / float(sizes[True]) / ((F.col("unlabelled") + 0.5) / float(max(sizes.get(False, 0), 1))))
    ranked = counts.where(F.col("toxic") >= min(LEAST_TEXTS, sizes[True])).withColumn("gain", F.col("toxic") * lift).where("gain > 0")
    best = ranked.orderBy(F.desc("gain"), "feature").limit(FEATURES).select("feature").collect()
    model = Model(np.sort(np.array([r[0] for r in best], np.int64).astype(np.uint64)), np.zeros(len(best)), 0.0)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # FEATURES hashes

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in S.blocks(batches):
            text, feature, value = shared.value.rates(b.buf, b.off)
            cut = np.searchsorted(text, np.arange(b.n + 1))
            rows = [(feature[i:j].astype("<i4").tobytes(), value[i:j].astype("<f4").tobytes()) for i, j in zip(cut[:-1], cut[1:])]
            yield pa.RecordBatch.from_arrays([S.fields(b.rows, "toxic")[0], *(pa.array([r[k] for r in rows], pa.binary()) for k in (0, 1))], names=["toxic", "features", "rates"])

    pdf = sample.mapInArrow(vectors, "toxic boolean, features binary, rates binary").toPandas()
    x = np.zeros((len(pdf), len(best)), np.float32)
    for i, (f, v) in enumerate(zip(pdf["features"], pdf["rates"])):
        x[i, np.frombuffer(f, "<i4")] = np.frombuffer(v, "<f4")
    is_toxic = pdf["toxic"].to_numpy(bool)
    unknown = x[~is_toxic] if (~is_toxic).any() else np.zeros((1, x.shape[1]), np.float32)
    model.weights, model.bias = fit(x[is_toxic], unknown, prior)
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of docs(doc_id, text, held_out).

    score is the logistic of the margin, that of the bias alone for null and empty texts; predicted is 1 from
    0.5 on. Repeated rows are each scored, a null doc_id stays null, other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = [x.split()[0] for x in SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in S.blocks(batches):
            p = 1 / (1 + np.exp(-np.clip(shared.value.margins(b.buf, b.off), -30, 30)))
            yield pa.RecordBatch.from_arrays([*S.fields(b.rows, "doc_id", "held_out"), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], names=names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "held_out", "text").mapInArrow(run, SCHEMA)


def toxicity(docs: DataFrame, labels: DataFrame, folds: int = 5) -> DataFrame:
    """Learn from the rows of docs and labels whose crc_of_id mod folds is not 0, then score all docs."""
    held_out = S.crc_of_id(F.col("doc_id")) % folds == 0
    model = train(docs.where(~held_out), labels.where(~held_out))
    return score(docs.select("doc_id", "text", held_out.alias("held_out")), model)
