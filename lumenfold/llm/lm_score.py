"""Language-model scores by a hashed maximum-entropy model with class-factored softmax.

P(word | history) = P(class | history) * P(word | class, history). The VOCABULARY most frequent words are put into
classes by frequency, most frequent first, each class with about as much of the sum of their square roots of counts; all others
share classes by their last bytes, and the end of a text is a class of its own, so every token has a class.

Both factors are maximum-entropy models over the same hashed features of the history: the previous word, the two
before it (skip features), and the last two together (the history of a trigram). Among classes a softmax runs over all classes, its
weights in a table of feature buckets by class. Inside a class of frequent words a softmax runs over the class's
words, its weights in one hashed table of (feature, word). A word that isn't in the vocabulary has its add-one
share of its class, as its own number of parameters has no bound.

Word counts of the whole training part are gathered in packed form: documents are dealt into chunks of a bounded
size, a chunk's distinct words go to the part of their hash, and each part sends back the totals in the order it
got them. Training starts from the classes' and words' shares and takes one pass over all training texts, in
BATCHES parts of them: for each part, tasks sum observed and expected feature counts under the weights so far, the sums
meet in a shuffle, and the driver, which holds only the weights, moves them along the gradient, scaled by its
curvature. Before a part moves the weights its texts are unseen, so its log likelihood tells whether the steps still
improve the model; where it falls, the steps get smaller.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared as S

VOCABULARY, WORD_CLASSES, SUFFIX_CLASSES, SUFFIX_BYTES = 1024, 24, 24, 2
CLASSES = WORD_CLASSES + SUFFIX_CLASSES + 1
END_CLASS = CLASSES - 1
#: Features of a history, buckets of each, and bits of the table of (feature, word).
FEATURES, BUCKETS, WORD_BITS = 4, 1 << 12, 18
BATCHES, RATE, DAMP, LARGEST = 8, 1.2, 8.0, 1.5
CHUNK_BYTES = 8 << 20
TOKENS_AT_ONCE = 1 << 16
FOLDS, HELD_OUT = 7, 2
_PIECE = 1 << 14  # weights in one row of the gradient's shuffle
_WORD_TABLE = 1 << WORD_BITS
_CLASS_TABLE = (FEATURES * BUCKETS + 1) * CLASSES
_SIZE = _CLASS_TABLE + _WORD_TABLE + VOCABULARY
SCHEMA = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def tokens(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, suffix class, first) of the words of each text."""
    starts, ends, first = S.word_ranges(buf, off)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.uint8), first
    low = S._LOWER[buf]
    last = np.zeros(len(starts), np.uint64)
    for k in range(1, SUFFIX_BYTES + 1):
        at = ends - k
        last = last * np.uint64(256) + np.where(at >= starts, low[np.maximum(at, 0)], 0).astype(np.uint64)
    return S.range_hash(low, starts, ends), (S.mix(last) % np.uint64(SUFFIX_CLASSES)).astype(np.uint8), first


def _text_tokens(table: pa.Table | pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """tokens() of all rows, block by block."""
    hashes, suffixes, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint8)], []
    batches = table.to_batches() if isinstance(table, pa.Table) else [table]
    for b in S.blocks(batches):
        h, s, first = tokens(b.buf, b.off)
        hashes.append(h)
        suffixes.append(s)
        counts.append(np.diff(first))
    n = np.concatenate(counts) if counts else np.zeros(0, np.int64)
    return np.concatenate(hashes), np.concatenate(suffixes), np.concatenate(([0], np.cumsum(n)))


# --- counts --------------------------------------------------------------------------------------


def _vocabulary(hashes: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words ordered by part and hash: (words, part, one index of each, place of each token)."""
    words, index, place = np.unique(hashes, return_index=True, return_inverse=True)
    part = (S.mix(words) % np.uint64(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    back = np.empty(len(order), np.int64)
    back[order] = np.arange(len(order))
    return words[order], part[order], index[order], back[place]


def _send(parts: int):
    def run(table: pa.Table) -> pa.Table:
        hashes, suffix, first = _text_tokens(table)
        words, part, index, place = _vocabulary(hashes, parts)
        training = np.repeat(~np.asarray(table.column("held_out")).astype(bool), np.diff(first))
        n = np.bincount(place[training], minlength=len(words)).astype(np.int32)
        cut = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(part) else np.zeros(0, np.int64)
        ends = np.append(cut[1:], len(part)) if len(part) else cut
        pack = lambda x: pa.array([x[i:j].tobytes() for i, j in zip(cut, ends)], pa.binary())
        chunk = table.column("chunk")[0].as_py()
        return pa.table([pa.array([chunk] * len(cut), pa.int32()), pa.array(part[cut].astype(np.int32)), pack(words), pack(n), pack(suffix[index])], names=["chunk", "part", "words", "n", "suffix"])

    return run


def _total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each part: the totals for each chunk (kind 0), sums by suffix class (1) and its most frequent words (2)."""

    def of(part: int, rows: list[tuple]) -> pa.RecordBatch:
        words, n, suffix = (np.frombuffer(b"".join(r[k] for r in rows), kind) for k, kind in ((1, np.uint64), (2, np.int32), (3, np.uint8)))
        seen, index, place = np.unique(words, return_index=True, return_inverse=True)
        total = np.bincount(place, n, len(seen)).astype(np.int64)
        known, size, at = total > 0, [len(r[1]) // 8 for r in rows], 0
        out = []
        for (chunk, *_), k in zip(rows, size):
            out.append((0, chunk, part, total[place[at : at + k]].tobytes(), 0, 0, 0))
            at += k
        kinds = suffix[index].astype(np.int64)
        sums, distinct = np.bincount(kinds, total, SUFFIX_CLASSES), np.bincount(kinds[known], minlength=SUFFIX_CLASSES)
        out += [(1, 0, part, b"", int(k), int(sums[k]), int(distinct[k])) for k in np.flatnonzero(distinct)]
        top = np.flatnonzero(known)[np.lexsort((seen[known], -total[known]))[:VOCABULARY]]
        out += [(2, 0, part, b"", int(seen[k].astype(np.int64)), int(total[k]), int(kinds[k])) for k in top]
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate((pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.int64()))], names=["kind", "chunk", "part", "totals", "key", "n", "m"])

    part, held = None, []
    for batch in batches:
        for chunk, p, words, n, suffix in zip(*(c.to_pylist() for c in S.fields(batch, "chunk", "part", "words", "n", "suffix"))):
            if p != part and held:
                yield of(part, held)
                held = []
            part = p
            held.append((chunk, words, n, suffix))
    if held:
        yield of(part, held)


@dataclass
class Model:
    """words: hashes of the vocabulary, ordered by class; edges: where each class begins in it; share[k]: log10 of 1 / add-one total of suffix class k.

    weights holds the class table, by feature bucket and at last the bias, the hashed word table, and the words' biases.
    """

    words: np.ndarray
    edges: np.ndarray
    share: np.ndarray
    weights: np.ndarray

    def __post_init__(self):
        self.order = np.argsort(self.words)
        self.ordered = self.words[self.order]
        self.of = np.searchsorted(self.edges, np.arange(len(self.words)), "right") - 1
        self.class_weights = self.weights[:_CLASS_TABLE].reshape(-1, CLASSES)
        self.word_weights = self.weights[_CLASS_TABLE : _CLASS_TABLE + _WORD_TABLE]
        self.word_bias = self.weights[_CLASS_TABLE + _WORD_TABLE :]

    def places(self, hashes: np.ndarray) -> np.ndarray:
        """Place of each word in the vocabulary, -1 for others."""
        if not len(self.words) or not len(hashes):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.ordered, hashes), len(self.words) - 1)
        return np.where(self.ordered[at] == hashes, self.order[at], -1)


def vocabulary_classes(counts: np.ndarray) -> np.ndarray:
    """Where each word class begins among words ordered by falling counts: even parts of the sum of their square roots."""
    mass = np.cumsum(np.sqrt(counts))
    edges = np.searchsorted(mass, mass[-1] * np.arange(WORD_CLASSES) / WORD_CLASSES, "left") if len(counts) else np.zeros(WORD_CLASSES, np.int64)
    return np.maximum.accumulate(edges)


@dataclass
class Tokens:
    """All tokens of some texts, ends included: class, place in the vocabulary or -1, feature buckets, text."""

    kind: np.ndarray
    place: np.ndarray
    features: np.ndarray  # (FEATURES, tokens), each in its own range of buckets
    text: np.ndarray


def histories(model: Model, hashes: np.ndarray, suffix: np.ndarray, first: np.ndarray) -> Tokens:
    """Tokens of the words of texts first[i]:first[i+1]. A word outside the vocabulary counts as its suffix class in histories."""
    n = np.diff(first)
    last = np.cumsum(n + 1) - 1
    total = len(hashes) + len(n)
    word = np.ones(total, bool)
    word[last] = False
    found = model.places(hashes)
    place, kind = np.full(total, -1), np.full(total, END_CLASS)
    place[word] = found
    own = WORD_CLASSES + suffix.astype(np.int64)
    kind[word] = np.where(found >= 0, model.of[found], own) if len(model.words) else own
    name = np.zeros(total, np.uint64)  # 0 stands for the beginning of a text
    name[word] = 1 + np.where(found >= 0, found + SUFFIX_CLASSES, suffix).astype(np.uint64)
    at = np.arange(total) - np.repeat(last - n, n + 1)
    back = []
    for k in (1, 2, 3):
        x = np.zeros(total, np.uint64)
        x[k:] = name[:-k] if total > k else 0
        x[at < k] = 0
        back.append(x)
    keys = [*back, back[0] * np.uint64(1 << 20) + back[1]]
    features = np.stack([(S.mix(x + np.uint64(k << 50)) % np.uint64(BUCKETS)).astype(np.int64) + k * BUCKETS for k, x in enumerate(keys)])
    return Tokens(kind, place, features, np.repeat(np.arange(len(n)), n + 1))


_FEATURE_CELLS = (S.mix(np.arange(FEATURES * BUCKETS, dtype=np.uint64)) >> np.uint64(64 - WORD_BITS)).astype(np.int64)
_WORD_CELLS = (S.mix(np.arange(VOCABULARY, dtype=np.uint64) + np.uint64(1 << 40)) >> np.uint64(64 - WORD_BITS)).astype(np.int64)


def class_logits(model: Model, features: np.ndarray) -> np.ndarray:
    out = np.take(model.class_weights, features[0], axis=0)
    out += model.class_weights[-1]
    for f in features[1:]:
        out += np.take(model.class_weights, f, axis=0)
    return out


def word_cells(feature: np.ndarray, lo: int, hi: int) -> np.ndarray:
    """(tokens, hi - lo): cells of the word table for one feature of each token and each word of a class."""
    return _FEATURE_CELLS[feature][:, None] ^ _WORD_CELLS[lo:hi]


def word_logits(model: Model, features: np.ndarray, lo: int, hi: int) -> np.ndarray:
    out = np.tile(model.word_bias[lo:hi], (features.shape[1], 1))
    for f in features:
        out += np.take(model.word_weights, word_cells(f, lo, hi))
    return out


def _normalised(x: np.ndarray) -> np.ndarray:
    """Logs of the sums of exponentials; x becomes the exponentials, from each row's largest value on."""
    top = x.max(1, keepdims=True)
    x -= top
    np.exp(x, out=x)
    return np.log(x.sum(1)) + top[:, 0]


def _softmax(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(probabilities, logs of the sums); x is overwritten."""
    norm = _normalised(x)
    x /= x.sum(1, keepdims=True)
    return x, norm


def _by_class(model: Model, t: Tokens) -> Iterator[tuple[np.ndarray, int, int]]:
    """(tokens, first word, end): tokens of each class of several vocabulary words."""
    inside = np.flatnonzero(t.place >= 0)
    order = inside[np.argsort(t.kind[inside].astype(np.uint8), kind="stable")]
    cut = np.searchsorted(t.kind[order], np.arange(WORD_CLASSES + 1))
    edges = np.append(model.edges, len(model.words))
    for k in range(WORD_CLASSES):
        if cut[k + 1] > cut[k] and edges[k + 1] - edges[k] > 1:
            yield order[cut[k] : cut[k + 1]], int(edges[k]), int(edges[k + 1])


def log_probabilities(model: Model, t: Tokens) -> np.ndarray:
    """Natural logs of P(class | history), times P(word | class, history) for words of the vocabulary."""
    x = class_logits(model, t.features)
    out = x[np.arange(len(t.kind)), t.kind]
    out -= _normalised(x)
    for some, lo, hi in _by_class(model, t):
        x = word_logits(model, t.features[:, some], lo, hi)
        out[some] += x[np.arange(len(some)), t.place[some] - lo]
        out[some] -= _normalised(x)
    return out


def _add_sums(model: Model, t: Tokens, observed: np.ndarray, expected: np.ndarray) -> float:
    """Add the tokens' observed and expected counts of all weights; their log likelihood so far."""
    x = class_logits(model, t.features)
    likelihood = float(x[np.arange(len(t.kind)), t.kind].sum(dtype=np.float64))
    p, norm = _softmax(x)
    likelihood -= float(norm.sum(dtype=np.float64))
    seen, due = (v[:_CLASS_TABLE].reshape(-1, CLASSES) for v in (observed, expected))
    by_class = np.ascontiguousarray(p.T, np.float64)
    for k, f in enumerate(t.features):
        rows = slice(k * BUCKETS, (k + 1) * BUCKETS)
        seen[rows] += np.bincount((f - k * BUCKETS) * CLASSES + t.kind, minlength=BUCKETS * CLASSES).reshape(BUCKETS, CLASSES)
        due[rows] += np.stack([np.bincount(f - k * BUCKETS, weights, minlength=BUCKETS) for weights in by_class], 1)
    seen[-1] += np.bincount(t.kind, minlength=CLASSES)
    due[-1] += p.sum(0, dtype=np.float64)

    words, bias = slice(_CLASS_TABLE, _CLASS_TABLE + _WORD_TABLE), _CLASS_TABLE + _WORD_TABLE
    classes = []
    for some, lo, hi in _by_class(model, t):
        x = word_logits(model, t.features[:, some], lo, hi)
        own = t.place[some] - lo
        likelihood += float(x[np.arange(len(some)), own].sum(dtype=np.float64))
        p, norm = _softmax(x)
        likelihood -= float(norm.sum(dtype=np.float64))
        observed[bias + lo : bias + hi] += np.bincount(own, minlength=hi - lo)
        expected[bias + lo : bias + hi] += p.sum(0, dtype=np.float64)
        classes.append((some, lo, hi, p))
    if classes:
        # one sum over the table for all classes together
        weights = np.concatenate([p.ravel() for *_, p in classes])
        all_of = np.concatenate([some for some, *_ in classes])
        for f in t.features:
            expected[words] += np.bincount(np.concatenate([word_cells(f[some], lo, hi).ravel() for some, lo, hi, _ in classes]), weights, minlength=_WORD_TABLE)
            observed[words] += np.bincount(_FEATURE_CELLS[f[all_of]] ^ _WORD_CELLS[t.place[all_of]], minlength=_WORD_TABLE)
    return likelihood


def _pieces(hashes: np.ndarray, suffix: np.ndarray, first: np.ndarray) -> Iterator[tuple[slice, np.ndarray]]:
    """(texts, their first words) of about TOKENS_AT_ONCE tokens."""
    some, n = 0, len(first) - 1
    while some < n:
        to = min(max(some + 1, int(np.searchsorted(first, first[some] + TOKENS_AT_ONCE))), n)
        yield slice(some, to), first[some : to + 1]
        some = to


def _spans(t: Tokens) -> Iterator[Tokens]:
    """Tokens some at a time, so that a long text takes no more memory than others."""
    for i in range(0, len(t.kind), TOKENS_AT_ONCE):
        s = slice(i, i + TOKENS_AT_ONCE)
        yield Tokens(t.kind[s], t.place[s], t.features[:, s], t.text[s])


def _sums(shared):
    """Observed and expected counts of a task's texts, as those pieces that aren't 0; piece -1 has tokens and log likelihood."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        observed, expected = np.zeros(_SIZE), np.zeros(_SIZE)
        n, likelihood = 0, 0.0
        for b in S.blocks(batches):
            hashes, suffix, first = tokens(b.buf, b.off)
            for _, words in _pieces(hashes, suffix, first):
                t = histories(model, hashes[words[0] : words[-1]], suffix[words[0] : words[-1]], words - words[0])
                n += len(t.kind)
                for part in _spans(t):
                    likelihood += _add_sums(model, part, observed, expected)
        at = [k for k in range(-(-_SIZE // _PIECE)) if expected[k * _PIECE : (k + 1) * _PIECE].any()]
        pack = lambda x: [x[k * _PIECE : (k + 1) * _PIECE].astype(np.float32).tobytes() for k in at]
        told = np.array([n, likelihood]).tobytes()
        yield pa.RecordBatch.from_arrays([pa.array([*at, -1], pa.int32()), pa.array([*pack(observed), told], pa.binary()), pa.array([*pack(expected), told], pa.binary())], names=["piece", "observed", "expected"])

    return run


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, list[np.ndarray]] = {}
    for batch in batches:
        for piece, *sums in zip(*(c.to_pylist() for c in S.fields(batch, "piece", "observed", "expected"))):
            own = [np.frombuffer(x, np.float32 if piece >= 0 else np.float64).astype(np.float64) for x in sums]
            total[piece] = [x + y for x, y in zip(total[piece], own)] if piece in total else own
    columns = [pa.array(list(total), pa.int32()), *(pa.array([x[k].tobytes() for x in total.values()], pa.binary()) for k in range(2))]
    yield pa.RecordBatch.from_arrays(columns, names=["piece", "observed", "expected"])


_SUMS = "piece int, observed binary, expected binary"


def gathered(texts: DataFrame, model: Model) -> tuple[np.ndarray, np.ndarray, int, float]:
    """(observed, expected, tokens, log likelihood) over all rows of texts(text); the driver gets one vector of the weights' size."""
    spark = texts.sparkSession
    shared = spark.sparkContext.broadcast(model)
    sums = texts.mapInArrow(_sums(shared), _SUMS).repartition(S.n_tasks(spark), "piece").mapInArrow(_summed, _SUMS)
    out, told = [np.zeros(_SIZE), np.zeros(_SIZE)], np.zeros(2)
    for r in sums.toLocalIterator():
        if r["piece"] < 0:
            told = np.frombuffer(r["observed"])
            continue
        for vector, sums_ in zip(out, (r["observed"], r["expected"])):
            own = np.frombuffer(sums_)
            vector[r["piece"] * _PIECE : r["piece"] * _PIECE + len(own)] = own
    shared.destroy()
    S.release(spark)
    return out[0], out[1], int(told[0]), float(told[1])


def start(words: np.ndarray, counts: np.ndarray, class_counts: np.ndarray, share: np.ndarray) -> Model:
    """The model before training: histories tell nothing, classes and words have their add-one shares."""
    weights = np.zeros(_SIZE, np.float32)
    edges = vocabulary_classes(counts)
    of = np.searchsorted(edges, np.arange(len(words)), "right") - 1
    whole = class_counts.astype(np.float64)
    np.add.at(whole, of, counts)
    weights[_CLASS_TABLE - CLASSES : _CLASS_TABLE] = np.log((whole + 1) / (whole.sum() + CLASSES))
    weights[_CLASS_TABLE + _WORD_TABLE :][: len(words)] = np.log(counts + 1.0)
    return Model(words, edges, share, weights)


def train(parts: list[DataFrame], model: Model) -> Model:
    """A gradient step for each of the parts, frames of text; their rows are all training rows, each in one part."""
    rate, before = RATE, -np.inf
    for texts in parts:
        observed, expected, n, likelihood = gathered(texts, model)
        if not n:
            continue
        if likelihood / n < before:
            rate /= 2
        before = likelihood / n
        step = rate * (observed - expected) / (np.maximum(observed, expected) + DAMP)
        model = Model(model.words, model.edges, model.share, (model.weights + np.clip(step, -LARGEST, LARGEST)).astype(np.float32))
    return model


def text_scores(model: Model, hashes: np.ndarray, suffix: np.ndarray, first: np.ndarray, c: np.ndarray) -> np.ndarray:
    """log10 probability of each text; c: training counts of its words."""
    score = np.zeros(len(first) - 1)
    for texts, words in _pieces(hashes, suffix, first):
        i, j = words[0], words[-1]
        t = histories(model, hashes[i:j], suffix[i:j], words - i)
        log_p = np.concatenate([log_probabilities(model, part) for part in _spans(t)]) / np.log(10)
        is_word = np.ones(len(t.kind), bool)
        is_word[np.cumsum(np.diff(words) + 1) - 1] = False
        inside = np.zeros(len(t.kind))
        inside[is_word] = np.log10(c[i:j] + 1.0)
        shared = is_word & (t.place < 0)
        inside = np.where(shared, inside + model.share[np.clip(t.kind - WORD_CLASSES, 0, SUFFIX_CLASSES - 1)], 0.0)
        score[texts] = np.bincount(t.text, log_p + inside, texts.stop - texts.start)
    return score


def _score(shared, parts: int, n_train: int, n_distinct: int, n_ends: int):
    def run(docs: pa.Table, totals: pa.Table) -> pa.Table:
        totals = totals.sort_by("part")
        counts = np.frombuffer(b"".join(totals.column("totals").to_pylist()), np.int64)
        hashes, suffix, first = _text_tokens(docs)
        _, _, _, place = _vocabulary(hashes, parts)
        c = counts[place] if len(place) else np.zeros(0, np.int64)
        n = np.diff(first)
        base = S.per_text(np.log10((c + 1.0) / (n_train + n_distinct + 1)), first) + np.log10((n_ends + 1.0) / (n_train + n_distinct + 1))
        score = text_scores(shared.value, hashes, suffix, first, c)
        known = S.per_text(c > 0, first) + (n_ends > 0)
        return pa.table([docs.column("doc_id"), docs.column("held_out"), pa.array(n + 1), pa.array(known), pa.array(np.full(len(n), n_train)), pa.array(base), pa.array(score)], names=[x.split()[0] for x in SCHEMA.split(", ")])

    return run


def lm_scores(docs: DataFrame, batches: int = BATCHES) -> DataFrame:
    """SCHEMA for each row of docs(doc_id, text); learns from the rows outside the held-out fold. No batches: no training.

    A null text is empty and has the end alone. Repeated rows count and are scored each; a null doc_id stays
    null; other columns are ignored; an empty table gives an empty result. Without training rows all counts
    are 0 and the classes equally likely.
    """
    spark, tasks = docs.sparkSession, S.n_tasks(docs.sparkSession)
    scratch = S.Scratch(spark)
    held_out = S.crc_of_id(F.col("doc_id")) % FOLDS == HELD_OUT
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", held_out.alias("held_out"))
    size, n_ends, n_rows = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.coalesce(F.sum((~F.col("held_out")).cast("long")), F.lit(0)), F.count("*")).first()
    chunks = max(1, -(-size // CHUNK_BYTES), -(-n_rows // (CHUNK_BYTES // 64)))
    # dealt once and written: a row's number spreads equal rows, and would not be the same in a second reading
    number = F.monotonically_increasing_id()
    dealt = rows.select("*", F.pmod(F.xxhash64("text", number), F.lit(chunks)).cast("int").alias("chunk"), F.pmod(F.xxhash64(number, F.lit(1)), F.lit(max(batches, 1))).cast("int").alias("batch"))
    dealt = scratch.settle(dealt, "dealt", by=("batch",))
    sent = dealt.groupBy("chunk").applyInArrow(_send(chunks), "chunk int, part int, words binary, n binary, suffix binary")
    totals = sent.repartition(tasks, "part").sortWithinPartitions("part")
    totals = scratch.settle(totals.mapInArrow(_total, "kind int, chunk int, part int, totals binary, key long, n long, m long"), "word-totals")

    sums = totals.where("kind = 1").groupBy("key").agg(F.sum("n").alias("n"), F.sum("m").alias("m")).collect()  # SUFFIX_CLASSES rows
    top = totals.where("kind = 2").select("key", "n", "m").orderBy(F.desc("n"), "key").limit(VOCABULARY).collect()
    n_train, n_distinct = sum(r["n"] for r in sums) + n_ends, sum(r["m"] for r in sums) + (n_ends > 0)
    of_class, class_counts = np.ones(SUFFIX_CLASSES), np.zeros(CLASSES, np.int64)  # the one is for words that training doesn't know
    class_counts[END_CLASS] = n_ends
    for r in sums:
        of_class[r["key"]] += r["n"] + r["m"]
        class_counts[WORD_CLASSES + r["key"]] += r["n"]
    for r in top:
        of_class[r["m"]] -= r["n"] + 1
        class_counts[WORD_CLASSES + r["m"]] -= r["n"]
    model = start(np.array([r["key"] for r in top], np.int64).astype(np.uint64), np.array([r["n"] for r in top], np.int64), class_counts, -np.log10(of_class))
    model = train([dealt.where(~F.col("held_out") & (F.col("batch") == k)).select("text") for k in range(batches)], model)

    counts = totals.where("kind = 0").select("chunk", "part", "totals")
    shared = spark.sparkContext.broadcast(model)  # the weights: a fixed size
    return dealt.groupBy("chunk").cogroup(counts.groupBy("chunk")).applyInArrow(_score(shared, chunks, n_train, n_distinct, n_ends), SCHEMA)
