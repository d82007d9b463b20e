"""Language identification by prediction by partial matching.

Each language has a byte context tree of depths 0 to ORDER with frozen counts. A byte's code length under a
language is exact: the longest context seen in training codes the byte or an escape (method C: one count for
each distinct follower), shorter contexts leave out what longer ones already ruled out, and below depth 0 the
bytes never seen share what is left evenly. So for any context the 256 code lengths satisfy Kraft's equality.
A text's language is the one with the shortest code.

Code lengths are a function of (context, byte) alone, hence they are computed once for each gram and looked
up for whole blocks of text at once; grams that no language has seen go through the trees themselves.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared as S

ORDER = 3
#: Bytes of distinct training texts for each language, whole texts only; longer texts are not trained on.
TRAIN_BYTES = 1_000_000
UNDETERMINED = "und"
#: A code of this many bits a byte or more compresses nothing.
INCOMPRESSIBLE = 8.0
SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double, bits_per_byte double"


def _mask(n_bytes: int) -> np.uint64:
    return np.uint64((1 << (8 * n_bytes)) - 1)


def grams(buf: np.ndarray, off: np.ndarray, order: int) -> np.ndarray:
    """For each byte, its `order` predecessors in its text (zero bytes before the start) and itself, as one number."""
    key = buf.astype(np.uint64)
    for k in range(1, order + 1):
        key[k:] |= buf[:-k].astype(np.uint64) << np.uint64(8 * k)
    starts = off[:-1][np.diff(off) > 0]
    for k in range(order):
        at = starts + k
        at = at[at < np.append(starts[1:], len(buf))]
        key[at] &= _mask(k + 1)
    return key


@dataclass
class Tree:
    """A language's counts. For depth k: grams[k] (context and byte) with count[k]; contexts ctx[k] with total n[k]
    and distinct followers d[k]; inherited[k]: of these followers, their total count one depth up."""

    grams: list[np.ndarray] = field(default_factory=list)
    count: list[np.ndarray] = field(default_factory=list)
    ctx: list[np.ndarray] = field(default_factory=list)
    n: list[np.ndarray] = field(default_factory=list)
    d: list[np.ndarray] = field(default_factory=list)
    inherited: list[np.ndarray] = field(default_factory=list)

    @classmethod
    def grown(cls, keys: np.ndarray, counts: np.ndarray, order: int) -> Tree:
        tree = cls()
        for k in range(order + 1):
            seen, place = np.unique(keys & _mask(k + 1), return_inverse=True)
            count = np.bincount(place, counts, len(seen))
            ctx, owner = np.unique(seen >> np.uint64(8), return_inverse=True)
            up = np.zeros(len(ctx))
            if k:
                up = np.bincount(owner, tree.count[k - 1][np.searchsorted(tree.grams[k - 1], seen & _mask(k))], len(ctx))
            for column, values in ((tree.grams, seen), (tree.count, count), (tree.ctx, ctx), (tree.n, np.bincount(owner, count, len(ctx))), (tree.d, np.bincount(owner, minlength=len(ctx)).astype(float)), (tree.inherited, up)):
                column.append(values)
        return tree

    def bits(self, keys: np.ndarray) -> np.ndarray:
        """Code length of each gram's last byte after the bytes before it."""
        cost, left = np.zeros(len(keys)), np.arange(len(keys))
        den, ruled_out = np.full(len(keys), -1.0), np.zeros(len(keys))  # den < 0: no context so far
        for k in range(len(self.grams) - 1, -1, -1):
            if not len(left):
                break
            g = keys[left] & _mask(k + 1)
            at = np.minimum(np.searchsorted(self.ctx[k], g >> np.uint64(8)), len(self.ctx[k]) - 1)
            known = self.ctx[k][at] == g >> np.uint64(8)
            i, at, g = left[known], at[known], g[known]
            longer = den[i] >= 0
            below = np.where(longer, self.n[k][at] - den[i] + self.d[k][at] - ruled_out[i], self.n[k][at] + self.d[k][at])
            s = np.minimum(np.searchsorted(self.grams[k], g), len(self.grams[k]) - 1)
            hit = self.grams[k][s] == g
            cost[i[hit]] += np.log2(below[hit] / self.count[k][s[hit]])
            novel = (self.d[k][at] - ruled_out[i]) * ~hit
            esc = novel > 0
            cost[i[esc]] += np.log2(below[esc] / novel[esc])
            miss = ~hit
            den[i[miss]] = self.inherited[k][at[miss]]
            ruled_out[i[miss]] = self.d[k][at[miss]]
            left = np.concatenate((left[~known], i[miss]))
        cost[left] += np.log2(256 - (self.d[0][0] if len(self.d[0]) else 0))
        return cost


@dataclass
class Model:
    langs: list[str]
    trees: list[Tree]
    order: int = ORDER
    keys: np.ndarray = None
    costs: np.ndarray = None
    slots: list = None

    def prepared(self) -> Model:
        """With the code lengths of all grams that any language has seen, behind two hash tables."""
        if self.slots is None:
            self.keys = np.unique(np.concatenate([t.grams[self.order] for t in self.trees]))
            self.costs = np.stack([t.bits(self.keys) for t in self.trees], 1).astype(np.float32)
            self.slots, self.shift = [], 64 - max(12, int(np.log2(max(len(self.keys), 1))) + 4)
            todo = np.arange(len(self.keys))
            for factor in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F):
                table, at = np.zeros(1 << (64 - self.shift), np.int32), (self.keys[todo] * np.uint64(factor)) >> np.uint64(self.shift)
                table[at] = todo
                self.slots.append((np.uint64(factor), table))
                todo = todo[table[at] != todo]
        return self

    def bits(self, key: np.ndarray) -> np.ndarray:
        """Code lengths, one row for each gram and one column for each language."""
        shift = np.uint64(self.shift)
        factor, table = self.slots[0]
        at = table[(key * factor) >> shift]
        miss = np.flatnonzero(self.keys[at] != key)
        factor, table = self.slots[1]
        at[miss] = table[(key[miss] * factor) >> shift]
        out = self.costs[at]
        miss = miss[self.keys[at[miss]] != key[miss]]
        if len(miss):
            rare, place = np.unique(key[miss], return_inverse=True)
            out[miss] = np.stack([t.bits(rare) for t in self.trees], 1)[place]
        return out

    def text_bits(self, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Code length of each whole text under each language."""
        out = np.zeros((len(off) - 1, len(self.langs)))
        full = np.diff(off) > 0
        if full.any():
            out[full] = np.add.reduceat(self.bits(grams(buf, off, self.order)), off[:-1][full], axis=0, dtype=np.float64)
        return out


def _count(order: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in S.blocks(batches):
            lang = np.asarray(S.fields(b.rows, "lang")[0].to_pylist(), object)
            key, owner = grams(b.buf, b.off, order), np.repeat(lang, np.diff(b.off))
            for one in dict.fromkeys(lang.tolist()):
                seen, n = np.unique(key[owner == one], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([one] * len(seen), pa.string()), pa.array(seen.astype(np.int64)), pa.array(n)], names=["lang", "gram", "n"])

    return run


def train(docs: DataFrame, order: int = ORDER, train_bytes: int = TRAIN_BYTES) -> Model:
    """Fit on docs(text, lang): distinct texts drawn by their hash, about train_bytes of them for each language.

    The sample is bounded by train_bytes and so are the counts that reach the driver, at most one for each
    byte. Rows with a null text or language, and texts longer than train_bytes, are not used.
    """
    if order > 6:
        raise ValueError("grams of more than seven bytes don't fit a long")
    size = F.octet_length("text")
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (size <= train_bytes) & (size > 0)).select("text", "lang", size.alias("size"))
    totals = rows.groupBy("lang").agg(F.sum("size").alias("total")).collect()
    if not totals:
        return Model([], [], order)
    draw = F.pmod(F.xxhash64("text"), F.lit(1 << 30)) / float(1 << 30)
    rate = F.create_map(*[x for r in totals for x in (F.lit(r["lang"]), F.lit(min(1.0, 1.1 * train_bytes / r["total"])))])
    drawn = rows.where(draw < rate[F.col("lang")]).dropDuplicates(["lang", "text"])
    counted = drawn.mapInArrow(_count(order), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    pdf = counted.toPandas()
    langs = sorted(pdf["lang"].unique())
    trees = [Tree.grown(p["gram"].to_numpy(np.int64).astype(np.uint64), p["n"].to_numpy(float), order) for p in (pdf[pdf["lang"] == x] for x in langs)]
    return Model(langs, trees, order)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """Language of each row of docs(doc_id, text, held_out): (doc_id, held_out, lang_pred, score, bits_per_byte).

    score is the posterior of the best language with all languages equally likely beforehand. A null or empty
    text, one without a letter, and any text under a model without languages get `und`, score 0 and null bits.
    Repeated rows are each judged, a null doc_id stays null, other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = [x.split()[0] for x in SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        if m.langs:
            m.prepared()
        for b in S.blocks(batches):
            doc_id, held_out, letter = S.fields(b.rows, "doc_id", "held_out", "letter")
            if not m.langs:
                yield pa.RecordBatch.from_arrays([doc_id, held_out, pa.array([UNDETERMINED] * b.n), pa.array(np.zeros(b.n)), pa.nulls(b.n, pa.float64())], names=names)
                continue
            bits, known = m.text_bits(b.buf, b.off), np.asarray(letter)
            best = bits.min(1)
            score = 1 / np.exp2(np.maximum(best[:, None] - bits, -1000)).sum(1)
            langs = np.where(known, np.asarray(m.langs, object)[bits.argmin(1)], UNDETERMINED)
            rate = pa.array(best / np.maximum(np.diff(b.off), 1), mask=~known)
            yield pa.RecordBatch.from_arrays([doc_id, held_out, pa.array(langs, pa.string()), pa.array(np.where(known, score, 0.0)), rate], names=names)

    letter = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letter")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "held_out", letter).mapInArrow(run, SCHEMA)


def language_id(docs: DataFrame, folds: int = 5) -> DataFrame:
    """Train on the rows of docs(doc_id, text, lang) whose crc_of_id mod folds is not 0, then identify all rows."""
    held_out = S.crc_of_id(F.col("doc_id")) % folds == 0
    model = train(docs.where(~held_out))
    return identify(docs.select("doc_id", "text", held_out.alias("held_out")), model)


def accepted(docs: DataFrame, folds: int = 5) -> DataFrame:
    """The rows of docs that have a language and that its model compresses at all; columns as they were.

    Each row is judged by its own text, in one pass without a shuffle. Under a model without languages none stays.
    """
    model = train(docs.where(S.crc_of_id(F.col("doc_id")) % folds != 0))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    columns, letter = docs.columns, "letter"
    while letter in columns:
        letter += "_"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        if m.langs:
            m.prepared()
        for b in S.blocks(batches):
            keep = np.asarray(S.fields(b.rows, letter)[0])
            if m.langs:
                keep = keep & (m.text_bits(b.buf, b.off).min(1) < INCOMPRESSIBLE * np.diff(b.off))
            else:
                keep = np.zeros(b.n, bool)
            yield b.rows.select(columns).filter(pa.array(keep))

    has_letter = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    return docs.withColumn(letter, has_letter).mapInArrow(run, docs.schema)
