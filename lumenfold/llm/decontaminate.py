"""Benchmark decontamination by CGK embedding and bit-sampling LSH.

Texts and items are lower-cased and reduced to runs of letters, digits and non-ASCII bytes, one space apart.
An item leaks into a text if some substring of the text is within MAX_EDIT of the item's bytes in edit
distance. An item that may have e edits is cut into e + 1 pieces of bytes, of which one at least stays as it is.
More than that: of two neighbouring pieces somewhere, one is as it was and the other has one edit at most (or the
last piece, if it has no neighbour, is as it was), or the edits would be more than e. Item-sized windows are taken
wherever a text has a piece so, aligned as the item has it, so no leak is without a window. A random walk embeds a window: at every step it writes the byte it stands on, and a random
function of step and byte says whether it moves on; edit distance becomes Hamming distance. LSH repetitions
sample few places of the embeddings; a window that agrees with its item in all places of any repetition is a
candidate, and the exact edit distance decides. How many repetitions there are follows from the target recall; as no
leak is without a window, they alone decide what is missed.

The items are sent to the tasks in slices of at most SLICE items and SLICE_BYTES bytes, one pass over the
texts for each slice, so what is broadcast has a fixed bound however large the benchmark is.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared as S

MAX_EDIT = 0.10
#: Walks, and sampled places of a repetition.
WALKS, PLACES = 4, 3
#: What share of the leaks is to be found, and the share of places in which a leak's embedding agrees with its item's. Measured on
#: items of 16 to 59 words with MAX_EDIT of random edits: nine leaks in ten agree in all places of five repetitions in a hundred.
TARGET_RECALL, AGREEMENT = 0.99, 0.37
SLICE, SLICE_BYTES = 20_000, 16 << 20
SCHEMA = "doc_id long, item_id long, edits int, item_bytes int"
_PAD, _MOST_WINDOWS, _MOST_PLACED = 0, 2000, 1 << 18
#: Bytes of embeddings that are held at a time, and steps of a walk whose moves are.
_MOST_HELD, _SLAB = 32 << 20, 1024


def repetitions(target_recall: float = TARGET_RECALL) -> int:
    """Repetitions on each walk so that a leak agrees with its item in all places of one with this probability at least."""
    whole = math.log(1 - target_recall) / math.log(1 - AGREEMENT**PLACES)
    return max(1, math.ceil(whole / WALKS))

_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def normalised(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Block of the texts' words in lower case, each with one space before it unless the text begins with it."""
    word = _WORD[buf]
    keep = word.copy()
    keep[:-1] |= ~word[:-1] & word[1:]
    last = off[1:][off[1:] > off[:-1]] - 1
    keep[last] &= word[last]
    out = np.where(word, S._LOWER[buf], 32).astype(np.uint8)[keep]
    return out, np.concatenate(([0], np.cumsum(keep, dtype=np.int64)))[off]


@dataclass
class Items:
    """A slice of the benchmark: normalised bytes, seeds, and LSH keys of the embeddings."""

    ids: np.ndarray
    bodies: list[bytes]
    target_recall: float = TARGET_RECALL

    def prepared(self) -> Items:
        if hasattr(self, "seeds"):
            return self
        self.size = size = np.array([len(b) for b in self.bodies], np.int64)
        buf, off = np.frombuffer(b"".join(self.bodies), np.uint8), np.concatenate(([0], np.cumsum(size)))
        self.most = np.array([int(MAX_EDIT * n) for n in size], np.int64)
        self.seeds = _pieces(_grams(buf), off, size, self.most + 1)
        rng = np.random.default_rng(20_130_217)
        # a walk takes two steps a byte on average, so places are drawn from the first 2 * size of them
        self.share = rng.random((WALKS, repetitions(self.target_recall), PLACES))
        self.keys = np.zeros((len(size), *self.share.shape), np.uint8)
        for some in self.by_size(np.arange(len(size))):
            self.keys[some] = self.sampled(_matrix(buf, off[some], size[some], int(size[some].max())), some)
        return self

    def by_size(self, item: np.ndarray) -> Iterator[np.ndarray]:
        """Where items of like sizes are, some at a time, so that their embeddings take a bounded number of bytes, or are one."""
        order = np.argsort(self.size[item], kind="stable")
        done = 0
        while done < len(order):
            to = min(done + _MOST_WINDOWS, len(order))
            while to > done + 1 and (to - done) * 2 * int(self.size[item[order[to - 1]]]) > _MOST_HELD:
                to = done + (to - done) // 2
            yield order[done:to]
            done = to

    @staticmethod
    def _moves(walk: int, slab: int) -> np.ndarray:
        """Whether a walk moves on, by step of a slab and byte; made anew for each slab, so that no table grows with the items."""
        return np.random.default_rng([20_130_217, walk, slab]).integers(0, 2, (_SLAB, 256)).astype(np.int64)

    def sampled(self, rows: np.ndarray, item: np.ndarray) -> np.ndarray:
        """The sampled bytes of the embeddings of rows, at the places of their items."""
        n, width = rows.shape
        flat, base = rows.ravel(), np.arange(n) * width
        out = np.empty((n, *self.share.shape), np.uint8)
        steps = int(2 * self.size[item].max(initial=1))
        wrote = np.empty((steps, n), np.uint8)
        for w in range(WALKS):
            at = base.copy()
            for step in range(steps):
                if step % _SLAB == 0:
                    moves = self._moves(w, step // _SLAB)
                byte = flat[at]
                wrote[step] = byte
                at += moves[step % _SLAB][byte]
                np.minimum(at, base + width - 1, out=at)
            places = (self.share[w][None] * (2 * self.size[item])[:, None, None]).astype(np.int64)
            out[:, w] = wrote[places, np.arange(n)[:, None, None]]
        return out


_MASK = np.array([0, *((1 << 8 * q) - 1 for q in range(1, 9))], np.uint64)
_SEEN_BITS = 22


def _grams(buf: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place on as one number, the first one lowest; zeros follow the end."""
    out = np.concatenate((buf, np.zeros(8, np.uint8))).astype(np.uint64)
    for k in (1, 2, 4):
        out[:-k] |= out[k:] << np.uint64(8 * k)
    return out[: len(buf)]


def _slot(gram: np.ndarray) -> np.ndarray:
    return (gram * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _SEEN_BITS)


@dataclass
class Seeds:
    """Pieces of items whose first q bytes are looked for; row k of begin and many says where key k has its pieces.

    A piece has its item, its place there, its size and its last q bytes; then for its neighbour's near half and
    far half the distance, the size (0 if there is no neighbour) and the bytes.
    """

    q: int
    seen: np.ndarray
    keys: np.ndarray
    begin: np.ndarray
    many: np.ndarray
    item: np.ndarray
    at: np.ndarray
    size: np.ndarray
    tail: np.ndarray
    near: tuple[np.ndarray, np.ndarray, np.ndarray]
    far: tuple[np.ndarray, np.ndarray, np.ndarray]


def _pieces(grams: np.ndarray, off: np.ndarray, size: np.ndarray, pieces: np.ndarray) -> list[Seeds]:
    """The pieces of all items, by the bytes of their first gram."""
    item, k = np.repeat(np.arange(len(size)), pieces), S.ragged(pieces)
    m, n, base = size[item], pieces[item], off[item]
    at, end = k * m // n, (k + 1) * m // n
    other = k ^ 1
    has, after = other < n, other > k
    low, high = other * m // n, (other + 1) * m // n
    middle = np.where(after, low + (high - low) // 2, high - (high - low) // 2)
    halves = []
    for first, last in ((np.where(after, low, middle), np.where(after, middle, high)), (np.where(after, middle, low), np.where(after, high, middle))):
        long = np.where(has, last - first, 0)
        halves.append((np.where(has, first - at, 0), long, grams[np.where(has, base + first, 0)] & _MASK[long]))
    width, out = np.minimum(8, m // n), []
    for q in np.unique(width).tolist():
        some = np.flatnonzero(width == q)
        key = grams[base[some] + at[some]] & _MASK[q]
        order = np.argsort(key, kind="stable")
        some = some[order]
        keys, begin = np.unique(key[order], return_index=True)
        seen = np.zeros(1 << _SEEN_BITS, bool)
        seen[_slot(keys)] = True
        tail = grams[base[some] + end[some] - q] & _MASK[q]
        out.append(Seeds(q, seen, keys, begin, np.diff(np.append(begin, len(some))), item[some], at[some], (end - at)[some], tail, *(tuple(x[some] for x in h) for h in halves)))
    return out


def _placed(grams: np.ndarray, noff: np.ndarray, seeds: Seeds) -> Iterator[np.ndarray]:
    """(text, item, start) of the windows that pieces place in a block, some at a time."""
    own = grams & _MASK[seeds.q]
    maybe = np.flatnonzero(seeds.seen[_slot(own)])
    key = np.minimum(np.searchsorted(seeds.keys, own[maybe]), len(seeds.keys) - 1)
    hit = seeds.keys[key] == own[maybe]
    places, keys = maybe[hit], key[hit]
    total = np.cumsum(seeds.many[keys])
    done = 0
    while done < len(places):
        to = max(done + 1, int(np.searchsorted(total, (total[done - 1] if done else 0) + _MOST_PLACED, "right")))
        place, key = places[done:to], keys[done:to]
        done = to
        many = seeds.many[key]
        entry = np.repeat(seeds.begin[key], many) + S.ragged(many)
        text = np.searchsorted(noff, place, "right") - 1
        low, high = np.repeat(noff[text], many), np.repeat(noff[text + 1], many)
        place, text = np.repeat(place, many), np.repeat(text, many)

        def has(at, size, bytes_):
            inside = (at >= low) & (at + size <= high)
            return inside & (grams[np.where(inside, np.minimum(at, len(grams) - 1), 0)] & _MASK[size] == bytes_)

        keep = has(place + seeds.size[entry] - seeds.q, np.full(len(entry), seeds.q), seeds.tail[entry])
        entry, place, text, low, high = (x[keep] for x in (entry, place, text, low, high))
        near, far = ([x[entry] for x in h] for h in (seeds.near, seeds.far))
        keep = (near[1] == 0) | has(place + near[0], *near[1:])
        for shift in (-1, 0, 1):
            keep |= has(place + far[0] + shift, *far[1:])
        entry, place, text, low = (x[keep] for x in (entry, place, text, low))
        yield np.stack([text, seeds.item[entry], np.maximum(place - seeds.at[entry], low)], 1)


def _matrix(buf: np.ndarray, begin: np.ndarray, size: np.ndarray, width: int) -> np.ndarray:
    """Rows of buf from begin on, of the given sizes, padded."""
    out = np.full((len(begin), width + 1), _PAD, np.uint8)
    out[np.repeat(np.arange(len(begin)), size), S.ragged(size)] = buf[np.repeat(begin, size) + S.ragged(size)]
    return out


def edits_within(item: bytes, text: bytes) -> int:
    """Least edit distance of item to any substring of text, with bit vectors of the item's length."""
    ones = (1 << len(item)) - 1
    where: dict[int, int] = {}
    for k, c in enumerate(item):
        where[c] = where.get(c, 0) | 1 << k
    up, down, score = ones, 0, len(item)
    least, top = score, 1 << (len(item) - 1)
    for c in text:
        match = where.get(c, 0)
        diagonal = (((match & up) + up) ^ up) | match | down
        rise, fall = down | ~(diagonal | up) & ones, up & diagonal
        score += bool(rise & top) - bool(fall & top)
        least = min(least, score)
        rise, fall = rise << 1 & ones, fall << 1 & ones
        up, down = fall | ~(diagonal | rise) & ones, rise & diagonal
    return least


def leaks_of(buf: np.ndarray, off: np.ndarray, items: Items) -> list[tuple[int, int, int]]:
    """(text number, item number, edits) of the leaks in a block."""
    norm, noff = normalised(buf, off)
    grams = _grams(norm)
    window = np.unique(np.concatenate([np.zeros((0, 3), np.int64), *(w for seeds in items.seeds for w in _placed(grams, noff, seeds))]), axis=0)
    found: dict[tuple[int, int], int] = {}
    for some in items.by_size(window[:, 1]):
        text, item, begin = window[some].T
        size = np.minimum(items.size[item], noff[text + 1] - begin)
        sampled = items.sampled(_matrix(norm, begin, size, int(items.size[item].max())), item)
        near = (sampled == items.keys[item]).all(-1).any((1, 2))
        for t, j, b in zip(text[near].tolist(), item[near].tolist(), begin[near].tolist()):
            if found.get((t, j)) == 0:
                continue
            most = int(items.most[j])
            low, high = max(int(noff[t]), b - most), min(int(noff[t + 1]), b + int(items.size[j]) + most)
            edits = edits_within(items.bodies[j], norm[low:high].tobytes())
            if edits <= most and edits < found.get((t, j), most + 1):
                found[t, j] = edits
    return [(t, j, e) for (t, j), e in found.items()]


def _slices(benchmark: DataFrame, target_recall: float) -> Iterator[Items]:
    """The benchmark's items that have a word, in slices of bounded size."""
    ids, bodies, size = [], [], 0
    for r in benchmark.where(F.col("text").isNotNull() & F.col("item_id").isNotNull()).select("item_id", "text").toLocalIterator():
        raw = np.frombuffer(r["text"].encode(), np.uint8)
        body = normalised(raw, np.array([0, len(raw)]))[0].tobytes().strip() if len(raw) else b""
        if not body:
            continue
        if ids and (len(ids) >= SLICE or size + len(body) > SLICE_BYTES):
            yield Items(np.array(ids), bodies, target_recall)
            ids, bodies, size = [], [], 0
        ids.append(r["item_id"])
        bodies.append(body)
        size += len(body)
    if ids:
        yield Items(np.array(ids), bodies, target_recall)


def _in_turn(slices: Iterator[Items]) -> Iterator[tuple[Items, bool]]:
    """The slices, each with whether it is the last one."""
    items = next(slices, None)
    while items is not None:
        following = next(slices, None)
        yield items, following is None
        items = following


def _find(shared):
    """(doc_id, item_id, edits, item_bytes) rows of batches(doc_id, text) for a broadcast slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value.prepared()
        for b in S.blocks(batches):
            found = leaks_of(b.buf, b.off, held)
            text, item, edits = (np.array([f[k] for f in found], np.int64) for k in range(3))
            columns = [pa.array(held.ids[item], pa.int64()), pa.array(edits.astype(np.int32)), pa.array(held.size[item].astype(np.int32))]
            yield pa.RecordBatch.from_arrays([S.fields(b.rows, "doc_id")[0].take(pa.array(text)), *columns], names=["doc_id", "item_id", "edits", "item_bytes"])

    return run


def _drop(shared):
    """The rows of batches(text, ...) into which no item of a broadcast slice leaks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value.prepared()
        for b in S.blocks(batches):
            keep = np.ones(b.n, bool)
            keep[[t for t, *_ in leaks_of(b.buf, b.off, held)]] = False
            yield b.rows.filter(pa.array(keep))

    return run


def leaks(docs: DataFrame, benchmark: DataFrame, target_recall: float = TARGET_RECALL) -> DataFrame:
    """(doc_id, item_id, edits, item_bytes): the benchmark items that leak into docs(doc_id, text).

    benchmark(item_id, text). Null and empty texts leak nothing; items that are null, have a null id or no
    word are left out; one of fewer than ten bytes leaks only as it is. Items with a repeated id count each; a pair is returned once, with its least
    edits. A null doc_id stays null; other columns are ignored; empty tables give an empty result. If the
    benchmark has several slices, what each finds is written before the next one is sent.
    """
    spark = docs.sparkSession
    docs = docs.where(F.octet_length("text") > 0).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = docs.limit(0).select("doc_id", F.lit(0).cast("long").alias("item_id"), F.lit(0).alias("edits"), F.lit(0).alias("item_bytes"))
    for items, last in _in_turn(_slices(benchmark, target_recall)):
        shared = spark.sparkContext.broadcast(items)
        found = docs.mapInArrow(_find(shared), SCHEMA)
        if not last:
            found = S.settle(found, "leaks")
            shared.destroy()
        out = out.unionByName(found)
    return out.groupBy("doc_id", "item_id").agg(F.min("edits").alias("edits"), F.min("item_bytes").alias("item_bytes"))


def decontaminated(docs: DataFrame, benchmark: DataFrame, target_recall: float = TARGET_RECALL) -> DataFrame:
    """The rows of docs into which no item leaks, columns as they were, in one pass over the texts for each slice.

    Each row is judged by its own text, so rows without a doc_id and repeated ids are no exception; null and
    empty texts stay; other columns may have any names; empty tables change nothing.
    """
    for items, last in _in_turn(_slices(benchmark, target_recall)):
        shared = docs.sparkSession.sparkContext.broadcast(items)
        docs = docs.mapInArrow(_drop(shared), docs.schema)
        if not last:
            docs = S.settle(docs, "decontaminated")
            shared.destroy()
    return docs
