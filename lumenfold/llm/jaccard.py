"""Exact n-gram Jaccard self-join by signature trees.

Rows with equal shingle sets are one class, represented by its smallest doc_id. Two sets within the
threshold share a shingle among the first |set| - ceil(t |set|) + 1 of each, in any order common to all sets;
here shingles known to be frequent come last, so that passages which many documents share seldom make
blocks. A block is the representatives that share such a shingle.

Each block is joined with itself by a signature tree: a leaf holds a few sets, a node the OR and the AND of
the 2048-bit signatures below it, the range of their sizes, and their component if they have one in common. A
pair of nodes is left out if their sizes are too far apart, if the largest overlap that the signatures allow
is too small, or if all below is linked already. What remains is compared once more, by signatures as long as
the sets need, and then verified on the whole sets.

Representatives are first compared with a leader each, the smallest one with the same minimum under a hash,
which is linear in their number. Its links make most large groups of near copies one component, and blocks of
one component need no join. A block above BLOCK representatives is dealt out: its largest component and what is not
in it into parts of about BLOCK each, and each part of the one meets each part of the other.

Which shingles count as frequent, and the leaders, only decide how much work is done: every pair of sets
within the threshold is either verified or already linked through others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import graph
from . import shared as S

WORDS = 5
#: Link if 100 * intersection >= PERCENT * union.
PERCENT = 80
#: One in so many documents is counted for frequent shingles; frequent is so many of those, and no more than
#: so many shingles, the most frequent, are sent to the tasks.
COUNTED, FREQUENT, MOST_FREQUENT = 16, 4, 500_000
#: A leader must share so many of the minima under so many hashes.
LEADER_SHARED, LEADER_HASHES = 5, 8
BLOCK, LEAF = 128, 8
#: Pairs of leaves whose sets are compared at a time.
LEAF_PAIRS = 1024
#: Candidate pairs of a component that a round verifies; after the last one, all that are left.
ROUNDS = (3, 48)
SIGNATURE_WORDS = 32
#: Bits for each shingle of the sketches that candidate pairs are compared by before their texts are.
SKETCH_BITS = 4
#: Postings of a part, on average, when shingles shared by several sets are looked for.
PART = 400_000
SET_SCHEMA = "doc_id long, h long, n_shingles long, d1 long, d2 long, leaders array<long>, prefix array<long>, rare int, sig binary"
_SALTS = S.mix(np.arange(LEADER_HASHES + 2, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


# --- sets ----------------------------------------------------------------------------------------


def shingles(buf: np.ndarray, off: np.ndarray, n: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, offsets): the distinct n-word shingles of each text, in order; a shorter text is one shingle."""
    hashes, first = S.words(buf, off)
    shingle, count = S.windows(hashes, first, n)
    at = np.concatenate(([0], np.cumsum(count)))
    out = []
    for i, words in enumerate(np.diff(first)):
        if words >= n:
            out.append(np.unique(shingle[at[i] : at[i + 1]]))
        elif words:
            out.append(S.windows(hashes[first[i] : first[i + 1]], np.array([0, words]), int(words))[0])
        else:
            out.append(np.zeros(0, np.uint64))
    return np.concatenate(out) if out else np.zeros(0, np.uint64), np.concatenate(([0], np.cumsum([len(x) for x in out])))


class Frequent:
    """Membership in a sorted array of hashes."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = hashes
        self.low = np.zeros(1 << 22, bool)
        self.low[hashes & np.uint64((1 << 22) - 1)] = True

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        out = self.low[keys & np.uint64((1 << 22) - 1)]
        at = np.flatnonzero(out)
        if len(at):
            place = np.minimum(np.searchsorted(self.hashes, keys[at]), len(self.hashes) - 1)
            out[at] = self.hashes[place] == keys[at]
        return out


def frequent_shingles(docs: DataFrame) -> np.ndarray:
    """The most frequent shingles, counted over one in COUNTED of the distinct texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in S.blocks(batches):
            seen, n = np.unique(shingles(b.buf, b.off)[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int64)), pa.array(n)], names=["shingle", "n"])

    some = docs.select("text").where(F.pmod(F.xxhash64("text"), F.lit(COUNTED)) == 0).dropDuplicates(["text"])
    counts = some.mapInArrow(run, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n")).where(F.col("n") >= FREQUENT)
    top = counts.orderBy(F.desc("n"), "shingle").limit(MOST_FREQUENT).select("shingle").toPandas()["shingle"]
    return np.sort(top.to_numpy(np.int64).astype(np.uint64))


def shingle_sets(docs: DataFrame, frequent: np.ndarray) -> DataFrame:
    """SET_SCHEMA for each row: set size, digest, leader hashes, prefix with its `rare` first shingles not
    known to be frequent, and signature."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent)  # MOST_FREQUENT hashes at most
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int32(), pa.binary())
    names = [x.split()[0] for x in SET_SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Frequent(shared.value)
        for b in S.blocks(batches):
            sets, off = shingles(b.buf, b.off)
            rows = _described(sets, off, known(sets))
            yield pa.RecordBatch.from_arrays([*S.fields(b.rows, "doc_id", "h"), *(pa.array(r, kind) for r, kind in zip(rows, kinds))], names=names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"), "text").mapInArrow(run, SET_SCHEMA)


def _described(sets: np.ndarray, off: np.ndarray, frequent: np.ndarray) -> list:
    n = np.diff(off)
    full = np.flatnonzero(n)
    at = off[:-1][full]
    mixed = [S.mix(sets ^ salt) for salt in _SALTS[:LEADER_HASHES]]
    digests = []
    for salt in _SALTS[-2:]:
        d = np.zeros(len(n), np.int64)
        if len(full):
            d[full] = np.add.reduceat(S.mix(sets + salt), at).astype(np.int64)
        digests.append(d)
    leaders = np.zeros((len(n), LEADER_HASHES), np.int64)
    if len(full):
        for k, m in enumerate(mixed):
            leaders[full, k] = np.minimum.reduceat(m, at).astype(np.int64)
    bits = np.zeros((len(n), 64 * SIGNATURE_WORDS), bool)
    bits[np.repeat(np.arange(len(n)), n), (mixed[0] % np.uint64(64 * SIGNATURE_WORDS)).astype(np.int64)] = True
    sig = np.packbits(bits, axis=1)
    prefix, rare = [], []
    for i in range(len(n)):
        own, late = sets[off[i] : off[i + 1]], frequent[off[i] : off[i + 1]]
        size = prefix_size(len(own))
        early = own[~late][:size]
        rare.append(len(early))
        prefix.append((early if len(early) == size else np.concatenate((early, own[late][: size - len(early)]))).astype(np.int64))
    return [n, *digests, list(leaders), prefix, rare, [s.tobytes() for s in sig]]


def prefix_size(n: int) -> int:
    """Shingles of a set of n of which a linked set has at least one among its own."""
    return n - -(-PERCENT * n // 100) + 1 if n else 0


# --- signature trees -----------------------------------------------------------------------------


def _count_bits(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x).sum(-1, dtype=np.int64)


class SignatureTree:
    """Levels of nodes over sets in the order of their sizes; level 0 holds the leaves."""

    def __init__(self, size: np.ndarray, sig: np.ndarray, comp: np.ndarray):
        self.order = np.lexsort((sig[:, 0], size))
        self.size, self.sig, self.comp = size[self.order], sig[self.order], comp[self.order]
        cut = np.arange(0, len(size), LEAF)
        self.levels = [self._node(cut, self.size, self.size, self.sig, self.sig, self.comp, self.comp)]
        while len(self.levels[-1][0]) > 1:
            low, high, both, either, c0, c1 = self.levels[-1]
            self.levels.append(self._node(np.arange(0, len(low), 2), low, high, both, either, c0, c1))

    @staticmethod
    def _node(cut, low, high, both, either, c0, c1):
        return (np.minimum.reduceat(low, cut), np.maximum.reduceat(high, cut), np.bitwise_and.reduceat(both, cut, axis=0), np.bitwise_or.reduceat(either, cut, axis=0), np.minimum.reduceat(c0, cut), np.maximum.reduceat(c1, cut))

    def _possible(self, level: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
        """Which pairs of nodes may hold a pair of sets that link and aren't linked yet."""
        low, high, both, either, c0, c1 = self.levels[level]
        overlap = np.minimum(high[u] - _count_bits(both[u] & ~either[v]), high[v] - _count_bits(both[v] & ~either[u]))
        one = (c0[u] == c1[u]) & (c0[v] == c1[v]) & (c0[u] == c0[v])
        return ~one & _enough(overlap, low[u], low[v]) & (100 * high[u] >= PERCENT * low[v]) & (100 * high[v] >= PERCENT * low[u])

    def self_join(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Positions of the pairs of sets that may link, each pair once, and their largest possible similarity."""
        u = v = np.zeros(1, np.int64)
        for level in range(len(self.levels) - 1, -1, -1):
            keep = self._possible(level, u, v)
            u, v = u[keep], v[keep]
            if level:
                n = len(self.levels[level - 1][0])
                u, v = np.repeat(2 * u, 4) + np.tile([0, 0, 1, 1], len(u)), np.repeat(2 * v, 4) + np.tile([0, 1, 0, 1], len(v))
                inside = (u <= v) & (v < n)
                u, v = u[inside], v[inside]
        found = [self._leaf_pairs(u[i : i + LEAF_PAIRS], v[i : i + LEAF_PAIRS]) for i in range(0, max(len(u), 1), LEAF_PAIRS)]
        a, b, overlap = (np.concatenate([f[k] for f in found]) for k in range(3))
        return self.order[a], self.order[b], overlap / (self.size[a] + self.size[b] - overlap)

    def _leaf_pairs(self, u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pairs of sets of these pairs of leaves that may link, and their largest possible overlap."""
        k = LEAF
        a = np.repeat(k * u, k * k) + np.tile(np.repeat(np.arange(k), k), len(u))
        b = np.repeat(k * v, k * k) + np.tile(np.tile(np.arange(k), k), len(v))
        inside = (a < b) & (b < len(self.size))
        a, b = a[inside], b[inside]
        keep = self.comp[a] != self.comp[b]
        a, b = a[keep], b[keep]
        overlap = np.minimum(self.size[a] - _count_bits(self.sig[a] & ~self.sig[b]), self.size[b] - _count_bits(self.sig[b] & ~self.sig[a]))
        keep = _enough(overlap, self.size[a], self.size[b])
        return a[keep], b[keep], overlap[keep]


def _enough(overlap: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether 100 * overlap >= PERCENT * (x + y - overlap)."""
    return (100 + PERCENT) * overlap >= PERCENT * (x + y)


def _join_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidate pairs of blocks; rows come sorted by block."""
    held: list[pa.RecordBatch] = []

    def joined(rows: pa.Table) -> pa.RecordBatch:
        block, doc, size, comp = (rows.column(c).to_numpy() for c in ("block", "doc_id", "n_shingles", "comp"))
        sig = np.frombuffer(b"".join(rows.column("sig").to_pylist()), np.uint64).reshape(-1, SIGNATURE_WORDS)
        cut = np.flatnonzero(np.append(True, block[1:] != block[:-1])) if len(block) else np.zeros(0, np.int64)
        a, b, most = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        for i, j in zip(cut, np.append(cut[1:], len(block))):
            if j - i > 1:
                x, y, bound = SignatureTree(size[i:j], sig[i:j], comp[i:j]).self_join()
                a.append(doc[i:j][x])
                b.append(doc[i:j][y])
                most.append(bound)
        a, b, most = np.concatenate(a), np.concatenate(b), np.concatenate(most)
        pair, index = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0, return_index=True)
        return pa.RecordBatch.from_arrays([pa.array(pair[:, 0]), pa.array(pair[:, 1]), pa.array(most[index])], names=["a", "b", "most"])

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        block = batch.column(0)
        if block[0] == block[batch.num_rows - 1] and sum(x.num_rows for x in held) < 4096:
            continue  # the block may go on
        rows = pa.Table.from_batches(held)
        keys = rows.column("block").to_numpy()
        cut = int(np.searchsorted(keys, keys[-1])) if keys[0] != keys[-1] else 0
        if cut:
            yield joined(rows.slice(0, cut))
        held = rows.slice(cut).to_batches()
    if held:
        yield joined(pa.Table.from_batches(held))


# --- the join ------------------------------------------------------------------------------------


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Those of pairs(a, b) whose whole sets link; texts(doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in S.blocks(batches, "text_a"):
            other, off = S.text_view(S.fields(block.rows, "text_b")[0])
            x, xo = shingles(block.buf, block.off)
            y, yo = shingles(other, off)
            both = np.array([len(np.intersect1d(x[xo[i] : xo[i + 1]], y[yo[i] : yo[i + 1]], True)) for i in range(block.n)], np.int64)
            link = pa.array(_enough(both, np.diff(xo), np.diff(yo)) & (both > 0))
            yield pa.RecordBatch.from_arrays([c.filter(link) for c in S.fields(block.rows, "a", "b")], names=["a", "b"])

    a = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
    b = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))
    return pairs.join(a, "a").join(b, "b").select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def _packed(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    """The rare postings of a batch as one row for each part: shingles and documents, 8 bytes each."""
    for batch in batches:
        doc, rare, prefix = S.fields(batch, "doc_id", "rare", "prefix")
        size, rare = prefix.value_lengths().to_numpy(), rare.to_numpy()
        keep = S.ragged(size) < np.repeat(rare, size)
        shingle, doc = prefix.flatten().to_numpy()[keep], np.repeat(doc.to_numpy(), size)[keep]
        part = (S.mix(shingle.astype(np.uint64)) % np.uint64(parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        shingle, doc, part = shingle[order], doc[order], part[order]
        first = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(part) else np.zeros(0, np.int64)
        cut = list(zip(first, np.append(first[1:], len(part))))
        yield pa.RecordBatch.from_arrays([pa.array(part[first].astype(np.int32)), *(pa.array([x[i:j].tobytes() for i, j in cut], pa.binary()) for x in (shingle, doc))], names=["part", "shingles", "docs"])


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(shingle, doc_id) of the shingles that several documents of a part have; rows come sorted by part."""

    def of(rows: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
        shingle, doc = (np.frombuffer(b"".join(r[k] for r in rows), np.int64) for k in range(2))
        order = np.argsort(shingle, kind="stable")
        shingle, doc = shingle[order], doc[order]
        again = np.zeros(len(shingle) + 1, bool)
        again[1:-1] = shingle[1:] == shingle[:-1]
        keep = again[1:] | again[:-1]
        return pa.RecordBatch.from_arrays([pa.array(shingle[keep]), pa.array(doc[keep])], names=["shingle", "doc_id"])

    part, held = None, []
    for batch in batches:
        for p, *row in zip(*(c.to_pylist() for c in batch.columns)):
            if p != part and held:
                yield of(held)
                held = []
            part = p
            held.append(row)
    if held:
        yield of(held)


def shared_postings(reps: DataFrame) -> DataFrame:
    """(shingle, doc_id) of the prefixes of reps whose shingle is in several of them.

    Rare shingles go packed to the part of their hash, in one shuffle, and a part keeps those it has twice.
    Frequent ones are not gathered: each is a row, known to be shared.
    """
    tasks = S.n_tasks(reps.sparkSession)
    total = reps.agg(F.sum("rare")).first()[0] or 0
    parts = max(tasks, -(-total // PART))
    packed = reps.select("doc_id", "rare", "prefix").mapInArrow(lambda it: _packed(it, parts), "part int, shingles binary, docs binary")
    rare = packed.repartition(tasks, "part").sortWithinPartitions("part").mapInArrow(_shared, "shingle long, doc_id long")
    late = F.expr("slice(prefix, rare + 1, greatest(size(prefix) - rare, 0))")
    return rare.unionByName(reps.select(F.explode(late).alias("shingle"), "doc_id"))


def _near_size(a: str, b: str):
    return (100 * F.col(a) >= PERCENT * F.col(b)) & (100 * F.col(b) >= PERCENT * F.col(a))


def _blocks(postings: DataFrame, described: DataFrame, comps: DataFrame, scratch: S.Scratch) -> DataFrame:
    """(block, doc_id, n_shingles, comp, sig): blocks whose members are in several components."""
    placed = postings.join(comps, "doc_id")
    several = placed.groupBy("shingle").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1"), F.count("*").alias("n")).where("c0 <> c1")
    several = scratch.settle(several.select("shingle", "n"), "shared-shingles")  # tables of what was counted, so that the joins may split a hot shingle
    members = scratch.settle(placed.join(several, "shingle").select("shingle", "doc_id", "comp", "n"), "block-members", ("shared-shingles",))
    small = members.where(F.col("n") <= BLOCK).groupBy("shingle").agg(F.sort_array(F.collect_list("doc_id")).alias("docs")).select("docs").distinct()
    small = small.select(F.xxhash64("docs", F.lit(0)).alias("block"), F.explode("docs").alias("doc_id"))

    # of a large block's largest component, each member goes to one part, and so do the others to parts of their own;
    # every part meets each of the others' parts, and these meet one another, in blocks of two parts
    large = members.where(F.col("n") > BLOCK)
    main = large.groupBy("shingle", "comp").agg(F.count("*").alias("k")).groupBy("shingle").agg(F.max_by("comp", F.struct("k", "comp")).alias("main"), F.max("k").alias("k"))
    large = large.join(scratch.settle(main, "main-components"), "shingle").withColumns({"parts": F.ceil(F.col("k") / BLOCK).cast("int"), "own": F.ceil((F.col("n") - F.col("k")) / BLOCK).cast("int")})
    inside, others = large.where("comp = main"), large.where("comp <> main")
    own_part = F.pmod(F.xxhash64("doc_id"), F.col("own")).cast("int")
    main_part = F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int")
    once = inside.withColumn("part", main_part).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("own") - 1)))
    against = others.withColumn("other", own_part).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    cross = once.unionByName(against).select(F.xxhash64("shingle", F.lit("main"), "part", "other").alias("block"), "doc_id")
    among = others.withColumn("part", own_part).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("own") - 1)))
    among = among.select(F.xxhash64("shingle", F.least("part", "other"), F.greatest("part", "other")).alias("block"), "doc_id")
    large = cross.unionByName(among)
    return small.unionByName(large).join(described, "doc_id").join(comps, "doc_id").select("block", "doc_id", "n_shingles", "comp", "sig")


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Signatures of texts with a power of two of bits, SKETCH_BITS to twice that for each shingle."""
    for b in S.blocks(batches):
        sets, off = shingles(b.buf, b.off)
        n = np.diff(off)
        sketch = []
        for i in range(b.n):
            bits = np.zeros(1 << max(9, int(SKETCH_BITS * n[i] - 1).bit_length()), bool)
            bits[(sets[off[i] : off[i + 1]] & np.uint64(len(bits) - 1)).astype(np.int64)] = True
            sketch.append(np.packbits(bits, bitorder="little").tobytes())
        yield pa.RecordBatch.from_arrays([S.fields(b.rows, "doc_id")[0], pa.array(n), pa.array(sketch, pa.binary())], names=["doc_id", "n", "sketch"])


def sketch_overlap(x: bytes, nx: int, y: bytes, ny: int) -> int:
    """Largest overlap that two sketches allow; the longer is folded to the size of the shorter."""
    x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
    size = min(len(x), len(y))
    x, y = (np.bitwise_or.reduce(v.reshape(-1, size), axis=0) for v in (x, y))
    return int(min(nx - _count_bits(x & ~y), ny - _count_bits(y & ~x)))


def _possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose sketches allow a link, with the largest similarity that they allow."""
    for batch in batches:
        a, b, nx, ny = (c.to_numpy() for c in S.fields(batch, "a", "b", "nx", "ny"))
        overlap = np.array([sketch_overlap(x.as_py(), p, y.as_py(), q) for x, p, y, q in zip(S.fields(batch, "x")[0], nx, S.fields(batch, "y")[0], ny)], np.int64)
        keep = _enough(overlap, nx, ny)
        most = overlap[keep] / np.maximum(nx + ny - overlap, 1)[keep]
        yield pa.RecordBatch.from_arrays([pa.array(a[keep]), pa.array(b[keep]), pa.array(most)], names=["a", "b", "most"])


def _sketch_filter(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """(a, b, most) of the pairs(a, b) that sketches(doc_id, n, sketch) leave possible."""
    x = sketches.select(F.col("doc_id").alias("a"), F.col("n").alias("nx"), F.col("sketch").alias("x"))
    y = sketches.select(F.col("doc_id").alias("b"), F.col("n").alias("ny"), F.col("sketch").alias("y"))
    return pairs.select("a", "b").join(x, "a").join(y, "b").select("a", "b", "nx", "ny", "x", "y").mapInArrow(_possible, "a long, b long, most double")


def _components_of(ids: DataFrame, links: DataFrame) -> DataFrame:
    """(doc_id, comp) of all ids."""
    linked = graph.components(links).withColumnRenamed("node", "doc_id")
    return S.settle(ids.join(linked, "doc_id", "left").select("doc_id", F.coalesce("component", "doc_id").alias("comp")), "components")


def _verified_in_rounds(pairs: DataFrame, texts: DataFrame, ids: DataFrame, links: DataFrame, comps: DataFrame) -> DataFrame:
    """links with those of pairs(a, b, most) that make a difference to the components.

    A round verifies the likeliest pairs of each component, more of them every time and at last all; pairs
    that then lie in one component need no look any more. So a large group of near copies is linked by a few
    of its pairs, while every pair of different components is verified.
    """
    for most in (*ROUNDS, None):
        c = lambda side: comps.select(F.col("doc_id").alias(side), F.col("comp").alias(f"c{side}"))
        pairs = S.settle(pairs.join(c("a"), "a").join(c("b"), "b").where("ca <> cb").select("a", "b", "most", "ca", "cb"), "live-pairs")
        if pairs.isEmpty():
            return links
        picked = pairs.select("a", "b")
        if most is not None:
            by_comp = pairs.select("a", "b", "most", F.explode(F.array("ca", "cb")).alias("comp"))
            rank = F.row_number().over(Window.partitionBy("comp").orderBy(F.desc("most"), "a", "b"))
            picked = by_comp.withColumn("k", rank).where(F.col("k") <= most).select("a", "b").distinct()
        picked = S.settle(picked, "picked-pairs")
        links = S.settle(links.unionByName(_verified(picked, texts)), "links")
        if most is not None:
            pairs = pairs.drop("ca", "cb").join(picked, ["a", "b"], "left_anti")
            comps = _components_of(ids, links)
    return links


def _named_sets(docs: DataFrame) -> DataFrame:
    """(doc_id, h, n_shingles, d1, d2, component_id) for each row; h is a hash of its text."""
    spark = docs.sparkSession
    scratch = S.Scratch(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sets = scratch.settle(shingle_sets(docs, frequent_shingles(docs)), "shingle-sets")
    classes = scratch.settle(sets.where("n_shingles > 0").groupBy("d1", "d2").agg(F.min("doc_id").alias("rep")), "set-classes")
    reps = sets.join(classes.withColumnRenamed("rep", "doc_id"), ["doc_id", "d1", "d2"], "left_semi")

    postings = scratch.settle(shared_postings(reps), "postings")
    described = reps.join(postings.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", "n_shingles", "leaders", "sig").distinct()
    described = scratch.settle(described, "candidates")
    sets = scratch.settle(sets.select("doc_id", "h", "n_shingles", "d1", "d2"), "set-names", ("shingle-sets",))
    texts = scratch.settle(docs.join(described.select("doc_id").distinct(), "doc_id", "left_semi"), "candidate-texts")

    keyed = described.select("doc_id", "n_shingles", "leaders", F.posexplode("leaders").alias("k", "least"))
    leader = keyed.groupBy("k", "least").agg(F.min(F.struct("doc_id", "n_shingles", "leaders")).alias("leader"), F.count("*").alias("n")).where("n > 1")
    led = keyed.join(scratch.settle(leader.select("k", "least", "leader"), "leaders"), ["k", "least"]).where((F.col("doc_id") > F.col("leader.doc_id")) & _near_size("n_shingles", "leader.n_shingles"))
    same = F.size(F.filter(F.zip_with("leaders", "leader.leaders", lambda x, y: x == y), lambda e: e))
    led = led.where(same >= LEADER_SHARED).select(F.col("leader.doc_id").alias("a"), F.col("doc_id").alias("b")).distinct()
    links = S.settle(_verified(led, texts), "leader-links")
    scratch.drop("leaders")

    ids = scratch.settle(described.select("doc_id").distinct(), "candidate-ids")
    comps = _components_of(ids, links)
    members = _blocks(postings, described.select("doc_id", "n_shingles", "sig"), comps, scratch)
    tasks = S.n_tasks(spark)
    pairs = members.repartition(tasks, "block").sortWithinPartitions("block").mapInArrow(_join_blocks, "a long, b long, most double")
    pairs = scratch.settle(pairs.groupBy("a", "b").agg(F.max("most").alias("most")), "tree-pairs", ("block-members", "main-components", "postings", "candidates"))
    sketches = scratch.settle(texts.mapInArrow(_sketched, "doc_id long, n long, sketch binary"), "sketches")
    pairs = scratch.settle(_sketch_filter(pairs, sketches).groupBy("a", "b").agg(F.max("most").alias("most")), "possible-pairs", ("tree-pairs", "sketches"))
    found = graph.components(_verified_in_rounds(pairs, texts, ids, links, comps))
    scratch.drop("possible-pairs", "candidate-texts", "candidate-ids")

    named = classes.join(found.withColumnRenamed("node", "rep"), "rep", "left").select("d1", "d2", F.coalesce("component", "rep").alias("component_id"))
    out = sets.join(named, ["d1", "d2"], "left")
    return out.withColumn("component_id", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of docs(doc_id, text).

    A null text, or one without words, has an empty set, links with nothing and is its own component. Rows
    that repeat a doc_id are one document for links: it has the links of all of them. Rows without a doc_id
    join no component but through an equal set, else theirs is null. Other columns are ignored; an empty
    table gives an empty result.
    """
    return _named_sets(docs).select("doc_id", "n_shingles", "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """docs with one row of each component, columns as they were.

    The row that stays has the component's doc_id; of several such rows, the one whose text has the smallest
    hash. Rows without a doc_id stay if no row with one has their set, one for each set. A row with an empty set,
    also one whose text is null, duplicates nothing but itself, so one stays for each doc_id and text. Other
    columns may have any names; an empty table gives an empty result.
    """
    sets = _named_sets(docs)
    linked = sets.where("n_shingles > 0 AND (doc_id IS NULL AND component_id IS NULL OR doc_id = component_id)")
    group = [F.col("component_id"), *(F.when(F.col("component_id").isNull(), F.col(c)).alias(c) for c in ("d1", "d2"))]
    kept = linked.groupBy(*group).agg(F.min("h").alias("h")).select(F.col("component_id").alias("doc_id"), "h")
    kept = kept.unionByName(sets.where("n_shingles = 0").select("doc_id", "h")).distinct()
    keys = [F.coalesce("doc_id", F.lit(0)).alias("id"), F.col("doc_id").isNull().alias("no_id"), F.col("h")]
    whole = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h")).select("row", *keys)
    # a broadcast of kept would leave the rows where they are and shuffle them afterwards; this way they move once
    once = whole.join(kept.select(*keys).hint("merge"), ["id", "no_id", "h"], "left_semi").dropDuplicates(["id", "no_id", "h"])
    return once.select("row.*")


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(words[i:i+4], ' ') AS shingle
  FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 3, 2))) AS i FROM w WHERE len(words) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), link AS (
  SELECT p.a, p.b FROM (
    SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.shingle = y.shingle AND x.doc_id < y.doc_id GROUP BY ALL
  ) p JOIN n na ON na.doc_id = p.a JOIN n nb ON nb.doc_id = p.b WHERE 100 * p.c >= 80 * (na.n + nb.n - p.c)
), both_ways AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link
), reach(doc_id, r) AS (
  SELECT a, b FROM both_ways UNION SELECT reach.doc_id, both_ways.b FROM reach JOIN both_ways ON reach.r = both_ways.a
)
SELECT w.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, least(w.doc_id, coalesce(min(reach.r), w.doc_id)) AS component_id
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN reach USING (doc_id) GROUP BY w.doc_id
"""
