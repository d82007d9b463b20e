"""Removal of byte strings that occur earlier, by blockwise suffix sorting with a difference cover.

Every window of LENGTH bytes holds an anchor, the smallest hashed GRAM of the window, and equal windows hold
equal anchors at the same place. So only suffixes around anchors that occur twice can matter:

1. Each text is cut into runs of windows with one anchor. Runs whose anchor occurs once are left out.
2. The others' contexts, that is their bytes, are gathered by anchor and sorted as suffixes one bucket at a
   time: a bucket is whole anchors of a bounded number of bytes. Suffixes are sorted by their first V bytes,
   and ties are resolved by ranks of the suffixes at difference-cover positions, worked out beforehand, so
   memory follows the bucket and not the ties. Contexts that are equal throughout, found by sorting them as
   wholes, take part once for all their holders. In the sorted order equal windows are neighbours, one run, and
   of all holders of a run's windows all but the earliest are removed.
3. An anchor of more than `most_runs` contexts is dealt out to several buckets. What is removed in one of them
   is settled; the first windows of each go on to buckets by longer keys, of 60, 90 and at last all 100 bytes
   of the windows, until each key fits into a bucket. Keys that occur once are left out at each step.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared as S

LENGTH, GRAM = 100, 20
#: Bytes that contexts of one bucket key share, by level.
KEY_BYTES = (GRAM, 60, 90, LENGTH)
#: A perfect difference set: every shift modulo V is a difference of two of its members.
V, COVER = 7, np.array([0, 1, 3])
BUCKET_BYTES, MOST_RUNS = 400_000, 2000
RUN_SCHEMA = "key long, doc_id long, h long, place long"
CONTEXT_SCHEMA = "key long, n long, doc_id long, h long, place long, body binary"
SORTED_SCHEMA = "gone boolean, doc_id long, h long, place long, body binary"
OUT_SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
#: A place holds the first window of a run in its text, the anchor after it, and the windows, the last two below 128.
_BITS = 7
_LOW = (1 << _BITS) - 1


# --- runs and their contexts ---------------------------------------------------------------------


def _place(begin: np.ndarray, anchor: np.ndarray, n: np.ndarray) -> np.ndarray:
    return (begin << 2 * _BITS) | (anchor << _BITS) | n


def _sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """Where the first of the least values of x[i:i+width] is, for each i, by doubling."""
    value, at, span = x, np.arange(len(x), dtype=np.int32), 1

    def merged(value, at, by):
        later = value[by:] < value[:-by]
        return np.where(later, value[by:], value[:-by]), np.where(later, at[by:], at[:-by])

    while span * 2 <= width:
        value, at = merged(value, at, span)
        span *= 2
    return (merged(value, at, width - span) if width > span else (value, at))[1]


def runs(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, text number, place) of the runs in a block."""
    count = np.maximum(np.diff(off) - LENGTH + 1, 0)
    if not count.sum():
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none, none
    up, down = S._powers(len(buf) + 1)
    total = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * up[: len(buf)], out=total[1:])
    gram = S.mix((total[GRAM:] - total[:-GRAM]) * down[: len(buf) - GRAM + 1])
    text = np.repeat(np.arange(len(count)), count)
    start = np.repeat(off[:-1], count) + S.ragged(count)
    at = _sliding_least(gram, LENGTH - GRAM + 1)[start]
    new = np.ones(len(start), bool)
    new[1:] = (at[1:] != at[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(new)
    n = np.diff(np.append(first, len(start)))
    begin = start[first]
    return gram[at[first]], text[first], _place(begin - off[text[first]], at[first] - begin, n)


def _slabs(b: S.Block) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first byte, bytes, offsets): a block as it is, or a longer text in slabs that overlap so that no window is lost."""
    if b.n > 1 or len(b.buf) <= S.BLOCK_BYTES:
        yield 0, b.buf, b.off
        return
    for at in range(0, len(b.buf) - LENGTH + 1, S.BLOCK_BYTES):
        slab = b.buf[at : at + S.BLOCK_BYTES + LENGTH - 1]
        yield at, slab, np.array([0, len(slab)])


def _find_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in S.blocks(batches):
        for at, buf, off in _slabs(b):
            key, text, place = runs(buf, off)
            doc_id, h = (c.take(pa.array(text)) for c in S.fields(b.rows, "doc_id", "h"))
            yield pa.RecordBatch.from_arrays([pa.array(key.astype(np.int64)), doc_id, h, pa.array(place + (at << 2 * _BITS))], names=["key", "doc_id", "h", "place"])


def _bodies(buf: np.ndarray, begin: np.ndarray, size: np.ndarray) -> pa.Array:
    cut = pa.array(np.concatenate(([0], np.cumsum(size))).astype(np.int32))
    body = buf[np.repeat(begin, size) + S.ragged(size)]
    return pa.Array.from_buffers(pa.binary(), len(size), [None, cut.buffers()[1], pa.py_buffer(body)])


def _cut_contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each wanted run, with its bytes; rows alike in doc_id and text are one document."""
    before = None
    for b in S.blocks(batches):
        which = list(zip(*(c.to_pylist() for c in S.fields(b.rows, "doc_id", "h"))))
        new = np.array([x != y for x, y in zip(which, [before, *which])])
        before = which[-1]
        runs_of = S.fields(b.rows, "places")[0].value_lengths().to_numpy()
        keys, n, places = (c.flatten() for c in S.fields(b.rows, "keys", "of", "places"))
        text = np.repeat(np.arange(b.n), runs_of)
        wanted = np.flatnonzero(new[text])
        place = places.to_numpy()
        size = (place & _LOW) + LENGTH - 1
        for i in range(0, len(wanted), 20_000):
            some = wanted[i : i + 20_000]
            take = pa.array(some)
            doc_id, h = (c.take(pa.array(text[some])) for c in S.fields(b.rows, "doc_id", "h"))
            body = _bodies(b.buf, b.off[text[some]] + (place[some] >> 2 * _BITS), size[some])
            yield pa.RecordBatch.from_arrays([keys.take(take), n.take(take), doc_id, h, places.take(take), body], names=["key", "n", "doc_id", "h", "place", "body"])


def _refine(level: int):
    """Contexts as contexts by the keys of a level: windows in one share KEY_BYTES[level] bytes at the same place."""
    width = KEY_BYTES[level]
    step = LENGTH - width + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in S.blocks(batches, "body", 1_000_000):
            place = S.fields(b.rows, "place")[0].to_numpy()
            n, anchor = place & _LOW, (place >> _BITS) & _LOW
            owner, inside = np.repeat(np.arange(b.n), n), S.ragged(n)
            group = (anchor[owner] - inside) // step
            new = np.ones(len(owner), bool)
            new[1:] = (owner[1:] != owner[:-1]) | (group[1:] != group[:-1])
            first = np.flatnonzero(new)
            many, owner, inside, group = np.diff(np.append(first, len(new))), owner[first], inside[first], group[first]
            begin = b.off[owner]
            shared = begin + anchor[owner] - step * group
            key = S.mix(S.range_hash(b.buf, shared, shared + width) + S.mix((group + 128 * level).astype(np.uint64)))
            doc_id, h = (c.take(pa.array(owner)) for c in S.fields(b.rows, "doc_id", "h"))
            cut = _place((place[owner] >> 2 * _BITS) + inside, anchor[owner] - inside, many)
            yield pa.RecordBatch.from_arrays([pa.array(key.astype(np.int64)), doc_id, h, pa.array(cut), _bodies(b.buf, begin + inside, many + LENGTH - 1)], names=["key", "doc_id", "h", "place", "body"])

    return run


# --- sorting suffixes ----------------------------------------------------------------------------


def _shift(a: int, b: int) -> int:
    """Smallest shift that takes the residues a and b into the cover."""
    return next(s for s in range(V) if (a + s) % V in COVER and (b + s) % V in COVER)


def _prefix_keys(text: np.ndarray, width: int) -> np.ndarray:
    """The first `width` bytes of every suffix as a number; beyond the end there are zero bytes."""
    padded = np.concatenate((text, np.zeros(width, np.uint8))).astype(np.uint64)
    key = np.zeros(len(text), np.uint64)
    for k in range(width):
        key = (key << np.uint64(8)) | padded[k : k + len(text)]
    return key


def cover_ranks(text: np.ndarray, key: np.ndarray, depth: int) -> np.ndarray:
    """Ranks of the suffixes at cover positions by their first `depth` bytes at least, 0 elsewhere.

    The cover positions of one residue, V bytes apart, make a string of names; the strings of all residues
    stand one after the other, and prefix doubling ranks their suffixes.
    """
    at = np.concatenate([np.arange(r, len(text), V) for r in COVER])
    last = np.append(np.diff(at) < 0, True)
    rank = np.unique(key[at], return_inverse=True)[1] + 1
    seen, step = V, 1
    while seen < depth:
        after = np.zeros(len(at), np.int64)
        after[:-step] = rank[step:]
        ends = np.flatnonzero(last)
        for k in range(step):  # what follows the end of a residue's string is no continuation
            after[np.maximum(ends - k, 0)] = 0
        rank = np.unique(rank * (len(at) + 2) + after, return_inverse=True)[1] + 1
        seen, step = 2 * seen, 2 * step
    ranks = np.zeros(len(text) + V, np.int64)
    ranks[at] = rank
    return ranks


def sort_suffixes(text: np.ndarray, at: np.ndarray, depth: int = LENGTH) -> np.ndarray:
    """Order of the suffixes text[at:] by `depth` bytes; suffixes equal that far are neighbours."""
    key = _prefix_keys(text, V)
    ranks = cover_ranks(text, key, depth)
    group = np.unique(key[at], return_inverse=True)[1].astype(np.int64)
    tied = np.flatnonzero(np.bincount(group)[group] > 1)
    position = np.zeros(len(at), np.int64)
    span = int(ranks.max(initial=0)) + 1
    residue = at[tied] % V
    members = [tied[residue == r] for r in range(V)]
    for a in range(V):
        for b in range(V):
            if len(members[a]) and len(members[b]):
                s = _shift(a, b)
                code = np.sort(group[members[a]] * span + ranks[at[members[a]] + s])
                own = group[members[b]]
                position[members[b]] += np.searchsorted(code, own * span + ranks[at[members[b]] + s]) - np.searchsorted(code, own * span)
    return np.lexsort((position, group))


def window_runs(text: np.ndarray, at: np.ndarray, order_of: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray]:
    """(run of each window text[at:at+LENGTH], first window of each run): equal windows are neighbours in the suffix order and one run; order_of says which is first (the last key counts most)."""
    order = sort_suffixes(text, at)
    eight = _prefix_keys(text, 8)
    x, y = at[order[:-1]], at[order[1:]]
    same = eight[x + LENGTH - 8] == eight[y + LENGTH - 8]
    for k in range(0, LENGTH - 8, 8):
        same &= eight[x + k] == eight[y + k]
    run = np.empty(len(at), np.int64)
    run[order] = np.cumsum(np.append(0, ~same)) if len(at) else run
    by_run = np.lexsort((*order_of, run))
    return run, by_run[np.append(True, run[by_run[1:]] != run[by_run[:-1]])[: len(at)]]


def repeats(text: np.ndarray, at: np.ndarray, order_of: tuple[np.ndarray, ...]) -> np.ndarray:
    """Which windows text[at:at+LENGTH] equal one that comes earlier by the keys order_of (the last counts most)."""
    run, first = window_runs(text, at, order_of)
    out = np.ones(len(at), bool)
    out[first] = False
    return out


def _classes(text: np.ndarray, begin: np.ndarray, size: np.ndarray, order_of: tuple[np.ndarray, ...]) -> np.ndarray:
    """For each context text[begin:begin+size] the earliest one by the keys order_of that is equal to it throughout: itself, or its representative."""
    words = np.concatenate((text, np.zeros(8, np.uint8))).astype(np.uint64)
    for k in (1, 2, 4):  # the eight bytes from each place on, the first one highest
        words[:-k] = (words[:-k] << np.uint64(8 * k)) | words[k:]
    columns = []
    for k in range(0, int(size.max(initial=0)), 8):
        inside = np.maximum(size - k, 0)
        cut = np.where(inside < 8, (8 - np.minimum(inside, 8)) * 8, 0).astype(np.uint64)
        word = words[np.minimum(begin + k, len(text))]
        columns.append(np.where(inside > 0, (word >> cut), np.uint64(0)))
    run = np.zeros(len(begin), np.int64)
    order = np.lexsort((*columns[::-1], size))
    new = np.zeros(max(len(order) - 1, 0), bool)
    for c in (size, *columns):
        new |= c[order[1:]] != c[order[:-1]]
    run[order] = np.cumsum(np.append(0, new))[: len(order)]
    by_run = np.lexsort((*order_of, run))
    first = by_run[np.append(True, run[by_run[1:]] != run[by_run[:-1]])[: len(run)]]
    return first[run] if len(run) else run


def _resolve(rows: pa.Table, firsts: bool) -> pa.RecordBatch:
    """SORTED_SCHEMA for a bucket's contexts: the windows that occur earlier in it, as runs, and if asked the others with their bytes.

    Contexts that are equal throughout take part in the suffix sort once, for all that hold them: the windows of the
    earliest of each are sorted, and of a run of equal windows the first stays. It is a sorted one, so what later holders have goes.
    """
    body, off = S.text_view(rows.column("body").combine_chunks() if rows.column("body").num_chunks != 1 else rows.column("body").chunk(0))
    doc_id, h, place = (rows.column(c).to_numpy() for c in ("doc_id", "h", "place"))
    order = np.lexsort((place, h, doc_id))  # a context that is there twice comes from a repeated row
    once = np.append(True, np.any([x[order[1:]] != x[order[:-1]] for x in (doc_id, h, place)], axis=0))
    if not once.all():
        return _resolve(rows.take(pa.array(np.sort(order[once]))), firsts)
    n, start = place & _LOW, place >> 2 * _BITS
    like = _classes(body, off[:-1], np.diff(off), (place, h, doc_id))
    rep = np.flatnonzero(like == np.arange(len(n)))
    owner = np.repeat(rep, n[rep])
    inside = S.ragged(n[rep])
    begin = start[owner] + inside
    text, at = S.text_view(rows.column("body").combine_chunks().take(pa.array(rep))) if len(rep) < len(n) else (body, off)
    run, first = window_runs(text, np.repeat(at[:-1], n[rep]) + inside, (begin, h[owner], doc_id[owner]))
    gone = np.ones(len(run), bool)
    gone[first] = False
    new = np.ones(len(gone), bool)
    new[1:] = (gone[1:] != gone[:-1]) | (owner[1:] != owner[:-1])
    first = np.flatnonzero(new)
    many = np.diff(np.append(first, len(gone)))
    if not firsts:
        keep = gone[first]
        first, many = first[keep], many[keep]
    own, inner = owner[first], inside[first]
    anchor = ((place >> _BITS) & _LOW)[own]
    at = _place(begin[first], np.where(gone[first], 0, anchor - inner), many)
    gone, size = gone[first], np.where(gone[first], 0, many + LENGTH - 1)
    # the first of a run is a sorted window, so whoever else holds the context holds none of them: all its windows are gone
    copy = np.flatnonzero(like != np.arange(len(n)))
    own, inner = np.concatenate((own, copy)), np.concatenate((inner, np.zeros(len(copy), np.int64)))
    at, gone, size = np.concatenate((at, _place(start[copy], 0, n[copy]))), np.concatenate((gone, np.ones(len(copy), bool))), np.concatenate((size, np.zeros(len(copy), np.int64)))
    return pa.RecordBatch.from_arrays([pa.array(gone), pa.array(doc_id[own]), pa.array(h[own]), pa.array(at), _bodies(body, off[own] + inner, size)], names=["gone", "doc_id", "h", "place", "body"])


def _sort_buckets(bucket_bytes: int):
    """Rows come sorted by bucket; what is sorted at once is the rows of whole buckets, of bucket_bytes or one bucket."""

    def n_bytes(batch: pa.RecordBatch) -> int:
        return pc.sum(pc.binary_length(S.fields(batch, "body")[0])).as_py() or 0

    def resolved(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        hot = np.asarray(rows.column("hot"))
        for firsts in (False, True):
            if (hot == firsts).any():
                yield _resolve(rows.filter(pa.array(hot == firsts)), firsts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                held.append(batch.slice(at, 512))
                size += n_bytes(held[-1])
                if size >= bucket_bytes:
                    rows = pa.Table.from_batches(held)
                    keys = rows.column("bucket").to_numpy()
                    cut = int(np.searchsorted(keys, keys[-1]))
                    if cut:
                        yield from resolved(rows.slice(0, cut))
                        held = rows.slice(cut).to_batches()
                        size = sum(map(n_bytes, held))
        if held and sum(b.num_rows for b in held):
            yield from resolved(pa.Table.from_batches(held))

    return run


# --- removal -------------------------------------------------------------------------------------


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("h"))


def _sorted(contexts: DataFrame, n_bytes: int, bucket_bytes: int, most_runs: int, salt: int) -> DataFrame:
    """SORTED_SCHEMA of contexts; keys of more than most_runs of them are dealt out, and their first windows come along."""
    part = F.pmod(F.xxhash64("doc_id", "h", "place", F.lit(salt)), F.ceil(F.col("n") / most_runs))
    hot = F.col("n") > most_runs
    dealt = contexts.select(F.when(hot, F.xxhash64("key", part)).otherwise(F.col("key")).alias("bucket"), hot.alias("hot"), "doc_id", "h", "place", "body")
    dealt = dealt.repartition(S.n_tasks(contexts.sparkSession, n_bytes), "bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(_sort_buckets(bucket_bytes), SORTED_SCHEMA)


def removals(docs: DataFrame, bucket_bytes: int = BUCKET_BYTES, most_runs: int = MOST_RUNS) -> DataFrame:
    """(doc_id, h, places): the windows to remove of each document that has any, as places with anchor 0."""
    scratch = S.Scratch(docs.sparkSession)
    keyed = _keyed(docs).where(F.col("doc_id").isNotNull() & (F.octet_length("text") >= LENGTH))
    found = scratch.settle(keyed.mapInArrow(_find_runs, RUN_SCHEMA), "runs")
    # the keys are a table of their own: a join right behind their sum could not split a hot key
    twice = scratch.settle(found.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "repeated-anchors")
    wanted = found.join(twice, "key").groupBy("doc_id", "h").agg(F.collect_list(F.struct("key", "n", "place")).alias("runs"))
    wanted = wanted.select("doc_id", "h", F.col("runs.key").alias("keys"), F.col("runs.n").alias("of"), F.col("runs.place").alias("places"))
    wanted = scratch.settle(wanted, "wanted-runs", ("runs", "repeated-anchors"))
    n_bytes = 2 * LENGTH * (wanted.agg(F.sum(F.size("places"))).first()[0] or 0)
    # written, so that the shuffled texts are gone when the contexts are shuffled
    contexts = scratch.settle(keyed.join(wanted, ["doc_id", "h"]).mapInArrow(_cut_contexts, CONTEXT_SCHEMA), "contexts", ("wanted-runs",))
    rounds = [scratch.settle(_sorted(contexts, n_bytes, bucket_bytes, most_runs, 0), "sorted", ("contexts",))]
    while not (firsts := rounds[-1].where("NOT gone")).isEmpty():
        k = len(rounds)
        finer = firsts.mapInArrow(_refine(min(k, len(KEY_BYTES) - 1)), RUN_SCHEMA + ", body binary")
        finer = scratch.settle(finer, f"finer-{k}")
        count = scratch.settle(finer.groupBy("key").agg(F.count("*").alias("n"), F.sum(F.octet_length("body")).alias("b")).where("n > 1"), f"finer-keys-{k}")
        n_bytes = count.agg(F.sum("b")).first()[0] or 0
        rounds.append(scratch.settle(_sorted(finer.join(count.drop("b"), "key"), n_bytes, bucket_bytes, most_runs, k), f"sorted-{k}", (f"finer-{k}", f"finer-keys-{k}")))
    gone = rounds[0]
    for r in rounds[1:]:
        gone = gone.unionByName(r)
    gone = gone.where("gone").groupBy("doc_id", "h").agg(F.collect_set("place").alias("places"))
    return scratch.settle(gone, "removals", ("sorted", *(f"sorted-{k}" for k in range(1, len(rounds)))))


def _spans(length: int, places: np.ndarray) -> np.ndarray:
    """Maximal removed runs (begin, end) of a text."""
    begin = np.sort(places)
    begin, end = begin >> 2 * _BITS, (begin >> 2 * _BITS) + (begin & _LOW) + LENGTH - 1
    end = np.minimum(np.maximum.accumulate(end), length)
    new = np.append(True, begin[1:] > end[:-1])
    first = np.flatnonzero(new)
    return np.stack([begin[first], end[np.append(first[1:], len(begin)) - 1]], 1)


def _kept(text: pa.Array, places: pa.Array) -> Iterator[tuple[int, np.ndarray | None, bytes]]:
    """(bytes, spans, what remains) of each row."""
    raw, off = S.text_view(text)
    for i, own in enumerate(places):
        body = raw[off[i] : off[i + 1]]
        if not own.is_valid or not len(own):
            yield len(body), None, body.tobytes()
            continue
        spans = _spans(len(body), own.values.to_numpy())
        rest = zip(np.append(0, spans[:, 1]), np.append(spans[:, 0], len(body)))
        yield len(body), spans, b"".join([body[x:y].tobytes() for x, y in rest])


def suffix_dedup(docs: DataFrame, bucket_bytes: int = BUCKET_BYTES, most_runs: int = MOST_RUNS) -> DataFrame:
    """OUT_SCHEMA for each row of docs(doc_id, text), judged as UTF-8 bytes.

    A byte is removed if a string of LENGTH bytes that covers it, inside its text, also starts earlier: in a
    document of smaller doc_id, or before in the same one. A null text is empty. Rows alike in doc_id and
    text are one document and get the same result; rows that share a doc_id but not the text come in the order
    of a hash of their texts. Rows without a doc_id match nothing and are kept whole. Other columns are
    ignored, whatever their names; an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in S.blocks(batches):
            rows = [(n, n - len(rest), 0 if spans is None else len(spans), hashlib.sha256(rest).hexdigest()) for n, spans, rest in _kept(*S.fields(b.rows, "text", "places"))]
            yield pa.RecordBatch.from_arrays([S.fields(b.rows, "doc_id")[0], *(pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string())))], names=[x.split()[0] for x in OUT_SCHEMA.split(", ")])

    return _keyed(docs).join(removals(docs, bucket_bytes, most_runs), ["doc_id", "h"], "left").select("doc_id", "text", "places").mapInArrow(run, OUT_SCHEMA)


def without_repeats(docs: DataFrame, bucket_bytes: int = BUCKET_BYTES, most_runs: int = MOST_RUNS) -> DataFrame:
    """docs with the repeated bytes taken out of text, columns as they were; n_chars, if there, counts anew.

    A cut may fall inside a character; the rest of such a character goes too. Null and empty texts stay as they
    are, and so do rows without a doc_id; repeated rows are cut alike; other columns may have any names; an
    empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                row, places = S.fields(batch.slice(at, 512), "row", "places")
                row = dict(zip((f.name for f in row.type), row.flatten()))
                rest = [None if not t.is_valid else r.decode("utf-8", "ignore") for t, (_, _, r) in zip(row["text"], _kept(row["text"], places))]
                row["text"] = pa.array(rest, pa.string())
                yield pa.RecordBatch.from_arrays(list(row.values()), names=list(row))

    whole = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"))
    out = whole.join(removals(docs, bucket_bytes, most_runs), ["doc_id", "h"], "left").select("row", "places").mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
