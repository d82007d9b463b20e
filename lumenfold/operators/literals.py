"""Many literals in one pass over texts: an Aho-Corasick automaton over byte classes, run in numpy.

The automaton holds the first HEAD bytes of each literal, so it stays small whatever the literals' length; what follows a
head is compared where the head was seen. A block of texts is cut into lanes that run in step, one gather a byte for all of
them. A state depends on the last HEAD bytes only, so a lane that starts HEAD - 1 bytes early is in the right state.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HEAD = 12
LANE, BLOCK = 512, 1 << 20  # bytes of a lane and of a block of texts
_JOINS = np.zeros(256, bool)  # bytes beside which a literal isn't a token of its own
_JOINS[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789@._/-")] = True
#: Literals of one automaton, the part of a table that is sent to tasks at once; larger tables take several scans.
SLICE_BYTES, SLICE_ROWS = 16 << 20, 100_000


class Automaton:
    """Heads of literals as a complete transition table over the byte values that occur in them."""

    def __init__(self, literals: list[bytes]):
        if any(not x for x in literals):
            raise ValueError("a literal has no bytes")
        self.literals = literals
        heads = [x[:HEAD] for x in literals]
        used = sorted(set(b"".join(heads)))
        self.byte_class = np.zeros(256, np.uint8 if len(used) < 255 else np.uint16)  # class 0: in no literal, or between texts
        self.byte_class[used] = np.arange(1, len(used) + 1)
        width = self.width = len(used) + 1
        children: list[dict[int, int]] = [{}]
        at_end: dict[int, list[int]] = {}
        for n, head in enumerate(heads):
            state = 0
            for c in self.byte_class[list(head)].tolist():
                if c not in children[state]:
                    children[state][c] = len(children)
                    children.append({})
                state = children[state][c]
            at_end.setdefault(state, []).append(n)
        table = np.zeros((len(children), width), np.int32)
        #: the nearest state at or above, by suffixes, where a head ends; state 0 for none
        self.ends, fail = np.zeros(len(children), np.int32), np.zeros(len(children), np.int32)
        table[0, list(children[0])] = list(children[0].values())
        level = list(children[0].values())
        while level:
            below = []
            for state in level:
                self.ends[state] = state if state in at_end else self.ends[fail[state]]
                table[state] = table[fail[state]]
                for c, child in children[state].items():
                    fail[child] = table[state, c]
                    table[state, c] = child
                    below.append(child)
            level = below
        self.shorter = self.ends[fail]  # the next shorter head that ends where a state's does
        self.table = table.ravel()
        states = sorted(at_end)
        self.first = np.zeros(len(children) + 1, np.int64)
        self.first[np.array(states, np.int64) + 1] = [len(at_end[s]) for s in states]
        self.first = np.cumsum(self.first)
        self.at = np.array([n for s in states for n in at_end[s]], np.int64)
        self.size = np.array([len(x) for x in literals], np.int64)
        self.head = np.minimum(self.size, HEAD)

    def heads(self, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place of a head's last byte, literal) for all heads in an array of byte classes."""
        lanes = -(-len(code) // LANE)
        padded = np.zeros(HEAD - 1 + lanes * LANE, code.dtype)
        padded[HEAD - 1 : HEAD - 1 + len(code)] = code
        steps = np.lib.stride_tricks.as_strided(padded, (lanes, LANE + HEAD - 1), (LANE * code.itemsize, code.itemsize)).T.astype(np.int32)
        state = np.zeros(lanes, np.int32)
        seen: list[tuple[np.ndarray, np.ndarray]] = []
        for k in range(LANE + HEAD - 1):
            state = self.table[state * self.width + steps[k]]
            if k >= HEAD - 1:
                end = self.ends[state]
                lane = np.flatnonzero(end)
                if len(lane):
                    seen.append((lane * LANE + k - HEAD + 1, end[lane]))
        if not seen:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        place, end = (np.concatenate([s[k] for s in seen]) for k in (0, 1))
        places, found = [], []
        while len(place):
            n = self.first[end + 1] - self.first[end]
            places.append(np.repeat(place, n))
            found.append(self.at[np.repeat(self.first[end], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)])
            end = self.shorter[end]
            place, end = place[end > 0], end[end > 0]
        return np.concatenate(places), np.concatenate(found)

    def find(self, texts: list[bytes], tokens: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, literal, first byte in the text) of every occurrence, overlapping ones included; with `tokens`, of those that stand alone."""
        raw = b"\0".join(texts) + b"\0"
        starts = np.cumsum([0, *(len(t) + 1 for t in texts)])
        code = self.byte_class[np.frombuffer(raw, np.uint8)]
        code[starts[1:] - 1] = 0
        place, literal = self.heads(code)
        begin = place - self.head[literal] + 1
        text = np.searchsorted(starts, begin, "right") - 1
        inside = begin + self.size[literal] < starts[text + 1]
        if tokens:
            joins = _JOINS[np.frombuffer(raw, np.uint8)]
            inside[inside] = ~joins[begin[inside] - 1] & ~joins[begin[inside] + self.size[literal[inside]]]
        begin, text, literal = begin[inside], text[inside], literal[inside]
        long = self.size[literal] > HEAD
        whole = ~long
        view = memoryview(raw)
        whole[long] = [view[b : b + n] == self.literals[x] for b, x, n in zip(begin[long].tolist(), literal[long].tolist(), self.size[literal[long]].tolist())]
        return text[whole], literal[whole], (begin - starts[text])[whole]


def _slices(literals: DataFrame) -> list[DataFrame]:
    """literals(literal) in parts that fit into an automaton."""
    n, size = literals.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("literal")), F.lit(0))).first()
    parts = max(-(-size // SLICE_BYTES), -(-n // SLICE_ROWS))
    if parts == 1:
        return [literals]
    parts *= 2  # rows fall into parts by hash, unevenly
    return [literals.where(F.pmod(F.xxhash64("literal"), F.lit(parts)) == k) for k in range(parts)]


def occurrences(texts: DataFrame, literals: DataFrame, key: str = "rel", tokens: bool = False) -> DataFrame:
    """(key, literal_id, n, first): how often texts(key, text) hold each of literals(literal_id long, literal), and at which byte first.

    Occurrences may overlap; with `tokens`, none counts that touches a letter, a digit or one of `@._/-`. Texts are read once for each slice of the literals, which is one slice up to SLICE_BYTES and
    SLICE_ROWS; a task holds a slice's automaton and one block of texts, or one longer text. Null texts hold nothing, null
    and empty literals are in no text; literals that are equal are each found: the automaton has them once, and what is found meets
    their ids in a join.
    """
    spark, out = texts.sparkSession, None
    rows = texts.where(F.col("text").isNotNull()).select(F.col(key).alias("key"), F.col("text").cast("binary").alias("text"))
    kind = rows.schema["key"].dataType
    schema = f"`{key}` {kind.simpleString()}, literal binary, n long, first long"
    ids = literals.where("literal <> ''").select(F.col("literal_id").cast("long").alias("literal_id"), F.col("literal").cast("binary").alias("literal"))
    for part in _slices(ids.select("literal").distinct()):
        held = part.collect()  # bounded by the size of a slice
        if not held:
            continue
        shared = spark.sparkContext.broadcast(Automaton([bytes(r.literal) for r in held]))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            automaton = shared.value
            for batch in batches:
                texts, at = batch.column(1).to_pylist(), 0
                while at < len(texts):
                    to, size = at, 0
                    while to < len(texts) and (to == at or size + len(texts[to]) <= BLOCK):
                        size += len(texts[to])
                        to += 1
                    text, literal, begin = automaton.find(texts[at:to], tokens)
                    order = np.lexsort((begin, literal, text))
                    text, literal, begin = text[order], literal[order], begin[order]
                    new = np.flatnonzero(np.append(True, (text[1:] != text[:-1]) | (literal[1:] != literal[:-1]))[: len(text)])
                    n = np.diff(np.append(new, len(text)))
                    found = pa.array([automaton.literals[x] for x in literal[new].tolist()], pa.binary())
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(text[new] + at)), found, pa.array(n), pa.array(begin[new])], names=[key, "literal", "n", "first"])
                    at = to

        found = rows.mapInArrow(run, schema)
        out = found if out is None else out.unionByName(found)
    if out is None:
        return spark.createDataFrame([], f"`{key}` {kind.simpleString()}, literal_id long, n long, first long")
    return out.join(ids, "literal").select(key, "literal_id", "n", "first")
