"""Sequence packing by the online sum-of-squares rule.

A document's whole windows of SEQUENCE ids are sequences of their own. What remains of it goes, as it comes, to
the fill level that leaves the smallest sum over levels of the squared number of open sequences at that level; a
level array holds these numbers. A level is a sixteenth of a sequence wide. A sequence with less than that to go
leaves the levels and is filled up with the first ids of the remainders that follow.

At the end of a partition the emptiest open sequences are cut up to fill the gaps of the fullest, so that most stay
as they were placed, and the last one is cut at powers of two, which need no padding. Partitions pack on their own:
there is no shuffle, and a partition that runs again makes the same sequences with the same ids.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared as S

SEQUENCE = 2048
END_ID = 1
LEVELS = 16
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_BYTES = 4  # of an id: little-endian unsigned 32-bit


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Ids of texts as bytes, by a byte-level BPE of `tokenizers`.

    Its pre-tokenizer never joins characters over a single space between two other characters, so such a text
    splits at its spaces into parts whose ids can be kept. Texts with other white space next to a space, or
    with characters outside SAFE, are encoded whole.
    """

    SAFE = re.compile(r"[^\n -~À-ɏ]")
    PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
    MOST_KEPT = 1_000_000

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        # byte-level BPE writes a byte as its own character if that is visible, else as one from 256 on
        shown = [b for b in range(256) if chr(b).isprintable() and b != 0x20]
        hidden = [b for b in range(256) if b not in shown]
        self.letters = {b: 256 + k for k, b in enumerate(hidden)}
        encoder = self

        class Parts(dict):
            def __missing__(self, part: str) -> bytes:
                if len(self) >= encoder.MOST_KEPT:
                    self.clear()
                pieces = encoder.PIECE.findall(part)
                ids = encoder._piece(part) if len(pieces) == 1 else b"".join(map(self.__getitem__, pieces))
                self[part] = ids
                return ids

        self.parts = Parts()

    def _whole(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _piece(self, piece: str) -> bytes:
        """Ids of what the pre-tokenizer leaves in one piece: the BPE model's own."""
        tokens = self.tokenizer.model.tokenize(piece.encode().decode("latin-1").translate(self.letters))
        return b"".join([t.id.to_bytes(_BYTES, "little") for t in tokens])

    def __call__(self, text: str) -> bytes:
        if "  " in text or " \n" in text or "\n " in text or text[:1] == " " or text[-1:] == " " or self.SAFE.search(text) or any(s in text for s in self.special):
            return self._whole(text)
        return b"".join(map(self.parts.__getitem__, text.replace(" ", "\t ").split("\t")))


class Packer:
    """Sum-of-squares packing of one stream of documents; rows() are the pieces of closed sequences.

    `rest` counts the ids that lie in no whole window, `moved` those of them that finish() takes from where they were placed.
    """

    def __init__(self, size: int, first_sequence: int, levels: int = LEVELS):
        self.size, self.next = size, first_sequence
        self.grain = max(size // levels, 1)
        self.levels = np.zeros(size // self.grain, np.int64)  # open sequences by fill; the last level is always 0
        self.open: list[list[tuple[int, list]]] = [[] for _ in self.levels]  # (fill, pieces)
        self.short: list[tuple[int, list]] = []  # open sequences of the last level
        self.closed: list[tuple] = []
        self.rest = self.moved = 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        n = len(ids) // _BYTES
        whole = n - n % self.size
        for start in range(0, whole, self.size):
            self._close([(doc_id, start, ids[start * _BYTES : (start + self.size) * _BYTES], n)])
        self.rest += n - whole
        piece = (doc_id, whole, ids[whole * _BYTES :], n)
        while self.short and piece[2]:
            fill, pieces = self.short.pop()
            head, piece = self._cut(piece, self.size - fill)
            self._put(fill, pieces, head)
        if piece[2]:
            self._place(piece)

    @staticmethod
    def _cut(piece: tuple, most: int) -> tuple[tuple, tuple]:
        """The first `most` ids of a piece, and the others."""
        doc_id, start, ids, n = piece
        return (doc_id, start, ids[: most * _BYTES], n), (doc_id, start + most, ids[most * _BYTES :], n)

    def _place(self, piece: tuple) -> None:
        n, level = len(piece[2]) // _BYTES, self.levels
        last = len(level) - 1
        best, best_h = (2 * level[n // self.grain] + 1 if n // self.grain < last else 0), None
        for h in range(last - 1, -1, -1):
            if level[h] and (to := self.open[h][-1][0] + n) <= self.size:
                # a sequence leaves level h, and comes to a higher one unless that is the last
                up = min(to // self.grain, last)
                change = 0 if up == h else 1 - 2 * level[h] + (2 * level[up] + 1 if up < last else 0)
                if change < best:
                    best, best_h = change, h
        fill, pieces = (0, []) if best_h is None else self.open[best_h].pop()
        if best_h is not None:
            level[best_h] -= 1
        self._put(fill, pieces, piece)

    def _put(self, fill: int, pieces: list, piece: tuple) -> None:
        pieces.append(piece)
        fill += len(piece[2]) // _BYTES
        h = fill // self.grain
        if fill == self.size:
            self._close(pieces)
        elif h == len(self.levels) - 1:
            self.short.append((fill, pieces))
        else:
            self.open[h].append((fill, pieces))
            self.levels[h] += 1

    def _close(self, pieces: list[tuple]) -> None:
        offset = 0
        for doc_id, start, ids, n in pieces:
            length = len(ids) // _BYTES
            self.closed.append((doc_id, start, length, zlib.crc32(ids), n, self.next, offset))
            offset += length
        self.next += 1

    def finish(self) -> None:
        """Fill the gaps of the fullest open sequences with ids of the emptiest, and cut the last one at powers of two."""
        left = sorted(self.short + [x for held in self.open for x in held], key=lambda x: -x[0])
        self.short, self.open = [], [[] for _ in self.levels]
        self.levels[:] = 0
        while len(left) > 1:
            fill, pieces = left.pop(0)
            while fill < self.size and left:
                held, own = left.pop()
                head, piece = self._cut(own.pop(0), self.size - fill)
                pieces.append(head)
                took = len(head[2]) // _BYTES
                fill, self.moved = fill + took, self.moved + took
                own = [piece, *own] if piece[2] else own
                if own:
                    left.append((held - took, own))
            left = [(fill, pieces), *left] if fill < self.size else left
            if fill == self.size:
                self._close(pieces)
        for fill, pieces in left:
            self.moved += fill
            while fill:
                room, some = 1 << (fill.bit_length() - 1), []
                fill -= room
                while room:
                    head, piece = self._cut(pieces.pop(0), room)
                    some.append(head)
                    room -= len(head[2]) // _BYTES
                    pieces = [piece, *pieces] if piece[2] else pieces
                self._close(some)

    def rows(self) -> pa.RecordBatch:
        columns = list(zip(*self.closed)) or [()] * 7
        self.closed = []
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=[x.split()[0] for x in SCHEMA.split(", ")])


def pack(docs: DataFrame, path: str | None = None, size: int = SEQUENCE) -> DataFrame:
    """The pieces of all docs(doc_id, text) packed into sequences of at most `size` ids; `size` is a power of two.

    A document is its text's ids and then END_ID; a null or empty text has that id alone. Each id lies in
    exactly one piece. Repeated rows are packed each; a null doc_id stays null; other columns are ignored; an
    empty table gives an empty result. Memory holds a block of texts and the open remainders.
    """
    path = path or tokenizer_path()
    end = np.asarray([END_ID], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, packer = _encoder(path), Packer(size, TaskContext.get().partitionId() << 40)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                for doc_id, text in zip(*(c.to_pylist() for c in S.fields(some, "doc_id", "text"))):
                    packer.add(doc_id, encoder(text or "") + end)
                yield packer.rows()
        packer.finish()
        yield packer.rows()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)


_ENCODERS: dict[str, Encoder] = {}


def _encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
