"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

A text is cut where no piece of the vocabulary can reach across: before a word's leading marks and around
characters that stand in no piece of several. The distinct words that a task has not met yet are encoded together:
their symbols lie in one flat array, each round finds every word's best pair by a segmented minimum, merges its
leftmost occurrence (or all of them, where the merged symbol cannot form a better pair), and drops the words without
a pair left. Texts are then gathered from the words' ids, and decoding gathers bytes from ids.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared as S

MODEL = "piece_bpe_32k.model"
MARK = "▁"  # stands for a space
UNKNOWN_TEXT, BROKEN = " ⁇ ".encode(), "�".encode()  # what decoding writes for the unknown id and for a stray byte
#: Words that a task keeps, ids of theirs, and rounds after which a queue finishes what is left of long words.
MOST_WORDS, MOST_IDS, ROUNDS = 1_000_000, 8_000_000, 64
NONE = np.iinfo(np.int32).max


def model_path(name: str = MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Vocabulary:
    """Pieces, merges and bytes of a SentencePiece BPE model with byte fallback, a dummy prefix and no other normalisation."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.size = sp.vocab_size()
        plain = [i for i in range(n) if not (sp.is_unknown(i) or sp.is_control(i) or sp.is_byte(i))]
        self.byte_id = np.full(256, sp.unk_id(), np.int32)
        content = [b""] * n
        for i in range(n):
            if sp.is_byte(i):
                value = int(sp.id_to_piece(i)[3:5], 16)
                self.byte_id[value], content[i] = i, bytes([value])
            elif sp.is_unknown(i):
                content[i] = UNKNOWN_TEXT
        text = {i: sp.id_to_piece(i) for i in plain}
        for i, piece in text.items():
            content[i] = piece.replace(MARK, " ").encode()
        self.is_byte = np.array([sp.is_byte(i) for i in range(n)])
        self.is_control = np.array([sp.is_control(i) for i in range(n)])
        self.marked = np.array([i in text and text[i].startswith(MARK) for i in range(n)])
        self.n_bytes = np.array([len(b) for b in content], np.int64)
        self.first_byte = np.concatenate(([0], np.cumsum(self.n_bytes)))
        self.bytes = np.frombuffer(b"".join(content), np.uint8)
        self._merges({piece: i for i, piece in text.items()}, np.array([sp.get_score(i) for i in range(n)], np.float32))

    def _merges(self, ids: dict[str, int], score: np.ndarray) -> None:
        rank = np.unique(-score, return_inverse=True)[1].astype(np.int32)  # equal scores share a rank: the leftmost goes first
        self.char = np.full(0x110000, -1, np.int32)
        found: list[tuple[int, int, int]] = []
        self.hasty = np.zeros(self.size, bool)
        for piece, i in ids.items():
            if len(piece) == 1:
                self.char[ord(piece)] = i
            for k in range(1, len(piece)):
                a, b = ids.get(piece[:k]), ids.get(piece[k:])
                if a is not None and b is not None:
                    found.append((a, b, i))
                    self.hasty[[x for x in (a, b) if rank[i] <= rank[x]]] = True
        found.sort()
        pairs = np.array(found, np.int64).reshape(-1, 3)
        self.pair = np.append(pairs[:, 0] * self.size + pairs[:, 1], np.int64(-1) if not len(pairs) else np.iinfo(np.int64).max)
        self.merged = np.append(pairs[:, 2], 0).astype(np.int32)
        self.rank = np.append(rank[pairs[:, 2]], NONE).astype(np.int32)
        joined = "".join(sorted({c for piece in ids if len(piece) > 1 for c in piece if c != MARK}))
        inner = f"[{re.escape(joined)}]" if joined else r"(?!)"
        across = any(MARK in piece.lstrip(MARK) for piece in ids)
        self.words = re.compile(f"(?:{MARK}|{inner})+|." if across else f"{MARK}+{inner}*|{inner}+|.", re.S)

    def lookup(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Place of each pair among the merges; the last place, of rank NONE, for what is no merge."""
        key = left.astype(np.int64) * self.size + right
        at = np.searchsorted(self.pair, key)
        return np.where((self.pair[at] == key) & (left >= 0) & (right >= 0), at, len(self.pair) - 1)


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def _queue(v: Vocabulary, symbols: list[int]) -> list[tuple[int, int]]:
    """(place, symbol) of what is left of one word when its pairs are merged one by one, best rank and leftmost first."""
    n = len(symbols)
    after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    queue: list[tuple[int, int, int, int, int]] = []

    def offer(a: int, b: int) -> None:
        if symbols[a] >= 0 and symbols[b] >= 0:
            key = symbols[a] * v.size + symbols[b]
            at = int(np.searchsorted(v.pair, key))
            if v.pair[at] == key:
                heapq.heappush(queue, (int(v.rank[at]), a, symbols[a], symbols[b], int(v.merged[at])))

    for i in range(n - 1):
        offer(i, i + 1)
    while queue:
        _, a, left, right, merged = heapq.heappop(queue)
        b = after[a]
        if not alive[a] or b >= n or symbols[a] != left or symbols[b] != right:
            continue
        symbols[a], alive[b] = merged, False
        after[a] = after[b]
        if after[a] < n:
            before[after[a]] = a
            offer(a, after[a])
        if before[a] >= 0:
            offer(before[a], a)
    return [(i, symbols[i]) for i in range(n) if alive[i]]


def encode_words(v: Vocabulary, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all words one after the other, number of ids of each)."""
    code = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    word = np.repeat(np.arange(len(words)), np.fromiter(map(len, words), np.int64, len(words)))
    symbol, place = v.char[code], np.arange(len(code))  # place: of a symbol's first character
    done: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(ROUNDS):
        if not len(symbol):
            break
        first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
        at = np.full(len(symbol), len(v.pair) - 1)
        at[:-1] = v.lookup(symbol[:-1], symbol[1:])
        at[first[1:] - 1] = len(v.pair) - 1  # a word's last symbol has no pair
        rank = v.rank[at]
        size = np.diff(np.append(first, len(symbol)))
        best = np.minimum.reduceat(rank, first)
        over = np.repeat(best == NONE, size)
        hit = np.flatnonzero((rank == np.repeat(best, size)) & ~over)
        merged = v.merged[at[hit]]
        # of neighbouring pairs every second one goes; of a hasty symbol's pairs only the word's leftmost
        new_run = np.append(True, hit[1:] != hit[:-1] + 1)[: len(hit)]
        odd = (hit - np.maximum.accumulate(np.where(new_run, hit, 0))) & 1
        leftmost = np.append(True, word[hit[1:]] != word[hit[:-1]])[: len(hit)]
        hasty = v.hasty[merged] | np.repeat(np.maximum.reduceat(v.hasty[merged], np.flatnonzero(leftmost)), np.diff(np.append(np.flatnonzero(leftmost), len(hit)))) if len(hit) else np.zeros(0, bool)
        take = np.where(hasty, leftmost, odd == 0)
        symbol[hit[take]] = merged[take]
        keep = ~over
        keep[hit[take] + 1] = False
        done.append((place[over], symbol[over]))
        symbol, place, word = symbol[keep], place[keep], word[keep]
    if len(symbol):
        first = np.append(np.flatnonzero(np.append(True, word[1:] != word[:-1])), len(symbol))
        for a, b in zip(first[:-1], first[1:]):
            left = _queue(v, symbol[a:b].tolist())
            done.append((place[a:b][[i for i, _ in left]], np.array([s for _, s in left], np.int32)))
    place, symbol = (np.concatenate([d[k] for d in done]) if done else np.zeros(0, np.int64) for k in (0, 1))
    order = np.argsort(place)
    return _with_bytes(v, symbol[order], code[place[order]], np.repeat(np.arange(len(words)), np.fromiter(map(len, words), np.int64, len(words)))[place[order]], len(words))


def _with_bytes(v: Vocabulary, symbol: np.ndarray, code: np.ndarray, word: np.ndarray, n_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Replace characters outside the vocabulary, symbol -1, by the ids of their UTF-8 bytes."""
    unknown = symbol < 0
    width = np.ones(len(symbol), np.int64)
    width[unknown] = 1 + (code[unknown] >= 0x80) + (code[unknown] >= 0x800) + (code[unknown] >= 0x10000).astype(np.int64)
    ids = np.repeat(symbol, width)
    if unknown.any():
        raw = np.frombuffer(code[unknown].astype("<u4").tobytes().decode("utf-32-le").encode(), np.uint8)
        ids[np.repeat(unknown, width)] = v.byte_id[raw]
    return ids.astype(np.int32), np.bincount(word, width, n_words).astype(np.int64)


class Codec:
    """Encoder and decoder of one task; it keeps the ids of words that it has met, up to a bound."""

    def __init__(self, path: str):
        self.v = vocabulary(path)
        self._forget()

    def _forget(self) -> None:
        self.at: dict[str, int] = {}
        self.ids, self.count, self.first, self.used = np.zeros(1 << 16, np.int32), np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64), 0

    def _learn(self, words: list[str]) -> None:
        ids, count = encode_words(self.v, words)
        have = len(self.at)
        while len(self.ids) < self.used + len(ids):
            self.ids = np.concatenate((self.ids, np.zeros_like(self.ids)))
        while len(self.count) < have + len(words):
            self.count, self.first = (np.concatenate((x, np.zeros_like(x))) for x in (self.count, self.first))
        self.ids[self.used : self.used + len(ids)] = ids
        self.count[have : have + len(words)] = count
        self.first[have : have + len(words)] = self.used + np.cumsum(count) - count
        self.used += len(ids)
        self.at.update(zip(words, range(have, have + len(words))))

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, where each text's ids start and the last end)."""
        if len(self.at) > MOST_WORDS or self.used > MOST_IDS:
            self._forget()
        words = [self.v.words.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        flat = [w for ws in words for w in ws]
        if new := list(dict.fromkeys(w for w in flat if w not in self.at)):
            self._learn(new)
        at = np.fromiter(map(self.at.__getitem__, flat), np.int64, len(flat))
        count = self.count[at]
        ids = self.ids[np.repeat(self.first[at], count) + S.ragged(count)]
        ends = np.concatenate(([0], np.cumsum(count)))
        return ids, ends[np.cumsum([0, *map(len, words)])]

    def decode(self, ids: np.ndarray, off: np.ndarray) -> list[str]:
        """The text of each ids[off[i]:off[i+1]]; the space of the dummy prefix goes, stray bytes become U+FFFD."""
        v = self.v
        known = (ids >= 0) & (ids < v.size)
        if not known.all():
            raise ValueError(f"no piece has the id {ids[~known][0]}")
        count = v.n_bytes[ids]
        raw = v.bytes[np.repeat(v.first_byte[ids], count) + S.ragged(count)].tobytes()
        ends = np.concatenate(([0], np.cumsum(count)))
        shown = np.flatnonzero(~v.is_control[ids])
        lead = np.append(shown, len(ids))[np.searchsorted(shown, off[:-1])]  # a text's first id that is no control id
        prefixed = (lead < off[1:]) & v.marked[np.append(ids, 0)[lead]]
        out = []
        for i, (a, b) in enumerate(zip(ends[off[:-1]], ends[off[1:]])):
            try:
                out.append(raw[a + prefixed[i] : b].decode())
            except UnicodeDecodeError:
                out.append(self._mend(ids[off[i] : off[i + 1]])[int(prefixed[i]) :])
        return out

    def _mend(self, ids: np.ndarray) -> str:
        """Text of ids whose byte pieces are not UTF-8 throughout: each byte outside a whole character is BROKEN."""
        v, out, run = self.v, [], b""
        for i in [*ids.tolist(), -1]:
            if i >= 0 and v.is_byte[i]:
                run += bytes(v.bytes[v.first_byte[i] : v.first_byte[i + 1]])
                continue
            while run:
                for n in (1, 2, 3, 4):
                    try:
                        out.append(run[:n].decode().encode())
                        run = run[n:]
                        break
                    except UnicodeDecodeError:
                        pass
                else:
                    out.append(BROKEN)
                    run = run[1:]
            if i >= 0:
                out.append(bytes(v.bytes[v.first_byte[i] : v.first_byte[i + 1]]))
        return b"".join(out).decode()


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, ids array<int>) for each row of docs(doc_id, text): the ids of the model at `path`, without begin or end.

    Null and empty texts have no ids; repeated rows are encoded each by itself, a null doc_id stays null, other
    columns are ignored, an empty table gives an empty result. A task's memory follows one block of texts or one
    longer text, and the words it keeps, at most MOST_WORDS and MOST_IDS before a block.
    """
    path = path or model_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(path)
        for b in S.blocks(batches):
            doc_id, text = S.fields(b.rows, "doc_id", "text")
            ids, off = codec.encode(text.to_pylist())
            yield pa.RecordBatch.from_arrays([doc_id, pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(ids))], names=["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode(tokens: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, ids, text) for each row of tokens(doc_id, ids array<int>); no ids, or a null array, give an empty text. An id outside the vocabulary is an error."""
    path = path or model_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(path)
        for batch in batches:
            ids = batch.column(1)
            flat, count = ids.flatten(), ids.value_lengths().fill_null(0)
            off = np.concatenate(([0], np.cumsum(np.asarray(count), dtype=np.int64)))
            at = 0
            while at < len(ids):  # some rows at a time, so that the temporaries stay small
                to = min(max(at + 1, int(np.searchsorted(off, off[at] + S.BLOCK_BYTES, "right")) - 1), len(ids))
                part = np.asarray(flat[off[at] : off[to]])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, to - at), ids.slice(at, to - at), pa.array(codec.decode(part, off[at : to + 1] - off[at]), pa.string())], names=["doc_id", "ids", "text"])
                at = to

    return tokens.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids")).mapInArrow(run, "doc_id long, ids array<int>, text string")


def piece_digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) for each row of docs(doc_id, text); see encode and decode."""
    return decode(encode(docs, path), path).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"),
    )
