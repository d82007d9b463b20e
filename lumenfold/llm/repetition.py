"""Quality rules by repetition coverage.

Rolling hashes of n-word windows of several lengths mark, inside each text, the windows that occur twice or
more; a text's coverage at length n is the share of its word characters that lie inside such windows. Lines
count likewise. Everything is computed within one text, so there is no shuffle and no state between rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared as S

#: Most of a text's word characters that may lie in repeated windows of so many words.
COVERAGE_LIMITS = {5: 0.15, 7: 0.13, 10: 0.10}
#: Most of a text's word characters that may lie in lines seen before, and most of its lines.
LINE_CHAR_LIMIT, LINE_LIMIT = 0.20, 0.30
BASE_WINDOW, MIN_WORDS, MAX_REPEAT_PERCENT = 3, 50, 50

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, "
    + ", ".join(f"dup_chars_{n} long" for n in COVERAGE_LIMITS)
    + ", n_lines long, dup_line_chars long"
)


def _repeated(keys: np.ndarray) -> np.ndarray:
    """True where a key occurs twice or more."""
    if len(keys) < 2:
        return np.zeros(len(keys), bool)
    ordered = np.sort(keys)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(twice):
        return np.zeros(len(keys), bool)
    at = np.searchsorted(twice, keys)
    return twice[np.minimum(at, len(twice) - 1)] == keys


def _rolled(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sums of hash * base**place up to each word, powers of the inverse base): any window's hash is a difference of two sums, shifted back."""
    up, down = S._powers(len(hashes) + 1)
    total = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * up[: len(hashes)], out=total[1:])
    return total, down


def _covered(rolled: tuple[np.ndarray, np.ndarray], first: np.ndarray, n: int, among: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """(which words lie in an n-word window that its text repeats, the starts of those windows).

    among: starts of repeated windows of a smaller length; a repeated window starts at one of them.
    """
    total, down = rolled
    count = len(total) - 1
    words = np.zeros(count + 1, np.int64)
    if count < n:
        return words[:-1].astype(bool), np.zeros(0, np.int64)
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    starts = np.arange(count - n + 1) if among is None else among[among <= count - n]
    starts = starts[text[starts] == text[starts + n - 1]]
    key = S.mix((total[starts + n] - total[starts]) * down[starts]) ^ S.mix(text[starts].astype(np.uint64) + np.uint64(1))
    starts = starts[_repeated(key)]
    np.add.at(words, starts, 1)
    np.add.at(words, starts + n, -1)
    return np.cumsum(words)[:-1] > 0, starts


def _lines(buf: np.ndarray, off: np.ndarray, starts: np.ndarray, chars_before: np.ndarray) -> tuple[np.ndarray, ...]:
    """Per text: lines with a word, those equal to an earlier line, and the word characters in the latter."""
    n = len(off) - 1
    if not len(buf):
        return (np.zeros(n, np.int64),) * 3
    breaks = np.flatnonzero(buf == 10)
    begin = np.unique(np.concatenate((off[:-1][off[:-1] < off[1:]], breaks + 1)))
    begin = begin[begin < len(buf)]
    text = np.searchsorted(off, begin, "right") - 1
    next_break = np.append(breaks, len(buf))[np.searchsorted(breaks, begin)]
    end = np.minimum(next_break, off[text + 1])
    full = np.searchsorted(starts, end) > np.searchsorted(starts, begin)
    begin, end, text = begin[full], end[full], text[full]
    key = S.range_hash(buf, begin, end) ^ S.mix(text.astype(np.uint64) + np.uint64(1))
    order = np.argsort(key, kind="stable")  # equal lines stay in the order of the text
    again = np.zeros(len(key), bool)
    again[order[1:]] = key[order[1:]] == key[order[:-1]]
    chars = chars_before[end] - chars_before[begin]
    return np.bincount(text, minlength=n), np.bincount(text[again], minlength=n), np.bincount(text[again], chars[again], n).astype(np.int64)


def measure(buf: np.ndarray, off: np.ndarray) -> dict[str, np.ndarray]:
    """The counts of SCHEMA for each text of a block."""
    starts, ends, first = S.word_ranges(buf, off)
    hashes = S.range_hash(buf, starts, ends) if len(starts) else np.zeros(0, np.uint64)
    chars_before = np.zeros(len(buf) + 1, np.int64)
    np.cumsum(((buf & 0xC0) != 0x80) & ~S._SPACE[buf], out=chars_before[1:])
    word_chars = chars_before[ends] - chars_before[starts]
    out = {"n_words": np.diff(first), "word_chars": chars_before[off[1:]] - chars_before[off[:-1]], "n_symbols": S.per_text(_SYMBOL[buf], off)}
    out["n_lines"], out["n_dup_lines"], out["dup_line_chars"] = _lines(buf, off, starts, chars_before)
    rolled = _rolled(hashes)
    hit, among = _covered(rolled, first, BASE_WINDOW, None)
    out["n_repeat_words"] = S.per_text(hit, first)
    for n in sorted(COVERAGE_LIMITS):
        hit, among = _covered(rolled, first, n, among)
        out[f"dup_chars_{n}"] = S.per_text(np.where(hit, word_chars, 0), first)
    return out


def _verdict(m: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    failed = (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > MAX_REPEAT_PERCENT * m["n_words"])
    kept = ~failed & (m["dup_line_chars"] <= LINE_CHAR_LIMIT * m["word_chars"]) & (m["n_dup_lines"] <= LINE_LIMIT * m["n_lines"])
    for n, most in COVERAGE_LIMITS.items():
        kept &= m[f"dup_chars_{n}"] <= most * m["word_chars"]
    return failed, kept


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    for b in S.blocks(batches):
        m = measure(b.buf, b.off)
        m["base_failed"], m["kept"] = _verdict(m)
        yield pa.RecordBatch.from_arrays([S.fields(b.rows, "doc_id")[0], *(pa.array(m[n]) for n in names[1:])], names=names)


def repetition_quality(docs: DataFrame) -> DataFrame:
    """Repetition measures and the verdict for each row of docs(doc_id, text).

    Words are `[^\\x20\\x09-\\x0D]+`, cases kept apart. Null and empty texts have no words and fail the base
    rule; repeated rows are judged each by itself, a null doc_id stays null, other columns are ignored, an
    empty table gives an empty result. Memory follows one block or one text, whichever is longer.
    """
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_run, SCHEMA)
