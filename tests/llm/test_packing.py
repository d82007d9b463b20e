import zlib
from collections import defaultdict

import numpy as np
import pytest

from lumenfold.llm import packing as P

TEXTS = ["", "one", "two words", "  double  spaces ", "tab\there", "Größe ½ ² 日本 ", "a\n\nb\n c \nd", "it's we'll 'sup don''t", "x<|endoftext|> y", "nb sp  x", "a_b 1_2 3.14 ×÷", "e\x1cf \x0b g"]


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(P.tokenizer_path())


def test_encoder_gives_the_tokenizers_ids(tokenizer, spark):
    encoder = P.Encoder(P.tokenizer_path())
    more = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    for t in TEXTS + more:
        assert np.frombuffer(encoder(t), "<u4").tolist() == tokenizer.encode(t, add_special_tokens=False).ids, t


def check(rows, texts, tokenizer, size):
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    assert by_doc.keys() == texts.keys()
    for i, pieces in by_doc.items():
        ids = np.array([*tokenizer.encode(texts[i] or "", add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for p in sorted(pieces, key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids) and p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes())
            at += p.length
        assert at == len(ids)
    padding = 0
    for pieces in by_seq.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at and p.length > 0
            at += p.length
        assert at <= size
        padding += 0 if at & (at - 1) == 0 else size - at
    return padding


def test_every_id_in_one_piece_and_no_padding(spark, tokenizer):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert check(P.pack(docs).collect(), {r.doc_id: r.text for r in docs.collect()}, tokenizer, 2048) == 0


def test_odd_rows(spark, tokenizer):
    texts = {i: t for i, t in enumerate([*TEXTS, None, "long text " * 30_000])}
    docs = spark.createDataFrame([(i, t, i) for i, t in texts.items()], "doc_id long, text string, start long")
    assert check(P.pack(docs, size=64).collect(), texts, tokenizer, 64) == 0
    assert P.pack(docs.limit(0)).collect() == []
    twice = spark.createDataFrame([(None, "a b"), (None, "a b")], "doc_id long, text string")
    assert sum(r.length for r in P.pack(twice).collect()) == 2 * 3


def test_level_choice_is_the_least_sum_of_squares():
    rng, packer = np.random.default_rng(7), P.Packer(16, 0, 16)
    for _ in range(400):
        n = int(rng.integers(1, 16))
        before = packer.levels.copy()
        packer.short.clear()  # so that nothing is filled up first; at this grain a level has one fill
        packer.add(0, bytes(4 * n))
        best = None
        for h in [0, *np.flatnonzero(before[1:]) + 1]:
            if h + n <= 16:
                after = before.copy()
                if h:
                    after[h] -= 1
                if h + n < 15:
                    after[h + n] += 1
                best = min(best, (after**2).sum()) if best is not None else (after**2).sum()
        assert (packer.levels**2).sum() == best


def test_placement_decides_at_least_nine_tenths_of_the_remainders(spark):
    encoder = P.Encoder(P.tokenizer_path())
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").orderBy("doc_id").collect()
    rest = moved = 0
    for k in range(8):
        packer = P.Packer(P.SEQUENCE, 0)
        for r in rows[k * len(rows) // 8 : (k + 1) * len(rows) // 8]:
            packer.add(r.doc_id, encoder(r.text or "") + b"\1\0\0\0")
        packer.finish()
        rest, moved = rest + packer.rest, moved + packer.moved
    assert rest > 100_000 and moved <= 0.1 * rest
