import hashlib
import random

import numpy as np
import pytest
import sentencepiece

from lumenfold.llm import pieces as P


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=P.model_path())


@pytest.fixture(scope="module")
def codec():
    return P.Codec(P.model_path())


def same(codec, library, texts):
    ids, off = codec.encode(texts)
    decoded = codec.decode(ids, off)
    for i, t in enumerate(texts):
        want = library.encode(t or "")
        assert ids[off[i] : off[i + 1]].tolist() == want, (t or "")[:80]
        assert decoded[i] == library.decode(want)


ODD = ["", None, " ", "  ", "a", " a", "a  b", "\x00a", "a\tb", "é é", "▁x", "<s>hi</s><unk><0x41>", "日本語 text", "\U0001f600\U0001f600 \U0001f600", "\r\n", "a ", "12345", "x\n\n\ny", "abc▁▁ def", "ﬁ Å 　x"]
LONG = ["ab" * 3000, "th" * 3000, " " * 5000 + "x", "a" * 5001, "=" * 777, "andand" * 400, "returnreturn" * 300, "word " * 40_000]


def test_odd_and_long_texts(codec, library):
    same(codec, library, ODD)
    same(codec, library, LONG)
    same(codec, library, [])


def test_texts_of_hasty_pairs(codec, library):
    """Pieces that a better pair can follow, next to one another, in words short and long."""
    v, pick = codec.v, random.Random(5)
    parts = [library.id_to_piece(int(i)) for i in pick.sample(np.flatnonzero(v.hasty).tolist(), 300)]
    for _ in range(60):
        same(codec, library, ["".join(pick.choice(parts) for _ in range(pick.randint(1, 60))) for _ in range(5)])


def test_random_characters(codec, library):
    pick = random.Random(6)
    alphabet = "abcdehinorst ▁\n12é日\U0001f600-=/._A"
    for _ in range(60):
        same(codec, library, ["".join(pick.choice(alphabet) for _ in range(pick.randint(0, 200))) for _ in range(10)])


def test_the_queue_gives_what_the_rounds_give(codec, library, monkeypatch):
    monkeypatch.setattr(P, "ROUNDS", 0)
    same(P.Codec(P.model_path()), library, [t for t in ODD + LONG[:6]])


def test_forgetting_words_changes_nothing(library, monkeypatch):
    monkeypatch.setattr(P, "MOST_WORDS", 3)
    codec = P.Codec(P.model_path())
    for _ in range(3):
        same(codec, library, ["some words of a text", "other words of it", "some words"])


def test_decoding_any_ids(codec, library):
    pick = random.Random(7)
    for top in (270, codec.v.size - 1):
        for _ in range(200):
            ids = [pick.randint(0, top) for _ in range(pick.randint(0, 20))]
            assert codec.decode(np.array(ids, np.int32), np.array([0, len(ids)])) == [library.decode(ids)], ids
    with pytest.raises(ValueError):
        codec.decode(np.array([codec.v.size], np.int32), np.array([0, 1]))


def digests(library, text):
    ids = library.encode(text or "")
    return len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_query_on_whole_documents(spark, library):
    from lumenfold.llm.queries import op13_sentencepiece

    d = "/root/testdata/sf0.001"
    want = {r.doc_id: digests(library, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in op13_sentencepiece(spark, d).collect()} == want


def test_odd_rows(spark, library):
    rows = [(i, t, "x", 1) for i, t in enumerate(ODD)] + [(None, "no id", "x", 1), (3, "again", "x", 1), (3, "again", "x", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string, ids int")
    got = sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in P.piece_digests(docs).collect())
    assert got == sorted((str(r[0]), *digests(library, r[1])) for r in rows)
    assert P.piece_digests(docs.limit(0)).collect() == []


def test_round_trip_of_ids_and_texts(spark):
    docs = spark.createDataFrame([(1, "One  text, with 2 spaces\n"), (2, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in P.decode(P.encode(docs)).collect()}
    assert got[1].text == "One  text, with 2 spaces\n" and got[2].text == "" and got[2].ids == []
    assert P.decode(spark.createDataFrame([(1, None)], "doc_id long, ids array<int>")).first().text == ""
