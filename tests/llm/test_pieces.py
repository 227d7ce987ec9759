from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
import sentencepiece

from veilmark.llm import pieces
from veilmark.llm.pieces import MODEL, PieceEncoder, decode_pieces, distinct_words, encode_pieces, op13_sentencepiece, word_table
from veilmark.llm.tokens import vocabulary

ODD = ["a\n b", "  x", "x  y ", " ", "", "▁", "▁▁x▁ y", "don't <s></s> <0x0A>", "a\0b", "Ωé́ 😀 x", "\xa0x　y", "z" * 3000, "1 23.4\t\r\n", "   ", "x▁ ▁y", "漢字 かな", "ﬁ①Ａ"]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=vocabulary(MODEL))


def drawn(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice("ab É,. \n'1▁é漢") for _ in range(rng.randint(0, 60))) for _ in range(n)]


def check(enc, library, texts):
    ids, counts = enc.encode(texts)
    at = np.concatenate([[0], np.cumsum(counts)])
    for k, t in enumerate(texts):
        assert ids[at[k] : at[k + 1]].tolist() == library.encode(t), repr(t)
    assert enc.decode(ids, counts) == [library.decode(library.encode(t)) for t in texts]


def test_encoder_equals_library(library, monkeypatch):
    enc = PieceEncoder(vocabulary(MODEL))
    assert enc.apart
    check(enc, library, ODD + drawn(500, 1))
    check(enc, library, [])
    monkeypatch.setattr("veilmark.llm.tokens.MEMO_WORDS", 20)
    monkeypatch.setattr("veilmark.llm.pieces.MEMO_WORDS", 20)
    for k in range(10):  # the memo is emptied again and again
        check(enc, library, drawn(30, k))
    enc.apart = False  # any other model: whole texts
    check(enc, library, ODD)


def test_words_that_hash_alike(library, monkeypatch):
    for place in ("veilmark.llm.tokens.slice_hashes", "veilmark.llm.pieces.slice_hashes"):
        monkeypatch.setattr(place, lambda data, starts, ends: np.zeros(len(starts), np.uint64))
    check(PieceEncoder(vocabulary(MODEL)), library, ODD)


def test_decoder_equals_library(library):
    rng = random.Random(2)
    runs = [[rng.choice([rng.randrange(32000), rng.randrange(300), 28705, 0, 1, 2]) for _ in range(rng.randint(0, 6))] for _ in range(3000)]
    got = PieceEncoder(vocabulary(MODEL)).decode(np.array([i for r in runs for i in r]), np.array([len(r) for r in runs]))
    assert got == [library.decode(r) for r in runs]


def test_table_of_words(spark, library):
    texts = ["one two", "one  two", "two one one", "x" * 99 + " one", "x" * 99, None, "", "once"]
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    counted = {bytes(r["word"]): r["n"] for r in distinct_words(df).collect()}
    assert counted == {b" one": 5, b" two": 2, b"  two": 1, b" once": 1}
    words, size, count, pool = word_table(df, vocabulary(MODEL))
    assert len(size) == 2 and sorted([words[: size[0]], words[size[0] :]]) == [b" one", b" two"]
    check(PieceEncoder(vocabulary(MODEL), (words, size, count, pool)), library, [t or "" for t in texts] + ODD)
    assert len(word_table(df, vocabulary(MODEL), most=1)[1]) == 1  # the more frequent one
    assert len(word_table(df.limit(0), vocabulary(MODEL))[1]) == 0


@pytest.mark.parametrize("most", [500_000, 10, 0])
def test_documents(spark, docs, library, most):
    """Nulls, empty and long texts, repeated rows, clashing columns, any size of the table."""
    df = docs.withColumnRenamed("length", "ids").withColumnRenamed("source", "decoded")
    done = decode_pieces(encode_pieces(df, most=most))
    assert done.columns == ["doc_id", "text", "lang", "n_chars", "ids", "decoded"]
    rows = done.collect()
    both = encode_pieces(df, most=most, decoded="decoded")
    assert sorted(map(str, both.select(*done.columns).collect())) == sorted(map(str, rows))
    assert len(rows) == docs.count()
    for r in rows:
        want = [*library.encode(r["text"] or ""), 2]
        assert r["ids"] == want and r["decoded"] == library.decode(want)


def test_odd_lists_of_ids(spark):
    rows = [(1, None), (2, []), (3, [None]), (4, [28705, 40000]), (5, [-1]), (6, [1, 2]), (7, [259, 264])]
    found = {r["k"]: r["decoded"] for r in decode_pieces(spark.createDataFrame(rows, "k int, ids array<int>")).collect()}
    assert found == {1: None, 2: "", 3: None, 4: None, 5: None, 6: "", 7: "  a"}
    assert encode_pieces(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_query(spark, library):
    sf = "/root/testdata/sf0.001"
    found = {r["doc_id"]: r for r in op13_sentencepiece(spark, sf).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for d in spark.read.parquet(f"{sf}/documents.parquet").collect():
        ids, r = [*library.encode(d["text"] or ""), 2], found[d["doc_id"]]
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids)))


def test_other_models_are_told_apart(library, monkeypatch):
    assert pieces.words_stand_alone(library)

    class Other:
        def __getattr__(self, name):
            return getattr(library, name)

        def id_to_piece(self, i):
            return "a▁b" if i == 300 else library.id_to_piece(i)

    assert not pieces.words_stand_alone(Other())
