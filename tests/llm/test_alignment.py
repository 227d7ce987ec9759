from __future__ import annotations

import hashlib
from collections import Counter

import pytest
import sentencepiece
from tokenizers import Tokenizer

from veilmark.llm import alignment
from veilmark.llm.alignment import align_documents, op11_tokenizer_alignment
from veilmark.llm.tokens import _BYTE_CHARS, vocabulary


def plain(texts):
    """(n_a, n_b, n_groups, n_links, n_best, count_sum, groups) of each text, by loops over bytes."""
    tok = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    tok.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=vocabulary("piece_bpe_32k.model"))
    byte = {shown: b for b, shown in _BYTE_CHARS.items()}

    def spell(piece):
        return bytes([int(piece[3:5], 16)]) if len(piece) == 6 and piece.startswith("<0x") else piece.replace("▁", " ").encode()

    docs, total = [], Counter()
    for t in texts:
        if not t:
            docs.append(None)
            continue
        a, b = tok.encode(" " + t, add_special_tokens=False).ids, sp.encode(t)
        of_a = [bytes(byte[c] for c in tok.id_to_token(i)) for i in a]
        of_b = [spell(sp.id_to_piece(i)) for i in b]
        if not b"".join(of_a) == b"".join(of_b) == (" " + t).encode():
            docs.append(None)
            continue
        at_a = [k for k, x in enumerate(of_a) for _ in x]
        at_b = [k for k, x in enumerate(of_b) for _ in x]
        links = sorted(set(zip(at_a, at_b, strict=True)))
        groups, own_a, own_b = [], [], []
        for p in range(len(at_a)):
            if not p or at_a[p] != at_a[p - 1]:
                own_a.append(a[at_a[p]])
            if not p or at_b[p] != at_b[p - 1]:
                own_b.append(b[at_b[p]])
            if p + 1 == len(at_a) or (at_a[p] != at_a[p + 1] and at_b[p] != at_b[p + 1]):
                groups.append(",".join(map(str, own_a)) + "|" + ",".join(map(str, own_b)))
                own_a, own_b = [], []
        pairs = [(a[i], b[j]) for i, j in links]
        total.update(pairs)
        docs.append((len(a), len(b), len(groups), pairs, ";".join(groups)))
    best = {}
    for (_, j), n in total.items():
        best[j] = max(best.get(j, 0), n)
    out = []
    for d in docs:
        pairs = d[3] if d else []
        n_best = sum(total[p] == best[p[1]] for p in pairs)
        out.append((*(d[:3] if d else (0, 0, 0)), len(pairs), n_best, sum(total[p] for p in pairs), d[4] if d else ""))
    return out


ODD = ["a", "▁", "x▁y", "<|endoftext|> <s>", "漢字 かな\n\nx", "é́ 😀😀 don't", "  two  blanks ", "tab\there", "aaaa" * 40_000, "12 345 6.7"]


@pytest.mark.parametrize(("slot_rows", "held"), [(20_000, 1 << 21), (3, 50)])
def test_equals_plain_alignment(spark, docs, monkeypatch, slot_rows, held):
    """Nulls, empty and long texts, repeated rows and ids, other columns; hot ids dealt over slots."""
    monkeypatch.setattr(alignment, "HELD", held)
    more = spark.createDataFrame([(None if k % 2 else 9000, t) for k, t in enumerate(ODD)], "doc_id long, text string")
    df = docs.select("doc_id", "text").union(more).repartition(5)
    df = df.withColumn("row", df["doc_id"]).withColumn("n_best", df["text"]).cache()
    rows = df.collect()
    want = sorted(str((r["doc_id"], *w)) for r, w in zip(rows, plain([r["text"] for r in rows]), strict=True))
    assert sorted(str(tuple(r)) for r in align_documents(df, slot_rows=slot_rows).collect()) == want
    assert align_documents(df.limit(0)).collect() == []


def test_many_links_of_a_pair(spark, monkeypatch):
    """Multiplicities beyond 16 bits."""
    text = " ".join(["the"] * 70_000)
    df = spark.createDataFrame([(1, text), (2, "the the")], "doc_id long, text string")
    rows = {r["doc_id"]: tuple(r)[1:] for r in align_documents(df).collect()}
    assert [rows[1], rows[2]] == plain([text, "the the"])


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/documents.parquet").collect()
    found = {r["doc_id"]: tuple(r)[1:] for r in op11_tokenizer_alignment(spark, sf).collect()}
    for r, w in zip(rows, plain([r["text"] for r in rows]), strict=True):
        assert found[r["doc_id"]] == (*w[:6], hashlib.sha256(w[6].encode()).hexdigest() if w[6] else "")
