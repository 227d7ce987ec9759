from __future__ import annotations

import json
import random
import types
import zlib
from pathlib import Path

import numpy as np
import pyarrow.fs as pafs
import pytest
from tokenizers import Tokenizer

from veilmark.llm.packing import fullest, pack, pack_documents, plan_bins
from veilmark.llm.shared import new_path
from veilmark.llm.token_files import SequenceReader, read_token_files, write_token_files
from veilmark.llm.tokens import Encoder, vocabulary

ODD = ["a\n b", "a \n \nb", "  x", "x  y ", "\n x", "don't 'll", "<|endoftext|> q", "a\n\n b\t\tc", "", " ", "3 4 5.6 ###", "ÀÉ ß½ ²", "a\0b", "Ω é ́", "\xa0x", "　y", "z" * 99, "  \n  ", "a1b2", "µ×÷ª"]


@pytest.mark.parametrize(("name", "drops"), [("byte_bpe_50k.json", False), ("word_bpe_49k.json", True)])
def test_encoder_equals_library(name, drops):
    tok, enc = Tokenizer.from_file(vocabulary(name)), Encoder(vocabulary(name), drops)
    rng = random.Random(1)
    texts = ODD + ["".join(rng.choice("ab É,. \n'1") for _ in range(rng.randint(0, 60))) for _ in range(300)]
    ids, counts = enc.encode(texts)
    at = np.concatenate([[0], np.cumsum(counts)])
    for k, t in enumerate(texts):
        assert ids[at[k] : at[k + 1]].tolist() == tok.encode(t, add_special_tokens=False).ids, repr(t)
    assert len(enc.encode([])[0]) == 0


@pytest.mark.parametrize(("name", "drops"), [("byte_bpe_50k.json", False), ("word_bpe_49k.json", True)])
def test_other_cuts_go_to_the_library(tmp_path, name, drops):
    """Known files are cut here; one with another pre-tokenizer or normalizer gets whole texts."""
    spec = json.loads(Path(vocabulary(name)).read_text())
    assert Encoder(vocabulary(name), drops).known
    changed = spec | {"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": True, "trim_offsets": True, "use_regex": False}}
    lowered = spec | {"normalizer": {"type": "Lowercase"}}
    for k, other in enumerate([changed, lowered]):
        path = tmp_path / f"{k}.json"
        path.write_text(json.dumps(other))
        tok, enc = Tokenizer.from_file(str(path)), Encoder(str(path), drops)
        texts = [t for t in ODD if "<|" not in t] + ["One two  THREE"]
        ids, counts = enc.encode(texts)
        at = np.concatenate([[0], np.cumsum(counts)])
        assert not enc.known
        assert [ids[at[i] : at[i + 1]].tolist() for i in range(len(texts))] == [tok.encode(t, add_special_tokens=False).ids for t in texts]


def thue_morse(n):
    return "".join("ab"[bin(k).count("1") % 2] for k in range(n))


@pytest.mark.parametrize(("name", "drops"), [("byte_bpe_50k.json", False), ("word_bpe_49k.json", True)])
def test_words_that_collide_in_polynomial_hashes(name, drops):
    """The Thue-Morse word and its complement, in one block and one after the other."""
    tok, enc = Tokenizer.from_file(vocabulary(name)), Encoder(vocabulary(name), drops)
    for n in (128, 1024, 2048):
        word = thue_morse(n)
        pair = [word, word.translate(str.maketrans("ab", "ba"))]
        for texts in (pair, pair[:1], pair[1:]):
            want = [i for t in texts for i in tok.encode(t, add_special_tokens=False).ids]
            assert enc.encode(texts)[0].tolist() == want


def test_colliding_pieces_go_to_the_library(monkeypatch):
    """Were all pieces to hash alike, ids would still be the library's."""
    monkeypatch.setattr("veilmark.llm.tokens.slice_hashes", lambda data, starts, ends: np.zeros(len(starts), np.uint64))
    enc, tok = Encoder(vocabulary("byte_bpe_50k.json"), False), Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    texts = ["one two", "one", "", "three " * 90 + "x" * 300, "x" * 300, "y" * 300]
    want = [tok.encode(t, add_special_tokens=False).ids for t in texts]
    ids, counts = enc.encode(texts)
    assert ids.tolist() == [i for w in want for i in w] and counts.tolist() == [len(w) for w in want]


def test_memo_is_bounded(monkeypatch):
    monkeypatch.setattr("veilmark.llm.tokens.MEMO_WORDS", 50)
    enc = Encoder(vocabulary("byte_bpe_50k.json"), False)
    tok = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    for k in range(20):
        text = " ".join(f"word{chr(97 + (k * j) % 26)}{chr(97 + j)}" for j in range(20))
        assert enc.encode([text])[0].tolist() == tok.encode(text, add_special_tokens=False).ids
    assert len(enc.place) < 120


def test_fullest_is_the_best_sum():
    rng = random.Random(2)
    for _ in range(200):
        counts = {rng.randint(1, 12): rng.randint(1, 3) for _ in range(rng.randint(1, 5))}
        free = rng.randint(1, 30)
        sums = {0}
        for x, n in counts.items():
            sums = {s + k * x for s in sums for k in range(n + 1)}
        got = fullest(free, sorted(counts, reverse=True), dict(counts))
        assert sum(got) == max(s for s in sums if s <= free)
        assert all(got.count(x) <= counts[x] for x in got)


def least_bins(histogram, capacity):
    """No packing has fewer bins (Martello and Toth's second bound)."""
    best = 0
    for a in range(capacity // 2 + 1):
        large = sum(n for x, n in histogram.items() if x > capacity - a)
        middle = {x: n for x, n in histogram.items() if capacity - a >= x > capacity / 2}
        small = sum(x * n for x, n in histogram.items() if a <= x <= capacity / 2)
        room = sum((capacity - x) * n for x, n in middle.items())
        best = max(best, large + sum(middle.values()) + max(0, -(-(small - room) // capacity)))
    return best


def best_fit_decreasing(histogram, capacity):
    rooms = []
    for x in sorted((x for x, n in histogram.items() for _ in range(n)), reverse=True):
        fits = [k for k, r in enumerate(rooms) if r >= x]
        k = min(fits, key=lambda k: rooms[k], default=None)
        if k is None:
            rooms.append(capacity - x)
        else:
            rooms[k] -= x
    return len(rooms)


@pytest.mark.parametrize("seed", range(8))
def test_plan_uses_every_piece_once(seed):
    rng = random.Random(seed)
    histogram = {rng.randint(1, 64): rng.randint(1, 40) for _ in range(30)}
    plan = plan_bins(histogram, 64)
    for x, n in histogram.items():
        own = plan[plan.length == x].sort_values("low")
        assert own.low.iloc[0] == 0 and own.high.iloc[-1] == n and (own.low.iloc[1:].values == own.high.iloc[:-1].values).all()
    bins = (plan.first_bin + (plan.high - plan.low) // plan.per_bin).max()
    assert least_bins(histogram, 64) <= bins <= best_fit_decreasing(histogram, 64) + 1
    room = {}
    for r in plan.itertuples():
        for k in range(r.first_bin, r.first_bin + (r.high - r.low) // r.per_bin):
            room.setdefault(k, []).append((r.offset, r.per_bin * r.length))
    assert len(room) == bins
    check_gapless([types.SimpleNamespace(sequence_id=k, offset=o, length=n) for k, places in room.items() for o, n in places], 64)


def check_gapless(rows, capacity):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        end = 0
        for offset, n in sorted(places):
            assert offset == end
            end += n
        assert end <= capacity


def test_pack_documents(spark, docs, empty):
    tok = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    rows = pack_documents(docs).collect()
    check_gapless(rows, 2048)
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    assert {r.doc_id for r in rows} == set(texts)
    for doc_id, t in texts.items():
        ids = tok.encode(t, add_special_tokens=False).ids + [0]
        own = sorted({(r.piece, r.start, r.length, r.ids_crc32) for r in rows if r.doc_id == doc_id})
        assert [p for p, *_ in own] == list(range(len(own)))
        assert all(n == 2048 for _, _, n, _ in own[1:])
        for _, start, n, crc in own:
            assert zlib.crc32(np.array(ids[start : start + n], "<u4").tobytes()) == crc
        assert own[-1][1] + own[-1][2] == len(ids)
    assert pack_documents(empty).count() == 0


def test_pack_with_ties_and_bad_lengths(spark):
    df = spark.createDataFrame([(k % 5, 7) for k in range(40)] + [(9, None), (9, 0), (None, 3)], "doc_id long, length long")
    rows = pack(df, ["doc_id"], capacity=16).collect()
    assert len(rows) == 43 and sum(r.sequence_id is None for r in rows) == 2
    check_gapless([r for r in rows if r.sequence_id is not None], 16)
    with pytest.raises(ValueError):
        pack(df, ["doc_id"], capacity=5)


def test_token_files_round_trip(spark, docs, empty):
    tok = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    folder = new_path(spark, "files")
    index = write_token_files(docs, folder, size=64)
    rows = sorted(read_token_files(index, folder).collect(), key=lambda r: r.start)
    source = sorted(docs.collect(), key=lambda r: r.doc_id)
    at = 0
    for r, d in zip(rows, source, strict=True):
        ids = [*tok.encode(d.text or "", add_special_tokens=False).ids, 1]
        assert (r.doc_id, r.start, r.n_tokens) == (d.doc_id, at, len(ids))
        assert r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        at += len(ids)
    fs, base = pafs.FileSystem.from_uri(folder)
    total = 0
    for f in {r.file for r in index.select("file").collect()}:
        reader = SequenceReader(fs, f"{base}/{f}")
        total += len(reader)
        assert not reader.ids(0, 1).flags.owndata  # a view of the mapped file
    assert total == at
    empty_index = write_token_files(empty, new_path(spark, "files"))
    assert read_token_files(empty_index, folder).count() == 0
