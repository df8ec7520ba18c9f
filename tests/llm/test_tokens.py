import hashlib
import json
import random
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest

from newsloom.llm import bpe, packing, records
from newsloom.llm.common import text_bytes
from newsloom.llm.pretoken import library, library_words

P = pytest.importorskip("public_tokenizers")
BYTE, WORD = P.path("byte_bpe_50k.json"), P.path("word_bpe_49k.json")


def ids(path, text):
    return library(path).encode(text or "", add_special_tokens=False).ids


def order(r):
    return tuple((x is None, x if x is not None else 0) for x in r)


def test_words_like_the_library():
    rng = random.Random(3)
    alpha = ["'s", "'re", "'ll", "'", "''", " ", "  ", "\n", "\n\n", " \n", "\t", "a", "B", "the", "don't", "é", "ç", "1", "23", "!!", "...", "ü", "ß", "İ", "Σ", "é", " ", "’", "中", "😀", "<|endoftext|>", "<|ENDOFTEXT|>", "<|startoftext|>", "$%", "I'VE", "we've'd", "\x1c", "\x85", "_", "x'sy"]
    texts = ["".join(rng.choice(alpha) for _ in range(rng.randint(0, 14))) for _ in range(1500)]
    texts += ["x" + chr(c) + "y " + chr(c) + "1" + chr(c) * 2 + " '" + chr(c) for c in range(1, 0x600)]
    for path, encoders in ((BYTE, (library_words(BYTE, "byte"), bpe.words_of(BYTE))), (WORD, (library_words(WORD, "word"),))):
        for words in encoders:
            got, bounds = words.encode(*text_bytes(pa.array(texts)))
            assert [got[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:])] == [ids(path, t) for t in texts]


def test_failing_words_are_merged():
    v = bpe.vocabulary(BYTE)
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdehilnorstu é") for _ in range(rng.randint(1, 24))) for _ in range(400)]
    proposals = [v.longest_match(w.encode()) for w in words]
    exact = [v.exact_merge(w.encode()) for w in words]
    assert proposals != exact and v.encode_words(words) == exact


def test_very_long_words():
    rng = random.Random(1)
    words = ["".join(rng.choice("abcdefghij") for _ in range(20_000)), "a" * 30_000, "ab" * 10_000, "é" * 5_000]
    v = bpe.vocabulary(BYTE)
    for w in words:
        assert v.exact_merge(w.encode()) == ids(BYTE, w)
    began = time.time()
    assert [v.encode_words([w])[0] for w in words] == [ids(BYTE, w) for w in words]
    v.exact_merge(words[0].encode() * 10)
    assert time.time() - began < 60


def test_a_byte_without_entry(tmp_path):
    tiny = {"model": {"vocab": {"a": 0, "b": 1, "ab": 2}, "merges": ["a b"]}, "added_tokens": []}
    (tmp_path / "tiny.json").write_text(json.dumps(tiny))
    v = bpe.Vocabulary(str(tmp_path / "tiny.json"))
    assert v.longest_match(b"aba") == [2, 0]
    with pytest.raises(ValueError):
        v.longest_match(b"ac")


def test_round_trip(docs, rows, none):
    got = sorted(((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.round_trip(docs, BYTE).collect()), key=order)
    want = []
    for i, t in rows:
        one = ids(BYTE, t)
        want.append((i, len(one), hashlib.sha256(",".join(map(str, one)).encode()).hexdigest(), hashlib.sha256(library(BYTE).decode(one, skip_special_tokens=False).encode()).hexdigest()))
    assert got == sorted(want, key=order)
    assert bpe.round_trip(none, BYTE).count() == 0
    texts = {r.text for r in bpe.decode(bpe.encode(docs, BYTE), BYTE).collect()}
    assert {t or "" for _, t in rows} == texts


def test_records(docs, rows, none):
    got = sorted(records.write_and_read(docs, BYTE).collect(), key=lambda r: r.start)
    assert [order((r.doc_id,)) for r in got] == sorted([order((i,)) for i, _ in rows], key=lambda k: (not k[0][0], k[0][1]))
    start = 0
    for r in got:
        assert r.start == start
        start += r.n_tokens
    want = sorted(((i, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, t in rows for x in (ids(BYTE, t) + [0],)), key=order)
    assert sorted(((r.doc_id, r.n_tokens, r.ids_crc32) for r in got), key=order) == want
    assert records.write_and_read(none, BYTE).count() == 0


def test_frames_tell_damage():
    data = records.frame(records.to_payload(5, np.array([1, 70_000], np.uint32)))
    payload, end = records.unframe(data)
    key, back = records.from_payload(payload)
    assert (key, back.tolist(), end) == (5, [1, 70_000], len(data))
    for at in range(len(data)):
        with pytest.raises(ValueError):
            records.unframe(data[:at] + bytes([data[at] ^ 1]) + data[at + 1 :])
    with pytest.raises(ValueError):
        records.unframe(data[:-1])


def test_packing(docs, rows, none):
    cut = packing.pieces(docs, WORD, 64, with_ids=True)
    found = packing.pack(cut, len(rows), 64, group=40)
    got = found.collect()
    sequences = {}
    for r in got:
        assert len(r.ids) == 4 * r.length and zlib.crc32(r.ids) == r.ids_crc32 and r.length <= 64
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in sequences.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 64
    want = sorted(((i, at, len(p), zlib.crc32(np.array(p, "<u4").tobytes()), len(x)) for i, t in rows for x in (ids(WORD, t) + [1],) for at in range(0, len(x), 64) for p in (x[at : at + 64],)), key=order)
    assert sorted(((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got), key=order) == want
    assert sum(r.length for r in got) / 64 / len(sequences) > 0.9
    padded = [len(r.ids) // 4 for r in packing.sequences(found, 64).collect()]
    assert len(padded) == len(sequences) and all(n == 64 or n & (n - 1) == 0 for n in padded)
    assert packing.pack(packing.pieces(none, WORD, 64), 0, 64).count() == 0


def test_groups_are_of_documents_and_bounded(spark):
    rows = [(7, "one same text of some words")] * 900 + [(i, "a b c " * (i % 50)) for i in range(100)]
    cut = packing.pieces(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), WORD, 16)
    got = packing.pack(cut, 1000, 16, group=50).collect()
    groups, of = {}, {}
    for r in got:
        groups.setdefault(r.sequence_id >> 32, []).append(r)
        if r.doc_id != 7:
            of.setdefault(r.doc_id, set()).add(r.sequence_id >> 32)
    assert max(len({(r.doc_id, r.start, r.sequence_id, r.offset) for r in g if r.start == 0}) for g in groups.values()) < 110
    assert all(len(g) == 1 for g in of.values())


def test_first_fit_decreasing():
    rng = np.random.default_rng(2)
    lengths = rng.integers(1, 65, 300)
    bins, offsets = packing.first_fit_decreasing(lengths, 64)
    free, want = [], {}
    for i in sorted(range(300), key=lambda i: (-lengths[i], i)):
        at = next((b for b, f in enumerate(free) if f >= lengths[i]), None)
        if at is None:
            free.append(64)
            at = len(free) - 1
        want[i] = (at, 64 - free[at])
        free[at] -= lengths[i]
    assert [(int(b), int(o)) for b, o in zip(bins, offsets)] == [want[i] for i in range(300)]
