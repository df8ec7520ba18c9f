"""Words that ordinary hashes take for each other: two-letter words and their complements, in every operator that hashes words."""

import hashlib
import zlib

import numpy as np
import pytest

from newsloom.llm import bpe, ngram_jaccard, packing, pretoken, queries, records, substring_dedup, suffix_tree
from newsloom.llm.common import text_bytes


def alternating(n):
    """The word of n letters in which each half of a beginning of 2**k letters is the other's complement."""
    word = "a"
    while len(word) < n:
        word += word.translate(str.maketrans("ab", "ba"))
    return word


WORDS = [w for n in (1024, 4096) for w in (alternating(n), alternating(n).translate(str.maketrans("ab", "ba")))]


@pytest.fixture(scope="module")
def pairs(spark):
    """Each document repeats one word 14 times."""
    return spark.createDataFrame([(i, " ".join([w] * 14)) for i, w in enumerate(WORDS, 1)], "doc_id long, text string")


def test_similar_sets_and_windows(pairs):
    assert {r.doc_id: r.component_id for r in ngram_jaccard.join(pairs, 5).collect()} == {1: 1, 2: 2, 3: 3, 4: 4}
    assert {r.doc_id: r.n_removed for r in substring_dedup.deduplicate(pairs, 13).collect()} == {1: 0, 2: 0, 3: 0, 4: 0}


def test_tokens_of_the_tree(spark):
    two = spark.createDataFrame([(i, w) for i, w in enumerate(WORDS[:2], 1)], "doc_id long, text string")
    got = {r.doc_id: r for r in suffix_tree.score(two, held=99).collect()}
    expected = np.log10(2 / 8) + np.log10(3 / 8)  # four tokens of three kinds: each word once, ends twice
    assert got[1].base_score == pytest.approx(expected) and got[2].base_score == pytest.approx(expected)


def test_ids_are_the_library_s(pairs):
    path = queries.tokenizer("byte_bpe_50k.json")
    library = pretoken.library(path)
    ids = {i: library.encode(" ".join([w] * 14), add_special_tokens=False).ids for i, w in enumerate(WORDS, 1)}
    for r in bpe.round_trip(pairs, path).collect():
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids[r.doc_id])).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(" ".join([WORDS[r.doc_id - 1]] * 14).encode()).hexdigest()
    for r in records.write_and_read(pairs, path, end_id=0).collect():
        assert r.ids_crc32 == zlib.crc32(np.array(ids[r.doc_id] + [0], "<u4").tobytes())


def test_packed_ids_are_the_library_s(spark):
    path = queries.tokenizer("word_bpe_49k.json")
    library = pretoken.library(path)
    one = spark.createDataFrame([(i, w) for i, w in enumerate(WORDS, 1)], "doc_id long, text string")
    found = {}
    for r in sorted(packing.pack(packing.pieces(one, path, 2048, end_id=1), one.count(), 2048).collect(), key=lambda r: r.start):
        found.setdefault(r.doc_id, []).append((r.start, r.length, r.ids_crc32))
    for i, w in enumerate(WORDS, 1):
        whole = np.array(library.encode(w, add_special_tokens=False).ids + [1], "<u4")
        assert [zlib.crc32(whole[a : a + n].tobytes()) for a, n, _ in found[i]] == [c for _, _, c in found[i]]


def test_a_word_behind_another_one_s_hash(monkeypatch, rows):
    """With fifty hashes for all words, texts are still encoded as the library does."""
    import pyarrow as pa

    true = pretoken.span_hashes
    monkeypatch.setattr(pretoken, "span_hashes", lambda *a: true(*a) % np.uint64(50))
    path = queries.tokenizer("byte_bpe_50k.json")
    texts = [t for _, t in rows]
    pretoken.library_words.cache_clear()
    ids, bounds = pretoken.library_words(path, "byte").encode(*text_bytes(pa.array(texts, pa.string())))
    pretoken.library_words.cache_clear()
    for i, t in enumerate(texts):
        assert ids[bounds[i] : bounds[i + 1]].tolist() == pretoken.library(path).encode(t or "", add_special_tokens=False).ids


def test_spans(spark):
    data = np.random.default_rng(1).integers(0, 4, 5000).astype(np.uint8)
    starts = np.random.default_rng(2).integers(0, 4800, 20000)
    ends = starts + np.random.default_rng(3).integers(0, 90, 20000)
    hashes = pretoken.span_hashes(data, starts, ends)
    by_word, by_hash = {}, {}
    for a, b, h in zip(starts.tolist(), ends.tolist(), hashes.tolist()):
        w = data[a:b].tobytes()
        assert by_word.setdefault(w, h) == h and by_hash.setdefault(h, w) == w
