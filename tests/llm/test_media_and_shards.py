import bisect
import hashlib
import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from newsloom.llm import audio, sharding


def test_digests(docs, rows, none):
    got = audio.digests(docs).collect()
    assert len(got) == len(rows)
    by = {}
    for i, t in rows:
        data = (t or "").encode()
        payload = data + b"\0" * (max(64, -(-len(data) // 64) * 64) - len(data))
        by.setdefault((i, len(data)), set()).add((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:])))
    for r in got:
        assert (r.payload_bytes, r.payload_sha256, r.tail_crc32) in by[r.doc_id, r.n_bytes]
        assert r.media_bytes == r.payload_bytes + 44
    features = {}
    for r in got:
        assert features.setdefault(r.payload_sha256, (r.media_sha256, r.feature)) == (r.media_sha256, r.feature)
    assert audio.digests(none).count() == 0 and audio.clips(none).count() == 0
    assert all(len(r.tensor) == audio.PATCH * audio.BANDS and r.end_s > r.start_s for r in audio.clips(docs).collect())


def test_signal():
    t = np.arange(16000) / 16000
    tone = np.where((t > 0.3) & (t < 0.6), np.sin(2 * np.pi * 1000 * t), 0)
    samples = np.clip(tone * 100 + 128, 0, 255).astype(np.uint8).tobytes()
    back, rate = audio.from_wav(audio.to_wav(samples))
    assert (back, rate) == (samples, 16000)
    found = audio.features(samples)
    assert len(found["active_spans"]) == 1 and abs(found["active_spans"][0][0] - 0.3) < 0.05 and abs(found["active_spans"][0][1] - 0.6) < 0.05
    low, high = (audio.resample(np.sin(2 * np.pi * f * t).astype(np.float32)) for f in (1000, 7000))
    assert len(low) == 10000 and abs(np.abs(low[100:-100]).max() - 1) < 0.05 and np.abs(high[100:-100]).max() < 0.05
    assert np.allclose(audio.resample(np.ones(400, np.float32), 3, 2)[50:-50], 1, atol=0.02)
    peak = np.argmax(found["mel"][len(found["mel"]) // 2 - 5])
    centre = 2595 * np.log10(1 + 1000 / 700) / (2595 * np.log10(1 + 5000 / 700)) * (audio.BANDS + 1) - 1
    assert abs(peak - centre) <= 1


def slow_features(samples):
    """The same features by their definitions, sample by sample."""
    x = (np.frombuffer(samples, np.uint8).astype(float) - 128) / 128
    up, down = audio.UP, audio.DOWN
    n = 12 * max(up, down)
    t = np.arange(-n, n + 1)
    h = np.sinc(t / max(up, down)) / max(up, down) * np.hamming(2 * n + 1) * up
    wide = np.zeros(len(x) * up)
    wide[::up] = x
    length = -(-len(x) * up // down)
    shift = (len(np.pad(h, (0, -len(h) % up))) // 2) // up * up  # the filter's middle, in whole input samples
    full = np.convolve(wide, h)
    y = np.array([full[k] if (k := m * down + shift) < len(full) else 0.0 for m in range(length)])
    y = np.pad(y, (0, max(0, audio.WINDOW - length)))
    rate = audio.RATE * up // down
    bank = audio.mel_bank(rate, 256, audio.BANDS)
    mel, energy = [], []
    for at in range(0, len(y) - audio.WINDOW + 1, audio.HOP):
        frame = y[at : at + audio.WINDOW]
        energy.append(np.sqrt((frame**2).mean()))
        power = np.abs(np.fft.rfft(frame * np.hanning(audio.WINDOW), 256)) ** 2
        mel.append([np.log10(1e-6 + sum(power[b] * bank[b, m] for b in range(129))) for m in range(audio.BANDS)])
    return np.array(mel), np.array(energy)


def test_features_by_definition_and_in_blocks():
    rng = np.random.default_rng(6)
    for n in (64, 320, 3200, 40_000):
        samples = rng.integers(0, 256, n, dtype=np.uint8).tobytes()
        mel, energy = slow_features(samples)
        for block in (7, 4096):
            found = audio.features(samples, block=block)
            assert found["mel"].shape == mel.shape and np.allclose(found["mel"], mel, atol=2e-3)
            assert np.allclose(found["energy"], energy, atol=1e-4)
    assert audio.low_pass(audio.UP, audio.DOWN).shape[0] == audio.UP > 1


def test_tensors_are_stored_with_their_spans():
    clips = [audio.features(bytes([128]) * 64), audio.features(np.random.default_rng(1).integers(0, 256, 9000, dtype=np.uint8).tobytes())]
    back = audio.read_tensors(audio.stored_tensors(clips))
    for a, b in zip(clips, back, strict=True):
        assert np.array_equal(a["patches"], b["patches"]) and np.allclose(a["patch_spans"], b["patch_spans"])
        assert np.allclose(np.array(a["active_spans"]).reshape(-1, 2), b["active_spans"])
    assert audio.read_tensors(audio.stored_tensors([])) == []


def test_a_very_long_text_takes_bounded_memory():
    import tracemalloc

    samples = np.random.default_rng(2).integers(0, 256, 8 << 20, dtype=np.uint8).tobytes()
    tracemalloc.start()
    audio.features(samples)
    assert tracemalloc.get_traced_memory()[1] < 8 * len(samples)
    tracemalloc.stop()


def test_hysteresis():
    energy = np.array([0, 3, 9, 3, 0, 3, 3, 0, 10, 0], float)
    assert audio.segments(energy).tolist() == [[1, 4], [8, 9]]
    assert audio.segments(np.zeros(3)).tolist() == []


def test_shards(spark, docs, rows, none):
    got = sharding.shard(docs, 4, ranges=16).collect()
    assert len(got) == len(rows)
    assert sorted((r.size, r.text_crc32) for r in got) == sorted((len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for _, t in rows)
    for s in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    assert sharding.shard(none).count() == 0


def test_shards_are_even_with_a_hot_text(spark):
    rows = [(i, "same text " * 20 if i % 3 == 0 else f"text {i} " * (5 + i % 30)) for i in range(3000)]
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string"), 8).collect()
    sizes = {}
    for r in got:
        sizes[r.shard] = sizes.get(r.shard, 0) + r.size
    assert len(sizes) == 8 and max(sizes.values()) < 1.05 * min(sizes.values())


def test_ranges_are_looked_up_exactly(spark):
    """Several hundred ranges, some of them divided keys, against a search in a list."""
    rng = random.Random(3)
    keys = sorted({rng.randrange(-(1 << 63), 1 << 63) for _ in range(400)} | {-(1 << 63), -1, 0, (1 << 63) - 1})
    ranges = [(k, 1 + 3 * (i % 9 == 0)) for i, k in enumerate(keys)]
    points = [(k + d, rng.randrange(-(1 << 63), 1 << 63)) for k in keys for d in (-1, 0, 1) if -(1 << 63) <= k + d < 1 << 63]
    points += [(rng.randrange(-(1 << 63), 1 << 63), rng.randrange(-(1 << 63), 1 << 63)) for _ in range(2000)]
    firsts = [sum(p for _, p in ranges[:i]) for i in range(len(ranges))]
    df = spark.createDataFrame(points, "_key long, _row long")
    for r in sharding.ranged(df, ranges).collect():
        i = bisect.bisect_right(keys, r._key) - 1
        parts = ranges[i][1]
        part = min(int((r._row / 2**64 + 0.5) * parts), parts - 1)
        assert (r._range, r._whole) == (firsts[i] + part, parts == 1)
    assert {r._range for r in sharding.ranged(df, []).collect()} == {0}


def test_placement_is_the_line_of_all_bytes(spark):
    """Every shard holds a run of keys, as a plain walk over the sorted texts would give it, up to the one text at either border."""
    rng = random.Random(4)
    rows = [(i, f"{rng.random()} " * rng.randint(1, 60)) for i in range(2500)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in sharding.shard(df, 8, ranges=300).collect()}
    key = {r.doc_id: r.k for r in df.select("doc_id", F.xxhash64("text").alias("k")).collect()}
    total, at = sum(r.size for r in got.values()), 0
    for i in sorted(key, key=key.get):
        assert got[i].shard == min(7, int((at + got[i].size / 2) // (total / 8)))
        at += got[i].size
    order = [got[i].shard for i in sorted(key, key=key.get)]
    assert order == sorted(order)
