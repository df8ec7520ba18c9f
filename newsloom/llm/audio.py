"""Media columns: 8-bit audio stored as WAV, and its features.

Features of a clip: the samples are resampled by a polyphase filter, cut into overlapping windows whose spectra
are summed into log-mel bands, and segmented by energy with two thresholds (hysteresis). Band frames are stored as
fixed-shape tensors of ``PATCH`` frames each, with the time span that each covers, in Arrow's stream format. All is done
in blocks of frames, so a long clip takes little more memory than its samples.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from newsloom.llm.common import in_slices

RATE, UP, DOWN = 16_000, 5, 8
WINDOW, HOP, BANDS, PATCH = 200, 80, 24, 16
#: Segments begin above the upper share of the clip's loudest frame and last until below the lower one.
UPPER, LOWER = 0.5, 0.25


def to_wav(samples: bytes, rate: int = RATE) -> bytes:
    """One channel of unsigned 8-bit PCM in a RIFF/WAVE container; lossless."""
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(rate)
        w.writeframes(samples)
    return out.getvalue()


def from_wav(stored: bytes) -> tuple[bytes, int]:
    """The samples and the rate of a stored clip."""
    with wave.open(io.BytesIO(stored), "rb") as r:
        if (r.getnchannels(), r.getsampwidth()) != (1, 1):
            raise ValueError("not one channel of 8-bit samples")
        return r.readframes(r.getnframes()), r.getframerate()


@lru_cache
def low_pass(up: int, down: int, taps_per_phase: int = 12) -> np.ndarray:
    """A windowed-sinc filter for resampling by up/down, one row for each phase."""
    n = taps_per_phase * max(up, down)
    t = np.arange(-n, n + 1)
    h = np.sinc(t / max(up, down)) / max(up, down) * np.hamming(2 * n + 1) * up
    h = np.pad(h, (0, -len(h) % up))
    return h.reshape(-1, up).T.astype(np.float32)


def resampled(length: int, up: int = UP, down: int = DOWN) -> int:
    """How many samples resampling gives."""
    return -(-length * up // down)


def resample(x: np.ndarray, up: int = UP, down: int = DOWN, first: int = 0, last: int | None = None) -> np.ndarray:
    """Samples ``first`` to ``last`` of x resampled by up/down: each takes only the taps of its own phase.

    Samples beyond either end of x are zero. x may be unsigned 8-bit, then 128 is zero and the range -1 to 1.
    """
    last = resampled(len(x), up, down) if last is None else last
    phases = low_pass(up, down)
    taps, delay = phases.shape[1], (phases.size // 2) // up
    low, high = first * down // up + delay - taps + 1, max(0, last - 1) * down // up + delay + 1
    part = x[max(0, low) : max(0, high)]
    part = (part.astype(np.float32) - 128) / 128 if x.dtype == np.uint8 else part.astype(np.float32)
    left = max(0, -low)
    part = np.pad(part, (left, max(0, high - low - left - len(part))))
    windows = np.lib.stride_tricks.sliding_window_view(part, taps)
    out = np.empty(max(0, last - first), np.float32)
    for at in range(first, min(last, first + up)):
        place = at * down  # every up-th sample from here has the same phase
        rows = windows[place // up + delay - taps + 1 - low :: down]
        own = out[at - first :: up]
        own[:] = rows[: len(own)] @ phases[place % up][::-1]
    return out


@lru_cache
def mel_bank(rate: int, size: int, bands: int) -> np.ndarray:
    """Triangular bands, evenly spaced on the mel scale; spectrum bins by bands."""
    mel = np.linspace(0, 2595 * np.log10(1 + rate / 2 / 700), bands + 2)
    hz = 700 * (10 ** (mel / 2595) - 1)
    bins = np.fft.rfftfreq(size, 1 / rate)
    up = (bins[:, None] - hz[:-2]) / (hz[1:-1] - hz[:-2])
    down = (hz[2:] - bins[:, None]) / (hz[2:] - hz[1:-1])
    return np.maximum(0, np.minimum(up, down)).astype(np.float32)


def log_mel(frames: np.ndarray, rate: int, bands: int = BANDS) -> np.ndarray:
    """Log energies of mel bands of each frame."""
    window = frames.shape[1]
    size = 1 << (window - 1).bit_length()
    spectrum = np.fft.rfft(frames * np.hanning(window).astype(np.float32), size)
    return np.log10(1e-6 + np.abs(spectrum).astype(np.float32) ** 2 @ mel_bank(rate, size, bands))


def segments(energy: np.ndarray, upper: float = UPPER, lower: float = LOWER) -> np.ndarray:
    """First and last-plus-one frames of each active span: runs over ``lower`` in which some frame is over ``upper``, as shares of the loudest."""
    top = float(energy.max()) if len(energy) else 0.0
    if top <= 0:
        return np.zeros((0, 2), np.int64)
    edges = np.flatnonzero(np.diff(np.concatenate(([0], energy >= lower * top, [0])).astype(np.int8)))
    runs = edges.reshape(-1, 2)
    loud = np.concatenate(([0], np.cumsum(energy >= upper * top)))
    return runs[loud[runs[:, 1]] > loud[runs[:, 0]]]


def features(samples: bytes, rate: int = RATE, block: int = 4096) -> dict:
    """Log-mel frames, their time spans in patches, and active spans in seconds, of 8-bit samples; in blocks of frames."""
    x = np.frombuffer(samples, np.uint8)
    new_rate, n = rate * UP // DOWN, resampled(len(x))
    count = max(1, 1 + (n - WINDOW) // HOP)
    mel, energy = np.empty((count, BANDS), np.float32), np.empty(count)
    for at in range(0, count, block):
        end = min(count, at + block)
        stop = (end - 1) * HOP + WINDOW
        y = resample(x, first=at * HOP, last=min(n, stop))
        y = np.pad(y, (0, max(0, stop - at * HOP - len(y))))
        frames = np.lib.stride_tricks.sliding_window_view(y, WINDOW)[::HOP]
        mel[at:end] = log_mel(frames, new_rate)
        energy[at:end] = np.sqrt((frames.astype(np.float64) ** 2).mean(axis=1))
    step = HOP / new_rate
    spans = [(float(a * step), float((b - 1) * step + WINDOW / new_rate)) for a, b in segments(energy)]
    patches = np.pad(mel, ((0, -len(mel) % PATCH), (0, 0)), constant_values=-6).reshape(-1, PATCH, BANDS)
    times = [(float(i * PATCH * step), float(min((i + 1) * PATCH, len(mel)) * step - step + WINDOW / new_rate)) for i in range(len(patches))]
    return {"mel": mel, "patches": patches, "patch_spans": times, "active_spans": spans, "energy": energy}


def tensor_column(patches: np.ndarray) -> pa.FixedShapeTensorArray:
    """Patches as an Arrow column of fixed-shape tensors."""
    return pa.FixedShapeTensorArray.from_numpy_ndarray(np.ascontiguousarray(patches, dtype=np.float32))


def stored_tensors(clips: list[dict]) -> bytes:
    """The features of clips in Arrow's stream format: clip, start_s, end_s, active (a span of sound) or a tensor of PATCH frames by BANDS."""
    out = io.BytesIO()
    if not clips:
        return b""
    patches = np.concatenate([c["patches"] for c in clips])
    spans = [(i, *span) for i, c in enumerate(clips) for span in c["patch_spans"]]
    active = [(i, *span) for i, c in enumerate(clips) for span in c["active_spans"]]
    kinds = (pa.int32(), pa.float64(), pa.float64())
    table = pa.table([*(pa.array([s[k] for s in spans], kind) for k, kind in enumerate(kinds)), tensor_column(patches)], ["clip", "start_s", "end_s", "tensor"])
    sounds = pa.table([pa.array([s[k] for s in active], kind) for k, kind in enumerate(kinds)], ["clip", "start_s", "end_s"])
    for one in (table, sounds):
        with pa.ipc.new_stream(out, one.schema) as writer:
            writer.write_table(one)
    return out.getvalue()


def read_tensors(data: bytes) -> list[dict]:
    """The clips of stored_tensors(): patches, patch_spans, active_spans; clips are numbered as they were."""
    source = io.BytesIO(data)
    if not data:
        return []
    table, sounds = (pa.ipc.open_stream(source).read_all() for _ in range(2))
    patches = table.column("tensor").combine_chunks().to_numpy_ndarray()
    spans = [np.column_stack([t.column(c).to_numpy() for c in ("clip", "start_s", "end_s")]) for t in (table, sounds)]
    out = []
    for i in range(int(spans[0][-1, 0]) + 1):
        low, high = np.searchsorted(spans[0][:, 0], (i, i + 1))
        a, z = np.searchsorted(spans[1][:, 0], (i, i + 1))
        out.append({"patches": patches[low:high], "patch_spans": spans[0][low:high, 1:], "active_spans": spans[1][a:z, 1:]})
    return out


def summary(found: dict) -> str:
    """A short text of features as read back: patches, active spans and their seconds, checksums of the tensors (in steps of 1/16) and of all times (in milliseconds)."""
    tensor = np.rint(found["patches"] * 16).astype("<i2")
    times = np.rint(np.concatenate((found["patch_spans"], found["active_spans"])) * 1000).astype("<i8")
    seconds = float((found["active_spans"][:, 1] - found["active_spans"][:, 0]).sum())
    return f"patches={len(tensor)};active={len(found['active_spans'])};seconds={seconds:.3f};mel={zlib.crc32(tensor.tobytes()):08x};times={zlib.crc32(times.tobytes()):08x}"


def stored(payload: bytes) -> tuple[tuple, dict]:
    """Sizes and checksums of one payload as stored and read back, and the features of what was read."""
    media = to_wav(payload)
    back, rate = from_wav(media)
    return (len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(media), hashlib.sha256(media).hexdigest()), features(back, rate)


def text_payload(data: bytes) -> bytes:
    """data and as many zero bytes as make a positive multiple of 64."""
    return data + b"\0" * (max(64, -(-len(data) // 64) * 64) - len(data))


def clips(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The patches of every whole text's clip as rows: doc_id, patch, start_s, end_s, tensor (PATCH * BANDS values).

    Null texts are empty clips of 64 zero samples. Rows are independent of each other, so repeated rows give repeated
    clips; an empty table gives no rows.
    """

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches, 1 << 20, text):
            for key, value in zip(batch.column(0), batch.column(1), strict=True):
                found = features(*from_wav(to_wav(text_payload((value.as_py() or "").encode()))))
                spans, patches = np.array(found["patch_spans"]), found["patches"]
                for at in range(0, len(patches), 1024):
                    part, times = patches[at : at + 1024], spans[at : at + 1024]
                    columns = [pa.array([key.as_py()] * len(part), pa.int64()), pa.array(range(at, at + len(part)), pa.int32()), pa.array(times[:, 0]), pa.array(times[:, 1]), tensor_column(part).storage.cast(pa.list_(pa.float32()))]
                    yield pa.RecordBatch.from_arrays(columns, ["doc_id", "patch", "start_s", "end_s", "tensor"])

    return docs.select(doc_id, text).mapInArrow(made, "doc_id long, patch int, start_s double, end_s double, tensor array<float>")


def digests(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of docs: sizes and checksums of its clip as stored and read back, and its features as text.

    The features of a slice of rows are stored as tensors and time spans and read back before they are summed up. A null text
    is empty. Equal texts give equal values; ids may be null or repeated; other columns are left out. An empty table gives no rows.
    """

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches, 1 << 20, text):
            rows, found = [], []
            for value in batch.column(1):
                data = (value.as_py() or "").encode()
                sizes, feature = stored(text_payload(data))
                rows.append((len(data), *sizes))
                found.append(feature)
            texts = [summary(f) for f in read_tensors(stored_tensors(found))]
            columns = [*zip(*rows, strict=True), texts]
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), *(pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True))],
                ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"],
            )

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return docs.select(doc_id, text).mapInArrow(made, schema)
