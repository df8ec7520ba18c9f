"""Quality classifier from compressed sizes.

Two zstandard dictionaries are built, one from texts labelled good and one from texts labelled bad. A text is
compressed with each in blocks; the difference of the two sizes over the text's size says which kind of text it
resembles, and a logistic curve fitted on other labelled texts turns that difference into a probability.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.common import fold


@dataclass(frozen=True)
class QualityModel:
    """A fitted classifier: raw dictionaries and the calibration curve. Small, of a fixed size, and picklable.

    ``good`` and ``bad`` are at most ``dictionary_bytes`` each, so the model can be shipped to any task.
    """

    good: bytes
    bad: bytes
    slope: float
    offset: float
    block: int
    level: int

    def scorer(self):
        """A function from bytes to a score in 0..1; builds the compressors once."""
        difference = differences(self.good, self.bad, self.block, self.level)
        slope, offset = self.slope, self.offset

        def score(data: bytes) -> float:
            return float(1 / (1 + np.exp(-np.clip(slope * difference(data) + offset, -40, 40))))

        return score


def differences(good: bytes, bad: bytes, block: int, level: int):
    """The normalised size difference of a text: (bytes with the bad dictionary - bytes with the good one) / bytes."""
    with_good, with_bad = (zstandard.ZstdCompressor(level=level, dict_data=dictionary(d, level), write_content_size=False, write_dict_id=False) for d in (good, bad))

    def difference(data: bytes) -> float:
        more = 0
        for at in range(0, len(data), block):
            piece = data[at : at + block]
            more += len(with_bad.compress(piece)) - len(with_good.compress(piece))
        return more / (len(data) + 64)

    return difference


def dictionary(raw: bytes, level: int) -> zstandard.ZstdCompressionDict:
    """A dictionary ready for use; raw may be trained or plain content, or empty."""
    made = zstandard.ZstdCompressionDict(raw or b"\n" * 8)
    made.precompute_compress(level=level)
    return made


def train_dictionary(texts: list[bytes], size: int, block: int) -> bytes:
    """A trained dictionary of at most size bytes; plain content where there is too little text to train one."""
    blocks = [t[at : at + block] for t in texts for at in range(0, len(t), block)]
    total = sum(map(len, blocks))
    size = max(256, min(size, total // 8))
    try:
        return zstandard.train_dictionary(size, blocks).as_bytes()
    except zstandard.ZstdError:
        return b"".join(blocks)[-size:]


def calibrate(x: np.ndarray, good: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Slope and offset of a logistic curve through (x, good), by Newton steps with a slight pull towards zero."""
    scale = float(np.std(x)) or 1.0
    a = np.column_stack([x / scale, np.ones(len(x))])
    w = np.zeros(2)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -40, 40)))
        gradient = a.T @ (good - p) - np.array([1e-3, 1e-3]) * w
        hessian = (a * (p * (1 - p))[:, None]).T @ a + np.diag([1e-3, 1e-3])
        step = np.linalg.solve(hessian, gradient)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0] / scale), float(w[1])


def fit(documents: DataFrame, labels: DataFrame, per_class: int = 600, dictionary_bytes: int = 64 << 10, block: int = 1024, level: int = 3, folds: int = 5, text_bytes: int = 1 << 20) -> QualityModel:
    """Learn from labelled documents whose fold is not 0.

    per_class and text_bytes bound the sample: that many labelled ids of either class, the first by a hash of the id, so
    the same rows at any parallelism, and of each at most so many characters. An id labelled both ways teaches nothing; of
    several texts with one id the least in order counts. Half of the sample builds the dictionaries, the other half calibrates.
    Without any usable label (empty tables, null labels) the model scores every text 0.5.
    """
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & (fold("doc_id", folds) != 0)).groupBy("doc_id")
    usable = known.agg(F.min("quality").alias("_good"), F.max("quality").alias("_other")).where("_good = _other").select("doc_id", "_good")
    picked = [usable.where(F.col("_good") == kind).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for kind in (0, 1)]
    # at most 2 * per_class ids of 12 bytes: the parameter bounds what is broadcast
    sample = F.broadcast(picked[0].unionByName(picked[1]))
    texts_of = documents.select("doc_id", "text").join(sample, "doc_id").where(F.length("text") > 0).groupBy("doc_id", "_good").agg(F.min("text").alias("text"))
    rows = texts_of.select("doc_id", "_good", F.left("text", F.lit(text_bytes)).alias("text")).collect()
    texts: dict[int, list[bytes]] = {0: [], 1: []}
    for row in sorted(rows, key=lambda r: (r.doc_id * 2654435761 % 2**32, r.doc_id, r.text)):
        texts[row._good].append(row.text.encode())
    good, bad = (train_dictionary(texts[kind][::2], dictionary_bytes, block) if texts[kind] else b"" for kind in (1, 0))
    other = [(t, kind) for kind in (0, 1) for t in (texts[kind][1::2] or texts[kind])]
    slope, offset = 0.0, 0.0
    if other:
        difference = differences(good, bad, block, level)
        slope, offset = calibrate(np.array([difference(t) for t, _ in other]), np.array([float(k) for _, k in other]))
    if not texts[0] or not texts[1]:
        slope, offset = 0.0, 0.0
    else:  # the sample holds as many of either class; the curve must know how common each is among all labels
        share = usable.agg(F.count(F.when(F.col("_good") == 1, 1)).alias("good"), F.count("*").alias("all")).first()
        drawn = sum(kind for _, kind in other) / len(other)
        real = (share["good"] + 1) / (share["all"] + 2)
        offset += float(np.log(real / (1 - real)) - np.log(drawn / (1 - drawn)))
    return QualityModel(good, bad, slope, offset, block, level)


def score(documents: DataFrame, model: QualityModel, text: str = "text", to: str = "score") -> DataFrame:
    """documents with a score for every whole text. A null text is taken as empty; all columns stay as they are.

    Equal texts get equal scores. ``to`` replaces a column of that name.
    """

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        one = model.scorer()
        for texts in batches:
            yield pd.Series([one(t.encode()) if t else one(b"") for t in texts], dtype="float64")

    return documents.withColumn(to, scored(F.col(text)))

