"""Quality scores by compression: texts like the good ones shrink more under a dictionary of good text than of bad text.

Every text is cut into chunks, each compressed alone with either dictionary, so a long text counts in all its parts. The
difference of the two sizes per byte of text, drawn towards the mean of all texts where a text is short, is the single
input of a logistic calibration.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leadfit.llm.common import sampled_labels, sampled_texts

CHUNK = 1024
DICTIONARY_BYTES = 65_536
LEVEL = 3
PER_CLASS = 3000  # bound of the labelled rows that are learnt from, by class
CHUNKS_OF_A_TEXT = 4  # bound of the chunks of one labelled text that are learnt from, evenly spread over it
SHRINKAGE = 50  # bytes of average text that every text is mixed with


def chunks_of(text: str | None) -> list[bytes]:
    data = (text or "").encode()
    return [data[i:i + CHUNK] for i in range(0, len(data), CHUNK)]


def dictionary(samples: list[bytes]) -> bytes:
    """Dictionary trained on samples; where there are too few of them, the samples themselves."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-DICTIONARY_BYTES:].ljust(8, b"\0")


def compressor(content: bytes) -> zstandard.ZstdCompressor:
    data = zstandard.ZstdCompressionDict(content)
    data.precompute_compress(level=LEVEL)
    frame = zstandard.ZstdCompressionParameters.from_level(
        LEVEL, format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=0, write_dict_id=0)
    return zstandard.ZstdCompressor(dict_data=data, compression_params=frame)


@dataclass(frozen=True)
class CompressionModel:
    """Two dictionaries and a calibration; `constant` alone where a class has no labelled text."""

    good: bytes = b""
    bad: bytes = b""
    mean: float = 0.0
    slope: float = 0.0
    offset: float = 0.0
    constant: float | None = None

    def scorer(self):
        """Function from chunks to a score from 0 to 1."""
        if self.constant is not None:
            return lambda chunks: self.constant
        good, bad = compressor(self.good), compressor(self.bad)

        def score(chunks: list[bytes]) -> float:
            x = difference(good, bad, chunks, self.mean)
            return float(1 / (1 + np.exp(-np.clip(self.slope * x + self.offset, -30, 30))))

        return score


def difference(good, bad, chunks: list[bytes], mean: float) -> float:
    """Bytes that the dictionary of good text saves per byte of text, over that of bad text."""
    saved = sum(len(bad.compress(c)) - len(good.compress(c)) for c in chunks)
    return (saved + mean * SHRINKAGE) / (sum(map(len, chunks)) + SHRINKAGE)


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3) -> tuple[float, float]:
    """Slope and offset of a weighted logistic curve, by Newton steps on the standardised input."""
    centre, scale = np.average(x, weights=weight), x.std() or 1.0
    a = np.stack([(x - centre) / scale, np.ones_like(x)], axis=1)
    w = np.zeros(2)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        g = a.T @ (weight * (p - y)) + ridge * w
        h = (a * (weight * p * (1 - p))[:, None]).T @ a + ridge * np.eye(2)
        step = np.linalg.solve(h, g)
        w -= np.clip(step, -2, 2)
    return w[0] / scale, w[1] - w[0] * centre / scale


def fit_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", parts: int = 4, held_out: int = 2, per_class: int = PER_CLASS, most_chunks: int = CHUNKS_OF_A_TEXT) -> CompressionModel:
    """Dictionaries from two thirds of a bounded sample of labelled texts, calibration from the rest.

    At most per_class rows of each class and most_chunks chunks of a text, evenly spread over it, come to the driver,
    whatever the corpus. The classes weigh in the calibration what they weigh among all labelled rows. Of several texts
    of one id that of the smallest hash is learnt from.
    """
    sample, sizes = sampled_labels(labels, label, per_class, parts, held_out)
    if not sizes.get(0) or not sizes.get(1):
        return CompressionModel(constant=0.5 if not sizes else float(1 in sizes))

    @F.pandas_udf("array<binary>")
    def spread_chunks(texts: pd.Series) -> pd.Series:
        def pick(text):
            chunks = chunks_of(text)
            return [chunks[i] for i in sorted({*np.linspace(0, len(chunks) - 1, most_chunks).astype(int)})] if chunks else []

        return texts.map(pick)

    rows = sorted(sampled_texts(docs, sample, {"chunks": spread_chunks("text")}).collect(), key=lambda r: r["doc_id"])
    held = {v: [r["chunks"] for r in rows if r["label"] == v and r["chunks"]] for v in (0, 1)}
    if not held[0] or not held[1]:
        return CompressionModel(constant=sizes[1] / (sizes[0] + sizes[1]))
    # each third text calibrates; with very few texts all do both
    few = min(map(len, held.values())) < 6
    learn = {v: [c for i, chunks in enumerate(x) for c in chunks if few or i % 3] for v, x in held.items()}
    good_bytes, bad_bytes = dictionary(learn[1]), dictionary(learn[0])
    good, bad = compressor(good_bytes), compressor(bad_bytes)
    check = [(chunks, v) for v, x in held.items() for i, chunks in enumerate(x) if few or i % 3 == 0]
    y = np.array([v for _, v in check], float)
    weight = np.where(y == 1, sizes[1] / max(1, y.sum()), sizes[0] / max(1, (1 - y).sum()))
    weight *= len(y) / weight.sum()
    plain = np.array([difference(good, bad, chunks, 0.0) for chunks, _ in check])
    mean = float(np.average(plain, weights=weight))
    x = np.array([difference(good, bad, chunks, mean) for chunks, _ in check])
    slope, offset = logistic(x, y, weight)
    return CompressionModel(good_bytes, bad_bytes, mean, float(slope), float(offset))


def quality_score(spark: SparkSession, model: CompressionModel, text: Column) -> Column:
    """Score of whole texts, from 0 to 1; higher: good is likelier. A null or empty text scores as an average one.

    The model has a fixed size (two dictionaries of DICTIONARY_BYTES).
    """
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        of = shared.value.scorer()
        for texts in batches:
            yield pd.Series([of(chunks_of(t)) for t in texts], dtype=float)

    return score(text)


def keep_quality(docs: DataFrame, model: CompressionModel, threshold: float = 0.7) -> DataFrame:
    """The rows of docs, with all their columns as they are, whose text scores at least the threshold.

    Null and empty texts score as average ones; repeated rows are judged alike; an empty table stays empty.
    """
    return docs.where(quality_score(docs.sparkSession, model, docs["text"].cast("string")) >= threshold)
