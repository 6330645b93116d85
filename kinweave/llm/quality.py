"""Quality by compression: which of two dictionaries, built from good and from bad text, fits a text better.

Two zstandard dictionaries are trained on a bounded sample of labelled rows.  A text is compressed in blocks, each once with
either dictionary; the difference of the two compressed sizes, divided by the length of the text, is its one feature.  Blocks
keep the dictionaries in force over the whole of a long text, which would otherwise compress by its own beginning.  A logistic
curve, fitted to other rows of the sample than the dictionaries, turns the difference into a probability.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from kinweave.llm.common import key_bucket, labelled_sample, narrow

#: Bounds of the training sample: rows of each class, and characters of a row.  Half of them build the dictionaries.
PER_CLASS, MAX_CHARS = 3_000, 20_000
BLOCK, LEVEL, DICTIONARY_BYTES = 512, 3, 112_640
#: Added to a text's length, so that a handful of bytes decides little.
DAMP = 32


def blocks(text: bytes) -> list[bytes]:
    return [text[i : i + BLOCK] for i in range(0, len(text), BLOCK)]


def dictionary(texts: list[bytes]) -> zstandard.ZstdCompressionDict:
    """A trained dictionary; the plain text of the samples where there is too little to train on."""
    parts = [b for t in texts for b in blocks(t)]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, parts)
    except zstandard.ZstdError:
        return zstandard.ZstdCompressionDict(b"".join(parts)[-DICTIONARY_BYTES:], dict_type=zstandard.DICT_TYPE_RAWCONTENT)


class Compressors:
    """The two compressors of a model; made once per task, since they can't travel."""

    def __init__(self, good: bytes, bad: bytes):
        plain = {"write_content_size": False, "write_checksum": False, "write_dict_id": False, "level": LEVEL}
        self.each = [zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(d), **plain) for d in (good, bad)]

    def difference(self, text: bytes) -> float:
        """(size by the bad dictionary - size by the good one) / damped length."""
        good, bad = (c.compress for c in self.each)
        return sum(len(bad(b)) - len(good(b)) for b in blocks(text)) / (len(text) + DAMP)


@dataclass
class CompressionModel:
    good: bytes
    bad: bytes
    slope: float
    offset: float

    @classmethod
    def fit(cls, texts: list[bytes], marks: np.ndarray) -> CompressionModel:
        """Dictionaries from every other row of a class, the curve from the rest, by Newton steps on the logistic loss."""
        odd = np.zeros(len(marks), bool)
        for mark in (0, 1):
            odd[np.flatnonzero(marks == mark)[1::2]] = True
        good, bad = (dictionary([t for t, m, o in zip(texts, marks, odd) if m == mark and not o]).as_bytes() for mark in (1, 0))
        pair = Compressors(good, bad)
        rest = odd if odd.any() else ~odd
        x = np.array([pair.difference(t) for t, o in zip(texts, rest) if o])
        y = marks[rest].astype(float)
        basis, (offset, slope) = np.c_[np.ones(len(x)), x], np.zeros(2)
        ridge = np.diag([1e-3, 1e-3])
        weights = np.zeros(2)
        for _ in range(50 if len(x) else 0):
            p = 1 / (1 + np.exp(-np.clip(basis @ weights, -30, 30)))
            grad = basis.T @ (p - y) + ridge @ weights
            curve = (basis * (p * (1 - p) + 1e-9)[:, None]).T @ basis + ridge
            step = np.linalg.solve(curve, grad)
            weights = weights - step * min(1.0, 10 / max(np.abs(step).max(), 1e-12))
            if np.abs(step).max() < 1e-8:
                break
        offset, slope = weights
        return cls(good, bad, float(slope), float(offset))

    def score(self) -> Column:
        """A function of a text column: the probability of label 1, 0 to 1; null and empty texts lie at difference 0."""
        model = self

        @pandas_udf("double")
        def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            pair = Compressors(model.good, model.bad)
            for texts in batches:
                x = np.array([pair.difference(t.encode()) if t else 0.0 for t in texts], float)
                yield pd.Series(1 / (1 + np.exp(-np.clip(model.offset + model.slope * x, -500, 500))))

        return scored


def fit(docs: DataFrame, labels: DataFrame, learn: Column | None = None) -> CompressionModel:
    """Fit on at most `PER_CLASS` labelled rows of each class with texts of at most `MAX_CHARS` characters."""
    rows = labelled_sample(docs, labels, "quality", F.lit(True) if learn is None else learn, PER_CLASS, MAX_CHARS)
    marks = np.array([mark for mark, _ in rows], np.int64)
    return CompressionModel.fit([text.encode() for _, text in rows], marks)


def quality(
    docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", held_parts: int = 4, held_out: int = 2
) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted (1 from 0.7).

    Rows whose crc32(doc_id as text) mod `held_parts` is `held_out` are never learned from.  Null and empty texts score as
    texts that fit both dictionaries equally; a null doc_id is not held out.  Repeated rows score alike.  With no labelled
    rows at all every score is 0.5.  An empty table gives an empty result.
    """
    rows = narrow(docs, doc_id=doc_id, text=text)
    bucket = key_bucket("doc_id", held_parts)
    model = fit(rows, labels, F.coalesce(bucket != held_out, F.lit(True)))
    scored = rows.select("doc_id", F.coalesce(bucket == held_out, F.lit(False)).alias("held_out"), model.score()("text").alias("score"))
    return scored.withColumn("predicted", F.when(F.col("score") >= 0.7, 1).otherwise(0))
