"""Toxicity by a factorization machine over hashed terms.

Terms are the lower-cased words of a text and their beginnings, hashed to `HASH_BITS` bits.  The machine adds to linear
weights the pairwise products of term factors, so that two terms together (an insult and who is meant) can weigh more or
less than their sum.  A bounded sample of labelled rows fits it: the terms that tell the classes apart best get weights and
factors, all others weigh nothing.  The fitted model is a few arrays of fixed size; scoring reads whole texts, one pass,
without a shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from kinweave.llm.common import key_bucket, labelled_sample, narrow

WORD = re.compile(r"[^\W_]+")
HASH_BITS = 20
#: Lengths of the word beginnings that are terms besides the word.
STEMS = (4, 5)
#: Bounds of the training sample: rows of each class, and characters of a row.
PER_CLASS, MAX_CHARS = 3_000, 20_000
#: Terms with weights, and numbers in a term's factor.
TERMS, RANK = 2_048, 8
#: Words whose terms a task remembers; it starts afresh beyond, with equal results.
CACHE = 200_000


def terms_of(word: str) -> list[int]:
    """Hashed terms of one lower-cased word."""
    names = [word, *(f"{word[:n]}*" for n in STEMS if len(word) > n)]
    return [xxhash.xxh3_64_intdigest(n) >> (64 - HASH_BITS) for n in names]


def words_of(text: str | None) -> set[str]:
    return set(WORD.findall(text.lower())) if text else set()


@dataclass
class FactorizationMachine:
    """terms (sorted hashes), bias, linear weights and factors of each."""

    terms: np.ndarray
    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def raw(self, rows: list[np.ndarray]) -> np.ndarray:
        """Log odds of rows of positions in `terms`, each the set of a text's terms.

        sum over pairs <v_i, v_j> = (|sum v_i|^2 - sum |v_i|^2) / 2, so a row costs its number of terms.
        """
        out = np.full(len(rows), self.bias)
        squares = (self.factors**2).sum(1)
        for i, at in enumerate(rows):
            if len(at):
                total = self.factors[at].sum(0)
                out[i] += self.linear[at].sum() + 0.5 * (total @ total - squares[at].sum())
        return out

    @classmethod
    def fit(cls, texts: list[str], marks: np.ndarray, epochs: int = 60, rate: float = 0.05, decay: float = 1e-4):
        """Adaptive gradient descent on the logistic loss, the classes weighted equally."""
        cache: dict[str, list[int]] = {}
        sets = []
        for text in texts:
            found: set[int] = set()
            for word in words_of(text):
                if word not in cache:
                    cache[word] = terms_of(word)
                found.update(cache[word])
            sets.append(np.fromiter(found, np.int64, len(found)))
        size = np.array([marks.sum(), (1 - marks).sum()], float)
        seen = np.zeros((2, 1 << HASH_BITS), np.float32)
        for found, mark in zip(sets, marks):
            seen[1 - mark, found] += 1
        share = (seen + 0.5) / (size[:, None] + 1)
        gain = np.abs(np.log(share[0] / share[1])) * np.sqrt(share.max(0)) * (seen.sum(0) >= 3)
        terms = np.sort(np.argsort(-gain, kind="stable")[:TERMS])
        rows = [np.flatnonzero(np.isin(terms, found, assume_unique=True)) for found in sets]

        rng = np.random.default_rng(7)
        bias, linear = 0.0, np.zeros(len(terms))
        factors = rng.normal(0, 0.01 if texts else 0.0, (len(terms), RANK))
        past_b, past_l, past_f = 1e-8, np.full(len(terms), 1e-8), np.full((len(terms), RANK), 1e-8)
        weight = np.where(marks == 1, 0.5 / max(size[0], 1), 0.5 / max(size[1], 1)) * len(marks)
        for _ in range(epochs):
            for batch in np.array_split(rng.permutation(len(rows)), max(1, len(rows) // 64)):
                grad_b, grad_l, grad_f = 0.0, np.zeros(len(terms)), np.zeros((len(terms), RANK))
                for i in batch:
                    at = rows[i]
                    own = factors[at]
                    total = own.sum(0)
                    raw = bias + linear[at].sum() + 0.5 * (total @ total - (own**2).sum())
                    miss = (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - marks[i]) * weight[i] / len(batch)
                    grad_b += miss
                    grad_l[at] += miss
                    grad_f[at] += miss * (total - own)
                grad_l += decay * linear
                grad_f += decay * factors
                past_b, past_l, past_f = past_b + grad_b**2, past_l + grad_l**2, past_f + grad_f**2
                bias -= rate * grad_b / np.sqrt(past_b)
                linear -= rate * grad_l / np.sqrt(past_l)
                factors -= rate * grad_f / np.sqrt(past_f)
        return cls(terms, float(bias), linear, factors)

    def score(self) -> Column:
        """A function of a text column: the probability of toxicity, 0 to 1; null and empty texts get that of no terms."""
        model = self
        place = {int(t): i for i, t in enumerate(self.terms)}

        @pandas_udf("double")
        def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            cache: dict[str, tuple[int, ...]] = {}
            for texts in batches:
                rows = []
                for text in texts:
                    words = words_of(text)
                    if len(cache) > CACHE:
                        cache.clear()
                    found: set[int] = set()
                    for word in words:
                        at = cache.get(word)
                        if at is None:
                            at = cache[word] = tuple(place[t] for t in terms_of(word) if t in place)
                        if at:
                            found.update(at)
                    rows.append(np.fromiter(found, np.int64, len(found)))
                yield pd.Series(1 / (1 + np.exp(-np.clip(model.raw(rows), -500, 500))))

        return scored


def fit(docs: DataFrame, labels: DataFrame, learn: Column | None = None) -> FactorizationMachine:
    """Fit on at most `PER_CLASS` labelled rows of each class with texts of at most `MAX_CHARS` characters."""
    rows = labelled_sample(docs, labels, "toxic", F.lit(True) if learn is None else learn, PER_CLASS, MAX_CHARS)
    marks = np.array([mark for mark, _ in rows], np.int64)
    return FactorizationMachine.fit([text for _, text in rows], marks)


def toxicity(
    docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", held_parts: int = 5, held_out: int = 0
) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted (1 from 0.5).

    Rows whose crc32(doc_id as text) mod `held_parts` is `held_out` are never learned from.  Null and empty texts score as
    texts without any known term; a null doc_id is not held out.  Repeated rows score alike.  Without labels of both
    classes every score is that of the classes seen, 0.5 with none.  An empty table gives an empty result.
    """
    rows = narrow(docs, doc_id=doc_id, text=text)
    bucket = key_bucket("doc_id", held_parts)
    model = fit(rows, labels, F.coalesce(bucket != held_out, F.lit(True)))
    scored = rows.select("doc_id", F.coalesce(bucket == held_out, F.lit(False)).alias("held_out"), model.score()("text").alias("score"))
    return scored.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))
