import random

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from kinweave.functions import similarity

LETTERS = "abcdeé üñ1 "


def _pairs(count, seed=3):
    rng = random.Random(seed)

    def word(limit):
        return "".join(rng.choice(LETTERS) for _ in range(rng.randint(0, limit)))

    def typo(text):
        chars = list(text)
        for _ in range(rng.randint(0, 4)):
            if chars:
                chars[rng.randrange(len(chars))] = rng.choice(LETTERS)
        return "".join(chars)

    pairs = []
    for _ in range(count):
        limit = rng.choice([3, 8, 20, 50, 90, 200, 260])
        left = word(limit)
        pairs.append((left, typo(left) if rng.random() < 0.5 else word(limit)))
    return pairs


def _expected(pairs):
    frame = pd.DataFrame(pairs, columns=["l", "r"])  # noqa: F841
    return duckdb.sql("SELECT jaro_winkler_similarity(l, r) AS s FROM frame").df()["s"].to_numpy()


def _encoded(pairs):
    values, code = np.unique(np.array([p[0] for p in pairs] + [p[1] for p in pairs], dtype=object), return_inverse=True)
    return similarity.EncodedStrings(list(values)), code[: len(pairs)], code[len(pairs) :]


def test_scores_equal_the_database_function():
    pairs = _pairs(20_000)
    found = similarity.score_pairs(*_encoded(pairs))
    assert np.abs(found - _expected(pairs)).max() < 1e-12


@pytest.mark.parametrize("cutoff", [0.5, 0.7, 0.8, 0.95])
def test_cutoff_and_filter_lose_nothing(cutoff):
    pairs = _pairs(20_000, seed=5)
    enc, left, right = _encoded(pairs)
    wanted = _expected(pairs) >= cutoff
    assert similarity.may_reach(enc, left, right, cutoff)[wanted].all()
    assert ((similarity.score_pairs(enc, left, right, cutoff) >= cutoff) == wanted).all()


def test_column_form(spark):
    rows = [("München", "Munchen"), ("", ""), ("", "a"), ("abc", "abc"), (None, "a"), ("a", None), ("x" * 100, "x" * 99 + "y")]
    frame = spark.createDataFrame(rows, "l string, r string")
    found = [r[0] for r in frame.select(similarity.jaro_winkler(F.col("l"), F.col("r"))).collect()]
    assert found[4] is None and found[5] is None
    plain = [rows[i] for i in (0, 1, 2, 3, 6)]
    assert [found[i] for i in (0, 1, 2, 3, 6)] == pytest.approx(list(_expected(plain)))
    assert round(found[0], 4) == 0.8821


def test_long_strings_equal_the_database_function():
    rng = random.Random(8)

    def text(n):
        return "".join(rng.choices("abcdefghijklmnopqrstuvwxyz  eeaaé", k=n))

    pairs = [("x" * 3000, "x" * 2000 + "y"), ("", "abc" * 500), ("a" * 70, "b" * 700), ("ab" * 900, "ba" * 800)]
    for _ in range(300):
        left = text(rng.randint(200, 4000))
        pairs.append((left, left[: rng.randint(1, len(left))] + text(rng.randint(1, 900))))
        pairs.append((left, text(rng.randint(1, 4000))))
    assert np.abs(similarity.score_pairs(*_encoded(pairs)) - _expected(pairs)).max() < 1e-12
