import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from kinweave.llm import quality, toxicity
from kinweave.llm.common import labelled_sample, table

CASES = [(quality.quality, "quality", 4, 2, 0.7), (toxicity.toxicity, "toxic", 5, 0, 0.5)]


@pytest.mark.parametrize("score,mark,parts,out,limit", CASES)
def test_held_out_accuracy(spark, score, mark, parts, out, limit):
    """Better than always the commoner mark, on rows that were not learned from."""
    folder = "/root/testdata/sf0.1"
    labels = table(spark, folder, "labels")
    got = score(table(spark, folder, "documents"), labels)
    rows = got.join(labels, "doc_id").where("held_out").select("predicted", mark, "score").collect()
    truth = np.array([r[mark] for r in rows])
    right = np.array([r["predicted"] for r in rows]) == truth
    both = min(right[truth == 0].mean(), right[truth == 1].mean())
    assert right.mean() > 0.95 and both > 0.85, (right.mean(), both)


@pytest.mark.parametrize("score,mark,parts,out,limit", CASES)
def test_awkward_rows(odd, known, nothing, score, mark, parts, out, limit):
    got = score(odd, known).collect()
    assert len(got) == odd.count()
    for r in got:
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= limit)
        assert r["held_out"] == (r["doc_id"] is not None and brute.held(r["doc_id"], parts, out))
    blank = {r["score"] for r in got if r["doc_id"] in (3, 4)}
    assert len(blank) == 1
    assert score(nothing, known).collect() == []
    assert {r["score"] for r in score(odd, known.limit(0)).collect()} == {0.5}


@pytest.mark.parametrize("score,mark,parts,out,limit", CASES)
def test_held_out_labels_are_never_used(odd, known, score, mark, parts, out, limit):
    """Turning the held-out labels round changes no score."""
    bucket = F.crc32(F.col("doc_id").cast("string")) % parts
    turned = known.withColumn(mark, F.when(bucket == out, 1 - F.col(mark)).otherwise(F.col(mark)))
    one, two = ({(r["doc_id"], r["score"]) for r in score(odd, k).collect()} for k in (known, turned))
    assert one == two


def test_samples_bound_rows_not_ids(spark):
    """One labelled id that very many rows repeat, with equal and with other texts, one of them very long."""
    rows = [(1, "same words")] * 5_000 + [(1, "x" * 50_000), (1, "another text"), (2, "short"), (3, None), (4, "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(6)
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 0), (3, 1), (4, 0), (None, 1), (5, 1), (2, None)], "doc_id bigint, quality int")
    got = labelled_sample(docs, labels, "quality", F.lit(True), 40, 1_000)
    assert len(got) == 42 and [t for m, t in got if m == 0] == ["short"] * 2
    assert {t for m, t in got if m == 1} <= {"same words", "another text"} and sum(m for m, _ in got) == 40
    everything = labelled_sample(docs, labels, "quality", F.lit(True), 10_000, 1_000)
    assert len(everything) == 5_001 + 2 and labelled_sample(docs, labels.limit(0), "quality", F.lit(True), 40, 1_000) == []


@pytest.mark.parametrize("per_class", [3_000, 60])
def test_quality_equals_brute_force(spark, monkeypatch, per_class):
    """Every score of sf0.01, with a sample that holds all labelled rows and with one that has to choose."""
    monkeypatch.setattr(quality, "PER_CLASS", per_class)
    folder = "/root/testdata/sf0.01"
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    pairs = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    marks = [(r["doc_id"], r["quality"]) for r in labels.select("doc_id", "quality").collect()]
    expected = brute.quality(pairs, marks, per_class, quality.MAX_CHARS, quality.DICTIONARY_BYTES, quality.BLOCK, quality.DAMP)
    got = quality.quality(docs, labels).collect()
    assert len(got) == len(pairs)
    for r in got:
        assert abs(r["score"] - expected[r["doc_id"]]) < 1e-6, r
        assert r["held_out"] == brute.held(r["doc_id"], 4, 2) and r["predicted"] == int(r["score"] >= 0.7)


def test_pairs_of_terms_can_mean_what_terms_do_not():
    """Exclusive or of two terms, which no linear weights can learn."""
    rng = np.random.default_rng(1)
    texts, marks = [], []
    for _ in range(800):
        a, b = rng.integers(0, 2, 2)
        texts.append(" ".join(["filler", *(["insult"] * a), *(["group"] * b)]))
        marks.append(int(a != b))
    model = toxicity.FactorizationMachine.fit(texts, np.array(marks), epochs=200)
    place = {int(t): i for i, t in enumerate(model.terms)}
    rows = [np.array(sorted({place[t] for w in x.split() for t in toxicity.terms_of(w) if t in place})) for x in texts]
    assert ((model.raw(rows) > 0) == np.array(marks)).mean() > 0.95


def test_factorised_sum_equals_all_pairs():
    rng = np.random.default_rng(2)
    model = toxicity.FactorizationMachine(np.arange(9), 0.3, rng.normal(size=9), rng.normal(size=(9, 4)))
    at = np.array([0, 3, 4, 8])
    pairs = sum(model.factors[i] @ model.factors[j] for i in at for j in at if i < j)
    assert np.isclose(model.raw([at])[0], 0.3 + model.linear[at].sum() + pairs)
