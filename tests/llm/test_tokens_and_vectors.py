import hashlib
import random

import brute
import numpy as np
import public_tokenizers
import pytest

from kinweave.llm import alignment, queries, tokencounts, whitening
from kinweave.llm.common import table

FOLDER = "/root/testdata/sf0.01"
A, B = queries.vocabulary_path("byte_bpe_50k.json"), queries.vocabulary_path("piece_bpe_32k.model")


def odd_texts(seed, n):
    """Random texts of blanks, marks, special strings, letters of several scripts and control characters."""
    rnd = random.Random(seed)
    bits = list(" \n\tab▁漢é\x00'.9　​\x1cs=") + [" the", "  ", "<|endoftext|>", "<s>", "don't", "====="]
    return ["".join(rnd.choices(bits, k=rnd.randint(0, 80))) for _ in range(n)] + ["", " ", "  ", "▁"]


def lengths_of(name):
    path = public_tokenizers.path(name)
    if name.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda t: len(model.encode(t))
    import tokenizers

    tokenizer = tokenizers.Tokenizer.from_file(path)
    return lambda t: len(tokenizer.encode(t, add_special_tokens=False).ids)


@pytest.mark.parametrize("name", ["piece_bpe_32k.model", "byte_bpe_50k.json", "word_bpe_49k.json"])
@pytest.mark.parametrize("most", [1, 9, 1 << 15])
def test_parts_do_not_change_counts(name, most):
    count, texts = lengths_of(name), odd_texts(most, 800)
    made = tokencounts.Lengths(name.rsplit(".")[-1], tokencounts.file_of(public_tokenizers.path(name)))
    assert made(texts, batch=500, most=most).tolist() == [count(t) for t in texts]
    assert made.cuts is not None
    assert made("", 1, 1).tolist() == []


def test_parts_are_short_and_slices_hold_all():
    made = tokencounts.Lengths("model", tokencounts.file_of(B))
    parts, added = made.parts("word " * 50_000, 1_000)
    assert max(map(len, parts)) < 1_010 and added == 0
    assert made.parts("漢" * 5_000, 100) == (["漢" * 5_000], 0)
    assert len(made.parts("漢字\n" * 5_000, 100)[0]) > 100
    assert list(tokencounts.slices(np.cumsum([5, 1, 9, 2, 2]), 6)) == [(0, 2), (2, 3), (3, 5)]
    with pytest.raises(ValueError):
        tokencounts.Lengths("txt", b"")


def test_token_counts_of_the_query(spark):
    count, rows = lengths_of("piece_bpe_32k.model"), table(spark, FOLDER, "documents").collect()
    got = {r["doc_id"]: r for r in queries.op13_token_counts(spark, FOLDER).collect()}
    assert len(got) == len(rows)
    for r in rows:
        n, text = count(r["text"] or ""), r["text"] or ""
        assert tuple(got[r["doc_id"]]) == (r["doc_id"], len(text.encode()), n, n > 4096)


def test_token_counts_of_awkward_documents(spark, odd, nothing):
    count = lengths_of("piece_bpe_32k.model")
    got = sorted((str(r["doc_id"]), r["n_bytes"], r["n_tokens"]) for r in tokencounts.count_tokens(odd, B).collect())
    rows = [(d, t or "") for d, t, *_ in brute.awkward()]
    assert got == sorted((str(d), len(t.encode()), count(t)) for d, t in rows)
    assert tokencounts.count_tokens(nothing, B).collect() == []
    assert tokencounts.count_tokens(odd, B, doc_id="key", limit=0).where("over_limit <> (n_tokens > 0)").count() == 0


def same_alignment(docs, found):
    rows = docs.select("doc_id", "text").collect()
    want, count = brute.aligned([r["text"] or "" for r in rows])
    digests = [(*x[:6], hashlib.sha256(x[6].encode()).hexdigest() if x[6] else "") for x in want]
    columns = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    got = found.documents().select(*columns).collect()
    assert sorted((str(r[0]), *r[1:]) for r in got) == sorted((str(r["doc_id"]), *x) for r, x in zip(rows, digests))
    highest = {}
    for (_, b), n in count.items():
        highest[b] = max(n, highest.get(b, 0))
    pairs = {(r["a"], r["b"]): (r["n"], r["best"]) for r in found.pair_counts().collect()}
    assert pairs == {p: (n, n == highest[p[1]]) for p, n in count.items()}


def test_alignment_of_awkward_documents(spark, odd, nothing):
    same_alignment(odd, alignment.align(odd, A, B))
    found = alignment.align(nothing, A, B)
    assert found.documents().collect() == [] and found.pair_counts().collect() == []


@pytest.mark.parametrize("block", [1, 700])
def test_alignment_does_not_depend_on_blocks(spark, block):
    docs = spark.createDataFrame(list(enumerate(odd_texts(3, 900))), "doc_id bigint, text string").repartition(2).persist()
    same_alignment(docs, alignment.align(docs, A, B, block=block))


def test_alignment_of_the_query_and_kept_groups(spark):
    docs = table(spark, FOLDER, "documents").where("doc_id < 200")
    found = alignment.align(docs, A, B, groups=True)
    same_alignment(docs, found)
    for r in found.documents().collect():
        assert r["groups_sha256"] == (hashlib.sha256(r["groups"].encode()).hexdigest() if r["groups"] else "")
        assert r["groups"].count(";") + 1 == r["n_groups"] or not r["groups"]


def test_identity_map():
    a, b = [b"x", b"", b"yz", b"q"], [b"yz", b"x", b"x", b" "]
    assert alignment.identity_map(a, b, [False, True, False, False]).tolist() == [2, -1, 0, -1]


def whitened_plainly(vectors):
    x = np.floor(1024 * np.array(vectors, float)).astype(np.int64) + 100_000
    n, s = len(x), x.sum(0)
    centred = x - s / n
    values, found = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(-values)[:8]
    white = centred @ found[:, order] / np.sqrt(values[order])
    return white, values[order] / values.sum(), [sum(int(n * v - t) ** 2 for v, t in zip(r, s)) for r in x.tolist()]


def test_whitening_of_the_query(spark):
    rows = [r for r in table(spark, FOLDER, "embeddings").collect()]
    white, explained, apart = whitened_plainly([r["embedding"] for r in rows])
    got = queries.op12_whitening(spark, FOLDER).toPandas()
    assert len(got) == 8 * len(rows) and set(got["n"]) == {len(rows)}
    table_ = got.pivot(index="vec_id", columns="component", values="whitened").loc[[r["vec_id"] for r in rows]].to_numpy()
    signs = np.sign((table_ * white).sum(0))
    assert np.abs(table_ * signs - white).max() < 1e-9
    assert np.abs(got.groupby("component")["explained"].first().to_numpy() / explained - 1).max() < 1e-9
    assert got.groupby("vec_id")["deviation"].first().loc[[r["vec_id"] for r in rows]].tolist() == apart
    assert got["identity_error"].max() < 1e-9


def test_whitening_of_awkward_vectors(spark):
    rows = [(1, [1.0, 2.0]), (None, [3.0, 4.0]), (2, None), (3, [1.0, None]), (4, [float("nan"), 1.0])]
    rows += [(5, []), (1, [1.0, 2.0]), (6, [float("-inf"), 0.0])]
    given = spark.createDataFrame([(*r, 7, "x") for r in rows], "vec_id bigint, embedding array<float>, n int, place string")
    got = whitening.whiten(given).collect()
    assert sorted(str(r["vec_id"]) for r in got) == ["1", "1", "None"]
    assert {len(r["whitened"]) for r in got} == {1}  # all on one line: one component has variance
    assert abs(sum(r["whitened"][0] for r in got)) < 1e-9 and got[0]["identity_error"] < 1e-9
    alike = whitening.whiten(given.where("vec_id = 1")).collect()
    assert [(r["n"], r["deviation"], r["whitened"]) for r in alike] == [(2, 0, []), (2, 0, [])]
    assert whitening.whiten(given.where("vec_id = 2")).collect() == []
    assert whitening.by_component(whitening.whiten(given.where("false"))).collect() == []
    mixed = spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "vec_id bigint, embedding array<double>")
    with pytest.raises(ValueError):
        whitening.whiten(mixed)


def test_equal_variances_are_all_found(spark):
    """Four axes of equal variance: a Krylov space of any start ends early, and fresh directions find the rest."""
    rows = [(8 * s + i, [float(s) * (i == j) for j in range(4)]) for s in (-1, 1) for i in range(4)]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).collect()
    assert {len(r["whitened"]) for r in got} == {4}
    assert np.allclose(got[0]["explained"], 0.25) and got[0]["identity_error"] < 1e-9


def test_deviations_beyond_64_bits():
    x = np.array([[100_000.0, 2.0**49], [100_001.0, 0.0]])
    sums = [3_000_000_000_200, 7 << 50]
    n = 1 << 36
    want = [sum((n * int(v) - s) ** 2 for v, s in zip(r, sums)) for r in x]
    assert whitening.deviations(x, n, sums) == want


def test_fewer_steps_lead_to_the_first_components():
    rnd = np.random.default_rng(1)
    x = rnd.standard_normal((400, 30)) * 2.0 ** -np.arange(30)
    x -= x.mean(0)

    def product(y):
        u = x @ y
        return x.T @ u, float(u @ u)

    full = np.linalg.svd(x, compute_uv=False)
    for steps in (12, 30):
        v, b = whitening.bidiagonal(product, 30, steps)
        assert np.abs(v.T @ v - np.eye(steps)).max() < 1e-12
        assert np.allclose(np.linalg.svd(b, compute_uv=False)[:4], full[:4], rtol=1e-9)
