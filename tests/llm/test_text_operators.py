import hashlib
import random
import unicodedata

import brute
import numpy as np
import pytest

from kinweave.llm import bpe, fingerprints, urls
from kinweave.llm.common import table
from kinweave.llm.queries import vocabulary_path


@pytest.mark.parametrize("which", ["odd", "small"])
def test_bpe_equals_the_library(spark, odd, small, which):
    from tokenizers import Tokenizer

    docs = odd if which == "odd" else table(spark, small, "documents")
    tokenizer, path = Tokenizer.from_file(vocabulary_path()), vocabulary_path()
    expected = []
    for r in docs.select("doc_id", "text").collect():
        ids = tokenizer.encode(r["text"] or "", add_special_tokens=False).ids
        expected.append((r["doc_id"], ids, tokenizer.decode(ids, skip_special_tokens=False)))
    decoded = bpe.decode(bpe.encode(docs, path), path)
    at_once = bpe.encode(docs, path, decoded=True)
    assert sorted(map(str, at_once.collect())) == sorted(map(str, decoded.collect()))
    nulls = bpe.decode(spark.createDataFrame([(1, None), (2, []), (3, [5, 7])], "doc_id int, token_ids array<int>"), path)
    assert [r["decoded"] for r in nulls.orderBy("doc_id").collect()] == ["", "", "& ("]
    assert sorted(((r[0], r[1], r[2]) for r in decoded.collect()), key=str) == sorted(expected, key=str)
    digests = {(r[0], r[1], r[2], r[3]) for r in bpe.digests(decoded).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert digests == {(d, len(ids), sha(" ".join(map(str, ids))), sha(text)) for d, ids, text in expected}


def test_bpe_of_odd_strings():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(vocabulary_path())
    encoder = bpe.Encoder(bpe.Vocabulary.read(vocabulary_path()))
    rng = np.random.default_rng(4)
    texts = ["", "<|endoftext|>x<|startoftext|> <|endoftext|", "aaaa aaaaaaaaa", "ΑΣ ΣΑΣ. Σ", "é Å İ", "a\x1cb\x85c d"]
    texts += ["".join(rng.choice(list("aAbB<|>'stlve1 \n漢é"), 60)) for _ in range(500)]
    assigned = [c for c in map(chr, range(32, 0xD800)) if unicodedata.category(c) not in ("Cn", "Co")]
    texts += ["".join(rng.choice(assigned, 30)) for _ in range(300)]
    ids, counts = encoder.encode(texts)
    ends = np.cumsum(counts)
    for text, end, n in zip(texts, ends, counts):
        assert ids[end - n : end].tolist() == tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


def test_bpe_forgets_without_a_trace(monkeypatch):
    texts = [brute.words(i, 50) for i in range(30)]
    vocabulary = bpe.Vocabulary.read(vocabulary_path())
    whole = bpe.Encoder(vocabulary).encode(texts)[0]
    monkeypatch.setattr(bpe, "POOL", 10)
    encoder = bpe.Encoder(vocabulary)
    assert np.concatenate([encoder.encode([t])[0] for t in texts]).tolist() == whole.tolist()


URLS = [
    None, "", "no scheme", "http://", "://", "http://ORG/", "https://a.ORG/x?y#z", "http://org", "http://.org/", "http://xorg/a",
    "http://www.example.org/es/1", "http://example.org/es", "http://example.org/en/12", "http://xexample.org/en/1", "http://a.com/fr/", "http://com/de/x",
    "http://a.com/de?/x", "http://evil.net/x.org/", "http://evil.net/?u=http://a.org/", "ftp://a.b.example.org/en/1#f", "http://é.org/ü/ÄA", "http://a.org:80/",
    "http://a\n.org/\n/x", "http://" + "a" * 5000 + ".com/fr/" + "b" * 5000,
]


@pytest.mark.parametrize("rules", [urls.RULES, [("block", f"h{i}.example/p{i}/") for i in range(40)] + list(urls.RULES), []])
def test_urls(spark, rules):
    pages = spark.createDataFrame([(i, u, "h", "v") for i, u in enumerate(URLS + URLS[-3:])], "page_id int, url string, host string, verdict string")
    got = urls.filter_urls(pages, rules=rules).collect()
    expected = [(i, *brute.url(u, rules, urls.DEFAULT)) for i, u in enumerate(URLS + URLS[-3:])]
    assert sorted(map(tuple, got), key=str) == sorted(expected, key=str)
    assert urls.filter_urls(pages.limit(0)).collect() == []


def jaccard(a, b):
    return len(a & b) / len(a | b) if a or b else 1.0


@pytest.mark.parametrize("which", ["odd", "small"])
def test_edited_pairs(spark, odd, small, which):
    docs = odd.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"]) if which == "odd" else table(spark, small, "documents")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    texts, expected = dict(rows), brute.edited(rows)
    order = sorted(texts, reverse=True)
    got = {r["doc_id"]: r for r in fingerprints.edited_pairs(docs).collect()}
    assert set(got) == set(texts)
    for i, d in enumerate(order):
        r, (n, changed) = got[d], expected[d]
        assert r["n_chars"] == n and r["edited_sha256"] == hashlib.sha256(changed.encode()).hexdigest()
        own, new, after = (fingerprints.sketch((t or "").encode()) for t in (texts[d], changed, texts[order[(i + 1) % len(order)]]))
        assert r["fingerprint"] == fingerprints.to_text(own) and r["edited_fingerprint"] == fingerprints.to_text(new)
        assert r["near_edited"] == jaccard(set(own.tolist()), set(new.tolist()))
        assert r["near_next"] == jaccard(set(own.tolist()), set(after.tolist()))
    sketches = {r["doc_id"]: r["fingerprint"] for r in fingerprints.document_sketches(docs).collect()}
    assert sketches == {d: r["fingerprint"] for d, r in got.items()}


def test_edited_pairs_of_repeated_and_null_ids(spark, odd, nothing):
    got = fingerprints.edited_pairs(odd).collect()
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(r["doc_id"]) for r in odd.collect())
    assert fingerprints.edited_pairs(nothing).collect() == []
    one = spark.createDataFrame([(1, "a b c d e f g h i")], "doc_id bigint, text string")
    assert [r["near_next"] for r in fingerprints.edited_pairs(one).collect()] == [1.0]


def test_edited_pairs_of_text_ids(spark):
    """Ids that are no numbers, one beginning another, beyond ASCII, and empty, in the order of their bytes."""
    rng = random.Random(4)
    ids = ["", "a", "a b", "ab", "\u00e9t\u00e9", "\U0001f600", "Zeta", "document-1", "document-10", "document-2", *(f"id{i}" for i in range(40))]
    rows = [(d, brute.words(i, rng.randrange(1, 60))) for i, d in enumerate(ids)]
    expected = brute.edited([(d.encode(), t) for d, t in rows])
    got = fingerprints.edited_pairs(spark.createDataFrame(rows, "doc_id string, text string").repartition(4)).collect()
    assert len(got) == len(ids)
    for r in got:
        n, changed = expected[r["doc_id"].encode()]
        assert (r["n_chars"], r["edited_sha256"]) == (n, hashlib.sha256(changed.encode()).hexdigest())


def test_likeness_of_short_texts():
    """Mean error of the likeness of texts of 20 to 50 words to their beginnings, against whole shingle sets."""
    errors = []
    for seed in range(300):
        text = brute.words(seed, 20 + seed % 31).split(" ")
        one, two = " ".join(text), " ".join(text[: len(text) * 2 // 3])
        sets = [{tuple(t[i : i + 5]) for i in range(len(t) - 4)} for t in (one.split(" "), two.split(" "))]
        errors.append(abs(fingerprints.likeness(*(fingerprints.sketch(t.encode()) for t in (one, two))) - jaccard(*sets)))
    assert np.mean(errors) < 0.11, np.mean(errors)


def test_sketches_estimate_and_merge():
    a, b = brute.words(21, 4000), brute.words(22, 40_000)
    whole = (a + " " + b).encode()
    first, both = fingerprints.sketch(a.encode()), fingerprints.sketch(whole)
    assert fingerprints.containment(first, both) == 1.0
    assert abs(fingerprints.likeness(first, both) - 4000 / 44_000) < 0.02
    assert (fingerprints.from_text(fingerprints.to_text(both)) == both).all()
    merged = np.union1d(first, fingerprints.sketch(b.encode()))
    assert set(merged.tolist()) <= set(both.tolist())
