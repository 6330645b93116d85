import os
import random
import re
import sys
from collections import defaultdict

import brute
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

import corpus_pipeline  # noqa: E402
from kinweave.llm import nearcopies, simhash  # noqa: E402
from kinweave.llm.common import table  # noqa: E402

SCHEMA = "doc_id bigint, text string"


def shingles(text, n=5):
    found = brute.WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {" ".join(found[i : i + n]) for i in range(max(1, len(found) - n + 1))} if found else set()


def jaccard_links(texts, least):
    """All pairs whose plain Jaccard similarity of five-word shingle sets is at least `least`, by an inverted index."""
    sets, lists, shared = [shingles(t) for t in texts], defaultdict(list), defaultdict(int)
    for i, s in enumerate(sets):
        for x in s:
            for j in lists[x]:
                shared[j, i] += 1
            lists[x].append(i)
    return {p for p, o in shared.items() if o >= least * (len(sets[p[0]] | sets[p[1]]))}


def roots(n, links):
    parent = list(range(n))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in links:
        a, b = root(i), root(j)
        parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(n)]


def planted(seed, share, n=150):
    """Pairs of texts of which the second replaces the last words: similarity about `share`."""
    rnd, out = random.Random(seed), []
    for i in range(n):
        size = rnd.randint(60, 400)
        keep = size - round((size - 4) * (1 - share) / (1 + share))
        base = brute.words(f"{seed} {i}", size)
        out += [base, " ".join(base.split()[:keep]) + " " + brute.words(f"{seed} {i} end", size - keep)]
    return out


def kept(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), SCHEMA).repartition(5)
    return {r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()}


def test_planted_near_copies_go(spark):
    texts = [t for k, share in enumerate((0.805, 0.85, 0.9, 0.95, 1.0)) for t in planted(k, share)]
    links = jaccard_links(texts, 0.8)
    assert len(links) >= 700
    left = kept(spark, texts)
    assert sum(j not in left for _, j in links) >= 0.999 * len(links)
    assert left >= set(roots(len(texts), links))


def test_simhash_index_finds_candidates(spark, monkeypatch):
    """Near copies that no band shows are found by their fingerprints; those whose sets differ too much are not linked."""
    monkeypatch.setattr(nearcopies, "bands", lambda mins: [])
    texts = [t for i in range(60) for base in [brute.words(f"s {i}", 300)] for t in (base, base + f" last{i}")]
    # two words over and over: the shingle in most places decides the fingerprint, further words only the set
    texts += [" ".join(["ab"] * 60), " ".join(["ab"] * 60 + ["cd", "ef"])]
    prints = [int.from_bytes(simhash.fingerprint(t.encode())) for t in texts]
    close = [i for i in range(0, len(texts), 2) if (prints[i] ^ prints[i + 1]).bit_count() <= 4]
    links = jaccard_links(texts, 0.8)
    linked = [i for i in close if (i, i + 1) in links]
    assert len(linked) >= 30 and len(texts) - 2 in close and len(texts) - 2 not in linked
    left = kept(spark, texts)
    assert all(i in left and i + 1 not in left for i in linked)
    assert {len(texts) - 2, len(texts) - 1} <= left
