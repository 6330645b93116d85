import hashlib
import random

import brute
import numpy as np
import pytest

from kinweave.llm import exact, simhash, suffixes
from kinweave.llm.common import table


def plain(frame):
    return sorted(map(tuple, frame.collect()), key=str)


def pairs(docs):
    return [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]


@pytest.mark.parametrize("which", ["odd", "small"])
def test_exact_duplicates(spark, odd, small, which):
    docs = odd if which == "odd" else table(spark, small, "documents")
    got = exact.exact_duplicates(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")
    assert plain(got) == sorted(brute.exact(pairs(docs)), key=str)


@pytest.mark.parametrize("bits", [12, 16, 30])
def test_quotient_filters_merge_without_loss(bits):
    rng = np.random.default_rng(3)
    parts = [rng.integers(0, 2**64, n, np.uint64) for n in (500, 500, 0, 7, 90, 1)]
    parts[1][:100] = parts[0][:100]
    parts[4][:5] = np.uint64(2**64 - 1)
    of = exact.CountingQuotientFilter.of
    merged = exact.CountingQuotientFilter.merged(of(bits, part) for part in parts)
    keys, counts = np.unique(np.concatenate(parts), return_counts=True)
    assert (merged.keys() == keys).all() and (merged.counts == counts).all()
    assert (merged.repeated() == keys[counts > 1]).all()
    assert merged.runs.sum() == len(keys) and (np.diff(merged.quotients.astype(float)) > 0).all()
    # what travels in blocks comes back as it was
    for block_bits in (0, 4, 12):
        back = [exact.CountingQuotientFilter.of_block(bits, block_bits, *row) for row in merged.blocks(block_bits)]
        assert (np.concatenate([p.keys() for p in back]) == keys).all()
        assert (np.concatenate([p.counts for p in back]) == counts).all()
    assert exact.CountingQuotientFilter.merged([]) is None and not list(of(bits, parts[2]).blocks(4))


def test_repeated_fingerprints_over_many_filters(spark, monkeypatch):
    """Filters sent off often and cut into many blocks find the same fingerprints."""
    monkeypatch.setattr(exact, "BLOCK_KEYS", 64)
    monkeypatch.setattr(exact, "FILTER_KEYS", 50)
    rows = [(d % 37,) if d % 3 == 0 else (d * 0x9E3779B97F4A7C15 % 2**63 * (-1) ** d,) for d in range(3_000)]
    found = exact.repeated_fingerprints(spark.createDataFrame(rows, "fingerprint bigint").repartition(5), len(rows))
    seen = [r[0] for r in rows]
    assert sorted(r[0] for r in found.collect()) == sorted({v for v in seen if seen.count(v) > 1})


@pytest.mark.parametrize("which,turns,bits,words", [("odd", 1, 4, 4), ("small", 1, 4, 4), ("odd", 4, 44, 5), ("small", 3, 40, 5)])
def test_simhash_components(spark, odd, small, which, turns, bits, words):
    docs = odd if which == "odd" else table(spark, small, "documents")
    rows = pairs(docs)
    prints = [tuple(brute.simhash(t, words, turn=turn) for turn in range(turns)) for _, t in rows]
    alone = [p[0] for p in prints] if turns == 1 else prints
    roots = brute.classes([d for d, _ in rows], alone, bits, None if turns == 1 else simhash.spread(turns))
    expected = sorted(((d, f"{p[0]:016x}", r) for (d, _), p, r in zip(rows, prints, roots)), key=str)
    found = simhash.near_duplicates(docs, words=words, bits=bits, turns=turns)
    assert plain(found.select("doc_id", "fingerprint", "component_id")) == expected


@pytest.mark.parametrize("tile", [2048, 5])
def test_long_fingerprints_link_over_few_equal_bytes(spark, monkeypatch, tile):
    """Tiles change nothing for several fingerprints a document, either."""
    monkeypatch.setattr(simhash, "TILE", tile)
    rnd = random.Random(6)
    prints = [tuple(rnd.getrandbits(64) for _ in range(4)) for _ in range(20)]
    for p in prints[:20]:
        for bits in range(5, 60, 5):
            flipped = sum(1 << b for b in rnd.sample(range(256), bits))
            prints.append(tuple(x ^ (flipped >> 64 * t) % (1 << 64) for t, x in enumerate(p)))
    prints.sort(key=lambda p: p[0] ^ 1 << 63)  # as signed numbers
    signed = [tuple(x - (1 << 64) if x >> 63 else x for x in p) for p in prints]
    frame = spark.createDataFrame(signed, "print0 bigint, print1 bigint, print2 bigint, print3 bigint")
    found = {r["node"]: r["root"] for r in simhash.components(simhash.links(frame, len(signed), 44, 4)).collect()}
    assert [found.get(p[0], p[0]) for p in signed] == brute.classes([p[0] for p in signed], prints, 44, simhash.spread(4))


def test_spread_triples_share_one_position_at_most():
    from itertools import combinations

    for turns in (3, 4, 6):
        sets = [frozenset(t) for t in simhash.spread(turns)]
        assert all(len(s) == 3 for s in sets)
        assert all(len(s & t) <= 1 for s, t in combinations(sets, 2))


@pytest.mark.parametrize("expected,tile", [(10, 2048), (10_000, 2048), (10_000, 7), (1 << 25, 2048)])
def test_links_connect_what_is_linked(spark, monkeypatch, expected, tile):
    """All list lengths and tiles give the same components as all pairs."""
    monkeypatch.setattr(simhash, "TILE", tile)
    rnd = random.Random(5)
    prints = [rnd.getrandbits(64) for _ in range(60)]
    for p in prints[:30]:
        for bits in range(6):
            q = p
            for bit in rnd.sample(range(64), bits):
                q ^= 1 << bit
            prints.append(q)
    signed = sorted({p - (1 << 64) if p >> 63 else p for p in prints})
    frame = spark.createDataFrame([(p,) for p in signed], "print0 bigint")
    found = {r["node"]: r["root"] for r in simhash.components(simhash.links(frame, expected)).collect()}
    roots = brute.classes(signed, [p % (1 << 64) for p in signed])
    assert [found.get(p, p) for p in signed] == roots


def test_coverings_guarantee_a_shared_list():
    from itertools import combinations

    for size in (2, 3, 4):
        chosen = [set(c) for c in simhash.covering(size)]
        assert all(any(c <= set(four) for c in chosen) for four in combinations(range(8), 4))


@pytest.mark.parametrize("which,hot", [("odd", 2048), ("odd", 1), ("small", 2048), ("small", 1)])
def test_repeated_spans(spark, odd, small, which, hot, monkeypatch):
    monkeypatch.setattr(suffixes, "HOT", hot)
    docs = odd if which == "odd" else table(spark, small, "documents")
    rows = pairs(docs)
    texts = [(t or "").encode() for _, t in rows]
    expected = []
    for (d, _), t, spans in zip(rows, texts, brute.repeated_bytes(texts, 400)):
        rest = b"".join(t[a:b] for a, b in zip([0, *(h for _, h in spans)], [*(l for l, _ in spans), len(t)]))
        expected.append((d, len(t), sum(h - l for l, h in spans), spans, hashlib.sha256(rest).hexdigest()))
    got = [(r[0], r[1], r[2], [tuple(s) for s in r[3]], r[4]) for r in suffixes.repeated_spans(docs).collect()]
    assert sorted(got, key=str) == sorted(expected, key=str)


def test_pieces_of_a_long_text_change_nothing(spark, odd, monkeypatch):
    before = plain(suffixes.repeated_spans(odd))
    monkeypatch.setattr(suffixes, "PIECE", 1 << 11)
    assert plain(suffixes.repeated_spans(odd)) == before


def test_suffix_sort_equals_plain_sort():
    rnd = random.Random(9)
    data = bytes(rnd.choices(b"ab", k=3000))
    starts = np.array(rnd.sample(range(2900), 900))
    bucket = np.array([rnd.randrange(4) for _ in starts])
    for length in (8, 60):
        order, same = suffixes.sort_suffixes(np.frombuffer(data, np.uint8), starts, bucket, length)
        keys = [(bucket[i], data[starts[i] : starts[i] + length]) for i in order]
        assert keys == sorted(keys)
        assert same.tolist() == [False, *(a == b for a, b in zip(keys, keys[1:]))]


def test_empty_tables(nothing):
    for frame in (exact.exact_duplicates(nothing), simhash.near_duplicates(nothing), suffixes.repeated_spans(nothing)):
        assert frame.collect() == []
