import math
import os
import re
import sys
from collections import Counter, defaultdict

import brute
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

import corpus_pipeline  # noqa: E402
from kinweave.llm import toxicity  # noqa: E402
from kinweave.llm.common import table  # noqa: E402

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def steps(spark):
    """Input and output rows of every stage."""
    docs, out = table(spark, FOLDER, "documents"), []
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        docs = stage(spark, docs, FOLDER).persist()
        out.append((name, before, docs.collect(), docs.columns))
    return out


def test_stages_follow_each_other(steps):
    assert [s[0] for s in steps] == ["toxicity", "exact_dedup", "near_dedup", "mixing", "bpe"]
    for _, before, after, columns in steps[:-1]:
        assert columns == ["doc_id", "text", "lang", "source", "n_chars"]
        assert {tuple(r) for r in after} <= {tuple(r) for r in before}
        assert after


def test_toxicity_stage(spark, steps):
    scored = toxicity.toxicity(table(spark, FOLDER, "documents"), table(spark, FOLDER, "labels"), held_out=-1)
    clean = {r["doc_id"] for r in scored.where("predicted = 0").collect()}
    assert {r["doc_id"] for r in steps[0][2]} == clean


def test_dedup_stages(steps):
    _, before, after, _ = steps[1]
    assert {r["doc_id"] for r in after} == {r[0] for r in brute.exact([(r["doc_id"], r["text"]) for r in before]) if r[3]}


def shingles(text):
    found = brute.WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(found[i : i + 5]) for i in range(max(1, len(found) - 4))) if found else frozenset()


def test_near_copies_by_jaccard(steps):
    """One document of each component of similarity 0.8, judged on all pairs of shingle sets that share a shingle."""
    _, before, after, _ = steps[2]
    sets = {r["doc_id"]: shingles(r["text"]) for r in before}
    holders, parent = defaultdict(list), {d: d for d in sets}

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d

    for d, own in sorted(sets.items()):
        shared = Counter(other for s in own or [None] for other in holders[s])
        for other, n in shared.items():
            if not own or n * 5 >= 4 * (len(own) + len(sets[other]) - n):
                low, high = sorted((root(d), root(other)))
                parent[high] = low
        for s in own or [None]:
            holders[s].append(d)
    assert {r["doc_id"] for r in after} == {root(d) for d in sets}


def test_mixing_stage(steps):
    """Every document is taken its source's ratio of times, rounded down or up, and sources come near their targets."""
    _, before, after, _ = steps[3]
    size = {r["doc_id"]: len(brute.WORD.findall(r["text"] or "")) for r in before}
    total, taken, largest = Counter(), Counter(), Counter()
    for r in before:
        total[r["source"]] += size[r["doc_id"]]
        largest[r["source"]] = max(largest[r["source"]], size[r["doc_id"]])
    goal, copies = brute.targets(total), Counter(r["doc_id"] for r in after)
    for r in before:
        ratio = goal[r["source"]] / total[r["source"]]
        assert math.floor(ratio) <= copies[r["doc_id"]] <= math.ceil(ratio) <= 3
        taken[r["source"]] += copies[r["doc_id"]] * size[r["doc_id"]]
    for source in total:
        assert abs(taken[source] - goal[source]) <= largest[source]


def test_last_stage_and_run(spark, steps):
    _, before, after, _ = steps[4]
    assert sorted(r["doc_id"] for r in after) == sorted(r["doc_id"] for r in before)
    whole = corpus_pipeline.run(spark, FOLDER)
    assert sorted(map(str, whole.collect())) == sorted(map(str, after))


def test_clashing_names_and_repeated_rows(spark):
    """Columns named like working columns come back untouched, and of rows that repeat wholly one stays."""
    names = ["row", "row_", "key", "component", "head", "times", "kept", "kept_id", "kept_source", "kept_copies", "copies", "size", "a.b"]
    values = [(d, f"{brute.words(d or 0, 30)} {'x' * (d or 0)}", "s") for d in (1, 2, 3, None) for _ in range(3)]
    rows = [(*v, *[f"{n}{i}" for n in names]) for i, v in enumerate(values)] + [(*values[0], *[f"{n}0" for n in names])] * 2
    docs = spark.createDataFrame(rows, ", ".join(["doc_id bigint", "text string", "source string", *[f"`{n}` string" for n in names]]))
    for stage in (corpus_pipeline.drop_exact_copies, corpus_pipeline.drop_near_copies):
        out = stage(spark, docs, FOLDER)
        assert out.columns == docs.columns
        found = out.collect()
        assert sorted(str(r["doc_id"]) for r in found) == ["1", "2", "3", "None"]
        assert {tuple(r) for r in found} <= set(rows)
    out = corpus_pipeline.mix_sources(spark, docs, FOLDER).collect()
    assert Counter(map(tuple, out)) == Counter(rows)  # one source takes all of itself


def test_awkward_documents(spark, odd, nothing):
    for docs in (odd, nothing):
        for _, stage in corpus_pipeline.STAGES:
            columns = docs.columns
            docs = stage(spark, docs, FOLDER).persist()
        assert docs.count() <= odd.count() * 3
        assert columns == odd.columns
