import random

import corpus_pipeline
import numpy as np

from gridcalc.llm import shingle_sets


def shingles(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def test_stage_links_all_from_a_similarity_of_08(spark):
    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(5000)}"
    docs = []
    for _ in range(25):
        base = [word() for _ in range(rng.randrange(100, 400))]
        docs.append(" ".join(base))
        for _ in range(3):
            w = list(base)
            for _ in range(rng.randrange(1, max(2, len(w) // 30))):
                w[rng.randrange(len(w))] = word()
            docs.append(" ".join(w))
    docs += ["", "one two", "ONE  two", ""]
    sets = [shingles(t) for t in docs]
    root = list(range(len(docs)))
    similar = 0
    for i in range(len(docs)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                similar += 1
                a, b = sorted((root[i], root[j]))
                root = [a if r == b else r for r in root]
    assert similar > 30
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(docs)] + [(None, docs[0], "y")], "doc_id long, text string, root string")
    got = corpus_pipeline.drop_near_duplicates(spark, df, "")
    assert got.columns == df.columns
    assert sorted(r.doc_id for r in got.where("doc_id is not null").collect()) == [i for i, r in enumerate(root) if i == r]
    assert got.where("doc_id is null").count() == 1


def test_parts_joined_across_blocks_as_by_all_pairs(spark, monkeypatch):
    """Copies of one passage with changes of their own: many components a bucket, compared by blocks of a few members."""
    rng = random.Random(11)
    base = [f"b{k}" for k in range(60)]
    docs = []
    for _ in range(120):
        w = list(base)
        for _ in range(rng.randrange(1, 6)):
            w[rng.randrange(25, 60)] = f"w{rng.randrange(9)}"
        docs.append(" ".join(w))
    docs = sorted(set(docs))
    sets = [shingles(t) for t in docs]
    root = list(range(len(docs)))
    for i in range(len(docs)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = sorted((root[i], root[j]))
                root = [a if r == b else r for r in root]
    assert 2 < len(set(root)) < len(docs)
    df = spark.createDataFrame(list(enumerate(docs)), "key string, text string")
    groups = lambda pairs: sorted(sorted(k for k, r in pairs if r == x) for x in {r for _, r in pairs})
    want = groups([(str(k), r) for k, r in enumerate(root)])
    assert groups([tuple(r) for r in shingle_sets.roots(spark, df).collect()]) == want
    monkeypatch.setattr(shingle_sets, "BLOCK_ROWS", 7)
    assert groups([tuple(r) for r in shingle_sets.roots(spark, df).collect()]) == want


def test_forest_compares_asking_sets_of_other_parts_only():
    a, b, c = np.arange(10), np.arange(1, 10), np.arange(50, 60)
    part, asks = np.array([5, 5, 5, 7, 9]), np.array([False, False, True, True, True])
    assert shingle_sets.forest(part, asks, [a, c, a, b, c], 0.8) == [(3, 0), (4, 1)]
    assert shingle_sets.forest(part[2:], asks[2:], [a, b, c], 0.8) == []
