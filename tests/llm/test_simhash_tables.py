import random

import corpus_pipeline
import numpy as np
import pytest

from gridcalc.llm import shingle_sets, simhash_tables
from gridcalc.llm.components import local_roots


def hashes(rng, n):
    return np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))


def near(rng, threshold, common):
    """Two sets at the threshold or just above it."""
    own = hashes(rng, int(common / threshold + 1e-9) - common)
    shared, cut = hashes(rng, common), rng.integers(len(own) + 1)
    return np.sort(np.r_[shared, own[:cut]]), np.sort(np.r_[shared, own[cut:]])


def test_stage_drops_only_what_simhash_links(spark, monkeypatch):
    """Near copies are found by way of fingerprints: without their links only equal shingle sets are left to one."""
    rng = random.Random(3)
    base = [f"b{rng.randrange(9999)}" for _ in range(200)]
    other = [*base[:100], "changed", *base[101:]]
    df = spark.createDataFrame([(1, " ".join(base)), (2, " ".join(other)), (3, " ".join(base).upper())], "doc_id long, text string")
    kept = lambda: sorted(r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, df, "").collect())
    assert kept() == [1]
    monkeypatch.setattr(shingle_sets, "links", lambda spark, prints, threshold: spark.createDataFrame([], "u long, v long"))
    assert kept() == [1, 2]


@pytest.mark.parametrize("n", [0, 1, 4, 255, 256, 4500])
def test_fingerprint_by_definition(n):
    own = hashes(np.random.default_rng(n), n)
    votes = simhash_tables._mixed(own[:, None] + simhash_tables._SALTS)
    want = [sum(1 << b for b in range(64) if 2 * int((votes[:, w] >> np.uint64(b) & np.uint64(1)).sum()) > n) for w in range(simhash_tables.WORDS)]
    assert simhash_tables.wide_fingerprint(own).tolist() == want


def test_bits_agree_as_often_as_counted():
    rng = np.random.default_rng(1)
    for common, a, b in ((4, 1, 0), (12, 2, 1), (80, 10, 10)):
        same = []
        for _ in range(100):
            x = hashes(rng, common + a + b)
            f, g = (simhash_tables.wide_fingerprint(y) for y in (x[: common + a], np.r_[x[:common], x[common + a :]]))
            same.append(1 - np.bitwise_count(f ^ g).sum() / (64 * simhash_tables.WORDS))
        assert abs(np.mean(same) - simhash_tables.agreement(common, a, b)) < 0.006
    least = [simhash_tables.least_agreement(0.8, k) for k in (1, simhash_tables.SMALL)]
    assert least == [0.8125, simhash_tables.agreement(12, 2, 1)]
    for common in (60, 100, 200):
        both = common // 4
        assert min(simhash_tables.agreement(common, both - b, b) for b in range(0, both + 1, 5)) > least[1]


def test_tables_join_pairs_at_the_threshold(spark):
    """Pairs at 0.8, small sets among them, meet in tables of ten bits, and sets of no pair stay alone."""
    rng = np.random.default_rng(7)
    pairs = [near(rng, 0.8, 4 * int(c)) for c in [1] * 150 + [2, 3, 4, 5] * 50 + rng.integers(6, 60, 150).tolist()]
    sets = [s for pair in pairs for s in pair]
    rows = [(i, len(s), simhash_tables.wide_fingerprint(s).view(np.int64).tolist()) for i, s in enumerate(sets)]
    prints = spark.createDataFrame(rows, "sid long, n int, words array<long>")
    got = {(r.u, r.v) for r in simhash_tables.links(spark, prints, 0.8, bits=10).collect()}
    missing = [k for k in range(len(pairs)) if (2 * k + 1, 2 * k) not in got and (2 * k, 2 * k + 1) not in got]
    assert not missing
    assert sum(u // 2 != v // 2 for u, v in got) == 0


def test_groups_by_tables_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(simhash_tables, "BUCKET", 16)
    rng = random.Random(9)
    word = lambda: f"w{rng.randrange(3000)}"
    docs = []
    for _ in range(40):
        base = [word() for _ in range(rng.randrange(9, 150))]
        for _ in range(4):
            w = list(base)
            for _ in range(rng.randrange(0, max(2, len(w) // 35))):
                w[rng.randrange(len(w))] = word()
            docs.append(" ".join(w))
    sets = [frozenset(tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)) for t in docs]
    x, y = np.array([(i, j) for i in range(len(docs)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]).T
    want = local_roots(len(docs), x, y)
    assert 45 < len(set(want.tolist())) < 130
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(docs)], "key string, text string")
    got = {int(r.key): r.root for r in shingle_sets.roots(spark, df).collect()}
    assert len(set(zip(want.tolist(), (got[i] for i in range(len(docs))), strict=True))) == len(set(got.values())) == len(set(want.tolist()))


def test_large_bucket_joins_as_all_pairs_do(monkeypatch):
    rng = np.random.default_rng(0)
    flip = lambda k: np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, (k, 4, 12), dtype=np.uint64), axis=2)
    words = np.concatenate([c ^ flip(60) for c in rng.integers(0, 2**63, (50, 4), dtype=np.uint64)] + [rng.integers(0, 2**63, (200, 4), dtype=np.uint64)])
    x, y = np.nonzero(simhash_tables.apart(words[:, None], words[None, :]) <= 71)
    want = local_roots(len(words), x, y)
    assert len(words) > simhash_tables.BUCKET and 2 < len(set(want.tolist())) < len(words)
    assert (simhash_tables.bucket_roots(words, 71) == want).all()


def test_forest_skips_pairs_that_fingerprints_tell_apart():
    a, b = np.arange(10), np.arange(1, 10)
    part, asks = np.array([5, 7]), np.array([False, True])
    alike = np.zeros((2, simhash_tables.WORDS), np.uint64)
    assert shingle_sets.forest(part, asks, [a, b], 0.8, alike) == [(1, 0)]
    alike[1, :2] = ~alike[1, :2]
    assert shingle_sets.forest(part, asks, [a, b], 0.8, alike) == []
