import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from gridcalc.llm import katz


def brute(docs, order, modulus=7, held=2):
    mark = lambda d: d is not None and zlib.crc32(str(d).encode()) % modulus == held
    words = lambda t: (t or "").encode().lower().split()
    uni, after = Counter(), defaultdict(Counter)  # context (tuple) -> next words
    for d, t in docs:
        if not mark(d):
            w = [*words(t), "END"]
            uni.update(w)
            padded = ["BEGIN"] * (order - 1) + w
            for i in range(order - 1, len(padded)):
                for k in range(1, order):
                    after[tuple(padded[i - k : i])][padded[i]] += 1
    n, v = sum(uni.values()), len(uni)

    def counts(values):
        return np.bincount(np.minimum(list(values), katz.FITTED + 1), minlength=katz.FITTED + 2).astype(float) if values else np.zeros(katz.FITTED + 2)

    model = katz.Unigrams(counts(list(uni.values())), n)
    d = {k: katz.discounts(counts([c for h, x in after.items() if len(h) == k - 1 for c in x.values()])) for k in range(2, order + 1)}
    vocabulary = [*uni, "never seen"]
    memo = {}

    def p(w, h):
        if not h:
            return float(model.p(np.array([uni[w]]))[0])
        if h not in after:
            return p(w, h[1:])
        if h not in memo:
            x, c, dk = after[h], sum(after[h].values()), d[len(h) + 1]
            direct = {w: (dk[k] if k <= katz.SMALL else 1) * k / c for w, k in x.items()}
            left = 1 - sum(direct.values())
            if left <= 1e-9 / c:
                direct = {w: q * (c - 0.5) / c / sum(direct.values()) for w, q in direct.items()}
                left = 0.5 / c
            memo[h] = direct, left / (1 - sum(p(w, h[1:]) for w in x))
            assert abs(sum(p(w, h) for w in vocabulary) - 1) < 1e-9
        direct, alpha = memo[h]
        return direct[w] if w in direct else alpha * p(w, h[1:])

    out = []
    for doc, t in docs:
        w = [*words(t), "END"]
        padded = ["BEGIN"] * (order - 1) + w
        score = sum(math.log10(p(x, tuple(padded[i : i + order - 1]))) for i, x in enumerate(w))
        out.append((doc, mark(doc), len(w), sum(uni[x] > 0 for x in w), n, sum(math.log10((uni[x] + 1) / (n + v + 1)) for x in w), score))
    return sorted(out, key=str)


@pytest.mark.parametrize(("order", "hot", "chunk"), [(3, 10**6, 3_000_000), (3, 12, 300), (3, 2, 3_000_000), (2, 12, 300), (4, 9, 500)])
def test_equals_brute_force(spark, monkeypatch, order, hot, chunk):
    """With few, some and most contexts dealt by their next word."""
    monkeypatch.setattr(katz, "HOT_TOKENS", hot)
    monkeypatch.setattr(katz, "CHUNK_TOKENS", chunk)
    rng = np.random.default_rng(0)
    p = 1 / np.arange(1, 60)
    docs = [(i, " ".join("W%d" % x for x in rng.choice(59, rng.integers(0, 40), p=p / p.sum()))) for i in range(120)]
    docs += [(500, None), (501, ""), (None, "w1 w2"), (7, "w1  W2\tw3"), (7, "w1  W2\tw3"), (502, "new words only"), (503, "w1 " * 3000)]
    df = spark.createDataFrame([(d, t, "x") for d, t in docs], "doc_id long, text string, chunk string").repartition(3)
    got = sorted((tuple(r) for r in katz.score(spark, df, order=order).collect()), key=str)
    want = brute(docs, order)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert np.allclose([g[5:] for g in got], [w[5:] for w in want])


def test_good_turing_where_counts_allow_and_smoothed_where_not():
    n = np.array([0, 1000, 300, 120, 60, 35, 22] + [0] * 19, float)
    d = katz.discounts(n)
    tail = 6 * n[6] / n[1]
    assert np.allclose(d[1:], [((r + 1) * n[r + 1] / n[r] / r - tail) / (1 - tail) for r in range(1, 6)])
    n[4] = 140  # more kinds seen four times than three: no factor below one
    d = katz.discounts(n)
    assert (np.diff(d[1:]) > 0).all() and 0 < d[1] and d[5] < 1
    assert not np.allclose(d[1:], [(r - 0.5) / r for r in range(1, 6)])
    assert np.allclose(katz.discounts(np.zeros(26))[1:], [(r - 0.5) / r for r in range(1, 6)])


def test_packed_arrays_come_back():
    arrays = [np.array([2**63, 5], np.uint64), np.array([], np.int64), np.array([0, 255]), np.array([3, 70000]), np.array([2**40, 1])]
    for a, b in zip(arrays, katz.unpack(katz.pack(*arrays)), strict=True):
        assert (a == b).all() and len(a) == len(b)


def test_nothing_to_learn_from(spark):
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    r = katz.score(spark, spark.createDataFrame([(held, "a b")], "doc_id long, text string")).first()
    assert (r.n_known, r.train_tokens, r.score) == (0, 0, 0.0)
    assert katz.score(spark, spark.createDataFrame([], "doc_id long, text string")).collect() == []
