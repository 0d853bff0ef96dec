import numpy as np
import pytest
import xxhash

from gridcalc.llm import simhash


def brute(docs):
    """fingerprint and component per row, from the definition."""
    fps = []
    for _, text in docs:
        w = (text or "").encode().lower().split()
        sh = [b" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
        h = [xxhash.xxh64_intdigest(s, 42) for s in sh]
        fps.append(sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h)))
    comp = list(range(len(docs)))
    for i in range(len(docs)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4 and docs[i][0] is not None and docs[j][0] is not None:
                a, b = comp[i], comp[j]
                comp = [b if c == a else c for c in comp]
    low = {}
    for (d, _), c in zip(docs, comp, strict=True):
        if d is not None:
            low[c] = min(low.get(c, d), d)
    return sorted(((d, f"{f:016x}", low[c] if d is not None else None) for (d, _), f, c in zip(docs, fps, comp, strict=True)), key=str)


def made(seed, n):
    rng = np.random.default_rng(seed)
    words = [f"w{i}" for i in range(300)]
    base = [" ".join(rng.choice(words, 120)) for _ in range(5)]
    docs = []
    for i in range(n):
        w = base[rng.integers(5)].split()
        for _ in range(rng.integers(0, 3)):
            w[rng.integers(len(w))] = "X" + str(rng.integers(50))
        docs.append((i, " ".join(w)))
    return docs


@pytest.mark.parametrize("docs", [
    made(1, 150) + [(900, None), (901, ""), (902, " \n"), (903, "One two"), (904, "one TWO"), (None, "one two"), (None, None), (0, "a b c d e f")],
    [(3, "Ä b c d"), (2, "Ä b c d"), (1, "x y\x0bz")],
    [(i, "same text of six words here") for i in range(400)] + [(1000, "z " * 30000)],
])
def test_equals_brute_force(spark, docs):
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in docs], "doc_id long, text string, fp string, u int")
    got = sorted((tuple(r) for r in simhash.near_duplicates(spark, df).collect()), key=str)
    assert got == brute(docs)


def test_empty_table(spark):
    assert simhash.near_duplicates(spark, spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_large_bucket_joins_as_all_pairs_do():
    rng = np.random.default_rng(0)
    centres = rng.integers(0, 2**63, 3, dtype=np.uint64)
    fps = np.unique(np.concatenate([c ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 37, (1500, 3), dtype=np.uint64), axis=1) for c in centres]))
    assert len(fps) > simhash.PAIRWISE
    from gridcalc.llm.components import local_roots

    a, b = simhash.bucket_links(fps, 4)
    assert (np.bitwise_count(fps[a] ^ fps[b]) <= 4).all()
    x, y = np.nonzero(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 4)
    assert (local_roots(len(fps), a, b) == local_roots(len(fps), x, y)).all()


def test_block_masks_cover_every_pair():
    masks = simhash.block_masks(4, 3)
    rng = np.random.default_rng(3)
    for _ in range(500):
        flip = sum(1 << int(b) for b in set(rng.integers(0, 64, 4)))
        assert any(m & flip == 0 for m in masks)
