import random

from gridcalc.llm import decontaminate


def least_edits(item, text):
    """Sellers' recursion: the least edit distance of an item to any stretch of a text."""
    row = [0] * (len(text) + 1)
    for i, w in enumerate(item, 1):
        last, row = row, [i]
        for j, x in enumerate(text, 1):
            row.append(min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (w != x)))
    return min(row)


def test_matches_are_all_pairs_within_reach(spark):
    """Substitutions, insertions and deletions up to and beyond the limit, against every pair's distance."""
    rng = random.Random(11)
    word = lambda: f"w{rng.randrange(150)}"
    items = [(i, [word() for _ in range(rng.choice([8, 10, 13, 25, 40]))]) for i in range(12)]
    docs = []
    for k in range(70):
        w = list(rng.choice(items)[1])
        for _ in range(rng.randrange(0, int(0.25 * len(w)) + 2)):
            at, how = rng.randrange(len(w)), rng.randrange(3)
            w[at : at + 1] = [] if how == 0 else [word()] if how == 1 else [w[at], word()]
        docs.append((k, [word() for _ in range(rng.randrange(25))] + w + [word() for _ in range(rng.randrange(25))]))
    docs += [(100, docs[0][1]), (101, docs[0][1] * 3)]
    want = {}
    for d, text in docs:
        for i, item in items:
            if (cost := least_edits(item, text)) <= int(0.2 * len(item) + 1e-9):
                want[d, i] = cost
    df = spark.createDataFrame([(d, " ".join(t)) for d, t in docs], "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(t)) for i, t in items], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.distance for r in decontaminate.matches(spark, df, bench).collect()}
    assert len(want) > 40
    assert got.keys() <= want.keys()
    assert len(got) >= 0.98 * len(want)
    assert sum(got[k] == want[k] for k in got) >= 0.98 * len(got)
