"""The registered classifiers on a whole table, against slow versions written from their definitions."""

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow.parquet as pq

from gridcalc.llm import labelled, quality, queries, toxicity

SF_DIR = "/root/testdata/sf0.001"


def tables(label):
    read = lambda name, columns: zip(*(c.to_pylist() for c in pq.read_table(f"{SF_DIR}/{name}.parquet", columns=columns).columns), strict=True)
    docs = dict(read("documents", ["doc_id", "text"]))
    labels = {d: y for d, y in read("labels", ["doc_id", label]) if y in (0, 1)}
    return docs, labels


def held(d, modulus, remainder):
    return zlib.crc32(str(d).encode()) % modulus == remainder


def test_quality_votes(spark):
    docs, labels = tables("quality")
    train = [(d, y) for d, y in labels.items() if not held(d, 4, 2)]
    assert max(sum(y == c for _, y in train) for c in (0, 1)) <= quality.PER_CLASS
    prior = sum(y for _, y in train) / len(train)
    train = [(d, y) for d, y in train if d in docs]
    terms = quality.Terms()
    x = np.array([terms.vector(docs[d] or "").astype("<f2") for d, _ in train], float)
    y = np.array([y for _, y in train])
    idf = np.log((1 + len(x)) / (1 + (x > 0).sum(0))) + 1
    directions = np.linalg.svd(x * idf, full_matrices=False)[2][: quality.LATENT].T
    known = (x * idf) @ directions
    known /= np.maximum(np.linalg.norm(known, axis=1, keepdims=True), 1e-300)
    weight = np.where(y == 1, prior / y.mean(), (1 - prior) / (1 - y.mean()))
    wrong = 0
    got = queries.op3_quality(spark, SF_DIR).collect()
    assert sorted(r.doc_id for r in got) == sorted(docs)
    for r in got:
        assert r.held_out == held(r.doc_id, 4, 2) and r.predicted == int(r.score >= 0.7)
        v = (terms.vector(docs[r.doc_id] or "") * idf) @ directions
        cosine = known @ v / max(np.linalg.norm(v), 1e-300)
        near = sorted(range(len(known)), key=lambda i: -cosine[i])[: quality.NEIGHBOURS]
        votes = [max(cosine[i], 0) ** 8 * weight[i] for i in near]
        want = sum(w * y[i] for w, i in zip(votes, near, strict=True)) / sum(votes) if sum(votes) > 0 else prior
        wrong += abs(want - r.score) > 1e-3
    assert wrong <= 2  # ties for the last neighbour


class Spelling:
    """Interpolated Kneser-Ney over letters, by its recursive definition."""

    def __init__(self, counts, shared, floor, order=toxicity.ORDER, discount=0.75):
        self.shared, self.floor, self.order, self.discount = shared, floor, order, discount
        self.after = defaultdict(Counter)  # context -> letter -> count, continuation counts below the highest order
        grams = Counter()
        for w, n in counts.items():
            s = f"^{w}$"
            for i in range(1, len(s)):
                k = min(order, i + 1)
                grams[s[i + 1 - k : i + 1]] += n
        for k in range(order, 2, -1):
            for g in [g for g in grams if len(g) == k]:
                grams[g[1:]] += 1
        for g, n in grams.items():
            self.after[g[:-1]][g[-1]] += n

    def p(self, letter, context):
        if not context:
            return self.shared.get(letter, self.floor)
        lower = self.p(letter, context[1:])
        if context not in self.after:
            return lower
        x, total = self.after[context], sum(self.after[context].values())
        return max(x[letter] - self.discount, 0) / total + self.discount * len(x) / total * lower if x[letter] else self.discount * len(x) / total * lower

    def log_p(self, word):
        s = f"^{word}$"
        return sum(math.log(self.p(s[i], s[max(0, i + 1 - self.order) : i])) for i in range(1, len(s)))


def test_toxicity_by_two_spellings(spark):
    docs, labels = tables("toxic")
    train = [(d, y) for d, y in labels.items() if not held(d, 3, 1) and d in docs]
    assert max(sum(y == c for _, y in train) for c in (0, 1)) <= toxicity.PER_CLASS
    counts = {c: sum((Counter(toxicity.words(docs[d] or "")) for d, y in train if y == c), Counter()) for c in (0, 1)}
    shared = toxicity.shared_letters(counts[0] + counts[1])
    floor = min(shared.values()) / 10
    toxic, plain = (Spelling(counts[c], shared, floor) for c in (1, 0))
    model = toxicity.fit(spark, spark.read.parquet(f"{SF_DIR}/documents.parquet"), spark.read.parquet(f"{SF_DIR}/labels.parquet"))
    memo = {}

    def ratio(w):
        if w not in memo:
            memo[w] = min(toxicity.MOST, max(toxicity.LEAST, toxic.log_p(w) - plain.log_p(w)))
        return memo[w]

    got = {r.doc_id: r for r in queries.op8_toxicity(spark, SF_DIR).collect()}
    assert sorted(got) == sorted(docs)
    for d in sorted(docs, key=lambda d: len(docs[d] or ""))[:60]:
        r, evidence = sorted(map(ratio, toxicity.words(docs[d] or "")), reverse=True), np.zeros(3)
        if r:
            top = r[: max(2, math.ceil(toxicity.STRONGEST * len(r)))]
            evidence = np.array([5 * sum(r) / len(r), sum(top) / len(top), sum(r[:2]) / len(r[:2])])
        want = labelled.sigmoid(evidence @ model.weights[:-1] + model.weights[-1])
        assert abs(want - got[d].score) < 1e-9
        assert got[d].held_out == held(d, 3, 1) and got[d].predicted == int(got[d].score >= 0.7)


def test_repeated_rows_ties_very_long_texts_and_clashing_columns(spark):
    docs, _ = tables("toxic")
    long = " ".join(str(t) for t in docs.values())
    rows = [(1, long, "x"), (1, long, "y"), (2, "A" * 200_000, "z"), (3, None, "w"), (None, "", "v")]
    df = spark.createDataFrame(rows, "doc_id long, text string, score string").withColumnsRenamed({"score": "held_out"})
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet")
    for scored, model in ((quality.scored, quality.fit), (toxicity.scored, toxicity.fit)):
        fitted = model(spark, spark.read.parquet(f"{SF_DIR}/documents.parquet"), labels)
        got = scored(spark, df, fitted).collect()
        assert len(got) == 5 and len({r.score for r in got if r.doc_id == 1}) == 1
        assert {r.score for r in got if r.doc_id == 3} == {r.score for r in got if r.doc_id is None}
        assert all(0 <= r.score <= 1 for r in got)
