"""Toxicity by two Kneser-Ney models, one of toxic and one of ordinary text.

Each model spells words letter by letter, with contexts of up to five letters; the highest order has counts, lower ones
continuation counts, all interpolated with absolute discounts. Both models end in one shared order of letter
continuation counts, so that rare expressions are smoothed alike. A word's evidence is the log-likelihood ratio of the
two spellings. A text's evidence is length-normalised: means over its words, of the whole text and of its strongest
words, which a logistic regression, fitted across folds, turns into a probability.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridcalc.llm import labelled
from gridcalc.llm.common import bytes_of, kept, text_slices

#: Examples of each class at most: a classifier's fit on a bounded sample.
PER_CLASS = 1500
ORDER = 6
FOLDS = 3
#: A word's evidence is kept between these, so that no single odd word decides.
LEAST, MOST = -1.0, 6.0
#: The share of a text's words that its strongest passage takes, two at least.
STRONGEST = 0.015
MEANS = 3
CACHE_WORDS = 400_000
_words = regex.compile(r"[\p{L}\p{M}\p{N}]+").findall


def words(text: str) -> list[str]:
    return _words(text.lower())


class KneserNey:
    """Interpolated Kneser-Ney letter counts of words: for each order, discounted shares and backoff weights."""

    def __init__(self, counts: Counter[str], order: int = ORDER, discount: float = 0.75):
        self.order = order
        grams: list[dict[str, int]] = [defaultdict(int) for _ in range(order + 1)]
        for word, n in counts.items():
            s = f"^{word}$"
            for i in range(1, len(s)):
                # contexts cut short by the word's start have counts, as the highest order does
                k = min(order, i + 1)
                grams[k][s[i + 1 - k : i + 1]] += n
        for k in range(order, 2, -1):  # continuation counts: distinct letters to the left
            lower = grams[k - 1]
            for g in grams[k]:
                lower[g[1:]] += 1
        self.shares: list[dict[str, float]] = [{} for _ in range(order + 1)]
        self.back: list[dict[str, float]] = [{} for _ in range(order + 1)]
        for k in range(2, order + 1):
            total, kinds = defaultdict(int), defaultdict(int)
            for g, n in grams[k].items():
                total[g[:-1]] += n
                kinds[g[:-1]] += 1
            self.shares[k] = {g: (n - discount) / total[g[:-1]] for g, n in grams[k].items()}
            self.back[k] = {h: discount * kinds[h] / total[h] for h in total}
            grams[k] = {}

    def log_likelihood(self, word: str, shared: dict[str, float], floor: float) -> float:
        """Natural logarithm of the word's probability, letter by letter; contexts never seen pass to shorter ones."""
        s, out = f"^{word}$", 0.0
        for i in range(1, len(s)):
            p = shared.get(s[i], floor)
            for k in range(2, min(self.order, i + 1) + 1):
                g = s[i + 1 - k : i + 1]
                p = self.shares[k].get(g, 0.0) + self.back[k].get(g[:-1], 1.0) * p
            out += math.log(p)
        return out


def ratios(a: KneserNey, b: KneserNey, shared: dict[str, float], floor: float) -> tuple[list[dict[str, float]], list[dict[str, float]]]:
    """For each order, the log ratio of the two models' probabilities of every run of letters that one of them has seen,
    and of their backoff weights: all that a word's log-likelihood ratio takes."""
    found: list[dict[str, float]] = [{} for _ in range(a.order + 1)]
    weights: list[dict[str, float]] = [{} for _ in range(a.order + 1)]
    low: dict[str, tuple[float, float]] = {}
    for k in range(2, a.order + 1):
        now = {}
        sa, sb, ba, bb = a.shares[k], b.shares[k], a.back[k], b.back[k]
        for g in sa.keys() | sb.keys():
            if k == 2:
                pa = pb = shared.get(g[1], floor)
            else:
                pa, pb = low[g[1:]]
            h = g[:-1]
            pair = sa.get(g, 0.0) + ba.get(h, 1.0) * pa, sb.get(g, 0.0) + bb.get(h, 1.0) * pb
            now[g] = pair
            found[k][g] = math.log(pair[0] / pair[1])
        for h in ba.keys() | bb.keys():
            weights[k][h] = math.log(ba.get(h, 1.0) / bb.get(h, 1.0))
        low = now
    return found, weights


def shared_letters(counts: Counter[str]) -> dict[str, float]:
    """Letter probabilities by continuation counts (distinct letters before) over both classes, one added."""
    pairs = {(s[i], s[i + 1]) for w in counts for s in (f"^{w}$",) for i in range(len(s) - 1)}
    after = Counter(b for _, b in pairs)
    total = sum(after.values()) + len(after) + 1
    return {c: (n + 1) / total for c, n in after.items()}


class Model:
    """Two Kneser-Ney models and the weights that make a probability of their evidence."""

    def __init__(self, toxic: Counter[str], ordinary: Counter[str]):
        shared = shared_letters(toxic + ordinary)
        self.found, self.back = ratios(KneserNey(toxic), KneserNey(ordinary), shared, min(shared.values(), default=1.0) / 10)
        self.known: dict[str, float] = {}
        self.weights = np.zeros(MEANS + 1)

    def ratio(self, word: str) -> float:
        """Log-likelihood ratio of the word's two spellings."""
        s, out, found, back = f"^{word}$", 0.0, self.found, self.back
        for i in range(1, len(s)):
            for k in range(min(ORDER, i + 1), 1, -1):
                g = s[i + 1 - k : i + 1]
                r = found[k].get(g)
                if r is not None:
                    out += r
                    break
                out += back[k].get(g[:-1], 0.0)
        return out

    def evidence(self, text: str) -> np.ndarray:
        """Mean log-likelihood ratios a word: of the whole text, of its strongest words, and of its two strongest; zeros without words."""
        w = words(text)
        if not w:
            return np.zeros(MEANS)
        known = self.known
        if len(known) > CACHE_WORDS:
            known.clear()
        for x in set(w).difference(known):
            known[x] = min(MOST, max(LEAST, self.ratio(x)))
        ratio = np.fromiter(map(known.__getitem__, w), float, len(w))
        ranked = np.sort(ratio)[::-1]
        return np.array([5 * ratio.mean(), ranked[: max(2, math.ceil(STRONGEST * len(w)))].mean(), ranked[:2].mean()])

    def score(self, evidence: np.ndarray) -> np.ndarray:
        return labelled.sigmoid(evidence @ self.weights[:-1] + self.weights[-1])


def _counted(rows: DataFrame) -> DataFrame:
    """(label, fold, word, n) of labelled texts."""
    schema = pa.schema([("label", pa.int32()), ("fold", pa.int32()), ("word", pa.string()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, 2):
            counts: dict[tuple[int, int], Counter] = defaultdict(Counter)
            for label, fold, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                counts[label, fold].update(words(text))
            found = [(a, b, w, n) for (a, b), c in counts.items() for w, n in c.items()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), schema.types, strict=True)] if found else [pa.array([], t) for t in schema.types], schema=schema)

    return rows.select("label", "fold", "text").mapInArrow(run, "label int, fold int, word string, n long").groupBy("label", "fold", "word").agg(F.sum("n").alias("n"))


def fit(spark: SparkSession, documents: DataFrame, labels: DataFrame, modulus: int = 3, held: int = 1, per_class: int = PER_CLASS) -> Model:
    """Trains on at most ``per_class`` documents of each class outside the held-out remainder."""
    from gridcalc.llm.common import written

    rows = labelled.sample(documents, labels, "toxic", modulus, held, per_class)
    rows = written(spark, rows.withColumn("fold", (F.pmod(F.xxhash64(F.col("doc_id") + 1), F.lit(FOLDS))).cast("int")), "toxic-sample")
    counts = {(c, k): Counter() for c in (0, 1) for k in range(FOLDS)}
    table = _counted(rows).toArrow()  # the words of a bounded sample
    for batch in table.to_batches(50_000):
        for label, fold, word, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            counts[label, fold][word] = n
    del table
    others = lambda c, k: sum((counts[c, j] for j in range(FOLDS) if j != k), Counter())
    schema = pa.schema([("label", pa.int32()), ("evidence", pa.list_(pa.float64()))])
    got = []
    for k in range(FOLDS):  # one model of a bounded sample at a time
        known = spark.sparkContext.broadcast(Model(others(1, k), others(0, k)))

        def run(batches: Iterator[pa.RecordBatch], known=known) -> Iterator[pa.RecordBatch]:
            for batch in text_slices(batches, 1):
                label, text = (c.to_pylist() for c in batch.columns)
                yield pa.RecordBatch.from_arrays([pa.array(label, pa.int32()), pa.array([known.value.evidence(t).tolist() for t in text], schema.types[1])], schema=schema)

        got += rows.where(F.col("fold") == k).select("label", "text").mapInArrow(run, "label int, evidence array<double>").collect()  # a row an example
        known.destroy()
    model = Model(others(1, None), others(0, None))
    y = np.array([r.label for r in got], float)
    if len(got) and 0 < y.mean() < 1:
        prior = min(max(labelled.share(labels, "toxic", modulus, held), 1e-3), 1 - 1e-3)
        weight = np.where(y == 1, prior / y.mean(), (1 - prior) / (1 - y.mean()))
        model.weights = labelled.logistic(np.array([r.evidence for r in got]), y, weight)
    else:
        model.weights[-1] = 30.0 if len(got) and y.mean() == 1 else -30.0 if len(got) else 0.0
    return model


def scored(spark: SparkSession, documents: DataFrame, model: Model, modulus: int = 3, held: int = 1, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted per row of ``documents``.

    Null texts count as empty and are scored by the intercept alone; a null doc_id is not held out. Without labels, or
    with labels of one class only, every text has one score.
    """
    known = spark.sparkContext.broadcast(model)
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = known.value
        for batch in text_slices(batches, 2):
            evidence = np.array([own.evidence(t.decode()) for t in bytes_of(batch.column(2))])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(own.score(evidence))], schema=schema)

    rows = documents.select(F.col("doc_id").cast("long"), F.coalesce(labelled.remainder("doc_id", modulus) == held, F.lit(False)).alias("held_out"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double").withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def toxicity(spark: SparkSession, documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Fits on the labelled rows that are not held out and scores every whole text."""
    return scored(spark, documents, fit(spark, documents, labels))


def accepted(spark: SparkSession, documents: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """The rows of ``documents`` that score below ``threshold``, with all their columns."""
    known = spark.sparkContext.broadcast(model)
    return kept(documents, lambda: lambda texts: known.value.score(np.array([known.value.evidence(t.decode()) for t in texts])) < threshold)
