"""Quality by nearest-neighbour voting over latent-semantic vectors of a text's form.

Terms are the shapes of words (letters, cases, digits, signs), pairs of neighbouring shapes, repeated words and word
lengths, hashed to TERMS places. Log counts times inverse document frequency, projected on the leading singular
directions of the labelled sample, give a vector. The labelled vectors are broadcast; each document's cosines with all
of them are exact, in blocks, and its nearest neighbours vote with weights by similarity.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridcalc.llm import labelled
from gridcalc.llm.common import bytes_of, kept, text_slices

#: Examples of each class at most: a classifier's fit on a bounded sample.
PER_CLASS = 2000
TERMS = 1024
LATENT = 48
NEIGHBOURS = 15
CACHE_WORDS = 400_000
#: Runs of characters in one term at most; longer words are several terms.
PIECE_RUNS = 6
_runs = regex.compile(r"\p{Lu}+|\p{Ll}+|\p{L}+|\p{N}+|(\W)\1*|.", regex.DOTALL)


def shape(word: str) -> str:
    """A word's form: upper-case runs A, lower-case runs a, other letters x, digits 0, each sign as itself."""
    out = []
    for m in _runs.finditer(word):
        c = m[0][0]
        out.append("A" if c.isupper() else "a" if c.islower() else "x" if c.isalpha() else "0" if c.isdigit() else c + c if len(m[0]) > 1 else c)
    return "".join(out)


def pieces(word: str) -> list[str]:
    """A word in pieces of at most PIECE_RUNS runs."""
    if len(word) <= PIECE_RUNS:
        return [word]
    starts = [m.start() for m in _runs.finditer(word)][::PIECE_RUNS]
    return [word[i:j] for i, j in zip(starts, [*starts[1:], len(word)], strict=True)]


def _place(term: str) -> int:
    return zlib.crc32(term.encode()) % TERMS


class Terms:
    """Counts the terms of texts; shapes of words seen before are looked up."""

    def __init__(self):
        self.codes: dict[str, int] = {}
        self.shapes: dict[str, int] = {}
        self.shape_of: list[int] = []
        self.single: list[int] = []

    def _code(self, word: str) -> int:
        s = shape(word)
        if s not in self.shapes:
            self.shapes[s] = len(self.shapes)
            self.single.append(_place("s" + s))
        self.shape_of.append(self.shapes[s] * 64 + (len(word) if len(word) < 32 else 26 + len(word).bit_length()))
        return len(self.shape_of) - 1

    def vector(self, text: str) -> np.ndarray:
        words = [p for w in text.split() for p in (pieces(w) if len(w) > PIECE_RUNS and w not in self.codes else (w,))]
        if not words:
            return np.zeros(TERMS, np.float32)
        if len(self.codes) > CACHE_WORDS:
            self.codes, self.shape_of = {}, []
        codes = self.codes
        for w in set(words).difference(codes):
            codes[w] = self._code(w)
        c = np.fromiter(map(codes.__getitem__, words), np.int64, len(words))
        both = np.fromiter(map(self.shape_of.__getitem__, c), np.int64, len(c))
        single = np.array(self.single)[both >> 6]
        pairs = (single[:-1] * 7919 + single[1:] * 104729 + 13) % TERMS
        again = np.where(c[1:] == c[:-1], _place("again"), _place("fresh"))
        lengths = (both & 63) * 31 % TERMS
        counts = np.bincount(np.concatenate([single, pairs, again, lengths]), minlength=TERMS).astype(np.float32)
        kinds = len(np.unique(c)) / len(c)  # how much of the text repeats, as far as its length lets it show
        counts[_place(f"kinds{int(4 * kinds)}")] += len(c) / 2
        return np.log1p(100 * counts / len(c))


class Model:
    """Inverse document frequencies, projection, and the labelled vectors with their votes."""

    def __init__(self, x: np.ndarray, labels: np.ndarray, weight: np.ndarray, prior: float):
        n = max(1, len(x))
        self.idf = np.log((1 + n) / (1 + (x > 0).sum(0))).astype(np.float32) + 1 if len(x) else np.ones(TERMS, np.float32)
        x = x * self.idf
        self.prior = prior
        values, vectors = np.linalg.eigh((x.T @ x).astype(np.float64))
        self.project = vectors[:, ::-1][:, :LATENT].astype(np.float32)
        self.labels, self.weight = labels.astype(np.float64), weight.astype(np.float64)
        self.known = self._unit(x @ self.project)

    @staticmethod
    def _unit(x: np.ndarray) -> np.ndarray:
        n = np.linalg.norm(x, axis=1, keepdims=True)
        return np.divide(x, n, out=np.zeros_like(x), where=n > 0)

    def score(self, x: np.ndarray, block: int = 512) -> np.ndarray:
        """Votes of the nearest labelled vectors; a text without terms, or no labels at all, gets the prior."""
        out = np.full(len(x), self.prior)
        if not len(self.known):
            return out
        unit = self._unit((x * self.idf) @ self.project)
        k = min(NEIGHBOURS, len(self.known))
        for i in range(0, len(x), block):
            cosine = unit[i : i + block] @ self.known.T
            near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
            vote = np.maximum(np.take_along_axis(cosine, near, 1), 0).astype(np.float64) ** 8 * self.weight[near]
            total = vote.sum(1)
            some = total > 0
            out[i : i + block][some] = (vote * self.labels[near]).sum(1)[some] / total[some]
        return np.clip(out, 0, 1)


def fit(spark: SparkSession, documents: DataFrame, labels: DataFrame, modulus: int = 4, held: int = 2, per_class: int = PER_CLASS) -> Model:
    """Takes vectors of at most ``per_class`` documents of each class outside the held-out remainder."""
    rows = labelled.sample(documents, labels, "quality", modulus, held, per_class)
    schema = pa.schema([("label", pa.int32()), ("vector", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = Terms()
        for batch in text_slices(batches, 1):
            label, text = (c.to_pylist() for c in batch.columns)
            yield pa.RecordBatch.from_arrays([pa.array(label, pa.int32()), pa.array([terms.vector(t).astype("<f2").tobytes() for t in text], pa.binary())], schema=schema)

    got = rows.select("label", "text").mapInArrow(run, "label int, vector binary").collect()  # a row an example
    got.sort(key=lambda r: (r.label, r.vector))
    x = np.array([np.frombuffer(r.vector, "<f2") for r in got], np.float32).reshape(len(got), TERMS)
    y = np.array([r.label for r in got], float)
    prior = labelled.share(labels, "quality", modulus, held)
    mean = y.mean() if len(y) else 0.5
    weight = np.where(y == 1, prior / max(mean, 1e-9), (1 - prior) / max(1 - mean, 1e-9))
    return Model(x, y, weight, prior)


def scored(spark: SparkSession, documents: DataFrame, model: Model, modulus: int = 4, held: int = 2, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted per row of ``documents``.

    Null and empty texts get the labels' share of class 1 as score; a null doc_id is not held out. Other columns are
    not looked at. Without labels every score is 0.5.
    """
    known = spark.sparkContext.broadcast(model)  # at most 2 * PER_CLASS vectors of LATENT floats
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = Terms()
        for batch in text_slices(batches, 2):
            x = np.array([terms.vector(t.decode()) for t in bytes_of(batch.column(2))])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(known.value.score(x))], schema=schema)

    rows = documents.select(F.col("doc_id").cast("long"), F.coalesce(labelled.remainder("doc_id", modulus) == held, F.lit(False)).alias("held_out"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double").withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def quality(spark: SparkSession, documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Takes the labelled rows that are not held out and scores every whole text."""
    return scored(spark, documents, fit(spark, documents, labels))


def accepted(spark: SparkSession, documents: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The rows of ``documents`` that score ``threshold`` or more, with all their columns."""
    known = spark.sparkContext.broadcast(model)  # at most 2 * PER_CLASS vectors of LATENT floats

    def start():
        terms = Terms()
        return lambda texts: known.value.score(np.array([terms.vector(t.decode()) for t in texts])) >= threshold

    return kept(documents, start)
