"""A bounded sample of labelled documents, and word codes: what the two trained classifiers share."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder(id_col: str, modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo ``modulus``."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % modulus


def sample(documents: DataFrame, labels: DataFrame, label: str, modulus: int, held: int, per_class: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, label) of at most ``per_class`` labelled documents of each class outside the held-out remainder.

    Rows are taken in the order of a hash of their id; null ids and labels are no examples, of several labels of one id
    the smallest counts.
    """
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).where("doc_id is not null and label in (0, 1)")
    known = known.where(remainder("doc_id", modulus) != held).groupBy("doc_id").agg(F.min("label").alias("label"))
    parts = [known.where(F.col("label") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for c in (0, 1)]
    chosen = F.broadcast(parts[0].union(parts[1]))  # 2 * per_class rows at most
    docs = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return docs.join(chosen, "doc_id")


def share(labels: DataFrame, label: str, modulus: int, held: int, id_col: str = "doc_id") -> float:
    """The share of class 1 among all labels outside the held-out remainder; 0.5 if there is none."""
    got = labels.where((remainder(id_col, modulus) != held) & F.col(label).cast("int").isin(0, 1)).agg(F.avg(F.col(label).cast("double"))).first()[0]
    return 0.5 if got is None else float(got)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.1, steps: int = 60) -> np.ndarray:
    """Weights of a ridge logistic regression by Newton's method; the last is the intercept."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    penalty = np.diag([ridge] * (x.shape[1] - 1) + [1e-6])
    for _ in range(steps):
        p = sigmoid(x @ w)
        grad = x.T @ (weight * (p - y)) + penalty @ w
        hess = (x * (weight * p * (1 - p))[:, None]).T @ x + penalty
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w
