"""Medians of all cells up to each row, exact, without ordering the table in one task.

Values are cut into ranges at quantiles of a sample; a bound is a range of its own, so that a frequent value is one that
needs no search. Rows are cut into buckets. The counts of each range before each bucket say in which range a row's middle
cells lie, and at which place among the range's cells so far. A range then answers by a wavelet matrix over its cells in
the order of rows; where many rows ask one range, they ask in stretches, each with a copy of the range's cells.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridcalc.operators.lookups import range_of

#: Cells of one range, about; ranges at most; sampled values.
RANGE_CELLS, RANGES, SAMPLE = 500_000, 500, 50_000
#: Rows of one bucket, and of one stretch of askers.
BUCKET_ROWS, STRETCH = 65_536, 1_000_000


def smallest(values: np.ndarray, ends: np.ndarray, places: np.ndarray) -> np.ndarray:
    """For each asker the value at a place (from 0) among the first ``end`` values in ascending order."""
    order = np.argsort(values, kind="stable")
    rank = np.empty(len(values), np.int64)
    rank[order] = np.arange(len(values))
    low, high, place, found = np.zeros(len(ends), np.int64), ends.astype(np.int64), places.astype(np.int64), np.zeros(len(ends), np.int64)
    for bit in range(max(1, len(values) - 1).bit_length() - 1, -1, -1):
        one = (rank >> bit & 1).astype(bool)
        zeros = np.r_[0, np.cumsum(~one)]
        a, b = zeros[low], zeros[high]
        left = place < b - a
        low, high = np.where(left, a, zeros[-1] + low - a), np.where(left, b, zeros[-1] + high - b)
        found |= np.where(left, 0, 1 << bit)
        place = np.where(left, place, place - (b - a))
        rank = np.r_[rank[~one], rank[one]]
    return values[order[found]]


def middles(before: np.ndarray, at: np.ndarray, ranges: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(at, side, range, place) of the two middle cells at each ``at``; cells in order, a range of -1 is no cell."""
    counts = before.astype(np.int64).tolist()
    total, p, c, out = sum(counts), 0, 0, []
    at, ranges = at.tolist(), ranges.tolist()
    for i, (t, v) in enumerate(zip(at, ranges, strict=True)):
        if v >= 0:
            counts[v] += 1
            total += 1
            if v < p:
                c += 1
        if not total or i + 1 < len(at) and at[i + 1] == t:
            continue
        k = (total - 1) // 2
        while k < c:
            p -= 1
            c -= counts[p]
        while k >= c + counts[p]:
            c += counts[p]
            p += 1
        out.append((t, 0, p, k - c))
        if total // 2 < c + counts[p]:
            out.append((t, 1, p, total // 2 - c))
        else:
            out.append((t, 1, next(q for q in range(p + 1, len(counts)) if counts[q]), 0))
    return out


def running(cells: DataFrame, at: Column, rows: int) -> DataFrame:
    """(__at, median) for each value of ``at``, a whole number, of all cells ``x`` whose own is not above; null before any."""
    cells = cells.select(at.cast("long").alias("at"), F.col("x"))
    ranges = min(RANGES, -(-rows // RANGE_CELLS))
    bounds: list[float] = []
    if ranges > 1:
        sample = sorted(r.x for r in cells.where("x is not null").orderBy(F.xxhash64("at", "x")).limit(SAMPLE).select("x").collect())  # SAMPLE values
        bounds = sorted({sample[len(sample) * i // ranges] for i in range(1, ranges)}) if sample else []
    size = 2 * len(bounds) + 1
    above = range_of(F.col("x"), bounds)
    on_bound = F.coalesce(F.get(F.array(*map(F.lit, bounds)), above - 1) == F.col("x"), F.lit(False)) if bounds else F.lit(False)
    placed = cells.withColumns({"range": F.when(F.col("x").isNull(), -1).otherwise(2 * above - on_bound.cast("int")), "bucket": F.floor(F.col("at") / BUCKET_ROWS)})
    counts = placed.groupBy("bucket", "range").agg(F.count("*").alias("n"))
    # of each bucket what each range holds before it: buckets times ranges rows
    grid = counts.select("bucket").distinct().withColumn("range", F.explode(F.sequence(F.lit(0), F.lit(size - 1))))
    so_far = Window.partitionBy("range").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = grid.join(counts, ["bucket", "range"], "left").withColumn("before", F.coalesce(F.sum("n").over(so_far), F.lit(0))).select(F.col("bucket").alias("of"), F.col("range").alias("held"), "before")

    def ask(own: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        base = np.zeros(size, np.int64)
        base[known["held"].to_numpy()] = known["before"].to_numpy()
        own = own.sort_values("at", kind="stable")
        return pd.DataFrame(middles(base, own["at"].to_numpy(), own["range"].to_numpy()), columns=["at", "side", "range", "place"])

    asked = placed.groupBy("bucket").cogroup(before.groupBy("of")).applyInPandas(ask, "at long, side int, range int, place long")
    asked = asked.withColumn("stretch", F.floor(F.col("at") / STRETCH))
    bound_at = F.array(*map(F.lit, bounds)) if bounds else F.array().cast("array<double>")
    simple = asked.where("range % 2 = 1").select("at", F.get(bound_at, ((F.col("range") - 1) / 2).cast("int")).alias("x"))
    hard = asked.where("range % 2 = 0")
    wanted = hard.select("range", "stretch").distinct()
    held = placed.select("at", "x", "range").join(wanted, "range").where(F.col("at") < (F.col("stretch") + 1) * STRETCH)

    def answer(own: pd.DataFrame, askers: pd.DataFrame) -> pd.DataFrame:
        if not len(own) or not len(askers):
            return pd.DataFrame({"at": [], "x": []})
        own = own.sort_values("at", kind="stable")
        ends = np.searchsorted(own["at"].to_numpy(), askers["at"].to_numpy(), "right")
        return pd.DataFrame({"at": askers["at"].to_numpy(), "x": smallest(own["x"].to_numpy(), ends, askers["place"].to_numpy())})

    asking = hard.select(F.col("range").alias("in"), F.col("stretch").alias("of"), "at", "place")
    found = held.groupBy("range", "stretch").cogroup(asking.groupBy("in", "of")).applyInPandas(answer, "at long, x double")
    return found.unionByName(simple).groupBy(F.col("at").alias("__at")).agg(F.avg("x").alias("median"))
