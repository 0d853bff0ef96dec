"""Rows of a sheet in windows that move with the row, without ordering the whole table in one task.

Row numbers are dense, so a row's bucket is arithmetic. A window that moves by a few rows needs its own bucket and the
first rows of the next: those rows are copied there (the halo). A window with one fixed end is a running value inside a
bucket, combined with the totals of the buckets before or after, of which there are at most MOST_BUCKETS; they are the
only thing that is broadcast. Running values that are read at an offset take a second, moving window.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROW = "__row"
BUCKET = "__bucket"
HALO = "__halo"
LEAST_BUCKET = 65_536
MOST_BUCKETS = 10_000


def bucket_size(rows: int) -> int:
    return max(LEAST_BUCKET, -(-rows // MOST_BUCKETS))


@dataclass
class Moving:
    """An aggregate over rows first..last relative to the row; or, with ``take``, one cell ``first`` rows below."""

    name: str
    first: int
    last: int
    build: Callable[[Column | None], Column]
    cell: bool = False


@dataclass
class Running:
    """A decomposable aggregate from a fixed first row to the row (forward), or from the row to a fixed last row.

    ``value`` is the row's contribution, null outside the fixed end; ``combine`` is sum, min or max.
    """

    name: str
    value: Column
    combine: str
    forward: bool
    offset: int


@dataclass
class Requests:
    moving: list[Moving] = field(default_factory=list)
    running: list[Running] = field(default_factory=list)


_AGGREGATES = {"sum": F.sum, "min": F.min, "max": F.max}


def _both(kind: str, a: Column, b: Column) -> Column:
    if kind == "sum":
        return F.coalesce(a + b, a, b)
    return (F.least if kind == "min" else F.greatest)(a, b)


def _running(df: DataFrame, wanted: list[Running]) -> DataFrame:
    inputs = {f"{r.name}_in": r.value for r in wanted}
    df = df.withColumns(inputs)
    forward = Window.partitionBy(BUCKET).orderBy(ROW).rowsBetween(Window.unboundedPreceding, 0)
    backward = Window.partitionBy(BUCKET).orderBy(F.desc(ROW)).rowsBetween(Window.unboundedPreceding, 0)
    totals = df.groupBy(BUCKET).agg(*(_AGGREGATES[r.combine](f"{r.name}_in").alias(f"{r.name}_t") for r in wanted))
    before = Window.partitionBy(F.lit(0)).orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy(F.lit(0)).orderBy(F.desc(BUCKET)).rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(BUCKET, *(_AGGREGATES[r.combine](f"{r.name}_t").over(before if r.forward else after).alias(f"{r.name}_c") for r in wanted))
    df = df.withColumns({f"{r.name}_w": _AGGREGATES[r.combine](f"{r.name}_in").over(forward if r.forward else backward) for r in wanted})
    df = df.join(F.broadcast(carried), BUCKET)  # at most MOST_BUCKETS rows
    df = df.withColumns({r.name: _both(r.combine, F.col(f"{r.name}_w"), F.col(f"{r.name}_c")) for r in wanted})
    return df.drop(*(f"{r.name}_{x}" for r in wanted for x in ("in", "w", "c")))


def apply(df: DataFrame, rows: int, wanted: Requests) -> DataFrame:
    """Adds a column for each request; ``df`` has dense row numbers from 1."""
    moving = list(wanted.moving)
    size = bucket_size(rows)
    if wanted.running or moving:
        df = df.withColumn(BUCKET, F.floor((F.col(ROW) - 1) / F.lit(size)).cast("long"))
    if wanted.running:
        df = _running(df, wanted.running)
        for r in wanted.running:
            if r.offset:
                # the running value at a row below, which itself lies on the sheet
                moving.append(Moving(r.name, r.offset, r.offset, lambda w, c=r.name: F.col(c), cell=True))
    if moving:
        reach = max(m.last for m in moving)
        if reach:
            if reach >= size:
                size = -(-(reach + 1) // size) * size
                df = df.withColumn(BUCKET, F.floor((F.col(ROW) - 1) / F.lit(size)).cast("long"))
            near = (F.pmod(F.col(ROW) - 1, F.lit(size)) < reach) & (F.col(BUCKET) > 0)
            homes = F.when(near, F.array(F.struct(F.col(BUCKET).alias("b"), F.lit(False).alias("h")), F.struct((F.col(BUCKET) - 1).alias("b"), F.lit(True).alias("h")))).otherwise(F.array(F.struct(F.col(BUCKET).alias("b"), F.lit(False).alias("h"))))
            df = df.withColumn("__home", F.explode(homes)).withColumns({BUCKET: F.col("__home.b"), HALO: F.col("__home.h")}).drop("__home")
        order = Window.partitionBy(BUCKET).orderBy(ROW)
        made = {}
        for m in moving:
            if m.cell:
                made[m.name] = F.lead(m.build(None), m.first).over(order) if m.first else m.build(None)
            else:
                made[m.name] = m.build(order.rowsBetween(m.first, m.last))
        df = df.withColumns(made)
        if reach:
            df = df.where(~F.col(HALO)).drop(HALO)
    return df.drop(BUCKET) if BUCKET in df.columns else df
