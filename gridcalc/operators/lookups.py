"""LOOKUP, INDEX and MATCH as joins of a sheet with itself.

Exact matches reduce the searched column to one row a value before joining. Positional matches ("the last row whose value
is not above") meet on a value axis cut into ranges at quantiles of a sample, of texts as of numbers: a running best
inside each range and the best of the ranges before, of which there are at most RANGES. Only distinct values take part.

What was found comes back to the rows by a join that gathers no rows in one task: short ranges are broadcast; else rows
that ask for nothing, or for what very many rows ask for, stay out of the join's exchange.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridcalc.operators.frames import ROW

RANGES = 1000
#: Rows of one range, about, and values that the ranges' bounds are taken from.
RANGE_ROWS = 1_000_000
SAMPLE = 50_000
#: Hits of fixed width that are broadcast.
BROADCAST_ROWS = 100_000
#: A key is hot if this many rows ask for it, or one in HOT_PARTS of all rows where those are more; one row in HOT_STEP tells.
HOT_ROWS = 250_000
HOT_PARTS = 1000
HOT_STEP = 64
_PLAIN = (T.NumericType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)


def exact(searched: DataFrame) -> DataFrame:
    """(key, hit) of the first row of each value; ``searched`` has key, row and target."""
    return searched.where("key is not null").groupBy("key").agg(F.min_by(F.struct("row", "target"), "row").alias("hit"))


def range_of(key: Column, bounds: list) -> Column:
    """How many of the ascending bounds are at most the key, by bisection."""

    def among(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(key < F.lit(bounds[middle]), among(low, middle)).otherwise(among(middle + 1, high))

    return among(0, len(bounds))


def sampled_bounds(keys: DataFrame, rows: int) -> list:
    """Ascending bounds that cut a column of distinct keys into ranges of RANGE_ROWS, about; at most RANGES of them."""
    ranges = min(RANGES, -(-rows // RANGE_ROWS))
    if ranges < 2:
        return []
    found = sorted(r.key for r in keys.select("key").orderBy(F.xxhash64("key")).limit(SAMPLE).collect())  # SAMPLE values
    return sorted({found[len(found) * i // ranges] for i in range(1, ranges)}) if found else []


def positional(searched: DataFrame, sources: DataFrame, last: bool, rows: int) -> DataFrame:
    """(key, hit) for each distinct source value.

    With ``last`` the hit is the last row whose value is at most the source; without, the first whose value is at least
    the source.
    """
    keep = F.max_by if last else F.min_by
    best = searched.where("key is not null").groupBy("key").agg(keep(F.struct("row", "target"), "row").alias("hit"))
    asked = sources.where("key is not null").select("key").distinct()
    bounds = sampled_bounds(best, rows)
    both = best.select("key", F.lit(0).alias("tag"), "hit").unionByName(asked.select("key", F.lit(1).alias("tag")), allowMissingColumns=True)
    both = both.withColumn("part", range_of(F.col("key"), bounds))
    pick = F.max if last else F.min
    to = (lambda c: c.asc()) if last else (lambda c: c.desc())
    inside = Window.partitionBy("part").orderBy(to(F.col("key")), "tag").rowsBetween(Window.unboundedPreceding, 0)
    if not bounds:
        return both.withColumn("own", pick("hit").over(inside)).where("tag = 1").select("key", F.col("own").alias("hit"))
    others = Window.partitionBy(F.lit(0)).orderBy(to(F.col("part"))).rowsBetween(Window.unboundedPreceding, -1)
    carried = both.groupBy("part").agg(pick("hit").alias("own")).select("part", pick("own").over(others).alias("carried"))
    found = both.withColumn("own", pick("hit").over(inside)).join(F.broadcast(carried), "part")  # at most RANGES rows
    better = (F.greatest if last else F.least)("own", "carried")
    return found.where("tag = 1").select("key", better.alias("hit"))


def _fixed_width(kind: T.DataType) -> bool:
    return all(_fixed_width(f.dataType) for f in kind.fields) if isinstance(kind, T.StructType) else isinstance(kind, _PLAIN)


def _hot(df: DataFrame, asked: str, rows: int) -> list[int]:
    """Hashes of the keys that very many rows ask for, 2 * HOT_PARTS at most. They only tell a row's way, not its hit."""
    least = max(HOT_ROWS, rows // HOT_PARTS)
    if rows <= least:
        return []
    seen = df.where(F.col(asked).isNotNull() & (F.pmod(F.xxhash64(ROW), F.lit(HOT_STEP)) == 0))
    # half of what is to be expected: by chance none is missed
    return [r.h for r in seen.groupBy(F.xxhash64(asked).alias("h")).count().where(F.col("count") * 2 * HOT_STEP >= least).collect()]


def _join(df: DataFrame, source: Column, hits: DataFrame, name: str, rows: int, most: int) -> DataFrame:
    """Adds to each of ``rows`` rows the value of its key as column ``name``; ``hits`` has key (unique), value and row.

    ``most`` is a bound of the hits. Rows without a key, and those with a hot one, meet no hit in the large join; they are
    dealt by their own row numbers. Hot keys' hits are broadcast.
    """
    key, asked, own, hit_own = (f"{name}_{x}" for x in ("k", "s", "o", "z"))
    df = df.withColumn(asked, source)
    # the row numbers begin with 1: always 0, but not a constant, which would be folded out of the join's keys
    hits = hits.select(F.col("key").alias(key), F.col("value").alias(name), F.least("row", F.lit(0)).alias(hit_own))
    kinds = [df.schema[asked].dataType, hits.schema[key].dataType]
    if most <= BROADCAST_ROWS and all(map(_fixed_width, [*kinds, hits.schema[name].dataType])):
        return df.join(F.broadcast(hits.drop(hit_own)), F.col(asked) == F.col(key), "left").drop(key, asked)
    alone, found = F.col(asked).isNull(), F.col(name)
    # equal keys of other kinds may differ in their hashes
    same = kinds[0] == kinds[1] and (kinds[0] == T.StringType() or isinstance(kinds[0], _PLAIN))
    if hot := _hot(df, asked, rows) if same else []:
        few = hits.where(F.xxhash64(key).isin(hot)).select(F.col(key).alias(f"{name}_hk"), F.col(name).alias(f"{name}_h"))
        df = df.join(F.broadcast(few), F.col(asked) == F.col(f"{name}_hk"), "left")  # at most 2 * HOT_PARTS rows
        alone, found = alone | F.xxhash64(asked).isin(hot), F.coalesce(name, f"{name}_h")
    df = df.withColumn(own, F.when(alone, F.col(ROW)).otherwise(F.lit(0).cast("long")))
    parts = -(-rows // RANGE_ROWS)
    if parts > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        df, hits = df.repartition(parts, asked, own), hits.repartition(parts, key, hit_own)
    joined = df.join(hits, (F.col(asked) == F.col(key)) & (F.col(own) == F.col(hit_own)), "left")
    return joined.withColumn(name, found).drop(key, asked, own, hit_own, f"{name}_hk", f"{name}_h")


def join_key(df: DataFrame, source: Column, hits: DataFrame, name: str, rows: int, most: int) -> DataFrame:
    """Adds a source's hit to each row as column ``name``; null where there is none."""
    return _join(df, source, hits.select("key", F.col("hit").alias("value"), F.col("hit.row").alias("row")), name, rows, most)


def join_row(df: DataFrame, row: Column, cells: DataFrame, name: str, rows: int, most: int) -> DataFrame:
    """Adds the target (a column of ``cells``) of a computed row number as column ``name``."""
    return _join(df, row, cells.select(F.col("row").alias("key"), F.col("target").alias("value"), "row"), name, rows, most)


def distinct_sources(df: DataFrame, source: Column) -> DataFrame:
    return df.select(source.alias("key"))


__all__ = ["ROW", "distinct_sources", "exact", "join_key", "join_row", "positional"]
