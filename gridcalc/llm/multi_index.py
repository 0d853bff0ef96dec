"""Exact nearest neighbours by an inverted multi-index.

Both halves of a vector are quantised by centroids of their own; a pair of them is a cell. A query goes through cells by
the sum of its halves' distances, by a heap, until they hold CANDIDATES entries; the last of the nearest of these bounds
the true distances from above. A second pass visits every cell that a lower bound on its distance does not rule out, at
any size of table, and ranks by exact distance. Entries and queries meet cell by cell (small cells: by all cells of a
first half) in packed blocks of bounded size, so a full cell is many small tasks.
Equal vectors are one entry with their smallest ids: no more of them can be among the nearest.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridcalc.llm.common import partitions, written

#: Rows that the centroids are fitted on at most: a bounded sample; every row is indexed.
SAMPLE = 16_384
CENTROIDS = 48
#: Entries that the cells of a query's first pass hold at least; the second has no such number.
CANDIDATES = 6_000
ENTRY_BLOCK = 1024
QUERY_BLOCK = 128
#: Blocks of one group: what one side of a task holds of a cell.
GROUP = 64


def usable(vector: Column) -> Column:
    """Not null, not empty, all components finite, one not zero."""
    fine = F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False)))
    return F.coalesce((F.size(vector) > 0) & fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def centroids(x: np.ndarray, k: int, rounds: int = 12, seed: int = 0) -> np.ndarray:
    """k-means; empty clusters keep their centre."""
    rng = np.random.default_rng(seed)
    c = x[np.sort(rng.choice(len(x), min(k, len(x)), replace=False))].copy()
    for _ in range(rounds):
        near = nearest(x, c)
        n = np.bincount(near, minlength=len(c))
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
    return c


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1)[None, :], 0)


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return distances(x, c).argmin(1)


def visited(first: np.ndarray, second: np.ndarray, counts: np.ndarray, wanted: int) -> list[int]:
    """Cells in the order of first[i] + second[j], until they hold ``wanted`` entries; counts by (i, j)."""
    a, b = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
    heap, pushed, out, held = [(first[a[0]] + second[b[0]], 0, 0)], {(0, 0)}, [], 0
    while heap and held < wanted:
        _, i, j = heapq.heappop(heap)
        cell = (int(a[i]), int(b[j]))
        if n := int(counts[cell]):
            out.append(cell[0] * counts.shape[1] + cell[1])
            held += n
        for x, y in ((i + 1, j), (i, j + 1)):
            if x < len(a) and y < len(b) and (x, y) not in pushed:
                pushed.add((x, y))
                heapq.heappush(heap, (first[a[x]] + second[b[y]], x, y))
    return out


def _gaps(d: np.ndarray, c: np.ndarray, scale: float) -> np.ndarray:
    """Lower bounds on the distance of a half to the entries of each centroid, which is the nearest of these; d: its squared distances."""
    apart = np.sqrt(distances(c, c))
    far = apart > 1e-3 * scale  # for closer ones rounding tells as much as distance
    return np.where(far, (d[:, None] - d[None, :]) / np.where(far, 2 * apart, 1), 0).max(1, initial=0)


def lower_bounds(a: np.ndarray, b: np.ndarray, first: np.ndarray, second: np.ndarray, radii: np.ndarray, scale: float) -> np.ndarray:
    """A lower bound on the distance of one query to the entries of each cell (i, j).

    a, b: its squared distances to the centroids; radii: (3, i, j), how far a cell's entries are from its first centroid,
    its second and both at most; scale: the largest norm.
    """
    x = np.maximum(np.sqrt(a)[:, None] - radii[0], _gaps(a, first, scale)[:, None])
    y = np.maximum(np.sqrt(b)[None, :] - radii[1], _gaps(b, second, scale)[None, :])
    return np.maximum(np.sqrt(x * x + y * y), np.sqrt(a[:, None] + b[None, :]) - radii[2])


def nearest_in_block(er: np.ndarray, e: np.ndarray, q: np.ndarray, bounds: np.ndarray, n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each query the ids and distances of its ``n`` nearest entries that its bound allows, ties by id.

    Products of matrices only leave out what is further by more than their rounding; distances are exact.
    """
    e2, q2 = (e * e).sum(1), (q * q).sum(1)
    d2 = e2[None, :] - 2 * (q @ e.T) + q2[:, None]
    out = []
    for i in range(len(q)):
        limit = bounds[i] ** 2
        if len(er) > n:
            limit = min(limit, np.partition(d2[i], n - 1)[n - 1])
        at = np.flatnonzero(~(d2[i] > limit + 1e-11 * (e2.max() + q2[i])))
        d = np.sqrt(((e[at] - q[i]) ** 2).sum(1))
        top = np.lexsort((er[at], d))[:n]
        out.append((er[at][top], d[top]))
    return out


def _matrix(column: pa.Array) -> np.ndarray:
    return np.array([np.asarray(v, np.float64) for v in column.to_pylist()])


def _packed(df: DataFrame, name: str, size: int) -> tuple[DataFrame, DataFrame]:
    """Rows (cell, rep, vector) as blocks (cell, group, reps, vectors) of about ``size``, GROUP of them a group; and the
    groups of each cell."""
    counts = df.groupBy("cell").agg(F.count("*").alias("n"))  # at most CENTROIDS squared
    salted = df.join(F.broadcast(counts), "cell").withColumn("salt", F.pmod(F.xxhash64("rep"), F.ceil(F.col("n") / size)))
    dealt = salted.repartition(partitions(df.sparkSession), "cell", "salt").sortWithinPartitions("cell", "salt").select("cell", "salt", "rep", "vector")
    schema = pa.schema([("cell", pa.int64()), ("salt", pa.int64()), (f"{name}_reps", pa.binary()), (f"{name}_vectors", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, np.ndarray]] = []
        key = None

        def block() -> pa.RecordBatch:
            reps, vectors = np.array([r for r, _ in held], np.int64), np.array([v for _, v in held], np.float64)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([key[0]]), pa.array([key[1]]), pa.array([reps.tobytes()], pa.binary()), pa.array([vectors.tobytes()], pa.binary())], schema=schema)

        for batch in batches:
            for cell, salt, rep, vector in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and (key != (cell, salt) or len(held) == 2 * size):
                    yield block()
                key = (cell, salt)
                held.append((rep, vector))
        if held:
            yield block()

    blocks = dealt.mapInArrow(run, f"cell long, salt long, {name}_reps binary, {name}_vectors binary")
    groups = counts.select("cell", F.ceil(F.ceil(F.col("n") / size) / GROUP).alias(f"{name}_groups"))
    return blocks.withColumn(f"{name}_group", F.floor(F.col("salt") / GROUP)).drop("salt"), groups


def _met(entries: DataFrame, queries: DataFrame) -> DataFrame:
    """Blocks of entries and queries of one cell, side by side: a full cell is as many tasks as pairs of groups."""
    e, e_groups = _packed(entries, "e", ENTRY_BLOCK)
    q, q_groups = _packed(queries, "q", QUERY_BLOCK)
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    e = e.join(F.broadcast(q_groups), "cell").withColumn("q_group", each("q_groups"))
    q = q.join(F.broadcast(e_groups), "cell").withColumn("e_group", each("e_groups"))
    return e.join(q, ["cell", "e_group", "q_group"])


def search(spark: SparkSession, df: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", candidates: int = CANDIDATES, n_centroids: int = CENTROIDS) -> DataFrame:
    """For each query row its ``k`` nearest other rows: query_id, rank, vec_id, score (Euclidean distance).

    Ties go to the smaller id. Vectors that are null, empty, zero, or hold null or non-finite components take no part; nor
    do rows without an id. Vectors of each length have an index of their own: there is no distance between lengths.
    Rows that repeat id and vector are one row; an id with several vectors asks with each, and its own are not its
    neighbours. The result is exact; ``candidates`` and ``n_centroids`` only decide how much work it takes. An empty
    table gives an empty result; other columns are not looked at.
    """
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"), is_query.alias("asked")).where("id is not null").where(usable(F.col("vector")))
    out = None
    for r in rows.groupBy(F.size("vector").alias("width")).agg(F.max("asked").alias("asked")).where("asked").orderBy("width").collect():  # a row a length
        found = _search(spark, rows.where(F.size("vector") == r.width), r.width, k, candidates, n_centroids)
        out = found if out is None else out.unionByName(found)
    return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double") if out is None else out


def _search(spark: SparkSession, rows: DataFrame, width: int, k: int, candidates: int, n_centroids: int) -> DataFrame:
    """The search among vectors of one length: rows (id, vector, asked), one at least."""
    sample = rows.select("id", "vector").orderBy(F.xxhash64("id"), "id").limit(SAMPLE).collect()  # SAMPLE rows
    x = np.array([r.vector for r in sample])
    half = width // 2
    first, second = (centroids(x[:, part], n_centroids) for part in (slice(0, half), slice(half, width)))
    cells = (len(first), len(second))

    # of equal vectors the k + 1 smallest ids, found in each task before they meet
    by_vector = Window.partitionBy("vector").orderBy("id")
    few = rows.select("id", "vector").dropDuplicates().withColumn("place", F.row_number().over(by_vector)).where(F.col("place") <= k + 1)
    groups = few.groupBy("vector").agg(F.min("id").alias("rep"), F.array_sort(F.collect_list("id")).alias("ids"))  # k + 1 ids at most
    radius = ("r0", "r1", "r2", "norm")
    schema = pa.schema([("rep", pa.int64()), ("ids", pa.list_(pa.int64())), ("vector", pa.list_(pa.float64())), ("cell", pa.int64()), *((r, pa.float64()) for r in radius)])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                v = _matrix(batch.column(2))
                a, b = distances(v[:, :half], first), distances(v[:, half:], second)
                cell = a.argmin(1) * cells[1] + b.argmin(1)
                a, b = a.min(1), b.min(1)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), *map(pa.array, (cell, np.sqrt(a), np.sqrt(b), np.sqrt(a + b), np.sqrt((v * v).sum(1))))], schema=schema)

    entries = written(spark, groups.select("rep", "ids", "vector").mapInArrow(place, "rep long, ids array<long>, vector array<double>, cell long, r0 double, r1 double, r2 double, norm double"), "entries")
    counts, radii, scale = np.zeros(cells, np.int64), np.zeros((3, *cells)), 0.0
    for r in entries.groupBy("cell").agg(F.count("*").alias("n"), *(F.max(c).alias(c) for c in radius)).collect():  # at most CENTROIDS squared
        at = divmod(r.cell, cells[1])
        counts[at], scale = r.n, max(scale, r.norm)
        radii[:, at[0], at[1]] = r.r0, r.r1, r.r2

    asked = written(spark, rows.where("asked").select("id", "vector").dropDuplicates().join(entries.select("vector", "rep"), "vector").select("id", "rep"), "asked")
    probe_schema = pa.schema([("cell", pa.int64()), ("rep", pa.int64()), ("vector", pa.list_(pa.float64())), ("bound", pa.float64())])
    # cells of a unit: one where they fill blocks, else all of a first half
    span = 1 if counts.sum() > ENTRY_BLOCK * counts.size else cells[1]

    def probes(asking: DataFrame, cells_of: Callable[[np.ndarray, np.ndarray, float], list[int]]) -> DataFrame:
        """Rows (cell, rep, vector with the bound before it) of (rep, vector, bound), for the cells that ``cells_of`` names."""

        def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    v = _matrix(batch.column(1))
                    a, b = distances(v[:, :half], first), distances(v[:, half:], second)
                    for i in range(len(v)):
                        bound = batch.column(2)[i].as_py()
                        found = cells_of(a[i], b[i], bound)
                        n = len(found)
                        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array([batch.column(0)[i].as_py()] * n, pa.int64()), pa.array([batch.column(1)[i].as_py()] * n, probe_schema.types[2]), pa.array([bound] * n, pa.float64())], schema=probe_schema)

        rows = written(spark, asking.mapInArrow(probe, "cell long, rep long, vector array<double>, bound double"), "probes")
        return rows.select("cell", "rep", F.concat(F.array("bound"), "vector").alias("vector"))

    best_schema = pa.schema([("query", pa.int64()), ("rep", pa.int64()), ("score", pa.float64())])

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for er, ev, qr, qv in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                er, qr = np.frombuffer(er, np.int64), np.frombuffer(qr, np.int64)
                e, q = np.frombuffer(ev).reshape(len(er), width), np.frombuffer(qv).reshape(len(qr), width + 1)
                found = nearest_in_block(er, e, q[:, 1:], q[:, 0], k + 1)
                out = [(np.full(len(reps), r), reps, d) for r, (reps, d) in zip(qr, found, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], schema=best_schema)

    def best(cell: Column, probed: DataFrame) -> DataFrame:
        """The k + 1 nearest entries of each query among those that it meets, with their place."""
        met = _met(entries.select(cell.alias("cell"), "rep", "vector"), probed)
        ranked = met.select("e_reps", "e_vectors", "q_reps", "q_vectors").mapInArrow(rank, "query long, rep long, score double")
        order = Window.partitionBy("query").orderBy("score", "rep")
        return ranked.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k + 1)

    def near(a: np.ndarray, b: np.ndarray, bound: float) -> list[int]:
        return visited(a, b, counts, candidates)

    def within(a: np.ndarray, b: np.ndarray, bound: float) -> list[int]:
        open_to = (counts > 0) & ~(lower_bounds(a, b, first, second, radii, scale) > bound)
        return np.unique(np.flatnonzero(open_to) // span).tolist()

    unique = entries.join(asked.select("rep").distinct(), "rep", "left_semi").select("rep", "vector")
    top = best(F.col("cell"), probes(unique.withColumn("bound", F.lit(float("inf"))), near))
    if counts.sum() > candidates:  # else that was all
        last = written(spark, top.where(F.col("place") == k + 1).select(F.col("query").alias("rep"), "score"), "bounds")
        bound = F.coalesce(F.col("score") + F.lit(1e-6 * scale), F.lit(float("inf")))  # more than rounding
        top = best(F.floor(F.col("cell") / span), probes(unique.join(last, "rep", "left").select("rep", "vector", bound.alias("bound")), within))
    hits = top.join(entries.select("rep", "ids"), "rep").select("query", "score", F.explode("ids").alias("id"))
    lists = hits.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("score", "id"))).alias("hits"))  # (k + 1) squared at most
    mine = asked.join(lists, asked.rep == lists.query).select(F.col("id").alias("query_id"), F.slice(F.filter("hits", lambda h: h["id"] != F.col("id")), 1, k).alias("hits"))
    return mine.select("query_id", F.posexplode("hits").alias("pos", "hit")).select("query_id", (F.col("pos") + 1).alias("rank"), F.col("hit.id").alias("vec_id"), F.col("hit.score").alias("score"))
