"""Near-duplicates by the Jaccard similarity of word shingles, 0.8 or more by default, found by SimHash.

Wide fingerprints of the shingle sets that share a table and differ in few bits are linked (:mod:`simhash_tables`; a pair
at 0.8 is not with a probability of 6e-6 at most), and what the links join is a cluster. Clusters are then compared
exactly: all members first with the cluster's least, which is linear in the cluster. Where that leaves members in
different components, those outside the commonest component are compared with the whole cluster, by blocks of bounded
size whose links become a spanning forest.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridcalc.llm.common import bytes_of, gathered, partitions, rows_of, text_slices, written
from gridcalc.llm.components import components
from gridcalc.llm.simhash import shingles
from gridcalc.llm.simhash_tables import SMALL, WORDS, apart, distances, links, wide_fingerprint

#: About how many members, and shingles of all of them, a block of a bucket has.
BLOCK_ROWS, BLOCK_SHINGLES = 2048, 1 << 20


def shingle_set(text: bytes, ngram: int) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a text."""
    sh = shingles(text.lower().split(), ngram)
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, sh, repeat(42)), np.uint64, len(sh)))


def forest(part: np.ndarray, asks: np.ndarray, sets: list[np.ndarray], threshold: float, words: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Index pairs that join the parts (by a label each) as all similar pairs of an asking and another set would; no set is empty.

    With fingerprints (a row of words each), only pairs within the Hamming distance are compared.
    """
    sizes = np.array([len(s) for s in sets])
    names, flat = np.unique(np.concatenate(sets), return_inverse=True)
    ends = np.cumsum(sizes)
    _, part = np.unique(part, return_inverse=True)
    rest = np.flatnonzero(~asks)
    if not len(rest):
        return []
    usual, small = distances(threshold)
    # without what asks, the others' shingles lie in one run
    others = flat[gathered(ends - sizes, sizes, rest)]
    seen = np.zeros(len(names), np.int32)
    found = []
    for k in np.flatnonzero(asks):
        own = flat[ends[k] - sizes[k] : ends[k]]
        low, high = np.minimum(sizes[rest], sizes[k]), np.maximum(sizes[rest], sizes[k])
        near = rest[(part[rest] != part[k]) & (low >= threshold * high)]
        if words is not None:
            near = near[apart(words[near], words[k]) <= np.where(np.minimum(sizes[near], sizes[k]) < SMALL, small, usual)]
        if not len(near):
            continue
        if 2 * len(near) < len(rest):
            run = flat[gathered(ends - sizes, sizes, near)]
        else:
            near, run = rest, others
        seen[own] = 1
        both = np.add.reduceat(seen[run], np.cumsum(sizes[near]) - sizes[near])
        seen[own] = 0
        for j in near[both >= threshold * (sizes[near] + sizes[k] - both)]:
            if part[j] != part[k]:
                part[part == part[j]] = part[k]
                found.append((int(k), int(j)))
    return found


def roots(spark: SparkSession, texts: DataFrame, ngram: int = 5, threshold: float = 0.8) -> DataFrame:
    """(key, root) for each row (key, text) of ``texts``: equal roots for texts that a chain of near-duplicates joins."""
    schema = pa.schema([("key", pa.string()), ("sid", pa.int64()), ("n", pa.int32()), ("words", pa.list_(pa.int64()))])

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(b: pa.RecordBatch) -> list:
            sets = [shingle_set(t, ngram) for t in bytes_of(b.column(1))]
            return [b.column(0), [xxhash.xxh64_intdigest(s.tobytes(), 1) - (1 << 63) for s in sets], [len(s) for s in sets], [wide_fingerprint(s).view(np.int64) for s in sets]]

        return rows_of(text_slices(batches, 1), schema, made)

    sketches = written(spark, texts.select("key", "text").mapInArrow(sketch, "key string, sid long, n int, words array<long>"), "sketches")
    # equal sets are one, empty sets have no others; a cluster of one is none
    prints = written(spark, sketches.where("n > 0").dropDuplicates(["sid"]).select("sid", "n", "words"), "prints")
    joined = components(spark, links(spark, prints, threshold))
    placed = prints.join(joined, prints.sid == joined.node, "left").select(F.coalesce("root", "sid").alias("bucket"), "sid", "n")
    full = placed.groupBy("bucket").agg(F.min(F.struct("sid", "n")).alias("least"), F.count("*").alias("m")).where("m > 1")
    members = written(spark, placed.join(full.select("bucket", "least"), "bucket"), "members")
    set_schema = pa.schema([("sid", pa.int64()), ("words", pa.list_(pa.int64())), ("shingles", pa.list_(pa.int64()))])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return rows_of(text_slices(batches, 1), set_schema, lambda b: [b.column(0), b.column(2), [shingle_set(t, ngram).view(np.int64) for t in bytes_of(b.column(1))]])

    wanted = members.select("sid").distinct()
    keys = sketches.join(wanted, "sid", "left_semi").groupBy("sid").agg(F.min(F.struct("key", "words")).alias("one")).select("sid", "one.*")
    sets = written(spark, texts.join(keys, "key").select("sid", "text", "words").mapInArrow(gather, "sid long, words array<long>, shingles array<long>").dropDuplicates(["sid"]), "sets")

    def alike(pairs: DataFrame) -> DataFrame:
        """Those of the pairs (u, v) whose sets are similar enough."""
        a, b = (sets.select(F.col("sid").alias(x), F.col("shingles").alias(f"{x}s")) for x in "uv")
        both = F.size(F.array_intersect("us", "vs"))
        return pairs.distinct().join(a, "u").join(b, "v").where(both >= F.lit(threshold) * (F.size("us") + F.size("vs") - both)).select("u", "v")

    fits = lambda m, n: F.least(m, n) >= F.lit(threshold) * F.greatest(m, n)
    stars = members.where((F.col("sid") != F.col("least.sid")) & fits(F.col("n"), F.col("least.n")))
    edges = written(spark, alike(stars.select(F.col("sid").alias("u"), F.col("least.sid").alias("v"))), "edges")
    parts = components(spark, edges)
    placed = members.join(parts, members.sid == parts.node, "left").select("bucket", "sid", "n", F.coalesce("root", "sid").alias("part"))
    placed = written(spark, placed, "placed")
    by_part = placed.groupBy("bucket", "part").agg(F.count("*").alias("m"), F.sum("n").alias("n"))
    sums = by_part.groupBy("bucket").agg(F.max(F.struct("m", "part", "n")).alias("most"), F.sum("m").alias("m"), F.sum("n").alias("n"), F.count("*").alias("parts"))
    blocks = lambda m, n: F.ceil(F.greatest(m / BLOCK_ROWS, n / BLOCK_SHINGLES)).cast("int")
    deal = sums.where("parts > 1").select(
        "bucket", F.col("most.part").alias("most"), blocks(F.col("m"), F.col("n")).alias("rows"), blocks(F.col("m") - F.col("most.m"), F.col("n") - F.col("most.n")).alias("asking")
    )
    # each member meets every block of those that ask, and each of those every block of members
    mixed = placed.join(deal, "bucket")
    salt = F.xxhash64("sid")
    told = mixed.select("bucket", F.explode(F.sequence(F.lit(0), F.col("asking") - 1)).alias("i"), F.pmod(salt, "rows").cast("int").alias("j"), "sid", "part", F.lit(False).alias("asks"))
    asking = mixed.where("part != most").select(
        "bucket", F.pmod(salt, "asking").cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.col("rows") - 1)).alias("j"), "sid", "part", F.lit(True).alias("asks")
    )
    units = told.union(asking).join(sets, "sid").select("bucket", "i", "j", "sid", "part", "asks", "words", "shingles")
    units = units.repartition(partitions(spark), "bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
    edge_schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for b in batches:
                keys = zip(*(c.to_pylist() for c in b.columns[:6]), strict=True)
                words = b.column(6).flatten().to_numpy().view(np.uint64).reshape(-1, WORDS).copy()
                for k, (bucket, i, j, *row) in enumerate(keys):
                    yield (bucket, i, j), *row, words[k], b.column(7)[k].values.to_numpy().copy()

        for _, unit in groupby(rows(), lambda r: r[0]):
            _, sids, part, asks, words, own = zip(*unit, strict=True)
            pairs = forest(np.array(part), np.array(asks), list(own), threshold, np.stack(words))
            u, v = ([sids[x[k]] for x in pairs] for k in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], schema=edge_schema)

    more = units.mapInArrow(compare, "u long, v long")
    found = components(spark, edges.union(more))
    return sketches.join(found, sketches.sid == found.node, "left").select("key", F.coalesce("root", "sid").alias("root"))
