"""SimHash near-duplicates: fingerprints, pigeonhole blocks, Hamming verification, components.

A fingerprint's 64 bits are cut into seven blocks. Two fingerprints that differ in at most four bits agree on three
whole blocks at least, so they meet in one of the 35 tables keyed by three blocks (27 bits and more). Only distinct
fingerprints enter the tables: exact copies never meet. Inside a bucket links become a spanning forest, never all pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridcalc.llm.common import bytes_of, partitions, rows_of, text_slices, written
from gridcalc.llm.components import components, local_roots

#: For each byte, its eight bits in the eight bytes of a word: sums of up to 255 hashes fit.
_LANES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view(np.uint64).ravel()
#: Rows gathered before buckets are compared.
BUFFER_ROWS = 1 << 18
#: Buckets up to this size are compared pair by pair at once; larger ones first link close pairs by way of midpoints.
PAIRWISE = 2048


def shingles(words: list[bytes], n: int) -> list[bytes]:
    if len(words) < n:
        return [b" ".join(words)] if words else []
    return list(map(b" ".join, zip(*(words[i:] for i in range(n)), strict=False)))


def fingerprints_of(texts: list[bytes], ngram: int = 4) -> np.ndarray:
    """Unsigned fingerprints of UTF-8 texts; a text without words has zero."""
    out = np.zeros(len(texts), np.uint64)
    hashes, docs, starts, edges = [], [], [], []
    at = 0
    for k, text in enumerate(texts):
        sh = shingles(text.lower().split(), ngram)
        if sh:
            hashes.append(np.fromiter(map(xxhash.xxh64_intdigest, sh, repeat(42)), np.uint64, len(sh)))
            docs.append((k, len(sh)))
            starts.append(len(edges))
            edges.extend(range(at, at + len(sh), 255))
            at += len(sh)
    if not docs:
        return out
    lanes = _LANES[np.concatenate(hashes).view(np.uint8).reshape(-1, 8)]
    counts = np.add.reduceat(np.add.reduceat(lanes, edges, axis=0).view(np.uint8).reshape(len(edges), 64), starts, axis=0, dtype=np.int64)
    which, n = np.array(docs).T
    out[which] = np.packbits(counts * 2 > n[:, None], axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", ngram: int = 4) -> DataFrame:
    """(doc_id, fp) per row, fp as a signed long; a null text counts as empty."""
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])

    def run(batches):
        return rows_of(text_slices(batches, 1), schema, lambda b: [b.column(0), fingerprints_of(bytes_of(b.column(1)), ngram).view(np.int64)])

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def block_masks(max_bits: int, keep: int) -> list[int]:
    """Masks of ``keep`` of ``max_bits + keep`` blocks each."""
    n = max_bits + keep
    edges = [64 * i // n for i in range(n + 1)]
    blocks = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:], strict=False)]
    return [sum(c) for c in combinations(blocks, keep)]


def _close(fps: np.ndarray, rows: np.ndarray, roots: np.ndarray | None, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (row, any) within ``max_bits``; with roots, only those of different components."""
    found = [(np.empty(0, np.int64), np.empty(0, np.int64))]
    step = max(1, (1 << 21) // max(1, len(fps)))
    for i in range(0, len(rows), step):
        part = rows[i : i + step]
        near = np.bitwise_count(fps[part, None] ^ fps[None, :]) <= max_bits
        if roots is not None:
            near &= roots[part, None] != roots[None, :]
        a, b = np.nonzero(near)
        a = part[a]
        if len(a) > 4 * len(fps):  # a forest of these says the same
            low = local_roots(len(fps), a, b)
            a = np.flatnonzero(low != np.arange(len(fps)))
            b = low[a]
        found.append((a, b))
    return np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])


def bucket_links(fps: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs that join the fingerprints of one bucket exactly as all its close pairs would."""
    if len(fps) <= PAIRWISE:
        return _close(fps, np.arange(len(fps)), None, max_bits)
    # Two that differ in two bits have a midpoint in common: linear in the bucket, whatever its size.
    vary = int(np.bitwise_or.reduce(fps) ^ np.bitwise_and.reduce(fps))
    flips = np.array([0] + [1 << k for k in range(64) if vary >> k & 1], np.uint64)
    points = (fps[:, None] ^ flips[None, :]).ravel()
    order = np.argsort(points, kind="stable")
    same = np.flatnonzero(points[order][1:] == points[order][:-1])
    a, b = order[same] // len(flips), order[same + 1] // len(flips)
    roots = local_roots(len(fps), a, b)
    top = np.bincount(roots).argmax()
    more = _close(fps, np.flatnonzero(roots != top), roots, max_bits)
    return np.concatenate([a, more[0]]), np.concatenate([b, more[1]])


def _forest(keys: np.ndarray, fps: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges (fp, smaller fp of its group) over sorted whole buckets."""
    if not len(fps):
        return fps.view(np.int64), fps.view(np.int64)
    cut = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1], True])
    sizes = np.diff(cut)
    small = np.repeat(np.where(sizes <= 24, sizes, 0), sizes)
    a, b = [], []
    place = np.arange(len(fps)) - np.repeat(cut[:-1], sizes)
    for s in range(1, int(small.max(initial=0))):
        i = np.flatnonzero(place + s < small)
        i = i[np.bitwise_count(fps[i] ^ fps[i + s]) <= max_bits]
        a.append(i)
        b.append(i + s)
    for k in np.flatnonzero(sizes > 24):
        x, y = bucket_links(fps[cut[k] : cut[k + 1]], max_bits)
        a.append(x + cut[k])
        b.append(y + cut[k])
    if not a:
        return fps[:0].view(np.int64), fps[:0].view(np.int64)
    a, b = fps[np.concatenate(a)], fps[np.concatenate(b)]
    nodes, back = np.unique(np.concatenate([a, b]).view(np.int64), return_inverse=True)
    roots = local_roots(len(nodes), back[: len(a)], back[len(a) :])
    child = np.flatnonzero(roots != np.arange(len(nodes)))
    return nodes[child], nodes[roots[child]]


def links(spark: SparkSession, distinct_fps: DataFrame, max_bits: int = 4, keep: int = 3) -> DataFrame:
    """Edges (u, v) between fingerprints (column fp) that join them as all pairs within ``max_bits`` would."""
    masks = block_masks(max_bits, keep)
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    keyed = F.array(*(F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("k")) for t, m in enumerate(signed)))
    table = distinct_fps.select("fp", F.explode(keyed).alias("b")).select(F.col("b.t").alias("t"), F.col("b.k").alias("k"), "fp")
    table = table.repartition(partitions(spark), "t", "k").sortWithinPartitions("t", "k", "fp")
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        rows = 0

        def flush(last: bool):
            nonlocal rows
            keys, fps = np.concatenate([k for k, _ in held]), np.concatenate([f for _, f in held])
            whole = len(keys) if last else int(np.flatnonzero(keys != keys[-1])[-1]) + 1 if (keys != keys[-1]).any() else 0
            held[:] = [(keys[whole:], fps[whole:])]
            rows = len(keys) - whole
            u, v = _forest(keys[:whole], fps[:whole].view(np.uint64), max_bits)
            return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], schema=schema)

        for batch in batches:
            t, k, fp = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            # t and k as one key: the order within a table stays, and neighbours of two tables never agree
            key = np.empty(len(t), [("t", np.int32), ("k", np.int64)])
            key["t"], key["k"] = t, k
            held.append((key, fp))
            rows += len(fp)
            if rows >= BUFFER_ROWS:
                before = rows
                yield flush(False)
                if rows > before // 2:  # one bucket fills the buffer: wait for its end
                    rows = -rows
        if held:
            yield flush(True)

    return table.mapInArrow(run, "u long, v long")


def near_duplicates(spark: SparkSession, df: DataFrame, id_col: str = "doc_id", text_col: str = "text", ngram: int = 4, max_bits: int = 4) -> DataFrame:
    """One row per row of ``df``: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable).

    Null and empty texts have fingerprint zero and link like any others. A row without a doc_id has a fingerprint and
    no component, and links nothing. Rows that repeat a doc_id are kept; other columns are not looked at.
    """
    fps = written(spark, fingerprints(df, id_col, text_col, ngram), "fingerprints")
    heads = written(spark, fps.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("head")), "heads")
    found = components(spark, links(spark, heads.select("fp"), max_bits))
    rooted = heads.join(found, heads.fp == found.node, "left").select("fp", "head", F.coalesce("root", "fp").alias("root"))
    lowest = rooted.groupBy("root").agg(F.min("head").alias("component_id"))
    of_fp = rooted.join(lowest, "root").select("fp", "component_id")
    out = fps.join(of_fp, "fp", "left")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def roots(spark: SparkSession, texts: DataFrame, ngram: int = 4, max_bits: int = 4) -> DataFrame:
    """(key, root) for each row (key, text) of ``texts``: equal roots for texts whose fingerprints a chain of links joins."""
    schema = pa.schema([("key", pa.string()), ("fp", pa.int64())])

    def run(batches):
        return rows_of(text_slices(batches, 1), schema, lambda b: [b.column(0), fingerprints_of(bytes_of(b.column(1)), ngram).view(np.int64)])

    fps = written(spark, texts.select("key", "text").mapInArrow(run, "key string, fp long"), "fingerprints")
    found = components(spark, links(spark, fps.select("fp").distinct(), max_bits))
    return fps.join(found, fps.fp == found.node, "left").select("key", F.coalesce("root", "fp").alias("root"))


def one_of_each(spark: SparkSession, df: DataFrame, roots: Callable[[SparkSession, DataFrame], DataFrame] = roots) -> DataFrame:
    """The rows of ``df`` (doc_id, text and any others) without near-duplicates: of each group the one with the smallest doc_id stays.

    Groups are those of ``roots``, which makes of rows (key, text) rows (key, root), with a root a group; by default by
    fingerprints. Null and empty texts are equal texts. Rows without a doc_id stay and speak for no other. Of rows that
    share the smallest doc_id of a group, one of the text whose digest is least stays; rows of one doc_id with texts of
    different groups are judged each in their own. An empty table gives an empty result.
    """
    key, own = "_gridcalc_key", F.col("doc_id").cast("long")
    keyed = df.withColumn(key, F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary"), 256))
    rows = keyed.where(own.isNotNull())
    of_key = roots(spark, rows.select(F.col(key).alias("key"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))).distinct()
    least = rows.groupBy(key).agg(F.min(own).alias("_gridcalc_id"))
    heads = least.join(of_key.withColumnRenamed("key", key), key).groupBy("root").agg(F.min(F.struct("_gridcalc_id", key)).alias("head"))
    heads = written(spark, heads.select("head._gridcalc_id", f"head.{key}"), "heads")
    staying = rows.join(heads, (rows[key] == heads[key]) & (own == heads["_gridcalc_id"]), "left_semi")
    return keyed.where(own.isNull()).unionByName(staying.dropDuplicates(["doc_id", key])).select(*df.columns)
