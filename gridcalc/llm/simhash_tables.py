"""SimHash for similar shingle sets: wide fingerprints, tables on sampled bits, Hamming verification.

A bit of a fingerprint is 1 if over half of a set's distinct shingles vote for it, as in :mod:`simhash`, with 1,024 bits
of sixteen hashes for its 64: sets at a similarity of 0.8 differ in 15% of the bits, 10 of 64, too many for whole blocks.
Each table is keyed by some of the bits. Inside a bucket, fingerprints are linked by a spanning forest if their first
256 bits differ in few enough. Bits, tables and distance are such that a pair at the threshold fails to meet with a
probability of 6e-6 at most, also for the worst of small sets, where ties of votes make bits differ more often.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from math import comb, floor

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from gridcalc.llm.common import partitions
from gridcalc.llm.components import local_roots
from gridcalc.llm.simhash import _LANES

#: Words of 64 bits of a fingerprint, and how many of them are compared.
WORDS, CHECKED = 16, 4
#: Probabilities that a pair at the threshold shares no table, and that it is too far apart.
TABLE_MISS, DISTANCE_MISS = 5e-6, 1e-6
#: Members of a usual bucket at most (so many are one table), and bits of a key at least where there are more.
BUCKET, MIN_BITS = 2048, 10
#: Sets under this size, and all that may be similar to one, have tables of their own.
SMALL = 5
#: Shingles that vote at a time; pairs that are compared at a time; rows gathered before buckets are compared.
_STEP, PAIRS, BUFFER_ROWS = 255 * 16, 1 << 18, 1 << 16
_SALTS = np.random.default_rng(1).integers(0, 1 << 63, WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def wide_fingerprint(hashes: np.ndarray) -> np.ndarray:
    """The fingerprint of a set of shingle hashes, as words; zero for an empty set."""
    counts = np.zeros((WORDS, 64), np.int64)
    for i in range(0, len(hashes), _STEP):
        votes = _mixed(hashes[None, i : i + _STEP] + _SALTS[:, None])
        lanes = _LANES[votes.view(np.uint8).reshape(WORDS, -1, 8)]
        counts += np.add.reduceat(lanes, np.arange(0, votes.shape[1], 255), axis=1).view(np.uint8).reshape(WORDS, -1, 64).sum(1, dtype=np.int64)
    return np.packbits(counts * 2 > len(hashes), axis=1, bitorder="little").view(np.uint64).ravel()


def agreement(common: int, a: int, b: int) -> float:
    """The probability that a bit is the same for two sets that share ``common`` shingles and have ``a`` and ``b`` of their own."""
    shared, own_a, own_b = (np.array([comb(n, k) for k in range(n + 1)]) / 2.0**n for n in (common, a, b))
    total = 0.0
    for k, q in enumerate(shared):
        x, y = (own[2 * (k + np.arange(n + 1)) > common + n].sum() for n, own in ((a, own_a), (b, own_b)))
        total += q * (x * y + (1 - x) * (1 - y))
    return float(total)


@cache
def least_agreement(threshold: float, smallest: int) -> float:
    """The least :func:`agreement` of unequal sets of ``smallest`` shingles or more at a similarity of ``threshold`` or more.

    Sets that share more than 40 shingles are left to the limit, 1 - acos(2t / (1 + t)) / pi, less 0.003 (at 0.8 they lose 0.002 of it).
    """
    found = 1 - np.arccos(2 * threshold / (1 + threshold)) / np.pi - 0.003
    for common in range(1, 41):
        for both in range(1, floor(common / threshold) - common + 2):
            if common >= threshold * (common + both):
                found = min([found, *(agreement(common, both - b, b) for b in range(both // 2 + 1) if common + b >= smallest)])
    return float(found)


def _differing(n: int, p: float) -> np.ndarray:
    """Probabilities of 0 to n bits of n that differ."""
    logs = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, n + 1)))])
    d = np.arange(n + 1)
    return np.exp(logs[n] - logs[d] - logs[n - d] + d * np.log(1 - p) + (n - d) * np.log(p))


def table_count(p: float, bits: int) -> int:
    """Tables on ``bits`` bits of which a pair whose bits agree with probability ``p`` misses all with TABLE_MISS at most."""
    if not bits:
        return 1
    n = 64 * WORDS
    d = np.arange(n + 1)
    meets = np.prod([np.clip(n - d - i, 0, None) / (n - i) for i in range(bits)], axis=0)
    count = 1
    while _differing(n, p) @ (1 - meets) ** count > TABLE_MISS:
        count += 1
    return count


def max_distance(p: float) -> int:
    """The most of the checked bits that differ, but for a probability of DISTANCE_MISS."""
    over = 1 - np.cumsum(_differing(64 * CHECKED, p))
    return int(np.flatnonzero(over <= DISTANCE_MISS)[0])


def distances(threshold: float) -> tuple[int, int]:
    """The distance of pairs in which both sets have SMALL shingles or more, and of others."""
    return max_distance(least_agreement(threshold, SMALL)), max_distance(least_agreement(threshold, 1))


def apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """In how many of the checked bits fingerprints (words on the last axis) differ."""
    return sum(np.bitwise_count(a[..., i] ^ b[..., i]).astype(np.int16) for i in range(CHECKED))


def key_bits(n: int) -> int:
    """Bits of a key for ``n`` fingerprints."""
    return 0 if n <= BUCKET else max(MIN_BITS, int(np.ceil(np.log2(n / BUCKET))))


def sampled_bits(tables: int, bits: int) -> np.ndarray:
    """A row of bit places for each table; each place serves once before any serves again."""
    rng = np.random.default_rng(2)
    rounds = [rng.permutation(64 * WORDS) for _ in range(-(-tables // (64 * WORDS // bits)))] if bits else []
    rows = [r[: len(r) // bits * bits].reshape(-1, bits) for r in rounds]
    return np.concatenate(rows)[:tables] if rows else np.empty((tables, 0), np.int64)


def _near(words: np.ndarray, rows: np.ndarray, roots: np.ndarray | None, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (row, any) within the distance as a forest; with roots, only those of different components."""
    a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    step = max(1, PAIRS // max(1, len(words)))
    for i in range(0, len(rows), step):
        part = rows[i : i + step]
        near = apart(words[part, None], words[None, :]) <= distance
        near &= part[:, None] > np.arange(len(words)) if roots is None else roots[part, None] != roots[None, :]
        x, y = np.nonzero(near)
        if len(x) > len(words):
            low = local_roots(len(words), part[x], y)
            child = np.flatnonzero(low != np.arange(len(words)))
            a.append(child)
            b.append(low[child])
        else:
            a.append(part[x])
            b.append(y)
    return np.concatenate(a), np.concatenate(b)


def bucket_roots(words: np.ndarray, distance: int) -> np.ndarray:
    """For each fingerprint of a bucket the least index that a chain of pairs within the distance joins to it."""
    n = len(words)
    if n <= BUCKET:
        a, b = _near(words, np.arange(n), None, distance)
        return local_roots(n, a, b) if len(a) else np.arange(n)
    # What lies near a few pivots is joined in linear time; who stays outside the commonest component meets all.
    free = np.ones(n, bool)
    a, b = [], []
    for _ in range(32):
        if not free.any():
            break
        pivot = int(free.argmax())
        near = np.flatnonzero(apart(words, words[pivot]) <= distance)
        free[near] = False
        a.append(near)
        b.append(np.full(len(near), pivot))
    a, b = np.concatenate(a), np.concatenate(b)
    roots = local_roots(n, a, b)
    top = np.bincount(roots).argmax()
    more = _near(words, np.flatnonzero(roots != top), roots, distance)
    return local_roots(n, np.concatenate([a, more[0]]), np.concatenate([b, more[1]]))


def links(spark: SparkSession, prints: DataFrame, threshold: float = 0.8, bits: int | None = None) -> DataFrame:
    """Edges (u, v) that join rows (sid, n, words), of distinct sids, as all pairs that share a table and lie within the distance would.

    ``n`` is a set's size and ``words`` its :func:`wide_fingerprint` as longs; ``bits`` of a key follow the number of rows.
    """
    if bits is None:
        bits = key_bits(prints.count())
    usual, least = least_agreement(threshold, SMALL), least_agreement(threshold, 1)
    usual_tables, small_tables = table_count(usual, bits), table_count(least, bits)
    places = sampled_bits(usual_tables + small_tables, bits)
    top_small = floor((SMALL - 1) / threshold)
    row_schema = pa.schema([("key", pa.int64()), ("sid", pa.int64()), *((f"w{i}", pa.int64()) for i in range(CHECKED))])
    edge_schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])
    limits = distances(threshold)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = 1 << np.arange(bits, dtype=np.int64)
        for batch in (whole.slice(i, 500) for whole in batches for i in range(0, whole.num_rows, 500)):
            sid, n = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(2))
            words = batch.column(2).flatten().to_numpy().reshape(-1, WORDS)
            ones = np.unpackbits(np.ascontiguousarray(words).view(np.uint8), axis=1, bitorder="little")
            for own, first, last in ((n >= SMALL, 0, usual_tables), (n <= top_small, usual_tables, len(places))):
                at = np.flatnonzero(own)
                if len(at):
                    keys = np.concatenate([(t << 40) + ones[at][:, places[t]] @ powers for t in range(first, last)])
                    rows = np.tile(at, last - first)
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (keys, sid[rows], *words[rows, :CHECKED].T)], schema=row_schema)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        rows, wait = 0, BUFFER_ROWS

        def flush(last: bool) -> pa.RecordBatch:
            table = np.concatenate(held)
            cut = np.flatnonzero(np.r_[True, table[1:, 0] != table[:-1, 0], True])
            if not last:
                cut = cut[:-1]
            held[:] = [table[cut[-1] :]]
            u, v = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            for x, y in zip(cut, cut[1:], strict=False):
                if y - x > 1:
                    sids = table[x:y, 1]
                    roots = bucket_roots(table[x:y, 2:].view(np.uint64), limits[int(table[x, 0] >> 40 >= usual_tables)])
                    child = np.flatnonzero(roots != np.arange(y - x))
                    u.append(sids[child])
                    v.append(sids[roots[child]])
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(u)), pa.array(np.concatenate(v))], schema=edge_schema)

        for batch in batches:
            if batch.num_rows:
                held.append(np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], axis=1))
                rows += batch.num_rows
            if rows >= wait:
                yield flush(False)
                rows = len(held[0])
                wait = max(BUFFER_ROWS, 2 * rows)  # a bucket that fills the buffer is awaited
        if held:
            yield flush(True)

    dealt = prints.select("sid", "n", "words").mapInArrow(deal, "key long, sid long, " + ", ".join(f"w{i} long" for i in range(CHECKED)))
    dealt = dealt.repartition(partitions(spark), "key").sortWithinPartitions("key", "sid")
    return dealt.mapInArrow(compare, "u long, v long")
