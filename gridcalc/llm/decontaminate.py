"""Benchmark decontamination: edit distance by CGK embedding, bit-sampling LSH over item-sized windows, exact verification.

Texts and items are sequences of lower-cased words. The CGK random walk copies the current word to the output and
advances by a random bit that depends on step and word; close sequences give outputs close in Hamming distance. Each
repetition draws another walk and samples SAMPLED of its outputs; equal samples of an item and a window of the item's
length make a candidate. Word edit distance decides, over all of a candidate's neighbourhood: an item is found where
some passage of the text is at a distance of at most (1 - similarity) times the item's length.

Windows that can't come that close are not walked: a window within d edits of an item has at least n - 1 - 2d of its
word pairs, counted over all items, and n - 2 - 3d of its word triples, counted over the items of one length.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridcalc.llm.common import bytes_of, kept, text_slices

SIMILARITY = 0.8
#: Outputs sampled of each walk, and walks: over 0.99 of passages at the largest distance meet (see the tests).
SAMPLED = 3
REPETITIONS = 40
#: Items are searched in blocks of this many, each a broadcast of bounded size.
ITEMS_AT_ONCE = 20_000
SLICE_BYTES = 4_000_000
WINDOWS_AT_ONCE = 512
_words = re.compile(r"\w+").findall
_LOW = np.uint64((1 << 22) - 1)
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def words(text: str) -> list[str]:
    return _words(text.lower())


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def walk(symbols: np.ndarray, starts: np.ndarray, ends: np.ndarray, steps: int, repetitions: int) -> np.ndarray:
    """CGK outputs (sequence, repetition, step) of symbols[start:end]; past the end the output is 0."""
    seeds = np.arange(repetitions, dtype=np.uint64) * np.uint64(1009) + np.uint64(1)
    at = np.repeat(starts[:, None], repetitions, axis=1)
    ends = ends[:, None]
    out = np.zeros((len(starts), repetitions, steps), np.uint64)
    for j in range(steps):
        inside = at < ends
        symbol = np.where(inside, symbols[np.minimum(at, len(symbols) - 1)], np.uint64(0))
        out[:, :, j] = symbol
        with np.errstate(over="ignore"):
            bit = _mixed(symbol + (seeds + np.uint64(j)) * _GOLD) >> np.uint64(63)
        at += bit.astype(np.int64) & inside
    return out


def _keys(outputs: np.ndarray, lengths: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """A hash of each walk's sampled outputs, with length and repetition; steps (sequence, repetition, sampled)."""
    repetitions = outputs.shape[1]
    with np.errstate(over="ignore"):
        key = np.asarray(lengths, np.uint64)[:, None] * _GOLD + np.arange(repetitions, dtype=np.uint64)[None, :] * np.uint64(0xC2B2AE3D27D4EB4F)
        picked = np.take_along_axis(outputs, steps, axis=2)
        for c in range(picked.shape[2]):
            key = _mixed(key * np.uint64(31) + picked[:, :, c])
    return key


def edits(pattern: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """Least edit distance of ``pattern`` to any stretch of ``text``, and that stretch (first of the best ends)."""
    n = len(text)
    cost, begin = np.zeros(n + 1, np.int64), np.arange(n + 1)
    ramp = np.arange(n + 1)
    for i, p in enumerate(pattern, 1):
        through = cost[:-1] + (text != p)
        drop = cost + 1
        best = np.r_[i, np.minimum(through, drop[1:])]
        start = np.r_[0, np.where(through <= drop[1:], begin[:-1], begin[1:])]
        # insertions: running minimum of best[j] - j
        low = np.minimum.accumulate(best - ramp)
        source = np.maximum.accumulate(np.where(best - ramp == low, ramp, 0))
        cost, begin = low + ramp, start[source]
    end = int(np.argmin(cost))
    return int(cost[end]), int(begin[end]), end


class Items:
    """The embedded items of one block: for each length its walks' keys, and all word pairs."""

    def __init__(self, items: list[tuple[int, str]], similarity: float = SIMILARITY, sampled: int = SAMPLED, repetitions: int = REPETITIONS):
        self.similarity, self.repetitions = similarity, repetitions
        self.code: dict[str, int] = {}
        self.sequences: list[tuple[int, np.ndarray]] = []
        for item_id, text in items:
            w = words(text or "")
            if w:
                self.sequences.append((item_id, np.fromiter((xxhash.xxh3_64_intdigest(x) for x in w), np.uint64, len(w))))
        self.by_length: dict[int, list[int]] = defaultdict(list)
        for k, (_, s) in enumerate(self.sequences):
            self.by_length[len(s)].append(k)
        self.grams = {g: np.unique(np.concatenate([self.gram_keys(s, g) for _, s in self.sequences] or [np.empty(0, np.uint64)])) for g in (2, 3)}
        self.sieve = {}
        for g, known in self.grams.items():
            self.sieve[g] = np.zeros(int(_LOW) + 1, bool)
            self.sieve[g][(known & _LOW).astype(np.int64)] = True
        self.lengths = np.array(sorted(self.by_length), np.int64)
        self.longest = int(self.lengths.max(initial=1))
        # of the items of each length, their runs of three
        self.of_length = [np.unique(np.concatenate([self.gram_keys(self.sequences[k][1], 3) for k in self.by_length[n]])) for n in self.lengths.tolist()]
        # the steps sampled for a length, of a walk that still runs among its words
        self.steps = np.array([[np.random.default_rng((int(n), r)).choice(max(sampled, int(n)), sampled, replace=False) for r in range(repetitions)] for n in self.lengths]).reshape(len(self.lengths), repetitions, sampled)
        self.steps = np.minimum(self.steps, self.longest - 1)
        keys, owners = [], []
        for c, n in enumerate(self.lengths.tolist()):
            members = np.array(self.by_length[n])
            flat = np.concatenate([self.sequences[k][1] for k in members])
            starts = np.arange(len(members), dtype=np.int64) * n
            for i in range(0, len(members), 256):
                part = starts[i : i + 256]
                mine = self.keys_of(flat, part, part + n, np.full(len(part), c))
                keys.append(mine.ravel())
                owners.append(np.repeat(members[i : i + 256], repetitions))
        self.keys = np.concatenate(keys) if keys else np.empty(0, np.uint64)
        order = np.argsort(self.keys, kind="stable")
        self.keys, self.owners = self.keys[order], np.concatenate(owners)[order] if owners else order

    def keys_of(self, symbols: np.ndarray, starts: np.ndarray, ends: np.ndarray, classes: np.ndarray) -> np.ndarray:
        """Keys (window, repetition) of windows whose length has the given place in ``lengths``."""
        outputs = walk(symbols, starts, ends, int(self.lengths[classes].max()), self.repetitions)
        steps = np.minimum(self.steps[classes], outputs.shape[2] - 1)
        return _keys(outputs, self.lengths[classes], steps)

    @staticmethod
    def gram_keys(s: np.ndarray, g: int) -> np.ndarray:
        """Keys of the runs of ``g`` words, one for each but the last g - 1."""
        n = max(0, len(s) - g + 1)
        key = np.zeros(n, np.uint64)
        with np.errstate(over="ignore"):
            for i in range(g):
                key = _mixed(key * np.uint64(3) + s[i : i + n] * _GOLD)
        return key

    def known_grams(self, symbols: np.ndarray, document: np.ndarray, g: int) -> np.ndarray:
        """How many of the runs of ``g`` words that start before each place are an item's."""
        hit = np.zeros(len(symbols) + 1, np.int64)
        keys, known = self.gram_keys(symbols, g), self.grams[g]
        if len(keys) and len(known):
            maybe = np.flatnonzero(self.sieve[g][(keys & _LOW).astype(np.int64)])
            place = np.minimum(np.searchsorted(known, keys[maybe]), len(known) - 1)
            sure = maybe[known[place] == keys[maybe]]
            hit[sure[document[sure] == document[sure + g - 1]] + 1] = 1
        return np.cumsum(hit)

    def need(self, n: int, g: int) -> int:
        """Runs of ``g`` words that a window of an item of ``n`` words shares with it at least."""
        return n - (g - 1) - g * self.allowed(n)

    def allowed(self, n: int) -> int:
        return int(math.floor((1 - self.similarity) * n + 1e-9))

    def search(self, symbols: np.ndarray, bounds: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """(document, item, distance, first word, word after the last) over documents symbols[bounds[d]:bounds[d+1]]."""
        if not len(symbols) or not self.sequences:
            return []
        document = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        end_of = bounds[1:][document]
        hits = {g: self.known_grams(symbols, document, g) for g in (2, 3)}
        windows, classes = [], []
        rows = np.arange(len(symbols))
        # first, at once for all lengths of which every window shares a run of three: places before enough of those
        least = min((self.need(n, 3) for n in self.lengths.tolist() if self.need(n, 3) > 0), default=1)
        stop = np.minimum(rows + self.longest + int(self.allowed(self.longest)), end_of)
        likely = np.flatnonzero(hits[3][stop] - hits[3][:-1] >= least)
        threes = np.flatnonzero(np.diff(hits[3]))
        keys = self.gram_keys(symbols, 3)[threes]
        for c, n in enumerate(self.lengths.tolist()):
            starts = rows
            if (need := self.need(n, 3)) > 0:
                starts, own = likely, self.of_length[c]
                at = threes[own[np.minimum(np.searchsorted(own, keys), len(own) - 1)] == keys]
                starts = starts[np.searchsorted(at, np.minimum(starts + n, end_of[starts]) - 2) - np.searchsorted(at, starts) >= need]
            for g, hit in hits.items():
                if (need := self.need(n, g)) > 0:
                    last = np.maximum(np.minimum(starts + n, end_of[starts]) - (g - 1), starts)
                    starts = starts[hit[last] - hit[starts] >= need]
            starts = starts[end_of[starts] - starts >= n - self.allowed(n)]
            windows.append(starts)
            classes.append(np.full(len(starts), c))
        windows, classes = np.concatenate(windows), np.concatenate(classes)
        grouped: dict[tuple[int, int], set[int]] = defaultdict(set)
        for i in range(0, len(windows), WINDOWS_AT_ONCE):
            w, c = windows[i : i + WINDOWS_AT_ONCE], classes[i : i + WINDOWS_AT_ONCE]
            mine = self.keys_of(symbols, w, np.minimum(w + self.lengths[c], end_of[w]), c).ravel()
            lo, hi = np.searchsorted(self.keys, mine, "left"), np.searchsorted(self.keys, mine, "right")
            for x in np.flatnonzero(hi > lo).tolist():
                start = int(w[x // self.repetitions])
                for k in self.owners[lo[x] : hi[x]].tolist():
                    grouped[int(document[start]), k].add(start)
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        for (doc, k), places in grouped.items():
            item_id, seq = self.sequences[k]
            d, n = self.allowed(len(seq)), len(seq)
            low, high, left = int(bounds[doc]), int(bounds[doc + 1]), sorted(places)
            while left:  # neighbouring windows share one stretch
                j = 1
                while j < len(left) and left[j] - left[j - 1] <= n:
                    j += 1
                a, b = max(low, left[0] - d), min(high, left[j - 1] + n + 2 * d)
                left = left[j:]
                cost, first, end = edits(seq, symbols[a:b])
                if cost <= d:
                    got = (cost, a + first - low, a + end - low)
                    if (doc, item_id) not in best or got < best[doc, item_id]:
                        best[doc, item_id] = got
        return [(doc, item, *rest) for (doc, item), rest in best.items()]


class Searcher:
    """Finds items in whole texts; the hashes of words seen before are looked up."""

    def __init__(self, items: Items):
        self.items, self.hashes = items, {}

    def search(self, texts: list[str]) -> list[tuple[int, int, int, int, int]]:
        found, flat, counts, first, held = [], [], [], 0, 0

        def flush() -> None:
            nonlocal first
            hashes = self.hashes
            if len(hashes) > 500_000:
                hashes.clear()
            for w in set(flat).difference(hashes):
                hashes[w] = xxhash.xxh3_64_intdigest(w)
            symbols = np.fromiter(map(hashes.__getitem__, flat), np.uint64, len(flat))
            bounds = np.r_[0, np.cumsum(counts)].astype(np.int64)
            found.extend((d + first, *rest) for d, *rest in self.items.search(symbols, bounds))
            first += len(counts)
            flat.clear()
            counts.clear()

        for t in texts:
            if counts and held + len(t) > SLICE_BYTES:
                flush()
                held = 0
            w = words(t)
            flat += w
            counts.append(len(w))
            held += len(t)
        if counts:
            flush()
        return found


def _blocks(spark: SparkSession, benchmark: DataFrame, similarity: float):
    """Broadcasts of the items, about ITEMS_AT_ONCE in each."""
    items = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).where("item_id is not null and text is not null")
    blocks = max(1, math.ceil(items.count() / ITEMS_AT_ONCE))
    for block in range(blocks):
        part = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block)
        yield spark.sparkContext.broadcast(Items(sorted(tuple(r) for r in part.collect()), similarity))


def matches(spark: SparkSession, documents: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One row for each document and benchmark item that it holds: doc_id, item_id, distance, first_word, end_word.

    Null and empty texts and items hold nothing and are held by nothing. A null doc_id is kept as null; rows that repeat
    a doc_id give a row each. Every item with an item_id is searched in every whole text.
    """
    schema = pa.schema([(c, pa.int64()) for c in ("doc_id", "item_id", "distance", "first_word", "end_word")])
    text = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = None
    for known in _blocks(spark, benchmark, similarity):

        def run(batches: Iterator[pa.RecordBatch], known=known) -> Iterator[pa.RecordBatch]:
            searcher = Searcher(known.value)
            for batch in text_slices(batches, 1):
                ids = batch.column(0).to_pylist()
                rows = [(ids[d], *rest) for d, *rest in searcher.search([t.decode() for t in bytes_of(batch.column(1))])]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], schema=schema)

        found = text.mapInArrow(run, "doc_id long, item_id long, distance long, first_word long, end_word long")
        out = found if out is None else out.union(found)
    return out


def clean(spark: SparkSession, documents: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``documents`` that hold no benchmark item, with all their columns; items without an item_id count too."""
    for known in _blocks(spark, benchmark.withColumn("item_id", F.coalesce(F.col("item_id").cast("long"), F.lit(-1))), similarity):

        def start(known=known):
            searcher = Searcher(known.value)

            def test(texts: list[bytes]) -> np.ndarray:
                keep = np.ones(len(texts), bool)
                keep[[d for d, *_ in searcher.search([t.decode() for t in texts])]] = False
                return keep

            return test

        documents = kept(documents, start)
    return documents
