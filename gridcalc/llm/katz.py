"""Language-model scores by Katz backoff over word sequences of ORDER words, with Good-Turing discounts and exact backoff weights.

p(w | h) = d(c) c(h, w) / c(h) for a sequence seen in training, else alpha(h) p(w | h'), h' being h without its first
word; p(w) = d(c) c(w) / N for a seen word, and the mass left is that of one unknown word. alpha(h) is exactly what
makes the probabilities after h sum to one. Discounts are Good-Turing's by the counts of counts of each length. A
context never seen passes to h'. Each text begins in a context of its own and ends in an end token.

Texts are coded once, in chunks. A chunk sends each partition of a table what it needs to know and has counted: its
distinct words, then its distinct sequences by their context's last word, with a dictionary of the words named. The
partition adds up all orders and answers in the order asked: counts, and for each context how many words were seen once,
twice and so on after it, there and in the next shorter context. These integers are all that alpha takes, and they add
up. Words are 64-bit hashes at first; their partitions number them, frequent ones first, and the numbers take fewer bytes.
A context too frequent for one partition is dealt by the following word instead, its sums are added over the
partitions, and longer sequences behind it follow in a round of their own, by two words of their context, and so on.
What travels is at most a row for each distinct sequence of a chunk, and a few bytes each.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridcalc.llm.common import bytes_of, fresh_path, open_fs, partitions, put_file, text_slices
from gridcalc.llm.labelled import remainder

ORDER = 3
CHUNK_TOKENS = 1_800_000
#: Tokens whose sequences one partition adds up, about.
PARTITION_TOKENS = 3_000_000
#: A context so frequent is dealt over partitions, and at most so many of an order are.
HOT_TOKENS, HOT_CONTEXTS = 3_000_000, 50_000
#: Counts up to this are discounted.
SMALL = 5
#: Counts of counts that Good-Turing's smoothing is fitted to.
FITTED = 24
#: Words can't hold blanks: these are no words.
BEGIN, END = b" begin", b" end"
_GOLD = np.uint64(0x9E3779B97F4A7C15)
_R = np.arange(1, SMALL + 1)
#: What a summary row tells: counts of counts, a frequent sequence, a frequent context's sums, totals.
COUNTS, FREQUENT, SUMS, TOTALS = range(4)


def word_hash(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word)


def turing(n: np.ndarray) -> np.ndarray | None:
    """Katz's factors for counts 0..SMALL from n[r], the number of kinds seen r times; None if one is not between zero and one."""
    if (n[1 : SMALL + 2] <= 0).any():
        return None
    tail = (SMALL + 1) * n[SMALL + 1] / n[1]
    if tail >= 1:
        return None
    d = np.r_[1.0, ((_R + 1) * n[_R + 1] / n[_R] / _R - tail) / (1 - tail)]
    return d if ((d[1:] > 0) & (d[1:] < 1)).all() else None


def discounts(n: np.ndarray) -> np.ndarray:
    """Factors for counts 0..SMALL: Good-Turing's from the counts of counts as they are, where these give factors between
    zero and one, else from their log-linear fit (each averaged over the gap to its neighbours).

    Where there is nothing to fit, or it falls no faster than 1/r (very few data), (r - 1/2) / r.
    """
    n = np.asarray(n, float)
    d = turing(n)
    if d is not None:
        return d
    r = np.flatnonzero(n[: FITTED + 1] > 0)
    r = r[r > 0]
    if len(r) >= 3:
        before, after = np.r_[0, r[:-1]], np.r_[r[1:], 2 * r[-1] - r[-2]]
        slope, level = np.polyfit(np.log(r), np.log(n[r] * 2 / (after - before)), 1, w=np.sqrt(n[r]))
        if slope < -1:
            d = turing(np.r_[0, np.exp(level + slope * np.log(np.arange(1, SMALL + 2)))])
            if d is not None:
                return d
    return np.r_[1.0, (_R - 0.5) / _R]


class Unigrams:
    """p(w) by count."""

    def __init__(self, n: np.ndarray, tokens: int):
        self.d, self.tokens = discounts(n), tokens
        lost = float(((1 - self.d[1:]) * _R * n[1 : SMALL + 1]).sum())
        if tokens and lost <= 0:  # every word is frequent: an unknown one has half a count
            lost = 0.5
            self.scale = (tokens - lost) / tokens
        else:
            self.scale = 1.0
        self.unknown = lost / tokens if tokens else 1.0

    def p(self, c: np.ndarray) -> np.ndarray:
        c = np.asarray(c, np.int64)
        return np.where(c > 0, discounted(self.d, c) * self.scale / max(1, self.tokens), self.unknown)


def discounted(d: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.where(c <= SMALL, d[np.minimum(c, SMALL)], 1.0) * c


def _weighed(d: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """Discounted counts from rows of (kinds counted 1, ..., SMALL times, counts of the others)."""
    return sums[:, :SMALL] @ (d[1:] * _R) + sums[:, SMALL]


def chain(d: list[np.ndarray], unigrams: Unigrams, words: np.ndarray, steps: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """p of sequences, from the counts of their last words and for each longer sequence (its counts, its contexts' sums).

    d: factors by length. Sums: after the context the kinds of words by their counts there, and by those in the next
    shorter context; see :func:`_weighed`.
    """
    p, each, d_low = unigrams.p(words), np.full(len(words), unigrams.scale / max(1, unigrams.tokens)), unigrams.d
    for d_own, (c, sums) in zip(d, steps, strict=True):
        own, low = sums[:, : SMALL + 1], sums[:, SMALL + 1 :]
        count, used = own[:, :SMALL] @ _R + own[:, SMALL], _weighed(d_own, own)
        some = count > 0
        # nothing discounted (all sequences frequent): half a count is set aside
        scale = np.where(used > count - 1e-9, (count - 0.5) / np.maximum(used, 1e-300), 1.0)
        now = scale / np.maximum(count, 1)
        left = 1 - used * now
        alpha = np.where(some, left / np.maximum(1 - _weighed(d_low, low) * each, 1e-300), 1.0)
        p = np.where(c > 0, discounted(d_own, c) * now, alpha * p)
        each, d_low = now, d_own
    return p


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of numbers from zero by their first bytes, their second bytes and so on, compressed; unsigned ones come back so."""
    head, body = [struct.pack("<B", len(arrays))], []
    for a in arrays:
        most = int(a.max(initial=0))
        width = next(w for w in (1, 2, 3, 4, 5, 8) if w == 8 or most < 1 << 8 * w)
        head.append(struct.pack("<BBQ", width, a.dtype == np.uint64, len(a)))
        body.append(np.ascontiguousarray(a, "<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes())
    return b"".join(head) + zstandard.ZstdCompressor(level=1).compress(b"".join(body))


def unpack(data: bytes) -> list[np.ndarray]:
    n, out, at = data[0], [], 0
    body = zstandard.ZstdDecompressor().decompress(memoryview(data)[1 + 10 * n :])
    for k in range(n):
        width, unsigned, size = struct.unpack_from("<BBQ", data, 1 + 10 * k)
        wide = np.zeros((size, 8), np.uint8)
        wide[:, :width] = np.frombuffer(body, np.uint8, size * width, at).reshape(width, size).T
        at += size * width
        out.append(wide.view("<u8" if unsigned else "<i8").ravel())
    return out


def distinct(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rank of each key among the distinct ones, and a place of each of these."""
    order = np.argsort(key)
    key = key[order]
    new = np.ones(len(key), bool)
    np.not_equal(key[1:], key[:-1], out=new[1:])
    del key
    back = np.empty(len(order), np.int64)
    back[order] = np.cumsum(new) - 1
    return back, order[new]


def _part(hashes: np.ndarray, n: int) -> np.ndarray:
    """The partition of each hash, by its place in the range of hashes."""
    return ((hashes >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def folded(words: list[np.ndarray]) -> np.ndarray:
    """A hash of each sequence of word numbers, the last word first."""
    key = np.zeros(len(words[0]), np.uint64)
    with np.errstate(over="ignore"):
        for w in words:
            key = (key ^ (key >> np.uint64(31))) * _GOLD + w.astype(np.uint64) + np.uint64(1)
            key = (key ^ (key >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            key ^= key >> np.uint64(32)
    return key


def _slices(parts: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(part, from, to) of sorted parts."""
    cut = np.flatnonzero(np.r_[True, parts[1:] != parts[:-1], True]) if len(parts) else np.array([0])
    for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
        yield int(parts[a]), a, b


def _heads(context: np.ndarray) -> np.ndarray:
    """Which rows begin a run."""
    return np.r_[True, context[1:] != context[:-1]] if len(context) else np.empty(0, bool)


def contexts(columns: Iterable[np.ndarray], size: int) -> np.ndarray:
    """Ranks of contexts, by their last word, then the one before and so on."""
    out = None
    for c in columns:
        out = c.astype(np.int64) if out is None else distinct(out * size + c)[0]
    return out


class Chunk:
    """A chunk of coded texts, each with ``order`` - 1 beginnings before it."""

    def __init__(self, body: bytes, order: int):
        self.order = order
        self.hashes, self.own, self.lengths, self.codes, self.held = unpack(body)
        self.by_hash = np.argsort(self.hashes)

    def sequences(self, counts: np.ndarray, numbers: np.ndarray) -> None:
        """Distinct sequences in the order of contexts and words: ``before[k]`` is the word k + 1 places before ``word``.

        Words go by their rank among the chunk's ``numbers``; these and their counts are told in the order of hashes.
        """
        by_number = np.argsort(numbers)
        self.counts, self.numbers = counts[by_number], numbers[by_number]
        rank = np.empty(len(numbers), np.int32)
        rank[self.by_hash[by_number]] = np.arange(len(numbers))
        first = np.zeros(len(self.codes), bool)
        starts = np.cumsum(self.lengths) - self.lengths
        for k in range(self.order - 1):
            first[starts + k] = True
        at = np.flatnonzero(~first)
        code = rank[self.codes]
        back, where = distinct(contexts((code[at - k] for k in range(1, self.order)), len(numbers)) * len(numbers) + code[at])
        self.back, at = back.astype(np.int32), at[where]
        self.word, self.before = code[at], [code[at - k] for k in range(1, self.order)]
        learnt = np.repeat(self.held == 0, self.lengths - (self.order - 1))
        self.seen = np.bincount(self.back[learnt], minlength=len(where))

    def ask_words(self, n: int) -> Iterator[tuple[int, bytes]]:
        hashes, own = self.hashes[self.by_hash], self.own[self.by_hash]
        for part, a, b in _slices(_part(hashes, n)):
            yield part, pack(np.diff(hashes[a:b], prepend=np.uint64(0)), own[a:b])

    def rounds(self, n: int, hot_from: int, heavy: dict[int, np.ndarray], last: int) -> Iterator[tuple]:
        """For each round j, by what it asks: j, rows of sequences and their parts, in order; for frequent contexts the same
        of shortened sequences, with their rows, and the shortened sequence of each row."""
        who = np.arange(len(self.word))
        for j in range(2, last + 1):
            key = folded([self.numbers[c[who]] for c in self.before[: j - 1]])
            hot = self.counts[self.before[0][who]] >= hot_from if j == 2 else np.isin(key, heavy[j - 1])
            cold = who[~hot]
            part = _part(key[~hot], n)
            by_part = np.argsort(part.astype(np.min_scalar_type(n)), kind="stable")
            who, key = who[hot], key[hot]
            short = contexts([c[who] for c in self.before[: j - 1]], len(self.numbers)) * len(self.numbers) + self.word[who]
            short, where = distinct(short)
            dealt = n + _part(folded([self.numbers[self.word[who[where]]]]), n)
            by_word = np.argsort(dealt.astype(np.min_scalar_type(2 * n)), kind="stable")
            place = np.empty(len(by_word), np.int64)
            place[by_word] = np.arange(len(by_word))
            yield j, cold[by_part], part[by_part], who, key, place[short], where[by_word], dealt[by_word]

    def ask(self, rows: np.ndarray, seen: np.ndarray, length: int, base: np.ndarray | None) -> bytes:
        """What one part is told: the words named, sequences of ``length`` words, training counts, counts one shorter."""
        columns = [self.word[rows], *(c[rows] for c in self.before[: length - 1])]
        words, local = np.unique(np.concatenate(columns), return_inverse=True)
        word, nearest, *rest = np.split(local, length)
        told = [np.diff(self.numbers[words], prepend=0), self.counts[words], word, np.diff(nearest, prepend=0), *rest, seen]
        return pack(*told) if base is None else pack(*told, base)


def add_words(part: int, blobs: list[bytes], begin: int, n: int) -> tuple[list[bytes], list[tuple]]:
    """Adds up a partition's words and numbers them: part, part + n and so on, by falling counts."""
    sent = [unpack(b) for b in blobs]
    kinds, back = np.unique(np.concatenate([np.cumsum(h, dtype=np.uint64) for h, _ in sent]), return_inverse=True)
    total = np.bincount(back, np.concatenate([c for _, c in sent]), len(kinds)).astype(np.int64)
    number = np.empty(len(kinds), np.int64)
    number[np.argsort(-total, kind="stable")] = np.arange(len(kinds)) * n + part
    own, its = total[kinds != begin], kinds == begin
    totals = [int(own.sum()), int((own > 0).sum()), int(total[its].sum()), int(number[its].sum())]
    ends = np.cumsum([len(h) for h, _ in sent])
    return [pack(total[x], number[x] // n) for x in np.split(back, ends[:-1])], [(COUNTS, 1, 0, _counts_of(own)), (TOTALS, 0, 0, totals)]


def _counts_of(total: np.ndarray) -> list[int]:
    return np.bincount(np.minimum(total, FITTED + 1), minlength=FITTED + 2).tolist()


def _sums(context: np.ndarray, size: int, total: np.ndarray, low: np.ndarray) -> np.ndarray:
    out = np.empty((size, 2 * SMALL + 2), np.int32 if max(total.sum(), low.sum()) < 1 << 31 else np.int64)
    for k, c in enumerate((total, low)):
        c = np.where(total > 0, c, 0)
        for r in range(1, SMALL + 1):
            out[:, k * (SMALL + 1) + r - 1] = np.bincount(context[c == r], minlength=size)
        out[:, k * (SMALL + 1) + SMALL] = np.bincount(context, np.where(c > SMALL, c, 0), size)
    return out


def add_sequences(blobs: list[bytes], first: int, length: int, hot: bool, order: int, hot_from: int) -> tuple[list[bytes], list[tuple]]:
    """Adds up a partition: sequences of ``first`` to ``length`` words; the answers, and what all partitions sum."""
    sent = [unpack(b) for b in blobs]
    numbers, names = np.unique(np.concatenate([np.cumsum(s[0]) for s in sent]), return_inverse=True)
    size, starts = len(numbers), np.cumsum([0] + [len(s[0]) for s in sent])
    names = names.astype(np.int32)
    word_counts = np.zeros(size, np.int64)
    word_counts[names] = np.concatenate([s[1] for s in sent])

    def column(k: int) -> np.ndarray:
        return names[np.concatenate([(np.cumsum(s[k]) if k == 3 else s[k]) + at for s, at in zip(sent, starts, strict=False)])]

    word, before = column(2), [column(k) for k in range(3, 2 + length)]
    seen = np.concatenate([s[2 + length] for s in sent])
    low = word_counts[word] if first == 2 else np.concatenate([s[3 + length] for s in sent])
    ends = np.cumsum([len(s[2]) for s in sent])
    del sent
    answers: list[list[np.ndarray]] = [[] for _ in blobs]
    rows: list[tuple] = []
    context = distinct(contexts(before[: first - 1], size))[0]  # wide: products of two names follow
    for k in range(first, length + 1):
        if k > first:
            context = distinct(context * size + before[k - 2])[0]
        back, where = distinct(context * size + word)
        total = np.bincount(back, seen, len(where)).astype(np.int64)
        sums = _sums(context[where], int(context.max()) + 1, total, low[where])
        rows.append((COUNTS, k, 0, _counts_of(total)))
        if k < order:
            many = where[total >= hot_from]
            rows += [(FREQUENT, k, int(h), []) for h in folded([numbers[c[many]] for c in (word, *before[: k - 1])]).view(np.int64)]
        if hot:
            _, some = distinct(context)
            rows += [(SUMS, k, int(h), s) for h, s in zip(folded([numbers[c[some]] for c in before[: k - 1]]).view(np.int64).tolist(), sums.tolist(), strict=True)]
        for mine, a, b in zip(answers, np.r_[0, ends[:-1]].tolist(), ends.tolist(), strict=True):
            mine.append(total[back[a:b]])
            if not hot:
                own = context[a:b]
                mine.append(sums[own[_heads(own)]].T.ravel())
        low = total[back]
    return [pack(*a) for a in answers], rows


def chunks(spark: SparkSession, docs: DataFrame, folder: str, order: int) -> DataFrame:
    """Coded texts: chunk, tokens, the packed body (see :class:`Chunk`) and the documents' ids."""
    arrow = pa.schema([("chunk", pa.int64()), ("tokens", pa.int64()), ("body", pa.binary()), ("docs", pa.list_(pa.int64()))])
    pad = [BEGIN] * (order - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        known: dict[bytes, int] = {}
        codes: list[np.ndarray] = []
        ids: list[pa.Array] = []
        held: list[np.ndarray] = []
        lengths: list[int] = []
        total = 0

        def chunk() -> pa.RecordBatch:
            nonlocal number, total
            code, length, mark = np.concatenate(codes), np.array(lengths, np.int64), np.concatenate(held)
            hashes = np.fromiter(map(word_hash, known), np.uint64, len(known))
            # codes by frequency, so that most are small
            ranked = np.argsort(-np.bincount(code, minlength=len(hashes)), kind="stable")
            rank = np.empty(len(hashes), np.uint32)
            rank[ranked] = np.arange(len(hashes))
            counts = np.bincount(code[np.repeat(~mark, length)], minlength=len(hashes))[ranked]
            at = known.get(BEGIN)
            counts[rank[at]] //= order - 1  # a text begins once
            row = [[part << 24 | number], [total], [pack(hashes[ranked], counts, length, rank[code], mark.astype(np.uint8))], pa.array([pa.concat_arrays(ids).to_pylist()], arrow.types[3])]
            number, total = number + 1, 0
            for x in (known, codes, ids, held, lengths):
                x.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(row, arrow.types, strict=True)], schema=arrow)

        for batch in text_slices(batches, 2):
            words: list[bytes] = []
            for t in bytes_of(batch.column(2)):
                w = t.lower().split()
                words += pad  # no tokens, but contexts
                words += w
                words.append(END)
                lengths.append(len(w) + order)
            for w in set(words).difference(known):
                known[w] = len(known)
            codes.append(np.fromiter(map(known.__getitem__, words), np.uint32, len(words)))
            ids.append(batch.column(0))
            held.append(batch.column(1).to_numpy(zero_copy_only=False).astype(bool))
            total += len(words)
            if total >= CHUNK_TOKENS:
                yield chunk()
        if ids:
            yield chunk()

    rows = docs.select("doc_id", "held_out", "text").mapInArrow(run, "chunk long, tokens long, body binary, docs array<long>")
    rows.write.option("compression", "none").parquet(folder)
    return spark.read.schema(rows.schema).parquet(folder)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for k in range(batch.num_rows):
            yield tuple(c[k].as_py() for c in batch.columns)


def exchanged(spark: SparkSession, table: DataFrame, ask: Callable[[int, bytes], Iterator[tuple[int, bytes]]], add_up: Callable[[int, list[bytes]], tuple[list[bytes], list[tuple]]], n: int, folder: str) -> list[tuple]:
    """Chunks ask, partitions add up; each partition's answers become a file, with an index a chunk; the summaries' sums come back.

    A summary is (kind, length, key, numbers); numbers of equal kind, length and key are added up before they reach the
    driver: a few rows a length, and at most HOT_CONTEXTS for frequent contexts.
    """
    schema = pa.schema([("part", pa.int64()), ("chunk", pa.int64()), ("blob", pa.binary())])
    told_schema = pa.schema([("kind", pa.int32()), ("length", pa.int32()), ("key", pa.int64()), ("numbers", pa.list_(pa.int64()))])
    answer_schema = pa.schema([("chunk", pa.int64()), ("part", pa.int64()), *told_schema])
    place = -1  # the kind of rows that tell where an answer is

    def asking(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, body in _rows(batches):
            for part, blob in ask(number, body):
                yield pa.RecordBatch.from_arrays([pa.array([part]), pa.array([number]), pa.array([blob], pa.binary())], schema=schema)

    def answering(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, numbers, blobs = None, [], []

        def done() -> pa.RecordBatch:
            answers, summary = add_up(now, blobs)
            put_file(f"{folder}/{now}.part", lambda out: out.write(b"".join(answers)))
            ends = np.cumsum(list(map(len, answers))).tolist()
            rows = [(number, now, place, 0, 0, [end - len(x), len(x)]) for number, x, end in zip(numbers, answers, ends, strict=True)]
            rows += [(-1 - key % n, now, kind, length, key, values) for kind, length, key, values in summary]
            numbers.clear()
            blobs.clear()
            pa.default_memory_pool().release_unused()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), answer_schema.types, strict=True)], schema=answer_schema)

        for part, number, blob in _rows(batches):
            if blobs and part != now:
                yield done()
            now = part
            numbers.append(number)
            blobs.append(blob)
        if blobs:
            yield done()

    def saving(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, places, sums = None, [], {}

        def put() -> None:
            put_file(f"{folder}/{now}.index", lambda out: out.write(np.array(places, "<i8").tobytes()))
            places.clear()

        for number, part, kind, length, key, numbers in _rows(batches):
            if kind == place:
                if places and number != now:
                    put()
                now = number
                places.append((part, *numbers))
            else:
                old = sums.get((kind, length, key))
                sums[kind, length, key] = numbers if old is None else [a + b for a, b in zip(old, numbers, strict=True)]
        if places:
            put()
        if sums:
            columns = [*zip(*sums, strict=True), list(sums.values())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, told_schema.types, strict=True)], schema=told_schema)

    told = "kind int, length int, key long, numbers array<long>"
    asked = table.select("chunk", "body").mapInArrow(asking, "part long, chunk long, blob binary")
    dealt = asked.repartition(partitions(spark), "part").sortWithinPartitions("part", "chunk")
    answers = dealt.mapInArrow(answering, f"chunk long, part long, {told}")
    return [tuple(r) for r in answers.repartition(partitions(spark), "chunk").sortWithinPartitions("chunk", "part").mapInArrow(saving, told).collect()]


class Answers:
    """A chunk's answers by partition, each read when asked for."""

    def __init__(self, folder: str, chunk: int):
        self.folder = folder
        file_system, path = open_fs(f"{folder}/{chunk}.index")
        with file_system.open_input_file(path) as f:
            self.places = {p: (at, size) for p, at, size in np.frombuffer(f.read(), "<i8").reshape(-1, 3).tolist()}

    def __getitem__(self, part: int) -> list[np.ndarray]:
        at, size = self.places[part]
        file_system, path = open_fs(f"{self.folder}/{part}.part")
        with file_system.open_input_file(path) as f:
            return unpack(f.read_at(size, at))


class Model:
    """What a task needs to ask and to score: where answers are, and what is known of frequent contexts."""

    def __init__(self, folder: str, n: int, order: int, hot_from: int):
        self.folder, self.n, self.order, self.hot_from = folder, n, order, hot_from
        self.heavy: dict[int, np.ndarray] = {}
        self.sums: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.last = 1  # rounds done

    def chunk(self, number: int, body: bytes) -> Chunk:
        out = Chunk(body, self.order)
        got = Answers(f"{self.folder}/words", number)
        told = {p: got[p] for p in sorted(got.places)}
        out.sequences(np.concatenate([c for c, _ in told.values()]), np.concatenate([x * self.n + p for p, (_, x) in told.items()]))
        return out

    def ask(self, number: int, body: bytes) -> Iterator[tuple[int, bytes]]:
        """The next round's."""
        own, base = self.chunk(number, body), None
        for j, cold, part, who, _, short, where, dealt in own.rounds(self.n, self.hot_from, self.heavy, self.last + 1):
            if j > self.last:
                for p, a, b in _slices(part):
                    rows = cold[a:b]
                    yield p, own.ask(rows, own.seen[rows], self.order, None if base is None else base[rows])
                seen = np.bincount(short, own.seen[who], len(where)).astype(np.int64)
                for p, a, b in _slices(dealt):
                    rows = who[where[a:b]]
                    yield p, own.ask(rows, seen[a:b], j, None if base is None else base[rows])
            elif len(who):
                base = np.zeros(len(own.word), np.int64)
                base[who] = self.hot_counts(number, j, dealt)[short]

    def hot_counts(self, number: int, j: int, dealt: np.ndarray) -> np.ndarray:
        got = Answers(f"{self.folder}/round-{j}", number)
        return np.concatenate([got[p][0] for p, _, _ in _slices(dealt)])

    def add_up(self, part: int, blobs: list[bytes]) -> tuple[list[bytes], list[tuple]]:
        hot, j = part >= self.n, self.last + 1
        return add_sequences(blobs, j, j if hot else self.order, hot, self.order, self.hot_from)

    def log_p(self, number: int, own: Chunk, unigrams: Unigrams, d: list[np.ndarray]) -> np.ndarray:
        """log10 p of each sequence of the chunk."""
        out = np.empty(len(own.word))
        known: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # of frequent contexts' rows: the counts, which sums, the sums
        for j, cold, part, who, key, short, _, dealt in own.rounds(self.n, self.hot_from, self.heavy, self.last):
            got = Answers(f"{self.folder}/round-{j}", number) if len(cold) else None
            for p, a, b in _slices(part):
                rows, told = cold[a:b], got[p]
                steps = [(c[rows], s[w[rows]]) for c, w, s in known]
                head = np.zeros(len(rows), bool)
                for k in range(2, self.order + 1):
                    head |= _heads(own.before[k - 2][rows])
                    if k >= j:
                        sums = told[2 * (k - j) + 1].reshape(2 * SMALL + 2, -1).T
                        steps.append((told[2 * (k - j)], sums[np.cumsum(head) - 1]))
                out[rows] = np.log10(chain(d, unigrams, own.counts[own.word[rows]], steps))
            if len(who):
                counts, which = np.zeros(len(own.word), np.int64), np.zeros(len(own.word), np.int32)
                counts[who] = self.hot_counts(number, j, dealt)[short]
                keys, sums = self.sums[j]
                which[who] = np.searchsorted(keys, key)
                known.append((counts, which, sums))
                if j == self.order:
                    out[who] = np.log10(chain(d, unigrams, own.counts[own.word[who]], [(c[who], s[w[who]]) for c, w, s in known]))
        return out


def score(spark: SparkSession, documents: DataFrame, modulus: int = 7, held: int = 2, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER) -> DataFrame:
    """Per row of ``documents``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    ``order``, two at least, is the number of words of the longest sequences. Texts whose id's remainder is ``held`` are
    scored, not learnt from; a null id is learnt from. Null texts count as empty: one end token. Repeated rows count and
    are scored each. Without any training text every token is unknown and scores log10(1) = 0. An empty table gives an
    empty result; other columns are not looked at.
    """
    folder = fresh_path(spark, "katz")
    rows = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(remainder(id_col, modulus) == held, F.lit(False)).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    table = chunks(spark, rows, f"{folder}/chunks", order)
    all_tokens = table.agg(F.sum("tokens")).first()[0] or 0
    out_type = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    if not all_tokens:
        return spark.createDataFrame([], out_type)
    n = max(partitions(spark), -(-all_tokens // PARTITION_TOKENS))
    hot_from = max(2, HOT_TOKENS, -(-all_tokens // HOT_CONTEXTS))  # at most HOT_CONTEXTS contexts of a length are so frequent
    begin = word_hash(BEGIN)
    told = exchanged(spark, table, lambda number, body: Chunk(body, order).ask_words(n), lambda part, blobs: add_words(part, blobs, begin, n), n, f"{folder}/words")
    counts = {length: np.array(numbers, float) for kind, length, _, numbers in told if kind == COUNTS}
    tokens, vocabulary, beginnings, beginning = next(numbers for kind, _, _, numbers in told if kind == TOTALS)
    unigrams = Unigrams(counts[1], tokens)

    model = Model(folder, n, order, hot_from)
    for j in range(2, order + 1):
        known = spark.sparkContext.broadcast(model)  # at most HOT_CONTEXTS contexts of each length
        told = exchanged(spark, table, lambda number, body, known=known: known.value.ask(number, body), lambda part, blobs, known=known: known.value.add_up(part, blobs), n, f"{folder}/round-{j}")
        model.last = j
        for kind, length, _, numbers in told:
            if kind == COUNTS:
                counts[length] = counts.get(length, 0) + np.array(numbers, float)
        for length in range(j, order):
            heavy = [key for kind, own, key, _ in told if kind == FREQUENT and own == length]
            if beginnings >= hot_from:
                heavy.append(int(folded([np.array([beginning])] * length).view(np.int64)[0]))
            model.heavy[length] = np.union1d(model.heavy.get(length, np.empty(0, np.uint64)), np.array(heavy, np.int64).view(np.uint64))
        hot = sorted((key % (1 << 64), numbers) for kind, _, key, numbers in told if kind == SUMS)
        if not hot:
            break
        model.sums[j] = np.array([k for k, _ in hot], np.uint64), np.array([s for _, s in hot], np.int64)
    d = [discounts(counts[k]) for k in range(2, order + 1)]
    known = spark.sparkContext.broadcast(model)
    arrow = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, ids, body in _rows(batches):
            own = known.value.chunk(number, body)
            log_p = known.value.log_p(number, own, unigrams, d)
            of = own.counts[own.word]
            n_tokens = own.lengths - (order - 1)
            starts = np.cumsum(n_tokens) - n_tokens
            base = np.log10((of + 1) / (tokens + vocabulary + 1))
            each = lambda x: np.add.reduceat(x[own.back], starts)  # noqa: B023, E731
            columns = [ids, own.held > 0, n_tokens, each((of > 0).astype(np.int64)), np.full(len(ids), tokens), each(base), each(log_p)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, arrow.types, strict=True)], schema=arrow)

    return table.select("chunk", "docs", "body").mapInArrow(judge, out_type)
