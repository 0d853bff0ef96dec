"""Token ids in packed binary files: fixed-width bits, block offsets, random access, global document starts.

File: ids packed at the fewest bits that hold the vocabulary, in blocks of BLOCK ids that each start at a byte; then the
footer as an Arrow IPC record (block byte offsets, document ids and ends); then the footer's length and the magic.
One file holds one range of doc_ids in ascending order; the manifest has each file's first id position.
"""

from __future__ import annotations

import io
import json
import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridcalc.llm.common import bytes_of, fresh_path, gathered, open_fs, partitions, put_file, text_slices

MAGIC = b"GCTOK001"
BLOCK = 1 << 16
#: Distinct pieces of words whose ids one Python worker keeps.
CACHE_PIECES = 1_000_000
#: Fixed value: the pre-splitting pattern of the lower-casing tokenizer, as its vocabulary file has it.
FOLDED = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Kinds of bytes. Words without odd ones hold nothing that composes, and each of their letters (ASCII, Latin-1) has one lower-case
#: letter. A byte after 0xC3 is a letter's second, unless it makes a multiplication or division sign.
BLANK, LETTER, DIGIT, SIGN, ODD = range(5)
_KIND = np.full(256, ODD, np.uint8)
_KIND[0x21:0x7F] = SIGN
_KIND[[*b"\t\n\x0b\x0c\r "]] = BLANK
_KIND[[*b"0123456789"]] = DIGIT
_KIND[[*range(65, 91), *range(97, 123), 0xC3]] = LETTER
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def bits_for(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Little-endian bit packing."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    each = np.unpackbits(ids.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")[:, :bits]
    return np.packbits(each.ravel(), bitorder="little").tobytes()


def unpack(data: bytes, count: int, bits: int, start: int = 0) -> np.ndarray:
    """``count`` ids from the ``start``-th on."""
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", count, start * bits // 8).astype(np.uint32)
    padded = np.frombuffer(data + bytes(8), np.uint8)
    at = (np.arange(count, dtype=np.int64) + start) * bits
    words = np.lib.stride_tricks.as_strided(padded, (len(padded) - 7, 8), (1, 1))[at >> 3]
    wide = np.ascontiguousarray(words).view("<u8").ravel()
    return ((wide >> (at & 7).astype(np.uint64)) & np.uint64((1 << bits) - 1)).astype(np.uint32)


class Encoder:
    """A tokenizer's ids for texts whose blank-separated words it treats one by one; pieces seen before are looked up."""

    def __init__(self, tokenizer_json: str, plain_specials: bool = False):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.json = tokenizer_json
        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.tokenizer.encode_special_tokens = plain_specials
        #: One token that stands between words encoded together; as a special token it parts what is normalised.
        self.between = max(((t["content"], t["id"]) for t in json.loads(tokenizer_json)["added_tokens"] if t["special"] and not (t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"])), default=None)
        self.vocabulary = self.tokenizer.get_vocab_size(with_added_tokens=True)
        spec = json.loads(tokenizer_json)
        steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [{}])
        self.folds = "Lowercase" in json.dumps(spec.get("normalizer")) and steps[0].get("pattern", {}).get("Regex") == FOLDED and all("<|" in t["content"] for t in spec["added_tokens"])
        #: The ids that end a piece, if each piece of plain signs has one and the model can be given such pieces as they are.
        self.last = None
        suffix, tokens = spec["model"].get("end_of_word_suffix"), spec["model"]["vocab"]
        if self.folds and suffix == "</w>" and {c + suffix for c in ByteLevel.alphabet()} <= tokens.keys() and [(t["type"], t.get("add_prefix_space"), t.get("use_regex")) for t in steps[1:]] == [("ByteLevel", False, False)]:
            self.last = np.zeros(self.vocabulary, bool)
            self.last[[i for t, i in tokens.items() if t.endswith(suffix)]] = True
            blanks = {"type": "Split", "pattern": {"String": " "}, "behavior": "Removed", "invert": False}
            self.model = Tokenizer.from_str(json.dumps(spec | {"normalizer": None, "added_tokens": [], "truncation": None, "padding": None, "pre_tokenizer": {"type": "Sequence", "pretokenizers": [blanks, *steps[1:]]}}))
        self._trim()

    @cached_property
    def joint(self):
        """The tokenizer that takes words with a special token between them."""
        from tokenizers import Tokenizer

        joint = Tokenizer.from_str(self.json)
        joint.no_truncation()
        joint.no_padding()
        return joint

    def _trim(self) -> None:
        """Forgets all pieces."""
        self.pieces: dict[bytes, int] = {}
        self.flat = np.empty(1 << 16, np.uint32)
        self.used, self.known, self.offsets, self.lengths = 0, 0, np.empty(1 << 14, np.int64), np.empty(1 << 14, np.int64)

    def _learn(self, plain: list[bytes], words: list[bytes]) -> None:
        """Ids of new pieces; nothing in plain ones is normalised or split, so that the tokenizer's model alone is asked."""
        if self.last is None:
            plain, words = [], plain + words
        for i in range(0, len(plain), 20_000):
            some = plain[i : i + 20_000]
            ids = np.array(self.model.encode_batch_fast([b" ".join(some).decode()], add_special_tokens=False)[0].ids, np.uint32)
            self.pieces.update(zip(some, self._store(ids, np.diff(np.flatnonzero(self.last[ids]), prepend=-1)), strict=True))
        odd = [x for x in words if self.between is None or b"<" in x or b"[" in x]
        if odd:
            ids = [e.ids for e in self.tokenizer.encode_batch_fast([x.decode() for x in odd], add_special_tokens=False)]
            self.pieces.update(zip(odd, self._store(np.array([i for x in ids for i in x], np.uint32), np.fromiter(map(len, ids), np.int64, len(ids))), strict=True))
            skip = set(odd)
            words = [x for x in words if x not in skip]
        for i in range(0, len(words), 20_000):
            some = words[i : i + 20_000]
            text, mark = self.between
            ids = np.array(self.joint.encode_batch_fast([text.join(x.decode() for x in some)], add_special_tokens=False)[0].ids, np.uint32)
            cut = np.r_[-1, np.flatnonzero(ids == mark), len(ids)]
            self.pieces.update(zip(some, self._store(ids[ids != mark], np.diff(cut) - 1), strict=True))

    def _store(self, new: np.ndarray, n: np.ndarray) -> range:
        """The codes of runs of ids."""
        first, last = self.known, self.known + len(n)
        while last > len(self.offsets):
            self.offsets, self.lengths = np.resize(self.offsets, 2 * len(self.offsets)), np.resize(self.lengths, 2 * len(self.lengths))
        while self.used + len(new) > len(self.flat):
            self.flat = np.resize(self.flat, 2 * len(self.flat))
        self.flat[self.used : self.used + len(new)] = new
        self.offsets[first:last] = self.used + np.cumsum(n) - n
        self.lengths[first:last] = n
        self.used, self.known = self.used + len(new), last
        return range(first, last)

    def _parted(self, data: bytes) -> tuple[pa.DictionaryArray, np.ndarray, np.ndarray]:
        """The pieces that the tokenizer makes of words of plain signs, in lower case if it folds case, where they begin, and which are whole words: all others.

        No other letters are folded here: what composes with a mark must do so before it is lowered. ``data`` ends with two blanks.
        """
        raw = np.frombuffer(data, np.uint8)
        kind, text = _KIND[raw], _LOWER[raw]
        lead = np.flatnonzero(raw[:-1] == 0xC3)
        second = raw[lead + 1]
        letter = (second >= 0x80) & (second <= 0xBF) & (second != 0x97) & (second != 0xB7)
        kind[lead[letter] + 1] = LETTER
        text[lead[letter & (second < 0x9F)] + 1] += 32
        held = kind != BLANK
        start = held.copy()
        start[1:] &= (kind[1:] != kind[:-1]) | (kind[1:] == DIGIT)
        # 's, 't, 'm, 'd, 're, 've, 'll where a piece begins with the apostrophe
        quote = np.flatnonzero(start & (text == ord("'")))
        one, two = text[quote + 1], text[quote + 2]
        short = np.isin(one, [*b"stmd"])
        long = (np.isin(one, [*b"rv"]) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
        start[quote[short | long] + 1] = False
        after = np.r_[quote[short] + 2, quote[long] + 3]
        start[after] = held[after]
        whole = kind == ODD if self.folds else held
        whole[:-1] |= (raw[:-1] == ord("<")) & (raw[1:] == ord("|"))
        inside = np.zeros(len(raw), bool)
        if whole.any():
            turn = np.diff(held, prepend=False)
            first, last = np.flatnonzero(turn & held), np.flatnonzero(turn & ~held)
            those = np.logical_or.reduceat(whole, first)
            step = np.zeros(len(raw), np.int8)
            step[first[those]], step[last[those]] = 1, -1
            inside = np.cumsum(step, dtype=np.int8).view(bool)
            start &= ~inside
            start[first[those]] = True
            np.copyto(text, raw, where=inside)
        text, at = text[held], np.flatnonzero(start)
        ends = np.append(np.flatnonzero(start[held]), len(text))
        return pa.Array.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(ends), pa.py_buffer(text)]).dictionary_encode(), at, inside[at]

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of UTF-8 texts in a row, and the number of ids of each."""
        parted, at, whole = self._parted(b" ".join(texts) + b"  ")
        pieces, places = parted.dictionary.to_numpy(zero_copy_only=False), parted.indices.to_numpy()
        if len(self.pieces) > CACHE_PIECES:
            self._trim()
        codes = np.fromiter(map(self.pieces.get, pieces, repeat(-1)), np.int64, len(pieces))
        new = codes < 0
        words = np.zeros(len(pieces), bool)
        words[places] = whole
        self._learn(pieces[new & ~words].tolist(), pieces[new & words].tolist())
        codes[new] = np.fromiter(map(self.pieces.__getitem__, pieces[new]), np.int64)
        codes = codes[places]
        ids = self.flat[gathered(self.offsets, self.lengths, codes)]
        total = np.r_[0, np.cumsum(self.lengths[codes])]
        ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
        return ids, np.diff(total[np.searchsorted(at, ends)], prepend=0)


_encoders: dict[tuple[int, bool], Encoder] = {}


def encoder(tokenizer_json: str, plain_specials: bool = False) -> Encoder:
    """One encoder for all tasks of a worker."""
    key = (hash(tokenizer_json), plain_specials)
    if key not in _encoders:
        _encoders[key] = Encoder(tokenizer_json, plain_specials)
    return _encoders[key]


def with_ends(ids: np.ndarray, counts: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Appends ``end_id`` to each document."""
    ends = np.cumsum(counts)
    return np.insert(ids, ends, np.uint32(end_id)), counts + 1


class Writer:
    """Packs ids into an open file, block by block."""

    def __init__(self, out, bits: int):
        self.out, self.bits = out, bits
        self.rest, self.offsets, self.at, self.total = np.empty(0, np.uint32), [], 0, 0
        self.doc_ids: list[pa.Array] = []
        self.counts: list[np.ndarray] = []

    def add(self, doc_ids: pa.Array, ids: np.ndarray, counts: np.ndarray) -> None:
        self.doc_ids.append(doc_ids)
        self.counts.append(counts)
        self.rest = np.concatenate([self.rest, ids])
        whole = len(self.rest) // BLOCK * BLOCK
        for i in range(0, whole, BLOCK):
            self._block(self.rest[i : i + BLOCK])
        self.rest = self.rest[whole:].copy()

    def _block(self, ids: np.ndarray) -> None:
        data = pack(ids, self.bits)
        self.offsets.append(self.at)
        self.at += len(data)
        self.total += len(ids)
        self.out.write(data)

    def close(self) -> None:
        if len(self.rest):
            self._block(self.rest)
        ends = np.cumsum(np.concatenate(self.counts)) if self.counts else np.empty(0, np.int64)
        docs = pa.chunked_array(self.doc_ids, pa.int64()).combine_chunks() if self.doc_ids else pa.array([], pa.int64())
        footer = io.BytesIO()
        table = pa.table({"docs": pa.array([docs.to_pylist()], pa.list_(pa.int64())), "ends": [ends.tolist()], "offsets": pa.array([self.offsets], pa.list_(pa.int64())), "bits": [self.bits], "ids": [self.total]})
        with pa.ipc.new_stream(footer, table.schema) as sink:
            sink.write_table(table)
        data = footer.getvalue()
        self.out.write(data)
        self.out.write(len(data).to_bytes(8, "little") + MAGIC)


class Reader:
    """Random access to one packed file."""

    def __init__(self, uri: str):
        file_system, path = open_fs(uri)
        self.file = file_system.open_input_file(path)
        size = self.file.size()
        tail = self.file.read_at(16, size - 16)
        if tail[8:] != MAGIC:
            raise ValueError(f"no packed token file: {uri}")
        n = int.from_bytes(tail[:8], "little")
        meta = pa.ipc.open_stream(self.file.read_at(n, size - 16 - n)).read_all()
        self.bits, self.total, self.data_end = meta["bits"][0].as_py(), meta["ids"][0].as_py(), size - 16 - n
        self.doc_ids = meta["docs"].combine_chunks().flatten()
        self.ends = meta["ends"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        self.offsets = meta["offsets"].combine_chunks().flatten().to_numpy(zero_copy_only=False)

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids of positions start to stop of this file; reads the blocks that hold them only."""
        if stop <= start:
            return np.empty(0, np.uint32)
        first, last = start // BLOCK, (stop - 1) // BLOCK
        begin = int(self.offsets[first])
        end = int(self.offsets[last + 1]) if last + 1 < len(self.offsets) else self.data_end
        data = self.file.read_at(end - begin, begin)
        out = []
        for b in range(first, last + 1):
            lo, hi = max(start, b * BLOCK) - b * BLOCK, min(stop, (b + 1) * BLOCK) - b * BLOCK
            out.append(unpack(data[int(self.offsets[b]) - begin :], hi - lo, self.bits, lo))
        return np.concatenate(out)

    def document(self, k: int) -> np.ndarray:
        return self.ids(int(self.ends[k - 1]) if k else 0, int(self.ends[k]))

    def spans(self, ids_at_once: int = 1 << 20) -> Iterator[tuple[int, int]]:
        """Runs of documents of about so many ids."""
        k = 0
        while k < len(self.ends):
            base = int(self.ends[k - 1]) if k else 0
            j = max(k + 1, int(np.searchsorted(self.ends, base + ids_at_once, "right")))
            yield k, j
            k = j


@dataclass
class TokenDataset:
    """Files in ascending order of doc_id: (uri, first id position, ids, documents)."""

    files: list[tuple[str, int, int, int]]


def write_tokens(spark: SparkSession, df: DataFrame, tokenizer_json: str, end_id: int, folder: str, id_col: str = "doc_id", text_col: str = "text") -> TokenDataset:
    """Encodes every whole text and writes packed files, documents in ascending order of id (nulls first; ties by a hash of the text)."""
    known = spark.sparkContext.broadcast(tokenizer_json)  # one vocabulary file
    n = partitions(spark)
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    tie = F.xxhash64("text")
    docs = docs.repartitionByRange(n, "doc_id", tie).sortWithinPartitions("doc_id", tie)
    schema = pa.schema([("part", pa.int64()), ("uri", pa.string()), ("ids", pa.int64()), ("docs", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        uri, totals = f"{folder}/part-{part:06d}.tok", [0, 0]

        def fill(out) -> None:
            own = encoder(known.value)
            writer = Writer(out, bits_for(own.vocabulary))
            for batch in text_slices(batches, 1):
                ids, counts = with_ends(*own.encode(bytes_of(batch.column(1))), end_id)
                writer.add(batch.column(0), ids, counts)
                totals[1] += batch.num_rows
            writer.close()
            totals[0] = writer.total

        put_file(uri, fill)
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (part, uri, *totals)], schema=schema)

    found = sorted(tuple(r) for r in docs.mapInArrow(run, "part long, uri string, ids long, docs long").collect())  # a row a file
    files, at = [], 0
    for _, uri, ids, count in found:
        files.append((uri, at, ids, count))
        at += ids
    return TokenDataset(files)


def read_tokens(spark: SparkSession, data: TokenDataset, row: Callable[[np.ndarray], list] | None = None) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32 (of the ids as little-endian 32-bit integers)."""
    if not any(f[3] for f in data.files):
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    files = spark.createDataFrame([f[:2] for f in data.files if f[3]], "uri string, first long").repartition(len(data.files))
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, first in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                reader = Reader(uri)
                for k, j in reader.spans():
                    begin = int(reader.ends[k - 1]) if k else 0
                    raw = reader.ids(begin, int(reader.ends[j - 1])).astype("<u4").tobytes()
                    ends = reader.ends[k:j]
                    starts = np.r_[begin, ends[:-1]]
                    sums = [zlib.crc32(raw[4 * (a - begin) : 4 * (b - begin)]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([reader.doc_ids[k:j], pa.array(starts + first), pa.array(ends - starts), pa.array(sums, pa.int64())], schema=schema)

    return files.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_index(spark: SparkSession, df: DataFrame, tokenizer_json: str, end_id: int = 1) -> DataFrame:
    """Writes ``df``'s texts as packed token files and reads them back, one row per row of ``df``.

    Null texts count as empty: they hold the end id alone. Null ids come first. An empty table gives an empty result.
    """
    return read_tokens(spark, write_tokens(spark, df, tokenizer_json, end_id, fresh_path(spark, "tokens")))
