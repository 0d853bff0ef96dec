"""Byte-pair encoding by a tokenization automaton.

The automaton reads token sequences and accepts exactly those that the merges yield. It starts as one state with a loop
for each byte. A merge (u, v) splits the state s that u leads to: u now leads to a copy s' that has all arcs of s but v,
and every state with an arc u gets an arc uv to where v led from s. All arcs of one label lead to one state throughout,
so a merge adds one state at most, a state is named by the last label, and its arcs are looked up in the table of
arcs lost and made. A word's ids are the one path whose labels spell it, found by a byte trie and the arc table. Decoding emits the labels along the path.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridcalc.llm.common import bytes_of, gathered, text_slices

#: The pre-splitting pattern of byte-level BPE, as the vocabulary file's format names it.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Distinct pre-split words whose ids one Python worker keeps.
CACHE_WORDS = 300_000
#: Looked-up arcs that one Python worker keeps.
ARCS = 400_000
#: Bytes of text that are encoded at once, a longer text alone.
SLICE_BYTES = 2_000_000


def byte_letters() -> dict[str, int]:
    """The printable letter that a vocabulary file writes for each byte, by the rule of byte-level BPE."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Automaton:
    """States and arcs over token ids, built from a byte-level vocabulary and its merges in order."""

    def __init__(self, vocabulary: dict[str, int], merges: list[tuple[str, str]]):
        letters = byte_letters()
        size = max(vocabulary.values()) + 1
        self.label: list[bytes] = [b""] * size
        for token, i in vocabulary.items():
            if all(c in letters for c in token):
                self.label[i] = bytes(letters[c] for c in token)
        self.states = 1
        self.target = [-1] * size  # the state that a label's arcs lead to
        self.born = [-1] * size  # 0: a byte; k: by the k-th merge
        self.halves: list[tuple[int, int]] = [(-1, -1)] * size
        self.lost: dict[int, int] = {}  # label u and label v: the merge at which the state that u leads to lost its arc v
        self.arcs: dict[int, bool] = {}
        self.size = size
        for letter in letters:
            if letter in vocabulary:
                i = vocabulary[letter]
                self.target[i], self.born[i] = 0, 0
        for k, (left, right) in enumerate(merges, 1):
            self._merge(k, vocabulary[left], vocabulary[right], vocabulary[left + right])
        self.whole = {label: i for i, label in enumerate(self.label) if label and self.born[i] >= 0}
        self.trie: dict = {}
        for i, label in enumerate(self.label):
            if label and self.born[i] >= 0:
                node = self.trie
                for b in label[:-1]:
                    node = node.setdefault(b, [{}, -1])[0]
                node.setdefault(label[-1], [{}, -1])[1] = i

    def _merge(self, k: int, u: int, v: int, uv: int) -> None:
        """The merge gadget; nothing changes where u is never followed by v."""
        if self.target[u] < 0 or self.target[v] < 0 or self.born[uv] >= 0 or not self.has(u, v):
            return
        after = self.target[v]
        self.target[u], self.states = self.states, self.states + 1
        self.lost[u * self.size + v] = k
        self.target[uv], self.born[uv], self.halves[uv] = after, k, (u, v)

    def has(self, last: int, token: int) -> bool:
        """Whether the state that label ``last`` leads to has an arc ``token``; -1 for the first state.

        That state has the arcs that its chain of copies has not lost: those lost by copies for ``last`` itself, and by
        copies made for its right half before the merge that made it, and so on. An arc made by a later merge is there
        where its left half was.
        """
        if self.born[token] < 0:
            return False
        if last < 0:
            return True
        size, lost, born, halves = self.size, self.lost, self.born, self.halves
        before = 1 << 60
        while last >= 0:
            base, t, until = last * size, token, 1 << 60
            while t >= 0:
                k = lost.get(base + t)
                if k is not None and k < before and k <= until:
                    return False
                until = born[t]
                t = halves[t][0]
            before = born[last]
            last = halves[last][1]
        return True

    def path(self, word: bytes) -> list[int]:
        """The ids of one pre-split word.

        Tries the longest label first and goes back where no arc leads on. Each prefix of the word has one path only, so
        a position from which the end can't be reached is never entered twice.
        """
        whole = self.whole.get(word)
        if whole is not None:
            return [whole]
        n, size, arcs, trie = len(word), self.size, self.arcs, self.trie
        dead: set[int] = set()
        tokens: list[int] = []
        places: list[tuple[int, int, list[tuple[int, int]]]] = []
        at, state, open_ = 0, -1, None
        while True:
            if open_ is None:  # labels that go on from here, longest last
                open_, node = [], trie
                for i in range(at, n):
                    step = node.get(word[i])
                    if step is None:
                        break
                    node, token = step
                    if token >= 0:
                        open_.append((i + 1, token))
            while open_:
                end, token = open_.pop()
                if end in dead:
                    continue
                key = state * size + token
                found = arcs.get(key)
                if found is None:
                    if len(arcs) > ARCS:
                        arcs.clear()
                    found = arcs[key] = self.has(state, token)
                if found:
                    break
            else:
                dead.add(at)
                at, state, open_ = places.pop()
                tokens.pop()
                continue
            tokens.append(token)
            if end == n:
                return tokens
            places.append((at, state, open_))
            at, state, open_ = end, token, None


class Codec:
    """Encodes and decodes whole texts; words seen before are looked up."""

    def __init__(self, tokenizer_json: str):
        spec = json.loads(tokenizer_json)
        model = spec["model"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.automaton = Automaton(model["vocab"], merges)
        specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.specials = {s.encode(): i for s, i in specials.items()}
        self.special_pattern = regex.compile("(" + "|".join(map(regex.escape, sorted(specials, key=len, reverse=True))) + ")") if specials else None
        self.split = regex.compile(PATTERN).findall
        labels = list(self.automaton.label) + [b""] * max(0, max(specials.values(), default=-1) + 1 - len(self.automaton.label))
        for s, i in specials.items():
            labels[i] = s.encode()
        self.label_bytes = np.frombuffer(b"".join(labels), np.uint8)
        self.label_lengths = np.fromiter(map(len, labels), np.int64, len(labels))
        self.label_offsets = np.cumsum(self.label_lengths) - self.label_lengths
        self._forget()

    def _forget(self) -> None:
        self.code: dict[str, int] = {}
        self.flat, self.used = np.empty(1 << 16, "<u4"), 0
        self.offsets, self.lengths = np.empty(1 << 14, np.int64), np.empty(1 << 14, np.int64)

    def _words(self, text: str) -> list[str]:
        if self.special_pattern is None or not self.special_pattern.search(text):
            return self.split(text)
        out = []
        for k, part in enumerate(self.special_pattern.split(text)):
            out += [f"\0{part}"] if k % 2 else self.split(part)  # no pre-split word holds a special token's text after a null byte
        return out

    def _ids_of(self, word: str) -> list[int]:
        if word[0] == "\0" and (i := self.specials.get(word[1:].encode())) is not None:
            return [i]
        return self.automaton.path(word.encode())

    def _learn(self, words: list[str]) -> None:
        first, ids, n = len(self.code), [], []
        for w in words:
            found = self._ids_of(w)
            ids += found
            n.append(len(found))
        while first + len(words) > len(self.offsets):
            self.offsets, self.lengths = np.resize(self.offsets, 2 * len(self.offsets)), np.resize(self.lengths, 2 * len(self.lengths))
        while self.used + len(ids) > len(self.flat):
            self.flat = np.resize(self.flat, 2 * len(self.flat))
        self.flat[self.used : self.used + len(ids)] = ids
        self.lengths[first : first + len(words)] = n
        self.offsets[first : first + len(words)] = self.used + np.cumsum(n) - n
        self.used += len(ids)
        self.code.update(zip(words, range(first, first + len(words)), strict=True))

    def encode_all(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in a row, and where each text's ids end."""
        words, ends = [], []
        for t in texts:
            words += self._words(t)
            ends.append(len(words))
        if len(self.code) > CACHE_WORDS:
            self._forget()
        self._learn(list(set(words).difference(self.code)))
        codes = np.fromiter(map(self.code.__getitem__, words), np.int64, len(words))
        total = np.r_[0, np.cumsum(self.lengths[codes])]
        return self.flat[gathered(self.offsets, self.lengths, codes)], total[np.array(ends, np.int64)]

    def encode(self, text: str) -> np.ndarray:
        return self.encode_all([text])[0]

    def labels(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of the arcs' labels."""
        return self.label_bytes[gathered(self.label_offsets, self.label_lengths, ids)]

    def decode(self, ids: np.ndarray) -> str:
        return self.labels(ids).tobytes().decode("utf-8", "replace")


_codecs: dict[int, Codec] = {}


def codec(tokenizer_json: str) -> Codec:
    """One codec for all tasks of a worker."""
    key = hash(tokenizer_json)
    if key not in _codecs:
        _codecs[key] = Codec(tokenizer_json)
    return _codecs[key]


def encoded(spark: SparkSession, df: DataFrame, tokenizer_json: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids, decoded) per row; a null text counts as empty. Ids are little-endian unsigned 32-bit integers."""
    return _mapped(spark, df, tokenizer_json, "doc_id long, ids binary, decoded string", lambda ids, text: (ids.tobytes(), text), id_col, text_col)


def digests(spark: SparkSession, df: DataFrame, tokenizer_json: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) per row, of the ids and of the text decoded from them.

    Null texts count as empty, null ids are kept, repeated rows are each encoded, an empty table gives an empty result.
    """
    return _mapped(spark, df, tokenizer_json, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", lambda ids, text: (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()), id_col, text_col)


def _mapped(spark: SparkSession, df: DataFrame, tokenizer_json: str, schema: str, row, id_col: str, text_col: str) -> DataFrame:
    known = spark.sparkContext.broadcast(tokenizer_json)  # one vocabulary file
    arrow = pa.schema([(f.split()[0], {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}[f.split()[1]]) for f in schema.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(known.value)
        for batch in text_slices(batches, 1):
            rows, texts, held = [], [], 0

            def flush() -> None:
                ids, ends = own.encode_all(texts)
                marks = np.r_[0, np.cumsum(own.label_lengths[ids])]
                text, k = own.labels(ids).tobytes(), 0
                for end in ends.tolist():
                    rows.append(row(ids[k:end], text[marks[k] : marks[end]].decode("utf-8", "replace")))
                    k = end
                texts.clear()

            for t in bytes_of(batch.column(1)):
                if texts and held + len(t) > SLICE_BYTES:
                    flush()
                    held = 0
                texts.append(t.decode())
                held += len(t)
            if texts:
                flush()
            columns = list(zip(*rows, strict=True)) or [[] for _ in arrow.names[1:]]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, f.type) for c, f in zip(columns, list(arrow)[1:], strict=True))], schema=arrow)

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)
