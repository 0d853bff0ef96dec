import random
import zlib
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from gridcalc.llm import bpe_automaton, token_files
from gridcalc.llm.common import fresh_path

WORD, BYTE = (Path(public_tokenizers.path(n)).read_text() for n in ("word_bpe_49k.json", "byte_bpe_50k.json"))


def odd_texts():
    r = random.Random(0)
    fixed = ["J\u030c abc H\u0331 T\u0308 W\u030a, X.", "Êa,!! don't DON'T 'Tis x'S '' ÀÿÖß×÷ªºµ 12a3 a1.5-b ,'s ciónsé$$$", "Word, WORD. word word,\u0301 A\u030a. end.", "a\x85B\x1cC\xa0D\u2028E <|ENDOFTEXT|> <|endoftext|>, [X] <|startoftext|>.", "", "  a  b\n\n c<|endoftext|> d", "\0<|endoftext|>", "don't we'll\xa0 　x", "日本語 🎉 é", "a" * 5000, "\x1c a\x85b <|startoftext|>x", "́ Σ ΑΣ İ"]
    return fixed + ["".join(r.choice("aeinorst  lhd'\né\xf1🎉01.,-ABT") for _ in range(r.randrange(70))) for _ in range(400)]


def test_automaton_equals_library_and_round_trips():
    codec, library = bpe_automaton.Codec(BYTE), Tokenizer.from_str(BYTE)
    for text, want in zip(odd_texts(), library.encode_batch(odd_texts(), add_special_tokens=False), strict=True):
        ids = codec.encode(text)
        assert ids.tolist() == want.ids
        assert codec.decode(ids) == text == library.decode(want.ids, skip_special_tokens=False)


def test_small_automaton_accepts_exactly_what_merges_yield():
    letters = {"a": 0, "b": 1}
    merges = [("a", "a"), ("a", "b"), ("aa", "b"), ("b", "ab")]
    vocabulary = letters | {u + v: 2 + k for k, (u, v) in enumerate(merges)}
    names = {i: t for t, i in vocabulary.items()}
    auto = bpe_automaton.Automaton(vocabulary, merges)
    for n in range(1, 11):
        for bits in range(2**n):
            word = "".join("ab"[bits >> k & 1] for k in range(n))
            parts = list(word)
            for u, v in merges:
                k = 0
                while k < len(parts) - 1:
                    if parts[k : k + 2] == [u, v]:
                        parts[k : k + 2] = [u + v]
                    k += 1
            assert [names[i] for i in auto.path(word.encode())] == parts


@pytest.mark.parametrize("bits", [1, 7, 8, 13, 16, 17, 31])
def test_pack_and_unpack(bits):
    ids = np.random.default_rng(0).integers(0, 2**bits, 1003).astype(np.uint32)
    data = token_files.pack(ids, bits)
    assert len(data) == (1003 * bits + 7) // 8
    assert (token_files.unpack(data, 700, bits, 300) == ids[300:1000]).all()


def test_encoder_equals_library_on_marks_and_signs():
    r = random.Random(7)
    letters = "JHTWAaijkXYÀÿß×÷ºµst01,.,.  <|>[]'\x1c\x85\xa0\u0301\u030c\u0331\u0308\u030a\u0345\u1e9e\u0130\u212b\u1f88\u03a3"
    texts = ["".join(r.choice(letters) for _ in range(r.randrange(40))) for _ in range(3000)] + ["<|endoftext|>," * 3, "A <|endoftext|>b", "<|startoftext|><|endoftext|> X,"]
    for plain in (False, True):
        library = Tokenizer.from_str(WORD)
        library.encode_special_tokens = plain
        own = token_files.Encoder(WORD, plain)
        own.encode([t.encode() for t in texts[::2]])
        own._trim()
        ids, counts = own.encode([t.encode() for t in texts])
        at = 0
        for t, n, want in zip(texts, counts.tolist(), library.encode_batch(texts, add_special_tokens=False), strict=True):
            assert ids[at : at + n].tolist() == want.ids, repr(t)
            at += n


def test_plain_words_are_parted_without_the_normalizer(monkeypatch):
    r = random.Random(11)
    letters = "'''''sstmdrevlLSTDM aÀÖØÞßàöøÿ09.,<[ \n\t\x0b\x0c\r"
    texts = ["".join(r.choice(letters) for _ in range(r.randrange(30))) for _ in range(3000)] + ["", " ", "'", "it's", "'S", "''ll'll", "1's'9're", "'ll", "[x]<y>|<", "Ünïté's"]
    library = Tokenizer.from_str(WORD)
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    own = token_files.Encoder(WORD)
    own.tokenizer = own.joint = None  # neither normalises nor splits such words
    monkeypatch.setattr(token_files, "CACHE_PIECES", 50)
    for k in range(0, len(texts), 100):
        ids, counts = own.encode([t.encode() for t in texts[k : k + 100]])
        assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == want[k : k + 100]


def test_token_files_equal_library(spark):
    rows = [(i * 3, t) for i, t in enumerate(odd_texts())] + [(None, "no id"), (5000, None), (5000, "twice"), (5001, "x " * 90_000)]
    df = spark.createDataFrame([(d, t, "n", 1) for d, t in rows], "doc_id long, text string, uri string, ids int").repartition(5)
    got = {(r.doc_id, r.ids_crc32): r for r in token_files.token_index(spark, df, WORD).collect()}
    library, start = Tokenizer.from_str(WORD), 0
    seen = 0
    for d, t in sorted(rows, key=lambda r: -1 if r[0] is None else r[0]):
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        r = got[d, zlib.crc32(ids.tobytes())]
        assert r.n_tokens == len(ids)
        assert d == 5000 or r.start == start
        start += len(ids)
        seen += 1
    assert seen == len(got)
    assert token_files.token_index(spark, df.limit(0), WORD).collect() == []


def test_random_access(spark):
    df = spark.createDataFrame([(1, "a b c " * 40_000), (2, "d"), (3, "")], "doc_id long, text string")
    data = token_files.write_tokens(spark, df, WORD, 1, fresh_path(spark, "t"))
    library = Tokenizer.from_str(WORD)
    documents = {}
    for uri, _, _, n in data.files:
        reader = token_files.Reader(uri)
        for k in range(n):
            documents[reader.doc_ids[k].as_py()] = reader.document(k)
    assert documents[1].tolist() == [*library.encode("a b c " * 40_000, add_special_tokens=False).ids, 1]
    assert documents[3].tolist() == [1]


def test_bpe_query_defined_for_odd_rows(spark):
    df = spark.createDataFrame([(None, "x"), (1, None), (1, None), (2, "<|endoftext|>")], "doc_id long, text string")
    got = sorted(bpe_automaton.digests(spark, df, BYTE).select("doc_id", "n_tokens").collect(), key=str)
    assert [tuple(r) for r in got] == [(1, 0), (1, 0), (2, 1), (None, 1)]
    assert bpe_automaton.encoded(spark, df.where("doc_id = 2"), BYTE).first().decoded == "<|endoftext|>"
    assert bpe_automaton.digests(spark, df.limit(0), BYTE).collect() == []
