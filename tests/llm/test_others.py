import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridcalc.llm import decontaminate, multi_index, quality, token_counts, toxicity, warc
from gridcalc.llm.common import fresh_path, put_file
from tests.llm.test_tokens import WORD, odd_texts


def test_warc_round_trip_and_lookup(spark):
    long, other = "<html>" + "x" * 200, "<p>é" + "y" * 120
    pages = [(3, "http://a.example.org/x", long), (1, "https://www.b.example.com/", long), (2, "http://a.example.org/x", "short"), (5, None, None), (6, "not a url\r\nWARC-Type: x", other), (None, "http://c.example/", long), (7, "http://b.example.com", other), (7, "http://b.example.com", other), (8, "http://[bad", "short")]
    df = spark.createDataFrame([(p, u, h, "x", 1) for p, u, h in pages], "page_id long, url string, html string, digest string, file int")
    got = sorted((tuple(r) for r in warc.archive(spark, df).collect()), key=str)
    want = []
    for p, _, h in pages:
        data = (h or "").encode()
        firsts = [q for q, _, g in pages if g == h and q is not None]
        refers = min(firsts) if p is not None and len(data) >= 100 and min(firsts) != p else None
        want.append((p, len(data), hashlib.sha256(data).hexdigest(), "revisit" if refers else "response", refers))
    assert got == sorted(want, key=str)
    folder = fresh_path(spark, "w")
    captures = warc.write_archives(spark, df, folder)
    index = warc.Index(warc.write_index(spark, captures, folder, block_lines=2))
    found = index.records("http://a.example.org/x")
    assert sorted(h["WARC-Page-ID"] for h, _, _ in found) == ["2", "3"]
    assert {h["WARC-Type"]: p for h, _, p in found} == {"revisit": b"", "response": b"short"}
    assert index.records("http://nowhere.example/") == []
    directory = warc.write_index(spark, captures, fresh_path(spark, "w"), block_lines=2)
    urls = spark.createDataFrame([("http://a.example.org/x",), ("http://nowhere.example/",), ("http://a.example.org/x",), (None,)], "url string")
    places = {tuple(r) for r in warc.located(spark, urls, directory).collect()}
    assert places == {(c.file, c.offset, c.length) for c in captures.collect() if c.page_id in (2, 3, 5)}
    assert warc.archive(spark, df.limit(0)).collect() == []


def test_one_key_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(warc.write_index, "__defaults__", (2,))
    pages = [(k, "http://hot.example/" if k % 3 else f"http://h{k % 7}.example/{k}", f"page {k}") for k in range(60)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    assert sorted(r.page_id for r in warc.archive(spark, df).collect()) == list(range(60))


def test_url_keys_sort_by_host():
    assert warc.url_key("https://www.Blog.example.com:443/A?b=C") == "com,example,blog)/a?b=c"
    assert warc.url_key("http://x.org:8080") == "org,x:8080)/"


def test_multi_index_against_brute_force(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(700, 8)).astype(np.float32)
    x[300:420] = x[5]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(9000, None), (9100, [0.0] * 8), (9200, [float("nan")] * 8), (9300, [1.0] * 3), (9400, [None] * 8), (None, [1.0] * 8)]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, cell int")
    got = {}
    for r in multi_index.search(spark, df, F.col("vec_id") % 20 == 0, candidates=400, n_centroids=6).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    assert set(got) == set(range(0, 700, 20))
    hit = 0
    for q in range(0, 700, 20):
        d = np.sqrt(((x.astype(float) - x[q].astype(float)) ** 2).sum(1))
        best = [int(j) for j in np.lexsort((np.arange(700), d)) if j != q][:10]
        assert list(sorted(got[q])) == list(range(1, 11))
        hit += len({v for v, _ in got[q].values()} & set(best))
        assert all(abs(d[v] - s) < 1e-12 for v, s in got[q].values())
        if 300 <= q < 420:
            assert [got[q][k][0] for k in range(1, 11)] == best
    assert hit >= 0.9 * 350
    assert multi_index.search(spark, df.limit(0), F.lit(True)).collect() == []
    assert multi_index.search(spark, df.where("vec_id = 3 or vec_id = 4"), F.lit(True)).count() == 2


def test_cells_come_in_order_of_summed_distance():
    a, b = np.array([3.0, 1.0, 2.0]), np.array([0.5, 0.1])
    cells = multi_index.visited(a, b, np.ones((3, 2), int), 6)
    assert [a[c // 2] + b[c % 2] for c in cells] == sorted(x + y for x in a for y in b)


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_edits_against_brute_force():
    rng = random.Random(0)
    for _ in range(60):
        a, b = [rng.randrange(4) for _ in range(rng.randrange(1, 7))], [rng.randrange(4) for _ in range(rng.randrange(0, 9))]
        want = min(edit_distance(a, b[i:j]) for i in range(len(b) + 1) for j in range(i, len(b) + 1))
        cost, i, j = decontaminate.edits(np.array(a), np.array(b))
        assert cost == want == edit_distance(a, b[i:j])


def test_decontamination_recall_and_precision(spark):
    rng = random.Random(2)
    vocabulary = [f"w{i}" for i in range(400)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(10, 50)))) for i in range(30)]
    docs, truth = [], set()
    for k in range(200):
        i, text = rng.choice(items)
        w = text.split()
        for _ in range(rng.randrange(0, int(0.2 * len(w)) + 1)):
            w[rng.randrange(len(w))] = "other"
        around = lambda: [rng.choice(vocabulary) for _ in range(rng.randrange(30))]
        docs.append((k, " ".join(around() + w + around())))
        truth.add((k, i))
    docs += [(1000 + k, " ".join(rng.choice(vocabulary) for _ in range(200))) for k in range(50)] + [(2000, None), (2001, ""), (None, items[0][1].upper())]
    df = spark.createDataFrame([(d, t, 1) for d, t in docs], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame([*items, (99, None), (98, ""), (None, "x y")], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.matches(spark, df, bench).collect()}
    assert (None, 0) in got
    assert len(truth & got) >= 0.98 * len(truth)
    assert not [g for g in got if g[0] is not None and g[0] >= 1000]
    kept = {r.doc_id for r in decontaminate.clean(spark, df, bench).collect()}
    assert kept == {d for d, _ in docs} - {d for d, _ in got}
    assert decontaminate.matches(spark, df.limit(0), bench).collect() == []
    assert decontaminate.matches(spark, df, bench.limit(0)).collect() == []


def test_token_counts_equal_library(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_str(WORD)
    library.encode_special_tokens = True
    rows = [(i, t) for i, t in enumerate(odd_texts())] + [(None, "x"), (7, None)]
    df = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, file int").repartition(3)
    got = sorted((tuple(r) for r in token_counts.token_counts(spark, df, WORD, 49407).collect()), key=str)
    assert got == sorted(((d, len(library.encode(t or "", add_special_tokens=False).ids)) for d, t in rows), key=str)
    assert token_counts.token_counts(spark, df.limit(0), WORD, 49407).collect() == []


@pytest.mark.parametrize("block", [1, 2, 3, 7, 100])
def test_scan_stitches_blocks_and_files(spark, block):
    rng = np.random.default_rng(block)
    stream = rng.choice([9, 1, 2, 3], 60).astype("<u2")
    files, at, folder = [], 0, fresh_path(spark, "s")
    for k, n in enumerate([10, 0, 1, 25, 24]):
        part = stream[at : at + n].tobytes()
        put_file(f"{folder}/{k}.bin", lambda out, part=part: out.write(part))
        files.append((f"{folder}/{k}.bin", n))
        at += n
    got = [r.n_tokens for r in token_counts.scan(spark, files, 9, 2, block).orderBy("file", "ordinal").collect()]
    ends = np.flatnonzero(stream == 9)
    assert got == (np.diff(np.r_[-1, ends]) - 1).tolist()


def labelled_docs(bad, good, n=160):
    rng = random.Random(0)
    return [(i, bad(rng) if i % 4 == 0 else good(rng), int(i % 4 == 0)) for i in range(n)]


def plain(rng, k=60):
    return " ".join("".join(rng.choice(["ba", "lo", "mi", "re", "tu"]) for _ in range(rng.randrange(1, 4))) for _ in range(k))


def test_toxicity_learns_and_scores_all(spark):
    def bad(rng):
        w = plain(rng).split()
        for _ in range(4):
            w[rng.randrange(len(w))] = rng.choice(["grunk", "grunkmi", "zorvex"])
        return " ".join(w)

    docs = labelled_docs(bad, plain)
    df = spark.createDataFrame([(d, t, "x") for d, t, _ in docs] + [(900, None, "x"), (901, "", "x"), (None, "grunk grunk", "x")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(d, y) for d, _, y in docs] + [(5, None), (None, 1)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity(spark, df, labels).collect()}
    assert len(got) == len(docs) + 3
    held = [(got[d].score, y) for d, _, y in docs if got[d].held_out]
    assert len(held) > 20
    assert np.mean([(s > 0.5) == y for s, y in held]) > 0.9
    assert got[900].score == got[901].score
    none = toxicity.toxicity(spark, df, labels.limit(0)).collect()
    assert {r.score for r in none} == {0.5}
    assert toxicity.toxicity(spark, df.limit(0), labels).collect() == []


def test_ratio_is_that_of_the_two_models():
    from collections import Counter

    a, b = Counter("idiot moron idea idle you".split()), Counter("the idea ideal of and idle".split())
    model, shared = toxicity.Model(a, b), toxicity.shared_letters(a + b)
    x, y, floor = toxicity.KneserNey(a), toxicity.KneserNey(b), min(shared.values()) / 10
    for w in ("idiot", "the", "zq", "ideas", "9x", ""):
        assert abs(model.ratio(w) - (x.log_likelihood(w, shared, floor) - y.log_likelihood(w, shared, floor))) < 1e-9


def test_quality_learns_form(spark):
    def bad(rng):
        return " ".join(w.upper() + "!!" for w in plain(rng).split())

    docs = [(d, t, 1 - y) for d, t, y in labelled_docs(bad, plain)]
    df = spark.createDataFrame([(d, t) for d, t, _ in docs] + [(900, None), (901, " "), (None, "A!! B!!")], "doc_id long, text string")
    labels = spark.createDataFrame([(d, y) for d, _, y in docs], "doc_id long, quality int")
    got = {r.doc_id: r for r in quality.quality(spark, df, labels).collect()}
    assert all((got[d].score >= 0.5) == y for d, _, y in docs if got[d].held_out)
    assert got[900].score == got[901].score
    assert {r.score for r in quality.quality(spark, df, labels.limit(0)).collect()} == {0.5}
    assert quality.quality(spark, df.limit(0), labels).collect() == []
