import random

import corpus_pipeline
from gridcalc.llm import bpe_automaton, decontaminate, quality, simhash, toxicity

from tests.llm.test_tokens import BYTE


def test_stages_on_a_small_corpus(spark, tmp_path):
    rng = random.Random(4)
    plain = lambda k=70: " ".join("".join(rng.choice(["ba", "lo", "mi", "re", "tu"]) for _ in range(rng.randrange(1, 4))) for _ in range(k))

    def toxic():
        w = plain().split()
        for _ in range(5):
            w[rng.randrange(len(w))] = rng.choice(["grunk", "grunkmi", "zorvex"])
        return " ".join(w)

    item = plain(25)
    rows, labels = [], []
    for i in range(240):
        kind = i % 6
        text = toxic() if kind == 0 else " ".join(w.upper() + "!!" for w in plain().split()) if kind == 1 else plain()
        rows.append((i, text, "en", "s", len(text)))
        if i % 3 < 2 or i % 2:
            labels.append((i, int(kind != 1), int(kind == 0)))
    copied = rows[2][1]
    rows += [(1000, copied, "en", "s", 1), (1001, copied, "en", "s", 1), (1002, f"{plain(30)} {item} {plain(30)}", "en", "s", 1), (1003, plain(), None, None, None)]
    for name, data, schema in (("documents", rows, "doc_id long, text string, lang string, source string, n_chars long"), ("labels", labels, "doc_id long, quality int, toxic int"), ("benchmark", [(7, item)], "item_id long, text string")):
        spark.createDataFrame(data, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    sf_dir = str(tmp_path)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality", "near_duplicates", "decontamination", "bpe"]

    by_id = {r[0]: r for r in rows}
    read = lambda df: {r.doc_id for r in df.collect()}
    toxic_labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.fit(spark, docs, toxic_labels)
    left = corpus_pipeline.drop_toxic(spark, docs, sf_dir)
    assert left.columns == docs.columns
    assert read(left) == {d for d, t, *_ in rows if model.score(model.evidence(t)[None, :])[0] < 0.7}
    assert not [d for d in read(left) if d < 240 and d % 6 == 0]

    good = corpus_pipeline.drop_poor(spark, left, sf_dir)
    judged, terms = quality.fit(spark, left, toxic_labels), quality.Terms()
    assert read(good) == {d for d in read(left) if judged.score(terms.vector(by_id[d][1])[None, :])[0] >= 0.5}
    assert {1000, 1001, 1002, 1003} <= read(good)

    single = corpus_pipeline.drop_near_duplicates(spark, good, sf_dir)
    groups = {r.doc_id: r.component_id for r in simhash.near_duplicates(spark, good).collect()}
    assert read(single) == {d for d, c in groups.items() if d == c}
    assert 2 in read(single) and not {1000, 1001} & read(single)

    clean = corpus_pipeline.drop_benchmark_leaks(spark, single, sf_dir)
    found = decontaminate.Searcher(decontaminate.Items([(7, item)]))
    assert read(clean) == {d for d in read(single) if not found.search([by_id[d][1]])} == read(single) - {1002}

    codec = bpe_automaton.Codec(BYTE)
    out = {r.doc_id: r for r in corpus_pipeline.encode(spark, clean, sf_dir).collect()}
    assert set(out) == read(clean)
    assert all(codec.encode(by_id[d][1]).tobytes() == r.ids and r.n_tokens == len(r.ids) // 4 for d, r in out.items())
    assert {r.doc_id for r in corpus_pipeline.run(spark, sf_dir).collect()} == set(out)


def test_repeated_and_missing_ids_in_near_duplicates(spark):
    long = "one two three four five six seven"
    df = spark.createDataFrame([(1, long, "x"), (1, long, "y"), (2, long, "z"), (None, long, "n"), (None, None, "m")], "doc_id long, text string, component_id string")
    got = sorted((r.doc_id, r.component_id) for r in simhash.one_of_each(spark, df).where("doc_id is not null").collect())
    assert len(got) == 1 and got[0][0] == 1
    assert simhash.one_of_each(spark, df).where("doc_id is null").count() == 2
