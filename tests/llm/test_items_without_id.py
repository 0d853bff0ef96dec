from gridcalc.llm import decontaminate


def test_clean_searches_items_without_an_id(spark):
    one, two, three = (" ".join(f"{c}{i}" for i in range(15)) for c in "abc")
    docs = spark.createDataFrame([(1, f"x {one} y"), (2, f"x {two} y"), (3, "x y z " * 9), (4, three)], "doc_id long, text string")
    bench = spark.createDataFrame([(None, one), (None, two), (7, three), (None, None)], "item_id long, text string")
    assert [r.doc_id for r in decontaminate.clean(spark, docs, bench).collect()] == [3]
