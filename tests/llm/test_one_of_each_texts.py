import corpus_pipeline
import pytest

from gridcalc.llm import shingle_sets, simhash


@pytest.mark.parametrize("roots", [simhash.roots, shingle_sets.roots])
def test_only_the_row_that_is_a_copy_goes(spark, roots):
    x, y, z = (" ".join(f"{c}{i}" for i in range(30)) for c in "xyz")
    df = spark.createDataFrame([(5, x, 1), (5, y, 2), (1, y, 3), (6, x, 4), (3, x, 5), (7, x, 6), (7, z, 7), (8, None, 8), (9, "", 9), (None, x, 10)], "doc_id long, text string, key int")
    got = sorted(r.key for r in simhash.one_of_each(spark, df, roots).collect())
    assert got == [3, 5, 7, 8, 10]


def test_repeated_rows_leave_one(spark):
    x = " ".join(f"x{i}" for i in range(30))
    df = spark.createDataFrame([(5, x, "a"), (5, x, "b"), (6, x, "c")], "doc_id long, text string, root string")
    got = corpus_pipeline.drop_near_duplicates(spark, df, "").collect()
    assert [r.doc_id for r in got] == [5]
    assert corpus_pipeline.drop_near_duplicates(spark, df.limit(0), "").collect() == []
