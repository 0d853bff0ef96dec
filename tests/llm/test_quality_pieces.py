import numpy as np

from gridcalc.llm import quality


def test_all_of_a_long_word_counts():
    terms = quality.Terms()
    start = "ab1,cd2;"
    assert not np.array_equal(terms.vector(start + "ef" * 9), terms.vector(start + "EF3!" * 9))
    assert "".join(quality.pieces(start * 5)) == start * 5
    assert all(len(quality.shape(p)) <= 2 * quality.PIECE_RUNS for p in quality.pieces(start * 5))
    assert quality.pieces("Word,") == ["Word,"]
