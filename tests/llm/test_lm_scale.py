import numpy as np

from cairnspark.llm import lm


def test_scores_are_finite_after_very_many_occurrences():
    """A byte that followed a context 2**26 times without exception leaves the others a probability."""
    slot = lm.PAD << 8 | lm.PAD
    keys = np.array([slot << 8 | 0x7F], np.int64).astype(np.int32)
    row_of, rows = lm.short_contexts(keys, np.array([1 << 26]))
    assert rows.max() < 1
    words = [b"\x7f ", b"a "]
    score = lm.word_scores(words, np.array([0, 0]), lm.NONE, lm.NONE, row_of, rows, lm.NONE, np.zeros(1, np.int64))
    assert np.isfinite(score).all() and score[1] < score[0]
