"""Search ranks by rounded score, then id."""

import numpy as np

from oddsframe.llm import search


def test_equal_rounded_scores_go_by_id():
    values = np.full(1000, 0.5)
    values[[900, 300, 10]] = 1.00002, 1.00001, 1.0
    n = np.ones(1000, np.int64)
    shard = search.Shard(np.arange(1000), np.arange(1000) * 7 % 1000, n, np.zeros(1000, np.int32), n.astype(np.uint32), values, 1)
    for k, want in ((1, [10]), (2, [10, 300]), (3, [10, 300, 900])):
        assert shard.ids[shard.best(np.array([0]), k)[0]].tolist() == want
