"""Successors of documents must not depend on how often or where Spark computes a range."""

import numpy as np
import pytest

from oddsframe.llm import winnowing


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture(scope="module")
def many(spark):
    rng = np.random.default_rng(4)
    ids = rng.permutation(200_000)[:40_000]
    return spark.createDataFrame([(int(i), f"text number {i % 977} of many " * (1 + int(i) % 3)) for i in ids], "doc_id long, text string").repartition(7)


def test_same_rows_with_and_without_reuse(spark, many):
    want = rows_of(winnowing.fingerprints(many))
    assert len({r[0] for r in want}) == len(want) == 40_000
    for reuse, partitions in (("false", "8"), ("false", "300"), ("true", "3")):
        spark.conf.set("spark.sql.exchange.reuse", reuse)
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        try:
            assert rows_of(winnowing.fingerprints(many, range_bytes=200_000)) == want
        finally:
            spark.conf.unset("spark.sql.exchange.reuse")
            spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_pieces_do_not_show(monkeypatch):
    rng = np.random.default_rng(9)
    texts = ["".join(chr(97 + int(c)) for c in rng.integers(0, 3, n)) for n in (0, 1, 24, 25, 99, 100, 101, 500, 3000)] + ["ab" * 700, "é東\U0001f600" * 300]
    whole = [winnowing.winnow(t).tolist() for t in texts]
    for piece in (1, 7, 64):
        monkeypatch.setattr(winnowing, "PIECE", piece)
        assert [winnowing.winnow(t).tolist() for t in texts] == whole


def test_a_text_of_fifty_megabytes_keeps_memory_bounded():
    import resource

    text = "a sentence of words that differ 0123456789 " * (50_000_000 // 43)
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    chosen = winnowing.winnow(text)
    assert len(chosen) > 100_000 and resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 250_000  # KB
    assert len(winnowing.hashes_of(chosen)) < 100
