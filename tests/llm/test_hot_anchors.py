"""Lines that stand in very many texts, with ever different neighbours."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from oddsframe.llm import suffixes
from tests.llm import brute

LINE = "a common line that stands in every text of this table, and is yet shorter than a window"


@pytest.mark.parametrize("most_hot", [200_000, 0])  # hot anchors sent to all tasks, or joined
def test_a_frequent_anchor_is_split_at_any_table_size(spark, monkeypatch, most_hot):
    monkeypatch.setattr(suffixes, "MOST_HOT", most_hot)
    rng = np.random.default_rng(5)
    word = lambda n: "".join(chr(97 + c) for c in rng.integers(0, 26, n))
    tails = [word(60) for _ in range(7)]
    rows = [(k, word(80) + LINE + (tails[k % 7] if k % 3 == 0 else word(90))) for k in range(400)]
    docs = suffixes.keyed(spark.createDataFrame(rows, "doc_id long, text string").repartition(6))

    def fullest():
        sent = suffixes.sent_stretches(docs, 3, 2).where("stretch is not null")
        return sent.groupBy("anchor").agg(F.sum(F.length("stretch")).alias("n")).agg(F.max("n")).first()[0]

    assert fullest() > 20_000  # one sort holds them all: far below SORT_BYTES
    monkeypatch.setattr(suffixes, "SORT_BYTES", 30_000)
    monkeypatch.setattr(suffixes, "HOT_ROWS", 10)
    assert fullest() <= 30_000 * suffixes.HOT_SHARE
    found = {r["doc_id"]: (r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffixes.repeated_passages(docs.select(F.col("k1").alias("doc_id"), "text")).collect()}
    assert found == {k: (n, runs, hashlib.sha256(kept).hexdigest()) for (k, _), (kept, n, runs) in zip(rows, brute.cut_repeats([t for _, t in rows]))}
    assert sum(n for n, *_ in found.values()) > 0
