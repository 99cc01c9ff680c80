"""Queries answered together by a shard, and thresholds that the first files of an index give the others."""

import numpy as np
from pyspark.sql import functions as F

from oddsframe.llm import search

K = 5


def test_queries_of_a_part_with_and_without_floors():
    rng = np.random.default_rng(3)
    n_terms, n_docs = 3000, 700
    bags = [np.unique(np.minimum(rng.zipf(1.3, 120) - 1 + rng.integers(0, 40, 120), n_terms - 1)) for _ in range(n_docs)]
    values = [rng.random(len(b)) + 0.01 for b in bags]
    dense = np.zeros((n_docs, n_terms))
    for d, (b, v) in enumerate(zip(bags, values)):
        dense[d, b] = v
    sizes = np.array([len(b) for b in bags])
    assert (dense > 0).any(axis=0).sum() > search.COMMON  # both common and rare words
    shard = search.Shard(np.arange(n_docs)[::-1].copy(), sizes, sizes, np.concatenate(bags).astype(np.int32), np.ones(sizes.sum(), np.uint32), np.concatenate(values), n_terms)
    asked = bags[::20]
    part = search.Part(np.concatenate(asked).astype(np.int32), np.array([len(b) for b in asked]), shard.column)
    scores = np.array([dense[:, b].sum(axis=1) for b in asked])
    order = np.lexsort((np.broadcast_to(np.arange(n_docs)[::-1], scores.shape), -np.round(scores, search.DIGITS)), axis=1)[:, :K]
    want = np.take_along_axis(scores, order, axis=1)
    opened = []
    for floor in (np.zeros(len(asked)), want[:, K - 1] - search.TIE):
        query, place, score, blocks = shard.search(part, floor, K)
        assert query.tolist() == np.repeat(np.arange(len(asked)), K).tolist() and np.allclose(score, want.ravel())
        assert shard.ids[place].tolist() == (n_docs - 1 - order).ravel().tolist() and (floor <= want[:, K - 1]).all()
        opened.append(blocks)
    assert opened[1] <= opened[0] <= len(asked) * shard.n_blocks
    query, _, score, _ = shard.search(part, want[:, 1] - search.TIE, K)  # what can't reach the floor is left out
    assert (np.bincount(query, minlength=len(asked)) < K).all() and np.allclose(score, np.concatenate([w[:n] for w, n in zip(want, np.bincount(query))]))
    assert [len(x) for x in shard.search(part, np.full(len(asked), 1e9), K)[:3]] == [0, 0, 0]


def test_later_files_return_what_reaches_the_first_thresholds(spark, monkeypatch):
    words = F.transform(F.sequence(F.lit(1), F.lit(30)), lambda k: F.concat(F.lit("w"), F.floor(F.pow(F.pmod(F.xxhash64("id", k), F.lit(1000)) / 100.0, F.lit(3.0))).cast("string")))
    docs = spark.range(0, 2000, 1, 20).select(F.when(F.col("id") % 97 != 5, F.col("id")).alias("doc_id"), F.concat_ws(" ", words).alias("text"))
    asked = docs.where("doc_id % 100 = 0").unionByName(docs.where("doc_id = 300"))  # a query that is given twice
    passes, hits = [], search._hits
    monkeypatch.setattr(search, "_hits", lambda *args: passes.append(hits(*args)) or passes[-1])
    found = sorted(map(tuple, search.search(docs, asked, K).collect()))
    assert len(found) == K * 20 and len(passes) == 2
    later = passes[1].agg(F.sum(F.length("ids") / 8)).first()[0]
    assert later < K * 21 * 8  # without thresholds: K for each query from each of 17 files
    passes.clear()
    assert sorted(map(tuple, search.search(docs.coalesce(1), asked, K).collect())) == found and len(passes) == 1


def test_long_documents_are_matched_piece_by_piece(monkeypatch):
    rng = np.random.default_rng(5)
    n_terms, n_docs = 4000, 130
    bags = [np.unique(rng.integers(0, n_terms, 3000 if d % 3 == 0 else 50)) for d in range(n_docs)]
    sizes = np.array([len(b) for b in bags])
    values = rng.random(sizes.sum()) + 0.01
    shard = search.Shard(np.arange(n_docs), sizes, sizes, np.concatenate(bags).astype(np.int32), np.ones(sizes.sum(), np.uint32), values, n_terms)
    part = search.Part(np.concatenate(bags).astype(np.int32), sizes, shard.column)
    whole = shard.search(part, np.zeros(n_docs), K)
    longest, repeat = [], np.repeat
    monkeypatch.setattr(search, "MATCHES", 20_000)
    monkeypatch.setattr(search.np, "repeat", lambda *args: longest.append(len(out := repeat(*args))) or out)
    pieces = shard.search(part, np.zeros(n_docs), K)
    assert all(np.array_equal(a, b) for a, b in zip(whole[:2], pieces[:2])) and np.allclose(whole[2], pieces[2])
    assert max(longest) < 20_000 + n_docs < 64 * 43 * 1000
