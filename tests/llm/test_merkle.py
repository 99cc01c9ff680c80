"""Merkle manifests against trees built node by node, for several fanouts, and their edge cases."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from oddsframe.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, tree string, node string, nodes string"


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def climbed(nodes, fanout):
    """Root, and for every node its steps (siblings left, right)."""
    steps = [[] for _ in nodes]
    level = [(h, [k]) for k, h in enumerate(nodes)]
    while len(level) > 1:
        above = []
        for at in range(0, len(level), fanout):
            run = [h for h, _ in level[at : at + fanout]]
            for j, (_, members) in enumerate(level[at : at + fanout]):
                for k in members:
                    steps[k].append(("".join(run[:j]), "".join(run[j + 1 :])))
            above.append((digest(*run), [k for _, m in level[at : at + fanout] for k in m]))
        level = above
    return level[0][0], steps


def expected(rows, fanout):
    by = {}
    for r in rows:
        leaf = digest(*[field(r[c]) for c in ("doc_id", "source", "lang", "n_chars", "text")])
        by.setdefault(r["lang"], []).append((r["doc_id"] is not None, r["doc_id"], leaf, r))
    langs = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for lang in langs:
        by[lang].sort(key=lambda x: (x[0], x[1] or 0, x[2]))
        trees[lang] = climbed([x[2] for x in by[lang]], fanout)
    root, over = climbed([trees[x][0] for x in langs], fanout)
    out = []
    for lang, above in zip(langs, over):
        for (_, i, leaf, r), steps in zip(by[lang], trees[lang][1]):
            steps = steps + above
            node = leaf
            if i is not None and zlib.crc32(str(i).encode()) % 7 == 0 and r["n_chars"] is not None:
                node = digest(*[field(r[c] + 1 if c == "n_chars" else r[c]) for c in ("doc_id", "source", "lang", "n_chars", "text")])
            for left, right in steps:
                node = digest(left, node, right)
            out.append((i, leaf, trees[lang][0], root, digest(*[x + y for x, y in steps]), node, node == root))
    return sorted(out, key=repr)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def made(spark, sizes):
    rows = [(k * 3, f"s{k % 4}", lang, None if k % 11 == 0 else k, f"text é {k}" if k % 5 else None) for lang, n in sizes.items() for k in range(n)]
    return spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA)


@pytest.mark.parametrize("sizes", [{"en": 1}, {"en": 2, "de": 1}, {"en": 257, None: 17, "é": 16, "z": 33, "Z": 3}])
def test_trees_of_any_height(spark, sizes):
    df = made(spark, sizes)
    assert rows_of(merkle.documents_manifest(df)) == expected(df.collect(), 2)


@pytest.mark.parametrize("fanout,span", [(3, 2), (16, 1), (2, 1)])
def test_other_fanouts(spark, fanout, span):
    df = made(spark, {"en": 70, "de": 1, "fr": 9})
    fields = ("doc_id", "source", "lang", "n_chars", "text")
    got = rows_of(merkle.manifest(df, fields, "doc_id", "lang", fanout=fanout, span=span))
    want = expected(df.collect(), fanout)
    assert [r[:5] for r in got] == [r[:5] for r in want] and all(r[6] for r in got)


def test_edges(spark):
    rows = [(1, "a", "en", 1, "x"), (1, "a", "en", 1, "x"), (1, "b", "en", 1, "x"), (None, None, None, None, None), (None, "a", "en", 7, ""), (21, "a", "", 3, "\x00 東京"), (7, None, None, 5, "y" * 200_000)]
    df = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA)
    assert rows_of(merkle.documents_manifest(df)) == expected(df.collect(), 2)
    assert merkle.documents_manifest(df.where("false")).collect() == []


def test_a_group_is_numbered_over_many_partitions(spark, monkeypatch):
    monkeypatch.setattr(merkle, "SORT_ROWS", 50)
    df = made(spark, {"en": 900, "de": 20})
    leaves = df.select(F.col("lang").alias("tree"), F.col("doc_id").alias("id"))
    rows = merkle.numbered(leaves, ["id"]).collect()
    assert all(r["position"] * 3 == r["id"] and r["nodes"] == (900 if r["tree"] == "en" else 20) for r in rows) and len(rows) == 920
