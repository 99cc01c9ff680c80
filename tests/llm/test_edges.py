"""Nulls, empty and long texts, ties, repeats, empty tables and clashing names, for every operator and stage."""

import hashlib
import zlib

import pytest

import corpus_pipeline
from oddsframe.llm import htmltext, langid, mixing, packing, search, sharding, simhash, suffixes, toxicity, winnowing
from tests.llm import brute

# names that operators use inside, as extra input columns
EXTRA = ["item", "fp", "name", "row", "k1", "k2", "spans", "tokens", "number", "copies", "block", "times", "id", "root"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in EXTRA)
LONG = " ".join(f"word{i % 5000}x{i % 7}" for i in range(40_000))
PASSAGE = "this passage of well over one hundred bytes stands in more than one of the documents, so the later one has to go now"
ROWS = [
    (1, "the cat sat on the mat and looked at the dog " * 5, "en", "a"),
    (2, "the cat sat on the mat and looked at the dog " * 5, "en", "a"),
    (2, "the cat sat on the mat and looked at the dog " * 5, "en", "a"),  # a repeated row
    (3, None, None, None),
    (4, "", "en", "b"),
    (5, " \t\n", None, "b"),
    (None, "no id here but words", "de", None),
    (None, None, None, None),
    (6, "Straße É 東京 emoji \U0001f600 \x00 end", "de", "b"),
    (7, LONG, "en", "a"),
    (8, "before " + PASSAGE, "fr", "c"),
    (9, PASSAGE + " after", "fr", "c"),
    (9, "same id, other text", "fr", "c"),
    (10, "aaaa" * 200, "xx", "c"),
    (11, "12345 67890 !!!", "en", "c"),
]
N = len(ROWS)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, len(r[1] or ""), *["clash"] * len(EXTRA)) for r in ROWS], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(1, 1, 0), (2, 1, 0), (8, 0, 1), (9, 0, 1), (9, 0, 0), (None, 1, 1), (7, None, None), (99, 1, 1)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def ids(rows):
    return sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in rows)


ALL_IDS = sorted((r[0] is None, r[0] or 0) for r in ROWS)


def test_sharding(docs, none):
    rows = sharding.assign_shards(docs, 4).collect()
    assert ids(rows) == ALL_IDS
    assert sorted((r["slot"], r["shard"]) for r in rows) == [(k // 4, k % 4) for k in range(N)]
    want = sorted((len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for _, t, *_ in ROWS)
    assert sorted((r["size"], r["text_crc32"]) for r in rows) == want
    assert sharding.assign_shards(none).collect() == []


def test_mixing(docs, none):
    rows = mixing.mixture(docs, max_repeats=3.0, block_tokens=1000).collect()
    assert set(ids(rows)) == set(ALL_IDS)
    assert all(r["epoch"] in (0, 1, 2, 3) and r["block"] >= 0 for r in rows)
    mixed = mixing.mixed(docs, max_repeats=3.0)
    assert mixed.columns == docs.columns and mixed.count() == len(rows)
    assert mixing.mixture(none).collect() == [] and mixing.mixed(none).collect() == []
    wordless = docs.where("doc_id in (3, 4, 5)")
    assert mixing.mixed(wordless).count() == 3


def test_packing(docs, none):
    rows = packing.pack(docs, (16, 64, 256), 50).collect()
    assert set(ids(rows)) == set(ALL_IDS)
    assert sum(r["tokens"] for r in rows) == sum(len(brute.words(r[1])) for r in ROWS)
    assert all(r["offset"] + r["tokens"] <= r["capacity"] for r in rows if r["sequence"] is not None)
    assert packing.pack(none).collect() == []


def test_simhash(docs, none):
    rows = simhash.near_duplicates(docs).collect()
    assert ids(rows) == ALL_IDS
    fps = [brute.simhash(t) for _, t, *_ in ROWS]
    roots = brute.classes(fps)
    least = {}
    for (i, *_), root in zip(ROWS, roots):
        if i is not None:
            least[root] = min(i, least.get(root, i))
    want = sorted((str(i), f"{f:016x}", str(least.get(r))) for (i, *_), f, r in zip(ROWS, fps, roots))
    assert sorted((str(r["doc_id"]), r["fingerprint"], str(r["component_id"])) for r in rows) == want
    left = simhash.deduplicated(docs)
    assert left.columns == docs.columns and left.count() == len(set(roots))
    assert simhash.near_duplicates(none).collect() == [] and simhash.deduplicated(none).collect() == []


def test_suffixes(docs, none):
    rows = {(r["doc_id"], r["n_bytes"]): r for r in suffixes.repeated_passages(docs).collect()}
    one = {(i, t or ""): None for i, t, *_ in ROWS}  # rows equal in id and text are one document
    order = sorted(one, key=lambda k: (k[0] is None, k[0] or 0, k[1] != PASSAGE + " after"))
    for (i, text), (kept, removed, runs) in zip(order, brute.cut_repeats([t for _, t in order])):
        r = rows[(i, len(text.encode()))]
        assert (r["n_removed"], r["n_spans"], r["kept_sha256"]) == (removed, runs, hashlib.sha256(kept).hexdigest()), i
    assert suffixes.repeated_passages(docs).count() == N
    clean = suffixes.cleaned(docs)
    assert clean.columns == docs.columns and clean.count() == N
    assert clean.where("doc_id = 3").first()["text"] is None
    assert suffixes.repeated_passages(none).collect() == [] and suffixes.cleaned(none).collect() == []


def test_winnowing(docs, none):
    rows = winnowing.fingerprints(docs).collect()
    assert ids(rows) == ALL_IDS
    by_text = {}
    for r in rows:
        by_text.setdefault(r["doc_id"], r["fingerprint"])
    assert by_text[1] == by_text[2] and by_text[3] == by_text[4] == ""
    alone = winnowing.fingerprints(docs.where("doc_id = 8")).first()
    text = "before " + PASSAGE
    half = len(text) // 2
    assert alone["edited_sha256"] == hashlib.sha256((text[: len(text) - half] + text[:half]).encode()).hexdigest() and alone["near_next"] == 1.0
    assert winnowing.fingerprints(none).collect() == []


def test_languages(docs, none):
    rows = langid.languages(docs).collect()
    assert ids(rows) == ALL_IDS
    assert all(0 <= r["score"] <= 1 for r in rows)
    assert {r["doc_id"]: r["lang_pred"] for r in rows if r["doc_id"] in (3, 4, 5, 11)} == dict.fromkeys((3, 4, 5, 11), "und")
    assert langid.languages(none).collect() == []
    assert {r["lang_pred"] for r in langid.languages(docs.where("doc_id = 6 or lang is null")).collect()} <= {"und", "de"}


def test_toxicity(spark, docs, none, labels):
    rows = toxicity.scores(docs, labels).collect()
    assert ids(rows) == ALL_IDS
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) and r["held_out"] == brute.held_out(r["doc_id"]) for r in rows)
    assert toxicity.accepted(docs, labels).columns == docs.columns
    empty = labels.where("false")
    assert {r["score"] for r in toxicity.scores(docs, empty).collect()} == {0.0}
    assert toxicity.accepted(docs, empty).count() == N
    assert toxicity.scores(none, labels).collect() == [] and toxicity.accepted(none, labels).collect() == []


def test_search(docs, none):
    rows = search.search(docs, docs.where("doc_id in (1, 3, 4, 8)"), k=3).collect()
    found = {}
    for r in rows:
        found.setdefault(r["query_id"], []).append((r["rank"], r["doc_id"]))
    assert set(found) == {1, 8} and [d for _, d in sorted(found[1])] == [1, 2, 2] and sorted(found[8])[0] == (1, 8)
    assert search.search(docs, none).collect() == [] and search.search(none, none).collect() == []


def test_pages(spark):
    schema = "page_id long, url string, html string, text string"
    pages = [(1, None, "<p>a<p>b", "clash"), (1, "u", "<p>a<p>b", None), (2, "u", None, ""), (3, "u", "", ""), (None, "u", "<td>x" * 3000, ""), (4, "u", "<" * 1000 + "&#xfffffff;&nope;", "")]
    rows = htmltext.pages_text(spark.createDataFrame(pages, schema)).collect()
    assert len(rows) == 6 and [r["text"] for r in rows[:4]] == ["a\n\nb", "a\n\nb", "", ""] and rows[4]["n_chars"] >= 3000
    assert htmltext.pages_text(spark.createDataFrame([], schema)).collect() == []


@pytest.mark.parametrize("stage", range(5))
def test_stages(spark, docs, none, labels, tmp_path, stage):
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    name, step = corpus_pipeline.STAGES[stage]
    for df in (docs, none):
        out = step(spark, df, str(tmp_path))
        rows = out.collect()
        assert stage == 4 or out.columns == docs.columns, name
        assert rows if df is docs else rows == []
