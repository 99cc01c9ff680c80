"""Plain page files: each page is either parsed or a dead letter with its reason."""

import pytest
from pyspark.sql import functions as F

from oddsframe.sources import pages, scripts

GOOD = 'A[1]="7^c^L^L^^h^H^^a^A^^22:00^d^0^1^2".split(\'^\');'
PAGES = {
    "a.js": (GOOD.encode(), None),
    "b.js": (b"\xef\xbb\xbf", "empty"),
    "c.js": (b" \r\n\t", "empty"),
    "d.js": (b"<title>404 Not Found</title>", "error_page"),
    "e.js": (b"var A=[];", "unparsed"),
    "f.js": (GOOD[:-12].encode(), "unparsed"),
    "g.js": (("<p>澳門彩票威廉希爾立博香港馬會</p>" + GOOD).encode(), None),
}


@pytest.fixture
def files(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for name, (body, _) in PAGES.items():
        (folder / name).write_bytes(body)
    (folder / "notes.txt").write_bytes(b"no page")
    (folder / "z.js").write_bytes(b"")  # Spark lists no file without a byte
    return pages.read_page_files(spark, str(folder), "*.js").withColumn("content_type", F.lit(""))


def test_every_page_is_in_one_of_the_two_outputs(files, tmp_path):
    triaged = pages.triage(pages.decode_pages(files), scripts.is_live_list(F.col("text")))
    good, dead = pages.split_pages(triaged, str(tmp_path / "split"))
    name = lambda r: r["url"].rsplit("/", 1)[1]
    assert {name(r): r["reason"] for r in dead.collect()} == {n: why for n, (_, why) in PAGES.items() if why}
    assert sorted(map(name, good.collect())) == sorted(n for n, (_, why) in PAGES.items() if not why)
    assert "reason" not in good.columns and {bytes(r["body"]) for r in good.collect()} == {b for b, why in PAGES.values() if not why}


def test_file_names_are_matched_when_folders_are_listed(files):
    assert files.count() == len(PAGES)
    assert set(files.columns) == {"url", "fetched_at", "body", "content_type"}


def test_null_pages_and_unknown_answers_are_dead_letters(rows, tmp_path):
    df = rows([(1, None), (2, "x"), (3, "y")], "id int, text string")
    triaged = pages.triage(df, F.when(F.col("id") == 2, F.lit(None)).otherwise(F.lit(True)))
    good, dead = pages.split_pages(triaged, str(tmp_path / "split"))
    assert [r["id"] for r in good.collect()] == [3]
    assert {r["id"]: r["reason"] for r in dead.collect()} == {1: "empty", 2: "unparsed"}


def test_no_pages(rows, tmp_path):
    triaged = pages.triage(rows([], "id int, text string"), F.lit(True))
    assert [t.count() for t in pages.split_pages(triaged, str(tmp_path / "split"))] == [0, 0]


def test_page_files_are_shared_out_and_a_key_keeps_one_file(spark, tmp_path):
    rows = [(k % 20, f"text {k}") for k in range(40)] + [(None, "no key")]
    texts = spark.createDataFrame(rows, "page_id int, value string").coalesce(1)
    pages.write_page_files(texts, str(tmp_path / "in"), "page_id")
    found = list((tmp_path / "in").glob("page_id=*/part-*"))
    assert len(found) == len({f.parent for f in found}) == 21
    assert len({f.name.split("-")[1] for f in found}) > 1  # more tasks than the one that held the rows
    lines = sorted(line for f in found for line in f.read_text().splitlines())
    assert lines == sorted(value for _, value in rows)
