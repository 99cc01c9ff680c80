"""Work that must not be repeated, nor sit in one task, when tables grow."""

import re

import pandas as pd
from pyspark.sql import functions as F

from oddsframe.functions import text as T
from oddsframe.operators import context as C
from oddsframe.operators import documents
from oddsframe.operators import link as R
from oddsframe.operators import ordered
from oddsframe.sources import crowd, feeds, tables
from oddsframe.streaming import keyed


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def _snapshots(spark, n):
    rows = spark.range(n).select(
        F.col("id").alias("snapshot_id"), F.col("id").cast("string").alias("match_id"), F.concat(F.lit("alpha town "), "id").alias("home"),
        F.concat(F.lit("beta city "), "id").alias("away"), F.lit("cup").alias("league"), F.lit(60).alias("kickoff_min"),
    )
    return rows, rows.withColumns({"id": F.concat(F.lit("p"), "match_id"), "source_index": F.col("snapshot_id")}).drop("match_id")


def test_gate_scores_a_pair_once(spark):
    matches, catalog = _snapshots(spark, 3)
    once = _plan(R._scored(matches, catalog, ["snapshot_id"])).count("levenshtein(")
    out = R.gated_pool_match(matches, catalog)
    assert _plan(out).count("levenshtein(") == once
    assert {(r.match_id, r.matched_id, r.score) for r in out.collect()} == {(str(k), f"p{k}", 100) for k in range(3)}


def test_small_snapshots_share_tasks(spark):
    matches, catalog = _snapshots(spark, 300)
    pairs = R.pairs_to_score(matches, catalog, ["snapshot_id"])
    assert pairs.count() == 300
    assert pairs.rdd.getNumPartitions() <= int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_injuries_of_a_squad_belong_to_all_its_fixtures(spark):
    matches, _ = _snapshots(spark, 4)
    matches = matches.withColumn("batch_id", F.lit(1)).drop("snapshot_id", "kickoff_min")
    fixtures = matches.select("batch_id", F.col("match_id").cast("long").alias("fixture_id"), F.col("match_id").cast("long").alias("source_index"), "home", "away")
    ids = fixtures.select("fixture_id")
    rosters = spark.createDataFrame([(0, 7), (1, 7), (1, 7), (2, 8), (3, None)], "fixture_id long, squad int")
    hurt = spark.createDataFrame([(7, "A"), (7, "A"), (7, "B"), (9, "C"), (None, "D")], "squad int, player string")
    named = C.assemble_context(matches, fixtures, rosters.join(hurt, "squad").drop("squad"), ids, ids)["injuries"]
    shared = C.assemble_context(matches, fixtures, hurt, ids, ids, rosters=rosters)["injuries"]
    assert sorted(shared.columns) == sorted(named.columns)
    rows = lambda df: sorted(tuple(r) for r in df.select(sorted(named.columns)).collect())
    assert rows(shared) == rows(named) and rows(shared)


def test_classes_of_many_characters_are_ranges(spark):
    chars = [a for a, _ in T._compatible(False)[2]]
    pattern = T._any_of(chars)
    assert len(pattern) < len(chars)
    every = [chr(n) for n in range(0x80, 0x20000) if not 0xD800 <= n < 0xE000]
    assert {c for c in every if re.fullmatch(pattern, c)} == {c for c in every if c in set(chars)}


def test_crowd_sections_are_found_once(spark):
    page = spark.createDataFrame([(1, "<p>x</p>")], "page_id int, body string")
    assert _plan(crowd.parse_crowd_index(page)).count("IsExpert_") == 2  # one for each market


def test_cells_are_cut_without_patterns(spark):
    page = spark.createDataFrame([(1, '<table id="odds"><TR class="a"><td\n x="1">A<b>c</b></td><TH>B</TH ></tH></tr></table>')], "page_id int, body string")
    rows = page.select(F.explode(tables.html_rows(F.col("body"))).alias("r")).select("r")
    assert "^<[^>]*>" not in _plan(rows)
    cells = rows.first().r.cells
    assert [(c.tag, c.html) for c in cells] == [('<td\n x="1">', "A<b>c</b>"), ("<TH>", "B</TH >")]


def test_ticks_of_a_key_are_merged_without_sorting_frames(monkeypatch):
    ticks = pd.DataFrame({"at_us": [5, 3, 3, 5], "event_id": [1, 9, 2, 4], "price": [1.5, 2.5, 3.5, float("nan")]})
    monkeypatch.delattr(pd.DataFrame, "sort_values")
    value = keyed.merged(None, ticks)
    assert value[:5] == (3, 2, 3.5, 5, 4) and value[5] != value[5] and value[6] == 4
    assert keyed.merged((1, 1, 1.0, 9, 9, 9.0, 2), ticks) == (1, 1, 1.0, 9, 9, 9.0, 6)


def test_description_of_a_line_is_worked_out_once(spark):
    lines = "<p>•胜:90%</p><p>近12场相同胜平负</p><p>•大:85% •小:80%</p><p>近12场相同總進球數</p><p>赢:85% 近30场让球</p><p>赢:85% 近30场让球</p><p>输:85%</p>"
    df = spark.createDataFrame([(1, f"<h3>概率</h3>{lines}"), (1, f"<h3>概率</h3>{lines}"), (2, "概率<p>大:79% 近12场进球数</p>"), (3, None)], "page_id int, body string")
    out = feeds.parse_probability_text(df)
    assert _plan(out).count("·•-]+") == 1
    got = sorted((r.page_id, r.line, r.description, r.type, r.percent) for r in out.collect())
    goals = [(1, "•大:85% •小:80%", "近12场相同總進球數", t, p) for t, p in (("大", 85.0), ("小", 80.0))]
    assert got == sorted([*goals, (1, "赢:85% 近30场让球", "近30场让球", "赢", 85.0)])


def test_injuries_read_only_named_columns(spark):
    doc = '{"response":[{"player":{"id":7,"name":"A","type":"Out","reason":"Knee"},"team":{"id":"t","name":"T"},"fixture":{"id":1.5}},{"player":null}]}'
    df = spark.createDataFrame([(1, doc), (2, "{")], "page_id int, body string")
    whole, some = feeds.parse_context_json(df, "injuries"), feeds.parse_context_json(df, "injuries", columns=["player", "fixture_id"])
    assert whole.columns == ["page_id", "pos", "player", "player_id", "team", "team_id", "type", "reason", "fixture_id"]
    assert [tuple(r) for r in whole.collect()] == [(1, 0, "A", "7", "T", "t", "Out", "Knee", "1.5"), (1, 1, *[None] * 7)]
    assert [tuple(r) for r in some.collect()] == [(1, 0, "A", "1.5"), (1, 1, None, None)]
    assert "reason" not in _plan(some) and "reason" in _plan(whole)


def test_squad_shuffles_slots_and_matches_once(spark):
    schema = "match_id string, team_pos int, team string, formation string, coach string, role string, pos int, name string, number string, position string"
    slot = lambda m, t, role, pos, name, at="M": (m, t, f"T{t}", "4-4-2", "C", role, pos, name, str(pos), at)
    people = [
        slot("1", 0, "start", 0, "A"), slot("1", 0, "start", 0, "B"), slot("1", 0, "start", 1, None), slot("1", 0, "substitute", 0, "A", "G"),
        slot("1", 1, "start", 0, "D"), slot("2", 0, "substitute", 1, "E"), slot("3", 0, "start", 0, ""), slot("4", 0, "substitute", 0, None),
    ]
    out = documents.squad(spark.createDataFrame(people, schema))
    assert out._jdf.queryExecution().sparkPlan().toString().count("ObjectHashAggregate") == 2  # partial and final of one list a match
    got = {r.match_id: (r.full_squad_list and [tuple(p) for p in r.full_squad_list], r.probable_xi and [(x.team_pos, x.team, [tuple(p) for p in x.start_xi]) for x in r.probable_xi]) for r in out.collect()}
    assert got == {
        "1": ([("A", "T0", "G"), ("D", "T1", "M")], [(0, "T0", [("A", "0", "M"), (None, "1", "M")]), (1, "T1", [("D", "0", "M")])]),
        "2": ([("E", "T0", "M")], None),
        "3": (None, [(0, "T0", [("", "0", "M")])]),
    }


def test_few_runs_of_numbered_rows_are_broadcast(spark):
    rows = spark.range(200_000).select((F.col("id") % 3).alias("k"), F.col("id").alias("n"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "100000")
    try:
        out = ordered.numbered(rows, ["k"], ["n"], "at")
        assert "BroadcastHashJoin" in out._jdf.queryExecution().sparkPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert out.where(F.col("at") != F.floor(F.col("n") / 3) + 1).count() == 0
