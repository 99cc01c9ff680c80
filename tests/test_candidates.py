"""Candidate search of the linking operators against all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from oddsframe import dims
from oddsframe.functions import text as T
from oddsframe.operators import link

NAMES = "snapshot_id int, match_id string, home string, home_en string, away string, away_en string, league string, kickoff_min long, clock_only boolean"
WORDS = ["red", "star", "blue", "moon", "north", "end", "city", "rovers", "fc", "united", "saint", "a", "ab", "東京", "大阪", "é", "FC", "u21", "Real", "Ath"]


def spelling(rnd, word):
    """A word, sometimes with an edit."""
    at = rnd.randrange(len(word))
    return rnd.choice([word, word, word, word[:at] + word[at + 1 :], word[:at] + rnd.choice("abcxyz") + word[at:], word[::-1]])


def name(rnd):
    alias = rnd.choice(rnd.choice(dims.TEAM_ALIASES))
    return rnd.choice([alias, "", None, *[" ".join(spelling(rnd, rnd.choice(WORDS)) for _ in range(rnd.randrange(1, 4))) for _ in range(5)]])


def sides(rnd, n, prefix):
    leagues = ["premier league", "Premier Lg", "j1", "cup", "", None, *[a for g in dims.COMPETITION_ALIASES[:2] for a in g[:2]]]
    return [(rnd.randrange(2), f"{prefix}{k}", *[name(rnd) for _ in range(4)], rnd.choice(leagues), rnd.choice([None, rnd.randrange(400)]), rnd.random() < 0.2) for k in range(n)]


@pytest.mark.parametrize("seed", [1, 2])
def test_links_equal_those_of_all_pairs(spark, rows, monkeypatch, seed):
    rnd = random.Random(seed)
    monkeypatch.setattr(link, "ENTRIES_PER_PACK", 40)
    m = rows(sides(rnd, 90, "m"), NAMES)
    p = rows([(*r, k) for k, r in enumerate(sides(rnd, 120, "p"))], NAMES + ", source_index long").withColumnRenamed("match_id", "id")
    entry = F.struct("id", F.col("source_index").alias("ix"), link.link_key(p).alias("key"))
    pairs = m.select("snapshot_id", "match_id", link.link_key(m).alias("_m")).join(p.select("snapshot_id", F.array(entry).alias("c")), "snapshot_id")
    scored = pairs.select("snapshot_id", "match_id", link.pair_scores(F.col("_m"), F.col("c"))[0].alias("b")).cache()
    best = {r["match_id"]: r["b"] for r in scored.groupBy("match_id").agg(F.max("b").alias("b")).collect()}
    for r in link.link_matches(m, p).collect():
        b = best.get(r["match_id"])
        assert r["score"] == (b["score"] if b else 0)
        if r["status"] != "not_found":
            assert (r["matched_id"], r["team_score"], r["swapped"]) == (b["matched_id"], b["team_score"], b["swapped"])
    good = scored.select("match_id", "b.*").where("not swapped and home_score >= 75 and away_score >= 75 and time_score >= 80 and score >= 85")
    want = {}
    for r in good.orderBy("match_id", F.desc("score"), F.desc("neg_ix")).collect():
        want.setdefault(r["match_id"], []).append(r)
    want = {k: v[0]["matched_id"] for k, v in want.items() if len(v) == 1 or v[0]["score"] - v[1]["score"] >= 5}
    assert {r["match_id"]: r["matched_id"] for r in link.gated_pool_match(m, p).collect()} == want


def test_few_pairs_of_a_large_snapshot_are_scored(rows):
    rnd = random.Random(7)
    syllables = ["ka", "ro", "mi", "ten", "lu", "sa", "por", "ving", "he", "no", "stad", "burg"]
    team = lambda: "".join(rnd.choice(syllables) for _ in range(rnd.randrange(2, 5))) + rnd.choice([" fc", " united", ""])
    n = 1500
    p = [(1, str(k), team(), team(), rnd.choice(["lg one", "lg two", "cup"]), rnd.randrange(2000), k) for k in range(n)]
    m = [(1, f"m{k}", spelling(rnd, h), a, lg, t + rnd.randrange(5)) for k, (_, _, h, a, lg, t, _) in enumerate(p)]
    m = rows(m, "snapshot_id int, match_id string, home string, away string, league string, kickoff_min long")
    p = rows(p, "snapshot_id int, id string, home string, away string, league string, kickoff_min long, source_index long")
    assert link.pairs_to_score(m, p, ["snapshot_id"]).count() < 0.02 * n * n
    assert link.link_matches(m, p).where(F.col("status") == "open").count() > 0.95 * n


def fixture_rows(rnd, n):
    word = lambda: spelling(rnd, rnd.choice([*WORDS, "xx", "real madrid", "ab cd ef gh ij"]))
    return [(rnd.randrange(2), f"x{k}", *[rnd.choice([None, ""] + [" ".join(word() for _ in range(rnd.randrange(1, 5))) for _ in range(8)]) for _ in range(4)], k) for k in range(n)]


@pytest.mark.parametrize("seed", [3, 4])
def test_fixture_links_equal_those_of_all_pairs(rows, seed):
    rnd = random.Random(seed)
    schema = "batch_id int, match_id string, home string, home_s string, away string, away_s string, source_index long"
    m, f = rows(fixture_rows(rnd, 80), schema), rows(fixture_rows(rnd, 100), schema).withColumnRenamed("match_id", "fixture_id")
    key = lambda *cols: F.array(*[T.fixture_name_key(F.col(c)) for c in cols])
    left = m.select("batch_id", "match_id", key("home", "home_s").alias("h"), key("away", "away_s").alias("a"))
    right = f.select("batch_id", "fixture_id", "source_index", key("home")[0].alias("fh"), key("away")[0].alias("fa"))
    both = left.join(right, "batch_id")
    score = lambda one, two: (link._best_name(F.col("h"), F.col(one)) + link._best_name(F.col("a"), F.col(two))) / 2.0
    scored = both.select("match_id", F.struct(F.greatest(score("fh", "fa"), score("fa", "fh")).alias("score"), (-F.col("source_index")).alias("ix"), "fixture_id").alias("b"))
    want = {r["match_id"]: (r["b"]["score"], r["b"]["fixture_id"]) for r in scored.groupBy("match_id").agg(F.max("b").alias("b")).where("b.score >= 0.58").collect()}
    got = {r["match_id"]: (r["score"], r["fixture_id"]) for r in link.link_fixtures(m, f).collect()}
    assert got == want and want
    assert link.fixture_candidates(m, f, 0.58, ["batch_id"]).count() < 0.6 * both.count()
