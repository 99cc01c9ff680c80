"""Hot keys against brute force, row-order independence, and plan shapes."""

import os
import random
import statistics

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from oddsframe.operators import cache, documents, features, link, ordered, pools, quotes, select
from oddsframe.operators.ordered import previous_row
from oddsframe.plans import load_all
from oddsframe.plans.registry import QUERIES
from oddsframe.streaming import streams

SF = "/root/testdata/sf0.001"
load_all()


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def skewed(n=3000, seed=7):
    """A third of the rows on one key."""
    rnd = random.Random(seed)
    return [("hot" if rnd.random() < 0.4 else f"k{rnd.randrange(40)}", i, rnd.choice(["", "", "a", "b", "c"])) for i in range(n)]


def test_carry_forward_over_blocks(rows):
    data = skewed()
    out = quotes.carry_forward(rows(data, "k string, i long, v string"), "v", ["k"], F.floor(F.col("i") / 97), ["i"])
    seen, want = {}, {}
    for k, i, v in data:
        seen[k] = v or seen.get(k)
        want[i] = seen[k]
    assert {r.i: r.v_carried for r in out.collect()} == want


def test_previous_row_and_running_number(rows):
    df = rows(skewed(), "k string, i long, v string")
    prev = {r.i: r.prev.i if r.prev else None for r in previous_row(df, ["k"], F.floor(F.col("i") / 50), ["i"], ["i"]).collect()}
    number = {r.i: r.row_no for r in select.running_number(df, ["k"], "i", block=64).collect()}
    last, count = {}, {}
    for k, i, _ in skewed():
        assert prev[i] == last.get(k) and number[i] == count.get(k, 0)
        last[k], count[k] = i, count.get(k, 0) + 1


def test_latest_and_main_line_do_not_depend_on_row_order(rows):
    rnd = random.Random(3)
    data = [("1", "asian", "full", rnd.choice(["47", "3", "8"]), rnd.random() < 0.5, i, None) for i in range(300)]
    schema = "match_id string, market string, period string, company_id string, is_multi_line boolean, source_index long, changed_at timestamp_ntz"
    results = []
    for _ in range(2):
        rnd.shuffle(data)
        df = rows(data, schema)
        main = quotes.filter_bookmakers(df)
        results.append((sorted(map(str, quotes.latest_quote(df).collect())), sorted(map(str, main.select(*df.columns).collect()))))
    assert results[0] == results[1]


def test_features_of_a_hot_match(rows):
    rnd = random.Random(11)
    data = [("hot" if i % 5 < 2 else f"m{rnd.randrange(30)}", "asian", "full", rnd.choice("pqrs"), rnd.random() < 0.2, False, rnd.randrange(70, 110) / 100,
             None, rnd.choice([None, 0.81, 0.9, 1.0]), rnd.randrange(-8, 9) / 4, 0.9, None, 0.9, 0.0) for i in range(4000)]
    schema = "match_id string, market string, period string, bookmaker string, is_multi_line boolean, is_closed boolean, " + ", ".join(
        f"{w}_{c} double" for w in ("cur", "ini") for c in ("a", "draw", "b", "line")
    )
    got = {r.match_id: r for r in features.asian_features(rows(data, schema)).collect()}
    for match in ("hot", "m3"):
        mine = [d for d in data if d[0] == match]
        a, b, line = [d[6] for d in mine], [d[8] for d in mine if d[8] is not None], [d[9] for d in mine]
        r = got[match]
        assert (r.rows, r.bookmaker_count, r.multi_line) == (len(mine), len({d[3] for d in mine}), sum(d[4] for d in mine))
        assert r.line_median == pytest.approx(statistics.median(line), abs=1e-3)
        assert r.home_odds_avg == pytest.approx(statistics.mean(a), abs=6e-4)
        spread = (statistics.pstdev(a) + statistics.pstdev(b) + statistics.pstdev(line)) / 3
        assert r.disagreement == pytest.approx(spread, abs=6e-5)
        assert r.low_water == sum(d[6] <= 0.82 or (d[8] or 0) <= 0.82 for d in mine)


def test_one_pass_score_scan_equals_the_single_scans(rows):
    rnd = random.Random(13)
    data = [("hot" if i % 3 == 0 else str(i % 25), f"FB{i % 3}", rnd.choice(["CRS", "FCS"]), str(rnd.randrange(2)), f"0{rnd.randrange(3)}0{rnd.randrange(3)}",
             f"{rnd.randrange(10, 34) / 2:.2f}", i) for i in range(2500)]
    df = rows(data, "match_id string, front_end_id string, pool string, line_id string, sel string, odds string, sel_index long")
    df = df.withColumn("kickoff_ts", F.lit("2026-05-01 20:00:00").cast("timestamp_ntz"))
    single = pools.full_half_equal_scores(df)
    for part in (pools.equal_odds_by_total(df), pools.half_score_pairs(df), pools.score_pairs(df)):
        single = single.unionByName(part)
    cols = ["match_id", "kickoff_ts", "pool", "rule", "rule_label", "line_id", "line", "selection", "odds", "total_goals", "score_count", "source_page"]
    got = pools.scan_equal_scores(df, F.lit("2026-05-01 18:00:00"))
    assert sorted(map(str, got.select(*cols).collect())) == sorted(map(str, single.select(*cols).distinct().collect()))
    assert got.where("match_id = 'hot'").count() > 0


def test_link_packs_give_the_same_best(rows, monkeypatch):
    """A catalog larger than one pack and a snapshot cut into salts change nothing."""
    rnd = random.Random(5)
    names = ["red star", "blue moon", "north end", "city", "rovers", "athletic", "wanderers", "forest"]
    pick = lambda: f"{rnd.choice(names)} {rnd.choice(names)}"
    m = rows([(1, str(i), pick(), pick(), "lg", rnd.randrange(500)) for i in range(60)], "snapshot_id int, match_id string, home string, away string, league string, kickoff_min long")
    p = rows([(1, f"p{i}", i, pick(), pick(), "lg", rnd.randrange(500)) for i in range(90)], "snapshot_id int, id string, source_index long, home string, away string, league string, kickoff_min long")
    whole = sorted(map(str, link.link_matches(m, p).collect()))
    monkeypatch.setattr(link, "ENTRIES_PER_PACK", 7)
    monkeypatch.setattr(link, "MATCHES_PER_SALT", 9)
    assert sorted(map(str, link.link_matches(m, p).collect())) == whole
    # brute force over single pairs
    pairs = m.withColumn("_m", link.link_key(m)).join(p.select("snapshot_id", F.array(F.struct("id", F.col("source_index").alias("ix"), link.link_key(p).alias("key"))).alias("c")), "snapshot_id")
    scored = pairs.select("match_id", F.inline(link.pair_scores(F.col("_m"), F.col("c"))))
    best = {r.match_id: (r.b.score, -r.b.neg_ix) for r in scored.groupBy("match_id").agg(F.max(F.struct("score", "neg_ix")).alias("b")).collect()}
    got = link.link_matches(m, p).collect()
    assert all(best[r.match_id][0] == r.score and (r.matched_id in (None, f"p{best[r.match_id][1]}")) for r in got)


def _ticks(rows, n=200):
    data = [(str(i % 5), "b%d" % (i % 2), i, float(i % 7)) for i in range(n)]
    return rows(data, "match_id string, bookmaker_key string, event_id long, price double").withColumn("ts", F.timestamp_seconds(F.col("event_id") * 60 % 4000))


def _drain(spark, df, tmp_path, partial, merge, live=None):
    """Over one file a batch, with a fold in between and late rows after it."""
    half = F.col(df.columns[0]).isNotNull() & (F.xxhash64(*df.columns) % 2 == 0)
    schema = partial(spark.createDataFrame([], df.schema)).schema
    for part in (df.where(half), df.where(~half)):
        part.repartition(3).write.mode("append").parquet(str(tmp_path / "in"))
        stream = streams.read_stream(spark, str(tmp_path / "in"), df.schema, files_per_batch=1)
        streams.write_partials(stream, partial, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
        streams.compact(spark, str(tmp_path / "out"), schema, merge, live, grace_hours=0)
    left = list((tmp_path / "out").glob("batch_id=*")), list((tmp_path / "out").glob("upto=*"))
    assert (len(left[0]), len(left[1])) == (0, 1)
    return merge(streams.read_partials(spark, str(tmp_path / "out"), schema))


def _same(a, b):
    assert sorted(map(str, a.collect())) == sorted(map(str, b.select(*a.columns).collect()))


@pytest.mark.parametrize("job", [(streams.latest_quotes, streams.latest_quotes), (streams.open_close, streams.merge_open_close)])
def test_tick_streams_equal_batch(spark, rows, tmp_path, job):
    df = _ticks(rows)
    _same(_drain(spark, df, tmp_path, *job), job[1](job[0](df)))


def test_progress_stream_equals_batch(spark, rows, tmp_path):
    df = rows([(str(i % 9), i % 3 > 0, "HTTP 404" if i % 3 == 0 else None, i % 4) for i in range(120)], "match_id string, ok boolean, error string, hits int")
    got = _drain(spark, df, tmp_path, streams.match_counts, streams.merge_counts)
    _same(got, streams.match_counts(df))
    assert streams.progress(got).first()["total"] == 120


def test_cache_stream_drops_expired_entries(spark, rows, tmp_path):
    df = rows([(str(i % 20), i, float(i)) for i in range(100)], "match_id string, source_index long, result double")
    df = df.withColumn("saved_at", F.timestamp_seconds(F.col("source_index") * 3600).cast("timestamp_ntz"))
    now = F.timestamp_seconds(F.lit(95 * 3600)).cast("timestamp_ntz")
    got = _drain(spark, df, tmp_path, lambda b: cache.latest_results(b, ttl_hours=10), streams.merge_cache, F.col("expires_at") > now)
    want = cache.live_entries(cache.latest_results(df, ttl_hours=10), now)
    _same(want, got)
    assert got.count() == 14


def test_dedupe_stream_lets_one_through_and_forgets(spark, rows, tmp_path):
    df = rows([("a", 0), ("a", 3600), ("b", 10), ("a", 10 * 86400), ("c", 20 * 86400), ("a", 30 * 86400)], "k string, s long").withColumn("ts", F.timestamp_seconds(F.col("s") + 1_700_000_000))
    known = set()
    for n, at in enumerate(sorted(r["s"] for r in df.collect())):  # files are read by age
        df.where(F.col("s") == at).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        new = set((tmp_path / "in").glob("*.parquet")) - known
        known |= new
        [os.utime(f, (1_000_000_000 + 60 * n,) * 2) for f in new]
    stream = streams.read_stream(spark, str(tmp_path / "in"), df.schema, files_per_batch=1)
    once = streams.stream_dedupe_hits(stream, ["k"], "ts", "2 days").select("k", "s")
    once.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination()
    got = sorted((r["k"], r["s"]) for r in spark.read.schema("k string, s long").parquet(str(tmp_path / "out")).collect())
    # the watermark follows a batch behind: "a" is let through again once its state has gone
    assert got == [("a", 0), ("a", 30 * 86400), ("b", 10), ("c", 20 * 86400)]


@pytest.mark.parametrize("name", ["a4_match_features", "j2_link_matches", "j3_gated_pool_match", "a17_match_documents", "w1_latest_quote", "l4_chunk_ids", "j9_head_to_head", "a8_h2h_over_under", "q4_series_quality", "p4_scan_equal_scores", "j7_merge_market_sources"])
def test_no_cross_join_and_no_single_task_step(spark, name):
    text = plan(QUERIES[name](spark, SF))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    assert "SinglePartition" not in text


def test_scan_reads_only_needed_columns_and_filters(spark):
    text = plan(QUERIES["a2_asian_features_full"](spark, SF))
    assert "PushedFilters" in text and "l_linestatus" in text
    schema = text.split("ReadSchema: ")[1].split(">")[0]
    assert "l_extendedprice" not in schema


def test_a_hot_payload_is_numbered_over_many_tasks(spark, rows, monkeypatch):
    kept, write = [], ordered.written
    monkeypatch.setattr(ordered, "written", lambda df, name: kept.append(write(df, name)) or kept[-1])
    data = [(("hot", None, "x")[0 if k % 3 else 1 + k % 2], k // 2, k, "m%d" % (k % 50)) for k in range(3000)]
    df = rows(data, "payload string, a long, b long, match_id string").repartition(5)
    got = ordered.numbered(df, ["payload"], ["a", "b"], "n", "total")
    by = {}
    for r in got.collect():
        by.setdefault(r["payload"], []).append(r)
    for payload, own in by.items():
        own.sort(key=lambda r: (r["a"], r["b"]))
        assert [r["n"] for r in own] == list(range(1, len(own) + 1)) and {r["total"] for r in own} == {len(own)}
    # two thirds of all rows share a payload, and were sorted and numbered in several tasks
    assert kept[0].where("payload = 'hot'").select(F.shiftright("_at", 33)).distinct().count() >= int(spark.conf.get("spark.sql.shuffle.partitions")) // 2
    text = plan(documents.budget_rows(df, ["payload"], ["a", "b"], 100))
    assert "row_number" not in text and "Window" in text  # the window adds up the rows of partitions alone
