"""Safe reads beside a compaction, and keyed state against batch after late rows, a restart and expiry."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from oddsframe.streaming import keyed, streams

TICKS = "match_id string, bookmaker_key string, event_id long, price double, s long"


@pytest.fixture
def out(tmp_path):
    return str(tmp_path / "out")


def _part(rows, out, n, data):
    rows(data, "k string, v long").write.mode("overwrite").parquet(f"{out}/batch_id={n}")


def _merge(df):
    return df.groupBy("k").agg(F.max("v").alias("v"))


def _read(spark, out):
    return sorted(map(tuple, _merge(streams.read_partials(spark, out, "k string, v long")).collect()))


def test_a_reader_that_listed_before_a_compaction_still_reads(spark, rows, out):
    for n in range(3):
        _part(rows, out, n, [("a", n), (f"k{n}", 1)])
    before = streams.read_partials(spark, out, "k string, v long")
    want = _read(spark, out)
    streams.compact(spark, out, "k string, v long", _merge)
    assert sorted(map(tuple, _merge(before).collect())) == want == _read(spark, out)
    _part(rows, out, 3, [("a", 9)])
    listed = streams.read_partials(spark, out, "k string, v long")
    streams.compact(spark, out, "k string, v long", _merge)  # the first base has to stay as well
    assert dict(map(tuple, _merge(listed).collect()))["a"] == 9 == dict(_read(spark, out))["a"]
    assert len(streams.live_folders(spark, out)) == 1
    _part(rows, out, 4, [("b", 1)])
    streams.compact(spark, out, "k string, v long", _merge, grace_hours=0)
    assert len([f for f in os.listdir(out) if "=" in f]) == 1 and ("b", 1) in _read(spark, out)


def test_a_compaction_that_is_killed_loses_nothing(spark, rows, out, monkeypatch):
    _part(rows, out, 0, [("a", 1)])
    _part(rows, out, 1, [("b", 2)])

    def killed(*_):
        raise RuntimeError("killed")

    with monkeypatch.context() as m:
        m.setattr(streams, "_swap_manifest", killed)
        with pytest.raises(RuntimeError):
            streams.compact(spark, out, "k string, v long", _merge, grace_hours=0)
    assert _read(spark, out) == [("a", 1), ("b", 2)]
    streams.compact(spark, out, "k string, v long", _merge)
    assert _read(spark, out) == [("a", 1), ("b", 2)] and len(streams.live_folders(spark, out)) == 1


def _run(spark, tmp_path, **options):
    stream = streams.read_stream(spark, str(tmp_path / "in"), TICKS, files_per_batch=1).withColumn("ts", F.timestamp_seconds("s"))
    query = streams.write_partials(keyed.price_changes(stream, **options), lambda b: b, str(tmp_path / "out"), str(tmp_path / "state"), mode="update")
    query.awaitTermination()
    return [p["stateOperators"][0] for p in query.recentProgress]


def _land(rows, tmp_path, n, data):
    known = set((tmp_path / "in").glob("*.parquet")) if n else set()
    rows(data, TICKS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    for f in set((tmp_path / "in").glob("*.parquet")) - known:
        os.utime(f, (1_000_000_000 + 60 * n,) * 2)  # files are read by age


def test_keyed_state_equals_batch_after_late_rows_and_a_restart(spark, rows, tmp_path):
    ticks = [(str(k % 4), f"b{k % 2}", k, float(k % 7), 1_700_000_000 + (k * 37) % 600) for k in range(120)]
    for n in range(3):
        _land(rows, tmp_path, n, ticks[n::3])
        state = _run(spark, tmp_path, delay="1 hour")  # a new query each time: the state comes from the checkpoint
    got = {(r["match_id"], r["bookmaker_key"]): r for r in keyed.latest_values(streams.read_partials(spark, str(tmp_path / "out"), keyed.MOVES)).collect()}
    assert state[-1]["numRowsTotal"] >= len(got) == 4
    for key, r in got.items():
        own = sorted((t[4], t[2], t[3]) for t in ticks if t[:2] == key)
        assert (r["open_us"] // 1_000_000, r["open_event"], r["open_price"]) == own[0]
        assert (r["latest_us"] // 1_000_000, r["latest_event"], r["latest_price"]) == own[-1]
        assert r["ticks"] == len(own) and not r["closed"]


def test_state_of_prices_that_no_longer_move_is_dropped(spark, rows, tmp_path):
    day = 86_400
    for n in range(8):  # a match a day, each with two prices
        _land(rows, tmp_path, n, [(str(n), b, 2 * n + k, 1.5, 1_700_000_000 + n * day + k) for k, b in enumerate(("x", "y"))])
    state = _run(spark, tmp_path, delay="1 hour", keep_hours=24)
    assert max(s["numRowsTotal"] for s in state) <= 3 * 4  # value and timer of a few matches, not of all
    rows_ = keyed.latest_values(streams.read_partials(spark, str(tmp_path / "out"), keyed.MOVES)).collect()
    assert len(rows_) == 16 and sum(r["closed"] for r in rows_) >= 10


CAPTURES = "match_id string, saved_at timestamp_ntz, event_id long, ok boolean, asian_home_percent int, asian_away_percent int, over_percent int, under_percent int"


def test_requests_see_the_last_good_capture_of_their_micro_batch(spark, rows, tmp_path):
    at = lambda hour: dt.datetime(2024, 1, 1, hour)
    good, asks, answers = (str(tmp_path / n) for n in ("good", "asks", "answers"))

    def capture(*data):
        rows([(m, at(h), e, ok, p, 100 - p, 50, 50) for m, h, e, ok, p in data], CAPTURES).write.mode("append").parquet(str(tmp_path / "in"))
        stream = streams.read_stream(spark, str(tmp_path / "in"), CAPTURES)
        streams.stream_last_good(stream, good, str(tmp_path / "good-state")).awaitTermination()

    def ask(*data):
        rows([(i, m, at(h)) for i, m, h in data], "id int, match_id string, at timestamp_ntz").coalesce(1).write.mode("append").parquet(asks)
        stream = streams.read_stream(spark, asks, "id int, match_id string, at timestamp_ntz")
        streams.stream_serve(stream, good, rows([], CAPTURES).schema, answers, str(tmp_path / "state")).awaitTermination()

    capture(("a", 1, 1, True, 60), ("a", 2, 2, False, 99), ("b", 3, 3, None, 80), (None, 3, 4, True, 80))
    ask((1, "a", 6), (2, "b", 6), (3, None, 6))
    capture(("a", 1, 5, True, 75), ("b", 0, 6, True, 70))  # equal times: the later event; an older time for b is still its only good one
    ask((4, "a", 8), (5, "b", 6))
    capture(("a", 7, 7, False, 10))  # a failed capture changes nothing
    ask((6, "a", 7), (7, "a", 8))
    out = streams.read_partials(spark, answers, "id int, served boolean, event_id long, stale boolean, hot boolean")
    assert {r[0]: tuple(r[1:]) for r in out.collect()} == {
        1: (True, 1, False, False), 2: (False, None, None, False), 3: (False, None, None, False),
        4: (True, 5, True, True), 5: (True, 6, False, True), 6: (True, 5, False, True), 7: (True, 5, True, True),
    }


def test_streamed_answers_equal_batch(spark, rows, tmp_path):
    """Over many small micro-batches with late captures, as one batch over all of them."""
    data = [(f"m{k % 7}", dt.datetime(2024, 1, 1) + dt.timedelta(minutes=(k * 37) % 600), k, k % 3 > 0, k % 101, 100 - k % 101, 50, 50) for k in range(90)]
    for n in range(3):
        rows(data[n::3], CAPTURES).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    captures = streams.read_stream(spark, str(tmp_path / "in"), CAPTURES, files_per_batch=1)
    streams.stream_last_good(captures, str(tmp_path / "good"), str(tmp_path / "good-state")).awaitTermination()
    schema = rows([], CAPTURES).schema
    got = streams.newest_good(streams.read_partials(spark, str(tmp_path / "good"), schema))
    want = streams.newest_good(rows(data, CAPTURES))
    assert len(streams.live_folders(spark, str(tmp_path / "good"))) == 3
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
