"""Operators on small literal tables."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from oddsframe.functions import odds as X
from oddsframe.functions import text as T
from oddsframe.operators import audit, documents, features, history, link, pools, quotes, select
from oddsframe.sources import feeds


def test_bookmaker_names(rows):
    df = rows(
        [("澳*", None), ("36*(英国)", "Bet 365"), ("威*", None), ("香港马*", None), ("nobody", None)],
        "company string, english_name string",
    ).withColumns({"market": F.lit("asian"), "company_id": F.lit("")})
    got = {r.company: (r.bookmaker_key, r.bookmaker) for r in quotes.identify_bookmaker(df).collect()}
    assert got == {
        "澳*": ("macau", "澳門彩票"), "36*(英国)": ("bet365", "Bet365"), "威*": ("william_hill", "威廉希爾"),
        "香港马*": ("hk_jockey", "香港賽馬會"), "nobody": (None, None),
    }


Q = "source_index int, market string, company_id string, company string, is_multi_line boolean"


def quote_rows(rows, data):
    return rows(data, Q).withColumns({"match_id": F.lit("1"), "period": F.lit("full")})


def test_filter_by_company_id_and_main_line(rows):
    df = quote_rows(
        rows,
        [(0, "asian", "1", "x", False), (1, "asian", "3", "Crow*", True), (2, "asian", "3", "Crow*", False), (3, "over_under", "48", "x", False),
         (4, "europe", "177", "x", False), (5, "europe", "281", "x", False), (6, "asian", "31", "利*", False)],
    )
    got = quotes.filter_bookmakers(df).orderBy("bookmaker_rank").collect()
    assert [(r.bookmaker_key, r.source_index) for r in got] == [("pinna", 4), ("bet365", 5), ("crown", 2), ("hk_jockey", 3)]
    assert quotes.filter_bookmakers(df, keep_all=True).count() == 7
    assert [r.bookmaker_key for r in quotes.filter_bookmakers(df, ["利記", "macau"]).orderBy("source_index").collect()] == ["macau", "sbobet"]


def test_latest_quote(rows):
    df = rows(
        [(0, "betfair", "2.44", "2026-05-02 17:03:00"), (1, "libo", "2.37", "2026-05-02 17:01:00"), (2, "betfair", "2.00", "2026-05-02 14:22:00"),
         (3, "libo", "2.20", "2026-05-02 17:03:00"), (4, None, "9", None)],
        "source_index int, bookmaker_key string, win string, t string",
    ).withColumns({"match_id": F.lit("1"), "changed_at": F.col("t").cast("timestamp_ntz")})
    got = {r.bookmaker_key: r.win for r in quotes.latest_quote(df).collect()}
    assert got == {"betfair": "2.44", "libo": "2.20", None: "9"}


def test_merge_is_idempotent_and_drops_unknown_together(rows):
    primary = quote_rows(rows, [(0, "asian", "3", "Crow*", False), (1, "asian", "999", "u1", False), (2, "asian", "8", "36*", False)])
    extra = quote_rows(rows, [(0, "asian", "998", "u2", False), (1, "asian", "3", "Crow*", False)])
    once = quotes.merge_market_sources(primary, extra)
    assert sorted(r.company for r in once.collect()) == ["36*", "Crow*", "u2"]
    again = quotes.merge_market_sources(once.select(*primary.columns), extra)
    assert sorted(r.company for r in again.collect()) == ["36*", "Crow*", "u2"]
    assert quotes.merge_market_sources(primary, extra.limit(0)).count() == 3


def test_official_feed_only_fills_gaps(rows):
    primary = quote_rows(rows, [(0, "asian", "48", "x", False)])
    official = quote_rows(rows, [(0, "asian", "48", "official", False)])
    assert [r.company for r in quotes.merge_market_sources(primary, official, official=True).collect()] == ["x"]


def test_no_totals_still_flags_low_line(rows):
    schema = "match_id string, market string, period string, bookmaker string, is_multi_line boolean, is_closed boolean, " + ", ".join(
        f"{w}_{c} double" for w in ("cur", "ini") for c in ("a", "draw", "b", "line")
    )
    df = rows([("1", "europe", "full", "Pinna", None, None, 1.5, 4.0, 6.0, None, 1.5, 4.0, 6.0, None)], schema)
    r = features.match_features(df).first()
    assert "入球盤偏低但大球低水" in r.flags and "缺少亞盤全場，讓球驗證不足" in r.flags
    assert (r.eu_favourite, r.eu_disagreement, r.conflict_score) == ("主", 0.0, 38)  # overround 10, low line 12, two markets missing 16
    # one missing side counts as low water
    half = rows([("2", "asian", "full", "Crown", False, False, 0.9, None, None, 0.25, 0.9, None, 0.9, 0.0)], schema)
    assert features.asian_features(half).first().low_water == 1


def test_head_to_head_samples(rows):
    past = rows([(i, "26-01-%02d" % (i + 1), "2" if i % 2 else "1", "1" if i % 2 else "2", 3, i % 2) for i in range(8)],
                "source_index int, played_at string, home_team_id string, away_team_id string, home_goals int, away_goals int")
    m = rows([("a", "1", "2"), ("b", "", "2"), ("c", "1", "9")], "match_id string, home_team_id string, away_team_id string")
    got = {r.match_id: r for r in history.h2h_over_under(m, past).collect()}
    assert (got["a"].sample_count, got["a"].over_percent, got["a"].over_hit, got["a"].under_hit) == (8, 100.0, True, False)
    assert (got["b"].no_data_reason, got["c"].no_data_reason) == ("missing_ids", "no_meetings")
    few = history.h2h_over_under(m, past.where("source_index < 7")).where("match_id = 'a'").first()
    assert (few.no_data_reason, few.sample_count, few.over_percent) == ("too_few", 7, None)
    hit = history.h2h_hits(history.h2h_over_under(m, past)).first()
    assert (hit.type, hit.description) == ("大球", "近8次對賽，大球8次（100%）")


SEL = "match_id string, pool string, line_id string, sel_index int, sel string, odds string"


def test_three_way_scan(rows):
    df = rows([("1", "HAD", "0", 0, "H", "2.14"), ("1", "HAD", "0", 1, "A", "3"), ("1", "HAD", "0", 2, "D", "3.00"),
               ("2", "HAD", "0", 0, "H", "1.73"), ("2", "HAD", "0", 1, "A", "1.76"), ("3", "HAD", "0", 0, "D", "1.73")], SEL)
    got = sorted((r.match_id, r.rule, r.selection, r.odds, r.home_odds) for r in pools.scan_three_way(df).collect())
    assert got == [("1", "HAD_2.14_3.00_3.00", "H", "2.14", "2.14"), ("2", "HAD_HOME_AWAY_1.73", "H", "1.73", "1.73"), ("2", "HAD_HOME_AWAY_1.76", "A", "1.76", "1.73")]


def test_price_rules(rows):
    df = rows([("1", "FHA", "0", 0, "H", "2.03"), ("1", "FHA", "0", 1, "A", "2.03"), ("1", "FHA", "0", 2, "D", "1.76"), ("1", "FHL", "0", 3, "L", "1.94"),
               ("1", "EHH", "0", 4, "D", "3.1"), ("1", "EHH", "0", 5, "H", "3.10"), ("1", "HIL", "0", 6, "H", "1.94")], SEL)
    got = sorted((r.rule, r.selection) for r in pools.scan_price_rules(df).collect())
    assert got == [("EHH_DRAW_3.10", "D"), ("FHA_DRAW_1.76", "D"), ("FHA_HOME_AWAY_2.03", "A"), ("FHA_HOME_AWAY_2.03", "H"), ("FHL_ANY_1.94", "L")]


def test_score_scans(rows):
    df = rows([("1", "CRS", "0", 0, "0100", "8.5"), ("1", "CRS", "0", 1, "0001", "8.50"), ("1", "CRS", "0", 2, "0101", "8.5"), ("1", "CRS", "0", 3, "0202", "15"),
               ("1", "CRS", "0", 4, "0301", "15"), ("1", "FCS", "0", 5, "0:0", "8.5"), ("1", "FCS", "0", 6, "1:0", "8.5"), ("1", "FCS", "0", 7, "0:1", "9")], SEL)
    total = pools.equal_odds_by_total(df).collect()
    assert [(r.rule, r.selection, r.score_count) for r in total] == [("CRS_SAME_TOTAL_1_ODDS_8.50", "1:0 / 0:1", 2)]
    assert [r.rule for r in pools.half_score_pairs(df).collect()] == ["FCS_home_SAME_ODDS_00_10_8.50"]
    assert [r.rule for r in pools.score_pairs(df).collect()] == ["CRS_PAIR_10_11_ODDS_8.50"]
    assert [(r.rule, r.selection) for r in pools.full_half_equal_scores(df).collect()] == [("CRS_FCS_SAME_SCORE_10_ODDS_8.50", "全場 1:0 | 半場 1:0")]


def test_pool_quotes(rows):
    base = ("1", "HDC", "2", "-1.0/-1.5", True, "AVAILABLE", "AVAILABLE")
    schema = "match_id string, pool string, line_id string, condition string, main boolean, line_status string, comb_status string, sel_index int, sel string, odds string, update_at string"
    df = rows([(*base, 0, "H", "1.95", "u"), (*base, 1, "A", "1.85", "u"), ("2", "HIL", "1", "x/2.5", True, "AVAILABLE", "AVAILABLE", 0, "H", "1.9", "u"),
               ("2", "HIL", "1", "x/2.5", True, "AVAILABLE", "AVAILABLE", 1, "L", "1.9", "u")], schema)
    got = pools.pool_quotes(df).collect()
    assert [(r.market, r.period, r.cur_line, r.cur_a, r.cur_b, r.is_multi_line) for r in got] == [("asian", "full", 1.25, 0.95, 0.85, False)]


def test_price_text(rows):
    got = rows([("3",), ("1.666",), ("",), ("n/a",), (None,)], "o string").select(X.norm_odds(F.col("o")).alias("n")).collect()
    assert [r.n for r in got] == ["3.00", "1.67", "", "n/a", ""]


def test_pool_windows(rows):
    now = F.lit("2026-05-01 20:00:00").cast("timestamp_ntz")
    at = lambda h: dt.datetime(2026, 5, 1, 20) + dt.timedelta(hours=h)
    df = rows([(1, at(1), "PREEVENT"), (2, at(-1), "PREEVENT"), (3, at(-1), "FIRSTHALFINPLAY"), (4, at(-5), "INPLAY"), (5, at(30), "x")], "id int, kickoff_ts timestamp_ntz, status string")
    assert [r.id for r in select.pool_window_or_inplay(df, now).orderBy("id").collect()] == [1, 3]
    assert [r.id for r in select.pool_window(df, now).collect()] == [1]


def minutes(text):
    return int((dt.datetime.fromisoformat(text) - dt.datetime(1970, 1, 1)).total_seconds() // 60)


CASES = [
    # match (league, home, away, kickoff or clock) x pool match, expected status, lowest score
    (("英超", "Arsenal", "Chelsea", "2026-05-02T20:05"), ("英超", "Arsenal FC", "Chelsea FC", "2026-05-02T20:00"), "open", 90),
    (("歐霸盃", "費雷堡", "布拉加", "03:00"), ("歐霸盃", "弗賴堡", "布拉加", "2026-05-08T03:00"), "open", 90),
    (("歐國聯", "荷蘭", "德國", "02:45"), ("歐洲國家聯賽", "荷蘭", "德國", "2026-09-26T02:45"), "open", 90),
    (("非洲盃", "喀麥隆", "科摩羅", "03:00"), ("非國盃外圍賽", "喀麥隆", "科摩羅", "2026-09-26T03:00"), "open", 90),
    (("烏拉盃", "利物浦蒙特維多", "科尔隆", "02:30"), ("烏拉圭盃", "蒙特維多利物浦", "蒙特維多高隆FC", "2026-09-24T02:27"), "open", 90),
    (("智利盃", "克里科", "迪康塞普森", "05:00"), ("智利盃", "古里高聯", "康塞普森體育", "2026-09-24T04:57"), "open", 90),
    (("解放者杯", "普拉騰斯", "彭拿路", "06:00"), ("南美自由盃", "CA普拉坦斯", "彭拿路", "2026-05-08T06:00"), "open", 85),
    (("解放者杯", "科金博", "秘魯體育大學", "08:00"), ("南美自由盃", "Coquimbo Unido", "Universitario Deportes", "2026-05-08T08:00"), "open", 90),
    (("歐霸盃", "費雷堡", "布拉加", "03:00"), ("歐霸盃", "阿士東維拉", "諾定咸森林", "2026-05-08T03:00"), "not_found", 0),
]


def test_link_cases(rows):
    left, right = [], []
    for i, ((lg, h, a, k), (plg, ph, pa, pk), _, _) in enumerate(CASES):
        clock = len(k) == 5
        minute = int(k[:2]) * 60 + int(k[3:]) if clock else minutes(k)
        left.append((i, str(i), lg, h, a, minute, clock))
        right.append((i, f"p{i}", 0, plg, ph, pa, minutes(pk)))
    m = rows(left, "snapshot_id int, match_id string, league string, home string, away string, kickoff_min long, clock_only boolean")
    p = rows(right, "snapshot_id int, id string, source_index int, tournament string, home string, away string, kickoff_min long")
    got = {r.match_id: r for r in link.link_matches(m, p).collect()}
    for i, (_, _, status, lowest) in enumerate(CASES):
        r = got[str(i)]
        assert r.status == status, (i, r)
        assert r.score >= lowest if status == "open" else r.score < 58
        assert (r.matched_id == f"p{i}") == (status == "open")
    assert got["2"].league_score == 100 and got["7"].home_score == 100


def test_name_similarity_is_symmetric(rows):
    df = rows([("Arsenal FC", "Arsenal Tula"), ("FC東京", "東京綠茵"), ("a", "ab"), ("", "x")], "a string, b string")
    df = df.select(T.name_key(F.col("a")).alias("a"), T.name_key(F.col("b")).alias("b"))
    for r in df.select(T.name_similarity(F.col("a"), F.col("b")).alias("x"), T.name_similarity(F.col("b"), F.col("a")).alias("y")).collect():
        assert r.x == r.y


def test_team_names(spark, rows):
    df = rows([("Arsenal FC",), ("CA普拉坦斯",), ("fc東京",), ("東京FC",), ("皇家馬德里（青年隊）",), ("ＡＣ米蘭",)], "n string")
    got = [r.x for r in df.select(T.norm_team(F.col("n")).alias("x")).collect()]
    assert got == ["arsenal", "普拉坦斯", "東京", "東京", "皇家马德里", "米兰"]
    forms = rows([("ﬁorentina", "Târgoviște"), ("東京Ⅱ", "Hà Nội"), ("Ｔｏｋｙｏ ②", "plain"), (None, None)], "a string, b string")
    got = [(r.t, r.c, r.l) for r in forms.select(T.norm_team(F.col("a")).alias("t"), T.norm_comp(F.col("a")).alias("c"), T.norm_latin(F.col("b")).alias("l")).collect()]
    assert got == [("fiorentina", "fiorentina", "targoviste"), ("東京ii", "東京ii", "hanoi"), ("tokyo2", "tokyo2", "plain"), ("", "", "")]


def test_league_filter(rows):
    df = rows([("2980859", "英超"), ("2", "火星聯"), ("3", "荷乙附加赛"), ("4", "Scottish League Cup"), ("5", "欧协联")], "match_id string, league string")
    assert [r.match_id for r in select.filter_allowed_leagues(df).orderBy("match_id").collect()] == ["2980859", "3", "4", "5"]
    assert select.filter_allowed_leagues(df, False).count() == 5
    assert [r.match_id for r in select.filter_allowed_leagues(df, ["火星聯"]).collect()] == ["2"]
    assert [r.match_id for r in select.search_league(df, "conference league").collect()] == ["5"]
    assert select.league_names_expanded(df.sparkSession).where("league_name in ('荷乙附', '英超', '東盟盃爭冠', 'AFCON')").count() == 4


def test_probe_expectations(rows):
    df = rows([(200, "fine", False, "warn", "no list"), (200, "fine", True, None, "list ok"), (403, "Access Denied", True, None, None)],
              "status_code int, body string, expected_ok boolean, expected_severity string, expected_diagnosis string").withColumn("error", F.lit(None).cast("string"))
    got = [(r.state, r.diagnosis) for r in audit.probe_status(df).collect()]
    assert got == [("warn", "no list"), ("ok", "list ok"), ("error", "blocked")]


def test_structured_output(rows):
    part_d = 'Part B\n```json\n{"chart_only":true}\n```\nPart D\n```json\n{"match_meta":{"home_team":"A"},"recommendation":{"recommendation":"observe"}}\n```'
    top = 'x\n```json\n{"example":true,"top10":[]}\n```\n```json\n{"schemaVersion":"odds-analysis-v1","dataQuality":{},"top10":[{"matchId":"m1","confidenceScore":81}],"top3Candidates":[]}\n```'
    bare = 'text {"a":1} then {"schemaVersion":"odds-analysis-v1","match_meta":{},"recommendation":{"recommendation":"{observe}"}} end'
    df = rows([(1, "single_match_deep_analysis", part_d), (2, "top10_ai_ranking", top), (3, "single_match_deep_analysis", bare), (4, "top10_ai_ranking", "none")], "id int, workflow string, text string")
    got = {r.id: r for r in audit.validate_outputs(audit.extract_structured(df)).collect()}
    assert "observe" in got[1].structured and "m1" in got[2].structured and "{observe}" in got[3].structured
    assert (got[2].level, got[2].validation_score) == ("ok", 100)
    assert got[3].level == "warn" and {"pitch_reality", "singleMatch"} <= set(got[3].missing)
    assert (got[4].level, got[4].ok, got[4].validation_score, got[4].missing) == ("error", False, 0, ["structured_json"])


def test_captures_are_not_mixed(rows):
    """2:0 at 7.00 in one capture and 1:1 at 7.00 in the next were never equal at one time."""
    schema = "snapshot_id int, match_id string, pool string, line_id string, sel string, odds string, sel_index int, kickoff_ts timestamp_ntz"
    at = __import__("datetime").datetime(2026, 5, 1, 20)
    prices = [(1, "0200", "7.00", 1), (1, "0101", "6.50", 2), (2, "0200", "7.50", 3), (2, "0101", "7.00", 4)]
    df = rows([(s, "1", "CRS", "0", sel, o, i, at) for s, sel, o, i in prices], schema)
    assert pools.equal_odds_by_total(df).count() == 0 and pools.score_pairs(df).count() == 0
    assert pools.scan_equal_scores(df, F.lit("2026-05-01 18:00:00").cast("timestamp_ntz")).count() == 0
    assert pools.equal_odds_by_total(df.drop("snapshot_id")).count() == 1
    assert {r.snapshot_id for r in pools.latest_snapshot(df).collect()} == {2}


def test_quotes_of_open_pools_only(rows):
    schema = "snapshot_id int, match_id string, pool string, pool_status string, line_id string, condition string, main boolean, line_status string, comb_status string, sel_index int, sel string, odds string, update_at string"
    line = lambda s, status, i, sel, odds, main=True: (s, "1", "HIL", status, "a", "2.5", main, "AVAILABLE", "AVAILABLE", i, sel, odds, f"t{s}")
    df = rows([line(1, "SellingStarted", 1, "H", "1.90"), line(1, "SellingStarted", 2, "L", "1.80"), line(2, "Suspended", 3, "H", "2.00"), line(2, "Suspended", 4, "L", "1.70"),
               line(3, "SELLINGSTARTED", 5, "H", "2.10", None), line(3, "SELLINGSTARTED", 6, "L", "1.60", None)], schema)
    got = sorted((r.snapshot_id, r.cur_a, r.changed_at, r.is_multi_line) for r in pools.pool_quotes(df).collect())
    assert got == [(1, 0.9, "t1", False), (3, 1.1, "t3", True)]


def test_no_quote_is_lost(rows):
    q = rows([("1", "asian", "full", "3"), ("2", "asian", "full", "3"), (None, "europe", None, "9")], "match_id string, market string, period string, company_id string")
    q = q.withColumns({c: F.lit(1.5) for c in ("cur_a", "cur_b", "cur_line", "ini_a", "ini_b", "ini_line", "cur_draw", "ini_draw")})
    q = q.withColumns({"is_closed": F.lit(False), "is_multi_line": F.lit(False), "changed_at": F.lit("t")})
    m = rows([("1", 2, "later"), ("1", 1, "first")], "match_id string, source_index int, league string")
    assert sorted((r.matchId or "", r.league or "") for r in quotes.flatten_quotes(q, m).collect()) == [("", ""), ("1", "first"), ("2", "")]


def test_null_keys_keep_their_rows(rows):
    df = rows([(None, 1), ("a", 5_000_000_000), (None, 900)], "snapshot_id string, source_index long")
    assert sorted((r.source_index, r.chunk) for r in select.chunk_ids(df, size=1).collect()) == [(1, 0), (900, 1), (5_000_000_000, 0)]


def test_a_meeting_counts_once(rows):
    past = rows([(1, "2025-01-01", "7", "8", 3, 0), (2, "2025-01-01", "7", "8", 3, 0), (3, "2025-06-01", "8", "7", 0, 0)],
                "source_index int, played_at string, home_team_id string, away_team_id string, home_goals int, away_goals int")
    got = history.pair_stats(past).first()
    assert (got.sample_count, got.over_count, got.history) == (2, 1, "2025-01-01 3-0 | 2025-06-01 0-0")


def test_unknown_bookmakers_count(rows):
    df = rows([("1", "asian", "full", None, "Book A"), ("1", "asian", "full", "", "Book B"), ("1", "asian", "full", "Pinna", "x")], "match_id string, market string, period string, bookmaker string, company string")
    df = df.withColumns({c: F.lit(0.9) for c in ("cur_a", "cur_b", "cur_draw", "cur_line", "ini_a", "ini_b", "ini_draw", "ini_line")}).withColumns({"is_closed": F.lit(False), "is_multi_line": F.lit(False)})
    assert features.asian_features(df).first().bookmaker_count == 3


def test_league_export_and_filter(spark):
    names = {r.league_name for r in select.league_names_expanded(spark).collect()}
    assert len(names) == 1585 and {"卡亲王盃", "韓K2联", "世盃外", "東盟杯"} <= names
    assert not {"K联赛2", "英足总杯", "世盃外附"} & names


def test_all_players_and_rows_come_out(rows):
    people = ",".join(f'{{"player":{{"name":"p{i}"}}}}' for i in range(15))
    team = f'{{"team":{{"name":"T"}},"startXI":[{people}],"substitutes":[{people}]}}'
    df = rows([(1, '{"response":[' + ",".join([team] * 6) + "]}")], "page_id int, body string")
    assert feeds.parse_lineups(df).count() == 6 * 30
    many = rows([("1", "asian", "full", i) for i in range(30)], "match_id string, market string, period string, n int").withColumn("payload", F.lit(1))
    docs = documents.match_documents(many, ["payload"], ["n"], 12).collect()
    assert sorted((d.payload_no, d.market_counts.asianFull) for d in docs) == [(0, 12), (1, 12), (2, 6)]
    assert documents.match_documents(many, ["payload"], ["n"]).first().market_counts.asianFull == 30


def test_brace_scan_is_linear(rows):
    import time

    df = rows([(1, "{" * 200_000 + '{"top10":[1]} {"a":"}"} tail')], "id int, text string")
    start = time.time()
    assert audit.extract_structured(df).first().structured == '{"top10":[1]}'
    assert time.time() - start < 30


def test_scratch_folder_only_for_local_sessions(monkeypatch):
    from types import SimpleNamespace

    from oddsframe.session import checkpoint_root

    conf = SimpleNamespace(get=lambda *a: None)
    session = SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master="spark://host:7077", getConf=lambda: conf))
    with pytest.raises(RuntimeError):
        checkpoint_root(session)
