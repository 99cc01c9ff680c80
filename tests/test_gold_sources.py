"""Parsers on small literal captures."""

import datetime as dt

from pyspark.sql import functions as F

from oddsframe.sources import crowd, feeds, pages, scripts, tables


def decode(rows, body, kind=""):
    return pages.decode_pages(rows([(kind, bytearray(body))], "content_type string, body binary")).first().text


def test_decode_falls_back_to_gb(rows):
    assert decode(rows, bytes([176, 196, 42])) == "澳*"


def test_decode_keeps_mostly_valid_utf8(rows):
    out = decode(rows, ("公司澳門彩票威廉希爾立博香港馬" * 3 + "\n").encode() + b"\xff")
    assert "澳門彩票" in out


def test_decode_trusts_declared_utf8(rows):
    out = decode(rows, ('<meta charset="utf-8">' + "公司澳門彩票威廉希爾立博香港賽馬會" * 3).encode() + b"\xff")
    assert "澳門彩票" in out and "香港賽馬會" in out


def test_decode_overrides_stale_gb_declaration(rows):
    out = decode(rows, ('<meta charset="gb2312">' + "吉尼斯坦VS英特杜古 公司 澳門彩票" * 3).encode())
    assert "吉尼斯坦" in out and "澳門彩票" in out


def test_error_pages(rows):
    good = '<title>Analysis</title><div id="compDiv">概率事件</div><script>var freshJsonData = {"oddsId":404123};</script>'
    bad = "<title>404 Not Found</title><body>404 Not Found</body>"
    df = rows([(1, good), (2, bad), (3, "<p>500 - Internal server error</p>freshJsonData")], "id int, body string")
    assert [r.id for r in pages.drop_error_pages(df).collect()] == [1]


def test_live_list(rows):
    fields = [""] * 47
    for i, v in {0: "2980859", 2: "英超", 3: "英超(T)", 5: "s", 6: "主隊 (中)", 8: "a", 11: "22:00", 13: "3", 14: "1", 15: "2", 37: "11", 38: "12"}.items():
        fields[i] = v
    body = f"A[1]=\"{'^'.join(fields)}\".split('^');A[2]=\"1^x^y\".split('^');"
    got = scripts.parse_live_list(rows([(1, body)], "page_id int, body string")).orderBy("pos").collect()
    assert len(got) == 2
    r = got[0]
    assert (r.match_id, r.league, r.home, r.away, r.state, r.score, r.half_score) == ("2980859", "英超(T)", "主隊(中)", "a", "下半場", "1-2", "")
    assert (r.home_team_id, r.away_team_id, got[1].league) == ("11", "12", "y")


ROW = (
    '<tr{0}><td><input data-id="3"></td><td>Crown 封</td><td>{1}</td><td>0.79</td><td goals="0.25">平/半</td><td title="t">1.05</td>'
    '<td oddstype="wholeLastOdds">.7</td><td oddstype="wholeLastOdds">x</td><td oddstype="wholeLastOdds">.9</td>'
    '<td oddstype="wholeOdds">0.84</td><td oddstype="wholeOdds" goals="0.5">半球</td><td oddstype="wholeOdds">1.01</td></tr>'
)


def test_odds_table_carries_company_to_hidden_rows(rows):
    hidden = ROW.format(' class="blue_txt"', "盤2").replace('<input data-id="3">', "").replace("Crown 封", "")
    df = rows([(1, f"<table id=odds>{ROW.format('', '')}{hidden}<tr><td colspan=12>x</td></tr></table>")], "page_id int, body string")
    main, multi = tables.parse_odds_table(df, include_multi=True).orderBy("pos").collect()
    assert (main.company, main.company_id, main.is_closed, main.initial.a, main.initial.line_value) == ("Crown", "3", True, "0.79", "0.25")
    assert (main.current.a, main.current.line_value, main.initial.time, main.last_before_current.b) == ("0.84", "0.5", "t", ".9")
    assert (multi.company, multi.company_id, multi.is_multi_line, multi.multi_label) == ("Crown", "3", True, "盤2")
    assert tables.parse_odds_table(df).count() == 1


def test_flat_odds_table(rows):
    cells = ROW.format("", "").replace("<tr>", "").replace("</tr>", "")
    df = rows([(1, f"<table id='odds'>{cells}{cells}</table>")], "page_id int, body string")
    assert [r.company for r in tables.parse_flat_odds_table(df).collect()] == ["Crown", "Crown"]


def test_page_meta(rows):
    body = (
        '<a class="LName">英超</a><span class="time">2026-04-19 20:00 星期日</span><div class="home"><a>x</a><a>甲(主)</a></div>'
        '<div class="guest"><a>乙(客)</a></div>'
    )
    r = tables.parse_page_meta(rows([(1, body)], "page_id int, body string")).first()
    assert (r.league, r.kickoff_raw, r.home, r.away) == ("英超", "2026-04-19 20:00", "甲", "乙")


GAME = '"281|1|Bet 365|2.05|3.25|3.4|44|28|26|91|2.2|3.25|3.25|42|28|28|93|0.93|0.93|0.95|2026,04-1,04,04,56,00|36*(英国)|1|0|0.86|0.93|0.99"'


def test_europe_script(rows):
    df = rows([(1, f"var game=Array({GAME});"), (2, f"var game=Array({GAME},{GAME.replace('281', '80')},\"9|cut")], "page_id int, body string")
    got = scripts.parse_europe_js(df).orderBy("page_id", "pos").collect()
    r = got[0]
    assert (r.company_id, r.company, r.initial.win, r.current.win, r.current.kelly_loss) == ("281", "36*(英国)", "2.05", "2.2", "0.95")
    assert r.changed_at == dt.datetime(2026, 4, 4, 4, 56) and r.is_primary and not r.is_exchange
    assert [x.company_id for x in got[1:]] == ["281", "80"]


def test_past_results_quotes_and_gaps(rows):
    body = "p[0]=['A, B','#f','26-01-01',1,2,3,1,1,0,0.5];p[1]=['L','','26-01-02',1,2,x,1,0,0,0];p[2]=[1,2,3];"
    got = scripts.parse_past_results(rows([(1, body)], "page_id int, body string")).collect()
    assert [(r.league, r.home_goals, r.away_goals, r.total_goals, r.handicap) for r in got] == [("A, B", 3, 1, 4, 0.5)]


def test_comparison_feed(rows):
    body = (
        '{"companies":[{"companyId":3,"nameEn":"Crow*","details":[{"homeOdds":0.9,"awayOdds":0.95,"drawOdds":0.5},{"homeOdds":0.8,"awayOdds":1.0,"num":2}]},'
        '{"companyId":8,"nameEn":"36*","details":[{"homeOdds":0.9,"awayOdds":0.9,"isStopLive":false},{"homeOdds":null,"awayOdds":1}]}]}'
    )
    got = feeds.parse_mobile_comparison(rows([(1, body)], "page_id int, body string")).orderBy("company_pos", "line_pos").collect()
    assert [(r.company_id, r.is_multi_line, r.multi_label, r.is_closed) for r in got] == [("3", False, "", False), ("3", True, "盤2", False), ("8", False, "", False)]


def test_probability_text(rows):
    body = (
        "<section><h3>概率事件</h3><div><p>•胜:100% •平:0%</p><p>近1场Crow*相同胜平负</p></div><div><p>•胜:100%</p><p>近10场36*相同胜平负</p></div>"
        "<div><p>•赢:40% •走:0% •输:60%</p><p>近10场Crow*相同让球</p></div><div><p>•大:80% •走:0% •小:20%</p><p>近10场Crow*相同总进球数</p></div></section>"
    )
    got = feeds.probability_page_events(rows([("7", body)], "match_id string, body string")).collect()
    assert [(r.type, r.percent, r.description) for r in got] == [("大", 80.0, "近10场Crow*相同总进球数")]


def test_probability_json_prefers_ten(rows):
    body = (
        'var freshJsonData = {"probabilityDatas":{"dataList":[{"companyName":"Crow*","companyId":3,"typeDatas":[{"kind":"ALL","oddsType":"OU","probStatistics":['
        '{"countType":"Five","count":20,"winScale":100,"drawScale":0,"lossScale":0},{"countType":"Ten","count":10,"winScale":80,"drawScale":0,"lossScale":20}]},'
        '{"kind":"ALL","oddsType":"EURO","probStatistics":[{"countType":"Ten","count":10,"winScale":100}]}]}]}};'
    )
    got = feeds.probability_page_events(rows([("7", body)], "match_id string, body string")).collect()
    assert [(r.type, r.percent, r.description) for r in got] == [("大", 80.0, "近10场Crow*相同总进球数")]


def test_crowd_home(rows):
    bar = (
        '<div class="guessBar" onclick="window.open(\'//g.example/tuijian/2916078.html\', \'_blank\')"><div class="team"><div class="icon"><img src="//i.example/h.png" /></div><span>清水鼓动</span></div>'
        '<span class="hCount">28%</span><span>亚让</span><span class="gCount">72%</span><span class="hCount">67%</span><span>大小</span><span class="gCount">33%</span>'
        '<div class="team"><span>大阪樱花</span></div></div>'
    )
    info = '<div class="title matchinfo" id="matchinfo_2916078"><span class="league">日职联</span><span class="L-time">12:00</span></div><ul></ul>'
    r = crowd.parse_crowd_home(rows([(1, info + bar)], "page_id int, body string")).first()
    assert (r.match_id, r.league, r.home, r.away) == ("2916078", "日职联", "清水鼓动", "大阪樱花")
    assert (r.asian_away_percent, r.asian_lean, r.over_percent, r.total_lean, r.hot) == (72.0, "away", 67.0, "over", True)
    assert r.home_image == "https://i.example/h.png"


def test_stream_chunks(rows):
    first = 'data: {"choices":[{"delta":{"content":"Hel"}}]}\n\ndata: {"choices":[{"delta":{"content":"lo"}}],"usage":{"total_tokens":7}}\n\ndata: [DONE]\n'
    df = rows([("a", 0, first), ("b", 0, 'data: {"error":{"message":"busy"}}\n'), ("c", 0, "data: {broken\n")], "conv_id string, turn int, text string")
    got = {r.conv_id: r for r in scripts.assemble_stream_chunks(df, ["conv_id"]).collect()}
    assert (got["a"].content, got["a"].usage.total_tokens, got["a"].error) == ("Hello", 7, None)
    assert got["b"].error == "busy" and got["c"].event_count == 1


def test_pool_catalog_order_and_window(rows):
    doc = '{"id":"1","kickOffTime":"2026-05-01T20:00:00","poolInfo":{"sellingPools":["EHH","HAD","CRS","HHA"]}}'
    df = rows([(doc,)], "body string")
    got = feeds.pool_catalog(df, ["HAD", "HHA"]).first()
    assert got.pool_types == ["HAD", "HHA", "EHH"]
    assert feeds.pool_catalog(df, now=F.lit("2026-05-10").cast("timestamp_ntz")).count() == 0
