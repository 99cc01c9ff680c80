"""Queries of the source parsers.

Bodies are made from the order table by Spark and parsed back; the SQL side takes the expected
values straight from the table, without parsing anything.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from oddsframe.functions import text as T
from oddsframe.plans.fx import ctes, fx, table
from oddsframe.plans.registry import query
from oddsframe.session import many_tasks
from oddsframe.sources import crowd, feeds, pages, scripts, tables


def orders(spark, sf):
    return table(spark, sf, "orders")


# Pieces from which on a template is long: generated code that lists them all is too long to be compiled to machine code.
LONG = 100


def body(spark, sf, template: str):
    """Orders with a body; `{expr}` in the template is a SQL expression over the order row."""
    parts, exprs, rest = [], [], template
    while "{{" in rest:
        head, rest = rest.split("{{", 1)
        expr, rest = rest.split("}}", 1)
        exprs += [] if expr in exprs else [expr]
        parts += [(F.lit(head), None), (None, expr)]
    parts.append((F.lit(rest), None))
    value = lambda expr: F.expr(f"cast({expr} as string)")
    joined = lambda read: F.concat(*[read(expr) if expr else piece for piece, expr in parts])
    if len(parts) > LONG:
        values = F.struct(*[value(expr).alias(f"v{i}") for i, expr in enumerate(exprs)])
        made = T.let(values, lambda v: joined(lambda expr: v[f"v{exprs.index(expr)}"]))
    else:
        made = joined(value)
    # the driver table is one file; spread its small rows before the bodies are made
    rows = orders(spark, sf).repartition(many_tasks(spark))
    return rows.select(F.col("o_orderkey").alias("page_id"), made.alias("body"))


@query(
    "s2_decode_pages",
    """select o_orderkey page_id, case o_orderkey % 3 when 0 then '澳門彩票' when 1 then '公司澳門彩票威廉希爾立博香港馬 ' else '澳* ' end || o_orderpriority as "text" from orders""",
)
def decoded(spark, sf):
    k = F.col("o_orderkey") % 3
    rows = orders(spark, sf).select(
        F.col("o_orderkey").alias("page_id"),
        F.when(k == 0, "text/html; charset=utf-8").when(k == 1, "").otherwise("text/html; charset=gb2312").alias("content_type"),
        k.alias("k"),
        F.concat(F.when(k == 0, "澳門彩票").when(k == 1, "公司澳門彩票威廉希爾立博香港馬 ").otherwise("澳* "), "o_orderpriority").alias("t"),
    )
    with pages.lenient_decoding(spark):
        rows = rows.withColumn("body", F.when(F.col("k") == 2, F.encode("t", "GB18030")).otherwise(F.encode("t", "UTF-8")))
    return pages.decode_pages(rows.drop("t", "k")).select("page_id", "text")


@query(
    "s3_drop_error_pages",
    f"with {ctes('fx_raw_pages')} select page_id, url from fx_raw_pages where page_id % 5 in (2, 3, 4)",
)
def useful(spark, sf):
    return pages.drop_error_pages(fx(spark, sf, "fx_raw_pages")).select("page_id", "url")


_STRIPPED = (
    "regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '<script\\b.*?</script>', '', 'gis'), '<style\\b.*?</style>', '', 'gis'),"
    " '<br\\s*/?>', ' ', 'gi'), '<[^>]+>', '', 'g')"
)


def _entities_sql(x):
    for name, ch in (("nbsp", " "), ("amp", "&"), ("lt", "<"), ("gt", ">"), ("quot", '"'), ("#39", "''")):
        x = f"regexp_replace({x}, '&{name};', '{ch}', 'gi')"
    return x


@query("s4_html_text", f"select page_id, trim(regexp_replace({_entities_sql(_STRIPPED)}, '[\\s ]+', ' ', 'g')) as \"text\" from pages")
def html_text(spark, sf):
    return table(spark, sf, "pages").select("page_id", T.cell_text(F.col("html")).alias("text"))


@query(
    "s5_parse_live_list",
    f"""with {ctes('fx_live_script')} select o_orderkey page_id, o_orderkey source_index, cast(o_orderkey as varchar) match_id, o_orderpriority league, 'H' || o_custkey % 40 home,
    'h' || o_custkey % 40 home_s, 'A' || o_orderkey % 40 away, '22:00' kickoff_raw, case o_orderstatus when 'O' then '0' when 'P' then '1' else '-1' end state_code,
    case o_orderstatus when 'O' then '未開' when 'P' then '上半場' else '完場' end state, '1-2' score from orders""",
)
def live(spark, sf):
    return scripts.parse_live_list(fx(spark, sf, "fx_live_script")).select(
        "page_id", "source_index", "match_id", "league", "home", "home_s", "away", "kickoff_raw", "state_code", "state", "score"
    )


_ODDS_ROW = (
    '<tr{hidden}><td><input name="oddsShow" data-id="{id}"></td><td>{name}</td><td>{multi}</td><td>0.7{{{{o_custkey % 10}}}}</td>'
    '<td goals="{{{{o_custkey % 5}}}}.25">球{{{{o_custkey % 5}}}}</td><td title="{{{{o_orderkey % 24}}}}:00">0.9{{{{o_custkey % 7}}}}</td>'
    '<td oddstype="wholeLastOdds">1</td><td oddstype="wholeLastOdds" goals="2">2</td><td oddstype="wholeLastOdds">3</td>'
    '<td oddstype="wholeOdds">0.8{{{{o_orderkey % 10}}}}</td><td oddstype="wholeOdds" goals="{{{{o_orderkey % 5}}}}.5">半</td>'
    '<td oddstype="wholeOdds">1.0{{{{o_orderkey % 7}}}}</td></tr>'
)
ODDS_PAGE = (
    '<html><table class="x" id="odds"><tr><th colspan="12">head</th></tr>'
    + _ODDS_ROW.format(hidden="", id="{{o_custkey % 50}}", name="Crown{{case when o_orderkey % 4 = 0 then ' 封' else '' end}}", multi="")
    + _ODDS_ROW.format(hidden=' style="display:none"', id="", name="", multi="盤2")
    + "<tr><td>short</td></tr></table><p>end</p></html>"
)
_ODDS_SQL = (
    "select o_orderkey page_id, {pos} pos, cast(o_custkey % 50 as varchar) company_id, 'Crown' company, {closed} is_closed, {multi} is_multi_line, '{label}' multi_label,"
    " '0.7' || o_custkey % 10 ini_a, '球' || o_custkey % 5 ini_line, o_custkey % 5 || '.25' ini_value, '0.9' || o_custkey % 7 ini_b, o_orderkey % 24 || ':00' ini_time,"
    " '0.8' || o_orderkey % 10 cur_a, o_orderkey % 5 || '.5' cur_value, '1.0' || o_orderkey % 7 cur_b, '2' last_value from orders"
)


def _odds_out(df):
    return df.select(
        "page_id", "pos", "company_id", "company", "is_closed", "is_multi_line", "multi_label", F.col("initial.a").alias("ini_a"),
        F.col("initial.line").alias("ini_line"), F.col("initial.line_value").alias("ini_value"), F.col("initial.b").alias("ini_b"),
        F.col("initial.time").alias("ini_time"), F.col("current.a").alias("cur_a"), F.col("current.line_value").alias("cur_value"),
        F.col("current.b").alias("cur_b"), F.col("last_before_current.line").alias("last_value"),
    )


@query(
    "s6_parse_odds_table",
    _ODDS_SQL.format(pos=0, closed="o_orderkey % 4 = 0", multi="false", label="") + " union all " + _ODDS_SQL.format(pos=1, closed="false", multi="true", label="盤2"),
)
def odds_table(spark, sf):
    return _odds_out(tables.parse_odds_table(body(spark, sf, ODDS_PAGE), include_multi=True))


@query("s6_parse_odds_table_main", _ODDS_SQL.format(pos=0, closed="o_orderkey % 4 = 0", multi="false", label=""))
def odds_table_main(spark, sf):
    return _odds_out(tables.parse_odds_table(body(spark, sf, ODDS_PAGE)))


_FLAT_PAGE = (
    '<table id="odds"><td>lead</td>'
    + _ODDS_ROW.format(hidden="", id="{{o_custkey % 50}}", name="Crown{{case when o_orderkey % 4 = 0 then ' 封' else '' end}}", multi="").replace("<tr>", "").replace("</tr>", "")
    + '<td><input name="oddsShow"></td><td>x</td></table>'
)


@query("s7_parse_flat_odds_table", _ODDS_SQL.format(pos=0, closed="o_orderkey % 4 = 0", multi="false", label=""))
def flat_table(spark, sf):
    return _odds_out(tables.parse_flat_odds_table(body(spark, sf, _FLAT_PAGE)))


@query(
    "s8_parse_page_meta",
    """select o_orderkey page_id, case when o_orderkey % 3 = 0 then '' else 'League ' || o_custkey % 9 end league, case when o_orderkey % 3 = 0 then lpad(cast(o_orderkey % 24 as varchar), 2, '0') || ':30'
    else '2026-04-19 ' || lpad(cast(o_orderkey % 24 as varchar), 2, '0') || ':00' end kickoff_raw, 'Home ' || o_custkey home, 'Away & ' || o_orderkey away from orders""",
)
def page_meta(spark, sf):
    desktop = (
        '<a class="a LName b">League {{o_custkey % 9}}</a><span class="time">2026-04-19 {{lpad(cast(o_orderkey % 24 as string), 2, "0")}}:00&nbsp;星期日</span>'
        '<div class="home x"><a href="/t">logo</a><a>Home {{o_custkey}}(主)</a></div><div class="guest"><a><b>Away &amp; {{o_orderkey}}</b>(客)</a></div>'
    )
    mobile = (
        '<div class="league">L 04-19 {{lpad(cast(o_orderkey % 24 as string), 2, "0")}}:30</div><div id="homeName">Home {{o_custkey}}</div><div id="guestName">Away &amp; {{o_orderkey}}</div>'
    )
    both = body(spark, sf, desktop).where("page_id % 3 <> 0").unionByName(body(spark, sf, mobile).where("page_id % 3 = 0"))
    return tables.parse_page_meta(both)


@query(
    "s9_parse_europe_js",
    """select o_orderkey page_id, cast(o_custkey % 12 as varchar) company_id, 'Book*' company, '2.05' ini_win, printf('%.2f', 1.20 + (o_custkey % 40) * 0.05) cur_win, '3.25' cur_draw, '0.86' ini_kelly,
    '0.95' cur_kelly_loss, timestamp '2026-04-04 04:56:00' changed_at, true is_primary, false is_exchange from orders""",
)
def europe_js(spark, sf):
    return scripts.parse_europe_js(fx(spark, sf, "fx_europe_script")).select(
        "page_id", "company_id", "company", F.col("initial.win").alias("ini_win"), F.col("current.win").alias("cur_win"),
        F.col("current.draw").alias("cur_draw"), F.col("initial.kelly_win").alias("ini_kelly"),
        F.col("current.kelly_loss").alias("cur_kelly_loss"), "changed_at", "is_primary", "is_exchange",
    )


@query(
    "s10_parse_europe_html",
    "select o_orderkey page_id, 0 pos, 'Book ' || o_custkey % 9 company, '2.' || o_custkey % 10 win, '3.1' draw, '0.9' || o_orderkey % 9 kelly_win, '04-19 10:00' changed_at_raw from orders",
)
def europe_html(spark, sf):
    cells = "".join(f"<td>{v}</td>" for v in ["Book {{o_custkey % 9}}", "2.{{o_custkey % 10}}", "", "3.1", "3.4", "44", "28", "27", "91", "0.9{{o_orderkey % 9}}", "0.95", "0.97", "04-19 10:00"])
    head = "".join(f"<th>{v}</th>" for v in ["公司"] + ["x"] * 11)
    page = f'<table id="other"></table><table id="datatb"><tr>{head}</tr><tr>{cells}</tr></table>'
    return tables.parse_europe_html(body(spark, sf, page)).select("page_id", "pos", "company", "win", "draw", "kelly_win", "changed_at_raw")


_SNAP = (
    'x <script>var freshJsonData = {"scheduleId":{{o_orderkey}},"sbOdds":{"sbOdds":[{"kind":"asian","odds":{"companyId":3,"firstHomeOdds":"0.9","homeOdds":"0.{{10 + o_custkey % 90}}",'
    '"drawOdds":"{{o_custkey % 5}}.25","awayOdds":"1.01","modifyTime":17000{{10000 + o_orderkey % 80000}}}},{"kind":"EURO","odds":{"homeOdds":"2.1","drawOdds":"3.3","awayOdds":"3.5"}}],"sbOddsHalf":[]},'
    '"jcOdds":{"sbOddsHalf":[{"kind":"OU","odds":{"homeOdds":"0.88","drawOdds":"1.5","awayOdds":"0.92"}}]}}; var z = {};</script>'
)
_SNAP_SQL = (
    "select o_orderkey page_id, 'asian' market, 'full' period, '3' company_id, 'Crow*' company, '0.' || 10 + o_custkey % 90 cur_a, o_custkey % 5 || '.25' cur_line, '1.01' cur_b, '0.9' ini_a,"
    " 1700000000 + 10000 + o_orderkey % 80000 changed from orders union all select o_orderkey, 'europe', 'full', '3', 'Crow*', '2.1', '3.3', '3.5', '', null from orders"
    " union all select o_orderkey, 'over_under', 'half', '48', '香港馬*', '0.88', '1.5', '0.92', '', null from orders"
)


@query("s11_parse_mobile_snapshot", _SNAP_SQL)
def snapshot(spark, sf):
    return feeds.parse_mobile_snapshot(body(spark, sf, _SNAP)).select(
        "page_id", "market", "period", "company_id", "company", F.col("current.a").alias("cur_a"), F.col("current.line").alias("cur_line"),
        F.col("current.b").alias("cur_b"), F.col("initial.a").alias("ini_a"), F.unix_seconds("changed_at").alias("changed"),
    )


_COMPARE = (
    '{"scheduleId":{{o_orderkey}},"companies":[{"companyId":{{o_custkey % 50}},"nameEn":"Book","details":[{"firstHomeOdds":"0.8","homeOdds":"0.9","drawOdds":"0.5","awayOdds":"1.{{10 + o_custkey % 80}}","num":1},'
    '{"homeOdds":"0.7","drawOdds":"0.75","awayOdds":"1.2","num":{{2 + o_custkey % 3}},"isStopLive":true},{"homeOdds":"","awayOdds":"1"}]}]}'
)


@query(
    "s12_parse_mobile_comparison",
    "select o_orderkey page_id, cast(o_custkey % 50 as varchar) company_id, 0 line_pos, '0.9' cur_a, '1.' || 10 + o_custkey % 80 cur_b, false is_multi_line, '' multi_label, false is_closed from orders"
    " union all select o_orderkey, cast(o_custkey % 50 as varchar), 1, '0.7', '1.2', true, '盤' || 2 + o_custkey % 3, true from orders",
)
def comparison(spark, sf):
    return feeds.parse_mobile_comparison(body(spark, sf, _COMPARE)).select(
        "page_id", "company_id", "line_pos", F.col("current.a").alias("cur_a"), F.col("current.b").alias("cur_b"), "is_multi_line", "multi_label", "is_closed"
    )


@query(
    "s13_parse_past_results",
    "select o_orderkey page_id, o_orderkey source_index, 'L' league, '26-04-19' played_at, cast(o_custkey % 40 as varchar) home_team_id, cast(o_orderkey % 40 as varchar) away_team_id,"
    " o_custkey % 4 home_goals, o_orderkey % 4 away_goals, 0.5 handicap, o_custkey % 4 + o_orderkey % 4 total_goals from orders",
)
def past(spark, sf):
    return scripts.parse_past_results(fx(spark, sf, "fx_past_script")).select(
        "page_id", "source_index", "league", "played_at", "home_team_id", "away_team_id", "home_goals", "away_goals", "handicap", "total_goals"
    )


_PROB = (
    '<script>var freshJsonData = {"scheduleId":1,"probabilityDatas":{"dataList":[{"companyName":"Crow*","companyId":{{o_custkey % 5}},"typeDatas":[{"kind":"ALL","oddsType":"OU",'
    '"probStatistics":[{"countType":"Five","count":5,"winScale":90,"drawScale":0,"lossScale":10},{"countType":"Ten","count":{{o_custkey % 20}},"winScale":{{o_orderkey % 101}},"drawScale":0,'
    '"lossScale":{{100 - o_orderkey % 101}}}]},{"kind":"HOME","oddsType":"OU","probStatistics":[]}]}]}};</script>'
)


@query(
    "s14_parse_probability_json",
    "select o_orderkey page_id, cast(o_custkey % 5 as varchar) company_id, 'Crow*' company_name, 'OU' odds_type, 'Five' count_type, 0 pos, 5 n, 90.0 win_scale, 10.0 loss_scale from orders"
    " union all select o_orderkey, cast(o_custkey % 5 as varchar), 'Crow*', 'OU', 'Ten', 1, o_custkey % 20, o_orderkey % 101, 100 - o_orderkey % 101 from orders",
)
def probability(spark, sf):
    return feeds.parse_probability_json(body(spark, sf, _PROB)).select(
        "page_id", "company_id", "company_name", "odds_type", "count_type", "pos", "n", "win_scale", "loss_scale"
    )


_PROB_TEXT = (
    "<section><h3>概率事件</h3><div><p>•胜:100% •平:0% •负:0%</p><p>近10场Crow*相同胜平负</p></div><div><p>•大:{{o_orderkey % 101}}% •走:0% •小:{{100 - o_orderkey % 101}}%</p>"
    "<p>近{{5 + o_custkey % 12}}场Crow*相同总进球数</p></div><li>赢:85% 近30场Pinna相同让球</li></section>"
)


@query(
    "s15_parse_probability_text",
    """with p as (select o_orderkey page_id, o_orderkey % 101 v, 5 + o_custkey % 12 n from orders) select page_id, '大' as type, v::double percent, '近' || n || '场Crow*相同总进球数' description from p where v >= 80 and n >= 10
    union all select page_id, '小', (100 - v)::double, '近' || n || '场Crow*相同总进球数' from p where 100 - v >= 80 and n >= 10 union all select page_id, '赢', 85.0, '近30场Pinna相同让球' from p""",
)
def probability_text(spark, sf):
    return feeds.parse_probability_text(body(spark, sf, _PROB_TEXT)).select("page_id", "type", "percent", "description")


_CROWD_BLOCK = (
    '<div class="match" id="match_position_{pos}"><div class="status"><div class="game_guess">日职联<i>05-06 13:00</i><p>x</p></div><span class="time blue" id="time_{id}" timestate="0">未</span></div>'
    '<div class="HTeam team" id="home_{id}" teamname="H{{{{o_custkey % 40}}}}"><span>[2]</span>名</div><div class="guessInfo"><div id="let_jd_{id}" data-count="{{{{o_custkey % 60}}}}" class="guessBar ">'
    '<div id="let_h_{id}" class="btn">主<span class="btnZS">0.96</span></div><span class="hCount">{{{{o_orderkey % 101}}}}%</span><span id="{id}_let" odds="0.5">受半球</span><span class="gCount">{{{{100 - o_orderkey % 101}}}}%</span>'
    '<div class="bar" style="width:51%"></div><div id="let_g_{id}" class="btn">客<span class="btnZS">0.92</span></div></div><div id="ou_jd_{id}" data-count="38" class="guessBar ">'
    '<div id="ou_o_{id}"><span class="btnZS">0.88</span></div><span class="hCount">{{{{o_custkey % 101}}}}%</span><span id="{id}_ou" odds="2.5">2.5</span><span class="gCount">{{{{100 - o_custkey % 101}}}}%</span></div></div>'
    '<div class="GTeam team" id="guest_{id}" teamname="">G{{{{o_orderkey % 40}}}}<span>[3]</span></div></div><div class="popupGuessTD"></div>'
)
_CROWD_PAGE = (
    _CROWD_BLOCK.format(pos="1", id="{{o_orderkey + 100}}") + _CROWD_BLOCK.format(pos="2", id="{{o_orderkey + 100}}").replace("受半球", "again")
)


@query(
    "s16_parse_crowd_index",
    """with s as (select o_orderkey page_id, (o_orderkey % 101)::double p, (o_custkey % 101)::double q, o_custkey, o_orderkey from orders) select page_id, cast(o_orderkey + 100 as varchar) match_id, '1' guess_id, '日职联' league,
    '05-06 13:00' kickoff_raw, '未' state, 'H' || o_custkey % 40 home, 'G' || o_orderkey % 40 away, '[2]' home_rank, '受半球' asian_line, 0.5 asian_line_odds, (o_custkey % 60)::double asian_count, p asian_home_percent, 100 - p asian_away_percent,
    0.96 asian_home_support_odds, 0.92 asian_away_support_odds, 51.0 asian_bar_width, q over_percent, 0.88 over_support_odds, case when p > 100 - p then 'home' when p < 100 - p then 'away' else 'balanced' end asian_lean,
    abs(p - (100 - p)) asian_edge, greatest(p, 100 - p, q, 100 - q) max_percent, greatest(p, 100 - p, q, 100 - q) >= 70 hot from s""",
)
def crowd_index(spark, sf):
    return crowd.parse_crowd_index(body(spark, sf, _CROWD_PAGE)).select(
        "page_id", "match_id", "guess_id", "league", "kickoff_raw", "state", "home", "away", "home_rank", "asian_line", "asian_line_odds", "asian_count",
        "asian_home_percent", "asian_away_percent", "asian_home_support_odds", "asian_away_support_odds", "asian_bar_width", "over_percent", "over_support_odds",
        "asian_lean", "asian_edge", "max_percent", "hot",
    )


_CROWD_HOME = (
    '<div class="title matchinfo" id="matchinfo_{{o_orderkey}}" data-time="2026,4,6,12,00,00"><span class="league">日职联</span><span class="L-time">12:00</span><a class="tit">A{{o_custkey % 9}} <span>VS</span> B</a>'
    '<a class="time blue"><span>已开场</span></a></div><ul></ul><div class="guessBar" onclick="window.open(\'//guess.example/tuijian/{{o_orderkey}}.html\', \'_blank\')">{{case when o_orderkey % 2 = 0 then'
    ' \'<div class="team"><div class="icon"><img src="//img.example/h.png" /></div><span>Home</span></div>\' else \'\' end}}<span class="hCount">{{o_orderkey % 101}}%</span><span>{{if(o_orderkey % 3 = 0, \'大小\', \'亚让\')}}</span><span class="gCount">{{100 - o_orderkey % 101}}%</span>'
    '<span class="hCount">60%</span><span>其他</span><span class="gCount">40%</span></div><div class="gl2 tabs"></div>'
)


@query(
    "s17_parse_crowd_home",
    """with s as (select *, (o_orderkey % 101)::double p from orders) select o_orderkey page_id, cast(o_orderkey as varchar) match_id, '日职联' league, '12:00' kickoff_raw, '已开场' state, case when o_orderkey % 2 = 0 then 'Home' else 'A' || o_custkey % 9 end home, 'B' away,
    case when o_orderkey % 2 = 0 then 'https://img.example/h.png' else '' end home_image, case when o_orderkey % 3 <> 0 then p end asian_home_percent, case when o_orderkey % 3 <> 0 then 60.0 else p end over_percent, case when o_orderkey % 3 <> 0 then 'over' when p > 100 - p then 'over' when p < 100 - p then 'under' else 'balanced' end total_lean from s""",
)
def crowd_home(spark, sf):
    return crowd.parse_crowd_home(body(spark, sf, _CROWD_HOME)).select(
        "page_id", "match_id", "league", "kickoff_raw", "state", "home", "away", "home_image", "asian_home_percent", "over_percent", "total_lean"
    )


@query(
    "s18_parse_pool_json",
    """select o_orderkey page_id, cast(o_orderkey as varchar) match_id, 'PREEVENT' status, 'HAD' pool, 'SELLINGSTARTED' pool_status, '0' line_id, 'H' sel, printf('%.2f', 1.70 + (o_custkey % 8) * 0.03) odds, 0 sel_index from orders
    union all select o_orderkey, cast(o_orderkey as varchar), 'PREEVENT', 'HAD', 'SELLINGSTARTED', '0', 'D', '3', 1 from orders""",
)
def pool_json(spark, sf):
    return feeds.parse_pool_json(fx(spark, sf, "fx_pool_json")).select("page_id", "match_id", "status", "pool", "pool_status", "line_id", "sel", "odds", "sel_index")


_CATALOG = (
    '{"id":"{{o_orderkey}}","frontEndId":"FB{{o_orderkey}}","kickOffTime":"2026-05-0{{1 + o_custkey % 9}}T10:00:00","status":"PREEVENT","homeTeam":{"name_ch":"","name_en":"H{{o_custkey % 40}}"},"awayTeam":{"name_ch":"A"},'
    '"poolInfo":{"sellingPools":["EHL","HAD"{{case when o_orderkey % 2 = 0 then \',"CRS","HIL"\' else \'\' end}}]}}'
)


@query(
    "s19_pool_catalog",
    """select cast(o_orderkey as varchar) match_id, 'FB' || o_orderkey front_end_id, 'H' || o_custkey % 40 home, 'A' away, case when o_orderkey % 2 = 0 then 'HAD,HIL,EHL' else 'HAD,EHL' end pool_types from orders where o_custkey % 9 between 1 and 3""",
)
def catalog(spark, sf):
    out = feeds.pool_catalog(body(spark, sf, _CATALOG), now=F.lit("2026-05-01 12:00:00").cast("timestamp_ntz"), hours=72)
    return out.select("match_id", "front_end_id", "home", "away", F.array_join("pool_types", ",").alias("pool_types"))


_PERSON = '{"player":{"id":{{o_custkey}},"name":"P#","type":"Out","reason":"Knee"},"team":{"id":7,"name":"T{{o_custkey % 9}}"},"fixture":{"id":{{o_orderkey}}}}'


@query(
    "s20_parse_context_injuries",
    "select o_orderkey page_id, i pos, 'P' || i player, 'T' || o_custkey % 9 team, 'Knee' reason, cast(o_orderkey as varchar) fixture_id from orders, range(33) t(i)",
)
def injuries(spark, sf):
    doc = '{"response":[' + ",".join(_PERSON.replace("#", str(i)) for i in range(33)) + "]}"
    columns = ["player", "team", "reason", "fixture_id"]
    return feeds.parse_context_json(body(spark, sf, doc), "injuries", columns=columns).select("page_id", "pos", *columns)


@query(
    "s20_parse_context_lineups",
    "select o_orderkey page_id, 'T' || o_custkey % 9 team, '4-4-2' formation, 'start' \"role\", i pos, 'S' || i as \"name\" from orders, range(12) t(i) union all select o_orderkey, 'T' || o_custkey % 9, '4-4-2', 'substitute', i, 'R' || i from orders, range(13) t(i)",
)
def lineups(spark, sf):
    people = lambda p, n: ",".join(f'{{"player":{{"id":{i},"name":"{p}{i}","number":{i},"pos":"M"}}}}' for i in range(n))
    doc = '{"response":[{"team":{"id":1,"name":"T{{o_custkey % 9}}"},"formation":"4-4-2","coach":{"name":"C"},"startXI":[' + people("S", 12) + '],"substitutes":[' + people("R", 13) + "]}]}"
    return feeds.parse_context_json(body(spark, sf, doc), "lineups").select("page_id", "team", "formation", "role", "pos", "name")


@query(
    "s20_parse_context_weather",
    "select o_orderkey page_id, timestamp '2026-04-19 10:00:00' + to_hours(cast(i as int)) hour_ts, (o_custkey % 30 + i)::double temperature_c, case i when 0 then 0.5 else 1.5 end precipitation_mm from orders, range(2) t(i)",
)
def weather(spark, sf):
    doc = '{"hourly":{"time":["2026-04-19T10:00","2026-04-19T11:00"],"temperature_2m":[{{o_custkey % 30}},{{o_custkey % 30 + 1}}],"precipitation":[0.5,1.5],"wind_speed_10m":[9,8]}}'
    return feeds.parse_context_json(body(spark, sf, doc), "weather").select("page_id", "hour_ts", "temperature_c", "precipitation_mm")


@query(
    "s20_parse_context_fixtures",
    "select o_orderkey page_id, cast(o_orderkey as varchar) fixture_id, '2026-04-19' as \"date\", 'NS' status, 'Not Started' status_long, 'Ground ' || o_custkey % 5 venue, 'City ' || o_custkey % 9 city, '1' league_id, 'PL' league, 'England' country,"
    " '2026' season, 'Round ' || o_custkey % 38 as \"round\", '1' home_id, 'H' || o_custkey % 40 home, '2' away_id, 'A' || o_orderkey % 40 away, (o_custkey % 4)::int goals_home, null::int goals_away, 1 halftime_home, 0 halftime_away,"
    " (o_custkey % 4)::int fulltime_home, null::int fulltime_away, null::int extratime_home, null::int extratime_away, null::int penalty_home, null::int penalty_away from orders",
)
def fixtures(spark, sf):
    doc = (
        '{"response":[{"fixture":{"id":{{o_orderkey}},"date":"2026-04-19","status":{"long":"Not Started","short":"NS"},"venue":{"name":"Ground {{o_custkey % 5}}","city":"City {{o_custkey % 9}}"}},"league":{"id":1,"name":"PL","country":"England","season":2026,"round":"Round {{o_custkey % 38}}"},'
        '"teams":{"home":{"id":1,"name":"H{{o_custkey % 40}}"},"away":{"id":2,"name":"A{{o_orderkey % 40}}"}},"goals":{"home":{{o_custkey % 4}},"away":null},"score":{"halftime":{"home":1,"away":0},"fulltime":{"home":{{o_custkey % 4}},"away":null}}}]}'
    )
    return feeds.parse_context_json(body(spark, sf, doc), "fixtures")


@query("s21_parse_event_props", "select event_id, cast(json_extract(props, '$.k') as bigint) k from events")
def props(spark, sf):
    return scripts.parse_event_props(table(spark, sf, "events"), "props", {"k": "long"}).select("event_id", "k")


@query(
    "s22_assemble_stream_chunks",
    """select conv_id, count(*) + 1 event_count, string_agg(role || '-' || turn || ';', '' order by turn) content, max(turn) total_tokens, 'last' is null as has_error from conversations group by conv_id""",
)
def stream_chunks(spark, sf):
    delta = F.to_json(
        F.struct(
            F.array(F.struct(F.struct(F.concat("role", F.lit("-"), "turn", F.lit(";")).alias("content")).alias("delta"))).alias("choices"),
            F.struct(F.col("turn").alias("total_tokens")).alias("usage"),
        )
    )
    tail = F.when(F.col("turn") == 0, F.lit("data: broken{\n\ndata: [DONE]")).otherwise(F.lit("data: [DONE]"))
    rows = table(spark, sf, "conversations").withColumn("text", F.concat(F.lit(": ping\r\ndata: "), delta, F.lit("\n"), tail))
    out = scripts.assemble_stream_chunks(rows, ["conv_id"])
    return out.select("conv_id", "event_count", "content", F.col("usage.total_tokens").alias("total_tokens"), F.col("error").isNotNull().alias("has_error"))


_NUM = "regexp_extract(replace(\"text\", ',', ''), '-?[0-9]+(?:\\.[0-9]+)?')"


@query("x1_first_number", f"select doc_id, try_cast(nullif({_NUM}, '') as double) number from documents")
def first_number(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.first_number(F.col("text")).alias("number"))


_TRAD = "translate(replace(replace(\"text\" || '冠军马会超级', '冠军', '冠軍'), '超级', '超級'), '马赛会门尔苏乌联维级组欧亚职业韩总杯国兰围区胜凯还让盘进数', '馬賽會門爾蘇烏聯維級組歐亞職業韓總盃國蘭圍區勝凱還讓盤進數')"


@query("x7_to_traditional", f"select doc_id, md5({_TRAD}) folded from documents")
def traditional(spark, sf):
    raw = F.concat("text", F.lit("冠军马会超级"))
    return table(spark, sf, "documents").select("doc_id", F.md5(T.to_traditional(raw)).alias("folded"))


@query(
    "x8_norm_name",
    "select doc_id, md5(regexp_replace(regexp_replace(replace(lower(translate(\"text\", '马赛会门尔苏乌联维级组欧亚职业韩总杯国兰围区胜凯还让盘进数', '馬賽會門爾蘇烏聯維級組歐亞職業韓總盃國蘭圍區勝凱還讓盤進數')), '封', ''), '[（(][^）)]*[）)]', '', 'g'), '[^0-9a-z一-鿿]+', '', 'g')) norm from documents",
)
def norm_name(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(T.norm_name(F.col("text"))).alias("norm"))


@query(
    "x21_absolute_url",
    "select page_id, case page_id % 3 when 0 then 'https://cdn.example/' || page_id when 1 then 'https://home.example/a/' || page_id else url end link from pages",
)
def links(spark, sf):
    k, i = F.col("page_id") % 3, F.col("page_id").cast("string")
    raw = F.when(k == 0, F.concat(F.lit("//cdn.example/"), i)).when(k == 1, F.concat(F.lit("/a/"), i)).otherwise(F.col("url"))
    return table(spark, sf, "pages").select("page_id", T.absolute_url(raw, "https://home.example/x/index.html").alias("link"))


@query("x22_mask_key", "select page_id, case when contains(url, '?') then url || '&key=sk-***' else url || '?key=sk-***' end || '&z=1' url from pages")
def masked(spark, sf):
    mark = F.when(F.contains("url", F.lit("?")), F.lit("&")).otherwise(F.lit("?"))
    raw = F.concat(F.col("url"), mark, F.lit("key=secret"), F.col("page_id").cast("string"), F.lit("&z=1"))
    return table(spark, sf, "pages").select("page_id", T.mask_key(raw).alias("url"))


@query("x23_token_estimate", "select doc_id, cast(ceil(length(\"text\") / 4.0) as bigint) tokens from documents")
def tokens(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.token_estimate(F.col("text")).alias("tokens"))
