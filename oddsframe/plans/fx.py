"""Input views over the driver tables, as SQL text that Spark and DuckDB both run.

A registered query and its SQL twin start from the same text, so inputs cannot differ.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

FX = {
    "fx_matches": """
select cast(o_orderkey as string) match_id, o_orderkey source_index, o_orderpriority league,
 concat('Team ', cast(o_custkey % 40 as string)) home, concat('Team ', cast(o_orderkey % 40 as string)) away,
 cast(o_custkey % 40 as string) home_team_id, cast(o_orderkey % 40 as string) away_team_id,
 o_orderdate kickoff_ts, case o_orderstatus when 'O' then '0' when 'P' then '1' else '-1' end state_code
 from orders where o_custkey % 40 <> o_orderkey % 40
""",
    "fx_quotes": """
select cast(l_orderkey % 3000 as string) match_id,
 case l_linenumber % 5 when 0 then 'europe' when 1 then 'asian' when 2 then 'asian' else 'over_under' end market,
 case when l_linenumber % 5 in (2,4) then 'half' else 'full' end period,
 case l_suppkey % 12 when 0 then '47' when 1 then '1' when 2 then '3' when 3 then '8' when 4 then '9' when 5 then '4' when 6 then '31' when 7 then '19' when 8 then '48' when 9 then '281' when 10 then '177' else '432' end company_id,
 l_returnflag = 'R' is_multi_line, l_linestatus = 'O' is_closed, l_shipdate changed_at,
 cast(case when l_linenumber % 5 = 0 then 1.2 + l_discount * 20 else 0.7 + l_discount * 4 end as double) cur_a,
 cast(case when l_linenumber % 5 = 0 then 2.5 + l_tax * 20 end as double) cur_draw,
 cast(case when l_partkey % 17 = 0 then null when l_linenumber % 5 = 0 then 1.5 + l_quantity / 10 else 0.7 + l_tax * 5 end as double) cur_b,
 cast(case when l_linenumber % 5 <> 0 then ((cast(l_quantity as bigint) % 9) - 4) / 4.0 end as double) cur_line,
 cast(case when l_linenumber % 5 = 0 then 1.2 + (l_partkey % 11) * 0.2 else 0.7 + (l_partkey % 11) * 0.04 end as double) ini_a,
 cast(case when l_linenumber % 5 = 0 then 2.5 + (l_partkey % 9) * 0.2 end as double) ini_draw,
 cast(case when l_linenumber % 5 = 0 then 1.5 + (l_partkey % 50) * 0.1 else 0.7 + (l_partkey % 9) * 0.05 end as double) ini_b,
 cast(case when l_linenumber % 5 <> 0 then ((l_partkey % 9) - 4) / 4.0 end as double) ini_line,
 l_extendedprice tie_break
 from lineitem
""",
    "fx_past": """
select o_orderkey source_index, o_orderdate played_at, cast(o_custkey % 40 as string) home_team_id,
 cast(o_orderkey % 40 as string) away_team_id,
 cast(floor(o_totalprice) as bigint) % 4 home_goals, cast(floor(o_totalprice / 10) as bigint) % 4 away_goals
 from orders where o_custkey % 40 <> o_orderkey % 40
""",
    "fx_pool": """
select cast(l_orderkey % 1500 as string) pool_match_id,
 case when l_returnflag = 'R' then 'CRS' when l_returnflag = 'A' then 'FCS' else 'HAD' end pool,
 cast(l_linenumber % 2 as string) line_id,
 case when l_returnflag = 'N' then (case l_suppkey % 3 when 0 then 'H' when 1 then 'D' else 'A' end)
      else concat('0', cast(l_suppkey % 3 as string), '0', cast(l_partkey % 3 as string)) end sel,
 case when l_returnflag = 'N' then cast(1.70 + (l_partkey % 8) * 0.03 as decimal(10,2))
      else cast(5 + (l_partkey % 22) * 0.5 as decimal(10,2)) end odds,
 case when l_linestatus = 'O' then 'AVAILABLE' else 'SUSPENDED' end comb_status, l_shipdate update_at,
 nullif(cast(l_linenumber % 3 as string), '2') snapshot_id, case when l_suppkey % 11 = 0 then 'SUSPENDED' when l_suppkey % 13 = 0 then '' else 'SellingStarted' end pool_status
 from lineitem
""",
    "fx_support": """
select cast(event_id as string) match_id, ts kickoff_ts, cast(user_id % 101 as int) asian_home_percent,
 100 - cast(user_id % 101 as int) asian_away_percent, cast(event_id % 101 as int) over_percent, 100 - cast(event_id % 101 as int) under_percent from events
""",
    "fx_ticks": """
select event_id, ts, cast(user_id as string) match_id, event_type bookmaker_key, value price from events
""",
    "fx_names_a": """
select p_partkey id, cast(floor(p_partkey / 50) as bigint) snapshot_id, concat(p_name, ' fc') home, concat(p_name, ' ', lower(p_brand)) away, lower(p_type) league, cast(p_size as bigint) kickoff_min from part
""",
    "fx_names_b": """
select p_partkey + 1000000 id, cast(floor(p_partkey / 50) as bigint) snapshot_id, replace(p_name, 'in', 'im') home, concat(lower(p_brand), ' ', p_name) away, lower(p_type) league, cast(p_size as bigint) + (p_partkey % 3) * 45 kickoff_min from part
""",
    "fx_prob": """
select cast(p_partkey % 400 as string) match_id, cast(p_partkey % 5 as string) company_id, case p_size % 3 when 0 then 'LETGOAL' when 1 then 'OU' else 'EURO' end odds_type, case when p_partkey % 7 = 0 then 'HOME' else 'ALL' end kind, case when p_size % 2 = 0 then 'Ten' else 'Five' end count_type, p_partkey pos, p_size n, cast(p_partkey % 101 as double) win_scale, 0.0 + cast(0 as double) draw_scale, cast(100 - p_partkey % 101 as double) loss_scale from part
""",
    "fx_sections": """
select cast(o_orderkey % 2000 as string) match_id, case o_custkey % 5 when 0 then 'asianFull' when 1 then 'asianHalf' when 2 then 'overUnderFull' when 3 then 'overUnderHalf' else 'europe' end section, o_orderkey source_index, cast(o_custkey % 5 as int) books, cast(o_custkey % 9 as int) kept_rows, cast(o_custkey % 31 as int) raw_rows, o_orderstatus = 'F' incomplete, case when o_custkey % 13 = 0 then 'timeout' end error from orders
""",
    "fx_probe": """
select event_id, case event_id % 8 when 0 then 200 when 1 then 403 when 2 then 429 when 3 then 503 when 4 then 302 when 5 then 404 else 200 end status_code, case event_id % 11 when 0 then 'ECONNRESET before secure TLS' when 1 then 'Timeout after 12000ms' end error, case event_id % 8 when 6 then '' when 7 then 'please enable cookies' else props end body from events
""",
    "fx_pool_json": """
select o_orderkey page_id, concat('{"id":"', cast(o_orderkey as string), '","status":"PREEVENT","foPools":[{"oddsType":"HAD","status":"SELLINGSTARTED","lines":[{"lineId":"0","combinations":[{"str":"H","currentOdds":"', cast(cast(1.70 + (o_custkey % 8) * 0.03 as decimal(10,2)) as string), '"},{"str":"D","currentOdds":"3"}]}]}]}') body from orders
""",
    "fx_raw_pages": """
select page_id, url, case page_id % 5 when 0 then concat('<title>404 Not Found</title>', html) when 1 then concat('<p>500 - Internal server error</p>', html) when 2 then concat('<title>404</title><div id="compDiv"></div>', html) else html end body from pages
""",
    "fx_europe_script": """
select o_orderkey page_id, concat('var game=Array("', cast(o_custkey % 12 as string), '|', cast(o_orderkey as string), '|Book|2.05|3.25|3.4|44.77|28.24|26.99|91.78|', cast(cast(1.20 + (o_custkey % 40) * 0.05 as decimal(10,2)) as string), '|3.25|3.25|42.48|28.76|28.76|93.46|0.93|0.93|0.95|2026,04-1,04,04,56,00|Book*|1|0|0.86|0.93|0.99");') body from orders
""",
    "fx_past_script": """
select o_orderkey page_id, concat('p[', cast(o_orderkey as string), ']=[''L'',''#000'',''26-04-19'',', cast(o_custkey % 40 as string), ',', cast(o_orderkey % 40 as string), ',', cast(o_custkey % 4 as string), ',', cast(o_orderkey % 4 as string), ',0,0,0.5];') body from orders
""",
    "fx_live_script": """
select o_orderkey page_id, concat('A[', cast(o_orderkey as string), ']="', cast(o_orderkey as string), '^c^', o_orderpriority, '^', o_orderpriority, '^^h', cast(o_custkey % 40 as string), '^H', cast(o_custkey % 40 as string), '^^a', cast(o_orderkey % 40 as string), '^A', cast(o_orderkey % 40 as string), '^^22:00^d^', case o_orderstatus when 'O' then '0' when 'P' then '1' else '-1' end, '^1^2".split(''^'');') body from orders
""",
    "fx_outputs": """
select o_orderkey id, case when o_custkey % 2 = 0 then 'top10_ai_ranking' else 'single_match_deep_analysis' end workflow, case o_custkey % 4 when 0 then 'plain text only' when 1 then 'x ```json {"schemaVersion":"odds-analysis-v1","match_meta":{},"recommendation":{"recommendation":"observe"}} ```' when 2 then 'x ```json {"schemaVersion":"odds-analysis-v1","top10":[{"matchId":"1","confidenceScore":80}],"dataQuality":{},"top3Candidates":[]} ```' else 'x ```json {"schemaVersion":"v0","top10":[]} ```' end text from orders
""",
    "fx_context": """
select s_suppkey id, case when s_suppkey % 10 = 0 then null else cast(s_suppkey % 50 as string) end match_id, s_name item from supplier
""",
    "fx_cache": """
select cast(o_orderkey % 4000 as string) match_id, o_orderkey source_index, o_orderdate saved_at, o_totalprice result from orders
""",
    "fx_outcomes": """
select o_orderkey id, o_orderdate created_at, case when o_orderstatus = 'F' then 'miss' else 'hit' end result, o_orderpriority workflow from orders
""",
    "fx_links": """
select cast(o_orderkey as string) match_id, cast(o_custkey % 101 as int) score, cast(o_custkey % 4 as int) pool_count, case when o_custkey % 101 >= 72 then 'open' when o_custkey % 101 >= 58 then 'possible' else 'not_found' end status from orders
""",
}

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fx(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The view as a DataFrame; only the driver tables it names are read."""
    sql = FX[name]
    used = [t for t in TABLES if re.search(rf"\bfrom {t}\b", sql)]
    return spark.sql(
        re.sub(r"\bfrom (%s)\b" % "|".join(used), r"from {\1}", sql.replace("{", "{{").replace("}", "}}")),
        **{t: table(spark, sf_dir, t) for t in used},
    )


def ctes(*names: str) -> str:
    """`with` list for an oracle."""
    return ", ".join(f"{n} as ({FX[n].strip()})" for n in names)
