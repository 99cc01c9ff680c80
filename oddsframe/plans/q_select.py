"""Queries of the selection operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from oddsframe.functions import odds as X
from oddsframe.functions import times
from oddsframe.operators import select as S
from oddsframe.plans.fx import ctes, fx, table
from oddsframe.plans.registry import query

NOW = "1998-06-15 00:00:00"
# fx_matches with real league names, so that the league rules have work to do
LEAGUES = {"1-URGENT": "英超附加賽", "2-HIGH": "世界杯外围赛", "3-MEDIUM": "地區聯賽", "4-NOT SPECIFIED": "J League Cup", "5-LOW": "日職百年构想联赛"}
_CASE = "case league " + " ".join(f"when '{k}' then '{v}'" for k, v in LEAGUES.items()) + " end"
M = f"with {ctes('fx_matches')}, m as (select * replace ({_CASE} as league) from fx_matches)"


def now():
    return F.lit(NOW).cast("timestamp_ntz")


def matches(spark, sf):
    names = F.create_map(*[F.lit(x) for kv in LEAGUES.items() for x in kv])
    return fx(spark, sf, "fx_matches").withColumn("league", F.try_element_at(names, F.col("league")))


@query("f2_filter_allowed_leagues", f"{M} select match_id, league from m where league in ('英超附加賽', '世界杯外围赛', '日職百年构想联赛')")
def allowed(spark, sf):
    return S.filter_allowed_leagues(matches(spark, sf)).select("match_id", "league")


@query("f2_filter_allowed_leagues_list", f"{M} select match_id, league from m where league = '日職百年构想联赛'")
def allowed_list(spark, sf):
    rows = matches(spark, sf).withColumns({"league_s": F.col("league"), "league_t": F.lit("")})
    return S.filter_allowed_leagues(rows, ["日職聯"]).select("match_id", "league")


@query("f3_league_names_expanded", f"{M} select league, count(*) n_matches from m where league in ('英超附加賽', '日職百年构想联赛') group by league")
def spellings(spark, sf):
    """Accepted spellings that occur in the match list, as written."""
    names = S.league_names_expanded(spark).withColumnRenamed("league_name", "league")
    return matches(spark, sf).join(F.broadcast(names), "league").groupBy("league").agg(F.count(F.lit(1)).alias("n_matches"))


@query("f4_search_league", f"{M} select match_id, league from m where league in ('世界杯外围赛')")
def searched(spark, sf):
    return S.search_league(matches(spark, sf), "世盃外").select("match_id", "league")


@query(
    "f5_normalize_match_ids",
    f"{M} select cast(source_index % 900 as varchar) match_id, min(source_index) source_index from m where source_index % 900 % 7 <> 0 group by 1",
)
def ids(spark, sf):
    bucket = F.col("source_index") % 900
    raw = F.when(bucket % 7 == 0, F.concat(F.lit("x"), bucket)).otherwise(F.concat(F.lit(" "), bucket, F.lit(" ")))
    rows = matches(spark, sf).withColumn("match_id", raw)
    return S.normalize_match_ids(rows).select("match_id", "source_index")


@query(
    "f5_match_ids_in_text",
    "select o_orderkey, cast(o_orderkey as varchar) || ',' || cast(o_custkey as varchar) ids from orders",
)
def ids_in_text(spark, sf):
    rows = table(spark, sf, "orders")
    raw = F.concat(F.lit("id "), "o_orderkey", F.lit("; #"), "o_custkey", F.lit(" end"))
    return rows.select("o_orderkey", F.array_join(S.match_ids_in_text(raw), ",").alias("ids"))


_STATE = "case state_code when '0' then '' when '1' then '上半場' else '完場' end"


@query(
    "f6_lifecycle_status",
    f"{M} select match_id, case state_code when '0' then 'upcoming' when '1' then 'live' else 'finished' end lifecycle from m",
)
def lifecycle(spark, sf):
    rows = matches(spark, sf).withColumn("state", F.expr(_STATE))
    return S.lifecycle_status(rows).select("match_id", "lifecycle")


@query(
    "f7_prematch_only",
    f"{M} select match_id from m where case when source_index % 2 = 0 then state_code = '0' else state_code = '0' and kickoff_ts >= timestamp '{NOW}' - interval 5 minute end",
)
def prematch(spark, sf):
    rows = matches(spark, sf).withColumn("state", F.expr(_STATE))
    rows = rows.withColumn("state_code", F.when(F.col("source_index") % 2 == 0, F.col("state_code")).otherwise(F.lit("")))
    return S.prematch_only(rows, now()).select("match_id")


@query(
    "f7_crowd_prematch_only",
    f"with {ctes('fx_support')} select match_id from fx_support where cast(match_id as bigint) % 3 <> 0 and kickoff_ts >= timestamp '2024-01-10 00:00:00' - interval 5 minute and kickoff_ts <= timestamp '2024-01-10 00:00:00' + interval 240 hour",
)
def crowd_prematch(spark, sf):
    rows = fx(spark, sf, "fx_support").withColumn(
        "state", F.when(F.col("match_id").cast("long") % 3 == 0, F.lit("Half")).otherwise(F.lit(""))
    )
    return S.crowd_prematch_only(rows, F.lit("2024-01-10").cast("timestamp_ntz"), 240).select("match_id")


def _window_sql(lo, hi):
    cmp = ">" if lo > 0 else ">="
    return f"kickoff_ts {cmp} timestamp '{NOW}' + interval {lo} hour and kickoff_ts <= timestamp '{NOW}' + interval {hi} hour"


@query("f8_kickoff_within", f"{M} select match_id, kickoff_ts from m where {_window_sql(24, 24 * 30)}")
def within(spark, sf):
    return S.kickoff_within(matches(spark, sf), 24, 24 * 30, now()).select("match_id", "kickoff_ts")


@query("f8_kickoff_window_0_24", f"{M} select match_id, kickoff_ts from m where state_code = '0' and {_window_sql(0, 24)}")
def window(spark, sf):
    return S.kickoff_window(matches(spark, sf), "0-24", now()).select("match_id", "kickoff_ts")


_POOLS = f"{M}, p as (select match_id, kickoff_ts, case source_index % 3 when 0 then 'FIRST_HALF_INPLAY' else 'PREEVENT' end status from m)"


def pool_rows(spark, sf):
    inplay = F.when(F.col("source_index") % 3 == 0, "FIRST_HALF_INPLAY").otherwise("PREEVENT")
    return matches(spark, sf).select("match_id", "kickoff_ts", inplay.alias("status"))


LATE = "1998-06-15 02:00:00"


@query("f9_pool_window", f"{_POOLS} select match_id from p where kickoff_ts between timestamp '{LATE}' and timestamp '{LATE}' + interval 480 hour")
def in_window(spark, sf):
    return S.pool_window(pool_rows(spark, sf), F.lit(LATE).cast("timestamp_ntz"), 480).select("match_id")


@query(
    "f9_pool_window_or_inplay",
    f"{_POOLS} select match_id from p where kickoff_ts between timestamp '{LATE}' and timestamp '{LATE}' + interval 24 hour or (status like '%INPLAY%' and kickoff_ts between timestamp '{LATE}' - interval 4 hour and timestamp '{LATE}')",
)
def in_play(spark, sf):
    return S.pool_window_or_inplay(pool_rows(spark, sf), F.lit(LATE).cast("timestamp_ntz"), 24).select("match_id")


@query("f10_open_pools", f"with {ctes('fx_pool')} select pool_match_id, pool, count(*) n_rows from fx_pool where comb_status = 'AVAILABLE' group by all")
def opened(spark, sf):
    rows = S.open_pools(fx(spark, sf, "fx_pool"), "comb_status")
    return rows.groupBy("pool_match_id", "pool").agg(F.count(F.lit(1)).alias("n_rows"))


LINKED = f"{M[:4]} {ctes('fx_matches', 'fx_links')}, m as (select f.*, l.score link_score, l.status link_status, l.pool_count from fx_matches f join fx_links l using (match_id))"


def linked(spark, sf):
    checks = fx(spark, sf, "fx_links")
    return S.attach_link_status(fx(spark, sf, "fx_matches"), checks).join(checks.select("match_id", "pool_count"), "match_id")


@query(
    "f11_search_matches",
    f"{LINKED} select match_id, link_status from m where state_code = '0' and link_status = 'open' and contains(lower(concat_ws(' ', match_id, league, home, away)), 'team 7')",
)
def search(spark, sf):
    return S.search_matches(linked(spark, sf), "Team 7", "upcoming", "open").select("match_id", "link_status")


@query(
    "f12_extraction_targets",
    f"{LINKED} select match_id, link_score from m where pool_count > 0 and (link_status = 'open' or (link_status = 'possible' and link_score >= 50)) and state_code = '0' and {_window_sql(0, 24 * 60)}",
)
def targets(spark, sf):
    return S.extraction_targets(linked(spark, sf), 0, 24 * 60, now()).select("match_id", "link_score")


@query(
    "f13_compact_columns",
    f"{M} select match_id, case when state_code = '1' then null else league end league, home,"
    " '{\"match_id\":\"' || match_id || '\"' || case when state_code = '1' then '' else ',\"league\":\"' || league || '\"' end || ',\"home\":\"' || home || '\"}' compact_json from m",
)
def compact(spark, sf):
    rows = matches(spark, sf).withColumn("league", F.when(F.col("state_code") == "1", F.lit("")).otherwise(F.col("league")))
    return S.compact_columns(rows, ["match_id", "league", "home", "missing_column"])


@query(
    "f14_probability_market_allowed",
    f"with {ctes('fx_prob')} select odds_type, odds_type <> 'EURO' allowed, count(*) n_rows from fx_prob group by all",
)
def allowed_market(spark, sf):
    label = F.when(F.col("odds_type") == "OU", "总进球数").when(F.col("odds_type") == "LETGOAL", "初盘让球").otherwise("让球 胜平负")
    rows = fx(spark, sf, "fx_prob").withColumn("allowed", S.probability_market_allowed(label))
    return rows.groupBy("odds_type", "allowed").agg(F.count(F.lit(1)).alias("n_rows"))


_SECTIONS = (
    f"with {ctes('fx_sections')}, s as (select match_id, section, source_index % 11 <> 0 ok, error, case books when 0 then '香港賽馬會' when 1 then 'Crown' end missing from fx_sections)"
)


def sections(spark, sf):
    label = F.when(F.col("books") == 0, "香港賽馬會").when(F.col("books") == 1, "Crown")
    return fx(spark, sf, "fx_sections").select(
        "match_id", "section", (F.col("source_index") % 11 != 0).alias("ok"), "error", F.lit(None).cast("string").alias("match_error"),
        F.when(label.isNotNull(), F.array(label)).alias("missing_labels"),
    )


@query(
    "f15_retry_issues",
    f"{_SECTIONS} select distinct match_id, type, label, detail from (select match_id, 'match_error' as type, '整場提取' as label, '沒有回傳資料' as detail from s where not ok"
    " union all select match_id, 'market_error', section, error from s where ok and error is not null"
    " union all select match_id, 'bookmaker_missing', section, '缺：' || missing from s where ok and missing = 'Crown')",
)
def issues(spark, sf):
    return S.retry_issues(sections(spark, sf))


@query("f15_retryable_results", f"{_SECTIONS} select distinct match_id from s where not ok or error is not null or missing = 'Crown'")
def retryable(spark, sf):
    return S.retryable_results(sections(spark, sf))


_LIVE = f"{M}, items as (select match_id, case when source_index % 4 = 0 then '' else home_team_id end home_team_id, home from m where source_index % 2 = 0), live as (select match_id, home_team_id, 'L' || home home, state_code from m where source_index % 3 = 0)"


@query(
    "j5_merge_live_meta",
    f"{_LIVE} select i.match_id, coalesce(nullif(i.home_team_id, ''), l.home_team_id) home_team_id, i.home, l.state_code from items i left join live l using (match_id)",
)
def live_meta(spark, sf):
    m = matches(spark, sf)
    team = F.when(F.col("source_index") % 4 == 0, "").otherwise(F.col("home_team_id"))
    items = m.where("source_index % 2 = 0").select("match_id", team.alias("home_team_id"), "home")
    live = m.where("source_index % 3 = 0").select("match_id", "home_team_id", F.concat(F.lit("L"), "home").alias("home"), "state_code")
    return S.merge_live_meta(items, live)


@query(
    "j6_merge_match_meta",
    f"""{M}, a as (select match_id, case when source_index % 2 = 0 then '' else home end home, null league from m where source_index % 3 <> 0),
    b as (select match_id, 'B' || home home, league from m) select b.match_id, coalesce(nullif(a.home, ''), b.home) home, b.league from b left join a using (match_id)""",
)
def match_meta(spark, sf):
    m = matches(spark, sf)
    first = m.where("source_index % 3 <> 0").select(
        "match_id", F.when(F.col("source_index") % 2 == 0, " ").otherwise(F.col("home")).alias("home")
    )
    second = m.select("match_id", F.concat(F.lit("B"), "home").alias("home"), "league")
    return S.merge_match_meta(first, second, fields=["home", "league"])


@query(
    "j14_attach_link_status",
    f"with {ctes('fx_matches', 'fx_links')} select m.match_id, coalesce(l.status, 'not_found') link_status, l.score link_score from fx_matches m left join (select * from fx_links where pool_count > 1) l using (match_id)",
)
def attached(spark, sf):
    checks = fx(spark, sf, "fx_links").where("pool_count > 1")
    return S.attach_link_status(fx(spark, sf, "fx_matches"), checks).select("match_id", "link_status", "link_score")


@query("a16_link_summary", f"with {ctes('fx_links')} select count(*) checked, count(*) filter (status = 'open') open_count, count(*) filter (status = 'possible') possible_count from fx_links")
def link_counts(spark, sf):
    return S.link_summary(fx(spark, sf, "fx_links"))


BATCH = (
    f"with {ctes('fx_sections')}, r as (select match_id, source_index % 5 <> 0 ok, case when source_index % 10 = 0 then 'HTTP 404 at page' when source_index % 5 = 0 then 'timeout' end error,"
    " case when source_index % 5 <> 0 then books else 0 end hits from fx_sections)"
)


def batch_rows(spark, sf):
    i = F.col("source_index")
    return fx(spark, sf, "fx_sections").select(
        "match_id", (i % 5 != 0).alias("ok"), F.when(i % 10 == 0, "HTTP 404 at page").when(i % 5 == 0, "timeout").alias("error"),
        F.when(i % 5 != 0, F.col("books")).otherwise(F.lit(0)).alias("hits"),
    )


@query(
    "a15_batch_summary",
    f"""{BATCH} select count(*) total, count(*) filter (ok or error like 'HTTP 404%') ok_count, count(*) filter (not ok and error = 'timeout') error_count,
    count(*) filter (coalesce(error like 'HTTP 404%', false)) no_data_count, cast(sum(hits) as bigint) hit_count, count(distinct match_id) filter (hits > 0) match_hit_count,
    cast(ceil(count(*) / 25.0) as bigint) batch_count from r""",
)
def batch(spark, sf):
    return S.batch_summary(batch_rows(spark, sf))


@query("l1_order_by_kickoff", f"with {ctes('fx_support')} select match_id, kickoff_ts from fx_support order by kickoff_ts, cast(match_id as bigint)")
def by_kickoff(spark, sf):
    rows = fx(spark, sf, "fx_support").withColumn("source_index", F.col("match_id").cast("long"))
    return S.order_by_kickoff(rows).select("match_id", "kickoff_ts")


@query("l2_sort_hits", f"{M} select match_id, league || '|' || home || '|' || away sort_text from m order by kickoff_ts, 2")
def sorted_hits(spark, sf):
    return S.sort_hits(matches(spark, sf).withColumn("tournament", F.col("league"))).select("match_id", "sort_text")


@query("l3_limit_matches", f"{M} select match_id, source_index from m order by source_index limit 50")
def limited(spark, sf):
    return S.limit_matches(matches(spark, sf), 50).select("match_id", "source_index")


@query(
    "l4_chunk_ids",
    f"{M} select match_id, nullif(state_code, '1') snapshot_id, cast((row_number() over (partition by state_code order by source_index) - 1) // 25 as bigint) chunk from m",
)
def chunks(spark, sf):
    rows = matches(spark, sf).withColumn("snapshot_id", F.nullif(F.col("state_code"), F.lit("1")))  # a NULL key is a key
    return S.chunk_ids(rows).select("match_id", "snapshot_id", "chunk")


@query("u2_excluded_matches", f"{M} select count(distinct match_id) excluded from m where state_code <> '0'")
def excluded(spark, sf):
    m = matches(spark, sf)
    return S.excluded_matches(m, m.where("state_code = '0'"))


@query(
    "u3_target_options",
    f"with {ctes('fx_matches', 'fx_cache')} select match_id, 'current' source from fx_matches where state_code = '0' union all select distinct match_id, 'cache' from fx_cache c where not exists (select 1 from fx_matches m where m.match_id = c.match_id and m.state_code = '0')",
)
def options(spark, sf):
    current = fx(spark, sf, "fx_matches").where("state_code = '0'").select("match_id", "source_index")
    return S.target_options(current, fx(spark, sf, "fx_cache").select("match_id", "source_index")).select("match_id", "source")


@query("u4_intersect_keys", "select o_orderkey, o_custkey % 7 = o_orderkey % 5 or o_custkey % 3 = o_orderkey % 5 or o_custkey % 7 = 9 shared from orders")
def shared(spark, sf):
    c, k = F.col("o_custkey"), F.col("o_orderkey")
    return table(spark, sf, "orders").select("o_orderkey", S.intersect_keys(F.array(c % 7, c % 3), F.array(k % 5, F.lit(9).cast("long"))).alias("shared"))


@query(
    "x14_score_text_state_label",
    f"""{M} select match_id, case when home_team_id = '0' then '' else home_team_id || '-' || away_team_id end score,
    case state_code when '0' then '未開' when '1' then '上半場' else '完場' end state from m""",
)
def labels(spark, sf):
    home = F.when(F.col("home_team_id") == "0", "").otherwise(F.col("home_team_id"))
    return matches(spark, sf).select("match_id", X.score_text(home, F.col("away_team_id")).alias("score"), X.state_label(F.col("state_code")).alias("state"))


@query(
    "x15_parse_kickoff",
    f"""{M} select match_id, case cast(source_index % 4 as int) when 0 then kickoff_ts when 1 then timestamp '{NOW}' + (date_trunc('day', kickoff_ts) - date_trunc('day', kickoff_ts)) + to_hours(cast(source_index % 24 as int))
      + to_minutes(5) when 2 then case when month(kickoff_ts) <> 2 or day(kickoff_ts) <> 29 then make_timestamp(1998, month(kickoff_ts), least(day(kickoff_ts), case month(kickoff_ts) when 2 then 28 else 31 end), source_index % 24, 30, 0) end end kickoff from m""",
)
def kickoffs(spark, sf):
    i, k = F.col("source_index"), F.col("kickoff_ts")
    hour = F.lpad((i % 24).cast("string"), 2, "0")
    raw = (
        F.when(i % 4 == 0, F.date_format(k, "yyyy/M/d HH:mm"))
        .when(i % 4 == 1, F.concat(hour, F.lit(":05")))
        .when(i % 4 == 2, F.concat(F.date_format(k, "MM-dd "), hour, F.lit(":30")))
        .otherwise(F.lit("TBA"))
    )
    return matches(spark, sf).select("match_id", times.parse_kickoff(raw, now()).alias("kickoff"))


@query(
    "x17_labels",
    f"""with {ctes('fx_support')} select match_id, case when user_p >= 70 then '高' when user_p >= 40 then '中' else '低' end risk,
    case when user_p >= 72 then '高' when user_p >= 50 then '中' else '低' end confidence, case when user_p >= 70 then '強' when user_p >= 40 then '中' else '弱' end pressure
    from (select match_id, asian_home_percent user_p from fx_support)""",
)
def level_labels(spark, sf):
    p = F.col("asian_home_percent")
    return fx(spark, sf, "fx_support").select(
        "match_id", X.risk_label(p).alias("risk"), X.confidence_label(p).alias("confidence"), X.pressure_label(p).alias("pressure")
    )


@query("x18_clamp_round", "select event_id, greatest(0.0, least(5.0, value)) clamped, floor(value * 10.0::double + 0.5::double) / 10.0::double rounded from events")
def clamped(spark, sf):
    v = F.col("value")
    return table(spark, sf, "events").select("event_id", X.clamp(v, 0.0, 5.0).alias("clamped"), X.round_n(v, 1).alias("rounded"))


@query(
    "x6_implied_prob",
    f"""with {ctes('fx_quotes')}, q as (select match_id, company_id, tie_break, cur_a, cur_draw, cur_b, 1.0/cur_a + 1.0/cur_draw + 1.0/cur_b o from fx_quotes where market = 'europe')
    select match_id, company_id, tie_break, floor(o * 1000000.0 + 0.5) / 1000000.0 overround, floor((1.0/cur_a)/o * 1000000.0 + 0.5) / 1000000.0 fair_home,
    floor((1.0/cur_draw)/o * 1000000.0 + 0.5) / 1000000.0 fair_draw, floor((1.0/cur_b)/o * 1000000.0 + 0.5) / 1000000.0 fair_away from q""",
)
def implied(spark, sf):
    q = fx(spark, sf, "fx_quotes").where("market = 'europe'")
    shares = X.implied(F.col("cur_a"), F.col("cur_draw"), F.col("cur_b"))
    return q.select("match_id", "company_id", "tie_break", *[X.round_n(v, 6).alias(k) for k, v in shares.items()])
