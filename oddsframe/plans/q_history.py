"""Queries of the head-to-head and probability operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from oddsframe.operators import history as H
from oddsframe.plans.fx import ctes, fx
from oddsframe.plans.registry import query
from oddsframe.plans.sqltext import rn

_PAST = f"with {ctes('fx_past', 'fx_matches')}, p as (select *, least(home_team_id, away_team_id) t1, greatest(home_team_id, away_team_id) t2 from fx_past)"
_MATCHES = "m as (select match_id, case when source_index % 50 = 0 then '' else home_team_id end home_team_id, away_team_id, case when source_index % 50 = 0 then '' else least(home_team_id, away_team_id) end t1, greatest(home_team_id, away_team_id) t2 from fx_matches where state_code = '0')"


def upcoming(spark, sf):
    home = F.when(F.col("source_index") % 50 == 0, "").otherwise(F.col("home_team_id"))
    return fx(spark, sf, "fx_matches").where("state_code = '0'").withColumn("home_team_id", home)


@query(
    "j9_head_to_head",
    f"{_PAST}, {_MATCHES} select p.source_index, t1 team_1, t2 team_2, home_goals, away_goals from p where exists (select 1 from m where m.t1 = p.t1 and m.t2 = p.t2 and m.t1 <> '')",
)
def meetings(spark, sf):
    out = H.head_to_head(upcoming(spark, sf), fx(spark, sf, "fx_past"))
    return out.select("source_index", "team_1", "team_2", "home_goals", "away_goals")


_STATS = f"""{_PAST}, {_MATCHES}, past2 as (select * from p union all select * replace (source_index + 10000000 as source_index) from p where source_index % 3 = 0), d as (select home_team_id, away_team_id, t1, t2, played_at, home_goals, away_goals, min(source_index) source_index from past2 group by all), s as (select t1, t2, count(*) n, count(*) filter (home_goals + away_goals > 2.5) o from d group by all),
    l as (select t1, t2, string_agg(cast(played_at as varchar) || ' ' || home_goals || '-' || away_goals, ' | ' order by source_index) history from
      (select * from d qualify row_number() over (partition by t1, t2 order by source_index) <= 10) group by all),
    r as (select match_id, m.t1, coalesce(n, 0) n, o, history, case when m.t1 = '' then 'missing_ids' when n is null then 'no_meetings' when n < 12 then 'too_few' end reason
      from m left join s using (t1, t2) left join l using (t1, t2)),
    h as (select match_id, case when t1 = '' then 0 else n end sample_count, reason no_data_reason, case when reason is null then o end over_count,
      case when reason is null then n - o end under_count, case when reason is null then history end history,
      case when reason is null then {rn('o::double / n * 100.0::double', 1)} end over_percent, case when reason is null then {rn('(n - o)::double / n * 100.0::double', 1)} end under_percent from r)"""


def landed(spark, sf):
    """Past results of which a third was landed from a second page as well."""
    past = fx(spark, sf, "fx_past")
    return past.unionByName(past.where("source_index % 3 = 0").withColumn("source_index", F.col("source_index") + 10_000_000))


@query("a8_h2h_over_under", f"{_STATS} select *, coalesce(over_percent >= 60, false) over_hit, coalesce(under_percent >= 60, false) under_hit from h")
def over_under(spark, sf):
    out = H.h2h_over_under(upcoming(spark, sf), landed(spark, sf), 60, 12)
    return out.select(
        "match_id", "sample_count", "no_data_reason", "over_count", "under_count", "history", "over_percent", "under_percent",
        "over_hit", "under_hit",
    )


@query(
    "a8_h2h_hits",
    f"""{_STATS}, x as (select match_id, sample_count, '大球' as type, over_count c, over_percent p from h where over_percent >= 60 union all
    select match_id, sample_count, '小球', under_count, under_percent from h where under_percent >= 60)
    select match_id, type, p percent, '近' || sample_count || '次對賽，' || type || c || '次（' || regexp_replace(cast(p as varchar), '\\.0$', '') || '%）' description from x""",
)
def hits(spark, sf):
    out = H.h2h_over_under(upcoming(spark, sf), landed(spark, sf), 60, 12)
    return H.h2h_hits(out).select("match_id", "type", "percent", "description")


EVENTS = f"""with {ctes('fx_prob')}, b as (select * from fx_prob where kind = 'ALL' and odds_type in ('LETGOAL', 'OU') and n >= 10
      qualify row_number() over (partition by match_id, company_id, odds_type order by count_type <> 'Ten', pos) = 1),
    e as (select *, case odds_type when 'OU' then '大' else '赢' end as type, win_scale percent from b union all
      select *, '走', draw_scale from b union all select *, case odds_type when 'OU' then '小' else '输' end, loss_scale from b)"""
EVENT_ROWS = "select match_id, company_id, odds_type, type, percent, n as count, '近' || n || '场相同' || case odds_type when 'OU' then '总进球数' else '让球' end description from e where percent >= 80"


@query("a9_probability_events", f"{EVENTS} {EVENT_ROWS}")
def events(spark, sf):
    out = H.probability_events(fx(spark, sf, "fx_prob"))
    return out.select("match_id", "company_id", "odds_type", "type", "percent", "count", "description")
