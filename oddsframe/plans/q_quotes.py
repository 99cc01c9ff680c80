"""Queries of the quote operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from oddsframe import dims
from oddsframe.operators import quotes as Q
from oddsframe.plans.fx import ctes, fx
from oddsframe.plans.registry import query
from oddsframe.plans.sqltext import KEYED, MAIN, ROW_ORDER, TARGETS, values

ORDER = ("changed_at", "tie_break", "company_id", "ini_a", "cur_a")
QUOTES = f"with {ctes('fx_quotes')}, {KEYED}"


def quotes(spark, sf):
    return fx(spark, sf, "fx_quotes")


@query(
    "j1_identify_bookmaker",
    f"""{QUOTES} select match_id, market, period, company_id, bookmaker_key, bookmaker, count(*) n_rows
    from keyed group by all""",
)
def identify(spark, sf):
    return (
        Q.identify_bookmaker(quotes(spark, sf))
        .groupBy("match_id", "market", "period", "company_id", "bookmaker_key", "bookmaker")
        .agg(F.count(F.lit(1)).alias("n_rows"))
    )


@query(
    "w1_latest_quote",
    f"""with {ctes('fx_quotes')} select match_id, company_id, changed_at, tie_break, cur_a, ini_a from fx_quotes
    where market = 'europe' qualify row_number() over (partition by match_id, company_id
    order by changed_at desc, tie_break desc, ini_a desc) = 1""",
)
def latest(spark, sf):
    out = Q.latest_quote(quotes(spark, sf).where("market = 'europe'"), index="tie_break")
    return out.select("match_id", "company_id", "changed_at", "tie_break", "cur_a", "ini_a")


@query(
    "w2_dedupe_main_line",
    f"""{QUOTES} select match_id, market, period, bookmaker_key, company_id, is_multi_line, changed_at, tie_break, cur_a, cur_b
    from keyed where bookmaker_key is not null qualify row_number() over (partition by match_id, market, period, bookmaker_key
    order by is_multi_line, {ROW_ORDER}) = 1""",
)
def dedupe(spark, sf):
    return Q.dedupe_main_line(Q.identify_bookmaker(quotes(spark, sf)), ORDER).select(
        "match_id", "market", "period", "bookmaker_key", "company_id", "is_multi_line", "changed_at", "tie_break", "cur_a", "cur_b"
    )


@query(
    "w3_filter_bookmakers",
    f"""{QUOTES}, {MAIN} select match_id, market, period, bookmaker_key, bookmaker, rnk bookmaker_rank, is_multi_line, changed_at,
    cur_a, cur_b, cur_line from main join ranks on id_key = bookmaker_key""",
)
def filtered(spark, sf):
    return Q.filter_bookmakers(quotes(spark, sf), order=ORDER).select(
        "match_id", "market", "period", "bookmaker_key", "bookmaker", "bookmaker_rank", "is_multi_line", "changed_at",
        "cur_a", "cur_b", "cur_line",
    )


@query(
    "w3_filter_bookmakers_off",
    f"""{QUOTES} select market, coalesce(bookmaker_key, '') bookmaker_key, coalesce(rnk, {len(dims.BOOKMAKERS) + 1}) bookmaker_rank,
    count(*) n_rows from keyed left join ranks on id_key = bookmaker_key group by all""",
)
def unfiltered(spark, sf):
    return (
        Q.filter_bookmakers(quotes(spark, sf), keep_all=True)
        .groupBy("market", F.coalesce("bookmaker_key", F.lit("")).alias("bookmaker_key"), "bookmaker_rank")
        .agg(F.count(F.lit(1)).alias("n_rows"))
    )


@query(
    "w4_carry_forward",
    f"""with {ctes('fx_quotes')}, r as (select match_id, changed_at, tie_break, ini_a, cur_a, market, is_multi_line,
    case when is_multi_line then null else company_id end company from fx_quotes),
    o as (select *, row_number() over (partition by match_id order by changed_at, tie_break, ini_a, cur_a) k from r)
    select match_id, changed_at, tie_break, coalesce(company, '') company,
    coalesce(last_value(company ignore nulls) over (partition by match_id order by k rows unbounded preceding), '') company_carried
    from o""",
)
def carried(spark, sf):
    rows = quotes(spark, sf).select(
        "match_id", "changed_at", "tie_break", "ini_a", "cur_a",
        F.when(F.col("is_multi_line"), F.lit("")).otherwise(F.col("company_id")).alias("company"),
    )
    block = F.year("changed_at")
    out = Q.carry_forward(rows, "company", ["match_id"], block, ["changed_at", "tie_break", "ini_a", "cur_a"])
    return out.select(
        "match_id", "changed_at", "tie_break", "company", F.coalesce("company_carried", F.lit("")).alias("company_carried")
    )


_SPLIT = "primary_rows as (select * from keyed where not is_multi_line), supplement as (select * from keyed where is_multi_line)"


@query(
    "j7_merge_market_sources",
    f"""{QUOTES}, {_SPLIT} select match_id, market, period, company_id, 0 merge_rank, tie_break from supplement
    union all select p.match_id, p.market, p.period, p.company_id, 1, p.tie_break from primary_rows p where not exists (
      select 1 from supplement s where s.match_id = p.match_id and s.market = p.market and s.period = p.period
      and s.bookmaker_key is not distinct from p.bookmaker_key)""",
)
def merged(spark, sf):
    q = quotes(spark, sf)
    out = Q.merge_market_sources(q.where("not is_multi_line"), q.where("is_multi_line"))
    return out.select("match_id", "market", "period", "company_id", "merge_rank", "tie_break")


_FEEDS = {
    "pages": "company_id in ('47', '3') and cast(match_id as bigint) % 3 <> 0",
    "mobile": "company_id in ('8', '1', '3') and cast(match_id as bigint) % 4 <> 0",
    "comparison": "company_id in ('3', '31') and is_closed",
    "official": "company_id = '48' and not is_closed",
}


def _resolve_sql(deep: bool) -> str:
    two_way = "market <> 'europe'"
    feeds = ", ".join(f"f_{n} as (select * from keyed where {two_way} and {c})" for n, c in _FEEDS.items())
    same = "x.match_id = b.match_id and x.market = b.market and x.period = b.period"
    base = (
        f"select * from f_pages union all select * from f_mobile b where not exists (select 1 from f_pages x where {same})"
        if deep
        else "select * from f_mobile union all select * from f_pages b where not exists (select 1 from f_mobile x where x.match_id = b.match_id)"
    )
    overlay = (
        f"select * from f_comparison union all select * from base b where not exists (select 1 from f_comparison x where {same}"
        " and x.bookmaker_key is not distinct from b.bookmaker_key)"
    )
    fillable = "(market = 'over_under' or (market = 'asian' and period = 'full'))"
    fill = (
        f"select * from f_official b where {fillable}"
        " and (select count(distinct m.market || m.period) from merged m where m.match_id = b.match_id and m.bookmaker_key = 'hk_jockey'"
        " and (m.market = 'over_under' or (m.market = 'asian' and m.period = 'full'))) < 3"
        f" and not exists (select 1 from merged x where {same} and x.bookmaker_key = 'hk_jockey')"
    )
    return (
        f"{QUOTES}, {feeds}, base as ({base}), merged as ({overlay}), fill as ({fill}),"
        " done as (select * from fill union all select * from merged)"
        " select match_id, market, period, company_id, tie_break, cur_line from done"
    )


def _resolved(deep):
    def run(spark, sf):
        q = quotes(spark, sf).where("market <> 'europe'")
        feeds = {n: q.where(c) for n, c in _FEEDS.items()}
        out = Q.resolve_market_sources(**feeds, deep=deep)
        return out.select("match_id", "market", "period", "company_id", "tie_break", "cur_line")

    return run


query("j8_resolve_market_sources_fast", _resolve_sql(False))(_resolved(False))
query("j8_resolve_market_sources_deep", _resolve_sql(True))(_resolved(True))


@query(
    "j11_coverage_gaps",
    f"""{QUOTES}, {values([(k,) for k in dims.TARGET_BOOKMAKERS], 'wanted', 'bookmaker_key')}
    select s.match_id, s.market, s.period, w.bookmaker_key from (select distinct match_id, market, period from keyed) s, wanted w
    where not exists (select 1 from keyed k where k.match_id = s.match_id and k.market = s.market and k.period = s.period
      and k.bookmaker_key = w.bookmaker_key)""",
)
def gaps(spark, sf):
    return Q.coverage_gaps(quotes(spark, sf))


@query(
    "a13_market_coverage",
    f"""{QUOTES} select match_id, market, period, count(*) raw_rows,
    count(distinct bookmaker_key) filter (bookmaker_key in {TARGETS}) covered_count,
    count(distinct bookmaker_key) filter (bookmaker_key in {TARGETS}) || '/4' coverage_label,
    4 - count(distinct bookmaker_key) filter (bookmaker_key in {TARGETS}) missing_count,
    concat_ws(',', case when not bool_or(coalesce(bookmaker_key = 'pinna', false)) then 'Pinna' end,
      case when not bool_or(coalesce(bookmaker_key = 'bet365', false)) then 'Bet365' end,
      case when not bool_or(coalesce(bookmaker_key = 'crown', false)) then 'Crown' end,
      case when not bool_or(coalesce(bookmaker_key = 'hk_jockey', false)) then '香港賽馬會' end) missing_labels
    from keyed group by match_id, market, period""",
)
def coverage(spark, sf):
    out = Q.market_coverage(quotes(spark, sf))
    return out.select(
        "match_id", "market", "period", "raw_rows", "covered_count", "coverage_label", F.size("missing").alias("missing_count"),
        F.array_join("missing_labels", ",").alias("missing_labels"),
    )


@query(
    "a14_candidate_score",
    f"""with {ctes('fx_sections')}, s as (select *, books * 1000 + kept_rows * 10 + raw_rows - case when incomplete then 5000 else 0 end score
    from fx_sections) select match_id, section, source_index, score, incomplete or raw_rows = 0 or (books < 4 and raw_rows < 20) retry
    from s qualify row_number() over (partition by match_id, section order by score desc, source_index) = 1""",
)
def candidates(spark, sf):
    return Q.candidate_score(fx(spark, sf, "fx_sections")).select("match_id", "section", "source_index", "score", "retry")


_FLAT_OUT = [
    "matchId", "league", "kickoffTime", "home", "away", "market", "period", "bookmakerKey", "companyId", "isClosed", "isMultiLine",
    "initialHomeOdds", "currentHandicapValue", "currentAwayOdds", "currentOverOdds", "currentTotalValue", "initialUnderOdds",
    "initialWin", "currentDraw", "currentLoss", "changedAt",
]


@query(
    "f1_flatten_quotes",
    f"""with {ctes('fx_quotes', 'fx_matches')}, {KEYED} select k.match_id "matchId", league, cast(kickoff_ts as varchar) "kickoffTime", home, away, market,
    case when market = 'europe' then 'full' else period end as "period", bookmaker_key "bookmakerKey", company_id "companyId",
    case when market <> 'europe' then case when is_closed then '1' else '0' end end "isClosed",
    case when market <> 'europe' then case when is_multi_line then '1' else '0' end end "isMultiLine",
    case when market = 'asian' then ini_a end "initialHomeOdds", case when market = 'asian' then cur_line end "currentHandicapValue",
    case when market = 'asian' then cur_b end "currentAwayOdds", case when market = 'over_under' then cur_a end "currentOverOdds",
    case when market = 'over_under' then cur_line end "currentTotalValue", case when market = 'over_under' then ini_b end "initialUnderOdds",
    case when market = 'europe' then ini_a end "initialWin", case when market = 'europe' then cur_draw end "currentDraw",
    case when market = 'europe' then cur_b end "currentLoss", case when market = 'europe' then cast(changed_at as varchar) end "changedAt"
    from keyed k left join (select * from fx_matches where source_index % 7 <> 0) m on m.match_id = k.match_id""",
)
def flat(spark, sf):
    known = fx(spark, sf, "fx_matches").where("source_index % 7 <> 0")  # some quotes have no match data, some matches come twice
    again = known.where("source_index % 5 = 0").withColumns({"source_index": F.col("source_index") + 10_000_000, "league": F.lit("later")})
    return Q.flatten_quotes(Q.identify_bookmaker(quotes(spark, sf)), known.unionByName(again)).select(*_FLAT_OUT)


@query(
    "u1_union_markets",
    f"""with {ctes('fx_quotes')} select match_id, market, period, tie_break, case when market = 'europe' then cur_draw end cur_draw,
    case when market <> 'europe' then cur_line end cur_line from fx_quotes""",
)
def unioned(spark, sf):
    q = quotes(spark, sf)
    base = ["match_id", "market", "period", "tie_break"]
    two = [q.where((F.col("market") == m) & (F.col("period") == p)).select(*base, "cur_line")
           for m in ("asian", "over_under") for p in ("full", "half")]
    return Q.union_markets(*two, q.where("market = 'europe'").select(*base, "cur_draw"))
