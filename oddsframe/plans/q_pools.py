"""Queries of the pool scans."""

from __future__ import annotations

from pyspark.sql import functions as F

from oddsframe.functions import odds as X
from oddsframe.operators import features as A
from oddsframe.operators import pools as P
from oddsframe.plans.fx import ctes, fx
from oddsframe.plans.registry import query
from oddsframe.plans.sqltext import rn

ORDER = ("update_at", "odds")
NOW = "2001-06-01 00:00:00"
HOURS = 24 * 120

# Selections with the columns of a landed pool table; kickoff is a function of the match.
POOL = (
    f"with {ctes('fx_pool')}, sel as (select pool_match_id match_id, cast('FB' || pool_match_id as varchar) front_end_id,"
    " timestamp '2001-01-01 00:00:00' + to_days(cast(cast(pool_match_id as bigint) % 700 as int)) kickoff_ts,"
    " pool, line_id, sel, odds, comb_status, update_at, snapshot_id, pool_status from fx_pool)"
)
_SCORES = (
    "scores as (select *, cast(cast(sel[1:2] as int) as varchar) || ':' || cast(cast(sel[3:4] as int) as varchar) score,"
    " cast(sel[1:2] as int) + cast(sel[3:4] as int) total, printf('%.2f', odds) o from sel where pool in ('CRS', 'FCS') and odds < 15)"
)


def sel(spark, sf):
    return fx(spark, sf, "fx_pool").select(
        F.col("pool_match_id").alias("match_id"),
        F.concat(F.lit("FB"), "pool_match_id").alias("front_end_id"),
        (F.lit("2001-01-01").cast("timestamp_ntz") + F.make_dt_interval((F.col("pool_match_id").cast("long") % 700).cast("int"))).alias("kickoff_ts"),
        "pool", "line_id", "sel", "odds", "comb_status", "update_at", "snapshot_id", "pool_status",
    )


def now():
    return F.lit(NOW).cast("timestamp_ntz")


def _three_way_sql(source: str) -> str:
    return (
        f"had as (select snapshot_id, match_id, front_end_id, kickoff_ts, line_id, max_by(printf('%.2f', odds), (update_at, odds)) filter (sel = 'H') h,"
        f" max_by(printf('%.2f', odds), (update_at, odds)) filter (sel = 'D') d, max_by(printf('%.2f', odds), (update_at, odds)) filter (sel = 'A') a"
        f" from {source} where pool = 'HAD' group by all), three as (select snapshot_id, match_id, front_end_id, kickoff_ts, line_id, 'HAD_HOME_AWAY_' || p as \"rule\", 'H' selection, h odds"
        " from had, (values ('1.73'), ('1.76')) t(p) where h = p union all select snapshot_id, match_id, front_end_id, kickoff_ts, line_id, 'HAD_HOME_AWAY_' || p, 'A', a from had,"
        " (values ('1.73'), ('1.76')) t(p) where a = p union all select snapshot_id, match_id, front_end_id, kickoff_ts, line_id, 'HAD_2.14_3.00_3.00', 'H', h from had"
        " where h = '2.14' and d = '3.00' and a = '3.00' union all select snapshot_id, match_id, front_end_id, kickoff_ts, line_id, 'HAD_3.00_3.00_2.14', 'A', a from had"
        " where h = '3.00' and d = '3.00' and a = '2.14')"
    )


@query("p1_scan_three_way", f"{POOL}, {_three_way_sql('sel')} select snapshot_id, match_id, line_id, \"rule\", selection, odds from three")
def three_way(spark, sf):
    return P.scan_three_way(sel(spark, sf), ORDER).select("snapshot_id", "match_id", "line_id", "rule", "selection", "odds")


# Other pools made from the HAD rows so that every price rule has candidates.
_VARIED = (
    "varied as (select snapshot_id, match_id, front_end_id, kickoff_ts, line_id, sel, update_at,"
    " case when pool <> 'HAD' then pool when line_id = '0' then 'FHA' when cast(match_id as bigint) % 2 = 0 then 'FHL' else 'EHL' end pool,"
    " case when pool = 'HAD' and line_id = '1' then odds - 0.04 else odds end odds from sel)"
)
_PRICE = (
    "price as (select snapshot_id, match_id, front_end_id, kickoff_ts, line_id, pool, sel selection, printf('%.2f', odds) odds, pool || case pool when 'FHA' then '_DRAW_' else '_ANY_' end"
    " || printf('%.2f', odds) as \"rule\" from {0} where (pool = 'FHA' and sel = 'D' and odds = 1.76) or (pool = 'EHL' and odds in (1.66, 1.69))"
    " or (pool = 'FHL' and odds in (1.66, 1.69, 1.94)))"
)


def varied(spark, sf):
    had = F.col("pool") == "HAD"
    other = F.when(F.col("line_id") == "0", "FHA").when(F.col("match_id").cast("long") % 2 == 0, "FHL").otherwise("EHL")
    less = (F.col("odds") - F.lit(0.04).cast("decimal(3,2)")).cast("decimal(10,2)")
    return sel(spark, sf).withColumns(
        {"odds": F.when(had & (F.col("line_id") == "1"), less).otherwise(F.col("odds")), "pool": F.when(had, other).otherwise(F.col("pool"))}
    )


@query("p2_scan_price_rules", f"{POOL}, {_VARIED}, {_PRICE.format('varied')} select snapshot_id, match_id, line_id, pool, \"rule\", selection, odds from price")
def price_rules(spark, sf):
    return P.scan_price_rules(varied(spark, sf)).select("snapshot_id", "match_id", "line_id", "pool", "rule", "selection", "odds")


_IN_WINDOW = f"kickoff_ts between timestamp '{NOW}' and timestamp '{NOW}' + to_hours({HOURS})"
_BOTH = f"bothp as (select * from sel where pool = 'HAD' and {_IN_WINDOW} union all by name select * from varied where pool in ('FHA', 'FHL', 'EHL') and {_IN_WINDOW})"


def both(spark, sf):
    s = sel(spark, sf)
    return s.where("pool = 'HAD'").unionByName(varied(spark, sf).where("pool in ('FHA', 'FHL', 'EHL')"))


@query(
    "p3_scan_special_odds",
    f"{POOL}, {_VARIED}, {_BOTH}, {_three_way_sql('bothp')}, {_PRICE.format('bothp')} select snapshot_id, match_id, front_end_id, kickoff_ts, line_id, 'HAD' pool, \"rule\", selection, odds from three"
    " union all select snapshot_id, match_id, front_end_id, kickoff_ts, line_id, pool, \"rule\", selection, odds from price",
)
def special(spark, sf):
    return P.scan_special_odds(both(spark, sf), now(), HOURS, ORDER).select(
        "snapshot_id", "match_id", "front_end_id", "kickoff_ts", "line_id", "pool", "rule", "selection", "odds"
    )


@query(
    "p3_scan_summary",
    f"{POOL}, {_VARIED}, {_BOTH}, {_three_way_sql('bothp')}, {_PRICE.format('bothp')} select (select count(distinct (coalesce(snapshot_id, '-'), match_id)) from bothp) scanned_matches,"
    " (select count(*) from three) + (select count(*) from price) hit_count",
)
def special_summary(spark, sf):
    rows = both(spark, sf)
    return P.scan_summary(rows, P.scan_special_odds(rows, now(), HOURS, ORDER), now(), HOURS)


_EQUAL = (
    "equal_total as (select snapshot_id, match_id, line_id, total, o, string_agg(score, ' / ' order by first_at, score) selection, count(*) n from"
    " (select snapshot_id, match_id, line_id, total, o, score, min((update_at, odds)) first_at from {0} where pool = 'CRS' group by all) group by all having count(*) >= 2)"
)
_TABLE = (
    "score_table as (select snapshot_id, match_id, pool, line_id, max_by(o, (update_at, odds)) filter (score = '0:0') s00, max_by(o, (update_at, odds)) filter (score = '1:0') s10,"
    " max_by(o, (update_at, odds)) filter (score = '0:1') s01, max_by(o, (update_at, odds)) filter (score = '1:1') s11 from {0} group by all)"
)


@query(
    "a10_equal_odds_by_total",
    f"{POOL}, {_SCORES}, {_EQUAL.format('scores')} select snapshot_id, match_id, line_id, 'CRS_SAME_TOTAL_' || total || '_ODDS_' || o as \"rule\", selection, o odds, total total_goals, n score_count from equal_total",
)
def equal_total(spark, sf):
    return P.equal_odds_by_total(sel(spark, sf), ORDER).select("snapshot_id", "match_id", "line_id", "rule", "selection", "odds", "total_goals", "score_count")


_HALF = (
    "half_pairs as (select snapshot_id, match_id, line_id, 'FCS_home_SAME_ODDS_00_10_' || s00 as \"rule\", '0:0 / 1:0' selection, s00 odds from score_table where pool = 'FCS' and s00 = s10"
    " union all select snapshot_id, match_id, line_id, 'FCS_away_SAME_ODDS_00_01_' || s00, '0:0 / 0:1', s00 from score_table where pool = 'FCS' and s00 = s01)"
)


@query("a11_half_score_pairs", f"{POOL}, {_SCORES}, {_TABLE.format('scores')}, {_HALF} select * from half_pairs")
def half_pairs(spark, sf):
    return P.half_score_pairs(sel(spark, sf), ORDER).select("snapshot_id", "match_id", "line_id", "rule", "selection", "odds")


_PAIRS = "pairs as (select snapshot_id, match_id, pool, line_id, pool || '_PAIR_10_11_ODDS_' || s10 as \"rule\", '1:0 / 1:1' selection, s10 odds from score_table where s10 = s11)"


@query("a12_score_pairs", f"{POOL}, {_SCORES}, {_TABLE.format('scores')}, {_PAIRS} select * from pairs")
def pairs(spark, sf):
    return P.score_pairs(sel(spark, sf), order=ORDER).select("snapshot_id", "match_id", "pool", "line_id", "rule", "selection", "odds")


_CROSS = (
    "full_half as (select f.snapshot_id, f.match_id, f.score, f.o from (select distinct snapshot_id, match_id, score, o from {0} where pool = 'CRS') f"
    " join (select distinct snapshot_id, match_id, score, o from {0} where pool = 'FCS') h on h.snapshot_id is not distinct from f.snapshot_id and h.match_id = f.match_id and h.score = f.score and h.o = f.o)"
)


@query(
    "j10_full_half_equal_scores",
    f"{POOL}, {_SCORES}, {_CROSS.format('scores')} select snapshot_id, match_id, 'CRS_FCS_SAME_SCORE_' || replace(score, ':', '') || '_ODDS_' || o as \"rule\","
    " '全場 ' || score || ' | 半場 ' || score selection, o odds from full_half",
)
def full_half(spark, sf):
    return P.full_half_equal_scores(sel(spark, sf)).select("snapshot_id", "match_id", "rule", "selection", "odds")


_WIN = f"wscores as (select * from scores where {_IN_WINDOW})"


@query(
    "p4_scan_equal_scores",
    f"{POOL}, {_SCORES}, {_WIN}, {_EQUAL.format('wscores')}, {_TABLE.format('wscores')}, {_HALF}, {_PAIRS}, {_CROSS.format('wscores')}"
    " select snapshot_id, match_id, 'CRS_SAME_TOTAL_' || total || '_ODDS_' || o as \"rule\", selection, o odds, 'crs' source from equal_total"
    " union all select snapshot_id, match_id, \"rule\", selection, odds, 'fcs' from half_pairs union all select snapshot_id, match_id, \"rule\", selection, odds, lower(pool) from pairs"
    " union all select snapshot_id, match_id, 'CRS_FCS_SAME_SCORE_' || replace(score, ':', '') || '_ODDS_' || o, '全場 ' || score || ' | 半場 ' || score, o, 'crs_fcs' from full_half",
)
def equal_scores(spark, sf):
    return P.scan_equal_scores(sel(spark, sf), now(), HOURS, ORDER).select("snapshot_id", "match_id", "rule", "selection", "odds", "source")


@query(
    "w5_dedupe_hits",
    f"{POOL}, {_VARIED}, {_PRICE.format('varied')} select distinct snapshot_id, match_id, pool, \"rule\", line_id, odds, selection from price",
)
def deduped(spark, sf):
    return P.dedupe_hits(P.scan_price_rules(varied(spark, sf))).select("snapshot_id", "match_id", "pool", "rule", "line_id", "odds", "selection")


_SOURCED = (
    "sourced as (select *, case when extract(year from update_at) % 3 = 0 then 'inplay_all' when pool = 'FCS' then 'fcs' else 'crs' end source,"
    " extract(year from update_at) source_rank from sel where pool in ('CRS', 'FCS'))"
)


@query(
    "w6_prefer_pool_source",
    f"{POOL}, {_SOURCED}, best as (select snapshot_id, match_id, pool, min_by(source, (case when pool = 'CRS' and source <> 'crs' then 1 else 0 end, source_rank)) source from sourced group by all)"
    " select snapshot_id, match_id, pool, source, count(*) n_rows from sourced s where exists (select 1 from best b where b.snapshot_id is not distinct from s.snapshot_id and b.match_id = s.match_id and b.pool = s.pool and b.source = s.source) group by all",
)
def preferred(spark, sf):
    year = F.year("update_at")
    rows = sel(spark, sf).where("pool in ('CRS', 'FCS')").withColumns(
        {
            "source": F.when(year % 3 == 0, "inplay_all").when(F.col("pool") == "FCS", "fcs").otherwise("crs"),
            "source_rank": year,
        }
    )
    return P.prefer_pool_source(rows).groupBy("snapshot_id", "match_id", "pool", "source").agg(F.count(F.lit(1)).alias("n_rows"))


@query(
    "w7_first_pool_candidates",
    f"{POOL}, {_SOURCED} select distinct match_id, source, case source when 'fcs' then 'FCS' else 'CRS' end target_pool from sourced"
    " where case source when 'fcs' then 'FCS' else 'CRS' end = pool",
)
def candidates(spark, sf):
    year = F.year("update_at")
    rows = sel(spark, sf).where("pool in ('CRS', 'FCS')").select(
        "match_id",
        F.when(year % 3 == 0, "inplay_all").when(F.col("pool") == "FCS", "fcs").otherwise("crs").alias("source"),
        F.array("pool").alias("selling_pools"),
        F.lit(None).cast("array<string>").alias("normal_pools"),
    )
    return P.first_pool_candidates(rows).select("match_id", "source", "target_pool")


@query(
    "x5_pool_quotes",
    f"{POOL}, lines as (select snapshot_id, match_id, case line_id when '0' then 'HDC' else 'HIL' end pool, line_id,"
    " min_by(odds, (update_at, odds)) filter (sel = 'H' and comb_status = 'AVAILABLE') a,"
    " min_by(odds, (update_at, odds)) filter (sel = case line_id when '0' then 'A' else 'D' end and comb_status = 'AVAILABLE') b, max(update_at) filter (comb_status = 'AVAILABLE') changed_at"
    " from sel where pool = 'HAD' and upper(pool_status) not in ('', 'SUSPENDED') group by all) select snapshot_id, match_id, case pool when 'HDC' then 'asian' else 'over_under' end market,"
    " case pool when 'HDC' then 1.25 else 2.5 end cur_line, pool = 'HIL' is_multi_line, changed_at, cast(a - 1 as double) cur_a, cast(b - 1 as double) cur_b from lines where a > 1 and b > 1",
)
def pool_quotes(spark, sf):
    first = F.col("line_id") == "0"
    rows = sel(spark, sf).where("pool = 'HAD'").withColumns(
        {
            "pool": F.when(first, "HDC").otherwise("HIL"),
            "sel": F.when(~first & (F.col("sel") == "D"), "L").otherwise(F.col("sel")),
            "condition": F.when(first, "-1.0/-1.5").otherwise("2.5"),
            "main": F.when(first, True),
            "line_status": F.lit("AVAILABLE"),
            "sel_index": F.struct("update_at", "odds"),
        }
    )
    return P.pool_quotes(rows).select("snapshot_id", "match_id", "market", "cur_line", "is_multi_line", "changed_at", "cur_a", "cur_b")


@query(
    "a6_pool_hit_features",
    f"""{POOL}, {_VARIED}, {_PRICE.format('varied')}, {_three_way_sql('sel')}, hits as (select match_id, 'HAD' pool, "rule", odds from three
    union all select match_id, pool, "rule", odds from price), g as (select 'FB' || match_id match_id, count(*) hit_count, count(distinct pool) np, count(distinct "rule") nr,
    bool_or("rule" like 'HAD\\_%' escape '\\') had, bool_or("rule" in ('FHA_DRAW_1.76', 'HHA_DRAW_3.10')) draw,
    bool_or("rule" like 'HIL\\_%' escape '\\' or "rule" like 'FHL\\_%' escape '\\') tot from hits group by match_id),
    s as (select *, least(100, 25 + case when hit_count > 1 then least(20, hit_count * 6) else 0 end + case when np > 1 then least(18, np * 6) else 0 end
    + case when had then 15 else 0 end + case when draw then 10 else 0 end + case when tot then 8 else 0 end) conflict_score from g)
    select match_id, hit_count, np n_pools, nr n_rules, conflict_score,
    {rn("greatest(0.0::double, least(100.0::double, (35 + least(20, hit_count * 5) + least(16, np * 8) + least(14, nr * 4) + case when had then 12 else 0 end + case when tot then 6 else 0 end - greatest(0, conflict_score - 75) * 0.25)::double))", 1)} confidence_score,
    1 + (hit_count > 1)::int + (np > 1)::int + had::int + draw::int + tot::int flag_count from s""",
)
def hit_features(spark, sf):
    hits = P.scan_three_way(sel(spark, sf), ORDER).unionByName(P.scan_price_rules(varied(spark, sf)))
    return A.pool_hit_features(hits).select(
        "match_id", "hit_count", F.size("pools").alias("n_pools"), F.size("rules").alias("n_rules"), "conflict_score",
        "confidence_score", "flag_count",
    )


@query(
    "x2_norm_odds",
    f"with {ctes('fx_pool')} select pool, case when odds % 1 = 0 then cast(cast(odds as int) as varchar) else cast(odds as varchar) end raw, printf('%.2f', odds) norm, odds = 3 same, count(*) n_rows from fx_pool group by all",
)
def norm(spark, sf):
    raw = F.when(F.col("odds") % 1 == 0, F.col("odds").cast("int").cast("string")).otherwise(F.col("odds").cast("string"))
    rows = fx(spark, sf, "fx_pool").withColumn("raw", raw)
    return rows.groupBy("pool", "raw", X.norm_odds(F.col("raw")).alias("norm"), X.same_odds(F.col("raw"), F.lit("3")).alias("same")).agg(
        F.count(F.lit(1)).alias("n_rows")
    )


@query(
    "x3_hk_odds",
    f"with {ctes('fx_pool')} select pool, cast(odds as double) odds, cast(odds - 1 as double) hk, cast(odds as double) back, count(*) n_rows from fx_pool group by all",
)
def hk(spark, sf):
    net = X.hk_odds(F.col("odds"))
    return fx(spark, sf, "fx_pool").groupBy(
        "pool", F.col("odds").cast("double").alias("odds"), net.cast("double").alias("hk"), X.decimal_odds(net).cast("double").alias("back")
    ).agg(F.count(F.lit(1)).alias("n_rows"))


@query(
    "x4_line_value",
    "select l_orderkey, l_linenumber, l_partkey, (cast(l_quantity as int) % 5 + cast(l_quantity as int) % 7) / 2.0 line_value from lineitem where l_linenumber <> 3",
)
def line_values(spark, sf):
    q = F.col("l_quantity").cast("int")
    text = F.concat((q % 5).cast("string"), F.lit(".0/"), F.when(F.col("l_linenumber") == 3, F.lit("x")).otherwise((q % 7).cast("string")))
    rows = spark.read.parquet(f"{sf}/lineitem.parquet").withColumn("line_value", X.line_value(text))
    return rows.where("line_value is not null").select("l_orderkey", "l_linenumber", "l_partkey", "line_value")


@query(
    "x16_parse_score",
    f"{POOL}, {_SCORES} select match_id, pool, score, total, count(*) n_rows from scores group by all",
)
def scores(spark, sf):
    return P.correct_scores(sel(spark, sf)).groupBy("match_id", "pool", "score", "total").agg(F.count(F.lit(1)).alias("n_rows"))


@query(
    "x24_source_page",
    f"with {ctes('fx_pool')} select pool, lower(pool) source_page, count(*) n_rows from fx_pool group by all",
)
def pages(spark, sf):
    rows = fx(spark, sf, "fx_pool").withColumn("source_page", X.source_page(F.col("pool")))
    return rows.groupBy("pool", "source_page").agg(F.count(F.lit(1)).alias("n_rows"))


@query(
    "x24_section_label",
    f"""with {ctes('fx_quotes')} select case when market = 'asian' then 'asian' when market = 'over_under' then 'overUnder' else '' end
    || case when market = 'europe' then 'europe' when period = 'half' then 'Half' else 'Full' end as section,
    case market when 'asian' then '亞盤 ' when 'over_under' then '大小 ' else '歐洲賠率' end || case when market = 'europe' then '' when period = 'half' then '半場' else '全場' end as section_label,
    count(*) n_rows from fx_quotes group by all""",
)
def sections(spark, sf):
    m, p = F.col("market"), F.col("period")
    rows = fx(spark, sf, "fx_quotes").select(X.section_key(m, p).alias("section"), X.section_label(m, p).alias("section_label"))
    return rows.groupBy("section", "section_label").agg(F.count(F.lit(1)).alias("n_rows"))


@query(
    "p1_latest_snapshot",
    f"{POOL}, newest as (select match_id, max(snapshot_id) s from sel group by 1) select sel.match_id, snapshot_id, count(*) n_rows from sel join newest n on n.match_id = sel.match_id and n.s = snapshot_id group by all",
)
def newest_capture(spark, sf):
    return P.latest_snapshot(sel(spark, sf)).groupBy("match_id", "snapshot_id").agg(F.count(F.lit(1)).alias("n_rows"))
