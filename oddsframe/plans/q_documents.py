"""Queries of the document, audit, cache and signal operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from oddsframe.operators import audit as A
from oddsframe.operators import cache as K
from oddsframe.operators import documents as D
from oddsframe.operators import pools as P
from oddsframe.operators import quotes as Q
from oddsframe.operators import signals as G
from oddsframe.plans.fx import ctes, fx
from oddsframe.plans.q_pools import POOL, _PRICE, _VARIED, varied
from oddsframe.plans.q_quotes import quotes
from oddsframe.plans.registry import query
from oddsframe.plans.sqltext import KEYED, mean, rn

# One payload per ten matches: about 200 rows each here, in parts of 120.
BUDGET = 120
ROW_ORDER = ["match_no", "bucket_no", "changed_at", "tie_break", "company_id", "ini_a", "cur_a"]
_ROWS = (
    f"with {ctes('fx_quotes')}, {KEYED}, r as (select *, cast(match_id as bigint) match_no, cast(match_id as bigint) // 10 payload_id,"
    " case when market = 'asian' and period = 'full' then 1 when market = 'asian' then 2 when market = 'over_under' and period = 'full' then 3 when market = 'over_under' then 4 else 5 end bucket_no,"
    " row_number() over (partition by cast(match_id as bigint) // 10 order by cast(match_id as bigint), case when market = 'asian' and period = 'full' then 1 when market = 'asian' then 2"
    " when market = 'over_under' and period = 'full' then 3 when market = 'over_under' then 4 else 5 end, changed_at, tie_break, company_id, ini_a, cur_a) row_no from keyed),"
    f" kept as (select *, (row_no - 1) // {BUDGET} payload_no from r)"
)
_COUNTS = ", ".join(f"count(*) filter (bucket_no = {i}) n{i}" for i in range(1, 6))
_DOCS = (
    f"{_ROWS}, docs as (select payload_id, payload_no, match_id, min(row_no) first_row, {_COUNTS}, string_agg(company_id, ',' order by row_no) filter (bucket_no = 3) books from kept group by all)"
)
_WHOLE = _DOCS.replace(f"(row_no - 1) // {BUDGET} payload_no", "0 payload_no")
_MISSING = "concat_ws('、', case when n1 = 0 then '亞盤 全場' end, case when n2 = 0 then '亞盤 半場' end, case when n3 = 0 then '大小 全場' end, case when n4 = 0 then '大小 半場' end, case when n5 = 0 then '歐洲賠率' end)"
_COMPLETE = "((n1 > 0)::int + (n2 > 0)::int + (n3 > 0)::int + (n4 > 0)::int + (n5 > 0)::int)"


def rows(spark, sf):
    q = Q.identify_bookmaker(quotes(spark, sf))
    bucket = (
        F.when((F.col("market") == "asian") & (F.col("period") == "full"), 1).when(F.col("market") == "asian", 2)
        .when((F.col("market") == "over_under") & (F.col("period") == "full"), 3).when(F.col("market") == "over_under", 4).otherwise(5)
    )
    number = F.col("match_id").cast("long")
    return q.withColumns({"match_no": number, "payload_id": F.floor(number / 10), "bucket_no": bucket, "league": F.lit("L"), "home": F.concat(F.lit("H"), "match_id"), "away": F.lit("")})


def docs(spark, sf):
    return D.match_documents(rows(spark, sf), ["payload_id"], ROW_ORDER, BUDGET)


@query(
    "a17_match_documents",
    f"{_DOCS} select payload_id, payload_no, match_id, first_row, n1 asian_full, n2 asian_half, n3 over_under_full, n4 over_under_half, n5 europe, {_COMPLETE} complete_market_count, {_MISSING} missing_markets, coalesce(books, '') books from docs",
)
def documents(spark, sf):
    c = F.col
    return docs(spark, sf).select(
        "payload_id", "payload_no", "match_id", "first_row", c("market_counts.asianFull").alias("asian_full"), c("market_counts.asianHalf").alias("asian_half"),
        c("market_counts.overUnderFull").alias("over_under_full"), c("market_counts.overUnderHalf").alias("over_under_half"), c("market_counts.europe").alias("europe"),
        "complete_market_count", F.array_join("missing_markets", "、").alias("missing_markets"),
        F.array_join(F.transform("markets.overUnderFull", lambda r: r["company_id"]), ",").alias("books"),
    )


@query(
    "a17_payload_summary",
    f"{_ROWS} select payload_id, count(*) original_rows, (count(*) + {BUDGET} - 1) // {BUDGET} payloads, count(*) > {BUDGET} split from r group by payload_id",
)
def payloads(spark, sf):
    return D.payload_summary(rows(spark, sf), ["payload_id"], BUDGET)


@query(
    "a18_per_match_chunks",
    f"{_DOCS} select payload_id, payload_no, match_id, row_number() over (partition by payload_id, payload_no order by first_row) chunk_index, count(*) over (partition by payload_id, payload_no) chunk_total, 'L · H' || match_id match_title from docs",
)
def chunks(spark, sf):
    return D.per_match_chunks(docs(spark, sf), ["payload_id"]).select("payload_id", "payload_no", "match_id", "chunk_index", "chunk_total", "match_title")


@query(
    "a18_pool_chunks",
    f"{POOL}, {_VARIED}, {_PRICE.format('varied')}, p as (select *, cast(match_id as bigint) // 50 payload_id, case when cast(match_id as bigint) % 2 = 0 then front_end_id else match_id end chunk_id, row_number() over (partition by cast(match_id as bigint) // 50 order by cast(match_id as bigint), pool, line_id, \"rule\", selection) row_no from price),"
    " g as (select payload_id, (row_no - 1) // 100 payload_no, chunk_id, count(*) n_rows, min(row_no) m from p group by all) select payload_id, payload_no, chunk_id, n_rows, row_number() over (partition by payload_id, payload_no order by m) chunk_index, count(*) over (partition by payload_id, payload_no) chunk_total from g",
)
def pool_chunks(spark, sf):
    number = F.col("match_id").cast("long")
    hits = P.scan_price_rules(varied(spark, sf)).withColumns({"number": number, "payload_id": F.floor(number / 50)})
    hits = hits.withColumn("front_end_id", F.when(number % 2 == 0, F.col("front_end_id")))
    out = D.pool_chunks(hits, ["payload_id"], ["number", "pool", "line_id", "rule", "selection"], 100)
    return out.select("payload_id", "payload_no", "chunk_id", F.size("rows").alias("n_rows"), "chunk_index", "chunk_total")


def inputs(spark, sf):
    d = D.match_documents(rows(spark, sf), ["payload_id"], ROW_ORDER).withColumn("state", F.when(F.col("match_id").cast("long") % 3 == 0, F.lit("下半場")).otherwise(F.lit("未開")))
    ids = fx(spark, sf, "fx_matches").select("match_id", "source_index")
    players = ids.where("source_index % 2 = 0").select("match_id", F.explode(F.sequence(F.lit(0), F.lit(12))).alias("k"))
    players = players.select(
        "match_id", F.lit(0).alias("team_pos"), F.lit("T").alias("team"), F.lit("4-4-2").alias("formation"), F.lit("C").alias("coach"),
        F.when(F.col("k") < 11, "start").otherwise("substitute").alias("role"), F.col("k").alias("pos"),
        F.when(F.col("k") == 12, "P0").otherwise(F.concat(F.lit("P"), "k")).alias("name"), F.col("k").cast("string").alias("number"), F.lit("M").alias("position"),
    )
    hurt = ids.where("source_index % 5 = 0").select("match_id", F.array(F.struct(F.lit("X").alias("player"))).alias("injuries"))
    return D.single_match_input(d, D.squad(players), hurt)


_INPUT = (
    f"{_WHOLE}, ids as (select cast(o_orderkey as varchar) match_id, o_orderkey k from orders where o_custkey % 40 <> o_orderkey % 40),"
    " inp as (select d.*, cast(d.match_id as bigint) % 3 = 0 live, case when i.k % 2 = 0 then 12 else 0 end squad, case when i.k % 2 = 0 then 11 else 0 end xi, case when i.k % 5 = 0 then 1 else 0 end hurt from docs d left join ids i using (match_id))"
)


@query(
    "a24_single_match_input",
    f"{_INPUT} select match_id, n5 n_open, n5 n_live, n1 + n2 n_asian, n3 + n4 n_totals, case when n1 > 0 then 'full' when n2 > 0 then 'half' else '' end first_period, squad, xi, hurt, live in_play_flag, 'H' || match_id home_team from inp",
)
def match_input(spark, sf):
    size = lambda c: F.coalesce(F.size(c), F.lit(0))
    return inputs(spark, sf).select(
        "match_id", F.size("odds_1x2_open").alias("n_open"), F.size("odds_1x2_live").alias("n_live"), F.size("asian_handicap_series").alias("n_asian"),
        F.size("totals_ou_series").alias("n_totals"), F.coalesce(F.try_element_at("asian_handicap_series", F.lit(1))["period"], F.lit("")).alias("first_period"),
        size("full_squad_list").alias("squad"), F.coalesce(F.size(F.try_element_at("probable_xi", F.lit(1))["start_xi"]), F.lit(0)).alias("xi"),
        size("injuries_suspensions").alias("hurt"), "in_play_flag", F.col("match_meta.home_team").alias("home_team"),
    )


@query(
    "a25_input_audit",
    f"{_INPUT} select match_id, 19 n_fields, 2 + 7 + 1 + (squad = 0)::int + (hurt = 0)::int + (n5 = 0)::int + (n1 + n2 = 0)::int + (n3 + n4 = 0)::int n_missing, 7 + (squad = 0)::int + (hurt = 0)::int n_critical,"
    " case when n5 > 0 then 'derived' else 'missing' end price_status from inp",
)
def audit(spark, sf):
    out = D.input_audit(inputs(spark, sf))
    price = F.filter("input_audit", lambda a: a["field"] == "odds_1x2_open/live")[0]["status"]
    return out.select(
        "match_id", F.size("input_audit").alias("n_fields"), F.size("missing_fields").alias("n_missing"), F.size("critical_missing").alias("n_critical"), price.alias("price_status")
    )


@query(
    "q5_market_completeness_gate",
    f"{_INPUT} select match_id, {_COMPLETE} <= 3 raise_risk, case when hurt = 0 then 60 else 100 end confidence_cap from inp",
)
def gate(spark, sf):
    d = inputs(spark, sf).withColumns({"has_injuries": F.coalesce(F.size("injuries_suspensions"), F.lit(0)) > 0, "has_lineups": F.coalesce(F.size("full_squad_list"), F.lit(0)) > 0})
    return G.market_completeness_gate(d).select("match_id", "raise_risk", "confidence_cap")


_FENCED = "regexp_extract(\"text\", '```json (.*?) ```', 1)"
OUTPUTS = f"with {ctes('fx_outputs')}, o as (select *, nullif({_FENCED}, '') j from fx_outputs)"


def outputs(spark, sf):
    return fx(spark, sf, "fx_outputs")


@query("a23_extract_structured", f"{OUTPUTS} select id, coalesce(j, '') structured from o")
def structured(spark, sf):
    out = A.extract_structured(outputs(spark, sf))
    return out.select("id", F.coalesce("structured", F.lit("")).alias("structured"))


@query(
    "a23_extract_unfenced",
    f"{OUTPUTS} select id, case when j is null then '{{\"top10\":[1]}}' else j end structured from o",
)
def unfenced(spark, sf):
    loose = F.regexp_replace(F.regexp_replace("text", "```json ", 'see {"a": 1} then '), " ```", " {broken")
    rows_ = outputs(spark, sf).withColumn("text", F.when(F.contains("text", F.lit("```")), loose).otherwise(F.lit('{"b":{"c":"}"}} or {"top10":[1]} end')))
    return A.extract_structured(rows_).select("id", "structured")


_SINGLE = "'match_meta,input_audit,source_audit,pitch_reality,market_truth,convergence,corner_matrix,anomaly_flags,charts,missing_fields,singleMatch'"


@query(
    "a22_validate_outputs",
    f"""{OUTPUTS}, c as (select id, workflow, j, j is null bad, workflow = 'single_match_deep_analysis' single, j like '%"schemaVersion":"odds-analysis-v1"%' v, j like '%"match_meta"%' meta, j like '%"recommendation"%' rec,
    j like '%"top10":[{{%' filled, j like '%"dataQuality"%' dq, j like '%"top3Candidates"%' t3 from o)
    select id, case when bad then 'error' when single then 'warn' when not filled then 'error' when v and dq and t3 then 'ok' else 'warn' end "level",
    cast(case when bad then 0 when single then floor((v::int + meta::int + 2 * rec::int + 0.5 * (14 - (v::int + meta::int + 2 * rec::int))) / 14.0 * 100 + 0.5)
      else floor((v::int + 0.5 * (1 - v::int) + filled::int + dq::int + 0.5 * (1 - dq::int) + t3::int + 0.5 * (1 - t3::int)) / 4.0 * 100 + 0.5) end as int) validation_score,
    case when bad then 1 when single then 13 - meta::int - 2 * rec::int else 3 - filled::int - dq::int - t3::int end n_missing from c""",
)
def validated(spark, sf):
    out = A.validate_outputs(A.extract_structured(outputs(spark, sf)))
    return out.select("id", "level", "validation_score", F.size("missing").alias("n_missing"))


@query(
    "a19_chunk_result_summary",
    f"""{OUTPUTS} select id, case when j like '%"confidenceScore":80%' then 80.0 end confidence_score, case when j like '%"recommendation":"observe"%' then 'observe' else '' end recommended_bet, "text" summary, id % 7 <> 0 ok from o""",
)
def result_summary(spark, sf):
    out = A.extract_structured(outputs(spark, sf)).withColumn("error", F.when(F.col("id") % 7 == 0, F.lit("timeout")))
    return A.chunk_result_summary(out).select("id", "confidence_score", "recommended_bet", "summary", "ok")


@query("a19_combine_counts", f"{OUTPUTS} select count(*) total_chunks, count(*) filter (id % 7 <> 0) success_count, count(*) filter (id % 7 = 0) failed_count from o")
def combined(spark, sf):
    out = A.extract_structured(outputs(spark, sf)).withColumn("error", F.when(F.col("id") % 7 == 0, F.lit("timeout")))
    return A.combine_counts(A.chunk_result_summary(out))


@query("a20_hit_rate", f"with {ctes('fx_outcomes')} select workflow, count(*) total, count(*) filter (result = 'hit') hits, count(*) filter (result = 'miss') misses, count(*) filter (result = 'hit')::double / count(*) hit_share from fx_outcomes group by workflow")
def hit_rate(spark, sf):
    return A.hit_rate(fx(spark, sf, "fx_outcomes"), ["workflow"])


@query("a20_latest_outcomes", f"with {ctes('fx_outcomes')} select id, created_at, result from fx_outcomes order by created_at desc, id desc limit 5")
def latest_outcomes(spark, sf):
    return A.latest_outcomes(fx(spark, sf, "fx_outcomes")).select("id", "created_at", "result")


_PROBE = f"""with {ctes('fx_probe')}, s as (select event_id, case when error like '%TLS%' then 'error' when error is not null then 'error'
    when body like '%please enable cookies%' then case when status_code >= 400 then 'error' else 'warn' end when status_code in (403, 429, 404) then 'error' when status_code = 503 then 'warn' when status_code = 302 then 'warn'
    when trim(body) = '' then 'warn' else 'ok' end state, case when error like '%TLS%' then 'tls' when error is not null then 'timeout' when body like '%please enable cookies%' then 'blocked' when status_code = 403 then 'http_403'
    when status_code = 429 then 'http_429' when status_code = 404 then 'http_4xx' when status_code = 503 then 'http_5xx' when status_code = 302 then 'http_3xx' when trim(body) = '' then 'empty' else 'ok' end diagnosis from fx_probe)"""


@query("a21_probe_status", f"{_PROBE} select * from s")
def probes(spark, sf):
    return A.probe_status(fx(spark, sf, "fx_probe")).select("event_id", "state", "diagnosis")


@query("a21_probe_summary", f"{_PROBE} select count(*) filter (state = 'ok') ok_count, count(*) filter (state = 'warn') warn_count, count(*) filter (state = 'error') error_count, case when count(*) filter (state = 'error') > 0 then 'error' when count(*) filter (state = 'warn') > 0 then 'warn' else 'ok' end overall from s")
def probe_summary(spark, sf):
    return A.probe_summary(A.probe_status(fx(spark, sf, "fx_probe")))


@query("a21_list_page_meta", "select o_orderkey page_id, 1 match_count, cast(o_orderkey as varchar) first_match_id, o_orderpriority first_league, 'H' || o_custkey % 40 first_home from orders")
def list_meta(spark, sf):
    return A.list_page_meta(fx(spark, sf, "fx_live_script")).select("page_id", "match_count", "first_match_id", "first_league", "first_home")


CACHE_NOW = "1999-01-01 00:00:00"
_LATEST = "l as (select match_id, source_index, saved_at, result, saved_at + to_hours(20000) expires_at from fx_cache qualify row_number() over (partition by match_id order by saved_at desc, source_index desc) = 1)"


def cache_now():
    return F.lit(CACHE_NOW).cast("timestamp_ntz")


@query(
    "t2_cache_upsert",
    f"with {ctes('fx_cache')}, {_LATEST} select match_id, saved_at, result from l where expires_at > timestamp '{CACHE_NOW}'",
)
def upsert(spark, sf):
    c = fx(spark, sf, "fx_cache")
    out = K.cache_upsert(c.where("source_index % 2 = 0"), c.where("source_index % 2 = 1"), cache_now(), 20000)
    return out.select("match_id", "saved_at", "result")


@query(
    "l5_cache_listing",
    f"with {ctes('fx_cache')}, {_LATEST} select match_id, saved_at, expires_at from l where expires_at > timestamp '{CACHE_NOW}'",
)
def listing(spark, sf):
    entries = K.latest_results(fx(spark, sf, "fx_cache"), ttl_hours=20000)
    return K.cache_listing(entries, cache_now()).select("match_id", "saved_at", "expires_at")


@query("l5_cache_stats", f"with {ctes('fx_cache')}, {_LATEST} select count(*) entries, max(saved_at) updated_at, 20000.0 ttl_hours from l where expires_at > timestamp '{CACHE_NOW}'")
def stats(spark, sf):
    return K.cache_stats(K.latest_results(fx(spark, sf, "fx_cache"), ttl_hours=20000), cache_now(), 20000)


@query(
    "t6_stale_flag",
    f"with {ctes('fx_support')} select match_id, kickoff_ts < timestamp '2024-01-10 00:00:00' - interval 6 hour stale, greatest(asian_home_percent, asian_away_percent, over_percent, under_percent) >= 80 hot from fx_support",
)
def stale(spark, sf):
    snap = fx(spark, sf, "fx_support").withColumn("saved_at", F.col("kickoff_ts"))
    return K.stale_flag(snap, F.lit("2024-01-10").cast("timestamp_ntz"), 6, 80).select("match_id", "stale", "hot")


_OPEN, _NOW = ("ini_a", "ini_draw", "ini_b"), ("cur_a", "cur_draw", "cur_b")


def _fair(cols, i):
    ok = " and ".join(f"{c} <> 0" for c in cols)
    return f"case when market = 'europe' and {ok} then (1.0/{cols[i]}) / (1.0/{cols[0]} + 1.0/{cols[1]} + 1.0/{cols[2]}) end"


@query(
    "q1_favourite_drift",
    f"""with {ctes('fx_quotes')}, p as (select match_id, {mean(_fair(_OPEN, 0), 1_000_000_000)} oh, {mean(_fair(_OPEN, 2), 1_000_000_000)} oa, {mean(_fair(_NOW, 0), 1_000_000_000)} lh, {mean(_fair(_NOW, 2), 1_000_000_000)} la,
    median(cur_line) filter (market = 'asian' and period = 'full') line_latest, median(ini_line) filter (market = 'asian' and period = 'full') line_open from fx_quotes group by match_id),
    s as (select match_id, case when oh >= oa then 'home' else 'away' end favourite, {rn('case when oh >= oa then oh else oa end', 4)} share_open, {rn('case when oh >= oa then lh else la end', 4)} share_latest, line_open, line_latest from p where oh is not null and oa is not null)
    select *, coalesce(share_latest < share_open and abs(line_latest) >= 0.75 and abs(line_latest) >= abs(line_open), false) gravity_veto from s""",
)
def drift(spark, sf):
    return G.favourite_drift(quotes(spark, sf))


@query(
    "q2_totals_conflict",
    f"""with {ctes('fx_quotes')}, s as (select match_id, {rn(mean('cur_line - ini_line'), 4)} line_change, {rn(mean('cur_b'), 3)} under_avg from fx_quotes where market = 'over_under' and period = 'full' group by match_id)
    select *, coalesce(line_change < 0 and under_avg <= 0.82, false) low_goal_risk from s""",
)
def totals(spark, sf):
    return G.totals_conflict(quotes(spark, sf))


@query(
    "q3_outlier_book",
    f"""with {ctes('fx_quotes')}, b as (select match_id, market, period, company_id, {mean('abs(cur_a - ini_a)')} m from fx_quotes group by all), s as (select *, median(m) over (partition by match_id, market, period) md, count(*) over (partition by match_id, market, period) books from b)
    select match_id, market, period, company_id, {rn('m', 4)} move, {rn('md', 4)} median_move, books from s where m >= 0.2 and md <= 0.1 and books >= 3""",
)
def outliers(spark, sf):
    return G.outlier_book(quotes(spark, sf))


@query(
    "q4_series_quality",
    f"""with {ctes('fx_ticks')}, s as (select *, epoch_us(ts) - epoch_us(lag(ts) over (partition by match_id, bookmaker_key order by event_id)) step from fx_ticks)
    select match_id, bookmaker_key, count(*) ticks, count(*) filter (step > 3 * 3600000000) gaps, count(*) filter (step = 0) duplicates, count(*) filter (step < 0) as reversed, max(ts) last_ts, max(ts) < timestamp '2024-01-20 00:00:00' - interval 24 hour stale from s group by all""",
)
def quality(spark, sf):
    return G.series_quality(fx(spark, sf, "fx_ticks"), F.lit("2024-01-20").cast("timestamp_ntz"), gap_hours=3, block=1000)
