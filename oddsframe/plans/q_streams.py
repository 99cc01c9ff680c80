"""Queries of the streaming jobs, drained once over the driver files, and of the sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from oddsframe.functions import sqlfns
from oddsframe.operators import cache as K
from oddsframe.operators import history as H
from oddsframe.operators import pools as P
from oddsframe.operators import quotes as Q
from oddsframe.operators.pools import HIT_KEY
from oddsframe.plans.fx import ctes, fx, table
from oddsframe.plans.q_history import EVENT_ROWS, EVENTS
from oddsframe.plans.q_pools import POOL, _PRICE, _VARIED, varied
from oddsframe.plans.q_select import BATCH
from oddsframe.plans.registry import query
from oddsframe.plans.sqltext import KEYED
from oddsframe.session import checkpoint_root
from oddsframe.sources import pages, scripts, sinks
from oddsframe.streaming import keyed
from oddsframe.streaming import streams as T


def _folder(spark, name):
    return f"{checkpoint_root(spark)}/oddsframe/{name}-{uuid.uuid4().hex}"


def _stream(spark, sf, name):
    return T.read_stream(spark, f"{sf}/{name}*.parquet", table(spark, sf, name).schema)


def ticks(spark, sf):
    e = _stream(spark, sf, "events")
    return e.select("event_id", "ts", F.col("user_id").cast("string").alias("match_id"), F.col("event_type").alias("bookmaker_key"), F.col("value").alias("price"))


def _drained(spark, rows, partial, merge, name, schema):
    """A stream drained into partials, folded once, and read back."""
    out = _folder(spark, name)
    T.write_partials(rows, partial, f"{out}/data", f"{out}/state").awaitTermination()
    T.compact(spark, f"{out}/data", schema, merge)
    return merge(T.read_partials(spark, f"{out}/data", schema))


def _schema(spark, partial, rows):
    return partial(spark.createDataFrame([], rows.schema)).schema


_TICKS = f"with {ctes('fx_ticks')}"


@query(
    "t1_stream_latest_quote",
    f"{_TICKS} select match_id, bookmaker_key, ts, event_id, price from fx_ticks qualify row_number() over (partition by match_id, bookmaker_key order by ts desc, event_id desc) = 1",
)
def latest(spark, sf):
    rows = ticks(spark, sf)
    return _drained(spark, rows, T.latest_quotes, T.latest_quotes, "latest", _schema(spark, T.latest_quotes, rows))


@query(
    "t4_stream_open_close_move",
    f"{_TICKS}, s as (select match_id, bookmaker_key, arg_min(price, (ts, event_id)) open_price, arg_max(price, (ts, event_id)) latest_price, count(*) ticks from fx_ticks group by all) select *, abs(latest_price - open_price) as \"move\" from s",
)
def moves(spark, sf):
    rows = ticks(spark, sf)
    prices = _drained(spark, rows, T.open_close, T.merge_open_close, "moves", _schema(spark, T.open_close, rows))
    return T.with_move(prices).drop("open_at", "latest_at")


@query(
    "t4_keyed_price_changes",
    f"{_TICKS} select match_id, bookmaker_key, arg_min(event_id, (ts, event_id)) open_event, arg_min(price, (ts, event_id)) open_price, arg_max(event_id, (ts, event_id)) latest_event, arg_max(price, (ts, event_id)) latest_price, count(*) ticks from fx_ticks group by all",
)
def keyed_changes(spark, sf):
    """Values as the keyed state emitted them; the delay spans the whole table, so that no tick is too late."""
    out = _folder(spark, "keyed")
    T.write_partials(keyed.price_changes(ticks(spark, sf), "3650 days"), lambda batch: batch, f"{out}/data", f"{out}/state", mode="update").awaitTermination()
    return keyed.latest_values(T.read_partials(spark, f"{out}/data", keyed.MOVES)).select("match_id", "bookmaker_key", "open_event", "open_price", "latest_event", "latest_price", "ticks")


_HITS = (
    "select distinct cast(l_orderkey % 3 as varchar) match_id, cast(l_orderkey % 3 as varchar) front_end_id, cast(l_suppkey % 2 as varchar) pool, l_returnflag as \"rule\", cast(l_linenumber % 2 as varchar) line_id,"
    " cast(l_quantity as int) % 2 total_goals, '8.50' odds, l_linestatus selection, l_shipdate kickoff_ts from lineitem"
)


@query("t3_stream_dedupe_hits", _HITS)
def deduped(spark, sf):
    """Hits come again with every capture; the 9-field key lets one of each through."""
    rows = _stream(spark, sf, "lineitem")
    match = (F.col("l_orderkey") % 3).cast("string")
    hits = rows.select(
        match.alias("match_id"), match.alias("front_end_id"), (F.col("l_suppkey") % 2).cast("string").alias("pool"), F.col("l_returnflag").alias("rule"), (F.col("l_linenumber") % 2).cast("string").alias("line_id"),
        (F.col("l_quantity").cast("int") % 2).alias("total_goals"), F.lit("8.50").alias("odds"), F.col("l_linestatus").alias("selection"), F.col("l_shipdate").alias("kickoff_ts"),
    )
    once = T.stream_dedupe_hits(hits, HIT_KEY, "kickoff_ts").select(*HIT_KEY)
    out = _folder(spark, "dedupe")
    writer = once.writeStream.format("parquet").option("checkpointLocation", f"{out}/state").trigger(availableNow=True)
    writer.start(f"{out}/data").awaitTermination()
    found = spark.read.schema(once.schema).parquet(f"{out}/data")
    return found.withColumn("kickoff_ts", F.col("kickoff_ts").cast(dict(hits.dtypes)["kickoff_ts"]))


@query(
    "t5_stream_progress",
    f"""{BATCH} select count(*) total, count(*) filter (ok or error like 'HTTP 404%') ok_count, count(*) filter (not ok and error = 'timeout') error_count,
    count(*) filter (coalesce(error like 'HTTP 404%', false)) no_data_count, cast(sum(hits) as bigint) hit_count, count(distinct match_id) filter (hits > 0) match_hit_count,
    cast(ceil(count(*) / 25.0) as bigint) batch_count from r""",
)
def progress(spark, sf):
    o = _stream(spark, sf, "orders")
    i = F.col("o_orderkey")
    results = o.select(
        (i % 2000).cast("string").alias("match_id"), (i % 5 != 0).alias("ok"),
        F.when(i % 10 == 0, "HTTP 404 at page").when(i % 5 == 0, "timeout").alias("error"),
        F.when(i % 5 != 0, (F.col("o_custkey") % 5).cast("int")).otherwise(F.lit(0)).alias("hits"),
    )
    return T.progress(_drained(spark, results, T.match_counts, T.merge_counts, "progress", _schema(spark, T.match_counts, results)))


_UPSERT = (
    f"with {ctes('fx_cache')}, l as (select match_id, saved_at, result, saved_at + to_hours(20000) expires_at from fx_cache qualify row_number() over (partition by match_id order by saved_at desc, source_index desc) = 1)"
    " select * from l where expires_at > timestamp '1999-01-01 00:00:00'"
)


CACHE_NOW = "1999-01-01"


def _cached(spark, sf):
    return _stream(spark, sf, "orders").select(
        (F.col("o_orderkey") % 4000).cast("string").alias("match_id"), F.col("o_orderkey").alias("source_index"),
        F.col("o_orderdate").alias("saved_at"), F.col("o_totalprice").alias("result"),
    )


@query("t2_stream_cache_upsert", _UPSERT)
def cache(spark, sf):
    results, out, now = _cached(spark, sf), _folder(spark, "cache"), F.lit(CACHE_NOW).cast("timestamp_ntz")
    T.stream_cache_upsert(results, f"{out}/data", f"{out}/state", 20000).awaitTermination()
    schema = StructType(results.schema.fields).add("expires_at", "timestamp_ntz")
    return T.read_cache(spark, f"{out}/data", schema, now).select("match_id", "saved_at", "result", "expires_at")


@query("k3_upsert_extract_cache", _UPSERT)
def stored_cache(spark, sf):
    """The cache table as it is stored: half of the results folded in, then the other half."""
    out, now = _folder(spark, "store"), F.lit(CACHE_NOW).cast("timestamp_ntz")
    schema = StructType(_cached(spark, sf).schema.fields).add("expires_at", "timestamp_ntz")
    for parity in (0, 1):
        batch = table(spark, sf, "orders").where(F.col("o_orderkey") % 2 == parity)
        rows = K.latest_results(batch.select(
            (F.col("o_orderkey") % 4000).cast("string").alias("match_id"), F.col("o_orderkey").alias("source_index"), F.col("o_orderdate").alias("saved_at"), F.col("o_totalprice").alias("result"),
        ), ttl_hours=20000)
        rows.select(*schema.names).write.parquet(f"{out}/batch_id={parity}")
        T.compact_cache(spark, out, schema, now)
    return T.read_partials(spark, out, schema).select("match_id", "saved_at", "result", "expires_at")


@query(
    "s1_read_raw_pages",
    "select page_id, url, 200 status_code, md5(html) body_hash from pages",
)
def raw_pages(spark, sf):
    """Captures landed in the raw-page layout and read back as a stream of files, drained once."""
    src = table(spark, sf, "pages")
    path = _folder(spark, "pages")
    landed = src.select(
        F.lit("site").alias("source"), F.col("page_id").cast("string").alias("match_id"), F.lit("").alias("market"), F.lit("").alias("period"),
        "url", F.lit("2026-04-19 10:00:00").cast("timestamp").alias("fetched_at"), F.lit(200).alias("status_code"),
        F.lit("text/html; charset=utf-8").alias("content_type"), F.lit(False).alias("incomplete"), F.encode("html", "UTF-8").alias("body"),
    )
    landed.write.parquet(f"{path}/in")
    text = pages.decode_pages(pages.read_raw_pages(spark, f"{path}/in", streaming=True))
    rows = text.select(F.col("match_id").cast("long").alias("page_id"), "url", "status_code", F.md5("text").alias("body_hash"))
    T.write_partials(rows, lambda batch: batch, f"{path}/data", f"{path}/state").awaitTermination()
    return T.read_partials(spark, f"{path}/data", rows.schema)


@query(
    "s1_read_page_files",
    """select s_suppkey page_id, case s_suppkey % 5 when 0 then 'error_page' when 1 then 'empty' when 2 then 'unparsed' end reason,
    case when s_suppkey % 5 > 2 then cast(s_suppkey as varchar) end match_id, case when s_suppkey % 5 > 2 then 'H' || s_nationkey end home from supplier""",
)
def page_files(spark, sf):
    """Script pages kept as files of their own, read as binary files; what can't be parsed goes to the dead letters."""
    path, k, i = _folder(spark, "files"), F.col("s_suppkey") % 5, F.col("s_suppkey").cast("string")
    fields = F.concat(i, F.lit("^c^L^L^^h^H"), F.col("s_nationkey").cast("string"), F.lit("^^a^A^^22:00^d^0^1^2"))
    script = F.concat(F.lit("A["), i, F.lit(']="'), fields, F.lit("\".split('^');"))
    made = F.when(k == 0, "<p>500 - Internal server error</p>").when(k == 1, " ").when(k == 2, "var A=[];").otherwise(script)
    pages.write_page_files(table(spark, sf, "supplier").select(F.col("s_suppkey").alias("page_id"), made.alias("value")), f"{path}/in", "page_id")
    files = pages.read_page_files(spark, f"{path}/in", "part-*").withColumn("content_type", F.lit(None).cast("string"))
    decoded = pages.decode_pages(files).select(F.col("page_id").cast("long").alias("page_id"), F.col("text").alias("body"))
    good, dead = pages.split_pages(pages.triage(decoded, scripts.is_live_list(F.col("body")), "body"), f"{path}/split")
    parsed = scripts.parse_live_list(good).select("page_id", F.lit(None).cast("string").alias("reason"), "match_id", "home")
    return parsed.unionByName(dead.select("page_id", "reason"), allowMissingColumns=True)


_AT = "2024-01-30 12:00:00"


@query(
    "t6_stream_stale",
    f"""with s as (select cast(user_id as varchar) match_id, ts, event_id from events where event_type <> 'error' qualify row_number() over (partition by user_id order by ts desc, event_id desc) = 1)
    select c_custkey request_id, s.event_id, s.ts saved_at, s.match_id is not null served, s.ts < timestamp '{_AT}' - interval 6 hour stale,
    coalesce(greatest(event_id % 101, 100 - event_id % 101) >= 80, false) hot from customer left join s on s.match_id = cast(c_custkey % 200 as varchar)""",
)
def served(spark, sf):
    """One stream keeps the last good capture of each match, another answers requests from it."""
    out, share = _folder(spark, "served"), (F.col("event_id") % 101).cast("int")
    captures = _stream(spark, sf, "events").select(
        F.col("user_id").cast("string").alias("match_id"), F.col("ts").alias("saved_at"), "event_id", (F.col("event_type") != "error").alias("ok"),
        share.alias("asian_home_percent"), (100 - share).alias("asian_away_percent"), share.alias("over_percent"), (100 - share).alias("under_percent"),
    )
    T.stream_last_good(captures, f"{out}/good", f"{out}/good-state").awaitTermination()
    requests = _stream(spark, sf, "customer").select(
        F.col("c_custkey").alias("request_id"), (F.col("c_custkey") % 200).cast("string").alias("match_id"), F.lit(_AT).cast("timestamp_ntz").alias("at")
    )
    T.stream_serve(requests, f"{out}/good", captures.schema, f"{out}/answers", f"{out}/state", 6, 80).awaitTermination()
    schema = "request_id long, event_id long, saved_at timestamp_ntz, served boolean, stale boolean, hot boolean"
    return T.read_partials(spark, f"{out}/answers", schema)


_EXPORT = f"with {ctes('fx_quotes', 'fx_matches')} select k.match_id \"matchId\", coalesce(league, '') league, coalesce(cast(kickoff_ts as varchar), '') \"kickoffTime\", coalesce(home, '') home, coalesce(away, '') away, market, case when market = 'europe' then 'full' else period end as \"period\", case when market <> 'europe' then case when is_multi_line then '1' else '0' end else '' end \"isMultiLine\", coalesce(cast(case when market = 'asian' then ini_a end as varchar), '') \"initialHomeOdds\", coalesce(cast(case when market = 'asian' then cur_line end as varchar), '') \"currentHandicapValue\", coalesce(cast(case when market = 'over_under' then cur_a end as varchar), '') \"currentOverOdds\", coalesce(cast(case when market = 'europe' then cur_draw end as varchar), '') \"currentDraw\", coalesce(case when market = 'europe' then cast(changed_at as varchar) end, '') \"changedAt\", company_id \"companyId\", case when market <> 'europe' then case when is_closed then '1' else '0' end else '' end \"isClosed\" from fx_quotes k left join fx_matches m on m.match_id = k.match_id"
_EXPORTED = [
    "matchId", "league", "kickoffTime", "home", "away", "market", "period", "companyId", "isClosed", "isMultiLine", "initialHomeOdds",
    "currentHandicapValue", "currentOverOdds", "currentDraw", "changedAt",
]


def flat(spark, sf):
    return Q.flatten_quotes(fx(spark, sf, "fx_quotes"), fx(spark, sf, "fx_matches"))


@query("k1_write_csv", _EXPORT)
def csv(spark, sf):
    path = _folder(spark, "csv")
    sinks.write_csv(flat(spark, sf), path)
    schema = ", ".join(f"`{c}` string" for c in sinks.HEADERS["flat"])
    back = spark.read.schema(schema).csv(path, header=True, escape='"')
    return back.select(*[F.coalesce(c, F.lit("")).alias(c) for c in _EXPORTED])


def _exported(spark, rows, kind, columns):
    """Rows written as CSV in the layout of a kind, and some of its columns read back."""
    path = _folder(spark, f"csv-{kind}")
    sinks.write_csv(rows, path, kind)
    schema = ", ".join(f"`{c}` string" for c in sinks.HEADERS[kind])
    back = spark.read.schema(schema).csv(path, header=True, escape='"')
    return back.select(*[F.coalesce(c, F.lit("")).alias(c) for c in columns])


@query(
    "k1_write_csv_pool",
    f"{POOL}, {_VARIED}, {_PRICE.format('varied')} select pool, \"rule\", front_end_id \"frontEndId\", match_id \"matchId\", cast(kickoff_ts as varchar) \"kickOffTime\", selection, odds, case when pool = 'EHL' then 'hil' else lower(pool) end \"sourcePage\", '' \"tournament\" from price",
)
def csv_pool(spark, sf):
    columns = ["pool", "rule", "frontEndId", "matchId", "kickOffTime", "selection", "odds", "sourcePage", "tournament"]
    return _exported(spark, P.scan_price_rules(varied(spark, sf)), "pool", columns)


@query(
    "k1_write_csv_probability",
    f"""{EVENTS} select match_id "matchId", cast(company_id as varchar) "companyId", odds_type "oddsType", "type", cast(percent as varchar) "percent", "description", cast("count" as varchar) "count", '' "league" from ({EVENT_ROWS})""",
)
def csv_probability(spark, sf):
    return _exported(spark, H.probability_events(fx(spark, sf, "fx_prob")), "probability", ["matchId", "companyId", "oddsType", "type", "percent", "description", "count", "league"])


@query(
    "k1_write_csv_crowd",
    f"""with {ctes('fx_support')} select match_id "matchId", cast(asian_home_percent as varchar) "asianHomePercent", cast(asian_away_percent as varchar) "asianAwayPercent",
    cast(over_percent as varchar) "overPercent", cast(under_percent as varchar) "underPercent", '' "detailUrl" from fx_support""",
)
def csv_crowd(spark, sf):
    return _exported(spark, fx(spark, sf, "fx_support"), "crowd", ["matchId", "asianHomePercent", "asianAwayPercent", "overPercent", "underPercent", "detailUrl"])


@query(
    "f13_compact_rows",
    f"""with {ctes('fx_quotes', 'fx_matches')}, {KEYED} select k.match_id "matchId", market, company_id "companyId", 8 + case when bookmaker_key is null then 0 else 2 end + case when cur_b is null then 0 else 1 end
    + case when market = 'europe' then 6 else 9 end - case when m.match_id is null then 4 else 0 end n_keys, count(*) n_rows from keyed k left join fx_matches m on m.match_id = k.match_id group by all""",
)
def compact_rows(spark, sf):
    named = Q.identify_bookmaker(fx(spark, sf, "fx_quotes"))
    out = sinks.compact_rows(Q.flatten_quotes(named, fx(spark, sf, "fx_matches")))
    keys = F.size(F.json_object_keys("compact_json")).alias("n_keys")
    return out.groupBy("matchId", "market", "companyId", keys).agg(F.count(F.lit(1)).alias("n_rows"))


@query("k2_write_jsonl", _EXPORT)
def jsonl(spark, sf):
    path = _folder(spark, "jsonl")
    sinks.write_jsonl(flat(spark, sf).select(*_EXPORTED), path)
    back = spark.read.schema(", ".join(f"`{c}` string" for c in _EXPORTED)).json(path)
    return back.select(*[F.coalesce(c, F.lit("")).alias(c) for c in _EXPORTED])


@query(
    "sql_functions",
    f"""with {ctes('fx_pool')} select pool, printf('%.2f', odds) odds, cast(odds - 1 as double) hk, cast(odds as double) back, cast(odds as double) number, (floor(odds) + 0.5)::double line,
    case when odds * 10 >= 70 then '高' when odds * 10 >= 40 then '中' else '低' end risk, case when odds * 10 >= 72 then '高' when odds * 10 >= 50 then '中' else '低' end confidence,
    case when odds * 10 >= 70 then '強' when odds * 10 >= 40 then '中' else '弱' end pressure,
    round(1 / odds::double + 1 / 3.0::double + 1 / (odds::double + 1), 9) overround, round((1 / 3.0::double) / (1 / odds::double + 1 / 3.0::double + 1 / (odds::double + 1)), 9) share, count(*) n_rows from fx_pool group by all""",
)
def sql_functions(spark, sf):
    sqlfns.register(spark)
    return spark.sql(
        """select pool, norm_odds(cast(odds as string)) odds, cast(hk_odds(odds) as double) hk, cast(decimal_odds(hk_odds(odds)) as double) back,
        first_number(concat('x ', odds, ' y')) number, line_value(concat(floor(odds), '/', floor(odds) + 1)) line, risk_label(odds * 10) risk,
        confidence_label(odds * 10) confidence, pressure_label(odds * 10) pressure,
        round(implied_overround(odds, 3, odds + 1), 9) overround, round(fair_share(3, odds, 3, odds + 1), 9) share, count(*) n_rows from {p} group by all""",
        p=fx(spark, sf, "fx_pool"),
    )
