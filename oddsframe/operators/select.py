"""Selection operators: leagues, ids, life cycle, time windows, limits, ordering, batches."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from oddsframe import dims
from oddsframe.functions.text import norm_name, text
from oddsframe.operators.ordered import blocked, join_null_safe
from oddsframe.operators.quotes import pick_first


def _league_cols(df: DataFrame) -> list[Column]:
    return [text(F.col(c)) for c in ("league", "league_s", "league_t") if c in df.columns]


def league_names_expanded(spark: SparkSession, leagues: list[str] | None = None) -> DataFrame:
    """The league export: names, other names, and phase variants of the leagues themselves."""
    names = []
    for league in leagues or dims.DEFAULT_LEAGUES:
        names += [*dims.league_names(league), *[league + suffix for suffix in dims.LEAGUE_SUFFIXES]]
    if leagues is None:
        names += dims.DEFAULT_PHASE_LEAGUES
    return spark.createDataFrame([(n,) for n in dict.fromkeys(names)], "league_name string")


def accepted_spellings(leagues: list[str] | None = None) -> list[str]:
    """What the league filter accepts: every name, each with every phase suffix."""
    names = [n + suffix for league in leagues or dims.DEFAULT_LEAGUES for n in dims.league_names(league) for suffix in ["", *dims.LEAGUE_SUFFIXES]]
    return list(dict.fromkeys(names + (dims.DEFAULT_PHASE_LEAGUES if leagues is None else [])))


def filter_allowed_leagues(df: DataFrame, leagues: list[str] | bool | None = None) -> DataFrame:
    """Keep rows whose league, in any of its name columns, is an accepted spelling.

    `False` keeps everything.  The accepted names are a fixed dimension (some thousand rows),
    so the rows never move.
    """
    if leagues is False:
        return df
    names_ = df.sparkSession.createDataFrame([(n,) for n in accepted_spellings(leagues or None)], "league_name string")
    allowed = (
        names_.select(norm_name(F.col("league_name")).alias("_league"))
        .where("_league <> ''")
        .distinct()
    )
    cols = _league_cols(df)
    names = {f"_l{i}": norm_name(c) for i, c in enumerate(cols)}
    hit = reduce(lambda a, b: a | b, [F.col(n) == F.col("_league") for n in names])
    if len(cols) == 1:
        return df.withColumns(names).join(F.broadcast(allowed), hit, "left_semi").drop(*names)
    # several name columns: one broadcast hash lookup each
    out, flags = df.withColumns(names), []
    for n in names:
        flags.append(f"{n}_ok")
        dim = F.broadcast(allowed.select(F.col("_league").alias(n), F.lit(True).alias(f"{n}_ok")))
        out = out.join(dim, n, "left")
    return out.where(F.coalesce(*flags)).drop(*names, *flags)


def league_alias_groups() -> list[list[str]]:
    return [dims.league_names(league) for league in dims.LEAGUE_ALIASES]


def search_league(df: DataFrame, query: str) -> DataFrame:
    """Rows whose league holds the query, or any name of a league group the query is part of."""
    needle = query.lower().strip()
    if not needle:
        return df
    spark = df.sparkSession
    groups = spark.createDataFrame(
        [(i, n) for i, g in enumerate(league_alias_groups()) for n in g], "grp int, name string"
    ).withColumn("n", norm_name(F.col("name")))
    key = norm_name(F.lit(query))
    found = groups.where(
        F.contains(F.lower("name"), F.lit(needle)) | ((key != "") & (F.col("n") != "") & F.contains(F.col("n"), key))
    ).select("grp")
    rows = groups.join(found.distinct(), "grp").select("name", "n").distinct().collect()  # names of a fixed dimension
    raw = F.lower(F.concat_ws(" ", *_league_cols(df)))
    wide = df.withColumns({"_raw": raw, "_norm": norm_name(raw)})
    hits = [F.contains("_raw", F.lit(needle)), (key != "") & F.contains(F.col("_norm"), key)]
    hits += [F.contains("_raw", F.lit(r.name.lower().strip())) for r in rows if r.name.strip()]
    hits += [F.contains("_norm", F.lit(r.n)) for r in rows if r.n]
    return wide.where(reduce(lambda a, b: a | b, hits)).drop("_raw", "_norm")


def normalize_match_ids(df: DataFrame, index: str = "source_index") -> DataFrame:
    """Rows with an all-digit id, the first occurrence of each."""
    rows = df.withColumn("match_id", F.trim(text(F.col("match_id")))).where(F.col("match_id").rlike(r"^\d+$"))
    return pick_first(rows, ["match_id"], [F.col(index)])


def match_ids_in_text(col: Column) -> Column:
    return F.regexp_extract_all(text(col), F.lit(r"(\d+)"), F.lit(1))


_STARTED = "完|進行|上半|下半|中場|加時|點球|点球|取消|腰斬|腰斩|延期|暫停|暂停|live|half|finished|postponed|cancel"
_OVER = "完|完場|结束|結束|finished|full.?time|ft|取消|腰斬|腰斩|延期|postponed|cancel"
_CROWD_STARTED = (
    "完|上|下|中場|中场|半場|半场|加時|加时|點球|点球|進行|进行|開場|开场|延期|推遲|推迟|取消|腰斬|腰斩|斷|断"
    "|live|half|finished|postponed|cancel"
)


def _code(df: DataFrame) -> Column:
    return F.trim(text(F.col("state_code"))) if "state_code" in df.columns else F.lit("")


def _state(df: DataFrame) -> Column:
    return F.lower(F.trim(text(F.col("state")))) if "state" in df.columns else F.lit("")


def not_started(df: DataFrame) -> Column:
    code, state = _code(df), _state(df)
    return F.when(code != "", code == "0").otherwise((state == "") | ~state.rlike(_STARTED))


def lifecycle_status(df: DataFrame) -> DataFrame:
    """upcoming / finished / live from the state code or text."""
    status = F.when((_code(df) == "0") | not_started(df), F.lit("upcoming"))
    return df.withColumn("lifecycle", status.when(_state(df).rlike(_OVER), F.lit("finished")).otherwise(F.lit("live")))


def prematch_only(df: DataFrame, now: Column) -> DataFrame:
    """Not started: by code if there is one, else by text and a kickoff not over five minutes past."""
    now = now.cast("timestamp_ntz")
    fresh = F.coalesce(F.col("kickoff_ts") >= now - F.expr("interval 5 minutes"), F.lit(True))
    code = _code(df)
    return df.where(F.when(code != "", code == "0").otherwise(not_started(df) & fresh))


def crowd_prematch_only(df: DataFrame, now: Column, hours: float = 0) -> DataFrame:
    """Crowd variant: by state text, kickoff not over five minutes past nor beyond `hours`."""
    now = now.cast("timestamp_ntz")
    k = F.col("kickoff_ts")
    keep = ~_state(df).rlike(_CROWD_STARTED) & F.coalesce(k >= now - F.expr("interval 5 minutes"), F.lit(True))
    if hours > 0:
        keep = keep & F.coalesce(k <= now + _hours(hours), F.lit(True))
    return df.where(keep)


def _hours(h: float) -> Column:
    return F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(float(h) * 3600).cast("decimal(18,6)"))


# Named kickoff windows in hours from now.
WINDOWS = {"0-4": (0, 4), "0-6": (0, 6), "6-12": (6, 12), "12-18": (12, 18), "0-24": (0, 24)}


def kickoff_within(df: DataFrame, start_h: float, end_h: float, now: Column) -> DataFrame:
    """Kickoff inside (start, end]; a start of 0 is inclusive, so neighbouring windows do not overlap."""
    now, k = now.cast("timestamp_ntz"), F.col("kickoff_ts")
    start, end = now + _hours(max(0, start_h)), now + _hours(max(start_h, end_h))
    return df.where((k > start if start_h > 0 else k >= now) & (k <= end))


def kickoff_window(df: DataFrame, name: str, now: Column) -> DataFrame:
    """One of the named windows over matches not started; any other name keeps all rows."""
    if name not in WINDOWS:
        return df
    return kickoff_within(df.where(not_started(df)), *WINDOWS[name], now)


def pool_window(df: DataFrame, now: Column, hours: int = 24) -> DataFrame:
    now = now.cast("timestamp_ntz")
    return df.where(F.col("kickoff_ts").between(now, now + _hours(max(1, hours))))


def pool_window_or_inplay(df: DataFrame, now: Column, hours: int = 24) -> DataFrame:
    """The window, or in play and started at most four hours ago."""
    now, k = now.cast("timestamp_ntz"), F.col("kickoff_ts")
    inside = k.between(now, now + _hours(max(1, hours)))
    if "status" not in df.columns:
        return df.where(inside)
    inplay = F.upper(text(F.col("status"))).rlike("INPLAY|LIVE|RUNNING")
    return df.where(inside | (inplay & k.between(now - _hours(4), now)))


def open_pools(df: DataFrame, status: str = "pool_status") -> DataFrame:
    value = F.upper(text(F.col(status)))
    return df.where((value != "") & ~value.isin(*dims.CLOSED_POOL_STATUSES))


_SEARCHED = ["match_id", "league", "league_s", "league_t", "home", "home_s", "home_t", "away", "away_s", "away_t"]


def search_matches(df: DataFrame, q: str = "", status: str = "all", link: str = "all") -> DataFrame:
    """Life cycle, link status and a substring over the id, league and team names."""
    out = lifecycle_status(df)
    if status != "all":
        out = out.where(F.col("lifecycle") == status)
    if link != "all":
        out = out.where(F.col("link_status") == link)
    needle = q.strip().lower()
    if needle:
        cols = [F.nullif(F.col(c).cast("string"), F.lit("")) for c in _SEARCHED if c in df.columns]
        out = out.where(F.contains(F.lower(F.concat_ws(" ", *cols)), F.lit(needle)))
    return out


def link_extractable(status: Column, score: Column, pool_count: Column) -> Column:
    """Linked to an open pool match: open, or possible with a score of 50 or more."""
    return (pool_count > 0) & ((status == "open") | ((status == "possible") & (score >= 50)))


def extraction_targets(df: DataFrame, start_h: float, end_h: float, now: Column) -> DataFrame:
    ok = link_extractable(F.col("link_status"), F.coalesce("link_score", F.lit(0)), F.coalesce("pool_count", F.lit(0)))
    return kickoff_within(df.where(ok & not_started(df)), start_h, end_h, now)


def compact_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """Whitelisted columns with empty text as missing, plus the compact JSON (missing keys left out)."""
    cols = []
    for c in columns:
        if c in df.columns:
            kind = df.schema[c].dataType.simpleString()
            cols.append((F.nullif(F.col(c), F.lit("")) if kind == "string" else F.col(c)).alias(c))
    out = df.select(*cols)
    return out.withColumn("compact_json", F.to_json(F.struct(*out.columns)))


def probability_market_allowed(col: Column) -> Column:
    """Handicap and goals texts; never win/draw/loss ones."""
    has = lambda words: reduce(lambda a, b: a | b, [F.contains(text(col), F.lit(w)) for w in words])
    return ~has(("胜平负", "勝平負")) & has(("让球", "讓球", "进球数", "進球數"))  # the last two also stand in 总进球数 and 總進球數


def retry_issues(sections: DataFrame) -> DataFrame:
    """Issue rows of a batch: match error, section error, or missing bookmakers.

    Input: one row per (match, section) with ok, match_error, error and missing_labels (array).
    The pool operator never counts as missing.
    """
    ignored = "hk jockey|香港賽馬會|香港赛马会|香港馬|香港马"
    missing = F.filter(
        F.coalesce("missing_labels", F.array().cast("array<string>")), lambda m: ~F.lower(m).rlike(ignored)
    )
    issue = lambda kind, label, detail: F.struct(
        F.lit(kind).alias("type"), label.alias("label"), detail.alias("detail")
    )
    ok = F.coalesce(F.col("ok"), F.lit(False))
    found = F.array(
        F.when(~ok, issue("match_error", F.lit("整場提取"), F.coalesce("match_error", F.lit("沒有回傳資料")))),
        F.when(ok & (text(F.col("error")) != ""), issue("market_error", F.col("section"), F.col("error"))),
        F.when(
            ok & (F.size(missing) > 0),
            issue("bookmaker_missing", F.col("section"), F.concat(F.lit("缺："), F.array_join(missing, "、"))),
        ),
    )
    rows = sections.select("match_id", F.inline(F.filter(found, lambda i: i.isNotNull())))
    return rows.distinct()


def retryable_results(sections: DataFrame) -> DataFrame:
    """Distinct matches with at least one issue."""
    return retry_issues(sections).select("match_id").distinct()


def order_by_kickoff(df: DataFrame, limit: int | None = None, index: str = "source_index") -> DataFrame:
    """Earliest kickoff first, unknown last, then input order; all rows, or the first `limit`."""
    ordered = df.orderBy(F.asc_nulls_last("kickoff_ts"), F.asc(index))
    return ordered if limit is None else ordered.limit(limit)


def sort_hits(hits: DataFrame) -> DataFrame:
    """Kickoff, then tournament|home|away|pool|label in binary order."""
    parts = [text(F.col(c)) for c in ("tournament", "home", "away", "pool", "rule_label") if c in hits.columns]
    return hits.withColumn("sort_text", F.concat_ws("|", *parts)).orderBy(F.asc_nulls_last("kickoff_ts"), "sort_text")


def limit_matches(df: DataFrame, n: int, index: str = "source_index") -> DataFrame:
    return df.orderBy(index).limit(n)


def running_number(df: DataFrame, keys: list[str], index: str, block: int = 50_000) -> DataFrame:
    """`row_no`: 0-based position per key by an integer `index`, without one task per key.

    The index range of a key is cut into as many blocks as its rows need, however sparse the index
    is; positions inside a block plus the counts of earlier blocks (one row per block) give the
    global position.  A NULL key is a key, a NULL index comes first.
    """
    rows = blocked(df, keys, index, block)
    counts = rows.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(
        F.sum("_n").over(W.partitionBy(*keys).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)
    )
    offsets = counts.select(*keys, "_b", before.alias("_before"))
    inside = F.row_number().over(W.partitionBy(*keys, "_b").orderBy(index))
    numbered = join_null_safe(rows.withColumn("_i", inside), offsets, [*keys, "_b"])
    return numbered.withColumn("row_no", (F.col("_before") + F.col("_i") - 1).cast("long")).drop("_b", "_i", "_before")


def chunk_ids(df: DataFrame, size: int = 25, keys: tuple[str, ...] = ("snapshot_id",), index: str = "source_index") -> DataFrame:
    """Batch number of each row, `size` rows per batch in list order, per snapshot."""
    out = running_number(df, list(keys), index)
    return out.withColumn("chunk", F.floor(F.col("row_no") / size).cast("long")).drop("row_no")


def excluded_matches(all_rows: DataFrame, kept: DataFrame) -> DataFrame:
    """How many distinct match ids of `all_rows` are not in `kept`."""
    ids = lambda df: df.select(F.trim(text(F.col("match_id"))).alias("match_id")).where("match_id <> ''").distinct()
    return ids(all_rows).join(ids(kept), "match_id", "left_anti").agg(F.count(F.lit(1)).alias("excluded"))


def target_options(current: DataFrame, cached: DataFrame) -> DataFrame:
    """Current matches first, cached ones only where not current; first occurrence wins."""
    tag = lambda df, source, rank: df.withColumns({"source": F.lit(source), "_rank": F.lit(rank)})
    both = tag(current, "current", 0).unionByName(tag(cached, "cache", 1), allowMissingColumns=True)
    both = both.where(F.coalesce("match_id", F.lit("")) != "")
    return pick_first(both, ["match_id"], [F.col("_rank"), F.col("source_index")]).drop("_rank")


def intersect_keys(left: Column, right: Column) -> Column:
    """Whether two alias sets share a name."""
    return F.arrays_overlap(left, right)


def batch_summary(results: DataFrame, chunk: int = 25) -> DataFrame:
    """Counts of a batch; an absent page counts as answered without data.

    Input: match_id, ok, error, hits (number of hits of the result).
    """
    no_data = text(F.col("error")).rlike("returned an error page|HTTP 404|no-match|Object reference|暂无相关数据|暂无数据")
    done = F.coalesce(F.col("ok"), F.lit(False)) | no_data
    hits = F.coalesce(F.col("hits"), F.lit(0))
    return results.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(done).alias("ok_count"),
        F.count_if(~done).alias("error_count"),
        F.count_if(no_data).alias("no_data_count"),
        F.coalesce(F.sum(hits), F.lit(0)).cast("long").alias("hit_count"),
        F.count_distinct(F.when(hits > 0, F.col("match_id"))).alias("match_hit_count"),
        F.ceil(F.count(F.lit(1)) / chunk).cast("long").alias("batch_count"),
    )


def link_summary(checks: DataFrame) -> DataFrame:
    return checks.agg(
        F.count(F.lit(1)).alias("checked"),
        F.count_if(F.col("status") == "open").alias("open_count"),
        F.count_if(F.col("status") == "possible").alias("possible_count"),
    )


def attach_link_status(matches: DataFrame, checks: DataFrame) -> DataFrame:
    """Link status and score per match; `not_found` where no check exists."""
    keyed = checks.select("match_id", F.col("status").alias("link_status"), F.col("score").alias("link_score"))
    out = matches.join(keyed, "match_id", "left")
    return out.withColumn("link_status", F.coalesce("link_status", F.lit("not_found")))


def merge_live_meta(items: DataFrame, live: DataFrame) -> DataFrame:
    """Live-list attributes behind the item's own; a blank own team id is filled."""
    team = {"home_team_id", "away_team_id"}
    theirs = live.select("match_id", *[F.col(c).alias(f"_l_{c}") for c in live.columns if c != "match_id"])
    joined = items.join(theirs, "match_id", "left")
    names = [c for c in dict.fromkeys([*items.columns, *live.columns]) if c != "match_id"]
    cols = []
    for c in names:
        own, other = F.col(c) if c in items.columns else None, F.col(f"_l_{c}") if c in live.columns else None
        if own is not None and c in team:
            own = F.nullif(own, F.lit(""))
        cols.append(F.coalesce(*[x for x in (own, other) if x is not None]).alias(c))
    return joined.select("match_id", *cols)


def merge_match_meta(*sources: DataFrame, fields: list[str]) -> DataFrame:
    """First non-empty value of each field by source priority, per match."""
    blocks = [s.withColumn("_p", F.lit(i)) for i, s in enumerate(sources)]
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), blocks)
    value = lambda f: F.nullif(F.trim(F.col(f).cast("string")), F.lit(""))
    aggs = [F.min_by(value(f), F.when(value(f).isNotNull(), F.col("_p"))).alias(f) for f in fields]
    return rows.groupBy("match_id").agg(*aggs)
