"""JSON feeds: mobile snapshots, comparison, probability data, pools, fixture context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oddsframe import dims
from oddsframe.functions.rows import spread, spread_fields
from oddsframe.functions.text import decode_entities, let, squeeze, strip_tags, text
from oddsframe.operators.history import probability_events, sample_count_in_text
from oddsframe.operators.select import pool_window, probability_market_allowed


def _kept(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c != "body"]


def script_json(body: Column, name: str = "freshJsonData") -> Column:
    """Text from the object literal on; JSON reading stops at the end of the object."""
    return F.regexp_extract(body, rf"(?s)\b{name}\s*=\s*(\{{.*)", 1)


_ODDS = (
    "struct<companyId: string, firstHomeOdds: string, firstDrawOdds: string, firstAwayOdds: string, "
    "homeOdds: string, drawOdds: string, awayOdds: string, modifyTime: string>"
)
_ENTRY = f"array<struct<kind: string, odds: {_ODDS}>>"
_FEED = f"struct<sbOdds: {_ENTRY}, sbOddsHalf: {_ENTRY}>"
_SNAPSHOT = "scheduleId string, " + ", ".join(f"{p} {_FEED}" for p, _, _ in dims.MOBILE_FEEDS)


def _epoch(value: Column) -> Column:
    seconds = value.try_cast("double")
    return F.when(seconds > 0, F.timestamp_seconds(seconds))


def _side(o: Column, first: bool) -> Column:
    names = ("firstHomeOdds", "firstDrawOdds", "firstAwayOdds") if first else ("homeOdds", "drawOdds", "awayOdds")
    return F.struct(*[text(o[n]).alias(a) for n, a in zip(names, ("a", "line", "b"))])


def _entry_of(entries: Column, kind: str) -> Column:
    return F.try_element_at(F.filter(entries, lambda e: F.upper(e["kind"]) == kind), F.lit(1))["odds"]


def parse_mobile_snapshot(df: DataFrame) -> DataFrame:
    """Quotes of the three feeds in a snapshot, for each market and period.

    For three-way odds `line` holds the draw price.
    """
    snap = df.withColumn("_s", F.from_json(script_json(F.col("body")), _SNAPSHOT))
    found = []
    for rank, (prop, company_id, company) in enumerate(dims.MOBILE_FEEDS):
        for market, kind in (("asian", "ASIAN"), ("over_under", "OU"), ("europe", "EURO")):
            for period, key in (("full", "sbOdds"), ("half", "sbOddsHalf")):
                entries = F.col(f"_s.{prop}.{key}")
                odds = _entry_of(entries, kind)
                found.append(
                    F.when(
                        odds.isNotNull(),
                        F.struct(
                            F.lit(rank).alias("feed_rank"), F.lit(market).alias("market"), F.lit(period).alias("period"),
                            F.coalesce(F.nullif(odds["companyId"], F.lit("")), F.lit(company_id)).alias("company_id"),
                            F.lit(company).alias("company"), _side(odds, True).alias("initial"), _side(odds, False).alias("current"),
                            _epoch(odds["modifyTime"]).alias("changed_at"),
                        ),
                    )
                )
    rows = F.filter(F.array(*found), lambda q: q.isNotNull())
    out = spread_fields(snap, [*_kept(df), F.col("_s.scheduleId").alias("schedule_id")], rows)
    return out.withColumns({"is_closed": F.lit(False), "is_multi_line": F.lit(False), "multi_label": F.lit("")})


_DETAIL = (
    "array<struct<firstHomeOdds: string, firstDrawOdds: string, firstAwayOdds: string, homeOdds: string, drawOdds: string, "
    "awayOdds: string, modifyTime: string, num: string, isStopLive: string>>"
)
_COMPARISON = f"scheduleId string, companies array<struct<companyId: string, nameEn: string, nameCn: string, details: {_DETAIL}>>"


def parse_mobile_comparison(df: DataFrame) -> DataFrame:
    """Quotes of the comparison feed; a company's further lines are multi lines."""
    parsed = df.withColumn("_j", F.from_json("body", _COMPARISON))
    companies = spread(parsed, _kept(df), "_j.companies", "_c", "company_pos")
    rows = spread(companies, [*_kept(df), "company_pos", "_c"], "_c.details", "_o", "line_pos")
    o = F.col("_o")
    number = lambda c: F.nullif(F.trim(c), F.lit("")).try_cast("double").isNotNull()
    rows = rows.where(number(o["homeOdds"]) & number(o["awayOdds"]))
    multi = F.col("line_pos") > 0
    label = F.concat(F.lit("盤"), F.coalesce(F.nullif(o["num"], F.lit("")), (F.col("line_pos") + 1).cast("string")))
    return rows.select(
        *_kept(df), "company_pos", "line_pos", F.col("_c.companyId").alias("company_id"),
        F.coalesce(F.nullif(F.col("_c.nameEn"), F.lit("")), F.col("_c.nameCn")).alias("company"),
        (F.coalesce(o["isStopLive"], F.lit("false")) != "false").alias("is_closed"), multi.alias("is_multi_line"),
        F.when(multi, label).otherwise(F.lit("")).alias("multi_label"),
        _side(o, True).alias("initial"), _side(o, False).alias("current"), _epoch(o["modifyTime"]).alias("changed_at"),
    )


_PROBABILITY = (
    "probabilityDatas struct<dataList: array<struct<companyName: string, companyId: string, typeDatas: array<struct<kind: string, "
    "oddsType: string, probStatistics: array<struct<countType: string, count: double, winScale: double, drawScale: double, "
    "lossScale: double>>>>>>>"
)


def parse_probability_json(df: DataFrame) -> DataFrame:
    """Probability statistics: one row per company, odds type and sample."""
    parsed = df.withColumn("_p", F.from_json(script_json(F.col("body")), _PROBABILITY))
    companies = spread(parsed, _kept(df), "_p.probabilityDatas.dataList", "_c", "_ci")
    types = spread(companies, [*_kept(df), "_c"], "_c.typeDatas", "_t", "_ti")
    rows = spread(types, [*_kept(df), "_c", "_t"], "_t.probStatistics", "_s")
    return rows.select(
        *_kept(df), F.col("_c.companyId").alias("company_id"), F.col("_c.companyName").alias("company_name"),
        F.col("_t.oddsType").alias("odds_type"), F.col("_t.kind").alias("kind"), F.col("_s.countType").alias("count_type"),
        "pos", F.col("_s.count").cast("int").alias("n"), F.col("_s.winScale").alias("win_scale"),
        F.col("_s.drawScale").alias("draw_scale"), F.col("_s.lossScale").alias("loss_scale"),
    )


def has_probability_json(body: Column) -> Column:
    return F.from_json(script_json(body), _PROBABILITY)["probabilityDatas"]["dataList"].isNotNull()


def parse_probability_text(df: DataFrame, threshold: float = 80, min_n: int = 10) -> DataFrame:
    """Events from the visible text of pages without probability JSON, from the heading to the end of the page.

    Lines and events stay arrays in the page's row: a filter above rows would be pushed below the description and work
    out its patterns once for each place that reads it.
    """
    pair = r"([^\s:：,，;；|/]+)\s*[:：]\s*(\d+(?:\.\d+)?)\s*%"

    def described(x):
        rest = F.regexp_replace(x["line"], r"^.*[:：]\s*\d+(?:\.\d+)?\s*%", "")
        after = let(rest, lambda r: F.when(r == "", r).otherwise(F.trim(F.regexp_replace(r, r"^[\s,，;；|/·•-]+", ""))))
        follow = F.when(~F.contains(x["below"], F.lit("%")), F.trim(x["below"])).otherwise(F.lit(""))
        return F.struct(x["line"].alias("line"), x["types"].alias("types"), let(after, lambda a: F.when(a != "", a).otherwise(follow)).alias("description"))

    def wanted(x):
        counted = F.coalesce(sample_count_in_text(x["description"]), F.lit(0)) >= min_n
        return counted & probability_market_allowed(F.coalesce(F.nullif(x["description"], F.lit("")), x["line"]))

    def read(x):
        pairs = F.arrays_zip(x["types"].alias("type"), F.regexp_extract_all(x["line"], F.lit(pair), F.lit(2)).alias("pct"))
        high = F.filter(pairs, lambda p: p["pct"].cast("double") >= threshold)
        kind = lambda p: F.trim(F.regexp_replace(p["type"], r"^[·•\-\s]+", ""))
        return F.transform(
            high, lambda p: F.struct(x["line"].alias("line"), x["description"].alias("description"), kind(p).alias("type"), p["pct"].cast("double").alias("percent"))
        )

    def events(lines):
        # each line next to the one below it, so the list itself is not copied per line
        types = lambda t: F.when(F.contains(t, F.lit("%")), F.regexp_extract_all(t, F.lit(pair), F.lit(1)))
        paired = F.transform(lines, lambda t, i: F.struct(t.alias("line"), text(F.get(lines, i + 1)).alias("below"), types(t).alias("types")))
        stated = F.filter(paired, lambda x: F.coalesce(F.size(x["types"]), F.lit(0)) > 0)
        kept = F.filter(F.transform(stated, described), wanted)
        return F.array_distinct(F.flatten(F.transform(kept, read)))

    section = F.regexp_extract("body", r"(?is)(?:概率事件|概率|Probability\s*Events?).*", 0)
    broken = F.regexp_replace(section, r"(?i)</(?:div|li|p|tr|td|dd|dt|section|article|h[1-6])>|<br\s*/?>", "\n")
    lines = F.filter(F.transform(F.split(decode_entities(strip_tags(broken)), r"\n+"), squeeze), lambda t: t != "")
    from_text = F.when(~F.coalesce(has_probability_json(F.col("body")), F.lit(False)), let(lines, events))
    return spread_fields(df, _kept(df), from_text).dropDuplicates([*_kept(df), "type", "percent", "description", "line"])


def probability_page_events(df: DataFrame, threshold: float = 80, min_n: int = 10) -> DataFrame:
    """Events of probability pages: from their JSON where present, else from their text."""
    cols = ["match_id", "type", "percent", "description"]
    from_json = probability_events(parse_probability_json(df), threshold, min_n)
    return from_json.select(*cols).unionByName(parse_probability_text(df, threshold, min_n).select(*cols))


_NAMED = "struct<id: string, name_en: string, name_ch: string>"
_SELECTION = "array<struct<selId: string, str: string, name_ch: string, name_en: string>>"
_COMBINATION = f"array<struct<combId: string, str: string, status: string, currentOdds: string, selections: {_SELECTION}>>"
_LINE = f"array<struct<lineId: string, status: string, condition: string, main: boolean, combinations: {_COMBINATION}>>"
_POOL = f"array<struct<id: string, status: string, oddsType: string, name_ch: string, name_en: string, updateAt: string, lines: {_LINE}>>"
POOL_MATCH = (
    "id string, frontEndId string, matchDate string, kickOffTime string, status string, updateAt string, "
    f"homeTeam {_NAMED}, awayTeam {_NAMED}, tournament struct<id: string, code: string, name_en: string, name_ch: string>, "
    f"poolInfo struct<normalPools: array<string>, inplayPools: array<string>, sellingPools: array<string>>, foPools {_POOL}"
)


def _pool_match(m: Column) -> list[Column]:
    name = lambda n: F.coalesce(F.nullif(m[n]["name_ch"], F.lit("")), m[n]["name_en"], F.lit(""))
    return [
        m["id"].alias("match_id"), m["frontEndId"].alias("front_end_id"),
        F.try_to_timestamp(m["kickOffTime"]).cast("timestamp_ntz").alias("kickoff_ts"), m["status"].alias("status"),
        name("tournament").alias("tournament"), m["tournament"]["name_ch"].alias("tournament_ch"),
        m["tournament"]["name_en"].alias("tournament_en"), m["tournament"]["code"].alias("tournament_code"),
        name("homeTeam").alias("home"), m["homeTeam"]["name_ch"].alias("home_ch"), m["homeTeam"]["name_en"].alias("home_en"),
        name("awayTeam").alias("away"), m["awayTeam"]["name_ch"].alias("away_ch"), m["awayTeam"]["name_en"].alias("away_en"),
    ]


def parse_pool_json(df: DataFrame) -> DataFrame:
    """One row per selection of a pool match document; matches without pools keep one row."""
    m = df.withColumn("_m", F.from_json("body", POOL_MATCH))
    meta = m.select(*_kept(df), *_pool_match(F.col("_m")), F.col("_m.updateAt").alias("_match_update"), F.posexplode_outer("_m.foPools").alias("_pi", "_p"))
    carried = [c for c in meta.columns if c not in ("_pi", "_p", "_match_update")]
    lines = meta.select(*carried, "_pi", "_p", "_match_update", F.posexplode_outer("_p.lines").alias("_li", "_l"))
    combos = lines.select(*carried, "_pi", "_p", "_match_update", "_li", "_l", F.posexplode_outer("_l.combinations").alias("_ci", "_c"))
    first = F.try_element_at("_c.selections", F.lit(1))
    sel = F.coalesce(F.nullif(F.col("_c.str"), F.lit("")), first["str"])
    names = F.flatten(F.transform("_c.selections", lambda s: F.array(s["name_ch"], s["name_en"], s["str"])))
    return combos.select(
        *carried, F.col("_p.oddsType").alias("pool"), F.col("_p.status").alias("pool_status"),
        F.col("_l.lineId").alias("line_id"), F.col("_l.condition").alias("condition"), F.col("_l.main").alias("main"),
        F.col("_l.status").alias("line_status"), sel.alias("sel"),
        F.coalesce(F.nullif(first["name_ch"], F.lit("")), F.nullif(first["name_en"], F.lit("")), sel).alias("sel_name"),
        F.col("_c.status").alias("comb_status"), F.col("_c.currentOdds").alias("odds"), names.alias("names"),
        F.coalesce(F.nullif(F.col("_p.updateAt"), F.lit("")), F.col("_match_update")).alias("update_at"),
        (F.coalesce("_pi", F.lit(0)) * 1000000 + F.coalesce("_li", F.lit(0)) * 1000 + F.coalesce("_ci", F.lit(0))).cast("long").alias("sel_index"),
    )


def pool_catalog(df: DataFrame, pool_keys: list[str] | None = None, now: Column | None = None, hours: int = 72) -> DataFrame:
    """Matches with their open pool types, in pool order, optionally inside the window."""
    m = df.withColumn("_m", F.from_json("body", POOL_MATCH))
    out = m.select(*_kept(df), *_pool_match(F.col("_m")), F.col("_m.poolInfo.sellingPools").alias("_selling"))
    if now is not None:
        out = pool_window(out, now, hours)
    kinds = [t for key in (pool_keys or dims.SPECIAL_POOLS) for t in dims.POOL_TYPES[key]]
    wanted = F.array(*[F.lit(k) for k in dict.fromkeys(kinds)])
    open_types = F.filter(wanted, lambda k: F.array_contains(F.col("_selling"), k))
    return out.withColumn("pool_types", open_types).where(F.size("pool_types") > 0).drop("_selling")


_TEAM = "struct<id: string, name: string>"
_PERSON = "struct<id: string, name: string, number: string, pos: string, grid: string, type: string, reason: string>"
_GOALS = "struct<home: int, away: int>"
_FIXTURE = (
    "fixture struct<id: string, date: string, status: struct<long: string, short: string>, venue: struct<name: string, city: string>>, "
    f"league struct<id: string, name: string, country: string, season: string, round: string>, teams struct<home: {_TEAM}, away: {_TEAM}>, "
    f"goals {_GOALS}, score struct<halftime: {_GOALS}, fulltime: {_GOALS}, extratime: {_GOALS}, penalty: {_GOALS}>"
)


def parse_fixtures(df: DataFrame) -> DataFrame:
    rows = spread(df, _kept(df), F.from_json("body", f"response array<struct<{_struct(_FIXTURE)}>>")["response"], "_f", "_at")
    f = F.col("_f")
    return rows.select(
        *_kept(df), f["fixture"]["id"].alias("fixture_id"), f["fixture"]["date"].alias("date"),
        f["fixture"]["status"]["short"].alias("status"), f["fixture"]["status"]["long"].alias("status_long"),
        f["fixture"]["venue"]["name"].alias("venue"), f["fixture"]["venue"]["city"].alias("city"),
        f["league"]["id"].alias("league_id"), f["league"]["name"].alias("league"), f["league"]["country"].alias("country"),
        f["league"]["season"].alias("season"), f["league"]["round"].alias("round"),
        f["teams"]["home"]["id"].alias("home_id"), f["teams"]["home"]["name"].alias("home"),
        f["teams"]["away"]["id"].alias("away_id"), f["teams"]["away"]["name"].alias("away"),
        f["goals"]["home"].alias("goals_home"), f["goals"]["away"].alias("goals_away"),
        *[f["score"][part][side].alias(f"{part}_{side}") for part in ("halftime", "fulltime", "extratime", "penalty") for side in ("home", "away")],
    )


def _struct(fields: str) -> str:
    """`a string, b struct<...>` as struct fields `a: string, b: struct<...>`."""
    out, depth, start = [], 0, 0
    for i, ch in enumerate(fields + ","):
        depth += ch == "<"
        depth -= ch == ">"
        if ch == "," and depth == 0:
            name, kind = fields[start:i].strip().split(" ", 1)
            out.append(f"{name}: {kind}")
            start = i + 1
    return ", ".join(out)


_INJURY = {
    "player": ("player", "name"), "player_id": ("player", "id"), "team": ("team", "name"), "team_id": ("team", "id"),
    "type": ("player", "type"), "reason": ("player", "reason"), "fixture_id": ("fixture", "id"),
}


def parse_injuries(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Injuries of a fixture document, with their place in it.

    columns: those read from an entry, all by default.  Spark does not narrow a JSON schema through an array made into
    rows, and an id that is a number costs a writer of its own.
    """
    read = {c: at for c, at in _INJURY.items() if columns is None or c in columns}
    parts = {part: [field for p, field in read.values() if p == part] for part, _ in read.values()}
    entry = ", ".join(f"{part}: struct<{', '.join(f'{field}: string' for field in fields)}>" for part, fields in parts.items())
    items = F.from_json("body", f"response array<struct<{entry}>>")["response"]
    rows = spread(df, _kept(df), items, "_i")
    return rows.select(*_kept(df), "pos", *[F.col("_i")[part][field].alias(c) for c, (part, field) in read.items()])


def parse_lineups(df: DataFrame) -> DataFrame:
    """Line-up players of every team, starters then substitutes."""
    entry = f"array<struct<player: {_PERSON}>>"
    schema = f"response array<struct<team: {_TEAM}, formation: string, coach: struct<name: string>, startXI: {entry}, substitutes: {entry}>>"
    teams = F.from_json("body", schema)["response"]
    rows = spread(df, _kept(df), teams, "_t", "team_pos")
    t = F.col("_t")
    empty = F.array().cast(entry)
    tagged = lambda arr, role: F.transform(
        F.coalesce(arr, empty), lambda e, i: F.struct(F.lit(role).alias("role"), i.alias("pos"), e["player"].alias("p"))
    )
    players = F.concat(tagged(t["startXI"], "start"), tagged(t["substitutes"], "substitute"))
    rows = spread_fields(rows, [*_kept(df), "team_pos", "_t"], players)
    p = F.col("p")
    return rows.select(
        *_kept(df), "team_pos", t["team"]["name"].alias("team"), t["team"]["id"].alias("team_id"), t["formation"].alias("formation"),
        t["coach"]["name"].alias("coach"), "role", "pos", p["name"].alias("name"), p["number"].alias("number"),
        p["pos"].alias("position"), p["grid"].alias("grid"),
    )


def parse_weather(df: DataFrame) -> DataFrame:
    """Hourly forecast rows from parallel arrays."""
    schema = "hourly struct<time: array<string>, temperature_2m: array<double>, precipitation: array<double>, wind_speed_10m: array<double>>"
    h = F.from_json("body", schema)["hourly"]
    zipped = F.arrays_zip(
        h["time"].alias("time"), h["temperature_2m"].alias("temperature_c"), h["precipitation"].alias("precipitation_mm"),
        h["wind_speed_10m"].alias("wind_speed_kmh"),
    )
    rows = spread_fields(df, _kept(df), zipped)
    return rows.withColumn("hour_ts", F.coalesce(*[F.try_to_timestamp("time", F.lit(f)) for f in ("yyyy-MM-dd'T'HH:mm", "yyyy-MM-dd HH:mm")]).cast("timestamp_ntz"))


CONTEXT_PARSERS = {"fixtures": parse_fixtures, "injuries": parse_injuries, "lineups": parse_lineups, "weather": parse_weather}


def parse_context_json(df: DataFrame, kind: str, **options) -> DataFrame:
    return CONTEXT_PARSERS[kind](df, **options)
