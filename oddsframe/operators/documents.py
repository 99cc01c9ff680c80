"""Per-match documents, chunks and the single-match input.

A document list may have a row budget per payload; rows over it go to further payloads.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oddsframe import dims
from oddsframe.functions.odds import section_key
from oddsframe.functions.text import let, text, token_estimate
from oddsframe.operators.ordered import numbered
from oddsframe.operators.quotes import pick_first

MISSING = "未指定"  # marker for a missing value in rendered documents

_MATCH = ["league", "kickoff_ts", "state", "score", "home", "away"]


def _have(df: DataFrame, names: list[str]) -> list[str]:
    return [n for n in names if n in df.columns]


def budget_rows(rows: DataFrame, payload: list[str], order: list[str], max_rows: int | None = None) -> DataFrame:
    """`row_no` from 1 in each payload, and `payload_no`: rows over the budget go to further payloads."""
    out = numbered(rows, payload, order, "row_no")
    part = F.floor((F.col("row_no") - 1) / max_rows) if max_rows else F.lit(0)
    return out.withColumn("payload_no", part.cast("long"))


def payload_summary(rows: DataFrame, payload: list[str], max_rows: int | None = None) -> DataFrame:
    """Rows of each payload, and into how many payloads of the budget they go."""
    out = rows.groupBy(*payload).agg(F.count(F.lit(1)).alias("original_rows"))
    parts = F.ceil(F.col("original_rows") / max_rows) if max_rows else F.lit(1)
    return out.withColumns({"payloads": parts.cast("long"), "split": parts > 1})


def match_documents(rows: DataFrame, payload: list[str], order: list[str], max_rows: int | None = None) -> DataFrame:
    """One nested document per match of a payload: five market arrays, counts, missing markets, size.

    A match that straddles two payloads of the budget has a document in each.
    """
    kept = budget_rows(rows.where(F.trim(text(F.col("match_id"))) != ""), payload, order, max_rows)
    payload = [*payload, "payload_no"]
    kept = kept.withColumn("_bucket", section_key(F.col("market"), F.col("period")))
    left_out = {*payload, *_MATCH, "match_id", "market", "period", "_bucket"}
    entry = F.struct(*[c for c in kept.columns if c not in left_out and c != "row_no"])
    aggs = [F.min("row_no").alias("first_row")]
    aggs += [F.min_by(c, "row_no").alias(c) for c in _have(rows, _MATCH)]
    for key, _, _, _ in dims.MARKET_BUCKETS:
        here = F.when(F.col("_bucket") == key, F.struct("row_no", entry.alias("r")))
        aggs.append(F.transform(F.sort_array(F.collect_list(here)), lambda x: x["r"]).alias(key))
    docs = kept.groupBy(*payload, "match_id").agg(*aggs)
    keys = [k for k, _, _, _ in dims.MARKET_BUCKETS]
    missing = F.array(*[F.when(F.size(k) == 0, F.lit(label)) for k, _, _, label in dims.MARKET_BUCKETS])
    docs = docs.withColumns(
        {
            "market_counts": F.struct(*[F.size(k).alias(k) for k in keys]),
            "missing_markets": F.filter(missing, lambda m: m.isNotNull()),
            "markets": F.struct(*keys),
        }
    ).drop(*keys)
    docs = docs.withColumn("complete_market_count", F.lit(len(keys)) - F.size("missing_markets"))
    document = F.to_json(F.struct("match_id", *_have(docs, _MATCH), "markets", "market_counts", "missing_markets"))
    return docs.withColumns({"json_chars": F.length(document), "estimated_tokens": token_estimate(document)})


def per_match_chunks(docs: DataFrame, payload: list[str]) -> DataFrame:
    """One chunk per document: position, total and title."""
    payload = [*payload, "payload_no"]
    teams = F.concat_ws(" vs ", *[F.nullif(F.col(c), F.lit("")) for c in ("home", "away") if c in docs.columns])
    title = F.concat_ws(" · ", F.nullif(F.col("league"), F.lit("")), F.nullif(teams, F.lit("")))
    return numbered(docs, payload, ["first_row"], "chunk_index", "chunk_total").withColumns(
        {
            "match_title": F.coalesce(F.nullif(title, F.lit("")), F.col("match_id")),
            "workflow": F.lit("chunk_match_scan"),
        }
    )


def pool_chunk_id(df: DataFrame) -> Column:
    """Group of a pool hit: front-end id, else match id, else the names."""
    names = F.concat_ws("|", *[F.nullif(F.col(c), F.lit("")) for c in ("tournament", "home", "away") if c in df.columns])
    ids = [F.nullif(F.col(c), F.lit("")) for c in ("front_end_id", "match_id", "raw_match_id") if c in df.columns]
    return F.coalesce(*ids, F.nullif(names, F.lit("")), F.lit("unknown"))


def pool_chunks(hits: DataFrame, payload: list[str], order: list[str], max_rows: int | None = None) -> DataFrame:
    """Hits of one pool match together; hits over the row budget go to further payloads."""
    kept = budget_rows(hits.withColumn("chunk_id", pool_chunk_id(hits)), payload, order, max_rows)
    payload = [*payload, "payload_no"]
    entry = F.struct("row_no", F.struct(*hits.columns).alias("r"))
    lists = F.transform(F.sort_array(F.collect_list(entry)), lambda x: x["r"]).alias("rows")
    out = kept.groupBy(*payload, "chunk_id").agg(F.min("row_no").alias("_first"), lists)
    return numbered(out, payload, ["_first"], "chunk_index", "chunk_total").drop("_first")


def squad(players: DataFrame) -> DataFrame:
    """Line-up players of each match once per name, the last line-up entry winning, and the probable elevens.

    players: match_id, team_pos, team, role, pos, name, number, position, formation, coach.
    Repeated captures of a slot merge first, so a match collects one row per slot of its line-ups, once; both lists are
    read from the collected slots.
    """
    players = pick_first(players, ["match_id", "team_pos", "role", "pos"], [F.col("name")])
    players = players.where((F.coalesce("name", F.lit("")) != "") | (F.col("role") == "start"))  # a slot of neither list
    at = F.struct("team_pos", (F.col("role") == "substitute").alias("substitute"), "pos").alias("at")
    slot = F.struct(at, "name", "role", "team", "formation", "coach", "number", "position")
    slots = players.groupBy("match_id").agg(F.sort_array(F.collect_list(slot)).alias("_slots"))

    def unique(named):
        ids, back = F.transform(named, lambda s: s["name"]), F.reverse(named)
        last = lambda s: F.get(back, F.array_position(F.transform(back, lambda x: x["name"]), s["name"]) - 1)
        first = F.filter(named, lambda s, i: F.array_position(ids, s["name"]) == i + 1)
        member = lambda s, x: F.struct(s["name"].alias("name"), x["team"].alias("team"), x["position"].alias("position"))
        return F.transform(first, lambda s: let(last(s), lambda x: member(s, x)))

    def eleven(team_pos, group):
        head = F.get(group, F.lit(0))
        people = F.transform(group, lambda s: F.struct(s["name"], s["number"], s["position"]))
        return F.struct(
            team_pos.alias("team_pos"), head["team"].alias("team"), head["formation"].alias("formation"), head["coach"].alias("coach"), people.alias("start_xi")
        )

    def elevens(starters):
        teams = F.array_distinct(F.transform(starters, lambda s: s["at"]["team_pos"]))
        return F.transform(teams, lambda t: let(F.filter(starters, lambda s: s["at"]["team_pos"].eqNullSafe(t)), lambda g: eleven(t, g)))

    named = F.filter("_slots", lambda s: F.coalesce(s["name"], F.lit("")) != "")
    starters = F.filter("_slots", lambda s: s["role"] == "start")
    some = lambda found, fn: let(found, lambda x: F.when(F.size(x) > 0, fn(x)))
    return slots.select("match_id", some(named, unique).alias("full_squad_list"), some(starters, elevens).alias("probable_xi"))


def single_match_input(docs: DataFrame, squads: DataFrame | None = None, injuries: DataFrame | None = None, source: str = "extract") -> DataFrame:
    """The input of a single-match analysis: prices open and live, line series (full then half),
    squad, probable elevens, injuries, in-play flag.  Missing values are NULL or empty arrays.

    squads: per match as from `squad`; injuries: per match with an `injuries` array.
    """
    c = F.col
    europe, m = c("markets.europe"), lambda k: c(f"markets.{k}")
    opened = F.transform(
        europe,
        lambda r: F.struct(r["bookmaker"].alias("bookmaker"), r["ini_a"].alias("home"), r["ini_draw"].alias("draw"), r["ini_b"].alias("away"), r["changed_at"].alias("changed_at")),
    )
    live = F.transform(
        europe,
        lambda r: F.struct(r["bookmaker"].alias("bookmaker"), r["cur_a"].alias("home"), r["cur_draw"].alias("draw"), r["cur_b"].alias("away"), r["changed_at"].alias("changed_at")),
    )

    def series(key, period, first, third):
        return F.transform(
            m(key),
            lambda r: F.struct(
                F.lit(period).alias("period"), r["bookmaker"].alias("bookmaker"), r["is_closed"].alias("is_closed"), r["is_multi_line"].alias("is_multi_line"),
                F.struct(r["ini_a"].alias(first), r["ini_line"].alias("line"), r["ini_b"].alias(third)).alias("open"),
                F.struct(r["cur_a"].alias(first), r["cur_line"].alias("line"), r["cur_b"].alias(third)).alias("latest"),
            ),
        )

    state = text(c("state")) if "state" in docs.columns else F.lit("")
    out = docs
    if squads is not None:
        out = out.join(squads, "match_id", "left")
    if injuries is not None:
        out = out.join(injuries.withColumnRenamed("injuries", "injuries_suspensions"), "match_id", "left")
    extra = [n for n in ("full_squad_list", "probable_xi", "injuries_suspensions") if n in out.columns]
    meta = {"home_team": "home", "away_team": "away", "kickoff_time": "kickoff_ts", "league": "league", "state": "state", "current_score": "score"}
    return out.select(
        "match_id",
        F.struct(c("match_id"), *[c(v).cast("string").alias(k) for k, v in meta.items() if v in docs.columns], F.lit(source).alias("source")).alias("match_meta"),
        opened.alias("odds_1x2_open"), live.alias("odds_1x2_live"),
        F.concat(series("asianFull", "full", "home", "away"), series("asianHalf", "half", "home", "away")).alias("asian_handicap_series"),
        F.concat(series("overUnderFull", "full", "over", "under"), series("overUnderHalf", "half", "over", "under")).alias("totals_ou_series"),
        *extra,
        ((state != "") & ~state.rlike("(?i)未|待|賽前|pre")).alias("in_play_flag"),
        F.array(*[F.lit(x) for x in ("HAD", "Handicap HAD", "HiLo", "Corner Taken HiLo")]).alias("bet_types_required"),
        "market_counts", "missing_markets",
    )


# Audited fields in order, and those whose absence is critical.
AUDIT_FIELDS = [
    "home_team", "away_team", "kickoff_time", "league", "recent_10_matches.xg", "recent_10_matches.xga",
    "recent_10_matches.actual_goals", "full_squad_list", "injuries/suspensions", "odds_1x2_open/live",
    "asian_handicap_series", "totals_ou_series", "possession_pct_recent", "final_third_penetration_rate",
    "crosses_frequency", "corners_recent", "importance_tags", "in_play_flag", "bet_types_required",
]
CRITICAL_FIELDS = [
    "recent_10_matches.xg", "recent_10_matches.xga", "recent_10_matches.actual_goals", "full_squad_list",
    "injuries/suspensions", "possession_pct_recent", "final_third_penetration_rate", "crosses_frequency", "corners_recent",
]


def input_audit(inputs: DataFrame) -> DataFrame:
    """Status of the 19 audited fields (ok / derived / missing), the missing and the critical ones."""
    c = F.col
    fields = set(inputs.schema["match_meta"].dataType.fieldNames())
    said = lambda col, good="ok": F.when(col, F.lit(good)).otherwise(F.lit("missing"))
    meta = lambda n: said(text(c(f"match_meta.{n}")) != "") if n in fields else F.lit("missing")
    array = lambda n, good="ok": said(F.coalesce(F.size(c(n)), F.lit(0)) > 0, good) if n in inputs.columns else F.lit("missing")
    status = {n: F.lit("missing") for n in AUDIT_FIELDS}
    status |= {n: meta(n) for n in ("home_team", "away_team", "kickoff_time", "league")}
    status |= {
        "full_squad_list": array("full_squad_list"),
        "injuries/suspensions": array("injuries_suspensions"),
        "odds_1x2_open/live": array("odds_1x2_open", "derived"),
        "asian_handicap_series": array("asian_handicap_series", "derived"),
        "totals_ou_series": array("totals_ou_series", "derived"),
        "in_play_flag": F.lit("ok"),
        "bet_types_required": F.lit("ok"),
    }
    audit = F.array(*[F.struct(F.lit(n).alias("field"), status[n].alias("status")) for n in AUDIT_FIELDS])
    out = inputs.withColumn("input_audit", audit)
    missing = F.transform(F.filter("input_audit", lambda a: a["status"] == "missing"), lambda a: a["field"])
    out = out.withColumn("missing_fields", missing)
    critical = F.array(*[F.lit(n) for n in CRITICAL_FIELDS])
    return out.withColumn("critical_missing", F.filter("missing_fields", lambda f: F.array_contains(critical, f)))


def render(col: Column) -> Column:
    """Text of a value for a rendered document."""
    return F.coalesce(F.nullif(col.cast("string"), F.lit("")), F.lit(MISSING))
