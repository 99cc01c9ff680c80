"""Script captures: live list, three-way odds, past results, streamed replies.

Parsers are column expressions over `body`; other columns pass through, the body does not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oddsframe.functions.odds import score_text, state_label
from oddsframe.functions.rows import spread
from oddsframe.functions.text import match_text, text
from oddsframe.functions.times import script_time


def _kept(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c != "body"]


def _field(fields: str, i: int) -> Column:
    return text(F.get(F.col(fields), F.lit(i)))


def _either(a: Column, b: Column) -> Column:
    return F.coalesce(F.nullif(a, F.lit("")), b)


_LIVE = r"(?s)A\[\d+]\s*=\s*\".*?\"\.split\('\^'\);"


def is_live_list(body: Column) -> Column:
    """Whether a page has a match for `parse_live_list`."""
    return body.rlike(_LIVE)


def parse_live_list(df: DataFrame) -> DataFrame:
    """One match per `A[n]="...".split('^');` block; traditional names first."""
    blocks = spread(df, _kept(df), F.regexp_extract_all("body", F.lit(_LIVE), F.lit(0)), "_b")
    inner = r"(?s)A\[(\d+)]\s*=\s*\"(.*)\"\.split"
    rows = blocks.withColumns(
        {
            "source_index": F.regexp_extract("_b", inner, 1).try_cast("long"),
            "_f": F.split(F.regexp_extract("_b", inner, 2), r"\^"),
        }
    )
    f = lambda i: _field("_f", i)
    name = lambda s, t: match_text(_either(f(t), f(s)))
    return rows.select(
        *_kept(df), "pos", "source_index", f(0).alias("match_id"),
        name(2, 3).alias("league"), match_text(f(2)).alias("league_s"), match_text(f(3)).alias("league_t"),
        name(5, 6).alias("home"), match_text(f(5)).alias("home_s"), match_text(f(6)).alias("home_t"),
        name(8, 9).alias("away"), match_text(f(8)).alias("away_s"), match_text(f(9)).alias("away_t"),
        f(11).alias("kickoff_raw"), f(13).alias("state_code"), state_label(f(13)).alias("state"),
        score_text(f(14), f(15)).alias("score"), score_text(f(18), f(19)).alias("half_score"),
        f(29).alias("asian_initial_line"), f(37).alias("home_team_id"), f(38).alias("away_team_id"),
        f(46).alias("total_initial_line"),
    )


_THREE_WAY = ["win", "draw", "loss", "win_rate", "draw_rate", "loss_rate", "return_rate"]
_KELLY = ["kelly_win", "kelly_draw", "kelly_loss"]


def parse_europe_js(df: DataFrame) -> DataFrame:
    """Three-way odds from `var game=Array("...|...")`; a cut-off tail loses only its last entry."""
    source = F.regexp_extract("body", r"(?s)var\s+game\s*=\s*Array\((.*?)(?:\);|\z)", 1)
    strings = F.regexp_extract_all(source, F.lit(r'"((?:\\.|[^"\\])*)"'), F.lit(1))
    rows = spread(df, _kept(df), strings, "_s")
    clean = F.replace(F.replace(F.col("_s"), F.lit('\\"'), F.lit('"')), F.lit("\\\\"), F.lit("\\"))
    rows = rows.withColumn("_f", F.split(clean, r"\|")).where(F.size("_f") >= 22)
    f = lambda i: _field("_f", i)
    group = lambda start, kelly: F.struct(
        *[f(start + i).alias(n) for i, n in enumerate(_THREE_WAY)], *[f(kelly + i).alias(n) for i, n in enumerate(_KELLY)]
    )
    return rows.select(
        *_kept(df), "pos", F.lit("europe").alias("market"), F.lit("full").alias("period"),
        f(0).alias("company_id"), f(1).alias("odds_id"), f(2).alias("english_name"), _either(f(21), f(2)).alias("company"),
        group(3, 24).alias("initial"), group(10, 17).alias("current"),
        script_time(f(20)).alias("changed_at_raw"),
        F.try_to_timestamp(script_time(f(20)), F.lit("yyyy-MM-dd HH:mm:ss")).cast("timestamp_ntz").alias("changed_at"),
        (f(22) == "1").alias("is_primary"), (f(23) == "1").alias("is_exchange"),
    )


def parse_past_results(df: DataFrame) -> DataFrame:
    """Past results from `p[n]=[...]` records with ten or more fields and numeric goals."""
    records = F.regexp_extract_all("body", F.lit(r"(?s)p\[\d+]\s*=\s*\[.*?];"), F.lit(0))
    rows = spread(df, _kept(df), records, "_r")
    inner = r"(?s)p\[(\d+)]\s*=\s*\[(.*)];"
    # every field ends in a comma once one is added; quotes may hold commas
    item = r"""\s*('(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*"|[^,'"]*)\s*,"""
    raw = F.regexp_extract_all(F.concat(F.regexp_extract("_r", inner, 2), F.lit(",")), F.lit(item), F.lit(1))
    unquote = lambda x: F.when(
        x.rlike("""^['"]"""), F.regexp_replace(F.substring(x, F.lit(2), F.length(x) - 2), r"\\(.)", "$1")
    ).otherwise(F.trim(x))
    rows = rows.withColumns({"_f": F.transform(raw, unquote), "source_index": F.regexp_extract("_r", inner, 1).try_cast("long")})
    f = lambda i: _field("_f", i)
    number = lambda i: F.when(F.trim(f(i)) == "", F.lit(0.0)).otherwise(F.trim(f(i)).try_cast("double"))
    rows = rows.where(F.size("_f") >= 10).withColumns({"_h": number(5), "_a": number(6)})
    return rows.where("_h is not null and _a is not null").select(
        *_kept(df), "pos", "source_index", match_text(f(0)).alias("league"), f(1).alias("color"), f(2).alias("played_at"),
        F.trim(f(3)).alias("home_team_id"), F.trim(f(4)).alias("away_team_id"),
        F.col("_h").cast("int").alias("home_goals"), F.col("_a").cast("int").alias("away_goals"),
        number(7).alias("half_home_goals"), number(8).alias("half_away_goals"), number(9).alias("handicap"),
        (F.col("_h") + F.col("_a")).cast("int").alias("total_goals"),
    )


def parse_event_props(df: DataFrame, column: str, fields: dict[str, str]) -> DataFrame:
    """Typed columns from a JSON text column; broken JSON gives NULLs."""
    schema = ", ".join(f"`{n}` {t}" for n, t in fields.items())
    parsed = F.from_json(F.col(column), schema)
    return df.withColumns({n: parsed[n] for n in fields})


_USAGE = "prompt_tokens long, completion_tokens long, total_tokens long"
_MESSAGE = "struct<content: string>"
_EVENT = (
    f"error struct<message: string>, choices array<struct<delta: {_MESSAGE}, message: {_MESSAGE}>>, "
    f"usage struct<{_USAGE.replace(' long', ': long')}>"
)


def stream_events(df: DataFrame, keys: list[str], order: str, column: str = "text") -> DataFrame:
    """The `data:` events of captured reply chunks, in order."""
    lines = spread(df, [*keys, F.col(order).alias("_chunk")], F.split(column, r"\r?\n"), "_t", "_line")
    data = F.trim(F.substr("_t", F.lit(6)))
    events = lines.where(F.col("_t").startswith("data:")).withColumn("_d", data).where("_d not in ('', '[DONE]')")
    event = F.from_json("_d", _EVENT)
    choice = F.get("_e.choices", F.lit(0))
    return events.withColumns({"_e": event, "at": F.struct("_chunk", "_line")}).select(
        *keys,
        "at",
        F.col("_e.error.message").alias("error"),
        F.concat(text(choice["delta"]["content"]), text(choice["message"]["content"])).alias("content"),
        F.col("_e.usage").alias("usage"),
    )


def assemble_stream_chunks(df: DataFrame, keys: list[str], order: str = "turn", column: str = "text") -> DataFrame:
    """One reply per key: content in order, the last usage, and the first error."""
    events = stream_events(df, keys, order, column)
    # one reply is one document; its pieces are joined where the reply is put together
    pieces = F.transform(F.array_sort(F.collect_list(F.struct("at", "content"))), lambda x: x["content"])
    return events.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("event_count"),
        F.array_join(pieces, "").alias("content"),
        F.max_by("usage", F.when(F.col("usage").isNotNull(), F.col("at"))).alias("usage"),
        F.min_by("error", F.when(F.col("error").isNotNull(), F.col("at"))).alias("error"),
    )
