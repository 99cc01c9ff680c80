"""Head-to-head and probability statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from oddsframe.functions.odds import round_n
from oddsframe.functions.text import text


def _pair(df: DataFrame) -> DataFrame:
    """The two teams in a fixed order, whoever played at home."""
    h, a = F.trim(text(F.col("home_team_id"))), F.trim(text(F.col("away_team_id")))
    return df.withColumns({"team_1": F.least(h, a), "team_2": F.greatest(h, a)})


PAIR = ["team_1", "team_2"]


def head_to_head(matches: DataFrame, past: DataFrame) -> DataFrame:
    """Past meetings of the teams that meet in `matches`, keyed by the unordered pair.

    Each past result appears once, however many matches share the pair; a match finds its
    meetings by its own pair.
    """
    wanted = _pair(matches).where("team_1 <> '' and team_2 <> ''").select(*PAIR).distinct()
    return _pair(past).join(wanted, PAIR, "left_semi")


def pair_stats(past: DataFrame, recent: int = 10, index: str = "source_index") -> DataFrame:
    """Per pair: meetings, games over 2.5 goals, and the first `recent` results as text.

    A meeting that was landed more than once counts once.  The list is cut to `recent` rows per
    pair before it is collected.
    """
    meeting = ["home_team_id", "away_team_id", "played_at", "home_goals", "away_goals"]
    past = past.groupBy(*meeting).agg(F.min(index).alias(index))
    rows = _pair(past).withColumn("total_goals", F.col("home_goals") + F.col("away_goals"))
    counts = rows.groupBy(*PAIR).agg(
        F.count(F.lit(1)).alias("sample_count"), F.count_if(F.col("total_goals") > 2.5).alias("over_count")
    )
    first = rows.withColumn("_r", F.row_number().over(W.partitionBy(*PAIR).orderBy(index))).where(F.col("_r") <= recent)
    line = F.concat_ws(" ", F.col("played_at").cast("string"), F.concat_ws("-", "home_goals", "away_goals"))
    lists = first.groupBy(*PAIR).agg(F.sort_array(F.collect_list(F.struct("_r", line.alias("t")))).alias("_l"))
    lists = lists.select(*PAIR, F.array_join(F.transform("_l", lambda x: x["t"]), " | ").alias("history"))
    return counts.join(lists, PAIR)


def h2h_over_under(matches: DataFrame, past: DataFrame, threshold: float = 80, min_n: int = 8, index: str = "source_index") -> DataFrame:
    """Over / under 2.5 goals of past meetings per match, with the reason where there is none.

    Meetings are reduced to one row per pair first, so the join is one row per match.
    """
    stats = pair_stats(past, index=index)
    out = _pair(matches).join(stats, PAIR, "left")
    n, over = F.coalesce("sample_count", F.lit(0)), F.col("over_count")
    known = (F.col("team_1") != "") & (F.col("team_2") != "")
    reason = (
        F.when(~known, F.lit("missing_ids"))
        .when(n == 0, F.lit("no_meetings"))
        .when(n < max(1, min_n), F.lit("too_few"))
    )
    out = out.withColumns({"sample_count": F.when(known, n).otherwise(F.lit(0)), "no_data_reason": reason})
    ready = F.col("no_data_reason").isNull()
    percent = lambda c: F.when(ready, round_n(c.cast("double") / F.col("sample_count") * 100.0, 1))
    out = out.withColumns(
        {
            "over_count": F.when(ready, over),
            "under_count": F.when(ready, F.col("sample_count") - over),
            "history": F.when(ready, F.col("history")),
        }
    )
    out = out.withColumns({"over_percent": percent(F.col("over_count")), "under_percent": percent(F.col("under_count"))})
    return out.withColumns(
        {
            "over_hit": F.coalesce(F.col("over_percent") >= threshold, F.lit(False)),
            "under_hit": F.coalesce(F.col("under_percent") >= threshold, F.lit(False)),
        }
    ).drop(*PAIR)


def h2h_hits(stats: DataFrame) -> DataFrame:
    """One row per match and side at or above the threshold."""
    side = lambda flag, name, count, pct: F.when(
        F.col(flag), F.struct(F.lit(name).alias("type"), F.col(count).alias("count"), F.col(pct).alias("percent"))
    )
    found = F.array(side("over_hit", "大球", "over_count", "over_percent"), side("under_hit", "小球", "under_count", "under_percent"))
    rows = stats.select("match_id", "sample_count", "history", F.inline(F.filter(found, lambda s: s.isNotNull())))
    text_ = F.concat(
        F.lit("近"), F.col("sample_count"), F.lit("次對賽，"), F.col("type"), F.col("count"), F.lit("次（"),
        F.regexp_replace(F.col("percent").cast("string"), r"\.0$", ""), F.lit("%）"),
    )
    return rows.withColumn("description", text_)


# Market name and outcome names per odds type.
_TYPE_NAMES = {"LETGOAL": ("让球", "赢", "走", "输"), "OU": ("总进球数", "大", "走", "小")}


def probability_events(stats: DataFrame, threshold: float = 80, min_n: int = 10) -> DataFrame:
    """Outcomes at or above the threshold, from one sample per company and odds type.

    The sample is the first `Ten` entry that is large enough, else the first large enough one.
    """
    ready = stats.where(
        (F.col("kind") == "ALL") & F.col("odds_type").isin(*_TYPE_NAMES) & (F.coalesce("n", F.lit(0)) >= min_n)
    )
    order = F.struct((F.col("count_type") != "Ten").cast("int").alias("r"), F.col("pos"))
    name = F.max(F.col("company_name")) if "company_name" in stats.columns else F.lit("")
    best = ready.groupBy("match_id", "company_id", "odds_type").agg(
        F.min_by(F.struct("n", "win_scale", "draw_scale", "loss_scale"), order).alias("s"), name.alias("company_name")
    )
    pick = lambda i: F.when(F.col("odds_type") == "OU", F.lit(_TYPE_NAMES["OU"][i])).otherwise(F.lit(_TYPE_NAMES["LETGOAL"][i]))
    outcome = lambda i, f: F.struct(pick(i).alias("type"), F.col(f"s.{f}").cast("double").alias("percent"))
    events = best.select(
        "match_id", "company_id", "company_name", "odds_type", pick(0).alias("market"), F.col("s.n").alias("count"),
        F.inline(F.array(outcome(1, "win_scale"), outcome(2, "draw_scale"), outcome(3, "loss_scale"))),
    ).where(F.col("percent") >= threshold)
    text_ = F.concat(F.lit("近"), F.col("count"), F.lit("场"), F.coalesce("company_name", F.lit("")), F.lit("相同"), F.col("market"))
    return events.withColumn("description", text_).dropDuplicates(
        ["match_id", "company_id", "odds_type", "type", "percent", "description"]
    )


def sample_count_in_text(col: Column) -> Column:
    """N of `近N场` in a description."""
    return F.regexp_extract(col, r"近\s*(\d+)\s*[场場]", 1).try_cast("int")
