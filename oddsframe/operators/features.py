"""Market features, conflict and confidence scores.

`market_blocks` reduces all quotes to one row per match, market and period with partially
mergeable aggregates; everything after it works on at most five rows per match.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oddsframe import dims
from oddsframe.functions import odds

LOW_WATER, HIGH_WATER = 0.82, 1.0


def _mean(col: Column, unit: int = odds.TICK) -> Column:
    """Mean from whole ticks: exact sums, the same whatever the task order."""
    return F.sum(odds.ticks(col, unit)).cast("double") / F.lit(float(unit)) / F.count(col)


def _spread(col: Column) -> Column:
    """Population deviation; 0 for fewer than two values."""
    t = odds.ticks(col).cast("double")
    n, total, squares = F.count(col), F.sum(odds.ticks(col)).cast("double"), F.sum((t * t).cast("long")).cast("double")
    variance = F.greatest(F.lit(0.0), (squares - total * total / n) / n)
    return F.when(n < 2, F.lit(0.0)).otherwise(F.sqrt(variance) / F.lit(float(odds.TICK)))


def _mean_of(*cols: Column) -> Column:
    """Mean of the values that are present."""
    total = reduce(lambda a, b: a + b, [F.coalesce(c, F.lit(0.0)) for c in cols])
    count = reduce(lambda a, b: a + b, [c.isNotNull().cast("int") for c in cols])
    return F.when(count > 0, total / count)


def market_blocks(quotes: DataFrame) -> DataFrame:
    """Aggregates per (match_id, market, period).

    Median and distinct bookmakers merge as value counts and small sets, so a match with very
    many rows is reduced before the shuffle as well.
    """
    a, draw, b, line = (F.col(f"cur_{c}") for c in ("a", "draw", "b", "line"))
    ia, idraw, ib, iline = (F.col(f"ini_{c}") for c in ("a", "draw", "b", "line"))
    low = (F.coalesce(a, F.lit(0.0)) <= LOW_WATER) | (F.coalesce(b, F.lit(0.0)) <= LOW_WATER)
    high = (F.coalesce(a, F.lit(0.0)) >= HIGH_WATER) | (F.coalesce(b, F.lit(0.0)) >= HIGH_WATER)
    share = odds.implied(a, draw, b)
    book = F.nullif(F.col("bookmaker"), F.lit(""))
    if "company" in quotes.columns:  # a bookmaker outside the known groups counts under its own name
        book = F.coalesce(book, F.nullif(F.col("company"), F.lit("")))
    raw = quotes.groupBy("match_id", "market", "period").agg(
        F.count(F.lit(1)).alias("rows"),
        F.size(F.collect_set(book)).alias("bookmaker_count"),
        F.collect_set(book).alias("bookmakers"),
        _mean(a).alias("avg_a"),
        _mean(draw).alias("avg_draw"),
        _mean(b).alias("avg_b"),
        *[_mean(v, odds.SHARE_TICK).alias(k) for k, v in share.items()],
        F.median(line).alias("line_median"),
        _mean(F.abs(line - iline)).alias("line_move"),
        F.count_if(low).alias("low_water"),
        F.count_if(high).alias("high_water"),
        F.count_if(F.col("is_multi_line")).alias("multi_line"),
        F.count_if(F.col("is_closed")).alias("closed"),
        *[_spread(c).alias(f"_sd_{n}") for n, c in (("a", a), ("draw", draw), ("b", b), ("line", line))],
        *[_mean(F.abs(c - i)).alias(f"_mv_{n}") for n, c, i in (("a", a, ia), ("draw", draw, idraw), ("b", b, ib))],
    )
    europe = F.col("market") == "europe"
    mean3 = lambda x, y, z: (x + y + z) / F.lit(3.0)
    spread = F.when(europe, mean3(F.col("_sd_a"), F.col("_sd_draw"), F.col("_sd_b"))).otherwise(
        mean3(F.col("_sd_a"), F.col("_sd_b"), F.col("_sd_line"))
    )
    move = F.when(europe, _mean_of(F.col("_mv_a"), F.col("_mv_draw"), F.col("_mv_b"))).otherwise(
        _mean_of(F.col("_mv_a"), F.col("_mv_b"))
    )
    price_digits = lambda c: F.when(europe, odds.round_n(c, 2)).otherwise(odds.round_n(c, 3))
    return raw.select(
        "match_id", "market", "period", "rows", "bookmaker_count", "bookmakers",
        price_digits(F.col("avg_a")).alias("avg_a"),
        odds.round_n(F.col("avg_draw"), 2).alias("avg_draw"),
        price_digits(F.col("avg_b")).alias("avg_b"),
        *[odds.round_n(F.col(k), 4).alias(k) for k in share],
        F.when(europe, odds.favourite(F.col("fair_home"), F.col("fair_away"))).alias("favourite"),
        odds.round_n(F.col("line_median"), 3).alias("line_median"),
        odds.round_n(F.col("line_move"), 3).alias("line_move"),
        "low_water", "high_water", "multi_line", "closed",
        odds.round_n(spread, 4).alias("disagreement"),
        odds.round_n(move, 4).alias("odds_move"),
    )


def europe_features(quotes: DataFrame) -> DataFrame:
    return market_blocks(quotes.where(F.col("market") == "europe")).select(
        "match_id", "rows", "bookmaker_count", F.col("avg_a").alias("avg_win"), "avg_draw",
        F.col("avg_b").alias("avg_loss"), F.col("overround").alias("avg_overround"), "fair_home", "fair_draw",
        "fair_away", F.col("favourite").alias("favorite"), "disagreement", "odds_move",
    )


def _two_way(quotes: DataFrame, market: str, period: str, first: str, third: str) -> DataFrame:
    rows = quotes.where((F.col("market") == market) & (F.col("period") == period))
    return market_blocks(rows).select(
        "match_id", "rows", "bookmaker_count", "line_median", "line_move", F.col("avg_a").alias(first),
        F.col("avg_b").alias(third), "low_water", "high_water", "multi_line", "closed", "disagreement", "odds_move",
    )


def asian_features(quotes: DataFrame, period: str = "full") -> DataFrame:
    return _two_way(quotes, "asian", period, "home_odds_avg", "away_odds_avg")


def over_under_features(quotes: DataFrame, period: str = "full") -> DataFrame:
    return _two_way(quotes, "over_under", period, "over_odds_avg", "under_odds_avg")


_EUROPE_FIELDS = ["overround", "favourite", "disagreement", "odds_move"]
_LINE_FIELDS = ["line_median", "line_move", "avg_a", "avg_b", "low_water", "high_water", "multi_line", "closed",
                "disagreement", "odds_move"]
_SHORT = {"asianFull": "af", "asianHalf": "ah", "overUnderFull": "of", "overUnderHalf": "oh", "europe": "eu"}


def match_blocks(quotes: DataFrame) -> DataFrame:
    """The five blocks of a match side by side, prefixed eu_ af_ ah_ of_ oh_."""
    aggs = [F.sum("rows").alias("row_count"), F.array_distinct(F.flatten(F.collect_list("bookmakers"))).alias("_books")]
    for key, market, period, _ in dims.MARKET_BUCKETS:
        p = _SHORT[key]
        here = F.col("market") == market
        if market != "europe":
            here = here & (F.col("period") == period)
        fields = _EUROPE_FIELDS if market == "europe" else _LINE_FIELDS
        aggs += [F.coalesce(F.sum(F.when(here, F.col(c))), F.lit(0)).alias(f"{p}_{c}") for c in ("rows", "bookmaker_count")]
        aggs += [F.max(F.when(here, F.col(c))).alias(f"{p}_{c}") for c in fields]
    # europe rows count for their market whatever their period says
    rows = quotes.withColumn("period", F.when(F.col("market") == "europe", F.lit("full")).otherwise(F.col("period")))
    wide = market_blocks(rows).groupBy("match_id").agg(*aggs)
    absent = {f"{p}_disagreement": F.coalesce(F.col(f"{p}_disagreement"), F.lit(0.0)) for p in _SHORT.values()}
    for name in ("low_water", "high_water", "multi_line", "closed"):
        absent |= {f"{p}_{name}": F.coalesce(F.col(f"{p}_{name}"), F.lit(0)) for p in ("af", "ah", "of", "oh")}
    absent["eu_favourite"] = F.coalesce(F.col("eu_favourite"), F.lit("不明"))
    return wide.withColumns(absent).withColumn("bookmaker_count", F.size("_books")).drop("_books")


def _conflict_rules() -> list[tuple[str, Column, int]]:
    """(flag title, condition, points); a rule without points only raises the flag."""
    c = F.col
    zero = lambda name: F.coalesce(c(name), F.lit(0.0))
    any_of = lambda name: (zero(f"af_{name}") > 0) | (zero(f"of_{name}") > 0)
    return [
        ("缺少歐洲賠率，真實價格層不足", c("eu_rows") == 0, 0),
        ("缺少亞盤全場，讓球驗證不足", c("af_rows") == 0, 0),
        ("缺少大小全場，入球節奏驗證不足", c("of_rows") == 0, 0),
        ("歐賠 overround 偏高", c("eu_overround") > 1.08, 10),
        ("莊家分歧偏高", (zero("eu_disagreement") > 0.12) | (zero("af_disagreement") > 0.08) | (zero("of_disagreement") > 0.08), 18),
        ("盤口有明顯移動", (zero("af_line_move") >= 0.25) | (zero("of_line_move") >= 0.25), 16),
        ("水位或歐賠波動偏大", (zero("af_odds_move") >= 0.08) | (zero("of_odds_move") >= 0.08) | (zero("eu_odds_move") >= 0.12), 14),
        ("出現 1.00+ 高水位置", any_of("high_water"), 12),
        ("出現 0.82 或以下低水位置", any_of("low_water"), 8),
        ("有封盤資料列", any_of("closed"), 12),
        ("多盤資料存在，主盤需要再確認", any_of("multi_line"), 10),
        ("歐賠偏主，但亞盤主隊水位偏高", (c("eu_favourite") == "主") & (zero("af_avg_a") >= HIGH_WATER), 16),
        ("歐賠偏客，但亞盤客隊水位偏高", (c("eu_favourite") == "客") & (zero("af_avg_b") >= HIGH_WATER), 16),
        ("大球盤偏高但細球低水", (zero("of_line_median") >= 3) & (zero("of_avg_b") <= LOW_WATER), 12),
        # missing counts as zero here, so a match without totals raises it as well
        ("入球盤偏低但大球低水", (zero("of_line_median") <= 2.25) & (zero("of_avg_a") <= LOW_WATER), 12),
    ]


def match_features(quotes: DataFrame) -> DataFrame:
    """Blocks, flags, conflict score, confidence score and levels per match."""
    c = F.col
    rules = [(title, F.coalesce(cond, F.lit(False)), points) for title, cond, points in _conflict_rules()]
    missing = sum((c(f"{p}_rows") == 0).cast("int") for p in ("eu", "af", "of"))
    points = sum(F.when(cond, F.lit(pts)).otherwise(F.lit(0)) for _, cond, pts in rules if pts) + missing * 8
    coverage = sum(
        F.when(c(f"{p}_rows") > 0, F.lit(w)).otherwise(F.lit(0))
        for p, w in (("eu", 24), ("af", 24), ("of", 24), ("ah", 8), ("oh", 8))
    ) + F.least(F.lit(12), F.greatest(*[c(f"{p}_bookmaker_count") for p in ("eu", "af", "of")]) * 2)
    calm = (
        (F.coalesce(c("eu_disagreement"), F.lit(0.0)) <= 0.08)
        & (F.coalesce(c("af_disagreement"), F.lit(0.0)) <= 0.06)
        & (F.coalesce(c("of_disagreement"), F.lit(0.0)) <= 0.06)
    )
    clarity = (
        F.lit(25)
        + F.when(c("eu_favourite").isin("主", "客"), 22).otherwise(0)
        + F.when(c("af_line_median").isNotNull(), 18).otherwise(0)
        + F.when(c("of_line_median").isNotNull(), 15).otherwise(0)
        + F.when(calm, 20).otherwise(0)
    )
    flags = F.filter(F.array(*[F.when(cond, F.lit(title)) for title, cond, _ in rules]), lambda f: f.isNotNull())
    wide = match_blocks(quotes).withColumns(
        {
            "conflict_score": odds.clamp(points, 0, 100).cast("int"),
            "_coverage": odds.clamp(coverage, 0, 100).cast("double"),
            "_clarity": odds.clamp(clarity, 0, 100).cast("double"),
            "flags": flags,
        }
    )
    confidence = c("_coverage") * 0.42 + (F.lit(100.0) - c("conflict_score")) * 0.38 + c("_clarity") * 0.2
    out = wide.withColumn("confidence_score", odds.round_n(odds.clamp(confidence, 0.0, 100.0), 1))
    return out.withColumns(
        {
            "conflict_level": odds.risk_label(c("conflict_score")),
            "confidence_level": odds.confidence_label(c("confidence_score")),
            "flag_count": F.size("flags"),
        }
    ).drop("_coverage", "_clarity")


def snapshot_summary(features: DataFrame, rows: str = "row_count") -> DataFrame:
    """One summary row over per-match features."""
    mean = lambda name: odds.round_n(F.coalesce(_mean(F.col(name)), F.lit(0.0)), 1)
    out = features.agg(
        F.count(F.lit(1)).alias("match_count"),
        F.coalesce(F.sum(rows), F.lit(0)).cast("long").alias("row_count"),
        F.coalesce(F.sum("flag_count"), F.lit(0)).cast("long").alias("conflict_count"),
        F.count_if(F.col("conflict_score") >= 70).alias("high_risk_count"),
        mean("conflict_score").alias("avg_conflict_score"),
        mean("confidence_score").alias("avg_confidence_score"),
    )
    return out.withColumn("pressure", odds.pressure_label(F.col("avg_conflict_score")))


def top_risks(features: DataFrame, k: int = 8, order: str = "match_id") -> DataFrame:
    """Highest conflict scores; ties keep input order (`order`)."""
    return features.orderBy(F.desc("conflict_score"), F.asc(order)).limit(k)


def top_confidence(features: DataFrame, k: int = 10, order: str = "match_id") -> DataFrame:
    return features.orderBy(F.desc("confidence_score"), F.asc(order)).limit(k)


def pool_hit_features(hits: DataFrame) -> DataFrame:
    """Per match: distinct pools, rules and prices among its hits, conflict and confidence.

    Distinct rules and pools are few; hits of one rule and price merge before the shuffle.
    """
    c = F.col
    per = hits.groupBy(F.coalesce(F.nullif(c("front_end_id"), F.lit("")), c("match_id"), F.lit("unknown")).alias("match_id")).agg(
        F.count(F.lit(1)).alias("hit_count"),
        F.sort_array(F.collect_set(F.nullif(c("pool"), F.lit("")))).alias("pools"),
        F.sort_array(F.collect_set(F.nullif(c("rule"), F.lit("")))).alias("rules"),
        F.sort_array(F.collect_set(F.nullif(c("odds"), F.lit("")))).alias("odds"),
    )
    starts = lambda *heads: F.exists("rules", lambda r: reduce(lambda x, y: x | y, [r.startswith(h) for h in heads]))
    n, pools, rules = c("hit_count"), F.size("pools"), F.size("rules")
    had, totals = starts("HAD_"), starts("HIL_", "FHL_")
    draw = F.exists("rules", lambda r: r.isin("FHA_DRAW_1.76", "HHA_DRAW_3.10"))
    flag_rules = [
        ("命中指定價位，需要用其他市場交叉驗證", F.lit(True), F.lit(25)),
        ("同一賽事多次命中", n > 1, F.least(F.lit(20), n * 6)),
        ("多個彩池同時命中", pools > 1, F.least(F.lit(18), pools * 6)),
        ("主客和完整組合命中", had, F.lit(15)),
        ("和局相關價位命中", draw, F.lit(10)),
        ("入球大細價位命中", totals, F.lit(8)),
    ]
    score = reduce(lambda x, y: x + y, [F.when(cond, pts).otherwise(F.lit(0)) for _, cond, pts in flag_rules])
    out = per.withColumns(
        {
            "conflict_score": odds.clamp(score, 0, 100).cast("int"),
            "flags": F.filter(F.array(*[F.when(cond, F.lit(t)) for t, cond, _ in flag_rules]), lambda f: f.isNotNull()),
            "_base": F.lit(35) + F.least(F.lit(20), n * 5) + F.least(F.lit(16), pools * 8) + F.least(F.lit(14), rules * 4)
            + F.when(had, 12).otherwise(0) + F.when(totals, 6).otherwise(0),
        }
    )
    confidence = c("_base") - F.greatest(F.lit(0), c("conflict_score") - 75) * 0.25
    out = out.withColumn("confidence_score", odds.round_n(odds.clamp(confidence.cast("double"), 0.0, 100.0), 1))
    return out.withColumns(
        {
            "conflict_level": odds.risk_label(c("conflict_score")),
            "confidence_level": odds.confidence_label(c("confidence_score")),
            "flag_count": F.size("flags"),
        }
    ).drop("_base")


def crowd_features(rows: DataFrame) -> DataFrame:
    """Concentration flags and scores of crowd support rows."""
    zero = lambda name: F.coalesce(F.col(name), F.lit(0))
    asian = F.greatest(zero("asian_home_percent"), zero("asian_away_percent"))
    total = F.greatest(zero("over_percent"), zero("under_percent"))
    asian_edge = F.coalesce(odds.edge(F.col("asian_home_percent"), F.col("asian_away_percent")), F.lit(0))
    total_edge = F.coalesce(odds.edge(F.col("over_percent"), F.col("under_percent")), F.lit(0))
    level = lambda v: F.when(v >= 80, F.lit("danger")).when(v >= 70, F.lit("warning"))
    out = rows.withColumns(
        {
            "asian_flag": level(asian),
            "total_flag": level(total),
            "conflict_score": odds.clamp(F.greatest(asian_edge, total_edge), 0, 100),
            "confidence_score": odds.clamp(F.greatest(asian, total), 0, 100),
        }
    )
    raised = F.col("asian_flag").isNotNull().cast("int") + F.col("total_flag").isNotNull().cast("int")
    return out.withColumns(
        {
            "flag_count": F.greatest(raised, F.lit(1)),  # none raised: one "observe" flag
            "conflict_level": odds.risk_label(F.col("conflict_score")),
            "confidence_level": odds.confidence_label(F.col("confidence_score")),
        }
    )


def crowd_hot(rows: DataFrame, threshold: int = 70) -> DataFrame:
    """Largest percentage and edge of a crowd row, and whether it is hot."""
    limit = max(1, min(threshold, 100))
    zero = lambda name: F.coalesce(F.col(name), F.lit(0))
    top = F.greatest(*[zero(c) for c in ("asian_home_percent", "asian_away_percent", "over_percent", "under_percent")])
    edges = [
        F.coalesce(odds.edge(F.col(a), F.col(b)), F.lit(0))
        for a, b in (("asian_home_percent", "asian_away_percent"), ("over_percent", "under_percent"))
    ]
    return rows.withColumns({"max_percent": top, "max_edge": F.greatest(*edges), "hot": top >= limit})
