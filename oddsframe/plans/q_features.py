"""Queries of the feature operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from oddsframe.functions import odds
from oddsframe.operators import features as A
from oddsframe.operators import quotes as Q
from oddsframe.plans.fx import ctes, fx
from oddsframe.plans.q_quotes import ORDER, quotes
from oddsframe.plans.registry import query
from oddsframe.plans.sqltext import KEYED, MAIN, mean, rn, spread

RAW = f"with {ctes('fx_quotes')}, {KEYED}"
_OK = "cur_a <> 0 and cur_draw <> 0 and cur_b <> 0"
_OVER = f"case when {_OK} then 1.0/cur_a + 1.0/cur_draw + 1.0/cur_b end"
_FAIR = {
    s: f"case when {_OK} then (1.0/{c}) / (1.0/cur_a + 1.0/cur_draw + 1.0/cur_b) end"
    for s, c in (("home", "cur_a"), ("draw", "cur_draw"), ("away", "cur_b"))
}


def _mean_of(*cols):
    total = " + ".join(f"coalesce({c}, 0.0)" for c in cols)
    count = " + ".join(f"(case when {c} is null then 0 else 1 end)" for c in cols)
    return f"(case when {count} > 0 then ({total}) / ({count}) end)"


def _move(name, where="true"):
    return mean(f"abs(cur_{name} - ini_{name})", where=where)


def eu_fields(where):
    fh, fa = (mean(_FAIR[s], 1_000_000_000, where) for s in ("home", "away"))
    return {
        "rows": f"count(*) filter ({where})",
        "bookmaker_count": f"count(distinct coalesce(bookmaker, 'Book ' || company_id)) filter ({where})",
        "avg_a": rn(mean("cur_a", where=where), 2),
        "avg_draw": rn(mean("cur_draw", where=where), 2),
        "avg_b": rn(mean("cur_b", where=where), 2),
        "overround": rn(mean(_OVER, 1_000_000_000, where), 4),
        **{f"fair_{s}": rn(mean(_FAIR[s], 1_000_000_000, where), 4) for s in _FAIR},
        "favourite": f"case when {fh} is null or {fa} is null then '不明' when {fh} - {fa} > 0.06 then '主'"
        f" when {fa} - {fh} > 0.06 then '客' else '接近' end",
        "disagreement": rn(
            f"({spread('cur_a', where)} + {spread('cur_draw', where)} + {spread('cur_b', where)}) / 3.0", 4
        ),
        "odds_move": rn(_mean_of(_move("a", where), _move("draw", where), _move("b", where)), 4),
    }


def line_fields(where):
    low = f"({where}) and (coalesce(cur_a, 0) <= 0.82 or coalesce(cur_b, 0) <= 0.82)"
    high = f"({where}) and (cur_a >= 1.0 or cur_b >= 1.0)"
    return {
        "rows": f"count(*) filter ({where})",
        "bookmaker_count": f"count(distinct coalesce(bookmaker, 'Book ' || company_id)) filter ({where})",
        "line_median": rn(f"median(cur_line) filter ({where})", 3),
        "line_move": rn(_move("line", where), 3),
        "avg_a": rn(mean("cur_a", where=where), 3),
        "avg_b": rn(mean("cur_b", where=where), 3),
        "low_water": f"count(*) filter ({low})",
        "high_water": f"count(*) filter ({high})",
        "multi_line": f"count(*) filter (({where}) and is_multi_line)",
        "closed": f"count(*) filter (({where}) and is_closed)",
        "disagreement": rn(
            f"({spread('cur_a', where)} + {spread('cur_b', where)} + {spread('cur_line', where)}) / 3.0", 4
        ),
        "odds_move": rn(_mean_of(_move("a", where), _move("b", where)), 4),
    }


def _cols(fields, rename=None):
    return ", ".join(f"{sql} as {(rename or {}).get(name, name)}" for name, sql in fields.items())


_EU_NAMES = {"avg_a": "avg_win", "avg_b": "avg_loss", "overround": "avg_overround", "favourite": "favorite"}


def named(spark, sf):
    """Quotes with the company name that an unknown bookmaker counts under."""
    return Q.identify_bookmaker(quotes(spark, sf)).withColumn("company", F.concat(F.lit("Book "), "company_id"))


@query(
    "a1_europe_features",
    f"{RAW} select match_id, {_cols(eu_fields('true'), _EU_NAMES)} from keyed where market = 'europe' group by match_id",
)
def europe(spark, sf):
    return A.europe_features(named(spark, sf))


def _two_way(name, market, first, third, run):
    for period in ("full", "half"):
        sql = (
            f"{RAW} select match_id, {_cols(line_fields('true'), {'avg_a': first, 'avg_b': third})} from keyed"
            f" where market = '{market}' and period = '{period}' group by match_id"
        )
        query(f"{name}_{period}", sql)(
            lambda spark, sf, period=period: run(named(spark, sf), period)
        )


_two_way("a2_asian_features", "asian", "home_odds_avg", "away_odds_avg", A.asian_features)
_two_way("a3_over_under_features", "over_under", "over_odds_avg", "under_odds_avg", A.over_under_features)

_BUCKETS = {
    "eu": "market = 'europe'",
    "af": "market = 'asian' and period = 'full'",
    "ah": "market = 'asian' and period = 'half'",
    "of": "market = 'over_under' and period = 'full'",
    "oh": "market = 'over_under' and period = 'half'",
}


def _features_sql() -> str:
    blocks = []
    for p, where in _BUCKETS.items():
        fields = eu_fields(where) if p == "eu" else line_fields(where)
        blocks.append(", ".join(f"{sql} as {p}_{name}" for name, sql in fields.items()))
    any_of = lambda n: f"(af_{n} > 0 or of_{n} > 0)"
    rules = [
        ("缺少歐洲賠率，真實價格層不足", "eu_rows = 0", 0),
        ("缺少亞盤全場，讓球驗證不足", "af_rows = 0", 0),
        ("缺少大小全場，入球節奏驗證不足", "of_rows = 0", 0),
        ("歐賠 overround 偏高", "eu_overround > 1.08", 10),
        ("莊家分歧偏高", "eu_disagreement > 0.12 or af_disagreement > 0.08 or of_disagreement > 0.08", 18),
        ("盤口有明顯移動", "af_line_move >= 0.25 or of_line_move >= 0.25", 16),
        ("水位或歐賠波動偏大", "af_odds_move >= 0.08 or of_odds_move >= 0.08 or eu_odds_move >= 0.12", 14),
        ("出現 1.00+ 高水位置", any_of("high_water"), 12),
        ("出現 0.82 或以下低水位置", any_of("low_water"), 8),
        ("有封盤資料列", any_of("closed"), 12),
        ("多盤資料存在，主盤需要再確認", any_of("multi_line"), 10),
        ("歐賠偏主，但亞盤主隊水位偏高", "eu_favourite = '主' and af_avg_a >= 1.0", 16),
        ("歐賠偏客，但亞盤客隊水位偏高", "eu_favourite = '客' and af_avg_b >= 1.0", 16),
        ("大球盤偏高但細球低水", "of_line_median >= 3 and coalesce(of_avg_b, 0) <= 0.82", 12),
        ("入球盤偏低但大球低水", "coalesce(of_line_median, 0) <= 2.25 and coalesce(of_avg_a, 0) <= 0.82", 12),
    ]
    on = lambda cond: f"coalesce({cond}, false)"
    score = " + ".join(f"case when {on(c)} then {p} else 0 end" for _, c, p in rules if p)
    score += " + 8 * ((eu_rows = 0)::int + (af_rows = 0)::int + (of_rows = 0)::int)"
    flags = "concat_ws('|', " + ", ".join(f"case when {on(c)} then '{t}' end" for t, c, _ in rules) + ")"
    n_flags = " + ".join(f"{on(c)}::int" for _, c, _ in rules)
    coverage = (
        "least(100, 24 * ((eu_rows > 0)::int + (af_rows > 0)::int + (of_rows > 0)::int) + 8 * ((ah_rows > 0)::int + (oh_rows > 0)::int)"
        " + least(12, 2 * greatest(eu_bookmaker_count, af_bookmaker_count, of_bookmaker_count)))"
    )
    clarity = (
        "least(100, 25 + case when eu_favourite in ('主', '客') then 22 else 0 end + case when af_line_median is not null then 18 else 0 end"
        " + case when of_line_median is not null then 15 else 0 end + case when coalesce(eu_disagreement, 0) <= 0.08"
        " and coalesce(af_disagreement, 0) <= 0.06 and coalesce(of_disagreement, 0) <= 0.06 then 20 else 0 end)"
    )
    confidence = rn(
        "greatest(0.0::double, least(100.0::double, coverage::double * 0.42::double + (100.0::double - conflict_score) * 0.38::double"
        " + clarity::double * 0.2::double))", 1,
    )
    return (
        f"{RAW}, {MAIN}, blocks as (select match_id, count(*) row_count, count(distinct bookmaker) bookmaker_count, {', '.join(blocks)}"
        f" from main group by match_id), scored as (select *, least(100, {score}) conflict_score, {flags} flags, {n_flags} flag_count,"
        f" {coverage} coverage, {clarity} clarity from blocks), feats as (select *, {confidence} confidence_score from scored)"
    )


FEATS = _features_sql()
_BLOCK_COLS = [
    "eu_rows", "eu_overround", "eu_favourite", "eu_disagreement", "eu_odds_move", "af_rows", "af_line_median", "af_line_move",
    "af_avg_a", "af_avg_b", "af_low_water", "af_high_water", "of_rows", "of_line_median", "of_avg_a", "of_avg_b", "ah_rows", "oh_rows",
]
_FEATURE_COLS = [
    "match_id", "row_count", "bookmaker_count", *_BLOCK_COLS, "conflict_score", "conflict_level", "confidence_score",
    "confidence_level", "flag_count", "flags",
]
_LEVELS = (
    "case when conflict_score >= 70 then '高' when conflict_score >= 40 then '中' else '低' end conflict_level,"
    " case when confidence_score >= 72 then '高' when confidence_score >= 50 then '中' else '低' end confidence_level"
)


def features(spark, sf):
    return A.match_features(Q.filter_bookmakers(quotes(spark, sf), order=ORDER))


@query(
    "a4_match_features",
    f"{FEATS} select match_id, row_count, bookmaker_count, {', '.join(_BLOCK_COLS)}, conflict_score, confidence_score, flag_count,"
    f" flags, {_LEVELS} from feats",
)
def match_features(spark, sf):
    out = features(spark, sf).withColumn("flags", F.array_join("flags", "|"))
    return out.select(*_FEATURE_COLS)


@query(
    "a5_snapshot_summary",
    f"{FEATS}, s as (select count(*) match_count, cast(sum(row_count) as bigint) row_count, cast(sum(flag_count) as bigint) conflict_count,"
    f" count(*) filter (conflict_score >= 70) high_risk_count, {rn(mean('conflict_score'), 1)} avg_conflict_score,"
    f" {rn(mean('confidence_score'), 1)} avg_confidence_score from feats)"
    " select *, case when avg_conflict_score >= 70 then '強' when avg_conflict_score >= 40 then '中' else '弱' end pressure from s",
)
def summary(spark, sf):
    return A.snapshot_summary(features(spark, sf))


@query("w8_top_risks", f"{FEATS} select match_id, conflict_score from feats order by conflict_score desc, match_id limit 8")
def risks(spark, sf):
    return A.top_risks(features(spark, sf).select("match_id", "conflict_score"))


@query("w8_top_confidence", f"{FEATS} select match_id, confidence_score from feats order by confidence_score desc, match_id limit 10")
def confidence(spark, sf):
    return A.top_confidence(features(spark, sf).select("match_id", "confidence_score"))


_CROWD = """greatest(asian_home_percent, asian_away_percent) amax, greatest(over_percent, under_percent) tmax,
    abs(asian_home_percent - asian_away_percent) aedge, abs(over_percent - under_percent) tedge"""


@query(
    "a7_crowd_features",
    f"""with {ctes('fx_support')}, s as (select match_id, {_CROWD} from fx_support)
    select match_id, case when amax >= 80 then 'danger' when amax >= 70 then 'warning' else '' end asian_flag,
    case when tmax >= 80 then 'danger' when tmax >= 70 then 'warning' else '' end total_flag, least(100, greatest(aedge, tedge)) conflict_score,
    least(100, greatest(amax, tmax)) confidence_score, greatest(1, (amax >= 70)::int + (tmax >= 70)::int) flag_count,
    case when greatest(aedge, tedge) >= 70 then '高' when greatest(aedge, tedge) >= 40 then '中' else '低' end conflict_level,
    case when greatest(amax, tmax) >= 72 then '高' when greatest(amax, tmax) >= 50 then '中' else '低' end confidence_level from s""",
)
def crowd(spark, sf):
    out = A.crowd_features(fx(spark, sf, "fx_support"))
    blank = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    return out.select(
        "match_id", blank("asian_flag"), blank("total_flag"), "conflict_score", "confidence_score", "flag_count",
        "conflict_level", "confidence_level",
    )


@query(
    "x20_crowd_hot",
    f"""with {ctes('fx_support')}, s as (select match_id, {_CROWD} from fx_support) select match_id, greatest(amax, tmax) max_percent,
    greatest(aedge, tedge) max_edge, greatest(amax, tmax) >= 70 hot from s""",
)
def hot(spark, sf):
    return A.crowd_hot(fx(spark, sf, "fx_support")).select("match_id", "max_percent", "max_edge", "hot")


@query(
    "x19_lean_edge",
    f"""with {ctes('fx_support')} select match_id, case when asian_home_percent > asian_away_percent then 'home'
    when asian_away_percent > asian_home_percent then 'away' else 'balanced' end asian_lean,
    case when over_percent > under_percent then 'over' when under_percent > over_percent then 'under' else 'balanced' end total_lean,
    abs(asian_home_percent - asian_away_percent) asian_edge, abs(over_percent - under_percent) total_edge from fx_support""",
)
def leans(spark, sf):
    c = F.col
    return fx(spark, sf, "fx_support").select(
        "match_id",
        odds.lean(c("asian_home_percent"), c("asian_away_percent"), "home", "away").alias("asian_lean"),
        odds.lean(c("over_percent"), c("under_percent"), "over", "under").alias("total_lean"),
        odds.edge(c("asian_home_percent"), c("asian_away_percent")).alias("asian_edge"),
        odds.edge(c("over_percent"), c("under_percent")).alias("total_edge"),
    )
