"""Price, line, score and label column helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from oddsframe import dims

# Odds carry at most four decimals.  Sums are taken over whole ticks so that a result
# does not depend on task order or on retried tasks, unlike floating-point sums.
TICK = 10_000
SHARE_TICK = 1_000_000_000


def ticks(col: Column, unit: int = TICK) -> Column:
    return F.round(col * F.lit(float(unit))).cast("long")


def round_n(col: Column, digits: int = 0) -> Column:
    """Half-up rounding with plain arithmetic, the same on every engine."""
    unit = float(10**digits)
    return F.floor(col * F.lit(unit) + F.lit(0.5)).cast("double") / F.lit(unit)


def clamp(col: Column, low, high) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), col))


def norm_odds(col: Column) -> Column:
    """Two-decimal text of a price; other text unchanged; missing is ''."""
    raw = F.trim(F.coalesce(col.cast("string"), F.lit("")))
    number = raw.try_cast("decimal(18,6)")
    return F.when(raw == "", F.lit("")).when(number.isNull(), raw).otherwise(number.cast("decimal(18,2)").cast("string"))


def same_odds(left: Column, right: Column) -> Column:
    return norm_odds(left) == norm_odds(right)


def hk_odds(decimal_odds: Column) -> Column:
    """Net price: decimal odds less the stake."""
    return (decimal_odds.cast("decimal(18,6)") - F.lit(1)).cast("decimal(18,2)")


def decimal_odds(net: Column) -> Column:
    return (net.cast("decimal(18,6)") + F.lit(1)).cast("decimal(18,2)")


def line_value(condition: Column) -> Column:
    """Mean of a split line such as -1.0/-1.5; NULL if any part is not a number."""
    parts = F.transform(F.split(condition, "/"), lambda p: F.trim(p).try_cast("double"))
    total = F.aggregate(parts, F.lit(0.0), lambda acc, p: acc + p)
    return F.when(F.trim(condition) != "", total / F.size(parts))


def implied(win: Column, draw: Column, loss: Column) -> dict[str, Column]:
    """Overround and fair shares; NULL unless the three prices are present and not zero."""
    ok = (win != 0) & (draw != 0) & (loss != 0)
    raw = {side: F.when(ok, F.lit(1.0) / price) for side, price in (("home", win), ("draw", draw), ("away", loss))}
    over = raw["home"] + raw["draw"] + raw["away"]
    return {"overround": over} | {f"fair_{side}": value / over for side, value in raw.items()}


def favourite(home: Column, away: Column) -> Column:
    return (
        F.when(home.isNull() | away.isNull(), F.lit("不明"))
        .when(home - away > 0.06, F.lit("主"))
        .when(away - home > 0.06, F.lit("客"))
        .otherwise(F.lit("接近"))
    )


def _level(score: Column, high: int, middle: int, top: str = "高", low: str = "低") -> Column:
    return F.when(score >= high, F.lit(top)).when(score >= middle, F.lit("中")).otherwise(F.lit(low))


def risk_label(score: Column) -> Column:
    return _level(score, 70, 40)


def confidence_label(score: Column) -> Column:
    return _level(score, 72, 50)


def pressure_label(score: Column) -> Column:
    return _level(score, 70, 40, top="強", low="弱")


def lean(left: Column, right: Column, left_name: str, right_name: str) -> Column:
    """Side with the larger percentage; a missing side counts as zero."""
    a, b = F.coalesce(left, F.lit(0)), F.coalesce(right, F.lit(0))
    return F.when(a > b, F.lit(left_name)).when(b > a, F.lit(right_name)).otherwise(F.lit("balanced"))


def edge(left: Column, right: Column) -> Column:
    return F.abs(left - right)


def score_text(home: Column, away: Column) -> Column:
    ready = (F.coalesce(home, F.lit("")) != "") & (F.coalesce(away, F.lit("")) != "")
    return F.when(ready, F.concat_ws("-", home, away)).otherwise(F.lit(""))


# State code -> label.
STATE_LABELS = {"-1": "完場", "0": "未開", "1": "上半場", "2": "中場", "3": "下半場", "4": "加時", "5": "點球"}


def state_label(code: Column) -> Column:
    out = F.when(code.isNull(), F.lit(""))
    for key, label in STATE_LABELS.items():
        out = out.when(code == key, F.lit(label))
    return out.otherwise(code)


def _score_number(raw: Column) -> Column:
    """A score text as home * 100 + away: four digits (each up to 20), two digits, or h:a."""
    t = F.trim(F.translate(raw, "０１２３４５６７８９：－", "0123456789:-"))
    digits = t.try_cast("int")
    four = F.when((digits >= 0) & (F.floor(digits / 100) <= 20) & (digits % 100 <= 20), digits)
    two = F.when(digits >= 0, F.floor(digits / 10).cast("int") * 100 + digits % 10)
    pattern = r"(\d{1,2})\s*[:：\-]\s*(\d{1,2})"
    split = F.regexp_extract(t, pattern, 1).try_cast("int") * 100 + F.regexp_extract(t, pattern, 2).try_cast("int")
    plain = F.when(F.length(t) == 4, four).when(F.length(t) == 2, two)
    return F.when(digits.isNotNull() & t.rlike(r"^\d+$"), plain).otherwise(split)


def parse_score(*texts: Column) -> Column:
    """struct(home, away, label) of the first text that reads as a score."""
    return _as_score(F.coalesce(*[_score_number(t) for t in texts]))


def parse_score_list(texts: Column) -> Column:
    """The same over an array of texts."""
    found = F.filter(F.transform(texts, lambda t: _score_number(t)), lambda n: n.isNotNull())
    return _as_score(F.try_element_at(found, F.lit(1)))


def _as_score(number: Column) -> Column:
    home, away = F.floor(number / 100).cast("int"), (number % 100).cast("int")
    label = F.concat(home.cast("string"), F.lit(":"), away.cast("string"))
    return F.when(number.isNotNull(), F.struct(home.alias("home"), away.alias("away"), label.alias("label")))


def price(df, name: str = "odds") -> Column:
    """Price column as decimal(18,2), NULL where it is no number; text is parsed, numbers are not."""
    kind = df.schema[name].dataType.typeName()
    col = F.col(name)
    if kind in ("string", "varchar", "char"):
        col = F.trim(col).try_cast("decimal(18,6)")
    return col.cast("decimal(18,2)")


def source_page(pool: Column) -> Column:
    """Page name of a pool type."""
    out = None
    for kind, page in dims.POOL_PAGES.items():
        out = F.when(pool == kind, F.lit(page)) if out is None else out.when(pool == kind, F.lit(page))
    return out.otherwise(F.lower(pool))


def section_key(market: Column, period: Column) -> Column:
    return _bucket(market, period, 0)


def section_label(market: Column, period: Column) -> Column:
    return _bucket(market, period, 3)


def _bucket(market: Column, period: Column, field: int) -> Column:
    out = None
    for bucket in dims.MARKET_BUCKETS:
        hit = (market == bucket[1]) & (period == bucket[2])
        out = F.when(hit, F.lit(bucket[field])) if out is None else out.when(hit, F.lit(bucket[field]))
    return out
