"""Rule scans over pool prices.

A selection table holds match_id, front_end_id, kickoff_ts, status, pool, pool_status, line_id,
condition, main, line_status, sel, comb_status, odds, update_at and an increasing `sel_index`;
columns a scan does not need may be absent.  `names` (array) may hold further selection texts.
All scans group by (match, pool, line) with partial aggregates, so a match with very many
selections is reduced before the shuffle.  A table with `snapshot_id` holds several captures: prices
are compared within a capture only, and hits say which.  `latest_snapshot` keeps the newest.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oddsframe import dims
from oddsframe.functions import odds as X
from oddsframe.operators.quotes import pick_first
from oddsframe.operators.select import pool_window, pool_window_or_inplay

HIT_COLUMNS = [
    "snapshot_id", "match_id", "front_end_id", "kickoff_ts", "pool", "rule", "rule_label", "line_id", "line", "selection", "odds",
    "home_odds", "draw_odds", "away_odds", "total_goals", "score_count", "source_page",
]
_TYPES = {"kickoff_ts": "timestamp_ntz", "total_goals": "int", "score_count": "int"}
_ORDER = ("sel_index",)


def _match(df: DataFrame) -> list[str]:
    """What tells a capture of a match apart."""
    return ["snapshot_id", "match_id"] if "snapshot_id" in df.columns else ["match_id"]


def latest_snapshot(sel: DataFrame) -> DataFrame:
    """The rows of each match's newest capture."""
    newest = sel.groupBy("match_id").agg(F.max("snapshot_id").alias("snapshot_id"))
    return sel.join(newest, ["match_id", "snapshot_id"], "left_semi")


def _opt(df: DataFrame, name: str) -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast(_TYPES.get(name, "string"))


def _hits(df: DataFrame, *extra: str) -> DataFrame:
    """Common hit layout."""
    out = df.withColumn("source_page", X.source_page(F.col("pool")))
    return out.select(*[_opt(out, c).cast(_TYPES.get(c, "string")).alias(c) for c in HIT_COLUMNS], *extra)


def _carry(df: DataFrame) -> list[Column]:
    """Match attributes carried through a grouping; equal on all rows of a match."""
    return [F.max(_opt(df, c)).alias(c) for c in ("front_end_id", "kickoff_ts")]


def _last(value: Column, where: Column, order) -> Column:
    """Value of the last row that fits."""
    return F.max_by(value, F.when(where, F.struct(*order)))


def scan_three_way(sel: DataFrame, order=_ORDER) -> DataFrame:
    """Home or away at a wanted price, and the two full price triples, per HAD line."""
    rows = sel.where(F.col("pool") == "HAD").withColumn("_o", X.price(sel))
    line = rows.groupBy(*_match(rows), "pool", "line_id").agg(
        *_carry(rows), *[_last(F.col("_o"), F.col("sel") == s, order).alias(s) for s in "HDA"]
    )
    line = line.withColumns({s: F.col(s).cast("string") for s in "HDA"})
    prices = {s: F.coalesce(F.col(s), F.lit("")) for s in "HDA"}
    hit = lambda cond, rule, label, side: F.when(
        cond, F.struct(F.lit(rule).alias("rule"), F.lit(label).alias("rule_label"), F.lit(side).alias("selection"), prices[side].alias("odds"))
    )
    found = []
    for price in dims.THREE_WAY_SIDE_PRICES:
        for side in "HA":
            found.append(hit(prices[side] == price, f"HAD_HOME_AWAY_{price}", f"主客和 主/客 {price}", side))
    for triple, side in ((("2.14", "3.00", "3.00"), "H"), (("3.00", "3.00", "2.14"), "A")):
        cond = (prices["H"] == triple[0]) & (prices["D"] == triple[1]) & (prices["A"] == triple[2])
        found.append(hit(cond, "HAD_" + "_".join(triple), "主客和 " + " / ".join(triple), side))
    out = line.select("*", F.inline(F.filter(F.array(*found), lambda h: h.isNotNull())))
    return _hits(out.withColumns({"home_odds": F.col("H"), "draw_odds": F.col("D"), "away_odds": F.col("A")}))


def price_rule_dim(spark, rules=None) -> DataFrame:
    rows = [(p, s, price, f"{p}_{infix}_{price}", label) for p, sides, price, infix, label in (rules or dims.PRICE_RULES) for s in (sides or [None])]
    dim = spark.createDataFrame(rows, "pool string, side string, price string, rule string, rule_label string")
    return dim.withColumn("price", F.col("price").cast("decimal(18,2)"))


def scan_price_rules(sel: DataFrame, rules=None) -> DataFrame:
    """Selections at a rule's price.  The rule table is a fixed handful of rows, joined by broadcast."""
    dim = F.broadcast(price_rule_dim(sel.sparkSession, rules)).alias("d")
    rows = sel.withColumns({"_o": X.price(sel), "selection": F.col("sel")}).alias("s")
    cond = (
        (F.col("s.pool") == F.col("d.pool"))
        & (F.col("s._o") == F.col("d.price"))
        & (F.col("d.side").isNull() | (F.col("d.side") == F.col("s.sel")))
    )
    out = rows.join(dim, cond).select("s.*", "d.rule", "d.rule_label")
    out = out.drop("odds").withColumnRenamed("_o", "odds")
    if "condition" in out.columns:
        out = out.withColumn("line", F.col("condition"))
    return _hits(out)


def scan_special_odds(sel: DataFrame, now: Column, hours: int = 24, order=_ORDER) -> DataFrame:
    """Price scans of the special pools for matches that start inside the window."""
    kinds = [t for p in dims.SPECIAL_POOLS for t in dims.POOL_TYPES[p]]
    rows = pool_window(sel, now, hours).where(F.col("pool").isin(*kinds))
    return scan_three_way(rows, order).unionByName(scan_price_rules(rows))


def scan_summary(sel: DataFrame, hits: DataFrame, now: Column, hours: int = 24) -> DataFrame:
    """Scanned matches and hits."""
    zero = F.lit(0).cast("long")
    scanned = pool_window(sel, now, hours).agg(F.count_distinct(F.struct(*_match(sel))).alias("scanned_matches")).withColumn("hit_count", zero)
    found = hits.agg(F.count(F.lit(1)).alias("hit_count")).withColumn("scanned_matches", zero)
    return scanned.unionByName(found).agg(*[F.max(c).alias(c) for c in ("scanned_matches", "hit_count")])


def correct_scores(sel: DataFrame) -> DataFrame:
    """Correct-score selections with a readable score and a price below the display limit."""
    score = X.parse_score(*[F.col(c) for c in ("sel_name", "sel") if c in sel.columns])
    if "names" in sel.columns:
        score = F.coalesce(score, X.parse_score_list(F.col("names")))
    rows = sel.where(F.col("pool").isin("CRS", "FCS")).withColumn("_o", X.price(sel))
    rows = rows.where(F.col("_o") < dims.MAX_SCORE_ODDS).withColumn("_s", score).where(F.col("_s").isNotNull())
    rows = rows.withColumn("_o", F.col("_o").cast("string"))
    return rows.withColumns({"score": F.col("_s.label"), "total": F.col("_s.home") + F.col("_s.away")})


def score_entries(sel: DataFrame, order=_ORDER) -> DataFrame:
    """Correct-score selections with repeats of a (line, score, price) merged: when it came first and last."""
    rows, at = correct_scores(sel), F.struct(*order)
    return rows.groupBy(*_match(rows), "pool", "line_id", "total", "score", "_o").agg(*_carry(rows), F.min(at).alias("_first"), F.max(at).alias("_last"))


def _equal_totals(entries: DataFrame) -> DataFrame:
    rows = entries.where(F.col("pool") == "CRS")
    groups = rows.groupBy(*_match(rows), "pool", "line_id", "total", "_o").agg(
        *_carry(rows), F.sort_array(F.collect_list(F.struct("_first", "score"))).alias("_l")  # the scores of one total
    )
    total = F.col("total").cast("string")
    out = groups.where(F.size("_l") >= 2).withColumns(
        {
            "odds": F.col("_o"),
            "rule": F.concat(F.lit("CRS_SAME_TOTAL_"), total, F.lit("_ODDS_"), F.col("_o")),
            "rule_label": F.concat(F.lit("全場波膽：同總入球 "), total, F.lit(" 同賠率")),
            "line": F.concat(F.lit("總入球 "), total),
            "selection": F.array_join(F.transform("_l", lambda x: x["score"]), " / "),
            "total_goals": F.col("total"),
            "score_count": F.size("_l"),
        }
    )
    return _hits(out)


def equal_odds_by_total(sel: DataFrame, order=_ORDER) -> DataFrame:
    """Full-time scores of one goal total and one price, where two or more scores share them."""
    return _equal_totals(score_entries(sel, order))


def _score_table(entries: DataFrame, pool: Column, labels: list[str]) -> DataFrame:
    """One row per line with the last price of each wanted score in column `s_<label>`."""
    rows = entries.where(pool)
    return rows.groupBy(*_match(rows), "pool", "line_id").agg(
        *_carry(rows), *[F.max_by("_o", F.when(F.col("score") == s, F.col("_last"))).alias(f"s_{s}") for s in labels]
    )


def _pair_hits(table: DataFrame, found: list[Column]) -> DataFrame:
    return _hits(table.select("*", F.inline(F.filter(F.array(*found), lambda h: h.isNotNull()))))


def _pair(first: str, second: str, rule: Column, label: Column, line: Column, total) -> Column:
    a, b = F.col(f"`s_{first}`"), F.col(f"`s_{second}`")
    return F.when(
        a == b,
        F.struct(
            rule.alias("rule"), label.alias("rule_label"), line.alias("line"), F.lit(f"{first} / {second}").alias("selection"),
            a.alias("odds"), F.lit(total).cast("int").alias("total_goals"), F.lit(2).alias("score_count"),
        ),
    )


def _half_pairs(entries: DataFrame) -> DataFrame:
    table = _score_table(entries, F.col("pool") == "FCS", ["0:0", "1:0", "0:1"])
    found = []
    for other, side in (("1:0", "home"), ("0:1", "away")):
        rule = F.concat(F.lit(f"FCS_{side}_SAME_ODDS_00_{other.replace(':', '')}_"), F.col("`s_0:0`"))
        found.append(_pair("0:0", other, rule, F.lit(f"半場波膽：{other} 與 0:0 同賠率"), F.lit("半場波膽"), 1))
    return _pair_hits(table, found)


def half_score_pairs(sel: DataFrame, order=_ORDER) -> DataFrame:
    """Half-time 0:0 priced like 1:0 (home) or 0:1 (away)."""
    return _half_pairs(score_entries(sel, order))


def _pairs(entries: DataFrame, pairs) -> DataFrame:
    labels = list(dict.fromkeys(s for p in pairs for s in p))
    table = _score_table(entries, F.col("pool").isin("CRS", "FCS"), labels)
    prefix = F.when(F.col("pool") == "FCS", F.lit("半場波膽同賠率")).otherwise(F.lit("全場波膽同賠率"))
    found = []
    for a, b in pairs:
        digits = f"{a.replace(':', '')}_{b.replace(':', '')}"
        rule = F.concat(F.col("pool"), F.lit(f"_PAIR_{digits}_ODDS_"), F.col(f"`s_{a}`"))
        found.append(_pair(a, b, rule, F.concat(prefix, F.lit(f"：{a} / {b}")), prefix, None))
    return _pair_hits(table, found)


def score_pairs(sel: DataFrame, pairs=None, order=_ORDER) -> DataFrame:
    """Configured score pairs at one price in one line, full and half time."""
    return _pairs(score_entries(sel, order), pairs or dims.SCORE_PAIRS)


def _full_half(entries: DataFrame) -> DataFrame:
    side = lambda p: F.max(F.col("pool") == p)
    groups = entries.groupBy(*_match(entries), "score", "_o").agg(
        *_carry(entries), F.max("total").alias("total_goals"), side("CRS").alias("_full"), side("FCS").alias("_half"),
        F.array_sort(F.collect_set(F.nullif(F.col("line_id"), F.lit("")))).alias("_lines"),
    ).where("_full and _half")
    text = F.concat(F.lit("全場 "), F.col("score"), F.lit(" | 半場 "), F.col("score"))
    digits = F.replace(F.col("score"), F.lit(":"), F.lit(""))
    out = groups.withColumns(
        {
            "pool": F.lit("CRS/FCS"),
            "rule": F.concat(F.lit("CRS_FCS_SAME_SCORE_"), digits, F.lit("_ODDS_"), F.col("_o")),
            "rule_label": F.lit("全場/半場波膽同比分同賠率"),
            "line_id": F.array_join("_lines", " / "),
            "line": F.concat(F.lit("比分 "), F.col("score"), F.lit("：全場 vs 半場")),
            "selection": text,
            "odds": F.col("_o"),
            "score_count": F.lit(2),
        }
    )
    return _hits(out).withColumn("source_page", F.lit("crs"))


def full_half_equal_scores(sel: DataFrame) -> DataFrame:
    """A score at the same price in the full-time and the half-time pool: one grouping, no self-join."""
    return _full_half(score_entries(sel, ("pool",)))


HIT_KEY = ["match_id", "front_end_id", "pool", "rule", "line_id", "total_goals", "odds", "selection", "kickoff_ts"]


def dedupe_hits(hits: DataFrame, rank: str | None = None) -> DataFrame:
    """One hit per 9-field key and capture; the lowest `rank` wins, without one the rows are equal anyway."""
    key = [*(c for c in ("snapshot_id",) if c in hits.columns), *HIT_KEY]
    return hits.dropDuplicates(key) if rank is None else pick_first(hits, key, [F.col(rank)])


def prefer_pool_source(sel: DataFrame, rank: str = "source_rank") -> DataFrame:
    """Keep one source per match, capture and pool: the regular listing for full-time scores, else the first."""
    order = F.struct((F.col("pool").eqNullSafe("CRS") & (F.col("source") != "crs")).cast("int"), F.col(rank))
    key = [*_match(sel), "pool"]
    chosen = sel.groupBy(*key).agg(F.min_by("source", order).alias("source"))
    same = reduce(lambda a, b: a & b, [sel[c].eqNullSafe(chosen[c]) for c in [*key, "source"]])
    return sel.join(chosen, same, "left_semi")


# Fixed values: (listing source, wanted pool) of the score scan.
SCORE_REQUESTS = [("crs", "CRS"), ("inplay_all", "CRS"), ("fcs", "FCS")]


def first_pool_candidates(catalog: DataFrame) -> DataFrame:
    """Distinct (match, source, wanted pool) whose pool is on sale."""
    on_sale = F.coalesce("selling_pools", "normal_pools")
    wanted = [F.when(F.col("source") == s, F.lit(p)) for s, p in SCORE_REQUESTS]
    rows = catalog.withColumn("target_pool", F.coalesce(*wanted))
    return rows.where(F.array_contains(on_sale, F.col("target_pool"))).dropDuplicates(["match_id", "source", "target_pool"])


def scan_equal_scores(sel: DataFrame, now: Column, hours: int = 24, order=_ORDER) -> DataFrame:
    """All equal-price score scans inside the window (or in play), with their source.

    The selections merge to distinct (line, score, price) entries once; each scan is a grouping of those.
    """
    rows = pool_window_or_inplay(sel, now, hours)
    if "source" in rows.columns:
        rows = prefer_pool_source(rows)
    entries = score_entries(rows, order)
    found = [
        (_equal_totals(entries), F.lit("crs")), (_half_pairs(entries), F.lit("fcs")), (_pairs(entries, dims.SCORE_PAIRS), F.lower("pool")),
        (_full_half(entries), F.lit("crs_fcs")),
    ]
    return reduce(lambda a, b: a.unionByName(b), [hits.withColumn("source", source) for hits, source in found])


CLOSED = ("CLOSED", "REFUND", "ABANDONED", "CANCELLED", "SUSPENDED")  # fixed values: states of a pool that is not open


def open_pool(sel: DataFrame) -> Column:
    """Whether the selection's pool is open; a table without the column holds open pools only."""
    if "pool_status" not in sel.columns:
        return F.lit(True)
    status = F.upper(F.coalesce("pool_status", F.lit("")))
    return (status != "") & ~status.isin(*CLOSED)


def pool_quotes(sel: DataFrame) -> DataFrame:
    """Two-way quotes from the handicap (HDC) and totals (HIL, FHL) pools.

    Only available lines of open pools with both prices above 1; prices net of stake, handicap sign flipped.
    """
    rows = sel.where(
        F.col("pool").isin("HDC", "HIL", "FHL") & open_pool(sel) & (F.col("line_status") == "AVAILABLE") & (F.col("comb_status") == "AVAILABLE")
    )
    first = lambda s: F.min_by(F.col("odds").cast("decimal(18,6)"), F.when(s, F.col("sel_index")))
    asian = F.col("pool") == "HDC"
    third = F.when(asian, F.lit("A")).otherwise(F.lit("L"))
    key = _match(rows)
    lines = rows.groupBy(*key, "pool", "line_id").agg(
        F.max("condition").alias("condition"),
        F.coalesce(F.max("main"), F.lit(False)).alias("main"),
        F.max("update_at").alias("changed_at"),
        first(F.col("sel") == "H").alias("_a"),
        first(F.col("sel") == third).alias("_b"),
    )
    value = X.line_value(F.col("condition"))
    lines = lines.withColumn("_v", value).where((F.col("_a") > 1) & (F.col("_b") > 1) & F.col("_v").isNotNull())
    return lines.select(
        *key,
        F.when(asian, F.lit("asian")).otherwise(F.lit("over_under")).alias("market"),
        F.when(F.col("pool") == "FHL", F.lit("half")).otherwise(F.lit("full")).alias("period"),
        F.lit("48").alias("company_id"),
        F.lit("香港賽馬會").alias("company"),
        F.lit("official").alias("source"),
        F.lit(False).alias("is_closed"),
        (~F.col("main")).alias("is_multi_line"),
        F.when(F.col("main"), F.lit("")).otherwise(F.concat(F.lit("盤"), F.col("line_id"))).alias("multi_label"),
        X.hk_odds(F.col("_a")).cast("double").alias("cur_a"),
        X.hk_odds(F.col("_b")).cast("double").alias("cur_b"),
        F.when(asian, -F.col("_v")).otherwise(F.col("_v")).alias("cur_line"),
        "changed_at",
    )
