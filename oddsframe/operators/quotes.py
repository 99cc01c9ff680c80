"""Quote operators: bookmaker identity, filtering, latest rows, source precedence, coverage.

A quote table holds match_id, market (asian / over_under / europe), period, company_id,
is_multi_line, is_closed, changed_at, cur_*/ini_* prices and, where order matters, an
increasing `source_index`.  Optional: company, english_name, bookmaker_key.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from oddsframe import dims
from oddsframe.functions.text import norm_name, normed, text


def _opt(df: DataFrame, name: str, kind: str = "string") -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast(kind)


def company_dim(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(dims.company_rows(), "market string, company_id string, id_key string")


def bookmaker_from_names(*names: Column) -> Column:
    """First bookmaker group, in fixed order, whose alias fits one of the normalised names."""
    out = None
    for key, _, aliases in dims.BOOKMAKERS:
        hit = F.lit(False)
        for alias in dict.fromkeys(normed(norm_name, tuple(aliases))):
            if not alias:
                continue
            fits = F.startswith if len(alias) <= 1 or alias.isdigit() else F.contains
            for name in names:
                hit = hit | ((name != "") & fits(name, F.lit(alias)))
        out = F.when(hit, F.lit(key)) if out is None else out.when(hit, F.lit(key))
    return out


def infer_market(df: DataFrame) -> Column:
    """Market of a row; a row without one but with three-way prices is europe."""
    three_way = F.lit(False)
    for name in ("win", "draw", "loss", "cur_draw"):
        if name in df.columns:
            three_way = three_way | (text(F.col(name)) != "")
    known = F.col("market").isin("asian", "over_under", "europe")
    return F.when(known, F.col("market")).when(three_way, F.lit("europe")).otherwise(F.lit(""))


def identify_bookmaker(quotes: DataFrame) -> DataFrame:
    """Add bookmaker_key and bookmaker (label): by (market, company id), else by name."""
    spark = quotes.sparkSession
    company, english = _opt(quotes, "company"), _opt(quotes, "english_name")
    named = quotes.withColumns({"_m": infer_market(quotes), "_cid": F.trim(text(F.col("company_id")))})
    by_id = F.broadcast(company_dim(spark).toDF("_m", "_cid", "_id_key"))  # fixed 32 rows
    joined = named.join(by_id, ["_m", "_cid"], "left")
    key = F.col("_id_key")
    if "company" in quotes.columns or "english_name" in quotes.columns:
        joined = joined.withColumns({"_n1": norm_name(company), "_n2": norm_name(english)})
        key = F.coalesce(key, bookmaker_from_names(F.col("_n1"), F.col("_n2")))
    labels = F.create_map(*[F.lit(v) for pair in dims.BOOKMAKER_LABELS.items() for v in pair])
    out = joined.withColumn("bookmaker_key", key).withColumn("bookmaker", F.try_element_at(labels, F.col("bookmaker_key")))
    return out.drop("_m", "_cid", "_id_key", "_n1", "_n2")


def bookmaker_rank(key: Column) -> Column:
    """Output order of bookmakers; unknown ones last."""
    order = F.array(*[F.lit(k) for k in dims.bookmaker_order()])
    at = F.array_position(order, key)
    return F.when(at > 0, at).otherwise(F.lit(len(dims.BOOKMAKERS) + 1)).cast("int")


def resolve_bookmakers(spark: SparkSession, names: list[str]) -> list[str]:
    """Keys for a caller's list of keys, labels or aliases (a handful of literals)."""
    known = set(dims.BOOKMAKER_LABELS)
    rows = spark.createDataFrame([(n,) for n in names], "name string").withColumn("n", norm_name(F.col("name")))
    keyed = rows.select("name", F.coalesce(bookmaker_from_names(F.col("n")), F.col("n")).alias("k")).collect()
    return [r.name if r.name in known else r.k for r in keyed]


def _struct_all(df: DataFrame) -> Column:
    return F.struct(*df.columns)


def pick_first(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key, the least by `order`.

    An aggregate with partial merge, so a key with very many rows sends one row per task.
    """
    picked = df.groupBy(*keys).agg(F.min_by(_struct_all(df), F.struct(*order)).alias("_r"))
    return picked.select("_r.*")


def pick_last(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    picked = df.groupBy(*keys).agg(F.max_by(_struct_all(df), F.struct(*order)).alias("_r"))
    return picked.select("_r.*")


def latest_quote(quotes: DataFrame, index: str = "source_index", extra_keys: tuple[str, ...] = ("match_id",)) -> DataFrame:
    """Last changed row per bookmaker; rows without a time rank by their index, ties keep the later row."""
    blank = lambda name: F.nullif(_opt(quotes, name), F.lit(""))
    key = F.coalesce(
        *[blank(c) for c in ("bookmaker_key", "company_id", "company", "english_name")],
        F.concat(F.lit("row-"), F.col(index).cast("string")),
    )
    when = F.coalesce(F.unix_micros(F.col("changed_at").cast("timestamp")) / 1000, F.col(index).cast("double"))
    keyed = quotes.withColumns({"_key": key, "_when": when})
    return pick_last(keyed, [*extra_keys, "_key"], [F.col("_when"), F.col(index)]).drop("_key", "_when")


def dedupe_main_line(quotes: DataFrame, order: tuple[str, ...] = ("source_index",)) -> DataFrame:
    """One row per bookmaker and section: a main line before a multi line, then source order."""
    keyed = quotes.where(F.coalesce(F.col("bookmaker_key"), F.lit("")) != "")
    rank = F.coalesce(F.col("is_multi_line"), F.lit(False)).cast("int")
    return pick_first(keyed, ["match_id", "market", "period", "bookmaker_key"], [rank, *[F.col(c) for c in order]])


def filter_bookmakers(
    quotes: DataFrame,
    keys: list[str] | None = None,
    keep_all: bool = False,
    dedupe: bool = True,
    order: tuple[str, ...] = ("source_index",),
) -> DataFrame:
    """Identify, keep the wanted bookmakers (default four), one main row each.

    Adds `bookmaker_rank`; output order is (bookmaker_rank, source order).
    """
    out = identify_bookmaker(quotes)
    if not keep_all:
        wanted = resolve_bookmakers(quotes.sparkSession, keys) if keys else dims.TARGET_BOOKMAKERS
        out = out.where(F.col("bookmaker_key").isin(*wanted))
        if dedupe:
            out = dedupe_main_line(out, order)
    return out.withColumn("bookmaker_rank", bookmaker_rank(F.col("bookmaker_key")))


def carry_forward(df: DataFrame, col: str, keys: list[str], block: Column, order: list[str]) -> DataFrame:
    """Last non-empty value of `col` up to each row, per key.

    Rows are cut into ordered blocks: the running value is worked out inside each block, and
    one summary row per block carries it over.  No key has to fit into a single task.
    `block` must not decrease along `order`.
    """
    rows = df.withColumns({"_b": block, "_v": F.nullif(F.col(col), F.lit(""))})
    inside = F.last("_v", ignorenulls=True).over(
        W.partitionBy(*keys, "_b").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    )
    at = F.struct(*order)
    per_block = rows.groupBy(*keys, "_b").agg(F.max_by("_v", F.when(F.col("_v").isNotNull(), at)).alias("_last"))
    before = F.last("_last", ignorenulls=True).over(
        W.partitionBy(*keys).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    )
    carried = per_block.select(*keys, "_b", before.alias("_before"))
    joined = rows.withColumn("_in", inside).alias("r").join(
        carried.alias("c"), [F.col(f"r.{k}").eqNullSafe(F.col(f"c.{k}")) for k in [*keys, "_b"]], "left"
    )
    return joined.select(
        *[F.col(f"r.{c}") for c in df.columns], F.coalesce("r._in", "c._before").alias(f"{col}_carried")
    )


_SECTION = ["match_id", "market", "period"]


def merge_market_sources(primary: DataFrame, supplement: DataFrame, official: bool = False) -> DataFrame:
    """Per section, supplement rows first, then primary rows of other bookmakers.

    Unknown bookmakers match each other (null-safe), as one group.  An official supplement is
    ignored where the primary already quotes that operator.  Adds `merge_rank`.
    """
    first, second = identify_bookmaker(supplement), identify_bookmaker(primary)
    if official:
        has = second.where(F.col("bookmaker_key") == "hk_jockey").select(*_SECTION).distinct()
        first = first.join(has, _SECTION, "left_anti")
    taken = first.select(*_SECTION, F.col("bookmaker_key").alias("_k")).distinct()
    cond = [second[c] == taken[c] for c in _SECTION] + [second["bookmaker_key"].eqNullSafe(taken["_k"])]
    kept = second.join(taken, cond, "left_anti")
    return first.withColumn("merge_rank", F.lit(0)).unionByName(
        kept.withColumn("merge_rank", F.lit(1)), allowMissingColumns=True
    )


_FEEDS = ("pages", "mobile", "comparison", "official")


def resolve_market_sources(
    pages: DataFrame, mobile: DataFrame, comparison: DataFrame, official: DataFrame, deep: bool = False
) -> DataFrame:
    """Two-way sections from four feeds.

    deep: page rows of a section if any, else the mobile snapshot; fast: every section of a
    match from its mobile snapshot if there is one, else from its pages.  Then the comparison
    overlay, then the official feed for matches that lack its operator in asian full, totals
    full or totals half; asian half is never filled.

    The feeds become one table.  What each match has (small sets of sections and bookmakers) is one
    aggregate over its narrow columns, and every row is kept or left out by that.
    """
    feeds = [df.withColumn("_feed", F.lit(name)) for name, df in zip(_FEEDS, (pages, mobile, comparison, official))]
    rows = identify_bookmaker(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), feeds))
    section = F.concat("market", F.lit("|"), "period")
    book = F.concat(section, F.lit("|"), F.coalesce("bookmaker_key", F.lit("?")))
    operator = F.col("bookmaker_key") == "hk_jockey"
    fillable = (F.col("market") == "over_under") | ((F.col("market") == "asian") & (F.col("period") == "full"))
    feed = lambda name: F.col("_feed") == name
    found = lambda value, cond: F.collect_set(F.when(cond, value))
    keyed = rows.withColumns({"_section": section, "_book": book, "_fill": fillable})
    have = keyed.groupBy("match_id").agg(
        found(F.col("_section"), feed("pages")).alias("_pages"), F.max(feed("mobile")).alias("_any_mobile"),
        found(F.col("_book"), feed("comparison")).alias("_compared"), found(F.col("_book"), feed("official") & F.col("_fill")).alias("_supplied"),
        *[found(F.col("_section"), feed(n) & operator).alias(f"_hk_{n}") for n in ("pages", "mobile", "comparison")],
    )
    if deep:
        base_hk = F.concat("_hk_pages", F.array_except("_hk_mobile", "_pages"))
    else:
        base_hk = F.when(F.col("_any_mobile"), F.col("_hk_mobile")).otherwise(F.col("_hk_pages"))
    quoted = F.array_union("_hk_comparison", base_hk)
    complete = F.size(F.filter(quoted, lambda s: ~s.startswith("asian|") | (s == "asian|full"))) == 3
    have = have.select("match_id", "_pages", "_any_mobile", "_compared", "_supplied", quoted.alias("_quoted"), complete.alias("_complete"))
    joined = keyed.join(have.withColumnRenamed("match_id", "_match"), F.col("match_id") == F.col("_match"), "left")
    among = lambda names, value: F.coalesce(F.array_contains(names, F.col(value)), F.lit(False))
    base = feed("pages") | (feed("mobile") & ~among("_pages", "_section")) if deep else feed("mobile") | (feed("pages") & ~F.coalesce("_any_mobile", F.lit(False)))
    merged = feed("comparison") | (base & ~among("_compared", "_book"))
    filled = ~F.coalesce("_complete", F.lit(False)) & ~among("_quoted", "_section")
    keep = (merged & ~(filled & among("_supplied", "_book"))) | (feed("official") & F.col("_fill") & filled)
    return joined.where(keep).drop("_feed", "_section", "_book", "_fill", "_match", *[c for c in have.columns if c != "match_id"])


def section_keys(quotes: DataFrame) -> DataFrame:
    return quotes.select(*_SECTION).distinct()


def coverage_gaps(quotes: DataFrame, expected: list[str] | None = None) -> DataFrame:
    """Expected bookmakers a section lacks; the expected list rides along as a literal array."""
    wanted = expected or dims.TARGET_BOOKMAKERS
    have = filter_bookmakers(quotes, dedupe=False, keep_all=True)
    per = have.groupBy(*_SECTION).agg(
        *[F.max((F.col("bookmaker_key") == k).cast("int")).alias(f"_{k}") for k in wanted]
    )
    missing = F.filter(
        F.array(*[F.when(F.coalesce(F.col(f"_{k}"), F.lit(0)) == 0, F.lit(k)) for k in wanted]), lambda k: k.isNotNull()
    )
    return per.select(*_SECTION, F.explode(missing).alias("bookmaker_key"))


def market_coverage(quotes: DataFrame, expected: list[str] | None = None) -> DataFrame:
    """Per section: raw rows, kept rows, covered / missing / optional bookmakers and the x/n label."""
    wanted = expected or dims.TARGET_BOOKMAKERS
    targets = dims.TARGET_BOOKMAKERS
    known = identify_bookmaker(quotes)
    present = {k: F.max((F.col("bookmaker_key") == k).cast("int")) for k in dict.fromkeys([*wanted, *targets])}
    per = known.groupBy(*_SECTION).agg(
        F.count(F.lit(1)).alias("raw_rows"), *[F.coalesce(v, F.lit(0)).alias(f"_{k}") for k, v in present.items()]
    )

    def keys(names, flag):
        return F.filter(
            F.array(*[F.when(F.col(f"_{k}") == flag, F.lit(k)) for k in names]), lambda k: k.isNotNull()
        )

    covered, missing = keys(targets, 1), keys(wanted, 0)
    hit = keys(wanted, 1)
    labels = F.create_map(*[F.lit(v) for pair in dims.BOOKMAKER_LABELS.items() for v in pair])
    return per.select(
        *_SECTION,
        "raw_rows",
        F.size(covered).alias("kept_rows"),
        F.size(covered).alias("covered_count"),
        covered.alias("covered"),
        missing.alias("missing"),
        F.transform(missing, lambda k: F.coalesce(F.try_element_at(labels, k), k)).alias("missing_labels"),
        F.array_except(covered, F.array(*[F.lit(k) for k in wanted])).alias("optional"),
        F.concat_ws("/", F.size(hit).cast("string"), F.lit(str(len(wanted)))).alias("coverage_label"),
    )


def candidate_score(sections: DataFrame, expected: int = 4) -> DataFrame:
    """Best fetched candidate per section and whether it should be fetched again.

    The score prefers more target bookmakers, then more rows, and marks down cut-off pages;
    the first candidate wins ties.
    """
    score = (
        F.col("books") * 1000 + F.col("kept_rows") * 10 + F.col("raw_rows")
        - F.when(F.coalesce(F.col("incomplete"), F.lit(False)), 5000).otherwise(0)
    )
    best = pick_first(sections.withColumn("score", score), ["match_id", "section"], [-F.col("score"), F.col("source_index")])
    weak = (F.col("books") < min(7, expected)) & (F.col("raw_rows") < 20)
    return best.withColumn(
        "retry", F.coalesce(F.col("incomplete"), F.lit(False)) | (F.col("raw_rows") == 0) | weak
    )


# The flat row's columns, in order.
FLAT_COLUMNS = [
    "matchId", "league", "kickoffTime", "state", "score", "home", "away", "market", "period", "bookmaker",
    "bookmakerKey", "company", "companyId", "isClosed", "isMultiLine", "multi", "initialHomeOdds",
    "initialHandicap", "initialHandicapValue", "initialAwayOdds", "currentHomeOdds", "currentHandicap",
    "currentHandicapValue", "currentAwayOdds", "initialOverOdds", "initialTotal", "initialTotalValue",
    "initialUnderOdds", "currentOverOdds", "currentTotal", "currentTotalValue", "currentUnderOdds", "initialWin",
    "initialDraw", "initialLoss", "currentWin", "currentDraw", "currentLoss", "currentWinRate",
    "currentDrawRate", "currentLossRate", "currentReturnRate", "kellyWin", "kellyDraw", "kellyLoss", "changedAt",
]


def flatten_quotes(quotes: DataFrame, matches: DataFrame) -> DataFrame:
    """The flat odds row: each market fills its own columns, the rest is NULL.

    Every quote gives one row; a match without data leaves its columns NULL, of a repeated match
    the first row counts (by `source_index` where there is one).
    """
    meta_names = {"match_id": "match_id", "league": "league", "kickoff_ts": "kickoffTime", "state": "state",
                  "score": "score", "home": "home", "away": "away"}
    first = F.struct(*([F.col("source_index")] if "source_index" in matches.columns else []), *[f"m_{n}" for n in meta_names.values()])
    meta = matches.select("*", *[_opt(matches, c).cast("string").alias(f"m_{n}") for c, n in meta_names.items()])
    meta = meta.groupBy("m_match_id").agg(*[F.min_by(f"m_{n}", first).alias(f"m_{n}") for c, n in meta_names.items() if c != "match_id"])
    joined = quotes.join(meta, quotes["match_id"] == meta["m_match_id"], "left")
    asian, totals, europe = (F.col("market") == m for m in ("asian", "over_under", "europe"))
    flag = lambda name: F.when(~europe, F.when(F.coalesce(F.col(name), F.lit(False)), F.lit("1")).otherwise(F.lit("0")))
    pick = lambda cond, name: F.when(cond, _opt(quotes, name))
    late = lambda name: F.when(
        europe, F.coalesce(F.nullif(_opt(quotes, f"cur_{name}").cast("string"), F.lit("")), _opt(quotes, name).cast("string"))
    )
    early = lambda name: F.when(
        europe, F.coalesce(F.nullif(_opt(quotes, name).cast("string"), F.lit("")), _opt(quotes, f"cur_{name}").cast("string"))
    )
    cols = {
        "matchId": F.col("match_id"),
        **{n: F.col(f"m_{n}") for n in ("league", "kickoffTime", "state", "score", "home", "away")},
        "market": F.col("market"),
        "period": F.when(europe, F.lit("full")).otherwise(F.col("period")),
        "bookmaker": _opt(quotes, "bookmaker"),
        "bookmakerKey": _opt(quotes, "bookmaker_key"),
        "company": _opt(quotes, "company"),
        "companyId": F.col("company_id"),
        "isClosed": flag("is_closed"),
        "isMultiLine": flag("is_multi_line"),
        "multi": F.when(~europe & F.col("is_multi_line"), _opt(quotes, "multi_label")),
    }
    for side, when in (("initial", "ini"), ("current", "cur")):
        line = F.coalesce(_opt(quotes, f"{when}_line_text"), _opt(quotes, f"{when}_line").cast("string"))
        cols |= {
            f"{side}HomeOdds": pick(asian, f"{when}_a"),
            f"{side}Handicap": F.when(asian, line),
            f"{side}HandicapValue": pick(asian, f"{when}_line"),
            f"{side}AwayOdds": pick(asian, f"{when}_b"),
            f"{side}OverOdds": pick(totals, f"{when}_a"),
            f"{side}Total": F.when(totals, line),
            f"{side}TotalValue": pick(totals, f"{when}_line"),
            f"{side}UnderOdds": pick(totals, f"{when}_b"),
            f"{side}Win": pick(europe, f"{when}_a"),
            f"{side}Draw": pick(europe, f"{when}_draw"),
            f"{side}Loss": pick(europe, f"{when}_b"),
        }
    cols |= {
        "currentWinRate": late("win_rate"),
        "currentDrawRate": late("draw_rate"),
        "currentLossRate": late("loss_rate"),
        "currentReturnRate": late("return_rate"),
        "kellyWin": early("kelly_win"),
        "kellyDraw": early("kelly_draw"),
        "kellyLoss": early("kelly_loss"),
        "changedAt": F.when(europe, F.col("changed_at").cast("string")),
    }
    return joined.select(*[cols[c].alias(c) for c in FLAT_COLUMNS])


def union_markets(*blocks: DataFrame) -> DataFrame:
    """The market blocks as one table; columns a block lacks are NULL."""
    out = blocks[0]
    for block in blocks[1:]:
        out = out.unionByName(block, allowMissingColumns=True)
    return out
