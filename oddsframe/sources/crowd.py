"""Crowd support pages.

Blocks of one page stay in the page's row, so repeats and match info are resolved without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oddsframe.functions import odds
from oddsframe.functions.rows import spread
from oddsframe.functions.text import absolute_url, block_text, let, text
from oddsframe.operators.features import crowd_hot

_Q = "[\"']"


def _kept(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c != "body"]


def _first(col: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract(col, pattern, group)


def _all(col: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(col, F.lit(pattern), F.lit(group))


def _attr(col: Column, name: str) -> Column:
    return block_text(_first(col, rf"(?is)\b{name}\s*=\s*([\"'])(.*?)\1", 2))


def _number(col: Column) -> Column:
    return _first(col, r"-?\d+(?:\.\d+)?", 0).try_cast("double")


def _team(block: Column, css: str) -> Column:
    tag = _first(block, rf"(?is)<div\s+class={_Q}[^\"']*{css}[^\"']*team[^\"']*{_Q}[^>]*>.*?</div>", 0)

    def read(tag, inner):
        plain = block_text(F.regexp_replace(inner, r"(?is)<span[^>]*>.*?</span>", ""))
        named = let(_attr(_first(tag, r"(?s)^<[^>]*>", 0), "teamname"), lambda n: F.coalesce(F.nullif(n, F.lit("")), plain))
        return F.struct(named.alias("name"), block_text(_first(inner, r"(?is)<span[^>]*>(.*?)</span>")).alias("rank"))

    return let(tag, lambda t: let(F.regexp_replace(t, r"(?is)^<div[^>]*>|</div>$", ""), lambda inner: read(t, inner)))


def _market(block: Column, prefix: str, left: str, right: str) -> Column:
    section = _first(
        block,
        rf"(?is)<div\s+id={_Q}{prefix}_jd_\d+{_Q}.*?"
        rf"(?=<div\s+id={_Q}(?:let|ou)_jd_\d+{_Q}|<div\s+class={_Q}GTeam\b|<div\s+id={_Q}IsExpert_|\z)",
        0,
    )
    percent = lambda s, css: _first(s, rf"(?i)<span\s+class={_Q}{css}{_Q}>\s*([\d.]+)%").try_cast("double")
    button = lambda side: _number(
        block_text(_first(block, rf"(?is)<div\s+id={_Q}{prefix}_{side}_\d+{_Q}.*?<span\s+class={_Q}btnZS{_Q}>(.*?)</span>"))
    )

    def read(s, line):
        return F.struct(
            block_text(line).alias("line"), _number(_attr(line, "odds")).alias("line_odds"), _number(_attr(s, "data-count")).alias("count"),
            percent(s, "hCount").alias("left"), percent(s, "gCount").alias("right"), button(left).alias("left_odds"), button(right).alias("right_odds"),
            _first(s, rf"(?i)class={_Q}bar{_Q}[^>]*style={_Q}[^\"']*width\s*:\s*([\d.]+)%").try_cast("double").alias("bar_width"),
        )

    # the section and its line are found once, not once for each value read from them
    return let(section, lambda s: let(_first(s, rf"(?is)<span\s+id={_Q}\d+_{prefix}{_Q}[^>]*>.*?</span>", 0), lambda line: read(s, line)))


def _unique(items: Column) -> Column:
    """Items whose id is seen for the first time."""
    def keep(xs):
        ids = F.transform(xs, lambda x: x["match_id"])
        return F.filter(xs, lambda x, i: (x["match_id"] != "") & (F.array_position(ids, x["match_id"]) == i + 1))

    return F.transform(F.array(items), keep)[0]


def _with_leans(df: DataFrame, threshold: int) -> DataFrame:
    c = F.col
    out = df.withColumns(
        {
            "asian_lean": odds.lean(c("asian_home_percent"), c("asian_away_percent"), "home", "away"),
            "total_lean": odds.lean(c("over_percent"), c("under_percent"), "over", "under"),
            "asian_edge": odds.edge(c("asian_home_percent"), c("asian_away_percent")),
            "total_edge": odds.edge(c("over_percent"), c("under_percent")),
        }
    )
    return crowd_hot(out, threshold)


def parse_crowd_index(df: DataFrame, threshold: int = 70) -> DataFrame:
    """One row per `match_position_n` block, the first block of a match wins."""
    pattern = (
        rf"(?is)<div\s+class={_Q}match{_Q}[^>]*id={_Q}match_position_\d+{_Q}.*?"
        rf"(?=<div\s+class={_Q}popupGuessTD{_Q}|<div\s+class={_Q}match{_Q}[^>]*id={_Q}match_position_|</form>|\z)"
    )

    def read(block):
        guess = _first(block, r"(?i)match_position_(\d+)")
        ids = [_first(block, rf"(?i)id={_Q}{p}_(\d+){_Q}") for p in ("time", "home", "let_jd")]
        return F.struct(F.coalesce(*[F.nullif(i, F.lit("")) for i in ids], guess).alias("match_id"), guess.alias("guess_id"), block.alias("b"))

    blocks = _unique(F.transform(_all(F.col("body"), pattern), read))
    rows = spread(df, _kept(df), blocks, "_x")
    b = F.col("_x.b")
    status = _first(b, rf"(?is)<div\s+class={_Q}game_guess{_Q}[^>]*>(.*?)</div>")
    league = F.regexp_replace(status, r"(?is)<i\b.*?</i>", "")
    score = lambda s: block_text(_first(b, rf"(?is)<span\s+id={_Q}{s}_score_\d+{_Q}[^>]*>(.*?)</span>"))
    rows = rows.withColumns(
        {
            "_h": _team(b, "HTeam"), "_g": _team(b, "GTeam"), "_let": _market(b, "let", "h", "g"), "_ou": _market(b, "ou", "o", "u"),
            "_hs": score("h"), "_as": score("g"),
        }
    )
    out = rows.select(
        *_kept(df), "pos", F.col("_x.match_id").alias("match_id"), F.col("_x.guess_id").alias("guess_id"),
        block_text(F.regexp_replace(league, r"(?is)<p\b.*?</p>", "")).alias("league"),
        block_text(_first(status, r"(?is)<i[^>]*>(.*?)</i>")).alias("kickoff_raw"),
        block_text(_first(b, rf"(?is)<span\s+class={_Q}time[^\"']*{_Q}[^>]*id={_Q}time_\d+{_Q}[^>]*>(.*?)</span>")).alias("state"),
        F.when((F.col("_hs") != "") | (F.col("_as") != ""), F.concat_ws("-", "_hs", "_as")).otherwise(F.lit("")).alias("score"),
        F.col("_h.name").alias("home"), F.col("_g.name").alias("away"), F.col("_h.rank").alias("home_rank"), F.col("_g.rank").alias("away_rank"),
        F.col("_let.line").alias("asian_line"), F.col("_let.line_odds").alias("asian_line_odds"), F.col("_let.count").alias("asian_count"),
        F.col("_let.left").alias("asian_home_percent"), F.col("_let.right").alias("asian_away_percent"),
        F.col("_let.left_odds").alias("asian_home_support_odds"), F.col("_let.right_odds").alias("asian_away_support_odds"),
        F.col("_let.bar_width").alias("asian_bar_width"), F.col("_ou.line").alias("total_line"),
        F.col("_ou.line_odds").alias("total_line_odds"), F.col("_ou.count").alias("total_count"), F.col("_ou.left").alias("over_percent"),
        F.col("_ou.right").alias("under_percent"), F.col("_ou.left_odds").alias("over_support_odds"),
        F.col("_ou.right_odds").alias("under_support_odds"), F.col("_ou.bar_width").alias("total_bar_width"),
    )
    return _with_leans(out, threshold)


def _info(block: Column) -> Column:
    title = block_text(_first(block, rf"(?is)<a[^>]+class={_Q}tit{_Q}.*?</a>", 0))
    teams = F.split(title, r"(?i)\s+VS\s+")
    part = lambda css, tag: block_text(_first(block, rf"(?is)<{tag}\s[^>]*class={_Q}{css}{_Q}.*?</{tag}>", 0))
    return F.struct(
        _first(block, r"(?i)matchinfo_(\d+)").alias("match_id"), part("league", "span").alias("league"),
        part("L-time", "span").alias("kickoff_raw"), part("time[^\"']*", "a").alias("state"),
        _first(block, rf"(?i)data-time={_Q}(.*?){_Q}").alias("data_time"), text(F.get(teams, F.lit(0))).alias("home"),
        text(F.get(teams, F.lit(1))).alias("away"),
    )


def _support(pairs: Column) -> Column:
    """Which of a block's percentage pairs is the handicap and which the totals one.

    By label; an unlabelled first pair is the handicap, an unlabelled second one the totals.
    """
    asian_word, total_word = "(?i)[亚亞让讓]|asian|handicap", "(?i)[大小]|total|over|under"
    marked = F.transform(pairs, lambda p, i: F.struct(p.alias("p"), i.alias("i")))
    is_total = lambda x: x["p"]["label"].rlike(total_word)
    asian = F.try_element_at(
        F.filter(marked, lambda x: x["p"]["label"].rlike(asian_word) | (~is_total(x) & (x["i"] == 0))), F.lit(1)
    )

    def rest(a):
        total = F.filter(marked, lambda x: (x["i"] != F.coalesce(a["i"], F.lit(-1))) & (is_total(x) | (x["i"] == 1)))
        return F.struct(a["p"].alias("asian"), F.try_element_at(total, F.lit(1))["p"].alias("total"))

    return F.transform(F.array(asian), rest)[0]


def parse_crowd_home(df: DataFrame, threshold: int = 70, base: str = "https://guess.example/") -> DataFrame:
    """Support bars of the home page with the league, kickoff and state of their match-info block."""
    info = rf"(?is)<div\s+class={_Q}title\s+matchinfo{_Q}[^>]*id={_Q}matchinfo_\d+{_Q}.*?(?=</div>\s*<ul|<div\s+class={_Q}title\s+matchinfo{_Q}|\z)"
    bar = rf"(?is)<div\s+class={_Q}guessBar{_Q}.*?(?=<div\s+class={_Q}guessBar{_Q}|<div\s+class={_Q}gl2\s+tabs{_Q}|\z)"
    link = r"(?i)(?:window\.open\(['\"]|href=['\"])([^'\"]*tuijian/\d+\.html[^'\"]*)"
    read = lambda b: F.struct(_first(_first(b, link), r"(?i)tuijian/(\d+)\.html").alias("match_id"), b.alias("b"))
    page = df.select(
        *_kept(df), F.transform(_all(F.col("body"), info), _info).alias("_infos"), _unique(F.transform(_all(F.col("body"), bar), read)).alias("_bars")
    )
    rows = spread(page, [*_kept(df), "_infos"], "_bars", "_x")
    b = F.col("_x.b")
    pair = rf"(?i)<span\s+class={_Q}hCount{_Q}>\s*([\d.]+)%\s*</span>\s*<span>\s*([^<]+?)\s*</span>\s*<span\s+class={_Q}gCount{_Q}>\s*([\d.]+)%"
    pairs = F.transform(
        _all(b, pair),
        lambda p: F.struct(
            block_text(_first(p, pair, 2)).alias("label"), _first(p, pair, 1).try_cast("double").alias("left"), _first(p, pair, 3).try_cast("double").alias("right")
        ),
    )
    rows = rows.withColumns(
        {
            "_i": F.try_element_at(F.filter("_infos", lambda x: x["match_id"] == F.col("_x.match_id")), F.lit(-1)),
            "_t": F.transform(_all(b, rf"(?is)<div\s+class={_Q}team{_Q}.*?<span>\s*(.*?)\s*</span>", 1), block_text),
            "_img": _all(b, rf"(?is)<div\s+class={_Q}team{_Q}[^<]*(?:<div[^>]*>\s*)?<img[^>]+src={_Q}([^\"']+)", 1),
            "_s": _support(pairs),
        }
    )
    name = lambda i, side: F.coalesce(F.nullif(F.get("_t", F.lit(i)), F.lit("")), F.col(f"_i.{side}"), F.lit(""))
    out = rows.select(
        *_kept(df), "pos", F.col("_x.match_id").alias("match_id"),
        *[text(F.col(f"_i.{c}")).alias(c) for c in ("league", "kickoff_raw", "state", "data_time")],
        name(0, "home").alias("home"), name(1, "away").alias("away"),
        absolute_url(text(F.get("_img", F.lit(0))), base).alias("home_image"), absolute_url(text(F.get("_img", F.lit(1))), base).alias("away_image"),
        F.col("_s.asian.left").alias("asian_home_percent"), F.col("_s.asian.right").alias("asian_away_percent"),
        F.col("_s.total.left").alias("over_percent"), F.col("_s.total.right").alias("under_percent"),
    )
    return _with_leans(out, threshold)
