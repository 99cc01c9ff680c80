"""Cross-source match linking by names, kickoff and league.

Names alone can decide a link, so every match has to meet the whole catalog of its snapshot; but few entries can be its
best.  Matches and entries meet in blocks of bounded size, in which an inverted index over name pieces bounds the score
of every entry (`candidates`); only entries whose bound reaches the best are scored in full.  A large catalog makes more
packs and a hot snapshot more salts, spread over tasks, and nothing is dropped.

Fixtures are linked by a cut-off, which allows an equi-join: two names can only reach it if they are equal, one holds
the other, or they share a word among their rarest ones.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.types import StructType

from oddsframe.functions import text as T
from oddsframe.functions.rows import spread
from oddsframe.functions.times import time_score
from oddsframe.operators.candidates import reachable
from oddsframe.session import written

ENTRIES_PER_PACK = 1_000
MATCHES_PER_SALT = 2_000
MOST_BLOCKS = 20_000  # tasks of one stage; beyond, a task does several blocks


def _percent(col: Column) -> Column:
    return F.floor(col * F.lit(100.0) + F.lit(0.5)).cast("int")


def league_key(col: Column) -> Column:
    norm = F.transform(F.array(T.norm_comp(col)), lambda n: F.struct(n.alias("n"), T.norm_team(n).alias("again")))
    return F.transform(
        norm,
        lambda x: F.struct(
            x["n"].alias("n"), T.bigrams(x["again"]).alias("g"), T.chars(x["n"]).alias("c"), T.comp_group(x["n"]).alias("grp")
        ),
    )[0]


def league_score(a: Column, b: Column) -> Column:
    """Closeness of two `league_key`s; 0.5 where one is missing."""
    same = (a["n"] == b["n"]) | F.contains(a["n"], b["n"]) | F.contains(b["n"], a["n"]) | (a["grp"] == b["grp"])
    fuzzy = F.greatest(T.dice(a["g"], b["g"]), T.dice(a["c"], b["c"]) * F.lit(0.9))
    return F.when((a["n"] == "") | (b["n"] == ""), F.lit(0.5)).when(same, F.lit(1.0)).otherwise(fuzzy)


_HOME = ["home", "home_ch", "home_en", "home_s", "home_t"]
_AWAY = ["away", "away_ch", "away_en", "away_s", "away_t"]


def _league_text(df: DataFrame) -> Column:
    cols = [F.nullif(F.col(c), F.lit("")) for c in ("league", "tournament", "tournament_ch", "tournament_en") if c in df.columns]
    return F.coalesce(*cols, F.lit(""))


def link_key(df: DataFrame) -> Column:
    """All that scoring needs of one match, worked out once."""
    have = lambda names: [F.col(c) for c in names if c in df.columns]
    clock = F.coalesce(F.col("clock_only"), F.lit(False)) if "clock_only" in df.columns else F.lit(False)
    return F.struct(
        T.name_variants(*have(_HOME)).alias("h"),
        T.name_variants(*have(_AWAY)).alias("a"),
        league_key(_league_text(df)).alias("l"),
        F.col("kickoff_min").cast("long").alias("k"),
        clock.alias("clock"),
    )


def _closeness(match: Column, c: Column) -> Column:
    return F.struct(
        time_score(F.abs(match["k"] - c["key"]["k"]), match["clock"]).alias("t"),
        league_score(match["l"], c["key"]["l"]).alias("l"),
    )


def _sides(match: Column, c: Column) -> Column:
    """Similarity of both sides, straight and crossed; the first entries win."""
    sims = F.struct(
        T.best_side_similarity(match["h"], c["key"]["h"]).alias("hh"),
        T.best_side_similarity(match["a"], c["key"]["a"]).alias("aa"),
        T.best_side_similarity(match["h"], c["key"]["a"]).alias("ha"),
        T.best_side_similarity(match["a"], c["key"]["h"]).alias("ah"),
    )

    def choose(s):
        crossed = s["ha"] + s["ah"] > s["hh"] + s["aa"]
        return F.struct(
            F.when(crossed, s["ha"]).otherwise(s["hh"]).alias("home"),
            F.when(crossed, s["ah"]).otherwise(s["aa"]).alias("away"),
            (F.greatest(s["hh"] + s["aa"], s["ha"] + s["ah"]) / F.lit(2.0)).alias("team"),
            ((s["ha"] + s["ah"]) / F.lit(2.0) > (s["hh"] + s["aa"]) / F.lit(2.0)).alias("swapped"),
        )

    return T.let(sims, choose)


def _total(team, near: Column) -> Column:
    return _percent(team * F.lit(0.74) + near["t"] * F.lit(0.18) + near["l"] * F.lit(0.08))


def _pair(match: Column, c: Column, near: Column) -> Column:
    """Scores of one pair, as a struct that orders by (score, earliest entry)."""
    def final(p):
        base = _total(p["team"], near)
        strong, weak = F.greatest(p["home"], p["away"]), F.least(p["home"], p["away"])
        lifted = (near["t"] >= 0.98) & (near["l"] >= 0.92) & (strong >= 0.92) & (weak >= 0.28)
        return F.struct(
            F.when(lifted, F.greatest(base, F.lit(82))).otherwise(base).alias("score"),
            (-c["ix"]).alias("neg_ix"),
            c["id"].alias("matched_id"),
            _percent(p["team"]).alias("team_score"),
            _percent(near["t"]).alias("time_score"),
            _percent(near["l"]).alias("league_score"),
            _percent(p["home"]).alias("home_score"),
            _percent(p["away"]).alias("away_score"),
            p["swapped"].alias("swapped"),
        )

    return T.let(_sides(match, c), final)


def pair_scores(match: Column, catalog: Column) -> Column:
    """Scored entries of a catalog array."""
    return F.transform(catalog, lambda c: T.let(_closeness(match, c), lambda near: _pair(match, c, near)))


def _dealt(rows: DataFrame, sizes: DataFrame, keys: list[str], own: tuple[str, str, str], other: tuple[str, str]) -> DataFrame:
    """Rows with the number of their own part by a hash of the id, copied to each part of the other side."""
    ident, parts, part = own
    out = rows.join(sizes, keys).withColumn(part, F.pmod(F.xxhash64(ident), F.col(parts)))
    return out.withColumn(other[1], F.explode(F.sequence(F.lit(0).cast("long"), F.col(other[0]) - 1))).drop("_salts", "_packs")


def pairs_to_score(matches: DataFrame, pool_matches: DataFrame, keys: list[str], gate: tuple[float, float] | None = None) -> DataFrame:
    """(keys, match_id, _m, c): link keys of a match next to an entry that can be its best, or that passes the gate.

    Raw names are shuffled; keys are worked out behind the shuffle, once a block.
    """
    blocks = [*keys, "_salt", "_pack"]
    n = lambda df, per, name: df.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / per).alias(name), F.count(F.lit(1)).alias(f"{name}_n"))
    sizes = n(matches, MATCHES_PER_SALT, "_salts").join(n(pool_matches, ENTRIES_PER_PACK, "_packs"), keys)
    # full blocks: many small snapshots share a task
    units = int(sizes.agg(F.sum(F.col("_salts_n").cast("double") * F.col("_packs_n"))).first()[0] or 0) // (MATCHES_PER_SALT * ENTRIES_PER_PACK)
    sizes = sizes.drop("_salts_n", "_packs_n")
    parts = max(int(matches.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(units, MOST_BLOCKS))
    left = _dealt(matches, sizes, keys, ("match_id", "_salts", "_salt"), ("_packs", "_pack")).repartition(parts, *blocks)
    right = _dealt(pool_matches, sizes, keys, ("id", "_packs", "_pack"), ("_salts", "_salt")).repartition(parts, *blocks)
    left = left.select(*blocks, "match_id", link_key(matches).alias("_m"))
    entry = F.struct(F.col("id"), F.col("source_index").cast("long").alias("ix"), link_key(pool_matches).alias("key"))
    right = right.select(*[F.col(b).alias(f"p{b}") for b in blocks], entry.alias("c"))
    kept = [*keys, "match_id", "_m"]

    def meet(a: pa.Table, b: pa.Table) -> pa.Table:
        a, b = a.combine_chunks(), b.combine_chunks()
        first, second = (t.column(c).combine_chunks() for t, c in ((a, "_m"), (b, "c")))
        pairs = reachable(first, second.field("key"), gate) if len(a) and len(b) else ([], [])
        i, j = (pa.array(x, pa.int64()) for x in pairs)
        return pa.table([*[a.column(c).take(i) for c in kept], b.column("c").take(j)], names=[*kept, "c"])

    schema = StructType([*[left.schema[c] for c in kept], right.schema["c"]])
    return left.groupBy(*blocks).cogroup(right.groupBy(*[f"p{b}" for b in blocks])).applyInArrow(meet, schema)


def _scored(matches: DataFrame, pool_matches: DataFrame, keys: list[str]) -> DataFrame:
    m, c = F.col("_m"), F.col("c")
    return pairs_to_score(matches, pool_matches, keys).select(*keys, "match_id", pair_scores(m, F.array(c))[0].alias("b"))


_DETAIL = ["team_score", "time_score", "league_score", "home_score", "away_score", "swapped"]


def link_matches(
    matches: DataFrame,
    pool_matches: DataFrame,
    possible: int = 58,
    open_: int = 72,
    keys: tuple[str, ...] = ("snapshot_id",),
) -> DataFrame:
    """Best catalog entry per match with its scores and status; the first entry wins ties.

    matches: match_id, names, league, kickoff_min; pool_matches: id, source_index and the same.
    """
    keys = list(keys)
    best = _scored(matches, pool_matches, keys).groupBy(*keys, "match_id").agg(F.max("b").alias("b"))
    out = matches.select(*keys, "match_id").join(best, [*keys, "match_id"], "left")
    score = F.coalesce("b.score", F.lit(0))
    found = score >= possible
    status = F.when(score >= max(open_, possible), F.lit("open")).when(found, F.lit("possible")).otherwise(F.lit("not_found"))
    return out.select(
        *keys, "match_id", status.alias("status"), score.alias("score"),
        F.when(found, F.col("b.matched_id")).alias("matched_id"),
        *[F.when(found, F.col(f"b.{c}")).alias(c) for c in _DETAIL],
    )


def gated_pool_match(matches: DataFrame, catalog: DataFrame, keys: tuple[str, ...] = ("snapshot_id",)) -> DataFrame:
    """The one safe catalog entry per match, or none.

    Not swapped, both sides, time and score high, and five points clear of the next such entry.
    Only entries that can qualify are scored, and two of them per match go on.
    """
    keys = list(keys)
    # both straight sides must round to 75
    pairs = pairs_to_score(matches, catalog, keys, gate=(0.8, 0.7449))
    safe = lambda b: ~b["swapped"] & (b["home_score"] >= 75) & (b["away_score"] >= 75) & (b["time_score"] >= 80) & (b["score"] >= 85)
    # chosen inside the array: a filter on the scores would be moved below them and score a pair once for each test
    scored = F.filter(pair_scores(F.col("_m"), F.array("c")), safe)
    good = spread(pairs, [*keys, "match_id"], scored, "b").select(*keys, "match_id", "b.*")
    order = W.partitionBy(*keys, "match_id").orderBy(F.desc("score"), F.desc("neg_ix"))
    top = good.withColumn("_r", F.row_number().over(order)).where("_r <= 2")
    per = top.groupBy(*keys, "match_id").agg(
        F.max(F.when(F.col("_r") == 1, F.struct("matched_id", "score", *_DETAIL[:5]))).alias("b"),
        F.max(F.when(F.col("_r") == 2, F.col("score"))).alias("second"),
    )
    clear = F.col("second").isNull() | (F.col("b.score") - F.col("second") >= 5)
    return per.where(clear).select(*keys, "match_id", "b.*")


def _fixture_keys(df: DataFrame, names: list[str]) -> Column:
    return F.array(*[T.fixture_name_key(F.col(c)) for c in names if c in df.columns])


def _best_name(lefts: Column, right: Column) -> Column:
    return F.aggregate(lefts, F.lit(0.0), lambda acc, left: F.greatest(acc, T.fixture_name_score(left, right)))


def _substrings(name: Column, n: int) -> Column:
    """Distinct runs of n letters; none where the name is shorter."""
    starts = F.when(F.length(name) >= n, F.sequence(F.lit(1), F.length(name) - n + 1)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(starts, lambda i: F.substr(name, i, F.lit(n))))


def _ranked_words(sides: DataFrame) -> DataFrame:
    """Sides (batch, n, t, ...) with `words`, rarest in the batch first, and whether the batch has names below three letters."""
    names = sides.select("batch", "n", "t").distinct()
    each = names.select("batch", "n", "t", F.explode("t").alias("word"))
    counts = each.groupBy("batch", "word").agg(F.count(F.lit(1)).alias("rarity"))
    ranked = each.join(counts, ["batch", "word"]).groupBy("batch", "n", "t").agg(F.sort_array(F.collect_list(F.struct("rarity", "word"))).alias("ranked"))
    tiny = names.where(F.length("n") < 3).select("batch", F.lit(True).alias("tiny")).distinct()
    out = sides.join(ranked, ["batch", "n", "t"], "left").join(tiny, "batch", "left")
    words = F.coalesce(F.transform("ranked", lambda p: p["word"]), F.array().cast("array<string>"))
    return out.withColumns({"words": words, "tiny": F.coalesce("tiny", F.lit(False))}).drop("ranked")


def fixture_candidates(matches: DataFrame, fixtures: DataFrame, threshold: float, keys: list[str]) -> DataFrame:
    """Distinct (keys, match_id, id) of which a side's names may score `threshold` or more.

    Equal and contained names meet by a run of letters: the first three of the shorter name's rarest word (or of the name)
    stand in the longer.  Others meet by a word: of n words at least ceil(threshold * n) must be shared, so one of the
    rarest n - that + 1 is.
    """
    def sides(df, names, who, other):
        keyed = df.select(F.struct(*keys).alias("batch"), F.col(who).alias("who"), F.explode(_fixture_keys(df, names)).alias("k"))
        keyed = keyed.select("batch", "who", "k.n", F.sort_array("k.t").alias("t"), F.lit(other).alias("fixture")).where("n != ''")
        return keyed.distinct()

    kind = fixtures.schema["fixture_id"].dataType
    left = sides(matches.withColumn("who", F.struct(F.col("match_id"), F.lit(None).cast(kind).alias("id"))), ["home", "home_s", "home_t", "away", "away_s", "away_t"], "who", False)
    right = sides(fixtures.withColumn("who", F.struct(F.lit(None).cast(matches.schema["match_id"].dataType).alias("match_id"), F.col("fixture_id").alias("id"))), ["home", "away"], "who", True)
    named = _ranked_words(left.unionByName(right))
    n = F.size("words")
    prefix = F.transform(F.slice("words", 1, F.greatest(n - F.ceil(n * F.lit(threshold - 1e-9)).cast("int") + 1, F.lit(0))), lambda w: F.concat(F.lit("w"), w))
    rarest = F.array(F.substring(F.coalesce(F.get("words", F.lit(0)), F.col("n")), 1, 3))
    short = F.when(F.col("tiny"), F.concat(_substrings(F.col("n"), 1), _substrings(F.col("n"), 2))).otherwise(F.array().cast("array<string>"))
    every = F.concat(_substrings(F.col("n"), 3), short)
    signed = lambda sign, pieces: F.transform(pieces, lambda p: F.concat(F.lit(sign), p))
    # `<`: the match's name is the shorter one, `>`: the fixture's is
    keys_of = F.when(F.col("fixture"), F.concat(prefix, signed("<", every), signed(">", rarest))).otherwise(F.concat(prefix, signed("<", rarest), signed(">", every)))
    named = written(named.select("batch", "who", "fixture", F.array_distinct(keys_of).alias("pieces")), "names")
    a = named.where("not fixture").select("batch", "who.match_id", F.explode("pieces").alias("piece"))
    b = named.where("fixture").select("batch", "who.id", F.explode("pieces").alias("piece"))
    return a.join(b, ["batch", "piece"]).select("batch.*", "match_id", "id").distinct()


def link_fixtures(matches: DataFrame, fixtures: DataFrame, threshold: float = 0.58, keys: tuple[str, ...] = ("batch_id",)) -> DataFrame:
    """Best fixture per match by shared name words, either way round, at or above the threshold."""
    keys = list(keys)
    entry = fixtures.select(
        *keys,
        F.col("fixture_id").alias("id"),
        F.col("source_index").cast("long").alias("ix"),
        T.fixture_name_key(F.col("home")).alias("h"),
        T.fixture_name_key(F.col("away")).alias("a"),
    )
    own = matches.select(*keys, "match_id", _fixture_keys(matches, ["home", "home_s", "home_t"]).alias("_h"), _fixture_keys(matches, ["away", "away_s", "away_t"]).alias("_a"))
    pairs = fixture_candidates(matches, fixtures, threshold, keys).join(own, [*keys, "match_id"]).join(entry, [*keys, "id"])
    sided = pairs.select(
        *keys, "match_id", "id", "ix",
        ((_best_name(F.col("_h"), F.col("h")) + _best_name(F.col("_a"), F.col("a"))) / F.lit(2.0)).alias("direct"),
        ((_best_name(F.col("_h"), F.col("a")) + _best_name(F.col("_a"), F.col("h"))) / F.lit(2.0)).alias("crossed"),
    )
    scored = sided.select(
        *keys, "match_id",
        F.struct(F.greatest("direct", "crossed").alias("score"), (-F.col("ix")).alias("neg_ix"), F.col("id").alias("fixture_id"), (F.col("crossed") > F.col("direct")).alias("reversed")).alias("b"),
    )
    best = scored.groupBy(*keys, "match_id").agg(F.max("b").alias("b"))
    return best.where(F.col("b.score") >= threshold).select(*keys, "match_id", "b.score", "b.fixture_id", "b.reversed")
