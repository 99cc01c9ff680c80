"""Queries of the linking and context operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from oddsframe.functions import text as T
from oddsframe.functions import times
from oddsframe.functions.odds import round_n
from oddsframe.operators import context as C
from oddsframe.operators import link as R
from oddsframe.plans.fx import ctes, fx, table
from oddsframe.plans.registry import query
from oddsframe.session import many_tasks

D = "::double"


def _norm(x):
    return f"regexp_replace(regexp_replace(lower({x}), '\\b(fc|sc|afc|cf|cd|ac|u19|u20|u21|u23)\\b', '', 'g'), '[^0-9a-z]+', '', 'g')"


def _grams(n):
    return f"case when length({n}) <= 2 then list_distinct(string_split({n}, '')) else list_distinct([substr({n}, i, 2) for i in range(1, length({n}))]) end"


def _dice(a, b):
    return f"(case when len({a}) = 0 or len({b}) = 0 then 0.0{D} else 2.0{D} * len(list_intersect({a}, {b})) / (len({a}) + len({b})) end)"


def sim(a, b):
    """Similarity of two prefixed name columns (n, g, c)."""
    an, bn = f"{a}_n", f"{b}_n"
    ratio = f"least(length({an}), length({bn}))::double / greatest(length({an}), length({bn}))"
    edit = f"(1.0{D} - levenshtein({an}, {bn})::double / greatest(length({an}), length({bn})))"
    return (
        f"(case when {an} = '' or {bn} = '' then 0.0{D} when {an} = {bn} then 1.0{D} when contains({an}, {bn}) or contains({bn}, {an})"
        f" then greatest(0.82{D}, least(0.96{D}, {ratio} + 0.18{D})) else greatest({_dice(f'{a}_g', f'{b}_g')},"
        f" {_dice(f'{a}_c', f'{b}_c')} * 0.96{D}, {edit} * 0.92{D}) end)"
    )


def _side(view, side):
    parts = []
    for col, p in (("home", "h"), ("away", "a")):
        n = _norm(col)
        parts.append(f"{n} {side}{p}_n, {_grams(n)} {side}{p}_g, list_distinct(string_split({n}, '')) {side}{p}_c")
    comp = "regexp_replace(lower(league), '[^0-9a-z]+', '', 'g')"
    parts.append(f"{comp} {side}l_n, {_grams(_norm(comp))} {side}l_g, list_distinct(string_split({comp}, '')) {side}l_c")
    return f"select id {side}id, snapshot_id, kickoff_min {side}k, {', '.join(parts)} from {view}"


_TIME = f"(case when abs(mk - pk) <= 10 then 1.0{D} when abs(mk - pk) <= 60 then 0.8{D} when abs(mk - pk) <= 180 then 0.55{D} else 0.0{D} end)"
_LEAGUE = (
    f"(case when ml_n = '' or pl_n = '' then 0.5{D} when ml_n = pl_n or contains(ml_n, pl_n) or contains(pl_n, ml_n) then 1.0{D}"
    f" else greatest({_dice('ml_g', 'pl_g')}, {_dice('ml_c', 'pl_c')} * 0.9{D}) end)"
)
NAMES = f"with {ctes('fx_names_a', 'fx_names_b')}, ma as ({_side('fx_names_a', 'm')}), pb as ({_side('fx_names_b', 'p')})"


def _scores(pairs):
    """CTEs from a pair table to its scores."""
    return (
        f"sims as (select *, {_TIME} t, {_LEAGUE} l, {sim('mh', 'ph')} hh, {sim('ma', 'pa')} aa, {sim('mh', 'pa')} ha, {sim('ma', 'ph')} ah from {pairs}),"
        f" sided as (select mid, pid, snapshot_id, t, l, (hh + aa) / 2.0{D} direct, (ha + ah) / 2.0{D} crossed, case when ha + ah > hh + aa then ha else hh end hs,"
        " case when ha + ah > hh + aa then ah else aa end as_ from sims),"
        f" based as (select *, cast(floor((greatest(direct, crossed) * 0.74{D} + t * 0.18{D} + l * 0.08{D}) * 100.0{D} + 0.5{D}) as int) base from sided),"
        " scored as (select mid, pid, snapshot_id, case when t >= 0.98 and l >= 0.92 and greatest(hs, as_) >= 0.92 and least(hs, as_) >= 0.28 then greatest(base, 82) else base end score,"
        f" cast(floor(greatest(direct, crossed) * 100.0{D} + 0.5{D}) as int) team_score, cast(floor(t * 100.0{D} + 0.5{D}) as int) time_score, cast(floor(l * 100.0{D} + 0.5{D}) as int) league_score,"
        f" cast(floor(hs * 100.0{D} + 0.5{D}) as int) home_score, cast(floor(as_ * 100.0{D} + 0.5{D}) as int) away_score, crossed > direct swapped from based)"
    )


ROWS = "rows_ as (select * from ma join pb on pid = mid + 1000000 and ma.snapshot_id = pb.snapshot_id)".replace(
    "select * from ma join pb on", "select ma.*, pb.* exclude (snapshot_id) from ma join pb on"
)
ALL = "pairs as (select ma.*, pb.* exclude (snapshot_id) from ma join pb using (snapshot_id))"


def names(spark, sf, view):
    """The small rows of a view, spread: what is worked out of a name costs far more than reading it."""
    return fx(spark, sf, view).repartition(many_tasks(spark))


def sides(spark, sf):
    a = fx(spark, sf, "fx_names_a").withColumn("match_id", F.col("id").cast("string"))
    b = fx(spark, sf, "fx_names_b").withColumns({"source_index": F.col("id"), "id": F.col("id").cast("string")})
    return a, b


def aligned(spark, sf):
    """Row i of one side next to row i of the other."""
    a, b = names(spark, sf, "fx_names_a"), names(spark, sf, "fx_names_b")
    b = b.select((F.col("id") - 1000000).alias("id"), *[F.col(c).alias(f"p_{c}") for c in ("home", "away", "league", "kickoff_min")])
    return a.join(b, "id")


@query("x9_norm_team", f"with {ctes('fx_names_a')} select id, {_norm('home')} home, {_norm('away')} away from fx_names_a")
def norm_team(spark, sf):
    return names(spark, sf, "fx_names_a").select("id", T.norm_team(F.col("home")).alias("home"), T.norm_team(F.col("away")).alias("away"))


@query("x10_norm_comp", f"with {ctes('fx_names_a')} select id, regexp_replace(lower(league), '[^0-9a-z]+', '', 'g') league from fx_names_a")
def norm_comp(spark, sf):
    bracketed = F.concat("league", F.lit(" (x)"))
    return names(spark, sf, "fx_names_a").select("id", T.norm_comp(bracketed).alias("league"))


@query(
    "x11_norm_latin_tokens",
    f"with {ctes('fx_names_a')} select id, regexp_replace(lower(away), '[^0-9a-z]+', '', 'g') norm, array_to_string(list_filter(regexp_split_to_array(lower(away), '[^0-9a-z]+'), lambda x: length(x) >= 3), ' ') tokens from fx_names_a",
)
def latin(spark, sf):
    marked = F.translate("away", "aeom", "ạếöṁ")
    return names(spark, sf, "fx_names_a").select("id", T.norm_latin(marked).alias("norm"), F.array_join(T.tokens3(marked), " ").alias("tokens"))


@query("x12_bigram_dice", f"{NAMES}, {ROWS} select mid id, {_dice('mh_g', 'ph_g')} dice, len(mh_g) n_grams from rows_")
def dice(spark, sf):
    rows = aligned(spark, sf).select("id", T.norm_team(F.col("home")).alias("a"), T.norm_team(F.col("p_home")).alias("b"))
    keyed = rows.select("id", T.bigrams(F.col("a")).alias("g"), T.bigrams(F.col("b")).alias("h"))
    return keyed.select("id", T.dice(F.col("g"), F.col("h")).alias("dice"), F.size("g").alias("n_grams"))


@query("x13_edit_sim", f"{NAMES}, {ROWS} select mid id, 1.0{D} - levenshtein(mh_n, ph_n)::double / greatest(length(mh_n), length(ph_n)) sim from rows_")
def edit(spark, sf):
    rows = aligned(spark, sf).select("id", T.norm_team(F.col("home")).alias("a"), T.norm_team(F.col("p_home")).alias("b"))
    return rows.select("id", T.edit_sim(F.col("a"), F.col("b")).alias("sim"))


@query("r1_name_similarity", f"{NAMES}, {ROWS} select mid id, {sim('mh', 'ph')} home_sim, {sim('ma', 'pa')} away_sim from rows_")
def similarity(spark, sf):
    keyed = aligned(spark, sf).select("id", *[T.name_key(F.col(c)).alias(c) for c in ("home", "away", "p_home", "p_away")])
    return keyed.select(
        "id", T.name_similarity(F.col("home"), F.col("p_home")).alias("home_sim"), T.name_similarity(F.col("away"), F.col("p_away")).alias("away_sim")
    )


@query("r2_best_side_similarity", f"{NAMES}, {ROWS} select mid id, greatest({sim('mh', 'ph')}, {sim('mh', 'pa')}, {sim('ma', 'ph')}, {sim('ma', 'pa')}) best from rows_")
def best_side(spark, sf):
    keyed = aligned(spark, sf).select("id", T.name_variants(F.col("home"), F.col("away")).alias("m"), T.name_variants(F.col("p_home"), F.col("p_away")).alias("p"))
    return keyed.select("id", T.best_side_similarity(F.col("m"), F.col("p")).alias("best"))


@query(
    "r3_time_score",
    f"{NAMES}, {ROWS} select mid id, {_TIME} score, case when least(abs(mk * 30 - pk) % 1440, 1440 - abs(mk * 30 - pk) % 1440) <= 10 then 1.0 when least(abs(mk * 30 - pk) % 1440, 1440 - abs(mk * 30 - pk) % 1440) <= 60 then 0.8"
    " when least(abs(mk * 30 - pk) % 1440, 1440 - abs(mk * 30 - pk) % 1440) <= 120 then 0.55 else 0.25 end clock_score from rows_",
)
def time(spark, sf):
    m, p = F.col("kickoff_min"), F.col("p_kickoff_min")
    return aligned(spark, sf).select(
        "id", times.time_score(F.abs(m - p)).alias("score"), times.time_score(F.abs(m * 30 - p), F.lit(True)).alias("clock_score")
    )


@query("r4_league_score", f"{NAMES}, lg as (select m.mid, m.ml_n, m.ml_g, m.ml_c, p.pl_n, p.pl_g, p.pl_c from ma m join pb p on p.pid = m.mid + 1000007) select mid id, {_LEAGUE} score from lg")
def league(spark, sf):
    a, b = names(spark, sf, "fx_names_a"), names(spark, sf, "fx_names_b")
    rows = a.select("id", R.league_key(F.col("league")).alias("l")).join(b.select((F.col("id") - 1000007).alias("id"), R.league_key(F.col("league")).alias("p")), "id")
    return rows.select("id", R.league_score(F.col("l"), F.col("p")).alias("score"))


@query("r5_pair_score", f"{NAMES}, {ROWS}, {_scores('rows_')} select cast(mid as varchar) match_id, score, team_score, time_score, league_score, home_score, away_score, swapped from scored")
def pair(spark, sf):
    a, b = sides(spark, sf)
    entry = F.struct("id", F.col("source_index").alias("ix"), R.link_key(b).alias("key"))
    right = b.select((F.col("id").cast("long") - 1000000).cast("string").alias("match_id"), F.array(entry).alias("catalog"))
    rows = a.select("match_id", R.link_key(a).alias("m")).join(right, "match_id")
    return rows.select("match_id", F.inline(R.pair_scores(F.col("m"), F.col("catalog")))).drop("neg_ix", "matched_id")


def _fix(x):
    return f"regexp_replace(lower({x}), '[^0-9a-z]+', '', 'g')"


def _tok(x):
    return f"list_distinct(list_filter(regexp_split_to_array(lower({x}), '[^0-9a-z]+'), lambda w: length(w) >= 3))"


def fixture_sim(a, b):
    return (
        f"(case when {a}_n = '' or {b}_n = '' then 0.0{D} when {a}_n = {b}_n then 1.0{D} when contains({a}_n, {b}_n) or contains({b}_n, {a}_n) then 0.82{D}"
        f" when len({a}_t) = 0 or len({b}_t) = 0 then 0.0{D} else len(list_intersect({a}_t, {b}_t))::double / greatest(len({a}_t), len({b}_t)) end)"
    )


def _fside(view, s):
    cols = ", ".join(f"{_fix(c)} {s}{p}_n, {_tok(c)} {s}{p}_t" for c, p in (("home", "h"), ("away", "a")))
    return f"select id {s}id, snapshot_id, {cols} from {view}"


FIX = f"with {ctes('fx_names_a', 'fx_names_b')}, ma as ({_fside('fx_names_a', 'm')}), pb as ({_fside('fx_names_b', 'p')})"


@query("r6_fixture_name_score", f"{FIX}, {ROWS} select mid id, {fixture_sim('mh', 'ph')} home, {fixture_sim('ma', 'pa')} away from rows_")
def fixture_score(spark, sf):
    keyed = aligned(spark, sf).select("id", *[T.fixture_name_key(F.col(c)).alias(c) for c in ("home", "away", "p_home", "p_away")])
    return keyed.select("id", T.fixture_name_score(F.col("home"), F.col("p_home")).alias("home"), T.fixture_name_score(F.col("away"), F.col("p_away")).alias("away"))


@query(
    "j2_link_matches",
    f"{NAMES}, {ALL}, {_scores('pairs')}, best as (select * from scored qualify row_number() over (partition by mid order by score desc, pid) = 1)"
    " select cast(mid as varchar) match_id, snapshot_id, case when score >= 72 then 'open' when score >= 58 then 'possible' else 'not_found' end status, score,"
    " case when score >= 58 then cast(pid as varchar) end matched_id, case when score >= 58 then team_score end team_score, case when score >= 58 then home_score end home_score from best",
)
def link(spark, sf):
    a, b = sides(spark, sf)
    return R.link_matches(a, b).select("match_id", "snapshot_id", "status", "score", "matched_id", "team_score", "home_score")


@query(
    "j3_gated_pool_match",
    f"{NAMES}, {ALL}, {_scores('pairs')}, good as (select * from scored where not swapped and home_score >= 75 and away_score >= 75 and time_score >= 80 and score >= 85),"
    " ranked as (select *, lead(score) over (partition by mid order by score desc, pid) nxt, row_number() over (partition by mid order by score desc, pid) r from good)"
    " select cast(mid as varchar) match_id, cast(pid as varchar) matched_id, score from ranked where r = 1 and (nxt is null or score - nxt >= 5)",
)
def gated(spark, sf):
    a, b = sides(spark, sf)
    return R.gated_pool_match(a, b).select("match_id", "matched_id", "score")


_LINKED = (
    f"{FIX}, {ALL}, sims as (select *, {fixture_sim('mh', 'ph')} hh, {fixture_sim('ma', 'pa')} aa, {fixture_sim('mh', 'pa')} ha, {fixture_sim('ma', 'ph')} ah from pairs),"
    f" scored as (select mid, pid, snapshot_id, (hh + aa) / 2.0{D} direct, (ha + ah) / 2.0{D} crossed from sims),"
    " best as (select *, greatest(direct, crossed) score from scored qualify row_number() over (partition by mid order by greatest(direct, crossed) desc, pid) = 1),"
    " linked as (select * from best where score >= 0.58)"
)


def fixtures(spark, sf):
    b = names(spark, sf, "fx_names_b")
    return b.select(F.col("snapshot_id").alias("batch_id"), F.col("id").alias("fixture_id"), F.col("id").alias("source_index"), "home", "away", "kickoff_min")


def batch(spark, sf):
    return names(spark, sf, "fx_names_a").select(F.col("snapshot_id").alias("batch_id"), F.col("id").cast("string").alias("match_id"), "home", "away", "league")


@query("j4_link_fixtures", f"{_LINKED} select cast(mid as varchar) match_id, pid fixture_id, floor(score * 1000.0{D} + 0.5{D}) / 1000.0{D} score, crossed > direct as reversed from linked")
def link_fixture(spark, sf):
    out = R.link_fixtures(batch(spark, sf), fixtures(spark, sf))
    return out.select("match_id", "fixture_id", round_n(F.col("score"), 3).alias("score"), "reversed")


@query(
    "j12_candidate_dates",
    f"with {ctes('fx_matches')}, k as (select distinct cast(kickoff_ts as date) d from fx_matches) select distinct cast(d as varchar) fixture_date from"
    " (select d - 1 d from k union all select d from k union all select d + 1 from k union all select date '1998-06-15' union all select date '1998-06-16')",
)
def dates(spark, sf):
    rows = fx(spark, sf, "fx_matches").withColumn("kickoff_raw", F.date_format("kickoff_ts", "M/d HH:mm"))
    now = F.lit("1998-06-15").cast("timestamp_ntz")
    full = F.to_date("kickoff_ts")
    out = C.candidate_dates(rows, now, F.when(F.year("kickoff_ts") == 1998, C.kickoff_date(F.col("kickoff_raw"), now)).otherwise(full))
    return out.select(F.col("fixture_date").cast("string").alias("fixture_date"))


@query(
    "j13_context_for_match",
    f"with {ctes('fx_context')}, d as (select distinct cast(s_suppkey % 50 as varchar) match_id from supplier) select d.match_id, id, item, 'own' as scope from d join fx_context c using (match_id)"
    " union all select null, id, item, 'general' from fx_context where match_id is null",
)
def context(spark, sf):
    docs = table(spark, sf, "supplier").select((F.col("s_suppkey") % 50).cast("string").alias("match_id")).distinct()
    return C.context_for_match(docs, fx(spark, sf, "fx_context")).select("match_id", "id", "item", "scope")


@query(
    "j15_weather_at_kickoff",
    """with f as (select event_id fixture_id, user_id place, ts kickoff_ts from events where event_id % 4 = 0), h as (select user_id place, ts hour_ts, value from events where event_id % 4 <> 0),
    e as (select place, date_trunc('hour', hour_ts) hr, min(hour_ts) hour_ts, arg_min(value, hour_ts) v from h group by all), o as (select place, arg_min(value, hour_ts) v from h group by place)
    select fixture_id, f.place, e.v is not null exact_hour, coalesce(e.v, o.v) as value from f left join e on e.place = f.place and e.hr = date_trunc('hour', f.kickoff_ts) left join o on o.place = f.place""",
)
def weather(spark, sf):
    e = table(spark, sf, "events")
    places = e.where("event_id % 4 = 0").select(F.col("event_id").alias("fixture_id"), F.col("user_id").alias("place"), F.col("ts").alias("kickoff_ts"))
    hourly = e.where("event_id % 4 <> 0").select(F.col("user_id").alias("place"), F.col("ts").alias("hour_ts"), "value")
    return C.weather_at_kickoff(places, hourly).select("fixture_id", "place", "exact_hour", "value")


@query(
    "j16_assemble_context",
    f"{_LINKED}, tagged as (select cast(mid as varchar) match_id, pid from linked) select match_id, 'fixture_matches' kind, count(*) n_rows from tagged group by all"
    " union all select match_id, 'injuries', count(*) from tagged join supplier on s_suppkey % 50 = pid % 50 group by all"
    " union all select match_id, 'lineups', count(*) from tagged where pid % 2 = 0 group by all union all select match_id, 'weather', count(*) from tagged where pid % 3 = 0 group by all"
    " union all select cast(mid as varchar), 'missing', 1 from ma where mid not in (select mid from linked)",
)
def assembled(spark, sf):
    fix = fixtures(spark, sf)
    ids = fix.select("fixture_id")
    injuries = table(spark, sf, "supplier").select((F.col("s_suppkey") % 50).alias("squad"), F.col("s_name").alias("player"))
    tables = C.assemble_context(
        batch(spark, sf), fix, injuries, ids.where("fixture_id % 2 = 0").withColumn("team", F.lit("x")),
        ids.where("fixture_id % 3 = 0").withColumn("temperature_c", F.lit(20.0)), rosters=ids.withColumn("squad", F.col("fixture_id") % 50),
    )
    return C.union_context(tables).groupBy("match_id", "kind").agg(F.count(F.lit(1)).alias("n_rows"))
