"""Audit of model output, outcome records and probe logs."""

from __future__ import annotations

import re
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from oddsframe.functions.text import text

SCHEMA_VERSION = "odds-analysis-v1"
# Keys a single-match report must hold.
SINGLE_MATCH_KEYS = [
    "match_meta", "input_audit", "source_audit", "pitch_reality", "market_truth", "convergence", "corner_matrix",
    "anomaly_flags", "recommendation", "charts", "missing_fields",
]


def _object(json: Column) -> Column:
    """The parsed JSON object; NULL if the text is none."""
    return F.when(json.rlike(r"^\s*\{"), F.try_parse_json(json))


def _has(v: Column, key: str) -> Column:
    return F.try_variant_get(v, f"$.{key}", "variant").isNotNull()


def _string(v: Column, key: str) -> Column:
    return F.try_variant_get(v, f"$.{key}", "string")


def _kind(v: Column, key: str) -> Column:
    return F.schema_of_variant(F.try_variant_get(v, f"$.{key}", "variant"))


def _truthy(v: Column, key: str) -> Column:
    """The key holds something: no null, false, zero or empty text.  Types are looked up only where the text is in doubt."""
    def holds(value: Column) -> Column:
        doubt = value.isin("", "false") | F.coalesce(value.try_cast("double") == 0, F.lit(False))
        return value.isNotNull() & (~doubt | ((value != "") & (_kind(v, key) == "STRING")))

    return _bind(_string(v, key), holds)


def _is_array(v: Column, key: str) -> Column:
    empty = (_string(v, key) == "[]") & (_kind(v, key) != "STRING")
    return _has(v, f"{key}[0]") | F.coalesce(empty, F.lit(False))


def _versioned(v: Column) -> Column:
    return F.coalesce(_string(v, "schemaVersion") == SCHEMA_VERSION, F.lit(False))


def candidate_points(v: Column) -> Column:
    """How much a JSON object looks like the wanted report."""
    any_of = lambda *keys: reduce(lambda a, b: a | b, [_truthy(v, k) for k in keys])
    rules = [
        (_versioned(v), 100),
        (_is_array(v, "top10"), 45),
        (_truthy(v, "dataQuality"), 20),
        (_is_array(v, "top3Candidates"), 15),
        (_truthy(v, "singleMatch"), 45),
        (_truthy(v, "match_meta") & _truthy(v, "recommendation"), 35),
        (any_of("pitch_reality", "market_truth", "corner_matrix"), 30),
        (_truthy(v, "recommendation"), 10),
    ]
    return reduce(lambda a, b: a + b, [F.when(c, F.lit(p)).otherwise(F.lit(0)) for c, p in rules])


def _bind(value: Column, use) -> Column:
    """`use(value)`, with the value computed once however often it is read."""
    return F.transform(F.array(value), use)[0]


def _choose(candidates: Column) -> Column:
    """The candidate with most points, the later one on a tie; NULL without a JSON object."""
    scored = F.transform(
        candidates,
        lambda t, i: _bind(
            _object(t), lambda v: F.when(v.isNotNull(), F.struct(candidate_points(v).alias("p"), i.alias("i"), t.alias("t")))
        ),
    )
    return F.array_max(F.filter(scored, lambda s: s.isNotNull()))["t"]


def balanced_objects():
    """UDF: every text from a `{` to its matching brace, braces in strings aside, in order of their starts.

    Only those that begin as a JSON object does: with a key or at once with the closing brace.  The functions are
    local, so they travel to the executors by value and need no package there.
    """
    def scan(raw):
        # one pass for each state of the quotes that a `{` can be read in: the quotes before a start do not count,
        # so a `{` is open either outside the running quotes or, read on its own, inside them
        found, stacks = [], ([], [])
        escaped = quoted = False
        keyed = re.compile(r'\{[ \t\r\n]*["}]')
        for at, ch in enumerate(raw):
            if escaped:
                escaped = False
                continue
            if ch == "\\":
                escaped = True
            elif ch == '"':
                quoted = not quoted
            elif ch == "{":
                stacks[quoted].append(at)
            elif ch == "}" and stacks[quoted]:
                start = stacks[quoted].pop()
                if keyed.match(raw, start):
                    found.append((start, raw[start : at + 1]))
        return [text for _, text in sorted(found)]

    def batch(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: scan(t) if t else [])

    return F.pandas_udf(batch, ArrayType(StringType()))


def extract_structured(df: DataFrame, column: str = "text") -> DataFrame:
    """`structured`: the JSON object of a model reply.

    Fenced blocks first; only replies without a usable one go through the brace scan.
    """
    raw = F.trim(text(F.col(column)))
    fences = F.regexp_extract_all(raw, F.lit(r"(?is)```(?:json)?\s*(.*?)```"), F.lit(1))
    blocks = F.transform(fences, lambda b: F.regexp_replace(b, r"^\s+|\s+$", ""))
    out = df.withColumn("_fenced", _choose(F.filter(blocks, lambda b: F.startswith(b, F.lit("{")))))
    loose = F.when(F.col("_fenced").isNull() & F.contains(F.col(column), F.lit("{")), F.col(column))
    out = out.withColumn("_loose", balanced_objects()(loose))
    return out.withColumn("structured", F.coalesce("_fenced", _choose(F.col("_loose")))).drop("_fenced", "_loose")


def validate_outputs(df: DataFrame, column: str = "structured") -> DataFrame:
    """Contract checks of a structured reply: level, score, checks and missing keys."""
    m = F.col("_m")
    has = lambda k: _has(m, k)
    single = (
        (text(F.col("workflow")) == "single_match_deep_analysis") | has("pitch_reality") | has("market_truth") | has("corner_matrix")
    )
    check = lambda key, status: F.struct(F.lit(key).alias("key"), status.alias("status"))
    grade = lambda ok, bad="warn": F.when(ok, F.lit("ok")).otherwise(F.lit(bad))
    version = grade(_versioned(m))
    value = lambda parent, key: F.coalesce(_string(m, f"{parent}.{key}"), F.lit("")) != ""
    decision = value("recommendation", "recommendation") | value("recommendation", "primary_market") | value("singleMatch", "conclusion")
    single_checks = F.array(
        check("schemaVersion", version),
        *[check(k, grade(has(k))) for k in SINGLE_MATCH_KEYS],
        check("singleMatch", grade(has("singleMatch"))),
        check("recommendation_value", grade(decision)),
    )
    filled = _has(m, "top10[0]")
    ranking_checks = F.array(
        check("schemaVersion", version),
        check("top10", grade(filled, "error")),
        check("dataQuality", grade(has("dataQuality"))),
        check("top3Candidates", grade(_is_array(m, "top3Candidates"))),
    )
    none = F.array(check("structured_json", F.lit("error")))
    out = df.withColumn("_m", _object(F.col(column)))
    out = out.withColumn("checks", F.when(m.isNull(), none).when(single, single_checks).otherwise(ranking_checks))
    bad = F.filter("checks", lambda c: (c["status"] != "ok") & (c["key"] != "schemaVersion"))
    name = lambda c: F.when(c["key"] == "recommendation_value", F.lit("recommendation.value")).otherwise(c["key"])
    points = F.aggregate(
        "checks", F.lit(0.0), lambda acc, c: acc + F.when(c["status"] == "ok", 1.0).when(c["status"] == "warn", 0.5).otherwise(0.0)
    )
    any_ = lambda s: F.exists("checks", lambda c: c["status"] == s)
    out = out.withColumns(
        {
            "level": F.when(any_("error"), F.lit("error")).when(any_("warn"), F.lit("warn")).otherwise(F.lit("ok")),
            "validation_score": F.floor(points / F.size("checks") * 100.0 + 0.5).cast("int"),
            "missing": F.array_distinct(F.transform(bad, name)),
        }
    )
    return out.withColumn("ok", F.col("level") != "error").drop("_m")


_LIST = "array<string>"
_RECOMMENDATION = (
    "struct<recommendedBet: string, recommendation: string, primaryMarket: string, primary_market: string, selection: string, pick: string, "
    "risk_level: string, suggested_stake_pct_of_bankroll: string>"
)
_PICK = (
    "matchId: string, matchTitle: string, confidenceScore: double, recommendedBet: string, recommended_bet: string, betRecommendation: string, "
    "primaryMarket: string, primary_market: string, selection: string, pick: string, betDirection: string, bet_direction: string, riskLevel: string, "
    "risk_level: string, suggestedStakePctOfBankroll: string, suggested_stake_pct_of_bankroll: string, conclusion: string, "
    f"evidence: {_LIST}, risks: {_LIST}, missingData: {_LIST}, layers: array<struct<finding: string>>, recommendation: {_RECOMMENDATION}"
)
_REPORT = f"summary string, top10 array<struct<{_PICK}>>, singleMatch struct<{_PICK}>, recommendation {_RECOMMENDATION}, dataQuality struct<missingData: {_LIST}>"


def chunk_result_summary(df: DataFrame, sizes: dict[str, int] | None = None) -> DataFrame:
    """Summary row of each chunk reply: first filled of the alternative keys.

    Input: match_id, structured (JSON), text (the reply) and optionally error.  `sizes` cuts named
    output columns to so many characters (texts) or items (lists); without it values stay whole.
    """
    sizes = sizes or {}
    out = df.withColumn("_r", F.from_json("structured", _REPORT))
    top, single = "_r.top10[0]", "_r.singleMatch"
    def at(path):
        base, _, field = path.rpartition(".")
        return F.get("_r.top10", F.lit(0))[field] if base == top else F.col(path)

    def rec(field):
        # the first of the three recommendations that exists at all
        picks = [F.get("_r.top10", F.lit(0))["recommendation"], F.col("_r.singleMatch.recommendation"), F.col("_r.recommendation")]
        return F.coalesce(*picks)[field]

    def first(name, *cols):
        filled = F.coalesce(*[F.nullif(c, F.lit("")) for c in cols], F.lit(""))
        return (F.left(filled, F.lit(sizes[name])) if name in sizes else filled).alias(name)

    def listed(name, items):
        return (F.slice(items, 1, sizes[name]) if name in sizes else items).alias(name)

    t, s = lambda f: at(f"{top}.{f}"), lambda f: at(f"{single}.{f}")
    both = lambda a, b: F.concat(F.coalesce(a, F.array().cast(_LIST)), F.coalesce(b, F.array().cast(_LIST)))
    findings = F.filter(F.transform(s("layers"), lambda x: x["finding"]), lambda x: F.coalesce(x, F.lit("")) != "")
    error = text(F.col("error")) if "error" in df.columns else F.lit("")
    return out.select(
        *[c for c in df.columns if c not in ("structured", "text", "error")],
        (error == "").alias("ok"),
        first("summary", F.col("_r.summary"), s("conclusion"), F.col("text"), F.lit("未有摘要")),
        F.coalesce(t("confidenceScore"), s("confidenceScore")).alias("confidence_score"),
        first("recommended_bet", t("recommendedBet"), t("recommended_bet"), t("betRecommendation"), s("recommendedBet"), s("recommended_bet"), rec("recommendedBet"), rec("recommendation"), rec("primary_market")),
        first("primary_market", t("primaryMarket"), t("primary_market"), s("primaryMarket"), s("primary_market"), rec("primaryMarket"), rec("primary_market")),
        first("selection", t("selection"), t("pick"), s("selection"), s("pick"), rec("selection"), rec("pick")),
        first("bet_direction", t("betDirection"), t("bet_direction"), s("betDirection"), s("bet_direction")),
        first("risk_level", t("riskLevel"), t("risk_level"), s("riskLevel"), s("risk_level"), rec("risk_level")),
        first("stake_pct", t("suggestedStakePctOfBankroll"), t("suggested_stake_pct_of_bankroll"), s("suggestedStakePctOfBankroll"), s("suggested_stake_pct_of_bankroll"), rec("suggested_stake_pct_of_bankroll")),
        first("conclusion", t("conclusion"), s("conclusion")),
        listed("evidence", both(t("evidence"), findings)),
        listed("risks", both(t("risks"), s("risks"))),
        listed("missing_data", both(F.col("_r.dataQuality.missingData"), s("missingData"))),
        error.alias("error"),
    )


def combine_counts(summaries: DataFrame) -> DataFrame:
    return summaries.agg(
        F.count(F.lit(1)).alias("total_chunks"), F.count_if("ok").alias("success_count"), F.count_if(~F.col("ok")).alias("failed_count")
    )


def hit_rate(outcomes: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Records, hits, misses and the hit share, in all or per `by`."""
    out = outcomes.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("result") == "hit").alias("hits"),
        F.count_if(F.col("result") == "miss").alias("misses"),
    )
    return out.withColumn("hit_share", F.when(F.col("total") > 0, F.col("hits") / F.col("total")))


def latest_outcomes(outcomes: DataFrame, n: int = 5) -> DataFrame:
    """Newest records: 5 are shown, 100 are kept (`n=100`) by the record store."""
    return outcomes.orderBy(F.desc("created_at"), F.desc("id")).limit(n)


_TLS = r"(?i)schannel|handshake|ssl/tls|UNEXPECTED_EOF|before secure TLS|ECONNRESET|Empty reply|Connection timed out"
_BLOCKED = (
    "(?i)access denied|forbidden|captcha|cloudflare|blocked|安全验证|安全驗證|访问过于频繁|訪問過於頻繁|please enable cookies|unusual traffic"
)


def probe_status(log: DataFrame) -> DataFrame:
    """State (ok / warn / error) and diagnosis of each probe.

    Optional expectation columns: expected_ok, expected_severity, expected_diagnosis.
    """
    code = F.coalesce(F.col("status_code"), F.lit(0))
    body, error = text(F.col("body")), text(F.col("error"))
    failed = error != ""
    case = lambda state, diagnosis: F.struct(F.lit(state).alias("state"), F.lit(diagnosis).alias("diagnosis"))
    basic = (
        F.when(failed & error.rlike(_TLS), case("error", "tls"))
        .when(failed & error.rlike("(?i)timeout"), case("error", "timeout"))
        .when(failed, case("error", "network"))
        .when(code == 403, case("error", "http_403"))
        .when(code == 429, case("error", "http_429"))
        .when(code >= 500, case("warn", "http_5xx"))
        .when((code >= 300) & (code < 400), case("warn", "http_3xx"))
        .when(code >= 400, case("error", "http_4xx"))
        .when(F.trim(body) == "", case("warn", "empty"))
        .otherwise(case("ok", "ok"))
    )
    blocked = ~failed & body.rlike(_BLOCKED)
    checked = F.when(blocked & (code >= 400), case("error", "blocked")).when(blocked, case("warn", "blocked")).otherwise(basic)
    out = log.withColumn("_c", checked).withColumns({"state": F.col("_c.state"), "diagnosis": F.col("_c.diagnosis")}).drop("_c")
    if "expected_ok" in log.columns:
        missed = ~failed & ~F.coalesce(F.col("expected_ok"), F.lit(True))
        weaker = F.when(F.col("state") == "ok", F.lit("warn")).otherwise(F.col("state"))
        met = ~failed & F.coalesce(F.col("expected_ok"), F.lit(False)) & (F.col("state") == "ok")
        said = F.nullif(text(F.col("expected_diagnosis")), F.lit(""))
        out = out.withColumns(
            {
                "state": F.when(missed, F.coalesce(F.col("expected_severity"), weaker)).otherwise(F.col("state")),
                "diagnosis": F.when(missed | met, F.coalesce(said, F.col("diagnosis"))).otherwise(F.col("diagnosis")),
            }
        )
    return out.withColumn("ok", F.col("state") == "ok")


def list_page_meta(log: DataFrame, column: str = "body") -> DataFrame:
    """Match count and first match of a probed list page."""
    blocks = F.regexp_extract_all(F.col(column), F.lit(r"(?s)A\[\d+]\s*=\s*\"(.*?)\"\.split\('\^'\);"), F.lit(1))
    f = lambda i: text(F.get(F.split(F.try_element_at("_b", F.lit(1)), r"\^"), F.lit(i)))
    either = lambda a, b: F.coalesce(F.nullif(f(a), F.lit("")), f(b))
    return log.withColumn("_b", blocks).withColumns(
        {
            "match_count": F.size("_b"), "first_match_id": f(0), "first_league": either(3, 2), "first_home": either(6, 5),
            "first_away": either(9, 8),
        }
    ).drop("_b")


def probe_summary(states: DataFrame) -> DataFrame:
    """Counts per state and the worst state overall."""
    out = states.agg(*[F.count_if(F.col("state") == s).alias(f"{s}_count") for s in ("ok", "warn", "error")])
    worst = F.when(F.col("error_count") > 0, F.lit("error")).when(F.col("warn_count") > 0, F.lit("warn")).otherwise(F.lit("ok"))
    return out.withColumn("overall", worst)
