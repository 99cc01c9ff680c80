"""Mixing sources to target weights by temperature, in built-in functions only.

Token shares p of the sources are raised to an exponent t and normalised: t = 1 keeps the natural mixture, t = 0
makes it flat.  The exponent is the smallest (flattest) that repeats no source more than `max_repeats` times or, if
`min_entropy` is asked for, the largest whose weights still reach that entropy (nats).  Both are monotone in t and
found by bisection; four halvings share one job over the per-source sums, of which the driver sees 15 rows.

Weights become token budgets, and a source's budget is spent on seeded permutations of its documents: whole
epochs, then the start of one more.  Every emitted row has a position in its source's budget; equal parts of all
budgets make a block, and the rows of a block are permuted together, so every block holds the target mixture.

A null source is a source of its own.  Null and empty texts have no tokens and come once an epoch; sources without
tokens have no weight and come once.  Rows equal in id, source and text go in or out together.  No rows, no output.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from oddsframe.llm.shared import keep, n_words, spell_out

STEPS = 10  # jobs of four halvings each
SMALL_TABLE = 50_000  # sources up to which their table may be broadcast


def digits(text: Column) -> Column:
    """60 bits of a digest."""
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def item(df: DataFrame) -> Column:
    text = F.coalesce(df["text"], F.lit(""))
    return digits(F.concat(F.coalesce(df["doc_id"].cast("string"), F.lit("-")), F.lit(":"), F.md5(text)))


def _named(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("s:"), source), F.lit("none"))


def source_tokens(rows: DataFrame) -> DataFrame:
    return rows.groupBy("name").agg(F.sum(F.col("tokens") * F.col("copies")).alias("all_tokens"))


def solve_exponent(sources: DataFrame, max_repeats: float = 2.0, min_entropy: float | None = None) -> tuple[float, dict]:
    """The exponent, and the totals that turn shares into weights."""
    used = sources.where("all_tokens > 0")
    total = used.agg(F.sum("all_tokens"), F.max("all_tokens"), F.min("all_tokens")).first()
    if not total[0]:
        return 1.0, {"tokens": 0, "largest": 0, "norm": 1.0}
    share = F.col("all_tokens") / F.lit(float(total[0]))

    def sums(points: list[float]) -> list:
        grid = used.select(share.alias("p"), F.explode(F.array(*[F.lit(float(x)) for x in points])).alias("t"))
        power = F.pow("p", "t")
        return grid.groupBy("t").agg(F.sum(power).alias("z"), F.sum(power * F.log("p")).alias("a")).orderBy("t").collect()

    def fits(row) -> bool:
        if min_entropy is not None:
            return math.log(row["z"]) - row["t"] * row["a"] / row["z"] < min_entropy
        return (total[1] / total[2]) ** (1 - row["t"]) <= max_repeats

    low, high = 0.0, 1.0  # fits() holds from some exponent on; look for that point
    for _ in range(STEPS):
        points = [low + (high - low) * k / 16 for k in range(1, 16)]
        first = next((k for k, row in enumerate(sums(points)) if fits(row)), 15)
        low, high = ([low, *points][first], [*points, high][first])
    exponent = math.ceil(high * 1e9 - 1e-3) / 1e9
    return exponent, {"tokens": int(total[0]), "largest": int(total[1]), "norm": sums([exponent])[0]["z"]}


def budgets(sources: DataFrame, exponent: float, totals: dict, budget: int | None = None) -> DataFrame:
    """Weight and token budget of every source; without a stated budget the least that uses every source in full."""
    if not totals["tokens"]:
        return sources.select("name", "all_tokens", F.lit(0.0).alias("weight"), F.lit(0).cast("long").alias("budget"))
    p = F.col("all_tokens") / F.lit(float(totals["tokens"]))
    weight = F.when(F.col("all_tokens") > 0, F.pow(p, F.lit(exponent)) / F.lit(totals["norm"])).otherwise(0.0)
    if budget is None:
        share = totals["largest"] / totals["tokens"]
        budget = totals["largest"] / (share**exponent / totals["norm"])
    out = sources.select("name", "all_tokens", weight.alias("weight"))
    return out.withColumn("budget", F.floor(F.col("weight") * F.lit(float(budget)) + 0.5).cast("long"))


def keyed(df: DataFrame) -> DataFrame:
    """One narrow row for each different (id, source, text), with how often it stands in the input."""
    rows = df.select(df["doc_id"].cast("long").alias("doc_id"), "source", _named(df["source"]).alias("name"), n_words(df["text"]).alias("tokens"), item(df).alias("item"))
    return rows.groupBy("doc_id", "source", "name", "tokens", "item").agg(F.count("*").alias("copies"))


def _with_plan(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Joins the per-source plan; a table of checked size goes to every task, so that a hot source moves nothing."""
    small = plan.limit(SMALL_TABLE + 1).count() <= SMALL_TABLE
    return rows.join(F.broadcast(plan) if small else plan, "name")


def _epochs(rows: DataFrame, plan: DataFrame, seed: int) -> DataFrame:
    """Every (row, epoch) that may be emitted, with its place in the epoch's permutation and the tokens before it."""
    plan = plan.withColumn("whole", F.when(F.col("all_tokens") > 0, F.floor(F.col("budget") / F.col("all_tokens"))).otherwise(1).cast("long"))
    plan = plan.withColumn("rest", F.col("budget") - F.col("whole") * F.col("all_tokens"))
    last = F.when(F.col("rest") > 0, F.col("whole")).otherwise(F.col("whole") - 1)
    rows = _with_plan(rows, plan.where("whole > 0 or rest > 0")).withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    rows = rows.withColumn("perm", digits(F.concat_ws(":", F.lit(seed), "epoch", "item"))).withColumn("part", F.shiftright("perm", 48))
    weight = F.col("tokens") * F.col("copies")
    parts = rows.groupBy("name", "epoch", "part").agg(F.sum(weight).alias("part_tokens"))
    over_parts = Window.partitionBy("name", "epoch").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("name", "epoch", "part", F.coalesce(F.sum("part_tokens").over(over_parts), F.lit(0)).alias("before"))
    inside = Window.partitionBy("name", "epoch", "part").orderBy("perm", "item", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("start", F.coalesce(F.sum(weight).over(inside), F.lit(0)))
    rows = rows.join(parts, ["name", "epoch", "part"]).withColumn("start", F.col("start") + F.col("before"))
    return rows.where((F.col("epoch") < F.col("whole")) | (F.col("start") + weight <= F.col("rest")))


def solved(df: DataFrame, max_repeats: float, min_entropy: float | None, budget: int | None) -> tuple[DataFrame, DataFrame]:
    rows = keep(keyed(df), "rows")
    sources = keep(source_tokens(rows), "sources")
    return rows, budgets(sources, *solve_exponent(sources, max_repeats, min_entropy), budget)


def mixture(df: DataFrame, max_repeats: float = 2.0, min_entropy: float | None = None, budget: int | None = None, block_tokens: int = 100_000, seed: int = 7) -> DataFrame:
    """The emitted rows in mixing order: (doc_id, source, tokens, epoch, block, place)."""
    rows, plan = solved(df, max_repeats, min_entropy, budget)
    spent = plan.agg(F.sum("budget").alias("spent")).first()["spent"] or 0
    blocks = max(1, -(-int(spent) // block_tokens))
    rows = _epochs(rows, plan, seed)
    rows = spell_out(rows, "copies")
    at = (F.col("epoch") * F.col("all_tokens") + F.col("start") + F.col("nth") * F.col("tokens")).cast("double")
    block = F.when(F.col("budget") > 0, F.least(F.floor(at * F.lit(float(blocks)) / F.col("budget").cast("double")), F.lit(blocks - 1))).otherwise(0).cast("long")
    rows = rows.withColumn("block", block)
    return rows.select("doc_id", "source", "tokens", "epoch", "block", digits(F.concat_ws(":", F.lit(f"{seed}b"), "block", "epoch", "item")).alias("place"))


def mixed(df: DataFrame, max_repeats: float = 2.0, min_entropy: float | None = None, budget: int | None = None, seed: int = 7) -> DataFrame:
    """The input rows, each as often as the mixture has it.

    Whether a row is in its source's last, partial epoch depends only on how its place compares with the last place
    that fits, so texts need not be moved to meet their decision.
    """
    rows, plan = solved(df, max_repeats, min_entropy, budget)
    ends = _epochs(rows, plan, seed).where("epoch = whole").groupBy("name").agg(F.max("perm").alias("end"))
    plan = plan.join(ends, "name", "left").withColumn("whole", F.when(F.col("all_tokens") > 0, F.floor(F.col("budget") / F.col("all_tokens"))).otherwise(1).cast("long"))
    plan = keep(plan.select("name", "whole", "end"), "plan")
    all_rows = df.select(F.struct("*").alias("row"), _named(df["source"]).alias("name"), item(df).alias("item"))
    out = _with_plan(all_rows, plan)
    perm = digits(F.concat_ws(":", F.lit(seed), "whole", "item"))
    times = F.col("whole") + F.coalesce((perm <= F.col("end")).cast("long"), F.lit(0))
    out = out.withColumn("times", times).where("times > 0")
    return out.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times")))).select("row.*")
