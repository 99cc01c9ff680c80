"""Order-dependent steps that do not put a whole key into one task.

Rows are cut into blocks that do not decrease along the order; work inside a block is a window
over (key, block), and one summary row per block carries the rest.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from oddsframe.session import written


def join_null_safe(df: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join on keys of which NULL equals NULL; the columns of `df`, then the rest of `other`."""
    right = other.select(*[F.col(k).alias(f"_k_{k}") for k in keys], *[c for c in other.columns if c not in keys])
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys])
    return df.join(right, same).drop(*[f"_k_{k}" for k in keys])


def blocked(df: DataFrame, keys: list[str], index: str, block: int) -> DataFrame:
    """`_b`: number of the index block of a row, about `block` rows each where the index is even."""
    n = F.col(index).cast("double")
    ranges = df.groupBy(*keys).agg(F.min(n).alias("_lo"), F.max(n).alias("_hi"), F.count(F.lit(1)).alias("_all"))
    rows = join_null_safe(df, ranges, keys)
    share = (n - F.col("_lo")) / (F.col("_hi") - F.col("_lo") + 1)
    number = F.coalesce(F.floor(share * F.ceil(F.col("_all") / block)), F.lit(-1)).cast("long")
    return rows.withColumn("_b", number).drop("_lo", "_hi", "_all")


def previous_row(df: DataFrame, keys: list[str], block: Column, order: list[str], cols: list[str]) -> DataFrame:
    """`prev`: struct of `cols` of the row before, per key; NULL on the first row."""
    rows = df.withColumns({"_b": block, "_s": F.struct(*cols)})
    inside = F.lag("_s").over(W.partitionBy(*keys, "_b").orderBy(*order))
    last = rows.groupBy(*keys, "_b").agg(F.max_by("_s", F.struct(*order)).alias("_last"))
    before = F.lag("_last").over(W.partitionBy(*keys).orderBy("_b"))
    joined = join_null_safe(rows.withColumn("_in", inside), last.select(*keys, "_b", before.alias("_before")), [*keys, "_b"])
    return joined.select(*df.columns, F.coalesce("_in", "_before").alias("prev"))


def numbered(df: DataFrame, keys: list[str], order: list[str], name: str, total: str | None = None) -> DataFrame:
    """`name`: place of a row in its key by `order`, from 1; `total`: rows of the key.

    Rows are range-partitioned and sorted by (key, order) and written once, so a key spreads over as many tasks as its
    rows need; a key's rows per partition, a row each, give where the partition's first row stands.  These are written
    too: their true size lets the planner broadcast them where they are few, and the rows are not shuffled again.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(parts, *keys, *order).sortWithinPartitions(*keys, *order)
    dealt = written(dealt.withColumn("_at", F.monotonically_increasing_id()), "numbered").withColumn("_part", F.shiftright("_at", 33))
    runs = dealt.groupBy(*keys, "_part").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    runs = written(runs, "runs")
    before = F.coalesce(F.sum("_rows").over(W.partitionBy(*keys).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    runs = runs.select(*keys, "_part", (before - F.col("_first") + 1).alias("_shift"), F.sum("_rows").over(W.partitionBy(*keys)).alias("_total"))
    out = join_null_safe(dealt, runs, [*keys, "_part"])
    return out.select(*df.columns, (F.col("_at") + F.col("_shift")).alias(name), *([F.col("_total").alias(total)] if total else []))
