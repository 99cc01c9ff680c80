"""Reproducible shuffle into shards: a keyed permutation of global row numbers, in built-in functions only.

Rows get numbers 0..n-1 in an order fixed by their values.  A Feistel network over Z_a x Z_b with a*b just
above n permutes the numbers; a result outside 0..n-1 is fed through the network again until it falls inside
(cycle walking), so the whole is a permutation of 0..n-1 that no task needs to know in full.  Position p goes to
shard p mod S at slot p div S: shard sizes differ by one row at most and slots have no gaps.

Null and empty texts have size 1 and CRC 0; a null id is a value like any other; rows equal in id, size and CRC
are interchangeable and get neighbouring numbers; other input columns are ignored; no rows in, no rows out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from oddsframe.llm.shared import spell_out

ROUNDS = 6
WALKS = 64  # more than any number needs: about one in sqrt(n) leaves the range at each pass
BLOCK_DIGITS = 3  # row numbers are dealt by 16**3 blocks of hashed values


def _mix(seed: int, r: int, x: Column) -> Column:
    """Round function: 60 bits of a digest."""
    digest = F.md5(F.concat(F.lit(f"{seed}:{r}:"), x.cast("string")))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def _sides(n: Column) -> tuple[Column, Column]:
    a = F.greatest(F.ceil(F.sqrt(n.cast("double"))), F.lit(1)).cast("long")
    return a, F.floor((n + a - 1) / a).cast("long")


def _once(v: Column, a: Column, b: Column, seed: int, back: bool = False) -> Column:
    """One pass of the network over a single number."""
    left, right = F.floor(v / b).cast("long"), v % b
    for r in reversed(range(ROUNDS)) if back else range(ROUNDS):
        step = F.lit(-1 if back else 1)
        if r % 2 == 0:
            left = F.pmod(left + step * (_mix(seed, r, right) % a), a)
        else:
            right = F.pmod(right + step * (_mix(seed, r, left) % b), b)
    return left * b + right


def permuted(df: DataFrame, number: str, total: str, seed: int = 42, back: bool = False, into: str = "position") -> DataFrame:
    """Adds the place of row `number` among `total` rows; `back` inverts it."""
    a, b = _sides(F.col(total))
    out = df.withColumns({"_a": a, "_b": b}).withColumns({"_l": F.floor(F.col(number) / F.col("_b")).cast("long"), "_r": F.col(number) % F.col("_b")})
    for r in reversed(range(ROUNDS)) if back else range(ROUNDS):  # a column a round: each digest is computed once
        side, other, size = ("_l", "_r", "_a") if r % 2 == 0 else ("_r", "_l", "_b")
        move = _mix(seed, r, F.col(other)) % F.col(size)
        out = out.withColumn(side, F.pmod(F.col(side) - move if back else F.col(side) + move, F.col(size)))
    v, n = F.col("_l") * F.col("_b") + F.col("_r"), F.col(total)
    walked = F.aggregate(F.sequence(F.lit(1), F.lit(WALKS)), v, lambda x, _: F.when(x < n, x).otherwise(_once(x, F.col("_a"), F.col("_b"), seed, back)))
    found = F.when(v < n, v).otherwise(walked)
    out = out.withColumn(into, found).drop("_a", "_b", "_l", "_r")
    return out.withColumn(into, F.when(F.col(into) < n, F.col(into)).otherwise(F.raise_error(F.lit("cycle walk did not end")).cast("long")))


def number_rows(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, size, text_crc32, number, total) of every row.

    Equal rows are counted before anything moves, hashed blocks hold an even share each however the ids are
    spread, and only the count of each block is brought together.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    rows = rows.groupBy("doc_id", "size", "text_crc32").agg(F.count("*").alias("copies"))
    name = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), "text_crc32", "size")
    rows = rows.withColumn("block", F.conv(F.substring(F.md5(name), 1, BLOCK_DIGITS), 16, 10).cast("int"))
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy("block").agg(F.sum("copies").alias("rows")).select(
        "block", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("offset"), F.sum("rows").over(Window.partitionBy()).alias("total")
    )  # 16**BLOCK_DIGITS rows at most, whatever the input
    inside = Window.partitionBy("block").orderBy("doc_id", "size", "text_crc32").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("first", F.coalesce(F.sum("copies").over(inside), F.lit(0)))
    rows = rows.join(F.broadcast(blocks), "block").withColumn("first", F.col("first") + F.col("offset"))
    return spell_out(rows, "copies").select("doc_id", "size", "text_crc32", "total", (F.col("first") + F.col("nth")).alias("number"))


def assign_shards(df: DataFrame, shards: int = 16, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Shard and slot of every row under the `rows` law."""
    placed = permuted(number_rows(df, id_col, text_col), "number", "total", seed)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), (F.col("position") % shards).cast("int").alias("shard"),
        F.floor(F.col("position") / shards).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )


def row_number_at(places: DataFrame, total: int, shards: int = 16, seed: int = 42) -> DataFrame:
    """Which row number stands at a (shard, slot): the same network backwards."""
    at = places.withColumns({"_p": F.col("slot") * shards + F.col("shard"), "_n": F.lit(total).cast("long")})
    return permuted(at, "_p", "_n", seed, back=True, into="number").drop("_p", "_n")
