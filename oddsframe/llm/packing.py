"""Best-fit packing of documents into sequences of several permitted lengths.

Documents are cut into pieces of the longest length at most.  Pieces are dealt by value into groups of bounded size,
and every group is packed on its own: longest piece first, each into the open bin that it fills best.  A piece that
fits no open bin opens one.  All permitted lengths are judged for it by what the pieces still to come can fill them
with: each is filled with the longest that fit, shrunk to its contents, and the one with the least cost per token wins
(a fixed cost a sequence, linear work, and quadratic attention).  In the end every bin shrinks to the least length that
holds it.  That choice looks ahead one bin only; so the group is also packed with each length as the least that may be
opened, and the cheapest of these packings stands.  It never costs more than any single length.

Null and empty texts have no piece and come out with a null sequence.  Rows equal in id and text are packed one by
one.  Ties go by length, then digest, then piece.  No rows, no output; other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections import Counter
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oddsframe.llm.mixing import item
from oddsframe.llm.shared import keep, n_words, spell_out

LENGTHS = (512, 1024, 2048, 4096, 8192)
GROUP_PIECES = 20_000
FIXED, ATTENTION = 64.0, 32_768.0  # cost of a sequence: FIXED + n + n * n / ATTENTION
SCHEMA = "doc_id long, piece long, first_token long, tokens long, sequence long, capacity int, offset long"


def cost(n: int) -> float:
    return FIXED + n + n * n / ATTENTION


class _Rest:
    """Sizes of the pieces that are still to come, and what a bin could be filled with from them."""

    def __init__(self, sizes: list[int], lengths: tuple[int, ...]):
        self.count = Counter(sizes)
        self.sizes = sorted(self.count)
        self.lengths = lengths

    def take(self, size: int) -> None:
        self.count[size] -= 1
        if not self.count[size]:
            del self.count[size]
            self.sizes.pop(bisect_left(self.sizes, size))

    def filled(self, used: int, length: int) -> int:
        at = bisect_right(self.sizes, length - used)
        while at:
            size = self.sizes[at - 1]
            used += size * min(self.count[size], (length - used) // size)
            at = bisect_right(self.sizes, length - used, 0, at - 1)
        return used

    def best_length(self, size: int) -> int:
        """Length of least cost per token for a bin that begins with a piece of this size."""

        def per_token(length: int) -> tuple[float, int]:
            used = self.filled(size, length)
            return cost(self.lengths[bisect_left(self.lengths, used)]) / used, length

        return min((n for n in self.lengths if n >= size), key=per_token)


def packed(sizes: list[int], lengths: tuple[int, ...], least: int | None = None) -> tuple[list[int], list[int], list[int]]:
    """Best fit of sizes in falling order; bins are opened by the look-ahead, or (`least`) at that length or above."""
    bins: list[int] = []  # tokens in each bin
    room: dict[int, list[int]] = {}  # bins by free space
    spaces: list[int] = []  # free spaces that occur, ascending
    rest = _Rest(sizes, lengths) if least is None else None
    where, offsets = [], []

    def put(k: int, free: int) -> None:
        if free:
            if free not in room:
                room[free] = []
                insort(spaces, free)
            room[free].append(k)

    for size in sizes:
        if rest:
            rest.take(size)
        at = bisect_left(spaces, size)
        if at < len(spaces):
            free = spaces[at]
            k = room[free].pop()
            if not room[free]:
                del room[free]
                del spaces[at]
        else:
            free = rest.best_length(size) if rest else lengths[bisect_left(lengths, max(size, least or 0))]
            k = len(bins)
            bins.append(0)
        where.append(k)
        offsets.append(bins[k])
        bins[k] += size
        put(k, free - size)
    return where, offsets, [lengths[bisect_left(lengths, used)] for used in bins]


def best_fit(sizes: list[int], lengths: tuple[int, ...] = LENGTHS) -> tuple[list[int], list[int], list[int]]:
    """Bin and offset of every piece (sizes in falling order), and the final length of every bin."""
    lengths = tuple(sorted(lengths))
    return min((packed(sizes, lengths, least) for least in (None, *lengths)), key=lambda found: sum(map(cost, found[2])))


def pieces(df: DataFrame, longest: int) -> DataFrame:
    rows = df.select(df["doc_id"].cast("long"), n_words(df["text"]).alias("words"), item(df).alias("item")).groupBy("doc_id", "words", "item").agg(F.count("*").alias("copies"))
    rows = spell_out(rows, "copies")
    rows = rows.withColumn("piece", F.explode_outer(F.when(F.col("words") > 0, F.sequence(F.lit(0).cast("long"), F.floor((F.col("words") - 1) / longest).cast("long")))))
    first = F.col("piece") * longest
    return rows.select("doc_id", "item", "nth", "piece", first.alias("first_token"), F.when(F.col("words") > 0, F.least(F.col("words") - first, F.lit(longest))).otherwise(0).alias("tokens"))


def pack(df: DataFrame, lengths: tuple[int, ...] = LENGTHS, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """One row a piece: its sequence, the sequence's length, and where the piece starts in it."""
    rows = keep(pieces(df, max(lengths)), "pieces")
    groups = max(1, -(-rows.where("piece is not null").count() // group_pieces))
    packed = rows.where("piece is not null").withColumn("group", F.pmod(F.xxhash64("item", F.floor(F.col("nth") / 1000), "piece"), F.lit(groups)))

    def one_group(key: tuple[Any, ...], part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["tokens", "item", "piece", "nth"], ascending=[False, True, True, True], kind="stable")
        where, offsets, capacity = best_fit(part["tokens"].tolist(), lengths)
        return part.assign(sequence=[(int(key[0]) << 32) + k for k in where], capacity=[capacity[k] for k in where], offset=offsets)[
            ["doc_id", "piece", "first_token", "tokens", "sequence", "capacity", "offset"]
        ]

    none = F.lit(None).cast("long")
    empty = rows.where("piece is null").select("doc_id", none.alias("piece"), none.alias("first_token"), "tokens", none.alias("sequence"), none.cast("int").alias("capacity"), none.alias("offset"))
    return packed.groupBy("group").applyInPandas(one_group, SCHEMA).unionByName(empty)
