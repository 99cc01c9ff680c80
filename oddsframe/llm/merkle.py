"""Merkle manifest of a dataset: a digest a row, a tree over each group's rows, and a tree over the groups.

H is the lowercase hex sha256 of its inputs' concatenation.  A row's leaf is H of its fields, each `-` if null, else
UTF-8 byte count, `:`, value.  In a group, leaves ascend by id; while several nodes remain, every `fanout` consecutive
ones become their H (the last run may be shorter, down to one).  What remains is the group's subroot; subroots in the
order of the groups (null first, bytewise) likewise give the root.  A row's proof is the siblings on its way to the
root; whoever has a row, its proof and the root can verify the row without the rest.

Nodes of a tree are addressed by (group, position).  One pass takes SPAN levels: conditional aggregates spread a
block of fanout ** SPAN nodes into as many columns, and column expressions hash runs of them level by level.  On the
way down a block meets the proof of its own node, and the columns beside a slot are the siblings of what it holds, so
a proof is put together where it is used and never shuffled whole.

Positions come from a range partitioning by (group, id) and the row counts of its partitions, so a group may hold any
share of the rows.  A null id comes first; rows equal in group and id follow each other by leaf, and each is a leaf.
No rows, no output; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from oddsframe.llm.shared import keep, tasks

FANOUT, SPAN = 2, 4  # children of a node; levels a pass
SORT_ROWS = 500_000  # rows of a partition that is numbered
SMALL_TABLE = 50_000  # rows up to which counts of partitions may be broadcast
STEP = "struct<left: string, right: string>"  # siblings before and after a node


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """`position` of every row in its `tree` by `order`, and `nodes`, the number of rows of that tree."""
    spark = rows.sparkSession
    parts = tasks(spark, -(-rows.count() // SORT_ROWS))
    dealt = rows.repartitionByRange(parts, "tree", *order).sortWithinPartitions("tree", *order)
    dealt = keep(dealt.withColumn("at", F.monotonically_increasing_id()), "sorted").withColumn("part", F.shiftright("at", 33))
    runs = dealt.groupBy("tree", "part").agg(F.min("at").alias("first"), F.count("*").alias("rows"))
    before = F.sum("rows").over(W.partitionBy("tree").orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    runs = keep(runs.select("tree", "part", (F.coalesce(before, F.lit(0)) - F.col("first")).alias("shift"), F.sum("rows").over(W.partitionBy("tree")).alias("nodes")), "runs")
    small = runs.limit(SMALL_TABLE + 1).count() <= SMALL_TABLE
    placed = dealt.join(F.broadcast(runs) if small else runs, ["tree", "part"])
    return placed.withColumn("position", F.col("at") + F.col("shift")).drop("at", "part", "shift")


def _name(step: int, slot: int) -> str:
    return f"node{step}_{slot}"


def _grows(step: int, fanout: int) -> Column:
    """Whether a tree still has several nodes after `step` levels of a pass."""
    return F.col("nodes") > fanout**step


def raised(nodes: DataFrame, fanout: int, span: int) -> DataFrame:
    """Blocks of (tree, nodes, position, node, load): their nodes in columns, level by level, and what is left on top."""
    width = fanout**span
    nodes = nodes.withColumns({"slot": F.col("position") % width, "position": F.floor(F.col("position") / width).cast("long")})
    spread = [F.max(F.when(F.col("slot") == k, F.struct("node", "load"))).alias(f"held{k}") for k in range(width)]
    blocks = nodes.groupBy("tree", "position").agg(F.max("nodes").alias("nodes"), *spread)
    blocks = blocks.withColumns({_name(0, k): F.col(f"held{k}.node") for k in range(width)} | {f"load{k}": F.col(f"held{k}.load") for k in range(width)})
    blocks = blocks.drop(*[f"held{k}" for k in range(width)])
    for step in range(span):
        runs = {}
        for k in range(0, fanout ** (span - step), fanout):
            first = F.col(_name(step, k))
            joined = F.concat_ws("", *[_name(step, k + c) for c in range(fanout)])  # skips slots without a node
            runs[_name(step + 1, k // fanout)] = F.when(first.isNull(), None).when(_grows(step, fanout), F.sha2(joined, 256)).otherwise(first)
        blocks = blocks.withColumns(runs)
    return blocks


def tree(rows: DataFrame, order: list[str], fanout: int, span: int) -> tuple[list[DataFrame], DataFrame]:
    """Block tables from the leaves up, and (tree, node) of the tops; rows: (tree, node, load) and what `order` names."""
    nodes = numbered(rows, order)
    most = nodes.agg(F.max("nodes")).first()[0] or 1
    levels = []
    while not levels or most > 1:
        levels.append(keep(raised(nodes.select("tree", "nodes", "position", "node", "load"), fanout, span), f"level{len(levels)}"))
        width = fanout**span
        most = -(-most // width)
        nodes = levels[-1].select("tree", F.ceil(F.col("nodes") / width).alias("nodes"), "position", F.col(_name(span, 0)).alias("node"), F.lit(None).cast("string").alias("load"))
    return levels, nodes.select("tree", "node")


def _siblings(slot: int, fanout: int, span: int) -> Column:
    """Steps from a slot of a block to the block's own node."""
    steps = []
    for step in range(span):
        own = slot // fanout**step
        first = own - own % fanout
        left = F.concat_ws("", *[_name(step, k) for k in range(first, own)])
        right = F.concat_ws("", *[_name(step, k) for k in range(own + 1, first + fanout)])
        steps.append(F.when(_grows(step, fanout), F.struct(left.alias("left"), right.alias("right"))))
    return F.array_compact(F.array(*steps))


def proved(levels: list[DataFrame], tops: DataFrame, fanout: int, span: int) -> DataFrame:
    """(tree, node, load, proof, and the other columns of `tops`) of the leaves; tops: (tree, proof, ...)."""
    carried = [c for c in tops.columns if c not in ("tree", "proof")]
    above = tops.withColumn("position", F.lit(0).cast("long"))
    width = fanout**span
    for blocks in reversed(levels):
        met = blocks.join(above, ["tree", "position"])
        slots = [
            F.struct((F.col("position") * width + k).alias("position"), F.col(_name(0, k)).alias("node"), F.col(f"load{k}").alias("load"), _siblings(k, fanout, span).alias("steps"))
            for k in range(width)
        ]
        opened = met.select("tree", "proof", *carried, F.explode(F.filter(F.array(*slots), lambda s: s["node"].isNotNull())).alias("slot"))
        above = opened.select("tree", *carried, F.concat("slot.steps", "proof").alias("proof"), "slot.position", "slot.node", "slot.load")
    return above


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and a proof lead to."""
    return F.aggregate(proof, leaf, lambda node, step: F.sha2(F.concat(step["left"], node, step["right"]), 256))


def manifest(df: DataFrame, fields: tuple[str, ...], id_column: str, group: str, tampered: DataFrame | None = None, fanout: int = FANOUT, span: int = SPAN) -> DataFrame:
    """(id, leaf, subroot, root, proof_sha256, folded_root, verified), one row an input row.

    `tampered` is `df` with column `claimed` beside the rest: the leaf of what is put to the proof in place of the row
    (null: the row itself).  Without it every row is verified as it stands.
    """
    claimed = tampered["claimed"] if tampered is not None else F.lit(None).cast("string")
    df = tampered if tampered is not None else df
    name = df[group].cast("string")
    leaves = df.select(
        F.coalesce(F.concat(F.lit("s:"), name), F.lit("none")).alias("tree"),  # null sorts before all names
        leaf(df, fields).alias("node"),
        F.struct(df[id_column].cast("long").alias("id"), claimed.alias("claimed")).alias("load"),
    ).withColumn("id", F.col("load.id"))
    levels, subroots = tree(leaves, ["id", "node"], fanout, span)
    groups = subroots.select(F.lit("").alias("tree"), "node", F.col("tree").alias("load"))
    group_levels, top = tree(groups, ["load"], fanout, span)
    top = top.select("tree", F.col("node").alias("root"), F.array().cast(f"array<{STEP}>").alias("proof"))
    proved_groups = proved(group_levels, top, fanout, span).select(F.col("load").alias("tree"), F.col("node").alias("subroot"), "root", "proof")
    rows = proved(levels, keep(proved_groups, "groups"), fanout, span)
    siblings = F.array_join(F.transform("proof", lambda s: F.concat(s["left"], s["right"])), "")
    rows = rows.select(
        F.col("load.id").alias("id"), F.col("node").alias("leaf"), "subroot", "root",
        F.sha2(siblings, 256).alias("proof_sha256"), folded(F.coalesce("load.claimed", "node"), F.col("proof")).alias("folded_root"),
    )
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))


def leaf(df: DataFrame, fields: tuple[str, ...], changed: dict[str, Column] | None = None) -> Column:
    return digest(*[field((changed or {}).get(c, df[c])) for c in fields])


def documents_manifest(df: DataFrame) -> DataFrame:
    """The manifest of `documents` by language, put to the proof: where 7 divides the crc32 of a row's decimal id, the
    row comes with one more in n_chars (a null stays, and a row with a null id stays as it is)."""
    fields = ("doc_id", "source", "lang", "n_chars", "text")
    chosen = (F.crc32(df["doc_id"].cast("string")) % 7 == 0) & df["n_chars"].isNotNull()
    claimed = F.when(chosen, leaf(df, fields, {"n_chars": df["n_chars"] + 1}))
    narrow = df.select(*[df[c] for c in fields], claimed.alias("claimed"))
    return manifest(narrow, fields, "doc_id", "lang", tampered=narrow).withColumnRenamed("id", "doc_id")
