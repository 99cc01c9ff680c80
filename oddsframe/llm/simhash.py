"""Near-duplicate documents by SimHash, joined by meet-in-the-middle ball hashing.

Two fingerprints within `radius` bits of each other share at least one value within half the radius of both.  So
every different fingerprint emits all values in its half-radius ball, the values are shuffled, and fingerprints that
meet at a value are compared.  Values travel packed: a row holds what a block of fingerprints sends to one bucket,
as 24 bits a value beside the bucket number; what only seems to meet is told apart by the comparison.

Fingerprints that truly meet at one value are all links of each other, so a meeting emits links to its least member
only, and a pair only at the one value in its middle that takes the lower half of the differing bits.  The links
left out follow by induction on the least member; components come out whole.

Null and empty texts have fingerprint zero and link like any other; equal texts have equal fingerprints; a null id
counts as no id (a component of nulls alone has a null id); other columns are ignored; no rows, no output.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oddsframe.llm.components import components
from oddsframe.llm.mixing import item
from oddsframe.llm.shared import keep, small_batches, tasks

SHINGLE, SEED, RADIUS = 4, 42, 4
BLOCK = 1024  # fingerprints whose balls are spelled out together
SPELL_FPS = 16_384  # fingerprints whose balls one task spells out
BUCKET_VALUES = 4_000_000  # values that one bucket should hold
LOW_BITS = 24
ODD = np.uint64(0x9E3779B97F4A7C15)


def fingerprint(text: bytes) -> int:
    """64 majority bits over the hashes of all word shingles."""
    words = text.lower().split()
    if not words:
        return 0
    if len(words) <= SHINGLE:
        return int.from_bytes(xxhash.xxh64_digest(b" ".join(words), SEED), "big")
    line, digest = b" ".join(words), xxhash.xxh64_digest
    ends = np.cumsum([len(w) + 1 for w in words])
    starts, ends = [0, *ends[: -SHINGLE].tolist()], (ends[SHINGLE - 1 :] - 1).tolist()
    counts, n = np.zeros(64, np.int64), len(ends)
    for k in range(0, n, 65_536):
        hashes = b"".join([digest(line[s:e], SEED) for s, e in zip(starts[k : k + 65_536], ends[k : k + 65_536])])
        bits = np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1)
        counts += bits.sum(axis=0, dtype=np.uint32)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")


def fingerprints(df: DataFrame) -> DataFrame:
    """(doc_id, item, fp) of every row; fp holds the 64 bits as a signed long."""
    small_batches(df.sparkSession)

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            texts = part.column(2).cast(pa.binary()).to_pylist()
            values = np.array([fingerprint(t) if t else 0 for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(values)], names=["doc_id", "item", "fp"])

    rows = df.select(df["doc_id"].cast("long"), item(df).alias("item"), "text")
    return rows.mapInArrow(batches, "doc_id long, item long, fp long")


def ball(radius: int) -> np.ndarray:
    """What to XOR to a fingerprint for every value within `radius` bits."""
    masks = [sum(1 << b for b in bits) for n in range(radius + 1) for bits in combinations(range(64), n)]
    return np.array(masks, np.uint64)


def _spread(values: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each value, and 24 further bits."""
    mixed = values * ODD
    mixed ^= mixed >> np.uint64(32)
    mixed *= ODD
    low = (mixed >> np.uint64(8)).astype(np.uint32) & np.uint32((1 << LOW_BITS) - 1)
    mixed >>= np.uint64(40)  # 24 bits choose the bucket
    mixed *= np.uint64(buckets)
    mixed >>= np.uint64(24)
    return mixed.astype(np.uint32), low


def send(fps: np.ndarray, masks: np.ndarray, buckets: int) -> pd.DataFrame:
    """The balls of some fingerprints, packed by bucket: whose values (fps, counts) and the values' low bits."""
    bucket, low = _spread((fps[:, None] ^ masks[None, :]).ravel(), buckets)
    order = np.argsort(bucket.astype(np.uint16) if buckets <= 65_536 else bucket, kind="stable")
    bucket, who = bucket[order], (order // len(masks)).astype(np.uint32)
    low = low[order].view(np.uint8).reshape(-1, 4)[:, :3]
    new = np.flatnonzero(np.r_[True, (bucket[1:] != bucket[:-1]) | (who[1:] != who[:-1])])  # a run: values of one fingerprint in one bucket
    counts = np.diff(np.r_[new, len(who)]).astype(np.uint16)
    owners, run_bucket = fps[who[new]], bucket[new]
    cut = np.flatnonzero(np.r_[True, run_bucket[1:] != run_bucket[:-1]])
    ends = np.r_[cut[1:], len(new)]
    value_at = np.r_[new, len(who)]
    return pd.DataFrame({
        "bucket": run_bucket[cut].astype(np.int32),
        "fps": [owners[a:b].tobytes() for a, b in zip(cut, ends)],
        "counts": [counts[a:b].tobytes() for a, b in zip(cut, ends)],
        "low": [low[value_at[a] : value_at[b]].tobytes() for a, b in zip(cut, ends)],
    })


def _middle(a: np.ndarray, b: np.ndarray, half: int) -> np.ndarray:
    """a with the lower half of the bits flipped in which it differs from b (a < b)."""
    rest = a ^ b
    flips, out = (np.bitwise_count(rest) + 1) // 2, a.copy()
    for k in range(half):
        bit = rest & (~rest + np.uint64(1))
        out ^= np.where(flips > k, bit, np.uint64(0))
        rest ^= bit
    return out


def meet(owners: np.ndarray, counts: np.ndarray, low: np.ndarray, bucket: int, buckets: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links among the fingerprints that meet in a bucket; each owner's count of values, and the low bits of all of them."""
    known, who = np.unique(owners, return_inverse=True)
    packed = low.astype(np.uint64)
    packed <<= np.uint64(32)
    packed |= np.repeat(who.astype(np.uint32), counts)
    packed.sort()
    packed = packed[np.r_[True, packed[1:] != packed[:-1]]]
    value = (packed >> np.uint64(32)).astype(np.uint32)
    beside = value[1:] == value[:-1]
    met = np.r_[beside, False] | np.r_[False, beside]
    value, packed = value[met], packed[met]
    f = known[(packed & np.uint64(0xFFFFFFFF)).astype(np.int64)]
    del packed, beside, met
    half, left, right = (radius + 1) // 2, [], []

    def take(a, b, at):
        a, b = np.minimum(a, b), np.maximum(a, b)
        near = np.bitwise_count(a ^ b) <= radius
        a, b, at = a[near], b[near], at[near]
        home, bits = _spread(_middle(a, b, half), buckets)
        here = (home == bucket) & (bits == at)
        left.append(a[here])
        right.append(b[here])

    while len(f):
        start = np.r_[True, value[1:] != value[:-1]]
        group = np.cumsum(start) - 1
        size = np.bincount(group)
        many = size[group] > 1
        value, f, start = value[many], f[many], start[many]
        if not len(f):
            break
        group = np.cumsum(start) - 1
        least = f[start][group]
        linked = np.bitwise_count(f ^ least) <= radius
        member = linked & ~start
        take(least[member], f[member], value[member])
        failing = np.flatnonzero(~linked)
        members, groups = np.flatnonzero(member), int(group[-1]) + 1
        n_members = np.bincount(group[members], minlength=groups)
        each = n_members[group[failing]]  # what fails at the least member meets its linked members one by one
        if each.sum():
            first = np.r_[0, np.cumsum(n_members)][group[failing]]
            offset = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
            other, mine = members[np.repeat(first, each) + offset], np.repeat(failing, each)
            take(f[mine], f[other], value[mine])
        value, f = value[failing], f[failing]
    empty = np.zeros(0, np.uint64)
    return np.concatenate([empty, *left]), np.concatenate([empty, *right])


def links(fps: DataFrame, radius: int = RADIUS, bucket_values: int = BUCKET_VALUES) -> DataFrame:
    """Links (a, b) that connect all fingerprints within `radius` bits; `fps` has one row for each different fp."""
    masks = ball((radius + 1) // 2)
    n = fps.count()
    buckets = max(1, -(-n * len(masks) // bucket_values))

    def spell(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            values = part.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for k in range(0, len(values), BLOCK):
                yield pa.RecordBatch.from_pandas(send(values[k : k + BLOCK], masks, buckets), preserve_index=False)

    def bucket_links(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        joined = {c: np.frombuffer(b"".join(table.column(c).to_pylist()), t) for c, t in (("fps", np.uint64), ("counts", np.uint16), ("low", np.uint8))}
        low = np.zeros((len(joined["low"]) // 3, 4), np.uint8)
        low[:, :3] = joined.pop("low").reshape(-1, 3)
        a, b = meet(joined["fps"], joined["counts"], low.view(np.uint32).ravel(), key[0].as_py(), buckets, radius)
        return pa.table({"a": a.view(np.int64), "b": b.view(np.int64)})

    spread = fps.select("fp").repartition(-(-n // SPELL_FPS) or 1, "fp")  # the table is small, its balls are not
    sent = spread.mapInArrow(spell, "bucket int, fps binary, counts binary, low binary")
    return sent.repartition(tasks(fps.sparkSession, buckets), "bucket").groupBy("bucket").applyInArrow(bucket_links, "a long, b long")


def classes(df: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(doc_id, item, fp, component_id): the least id among all documents reachable over links."""
    rows = keep(fingerprints(df), "fingerprints")
    first = rows.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    roots = components(links(keep(first.select("fp"), "distinct"), radius))
    labels = first.join(roots, first["fp"] == roots["node"], "left").select("fp", F.coalesce("root", "fp").alias("root"), "first_id")
    least = labels.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return rows.join(labels.join(least, "root").select("fp", "component_id", "root"), "fp")


def near_duplicates(df: DataFrame, radius: int = RADIUS) -> DataFrame:
    return classes(df, radius).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def deduplicated(df: DataFrame, radius: int = RADIUS) -> DataFrame:
    """One row of each class stays: the one with the least (id, digest)."""
    found = keep(classes(df, radius).groupBy("root", "doc_id", "item").agg(F.count("*").alias("copies")), "classes")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "item")
    best = found.groupBy("root").agg(F.min(order).alias("best"), F.count("*").alias("n"))
    best = keep(best.where("n > 1"), "best")  # written, so that Spark can split a large class in the join
    gone = found.join(best, "root").where(~((F.col("doc_id").eqNullSafe(F.col("best.doc_id"))) & (F.col("item") == F.col("best.item"))))
    gone = gone.select(F.col("doc_id").alias("gone_id"), F.col("item").alias("gone_item"))
    rows = df.select(F.struct("*").alias("row"), df["doc_id"].cast("long").alias("id"), item(df).alias("item"))
    stay = rows.join(gone, F.col("id").eqNullSafe(F.col("gone_id")) & (F.col("item") == F.col("gone_item")), "left_anti")
    if not found.where("copies > 1").isEmpty():
        stay = stay.dropDuplicates(["id", "item"])
    return stay.select("row.*")
