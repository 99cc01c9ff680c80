"""Removal of repeated passages: every byte inside a 100-byte string that also starts earlier.

A suffix array over all texts does not fit a machine, so texts are brought to shards by content.  Each 100-byte
window picks an anchor, the least hash among its 32-byte grams; equal windows pick equal anchors, and neighbouring
windows mostly share one.  An anchor that occurs once in all texts cannot be part of a repeated window.  For the
others, the stretch of text under an anchor's windows goes to the anchor's shard, which builds a suffix array by
induced sorting and finds from common prefixes which windows occurred earlier.  Whatever is equal within a batch of
texts is settled there, byte by byte, so a passage in a third of all texts reaches its shard once per batch.  Where
repeated anchors are found, their different stretches are counted too: an anchor whose stretches could fill a good part
of a sort, as it stands in ever different text, is split up, and its windows go by their own bytes, again only those
that occur twice.  Which anchors repeat is kept in a table and meets each document by a join, and so do those that are
split, unless they are few by count.

Null texts count as empty.  Earlier means smaller id (a null id comes last), then digest of the text, then start;
rows equal in id and text are one document and get the same result.  Texts shorter than a window lose nothing.
No rows, no output; other columns are ignored (`cleaned` keeps them).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oddsframe.llm.rolling import ODD, mix, prefix, sliding_least
from oddsframe.llm.shared import keep, return_memory, small_batches, tasks, utf8
from oddsframe.llm.suffixarray import repeats

WINDOW, GRAM = 100, 32
PIECE = 1 << 17  # bytes hashed together
BUCKET_BYTES = 16_000_000  # text whose anchors share a bucket
SHARD_BYTES = 8_000_000  # text whose stretches share a shard
SORT_BYTES = 1_500_000  # stretches sorted at once
STRETCH = 2 * WINDOW - GRAM  # bytes of a stretch at most
HOT_SHARE, HOT_ROWS = 0.5, 100  # split up: an anchor whose stretches may fill this share of a sort, and are more than so many
MOST_HOT = 200_000  # hot anchors up to which their codes (8 bytes each) go to every task
NONE = np.zeros(0, np.uint64)


def _piece_runs(data: np.ndarray, valid: np.ndarray, hot: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of windows that share an anchor: first and last window, the anchor's hash, a digest of the bytes under them,
    and whether the run is one window of a hot anchor.

    A window of a hot anchor is a run of its own, anchored by its digest.
    """
    sums, power = prefix(data)
    n = len(data) - GRAM + 1
    grams = mix((sums[GRAM:] - sums[:-GRAM]) * power[:n])
    least = (grams & ~np.uint64(0xFFFFFF)) | (np.uint64(0xFFFFFF) - np.arange(n, dtype=np.uint64))  # ties: the last
    least = sliding_least(least, WINDOW - GRAM + 1)
    valid = valid[: len(least)]
    new = valid & np.r_[True, (least[1:] != least[:-1]) | ~valid[:-1]]
    first = np.flatnonzero(new)
    last = np.flatnonzero(valid & np.r_[(least[1:] != least[:-1]) | ~valid[1:], True])
    anchor = grams[(np.uint64(0xFFFFFF) - (least[first] & np.uint64(0xFFFFFF))).astype(np.int64)]
    single = np.isin(_code(anchor), hot)
    if single.any():
        each = np.where(single, last - first + 1, 1)
        run = np.repeat(np.arange(len(first)), each)
        first = first[run] + np.arange(len(run)) - np.repeat(np.cumsum(each) - each, each)
        single, anchor = single[run], anchor[run]
        last = np.where(single, first, last[run])
    under = mix((sums[last + WINDOW] - sums[first]) * power[first])
    return first, last, np.where(single, under, anchor), under, single


def _marked(starts: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """Where a window may start in texts that lie side by side."""
    long_ = ends - starts >= WINDOW
    steps = np.zeros(n + 1, np.int8)
    np.add.at(steps, starts[long_], 1)
    np.add.at(steps, ends[long_] - WINDOW + 1, -1)
    return np.cumsum(steps[:-1], dtype=np.int8).view(bool)


def runs(data: np.ndarray, starts: np.ndarray, hot: np.ndarray = NONE) -> dict[str, np.ndarray]:
    """The runs of all texts of a batch; text number, first and last window within the batch's bytes, anchor, digest."""
    ends = np.append(starts[1:], len(data)) if len(starts) and starts[-1] != len(data) else starts[1:]
    starts = starts[: len(ends)]
    valid = _marked(starts, ends, len(data))
    parts = []
    for at in range(0, len(data), PIECE):
        upto = min(at + PIECE, len(data))
        data_part = data[at : min(upto + WINDOW - 1, len(data))]
        if len(data_part) >= WINDOW and valid[at:upto].any():
            ok = np.zeros(len(data_part), bool)
            ok[: upto - at] = valid[at:upto]
            first, last, *others = _piece_runs(data_part, ok, hot)
            parts.append((first + at, last + at, *others))
    cols = [np.concatenate(c) for c in zip(*parts)] if parts else [np.zeros(0, np.int64), np.zeros(0, np.int64), NONE, NONE, np.zeros(0, bool)]
    text = np.searchsorted(starts, cols[0], side="right") - 1 if len(starts) else cols[0]
    return {"text": text, "first": cols[0], "last": cols[1], "anchor": cols[2], "under": cols[3], "single": cols[4]}


def _bucket(anchor: np.ndarray, buckets: int) -> np.ndarray:
    return ((anchor >> np.uint64(40)) * np.uint64(buckets) >> np.uint64(24)).astype(np.int64)


def _code(anchor: np.ndarray) -> np.ndarray:
    """The bits of an anchor that tell it apart within its bucket, and within a batch of texts."""
    return anchor & np.uint64((1 << 40) - 1)


def keyed(df: DataFrame) -> DataFrame:
    """Identity of a document: the id, whether it is null, and a digest of the text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return df.select(F.coalesce("doc_id", F.lit(0)).cast("long").alias("k1"), F.col("doc_id").isNull().alias("late"), F.xxhash64(text, F.col("doc_id").isNull()).alias("k2"), text.alias("text"))


def _ids(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return part.column(0).to_numpy(), part.column(1).to_numpy()


def _distinct(found: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The anchors of a batch in order, and how many different stretches each has."""
    turn = np.lexsort((found["under"], found["last"] - found["first"], found["anchor"]))
    anchor, size, under = found["anchor"][turn], (found["last"] - found["first"])[turn], found["under"][turn]
    other = np.r_[True, anchor[1:] != anchor[:-1]]
    new = other | np.r_[True, (size[1:] != size[:-1]) | (under[1:] != under[:-1])]
    at = np.flatnonzero(other)
    return anchor[at], np.add.reduceat(new, at, dtype=np.uint32)


def _wide(lows: list[bytes]) -> np.ndarray:
    """Codes from their five bytes each."""
    flat = np.frombuffer(b"".join(lows), np.uint8).reshape(-1, 5)
    wide = np.zeros((len(flat), 8), np.uint8)
    wide[:, :5] = flat
    return wide.view(np.uint64).ravel()


def _listed(column: pa.Array) -> np.ndarray:
    """All numbers in a column of lists of codes."""
    return column.flatten().to_numpy(zero_copy_only=False).view(np.uint64)


def _lists(codes: np.ndarray, cut: np.ndarray) -> pa.ListArray:
    """Lists of codes that begin at `cut`."""
    return pa.ListArray.from_arrays(pa.array(np.r_[cut, len(codes)].astype(np.int32)), pa.array(codes.view(np.int64)))


def repeated(docs: DataFrame, buckets: int, split: bool = False, few: np.ndarray = NONE) -> DataFrame:
    """(k1, k2, codes): the anchors of each document that occur more than once in all texts, or the windows below its
    hot anchors where `split` (`few`, or the document's own `hot`); rows without codes list in `hot` anchors whose
    stretches are too many for one sort.

    A batch sends each of its anchors to the anchor's bucket once, with how many different stretches it has.
    """
    most = max(HOT_ROWS, int(HOT_SHARE * SORT_BYTES / STRETCH))
    parts = tasks(docs.sparkSession, buckets)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            return_memory()
            k1, k2 = _ids(part)
            found = runs(*utf8(part.column("text")), _listed(part.column("hot")) if split and not len(few) else few)
            if split:
                found = {name: column[found["single"]] for name, column in found.items()}
            anchor, text = found["anchor"], found["text"]
            if not len(anchor):
                continue
            _, many = _distinct(found)
            order = np.argsort(anchor, kind="stable")
            new = np.r_[True, anchor[order][1:] != anchor[order][:-1]]
            size = np.diff(np.r_[np.flatnonzero(new), len(order)])
            here = np.sort(order[np.repeat(size > 1, size)])  # settled in this batch: repeated
            out = []
            if len(here):
                cut = np.flatnonzero(np.r_[True, text[here][1:] != text[here][:-1]])
                for a, b in zip(cut, np.r_[cut[1:], len(here)]):
                    who = text[here[a]]
                    out.append((int(k2[who] % buckets), k1[who : who + 1].tobytes(), k2[who : who + 1].tobytes(), b"", np.unique(_code(anchor[here[a:b]])).tobytes(), b""))
            once = order[new]  # one of each for the others
            bucket, low = _bucket(anchor[once], buckets), _code(anchor[once])
            turn = np.lexsort((text[once], bucket))
            bucket, low, who, many = bucket[turn], low[turn], text[once][turn], many[turn]
            run = np.flatnonzero(np.r_[True, (bucket[1:] != bucket[:-1]) | (who[1:] != who[:-1])])
            counts, owners, run_bucket = np.diff(np.r_[run, len(who)]), who[run], bucket[run]
            low = low.view(np.uint8).reshape(-1, 8)[:, :5]
            at = np.r_[run, len(who)]
            cut = np.flatnonzero(np.r_[True, run_bucket[1:] != run_bucket[:-1]])
            for a, b in zip(cut, np.r_[cut[1:], len(run)]):
                out.append((int(run_bucket[a]), k1[owners[a:b]].tobytes(), k2[owners[a:b]].tobytes(), counts[a:b].astype(np.uint32).tobytes(), low[at[a] : at[b]].tobytes(), many[at[a] : at[b]].tobytes()))
            bucket = np.array([r[0] for r in out], np.int64)
            names = ["part", "bucket", "k1", "k2", "counts", "anchors", "many"]
            yield pa.RecordBatch.from_arrays([pa.array((bucket % parts).astype(np.int32)), pa.array(bucket), *(pa.array([r[k] for r in out], pa.binary()) for k in range(1, 6))], names=names)

    def match(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        return_memory()
        settled = table.filter(pc.equal(pc.binary_length(table.column("counts")), 0))
        sent = table.filter(pc.greater(pc.binary_length(table.column("counts")), 0))
        flat = {name: b"".join(sent.column(name).to_pylist()) for name in ("k1", "k2", "counts", "many")}
        ids1, ids2, many = np.frombuffer(flat["k1"], np.int64), np.frombuffer(flat["k2"], np.int64), np.frombuffer(flat["many"], np.uint32)
        owner = np.repeat(np.arange(len(ids1), dtype=np.int32), np.frombuffer(flat["counts"], np.uint32))
        low = _wide(sent.column("anchors").to_pylist())
        order = np.argsort(low, kind="stable")
        new = np.r_[np.ones(min(1, len(low)), bool), low[order][1:] != low[order][:-1]]
        first = np.flatnonzero(new)
        size = np.diff(np.r_[first, len(order)])
        hit = np.sort(order[np.repeat(size > 1, size)])
        cut = np.flatnonzero(np.r_[np.ones(min(1, len(hit)), bool), owner[hit][1:] != owner[hit][:-1]])
        own = [np.frombuffer(b"".join(settled.column(name).to_pylist()), kind) for name, kind in (("k1", np.int64), ("k2", np.int64), ("anchors", np.uint64))]
        sizes = pc.binary_length(settled.column("anchors")).to_numpy() // 8
        hot = low[order[first]][np.add.reduceat(many[order].astype(np.int64), first) > most] if len(first) and not split else NONE
        n = len(cut) + len(settled)
        codes = _lists(np.r_[low[hit], own[2]], np.r_[cut, len(hit) + np.cumsum(sizes) - sizes].astype(np.int64))
        columns = [pa.array(np.r_[ids1[owner[hit[cut]]], own[0]]), pa.array(np.r_[ids2[owner[hit[cut]]], own[1]]), codes, pa.nulls(n, codes.type)]
        rows = pa.table(columns, names=["k1", "k2", "codes", "hot"])
        extra = pa.table([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, codes.type), _lists(hot, np.zeros(1, np.int64))], names=rows.column_names)
        return pa.concat_tables([rows, extra]) if len(hot) else rows

    columns = ["k1", "k2", "text", *(["hot"] if split and not len(few) else [])]
    sent = docs.select(*columns).mapInArrow(send, "part int, bucket long, k1 binary, k2 binary, counts binary, anchors binary, many binary")
    return sent.repartitionById(parts, "part").groupBy("part", "bucket").applyInArrow(match, "k1 long, k2 long, codes array<long>, hot array<long>")


def marked(docs: DataFrame, buckets: int) -> tuple[DataFrame, np.ndarray]:
    """`docs` that hold repeated anchors, with `codes` of those and, of anchors that are split, `hot`, or few for all."""
    found = keep(repeated(docs, buckets), "anchors")
    own = found.where("codes is not null").select("k1", "k2", "codes", "hot")
    hot = found.where("hot is not null").select(F.explode("hot").alias("code")).distinct()
    many = hot.limit(MOST_HOT + 1).count()
    few = np.unique(np.array([r["code"] for r in hot.collect()], np.int64).view(np.uint64)) if many <= MOST_HOT else NONE
    parts = [own]
    if len(few):
        parts.append(repeated(docs, buckets, split=True, few=few))
    elif many:
        held = own.select("k1", "k2", F.explode("codes").alias("code")).join(hot, "code")
        held = keep(held.groupBy("k1", "k2").agg(F.collect_set("code").alias("hot")), "split")
        windows = repeated(docs.join(held, ["k1", "k2"]), buckets, split=True)
        parts += [held.select("k1", "k2", F.lit(None).cast("array<long>").alias("codes"), "hot"), windows]
    marks = reduce(DataFrame.unionByName, parts).groupBy("k1", "k2").agg(*[F.flatten(F.collect_list(c)).alias(c) for c in ("codes", "hot")])
    return docs.join(marks, ["k1", "k2"]), few


def _alike(raw: memoryview, turn: np.ndarray, first: np.ndarray, last: np.ndarray, same: np.ndarray) -> np.ndarray:
    """Which of the stretches that agree with the one before them in their digests also agree in their bytes."""
    at = np.flatnonzero(same)
    for k, i, j, n in zip(at.tolist(), first[turn[at]].tolist(), first[turn[at - 1]].tolist(), (last - first)[turn[at]].tolist()):
        same[k] = raw[i : i + n + WINDOW] == raw[j : j + n + WINDOW]
    return same


def _stretches(part: pa.RecordBatch, few: np.ndarray = NONE) -> tuple[tuple, tuple]:
    """What the repeated anchors of a batch cover: spans settled here, and stretches for the shards."""
    k1, k2, late = (part.column(k).to_numpy(zero_copy_only=False) for k in ("k1", "k2", "late"))
    data, starts = utf8(part.column("text"))
    raw = data.tobytes()
    found = runs(data, starts, few if len(few) else _listed(part.column("hot")))
    hit = np.isin(_code(found["anchor"]), _listed(part.column("codes")))
    text, first, last, anchor, under = (found[c][hit] for c in ("text", "first", "last", "anchor", "under"))
    turn = np.lexsort((first, k2[text], k1[text], late[text], under, last - first, anchor))
    same = np.r_[np.zeros(min(1, len(turn)), bool), (anchor[turn][1:] == anchor[turn][:-1]) & (under[turn][1:] == under[turn][:-1]) & ((last - first)[turn][1:] == (last - first)[turn][:-1])]
    same = _alike(memoryview(raw), turn, first, last, same)
    later = np.zeros(len(turn), bool)
    later[turn] = same
    # the same document may stand in a batch twice: its stretches are as early as those of its twin
    head = turn[np.maximum.accumulate(np.where(same, 0, np.arange(len(turn))))] if len(turn) else turn
    twin = np.zeros(len(turn), bool)
    twin[turn] = (k1[text[turn]] == k1[text[head]]) & (k2[text[turn]] == k2[text[head]]) & (late[text[turn]] == late[text[head]]) & (first[turn] - starts[text[turn]] == first[head] - starts[text[head]])
    later &= ~twin
    owner, start, end = text[later], (first - starts[text])[later], (last - starts[text])[later] + WINDOW
    new = np.r_[True, (owner[1:] != owner[:-1]) | (start[1:] > end[:-1])] if len(owner) else later[:0]  # neighbours become one span
    owner, start, end = owner[new], start[new], end[np.r_[new[1:], True]] if len(owner) else end
    settled = (k1[owner], k2[owner], start, end)
    go = ~later
    text, first, last, anchor = text[go], first[go], last[go], anchor[go]
    stretch = pa.array([raw[a:b] for a, b in zip(first.tolist(), (last + WINDOW).tolist())], pa.binary())
    return settled, (anchor, k1[text], k2[text], late[text], first - starts[text], stretch)


def _shard_repeats(late: np.ndarray, k1: np.ndarray, k2: np.ndarray, first: np.ndarray, stretch: list[bytes]) -> tuple[list, ...]:
    """Spans (k1, k2, start, end) of the windows of a shard's stretches that occurred earlier."""
    out: tuple[list, ...] = ([], [], [], [])

    def add(i: int, a: int, b: int) -> None:
        for column, value in zip(out, (int(k1[i]), int(k2[i]), int(first[i]) + a, int(first[i]) + b)):
            column.append(value)

    known: dict[bytes, int] = {}
    lead = []
    for i in np.lexsort((first, k2, k1, late)):
        j = known.setdefault(stretch[i], i)
        if j == i:
            lead.append(i)
        elif (k1[i], k2[i], late[i], first[i]) != (k1[j], k2[j], late[j], first[j]):
            add(i, 0, len(stretch[i]))
    text = np.frombuffer(b"".join(stretch[i] for i in lead), np.uint8)
    sizes = np.array([len(stretch[i]) for i in lead])
    ends = np.cumsum(sizes)
    begins = ends - sizes
    repeated = repeats(text, _marked(begins, ends, len(text)), WINDOW)
    edge = np.diff(np.r_[0, repeated.astype(np.int8), 0])
    for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)):
        i = int(np.searchsorted(ends, a, side="right"))
        while a < b:  # stretches follow each other without a gap
            upto = min(b, int(ends[i]))
            add(lead[i], int(a - begins[i]), int(upto - 1 - begins[i]) + WINDOW)
            a, i = upto, i + 1
    return out


def sent_stretches(docs: DataFrame, shards: int, buckets: int) -> DataFrame:
    """What goes to the shards: stretches by anchor, and spans that are settled already (without a stretch)."""
    parts = tasks(docs.sparkSession, shards)
    held, few = marked(docs, buckets)

    def stretch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            return_memory()
            (a1, a2, start, end), (anchor, k1, k2, late, first, bytes_) = _stretches(part, few)
            n, m = len(a1), len(k1)
            shard = np.r_[(a2.astype(np.int64) % shards), (mix(anchor) % np.uint64(shards)).astype(np.int64)]
            yield pa.RecordBatch.from_arrays([
                pa.array((shard % parts).astype(np.int32)), pa.array(shard), pa.array(np.r_[np.zeros(n, np.int64), anchor.view(np.int64)]), pa.array(np.r_[a1, k1]), pa.array(np.r_[a2, k2]),
                pa.array(np.r_[np.zeros(n, bool), late.astype(bool)]), pa.array(np.r_[start, first]), pa.array(np.r_[end, np.zeros(m, np.int64)]), pa.concat_arrays([pa.nulls(n, pa.binary()), bytes_]),
            ], names=["part", "shard", "anchor", "k1", "k2", "late", "start", "end", "stretch"])

    return held.mapInArrow(stretch, "part int, shard long, anchor long, k1 long, k2 long, late boolean, start long, end long, stretch binary")


def spans(docs: DataFrame, shard_bytes: int = SHARD_BYTES, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """(k1, k2, spans): the covered byte ranges of every document that has any; `docs` comes from keyed()."""
    small_batches(docs.sparkSession)
    total = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    shards, buckets = max(1, -(-total // shard_bytes)), max(1, -(-total // bucket_bytes))

    def sort_shard(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        return_memory()
        c = {name: table.column(name).to_numpy() for name in ("anchor", "k1", "k2", "late", "start", "end")}
        stretches = table.column("stretch").to_pylist()
        ready = np.array([s is None for s in stretches], bool)
        out = [c["k1"][ready].tolist(), c["k2"][ready].tolist(), c["start"][ready].tolist(), c["end"][ready].tolist()]
        go = np.flatnonzero(~ready)
        parts = 1 + sum(len(stretches[i]) for i in go) // SORT_BYTES  # sorted in parts by anchor: equal windows share one
        part_of = mix(c["anchor"][go].view(np.uint64) ^ ODD) % np.uint64(parts)
        for k in range(parts):
            at = go[part_of == np.uint64(k)]
            if len(at):
                found = _shard_repeats(*(c[name][at] for name in ("late", "k1", "k2", "start")), [stretches[i] for i in at])
                for column, more in zip(out, found):
                    column.extend(more)
        return pa.table(dict(zip(("k1", "k2", "start", "end"), (pa.array(x, pa.int64()) for x in out))))

    sent = sent_stretches(docs, shards, buckets)
    found = sent.repartitionById(tasks(docs.sparkSession, shards), "part").groupBy("part", "shard").applyInArrow(sort_shard, "k1 long, k2 long, start long, end long")
    return found.groupBy("k1", "k2").agg(F.collect_set(F.struct("start", "end")).alias("spans"))


def cut(text: bytes, found: list | None) -> tuple[bytes, int, int]:
    """What is left of a text without its spans, the bytes removed, and the number of maximal runs."""
    if found is None or len(found) == 0:
        return text, 0, 0
    kept, n, at = [], 0, 0
    merged: list[list[int]] = []
    for start, end in sorted((s["start"], s["end"]) for s in found):
        if merged and start <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], end)
        else:
            merged.append([start, end])
    for start, end in merged:
        kept.append(text[at:start])
        n, at = n + end - start, end
    return b"".join([*kept, text[at:]]), n, len(merged)


def repeated_passages(df: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row."""
    docs = keyed(df)
    joined = docs.join(spans(docs), ["k1", "k2"], "left")

    def digest(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            texts = part.column("text").cast(pa.binary()).to_pylist()
            done = [(len(t), *cut(t, s)) for t, s in zip(texts, part.column("spans").to_pylist())]
            ids = [None if late else k for k, late in zip(part.column("k1").to_pylist(), part.column("late").to_pylist())]
            yield pa.RecordBatch.from_arrays([
                pa.array(ids, pa.int64()), pa.array([d[0] for d in done], pa.int64()), pa.array([d[2] for d in done], pa.int64()), pa.array([d[3] for d in done], pa.int64()),
                pa.array([hashlib.sha256(d[1]).hexdigest() for d in done], pa.string()),
            ], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return joined.mapInArrow(digest, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def cleaned(df: DataFrame) -> DataFrame:
    """The input rows with repeated passages cut out; a character cut in two is dropped, a null text stays null."""
    found = spans(keyed(df))

    @F.pandas_udf("string")
    def left_over(text: pd.Series, found: pd.Series) -> pd.Series:
        return pd.Series([t if s is None else cut(t.encode(), list(s))[0].decode("utf-8", "ignore") for t, s in zip(text, found)])

    key = [F.coalesce(df["doc_id"], F.lit(0)).cast("long").alias("k1"), F.xxhash64(F.coalesce(df["text"], F.lit("")), df["doc_id"].isNull()).alias("k2")]
    joined = df.select(F.struct("*").alias("row"), *key).join(found, ["k1", "k2"], "left")
    new = F.when(F.col("spans").isNull(), F.col("row.text")).otherwise(left_over(F.col("row.text"), F.col("spans")))
    return joined.select(F.col("row").withField("text", new).alias("row")).select("row.*")
