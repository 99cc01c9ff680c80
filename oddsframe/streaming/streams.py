"""Structured Streaming forms of the latest-quote, cache, dedupe, move and progress jobs.

Running results keep no state in the stream.  Each micro-batch is reduced to one partial row per key it
touched and written under its own batch id; a batch that is run again after a lost executor or a restart
replaces the same folder.  Reading merges the partials, so late rows count whenever they come, and
`compact` folds finished batches into one base table, without the rows that have expired.  A manifest
names the live base and is swapped by one rename; folders it no longer names stay for a grace period, so
a reader that has listed them still reads, and a compaction that is killed has changed nothing.  The dedupe
job holds state, bounded by its watermark, in RocksDB, as do the keyed jobs of `keyed`.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable

from py4j.java_gateway import JavaObject
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from oddsframe.functions.text import text
from oddsframe.operators.cache import STALE_HOURS, TTL_HOURS, latest_results, live_entries, stale_flag
from oddsframe.operators.quotes import pick_last

TICK_KEYS = ["match_id", "bookmaker_key"]
Reduce = Callable[[DataFrame], DataFrame]


def read_stream(spark: SparkSession, path: str, schema, files_per_batch: int = 1000) -> DataFrame:
    """A file stream over landed Parquet; the schema is given, never inferred."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def use_rocksdb(spark: SparkSession) -> None:
    """Keep state off the heap."""
    spark.conf.set(
        "spark.sql.streaming.stateStore.providerClass",
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    )


def write_partials(rows: DataFrame, partial: Reduce, path: str, checkpoint: str, once: bool = True, mode: str = "append") -> StreamingQuery:
    """The partial rows of each micro-batch under `path/batch_id=N`."""
    def save(batch: DataFrame, batch_id: int) -> None:
        partial(batch).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    writer = rows.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(save)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="10 seconds")).start()


MANIFEST, GRACE_HOURS = "_manifest.json", 24.0


def _at(spark: SparkSession, *parts: str) -> tuple[JavaObject, JavaObject]:
    """A path and its file system."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path("/".join(parts))
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _finished(spark: SparkSession, path: str, after: int) -> dict[int, str]:
    """Names of the batches after a number whose write has finished."""
    root, fs = _at(spark, path)
    names = [s.getPath().getName() for s in fs.listStatus(root)] if fs.exists(root) else []
    found = {int(n.split("=")[1]): n for n in names if n.startswith("batch_id=")}
    return {k: n for k, n in found.items() if k > after and fs.exists(_at(spark, path, n, "_SUCCESS")[0])}


def read_manifest(spark: SparkSession, path: str) -> dict:
    """`base`: the live base table or null, `upto`: the last batch in it, `retired`: folders of before and when they went."""
    file, fs = _at(spark, path, MANIFEST)
    if not fs.exists(file):
        return {"base": None, "upto": -1, "retired": []}
    stream = fs.open(file)
    try:
        return json.loads(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def _swap_manifest(spark: SparkSession, path: str, manifest: dict) -> None:
    """Write beside, then replace in one step."""
    jvm = spark.sparkContext._jvm
    draft, fs = _at(spark, path, f"_manifest-{uuid.uuid4().hex}")
    out = fs.create(draft, True)
    try:
        out.writeBytes(json.dumps(manifest))
    finally:
        out.close()
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    context.rename(fs.makeQualified(draft), fs.makeQualified(_at(spark, path, MANIFEST)[0]), options)


def live_folders(spark: SparkSession, path: str) -> list[str]:
    """What a reader has to read now: the live base and the finished batches after it."""
    manifest = read_manifest(spark, path)
    batches = _finished(spark, path, manifest["upto"])
    return [*([manifest["base"]] if manifest["base"] else []), *[n for _, n in sorted(batches.items())]]


def read_partials(spark: SparkSession, path: str, schema) -> DataFrame:
    folders = [f"{path}/{n}" for n in live_folders(spark, path)]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def compact(spark: SparkSession, path: str, schema, merge: Reduce, live: Column | None = None, grace_hours: float = GRACE_HOURS) -> None:
    """Fold the finished batches into a new base table, rows that are not `live` left out.

    Folders that went before the grace period are deleted.  One compaction runs at a time.
    """
    manifest = read_manifest(spark, path)
    batches = _finished(spark, path, manifest["upto"])
    if not batches:
        return
    now, newest = int(time.time() * 1000), max(batches)
    base = f"upto={newest}-{uuid.uuid4().hex}"
    merged = merge(read_partials(spark, path, schema))
    (merged if live is None else merged.where(live)).write.parquet(f"{path}/{base}")
    gone = [*([manifest["base"]] if manifest["base"] else []), *batches.values()]
    retired = manifest["retired"] + [[name, now] for name in gone]
    late = now - int(grace_hours * 3_600_000)
    _swap_manifest(spark, path, {"base": base, "upto": newest, "retired": [r for r in retired if r[1] > late]})
    for name, at in retired:
        if at <= late:
            folder, fs = _at(spark, path, name)
            fs.delete(folder, True)


def latest_quotes(ticks: DataFrame) -> DataFrame:
    """Latest tick per match and bookmaker; a later event wins equal times.  Merges its own output."""
    at = F.struct("ts", "event_id")
    return ticks.groupBy(*TICK_KEYS).agg(
        F.max("ts").alias("ts"), F.max_by("event_id", at).alias("event_id"), F.max_by("price", at).alias("price")
    )


def open_close(ticks: DataFrame) -> DataFrame:
    """First and latest price per match and bookmaker of a batch of ticks."""
    at = F.struct("ts", "event_id")
    return ticks.groupBy(*TICK_KEYS).agg(
        F.min(at).alias("open_at"), F.min_by("price", at).alias("open_price"), F.max(at).alias("latest_at"),
        F.max_by("price", at).alias("latest_price"), F.count(F.lit(1)).alias("ticks"),
    )


def merge_open_close(parts: DataFrame) -> DataFrame:
    return parts.groupBy(*TICK_KEYS).agg(
        F.min("open_at").alias("open_at"), F.min_by("open_price", "open_at").alias("open_price"), F.max("latest_at").alias("latest_at"),
        F.max_by("latest_price", "latest_at").alias("latest_price"), F.sum("ticks").alias("ticks"),
    )


def with_move(prices: DataFrame) -> DataFrame:
    return prices.withColumn("move", F.abs(F.col("latest_price") - F.col("open_price")))


def stream_dedupe_hits(hits: DataFrame, keys: list[str], time: str, delay: str = "2 days") -> DataFrame:
    """One hit per key while its event time is within the delay; state older than that is dropped."""
    use_rocksdb(hits.sparkSession)
    timed = hits.withColumn(time, F.col(time).cast("timestamp"))
    return timed.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


_COUNTS = ["total", "ok_count", "error_count", "no_data_count", "hit_count"]


def match_counts(results: DataFrame) -> DataFrame:
    """Counts per match of a batch of results; `progress` sums them up."""
    no_data = text(F.col("error")).rlike("returned an error page|HTTP 404|no-match|Object reference|暂无相关数据|暂无数据")
    done = F.coalesce(F.col("ok"), F.lit(False)) | no_data
    return results.groupBy("match_id").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(done).alias("ok_count"),
        F.count_if(~done).alias("error_count"),
        F.count_if(no_data).alias("no_data_count"),
        F.sum(F.coalesce(F.col("hits"), F.lit(0))).cast("long").alias("hit_count"),
    )


def merge_counts(parts: DataFrame) -> DataFrame:
    return parts.groupBy("match_id").agg(*[F.sum(c).cast("long").alias(c) for c in _COUNTS])


def progress(per_match: DataFrame, chunk: int = 25) -> DataFrame:
    """The batch counts from the per-match counts."""
    out = per_match.agg(
        *[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in _COUNTS],
        F.count_if(F.col("hit_count") > 0).alias("match_hit_count"),
    )
    return out.withColumn("batch_count", F.ceil(F.col("total") / chunk).cast("long"))


def stream_cache_upsert(results: DataFrame, path: str, checkpoint: str, ttl_hours: float = TTL_HOURS, once: bool = True) -> StreamingQuery:
    """Keyed upsert of extraction results: each micro-batch adds its newest result per match."""
    return write_partials(results, lambda batch: latest_results(batch, ttl_hours=ttl_hours), path, checkpoint, once)


def merge_cache(parts: DataFrame) -> DataFrame:
    return pick_last(parts, ["match_id"], [F.col("saved_at"), F.col("source_index")])


def compact_cache(spark: SparkSession, path: str, schema, now: Column) -> None:
    """One row per match that has not expired."""
    compact(spark, path, schema, merge_cache, F.col("expires_at") > now.cast("timestamp_ntz"))


def read_cache(spark: SparkSession, path: str, schema, now: Column) -> DataFrame:
    """Live entry per match."""
    return merge_cache(live_entries(read_partials(spark, path, schema), now))


def newest_good(captures: DataFrame) -> DataFrame:
    """Newest capture per match of those that are `ok`; a later event wins equal times.  Merges its own output."""
    return pick_last(captures.where(F.coalesce(F.col("ok"), F.lit(False))), ["match_id"], [F.col("saved_at"), F.col("event_id")])


def stream_last_good(captures: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Keep the last good capture of each match; a failed one never replaces it."""
    return write_partials(captures, newest_good, path, checkpoint, once)


def stream_serve(
    requests: DataFrame, snapshots: str, schema, path: str, checkpoint: str,
    ttl_hours: float = STALE_HOURS, threshold: int = 70, once: bool = True,
) -> StreamingQuery:
    """Answer each request (match_id, at, ...) with the last good capture of its match as of the micro-batch.

    The snapshot is read anew for every micro-batch, so a request sees what the capture stream has finished by
    then.  A request of a match without a good capture, or without a match, comes out with `served` false.
    """
    spark = requests.sparkSession

    def answer(batch: DataFrame) -> DataFrame:
        good = newest_good(read_partials(spark, snapshots, schema)).withColumnRenamed("match_id", "_match")
        found = batch.join(good, batch["match_id"] == good["_match"], "left")
        flagged = stale_flag(found, F.col("at"), ttl_hours, threshold)
        return flagged.withColumn("served", F.col("_match").isNotNull()).drop("_match")

    return write_partials(requests, answer, path, checkpoint, once)
