"""Raw pages: reading, decoding, error pages."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from oddsframe.functions.text import text
from oddsframe.session import many_tasks

RAW_PAGE = (
    "source string, match_id string, market string, period string, url string, fetched_at timestamp, "
    "status_code int, content_type string, incomplete boolean, body binary"
)


def read_raw_pages(spark: SparkSession, path: str, streaming: bool = False, files_per_batch: int = 1000) -> DataFrame:
    """Landed page captures with a fixed schema, as a batch or a file stream."""
    if streaming:
        reader = spark.readStream.schema(RAW_PAGE).option("maxFilesPerTrigger", files_per_batch)
        return reader.parquet(path)
    return spark.read.schema(RAW_PAGE).parquet(path)


def write_page_files(texts: DataFrame, path: str, key: str) -> None:
    """Texts (key, value) as plain files, one in a folder of each key; the folders are shared out over the tasks.

    Making a file costs far more than its text, so even a small table must not be written by the task that scanned it.
    """
    texts.repartition(many_tasks(texts.sparkSession), key).write.partitionBy(key).text(path)


def read_page_files(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """Captures kept as plain files: one row per file, with the partition columns of their folders.

    `pattern` is a glob over file names; other files are left out when the folders are listed.  Spark's listing
    also leaves out files without a single byte: they give no row, so they are no dead letters either.
    """
    reader = spark.read.format("binaryFile")
    files = (reader.option("pathGlobFilter", pattern) if pattern else reader).load(path)
    own = ["path", "modificationTime", "length", "content"]
    return files.select(
        *[c for c in files.columns if c not in own],
        F.col("path").alias("url"), F.col("modificationTime").alias("fetched_at"), F.col("content").alias("body"),
    )


def triage(df: DataFrame, found: Column, body: str = "text") -> DataFrame:
    """`reason` why a page can't be parsed: empty, error_page or unparsed; NULL where `found` holds.

    `found` tells whether the page has what its parser looks for; NULL counts as not found.
    """
    page = F.col(body)
    return df.withColumn(
        "reason",
        F.when(~F.coalesce(page, F.lit("")).rlike(r"\S"), F.lit("empty"))
        .when(is_error_page(page), F.lit("error_page"))
        .when(~F.coalesce(found, F.lit(False)), F.lit("unparsed")),
    )


def split_pages(triaged: DataFrame, path: str) -> tuple[DataFrame, DataFrame]:
    """Pages to parse and the dead letters with their reason; written once, each page in one of the two."""
    triaged.withColumn("dead", F.col("reason").isNotNull()).write.partitionBy("dead").parquet(path)
    schema = triaged.schema.add("dead", "boolean")
    both = triaged.sparkSession.read.schema(schema).parquet(path)
    return both.where(~F.col("dead")).drop("dead", "reason"), both.where("dead").drop("dead")


# Characters typical of UTF-8 text read as GB18030 (fixed values).
_MOJIBAKE = "鍚鑿鏂涓浜澶鎶娓妯鐞偛璧涘锛冿鈩鍗婂"
_GB = ["gb2312", "gbk", "gb18030", "cp936"]


@contextmanager
def lenient_decoding(spark: SparkSession):
    """Let `decode` take every Java charset and replace broken bytes, while an expression is built."""
    flags = ["spark.sql.legacy.javaCharsets", "spark.sql.legacy.codingErrorAction"]
    before = {f: spark.conf.get(f, None) for f in flags}
    try:
        for f in flags:
            spark.conf.set(f, "true")
        yield
    finally:
        for f, value in before.items():
            spark.conf.unset(f) if value is None else spark.conf.set(f, value)


def _count(col: Column, pattern: str) -> Column:
    return F.length(col) - F.length(F.regexp_replace(col, pattern, ""))


def _head(body: Column, size: int | None) -> Column:
    return body if size is None else F.substring(body, 1, size)


def declared_charset(body: Column, content_type: Column, head_bytes: int | None = None) -> Column:
    """Charset of the header, else of the body, as utf-8 / gb18030 / big5 / its own name.

    `head_bytes` limits how much of the body is looked through; the default is all of it.
    """
    head = F.decode(_head(body, head_bytes), "ISO-8859-1")
    header = F.regexp_extract(text(content_type), r"(?i)charset=([^;\s]+)", 1)
    meta = F.regexp_extract(head, r"(?i)charset=[\"']?\s*([a-z0-9_-]+)", 1)
    name = F.lower(F.translate(F.coalesce(F.nullif(header, F.lit("")), meta), "\"'", ""))
    return (
        F.when(name.isin(*_GB), F.lit("gb18030"))
        .when(name.isin("", "utf8", "utf-8"), F.lit("utf-8"))
        .otherwise(name)
    )


def decode_pages(df: DataFrame, head_bytes: int | None = None) -> DataFrame:
    """`text` of each page: the declared charset, or the other of UTF-8 and GB18030 where that one
    clearly reads better."""
    spark = df.sparkSession
    body, kind = F.col("body"), text(F.col("content_type"))
    with lenient_decoding(spark):
        read = df.withColumns(
            {
                "_cs": declared_charset(body, kind, head_bytes),
                "_utf": F.decode(body, "UTF-8"),
                "_gb": F.decode(body, "GB18030"),
                "_big5": F.decode(body, "Big5"),
                "_says_utf": kind.rlike(r"(?i)charset\s*=\s*[\"']?\s*utf-?8")
                | F.decode(_head(body, head_bytes), "ISO-8859-1").rlike(r"(?i)charset\s*=\s*[\"']?\s*utf-?8"),
            }
        )
    cjk = lambda c: _count(F.col(c), "[㐀-鿿]")
    bad = lambda c: _count(F.col(c), "�")
    odd = lambda c: _count(F.col(c), f"[{_MOJIBAKE}]")
    counts = read.withColumns(
        {
            "_utf_cjk": cjk("_utf"), "_gb_cjk": cjk("_gb"), "_utf_bad": bad("_utf"), "_gb_bad": bad("_gb"),
            "_utf_odd": odd("_utf"), "_gb_odd": odd("_gb"),
        }
    )
    u = {k: F.col(f"_utf_{k}") for k in ("cjk", "bad", "odd")}
    g = {k: F.col(f"_gb_{k}") for k in ("cjk", "bad", "odd")}
    readable = (
        (u["cjk"] >= 10) & (u["bad"] <= F.greatest(F.lit(3), F.ceil(u["cjk"] / 80))) & (g["odd"] >= u["odd"] + 4)
    )
    good_utf = (u["cjk"] >= 20) & (u["bad"] <= F.greatest(F.lit(4), F.ceil(u["cjk"] / 60)))
    to_gb = (
        (u["bad"] > 0)
        & ~(F.col("_says_utf") & (u["cjk"] >= 10))
        & ~good_utf
        & (g["bad"] < u["bad"])
        & (g["cjk"] >= u["cjk"])
    )
    chosen = (
        F.when(F.col("_cs") == "gb18030", F.when(readable, F.col("_utf")).otherwise(F.col("_gb")))
        .when(F.col("_cs") == "big5", F.col("_big5"))
        .when(to_gb, F.col("_gb"))
        .otherwise(F.col("_utf"))
    )
    out = counts.withColumn("text", F.regexp_replace(chosen, "^﻿", ""))
    return out.select(*df.columns, "text")


def is_error_page(body: Column, head_chars: int | None = None) -> Column:
    """A server error on the page, or a not-found page without any match data.

    `head_chars` limits how much of the page is looked through; the default is all of it.
    """
    head = _head(body, head_chars)
    plain = F.regexp_replace(head, r"(?is)<script\b.*?</script>|<style\b.*?</style>", " ")
    plain = F.regexp_replace(plain, "<[^>]+>", " ")
    useful = body.rlike("(?i)freshJsonData|oddsData|概率事件|compDiv|scheduleId")
    server = plain.rlike(r"(?i)500\s*-\s*Internal server error|URL Rewrite Module Error|Server Error")
    gone = (
        head.rlike("(?i)<title>[^<]*(?:404|Not Found|頁面不存在|页面不存在)[^<]*</title>")
        | plain.rlike(r"(?i)404\s*(?:Not Found|錯誤|错误)|頁面不存在|页面不存在|no-match")
        | plain.rlike("(?i)未将对象引用设置到对象的实例|Object reference not set")
    )
    return server | (~useful & gone)


def drop_error_pages(df: DataFrame, body: str = "body", head_chars: int | None = None) -> DataFrame:
    return df.where(~is_error_page(F.col(body), head_chars))
