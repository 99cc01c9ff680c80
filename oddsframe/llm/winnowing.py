"""Document fingerprints by winnowing, and how alike they are to those of an edited and of the next document.

Every gram of GRAM code points is hashed; each run of WINDOW neighbouring grams gives its least hash, the rightmost
of equal ones, with its position.  Two texts that share GRAM + WINDOW - 1 code points share a chosen hash.  A
fingerprint is the chosen hashes in text order, 8 hex digits of hash and 8 of position each; likeness is the share
of common hashes (both empty: 1).  A text with fewer code points than a gram is one gram.

A document's successor is the next in falling id order, from the last back to the first.  Rows are dealt into ranges of
that order, whose bounds are taken from a sample of the keys and fixed before anything is dealt: a row's range follows
from its key alone, however often it is computed.  Within a range a successor stands beside its document; the first and
last rows of ranges, found by an aggregate, meet by a join.  Long texts are hashed piece by piece.

Null texts count as empty (no hash, empty fingerprint).  A null id comes last; rows with equal ids follow each other
by digest of the text.  A single row is its own successor.  No rows, no output; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from oddsframe.llm.rolling import gram_hashes, sliding_least
from oddsframe.llm.shared import keep, small_batches, tasks

GRAM, WINDOW = 25, 76
PIECE = 1 << 16  # windows chosen together
RANGE_BYTES, SAMPLED = 12_000_000, 20  # text of a range; keys sampled for each
LAST = np.uint64(0xFFFFFFFF)
FIELDS = ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
TYPES = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]


def winnow(text: str) -> np.ndarray:
    """Chosen grams in text order: hash in the upper and position in the lower 32 bits."""
    gram = min(GRAM, len(text))
    grams = len(text) - gram + 1
    window = min(WINDOW, grams)
    found = [np.zeros(0, np.uint64)]
    for at in range(0, grams - window + 1, PIECE) if gram else ():
        upto = min(at + PIECE + window - 1, grams)  # grams below the windows that start in this piece
        points = np.frombuffer(text[at : upto + gram - 1].encode("utf-32-le", "surrogatepass"), np.uint32)
        hashes = gram_hashes(points, gram) >> np.uint64(32)
        keys = hashes << np.uint64(32) | (LAST - np.arange(at, at + len(hashes), dtype=np.uint64))  # least hash, then rightmost
        least = sliding_least(keys, window)
        found.append(least[np.r_[True, least[1:] != least[:-1]]])
    least = np.concatenate(found)
    least = least[np.r_[np.ones(min(1, len(least)), bool), least[1:] != least[:-1]]]
    return least & ~LAST | (LAST - (least & LAST))


def shown(chosen: np.ndarray) -> str:
    return chosen.astype(">u8").tobytes().hex()


def hashes_of(chosen: np.ndarray) -> np.ndarray:
    return np.unique(chosen >> np.uint64(32))


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    if not len(a) and not len(b):
        return 1.0
    common = len(a) + len(b) - len(np.unique(np.r_[a, b]))
    return common / (len(a) + len(b) - common)


def edited(text: str, following: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


class _Fingerprinted:
    def __init__(self, doc_id: int | None, text: str):
        self.doc_id, self.text = doc_id, text
        self.chosen = winnow(text)
        self.hashes = hashes_of(self.chosen)


def _row(doc: _Fingerprinted, following: _Fingerprinted) -> tuple:
    other = edited(doc.text, following.text)
    chosen = winnow(other)
    digest = hashlib.sha256(other.encode("utf-8", "surrogatepass")).hexdigest()
    return doc.doc_id, len(doc.text), digest, shown(doc.chosen), shown(chosen), likeness(doc.hashes, hashes_of(chosen)), likeness(doc.hashes, following.hashes)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [[]] * len(FIELDS)
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, TYPES)], names=list(FIELDS))


def _inside(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of all documents but the last of a sorted partition."""
    previous = None
    for part in parts:
        rows = []
        for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
            doc = _Fingerprinted(doc_id, text)
            if previous is not None:
                rows.append(_row(previous, doc))
            previous = doc
        yield _batch(rows)


def _across(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of the last documents, whose successor came along."""
    for part in parts:
        yield _batch([_row(_Fingerprinted(i, t), _Fingerprinted(None, n)) for i, t, n in zip(*(part.column(k).to_pylist() for k in range(3)))])


def _key() -> Column:
    """A text that sorts as the documents follow each other: falling id, null last, then digest of the text."""
    falling = F.lpad(F.hex(F.bitwise_not(F.col("doc_id")).bitwiseXOR(F.lit(-(1 << 63)))), 16, "0")  # as unsigned digits
    return F.concat(F.coalesce(falling, F.lit("~")), F.lpad(F.hex(F.xxhash64("text")), 16, "0"))


def _ranges(rows: DataFrame, range_bytes: int) -> tuple[Column, int]:
    """Number of a row's range, and how many there are."""
    size, n = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count("*")).first()
    ranges = tasks(rows.sparkSession, -(-size // range_bytes))
    every = max(1, n // (ranges * SAMPLED))
    keys = sorted(r["key"] for r in rows.select("key").where(F.pmod(F.xxhash64("key"), F.lit(every)) == 0).collect())
    bounds = sorted({keys[k * len(keys) // ranges] for k in range(1, ranges)} if keys else set())
    if not bounds:
        return F.lit(0), 1
    run = max(1, int(len(bounds) ** 0.5))  # looked up in two steps
    runs = [bounds[k : k + run] for k in range(0, len(bounds), run)]
    passed = F.size(F.filter(F.lit([r[0] for r in runs]), lambda b: b <= F.col("key")))
    inside = F.size(F.filter(F.get(F.array(*[F.lit(r) for r in runs]), F.greatest(passed - 1, F.lit(0))), lambda b: b <= F.col("key")))
    return F.greatest(passed - 1, F.lit(0)) * run + inside, len(bounds) + 1


def fingerprints(df: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    spark = df.sparkSession
    small_batches(spark)
    rows = df.select(df["doc_id"].cast("long").alias("doc_id"), F.coalesce(df["text"], F.lit("")).alias("text")).withColumn("key", _key())
    number, ranges = _ranges(rows, range_bytes)
    rows = rows.withColumn("part", number)
    dealt = rows.repartitionById(ranges, "part").sortWithinPartitions("key").select("doc_id", "text")
    ends = rows.groupBy("part").agg(F.min_by("text", "key").alias("first"), F.max_by("doc_id", "key").alias("doc_id"), F.max_by("text", "key").alias("text"))
    ends = keep(ends, "ends")
    line = Window.orderBy("part")  # numbers of ranges alone
    back = F.first("part").over(line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    after = ends.select("part", F.coalesce(F.lead("part").over(line), back).alias("next"))
    firsts = ends.select(F.col("part").alias("next"), F.col("first").alias("following"))
    last = ends.drop("first").join(after, "part").join(firsts, "next").select("doc_id", "text", "following")
    return dealt.mapInArrow(_inside, SCHEMA).unionByName(last.mapInArrow(_across, SCHEMA))
