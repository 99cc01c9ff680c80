"""Language of a text by rank-order profiles of its n-grams.

A language's profile is the list of its PROFILE most frequent n-grams (1 to MAX_N letters, words padded with a blank
on either side).  A document's most frequent n-grams are ranked the same way, and each profile is charged for how
far they are out of place, PROFILE for an n-gram it lacks.  The least charge wins; ties go to the name that sorts
first.  The score is one minus the charge as a share of the most that could be charged.

Profiles are learned from at most about TRAIN_ROWS documents of each language, picked by a digest of their id.

Null texts and texts without a letter are `und` with score 0.  Without anything to learn from every text is `und`.
Texts of a null language teach nothing.  Rows are judged one by one, so repeated rows and ids do no harm.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from oddsframe.llm.shared import held_out, small_batches

PROFILE, MAX_N = 300, 3
TRAIN_ROWS = 20_000
LANGUAGES = 1_000  # profiles a model may hold
GROUP_CHARS = 1 << 19  # code points counted together
UNKNOWN = "und"
_letters: list[np.ndarray] = []


def _is_letter() -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _letters[0]


def _groups(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Stretches of the list that are counted together; a long text stands alone."""
    start = size = 0
    for k, text in enumerate(texts):
        if k > start and size + len(text) > GROUP_CHARS:
            yield start, k
            start, size = k, 0
        size += len(text)
    if texts:
        yield start, len(texts)


def ranked_grams(texts: list[str], most: int) -> tuple[np.ndarray, list[np.ndarray], np.ndarray, np.ndarray]:
    """The n-grams of each text: text number, code points (0: blank or none), count and rank, most frequent first."""
    points = np.frombuffer("\0".join([t.lower().replace("\0", " ") for t in texts]).encode("utf-32-le", "surrogatepass"), np.uint32)
    is_break = points == 0
    text = np.cumsum(np.r_[0, is_break])[:-1] if len(points) else np.zeros(0, np.int64)
    points = np.where(_is_letter()[points], points, 0)
    inside = np.r_[True, (points[1:] != 0) | (points[:-1] != 0) | (text[1:] != text[:-1])] if len(points) else is_break
    points, text = points[inside], text[inside]  # one blank between words
    # a blank before and after each text, so that no gram spans two
    edge = np.r_[True, text[1:] != text[:-1]] if len(text) else np.zeros(0, bool)
    at = np.flatnonzero(edge)
    points, text = np.insert(points, at, 0), np.insert(text, at, text[at] if len(at) else text)
    points, text = np.append(points, 0), np.append(text, text[-1] if len(text) else 0)
    alphabet, symbol = np.unique(points, return_inverse=True)
    bits = max(1, int(len(alphabet)).bit_length())
    symbol = symbol.astype(np.uint64)
    keys = []
    for n in range(1, MAX_N + 1):
        if len(points) < n:
            continue
        m = len(points) - n + 1
        ok = text[:m] == text[n - 1 :]
        ok &= points[:m] != 0 if n == 1 else (points[:m] != 0) | (points[1 : m + 1] != 0)
        if n == 2:
            ok &= (points[:m] != 0) | (points[1 : m + 1] != 0)
        for k in range(1, n - 1):
            ok &= points[k : m + k] != 0  # a blank stands at the ends only
        key = text[:m].astype(np.uint64)
        for k in range(MAX_N):
            key = key << np.uint64(bits) | (symbol[k : m + k] + np.uint64(1) if k < n else np.uint64(0))
        keys.append(key[ok])
    keys = np.sort(np.concatenate(keys)) if keys else np.zeros(0, np.uint64)
    new = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    counts, keys = np.diff(np.r_[new, len(keys)]), keys[new]
    owner = (keys >> np.uint64(bits * MAX_N)).astype(np.int64)
    order = np.lexsort((-counts, owner)) if len(keys) and counts.max() >= 1 << 20 else _by_count(owner, counts)
    owner, counts, keys = owner[order], counts[order], keys[order]
    begins = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]]) if len(owner) else new
    rank = np.arange(len(owner)) - np.repeat(begins, np.diff(np.r_[begins, len(owner)]))
    top = rank < most
    symbols = np.r_[np.uint32(0), alphabet.astype(np.uint32)]
    grams = [symbols[(keys[top] >> np.uint64(bits * (MAX_N - 1 - k)) & np.uint64((1 << bits) - 1)).astype(np.int64)] for k in range(MAX_N)]
    lengths = sum((keys[top] >> np.uint64(bits * (MAX_N - 1 - k)) & np.uint64((1 << bits) - 1)) != 0 for k in range(MAX_N))
    return owner[top], [*grams, np.asarray(lengths)], counts[top], rank[top]


def _by_count(owner: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Stable order by text and falling count, in one sort of packed words."""
    low = np.uint64(max(1, int(len(owner)).bit_length()))
    packed = (owner.astype(np.uint64) << np.uint64(20) | ((1 << 20) - counts).astype(np.uint64)) << low | np.arange(len(owner), dtype=np.uint64)
    return (np.sort(packed) & ((np.uint64(1) << low) - np.uint64(1))).astype(np.int64)


def _gram_id(grams: list[np.ndarray]) -> np.ndarray:
    """A word for each n-gram: 20 bits for each of up to three code points below 2**20, and the length."""
    word = np.zeros(len(grams[0]), np.uint64)
    for column in grams[:MAX_N]:
        word = word << np.uint64(20) | (column.astype(np.uint64) & np.uint64(0xFFFFF))
    return word << np.uint64(2) | grams[MAX_N].astype(np.uint64)


def learn(df: DataFrame, train_rows: int = TRAIN_ROWS, profile: int = PROFILE) -> dict[str, dict[int, int]]:
    """Ranks of the most frequent n-grams of every language; reads no held-out row."""
    small_batches(df.sparkSession)
    rows = df.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang", "text")
    counts = rows.groupBy("lang").agg(F.count("*").alias("rows"))
    if counts.limit(LANGUAGES + 1).count() > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    share = counts.select("lang", (F.lit(float(train_rows)) / F.col("rows")).alias("share"))
    picked = rows.join(F.broadcast(share), "lang").where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < F.col("share") * 1_000_000).select("lang", "text")

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            langs, texts = part.column(0).to_pylist(), part.column(1).to_pylist()
            for a, b in _groups(texts):
                owner, grams, n, _ = ranked_grams(texts[a:b], 1 << 62)
                names = sorted(set(langs[a:b]))
                lang = np.array([names.index(x) for x in langs[a:b]])[owner]
                word = _gram_id(grams)
                order = np.lexsort((word, lang))
                lang, word, n = lang[order], word[order], n[order]
                new = np.flatnonzero(np.r_[True, (word[1:] != word[:-1]) | (lang[1:] != lang[:-1])]) if len(word) else np.zeros(0, np.int64)
                total = np.add.reduceat(n, new) if len(new) else n
                yield pa.RecordBatch.from_arrays([pa.array([names[k] for k in lang[new]], pa.string()), pa.array(word[new].view(np.int64)), pa.array(total.astype(np.int64))], names=["lang", "gram", "n"])

    grams = picked.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    best = grams.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))).where(F.col("rank") <= profile)
    model: dict[str, dict[int, int]] = {}
    for row in best.collect():  # `profile` rows a language
        model.setdefault(row["lang"], {})[row["gram"] & (1 << 64) - 1] = row["rank"] - 1
    return model


class Profiles:
    """The profiles of all languages as one table of ranks."""

    def __init__(self, model: dict[str, dict[int, int]], profile: int = PROFILE):
        self.names, self.profile = sorted(model), profile
        self.known = np.unique(np.array([g for ranks in model.values() for g in ranks], np.uint64))
        self.ranks = np.full((len(self.known) + 1, len(self.names)), -1, np.int64)
        for k, name in enumerate(self.names):
            grams = np.array(list(model[name]), np.uint64)
            self.ranks[np.searchsorted(self.known, grams), k] = list(model[name].values())

    def judge(self, texts: list[str]) -> list[tuple[str, float]]:
        out: list[tuple[str, float]] = []
        for a, b in _groups(texts):
            owner, grams, _, rank = ranked_grams(texts[a:b], self.profile)
            word = _gram_id(grams)
            at = np.searchsorted(self.known, word)
            at[(at == len(self.known)) | (np.append(self.known, np.uint64(0))[at] != word)] = len(self.known)
            ranks = self.ranks[at]
            charge = np.where(ranks < 0, self.profile, np.abs(ranks - rank[:, None]))
            size = np.bincount(owner, minlength=b - a)
            totals = np.stack([np.bincount(owner, charge[:, k], b - a) for k in range(len(self.names))], axis=1) if self.names else None
            for k in range(b - a):
                if totals is None or not size[k]:
                    out.append((UNKNOWN, 0.0))
                else:
                    best = int(totals[k].argmin())
                    out.append((self.names[best], float(1 - totals[k, best] / (self.profile * size[k]))))
        return out


def languages(df: DataFrame, train_rows: int = TRAIN_ROWS, profile: int = PROFILE) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row."""
    profiles = Profiles(learn(df, train_rows, profile), profile)

    def predict(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            judged = profiles.judge(part.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([j[0] for j in judged], pa.string()), pa.array([j[1] for j in judged], pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    rows = df.select(df["doc_id"].cast("long"), held_out(F.col("doc_id")).alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(predict, "doc_id long, held_out boolean, lang_pred string, score double")
