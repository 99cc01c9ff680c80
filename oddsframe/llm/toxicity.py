"""Toxicity of texts by a subsequence string-kernel support vector machine with Nystroem landmarks.

The kernel compares two strings by the letter triples they share as subsequences: a triple spread over n letters
counts DECAY**n, up to SPAN letters, so an insult with letters put in or left out stays similar to itself.  Values are
scaled by what strings of their lengths could share at most.  Before that, words lose everything but letters, accents
are folded, and runs of single letters are read as one word (`i.d-i o t`).

Labelled texts teach through their words, not their sentences.  The label holds for a text, so the telling words are
found by greedy cover: words that two or more toxic and next to no clean texts have, until every toxic text that can
be is told by one.  Words of clean texts are negative.  An insult made of several ordinary words is not learned.  The machine is linear in the Nystroem features
of a bounded number of landmark words; as the kernel is a plain product over triples, the trained machine folds into
one weight a triple, and judging a text takes a few table lookups a letter.  A text scores by its three worst words,
through a logistic curve fitted to the labelled texts.

At most about TRAIN_TEXTS labelled texts of each class are learned from, picked by a digest of their id; nothing of
them but the text is used.  Labels of a null id or value teach nothing, and an id labelled twice counts as toxic if
either says so.  Null, empty and letterless texts get the score of a text without any telling word.  Where either
class is missing all scores are 0.  Rows are judged one by one, so repeated rows and ids do no harm.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oddsframe.llm.langid import _groups, _is_letter
from oddsframe.llm.shared import held_out, keep, small_batches

DECAY, SPAN = 0.7, 6
TRAIN_TEXTS = 4_000
CANDIDATES, NEGATIVES, LANDMARKS = 1_000, 20_000, 192
SPREAD_WEIGHT = 1.0
WORST, CLIP = 3, 1.5  # words of a text that make its score, and how far one may count
SPACE, BREAK = 255, 254
STEPS = [(a, b) for b in range(2, SPAN) for a in range(1, b)]
_class: list[np.ndarray] = []


def _classes() -> np.ndarray:
    """A class for each code point: 1-26 letters a-z, 27-31 other letters, 0 what is left out."""
    if not _class:
        points = np.arange(0x110000)
        table = np.where(_is_letter(), 27 + points % 5, 0).astype(np.uint8)
        for c in range(0x250):
            base = unicodedata.normalize("NFKD", chr(c))[0].lower()
            if "a" <= base <= "z":
                table[c] = ord(base) - 96
        table[[9, 10, 11, 12, 13, 32, 0x85, 0xA0, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x3000]] = SPACE
        table[0] = BREAK
        _class.append(table)
    return _class[0]


def letters(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All letters of some texts, the word each belongs to, and the text each word belongs to."""
    points = np.frombuffer("\0".join([t.lower().replace("\0", " ") for t in texts]).encode("utf-32-le", "surrogatepass"), np.uint32)
    found = _classes()[points]
    found = found[found != 0]
    is_letter = found < BREAK
    text = np.cumsum(found == BREAK)[is_letter]
    word = np.cumsum(~is_letter)[is_letter]
    if not len(word):
        return found[:0], word, text
    word = np.cumsum(np.r_[0, word[1:] != word[:-1]])
    size = np.bincount(word)
    owner = text[np.flatnonzero(np.r_[True, word[1:] != word[:-1]])]
    single = size == 1
    joins = np.r_[False, single[1:] & single[:-1] & (owner[1:] == owner[:-1])]
    merged = np.cumsum(~joins) - 1
    return found[is_letter], merged[word], owner[~joins]


def mass(lengths: np.ndarray) -> np.ndarray:
    """Length of the triple vector of a string whose triples all differ."""
    n = np.asarray(lengths)[..., None]
    spans = np.array([b for _, b in STEPS])
    return np.sqrt((np.maximum(n - spans, 0) * DECAY ** (2.0 * (spans + 1))).sum(axis=-1))


def triples(word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes and weights of a word's triples, the whole scaled by its mass."""
    codes, weights = [], []
    w = word.astype(np.int64)
    for a, b in STEPS:
        if len(w) > b:
            codes.append(w[:-b] << 10 | w[a : len(w) - b + a] << 5 | w[b:])
            weights.append(np.full(len(w) - b, DECAY ** (b + 1.0)))
    if not codes:
        return np.zeros(0, np.int64), np.zeros(0)
    return np.concatenate(codes), np.concatenate(weights) / mass(np.array(len(w)))


def vectors(words: list[bytes]) -> np.ndarray:
    """Dense triple vectors (used for the landmarks only)."""
    out = np.zeros((len(words), 1 << 15), np.float32)
    for k, word in enumerate(words):
        codes, weights = triples(np.frombuffer(word, np.uint8))
        np.add.at(out[k], codes, weights)
    return out


def kernel(words: list[bytes], landmarks: np.ndarray) -> np.ndarray:
    out = np.zeros((len(words), len(landmarks)))
    for k, word in enumerate(words):
        codes, weights = triples(np.frombuffer(word, np.uint8))
        out[k] = landmarks[:, codes] @ weights
    return out


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, c: float = 100.0, rounds: int = 30) -> tuple[np.ndarray, float]:
    """Linear support vector machine with squared hinge loss, by Newton steps."""
    x1 = np.c_[x, np.ones(len(x))]
    w, ridge = np.zeros(x1.shape[1]), np.r_[np.ones(x.shape[1]), 1e-6]
    loss = np.inf
    for _ in range(rounds):
        slack = np.maximum(0, 1 - y * (x1 @ w))
        now = 0.5 * (ridge * w * w).sum() + c * (weight * slack**2).sum()
        if now >= loss - 1e-9 * abs(loss if loss < np.inf else 1):
            break
        loss = now
        inside = slack > 0
        xi, wi = x1[inside], weight[inside]
        hessian = np.diag(ridge) + 2 * c * (xi * wi[:, None]).T @ xi
        w = np.linalg.solve(hessian, 2 * c * (xi * wi[:, None]).T @ y[inside])
    return w[:-1], float(w[-1])


class Machine:
    """A weight for each triple, the offset, and the logistic curve from a text's worst words to its score."""

    def __init__(self, table: np.ndarray, offset: float):
        self.table, self.offset = table.astype(np.float32), offset
        self.curve = np.r_[np.ones(WORST), 0.0]

    def worst(self, texts: list[str]) -> np.ndarray:
        """Decision values of each text's WORST worst words, falling; the offset where there are fewer."""
        out = np.full((len(texts), WORST), self.offset)
        for first, end in _groups(texts):
            letter, word, owner = letters(texts[first:end])
            if not len(letter):
                continue
            code, total = letter.astype(np.int32), np.zeros(len(letter), np.float32)
            for a, b in STEPS:
                n = len(code) - b
                if n > 0:
                    at = code[:n] << 10 | code[a : n + a] << 5 | code[b:]
                    total[:n] += np.where(word[:n] == word[b:], self.table[at] * np.float32(DECAY ** (b + 1.0)), np.float32(0))
            size = np.bincount(word)
            value = np.bincount(word, total) / np.maximum(mass(np.arange(size.max() + 1))[size], 1e-12) + self.offset
            begins = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            text = owner[begins] + first
            each = np.repeat(np.arange(len(begins)), np.diff(np.r_[begins, len(owner)]))
            for k in range(WORST):
                most = np.maximum.reduceat(value, begins)
                out[text, k] = np.maximum(most, self.offset)
                hit = np.flatnonzero(value == most[each])
                value[hit[np.r_[True, each[hit][1:] != each[hit][:-1]]]] = -np.inf
        return np.clip(out, -CLIP, CLIP)

    def score(self, texts: list[str]) -> np.ndarray:
        z = np.clip(self.worst(texts) @ self.curve[:-1] + self.curve[-1], -40, 40)
        return 1 / (1 + np.exp(-z))


def labelled(docs: DataFrame, labels: DataFrame, train_texts: int) -> DataFrame:
    """(text, toxic) of a bounded sample of labelled texts of each class; equal texts come once."""
    small_batches(docs.sparkSession)
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic_"))
    share = known.groupBy("toxic_").agg((F.lit(float(train_texts)) / F.count("*")).alias("share"))
    known = known.join(F.broadcast(share), "toxic_").where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < F.col("share") * 1_000_000)
    known = keep(known.select("doc_id", "toxic_"), "picked")  # about train_texts ids of each class
    texts = docs.select("doc_id", "text").where(F.col("text").isNotNull()).join(F.broadcast(known), "doc_id")
    return keep(texts.groupBy("text").agg(F.max("toxic_").alias("toxic")), "labelled")


def text_words(sample: DataFrame) -> DataFrame:
    """(text number, toxic, word): the different words of every sampled text."""

    def split(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            texts, out = part.column(2).to_pylist(), ([], [], [])
            for a, b in _groups(texts):
                letter, word, owner = letters(texts[a:b])
                ends = np.cumsum(np.bincount(word)) if len(word) else word
                raw = letter.tobytes()
                seen = {(int(o) + a, raw[s:e]) for o, s, e in zip(owner, np.r_[0, ends[:-1]] if len(ends) else [], ends) if e - s > 2}
                for k, w in sorted(seen):
                    for column, value in zip(out, (part.column(0)[k].as_py(), part.column(1)[k].as_py(), w)):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.binary())], names=["text", "toxic", "word"])

    rows = sample.select(F.xxhash64("text").alias("id"), F.col("toxic").cast("int"), "text")
    return rows.mapInArrow(split, "text long, toxic int, word binary")


def _telling(candidates: dict[bytes, tuple[int, int]], pairs: list[tuple[bytes, int]], least: int) -> list[bytes]:
    """Greedy cover of the toxic texts by candidate words, then the words that are as telling without being needed."""
    texts: dict[bytes, set[int]] = {}
    for word, text in pairs:
        texts.setdefault(word, set()).add(text)
    left, out = {t for s in texts.values() for t in s}, []
    most = max((len(s) for s in texts.values()), default=0)
    pool = dict(texts)
    while pool and left:
        word = max(pool, key=lambda w: (len(pool[w] & left), w))
        if len(pool[word] & left) < least:
            break
        out.append(word)
        left -= pool.pop(word)
    return out + sorted(w for w in pool if candidates[w][1] == 0 and candidates[w][0] >= max(least, most // 20))


def spaced_out(word: bytes) -> list[bytes]:
    """The word with a letter put in, once at every inner place."""
    return [word[:k] + bytes([1 + (7 * k + len(word)) % 26]) + word[k:] for k in range(1, len(word))]


def learn(docs: DataFrame, labels: DataFrame, train_texts: int = TRAIN_TEXTS) -> Machine | None:
    sample = labelled(docs, labels, train_texts)
    sizes = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not sizes.get(0) or not sizes.get(1):
        return None
    words = keep(text_words(sample), "words")
    counts = keep(words.groupBy("word").agg(F.sum("toxic").alias("bad"), F.sum(1 - F.col("toxic")).alias("good")), "counts")
    least = 2  # two texts, however many there are
    telling = counts.where((F.col("bad") >= least) & (F.col("bad") / sizes[1] >= 10 * (F.col("good") + 0.5) / sizes[0]))
    telling = telling.orderBy(F.desc("bad"), "word").limit(CANDIDATES)
    candidates = {bytes(r["word"]): (r["bad"], r["good"]) for r in telling.collect()}
    pairs = words.where("toxic = 1").join(F.broadcast(telling.select("word")), "word").select("word", "text").collect()
    positive = _telling(candidates, [(bytes(r["word"]), r["text"]) for r in pairs], least)
    clean = counts.where("good > 0").withColumn("turn", F.xxhash64("word"))
    common = clean.orderBy(F.desc("good"), "word").limit(NEGATIVES // 2).select("word", "good").collect()
    others = clean.orderBy("turn", "word").limit(NEGATIVES // 2).select("word", "good").collect()
    negative = sorted({bytes(r["word"]) for r in common + others} - set(positive))
    if not positive:
        return None
    step = max(1, len(negative) // (LANDMARKS // 3))
    landmarks = vectors([*positive[: LANDMARKS - LANDMARKS // 3], *negative[::step][: LANDMARKS // 3]])
    gram = landmarks @ landmarks.T
    values, axes = np.linalg.eigh(gram.astype(float))
    root = axes[:, values > 1e-6] / np.sqrt(values[values > 1e-6])  # Nystroem features: kernel to the landmarks times this
    spread = [v for word in positive for v in spaced_out(word)]
    x = kernel([*positive, *spread, *negative], landmarks) @ root
    y = np.r_[np.ones(len(positive) + len(spread)), -np.ones(len(negative))]
    weight = np.r_[np.ones(len(positive)), np.full(len(spread), SPREAD_WEIGHT), np.full(len(negative), max(0.05, 4 * len(positive) / len(negative)))]
    w, offset = fit(x, y, weight)
    machine = Machine((root @ w) @ landmarks, offset)

    def worst(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            yield pa.RecordBatch.from_arrays([part.column(1), pa.array(machine.worst(part.column(0).to_pylist()).tolist(), pa.list_(pa.float64()))], names=["toxic", "worst"])

    seen = sample.select("text", F.col("toxic").cast("int")).mapInArrow(worst, "toxic int, worst array<double>").collect()  # the sample's size at most
    machine.curve = _curve(np.array([r["worst"] for r in seen]), np.array([r["toxic"] for r in seen]))
    return machine


def _curve(value: np.ndarray, toxic: np.ndarray, ridge: float = 0.3, rounds: int = 25) -> np.ndarray:
    """Logistic regression of the label on a text's worst words, by Newton steps."""
    x = np.c_[value, np.ones(len(value))]
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(hessian, x.T @ (toxic - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def scores(docs: DataFrame, labels: DataFrame, train_texts: int = TRAIN_TEXTS) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row."""
    machine = learn(docs, labels, train_texts)

    def judge(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            score = machine.score(part.column(2).to_pylist()) if machine else np.zeros(len(part))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(score, pa.float64()), pa.array((score >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(docs["doc_id"].cast("long"), held_out(F.col("doc_id")).alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(judge, "doc_id long, held_out boolean, score double, predicted int")


def accepted(docs: DataFrame, labels: DataFrame, train_texts: int = TRAIN_TEXTS) -> DataFrame:
    """The rows whose text is not judged toxic."""
    machine = learn(docs, labels, train_texts)
    if machine is None:
        return docs

    @F.pandas_udf("boolean")
    def toxic(text: pd.Series) -> pd.Series:
        return pd.Series(machine.score([t or "" for t in text]) >= 0.5)

    return docs.where(~toxic(F.coalesce(docs["text"], F.lit(""))))
