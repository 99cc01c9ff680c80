"""Exact BM25 top-k over an inverted index with block-max pruning, run per shard and merged with global statistics.

Texts become bags of words once (a forward index of word hashes, kept in the shared folder).  Counts of the query
words over all documents and the mean length come first, so every shard scores alike.  A shard is a bounded run of
rows of the forward index: it keeps the values of the COMMON words as a matrix, inverts its rows for all others, and
keeps the largest value of every common word in every block of BLOCK neighbouring documents.  PART queries are answered
together, a block after the other: sums of rare words are exact, and a block whose bound (those sums and its largest
common values) stays below a query's threshold is not opened for it.  Shards return their k best with true scores, and
the k best of those are the answer.

One file of FIRST of the index is searched first.  Its k-th best score of a query is a lower bound of the true one: the
other files return only what reaches it, so their hits do not grow with shards times queries.

Queries go to the shards in blocks of at most QUERY_WORDS words, which is what is broadcast at a time; each block
is one pass over the index.  A query is the set of its words (ASCII letters lower-cased, split at ASCII white space).

Null and empty texts match nothing and, as queries, find nothing; only documents with a common word are found.
Ties go to the smaller id (a null id last).  Repeated rows are separate documents.  No rows, no output.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oddsframe.llm.rolling import mix, prefix
from oddsframe.llm.shared import keep, return_memory, small_batches, utf8

K1, B = 1.2, 0.75
BLOCK = 64
PIECE = 1 << 17  # words hashed together
QUERY_WORDS = 24_000_000
COMMON = 512  # words whose values are kept as a matrix
PART = 2048  # queries answered together
SHARD_ROWS, SHARD_WORDS = 4096, 1 << 21
MATCHES = 1 << 18  # of rare words of documents and queries, held at a time
FIRST = 8  # one file of so many is searched first
DIGITS = 4
SLACK = 1e-4  # more than single precision loses in a sum of COMMON values
TIE = 1.1e-4  # scores further apart than this are never equal when rounded
WORDS_SCHEMA = "doc_id long, length long, words binary, counts binary"


def hashed_words(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of a batch in order, and how many each text has."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(starts) - 1, np.int64)
    letter = (data != 32) & ((data < 9) | (data > 13))
    edge = np.zeros(len(data) + 1, bool)  # a text ends a word even where it ends without a space
    edge[starts] = True
    begins = np.flatnonzero(letter & (edge[:-1] | ~np.r_[False, letter[:-1]]))
    ends = np.flatnonzero(letter & (edge[1:] | ~np.r_[letter[1:], False])) + 1
    low = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
    words = np.zeros(len(begins), np.uint64)
    for at in range(0, len(begins), PIECE):  # power tables stay small: hashes do not depend on the place
        a, b = begins[at : at + PIECE], ends[at : at + PIECE]
        sums, power = prefix(low[a[0] : b[-1]])
        words[at : at + PIECE] = mix((sums[b - a[0]] - sums[a - a[0]]) * power[a - a[0]])
    return words, np.diff(np.searchsorted(begins, starts))


def forward_index(df: DataFrame) -> DataFrame:
    small_batches(df.sparkSession)

    def split(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            return_memory()
            words, length = hashed_words(*utf8(part.column(1)))
            columns: tuple[list[bytes], list[bytes]] = ([], [])
            for end, n in zip(np.cumsum(length).tolist(), length.tolist()):
                bag = np.sort(words[end - n : end])
                new = np.flatnonzero(np.r_[True, bag[1:] != bag[:-1]]) if n else np.zeros(0, np.int64)
                columns[0].append(bag[new].tobytes())
                columns[1].append(np.diff(np.r_[new, n]).astype(np.uint32).tobytes() if n else b"")
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(length, pa.int64()), *(pa.array(c, pa.binary()) for c in columns)], names=["doc_id", "length", "words", "counts"])

    return df.select(df["doc_id"].cast("long"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(split, WORDS_SCHEMA)


def _numbers(column: pa.Array, kind: type) -> np.ndarray:
    """What the rows of a binary column hold, one row after the other."""
    return utf8(column)[0].view(kind)


class Part:
    """Some queries, by what they ask for: their common words as bits, and for every rare word who has it."""

    def __init__(self, terms: np.ndarray, sizes: np.ndarray, column: np.ndarray):
        owner, at = np.repeat(np.arange(len(sizes)), sizes), column[terms]
        bits = np.zeros((len(sizes), COMMON), bool)
        bits[owner[at >= 0], at[at >= 0]] = True
        self.bits = np.packbits(bits, axis=1)
        rare, owner = terms[at < 0], owner[at < 0]
        turn = np.argsort(rare, kind="stable")
        self.cells = (owner[turn] * BLOCK).astype(np.int32)
        self.terms, first = np.unique(rare[turn], return_index=True)
        self.first = np.r_[first, len(rare)].astype(np.int32)

    def __len__(self) -> int:
        return len(self.bits)


def most_common(weights: np.ndarray) -> np.ndarray:
    """The column of each of the COMMON heaviest words, -1 for all others."""
    column = np.full(len(weights), -1, np.int16)
    best = np.argsort(-weights, kind="stable")[:COMMON]
    column[best] = np.arange(len(best))
    return column


class Queries:
    """A block of queries: ids, and each one's words as places in the sorted list of all of them."""

    def __init__(self, found: pa.Table):
        self.ids = found.column("doc_id").to_numpy()
        flat = np.concatenate([np.zeros(0, np.uint64), *(_numbers(c, np.uint64) for c in found.column("words").chunks)])
        self.sizes = np.concatenate([np.zeros(0, np.int64), *(np.diff(utf8(c)[1]) // 8 for c in found.column("words").chunks)])
        self.words = np.unique(flat)
        self.terms = np.concatenate([np.zeros(0, np.int32), *(np.searchsorted(self.words, flat[at : at + PIECE]).astype(np.int32) for at in range(0, len(flat), PIECE))])

    def ranked(self, df: np.ndarray, rows: int) -> Asked:
        """The same for the shards, when it is known how many of all rows hold each word."""
        column = most_common(df * np.bincount(self.terms, minlength=len(df)))
        ends = np.cumsum(np.r_[0, self.sizes])
        parts = [Part(self.terms[ends[at] : ends[min(at + PART, len(self.ids))]], self.sizes[at : at + PART], column) for at in range(0, len(self.ids), PART)]
        return Asked(self.ids, self.words, np.log(1 + (rows - df + 0.5) / (df + 0.5)), column, parts)


class Asked(NamedTuple):
    """What a shard has to know of a block of queries."""

    ids: np.ndarray
    words: np.ndarray
    idf: np.ndarray
    column: np.ndarray
    parts: list[Part]


def places(words: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in a sorted list, and which were found there."""
    if not len(words):
        return np.zeros(0, np.int64), np.zeros(len(word), bool)
    at = np.searchsorted(words, word)
    hit = words[np.minimum(at, len(words) - 1)] == word
    return at[hit], hit


def _ranges(begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """All numbers of some ranges, one after the other."""
    size = ends - begins
    return np.arange(size.sum()) + np.repeat(begins - (np.cumsum(size) - size), size)


class Shard:
    """Some documents, for the words of a block of queries: common words as a matrix, rare ones as postings by block.

    Documents with the same commonest word stand together, by length: their blocks have tight bounds.
    """

    def __init__(self, ids: np.ndarray, lengths: np.ndarray, sizes: np.ndarray, terms: np.ndarray, counts: np.ndarray, values: np.ndarray, n_terms: int, column: np.ndarray | None = None):
        """Postings come by document: its words in the block, as many as `sizes` says."""
        main = np.zeros(len(ids), np.uint64)
        used = sizes > 0
        if len(terms):
            main[used] = np.maximum.reduceat(np.minimum(counts, 0xFFFFFFF).astype(np.uint64) << np.uint64(32) | terms.astype(np.uint64), (np.cumsum(sizes) - sizes)[used])
        order = np.lexsort((lengths, main & np.uint64(0xFFFFFFFF)))
        self.ids, self.n_terms, self.n_blocks = ids[order], n_terms, -(-len(ids) // BLOCK)
        self.column = most_common(np.bincount(terms, minlength=n_terms)) if column is None else column
        ends = np.cumsum(sizes)
        turn = _ranges((ends - sizes)[order], ends[order])
        terms, values, place = terms[turn], values[turn], np.repeat(np.arange(len(ids), dtype=np.int32), sizes[order])
        at = self.column[terms]
        exact = np.zeros((self.n_blocks * BLOCK, COMMON))
        exact[place[at >= 0], at[at >= 0]] = values[at >= 0]
        self.exact = exact.reshape(self.n_blocks, BLOCK, COMMON)
        self.rough = self.exact.astype(np.float32)
        self.most = self.rough.max(axis=1)
        self.terms, self.values, self.places = terms[at < 0], values[at < 0], place[at < 0]

    def search(self, part: Part, floor: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """The k best documents of each query that may reach its `floor`, which rises: queries, places, scores by query
        and rank, and how many blocks were opened for a query.

        A block's bound is the largest sum of rare words among its documents and the block's largest value of every
        common word.  Sums in single precision only choose what is summed again in full.
        """
        at_term = np.full(self.n_terms, -1, np.int32)
        at_term[part.terms] = np.arange(len(part.terms))
        at = at_term[self.terms]
        hit = at >= 0
        at, place, value = at[hit], self.places[hit], self.values[hit]
        begins = part.first[at]
        n = part.first[at + 1] - begins
        cell = (place % BLOCK).astype(np.int64)
        edges = np.searchsorted(place, np.arange(self.n_blocks + 1) * BLOCK)
        common = np.unpackbits(part.bits, axis=1).astype(np.float32)
        bounds = self.most @ common.T
        best = np.zeros((len(part), k))
        found: tuple[list, list, list] = ([], [], [])
        opened = 0
        for block in range(self.n_blocks):
            a, b = edges[block], edges[block + 1]
            rare = np.zeros(len(part) * BLOCK)
            sums = np.cumsum(n[a:b])
            stops = a + np.unique(np.r_[np.searchsorted(sums, np.arange(MATCHES, sums[-1] if b > a else 0, MATCHES)), b - a])
            for c, d in zip(np.r_[a, stops[:-1]], stops):  # long texts match many times more than others
                cells = np.repeat(cell[c:d], n[c:d])
                cells += part.cells[_ranges(begins[c:d], begins[c:d] + n[c:d])]
                rare += np.bincount(cells, np.repeat(value[c:d], n[c:d]), len(rare))
            rare = rare.reshape(len(part), BLOCK)
            bound = (bounds[block] + rare.max(axis=1)) * (1 + SLACK)
            some = np.flatnonzero((bound >= floor) & (bound > 0))
            opened += len(some)
            if not len(some):
                continue
            rough = (common[some] @ self.rough[block].T + rare[some]).max(axis=1) * (1 + SLACK)
            some = some[(rough >= floor[some]) & (rough > 0)]
            if not len(some):
                continue
            scores = common[some].astype(float) @ self.exact[block].T + rare[some]
            tops = np.concatenate([best[some], scores], axis=1)
            best[some] = tops = np.partition(tops, -k, axis=1)[:, -k:]
            floor[some] = np.maximum(floor[some], tops[:, 0] - TIE)
            query, doc = np.nonzero((scores >= floor[some, None]) & (scores > 0))
            for column, more in zip(found, (some[query], doc + block * BLOCK, scores[query, doc])):
                column.append(more)
        query, doc, score = (np.concatenate([np.zeros(0, np.int64), *column]) for column in found)
        left = score >= floor[query.astype(np.int64)]
        query, doc, score = query[left].astype(np.int64), doc[left].astype(np.int64), score[left]
        turn = np.lexsort((self.ids[doc], -np.round(score, DIGITS), query))
        query, doc, score = query[turn], doc[turn], score[turn]
        first = np.searchsorted(query, query)
        left = np.arange(len(query)) - first < k
        return query[left], doc[left], score[left], opened

    def best(self, terms: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, int]:
        """The k best documents of one query and their scores, and how many blocks were opened."""
        part = Part(terms, np.array([len(terms)]), self.column)
        _, docs, scores, opened = self.search(part, np.zeros(1), k)
        return docs, scores, opened


NO_ID = np.iinfo(np.int64).max  # a null id sorts last
HITS = "query_id long, ids binary, scores binary"


def _counted(index: DataFrame, words: np.ndarray) -> np.ndarray:
    """How many rows hold each of the words."""
    sent = index.sparkSession.sparkContext.broadcast(words)

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return_memory()
        total = np.zeros(len(sent.value), np.int64)
        for part in parts:
            at, _ = places(sent.value, _numbers(part.column(0), np.uint64))
            np.add(total, np.bincount(at, minlength=len(total)), out=total)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["place", "n"])

    counted = index.select("words").mapInArrow(count, "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).toArrow()
    sent.unpersist()
    df = np.zeros(len(words))
    df[counted.column("place").to_numpy()] = counted.column("n").to_numpy()
    return df


def _hits(index: DataFrame, scored: Broadcast[Asked], floor: np.ndarray, k: int, mean: float) -> DataFrame:
    """The k best of each shard for each query, without those that can't reach the query's floor."""
    least = index.sparkSession.sparkContext.broadcast(floor)

    def answer(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, floor = scored.value, least.value.copy()
        held: list[list[np.ndarray]] = [[] for _ in range(6)]

        def answers() -> pa.RecordBatch:
            return_memory()
            columns = [np.concatenate(column) for column in held]
            for column in held:
                column.clear()
            shard = Shard(*columns, len(asked.words), asked.column)
            columns.clear()
            rows: list[tuple[int, bytes, bytes]] = []
            for at, part in zip(range(0, len(asked.ids), PART), asked.parts):
                query, doc, score, _ = shard.search(part, floor[at : at + PART], k)
                ids = shard.ids[doc]
                edges = np.flatnonzero(np.r_[True, query[1:] != query[:-1], True]) if len(query) else np.zeros(1, np.int64)
                rows += [(q, ids[a:b].tobytes(), score[a:b].tobytes()) for q, a, b in zip(asked.ids[at + query[edges[:-1]]].tolist(), edges[:-1], edges[1:])]
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())], names=["query_id", "ids", "scores"])

        for part in parts:
            at, hit = places(asked.words, _numbers(part.column("words"), np.uint64))
            owner = np.repeat(np.arange(len(part)), np.diff(utf8(part.column("counts"))[1]) // 4)[hit]
            tf, length = _numbers(part.column("counts"), np.uint32)[hit], part.column("length").to_numpy()
            value = asked.idf[at] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[owner] / mean))
            for column, more in zip(held, (part.column("doc_id").fill_null(NO_ID).to_numpy(), length, np.bincount(owner, minlength=len(part)), at.astype(np.int32), tf, value)):
                column.append(more)
            if sum(map(len, held[0])) >= SHARD_ROWS or sum(map(len, held[3])) >= SHARD_WORDS:
                yield answers()
        if held[0]:
            yield answers()

    return index.mapInArrow(answer, HITS)


def _merged(hits: DataFrame, k: int) -> DataFrame:
    def merge(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        ids = np.frombuffer(b"".join(table.column("ids").to_pylist()), np.int64)
        scores = np.round(np.frombuffer(b"".join(table.column("scores").to_pylist()), float), DIGITS)
        turn = np.lexsort((ids, -scores))[:k]
        found = pa.array(ids[turn], mask=ids[turn] == NO_ID)
        return pa.table({"query_id": pa.array([key[0].as_py()] * len(turn), pa.int64()), "rank": pa.array(np.arange(1, len(turn) + 1), pa.int32()), "doc_id": found, "score": pa.array(scores[turn])})

    return hits.groupBy("query_id").applyInArrow(merge, "query_id long, rank int, doc_id long, score double")


def _search_block(index: DataFrame, queries: Queries, k: int, rows: int, mean: float) -> DataFrame:
    spark = index.sparkSession
    scored = spark.sparkContext.broadcast(queries.ranked(_counted(index, queries.words), rows))
    floor = np.zeros(len(queries.ids))
    files = sorted(index.inputFiles())
    if len(files) == 1:
        return _merged(_hits(index, scored, floor, k, mean), k)
    some, others = (spark.read.schema(index.schema).parquet(*f) for f in (files[::FIRST], [f for n, f in enumerate(files) if n % FIRST]))
    first = keep(_hits(some, scored, floor, k, mean), "first")
    least = _merged(first, k).where(F.col("rank") == k).select("query_id", "score").toArrow()
    turn = np.argsort(least.column("query_id").to_numpy())
    at, hit = places(least.column("query_id").to_numpy()[turn], queries.ids)
    floor[hit] = least.column("score").to_numpy()[turn][at] - TIE
    return _merged(first.unionByName(_hits(others, scored, floor, k, mean)), k)


def search(df: DataFrame, queries: DataFrame, k: int = 10, query_words: int = QUERY_WORDS) -> DataFrame:
    """(query_id, rank, doc_id, score): the k best documents for each query text; `queries` has doc_id and text."""
    index = keep(forward_index(df), "index")
    asked = keep(forward_index(queries).where("doc_id is not null and length > 0"), "queries")
    rows, mean = index.agg(F.count("*"), F.avg("length")).first()
    size = F.octet_length("words") / 8
    blocks = max(1, -(-int(asked.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]) * 2 // query_words))
    out = None
    for block in range(blocks):
        some = asked.where(F.pmod(F.xxhash64("doc_id"), F.lit(blocks)) == block).select("doc_id", "words").orderBy("doc_id", "words").toArrow()
        found = _search_block(index, Queries(some), k, rows, mean or 1.0)
        found = keep(found, f"block{block}") if blocks > 1 else found
        out = found if out is None else out.unionByName(found)
    return out
