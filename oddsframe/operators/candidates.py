"""Which catalog entries can be a match's best: an inverted index over name pieces with a bound per entry.

A block holds some matches and some entries of one snapshot.  The entries' bigrams and characters are indexed; looking
up a match's pieces gives the number of shared ones for every entry at once, and from these counts an upper and a lower
bound of the exact score.  All bounds follow from the definition of the similarity: the dice parts are exact, an edit
costs at least the characters and bigrams that are not shared, and a contained or equal name shares all its pieces.
An entry is passed on where its upper bound reaches the best lower bound, so no best entry, tied ones included, is lost.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from oddsframe.functions.times import CLOCK_STEPS, DATED_STEPS

SLACK = 1e-9  # for sums of doubles in another order


def _offsets(column: pa.ListArray) -> np.ndarray:
    return column.offsets.to_numpy().astype(np.int64)


class Names:
    """Flat arrays of name keys: text, distinct bigrams, distinct characters, alias group."""

    def __init__(self, keys: pa.StructArray):
        texts = keys.field("n")
        self.text = np.array(texts.to_pylist(), object)
        self.length = np.array([len(t) for t in self.text], np.int64)
        self.group = keys.field("grp").fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        self.pieces = []  # offsets and values of bigrams, then of characters
        for part in ("g", "c"):
            column = keys.field(part)
            at = _offsets(column)
            self.pieces.append((at - at[0], column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)))
        self.sizes = [np.diff(at) for at, _ in self.pieces]

    def __len__(self) -> int:
        return len(self.text)

    def of(self, part: int, k: int) -> np.ndarray:
        at, values = self.pieces[part]
        return values[at[k] : at[k + 1]]


class Index:
    """Postings of the pieces of many names."""

    def __init__(self, names: Names):
        self.names = names
        self.postings = []
        for at, values in names.pieces:
            owner = np.repeat(np.arange(len(names)), np.diff(at))
            order = np.argsort(values, kind="stable")
            known, first = np.unique(values[order], return_index=True)
            self.postings.append((known, np.append(first, len(values)), owner[order]))
        self.by_text: dict[str, list[int]] = {}
        for k, text in enumerate(names.text):
            self.by_text.setdefault(text, []).append(k)

    def shared(self, part: int, pieces: np.ndarray) -> np.ndarray:
        known, first, owner = self.postings[part]
        at = np.searchsorted(known, pieces)
        at = at[(at < len(known)) & (known[np.minimum(at, len(known) - 1)] == pieces)] if len(known) else at[:0]
        rows = [owner[first[k] : first[k + 1]] for k in at]
        return np.bincount(np.concatenate(rows), minlength=len(self.names)) if rows else np.zeros(len(self.names), np.int64)

    def bounds(self, one: Names, k: int, characters: float, league: bool) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest similarity of name k of `one` to every name here."""
        many = self.names
        n_g, n_c, length = one.sizes[0][k], one.sizes[1][k], one.length[k]
        grams, chars = self.shared(0, one.of(0, k)), self.shared(1, one.of(1, k))
        dice = [2.0 * grams / np.maximum(n_g + many.sizes[0], 1) * (n_g > 0), characters * 2.0 * chars / np.maximum(n_c + many.sizes[1], 1)]
        low = np.maximum(*dice)
        high = low
        longest = np.maximum(np.maximum(length, many.length), 1)
        inside = (chars == np.minimum(n_c, many.sizes[1])) & ((grams == np.minimum(n_g, many.sizes[0])) | (np.minimum(length, many.length) <= 2))
        if league:
            high = np.where(inside, 1.0, high)
        else:
            common = np.minimum(length - n_c + chars, many.length - many.sizes[1] + chars)
            edits = np.maximum(longest - common, (np.maximum(n_g, many.sizes[0]) - grams) / 2.0)
            high = np.maximum(high, 0.92 * (1.0 - edits / longest))
            held = np.maximum(0.82, np.minimum(0.96, np.minimum(length, many.length) / longest + 0.18))
            low, high = np.where(inside, np.minimum(low, held), low), np.where(inside, np.maximum(high, held), high)
        same = many.group == one.group[k] if one.group[k] >= 0 else np.zeros(len(many), bool)
        same[self.by_text.get(one.text[k], [])] = True
        low, high = np.where(same, 1.0, low), np.where(same, 1.0, high)
        if league:
            missing = (many.length == 0) | (length == 0)
            return np.where(missing, 0.5, low), np.where(missing, 0.5, high)
        return low, high


class Side:
    """The variants of one side of all entries, and the best bounds over them."""

    def __init__(self, column: pa.ListArray):
        at = _offsets(column)
        self.first, self.last = at[:-1] - at[0], at[1:] - at[0]
        self.index = Index(Names(column.flatten()))

    def best(self, one: Names, variants: range) -> tuple[np.ndarray, np.ndarray]:
        n = len(self.first)
        out = np.zeros(n), np.zeros(n)
        filled = self.last > self.first
        for k in variants if filled.any() else ():
            for most, found in zip(out, self.index.bounds(one, k, 0.96, league=False)):
                most[filled] = np.maximum(most[filled], np.maximum.reduceat(found, self.first[filled]))
        return out


def steps(gap: np.ndarray, table: tuple) -> np.ndarray:
    out = np.full(len(gap), table[-1])
    for most, score in reversed(table[:-1]):
        out[gap <= most] = score
    return out


def closeness_in_time(kickoff: int | None, clock: bool, kickoffs: np.ndarray, known: np.ndarray) -> np.ndarray:
    if kickoff is None:
        return np.full(len(kickoffs), 0.5)
    gap = np.abs(kickoffs - kickoff)
    turn = gap % 1440
    score = steps(np.minimum(turn, 1440 - turn), CLOCK_STEPS) if clock else steps(gap, DATED_STEPS)
    return np.where(known, score, 0.5)


def percent(score: np.ndarray, slack: float) -> np.ndarray:
    return np.floor(score * 100.0 + 0.5 + slack)


def reachable(matches: pa.StructArray, entries: pa.StructArray, gate: tuple[float, float] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (match, entry) that have to be scored; both come as link keys.

    For the best entry of every match, or (`gate`) all entries with that much time score and similarity on both
    straight sides.
    """
    sides = {name: Side(entries.field(name)) for name in ("h", "a")}
    leagues = Index(Names(entries.field("l")))
    kickoffs, known = entries.field("k").fill_null(0).to_numpy(zero_copy_only=False), entries.field("k").is_valid().to_numpy(zero_copy_only=False)
    own = {name: (_offsets(matches.field(name)), Names(matches.field(name).flatten())) for name in ("h", "a")}
    own_leagues = Names(matches.field("l"))
    league_bounds: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    out: list[list[np.ndarray]] = [[np.zeros(0, np.int64)], [np.zeros(0, np.int64)]]
    for k, (kickoff, clock) in enumerate(zip(matches.field("k").to_pylist(), matches.field("clock").to_pylist())):
        time = closeness_in_time(kickoff, clock, kickoffs, known)
        variants = {name: range(at[k] - at[0], at[k + 1] - at[0]) for name, (at, _) in own.items()}
        bound = lambda mine, theirs: sides[theirs].best(own[mine][1], variants[mine])
        straight = bound("h", "h"), bound("a", "a")
        if gate:
            hit = (time >= gate[0]) & (straight[0][1] + SLACK >= gate[1]) & (straight[1][1] + SLACK >= gate[1])
        else:
            crossed = bound("h", "a"), bound("a", "h")
            league = league_bounds.setdefault(own_leagues.text[k], None) or leagues.bounds(own_leagues, k, 0.9, league=True)
            league_bounds[own_leagues.text[k]] = league
            low, high = ([np.maximum(straight[0][i] + straight[1][i], crossed[0][i] + crossed[1][i]) / 2.0 * 0.74 + time * 0.18 + league[i] * 0.08 for i in (0, 1)])
            strongest = np.maximum.reduce([straight[0][1], straight[1][1], crossed[0][1], crossed[1][1]])
            high = percent(high, SLACK * 100)
            high = np.where((time >= 0.98) & (league[1] >= 0.92 - SLACK) & (strongest >= 0.92 - SLACK), np.maximum(high, 82), high)
            hit = high >= percent(low, -SLACK * 100).max() if len(low) else np.zeros(0, bool)
        at = np.flatnonzero(hit)
        out[0].append(np.full(len(at), k))
        out[1].append(at)
    return np.concatenate(out[0]), np.concatenate(out[1])
