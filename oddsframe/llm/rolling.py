"""Rolling hashes of all grams of a sequence, as whole-array operations modulo 2**64."""

from __future__ import annotations

import numpy as np

ODD = np.uint64(0x9E3779B97F4A7C15)
TABLE = (1 << 17) + 4096  # longer runs are hashed piece by piece
_powers: list[np.ndarray] = []


def _power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, TABLE)
        inverse = np.uint64(pow(int(ODD), -1, 1 << 64))
        _powers[:] = [np.cumprod(np.r_[np.uint64(1), np.full(size, base, np.uint64)]) for base in (ODD, inverse)]
    return _powers[0], _powers[1]


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def prefix(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums s and powers p with (s[b] - s[a]) * p[a] a hash of data[a:b] alone."""
    power, inverse = _power_table(len(data) + 1)
    terms = data.astype(np.uint64)
    terms += np.uint64(1)
    terms *= inverse[: len(data)]
    return np.r_[np.uint64(0), np.cumsum(terms)], power


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """Hash of every gram of `data`, computed in pieces that the table of powers covers."""
    out = np.empty(max(len(data) - gram + 1, 0), np.uint64)
    step = TABLE - gram
    for at in range(0, len(out), step):
        sums, power = prefix(data[at : at + step + gram - 1])
        out[at : at + step] = mix((sums[gram:] - sums[:-gram]) * power[: len(sums) - gram])
    return out


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every `width` neighbours."""
    span = 1
    while span * 2 <= width:
        values = np.minimum(values[:-span], values[span:])
        span *= 2
    return np.minimum(values[: span - width], values[width - span :]) if width > span else values
