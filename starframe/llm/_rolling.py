"""Rolling fingerprints of byte strings and word sequences, vectorised with numpy.

A polynomial fingerprint with wrap-around 64-bit arithmetic: with ``S[i] = sum(t[c_j] * B**j, j < i)`` the fingerprint of any
slice ``[a, b)`` is ``(S[b] - S[a]) * B**-a``, so one prefix sum gives the fingerprint of every window (Rabin-Karp).  ``B`` is
odd and so has an inverse; symbols are mapped to random 64-bit values first.  These functions run inside Spark tasks, on a few
hundred kilobytes at a time.
"""

from __future__ import annotations

import numpy as np

_U = np.uint64
_BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
_TABLES = tuple(np.random.default_rng(1000 + f).integers(1, 2**64 - 1, 256, dtype=np.uint64) | _U(1) for f in range(2))
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}

#: ASCII white space: the space and 0x09 to 0x0D.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def powers(n: int, family: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """``B**i`` and ``B**-i`` for i in 0..n, kept for the next call."""
    have = _POWERS.get(family)
    if have is None or len(have[0]) < n + 1:
        size = max(n + 1, 1 << 16)
        base = _BASES[family]
        both = []
        for b in (base, pow(base, -1, 1 << 64)):
            a = np.full(size, b, _U)
            a[0] = 1
            both.append(np.multiply.accumulate(a))
        have = _POWERS[family] = (both[0], both[1])
    return have


def prefix(symbols: np.ndarray, family: int = 0) -> np.ndarray:
    """Prefix sums of symbols (uint64 values), one longer than its input."""
    up, _ = powers(len(symbols), family)
    out = np.zeros(len(symbols) + 1, _U)
    np.cumsum(symbols * up[: len(symbols)], out=out[1:])
    return out


def of_bytes(data: np.ndarray, family: int = 0) -> np.ndarray:
    return prefix(_TABLES[family][data], family)


def slices(s: np.ndarray, start: np.ndarray, stop: np.ndarray, family: int = 0) -> np.ndarray:
    """Fingerprints of the slices [start, stop)."""
    _, down = powers(len(s), family)
    return mix((s[stop] - s[start]) * down[start])


def windows(s: np.ndarray, length: int, family: int = 0) -> np.ndarray:
    """Fingerprints of every slice of one length."""
    n = len(s) - length
    if n <= 0:
        return np.zeros(0, _U)
    _, down = powers(len(s), family)
    return mix((s[length:] - s[:n]) * down[:n])


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads a value's entropy over all its bits."""
    x = x ^ (x >> _U(33))
    x *= _U(0xFF51AFD7ED558CCD)
    x ^= x >> _U(29)
    x *= _U(0xC4CEB9FE1A85EC53)
    x ^= x >> _U(32)
    return x


class Texts:
    """Texts laid end to end: ``data`` (uint8), and where each begins and ends."""

    def __init__(self, texts: list[bytes]):
        self.data = np.frombuffer(b"".join(texts), np.uint8)
        ends = np.cumsum([len(t) for t in texts], dtype=np.int64) if texts else np.zeros(0, np.int64)
        self.ends = ends
        self.starts = ends - np.array([len(t) for t in texts], np.int64) if texts else ends


class Words:
    """The words ``[^\\x20\\x09-\\x0D]+`` of texts laid end to end; no word spans two texts.

    ``start``, ``stop``: byte positions; ``text``: the number of the text; ``hash``: fingerprint of the word's bytes;
    ``first``: the number of the first word of each text, and one more entry at the end.
    """

    def __init__(self, texts: Texts, separators: np.ndarray = IS_SPACE):
        inside = ~separators[texts.data]
        edge = np.zeros(len(inside) + 1, bool)
        if len(inside):
            edge[0], edge[-1] = inside[0], inside[-1]
            edge[1:-1] = inside[1:] != inside[:-1]
        # A text boundary between two word bytes ends one word and begins another.
        cut = texts.starts[(texts.starts > 0) & (texts.starts < len(inside))]
        cut = np.unique(cut[inside[cut] & inside[cut - 1]]) if len(cut) else cut
        marks = np.sort(np.concatenate([np.flatnonzero(edge), cut, cut]))
        self.start, self.stop = marks[0::2], marks[1::2]
        self.first = np.append(np.searchsorted(self.start, texts.starts), len(self.start))
        self.text = np.searchsorted(texts.ends, self.start, side="right")
        self.hash = slices(of_bytes(texts.data), self.start, self.stop)


def chunks(rows: list[tuple], size: int = 1 << 20):
    """Rows whose last item is a text as bytes, in lists of about ``size`` bytes; one longer text makes a list of its own."""
    part, n = [], 0
    for row in rows:
        if part and n + len(row[-1]) > size:
            yield part
            part, n = [], 0
        part.append(row)
        n += len(row[-1])
    if part:
        yield part
