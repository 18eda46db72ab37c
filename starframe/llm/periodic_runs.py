"""Periodic run detection (12) by multi-scale minimizers, with direct lag scans for short periods.

A run is a maximal stretch of words with smallest period q that is max(shortest, 2 q) words long at least.

- Periods below SCAN: words are compared with those q places further, for each q; long enough streaks of equal ones are stretches.
- Periods from P to 2 P, for P = SCAN, 2 SCAN, ...: the fingerprints of all P/4-word strings are formed, and those are kept that are
  the least of some window of P/4 of them (ties are all kept).  A run of such a period holds over P/2 windows that stand once more
  q words later; equal windows have equal minima, so two equal minima lie q apart.  All pairs of equal minima that are P to 2 P apart
  are seeds, whose matches are extended to both sides by binary search over prefix fingerprints.

Where a minimum follows an equal one within P/8 words, the text there has a short period, and minima are dense.  A seed of which both
ends follow so has a neighbour that lies on the same stretch, so only seeds with an end that doesn't are extended: seeds stay in
proportion to the words of a scale, also in a text of one word.

A stretch found for several multiples of a period is the run of the least.  Documents are worked on one batch of about a megabyte at a
time in Arrow tasks; nothing is shuffled.  Words are numbered exactly within a document; fingerprints of longer strings have 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from starframe.llm import _rolling as R

_U = np.uint64
#: Periods from here on are found by minimizers.
SCAN = 32

RUNS = "array<struct<start:long,length:long,period:long>>"


def minima(h: np.ndarray, width: int) -> np.ndarray:
    """Which entries are the least of some window of ``width`` neighbours; ties are all."""
    if len(h) < width:
        return np.zeros(len(h), bool)

    def slide(x: np.ndarray, f) -> np.ndarray:
        size = 1
        while size < width:
            step = min(size, width - size)
            x = f(x[:-step], x[step:])
            size += step
        return x

    edge = np.zeros(width - 1, h.dtype)
    return slide(np.concatenate([edge, slide(h, np.minimum), edge]), np.maximum) == h


def _between(numbers: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each pair of limits [low, high) of positions: its number, repeated, and the positions."""
    n = np.maximum(high - low, 0)
    return np.repeat(numbers, n), np.arange(n.sum()) + np.repeat(low - (np.cumsum(n) - n), n)


def seeds(keys: np.ndarray, period: int, size: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of equal minima that are ``period`` up to twice as many places apart: the first places, and the distances."""
    at = np.flatnonzero(minima(keys, width))
    at = at[np.lexsort((at, keys[at]))]
    key = keys[at]
    same = key[1:] == key[:-1]
    often = np.append(same, False) | np.append(False, same)
    at, key = at[often], key[often]
    if not len(at):
        return at, at
    new = np.append(True, key[1:] != key[:-1])
    # One axis for all keys, on which places of different keys are too far apart to meet.
    place = np.cumsum(new) * (len(keys) + 2 * period + 1) + at
    alone = np.flatnonzero(new | np.append(True, np.diff(at) > size // 2))
    first, second = _between(alone, np.searchsorted(place, place[alone] + period), np.searchsorted(place, place[alone] + 2 * period))
    other, before = _between(alone, np.searchsorted(place, place[alone] - 2 * period, "right"), np.searchsorted(place, place[alone] - period, "right"))
    pairs = np.unique(np.stack([np.append(at[first], at[before]), np.append(at[second], at[other])]), axis=1)
    return pairs[0], pairs[1] - pairs[0]


def _reach(s: np.ndarray, a: np.ndarray, b: np.ndarray, back: bool) -> np.ndarray:
    """How many symbols agree from places a and b on (back: before them), by binary search over prefix fingerprints."""
    low, high = np.zeros(len(a), np.int64), (np.minimum(a, b) if back else len(s) - 1 - np.maximum(a, b)).astype(np.int64)
    while (low < high).any():
        mid = (low + high + 1) // 2
        x, y = (R.slices(s, a - mid, a), R.slices(s, b - mid, b)) if back else (R.slices(s, a, a + mid), R.slices(s, b, b + mid))
        fits = x == y
        low, high = np.where(fits, mid, low), np.where(fits, high, mid - 1)
    return low


def _laid_out(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers of texts end to end, with another negative number after each text, and where each text begins."""
    size = np.array([len(p) + 1 for p in parts])
    ends = np.cumsum(size)
    x = np.empty(ends[-1], np.int64)
    for p, e in zip(parts, ends.tolist(), strict=True):
        x[e - len(p) - 1 : e - 1] = p
    x[ends - 1] = -1 - np.arange(len(parts))
    return x, ends - size


def runs(parts: list[np.ndarray], shortest: int = 12) -> list[np.ndarray]:
    """The runs of each text, given as numbers of its words: rows (start, length, period), by start, then period."""
    found = []  # text, start, end, period
    which = np.flatnonzero([len(p) >= shortest for p in parts])
    period = 1
    while len(which):
        x, first = _laid_out([parts[k] for k in which])
        if period < SCAN:
            for q in range(1, min(SCAN, (len(x) - 1) // 2 + 1)):
                equal = np.concatenate([[False], x[q:] == x[:-q], [False]])
                edges = np.flatnonzero(equal[1:] != equal[:-1])
                a, b = edges[0::2], edges[1::2] + q
                long = b - a >= max(shortest, 2 * q)
                found.append((a[long], b[long], np.full(long.sum(), q), which, first))
            period = SCAN
        else:
            size = period // 4
            s = R.prefix(R.mix(x.astype(_U)))
            a, q = seeds(R.windows(s, size), period, size, size)
            left, right = _reach(s, a, a + q, True), _reach(s, a + size, a + size + q, False)
            start, end = a - left, a + size + q + right
            long = end - start >= np.maximum(shortest, 2 * q)
            found.append((start[long], end[long], q[long], which, first))
            period *= 2
        which = which[[len(parts[k]) >= 2 * period for k in which]] if len(which) else which
    own: list[list[tuple[int, int, int]]] = [[] for _ in parts]
    for a, b, q, which, first in found:
        at = np.searchsorted(first, a, side="right") - 1
        for k, start, end, p in zip(which[at].tolist(), (a - first[at]).tolist(), (b - first[at]).tolist(), q.tolist(), strict=True):
            own[k].append((start, end, p))
    out = []
    for rows in own:
        least: dict[tuple[int, int], int] = {}
        for start, end, p in rows:
            least[start, end] = min(p, least.get((start, end), p))
        out.append(np.array(sorted((start, end - start, p) for (start, end), p in least.items()), np.int64).reshape(-1, 3))
        out[-1] = out[-1][np.lexsort((out[-1][:, 2], out[-1][:, 0]))]
    return out


def kept_words(n: int, found: np.ndarray) -> np.ndarray:
    """Which of n words no run repeats: those that lie in no run, or among a run's first period at most."""
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, found[:, 0] + found[:, 2], 1)
    np.add.at(steps, found[:, 0] + found[:, 1], -1)
    return np.cumsum(steps[:-1]) == 0


def _numbered(words: list[bytes]) -> np.ndarray:
    known: dict[bytes, int] = {}
    return np.array([known.setdefault(w, len(known)) for w in words], np.int64)


def _scan(shortest: int):
    def scan(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in tables:
            texts = table.column("text").cast(pa.large_binary())
            sizes, spans, lists, kept = [], [], [], []
            for part in R.chunks([(k, texts[k].as_py() or b"") for k in range(len(texts))]):
                words = [t.split() for _, t in part]  # bytes.split() parts at the space and 0x09 to 0x0D
                for own, rows in zip(words, runs([_numbered(w) for w in words], shortest), strict=True):
                    sizes.append(len(own))
                    spans.append(len(rows))
                    lists.append(rows)
                    kept.append(b" ".join(compress(own, kept_words(len(own), rows).tolist()) if len(rows) else own))
            flat = np.concatenate([*lists, np.zeros((0, 3), np.int64)])
            items = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(flat[:, k])) for k in range(3)], names=["start", "length", "period"])
            ends = pa.array(np.append(0, np.cumsum(spans, dtype=np.int32)).astype(np.int32))
            yield pa.RecordBatch.from_arrays([table.column("doc_id"), pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(ends, items), pa.array(kept, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "runs", "collapsed"])

    return scan


def find_runs(docs: DataFrame, shortest: int = 12) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_words, runs (start, length, period: by start, then period), collapsed.

    Words are ``[^\\x20\\x09-\\x0D]+``.  ``collapsed`` is the text without the words that any run contains after its first period, one
    space between the others.  A null text has no words, no runs and an empty ``collapsed``; so has one of white space.  Repeated rows
    and null ids are rows like others; other columns are ignored; an empty table gives no rows.
    """
    rows = docs.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "CAST(text AS STRING) AS text")
    return rows.mapInArrow(_scan(shortest), f"doc_id long, n_words long, runs {RUNS}, collapsed string")
