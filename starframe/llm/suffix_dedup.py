"""Suffix-array dedup (1) by prefix-free parsing: remove every byte covered by a long string that occurs more than once.

Prefix-free parsing cuts text where a rolling fingerprint of a few bytes has a chosen value (a *trigger*), so equal text is cut
alike wherever it stands, and orders the suffixes of the text by (suffix of a phrase, rank of the parse that follows).  Repeats
of ``length`` bytes need that order only to a depth of ``length``, where it is an equivalence: two positions are neighbours in
it exactly if their phrase suffixes and the parse after them agree for ``length`` bytes.  So each phrase gets two keys instead
of ranks:

* *core*: what every string that starts in this part of the phrase has in common (anchored at the phrase's closing trigger);
* *outer*: all the text that those strings cover, i.e. the phrase suffix and the parse that follows, to that depth.

A core that occurs once: nothing here repeats.  A core whose occurrences all have one outer: everything here repeats (the dictionary
entry is judged once, for all its copies).  Only cores with several outers, at the edges of repeated passages, and stretches
without triggers are resolved string by string.  Keys travel between batches as in :mod:`starframe.llm._exchange`.

Ranges answer with the states of the keys in the order in which a batch sent them, so no key travels back.  Decisions rest on 128
bits (core and outer) or 96 (two fingerprints of a string).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starframe.llm import _exchange as X
from starframe.llm import _rolling as R

_U = np.uint64
_NO = np.zeros(0, _U)
#: Bytes of a trigger, one in how many places is one, and into how many parts a phrase can be cut.
TRIGGER, EVERY, PARTS = 12, 36, 3
_SENT = "range int, batch int, keys binary, other binary, flags binary"
_TOLD = "batch int, kind int, range int, states binary"
#: What is known of a key: it occurs once, it repeats, or it repeats with several outers.
ONCE, TWICE, MIXED = 0, 1, 2
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))


class _Parse:
    """The phrases of some texts laid end to end, in up to PARTS parts by the distance from the closing trigger."""

    def __init__(self, texts: list[bytes], length: int):
        t = R.Texts(texts)
        self.texts, self.length = t, length
        self.s = [R.of_bytes(t.data, f) for f in (0, 1)]
        grams = R.windows(self.s[0], TRIGGER)
        at = np.flatnonzero(grams < _U(2**64 // EVERY))
        text = np.searchsorted(t.ends, at, side="right")
        fits = at + TRIGGER <= t.ends[text] if len(at) else np.zeros(0, bool)
        at, text = at[fits], text[fits]
        begin, end = t.starts[text], t.ends[text]
        prev = np.empty(len(at), np.int64)  # where the phrase that this trigger closes begins
        if len(at):
            prev[0] = begin[0]
            prev[1:] = np.where(text[1:] == text[:-1], at[:-1] + 1, begin[1:])
        last = length - TRIGGER  # farthest that a string can start before the trigger it holds
        low, high = np.maximum(0, at - (end - length)), np.minimum(at - prev, last)
        width = last // PARTS + 1
        found = []
        for k in range(PARTS):
            lo, hi = np.maximum(low, k * width), np.minimum(high, (k + 1) * width - 1)
            ok = lo <= hi
            a, lo, hi = at[ok], lo[ok], hi[ok]
            core = R.slices(self.s[0], a - k * width, a - (k + 1) * width + 1 + length)
            outer = R.slices(self.s[1], a - hi, a - lo + length, 1)
            outer = R.mix(outer + ((lo - k * width) * width + hi - k * width).astype(_U))
            found.append((core + _U(k), outer, a - hi, a - lo))
        self.core, self.outer, self.left, self.right = (np.concatenate(c) for c in zip(*found, strict=True))
        # Starts of strings without a trigger: between triggers that are far apart, and after the last one.
        gaps = [(p, min(a - last - 1, e - length)) for p, a, e in zip(prev.tolist(), at.tolist(), end.tolist(), strict=True) if a - last - 1 >= p]
        final = np.full(len(t.starts), -1, np.int64)
        final[text] = at
        tails = np.where(final >= 0, final + 1, t.starts)
        gaps += [(p, e) for p, e in zip(tails.tolist(), (t.ends - length).tolist(), strict=True) if e >= p]
        self.free = np.concatenate([np.zeros(0, np.int64), *(np.arange(p, e + 1) for p, e in gaps if e >= p)])

    def strings(self, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return R.slices(self.s[0], starts, starts + self.length), R.slices(self.s[1], starts, starts + self.length, 1) >> _U(32)

    def unsure(self, states: np.ndarray) -> np.ndarray:
        """The starts to look at one by one, given what is known of each part."""
        two = states == MIXED
        return np.concatenate([self.free, *(np.arange(a, b + 1) for a, b in zip(self.left[two].tolist(), self.right[two].tolist(), strict=True))])


def _rows(table: pa.Table) -> list[tuple[int, bytes]]:
    return [(k, t or b"") for k, t in enumerate(table["text"].cast(pa.large_binary()).to_pylist())]


def _merge(keys: np.ndarray, other: np.ndarray, strings: bool):
    """Sorts keys and makes equal ones one, with what is known of it in this batch.  Parts are equal if their cores are; strings
    that differ in the second fingerprint are different strings."""
    order = np.lexsort((other, keys))
    keys, other = keys[order], other[order]
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    if strings:
        new[1:] |= other[1:] != other[:-1]
    at = np.flatnonzero(new)
    size = np.diff(np.append(at, len(keys)))
    states = (size > 1).astype(np.uint8)
    states[other[at] != other[at + size - 1]] = MIXED
    return keys[at], other[at], states


def _parse(table: pa.Table, length: int) -> list[tuple[list, _Parse]]:
    rows = [(k, t or b"") for k, t in enumerate(table["text"].cast(pa.large_binary()).to_pylist())]
    return [(part, _Parse([t for _, t in part], length)) for part in R.chunks(rows)]


def _all(arrays: list[np.ndarray], kind=_U) -> np.ndarray:
    return np.concatenate(arrays) if arrays else np.zeros(0, kind)


def _send(batch: int, bits: int, keys: np.ndarray, other: np.ndarray, states: np.ndarray, width: int) -> pa.Table:
    """One row for each range; ``width``: bytes of the second value."""
    other = other.astype(f"<u{width}")
    out = [(r, batch, X.pack(keys[a:b]), other[a:b].tobytes(), states[a:b].tobytes()) for r, a, b in X.ranges(keys, bits)]
    cols = zip(*out, strict=True) if out else [[]] * 5
    return pa.table([pa.array(list(c), t) for c, t in zip(cols, (pa.int32(), pa.int32(), *[pa.binary()] * 3), strict=True)], names=["range", "batch", "keys", "other", "flags"])


def _send_parts(length: int, bits: int):
    def send(table: pa.Table) -> pa.Table:
        parsed = _parse(table, length)
        return _send(table["batch"][0].as_py(), bits, *_merge(_all([p.core for _, p in parsed]), _all([p.outer for _, p in parsed]), False), 8)

    return send


def _decide(strings: bool):
    """For a range: tells each batch what is known of each of the keys it sent, in their order."""
    width = 4 if strings else 8

    def decide(table: pa.Table) -> pa.Table:
        sent = [X.unpack(b) for b in table["keys"].to_pylist()]
        keys = np.concatenate(sent)
        other = np.concatenate([np.frombuffer(b, f"<u{width}") for b in table["other"].to_pylist()])
        flags = np.concatenate([np.frombuffer(b, np.uint8) for b in table["flags"].to_pylist()])
        order = np.lexsort((other, keys))
        keys, other, flags = keys[order], other[order], flags[order]
        new = np.ones(len(keys), bool)
        new[1:] = keys[1:] != keys[:-1]
        if strings:
            new[1:] |= other[1:] != other[:-1]
        at = np.flatnonzero(new)
        size = np.diff(np.append(at, len(keys)))
        worst = np.maximum.reduceat(flags, at)
        state = np.maximum(worst, size > 1).astype(np.uint8)
        state[other[at] != other[at + size - 1]] = MIXED
        states = np.empty(len(keys), np.uint8)
        states[order] = np.repeat(state, size)
        ends = np.cumsum([len(k) for k in sent])
        told = [states[e - len(k) : e].tobytes() for k, e in zip(sent, ends.tolist(), strict=True)]
        return pa.table([table["batch"].cast(pa.int32()), pa.array([int(strings)] * len(told), pa.int32()), table["range"].cast(pa.int32()), pa.array(told, pa.binary())], names=["batch", "kind", "range", "states"])

    return decide


def _told(table: pa.Table, kind: int) -> np.ndarray:
    """What is known of the batch's sorted keys: rows come by range, ranges in the order of the keys."""
    rows = sorted((r, s) for k, r, s in zip(table["kind"].to_pylist(), table["range"].to_pylist(), table["states"].to_pylist(), strict=True) if k == kind)
    return _all([np.frombuffer(s, np.uint8) for _, s in rows], np.uint8)


def _known_parts(parsed, told: pa.Table) -> list[np.ndarray]:
    """The states of the parts of each chunk."""
    states, cores = _told(told, 0), np.unique(_all([p.core for _, p in parsed]))
    return [states[np.searchsorted(cores, p.core)] for _, p in parsed]


def _send_strings(length: int, bits: int):
    def send(docs: pa.Table, told: pa.Table) -> pa.Table:
        parsed = _parse(docs, length)
        found = [p.strings(p.unsure(s)) for (_, p), s in zip(parsed, _known_parts(parsed, told), strict=True)]
        return _send(docs["batch"][0].as_py(), bits, *_merge(_all([k for k, _ in found]), _all([o for _, o in found]), True), 4)

    return send


def _cut(length: int):
    def cut(docs: pa.Table, told: pa.Table) -> pa.Table:
        parsed = _parse(docs, length)
        known = _known_parts(parsed, told)
        starts = [p.unsure(s) for (_, p), s in zip(parsed, known, strict=True)]
        found = [p.strings(s) for (_, p), s in zip(parsed, starts, strict=True)]
        # The batch's strings in the order in which it sent them, and which of them repeat.
        keys, other = _all([k for k, _ in found]), _all([o for _, o in found])
        order = np.lexsort((other, keys))
        new = np.ones(len(keys), bool)
        new[1:] = (keys[order][1:] != keys[order][:-1]) | (other[order][1:] != other[order][:-1])
        twice = np.empty(len(keys), bool)
        twice[order] = (_told(told, 1) != ONCE)[np.cumsum(new) - 1] if len(keys) else False
        out, done = [], 0
        for (part, p), state, at in zip(parsed, known, starts, strict=True):
            again = at[twice[done : done + len(at)]]
            done += len(at)
            whole = state == TWICE
            step = np.zeros(len(p.texts.data) + 1, np.int32)
            np.add.at(step, np.concatenate([p.left[whole], again]), 1)
            np.add.at(step, np.concatenate([p.right[whole], again]) + length, -1)
            gone = np.cumsum(step)[:-1] > 0
            for n, (_, text) in enumerate(part):
                own = gone[p.texts.starts[n] : p.texts.ends[n]]
                edge = np.flatnonzero(np.diff(np.concatenate([[False], own, [False]]))).tolist()
                spans = [{"start": s, "stop": e} for s, e in zip(edge[::2], edge[1::2], strict=True)]
                kept = b"".join(text[s:e] for s, e in zip([0, *edge[1::2]], [*edge[::2], len(text)], strict=True))
                out.append((len(text), len(text) - len(kept), spans, kept))
        cols = list(zip(*out, strict=True)) if out else [[]] * 4
        kinds = (pa.int64(), pa.int64(), _SPANS, pa.binary())
        return pa.table([docs["doc_id"], *(pa.array(list(c), t) for c, t in zip(cols, kinds, strict=True))], names=["doc_id", "n_bytes", "n_removed", "spans", "kept"])

    return cut


def suffix_dedup(docs: DataFrame, length: int = 200, batch_bytes: int = X.BATCH_BYTES) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_bytes, n_removed, spans (maximal removed runs of bytes), kept (binary).

    A byte goes if it is covered by a string of ``length`` bytes (at least 64) that also starts anywhere else, in this document
    or another; strings lie within one document and are judged on the input, so every copy of a passage goes, the first too.
    A null text counts as empty; shorter texts lose nothing.  Rows that share a doc_id are separate texts.  Other columns are
    ignored; an empty table gives no rows.
    """
    if length < 64:
        raise ValueError("length must be 64 at least")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    total = X.text_bytes(docs)
    # The same dealt rows are used three times below; Spark reuses their exchange.
    dealt = docs.withColumn("batch", X.by_hash(X.batches_for(total, batch_bytes), "doc_id", "text"))
    parts = dealt.groupBy("batch").applyInArrow(_send_parts(length, X.range_bits(total / EVERY * 1.1)), _SENT)
    told = parts.groupBy("range").applyInArrow(_decide(False), _TOLD)
    strings = dealt.groupBy("batch").cogroup(told.groupBy("batch")).applyInArrow(_send_strings(length, X.range_bits(total / 8)), _SENT)
    again = strings.groupBy("range").applyInArrow(_decide(True), _TOLD)
    return dealt.groupBy("batch").cogroup(told.unionByName(again).groupBy("batch")).applyInArrow(
        _cut(length), "doc_id long, n_bytes long, n_removed long, spans array<struct<start:long,stop:long>>, kept binary"
    )
