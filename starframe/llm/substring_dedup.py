"""Substring dedup (4): Rabin-Karp fingerprints of every fixed-length word window, counted over the corpus.

A word goes if a window that covers it also starts in a document with a smaller id.  Windows are judged on the input.

How it runs: batches of documents follow the order of the ids, so "in a smaller document" is "in an earlier batch, or earlier
in this one".  Every batch sends its distinct window fingerprints to their ranges; a range finds the first batch of each and
reports back to the later ones; a batch then cuts its documents.  Text is shuffled once (both uses share that exchange).

Fingerprints have 64 bits: among N different windows about N*N/2**65 pairs are expected to collide (0.0006 at 150 million).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starframe.llm import _exchange as X
from starframe.llm import _rolling as R

_LEAST = -(2**63)
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))


def _read(table: pa.Table) -> list[tuple[int, int, bytes]]:
    """(doc_id, row, text) in the order of the ids, nulls first."""
    ids = table["doc_id"].to_pylist()
    texts = table["text"].cast(pa.large_binary()).to_pylist()
    rows = [(_LEAST if d is None else d, k, t or b"") for k, (d, t) in enumerate(zip(ids, texts, strict=True))]
    return sorted(rows, key=lambda r: r[0])


def _windows(part: list[tuple[int, int, bytes]], size: int):
    """Words of some texts; for each window its first word and fingerprint."""
    words = R.Words(R.Texts([r[-1] for r in part]))
    keys = R.windows(R.prefix(words.hash), size)
    inside = words.text[: len(keys)] == words.text[size - 1 :][: len(keys)]
    at = np.flatnonzero(inside)
    return words, at, keys[at]


def _send(size: int, bits: int):
    def send(table: pa.Table) -> pa.Table:
        batch = table["batch"][0].as_py()
        keys = np.unique(np.concatenate([np.zeros(0, np.uint64), *(np.unique(_windows(p, size)[2]) for p in R.chunks(_read(table)))]))
        out = [(r, batch, X.pack(keys[a:b])) for r, a, b in X.ranges(keys, bits)]
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else ([], [], []), (pa.int32(), pa.int32(), pa.binary()), strict=True)], names=["range", "batch", "keys"])

    return send


def _first(table: pa.Table) -> pa.Table:
    """Tells each batch which of the keys it sent, in their order, an earlier batch has (bits)."""
    sent = [X.unpack(b) for b in table["keys"].to_pylist()]
    keys = np.concatenate(sent)
    source = np.repeat(table["batch"].to_numpy(), [len(k) for k in sent])
    order = np.lexsort((source, keys))
    later = np.zeros(len(keys), bool)
    # Equal keys come in the order of their batches, each batch once.
    later[order[1:]] = keys[order[1:]] == keys[order[:-1]]
    ends = np.cumsum([len(k) for k in sent])
    told = [np.packbits(later[e - len(k) : e]).tobytes() for k, e in zip(sent, ends.tolist(), strict=True)]
    return pa.table([table["batch"].cast(pa.int32()), table["range"].cast(pa.int32()), pa.array([len(k) for k in sent], pa.int32()), pa.array(told, pa.binary())], names=["batch", "range", "n", "later"])


def _cut(size: int):
    def cut(docs: pa.Table, seen: pa.Table) -> pa.Table:
        told = sorted(zip(seen["range"].to_pylist(), seen["n"].to_pylist(), seen["later"].to_pylist(), strict=True))
        later = np.concatenate([np.zeros(0, np.uint8), *(np.unpackbits(np.frombuffer(b, np.uint8), count=n) for _, n, b in told)]).astype(bool)
        rows = _read(docs)
        # The smallest id of each key in this batch: rows are in the order of ids, so the first one to come.
        parts, number, base = [], [np.zeros(0, np.int64)], 0
        for p in R.chunks(rows):
            words, at, keys = _windows(p, size)
            parts.append((p, words, at, keys))
            number.append(words.text[at] + base)
            base += len(p)
        all_keys = np.concatenate([np.zeros(0, np.uint64), *(k for *_, k in parts)])
        number = np.concatenate(number)
        uniq, first = np.unique(all_keys, return_index=True)
        ids = np.array([r[0] for r in rows], np.int64)
        least = ids[number[first]] if len(first) else ids[:0]
        # ``later`` follows the distinct keys in their order, as they were sent.
        at = np.searchsorted(uniq, all_keys)
        hit = later[at] | (least[at] < ids[number]) if len(uniq) else np.zeros(0, bool)
        out: list[tuple] = [()] * len(rows)
        done = 0
        for p, words, at, keys in parts:
            mine = hit[done : done + len(keys)]
            done += len(keys)
            step = np.zeros(len(words.start) + size + 1, np.int32)
            np.add.at(step, at[mine], 1)
            np.add.at(step, at[mine] + size, -1)
            gone = np.cumsum(step)[: len(words.start)] > 0
            begin = 0
            for n, row in enumerate(p):
                a, b = words.first[n], words.first[n + 1]
                text, own = row[-1], gone[a:b]
                removed = int(own.sum())
                edge = np.flatnonzero(np.diff(np.concatenate([[False], own, [False]])))
                spans = [{"start": int(s), "stop": int(e)} for s, e in zip(edge[::2], edge[1::2], strict=True)]
                kept = b" ".join(text[s:e] for s, e in zip((words.start[a:b][~own] - begin).tolist(), (words.stop[a:b][~own] - begin).tolist(), strict=True)) if removed else b" ".join(text.split())
                out[row[1]] = (int(b - a), removed, spans, kept.decode("utf-8", "replace"))
                begin += len(text)
        cols = list(zip(*out, strict=True)) if out else [[], [], [], []]
        kinds = (pa.int64(), pa.int64(), _SPANS, pa.string())
        return pa.table([docs["doc_id"].cast(pa.int64()), *(pa.array(list(c), t) for c, t in zip(cols, kinds, strict=True))], names=["doc_id", "n_words", "n_removed", "spans", "kept_text"])

    return cut


def substring_dedup(docs: DataFrame, window: int = 13, batch_bytes: int = X.BATCH_BYTES) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_words, n_removed, spans (maximal removed runs of words), kept_text.

    Words are ``[^\\x20\\x09-\\x0D]+``; kept words are joined by one space.  A null or empty text has no words.  Rows that share
    a doc_id are one document and take nothing from each other; a null doc_id counts as the smallest.  Other columns are
    ignored; an empty table gives no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    total = X.text_bytes(docs)
    # The same dealt rows are used twice below; Spark reuses their exchange.
    dealt = X.by_order(docs, X.batches_for(total, batch_bytes))
    bits = X.range_bits(total / 6)
    sent = dealt.groupBy("batch").applyInArrow(_send(window, bits), "range int, batch int, keys binary")
    seen = sent.groupBy("range").applyInArrow(_first, "batch int, range int, n int, later binary")
    return dealt.groupBy("batch").cogroup(seen.groupBy("batch")).applyInArrow(
        _cut(window), "doc_id long, n_words long, n_removed long, spans array<struct<start:long,stop:long>>, kept_text string"
    )
