"""Batches of documents, and the exchange of sorted fingerprints between batches.

Text is dealt once, in batches of whole documents (a few megabytes each).  Fingerprints go the other way: each batch sends, to
each range of the fingerprint space, the distinct values it holds, sorted and delta coded; so however often a string repeats,
a batch sends it once, and no range gets more than one entry from a batch.  What a range decides goes back to the batches it
came from.  A hot string is thus spread by construction: it costs one entry per batch that holds it.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Text in a batch; memory for a batch in a task is about ten times that.
BATCH_BYTES = 4 << 20
#: Fingerprints in a range; sorting a range takes about 40 bytes for each.
RANGE_KEYS = 2_000_000


def text_bytes(docs: DataFrame) -> int:
    return docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0


def batches_for(total: int, batch_bytes: int = BATCH_BYTES) -> int:
    return max(1, math.ceil(total / batch_bytes))


def range_bits(keys: float, range_keys: int = RANGE_KEYS) -> int:
    """Leading bits of a fingerprint that name its range."""
    return max(3, math.ceil(math.log2(max(1.0, keys / range_keys))))


def by_hash(n: int, *cols: str) -> Column:
    return F.pmod(F.xxhash64(*cols), F.lit(n)).cast("int")


def by_order(docs: DataFrame, n: int, column: str = "doc_id") -> DataFrame:
    """Adds ``batch``: equal shares of the documents in the order of an integer column, equal values together, nulls first.

    The limits between batches (8 bytes each) are approximate quantiles; exactly where they lie does not change a result.
    """
    from pyspark.ml.feature import Bucketizer

    key = F.coalesce(F.col(column).cast("double"), F.lit(-1.7e308))
    cuts: list[float] = []
    if n > 1:
        shares = [i / n for i in range(1, n)]
        found = docs.agg(F.percentile_approx(key, shares, max(10_000, 4 * n))).first()[0]
        cuts = sorted(set(found or []))
    splits = [-math.inf, *(c for c in cuts if math.isfinite(c)), math.inf]
    keyed = docs.withColumn("_key", key)
    if len(splits) < 3:
        return keyed.withColumn("batch", F.lit(0)).drop("_key")
    out = Bucketizer(splits=splits, inputCol="_key", outputCol="_batch").transform(keyed)
    return out.withColumn("batch", F.col("_batch").cast("int")).drop("_key", "_batch")


def pack(keys: np.ndarray) -> bytes:
    """Sorted uint64 values as the first one and the bytes of the differences, as few for each as the largest needs."""
    if not len(keys):
        return b""
    steps = np.diff(keys)
    width = max(1, (int(steps.max()).bit_length() + 7) // 8) if len(steps) else 1
    return bytes([width]) + keys[:1].tobytes() + np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def unpack(blob: bytes) -> np.ndarray:
    if not blob:
        return np.zeros(0, np.uint64)
    width, first = blob[0], np.frombuffer(blob, np.uint64, 1, 1)
    body = np.frombuffer(blob, np.uint8, offset=9).reshape(-1, width)
    steps = np.zeros((len(body), 8), np.uint8)
    steps[:, :width] = body
    out = np.empty(len(body) + 1, np.uint64)
    out[0] = first[0]
    np.cumsum(steps.view(np.uint64).ravel(), out=out[1:])
    out[1:] += first[0]
    return out


def ranges(keys: np.ndarray, bits: int):
    """Slices of sorted keys that have the same leading bits: (range, start, stop)."""
    if not len(keys):
        return
    top = (keys >> np.uint64(64 - bits)).astype(np.int64)
    edges = np.flatnonzero(np.diff(top)) + 1
    for a, b in zip(np.append(0, edges), np.append(edges, len(keys)), strict=True):
        yield int(top[a]), int(a), int(b)

