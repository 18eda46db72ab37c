"""Best-fit packing (9): tokenised documents into sequences of bounded size, by vector best fit.

A sequence has three capacities: tokens, documents, and attention cost (the sum of squared lengths).  Pieces go in order of
falling length; each into the open sequence that fits under every capacity and scores best, by the weighted norm of what would
be left of the capacities (``norm``) or the weighted dot product of need and rest (``dot``).

Pieces of one length are alike, so the choice is made once for each length: the driver sees the number of pieces by length
(2048 numbers at most, whatever the corpus) and returns *slots*: "the next n pieces of length L go to sequences from s on, at
offset o".  Spark numbers the pieces within each length and looks their slots up, so no task or group holds them all.
"""

from __future__ import annotations

import json
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starframe.llm._shared import cut

_ENCODERS: dict = {}


def encoder(path: str):
    """A byte-level BPE in the JSON format of ``tokenizers``; the ids are those of that library, the merging is tiktoken's."""
    if path not in _ENCODERS:
        import public_tokenizers
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        # The byte-level alphabet: printable bytes stand for themselves, the others are shifted past 255.
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        letters = {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(b for b in range(256) if b not in plain)}
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(letters[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
        _ENCODERS[path] = tiktoken.Encoding("bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
    return _ENCODERS[path]


def _pieces(path: str, capacity: int, end: int, with_ids: bool):
    def cut_up(tables):
        from pyspark import TaskContext

        encode = encoder(path).encode_to_numpy
        part = TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for table in tables:
            row, piece, start, length, crc, rank, ids = [], [], [], [], [], [], []
            for n, text in enumerate(table.column("text").to_pylist()):
                tokens = np.append(encode(text, allowed_special="all") if text else np.zeros(0, np.uint32), end).astype("<u4")
                first = len(tokens) % capacity or capacity
                cuts = [0, *range(first, len(tokens) + 1, capacity)]
                for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    row.append(n)
                    piece.append(k)
                    start.append(a)
                    length.append(b - a)
                    crc.append(zlib.crc32(tokens[a:b].tobytes()))
                    rank.append(int(seen[b - a]))
                    seen[b - a] += 1
                    if with_ids:
                        ids.append(tokens[a:b].astype(np.int64))
            out = [table.column("doc_id").take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array([part] * len(row), pa.int32()), pa.array(rank, pa.int64())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "rank"]
            if with_ids:
                out.append(pa.array(ids, pa.list_(pa.int64())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in out], names=names)

    return cut_up


def slots(counts: dict[int, int], capacity: int, max_docs: int, max_cost: float, weights: tuple[float, float, float] = (1.0, 0.1, 0.1), score: str = "norm") -> list[tuple[int, int, int, int, int, int]]:
    """Slots (length, first rank, pieces, first sequence, pieces in each sequence, offset) for so many pieces of each length."""
    cap, w = np.array([capacity, max_docs, max_cost], float), np.array(weights, float)
    # An open state: sequences with the same content. bins: how many; used: tokens, documents, cost; node: the slot that made it.
    rest = np.zeros((0, 3))
    bins: list[int] = []
    node: list[int] = []
    made: list[dict] = []  # slots with their parent: sequences of a slot are a part of its parent's

    def put(length: int, rank: int, n: int, q: int, parent: int, left: np.ndarray) -> None:
        """n sequences get q pieces each."""
        nonlocal rest
        made.append({"length": length, "rank": rank, "n": n, "q": q, "parent": parent, "offset": int(round(capacity - left[0]))})
        rest = np.vstack([rest, left - q * np.array([length, 1, float(length) ** 2])])
        bins.append(n)
        node.append(len(made) - 1)

    for length in sorted(counts, reverse=True):
        need, todo, rank = np.array([length, 1, float(length) ** 2]), counts[length], 0
        if np.any(need > cap):
            raise ValueError(f"a piece of {length} tokens exceeds a capacity")
        while todo:
            fits = np.flatnonzero((np.array(bins, dtype=float) > 0) & np.all(rest >= need, axis=1)) if bins else []
            if len(fits):
                scaled, ask = rest[fits] / cap, need / cap
                value = -(w * (scaled - ask) ** 2).sum(1) if score == "norm" else (w * scaled * ask).sum(1)
                at = int(fits[np.argmax(value)])
                left, have, parent = rest[at], bins[at], node[at]
            else:
                at, left, have, parent = -1, cap.copy(), todo, -1
            q = int(min(todo, np.floor((left / need).min())))
            n = min(have, todo // q)
            put(length, rank, n, q, parent, left)
            if at >= 0:
                bins[at] -= n
            todo, rank = todo - n * q, rank + n * q
        keep = [k for k, b in enumerate(bins) if b and rest[k][0] >= 1 and rest[k][1] >= 1]
        rest, bins, node = rest[keep], [bins[k] for k in keep], [node[k] for k in keep]
    # Numbers: a slot's sequences are the next ones of its parent's that no earlier child took; new sequences come at the end.
    base, taken, total = [0] * len(made), [0] * len(made), 0
    for k, s in enumerate(made):
        if s["parent"] < 0:
            base[k], total = total, total + s["n"]
        else:
            base[k] = base[s["parent"]] + taken[s["parent"]]
            taken[s["parent"]] += s["n"]
    return [(s["length"], s["rank"], s["n"] * s["q"], base[k], s["q"], s["offset"]) for k, s in enumerate(made)]


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = 2048, max_docs: int | None = None, max_cost: float | None = None, end: int = 0, score: str = "norm", with_ids: bool = False) -> DataFrame:
    """Per piece of ``docs`` (doc_id, text): doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids).

    A document's tokens end in the id ``end``; one longer than ``capacity`` is cut into pieces of that size, the first of
    which may be shorter.  ``max_docs`` and ``max_cost`` bound the pieces and the attention cost of a sequence; their defaults
    (capacity, and its square) follow from the tokens.  A null or empty text is the id ``end`` alone; repeated rows are packed
    each; other columns are ignored; an empty table gives no rows.
    """
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    kind = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, rank long" + ", ids array<long>" * with_ids
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    pieces = cut(docs.mapInArrow(_pieces(tokenizer, capacity, end, with_ids), kind))
    # Pieces of a length that earlier partitions hold, as a running sum: as many rows as partitions for each length.
    from pyspark.sql import Window

    by_part = cut(pieces.groupBy("length", "part").agg(F.count("*").alias("n")))
    before = by_part.select("length", "part", (F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).alias("before"))
    counts = {r["length"]: r["n"] for r in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    found = slots(counts, capacity, max_docs or capacity, max_cost or float(capacity) ** 2, score=score)
    table = docs.sparkSession.createDataFrame(found or [(0, 0, 0, 0, 1, 0)], "length long, first long, pieces long, sequence long, each long, at long")
    ranked = pieces.join(before, ["length", "part"]).withColumn("rank", F.col("rank") + F.col("before"))
    # The slots' number is bounded by the capacity, not by the corpus, so they can be broadcast.
    hit = ranked.join(F.broadcast(table), (ranked["length"] == table["length"]) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("first") + F.col("pieces"))).drop(table["length"])
    nth = F.col("rank") - F.col("first")
    return hit.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("sequence") + F.floor(nth / F.col("each"))).cast("long").alias("sequence_id"),
        (F.col("at") + F.pmod(nth, F.col("each")) * F.col("length")).cast("long").alias("offset"),
        *(["ids"] if with_ids else []),
    )
