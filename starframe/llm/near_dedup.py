"""MinHash near-dedup (3) with DartMinHash signatures (Christiani 2020), banded joining and exact verification.

Elements are five-word shingles with weights.  Hashed darts are thrown at the plane (weight, rank) of each element, in regions of
area one, so a region gets a Poisson(1) number of them; a dart counts if it lies below the element's weight, and each of the k
coordinates of a signature keeps its dart of least rank.  Two weighted sets agree in a coordinate with a probability equal to
their weighted Jaccard similarity.  Only ranks up to about (k ln k + 2k) / (total weight) are thrown at, so a signature takes time
linear in the elements plus k log k.

Equal texts are one node.  Nodes that agree in a band meet in a bucket; chains of buckets make clusters, within which every pair
is decided by exact similarity, so no link between members of a bucket is lost.  Pairs are never rows: the members of small
clusters come in bundles of some hundred texts, those of a larger cluster in pairs of its blocks, and a bundle counts common
shingles through an inverted index and returns a spanning forest of its links.  So a task holds a bounded number of texts however
large a cluster is.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starframe.llm import _rolling as R
from starframe.llm._components import components
from starframe.llm._shared import cut

_U = np.uint64
#: P(Poisson(1) > n) for n = 0, 1, ...: as limits on 64 bits.
_POISSON = np.array([int((1 - sum(math.exp(-1) / math.factorial(i) for i in range(n + 1))) * 2.0**64) for n in range(12)], dtype=np.uint64)


def _salt(*parts) -> np.ndarray:
    """Mixes integers or arrays into one hash."""
    out = R.mix(np.asarray(parts[0], _U).reshape(-1).copy())
    for k, p in enumerate(parts[1:], 1):
        out = R.mix(out + np.asarray(p).astype(_U) * _U(0x9E3779B97F4A7C15 + 2 * k * 0x1000193))
    return out


def _unit(h: np.ndarray) -> np.ndarray:
    return (h >> _U(11)).astype(np.float64) * 2.0**-53


def signatures(elements: np.ndarray, owner: np.ndarray, weights: np.ndarray, owners: int, k: int) -> np.ndarray:
    """DartMinHash signatures (owners by k) of weighted sets: element hashes, which set each belongs to, and its weight there.

    A set without elements gets zeros.
    """
    sig, best = np.zeros((owners, k), _U), np.full((owners, k), np.inf)
    mass = np.bincount(owner, weights, owners)
    limit = np.where(mass > 0, (k * math.log(k) + 2 * k) / np.maximum(mass, 1e-300), 0.0)
    open_ = mass > 0
    while open_.any():
        use = open_[owner]
        e, o, w = elements[use], owner[use], weights[use]
        band = 0
        while len(e):
            # Weights from 2**band - 1 on, in cells of height 2**-band: area one each.
            height = 2.0**-band
            cells = np.ceil(limit[o] / height).astype(np.int64)
            at = np.repeat(np.arange(len(e)), cells)
            cell = np.arange(len(at)) - np.repeat(np.cumsum(cells) - cells, cells)
            seed = _salt(e[at], cell, np.full(len(at), band))
            n = len(_POISSON) - np.searchsorted(_POISSON[::-1], R.mix(seed + _U(1)), side="left")
            which = np.repeat(np.arange(len(at)), n)
            dart = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
            h = _salt(seed[which], dart)
            rank = (cell[which] + _unit(R.mix(h + _U(3)))) * height
            weight = 2.0**band - 1 + _unit(R.mix(h + _U(5))) * 2.0**band
            own = o[at[which]]
            hit = (weight < w[at[which]]) & (rank < limit[own])
            h, rank, own = h[hit], rank[hit], own[hit]
            order = np.argsort(-rank, kind="stable")  # the last to be assigned is the least
            slot = own[order] * k + (R.mix(h[order] + _U(7)) % _U(k)).astype(np.int64)
            new_best, new_sig = np.full(owners * k, np.inf), np.zeros(owners * k, _U)
            new_best[slot], new_sig[slot] = rank[order], h[order]
            less = new_best.reshape(owners, k) < best
            best[less], sig[less] = new_best.reshape(owners, k)[less], new_sig.reshape(owners, k)[less]
            band += 1
            more = w > 2.0**band - 1
            e, o, w = e[more], o[more], w[more]
        open_ = open_ & np.isinf(best).any(1)
        limit = limit * 2
    return sig


def shingles(texts: list[bytes], size: int = 5):
    """Fingerprints of the shingles of each text and the text's number; a text of fewer words than ``size`` is one shingle."""
    words = R.Words(R.Texts(texts))
    s = R.prefix(words.hash)
    keys = R.windows(s, size)
    inside = words.text[: len(keys)] == words.text[size - 1 :][: len(keys)]
    count = np.diff(words.first)
    short = np.flatnonzero((count > 0) & (count < size))
    extra = R.slices(s, words.first[short], words.first[short + 1])
    return np.concatenate([keys[inside], extra]), np.concatenate([words.text[: len(keys)][inside], short])


def _sign(k: int, rows: int, size: int, weighted: bool):
    def sign(tables):
        for table in tables:
            texts = [(n, t or b"") for n, t in enumerate(table.column("text").cast(pa.large_binary()).to_pylist())]
            bands: list = [None] * len(texts)
            for part in R.chunks(texts, 1 << 19):
                e, o = shingles([t for _, t in part], size)
                order = np.lexsort((e, o))
                e, o = e[order], o[order]
                new = np.ones(len(e), bool)
                new[1:] = (e[1:] != e[:-1]) | (o[1:] != o[:-1])
                at = np.flatnonzero(new)
                w = np.diff(np.append(at, len(e))).astype(float) if weighted else np.ones(len(at))
                sig = signatures(e[at], o[at], w, len(part), k)
                some = np.bincount(o, minlength=len(part)) > 0
                for b in range(k // rows):
                    sig[:, b] = _salt(sig[:, b * rows], *(sig[:, b * rows + j] for j in range(1, rows)), np.full(len(part), b))
                for (n, _), own, ok in zip(part, sig[:, : k // rows].view(np.int64), some, strict=True):
                    bands[n] = own if ok else None
            own = [table.column(c) for c in table.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*own, pa.array(bands, pa.list_(pa.int64()))], names=[*(c for c in table.schema.names if c != "text"), "bands"])

    return sign


def _sets(texts: list[bytes], size: int, weighted: bool):
    """Distinct elements of each text and their owners; weighted: the n-th occurrence of a shingle is an element of its own."""
    e, o = shingles(texts, size)
    order = np.lexsort((e, o))
    e, o = e[order], o[order]
    new = np.ones(len(e), bool)
    new[1:] = (e[1:] != e[:-1]) | (o[1:] != o[:-1])
    if not weighted:
        return e[new], o[new]
    at = np.flatnonzero(new)
    return _salt(e, np.arange(len(e)) - np.repeat(at, np.diff(np.append(at, len(e))))), o


def _link(size: int, weighted: bool, similarity: float):
    """The links of a bundle of texts, as a spanning forest: (a, b) with b the least node of a tree."""

    def link(table: pa.Table) -> pa.Table:
        nodes, first = np.unique(np.array(table["node"].to_pylist(), dtype=object), return_index=True)
        texts = table["text"].cast(pa.large_binary())
        texts = [texts[int(k)].as_py() or b"" for k in first]
        found = [_sets([t for _, t in part], size, weighted) for part in R.chunks(list(enumerate(texts)))]
        base = np.cumsum([0, *(len(part) for part in R.chunks(list(enumerate(texts))))])
        e, o = np.concatenate([x for x, _ in found]), np.concatenate([x + b for (_, x), b in zip(found, base, strict=False)])
        count = np.bincount(o, minlength=len(nodes))
        # An inverted index of the elements that several texts share.
        _, code, often = np.unique(e, return_inverse=True, return_counts=True)
        keep = often[code] > 1
        code, o = code[keep], o[keep]
        by_text = np.argsort(o, kind="stable")
        own, ends = code[by_text], np.cumsum(np.bincount(o, minlength=len(nodes)))
        by_code = np.argsort(code, kind="stable")
        owners, stop = o[by_code], np.cumsum(np.bincount(code, minlength=len(often)))
        start = stop - np.bincount(code, minlength=len(often))
        parent = list(range(len(nodes)))

        def find(x: int) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for x in range(len(nodes)):
            mine = own[ends[x - 1] if x else 0 : ends[x]]
            if not len(mine):
                continue
            n = stop[mine] - start[mine]
            at = np.arange(n.sum()) + np.repeat(start[mine] - (np.cumsum(n) - n), n)
            common = np.bincount(owners[at], minlength=len(nodes))
            near = common >= (similarity - 1e-12) * (count[x] + count - common)
            near &= common > 0
            for y in np.flatnonzero(near[:x]).tolist():
                p, q = find(x), find(y)
                parent[max(p, q)] = min(p, q)
        pairs = [(k, find(k)) for k in range(len(nodes))]
        pairs = [(nodes[k], nodes[p]) for k, p in pairs if k != p]
        return pa.table([pa.array([a for a, _ in pairs], pa.binary()), pa.array([b for _, b in pairs], pa.binary())], names=["a", "b"])

    return link


#: Texts in a bundle, and bytes of text; below this many bytes a table whose size was counted is broadcast.
BUNDLE, BUNDLE_BYTES, BROADCAST_BYTES = 400, 8 << 20, 32 << 20


def near_dups(docs: DataFrame, similarity: float = 0.8, size: int = 5, k: int = 168, rows: int = 6, weighted: bool = False) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, node (the text's digest), class_id, class_size, is_first.

    Documents belong to one class if a chain of links joins them: a link is an equal text, or Jaccard similarity of word shingles
    (``size`` words ``[^\\x20\\x09-\\x0D]+``) of ``similarity`` at least.  With ``weighted`` shingles count as often as they occur,
    in signatures and in the comparison.  class_id is the least doc_id of the class, class_size its number of rows; is_first marks
    the rows of the class that hold the least doc_id's first text (by digest).  Texts that are null or without words make a class
    each by doc_id.  With k = 168 and 6 rows a band, a pair at similarity 0.8 shares a bucket with probability 0.9998.
    Repeated rows are in the class of their text; other columns are ignored; an empty table gives no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    keyed = docs.withColumns({"node": F.unhex(F.md5("text")), "id": F.xxhash64("text"), "size": F.octet_length("text")})
    signed = cut(keyed.mapInArrow(_sign(k, rows, size, weighted), "doc_id long, node binary, id long, size int, bands array<long>"))
    # Clusters: chains of buckets, on short ids (two texts of one id would only share a cluster).
    nodes = signed.where("bands is not null").groupBy("id").agg(F.first("bands").alias("bands"))
    key = nodes.select("id", F.posexplode("bands").alias("band", "value")).select("id", F.xxhash64("band", "value").alias("bucket"))
    least = key.groupBy("bucket").agg(F.min("id").alias("least"), F.max("id").alias("most")).where("least <> most").select("bucket", "least")
    clusters = components(key.join(least, "bucket").where("id <> least").select(F.col("id").alias("a"), F.col("least").alias("b")).distinct())
    # One row of each text of a cluster, and where it is compared.
    chosen = signed.where("bands is not null").groupBy("id", "node").agg(F.min("doc_id").alias("doc_id"), F.first("size").alias("size")).join(clusters.select(F.col("node").alias("id"), F.col("root").alias("cluster")), "id")
    chosen = cut(chosen)
    n, total = chosen.agg(F.count("*"), F.sum("size")).first()
    sizes = chosen.groupBy("cluster").agg(F.greatest(F.ceil(F.count("*") / BUNDLE), F.ceil(F.sum("size") / BUNDLE_BYTES)).alias("blocks"))
    bundles = max(1, math.ceil(n / BUNDLE), math.ceil((total or 0) / BUNDLE_BYTES))
    placed = chosen.join(sizes, "cluster").withColumn("block", F.pmod(F.xxhash64("id", F.lit(3)), F.col("blocks")))
    pair = F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda j: F.struct(F.least(j, F.col("block")).alias("i"), F.greatest(j, F.col("block")).alias("j")))
    # A cluster of one block shares a bundle with others; the pairs of blocks of a larger one are bundles of their own.
    bundle = F.when(F.col("blocks") == 1, F.array(F.pmod(F.xxhash64("cluster"), F.lit(bundles)))).otherwise(F.transform(pair, lambda p: F.xxhash64("cluster", p["i"], p["j"])))
    placed = placed.select("id", "node", "doc_id", bundle.alias("bundles"))
    # A row has its keys and a number for each bundle: as many as its cluster has blocks.
    placed = cut(placed)
    held = placed.agg(F.sum(64 + 8 * F.size("bundles"))).first()[0] or 0
    placed = F.broadcast(placed) if held < BROADCAST_BYTES else placed
    same = (keyed["id"] == placed["id"]) & (keyed["node"] == placed["node"]) & keyed["doc_id"].eqNullSafe(placed["doc_id"])
    texts = keyed.join(placed, same).select(keyed["node"], keyed["text"], F.explode("bundles").alias("bundle"))
    root = components(texts.groupBy("bundle").applyInArrow(_link(size, weighted, similarity), "a binary, b binary"))
    own = signed.join(root, "node", "left").withColumn("class", F.when(F.col("bands").isNotNull(), F.coalesce("root", "node")))
    by = own.where("class is not null").groupBy("class").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("class_size"), F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "node")).alias("f"))
    # Only classes of several rows are looked up; where they fit, the rows of a large class are not brought together for that.
    by = cut(by.where("class_size > 1"))
    by = F.broadcast(by) if by.count() * 80 < BROADCAST_BYTES else by
    single = F.col("class_size").isNull()
    first = single | (F.col("doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("node") == F.col("f.node")))
    out = own.where("class is not null").join(by, "class", "left").select("doc_id", "node", F.when(single, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size"), first.alias("is_first"))
    alone = own.where("class is null").select("doc_id", "node", F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("class_size"), F.lit(True).alias("is_first"))
    return out.unionByName(alone)


def keep_first(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, all columns (of any name), without the documents that are near-duplicates of one with a smaller doc_id.

    Of rows that share doc_id and text one is kept; texts that are null or without words stay.
    """
    classes = near_dups(docs, **options).where("is_first").groupBy("doc_id", "node").agg(F.count("*").alias("n"))
    # The caller's columns travel as one, so that none clashes.
    text = F.col("text").cast("string")
    blank = text.isNull() | (F.trim(F.translate(text, "\t\n\x0b\f\r", "     ")) == "")
    keyed = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("id"), F.unhex(F.md5(text)).alias("digest"), blank.alias("blank"))
    classes = cut(classes)
    kept = keyed.join(classes, keyed["id"].eqNullSafe(classes["doc_id"]) & keyed["digest"].eqNullSafe(classes["node"]))
    once = (F.col("n") == 1) | F.col("blank")
    return kept.where(once).select("row.*").unionByName(kept.where(~once).dropDuplicates(["id", "digest"]).select("row.*"))
