"""N-gram Jaccard join (11) with adaptive prefixes that ask for several matches (Wang, Li and Feng 2012).

All shingles are put into one order, rare ones first.  If two sets are similar enough, so that c = ceil(t * size) shingles are common
at least, then the first size - c + l shingles of either hold l common ones or more, for every l.  Each set chooses its own l: a longer
prefix costs more postings, but then l matches are asked for before two texts are compared.  A pair must have as many matches as the
smaller of its two l.

The order is: shingles that are not known to be frequent by hash, then those known, by the order of their frequency.  Frequencies are
counted in a first pass, over somewhat more of each set than a prefix by hash alone has; what is known of them goes to two tables of
SLOTS bits.  Any order gives right results, so it matters to cost only that a slot may be shared, and that the rest is not counted.

Equal sets are one node.  Postings of a shingle with up to CROWD nodes make pairs, whose matches are counted; the nodes of a larger
crowd are all linked with one of them instead, so a crowd costs a row for each node.  Chains of what is left make clusters, in which
every pair is decided by exact comparison through an inverted index, in bundles of bounded size (see near_dedup).
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starframe.llm import _rolling as R
from starframe.llm._components import components
from starframe.llm._shared import cut
from starframe.llm.near_dedup import _link, shingles

#: Bits of each table of frequent shingles (2 * SLOTS / 8 bytes are sent to tasks); share of a set that is counted, by hash.
SLOTS, COUNTED = 1 << 22, 0.22
#: Most matches asked for; cost of a comparison and of a chance occurrence elsewhere, in postings.
MOST, COMPARE, CHANCE = 4, 50.0, 0.02
#: Nodes that share a shingle of their prefixes up to which pairs are counted; beyond, and from MANY times that on, it is frequent.
CROWD, MANY = 12, 8
#: Nodes in a bundle, and bytes of their texts; below this many bytes a table of which rows were counted is broadcast.
BUNDLE, BUNDLE_BYTES, BROADCAST_BYTES = 400, 8 << 20, 32 << 20
#: Digests that a task remembers, so that repeated texts give postings once.
SEEN = 200_000

_U = np.uint64


def folded(text: Column) -> Column:
    """A to Z in lower case, nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _sets(texts: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each text, sorted, and their owners."""
    e, o = shingles(texts, size)
    order = np.lexsort((e, o))
    e, o = e[order], o[order]
    new = np.ones(len(e), bool)
    new[1:] = (e[1:] != e[:-1]) | (o[1:] != o[:-1])
    return e[new], o[new]


def _slots(e: np.ndarray) -> np.ndarray:
    return (R.mix(e) % _U(SLOTS)).astype(np.int64)


def _parts(table: pa.RecordBatch, size: int):
    """Rows of a batch in portions: their numbers, distinct shingles, the owners' places in the portion, set sizes, digests of the sets."""
    texts = table.column("text").cast(pa.large_binary())
    for part in R.chunks([(k, (texts[k].as_py() or b"").lower()) for k in range(len(texts))], 1 << 19):  # bytes.lower() folds A to Z only
        e, o = _sets([t for _, t in part], size)
        n = np.bincount(o, minlength=len(part))
        ends = np.cumsum(n)
        yield [k for k, _ in part], e, o, n, [hashlib.md5(e[b - c : b].tobytes()).digest() for b, c in zip(ends.tolist(), n.tolist(), strict=True)]


def _short(nodes: list[bytes]) -> np.ndarray:
    """64 bits of digests; two nodes that share them would only be compared."""
    return np.array([int.from_bytes(x[:8], "little", signed=True) for x in nodes], np.int64)


def _digest(size: int):
    def digest(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in tables:
            sizes, nodes = [], []
            for _, _, _, n, own in _parts(table, size):
                sizes += n.tolist()
                nodes += own
            yield pa.RecordBatch.from_arrays([table.column("doc_id"), pa.array(nodes, pa.binary()), pa.array(_short(nodes)), pa.array(sizes, pa.int64()), table.column("h"), table.column("bytes")], names=["doc_id", "node", "id", "n", "h", "bytes"])

    return digest


class _Fresh:
    """Which sets a task has not met before; it remembers SEEN of them."""

    def __init__(self):
        self.seen: set[bytes] = set()

    def of(self, nodes: list[bytes]) -> np.ndarray:
        out = []
        for node in nodes:
            out.append(node not in self.seen)
            if len(self.seen) < SEEN:
                self.seen.add(node)
        return np.array(out, bool)


def _first_tokens(size: int, percent: int):
    """The shingles of least hash of each set: as many as a prefix has by hash alone, and half as many again."""

    def first_tokens(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh = _Fresh()
        for table in tables:
            for _, e, o, n, nodes in _parts(table, size):
                first = np.cumsum(n) - n
                most = np.maximum(n - -(-percent * n // 100) + MOST, np.ceil(COUNTED * n)).astype(np.int64)
                inside = (np.arange(len(e)) - np.repeat(first, n) < np.repeat(most, n)) & fresh.of(nodes)[o]
                yield pa.RecordBatch.from_arrays([pa.array(e[inside].view(np.int64)), pa.array(_slots(e[inside]))], names=["token", "slot"])

    return first_tokens


def _frequent(tokens: DataFrame) -> np.ndarray:
    """For each slot 0, or 1 (2) if a shingle of more than CROWD (MANY * CROWD) sets is there."""
    often = tokens.groupBy("token").agg(F.count("*").alias("n"), F.first("slot").alias("slot")).where(F.col("n") > CROWD)
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("slot") % 64).cast("int"))
    # SLOTS / 64 rows at most.
    words = often.groupBy(F.expr("slot DIV 64").alias("word")).agg(F.bit_or(bit).alias("one"), F.bit_or(F.when(F.col("n") > MANY * CROWD, bit)).alias("two")).collect()
    out = np.zeros((SLOTS // 64, 64), np.uint8)
    for r in words:
        for k in (r["one"], r["two"] or 0):
            out[r["word"]] += np.unpackbits(np.array([k], np.int64).view(np.uint8), bitorder="little")
    return np.packbits(np.stack([out.ravel() >= 1, out.ravel() >= 2]), axis=1)


def _rank(e: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    slot = _slots(e)
    return sum((row[slot >> 3] >> (7 - (slot & 7)).astype(np.uint8)) & 1 for row in frequent)


def prefixes(e: np.ndarray, o: np.ndarray, n: np.ndarray, frequent: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Which shingles are in the prefix of their set (places in e), and the number of matches that each set asks for."""
    rank = _rank(e, frequent)
    order = np.lexsort((e, rank, o))
    rank = rank[order]
    first = np.cumsum(n) - n
    base = n - -(-percent * n // 100)  # a set of n shingles has at least ceil(percent / 100 * n) in common with a partner
    sums = np.concatenate([[0.0], np.cumsum(np.array([CHANCE, 3.0 * CROWD, 3.0 * MANY * CROWD])[rank])])
    cost = np.full((MOST, len(n)), np.inf)
    for k in range(1, MOST + 1):
        fits = base + k <= n
        met = sums[np.minimum(first + base + k, len(e))] - sums[first]
        cost[k - 1] = np.where(fits, base + k + met + COMPARE * met / k, np.inf)
    matches = np.argmin(cost, axis=0) + 1
    inside = np.arange(len(e)) - np.repeat(first, n) < np.repeat(base + matches, n)
    return order[inside], matches


def _post(size: int, frequent: np.ndarray, percent: int):
    def post(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh = _Fresh()
        for table in tables:
            for _, e, o, n, nodes in _parts(table, size):
                at, matches = prefixes(e, o, n, frequent, percent)
                at = at[fresh.of(nodes)[o[at]]]
                ids = _short(nodes)
                yield pa.RecordBatch.from_arrays([pa.array(e[at].view(np.int64)), pa.array(ids[o[at]]), pa.array(n[o[at]].astype(np.int32)), pa.array(matches[o[at]].astype(np.int8))], names=["token", "id", "n", "matches"])

    return post


def candidates(postings: DataFrame, percent: int) -> DataFrame:
    """Edges (a, b) between ids: pairs with matches enough, and one star for each crowd.

    The table of shared shingles is joined to, so a shingle that many nodes have in their prefixes can be split.
    """
    shared = postings.groupBy("token").agg(F.count("*").alias("held"), F.min("id").alias("least"), F.max("id").alias("most")).where("least <> most").select("token", "held", "least")
    rows = cut(postings.join(shared, "token"))
    stars = rows.where((F.col("held") > CROWD) & (F.col("id") != F.col("least"))).select(F.col("id").alias("a"), F.col("least").alias("b")).distinct()
    # CROWD rows to a list at most.
    lists = rows.where(F.col("held") <= CROWD).groupBy("token").agg(F.collect_set(F.struct("id", "n", "matches")).alias("all"))
    near = lambda x, y: 100 * F.least(x["n"], y["n"]) >= percent * F.greatest(x["n"], y["n"])
    pair = lambda x, y: F.struct(x["id"].alias("a"), y["id"].alias("b"), F.least(x["matches"], y["matches"]).alias("needed"))
    pairs = F.flatten(F.transform("all", lambda x: F.transform(F.filter("all", lambda y: (x["id"] < y["id"]) & near(x, y)), lambda y: pair(x, y))))
    met = lists.select(F.inline(pairs)).groupBy("a", "b").agg(F.count("*").alias("met"), F.max("needed").alias("needed")).where("met >= needed").select("a", "b")
    return stars.unionByName(met)


def jaccard_links(docs: DataFrame, percent: int = 85, size: int = 4) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id, node (digest of the set).

    A to Z are lower-cased; words are ``[^\\x20\\x09-\\x0D]+``.  A document's set has its distinct shingles of ``size`` words; of fewer
    words, the whole sequence as one; null texts and those without words have none and are linked with nothing.  Two documents are
    linked if 100 * common >= percent * union.  component_id is the least doc_id reachable by links (null ids count as greatest: a
    component of such rows only has a null).  Repeated rows share a component; other columns are ignored; an empty table gives no rows.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumns({"h": F.xxhash64("text"), "bytes": F.octet_length("text").cast("long")})
    signed = cut(rows.mapInArrow(_digest(size), "doc_id long, node binary, id long, n long, h long, bytes long"))
    frequent = _frequent(rows.select("text").mapInArrow(_first_tokens(size, percent), "token long, slot long"))
    postings = rows.select("text").mapInArrow(_post(size, frequent, percent), "token long, id long, n int, matches byte")
    clusters = components(candidates(postings, percent))
    # One row of each set of a cluster, and where it is compared.
    nodes = signed.where("n > 0").groupBy("node", "id").agg(F.min("doc_id").alias("doc_id"), F.min(F.struct("doc_id", "h", "bytes")).alias("one"))
    chosen = cut(nodes.select("node", "id", "one.*").join(clusters.select(F.col("node").alias("id"), F.col("root").alias("cluster")), "id"))
    count, total = chosen.agg(F.count("*"), F.sum("bytes")).first()
    bundles = max(1, math.ceil(count / BUNDLE), math.ceil((total or 0) / BUNDLE_BYTES))
    sizes = chosen.groupBy("cluster").agg(F.greatest(F.ceil(F.count("*") / BUNDLE), F.ceil(F.sum("bytes") / BUNDLE_BYTES)).alias("blocks"))
    placed = chosen.join(sizes, "cluster").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
    pair = F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda j: F.struct(F.least(j, F.col("block")).alias("i"), F.greatest(j, F.col("block")).alias("j")))
    bundle = F.when(F.col("blocks") == 1, F.array(F.pmod(F.xxhash64("cluster"), F.lit(bundles)))).otherwise(F.transform(pair, lambda p: F.xxhash64("cluster", p["i"], p["j"])))
    placed = cut(placed.select("node", F.col("doc_id").alias("d"), F.col("h").alias("g"), bundle.alias("bundles")))
    weight = placed.agg(F.sum(60 + 8 * F.size("bundles"))).first()[0] or 0
    held = F.broadcast(placed) if weight < BROADCAST_BYTES else placed
    found = rows.join(held, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("h") == F.col("g"))).select("node", folded(F.col("text")).alias("text"), F.explode("bundles").alias("bundle"))
    roots = components(found.groupBy("bundle").applyInArrow(_link(size, False, percent / 100), "a binary, b binary"))
    least = nodes.select("node", "doc_id").join(roots, "node").groupBy("root").agg(F.min("doc_id").alias("component_id"))
    linked = cut(roots.join(least, "root").select("node", "component_id"))
    alone = nodes.join(linked, "node", "left_anti").select("node", F.col("doc_id").alias("component_id"))
    out = signed.join(linked.unionByName(alone), "node", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), "node")

