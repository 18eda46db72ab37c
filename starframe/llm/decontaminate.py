"""Benchmark decontamination (2): a BM25 inverted index of test items with block-max WAND, queried by every training passage.

An item's BM25 score is divided by the score of the item against itself, so one threshold serves all items.  The index keeps, for
each term, its impact on each item, and its greatest impact in each block of items.  Every passage of every document is a query:
blocks whose bound (the sum of the passage's block maxima) stays below the threshold are skipped, the others are scored in full,
and every item at or above the threshold is verified by five-word shingles of its question and answer found in the passage.

The index, not the corpus, is broadcast, in shards of about ``shard_items`` items and ``shard_bytes`` of text; ``shards_each`` of them
go with one pass over the corpus.  Document frequencies, the number of items, their mean length and the length of passages are those
of the whole benchmark, counted by Spark, so scores and passages do not depend on the number of shards.  Of several passages with one
item the one with the best score, overlaps and then the latest place is given.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starframe.llm import _rolling as R

BLOCK = 16
_SEPARATORS = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
_OUT = "doc_id long, item_id long, score double, overlap double, question_overlap double, answer_overlap double, passage long"


def _words(texts: list[bytes]) -> R.Words:
    return R.Words(R.Texts(texts), _SEPARATORS)


def _fold(text: str | None) -> bytes:
    """Lower case; words are then runs of letters and digits."""
    return (text or "").lower().encode()


def _grams(hashes: np.ndarray, size: int) -> np.ndarray:
    return np.unique(R.windows(R.prefix(hashes), size))


class Statistics:
    """Of all items of a benchmark that have a word: their number, mean and greatest length, and in how many each term is."""

    def __init__(self, items: DataFrame):
        self.items, self.mean, self.longest = items.mapInArrow(_lengths, "n long").agg(F.count("*"), F.avg("n"), F.max("n")).first()
        self.terms = items.mapInArrow(_terms, "term long").groupBy("term").agg(F.count("*").alias("df"))

    def frequencies(self, terms: np.ndarray) -> np.ndarray:
        """For the sorted terms of a shard, whose number the shard bounds."""
        import pandas as pd

        own = self.terms.sparkSession.createDataFrame(pd.DataFrame({"term": terms.view(np.int64)}), "term long")
        found = {r["term"]: r["df"] for r in self.terms.join(own, "term").collect()}
        return np.array([found[t] for t in terms.view(np.int64).tolist()], float)


def _each_item(tables):
    """The term fingerprints of each item with a word."""
    for table in tables:
        for q, a in zip(table.column("question").to_pylist(), table.column("answer").to_pylist(), strict=True):
            words = _words([_fold(q), _fold(a)]).hash
            if len(words):
                yield words


def _lengths(tables):
    for words in _each_item(tables):
        yield pa.RecordBatch.from_arrays([pa.array([len(words)], pa.int64())], names=["n"])


def _terms(tables):
    for words in _each_item(tables):
        yield pa.RecordBatch.from_arrays([pa.array(np.unique(words).view(np.int64))], names=["term"])


class Index:
    """An inverted index of items (id, question, answer), the texts folded; at least one has a word."""

    def __init__(self, items: list[tuple[int, bytes, bytes]], size: int, whole: "Statistics", k1: float = 1.2, b: float = 0.75):
        self.size = size
        parts = _words([t for _, q, a in items for t in (q, a)])
        cut = parts.first
        self.ids, self.parts, lists = [], [], []
        for n, (item, _, _) in enumerate(items):
            q, a, both = (parts.hash[cut[i] : cut[j]] for i, j in ((2 * n, 2 * n + 1), (2 * n + 1, 2 * n + 2), (2 * n, 2 * n + 2)))
            if len(both):
                self.ids.append(item)
                self.parts.append([(min(size, len(p)), _grams(p, min(size, len(p)))) if len(p) else None for p in (both, q, a)])
                lists.append(both)
        self.longest = whole.longest
        n, length = len(lists), np.array([len(x) for x in lists], float)
        self.terms, inverse = np.unique(np.concatenate(lists), return_inverse=True)
        owner = np.repeat(np.arange(n), length.astype(int))
        pair, tf = np.unique(inverse.astype(np.int64) * n + owner, return_counts=True)
        term, item = pair // n, pair % n
        df = whole.frequencies(self.terms)
        idf = np.log(1 + (whole.items - df + 0.5) / (df + 0.5))
        impact = idf[term] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length[item] / whole.mean))
        # Multiples of 2**-22: their sums up to 2 are exact, so a score does not depend on the order or on the shard.
        impact = (np.round(impact / np.bincount(item, impact, n)[item] * 2**22) / 2**22).astype(np.float32)
        # Postings by block of items: terms of the block and their impacts on its items.
        self.bounds = np.zeros((len(self.terms) + 1, math.ceil(n / BLOCK)), np.float32)  # the last row: not a term
        np.maximum.at(self.bounds, (term, item // BLOCK), impact)
        self.blocks = []
        for k in range(self.bounds.shape[1]):
            own = item // BLOCK == k
            rows, at = np.unique(term[own], return_inverse=True)
            table = np.zeros((len(rows) + 1, BLOCK), np.float32)
            table[at, item[own] % BLOCK] = impact[own]
            at = np.full(len(self.terms) + 1, len(rows), np.int32)
            at[rows] = np.arange(len(rows))
            self.blocks.append((at, table))

    def lookup(self, sorted_values: np.ndarray, x: np.ndarray) -> np.ndarray:
        """Positions in the sorted values, or their number where they lack it."""
        at = np.minimum(np.searchsorted(sorted_values, x), len(sorted_values) - 1)
        return np.where(sorted_values[at] == x, at, len(sorted_values))

    def search(self, words: R.Words, threshold: float):
        """(text, first word, end, item, score) of every passage and item at the threshold; passages are two items long, and begin
        every item's length, so that each place of each item lies whole in one."""
        step = self.longest
        term = self.lookup(self.terms, words.hash)
        known = np.flatnonzero(term < len(self.terms))
        if not len(known):
            return
        text = words.text[known]
        nth = (known - words.first[text]) // step
        # A passage number for each text and stretch; a word lies in the passage that begins in its stretch and in the one before.
        per = np.diff(words.first) // step + 1
        base = np.cumsum(per) - per
        own = base[text] + nth
        before = nth > 0
        pair = np.unique(np.concatenate([own, own[before] - 1]) * (len(self.terms) + 1) + np.concatenate([term[known], term[known[before]]]))
        passage, t = pair // (len(self.terms) + 1), pair % (len(self.terms) + 1)
        starts = np.flatnonzero(np.append(True, passage[1:] != passage[:-1]))
        ends = np.append(starts[1:], len(passage))
        for lo in range(0, len(starts), 4096):
            some = slice(lo, lo + 4096)
            a, z = starts[some], ends[some]
            at = t[a[0] : z[-1]]
            bound = np.add.reduceat(self.bounds[at], a - a[0], axis=0)
            for k in np.flatnonzero((bound >= threshold).any(0)).tolist():
                row, table = self.blocks[k]
                use = np.flatnonzero(bound[:, k] >= threshold)
                size = (z - a)[use]
                begin = np.cumsum(size) - size
                mine = np.arange(size.sum()) + np.repeat(a[use] - a[0] - begin, size)
                score = np.add.reduceat(table[row[at[mine]]], begin, axis=0)
                for p, j in zip(*(x.tolist() for x in np.nonzero(score >= threshold)), strict=True):
                    number = passage[a[use[p]]]
                    owner = int(np.searchsorted(base, number, side="right")) - 1
                    first = int(words.first[owner] + (number - base[owner]) * step)
                    yield owner, first, min(first + 2 * step, int(words.first[owner + 1])), k * BLOCK + j, float(score[p, j])

    def overlaps(self, hashes: np.ndarray, item: int, grams: dict) -> list[float | None]:
        """Shares of the item's shingles (whole, question, answer) that the passage has."""
        out: list[float | None] = []
        for part in self.parts[item]:
            if part is None:
                out.append(None)
                continue
            size, own = part
            if size not in grams:
                grams[size] = _grams(hashes, size)
            out.append(len(np.intersect1d(own, grams[size], assume_unique=True)) / len(own))
        return out


def _scan(shared, threshold: float, overlap: float, each: float):
    def scan(tables):
        for table in tables:
            ids = table.column("doc_id").to_pylist()
            rows = [(d, _fold(t)) for d, t in zip(ids, table.column("text").to_pylist(), strict=True)]
            out = []
            for part in R.chunks(rows):
                words = _words([t for _, t in part])
                grams: dict = {}
                for index in (one.value for one in shared):
                    best: dict = {}
                    for text, a, z, item, score in index.search(words, threshold):
                        whole, q, ans = index.overlaps(words.hash[a:z], item, grams.setdefault((a, z), {}))
                        if whole >= overlap and (q is None or q >= each) and (ans is None or ans >= each):
                            row = (score, whole, q, ans, a - int(words.first[text]))
                            if best.get((text, item), row) <= row:
                                best[text, item] = row
                    out += [(part[text][0], index.ids[item], *row) for (text, item), row in sorted(best.items())]
            cols = list(zip(*out, strict=True)) if out else [[]] * 7
            kinds = (pa.int64(), pa.int64(), *[pa.float64()] * 4, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True)], names=[x.split()[0] for x in _OUT.split(", ")])

    return scan


def find_leaks(docs: DataFrame, items: DataFrame, threshold: float = 0.5, overlap: float = 0.8, each: float = 0.6, size: int = 5, shard_items: int = 1024, shard_bytes: int = 4 << 20, shards_each: int = 8) -> DataFrame:
    """Test items found in ``docs`` (doc_id, text): doc_id, item_id, score, overlap, question_overlap, answer_overlap, passage.

    ``items`` has item_id and either question and answer, or text, whose first half then counts as the question and the second
    as the answer.  A passage leaks an item if its BM25 score is ``threshold`` of the item's own, and it holds ``overlap`` of all
    the item's shingles (``size`` words, fewer where a part is shorter) and ``each`` of the question's and of the answer's; a part
    without words is not asked for.  One row for each document row and item, with its best passage (its first word).  Texts that
    are null or empty leak nothing, items without words are never found, repeated rows give repeated results, other columns are
    ignored; with no documents or no items the result is empty.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    split = {"question", "answer"} <= set(items.columns)
    parts = items.select(F.col("item_id").cast("long").alias("item_id"), *([F.col(c).cast("string").alias(c) for c in ("question", "answer")] if split else [F.col("text").cast("string").alias("question"), F.lit(None).cast("string").alias("answer")]))
    n, b = parts.agg(F.count("*"), F.sum(F.length(F.concat_ws(" ", "question", "answer")))).first()
    shards = max(math.ceil(n / shard_items), math.ceil((b or 0) / shard_bytes), 1)
    whole = Statistics(parts)
    passes, ready = [], []
    for s in range(shards) if whole.items else ():
        own = []
        for r in parts.where(F.pmod(F.xxhash64("item_id", "question"), F.lit(shards)) == s).orderBy("item_id", "question", "answer").collect():
            q, a = _fold(r["question"]), _fold(r["answer"])
            if not split:
                w = _words([q])
                half = int(w.start[(len(w.start) + 1) // 2]) if len(w.start) > 1 else len(q)
                q, a = q[:half], q[half:]
            own.append((r["item_id"], q, a))
        if any(len(_words([q, a]).start) for _, q, a in own):
            ready.append(spark.sparkContext.broadcast(Index(own, size, whole)))
        if ready and (len(ready) == shards_each or s == shards - 1):
            passes.append(docs.mapInArrow(_scan(ready, threshold, overlap, each), _OUT))
            ready = []
    if ready:
        passes.append(docs.mapInArrow(_scan(ready, threshold, overlap, each), _OUT))
    out = None
    for found in passes:
        out = found if out is None else out.unionByName(found)
    return out if out is not None else spark.createDataFrame([], _OUT)


def without_leaks(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, all columns (of any name), that leak no item; rows that share a doc_id go or stay together.

    A document with a null doc_id is judged with all others of null doc_id.
    """
    bad = find_leaks(docs, items, **options).select("doc_id").distinct()
    # The caller's columns travel as one, so that none clashes.
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("id"))
    return rows.join(bad, rows["id"].eqNullSafe(bad["doc_id"]), "left_anti").select("row.*")
