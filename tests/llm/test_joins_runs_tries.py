"""Operators 11 to 13 against plain versions: SQL over whole small tables, brute force over made-up ones, odd rows."""

import hashlib
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest

from starframe.llm import jaccard_join, periodic_runs, prefix_trie
from starframe.llm import queries as Q
from tests.llm.test_brute_force import WORD, Union, sha


@pytest.mark.parametrize("name", ["op11_ngram_jaccard_join", "op12_periodic_runs", "op13_prefix_trie"])
def test_query_equals_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = con.sql(Q.ORACLE_SQL[name])
    got = Q.QUERIES[name](spark, sf)
    assert sorted(got.columns) == sorted(want.columns)
    expected = sorted((tuple(r) for r in want.fetchall()), key=repr)
    assert len(expected) > 30
    assert sorted((tuple(r[c] for c in want.columns) for r in got.collect()), key=repr) == expected


# Operator 11


def set_of(text: str | None) -> set:
    words = [w.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for w in WORD.findall(text or "")]
    return {tuple(words[k : k + 4]) for k in range(max(1, len(words) - 3))} if words else set()


def linked(rows) -> dict:
    """The least id of each row's component, from all pairs."""
    ids = sorted({d for d, _ in rows})
    sets = [(d, set_of(t)) for d, t in rows]
    u = Union(ids)
    for k, (d, x) in enumerate(sets):
        for e, y in sets[:k]:
            if x and y and 100 * len(x & y) >= 85 * len(x | y):
                u.join(d, e)
    return {d: u.find(d) for d in ids}


def variants(rng, n: int, words: int, changes: int) -> list[str]:
    base = [f"w{k}" for k in rng.integers(0, 10**6, words)]
    out = []
    for _ in range(n):
        own = list(base)
        for k in rng.integers(0, words, rng.integers(0, changes + 1)):
            own[k] = f"x{rng.integers(0, 10**6)}"
        out.append(" ".join(own))
    return out


@pytest.mark.parametrize(("crowd", "bundle"), [(12, 400), (3, 7), (1000, 400)])
def test_join_of_crowds_equals_all_pairs(spark, monkeypatch, crowd, bundle):
    """Groups around the threshold, of few and many members, with a passage that all documents share."""
    monkeypatch.setattr(jaccard_join, "CROWD", crowd)
    monkeypatch.setattr(jaccard_join, "BUNDLE", bundle)
    rng = np.random.default_rng(crowd)
    passage = " ".join(f"p{k}" for k in range(40))
    texts = [t for n, words, changes in ((60, 120, 4), (25, 60, 3), (8, 300, 12), (5, 20, 1), (6, 4, 1), (4, 3, 0)) for t in variants(rng, n, words, changes)]
    texts += [f"{passage} {t}" for t in variants(rng, 20, 9, 2) + variants(rng, 20, 200, 6)] + [t.upper() for t in texts[:5]]
    rows = list(enumerate(texts))
    got = jaccard_join.jaccard_links(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = linked(rows)
    assert {r.doc_id: r.component_id for r in got} == want
    assert {r.doc_id: r.n_shingles for r in got} == {d: len(set_of(t)) for d, t in rows}
    assert 5 < len(set(want.values())) < 170


def test_prefixes_hold_the_matches_they_ask_for():
    """For any order, two similar sets have as many common shingles in their prefixes as the smaller number asked for."""
    rng = np.random.default_rng(5)
    frequent = rng.integers(0, 256, (2, jaccard_join.SLOTS // 8)).astype(np.uint8)
    frequent[1] &= frequent[0]
    met = 0
    for words in (1, 3, 4, 6, 10, 30, 80, 300) * 6:
        texts = [t.encode() for t in variants(rng, 12, words, max(1, words // 40))]
        e, o = jaccard_join._sets(texts, 4)
        n = np.bincount(o, minlength=len(texts))
        at, matches = jaccard_join.prefixes(e, o, n, frequent, 85)
        held = [set(e[at][o[at] == k].tolist()) for k in range(len(texts))]
        sets = [set(e[o == k].tolist()) for k in range(len(texts))]
        for a in range(len(texts)):
            for b in range(a):
                if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                    met += 1
                    assert len(held[a] & held[b]) >= min(matches[a], matches[b])
    assert met > 500


def test_join_of_odd_rows(spark):
    schema = "doc_id long, text string, id string, h string, bytes string, node string, n int, token string, slice int, counts int, bundle string, component_id string"
    more = ("a", "b", "c", "d", 1, "e", 2, 3, "f", "g")
    long = " ".join(f"w{k}" for k in range(300_000))
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "One two"), (5, "one TWO"), (5, "one TWO"), (6, "one two three"), (None, "one two"), (None, None), (None, "alone here"), (7, long), (8, long + " end"), (9, "Äone two"), (10, "äone two"), (1, "one two")]
    got = jaccard_join.jaccard_links(spark.createDataFrame([r + more for r in rows], schema))
    assert got.columns == ["doc_id", "n_shingles", "component_id", "node"]
    have = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()), key=repr)
    want = [(1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 1, 1), (5, 1, 1), (5, 1, 1), (6, 1, 6), (None, 1, 1), (None, 0, None), (None, 1, None), (7, 299_997, 7), (8, 299_998, 7), (9, 1, 9), (10, 1, 10), (1, 1, 1)]
    assert have == sorted(want, key=repr)
    assert jaccard_join.jaccard_links(spark.createDataFrame([], schema)).collect() == []


# Operator 12


def all_runs(words: list) -> list[tuple[int, int, int]]:
    """Every stretch with a period, by the definition: maximal, smallest period, long enough."""
    n, found = len(words), {}
    for q in range(1, n // 2 + 1):
        k = 0
        while k < n - q:
            if words[k] != words[k + q]:
                k += 1
                continue
            start = k
            while k < n - q and words[k] == words[k + q]:
                k += 1
            if k + q - start >= max(12, 2 * q):
                found.setdefault((start, k + q), q)
    return sorted(((s, e - s, q) for (s, e), q in found.items()), key=lambda r: (r[0], r[2]))


def periodic_texts(rng) -> list[list[str]]:
    w = lambda k: [f"w{x}" for x in rng.integers(0, 10**6, k)]
    out = [["a"] * 500, ["a"] * 11, ["a"] * 12, list("ab" * 90 + "a" + "ab" * 90), list("aab" * 70 + "b" + "aab" * 70)]
    for p in (1, 2, 5, 6, 7, 11, 12, 31, 32, 33, 63, 64, 65, 100, 127, 128, 129, 255, 300):
        for times in (2, 2.4, 3.5, 9):
            base = w(p)
            n = int(p * times)
            own = [base[k % p] for k in range(n)]
            out.append(w(int(rng.integers(0, 40))) + own + w(int(rng.integers(0, 40))))
            # A period whose inside is periodic itself, twice over.
            inner = (w(int(rng.integers(1, 4))) * p)[: max(1, p - int(rng.integers(0, 3)))]
            out.append(inner * int(times) + inner[: len(inner) // 2] + w(3) + inner)
    for letters in (1, 2, 3):
        for n in (15, 100, 400):
            out.append([f"l{x}" for x in rng.integers(0, letters, n)])
    fib = ["a", "ab"]
    while len(fib[-1]) < 700:
        fib.append(fib[-1] + fib[-2])
    return out + [list(fib[-1][:700]), w(200) * 3 + w(150) * 2, (w(40) * 2 + w(7) * 5) * 3]


def test_runs_equal_the_definition():
    texts = periodic_texts(np.random.default_rng(2))
    got = periodic_runs.runs([periodic_runs._numbered([w.encode() for w in t]) for t in texts])
    for t, r in zip(texts, got, strict=True):
        assert [tuple(x) for x in r.tolist()] == all_runs(t), (len(t), t[:20])


def test_minima_are_those_of_windows():
    rng = np.random.default_rng(3)
    for width in (1, 2, 3, 8, 13):
        h = rng.integers(1, 9, 60).astype(np.uint64)
        want = np.zeros(60, bool)
        for k in range(60 - width + 1):
            want[k + np.flatnonzero(h[k : k + width] == h[k : k + width].min())] = True
        assert (periodic_runs.minima(h, width) == want).all()


def test_seeds_stay_in_proportion_to_the_text():
    """A text of one word, or of one word broken now and then, has no more seeds than a few for each word."""
    for x in (np.zeros(20_000, np.int64), np.arange(20_000) % 97 == 0, np.arange(20_000) % 33 == 0):
        s = periodic_runs.R.prefix(periodic_runs.R.mix(x.astype(np.uint64)))
        for period in (32, 256, 4096):
            size = period // 4
            assert len(periodic_runs.seeds(periodic_runs.R.windows(s, size), period, size, size)[0]) <= 10 * len(x)


def test_runs_of_odd_rows(spark):
    schema = "doc_id long, text string, words string, runs string, collapsed string"
    loop = " ".join(f"w{k % 5000}" for k in range(200_000))
    rows = [(1, None), (2, ""), (3, "\n \t"), (None, "x " * 13), (4, "x  " * 12), (5, loop), (5, loop), (6, "a b c d e f " * 2 + "g")]
    got = periodic_runs.find_runs(spark.createDataFrame([(*r, "p", "q", "r") for r in rows], schema)).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    for k in (1, 2, 3):
        assert (by[k].n_words, by[k].runs, by[k].collapsed) == (0, [], "")
    assert [tuple(x) for x in by[None].runs] == [(0, 13, 1)] and by[None].collapsed == "x"
    assert by[4].collapsed == "x "
    assert [tuple(x) for x in by[5].runs] == [(0, 200_000, 5000)] and by[5].collapsed == " ".join(f"w{k}" for k in range(5000))
    assert by[6].collapsed == "a b c d e f g"
    assert periodic_runs.find_runs(spark.createDataFrame([], schema)).collect() == []


# Operator 13


def tree(conversations: dict[int, list]) -> list[tuple]:
    members = defaultdict(list)
    for c, turns in conversations.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)

    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        own = (len(members[node]) - 1) * len(node[-1][1].encode()) if node else 0
        leaves[node] = 1 if node not in children else sum(leaves[x] for x in children[node])
        saved[node] = own + sum(saved[x] for x in children.get(node, []))
    out = []
    for node, own in members.items():
        ends = ",".join(str(c) for c in sorted(own) if len(conversations[c]) == len(node))
        out.append((min(own), len(node), min(members[node[:-1]]) if node else None, len(own), len(children.get(node, [])), leaves[node], saved[node], sha(ends)))
    return sorted(out, key=repr)


NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


@pytest.mark.parametrize(("segment", "shard", "piece"), [(4096, 500_000, 4096), (3, 10, 2), (1, 5, 1), (4, 40, 7)])
def test_trie_equals_nested_dicts(spark, monkeypatch, segment, shard, piece):
    for name, value in (("SEGMENT", segment), ("SHARD", shard), ("PIECE", piece)):
        monkeypatch.setattr(prefix_trie, name, value)
    rng = np.random.default_rng(segment)
    talks: dict[int, list] = {}
    for c in rng.permutation(120).tolist():
        old = talks[int(rng.choice(list(talks)))] if talks and rng.random() < 0.8 else []
        talks[c] = old[: int(rng.integers(0, len(old) + 1))] + [(f"r{rng.integers(0, 2)}", f"té{rng.integers(0, 3)}") for _ in range(int(rng.integers(0, 9)))]
    talks[500], talks[501] = talks[7], talks[7]
    rows = [(c, k, r, t) for c, turns in talks.items() for k, (r, t) in enumerate(turns)]
    own = {c: t for c, t in talks.items() if t}
    got = prefix_trie.prefix_trie(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert sorted((tuple(r[c] for c in NODE) for r in got.collect()), key=repr) == tree(own)
    digests = prefix_trie.ordered(prefix_trie.digests(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")))
    every = prefix_trie.trie(digests, spark.createDataFrame([(c,) for c in talks], "conv_id long"))
    assert sorted((tuple(r[c] for c in NODE) for r in every.collect()), key=repr) == tree(talks)


def test_slots_are_minimal_and_perfect():
    for n in (0, 1, 2, 1000, 50_000):
        keys = np.unique(np.random.default_rng(n).integers(0, 2**63, n).astype(np.uint64))
        slots = prefix_trie.Slots(keys)
        assert sorted(slots.of(keys).tolist()) == list(range(len(keys)))


def test_trie_refuses_a_shared_digest(spark):
    """Two turns that are given one digest, but other lengths, are noticed."""
    rows = spark.createDataFrame([(1, 0, 5, 6, 10), (2, 0, 5, 6, 11)], "conv_id long, pos long, t1 long, t2 long, bytes long")
    with pytest.raises(Exception, match="share a digest"):
        prefix_trie.trie(rows).collect()


def test_trie_of_odd_rows(spark):
    schema = "conv_id long, turn long, role string, text string, pos string, a string, depth string, shard string"
    rows = [(1, None, None, None), (1, 3, "u", "x"), (2, 1, "", ""), (2, 9, "u", "x"), (None, 1, "u", "x"), (3, 1, "ux", ""), (4, 1, "u", "x"), (4, 1, "u", "x"), (5, 2, "u", "y" * 300_000)]
    talks = {1: [("", ""), ("u", "x")], 2: [("", ""), ("u", "x")], 3: [("ux", "")], 4: [("u", "x")] * 2, 5: [("u", "y" * 300_000)]}
    got = prefix_trie.prefix_trie(spark.createDataFrame([(*r, "p", "q", "r", "s") for r in rows], schema))
    assert sorted((tuple(r[c] for c in NODE) for r in got.collect()), key=repr) == tree(talks)
    assert prefix_trie.prefix_trie(spark.createDataFrame([], schema)).collect() == []


def test_long_conversation_is_numbered_over_partitions(spark):
    rows = spark.range(20_000).selectExpr("CASE WHEN id % 3 = 0 THEN 7 ELSE id END AS conv_id", "id * 17 % 20011 AS turn", "'u' AS role", "CAST(id AS STRING) AS text")
    got = prefix_trie.ordered(prefix_trie.digests(rows)).where("conv_id = 7").select("pos").collect()
    assert sorted(r.pos for r in got) == list(range(20_000 // 3 + 2))  # and the row of number 7 itself


def test_rebuilt_conversations_follow_the_contract(spark, sf):
    talks = defaultdict(list)
    for r in sorted(spark.read.parquet(f"{sf}/conversations.parquet").collect(), key=lambda r: (r.conv_id, r.turn)):
        talks[r.conv_id].append((r.role or "", r.text or ""))
    h = {c: zlib.crc32(str(c).encode()) % 9 for c in talks}
    want = tree({c: talks.get(c - c % 5, [])[: h[c]] + turns[h[c] :] for c, turns in talks.items()})
    assert sorted((tuple(r[c] for c in NODE) for r in Q.op13_prefix_trie(spark, sf).collect()), key=repr) == want
    assert hashlib.sha256(b"").hexdigest() in {r[-1] for r in want}
