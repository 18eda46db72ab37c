"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns have defined results."""

import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from starframe.llm import decontaminate, language_id, license_scan, line_dedup, near_dedup, packing, quality_rules, substring_dedup, suffix_dedup, url_filter

#: Texts of licences, one in a file; the test of them is left out where the folder is missing.
LIBRARY = "/usr/share/common-licenses"
LONG = " ".join(f"word{k % 977} of line {k}." for k in range(20_000))
SAME = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen"
ROWS = [(1, SAME, "en"), (1, SAME, "en"), (2, SAME, None), (None, SAME, "en"), (None, None, None), (3, None, "en"), (4, "", "de"), (5, " \n\t\n ", "de"), (6, LONG, "en"), (7, "12345 !!", "fr"), (8, "line\n\nline\nother", "es")]
MORE = ["_id", "_text", "_h", "_n", "_bad", "_words", "_lines", "depth", "suffix", "features", "row", "gone", "id", "digest", "blank", "h", "t", "k1"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, keep string, node string, rank int, label string, " + ", ".join(f"{c} string" for c in MORE)


def table(spark, rows):
    return spark.createDataFrame([(d, t, g, "s", len(t or ""), "k", "n", 1, "l", *MORE) for d, t, g in rows], SCHEMA)


OPERATORS = {
    "suffix": lambda df: suffix_dedup.suffix_dedup(df),
    "substring": lambda df: substring_dedup.substring_dedup(df),
    "near": lambda df: near_dedup.near_dups(df),
    "near_keep": lambda df: near_dedup.keep_first(df),
    "lines": lambda df: line_dedup.dedup_lines(df),
    "language": lambda df: language_id.identify(df, language_id.fit(df)),
    "quality": lambda df: quality_rules.judge(df),
    "packing": lambda df: packing.pack(df),
    "licenses": lambda df: license_scan.scan(df),
    "urls": lambda df: url_filter.judge(df.withColumnRenamed("text", "url"), None),
    "leaks": lambda df: decontaminate.find_leaks(df, df.selectExpr("doc_id AS item_id", "CAST(NULL AS STRING) AS text")),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_empty_table(spark, name):
    assert OPERATORS[name](table(spark, ROWS[:0])).collect() == []


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_odd_rows(spark, name):
    got = OPERATORS[name](table(spark, ROWS)).collect()
    if name not in ("near_keep", "licenses", "leaks", "packing"):
        assert len(got) == len(ROWS)
    if name == "suffix":
        assert all(r.n_removed == 0 for r in got)  # nothing of 200 bytes repeats
    if name == "substring":
        # The null id comes first, so it keeps its words; rows of one id take nothing from each other.
        assert sorted((r.doc_id or 0, r.n_removed) for r in got if r.n_words == 16) == [(0, 0), (1, 16), (1, 16), (2, 16)]
    if name == "near":
        same = [r for r in got if r.class_size == 4]
        assert len(same) == 4 and {r.class_id for r in same} == {1} and sum(r.is_first for r in same) == 2
    if name == "near_keep":
        assert sum(r.text == SAME for r in got) == 1 and len(got) == len(ROWS) - 3
        assert got[0].asDict().keys() == set(SCHEMA.replace(" long", "").replace(" string", "").replace(" int", "").split(", "))
    if name == "lines":
        kept = {r.doc_id: r.text for r in got if r.doc_id in (1, 2, 8)}
        assert kept == {1: "", 2: "", 8: "line\n\nother"}
        assert {r.text for r in got if r.doc_id is None} == {SAME, None}
    if name == "language":
        assert {r.lang_pred for r in got if r.doc_id in (3, 4, 5, 7)} == {"und"} and all(0 <= r.score <= 1 for r in got)
    if name == "quality":
        assert {r.doc_id: r.n_words for r in got if r.doc_id in (3, 4, 5, 6)} == {3: 0, 4: 0, 5: 0, 6: 80_000}
    if name == "packing":
        assert sum(r.length for r in got if r.doc_id in (3, 4)) == 2 and sum(1 for r in got if r.doc_id == 1) == 2
    if name == "urls":
        assert {(r.host, r.path, r.rule, r.verdict) for r in got} == {("", "", None, "allow")}


@pytest.mark.parametrize("name", ["near_keep", "lines", "quality", "urls", "no_leaks"])
def test_other_columns_stay_whatever_their_names(spark, name):
    df = table(spark, ROWS)
    leaks = lambda df: decontaminate.without_leaks(df, df.selectExpr("doc_id AS item_id", "CAST(NULL AS STRING) AS text"))
    got = (OPERATORS | {"no_leaks": leaks})[name](df).collect()
    assert got and all(r[c] == c for r in got for c in MORE) and all(r["keep"] == "k" and r["rank"] == 1 for r in got)


def test_leaks_do_not_depend_on_shards(spark, sf):
    docs, items = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    plain = lambda df: sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect())
    one = plain(decontaminate.find_leaks(docs, items))
    assert one and one == plain(decontaminate.find_leaks(docs, items, shard_items=9, shards_each=2))


def test_licences_do_not_depend_on_other_templates(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = lambda df: {(r.doc_id, r.license, round(r.containment, 9)) for r in df.collect()}
    own = license_scan.notices(spark)
    one = kept(license_scan.scan(docs))
    # Whole texts as templates besides: over 100,000 shingles in all.
    more = own.unionByName(docs.where("text is not null").select(F.concat(F.lit("text "), "doc_id").alias("license"), "text"))
    many = kept(license_scan.scan(docs, more))
    assert one and one == {r for r in many if not r[1].startswith("text ")}
    full = {r.doc_id for r in docs.collect() if r.text and any(c.isalnum() for c in r.text)}
    assert {d for d, name, c in many if name == f"text {d}" and c == 1.0} == full


def test_licences_of_null_and_repeated_ids(spark):
    text = "some words before it " * 9 + license_scan.NOTICES["MIT-text"] + " and some words after it" * 9
    rows = [(None, text), (None, text), (7, text), (7, text + " more"), (8, None), (9, " .,")]
    got = {(r.doc_id, r.license, r.containment, r.n_windows > 0) for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(None, "MIT-text", 1.0, True), (7, "MIT-text", 1.0, True)}
    none = spark.createDataFrame([], "license string, text string")
    assert license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string"), none).count() == 0
    twice = spark.createDataFrame([("x", text), ("x", "quite another text of seven words or so"), (None, text)], "license string, text string")
    assert {(r.doc_id, r.license) for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string"), twice).collect()} == {(d, n) for d in (None, 7) for n in ("x", None)}


@pytest.mark.skipif(not Path(LIBRARY).is_dir(), reason="no licence texts on this machine")
def test_licences_of_a_library_of_full_texts(spark):
    """Whole licences, each with a word in a hundred edited, between other words, against a brute-force containment."""
    library = license_scan.read_templates(spark, LIBRARY)
    texts = {r.license: r.text for r in library.collect()}
    words = {k: re.findall(r"[^\W_]+", t.lower()) for k, t in texts.items()}
    grams = lambda w: {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
    rows, want = [], set()
    for n, (name, w) in enumerate(sorted(words.items())):
        body = [f"edited{k}" if k % 100 == 50 else x for k, x in enumerate(w)]
        text = [f"a{k}" for k in range(211 * n)] + body + [f"b{k}" for k in range(97 * n)]
        rows.append((n, " ".join(text)))
        want |= {(n, other) for other in words if len(grams(words[other]) & grams(text)) >= 0.8 * len(grams(words[other]))}
    got = {(r.doc_id, r.license) for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string"), library).collect()}
    assert len(want) >= len(texts) > 9 and got == want


def test_language_sample_is_dealt_by_language(spark):
    rows = [(None, f"the house number {k} is by the river and the old mill", "en") for k in range(300)] + [(None, "das alte haus steht am fluss neben der mühle", "de")] * 40 + [(5, f"la casa vieja {'abc'[k % 3]} está junto al río", "es") for k in range(9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert set(language_id.fit(df, sample_docs=10)) == {"de", "en", "es"}


def test_language_encoders_are_told_apart_by_their_whole_contents(spark):
    head = "a" * 100
    texts = [f"{head} rauf runter drüber drunter {k}" for k in range(30)]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string").coalesce(1)
    one, two = (head + " rauf runter drüber drunter").encode(), (head + " sesquipedalian vocabulary!!").encode()
    for content, other, want in ((one, two, "x"), (two, one, "y")):
        assert {r.lang_pred for r in language_id.identify(df, {"x": content, "y": other}).collect()} == {want}


def test_urls_repeated_often_are_one_row_of_the_sample(spark):
    rows = [("https://same.example.org/a", 1)] * 500 + [(f"https://site{k}.example.org/{'bad' * (k % 2)}{k}?q={k}", k % 2) for k in range(400)]
    df = spark.createDataFrame(rows, "url string, bad int")
    model = url_filter.UrlFilter.fit(df, sample=200)
    got = url_filter.judge(df, model).collect()
    assert len(got) == len(rows) and all(0 <= r.bad_score <= 1 for r in got)
    assert url_filter.judge(table(spark, ROWS).withColumnRenamed("text", "url"), model).count() == len(ROWS)
    assert url_filter.judge(df.limit(0), model).collect() == []


def test_leaks_of_question_and_answer(spark):
    items = spark.createDataFrame([(1, "what is the name of the first of all rivers", "it is the long blue one in the north"), (2, None, None), (3, "", "")], "item_id long, question string, answer string")
    docs = spark.createDataFrame([(1, "x " * 300 + "What is the name of the first of all rivers? It is the long blue one in the north. " + "y " * 300), (2, "what is the name of the first of all rivers"), (3, None)], "doc_id long, text string")
    got = decontaminate.find_leaks(docs, items).collect()
    assert [(r.doc_id, r.item_id, r.question_overlap, r.answer_overlap) for r in got] == [(1, 1, 1.0, 1.0)]
    shards = decontaminate.find_leaks(docs, items, shard_items=1).collect()
    assert [(r.doc_id, r.item_id) for r in shards] == [(1, 1)]
    assert [r.doc_id for r in decontaminate.without_leaks(docs, items).collect()] == [2, 3]


def test_pipeline_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    n = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        rows = out.collect()
        assert out.columns == docs.columns and 0.5 * n < len(rows) <= n, name
        docs, n = spark.createDataFrame(rows, out.schema), len(rows)
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf).select("doc_id").distinct().count() == n


def test_pipeline_on_odd_rows(spark, sf):
    docs = table(spark, ROWS).select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
    assert docs.count() > 0


def test_dictionaries_are_bounded_by_bytes(spark):
    rows = [(k, "wort " * 20, "de") for k in range(50)] + [(99, "lang " * 10_000, "de"), (100, "mot seul", "fr")]
    made = language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), sample_docs=40, sample_bytes=1000)
    assert set(made) == {"de", "fr"} and made["de"].count(b"wort") == 200 and b"lang" not in made["de"]
    assert made["fr"].split() == [b"mot", b"seul"]
