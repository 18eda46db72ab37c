"""Quality rules (6), line first: rules for punctuation, navigation and boilerplate judge every line, failing lines are removed,
and documents that lose too much of their text are rejected.  Column expressions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starframe.llm import _native as N

SYMBOLS = "#*$%&|<>"
#: Phrases of page furniture; a line fails if it has one and is short.
BOILERPLATE = "(?i)(cookie|privacy) (policy|notice|settings)|terms (of|and) (use|service|conditions)|all rights reserved|click here|read more|sign (in|up) |log ?in|subscribe to|javascript|share (this|on)|skip to content|lorem ipsum|back to top"


def _punctuation(line: Column) -> Column:
    """Too many symbols, or too many marks of exclamation and question, for the length."""
    n = F.length(line)
    symbols = n - F.length(F.translate(line, SYMBOLS, ""))
    marks = n - F.length(F.translate(line, "!?", ""))
    return (symbols * 10 > n) | (marks * 8 > n)


def _navigation(line: Column) -> Column:
    """A menu: entries with separators between them."""
    return F.size(F.split(line, " [|»›•·] ")) > 4


def _boilerplate(line: Column, longest: int) -> Column:
    return (F.length(line) <= longest) & line.rlike(BOILERPLATE)


def clean(docs: DataFrame, least: float = 0.5, furniture_chars: int = 200) -> DataFrame:
    """Adds to ``docs`` (with a column text), or replaces: clean_text, n_lines, n_removed_lines, kept_share, line_kept.

    Lines (between newlines) with a word are judged; those that fail go, blank ones stay.  ``kept_share`` is the share of the
    characters of judged lines that is left; ``line_kept`` says whether it is ``least`` or more.  A null or empty text has no
    lines, share 1 and passes; its clean_text is as it was.
    """
    lines = docs.withColumn("_lines", F.split(F.col("text").cast("string"), "\n"))
    bad = lambda x: _punctuation(x) | _navigation(x) | _boilerplate(x, furniture_chars)
    blank = lambda x: ~x.rlike("[^\\x20\\x09-\\x0D]")
    lines = lines.withColumn("_left", F.filter("_lines", lambda x: blank(x) | ~bad(x)))
    size = lambda c: F.aggregate(F.col(c), F.lit(0).cast("long"), lambda a, x: a + F.when(blank(x), 0).otherwise(F.length(x)))
    some = F.coalesce(F.size("_lines"), F.lit(0))
    lines = lines.withColumn("_all", size("_lines")).withColumn("_rest", size("_left"))
    share = F.when(F.coalesce("_all", F.lit(0)) > 0, F.col("_rest") / F.col("_all")).otherwise(1.0)
    return (
        lines.withColumn("clean_text", F.array_join("_left", "\n"))
        .withColumn("n_lines", F.when(F.col("_lines").isNull(), 0).otherwise(some).cast("long"))
        .withColumn("n_removed_lines", F.when(F.col("_lines").isNull(), 0).otherwise(some - F.size("_left")).cast("long"))
        .withColumn("kept_share", share)
        .withColumn("line_kept", share >= least)
        .drop("_lines", "_left", "_all", "_rest")
    )


def measures(docs: DataFrame, least_words: int = 10, most_repeated: int = 20) -> DataFrame:
    """Adds to ``docs`` (with a column text): n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed.

    Words are ``[^\\x20\\x09-\\x0D]+``, none for a null text.  n_repeat_words: words in five-word windows that occur twice or more in
    the text.  base_failed: fewer than ``least_words`` words, or more than ``most_repeated`` per cent repeated.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    out = docs.withColumn("_words", N.words(text)).withColumn("_h", N.hashes("_words")).withColumn("n_words", F.size("_words").cast("long"))
    windows = F.when(F.col("n_words") >= 5, N.shingles("_h")).otherwise(F.array().cast("array<bigint>"))
    out = out.withColumn("_win", windows).withColumn("_again", F.size(F.array_distinct("_win")) < F.size("_win"))
    # Only texts with a repeated window sort theirs; equal neighbours are the repeated ones.
    sorted_ = F.when(F.col("_again"), F.sort_array(F.transform("_win", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    out = out.withColumn("_sorted", sorted_)
    s, n = F.col("_sorted"), F.size("_sorted")
    same = lambda x, j: s[j]["h"] == x["h"]
    twice = F.filter("_sorted", lambda x, i: F.when(i > 0, same(x, F.greatest(i - 1, F.lit(0)))).otherwise(F.lit(False)) | F.when(i < n - 1, same(x, F.least(i + 1, n - 1))).otherwise(F.lit(False)))
    out = out.withColumn("_at", F.sort_array(F.transform(twice, lambda x: x["i"])))
    at, m = F.col("_at"), F.size("_at")
    covered = F.aggregate(F.transform("_at", lambda p, i: F.when(i < m - 1, F.least(F.lit(5), at[F.least(i + 1, m - 1)] - p)).otherwise(F.lit(5))), F.lit(0).cast("long"), lambda a, x: a + x)
    full = F.filter(F.split(text, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    out = out.withColumn("_full", full)
    return (
        out.withColumn("word_chars", F.length(F.regexp_replace(text, "[\\x20\\x09-\\x0D]+", "")).cast("long"))
        .withColumn("n_symbols", (F.length(text) - F.length(F.regexp_replace(text, "[#*$%&|<>]+", ""))).cast("long"))
        .withColumn("n_dup_lines", (F.size("_full") - F.size(F.array_distinct("_full"))).cast("long"))
        .withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("long")))
        .withColumn("base_failed", (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeated * F.col("n_words")))
        .drop("_words", "_h", "_win", "_again", "_sorted", "_at", "_full")
    )


RESULTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "clean_text", "n_lines", "n_removed_lines", "kept_share", "line_kept", "kept")


def judge(docs: DataFrame) -> DataFrame:
    """``docs`` (with a column text) with all measures, the cleaned text and ``kept``: not base_failed, and line_kept.

    Works row by row: repeated rows get the same result, an empty table gives no rows, other columns stay, whatever their names
    (those that have the name of a result are replaced).
    """
    # The caller's columns travel as one, so that none clashes with those needed here.
    own = docs.select(F.struct(*(c for c in docs.columns if c not in RESULTS)).alias("row"), F.col("text").cast("string").alias("text"))
    return clean(measures(own)).withColumn("kept", ~F.col("base_failed") & F.col("line_kept")).select("row.*", *RESULTS)
