"""Column expressions over words and shingles of whole texts; no Python runs on the executors.

Each returns an expression that should be given a column of its own (``withColumn``) before another expression uses it twice.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from starframe.functions.shared import fixed

__all__ = ["SPACES", "fixed", "folded_words", "hashes", "shingles", "words"]

#: Characters between words: the space and 0x09 to 0x0D.
SPACES = " \\t\\n\\x0b\\f\\r"


def words(text: Column | str) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+``; none for a null text."""
    return F.coalesce(F.array_remove(F.split(text, "[\\x20\\x09-\\x0D]+"), ""), F.array().cast("array<string>"))


def folded_words(text: Column | str) -> Column:
    """Lower-case runs of letters and digits; none for a null text."""
    return F.coalesce(F.array_remove(F.split(F.lower(text), "[^\\p{L}\\p{N}]+"), ""), F.array().cast("array<string>"))


def hashes(items: Column | str) -> Column:
    return F.transform(items, lambda w: F.xxhash64(w))


def shingles(hashed: str, size: int = 5) -> Column:
    """Hashes of every ``size`` neighbouring entries of a column of hashes; one for a shorter list, none for an empty one."""
    n = F.size(hashed)
    parts = lambda i: [F.col(hashed)[i + k] for k in range(size)]
    many = F.transform(F.sequence(F.lit(0), n - size), lambda i: F.xxhash64(*parts(i)))
    return F.when(n >= size, many).when(n > 0, F.array(F.xxhash64(hashed))).otherwise(F.array().cast("array<bigint>"))
