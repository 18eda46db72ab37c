"""Header cards as a table: parsing, joining of continued values, keyword look-up and search.  All are Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from starframe.functions.scalar import printable, to_double, to_int, unquote
from starframe.functions.shared import fixed

_STRING = "^ *'(?:[^']|'')*'?"


def split_cards(headers: DataFrame, column: str = "header", keys: list[str] = ("path", "hdu")) -> DataFrame:
    """One row per 80-character card of a header text, up to END: keys, seq, card.

    Headers are dealt by their keys once, so that few large files keep no core idle and what groups cards by header moves none.
    """
    own = headers.select(*keys, F.col(column).alias("_header")).repartition(*keys)
    own = fixed(own, _cards=F.regexp_extract_all("_header", F.lit("(?s)(.{80})"), 1)).drop("_header")
    end = F.array_position(F.transform("_cards", lambda c: F.rtrim(c)), "END")
    own = own.withColumn("_cards", F.when(end > 0, F.slice("_cards", F.lit(1), end.cast("int"))).otherwise(F.col("_cards")))
    return own.select(*keys, F.posexplode("_cards").alias("seq", "card"))


def parse_cards(cards: DataFrame, card: str = "card") -> DataFrame:
    """Adds kind (v: keyword with a value, c: comment, e: end), key, value, is_string, comment to 80-character cards."""
    columns = [c for c in cards.columns if c not in ("kind", "key", "value", "is_string", "comment")]
    text, name, kind, field, string = (F.col(f"_{c}") for c in ("text", "name", "kind", "field", "string"))
    # What several results follow from is computed once.
    own = cards.select(*columns, F.rpad(F.col(card), 80, " ").alias("_text"))
    hierarch = text.startswith("HIERARCH ") & (F.instr(text, "=") > 0)
    own = fixed(own, _name=F.rtrim(F.substring(text, 1, 8)), _hierarch=hierarch)
    plain = (F.substring(text, 9, 2) == "= ") & ~name.isin("COMMENT", "HISTORY", "", "CONTINUE")
    own = fixed(own, _kind=F.when(F.rtrim(text) == "END", "e").when(plain | F.col("_hierarch"), "v").otherwise("c"), _plain=plain)
    more = name == "CONTINUE"
    own = fixed(own, _field=F.when(F.col("_hierarch"), F.regexp_extract(text, "^[^=]*=(.*)$", 1)).when(F.col("_plain"), F.substring(text, 11, 70)).when(more, F.substring(text, 9, 72)))
    own = fixed(own, _string=F.coalesce(F.ltrim(field).startswith("'"), F.lit(False)) & ((kind == "v") | more))
    key = F.when(F.col("_hierarch"), F.trim(F.regexp_extract(text, "^HIERARCH +([^=]*)=", 1))).otherwise(name)
    value = F.when(string, unquote(field)).when(kind == "v", F.trim(F.regexp_extract(field, "^([^/]*)", 1))).otherwise(F.rtrim(F.substring(text, 9, 72)))
    comment = F.when(string, F.regexp_extract(field, _STRING + " *(?:/ ?(.*))?$", 1)).when(kind == "v", F.regexp_extract(field, "^[^/]*/ ?(.*)$", 1)).otherwise("")
    made = {"kind": kind, "key": printable(F.when(kind == "e", "END").otherwise(key)), "value": F.when(kind == "e", "").otherwise(printable(value)), "is_string": string, "comment": printable(F.rtrim(comment))}
    return fixed(own, **made).select(*columns, *made)


def join_continued(cards: DataFrame, keys: list[str] = ("path", "hdu")) -> DataFrame:
    """Strings that end in ``&`` take in the CONTINUE cards that follow; comments are joined by a space.  An orphan CONTINUE is a comment."""
    w = Window.partitionBy(*keys).orderBy("seq")
    runs = (F.col("key") == "CONTINUE") & F.col("is_string")
    # A chain starts at a keyword with a string value; each part but the last ends in &.
    linked = runs & F.coalesce(F.lag((F.col("is_string") & ((F.col("kind") == "v") | runs)) & F.col("value").endswith("&")).over(w), F.lit(False))
    marked = cards.withColumn("_linked", linked)
    # A part continues a chain only if every card back to a keyword is linked.
    marked = marked.withColumn("_chain", F.sum(F.when(F.col("_linked"), 0).otherwise(1)).over(w))
    headed = F.first(F.col("kind") == "v").over(Window.partitionBy(*keys, "_chain").orderBy("seq"))
    marked = marked.withColumn("_chain", F.when(F.col("_linked") & ~headed, -F.col("seq")).otherwise(F.col("_chain")))
    part = F.struct("seq", "kind", "key", "value", "is_string", "comment")
    grouped = marked.groupBy(*keys, "_chain").agg(F.array_sort(F.collect_list(part)).alias("_p"))
    p, n = F.col("_p"), F.size("_p")
    text = F.array_join(F.transform("_p", lambda x, i: F.when(x["value"].endswith("&") & x["is_string"] & (n > 1) & (i < n), F.regexp_replace(x["value"], "&$", "")).otherwise(x["value"])), "")
    note = F.array_join(F.filter(F.transform("_p", lambda x: x["comment"]), lambda c: c != ""), " ")
    return grouped.select(*keys, p[0]["seq"].alias("seq"), p[0]["kind"].alias("kind"), p[0]["key"].alias("key"), text.alias("value"), p[0]["is_string"].alias("is_string"), note.alias("comment"))


def keyword(cards: DataFrame, key: str, kind: str = "string", keys: list[str] = ("path", "hdu")) -> DataFrame:
    """The first card with a key in each header: keys, value (``kind``: string, int or double)."""
    value: Column = F.min_by("value", "seq")
    found = cards.where((F.col("key") == key) & (F.col("kind") == "v")).groupBy(*keys).agg(value.alias("value"))
    return found.withColumn("value", {"string": F.col("value"), "int": to_int(F.col("value")), "double": to_double(F.col("value"))}[kind])


def keywords(cards: DataFrame, names: list[str], keys: list[str] = ("path", "hdu")) -> DataFrame:
    """One row per header with a column for each key (the first card's value), in one aggregate."""
    own = cards.where(F.col("key").isin(names) & (F.col("kind") == "v"))
    return own.groupBy(*keys).agg(*(F.min_by("value", F.when(F.col("key") == n, F.col("seq"))).alias(n) for n in names))


def search(cards: DataFrame, text: str) -> DataFrame:
    """Cards with a text in key, value or comment, in any case."""
    like = "%" + text.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_") + "%"
    return cards.where(F.col("key").ilike(like) | F.col("value").ilike(like) | F.col("comment").ilike(like))
