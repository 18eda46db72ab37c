"""The registered queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from starframe.llm.suffix_dedup import suffix_dedup

    out = suffix_dedup(_read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from starframe.llm.substring_dedup import substring_dedup

    out = substring_dedup(_read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"), F.size("spans").cast("long").alias("n_spans"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from starframe.llm.decontaminate import find_leaks

    return find_leaks(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op3_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from starframe.llm.near_dedup import near_dups

    return near_dups(_read(spark, sf_dir, "documents")).select("doc_id", "class_id", "class_size", "is_first")


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled URLs: a page's URL carries the number of the document it was made from; one of low quality or toxic is bad."""
    from starframe.llm import url_filter as U

    pages = _read(spark, sf_dir, "pages").select("page_id", "url")
    labels = _read(spark, sf_dir, "labels").select("doc_id", ((F.col("quality") == 0) | (F.col("toxic") == 1)).cast("int").alias("bad"))
    labelled = pages.withColumn("doc_id", F.expr("try_cast(regexp_extract(url, '/([0-9]{1,18})', 1) AS BIGINT)")).join(labels, "doc_id")
    out = U.judge(pages, U.UrlFilter.fit(labelled.select("url", "bad")))
    return out.select("page_id", "host", "path", "rule", "verdict", "bad_score")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from starframe.llm.quality_rules import judge

    out = judge(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_removed_lines", "kept_share")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from starframe.llm.line_dedup import dedup_lines

    out = dedup_lines(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed_lines", F.sha2("text", 256).alias("kept_sha256"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from starframe.llm import language_id as L

    docs = _read(spark, sf_dir, "documents")
    out = L.identify(docs, L.fit(docs.where(~L.held_out())))
    return out.select("doc_id", L.held_out().alias("held_out"), "lang_pred", "score", "margin", "accepted")


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from starframe.llm.packing import pack

    return pack(_read(spark, sf_dir, "documents"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from starframe.llm.license_scan import scan

    return scan(_read(spark, sf_dir, "documents"))


def op11_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from starframe.llm.jaccard_join import jaccard_links

    return jaccard_links(_read(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, text): of documents chosen by the checksum of their ids, the text repeats itself from some word on."""
    from starframe.llm import _native as N

    check = F.crc32(F.col("doc_id").cast("string"))
    rows = N.fixed(docs.select("doc_id", "text"), g=F.floor(check / 10), words=F.when(check % 10 == 0, N.words("text")))
    n = F.size("words")
    rows = N.fixed(rows, a=F.when(n > 0, (F.col("g") % n).cast("int")))
    rows = N.fixed(rows, p=(1 + F.floor((n - F.col("a")) / (3 + F.col("g") % 8))).cast("int"))
    word = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get("words", F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p"))))
    return rows.select("doc_id", F.when(n > 0, F.array_join(word, " ")).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from starframe.llm.periodic_runs import find_runs

    out = find_runs(with_planted_runs(_read(spark, sf_dir, "documents")))
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("before"), (-r["period"]).alias("less"))))
    line = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    lines = F.when(F.size("runs") > 0, F.concat(F.array_join(line, "\n"), F.lit("\n"))).otherwise("")
    out = out.select("doc_id", F.size("runs").cast("long").alias("n_runs"), longest.alias("m"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    return out.select("doc_id", "n_runs", (-F.col("m.before")).alias("start"), "m.length", (-F.col("m.less")).alias("period"), F.expr("1000 * m.length DIV -m.less").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation begins with the first turns of the one whose number is the next multiple of five below."""
    from starframe.llm import prefix_trie as T
    from starframe.llm._shared import cut

    rows = cut(T.ordered(T.digests(_read(spark, sf_dir, "conversations"))))
    ids = rows.groupBy("conv_id").agg(F.count("*").alias("n")).withColumns({"base": F.expr("conv_id - conv_id % 5"), "h": F.crc32(F.col("conv_id").cast("string")) % 9})
    ids = cut(ids.join(ids.select(F.col("conv_id").alias("base"), F.col("n").alias("held")), "base", "left").withColumn("m", F.least("h", F.coalesce("held", F.lit(0)))).select("conv_id", "base", "h", "m"))
    heads = rows.where("pos < 8 AND conv_id % 5 = 0").withColumnRenamed("conv_id", "base").join(ids.select("base", "conv_id", "m"), "base").where("pos < m")
    own = rows.join(ids.select("conv_id", "h", "m"), "conv_id").where("pos >= h").withColumn("pos", F.col("pos") - F.col("h") + F.col("m"))
    columns = ["conv_id", "pos", "t1", "t2", "bytes"]
    return T.trie(heads.select(*columns).unionByName(own.select(*columns)), ids)


_DEALT = (op1_suffix_dedup, op2_decontamination, op3_minhash_dedup, op4_substring_dedup, op5_url_filter, op6_quality_rules, op7_line_dedup, op8_language_id, op9_best_fit_packing, op10_license_scan, op11_ngram_jaccard_join, op12_periodic_runs, op13_prefix_trie)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in _DEALT}
_WORDS = r"x AS (SELECT doc_id, text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS n FROM documents)"


def _sql_quality() -> str:
    from starframe.llm.quality_rules import BOILERPLATE, SYMBOLS

    blank = r"NOT regexp_matches({}, '[^\x20\x09-\x0D]')".format
    bad = f"""((length(l) - length(translate(l, '{SYMBOLS}', ''))) * 10 > length(l) OR (length(l) - length(translate(l, '!?', ''))) * 8 > length(l)
 OR len(string_split_regex(l, ' [|»›•·] ')) > 4 OR (length(l) <= 200 AND regexp_matches(l, '{BOILERPLATE}')))"""
    return rf"""WITH {_WORDS},
w AS (SELECT doc_id, i, array_to_string(ws[i:i+4], ' ') AS s FROM x, unnest(range(1, n - 3)) AS t(i) WHERE n >= 5),
g AS (SELECT doc_id, i FROM w QUALIFY count(*) OVER (PARTITION BY doc_id, s) > 1),
r AS (SELECT doc_id, count(DISTINCT i + k) AS again FROM g, unnest(range(0, 5)) AS t(k) GROUP BY 1),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM documents),
f AS (SELECT doc_id, count(*) FILTER (NOT ({blank('l')})) - count(DISTINCT l) FILTER (NOT ({blank('l')})) AS dup, count(*) FILTER (NOT ({blank('l')}) AND {bad}) AS gone,
 coalesce(sum(length(l)) FILTER (NOT ({blank('l')})), 0) AS total, coalesce(sum(length(l)) FILTER (NOT ({blank('l')}) AND NOT {bad}), 0) AS rest FROM l GROUP BY 1),
m AS (SELECT x.doc_id, n::BIGINT AS n_words, length(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars, (length(coalesce(text, '')) - length(regexp_replace(coalesce(text, ''), '[#*$%&|<>]+', '', 'g')))::BIGINT AS n_symbols,
 coalesce(dup, 0)::BIGINT AS n_dup_lines, coalesce(again, 0)::BIGINT AS n_repeat_words, n < 10 OR 100 * coalesce(again, 0) > 20 * n AS base_failed, coalesce(gone, 0)::BIGINT AS n_removed_lines,
 CASE WHEN coalesce(total, 0) > 0 THEN rest::DOUBLE / total ELSE 1.0 END AS kept_share FROM x LEFT JOIN r USING (doc_id) LEFT JOIN f USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND kept_share >= 0.5 AS kept, n_removed_lines, kept_share FROM m"""


def _crc32(text: str) -> str:
    """The CRC-32 of a short ASCII text, bit by bit."""
    step = "lambda c, k: xor(c >> 1, (c & 1) * 3988292384)"
    return f"xor(list_reduce(string_split({text}, ''), lambda s, x: list_reduce(range(8), {step}, xor(s, ascii(x)::BIGINT)), 4294967295::BIGINT), 4294967295::BIGINT)"


_RUNS = rf"""{_WORDS.replace("x AS (", "y AS (")}, c AS (SELECT doc_id, ws, n, {_crc32("doc_id::VARCHAR")} AS h FROM y), d AS (SELECT *, h // 10 AS g, (h // 10) % greatest(n, 1) AS a FROM c), e AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM d),
x AS (SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(0, n), lambda i: ws[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END]) ELSE ws END AS ws FROM e),
w AS (SELECT doc_id, i - 1 AS i, hash(ws[i:i+5]) AS s FROM x, unnest(range(1, n - 4)) AS t(i) WHERE n >= 12),
m AS (SELECT u.doc_id, u.i, v.i - u.i AS q FROM w AS u JOIN w AS v ON u.doc_id = v.doc_id AND u.s = v.s AND v.i > u.i),
b AS (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS o FROM m),
f AS (SELECT doc_id, q, min(i) AS start, max(i) + 6 + q - min(i) AS length FROM b GROUP BY doc_id, q, o),
r AS (SELECT doc_id, start, length, min(q) AS period FROM f WHERE length >= greatest(12, 2 * q) GROUP BY 1, 2, 3),
z AS (SELECT doc_id, count(*) AS n_runs, max((length, -start, -period)) AS m, string_agg(concat(start, ',', length, ',', period, chr(10)), '' ORDER BY start, period) AS listed FROM r GROUP BY 1),
o AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM r),
k AS (SELECT x.doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) - 1 AS i FROM x),
l AS (SELECT k.doc_id, string_agg(word, ' ' ORDER BY k.i) FILTER (o.i IS NULL) AS kept FROM k LEFT JOIN o ON k.doc_id = o.doc_id AND k.i = o.i GROUP BY 1)
SELECT x.doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, (-m[2])::BIGINT AS start, m[1]::BIGINT AS length, (-m[3])::BIGINT AS period, (1000 * m[1] // -m[3])::BIGINT AS exponent_milli,
 sha256(coalesce(listed, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256 FROM x LEFT JOIN z USING (doc_id) LEFT JOIN l USING (doc_id)"""

_JACCARD = rf"""WITH RECURSIVE {_WORDS.replace("(text, '')", "(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '')")},
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i+3], ' ') AS g FROM x, unnest(range(1, greatest(n - 2, 2))) AS t(i) WHERE n > 0), z AS (SELECT doc_id, count(*) AS size FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s AS a JOIN s AS b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN z AS y ON y.doc_id = a JOIN z AS w ON w.doc_id = b WHERE 100 * c >= 85 * (y.size + w.size - c)),
r(a, b) AS (SELECT doc_id, doc_id FROM x UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT x.doc_id, coalesce(any_value(size), 0)::BIGINT AS n_shingles, min(r.b) AS component_id FROM x JOIN r ON r.a = x.doc_id LEFT JOIN z ON z.doc_id = x.doc_id GROUP BY x.doc_id"""

_TRIE = f"""WITH o AS (SELECT conv_id, coalesce(turn, -1) AS turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS pos, {{'role': coalesce(role, ''), 'text': coalesce(text, '')}} AS t FROM conversations WHERE conv_id IS NOT NULL),
b AS (SELECT conv_id, list(t ORDER BY pos) AS l, {_crc32("conv_id::VARCHAR")} % 9 AS h FROM o GROUP BY 1),
r AS (SELECT c.conv_id, list_concat(coalesce(x.l[1:c.h], []), c.l[c.h+1:]) AS l FROM b AS c LEFT JOIN b AS x ON x.conv_id = c.conv_id - c.conv_id % 5),
p AS (SELECT conv_id, d, len(l) = d AS last, sha256(to_json(l[1:d])::VARCHAR) AS k, CASE WHEN d > 0 THEN sha256(to_json(l[1:d-1])::VARCHAR) END AS pk, CASE WHEN d > 0 THEN strlen(l[d].text) ELSE 0 END AS size FROM r, unnest(range(0, len(l) + 1)) AS u(d)),
n AS (SELECT d, k, any_value(pk) AS pk, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(size) AS saved, coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (last), '') AS ends FROM p GROUP BY 1, 2),
c AS (SELECT pk, count(*) AS n_children FROM n WHERE d > 0 GROUP BY 1),
w AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN c ON c.pk = n.k),
s AS (SELECT p.k, count(*) FILTER (n_children = 0) AS n_leaves, sum(saved) AS saved_tokens FROM w JOIN p ON p.conv_id = w.conv_id AND p.d <= w.d GROUP BY 1)
SELECT w.conv_id, w.d::BIGINT AS depth, y.conv_id AS parent_conv_id, w.n_convs::BIGINT AS n_convs, w.n_children::BIGINT AS n_children, n_leaves::BIGINT AS n_leaves, saved_tokens::BIGINT AS saved_tokens, sha256(w.ends) AS ends_sha256
FROM w JOIN s ON s.k = w.k LEFT JOIN n AS y ON y.k = w.pk"""


ORACLE_SQL: dict[str, str] = {
    "op13_prefix_trie": _TRIE,
    "op11_ngram_jaccard_join": _JACCARD,
    "op12_periodic_runs": f"WITH {_RUNS}",
    "op4_substring_dedup": rf"""WITH {_WORDS}, w AS (SELECT doc_id, i, array_to_string(ws[i:i+12], ' ') AS s FROM x, unnest(range(1, n - 11)) AS t(i) WHERE n >= 13),
f AS (SELECT s, min(doc_id) AS m FROM w GROUP BY 1), h AS (SELECT w.doc_id, i FROM w JOIN f USING (s) WHERE m < w.doc_id), g AS (SELECT DISTINCT doc_id, i + k AS p FROM h, unnest(range(0, 13)) AS t(k)),
d AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS p FROM x),
k AS (SELECT d.doc_id, count(g.p) AS n_removed, string_agg(word, ' ' ORDER BY d.p) FILTER (g.p IS NULL) AS kept FROM d LEFT JOIN g ON d.doc_id = g.doc_id AND d.p = g.p GROUP BY 1),
s AS (SELECT a.doc_id, count(*) AS n_spans FROM g AS a LEFT JOIN g AS b ON a.doc_id = b.doc_id AND a.p = b.p + 1 WHERE b.p IS NULL GROUP BY 1)
SELECT x.doc_id, n::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256, coalesce(n_spans, 0)::BIGINT AS n_spans FROM x LEFT JOIN k USING (doc_id) LEFT JOIN s USING (doc_id)""",
    "op6_quality_rules": _sql_quality(),
}
