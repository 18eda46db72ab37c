"""URL filters (5): gradient-boosted trees on lexical features of URLs, trained from labelled URLs, after a list of rules.

Features: lengths, depth, digit ratio, entropy, parameter counts, and statistics of the host's suffix.  All are column expressions,
and training and scoring are Spark ML's, so no Python runs on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (host, path, verdict); fixed by the contract of the query.
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FEATURES = ("url_length", "host_length", "path_length", "depth", "host_labels", "digit_ratio", "host_digit_ratio", "hyphens", "entropy", "host_entropy", "parameters", "query_length", "has_fragment", "is_https", "longest_label", "suffix_share", "suffix_bad")


def parts(urls: DataFrame, column: str = "url") -> DataFrame:
    """Adds host (A-Z lower-cased) and path; both empty where the URL is null or has no ``://``."""
    rest = F.regexp_extract(F.coalesce(F.col(column).cast("string"), F.lit("")), "(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(rest, "(?s)^([^/?#]*)", 1), _UPPER, _LOWER)
    return urls.withColumn("host", host).withColumn("path", F.regexp_extract(rest, "(?s)^[^/?#]*([^?#]*)", 1))


def rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits (or null), and its verdict.  A rule fits its host and all subdomains if the path starts with its."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, v).otherwise(verdict)
    return name, verdict


def _entropy(text: Column) -> Column:
    """Bits per character."""
    n = F.greatest(F.length(text), F.lit(1)).cast("double")
    share = F.transform(F.array_distinct(F.split(text, "")), lambda c: (F.length(text) - F.length(F.replace(text, c, F.lit("")))) / n)
    return F.aggregate(share, F.lit(0.0), lambda a, p: a - F.when(p > 0, p * F.log2(p)).otherwise(0.0))


def features(urls: DataFrame, suffixes: DataFrame | None = None, column: str = "url") -> DataFrame:
    """Adds the lexical features to ``urls`` that have host and path.  ``suffixes`` (suffix, suffix_share, suffix_bad): statistics."""
    url = F.coalesce(F.col(column).cast("string"), F.lit(""))
    low, host, path = F.lower(url), F.col("host"), F.col("path")
    query = F.regexp_extract(url, "(?s)\\?([^#]*)", 1)
    digits = lambda t: (F.length(t) - F.length(F.translate(t, "0123456789", ""))) / F.greatest(F.length(t), F.lit(1))
    count = lambda t, c: (F.length(t) - F.length(F.translate(t, c, ""))).cast("double")
    labels = F.split(host, "\\.")
    out = urls.withColumns(
        {
            "suffix": F.substring_index(host, ".", -1),
            "url_length": F.length(url).cast("double"), "host_length": F.length(host).cast("double"), "path_length": F.length(path).cast("double"),
            "depth": count(F.regexp_replace(path, "/+$", ""), "/"), "host_labels": F.size(labels).cast("double"),
            "digit_ratio": digits(url), "host_digit_ratio": digits(host), "hyphens": count(host, "-"),
            "entropy": _entropy(low), "host_entropy": _entropy(host),
            "parameters": F.when(query == "", 0.0).otherwise(count(query, "&") + 1), "query_length": F.length(query).cast("double"),
            "has_fragment": F.contains(url, F.lit("#")).cast("double"), "is_https": low.startswith("https").cast("double"),
            "longest_label": F.array_max(F.transform(labels, lambda x: F.length(x))).cast("double"),
        }
    )
    if suffixes is None:
        return out
    return out.join(suffixes, "suffix", "left").fillna(0.0, ["suffix_share", "suffix_bad"])


class UrlFilter:
    """A fitted filter: ``fit`` from labelled URLs, ``judge`` for any."""

    def __init__(self, model, assembler, suffixes: DataFrame, threshold: float):
        self.model, self.assembler, self.suffixes, self.threshold = model, assembler, suffixes, threshold

    @staticmethod
    def fit(labelled: DataFrame, sample: int = 20_000, trees: int = 10, depth: int = 4, threshold: float = 0.5) -> "UrlFilter | None":
        """From (url, bad 0/1): equal rows are made one, weighted by their number, before about ``sample`` of them are chosen by a hash,
        so a URL that is repeated often is one row of the sample.  None without two classes.

        Suffix statistics come from the same rows; a row's own label is left out of the statistic that it is trained on.
        """
        from pyspark.ml.classification import GBTClassifier
        from pyspark.ml.feature import VectorAssembler

        from starframe.llm._shared import cut

        rows = labelled.where(F.col("url").isNotNull() & F.col("bad").isNotNull()).select(F.col("url").cast("string").alias("url"), F.col("bad").cast("double").alias("bad"))
        rows = rows.groupBy("url", "bad").agg(F.count("*").cast("double").alias("weight"))
        n = rows.count()
        share = min(1.0, sample / max(n, 1))
        rows = cut(parts(rows.where(F.pmod(F.xxhash64("url", "bad", F.lit(5)), F.lit(1 << 30)) < int(share * (1 << 30)))))
        total, classes = rows.agg(F.sum("weight"), F.countDistinct("bad")).first()
        if classes < 2:
            return None
        suffix = F.substring_index("host", ".", -1)
        stats = cut(rows.groupBy(suffix.alias("suffix")).agg(F.sum("weight").alias("n"), F.sum(F.col("weight") * F.col("bad")).alias("k")))
        # As many rows as the sample has, at most: small enough for every executor.
        suffixes = F.broadcast(stats.select("suffix", (F.col("n") / total).alias("suffix_share"), (F.col("k") / F.col("n")).alias("suffix_bad")))
        assembler = VectorAssembler(inputCols=list(FEATURES), outputCol="features", handleInvalid="keep")
        others = F.when(F.col("n") > F.col("weight"), (F.col("k") - F.col("weight") * F.col("bad")) / (F.col("n") - F.col("weight"))).otherwise(0.0)
        seen = features(rows, suffixes).join(F.broadcast(stats), "suffix").withColumn("suffix_bad", others)
        train = cut(assembler.transform(seen).select("features", "bad", "weight").coalesce(4))
        gbt = GBTClassifier(labelCol="bad", featuresCol="features", weightCol="weight", maxIter=trees, maxDepth=depth, maxBins=32, stepSize=0.2, minInstancesPerNode=25, seed=5)
        return UrlFilter(gbt.fit(train), assembler, suffixes, threshold)

    def score(self, urls: DataFrame) -> DataFrame:
        """Adds bad_score (0 to 1) to ``urls`` that have host and path; other columns stay."""
        from pyspark.ml.functions import vector_to_array

        made = self.model.transform(self.assembler.transform(features(urls, self.suffixes)))
        return made.withColumn("bad_score", vector_to_array("probability")[1]).drop("features", "probability", "rawPrediction", "prediction", "suffix", *FEATURES)


def judge(urls: DataFrame, model: UrlFilter | None, rules=RULES) -> DataFrame:
    """Per row of ``urls`` (with a column url): all its columns, host, path, rule, verdict (allow or block), bad_score.

    The longest rule that fits decides; else the model does (without one: allow).  Works row by row: repeated rows get the same
    result; a null URL has empty parts, no rule, and the model's verdict; columns with the names of results are replaced, others of
    any name stay.
    """
    results = ("host", "path", "rule", "verdict", "bad_score")
    kept = [c for c in urls.columns if c not in results]
    # The caller's columns travel as one, so that none clashes with a feature.
    own = parts(urls.select(F.struct(*kept).alias("row"), F.col("url").cast("string").alias("url")))
    scored = model.score(own) if model else own.withColumn("bad_score", F.lit(0.0))
    name, verdict = rule(F.col("host"), F.col("path"), rules)
    limit = model.threshold if model else 0.5
    decided = F.coalesce(verdict, F.when(F.col("bad_score") >= limit, "block").otherwise("allow"))
    return scored.select("row.*", "host", "path", name.alias("rule"), decided.alias("verdict"), "bad_score")
