"""License scans (10): MinHash bands over overlapping text windows retrieve templates; exact shingle containment verifies them.

A template of n shingles has windows of the next power of two of them, a quarter of that apart, so wherever a copy stands some
window holds it up to an eighth of the width at either end; what other templates there are makes no difference to its windows.
Only shingles that stand in a template are kept of the corpus; a window's MinHash is of those of templates of its size.  It is
compared with a template's by ``bands`` values of ``rows`` rows each: at a Jaccard similarity s they meet with probability
1 - (1 - s**rows)**bands; with 24 bands of one row that is 0.9998 at s = 0.3 and over 0.999999 at s = 0.5.  A hit only gives the
place: the template's shingles are counted over the window and as much text again on either side, so no place of a copy loses any
of it.  Templates are tables like the corpus: nothing of them goes through the driver.  Column expressions and joins only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starframe.llm import _native as N
from starframe.llm._shared import cut

#: Below this many bytes a table whose rows were counted is broadcast; beyond, Spark shuffles both sides.
BROADCAST_BYTES = 32 << 20

#: Notices as they stand in files and at the foot of pages (fixed texts of their licences).
NOTICES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "MIT": "Released under the MIT License.",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "BSD-3-Clause-text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "MPL-2.0-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
}


def notices(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(sorted(NOTICES.items()), "license string, text string")


def read_templates(spark: SparkSession, path: str) -> DataFrame:
    """(license, text) of a folder with one text file for each licence, named after it."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), "value")
    return files.select(F.regexp_replace("file", "\\.txt$", "").alias("license"), F.col("value").alias("text"))


def _hashed(df: DataFrame, size: int) -> DataFrame:
    return N.fixed(N.fixed(df, _w=N.hashes(N.folded_words("text"))), sh=N.shingles("_w", size))


def _small(df: DataFrame, bytes_each: int) -> DataFrame:
    """Broadcast if its counted rows are few enough; else Spark shuffles both sides."""
    return F.broadcast(df) if df.count() * bytes_each < BROADCAST_BYTES else df


def _signature(df: DataFrame, keys: list[str], bands: int, rows: int) -> DataFrame:
    """``keys`` and band of the MinHash of the shingles ``s`` of each group: a row for each band, of ``rows`` minima each."""
    least = df.groupBy(*keys).agg(*(F.min(F.xxhash64("s", F.lit(k))).alias(f"m{k}") for k in range(bands * rows)))
    band = F.array(*(F.xxhash64(*(F.col(f"m{b * rows + k}") for k in range(rows)), F.lit(b), F.col("g")) for b in range(bands)))
    return least.select(*keys, F.explode(band).alias("band"))


def _templates(templates: DataFrame, size: int) -> DataFrame:
    """A row for each distinct shingle ``s`` of a template: t (which), license, n (such shingles), g (class of length), s."""
    known = templates.select(F.col("license").cast("string").alias("license"), F.col("text").cast("string").alias("text"))
    known = _hashed(known, size).select("license", F.xxhash64("license", "text").alias("t"), F.array_distinct("sh").alias("own"), F.ceil(F.log2(F.size("sh"))).cast("int").alias("g"))
    return cut(known.where("size(own) > 0").dropDuplicates(["license", "t"]).select("license", "t", F.size("own").alias("n"), "g", F.explode("own").alias("s")))


def scan(docs: DataFrame, templates: DataFrame | None = None, containment: float = 0.8, size: int = 5, bands: int = 24, rows: int = 1) -> DataFrame:
    """Licences found in ``docs`` (doc_id, text): doc_id, license, containment, n_windows; one row for each document and licence.

    ``templates`` (license, text) may be of any number and length; one pass over ``docs`` serves all.  A licence is found if a
    window and a width on either side hold ``containment`` of its shingles (``size`` words, lower case, letters and digits; a
    shorter notice is one shingle of all its words, found only in texts of so many words).  ``n_windows`` counts such windows of
    the document's distinct texts.  Texts that are null or without words have no licence; rows that share a doc_id are one
    document (null is one, too); several templates of one name are one licence, of which the best counts; a document has a row for
    each licence that it holds, so there are no ties; other columns are ignored; with no documents or templates the result is empty.
    """
    known = _templates(templates if templates is not None else notices(docs.sparkSession), size)
    named = known.select("t", "license", "n", "g").distinct()
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    text = _hashed(text.withColumns({"h": F.xxhash64("text", F.col("doc_id").isNull()), "none": F.col("doc_id").isNull(), "d": F.coalesce("doc_id", F.lit(0))}), size)
    # Shingles of no template can't count for any: exact, and few rows are left after it.
    every = text.select("d", "h", "none", F.size("sh").alias("size"), F.posexplode("sh").alias("pos", "s"))
    hits = cut(every.join(_small(known.select("s", "g").distinct(), 24), "s").withColumn("width", F.expr("1 << g")))

    # The windows that hold a shingle: those that start at a multiple of the step, and the last one.
    step, last = F.greatest(F.expr("width DIV 4").cast("int"), F.lit(1)), F.greatest(F.col("size") - F.col("width"), F.lit(0))
    least = F.greatest(F.ceil((F.col("pos") - F.col("width") + 1) / step).cast("int"), F.lit(0))
    most = F.floor(F.least("pos", last) / step).cast("int")
    starts = F.when(least <= most, F.transform(F.sequence(least, most), lambda k: k * step)).otherwise(F.array().cast("array<int>"))
    starts = F.when(F.col("pos") >= last, F.array_union(starts, F.array(last))).otherwise(starts)
    windows = hits.select("d", "h", "none", "g", "s", F.explode(starts).alias("start"))
    index = _signature(known, ["t", "g"], bands, rows).select("t", "band")
    place = ["d", "h", "none", "g", "start"]
    met = _signature(windows, place, bands, rows).join(_small(index, 24), "band").select(*place, "t").distinct()

    # A window and a width on either side meet the hits by bins of a width; then the template's own shingles are counted.
    width = F.expr("1 << g")
    met = met.withColumns({"from": F.col("start") - width, "to": F.col("start") + 2 * width})
    met = met.withColumn("bin", F.explode(F.sequence(F.floor(F.col("from") / width), F.floor((F.col("to") - 1) / width))))
    near = hits.select("d", "h", "g", "s", "pos", F.floor(F.col("pos") / F.col("width")).alias("bin")).join(met, ["d", "h", "g", "bin"]).where("pos >= from AND pos < to")
    held = near.join(_small(known.select("t", "s"), 24), ["t", "s"]).groupBy("d", "h", "none", "t", "start").agg(F.countDistinct("s").alias("held"))
    found = held.join(_small(named, 64), "t").withColumn("containment", F.col("held") / F.col("n")).where(F.col("containment") >= containment)
    out = found.groupBy("d", "none", "license").agg(F.max("containment").alias("containment"), F.countDistinct("h", "start").alias("n_windows"))
    return out.select(F.when(~F.col("none"), F.col("d")).alias("doc_id"), "license", "containment", "n_windows")
