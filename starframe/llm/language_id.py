"""Language ID (8) by compression: each text is encoded with one zstandard raw-content dictionary per language; the smallest wins.

Dictionaries are fitted on a bounded sample of labelled documents (``sample_docs`` of each language and ``sample_bytes`` bytes,
whole texts); every text is then encoded whole, in pieces of PIECE bytes, each with the dictionary, so that its share does not
shrink with the length.  ``margin`` is the lead of the best language over the next one, as a share of the latter's size; where it is
narrow the prediction is marked as rejected.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

_LETTER = regex.compile(r"\p{L}")
_REST = re.compile(r"[\W\d_]+")
_ENCODERS: dict[bytes, list] = {}
#: Bytes that are encoded at once.
PIECE = 1 << 17


def held_out() -> Column:
    """Documents that nothing is learned from: crc32 of the id as text leaves 2 when divided by 4 (a null id: not held out)."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, sample_docs: int = 100, sample_bytes: int = 8 << 20) -> dict[str, bytes]:
    """Raw-content dictionaries by language, from (doc_id, text, lang): ``sample_docs`` documents of each, chosen by a hash.

    The choice is made within each language, by id and text, and each task passes on as many rows at most; so the driver sees
    ``sample_docs`` texts of each language, however the rows are spread, and ``sample_bytes`` bytes of them: the choice ends before
    the text that would exceed that, and texts longer by themselves are not chosen.  Rows without a language or a text are left out.
    """
    known = docs.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"), F.xxhash64(F.col("doc_id").cast("string"), "text").alias("dice")).where("lang is not null and text is not null")
    known = known.where(F.octet_length("text") <= sample_bytes)
    chosen = known.withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("dice", "text"))).where(F.col("n") <= sample_docs)
    chosen = chosen.withColumn("total", F.sum(F.octet_length("text")).over(Window.partitionBy("lang").orderBy("n"))).where(F.col("total") <= sample_bytes)
    texts: dict[str, list[str]] = {}
    for r in chosen.orderBy("lang", "n").collect():
        texts.setdefault(r["lang"], []).append(r["text"])
    out = {lang: letters("\n".join(own)) for lang, own in texts.items()}
    return {k: v for k, v in out.items() if v.strip()}


def letters(text: str) -> bytes:
    """Lower-case words with one space between: case, digits and marks say nothing about the language."""
    return f" {_REST.sub(' ', text.lower())} ".encode()


def _compressors(level: int, contents: list[bytes]):
    import zstandard as z

    key = hashlib.blake2b(b"".join(hashlib.blake2b(c).digest() for c in contents) + bytes([level])).digest()
    if key not in _ENCODERS:
        made = []
        for c in contents:
            data = z.ZstdCompressionDict(c, dict_type=z.DICT_TYPE_RAWCONTENT)
            params = z.ZstdCompressionParameters.from_level(level, min_match=3, write_content_size=0, write_checksum=0, write_dict_id=0)
            data.precompute_compress(compression_params=params)
            made.append(z.ZstdCompressor(dict_data=data, compression_params=params))
        _ENCODERS[key] = made
    return _ENCODERS[key]


def _predict(names: list[str], contents: list[bytes], level: int, narrow: float, filter_only: bool = False):
    def predict(tables):
        encoders = _compressors(level, contents)
        for table in tables:
            lang, score, margin, kept = [], [], [], []
            for text in table.column("text").to_pylist():
                if text is None or not _LETTER.search(text):
                    lang.append("und")
                    score.append(0.0)
                    margin.append(0.0)
                    kept.append(False)
                    continue
                data = letters(text)
                parts = [data[k : k + PIECE] for k in range(0, len(data), PIECE)]
                size = np.array([sum(len(e.compress(p)) for p in parts) for e in encoders])
                best = int(np.argmin(size))
                lead = np.sort(size)[1] / size[best] - 1 if len(size) > 1 else 1.0
                lang.append(names[best])
                score.append(float(1 / np.exp2(-np.minimum(size - size[best], 1000.0)).sum()))
                margin.append(float(lead))
                kept.append(bool(lead >= narrow))
            if filter_only:
                keep = pa.array(kept, pa.bool_())
                yield table.filter(keep)
                continue
            yield pa.RecordBatch.from_arrays(
                [table.column("doc_id"), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(margin, pa.float64()), pa.array(kept, pa.bool_())],
                names=["doc_id", "lang_pred", "score", "margin", "accepted"],
            )

    return predict


def identify(docs: DataFrame, dictionaries: dict[str, bytes], level: int = 3, narrow: float = 0.005) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, lang_pred, score, margin, accepted.

    ``score`` (0 to 1) weighs the languages by two to the power of minus their size in bytes.  A text that is null or has no
    letter gives ``und``, score 0, and is not accepted; ties go to the first language by name and are not accepted.  Repeated
    rows get the same result each; other columns are ignored; an empty table gives no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    if not dictionaries:
        return docs.select("doc_id", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(0.0).alias("margin"), F.lit(False).alias("accepted"))
    names = sorted(dictionaries)
    return docs.mapInArrow(_predict(names, [dictionaries[n] for n in names], level, narrow), "doc_id long, lang_pred string, score double, margin double, accepted boolean")


def accepted_only(docs: DataFrame, dictionaries: dict[str, bytes], level: int = 3, narrow: float = 0.005) -> DataFrame:
    """The rows of ``docs``, all columns, whose language is accepted.  Rows are filtered where they are read; nothing is shuffled."""
    if not dictionaries:
        return docs.limit(0)
    names = sorted(dictionaries)
    return docs.mapInArrow(_predict(names, [dictionaries[n] for n in names], level, narrow, True), docs.schema)
