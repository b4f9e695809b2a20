"""Language ID by compression: a text belongs to the language whose zstandard dictionary makes it smallest.

Dictionaries are raw content: normalised texts of labelled rows, a bounded number of bytes a language.
Compressed sizes are whole bytes, which is coarse for short texts, so a text is compressed with two
dictionaries a language, and the mean size counts. Texts are compressed in pieces, each with the
dictionaries afresh, so that all of a text has a say.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches, words

DICTIONARY_BYTES = 64 << 10
DICTIONARIES = 2
BUCKETS = 256  # labelled texts a language that the driver sees at most, each of up to DICTIONARY_BYTES characters
LANGUAGES = 500  # that are learned at most; each has its dictionaries in every task
PIECE = 64 << 10  # bytes of a text that are compressed at once, so that the dictionaries stay within the window
UNDETERMINED = "und"


def normalised(text: str | None) -> bytes:
    """Lower-case words one space apart; nothing where a text is null or has no letter."""
    found = words(text)
    if not found:
        return b""
    joined = b" ".join(found)
    if not joined.translate(None, b"0123456789 "):
        return b""
    if joined.isascii() or any(c.isalpha() for c in text):
        return joined
    return b""


def learn(labelled: DataFrame, dictionary_bytes: int = DICTIONARY_BYTES, dictionaries: int = DICTIONARIES) -> dict[str, list[bytes]]:
    """Dictionaries by language from labelled(text, lang); the sample is bounded by dictionary_bytes, dictionaries and BUCKETS.

    For each language and each hash bucket the text of least hash counts, which partial aggregation finds
    without a shuffle of the texts; of a text longer than a dictionary a window at a hashed place. Texts
    fill the dictionaries in hash order, those of 200 to 4,000 characters first. Rows without text or lang
    teach nothing, repeated ones once; no rows give no dictionaries; other columns are ignored. More than
    LANGUAGES values of lang are an error, as what reaches the driver would grow with them.
    """
    rows = labelled.where("text is not null and lang is not null and length(text) > 0")
    rows = rows.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).withColumn("h", F.xxhash64("text"))
    if rows.select("lang").distinct().limit(LANGUAGES + 1).count() > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages are labelled; say which ones to learn")
    size = F.length("text")
    window = F.when(size > dictionary_bytes, F.substr("text", F.pmod("h", size - dictionary_bytes).cast("int") + 1, F.lit(dictionary_bytes))).otherwise(F.col("text"))
    # short enough that a bucket's winner fits a dictionary many times over, where a language has such texts
    least = F.min(F.struct(F.when(size.between(200, 4000), 0).otherwise(1).alias("odd"), "h", window.alias("text")))
    picked = rows.groupBy("lang", F.pmod("h", F.lit(BUCKETS)).alias("bucket")).agg(least.alias("least")).select("lang", "least.*").collect()
    out: dict[str, list[bytes]] = {}
    for lang in sorted({r["lang"] for r in picked}):
        texts = [normalised(r["text"]) for r in sorted((r for r in picked if r["lang"] == lang), key=lambda r: (r["odd"], r["h"]))]
        whole, n = [], 0
        for text in texts:
            if n and n + len(text) > dictionary_bytes * dictionaries:
                continue
            whole.append(text)
            n += len(text) + 1
        out[lang] = [b" ".join(whole[k::dictionaries]) or b" ".join(whole) for k in range(dictionaries)]
    return out


def sizes_by(dictionaries: dict[str, list[bytes]]):
    """A function from a text to its compressed bytes for each language, above those of an empty text."""
    import zstandard

    # lazy matching of three bytes or more: short matches are what tells languages apart
    params = zstandard.ZstdCompressionParameters(window_log=20, chain_log=17, hash_log=17, search_log=3, min_match=3, target_length=16, strategy=zstandard.STRATEGY_LAZY2, write_content_size=0, write_checksum=0, write_dict_id=0)
    made = []
    for lang in sorted(dictionaries):
        own = []
        for content in dictionaries[lang]:
            known = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            known.precompute_compress(compression_params=params)
            own.append(zstandard.ZstdCompressor(dict_data=known, compression_params=params).compress)
        made.append(own)

    def sizes(text: bytes) -> np.ndarray:
        n = max(1, -(-len(text) // PIECE))
        pieces = [text[len(text) * k // n : len(text) * (k + 1) // n] for k in range(n)]
        return np.array([sum(len(f(piece)) for f in own for piece in pieces) / len(own) for own in made])

    return sizes


def identify(docs: DataFrame, dictionaries: dict[str, list[bytes]], margin: float = 0.002) -> DataFrame:
    """docs with lang_pred, score and rejected; a column of docs by one of these names gives way.

    lang_pred is the language of the least size, the first by name on a tie, and `und` for a null text or
    one without letters. score is the best language's weight when each loses two to the power of the
    bits by which it is larger, a byte of difference counting as one bit. rejected says that the text is
    `und` or that the second language lies within margin of the best size. With no dictionaries every text
    is `und`. Repeated rows are kept, and an empty table gives an empty table.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(dictionaries)
    names = sorted(dictionaries)
    kind = "struct<lang_pred: string, score: double, rejected: boolean>"

    @F.pandas_udf(kind)
    def predict(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        sizes = sizes_by(shared.value) if names else None
        for batch in texts:
            out = []
            for text in batch:
                plain = normalised(text) if text and names else b""
                if not plain:
                    out.append((UNDETERMINED, 0.0, True))
                    continue
                n = sizes(plain)
                best = int(n.argmin())
                weight = 1 / float(np.exp2(np.maximum(n.min() - n, -60.0)).sum())
                second = np.partition(n, 1)[1] if len(n) > 1 else np.inf
                out.append((names[best], weight, bool(second - n[best] <= margin * n[best])))
            yield pd.DataFrame(out, columns=["lang_pred", "score", "rejected"])

    # a filter on what it says would else run it a second time
    told = docs.select(F.struct("*").alias("document"), predict.asNondeterministic()(F.col("text").cast("string")).alias("told"))
    return told.select(*[F.col("document")[c].alias(c) for c in docs.columns if c not in ("lang_pred", "score", "rejected")], "told.*")


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of a doc_id as text, modulo parts."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(parts))
