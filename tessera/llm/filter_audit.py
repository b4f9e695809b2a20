"""Filter interaction audit by contractions of a contingency tensor.

Five filters give each document five bits. Per part its documents are counted by these bits, which
is a tensor of 2 x 2 x 2 x 2 x 2 (0 passes, 1 fails, an axis a filter); every number of every order
and step is then one contraction, in which each axis selects pass ([1, 0]), fail ([0, 1]) or all
([1, 1]). The corpus is read once, however many orders there are.

Texts stay in the task that reads them: it sends a 32-byte hash and the bits. Copies are told by that
hash. Counts are summed before every shuffle, so that one text on a third of all rows, or one part of
all, is a few rows a task by the time that it gathers.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import small_batches

FILTERS = "ABCDE"
# The limits of the filters A to D.
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 200, 50, 3
_ODD = re.compile(rb"[#$%&*|]")

_SPACE = re.compile(rb"[\x20\x09-\x0D]")
_CAPITALS = bytes(range(ord("A"), ord("Z") + 1))
_CONTINUED = bytes(range(0x80, 0xC0))  # bytes of UTF-8 that begin no code point
_PIECE = 1 << 20

_DIGEST = "doc_id long, part string, text_key binary, bits int"
_COUNTS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
_REPORT = "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in _COUNTS)


def words_of(text: bytes) -> tuple[int, int]:
    """Number of words and of distinct words; a very long text is cut in pieces at white space, so that only its distinct words are held."""
    if len(text) <= _PIECE:
        found = text.split()  # bytes part at exactly 0x20 and 0x09 to 0x0D
        return len(found), len(set(found))
    n, seen, start = 0, set(), 0
    while start < len(text):
        cut = _SPACE.search(text, start + _PIECE)
        end = cut.start() if cut else len(text)
        found = text[start:end].split()
        n, start = n + len(found), end
        seen.update(found)
    return n, len(seen)


def failures(text: bytes) -> int:
    """The bits of A to D: 1, 2, 4 and 8 for a filter that the text fails."""
    n, distinct = words_of(text)
    capitals = len(text) - len(text.translate(None, _CAPITALS))
    points = len(text.translate(None, _CONTINUED))
    return (n < LEAST_WORDS) + 2 * (100 * distinct < LEAST_DISTINCT * n) + 4 * (100 * capitals > MOST_CAPITALS * points) + 8 * (_ODD.search(text) is not None)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys, bits = [], []
        for text in batch.column("text"):
            text = text.as_py()
            keys.append(hashlib.sha256(text).digest())
            bits.append(failures(text))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("part"), pa.array(keys, pa.binary()), pa.array(bits, pa.int32())], ["doc_id", "part", "text_key", "bits"])


def _selections() -> tuple[list[tuple[str, int]], dict[str, np.ndarray]]:
    """(order, step) of every row, and for each count its selection: rows x 5 axes x (pass, fail)."""
    rows, picks = [], {k: [] for k in ("kept", "removed", "fails", "unique")}
    passes, fails, either = (1, 0), (0, 1), (1, 1)
    for order in itertools.permutations(range(len(FILTERS))):
        for k, own in enumerate(order):
            rows.append(("".join(FILTERS[i] for i in order), k + 1))
            before = order[:k]
            picks["kept"].append([passes if i in before or i == own else either for i in range(len(FILTERS))])
            picks["removed"].append([passes if i in before else fails if i == own else either for i in range(len(FILTERS))])
            picks["fails"].append([fails if i == own else either for i in range(len(FILTERS))])
            picks["unique"].append([fails if i == own else passes for i in range(len(FILTERS))])
    return rows, {k: np.array(v, np.int64) for k, v in picks.items()}


def contract(tensor: np.ndarray, picks: np.ndarray) -> np.ndarray:
    """Sums of a tensor of 2^5 over each row of selections."""
    return np.einsum("abcde,sa,sb,sc,sd,se->s", tensor, *(picks[:, k] for k in range(picks.shape[1])))


def _report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows, picks = _selections()
    orders, steps = [o for o, _ in rows], [s for _, s in rows]
    own = np.array([FILTERS.index(o[s - 1]) for o, s in rows])
    for batch in batches:
        for row in batch.to_pylist():
            tensors = {k: np.zeros(1 << len(FILTERS), np.int64) for k in ("n", "good", "toxic")}
            for cell in row["cells"]:
                for k, tensor in tensors.items():
                    tensor[cell["bits"]] = cell[k]
            # bit 0 is filter A and the last axis of a reshape, so the axes are turned over
            n, good, toxic = (t.reshape((2,) * len(FILTERS)).transpose() for t in tensors.values())
            removed = contract(n, picks["removed"])
            out = {
                "kept": contract(n, picks["kept"]), "removed": removed, "redundant": contract(n, picks["fails"]) - removed, "unique_fails": contract(n, picks["unique"]),
                "good_lost": contract(good, picks["removed"]), "toxic_lost": contract(toxic, picks["removed"]),
                "shapley": np.array([removed[own == k].sum() for k in range(len(FILTERS))])[own],
            }
            yield pa.RecordBatch.from_arrays([pa.array([row["part"]] * len(rows)), pa.array(orders), pa.array(steps, pa.int32()), *(pa.array(out[c]) for c in _COUNTS)], ["part", "filter_order", "step", *_COUNTS])


def cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, bits (five), n, good, toxic: the documents by part and by what they fail.

    E holds for a document whose text stands under a smaller doc_id, wherever that one went. A null
    text is empty, a null lang the part of the empty string; a null doc_id has no smaller one and is
    none, and has no label. Of several labels of a document any that says 1 counts. Repeated rows of
    one doc_id count each, and do not fail E against each other.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))
    told = rows.mapInArrow(_digest, _DIGEST)
    said = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False)).cast("int")).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False)).cast("int")).alias("toxic"))
    told = told.join(said, "doc_id", "left").na.fill(0, ["good", "toxic"])
    kinds = ["text_key", "bits", "part", "good", "toxic"]  # a text has few of them, however often it stands
    by_id = told.groupBy("doc_id", *kinds).agg(F.count("*").alias("n"))
    by_text = by_id.groupBy(*kinds).agg(F.sum("n").alias("n"), F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n"))).alias("first"), F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("unnamed"))
    least = F.min("first.doc_id").over(Window.partitionBy("text_key"))
    by_text = by_text.withColumn("clean", F.col("unnamed") + F.when(F.col("first.doc_id") == least, F.col("first.n")).otherwise(0))
    split = by_text.select("part", "good", "toxic", F.explode(F.array(F.struct(F.col("bits"), F.col("clean").alias("n")), F.struct((F.col("bits") + 16).alias("bits"), (F.col("n") - F.col("clean")).alias("n")))).alias("cell"))
    split = split.select("part", "good", "toxic", "cell.bits", "cell.n")
    return split.groupBy("part", "bits").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("good")).alias("good"), F.sum(F.col("n") * F.col("toxic")).alias("toxic"))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """What each step of all 120 orders of the filters keeps and removes, per lang of docs(doc_id, text, lang).

    Other columns are not read. An empty table has no part and so no row; a part has 600 rows, zeros
    included.
    """
    by_part = cells(docs, labels).groupBy("part").agg(F.collect_list(F.struct("bits", "n", "good", "toxic")).alias("cells"))
    return by_part.mapInArrow(_report, _REPORT)
