"""What the training-data operators share: tables, scratch space, words, graph components."""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# ASCII upper case, punctuation and controls; every other byte belongs to a word.
_SEPARATORS = bytes(b for b in range(128) if not chr(b).isalnum())
_TO_SPACE = bytes.maketrans(_SEPARATORS, b" " * len(_SEPARATORS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Texts may be long, so that Arrow batches are bounded by bytes; one setting for all operators, as plans run later than they are made."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as spark.checkpoint.dir names it.

    Where it is unset, a local session (as in tests) gets one of its own; a cluster must set it.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = f"/tmp/checkpoints/{spark.sparkContext.applicationId}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: it cuts the lineage and survives the loss of executors."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def words(text: str | None) -> list[bytes]:
    """Lower-case words of a whole text as UTF-8: ASCII white space, controls and punctuation part them."""
    return text.lower().encode("utf-8", "replace").translate(_TO_SPACE).split() if text else []


class WordHashes(dict):
    """64-bit hashes by word; a worker keeps those it met, up to a bound."""

    bound = 150_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.bound:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_HASHES = WordHashes()


def word_hashes(found: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_HASHES.__getitem__, found), np.uint64, len(found))


def mixed(x: np.ndarray) -> np.ndarray:
    """A finalising mix of 64-bit integers."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
        return x ^ (x >> np.uint64(33))


def shingle_hashes(found: list[bytes], n: int = 5) -> np.ndarray:
    """Hashes of all runs of n words in order; of the whole text where it has fewer, none if it has no word."""
    h = word_hashes(found)
    if not len(h):
        return h
    n = min(n, len(h))
    with np.errstate(over="ignore"):
        out = h[: len(h) - n + 1].copy()
        for k in range(1, n):
            out = out * np.uint64(0x9E3779B97F4A7C15) + h[k : len(h) - n + 1 + k]
    return mixed(out)


def text_key(found: list[bytes]) -> bytes | None:
    """128 bits that tell one sequence of words from another."""
    return xxhash.xxh3_128_digest(b" ".join(found)) if found else None


def batches_of(rows: Iterator[dict], schema: pa.Schema, size: int = 5000) -> Iterator[pa.RecordBatch]:
    """Rows as Arrow batches of a bounded number of rows."""
    held: list[dict] = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield pa.RecordBatch.from_pylist(held, schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Consecutive rows of equal keys, from batches that come sorted by them; a run may span batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(batch.schema.get_field_index(k)).to_pylist() for k in keys]
        rows = list(zip(*columns, strict=True))
        start = 0
        for i, row in enumerate(rows):
            if row != last:
                if i > start:
                    held.append(batch.slice(start, i - start))
                if held:
                    yield pa.Table.from_batches(held)
                held, start, last = [], i, row
        held.append(batch.slice(start))
    if held:
        yield pa.Table.from_batches(held)


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of edges(a, b), as (node, component): the least node of each.

    Alternating large-star and small-star steps: each points a node's neighbours at the least of
    them, so a chain of length n takes about log n rounds. A step is one grouping whose partial
    minimum runs before the shuffle and one join that may split hot nodes; every round is written,
    so nothing gathers in the driver and a lost executor costs one step.
    """
    now = written(edges.select("a", "b").where("a <> b").distinct(), "edges")

    def star(e: DataFrame, both: bool) -> DataFrame:
        if both:
            e = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        else:
            e = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = e.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        linked = e.join(least, "a")
        if both:
            linked = linked.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            linked = linked.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
        return linked.where("a <> b").distinct()

    def state(e: DataFrame) -> tuple:
        row = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        return tuple(row)

    before = state(now)
    for _ in range(rounds):
        now = written(star(star(now, True), False), "edges")
        after = state(now)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component"))


def passes_for(recall: float, chance: float) -> int:
    """Independent tries, each with the given chance, that reach a recall."""
    return max(1, math.ceil(math.log1p(-recall) / math.log1p(-chance))) if chance < 1 else 1


def heavy(counts: DataFrame, weight: str, total: int, share: int = 1000) -> tuple[DataFrame, DataFrame]:
    """counts parted in rows of weight over total / share, of which there are fewer than share, and the rest."""
    bound = total / share
    return counts.where(F.col(weight) > bound), counts.where(F.col(weight) <= bound)


def join_by_weight(rows: DataFrame, facts: DataFrame, key: str, weight: str, total: int, columns: list[str]) -> DataFrame:
    """rows left join facts by key, where a fact's weight is the number of its rows and total that of all.

    Keys of more than a thousandth of the rows would each gather in one task; there are fewer than a
    thousand of them, so they are broadcast, and their rows stay where they are.
    """
    many, few = heavy(facts.select(key, weight, *columns), weight, total)
    many = F.broadcast(many.drop(weight).withColumnRenamed(key, "heavy_key").withColumn("is_heavy", F.lit(True)))
    met = rows.join(many, rows[key].eqNullSafe(F.col("heavy_key")), "left")
    first = met.where("is_heavy").drop("heavy_key", "is_heavy")
    rest = met.where("is_heavy is null").drop("heavy_key", "is_heavy", *columns)
    return first.unionByName(rest.join(few.drop(weight), key, "left"))
