"""Exact vector retrieval under scopes (V4 to V9, K1, K10, F12, J1 to J5, ST11, W1, X5)."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import fold_sorted


@dataclass(frozen=True)
class SearchRequest:
    """VC7, V6, V8, M12: a checked request; k falls into 1 to 50."""

    vector: Sequence[float]
    k: int | None = 10
    min_similarity: float | None = None
    include_references: bool = False

    def __post_init__(self):
        v = list(self.vector)
        if not v or not all(isinstance(x, (int, float)) and math.isfinite(x) for x in v) or not any(v):
            raise ValueError("the query vector must be finite and not zero")
        if self.min_similarity is not None and not -1 <= self.min_similarity <= 1:
            raise ValueError("min_similarity lies between -1 and 1")
        object.__setattr__(self, "k", min(max(10 if self.k is None else self.k, 1), 50))


def valid_vector(v: Column, dimension: int) -> Column:
    """V4: the exact dimension, all components finite."""
    return F.coalesce((F.size(v) == dimension) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def dot(a: Column, b: Column) -> Column:
    """V7: the inner product in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def top_k(chunks: DataFrame, request: SearchRequest) -> DataFrame:
    """chunks(paper_id, chunk_index, embedding, ...) nearest to the query, ranked.

    The limit comes before the numbering, so each task keeps k rows and the window sees k.
    """
    query = F.array(*[F.lit(float(x)) for x in request.vector])
    near = chunks.where(valid_vector(F.col("embedding"), len(request.vector)) & (dot(F.col("embedding"), F.col("embedding")) > 0))
    near = near.withColumn("distance", 1 - cosine(F.col("embedding"), query)).drop("embedding")
    if request.min_similarity is not None:
        near = near.where(1 - F.col("distance") >= request.min_similarity)
    near = near.orderBy("distance", "paper_id", "chunk_index").limit(request.k)
    rank = F.row_number().over(Window.orderBy("distance", "paper_id", "chunk_index"))
    return near.withColumn("rank", rank).withColumn("similarity", 1 - F.col("distance"))


def searchable(papers: DataFrame, jobs: DataFrame, chunks: DataFrame, sections: DataFrame, embeddings: DataFrame, scope: DataFrame, references: bool = False) -> DataFrame:
    """Chunks of papers in scope that are ready and embedded in their current generation, outside reference lists."""
    ready = papers.where("status = 'ready'").join(scope, "paper_id", "left_semi").select("paper_id", "title", "completed_at")
    done = jobs.where("status = 'complete'").select("paper_id", F.col("source_completed_at").alias("generation"))
    live = ready.join(done, "paper_id").where(F.col("completed_at") == F.col("generation"))
    kinds = sections if references else sections.where("section_type <> 'references'")
    rows = chunks.join(live, "paper_id").join(kinds.select("section_id", "section_title", "section_type"), "section_id")
    return rows.join(embeddings.where("content_hash is not null").select("chunk_id", "embedding"), "chunk_id")


def coverage(papers: DataFrame, jobs: DataFrame, chunks: DataFrame) -> DataFrame:
    """ST11, J2, J9, A11: each paper's chunks and state of search."""
    counts = chunks.groupBy("paper_id").agg(F.count("*").alias("chunks"))
    rows = papers.join(counts, "paper_id", "left").join(jobs.select("paper_id", F.col("status").alias("job"), "source_completed_at"), "paper_id", "left")
    stale = ~F.col("source_completed_at").eqNullSafe(F.col("completed_at"))
    n = F.coalesce("chunks", F.lit(0))
    state = (
        F.when(F.col("status") == "failed", "processing_failed")
        .when(F.col("status") != "ready", "not_processed")
        .when(n == 0, "no_text")
        .when(F.col("job").isNull(), "not_indexed")
        .when(stale, "outdated")
        .when(F.col("job") == "complete", "searchable")
        .when(F.col("job") == "failed", "index_failed")
        .otherwise("indexing")
    )
    return rows.select("paper_id", n.alias("chunks"), state.alias("state"))


def embedding_input(title: Column, section: Column, text: Column, most: int = 300) -> Column:
    """V1: headed text to embed; null for blank text, which one character tells."""
    from ..functions.text import WS, collapse, ellipsis

    head = lambda name, c: F.when(collapse(c) != "", F.concat(F.lit(f"{name}: "), ellipsis(collapse(c), most)))
    top = F.concat_ws("\n", head("Title", title), head("Section", section))
    said = text.rlike(rf"[^{WS[1:]}")  # one character that is no white space
    return F.when(said, F.when(top == "", text).otherwise(F.concat(top, F.lit("\n\n"), text)))


def incremental_plan(current: DataFrame, stored: DataFrame) -> DataFrame:
    """V2, V3: which chunks(chunk_id, input) keep the vector that stored(chunk_id, content_hash) has."""
    hashed = current.withColumn("content_hash", F.sha2(F.col("input"), 256))
    old = stored.select("chunk_id", F.col("content_hash").alias("stored_hash"))
    return hashed.join(old, "chunk_id", "left").withColumn("action", F.when(F.col("content_hash").eqNullSafe(F.col("stored_hash")), "reuse").when(F.col("stored_hash").isNull(), "embed").otherwise("replace"))


# Characters a token before anything is known, the bounds of the estimate, the weight of the newest ratio and the margin.
FIRST, LEAST, MOST, WEIGHT, MARGIN = 3.0, 2.5, 4.0, 0.3, 0.9


def token_estimate(chars: Column, per_token: float = FIRST) -> Column:
    """V10."""
    return F.ceil(chars / F.lit(per_token)).cast("long")


def estimates(observed: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """A key's estimate of characters a token over observed(key, chars, tokens, ...) in order.

    A moving average of the ratios, which starts with the first, less a margin and within bounds; rows without characters or tokens
    say nothing, and a key without any other has no row. A step is factor * average + value, and so is any run of steps, so tasks
    fold their sorted rows into one such pair for each key and range, and the few pairs of a key are put together in order.
    """
    rows = observed.where("tokens > 0 and chars > 0").select(F.col(key).cast("string").alias(key), *order, (F.col("chars") / F.col("tokens")).alias("ratio"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, held, last = TaskContext.get().partitionId(), [], object()
        for batch in batches:
            for k, ratio in zip(batch.column(0).to_pylist(), batch.column(batch.num_columns - 1).to_pylist(), strict=True):
                if k != last:
                    held.append([k, 1.0, 0.0, ratio])
                    last = k
                run = held[-1]
                run[1], run[2] = run[1] * (1 - WEIGHT), run[2] * (1 - WEIGHT) + WEIGHT * ratio
        if held:
            kinds = [pa.string(), pa.float64(), pa.float64(), pa.float64()]
            key_, factor, value, first = (pa.array(x, t) for x, t in zip(zip(*held), kinds, strict=True))
            yield pa.RecordBatch.from_arrays([key_, pa.array([part] * len(held), pa.int32()), factor, value, first], [key, "part", "factor", "value", "first"])

    dealt = rows.repartitionByRange(key, *order).sortWithinPartitions(key, *order).mapInArrow(work, f"{key} string, part int, factor double, value double, first double")
    pairs = dealt.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("part", "factor", "value", "first"))).alias("runs"))
    average = F.aggregate("runs", F.element_at("runs", 1)["first"], lambda a, r: a * r["factor"] + r["value"])
    return pairs.select(key, F.least(F.lit(MOST), F.greatest(F.lit(LEAST), average * MARGIN)).alias("chars_per_token"))


def batches(rows: DataFrame, key: str, order: Sequence[str], size: str, most_items: int = 32, most_size: int = 240_000) -> DataFrame:
    """Sequential batches of a key's rows by number and total size, one row at a time in order."""
    at = rows.columns.index(size)

    def step(state: tuple[int, int, int], row: tuple) -> tuple[tuple, tuple]:
        n, total, batch = state
        full = n > 0 and (n + 1 > most_items or total + row[at] > most_size)
        state = (1, row[at], batch + 1) if full else (n + 1, total + row[at], batch)
        return state, (*row, state[2])

    kind = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes)
    return fold_sorted(rows, [key], [*order, size], lambda: (0, 0, 0), step, f"{kind}, batch int")


def zip_vectors(inputs: DataFrame, vectors: DataFrame, keys: Sequence[str]) -> DataFrame:
    """V5: inputs with the vector that came back at their place; a place without one, or one too many, fails the batch.

    inputs(batch, place, ...), vectors(batch, place, embedding).
    """
    both = inputs.withColumn("asked", F.lit(True)).join(vectors.withColumn("given", F.lit(True)), list(keys), "full")
    bad = both.groupBy(keys[0]).agg(F.bool_or(F.col("asked").isNull() | F.col("given").isNull()).alias("mismatch"))
    return both.where("asked").drop("asked", "given").join(bad, keys[0]).withColumn("embedding", F.when(~F.col("mismatch"), F.col("embedding")))


def in_active_space(rows: DataFrame, models: DataFrame) -> DataFrame:
    """V9: rows(model, ...) of the one active model; with none or several active, none."""
    active = models.where("active").groupBy().agg(F.count("*").alias("n"), F.min("model").alias("model")).where("n = 1").select("model")
    return rows.join(active, "model", "left_semi")
