"""Exact top-k inner products by norm-bucketed retrieval.

Components become the integers floor(256 x), so every score is exact. Vectors are ordered by length
and parted by range into shards, a shard into buckets of like length. A query meets the buckets from
the longest on, with the k-th best score it has so far: over the lengths of query and bucket that is
the cosine a vector of the bucket must reach at least. Above one the bucket, and all shorter ones,
are left out. A high one prunes by coordinates: where a vector's component on the query's largest
coordinates lies outside the range that this cosine allows, found by search in a sorted list, it
can't reach it. A low one prunes by length alone, and what is left is multiplied in one block.

A task holds one shard, which its bytes bound, and reads the queries in batches; a first pass over
the longest vectors of all tells each query which shards it need not visit. Queries beyond a slice's
size meet their own copy of the shards, so that neither side of a task grows with the corpus.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import runs, written

SCALE = 256
BUCKET = 4096  # vectors of like length that share a threshold
SHARD_COMPONENTS = 1 << 25  # of a task's vectors
SLICE = 1 << 19  # queries that one copy of the shards serves
LEAST_SHARDS = 16  # for small tables, as far as each has a bucket
SEEDS = 4096  # longest vectors, for the first thresholds
HIGH = 0.8  # cosines from here on prune by coordinates
FOCUS = 3  # coordinates that a query is pruned by
QUERIES = 256  # that are multiplied at once

_LIMIT = 1 << 62
_NONE = np.iinfo(np.int64).min
_EASY = 1 << 50  # a score below it and a place in a bucket fit one integer
_SLACK = 1e-9  # of rounded lengths and cosines

_VECTORS = "vec_id long, z binary, norm double, is_query boolean"
_HITS = "query_id long, vec_id long, score long"


def quantised(x: np.ndarray) -> np.ndarray:
    """floor(256 x) as int64, held within 2^62."""
    with np.errstate(over="ignore"):
        return np.clip(np.floor(SCALE * x), -float(_LIMIT), float(_LIMIT)).astype(np.int64)


def _quantise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, zs, norms, asks = [], [], [], []
        for vec_id, x, ask in zip(*(batch.column(k) for k in ("vec_id", "embedding", "is_query")), strict=True):
            if x.values.null_count:
                continue
            x = x.values.to_numpy(zero_copy_only=False).astype(np.float64)
            if not np.isfinite(x).all():
                continue
            z = quantised(x)
            ids.append(vec_id.as_py())
            zs.append(z.astype("<i2" if np.abs(z).max(initial=0) < 1 << 15 else "<i8"))
            norms.append(float(np.sqrt(np.square(z.astype(np.float64)).sum())))
            asks.append(ask.as_py())
        # a leading byte says how wide the integers are
        blobs = pa.array([bytes([z.itemsize]) + z.tobytes() for z in zs], pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), blobs, pa.array(norms, pa.float64()), pa.array(asks, pa.bool_())], ["vec_id", "z", "norm", "is_query"])


def _matrix(blobs: list[bytes], dim: int) -> np.ndarray:
    """Vectors as rows of dim components; those a vector lacks are zero."""
    out = np.zeros((len(blobs), dim), np.int16 if all(b[0] == 2 for b in blobs) else np.int64)
    for row, blob in zip(out, blobs, strict=True):
        z = np.frombuffer(blob, f"<i{blob[0]}", offset=1)
        row[: len(z)] = z
    return out


def products(q: np.ndarray, v: np.ndarray, bound: float) -> np.ndarray:
    """Exact integer products of rows; bound is at least the product of their greatest lengths, and so of every partial sum."""
    if bound < 1 << 24:
        return (q.astype(np.float32) @ v.T.astype(np.float32)).astype(np.int64)
    if bound < 1 << 53:
        return (q.astype(np.float64) @ v.T.astype(np.float64)).astype(np.int64)
    exact = q.astype(object) @ v.T.astype(object)
    return np.clip(exact, -(2**63) + 1, 2**63 - 1).astype(np.int64)


def best_of(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k highest of each row, ties to the smaller id; ids ascend along the columns. _NONE is no score."""
    rows, n = scores.shape
    top = min(k, n)
    if n > k and np.abs(scores, where=scores != _NONE, out=np.zeros_like(scores)).max(initial=0) < _EASY:
        place = np.arange(n - 1, -1, -1)
        keys = np.where(scores == _NONE, _NONE, scores * n + place)
        at = np.argpartition(keys, n - top, axis=1)[:, n - top :]
    else:
        at = np.lexsort((np.broadcast_to(ids, scores.shape), ~scores), axis=1)[:, :top]
    found = np.take_along_axis(scores, at, 1)
    out = np.full((rows, k), _NONE), np.full((rows, k), np.iinfo(np.int64).max)
    out[0][:, :top], out[1][:, :top] = found, np.where(found == _NONE, np.iinfo(np.int64).max, ids[at])
    return out


class Bucket:
    """Vectors of like length, by vec_id."""

    def __init__(self, ids: np.ndarray, z: np.ndarray, norms: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.z, self.norms, self.longest = ids[order], z[order], norms[order], float(norms.max())
        self._lists: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def directions(self, f: int) -> np.ndarray:
        """Component f of the vectors' directions."""
        return self.z[:, f] / np.maximum(self.norms, 1e-300)

    def sorted_list(self, f: int) -> tuple[np.ndarray, np.ndarray]:
        if f not in self._lists:
            x = self.directions(f)
            order = np.argsort(x)
            self._lists[f] = x[order].astype(np.float32), order.astype(np.int16)
        return self._lists[f]

    def within(self, direction: np.ndarray, cosine: float) -> np.ndarray:
        """Vectors, in order, whose components on the direction's largest coordinates allow the cosine."""
        focus = np.argsort(-np.abs(direction))[:FOCUS]
        reach = math.acos(min(1.0, cosine))
        at = None
        for f in focus:
            angle = math.acos(max(-1.0, min(1.0, float(direction[f]))))
            low, high = math.cos(min(math.pi, angle + reach)) - 1e-6, math.cos(max(0.0, angle - reach)) + 1e-6
            if at is None:
                x, order = self.sorted_list(int(f))
                at = order[np.searchsorted(x, low) : np.searchsorted(x, high, side="right")]
            else:
                x = self.z[at, f] / np.maximum(self.norms[at], 1e-300)
                at = at[(x >= low) & (x <= high)]
        return np.sort(at)


def search(q: np.ndarray, q_ids: np.ndarray, q_norms: np.ndarray, floors: np.ndarray, buckets: list[Bucket], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Scores and ids of the k best of each query in buckets that get shorter; those under its floor may lack."""
    scores, ids = np.full((len(q), k), _NONE), np.full((len(q), k), np.iinfo(np.int64).max)
    longest = float(q_norms.max(initial=0))

    def offer(at: np.ndarray, found: np.ndarray, of: np.ndarray) -> None:
        found[q_ids[at][:, None] == of[None, :]] = _NONE
        some = (found >= np.maximum(scores[at, -1], _NONE + 1)[:, None]).any(1)
        if some.any():
            at = at[some]
            s, i = best_of(found[some], of, k)
            s, i = np.hstack([scores[at], s]), np.hstack([ids[at], i])
            order = np.lexsort((i, ~s), axis=1)[:, :k]
            scores[at], ids[at] = np.take_along_axis(s, order, 1), np.take_along_axis(i, order, 1)

    for bucket in buckets:
        limit = np.maximum(floors, np.where(scores[:, -1] == _NONE, -np.inf, scores[:, -1]))
        reach = q_norms * bucket.longest
        cosine = np.where(reach > 0, limit / np.where(reach > 0, reach, 1), np.where(limit > 0, np.inf, -np.inf))
        alive = cosine <= 1 + _SLACK
        if not alive.any():
            break
        high = alive & (cosine >= HIGH)
        low = np.flatnonzero(alive & ~high)
        if len(low):
            need = np.where(limit[low] > 0, limit[low] / np.maximum(q_norms[low], 1e-300), 0).min() * (1 - _SLACK)
            near = bucket.norms >= need
            offer(low, products(q[low], bucket.z[near], longest * bucket.longest), bucket.ids[near])
        for one in np.flatnonzero(high):
            near = bucket.within(q[one] / q_norms[one], float(cosine[one]) * (1 - _SLACK))
            if len(near):
                offer(np.array([one]), products(q[one : one + 1], bucket.z[near], longest * bucket.longest), bucket.ids[near])
    return scores, ids


def _buckets(ids: np.ndarray, z: np.ndarray, norms: np.ndarray) -> list[Bucket]:
    order = np.lexsort((ids, -norms))
    return [Bucket(ids[at], z[at], norms[at]) for at in (order[i : i + BUCKET] for i in range(0, len(order), BUCKET))]


def _columns(t: pa.Table | pa.RecordBatch, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.array(t.column("vec_id").to_pylist(), np.int64), _matrix(t.column("z").to_pylist(), dim), np.array(t.column("norm").to_pylist(), np.float64)


def norm_topk(vectors: DataFrame, is_query: Column, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score: for each row of vectors(vec_id, embedding) with is_query, the k rows of highest product.

    All of them where there are fewer; ties go to the smaller vec_id. A row without vec_id, and a
    vector that is null or holds a null or non-finite component, takes no part. Repeated rows count
    once. Different vectors under one vec_id are a row each, but none is the other's result, and as
    queries they share k places. An empty vector and a vector of zeros score 0; components that a
    shorter vector lacks are 0. A score that no long holds is the nearest long. Other columns are not
    read.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), F.coalesce(is_query, F.lit(False)).alias("is_query")).where("vec_id is not null and embedding is not null")
    n, asked, dim = rows.agg(F.count("*"), F.count_if("is_query"), F.coalesce(F.max(F.size("embedding")), F.lit(0))).first()
    if not asked:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    dim = max(dim, 1)
    shards = max(math.ceil(n * dim / SHARD_COMPONENTS), min(LEAST_SHARDS, math.ceil(n / BUCKET)))
    slices = math.ceil(asked / SLICE)

    # equal rows have equal keys, and so meet in one range; ties of length are parted by id
    ranged = rows.mapInArrow(_quantise, _VECTORS).repartitionByRange(shards, F.desc("norm"), "vec_id").sortWithinPartitions(F.desc("norm"), "vec_id", "z")

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            fresh = []
            for key in zip(batch.column("vec_id").to_pylist(), batch.column("z").to_pylist(), strict=True):
                fresh.append(key != last)
                last = key
            yield batch.filter(pa.array(fresh, pa.bool_()))

    held = written(ranged.mapInArrow(distinct, _VECTORS).withColumn("shard", F.spark_partition_id()), "vectors")
    longest = [(r.shard, r.norm) for r in held.groupBy("shard").agg(F.max("norm").alias("norm")).collect()]  # a row for 2^25 components
    seeds = held.orderBy(F.desc("norm"), "vec_id").limit(SEEDS).select("vec_id", "z", "norm").toArrow()
    seed_columns = _columns(seeds, dim)

    def floors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = _buckets(*seed_columns)
        for batch in batches:
            for start in range(0, batch.num_rows, QUERIES):
                part = batch.slice(start, QUERIES)
                ids, z, norms = _columns(part, dim)
                scores, _ = search(z, ids, norms, np.full(len(ids), -np.inf), first, k)
                floor = np.where(scores[:, -1] == _NONE, -np.inf, scores[:, -1])
                visits = [[s for s, length in longest if f <= 0 or q * length * (1 + _SLACK) >= f] for f, q in zip(floor, norms, strict=True)]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("vec_id", "z", "norm")), pa.array(floor), pa.array(visits, pa.list_(pa.int32()))], ["vec_id", "z", "norm", "floor", "visits"])

    queries = held.where("is_query").select("vec_id", "z", "norm").mapInArrow(floors, "vec_id long, z binary, norm double, floor double, visits array<int>")
    own_slice = F.pmod(F.xxhash64("vec_id", "z"), F.lit(slices)).cast("int")
    asking = queries.withColumn("shard", F.explode("visits")).select("shard", own_slice.alias("slice"), F.lit(1).alias("kind"), "vec_id", "z", "norm", "floor")
    offered = held.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1)))).select("shard", "slice", F.lit(0).alias("kind"), "vec_id", "z", "norm", F.lit(None).cast("double").alias("floor"))
    together = offered.union(asking).repartition(shards * slices, "shard", "slice").sortWithinPartitions("shard", "slice", "kind", F.desc("norm"), "vec_id")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts, buckets = None, [], None
        for run in _steps(batches):
            key, kind = (run.column("shard")[0].as_py(), run.column("slice")[0].as_py()), run.column("kind")[0].as_py()
            if key != now:
                now, parts, buckets = key, [], None
            if kind == 0:
                parts.append(_columns(run, dim))
                continue
            if buckets is None:
                buckets = _buckets(*(np.concatenate(x) for x in zip(*parts, strict=True))) if parts else []
                parts = []
            for start in range(0, run.num_rows, QUERIES):
                part = run.slice(start, QUERIES)
                ids, z, norms = _columns(part, dim)
                scores, found = search(z, ids, norms, np.array(part.column("floor").to_pylist(), np.float64), buckets, k)
                some = scores != _NONE
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, some.sum(1))), pa.array(found[some]), pa.array(scores[some])], ["query_id", "vec_id", "score"])

    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    hits = together.mapInArrow(meet, _HITS)
    return hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches cut where shard, slice or kind change."""
    for batch in batches:
        for run in runs(iter([batch]), ["shard", "slice", "kind"]):
            yield from run.to_batches()
