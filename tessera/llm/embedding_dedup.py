"""Embedding near-dedup by sorted projection passes.

1. Equal vectors of a label form a class; from here on a class stands once, by its least vec_id.
2. A vector's concatenated random hyperplane bits order its label lexicographically. The leading bits,
   as many as leave about `CELL` classes together, cut the order into cells, once a deal; how often
   vectors are dealt follows from the chance that a linked pair agrees on these bits, for a target
   recall. A cell over `CELL` classes is split into blocks, and each pair of blocks is a group.
3. A group sorts its classes by further bits, pass after pass, and compares neighbouring windows. It
   stops when the passes made would miss less than the target leaves, by the share of known links that
   the last passes found again; classes linked to most of their window are compared with all of it.
4. A pair counts in the first deal whose cells it shares, so no pairs are written to tell repeats
   apart: groups return counts of links and a spanning forest.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, join_by_weight, passes_for, runs, small_batches, written

TILE = 256
CELL = 8192
BITS = 62
CROWDED = TILE // 8  # links within a window from which more may stand beyond it
_KIND = "label string, vec_id long, h long, digest binary, cells array<long>, d int"


def _usable(batch: pa.RecordBatch) -> tuple[np.ndarray, list[np.ndarray]]:
    """Rows that may link, and their vectors in double precision."""
    at, out = [], []
    for k, (label, vec_id, _, v) in enumerate(zip(*(c.to_pylist() for c in batch.columns), strict=True)):
        if label is None or vec_id is None or not v or None in v:
            continue
        v = np.array(v, np.float64)
        if np.isfinite(v).all() and v.any():
            at.append(k)
            out.append(v)
    return np.array(at, np.int64), out


def _unit(vectors: np.ndarray) -> np.ndarray:
    """Vectors of length one, by way of their greatest component, so that squares neither vanish nor overflow."""
    scaled = vectors / np.abs(vectors).max(1)[:, None]
    return scaled / np.sqrt((scaled * scaled).sum(1))[:, None]


def _planes(seed: int, count: int, d: int) -> np.ndarray:
    return np.random.default_rng([20240517, seed, d]).standard_normal((d, count))


def keyed(rows: DataFrame, deals: int, bits: int) -> DataFrame:
    """(label, vec_id, h, digest, cells, d) of rows that may link: a digest of the vector and its cell in each deal."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = 1 << np.arange(bits, dtype=np.int64)
        for batch in batches:
            at, vectors = _usable(batch)
            cells: list = [None] * len(at)
            for d in {len(v) for v in vectors}:
                mine = [k for k, v in enumerate(vectors) if len(v) == d]
                signs = np.array([vectors[k] for k in mine]) @ _planes(0, deals * bits, d) > 0
                for k, row in zip(mine, (signs.reshape(len(mine), deals, bits) @ weights).tolist(), strict=True):
                    cells[k] = row
            digests = [xxhash.xxh3_128_digest((v + 0.0).tobytes()) for v in vectors]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), batch.column(1).take(pa.array(at)), batch.column(2).take(pa.array(at)), pa.array(digests, pa.binary()), pa.array(cells, pa.list_(pa.int64())), pa.array([len(v) for v in vectors], pa.int32())], ["label", "vec_id", "h", "digest", "cells", "d"])

    small_batches(rows.sparkSession)
    return rows.select(F.col("label").cast("string").alias("label"), F.col("vec_id").cast("long").alias("vec_id"), F.xxhash64("embedding").alias("h"), "embedding").mapInArrow(work, _KIND)


def _close(v: np.ndarray, w: np.ndarray, threshold: float) -> np.ndarray:
    """Pairs at the threshold by cosine in double precision; near it each is summed anew."""
    c = v @ w.T
    out = c >= threshold
    for x, y in np.argwhere(np.abs(c - threshold) < 1e-12).tolist():
        out[x, y] = math.fsum((v[x] * w[y]).tolist()) >= threshold
    return out


def linked(v: np.ndarray, threshold: float, missed: float, tile: int) -> np.ndarray:
    """Links among unit vectors, each way, by sorted passes that leave at most about the share `missed` unmet.

    Windows are a tile and the next. A pass has the chance of evenly spread vectors, or less where it
    meets fewer of the links known before it; where all pairs are no more work, they are compared.
    """
    n, d = v.shape
    out = np.zeros((n, n), bool)
    if n <= 2 * tile:
        out = _close(v, v, threshold)
        np.fill_diagonal(out, False)
        return out | out.T
    even = (1 - math.acos(threshold) / math.pi) ** (math.log2(n / tile) + 1)
    whole = np.zeros(n, bool)  # rows compared with all others
    a, b = np.zeros(0, np.int64), np.zeros(0, np.int64)  # known links of the others
    left, turn = 1.0, 0
    weights = 1 << np.arange(BITS, dtype=np.int64)
    while left > missed:
        turn += 1
        if turn * 2 * tile >= n:
            whole[:] = False
            _compare(np.arange(n), whole, out, v, threshold, tile)
            break
        order = np.argsort((v @ _planes(turn, BITS, d) > 0) @ weights, kind="stable")
        place = np.empty(n, np.int64)
        place[order] = np.arange(n) // tile
        chance = even
        if len(a):
            chance = min(even, (np.count_nonzero(np.abs(place[a] - place[b]) <= 1) + 0.5) / (len(a) + 1))
        left *= 1 - chance
        found = np.zeros(n, np.int64)
        more = []
        for s in range(0, n, tile):
            one, two = order[s : s + tile], order[s : s + 2 * tile]
            x, y = np.nonzero(_close(v[one], v[two], threshold))
            x, y = one[x], two[y]
            x, y = x[x != y], y[x != y]
            if len(x):
                found += np.bincount(x, minlength=n)
                new = ~out[x, y]
                out[x, y] = out[y, x] = True
                more.append((np.minimum(x, y)[new], np.maximum(x, y)[new]))
        crowded = np.flatnonzero((found > CROWDED) & ~whole)
        if len(crowded):
            _compare(crowded, whole, out, v, threshold, tile)
        x, y = np.concatenate([a, *(m[0] for m in more)]), np.concatenate([b, *(m[1] for m in more)])
        open_ = ~whole[x] & ~whole[y]
        a, b = x[open_], y[open_]
    return out


def _compare(at: np.ndarray, whole: np.ndarray, out: np.ndarray, v: np.ndarray, threshold: float, tile: int) -> None:
    """Rows with all others."""
    for s in range(0, len(at), tile):
        some = at[s : s + tile]
        close = _close(v[some], v, threshold)
        close[np.arange(len(some)), some] = False
        out[some] |= close
        out[:, some] |= close.T
    whole[at] = True


def _least(close: np.ndarray) -> np.ndarray:
    """For each row of a square of links the least row that it reaches, some rows at a time."""
    label = np.arange(len(close))
    while True:
        before = label.copy()
        for s in range(0, len(close), 256):
            label[s : s + 256] = np.minimum(label[s : s + 256], np.where(close[s : s + 256], label[None, :], len(close)).min(1))
        label = np.minimum(label, label[label])
        if (label == before).all():
            return label


_LINKS = pa.schema([("label", pa.string()), ("rep", pa.int64()), ("links", pa.int64()), ("other", pa.int64())])


def _groups(threshold: float, missed: float, tile: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs(batches, ["label", "deal", "cell", "i", "j", "d"]):
            if len(group) < 2:
                continue
            label, deal, i, j = (group.column(c)[0].as_py() for c in ("label", "deal", "i", "j"))
            ids, copies, own = (np.array(group.column(c).to_pylist(), np.int64) for c in ("rep", "copies", "own"))
            cells = np.array(group.column("cells").to_pylist(), np.int64)
            vectors = group.column("embedding").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(ids), -1)
            close = linked(_unit(vectors), threshold, missed, tile)
            at = np.flatnonzero(close.any(1))
            if not len(at):
                continue
            close, ids, copies, own, cells = close[np.ix_(at, at)], ids[at], copies[at], own[at], cells[at]
            for q in range(deal):  # pairs that an earlier deal had in one cell
                close &= cells[:, q][:, None] != cells[:, q][None, :]
            if i != j:
                close &= own[:, None] != own[None, :]
            links = np.concatenate([close[s : s + 256] @ copies for s in range(0, len(close), 256)])
            root = _least(close)
            some = np.flatnonzero(links)
            if len(some):
                yield pa.RecordBatch.from_arrays([pa.array([label] * len(some)), pa.array(ids[some]), pa.array(links[some]), pa.array(ids[root[some]])], schema=_LINKS)

    return work


def near_vectors(rows: DataFrame, threshold: float = 0.98, recall: float = 0.9999, tile: int = TILE, cell: int = CELL) -> DataFrame:
    """For each row of rows(vec_id, label, embedding): n_links, component_id and kept.

    Vectors link when their labels are equal and their cosine in double precision is at least the
    threshold. n_links counts other vectors, component_id is the least vec_id reachable by links and
    kept says that it is the row's own. Vectors without a label, null or zero ones and ones with null or
    non-finite components link with nothing, as do vectors of different lengths. A repeated row counts
    as one vector; one of several vectors under one id and label (that of the least digest) stands for
    them. A null vec_id gives no links, a null component_id and kept. An empty table gives an empty table.
    """
    spark = rows.sparkSession
    size = int(spark.conf.get("spark.sql.shuffle.partitions"))
    most = rows.groupBy("label").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    # leading bits that cut the largest label into cells, and the chance that a linked pair agrees on them
    bits = max(0, math.ceil(math.log2(max(most, 1) / cell)))
    missed = (1 - recall) / 2
    deals = passes_for(1 - missed, (1 - math.acos(threshold) / math.pi) ** bits) if bits else 1
    told = keyed(rows, deals, bits)
    # a repeated row once; of several vectors under one id and label the one of the least digest
    ids = written(told.groupBy("label", "vec_id").agg(F.min(F.struct("digest", "h", "cells", "d")).alias("v")).select("label", "vec_id", "v.*"), "vectors")
    classes = ids.groupBy("label", "digest").agg(F.min(F.struct("vec_id", "h")).alias("least"), F.count("*").alias("copies"), F.first("cells").alias("cells"), F.first("d").alias("d"))
    classes = written(classes.select("label", "digest", F.col("least.vec_id").alias("rep"), F.col("least.h").alias("h"), "copies", "cells", "d"), "classes")
    dealt = classes.select("label", "rep", "h", "copies", "cells", "d", F.posexplode("cells").alias("deal", "cell"))
    crowds = dealt.groupBy("label", "deal", "cell").agg(F.count("*").alias("m")).where(F.col("m") > cell)
    parts = F.coalesce(F.ceil(F.col("m") / (cell // 2)), F.lit(1)).cast("int")
    dealt = dealt.join(crowds, ["label", "deal", "cell"], "left").withColumn("p", parts).withColumn("own", F.pmod(F.xxhash64("rep"), F.col("p")).cast("int"))
    dealt = dealt.withColumn("peer", F.explode(F.sequence(F.lit(0), F.col("p") - 1)))
    dealt = dealt.select("label", "rep", "h", "copies", "cells", "d", "deal", "cell", "own", F.least("own", "peer").alias("i"), F.greatest("own", "peer").alias("j"))
    raw = rows.select(F.col("label").cast("string").alias("label"), F.col("vec_id").cast("long").alias("rep"), F.xxhash64("embedding").alias("h"), "embedding")
    raw = raw.groupBy("label", "rep", "h").agg(F.first("embedding").alias("embedding"))
    columns = ["label", "deal", "cell", "i", "j", "d", "own", "rep", "copies", "cells", "embedding"]
    grouped = raw.join(dealt, ["label", "rep", "h"]).select(columns).repartition(size, "label", "deal", "cell", "i", "j").sortWithinPartitions("label", "deal", "cell", "i", "j", "d", "rep")
    small_batches(spark)
    links = written(grouped.mapInArrow(_groups(threshold, missed, tile), "label string, rep long, links long, other long"), "links")
    # one vec_id may stand under several labels, and is one vector in what can be reached
    twice = ids.groupBy("vec_id").agg(F.count("*").alias("n")).where("n > 1").select("vec_id")
    several = ids.join(twice, "vec_id").join(classes.select("label", "digest", "rep"), ["label", "digest"]).groupBy("vec_id").agg(F.min("rep").alias("b"), F.collect_set("rep").alias("reps"))
    edges = links.select(F.col("rep").alias("a"), F.col("other").alias("b")).union(several.select(F.explode("reps").alias("a"), "b"))
    found = components(edges.where("a <> b"))
    counts = links.groupBy("label", "rep").agg(F.sum("links").alias("links"))
    known = classes.select("label", "digest", "rep", "copies").join(counts, ["label", "rep"], "left").join(found.withColumnRenamed("node", "rep"), "rep", "left")
    known = known.select(F.struct("label", "digest").alias("class"), "copies", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("links"), F.coalesce("component", "rep").alias("component"))
    # only classes that say more than their single vector does are joined back
    known = written(known.where("links > 0"), "known")
    told = join_by_weight(ids.select("vec_id", F.struct("label", "digest").alias("class")), known, "class", "copies", ids.count(), ["links", "component"])
    told = told.groupBy("vec_id").agg(F.sum("links").alias("n_links"), F.min("component").alias("component"))
    out = rows.select(F.col("vec_id").cast("long").alias("vec_id")).join(told, "vec_id", "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
