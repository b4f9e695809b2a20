"""Benchmark decontamination by greedy string tiling.

Documents meet benchmark items that share a seed (a run of words). For each such pair the longest
common run of unmarked words is marked again and again, found by running Karp-Rabin over hashes of a
falling length, until none reaches the least length. The share of an item's words under tiles tells
how much of it a document holds, in whatever order its passages stand.

The benchmark goes to the tasks in blocks of a bounded size, and documents stay where they are: each
is tiled by the task that reads it, so passages shared by many documents never meet in one place.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, words, written

BLOCK_BYTES = 32 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)


def rolling(ids: np.ndarray, n: int) -> np.ndarray:
    """Karp-Rabin hashes of all runs of n ids (polynomials modulo 2**64)."""
    with np.errstate(over="ignore"):
        out = ids[: len(ids) - n + 1].astype(np.uint64)
        for k in range(1, n):
            out = out * _BASE + ids[k : len(ids) - n + 1 + k]
    return out


def _free(marked: np.ndarray, n: int) -> np.ndarray:
    """Starts of runs of n unmarked words."""
    total = np.concatenate([[0], np.cumsum(marked)])
    return total[n:] == total[:-n]


def _ahead(marked: np.ndarray) -> np.ndarray:
    """How many unmarked words stand from each place on."""
    stops = np.flatnonzero(np.append(marked, True))
    at = np.arange(len(marked))
    return stops[np.searchsorted(stops, at)] - at


def _matches(item: np.ndarray, text: np.ndarray, used_i: np.ndarray, used_t: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts in item and text and lengths of all common unmarked runs of at least a length that reach no further to the left.

    Starts meet by hash, and only where the words before them differ, so that a repeated phrase gives a
    match for each of its runs and not for each pair of its words; runs are extended by doubling.
    """
    none = np.zeros(0, np.int64)
    hi, ht = rolling(item, length), rolling(text, length)
    at_i, at_t = np.flatnonzero(_free(used_i, length)), np.flatnonzero(_free(used_t, length))
    both = np.intersect1d(hi[at_i], ht[at_t])
    at_i, at_t = at_i[np.isin(hi[at_i], both)], at_t[np.isin(ht[at_t], both)]
    if not len(at_i):
        return none, none, none
    # the word before a start; where none is free two numbers that no words have and that differ
    before_i = np.where((at_i == 0) | used_i[at_i - 1], -1, item[at_i - 1].astype(np.int64))
    before_t = np.where((at_t == 0) | used_t[at_t - 1], -2, text[at_t - 1].astype(np.int64))
    words_ = np.unique(before_t)
    group_t = np.searchsorted(both, ht[at_t]) * (len(words_) + 1) + np.searchsorted(words_, before_t)
    order = np.argsort(group_t, kind="stable")
    at_t, group_t = at_t[order], group_t[order]
    place = np.minimum(np.searchsorted(words_, before_i), len(words_) - 1)
    own = np.searchsorted(both, hi[at_i]) * (len(words_) + 1)
    first, last = np.searchsorted(group_t, own), np.searchsorted(group_t, own + len(words_), "right")
    same = words_[place] == before_i
    skip, resume = np.searchsorted(group_t, own + place), np.searchsorted(group_t, own + place, "right")
    skip, resume = np.where(same, skip, last), np.where(same, resume, last)
    starts, counts = np.concatenate([first, resume]), np.concatenate([skip - first, last - resume])
    total = np.cumsum(counts)
    p = np.repeat(np.concatenate([at_i, at_i]), counts)
    q = at_t[np.repeat(starts - (total - counts), counts) + np.arange(total[-1])] if len(p) else none
    most = np.minimum(_ahead(used_i)[p], _ahead(used_t)[q])
    n = np.zeros(len(p), np.int64)
    size = 1 << max(int(most.max()).bit_length() - 1, 0) if len(p) else 0
    while size:
        fits = np.flatnonzero(n + size <= most)
        if len(fits):
            a, b = rolling(item, size), rolling(text, size)
            n[fits[a[p[fits] + n[fits]] == b[q[fits] + n[fits]]]] += size
        size //= 2
    good = n >= length
    return p[good], q[good], n[good]


def _behind(marked: np.ndarray) -> np.ndarray:
    """How many marked words stand from each place on."""
    return _ahead(~marked)


def _pieces(p: np.ndarray, q: np.ndarray, n: np.ndarray, used_i: np.ndarray, used_t: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What tiles have left of matches: their unmarked runs of at least a length."""
    free_i, free_t, taken_i, taken_t = _ahead(used_i), _ahead(used_t), _behind(used_i), _behind(used_t)
    ends, out = p + n, []
    while len(p):
        run = np.minimum(np.minimum(free_i[p], free_t[q]), ends - p)
        good = run >= length
        out.append((p[good], q[good], run[good]))
        p, q = p + run, q + run
        on = p + length <= ends
        p, q, ends = p[on], q[on], ends[on]
        skip = np.maximum(taken_i[p], taken_t[q])
        p, q = p + skip, q + skip
        on = p + length <= ends
        p, q, ends = p[on], q[on], ends[on]
    return tuple(np.concatenate([x[k] for x in out]) if out else n[:0] for k in range(3))


def tiles(item: np.ndarray, text: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (start in item, start in text, length), longest first, ties by place in item, then in text.

    The search length falls from the item's length by halves. At each, matches are taken from the
    longest on; what a tile has cut off a match stays in the race with its own length. Matches of hashes
    are verified word by word.
    """
    found: list[tuple[int, int, int]] = []
    used_i, used_t = np.zeros(len(item), bool), np.zeros(len(text), bool)
    length = min(len(item), len(text))
    while length >= least:
        p, q, n = _matches(item, text, used_i, used_t, length)
        while len(n):
            top = int(n.max())
            now = np.flatnonzero(n == top)
            now = now[np.lexsort((q[now], p[now]))]
            false = np.zeros(len(n), bool)
            while len(now):
                x, y = int(p[now[0]]), int(q[now[0]])
                if (item[x : x + top] == text[y : y + top]).all():
                    used_i[x : x + top] = used_t[y : y + top] = True
                    found.append((x, y, top))
                    now = now[((p[now] >= x + top) | (p[now] + top <= x)) & ((q[now] >= y + top) | (q[now] + top <= y))]
                else:  # equal hashes of unequal words
                    false[now[0]] = True
                    now = now[1:]
            p, q, n = _pieces(p[~false], q[~false], n[~false], used_i, used_t, length)
        length = max(length // 2, least) if length > least else 0
    return found


class _Items:
    """A block of the benchmark: words as small numbers, seeds with their items."""

    def __init__(self, rows: list[tuple[int, str | None]], seed: int):
        self.numbers: dict[bytes, int] = {}
        self.items = []
        hashes, owners = [], []
        for item_id, text in rows:
            ids = np.array([self.numbers.setdefault(w, len(self.numbers) + 1) for w in words(text)], np.uint64)
            if not len(ids):
                continue
            n = min(seed, len(ids))
            hashes.append((n, rolling(ids, n)))
            owners.append(np.full(len(ids) - n + 1, len(self.items)))
            self.items.append((item_id, ids))
        self.seeds = {}
        for n in sorted({n for n, _ in hashes}):  # items shorter than a seed have a seed of their length
            h = np.concatenate([h for m, h in hashes if m == n])
            o = np.concatenate([o for (m, _), o in zip(hashes, owners, strict=True) if m == n])
            order = np.argsort(h, kind="stable")
            self.seeds[n] = h[order], o[order]

    def candidates(self, ids: np.ndarray) -> list[int]:
        """Items with a seed in a text."""
        out: set[int] = set()
        known = ids != 0
        for n, (seeds, owners) in self.seeds.items():
            if len(ids) < n:
                continue
            h = rolling(ids, n)[_free(~known, n)]
            if not len(h):
                continue
            h = np.unique(h)
            s, e = np.searchsorted(seeds, h, "left"), np.searchsorted(seeds, h, "right")
            for a, b in zip(s[e > s].tolist(), e[e > s].tolist(), strict=True):
                out.update(owners[a:b].tolist())
        return sorted(out)


def _blocks(benchmark: DataFrame, size: int) -> Iterator[list[tuple[int, str | None]]]:
    """Benchmark rows a block at a time: the driver holds no more than one block and one partition."""
    held, weight = [], 0
    for row in benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).toLocalIterator():
        held.append(tuple(row))
        weight += len(row[1] or "")
        if weight >= size:
            yield held
            held, weight = [], 0
    if held:
        yield held


def overlaps(docs: DataFrame, benchmark: DataFrame, least: int = 4, seed: int = 5, threshold: float = 0.6, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Pairs (doc_id, item_id, covered, item_words, coverage) with coverage of at least the threshold.

    A seed of `seed` words finds a pair (of all its words where an item has fewer); tiles have `least`
    words or more (again all of a shorter item's). Null or empty texts and items give no pairs; a
    repeated document gives its pairs again, a repeated item its own; null ids are kept. A benchmark of
    any size is read in blocks of block_bytes, with a pass over the documents for each. The pairs of every
    block but the last are written as soon as it has been passed, so that no task and not the driver has
    two blocks at once.
    """
    spark = docs.sparkSession
    small_batches(spark)
    kind = "doc_id long, item_id long, covered long, item_words long, coverage double"
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out, shared, last = None, None, None
    for rows in _blocks(benchmark, block_bytes):
        if last is not None:
            done = written(last, "overlaps")
            out = done if out is None else out.union(done)
            shared.destroy()
        shared = spark.sparkContext.broadcast(rows)
        last = source.mapInArrow(_tiler(shared, least, seed, threshold), kind)
    if last is None:
        return source.where("false").selectExpr("doc_id", "doc_id as item_id", "doc_id as covered", "doc_id as item_words", "0d as coverage")
    return last if out is None else out.union(last)


def _tiler(shared, least: int, seed: int, threshold: float):
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("covered", pa.int64()), ("item_words", pa.int64()), ("coverage", pa.float64())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = _Items(shared.value, seed)
        number = block.numbers.get
        for batch in batches:
            out = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if not text:
                    continue
                found = words(text)
                ids = np.fromiter((number(w, 0) for w in found), np.uint64, len(found))
                for k in block.candidates(ids):
                    item_id, item = block.items[k]
                    # words that the item lacks end runs wherever they stand
                    inside = np.isin(ids, item)
                    near = inside.copy()
                    near[1:] |= inside[:-1]
                    small = np.where(inside, ids, np.uint64(0))[near]
                    covered = sum(n for _, _, n in tiles(item, small, min(least, len(item))))
                    if covered >= threshold * len(item):
                        out.append((doc, item_id, covered, len(item), covered / len(item)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)

    return work


def decontaminate(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """The rows of docs that hold no benchmark item (see overlaps), in the columns of docs, whatever their names.

    Rows without an id are judged by their text too; null and empty texts and repeated rows are kept.
    """
    keyed = docs.select(F.struct("*").alias("document"), F.xxhash64(F.col("doc_id").cast("long"), "text").alias("leak"), "text")
    hits = written(overlaps(keyed.select(F.col("leak").alias("doc_id"), "text"), benchmark, **how).select(F.col("doc_id").alias("leak")).distinct(), "leaks")
    return keyed.join(hits, "leak", "left_anti").select("document.*")
