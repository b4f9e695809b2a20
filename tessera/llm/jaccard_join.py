"""N-gram Jaccard join by MinHash banding.

1. Each text becomes a class key (its word sequence) and the band hashes of its five-word shingles.
2. Texts of one key form a class; from here on a class stands once, by its least doc_id.
3. Classes that share a band hash meet in a bucket. A bucket over `BLOCK` classes or `WORDS` words is
   split into blocks, and each pair of blocks is a group of its own, so a hot bucket spreads over tasks.
4. A pair counts in the first band that its two classes share, so no group repeats another's work;
   a first round on band hashes alone tells which classes need their texts in which groups.
5. Groups verify their pairs on the full shingle sets and return counts of links by class and a
   spanning forest, never the pairs themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, join_by_weight, mixed, passes_for, runs, shingle_hashes, small_batches, text_key, words, written

BLOCK = 512
WORDS = 2_000_000


def banding(threshold: float, recall: float, hashes: int = 128) -> tuple[int, int]:
    """(bands, rows): the most rows a band whose bands reach the recall at the threshold within a number of hashes."""
    best = (passes_for(recall, threshold), 1)
    for rows in range(2, hashes + 1):
        bands = passes_for(recall, threshold**rows)
        if bands * rows <= hashes:
            best = (bands, rows)
    return best


def band_hashes(sets: list[np.ndarray], bands: int, rows: int) -> np.ndarray:
    """Band hashes (texts, bands) of non-empty shingle arrays, all texts at once."""
    flat = np.concatenate(sets)
    starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    seeds = mixed(np.arange(1, bands * rows + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    out = np.zeros((len(sets), bands), np.uint64)
    with np.errstate(over="ignore"):
        for b in range(bands):
            band = np.full(len(sets), b + 1, np.uint64)
            for r in range(rows):
                # the high halves of products are well mixed, which is what a minimum looks at
                least = np.minimum.reduceat(flat * seeds[b * rows + r], starts)
                band = mixed(band * np.uint64(0x9E3779B97F4A7C15) + least)
            out[:, b] = band
    return out


def sketches(docs: DataFrame, bands: int, rows: int, n: int) -> DataFrame:
    """(doc_id, h, key, size, bands): a hash of the text, its class key, words and band hashes; null keys where a text is null or has no word."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys: list[bytes | None] = []
            sets, where = [], {}
            place, sizes = [], []
            for text in batch.column(2).to_pylist():
                found = words(text)
                key = text_key(found)
                keys.append(key)
                sizes.append(len(found))
                if key is not None and key not in where:  # copies within a batch are sketched once
                    where[key] = len(sets)
                    sets.append(shingle_hashes(found, n))
                place.append(where.get(key, -1))
            hashes = band_hashes(sets, bands, rows).view(np.int64) if sets else np.zeros((1, bands), np.int64)
            lists = [hashes[p] if p >= 0 else None for p in place]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), pa.array(lists, pa.list_(pa.int64()))], ["doc_id", "h", "key", "size", "bands"])

    small_batches(docs.sparkSession)
    text = F.col("text").cast("string")
    kept = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("h"), text.alias("text"))
    return kept.mapInArrow(work, "doc_id long, h long, key binary, size long, bands array<long>")


def fresh_pairs(bands: np.ndarray, others: np.ndarray, bucket: int) -> np.ndarray:
    """Which pairs of two blocks share the bucket's band hash and no earlier one."""
    at = int(np.flatnonzero(bands[0] == bucket)[0])
    fresh = np.ones((len(bands), len(others)), bool)
    for b in range(at):
        fresh &= bands[:, b][:, None] != others[:, b][None, :]
    return fresh


def _sides(table: pa.Table) -> tuple[np.ndarray, np.ndarray, bool]:
    """Rows of the left and right block of a group; True if it is one block with itself."""
    i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
    own = np.array(table.column("own").to_pylist())
    if i == j:
        every = np.arange(len(own))
        return every, every, True
    return np.flatnonzero(own == i), np.flatnonzero(own == j), False


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    whole = column.combine_chunks()
    flat = whole.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(whole), -1)


def needed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each group the classes that have a fresh pair."""
    out: list[pa.Table] = []
    held = 0
    for group in runs(batches, ["bucket", "i", "j"]):
        if len(group) < 2:
            continue
        left, right, same = _sides(group)
        if not len(left) or not len(right):
            continue
        bands = _matrix(group.column("bands"))
        fresh = fresh_pairs(bands[left], bands[right], group.column("bucket")[0].as_py())
        if same:
            np.fill_diagonal(fresh, False)
        use = np.zeros(len(group), bool)
        use[left[fresh.any(1)]] = True
        use[right[fresh.any(0)]] = True
        if use.any():
            out.append(group.filter(pa.array(use)))
            held += int(use.sum())
        if held >= 2000:
            yield from pa.concat_tables(out).combine_chunks().to_batches()
            out, held = [], 0
    if out:
        yield from pa.concat_tables(out).combine_chunks().to_batches()


def overlaps(sets: list[np.ndarray], others: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of sorted distinct arrays, all of one side with all of the other.

    Only hashes found on both sides matter; they become columns of bits, a bounded slice at a time.
    """
    a, b = np.concatenate(sets), np.concatenate(others)
    common = np.intersect1d(a, b)
    out = np.zeros((len(sets), len(others)), np.float32)
    rows_a, rows_b = np.repeat(np.arange(len(sets)), [len(s) for s in sets]), np.repeat(np.arange(len(others)), [len(s) for s in others])
    where_a, where_b = np.searchsorted(common, a), np.searchsorted(common, b)
    in_a = (where_a < len(common)) & (common[np.minimum(where_a, max(len(common) - 1, 0))] == a) if len(common) else np.zeros(len(a), bool)
    in_b = (where_b < len(common)) & (common[np.minimum(where_b, max(len(common) - 1, 0))] == b) if len(common) else np.zeros(len(b), bool)
    rows_a, where_a, rows_b, where_b = rows_a[in_a], where_a[in_a], rows_b[in_b], where_b[in_b]
    width = 4096
    order_a, order_b = np.argsort(where_a, kind="stable"), np.argsort(where_b, kind="stable")
    rows_a, where_a, rows_b, where_b = rows_a[order_a], where_a[order_a], rows_b[order_b], where_b[order_b]
    for start in range(0, len(common), width):
        x, y = np.zeros((len(sets), width), np.float32), np.zeros((len(others), width), np.float32)
        s, e = np.searchsorted(where_a, [start, start + width])
        x[rows_a[s:e], where_a[s:e] - start] = 1
        s, e = np.searchsorted(where_b, [start, start + width])
        y[rows_b[s:e], where_b[s:e] - start] = 1
        out += x @ y.T
    return out


def least_linked(linked: np.ndarray, left: np.ndarray, right: np.ndarray, size: int) -> np.ndarray:
    """For each row of a group the least row that it reaches by links."""
    label = np.arange(size)
    while True:
        before = label.copy()
        np.minimum.at(label, left, np.where(linked, label[right][None, :], size).min(1))
        np.minimum.at(label, right, np.where(linked, label[left][:, None], size).min(0))
        label = np.minimum(label, label[label])
        if (label == before).all():
            return label


def verifier(threshold: float, n: int):
    schema = pa.schema([("key", pa.binary()), ("links", pa.int64()), ("other", pa.binary())])

    def pair(one: np.ndarray, two: np.ndarray) -> bool:
        shared = len(np.intersect1d(one, two, assume_unique=True))
        return shared >= threshold * (len(one) + len(two) - shared)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for group in runs(batches, ["bucket", "i", "j"]):
            if len(group) < 2:
                continue
            keys, sizes = group.column("key").to_pylist(), group.column("copies").to_pylist()
            # one text's words at a time, as texts may be long
            sets = [np.unique(shingle_hashes(words(t.as_py()), n)) for t in group.column("text")]
            bands = _matrix(group.column("bands"))
            left, right, same = _sides(group)
            if not len(left) or not len(right):
                continue
            fresh = fresh_pairs(bands[left], bands[right], group.column("bucket")[0].as_py())
            if same:
                fresh = np.triu(fresh, 1)
            if len(keys) <= 8:
                linked = np.zeros_like(fresh)
                for x, y in np.argwhere(fresh).tolist():
                    linked[x, y] = pair(sets[left[x]], sets[right[y]])
            else:
                shared = overlaps([sets[k] for k in left], [sets[k] for k in right])
                la, lb = np.array([len(sets[k]) for k in left]), np.array([len(sets[k]) for k in right])
                linked = fresh & (shared >= threshold * (la[:, None] + lb[None, :] - shared))
            weight = np.array(sizes, np.int64)
            links = np.zeros(len(keys), np.int64)
            np.add.at(links, left, linked @ weight[right])
            np.add.at(links, right, linked.T @ weight[left])
            root = least_linked(linked, left, right, len(keys)).tolist()
            out += [(keys[k], int(links[k]), keys[root[k]]) for k in np.flatnonzero(links).tolist()]
            if len(out) >= 2000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)

    return work


def jaccard_join(docs: DataFrame, threshold: float = 0.8, n: int = 5, recall: float = 0.9995, block: int = BLOCK, by_text: bool = False) -> DataFrame:
    """Texts whose sets of n-word shingles have a Jaccard similarity of at least the threshold.

    Returns a row for each row of docs: doc_id, class_id (least doc_id with the same words), n_copies
    (documents of the class), n_links (other documents linked, copies included), component_id (least
    doc_id reachable by links), kept (the row's class is the component's first, and doc_id its least).
    Texts with fewer than n words count as one shingle. Texts without words, null ones too, and rows
    without a doc_id link with nothing: they have themselves as class and component, and are kept.
    Repeated rows count once as a document; rows of one doc_id with different words are classes of their
    own, which link only by what they say. Other columns are ignored, and an empty table gives an empty
    table. by_text adds text_hash (xxhash64 of the text) and stays, which is kept for one text only
    where a kept document has several that say the same words.
    """
    bands, rows = banding(threshold, recall)
    flat = written(sketches(docs, bands, rows, n), "sketches")
    by_doc = flat.where("key is not null and doc_id is not null").groupBy("key", "doc_id").agg(F.min("h").alias("h"), F.max("h").alias("last"), F.count("*").alias("rows"), F.first("size").alias("size"), F.first("bands").alias("bands"))
    classes = by_doc.groupBy("key").agg(F.min(F.struct("doc_id", "h")).alias("least"), F.count("*").alias("copies"), F.sum("rows").alias("rows"), F.bool_or(F.col("h") != F.col("last")).alias("spelled"), F.first("size").alias("size"), F.first("bands").alias("bands"))
    classes = written(classes.select("key", F.col("least.doc_id").alias("rep"), F.col("least.h").alias("h"), "copies", "rows", "spelled", "size", "bands"), "classes")
    entries = classes.select("key", "size", F.explode("bands").alias("bucket"))
    shared = entries.groupBy("bucket").agg(F.count("*").alias("m"), F.sum("size").alias("words")).where("m > 1")
    met = entries.join(shared, "bucket")
    parts = F.greatest(F.ceil(F.col("m") / F.lit(block)), F.ceil(F.col("words") / F.lit(WORDS))).cast("int")
    met = met.withColumn("p", parts).withColumn("own", F.pmod(F.xxhash64("key"), F.col("p")).cast("int"))
    met = met.withColumn("peer", F.explode(F.sequence(F.lit(0), F.col("p") - 1)))
    met = met.select("bucket", F.least("own", "peer").cast("int").alias("i"), F.greatest("own", "peer").cast("int").alias("j"), "own", "key")
    grouped = met.join(classes.select("key", "rep", "h", "copies", "bands"), "key")
    size = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def gathered(df: DataFrame) -> DataFrame:
        return df.repartition(size, "bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")

    columns = ["bucket", "i", "j", "own", "key", "rep", "h", "copies", "bands"]
    kinds = "bucket long, i int, j int, own int, key binary, rep long, h long, copies long, bands array<long>"
    items = written(gathered(grouped.select(columns)).mapInArrow(needed, kinds), "items")
    text = F.col("text").cast("string")
    texts = docs.select(F.col("doc_id").cast("long").alias("rep"), F.xxhash64(text).alias("h"), text.alias("text"))
    # a class's text once, however often its row is repeated
    texts = texts.join(items.select("rep", "h").distinct(), ["rep", "h"], "left_semi").groupBy("rep", "h").agg(F.first("text").alias("text"))
    small_batches(docs.sparkSession)
    links = gathered(items.join(texts, ["rep", "h"]).select(*columns, "text")).mapInArrow(verifier(threshold, n), "key binary, links long, other binary")
    links = written(links, "links")
    reps = classes.select("key", "rep", "h", "copies", "rows", "spelled")
    counts = links.groupBy("key").agg(F.sum("links").alias("links"))
    node = F.struct(F.col("rep").alias("d"), F.col("key").alias("k"))
    ends = reps.select("key", node.alias("node"))
    edges = links.where("key <> other").select("key", "other").join(ends.withColumnRenamed("node", "a"), "key").join(ends.select(F.col("key").alias("other"), F.col("node").alias("b")), "other")
    found = components(edges.select("a", "b")).select(F.col("node.k").alias("key"), "component")
    known = reps.join(counts, "key", "left").join(found, "key", "left").withColumn("component", F.coalesce("component", node))
    first = F.col("component.k") == F.col("key")
    known = known.select("key", "rows", F.col("rep").alias("class_id"), F.col("copies").alias("n_copies"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.col("component.d").alias("component_id"), first.alias("first"), F.when(F.col("spelled"), F.col("h")).alias("spelling"))
    # only classes that say more than their single document does are joined back
    known = written(known.where("n_links > 0 or spelling is not null"), "known")
    said = flat.select("doc_id", F.col("h").alias("text_hash"), F.when(F.col("doc_id").isNotNull(), F.col("key")).alias("key"))
    out = join_by_weight(said, known, "key", "rows", flat.count(), ["class_id", "n_copies", "n_links", "component_id", "first", "spelling"])
    kept = F.coalesce(F.col("first") & (F.col("doc_id") == F.col("component_id")), F.lit(True))
    stays = kept & F.coalesce(F.col("text_hash") == F.col("spelling"), F.lit(True))
    columns = [F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_copies", F.lit(1)).alias("n_copies"), F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "doc_id").alias("component_id"), kept.alias("kept")]
    return out.select("doc_id", *columns, *([F.col("text_hash"), stays.alias("stays")] if by_text else []))
