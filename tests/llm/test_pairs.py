"""Jaccard join, decontamination and vectors against brute force, with nulls, empties, ties, repeats and clashing names."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import decontamination as D
from tessera.llm.common import shingle_hashes, words
from tessera.llm.embedding_dedup import near_vectors
from tessera.llm.jaccard_join import banding, jaccard_join, overlaps


def texts(seed, n=60):
    r = random.Random(seed)
    base = [" ".join(r.choice("abcdefghijklmnop") + r.choice("xyz") for _ in range(r.randint(3, 80))) for _ in range(n // 4)]
    out = []
    for k in range(n):
        w = r.choice(base).split()
        for _ in range(r.randint(0, 3)):
            w[r.randrange(len(w))] = "new" + str(r.randint(0, 3))
        out.append((k, " ".join(w)))
    return out


def brute(rows):
    sets = {}
    for d, t in rows:
        if d is not None and words(t):
            sets.setdefault(d, set(shingle_hashes(words(t)).tolist()))
    links = {d: set() for d, _ in rows if d is not None}
    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            same = len(sets[a] & sets[b])
            if same >= 0.8 * (len(sets[a]) + len(sets[b]) - same):
                links[a].add(b)
                links[b].add(a)
    comp = {}
    for d in sorted(links):
        if d not in comp:
            todo = [d]
            while todo:
                x = todo.pop()
                if x not in comp:
                    comp[x] = d
                    todo += links[x]
    return {d: (len(links[d]), comp[d]) for d in links}


@pytest.mark.parametrize("block", [1024, 3])
def test_jaccard_join(spark, block):
    rows = [*texts(1), (100, None), (101, ""), (102, " ,. "), (103, "one two"), (104, "One, two!"), (105, "é" * 20000)]
    df = spark.createDataFrame([*rows, rows[3], (None, rows[3][1]), (None, None)], "doc_id long, text string").withColumns({"bands": F.lit(1), "key": F.lit("x"), "rep": F.lit(0)})
    out = jaccard_join(df, block=block)
    got = out.collect()
    assert len(got) == len(rows) + 3
    known = {r.doc_id: (r.n_links, r.component_id) for r in got if r.doc_id is not None}
    assert known == brute(rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got if r.doc_id is not None)
    assert all(r.kept and r.n_links == 0 and r.component_id is None for r in got if r.doc_id is None)
    assert jaccard_join(df.where("false")).count() == 0


def test_jaccard_join_of_rows_that_share_an_id(spark):
    """Row (9, Y) stays, as nothing is like it; of (9, X), a copy of 5, nothing stays, and of one document's two spellings one."""
    x, y = " ".join(f"x{k}" for k in range(30)), " ".join(f"y{k}" for k in range(30))
    rows = [(5, x), (9, x), (9, y), (9, y.upper()), (11, "one"), (None, x)] + [(5, x)] * 400
    out = jaccard_join(spark.createDataFrame(rows, "doc_id long, text string").withColumns({"h": F.lit(1), "first": F.lit(2)}), by_text=True).collect()
    assert len(out) == len(rows)
    kept = {(r.doc_id, r.text_hash) for r in out if r.stays}
    assert sorted((d is None, d or 0) for d, _ in kept) == [(False, 5), (False, 9), (False, 11), (True, 0)]
    assert {(r.doc_id, r.component_id, r.n_links) for r in out} == {(5, 5, 1), (9, 5, 1), (9, 9, 0), (11, 11, 0), (None, None, 0)}


def test_banding_reaches_its_recall():
    for t, recall in ((0.8, 0.9995), (0.5, 0.99), (0.95, 0.999)):
        b, r = banding(t, recall)
        assert 1 - (1 - t**r) ** b >= recall and (b * r <= 128 or r == 1)


def test_overlaps_of_sets():
    r = np.random.default_rng(0)
    a = [np.unique(r.integers(0, 9000, n).astype(np.uint64)) for n in (1, 50, 9000)]
    b = [np.unique(r.integers(0, 9000, n).astype(np.uint64)) for n in (2, 700)]
    assert overlaps(a, b).tolist() == [[len(np.intersect1d(x, y)) for y in b] for x in a]


def test_tiles_of_repeated_phrases_are_quick():
    """Periodic texts: one tile each, without a match for every pair of words."""
    import time

    began = time.perf_counter()
    period = np.tile(np.array([3, 4], np.uint64), 10_000)
    assert D.tiles(period[:101], period, 4)[0] == (0, 0, 101)
    assert D.tiles(np.full(400, 7, np.uint64), np.full(20_000, 7, np.uint64), 4) == [(0, 0, 400)]
    parted = np.full(20_000, 7, np.uint64)
    parted[::11] = 0
    assert sum(n for _, _, n in D.tiles(np.full(400, 7, np.uint64), parted, 4)) == 400
    assert time.perf_counter() - began < 3


def slow_tiles(item, text, least):
    """Greedy string tiling as defined: all maximal matches anew for every tile."""
    ui, ut, out = set(), set(), 0
    while True:
        best = (0, 0, 0)
        for p in range(len(item)):
            for q in range(len(text)):
                n = 0
                while p + n < len(item) and q + n < len(text) and p + n not in ui and q + n not in ut and item[p + n] == text[q + n]:
                    n += 1
                best = max(best, (n, -p, -q))
        n, p, q = best[0], -best[1], -best[2]
        if n < least:
            return out
        out += n
        ui.update(range(p, p + n))
        ut.update(range(q, q + n))


def test_tiles_match_the_definition():
    r = np.random.default_rng(4)
    for k in range(600):
        top = 2 + k % 4
        item, text = r.integers(1, top, r.integers(1, 14)).astype(np.uint64), r.integers(0, top, r.integers(1, 30)).astype(np.uint64)
        assert sum(n for _, _, n in D.tiles(item, text, 1 + k % 3)) == slow_tiles(item.tolist(), text.tolist(), 1 + k % 3)


def test_decontamination(spark):
    w = [f"w{k}" for k in range(40)]
    bench = spark.createDataFrame([(1, " ".join(w)), (2, "just three words"), (3, None), (4, ""), (5, "other thing that nobody ever said in any text here")], "item_id long, text string")
    swapped = " ".join([*w[20:], "between", *w[:20]])
    rows = [(1, "x " + " ".join(w) + " y"), (2, swapped), (3, " ".join(w[:10])), (4, "so Just three, words it is"), (5, None), (6, ""), (7, "z " * 20000 + " ".join(w)), (8, "w1 w2 " * 20000), (None, " ".join(w)), (1, "x " + " ".join(w) + " y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("item_id", F.lit(9))
    want = sorted([(1, 1), (1, 1), (2, 1), (4, 2), (7, 1), (-1, 1)])
    for size in (32 << 20, 50):
        got = sorted((-1 if r.doc_id is None else r.doc_id, r.item_id) for r in D.overlaps(docs, bench, block_bytes=size).collect())
        assert got == want
    kept = D.decontaminate(docs, bench)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [3, 5, 6, 8]
    assert D.overlaps(docs, bench.where("false")).count() == 0 == D.overlaps(docs.where("false"), bench).count()


def vectors(seed, n=400, d=16):
    r = np.random.default_rng(seed)
    base = r.standard_normal((n // 8, d))
    return [(k, int(r.integers(0, 3)), (base[r.integers(0, len(base))] + r.standard_normal(d) * 0.05).tolist()) for k in range(n)]


@pytest.mark.parametrize(("tile", "cell"), [(256, 8192), (8, 8192), (8, 40)])
def test_vectors_match_brute_force(spark, tile, cell):
    rows = vectors(3)
    rows += [(1000 + k, 7, rows[0][2]) for k in range(30)]
    odd = [(2000, None, rows[0][2]), (2001, 7, None), (2002, 7, [0.0] * 16), (2003, 7, [float("nan")] + [1.0] * 15), (2004, 7, [float("inf")] + [1.0] * 15), (2005, 7, [None] + [1.0] * 15), (2006, 7, []), (2007, 7, [1.0, 2.0]), (None, 7, rows[0][2]), rows[5]]
    df = spark.createDataFrame([*rows, *odd], "vec_id long, label int, embedding array<double>").withColumns({"tiles": F.lit(1), "keys": F.lit("k")})
    out = near_vectors(df, tile=tile, cell=cell).collect()
    assert len(out) == len(rows) + len(odd)
    v = {i: (label, np.array(x) / math.sqrt(math.fsum(c * c for c in x))) for i, label, x in rows}
    ids = list(v)
    links = {i: {j for j in ids if j != i and v[i][0] == v[j][0] and float(v[i][1] @ v[j][1]) >= 0.98} for i in ids}
    got = {r.vec_id: r for r in out}
    assert sum(len(x) for x in links.values()) > 500
    assert {i: got[i].n_links for i in ids} == {i: len(links[i]) for i in ids}
    for i in ids:
        assert got[i].component_id <= min({i} | links[i]) and got[i].kept == (got[i].component_id == i)
        assert all(got[j].component_id == got[i].component_id for j in links[i])
    assert all(got[i].n_links == 0 and got[i].component_id == i for i in range(2000, 2008))
    assert got[None].component_id is None
    assert near_vectors(df.where("false")).count() == 0


def test_links_of_many_vectors_are_found():
    """Recall against all pairs, evenly spread and concentrated, with a crowd."""
    from tessera.llm.embedding_dedup import _unit, linked

    r = np.random.default_rng(8)
    for base in (0.0, 0.9, 0.96):
        v = _unit(np.sqrt(base) * _unit(r.standard_normal((1, 64))) + np.sqrt(1 - base) * _unit(r.standard_normal((6000, 64))))
        v[5000:5500] = _unit(v[:500] + 0.19 * np.sqrt(1 - base) * _unit(r.standard_normal((500, 64))))
        v[5500:5800] = _unit(v[7] + 0.02 * _unit(r.standard_normal((300, 64))))
        want = v @ v.T >= 0.98
        np.fill_diagonal(want, False)
        got = linked(v, 0.98, 5e-5, 256)
        assert not (got & ~want).any() and (got & want).sum() >= 0.9995 * want.sum() and (got == got.T).all()


def test_a_benchmark_of_several_blocks_and_repeated_items(spark):
    r = random.Random(12)
    vocabulary = [f"w{k}" for k in range(60)]
    items = [(k % 7, " ".join(r.choice(vocabulary) for _ in range(r.randint(6, 25)))) for k in range(12)] + [(3, None), (None, "w1 w2 w3 w4 w5 w6")]
    items += items[:2]  # repeated rows
    docs = [(d, " ".join(r.choice(vocabulary) for _ in range(30)) + " " + r.choice(items)[1 if d % 2 else 0].__str__() + " w9") for d in range(40)] + [(None, items[0][1]), (5, None)]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string").coalesce(1)
    rows = lambda size: sorted(map(str, D.overlaps(d, b, block_bytes=size).collect()))
    one, many = rows(1 << 30), rows(60)
    assert one == many and len(one) > 20
    assert sum("doc_id=None" in x for x in one) >= 1 and sum("item_id=None" in x for x in one) >= 0
    kept = D.decontaminate(d, b, block_bytes=60)
    assert sorted(map(str, kept.collect())) == sorted(map(str, D.decontaminate(d, b).collect())) and kept.count() < len(docs)
