"""Filter audit, norm-bucketed search and fill-in-middle against brute force."""

import hashlib
import itertools
import math
import re

import numpy as np
import pytest

from tessera.llm import fill_middle as M
from tessera.llm import filter_audit as A
from tessera.llm import norm_topk as N

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def brute_audit(docs, labels):
    def fails(i, text):
        ws, first = WORDS.findall(text), [d for d, t, _ in docs if (t or "") == text and d is not None]
        return {
            "A": len(ws) < 200, "B": 100 * len(set(ws)) < 50 * len(ws), "C": 100 * len(re.findall("[A-Z]", text)) > 3 * len(text),
            "D": bool(re.search(r"[#$%&*|]", text)), "E": i is not None and any(d < i for d in first),
        }

    told = [(p or "", fails(i, t or ""), any(d == i and q == 1 for d, q, _ in labels if d is not None), any(d == i and x == 1 for d, _, x in labels if d is not None)) for i, t, p in docs]
    out = []
    for part in {t[0] for t in told}:
        mine, removed_by = [t[1:] for t in told if t[0] == part], dict.fromkeys("ABCDE", 0)
        rows = []
        for order in itertools.permutations("ABCDE"):
            left = mine
            for k, own in enumerate(order):
                gone, left = [t for t in left if t[0][own]], [t for t in left if not t[0][own]]
                removed_by[own] += len(gone)
                every = sum(t[0][own] for t in mine)
                unique = sum(t[0][own] and sum(t[0].values()) == 1 for t in mine)
                rows.append((part, "".join(order), k + 1, len(left), len(gone), every - len(gone), unique, sum(t[1] for t in gone), sum(t[2] for t in gone), own))
        out += [(*r[:-1], removed_by[r[-1]]) for r in rows]
    return sorted(out)


def test_audit_equals_brute_force(spark):
    long = " ".join(f"w{k}" for k in range(230))
    docs = [
        (1, long, "en"), (2, long, "en"), (2, long, "en"), (3, long, "fr"), (4, long + " #", "en"), (4, long + " #", None), (5, None, "en"), (6, "", "en"), (7, "ABC def", "fr"), (8, "a b " * 300, ""),
        (None, long, "en"), (None, None, "en"), (9, "一A\U0001f600" * 40, "zh"), (10, long.upper(), "en"), (11, long.upper(), "fr"), (1, "x", "en"), (12, "q " * 200 + "* Z", "fr"), (13, long + "\x1c" + long, "en"),
    ]
    labels = [(1, 1, 0), (2, 0, 1), (2, 1, None), (3, 1, 1), (5, None, None), (6, 1, 1), (99, 1, 1), (None, 1, 1), (11, 1, 0)]
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string").selectExpr("*", "1 as bits", "2 as n", "3 as part", "4 as good")
    got = A.audit(d.repartition(3), spark.createDataFrame(labels, "doc_id long, quality int, toxic int").selectExpr("*", "7 as good"))
    assert sorted(tuple(r) for r in got.collect()) == brute_audit(docs, labels)
    assert A.audit(d.limit(0), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).count() == 0
    only = A.audit(d.where("doc_id = 1"), spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert only.count() == 600 and only.agg({"good_lost": "sum"}).first()[0] == 0


def test_words_of_long_texts_are_counted_in_pieces(monkeypatch):
    text = (" ".join(f"w{k % 700}" for k in range(40_000)) + " \t\n").encode()
    whole = A.words_of(text)
    monkeypatch.setattr(A, "_PIECE", 1000)
    assert A.words_of(text) == whole == (40_000, 700)
    assert A.words_of(b"x" * 5000) == (1, 1) and A.words_of(b" " * 5000) == (0, 0)


def test_contractions_equal_sums():
    t = np.arange(32).reshape((2,) * 5)
    rows, picks = A._selections()
    assert len(rows) == 600
    for k in (0, 77, 599):
        for name in picks:
            s = picks[name][k]
            want = sum(int(t[i]) for i in itertools.product((0, 1), repeat=5) if all(s[a][i[a]] for a in range(5)))
            assert A.contract(t, picks[name])[k] == want


def brute_topk(rows, k=5):
    def z(x):
        return [math.floor(256 * v) for v in x]

    held = {(i, tuple(z(x))) for i, x in rows if i is not None and x is not None and all(v is not None and math.isfinite(v) for v in x)}
    best = {}
    for i, q in held:
        if i % 50 == 0:
            best.setdefault(i, []).extend((-sum(a * b for a, b in zip(q, v)), j) for j, v in held if j != i)
    return sorted((i, r + 1, j, -s) for i, found in best.items() for r, (s, j) in enumerate(sorted(found)[:k]))


@pytest.mark.parametrize("kind", ["unit", "lengths", "copies", "close"])
def test_topk_equals_brute_force(spark, monkeypatch, kind):
    r = np.random.default_rng(3)
    x = r.normal(size=(900, 12))
    if kind == "unit":
        x /= np.linalg.norm(x, axis=1)[:, None]
    elif kind == "lengths":
        x *= r.lognormal(sigma=1.5, size=(900, 1))
    elif kind == "copies":
        x = x[r.integers(0, 6, 900)]
    else:
        x = r.normal(size=(20, 12))[r.integers(0, 20, 900)] * (1 + 0.02 * r.normal(size=(900, 12)))
    monkeypatch.setattr(N, "BUCKET", 32)
    monkeypatch.setattr(N, "SHARD_COMPONENTS", 12 * 128)
    monkeypatch.setattr(N, "SEEDS", 64)
    monkeypatch.setattr(N, "SLICE", 7)
    rows = [(int(i) - 100, v.astype(np.float32).astype(float).tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 as norm", "'a' as z", "2 as shard", "true as is_query")
    got = N.norm_topk(df.repartition(5), df["vec_id"] % 50 == 0)
    assert sorted(tuple(t) for t in got.collect()) == brute_topk(rows)


def test_topk_of_odd_vectors(spark):
    inf, nan = math.inf, math.nan
    rows = [
        (0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, None), (3, [nan, 1.0]), (4, [None, 1.0]), (5, [inf, 0.0]), (None, [9.0, 9.0]), (6, [0.0, 0.0]), (7, []), (8, [-1.0]), (50, [0.0, 0.0]),
        (100, [1e-9, -1e-9]), (9, [3e4, 5.0]), (150, [0.0, 1.0, 2.0]), (150, [0.0, -1.0]), (200, [-5e4, 1.0]),
    ]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")

    def padded(x):
        return None if x is None else x + [0.0] * (3 - len(x))

    want = brute_topk([(i, padded(x)) for i, x in rows])
    assert sorted(tuple(t) for t in N.norm_topk(df, df["vec_id"] % 50 == 0).collect()) == want
    assert N.norm_topk(df.limit(0), df["vec_id"] % 50 == 0).count() == 0
    one = df.where("vec_id = 50")
    assert N.norm_topk(one, one["vec_id"] % 50 == 0).count() == 0
    huge = spark.createDataFrame([(50, [1e300]), (1, [1e300]), (2, [-1e300])], "vec_id long, embedding array<double>")
    got = sorted(tuple(t) for t in N.norm_topk(huge, huge["vec_id"] % 50 == 0).collect())
    assert got == [(50, 1, 1, 2**63 - 1), (50, 2, 2, -(2**63) + 1)]


def test_pruning_keeps_what_a_cosine_allows():
    r = np.random.default_rng(5)
    z = N.quantised(r.normal(size=(500, 8)))
    norms = np.linalg.norm(z, axis=1)
    bucket = N.Bucket(np.arange(500), z.astype(np.int16), norms)
    for q in r.normal(size=(50, 8)):
        q /= np.linalg.norm(q)
        for cosine in (0.8, 0.9, 0.99):
            near = set(bucket.within(q, cosine).tolist())
            assert set(np.flatnonzero(z @ q / norms >= cosine).tolist()) <= near
            assert cosine < 0.9 or len(near) < 250


UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def brute_middle(doc_id, text):
    text = text or ""
    units = UNIT.findall(text)
    n, digest = len(units), hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    plain = not text or any(t in text for t in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50
    form = "plain" if plain else "spm" if h[3] % 100 < 80 else "psm"
    out = {"plain": text, "psm": f"<P>{p}<S>{s}<M>{m}", "spm": f"<S>{s}<P>{p}<M>{m}"}[form]

    def sha(t):
        return hashlib.sha256(t.encode()).hexdigest()

    return (doc_id, n, form, None if plain else len(p), None if plain else len(m), sha(out), sha(text))


def test_fill_middle_equals_brute_force(spark):
    texts = [
        None, "", " ", "\n\t", "word", " word ", "a b  c\r\n\x0b\x0cd ", " x y　z", "<P>", "a <S> b", "<M", "<<P>>", "S> P> M>", "<", "a<", "\U0001f600 \U0001f601\U0001f602 é",
        "line one\nline two\n\n", "$1 \\ $3 {2}", "x " * 5, "\x00 \x1c\x1d y", "end\n",
    ]
    rows = [(k * 31 + j, t) for k in range(12) for j, t in enumerate(texts)] + [(None, "a b c d"), (7, "a b"), (7, "a b")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as h1", "'q' as form", "2 as n", "'z' as output")
    got = M.digests(M.fill_middle(df)).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(repr(brute_middle(*r)) for r in rows)
    assert {r.form for r in got} == {"plain", "spm", "psm"}
    assert M.digests(M.fill_middle(df.limit(0))).count() == 0


def test_fill_middle_of_very_long_texts(spark):
    rows = [(k, f"w{k} é\n" * 400_000) for k in range(4, 12)] + [(20, "y" * 3_000_000), (21, " " * 2_000_000)]
    got = M.digests(M.fill_middle(spark.createDataFrame(rows, "doc_id long, text string"))).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(repr(brute_middle(*r)) for r in rows)
    assert any(r.form != "plain" for r in got)


def test_fill_middle_parts_come_back(spark):
    df = spark.createDataFrame([(k, f"one two three {k} four five") for k in range(60)], "doc_id long, text string")
    for r in M.restored(M.fill_middle(df)).collect():
        if r.form != "plain":
            assert r.prefix + r.middle + r.suffix == r.text == f"one two three {r.doc_id} four five"
