import numpy as np
import pytest

from tessera.llm import common as C


def test_words_and_shingles():
    assert C.words("A b, C-d\n'É' 1") == [b"a", b"b", b"c", b"d", "é".encode(), b"1"]
    assert C.words(None) == C.words("") == C.words(" .,;\n") == []
    assert len(C.shingle_hashes([])) == 0 and C.text_key([]) is None
    assert len(C.shingle_hashes([b"a", b"b"])) == 1 and len(C.shingle_hashes([b"a"] * 7)) == 3


@pytest.mark.parametrize("seed", [0, 1])
def test_components_match_union_find(spark, seed):
    r = np.random.default_rng(seed)
    edges = [(int(a), int(b)) for a, b in r.integers(0, 300, (220, 2))] + [(k, k + 1) for k in range(1000, 1060)] + [(5, 5)]
    root = {}

    def top(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        p, q = top(a), top(b)
        root[max(p, q)] = min(p, q)
    got = {r.node: r.component for r in C.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: top(x) for x in root if top(x) != x}
    assert C.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_runs_join_batches(spark):
    import pyarrow as pa

    parts = [pa.RecordBatch.from_pydict({"k": x}) for x in ([1, 1, 2], [2, 2], [], [3])]
    assert [t.column("k").to_pylist() for t in C.runs(iter(parts), ["k"])] == [[1, 1], [2, 2, 2], [3]]
