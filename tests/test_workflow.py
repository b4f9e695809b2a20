"""Leased jobs in batch and as a stream, evidence packets and candidate terms against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import citations as C
from tessera.operators import evidence as E
from tessera.operators import graph as G
from tessera.streaming import jobs as J

KIND = "job string, seq long, ts double, action string, token string, generation string, n long"


def scripts():
    at = 1000.0
    a = [("a", 0, at, "request", None, "g1", None), ("a", 1, at + 1, "claim", "t1", None, None), ("a", 2, at + 2, "store", "t0", "g1", 2), ("a", 3, at + 3, "store", "t1", "g1", 2), ("a", 4, at + 4, "complete", "t1", "g1", 3), ("a", 5, at + 5, "store", "t1", "g1", 1), ("a", 6, at + 6, "complete", "t1", "g1", 3), ("a", 7, at + 7, "claim", "t2", None, None), ("a", 8, at + 8, "request", None, "g1", None), ("a", 9, at + 9, "request", None, "g2", None)]
    b = [("b", 0, at, "claim", "t1", None, None), ("b", 1, at, "request", None, "g1", None), ("b", 2, at, "claim", "t1", None, None), ("b", 3, at + 1, "retry", "t1", None, None), ("b", 4, at + 2, "claim", "t2", None, None), ("b", 5, at + 100, "claim", "t2", None, None), ("b", 6, at + 101, "release", "t2", None, None), ("b", 7, at + 102, "claim", "t3", None, None), ("b", 8, at + 2000, "claim", "t4", None, None), ("b", 9, at + 2001, "store", "t3", "g1", 1), ("b", 10, at + 4000, "claim", "t5", None, None), ("b", 11, at + 4001, "fail", "t4", None, None)]
    want = {"a": "requested claimed lost stored incomplete stored completed not_eligible unchanged requested".split(), "b": "not_eligible requested claimed retried not_eligible claimed released claimed claimed lost expired lost".split()}
    return a + b, want


def test_replay_follows_the_leases(spark):
    rows, want = scripts()
    random.Random(1).shuffle(rows)
    got = J.replay(spark.createDataFrame(rows, KIND)).collect()
    assert {k: [r.outcome for r in sorted((r for r in got if r.job == k), key=lambda r: r.seq)] for k in want} == want
    last = max((r for r in got if r.job == "b"), key=lambda r: r.seq)
    assert (last.status, last.attempts) == ("failed", 3)
    assert J.replay(spark.createDataFrame([], KIND)).count() == 0


def test_stream_says_what_the_replay_says(spark, tmp_path):
    rows, _ = scripts()
    df = spark.createDataFrame(rows, KIND)
    for k, part in enumerate([(0, 3), (3, 7), (7, 99)]):
        df.where(f"seq >= {part[0]} and seq < {part[1]}").coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    events = spark.readStream.schema(KIND).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    query = J.stream(events).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert query.exception() is None
    order = ["job", "seq"]
    assert spark.read.parquet(f"{tmp_path}/out").orderBy(order).collect() == J.replay(df).orderBy(order).collect()


def slow_packet(rows, most, budget, largest):
    """Fields in turn, each the first chunk of its queue that is new and fits, passing for good those that do not."""
    rows = [r for r in rows if r[4] <= largest]
    queues = {f: sorted({(p, i, c) for c, i, g, p, _ in rows if g == f}) for f in E.FIELDS}
    sizes = {c: s for c, _, _, _, s in rows}
    taken, used = [], 0
    while len(taken) < most:
        before = len(taken)
        for f in E.FIELDS:
            while queues[f] and len(taken) < most:
                c = queues[f].pop(0)[2]
                if c not in taken and used + sizes[c] <= budget:
                    taken.append(c)
                    used += sizes[c]
                    break
        if len(taken) == before:
            break
    return set(taken)


def test_evidence_packet(spark):
    r = random.Random(5)
    rows = []
    for paper in range(30):
        size = {c: r.randint(1, 60) for c in range(25)}
        rows += [(paper, c, c, f, r.randint(0, 2), size[c]) for c in range(25) for f in E.FIELDS if r.random() < 0.3]
    df = spark.createDataFrame(rows, "paper_id long, chunk_id long, chunk_index long, field string, priority int, size int")
    got = E.evidence_packet(df, most=9, budget=200, largest=50).collect()
    for paper in range(30):
        mine = [x for x in got if x.paper_id == paper]
        assert {x.chunk_id for x in mine} == slow_packet([x[1:] for x in rows if x[0] == paper], 9, 200, 50)
        assert [x.chunk_id for x in sorted(mine, key=lambda x: int(x.evidence_id[1:]))] == sorted(x.chunk_id for x in mine)


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("We use the BERT language model, and bag of words.", {"BERT": "bert", "BERT language": "bert language", "BERT language model": "bert language model", "language model": "language model", "bag of words": "bag of words"}),
        ("C++ and the model of data", {"C++": "c++"}), ("GPT 4 results", {"GPT": "gpt", "GPT 4": "gpt 4"}), ("deep-learning: cell-content", {"deep-learning": "deep learning", "cell-content": "cell content"}), ("", {}), (None, {}), ("the of and", {}),
    ],
)
def test_candidate_terms(spark, text, want):
    df = spark.createDataFrame([(1, text)], "item long, text string").withColumn("words_in", F.lit(1))
    assert {r.phrase: r.key for r in G.candidates(df).collect()} == want


def test_odd_metadata(spark):
    df = spark.createDataFrame([(1, None, None, None, None, None, None, None, None, None, None), (2, "ﬁne​ title", ["a"] * 60 + ["b"], 3001, " ", "x" * 400, "doi:10.1/x", "https://h", None, "", "1")], "paper_id long, title string, authors array<string>, publication_year int, container_title string, publisher string, doi string, url string, volume string, issue string, pages string")
    a, b = C.normalize_metadata(df).orderBy("paper_id").collect()
    assert (a.title, a.authors, a.publication_year) == ("", [], None)
    assert (b.title, len(b.authors), b.publication_year, b.container_title, len(b.publisher), b.doi, b.url, b.issue) == ("fine title", 50, None, None, 300, None, "https://h/", None)
    assert C.normalize_metadata(df.where("false")).count() == 0
