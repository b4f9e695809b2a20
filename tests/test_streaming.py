"""Sinks that survive a kill, leases that end by time, change feeds and rolling windows on streams."""

import datetime
import random

import pytest
import pandas as pd
from pyspark.sql import functions as F

from tessera.operators import relational as R
from tessera.sources import intake as I
from tessera.streaming import feed
from tessera.streaming import jobs as J
from tessera.streaming import leases as L
from tessera.streaming.sink import TableSet, fenced

TABLES = {n: "paper_id long, n int, v string" for n in ("sections", "chunks", "pages", "tables", "facts")}


def rows(spark, k, ids, v):
    return {n: spark.createDataFrame([(i, j, f"{v}{n}") for i in ids for j in range(k)], "paper_id long, n int, v string") for n in TABLES}


def stands(t):
    return {n: sorted((r.paper_id, r.n, r.v) for r in t.read(n).collect()) for n in TABLES}


def test_tables_change_at_once_or_not_at_all(spark, tmp_path, monkeypatch):
    t = TableSet(spark, str(tmp_path), "paper_id", TABLES)
    assert t.write(0, rows(spark, 2, [1, 2, 3], "a"))
    before = stands(t)
    put, seen = TableSet._put, []

    def dies(self, part, batch, df):
        if part == "data/pages":
            raise RuntimeError("killed")
        seen.append(part)
        put(self, part, batch, df)

    new, keys = rows(spark, 3, [2, 9], "b"), spark.createDataFrame([(2,), (3,), (9,), (None,)], "paper_id long")
    monkeypatch.setattr(TableSet, "_put", dies)
    with pytest.raises(RuntimeError):
        t.write(1, new, keys)
    assert seen == ["keys", "data/sections", "data/chunks"] and stands(t) == before
    monkeypatch.setattr(TableSet, "_put", put)
    again = TableSet(spark, str(tmp_path), "paper_id", TABLES)
    assert again.write(1, new, keys)
    want = {n: sorted([r for r in before[n] if r[0] == 1] + [(i, j, f"b{n}") for i in (2, 9) for j in range(3)]) for n in TABLES}
    assert stands(again) == want
    assert not again.write(1, rows(spark, 1, [1], "c")) and stands(again) == want
    fresh = again.compacted(f"{tmp_path}/fresh")
    assert stands(fresh) == want and fresh.done(1)
    again.write(2, {}, spark.createDataFrame([(1,)], "paper_id long"))
    assert all(r[0] != 1 for r in stands(again)["facts"])


def test_inserts_and_upserts_count_once(spark, tmp_path):
    kind = "k string, at int, v string"
    t = TableSet(spark, f"{tmp_path}/a", "k", {"usage": kind})
    frame = lambda xs: spark.createDataFrame(xs, kind)
    assert t.insert(0, "usage", frame([("x", 2, "b"), ("x", 1, "a"), ("y", 5, "c"), (None, 1, "n")]), "at")
    assert t.insert(1, "usage", frame([("x", 0, "z"), ("w", 1, "d")]), "at") and not t.insert(1, "usage", frame([("q", 0, "z")]), "at")
    assert sorted(map(tuple, t.read("usage").collect())) == [("w", 1, "d"), ("x", 1, "a"), ("y", 5, "c")]
    u = TableSet(spark, f"{tmp_path}/b", "k", {"notes": kind})
    u.upsert(0, "notes", frame([("x", 1, "a"), ("x", 3, "c"), ("x", 3, "b"), ("y", 1, "y")]), "at")
    u.upsert(1, "notes", frame([("y", 0, "new")]), "at")
    assert sorted(map(tuple, u.read("notes").collect())) == [("x", 3, "b"), ("y", 0, "new")]


def test_lost_claims_write_nothing(spark):
    made = spark.createDataFrame([(1, "t1"), (2, "t1"), (3, "t1"), (4, "t1")], "paper_id long, token string")
    claims = spark.createDataFrame([(1, "t1", "processing"), (2, "t2", "processing"), (3, "t1", "ready")], "paper_id long, token string, status string")
    assert [r.paper_id for r in fenced(made, claims, "paper_id", "token").collect()] == [1]


def test_foreach_batch_writes_each_batch_once(spark, tmp_path):
    t = TableSet(spark, f"{tmp_path}/t", "paper_id", {"chunks": TABLES["chunks"]})
    for k in range(3):
        rows(spark, 2, [k, k + 1], f"b{k}")["chunks"].coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    read = spark.readStream.schema(TABLES["chunks"]).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    for check in ("one", "two"):  # a lost checkpoint replays every batch
        q = read.writeStream.foreachBatch(t.sink(lambda b: ({"chunks": b}, None))).option("checkpointLocation", f"{tmp_path}/{check}").trigger(availableNow=True).start()
        assert q.awaitTermination(120) and q.exception() is None
        got = sorted(map(tuple, t.read("chunks").collect()))
        assert got == sorted((i, j, f"b{min(i, 2)}chunks") for i in range(4) for j in range(2))


def run_stream(spark, out, path, check):
    query = out.writeStream.format("parquet").option("path", path).option("checkpointLocation", check).trigger(availableNow=True).start()
    assert query.awaitTermination(240)
    assert query.exception() is None
    return spark.read.parquet(path)


def test_leases_end_without_an_event(spark, tmp_path):
    kind = "job string, seq long, ts double, action string, token string, generation string, n long"
    at = 1_000_000.0
    script = [
        [("a", 0, at, "request", None, "g", None), ("a", 1, at, "claim", "t1", None, None), ("b", 0, at, "request", None, "g", None), ("c", 0, at, "request", None, "g", None), ("c", 1, at, "claim", "t", None, None), ("c", 2, at + 1, "complete", "t", "g", 0)],
        [("b", 1, at + 10, "claim", "t1", None, None), ("b", 0, at + 9, "fail", "t1", None, None), ("z", 0, at + 3000, "request", None, "g", None)],
        [("a", 2, at + 3001, "claim", "t2", None, None), ("z", 1, at + 9000, "claim", "t", None, None)],
        [("z", 2, at + 200_000, "release", "t", None, None)], [("z", 3, at + 200_001, "claim", "t", None, None)],
    ]
    for k, part in enumerate(script):
        spark.createDataFrame(part, kind).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    events = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    out = run_stream(spark, L.lease_stream(events, J.Rules(attempts=2, lease=900), "1 second", keep=5000), f"{tmp_path}/out", f"{tmp_path}/check").collect()
    told = {k: [(r.seq, r.outcome, r.status) for r in out if r.job == k] for k in "abc"}
    assert sorted(told["a"], key=str) == sorted([(0, "requested", "queued"), (1, "claimed", "running"), (None, "lapsed", "running"), (2, "claimed", "running"), (None, "expired", "failed"), (None, "forgotten", "failed")], key=str)
    assert (0, "late", "queued") in told["b"] and (None, "lapsed", "running") in told["b"] and (1, "claimed", "running") in told["b"]
    assert (None, "forgotten", "complete") in told["c"]
    batch = {(r.job, r.seq): r.outcome for r in J.replay(spark.createDataFrame([e for part in script for e in part if e[:2] != ("b", 0) or e[3] == "request"], kind), J.Rules(attempts=2, lease=900)).collect()}
    assert all(batch[r.job, r.seq] == r.outcome for r in out if r.seq is not None and r.outcome != "late")


class _Handle:
    """State and timers of one group, counted."""

    def __init__(self):
        self.value, self.timers, self.updates = None, set(), 0

    def getValueState(self, name, kind):
        return self

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value, self.updates = value, self.updates + 1

    def clear(self):
        self.value = None

    def listTimers(self):
        return iter(self.timers)

    deleteTimer = lambda self, at: self.timers.discard(at)
    registerTimer = lambda self, at: self.timers.add(at)


def test_jobs_of_a_group_share_a_call_and_a_timer():
    class At:
        def __init__(self, ms):
            self.getExpiryTimeInMs = self.getCurrentWatermarkInMs = lambda: ms

    leases, handle = L._Leases(J.Rules(attempts=1, lease=10), keep=50), _Handle()
    leases.init(handle)
    rows = [(j, k, float(at + k), a, "t" if k else None, "g", None) for j, at in (("a", 0), ("b", 5), ("c", 0)) for k, a in enumerate(("request", "claim", "complete")[: 3 if j == "c" else 2])]
    said = lambda frames: [(r.job, None if pd.isna(r.seq) else r.seq, r.outcome, r.status) for f in frames for r in f.itertuples()]
    first = said(leases.handleInputRows((7,), iter([pd.DataFrame(rows[:3], columns=L._EVENT), pd.DataFrame(rows[3:], columns=L._EVENT)]), At(0)))
    assert sorted(first) == [("a", 0, "requested", "queued"), ("a", 1, "claimed", "running"), ("b", 0, "requested", "queued"), ("b", 1, "claimed", "running"), ("c", 0, "requested", "queued"), ("c", 1, "claimed", "running"), ("c", 2, "completed", "complete")]
    assert handle.timers == {11_001} and handle.updates == 1
    assert said(leases.handleExpiredTimer((7,), At(11_001), At(11_001))) == [("a", None, "expired", "failed")] and handle.timers == {16_001}
    assert said(leases.handleExpiredTimer((7,), At(60_000), At(16_001))) == [("b", None, "expired", "failed"), ("c", None, "forgotten", "complete")]
    assert sorted(said(leases.handleExpiredTimer((7,), At(200_000), At(61_002)))) == [("a", None, "forgotten", "failed"), ("b", None, "forgotten", "failed")]
    assert handle.value is None and not handle.timers


def test_changes_make_an_activity_once(spark, tmp_path):
    kind = "change_id string, ts timestamp_ntz, op string, project long, paper long"
    at = datetime.datetime(2024, 1, 1)
    parts = [
        [("c1", at, "insert", 1, 7), ("c2", at + datetime.timedelta(hours=1), "insert", 1, 8), ("c2", at + datetime.timedelta(hours=1), "insert", 1, 8)],
        [("c3", at + datetime.timedelta(hours=5), "delete", 1, 7), ("c1", at, "insert", 1, 7), ("c4", at, "usage", 2, None)],
        [("c2", at + datetime.timedelta(hours=1), "insert", 1, 8), ("c5", at + datetime.timedelta(minutes=5), "insert", 3, 7), (None, at, "insert", 9, 9)],
    ]
    for k, part in enumerate(parts):
        spark.createDataFrame(part, kind).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    read = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    store = feed.activity_store(spark, f"{tmp_path}/store")
    for check in ("one", "two"):  # c5 is late, and the second run repeats every change
        q = feed.activity_feed(read, store, f"{tmp_path}/{check}")
        assert q.awaitTermination(120) and q.exception() is None
        got = sorted((r.change_id, r.kind, r.project, r.paper) for r in store.read("activity").collect())
        assert got == [("c1", "paper_linked", 1, 7), ("c2", "paper_linked", 1, 8), ("c3", "paper_unlinked", 1, 7), ("c5", "paper_linked", 3, 7)]


def test_reads_are_taken_again_until_they_hold(spark, tmp_path):
    def put(generations, rows):
        spark.createDataFrame(generations, "paper long, generation string").coalesce(1).write.mode("overwrite").parquet(f"{tmp_path}/papers")
        spark.createDataFrame(rows, "paper long, chunk int").coalesce(1).write.mode("overwrite").parquet(f"{tmp_path}/chunks")

    put([(1, "a"), (2, "a"), (3, None), (4, "a")], [(1, 1), (2, 1), (3, 1)])
    calls = []

    def children(keys):
        calls.append(sorted(r.paper for r in keys.collect()))
        found = keys.sparkSession.read.parquet(f"{tmp_path}/chunks").join(keys, "paper", "left_semi").persist()
        found.count()
        if len(calls) == 1:  # a writer comes between the two reads
            put([(1, "a"), (2, "b"), (3, None)], [(1, 1), (2, 5), (2, 6), (3, 1)])
        return found

    take = lambda: spark.read.parquet(f"{tmp_path}/papers")
    rows, unsettled = I.settled_read(take, children, "paper", "generation")
    assert calls == [[1, 2, 3, 4], [2]]  # 4 is gone
    assert sorted((r.paper, r.generation, r.chunk) for r in rows.collect()) == [(1, "a", 1), (2, "b", 5), (2, "b", 6), (3, None, 1)]
    assert unsettled.count() == 0

    def always(keys):
        put([(1, f"g{len(calls)}")], [(1, 1)])
        calls.append(1)
        return keys.sparkSession.createDataFrame([(1, 1)], "paper long, chunk int")

    rows, unsettled = I.settled_read(take, always, "paper", "generation", tries=2)
    assert rows.count() == 0 and [r.paper for r in unsettled.collect()] == [1]


def test_rolling_stream_equals_the_batch_window(spark, tmp_path):
    r = random.Random(4)
    start = datetime.datetime(2024, 1, 1)
    data = [(f"u{r.randint(0, 3)}", i, start + datetime.timedelta(seconds=r.randint(0, 1200) / 2), r.choice([None, 1, 5])) for i in range(300)]
    kind = "key string, id long, ts timestamp_ntz, amount long"
    arrival = sorted(data, key=lambda x: x[2] + datetime.timedelta(seconds=r.randint(0, 50)))  # shuffled within the delay
    for k in range(0, 300, 60):
        spark.createDataFrame(arrival[k : k + 60], kind).coalesce(1).write.parquet(f"{tmp_path}/in/{k:03d}")
    spark.createDataFrame([("end", -1, start + datetime.timedelta(hours=3), 0)], kind).coalesce(1).write.parquet(f"{tmp_path}/in/998")
    spark.createDataFrame([("end", -2, start + datetime.timedelta(hours=9), 0)], kind).coalesce(1).write.parquet(f"{tmp_path}/in/999")
    read = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    got = run_stream(spark, L.rolling_stream(read, 60, "1 minute"), f"{tmp_path}/out", f"{tmp_path}/check")
    want = R.rolling_use(spark.createDataFrame(data, kind).na.fill(0, ["amount"]), "key", "ts", 60, "amount")
    assert sorted((x.id, x.in_window, x.amount_in_window) for x in got.where("id >= 0").collect()) == sorted((x.id, x.in_window, x.amount_in_window) for x in want.collect())


def test_rolling_stream_calls_python_by_groups_of_keys(spark, tmp_path):
    spark.createDataFrame([], "key string, id long, ts timestamp_ntz, amount long").write.parquet(f"{tmp_path}/in")
    read = spark.readStream.schema("key string, id long, ts timestamp_ntz, amount long").parquet(f"{tmp_path}/in")
    plan = L.rolling_stream(read)._jdf.queryExecution().analyzed().toString()
    assert "xxhash64(key" in plan, plan
