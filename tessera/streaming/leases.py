"""Leased jobs as a stream that sees time pass: leases end, and finished jobs go, without another event (ST1, ST3, ST8).

jobs.stream learns of an ended lease from a job's next event, and keeps every job. Here a timer of
event time stands for the end of each lease: it says `expired` where no attempt is left, and `lapsed`
where the next claim may take the job. Another removes the state of a job that has been finished for
long enough. Jobs are held by groups, whose timer is the first of their jobs'. The step between events is that of the batch replay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .jobs import _EMPTY, KIND, Rules, _events, step

_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_EVENT = ["job", "seq", "ts", "action", "token", "generation", "n"]
_EVENTS = pa.schema(list(zip(_EVENT, [pa.string(), pa.int64(), pa.float64(), pa.string(), pa.string(), pa.string(), pa.int64()], strict=True)))
_COLUMNS = ["job", "seq", "outcome", "status", "attempts", "stored"]


def _timers(rows: DataFrame) -> None:
    """Timers need the RocksDB state store."""
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKS)


# Jobs and keys are dealt over so many groups: a call to Python, its timer and its state serve all of a group.
GROUPS = 512
_JOB = ["job", "status", "attempts", "token", "updated", "ready", "stored", "generation", "last", "told"]
_KINDS = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.float64(), pa.float64(), pa.int64(), pa.string(), pa.int64(), pa.bool_()]


def _packed(table: pa.Table) -> bytes:
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, table.schema) as writer:
        writer.write_table(table)
    return out.getvalue().to_pybytes()


class _Leases(StatefulProcessor):
    """Jobs of a group, each with its own state and end; one timer stands at the first end of any."""

    def __init__(self, rules: Rules, keep: float):
        self.rules, self.keep = rules, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("jobs", "rows binary")

    def _jobs(self) -> dict[str | None, tuple[tuple, int, bool]]:
        """The state of each job, its last sequence number, and whether the end of its lease has been told."""
        if not self.held.exists():
            return {}
        with pa.ipc.open_stream(bytes(self.held.get()[0])) as rows:
            return {job: (tuple(state), last, told) for job, *state, last, told in zip(*(c.to_pylist() for c in rows.read_all().columns), strict=True)}

    def _due(self, state: tuple, told: bool) -> int | None:
        """The time in ms when a job's lease has ended, or its state may go."""
        status, updated = state[0], state[3]
        if status in ("complete", "failed") or (status == "running" and not told):
            return int((updated + (self.rules.lease if status == "running" else self.keep)) * 1000) + 1
        return None

    def _put(self, jobs: dict[str | None, tuple[tuple, int, bool]]) -> None:
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        if not jobs:
            self.held.clear()
            return
        rows = [(job, s, int(n), t, float(u), float(r), int(k), g, int(last), told) for job, ((s, n, t, u, r, k, g), last, told) in jobs.items()]
        self.held.update((_packed(pa.table(dict(zip(_JOB, (pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), _KINDS, strict=True)), strict=True)))),))
        due = [at for state, _, told in jobs.values() if (at := self._due(state, told)) is not None]
        if due:
            self.handle.registerTimer(min(due))

    def _ended(self, state: tuple, at: float) -> tuple[tuple, str]:
        """A running job once its lease has ended: the last attempt fails, any other waits for a claim."""
        status, attempts, token, updated, ready, stored, generation = state
        if attempts >= self.rules.attempts:
            return ("failed", attempts, None, at, ready, stored, generation), "expired"
        return state, "lapsed"

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        jobs = self._jobs()
        out = []
        events = pa.concat_tables([pa.Table.from_pandas(r[_EVENT], _EVENTS, preserve_index=False) for r in rows]).sort_by("seq")
        for job, *event in zip(*(c.to_pylist() for c in events.columns), strict=True):
            state, last, told = jobs.get(job, (_EMPTY, -1, False))
            if event[0] <= last:
                out.append((job, event[0], "late", state))
                jobs.setdefault(job, (state, last, told))
                continue
            end = state[3] + self.rules.lease
            # events of a batch come before its timers, so an end that lies before an event is told here; step tells that of a last attempt to a claim
            if state[0] == "running" and not told and end < event[1] and not (event[2] == "claim" and state[1] >= self.rules.attempts):
                state, outcome = self._ended(state, end)
                out.append((job, None, outcome, state))
            before = state
            state, outcome = step(self.rules, state, event)
            told, last = state[0] == "running" and state[3] == before[3] and end < event[1], event[0]
            out.append((job, last, outcome, state))
            jobs[job] = (state, last, told)
        self._put(jobs)
        yield _frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """All ends that the watermark has passed: a job that fails by one may be forgotten by the next."""
        until = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        jobs, out = self._jobs(), []
        for job, (state, last, told) in list(jobs.items()):
            while (at := self._due(state, told)) is not None and at <= until:
                if state[0] != "running":
                    out.append((job, None, "forgotten", state))
                    del jobs[job]
                    break
                state, outcome = self._ended(state, at / 1000)
                out.append((job, None, outcome, state))
                told = True
                jobs[job] = (state, last, told)
        self._put(jobs)
        yield _frame(out)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    told = [(job, seq, outcome, state[0], int(state[1]), int(state[5])) for job, seq, outcome, state in rows]
    return pd.DataFrame(told, columns=_COLUMNS).astype({"seq": "Int64"})


def lease_stream(events: DataFrame, rules: Rules = Rules(), delay: str = "1 minute", keep: float = 86_400.0) -> DataFrame:
    """ST1, ST3, ST8: what became of each of a stream's events(job, seq, ts, action, token, generation, n), and of leases that end.

    A row of a timer has no seq. Events of a batch are taken by seq; one at or below a job's last is
    `late` and changes nothing. Time is the events' own, delay behind the latest; state of a finished
    job goes after keep seconds of it, and a request after that starts afresh.
    """
    _timers(events)
    timed = _events(events).withColumn("at", F.timestamp_seconds("ts")).withWatermark("at", delay)
    grouped = timed.withColumn("group", F.pmod(F.xxhash64("job"), F.lit(GROUPS))).groupBy("group")
    return grouped.transformWithStateInPandas(_Leases(rules, keep), KIND, "Append", "EventTime")


# --- W9: what was used in the seconds before each request ------------------------------------------------------------
_USE = "key string, id long, in_window long, amount_in_window long"
_TOLD = ["key", "id", "in_window", "amount_in_window"]


_KEPT = ["key", "id", "micros", "amount", "told"]


class _Rolling(StatefulProcessor):
    """Requests of a group of keys wait until the watermark has passed them, so that they count in order of time however they arrive."""

    def __init__(self, seconds: float):
        self.every = int(seconds * 1_000_000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("kept", "rows binary")

    def _rows(self) -> pd.DataFrame:
        if not self.kept.exists():
            return pd.DataFrame(columns=_KEPT)
        with pa.ipc.open_stream(bytes(self.kept.get()[0])) as rows:
            return rows.read_pandas()

    def _keep(self, rows: pd.DataFrame) -> None:
        """One timer stands, at the end of the window of the first request that waits."""
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        if rows.empty:
            self.kept.clear()
            return
        self.kept.update((_packed(pa.Table.from_pandas(rows, preserve_index=False)),))
        waiting = rows["micros"][~rows["told"].astype(bool)]
        if len(waiting):
            every = max(self.every // 1000, 1)
            self.handle.registerTimer((int(waiting.min()) // 1000 // every + 1) * every)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        fresh = pd.concat(list(rows))[_KEPT[:4]].assign(told=False)
        held = self._rows()
        self._keep(fresh if held.empty else pd.concat([held, fresh]))
        yield pd.DataFrame(columns=_TOLD)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        until = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs()) * 1000
        rows = self._rows()
        past = rows[rows["micros"] < until]
        code = pd.factorize(past["key"], use_na_sentinel=False)[0]
        order = np.lexsort((past["micros"], code))
        past, code = past.iloc[order], code[order]
        due = ~past["told"].to_numpy(bool)
        # keys stand one after another, a window and more apart
        at = past["micros"].to_numpy(np.int64)
        at = at - at.min() + self.every if len(at) else at
        span = int(at.max()) + 1 if len(at) else 1
        place = code.astype(np.int64 if len(set(code)) * span < 2**63 else object) * span + at
        first, end = np.searchsorted(place, place[due] - self.every, "left"), np.searchsorted(place, place[due], "right")  # a row counts with all others of its own time
        sums = np.concatenate([[0], np.cumsum(past["amount"].to_numpy(np.int64))])
        told = pd.DataFrame({"key": past["key"][due], "id": past["id"][due], "in_window": end - first, "amount_in_window": sums[end] - sums[first]})
        recent = past[past["micros"] >= until - self.every].assign(told=True)
        self._keep(pd.concat([recent, rows[rows["micros"] >= until]]))
        yield told


def rolling_stream(requests: DataFrame, seconds: float = 60, delay: str = "1 minute") -> DataFrame:
    """requests(key, id, ts, amount) of a stream with the requests and amounts of the seconds that end at each.

    State holds a key's last seconds and what the watermark has not passed; requests later than the
    delay are left out by the watermark, as everywhere. A null amount is 0, and a null ts never counts.
    """
    _timers(requests)
    rows = requests.select(F.col("key").cast("string").alias("key"), F.col("id").cast("long").alias("id"), F.col("ts").cast("timestamp").alias("ts"), F.coalesce(F.col("amount").cast("long"), F.lit(0)).alias("amount"))
    timed = rows.where("ts is not null").withColumn("micros", F.unix_micros("ts")).withWatermark("ts", delay)
    grouped = timed.withColumn("group", F.pmod(F.xxhash64("key"), F.lit(GROUPS))).groupBy("group")
    return grouped.transformWithStateInPandas(_Rolling(seconds), _USE, "Append", "EventTime")
