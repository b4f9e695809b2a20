"""Leased jobs as folds over their events, in batch and as a stream (ST1 to ST10, ST12, ST27, A10).

A job's events are request, claim, store, complete, retry, release and fail, each with a time, and all but the
first with the claim's token. Both forms use one step, so a replay in batch says what the stream said.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ordered import fold_sorted

LEASE = 15 * 60
KIND = "job string, seq long, outcome string, status string, attempts long, stored long"
_STATE = "status string, attempts long, token string, updated double, ready double, stored long, generation string"
_EMPTY = ("none", 0, None, 0.0, 0.0, 0, None)


@dataclass(frozen=True)
class Rules:
    """How often a job may be claimed, how long a claim lasts, how long a retry waits (seconds), and how much there is to store."""

    attempts: int = 3
    lease: float = LEASE
    delay: float = 60.0


def step(rules: Rules, state: tuple, event: tuple) -> tuple[tuple, str]:
    """The next state of a job and what became of an event (seq, ts, action, token, generation, n)."""
    status, attempts, token, updated, ready, stored, generation = state
    _, ts, action, given, gen, n = event
    stale = status == "running" and updated < ts - rules.lease
    if action == "request":
        if status in ("queued", "running") and gen == generation and not stale:
            return state, "unchanged"
        if status == "complete" and gen == generation:
            return state, "unchanged"
        return ("queued", 0, None, ts, ts, 0, gen), "requested"
    if action == "claim":
        if stale and attempts >= rules.attempts:
            return ("failed", attempts, None, ts, ready, stored, generation), "expired"
        eligible = stale or (status == "queued" and ready <= ts and attempts < rules.attempts)
        return (("running", attempts + 1, given, ts, ready, stored, generation), "claimed") if eligible else (state, "not_eligible")
    if status != "running" or token is None or given != token:
        return state, "lost"
    if action in ("store", "complete") and gen != generation:
        return state, "lost"
    if action == "store":
        return (status, attempts, token, ts, ready, stored + (n or 0), generation), "stored"
    if action == "complete":
        if stored != (n or 0):
            return state, "incomplete"
        return ("complete", attempts, None, ts, ready, stored, generation), "completed"
    if action == "release":
        return ("queued", attempts - 1, None, ts, ts, stored, generation), "released"
    if action == "retry" and attempts < rules.attempts:
        return ("queued", attempts, None, ts, ts + rules.delay, stored, generation), "retried"
    return ("failed", attempts, None, ts, ready, stored, generation), "failed"


def _events(events: DataFrame) -> DataFrame:
    return events.select(F.col("job").cast("string").alias("job"), F.col("seq").cast("long").alias("seq"), F.col("ts").cast("double").alias("ts"), "action", "token", "generation", F.col("n").cast("long").alias("n"))


def replay(events: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """What became of each of events(job, seq, ts, action, token, generation, n), and the job's state after it."""

    def told(state: tuple, row: tuple) -> tuple[tuple, tuple]:
        state, outcome = step(rules, state, row[1:])
        return state, (row[0], row[1], outcome, state[0], state[1], state[5])

    return fold_sorted(_events(events), ["job"], ["seq"], lambda: _EMPTY, told, KIND)


def stream(events: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """The same of a streaming DataFrame: state by job, kept by Spark's state store.

    Events of a batch are taken in order of seq; one that comes in a later batch than it should is applied when it comes. Where late
    events must change nothing, or leases must end by themselves, leases.lease_stream does so.
    """

    def update(key: tuple, frames: Iterator[pd.DataFrame], held) -> Iterator[pd.DataFrame]:
        state = tuple(held.get) if held.exists else _EMPTY
        out = []
        rows = pd.concat(list(frames)).sort_values("seq")
        for row in rows[["seq", "ts", "action", "token", "generation", "n"]].itertuples(index=False):
            event = tuple(None if pd.isna(x) else x for x in row)
            state, outcome = step(rules, state, event)
            out.append((key[0], int(event[0]), outcome, state[0], int(state[1]), int(state[5])))
        held.update((state[0], int(state[1]), state[2], float(state[3]), float(state[4]), int(state[5]), state[6]))
        yield pd.DataFrame(out, columns=["job", "seq", "outcome", "status", "attempts", "stored"])

    return _events(events).groupBy("job").applyInPandasWithState(update, KIND, _STATE, "append", "NoTimeout")


def claimable(jobs: DataFrame, now: Column, attempts: int = 3, lease: int = LEASE) -> DataFrame:
    """ST1, ST3, ST8, K2: jobs(queue, job, status, attempts, updated, created, ready) with verdict (expire, pick, wait) and the order of picking within a queue."""
    stale = (F.col("status") == "running") & (F.col("updated") < now - F.expr(f"interval {lease} seconds"))
    queued = (F.col("status") == "queued") & (F.col("ready") <= now)
    verdict = F.when(stale & (F.col("attempts") >= attempts), "expire").when((stale | queued) & (F.col("attempts") < attempts), "pick").otherwise("wait")
    told = jobs.withColumn("verdict", verdict)
    place = F.row_number().over(Window.partitionBy("queue", "verdict").orderBy("created", "job"))
    return told.withColumn("place", F.when(F.col("verdict") == "pick", place))


def failure(code: Column, attempts: Column, most: int = 3) -> Column:
    """ST27: retry or fail by kind of failure and attempts made."""
    # Failures that another attempt may mend.
    passing = ["timeout", "network", "rate_limited", "server_error", "busy"]
    return F.when(code.isin(*passing) & (attempts < most), "retry").otherwise("fail")


def complete_extractions(expected: DataFrame, stored: DataFrame, key: str, item: str) -> DataFrame:
    """ST5, ST9, X3: whether each key's expected items are all stored, and nothing else."""
    e = expected.select(key, item).distinct().withColumn("expected", F.lit(1))
    s = stored.select(key, item).distinct().withColumn("stored", F.lit(1))
    both = e.join(s, [key, item], "full")
    return both.groupBy(key).agg(F.count("expected").alias("expected"), F.count("stored").alias("stored"), F.count_if(F.col("expected").isNull()).alias("unknown")).withColumn("complete", (F.col("stored") == F.col("expected")) & (F.col("unknown") == 0))


def reservations(events: DataFrame, now: Column, minutes: int = 15) -> DataFrame:
    """ST12: each reservation(owner, reservation, ts, action, bytes) as live, consumed, released or expired at a time; what comes after its expiry changes nothing."""
    a = events.groupBy("owner", "reservation").agg(F.min(F.when(F.col("action") == "reserve", F.col("ts"))).alias("since"), F.max(F.when(F.col("action") == "reserve", F.col("bytes"))).alias("bytes"), F.min(F.when(F.col("action") != "reserve", F.struct("ts", "action"))).alias("end"))
    limit = F.col("since") + F.expr(f"interval {minutes} minutes")
    ended = (F.col("end.ts") >= F.col("since")) & (F.col("end.ts") < limit)
    state = F.when(ended & (F.col("end.action") == "consume"), "consumed").when(ended, "released").when(now >= limit, "expired").otherwise("live")
    return a.where("since is not null").select("owner", "reservation", "bytes", state.alias("state"))


def admission(used: DataFrame, reserved: DataFrame, asked: DataFrame, capacity: int, largest: int) -> DataFrame:
    """A10: whether each asked(owner, bytes) fits beside what is used(owner, bytes) and the live of reserved(owner, bytes, state).

    A file above the largest one is refused before anything is counted, as if all were free; a size that is null or not above 0 is
    refused as invalid. Each request is judged on its own, and remaining is what would be left after it.
    """
    u = used.groupBy("owner").agg(F.sum("bytes").alias("in_use"))
    r = reserved.where("state = 'live'").groupBy("owner").agg(F.sum("bytes").alias("held"))
    rows = asked.join(u, "owner", "left").join(r, "owner", "left").na.fill(0, ["in_use", "held"])
    n, taken = F.col("bytes"), F.col("in_use") + F.col("held")
    valid, small = F.coalesce(n > 0, F.lit(False)), n <= largest
    fits = valid & small & (taken + n <= capacity)
    left = F.when(valid & ~small, capacity).when(fits, capacity - taken - n).when(valid, F.greatest(capacity - taken, F.lit(0)))
    reason = F.when(~valid, "invalid_file_size").when(~small, "file_too_large").when(~fits, "over_capacity")
    return rows.select("owner", "bytes", F.when(valid & ~small, 0).otherwise(taken).alias("used"), F.lit(capacity).cast("long").alias("capacity"), left.cast("long").alias("remaining"), F.coalesce(fits, F.lit(False)).alias("admitted"), reason.alias("reason"))
