"""Queries of sinks and streams: what they write is read back and compared with SQL over the tables it came from."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..session import shared_dir
from ..sources import intake as I
from ..streaming.feed import activity_feed, activity_store
from ..streaming.jobs import Rules
from ..streaming.leases import lease_stream, rolling_stream
from ..streaming.sink import TableSet
from .registry import query, table

_DERIVED = {"sections": "l_quantity", "chunks": "l_extendedprice", "pages": "l_discount", "tables": "l_tax", "facts": "l_partkey"}
_SET = {n: "paper bigint, n int, v double" for n in _DERIVED}


def _parts(name: str) -> str:
    return f"{name}-{uuid.uuid4().hex}"


@query("snk1_written", "with d as (select l_orderkey as paper, l_linenumber as n, l_quantity as sections, l_extendedprice as chunks, l_discount as pages, l_tax as tables, cast(l_partkey as double) as facts from lineitem), u as (unpivot d on sections, chunks, pages, tables, facts into name kind value v) select kind, paper, n, v from u where paper % 3 = 0 or (paper % 3 = 1 and n > 1) union all select kind, paper, n + 100, -v from u where paper % 3 = 1 and n = 1")
def snk1_written(spark, sf_dir):
    """Three batches: every paper's rows, a third of the papers again with other ones, and another third that loses all of its own."""
    store = TableSet(spark, f"{shared_dir(spark)}/{_parts('derived')}", "paper", _SET)
    lines = table(spark, sf_dir, "lineitem")
    made = {n: lines.select(F.col("l_orderkey").alias("paper"), F.col("l_linenumber").alias("n"), F.col(c).cast("double").alias("v")) for n, c in _DERIVED.items()}
    again = {n: rows.where("paper % 3 = 1").select("paper", F.when(F.col("n") == 1, 101).otherwise(F.col("n")).alias("n"), F.when(F.col("n") == 1, -F.col("v")).otherwise(F.col("v")).alias("v")) for n, rows in made.items()}
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("paper"))
    store.write(0, made)
    store.write(1, again, orders.where("paper % 3 = 1"))
    store.write(2, {}, orders.where("paper % 3 = 2"))
    out = None
    for n in _DERIVED:
        rows = store.read(n).select(F.lit(n).alias("kind"), "paper", "n", "v")
        out = rows if out is None else out.unionByName(rows)
    return out


@query("snk2_written", "select user_id || ':' || cast(floor(value) as bigint) as k, arg_min(event_id, (event_id % 3, event_id)) as event_id from events group by 1")
def snk2_written(spark, sf_dir):
    """Usage events in three batches, of which the second comes twice; a key that stands is not written again."""
    store = TableSet(spark, f"{shared_dir(spark)}/{_parts('usage')}", "k", {"usage": "k string, event_id bigint"})
    rows = table(spark, sf_dir, "events").select(F.concat(F.col("user_id").cast("string"), F.lit(":"), F.floor("value").cast("string")).alias("k"), "event_id")
    for batch, part in enumerate([0, 1, 1, 2]):
        store.insert(batch, "usage", rows.where(F.col("event_id") % 3 == part), "event_id")
    return store.read("usage")


@query("snk3_written", "select o_custkey as k, o_orderkey as v from orders qualify row_number() over (partition by o_custkey order by o_orderkey % 2 desc, o_orderdate desc nulls last, cast(o_orderkey as varchar) || ',') = 1")
def snk3_written(spark, sf_dir):
    """A customer's newest order of two batches, the later batch in the place of the first."""
    store = TableSet(spark, f"{shared_dir(spark)}/{_parts('newest')}", "k", {"newest": "k bigint, v bigint, at timestamp_ntz"})
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("v"), F.coalesce(F.col("o_orderdate"), F.lit("1900-01-01").cast("timestamp_ntz")).alias("at"))
    for batch in (0, 1):
        store.upsert(batch, "newest", rows.where(F.col("v") % 2 == batch), "at")
    return store.read("newest").select("k", "v")


def fed(spark: SparkSession, parts: list[DataFrame], name: str, start: Callable[[DataFrame], StreamingQuery]) -> None:
    """Feeds a stream the given parts in order: each is written by all tasks and is one batch, however many files it has.

    start begins a query that ends once it has read what there is; its checkpoint tells the next part from those before.
    """
    path = f"{shared_dir(spark)}/{_parts(name)}"
    for k, part in enumerate(parts):
        part.write.parquet(f"{path}/{k:03d}")
        start(spark.readStream.schema(parts[0].schema).option("recursiveFileLookup", "true").parquet(path)).awaitTermination()


def finished(spark: SparkSession, parts: list[DataFrame], name: str, made: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What a stream made of the parts once it has read all of them."""
    path, schemas = f"{shared_dir(spark)}/{_parts(name)}", []

    def start(rows: DataFrame) -> StreamingQuery:
        out = made(rows)
        schemas.append(out.schema)
        return out.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/check").trigger(availableNow=True).start()

    fed(spark, parts, name, start)
    return spark.read.schema(schemas[-1]).parquet(f"{path}/out")


@query("st20_feed", "select 'c' || l_orderkey || ':' || l_linenumber as change_id, case when l_linenumber % 3 = 0 then 'paper_unlinked' else 'paper_linked' end as kind, l_orderkey as project, min(l_suppkey) as paper from lineitem where l_linenumber % 3 < 2 group by 1, 2, 3")
def st20_feed(spark, sf_dir):
    """A feed of changes that repeats half of itself and brings some late, as activity, each once."""
    n = F.col("l_linenumber")
    changes = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_suppkey").alias("paper"), F.min("l_shipdate").alias("ts"))
    rows = changes.select(F.concat(F.lit("c"), F.col("l_orderkey").cast("string"), F.lit(":"), n.cast("string")).alias("change_id"), "ts", F.when(n % 3 == 0, "delete").when(n % 3 == 1, "insert").otherwise("usage").alias("op"), F.col("l_orderkey").alias("project"), "paper")
    at = f"{shared_dir(spark)}/{_parts('activity')}"
    store = activity_store(spark, f"{at}/store")
    fed(spark, [rows.where("project % 2 = 0"), rows, rows.where("project % 3 = 0")], "changes", lambda changes: activity_feed(changes, store, f"{at}/check"))
    return store.read("activity").select("change_id", "kind", "project", "paper")


@query("w9_stream", "select event_id as id, count(*) over w as in_window, cast(sum(cast(floor(value) as bigint)) over w as bigint) as amount_in_window from events window w as (partition by user_id order by ts range between interval 86400 seconds preceding and current row)")
def w9_stream(spark, sf_dir):
    """The rolling window of w9_rolling_window from a stream that brings each day's events in disorder."""
    rows = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("key"), F.col("event_id").alias("id"), "ts", F.floor("value").cast("long").alias("amount"))
    day = F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 86_400 + F.pmod(F.xxhash64("id"), F.lit(100)) / 100)
    first, last = rows.agg(F.min(day), F.max(day)).first()
    if first is None:
        return spark.createDataFrame([], "id long, in_window long, amount_in_window long")
    step = max(1, (last - first + 6) // 6)
    parts = [rows.where((day >= k) & (day < k + step)) for k in range(first, last + 1, step)]
    ends = [spark.range(1).select(F.lit("end").alias("key"), F.lit(-1).cast("long").alias("id"), F.timestamp_seconds(F.lit((last + d) * 86_400)).cast("timestamp_ntz").alias("ts"), F.lit(0).cast("long").alias("amount")) for d in (9, 18)]
    told = finished(spark, [*parts, *ends], "requests", lambda rows: rolling_stream(rows, 86_400, "2 days"))
    return told.where("id >= 0").select("id", "in_window", "amount_in_window")


@query("st1_silent_expiry", "select cast(c_custkey as varchar) as job, case when c_custkey % 3 = 0 then 'completed' when c_custkey % 3 = 1 then 'expired' else 'not_claimed' end as outcome from customer")
def st1_silent_expiry(spark, sf_dir):
    """Jobs of which a third finishes, a third falls silent with its last attempt running and a third is never claimed."""
    k, at = F.col("c_custkey"), F.lit(1_700_000_000.0)
    actions = F.when(k % 3 == 0, F.array(*map(F.lit, ["request", "claim", "complete"]))).when(k % 3 == 1, F.array(F.lit("request"), F.lit("claim"))).otherwise(F.array(F.lit("request")))
    rows = table(spark, sf_dir, "customer").select(k.cast("string").alias("job"), F.posexplode(actions).alias("seq", "action"))
    events = rows.select("job", F.col("seq").cast("long"), (at + F.col("seq")).alias("ts"), "action", F.when(F.col("seq") > 0, "t").alias("token"), F.lit("g").alias("generation"), F.lit(0).cast("long").alias("n"))
    clock = [spark.range(1).select(F.lit("clock").alias("job"), F.lit(d).cast("long").alias("seq"), (at + 4000.0 * (d + 1)).alias("ts"), F.lit("release").alias("action"), F.lit(None).cast("string").alias("token"), F.lit("g").alias("generation"), F.lit(0).cast("long").alias("n")) for d in range(2)]
    told = finished(spark, [events, *clock], "jobs", lambda rows: lease_stream(rows, Rules(attempts=1), "1 minute")).where("job <> 'clock'")
    last = told.groupBy("job").agg(F.max(F.when(F.col("outcome").isin("completed", "expired"), F.col("outcome"))).alias("end"))
    return last.select("job", F.coalesce("end", F.lit("not_claimed")).alias("outcome"))


@query("src13_settled", "select o_orderkey as paper, o_orderstatus as generation, l_linenumber as chunk from orders join lineitem on l_orderkey = o_orderkey where not (o_orderstatus = 'P' and o_orderkey % 5 = 0)")
def src13_settled(spark, sf_dir):
    """Chunks under the generation that stood before and after they were read; some generations move once, others at every read."""
    reads = []

    def take():
        reads.append(len(reads))
        moved = F.when((F.col("o_orderstatus") == "P") & (F.col("o_orderkey") % 5 == 0), F.lit(f"at read {len(reads)}")).when((F.col("o_orderstatus") == "O") & (F.lit(len(reads)) == 1), "draft")
        return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("paper"), F.coalesce(moved, "o_orderstatus").alias("generation"))

    chunks = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("paper"), F.col("l_linenumber").alias("chunk"))
    rows, _ = I.settled_read(take, lambda keys: chunks.join(keys, "paper", "left_semi"), "paper", "generation")
    return rows.select("paper", "generation", "chunk")
