"""Activity from a feed of changes (ST20): appended change rows become activity, each once, however often or late they come."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .sink import TableSet

# What a change of the links says.
KINDS = {"insert": "paper_linked", "delete": "paper_unlinked"}
_ACTIVITY = "change_id string, ts timestamp_ntz, kind string, project long, paper long"


def activity_store(spark: SparkSession, root: str) -> TableSet:
    """Where activity is kept, by the change that made it."""
    return TableSet(spark, root, "change_id", {"activity": _ACTIVITY})


def activity(changes: DataFrame) -> DataFrame:
    """changes(change_id, ts, op, project, paper) of links as activity; other changes, and those without an id, make none."""
    kind = F.coalesce(*[F.when(F.col("op") == op, said) for op, said in KINDS.items()])
    return changes.select(F.col("change_id").cast("string").alias("change_id"), "ts", kind.alias("kind"), F.col("project").cast("long").alias("project"), F.col("paper").cast("long").alias("paper")).where("kind is not null and change_id is not null")


def activity_feed(changes: DataFrame, store: TableSet, checkpoint: str) -> StreamingQuery:
    """Writes a stream of changes as activity until it has read all there is.

    A change that stands in the store already makes none, however late its repeat comes and whichever
    checkpoint reads it, so a watermark, which would drop late changes, has no part in it. A batch that
    is cut short leaves nothing that counts. One feed writes to a store at a time.
    """

    def take(rows: DataFrame, batch: int) -> None:
        store.insert(store.next_batch(), "activity", rows, "ts")

    return activity(changes).writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
