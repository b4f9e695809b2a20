"""Tables that change together, one batch at a time (SNK1 to SNK4).

A batch writes the new rows of every table to folders of its own, then the keys that it stands for,
then one row that says it is done. Only the last makes it count: whoever reads before sees the batch
before, and a batch that was cut short is written over when it runs again. What stands for a key are
the rows of the latest batch that is done and names it, so all tables of a key change at once, and a
key that has no rows any more is told by its name alone. Nothing is changed in place; compacted()
writes what stands to a fresh folder.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.relational import newest


class TableSet:
    """Tables under a folder that executors share; schemas by name, each with the key column."""

    def __init__(self, spark: SparkSession, root: str, key: str, schemas: Mapping[str, str]):
        self.spark, self.root, self.key = spark, root.rstrip("/"), key
        self.schemas = {name: T.StructType.fromDDL(ddl) for name, ddl in schemas.items()}
        kinds = {s[key].dataType.simpleString() for s in self.schemas.values()}
        if len(kinds) != 1:
            raise ValueError(f"{key} has one type in all tables, not {sorted(kinds)}")
        key_schema = T.StructType([T.StructField(key, next(iter(self.schemas.values()))[key].dataType)])
        self._kinds = {**{f"data/{n}": s for n, s in self.schemas.items()}, "keys": key_schema, "done": T.StructType.fromDDL("keys long")}
        for part, schema in self._kinds.items():  # a reader finds a folder, however little was written
            spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{self.root}/{part}/batch=-1")

    def _part(self, part: str) -> DataFrame:
        schema = T.StructType([*self._kinds[part].fields, T.StructField("batch", T.LongType())])
        return self.spark.read.schema(schema).parquet(f"{self.root}/{part}")

    def _put(self, part: str, batch: int, rows: DataFrame) -> None:
        columns = [F.col(f.name).cast(f.dataType).alias(f.name) for f in self._kinds[part]]
        rows.select(*columns).write.mode("overwrite").parquet(f"{self.root}/{part}/batch={batch}")

    def done(self, batch: int) -> bool:
        return bool(self._part("done").where(F.col("batch") == batch).head(1))

    def next_batch(self) -> int:
        """The number after the last batch that is done."""
        last = self._part("done").agg(F.max("batch")).first()[0]
        return 0 if last is None else last + 1

    def write(self, batch: int, tables: Mapping[str, DataFrame], keys: DataFrame | None = None) -> bool:
        """SNK1: in all tables the rows of keys become those given; whether it wrote, as a batch that is done is never written again.

        Without keys, those of the rows given. Rows of other keys and null keys are no part of the batch;
        a table that is not given loses the keys' rows.
        """
        if self.done(batch):
            return False
        named = lambda: self._part("keys").where(F.col("batch") == batch).drop("batch")
        if keys is not None:
            self._put("keys", batch, keys.select(self.key).where(F.col(self.key).isNotNull()).distinct())
        for name, schema in self.schemas.items():  # a table that is not given may hold rows of a batch that was cut short
            rows = self.spark.createDataFrame([], schema) if name not in tables else tables[name].where(F.col(self.key).isNotNull()) if keys is None else tables[name].join(named(), self.key, "left_semi")
            self._put(f"data/{name}", batch, rows)
        if keys is None:  # all rows are of the batch, and what was written tells its keys
            of = [self._part(f"data/{name}").where(F.col("batch") == batch).select(self.key).distinct() for name in tables]
            self._put("keys", batch, reduce(DataFrame.union, of).distinct())
        self._put("done", batch, named().agg(F.count("*").alias("keys")).coalesce(1))
        return True

    def latest(self) -> DataFrame:
        """The key with the batch that stands for it."""
        done = self._part("done").select("batch").distinct()
        return self._part("keys").join(done, "batch", "left_semi").groupBy(self.key).agg(F.max("batch").alias("batch"))

    def read(self, name: str) -> DataFrame:
        """What stands in a table."""
        return self._part(f"data/{name}").join(self.latest(), [self.key, "batch"], "left_semi").select(*self.schemas[name].names)

    def insert(self, batch: int, name: str, rows: DataFrame, order: str) -> bool:
        """SNK2, SNK4: rows of keys that the table lacks, the least in order of each; the others change nothing."""
        if self.done(batch):
            return False
        fresh = rows.join(self.latest().select(self.key), self.key, "left_anti")
        first = fresh.groupBy(self.key).agg(F.min(F.struct(F.col(order).alias("insert_order"), *[c for c in rows.columns if c != self.key])).alias("first"))
        return self.write(batch, {name: first.select(self.key, *[F.col(f"first.{c}").alias(c) for c in rows.columns if c != self.key])})

    def upsert(self, batch: int, name: str, rows: DataFrame, updated: str) -> bool:
        """SNK3: the newest row of each key, ties to the least content, in the place of what stands."""
        others = [c for c in rows.columns if c != self.key]
        return self.write(batch, {name: newest(rows, [self.key], updated, F.to_json(F.struct(*others)))})

    def sink(self, split: Callable[[DataFrame], tuple[Mapping[str, DataFrame], DataFrame | None]]) -> Callable[[DataFrame, int], None]:
        """For writeStream.foreachBatch: split turns a batch into rows by table and the keys that they stand for."""

        def take(rows: DataFrame, batch: int) -> None:
            self.write(batch, *split(rows))

        return take

    def compacted(self, root: str) -> TableSet:
        """What stands now as one batch of a fresh folder."""
        fresh = TableSet(self.spark, root, self.key, {n: ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in s) for n, s in self.schemas.items()})
        last = self._part("done").agg(F.max("batch")).first()[0]
        if last is not None:
            fresh.write(last, {n: self.read(n) for n in self.schemas}, self.latest())
        return fresh


def fenced(rows: DataFrame, claims: DataFrame, key: str, token: str) -> DataFrame:
    """SNK1: rows(key, token, ...) whose key is still processing under the token they were made with; the others lost their claim and write nothing."""
    live = claims.where("status = 'processing'").select(F.col(key), F.col(token)).distinct()
    return rows.join(live, [key, token], "left_semi")

