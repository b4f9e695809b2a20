"""Folds over a key's rows in order, one row at a time, so that a key of any size needs no more than its state."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType
from pyspark.sql.pandas.types import to_arrow_schema


def fold_sorted(rows: DataFrame, keys: Sequence[str], order: Sequence[str], start: Callable, step: Callable, kind: str) -> DataFrame:
    """What step says of each row of a key in order: step(state, row) gives the next state and a row of kind.

    Rows are partitioned by keys and sorted within tasks; a state begins with start() and is dropped with its key. Rows come as tuples of
    the columns in their order. Null keys are a key.
    """
    names, schema = rows.columns, to_arrow_schema(StructType.fromDDL(kind))
    at = [names.index(k) for k in keys]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state, first = None, None, True
        for batch in batches:
            out = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                key = tuple(row[k] for k in at)
                if first or key != last:
                    last, state, first = key, start(), False
                state, told = step(state, row)
                out.append(told)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)

    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(work, kind)
