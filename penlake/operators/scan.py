"""Steps that depend on the row before: folds over ordered rows, and dense numbers."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

Step = Callable[[Any, tuple], tuple[Any, Sequence[tuple]]]


def ordered_scan(rows: DataFrame, keys: list[str], order: list[str], columns: list[str], start: Callable[[], Any], step: Step, schema: str) -> DataFrame:
    """Fold the rows of each key in order: step(state, values of columns) gives the next state and rows of schema, which follow the keys.

    Rows are sorted by Spark and streamed: a task holds a batch and one state, however many rows a key has, and the work
    is linear in them. A key is one sequence, so its rows are seen by one task.
    """
    out_type = StructType([*(rows.schema[k] for k in keys), *StructType.fromDDL(schema)])
    arrow, n = to_arrow_schema(out_type), len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: tuple | None = None
        state: Any = None
        for b in batches:
            out: list[tuple] = []
            for row in zip(*(c.to_pylist() for c in b.columns)):
                key = row[:n]
                if key != now:
                    now, state = key, start()
                state, given = step(state, row[n:])
                out.extend((*key, *g) for g in given)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), arrow.types)], schema=arrow)

    slim = rows.select(*keys, *columns, *(F.col(o).alias(f"__{i}") for i, o in enumerate(order)))
    by_key = slim.repartition(*keys).sortWithinPartitions(*keys, *(f"__{i}" for i in range(len(order)))).select(*keys, *columns)
    return by_key.mapInArrow(run, out_type)


def range_of(value: Column, cuts: list[float]) -> Column:
    """How many of the sorted cuts are at most the value: a look at every so many of them, then at those between."""
    if not cuts:
        return F.lit(0)
    m = math.isqrt(len(cuts) - 1) + 1
    chunks = [cuts[i : i + m] for i in range(0, len(cuts), m)]
    below = lambda some: F.size(F.filter(some, lambda c: c <= value))
    chunk = below(F.array(*(F.lit(c[0]) for c in chunks)))
    return F.when(chunk > 0, (chunk - 1) * m + below(F.get(F.array(*(F.array(*map(F.lit, c)) for c in chunks)), chunk - 1))).otherwise(0)


def dense_index(rows: DataFrame, key: str, name: str = "ix", by: Sequence[str] = (), ranges: int | None = None) -> DataFrame:
    """rows with a number from 0, without gaps, in the order of a numeric key, which is unique and not null; for each group of ``by``, of which there are few.

    Quantiles cut the rows into ranges (as many as a shuffle has partitions), so no task orders all of them; what is
    broadcast is a number for each range.
    """
    n = ranges or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts = sorted(set(rows.stat.approxQuantile(key, [i / n for i in range(1, n)], 0.2 / n))) if n > 1 else []
    rows = rows.withColumn("__range", range_of(F.col(key), cuts))
    before = F.sum("n").over(Window.partitionBy(*(by or [F.lit(0)])).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1))
    sizes = rows.groupBy(*by, "__range").agg(F.count(F.lit(1)).alias("n"))
    starts = sizes.select(*by, "__range", F.coalesce(before, F.lit(0)).alias("__start"))
    place = F.row_number().over(Window.partitionBy(*by, "__range").orderBy(key)) - 1
    return rows.withColumn("__place", place).join(F.broadcast(starts), [*by, "__range"]).withColumn(name, F.col("__start") + F.col("__place")).drop("__range", "__place", "__start")
