"""What the corpus operators share: table access, scratch tables, word splitting and hashing."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from penlake.sources.scratch import materialise, scratch_dir  # noqa: F401  (the operators take them from here)

#: Odd 64-bit constants for multiplicative hashing (fixed values).
MIX = np.uint64(0x9E3779B97F4A7C15)
MIX2 = np.uint64(0xC2B2AE3D27D4EB4F)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_enough(df: DataFrame, rows: int) -> bool:
    """True if df has at most so many rows; reads no more than that."""
    return df.limit(rows + 1).count() <= rows


def join_checked(left: DataFrame, right: DataFrame, on: str | list[str], how: str, rows: int = 100_000) -> DataFrame:
    """Join, with right broadcast only if a count shows that it has at most ``rows`` rows; else a shuffled join."""
    return left.join(F.broadcast(right) if small_enough(right, rows) else right.hint("merge"), on, how)


def hot_keys(df: DataFrame, on: str, rows: int | None = None, share: int = 1000) -> list:
    """The keys that hold more than a ``share``-th of the rows of df, of which there are fewer than ``share``. rows: their number, where it's known."""
    rows = df.count() if rows is None else rows
    counts = df.where(F.col(on).isNotNull()).groupBy(on).agg(F.count(F.lit(1)).alias("rows"))
    return [r[0] for r in counts.where(F.col("rows") * share > rows).select(on).collect()]


def join_unique(left: DataFrame, right: DataFrame, on: str, how: str = "inner", hot: list | None = None) -> DataFrame:
    """Join with right, which has at most one row per key, so that no task receives a hot key of left (a written table).

    The rows of hot keys meet the few rows of right that they need by broadcast, the others by a shuffle; rows without a
    key meet nothing. hot: hot_keys(left, on), where it's known. how: inner or left.
    """
    hot, key = hot_keys(left, on) if hot is None else hot, F.col(on)
    parts = [left.where(key.isNotNull() & ~key.isin(hot) if hot else key.isNotNull()).join(right, on, how)]
    if hot:
        parts.append(left.where(key.isin(hot)).join(F.broadcast(right.where(key.isin(hot))), on, how))
    if how == "left":
        rest = [F.lit(None).cast(f.dataType).alias(f.name) for f in right.schema if f.name != on]
        parts.append(left.where(key.isNull()).select(on, *(c for c in left.columns if c != on), *rest))
    return reduce(DataFrame.unionByName, parts)


@contextmanager
def splitting_skew(spark: SparkSession) -> Iterator[None]:
    """Within, adaptive execution splits skewed keys of joins even where an aggregation follows, at the price of a shuffle."""
    name = "spark.sql.adaptive.forceOptimizeSkewedJoin"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def map_batches(df: DataFrame, f: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """mapInArrow with a function of one batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows and (out := f(b)) is not None:
                yield out

    return df.mapInArrow(run, schema)


def sorted_groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Split a partition that is sorted by key (no nulls) into tables that never break a group of equal keys."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        keys = b.column(b.schema.get_field_index(key))
        last = keys[-1]
        if held and held[-1].column(held[-1].schema.get_field_index(key))[-1] == last and keys[0] == last:
            held.append(b)
            continue
        values = keys.to_numpy(zero_copy_only=False)
        cut = int(np.flatnonzero(values != values[-1])[-1]) + 1 if (values != values[-1]).any() else 0
        yield_now = [*held, b.slice(0, cut)] if cut else held
        if yield_now:
            yield pa.Table.from_batches(yield_now)
        held = [b.slice(cut)]
    if held:
        yield pa.Table.from_batches(held)


class WordHashes(dict):
    """64-bit hashes of words, remembered up to a bound so that memory stays flat."""

    def __init__(self, most: int = 400_000):
        import xxhash

        super().__init__()
        self.most, self.hash = most, xxhash.xxh3_64_intdigest

    def __missing__(self, word: bytes) -> int:
        h = self[word] = self.hash(word)
        return h

    def __call__(self, words: list[bytes]) -> np.ndarray:
        if len(self) > self.most:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def rolled(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n values, by an order-sensitive fold that is mixed after each step."""
    if len(h) < n:
        return h[:0]
    out = h[: len(h) - n + 1].copy()
    for i in range(1, n):
        out ^= out >> np.uint64(29)
        out *= MIX
        out += h[i : len(h) - n + 1 + i]
    return mixed(out)


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = (h ^ (h >> np.uint64(31))) * MIX2
    h = (h ^ (h >> np.uint64(29))) * MIX
    return h ^ (h >> np.uint64(32))


def texts_of(b: pa.RecordBatch, name: str = "text") -> list[str]:
    """A column of strings; null counts as empty."""
    return [t or "" for t in b.column(b.schema.get_field_index(name)).to_pylist()]


def column(b: pa.RecordBatch, name: str) -> pa.Array:
    return b.column(b.schema.get_field_index(name))
