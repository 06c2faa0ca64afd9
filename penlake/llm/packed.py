"""Shuffling many small facts as few packed rows.

A task that has made arrays of facts sorts them by bucket and gives out one row per bucket, with the arrays as
compressed bytes; what Spark shuffles are those rows. The receiving task takes the rows of one bucket after the
other, so its memory is that of one bucket. The number of buckets follows the size of the input.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from penlake.llm.common import sorted_groups

ROW = "bucket int, kind int, id long, meta binary, data binary"
ROW_ARROW = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("id", pa.int64()), ("meta", pa.binary()), ("data", pa.binary())])


@cache
def codec():
    """This process's compressor and decompressor."""
    import zstandard

    return zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def squeeze(data: bytes) -> bytes:
    return codec()[0].compress(data)


def unsqueeze(data: bytes) -> bytes:
    return codec()[1].decompress(data)


def freeze(*arrays: np.ndarray) -> bytes:
    """Arrays of one length as bytes; byte planes and differences of all but the first, as neighbours are alike."""
    n = len(arrays[0])
    planes = [np.ascontiguousarray(a).view(np.uint8).reshape(n, a.itemsize).T.tobytes() for a in (arrays[0], *(np.diff(a, prepend=a.dtype.type(0)) for a in arrays[1:]))]
    return n.to_bytes(4, "little") + squeeze(b"".join(planes))


def thaw(blob: bytes, *dtypes: type) -> list[np.ndarray]:
    n, raw, out, at = int.from_bytes(blob[:4], "little"), unsqueeze(blob[4:]), [], 0
    for i, t in enumerate(dtypes):
        size = np.dtype(t).itemsize
        a = np.ascontiguousarray(np.frombuffer(raw, np.uint8, n * size, at).reshape(size, n).T).view(t).reshape(n)
        out.append(np.cumsum(a, dtype=t) if i else a)
        at += n * size
    return out


def parcels(kind: int, bucket: np.ndarray, *arrays: np.ndarray, wide: np.ndarray | None = None) -> list[tuple]:
    """One row per bucket for facts of one kind. wide: a matrix with a row for each fact, given out as it is."""
    if not len(bucket):
        return []
    order = np.argsort(bucket, kind="stable")
    b = bucket[order]
    cuts = np.flatnonzero(np.diff(b, prepend=-1))
    sorted_arrays = [a[order] for a in arrays]
    data = wide[order] if wide is not None else None
    return [(int(b[i]), kind, None, freeze(*(a[i:j] for a in sorted_arrays)), data[i:j].tobytes() if data is not None else None) for i, j in zip(cuts, [*cuts[1:], len(b)])]


def batch_of(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), ROW_ARROW.types)], schema=ROW_ARROW)


def by_bucket(rows: DataFrame, f: Callable[[int, dict[int, list[tuple]]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """Bring the rows of each bucket together and apply f(bucket, {kind: [(id, meta, data)]})."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple]] = {}
        now = None
        for t in sorted_groups(batches, "bucket"):
            for bucket, kind, *rest in zip(*(c.to_pylist() for c in t.columns)):
                if bucket != now:
                    if held:
                        yield from f(now, held)
                    held, now = {}, bucket
                held.setdefault(kind, []).append(tuple(rest))
        if held:
            yield from f(now, held)

    return rows.repartition(n, "bucket").sortWithinPartitions("bucket", "kind").mapInArrow(run, schema)


def joined_up(parts: list[tuple], *dtypes: type) -> list[np.ndarray]:
    """The arrays of all parcels of one kind."""
    if not parts:
        return [np.zeros(0, t) for t in dtypes]
    return [np.concatenate(x) for x in zip(*(thaw(meta, *dtypes) for _, meta, _ in parts))]
