"""Pen events to strokes and records: a state machine for each pen, over tables and streams alike.

A press begins a stroke, moves lengthen it while the pen is down and far enough from the last point kept, a lift or the
pen's leaving closes it with a copy of its last point, pen up. A stroke that is begun again before it's closed is lost.
An event of another kind, or without a place, changes nothing.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from penlake.operators.scan import ordered_scan

PRESS, MOVE, ENDS = "press", "move", ("lift", "leave")
#: Kept distance in pixels (a fixed value).
INTERVAL = 2.0
POINTS = "stroke long, pos long, x double, y double, pen long"
STATE = "xs array<double>, ys array<double>, strokes long, points long"


def start() -> tuple:
    """No stroke; none done."""
    return [], [], 0, 0


def step(state: tuple, row: tuple, interval: float = INTERVAL) -> tuple[tuple, list[tuple]]:
    """The next state, and the rows of a stroke that this event closes. The last point of the open stroke is the last one kept."""
    xs, ys, strokes, points = state
    kind, x, y = row
    if kind in ENDS:
        if not xs:
            return state, []
        out = [(strokes + 1, points + 1 + i, a, b, 1) for i, (a, b) in enumerate(zip(xs, ys))]
        out.append((strokes + 1, points + 1 + len(xs), xs[-1], ys[-1], 0))
        return ([], [], strokes + 1, points + len(out)), out
    if x is None or y is None:
        return state, []
    if kind == PRESS:
        return ([x], [y], strokes, points), []
    if kind == MOVE and xs:
        dx, dy = x - xs[-1], y - ys[-1]
        if math.sqrt(dx * dx + dy * dy) >= interval:
            xs.append(x)
            ys.append(y)
    return state, []


def capture(events: DataFrame, key: str, order: list[str], interval: float = INTERVAL) -> DataFrame:
    """key, stroke, pos, x, y, pen of closed strokes. events: (key, order, kind, x, y)."""
    return ordered_scan(events, [key], order, ["kind", "x", "y"], start, partial(step, interval=interval), POINTS)


def capture_stream(events: DataFrame, key: str, order: list[str], interval: float = INTERVAL) -> DataFrame:
    """capture for a stream whose events of a pen come in order from one micro-batch to the next; within one they're sorted.

    The state of a pen is its open stroke and two counts.
    """

    def run(k: tuple, frames: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        state = tuple(list(v) if isinstance(v, (list, tuple)) else v for v in held.get) if held.exists else start()
        rows = pd.concat(frames).sort_values(order)
        out: list[tuple] = []
        for kind, x, y in zip(rows["kind"], rows["x"], rows["y"]):
            state, given = step(state, (kind, None if pd.isna(x) else x, None if pd.isna(y) else y), interval)
            out.extend((*k, *g) for g in given)
        held.update(state)
        yield pd.DataFrame(out, columns=[key, "stroke", "pos", "x", "y", "pen"])

    typed = f"{key} {events.schema[key].dataType.simpleString()}, {POINTS}"
    return events.groupBy(key).applyInPandasWithState(run, typed, STATE, "append", GroupStateTimeout.NoTimeout)


def trimmed(text: str):
    return F.regexp_replace(F.col(text), r"^\s+|\s+$", "")


def entries(points: DataFrame, forms: DataFrame, key: str, width: float, height: float) -> DataFrame:
    """Records of captured points with what a form says: key, metadata and points relative to the canvas, at 4 digits.

    forms: (key, author, ascii). Forms with a blank author or text are refused, and so are those without a stroke. A
    record holds its points, as one drawing does.
    """
    valid = forms.select(key, trimmed("author").alias("author"), trimmed("ascii").alias("ascii")).where("author <> '' and ascii <> ''")
    four = lambda v: F.floor(v * 10000 + 0.5) / 10000
    point = F.array(four(F.col("x") / width), four(F.col("y") / height), F.col("pen").cast("double"))
    drawn = points.groupBy(key).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", point.alias("p")))), lambda s: s["p"]).alias("points"),
        F.count(F.lit(1)).cast("int").alias("pointCount"),
        F.max("stroke").cast("int").alias("strokeCount"),
    )
    metadata = F.struct("author", F.col("ascii").alias("asciiSequence"), "pointCount", "strokeCount", F.lit(width / height).alias("aspectRatio"))
    return valid.join(drawn, key).select(key, metadata.alias("metadata"), "points")
