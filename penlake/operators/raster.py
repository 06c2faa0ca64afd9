"""Steps over the points of an item: the greedy walk, sequential by nature, in NumPy; smoothing as windows."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def order_points(xy: np.ndarray) -> np.ndarray:
    """Greedy walk over pixels: the first pixel in (x, y) order that touches the last one, else the first left."""
    left = sorted(map(tuple, xy.tolist()))
    grid = set(left)
    out, at = [], 0
    while grid:
        if out:
            x, y = out[-1]
            near = next((p for p in ((x + i, y + j) for i in (-1, 0, 1) for j in (-1, 0, 1)) if p in grid), None)
        else:
            near = None
        if near is None:
            while left[at] not in grid:
                at += 1
            near = left[at]
        grid.discard(near)
        out.append(near)
    return np.array(out, dtype=float).reshape(-1, 2)


def walk(points: DataFrame) -> DataFrame:
    """Rows (item_id, x, y: whole numbers) with pos by the greedy walk. An item is one crop."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        xy = order_points(pdf[["x", "y"]].drop_duplicates().to_numpy())
        return pd.DataFrame({"item_id": pdf["item_id"].iloc[0], "pos": np.arange(1, len(xy) + 1), "x": xy[:, 0], "y": xy[:, 1]})

    return points.groupBy("item_id").applyInPandas(one, "item_id long, pos long, x double, y double")


def smooth(points: DataFrame, window: int = 4, order: int = 2) -> DataFrame:
    """Least-squares smoothing of x and y within each run of one pen state that is longer than the window.

    A point takes the value at the middle of its window (between two points if the window is even), the points at either
    end of a run the values of the polynomial of the first or last window. All are fixed weights on neighbours.
    """
    powers = np.arange(order + 1)
    solve = np.linalg.pinv(np.vander(np.arange(window, dtype=float), order + 1, increasing=True))
    state, run, whole = Window.partitionBy("item_id").orderBy("pos"), Window.partitionBy("item_id", "run").orderBy("pos"), Window.partitionBy("item_id", "run")
    turn = F.coalesce((F.col("pen") != F.lag("pen").over(state)).cast("int"), F.lit(0))
    p = points.select("item_id", "pos", "x", "y", "pen", turn.alias("turn")).withColumn("run", F.sum("turn").over(state))
    p = p.withColumn("r", F.row_number().over(run)).withColumn("n", F.count("*").over(whole))

    def value(c: str, first: int, at: float) -> Column:
        """The value at a place of the window whose first point lies so far from this one."""
        weights = (at**powers) @ solve
        return sum((F.lag(c, -(first + j)).over(run) * float(w) for j, w in enumerate(weights)), F.lit(0.0))

    def fitted(c: str) -> Column:
        out = F.when(F.col("n") <= window, F.col(c))
        for i in range(window // 2):
            out = out.when(F.col("r") == i + 1, value(c, -i, i)).when(F.col("r") == F.col("n") - i, value(c, i + 1 - window, window - 1 - i))
        return out.otherwise(value(c, -((window - 1) // 2), (window - 1) / 2))

    return p.select("item_id", "pos", fitted("x").alias("x"), fitted("y").alias("y"), "pen")
