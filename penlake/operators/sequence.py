"""Order-dependent operators over point rows (item_id, pos, x, y, pen)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from penlake.functions.geometry import BASELINE, cartesian, polar
from penlake.operators.scan import ordered_scan

BY_POS = Window.partitionBy


def ordered(*keys: str) -> Window:
    return Window.partitionBy(*(keys or ("item_id",))).orderBy("pos")


def normalise(points: DataFrame, aspect: float, baseline: float | None = BASELINE) -> DataFrame:
    x = F.col("x") * aspect
    y = F.col("y") - baseline if baseline is not None else F.col("y")
    return points.withColumns({"x": x - F.first(x).over(ordered()), "y": y})


def offsets(points: DataFrame) -> DataFrame:
    """dx and dy to the point before, 0 for the first."""
    w = ordered()
    return points.withColumns({"dx": F.coalesce(F.col("x") - F.lag("x").over(w), F.lit(0.0)), "dy": F.coalesce(F.col("y") - F.lag("y").over(w), F.lit(0.0))})


def offsets_after_word(points: DataFrame, word: str = "word") -> DataFrame:
    """Offsets within a word; a word's first point is measured from the word before, past its right end."""
    w = Window.partitionBy("item_id", word).orderBy("pos")
    whole = Window.partitionBy("item_id", word)
    p = points.withColumns({"__min": F.min("x").over(whole), "__max": F.max("x").over(whole)})
    by_item = Window.partitionBy("item_id").orderBy("pos")
    before = {c: F.lag(c).over(by_item) for c in ("x", "y", "__max")}
    first = F.row_number().over(w) == 1
    dx = F.when(first, (before["__max"] - before["x"]) + (F.col("x") - F.col("__min"))).otherwise(F.col("x") - before["x"])
    return p.withColumns({"dx": F.coalesce(dx, F.lit(0.0)), "dy": F.coalesce(F.col("y") - before["y"], F.lit(0.0))}).drop("__min", "__max")


def to_polar(points: DataFrame) -> DataFrame:
    r, theta = polar(F.col("dx"), F.col("dy"))
    return points.withColumns({"r": r, "theta": theta})


def reconstruct(points: DataFrame) -> DataFrame:
    """Running sums of the offsets that (r, theta) stand for."""
    dx, dy = cartesian(F.col("r"), F.col("theta"))
    w = ordered().rowsBetween(Window.unboundedPreceding, 0)
    return points.withColumns({"x": F.sum(dx).over(w), "y": F.sum(dy).over(w)})


def strokes(points: DataFrame) -> DataFrame:
    """Runs of pen-down points, numbered from 1 in each item, with their extent; pen-up points part them."""
    up = F.sum(F.when(F.col("pen") == 1, 0).otherwise(1)).over(ordered().rowsBetween(Window.unboundedPreceding, 0))
    runs = points.withColumn("island", up).where("pen = 1").groupBy("item_id", "island")
    return runs.agg(F.min("pos").alias("first_pos"), F.count("*").alias("n_points"), *(f(c).alias(f"{f.__name__}_{c}") for c in ("x", "y") for f in (F.min, F.max)))


def pen_and(points: DataFrame) -> DataFrame:
    """Pen state as the product of up to the last four."""
    return points.withColumn("pen", F.min("pen").over(ordered().rowsBetween(-3, 0)))


def breaks(points: DataFrame, gap: Column | float) -> DataFrame:
    """stroke: a number that rises where a point is further than gap (Chebyshev) from the one before."""
    w = ordered()
    far = F.greatest(F.abs(F.col("x") - F.lag("x").over(w)), F.abs(F.col("y") - F.lag("y").over(w))) > gap
    return points.withColumn("stroke", F.sum(F.when(far, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def closed(strokes: DataFrame) -> DataFrame:
    """Points of strokes (numbered from 0 as by breaks), pen down, each stroke's last point repeated pen up; pos counts both."""
    w = ordered()
    ends = F.coalesce(F.lead("stroke").over(w) != F.col("stroke"), F.lit(True))
    p = strokes.drop("pen").withColumns({"ends": ends, "place": F.row_number().over(w) + F.col("stroke")})
    p = p.withColumn("pen", F.explode(F.when(F.col("ends"), F.array(F.lit(1), F.lit(0))).otherwise(F.array(F.lit(1)))))
    return p.select("item_id", (F.col("place") + 1 - F.col("pen")).cast("long").alias("pos"), "x", "y", F.col("pen").cast("long").alias("pen"))


def trimmed(points: DataFrame) -> DataFrame:
    """Items without their first and their last point."""
    w = ordered()
    p = points.withColumns({"before": F.lag("pos").over(w), "after": F.lead("pos").over(w)})
    return p.where("before is not null and after is not null").drop("before", "after")


def segments(points: DataFrame, mode: str) -> DataFrame:
    """Lines between neighbours that are drawn; mode: whose pen has to be down (end, start or both)."""
    w = ordered()
    p = points.withColumns({f"{c}1": F.lead(c).over(w) for c in ("x", "y", "pen")}).where("x1 is not null")
    return p.where({"end": "pen1 = 1", "start": "pen = 1", "both": "pen = 1 and pen1 = 1"}[mode]).select("item_id", "pos", "x", "y", "x1", "y1")


def downsample(points: DataFrame, fraction: float) -> DataFrame:
    """Of each stroke max(2, floor(n (1 - fraction))) evenly spaced points, first and last among them; pen-up points stay."""
    w = ordered().rowsBetween(Window.unboundedPreceding, 0)
    p = points.withColumn("island", F.sum(F.when(F.col("pen") == 1, 0).otherwise(1)).over(w))
    inside = Window.partitionBy("item_id", "island", "pen").orderBy("pos")
    p = p.withColumns({"i": F.row_number().over(inside) - 1, "n": F.count("*").over(Window.partitionBy("item_id", "island", "pen"))})
    m = F.least(F.greatest(F.floor(F.col("n") * F.lit(1 - fraction)), F.lit(2)), F.col("n"))
    return p.where((F.col("pen") != 1) | (F.col("n") <= 2) | evenly(F.col("i"), F.col("n"), m)).select("item_id", "pos", "x", "y", "pen")


def evenly(i: Column, n: Column, m: Column) -> Column:
    """True if i is among m evenly spaced indices from 0 to n - 1, each rounded down, the last being n - 1."""
    step = (n - 1) / F.nullif(m - 1, F.lit(0)).cast("double")
    # i is one of them if floor(k * step) = i for some k; only the k around i / step can be
    k = F.ceil(i / F.nullif(step, F.lit(0.0)))
    near = [(j <= m - 2) & (F.floor(j * step) == i) for j in (k - 1, k)]
    return F.when(m < 1, False).when(m == 1, i == 0).otherwise((i == n - 1) | F.coalesce(near[0] | near[1], i == 0))


def downsample_whole(points: DataFrame, fraction: float) -> DataFrame:
    """floor(n (1 - fraction)) evenly spaced points of each item, whatever the pen does; all of them at a fraction of 1."""
    if not 0 <= fraction <= 1:
        raise ValueError("fraction must lie between 0 and 1")
    if fraction == 1:
        return points
    item = Window.partitionBy("item_id")
    p = points.withColumns({"__i": F.row_number().over(item.orderBy("pos")) - 1, "__n": F.count("*").over(item)})
    return p.where(evenly(F.col("__i"), F.col("__n"), F.floor(F.col("__n") * F.lit(1 - fraction)))).drop("__i", "__n")


def metadata(points: DataFrame) -> DataFrame:
    """Counts of points and strokes (pen-up points), and width over height, of each item."""
    ratio = (F.max("x") - F.min("x")) / F.nullif(F.max("y") - F.min("y"), F.lit(0.0))
    return points.groupBy("item_id").agg(F.count("*").alias("point_count"), F.sum(F.when(F.col("pen") == 0, 1).otherwise(0)).alias("stroke_count"), F.round(ratio, 4).alias("aspect_ratio"))


def thin(points: DataFrame, least: float) -> DataFrame:
    """Points at least so far from the last one kept."""

    def step(last: tuple[float, float] | None, row: tuple) -> tuple[tuple[float, float], list[tuple]]:
        _, x, y = row
        if last is None or math.sqrt((x - last[0]) * (x - last[0]) + (y - last[1]) * (y - last[1])) >= least:
            return (x, y), [row]
        return last, []

    return ordered_scan(points, ["item_id"], ["pos"], ["pos", "x", "y"], lambda: None, step, "pos long, x double, y double")


def layout(widths: DataFrame, space: float, line: float, height: float) -> DataFrame:
    """Cursor of each word (item_id, pos, width): a word that starts beyond the line opens the next one."""

    def step(cursor: tuple[float, float], row: tuple) -> tuple[tuple[float, float], list[tuple]]:
        x, y = (0.0, cursor[1] + height) if cursor[0] > line else cursor
        return (x + row[1] + space, y), [(row[0], x, y)]

    return ordered_scan(widths.withColumn("pos", F.col("pos").cast("long")), ["item_id"], ["pos"], ["pos", "width"], lambda: (0.0, 0.0), step, "pos long, x double, y double")


def wrapped(words: DataFrame, keys: list[str], order: str, word: str, width: int = 80, gap: int = 1) -> DataFrame:
    """keys, order, word and line (from 0): words that stand behind one another, a new line begun before one that would pass the width.

    order: a whole number.
    """

    def step(state: tuple[int, int], row: tuple) -> tuple[tuple[int, int], list[tuple]]:
        at, line = state
        need = len(row[1] or "") + gap
        if at + need > width:
            at, line = 0, line + 1
        return (at + need, line), [(*row, line)]

    rows = words.select(*keys, F.col(order).cast("long").alias(order), word)
    return ordered_scan(rows, keys, [order], [order, word], lambda: (0, 0), step, f"{order} long, {word} string, line long")


def side_by_side(widths: DataFrame, space: float) -> DataFrame:
    """Start of each word when all stand on one line."""
    before = ordered().rowsBetween(Window.unboundedPreceding, -1)
    return widths.withColumn("x", F.coalesce(F.sum(F.col("width") + space).over(before), F.lit(0.0)))
