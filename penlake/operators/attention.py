"""Attention weights as rows, and what is shown of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from penlake.operators.corpus import attended


def causal_weights(points: DataFrame, first: int, heads: int = 1) -> DataFrame:
    """item_id, head, target, source and weight among the first positions of each item: a softmax over the sources up to the target.

    Head h scores a pair by h + 1 times its dot product. The bound is what keeps an item's pairs few.
    """
    p = points.where(F.col("pos") <= first).select("item_id", F.col("pos").alias("target"), "x", "y")
    k = p.groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct(F.col("target").alias("source"), F.col("x").alias("kx"), F.col("y").alias("ky")))).alias("__first"))
    each = p.join(k, "item_id").withColumn("head", F.explode(F.sequence(F.lit(0), F.lit(heads - 1))))
    return attended(each, F.filter("__first", lambda s: s["source"] <= F.col("target")), F.col("head") + 1).select("item_id", "head", "target", "source", "weight")


def strided(weights: DataFrame, first: int, stride: Column | int) -> DataFrame:
    """Weights among the first positions, every stride-th from the second one on, on both sides."""
    shown = lambda c: (F.col(c) > 1) & (F.col(c) <= first) & ((F.col(c) - 2) % stride == 0)
    return weights.where(shown("target") & shown("source"))


def drop_warmup(weights: DataFrame, texts: DataFrame, key: str = "item_id", tail: bool = False) -> DataFrame:
    """weights (key, source from 1) with ch, their character of the key's text, without the characters up to the first blank.

    As the plots of the method do it, the upper end is the length of what is shown, counted from the text's beginning,
    so that as many characters are left out at its end; with ``tail`` they stay. A text without a blank stays whole.
    """
    at, size = F.col("source") - 1, F.length("text")
    gap = F.instr("text", " ") - 1
    end = size if tail else size - gap - 1
    rows = weights.join(texts.select(key, "text"), key)
    return rows.where(F.when(gap < 0, at < size).otherwise((at > gap) & (at < end))).withColumn("ch", F.substring("text", F.col("source").cast("int"), F.lit(1))).drop("text")
