"""From words of pen points to training rows and back: augmentation, strokes thinned per word, layout, generation, data sets."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from penlake.functions import codec
from penlake.functions.geometry import clamp, shear, uniform
from penlake.operators import sequence
from penlake.operators.scan import dense_index

# Ranges of the augmentation, and where words start.
SHEAR, SCALE, DOWNSAMPLE_MEAN, DOWNSAMPLE_WIDTH, DROP = (-0.22, -0.18), (0.9, 1.1), 0.65, 0.1, 0.05
STARTS_AT_BOTTOM = "enaitoshrdx.vpukbgfcymzwlqjS,GJ"
STARTS_AT_TOP = "8049637OTA5N)EHR\"'(BCQLMWYUF!DXVKP"
TOP_DROP = 0.18


def between(bounds: tuple[float, float], u: Column) -> Column:
    return F.lit(bounds[0]) + F.lit(bounds[1] - bounds[0]) * u


def jitter(points: DataFrame, sigma: float = 0.001, seed: int = 31) -> DataFrame:
    """Normally distributed noise on x and y, by Box and Muller's method on hashed uniforms."""
    u = [uniform(seed, i, F.col("item_id"), F.col("pos")) for i in range(2)]
    far = sigma * F.sqrt(-2 * F.log(1 - u[0]))
    return points.withColumns({"x": F.col("x") + far * F.cos(2 * math.pi * u[1]), "y": F.col("y") + far * F.sin(2 * math.pi * u[1])})


def augment(points: DataFrame, seed: int = 7) -> DataFrame:
    """Shear, then scales of x and y, drawn once for each item."""
    u = lambda i: uniform(seed, i, F.col("item_id"))
    x = shear(F.col("x"), F.col("y"), between(SHEAR, u(0)))
    return points.withColumns({"x": x * between(SCALE, u(1)), "y": F.col("y") * between(SCALE, u(2))})


def downsample_words(points: DataFrame, fraction: Column | float, drop: float = 0.0, seed: int = 8) -> DataFrame:
    """points (item_id, word, pos, x, y, pen) with the strokes of each word thinned, and copy (0 or 1).

    Of a stroke of n points max(2, floor(n (1 - fraction))) evenly spaced ones stay, so one of a single point is doubled;
    those inside go with probability ``drop``. Pen-up points stay.
    """
    keys = ("item_id", "word")
    island = F.sum(F.when(F.col("pen") == 1, 0).otherwise(1)).over(Window.partitionBy(*keys).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    p = points.withColumns({"__island": island, "__share": 1 - (fraction if isinstance(fraction, Column) else F.lit(fraction))})
    stroke = Window.partitionBy(*keys, "__island", "pen")
    p = p.withColumns({"__i": F.row_number().over(stroke.orderBy("pos")) - 1, "__n": F.count("*").over(stroke)})
    m = F.greatest(F.floor(F.col("__n") * F.col("__share")), F.lit(2))
    inside = (F.col("__i") > 0) & (F.col("__i") < F.col("__n") - 1)
    dropped = inside & (uniform(seed, F.col("item_id"), F.col("pos")) <= drop) if drop else F.lit(False)
    p = p.where((F.col("pen") != 1) | ((F.col("__n") <= 2) | sequence.evenly(F.col("__i"), F.col("__n"), m)) & ~dropped)
    copies = F.when((F.col("pen") == 1) & (F.col("__n") == 1), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return p.withColumn("copy", F.explode(copies)).drop("__island", "__share", "__i", "__n")


def triples(points: DataFrame, texts: DataFrame, length: int = codec.LONGEST, text_length: int = 50, augmented: bool = True, seed: int = 7) -> DataFrame:
    """item_id, x, c, y: the shifted token arrays of each item's words, joined by two WORD tokens, and its text's ids.

    points: (item_id, word, pos, x, y, pen); texts: (item_id, text). Without augmentation points are taken as they are.
    """
    if augmented:
        fraction = DOWNSAMPLE_MEAN + DOWNSAMPLE_WIDTH * (uniform(seed, 3, F.col("item_id")) - 0.5)
        p = downsample_words(augment(points, seed), fraction, DROP)
    else:
        p = points.withColumn("copy", F.lit(0))
    p = p.withColumn("pos", F.row_number().over(Window.partitionBy("item_id").orderBy("pos", "copy")))
    p = sequence.to_polar(sequence.offsets_after_word(p))
    theta, r = codec.tokens_of(F.col("r"), F.col("theta"), F.col("pen"))
    new_word = F.col("word") != F.lag("word").over(Window.partitionBy("item_id").orderBy("pos"))
    mark = F.when(F.coalesce(new_word, F.lit(False)), F.array(F.lit(codec.WORD), F.lit(codec.WORD))).otherwise(F.expr("cast(array() as array<int>)"))
    rows = p.select("item_id", "pos", F.concat(mark, F.array(theta.cast("int"), r.cast("int"))).alias("t"))
    rows = rows.groupBy("item_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("pos", "t"))), lambda s: s["t"])).alias("tokens"))
    x, y = codec.shifted(F.col("tokens"), length)
    return rows.join(texts, "item_id").select("item_id", x.alias("x"), codec.encode_text(F.col("text"), text_length).alias("c"), y.alias("y"))


def decode_words(tokens: DataFrame, key: str = "item_id", column: str = "x") -> DataFrame:
    """key, word, i, r, theta, pen of token arrays: cut at pairs of WORD, special tokens taken out, an odd tail dropped."""
    w = Window.partitionBy(key).orderBy("at")
    t = tokens.select(key, F.posexplode(column).alias("at", "t"))
    cut = (F.col("t") == codec.WORD) & (F.lag("t").over(w) == codec.WORD)
    t = t.withColumn("word", F.sum(F.when(cut, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))).where(~F.col("t").isin(codec.PAD, codec.END, codec.WORD))
    inside = Window.partitionBy(key, "word").orderBy("at")
    t = t.withColumns({"k": F.row_number().over(inside) - 1, "d": F.lead("t").over(inside)}).where("k % 2 = 0 and d is not null")
    r, theta, pen = codec.decode(F.col("t"), F.col("d"))
    return t.select(key, "word", F.floor(F.col("k") / 2).alias("i"), r.alias("r"), theta.alias("theta"), pen.alias("pen"))


def decode_pairs(tokens: DataFrame, key: str = "item_id", column: str = "x") -> DataFrame:
    """The older form without words: PAD and END taken out, pairs in order, an odd tail dropped."""
    t = tokens.select(key, F.posexplode(F.filter(column, lambda t: ~t.isin(codec.PAD, codec.END))).alias("at", "t"))
    t = t.withColumn("d", F.lead("t").over(Window.partitionBy(key).orderBy("at"))).where("at % 2 = 0 and d is not null")
    r, theta, pen = codec.decode(F.col("t"), F.col("d"))
    return t.select(key, F.floor(F.col("at") / 2).alias("i"), r.alias("r"), theta.alias("theta"), pen.alias("pen"))


def elevation(first_letter: Column, first_y: Column) -> Column:
    """What is taken off a word's y, by its first letter: it starts on the line, or under the top, or stays."""
    here = lambda letters: (first_letter != "") & (F.instr(F.lit(letters), first_letter) > 0)
    return F.when(here(STARTS_AT_BOTTOM), first_y).when(here(STARTS_AT_TOP), first_y + TOP_DROP).otherwise(F.lit(0.0))


def lay_out(points: DataFrame, words: DataFrame, space: float = 0.12, line: float = 8.0, line_height: float = 0.5, letter_height: float = 0.35) -> DataFrame:
    """item_id, word, pos, x, y, pen of whole sentences.

    words: (item_id, word, text), all of them; points: (item_id, word, pos, x, y, pen), each word's from its own origin. A word
    is raised by its first letter and clipped; one that starts beyond the line opens the next. A word without points is
    one pen-up point at the cursor.
    """
    inside = Window.partitionBy("item_id", "word").orderBy("pos")
    p = points.join(words, ["item_id", "word"])
    p = p.withColumn("y", clamp(F.col("y") - elevation(F.left("text", F.lit(1)), F.first("y").over(inside)), -letter_height, letter_height))
    widths = p.groupBy("item_id", "word").agg(F.max_by("x", "pos").alias("width"))
    starts = words.select("item_id", "word").join(widths, ["item_id", "word"], "left").select("item_id", F.col("word").alias("pos"), F.coalesce("width", F.lit(0.0)).alias("width"))
    starts = sequence.layout(starts, space, line, line_height).select("item_id", F.col("pos").alias("word"), F.col("x").alias("x0"), F.col("y").alias("y0"))
    out = starts.join(p.select("item_id", "word", "pos", "x", "y", "pen"), ["item_id", "word"], "left")
    return out.select(
        "item_id", "word", F.coalesce("pos", F.lit(0)).alias("pos"), (F.coalesce("x", F.lit(0.0)) + F.col("x0")).alias("x"),
        (F.coalesce("y", F.lit(0.0)) + F.col("y0")).alias("y"), F.coalesce("pen", F.lit(0)).alias("pen"),
    )


def word_labels(points: DataFrame, left: float = 0.12, top: float = 0.95) -> DataFrame:
    """item_id, word, label, x, y: the number of each word and where it's written, by the word's first point."""
    first = points.groupBy("item_id", "word").agg(F.min_by(F.struct("x", "y"), "pos").alias("p"))
    return first.select("item_id", "word", F.col("word").cast("string").alias("label"), (F.col("p.x") - left).alias("x"), (top - F.col("p.y")).alias("y"))


def fill_words(words: DataFrame, most: int) -> DataFrame:
    """The first ``most`` words of each item, and empty ones up to that many. words: (item_id, word from 0, text)."""
    slots = words.select("item_id").distinct().select("item_id", F.explode(F.sequence(F.lit(0), F.lit(most - 1))).alias("word"))
    return slots.join(words, ["item_id", "word"], "left").select("item_id", "word", F.coalesce("text", F.lit("")).alias("text"))


def next_ranges(logits: DataFrame, key: str, vector: str, temperature: float, top_k: int) -> DataFrame:
    """key and ends: for each index the share of all up to it, from the softmax of the ``top_k`` largest logits at a temperature."""
    v = logits.select(key, F.posexplode(vector).alias("i", "v"))
    whole = Window.partitionBy(key)
    v = v.withColumns({"rank": F.rank().over(whole.orderBy(F.desc("v"))), "top": F.max("v").over(whole)})
    v = v.withColumn("e", F.when(F.col("rank") <= top_k, F.exp((F.col("v") - F.col("top")) / temperature)).otherwise(F.lit(0.0)))
    share = F.sum("e").over(whole.orderBy("i").rowsBetween(Window.unboundedPreceding, 0)) / F.sum("e").over(whole)
    parts = v.select(key, "i", share.alias("c")).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("i", "c"))).alias("s"))
    return parts.select(key, F.transform("s", lambda x: F.round(x["c"], 9)).alias("ends"))


def top_ranges(logits: DataFrame, key: str, vector: str) -> DataFrame:
    """As next_ranges, for a draw that always takes the largest logit, the first where equal."""
    from penlake.operators.corpus import argmax

    best = logits.select(key, vector, argmax(F.col(vector)).alias("best"))
    return best.select(key, F.transform(vector, lambda v, i: F.when(i < F.col("best"), 0.0).otherwise(1.0)).alias("ends"))


def generate(starts: DataFrame, ranges: DataFrame, steps: int, crop: int, seed: int = 12) -> DataFrame:
    """item_id and the tokens drawn one after the other, each from the range table's row of the token before; the last ``crop``.

    starts: (item_id, token); ranges: (token, ends). A join per step: what a step needs of the model is a lookup.
    """
    out = starts.withColumn("tokens", F.array(F.col("token").cast("bigint")))
    for k in range(steps):
        u = F.round(uniform(seed, k, F.col("item_id")), 9)
        drawn = F.size(F.filter("ends", lambda e: e <= F.col("u"))).cast("bigint")
        out = out.withColumn("u", u).join(ranges, "token").withColumn("token", drawn).select("item_id", "token", F.concat("tokens", F.array("token")).alias("tokens"))
    return out.select("item_id", F.slice("tokens", F.greatest(F.size("tokens") - crop + 1, F.lit(1)), F.lit(crop)).alias("tokens"))


def combos_by_side(bank: DataFrame, key: str, text: str, asked: DataFrame, ask: str, side: Column, seed: int = 42) -> DataFrame:
    """Texts of three different bank rows for each asked row, from the side of the split that it's for, so nothing leaks.

    bank: key, text and is_test; asked: the key ``ask``; side: whether an asked row is for the test set. Both sides need three rows.
    """
    from penlake.operators.corpus import combine, draw_three

    numbered = dense_index(bank, key, by=["is_test"])
    sizes = {r["is_test"]: r["n"] for r in bank.groupBy("is_test").agg(F.count("*").alias("n")).collect()}  # two rows
    out = []
    for test in (False, True):
        draws = F.posexplode(F.array(*(x.cast("bigint") for x in draw_three(F.col(ask), sizes.get(test, 0), seed)))).alias("pos", "ix")
        rows = asked.where(side if test else ~side).select(ask, draws)
        out.append(combine(rows.join(numbered.where(F.col("is_test") == test), "ix"), ask, "pos", text).select(ask, "ascii").withColumn("is_test", F.lit(test)))
    return out[0].unionByName(out[1])


def sampled(rows: DataFrame, at: str, bank: DataFrame, text: str, order: str, seed: int = 5) -> DataFrame:
    """For each row (a batch's or an endless stream's) a bank row drawn with replacement by a hash of ``at``."""
    numbered = dense_index(bank.select(text, order), order).select(text, "ix")
    n = bank.count()
    return rows.withColumn("ix", F.floor(uniform(seed, F.col(at)) * n)).join(numbered, "ix").drop("ix")
