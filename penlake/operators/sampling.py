"""Random draws as functions of hashed keys: made-up words and the removal of points."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from penlake.functions.codec import ALPHABET, with_value
from penlake.functions.geometry import uniform
from penlake.operators.scan import dense_index

# Letters with their weights (none under 4), word lengths with theirs, punctuation.
LETTERS = "abcdefghijklmnopqrstuvwxyz"
LETTER_WEIGHTS = [6, 4, 4, 4.3, 6, 4, 4, 6.1, 6, 4, 4, 4, 4, 6, 6, 4, 4, 6, 6.3, 6, 4, 4, 4, 4, 4, 4]
SHORTEST, LONGEST, SLOPE = 3, 10, 0.85
DIGIT_WORDS, MOST_DIGITS, DECIMALS, UPPER, CAPITAL, QUOTED, BRACKETED, FLOWING = 0.25, 5, 0.3, 0.25, 0.25, 0.1, 0.1, 0.8
PUNCTUATION = ",.?!"
EACH_PUNCTUATION = 0.05


def length_weights() -> list[float]:
    """Weights fall along a line; the shortest words count half, the next a quarter more."""
    out = [1 - SLOPE * i / (LONGEST - SHORTEST) for i in range(LONGEST - SHORTEST + 1)]
    return [out[0] * 0.5, out[1] / 0.8, *out[2:]]


def steps(weights: list[float]) -> list[float]:
    """Cumulative shares without the last: the number of them up to u is the index drawn."""
    return [x / sum(weights) for x in accumulate(weights)][:-1]


def pick(u: Column, weights: list[float]) -> Column:
    """The index that a uniform draws; u is worked out once, not for every weight."""
    return with_value(u, lambda x: F.size(F.filter(F.array(*map(F.lit, steps(weights))), lambda s: s <= x)))


def put_in(word: Column, at: Column, what: str) -> Column:
    return F.concat(F.left(word, at), F.lit(what), F.substring(word, at + 1, F.length(word)))


def made_up_words(rows: DataFrame, key: str, seed: int = 46) -> DataFrame:
    """rows with a word for each key: digits or weighted letters, then case, quotes, brackets and punctuation."""
    u = lambda *part: uniform(seed, *part, F.col(key))
    whole = lambda c: F.floor(c).cast("int")
    w, size = F.col("word"), F.length("word")
    digit = u("kind") < DIGIT_WORDS
    n = F.when(digit, 1 + whole(u("length") * MOST_DIGITS)).otherwise(SHORTEST + pick(u("length"), length_weights()))
    one = lambda i: F.when(F.col("digit"), whole(u("char", i) * 10).cast("string")).otherwise(F.substring(F.lit(LETTERS), pick(u("char", i), LETTER_WEIGHTS) + 1, F.lit(1)))
    df = rows.withColumns({"digit": digit, "n": n})
    df = df.withColumn("word", F.array_join(F.transform(F.sequence(F.lit(1), F.col("n")), one), ""))
    capital = F.concat(F.upper(F.left(w, F.lit(1))), F.substring(w, 2, LONGEST))
    cased = F.when(u("upper") < UPPER, F.upper(w)).when(u("capital") < CAPITAL, capital).otherwise(w)
    pointed = F.when(u("decimal") < DECIMALS, put_in(w, whole(u("point") * (size + 1)), ".")).otherwise(w)
    df = df.withColumn("word", F.when(F.col("digit"), pointed).otherwise(cased))
    mark = F.when(u("mark") < 0.5, '"').otherwise("'")
    inside = (u("mark") >= 0.5) & (u("inside") < 0.5) & (size > 1)
    quoted = F.when(inside, put_in(w, 1 + whole(u("gap") * (size - 1)), "'")).when(u("side") < 0.5, F.concat(mark, w)).otherwise(F.concat(w, mark))
    df = df.withColumn("word", F.when(u("quoted") < QUOTED, quoted).otherwise(w))
    df = df.withColumn("word", F.when(u("bracketed") >= BRACKETED, w).when(u("opens") < 0.5, F.concat(F.lit("("), w)).otherwise(F.concat(w, F.lit(")"))))
    end = F.coalesce(*(F.when(u("end", p) < EACH_PUNCTUATION, p) for p in PUNCTUATION), F.lit(""))
    return df.withColumn("word", F.when(u("flowing") < FLOWING, F.concat(w, end)).otherwise(w)).drop("digit", "n")


def remove_random(points: DataFrame, share: float = 0.04, seed: int = 9) -> DataFrame:
    """points (item_id, pos) less floor(share m) of the inner points among each item's first m, m being drawn below its length."""
    item = Window.partitionBy("item_id")
    p = points.withColumns({"__i": F.row_number().over(item.orderBy("pos")) - 1, "__n": F.count("*").over(item)})
    m = F.floor(uniform(seed, F.col("item_id")) * F.col("__n"))
    p = p.withColumns({"__k": F.floor(m * share), "__may": (F.col("__i") >= 1) & (F.col("__i") <= m - 2)})
    rank = F.row_number().over(Window.partitionBy("item_id", "__may").orderBy(uniform(seed, F.col("item_id"), F.col("pos")), "pos"))
    return p.withColumn("__rank", rank).where(~F.col("__may") | (F.col("__rank") > F.col("__k"))).drop("__i", "__n", "__k", "__may", "__rank")


def prompts(asked: DataFrame, ask: str, bank: DataFrame, text: str, key: str, k: int, seed: int = 17) -> DataFrame:
    """ask and prompt for each row of asked: k texts of the bank, each drawn with replacement, joined by blanks. None from an empty bank."""
    numbered, n = dense_index(bank.select(text, key), key).select(text, "ix"), bank.count()
    draws = F.array(*(F.floor(uniform(seed, i, F.col(ask)) * n) for i in range(k)))
    rows = asked.select(ask, F.posexplode(draws).alias("at", "ix")).join(numbered, "ix")
    return rows.groupBy(ask).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", text))), lambda s: s[text]), " ").alias("prompt"))


def random_word(u: Column) -> Column:
    """What one random character id stands for, as a word: the character, or ``the`` for padding and white space."""
    ch = F.substring(F.lit(ALPHABET), F.floor(u * (len(ALPHABET) + 1)).cast("int"), F.lit(1))
    return F.when(F.trim(ch) == "", "the").otherwise(ch)


def filled(words: Column, most: int, key: Column, seed: int = 23) -> Column:
    """A list of words with random ones behind it, up to one less than ``most``; lists that are longer stay as they are."""

    def longer(w: Column) -> Column:
        lacks = F.lit(most - 1) - F.size(w)
        return F.when(lacks > 0, F.concat(w, F.transform(F.sequence(F.lit(0), lacks - 1), lambda i: random_word(uniform(seed, key, i))))).otherwise(w)

    return with_value(words, longer)
