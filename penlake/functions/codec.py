"""The token space of pen offsets, and the text codec.

A point is two tokens, direction then distance; distances of pen-up points have ids of their own. Decoding gives the
lower edge of a bin.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Bins, special tokens and the alphabet.
THETA_EDGES = [-math.pi + 2 * math.pi * i / 219 for i in range(219)] + [math.pi]
R_EDGES = [0.0] + [0.0001 + (0.060 - 0.0001) * i / 29 for i in range(30)] + [0.06001 * (0.90 / 0.06001) ** (i / 119) for i in range(119)] + [0.90]
N_R = len(R_EDGES)
FIRST_THETA = 2 * N_R
PAD, END, WORD = 522, 523, 524
LONGEST = 1500  # tokens of a sequence
ALPHABET = " enaitoshrdx.vpukbgfcymzw1lqj804I92637OTAS5N)EHR\"'(BCQLMWYU,ZF!DXV?KPGJ"


def last_edge(v: Column, edges: list[float], guess: Column) -> Column:
    """Index of the last edge that is at most v, given a guess that is off by one at most."""
    table, g = F.array(*map(F.lit, edges)), F.least(F.greatest(guess.cast("int"), F.lit(0)), F.lit(len(edges) - 1))
    return F.when(F.get(table, g + 1) <= v, g + 1).when(F.get(table, g) <= v, g).otherwise(g - 1)


def theta_bin(theta: Column) -> Column:
    return last_edge(theta, THETA_EDGES, F.floor((theta + math.pi) * (219 / (2 * math.pi))))


def r_bin(r: Column) -> Column:
    even = 1 + F.floor((r - 0.0001) * (29 / (0.060 - 0.0001)))
    growing = 31 + F.floor(F.log(r / 0.06001) * (119 / math.log(0.90 / 0.06001)))
    return last_edge(r, R_EDGES, F.when(r < 0.0001, 0).when(r < 0.06001, F.least(even, F.lit(30))).otherwise(growing))


def tokens_of(r: Column, theta: Column, pen: Column) -> tuple[Column, Column]:
    """(direction token, distance token)."""
    return F.lit(FIRST_THETA) + theta_bin(theta), r_bin(r) + F.when(pen == 1, 0).otherwise(N_R)


def edge_at(i: Column, edges: list[float]) -> Column:
    """The edge of an index, clipped to the table."""
    return F.element_at(F.array(*map(F.lit, edges)), F.least(F.greatest(i, F.lit(0)), F.lit(len(edges) - 1)).cast("int") + 1)


def decode(theta_token: Column, r_token: Column) -> tuple[Column, Column, Column]:
    """(r, theta, pen) of a pair of tokens."""
    down = r_token < N_R
    return edge_at(F.when(down, r_token).otherwise(r_token - N_R), R_EDGES), edge_at(theta_token - FIRST_THETA, THETA_EDGES), F.when(down, 1).otherwise(0)


def without_specials(tokens: Column) -> Column:
    return F.filter(tokens, lambda t: ~t.isin(PAD, END, WORD))


def encode_whole(text: Column) -> Column:
    """Character ids of the whole text, 0 for unknown ones."""
    return F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.instr(F.lit(ALPHABET), c).cast("bigint"))


def encode_text(text: Column, length: int = 50) -> Column:
    """Character ids, 0 for unknown ones and padding, cut to length: those of the characters that are kept, as no other one has a say."""
    return F.slice(F.concat(encode_whole(F.substring(text, F.lit(1), F.lit(length))), F.array_repeat(F.lit(0).cast("bigint"), length)), 1, length)


def decode_text(ids: Column) -> Column:
    """Characters up to the first 0."""

    def known(ids: Column) -> Column:
        return with_value(F.array_position(ids, 0), lambda end: F.when(end > 0, F.slice(ids, F.lit(1), F.greatest(end - 1, F.lit(0)).cast("int"))).otherwise(ids))

    return F.array_join(F.transform(with_value(ids, known), lambda i: F.substring(F.lit(ALPHABET), i.cast("int"), F.lit(1))), "")


def with_value(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with value worked out once even where f uses it in a lambda."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def split_words(tokens: Column) -> Column:
    """Parts of a token array, cut between neighbouring WORD tokens; an empty array has none."""

    def parts(t: Column) -> Column:
        n = F.size(t)
        inside = F.when(n > 1, F.sequence(F.lit(2), n)).otherwise(F.expr("cast(array() as array<int>)"))
        cuts = F.filter(inside, lambda i: (F.element_at(t, i) == WORD) & (F.element_at(t, i - 1) == WORD))
        ends = with_value(cuts, lambda c: F.zip_with(F.concat(F.array(F.lit(1)), c), F.concat(c, F.array(n + 1)), lambda a, z: F.slice(t, a, z - a)))
        return F.when(n > 0, ends).otherwise(F.expr("cast(array() as array<array<int>>)"))

    return with_value(tokens, parts)


def join_words(parts: Column) -> Column:
    """Parts with two WORD tokens between neighbours."""
    n = F.size(parts)
    return F.flatten(F.transform(parts, lambda p, i: F.when(i < n - 1, F.concat(p, F.array(F.lit(WORD), F.lit(WORD)))).otherwise(p)))


def shifted(tokens: Column, length: int) -> tuple[Column, Column]:
    """(x, y) of a token array at a fixed length: x ends with END and padding, y is x one place on with END twice."""
    n = F.least(F.size(tokens), F.lit(length - 1))
    kept = F.slice(tokens, F.lit(1), n)
    pad = lambda k: F.array_repeat(F.lit(PAD), F.greatest(k, F.lit(0)))
    x = F.concat(kept, F.array(F.lit(END)), pad(F.lit(length - 1) - n))
    y = F.concat(F.slice(x, 2, F.greatest(n, F.lit(0))), F.array(F.lit(END)), pad(F.lit(length - 1) - n))
    return x, y
