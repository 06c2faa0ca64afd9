"""Exact duplicates against brute force, for runs and rounds of all sizes."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from penlake.llm import exact_dedup

SCHEMA = "doc_id long, text string, row string, node string, keep string, n string, digest string, kept string"


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def brute(rows, largest=True):
    """Each row's result but for kept, and how many rows of each group stay under which id."""
    groups = {}
    for doc_id, text in rows:
        groups.setdefault(lowered(text), []).append(doc_id)
    keep = {t: (max if largest else min)((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    return sorted([(d, keep[lowered(t)], len(groups[lowered(t)]), hashlib.sha256(lowered(t).encode()).hexdigest()) for d, t in rows], key=repr), Counter((hashlib.sha256(t.encode()).hexdigest(), k) for t, k in keep.items())


def check(df, rows, largest=True):
    got = df.collect()
    want, kept = brute(rows, largest)
    assert sorted([(r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got], key=repr) == want
    assert Counter((r["text_sha256"], r["doc_id"]) for r in got if r["kept"]) == kept


def rows_of(n, seed=3):
    """A third of all rows are one text, in changing case; the others repeat now and then."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        text = "The Same text É" if i % 3 == 0 else f"text {rng.randrange(n)} ÀÉ " + "z" * rng.randrange(3)
        rows.append((rng.randrange(10 * n), "".join(rng.choice((c.upper(), c)) if c.isascii() else c for c in text)))
    return rows


@pytest.mark.parametrize("leaf, bits, parts", [(8, 5, 1), (0, 2, 13), (2, 3, 1), (20, 2, 7)])
def test_rounds_of_all_sizes(spark, leaf, bits, parts):
    rows = rows_of(2000)
    df = spark.createDataFrame([(*r, *["x"] * 6) for r in rows], SCHEMA).repartition(parts)
    check(exact_dedup.find_copies(df, leaf=leaf, bits=bits), rows)


def test_smallest_stays(spark):
    rows = [*rows_of(300), (None, "one"), (5, "ONE"), (7, "one")]
    check(exact_dedup.find_copies(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), largest=False), rows, largest=False)


def test_odd_rows(spark):
    """Nulls, empty and very long texts, ties, repeated rows, clashing names, letters that only Unicode lowers."""
    long = "Word " * 300_000
    rows = [(1, None), (2, ""), (None, None), (None, "alone"), (None, "two"), (None, "Two"), (3, long), (9, long.upper()), (4, "a"), (4, "A"), (4, "a"), (5, "É"), (6, "é"), (7, " a"), (8, "a\n")]
    df = spark.createDataFrame([(*r, *["x"] * 6) for r in rows], SCHEMA)
    check(exact_dedup.find_copies(df), rows)
    assert exact_dedup.find_copies(df.limit(0)).count() == 0
    assert exact_dedup.find_copies(df.where("doc_id = 8")).collect()[0]["kept"]


def test_no_python_in_the_plan_and_no_row_of_a_group_moves_up(spark):
    df = exact_dedup.find_copies(spark.createDataFrame(rows_of(3000), "doc_id long, text string").repartition(6).select("*", F.lit(1).alias("bytes")))
    plan = df._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan
