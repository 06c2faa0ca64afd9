"""Spelling variants against brute force over all pairs of words."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import pytest

from penlake.llm import queries, spelling
from penlake.llm.common import materialise

SF = "/root/testdata/sf0.001"


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_groups(words, ratio=10):
    out = {}
    for w, n in words.items():
        others = [(-m, v) for v, m in words.items() if near(w, v)]
        best = min(others, default=None)
        form = best[1] if best and -best[0] >= ratio * n else None
        out[w] = (form, n, len(others), words[form] if form else None)
    rows = []
    for w, (form, *rest) in out.items():
        root = w
        while out[root][0]:
            root = out[root][0]
        rows.append((w, form, root, *rest))
    return sorted(rows)


def brute_words(rows):
    total = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            total[run] += 1
    return {w: n for w, n in total.items() if len(w) >= 7 and n >= 2}


def rows_of(df):
    return sorted(tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect())


@pytest.mark.parametrize("shards", [1, 10, 1000])
def test_neighbours_over_small_alphabets(spark, shards):
    """Dense sets, whose prefixes and suffixes many shards share; equal letters in a row; no least length."""
    rng = random.Random(shards)
    words = {"".join(rng.choice("abé") for _ in range(rng.randrange(1, 8))): rng.choice([1, 1, 2, 10, 25, 100, 100, 2000, 10**6]) for _ in range(500)}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    ways = materialise(spelling.ways_of(df, shard_words=max(len(words) // shards, 1)), "ways")
    named = {r["place"]: r["word"] for r in ways.collect()}
    assert [named[k] for k in sorted(named)] == sorted(words)
    got = {named[r["place"]]: (r["n_near"], -r["best"]["minus_n"], named[r["best"]["place"]]) for r in spelling.neighbours(ways).collect()}
    want = {}
    for w in words:
        others = [(-m, v) for v, m in words.items() if near(w, v)]
        if others:
            want[w] = (len(others), -min(others)[0], min(others)[1])
    assert got == want
    assert rows_of(spelling.group_variants(df)) == brute_groups(words)


def test_nodes_are_those_of_one_trie(spark):
    rng = random.Random(7)
    words = sorted({"".join(rng.choice("abcdö") for _ in range(rng.randrange(1, 9))) for _ in range(800)})
    df = spark.createDataFrame([(w,) for w in words], "word string")
    for backwards in (False, True):
        number = {}
        for r in spelling.trie_nodes(df, len(words), backwards, 37).collect():
            k = r["word"][::-1] if backwards else r["word"]
            for i, node in enumerate(r["nodes"]):
                assert number.setdefault(k[:i], node) == node
            assert len(r["nodes"]) == len(k) + 1
        assert len(set(number.values())) == len(number)


def test_chains_of_forms(spark):
    words = {"aaaaaaaaa": 2, "aaaaaaaab": 20, "aaaaaaabb": 200, "aaaaaabbb": 2000, "aaaaabbbb": 20_000, "aaaabbbbb": 200_000, "zzzzzzz": 5}
    got = rows_of(spelling.group_variants(spark.createDataFrame(list(words.items()), "word string, n long")))
    assert got == brute_groups(words) and {r[2] for r in got} == {"aaaabbbbb", "zzzzzzz"}


def test_odd_rows(spark):
    """Nulls, empty and very long texts and runs, repeated rows, clashing names."""
    rng = random.Random(3)
    stock = ["Language", "language", "languages", "LANGUAGÉ", "langage", "Straße", "Müllerei", "mullerei", "naïveté", "x" * 500, "x" * 501]
    rows = [(i, " ".join(rng.choice(stock) for _ in range(40)) + f" {i}_tokens7tokens") for i in range(60)]
    rows += [(1, None), (2, ""), (3, " 12 !"), (None, "language language naïveté×÷ naïveté×÷"), (7, "y" * 100_000), (7, "y" * 100_000), *rows[:3]]
    rows += [(100 + i, "language " * 300) for i in range(30)]
    df = spark.createDataFrame([(*r, *["x"] * 4) for r in rows], "doc_id long, text string, word string, n string, shard string, key string")
    got = rows_of(spelling.group_variants(spelling.word_counts(df, spelling.drop_a_character, held=5)))
    assert got == brute_groups(brute_words(rows)) and any(r[1] for r in got)
    plain = {r["word"]: r["n"] for r in spelling.word_counts(df).collect()}
    assert plain["y" * 100_000] == 2 and plain["x" * 500] > 10
    assert spelling.group_variants(spelling.word_counts(df.limit(0))).count() == 0
    assert rows_of(spelling.group_variants(spelling.word_counts(df.where("doc_id = 105")))) == [("language", None, "language", 300, 0, None)]


def test_words_of_the_table(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want = brute_words(rows)
    got = rows_of(queries.op11_spelling(spark, SF))
    assert {r[0]: r[3] for r in got} == want and any(r[1] for r in got)
