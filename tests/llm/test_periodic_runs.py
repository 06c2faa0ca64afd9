"""Runs against brute force: all periods, all places."""

from __future__ import annotations

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest

from penlake.llm import periodic_runs, queries

SF = "/root/testdata/sf0.001"


def brute_runs(w, least=24, times=3):
    """By definition; a period counts if no smaller one fits the whole stretch."""
    ids = {}
    x = np.array([ids.setdefault(t, len(ids)) for t in w], int)
    found = []
    for q in range(1, len(w) // times + 1):
        same = np.concatenate([[False], x[q:] == x[:-q], [False]])
        edges = np.flatnonzero(np.diff(same.astype(int)))
        for i, j in zip(edges[::2], edges[1::2]):
            length = int(j - i) + q
            if length >= max(least, times * q) and not any((x[i + p : i + length] == x[i : i + length - p]).all() for p in range(1, q)):
                found.append((int(i), length, q))
    return sorted(found, key=lambda r: (r[0], r[2]))


def brute_collapsed(w, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return [t for i, t in enumerate(w) if i not in gone]


def got_runs(texts, least=24, times=3):
    number, sizes = {}, [len(t) for t in texts]
    ends = np.cumsum(sizes)
    words = np.concatenate([np.array([number.setdefault((j, w), len(number)) for w in t], np.int64) for j, t in enumerate(texts)])
    found = periodic_runs.runs_of(words, np.repeat(ends, sizes), least, times, periodic_runs.shortest_block(least))
    out = [[] for _ in texts]
    for s, n, q in found.tolist():
        j = int(np.searchsorted(ends, s, "right"))
        out[j].append((s - int(ends[j]) + sizes[j], n, q))
    return out


def made(rng):
    """Words with runs of all kinds: nested, overlapping, with broken ends, over small alphabets."""
    kind = rng.randrange(5)
    few = [str(i) for i in range(rng.choice([1, 2, 2, 3, 5]))]
    if kind == 0:
        return [rng.choice(few) for _ in range(rng.randrange(1, 160))]
    w = []
    while len(w) < rng.randrange(20, 300):
        unit = [rng.choice(few if rng.random() < 0.7 else [f"n{rng.randrange(99)}"]) for _ in range(rng.randrange(1, 25))]
        if kind > 2:  # a unit that is nearly a run itself
            unit = unit[:4] * rng.randrange(1, 12) + [rng.choice(few)] * rng.randrange(3)
        w += (unit * 9)[: rng.randrange(1, 8 * len(unit) + 1)]
        if rng.random() < 0.4:
            w[rng.randrange(len(w))] = rng.choice(few)
    return w[:500]


@pytest.mark.parametrize("least, times", [(24, 3), (6, 3), (2, 3), (30, 5)])
def test_runs_of_all_kinds(least, times):
    rng = random.Random(least)
    for _ in range(60):
        texts = [made(rng) for _ in range(rng.choice([1, 5, 5]))]
        assert got_runs(texts, least, times) == [brute_runs(t, least, times) for t in texts]


def test_long_periods_and_fibonacci():
    a, b = ["x"], ["x", "y"]
    while len(b) < 1500:
        a, b = b, b + a
    rng = random.Random(1)
    long = [f"w{rng.randrange(50)}" for _ in range(400)]
    texts = [b[:1500], long * 3, (long * 4)[7:1405], ["z"] * 1200, (["z"] * 40 + ["y"]) * 20, long[:9] + ["z"] * 24 + long[:9]]
    got = got_runs(texts)
    assert got == [brute_runs(t) for t in texts]
    assert got[1] == [(0, 1200, 400)] and got[3] == [(0, 1200, 1)] and got[5] == [(9, 24, 1)]


def test_successors():
    rng = np.random.default_rng(2)
    for m in (1, 2, 3, 64, 100, 257):
        values = rng.permutation(m)
        tree = periodic_runs.WaveletTree(values)
        left = rng.integers(0, m, 300)
        right = left + 1 + (rng.random(300) * (m - left)).astype(int)
        x = rng.integers(0, m + 2, 300)
        want = [min((v for v in values[a:b] if v >= y), default=m) for a, b, y in zip(left, right, x)]
        assert tree.successor(left, right, x).tolist() == want


def prepared(doc_id, w):
    h, n = zlib.crc32(str(doc_id).encode()), len(w)
    if h % 10 or not n:
        return w
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]


def brute_row(doc_id, w):
    runs = brute_runs(w)
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    sha = [hashlib.sha256(x.encode()).hexdigest() for x in (lines, " ".join(brute_collapsed(w, runs)))]
    return (doc_id, len(runs), *(best if best else (None, None, None)), 1000 * best[1] // best[2] if best else None, *sha)


NAMES = ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


def test_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    short = {r["doc_id"] for r in docs if len((r["text"] or "").split()) < 2500}
    want = sorted(brute_row(r["doc_id"], prepared(r["doc_id"], (r["text"] or "").encode().decode().split())) for r in docs if r["doc_id"] in short)
    rows = queries.op12_periodic_runs(spark, SF)
    got = sorted(tuple(r) for r in rows.select(*NAMES).collect())
    assert len(got) == len(docs) and [r for r in got if r[0] in short] == want
    assert sum(r[1] > 0 for r in got) > 10


def test_odd_rows(spark):
    run = "a b c " * 20
    long = " ".join(f"w{i % 30_000}" for i in range(100_000))
    rows = [(1, None), (2, ""), (3, " \n"), (None, run), (4, run), (4, run), (5, "x y " * 30), (6, long), (7, "z " * 23), (8, "\t".join(["z"] * 24))]
    df = spark.createDataFrame([(*r, *["x"] * 5) for r in rows], "doc_id long, text string, runs string, collapsed string, best string, start string, n_words string")
    got = {}
    for r in periodic_runs.find_runs(df, chunk_words=50).collect():
        got.setdefault(r["doc_id"], []).append((r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]))
    assert got[1] == got[2] == got[3] == [(0, [], "")]
    assert got[4] == [(60, [(0, 60, 3)], "a b c")] * 2 and got[None] == got[4][:1]
    assert got[5] == [(30, [(0, 30, 1)], "x y")]
    assert got[6][0][:2] == (100_000, [(0, 100_000, 30_000)])
    assert got[7][0][1] == [] and got[8] == [(24, [(0, 24, 1)], "z")]
    digests = {r["doc_id"]: r for r in periodic_runs.digest(periodic_runs.find_runs(df)).collect()}
    assert digests[1]["start"] is None and digests[1]["runs_sha256"] == hashlib.sha256(b"").hexdigest()
    assert periodic_runs.find_runs(df.limit(0)).count() == 0
