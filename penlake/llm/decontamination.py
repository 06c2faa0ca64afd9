"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming search, exact verification.

The benchmark is taken in blocks of bounded size, each of which is broadcast, and every document is read once per
block (once in all, up to 20,000 items). Words are compared in lower case without punctuation at their ends.

1. A window of as many words as an item has, or a whole document that is shorter, is fingerprinted if it holds a
   shingle of an item of that length (others can't reach the threshold).
2. A fingerprint is looked up in ``BLOCKS`` tables, one per block of 16 bits: within a radius r of the whole, one block
   at least lies within r // BLOCKS of the item's (pigeonhole), and all values that near are probed, so no fingerprint
   within the radius is missed. The radius follows from the item's length, see radius_of().
3. Candidates are verified by the weighted Jaccard similarity of their shingles, the weights being how often a shingle
   comes.

Defined results: one row per document and item that meet, with the best window (of equal ones the first); items of
fewer than five words are a single shingle; empty or null items and texts match nothing; repeated documents give
repeated results, repeated items count once; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Iterator
from functools import cache, reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from penlake.llm.common import WordHashes, join_checked, mixed
from penlake.llm.substring_dedup import Powers

U64, I64 = np.uint64, np.int64
#: Blocks of a fingerprint, of 16 bits each.
BLOCKS = 4
LEAKS = "doc_id long, item_id long, n_windows long, start long, similarity double"


def plain(word: bytes) -> bytes:
    """Lower case, without punctuation at either end (unless there is nothing else)."""
    s = word.decode().lower()
    a, b = 0, len(s)
    while a < b and not s[a].isalnum():
        a += 1
    while b > a and not s[b - 1].isalnum():
        b -= 1
    return (s[a:b] or s).encode()


class Words(WordHashes):
    def __init__(self) -> None:
        super().__init__()
        self.hash = lambda w: xxhash.xxh3_64_intdigest(plain(w))


def fingerprints(h: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """SimHash of the windows of n words at the given starts: the sign of each bit's sum over the words."""
    lo, hi = int(starts[0]), int(starts[-1]) + n
    bits = np.unpackbits(mixed(h[lo:hi]).view(np.uint8).reshape(-1, 8), axis=1).astype(np.int32) * 2 - 1
    total = np.concatenate([np.zeros((1, 64), np.int32), np.cumsum(bits, axis=0, dtype=np.int32)])
    sums = total[starts - lo + n] - total[starts - lo]
    return np.packbits(sums > 0, axis=1).view(U64).ravel()


def weighted_similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Sum of the smaller weights over sum of the larger, for two bags of shingles."""
    values, where = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = np.bincount(where[: len(a)], minlength=len(values)), np.bincount(where[len(a) :], minlength=len(values))
    return np.minimum(x, y).sum() / np.maximum(x, y).sum()


def radius_of(n: int, whole: bool = False) -> int:
    """How far the fingerprint of a window can lie from that of an item of n words if they're 0.8 alike (fixed values).

    Measured on windows with random edits (1,500 for each of 21 lengths): up to 12 words only the same shingles reach
    0.8; from 13 to 59 words 99.9 % lie within 15, from 60 words within 11. Documents shorter than the item (whole)
    miss up to a fifth of its words and lie within 23.
    """
    return 23 if whole else 3 if n < 13 else 15 if n < 60 else 11


@cache
def probes(radius: int) -> np.ndarray:
    """All 16-bit values with at most so many bits."""
    return np.array([sum(1 << b for b in bits) for k in range(radius + 1) for bits in combinations(range(16), k)], U64)


class HammingIndex:
    """Fingerprints in the order of each of their blocks."""

    def __init__(self, prints: np.ndarray):
        self.prints = prints
        blocks = [(prints >> U64(16 * i)) & U64(0xFFFF) for i in range(BLOCKS)]
        self.orders = [np.argsort(x, kind="stable") for x in blocks]
        self.values = [x[o] for x, o in zip(blocks, self.orders)]
        self.looked_at = self.passed = 0  # pairs of a fingerprint and an item: all, and those that a block let through

    def near(self, p: np.ndarray, radius: int) -> Iterator[tuple[int, int]]:
        """(index into p, index of a fingerprint within the radius)."""
        masks = probes(radius // BLOCKS)
        for i, x in enumerate(p):
            some = []
            for k, (order, values) in enumerate(zip(self.orders, self.values)):
                near = masks ^ ((x >> U64(16 * k)) & U64(0xFFFF))
                lo, hi = np.searchsorted(values, near), np.searchsorted(values, near, "right")
                some += [order[a:z] for a, z in zip(lo[hi > lo].tolist(), hi[hi > lo].tolist())]
            self.looked_at += len(self.prints)
            if some:
                found = np.unique(np.concatenate(some))
                self.passed += len(found)
                for j in found[np.bitwise_count(self.prints[found] ^ x) <= radius]:
                    yield i, int(j)


class Benchmark:
    """Items grouped by length, with their shingles and indexes."""

    def __init__(self, items: list[tuple[int, str]], words: int):
        self.word, self.powers = Words(), Powers()
        self.lengths: dict[int, tuple[int, list[int], list[np.ndarray], HammingIndex]] = {}
        by: dict[int, list[tuple[int, np.ndarray]]] = defaultdict(list)
        for item_id, text in items:
            h = self.word((text or "").encode().split())
            if len(h):
                by[len(h)].append((item_id, h))
        grams: dict[int, dict[int, list[np.ndarray]]] = defaultdict(lambda: defaultdict(list))
        for n, some in by.items():
            k = min(words, n)
            bags = [self.powers.runs(h, k) for _, h in some]
            prints = np.concatenate([fingerprints(h, np.zeros(1, I64), n) for _, h in some])
            self.lengths[n] = (k, [i for i, _ in some], bags, HammingIndex(prints))
            grams[k][n] += bags
        #: per shingle size: all item shingles in order, and a bit table that rules out most others
        self.known = {}
        for k, lengths in grams.items():
            values = np.unique(np.concatenate([x for bags in lengths.values() for x in bags]))
            table = np.zeros(1 << 20, bool)
            table[values >> U64(44)] = True
            self.known[k] = (values, table, {n: np.unique(np.concatenate(bags)) for n, bags in lengths.items()})

    def leaks(self, text: bytes, threshold: float) -> Iterator[tuple[int, int, int, float]]:
        """(item, windows within the threshold, start of the best, its similarity)."""
        words = text.split()
        h = None
        for k, (values, table, lengths) in self.known.items():
            if len(words) < k:
                continue
            h = self.word(words) if h is None else h
            g = self.powers.runs(h, k)
            maybe = np.flatnonzero(table[g >> U64(44)])
            if not len(maybe):
                continue
            hit = maybe[values[np.minimum(np.searchsorted(values, g[maybe]), len(values) - 1)] == g[maybe]]
            for n, own in lengths.items() if len(hit) else ():
                at = hit[own[np.minimum(np.searchsorted(own, g[hit]), len(own) - 1)] == g[hit]]
                if not len(at):
                    continue
                m = min(n, len(words))  # words of a window: all of a document that is shorter than the item
                if m - k + 1 < threshold * (n - k + 1) - 1e-9:
                    continue
                mark = np.zeros(len(words) + 1, I64)
                np.add.at(mark, np.maximum(at - (m - k), 0), 1)
                np.add.at(mark, at + 1, -1)
                starts = np.flatnonzero(np.cumsum(mark)[: len(words) - m + 1])
                if not len(starts):
                    continue
                _, ids, bags, index = self.lengths[n]
                found: dict[int, list] = {}
                for i, j in index.near(fingerprints(h, starts, m), radius_of(n, m < n)):
                    s = int(starts[i])
                    if (sim := weighted_similarity(g[s : s + m - k + 1], bags[j])) >= threshold - 1e-12:
                        row = found.setdefault(j, [0, s, sim])
                        row[0] += 1
                        if sim > row[2]:
                            row[1:] = s, sim
                for j, (count, s, sim) in found.items():
                    yield ids[j], count, s, sim


#: This process's last benchmark block, so that tasks share it.
HELD: dict[str, Benchmark] = {}


def leaks_of_block(docs: DataFrame, items: list[tuple[int, str]], threshold: float, words: int) -> DataFrame:
    shared, name = docs.sparkSession.sparkContext.broadcast(items), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in HELD:
            HELD.clear()
            HELD[name] = Benchmark(shared.value, words)
        bench = HELD[name]
        for b in batches:
            rows = [(i, *x) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) if t for x in bench.leaks(t.encode(), threshold)]
            if rows:
                types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], [x.split()[0] for x in LEAKS.split(", ")])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(run, LEAKS)


def find_leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.8, words: int = 5, block_items: int = 20_000, block_chars: int = 16_000_000) -> DataFrame:
    """Pairs of documents (doc_id, text) and items (item_id, text) that meet."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).distinct()
    size = items.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars")).first()
    blocks = max(1, -(-size["n"] // block_items), -(-size["chars"] // block_chars))
    out = []
    for k in range(blocks):
        some = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k) if blocks > 1 else items
        out.append(leaks_of_block(docs, [tuple(r) for r in some.collect()], threshold, words))  # a block of bounded size, items being distinct
    return reduce(DataFrame.unionByName, out)


def without_leaks(docs: DataFrame, leaks: DataFrame, key: str = "doc_id") -> DataFrame:
    """docs without the rows whose key met an item."""
    return join_checked(docs, leaks.select(key).distinct(), key, "left_anti")
