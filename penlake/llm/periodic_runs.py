"""Runs: stretches of words that repeat with a period, by internal pattern matching.

A run is a stretch of at least ``least`` words and ``times`` smallest periods that no neighbouring word extends.

1. Documents in which no phrase of 2 ** k words recurs (the shortest block, 8 for the defaults) hold no run and are
   done; phrases are compared by 64-bit hashes here, which can only let a document through.
2. Of the others, many short ones or a long one at a time, phrases of 2 ** k words are ranked by doubling, within
   each document. The ranks are the dyadic blocks; the last ones sort the recurring places into a suffix array, in
   which the places of any block are an interval. A wavelet tree over that array answers range successors: the next
   place of a block at or behind a given word.
3. Let a run have length L and period q. The largest block size b with 2b - 1 + q <= L has an aligned block s in the
   run's first 2b - 1 words; it comes again at s + q, and q < 2b because L >= 3q. So each aligned block that recurs asks
   for its places among the next b words and the b - 1 behind these. If it has at most two in such a window, their
   distances are candidates. If it has more, they are a progression whose difference is the block's own period p; then
   q is p, or it's the distance of the ends at which the stretches of period p around s and around the progression
   break off: were both ends of the first outside of the run's part that is shifted, that part of 2q words would have
   period p, and so the run a smaller period.
4. A candidate (s, d) is lengthened both ways over equal blocks. Of stretches with the same ends the smallest period
   is the run's; it is among the candidates, as it makes a run itself.

Spark deals documents to tasks; a task's memory is about 100 bytes a word of its longest document that recurs much.

Defined results: a null or empty text has no words and no runs; rows with one doc_id, or none, are judged each by
itself; an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from penlake.llm.common import WordHashes, rolled

RUNS = "array<struct<start:long,length:long,period:long>>"
ARROW = pa.schema([
    ("doc_id", pa.int64()), ("n_words", pa.int64()),
    ("runs", pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))), ("collapsed", pa.string()),
])
I64, I32 = np.int64, np.int32


class WaveletTree:
    """Range counts and successors over a permutation of 0 .. m - 1, for arrays of queries."""

    def __init__(self, values: np.ndarray):
        self.m, self.levels = len(values), []
        for bit in reversed(range(max(self.m - 1, 1).bit_length())):
            zero = (values >> bit) & 1 == 0
            self.levels.append((bit, np.concatenate([[0], np.cumsum(zero)]).astype(I32), int(zero.sum())))
            values = np.concatenate([values[zero], values[~zero]])

    def below(self, left: np.ndarray, right: np.ndarray, x: np.ndarray) -> np.ndarray:
        """How many values at places left .. right - 1 are smaller than x (at most m - 1)."""
        count = np.zeros(len(left), I64)
        for bit, zeros, n in self.levels:
            zl, zr = zeros[left], zeros[right]
            one = (x >> bit) & 1 == 1
            count += np.where(one, zr - zl, 0)
            left, right = np.where(one, n + left - zl, zl), np.where(one, n + right - zr, zr)
        return count

    def ordered(self, left: np.ndarray, right: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The value at places left .. right - 1 that k others there are smaller than."""
        value = np.zeros(len(left), I64)
        for bit, zeros, n in self.levels:
            zl, zr = zeros[left], zeros[right]
            one = k >= zr - zl
            k = np.where(one, k - (zr - zl), k)
            value |= one.astype(I64) << bit
            left, right = np.where(one, n + left - zl, zl), np.where(one, n + right - zr, zr)
        return value

    def successor(self, left: np.ndarray, right: np.ndarray, x: np.ndarray) -> np.ndarray:
        """The smallest value of at least x at places left .. right - 1; m where there is none."""
        out = np.full(len(left), self.m, I64)
        open_ = np.flatnonzero(x < self.m)
        left, right, x = left[open_], right[open_], x[open_]
        k = self.below(left, right, x)
        some = np.flatnonzero(k < right - left)
        out[open_[some]] = self.ordered(left[some], right[some], k[some])
        return out


class Blocks:
    """Dyadic blocks of documents laid end to end: ranks by doubling, the suffix array of recurring places, common extensions.

    words: the number of each word, documents having no number in common. ends: where each word's document ends.
    """

    def __init__(self, words: np.ndarray, ends: np.ndarray, first: int):
        n = self.n = len(words)
        at = np.arange(n)
        rank = np.unique(words, return_inverse=True)[1]
        self.words = np.append(rank, -1)
        for k in range(first):
            whole = at + (2 << k) <= ends
            pair = rank[whole] * (2 * n + 1) + rank[at[whole] + (1 << k)]
            rank = n + at  # a block that its document doesn't hold is like no other
            rank[whole] = np.unique(pair, return_inverse=True)[1]
        size = np.bincount(rank, minlength=2 * n)
        self.places = np.flatnonzero(size[rank] > 1)
        m, self.first = len(self.places), first
        heads = np.cumsum(np.where(size > 1, size, 0)) - np.where(size > 1, size, 0)
        now = m + np.arange(n + 1)
        now[self.places] = heads[rank[self.places]]
        self.ranks: list[np.ndarray] = []
        self.sizes: list[np.ndarray] = []
        unsettled, step = self.places, 1 << first
        while len(unsettled):
            self.ranks.append(now.astype(I32))
            self.sizes.append(np.bincount(now[self.places], minlength=m))
            a, b = now[unsettled], now[unsettled + step]
            order = np.lexsort((b, a))
            a, b, unsettled = a[order], b[order], unsettled[order]
            group = np.flatnonzero(np.diff(a, prepend=-1))
            new = np.flatnonzero((np.diff(a, prepend=-1) != 0) | (np.diff(b, prepend=-1) != 0))
            counts = np.diff(np.append(new, len(a)))
            head = a[new] + new - group[np.searchsorted(group, new, "right") - 1]
            now = now.copy()
            now[unsettled] = np.repeat(head, counts)
            unsettled, step = unsettled[np.repeat(counts, counts) > 1], 2 * step
        suffixes = np.empty(m, I64)
        suffixes[now[self.places]] = np.arange(m)
        self.tree = WaveletTree(suffixes) if m else None

    def next_place(self, left: np.ndarray, right: np.ndarray, x: np.ndarray) -> np.ndarray:
        """The first text position of at least x in an interval of the suffix array; one far behind the text where there is none."""
        return np.append(self.places, 4 * self.n)[self.tree.successor(left, right, np.searchsorted(self.places, x))]

    def forwards(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words from a on equal those from b on (a < b)."""
        start = a
        for k in reversed(range(len(self.ranks))):
            step = np.where(self.ranks[k][a] == self.ranks[k][b], 1 << (self.first + k), 0)
            a, b = a + step, b + step
        going = np.ones(len(a), bool)
        for _ in range((1 << self.first) - 1):
            going &= self.words[a] == self.words[b]
            a, b = a + going, b + going
        return a - start

    def backwards(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words before a equal those before b (a < b)."""
        start = a
        for k in reversed(range(len(self.ranks))):
            size = 1 << (self.first + k)
            same = self.ranks[k][np.where(a >= size, a - size, self.n)] == self.ranks[k][b - np.minimum(size, b)]
            a, b = a - np.where(same, size, 0), b - np.where(same, size, 0)
        going = np.ones(len(a), bool)
        for _ in range((1 << self.first) - 1):
            going &= self.words[a - 1] == self.words[b - 1]  # place -1 holds a word like no other
            a, b = a - going, b - going
        return start - a


def candidates(blocks: Blocks) -> tuple[np.ndarray, np.ndarray]:
    """Places and distances, among them one of each run with its period."""
    starts, lengths, lefts, rights = [], [], [], []
    for k, (rank, size) in enumerate(zip(blocks.ranks, blocks.sizes)):
        length = 1 << (blocks.first + k)
        s = blocks.places[blocks.places % length == 0]
        left = rank[s].astype(I64)
        many = size[left] > 1
        starts.append(s[many])
        lefts.append(left[many])
        rights.append(left[many] + size[left[many]])
        lengths.append(np.full(int(many.sum()), length, I64))
    s, b, left, right = (np.concatenate(x) for x in (starts, lengths, lefts, rights))
    at, distance = [], []

    def give(where: np.ndarray, d: np.ndarray) -> None:
        at.append(where[d > 0])
        distance.append(d[d > 0])

    for low, high in ((s + 1, s + b), (s + b + 1, s + 2 * b - 1)):
        q = np.arange(len(s))
        one = blocks.next_place(left, right, low)
        q = q[one <= high]
        one = one[q]
        give(s[q], one - s[q])
        two = blocks.next_place(left[q], right[q], one + 1)
        more = two <= high[q]
        q, one, two = q[more], one[more], two[more]
        give(s[q], two - s[q])
        more = blocks.next_place(left[q], right[q], two + 1) <= high[q]
        q, one, p = q[more], one[more], (two - one)[more]
        here = s[q]
        give(here, p)
        give(here, (one - blocks.backwards(one, one + p)) - (here - blocks.backwards(here, here + p)))
        give(here, (one + blocks.forwards(one, one + p)) - (here + blocks.forwards(here, here + p)))
    return np.concatenate(at), np.concatenate(distance)


def runs_of(words: np.ndarray, ends: np.ndarray, least: int, times: int, first: int) -> np.ndarray:
    """Rows (start, length, period), by start and period, for words and ends as in Blocks."""
    blocks = Blocks(words, ends, first)
    if blocks.tree is None:
        return np.zeros((0, 3), I64)
    s, d = candidates(blocks)
    inside = s + d < blocks.n
    s, d = s[inside], d[inside]
    back = blocks.backwards(s, s + d)
    start, length = s - back, back + d + blocks.forwards(s, s + d)
    found = np.stack([start, length, d], axis=1)[length >= np.maximum(least, times * d)]
    if not len(found):
        return found
    found = found[np.lexsort((found[:, 2], found[:, 1], found[:, 0]))]
    new = np.any(np.diff(found[:, :2], axis=0, prepend=-1) != 0, axis=1)  # the smallest period of those with the same ends
    found = found[new]
    return found[np.lexsort((found[:, 2], found[:, 0]))]


def shortest_block(least: int) -> int:
    """The exponent of the largest power of two b with 2b - 1 + q <= L for every run."""
    return int((2 * least / 3 + 1) / 2).bit_length() - 1


def find_runs(docs: DataFrame, prepare: Callable[[int | None, list[bytes]], list[bytes]] | None = None, least: int = 24, times: int = 3, chunk_words: int = 100_000) -> DataFrame:
    """doc_id, n_words, runs (by start, then period) and the text without what repeats, for each row of docs (doc_id, text).

    collapsed: the words that no run contains after its first period, joined by one space. prepare: what to do with a
    document's words first. chunk_words: documents are worked through in stretches of about so many words.
    """
    if least < 2 or times < 3:
        raise ValueError("runs need at least 2 words and 3 periods")
    first = shortest_block(least)
    gram = 1 << first

    def suspects(hashes: list[np.ndarray]) -> list[int]:
        """The documents in which a phrase of a shortest block's size recurs."""
        sizes = np.array([max(len(h) - gram + 1, 0) for h in hashes])
        of = np.repeat(np.arange(len(hashes)), sizes)
        h = np.concatenate([rolled(h, gram) for h in hashes])
        order = np.lexsort((h, of))
        again = (np.diff(h[order]) == 0) & (np.diff(of[order]) == 0)
        return np.unique(of[order][1:][again]).tolist()

    def chunk(ids: list, texts: list[list[bytes]], hashes: list[np.ndarray]) -> pa.RecordBatch:
        runs: list[list[dict]] = [[] for _ in texts]
        kept = list(texts)
        if some := suspects(hashes):
            number: dict[bytes, int] = {}
            parts = [np.fromiter((number.setdefault(w, len(number)) for w in texts[i]), I64, len(texts[i])) for i in some]
            sizes = np.array([len(x) for x in parts])
            ends = np.cumsum(sizes)
            words = np.concatenate([x + j * len(number) for j, x in enumerate(parts)])
            found = runs_of(words, np.repeat(ends, sizes), least, times, first)
            of = np.searchsorted(ends, found[:, 0], "right")
            change = np.zeros(len(words) + 1, I64)
            np.add.at(change, found[:, 0] + found[:, 2], 1)
            np.add.at(change, found[:, 0] + found[:, 1], -1)
            stays = np.cumsum(change[:-1]) == 0
            for j, (start, length, period) in zip(of.tolist(), found.tolist()):
                runs[some[j]].append({"start": start - int(ends[j] - sizes[j]), "length": length, "period": period})
            for j in set(of.tolist()):
                i = some[j]
                kept[i] = [w for w, k in zip(texts[i], stays[ends[j] - sizes[j] : ends[j]].tolist()) if k]
        columns = [ids, [len(t) for t in texts], runs, [b" ".join(k).decode() for k in kept]]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, ARROW.types)], schema=ARROW)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed = WordHashes()
        for batch in batches:
            ids, texts, hashes, size = [], [], [], 0
            for doc_id, text in zip(*(c.to_pylist() for c in batch.columns)):
                words = (text or "").encode().split()
                words = prepare(doc_id, words) if prepare else words
                ids.append(doc_id)
                texts.append(words)
                hashes.append(hashed(words))
                size += len(words)
                if size >= chunk_words:
                    yield chunk(ids, texts, hashes)
                    ids, texts, hashes, size = [], [], [], 0
            if ids:
                yield chunk(ids, texts, hashes)

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(run, f"doc_id long, n_words long, runs {RUNS}, collapsed string")


def digest(found: DataFrame) -> DataFrame:
    """Of each row of find_runs: how many runs, the one with the greatest share of its length to its period, and hashes.

    Two shares that differ do so as doubles too, a document's length times a period being below 2 ** 52.
    """
    best = F.array_max(F.transform("runs", lambda r: F.struct((r["length"] / r["period"]).alias("share"), (-r["start"]).alias("start"), (-r["period"]).alias("period"), r["length"].alias("length"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", *(r[c].cast("string") for c in ("start", "length", "period"))), F.lit("\n")))
    return found.select("doc_id", "runs", "collapsed", best.alias("best")).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("best.start")).alias("start"),
        F.col("best.length").alias("length"),
        (-F.col("best.period")).alias("period"),
        F.expr("1000 * best.length div -best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
