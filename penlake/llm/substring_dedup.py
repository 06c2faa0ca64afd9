"""Removal of repeated passages: every word in a window of ``size`` words that also starts earlier goes.

1. Anchors. In each run of ``size`` words the ``gram``-word phrase with the smallest hash is its anchor; equal runs
   have equal anchors, and about one phrase in seven is one. Anchors that come once rule out their windows, and a
   document without a recurring anchor can't hold a repeated window.
2. Confirmed passages. Documents are dealt into buckets by a hash of their id. Each bucket gives out the first place
   of each of its different windows whose anchor recurs, with 80 bits of hash; where a window's places meet, those of
   a window that comes again are told the earliest place of all. So a bucket knows all passages that recur in the
   corpus and in itself, each by one place of its own.
3. Automata. A bucket compiles the phrases of those passages, taken word by word from its own documents, into
   Aho-Corasick automata over word numbers (at most ``shard`` phrases each) and streams all its documents through
   them, whole. Around each phrase that they locate the words are held against the passages' windows, word for word;
   what is removed is every occurrence found so but the earliest.

Facts travel in packed rows (see packed.py). A task or bucket gives out one place for the facts that are alike in it,
so a passage in a third of all documents makes a fact per bucket, and its occurrences are found where they lie.

Defined results: windows are judged on the input; a null or empty text, or one of fewer than ``size`` words, loses
nothing; two rows with one doc_id are one place in the order, so neither is earlier than the other; a null doc_id
comes last; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from itertools import compress, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from penlake.llm.common import WordHashes, materialise, mixed
from penlake.llm.packed import ROW, batch_of, by_bucket, joined_up, parcels, squeeze, unsqueeze

LAST = (1 << 63) - 1
POWER, SECOND = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA24BAED4963EE407)
RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string"
U64, I64, I32, U8 = np.uint64, np.int64, np.int32, np.uint8


class Powers:
    """Powers of an odd number and of its inverse, as far as needed: hashes of word runs from one running sum."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, U64)

    def runs(self, h: np.ndarray, n: int) -> np.ndarray:
        if len(h) < n:
            return h[:0]
        if len(self.up) <= len(h):
            size = 2 * len(h) + 1
            self.up = np.cumprod(np.concatenate([np.ones(1, U64), np.full(size, POWER)]), dtype=U64)
            self.down = np.cumprod(np.concatenate([np.ones(1, U64), np.full(size, U64(pow(int(POWER), -1, 1 << 64)))]), dtype=U64)
        total = np.concatenate([np.zeros(1, U64), np.cumsum(mixed(h) * self.up[: len(h)], dtype=U64)])
        return mixed((total[n:] - total[:-n]) * self.down[: len(h) - n + 1])


class Runs:
    """Word hashes of documents, and from them anchors and windows."""

    def __init__(self, size: int, gram: int):
        self.size, self.gram, self.word, self.powers = size, gram, WordHashes(), Powers()

    def anchors(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the phrases, and for each window its anchor's hash. At least ``size`` words."""
        g = self.powers.runs(h, self.gram)
        return g, sliding(np.minimum, g, self.size - self.gram + 1)

    def anchor_places(self, g: np.ndarray, least: np.ndarray) -> np.ndarray:
        """Positions of phrases that are the anchor of some window."""
        width = self.size - self.gram + 1
        edge = np.zeros(width - 1, U64)
        return np.flatnonzero(g == sliding(np.maximum, np.concatenate([edge, least, edge]), width))


def sliding(f: np.ufunc, x: np.ndarray, width: int) -> np.ndarray:
    """Minimum or maximum of each stretch of so many values, by doubling."""
    done = 1
    while done < width:
        step = min(done, width - done)
        x = f(x[: len(x) - step], x[step:])
        done += step
    return x


def bucket_of(x: np.ndarray, n: int) -> np.ndarray:
    return (mixed(x.astype(U64)) % U64(n)).astype(I32)


def firsts(hashes: np.ndarray, doc: np.ndarray, pos: np.ndarray, more: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Order by (hash, more hash bits, document, position), and for each fact in that order the index of the first of its kind."""
    order = np.lexsort((pos, doc, hashes) if more is None else (pos, doc, more, hashes))
    new = np.diff(hashes[order], prepend=~hashes[order[:1]]) != 0
    if more is not None:
        new |= np.diff(more[order], prepend=more[order[:1]]) != 0
    new = np.flatnonzero(new)
    return order, np.repeat(new, np.diff(np.append(new, len(order))))


def occurrences(texts: list[list[bytes]], patterns: list[tuple[int, int]], size: int, gram: int, shard: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(text, starts, numbers of patterns): the places in texts that have the words of a pattern, a pattern being ``size`` words at a place (text, start).

    The automata hold one phrase of ``gram`` words for each pattern, that with the smallest hash, so that neighbouring
    patterns share it, at most ``shard`` phrases each. Where a phrase is located, the ``size`` words around it are looked
    up word for word. A word is two characters, from two alphabets as large as the root of the number of words: an
    automaton looks through a node's branches one by one, so nodes must have few. Words of no pattern are number 0.
    """
    import ahocorasick

    if not patterns:
        return
    by_text: dict[int, list[int]] = {}
    for t, s in patterns:
        by_text.setdefault(t, []).append(s)
    words: set[bytes] = set()
    for t, starts in by_text.items():
        inside = np.zeros(len(texts[t]) + 1, I64)
        np.add.at(inside, starts, 1)
        np.add.at(inside, np.array(starts) + size, -1)
        words.update(compress(texts[t], np.cumsum(inside).tolist()))
    number, base = dict(zip(words, range(1, len(words) + 1))), math.isqrt(len(words)) + 1
    coded, numbers = [], []
    for t in texts:
        n = np.fromiter(map(number.get, t, repeat(0)), np.uint32, len(t))
        numbers.append(n)
        coded.append(np.stack([n // base, n % base + base], axis=1).astype(np.uint32).tobytes().decode("utf-32-le"))
    of: dict[str, int] = {}
    for k, (t, s) in enumerate(patterns):
        of.setdefault(coded[t][2 * s : 2 * (s + size)], k)
    gram, powers = min(gram, size), Powers()
    width = size - gram + 1
    phrases: set[str] = set()
    for t, starts in by_text.items():
        g = powers.runs(numbers[t].astype(U64), gram)
        least = sliding(np.minimum, g, width)[starts]
        for i in range(width):  # the first place in the window that has its least value
            here = g[np.array(starts) + i] == least
            phrases.update(coded[t][2 * (s + i) : 2 * (s + i + gram)] for s in np.array(starts)[here].tolist())
            least[here] = 0
    known = sorted(phrases)
    marks = [np.zeros(len(t) + 1, bool) for t in texts]
    for i in range(0, len(known), shard):
        machine = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
        for phrase in known[i : i + shard]:
            machine.add_word(phrase)
        machine.make_automaton()
        for text, mark in zip(coded, marks):
            if ends := [end for end, _ in machine.iter(text)]:
                mark[np.array(ends) // 2 - gram + 1] = True
    for t, (text, mark) in enumerate(zip(coded, marks)):
        if len(numbers[t]) < size or not mark.any():
            continue
        near = np.flatnonzero(sliding(np.maximum, mark[:-gram], width)[: len(numbers[t]) - size + 1])
        found = [(s, k) for s in near.tolist() if (k := of.get(text[2 * s : 2 * (s + size)])) is not None]
        if found:
            starts, ks = zip(*found)
            yield t, np.array(starts), np.array(ks)


def remove_repeats(docs: DataFrame, size: int = 20, gram: int = 7, bucket_chars: int = 6_000_000, shard: int = 20_000) -> DataFrame:
    """doc_id, n_words, n_removed and the hash of the kept words of each row of docs (doc_id, text)."""
    spark = docs.sparkSession
    slim = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    chars = slim.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-chars // bucket_chars))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = Runs(size, gram)
        for b in batches:
            hs, ids, at = [], [], []
            for doc_id, text in zip(*(c.to_pylist() for c in b.columns)):
                words = text.encode().split()
                if len(words) < size:
                    continue
                g, least = runs.anchors(runs.word(words))
                where = runs.anchor_places(g, least)
                hs.append(g[where])
                at.append(where.astype(I32))
                ids.append(np.full(len(where), doc_id, I64))
            if not hs:
                continue
            h, doc, pos = np.concatenate(hs), np.concatenate(ids), np.concatenate(at)
            order, first = firsts(h, doc, pos)
            more = np.flatnonzero(first != np.arange(len(first)))
            known = np.zeros(len(first), U8)
            known[first[more]] = 1
            keep = np.setdiff1d(np.arange(len(first)), more, assume_unique=True)
            keep = keep[np.argsort(order[keep])]
            rows = parcels(0, bucket_of(h[order[keep]], n), h[order[keep]], doc[order[keep]], pos[order[keep]], known[keep])
            if len(more):
                later = np.sort(order[more])
                rows += parcels(1, bucket_of(doc[later], n), doc[later], pos[later])
            yield batch_of(rows)

    def recurring(bucket: int, kinds: dict) -> Iterator[pa.RecordBatch]:
        h, doc, pos, known = joined_up(kinds.get(0, []), U64, I64, I32, U8)
        rows = [(b, 0, None, meta, None) for b, meta in ((bucket, m) for _, m, _ in kinds.get(1, []))]
        if len(h):
            order, first = firsts(h, doc, pos)
            count = np.bincount(first, minlength=len(first))[first]
            strong = np.bincount(first, known[order], len(first))[first] > 0
            keep = np.sort(order[(count > 1) | strong])
            if len(keep):
                rows += parcels(0, bucket_of(doc[keep], n), doc[keep], pos[keep])
        if rows:
            yield batch_of(rows)

    def bodies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_numpy()
            rows = [(bucket, 1, doc_id, None, squeeze(t.encode())) for bucket, doc_id, t in zip(bucket_of(ids, n).tolist(), ids.tolist(), b.column(1).to_pylist())]
            yield batch_of(rows)

    def candidates(bucket: int, kinds: dict) -> Iterator[pa.RecordBatch]:
        """Finished documents (kind 0), those with windows whose anchor recurs (kind 1), and the first places of these windows (kind 2)."""
        runs, rows = Runs(size, gram), []
        doc, pos = joined_up(kinds.get(0, []), I64, I32)
        order = np.argsort(doc, kind="stable")
        doc, pos = doc[order], pos[order]
        hs, more, ids, at = [], [], [], []
        for doc_id, _, data in kinds.get(1, []):
            words = unsqueeze(data).split()
            some = pos[np.searchsorted(doc, doc_id) : np.searchsorted(doc, doc_id, "right")]
            starts = np.zeros(0, I32)
            if len(some) and len(words) >= size:
                h = runs.word(words)
                g, least = runs.anchors(h)
                starts = np.flatnonzero(np.isin(least, g[some[some < len(g)]])).astype(I32)
            if len(starts):
                rows.append((bucket, 1, doc_id, None, squeeze(b" ".join(words))))
                hs.append(runs.powers.runs(h, size)[starts])
                more.append((runs.powers.runs(h ^ SECOND, size)[starts] >> U64(48)).astype(np.uint16))
                ids.append(np.full(len(starts), doc_id, I64))
                at.append(starts)
            else:
                rows.append((bucket, 0, doc_id, len(words).to_bytes(8, "big"), hashlib.sha256(b" ".join(words)).digest()))
            if len(rows) >= 2000:
                yield batch_of(rows)
                rows = []
        if hs:
            h, check, d, p = map(np.concatenate, (hs, more, ids, at))
            order, first = firsts(h, d, p, check)
            other = (d[order] != d[order[first]]) | (p[order] != p[order[first]])
            lead = np.unique(first)
            again = (np.bincount(first, other, len(first))[lead] > 0).astype(U8)
            by_place = np.argsort(order[lead])  # neighbours in a text pack well
            lead, again = order[lead][by_place], again[by_place]
            rows += parcels(2, bucket_of(h[lead], n), h[lead], check[lead], d[lead], p[lead], again, np.full(len(lead), bucket, I32))
        if rows:
            yield batch_of(rows)

    def confirmed(bucket: int, kinds: dict) -> Iterator[pa.RecordBatch]:
        """Of windows that come again, to each bucket that has another place than the earliest (kind 3): its own first place, and the earliest."""
        h, check, doc, pos, again, home = joined_up(kinds[2], U64, np.uint16, I64, I32, U8, I32)
        order, first = firsts(h, doc, pos, check)
        there, own = order[first], order
        tell = (doc[own] != doc[there]) | (pos[own] != pos[there]) | (again[own] > 0)
        own, there = own[tell], there[tell]
        by_place = np.lexsort((pos[own], doc[own]))
        own, there = own[by_place], there[by_place]
        if len(own):
            yield batch_of(parcels(3, home[own], doc[own], pos[own], doc[there], pos[there], check[own]))

    def finished(bucket: int, kinds: dict) -> Iterator[pa.RecordBatch]:
        """Compile the bucket's confirmed passages, stream its documents, remove what is found and isn't the earliest."""
        ids = [doc_id for doc_id, _, _ in kinds.get(1, [])]
        texts = [unsqueeze(data).split(b" ") for _, _, data in kinds.get(1, [])]
        doc, pos, there, start, check = joined_up(kinds.get(3, []), I64, I32, I64, I32, np.uint16)
        row: dict[int, list[int]] = {}
        for i, doc_id in enumerate(ids):
            row.setdefault(doc_id, []).append(i)
        runs = Runs(size, gram)

        def is_place(i: int, p: int, bits: int) -> bool:
            """Of rows that share a doc_id, the place lies in those that have the window there."""
            h = runs.word(texts[i][p : p + size])
            return len(h) == size and int(runs.powers.runs(h ^ SECOND, size)[0] >> U64(48)) == bits

        patterns, of = [], []
        for k, (d, p, bits) in enumerate(zip(doc.tolist(), pos.tolist(), check.tolist())):
            for i in row[d]:
                if len(row[d]) == 1 or is_place(i, p, bits):
                    patterns.append((i, p))
                    of.append(k)
        change = [np.zeros(len(t) + 1, I64) for t in texts]
        of = np.array(of, I64)
        for t, s, k in occurrences(texts, patterns, size, gram, shard):
            k = of[k]
            gone = s[(there[k] != ids[t]) | (start[k] != s)]
            np.add.at(change[t], gone, 1)
            np.add.at(change[t], gone + size, -1)
        rows = []
        for doc_id, words, c in zip(ids, texts, change):
            keep = np.cumsum(c[:-1]) == 0
            kept = words if keep.all() else [w for w, k in zip(words, keep.tolist()) if k]
            rows.append((doc_id, len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
        if rows:
            types = (pa.int64(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], [x.split()[0] for x in RESULT.split(", ")])

    anchors = by_bucket(slim.mapInArrow(scan, ROW), recurring, ROW)
    split = materialise(by_bucket(anchors.unionByName(slim.mapInArrow(bodies, ROW)), candidates, ROW), "repeats")
    facts = by_bucket(split.where("kind = 2"), confirmed, ROW)
    done = by_bucket(split.where("kind = 1").unionByName(facts), finished, RESULT)
    plain = split.where("kind = 0").select(
        F.col("id").alias("doc_id"),
        F.conv(F.hex("meta"), 16, 10).cast("long").alias("n_words"),
        F.lit(0).cast("long").alias("n_removed"),
        F.lower(F.hex("data")).alias("kept_sha256"),
    )
    return plain.unionByName(done).withColumn("doc_id", F.when(F.col("doc_id") != LAST, F.col("doc_id")))
