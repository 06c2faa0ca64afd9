"""Vector best-fit packing of tokenised documents into sequences.

A sequence has three capacities: tokens, documents and attention cost. The cost of a piece is that of its square of
the attention matrix in tiles (its length rounded up to ``tile``, squared), so many short pieces cost more than their
tokens tell. What a piece asks of each follows from its length alone, so the packing is worked out on the counts of
pieces by length (at most ``capacity`` of them, whatever the input), with bins that were filled alike held as one
group. The longest pieces go first. Of the groups that a piece fits under every constraint, the one with the largest
weighted dot product of the demand and the share already used is taken (``rule="dot"``; the dot product with what is
left would prefer empty bins), or that with the smallest weighted norm of what would remain (``rule="norm"``); as many
pieces of that length as the group has bins go in at once.

Capacities that aren't given are fitted: the packing with the fewest sequences under the token capacity alone sets how
many there may be, and then the tightest document and cost capacities that need no more sequences are taken.

The result is a list of placements: so many pieces of a length, from a rank on, go into consecutive sequences at one
offset. Each piece has a rank among the pieces of its length, counted within its task and over the tasks before, and
looks its place up, so the pieces themselves never meet and aren't sorted.

Defined results: a null or empty text is one piece of the end token alone; documents are cut only where longer than
the capacity, the first piece taking the remainder; repeated rows are documents of their own (pieces with equal
doc_id and piece get different places); pieces that tie in length are placed in the order of their ranks; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator
from functools import cached_property
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from penlake.llm.common import join_checked, materialise

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: With the task that cut the piece, and its rank among the task's pieces of its length.
RANKED = f"{PIECES}, chunk int, within long"
PLACED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
#: White space by any reading (Python's, the ranks' or the tokenizer's), for RE2, whose own is ASCII only.
SPACE = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{180e}\x{2000}-\x{200d}\x{2028}\x{2029}\x{202f}\x{205f}\x{2060}\x{3000}\x{feff}]"
#: Texts that aren't taken word by word: empty ones, and those in which white space meets white space or an end.
UNEVEN = rf"\A(?:{SPACE}|\z)|{SPACE}(?:{SPACE}|\z)"
END = np.uint32(2).tobytes()


class Tokens:
    """Token ids of whole texts, as bytes of little-endian 32-bit numbers.

    Byte-level BPE never merges across a blank that has a non-blank on either side. So the different words of a batch
    are read once, as one text, in which each begins with the token that has the blank in front; the ids of the texts
    are put together from them by position. Texts with other white space or special strings are read whole. Nothing is
    remembered between batches.
    """

    def __init__(self, path: str, ranks: str | None = None, words: int = 16_000):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer, self.ranks, self.words = Tokenizer.from_file(path), ranks, words
        vocabulary = self.tokenizer.get_vocab()
        self.begins = np.zeros(max(vocabulary.values()) + 1, bool)
        self.begins[[i for token, i in vocabulary.items() if token.startswith("Ġ")]] = True
        special = "|".join(re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values())
        self.special = re.compile(f"({special})") if special else None
        self.uneven = f"{UNEVEN}|{special}" if special else UNEVEN

    def ranked(self, simple: bool):
        """The same vocabulary read as ranks: several times faster. simple: by a pattern for texts in which no white space meets white space."""
        import tiktoken
        from public_tokenizers import PATTERN

        with open(self.ranks, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        # A single character of white space is the same token with and without the look ahead, which is slow.
        return tiktoken.Encoding("ranks", pat_str=PATTERN.replace(r"\s+(?!\S)|", "") if simple else PATTERN, mergeable_ranks=ranks, special_tokens={})

    @cached_property
    def simple(self):
        return self.ranked(True).encode_ordinary if self.ranks else self.ids

    @cached_property
    def fast(self):
        return self.ranked(False).encode_ordinary if self.ranks else self.ids

    def ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def hold(self, text: str, out: list[int]) -> None:
        """The first 2,000 characters of a text without special strings are held against the tokenizer."""
        some = self.ids(text[:2000])
        if len(text) > 2000:
            some = some[:-5]  # the cut may split a token
        if some != out[: len(some)]:
            raise ValueError("the ranks and the tokenizer disagree")

    def whole(self, text: str, held: bool) -> bytes:
        """The ids of any text; special strings are cut out, as the tokenizer does."""
        out = []
        for i, part in enumerate(self.special.split(text) if self.special else [text]):
            ids = self.ids(part) if i % 2 else self.fast(part)
            if held and not i % 2 and part:
                self.hold(part, ids)
                held = False
            out += ids
        return np.asarray(out, np.uint32).tobytes()

    def of_words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words with a blank in front, and where each word's ids begin and the last one's end."""
        out = []
        for at in range(0, len(words), self.words):
            some = words[at : at + self.words]
            text = " " + pc.binary_join(pa.ListArray.from_arrays([0, len(some)], some), " ")[0].as_py()
            ids = self.simple(text)
            self.hold(text, ids)
            out.append(np.asarray(ids, np.uint32))
        ids = np.concatenate(out)
        starts = np.flatnonzero(self.begins[ids])
        if len(starts) != len(words):
            raise ValueError("a blank isn't where a word begins")
        return ids, np.append(starts, len(ids))

    def by_words(self, texts: pa.Array) -> list[bytes]:
        split = pc.split_pattern(texts, " ")
        ends = split.offsets.to_numpy()[1:]
        first = np.append(0, ends[:-1])
        coded = split.values.dictionary_encode()
        code = coded.indices.to_numpy()
        ids, at = self.of_words(coded.dictionary)
        # A text's first word has no blank in front.
        bare = [self.simple(w) for w in split.values.take(pa.array(first)).to_pylist()]
        n, start = np.diff(at)[code], at[code]
        n[first] = [len(b) for b in bare]
        start[first] = len(ids) + np.cumsum(n[first]) - n[first]
        ids = np.concatenate([ids, np.fromiter(chain.from_iterable(bare), np.uint32)])
        till = np.cumsum(n)
        raw = ids[np.repeat(start - till + n, n) + np.arange(till[-1])].tobytes()
        cuts = [0, *(4 * till[ends - 1]).tolist()]
        return [raw[a:z] for a, z in zip(cuts, cuts[1:])]

    def __call__(self, texts: list[str | None] | pa.Array) -> list[bytes]:
        texts = (texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())).fill_null("")
        uneven = pc.match_substring_regex(texts, self.uneven)
        even = texts.filter(pc.invert(uneven))
        whole = [self.whole(t, not i) for i, t in enumerate(texts.filter(uneven).to_pylist())]
        words, whole = iter(self.by_words(even) if len(even) else ()), iter(whole)
        return [next(whole if u else words) for u in uneven.to_pylist()]


def together(texts: pa.Array, most: int = 8_000_000) -> Iterator[pa.Array]:
    """Stretches of texts with at most so many bytes, or one text."""
    cuts, size = [0], 0
    for i, n in enumerate(pc.binary_length(texts).fill_null(0).to_pylist()):
        if size + n > most and i > cuts[-1]:
            cuts.append(i)
            size = 0
        size += n
    for a, z in zip(cuts, [*cuts[1:], len(texts)]):
        if z > a:
            yield texts[a:z]


def pieces(docs: DataFrame, tokenizer: str, ranks: str | None = None, capacity: int = 1024) -> DataFrame:
    """The pieces of each document with the checksum of their ids (little-endian 32-bit), and their ranks in their task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, chunk, seen = Tokens(tokenizer, ranks), TaskContext.get().partitionId(), [0] * (capacity + 1)
        for b in batches:
            rows = []
            for doc_id, ids in zip(b.column(0).to_pylist(), chain.from_iterable(map(tokens, together(b.column(1))))):
                ids += END
                n = len(ids) // 4
                start, end, k = 0, n % capacity or capacity, 0
                while start < n:
                    size = end - start
                    rows.append((doc_id, k, start, size, zlib.crc32(ids[4 * start : 4 * end]), chunk, seen[size]))
                    seen[size] += 1
                    start, end, k = end, end + capacity, k + 1
            if not rows:
                continue
            cols = list(zip(*rows))
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], [x.split()[0] for x in RANKED.split(", ")])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(run, RANKED)


def ranks_before(sizes: DataFrame, together: int = 256) -> DataFrame:
    """chunk, length and before: how many pieces of that length are in earlier chunks; in two steps, so no window has all chunks."""
    sizes = sizes.withColumn("part", F.floor(F.col("chunk") / together))
    within = F.sum("n").over(Window.partitionBy("length", "part").orderBy("chunk")) - F.col("n")
    parts = sizes.groupBy("length", "part").agg(F.sum("n").alias("n"))
    earlier = parts.select("length", "part", (F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).alias("earlier"))
    return sizes.withColumn("within_part", within).join(earlier, ["length", "part"]).select("chunk", "length", (F.col("earlier") + F.col("within_part")).alias("before"))


def cost_of(length: int, tile: int) -> int:
    """Attention cost of a piece: the square of its length in whole tiles."""
    return (-(-length // tile) * tile) ** 2


def plan(
    counts: dict[int, int], capacity: int, max_docs: int, max_cost: int, rule: str = "dot", weights: tuple[float, float, float] = (1.0, 0.25, 0.25), tile: int = 128, most: int | None = None
) -> list[tuple[int, int, int, int, int]]:
    """Placements (length, first rank, pieces, first sequence, offset) of so many pieces by length.

    A group of bins is split where a length fills it in part. Demands and residuals are compared as shares of their
    capacities. The work follows the number of lengths and groups, not the counts; it ends once there are over ``most`` sequences.
    """
    scale = np.array([capacity, max_docs, max_cost], float)
    w = np.array(weights)
    res = np.zeros((0, 3))  # residual vectors of open groups
    base = np.zeros(0, np.int64)  # first sequence of each group
    size = np.zeros(0, np.int64)  # its bins
    placed, next_bin = [], 0
    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        ask = np.array([length, 1, cost_of(length, tile)], float)
        while left:
            open_now = np.flatnonzero((res >= ask).all(axis=1))
            if not len(open_now):
                fresh = np.array([[capacity, max_docs, max_cost]], float)
                if (fresh < ask).any():
                    raise ValueError(f"a piece of {length} tokens is over the capacity of an empty sequence")
                # Open as few bins as can hold what is left: several pieces of this length share one where they fit.
                each = int(min((fresh // ask)[0]))
                bins = -(-left // each)
                res, base, size = np.vstack([res, fresh]), np.append(base, next_bin), np.append(size, bins)
                next_bin += bins
                if most is not None and next_bin > most:
                    return [(length, rank, left, next_bin - left, 0)]
                continue
            over = (res[open_now] - ask) / scale
            score = (w * ask / scale * (1 - res[open_now] / scale)).sum(axis=1) if rule == "dot" else -(w * over * over).sum(axis=1)
            g = open_now[int(np.argmax(score))]
            take = int(min(left, size[g]))
            placed.append((length, rank, take, int(base[g]), int(capacity - res[g, 0])))
            rank, left = rank + take, left - take
            if take < size[g]:  # the rest of the group stays as it was
                res, base, size = np.vstack([res, res[g]]), np.append(base, base[g] + take), np.append(size, size[g] - take)
                size[g] = take
            res[g] -= ask
        keep = (res >= (1, 1, 1)).all(axis=1)
        res, base, size = res[keep], base[keep], size[keep]
    return placed


def sequences(places: list[tuple[int, int, int, int, int]]) -> int:
    return max((first + n for _, _, n, first, _ in places), default=0)


def fitted_plan(counts: dict[int, int], capacity: int, max_docs: int | None, max_cost: int | None, rule: str | None = None, tile: int = 128) -> tuple[list[tuple[int, int, int, int, int]], int, int]:
    """Placements, max_docs and max_cost; what isn't given is fitted."""
    rules = [rule] if rule else ["dot", "norm"]
    single, least = cost_of(capacity, tile), cost_of(1, tile)
    free = single + capacity * least
    full = {r: plan(counts, capacity, max_docs or capacity, max_cost or free, r, tile=tile) for r in rules}
    best = min(rules, key=lambda r: sequences(full[r]))
    places, most = full[best], sequences(full[best])

    def tightest(capacities: list[int], tried) -> int:
        """The smallest of the capacities that a search by halves finds to need no more sequences; the last one does."""
        nonlocal places
        lo, hi = 0, len(capacities) - 1
        while lo < hi:
            mid = (lo + hi) // 2
            found = tried(capacities[mid])
            if sequences(found) <= most:
                places, hi = found, mid
            else:
                lo = mid + 1
        return capacities[hi]

    ladder = sorted({*(min(capacity, round(1.3**k)) for k in range(64)), capacity})
    if max_docs is None:
        max_docs = tightest(ladder, lambda n: plan(counts, capacity, n, max_cost or free, best, tile=tile, most=most))
    if max_cost is None:
        max_cost = tightest([single, *(single + n * least for n in ladder)], lambda c: plan(counts, capacity, max_docs, c, best, tile=tile, most=most))
    return places, max_docs, max_cost


def pack(
    docs: DataFrame, tokenizer: str, ranks: str | None = None, capacity: int = 1024, max_docs: int | None = None, max_cost: int | None = None, rule: str | None = None, tile: int = 128
) -> DataFrame:
    """The pieces with sequence_id and offset. max_docs and max_cost that aren't given are fitted; so is the rule."""
    cut = materialise(pieces(docs, tokenizer, ranks, capacity), "pieces")
    sizes = materialise(cut.groupBy("chunk", "length").agg(F.count("*").alias("n")), "sizes")
    counts = {r["length"]: r["n"] for r in sizes.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    places, _, _ = fitted_plan(counts, capacity, max_docs, max_cost, rule, tile)
    ranked = join_checked(cut, materialise(ranks_before(sizes), "before"), ["chunk", "length"], "inner")
    ranked = ranked.withColumn("rank", F.col("before") + F.col("within")).select(*(x.split()[0] for x in PIECES.split(", ")), "rank")
    width = np.int64(1) << np.int64(44)
    at = np.array([length * width + rank for length, rank, *_ in places], np.int64)
    order = np.argsort(at)
    at = at[order]
    first_rank, first_bin, offset = (np.array([p[i] for p in places], np.int64)[order] for i in (1, 3, 4))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rank, length = b.column(5).to_numpy(), b.column(3).to_numpy()
            i = np.searchsorted(at, length * width + rank, side="right") - 1
            out = [*b.columns[:5], pa.array(first_bin[i] + rank - first_rank[i]), pa.array(offset[i])]
            yield pa.RecordBatch.from_arrays(out, [x.split()[0] for x in PLACED.split(", ")])

    return ranked.mapInArrow(run, PLACED)
