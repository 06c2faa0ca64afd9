"""Similarity join of documents on word shingles: a MinHash LSH forest, then exact verification.

1. Texts with the same shingle set are one node (its copies are counted, never paired). Sets are told apart by 128
   bits; a node's number is 64 of them, and the few that would share one are given others.
2. Each node's signature labels a path in each of ``trees`` prefix trees. The sorted paths of a tree are its trie;
   nodes that share a prefix are candidates. Whole paths of ``depth`` labels are matched first. How alike the pairs are
   that this finds tells what share of all pairs each shorter prefix would find; prefixes are shortened to the longest
   that reaches ``recall`` (the default: all but one pair in a million), and only prefixes under which paths branch are
   matched again. Without evidence it's the length that finds a pair just at the threshold with that probability.
3. Among nodes with a common prefix, one byte of each label gives an estimate that rules out chance meetings. Large
   groups are compared with leaders: a node that is very close to a leader stands behind it, and every node keeps its
   links to all leaders within reach, so by the triangle inequality of the Jaccard distance close nodes stay in one
   component of candidates.
4. Components of candidates are verified exactly: whole shingle sets meet in blocks of at most ``block`` nodes,
   products of incidence matrices give all intersections of two blocks, and links are counted where they're found.

Defined results: words are runs of non-blanks, as they are; a text of one to four words is one shingle; a null or
empty text has no shingle, no link and is a class of its own; repeated rows are copies; a class is a connected
component and is named by its smallest doc_id, a null doc_id coming last; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from penlake.llm.common import WordHashes, join_checked, join_unique, materialise, mixed
from penlake.llm.components import components
from penlake.llm.packed import ROW, batch_of, by_bucket, freeze, joined_up, parcels, squeeze, thaw, unsqueeze
from penlake.llm.substring_dedup import LAST, Powers, bucket_of

U64, I64, I32 = np.uint64, np.int64, np.int32
SHINGLED = "doc_id long, node long, check long, n_shingles int, signature binary"


class Shingler:
    def __init__(self, words: int, values: int, seed: int = 1):
        self.words, self.word, self.powers = words, WordHashes(), Powers()
        rng = np.random.default_rng(seed)
        self.a = rng.integers(1, 1 << 63, values, dtype=U64) * U64(2) + U64(1)
        self.b = rng.integers(0, 1 << 63, values, dtype=U64)

    def shingles(self, text: bytes) -> np.ndarray:
        """The sorted set of shingle hashes."""
        words = text.split()
        return np.unique(self.powers.runs(self.word(words), min(self.words, len(words)))) if words else np.zeros(0, U64)

    def signature(self, shingles: np.ndarray) -> np.ndarray:
        out = np.full(len(self.a), 0xFFFFFFFF, np.uint32)
        for i in range(0, len(shingles), 4096):
            h = (shingles[i : i + 4096, None] * self.a + self.b) >> U64(32)
            out = np.minimum(out, h.min(axis=0).astype(np.uint32))
        return out


def ids_of(shingles: np.ndarray, bits: int = 64) -> tuple[int, int]:
    """A node number (of fewer bits in tests), and 64 bits more to tell apart what shares one."""
    h = xxhash.xxh3_128_intdigest(shingles.tobytes())
    return (h >> 128 - bits) - (1 << bits - 1), (h & ((1 << 64) - 1)) - (1 << 63)


def prefix_length(found: np.ndarray, trees: int, depth: int, threshold: float, recall: float) -> int:
    """The longest prefix, of at most depth labels, that finds enough of all pairs within the threshold.

    found[i]: pairs that whole paths brought together and of whose labels i agree (by a byte of each). Each stands for as
    many pairs as its chance of being found is smaller than 1. One more pair, just at the threshold, is taken as given.
    """
    alike = np.maximum((256 * np.arange(len(found)) / (trees * depth) - 1) / 255, threshold)
    missed = lambda k: (1 - alike**k) ** trees
    pairs = found / (1 - missed(depth))
    for k in range(depth, 0, -1):
        if (pairs * missed(k)).sum() + (1 - threshold**k) ** trees <= (1 - recall) * (pairs.sum() + 1):
            return k
    raise ValueError("more trees are needed for this recall")


def near_pairs(signs: np.ndarray, close: float, reach: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs to link among nodes with a common prefix, a stretch at a time; signs: a byte of each label."""
    m = len(signs)
    alike = lambda a, b: (signs[a][:, None, :] == signs[b][None, :, :]).mean(axis=2, dtype=np.float32)
    is_leader = np.zeros(m, bool)
    for i in range(0, m, 128):
        rows = np.arange(i, min(m, i + 128))
        behind = np.zeros(len(rows), bool)
        leaders = np.flatnonzero(is_leader)
        for j in range(0, len(leaders), 1024):
            like = alike(rows, leaders[j : j + 1024])
            x, y = np.nonzero(like >= reach)
            yield rows[x], leaders[j : j + 1024][y]
            behind |= (like >= close).any(axis=1)
        own = alike(rows, rows)
        x, y = np.nonzero(np.triu(own >= reach, 1))
        yield rows[x], rows[y]
        new: list[int] = []
        for r in range(len(rows)):
            if not behind[r] and not (own[r, new] >= close).any():
                new.append(r)
        # Those of earlier stretches that stand behind others still get their links to the new leaders.
        fresh = rows[new]
        for j in range(0, i if len(fresh) else 0, 1024):
            some = np.arange(j, min(i, j + 1024))
            some = some[~is_leader[some]]
            if len(some):
                x, y = np.nonzero(alike(some, fresh) >= reach)
                yield some[x], fresh[y]
        is_leader[fresh] = True


def linked(sets: list[np.ndarray], split: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (i < j) whose Jaccard similarity reaches the threshold: all of them if split is 0, else those across it."""
    sizes = np.array([len(s) for s in sets])
    values, column = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(len(sets)), sizes)
    shared = np.bincount(column) > 1
    number = np.cumsum(shared) - 1
    keep = shared[column]
    row, column = row[keep], number[column[keep]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    left, right = (slice(0, split), slice(split, None)) if split else (slice(None), slice(None))
    common = np.zeros((len(sizes[left]), len(sizes[right])), np.float32)
    for c in range(0, int(shared.sum()), 1024):
        lo, hi = np.searchsorted(column, [c, c + 1024])
        m = np.zeros((len(sets), 1024), np.float32)
        m[row[lo:hi], column[lo:hi] - c] = 1
        common += m[left] @ m[right].T
    union = sizes[left][:, None] + sizes[right][None, :] - common
    # compared in whole numbers: threshold is taken as a fraction of 1000
    hit = 1000 * common.astype(I64) >= round(threshold * 1000) * union.astype(I64)
    i, j = np.nonzero(hit)
    j = j + split
    keep = i < j
    return i[keep], j[keep]


def roots(n: int, i: np.ndarray, j: np.ndarray, root: np.ndarray | None = None) -> np.ndarray:
    """Smallest index of each one's component, given links and maybe the components that others made."""
    root = np.arange(n) if root is None else root
    i, j = root[i], root[j]
    while True:
        low = root.copy()
        np.minimum.at(low, i, root[j])
        np.minimum.at(low, j, root[i])
        low = low[low]
        if (low == root).all():
            return root
        root = low


def jaccard_join(
    docs: DataFrame, threshold: float = 0.8, words: int = 5, trees: int = 20, depth: int = 4, recall: float = 0.999999, block: int = 2048, bucket_docs: int = 4000, pairwise: int = 8, bits: int = 64,
) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, class_id, n_links (other rows within the threshold), n_copies (rows with the same shingles).

    pairwise: groups of up to so many nodes with a common prefix are compared pair by pair, larger ones by leaders. Both
    ways bring together what must be verified, so results don't depend on it.
    """
    spark = docs.sparkSession
    slim = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    spread = (threshold * (1 - threshold) / (trees * depth)) ** 0.5
    least, close, reach = threshold - 5 * spread, min(0.98, threshold + 2.5 * spread), 2 * threshold - 1 - 5 * spread

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = Shingler(words, trees * depth)
        for b in batches:
            rows = []
            for doc_id, text in zip(*(c.to_pylist() for c in b.columns)):
                x = s.shingles(text.encode())
                rows.append((doc_id, *ids_of(x, bits), len(x), s.signature(x).tobytes()) if len(x) else (doc_id, None, None, 0, None))
            types = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], [x.split()[0] for x in SHINGLED.split(", ")])

    signed = materialise(slim.mapInArrow(sign, SHINGLED), "signed")
    nodes = signed.where("node is not null").groupBy("node", "check").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies"), F.first("signature").alias("signature"))
    nodes = materialise(nodes, "nodes")
    clash = materialise(nodes.groupBy("node").agg(F.count("*").alias("n")).where("n > 1").select("node", F.lit(True).alias("clash")), "clashes")
    if not clash.isEmpty():
        told_apart = F.when(F.col("clash"), F.xxhash64("node", "check", F.lit("again"))).otherwise(F.col("node"))
        signed, nodes = (materialise(join_checked(x, clash, "node", "left").withColumn("node", told_apart).drop("clash"), "apart") for x in (signed, nodes))
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-nodes.count() // bucket_docs))

    def keys_of(signature: np.ndarray, length: int) -> np.ndarray:
        """Hashes of the prefixes of so many labels, a row of trees for each node."""
        s = signature.reshape(len(signature), trees, depth)[:, :, :length].astype(U64)
        h = np.broadcast_to(np.arange(trees, dtype=U64), s.shape[:2])
        for k in range(length):
            h = mixed(h ^ (s[:, :, k] + U64((k + 1) << 40)))
        return h.ravel()

    def matrix(column: pa.Array) -> np.ndarray:
        return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(len(column), trees * depth)

    def prefixes(length: int) -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    s = matrix(b.column(1))
                    keys, node = keys_of(s, length), np.repeat(b.column(0).to_numpy(), trees)
                    paths = [keys_of(s, depth)] if length < depth else []
                    yield batch_of(parcels(0, bucket_of(keys, n), keys, node, *paths))

        return run

    def met(length: int) -> Callable:
        def run(bucket: int, kinds: dict) -> Iterator[pa.RecordBatch]:
            """Prefixes under which two paths or more lie (whole paths: two nodes), to their nodes."""
            key, node, *paths = joined_up(kinds[0], U64, I64, *([U64] if length < depth else []))
            path = paths[0] if paths else node
            order = np.lexsort((path, key))
            key, node, path = key[order], node[order], path[order]
            first = np.diff(key, prepend=~key[:1]) != 0
            branches = first | (np.diff(path, prepend=path[:1]) != 0)
            group = np.cumsum(first) - 1
            keep = np.bincount(group, branches)[group] > 1
            if keep.any():
                yield batch_of(parcels(0, bucket_of(node[keep], n), node[keep], key[keep]))

        return run

    def signs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                node = b.column(0).to_numpy()
                yield batch_of(parcels(1, bucket_of(node, n), node, node, wide=(matrix(b.column(1)) & 0xFF).astype(np.uint8)))

    def signed_keys(bucket: int, kinds: dict) -> Iterator[pa.RecordBatch]:
        node, key = joined_up(kinds.get(0, []), I64, U64)
        if not len(node):
            return
        have = joined_up(kinds[1], I64, I64)[0]
        wide = np.concatenate([np.frombuffer(d, np.uint8).reshape(-1, trees * depth) for _, _, d in kinds[1]])
        order = np.argsort(have)
        at = order[np.searchsorted(have[order], node)]
        for i in range(0, len(node), 100_000):
            some = slice(i, i + 100_000)
            yield batch_of(parcels(0, bucket_of(key[some], n), key[some], node[some], wide=wide[at[some]]))

    def candidates(bucket: int, kinds: dict) -> Iterator[pa.RecordBatch]:
        key, node = joined_up(kinds[0], U64, I64)
        wide = np.concatenate([np.frombuffer(d, np.uint8).reshape(-1, trees * depth) for _, _, d in kinds[0]])
        order = np.lexsort((node, key))
        key, node = key[order], node[order]
        cuts = np.flatnonzero(np.diff(key, prepend=~key[:1]))
        sizes = np.diff(np.append(cuts, len(key)))
        pairs: list[np.ndarray] = []
        found = np.zeros(trees * depth + 1)

        def tally(same: np.ndarray) -> None:
            """Count pairs by the labels in which they agree; one that meets in several trees is shared among them."""
            paths = same.reshape(-1, trees, depth).all(axis=2).sum(axis=1)
            np.add.at(found, same.sum(axis=1), 1 / np.maximum(paths, 1))

        for m in np.unique(sizes[sizes <= pairwise]):
            if m < 2:
                continue
            start = cuts[sizes == m]
            for a in range(m):
                for b in range(a + 1, m):
                    same = wide[order[start + a]] == wide[order[start + b]]
                    ok = same.mean(axis=1) >= least
                    tally(same[ok])
                    pairs.append(np.stack([node[start[ok] + a], node[start[ok] + b]], axis=1))
        for start, m in zip(cuts[sizes > pairwise], sizes[sizes > pairwise]):
            own = node[start : start + m]
            # Only who belongs together goes on, a link for each node, so a group of m nodes gives fewer than m rows.
            # Links are held until they are as many as the nodes, so that joining them up stays linear in both.
            root, signs_of, held, n_held = np.arange(m), wide[order[start : start + m]], [], 0
            for a, b in near_pairs(signs_of, close, reach):
                same = signs_of[a] == signs_of[b]
                tally(same[same.mean(axis=1) >= least])
                held.append((a, b))
                n_held += len(a)
                if n_held >= m:
                    root, held, n_held = roots(m, *map(np.concatenate, zip(*held)), root), [], 0
            if held:
                root = roots(m, *map(np.concatenate, zip(*held)), root)
            some = np.flatnonzero(root != np.arange(m))
            pairs.append(np.stack([own[root[some]], own[some]], axis=1))
        if pairs and len(links := np.unique(np.sort(np.concatenate(pairs), axis=1), axis=0)):
            none = pa.nulls(len(links))
            yield pa.RecordBatch.from_arrays([pa.array(links[:, 0]), pa.array(links[:, 1]), none.cast(pa.int32()), none.cast(pa.float64())], names)
        if len(some := np.flatnonzero(found)):
            none = pa.nulls(len(some), pa.int64())
            yield pa.RecordBatch.from_arrays([none, none, pa.array(some.astype(I32)), pa.array(found[some])], names)

    names = ["a", "b", "alike", "pairs"]
    labelled = nodes.select("node", "signature")

    def matched(length: int) -> DataFrame:
        shared = by_bucket(labelled.mapInArrow(prefixes(length), ROW), met(length), ROW)
        told = by_bucket(shared.unionByName(labelled.mapInArrow(signs, ROW)), signed_keys, ROW)
        return by_bucket(told, candidates, "a long, b long, alike int, pairs double")

    links = materialise(matched(depth), "candidates")
    found = np.zeros(trees * depth + 1)
    for alike, pairs in links.where("a is null").groupBy("alike").agg(F.sum("pairs")).collect():  # a row per number of labels
        found[alike] = pairs
    length = prefix_length(found, trees, depth, threshold, recall)
    if length < depth:
        links = links.unionByName(matched(length))
    maybe = components(links.where("a is not null").select("a", "b").distinct())
    # Each node's component, and the number of blocks that it's cut into.
    cut = maybe.groupBy("root").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    wanted = join_unique(maybe, cut, "root").join(nodes.select("node", "check", "first", "copies"), "node").select("first", "node", "check", "root", "copies", "blocks")
    wanted = materialise(wanted, "wanted")

    def wants(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                first, *rest = (c.to_numpy() for c in b.columns)
                yield batch_of(parcels(0, bucket_of(first, n), first, *rest))

    def bodies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_numpy()
            yield batch_of([(bucket, 1, doc_id, None, squeeze(t.encode())) for bucket, doc_id, t in zip(bucket_of(ids, n).tolist(), ids.tolist(), b.column(1).to_pylist())])

    def sets(bucket: int, kinds: dict) -> Iterator[pa.RecordBatch]:
        first, node, check, root, copies, blocks = joined_up(kinds.get(0, []), I64, I64, I64, I64, I64, I32)
        want = {(a, b): tuple(rest) for a, b, *rest in zip(first.tolist(), check.tolist(), node.tolist(), root.tolist(), copies.tolist(), blocks.tolist())}
        ids, s, rows = set(first.tolist()), Shingler(words, 0), []
        for doc_id, _, data in kinds.get(1, []):
            if doc_id not in ids:
                continue
            x = s.shingles(unsqueeze(data))
            if not len(x) or (found := want.pop((doc_id, ids_of(x, bits)[1]), None)) is None:
                continue
            own, root_of, copies_of, k = found
            mine = int(bucket_of(np.array([own]), k)[0])
            packed = freeze(x)
            for other in range(k):
                lo, hi = min(mine, other), max(mine, other)
                group = int(mixed(np.array([root_of], I64).astype(U64) + U64(lo * 1_000_003 + hi))[0] >> U64(1))
                meta = np.array([own, copies_of, root_of, lo, hi, mine], I64).tobytes()
                rows.append((group % n, 1, group, meta, packed))
            if len(rows) > 500:
                yield batch_of(rows)
                rows = []
        if rows:
            yield batch_of(rows)

    def verified(bucket: int, kinds: dict) -> Iterator[pa.RecordBatch]:
        groups: dict[tuple, list] = {}
        for _, meta, data in kinds[1]:
            own, copies_of, *group, mine = np.frombuffer(meta, I64).tolist()
            groups.setdefault(tuple(group), []).append((mine, own, copies_of, data))
        out = []
        for (root_of, lo, hi), rows in groups.items():
            rows.sort(key=lambda r: r[:2])
            split = sum(r[0] == lo for r in rows) if lo != hi else 0
            if lo != hi and not 0 < split < len(rows):
                continue
            i, j = linked([thaw(r[3], U64)[0] for r in rows], split, threshold)
            node, copies_of = np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
            links = np.bincount(i, copies_of[j], len(rows)) + np.bincount(j, copies_of[i], len(rows))
            top = roots(len(rows), i, j)
            some = np.flatnonzero(links)
            out.append(np.stack([node[some], node[top[some]], links[some].astype(I64)], axis=1))
        if out and len(x := np.concatenate(out)):
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in x.T], ["node", "near", "links"])

    met_sets = by_bucket(wanted.mapInArrow(wants, ROW).unionByName(slim.mapInArrow(bodies, ROW)), sets, ROW)
    sure = materialise(by_bucket(met_sets, verified, "node long, near long, links long"), "links")
    root = components(sure.select(F.col("node").alias("a"), F.col("near").alias("b")))
    linked_to = sure.groupBy("node").agg(F.sum("links").alias("links"))
    known = nodes.select("node", "first", "copies").join(linked_to, "node", "left").join(root, "node", "left").withColumn("root", F.coalesce("root", "node"))
    known = materialise(known, "known")
    named = known.groupBy("root").agg(F.min("first").alias("class_id"))
    classes = join_unique(known, named, "root").select("node", "class_id", "copies", F.coalesce("links", F.lit(0)).alias("links"))
    out = materialise(join_unique(signed.select("doc_id", "node"), materialise(classes, "classes"), "node", "left"), "joined")
    known_id = lambda c: F.when(c != LAST, c)
    return out.select(
        known_id(F.col("doc_id")).alias("doc_id"),
        known_id(F.coalesce("class_id", "doc_id")).alias("class_id"),
        F.coalesce(F.col("links") + F.col("copies") - 1, F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("copies", F.lit(1)).cast("long").alias("n_copies"),
    )
