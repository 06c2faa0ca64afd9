"""Spelling variants: words at an edit distance of one, by integer pairs of trie nodes.

1. Words. Runs of letters are counted per batch of documents, then summed; those that are long and frequent enough are
   the dictionary.
2. Nodes. Words are sorted within ranges (shards) and walked through as a trie: every prefix gets a number, and so does
   every suffix in the trie of the reversed words. A prefix that words of several shards share is a prefix of a
   splitter, so the splitters alone number it; all others lie in one shard, whose number is part of theirs. Words get
   numbers in their order.
3. Pairs. A word gives a pair (prefix node, suffix node) for every position that is skipped and for every place where
   something could be inserted. Words that share a pair by skipping differ in that one character; a word whose own
   halves are the pair is what those become when they lose it. So the join finds exact neighbours, each once: of equal
   characters in a row only the first is skipped for a shorter word. A pair has at most one word per character of the
   alphabet, and one that lacks it, so no group grows with the data.
4. Forms. Each pair gives its words the number of neighbours and the most frequent one, which are added up by word;
   roots are found by doubling along forms, whose counts grow at each step.

Defined results: a null or empty text has no words; a null doc_id counts as an empty one; rows that share a doc_id are
counted each; a dictionary of no or one word has no neighbours; an empty table gives no rows; texts and runs of any
length are read whole; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from penlake.llm.common import materialise

#: Letters of a word, once A-Z are lower-cased (a fixed value).
LETTERS = "[a-zÀ-ÿ]"


def lower_ascii(text: str) -> str:
    return text.encode().lower().decode()


def word_counts(docs: DataFrame, change: Callable[[int | None, str], str] | None = None, least_chars: int = 7, least_n: int = 2, held: int = 500_000) -> DataFrame:
    """word and n for the words of docs (doc_id, text) that have so many characters and occurrences.

    change: what becomes of a document's word before it is counted; it may only shorten it. held: a task adds up at
    most about so many different words before it sends them on.
    """
    long_enough = re.compile(LETTERS + "{%d,}" % least_chars)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[str] = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["word", "n"])

        for b in batches:
            for doc_id, text in zip(*(c.to_pylist() for c in b.columns)):
                found = long_enough.findall(lower_ascii(text or ""))
                if change is None:
                    total.update(found)
                else:
                    for word, n in Counter(found).items():
                        total[change(doc_id, word)] += n
                if len(total) > held:
                    yield out()
                    total.clear()
        if total:
            yield out()

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    parts = slim.mapInArrow(run, "word string, n long").where(F.length("word") >= least_chars)
    return parts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_n)


def drop_a_character(doc_id: int | None, word: str) -> str:
    """The word without one of its characters, if the hash of document and word is a multiple of 31."""
    h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
    if h % 31:
        return word
    at = h % len(word)
    return word[:at] + word[at + 1 :]


def splitters(keys: DataFrame, n: int, shards: int, chars: int = 32) -> list[str]:
    """At most shards - 1 beginnings of keys that cut the table's only column (n rows) into ranges of about one size.

    They are taken from about 32 keys a shard, those with the smallest hashes, which is what the driver sees.
    """
    few = keys.toDF("key").where(F.pmod(F.xxhash64("key"), F.lit(1 << 40)) < int(min(1.0, 32 * shards / max(n, 1)) * (1 << 40)))
    some = sorted(r[0] for r in few.select(F.substring("key", 1, chars)).collect())
    return sorted({some[i * len(some) // shards] for i in range(1, shards)}) if some else []


def trie_nodes(words: DataFrame, n: int, backwards: bool, shards: int) -> DataFrame:
    """word, its place (a number that grows with the words, or the reversed ones) and the numbers of the nodes on its way through the trie, root first.

    backwards: the trie of the reversed words. A task holds one way at a time, and the driver the splitters, which are
    of bounded length, as many as there are shards.
    """
    key = F.reverse("word") if backwards else F.col("word")
    cuts = splitters(words.select(key.alias("key")), n, shards)
    shared = {x: -1 - i for i, x in enumerate(sorted({"", *(s[:i] for s in cuts for i in range(len(s) + 1))}))}

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([bisect_right(cuts, k) for k in b.column(0).to_pylist()], pa.int64()), b.column(0)], ["shard", "key"])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, used, seen, before, path = -1, 0, 0, "", [shared[""]]
        for b in batches:
            places, paths = [], []
            for shard, k in zip(*(c.to_pylist() for c in b.columns)):
                if shard != at:
                    at, used, seen, before, path = shard, 0, 0, "", path[:1]
                same = 0
                for x, y in zip(before, k):
                    if x != y:
                        break
                    same += 1
                path = path[: same + 1]
                for i in range(same + 1, len(k) + 1):
                    node = shared.get(k[:i]) if path[-1] < 0 else None
                    if node is None:
                        used += 1
                        node = shard << 40 | used
                    path.append(node)
                before, seen = k, seen + 1
                places.append(shard << 40 | seen)
                paths.append(path)
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(places, pa.int64()), pa.array(paths, pa.list_(pa.int64()))], ["key", "place", "nodes"])

    dealt = words.select(key.alias("key")).mapInArrow(deal, "shard long, key string").repartition(shards, "shard").sortWithinPartitions("shard", "key")
    nodes = dealt.mapInArrow(walk, "key string, place long, nodes array<long>")
    return nodes.select((F.reverse("key") if backwards else F.col("key")).alias("word"), "place", "nodes")


def ways_of(words: DataFrame, shard_words: int = 200_000) -> DataFrame:
    """word, n, place and the nodes of prefixes and suffixes for each of the words (word, n; each once); places grow in code-point order."""
    n = words.count()
    shards = max(int(words.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n // shard_words))
    fore = trie_nodes(words, n, False, shards).withColumnRenamed("nodes", "prefixes")
    back = trie_nodes(words, n, True, shards).select("word", F.reverse("nodes").alias("suffixes"))
    return words.join(fore, "word").join(back, "word").select("word", "n", "place", "prefixes", "suffixes")


#: What a word does at a pair: lack a character there, skip one, or skip the first of equal ones.
LACKS, SKIPS, SKIPS_FIRST = 0, 1, 2


def neighbours(ways: DataFrame) -> DataFrame:
    """place, n_near and best (minus the count, and the place, of the most frequent neighbour) for the words that have neighbours. ways: as from ways_of."""
    size, chars = F.length("word"), F.split("word", "")
    firsts = F.zip_with(chars, F.concat(F.array(F.lit("")), F.slice(chars, 1, size - 1)), lambda x, y: F.when(x == y, SKIPS).otherwise(SKIPS_FIRST))
    every = F.arrays_zip(
        F.concat("prefixes", F.slice("prefixes", 1, size)).alias("prefix"),
        F.concat("suffixes", F.slice("suffixes", 2, size)).alias("suffix"),
        F.concat(F.array_repeat(F.lit(LACKS), size + 1), firsts).alias("does"),
    )
    pairs = ways.select("place", (-F.col("n")).alias("minus_n"), F.inline(every))
    many = pairs.withColumn("size", F.count(F.lit(1)).over(Window.partitionBy("prefix", "suffix"))).where("size > 1")
    met = many.groupBy("prefix", "suffix").agg(
        F.array_sort(F.collect_list(F.when(F.col("does") != LACKS, F.struct("minus_n", "place", "does")))).alias("longer"),
        F.max(F.when(F.col("does") == LACKS, F.struct("minus_n", "place"))).alias("shorter"),
    )
    met = met.withColumn("firsts", F.filter("longer", lambda x: x["does"] == SKIPS_FIRST))

    def plain(x: Column) -> Column:
        return F.when(x.isNotNull(), F.struct(x["minus_n"].alias("minus_n"), x["place"].alias("place")))

    def seen(x: Column) -> Column:
        """What a word that skips a character learns."""
        most = F.get("longer", F.lit(0))
        other = plain(F.when(most["place"] == x["place"], F.get("longer", F.lit(1))).otherwise(most))
        loses = (x["does"] == SKIPS_FIRST) & F.col("shorter").isNotNull()
        return F.struct(x["place"].alias("place"), (F.size("longer") - 1 + loses.cast("int")).alias("n"), F.least(other, F.when(loses, F.col("shorter"))).alias("best"))

    gains = F.array(F.struct(F.col("shorter.place").alias("place"), F.size("firsts").alias("n"), plain(F.get("firsts", F.lit(0))).alias("best")))
    told = met.select(F.explode(F.concat(F.transform("longer", seen), F.when(F.col("shorter").isNotNull(), gains).otherwise(F.array()))).alias("t")).select("t.*").where("n > 0")
    return told.groupBy("place").agg(F.sum("n").alias("n_near"), F.min("best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """place and root for the words of forms (place, form): the last one that the forms lead to, which has none. Forms have no cycles."""
    now = materialise(forms.select("place", F.col("form").alias("root"), F.lit(True).alias("moved")), "roots")
    while now.where("moved").limit(1).count():
        ahead = now.select(F.col("place").alias("root"), F.col("root").alias("further"))
        now = materialise(now.drop("moved").join(ahead, "root", "left").select("place", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
    return now.drop("moved")


def group_variants(words: DataFrame, ratio: int = 10, shard_words: int = 200_000) -> DataFrame:
    """word, form, root, n, n_near and form_n for each of the words (word, n; each once).

    form: the most frequent neighbour (of those that tie, the first in code-point order) if it's at least ``ratio``
    times as frequent as the word. Written in between, so words are read as often as needed.
    """
    ways = materialise(ways_of(materialise(words, "words"), shard_words), "ways")
    judged = materialise(ways.select("place", "word", "n").join(neighbours(ways), "place", "left"), "judged")
    linked = judged.where(-F.col("best.minus_n") >= ratio * F.col("n")).select("place", F.col("best.place").alias("form"), (-F.col("best.minus_n")).alias("form_n"))
    named = linked.join(roots(linked), "place")
    for c in ("form", "root"):
        named = named.join(ways.select(F.col("place").alias(c), F.col("word").alias("name")), c).drop(c).withColumnRenamed("name", c)
    return judged.join(named, "place", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")
