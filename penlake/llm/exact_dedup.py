"""Exact duplicates by a tree merge of sorted digest runs, in column expressions only.

1. Leaves. A row becomes its key and its identifier (doc_id, row); ``leaf`` neighbouring rows of a partition are a run.
   The key is the SHA-256 of the normalised text with a second, independent hash and the length in bytes: rows are
   merged only where all three agree, so each merge verifies what it joins.
2. Up. Runs of one partition are merged first, then partitions, in binomial rounds: a round merges the 2 ** ``bits``
   nodes whose numbers differ only in the next bits. A merge is an aggregation by (node, key) over sorted rows, which
   sums the rows of a key and retains the identifier that stays. What a key sends upwards is a row per node, however
   many copies there are, so no task receives a group: at most 2 ** ``bits`` rows a key in a round.
3. Down. The verdicts of keys that came more than once go back through the same nodes, level by level, so that no
   join has more rows for a key than a node has children, or a run has rows.

Each level is written to the shared folder, so a lost executor costs one level. The result doesn't depend on how the
rows are dealt.

Defined results: null text counts as empty; of equal texts the row with the largest (or smallest) doc_id stays, a null
doc_id being beaten by any other; of rows that share it, one stays; keep_id is null only where the whole group has null
ids; texts of any length are read whole; an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from penlake.llm.common import materialise, splitting_skew

KEY = ("digest", "check", "bytes")
#: Bits of a row number below the partition's number, in monotonically_increasing_id (a fixed value).
WITHIN = 33


def lower_ascii(text: Column) -> Column:
    """The text with only A-Z lower-cased; null is empty."""
    return F.translate(F.coalesce(text.cast("string"), F.lit("")), ascii_uppercase, ascii_lowercase)


def find_copies(docs: DataFrame, normalise=lower_ascii, largest: bool = True, leaf: int = 8, bits: int = 5) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 for each row of docs (doc_id, text).

    leaf: a run has 2 ** leaf rows. bits: a round merges 2 ** bits nodes.
    """
    text = normalise(F.col("text")).cast("binary")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("body")).select(
        F.monotonically_increasing_id().alias("row"), "doc_id",
        F.unhex(F.sha2("body", 256)).alias("digest"), F.xxhash64("body").alias("check"), F.octet_length("body").alias("bytes"),
    )
    rows = materialise(rows, "digests")
    if largest:
        best, who = F.max, F.struct("doc_id", "row")
    else:
        best, who = F.min, F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "row")

    def node(shift: int) -> Column:
        return F.shiftright("row", shift)

    ends = rows.agg(F.max(F.col("row").bitwiseAND((1 << WITHIN) - 1)), F.max(node(WITHIN))).first()
    within, parts = (x or 0 for x in ends)
    shifts = [leaf, *(s for s in range(leaf + bits, WITHIN, bits) if within >> s), WITHIN]
    while parts >> (shifts[-1] - WITHIN):
        shifts.append(shifts[-1] + bits)
    steps = [b - a for a, b in zip(shifts, shifts[1:])]

    runs = rows.groupBy(node(leaf).alias("node"), *KEY).agg(best(who).alias("keep"), F.count(F.lit(1)).alias("n"))
    levels = [materialise(runs, "runs")]
    for step in steps:
        merged = levels[-1].groupBy(F.shiftright("node", step).alias("node"), *KEY).agg(best("keep").alias("keep"), F.sum("n").alias("n"))
        levels.append(materialise(merged, "runs"))

    with splitting_skew(docs.sparkSession):
        told = levels.pop().where("n > 1")
        for step in reversed(steps):
            below = levels.pop().select("node", F.shiftright("node", step).alias("parent"), *KEY)
            told = materialise(below.join(told.withColumnRenamed("node", "parent"), ["parent", *KEY]).drop("parent"), "told")
        found = rows.withColumn("node", node(leaf)).join(told, ["node", *KEY], "left")
    alone = F.col("n").isNull()
    return found.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("keep.doc_id")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("keep.row") == F.col("row"))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )
