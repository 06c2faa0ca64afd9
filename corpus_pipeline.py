"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each as Parquet in the shared folder and
reads it back for the next. All but the last return the columns of documents and ignore others.

Decisions are taken for rows, not for ids: where a stage joins its verdicts back, rows are numbered first. So rows that
share a doc_id, or have none, are judged each by itself. An empty table gives an empty table at every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from penlake.llm import decontamination, jaccard_join, language_id, packing, pii
from penlake.llm.common import join_checked, materialise, table
from penlake.llm.queries import vocabulary

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Below this posterior a language isn't sure enough.
LEAST_SCORE = 0.5


def numbered(docs: DataFrame) -> DataFrame:
    """docs with a number for each row, written so that it stays."""
    return materialise(docs.select(*COLUMNS).withColumn("row", F.monotonically_increasing_id()), "numbered")


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a sure language, or not in a learned one at all, go; a missing label is filled with the prediction.

    A null text, or one without a letter, has no language and goes; so does every row if none has a label. Repeated
    rows go or stay together; of languages that tie the first in order is taken; texts of any length are read whole.
    """
    seen = language_id.identify_known(docs, vocabulary("piece_bpe_32k.model"), COLUMNS)
    kept = seen.where(F.col("lang_pred") != "und").where(F.col("score") >= LEAST_SCORE).where("known")
    return kept.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates one row stays: that with the smallest doc_id, a null one coming last.

    Repeated rows are copies, of which one stays, also where ids tie. A null or empty text is no copy of anything and stays.
    """
    rows = numbered(docs)
    classes = jaccard_join.jaccard_join(rows.select(F.col("row").alias("doc_id"), "text"))
    linked = classes.where("n_links > 0").select(F.col("doc_id").alias("row"), "class_id")
    linked = materialise(linked.join(rows.select("row", "doc_id"), "row"), "linked")
    first = linked.groupBy("class_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row")).alias("first"))
    gone = linked.select("row").join(first.select(F.col("first.row").alias("row")), "row", "left_anti")
    return join_checked(rows, materialise(gone, "copies"), "row", "left_anti").select(*COLUMNS)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold a benchmark item go, whatever their doc_id. A null or empty text holds none and stays."""
    rows = numbered(docs)
    leaks = decontamination.find_leaks(rows.select(F.col("row").alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
    leaks = materialise(leaks.select(F.col("doc_id").alias("row")).distinct(), "leaks")
    return join_checked(rows, leaks, "row", "left_anti").select(*COLUMNS)


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind in brackets; every row stays. A null text stays null, with a null n_chars."""
    clean = pii.redact(pii.find_pii(docs.select(*COLUMNS)))
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all rows with their places in sequences; a null text is one piece of the end token."""
    return packing.pack(docs, vocabulary("byte_bpe_50k.json"), vocabulary("byte_bpe_50k.tiktoken"))


STAGES = [
    ("language ID", keep_known_languages),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("benchmark decontamination", drop_leaks),
    ("PII", redact_pii),
    ("best-fit packing", pack),
]

#: Language models, tokenisers and packing have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if stage is not pack:
            docs = materialise(docs, name.replace(" ", "_"))
    return docs
