"""Tables of the repository's own shape over whatever Parquet tables hold the data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Point sequences (item_id, pos, x, y, pen): one per user of events, in order of time."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("item_id"),
        F.row_number().over(w).cast("bigint").alias("pos"),
        (F.col("value") / 2000).alias("x"),
        (F.get_json_object("props", "$.k").cast("double") / 1000).alias("y"),
        F.when(F.col("event_type") == "error", 0).otherwise(1).cast("bigint").alias("pen"),
    )


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, pos, word) of documents, cut at single blanks."""
    docs = table(spark, sf_dir, "documents").where("text is not null")
    return docs.select("doc_id", F.posexplode(F.split("text", " ")).alias("pos", "word"))
