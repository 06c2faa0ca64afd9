"""Handwriting records: JSON arrays, also zipped, to typed rows and back."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

METADATA = "struct<author:string,asciiSequence:string,pointCount:int,strokeCount:int,aspectRatio:double>"
RECORD = f"metadata {METADATA}, points array<array<double>>"
BOX = "text string, box_2d array<double>"


def read_json(spark: SparkSession, path: str, schema: str = RECORD, lines: bool = False) -> DataFrame:
    """A JSON array of records per file or, with lines, one record per line (as write_json leaves them)."""
    return spark.read.schema(schema).option("multiLine", not lines).json(path)


def read_json_zip(spark: SparkSession, path: str, schema: str = RECORD) -> DataFrame:
    """The first member of each archive under path, a JSON array. Spark reads the files; a task unpacks one."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = []
            for content in b.column(0).to_pylist():
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    texts.append(z.read(z.namelist()[0]).decode())
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["json"])

    raw = spark.read.format("binaryFile").load(path).select("content").mapInArrow(unpack, "json string")
    return raw.select(F.explode(F.from_json("json", f"array<struct<{_colons(schema)}>>")).alias("r")).select("r.*")


def _colons(schema: str) -> str:
    """``a int, b array<x>`` as the fields of a struct type."""
    out, depth, name = [], 0, True
    for c in schema:
        depth += (c == "<") - (c == ">")
        if c == " " and depth == 0 and name and out and out[-1] not in ", ":
            out.append(":")
            name = False
            continue
        if c == "," and depth == 0:
            name = True
        out.append(c)
    return "".join(out)


def boxes(raw: DataFrame, column: str = "raw") -> DataFrame:
    """A row per word of each response (a JSON array of text and box_2d): pos from 0, text and box; none for a response that isn't one.

    Other columns stay. A response's words are those of one page.
    """
    rest = [c for c in raw.columns if c != column]
    words = raw.select(*rest, F.from_json(column, f"array<struct<{_colons(BOX)}>>").alias("words"))
    return words.select(*rest, F.posexplode("words").alias("pos", "w")).where("w.text is not null").select(*rest, "pos", F.col("w.text").alias("text"), F.col("w.box_2d").alias("box"))


def transcript_words(pages: DataFrame, text: str = "text") -> DataFrame:
    """A row per word of each text, cut at white space: pos from 0 and word. Other columns stay; a blank or null text has none."""
    rest = [c for c in pages.columns if c != text]
    return pages.select(*rest, F.posexplode(F.split(F.regexp_replace(text, r"^\s+|\s+$", ""), r"\s+")).alias("pos", "word")).where("word <> ''")


def write_json(df: DataFrame, path: str, by: str | None = None) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(by) if by else writer).json(path)


def normalised(records: DataFrame, baseline: float | None = 0.65) -> DataFrame:
    """Points in model space: x by the aspect ratio and from 0, y from the baseline (None: y as it is)."""
    ratio = F.col("metadata.aspectRatio")
    first = F.col("points")[0][0]
    y = lambda p: p[1] if baseline is None else p[1] - F.lit(baseline)
    return records.withColumn("points", F.transform("points", lambda p: F.struct((p[0] * ratio - first * ratio).alias("x"), y(p).alias("y"), p[2].cast("int").alias("pen"))))


def long_enough(records: DataFrame, least: int = 3) -> DataFrame:
    """Records whose text has so many characters; none without a text."""
    return records.where(F.length("metadata.asciiSequence") >= least)


def js_word_bank(words: DataFrame, word: str = "word", end: str = ";") -> DataFrame:
    """One row with the line ``const words = [...]`` and its end. A word bank is a small list by its nature."""
    return words.agg(F.concat(F.lit("const words = "), F.to_json(F.sort_array(F.collect_list(word))), F.lit(end)).alias("value"))
