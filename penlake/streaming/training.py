"""The data side of a training run as streams: endless draws, evaluation every so many steps, metrics that survive restarts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from penlake.operators import corpus, training

BEST = "step long, test_loss double, best double, saved boolean"


def draws(spark: SparkSession, rows_per_step: int) -> DataFrame:
    """Without end: draw (0, 1, ...), ``rows_per_step`` new ones in a micro-batch. After a restart they go on where they were."""
    source = spark.readStream.format("rate-micro-batch").option("rowsPerBatch", rows_per_step).option("numPartitions", spark.sparkContext.defaultParallelism)
    return source.load().select(F.col("value").alias("draw"))


def endless(spark: SparkSession, bank: DataFrame, text: str, order: str, rows_per_step: int, seed: int = 5) -> DataFrame:
    """The endless loader: a stream of bank rows drawn with replacement; each draw is a function of its number alone."""
    return training.sampled(draws(spark, rows_per_step), "draw", bank, text, order, seed)


def evaluations(losses: DataFrame, run: str, every: int, last_batch: int = 10) -> DataFrame:
    """run, step, train_loss, test_loss, best and saved at the steps that are evaluated: every so many, but not step 0.

    losses: (run, step, side, batch, loss). A loss is the mean of its batches' means, batches up to and including
    ``last_batch``, which makes one more than its number. A step without either side is no evaluation.
    """
    due = losses.where((F.col("step") > 0) & (F.col("step") % every == 0) & (F.col("batch") <= last_batch))
    means = due.groupBy(run, "step", "side", "batch").agg(F.avg("loss").alias("m"))
    side = lambda name: F.avg(F.when(F.col("side") == name, F.col("m"))).alias(f"{name}_loss")
    both = means.groupBy(run, "step").agg(side("train"), side("test")).where("train_loss is not null and test_loss is not null")
    return corpus.running_best(both, run, "step", "test_loss")


def best_stream(losses: DataFrame, run: str) -> DataFrame:
    """running_best for a stream of (run, step, test_loss): the state of a run is its last step and best loss.

    Steps come in order from one micro-batch to the next; one at or before the last step of its run, as a resumed run
    repeats them, is ignored.
    """

    def follow(k: tuple, frames: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        last, best = held.get if held.exists else (-1, float("inf"))
        out = []
        for step, loss in pd.concat(frames).sort_values("step")[["step", "test_loss"]].itertuples(index=False):
            if step > last:
                last, saved, best = int(step), bool(loss < best), min(best, float(loss))
                out.append((*k, last, float(loss), best, saved))
        held.update((last, best))
        yield pd.DataFrame(out, columns=[run, "step", "test_loss", "best", "saved"])

    typed = f"{run} {losses.schema[run].dataType.simpleString()}, {BEST}"
    return losses.groupBy(run).applyInPandasWithState(follow, typed, "last long, best double", "append", GroupStateTimeout.NoTimeout)


def append_once(rows: DataFrame, folder: str, step: int) -> None:
    """Add a step's rows to a table of metrics; a step that is run again replaces what it wrote before."""
    rows.coalesce(1).write.mode("overwrite").parquet(f"{folder}/step={step}")


def metrics(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """All rows that append_once has written under folder, with their step; none if nothing was written yet."""
    try:
        return spark.read.schema(f"{schema}, step int").parquet(folder)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], f"{schema}, step int")


EVALUATED = "train_loss double, test_loss double, best double, saved boolean"


def train(batches: DataFrame, measure: Callable[[DataFrame], DataFrame], evaluate: Callable[[int], DataFrame], folder: str, every: int, max_steps: int = -1) -> StreamingQuery:
    """Start a run over a stream whose micro-batches are the steps; folder keeps its state and metrics.

    measure(batch) gives the step's metrics (train_loss), evaluate(step) one row (train_loss, test_loss) every so many
    steps, with which the best test loss so far and whether this one beats all before are written. What was written
    before a restart counts, so a run that is stopped and started again leaves the same metrics as one that isn't.
    Steps from ``max_steps`` on do nothing (-1: no end).
    """
    spark = batches.sparkSession

    def one(batch: DataFrame, step: int) -> None:
        if 0 <= max_steps <= step:
            return
        append_once(measure(batch).select(F.col("train_loss").cast("double").alias("train_loss")), f"{folder}/steps", step)
        if step > 0 and step % every == 0:
            before = metrics(spark, f"{folder}/evaluations", EVALUATED).where(F.col("step") < step).agg(F.min("test_loss").alias("before"))
            now = evaluate(step).crossJoin(before)  # one row each
            saved = F.col("before").isNull() | (F.col("test_loss") < F.col("before"))
            append_once(now.select("train_loss", "test_loss", F.least("test_loss", "before").alias("best"), saved.alias("saved")), f"{folder}/evaluations", step)

    return batches.writeStream.foreachBatch(one).option("checkpointLocation", f"{folder}/state").start()


def resume_point(spark: SparkSession, folder: str) -> DataFrame:
    """One row: step, after the last evaluation that was saved, and best_loss; nulls for a run without one."""
    saved = metrics(spark, f"{folder}/evaluations", EVALUATED).where("saved")
    return saved.agg((F.max("step") + 1).alias("step"), F.min("test_loss").alias("best_loss"))
