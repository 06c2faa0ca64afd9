"""Streams against tables: pen capture, endless draws, training runs that are stopped and started again."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from penlake.operators import scan, training
from penlake.plans import collect
from penlake.streaming import capture
from penlake.streaming import training as runs

SF = "/root/testdata/sf0.001"
EVENT = "pen_id long, t long, kind string, x double, y double"


def brute_capture(events, interval=capture.INTERVAL):
    """The page's own rules, pen by pen."""
    out = {}
    for pen in {e[0] for e in events}:
        strokes, now, kept = [], [], None
        for _, _, kind, x, y in sorted((e for e in events if e[0] == pen), key=lambda e: e[1]):
            if kind in ("lift", "leave"):
                if now:
                    strokes.append([*now, (*now[-1][:2], 0)])
                now, kept = [], None
            elif x is None or y is None:
                continue
            elif kind == "press":
                now, kept = [(x, y, 1)], (x, y)
            elif kind == "move" and now and ((x - kept[0]) ** 2 + (y - kept[1]) ** 2) ** 0.5 >= interval:
                now.append((x, y, 1))
                kept = (x, y)
        out[pen] = [(i + 1, *p) for i, s in enumerate(strokes) for p in s]
    return {(pen, s, k + 1, x, y, p) for pen, rows in out.items() for k, (s, x, y, p) in enumerate(rows)}


def some_events(n, seed=1):
    rng = random.Random(seed)
    kinds = ["press", "move", "move", "move", "lift", "leave", "hover", None]
    place = lambda: rng.choice([None, *(float(i) for i in range(9))])
    return [(rng.randrange(4) if i % 3 else 0, i, rng.choice(kinds), place(), place()) for i in range(n)]


def test_capture_state_machine(spark):
    events = some_events(2000)
    got = capture.capture(spark.createDataFrame(events, EVENT).repartition(7), "pen_id", ["t"])
    assert set(map(tuple, got.collect())) == brute_capture(events) and got.count() > 300
    assert capture.capture(spark.createDataFrame([], EVENT), "pen_id", ["t"]).count() == 0


def test_entries_need_author_text_and_a_stroke(spark):
    drawn = spark.createDataFrame([(k, 1, p, 3.0, 4.0, pen) for k in (1, 2, 3) for p, pen in ((1, 1), (2, 0))], "pen_id long, stroke long, pos long, x double, y double, pen long")
    forms = spark.createDataFrame([(1, " \tann\n", "a b "), (2, " ", "x"), (3, "bo", None), (4, "cy", "z")], "pen_id long, author string, ascii string")
    rows = capture.entries(drawn, forms, "pen_id", 6.0, 8.0).collect()
    assert [(r.pen_id, tuple(r.metadata), r.points) for r in rows] == [(1, ("ann", "a b", 2, 1, 0.75), [[0.5, 0.5, 1.0], [0.5, 0.5, 0.0]])]


def feed(spark, folder, rows, schema, name):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/{name}")


def until_done(query):
    assert query.awaitTermination(180)


def test_capture_stream_over_restarts(spark, tmp_path):
    """Events come in three files; the stream is stopped and started between them, in the middle of strokes."""
    events, got = some_events(600, 2), f"{tmp_path}/out"
    for part in range(3):
        feed(spark, tmp_path, events[200 * part : 200 * part + 200], EVENT, "in")
        stream = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        out = capture.capture_stream(stream, "pen_id", ["t"]).writeStream.option("checkpointLocation", f"{tmp_path}/state")
        until_done(out.trigger(availableNow=True).format("parquet").start(got))
    assert set(map(tuple, spark.read.parquet(got).collect())) == brute_capture(events)


def test_best_stream(spark, tmp_path):
    rng = random.Random(5)
    log = [(run, step, float(rng.randrange(100))) for step in range(10, 130, 10) for run in (1, 2)]
    schema, saved = "run long, step long, test_loss double", []
    for part in range(3):
        # A resumed run repeats its last steps.
        feed(spark, tmp_path, log[max(0, 8 * part - 4) : 8 * part + 8], schema, "in")
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        out = runs.best_stream(stream, "run").writeStream.option("checkpointLocation", f"{tmp_path}/state")
        until_done(out.trigger(availableNow=True).format("parquet").start(f"{tmp_path}/out"))
    best = {}
    for run, step, loss in log:
        before = best.get(run, float("inf"))
        best[run] = min(before, loss)
        saved.append((run, step, loss, best[run], loss < before))
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").collect())) == sorted(saved)


def test_draws_are_those_of_the_table(spark, tmp_path):
    bank = spark.createDataFrame([(i, f"w{i}") for i in range(9)], "k long, word string")
    query = runs.endless(spark, bank, "word", "k", 50).writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/state")
    for _ in range(2):
        until_done(query.trigger(availableNow=True).start(f"{tmp_path}/out"))
    got = spark.read.parquet(f"{tmp_path}/out")
    n = got.count()
    assert n >= 50 and n % 50 == 0
    want = training.sampled(spark.range(n).toDF("draw"), "draw", bank, "word", "k").select("draw", "word")
    assert set(map(tuple, got.select("draw", "word").collect())) == set(map(tuple, want.collect()))


@pytest.mark.parametrize("stops", [[12], [5, 9, 12]])
def test_training_run(spark, tmp_path, stops):
    """Twelve steps, evaluated every three, give the same metrics however often the run is stopped."""
    test = [9.0, 5.0, 7.0, 5.0]
    folder, schema = f"{tmp_path}/run", "step long, loss double"
    losses = [(k, float(k)) for k in range(12)]
    evaluate = lambda step: spark.createDataFrame([(0.5, test[step // 3])], "train_loss double, test_loss double")
    done = 0
    for stop in stops:
        for row in losses[done:stop]:
            feed(spark, tmp_path, [row], schema, "in")
        done = stop
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        query = runs.train(stream, lambda b: b.agg(F.avg("loss").alias("train_loss")), evaluate, folder, 3, max_steps=11)
        query.processAllAvailable()
        query.stop()
    steps = runs.metrics(spark, f"{folder}/steps", "train_loss double").orderBy("step").collect()
    assert [r.step for r in steps] == list(range(11)) and {r.train_loss for r in steps} <= {x for _, x in losses}
    evaluated = [tuple(r) for r in runs.metrics(spark, f"{folder}/evaluations", runs.EVALUATED).select("step", "test_loss", "best", "saved").orderBy("step").collect()]
    assert evaluated == [(3, 5.0, 5.0, True), (6, 7.0, 5.0, False), (9, 5.0, 5.0, False)]
    assert tuple(runs.resume_point(spark, folder).first()) == (4, 5.0)


def test_a_step_that_is_run_again_counts_once(spark, tmp_path):
    rows = spark.createDataFrame([(1.0,)], "train_loss double")
    assert runs.metrics(spark, f"{tmp_path}/m", "train_loss double").count() == 0
    assert tuple(runs.resume_point(spark, str(tmp_path)).first()) == (None, None)
    for step in (0, 1, 1, 1):
        runs.append_once(rows, f"{tmp_path}/m", step)
    assert sorted(r.step for r in runs.metrics(spark, f"{tmp_path}/m", "train_loss double").collect()) == [0, 1]


def test_evaluations_of_incomplete_steps(spark):
    rows = [(1, 10, "train", 0, 1.0), (1, 10, "test", 0, 2.0), (1, 10, "test", 1, 4.0), (1, 10, "test", 1, 6.0), (1, 10, "test", 11, 99.0), (1, 20, "train", 0, 1.0), (1, 0, "test", 0, 1.0), (1, 0, "train", 0, 1.0), (1, 15, "test", 0, 1.0)]
    got = runs.evaluations(spark.createDataFrame(rows, "run long, step long, side string, batch long, loss double"), "run", 10).collect()
    assert [(r.step, r.train_loss, r.test_loss, r.saved) for r in got] == [(10, 1.0, 3.5, True)]


def test_scan_keeps_state_over_batches(spark):
    """A hot key with more rows than an Arrow batch, keys that follow one another, nulls as keys."""
    rows = [(1, i) for i in range(25_000)] + [(2, 5), (2, 3), (None, 7)]
    df = spark.createDataFrame(rows, "k long, v long").repartition(5)
    step = lambda s, r: (s + r[0], [(r[0], s + r[0])])
    got = {}
    for r in scan.ordered_scan(df, ["k"], ["v"], ["v"], lambda: 0, step, "v long, total long").collect():
        got.setdefault(r.k, []).append((r.v, r.total))
    assert got[2] == [(3, 3), (5, 8)] and got[None] == [(7, 7)]
    assert [t for _, t in sorted(got[1])][-1] == sum(range(25_000)) and len(got[1]) == 25_000


@pytest.mark.parametrize("n, ranges", [(0, 4), (1, 4), (2, 1), (1000, 3), (1000, 37), (300, 300)])
def test_dense_index(spark, n, ranges):
    keys = random.Random(n).sample(range(-5 * n, 5 * n), n) if n else []
    df = spark.createDataFrame([(k, k % 3) for k in keys], "k long, g long").repartition(3)
    assert sorted((r.k, r.ix) for r in scan.dense_index(df, "k", ranges=ranges).collect()) == [(k, i) for i, k in enumerate(sorted(keys))]
    grouped = scan.dense_index(df, "k", by=["g"], ranges=ranges).collect()
    for g in range(3):
        assert sorted((r.k, r.ix) for r in grouped if r.g == g) == [(k, i) for i, k in enumerate(sorted(k for k in keys if k % 3 == g))]


def test_capture_of_the_table(spark):
    e = collect.pen_events(spark, SF)
    rows = [(r.pen_id, (r.ts, r.event_id), r.kind, r.x, r.y) for r in e.collect()]
    assert set(map(tuple, capture.capture(e, "pen_id", ["ts", "event_id"]).collect())) == brute_capture(rows)
