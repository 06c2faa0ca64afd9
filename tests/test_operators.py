"""Operators against plain Python on small rows, and the sources and streams."""

import json
import math
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from penlake.functions import codec
from penlake.operators import attention, corpus, raster, sampling, sequence
from penlake.sources import records
from penlake.streaming import metrics

RECORDS = [
    {"metadata": {"author": "a", "asciiSequence": "hi", "pointCount": 3, "strokeCount": 1, "aspectRatio": 2.0}, "points": [[0.5, 0.75, 1], [0.75, 0.5, 1], [1.0, 0.25, 0]]},
    {"metadata": {"author": "b", "asciiSequence": "yo", "pointCount": 0, "strokeCount": 0, "aspectRatio": 1.0}, "points": []},
]


def line(spark, n, item=1, pen=lambda i: 1):
    return spark.createDataFrame([(item, i + 1, float(i), float(i * i % 7), pen(i)) for i in range(n)], "item_id long, pos long, x double, y double, pen long")


@pytest.mark.parametrize("n", [1, 2, 3, 7, 50, 67])
@pytest.mark.parametrize("fraction", [0.0, 0.3, 0.625, 0.99])
def test_even_spacing_is_linspace(spark, n, fraction):
    want = np.linspace(0, n - 1, int(n * (1 - fraction)), dtype=int) + 1
    got = [r.pos for r in sequence.downsample_whole(line(spark, n), fraction).orderBy("pos").collect()]
    assert got == sorted(set(want.tolist()))


def test_fraction_bounds(spark):
    assert sequence.downsample_whole(line(spark, 5), 1).count() == 5
    with pytest.raises(ValueError):
        sequence.downsample_whole(line(spark, 5), 1.5)


def test_random_removal_spares_the_ends(spark):
    p = line(spark, 200).unionByName(line(spark, 1, item=2))
    kept = sampling.remove_random(p, 0.5).select("item_id", "pos").collect()
    assert {r.pos for r in kept if r.item_id == 1} >= {1, 200}
    assert sum(r.item_id == 2 for r in kept) == 1
    assert 100 <= len(kept) <= 201
    again = sampling.remove_random(p.repartition(7), 0.5).select("item_id", "pos").collect()
    assert sorted(kept) == sorted(again)


def test_made_up_words(spark):
    rows = sampling.made_up_words(spark.range(4000).toDF("k"), "k").collect()
    words = [r.word for r in rows]
    assert len(rows) == 4000 and all(words)
    digits = np.mean([any(c.isdigit() for c in w) for w in words])
    assert 0.2 < digits < 0.3
    assert max(map(len, words)) <= sampling.LONGEST + 3
    assert sampling.made_up_words(spark.range(0).toDF("k"), "k").count() == 0


def test_metadata_of_a_flat_line(spark):
    flat = spark.createDataFrame([(1, 1, 0.0, 1.0, 1), (1, 2, 3.0, 1.0, 0)], "item_id long, pos long, x double, y double, pen long")
    assert tuple(sequence.metadata(flat).first()) == (1, 2, 1, None)


def test_greedy_walk_keeps_to_neighbours():
    xy = raster.order_points(np.array([[0, 0], [0, 1], [5, 5], [1, 1]]))
    assert xy.tolist() == [[0, 0], [0, 1], [1, 1], [5, 5]]
    assert raster.order_points(np.zeros((0, 2))).shape == (0, 2)


def test_smoothing_keeps_parabolas(spark):
    rows = [(1, i, float(i), float(i * i), 1) for i in range(12)]
    df = spark.createDataFrame(rows, "item_id long, pos long, x double, y double, pen long")
    got = lambda n, **k: [r.y for r in raster.smooth(df.where(df.pos < n), **k).orderBy("pos").collect()]
    assert np.allclose(got(12, window=5), [r[3] for r in rows])
    # An even window has its middle between two points; the two points at either end aren't moved.
    assert np.allclose(got(12), [0, 1, *((i + 0.5) ** 2 for i in range(2, 10)), 100, 121])
    assert np.allclose(got(5), [0, 1, 2.5**2, 9, 16]) and got(4) == [0, 1, 4, 9] and got(0) == []


def test_cross_entropy(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0], 2), ([1000.0, 0.0], 0)], "v array<double>, t int")
    got = [r[0] for r in df.select(corpus.cross_entropy(df.v, df.t)).collect()]
    want = -np.log(np.exp(3) / np.exp([1, 2, 3]).sum())
    assert np.allclose(got, [want, 0.0])


@pytest.mark.parametrize("zipped", [False, True])
def test_records(spark, tmp_path, zipped):
    path = tmp_path / ("bank.json.zip" if zipped else "bank.json")
    if zipped:
        with zipfile.ZipFile(path, "w") as z:
            z.writestr("bank.json", json.dumps(RECORDS))
            z.writestr("other.json", "[]")
    else:
        path.write_text(json.dumps(RECORDS))
    read = (records.read_json_zip if zipped else records.read_json)(spark, str(path))
    got = {r.metadata.author: r for r in records.normalised(read).collect()}
    assert set(got) == {"a", "b"}
    assert got["a"].metadata.strokeCount == 1
    assert [(round(p.x, 6), round(p.y, 6), p.pen) for p in got["a"].points] == [(0.0, 0.1, 1), (0.5, -0.15, 1), (1.0, -0.4, 0)]
    assert got["b"].points == []


def test_records_go_out_and_come_back(spark, tmp_path):
    (tmp_path / "in.json").write_text(json.dumps(RECORDS))
    df = records.read_json(spark, str(tmp_path / "in.json"))
    records.write_json(df, str(tmp_path / "out"))
    assert sorted(map(str, records.read_json(spark, str(tmp_path / "out"), lines=True).collect())) == sorted(map(str, df.collect()))
    bank = spark.createDataFrame([("b",), ('a"',)], "word string")
    assert records.js_word_bank(bank).first()[0] == 'const words = ["a\\"","b"];'


def run_stream(df, folder):
    """What a stream that reads all there is and ends has given out."""
    query = df.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start(f"{folder}/out")
    assert query.awaitTermination(120)
    return set(map(tuple, df.sparkSession.read.parquet(f"{folder}/out").collect()))


def test_streams_give_what_tables_give(spark, tmp_path):
    path = "/root/testdata/sf0.001/events.parquet"
    events = spark.read.parquet(path)
    stream = metrics.event_stream(spark, path + "*", events.schema)
    days = lambda e: metrics.window_losses(e).selectExpr("cast(window.start AS timestamp) AS day", "event_type", "n")
    want = set(map(tuple, days(events).collect()))
    last = max(day for day, *_ in want)
    # Windows that the watermark hasn't passed stay open.
    assert run_stream(days(stream), tmp_path / "days") == {w for w in want if w[0] < last}
    runs = lambda e: metrics.sessions(e).selectExpr("user_id", "n_points", "cast(first_ts AS timestamp) AS first_ts")
    closed, all_runs = run_stream(runs(stream), tmp_path / "runs"), set(map(tuple, runs(events).collect()))
    assert closed and closed <= all_runs


def test_prompts_and_filled_lists(spark):
    bank = spark.createDataFrame([(10 * i, w) for i, w in enumerate(("a", "b", "c"))], "k long, word string")
    asked = spark.range(300).toDF("q")
    rows = sampling.prompts(asked, "q", bank, "word", "k", 4).collect()
    assert len(rows) == 300 and all(len(r.prompt.split()) == 4 and set(r.prompt.split()) <= set("abc") for r in rows)
    assert len({r.prompt for r in rows}) > 50  # of 81
    again = sampling.prompts(asked.repartition(5), "q", bank, "word", "k", 4).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, rows))
    assert sampling.prompts(asked, "q", bank.limit(0), "word", "k", 4).count() == 0
    lists = spark.createDataFrame([(i, ["x"] * (i % 8)) for i in range(400)], "q long, w array<string>")
    got = {r.q: r.w for r in lists.select("q", sampling.filled(lists.w, 6, lists.q).alias("w")).collect()}
    assert all(len(w) == max(5, q % 8) and w[: q % 8] == ["x"] * (q % 8) for q, w in got.items())
    more = [x for q, w in got.items() for x in w[q % 8 :]]
    assert "the" in more and all(x == "the" or len(x) == 1 and x.strip() for x in more)


def test_only_one_author(spark):
    rows = [(1, 1, "a", "ann"), (1, 2, "b", "ann"), (2, 1, "c", None)]
    schema = "k long, i long, t string, author string"
    got = corpus.combine_one_author(spark.createDataFrame(rows, schema), "k", "i", "t", "author").collect()
    assert sorted(map(tuple, got)) == [(1, "ann", "a b", 2), (2, None, "c", 1)]
    with pytest.raises(Exception, match="more than one author: 1"):
        corpus.combine_one_author(spark.createDataFrame([*rows, (1, 3, "d", "bo")], schema), "k", "i", "t", "author").collect()


def test_banks_are_split_alike(spark):
    banks = {"short": spark.range(0, 400, 2).toDF("k"), "long": spark.range(1000, 1900).toDF("k")}
    rows = corpus.split_banks(banks, "k").collect()
    assert sorted(r.k for r in rows if r.bank == "long") == list(range(1000, 1200))
    tests = {b: {r.k for r in rows if r.bank == b and r.is_test} for b in banks}
    assert len(tests["short"]) == 20 and {1000 + k // 2 for k in tests["short"]} == tests["long"]
    assert corpus.split_banks({"a": banks["short"], "b": banks["long"].limit(0)}, "k").count() == 0


def test_missing_keys_and_pages(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(1, 5, 2.0), (2, 6, None)], "k long, v long, box double")
    new = {"v": (F.col("v") * F.col("box")).cast("long")}
    assert sorted(map(tuple, corpus.where_known(df, "box", new).collect())) == [(1, 10, 2.0)]
    assert sorted(map(tuple, corpus.where_known(df, "box", new, keep=True).collect()), key=str) == [(1, 10, 2.0), (2, 6, None)]
    pages = spark.createDataFrame([(10 * i,) for i in range(7)], "p long")
    for start, end in ((0, 3), (5, 50), (7, 9), (3, 3)):
        assert sorted((r.page, r.p) for r in corpus.page_range(pages, "p", start, end).collect()) == [(i + 1, 10 * i) for i in range(start, min(7, end))]


def test_latest_of_a_kind_and_short_texts(spark):
    rows = [("r", "model", "m:v2"), ("r", "model", "m:v10"), ("r", "data", "d:v99")]
    df = spark.createDataFrame(rows, "run string, kind string, name string")
    assert [r.latest for r in corpus.latest(df, "run", "name", kind="model").collect()] == ["m:v10"]
    texts = spark.createDataFrame([((t,), []) for t in ("ab", "abc", None)], "metadata struct<asciiSequence:string>, points array<array<double>>")
    assert [r.metadata.asciiSequence for r in records.long_enough(texts).collect()] == ["abc"]


def test_strides_and_warmup(spark):
    weights = attention.causal_weights(line(spark, 12), 9, heads=2)
    sums = {(r.head, r.target): r["sum(weight)"] for r in weights.groupBy("head", "target").sum("weight").collect()}
    assert len(sums) == 18 and np.allclose(list(sums.values()), 1)
    shown = attention.strided(weights, 9, 3).where("head = 0").select("target", "source").collect()
    assert {tuple(r) for r in shown} == {(t, s) for t in (2, 5, 8) for s in (2, 5, 8) if s <= t}
    w = spark.createDataFrame([(k, 1, s, 1.0) for k in (1, 2) for s in range(1, 15)], "item_id long, pos long, source long, weight double")
    texts = spark.createDataFrame([(1, "the cat sat"), (2, "cat")], "item_id long, text string")
    read = lambda **k: {i: "".join(r.ch for r in sorted(attention.drop_warmup(w, texts, **k).where(f"item_id = {i}").collect(), key=lambda r: r.source)) for i in (1, 2)}
    assert read() == {1: "the cat sat"[4:7], 2: "cat"} and read(tail=True) == {1: "cat sat", 2: "cat"}


@pytest.mark.parametrize("tokens", [[], [7], [codec.WORD], [codec.WORD, codec.WORD], [5, 6, codec.WORD, codec.WORD, 7, 8, codec.WORD, codec.WORD, codec.WORD, 9]])
def test_word_parts(spark, tokens):
    want, part = [], []
    for t in tokens:
        if part and part[-1] == t == codec.WORD:
            want.append(part)
            part = []
        part.append(t)
    want += [part] if part else []
    df = spark.createDataFrame([(tokens,)], "t array<int>")
    assert df.select(codec.split_words(df.t)).first()[0] == want


def test_lines_of_words(spark):
    rng = np.random.default_rng(3)
    words = {k: ["x" * int(n) for n in rng.integers(0, 14, 60)] for k in range(3)}
    df = spark.createDataFrame([(k, i, w) for k, ws in words.items() for i, w in enumerate(ws)], "doc long, i int, w string").repartition(4)
    got = {(r.doc, r.i): r.line for r in sequence.wrapped(df, ["doc"], "i", "w", 30).collect()}
    for k, ws in words.items():
        at, line = 0, 0
        for i, w in enumerate(ws):
            if at + len(w) + 1 > 30:
                at, line = 0, line + 1
            at += len(w) + 1
            assert got[k, i] == line


def test_responses_and_transcripts(spark):
    raw = [(1, '[{"text": "a", "box_2d": [1, 2.5, 3, 4]}, {"text": "b"}]'), (2, '[{"text": "a", "box_2d": [1'), (3, "no JSON"), (4, None), (5, "[]"), (6, '{"text": "c", "box_2d": [1, 2, 3, 4]}')]
    got = {(r.page, r.pos): (r.text, r.box) for r in records.boxes(spark.createDataFrame(raw, "page long, raw string")).collect()}
    assert got[1, 0] == ("a", [1.0, 2.5, 3.0, 4.0]) and got[1, 1] == ("b", None) and not {k for k, _ in got} & {2, 3, 4, 5}
    texts = spark.createDataFrame([(1, "  a\tb\n\nc "), (2, " \n"), (3, None), (4, "")], "page long, text string")
    assert sorted(map(tuple, records.transcript_words(texts).collect())) == [(1, 0, "a"), (1, 1, "b"), (1, 2, "c")]


def test_cut_codes_read_only_what_they_keep(spark):
    """Ids that are cut to a length come from that many characters; the whole text isn't split for them."""
    text = "ab#" + "e" * 100
    df = spark.createDataFrame([(text,), ("",), ("é😀n" * 30,)], "text string")
    got = [r[0] for r in df.select(codec.encode_text(F.col("text"), 5).alias("ids")).collect()]
    whole = [r[0] for r in df.select(codec.encode_whole(F.col("text")).alias("ids")).collect()]
    assert got == [(w + [0] * 5)[:5] for w in whole]
    plan = df.select(codec.encode_text(F.col("text"), 5))._jdf.queryExecution().optimizedPlan().toString()
    assert "substring(text" in plan and "split(text" not in plan
    assert [r[0] for r in df.select(codec.decode_text(codec.encode_whole(F.col("text")))).collect()] == ["ab", "", ""]


def test_weights_need_no_window(spark):
    """Weights are worked out in a row: no window holds or sorts the pairs, and they are those of a softmax."""
    rows = [(k, i, ((i * 7 + k) % 5) / 3, (i % 4) / 2) for k in (1, 2) for i in range(1, 8)]
    p = spark.createDataFrame(rows, "item_id long, pos long, x double, y double")
    c = p.where("pos <= 3").select("item_id", F.col("pos").alias("source"), F.col("x").alias("kx"), F.col("y").alias("ky"))
    whole, causal = corpus.cross_attention(p, c, "item_id"), attention.causal_weights(p, 5, heads=2)
    for df in (whole, causal):
        assert "Window" not in df._jdf.queryExecution().optimizedPlan().toString()
    at = {(k, i): (x, y) for k, i, x, y in rows}

    def share(k, t, s, sources, head=0):
        e = {j: math.exp((at[k, t][0] * at[k, j][0] + at[k, t][1] * at[k, j][1]) * (head + 1)) for j in sources}
        return e[s] / sum(e.values())

    got = {(r["item_id"], r["pos"], r["source"]): r["weight"] for r in whole.collect()}
    assert got == pytest.approx({(k, t, s): share(k, t, s, (1, 2, 3)) for k, t in at for s in (1, 2, 3)})
    got = {(r["item_id"], r["head"], r["target"], r["source"]): r["weight"] for r in causal.collect()}
    assert got == pytest.approx({(k, h, t, s): share(k, t, s, range(1, t + 1), h) for k in (1, 2) for h in (0, 1) for t in range(1, 6) for s in range(1, t + 1)})


def test_a_draw_is_worked_out_once(spark):
    """A weighted pick evaluates its uniform once, not for every weight: the plan's filter holds no hash."""
    df = spark.range(50).select(sampling.pick(sampling.uniform(3, F.col("id")), sampling.LETTER_WEIGHTS).alias("i"), sampling.uniform(3, F.col("id")).alias("u"))
    assert all(r["i"] == sum(s <= r["u"] for s in sampling.steps(sampling.LETTER_WEIGHTS)) for r in df.collect())
    plan = spark.range(1).select(sampling.pick(sampling.uniform(3, F.col("id")), sampling.LETTER_WEIGHTS).alias("i"))._jdf.queryExecution().optimizedPlan().toString()
    shown = next(x for x in plan.splitlines() if "size(filter(" in x)
    assert "md5" not in shown.split("size(filter(", 1)[1]
