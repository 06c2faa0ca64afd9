"""The registered queries over the point, word and metric operators, each with the same result in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from penlake.functions import codec, geometry
from penlake.operators import corpus, raster, sampling, sequence
from penlake.sources.adapters import points, table, words
from penlake.streaming import metrics

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

PTS = """points AS (SELECT user_id AS item_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos, value / 2000 AS x,
  CAST(json_extract_string(props, '$.k') AS DOUBLE) / 1000 AS y, CAST(CASE WHEN event_type = 'error' THEN 0 ELSE 1 END AS BIGINT) AS pen FROM events)"""
OFFS = PTS + """, offs AS (SELECT *, coalesce(x - lag(x) OVER w, 0.0) AS dx, coalesce(y - lag(y) OVER w, 0.0) AS dy FROM points WINDOW w AS (PARTITION BY item_id ORDER BY pos))"""
POLAR = OFFS + ", polar AS (SELECT *, sqrt(dx * dx + dy * dy) AS r, atan2(dy, dx) AS theta FROM offs)"
T_EDGES = "[" + ", ".join(f"{e!r}::double" for e in codec.THETA_EDGES) + "]"
R_EDGES = "[" + ", ".join(f"{e!r}::double" for e in codec.R_EDGES) + "]"
TOKENS = POLAR + f""", tok AS (SELECT item_id, pos, {codec.FIRST_THETA} + len(list_filter({T_EDGES}, lambda e: e <= theta)) - 1 AS t,
  len(list_filter({R_EDGES}, lambda e: e <= r)) - 1 + CASE WHEN pen = 1 THEN 0 ELSE {codec.N_R} END AS d FROM polar)"""
WORDS = "words AS (SELECT doc_id, unnest(string_split(text, ' ')) AS word FROM documents WHERE text IS NOT NULL)"


def uniform_sql(*key: str) -> str:
    return "(('0x' || substr(md5(" + " || ':' || ".join(key) + "), 1, 8))::bigint / 4294967296::double)"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def long(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("bigint")


def r6(c: str) -> Column:
    return F.round(c, 6).alias(c)


@query("WITH c AS (SELECT unnest(string_split(text, '')) AS ch FROM documents), h AS (SELECT ch, count(*) AS n FROM c WHERE ch <> '' GROUP BY ch) SELECT ch, n, round(n / sum(n) OVER (), 6) AS share FROM h")
def q01_char_histogram(s: SparkSession, d: str) -> DataFrame:
    return corpus.char_histogram(table(s, d, "documents")).orderBy(F.desc("n"), "ch")


@query("WITH c AS (SELECT unnest(string_split(text, '')) AS ch FROM documents), h AS (SELECT ch, count(*) AS n FROM c WHERE ch <> '' GROUP BY ch) SELECT string_agg(ch, '' ORDER BY n DESC, encode(ch)) AS alphabet FROM h")
def q01b_alphabet(s: SparkSession, d: str) -> DataFrame:
    return corpus.alphabet(corpus.char_histogram(table(s, d, "documents")))


@query(f"WITH {WORDS} SELECT word, count(*) AS n FROM words WHERE NOT regexp_matches(word, '[ijtx]') GROUP BY word")
def q02_easy_words(s: SparkSession, d: str) -> DataFrame:
    return corpus.word_partition(words(s, d))[0].groupBy("word").agg(F.count("*").alias("n"))


@query(f"WITH {WORDS} SELECT word, count(*) AS n FROM words WHERE regexp_matches(word, '[ijtx]') GROUP BY word")
def q03_redo_words(s: SparkSession, d: str) -> DataFrame:
    return corpus.word_partition(words(s, d))[1].groupBy("word").agg(F.count("*").alias("n"))


@query(f"WITH {PTS} SELECT item_id, pos, round(x * 6.0::double - first_value(x * 6.0::double) OVER (PARTITION BY item_id ORDER BY pos), 6) AS x, round(y - 0.65::double, 6) AS y, pen FROM points")
def q04_normalise_points(s: SparkSession, d: str) -> DataFrame:
    return sequence.normalise(points(s, d), 6.0).select("item_id", "pos", r6("x"), r6("y"), "pen")


@query(f"WITH {OFFS} SELECT item_id, pos, round(dx, 6) AS dx, round(dy, 6) AS dy, pen FROM offs")
def q05_offsets(s: SparkSession, d: str) -> DataFrame:
    return sequence.offsets(points(s, d)).select("item_id", "pos", r6("dx"), r6("dy"), "pen")


@query(
    f"""WITH {PTS}, w AS (SELECT *, (pos - 1) // 8 AS word FROM points),
    e AS (SELECT *, min(x) OVER g AS lo, max(x) OVER g AS hi, row_number() OVER (PARTITION BY item_id, word ORDER BY pos) AS i FROM w WINDOW g AS (PARTITION BY item_id, word)),
    l AS (SELECT *, lag(x) OVER o AS px, lag(y) OVER o AS py, lag(hi) OVER o AS ph FROM e WINDOW o AS (PARTITION BY item_id ORDER BY pos))
    SELECT item_id, pos, round(coalesce(CASE WHEN i = 1 THEN (ph - px) + (x - lo) ELSE x - px END, 0.0), 6) AS dx, round(coalesce(y - py, 0.0), 6) AS dy FROM l"""
)
def q06_offsets_prev_word(s: SparkSession, d: str) -> DataFrame:
    p = points(s, d).withColumn("word", F.floor((F.col("pos") - 1) / 8))
    return sequence.offsets_after_word(p).select("item_id", "pos", r6("dx"), r6("dy"))


@query(f"WITH {POLAR} SELECT item_id, pos, round(r, 6) AS r, round(theta, 6) AS theta FROM polar")
def q07_polar(s: SparkSession, d: str) -> DataFrame:
    return sequence.to_polar(sequence.offsets(points(s, d))).select("item_id", "pos", r6("r"), r6("theta"))


def tokens(s: SparkSession, d: str) -> DataFrame:
    p = sequence.to_polar(sequence.offsets(points(s, d)))
    t, r = codec.tokens_of(F.col("r"), F.col("theta"), F.col("pen"))
    return p.select("item_id", "pos", t.alias("t"), r.alias("d"))


@query(f"WITH {TOKENS} SELECT item_id, pos, t::bigint AS theta_token, d::bigint AS r_token FROM tok")
def q08_tokens(s: SparkSession, d: str) -> DataFrame:
    return tokens(s, d).select("item_id", "pos", long("t").alias("theta_token"), long("d").alias("r_token"))


@query(
    f"""WITH {TOKENS} SELECT item_id, pos, round({R_EDGES}[(CASE WHEN d < {codec.N_R} THEN d ELSE d - {codec.N_R} END) + 1], 6) AS r,
    round({T_EDGES}[t - {codec.FIRST_THETA} + 1], 6) AS theta, (CASE WHEN d < {codec.N_R} THEN 1 ELSE 0 END)::bigint AS pen FROM tok"""
)
def q09_decode_tokens(s: SparkSession, d: str) -> DataFrame:
    r, theta, pen = codec.decode(F.col("t"), F.col("d"))
    return tokens(s, d).select("item_id", "pos", F.round(r, 6).alias("r"), F.round(theta, 6).alias("theta"), long(pen).alias("pen"))


@query(f"WITH {POLAR} SELECT item_id, pos, round(sum(r * cos(theta)) OVER w, 6) AS x, round(sum(r * sin(theta)) OVER w, 6) AS y FROM polar WINDOW w AS (PARTITION BY item_id ORDER BY pos)")
def q10_reconstruct(s: SparkSession, d: str) -> DataFrame:
    return sequence.reconstruct(sequence.to_polar(sequence.offsets(points(s, d)))).select("item_id", "pos", r6("x"), r6("y"))


@query(
    f"""WITH {PTS}, i AS (SELECT *, sum(1 - pen) OVER (PARTITION BY item_id ORDER BY pos) AS island FROM points)
    SELECT item_id, min(pos) AS first_pos, count(*) AS n_points, round(min(x), 6) AS min_x, round(max(x), 6) AS max_x, round(min(y), 6) AS min_y, round(max(y), 6) AS max_y FROM i WHERE pen = 1 GROUP BY item_id, island"""
)
def q11_strokes(s: SparkSession, d: str) -> DataFrame:
    return sequence.strokes(points(s, d)).select("item_id", "first_pos", "n_points", r6("min_x"), r6("max_x"), r6("min_y"), r6("max_y"))


@query("SELECT conv_id, string_agg(text, ' ' ORDER BY turn) AS ascii, sum(length(text))::bigint AS n_points, count(*) AS n_words FROM conversations GROUP BY conv_id")
def q12_combine(s: SparkSession, d: str) -> DataFrame:
    return corpus.combine(table(s, d, "conversations"), "conv_id", "turn", "text")


@query(
    """WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY md5('42:' || doc_id), doc_id) AS i, count(*) OVER () AS n FROM documents)
    SELECT doc_id, i <= least(1000, greatest(10, floor(0.05::double * n))) AS is_test FROM r"""
)
def q13_split(s: SparkSession, d: str) -> DataFrame:
    return corpus.split(table(s, d, "documents").select("doc_id"), "doc_id").select("doc_id", "is_test")


def _draw_sql() -> str:
    u = [f"floor({uniform_sql(chr(39) + '42' + chr(39), chr(39) + str(i) + chr(39), 'o_orderkey')} * (n - {i}))::bigint" for i in range(3)]
    return f"""WITH n AS (SELECT count(*) AS n FROM part), h AS (SELECT o_orderkey, n, {u[0]} AS a, {u[1]} AS h1, {u[2]} AS h2 FROM orders, n),
    b AS (SELECT *, (a + 1 + h1) % n AS b FROM h), c AS (SELECT *, ((b - a - 1) % n + n) % n AS gap FROM b),
    t AS (SELECT o_orderkey, a, b, (a + 1 + CASE WHEN h2 >= gap THEN h2 + 1 ELSE h2 END) % n AS c FROM c)
    SELECT o_orderkey, p.p_name || ' ' || q.p_name || ' ' || r.p_name AS ascii FROM t JOIN part p ON p.p_partkey = a JOIN part q ON q.p_partkey = b JOIN part r ON r.p_partkey = c"""


@query(_draw_sql())
def q14_combos(s: SparkSession, d: str) -> DataFrame:
    bank = table(s, d, "part").select("p_partkey", "p_name")
    draws = corpus.draw_three(F.col("o_orderkey"), bank.count())
    rows = table(s, d, "orders").select("o_orderkey", F.posexplode(F.array(*(long(x) for x in draws))).alias("pos", "ix"))
    return corpus.combine(rows.join(bank, F.col("p_partkey") == F.col("ix")), "o_orderkey", "pos", "p_name").select("o_orderkey", "ascii")


_IDS = f"list_transform(list_filter(string_split(text, ''), lambda c: c <> ''), lambda c: strpos('{codec.ALPHABET.replace(chr(39), chr(39) * 2)}', c))"
_FIXED = f"list_slice(list_concat({_IDS}, list_transform(range(50), lambda i: 0)), 1, 50)"


@query(f"SELECT doc_id, array_to_string({_FIXED}, ' ') AS ids FROM documents WHERE text IS NOT NULL")
def q15_encode_text(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").where("text is not null").select("doc_id", F.array_join(codec.encode_text(F.col("text")).cast("array<string>"), " ").alias("ids"))


@query(
    f"""WITH e AS (SELECT doc_id, {_FIXED} AS ids FROM documents WHERE text IS NOT NULL), k AS (SELECT doc_id, ids, coalesce(list_position(ids, 0), 0) AS z FROM e)
    SELECT doc_id, array_to_string(list_transform(list_slice(ids, 1, CASE WHEN z > 0 THEN z - 1 ELSE len(ids) END), lambda i: substr('{codec.ALPHABET.replace(chr(39), chr(39) * 2)}', i, 1)), '') AS text FROM k"""
)
def q16_decode_text(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").where("text is not null").select("doc_id", codec.decode_text(codec.encode_text(F.col("text"))).alias("text"))


@query(f"SELECT doc_id, array_to_string({_IDS}, ' ') AS ids FROM documents WHERE text IS NOT NULL")
def q15b_encode_whole_text(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").where("text is not null").select("doc_id", F.array_join(codec.encode_whole(F.col("text")).cast("array<string>"), " ").alias("ids"))


@query(
    f"""WITH e AS (SELECT doc_id, {_IDS} AS ids FROM documents WHERE text IS NOT NULL), k AS (SELECT doc_id, ids, coalesce(list_position(ids, 0), 0) AS z FROM e)
    SELECT doc_id, array_to_string(list_transform(list_slice(ids, 1, CASE WHEN z > 0 THEN z - 1 ELSE len(ids) END), lambda i: substr('{codec.ALPHABET.replace(chr(39), chr(39) * 2)}', i, 1)), '') AS text FROM k"""
)
def q16b_decode_whole_text(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").where("text is not null").select("doc_id", codec.decode_text(codec.encode_whole(F.col("text"))).alias("text"))


def token_arrays(s: SparkSession, d: str) -> DataFrame:
    parts = F.array_sort(F.collect_list(F.struct("pos", F.col("t").cast("int").alias("t"), F.col("d").cast("int").alias("d"))))
    return tokens(s, d).groupBy("item_id").agg(F.flatten(F.transform(parts, lambda p: F.array(p["t"], p["d"]))).alias("tokens"))


_ARR = f"{TOKENS}, arr AS (SELECT item_id, flatten(list([t, d] ORDER BY pos)) AS a FROM tok GROUP BY item_id)"


@query(
    f"""WITH {_ARR}, n AS (SELECT item_id, a, least(len(a), 99) AS n FROM arr), x AS (SELECT item_id, n, list_concat(list_slice(a, 1, n), [{codec.END}], list_transform(range(99 - n), lambda i: {codec.PAD})) AS x FROM n)
    SELECT item_id, array_to_string(x, ' ') AS x, array_to_string(list_concat(list_slice(x, 2, n + 1), [{codec.END}], list_transform(range(99 - n), lambda i: {codec.PAD})), ' ') AS y FROM x"""
)
def q17_shift_pad(s: SparkSession, d: str) -> DataFrame:
    x, y = codec.shifted(F.col("tokens"), 100)
    return token_arrays(s, d).select("item_id", F.array_join(x.cast("array<string>"), " ").alias("x"), F.array_join(y.cast("array<string>"), " ").alias("y"))


@query(
    f"""WITH {_ARR}, n AS (SELECT item_id, a, least(len(a), {codec.LONGEST - 1}) AS n FROM arr), x AS (SELECT item_id, n, list_concat(list_slice(a, 1, n), [{codec.END}], list_transform(range({codec.LONGEST - 1} - n), lambda i: {codec.PAD})) AS x FROM n)
    SELECT item_id, array_to_string(x, ' ') AS x, array_to_string(list_concat(list_slice(x, 2, n + 1), [{codec.END}], list_transform(range({codec.LONGEST - 1} - n), lambda i: {codec.PAD})), ' ') AS y FROM x"""
)
def q17b_shift_pad_long(s: SparkSession, d: str) -> DataFrame:
    x, y = codec.shifted(F.col("tokens"), codec.LONGEST)
    return token_arrays(s, d).select("item_id", F.array_join(x.cast("array<string>"), " ").alias("x"), F.array_join(y.cast("array<string>"), " ").alias("y"))


def marked(s: SparkSession, d: str) -> DataFrame:
    """Token arrays with WORD in place of pen-up distances and after them."""
    return token_arrays(s, d).withColumn("tokens", F.flatten(F.transform("tokens", lambda t: F.when(t.between(codec.N_R, codec.FIRST_THETA - 1), F.array(F.lit(codec.WORD), F.lit(codec.WORD))).otherwise(F.array(t)))))


_MARK = f"{TOKENS}, u AS (SELECT item_id, pos, unnest(CASE WHEN d >= {codec.N_R} THEN [t, {codec.WORD}, {codec.WORD}] ELSE [t, d] END) AS t, unnest(CASE WHEN d >= {codec.N_R} THEN [0, 1, 2] ELSE [0, 1] END) AS k FROM tok), "
_MARK += f"c AS (SELECT *, CASE WHEN t = {codec.WORD} AND lag(t) OVER w = {codec.WORD} THEN 1 ELSE 0 END AS cut FROM u WINDOW w AS (PARTITION BY item_id ORDER BY pos, k)), p AS (SELECT *, sum(cut) OVER (PARTITION BY item_id ORDER BY pos, k) AS part FROM c)"


@query(f"WITH {_MARK} SELECT item_id, part::bigint AS part, string_agg(t::varchar, ' ' ORDER BY pos, k) AS tokens FROM p GROUP BY item_id, part")
def q18_word_split(s: SparkSession, d: str) -> DataFrame:
    return marked(s, d).select("item_id", F.posexplode(codec.split_words(F.col("tokens"))).alias("part", "p")).select("item_id", long("part").alias("part"), F.array_join(F.col("p").cast("array<string>"), " ").alias("tokens"))


@query(f"WITH {_MARK}, g AS (SELECT item_id, part, string_agg(t::varchar, ' ' ORDER BY pos, k) AS s FROM p GROUP BY item_id, part) SELECT item_id, string_agg(s, ' {codec.WORD} {codec.WORD} ' ORDER BY part) AS tokens FROM g GROUP BY item_id")
def q19_word_concat(s: SparkSession, d: str) -> DataFrame:
    return marked(s, d).select("item_id", F.array_join(codec.join_words(codec.split_words(F.col("tokens"))).cast("array<string>"), " ").alias("tokens"))


@query(
    f"""WITH {PTS}, i AS (SELECT *, sum(1 - pen) OVER (PARTITION BY item_id ORDER BY pos) AS island FROM points),
    s AS (SELECT item_id, island, pen, count(*) AS n, list(pos ORDER BY pos) AS ps FROM i WHERE pen = 1 GROUP BY ALL),
    m AS (SELECT *, least(greatest(floor(n * 0.375::double)::bigint, 2), n) AS m FROM s),
    k AS (SELECT item_id, ps, n, m, unnest(range(m)) AS k FROM m)
    SELECT DISTINCT item_id, ps[(CASE WHEN k = m - 1 THEN n - 1 ELSE floor(k * ((n - 1) / (m - 1)::double))::bigint END) + 1] AS pos FROM k UNION ALL SELECT item_id, pos FROM points WHERE pen <> 1"""
)
def q20_downsample(s: SparkSession, d: str) -> DataFrame:
    return sequence.downsample(points(s, d), 0.625).select("item_id", "pos")


def _u(lo: float, hi: float, i: int) -> Column:
    return lo + (hi - lo) * geometry.uniform(7, i, F.col("item_id"))


def _u_sql(lo: float, hi: float, i: int) -> str:
    return f"({lo}::double + ({hi}::double - {lo}::double) * {uniform_sql(chr(39) + '7' + chr(39), chr(39) + str(i) + chr(39), 'item_id')})"


@query(f"WITH {PTS} SELECT item_id, pos, round((x + {_u_sql(-0.22, -0.18, 0)} * y) * {_u_sql(0.9, 1.1, 1)}, 6) AS x, round(y * {_u_sql(0.9, 1.1, 2)}, 6) AS y FROM points")
def q21_shear_scale(s: SparkSession, d: str) -> DataFrame:
    x = geometry.shear(F.col("x"), F.col("y"), _u(-0.22, -0.18, 0)) * _u(0.9, 1.1, 1)
    return points(s, d).select("item_id", "pos", F.round(x, 6).alias("x"), F.round(F.col("y") * _u(0.9, 1.1, 2), 6).alias("y"))


@query(f"WITH {PTS}, a AS (SELECT *, radians({_u_sql(-0.08, 0.08, 3)}) AS a FROM points) SELECT item_id, pos, round(x * cos(a) - y * sin(a), 6) AS x, round(x * sin(a) + y * cos(a), 6) AS y FROM a")
def q22_rotate(s: SparkSession, d: str) -> DataFrame:
    x, y = geometry.rotate(F.col("x"), F.col("y"), _u(-0.08, 0.08, 3))
    return points(s, d).select("item_id", "pos", F.round(x, 6).alias("x"), F.round(y, 6).alias("y"))


@query(f"WITH {PTS} SELECT item_id, pos, min(pen) OVER (PARTITION BY item_id ORDER BY pos ROWS 3 PRECEDING) AS pen FROM points")
def q23_pen_and(s: SparkSession, d: str) -> DataFrame:
    return sequence.pen_and(points(s, d)).select("item_id", "pos", "pen")


@query(
    f"""WITH RECURSIVE {PTS}, l(item_id, pos, x, y, nx) AS (SELECT item_id, pos, 0.0::double, 0.0::double, 0.0::double + x + 0.16::double FROM points WHERE pos = 1
    UNION ALL SELECT p.item_id, p.pos, CASE WHEN l.nx > 1.0 THEN 0.0 ELSE l.nx END, CASE WHEN l.nx > 1.0 THEN l.y + 0.55::double ELSE l.y END, (CASE WHEN l.nx > 1.0 THEN 0.0 ELSE l.nx END) + p.x + 0.16::double
    FROM l JOIN points p ON p.item_id = l.item_id AND p.pos = l.pos + 1) SELECT item_id, pos, round(x, 6) AS x, round(y, 6) AS y FROM l"""
)
def q24_layout(s: SparkSession, d: str) -> DataFrame:
    widths = points(s, d).select("item_id", "pos", F.col("x").alias("width"))
    return sequence.layout(widths, 0.16, 1.0, 0.55).select("item_id", "pos", r6("x"), r6("y"))


def logits(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))


_LOGITS = "v AS (SELECT vec_id, unnest(embedding)::double AS v, unnest(range(len(embedding))) AS i FROM embeddings)"


@query(f"WITH {_LOGITS}, r AS (SELECT *, rank() OVER (PARTITION BY vec_id ORDER BY v DESC) AS k FROM v) SELECT vec_id, i, round(v, 6) AS v FROM r WHERE k <= 5")
def q25_topk_mask(s: SparkSession, d: str) -> DataFrame:
    rows = logits(s, d).select("vec_id", F.posexplode(corpus.top_k_mask(F.col("v"), 5)).alias("i", "v"))
    return rows.where("v is not null").select("vec_id", long("i").alias("i"), r6("v"))


@query(f"WITH {_LOGITS}, m AS (SELECT *, max(v) OVER (PARTITION BY vec_id) AS m FROM v), e AS (SELECT vec_id, i, exp((v - m) / 0.7::double) AS e FROM m) SELECT vec_id, i, round(e / sum(e) OVER (PARTITION BY vec_id), 6) AS p FROM e")
def q26_softmax(s: SparkSession, d: str) -> DataFrame:
    rows = logits(s, d).select("vec_id", F.posexplode(corpus.softmax(F.col("v"), 0.7)).alias("i", "p"))
    return rows.select("vec_id", long("i").alias("i"), r6("p"))


@query(f"WITH {_LOGITS}, r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY v DESC, i) AS k FROM v) SELECT vec_id, i AS best FROM r WHERE k = 1")
def q27_argmax(s: SparkSession, d: str) -> DataFrame:
    return logits(s, d).select("vec_id", long(corpus.argmax(F.col("v"))).alias("best"))


@query(
    f"""WITH {_LOGITS}, m AS (SELECT *, max(v) OVER (PARTITION BY vec_id) AS m FROM v), e AS (SELECT vec_id, i, exp((v - m) / 0.7::double) AS e FROM m),
    c AS (SELECT vec_id, i, sum(e) OVER (PARTITION BY vec_id ORDER BY i) / sum(e) OVER (PARTITION BY vec_id) AS c, {uniform_sql("'11'", "vec_id")} AS u FROM e)
    SELECT vec_id, min(i) AS drawn FROM c WHERE round(c, 9) > round(u, 9) GROUP BY vec_id"""
)
def q28_sample_step(s: SparkSession, d: str) -> DataFrame:
    rows = logits(s, d).select("vec_id", F.posexplode(corpus.softmax(F.col("v"), 0.7)).alias("i", "p"))
    c = F.sum("p").over(Window.partitionBy("vec_id").orderBy("i").rowsBetween(Window.unboundedPreceding, 0))
    drawn = rows.withColumns({"c": c, "u": geometry.uniform(11, F.col("vec_id"))}).where("round(c, 9) > round(u, 9)")
    return drawn.groupBy("vec_id").agg(long(F.min("i")).alias("drawn"))


@query(
    f"""WITH {PTS}, b AS (SELECT item_id, pos, floor(x * 2000)::bigint AS v FROM points) SELECT item_id, pos, round(v / 1000.0::double * 1700, 6) AS px, floor(v * (1700 / 1000.0::double))::bigint AS px_whole,
    greatest(0, floor(v * (1700 / 1000.0::double))::bigint - 10) AS lo, least(1700, floor(v * (1700 / 1000.0::double))::bigint + 10) AS hi, round(least(1.0, greatest(0.0, v / 400.0::double)), 4) AS clamped FROM b"""
)
def q29_boxes(s: SparkSession, d: str) -> DataFrame:
    b = points(s, d).select("item_id", "pos", F.floor(F.col("x") * 2000).alias("v"))
    whole = long(geometry.scale_box(F.col("v"), 1700, whole=True))
    return b.select(
        "item_id", "pos", F.round(geometry.scale_box(F.col("v"), 1700), 6).alias("px"), whole.alias("px_whole"),
        long(F.greatest(F.lit(0), whole - 10)).alias("lo"), long(F.least(F.lit(1700), whole + 10)).alias("hi"),
        F.round(geometry.clamp(F.col("v") / 400.0, 0.0, 1.0), 4).alias("clamped"),
    )


@query(
    f"""WITH {PTS}, g AS (SELECT *, CASE WHEN greatest(abs(x - lag(x) OVER w), abs(y - lag(y) OVER w)) > 0.05::double THEN 1 ELSE 0 END AS far FROM points WINDOW w AS (PARTITION BY item_id ORDER BY pos))
    SELECT item_id, pos, sum(far) OVER (PARTITION BY item_id ORDER BY pos)::bigint AS stroke FROM g"""
)
def q30_stroke_breaks(s: SparkSession, d: str) -> DataFrame:
    return sequence.breaks(points(s, d), 0.05).select("item_id", "pos", long("stroke").alias("stroke"))


def _segments(mode: str, test: str) -> None:
    sql = f"""WITH {PTS}, n AS (SELECT *, lead(x) OVER w AS x1, lead(y) OVER w AS y1, lead(pen) OVER w AS pen1 FROM points WINDOW w AS (PARTITION BY item_id ORDER BY pos))
    SELECT item_id, pos, round(x, 6) AS x, round(y, 6) AS y, round(x1, 6) AS x1, round(y1, 6) AS y1 FROM n WHERE x1 IS NOT NULL AND {test}"""

    def run(s: SparkSession, d: str) -> DataFrame:
        return sequence.segments(points(s, d), mode).select("item_id", "pos", r6("x"), r6("y"), r6("x1"), r6("y1"))

    QUERIES[f"q31_segments_{mode}"], ORACLES[f"q31_segments_{mode}"] = run, sql


for _mode, _test in (("end", "pen1 = 1"), ("start", "pen = 1"), ("both", "pen = 1 AND pen1 = 1")):
    _segments(_mode, _test)


@query("SELECT page_id, url, quality::bigint AS quality FROM pages JOIN labels ON page_id = doc_id")
def q32_page_transcripts(s: SparkSession, d: str) -> DataFrame:
    pages = table(s, d, "pages").select("page_id", "url")
    return pages.join(table(s, d, "labels").select(F.col("doc_id").alias("page_id"), long("quality").alias("quality")), "page_id")


@query("SELECT page_id, url FROM pages WHERE NOT EXISTS (SELECT 1 FROM labels WHERE doc_id = page_id)")
def q33_pages_missing(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "pages").select("page_id", "url").join(table(s, d, "labels").select(F.col("doc_id").alias("page_id")), "page_id", "left_anti")


@query(f"WITH {PTS} SELECT item_id, pos, round(CASE WHEN pos % 3 = 0 THEN x * 2 ELSE x END, 6) AS x FROM points")
def q34_regenerate(s: SparkSession, d: str) -> DataFrame:
    p = points(s, d).select("item_id", "pos", "x")
    fresh = p.where("pos % 3 = 0").withColumn("x", F.col("x") * 2)
    return corpus.upsert(p, fresh, ["item_id", "pos"], "x").select("item_id", "pos", r6("x"))


@query("SELECT doc_id, lang AS style FROM documents WHERE lang = 'en' UNION ALL SELECT doc_id, 'other' FROM documents WHERE coalesce(lang <> 'en', true)")
def q35_union_banks(s: SparkSession, d: str) -> DataFrame:
    docs = table(s, d, "documents").select("doc_id", F.col("lang").alias("style"))
    return docs.where("style = 'en'").unionByName(docs.where("coalesce(style <> 'en', true)").withColumn("style", F.lit("other")))


@query("WITH b AS (SELECT event_type, floor(event_id / 100)::bigint AS batch, value FROM events), m AS (SELECT event_type, batch, avg(value) AS m FROM b GROUP BY ALL) SELECT event_type, round(avg(m), 6) AS mean_loss, count(*) AS n_batches FROM m GROUP BY event_type")
def q36_mean_batch_loss(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "events").select("event_type", F.floor(F.col("event_id") / 100).alias("batch"), "value")
    per = e.groupBy("event_type", "batch").agg(F.avg("value").alias("m"))
    return per.groupBy("event_type").agg(F.round(F.avg("m"), 6).alias("mean_loss"), F.count("*").alias("n_batches"))


@query(f"WITH {PTS}, b AS (SELECT item_id, pos, x, min(x) OVER (PARTITION BY item_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM points) SELECT item_id, pos, round(least(x, p), 6) AS best, p IS NULL OR x < p AS saved FROM b")
def q37_running_best(s: SparkSession, d: str) -> DataFrame:
    return corpus.running_best(points(s, d), "item_id", "pos", "x").select("item_id", "pos", r6("best"), "saved")


@query("SELECT event_id, round(0.01::double * pow(0.333::double, floor(event_id / 3300)), 9) AS lr FROM events")
def q38_lr_schedule(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "events").select("event_id", F.round(geometry.step_lr(F.col("event_id"), 0.01, 0.333, 3300), 9).alias("lr"))


@query("SELECT user_id, arg_max(event_type || ':v' || event_id, event_id) AS latest FROM events GROUP BY user_id")
def q39_latest_version(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "events").select("user_id", F.concat("event_type", F.lit(":v"), "event_id").alias("name"))
    return corpus.latest(e, "user_id", "name")


@query("""SELECT page_id, array_to_string(regexp_extract_all(html, 'href="([^"]*)"', 1), ' ') AS links, len(regexp_extract_all(html, 'href="([^"]*)"', 1))::bigint AS n FROM pages WHERE html IS NOT NULL""")
def q40_html_links(s: SparkSession, d: str) -> DataFrame:
    found = F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))
    return table(s, d, "pages").where("html is not null").select("page_id", F.array_join(found, " ").alias("links"), long(F.size(found)).alias("n"))


@query(
    f"""WITH {PTS}, w AS (SELECT item_id, (pos - 1) // 16 AS block, pos, x, y FROM points), s AS (SELECT t.item_id, t.pos AS target, k.pos AS source, t.x * k.x + t.y * k.y AS score FROM w t JOIN w k ON t.item_id = k.item_id AND t.block = k.block AND k.pos <= t.pos),
    e AS (SELECT *, exp(score - max(score) OVER (PARTITION BY item_id, target)) AS e FROM s) SELECT item_id, target, source, round(e / sum(e) OVER (PARTITION BY item_id, target), 6) AS weight FROM e"""
)
def q41_causal_attention(s: SparkSession, d: str) -> DataFrame:
    """Attention inside blocks of 16 positions: bounded pairs per target."""
    p = points(s, d).select("item_id", F.floor((F.col("pos") - 1) / 16).alias("block"), "pos", "x", "y")
    k = p.select("item_id", "block", F.col("pos").alias("source"), F.col("x").alias("kx"), F.col("y").alias("ky"))
    pairs = p.join(k, ["item_id", "block"]).where("source <= pos").withColumn("score", F.col("x") * F.col("kx") + F.col("y") * F.col("ky"))
    w = Window.partitionBy("item_id", "pos")
    e = pairs.withColumn("e", F.exp(F.col("score") - F.max("score").over(w)))
    return e.select("item_id", F.col("pos").alias("target"), "source", F.round(F.col("e") / F.sum("e").over(w), 6).alias("weight"))


@query(
    f"""WITH {PTS}, s AS (SELECT t.item_id, t.pos AS target, k.pos AS source, t.x * k.x + t.y * k.y AS score FROM points t JOIN points k ON t.item_id = k.item_id AND k.pos BETWEEN t.pos - {codec.LONGEST - 1} AND t.pos),
    e AS (SELECT *, exp(score - max(score) OVER (PARTITION BY item_id, target)) AS e FROM s) SELECT item_id, target, source, round(e / sum(e) OVER (PARTITION BY item_id, target), 6) AS weight FROM e"""
)
def q41b_causal_attention_long(s: SparkSession, d: str) -> DataFrame:
    """Causal attention over the last LONGEST positions up to the target; blocks of that many keep the join from making all pairs of a longer item."""
    p = points(s, d).select("item_id", F.floor((F.col("pos") - 1) / codec.LONGEST).alias("block"), "pos", "x", "y")
    k = p.select("item_id", F.explode(F.array("block", F.col("block") + 1)).alias("block"), F.col("pos").alias("source"), F.col("x").alias("kx"), F.col("y").alias("ky"))
    pairs = p.join(k, ["item_id", "block"]).where(F.col("source").between(F.col("pos") - (codec.LONGEST - 1), F.col("pos"))).withColumn("score", F.col("x") * F.col("kx") + F.col("y") * F.col("ky"))
    w = Window.partitionBy("item_id", "pos")
    e = pairs.withColumn("e", F.exp(F.col("score") - F.max("score").over(w)))
    return e.select("item_id", F.col("pos").alias("target"), "source", F.round(F.col("e") / F.sum("e").over(w), 6).alias("weight"))


@query(f"WITH {PTS} SELECT item_id, pos, round(coalesce(sum(x + 0.17::double) OVER (PARTITION BY item_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0), 6) AS x FROM points")
def q43_v1_side_by_side(s: SparkSession, d: str) -> DataFrame:
    return sequence.side_by_side(points(s, d).select("item_id", "pos", F.col("x").alias("width")), 0.17).select("item_id", "pos", r6("x"))


@query("WITH n AS (SELECT count(*) AS n FROM part) SELECT o_orderkey, p_name AS prompt FROM orders, n, part WHERE p_partkey = o_orderkey % n")
def q44_ordered_prompt(s: SparkSession, d: str) -> DataFrame:
    bank = table(s, d, "part").select("p_partkey", F.col("p_name").alias("prompt"))
    asked = table(s, d, "orders").select("o_orderkey", F.pmod("o_orderkey", F.lit(bank.count())).alias("p_partkey"))
    return asked.join(bank, "p_partkey").select("o_orderkey", "prompt")


@query(
    f"""WITH RECURSIVE {PTS}, l(item_id, pos, x, y, kept) AS (SELECT item_id, pos, x, y, true FROM points WHERE pos = 1
    UNION ALL SELECT p.item_id, p.pos, CASE WHEN sqrt((p.x - l.x) * (p.x - l.x) + (p.y - l.y) * (p.y - l.y)) >= 0.05::double THEN p.x ELSE l.x END,
    CASE WHEN sqrt((p.x - l.x) * (p.x - l.x) + (p.y - l.y) * (p.y - l.y)) >= 0.05::double THEN p.y ELSE l.y END, sqrt((p.x - l.x) * (p.x - l.x) + (p.y - l.y) * (p.y - l.y)) >= 0.05::double
    FROM l JOIN points p ON p.item_id = l.item_id AND p.pos = l.pos + 1) SELECT item_id, pos, round(x, 6) AS x, round(y, 6) AS y FROM l WHERE kept"""
)
def q45_thin_points(s: SparkSession, d: str) -> DataFrame:
    return sequence.thin(points(s, d), 0.05).select("item_id", "pos", r6("x"), r6("y"))


@query(
    f"""WITH RECURSIVE {PTS}, px AS (SELECT DISTINCT item_id, floor(x * 40)::double AS x, floor(y * 40)::double AS y FROM points), l AS (SELECT item_id, list(struct_pack(x := x, y := y) ORDER BY x, y) AS rest FROM px GROUP BY item_id),
    w AS (SELECT item_id, 0::bigint AS pos, NULL::STRUCT(x DOUBLE, y DOUBLE) AS p, rest FROM l UNION ALL SELECT item_id, pos + 1, nxt, list_filter(rest, lambda q: q <> nxt) FROM
      (SELECT item_id, pos, rest, coalesce(list_filter(rest, lambda q: abs(q.x - p.x) <= 1 AND abs(q.y - p.y) <= 1)[1], rest[1]) AS nxt FROM w WHERE len(rest) > 0))
    SELECT item_id, pos, p.x AS x, p.y AS y FROM w WHERE pos > 0"""
)
def q47_greedy_walk(s: SparkSession, d: str) -> DataFrame:
    p = points(s, d).select("item_id", F.floor(F.col("x") * 40).cast("double").alias("x"), F.floor(F.col("y") * 40).cast("double").alias("y"))
    return raster.walk(p)


@query(
    f"""WITH {PTS}, t AS (SELECT *, CASE WHEN pen <> lag(pen) OVER (PARTITION BY item_id ORDER BY pos) THEN 1 ELSE 0 END AS turn FROM points), u AS (SELECT *, sum(turn) OVER (PARTITION BY item_id ORDER BY pos) AS run FROM t),
    v AS (SELECT *, row_number() OVER (PARTITION BY item_id, run ORDER BY pos) AS r, count(*) OVER (PARTITION BY item_id, run) AS n FROM u)
    SELECT item_id, pos, round(CASE WHEN n <= 4 THEN x WHEN r = 1 THEN 0.95 * x + 0.15 * lead(x, 1) OVER w + -0.15 * lead(x, 2) OVER w + 0.05 * lead(x, 3) OVER w WHEN r = n THEN 0.05 * lag(x, 3) OVER w + -0.15 * lag(x, 2) OVER w + 0.15 * lag(x, 1) OVER w + 0.95 * x
    WHEN r = 2 THEN 0.15 * lag(x, 1) OVER w + 0.55 * x + 0.45 * lead(x, 1) OVER w + -0.15 * lead(x, 2) OVER w WHEN r = n - 1 THEN -0.15 * lag(x, 2) OVER w + 0.45 * lag(x, 1) OVER w + 0.55 * x + 0.15 * lead(x, 1) OVER w ELSE -0.0625 * lag(x, 1) OVER w + 0.5625 * x + 0.5625 * lead(x, 1) OVER w + -0.0625 * lead(x, 2) OVER w END, 12) AS x,
    round(CASE WHEN n <= 4 THEN y WHEN r = 1 THEN 0.95 * y + 0.15 * lead(y, 1) OVER w + -0.15 * lead(y, 2) OVER w + 0.05 * lead(y, 3) OVER w WHEN r = n THEN 0.05 * lag(y, 3) OVER w + -0.15 * lag(y, 2) OVER w + 0.15 * lag(y, 1) OVER w + 0.95 * y
    WHEN r = 2 THEN 0.15 * lag(y, 1) OVER w + 0.55 * y + 0.45 * lead(y, 1) OVER w + -0.15 * lead(y, 2) OVER w WHEN r = n - 1 THEN -0.15 * lag(y, 2) OVER w + 0.45 * lag(y, 1) OVER w + 0.55 * y + 0.15 * lead(y, 1) OVER w ELSE -0.0625 * lag(y, 1) OVER w + 0.5625 * y + 0.5625 * lead(y, 1) OVER w + -0.0625 * lead(y, 2) OVER w END, 12) AS y, pen FROM v WINDOW w AS (PARTITION BY item_id, run ORDER BY pos)"""
)
def q48_smooth(s: SparkSession, d: str) -> DataFrame:
    # At 6 digits many values would lie exactly between two.
    return raster.smooth(points(s, d)).select("item_id", "pos", F.round("x", 12).alias("x"), F.round("y", 12).alias("y"), "pen")


@query("WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 1 DAY THEN 0 ELSE 1 END AS new FROM events), g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS g FROM e) SELECT user_id, count(*) AS n_points, min(ts) AS first_ts FROM g GROUP BY user_id, g")
def q49_pen_sessions(s: SparkSession, d: str) -> DataFrame:
    return metrics.sessions(table(s, d, "events")).select("user_id", "n_points", "first_ts")


@query(
    f"""WITH {PTS}, c AS (SELECT item_id, pos AS source, x AS kx, y AS ky FROM points WHERE pos <= 8), s AS (SELECT p.item_id, pos, source, x * kx + y * ky AS score FROM points p JOIN c ON c.item_id = p.item_id),
    e AS (SELECT *, exp(score - max(score) OVER (PARTITION BY item_id, pos)) AS e FROM s) SELECT item_id, pos, source, round(e / sum(e) OVER (PARTITION BY item_id, pos), 6) AS weight FROM e"""
)
def q42_cross_attention(s: SparkSession, d: str) -> DataFrame:
    p = points(s, d).select("item_id", "pos", "x", "y")
    context = p.where("pos <= 8").select("item_id", F.col("pos").alias("source"), F.col("x").alias("kx"), F.col("y").alias("ky"))
    return corpus.cross_attention(p, context, "item_id").select("item_id", "pos", "source", r6("weight"))


@query(
    f"""WITH {PTS}, s AS (SELECT p.item_id, p.pos, c.pos AS source, p.x * c.x + p.y * c.y AS score FROM points p JOIN points c ON c.item_id = p.item_id),
    e AS (SELECT *, exp(score - max(score) OVER (PARTITION BY item_id, pos)) AS e FROM s) SELECT item_id, pos, source, round(e / sum(e) OVER (PARTITION BY item_id, pos), 6) AS weight FROM e"""
)
def q42b_cross_attention_whole(s: SparkSession, d: str) -> DataFrame:
    p = points(s, d).select("item_id", "pos", "x", "y")
    context = p.select("item_id", F.col("pos").alias("source"), F.col("x").alias("kx"), F.col("y").alias("ky"))
    return corpus.cross_attention(p, context, "item_id").select("item_id", "pos", "source", r6("weight"))


def _words_sql() -> str:
    u = lambda *part: uniform_sql("'46'", *(f"'{p}'" for p in part), "p_partkey")
    pick = lambda u, weights: f"len(list_filter([{', '.join(f'{x!r}::double' for x in sampling.steps(weights))}], lambda e: e <= {u}))"
    char = uniform_sql("'46'", "'char'", "i", "p_partkey")
    put = lambda at, what: f"left(w, {at}) || {what} || substr(w, {at} + 1)"
    point, gap = f"floor({u('point')} * (length(w) + 1))::bigint", f"(1 + floor({u('gap')} * (length(w) - 1))::bigint)"
    ends = " ".join(f"WHEN {u('end', p)} < 0.05::double THEN '{p}'" for p in sampling.PUNCTUATION)
    return f"""WITH k AS (SELECT p_partkey, {u("kind")} < 0.25::double AS digit, {u("length")} AS u FROM part),
    n AS (SELECT *, CASE WHEN digit THEN 1 + floor(u * 5)::bigint ELSE 3 + {pick("u", sampling.length_weights())} END AS n FROM k),
    c AS (SELECT p_partkey, digit, unnest(range(1, n + 1)) AS i FROM n), d AS (SELECT *, {char} AS u FROM c),
    w AS (SELECT p_partkey, digit, string_agg(CASE WHEN digit THEN floor(u * 10)::bigint::varchar ELSE substr('{sampling.LETTERS}', {pick("u", sampling.LETTER_WEIGHTS)} + 1, 1) END, '' ORDER BY i) AS w FROM d GROUP BY ALL),
    a AS (SELECT p_partkey, CASE WHEN digit THEN CASE WHEN {u("decimal")} < 0.3::double THEN {put(point, "'.'")} ELSE w END WHEN {u("upper")} < 0.25::double THEN upper(w)
      WHEN {u("capital")} < 0.25::double THEN upper(left(w, 1)) || substr(w, 2) ELSE w END AS w FROM w),
    q AS (SELECT *, CASE WHEN {u("mark")} < 0.5::double THEN '"' ELSE chr(39) END AS q FROM a),
    b AS (SELECT p_partkey, CASE WHEN {u("quoted")} >= 0.1::double THEN w WHEN q <> '"' AND {u("inside")} < 0.5::double AND length(w) > 1 THEN {put(gap, "q")} WHEN {u("side")} < 0.5::double THEN q || w ELSE w || q END AS w FROM q),
    p AS (SELECT p_partkey, CASE WHEN {u("bracketed")} >= 0.1::double THEN w WHEN {u("opens")} < 0.5::double THEN '(' || w ELSE w || ')' END AS w FROM b)
    SELECT p_partkey, CASE WHEN {u("flowing")} < 0.8::double THEN w || CASE {ends} ELSE '' END ELSE w END AS word FROM p"""


@query(_words_sql())
def q46_made_up_words(s: SparkSession, d: str) -> DataFrame:
    # Keys are few bytes, words much work: dealt out, as a small file is one task's.
    keys = table(s, d, "part").select("p_partkey").repartition(int(s.conf.get("spark.sql.shuffle.partitions")))
    return sampling.made_up_words(keys, "p_partkey")


@query(f"WITH {PTS} SELECT item_id, count(*) AS point_count, count(*) FILTER (WHERE pen = 0) AS stroke_count, round((max(x) - min(x)) / nullif(max(y) - min(y), 0), 4) AS aspect_ratio FROM points GROUP BY item_id")
def q50_metadata(s: SparkSession, d: str) -> DataFrame:
    return sequence.metadata(points(s, d))


@query(f"WITH {_LOGITS}, t AS (SELECT vec_id, ln(sum(exp(v))) - max(v) FILTER (WHERE i = vec_id % len) AS nll FROM v JOIN (SELECT vec_id, len(embedding) AS len FROM embeddings) USING (vec_id) GROUP BY vec_id) SELECT label, round(avg(nll), 6) AS loss, count(*) AS n FROM t JOIN embeddings USING (vec_id) GROUP BY label")
def q51_cross_entropy(s: SparkSession, d: str) -> DataFrame:
    v = table(s, d, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))
    nll = v.select("label", corpus.cross_entropy(F.col("v"), F.col("vec_id") % F.size("v")).alias("nll"))
    return nll.groupBy("label").agg(F.round(F.avg("nll"), 6).alias("loss"), F.count("*").alias("n"))


@query(
    f"""WITH {PTS}, n AS (SELECT item_id, count(*) AS n, floor(count(*) * 0.375::double)::bigint AS m FROM points GROUP BY item_id), k AS (SELECT *, unnest(range(m)) AS k FROM n)
    SELECT item_id, CASE WHEN k = 0 THEN 0 WHEN k = m - 1 THEN n - 1 ELSE floor(k * ((n - 1) / (m - 1)::double))::bigint END + 1 AS pos FROM k"""
)
def q52_downsample_whole(s: SparkSession, d: str) -> DataFrame:
    return sequence.downsample_whole(points(s, d), 0.625).select("item_id", "pos")


@query(
    f"""WITH {PTS}, n AS (SELECT item_id, pos, pos - 1 AS i, floor({uniform_sql("'9'", "item_id")} * count(*) OVER (PARTITION BY item_id))::bigint AS m FROM points),
    r AS (SELECT *, i BETWEEN 1 AND m - 2 AS may, row_number() OVER (PARTITION BY item_id, i BETWEEN 1 AND m - 2 ORDER BY {uniform_sql("'9'", "item_id", "pos")}, pos) AS rank FROM n)
    SELECT item_id, pos FROM r WHERE NOT may OR rank > floor(m * 0.1::double)"""
)
def q53_remove_random(s: SparkSession, d: str) -> DataFrame:
    return sampling.remove_random(points(s, d), 0.1).select("item_id", "pos")


@query("SELECT date_trunc('day', ts)::timestamp AS day, event_type, round(avg(value), 6) AS mean_value, count(*) AS n FROM events GROUP BY ALL")
def q54_window_losses(s: SparkSession, d: str) -> DataFrame:
    return metrics.window_losses(table(s, d, "events")).select(F.col("window.start").alias("day"), "event_type", r6("mean_value"), "n")
