"""Queries over the operators that make training rows, lay out sentences and generate; registered beside the catalogue's."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from penlake.functions import codec
from penlake.operators import corpus, sequence, training
from penlake.plans.catalogue import PTS, R_EDGES, T_EDGES, logits, long, query, r6, uniform_sql
from penlake.sources.adapters import points, table

WORD_POINTS = 12
PAIR = f"[{codec.WORD}, {codec.WORD}]"


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _u(seed: int, i: int, *key: str) -> str:
    return uniform_sql(f"'{seed}'", f"'{i}'", *key)


def _between(bounds: tuple[float, float], u: str) -> str:
    return f"({bounds[0]!r}::double + {bounds[1] - bounds[0]!r}::double * {u})"


def word_points(s: SparkSession, d: str) -> DataFrame:
    return points(s, d).withColumn("word", F.floor((F.col("pos") - 1) / WORD_POINTS))


WPTS = f"{PTS}, wpts AS (SELECT *, (pos - 1) // {WORD_POINTS} AS word FROM points)"
_SCALED = f"""{WPTS}, aug AS (SELECT item_id, word, pos, (x + {_between(training.SHEAR, _u(7, 0, 'item_id'))} * y) * {_between(training.SCALE, _u(7, 1, 'item_id'))} AS x,
  y * {_between(training.SCALE, _u(7, 2, 'item_id'))} AS y, pen, 1 - ({training.DOWNSAMPLE_MEAN}::double + {training.DOWNSAMPLE_WIDTH}::double * ({_u(7, 3, 'item_id')} - 0.5)) AS share FROM wpts)"""
_THIN = f"""{_SCALED}, isl AS (SELECT *, sum(1 - pen) OVER (PARTITION BY item_id, word ORDER BY pos) AS island FROM aug),
  str AS (SELECT item_id, word, island, any_value(share) AS share, count(*) AS n, list(pos ORDER BY pos) AS ps FROM isl WHERE pen = 1 GROUP BY item_id, word, island),
  cnt AS (SELECT *, greatest(floor(n * share)::bigint, 2) AS m FROM str), pick AS (SELECT *, unnest(range(m)) AS k FROM cnt),
  kept AS (SELECT item_id, word, k, m, ps[(CASE WHEN k = m - 1 THEN n - 1 ELSE floor(k * ((n - 1) / (m - 1)::double))::bigint END) + 1] AS pos FROM pick),
  stay AS (SELECT item_id, pos, k FROM kept WHERE k = 0 OR k = m - 1 OR {uniform_sql("'8'", 'item_id', 'pos')} > {training.DROP}::double
    UNION ALL SELECT item_id, pos, 0 FROM aug WHERE pen <> 1),
  thin AS (SELECT a.item_id, a.word, a.x, a.y, a.pen, a.pos AS before, row_number() OVER (PARTITION BY a.item_id ORDER BY a.pos, s.k) AS pos FROM stay s JOIN aug a ON a.item_id = s.item_id AND a.pos = s.pos)"""
_TRIPLE = f"""{_THIN}, ext AS (SELECT *, min(x) OVER g AS lo, max(x) OVER g AS hi, row_number() OVER (PARTITION BY item_id, word ORDER BY pos) AS i FROM thin WINDOW g AS (PARTITION BY item_id, word)),
  lagged AS (SELECT *, lag(x) OVER o AS px, lag(y) OVER o AS py, lag(hi) OVER o AS ph, lag(word) OVER o AS pw FROM ext WINDOW o AS (PARTITION BY item_id ORDER BY pos)),
  off AS (SELECT *, coalesce(CASE WHEN i = 1 THEN (ph - px) + (x - lo) ELSE x - px END, 0.0) AS dx, coalesce(y - py, 0.0) AS dy FROM lagged),
  pol AS (SELECT *, sqrt(dx * dx + dy * dy) AS r, atan2(dy, dx) AS theta FROM off),
  tk AS (SELECT item_id, pos, word, pw, {codec.FIRST_THETA} + len(list_filter({T_EDGES}, lambda e: e <= theta)) - 1 AS t,
    len(list_filter({R_EDGES}, lambda e: e <= r)) - 1 + CASE WHEN pen = 1 THEN 0 ELSE {codec.N_R} END AS d FROM pol),
  flat AS (SELECT item_id, flatten(list(CASE WHEN pw IS NOT NULL AND pw <> word THEN [{codec.WORD}, {codec.WORD}, t, d] ELSE [t, d] END ORDER BY pos)) AS a FROM tk GROUP BY item_id)"""


def _shift_sql(length: int) -> str:
    pad = f"list_transform(range({length - 1} - n), lambda i: {codec.PAD})"
    return f"""cut AS (SELECT item_id, a, least(len(a), {length - 1}) AS n FROM flat), xs AS (SELECT item_id, n, list_concat(list_slice(a, 1, n), [{codec.END}], {pad}) AS x FROM cut),
  tri AS (SELECT item_id, x, list_concat(list_slice(x, 2, n + 1), [{codec.END}], {pad}) AS y FROM xs)"""


_IDS = f"list_slice(list_concat(list_transform(list_filter(string_split(p_name, ''), lambda c: c <> ''), lambda c: strpos({_quoted(codec.ALPHABET)}, c)), list_transform(range(50), lambda i: 0)), 1, 50)"


def texts(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "part").select(F.col("p_partkey").alias("item_id"), F.col("p_name").alias("text"))


def joined(c: str):
    return F.array_join(F.col(c).cast("array<string>"), " ").alias(c)


@query(f"WITH {_TRIPLE}, {_shift_sql(codec.LONGEST)} SELECT item_id, array_to_string(x, ' ') AS x, array_to_string({_IDS}, ' ') AS c, array_to_string(y, ' ') AS y FROM tri JOIN part ON p_partkey = item_id")
def q55_triple(s: SparkSession, d: str) -> DataFrame:
    """Training rows: words augmented and thinned with random drops, offsets over words, tokens, shift; the item's text as ids."""
    return training.triples(word_points(s, d), texts(s, d)).select("item_id", joined("x"), joined("c"), joined("y"))


@query(f"WITH {_THIN} SELECT item_id, pos, before, round(x, 6) AS x, round(y, 6) AS y, pen FROM thin")
def q55b_augment(s: SparkSession, d: str) -> DataFrame:
    fraction = training.DOWNSAMPLE_MEAN + training.DOWNSAMPLE_WIDTH * (training.uniform(7, 3, F.col("item_id")) - 0.5)
    p = training.downsample_words(training.augment(word_points(s, d)), fraction, training.DROP)
    order = training.Window.partitionBy("item_id").orderBy("before", "copy")
    return p.withColumnRenamed("pos", "before").select("item_id", F.row_number().over(order).cast("bigint").alias("pos"), "before", r6("x"), r6("y"), "pen")


_DECODED = f"""round({R_EDGES}[least(greatest(CASE WHEN d < {codec.N_R} THEN d ELSE d - {codec.N_R} END, 0), {len(codec.R_EDGES) - 1}) + 1], 6) AS r,
  round({T_EDGES}[least(greatest(t - {codec.FIRST_THETA}, 0), {len(codec.THETA_EDGES) - 1}) + 1], 6) AS theta, (CASE WHEN d < {codec.N_R} THEN 1 ELSE 0 END)::bigint AS pen"""


@query(
    f"""WITH {_TRIPLE}, {_shift_sql(100)}, el AS (SELECT item_id, unnest(range(len(x))) AS ix, unnest(x) AS t FROM tri),
    c AS (SELECT *, CASE WHEN t = {codec.WORD} AND lag(t) OVER (PARTITION BY item_id ORDER BY ix) = {codec.WORD} THEN 1 ELSE 0 END AS cut FROM el), w AS (SELECT *, sum(cut) OVER (PARTITION BY item_id ORDER BY ix) AS word FROM c),
    k AS (SELECT item_id, word, t, row_number() OVER v - 1 AS k, lead(t) OVER v AS d FROM w WHERE t NOT IN ({codec.PAD}, {codec.END}, {codec.WORD}) WINDOW v AS (PARTITION BY item_id, word ORDER BY ix))
    SELECT item_id, word::bigint AS word, k // 2 AS i, {_DECODED} FROM k WHERE k % 2 = 0 AND d IS NOT NULL"""
)
def q56_decode_words(s: SparkSession, d: str) -> DataFrame:
    """Training rows of 100 tokens read back word by word; the cut leaves odd tails, which are dropped."""
    rows = training.decode_words(training.triples(word_points(s, d), texts(s, d), 100))
    return rows.select("item_id", long("word").alias("word"), long("i").alias("i"), r6("r"), r6("theta"), long("pen").alias("pen"))


@query(
    f"""WITH {_TRIPLE}, {_shift_sql(100)}, f AS (SELECT item_id, list_filter(x, lambda t: t NOT IN ({codec.PAD}, {codec.END})) AS x FROM tri), el AS (SELECT item_id, unnest(range(len(x))) AS ix, unnest(x) AS t FROM f),
    k AS (SELECT item_id, ix, t, lead(t) OVER (PARTITION BY item_id ORDER BY ix) AS d FROM el) SELECT item_id, ix // 2 AS i, {_DECODED} FROM k WHERE ix % 2 = 0 AND d IS NOT NULL"""
)
def q57_v1_codec(s: SparkSession, d: str) -> DataFrame:
    rows = training.decode_pairs(training.triples(word_points(s, d), texts(s, d), 100))
    return rows.select("item_id", long("i").alias("i"), r6("r"), r6("theta"), long("pen").alias("pen"))


_LETTER = "left(text, 1)"
_RAISED = f"""CASE WHEN {_LETTER} <> '' AND strpos({_quoted(training.STARTS_AT_BOTTOM)}, {_LETTER}) > 0 THEN fy WHEN {_LETTER} <> '' AND strpos({_quoted(training.STARTS_AT_TOP)}, {_LETTER}) > 0
  THEN fy + {training.TOP_DROP}::double ELSE 0 END"""


@query(
    f"""WITH RECURSIVE {WPTS}, own AS (SELECT item_id, word, pos, pen, x - first_value(x) OVER w AS x, y - 0.05::double AS y FROM wpts WHERE word % 4 <> 3 WINDOW w AS (PARTITION BY item_id, word ORDER BY pos)),
    names AS (SELECT DISTINCT w.item_id, w.word, p_name AS text FROM wpts w JOIN part ON p_partkey = (w.item_id * 7 + w.word) % 100),
    slots AS (SELECT DISTINCT n.item_id, s.word FROM names n, (SELECT unnest(range(6)) AS word) s), wl AS (SELECT s.item_id, s.word, coalesce(text, '') AS text FROM slots s LEFT JOIN names n ON n.item_id = s.item_id AND n.word = s.word),
    fy AS (SELECT o.*, text, first_value(y) OVER (PARTITION BY o.item_id, o.word ORDER BY pos) AS fy FROM own o JOIN wl ON wl.item_id = o.item_id AND wl.word = o.word),
    up AS (SELECT item_id, word, pos, pen, x, least(greatest(y - {_RAISED}, -0.04::double), 0.04::double) AS y FROM fy),
    wd AS (SELECT wl.item_id, wl.word, coalesce(arg_max(x, pos), 0.0) AS width FROM wl LEFT JOIN up ON up.item_id = wl.item_id AND up.word = wl.word GROUP BY wl.item_id, wl.word),
    cur(item_id, word, x, y, nx) AS (SELECT item_id, word, 0.0::double, 0.0::double, 0.0::double + width + 0.16::double FROM wd WHERE word = 0
      UNION ALL SELECT w.item_id, w.word, CASE WHEN c.nx > 0.5::double THEN 0.0 ELSE c.nx END, CASE WHEN c.nx > 0.5::double THEN c.y + 0.55::double ELSE c.y END,
        (CASE WHEN c.nx > 0.5::double THEN 0.0 ELSE c.nx END) + w.width + 0.16::double FROM cur c JOIN wd w ON w.item_id = c.item_id AND w.word = c.word + 1)
    SELECT cur.item_id, cur.word, coalesce(pos, 0)::bigint AS pos, round(coalesce(up.x, 0.0) + cur.x, 6) AS x, round(coalesce(up.y, 0.0) + cur.y, 6) AS y, coalesce(pen, 0)::bigint AS pen
    FROM cur LEFT JOIN up ON up.item_id = cur.item_id AND up.word = cur.word"""
)
def q58_layout_sentences(s: SparkSession, d: str) -> DataFrame:
    """Six words an item, some without points: raised by their first letter, clipped, wrapped."""
    p = word_points(s, d)
    named = p.select("item_id", "word").distinct().withColumn("p_partkey", F.pmod(F.col("item_id") * 7 + F.col("word"), F.lit(100)))
    words = training.fill_words(named.join(table(s, d, "part"), "p_partkey").select("item_id", "word", F.col("p_name").alias("text")), 6)
    first = F.first("x").over(training.Window.partitionBy("item_id", "word").orderBy("pos"))
    own = p.where("word % 4 <> 3").withColumns({"x": F.col("x") - first, "y": F.col("y") - 0.05})
    out = training.lay_out(own, words, 0.16, 0.5, 0.55, 0.04)
    return out.select("item_id", long("word").alias("word"), long("pos").alias("pos"), r6("x"), r6("y"), long("pen").alias("pen"))


def _generate_sql(steps: int, crop: int) -> str:
    out = ["s0 AS (SELECT vec_id AS item_id, vec_id % 64 AS token, [vec_id % 64] AS tokens FROM embeddings)"]
    for k in range(steps):
        drawn = f"len(list_filter(ends, lambda e: e <= round({uniform_sql(chr(39) + '12' + chr(39), chr(39) + str(k) + chr(39), 's.item_id')}, 9)))"
        out.append(f"s{k + 1} AS (SELECT s.item_id, {drawn} AS token, list_append(s.tokens, {drawn}) AS tokens FROM s{k} s JOIN rng r ON r.token = s.token)")
    return f"""WITH v AS (SELECT vec_id AS token, unnest(embedding)::double AS v, unnest(range(len(embedding))) AS i FROM embeddings),
    k AS (SELECT *, rank() OVER (PARTITION BY token ORDER BY v DESC) AS rank, max(v) OVER (PARTITION BY token) AS top FROM v),
    e AS (SELECT token, i, CASE WHEN rank <= 5 THEN exp((v - top) / 0.8::double) ELSE 0.0 END AS e FROM k),
    c AS (SELECT token, i, round(sum(e) OVER (PARTITION BY token ORDER BY i) / sum(e) OVER (PARTITION BY token), 9) AS c FROM e), rng AS (SELECT token, list(c ORDER BY i) AS ends FROM c GROUP BY token),
    {", ".join(out)} SELECT item_id, array_to_string(tokens[-{crop}:], ' ') AS tokens FROM s{steps}"""


@query(_generate_sql(4, 3))
def q59_generate(s: SparkSession, d: str) -> DataFrame:
    """Four tokens drawn in a row, each from the logits that the one before leads to: temperature, top-k, softmax, draw, crop."""
    ranges = training.next_ranges(logits(s, d), "vec_id", "v", 0.8, 5).withColumnRenamed("vec_id", "token")
    starts = logits(s, d).select(F.col("vec_id").alias("item_id"), (F.col("vec_id") % 64).alias("token"))
    return training.generate(starts, ranges, 4, 3).select("item_id", joined("tokens"))


def _sides_sql() -> str:
    u = [f"floor({uniform_sql(chr(39) + '42' + chr(39), chr(39) + str(i) + chr(39), 'o_orderkey')} * (n - {i}))::bigint" for i in range(3)]
    return f"""WITH h AS (SELECT p_partkey, p_name, row_number() OVER (ORDER BY md5('42:' || p_partkey), p_partkey) <= least(1000, greatest(10, floor(0.05::double * count(*) OVER ()))) AS is_test FROM part),
    b AS (SELECT *, row_number() OVER (PARTITION BY is_test ORDER BY p_partkey) - 1 AS ix, count(*) OVER (PARTITION BY is_test) AS n FROM h), n AS (SELECT DISTINCT is_test, n FROM b),
    a AS (SELECT o_orderkey, is_test, n, {u[0]} AS a, {u[1]} AS h1, {u[2]} AS h2 FROM orders JOIN n ON is_test = (o_orderkey % 10 = 0)), c AS (SELECT *, (a + 1 + h1) % n AS b FROM a),
    g AS (SELECT *, ((b - a - 1) % n + n) % n AS gap FROM c), t AS (SELECT o_orderkey, is_test, a, b, (a + 1 + CASE WHEN h2 >= gap THEN h2 + 1 ELSE h2 END) % n AS c FROM g)
    SELECT o_orderkey, p.p_name || ' ' || q.p_name || ' ' || r.p_name AS ascii, t.is_test FROM t JOIN b p ON p.is_test = t.is_test AND p.ix = a JOIN b q ON q.is_test = t.is_test AND q.ix = t.b JOIN b r ON r.is_test = t.is_test AND r.ix = t.c"""


@query(_sides_sql())
def q60_datasets(s: SparkSession, d: str) -> DataFrame:
    """The bank is split first; combinations are drawn within each side, so no test text is in a training row."""
    bank = corpus.split(table(s, d, "part").select("p_partkey", "p_name"), "p_partkey")
    return training.combos_by_side(bank, "p_partkey", "p_name", table(s, d, "orders").select("o_orderkey"), "o_orderkey", F.col("o_orderkey") % 10 == 0)


@query(f"WITH {PTS} SELECT item_id, pos, round(x + 0.001::double * sqrt(-2 * ln(1 - {_u(31, 0, 'item_id', 'pos')})) * cos(2 * pi() * {_u(31, 1, 'item_id', 'pos')}), 6) AS x, round(y + 0.001::double * sqrt(-2 * ln(1 - {_u(31, 0, 'item_id', 'pos')})) * sin(2 * pi() * {_u(31, 1, 'item_id', 'pos')}), 6) AS y FROM points")
def q61_jitter(s: SparkSession, d: str) -> DataFrame:
    return training.jitter(points(s, d)).select("item_id", "pos", r6("x"), r6("y"))


@query(f"WITH b AS (SELECT p_name, row_number() OVER (ORDER BY p_partkey) - 1 AS ix, count(*) OVER () AS n FROM part) SELECT o_orderkey, p_name FROM orders JOIN b ON ix = floor({uniform_sql(chr(39) + '5' + chr(39), 'o_orderkey')} * n)::bigint")
def q62_sampled(s: SparkSession, d: str) -> DataFrame:
    """Draws with replacement, the batch form of the endless loader."""
    return training.sampled(table(s, d, "orders").select("o_orderkey"), "o_orderkey", table(s, d, "part"), "p_name", "p_partkey").select("o_orderkey", "p_name")


@query(f"WITH {PTS} SELECT item_id, pos, round(1 - y, 6) AS y, (x * 1700)::int::bigint AS px FROM (SELECT item_id, pos, y, floor(x * 1700) / 1700 AS x FROM points) WHERE pos <= 60 AND pos > 1 AND (pos - 2) % 3 = 0")
def q63_stride_slice(s: SparkSession, d: str) -> DataFrame:
    """Every third position from the second on up to the 60th, y turned over, x in pixels."""
    p = points(s, d).where("pos <= 60 and pos > 1 and (pos - 2) % 3 = 0")
    return p.select("item_id", "pos", F.round(1 - F.col("y"), 6).alias("y"), long(F.floor(F.col("x") * 1700)).alias("px"))


@query("WITH n AS (SELECT event_type, count(*) AS n, avg(length(props)) AS m, count(DISTINCT user_id) AS users FROM events WHERE length(props) >= 3 GROUP BY event_type) SELECT event_type, n, round(m, 6) AS mean_length, users, users = 1 AS single FROM n")
def q64_counts(s: SparkSession, d: str) -> DataFrame:
    """Rows long enough, their mean length, and whether all are of one author."""
    e = table(s, d, "events").where(F.length("props") >= 3).groupBy("event_type")
    out = e.agg(F.count("*").alias("n"), F.round(F.avg(F.length("props")), 6).alias("mean_length"), F.count_distinct("user_id").alias("users"))
    return out.withColumn("single", F.col("users") == 1)


@query(
    f"""WITH {PTS}, b AS (SELECT *, CASE WHEN greatest(abs(x - lag(x) OVER w), abs(y - lag(y) OVER w)) > 0.2 THEN 1 ELSE 0 END AS far FROM points WINDOW w AS (PARTITION BY item_id ORDER BY pos)),
    s AS (SELECT *, sum(far) OVER (PARTITION BY item_id ORDER BY pos) AS stroke FROM b), e AS (SELECT *, coalesce(lead(stroke) OVER (PARTITION BY item_id ORDER BY pos) <> stroke, true) AS ends FROM s)
    SELECT item_id, (pos + stroke)::bigint AS pos, round(x, 6) AS x, round(y, 6) AS y, 1::bigint AS pen FROM e UNION ALL SELECT item_id, (pos + stroke + 1)::bigint, round(x, 6), round(y, 6), 0::bigint FROM e WHERE ends"""
)
def q65_closed_strokes(s: SparkSession, d: str) -> DataFrame:
    """Strokes that end where the next point is far, each with a closing pen-up point."""
    return sequence.closed(sequence.breaks(points(s, d), 0.2)).select("item_id", "pos", r6("x"), r6("y"), "pen")


@query(f"WITH {PTS}, n AS (SELECT *, max(pos) OVER (PARTITION BY item_id) AS n FROM points) SELECT item_id, pos, round(x, 6) AS x, round(y, 6) AS y, pen FROM n WHERE pos > 1 AND pos < n")
def q66_trimmed_ends(s: SparkSession, d: str) -> DataFrame:
    return sequence.trimmed(points(s, d)).select("item_id", "pos", r6("x"), r6("y"), "pen")
