"""Queries over pen capture, records, prompts, pages and banks; registered beside the catalogue's."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from penlake.functions import codec, geometry
from penlake.operators import corpus, sampling, sequence, training
from penlake.plans.catalogue import PTS, long, query, r6, uniform_sql
from penlake.plans.training import _quoted
from penlake.sources import records
from penlake.sources.adapters import points, table
from penlake.sources.scratch import new_path
from penlake.streaming import capture

# Which event means what for a pen; x and y are pixels.
KINDS = {"click": "press", "view": "move", "purchase": "move", "signup": "lift", "error": "leave"}
WIDTH, HEIGHT = 30.0, 12.0


def pen_events(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "events")
    kind = F.lit(None)
    for name, what in KINDS.items():
        kind = F.when(F.col("event_type") == name, what).otherwise(kind)
    y = F.get_json_object("props", "$.k").cast("double") / 10
    return e.select(F.col("user_id").alias("pen_id"), "ts", "event_id", kind.alias("kind"), (F.col("value") / 20).alias("x"), y.alias("y"))


_KIND = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in KINDS.items()) + " END"
_FAR = f"sqrt((e.x - t.cur[len(t.cur)].x) * (e.x - t.cur[len(t.cur)].x) + (e.y - t.cur[len(t.cur)].y) * (e.y - t.cur[len(t.cur)].y)) >= {capture.INTERVAL}::double"
_CAPTURE = f"""ev AS (SELECT user_id AS pen_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i, {_KIND} AS kind, value / 20 AS x, CAST(json_extract_string(props, '$.k') AS DOUBLE) / 10 AS y FROM events),
  st AS (SELECT DISTINCT pen_id, 0::bigint AS i, []::STRUCT(x DOUBLE, y DOUBLE)[] AS cur, []::STRUCT(x DOUBLE, y DOUBLE)[] AS done FROM ev
    UNION ALL SELECT e.pen_id, e.i, CASE WHEN kind = 'press' THEN [struct_pack(x := e.x, y := e.y)] WHEN kind = 'move' AND len(t.cur) > 0 AND {_FAR} THEN list_append(t.cur, struct_pack(x := e.x, y := e.y)) WHEN kind = 'move' THEN t.cur ELSE [] END,
      CASE WHEN kind IN ('lift', 'leave') THEN t.cur ELSE [] END FROM st t JOIN ev e ON e.pen_id = t.pen_id AND e.i = t.i + 1),
  str AS (SELECT pen_id, row_number() OVER (PARTITION BY pen_id ORDER BY i) AS stroke, list_append(done, done[len(done)]) AS ps FROM st WHERE len(done) > 0),
  cap AS (SELECT pen_id, stroke, k, p.x AS x, p.y AS y, CASE WHEN k = n THEN 0 ELSE 1 END::bigint AS pen, row_number() OVER (PARTITION BY pen_id ORDER BY stroke, k) AS pos
    FROM (SELECT pen_id, stroke, unnest(ps) AS p, unnest(range(1, len(ps) + 1)) AS k, len(ps) AS n FROM str))"""


@query(f"WITH RECURSIVE {_CAPTURE} SELECT pen_id, stroke, pos, round(x, 6) AS x, round(y, 6) AS y, pen FROM cap")
def q67_pen_capture(s: SparkSession, d: str) -> DataFrame:
    """Pen events to closed strokes: the state machine of the capture page."""
    return capture.capture(pen_events(s, d), "pen_id", ["ts", "event_id"]).select("pen_id", "stroke", "pos", r6("x"), r6("y"), "pen")


def forms(s: SparkSession, d: str) -> DataFrame:
    """One form per customer; every seventh has no author, every eleventh only blanks as text."""
    c = table(s, d, "customer")
    author = F.when(F.col("c_custkey") % 7 == 3, "").otherwise(F.concat(F.lit("  "), "c_name", F.lit("\t")))
    return c.select(F.col("c_custkey").alias("pen_id"), author.alias("author"), F.when(F.col("c_custkey") % 11 == 5, " \n ").otherwise(F.col("c_mktsegment")).alias("ascii"))


def captured(s: SparkSession, d: str) -> DataFrame:
    return capture.entries(capture.capture(pen_events(s, d), "pen_id", ["ts", "event_id"]), forms(s, d), "pen_id", WIDTH, HEIGHT)


_ENTRIES = f"""{_CAPTURE}, frm AS (SELECT c_custkey AS pen_id, c_name AS author, c_mktsegment AS ascii FROM customer WHERE c_custkey % 7 <> 3 AND c_custkey % 11 <> 5),
  rec AS (SELECT c.pen_id, any_value(author) AS author, any_value(ascii) AS ascii, count(*)::bigint AS point_count, max(stroke)::bigint AS stroke_count,
    string_agg(floor(x / {WIDTH}::double * 10000 + 0.5)::bigint || ',' || floor(y / {HEIGHT}::double * 10000 + 0.5)::bigint || ',' || pen, ' ' ORDER BY pos) AS points FROM cap c JOIN frm f ON f.pen_id = c.pen_id GROUP BY c.pen_id)"""


def flat_entries(entries: DataFrame) -> DataFrame:
    whole = lambda v: F.round(v * 10000).cast("bigint").cast("string")
    each = F.transform("points", lambda p: F.concat_ws(",", whole(p[0]), whole(p[1]), p[2].cast("int").cast("string")))
    m = F.col("metadata")
    return entries.select(
        "pen_id", m["author"].alias("author"), m["asciiSequence"].alias("ascii"), long(m["pointCount"]).alias("point_count"), long(m["strokeCount"]).alias("stroke_count"),
        m["aspectRatio"].alias("aspect_ratio"), F.array_join(each, " ").alias("points"),
    )


@query(f"WITH RECURSIVE {_ENTRIES} SELECT *, {WIDTH / HEIGHT!r}::double AS aspect_ratio FROM rec")
def q68_capture_entries(s: SparkSession, d: str) -> DataFrame:
    """Records of what was drawn, for forms that are filled in."""
    return flat_entries(captured(s, d))


@query(f"WITH RECURSIVE {_ENTRIES} SELECT author, ascii, point_count, stroke_count, points FROM rec WHERE length(ascii) >= 9")
def q69_records_out_and_in(s: SparkSession, d: str) -> DataFrame:
    """The records written as JSON lines in the shared folder and read back with the record schema, those with short texts left out."""
    path = new_path(s, "records")
    records.write_json(captured(s, d), path)
    read = records.long_enough(records.read_json(s, path, f"pen_id long, {records.RECORD}", lines=True), 9)
    return flat_entries(read).select("author", "ascii", "point_count", "stroke_count", "points")


@query(
    f"""WITH RECURSIVE {_ENTRIES}, w AS (SELECT DISTINCT ascii FROM rec) SELECT 'const words = [' || string_agg('"' || ascii || '"', ',' ORDER BY ascii) || '];' AS value FROM w"""
)
def q70_js_bank(s: SparkSession, d: str) -> DataFrame:
    words = captured(s, d).select(F.col("metadata.asciiSequence").alias("word")).distinct()
    return records.js_word_bank(words)


def _prompt_sql(k: int) -> str:
    ix = ", ".join(f"floor({uniform_sql(chr(39) + '17' + chr(39), chr(39) + str(i) + chr(39), 'o_orderkey')} * n)::bigint" for i in range(k))
    return f"""WITH b AS (SELECT p_name, row_number() OVER (ORDER BY p_partkey) - 1 AS ix, count(*) OVER () AS n FROM part), n AS (SELECT max(n) AS n FROM b),
    a AS (SELECT o_orderkey, unnest([{ix}]) AS ix, unnest(range({k})) AS k FROM orders, n) SELECT o_orderkey, string_agg(p_name, ' ' ORDER BY k) AS prompt FROM a JOIN b ON b.ix = a.ix GROUP BY o_orderkey"""


@query(_prompt_sql(4))
def q71_random_prompt(s: SparkSession, d: str) -> DataFrame:
    """Prompts of four words, each drawn with replacement."""
    return sampling.prompts(table(s, d, "orders").select("o_orderkey"), "o_orderkey", table(s, d, "part"), "p_name", "p_partkey", 4).select("o_orderkey", "prompt")


_CHAR = f"substr({_quoted(codec.ALPHABET)}, floor({uniform_sql(chr(39) + '23' + chr(39), 'o_orderkey', 'k')} * {len(codec.ALPHABET) + 1})::bigint, 1)"


@query(
    f"""WITH a AS (SELECT o_orderkey, string_split(p_name, ' ') AS w FROM orders JOIN part ON p_partkey = o_orderkey % 100),
    f AS (SELECT o_orderkey, unnest(range(6 - len(w) - 1)) AS k FROM a WHERE len(w) < 6), r AS (SELECT o_orderkey, k, CASE WHEN floor({uniform_sql(chr(39) + '23' + chr(39), 'o_orderkey', 'k')} * {len(codec.ALPHABET) + 1}) = 0 OR trim({_CHAR}) = '' THEN 'the' ELSE {_CHAR} END AS c FROM f),
    j AS (SELECT o_orderkey, string_agg(c, ' ' ORDER BY k) AS more FROM r GROUP BY o_orderkey) SELECT a.o_orderkey, array_to_string(w, ' ') || coalesce(' ' || more, '') AS words FROM a LEFT JOIN j ON j.o_orderkey = a.o_orderkey"""
)
def q72_filled_words(s: SparkSession, d: str) -> DataFrame:
    """Word lists filled up to one less than six with words of one random character."""
    asked = table(s, d, "orders").select("o_orderkey", (F.col("o_orderkey") % 100).alias("p_partkey"))
    lists = asked.join(table(s, d, "part"), "p_partkey").select("o_orderkey", F.split("p_name", " ").alias("words"))
    return lists.select("o_orderkey", F.array_join(sampling.filled(F.col("words"), 6, F.col("o_orderkey")), " ").alias("words"))


@query("WITH p AS (SELECT page_id, url, row_number() OVER (ORDER BY page_id) - 1 AS ix FROM pages) SELECT ix + 1 AS page, page_id, url FROM p WHERE ix >= 10 AND ix < 1000000000")
def q73_page_range(s: SparkSession, d: str) -> DataFrame:
    """Pages from the eleventh on, up to a bound beyond the last one."""
    return corpus.page_range(table(s, d, "pages"), "page_id", 10, 1_000_000_000).select("page", "page_id", "url")


@query("SELECT d.doc_id, n_chars, CASE WHEN quality IS NULL THEN n_chars ELSE floor(n_chars * (0.5::double + quality))::bigint END AS weight, quality IS NOT NULL AS labelled FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id")
def q74_missing_kept(s: SparkSession, d: str) -> DataFrame:
    """Rows without the key of a step go through untouched."""
    rows = table(s, d, "documents").select("doc_id", "n_chars").join(table(s, d, "labels").select("doc_id", "quality"), "doc_id", "left").withColumn("weight", F.col("n_chars"))
    done = corpus.where_known(rows, "quality", {"weight": F.floor(F.col("n_chars") * (F.lit(0.5) + F.col("quality"))).cast("bigint")}, keep=True)
    return done.select("doc_id", "n_chars", "weight", F.col("quality").isNotNull().alias("labelled"))


@query("SELECT d.doc_id, floor(n_chars * (0.5::double + quality))::bigint AS weight FROM documents d JOIN labels l ON l.doc_id = d.doc_id WHERE quality IS NOT NULL")
def q74b_missing_skipped(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "documents").select("doc_id", "n_chars").join(table(s, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    return corpus.where_known(rows, "quality", {"weight": F.floor(F.col("n_chars") * (F.lit(0.5) + F.col("quality"))).cast("bigint")}).select("doc_id", "weight")


@query("SELECT o_custkey, any_value(c_name) AS author, string_agg(o_orderpriority, ' ' ORDER BY o_orderkey) AS ascii, count(*) AS n_words FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY o_custkey")
def q75_one_author(s: SparkSession, d: str) -> DataFrame:
    """Rows of a group as one text; the job fails where a group has more than one author."""
    rows = table(s, d, "orders").join(table(s, d, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    return corpus.combine_one_author(rows, "o_custkey", "o_orderkey", "o_orderpriority", "c_name").select("o_custkey", "author", "ascii", "n_words")


_BANKS = """a AS (SELECT 'part' AS bank, p_partkey AS id, row_number() OVER (ORDER BY p_partkey) - 1 AS ix FROM part), b AS (SELECT 'supplier' AS bank, s_suppkey AS id, row_number() OVER (ORDER BY s_suppkey) - 1 AS ix FROM supplier),
  n AS (SELECT least((SELECT count(*) FROM a), (SELECT count(*) FROM b)) AS n), p AS (SELECT ix, row_number() OVER (ORDER BY md5('42:' || ix), ix) <= least(1000, floor(0.1::double * n)) AS is_test FROM (SELECT unnest(range(n)) AS ix, n FROM n))"""


@query(f"WITH {_BANKS} SELECT bank, id, is_test FROM a JOIN p ON p.ix = a.ix UNION ALL SELECT bank, id, is_test FROM b JOIN p ON p.ix = b.ix")
def q76_split_banks(s: SparkSession, d: str) -> DataFrame:
    """Two banks split alike: one permutation of the shorter one's places, a tenth of them for tests, the longer one's rest unused."""
    banks = {"part": table(s, d, "part").select(F.col("p_partkey").alias("id")), "supplier": table(s, d, "supplier").select(F.col("s_suppkey").alias("id"))}
    return corpus.split_banks(banks, "id").select("bank", "id", "is_test")


@query("WITH r AS (SELECT p_partkey, row_number() OVER (ORDER BY md5('42:' || p_partkey), p_partkey) AS i, count(*) OVER () AS n FROM part) SELECT p_partkey, i <= least(1000, floor(0.05::double * n)) AS is_test FROM r")
def q76b_split_v1(s: SparkSession, d: str) -> DataFrame:
    """The older split: a twentieth for tests, without a least number."""
    return corpus.split(table(s, d, "part").select("p_partkey"), "p_partkey", least=0)


@query("SELECT p_partkey, p_name, p_brand, p_size::bigint AS p_size FROM part WHERE NOT regexp_matches(p_name, '[ijtx]')")
def q77_easy_records(s: SparkSession, d: str) -> DataFrame:
    """The easy side of the partition, whole records."""
    return corpus.word_partition(table(s, d, "part"), word="p_name")[0].select("p_partkey", "p_name", "p_brand", long("p_size").alias("p_size"))


@query("SELECT 'const words = [' || string_agg('\"' || p_name || '\"', ',' ORDER BY p_name) || ']' AS value FROM (SELECT DISTINCT p_name FROM part WHERE regexp_matches(p_name, '[ijtx]'))")
def q77b_redo_list(s: SparkSession, d: str) -> DataFrame:
    redo = corpus.word_partition(table(s, d, "part"), word="p_name")[1].select(F.col("p_name").alias("word")).distinct()
    return records.js_word_bank(redo, end="")


@query("SELECT user_id, event_type || ':v' || max(value)::int AS latest FROM (SELECT user_id, event_type, floor(value) AS value FROM events WHERE event_type = 'click') GROUP BY user_id, event_type")
def q78_latest_of_kind(s: SparkSession, d: str) -> DataFrame:
    """The artefact with the highest version, of one kind."""
    e = table(s, d, "events").select("user_id", F.col("event_type").alias("kind"), F.concat("event_type", F.lit(":v"), F.floor("value").cast("string")).alias("name"))
    return corpus.latest(e, "user_id", "name", kind="click").select("user_id", "latest")


@query(f"WITH {PTS} SELECT item_id, pos, round(x * 3.0::double - first_value(x * 3.0::double) OVER (PARTITION BY item_id ORDER BY pos), 6) AS x, round(y, 6) AS y FROM points")
def q79_normalise_v1(s: SparkSession, d: str) -> DataFrame:
    """The older normalisation, which leaves y as it is."""
    return sequence.normalise(points(s, d), 3.0, baseline=None).select("item_id", "pos", r6("x"), r6("y"))


def _turn_sql(most: float) -> str:
    a = f"radians({-most!r}::double + {2 * most!r}::double * {uniform_sql(chr(39) + '19' + chr(39), 'item_id')})"
    return f"WITH {PTS}, t AS (SELECT *, {a} AS a FROM points) SELECT item_id, pos, round(x * cos(a) - y * sin(a), 6) AS x, round(x * sin(a) + y * cos(a), 6) AS y FROM t"


def turned(s: SparkSession, d: str, most: float) -> DataFrame:
    x, y = geometry.rotate(F.col("x"), F.col("y"), training.between((-most, most), geometry.uniform(19, F.col("item_id"))))
    return points(s, d).select("item_id", "pos", F.round(x, 6).alias("x"), F.round(y, 6).alias("y"))


@query(_turn_sql(0.75))
def q80_rotate_v1(s: SparkSession, d: str) -> DataFrame:
    return turned(s, d, 0.75)


@query(_turn_sql(3.0))
def q80b_rotate_wide(s: SparkSession, d: str) -> DataFrame:
    return turned(s, d, 3.0)


_LINES = """wd AS (SELECT conv_id, turn, unnest(string_split(text, ' ')) AS word, unnest(range(len(string_split(text, ' ')))) AS k FROM conversations WHERE text IS NOT NULL),
  st AS (SELECT conv_id, turn, k, word, length(word) + 1 AS at, CASE WHEN length(word) + 1 > 40 THEN 1 ELSE 0 END AS line FROM wd WHERE k = 0
    UNION ALL SELECT w.conv_id, w.turn, w.k, w.word, CASE WHEN s.at + length(w.word) + 1 > 40 THEN 0 ELSE s.at END + length(w.word) + 1, s.line + CASE WHEN s.at + length(w.word) + 1 > 40 THEN 1 ELSE 0 END
    FROM st s JOIN wd w ON w.conv_id = s.conv_id AND w.turn = s.turn AND w.k = s.k + 1)"""


@query(f"WITH RECURSIVE {_LINES} SELECT conv_id, turn, line::bigint AS line, string_agg(word, ' ' ORDER BY k) AS words FROM st GROUP BY conv_id, turn, line")
def q88_wrapped_lines(s: SparkSession, d: str) -> DataFrame:
    """Each turn's words in lines of 40 characters, as reports print them."""
    said = table(s, d, "conversations").where("text is not null").select("conv_id", "turn", F.posexplode(F.split("text", " ")).alias("k", "word"))
    lines = sequence.wrapped(said, ["conv_id", "turn"], "k", "word", 40)
    words = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "word"))), lambda x: x["word"]), " ")
    return lines.groupBy("conv_id", "turn", "line").agg(words.alias("words"))



def responses(s: SparkSession, d: str) -> DataFrame:
    """One page of words with boxes per user, as a model answers; some answers break off."""
    e = table(s, d, "events").select("user_id", "event_id", "event_type", F.floor("value").alias("x"), F.get_json_object("props", "$.k").cast("int").alias("y"))
    word = F.to_json(F.struct(F.col("event_type").alias("text"), F.array("y", "x", F.col("y") + 9, F.col("x") + 70).alias("box_2d")))
    page = e.groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", word.alias("j")))), lambda x: x["j"]), ",").alias("words"))
    return page.select("user_id", F.concat(F.lit("["), "words", F.when(F.col("user_id") % 13 == 4, F.lit("")).otherwise(F.lit("]"))).alias("raw"))


@query(
    """WITH w AS (SELECT user_id, event_type AS word, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS pos, floor(value)::double AS x, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS y FROM events WHERE user_id % 13 <> 4)
    SELECT user_id, pos, word, trunc(y * (2200 / 1000.0::double))::bigint AS y0, trunc(x * (1700 / 1000.0::double))::bigint AS x0, round((y + 9) / 1000.0::double * 2200, 6) AS y1, round((x + 70) / 1000.0::double * 1700, 6) AS x1 FROM w"""
)
def q89_boxes(s: SparkSession, d: str) -> DataFrame:
    """Words and boxes read from raw responses; corners on a page in whole pixels and not."""
    b, scale = F.col("box"), geometry.scale_box
    return records.boxes(responses(s, d)).select(
        "user_id", long("pos").alias("pos"), F.col("text").alias("word"), long(scale(b[0], 2200, True)).alias("y0"), long(scale(b[1], 1700, True)).alias("x0"),
        F.round(scale(b[2], 2200), 6).alias("y1"), F.round(scale(b[3], 1700), 6).alias("x1"),
    )


@query("WITH w AS (SELECT doc_id, list_filter(string_split_regex(text, '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') AS w FROM documents) SELECT doc_id, unnest(range(len(w))) AS pos, unnest(w) AS word FROM w")
def q90_transcript_words(s: SparkSession, d: str) -> DataFrame:
    """Every word occurrence of each transcript."""
    return records.transcript_words(table(s, d, "documents").select("doc_id", "text")).select("doc_id", long("pos").alias("pos"), "word")


def _two_banks_sql() -> str:
    u = [f"floor({uniform_sql(chr(39) + '42' + chr(39), chr(39) + str(i) + chr(39), 'o_orderkey')} * (n - {i}))::bigint" for i in range(3)]
    banks = _BANKS.replace("'supplier' AS bank, s_suppkey AS id", "'customer' AS bank, c_custkey AS id").replace("ORDER BY s_suppkey", "ORDER BY c_custkey").replace("FROM supplier", "FROM customer")
    return f"""WITH {banks}, both_ AS (SELECT bank, id, is_test FROM a JOIN p ON p.ix = a.ix UNION ALL SELECT bank, id, is_test FROM b JOIN p ON p.ix = b.ix),
    nb AS (SELECT bank, is_test, coalesce(p_name, c_name) AS text, row_number() OVER g - 1 AS ix, count(*) OVER (PARTITION BY bank, is_test) AS n FROM both_ LEFT JOIN part ON bank = 'part' AND p_partkey = id LEFT JOIN customer ON bank = 'customer' AND c_custkey = id WINDOW g AS (PARTITION BY bank, is_test ORDER BY id)),
    sz AS (SELECT DISTINCT bank, is_test, n FROM nb), ask AS (SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'part' ELSE 'customer' END AS bank, (o_orderkey // 2) % 10 = 0 AS is_test FROM orders),
    q AS (SELECT ask.*, n, {u[0]} AS i0, {u[1]} AS h1, {u[2]} AS h2 FROM ask JOIN sz ON sz.bank = ask.bank AND sz.is_test = ask.is_test), r AS (SELECT *, (i0 + 1 + h1) % n AS i1 FROM q), t AS (SELECT *, ((i1 - i0 - 1) % n + n) % n AS gap FROM r),
    v AS (SELECT *, (i0 + 1 + CASE WHEN h2 >= gap THEN h2 + 1 ELSE h2 END) % n AS i2 FROM t), x AS (SELECT o_orderkey, bank, is_test, unnest([i0, i1, i2]) AS ix, unnest([0, 1, 2]) AS k FROM v)
    SELECT o_orderkey, x.bank, x.is_test, string_agg(text, ' ' ORDER BY k) AS ascii FROM x JOIN nb ON nb.bank = x.bank AND nb.is_test = x.is_test AND nb.ix = x.ix GROUP BY o_orderkey, x.bank, x.is_test"""


@query(_two_banks_sql())
def q91_two_banks(s: SparkSession, d: str) -> DataFrame:
    """Data sets of two banks that are split alike; half the combinations come from each."""
    banks = {"part": table(s, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("text")), "customer": table(s, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("text"))}
    halves = corpus.split_banks(banks, "id")
    asked = table(s, d, "orders").select("o_orderkey")
    out = []
    for i, (name, bank) in enumerate(banks.items()):
        rows = bank.join(halves.where(F.col("bank") == name).select("id", "is_test"), "id")
        mine = asked.where(F.col("o_orderkey") % 2 == i)
        out.append(training.combos_by_side(rows, "id", "text", mine, "o_orderkey", F.floor(F.col("o_orderkey") / 2) % 10 == 0).withColumn("bank", F.lit(name)))
    return out[0].unionByName(out[1]).select("o_orderkey", "bank", "is_test", "ascii")
