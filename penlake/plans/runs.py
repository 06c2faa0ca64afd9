"""Queries over training runs, attention grids and labels of words; registered beside the catalogue's."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from penlake.functions import geometry
from penlake.operators import attention, corpus, training
from penlake.plans.catalogue import PTS, logits, long, query, r6
from penlake.plans.training import WPTS, texts, word_points
from penlake.sources.adapters import points, table, words
from penlake.streaming import training as runs

EVERY, CHUNK, LAST_BATCH = 10, 25, 2
LR = (0.01, 0.333, 20)


def losses(s: SparkSession, d: str) -> DataFrame:
    """Each user's events as the losses of evaluations: 25 rows a step, train and test in turn, six rows a batch."""
    i = (F.col("pos") - 1) % CHUNK
    return points(s, d).select(
        F.col("item_id").alias("run"), (F.floor((F.col("pos") - 1) / CHUNK) * 5).alias("step"), F.when(i % 2 == 0, "train").otherwise("test").alias("side"), F.floor(i / 6).alias("batch"), F.col("x").alias("loss")
    )


_LOSSES = f"""{PTS}, rows AS (SELECT item_id AS run, ((pos - 1) // {CHUNK}) * 5 AS step, CASE WHEN (pos - 1) % {CHUNK} % 2 = 0 THEN 'train' ELSE 'test' END AS side, ((pos - 1) % {CHUNK}) // 6 AS batch, x AS loss FROM points),
  m AS (SELECT run, step, side, batch, avg(loss) AS m FROM rows WHERE step > 0 AND step % {EVERY} = 0 AND batch <= {LAST_BATCH} GROUP BY run, step, side, batch),
  ev AS (SELECT run, step, avg(m) FILTER (side = 'train') AS train_loss, avg(m) FILTER (side = 'test') AS test_loss FROM m GROUP BY run, step HAVING count(DISTINCT side) = 2),
  b AS (SELECT *, min(test_loss) OVER (PARTITION BY run ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM ev)"""


@query(
    f"""WITH {_LOSSES} SELECT run, step, round(train_loss, 6) AS train_loss, round(test_loss, 6) AS test_loss, round(least(test_loss, coalesce(before, test_loss)), 6) AS best, before IS NULL OR test_loss < before AS saved,
    round({LR[0]}::double * pow({LR[1]}::double, floor(step / {LR[2]}::double)), 9) AS lr FROM b"""
)
def q81_evaluations(s: SparkSession, d: str) -> DataFrame:
    """What a run logs every ten steps: means of batch means, the best so far, what is saved, the learning rate."""
    out = runs.evaluations(losses(s, d), "run", EVERY, LAST_BATCH)
    return out.select("run", "step", r6("train_loss"), r6("test_loss"), r6("best"), "saved", F.round(geometry.step_lr(F.col("step"), *LR), 9).alias("lr"))


@query(f"WITH {_LOSSES} SELECT run, max(step) + 1 AS step, round(min(test_loss), 6) AS best_loss FROM b WHERE before IS NULL OR test_loss < before GROUP BY run")
def q81b_resume_points(s: SparkSession, d: str) -> DataFrame:
    """Where each run would go on: the step after its last saved evaluation."""
    saved = runs.evaluations(losses(s, d), "run", EVERY, LAST_BATCH).where("saved")
    return saved.groupBy("run").agg((F.max("step") + 1).alias("step"), F.round(F.min("test_loss"), 6).alias("best_loss"))


_GRID = f"""{PTS}, g AS (SELECT * FROM (SELECT unnest([1, 2]) AS stride) a, (SELECT unnest(range(3)) AS head) b), k AS (SELECT * FROM points WHERE pos <= 40),
  s AS (SELECT t.item_id, stride, head, t.pos AS target, k.pos AS source, (t.x * k.x + t.y * k.y) * (head + 1) AS score FROM k t JOIN k ON k.item_id = t.item_id AND k.pos <= t.pos, g
    WHERE t.pos > 1 AND k.pos > 1 AND (t.pos - 2) % stride = 0 AND (k.pos - 2) % stride = 0),
  all_s AS (SELECT t.item_id, head, t.pos AS target, k.pos AS source, (t.x * k.x + t.y * k.y) * (head + 1) AS score FROM k t JOIN k ON k.item_id = t.item_id AND k.pos <= t.pos, (SELECT unnest(range(3)) AS head) h),
  e AS (SELECT *, exp(score - max(score) OVER w) AS e FROM all_s WINDOW w AS (PARTITION BY item_id, head, target)), wt AS (SELECT *, e / sum(e) OVER (PARTITION BY item_id, head, target) AS weight FROM e)"""


@query(f"WITH {_GRID} SELECT wt.item_id, stride, s.head, s.target, s.source, round(weight, 6) AS weight FROM s JOIN wt ON wt.item_id = s.item_id AND wt.head = s.head AND wt.target = s.target AND wt.source = s.source")
def q82_attention_grid(s: SparkSession, d: str) -> DataFrame:
    """Causal weights of the first 40 positions for every stride and head, as they are drawn: cut, then every stride-th from the second on."""
    weights = attention.causal_weights(points(s, d), 40, heads=3)
    return attention.strided(corpus.with_grid(weights, {"stride": [1, 2]}), 40, F.col("stride")).select("item_id", long("stride").alias("stride"), long("head").alias("head"), "target", "source", r6("weight"))


_WARM = f"""{WPTS}, t AS (SELECT p_partkey AS item_id, p_name AS text, strpos(p_name, ' ') - 1 AS gap FROM part),
  c AS (SELECT item_id, pos AS source, x AS kx, y AS ky FROM points), sc AS (SELECT p.item_id, p.pos, source, x * kx + y * ky AS score FROM points p JOIN c ON c.item_id = p.item_id),
  e AS (SELECT *, exp(score - max(score) OVER (PARTITION BY item_id, pos)) AS e FROM sc), wt AS (SELECT *, e / sum(e) OVER (PARTITION BY item_id, pos) AS weight FROM e)"""


@query(
    f"""WITH {_WARM} SELECT wt.item_id, pos, source, substr(text, source, 1) AS ch, round(weight, 6) AS weight FROM wt JOIN t ON t.item_id = wt.item_id
    WHERE CASE WHEN gap < 0 THEN source <= length(text) ELSE source - 1 > gap AND source - 1 < length(text) - gap - 1 END"""
)
def q83_drop_warmup(s: SparkSession, d: str) -> DataFrame:
    """Cross-attention weights of the characters behind the first word; the upper end is the shown text's length, which leaves its tail out."""
    p = points(s, d).join(texts(s, d).select("item_id"), "item_id", "left_semi")  # items without a text show nothing
    context = p.select("item_id", F.col("pos").alias("source"), F.col("x").alias("kx"), F.col("y").alias("ky"))
    weights = corpus.cross_attention(p, context, "item_id")
    return attention.drop_warmup(weights, texts(s, d)).select("item_id", "pos", "source", "ch", r6("weight"))


@query(
    f"""WITH {WPTS}, f AS (SELECT item_id, word, arg_min(x, pos) AS x, arg_min(y, pos) AS y FROM wpts GROUP BY item_id, word)
    SELECT item_id, word::bigint AS word, word::bigint::varchar AS label, round(x - 0.12::double, 6) AS x, round(0.95::double - y, 6) AS y FROM f"""
)
def q84_word_labels(s: SparkSession, d: str) -> DataFrame:
    """Where the number of each word is written."""
    return training.word_labels(word_points(s, d)).select("item_id", long("word").alias("word"), "label", r6("x"), r6("y"))


@query("SELECT vec_id, i, round(0.5::double * v * (1 + tanh(sqrt(2 / 3.141592653589793::double) * (v + 0.044715::double * v * v * v))), 6) AS g FROM (SELECT vec_id, unnest(embedding)::double AS v, unnest(range(len(embedding))) AS i FROM embeddings)")
def q85_gelu(s: SparkSession, d: str) -> DataFrame:
    return logits(s, d).select("vec_id", F.posexplode("v").alias("i", "v")).select("vec_id", long("i").alias("i"), F.round(geometry.gelu(F.col("v")), 6).alias("g"))


@query(
    f"""WITH {WPTS}, l AS (SELECT item_id, word, max(x) - min(x) AS w, max(y) - min(y) AS h, count(*) AS n FROM wpts GROUP BY item_id, word), t AS (SELECT p_partkey, p_name, len(string_split(p_name, ' ')) AS k FROM part)
    SELECT (SELECT count(*) FROM l)::bigint AS n_words, (SELECT round(avg(n), 6) FROM l) AS mean_points, (SELECT count(*) FROM t WHERE length(p_name) >= 3) AS n_texts, (SELECT round(avg(k), 6) FROM t WHERE length(p_name) >= 3) AS mean_words,
      (SELECT count(DISTINCT c) FROM (SELECT unnest(string_split(p_name, '')) AS c FROM t WHERE length(p_name) >= 3) WHERE c <> '') AS alphabet"""
)
def q86_data_set_summary(s: SparkSession, d: str) -> DataFrame:
    """What is logged of a data set: words and their points, texts of three characters or more, their words and characters."""
    t = table(s, d, "part").where(F.length("p_name") >= 3)
    words = word_points(s, d).groupBy("item_id", "word").agg(F.count("*").alias("n")).agg(F.count("*").alias("n_words"), F.round(F.avg("n"), 6).alias("mean_points"))
    named = t.agg(F.count("*").alias("n_texts"), F.round(F.avg(F.size(F.split("p_name", " "))), 6).alias("mean_words"))
    chars = t.select(F.explode(F.array_distinct(F.split("p_name", ""))).alias("c")).where("c <> ''").agg(F.count_distinct("c").alias("alphabet"))
    return words.crossJoin(named).crossJoin(chars)  # one row each


@query(
    """WITH d AS (SELECT date_trunc('day', ts) AS day, event_type, value FROM events) SELECT strftime(day, '%Y-%m-%d') AS day, event_type || '-' || strftime(day, '%Y%m%d') AS name, count(*) AS n, round(max(value), 6) AS top FROM d GROUP BY day, event_type"""
)
def q87_dated_names(s: SparkSession, d: str) -> DataFrame:
    """Names with dates, as backups and artefacts have them."""
    e = table(s, d, "events").select(F.to_date("ts").alias("day"), "event_type", "value").groupBy("day", "event_type").agg(F.count("*").alias("n"), F.round(F.max("value"), 6).alias("top"))
    return e.select(F.date_format("day", "yyyy-MM-dd").alias("day"), F.concat_ws("-", "event_type", F.date_format("day", "yyyyMMdd")).alias("name"), "n", "top")


def _greedy_sql(steps: int, crop: int) -> str:
    out = ["s0 AS (SELECT vec_id AS item_id, vec_id % 64 AS token, [vec_id % 64] AS tokens FROM embeddings)"]
    out += [f"s{k + 1} AS (SELECT s.item_id, b.best AS token, list_append(s.tokens, b.best) AS tokens FROM s{k} s JOIN b ON b.vec_id = s.token)" for k in range(steps)]
    return f"WITH v AS (SELECT vec_id, unnest(embedding)::double AS v, unnest(range(len(embedding))) AS i FROM embeddings), b AS (SELECT vec_id, first(i ORDER BY v DESC, i) AS best FROM v GROUP BY vec_id), {', '.join(out)} SELECT item_id, array_to_string(tokens[-{crop}:], ' ') AS tokens FROM s{steps}"


@query(_greedy_sql(4, 5))
def q59b_generate_greedy(s: SparkSession, d: str) -> DataFrame:
    """Four tokens in a row, each the largest logit's that the one before leads to."""
    ranges = training.top_ranges(logits(s, d), "vec_id", "v").withColumnRenamed("vec_id", "token")
    starts = logits(s, d).select(F.col("vec_id").alias("item_id"), (F.col("vec_id") % 64).alias("token"))
    return training.generate(starts, ranges, 4, 5).select("item_id", F.array_join(F.col("tokens").cast("array<string>"), " ").alias("tokens"))


_FIRST = """RECURSIVE bank AS (SELECT word, min(doc_id) AS seen FROM (SELECT doc_id, unnest(string_split(text, ' ')) AS word FROM documents WHERE text IS NOT NULL) WHERE word <> '' GROUP BY word),
  f AS (SELECT word, row_number() OVER (ORDER BY seen, encode(word)) - 1 AS k FROM bank ORDER BY seen, encode(word) LIMIT 75),
  l AS (SELECT k, word, length(word) + 1 AS used, CASE WHEN length(word) + 1 > 80 THEN 1 ELSE 0 END AS line FROM f WHERE k = 0
    UNION ALL SELECT f.k, f.word, CASE WHEN l.used + length(f.word) + 1 > 80 THEN 0 ELSE l.used END + length(f.word) + 1, l.line + CASE WHEN l.used + length(f.word) + 1 > 80 THEN 1 ELSE 0 END FROM l JOIN f ON f.k = l.k + 1)"""


@query(f"WITH {_FIRST} SELECT line::bigint AS line, string_agg(word, ' ' ORDER BY k) AS words FROM l GROUP BY line")
def q92_first_words(s: SparkSession, d: str) -> DataFrame:
    """The first 75 different words of all texts, in the lines of a report."""
    bank = words(s, d).where("word <> ''").groupBy("word").agg(F.min("doc_id").alias("at"))
    return corpus.first_lines(bank, ["at", "word"], "word", 75, 80)
