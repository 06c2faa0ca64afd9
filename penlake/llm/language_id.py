"""Language identification by unigram models over the pieces of a public vocabulary, summed over all segmentations.

Each language has a probability for each piece. A word's probability in a language is the sum, over every way to
write the word as a row of pieces, of the product of their probabilities; a forward pass over the word's characters
gets it for all languages at once. A text scores the sum of its words' logarithms plus the language's share of the
training rows, and the score given out is the posterior of the best language.

Training is expectation-maximisation on the words of all labelled rows: Spark counts each language's different words,
tasks take words with counts, run the forward and backward passes and return expected piece counts, which Spark sums, so
a round's work follows the different words (``sample_docs`` bounds the rows per language, if it's given). What comes to the driver is
one number per piece and language, at most ``most_languages`` of which are learned at once (more labels than that are
an error, so the table that goes to the tasks has a bound); it's broadcast once a round. Words are lower-cased runs of
non-blanks of any length: sums are divided by their own size every few characters, so they can't underflow, and a word
is read in blocks that carry the last sums over. A character that no piece covers has a small fixed probability, the
same in each language.

The posterior compares the learned languages only and runs to 1 with a text's length. Whether a text is in any of them
is told by its fit: the mean log-probability of a character under the best language, over the plain words (letters, with
punctuation around them) if they are at least half of the words with a letter, else over all of these; so keys, numbers
and addresses in a short text don't decide.
identify_known() holds it against a bound for each language, fitted on all labelled rows.

Defined results: a null text, or one without a letter, is ``und`` with score 0, as is every text if no labelled row
was given; ties go to the language that sorts first; repeated rows are scored each by itself; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from penlake.llm.common import materialise

START, UNKNOWN = "▁", 1e-7
#: Sums are rescaled every so many characters; words are looked up in blocks of so many; batches hold so many characters.
RESCALE, BLOCK, BATCH = 16, 1 << 14, 1 << 17
#: Words are counted over so many characters of text at a time; fits are counted in steps of this size.
COUNTED, STEP = 1 << 25, 0.001
LETTER = re.compile(r"[^\W\d_]")
PLAIN = re.compile(r"[\W_]*[^\W\d_]+(['’-][^\W\d_]+)*[\W_]*")
BASE = np.uint64(0x100000001B3)
#: A language's bound lies so many times the distance from the median fit to the 5 % quantile under the median, and at least so far under it.
SPREADS, LEAST_DISTANCE = 6.0, 1.5


class Pieces:
    """The vocabulary as hashes, for looking up many substrings at once."""

    def __init__(self, path: str):
        import sentencepiece as sp

        model = sp.SentencePieceProcessor(model_file=path)
        self.names = sorted({model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))})
        self.most = max(map(len, self.names))
        hashes = np.array([self.hash(x) for x in self.names], np.uint64)
        self.order = np.argsort(hashes)
        self.hashes = hashes[self.order]
        self.n = len(self.names)
        self.maybe = np.zeros(1 << 21, bool)  # by 21 bits: most substrings are no piece, and most of these needn't be searched
        self.maybe[self.slot(hashes)] = True

    @staticmethod
    def hash(piece: str) -> int:
        h = 0
        for c in piece:
            h = (h * int(BASE) + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
        return h

    @staticmethod
    def slot(h: np.ndarray) -> np.ndarray:
        return (h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(43)

    def lattice(self, words: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """For words of one length, by piece length from 1: ids at each start (n where there is none, n + 1 for an unknown character), and the starts where a word has one."""
        size = len(words[0])
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(words), size).astype(np.uint64) + np.uint64(1)
        found, h = [], np.zeros_like(codes)
        for k in range(1, min(self.most, size) + 1):
            h = h[:, : size - k + 1] * BASE + codes[:, k - 1 :]
            ids = np.full(h.shape, self.n + (k == 1), np.int32)
            some = np.flatnonzero(self.maybe[self.slot(h)])
            if len(some):
                sought = h.ravel()[some]
                at = np.minimum(np.searchsorted(self.hashes, sought), self.n - 1)
                same = self.hashes[at] == sought
                ids.ravel()[some[same]] = self.order[at[same]]
            found.append((ids, (ids != self.n).any(axis=0)))
        return found


def log_forward(pieces: Pieces, words: list[str], p: np.ndarray) -> np.ndarray:
    """For words of one length, per word and language, the logarithm of the sum over all segmentations. p: (pieces + 2, languages)."""
    size, n = len(words[0]), len(words)
    ring = [np.ones((n, p.shape[1]))]  # sums for the last few ends, the newest last
    logs = np.zeros((n, p.shape[1]))
    for at in range(0, size, BLOCK):
        lo = max(0, at - pieces.most + 1)
        lattice = pieces.lattice([w[lo : at + BLOCK] for w in words])
        for i in range(at + 1, min(size, at + BLOCK) + 1):
            total = np.zeros_like(logs)
            for k in range(1, min(len(lattice), i - lo) + 1):
                ids, some = lattice[k - 1]
                if some[i - k - lo]:
                    total += ring[-k] * p[ids[:, i - k - lo]]
            ring.append(total)
            del ring[: -pieces.most]
            if i % RESCALE == 0:
                logs += np.log(total)
                ring = [r / total for r in ring]
    return logs + np.log(ring[-1])


def expected(pieces: Pieces, words: list[str], p: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Expected piece counts of weighted words of one length under one language's p (pieces + 2)."""
    size, n, lattice = len(words[0]), len(words), pieces.lattice(words)

    def sums(ends: range, step: int) -> tuple[np.ndarray, np.ndarray]:
        """Sums from the start (step 1) or from the end (step -1), each divided by its entry's scale, and the logarithms of the scales."""
        out, logs, scale = np.zeros((size + 1, n)), np.zeros((size + 1, n)), np.zeros(n)
        out[ends[0] - step] = 1
        for done, i in enumerate(ends, 1):
            for k, (ids, some) in enumerate(lattice, 1):
                j = i - step * k
                start = min(i, j)
                if 0 <= j <= size and some[start]:
                    out[i] += out[j] * p[ids[:, start]] * (np.exp(logs[j] - scale) if done >= RESCALE else 1)
            logs[i] = scale
            if done % RESCALE == 0:
                scale = scale + np.log(out[i])
                out[i], logs[i] = 1, scale
        return out, logs

    alpha, alpha_logs = sums(range(1, size + 1), 1)
    beta, beta_logs = sums(range(size - 1, -1, -1), -1)
    whole = alpha_logs[size] + np.log(alpha[size])
    out = np.zeros(len(p))
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for k, (ids, some) in enumerate(lattice, 1):
        for s in np.flatnonzero(some):
            share = np.exp(alpha_logs[s] + beta_logs[s + k] - whole) * weights
            found.append((ids[:, s], alpha[s] * p[ids[:, s]] * beta[s + k] * share))
            if len(found) * n >= BATCH * 4:
                out += np.bincount(*map(np.concatenate, zip(*found)), len(p))
                found = []
    return out + np.bincount(*map(np.concatenate, zip(*found)), len(p)) if found else out


def batches_of(words: list[tuple], size_of) -> Iterator[list[tuple]]:
    """Words of one length together, at most BATCH characters at a time (one word at least)."""
    by: dict = defaultdict(list)
    for w in words:
        by[size_of(w)].append(w)
    for size, some in by.items():
        step = max(1, BATCH // (size[-1] if isinstance(size, tuple) else size))
        for at in range(0, len(some), step):
            yield some[at : at + step]


class Scorer:
    """Log-probabilities of words in all languages, remembered up to a bound; again for words with a letter and for plain ones, with their lengths and numbers."""

    def __init__(self, pieces: Pieces, p: np.ndarray, most: int = 400_000):
        self.pieces, self.p, self.most = pieces, p, most
        self.row: dict[str, int] = {}
        self.values = np.zeros((0, 3 * p.shape[1] + 4))

    def learn(self, words: set[str]) -> None:
        new = sorted(words)
        out = np.zeros((len(new), self.p.shape[1]))
        for some in batches_of([(START + w, i) for i, w in enumerate(new)], lambda x: len(x[0])):
            out[[i for _, i in some]] = log_forward(self.pieces, [w for w, _ in some], self.p)
        start = len(self.values)
        self.row.update(zip(new, range(start, start + len(new))))
        size = np.array([[len(w) + 1] for w in new], float).reshape(-1, 1)
        letters, plain = (np.array([[bool(f(w))] for w in new], float).reshape(-1, 1) for f in (has_letter, PLAIN.fullmatch))
        self.values = np.vstack([self.values, np.hstack([out, out * letters, out * plain, size * letters, size * plain, letters, plain])])

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Per text and language: the sum of its words' log-probabilities, and the fit."""
        if len(self.row) > self.most:
            self.row, self.values = {}, self.values[:0]
        cut = [words_of(t) for t in texts]
        self.learn(set().union(*cut).difference(self.row))
        row = self.row
        sums = np.array([self.values[np.fromiter(map(row.__getitem__, w), np.int64, len(w))].sum(axis=0) for w in cut])
        n = self.p.shape[1]
        of_letters, of_plain = (sums[:, n * i : n * (i + 1)] / np.maximum(sums[:, 3 * n + i - 1, None], 1) for i in (1, 2))
        return sums[:, :n], np.where(2 * sums[:, -1:] >= sums[:, -2:-1], of_plain, of_letters)


def words_of(text: str) -> list[str]:
    return text.lower().split()


def has_letter(text: str | None) -> bool:
    return bool(text and LETTER.search(text))


def smoothed(counts: np.ndarray, mix: float = 0.01) -> np.ndarray:
    """Piece probabilities per language from expected counts (pieces, languages), mixed with the pooled ones; two rows more."""
    pooled = counts.sum(axis=1) + 0.01
    p = (1 - mix) * counts / np.maximum(counts.sum(axis=0), 1e-9) + mix * (pooled / pooled.sum())[:, None]
    return np.vstack([p, np.zeros(p.shape[1]), np.full(p.shape[1], UNKNOWN)])


def rows_of(labelled: DataFrame, sample_docs: int | None = None, most_languages: int = 500) -> tuple[DataFrame | None, dict[str, int]]:
    """The labelled rows (lang, text), on request up to about so many of each language, and how many of each there are."""
    rows = labelled.where("lang is not null and text is not null").select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    totals = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).limit(most_languages + 1).collect()}  # a row per language
    langs = sorted(totals)
    if not langs:
        return None, {}
    if len(langs) > most_languages:
        raise ValueError(f"more than {most_languages} labels")
    if sample_docs is None:
        return rows, totals
    share = F.create_map(*(x for k in langs for x in (F.lit(k), F.lit(min(1.0, sample_docs / totals[k])))))
    return rows.where(F.pmod(F.xxhash64("text"), F.lit(1_000_003)) < share[F.col("lang")] * 1_000_003), totals


def fit(labelled: DataFrame, vocabulary: str, sample_docs: int | None = None, rounds: int = 3, most_languages: int = 500) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, their piece probabilities and log shares, from rows (text, lang) with a letter and a label."""
    learned, totals = rows_of(labelled, sample_docs, most_languages)
    langs = sorted(totals)
    if not langs:
        return [], np.zeros((0, 0)), np.zeros(0)
    context = labelled.sparkSession.sparkContext
    number = {k: i for i, k in enumerate(langs)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, Counter] = defaultdict(Counter)

        def counted() -> Iterator[pa.RecordBatch]:
            for lang, words in seen.items():
                names, n = list(words), np.fromiter(words.values(), np.int64, len(words))
                for at in range(0, len(names), 1 << 16):
                    some = names[at : at + (1 << 16)]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), lang, np.int32)), pa.array(some), pa.array(n[at : at + (1 << 16)])], ["lang", "word", "n"])
            seen.clear()

        size = 0
        for b in batches:
            for lang, text in zip(*(c.to_pylist() for c in b.columns)):
                seen[number[lang]].update(words_of(text))
                size += len(text)
                if size >= COUNTED:
                    yield from counted()
                    size = 0
        yield from counted()

    words = learned.select("lang", "text").mapInArrow(count, "lang int, word string, n long")
    # A task has the words of few languages, so it gives out few counts; in order of length, so that a batch has many words of each.
    words = words.groupBy("lang", "word").agg(F.sum("n").alias("n")).repartitionByRange("lang", "word").sortWithinPartitions("lang", F.length("word")).persist()

    def e_step(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            pieces, p = Pieces(vocabulary), shared.value
            table = p if len(p) else np.vstack([np.full((pieces.n, len(langs)), 1 / pieces.n), np.zeros(len(langs)), np.full(len(langs), UNKNOWN)])
            total = np.zeros((pieces.n + 2, len(langs)))
            for b in batches:
                rows = [(lang, START + word, n) for lang, word, n in zip(*(c.to_pylist() for c in b.columns))]
                for some in batches_of(rows, lambda x: (x[0], len(x[1]))):
                    lang = some[0][0]
                    total[:, lang] += expected(pieces, [w for _, w, _ in some], table[:, lang], np.array([n for *_, n in some], float))
            piece, lang = np.nonzero(total[: pieces.n])
            yield pa.RecordBatch.from_arrays([pa.array(piece.astype(np.int32)), pa.array(lang.astype(np.int32)), pa.array(total[piece, lang])], ["piece", "lang", "n"])

        return run

    p = np.zeros((0, len(langs)))
    size = Pieces(vocabulary).n
    for _ in range(rounds):
        got = words.mapInArrow(e_step(context.broadcast(p)), "piece int, lang int, n double").groupBy("piece", "lang").agg(F.sum("n").alias("n")).toPandas()
        counts = np.zeros((size, len(langs)))
        counts[got["piece"], got["lang"]] = got["n"]
        p = smoothed(counts)
    words.unpersist()
    n = np.array([totals[k] for k in langs], float)
    return langs, p, np.log(n / n.sum())


def fit_bounds(fits: DataFrame) -> dict[str, float]:
    """The least fit of each language, from the fits (lang, fit) of all its labelled rows; nothing that is seen in under a twentieth of them moves it.

    The quantiles are those of all rows, of fits in steps of STEP, so what a language's are counted in is bounded.
    """
    counts = fits.groupBy("lang", (F.round(F.col("fit") / STEP) * STEP).alias("fit")).agg(F.count(F.lit(1)).alias("n"))
    rows = counts.groupBy("lang").agg(F.percentile("fit", F.array(F.lit(0.5), F.lit(0.05)), F.col("n")).alias("q")).collect()  # a row per language
    return {r["lang"]: r["q"][0] - max(SPREADS * (r["q"][0] - r["q"][1]), LEAST_DISTANCE) for r in rows}


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray, np.ndarray], vocabulary: str, keep: tuple[str, ...] = ("doc_id",), with_fit: bool = False) -> DataFrame:
    """The columns ``keep`` of docs with lang_pred and score, and on request fit (null for ``und``), in one pass over docs."""
    langs, p, prior = model
    names = [*keep, "lang_pred", "score", *["fit"] * with_fit]
    slim = docs.select(*keep, F.col("text").cast("string").alias("__text"))
    schema = T.StructType([*slim.schema.fields[:-1], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), *[T.StructField("fit", T.DoubleType())] * with_fit])

    shared = docs.sparkSession.sparkContext.broadcast(p)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(Pieces(vocabulary), shared.value) if langs else None
        for b in batches:
            texts = b.column(len(keep)).to_pylist()
            pred, score, fits = ["und"] * len(texts), np.zeros(len(texts)), [None] * len(texts)
            known = [i for i, t in enumerate(texts) if has_letter(t)] if scorer else []
            for at in range(0, len(known), 512):
                some = known[at : at + 512]
                logs, means = scorer([texts[i] for i in some])
                logs = logs + prior
                logs -= logs.max(axis=1, keepdims=True)
                post = np.exp(logs)
                post /= post.sum(axis=1, keepdims=True)
                for i, best, s, mean in zip(some, post.argmax(axis=1), post.max(axis=1), means):
                    pred[i], score[i], fits[i] = langs[best], s, float(mean[best])
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(pred, pa.string()), pa.array(score), *[pa.array(fits, pa.float64())] * with_fit], names)

    return slim.mapInArrow(run, schema)


def held_out(doc_id: str = "doc_id"):
    """True for the third of the documents that training leaves out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def identify(docs: DataFrame, vocabulary: str, keep: tuple[str, ...] = ("doc_id",), **fitting) -> DataFrame:
    """Fit on the documents that aren't held out, predict all: the columns ``keep``, lang_pred, score and held_out."""
    model = fit(docs.where(~held_out()).select("text", "lang"), vocabulary, **fitting)
    return predict(docs, model, vocabulary, keep).withColumn("held_out", held_out())


def identify_known(docs: DataFrame, vocabulary: str, keep: tuple[str, ...] = ("doc_id",), **fitting) -> DataFrame:
    """As identify(), but with fit and known: whether the text's fit reaches the bound of its language. Each text is read once; bounds are those of all labelled rows."""
    model = fit(docs.where(~held_out()).select("text", "lang"), vocabulary, **fitting)
    marked = docs.withColumn("__label", F.when(~held_out(), F.col("lang").cast("string")))
    seen = materialise(predict(marked, model, vocabulary, (*keep, "__label"), with_fit=True), "languages")
    bounds = fit_bounds(seen.where(F.col("__label") == F.col("lang_pred")).where("fit is not null").select(F.col("lang_pred").alias("lang"), "fit"))
    least = F.coalesce(*(F.when(F.col("lang_pred") == k, F.lit(v)) for k, v in bounds.items()), F.lit(float("inf")))
    return seen.drop("__label").withColumn("known", F.coalesce(F.col("fit") >= least, F.lit(False)))
