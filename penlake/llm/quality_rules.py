"""Host-level quality rules: rule failures by host, shrunk with an empirical beta prior, joined back to documents.

Each document is measured once (one pass over whole texts). A rule's failure rate at a host is replaced by its beta
posterior, whose mean is ``(failures + a) / (documents + a + b)``; a and b are fitted to all hosts by moments, so a host
with three documents isn't judged on three documents alone. What counts is how a host stands to the prior:

* strict, if the posterior mean lies more than ``strict_sd`` posterior standard deviations over the prior mean m: the
  host's documents that fail this rule go, elsewhere a failure of a rule that isn't a base rule is forgiven;
* refused, if the lower bound (mean less three deviations) lies over both ``worst_times`` m and ``worst_rate``: all
  documents of the host go.

A document that fails a base rule goes whatever its host.

Defined results: a null or empty text has no words and fails the base rule; a null host is no host, so its documents
are judged by the base rules alone; repeated rows are measured and counted as often as they come; an empty table gives
no rows; other columns of the input are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from penlake.llm.common import column, join_checked, map_batches, materialise

SYMBOLS = b"#*$%&|<>"
BLANKS = b"\x20\x09\x0a\x0b\x0c\x0d"
MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def repeat_words(words: list[bytes]) -> int:
    """Words inside 3-word windows that come twice or more; the first of them counts too."""
    if len(words) < 4:
        return 0
    ids: dict[bytes, int] = {}
    w = np.fromiter((ids.setdefault(x, len(ids)) for x in words), np.int64, len(words))
    _, pair = np.unique(w[:-1] * len(ids) + w[1:], return_inverse=True)
    _, window, n = np.unique(pair[:-1] * len(ids) + w[2:], return_inverse=True, return_counts=True)
    hit = np.zeros(len(words), bool)
    again = n[window] > 1
    for i in range(3):
        hit[i : len(words) - 2 + i] |= again
    return int(hit.sum())


def measure(text: str) -> tuple[int, int, int, int, int]:
    b = text.encode()
    words = b.split()  # of bytes: splits at just the six ASCII blanks
    lines = [x for x in b.split(b"\n") if x.strip()]
    return (
        len(words),
        len(text) - (len(b) - len(b.translate(None, BLANKS))),
        len(b) - len(b.translate(None, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeat_words(words),
    )


def measures(docs: DataFrame, host: str = "source") -> DataFrame:
    """doc_id, host and the five measures of each document."""

    def one(b: pa.RecordBatch) -> pa.RecordBatch:
        rows = [measure(t) if t else (0, 0, 0, 0, 0) for t in column(b, "text").to_pylist()]
        cols = [pa.array(c, pa.int64()) for c in zip(*rows)]
        return pa.RecordBatch.from_arrays(
            [column(b, "doc_id"), column(b, "host"), *cols],
            ["doc_id", "host", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"],
        )

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(host).cast("string").alias("host"), F.col("text").cast("string").alias("text"))
    return map_batches(slim, one, f"doc_id long, host string, {MEASURES}")


#: The rules by name, as SQL: true where a document fails.
RULES = {
    "short": "n_words < 50",
    "repetitive": "100 * n_repeat_words > 50 * n_words",
    "symbols": "10 * n_symbols > 3 * n_words",
    "dup_lines": "20 * n_dup_lines > n_words",
    "word_length": "n_words > 0 and (word_chars < 2 * n_words or word_chars > 15 * n_words)",
}


def host_verdicts(measured: DataFrame, strict_sd: float = 1.0, worst_times: float = 3.0, worst_rate: float = 0.3) -> DataFrame:
    """One row per host and rule: documents, failures, the posterior's rate and sd, and whether it's strict or refused.

    The prior of each rule has the mean m and variance v of the hosts' raw rates (weighted by documents):
    a + b = m (1 - m) / v - 1, kept between 1 and 10,000; a = m (a + b).
    """
    hosts = measured.where("host is not null").groupBy("host").agg(F.count("*").alias("n"), *(F.sum(F.expr(rule).cast("long")).alias(k) for k, rule in RULES.items()))
    long = hosts.select("host", "n", F.explode(F.array(*(F.struct(F.lit(k).alias("rule"), F.col(k).alias("failed")) for k in RULES))).alias("r")).select("host", "n", "r.*")
    m = F.sum("failed") / F.sum("n")
    prior = long.groupBy("rule").agg(m.alias("m"), F.sum(F.col("failed") * F.col("failed") / F.col("n")).alias("sq"), F.sum("n").alias("all"))
    v = F.greatest(F.col("sq") / F.col("all") - F.col("m") * F.col("m"), F.lit(1e-9))
    prior = prior.select("rule", "m", F.least(F.greatest(F.col("m") * (1 - F.col("m")) / v - 1, F.lit(1.0)), F.lit(10000.0)).alias("strength"))
    rate = (F.col("failed") + F.col("m") * F.col("strength")) / (F.col("n") + F.col("strength"))
    judged = long.join(F.broadcast(prior), "rule").withColumn("rate", rate)  # the prior has a row per rule
    judged = judged.withColumn("sd", F.sqrt(F.col("rate") * (1 - F.col("rate")) / (F.col("n") + F.col("strength") + 1)))
    refused = F.col("rate") - 3 * F.col("sd") > F.greatest(worst_times * F.col("m"), F.lit(worst_rate))
    return judged.select("host", "rule", "n", "failed", "rate", "sd", (F.col("rate") - strict_sd * F.col("sd") > F.col("m")).alias("strict"), refused.alias("refused"))


def quality_rules(docs: DataFrame, host: str = "source", **limits: float) -> DataFrame:
    """The measures of each document, base_failed, host_refused, host_failed (a strict rule of its host) and kept.

    The measures are written once and read for the host sums and for the join back. Only hosts that are strict or
    refused take part in that join; they're broadcast if a count shows that they are few.
    """
    measured = materialise(measures(docs, host), "quality")
    verdicts = host_verdicts(measured, **limits).where("refused or strict")
    hosts = verdicts.groupBy("host").agg(F.max("refused").alias("host_refused"), F.collect_set(F.when(F.col("strict"), F.col("rule"))).alias("strict"))  # at most a name per rule
    out = join_checked(measured, materialise(hosts, "hosts"), "host", "left")
    failed = F.expr(RULES["short"]) | F.expr(RULES["repetitive"])
    refused = F.coalesce("host_refused", F.lit(False))
    strictly = F.lit(False)
    for k, rule in RULES.items():
        strictly = strictly | (F.expr(rule) & F.coalesce(F.array_contains("strict", k), F.lit(False)))
    out = out.withColumns({"base_failed": failed, "host_refused": refused, "host_failed": strictly})
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "host_refused", "host_failed", (~F.col("base_failed") & ~F.col("host_refused") & ~F.col("host_failed")).alias("kept"),
    )
