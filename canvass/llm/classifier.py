"""A quality classifier whose scores lean on the sites that documents come from.

A logistic model of words and of the text's measures gives each document's own
evidence.  Sites have rates of good documents: a path's rate is drawn towards its
host's, and a host's towards the corpus's, as strongly as the spread between them
asks for (empirical Bayes by the method of moments).  A document's verdict adds its
evidence to what its path says.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canvass.llm.common import attach, stage
from canvass.llm.decontaminate import words_of
from canvass.llm.near_dups import word_hashes
from canvass.llm.quality_rules import measure

SAMPLE = 20_000  # labelled documents that the model is fitted on, by the order of their ids' hashes
BUCKETS = 1 << 16
DENSE = 7
ROUNDS, RATE, SHRINK = 400, 0.05, 1e-4
CHANCE = 5
EDGE = 1e-4  # probabilities stay this far from 0 and 1


def features(texts: list[str | None]):
    """Rows of (buckets of distinct words, dense measures)."""
    import numpy as np

    n, chars, symbols, lines, copies, repeats = (np.array(c, float) for c in measure(texts))
    some = np.maximum(n, 1)
    words = [words_of(t) for t in texts]
    buckets = [np.unique(word_hashes(w) % np.uint64(BUCKETS)).astype(np.int32) for w in words]
    kinds = np.array([len(set(w)) / max(1, len(w)) for w in words])
    dense = np.stack([np.log1p(n) / 5, np.minimum(chars / some, 20) / 5, np.minimum(symbols / some, 3), copies / np.maximum(lines, 1),
                      repeats / some, kinds, np.ones(len(n))], axis=1) if len(texts) else np.zeros((0, DENSE))
    return buckets, dense


def fit(buckets, dense, good):
    """Weights of a logistic model, by gradient steps of the Adam rule.

    Buckets whose documents are good no more or less often than chance allows
    (``CHANCE`` deviations) get no weight, or noise would be learnt by heart.
    """
    import numpy as np

    sizes = np.array([len(b) for b in buckets], np.int64)
    flat = np.concatenate(buckets).astype(np.int64)
    row = np.repeat(np.arange(len(buckets)), sizes)
    rate = np.clip(good.mean(), 0.01, 0.99)
    held = np.bincount(flat, minlength=BUCKETS)
    off = np.bincount(flat, weights=good[row], minlength=BUCKETS) - held * rate
    telling = np.abs(off) > CHANCE * np.sqrt(np.maximum(held, 1) * rate * (1 - rate))
    flat, row = flat[telling[flat]], row[telling[flat]]
    w, d = np.zeros(BUCKETS), np.zeros(DENSE)
    m, v = np.zeros(BUCKETS + DENSE), np.zeros(BUCKETS + DENSE)
    for step in range(1, ROUNDS + 1):
        z = np.bincount(row, weights=w[flat], minlength=len(buckets)) + dense @ d
        miss = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - good
        slope = np.concatenate([np.bincount(flat, weights=miss[row], minlength=BUCKETS) / len(good) + SHRINK * w,
                                dense.T @ miss / len(good)])
        m = 0.9 * m + 0.1 * slope
        v = 0.999 * v + 0.001 * slope**2
        move = RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, d = w - move[:BUCKETS], d - move[BUCKETS:]
    return w, d


def train(docs: DataFrame, labels: DataFrame):
    """Fit on at most ``SAMPLE`` labelled documents; without any, no evidence (zero weights)."""
    import numpy as np

    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(
        F.min(F.when((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0), 1).otherwise(0)).alias("good"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
    rows = docs.select(F.col("doc_id").alias("_d"), "text").join(
        stage(chosen, "sample"), F.col("_d") == F.col("doc_id")).select("text", "good")
    frame, _ = attach(rows, "buckets binary, dense binary", _packed, "text")
    # at most SAMPLE documents; sorted, so that the sums do not depend on how rows arrive
    got = sorted({(bytes(b), bytes(d), g) for g, b, d in frame.select("_1", "buckets", "dense").collect()})
    if not got:
        return np.zeros(BUCKETS), np.zeros(DENSE)
    return fit([np.frombuffer(b, np.int32) for b, _, _ in got], np.array([np.frombuffer(d) for _, d, _ in got]),
               np.array([g for _, _, g in got], float))


def _packed(texts):
    buckets, dense = features(texts)
    return [b.tobytes() for b in buckets], [d.tobytes() for d in dense]


def evidence(docs: DataFrame, weights) -> DataFrame:
    """Each document's own probability of being good, with its host and path."""
    import numpy as np

    sent = docs.sparkSession.sparkContext.broadcast(weights)  # BUCKETS + DENSE numbers

    def fn(texts):
        w, d = sent.value
        buckets, dense = features(texts)
        z = np.array([w[b].sum() for b in buckets]) + (dense @ d if len(texts) else 0)
        return [np.clip(1 / (1 + np.exp(-np.clip(z, -30, 30))), EDGE, 1 - EDGE).tolist()]

    frame, _ = attach(docs.select("doc_id", "host", "path", "text"), "own double", fn, "text")
    return frame.drop("_3").withColumnsRenamed({"_0": "doc_id", "_1": "host", "_2": "path"})


def strength(groups: DataFrame, prior: Column) -> Column:
    """How many documents a group's prior rate counts for, from the spread of the groups about it."""
    n, rate = F.col("n"), F.col("good") / F.col("n")
    noise = F.sum(prior * (1 - prior)) / F.sum(n)
    spread = F.sum(n * (rate - prior) ** 2) / F.sum(n) - noise
    inside = F.sum(n * prior * (1 - prior)) / F.sum(n)
    # no more spread than chance gives: groups are alike, and lean on the prior fully
    return F.greatest(F.lit(0.0), F.least(F.lit(1e9), F.when(spread > inside / 1e9, inside / spread - 1).otherwise(1e9)))


def sites(scored: DataFrame) -> DataFrame:
    """Rates of every path, after those of hosts and of the corpus: grouped sums of sums."""
    path = stage(scored.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.sum("own").alias("good")), "paths")
    host = path.groupBy(F.col("host").alias("_host")).agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    every = path.agg((F.sum("good") / F.sum("n")).alias("base"))
    row = stage(every, "corpus")  # one row
    base = row.first()[0] if not row.isEmpty() else None
    base = 0.5 if base is None else base
    pull = host.agg(strength(host, F.lit(base))).first()[0]
    pull = 0.0 if pull is None else pull
    host = host.select("_host", ((F.col("good") + pull * base) / (F.col("n") + pull)).alias("host_rate"))
    both = path.join(host, path["host"].eqNullSafe(host["_host"])).drop("_host")
    near = both.agg(strength(both, F.col("host_rate"))).first()[0]
    near = 0.0 if near is None else near
    rate = (F.col("good") + near * F.col("host_rate")) / (F.col("n") + near)
    return both.select(F.col("host").alias("_h"), F.col("path").alias("_p"), "host_rate", rate.alias("path_rate"),
                       F.lit(base).alias("base_rate"))


def logit(p: Column) -> Column:
    q = F.greatest(F.lit(EDGE), F.least(F.lit(1 - EDGE), p))
    return F.ln(q / (1 - q))


def classify(docs: DataFrame, labels: DataFrame, host: Column, path: Column) -> DataFrame:
    """One row per document: own evidence, rates of its host and path, posterior and verdict.

    Null and empty texts are judged by their measures like any other.  Null hosts and
    paths are sites of their own.  Without labels the evidence is even and so are the
    rates.  Repeated rows count each for itself; no rows give none.
    """
    rows = docs.select("doc_id", host.alias("host"), path.alias("path"), "text")
    scored = stage(evidence(rows, train(docs, labels)), "evidence")
    rates = stage(sites(scored), "rates")
    both = scored.join(rates, scored["host"].eqNullSafe(rates["_h"]) & scored["path"].eqNullSafe(rates["_p"]))
    z = logit(F.col("own")) + logit(F.col("path_rate")) - logit(F.col("base_rate"))
    return both.withColumn("good", 1 / (1 + F.exp(-z))).select(
        "doc_id", "host", "path", "own", "host_rate", "path_rate", "good", (F.col("good") >= 0.5).alias("kept"))
