"""Consensus labels from several annotators by the triplet moment method.

Votes are +1 (yes) and -1 (no). If annotators err independently given the true label y,
then the covariance of two annotators' votes - their agreement corrected for the agreement
that their yes-rates alone would give - is a product w_i * w_j, where
w_i = (sens_i + spec_i - 1) * sd(y), with sd(y) = 2 sqrt(pi (1 - pi)). Any three annotators thus give
w_i^2 = c_ij c_ik / c_jk; all triplets of an annotator enter one least-squares estimate, weighted by their common items. Sensitivity and specificity
follow from w_i, the annotator's own yes-rate and the share pi of true yes; items are labelled by the sum of log-odds weights.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

#: Annotators, those of most votes, whose covariances are a matrix on the driver (8 MB). Triplets with any other annotator are summed in the cluster.
CORE = 1000
#: Pairs of votes that are laid out at once.
PAIRS = 1 << 21
#: Shares of true yes at which the mean posterior is worked out.
SHARES = np.linspace(0.02, 0.98, 97)


def vote(col):
    """+1 for a spelling of yes, -1 for one of no, else null."""
    low = F.lower(F.regexp_replace(col, r"(?U)[\s\p{Punct}]", ""))
    return F.when(low.isin("yes", "y"), 1).when(low.isin("no", "n"), -1).cast("int")


def votes_of(second_annotation: DataFrame) -> DataFrame:
    """(question_id, annotator, vote): one vote of each person and each model per question.

    Of rows with the same question, person and model only the one with the latest `dated` counts
    (an equal date is settled by the larger row in order of mine, theirs); then the latest vote of each annotator.
    Void labels give no vote. People and models are told apart by a prefix. Aggregation is by
    max over a struct, combined before the shuffle, so a hot question or person is no hot task.
    """
    latest = second_annotation.where(F.col("question_id").isNotNull()).groupBy("question_id", "mine_by", "model").agg(
        F.max(F.struct(F.col("dated"), F.col("mine"), F.col("theirs"))).alias("r")
    )
    two = latest.select(
        "question_id",
        F.explode(
            F.array(
                F.struct(F.concat(F.lit("person:"), "mine_by").alias("annotator"), vote(F.col("r.mine")).alias("vote"), F.col("r.dated").alias("dated")),
                F.struct(F.concat(F.lit("model:"), "model").alias("annotator"), vote(F.col("r.theirs")).alias("vote"), F.col("r.dated").alias("dated")),
            )
        ).alias("v"),
    ).select("question_id", "v.*")
    return (
        two.where(F.col("vote").isNotNull() & F.col("annotator").isNotNull())
        .groupBy("question_id", "annotator")
        .agg(F.max(F.struct("dated", "vote"))["vote"].alias("vote"))
    )


def _flat(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Annotators, votes and row offsets of a batch of items."""
    lists = b.column("votes")
    offsets = lists.offsets.to_numpy().astype(np.int64)
    votes = lists.flatten()
    return votes.field("i").to_numpy().astype(np.int64), votes.field("vote").to_numpy().astype(np.float64), offsets - offsets[0]


def _pairs(items: DataFrame, k: int) -> DataFrame:
    """i > j, n, v, q: every two annotators with two common items or more, their number, n times the covariance c of their votes, and n c^2 less the variance it would have by chance.

    Summed in parts of a batch before the shuffle, so an item with many votes is no large matrix. An item holds at most one vote per annotator.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            who, v, offsets = _flat(b)
            size = np.diff(offsets)
            per, first = np.repeat(size, size), np.repeat(offsets[:-1], size)
            ends, start = np.cumsum(per), 0
            while start < len(who):
                end = max(start + 1, int(np.searchsorted(ends, ends[start] - per[start] + PAIRS, "right")))
                part = per[start:end]
                i = np.repeat(np.arange(start, end), part)
                j = np.arange(len(i)) - np.repeat(np.cumsum(part) - part, part) + np.repeat(first[start:end], part)
                keep = who[i] > who[j]
                i, j, start = i[keep], j[keep], end
                pair, at = np.unique(who[i] * k + who[j], return_inverse=True)
                sums = [np.bincount(at, x, len(pair)) for x in (np.ones(len(i)), v[i], v[j], v[i] * v[j])]
                yield pa.RecordBatch.from_arrays([pa.array(pair // k), pa.array(pair % k), *map(pa.array, sums)], ["i", "j", "n", "sx", "sy", "sxy"])

    summed = items.mapInArrow(run, "i long, j long, n double, sx double, sy double, sxy double").groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("n", "sx", "sy", "sxy")])
    x, y = F.col("sx") / F.col("n"), F.col("sy") / F.col("n")
    c = F.col("sxy") / F.col("n") - x * y
    return summed.where(F.col("n") >= 2).select("i", "j", "n", (F.col("n") * c).alias("v"), (F.col("n") * c * c - (1 - x * x) * (1 - y * y)).alias("q"))


def _outer_triplets(pairs: DataFrame, core: int) -> DataFrame:
    """i, top, low: each annotator's sums over the triplets of which one annotator at least is outside the core.

    A triplet is found once, from its annotator of fewest votes (the highest number), as that one has the fewest pairs.
    """
    low, mid, base = pairs.where(F.col("i") >= core).alias("low"), pairs.where(F.col("i") >= core).alias("mid"), pairs.alias("base")
    found = low.join(mid, F.col("low.i") == F.col("mid.i")).where(F.col("mid.j") > F.col("low.j")).join(base, (F.col("base.i") == F.col("mid.j")) & (F.col("base.j") == F.col("low.j")))

    def sums(who: str, one: str, two: str, across: str):
        return F.struct(F.col(who).alias("i"), (2 * F.col("low.v") * F.col("mid.v") * F.col("base.v")).alias("top"), (2 * F.col(f"{one}.n") * F.col(f"{two}.n") * F.col(f"{across}.q")).alias("low"))

    each = F.explode(F.array(sums("low.i", "low", "mid", "base"), sums("mid.j", "mid", "base", "low"), sums("low.j", "low", "base", "mid"))).alias("t")
    return found.select(each).groupBy("t.i").agg(F.sum("t.top").alias("top"), F.sum("t.low").alias("low"))


def _product(pairs: DataFrame, x: np.ndarray) -> np.ndarray:
    """The matrix of the pairs' v, times x: how far each annotator agrees with the others, who count x."""
    shared = pairs.sparkSession.sparkContext.broadcast(x)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x, total = shared.value, np.zeros(len(shared.value))
        for b in batches:
            i, j, v = (b.column(c).to_numpy() for c in ("i", "j", "v"))
            total += np.bincount(i, v * x[j], len(x)) + np.bincount(j, v * x[i], len(x))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["i", "y"])

    found = pairs.mapInArrow(run, "i long, y double").groupBy("i").agg(F.sum("y").alias("y")).toPandas()
    y = np.zeros(len(x))
    y[found["i"].to_numpy(int)] = found["y"]
    return y


def _inner_triplets(n: np.ndarray, v: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each annotator's sums over the triplets within a matrix of pairs."""
    return ((v @ v) * v).sum(1), ((n @ q) * n).sum(1)


def _size(top: np.ndarray, low: np.ndarray) -> np.ndarray:
    return np.sqrt(np.clip(np.divide(top, low, out=np.zeros(len(top)), where=low > 0), 0, 1))


def _signs(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Signs of the sizes w that follow the agreement with the others."""
    sign = np.zeros(len(w))
    if w.any():
        sign[int(np.argmax(w))] = 1
        for i in np.argsort(-w):
            if not sign[i]:
                sign[i] = 1 if v[i] @ (w * sign) >= 0 else -1
        for _ in range(10):
            sign = np.where(v @ (w * sign) >= 0, 1.0, -1.0)
        if (sign * w).sum() < 0:
            sign = -sign
    return sign


def solve_triplets(n: np.ndarray, c: np.ndarray, noise: np.ndarray) -> np.ndarray:
    """Signed w_i from counts n, covariances c and their chance variances; 0 where an annotator tells nothing.

    Least squares over all triplets, each weighted by the items common to its pairs: w_i^2 = sum(c_ij c_ik c_jk) / sum(c_jk^2 - chance).
    Signs follow the agreement with the others, the majority of whose weight is taken to be better than chance.
    """
    if not len(n):
        return np.zeros(0)
    n = np.where(n >= 2, n, 0)
    w = _size(*_inner_triplets(n, n * c, np.where(n > 0, n * c * c - noise, 0)))
    return _signs(n * c, w) * w


def _weights(pairs: DataFrame, k: int, core: int) -> np.ndarray:
    """Signed w_i of all k annotators, as solve_triplets has them for a matrix: triplets within the core by matrix products, all others in the cluster."""
    pairs = written(pairs) if k > core else pairs
    inner = pairs.where(F.col("i") < core).toPandas()
    n, v, q = (np.zeros((core, core)) for _ in range(3))
    i, j = inner["i"].to_numpy(int), inner["j"].to_numpy(int)
    for matrix, column in ((n, "n"), (v, "v"), (q, "q")):
        matrix[i, j] = matrix[j, i] = inner[column]
    top, low = np.zeros(k), np.zeros(k)
    top[:core], low[:core] = _inner_triplets(n, v, q)
    if k == core:
        w = _size(top, low)
        return _signs(v, w) * w
    outer = _outer_triplets(pairs, core).toPandas()
    at = outer["i"].to_numpy(int)
    top[at] += outer["top"]
    low[at] += outer["low"]
    w, sign = _size(top, low), np.zeros(k)
    if not w.any():
        return w
    sign[:core] = _signs(v, w[:core])
    if not sign.any():
        sign[int(np.argmax(w))] = 1
    # From the core to those who share items with it, and on to those who share items with these; whoever is not reached starts as better than chance.
    while (sign == 0).any():
        y = _product(pairs, w * sign)
        fresh = (sign == 0) & (y != 0)
        if not fresh.any():
            break
        sign[fresh] = np.where(y[fresh] >= 0, 1.0, -1.0)
    sign[sign == 0] = 1
    for _ in range(10):
        new = np.where(_product(pairs, w * sign) >= 0, 1.0, -1.0)
        if (new == sign).all():
            break
        sign = new
    return sign * w if (sign * w).sum() >= 0 else -sign * w


def reliability(w: np.ndarray, yes: np.ndarray, pi: float) -> tuple[np.ndarray, np.ndarray]:
    """Sensitivity and specificity of each annotator from w, its yes-rate and the share of true yes."""
    j = np.clip(w / (2 * np.sqrt(pi * (1 - pi))), -0.98, 0.98)
    return np.clip(yes + (1 - pi) * j, 0.01, 0.99), np.clip(1 - yes + pi * j, 0.01, 0.99)


def log_odds(who: np.ndarray, v: np.ndarray, offsets: np.ndarray, w: np.ndarray, yes: np.ndarray, pi: float) -> np.ndarray:
    """Log-odds of yes of each item, the prior's among them."""
    sens, spec = reliability(w, yes, pi)
    told = np.where(v > 0, np.log(sens / (1 - spec))[who], np.log((1 - sens) / spec)[who])
    return np.add.reduceat(told, offsets[:-1]) + np.log(pi / (1 - pi))


def consensus(second_annotation: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(items, annotators).

    items: question_id, label ('yes' or 'no'), p_yes, agreement (share of votes equal to the label), n_votes.
    annotators: annotator, kind, reliability (balanced accuracy), sensitivity, specificity, n_votes, chance-corrected weight.
    The share pi of true yes is the one that equals the mean posterior of all items; the means at SHARES come from one job over all votes. An item's votes
    are at most one per annotator, so they are gathered in a row. Items without a valid vote have no row. Ties go to yes. Fewer than three annotators, or
    votes of which no triplet tells anything: every annotator counts alike (majority). The annotators' own table (a row each) is on the driver; of the pairs
    only those of the CORE annotators with most votes are; the triplets of all others are summed in the cluster. Empty input gives empty results.
    """
    spark = second_annotation.sparkSession
    votes = written(votes_of(second_annotation))
    sums = votes.groupBy("annotator").agg(F.count("*").alias("n"), F.sum("vote").alias("s")).toPandas().sort_values(["n", "annotator"], ascending=[False, True], ignore_index=True)
    names, k = list(sums["annotator"]), len(sums)
    core = max(1, min(k, CORE))
    numbers = spark.createDataFrame([(a, i) for i, a in enumerate(names)], "annotator string, i long")
    numbered = votes.join(F.broadcast(numbers) if k <= 100_000 else numbers, "annotator")
    items = written(numbered.groupBy("question_id").agg(F.collect_list(F.struct("i", "vote")).alias("votes")))
    yes = ((sums["s"] / sums["n"]).to_numpy(float) + 1) / 2 if k else np.zeros(0)
    w = np.zeros(k)
    if k >= 3:
        w = _weights(_pairs(items, k), k, core)
    if not w.any():
        w[:] = 0.5
    told = spark.sparkContext.broadcast((w, yes))

    def posteriors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, yes = told.value
        for b in batches:
            if len(b):
                of = _flat(b)
                means = [(1 / (1 + np.exp(-log_odds(*of, w, yes, pi)))).sum() for pi in SHARES]
                yield pa.RecordBatch.from_arrays([pa.array(range(len(SHARES)), pa.int32()), pa.array(means), pa.array([len(b)] * len(SHARES), pa.int64())], ["share", "p", "n"])

    found = items.mapInArrow(posteriors, "share int, p double, n long").groupBy("share").agg((F.sum("p") / F.sum("n")).alias("p")).orderBy("share").toPandas()
    pi = 0.5
    for _ in range(1000 if len(found) else 0):
        new = float(np.clip(np.interp(pi, SHARES, found["p"]), SHARES[0], SHARES[-1]))
        pi, moved = new, abs(new - pi)
        if moved < 1e-6:
            break

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, yes = told.value
        for b in batches:
            if not len(b):
                continue
            who, v, offsets = _flat(b)
            odds = log_odds(who, v, offsets, w, yes, pi)
            size, ups = np.diff(offsets), np.add.reduceat((v > 0).astype(np.int64), offsets[:-1])
            same = np.where(odds >= 0, ups, size - ups) / size
            yield pa.RecordBatch.from_arrays([b.column("question_id"), pa.array(np.where(odds >= 0, "yes", "no").tolist(), pa.string()), pa.array(1 / (1 + np.exp(-odds))), pa.array(same), pa.array(size)], ["question_id", "label", "p_yes", "agreement", "n_votes"])

    labelled = items.mapInArrow(label, "question_id string, label string, p_yes double, agreement double, n_votes long")
    sens, spec = reliability(w, yes, pi)
    rows = [(a.split(":", 1)[1], a.split(":", 1)[0], float((sens[i] + spec[i]) / 2), float(sens[i]), float(spec[i]), int(sums["n"][i]), float(w[i])) for i, a in enumerate(names)]
    annotators = spark.createDataFrame(rows, "annotator string, kind string, reliability double, sensitivity double, specificity double, n_votes long, weight double")
    return labelled, annotators
