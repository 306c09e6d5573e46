"""Reading level of documents by harmonic propagation over a sentence-word graph.

Nodes are the English sentences and their words. Graded examples are sentences at the ends and in the middle of length and word length: short ones of
short words are clamped to 0, middling ones to 0.5, long ones of long words to 1; all others are free. Each iteration sets every word to the
mean of its sentences and every free sentence to the mean of its words, until difficulties rest: the harmonic function with the
examples as boundary. A sentence's length is no node, so a free sentence, and in the end every sentence, is graded by its words alone. Words are
hashed to SLOTS nodes, so the word side of the graph is a vector of proven size; an iteration is one pass over the sentences, summed up per slot in
each task before the shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, process_state
from .language import _profiles, sentence_spans, text_language

SLOTS = 1 << 17
LEVELS = ("plain", "ordinary", "legal")
#: Iterations end when the word nodes move less than this on average; LONGEST is an error, not a cut.
SETTLED, LONGEST = 1e-3, 200
#: Clamped examples: (difficulty, least words, most words, least mean word length, most mean word length).
EXAMPLES = ((0.0, 4, 10, 0.0, 4.2), (0.5, 14, 24, 4.7, 5.8), (1.0, 35, 120, 6.6, 20.0))
_WORD = re.compile(r"[^\W\d_]+")


def sentences(documents: DataFrame, prototypes: np.ndarray) -> DataFrame:
    """doc_id, words, clamp (null if free), nodes: the sentences of at least three words of the documents whose text is English."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        profiles, known = _profiles(prototypes), process_state("slots")
        for b in batches:
            if len(known) > 500_000:
                known.clear()
            ids, n, clamp, nodes, ends = [], [], [], [], [0]
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                if text_language(text, profiles) != "en":
                    continue
                for s, e in sentence_spans(text):
                    words = _WORD.findall(text[s:e].lower())
                    if len(words) < 3:
                        continue
                    k = len(words)
                    mean = sum(map(len, words)) / k
                    ids.append(doc)
                    n.append(k)
                    clamp.append(next((y for y, a, z, lo, hi in EXAMPLES if a <= k <= z and lo <= mean <= hi), None))
                    for w in set(words):
                        slot = known.get(w)
                        if slot is None:
                            slot = known[w] = crc32(w.encode()) % SLOTS
                        nodes.append(slot)
                    ends.append(len(nodes))
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(nodes, pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n, pa.int32()), pa.array(clamp, pa.float32()), lists], ["doc_id", "words", "clamp", "nodes"])

    rows = documents.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull() & (F.col("text") != "")).select("doc_id", "text")
    return rows.mapInArrow(run, "doc_id long, words int, clamp float, nodes array<int>")


def _difficulty(b: pa.RecordBatch, u: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Free difficulty, clamp, nodes, size of each sentence."""
    offsets = b.column("nodes").offsets.to_numpy().astype(np.int64)
    nodes = b.column("nodes").values.to_numpy()[offsets[0] : offsets[-1]]
    size = np.diff(offsets)
    sums = np.concatenate([[0.0], np.cumsum(u[nodes])])
    free = (sums[offsets[1:] - offsets[0]] - sums[offsets[:-1] - offsets[0]]) / size
    return free, b.column("clamp").to_numpy(zero_copy_only=False).astype(np.float64), nodes, size


def propagate(rows: DataFrame, tolerance: float = SETTLED) -> tuple[np.ndarray, np.ndarray]:
    """Difficulty of every word slot, and the mean free difficulty of each kind of example."""
    spark = rows.sparkSession
    u = np.full(SLOTS, 0.5)
    centres = np.array([y for y, *_ in EXAMPLES])
    for i in range(LONGEST):
        shared = spark.sparkContext.broadcast((u, i))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            u, i = shared.value
            top, low = np.zeros(SLOTS + 3), np.zeros(SLOTS + 3)
            for b in batches:
                if not len(b):
                    continue
                free, clamp, nodes, size = _difficulty(b, u)
                held = ~np.isnan(clamp)
                y = np.where(held, clamp, free)
                weight = np.where(held, 1.0, 0.0 if i == 0 else 0.5)  # the first pass knows the examples only
                top[:SLOTS] += np.bincount(nodes, np.repeat(y * weight, size), SLOTS)
                low[:SLOTS] += np.bincount(nodes, np.repeat(weight, size), SLOTS)
                for k, (level, *_) in enumerate(EXAMPLES):
                    top[SLOTS + k] += free[clamp == level].sum()
                    low[SLOTS + k] += (clamp == level).sum()
            at = np.flatnonzero(low)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(top[at]), pa.array(low[at])], ["slot", "top", "low"])

        sums = rows.mapInArrow(run, "slot long, top double, low double").groupBy("slot").agg(F.sum("top").alias("top"), F.sum("low").alias("low")).toPandas()
        slot, ratio = sums["slot"].to_numpy(np.int64), (sums["top"] / sums["low"]).to_numpy()
        new = np.full(SLOTS, 0.5)
        new[slot[slot < SLOTS]] = ratio[slot < SLOTS]
        for k in range(len(EXAMPLES)):
            if i and (slot == SLOTS + k).any():
                centres[k] = ratio[slot == SLOTS + k][0]
        at = slot[slot < SLOTS]
        moved = float(np.abs(new[at] - u[at]).mean()) if len(at) else 0.0
        u = new
        shared.unpersist()
        if i and moved < tolerance:
            return u, centres
    raise RuntimeError("difficulties did not settle")


def reading_levels(documents: DataFrame, prototypes: np.ndarray) -> DataFrame:
    """doc_id, level, difficulty, sentences, legal_share: one row per document in English by its text.

    difficulty is the word-weighted mean of the sentences' free difficulty; the level is the one
    that holds most of the words, a sentence's level being the nearest kind of example. Documents without a sentence of three words, in other
    languages, null or blank have no row. A document lies in one task, its sums are combined before the shuffle.
    """
    rows = cut(sentences(documents, prototypes))
    u, centres = propagate(rows)
    order = np.sort(centres)
    low, high = float((order[0] + order[1]) / 2), float((order[1] + order[2]) / 2)
    shared = documents.sparkSession.sparkContext.broadcast(u)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                free = _difficulty(b, shared.value)[0]
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("words"), pa.array(free)], ["doc_id", "words", "y"])

    scored = rows.mapInArrow(run, "doc_id long, words int, y double")
    docs = scored.groupBy("doc_id").agg(
        F.count("*").alias("sentences"),
        F.sum("words").alias("_n"),
        F.sum(F.col("words") * F.col("y")).alias("_y"),
        F.sum(F.when(F.col("y") < low, F.col("words")).otherwise(0)).alias("_plain"),
        F.sum(F.when(F.col("y") >= high, F.col("words")).otherwise(0)).alias("_legal"),
    )
    rest = F.col("_n") - F.col("_plain") - F.col("_legal")
    level = F.when(F.col("_legal") * 2 > F.col("_n"), LEVELS[2]).when(F.col("_plain") >= rest, LEVELS[0]).otherwise(LEVELS[1])
    return docs.select("doc_id", level.alias("level"), (F.col("_y") / F.col("_n")).alias("difficulty"), "sentences", (F.col("_legal") / F.col("_n")).alias("legal_share"))


def profile(levels: DataFrame) -> DataFrame:
    """level, documents, sentences, mean_difficulty."""
    return levels.groupBy("level").agg(F.count("*").alias("documents"), F.sum("sentences").alias("sentences"), F.avg("difficulty").alias("mean_difficulty"))
