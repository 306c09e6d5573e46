"""Evaluation texts inside training texts: CGK embedding, bit-sampling LSH, exact edit verification.

The CGK walk embeds a sequence of words so that edit distance becomes Hamming distance: a pointer walks over the
window; at step t it writes the word under it and moves on by a random bit of (t, word). Two windows a
few edits apart fall into step again and agree in most places. A repetition samples SAMPLED places of the walk and hashes the words
there; windows that share a hash in any repetition are candidates.

Windows have WINDOW words. Items are cut at every STRIDE-th word, documents at every word. Equal windows have equal walks whatever is sampled, so
a passage with WINDOW + STRIDE - 1 = 10 unchanged words in a row is a candidate for certain: every run of RUN = 12 equal words is, and every
passage of PASSAGE = 20 words with one word changed, put in or left out, as one of its sides has 10 words or more. So one repetition reaches a recall of 1
for up to one edit; for more edits there are REPETITIONS, and passages are found with the recall of the sampling. The walks of all windows of a batch advance together, one vector operation a step.

Document windows first pass a bit filter of the items' hashes (common.hash_filter). Only windows that pass are shuffled, each with the words around it.
Every candidate is verified there, a batch at a time: the run of equal words through the window, and the least edits of a passage of the item
that holds the window, from alignments of the words before and behind it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import filter_bits, hash_filter, passes, written
from .words import flat_words

RUN, PASSAGE, WINDOW, STRIDE, REPETITIONS, SAMPLED = 12, 20, 9, 2, 2, 20
_STEPS = 3 * WINDOW
#: Words of items up to which they are broadcast (16 MB); beyond it the candidates are shuffled to them.
BROADCAST_WORDS = 4_000_000
#: Words on either side of a window that are sent along.
AROUND = PASSAGE - WINDOW + 2


def _mix(x: np.ndarray, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ np.uint64(0x9E3779B97F4A7C15 * (seed + 1) % (1 << 64))) * np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(29)
        x *= np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(32))


def walks(words: np.ndarray, starts: np.ndarray, repetition: int, places: int = SAMPLED) -> np.ndarray:
    """The LSH hash of the window of WINDOW words at each start, over `places` sampled places of its walk."""
    sampled = set(np.random.default_rng(1009 + repetition).permutation(_STEPS)[:places].tolist())
    bits, content = _mix(words, repetition), _mix(words, 77)
    out = np.empty(len(starts), np.uint64)
    with np.errstate(over="ignore"):
        for s in range(0, len(starts), 1 << 15):  # few windows at a time stay in the processor's cache
            at = starts[s : s + (1 << 15)].copy()
            last = at + (WINDOW - 1)
            h = np.full(len(at), 1469598103934665603 + repetition, np.uint64)
            for t in range(max(sampled) + 1):
                inside = at <= last
                here = np.minimum(at, last)
                if t in sampled:
                    h = (h ^ np.where(inside, content[here], np.uint64(t))) * np.uint64(1099511628211)
                at += ((bits[here] >> np.uint64(t)) & np.uint64(1)).astype(np.int64)
            out[s : s + (1 << 15)] = h ^ (h >> np.uint64(31))
    return out


def _window_starts(offsets: np.ndarray, stride: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the windows in the flat words, and the row of each. With a stride the last window of a row is included."""
    sizes = np.diff(offsets)
    n = np.maximum(sizes - WINDOW + 1, 0)
    row = np.repeat(np.arange(len(n)), n)
    pos = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    if stride > 1:
        keep = (pos % stride == 0) | (pos == n[row] - 1)
        row, pos = row[keep], pos[keep]
    return offsets[row] + pos, row


def _fold(words: np.ndarray) -> np.ndarray:
    return (words >> np.uint64(32)).astype(np.uint32).view(np.int32)


def _stretches(words: np.ndarray, offsets: np.ndarray, starts: np.ndarray, row: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """The words around each window as a list, and how many of them come before it."""
    lo, hi = np.maximum(starts - AROUND, offsets[row]), np.minimum(starts + WINDOW + AROUND, offsets[row + 1])
    ends = np.concatenate([[0], np.cumsum(hi - lo)])
    at = np.arange(ends[-1]) - np.repeat(ends[:-1] - lo, hi - lo)
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(_fold(words)[at])), pa.array((starts - lo).astype(np.int8))


def item_windows(items: DataFrame, repetitions: int) -> DataFrame:
    """(hash, item, ipos) of every repetition of every window of items (item, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words, offsets = flat_words(b.column("text").to_pylist())
            starts, row = _window_starts(offsets, STRIDE)
            if not len(starts):
                continue
            ids, pos = b.column("item").take(pa.array(row)), pa.array((starts - offsets[row]).astype(np.int32))
            for r in range(repetitions):
                yield pa.RecordBatch.from_arrays([pa.array(walks(words, starts, r).view(np.int64)), ids, pos], ["hash", "item", "ipos"])

    return items.select("item", "text").mapInArrow(run, "hash long, item long, ipos int")


def item_words(items: DataFrame) -> DataFrame:
    """(item, iwords): the words of items (item, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words, offsets = flat_words(b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([b.column("item"), pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(_fold(words)))], ["item", "iwords"])

    return items.select("item", "text").mapInArrow(run, "item long, iwords array<int>")


def _halves(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (h & np.uint64(0xFFFFFFFF)).astype(np.uint32), (h >> np.uint64(32)).astype(np.uint32) ^ np.uint32(0x5BD1E995)


def _filter(windows: DataFrame, count: int) -> np.ndarray:
    """Bit filter of both halves of the windows' hashes."""

    def halves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([np.concatenate(_halves(b.column("hash").to_numpy().view(np.uint64))).tobytes()], pa.binary())], ["h"])

    return hash_filter(windows.select("hash").mapInArrow(halves, "h binary"), filter_bits(2 * count, 32))[0]


def document_windows(docs: DataFrame, filter_: np.ndarray, repetitions: int) -> DataFrame:
    """(hash, doc_id, pos, before, words) of the windows of docs (doc_id, text) that pass the filter."""
    shared = docs.sparkSession.sparkContext.broadcast(filter_)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words, offsets = flat_words(b.column("text").to_pylist())
            starts, row = _window_starts(offsets, 1)
            for r in range(repetitions if len(starts) else 0):
                h = walks(words, starts, r)
                low, high = _halves(h)
                hit = np.flatnonzero(passes(shared.value, low))
                hit = hit[passes(shared.value, high[hit])]
                if len(hit):
                    s, d = starts[hit], row[hit]
                    around, before = _stretches(words, offsets, s, d)
                    yield pa.RecordBatch.from_arrays([pa.array(h[hit].view(np.int64)), b.column("doc_id").take(pa.array(d)), pa.array((s - offsets[d]).astype(np.int32)), before, around], ["hash", "doc_id", "pos", "before", "words"])

    return docs.select("doc_id", "text").mapInArrow(run, "hash long, doc_id long, pos int, before byte, words array<int>")


def _laid(lists: pa.Array, before: np.ndarray, none: int) -> np.ndarray:
    """Words (rows, AROUND + WINDOW + AROUND) with the window, which `before` words precede, in the middle; `none` where there are no words."""
    offsets = lists.offsets.to_numpy().astype(np.int64)
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    size = np.diff(offsets)
    out = np.full((len(size), 2 * AROUND + WINDOW), none, np.int64)
    row = np.repeat(np.arange(len(size)), size)
    at = np.arange(len(flat)) - np.repeat(offsets[:-1] - offsets[0], size)
    column = AROUND - before[row] + at
    seen = (column >= 0) & (column < out.shape[1])
    out[row[seen], column[seen]] = flat[seen]
    return out


def runs_through(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First column and length of the longest run of equal words of two laid-out texts."""
    best, start, now = np.zeros(len(a), np.int64), np.zeros(len(a), np.int64), np.zeros(len(a), np.int64)
    for c, same in enumerate((a == b).T):
        now = (now + 1) * same
        more = now > best
        best[more], start[more] = now[more], c - now[more] + 1
    return start, best


def _grown(a: np.ndarray, b: np.ndarray, n: int, none: int) -> np.ndarray:
    """(rows, n + 1): least edits of the first i words of the item (a) against any first words of the document (b); large where the item ends before."""
    steps = np.arange(b.shape[1] + 1)
    row = np.broadcast_to(steps, (len(a), len(steps))).astype(np.int16)
    out = np.full((len(a), n + 1), 99, np.int16)
    out[:, 0] = 0
    steps = steps.astype(np.int16)
    for i in range(n):
        new = np.empty_like(row)
        new[:, 0] = i + 1
        new[:, 1:] = np.minimum(row[:, 1:] + 1, row[:, :-1] + (a[:, i, None] != b))
        row = np.minimum.accumulate(new - steps, axis=1) + steps
        out[:, i + 1] = np.where(a[:, i] == none, 99, row.min(1))
    return out


def passage_edits(item: np.ndarray, doc: np.ndarray, none: int) -> np.ndarray:
    """Least edits of a passage of PASSAGE words of the item that holds the window, against the document; 99 where the item has no such passage."""
    inside = (item[:, AROUND : AROUND + WINDOW] != doc[:, AROUND : AROUND + WINDOW]).sum(1)
    n = PASSAGE - WINDOW
    left = _grown(item[:, AROUND - 1 :: -1], doc[:, AROUND - 1 :: -1], n, none)
    right = _grown(item[:, AROUND + WINDOW :], doc[:, AROUND + WINDOW :], n, none)
    return inside + (left + right[:, ::-1]).min(1)


def leaks(documents: DataFrame, questions: DataFrame, parts: tuple[str, ...] = ("question", "gold_answer"), edits: int = 1) -> DataFrame:
    """doc_id, question_id, part, run, edits: items of which a passage stands in a document.

    run: the longest run of equal words; edits: least word edits of a passage of PASSAGE words, 0 where a run has as many, null where no such passage
    is within `edits`. Rows have run >= RUN or edits <= `edits`. Parts of fewer than WINDOW words hold no such passage. Null or blank text leaks nothing;
    repeated question rows count once; equal texts of several questions are searched once and reported for each; documents that
    repeat a text are each reported. Words are compared by 32 bits of their hashes in the check, after 64 bits of the walk. Empty input, no rows.
    """
    spread = F.explode(F.array(*[F.struct(F.lit(p).alias("part"), F.col(p).alias("text")) for p in parts])).alias("p")
    asked = questions.where(F.col("id").isNotNull()).select(F.col("id").alias("question_id"), spread).select("question_id", "p.part", "p.text").where(F.col("text").isNotNull())
    asked = asked.withColumn("item", F.xxhash64("text"))
    items = written(asked.groupBy("item").agg(F.first("text").alias("text")))
    repetitions = 1 if edits < 2 else REPETITIONS
    windows = written(item_windows(items, repetitions))
    docs = documents.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text")
    count = windows.count()
    passed = document_windows(docs, _filter(windows, count), repetitions)
    spoken = written(item_words(items))
    # Windows begin at every STRIDE-th word, so their number bounds the words: 4 bytes each.
    spoken = F.broadcast(spoken) if count // repetitions * STRIDE + count <= BROADCAST_WORDS else spoken
    pairs = passed.join(windows, "hash").select("doc_id", "item", "pos", "ipos", "before", "words").join(spoken, "item")
    if edits < 2:
        # One word more on either side must be equal, else there is neither a run of 10 words nor such a passage.
        same = lambda i: F.get("words", F.col("before") + i) == F.get("iwords", F.col("ipos") + i)
        pairs = pairs.where(F.coalesce(F.when(F.col("before") > 0, F.when(F.col("ipos") > 0, same(-1))), F.lit(False)) | F.coalesce(same(WINDOW), F.lit(False)))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not len(b):
                continue
            doc = _laid(b.column("words"), b.column("before").to_numpy().astype(np.int64), -(1 << 40))
            item = _laid(b.column("iwords"), b.column("ipos").to_numpy().astype(np.int64), -(1 << 41))
            start, run = runs_through(item, doc)
            first = b.column("ipos").to_numpy().astype(np.int64) - AROUND + start
            dist = np.full(len(run), 99)
            near = np.flatnonzero(run >= WINDOW + STRIDE - 1) if edits < 2 else np.arange(len(run))
            dist[near] = passage_edits(item[near], doc[near], -(1 << 41))
            ok = np.flatnonzero((run >= RUN) | (dist <= edits))
            take = pa.array(ok)
            shift = b.column("pos").to_numpy().astype(np.int64) - b.column("ipos").to_numpy()
            found = [pa.array(x[ok].astype(np.int32)) for x in (shift, first, first + run)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(take), b.column("item").take(take), *found, pa.array(dist[ok].astype(np.int32))], ["doc_id", "item", "shift", "s", "e", "edits"])

    checked = pairs.mapInArrow(verify, "doc_id long, item long, shift int, s int, e int, edits int")
    # Pieces of one run, as far as each window saw, are put together: at most one piece for each of the item's windows.
    lines = checked.groupBy("doc_id", "item", "shift").agg(F.array_sort(F.collect_set(F.struct("s", "e"))).alias("pieces"), F.min("edits").alias("edits"))
    step = lambda a, p: F.when(p["s"] <= a["e"], F.struct(a["s"].alias("s"), F.greatest(a["e"], p["e"]).alias("e"), F.greatest(a["n"], F.greatest(a["e"], p["e"]) - a["s"]).alias("n"))).otherwise(F.struct(p["s"].alias("s"), p["e"].alias("e"), F.greatest(a["n"], p["e"] - p["s"]).alias("n")))
    nothing = F.struct(F.lit(-(1 << 30)).alias("s"), F.lit(-(1 << 30)).alias("e"), F.lit(0).alias("n"))
    longest = lines.select("doc_id", "item", F.aggregate("pieces", nothing, step)["n"].alias("run"), "edits")
    found = longest.groupBy("doc_id", "item").agg(F.max("run").alias("run"), F.min("edits").alias("edits"))
    told = F.when(F.col("run") >= PASSAGE, 0).when(F.col("edits") <= edits, F.col("edits"))
    return found.join(asked.select("question_id", "part", "item").distinct(), "item").groupBy("doc_id", "question_id", "part").agg(F.max("run").alias("run"), F.min(told).alias("edits"))
