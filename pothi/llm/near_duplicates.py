"""Near-duplicate texts: min-hash buckets of word shingles, bit-sliced Hamming comparison, exact check.

1. Every text is hashed to minima of its shingles of SHINGLE words, one per hash function. A minimum agrees with chance J, the pair's Jaccard
   similarity, however common the shingles are and however large a group of copies is.
2. `rows` minima make a bucket key, and there are so many keys that a pair at the threshold meets with chance MEET. More rows need more keys but
   meet fewer strangers; the number of rows that compares at most COMPARISONS strangers a text is taken, told by a bounded sample of
   texts (PLAN_SAMPLE). The choice changes the cost only: every number of rows has the same chance.
   Keys that only one content has are left out before any shuffle by a bit filter (common.hash_filter). A full filter lets more keys pass, and loses none.
3. Contents that share a bucket are compared by their 1-bit min-hash signatures. The signatures of up to 64 contents form a block
   of vertical bit planes; a query's Hamming distances to the whole block are counted at once with carry-save bitwise adders,
   and a block is abandoned as soon as all its counters exceed the radius. Buckets over BLOCK rows are cut into a grid of
   sub-buckets, each pair of which is a group of its own, so no bucket is too hot for a task.
4. Pairs within the radius are verified by their exact Jaccard similarity.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, filter_bits, hash_filter, passes, small, written
from .words import flat_words

SHINGLE, THRESHOLD = 3, 0.5
#: Chance with which a pair at the threshold shares a bucket.
MEET = 0.994
BITS, BLOCK = 256, 8192
#: Strangers a text may be compared with before keys of more rows are taken; the rows to choose from.
COMPARISONS, ROWS = 20_000, (2, 3, 4, 5)
#: Texts, at most, whose minima tell how often strangers share a key.
PLAN_SAMPLE = 4_000


def mix(x: np.ndarray, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ np.uint64(0x9E3779B97F4A7C15 * (seed + 1) % (1 << 64))) * np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(29)
        x *= np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(32))


def runs(words: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of n words of every row, flat, in order, and their offsets."""
    sizes = np.maximum(np.diff(offsets) - n + 1, 0)
    ends = np.concatenate([[0], np.cumsum(sizes)])
    at = np.arange(ends[-1]) + np.repeat(offsets[:-1] - ends[:-1], sizes)
    h = np.zeros(len(at), np.uint64)
    with np.errstate(over="ignore"):
        for i in range(n):
            h += words[at + i] * np.uint64((0x9E3779B97F4A7C15 * (2 * i + 1)) % (1 << 64) | 1)
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
    return h, ends


def shingles(words: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed shingles of every row, flat and sorted within the row, and their offsets."""
    h, ends = runs(words, offsets, n)
    row = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    h, row = h[keep], row[keep]
    return h, np.searchsorted(row, np.arange(len(ends)))


def minima(h: np.ndarray, offsets: np.ndarray, functions: int) -> np.ndarray:
    """(texts, functions): the least value of every hash function over each text's shingles. Every text must have one.

    Texts of like size are laid side by side as the columns of a table, so a function costs one product and one minimum a cell.
    """
    x = (h >> np.uint64(32)).astype(np.uint32)
    sizes = np.diff(offsets)
    rng = np.random.default_rng(8209)
    factors = [(np.uint32(rng.integers(1, 1 << 32) | 1), np.uint32(rng.integers(0, 1 << 32))) for _ in range(functions)]
    out = np.empty((len(sizes), functions), np.uint32)
    order = np.argsort(-sizes, kind="stable")
    s = 0
    with np.errstate(over="ignore"):
        while s < len(order):
            longest = int(sizes[order[s]])
            texts = order[s : s + max(1, min(512, (1 << 15) // longest))]
            at = offsets[texts] + np.minimum(np.arange(longest)[:, None], sizes[texts] - 1)
            table = x[at]
            u = np.empty_like(table)
            for p, (factor, plus) in enumerate(factors):
                np.multiply(table, factor, out=u)
                u += plus
                out[texts, p] = u.min(axis=0)
            s += len(texts)
    return out


def bands_for(rows: int, threshold: float = THRESHOLD, meet: float = MEET) -> int:
    """Keys of so many rows with which a pair at the threshold shares one with the wanted chance."""
    return math.ceil(math.log(1 - meet) / math.log(1 - threshold**rows))


def bucket_keys(least: np.ndarray, rows: int, bands: int) -> np.ndarray:
    """(texts, bands) keys of 32 bits."""
    key = np.zeros((len(least), bands), np.uint64)
    with np.errstate(over="ignore"):
        for r in range(rows):
            key = (key ^ least[:, r : rows * bands : rows].astype(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
            key ^= key >> np.uint64(31)
        key = key * np.uint64(0x94D049BB133111EB) + (np.arange(bands, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return (key >> np.uint64(32)).astype(np.uint32)


def signatures(least: np.ndarray) -> np.ndarray:
    """1-bit min-hash signatures (texts, BITS / 64 words): a bit of each of the first BITS minima."""
    bits = ((least[:, :BITS] * np.uint32(0x9E3779B1)) >> np.uint32(31)).astype(np.uint8)
    return np.packbits(bits, axis=1, bitorder="little").view(np.uint64)


def plan_rows(sample: np.ndarray, texts: int, threshold: float = THRESHOLD) -> int:
    """Rows of a key: the fewest that compare no more than COMPARISONS strangers a text, else those that compare fewest. sample: minima of some texts."""
    n, loads = len(sample), []
    for rows in ROWS:
        shared = 0
        for s in range(0, 60, rows):
            _, c = np.unique(sample[:, s : s + rows], axis=0, return_counts=True)
            shared += int((c.astype(np.int64) * (c - 1)).sum())
        share = shared / max(len(range(0, 60, rows)) * n * (n - 1), 1)
        loads.append(bands_for(rows, threshold) * share * texts)
    return next((r for r, load in zip(ROWS, loads) if load <= COMPARISONS), ROWS[int(np.argmin(loads))])


def radius(threshold: float, bits: int = BITS) -> int:
    """Hamming radius that pairs of the given Jaccard similarity exceed with a chance of about one in two hundred."""
    p = (1 - threshold) / 2
    return min(bits, math.ceil(bits * p + 2.6 * math.sqrt(bits * p * (1 - p))))


#: Pairs of a query and a block that are counted together.
STRIPE = 16384


class Counters:
    """Bit-sliced counters: plane k holds bit k of 64 lanes' counts, for many words at once."""

    def __init__(self, n: int, bits: int):
        self.planes = [np.zeros(n, np.uint64) for _ in range(bits.bit_length())]
        self.ones, self.twos, self.fours = (np.zeros(n, np.uint64) for _ in range(3))

    @staticmethod
    def _save(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Carry-save adder: (carry, sum) of three bits per lane."""
        u = a ^ b
        return (a & b) | (u & c), u ^ c

    def add8(self, d: list[np.ndarray]) -> None:
        a, s = self._save(self.ones, d[0], d[1])
        b, s = self._save(s, d[2], d[3])
        e, t = self._save(self.twos, a, b)
        a, s = self._save(s, d[4], d[5])
        b, self.ones = self._save(s, d[6], d[7])
        f, self.twos = self._save(t, a, b)
        carry, self.fours = self._save(self.fours, e, f)
        for k in range(3, len(self.planes)):
            self.planes[k], carry = self.planes[k] ^ carry, self.planes[k] & carry

    def over(self, limit: int) -> np.ndarray:
        """Lanes whose count exceeds the limit, by comparing plane after plane from the top."""
        planes = [self.ones, self.twos, self.fours, *self.planes[3:]]
        more, same = np.zeros_like(self.ones), np.full_like(self.ones, ~np.uint64(0))
        for k in range(len(planes) - 1, -1, -1):
            if limit >> k & 1:
                same = same & planes[k]
            else:
                more |= same & planes[k]
                same = same & ~planes[k]
        return more

    def keep(self, rows: np.ndarray) -> None:
        self.planes = [p[rows] for p in self.planes]
        self.ones, self.twos, self.fours = self.ones[rows], self.twos[rows], self.fours[rows]


def close_pairs(group: np.ndarray, side: np.ndarray, sig: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows (a, b), a before b, of the same group within the Hamming limit; rows must be sorted by group.

    side 0 and 1: only pairs of different sides; side 2: all pairs of the group.
    """
    n = len(group)
    if n < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    sizes = np.diff(np.concatenate([starts, [n]]))
    first = np.repeat(starts, sizes)
    lane = (np.arange(n) - first) % 64
    block_start = np.flatnonzero(lane == 0)
    block = np.cumsum(lane == 0) - 1
    group_end_block = np.repeat(block[starts + sizes - 1], sizes)
    bits = sig.shape[1] * 64
    planes = np.zeros((bits, len(block_start)), np.uint64)
    for p in range(bits):
        bit = (sig[:, p // 64] >> np.uint64(p % 64)) & np.uint64(1)
        planes[p] = np.bitwise_or.reduceat(bit << lane.astype(np.uint64), block_start)
    # Each row is compared with its own block's later lanes and with all later blocks of its group.
    spans = group_end_block - block + 1
    q = np.repeat(np.arange(n), spans)
    b = np.repeat(block, spans) + np.arange(len(q)) - np.repeat(np.cumsum(spans) - spans, spans)
    filled = np.bitwise_or.reduceat(np.uint64(1) << lane.astype(np.uint64), block_start)
    left = np.bitwise_or.reduceat(np.where(side == 0, np.uint64(1), np.uint64(0)) << lane.astype(np.uint64), block_start)
    right = np.bitwise_or.reduceat(np.where(side == 1, np.uint64(1), np.uint64(0)) << lane.astype(np.uint64), block_start)
    later = np.where(lane == 63, np.uint64(0), ~np.uint64(0) << np.minimum(lane + 1, 63).astype(np.uint64))
    wanted = filled[b] & np.where(b == block[q], later[q], ~np.uint64(0))
    wanted &= np.where(side[q] == 2, ~np.uint64(0), np.where(side[q] == 0, right[b], left[b]))
    live = np.flatnonzero(wanted)
    # A query's bit as a whole word, once per row.
    masks = np.zeros((bits, n), np.uint64)
    for p in range(bits):
        masks[p] = np.uint64(0) - ((sig[:, p // 64] >> np.uint64(p % 64)) & np.uint64(1))
    out_a, out_b = [], []
    for s in range(0, len(live), STRIPE):
        c = live[s : s + STRIPE]
        qs, bs, ws = q[c], b[c], wanted[c]
        counters = Counters(len(c), bits)
        for p in range(0, bits, 8):
            counters.add8([planes[k][bs] ^ masks[k][qs] for k in range(p, p + 8)])
            if p % 64 == 56:
                near = ws & ~counters.over(limit)
                rows = np.flatnonzero(near)
                qs, bs, ws = qs[rows], bs[rows], near[rows]
                counters.keep(rows)
                if not len(rows):
                    break
        for k in range(64):
            hit = np.flatnonzero((ws >> np.uint64(k)) & np.uint64(1))
            if len(hit):
                out_a.append(qs[hit])
                out_b.append(block_start[bs[hit]] + k)
    if not out_a:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(out_a), np.concatenate(out_b)


def _batch_nodes(b: pa.RecordBatch, n: int, functions: int) -> tuple[np.ndarray, np.ndarray] | None:
    """Rows of a batch that have a shingle and, of each content, come first; their minima; for every row the row that stands for it, or -1."""
    nodes = b.column("node").to_numpy()
    _, first, which = np.unique(nodes, return_index=True, return_inverse=True)
    h, offsets = runs(*flat_words(b.column("text").take(pa.array(first)).to_pylist()), n)
    has = np.flatnonzero(np.diff(offsets) > 0)
    if not len(has):
        return None
    at = np.full(len(first), -1)
    at[has] = np.arange(len(has))
    return minima(h, np.concatenate([offsets[has], [len(h)]]), functions), at[which]


def _nodes(texts: DataFrame, n: int, rows: int, bands: int) -> DataFrame:
    """(chunk_id, node, keys, sig) of the texts that have a shingle. keys: 4 bytes a band, in the bands' order."""
    functions = max(BITS, rows * bands)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = _batch_nodes(b, n, functions) if len(b) else None
            if found is None:
                continue
            least, at = found
            keys = pa.array([r.tobytes() for r in bucket_keys(least, rows, bands)], pa.binary())
            sig = pa.array([r.tobytes() for r in signatures(least)], pa.binary())
            has = np.flatnonzero(at >= 0)
            take, of = pa.array(has), pa.array(at[has])
            yield pa.RecordBatch.from_arrays([b.column("chunk_id").take(take), b.column("node").take(take), keys.take(of), sig.take(of)], ["chunk_id", "node", "keys", "sig"])

    return texts.select("chunk_id", "node", "text").mapInArrow(run, "chunk_id long, node long, keys binary, sig binary")


def _planned(texts: DataFrame, n: int, threshold: float) -> int:
    """Rows of a key for these texts."""
    total = texts.count()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = _batch_nodes(b, n, 60) if len(b) else None
            if found is not None:
                has = np.flatnonzero(found[1] >= 0)
                yield pa.RecordBatch.from_arrays([b.column("node").take(pa.array(has)), pa.array([r.tobytes() for r in found[0][found[1][has]]], pa.binary())], ["node", "least"])

    share = min(1.0, PLAN_SAMPLE / max(total, 1))
    drawn = {r["node"]: r["least"] for r in texts.sample(share, 17).mapInArrow(run, "node long, least binary").limit(2 * PLAN_SAMPLE).collect()}
    return plan_rows(np.frombuffer(b"".join(drawn.values()), np.uint32).reshape(len(drawn), -1), total, threshold) if len(drawn) > 1 else ROWS[0]


def _matrix(column: pa.Array, dtype: type) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(len(column), -1)


def _placed(nodes: DataFrame, filter_: np.ndarray, hot: np.ndarray, block: int = BLOCK) -> DataFrame:
    """(gid, tag, sig) of the keys that pass the filter; keys at hot places are cut into a grid of sub-buckets.

    gid: the (sub-)bucket; tag: 4 times the row's number and its side, 2 where all pairs of the bucket count, else 0 or 1.
    """
    shared = nodes.sparkSession.sparkContext.broadcast((filter_, hot))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, (places, sizes) = shared.value
        for b in batches:
            if not len(b):
                continue
            keys, ids, sig = _matrix(b.column("keys"), np.uint32), b.column("row").to_numpy(), b.column("sig")
            row, band = np.nonzero(passes(bits, keys))
            key = (band.astype(np.int64) << 32) | keys[row, band]
            grid = np.ones(len(row), np.int64)
            if len(places):
                slot = (keys[row, band] & np.uint32(len(bits) * 8 - 1)).astype(np.int64)
                at = np.minimum(np.searchsorted(places, slot), len(places) - 1)
                grid = np.where(places[at] == slot, -(-sizes[at] // block), 1)
            mine = (mix(ids.view(np.uint64)[row], 3) % grid.astype(np.uint64)).astype(np.int64)
            ends = np.cumsum(grid)
            for s in range(0, int(ends[-1]) if len(ends) else 0, 1 << 18):
                at = np.arange(s, min(s + (1 << 18), int(ends[-1])))
                i = np.searchsorted(ends, at, "right")
                to, own = at - (ends[i] - grid[i]), mine[i]
                side = np.where(own == to, 2, np.where(own < to, 0, 1))
                cell = (np.minimum(own, to) << 20) + np.maximum(own, to)
                gid = np.where(grid[i] == 1, key[i], (mix((key[i] ^ (cell << 1)).view(np.uint64), 5) >> np.uint64(1)).view(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(gid), pa.array(ids[row[i]] * 4 + side), sig.take(pa.array(row[i]))], ["gid", "tag", "sig"])

    return nodes.select("row", "keys", "sig").mapInArrow(run, "gid long, tag long, sig binary")


def _compare(buckets: DataFrame, limit: int) -> DataFrame:
    """(a, b), a < b, row pairs within the limit. buckets: gid, tag, sig, sorted by gid."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(parts: list[pa.RecordBatch]) -> pa.RecordBatch | None:
            t = pa.Table.from_batches(parts).combine_chunks()
            gid = t.column("gid").to_numpy()
            group = np.concatenate([[0], np.cumsum(gid[1:] != gid[:-1])])
            many = np.flatnonzero(np.bincount(group)[group] > 1)
            if not len(many):
                return None
            tag = t.column("tag").to_numpy()[many]
            sig = _matrix(t.column("sig").take(pa.array(many)), np.uint64)
            row, side = tag >> 2, tag & 3
            i, j = close_pairs(group[many], side, sig, limit)
            i, j = i[row[i] != row[j]], j[row[i] != row[j]]
            if not len(i):
                return None
            pairs = np.unique(np.stack([np.minimum(row[i], row[j]), np.maximum(row[i], row[j])], 1), axis=0)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

        rest: list[pa.RecordBatch] = []
        for b in batches:
            if not len(b):
                continue
            gid = b.column("gid").to_numpy()
            change = np.flatnonzero(gid[1:] != gid[:-1]) + 1
            if rest and rest[-1].column("gid")[-1].as_py() != gid[0]:
                change = np.concatenate([[0], change])
            if len(change):  # whole buckets up to the last change
                at = int(change[-1])
                parts = [*rest, b.slice(0, at)] if at else rest
                if parts and (out := flush(parts)) is not None:
                    yield out
                rest, b = [], b.slice(at)
            rest.append(b)
        if rest and (out := flush(rest)) is not None:
            yield out

    return buckets.mapInArrow(run, "a long, b long").distinct()


def _fold(nodes: np.ndarray) -> np.ndarray:
    return (mix(nodes.view(np.uint64), 9) >> np.uint64(32)).astype(np.uint32)


def _sets(texts: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """(node, shingles): the distinct shingles, as sorted 32-bit hashes, of the texts whose node is wanted; a few others may be among them.

    wanted: node. They reach the workers as a bit filter, so no text is shuffled.
    """

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([_fold(b.column("node").to_numpy()).tobytes()], pa.binary())], ["h"])

    bits, _ = hash_filter(wanted.mapInArrow(hashes, "h binary"), filter_bits(wanted.count()))
    shared = texts.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            nodes = b.column("node").to_numpy()
            _, first = np.unique(nodes, return_index=True)
            take = pa.array(first[passes(shared.value, _fold(nodes[first]))] if len(first) else first)
            h, offsets = shingles(*flat_words(b.column("text").take(take).to_pylist()), n)
            lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array((h >> np.uint64(32)).astype(np.uint32).view(np.int32)))
            yield pa.RecordBatch.from_arrays([b.column("node").take(take), lists], ["node", "shingles"])

    return texts.select("node", "text").mapInArrow(run, "node long, shingles array<int>")


def _jaccard(rows: DataFrame, threshold: float) -> DataFrame:
    """(a, b, similarity) of the rows a, b, _x, _y whose sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not len(b):
                continue
            flat, row = [], []
            for c in ("_x", "_y"):
                lists = b.column(c)
                flat.append(lists.flatten().to_numpy(zero_copy_only=False).view(np.uint32).astype(np.uint64))
                row.append(np.repeat(np.arange(len(b), dtype=np.uint64), np.diff(lists.offsets.to_numpy())))
            sizes = sum(np.bincount(r.astype(np.int64), minlength=len(b)) for r in row)
            both = np.sort(np.concatenate([(r << np.uint64(32)) | f for r, f in zip(row, flat)]))
            same = np.bincount((both[1:][both[1:] == both[:-1]] >> np.uint64(32)).astype(np.int64), minlength=len(b))
            j = same / np.maximum(sizes - same, 1)
            near = np.flatnonzero(j >= threshold)
            take = pa.array(near)
            yield pa.RecordBatch.from_arrays([b.column("a").take(take), b.column("b").take(take), pa.array(j[near])], ["a", "b", "similarity"])

    return rows.select("a", "b", "_x", "_y").mapInArrow(run, "a long, b long, similarity double")


def similar_texts(chunks: DataFrame, threshold: float = THRESHOLD, n: int = SHINGLE, key: str = "chunk_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(links, members). links: a, b, similarity: node pairs of different content with Jaccard >= threshold, each once, a < b.
    members: node, the key's id (as chunk_id): every text with a shingle.

    A node is one content: of exact copies, however many, one row is bucketed and compared, so they cost no pairs. Null texts and texts of fewer
    than `n` words have no node. Rows that repeat an id are one member. Empty input gives empty results.
    """
    texts = chunks.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("chunk_id"), F.xxhash64(text).alias("node"), F.col(text).alias("text"))
    rows = _planned(texts, n, threshold)
    nodes = written(_nodes(texts, n, rows, bands_for(rows, threshold)).withColumn("row", F.monotonically_increasing_id()))
    members = nodes.select("node", "chunk_id").distinct()
    copied = written(nodes.groupBy("node").agg(F.count("*").alias("_copies"), F.min("row").alias("_first")).where(F.col("_copies") > 1).select("node", "_first"))
    once = nodes.join(small(copied), "node", "left").where(F.col("_first").isNull() | (F.col("_first") == F.col("row")))
    filter_, hot = hash_filter(once.select("keys"), filter_bits(nodes.count() * bands_for(rows, threshold), 8), twice=True, hot=BLOCK)
    buckets = _placed(once, filter_, hot).repartition("gid").sortWithinPartitions("gid")
    pairs = written(_compare(buckets, radius(threshold)))
    number = once.select("row", "node")
    named = pairs.join(number.select(F.col("row").alias("a"), F.col("node").alias("_a")), "a").join(number.select(F.col("row").alias("b"), F.col("node").alias("_b")), "b")
    named = written(named.select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b")))
    wanted = cut(named.select(F.explode(F.array("a", "b")).alias("node")).distinct())
    sets = written(_sets(texts, wanted, n).join(small(wanted), "node", "left_semi"))
    checked = named.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("_x")), "a").join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("_y")), "b")
    links = _jaccard(checked, threshold)
    return cut(links.distinct()), members


def similar_pairs(links: DataFrame, members: DataFrame) -> DataFrame:
    """(chunk_a, chunk_b), chunk_a < chunk_b: the links between all members of their nodes, and the pairs of equal members.

    This expands copies into pairs, as the query p3_found is defined; `groups` has one row per text instead and is the form for large groups of copies.
    """
    x, y = members.select(F.col("node").alias("a"), F.col("chunk_id").alias("_p")), members.select(F.col("node").alias("b"), F.col("chunk_id").alias("_q"))
    linked = links.join(x, "a").join(y, "b").select("_p", "_q")
    copied = members.groupBy("node").agg(F.count("*").alias("_n")).where(F.col("_n") > 1)
    again = members.join(copied, "node").select("node", "chunk_id")
    copies = again.select("node", F.col("chunk_id").alias("_p")).join(again.select("node", F.col("chunk_id").alias("_q")), "node").where(F.col("_p") < F.col("_q")).select("_p", "_q")
    return linked.unionByName(copies).select(F.least("_p", "_q").alias("chunk_a"), F.greatest("_p", "_q").alias("chunk_b")).distinct()


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, group): least node of the connected component, for nodes with a link.

    Labels spread to neighbours and jump along their own label, so long chains need few rounds; each
    round is written to the shared folder. No component reaches the driver.
    """
    edges = cut(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    label = cut(edges.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("group")).withColumnRenamed("a", "node"))
    for _ in range(rounds):
        near = edges.join(label.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("group").alias("_near"))
        step = label.join(near, label["node"] == near["a"]).select("node", F.least("group", "_near").alias("group"), F.col("group").alias("_old"))
        jump = step.join(label.select(F.col("node").alias("group"), F.col("group").alias("_jump")), "group", "left")
        new = cut(jump.select("node", F.least("group", F.coalesce("_jump", "group")).alias("group"), "_old"))
        label = new.select("node", "group")
        if new.where(F.col("group") != F.col("_old")).limit(1).count() == 0:
            return label
    raise RuntimeError("components did not settle")


def groups(links: DataFrame, members: DataFrame) -> DataFrame:
    """chunk_id, group_id, links: one row per text with a shingle. group_id is the least chunk_id of its group of texts
    linked directly or over others (its own where it has none); links counts the different contents it is linked with."""
    label = components(links)
    degree = links.select(F.col("a").alias("node")).unionByName(links.select(F.col("b").alias("node"))).groupBy("node").agg(F.count("*").alias("links"))
    placed = members.join(label, "node", "left").join(degree, "node", "left").select("chunk_id", F.coalesce("group", "node").alias("group"), F.coalesce("links", F.lit(0)).alias("links"))
    least = placed.groupBy("group").agg(F.min("chunk_id").alias("group_id"))
    return placed.join(least, "group").select("chunk_id", "group_id", "links")
