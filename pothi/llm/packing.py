"""Packing documents into containers of fixed capacity along a space-filling curve.

A document's tokens are hashed to random vectors of DIMS components and averaged: a random projection of its bag of
tokens. The quantised projection's Hilbert index puts documents of like content next to each other; the
documents are range-sorted by it and each range is packed by itself, in order, with best fit over the
OPEN containers opened last, so neighbours on the curve share containers. A document is cut only if it is longer than the capacity:
whole containers first, its rest is packed as a document is.
"""

from __future__ import annotations

import base64
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, strip

CAPACITY, OPEN, DIMS, BITS = 2048, 256, 3, 10
#: Documents of one packing range.
RANGE_ROWS = 100_000
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pre-tokenizer pattern that belongs to the byte-level vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_ENCODERS: dict = {}


def encoder(path: str = TOKENIZER):
    """The tokenizer in a rank file, one per process."""
    if path not in _ENCODERS:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _ENCODERS[path] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[path]


def hilbert(coordinates: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Hilbert index of rows of integer coordinates below 2^bits (Skilling's transposed form), vectorised over rows."""
    x = [c.astype(np.int64) for c in coordinates.T]
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            high = (x[i] & q) != 0
            swap = (x[0] ^ x[i]) & p
            x[0], x[i] = np.where(high, x[0] ^ p, x[0] ^ swap), np.where(high, x[i], x[i] ^ swap) if i else np.where(high, x[0] ^ p, x[0])
        q >>= 1
    for i in range(1, n):
        x[i] = x[i] ^ x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[n - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x = [c ^ t for c in x]
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def sized(df: DataFrame, tokenizer: str = TOKENIZER, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, tokens, curve: token count and place on the curve of every text that is not null or blank."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(tokenizer)
        table = np.random.default_rng(8191).standard_normal((enc.n_vocab + 1, DIMS)).astype(np.float32)
        for pdf in batches:
            n = np.zeros(len(pdf), np.int64)
            y = np.zeros((len(pdf), DIMS), np.float32)
            for i, t in enumerate(pdf[text]):
                ids = enc.encode_to_numpy(t, disallowed_special=())
                n[i] = len(ids)
                y[i] = table[ids].mean(0)
            # Means of standard normals over a few hundred skewed tokens lie within about one.
            grid = np.clip((y + 1.0) * (1 << (BITS - 1)), 0, (1 << BITS) - 1).astype(np.int64)
            yield pd.DataFrame({key: pdf[key], "tokens": n, "curve": hilbert(grid)})

    rows = df.where(F.col(key).isNotNull() & (F.length(strip(F.col(text))) > 0)).select(key, text)
    return rows.mapInPandas(run, f"`{key}` {dict(df.dtypes)[key]}, tokens long, curve long")


def pack_range(sizes: Iterator[tuple[object, int]], capacity: int, open_most: int) -> Iterator[tuple[int, object, int, int, int]]:
    """(container, key, part, start, tokens) for items in order. Best fit among at most `open_most` open containers."""
    free: list[tuple[int, int]] = []  # (room, container), ascending
    opened = 0
    for key, n in sizes:
        part = start = 0
        while n - start > capacity:
            yield opened, key, part, start, capacity
            opened, part, start = opened + 1, part + 1, start + capacity
        rest = n - start
        if rest <= 0:
            continue
        at = bisect_left(free, (rest, -1))
        if at < len(free):
            room, box = free.pop(at)
        else:
            room, box = capacity, opened
            opened += 1
            if len(free) >= open_most:
                free.pop(0)
        yield box, key, part, start, rest
        if room > rest:
            insort(free, (room - rest, box))


def pack(df: DataFrame, capacity: int = CAPACITY, tokenizer: str = TOKENIZER, key: str = "doc_id", text: str = "text", range_rows: int = RANGE_ROWS) -> DataFrame:
    """container_id, doc key, part, start, tokens: the container of each document, of each part of a longer one.

    start and tokens count tokens. Null and blank texts are not packed. Documents that repeat a text are packed each. Ranges
    are cut by (curve, key), so equal texts, however many, spread over ranges. Container ids are unique, not dense. Empty input, no rows.
    """
    rows = cut(sized(df, tokenizer, key, text))
    ranges = max(1, -(-rows.count() // range_rows))
    kind = dict(df.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << 40
        items = ((k, n) for pdf in batches for k, n in zip(pdf[key], pdf["tokens"].tolist()))
        out = []
        for row in pack_range(items, capacity, OPEN):
            out.append(row)
            if len(out) == 50_000:
                yield _frame(out, base, key)
                out = []
        yield _frame(out, base, key)

    ordered = rows.repartitionByRange(ranges, "curve", key).sortWithinPartitions("curve", key)
    return ordered.mapInPandas(run, f"container_id long, `{key}` {kind}, part int, start long, tokens long")


def _frame(rows: list[tuple], base: int, key: str) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["container_id", key, "part", "start", "tokens"])
    out["container_id"] += base
    return out


def containers(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """container_id, items, tokens, unused."""
    return packed.groupBy("container_id").agg(F.count("*").alias("items"), F.sum("tokens").alias("tokens"), (F.lit(capacity) - F.sum("tokens")).alias("unused"))
