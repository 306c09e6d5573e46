"""Words of texts as 64-bit hashes, in the Python workers, all characters of a batch at once."""

from __future__ import annotations

import unicodedata

import numpy as np

from .common import process_state

#: Characters taken at a time, so that the working arrays stay small. One longer text is taken whole.
CHARACTERS = 1 << 19
_FACTOR = 0x9E3779B97F4A7C15 | 1


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Which code points belong to words (letters, combining marks, decimal digits), and a random number for each code point."""
    state = process_state("words")
    if "word" not in state:
        category = [unicodedata.category(chr(cp)) for cp in range(0x110000)]
        state["word"] = np.fromiter((c[0] in "LM" or c == "Nd" for c in category), bool, len(category))
        state["value"] = np.random.default_rng(977).integers(0, 1 << 64, 0x110000, np.uint64) | np.uint64(1)
    return state["word"], state["value"]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers of an odd factor and of its inverse modulo 2^64."""
    state = process_state("words")
    if len(state.get("up", ())) < n:
        n = max(n, CHARACTERS + 4096)
        with np.errstate(over="ignore"):
            for name, factor in (("up", _FACTOR), ("down", pow(_FACTOR, -1, 1 << 64))):
                state[name] = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - 1, factor, np.uint64)]))
    return state["up"], state["down"]


def _words(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of a few texts, flat, and the words of each text.

    A word is hashed as a polynomial of its characters' numbers, taken from running sums, so no word is looked at by itself.
    """
    codes = np.frombuffer("\n".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
    word, value = _tables()
    inside = np.zeros(len(codes) + 2, np.int8)
    inside[1:-1] = word[codes]
    change = np.flatnonzero(inside[1:] != inside[:-1])
    starts, stops = change[::2], change[1::2]
    up, down = _powers(len(codes) + 1)
    with np.errstate(over="ignore"):
        sums = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum(value[codes] * up[: len(codes)], out=sums[1:])
        h = (sums[stops] - sums[starts]) * down[starts]
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
    return h, np.diff(np.searchsorted(starts, ends), prepend=0)


def flat_words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words of all texts, flat, and the offset of each text; null is as empty."""
    parts, counts, group, size = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [], 0
    for text in texts:
        low = (text or "").lower()
        if group and size + len(low) > CHARACTERS:
            h, n = _words(group)
            parts.append(h)
            counts.append(n)
            group, size = [], 0
        group.append(low)
        size += len(low) + 1
    if group:
        h, n = _words(group)
        parts.append(h)
        counts.append(n)
    return np.concatenate(parts), np.concatenate([[0], np.cumsum(np.concatenate(counts))]).astype(np.int64)
