"""Splitting oversized texts at natural boundaries by agglomerative merging.

A text over the limit is first cut into atomic segments (paragraph, line, sentence,
clause and word ends; a word longer than the room is cut hard). Each boundary between
two neighbouring segments has a strength. A heap holds all adjacent pairs; the weakest
boundary is merged first, shorter results before longer ones, while the merged piece
plus the overlap fits the limit. The strong boundaries are what remains between pieces.
Every piece but the first then starts with up to `overlap` characters repeated from the
end of the piece before, begun at the strongest boundary inside that stretch.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import strip

LIMIT, OVERLAP = 1200, 150

#: Strength of a boundary, strongest first; the match is the white space (or mark) before the cut.
_BOUNDARIES = (
    (5, regex.compile(r"\n[^\S\n]*(?:\n\s*)+")),
    (4, regex.compile(r"\n")),
    (3, regex.compile(r"(?<=[.!?।][\"'”’)\]]?)(?<!\b(?:Rs|No|Sec|Dr|Smt|Shri|रु|सं|क्र)\.)[^\S\n]+")),
    (2, regex.compile(r"(?<=[,;:])[^\S\n]+")),
    (1, regex.compile(r"[^\S\n]+")),
)


def _cuts(text: str, room: int) -> tuple[list[int], list[int]]:
    """Cut positions inside the text (each the start of a segment) and their strengths."""
    at: dict[int, int] = {}
    for strength, pattern in _BOUNDARIES:
        for m in pattern.finditer(text):
            if 0 < m.end() < len(text):
                at.setdefault(m.end(), strength)
    cuts = sorted(at)
    strengths = [at[c] for c in cuts]
    ends = [0, *cuts, len(text)]
    if any(b - a > room for a, b in zip(ends, ends[1:])):
        for a, b in zip(ends, ends[1:]):
            for c in range(a + room, b, room):
                while c > a + 1 and regex.match(r"\p{M}", text[c]):  # never between a letter and its mark
                    c -= 1
                at.setdefault(c, 0)
        cuts = sorted(at)
        strengths = [at[c] for c in cuts]
    return cuts, strengths


def split_text(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, int]]:
    """(start, body start, end) of each piece; start < body start is the repeated part.

    The pieces' bodies cover the whole text in order. A piece, stripped, has at most `limit` characters.
    """
    if len(text) <= limit:
        return [(0, 0, len(text))]
    room = limit - overlap
    cuts, strengths = _cuts(text, room)
    starts, ends = [0, *cuts], [*cuts, len(text)]
    n = len(starts)
    left, right = list(range(-1, n - 1)), [*range(1, n), -1]
    alive = [True] * n
    heap = [(strengths[i], ends[i + 1] - starts[i], i, i + 1) for i in range(n - 1)]
    heapq.heapify(heap)
    while heap:
        strength, size, i, j = heapq.heappop(heap)
        if not alive[i] or right[i] != j or ends[j] - starts[i] != size or size > room:
            continue
        ends[i], right[i], alive[j] = ends[j], right[j], False
        if right[j] != -1:
            left[right[j]] = i
            heapq.heappush(heap, (strengths[right[j] - 1], ends[right[j]] - starts[i], i, right[j]))
        if left[i] != -1:
            heapq.heappush(heap, (strengths[i - 1], ends[i] - starts[left[i]], left[i], i))
    pieces, k = [], 0
    strength_at = dict(zip(cuts, strengths))
    while k != -1:
        a = starts[k]
        begin = a
        if pieces and overlap:
            span = [c for c in range(max(a - overlap, pieces[-1][1] + 1), a) if strength_at.get(c, 0)]
            if span:
                begin = max(span, key=lambda c: (min(strength_at[c], 4), -c))
        pieces.append((begin, a, ends[k]))
        k = right[k]
    return pieces


def split_oversized(df: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP, text: str = "text", key: str = "chunk_id") -> DataFrame:
    """Pieces of every text: the key, page columns and section path, piece_no, n_pieces, start, end, piece.

    Texts that fit stay as they are, one piece, and never leave the JVM; only longer ones
    go to the Arrow workers, each row by itself, so no key can be too hot. Null or blank text
    gives no piece. Sizes count code points of the stripped text. Rows that repeat a key are
    taken once per row; use distinct input where that matters. Extra columns are ignored.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and less than limit")
    keep = [c for c in ("page", "end_page", "section_path") if c in df.columns]
    base = df.select(key, *keep, strip(F.col(text)).alias("_t")).where(F.length("_t") > 0)
    kinds = dict(base.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in (key, *keep)) + ", piece_no int, n_pieces int, start int, end int, piece string"
    whole = base.where(F.length("_t") <= limit).select(
        key, *keep, F.lit(0).alias("piece_no"), F.lit(1).alias("n_pieces"), F.lit(0).alias("start"), F.length("_t").alias("end"), F.col("_t").alias("piece")
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for row in pdf.itertuples(index=False):
                t = row[-1]
                spans = split_text(t, limit, overlap)
                for no, (begin, _, end) in enumerate(spans):
                    piece = t[begin:end]
                    rows.append((*row[:-1], no, len(spans), begin, end, piece.strip()))
            out = pd.DataFrame(rows, columns=[key, *keep, "piece_no", "n_pieces", "start", "end", "piece"])
            for c in keep:
                if kinds[c] in ("int", "bigint"):
                    out[c] = out[c].astype("Int64")
            yield out

    return whole.unionByName(base.where(F.length("_t") > limit).mapInPandas(run, schema))
