"""Lines repeated across one source's documents, found with compressed document bitmaps.

Documents of a source get dense numbers. For every line (told apart by its letters and marks
only) the set of documents that hold it is kept as bitmaps, one per block of 32,768 document
numbers; blocks without the line are absent, so the bitmaps are compressed by block. Variant spellings of
a line (case, digits, spaces, punctuation) have bitmaps of their own, united by
`bitmap_or_agg`; the cardinality of the union is exact. A chunk's line is deleted by looking its
document up in the bitmap of the line.

A line's occurrences bound its documents from above, so before any bitmap is built those lines are left out
that have too few occurrences to reach the threshold: exact, and it leaves at most
(occurrences per document) / share lines per source, however large the corpus.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import current_manifest, cut, small

SHARE, LEAST = 0.15, 3
_BITS = 32768


def line_key(line: Column) -> Column:
    """The line's letters and marks in lower case; empty where it has no letter."""
    key = F.lower(F.regexp_replace(line, r"[^\p{L}\p{M}]+", ""))
    return F.when(key.rlike(r"\p{L}"), key).otherwise("")


def with_scheme(chunks: DataFrame, manifest: DataFrame | None) -> DataFrame:
    """Chunks with `_scheme`: their own or, where null, that of their document's current manifest row.

    Only the rows without a scheme are joined.
    """
    own = chunks.where(F.col("scheme").isNotNull()).withColumn("_scheme", F.col("scheme"))
    none = chunks.where(F.col("scheme").isNull())
    if manifest is None:
        return own.unionByName(none.withColumn("_scheme", F.lit(None).cast("string")))
    held = current_manifest(manifest).select(F.col("id").alias("_id"), F.col("scheme").alias("_scheme"))
    return own.unionByName(none.join(held, F.col("document_id") == F.col("_id"), "left").drop("_id"))


def _numbered(docs: DataFrame, totals: DataFrame) -> DataFrame:
    """Document numbers that depend on the documents only: block of a hash, then the rank in the block.

    A scheme has a block for each half bitmap of its documents, so a small one has one bitmap a line and no source, however large, is numbered in one
    task; a recomputed task gives the same numbers.
    """
    block = F.pmod(F.xxhash64("_doc"), F.ceil(F.col("_docs") / (_BITS // 2)).cast("long"))
    rank = F.row_number().over(Window.partitionBy("_scheme", "_block").orderBy("_doc")) - 1
    return docs.join(totals, "_scheme").withColumn("_block", block).withColumn("_rank", rank.cast("long")).select(
        "_scheme", "_doc", (F.col("_block") * F.lit(1 << 20) + F.floor(F.col("_rank") / _BITS)).alias("_bucket"), F.expr(f"CAST(_rank % {_BITS} AS BIGINT)").alias("_bit")
    )


def text_keys(text: Column) -> Column:
    """line_key of every line of a text, in one pass over the text."""
    return F.split(F.lower(F.regexp_replace(text, r"[^\p{L}\p{M}\n]+", "")), "\n", -1)


def _lines(chunks: DataFrame, text: str, raw: bool) -> DataFrame:
    """One row per chunk row and line that has a letter: _hash of its key, and if `raw` the key, the line and its number."""
    keys = text_keys(F.col(text))
    if raw:
        zipped = F.arrays_zip(keys.alias("_key"), F.split(F.col(text), "\n", -1).alias("_line"))
        rows = chunks.select("chunk_id", F.col("document_id").alias("_doc"), "_scheme", F.posexplode(zipped).alias("line_no", "_l")).select("chunk_id", "_doc", "_scheme", "line_no", "_l._key", "_l._line")
    else:
        rows = chunks.select("_scheme", F.explode(keys).alias("_key"))
    return rows.where((F.col("_key") != "") & F.col("_key").rlike(r"\p{L}")).withColumn("_hash", F.xxhash64("_key"))


def frequent_keys(chunks: DataFrame, totals: DataFrame, share: float, least: int, text: str) -> DataFrame:
    """(_scheme, _hash) of the keys with enough occurrences to be repeated lines: a superset, found with map-side counts."""
    counted = _lines(chunks, text, raw=False).groupBy("_scheme", "_hash").agg(F.count("*").alias("_n")).where(F.col("_n") >= least)
    return cut(counted.join(totals, "_scheme").where(F.col("_n") >= _need(share, least)).select("_scheme", "_hash"))


def _need(share: float, least: int) -> Column:
    return F.greatest(F.ceil(F.col("_docs") * F.lit(share) - 1e-9), F.lit(least))


def repeated_lines(chunks: DataFrame, manifest: DataFrame | None = None, share: float = SHARE, least: int = LEAST, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(lines, cases): the repeated lines of each scheme, and where they stand.

    lines: scheme, line_key, example, variants, documents, share. cases: chunk_id, line_no, each once.
    Rows with a null scheme after the manifest look-up, or a null document, belong to no source. Only documents
    with chunks count. Rows that repeat a chunk_id give the same cases and count once. Empty input, empty results.
    """
    base = with_scheme(chunks.select("chunk_id", "document_id", "scheme", text), manifest).where(F.col("_scheme").isNotNull() & F.col("document_id").isNotNull())
    named = cut(base.select("_scheme", F.col("document_id").alias("_doc")).distinct())
    totals = small(cut(named.groupBy("_scheme").agg(F.count("*").alias("_docs"))))
    docs = cut(_numbered(named, totals))
    need = _need(share, least)
    frequent = frequent_keys(base, totals, share, least, text)
    hit = _lines(base, text, raw=True).join(small(frequent), ["_scheme", "_hash"])
    at = cut(hit.select("chunk_id", "line_no", "_doc", "_scheme", "_key", F.xxhash64("_line").alias("_variant"), "_line"))
    placed = at.join(docs, ["_scheme", "_doc"])
    per_variant = placed.groupBy("_scheme", "_key", "_bucket", "_variant").agg(F.expr("bitmap_construct_agg(_bit)").alias("_bits"), F.min("_line").alias("_line"))
    united = cut(per_variant.groupBy("_scheme", "_key", "_bucket").agg(F.expr("bitmap_or_agg(_bits)").alias("_bits"), F.min("_line").alias("_line")))
    kept = cut(
        united.groupBy("_scheme", "_key")
        .agg(F.sum(F.expr("bitmap_count(_bits)")).alias("_n"), F.min("_line").alias("example"))
        .join(totals, "_scheme")
        .where(F.col("_n") >= need)
    )
    variants = at.groupBy("_scheme", "_key").agg(F.count_distinct("_variant").alias("variants"))
    lines_out = kept.join(variants, ["_scheme", "_key"]).select(F.col("_scheme").alias("scheme"), F.col("_key").alias("line_key"), "example", "variants", F.col("_n").alias("documents"), (F.col("_n") / F.col("_docs")).alias("share"))
    bit = F.expr("shiftright(conv(hex(substring(_bits, CAST(_bit DIV 8 AS INT) + 1, 1)), 16, 10), CAST(_bit % 8 AS INT)) & 1")
    cases = (
        placed.join(united.join(small(kept.select("_scheme", "_key")), ["_scheme", "_key"]).select("_scheme", "_key", "_bucket", "_bits"), ["_scheme", "_key", "_bucket"])
        .where(bit == 1)
        .select("chunk_id", F.col("line_no").cast("long").alias("line_no"))
        .distinct()
    )
    return lines_out, cases


def remove_lines(chunks: DataFrame, cases: DataFrame, text: str = "text") -> DataFrame:
    """Chunks with `clean`: their text without the lines of `cases`; other columns stay. Null text stays null."""
    gone = cases.groupBy(F.col("chunk_id").alias("_c")).agg(F.collect_set("line_no").alias("_gone"))
    kept = F.expr(f"array_join(filter(split(`{text}`, '\\n', -1), (x, i) -> NOT array_contains(_gone, CAST(i AS BIGINT))), '\\n')")
    return chunks.join(gone, F.col("chunk_id") == F.col("_c"), "left").withColumn("clean", F.when(F.col("_gone").isNull(), F.col(text)).otherwise(kept)).drop("_c", "_gone")
