"""The queries of the training-data operators and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import current_manifest, language_name, read
from .consensus import consensus
from .language import chunk_prototypes, document_prototypes, documents_of_chunks, passages, scores
from .leakage import RUN, leaks
from . import near_duplicates
from .packing import containers, pack
from .reading_level import LEVELS, profile, reading_levels
from .repeated_lines import remove_lines, repeated_lines
from .scanned_text import Repairer
from .similar_vectors import most_similar, similar_pairs
from .splitting import split_oversized


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Repairer(read(spark, sf_dir, "chunks"), read(spark, sf_dir, "manifest")).fixes()


def p1_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Repairer(read(spark, sf_dir, "chunks"), read(spark, sf_dir, "manifest")).texts()


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    items, _ = consensus(read(spark, sf_dir, "second_annotation"))
    return items.where(F.col("label") == "no").select("question_id")


def p2_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consensus(read(spark, sf_dir, "second_annotation"))[0]


def p2_annotators(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consensus(read(spark, sf_dir, "second_annotation"))[1]


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.similar_pairs(*near_duplicates.similar_texts(read(spark, sf_dir, "chunks")))


def p3_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.groups(*near_duplicates.similar_texts(read(spark, sf_dir, "chunks")))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_lines(read(spark, sf_dir, "chunks"), read(spark, sf_dir, "manifest"))[1]


def p4_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_lines(read(spark, sf_dir, "chunks"), read(spark, sf_dir, "manifest"))[0].drop("share")


def p4_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = read(spark, sf_dir, "chunks")
    cases = repeated_lines(chunks, read(spark, sf_dir, "manifest"))[1]
    return remove_lines(chunks.select("chunk_id", "text"), cases).select("chunk_id", "clean").dropDuplicates(["chunk_id"])


def _language(spark: SparkSession, sf_dir: str):
    chunks, manifest = read(spark, sf_dir, "chunks"), read(spark, sf_dir, "manifest")
    return chunks, manifest, chunk_prototypes(chunks, manifest)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks, manifest, prototypes = _language(spark, sf_dir)
    told = scores(chunks, prototypes).where(F.col("sentences") > 0)
    named = current_manifest(manifest.select("id", "line_no", "language")).select(F.col("id").alias("document_id"), language_name(F.col("language")).alias("_named"))
    other = told.join(named, "document_id", "left").where(F.col("_named").isNull() | (F.col("_named") != F.col("lang")))
    return other.select("chunk_id", "lang").distinct()


def p5_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks, _, prototypes = _language(spark, sf_dir)
    once = chunks.groupBy("chunk_id").agg(F.max(F.struct("written", "document_id", "text")).alias("r")).select("chunk_id", "r.document_id", "r.text")
    return documents_of_chunks(scores(once, prototypes))


def p5_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks, _, prototypes = _language(spark, sf_dir)
    return passages(chunks, prototypes).dropDuplicates(["chunk_id", "start"])


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_pairs(most_similar(read(spark, sf_dir, "chunk_vectors")))


def p6_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return most_similar(read(spark, sf_dir, "chunk_vectors"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_oversized(read(spark, sf_dir, "chunks")).where(F.col("n_pieces") > 1).select("chunk_id").distinct()


def p7_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = split_oversized(read(spark, sf_dir, "chunks"))
    return pieces.dropDuplicates(["chunk_id", "piece_no"])


def p8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents"))


def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return containers(pack(read(spark, sf_dir, "documents")))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "questions"))
    return found.where(F.col("run") >= RUN).select("doc_id", "question_id").distinct()


def p9_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "questions"))


def p10_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read(spark, sf_dir, "documents")
    return reading_levels(documents, document_prototypes(documents))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p10_levels(spark, sf_dir).where(F.col("level") == LEVELS[2]).select("doc_id")


def p10_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile(p10_levels(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [p1_found, p1_repaired, p2_found, p2_consensus, p2_annotators, p3_found, p3_groups, p4_found, p4_lines, p4_clean, p5_found, p5_documents, p5_passages, p6_found, p6_neighbours, p7_found, p7_pieces, p8_packing, p8_containers, p9_found, p9_leaks, p10_found, p10_levels, p10_profile]
    return {f.__name__: f for f in found}


#: Lines of all chunks with their scheme and key, and those repeated in a scheme.
_P4 = r"""
    WITH m AS (SELECT id, arg_max(coalesce(scheme, ''), line_no) AS ms FROM manifest WHERE id IS NOT NULL GROUP BY id),
    c AS (SELECT DISTINCT chunk_id, document_id, coalesce(scheme, nullif(ms, '')) AS s, text FROM chunks LEFT JOIN m ON id = document_id),
    t AS (SELECT s, count(DISTINCT document_id) AS docs FROM c WHERE s IS NOT NULL GROUP BY s),
    a AS (SELECT chunk_id, document_id, s, string_split(text, chr(10)) AS ls FROM c WHERE s IS NOT NULL AND text IS NOT NULL),
    b AS (SELECT chunk_id, document_id, s, unnest(ls) AS line, unnest(range(len(ls))) AS line_no FROM a),
    l AS (SELECT *, lower(regexp_replace(line, '[^\p{L}\p{M}]+', '', 'g')) AS k FROM b),
    g AS (SELECT s, k, count(DISTINCT document_id) AS documents, count(DISTINCT line) AS variants, min(line) AS example
          FROM l WHERE regexp_matches(k, '\p{L}') GROUP BY s, k),
    q AS (SELECT g.*, docs FROM g JOIN t USING (s) WHERE documents >= greatest(3, ceil(docs * 0.15::DOUBLE - 1e-9)))
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p4_found": _P4 + "SELECT DISTINCT chunk_id, CAST(line_no AS BIGINT) AS line_no FROM l JOIN q USING (s, k)",
        "p4_lines": _P4 + "SELECT s AS scheme, k AS line_key, example, CAST(variants AS BIGINT) AS variants, CAST(documents AS BIGINT) AS documents FROM q",
        "p4_clean": _P4
        + """, gone AS (SELECT DISTINCT chunk_id, line_no FROM l JOIN q USING (s, k)),
            kept AS (SELECT b.chunk_id, string_agg(line, chr(10) ORDER BY line_no) AS clean
                     FROM (SELECT DISTINCT chunk_id, line, line_no FROM b) b ANTI JOIN gone USING (chunk_id, line_no) GROUP BY b.chunk_id)
            SELECT c.chunk_id, CASE WHEN text IS NOT NULL THEN coalesce(clean, '') END AS clean
            FROM (SELECT DISTINCT chunk_id, text FROM c) c LEFT JOIN kept USING (chunk_id)""",
        "p7_found": r"""
            SELECT DISTINCT chunk_id FROM chunks
            WHERE length(regexp_replace(text, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')) > 1200""",
    }
