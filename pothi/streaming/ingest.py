"""Streaming ingest, an extension: files of blocks in, replaced documents in the store out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pothi.operators.chunking import CLEANERS, SPLITTERS
from pothi.schemas import BLOCK
from pothi.sources.store import Store


def ingest_stream(spark: SparkSession, source: str, store: Store, run_id: str, checkpoint: str, cleaning: str = "strip", splitter: str = "fixed") -> StreamingQuery:
    """Each file holds whole documents' blocks; every micro-batch cleans and splits them and replaces their chunks.

    Replacing is idempotent, so a batch that is tried again after a failure leaves the same chunks.
    """
    blocks = spark.readStream.schema(BLOCK).parquet(source)

    def replace(batch: DataFrame, _: int) -> None:
        batch = batch.persist()  # read for the chunks and for the list of documents
        try:
            chunks = batch.transform(CLEANERS[cleaning]).transform(SPLITTERS[splitter])
            full = chunks.select(F.lit(run_id).alias("run_id"), "document_id", "ordinal", "text", "page", "end_page", "kinds", *[F.lit(None).cast("string").alias(c) for c in ("section_path", "scheme", "doc_kind")])
            store.replace_documents(batch.select(F.lit(run_id).alias("run_id"), "document_id"), full)
        finally:
            batch.unpersist()

    return blocks.writeStream.foreachBatch(replace).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
