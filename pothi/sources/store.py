"""A store of partitioned parquet tables with upserts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pothi import schemas
from pothi.sources.readers import check_schema

BUCKETS = 64


class Store:
    """Tables runs, chunks and embeddings under one folder.

    Chunks and embeddings are partitioned by (run_id, bucket), bucket = hash of the document: a write replaces only the partitions it
    touches, however many documents a run has. A document is replaced as a whole, also by nothing.

    A write first lays down its partitions, and the names of those it empties, beside the table; once they are complete the change is decided.
    What a crash left undone is then done when the store is opened again, and may be done twice. A half-written change is forgotten. Readers that come
    during a write may see some partitions before others. One writer at a time.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        for name, partitions in (("runs", []), ("chunks", ["run_id", "bucket"]), ("embeddings", ["run_id", "bucket"])):
            if self._exists(f"_{name}.new/data/_SUCCESS"):
                self._apply(name, partitions)

    def _path(self, name: str) -> str:
        return f"{self.folder}/{name}"

    def _exists(self, name: str) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self._path(name))
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def read(self, name: str, schema: str) -> DataFrame:
        if not self._exists(name):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(self._path(name))

    def runs(self) -> DataFrame:
        return self.read("runs", schemas.RUN)

    def chunks(self) -> DataFrame:
        return self.read("chunks", f"{schemas.CHUNK}, bucket int").drop("bucket")

    def start_run(self, run: DataFrame) -> None:
        """K1: insert or replace run rows; every axis must be there."""
        check_schema(run, schemas.RUN)
        if run.where(" OR ".join(f"{c.split()[0]} IS NULL" for c in schemas.RUN.split(", "))).limit(1).count():
            raise ValueError("a run needs all its columns")
        kept = self.runs().join(run.select("run_id"), "run_id", "left_anti")
        self._swap("runs", kept.unionByName(run.select(*kept.columns)), [])

    def _file(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self._path(name))
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _swap(self, name: str, df: DataFrame, partitions: list[str], touched: DataFrame | None = None) -> None:
        """Replace the touched partitions (all rows, without partitions) by those of `df`; a touched partition without a row is emptied."""
        fs, beside = self._file(f"_{name}.new")
        fs.delete(beside, True)
        if touched is not None:
            # A row per touched partition, which has no data file afterwards unless df has rows of it.
            touched.select(*partitions).distinct().write.parquet(self._path(f"_{name}.new/touched"))
        writer = df.write
        (writer.partitionBy(*partitions) if partitions else writer).parquet(self._path(f"_{name}.new/data"))
        self._apply(name, partitions)

    def _apply(self, name: str, partitions: list[str]) -> None:
        fs, beside = self._file(f"_{name}.new")
        data = self._path(f"_{name}.new/data")
        if partitions:
            fs.mkdirs(self._file(name)[1])
            escape = self.spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
            for r in self.spark.read.parquet(self._path(f"_{name}.new/touched")).toLocalIterator():
                part = "/".join(f"{c}={escape(str(r[c]))}" for c in partitions)
                _, new = self._file(f"_{name}.new/data/{part}")
                _, old = self._file(f"{name}/{part}")
                if fs.exists(new) or not self._exists(f"_{name}.new/moved/{part}"):
                    fs.delete(old, True)
                if fs.exists(new):  # a renamed folder: no data is written twice
                    fs.mkdirs(old.getParent())
                    fs.mkdirs(self._file(f"_{name}.new/moved/{part}")[1])
                    fs.rename(new, old)
        else:
            fs.delete(self._file(name)[1], True)
            fs.rename(self._file(f"_{name}.new/data")[1], self._file(name)[1])
        fs.delete(beside, True)

    @staticmethod
    def _bucket(col: str = "document_id"):
        return F.pmod(F.xxhash64(col), F.lit(BUCKETS)).cast("int")

    def replace_documents(self, documents: DataFrame, chunks: DataFrame) -> None:
        """K2/K3: all chunks of the given (run_id, document_id) rows are replaced by `chunks`, which may have none of them."""
        keys = documents.select("run_id", "document_id").where(F.col("run_id").isNotNull() & F.col("document_id").isNotNull()).distinct()
        touched = keys.select("run_id", self._bucket().alias("bucket")).distinct()
        held = self.read("chunks", f"{schemas.CHUNK}, bucket int").join(touched, ["run_id", "bucket"], "left_semi").join(keys, ["run_id", "document_id"], "left_anti")
        new = check_schema(chunks, schemas.CHUNK).join(keys, ["run_id", "document_id"], "left_semi").withColumn("bucket", self._bucket())
        columns = [c.split()[0] for c in schemas.CHUNK.split(", ")] + ["bucket"]
        self._swap("chunks", held.select(*columns).unionByName(new.select(*columns)), ["run_id", "bucket"], touched)

    def chunks_of(self, run_id: str) -> DataFrame:
        """S14."""
        return self.chunks().where(F.col("run_id") == run_id).orderBy("document_id", "ordinal")

    def upsert_embeddings(self, vectors: DataFrame) -> None:
        """K4: insert or replace by (run_id, document_id, ordinal, model). text_hash says which text a vector belongs to (Q14)."""
        schema = "run_id string, document_id string, ordinal int, model string, text_hash string, vector array<float>, bucket int"
        new = vectors.withColumn("bucket", self._bucket())
        held = self.read("embeddings", schema).join(new.select("run_id", "bucket").distinct(), ["run_id", "bucket"], "left_semi").join(new.select("run_id", "document_id", "ordinal", "model"), ["run_id", "document_id", "ordinal", "model"], "left_anti")
        columns = [c.strip().split(" ")[0] for c in schema.split(", ")]
        self._swap("embeddings", held.select(*columns).unionByName(new.select(*columns)), ["run_id", "bucket"], new.select("run_id", "bucket"))

    def embeddings(self) -> DataFrame:
        return self.read("embeddings", "run_id string, document_id string, ordinal int, model string, text_hash string, vector array<float>, bucket int").drop("bucket")


def cache_key(stem: str, converter: str, version: str, content: str):
    """K5: name of a cached conversion: stem, converter and version, first 16 digits of the content's sha256."""
    return F.concat(F.col(stem), F.lit("."), F.lit(converter), F.lit("-"), F.lit(version), F.lit("."), F.substring(F.sha2(F.col(content), 256), 1, 16), F.lit(".json"))


def write_blocks(blocks: DataFrame, path: str) -> None:
    """K5: blocks as one JSON document per source document."""
    rows = blocks.groupBy("document_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("seq", "text", "page", "kind", "level"))), lambda b: F.struct(b["text"].alias("text"), b["page"].alias("page"), b["kind"].alias("kind"), b["level"].alias("level"))).alias("blocks"))
    rows.write.mode("overwrite").json(path)


def write_json_lines(df: DataFrame, path: str, order: list[str] | None = None) -> None:
    """K6/K7: JSON lines with sorted keys, nulls kept; range-sorted files, not one file."""
    rows = df.select(*sorted(df.columns))
    (rows.orderBy(*order) if order else rows).write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_tsv(df: DataFrame, path: str) -> None:
    """K8."""
    df.write.mode("overwrite").option("sep", "\t").option("header", True).csv(path)


def append_json(df: DataFrame, path: str) -> None:
    """K9."""
    df.write.mode("append").json(path)
