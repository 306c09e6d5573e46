"""Helpers shared by the training-data operators."""

from __future__ import annotations

import os
import sys
import tempfile
import types
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a longest run of letters, combining marks and digits.
WORD = r"[\p{L}\p{M}\p{Nd}]+"
_OUTER_SPACE = r"(?U)^\s+|\s+$"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def strip(col: Column) -> Column:
    """The text without Unicode white space at both ends."""
    return F.regexp_replace(col, _OUTER_SPACE, "")


def current_manifest(manifest: DataFrame) -> DataFrame:
    """One row per id, the one with the highest line_no. Rows without an id are dropped."""
    rest = [c for c in manifest.columns if c not in ("id", "line_no")]
    held = manifest.where(F.col("id").isNotNull()).groupBy("id").agg(F.max_by(F.struct(*rest), "line_no").alias("_row"))
    return held.select("id", *[F.col("_row")[c].alias(c) for c in rest])


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir or set in the context.

    Where neither is (tests, a session on one machine) a folder of that machine is taken if the master is local; on a cluster it is an error,
    as executors would not share it.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named is None:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = os.path.join(tempfile.gettempdir(), "pothi-checkpoints")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """Cut the lineage with a compressed table in the shared folder, deleted when the application ends.

    Takes less disk than a checkpoint where rows are many; the folder is that of spark.checkpoint.dir.
    """
    spark = df.sparkSession
    base = ensure_checkpoint_dir(spark)
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{base}/pothi-{uuid.uuid4().hex}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    df.write.option("compression", "zstd").parquet(path.toString())
    return spark.read.schema(df.schema).parquet(path.toString())


def language_name(col: Column) -> Column:
    """The language a label names, in any of its usual spellings, else null."""
    low = F.lower(F.regexp_replace(F.regexp_replace(col, r"(?U)\s+", ""), "_", "-"))
    return (
        F.when(low.rlike("^(hinglish|hi-latn.*|hin-latn.*)$"), "hinglish")
        .when(low.rlike("^(en|eng|english)(-.*)?$"), "en")
        .when(low.rlike("^(hi|hin|hindi)(-.*)?$"), "hi")
        .when(low.rlike("^(mr|mar|marathi)(-.*)?$"), "mr")
    )


#: Rows up to which a (narrow) table is broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 100_000


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """`df` with a broadcast hint if a count shows that it has few rows, else as it is. Give it only cut or cheap frames."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def process_state(name: str) -> dict:
    """A dictionary of this process, kept over tasks. Functions go to the workers by value, so their module's variables would start anew in every task."""
    home = sys.modules.setdefault("_pothi_state", types.ModuleType("_pothi_state"))
    return home.__dict__.setdefault(name, {})


#: Most bits of a filter that is sent to the workers (32 MB).
FILTER_BITS = 28
_SEGMENTS = 64


def filter_bits(rows: int, per_row: int = 16) -> int:
    """log2 of the size of a filter for so many hashes; beyond FILTER_BITS a filter only lets more pass, and loses none."""
    return int(min(max(int(rows * per_row).bit_length(), 16), FILTER_BITS))


def hash_filter(hashes: DataFrame, log2: int, twice: bool = False, hot: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Bit filter, 2^log2 bits, of the places of hashes: those that occur, or with `twice` those that occur more than once.

    hashes: one binary column of uint32 hashes, any number a row. Also (2, places) the places of more than `hot` hashes, in order, and their hashes.
    Every batch sends its places as sorted bytes by segment, at most 4 bytes a hash are shuffled, and the driver gets the bits (32 MB at most)
    and the hot places.
    """
    part = (1 << log2) // _SEGMENTS
    (column,) = hashes.columns

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            slots = np.frombuffer(b"".join(x for x in b.column(0).to_pylist() if x), np.uint32) & np.uint32((1 << log2) - 1)
            if not len(slots):
                continue
            slots = np.sort(slots) if twice or hot else np.unique(slots)
            ends = np.searchsorted(slots, np.arange(1, _SEGMENTS + 1, dtype=np.int64) * part)
            starts = np.concatenate([[0], ends[:-1]])
            yield pa.RecordBatch.from_arrays([pa.array(range(_SEGMENTS), pa.int32()), pa.array([slots[s:e].tobytes() for s, e in zip(starts, ends)], pa.binary())], ["segment", "slots"])

    def unite(t: pa.Table) -> pa.Table:
        segment = t.column("segment")[0].as_py()
        slots = np.sort(np.concatenate([np.frombuffer(x.as_buffer(), np.uint32) for x in t.column("slots")])) - np.uint32(segment * part)
        seen = np.zeros(part, bool)
        seen[slots[1:][slots[1:] == slots[:-1]] if twice else slots] = True
        over = np.zeros((2, 0), np.int64)
        if hot:
            place, rows = np.unique(slots[hot:][slots[hot:] == slots[:-hot]], return_counts=True)
            over = np.stack([place.astype(np.int64) + segment * part, rows + hot])
        return pa.table({"segment": t.column("segment").slice(0, 1), "slots": pa.array([np.packbits(seen, bitorder="little").tobytes()], pa.binary()), "hot": pa.array([over.tobytes()], pa.binary())})

    rows = hashes.select(F.col(column).cast("binary")).mapInArrow(send, "segment int, slots binary").groupBy("segment").applyInArrow(unite, "segment int, slots binary, hot binary").collect()
    bits = np.zeros((1 << log2) // 8, np.uint8)
    for r in rows:
        bits[r["segment"] * (part // 8) : (r["segment"] + 1) * (part // 8)] = np.frombuffer(r["slots"], np.uint8)
    over = [np.frombuffer(r["hot"], np.int64).reshape(2, -1) for r in sorted(rows, key=lambda r: r["segment"])]
    return bits, np.concatenate([np.zeros((2, 0), np.int64), *over], 1)


def passes(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether the place of each uint32 hash is set in a filter of hash_filter."""
    slots = hashes & np.uint32(len(bits) * 8 - 1)
    return (bits[slots >> np.uint32(3)] >> (slots & np.uint32(7)).astype(np.uint8)) & np.uint8(1) == 1
