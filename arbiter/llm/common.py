"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arbiter.session import ensure_checkpoint_dir

#: A word is a run of code points that are not ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: The white space that separates words, as plain characters.
BLANKS = "\x20\t\n\x0b\x0c\r"
#: Text bytes that one Python batch handles at once; a longer single text is a batch of its own.
BATCH_BYTES = 4 << 20
#: Rows that go to a Python worker at once: the JVM holds a batch outside its heap, in vectors and again as the bytes sent.
BATCH_ROWS = 1000
#: Hash buckets of keys that a broadcast may hold.
KEY_BUCKETS = 1 << 21


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, label: str) -> DataFrame:
    """Cut lineage: write ``df`` as Parquet under the shared checkpoint folder and read it back.

    Lost executors then cost a reread, never a recomputation with other
    results.  The folder is the one that ``spark.checkpoint.dir`` names.
    """
    path = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Rows go to Python workers ``BATCH_ROWS`` at a time at most; a session that already sends fewer keeps its number.

    The session keeps this setting, as plans are run after they are returned.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def split_by_keys(rows: DataFrame, keys: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(maybe, never): the rows whose ``key`` may be among ``keys``, and those whose key cannot be, without a shuffle of rows.

    Only the distinct hash buckets of the keys are broadcast, ``KEY_BUCKETS`` at
    most whatever the data; some other rows share a bucket, so ``maybe`` still
    has to be joined.
    """
    bucket = F.pmod(F.xxhash64(key), F.lit(KEY_BUCKETS))
    few = F.broadcast(keys.select(bucket.alias("__bucket")).distinct())
    dealt = rows.withColumn("__bucket", bucket)
    return tuple(dealt.join(few, "__bucket", how).drop("__bucket") for how in ("left_semi", "left_anti"))


def without(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """``rows`` whose ``key`` is not among ``keys``; only rows that may be are shuffled."""
    maybe, never = split_by_keys(rows, keys, key)
    return never.union(maybe.join(keys.select(key), key, "left_anti").select(rows.columns))


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def word_count(text: Column) -> Column:
    """Number of words, without building an array of them (null: 0)."""
    marks = F.translate(F.regexp_replace(text, WORD, "x"), BLANKS, "")
    return F.coalesce(F.length(marks), F.lit(0)).cast("long")


def slices(batch: pa.RecordBatch, column: str, most: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a record batch so that each part holds about ``most`` bytes of ``column``."""
    if batch.num_rows == 0:
        return
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    cuts = np.flatnonzero(np.diff(ends // most, prepend=0)) + 1
    start = 0
    for stop in [*cuts.tolist(), batch.num_rows]:
        if stop > start:
            yield batch.slice(start, stop - start)
            start = stop
