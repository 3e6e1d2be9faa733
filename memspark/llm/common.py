"""What the training-data operators share: table reads, scratch tables and distributed positions."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: What counts as a word in every size and shingle: a run of anything but these six white-space characters.
WORD = r"[^\x20\x09-\x0D]+"

_LET_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table of that name; also lets Python workers import this package where it isn't installed."""
    env = spark.sparkContext.environment
    if _ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (env.get("PYTHONPATH"), _ROOT) if x)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused(df: DataFrame, *names: str) -> list[str]:
    """A name like each of these that no column of df has, in any case."""
    taken = {c.lower() for c in df.columns}
    return [next(x for i in range(len(taken) + 1) if (x := f"__{n}{i or ''}") not in taken) for n in names]


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's spark.checkpoint.dir, or one of our own where it is unset and all runs on this machine."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="memspark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def cut(df: DataFrame, name: str, **options: str) -> DataFrame:
    """df written as Parquet to the shared folder and read again: cuts lineage, and survives lost executors.

    What was shuffled for it is of no more use once it is written, so the session is asked to let go of that at once.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/memspark-{uuid.uuid4().hex}/{name}"
    before = spark.conf.get(_LET_GO, None)
    spark.conf.set(_LET_GO, "true")
    try:
        df.write.options(**options).parquet(path)
    finally:
        if before is None:
            spark.conf.unset(_LET_GO)
        else:
            spark.conf.set(_LET_GO, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes what cut has written for these; for tables that only other written tables were made of."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._cut)
        path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def running_start(df: DataFrame, group: str, weight: str, order: list[str], out: str, buckets: int) -> DataFrame:
    """Adds out: the sum of weight over the rows before each row, within its group, in the order of hashes. group must
    not be null; the order columns must tell all rows of a group apart.

    No group is ever sorted in one task: a hash of the order columns deals its rows into buckets, each (group, bucket) is
    numbered alone, and is then moved by the total of the buckets before it. The caller gives as many buckets as keep one small.
    """
    bucket, total, move, within = unused(df, "bucket", "total", "move", "within")
    dealt = df.withColumn(bucket, F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    totals = dealt.groupBy(group, bucket).agg(F.sum(weight).alias(total))
    before = Window.partitionBy(group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    moves = totals.select(group, bucket, F.coalesce(F.sum(total).over(before), F.lit(0)).alias(move))
    inner = Window.partitionBy(group, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = dealt.withColumn(within, F.coalesce(F.sum(weight).over(inner), F.lit(0)))
    return placed.join(moves, [group, bucket]).withColumn(out, F.col(within) + F.col(move)).drop(bucket, within, move)


def parts(batches: Iterator[pa.RecordBatch], column: int, most: int) -> Iterator[pa.RecordBatch]:
    """The rows of batches in slices whose values of a string or binary column, nulls counted as empty, make about most bytes; a longer value is a slice alone."""
    for batch in batches:
        sizes = batch.column(column).cast(pa.large_binary()).fill_null(b"")
        ends = np.frombuffer(sizes.buffers()[1], np.int64)[sizes.offset : sizes.offset + len(sizes) + 1] if len(sizes) else np.zeros(1, np.int64)
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, ends[at] + most, side="right")) - 1)
            yield batch.slice(at, to - at)
            at = to
