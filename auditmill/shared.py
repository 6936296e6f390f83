"""What jobs on a cluster share: the folder for written tables, cut lineage, numbers of rows, parts of batches."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one in the warehouse where that is unset.

    A cluster's warehouse in a folder of one machine is refused: other machines don't see it.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    if not spark.sparkContext.master.startswith("local") and (warehouse.startswith("file:") or ":" not in warehouse):
        raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
    return warehouse + "/checkpoints"


def cut(df: DataFrame) -> DataFrame:
    """Cuts lineage by a checkpoint in the shared folder, so that plans don't grow with levels and a lost executor costs one step."""
    spark = df.sparkSession
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(folder(spark))
    return df.checkpoint()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one in the warehouse where it is unset. A cluster's warehouse on one machine is refused."""
    own = spark.sparkContext._jsc.sc().getCheckpointDir()
    if not spark.conf.get("spark.checkpoint.dir", None) and own.isDefined():
        return own.get()
    return folder(spark)


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back: lineage ends there, and a lost executor costs nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/auditmill/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_path = path
    return out


def forget(df: DataFrame) -> None:
    """Deletes a written table that nothing reads any more."""
    path = getattr(df, "written_path", None)
    if path:
        jvm = df.sparkSession._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(p, True)


def numbered(df: DataFrame, name: str, *order: str) -> DataFrame:
    """df with a column of numbers from 0 in the order of its columns `order`, which must tell all rows apart.

    Two levels: rows are dealt by ranges of the order and numbered within their range, and a range begins where
    the counts of those before it end. So no task sees all rows; only the counts, one a range, meet.
    """
    dealt = cut(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    counts = dealt.groupBy("_range").agg(F.count("*").alias("_n"))
    before = counts.withColumn("_before", F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)))
    own = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1
    numbers = dealt.withColumn("_own", own).join(F.broadcast(before.select("_range", "_before")), "_range")  # a row a range
    return numbers.withColumn(name, (F.coalesce("_before", F.lit(0)) + F.col("_own")).cast("long")).drop("_range", "_own", "_before")


def parts(texts: pa.Array, *others: pa.Array, most: int = 1 << 20) -> Iterator[tuple[pa.Array, ...]]:
    """Slices of a batch of texts and of what stands beside them, each of `most` bytes of text at most beside its first row.

    Each row counts as 256 bytes more than its text has.

    A function that makes Python objects of a batch holds those of one slice at a time, however large batches are.
    """
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 256) // most
    cuts = [0, *(np.flatnonzero(np.diff(ends)) + 1).tolist(), len(texts)]
    for a, b in zip(cuts, cuts[1:]):
        yield tuple(x.slice(a, b - a) for x in (texts, *others))
