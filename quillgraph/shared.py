"""Tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: list[str] = []

#: Bytes of compressed files for one partition of a shuffle.
PARTITION_BYTES = 8 << 20


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it is unset, a temporary folder in local mode, as in tests; on a cluster executors would each write to their own disk, so that is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="quillgraph-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def written(df: DataFrame, label: str) -> DataFrame:
    """df as Parquet in the shared folder, read again: cuts the lineage and survives lost executors."""
    path = f"{shared_folder(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _input_bytes(df: DataFrame) -> int:
    """Bytes of the files that df reads, each as often as it is read; what isn't from files counts nothing."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = (int(str(leaves.apply(k).stats().sizeInBytes())) for k in range(leaves.size()))
    return sum(n for n in sizes if n < 1 << 60)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df dealt out by keys in partitions whose number grows with the files read (a power of two), so that a task's share and memory don't."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    needed = 1 << max(_input_bytes(df) // PARTITION_BYTES - 1, 0).bit_length()
    return df.repartition(max(least, needed), *keys)


def remove_written(spark: SparkSession) -> None:
    """Removes what `written` made; for when no frame read from it is needed any more."""
    while _written:
        at = spark._jvm.org.apache.hadoop.fs.Path(_written.pop())
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
