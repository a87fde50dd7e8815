"""Shared storage for intermediate tables, and the order of keys across partitions."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Largest number of bytes, estimated from a count, that is broadcast on purpose.
BROADCAST_BYTES = 64 << 20
#: Bytes of a batch of rows that goes to a Python worker.
BATCH_BYTES, _BATCH_SETTING = 4 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"
#: Stands for a null key where keys are compared; nulls sort first.
NULL_KEY = -(1 << 63)

_own_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or where
    that is unset (tests in local mode) one temporary folder per application. On a cluster
    a folder of one machine would lose data, so there the setting has to be made."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get(
        "spark.checkpoint.dir", None
    )
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        _own_dirs[app] = tempfile.mkdtemp(prefix="tidemark-")
    return _own_dirs[app]


def save(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write df as Parquet to the shared folder and read it again.

    Cuts the lineage: what reads the result survives the loss of any executor.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def drop(spark: SparkSession, path: str) -> None:
    """Remove a table written by save() that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def bounded_batches(spark: SparkSession) -> None:
    """Hand texts to Python workers in batches of bounded bytes, not only of rows, unless
    the session already says how large they may be: a worker holds a batch at a time. This
    sets spark.sql.execution.arrow.maxBytesPerBatch for the session, as it has to be in
    force when the result is computed."""
    if spark.conf.get(_BATCH_SETTING, None) is None:
        spark.conf.set(_BATCH_SETTING, str(BATCH_BYTES))


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run (batches to batches) with what Arrow keeps for later given back after each batch:
    a worker is used again by other tasks and stages, and would keep it."""

    def wrapped(batches: Iterator) -> Iterator:
        for batch in run(batches):
            yield batch
            pa.default_memory_pool().release_unused()
        pa.default_memory_pool().release_unused()

    return wrapped


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def small(df: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    """df with a broadcast hint if its counted size is below the bound, else as it is."""
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_BYTES else df


def quoted(column: str) -> str:
    """The name of a column as a reference, whatever characters it has."""
    return "`" + column.replace("`", "``") + "`"


def key_of(column: str):
    return F.coalesce(F.col(column).cast("long"), F.lit(NULL_KEY))


def neighbours(keys: DataFrame, key: str, *carried: str) -> DataFrame:
    """For each row of keys (distinct in key) the next key in ascending order, the
    previous key, and the carried columns of the previous row as prev_<name>.

    After the last key comes the first. Rows are range-partitioned by key and ordered
    within each partition; only one row a partition meets in a single task.
    """
    spark = keys.sparkSession
    shards, _ = save(
        keys.repartitionByRange(partitions(spark), key).withColumn("shard", F.spark_partition_id()),
        "order",
    )
    inside = Window.partitionBy("shard").orderBy(key)
    across, everything = Window.orderBy("shard"), Window.orderBy("shard").rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing
    )
    last = F.max_by(F.struct(key, *carried), key)
    edges = shards.groupBy("shard").agg(F.min(key).alias("lo"), last.alias("hi"))
    edges = edges.select(
        "shard",
        F.coalesce(F.lead("lo").over(across), F.first("lo").over(everything)).alias("after"),
        F.coalesce(F.lag("hi").over(across), F.last("hi").over(everything)).alias("before"),
    )
    rows = shards.select(
        "*",
        F.lead(key).over(inside).alias("in_next"),
        F.lag(F.struct(key, *carried)).over(inside).alias("in_prev"),
    ).join(F.broadcast(edges), "shard")  # one row a partition
    prev = F.coalesce("in_prev", "before")
    return rows.select(
        key,
        *carried,
        F.coalesce("in_next", "after").alias("next_key"),
        prev[key].alias("prev_key"),
        *(prev[c].alias(f"prev_{c}") for c in carried),
    )
