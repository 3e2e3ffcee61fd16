"""What several corpus operators need: tables, the shared folder, and bounded Arrow batches."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: Bytes of the batches that Python workers get and give, so that neither they nor the JVM hold much more than that.
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession) -> None:
    spark.conf.set(BATCH, str(4 << 20))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of an input folder, read by Spark so that any store it knows will do."""
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    A cluster names it in ``spark.checkpoint.dir``. Only on a local master, where that is unset, one is made and set.
    """
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not folder:
        if not re.match(r"local(\[|$)", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="sparkloom-"))
        folder = sc.getCheckpointDir()
    return folder.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


#: Shuffle files of a finished write are removed at once, not when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def keep(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read again: cuts lineage and outlives lost executors."""
    spark = df.sparkSession
    small_batches(spark)
    path = new_path(spark, label)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._kept_at = path
    return out


def forget(*kept: DataFrame) -> None:
    """Removes what ``keep`` wrote. No frame that reads it may be run later."""
    for df in kept:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._kept_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def unused(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores before it as keep it apart from the columns of ``df`` (which ignore case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def pieces(batch: pa.RecordBatch, column: int, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of ``batch`` whose ``column`` of strings takes about ``most`` bytes; a longer row stands alone."""
    texts = batch.column(column)
    if not batch.num_rows:
        return
    mean = max(1, texts.nbytes // batch.num_rows)
    step = max(1, most // mean)
    for at in range(0, batch.num_rows, step):
        part = batch.slice(at, step)
        if part.num_rows > 1 and part.column(column).nbytes > 4 * most:
            for one in range(part.num_rows):
                yield part.slice(one, 1)
        else:
            yield part


def released(run: Callable) -> Callable:
    """``run`` over a task's batches, after which the worker gives free memory back to the system.

    Workers stay for the next tasks, so what their allocators hold on to would stand beside the JVM's own work.
    """

    @wraps(run)
    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # only some C libraries have it
            trim(0)

    return whole


def as_bytes(texts: pa.Array) -> list[bytes]:
    """The UTF-8 of each string, nulls as empty."""
    return [x or b"" for x in texts.cast(pa.large_binary() if pa.types.is_large_string(texts.type) else pa.binary()).to_pylist()]


def _unfolded(column: Column, kind: T.DataType) -> Column:
    """About how many bytes a value takes in memory."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(column), F.lit(0)).cast("long") + 16
    if isinstance(kind, T.ArrayType):
        return F.aggregate(F.coalesce(column, F.array().cast(kind)), F.lit(16).cast("long"), lambda n, x: n + _unfolded(x, kind.elementType))
    if isinstance(kind, T.StructType):
        return sum((_unfolded(column[f.name], f.dataType) for f in kind.fields), F.lit(16).cast("long"))
    return F.lit(8).cast("long")


def small_enough(df: DataFrame, most_mb: int = 16) -> DataFrame:
    """``df``, which ``keep`` has written, marked for broadcast if it takes less than ``most_mb`` unfolded; else as it is."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df._kept_at)
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(path).getLength() > most_mb << 20:
        return df
    width = sum((_unfolded(F.col(f.name), f.dataType) for f in df.schema.fields), F.lit(32).cast("long"))
    return F.broadcast(df) if (df.agg(F.sum(width)).first()[0] or 0) <= most_mb << 20 else df


#: Slots that keys are told apart by.
SLOTS = 1 << 18


def parted(rows: DataFrame, side: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """``rows`` whose ``key`` (a long, not null) may be in ``side``, and those whose key isn't.

    The slots that the keys of ``side`` take are broadcast: at most ``SLOTS`` numbers, however many keys. So most rows
    without a partner needn't be shuffled to learn that.
    """
    slot = unused(rows, "slot")
    taken = F.broadcast(side.select(F.pmod(F.col(key), F.lit(SLOTS)).cast("int").alias(slot)).distinct())
    rows = rows.withColumn(slot, F.pmod(F.col(key), F.lit(SLOTS)).cast("int"))
    return rows.join(taken, slot, "left_semi").drop(slot), rows.join(taken, slot, "left_anti").drop(slot)


def hub_limit(rows: int) -> int:
    """A key with more rows than this is a hub: there are at most 100,000 hubs, however many rows."""
    return max(256, rows // 100_000)


def hub_join(rows: DataFrame, side: DataFrame, key: str, n: str, limit: int, how: str = "inner") -> DataFrame:
    """``rows`` joined (inner or left) with ``side``, which has one row a ``key`` and says in ``n`` how many of ``rows`` have it.

    Keys with more than ``limit`` rows, of which there can be few, are joined by broadcast, so that none of them
    gathers in a task; the rest is shuffled. ``n`` isn't in the result.
    """
    hubs = side.where(F.col(n) > limit)
    many = rows.join(F.broadcast(hubs.drop(n)), key)
    few = rows.join(F.broadcast(hubs.select(key)), key, "left_anti").join(side.where(F.col(n) <= limit).drop(n), key, how)
    return few.unionByName(many)
