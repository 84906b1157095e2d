"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import functools
import gc
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of whole texts; see :func:`text_batches`."""
    text_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: a local one only in a session of one machine that names none."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not where and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return where or "/tmp/narralith-checkpoints"


def cut(df: DataFrame, *by: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts the lineage, outlives executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._narralith_path = path
    return out


def drop_cut(df: DataFrame) -> None:
    """Delete a table written by :func:`cut` that no later plan reads."""
    path = getattr(df, "_narralith_path", None)
    if path:
        jvm = df.sparkSession._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(p, True)


def released(run):
    """A mapInArrow function whose worker gives its memory back at the end of each task; workers serve task after task."""

    @functools.wraps(run)
    def wrapped(batches):
        import pyarrow as pa

        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except AttributeError:  # not this C library
                pass

    return wrapped


#: Rows of a batch between Spark and its Python workers: a row is a whole text here, not a number.
BATCH_ROWS = 512


def text_batches(spark: SparkSession) -> None:
    """Let batches of texts be small, unless the session has chosen their size."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, str(BATCH_ROWS))


def block_pairs(groups: DataFrame, key: list[str], block: int, block_bytes: int) -> DataFrame:
    """Rows (key, node, bytes, ...) with the block pairs (i, j) that they belong to, and their own block, ``mine``.

    A group of up to ``block`` rows and ``block_bytes`` is one block, 0, and each row comes once.
    """
    parts = F.greatest(F.ceil(F.count("*") / block), F.ceil(F.sum("bytes") / block_bytes)).cast("int")
    big = groups.groupBy(*key).agg(parts.alias("blocks")).where("blocks > 1")
    dealt = groups.join(big, key, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("mine", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(F.least(k, F.col("mine")).alias("i"), F.greatest(k, F.col("mine")).alias("j")))
    return dealt.withColumn("at", F.explode(pairs)).withColumns({"i": F.col("at.i"), "j": F.col("at.j")}).drop("at", "blocks", "bytes")
