"""Shared folder, staging and small column helpers of the training-data operators."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: Rows of a side that may be broadcast after they were counted; every user has another way beyond it.
BROADCAST_ROWS = 500_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: `spark.checkpoint.dir` of the session.

    Only on one machine (`local[...]`, as in tests) a session that names none gets a temporary folder,
    for the life of the process; on a cluster that is an error, as executors share no local folder.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        path = spark.conf.get("lexiloom.own.checkpoint.dir", None)
    if not path:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="lexiloom-")
        atexit.register(shutil.rmtree, path, ignore_errors=True)
        path = "file://" + path
        spark.conf.set("lexiloom.own.checkpoint.dir", path)
    return path.rstrip("/")


def small_batches(spark: SparkSession, rows: int = 1000, mb: int | None = None) -> None:
    """Pass at most `rows` rows, and about `mb` MB if that is told, at once between the JVM and Python, so that long rows fit."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    if mb is not None:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(mb << 20))


#: Shuffle files of a finished query go at once; whoever runs the same DataFrame again makes them anew.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stage(df: DataFrame, label: str, **options: str) -> DataFrame:
    """Write `df` (with options of the writer) to the shared folder and read it back: lineage ends here, executors may go.

    The shuffle files that the write needed are removed when it is done.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.options(**options).parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged = path
    return out


def discard(*staged: DataFrame) -> None:
    """Remove staged tables that nothing reads any more: all that came of them is staged itself."""
    for df in staged:
        path = getattr(df, "_staged", None)
        if path is not None:
            spark = df.sparkSession
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def free_name(df: DataFrame, name: str) -> str:
    """`name`, with as many underscores before it as it takes to clash with no column of `df`."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else; texts of ASCII bytes alone take the faster built-in."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, ASCII_UPPER, ASCII_UPPER.lower())
    )


#: A key filter takes 16 bits a key, up to this bound; beyond it the filter only lets more keys pass.
BLOOM_BITS = 1 << 27
_PAGE = 4096


def key_filter(keys: DataFrame, col: str):
    """A function for tasks: which of an int64 array may be among the keys (a written table of longs).

    One-hash Bloom filter, built by bitmap aggregates and broadcast; at most BLOOM_BITS / 8 bytes.
    """
    bits = 1 << 16
    while bits < min(BLOOM_BITS, 16 * keys.count()):
        bits <<= 1
    at = F.pmod(col, F.lit(bits)) + 1
    pages = keys.groupBy(F.bitmap_bucket_number(at).alias("page")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits")
    )
    table_ = np.zeros((bits // (8 * _PAGE), _PAGE), dtype=np.uint8)
    for r in pages.collect():
        table_[r["page"] - 1] = np.frombuffer(bytes(r["bits"]), dtype=np.uint8)
    shared = keys.sparkSession.sparkContext.broadcast(table_)

    def may_hold(values: np.ndarray) -> np.ndarray:
        p = values.astype(np.int64) % bits
        bit = p % (8 * _PAGE)
        return ((shared.value[p // (8 * _PAGE), bit >> 3] >> (bit & 7).astype(np.uint8)) & 1) == 1

    return may_hold


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
