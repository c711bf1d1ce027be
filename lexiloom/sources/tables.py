"""Input tables and the two views of the documents that the queries run on."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LATIN = "abcdefghijklmnopqrstuvwxyz"
#: One Chinese character for each Latin letter, so that the corpus has blocks of them.
HAN = "的一是不了在人有我他这中大来上国个到说们为子和你地出"


def shared_folder(spark: SparkSession) -> str:
    """A fresh folder under `spark.checkpoint.dir`, which driver and executors share.

    Where the session names none, one machine (`local[...]`) takes a temporary one for the life of the
    process; on a cluster that is an error.
    """
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        top = tempfile.mkdtemp(prefix="lexiloom-")
        atexit.register(shutil.rmtree, top, ignore_errors=True)
        top = "file://" + top
    return f"{top.rstrip('/')}/{uuid.uuid4().hex}"


#: Tables of fewer bytes are dealt out to all cores after they are read.
SMALL = 128 << 20


def spread(df: DataFrame) -> DataFrame:
    """A small table over all cores: a small file often is one row group, and so one task, however its
    rows are worked on. Larger tables are read as they lie, without a shuffle."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if size < SMALL else df


def han(text: Column | str) -> Column:
    return F.translate(F.lower(F.col(text) if isinstance(text, str) else text), LATIN, HAN)


def documents(spark: SparkSession, sf_dir: str, view: str = "latin") -> DataFrame:
    """(doc_id, text) of the documents as they are, or with Latin letters as Chinese characters."""
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return docs if view == "latin" else docs.withColumn("text", han("text"))


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/conversations.parquet")


def benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
