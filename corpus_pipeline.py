"""Corpus cleaning pipeline: each stage takes the documents its predecessor kept.

Stages take (spark, docs, sf_dir) and return a DataFrame; all but the last return the columns of
`docs`. Decisions are made for rows, not for ids: they are joined back by id and a hash of the text,
null-safe, so a null or repeated id never takes another text with it. Of rows that repeat id and text
as they stand one stays where one of a group is to stay (of such rows with other values in other
columns, the first in the order of their JSON form).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.llm.common import BROADCAST_ROWS, documents, free_name, stage, table
from lexiloom.llm.decontaminate import decontaminate
from lexiloom.llm.exact_dedup import exact_dedup
from lexiloom.llm.jaccard_join import jaccard_components
from lexiloom.llm.language_id import predict, train
from lexiloom.llm.mixing import mix

#: Documents whose best language scores less are rejected.
LEAST_SCORE = 0.3


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """`docs` without the rows of the keys (id, th) in `gone`; where `one` holds, one row of the key stays."""
    gone = stage(gone.select("id", "th", "one"), "pipeline-gone")
    side = F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone
    i, h, one = (free_name(docs, c) for c in ("gone_id", "gone_th", "gone_one"))
    side = side.toDF(i, h, one)
    here = docs["doc_id"].eqNullSafe(F.col(i)) & F.xxhash64(docs["text"]).eqNullSafe(F.col(h))
    stays = docs.join(side, here, "left_anti")
    if gone.filter("one").isEmpty():
        return stays
    row = F.struct(*[docs[c] for c in docs.columns])
    again = docs.join(side.filter(F.col(one)), here).groupBy(F.col(i), F.col(h)).agg(F.min_by(row, F.to_json(row)).alias("row"))
    return stays.unionByName(again.select("row.*"))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a recognised language: `und` and scores below LEAST_SCORE go."""
    model = train(docs)
    p = free_name(docs, "predicted")
    told = docs.withColumn(p, predict(docs, model))
    return told.filter((F.col(p)["lang"] != "und") & (F.col(p)["score"] >= LEAST_SCORE)).drop(p)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    out = exact_dedup(docs).filter("group_size > 1")
    keys = out.groupBy("id", "th").agg(F.max("kept").alias("one"), F.min("kept").alias("all"))
    return without(docs, keys.filter("NOT all"))


def jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least id of each component of near-duplicates (then that of least text hash)."""
    rows = stage(jaccard_components(docs).filter("n_shingles > 0").groupBy("class_key", "id", "th").agg(F.count("*").alias("c")), "pipeline-near")
    place = F.struct(F.col("id").isNull().alias("no_id"), "id", "th")
    first = rows.groupBy("class_key").agg(F.min(place).alias("first"), F.sum("c").alias("members")).filter("members > 1")
    first = stage(first.select("class_key", "first"), "pipeline-first")
    first = F.broadcast(first) if first.count() <= BROADCAST_ROWS else first
    told = rows.join(first, "class_key").select("id", "th", "c", place.eqNullSafe(F.col("first")).alias("one"))
    return without(docs, told.filter("NOT one OR c > 1"))


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any benchmark window."""
    out = decontaminate(docs, table(spark, sf_dir, "benchmark"))
    return without(docs, out.filter("n_hit > 0").select("id", F.col("h").alias("th"), F.lit(False).alias("one")).distinct())


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with its place in the mix of sources."""
    return mix(docs)


STAGES = [
    ("language ID", language_id),
    ("exact dedup", exact),
    ("n-gram Jaccard join", jaccard),
    ("benchmark decontamination", benchmark),
    ("mixing sources to target weights", mixing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each one's result is written and read again."""
    docs = documents(spark, sf_dir)
    for k, (_, step) in enumerate(STAGES):
        docs = step(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stage(docs, f"pipeline-{k}")
    return docs


#: Learned weights decide the first stage, so no SQL gives these rows; tests hold them against brute force.
ORACLE_SQL = None
