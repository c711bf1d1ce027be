"""Exact deduplication by progressive refinement: length, then prefix hash, then full hash.

One narrow staged table has the length of every row's normalised text and a hash of its first
characters. Rows are counted by both at once, with partial aggregates: a length that one row has
drops out (level 1), and so does a prefix that one row of its length has (level 2). Only rows that
still share (length, prefix hash) with another row have their whole text hashed (SHA-256), in a
second scan filtered by the surviving keys (beyond a broadcast by a bit filter of them first), so no text is ever shuffled, and a group with a third
of all rows costs one row per task.

Defined results: null text counts as empty; empty texts equal each other; of rows that repeat id and
text as they stand exactly one is kept, whichever was read first; no rows in, no rows out; other
columns of the input are not read.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.llm.common import BROADCAST_ROWS, discard, documents, key_filter, stage

WHITE = " \t\n\x0b\x0c\r"
PREFIX_CHARS = 64


def normalised(text: Column) -> Column:
    """The text without the characters [\\x20\\x09-\\x0D]; null gives the empty string."""
    out = F.coalesce(text, F.lit(""))
    for ch in WHITE:
        out = F.replace(out, F.lit(ch), F.lit(""))
    return out


def _keyed(docs: DataFrame, id_col: str, text_col: str, digest: bool) -> DataFrame:
    norm = normalised(F.col(text_col))
    cols = [
        F.col(id_col).alias("id"),
        F.xxhash64(text_col).alias("th"),
        F.char_length(F.coalesce(F.col(text_col), F.lit(""))).alias("chars"),
        F.octet_length(norm).alias("n"),
        F.xxhash64(F.substring(norm, 1, PREFIX_CHARS)).alias("prefix"),
    ]
    return docs.select(*cols, *([F.sha2(norm, 256).alias("digest")] if digest else []))


def _candidates(docs: DataFrame, keys: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """`_keyed` with digests of the rows that a bit filter of too many keys to broadcast lets pass: they
    are picked before the join's shuffle, so no other text is hashed in full."""
    wanted = stage(keys.select(F.xxhash64("n", "prefix").alias("key")), "exact-filter")
    may_hold = key_filter(wanted, "key")
    discard(wanted)

    @F.pandas_udf("boolean")
    def picked(key: pd.Series) -> pd.Series:
        return pd.Series(may_hold(key.to_numpy()))

    norm = normalised(F.col(text_col))
    key = F.xxhash64(F.octet_length(norm), F.xxhash64(F.substring(norm, 1, PREFIX_CHARS)))
    return _keyed(docs.filter(picked(key)), id_col, text_col, True)


def exact_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest_all: bool = False
) -> DataFrame:
    """One row per input row: id, th (hash of the text), keep_id, group_size, kept, digest.

    Of equal texts the one with the most code points stays, then the smallest id. `digest` is
    null for rows decided by length or prefix, unless `digest_all` asks for it everywhere.
    """
    narrow = stage(_keyed(docs, id_col, text_col, False), "exact-keys")
    sizes = narrow.groupBy("n", "prefix").agg(F.count("*").alias("c"))
    keys = stage(sizes.filter("c > 1").select("n", "prefix"), "exact-survivors")
    few = keys.count() <= BROADCAST_ROWS
    side = F.broadcast(keys) if few else keys
    full = _keyed(docs, id_col, text_col, True)
    read = full if few or digest_all else _candidates(docs, keys, id_col, text_col)
    survivors = read.join(side, ["n", "prefix"], "left_semi").withColumn("row", F.monotonically_increasing_id())
    survivors = stage(survivors, "exact-full")  # rows have their numbers from here on
    groups = stage(
        survivors.groupBy("n", "digest")
        .agg(
            F.count("*").alias("group_size"),
            F.min(F.struct((-F.col("chars")).alias("c"), F.col("id").alias("keep_id"), "row")).alias("best"),
        )
        .filter("group_size > 1")
        .select("n", "digest", "group_size", F.col("best.keep_id").alias("keep_id"), F.col("best.row").alias("keep_row")),
        "exact-groups",
    )
    groups = F.broadcast(groups) if groups.count() <= BROADCAST_ROWS else groups
    in_groups = survivors.join(groups, ["n", "digest"], "left").select(
        "id",
        "th",
        F.when(F.col("group_size").isNull(), F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("row") == F.col("keep_row"), F.lit(True)).alias("kept"),
        "digest",
    )
    rest = (full if digest_all else narrow).join(side, ["n", "prefix"], "left_anti")
    if digest_all:
        discard(narrow)
    alone = rest.select(
        "id",
        "th",
        F.col("id").alias("keep_id"),
        F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"),
        F.col("digest") if digest_all else F.lit(None).cast("string").alias("digest"),
    )
    return in_groups.unionByName(alone)


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = exact_dedup(documents(spark, sf_dir), digest_all=True)
    return out.select(
        F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256")
    )


OP5_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
  FROM documents
)
SELECT doc_id,
       first_value(doc_id) OVER (PARTITION BY norm ORDER BY chars DESC, doc_id) AS keep_id,
       count(*) OVER (PARTITION BY norm) AS group_size,
       first_value(doc_id) OVER (PARTITION BY norm ORDER BY chars DESC, doc_id) = doc_id AS kept,
       sha256(norm) AS text_sha256
FROM d
"""
