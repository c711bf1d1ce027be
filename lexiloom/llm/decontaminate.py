r"""Benchmark decontamination by a prefix-filtered set join, in DataFrame functions alone.

Every benchmark item is cut into windows of `WINDOW` consecutive words (an item of fewer words
is one window). A window's tokens are ordered by rarity, the token's count over the whole corpus,
found in one scan that keeps nothing but benchmark words and aggregates before its shuffle. Since
containment has to be whole, the necessary prefix of a window is its one rarest token. A second
scan joins document words with those prefix tokens only, applies the positional bound (the token's
offset in the window fixes where the window would start) and the length bound (it has to end inside
the document), and verifies the words exactly in place, so nothing but true occurrences leaves the
scan. In that scan each word list ends in a mark with a build-side row of its own, which returns
every document's number of words without a third scan.

The benchmark side is broadcast in blocks of at most `BLOCK` windows, counted first; more blocks
mean more scans, never a larger broadcast.

Defined results: null or empty texts have no words; an item without words has no window; items
that repeat an id pool their windows; an item with a null id counts in n_hit and
n_items and has no place in the list of ids; rows that repeat a document's id and text get the same row
each; other columns are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.llm.common import ASCII_UPPER, documents, stage, table

WINDOW = 10
BLOCK = 200_000
#: Characters of words are digits, letters a-z and all beyond ASCII; a blank takes the place of others.
BREAKS = "".join(chr(c) for c in range(128) if not (chr(c).isalnum() or c == 32))
END = " "


def words_of(text: Column) -> Column:
    """The words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ of the text after A-Z to a-z, in order."""
    plain = F.translate(
        F.coalesce(text, F.lit("")), ASCII_UPPER + BREAKS, ASCII_UPPER.lower() + " " * len(BREAKS)
    )
    return F.array_remove(F.split(plain, " "), "")


def benchmark_windows(items: DataFrame, id_col: str, text_col: str, window: int) -> DataFrame:
    """item, words (the window's), n."""
    w = items.select(F.col(id_col).cast("string").alias("item"), words_of(F.col(text_col)).alias("w")).filter(
        F.size("w") > 0
    )
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - window, F.lit(0)))
    return (
        w.select("item", "w", F.explode(starts).alias("s"))
        .select("item", F.slice("w", F.col("s") + 1, window).alias("words"))
        .distinct()
        .withColumn("n", F.size("words"))
    )


def _prefixes(texts: DataFrame, windows: DataFrame, blocks: int) -> DataFrame:
    """item, words, n, token, off: each window that can occur, with its rarest token."""
    tokens = stage(windows.select("item", "words", "n", F.posexplode("words").alias("off", "token")), "bench-tokens")
    vocabulary = tokens.select("token").distinct()
    rarity = [
        texts.select(F.explode("w").alias("token"))
        .join(F.broadcast(_block(vocabulary, b, blocks)), "token", "left_semi")
        .groupBy("token")
        .agg(F.count("*").alias("df"))
        for b in range(blocks)
    ]
    counted = stage(reduce(DataFrame.unionByName, rarity), "bench-rarity")
    return stage(
        tokens.join(counted, "token", "left")
        .groupBy("item", "words", "n")
        .agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "token", "off")).alias("r"))
        .filter("r.df > 0")  # else a word that no document has
        .select("item", "words", "n", "r.token", "r.off"),
        "bench-prefix",
    )


def _block(df: DataFrame, b: int, blocks: int) -> DataFrame:
    return df if blocks == 1 else df.filter(F.pmod(F.xxhash64("token"), F.lit(blocks)) == b)


def occurrences(
    docs: DataFrame, items: DataFrame, id_col: str, text_col: str, item_col: str, item_text: str, window: int
) -> DataFrame:
    """True occurrences of windows (id, h, start, n, item, is_count); `is_count` tells a row's words in `start`."""
    windows = stage(benchmark_windows(items, item_col, item_text, window), "bench-windows")
    blocks = max(1, -(-windows.count() // BLOCK))
    texts = docs.select(
        F.col(id_col).alias("id"), F.xxhash64(text_col).alias("h"), words_of(F.col(text_col)).alias("w")
    )
    prefix = _prefixes(texts, windows, blocks)
    mark = prefix.sparkSession.range(1).select(
        F.lit(None).cast("string").alias("item"), F.array().cast("array<string>").alias("words"), F.lit(0).alias("n"),
        F.lit(END).alias("token"), F.lit(0).alias("off"), F.lit(True).alias("is_count"),
    )
    found = []
    for b in range(blocks):
        side = _block(prefix, b, blocks).withColumn("is_count", F.lit(False))
        words = F.array_append("w", F.lit(END)) if b == 0 else F.col("w")
        found.append(
            texts.select("id", "h", "w", F.posexplode(words).alias("pos", "token"))
            .join(F.broadcast(side.unionByName(mark) if b == 0 else side), "token")
            .withColumn("start", F.col("pos") - F.col("off"))
            .filter((F.col("start") >= 0) & (F.col("start") + F.col("n") <= F.size("w")))
            .filter(F.col("is_count") | (F.slice("w", F.greatest(F.col("start"), F.lit(0)) + 1, F.col("n")) == F.col("words")))
            .select("id", "h", "start", "n", "item", "is_count")
        )
    return reduce(DataFrame.unionByName, found)


def decontaminate(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
) -> DataFrame:
    """One row per document: id, h (hash of its text), n_words, n_hit, items (sorted array of ids), n_items."""
    found = stage(occurrences(docs, items, id_col, text_col, item_col, item_text, window), "bench-found")
    counted = found.filter("is_count").select("id", "h", F.col("start").cast("long").alias("n_words"))
    found = found.filter("NOT is_count")
    spans = found.select("id", "h", "start", "n").distinct()
    hit = (
        spans.select("id", "h", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("n") - 1)).alias("p"))
        .distinct()
        .groupBy("id", "h")
        .agg(F.count("*").alias("n_hit"))
    )
    items_of = found.groupBy("id", "h").agg(
        F.array_sort(F.collect_set("item")).alias("items"), F.max(F.col("item").isNull().cast("long")).alias("nameless")
    )
    per_doc = hit.withColumnsRenamed({"id": "i1", "h": "h1"}).join(
        items_of, F.col("i1").eqNullSafe(F.col("id")) & F.col("h1").eqNullSafe(F.col("h"))
    ).select("i1", "h1", "n_hit", "items", (F.size("items") + F.col("nameless")).alias("n_items"))
    per_doc = stage(per_doc, "bench-hits")
    return counted.join(
        per_doc, F.col("id").eqNullSafe(F.col("i1")) & F.col("h").eqNullSafe(F.col("h1")), "left"
    ).select(
        "id", "h", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
    )


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))
    return out.select(
        F.col("id").alias("doc_id"),
        "n_words",
        "n_hit",
        "n_items",
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


OP10_SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), bs AS (
  SELECT item, w, unnest(range(0, greatest(len(w) - 10, 0) + 1)) AS s FROM b WHERE len(w) > 0
), win AS (
  SELECT DISTINCT item, len(w[s + 1 : s + 10]) AS n, array_to_string(w[s + 1 : s + 10], ' ') AS k FROM bs
), sizes AS (SELECT DISTINCT n FROM win),
ds AS (
  SELECT doc_id, w, n, unnest(range(0, len(w) - n + 1)) AS s FROM w, sizes WHERE len(w) >= n
), dk AS (
  SELECT doc_id, n, s, array_to_string(w[s + 1 : s + n], ' ') AS k FROM ds
), hits AS (
  SELECT doc_id, dk.n AS n, s, item FROM dk JOIN win ON dk.n = win.n AND dk.k = win.k
), pos AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM hits) GROUP BY doc_id
), its AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
  FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id
)
SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN pos ON w.doc_id = pos.doc_id LEFT JOIN its ON w.doc_id = its.doc_id
"""
