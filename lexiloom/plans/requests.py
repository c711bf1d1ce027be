"""Segment requests and reports over tables."""

from __future__ import annotations

import time
from functools import reduce

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from lexiloom.operators import lattice

_REQUEST = "text string, function string, algorithm string"


def segment_requests(requests: DataFrame, lexicon: DataFrame, model=None, json_col: str = "request") -> DataFrame:
    """The other columns with `response`, `{"tokens": [...]}` of each JSON request.

    `algorithm` is dag, crf or hybrid (any other: hybrid), `function` search or plain. Requests that
    cannot be read have no tokens. One pass cuts each row in the way that it asks for.
    """
    r = F.from_json(json_col, _REQUEST)
    rows = requests.withColumn("_r", r).select(
        *[c for c in requests.columns if c != json_col],
        F.coalesce("_r.text", F.lit("")).alias("_text"),
        F.when(F.col("_r.algorithm").isin("dag", "crf"), F.col("_r.algorithm")).otherwise(F.lit("hybrid")).alias("_mode"),
        F.coalesce(F.col("_r.function") == "search", F.lit(False)).alias("_search"),
    )
    words = lattice.collect_lexicon(lexicon)
    if words is None:  # too large to broadcast: by joins, one way after another
        return _by_joins(rows, lexicon, model)
    cut = lattice.routed_udf(requests.sparkSession, words, model)
    return _answered(rows.withColumn("_tokens", cut("_text", "_mode", "_search")))


def _answered(rows: DataFrame) -> DataFrame:
    return rows.withColumn("response", F.to_json(F.struct(F.col("_tokens").alias("tokens")))).drop("_text", "_mode", "_search", "_tokens")


def _by_joins(rows: DataFrame, lexicon: DataFrame, model) -> DataFrame:
    parts = []
    for mode in ("dag", "crf", "hybrid"):
        for search in (False, True):
            mine = rows.filter((F.col("_mode") == mode) & (F.col("_search") == search))
            parts.append(lattice.segment(mine, "_text", lexicon, model, mode, search, out="_tokens"))
    return _answered(reduce(DataFrame.unionByName, parts))


def segmentation_report(sentences: DataFrame, lexicon: DataFrame, model=None, mode: str = "hybrid", text_col: str = "text") -> DataFrame:
    """The rows with `cut`, the tokens joined by ` / `, and their number."""
    out = lattice.segment(sentences, text_col, lexicon, model, mode)
    return out.withColumn("cut", F.array_join("tokens", " / ")).withColumn("n_tokens", F.size("tokens").cast("long")).drop("tokens")


def observed_report(
    sentences: DataFrame, lexicon: DataFrame, model=None, mode: str = "hybrid", text_col: str = "text"
) -> tuple[DataFrame, Observation]:
    """The report and its metrics (texts, characters, tokens), which the pass that reads the report counts."""
    seen = Observation("segmentation report")
    report = segmentation_report(sentences, lexicon, model, mode, text_col)
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return report.observe(
        seen, F.count("*").alias("texts"), total(F.char_length(text_col)).alias("characters"), total("n_tokens").alias("tokens")
    ), seen


def write_report(report: DataFrame, seen: Observation, path: str) -> dict[str, float]:
    """The report as a table at `path`; its metrics, the seconds it took and characters a second."""
    began = time.perf_counter()
    report.write.parquet(path)
    took = time.perf_counter() - began
    metrics = dict(seen.get)
    return metrics | {"seconds": took, "characters_per_second": metrics["characters"] / took}
