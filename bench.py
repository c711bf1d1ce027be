"""Times the headline queries over $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.operators import lattice, vocabulary
from lexiloom.operators.tagger import Tagger
from lexiloom.plans import queries as Q
from lexiloom.plans import registry
from lexiloom.sources import dictionaries as D
from lexiloom.sources import tables

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINES = [
    "discover_words", "layered_lexicon", "lattice_edges", "cut_dag", "cut_tagger", "cut_hybrid", "cut_search", "segment_corpus",
    "token_counts", "clean_dictionary", "corpus_to_sentences", "train_tagger", "segmentation_report", "stream_discover",
]


def _rate(spark: SparkSession, docs: DataFrame, lexicon: lattice.Words, model: Tagger) -> float:
    docs = docs.repartition(int(CPUS) * 2).persist()
    chars = docs.agg(F.sum(F.char_length("text"))).first()[0]
    run = lattice.segment_udf(spark, lexicon, model, "hybrid")
    began = time.perf_counter()
    docs.select(run(F.col("text"))).write.format("noop").mode("overwrite").save()
    took = time.perf_counter() - began
    docs.unpersist()
    return chars / took


def _unlike(spark: SparkSession) -> DataFrame:
    """The documents with Latin letters as Chinese characters of one of 200 alphabets."""
    every = "".join(chr(0x4E00 + k) for k in range(200 * 26))
    mine = F.substring(F.lit(every), (F.col("doc_id") % 200 * 26 + 1).cast("int"), F.lit(26))
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    return docs.select("doc_id", F.call_function("translate", F.lower("text"), F.lit(tables.LATIN), mine).alias("text"))


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    registry.QUERIES["discover_words"](spark, SF_DIR).write.format("noop").mode("overwrite").save()  # warm-up
    took = {}
    for name in HEADLINES:
        began = time.perf_counter()
        registry.QUERIES[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - began, 3)
    # The published figure is characters a second of the hybrid cut with everything loaded.
    model = Q._tagger(spark, SF_DIR)
    rate = _rate(spark, Q._han(spark, SF_DIR), lattice.collect_lexicon(Q._lexicon(spark, SF_DIR)), model)
    # The same over 200 alphabets, so that few blocks are met twice.
    unlike = _unlike(spark)
    words = vocabulary.discover_words(unlike, 3).select("word", "freq", F.lit(0).alias("layer"), F.lit(0).alias("ord"))
    unlike_rate = _rate(spark, unlike, lattice.collect_lexicon(D.layered_lexicon(words)), model)
    print(
        json.dumps(
            {
                "metric": "total time of headline queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took,
                "sf": SF_DIR.rstrip("/").rsplit("/", 1)[-1].removeprefix("sf"), "hybrid_cut_chars_per_sec": round(rate),
                "hybrid_cut_chars_per_sec_unlike_blocks": round(unlike_rate),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
