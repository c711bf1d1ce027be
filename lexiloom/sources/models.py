"""Tagger models: transitions (from_tag, to_tag, weight) and features (feature, tag, weight)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.functions.text import NUMBER, fields
from lexiloom.sources.dictionaries import read_lines

TAGS = "BMES"


def _tag(text: Column) -> Column:
    """0 to 3 for B, M, E, S; null for anything else."""
    return F.when(text.isin(*TAGS), F.instr(F.lit(TAGS), text) - 1)


def parse_model(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Transitions and features of lines `T from to weight` and `F feature tag weight`.

    Blank lines, comments (#), short lines, unknown tags and weights that are no number are passed
    over; the last line of a key wins.
    """
    f = F.col("f")
    rows = lines.withColumn("f", fields("line")).filter((F.size("f") >= 4) & ~F.get(f, F.lit(0)).startswith("#")).select(
        F.get(f, F.lit(0)).alias("kind"), F.get(f, F.lit(1)).alias("x"), F.get(f, F.lit(2)).alias("y"), F.when(F.get(f, F.lit(3)).rlike(NUMBER), F.get(f, F.lit(3)).try_cast("double")).alias("weight"), "ord"
    ).filter("weight IS NOT NULL")
    last = F.max_by("weight", "ord").alias("weight")
    trans = (
        rows.filter("kind = 'T'").select(_tag(F.col("x")).alias("from_tag"), _tag(F.col("y")).alias("to_tag"), "weight", "ord")
        .filter("from_tag IS NOT NULL AND to_tag IS NOT NULL").groupBy("from_tag", "to_tag").agg(last)
    )
    feats = (
        rows.filter("kind = 'F'").select(F.col("x").alias("feature"), _tag(F.col("y")).alias("tag"), "weight", "ord")
        .filter("tag IS NOT NULL").groupBy("feature", "tag").agg(last)
    )
    return trans, feats


def load_tagger_model(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return parse_model(read_lines(spark, path))


def model_lines(trans: DataFrame, feats: DataFrame) -> DataFrame:
    """(line): weights other than zero, six decimals."""
    name = lambda c: F.substring(F.lit(TAGS), F.col(c) + 1, F.lit(1))
    weight = F.format_string("%f", "weight")
    t = trans.filter("weight <> 0").select(F.concat_ws(" ", F.lit("T"), name("from_tag"), name("to_tag"), weight).alias("line"))
    f = feats.filter("weight <> 0").select(F.concat_ws(" ", F.lit("F"), "feature", name("tag"), weight).alias("line"))
    return t.unionByName(f)


def save_tagger_model(trans: DataFrame, feats: DataFrame, path: str) -> None:
    model_lines(trans, feats).write.text(path)
