"""Dictionary layers and text corpora as DataFrames.

A dictionary line is `word [freq]`; the tables carry `line`, `layer` (0 core, 1 base, 2 user) and
`ord`, the place of the line in its layer, because the last line of a word wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.functions.text import INTEGER, NUMBER, fields, trim_space

#: Frequency of a word that comes without one, and of one whose second field is no number.
NO_FREQ = 20000.0
BAD_FREQ = 1.0
#: Log-probability of a word that is not in the lexicon.
UNKNOWN = -20.0


def read_lines(spark: SparkSession, path: str, layer: int = 0) -> DataFrame:
    """(line, layer, ord) of text files; `ord` grows within and across the splits of a file."""
    raw = spark.read.option("lineSep", "\n").text(path)
    return raw.select(
        F.col("value").alias("line"),
        F.lit(layer).alias("layer"),
        F.struct(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("row"),
        ).alias("ord"),
    )


def parse_lines(lines: DataFrame) -> DataFrame:
    """(word, freq, layer, ord) of every line that is not blank."""
    f = F.col("f")
    number = F.when(F.get(f, F.lit(1)).rlike(NUMBER), F.get(f, F.lit(1)).try_cast("double"))
    freq = F.when(F.size(f) == 1, F.lit(NO_FREQ)).otherwise(F.coalesce(number, F.lit(BAD_FREQ)))
    return (
        lines.withColumn("f", fields("line")).filter(F.size("f") > 0).select(F.get(f, F.lit(0)).alias("word"), freq.alias("freq"), "layer", "ord")
    )


def load_dictionary(spark: SparkSession, path: str, layer: int = 0) -> DataFrame:
    return parse_lines(read_lines(spark, path, layer))


def combine_layers(*layers: DataFrame) -> DataFrame:
    """The lines of all layers, in order; every line stays."""
    out = layers[0]
    for df in layers[1:]:
        out = out.unionByName(df)
    return out


def effective(entries: DataFrame) -> DataFrame:
    """(word, freq): the last line of each word by layer and place."""
    return entries.groupBy("word").agg(F.max_by("freq", F.struct("layer", "ord")).alias("freq"))


def dictionary_stats(entries: DataFrame) -> DataFrame:
    """One row (total, size, max_len): overridden lines count in the total."""
    return entries.agg(
        F.coalesce(F.sum("freq"), F.lit(0.0)).alias("total"),
        F.count_distinct("word").alias("size"),
        F.coalesce(F.max(F.char_length("word")), F.lit(0)).alias("max_len"),
    )


def logprob(freq: Column, total: Column) -> Column:
    """ln(freq / total); UNKNOWN without a total; null where it is no number (such a word is never chosen)."""
    return F.when(total <= 0, F.lit(UNKNOWN)).otherwise(F.ln(freq / total))


def layered_lexicon(entries: DataFrame, total: float | None = None) -> DataFrame:
    """(word, freq, logp, n); `total` may be given, else it is that of `dictionary_stats`."""
    if total is None:
        total = dictionary_stats(entries).first()["total"]
    logp = logprob(F.col("freq"), F.lit(float(total)))
    return effective(entries).select("word", "freq", logp.alias("logp"), F.char_length("word").alias("n"))


def word_lookup(words: DataFrame, lexicon: DataFrame) -> DataFrame:
    """`words` (word, ...) with known and freq (0 if unknown)."""
    known = lexicon.select("word", "freq").withColumn("known", F.lit(True))
    return words.join(known, "word", "left").withColumns(
        {"known": F.coalesce("known", F.lit(False)), "freq": F.coalesce("freq", F.lit(0.0))}
    )


def word_logprob(words: DataFrame, lexicon: DataFrame) -> DataFrame:
    """`words` (word, ...) with logp: UNKNOWN where the lexicon has none."""
    known = lexicon.select("word", "logp").withColumn("known", F.lit(True))
    return words.join(known, "word", "left").withColumn(
        "logp", F.when(F.col("known"), F.col("logp")).otherwise(F.lit(UNKNOWN))
    ).drop("known")


def dictionary_lines(entries: DataFrame) -> DataFrame:
    """(line): `word freq`, whole frequencies without a point."""
    freq = F.col("freq")
    whole = (freq == F.floor(freq)) & (F.abs(freq) < 1e15)
    text = F.when(whole, freq.cast("long").cast("string")).otherwise(freq.cast("string"))
    return entries.select(F.concat_ws(" ", "word", text).alias("line"))


def write_dictionary(entries: DataFrame, path: str) -> None:
    dictionary_lines(entries).write.text(path)


def load_brands(lines: DataFrame) -> DataFrame:
    """(brand): every whole line that is not blank."""
    return lines.select(trim_space("line").alias("brand")).filter("brand <> ''").distinct()


def read_text_corpus(lines: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows whose text is not blank, trimmed."""
    return lines.withColumn(text_col, trim_space(text_col)).filter(F.col(text_col) != "")


def corpus_lines(segmented: DataFrame, tokens_col: str = "tokens") -> DataFrame:
    """Rows with `line`: the tokens joined by one space; rows without tokens go."""
    return segmented.filter(F.size(tokens_col) > 0).withColumn("line", F.array_join(tokens_col, " ")).drop(tokens_col)


def write_segmented_corpus(segmented: DataFrame, path: str) -> None:
    corpus_lines(segmented).select("line").write.text(path)


def integer(text: Column) -> Column:
    """A whole number, or null."""
    return F.when(text.rlike(INTEGER), text.try_cast("long"))
