"""Vocabulary mining and cleaning: n-gram discovery, token counts, pruning, feedback."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexiloom.functions import text as T
from lexiloom.operators import lattice
from lexiloom.sources.dictionaries import integer
from lexiloom.sources.tables import shared_folder

#: Ratios and thresholds of the vocabulary loop.
LONGEST = 4
CORPUS_THRESHOLD = 5
LOG_THRESHOLD = 3
CORE_RATIO = 0.9
USER_RATIO = 1000.0
NOISE_RATIO = 5.0
NEW_WORD_FREQ = 10000
#: Bits a word in the filter of frequent words, and its bits at most; beyond them it only lets more words pass.
WORD_BITS, MOST_BITS = 16, 1 << 26
#: Characters of distinct blocks whose n-grams are counted in one pass; of more, each length takes a pass and
#: its shuffle carries only words that may be frequent.
ONE_PASS = 100_000_000


def _written(df: DataFrame) -> DataFrame:
    """`df` from the shared folder, for steps that read it several times: else each of them makes it anew."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def block_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(block, n): distinct runs of letters and numbers."""
    return docs.select(F.explode(T.letter_blocks(text_col)).alias("block")).groupBy("block").agg(F.count("*").alias("n"))


def discover_words(docs: DataFrame, threshold: int = CORPUS_THRESHOLD, longest: int = LONGEST, text_col: str = "text") -> DataFrame:
    """(word, freq): substrings of 2 to `longest` characters inside blocks, at least `threshold` times.

    Distinct blocks are counted first, so that the n-gram shuffle carries each block once. Where they have
    more than ONE_PASS characters, lengths are counted one after another: a word is no more frequent than
    its parts without the first and without the last character, so only words whose parts are frequent are
    counted and shuffled (`gram_rows`). What a pass finds is written to the shared folder.
    """
    blocks = block_counts(docs, text_col)
    count = lambda rows: rows.groupBy("word").agg(F.sum("n").alias("freq")).filter(F.col("freq") >= threshold)
    blocks = blocks.filter(F.char_length("block") >= 2).persist(StorageLevel.DISK_ONLY)  # each pass reads them
    chars = blocks.agg(F.sum(F.char_length("block"))).first()[0] or 0
    passes = [(2, longest)] if chars <= ONE_PASS else [(k, k) for k in range(2, longest + 1)]
    levels, told = [], None
    for shortest, most in passes:
        counted, path = count(gram_rows(blocks, shortest, most, told)), shared_folder(docs.sparkSession)
        counted.write.parquet(path)
        levels.append(docs.sparkSession.read.schema(counted.schema).parquet(path))
        told = levels[-1]
    blocks.unpersist()
    out = levels[0]
    for level in levels[1:]:
        out = out.unionByName(level)
    return out


def gram_rows(blocks: DataFrame, shortest: int, longest: int, frequent: DataFrame | None = None) -> DataFrame:
    """(n, word): substrings of `shortest` to `longest` characters of the blocks (block, n).

    With `frequent`, a written table of words, only those whose parts without the last and without the
    first character may be among them.
    """
    cut = blocks.select("n", F.explode(T.pieces("block", longest - 1)).alias("piece"))
    rows = cut.select("n", F.explode(T.grams("piece", longest, shortest=shortest)).alias("word"))
    if frequent is None:
        return rows
    known = word_filter(frequent)
    return rows.filter(known(T.stem("word")) & known(T.rest("word")))


def word_filter(words: DataFrame) -> Callable[[Column], Column]:
    """A column function: whether a word may be in `words` (word, ...), a written table.

    A bit for each hash, in one array of at most MOST_BITS bits that Spark makes as a scalar subquery.
    """
    bits = 1 << 12
    while bits < min(MOST_BITS, WORD_BITS * words.count()):
        bits <<= 1
    place = lambda w: F.pmod(F.xxhash64(w), F.lit(bits))
    on = words.select(place(F.col("word")).alias("h")).groupBy(F.shiftright("h", 6).alias("id")).agg(F.expr("bit_or(shiftleft(1L, int(h & 63)))").alias("bits"))
    slots = words.sparkSession.range(bits // 64).join(on, "id", "left").select("id", F.coalesce("bits", F.lit(0).cast("long")).alias("bits"))
    table = slots.agg(F.array_sort(F.collect_list(F.struct("id", "bits")))["bits"].alias("bits")).scalar()
    return lambda w: F.getbit(F.get(table, F.shiftright(place(w), 6).cast("int")), place(w).bitwiseAND(63).cast("int")) == 1


def word_ngrams(blocks: DataFrame, longest: int = LONGEST, block_col: str = "block") -> DataFrame:
    """The other columns with one row for each substring (`word`) of 2 to `longest` characters."""
    keep = [c for c in blocks.columns if c != block_col]
    cut = blocks.select(*keep, F.explode(T.pieces(block_col, longest - 1)).alias("piece"))
    return cut.select(*keep, F.explode(T.grams("piece", longest)).alias("word"))


def noisy_brand_filter(words: DataFrame, brands: DataFrame) -> DataFrame:
    """`words` (word, ...) without those of four characters or more that are one character and a brand."""
    tail = F.when(F.char_length("word") >= 4, T.rest("word"))
    return words.withColumn("_tail", tail).join(brands.select(F.col("brand").alias("_tail")), "_tail", "left_anti").drop("_tail")


def token_counts(lines: DataFrame, brands: DataFrame, line_col: str = "line") -> DataFrame:
    """(word, freq) of corpus tokens of two characters or more with a Han character, brand noise aside."""
    counts = (
        lines.select(F.explode(T.fields(line_col)).alias("word"))
        .filter((F.char_length("word") >= 2) & T.has_chinese("word"))
        .groupBy("word")
        .agg(F.count("*").alias("freq"))
    )
    return noisy_brand_filter(counts, brands)


def ranked(words: DataFrame) -> DataFrame:
    """Most frequent first, then by word, for display and files."""
    return words.orderBy(F.desc("freq"), "word")


def sum_duplicates(lines: DataFrame) -> DataFrame:
    """(word, freq) of dictionary lines: whole frequencies above zero of words without punctuation, summed."""
    f = F.col("f")
    rows = lines.withColumn("f", T.fields("line")).filter(F.size("f") >= 2).select(F.get(f, F.lit(0)).alias("word"), integer(F.get(f, F.lit(1))).alias("freq"))
    return rows.filter((F.col("freq") > 0) & ~T.contains_punctuation("word")).groupBy("word").agg(F.sum("freq").alias("freq"))


def prune_prefixes(words: DataFrame, ratio: float) -> DataFrame:
    """Without each word that the next one in byte order extends at `ratio` of its frequency or more.

    What extends a word of two characters or more begins with the same two, and words that begin with
    them are neighbours in byte order, so windows over two characters see all that counts. The next word
    after a single character is the least of those that it begins.
    """
    w = Window.partitionBy(F.substring("word", 1, 2)).orderBy("word")
    long = F.char_length("word") >= 2
    ahead = words.withColumns({"_next": F.lead("word").over(w), "_freq": F.lead("freq").over(w)})
    after = words.filter(long).groupBy(F.substring("word", 1, 1).alias("_one")).agg(F.min(F.struct("word", "freq")).alias("_after"))
    ahead = ahead.join(after, (F.char_length("word") == 1) & (F.col("word") == F.col("_one")), "left")
    next_, freq = F.when(long, F.col("_next")).otherwise(F.col("_after.word")), F.when(long, F.col("_freq")).otherwise(F.col("_after.freq"))
    drop = F.startswith(next_, "word") & (freq / F.col("freq") >= ratio)
    return ahead.filter(~F.coalesce(drop, F.lit(False))).select(*words.columns)


def prune_suffixes(words: DataFrame, ratio: float) -> DataFrame:
    """The same from the end of words."""
    back = words.withColumn("word", T.reverse_word("word"))
    return prune_prefixes(back, ratio).withColumn("word", T.reverse_word("word"))


def noisy_extensions(words: DataFrame, ratio: float = NOISE_RATIO) -> DataFrame:
    """Without words of three characters or more that only put one character before or behind a word
    more than `ratio` times as frequent; a protected last character is no noise behind."""
    known = words.select("word", "freq")
    front = known.select(F.col("word").alias("_front"), F.col("freq").alias("_ff"))
    tail = known.select(F.col("word").alias("_stem"), F.col("freq").alias("_sf"))
    long = F.char_length("word") >= 3
    rows = words.withColumn("_front", F.when(long, T.rest("word"))).withColumn(
        "_stem", F.when(long & ~T.protected_suffix("word"), T.stem("word"))
    )
    noisy = lambda c: F.coalesce(F.col(c) / F.col("freq") > ratio, F.lit(False))
    return rows.join(front, "_front", "left").join(tail, "_stem", "left").filter(~noisy("_ff") & ~noisy("_sf")).select(*words.columns)


def clean_dictionary(lines: DataFrame, ratio: float = CORE_RATIO) -> DataFrame:
    """(word, freq): duplicates summed, then prefixes, suffixes and noisy extensions pruned."""
    words = _written(sum_duplicates(lines))
    return noisy_extensions(_written(prune_suffixes(prune_prefixes(words, ratio), ratio)))


def merge_new_words(feedback: DataFrame) -> DataFrame:
    """(line, ...) that feedback adds to the user layer: a `word number` pair as it is, else each field
    with a frequency of its own."""
    f = F.col("_f")
    pair = (F.size(f) == 2) & F.get(f, F.lit(1)).rlike(T.INTEGER)
    made = F.when(pair, F.array(T.trim_space("line"))).otherwise(
        F.transform(f, lambda w: F.concat_ws(" ", w, F.lit(str(NEW_WORD_FREQ))))
    )
    keep = [c for c in feedback.columns if c != "line"]
    return feedback.withColumn("_f", T.fields("line")).select(*keep, F.explode(made).alias("line"))


def interference_candidates(feedback: DataFrame, longest: int | None = None) -> DataFrame:
    """(word): substrings of two characters or more that straddle a boundary of a feedback line.

    `longest` bounds their length where a dictionary has no longer word.
    """
    f = F.col("f")
    sizes = F.transform(f, lambda w: F.char_length(w))
    bounds = F.transform(
        F.sequence(F.lit(1), F.size(f) - 1), lambda i: F.aggregate(F.slice(sizes, F.lit(1), i), F.lit(0), lambda a, x: a + x)
    )
    rows = feedback.select(T.fields("line").alias("f")).filter(F.size("f") >= 2).select(F.array_join(f, "").alias("t"), bounds.alias("b"))
    n = F.char_length("t")
    spans = F.flatten(
        F.transform(
            F.sequence(F.lit(0), n - 2),
            lambda s: F.transform(
                F.sequence(s + 2, n if longest is None else F.least(n, F.greatest(s + longest, s + 2))),
                lambda e: F.struct(s.alias("s"), e.alias("e")),
            ),
        )
    )
    cut = rows.withColumn("x", F.explode(spans)).filter(
        F.exists("b", lambda b: (F.col("x.s") < b) & (b < F.col("x.e")))
    )
    return cut.select(F.substring(F.col("t"), F.col("x.s") + 1, F.col("x.e") - F.col("x.s")).alias("word")).distinct()


def straddling_words(feedback: DataFrame, words: DataFrame) -> DataFrame:
    """(word): those of `words`, all distinct, that straddle a boundary of a feedback line.

    Up to LEXICON_WORDS words are broadcast and searched in the lines, so a line costs its length times
    the longest word at most; more are joined to the lines' substrings.
    """
    found = lattice.collect_lexicon(words.select("word", F.lit(0.0).alias("logp")))
    if found is None:
        longest = words.agg(F.max(F.char_length("word"))).first()[0] or 2
        return words.join(interference_candidates(feedback, max(2, longest)), "word", "left_semi")
    shared = feedback.sparkSession.sparkContext.broadcast(found.levels)

    @F.arrow_udf("array<string>")
    def search(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        known = lattice.Words.of_levels(shared.value)
        for lines, sizes in batches:
            yield pa.array(across(known, lines.to_pylist(), sizes.to_pylist()), pa.list_(pa.string()))

    f = F.col("f")
    rows = feedback.select(T.fields("line").alias("f")).filter(F.size("f") >= 2)
    rows = rows.select(search(F.array_join(f, ""), F.transform(f, lambda w: F.char_length(w))).alias("found"))
    return rows.select(F.explode("found").alias("word")).distinct()


def across(known: lattice.Words, lines: list[str], sizes: list[list[int]]) -> list[list[str]]:
    """The distinct known words of each line that begin before and end behind one of its boundaries."""
    out = []
    for line, parts in zip(lines, sizes):
        codes = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
        start, size, _ = known.found(codes)
        bounds = np.cumsum(parts)[:-1]
        hit = np.searchsorted(bounds, start, side="right") < np.searchsorted(bounds, start + size, side="left")
        out.append(list({line[s : s + n] for s, n in zip(start[hit].tolist(), size[hit].tolist())}))
    return out


def prune_interference(lines: DataFrame, feedback: DataFrame) -> DataFrame:
    """User dictionary lines (line, ...) without what feedback contradicts.

    If feedback touches no word, the lines stay as they are; else each word left has one line, with
    its last frequency (0 where it is missing or no whole number).
    """
    f = F.col("f")
    words = lines.withColumn("f", T.fields("line")).filter(F.size("f") > 0).select(
        F.get(f, F.lit(0)).alias("word"), F.coalesce(integer(F.get(f, F.lit(1))), F.lit(0)).alias("freq"), "layer", "ord"
    )
    latest = words.groupBy("word").agg(F.max_by(F.struct("freq", "layer", "ord"), F.struct("layer", "ord")).alias("w"))
    latest = _written(latest)
    bad = _written(straddling_words(feedback, latest.select("word")))
    if bad.isEmpty():
        return lines.select("line", "layer", "ord")
    return latest.join(bad, "word", "left_anti").select(
        F.concat_ws(" ", "word", "w.freq").alias("line"), F.col("w.layer").alias("layer"), F.col("w.ord").alias("ord")
    )


def absorb_feedback(user: DataFrame, feedback: DataFrame) -> DataFrame:
    """(word, freq) of the user layer after feedback: merge new words, prune interference, clean.

    `feedback` lines carry `layer` and `ord` behind those of `user`.
    """
    merged = user.select("line", "layer", "ord").unionByName(merge_new_words(feedback.select("line", "layer", "ord")))
    return clean_dictionary(prune_interference(merged, feedback), USER_RATIO)
