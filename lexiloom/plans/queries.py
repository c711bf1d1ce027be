"""The registered queries: each runs one operator over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.functions import text as T
from lexiloom.operators import lattice, tagger, training, vocabulary
from lexiloom.plans import evolve, requests
from lexiloom.sources import dictionaries as D
from lexiloom.sources import models, tables
from lexiloom.streaming import jobs

THRESHOLD = vocabulary.CORPUS_THRESHOLD
#: Words below these frequencies make the base and the user layer.
RARE, UNCOMMON = 3 * THRESHOLD, 6 * THRESHOLD

_folder = tables.shared_folder


def _kept(df: DataFrame) -> DataFrame:
    path = _folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _discovered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _kept(vocabulary.discover_words(tables.documents(spark, sf_dir, "han"), THRESHOLD))


def dictionary_lines(spark: SparkSession, sf_dir: str, words: DataFrame | None = None) -> DataFrame:
    """(line, layer, ord): a core layer of discovered words, a base layer of rare words of three characters
    without frequencies, and a user layer that lifts uncommon words of two characters."""
    words = _discovered(spark, sf_dir) if words is None else words
    n, f = F.char_length("word"), F.col("freq")
    core = words.select(F.concat_ws(" ", "word", f).alias("line"), F.lit(0).alias("layer"), F.col("word").alias("ord"))
    base = words.filter((n == 3) & (f < RARE)).select(F.col("word").alias("line"), F.lit(1).alias("layer"), F.col("word").alias("ord"))
    user = words.filter((n == 2) & (f < UNCOMMON)).select(
        F.concat_ws(" ", "word", f * 10).alias("line"), F.lit(2).alias("layer"), F.col("word").alias("ord")
    )
    return D.combine_layers(core, base, user)


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.parse_lines(dictionary_lines(spark, sf_dir))


def _lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Rounded, so that equal sums are equal wherever they are computed.
    return _kept(D.layered_lexicon(_entries(spark, sf_dir)).withColumn("logp", F.round("logp", 9)))


def _han(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.documents(spark, sf_dir, "han")


def _latin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.documents(spark, sf_dir)


def _messy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, line): all lines of the documents, and for most also what a dictionary would have of them:
    the first word alone or with numbers, in several forms (at places below zero)."""
    lines = _latin(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    first = F.coalesce(T.fields("line")[0], F.lit("x"))
    number = F.char_length("line") - 50
    form = F.when(F.col("pos") % 5 == 1, F.concat(F.lit("  "), first, F.lit("\t"), number, F.lit(" z")))
    form = form.when(F.col("pos") % 5 == 2, F.concat(first, F.lit(" "), number, F.lit(".5e1")))
    form = form.when(F.col("pos") % 5 == 3, F.concat(first, F.lit(" "), number)).otherwise(first)
    return lines.unionByName(lines.select("doc_id", (-1 - F.col("pos")).alias("pos"), form.alias("line")))


def _words(df: DataFrame, text_col: str = "text") -> DataFrame:
    return df.select(F.explode(T.fields(text_col)).alias("word")).distinct()


# Sources and sinks


def load_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _messy(spark, sf_dir).select("line", "doc_id", "pos", F.lit(0).alias("layer"), F.struct("doc_id", "pos").alias("ord"))
    return D.parse_lines(lines).select(F.col("ord.doc_id").alias("doc_id"), F.col("ord.pos").cast("long").alias("pos"), "word", "freq")


def layered_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.layered_lexicon(_entries(spark, sf_dir)).select("word", "freq", F.round("logp", 6).alias("logp"), F.col("n").cast("long").alias("n"))


def combine_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dictionary_lines(spark, sf_dir).select("line", F.col("layer").cast("long").alias("layer"))


def write_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written as text and read again."""
    path = _folder(spark)
    D.write_dictionary(_entries(spark, sf_dir), path)
    return D.load_dictionary(spark, path).select("word", "freq")


def read_text_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _latin(spark, sf_dir).select("doc_id", F.explode(F.split("text", "\n")).alias("text"))
    return D.read_text_corpus(lines)


def write_segmented_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = lattice.segment_corpus(_han(spark, sf_dir), _lexicon(spark, sf_dir))
    return D.corpus_lines(cut).select("doc_id", F.md5("line").alias("line_md5"), F.char_length("line").cast("long").alias("n_chars"))


def _zero_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of the dictionary lines with the tags of the zero model, which are all B."""
    named = _entries(spark, sf_dir).select("word", F.concat(F.col("layer"), F.lit(":"), "ord").alias("sent_id"))
    return tagger.sentences_of_lexicon(named).withColumn("pred", F.transform("tags", lambda t: F.lit(0)))


def _model(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(trans, feats): one batch update of the zero model on the dictionary lines."""
    feats, trans = training.perceptron_deltas(_kept(_zero_sentences(spark, sf_dir)))
    return _kept(trans), _kept(feats)


def _tagger(spark: SparkSession, sf_dir: str) -> tagger.Tagger:
    return tagger.Tagger.collect(*_model(spark, sf_dir))


def save_tagger_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.model_lines(*_model(spark, sf_dir))


def load_tagger_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written as text and read again: features and transitions in one table."""
    path = _folder(spark)
    models.save_tagger_model(*_model(spark, sf_dir), path)
    trans, feats = models.load_tagger_model(spark, path)
    t = trans.select(F.concat(F.lit("T"), F.col("from_tag")).alias("name"), F.col("to_tag").cast("long").alias("tag"), "weight")
    return t.unionByName(feats.select(F.concat(F.lit("F"), "feature").alias("name"), F.col("tag").cast("long").alias("tag"), "weight"))


def segment_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn as a request in one of four ways, with and without search; the tokens of the answers."""
    modes = F.element_at(F.array(*[F.lit(m) for m in ("dag", "crf", "hybrid", "other")]), (F.col("turn") % 4 + 1).cast("int"))
    functions = F.when(F.col("turn") % 3 == 0, F.lit("search")).otherwise(F.lit("plain"))
    asked = tables.conversations(spark, sf_dir).select(
        "conv_id", "turn",
        F.to_json(F.struct(tables.han("text").alias("text"), functions.alias("function"), modes.alias("algorithm"))).alias("request"),
    )
    out = requests.segment_requests(asked, _lexicon(spark, sf_dir), _tagger(spark, sf_dir))
    told = out.withColumn("tokens", F.from_json("response", "tokens array<string>")["tokens"])
    return told.select("conv_id", "turn", F.size("tokens").cast("long").alias("n_tokens"), F.md5(F.array_join("tokens", "\u0001")).alias("tokens_md5"))


def segment_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = lattice.segment_lines(_han(spark, sf_dir), _lexicon(spark, sf_dir), mode="dag")
    return lines.select("doc_id", F.md5("line").alias("line_md5"), F.char_length("line").cast("long").alias("n_chars"))


def segment_lines_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines in the mode that is taken where none is named."""
    lines = lattice.segment_lines(_han(spark, sf_dir), _lexicon(spark, sf_dir), _tagger(spark, sf_dir))
    return lines.select("doc_id", F.md5("line").alias("line_md5"), F.char_length("line").cast("long").alias("n_chars"))


# Predicates and string functions


def _flags(spark: SparkSession, sf_dir: str, **flags) -> DataFrame:
    both = _latin(spark, sf_dir).union(_han(spark, sf_dir))
    return _words(both).select("word", *[f("word").alias(name) for name, f in flags.items()])


def is_punctuation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flags(spark, sf_dir, is_punctuation=T.is_punctuation)


def contains_punctuation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flags(spark, sf_dir, contains_punctuation=T.contains_punctuation)


def has_chinese(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flags(spark, sf_dir, has_chinese=T.has_chinese)


def char_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flags(
        spark, sf_dir, is_alnum=T.is_alnum, has_alnum=T.has_alnum, has_cjk=T.has_cjk, has_word_char=T.has_word_char
    )


def protected_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flags(spark, sf_dir, protected=T.protected_suffix)


def reverse_word(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flags(spark, sf_dir, reversed=T.reverse_word)


def split_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _han(spark, sf_dir).select("doc_id", F.posexplode(T.split_blocks("text")).alias("pos", "block"))
    return rows.select("doc_id", (F.col("pos") + 1).cast("long").alias("pos"), "block", T.is_alnum("block").alias("is_alnum"))


def letter_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vocabulary.block_counts(_latin(spark, sf_dir))


def word_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vocabulary.word_ngrams(vocabulary.block_counts(_han(spark, sf_dir)).drop("n")).groupBy("word").agg(F.count("*").alias("n_blocks"))


def bmes_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _words(_han(spark, sf_dir)).select("word", F.concat_ws("", T.word_tags("word").cast("array<string>")).alias("tags"))


def _odd_tags(word: str) -> F.Column:
    """Tags that no word has as a whole, by place and character."""
    return F.transform(T.characters(word), lambda c, i: ((F.ascii(c) + i * 7) % 4).cast("int"))


def tags_to_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _words(_latin(spark, sf_dir)).select("word", T.characters("word").alias("c"), _odd_tags("word").alias("t"))
    return rows.select("word", F.array_join(T.words_of_tags("c", "t"), "|").alias("cut"))


def tagger_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = _words(_han(spark, sf_dir)).select(F.col("word").alias("sent_id"), T.characters("word").alias("chars"))
    return tagger.tagger_features(named).groupBy("feature").agg(F.count("*").alias("n"))


def load_brands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.load_brands(_messy(spark, sf_dir))


def _brands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.load_brands(dictionary_lines(spark, sf_dir).filter("layer = 1"))


def noisy_brand_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = vocabulary.discover_words(_han(spark, sf_dir), THRESHOLD)
    return vocabulary.noisy_brand_filter(words, _brands(spark, sf_dir))


# Joins


def word_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = vocabulary.discover_words(_han(spark, sf_dir), 2).select("word")
    return D.word_lookup(words, _lexicon(spark, sf_dir))


def word_logprob(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = vocabulary.discover_words(_han(spark, sf_dir), 2).select("word")
    return D.word_logprob(words, _lexicon(spark, sf_dir)).withColumn("logp", F.round("logp", 6))


def _todo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct blocks of the documents that are not plain letters and digits."""
    return _han(spark, sf_dir).select(F.explode(T.split_blocks("text")).alias("block")).filter(~T.is_alnum("block")).distinct()


def _longest(spark: SparkSession, lexicon: DataFrame) -> int:
    return lexicon.agg(F.max("n")).first()[0] or 0


def lattice_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    lexicon = _lexicon(spark, sf_dir)
    edges = lattice.lattice_edges(_todo(spark, sf_dir), lexicon, _longest(spark, lexicon))
    return edges.groupBy("block").agg(
        F.count("*").alias("n_edges"), F.sum("k").alias("total_k"), F.sum("source").alias("total_source"),
        F.round(F.sum("logp"), 4).alias("total_logp"),
    )


def _cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vocabulary.sum_duplicates(dictionary_lines(spark, sf_dir))


def noisy_extensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vocabulary.noisy_extensions(_kept(_cleaned(spark, sf_dir)))


def _pairs(texts: DataFrame, number: str, text: F.Column) -> DataFrame:
    """The columns with line and place: all words of the texts as feedback, two and two, and each third one
    with a number."""
    words = texts.select(*texts.columns, T.fields(text).alias("f"))
    # Lines are made in the array: a row for each word would carry all words of its text with it.
    told = lambda p, kind, *parts: F.struct((p * 2 + kind).alias("place"), F.concat_ws(" ", *parts).alias("line"))
    after = F.slice("f", F.lit(2), F.greatest(F.size("f"), F.lit(1)))
    pair = F.transform(F.arrays_zip(F.col("f").alias("w"), after.alias("next")), lambda x, p: F.when(p % 2 == 0, told(p, 0, x["w"], x["next"])))
    named = F.transform("f", lambda w, p: F.when(p % 3 == 1, told(p, 1, w, F.col(number).cast("string"))))
    return words.select(*texts.columns, F.explode(F.array_compact(F.concat(pair, named))).alias("x")).select(*texts.columns, "x.*")


def _feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole benchmark texts as feedback lines, in order."""
    lines = _pairs(tables.benchmark(spark, sf_dir), "item_id", tables.han("text"))
    return lines.select("line", F.lit(2).alias("layer"), F.format_string("1%010d%09d", "item_id", "place").alias("ord"))


def interference_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vocabulary.interference_candidates(_feedback(spark, sf_dir))


def _user_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dictionary's lines as a user layer."""
    return dictionary_lines(spark, sf_dir).select("line", F.lit(2).alias("layer"), F.concat(F.lit("0"), F.col("layer"), "ord").alias("ord"))


def prune_interference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vocabulary.prune_interference(_user_lines(spark, sf_dir), _feedback(spark, sf_dir)).select("line")


def emission_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, feats = _model(spark, sf_dir)
    named = _todo(spark, sf_dir).select(F.col("block").alias("sent_id"), T.characters("block").alias("chars"))
    scores = tagger.emission_scores(named, feats)
    return scores.groupBy(F.col("sent_id").alias("block")).agg(
        F.sum(F.col("score") * (F.col("pos") + 1) * (F.col("tag") + 1)).alias("weighted"), F.count("*").alias("n")
    )


# Aggregations and windows


def discover_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vocabulary.discover_words(_latin(spark, sf_dir))


def _corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.corpus_lines(lattice.segment_corpus(_han(spark, sf_dir), _lexicon(spark, sf_dir))).select("doc_id", "line")


def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the segmented corpus."""
    return vocabulary.token_counts(_corpus(spark, sf_dir), _brands(spark, sf_dir))


def sum_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vocabulary.sum_duplicates(_messy(spark, sf_dir))


def perceptron_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    trans, feats = _model(spark, sf_dir)
    t = trans.select(F.concat(F.lit("T"), F.col("from_tag")).alias("name"), F.col("to_tag").cast("long").alias("tag"), "weight")
    return t.unionByName(feats.select(F.concat(F.lit("F"), "feature").alias("name"), F.col("tag").cast("long").alias("tag"), "weight"))


def sentence_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the batch-updated model on the dictionary lines."""
    rows = tagger.viterbi_decode(_zero_sentences(spark, sf_dir).drop("pred"), _tagger(spark, sf_dir))
    return training.sentence_accuracy(rows).withColumn("accuracy", F.round("accuracy", 9))


def dictionary_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.dictionary_stats(_entries(spark, sf_dir)).withColumn("max_len", F.col("max_len").cast("long"))


def prune_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vocabulary.prune_prefixes(_cleaned(spark, sf_dir), vocabulary.CORE_RATIO)


def prune_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vocabulary.prune_suffixes(_cleaned(spark, sf_dir), vocabulary.CORE_RATIO)


def clean_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vocabulary.clean_dictionary(_kept(dictionary_lines(spark, sf_dir)))


def ranked_core(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vocabulary.ranked(token_counts(spark, sf_dir))


def merge_new_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vocabulary.merge_new_words(_messy(spark, sf_dir).drop("doc_id", "pos"))


# Segmentation and tagging


def _digest(df: DataFrame, tokens: str = "tokens") -> DataFrame:
    return df.select("doc_id", F.size(tokens).cast("long").alias("n_tokens"), F.md5(F.array_join(tokens, "\u0001")).alias("tokens_md5"))


def cut_dag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _digest(lattice.cut_dag(_han(spark, sf_dir), "text", _lexicon(spark, sf_dir)))


def best_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every distinct block, for lexicons of any size."""
    lexicon = _lexicon(spark, sf_dir)
    paths = lattice.cut_blocks(_todo(spark, sf_dir), lexicon, _longest(spark, lexicon))
    return paths.select("block", F.array_join("tokens", "\u0001").alias("path"))


def cut_tagger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _digest(lattice.segment(_han(spark, sf_dir), "text", _lexicon(spark, sf_dir), _tagger(spark, sf_dir), "crf"))


def cut_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _digest(lattice.segment(_han(spark, sf_dir), "text", _lexicon(spark, sf_dir), _tagger(spark, sf_dir), "hybrid"))


def cut_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _digest(lattice.search_tokens(_han(spark, sf_dir), "text", _lexicon(spark, sf_dir)))


def _decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = _todo(spark, sf_dir).select("block", T.characters("block").alias("chars"))
    return tagger.viterbi_decode(named, _tagger(spark, sf_dir))


def viterbi_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _decoded(spark, sf_dir).select("block", F.array_join("pred", "").alias("tags"))


def tagger_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _decoded(spark, sf_dir).select("block", F.array_join(T.words_of_tags("chars", "pred"), "\u0001").alias("words"))


def segment_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _digest(lattice.segment_corpus(_han(spark, sf_dir), _lexicon(spark, sf_dir)))


def corpus_to_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tagger.sentences_of_corpus(_corpus(spark, sf_dir)).select(
        "doc_id", F.size("chars").cast("long").alias("n"), F.md5(F.array_join("chars", "")).alias("chars_md5"),
        F.md5(F.array_join("tags", "")).alias("tags_md5"),
    )


def lexicon_to_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _zero_sentences(spark, sf_dir).select(
        "sent_id", F.array_join("chars", "").alias("chars"), F.array_join("tags", "").alias("tags")
    )


def _model_rows(trans: DataFrame, feats: DataFrame) -> DataFrame:
    t = trans.select(F.concat(F.lit("T"), F.col("from_tag")).alias("name"), F.col("to_tag").alias("tag"), "weight")
    return t.unionByName(feats.select(F.concat(F.lit("F"), "feature").alias("name"), "tag", "weight"))


def _sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The segmented corpus, then the dictionary lines, as sentences (ord, chars, tags)."""
    told = tagger.sentences_of_corpus(_corpus(spark, sf_dir)).withColumn("ord", F.format_string("0%020d", "doc_id"))
    named = _zero_sentences(spark, sf_dir).withColumn("ord", F.concat(F.lit("1"), "sent_id"))
    return _kept(told.select("ord", "chars", "tags").unionByName(named.select("ord", "chars", "tags")))


def train_tagger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights after ten epochs over the segmented corpus, then the dictionary lines."""
    return _model_rows(*training.model_tables(spark, training.train_tagger(_sentences(spark, sf_dir), shards=None)))


def _reported(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and benchmark items."""
    items = tables.benchmark(spark, sf_dir).select((-1 - F.col("item_id")).alias("doc_id"), tables.han("text").alias("text"))
    return _han(spark, sf_dir).union(items)


def segmentation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = requests.segmentation_report(_reported(spark, sf_dir), _lexicon(spark, sf_dir), _tagger(spark, sf_dir))
    return report.select("doc_id", F.md5("cut").alias("cut_md5"), "n_tokens")


def report_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the pass that writes the report counts on its way."""
    report, seen = requests.observed_report(_reported(spark, sf_dir), _lexicon(spark, sf_dir), _tagger(spark, sf_dir))
    told = requests.write_report(report, seen, _folder(spark))
    return spark.createDataFrame([(told["texts"], told["characters"], told["tokens"])], "texts long, characters long, tokens long")


# Pipelines and streams


def absorb_feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vocabulary.absorb_feedback(_user_lines(spark, sf_dir), _feedback(spark, sf_dir))


def _evolved(spark: SparkSession, sf_dir: str, feedback: DataFrame | None, user: DataFrame | None = None, epochs: int = 10) -> evolve.Vocabulary:
    """A turn of the loop on the dictionary's layers; lines of `user` come behind its own."""
    words = _discovered(spark, sf_dir)
    lines = _kept(dictionary_lines(spark, sf_dir, words))
    layers = [lines.filter(F.col("layer") == k) for k in range(3)]
    layers[2] = layers[2] if user is None else evolve.rooted(layers[2], "0").unionByName(evolve.rooted(user, "1"))
    return evolve.evolve(_han(spark, sf_dir), evolve.Vocabulary(*layers), feedback, _folder(spark), epochs, digits=9, discovered=words)


def evolve_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One turn of the loop over the documents: the new core layer and the weights of the new model."""
    made = _evolved(spark, sf_dir, _feedback(spark, sf_dir))
    weights = _model_rows(*training.model_tables(spark, made.model))
    core = made.core.select(F.lit("core").alias("part"), F.col("line").alias("name"), F.lit(None).cast("int").alias("tag"), F.lit(None).cast("double").alias("weight"))
    return core.unionByName(weights.withColumn("part", F.lit("model")))


def evolve_core(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One turn of the loop without its training: the new core layer and the user layer after feedback."""
    made = _evolved(spark, sf_dir, _feedback(spark, sf_dir), epochs=0)
    told = lambda df, name: df.select(F.lit(name).alias("part"), "line")
    return told(made.core, "core").unionByName(told(made.user, "user"))


def stream_words_loop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log of all turns, its new words, the user layer that takes them in, and the turn of the loop behind it:
    the user and core layers of the new version."""
    folder = _folder(spark)
    stream = _stream(spark, sf_dir, "conversations").select(tables.han("text").alias("text"))
    jobs.stream_discover(stream, f"{folder}/words", f"{folder}/state").awaitTermination()
    loop = lambda user: _evolved(spark, sf_dir, None, user, epochs=0)
    for _ in range(2):  # handed over once, however often it is asked for
        number = jobs.absorb_words(spark, f"{folder}/words", f"{folder}/versions", loop)
    told = lambda name: spark.read.parquet(f"{folder}/versions/version={number}/{name}").select(F.lit(name).alias("part"), "line")
    return told("user").unionByName(told("core"))


def cut_trained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hybrid cut of the documents with the tagger that was trained on them."""
    lexicon = _lexicon(spark, sf_dir)
    model = training.train_tagger(_sentences(spark, sf_dir), shards=None)
    return _digest(lattice.segment(_han(spark, sf_dir), "text", lexicon, model, "hybrid"))


def _stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    path = f"{sf_dir}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1_000_000).parquet(path + "*")


def stream_log_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _folder(spark)
    stream = _stream(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    jobs.stream_log_filter(stream, f"{folder}/out", f"{folder}/state").awaitTermination()
    return spark.read.schema("conv_id long, turn long, text string").parquet(f"{folder}/out")


def stream_discover(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _folder(spark)
    stream = _stream(spark, sf_dir, "conversations").select("text")
    jobs.stream_discover(stream, f"{folder}/out", f"{folder}/state").awaitTermination()
    return spark.read.parquet(f"{folder}/out").select("word", "freq")


def stream_feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All words of every conversation turn as feedback; the loop runs on the user layer that comes of it,
    which is returned, and core, lexicon and model are written beside it."""
    folder = _folder(spark)
    turns = _stream(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    lines = _pairs(turns, "turn", tables.han("text"))
    place = F.format_string("%010d%05d%09d", "conv_id", "turn", "place")
    loop = lambda user: _evolved(spark, sf_dir, None, user)
    jobs.stream_feedback(lines.select("line", place.alias("ord")), f"{folder}/versions", f"{folder}/state", loop).awaitTermination()
    return spark.read.parquet(f"{folder}/versions/version={jobs.latest_version(spark, folder + '/versions')}/user").select("line")


def stream_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that arrive, cut with the newest of two versions of the lexicon."""
    folder = _folder(spark)
    lexicon = _lexicon(spark, sf_dir)
    jobs.write_version({"lexicon": lexicon.filter(F.col("n") > 2)}, f"{folder}/versions", 1)
    jobs.write_version({"lexicon": lexicon}, f"{folder}/versions", 2)
    stream = _stream(spark, sf_dir, "documents").select("doc_id", tables.han("text").alias("text"))
    cut = jobs.newest_cut(spark, f"{folder}/versions", "dag")
    jobs.stream_segment(stream, lambda df: _digest(cut(df)), f"{folder}/out", f"{folder}/state").awaitTermination()
    return spark.read.parquet(f"{folder}/out").select("doc_id", "n_tokens", "tokens_md5")


def stream_segment_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same in hybrid mode: lexicon and model of the newest of two versions."""
    folder = _folder(spark)
    lexicon, (trans, feats) = _lexicon(spark, sf_dir), _model(spark, sf_dir)
    jobs.write_version({"lexicon": lexicon.filter(F.col("n") > 2), "trans": trans.limit(0), "feats": feats.limit(0)}, f"{folder}/versions", 1)
    jobs.write_version({"lexicon": lexicon, "trans": trans, "feats": feats}, f"{folder}/versions", 2)
    stream = _stream(spark, sf_dir, "documents").select("doc_id", tables.han("text").alias("text"))
    cut = jobs.newest_cut(spark, f"{folder}/versions")
    jobs.stream_segment(stream, lambda df: _digest(cut(df)), f"{folder}/out", f"{folder}/state").awaitTermination()
    return spark.read.parquet(f"{folder}/out").select("doc_id", "n_tokens", "tokens_md5")
