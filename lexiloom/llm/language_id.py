r"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Character n-grams of length 1 to 3 of the lower-cased whole text are hashed into `BUCKETS`
features. Document frequencies come from every document that may be learned from. The weights are
fitted by follow-the-regularised-leader (proximal, elastic net) on a sample of at most about
`PER_LANGUAGE` labelled documents a language, split over a task for each `SHARD_DOCS` of them (`SHARDS` at
least) whose weights are averaged; a fifth of the sample is kept back to fit the softmax temperature. Model size depends
on `BUCKETS` and the number of languages alone, so it may be broadcast.

Defined results: a text that is null or has no letter is `und` with score 0; rows without a
language are predicted but not learned from; with nothing to learn from, every row is `und`.
Repeated rows get the same answer; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.llm.common import documents, small_batches, stage

BUCKETS = 1 << 16
PER_LANGUAGE = 1500
SHARDS, SHARD_DOCS = 4, 1500
EPOCHS = 3
ALPHA, BETA, L1, L2 = 2.0, 1.0, 2e-4, 1e-4
CHUNK = 1 << 20
FOLDS = 5

_LETTER = regex.compile(r"\p{L}")  # number forms such as those for one half are no letters
_MULT = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], dtype=np.uint32)


def ngram_counts(text: str) -> np.ndarray:
    """Counts of the hashed 1- to 3-grams of the lower-cased text, as a dense vector."""
    cp = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    total = np.zeros(BUCKETS, dtype=np.int64)
    for lo in range(0, len(cp), CHUNK):
        part = cp[lo : lo + CHUNK + 2]
        h = np.zeros(len(part), dtype=np.uint32)
        for n in range(3):
            m = len(part) - n
            if m <= 0:
                break
            h = (h[:m] + part[n:] * _MULT[n]) * np.uint32(0x27D4EB2F) + np.uint32(n + 1)
            total += np.bincount((h[: min(m, CHUNK)] >> np.uint32(16)).astype(np.int64), minlength=BUCKETS)
    return total


def features(text: str, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices and L2-normalised sublinear TF-IDF values."""
    counts = ngram_counts(text)
    at = np.flatnonzero(counts)
    x = (1.0 + np.log(counts[at])) * idf[at]
    norm = np.sqrt(np.dot(x, x))
    return at, x / norm if norm else x


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], classes: int, epochs: int) -> np.ndarray:
    """Weights of shape (BUCKETS + 1, classes); the last row is the intercept."""
    z = np.zeros((BUCKETS + 1, classes))
    n = np.zeros((BUCKETS + 1, classes))

    def weights(at: np.ndarray) -> np.ndarray:
        za, na = z[at], n[at]
        return np.where(np.abs(za) <= L1, 0.0, (np.sign(za) * L1 - za) / ((BETA + np.sqrt(na)) / ALPHA + L2))

    for _ in range(epochs):
        for at, x, label in rows:
            at, x = np.append(at, BUCKETS), np.append(x, 1.0)
            w = weights(at)
            s = x @ w
            p = np.exp(s - s.max())
            p /= p.sum()
            p[label] -= 1.0
            g = np.outer(x, p)
            na = n[at]
            z[at] += g - (np.sqrt(na + g * g) - np.sqrt(na)) / ALPHA * w
            n[at] = na + g * g
    return weights(np.arange(BUCKETS + 1))


@dataclass
class LanguageModel:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray
    temperature: float = 1.0

    def logits(self, text: str) -> np.ndarray:
        at, x = features(text, self.idf)
        return x @ self.weights[at] + self.weights[BUCKETS]

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.languages or not text or not _LETTER.search(text):
            return "und", 0.0
        s = self.logits(text) / self.temperature
        p = np.exp(s - s.max())
        p /= p.sum()
        k = int(np.argmax(p))
        return self.languages[k], float(min(1.0, p[k]))


def held_out(id_col: str) -> Column:
    """crc32 of the id as text, mod 5, is 0 (a null id counts as the empty text)."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS)) == 0


def document_frequencies(texts: DataFrame) -> np.ndarray:
    """Documents that hold each feature, over every row of `texts` (column `text`)."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        df = np.zeros(BUCKETS, dtype=np.int64)
        for pdf in batches:
            for t in pdf["text"]:
                df += ngram_counts(t) > 0
        at = np.flatnonzero(df)
        yield pd.DataFrame({"f": at, "n": df[at]})

    rows = texts.select("text").mapInPandas(count, "f long, n long").groupBy("f").agg(F.sum("n").alias("n"))
    out = np.zeros(BUCKETS)
    for r in rows.collect():  # at most BUCKETS rows
        out[r["f"]] = r["n"]
    return out


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> LanguageModel:
    """Fit on the documents that are not held out and have text and language."""
    small_batches(docs.sparkSession)
    usable = docs.select(
        F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"),
        held_out(id_col).alias("held"),
    ).filter("NOT held AND lang IS NOT NULL AND text IS NOT NULL")
    per = sorted((r["lang"], r["n"]) for r in usable.groupBy("lang").agg(F.count("*").alias("n")).collect())
    if not per:
        return LanguageModel([], np.ones(BUCKETS), np.zeros((BUCKETS + 1, 0)))
    languages = [lang for lang, _ in per]
    total = sum(n for _, n in per)
    idf = np.log((1 + total) / (1 + document_frequencies(usable))) + 1.0
    share = F.create_map(*[F.lit(x) for lang, n in per for x in (lang, min(1.0, PER_LANGUAGE / n))])
    label = F.create_map(*[F.lit(x) for k, lang in enumerate(languages) for x in (lang, k)])
    many = max(SHARDS, sum(min(n, PER_LANGUAGE) for _, n in per) // SHARD_DOCS)
    # Drawn by row, as rows may share an id; rows that repeat id, text and language are learned from once.
    row = lambda seed: F.xxhash64(F.lit(seed), "id", "text")
    h = row("draw")
    sample = stage(
        usable.filter(F.pmod(h, F.lit(1 << 30)) < share[F.col("lang")] * (1 << 30)).select(
            "text",
            label[F.col("lang")].alias("label"),
            row("order").alias("ord"),
            F.pmod(row("fold"), F.lit(FOLDS)).cast("int").alias("fold"),
            F.pmod(row("shard"), F.lit(many)).cast("int").alias("shard"),
        ).dropDuplicates(["ord", "label"]),
        "lang-sample",
    )
    classes = len(languages)

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["ord", "text"])
        w = ftrl([(*features(t, idf), int(y)) for t, y in zip(pdf["text"], pdf["label"])], classes, EPOCHS)
        f, k = np.nonzero(w)
        return pd.DataFrame({"f": f, "k": k, "w": w[f, k]})

    fitting = sample.filter("fold > 0")
    shards = max(1, fitting.select("shard").distinct().count())
    weights = np.zeros((BUCKETS + 1, classes))
    sums = fitting.groupBy("shard").applyInPandas(fit, "f long, k long, w double").groupBy("f", "k").agg(F.sum("w").alias("w"))
    for r in sums.collect():  # at most (BUCKETS + 1) x languages rows, fewer by the L1 penalty
        weights[r["f"], r["k"]] = r["w"] / shards
    model = LanguageModel(languages, idf, weights)
    model.temperature = _temperature(sample.filter("fold = 0"), model)
    return model


def _temperature(rows: DataFrame, model: LanguageModel) -> float:
    """The softmax temperature of least negative log-likelihood on the rows kept back."""

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"label": pdf["label"], "s": [model.logits(t).tolist() for t in pdf["text"]]})

    got = rows.select("label", "text").mapInPandas(score, "label int, s array<double>").collect()  # a fifth of the sample
    if not got:
        return 1.0
    s, y = np.array([r["s"] for r in got]), np.array([r["label"] for r in got])

    def loss(t: float) -> float:
        a = s / t
        m = a.max(axis=1)
        return float(np.mean(m + np.log(np.exp(a - m[:, None]).sum(axis=1)) - a[np.arange(len(y)), y]))

    grid = np.exp(np.linspace(np.log(0.05), np.log(5.0), 60))
    return float(min(grid, key=loss))


def predict(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> Column:
    """A struct column (lang, score) for `docs`."""
    parts = (model.languages, model.idf, model.weights, model.temperature)
    shared = docs.sparkSession.sparkContext.broadcast(parts)

    @F.pandas_udf("struct<lang: string, score: double>")
    def guess(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = LanguageModel(*shared.value)
        for batch in texts:
            yield pd.DataFrame([m.predict(t) for t in batch], columns=["lang", "score"])

    return guess(F.col(text_col))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = train(docs)
    return docs.select("doc_id", held_out("doc_id").alias("held_out"), predict(docs, model).alias("p")).select(
        "doc_id", "held_out", F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score")
    )
