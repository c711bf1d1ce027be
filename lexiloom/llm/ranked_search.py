r"""Ranked lexical search with norm buckets: the best documents of each item, in exact integers.

A term t has the weight w_t, a document the impact of each of its terms; the score of an item is the
inner product sum(w_t * impact_t) over its distinct terms. Both sides carry sqrt(w_t), so an item is the
vector (sqrt(w_t)) and a document (sqrt(w_t) * impact_t), restricted to terms that some item has.

1. One scan counts, per document, its words and the occurrences of the items' terms. Sums over that
   written table give N, L and the document frequencies, so every weight and impact.
2. Impact vectors get their length (Euclidean norm), its bucket (a quarter of an octave) and lie sorted by
   length in each file. No vector is shuffled.
3. Waves read the buckets from the longest down. A task takes its vectors in runs of falling length.
   An item skips a run when |item| * (largest length of the run) is below the item's bound (Cauchy-Schwarz),
   or when the run's largest impacts of the item's terms add up to less. Inside a run the half of the item's terms of
   the greatest weight is added up; what the other half may add is bounded by the rest of the two lengths
   and by the run's largest impacts. Documents that may still reach the bound are scored whole, in integers.
4. The bound of an item is the k-th best score known: of the waves before, or of the task itself. A wave
   reads only vectors whose length may matter to some item; the filter on lengths reaches the file scan.

Items are taken in blocks of about `BLOCK` (item, term) pairs, each broadcast; more blocks mean more scans.
A task holds a run of vectors and k rows an item; the best k of all tasks are found in two steps.

Defined results: null and empty texts have no term, are not counted and never found; items without
terms, or whose terms no document has, give no row; each row of the items is searched for itself, also when its id
repeats or is null; document ids are integers, a null id ranks behind all others of the same score,
rows that repeat an id keep a rank each. No documents or no items: no rows. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexiloom.llm.common import discard, documents, small_batches, stage, table
from lexiloom.llm.decontaminate import words_of

TOP = 50
#: (item, term) pairs of a block of items, and documents x items that a task bounds at once.
BLOCK = 200_000
CELLS = 2_000_000
#: Bytes of a text that are split into words at once.
PIECE = 1 << 20
#: Buckets an octave of length; the waves end after these shares of all vectors.
STEPS = 4
WAVES = (1 / 64, 1 / 8, 1.0)
#: Bounds are doubles, scores integers: a bound counts as this much larger.
SLACK = 1 + 1e-9

#: Bytes of terms are digits, letters (A-Z become a-z) and all beyond ASCII; a blank takes the place of others.
_TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
_VECTORS = "id long, no_id boolean, n long, terms array<int>, tf array<long>"
_IMPACTS = "id long, no_id boolean, norm double, bucket int, terms array<int>, impacts array<long>"
_FOUND = "item int, id long, no_id boolean, score long"


def _terms(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a UTF-8 text in order, a piece of the text at a time."""
    plain, at = text.translate(_TERM_BYTES), 0
    while at < len(plain):
        end = plain.find(b" ", at + PIECE)
        end = len(plain) if end < 0 else end
        yield plain[at:end].split()
        at = end


def _lists(parts: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, parts)], dtype=np.int32)
    flat = np.concatenate(parts) if parts else np.empty(0, np.int64)
    return pa.ListArray.from_arrays(ends, pa.array(flat, kind))


def _flat(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Values and lengths of a column of lists without nulls."""
    return column.flatten().to_numpy(), column.value_lengths().to_numpy().astype(np.int64)


def count_terms(docs: DataFrame, id_col: str, text_col: str, vocabulary: dict[bytes, int]) -> DataFrame:
    """One row for each document with a term: id, no_id, n (its terms), and tf of those of the vocabulary."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value.get
        for batch in batches:
            ids, rows, lengths, terms, tfs = batch.column(0), [], [], [], []
            for row, text in enumerate(batch.column(1)):
                n, of = 0, {}
                for words in _terms(text.as_py() or b""):
                    n += len(words)
                    for t in map(known, words):
                        if t is not None:
                            of[t] = of.get(t, 0) + 1
                if n:
                    rows.append(row)
                    lengths.append(n)
                    terms.append(np.fromiter(of.keys(), np.int64, len(of)))
                    tfs.append(np.fromiter(of.values(), np.int64, len(of)))
            ids = ids.take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [ids.fill_null(0), ids.is_null(), pa.array(lengths, pa.int64()), _lists(terms, pa.int32()), _lists(tfs, pa.int64())],
                ["id", "no_id", "n", "terms", "tf"],
            )

    narrow = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"))
    return narrow.mapInArrow(count, _VECTORS)


def impact_vectors(vectors: DataFrame, weights: np.ndarray, n_docs: int, n_terms: int) -> DataFrame:
    """id, no_id, norm, bucket, terms, impacts of the documents with an impact that counts."""
    shared = vectors.sparkSession.sparkContext.broadcast(weights)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = 50 + (50 * batch.column(2).to_numpy() * n_docs) // n_terms
            terms, sizes = _flat(batch.column(3))
            tf, _ = _flat(batch.column(4))
            row = np.repeat(np.arange(len(sizes)), sizes)
            impact = (1_000_000_000 * tf) // (1000 * tf + 20 * m[row])
            w = shared.value[terms]
            keep = (w > 0) & (impact > 0)
            terms, row, impact, w = terms[keep], row[keep], impact[keep], w[keep]
            norm = np.sqrt(np.bincount(row, w * impact.astype(np.float64) ** 2, len(sizes)))
            some = norm > 0
            ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(sizes))[some])]).astype(np.int32)
            picked = pa.array(np.flatnonzero(some))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(picked), batch.column(1).take(picked), pa.array(norm[some]),
                    pa.array(np.floor(STEPS * np.log2(norm[some])).astype(np.int32)),
                    pa.ListArray.from_arrays(ends, pa.array(terms.astype(np.int32))), pa.ListArray.from_arrays(ends, pa.array(impact)),
                ],
                ["id", "no_id", "norm", "bucket", "terms", "impacts"],
            )

    return vectors.mapInArrow(weigh, _IMPACTS)


class Items:
    """A block of items: their terms by falling weight, as arrays that a broadcast carries."""

    def __init__(self, terms: list[list[int]], weights: np.ndarray):
        kept = [sorted((t for t in own if weights[t] > 0), key=lambda t: (-weights[t], t)) for own in terms]
        sizes = np.array([len(own) for own in kept], np.int64)
        self.weights = weights
        self.count = len(kept)
        self.ends = np.concatenate([[0], np.cumsum(sizes)])
        self.terms = np.array([t for own in kept for t in own], np.int64)
        self.item = np.repeat(np.arange(len(kept)), sizes)
        place = np.arange(len(self.terms)) - self.ends[self.item]
        self.focus = place < (sizes[self.item] + 1) // 2
        w = weights[self.terms].astype(np.float64)
        self.norm = np.sqrt(np.bincount(self.item, w, self.count))
        self.rest_norm = np.sqrt(np.bincount(self.item, w * ~self.focus, self.count))
        # Items by focus term: those of term t are by_term[first[t]:first[t + 1]].
        order = np.argsort(self.terms[self.focus], kind="stable")
        self.by_term = self.item[self.focus][order]
        self.first = np.searchsorted(self.terms[self.focus][order], np.arange(len(weights) + 1))


class _Best:
    """The best k (score, id) of one item that a task has met."""

    def __init__(self, k: int):
        self.k, self.score, self.id, self.no_id = k, np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)

    def add(self, score: np.ndarray, ids: np.ndarray, no_id: np.ndarray) -> int:
        """Take more rows in; returns the k-th best score, 0 while there are fewer."""
        self.score, self.id, self.no_id = (np.concatenate(x) for x in ((self.score, score), (self.id, ids), (self.no_id, no_id)))
        order = np.lexsort((self.id, self.no_id, -self.score))[: self.k]
        self.score, self.id, self.no_id = self.score[order], self.id[order], self.no_id[order]
        return int(self.score[-1]) if len(order) == self.k else 0


class _Run:
    """Vectors of like length, flat: terms, impacts and the row of each."""

    def __init__(self, batch: pa.RecordBatch, at: int, rows: int, weights: np.ndarray):
        part = batch.slice(at, rows)
        self.id, self.no_id = part.column(0).to_numpy(), part.column(1).to_numpy(zero_copy_only=False)
        self.norm = part.column(2).to_numpy()
        self.terms, sizes = _flat(part.column(4))
        self.impacts, _ = _flat(part.column(5))
        self.sizes, self.ends = sizes, np.concatenate([[0], np.cumsum(sizes)])
        self.row = np.repeat(np.arange(len(sizes)), sizes)
        self.most = np.zeros(len(weights), np.int64)
        np.maximum.at(self.most, self.terms, self.impacts)


def _bounds(run: _Run, items: Items, live: np.ndarray) -> np.ndarray:
    """Upper bounds of the scores of live items (rows) and the run's documents (columns)."""
    place = np.full(items.count, -1)
    place[live] = np.arange(len(live))
    n_rows = len(run.sizes)
    many = items.first[run.terms + 1] - items.first[run.terms]
    entry = np.repeat(np.arange(len(run.terms)), many)
    item = items.by_term[np.arange(len(entry)) - np.repeat(np.cumsum(many) - many, many) + items.first[run.terms[entry]]]
    on = place[item] >= 0
    entry, cell = entry[on], place[item[on]] * n_rows
    cell += run.row[entry]
    w, impact = items.weights[run.terms[entry]].astype(np.float64), run.impacts[entry].astype(np.float64)
    part = np.bincount(cell, w * impact, len(live) * n_rows).reshape(len(live), n_rows)
    square = np.bincount(cell, w * impact**2, len(live) * n_rows).reshape(len(live), n_rows)
    rest = items.rest_norm[live, None] * np.sqrt(np.maximum(run.norm**2 * SLACK - square, 0))
    add = np.bincount(items.item, items.weights[items.terms] * run.most[items.terms].astype(np.float64) * ~items.focus, items.count)
    return part + np.minimum(rest, add[live, None])


def _search(shared, floor: np.ndarray, k: int):
    """The task of a wave: the best k rows of each item that reach the item's floor."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items: Items = shared.value
        least = np.maximum(floor, 1)
        best = [None] * items.count
        dense = np.zeros(len(items.weights), np.int64)
        step = max(1, CELLS // max(1, items.count))
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                run = _Run(batch, at, step, items.weights)
                most = np.bincount(items.item, items.weights[items.terms] * run.most[items.terms].astype(np.float64), items.count)
                live = np.flatnonzero(np.minimum(items.norm * run.norm.max(), most) * SLACK >= least)
                if not len(live):
                    continue
                hit, row = np.nonzero(_bounds(run, items, live) * SLACK >= least[live, None])
                cuts = np.searchsorted(hit, np.arange(len(live) + 1))
                for j, i in enumerate(live):
                    rows = row[cuts[j] : cuts[j + 1]]
                    if not len(rows):
                        continue
                    own = items.terms[items.ends[i] : items.ends[i + 1]]
                    dense[own] = items.weights[own]
                    starts = np.cumsum(run.sizes[rows]) - run.sizes[rows]
                    flat = np.arange(run.sizes[rows].sum()) + np.repeat(run.ends[rows] - starts, run.sizes[rows])
                    score = np.add.reduceat(dense[run.terms[flat]] * run.impacts[flat], starts)
                    dense[own] = 0
                    reach = score >= least[i]
                    if reach.any():
                        best[i] = best[i] or _Best(k)
                        rows = rows[reach]
                        least[i] = max(least[i], best[i].add(score[reach], run.id[rows], run.no_id[rows]))
        for i, b in enumerate(best):
            if b is not None:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(b.id), i, np.int32)), pa.array(b.id), pa.array(b.no_id), pa.array(b.score)],
                    ["item", "id", "no_id", "score"],
                )

    return search


def _best_of(found: DataFrame, k: int) -> DataFrame:
    """The best k rows of each item with their rank; first in 32 parts of an item, then of what is left."""
    order = [F.desc("score"), "no_id", "id"]
    parts = Window.partitionBy("item", "part").orderBy(*order)
    less = found.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(32))).withColumn("rank", F.row_number().over(parts))
    less = less.filter(F.col("rank") <= k).drop("part", "rank")
    return less.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).filter(F.col("rank") <= k)


def _waves(impacts: DataFrame) -> list[tuple[int, int]]:
    """Ranges of buckets [low, high] from the longest vectors down, by the shares of WAVES."""
    sizes = sorted(((r["bucket"], r["c"]) for r in impacts.groupBy("bucket").agg(F.count("*").alias("c")).collect()), reverse=True)
    total, seen, out, high = sum(c for _, c in sizes), 0, [], None
    for k, (bucket, c) in enumerate(sizes):
        high = bucket if high is None else high
        seen += c
        if seen >= WAVES[len(out)] * total or k == len(sizes) - 1:
            out.append((bucket, high))
            high = None
    return out


def _search_block(docs: DataFrame, id_col: str, text_col: str, terms: list[list[str]], k: int) -> DataFrame | None:
    """item (place in the block), rank, id, no_id, score; None where no document has a term."""
    spark = docs.sparkSession
    vocabulary = {t.encode(): n for n, t in enumerate(sorted({t for own in terms for t in own}))}
    vectors = stage(count_terms(docs, id_col, text_col, vocabulary), "ranked-vectors")
    total = vectors.agg(F.count("*").alias("docs"), F.sum("n").alias("terms")).first()
    if not total["docs"]:
        return None
    df = np.zeros(len(vocabulary), np.int64)
    for r in vectors.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("df")).collect():
        df[r["t"]] = r["df"]
    n = total["docs"]
    weights = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * x + 1))) if x else 0 for x in df.tolist()], np.int64)
    impacts = impact_vectors(vectors, weights, n, total["terms"]).sortWithinPartitions(F.desc("norm"))
    impacts = stage(impacts, "ranked-impacts")
    discard(vectors)
    items = Items([[vocabulary[t.encode()] for t in own] for own in terms], weights)
    shared = spark.sparkContext.broadcast(items)
    floor, best = np.zeros(items.count, np.int64), None
    for low, high in _waves(impacts):
        # No item whose vector is shorter than this can reach its floor.
        reach = np.where(items.norm > 0, np.maximum(floor, 1) / np.maximum(items.norm, 1e-300), np.inf).min() / SLACK
        wave = impacts.filter(F.col("bucket").between(low, high) & (F.col("norm") >= F.lit(float(reach))))
        found = wave.mapInArrow(_search(shared, floor, k), _FOUND)
        before = best
        best = stage(_best_of(found if before is None else before.select("item", "id", "no_id", "score").unionByName(found), k), "ranked-best")
        if before is not None:
            discard(before)
        for r in best.filter(F.col("rank") == k).select("item", "score").collect():
            floor[r["item"]] = r["score"]
    discard(impacts)
    return best


def ranked_search(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    item_text: str = "text", k: int = TOP,
) -> DataFrame:
    """The k best documents of each row of `items`: item_id, rank, doc_id, score."""
    spark = docs.sparkSession
    small_batches(spark)
    own = items.select(F.col(item_col).alias("item_id"), F.array_distinct(words_of(F.col(item_text))).alias("terms")).filter(F.size("terms") > 0)
    own = stage(own.withColumn("row", F.monotonically_increasing_id()), "ranked-items")
    pairs = own.agg(F.sum(F.size("terms"))).first()[0] or 0
    blocks, parts = -(-pairs // BLOCK), []
    for b in range(blocks):
        rows = own.filter(F.pmod(F.xxhash64("row"), F.lit(blocks)) == b).select("row", "terms").orderBy("row").collect()
        found = _search_block(docs, id_col, text_col, [r["terms"] for r in rows], k) if rows else None
        if found is not None:
            names = spark.createDataFrame([(i, r["row"]) for i, r in enumerate(rows)], "item int, row long")
            parts.append(found.join(F.broadcast(names), "item").select("row", "rank", "id", "no_id", "score"))
    kind = own.schema["item_id"].dataType.simpleString()
    if not parts:
        return spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every.join(own.select("row", "item_id"), "row").select(
        "item_id", "rank", F.when(~F.col("no_id"), F.col("id")).alias("doc_id"), "score"
    )


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


OP11_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), s AS (
  SELECT count(*) AS every, sum(len(w)) AS total FROM d WHERE len(w) > 0
), q AS (
  SELECT item_id, list_distinct(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM benchmark
), qt AS (
  SELECT item_id, unnest(w) AS t FROM q
), tf AS (
  SELECT doc_id, n, t, count(*) AS tf FROM (SELECT doc_id, len(w) AS n, unnest(w) AS t FROM d)
  WHERE t IN (SELECT t FROM qt) GROUP BY ALL
), wt AS (
  SELECT t, CAST(floor(1000 * ln(CAST(2 * every + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM tf, s GROUP BY t, every
), im AS (
  SELECT doc_id, t, CAST((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * every) // total)) AS BIGINT) AS i FROM tf, s
), sc AS (
  SELECT item_id, doc_id, CAST(sum(w * i) AS BIGINT) AS score FROM qt JOIN wt USING (t) JOIN im USING (t) GROUP BY ALL
), r AS (
  SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
  FROM sc WHERE score > 0
)
SELECT * FROM r WHERE rank <= 50
"""
