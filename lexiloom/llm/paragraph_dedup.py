r"""Substring deduplication: MinHash banding of paragraphs, exact Jaccard, components.

A paragraph is a run of whole sentences of one line, or of lines of fewer than `LEAST` words that follow
one another (verse, lists). It ends with the line, with a sentence of `LONG` words or more, and with every
other shorter one, told by a hash of its last two words; between two short lines it ends at every third
place, told likewise; sentences of more than `RUN` words, such as text without stops, are cut where a hash
of two words is the least of `AROUND` words on both sides, and every `STEP` words or a little more where
the same few words come again and again. Where a paragraph ends thus depends on the words
around alone, so a passage put into another text falls into the same paragraphs in it. Paragraphs that
still have fewer than `LEAST` words are left alone.

Equal paragraphs are one node, by a hash of their words. Each node shows the least value of `bands`
x `rows` hash functions over its five-word shingles; `tuned_bands` picks the fewest values that find
a pair of the threshold's similarity with probability `RECALL`. Nodes that collide in a band are
joined exactly (Jaccard >= 3/4, by the region join of `jaccard_join`, which never emits the pairs of
a bucket), links give components, and of each component the first occurrence (least document, then
least paragraph) stays; all others are removed.

Two scans of the texts: the first shows the bands, the second reads paragraphs that repeat or
collide, found by a filter of bounded size. Both read the texts of a batch together, about `TOGETHER`
characters at once and a longer text alone. Counting is by partial aggregates.

Defined results: null or empty texts have no paragraphs; rows that repeat an id count as
occurrences with the same place; no rows in, no rows out; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.llm.common import BROADCAST_ROWS, discard, documents, key_filter, small_batches, stage
from lexiloom.llm.components import connected_components
from lexiloom.llm.jaccard_join import join_regions, once_each
from lexiloom.llm.shingles import SHINGLE, byte_word_hashes, mix64, word_places

LONG = 12
RUN, AROUND, STEP = 32, 6, 12
LEAST = 10
RECALL = 0.995
TOGETHER = 1 << 18
_SEEN = 200_000
SIMILARITY = 0.75
_BASE = np.uint64(0x9E3779B97F4A7C15)
_ENDS = np.zeros(256, dtype=bool)
_ENDS[[ord(c) for c in ".!?"]] = True


def tuned_bands(similarity: float = SIMILARITY, recall: float = RECALL, most: int = 64) -> tuple[int, int]:
    """(bands, rows) of the fewest hash values with 1 - (1 - s^rows)^bands >= recall."""
    best = None
    for rows in range(1, 9):
        for bands in range(1, most // rows + 1):
            if 1 - (1 - similarity**rows) ** bands >= recall:
                if best is None or bands * rows < best[0] * best[1]:
                    best = (bands, rows)
                break
    if best is None:
        raise ValueError("no banding reaches the recall")
    return best


def _least_around(values: np.ndarray) -> np.ndarray:
    """For each value but `AROUND` at both ends the least of it and `AROUND` neighbours on both sides."""
    width = 1
    while width <= 2 * AROUND:
        step = min(width, 2 * AROUND + 1 - width)
        values = np.minimum(values[:-step], values[step:])
        width += step
    return values


def _cut_places(values: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """Places whose value is the least around in its text; of equal ones that follow closely (words that repeat),
    one in `STEP` words. `heads` are the first places of the texts."""
    rims = np.zeros(len(values), dtype=np.int64)
    rims[heads] = AROUND
    place = np.arange(len(values)) + np.cumsum(rims)  # texts apart by a rim of `AROUND`
    wide = np.full(place[-1] + AROUND + 1, np.iinfo(np.uint64).max, dtype=np.uint64)
    wide[place] = values
    found = np.flatnonzero(values == _least_around(wide)[place - AROUND])
    if not len(found):
        return found
    at = place[found]
    opens = np.diff(at, prepend=at[0] - AROUND - 1) > AROUND
    since = at - at[np.maximum.accumulate(np.where(opens, np.arange(len(at)), 0))]
    return found[opens | (np.diff(since // STEP, prepend=-1) != 0)]


def together(texts: list[str | None]) -> Iterator[list[str | None]]:
    """Texts that follow one another, of `TOGETHER` characters at most or one text."""
    some: list[str | None] = []
    size = 0
    for t in texts:
        n = len(t or "")
        if some and size + n > TOGETHER:
            yield some
            some, size = [], 0
        some.append(t)
        size += n
    if some:
        yield some


class Paragraphs:
    """Paragraphs of one text, or of several one after another: hashes, shingles and places in code points of
    their text. `first` is each text's first paragraph, `counts` their number."""

    def __init__(self, *texts: str | None) -> None:
        parts = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
        raw = np.frombuffer(b"\n".join(parts), dtype=np.uint8)  # no word goes over the end of a line
        start, end = word_places(raw)
        self.count = 0
        self.first = self.counts = np.zeros(len(parts), dtype=np.int64)
        if not len(start):
            return
        begins = np.cumsum([0, *(len(p) + 1 for p in parts[:-1])])  # first byte of each text
        words = np.searchsorted(start, begins)  # first word of each text, or of the next that has any
        heads = np.unique(words[words < len(start)])
        last = np.zeros(len(start), dtype=bool)  # the last word of its line
        before = np.searchsorted(start, np.flatnonzero(raw == 10)) - 1
        last[before[before >= 0]] = last[-1] = True
        ends = np.flatnonzero(last)
        thin = np.diff(ends, prepend=-1) < LEAST  # lines of few words
        inner = np.zeros(len(start), dtype=bool)  # the end of a line between two such
        inner[ends[:-1]] = thin[:-1] & thin[1:]
        inner[heads - 1] = False  # a text ends; of the first text the last word, which is no inner one
        stop = _ENDS[raw[end - 1]] | last
        at = np.flatnonzero(stop)
        length = np.diff(at, prepend=-1)  # words of each sentence
        w = byte_word_hashes(raw)
        previous = np.append(np.uint64(0), w[:-1])
        previous[heads] = 0
        pair = mix64(w + mix64(previous))
        often = np.where(inner[at], pair[at] % np.uint64(3) == 0, pair[at] % np.uint64(2) == 0)
        close = at[(length >= LONG) | (last[at] & ~inner[at]) | often]
        if length.max() > RUN:
            places = _cut_places(pair, heads)
            close = np.union1d(close, places[np.repeat(length > RUN, length)[places]])
        self.lo = np.append(0, close[:-1] + 1)  # first word of each paragraph
        self.hi = close + 1
        self.words = self.hi - self.lo
        self.count = len(self.lo)
        self.first = np.searchsorted(self.lo, words)
        self.counts = np.diff(self.first, append=self.count)
        self._raw, self._begins, self._start, self._end = raw, begins, start, end
        # Order counts: each word is weighted by its place in its paragraph.
        place = np.arange(len(w)) - np.repeat(self.lo, self.words)
        sums = np.append(np.uint64(0), np.cumsum(mix64(w ^ mix64(place.astype(np.uint64) + _BASE)), dtype=np.uint64))
        self.key = mix64(sums[self.hi] - sums[self.lo] + self.words.astype(np.uint64)).view(np.int64)
        self.long = self.words >= LEAST
        h = np.zeros(max(0, len(w) - SHINGLE + 1), dtype=np.uint64)
        for j in range(SHINGLE):
            h = mix64(h * _BASE + w[j : j + len(h)])
        self.shingle = h

    def places(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the paragraphs `at`: number of their text, first code point there and the one past the end."""
        text = np.searchsorted(self.first, at, side="right") - 1
        inside = np.flatnonzero((self._raw & 0xC0) == 0x80)  # bytes that begin no character
        begin, start, end = (
            b - np.searchsorted(inside, b) for b in (self._begins[text], self._start[self.lo[at]], self._end[self.hi[at] - 1])
        )
        return text, start - begin, end - begin

    def shingles(self, i: int) -> np.ndarray:
        return np.unique(self.shingle[self.lo[i] : self.hi[i] - SHINGLE + 1])

    def bands(self, bands: int, rows: int) -> np.ndarray:
        """Keys of the bands of the long paragraphs, shape (paragraphs, bands)."""
        lo = self.lo[self.long]
        hi = self.hi[self.long] - SHINGLE + 1
        out = np.zeros((len(lo), bands), dtype=np.uint64)
        if not len(lo):
            return out.view(np.int64)
        cuts = np.ravel(np.column_stack((lo, hi)))
        cuts = cuts[:-1] if cuts[-1] >= len(self.shingle) else cuts
        for b in range(bands):
            key = np.zeros(len(lo), dtype=np.uint64)
            for r in range(rows):
                seeded = mix64(self.shingle ^ mix64(np.array([b * rows + r + 1], dtype=np.uint64)))
                key = mix64(key * _BASE + np.minimum.reduceat(seeded, cuts)[::2])
            out[:, b] = mix64(key + np.uint64(b + 1))
        return out.view(np.int64)


def band_rows(docs: DataFrame, text_col: str) -> DataFrame:
    """(key, n, bands): the long paragraphs with their bands. Equal ones come once a batch with their number,
    and with their bands once a task, as far as it remembers `_SEEN` keys."""
    bands, rows = tuned_bands()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            keys, shown = [], []
            for texts in together(batch.column(0).to_pylist()):
                p = Paragraphs(*texts)
                if p.count and p.long.any():
                    keys.append(p.key[p.long])
                    shown.append(p.bands(bands, rows))
            if keys:
                key, band = np.concatenate(keys), np.concatenate(shown)
                key, first, n = np.unique(key, return_index=True, return_counts=True)
                fresh = np.array([k not in seen for k in key.tolist()])
                ends = np.append(0, np.cumsum(fresh * bands)).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(band[first[fresh]].ravel()), mask=pa.array(~fresh))
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n), lists], names=["key", "n", "bands"])
                if len(seen) < _SEEN:
                    seen.update(key.tolist())

    return docs.select(F.col(text_col).alias("text")).mapInArrow(scan, "key long, n long, bands array<long>")


def _collisions(shown: DataFrame) -> DataFrame:
    """(pivot, key) of the nodes in a band with another node; the pivot is the least of them.

    Nodes that collide in several bands under one pivot meet in one region. Bands are counted by partial
    aggregates, and only nodes of those that two share go on to a join, which splits a band of many nodes.
    """
    rows = shown.filter("bands IS NOT NULL").select("key", F.explode("bands").alias("band"))
    ends = rows.groupBy("band").agg(F.min("key").alias("pivot"), F.max("key").alias("last"))
    met = stage(ends.filter("pivot <> last").select("band", "pivot"), "para-met")
    may_meet = key_filter(met, "band")

    def those(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, bands = batch.column(0).to_numpy(), batch.column(1)
            band = bands.flatten().to_numpy()
            keep = may_meet(band)
            row = np.repeat(key, pc.list_value_length(bands).to_numpy())[keep]
            yield pa.RecordBatch.from_arrays([pa.array(row), pa.array(band[keep])], names=["key", "band"])

    meeting = shown.filter("bands IS NOT NULL").select("key", "bands").mapInArrow(those, "key long, band long")
    out = stage(meeting.join(met, "band").select("pivot", "key").distinct(), "para-collisions")
    discard(met)
    return out


def _occurrences(docs: DataFrame, id_col: str, text_col: str, wanted: DataFrame, near: DataFrame) -> DataFrame:
    """(id, n, found): each document's number of paragraphs and the occurrences of wanted ones.

    `shingles` is set for `near` ones, at the first occurrence in a task. The filters let a few more pass.
    """
    may_hold, may_join = key_filter(wanted, "key"), key_filter(near, "key")
    places = "array<struct<no: long, start: long, `end`: long, words: long, key: long, shingles: binary>>"

    @F.arrow_udf(f"struct<n: long, found: {places}>")
    def scan(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        seen: set[int] = set()
        for column in batches:
            counts, sizes, parts, shingles = [], [], [], []
            for texts in together(column.to_pylist()):
                p = Paragraphs(*texts)
                counts.append(p.counts)
                at = np.flatnonzero(p.long & may_hold(p.key)) if p.count else np.zeros(0, dtype=np.int64)
                if not len(at):
                    sizes.append(np.zeros(len(texts), dtype=np.int64))
                    continue
                text, start, end = p.places(at)
                sizes.append(np.bincount(text, minlength=len(texts)))
                parts.append(np.stack((at - p.first[text], start, end, p.words[at], p.key[at])))
                for i, k, join in zip(at.tolist(), p.key[at].tolist(), may_join(p.key[at]).tolist()):
                    new = join and k not in seen
                    shingles.append(p.shingles(i).tobytes() if new else None)
                    if new and len(seen) < _SEEN:
                        seen.add(k)
            numbers = np.concatenate(parts, axis=1) if parts else np.zeros((5, 0), dtype=np.int64)
            found = pa.StructArray.from_arrays(
                [*(pa.array(x) for x in numbers), pa.array(shingles, pa.binary())], names=["no", "start", "end", "words", "key", "shingles"]
            )
            ends = np.append(0, np.cumsum(np.concatenate([np.zeros(0, dtype=np.int64), *sizes]))).astype(np.int32)
            n = np.concatenate([np.zeros(0, dtype=np.int64), *counts])
            yield pa.StructArray.from_arrays([pa.array(n), pa.ListArray.from_arrays(pa.array(ends), found)], names=["n", "found"])

    return docs.select(F.col(id_col).alias("id"), scan(F.col(text_col)).alias("s")).select("id", "s.n", "s.found")


def _few(df: DataFrame) -> DataFrame:
    """To be broadcast if it has few rows; a written table."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def paragraph_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_paragraphs, n_repeated, n_removed, removed, kept_in.

    `n_repeated` counts paragraphs that occur again, equal or near; `removed` lists those that go
    as structs (no, start, end, component): code points, end exclusive; `kept_in` lists the
    documents in which the removed ones stay.
    """
    small_batches(docs.sparkSession)
    shown = stage(band_rows(docs, text_col), "para-bands")
    repeated = shown.groupBy("key").agg(F.sum("n").alias("n")).filter("n > 1").select("key")
    collisions = _collisions(shown)
    near = collisions.select("key").distinct()
    near = stage(near, "para-near")
    wanted = stage(repeated.union(near).distinct(), "para-wanted")
    discard(shown)
    read = stage(_occurrences(docs, id_col, text_col, wanted, near), "para-read")
    found = read.select("id", F.explode("found").alias("f")).select("id", "f.*")
    sets = found.filter("shingles IS NOT NULL").select(F.col("key").alias("row"), "shingles")
    sets = stage(once_each(sets), "para-sets")
    sizes = sets.select("row", F.expr("octet_length(shingles) div 8").cast("long").alias("n"))
    members = collisions.select(F.col("pivot").cast("string").alias("region"), F.col("key").alias("row")).join(sizes, "row")
    members = stage(members.withColumn("digest", F.format_string("%016x", "row")), "para-members")
    linked = connected_components(join_regions(members, sets))
    discard(collisions, members, sets)
    signed = lambda c: F.conv(c, 16, -10).cast("long")
    comps = linked.select(signed("node").alias("key"), signed("component").alias("component"))
    named = found.select("id", "no", "start", "end", "key").join(_few(comps), "key", "left").select(
        "id", "no", "start", "end", F.coalesce("component", "key").alias("component")
    )
    named = stage(named, "para-named")
    groups = named.groupBy("component").agg(F.count("*").alias("size"), F.min(F.struct("id", "no")).alias("first"))
    groups = _few(stage(groups.filter("size > 1"), "para-groups"))
    marked = named.join(groups, "component").withColumn(
        "gone", ~(F.col("id").eqNullSafe(F.col("first.id")) & (F.col("no") == F.col("first.no")))
    )
    per = marked.groupBy("id").agg(
        F.count("*").alias("n_repeated"),
        F.array_sort(F.collect_list(F.when(F.col("gone"), F.struct("no", "start", "end", "component")))).alias("removed"),
        F.array_sort(F.collect_set(F.when(F.col("gone"), F.col("first.id")))).alias("kept_in"),
    ).withColumnRenamed("id", "rid")  # lists bounded by a document's own paragraphs
    none = F.array().cast("array<struct<no: long, start: long, `end`: long, component: long>>")
    return read.select("id", F.col("n").alias("n_paragraphs")).join(
        stage(per, "para-documents"), F.col("id").eqNullSafe(F.col("rid")), "left"
    ).select(
        "id", "n_paragraphs", F.coalesce("n_repeated", F.lit(0)).cast("long").alias("n_repeated"),
        F.coalesce(F.size("removed"), F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("removed", none).alias("removed"),
        F.coalesce("kept_in", F.array().cast(per.schema["kept_in"].dataType)).alias("kept_in"),
    )


def op6_paragraph_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = paragraph_dedup(documents(spark, sf_dir))
    return out.select(
        F.col("id").alias("doc_id"), "n_paragraphs", "n_repeated", "n_removed", "kept_in",
        F.array_join(F.transform("removed", lambda r: F.concat_ws(":", r["start"], r["end"])), ",").alias("removed_spans"),
        F.array_join(F.transform("removed", lambda r: r["component"].cast("string")), ",").alias("components"),
    )
