"""Dictionary segmentation: best path over the lattice of dictionary words.

A text falls into blocks; blocks of ASCII letters and digits stay whole, every other block takes the
path of greatest summed log-probability, found from right to left. Of equal sums the first candidate
wins: dictionary words by length, then the run of letters and digits that starts there. A character on
its own is a candidate only where nothing else starts.

A worker looks at a batch of texts at once: its distinct blocks lie in one array, all words that start
anywhere are found level by level (`Words`), and one sweep from the right settles every block. A lexicon
that is too large to broadcast is joined instead (`cut_joined`); `segment` chooses by its count.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from itertools import accumulate, chain

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexiloom.functions import text as T
from lexiloom.operators.tagger import GAP, Tagger, code_points
from lexiloom.sources.dictionaries import UNKNOWN

#: Words that may be broadcast to every Python worker (about 30 bytes each); beyond it the lattice is joined.
LEXICON_WORDS = 5_000_000
#: Words, or beginnings of words, that a join broadcasts; more are shuffled.
JOINED_WORDS = 500_000
#: Characters of a block that a join's path takes at once; longer ones fall apart where no word crosses.
LONG_BLOCK = 100_000
#: Characters of the blocks whose cut a worker remembers.
MEMORY = 4_000_000
#: Rows a worker takes at once.
BATCH = 500

_BLOCK = re.compile(r"[A-Za-z0-9\u4e00-\u9fff]+|[^A-Za-z0-9\u4e00-\u9fff]+")
#: Some character that is no punctuation (as `functions.text.is_punctuation`).
_WORDY = regex.compile(r"[^\p{P}\p{S}\u3000-\u303F\uFF00-\uFFEF]")
_FLOOR = -1.7976931348623157e308


class Words:
    """A lexicon as levels of prefixes, in arrays.

    A prefix of k characters has a number; a prefix and its next character, packed into one integer, are
    looked up among the sorted ones of the next level. Prefixes that are words have a log-probability.
    """

    def __init__(self, words: list[str], logp: np.ndarray) -> None:
        codes, lens = code_points(words)
        at = np.cumsum(lens) - lens
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        parent, alive = np.zeros(len(lens), dtype=np.int64), np.flatnonzero(lens > 0)
        for k in range(int(lens.max(initial=0))):
            key = parent[alive] << 21 | codes[at[alive] + k]
            level, number = np.unique(key, return_inverse=True)
            parent[alive] = number
            ends = alive[lens[alive] == k + 1]
            is_word, value = np.zeros(len(level), dtype=bool), np.zeros(len(level))
            is_word[parent[ends]], value[parent[ends]] = True, logp[ends]
            self.levels.append((level, is_word, value))
            alive = alive[lens[alive] > k + 1]
        self._index()

    def _index(self) -> None:
        self.first = np.full(GAP + 1, -1, dtype=np.int32)
        if self.levels:
            self.first[self.levels[0][0]] = np.arange(len(self.levels[0][0]))

    @classmethod
    def of_levels(cls, levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Words:
        """From `levels`, which are plain arrays and so may be broadcast where this package is not installed."""
        out = cls.__new__(cls)
        out.levels = levels
        out._index()
        return out

    @classmethod
    def of(cls, logp: dict[str, float] | Words) -> Words:
        return logp if isinstance(logp, cls) else cls(list(logp), np.array(list(logp.values()), dtype=np.float64))

    @property
    def longest(self) -> int:
        return len(self.levels)

    def found(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, length, log-probability) of every word in the codes, by start, then length."""
        starts, sizes, values = [], [], []
        at, node = np.arange(len(codes)), np.zeros(0, dtype=np.int64)
        for k, (level, is_word, value) in enumerate(self.levels):
            if k == 0:
                node = self.first[codes]
                hit = node >= 0
            else:
                inside = at + k < len(codes)
                at, node = at[inside], node[inside]
                key = node.astype(np.int64) << 21 | codes[at + k]
                node = np.searchsorted(level, key)
                node[node == len(level)] = 0
                hit = level[node] == key
            at, node = at[hit], node[hit]
            if not len(at):
                break
            word = is_word[node]
            starts.append(at[word])
            sizes.append(np.full(len(starts[-1]), k + 1))
            values.append(value[node[word]])
        if not starts:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0)
        start, size, value = map(np.concatenate, (starts, sizes, values))
        order = np.argsort(start, kind="stable")  # levels come by length
        return start[order], size[order], value[order]


def collect_lexicon(lexicon: DataFrame) -> Words | None:
    """The lexicon for broadcasting; None beyond LEXICON_WORDS. A word without logp has NaN and is never chosen."""
    rows = lexicon.select("word", "logp").limit(LEXICON_WORDS + 1).toPandas()
    if len(rows) > LEXICON_WORDS:
        return None
    return Words(rows["word"].tolist(), rows["logp"].to_numpy(dtype=np.float64, na_value=np.nan))


def choose_path(n: int, candidates: Callable[[int], list[tuple[int, float]]]) -> list[int]:
    """Ends of the best path over n characters; candidates are (end, log-probability), end exclusive."""
    best = [0.0] * (n + 1)
    to = [0] * (n + 1)
    for i in range(n - 1, -1, -1):
        top, end = _FLOOR, -1
        for e, p in candidates(i):
            p += best[e]
            if p > top:
                top, end = p, e
        if end < 0:
            top, end = UNKNOWN + best[i + 1], i + 1
        best[i], to[i] = top, end
    ends, i = [], 0
    while i < n:
        i = to[i]
        ends.append(i)
    return ends


def _runs(codes: np.ndarray) -> np.ndarray:
    """For each place the end of the run of ASCII letters and digits that holds it; 0 outside of runs."""
    low = codes | 32
    inside = ((codes >= 48) & (codes <= 57)) | ((low >= 97) & (low <= 122) & (codes < 128))
    out = np.where(inside, len(codes), np.arange(len(codes)))
    ends = np.minimum.accumulate(out[::-1])[::-1]
    return np.where(inside, ends, 0)


def _apart(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The codes of all texts with a gap after each, which no word spans; where each starts; its length."""
    plain, lens = code_points(texts)
    starts = np.cumsum(lens + 1) - lens - 1
    codes = np.full(len(plain) + len(texts), GAP, dtype=np.int64)
    codes[np.arange(len(plain)) + np.repeat(np.arange(len(texts)), lens)] = plain
    return codes, starts, lens


def _ways(codes: np.ndarray, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, log-probability, source) of the words (0) and runs of letters and digits (1), in order."""
    start, size, value = words.found(codes)
    run = _runs(codes)
    source = np.zeros(len(start), dtype=np.int32)
    if run.any():
        # A run ends like a word of its own where no dictionary word does.
        at = np.flatnonzero(run)
        ends, asked = start * (len(codes) + 1) + start + size, at * (len(codes) + 1) + run[at]  # in order, both
        there = np.searchsorted(ends, asked)
        there[there == len(ends)] = 0
        at = at[ends[there] != asked] if len(ends) else at
        start, size = np.concatenate((start, at)), np.concatenate((size, run[at] - at))
        value = np.concatenate((value, np.full(len(at), UNKNOWN)))
        source = np.concatenate((source, np.ones(len(at), dtype=np.int32)))
        order = np.argsort(start, kind="stable")
        start, size, value, source = start[order], size[order], value[order], source[order]
    return start, size, value, source


def best_paths(blocks: list[str], words: Words) -> list[list[str]]:
    """The words of each block."""
    codes, starts, lens = _apart(blocks)
    start, size, value, _ = _ways(codes, words)
    at = np.searchsorted(start, np.arange(len(codes) + 1)).tolist()
    ends, value = (start + size).tolist(), value.tolist()
    best = [0.0] * (len(codes) + 1)  # 0 at the gaps, so that each block begins anew
    to = list(range(1, len(codes) + 1))
    gap = set((starts + lens).tolist())
    hi = len(ends)
    for i in range(len(codes) - 1, -1, -1):
        lo = at[i]
        if lo == hi:
            if i not in gap:
                best[i] = UNKNOWN + best[i + 1]
            continue
        top, end = _FLOOR, -1
        for c in range(lo, hi):
            p = value[c] + best[ends[c]]
            if p > top:
                top, end = p, ends[c]
        if end < 0:
            top, end = UNKNOWN + best[i + 1], i + 1
        best[i], to[i] = top, end
        hi = lo
    out = []
    for block, lo, n in zip(blocks, starts.tolist(), lens.tolist()):
        cut, i, hi = [], lo, lo + n
        while i < hi:
            j = to[i]
            cut.append(block[i - lo : j - lo])
            i = j
        out.append(cut)
    return out


def edges_of(blocks: list[str], words: Words) -> pa.Array:
    """The candidates of each block as a list of (i, k, logp, source), a character alone (2) where nothing else starts."""
    codes, starts, lens = _apart(blocks)
    start, size, value, source = _ways(codes, words)
    alone = np.ones(len(codes), dtype=bool)
    alone[start] = alone[starts + lens] = False
    at = np.flatnonzero(alone)
    start = np.concatenate((start, at))
    order = np.argsort(start, kind="stable")
    start, size = start[order], np.concatenate((size, np.ones(len(at), dtype=np.int64)))[order]
    value = np.concatenate((value, np.full(len(at), UNKNOWN)))[order]
    source = np.concatenate((source, np.full(len(at), 2, dtype=np.int32)))[order]
    owner = np.searchsorted(starts, start, side="right") - 1
    bounds = np.searchsorted(owner, np.arange(len(blocks) + 1))
    place = start - starts[owner] if len(start) else start
    rows = pa.StructArray.from_arrays(
        [pa.array(place, pa.int32()), pa.array(size, pa.int32()), pa.array(value, pa.float64(), from_pandas=True), pa.array(source, pa.int32())],
        ["i", "k", "logp", "source"],
    )
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), rows)


def best_path(block: str, logp: dict[str, float] | Words) -> list[str]:
    """The words of one block."""
    return best_paths([block], Words.of(logp))[0]


class Cutter:
    """Cuts texts by dictionary, by tagger or by both; made once in each Python worker."""

    def __init__(
        self, logp: dict[str, float] | Words, tagger=None, mode: str = "dag", compat_duplicate: bool = False, punctuation: bool = True
    ) -> None:
        self.words = Words.of(logp)
        self.tagger = tagger
        self.mode = mode if tagger is not None else "dag"
        self.compat = compat_duplicate
        self.punctuation = punctuation
        self.memo: dict[str, tuple[str, ...]] = {}
        self.shared: dict[str, str] = {}
        self.memo_chars = 0
        self.inner: dict[str, tuple[str, ...]] = {}
        self.inner_chars = 0

    def _blocks(self, blocks: list[str]) -> list[list[str]]:
        """Words of blocks that are not letters and digits alone."""
        if self.mode == "crf":
            return self.tagger.cut_many(blocks, self.compat)
        paths = best_paths(blocks, self.words)
        return self.fill_gaps(paths) if self.mode == "hybrid" else paths

    def fill_gaps(self, paths: list[list[str]]) -> list[list[str]]:
        """Dictionary paths in which the tagger has cut the runs of single characters."""
        pieces: dict[int, list[tuple[bool, str]]] = {}
        for k, path in enumerate(paths):
            if min(map(len, path), default=2) > 1:
                continue
            mine = pieces[k] = []
            gap = ""
            for w in path:
                if len(w) > 1:
                    if gap:
                        mine.append((True, gap))
                        gap = ""
                    mine.append((False, w))
                else:
                    gap += w
            if gap:
                mine.append((True, gap))
        gaps = list(dict.fromkeys(p for mine in pieces.values() for is_gap, p in mine if is_gap))
        cut = dict(zip(gaps, self.tagger.cut_many(gaps, self.compat)))
        out = list(paths)
        for k, mine in pieces.items():
            out[k] = [w for is_gap, p in mine for w in (cut[p] if is_gap else (p,))]
        return out

    def cut_many(self, texts: list[str | None]) -> tuple[list[str], list[int]]:
        """The tokens of all texts in one list, and how many each text has."""
        cut = [_BLOCK.findall(t) if t else [] for t in texts]
        here: dict[str, list[str] | tuple[str, ...]] = {}
        new = []
        for block in dict.fromkeys(chain.from_iterable(cut)):
            known = self.memo.get(block)
            if known is None and block.isascii() and block.isalnum():
                known = [block]
            if known is None:
                new.append(block)
            else:
                here[block] = known
        if new:
            cuts = self._blocks(new)
            if not self.punctuation:
                cuts = [[w for w in words if _WORDY.search(w)] for words in cuts]
            here.update(zip(new, cuts))
            self.memo_chars += sum(map(len, new))
            if self.memo_chars > MEMORY:
                self.memo, self.shared, self.memo_chars = {}, {}, sum(map(len, new))
            if self.memo_chars <= MEMORY:
                # Equal words are one object, which takes far less than a copy for each block.
                one = self.shared.setdefault
                self.memo.update((block, tuple(one(w, w) for w in words)) for block, words in zip(new, cuts))
        sizes = list(accumulate(map(len, map(here.__getitem__, chain.from_iterable(cut))), initial=0))
        ends = list(accumulate(map(len, cut), initial=0))
        tokens = list(chain.from_iterable(map(here.__getitem__, chain.from_iterable(cut))))
        return tokens, [sizes[hi] - sizes[lo] for lo, hi in zip(ends, ends[1:])]

    def search_many(self, texts: list[str | None]) -> tuple[list[str], list[int]]:
        """Tokens with, before each of three characters or more, the dictionary words inside it."""
        tokens, counts = self.cut_many(texts)
        new = [t for t in dict.fromkeys(tokens) if t not in self.inner]
        self.inner_chars += sum(map(len, new))
        if self.inner_chars > MEMORY:
            self.inner, new = {}, list(dict.fromkeys(tokens))
            self.inner_chars = sum(map(len, new))
        self.inner.update(zip(new, self._inner(new)))
        ends = list(accumulate(counts, initial=0))
        sizes = list(accumulate(map(len, map(self.inner.__getitem__, tokens)), initial=0))
        return list(chain.from_iterable(map(self.inner.__getitem__, tokens))), [sizes[hi] - sizes[lo] for lo, hi in zip(ends, ends[1:])]

    def _inner(self, words: list[str]) -> list[tuple[str, ...]]:
        out = {w: (w,) for w in words}
        long = [w for w in words if len(w) > 2 and not (w.isascii() and w.isalnum())]
        codes, starts, _ = _apart(long)
        start, size, _ = self.words.found(codes)
        owner = np.searchsorted(starts, start, side="right") - 1
        inside: dict[str, list[str]] = {}
        lo = start - starts[owner] if len(start) else start
        for k, i, n in zip(owner.tolist(), lo.tolist(), size.tolist()):
            w = long[k]
            if n < len(w):
                inside.setdefault(w, []).append(w[i : i + n])
        for w, subs in inside.items():
            out[w] = (*subs, w)
        return [out[w] for w in words]

    def cut(self, text: str | None) -> list[str]:
        return self.cut_many([text])[0]

    def search(self, text: str | None) -> list[str]:
        return self.search_many([text])[0]


def _lists(tokens: list[str], counts: list[int]) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(list(accumulate(counts, initial=0)), pa.int32()), pa.array(tokens, pa.string()))


def _modes(mode: str) -> str:
    return mode if mode in ("dag", "crf", "hybrid") else "hybrid"


def segment_udf(
    session, logp: dict[str, float] | Words, tagger=None, mode: str = "hybrid", search: bool = False,
    compat_duplicate: bool = False, punctuation: bool = True,
) -> Callable[[Column | str], Column]:
    """A column function text -> array<string>. Unknown modes cut as `hybrid`; without a tagger, all as
    `dag`; without `punctuation`, tokens of punctuation alone go."""
    mode = _modes(mode)
    shared = session.sparkContext.broadcast((Words.of(logp).levels, tagger.weights() if tagger is not None else None))
    session.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH))

    @F.arrow_udf("array<string>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        levels, weights = shared.value
        cutter = Cutter(Words.of_levels(levels), Tagger(*weights) if weights else None, mode, compat_duplicate, punctuation)
        cut = cutter.search_many if search else cutter.cut_many
        for texts in batches:
            yield _lists(*cut(texts.to_pylist()))

    # Else a filter on the tokens would be pushed below the cut with a second copy of it.
    return run.asNondeterministic()


def routed_udf(session, logp: dict[str, float] | Words, tagger=None) -> Callable[..., Column]:
    """A column function (text, mode, search) -> array<string>: every row is cut once, in its own way."""
    shared = session.sparkContext.broadcast((Words.of(logp).levels, tagger.weights() if tagger is not None else None))
    session.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH))

    @F.arrow_udf("array<string>")
    def run(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        levels, weights = shared.value
        words = Words.of_levels(levels)
        model = Tagger(*weights) if weights else None
        cutters = {m: Cutter(words, model, m) for m in ("dag", "crf", "hybrid")}
        for texts, modes, searches in batches:
            rows: dict[tuple[str, bool], list[int]] = {}
            for k, route in enumerate(zip(modes.to_pylist(), searches.to_pylist())):
                rows.setdefault((_modes(route[0]), bool(route[1])), []).append(k)
            plain = texts.to_pylist()
            out: list[list[str]] = [[]] * len(plain)
            for (mode, search), ks in rows.items():
                cutter = cutters[mode]
                tokens, counts = (cutter.search_many if search else cutter.cut_many)([plain[k] for k in ks])
                at = list(accumulate(counts, initial=0))
                for k, lo, hi in zip(ks, at, at[1:]):
                    out[k] = tokens[lo:hi]
            yield _lists(list(chain.from_iterable(out)), list(map(len, out)))

    return run.asNondeterministic()


def segment(
    df: DataFrame, text_col: str, lexicon: DataFrame, model=None, mode: str = "hybrid", search: bool = False, out: str = "tokens",
    compat_duplicate: bool = False, punctuation: bool = True,
) -> DataFrame:
    """`df` with the tokens of `text_col`: one narrow pass, the lexicon and the model broadcast. A lexicon
    of more than LEXICON_WORDS is joined to the distinct blocks instead."""
    words = collect_lexicon(lexicon)
    if words is None:
        return _segment_joined(df, text_col, lexicon, model, _modes(mode), search, out, compat_duplicate, punctuation)
    run = segment_udf(df.sparkSession, words, model, mode, search, compat_duplicate, punctuation)
    return df.withColumn(out, run(F.col(text_col)))


def cutter(lexicon: DataFrame, model=None, mode: str = "hybrid") -> Callable[[DataFrame, str, str], DataFrame]:
    """`segment` for many frames: (df, text_col, out) -> df with tokens, lexicon and model collected once."""
    words = collect_lexicon(lexicon)
    if words is None:
        return lambda df, text_col, out: _segment_joined(df, text_col, lexicon, model, _modes(mode), False, out, False, True)
    run = segment_udf(lexicon.sparkSession, words, model, mode)
    return lambda df, text_col, out: df.withColumn(out, run(F.col(text_col)))


def cut_dag(df: DataFrame, text_col: str, lexicon: DataFrame, out: str = "tokens") -> DataFrame:
    return segment(df, text_col, lexicon, None, "dag", out=out)


def search_tokens(df: DataFrame, text_col: str, lexicon: DataFrame, model=None, mode: str = "dag", out: str = "tokens") -> DataFrame:
    """Tokens with, before each of three characters or more, the dictionary words inside it."""
    return segment(df, text_col, lexicon, model, mode, True, out)


def segment_corpus(docs: DataFrame, lexicon: DataFrame, text_col: str = "text", out: str = "tokens") -> DataFrame:
    """Dictionary cut without tokens of punctuation alone; rows without tokens go."""
    return segment(docs, text_col, lexicon, None, "dag", out=out, punctuation=False).filter(F.size(out) > 0)


def segment_lines(docs: DataFrame, lexicon: DataFrame, model=None, mode: str = "hybrid", text_col: str = "text") -> DataFrame:
    """`line`: the tokens of each text that is not blank, joined by ` / `."""
    rows = docs.withColumn(text_col, T.trim_space(text_col)).filter(F.col(text_col) != "")
    return segment(rows, text_col, lexicon, model, mode).withColumn("line", F.array_join("tokens", " / ")).drop("tokens")


def _numbered(blocks: DataFrame, block_col: str) -> DataFrame:
    """(b, block): distinct blocks under a short name: themselves, or a digest of long ones."""
    b = blocks.select(F.col(block_col).alias("block")).distinct()
    return b.select(F.when(F.char_length("block") <= 32, F.col("block")).otherwise(F.sha2("block", 256)).alias("b"), "block")


def _side(df: DataFrame) -> DataFrame:
    """A side of the lexicon for a join: broadcast when it has few rows, which are counted."""
    return F.broadcast(df) if df.count() <= JOINED_WORDS else df


def _candidates(b: DataFrame, lexicon: DataFrame, longest: int) -> DataFrame:
    """(b, i, found): the candidates (source, k, logp) that start at place i of a block, in order.

    A place carries its next `longest` characters. The first two tell how long the longest word is that
    begins with them, so a place where none does is not expanded, and others only as far as words go.
    """
    longest = max(1, longest)
    piece = F.posexplode(T.pieces("block", longest - 1))
    at = b.filter("block <> ''").select("b", F.char_length("block").alias("n"), piece.alias("piece_no", "piece"))
    size = F.least(F.lit(T.PIECE), F.col("n") - F.col("piece_no") * T.PIECE)
    stubs = F.posexplode(F.transform(F.sequence(F.lit(1), size), lambda j: F.substring(F.col("piece"), j, F.lit(longest))))
    places = at.select("b", "piece_no", stubs.alias("j", "stub")).select("b", (F.col("piece_no") * T.PIECE + F.col("j")).alias("i"), "stub")
    heads = lexicon.filter(F.char_length("word") > 1).groupBy(F.substring("word", 1, 2).alias("head")).agg(F.max(F.char_length("word")).alias("most"))
    reach = places.join(_side(heads), F.substring("stub", 1, 2) == F.col("head"), "left")
    ends = F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.coalesce("most", F.lit(1)), F.char_length("stub"))))
    subs = reach.select("b", "i", "stub", F.explode(ends).alias("k")).withColumn("word", F.substring(F.col("stub"), F.lit(1), F.col("k")))
    told = lexicon.select("word", "logp", F.lit(True).alias("is_word"))
    words = subs.join(_side(told), "word", "left").filter("is_word OR k = 1")
    words = words.select(
        "b", "i", F.when(F.col("is_word"), 0).otherwise(2).alias("source"), "k", F.when(F.col("is_word"), F.col("logp")).otherwise(F.lit(UNKNOWN)).alias("logp")
    )
    # Every end of a run of letters and digits, from each of its places.
    mixed = F.posexplode(F.regexp_extract_all("block", F.lit(f"([{T.ALNUM}]+|[^{T.ALNUM}]+)"), F.lit(1)))
    parts = b.filter(T.has_alnum("block")).select("b", mixed.alias("p", "part")).withColumn("m", F.char_length("part"))
    before = Window.partitionBy("b").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    runs = parts.withColumn("lo", F.coalesce(F.sum("m").over(before), F.lit(0)).cast("int")).filter(T.is_alnum("part"))
    runs = runs.select("b", "lo", "m", "part", F.explode(F.sequence(F.lit(0), F.col("m") - 1)).alias("j")).withColumn("k", F.col("m") - F.col("j"))
    known = lexicon.select("word", F.col("logp").alias("lp"), F.lit(True).alias("known"))
    runs = runs.select(
        "b", (F.col("lo") + F.col("j")).alias("i"), "k",
        F.when(F.col("k") <= longest, F.substring(F.col("part"), F.col("j") + 1, F.col("k"))).alias("word"),
    ).join(known, "word", "left")
    runs = runs.select("b", "i", F.lit(1).alias("source"), "k", F.when(F.col("known"), F.col("lp")).otherwise(F.lit(UNKNOWN)).alias("logp"))
    found = words.unionByName(runs).groupBy("b", "i").agg(F.array_sort(F.collect_list(F.struct("source", "k", "logp"))).alias("x"))
    # One run at most: it counts where no word ends with it; one character alone where nothing else starts.
    inside = lambda c: F.exists(F.filter("x", lambda y: y["source"] == 0), lambda y: y["k"] == c["k"])
    keep = F.filter("x", lambda c: (c["source"] == 0) | ((c["source"] == 1) & ~inside(c)) | ((c["source"] == 2) & (F.size("x") == 1)))
    return found.select("b", "i", keep.alias("found"))


def lattice_edges(blocks: DataFrame, lexicon: DataFrame, longest: int, block_col: str = "block") -> DataFrame:
    """(block, i, k, logp, source): candidates of k characters from place i (0 first) of each block.

    Dictionary words (source 0), the whole run of letters and digits (source 1) where it is no such word,
    the single character (source 2) where nothing else starts. A lexicon of up to LEXICON_WORDS is broadcast and
    found in the blocks, a larger one joined on the substring.
    """
    words = collect_lexicon(lexicon)
    if words is not None:
        run = _blocks_udf(lexicon.sparkSession, words, "array<struct<i:int,k:int,logp:double,source:int>>", edges_of)
        found = _distinct(blocks, block_col).select("block", run("block").alias("c")).select("block", F.explode("c").alias("c"))
        return found.select("block", "c.i", "c.k", "c.logp", "c.source")
    b = _numbered(blocks, block_col)
    edges = _candidates(b, lexicon, longest).select("b", "i", F.explode("found").alias("c"))
    edges = edges.select("b", "i", "c.k", "c.logp", "c.source")
    short = edges.filter(F.char_length("b") <= 32).withColumnRenamed("b", "block")
    long = edges.filter(F.char_length("b") > 32).join(b.filter(F.char_length("block") > 32), "b").select(*short.columns)
    return short.unionByName(long)


def _distinct(blocks: DataFrame, block_col: str) -> DataFrame:
    return blocks.select(F.col(block_col).alias("block")).filter("block <> ''").distinct()


def _blocks_udf(session, words: Words, kind: str, made: Callable[[list[str], Words], pa.Array]) -> Callable[[Column | str], Column]:
    """A column function of a block with the words broadcast."""
    shared = session.sparkContext.broadcast(words.levels)
    session.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH))

    @F.arrow_udf(kind)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = Words.of_levels(shared.value)
        for blocks in batches:
            yield made(blocks.to_pylist(), known)

    return run.asNondeterministic()


def cut_blocks(blocks: DataFrame, lexicon: DataFrame, longest: int, block_col: str = "block") -> DataFrame:
    """(block, tokens) of distinct blocks: with the lexicon broadcast, or beyond LEXICON_WORDS by `cut_joined`."""
    words = collect_lexicon(lexicon)
    if words is None:
        return cut_joined(blocks, lexicon, longest, block_col)
    run = _blocks_udf(lexicon.sparkSession, words, "array<string>", lambda texts, known: pa.array(best_paths(texts, known), pa.list_(pa.string())))
    return _distinct(blocks, block_col).select("block", run("block").alias("tokens"))


def cut_joined(blocks: DataFrame, lexicon: DataFrame, longest: int, block_col: str = "block") -> DataFrame:
    """(block, tokens) of distinct blocks with the lexicon joined, not broadcast: for lexicons of any size.

    A block longer than LONG_BLOCK falls into pieces of about that many characters, each between places that
    no candidate crosses, so that its best path is that of its pieces; where there is no such place it stays whole.
    """
    b = _numbered(blocks, block_col)
    short, long = b.filter(F.char_length("block") <= LONG_BLOCK), b.filter(F.char_length("block") > LONG_BLOCK)
    edges = F.array_sort(F.collect_list(F.struct("i", "found"))).alias("edges")
    each = _candidates(short, lexicon, longest).groupBy("b").agg(edges)

    @F.pandas_udf("array<string>")
    def paths(block: pd.Series, edges: pd.Series) -> pd.Series:
        out = []
        for text, places in zip(block, edges):
            first = places[0]["i"]
            at = [
                [(e["i"] - first + c["k"], math.nan if c["logp"] is None else c["logp"]) for c in e["found"]] for e in places
            ]  # every place has an entry
            words, lo = [], 0
            for end in choose_path(len(text), at.__getitem__):
                words.append(text[lo:end])
                lo = end
            out.append(words)
        return pd.Series(out, dtype=object)

    whole = short.join(each, "b").select("block", paths("block", "edges").alias("tokens"))
    parts = path_pieces(_candidates(long, lexicon, longest)).groupBy("b", "piece").agg(F.min("i").alias("lo"), F.count("*").cast("int").alias("n"), edges)
    text = F.substring(F.col("block"), F.col("lo") + 1, F.col("n"))
    cut = long.join(parts, "b").select("b", "piece", paths(text, "edges").alias("tokens"))
    cut = cut.groupBy("b").agg(F.flatten(F.array_sort(F.collect_list(F.struct("piece", "tokens")))["tokens"]).alias("tokens"))
    return whole.unionByName(long.join(cut, "b").select("block", "tokens"))


def path_pieces(candidates: DataFrame) -> DataFrame:
    """The candidates (b, i, found) with `piece`, which grows at the first place behind each multiple of
    LONG_BLOCK that no candidate crosses. The places of a block pass one task in order, none held."""
    row = Window.partitionBy("b").orderBy("i")
    behind = row.rowsBetween(Window.unboundedPreceding, -1)
    ends = candidates.withColumn("end", F.col("i") + F.array_max(F.transform("found", lambda c: c["k"])))
    free = F.when(F.coalesce(F.max("end").over(behind), F.lit(0)) <= F.col("i"), F.col("i"))
    last = F.max("free").over(row.rowsBetween(Window.unboundedPreceding, 0))
    return ends.withColumn("free", free).withColumn("piece", F.floor(last / LONG_BLOCK)).drop("end", "free")


def _segment_joined(
    df: DataFrame, text_col: str, lexicon: DataFrame, model, mode: str, search: bool, out: str, compat_duplicate: bool, punctuation: bool
) -> DataFrame:
    """`segment` by joins: distinct blocks are cut once and joined back to their places in the texts."""
    longest = lexicon.agg(F.max(F.char_length("word"))).first()[0] or 1
    mode = mode if model is not None else "dag"
    rows = df.select(F.struct("*").alias("row"), F.monotonically_increasing_id().alias("no"), T.split_blocks(text_col).alias("blocks"))
    rows = rows.select("no", "row", F.posexplode_outer("blocks").alias("pos", "block"))
    rows = rows.select("no", F.coalesce("pos", F.lit(0)).alias("pos"), "block", F.when(F.coalesce("pos", F.lit(0)) == 0, F.col("row")).alias("row"))
    todo = df.select(F.explode(T.split_blocks(text_col)).alias("block")).filter(~T.is_alnum("block")).distinct()
    if mode == "crf":
        cut = todo.withColumn("tokens", segment_udf(df.sparkSession, {}, model, "crf", compat_duplicate=compat_duplicate)("block"))
    else:
        cut = cut_joined(todo, lexicon, longest)
    if mode == "hybrid":
        shared = df.sparkSession.sparkContext.broadcast(model.weights())

        @F.pandas_udf("array<string>")
        def fill(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            cutter = Cutter({}, Tagger(*shared.value), "hybrid", compat_duplicate)
            for paths in batches:
                yield pd.Series(cutter.fill_gaps([list(p) for p in paths]), dtype=object)

        cut = cut.withColumn("tokens", fill("tokens"))
    if not punctuation:
        cut = cut.withColumn("tokens", F.filter("tokens", lambda t: ~T.is_punctuation(t)))
    if search:
        cut = _searched(cut, lexicon, longest)
    done = rows.join(cut, "block", "left").withColumn("tokens", F.coalesce("tokens", F.when(F.col("block").isNotNull(), F.array("block")).otherwise(F.array().cast("array<string>"))))
    joined = done.groupBy("no").agg(F.first("row", ignorenulls=True).alias("row"), F.array_sort(F.collect_list(F.struct("pos", "tokens"))).alias("x"))
    return joined.select("row.*", F.flatten("x.tokens").alias(out))


def _searched(cut: DataFrame, lexicon: DataFrame, longest: int) -> DataFrame:
    """(block, tokens) with the dictionary words inside each token before it."""
    at = cut.select("block", F.posexplode("tokens").alias("p", "token"))
    long = at.select("token").distinct().filter((F.char_length("token") > 2) & ~T.is_alnum("token"))
    n = F.char_length("token")
    starts = long.select("token", F.explode(F.sequence(F.lit(1), n)).alias("i"))
    subs = starts.select("token", "i", F.explode(F.sequence(F.lit(1), F.least(F.lit(longest), n - F.col("i") + 1))).alias("k")).filter(F.col("k") < n)
    subs = subs.withColumn("word", F.substring(F.col("token"), F.col("i"), F.col("k"))).join(lexicon.select("word"), "word", "left_semi")
    inner = subs.groupBy("token").agg(F.array_sort(F.collect_list(F.struct("i", "k", "word")))["word"].alias("inner"))
    full = at.join(inner, "token", "left").withColumn("ts", F.concat(F.coalesce("inner", F.array().cast("array<string>")), F.array("token")))
    back = full.groupBy("block").agg(F.flatten(F.array_sort(F.collect_list(F.struct("p", "ts")))["ts"]).alias("tokens"))
    none = F.array().cast("array<string>")  # a block may have lost all its tokens
    return cut.select("block").join(back, "block", "left").withColumn("tokens", F.coalesce("tokens", none))
