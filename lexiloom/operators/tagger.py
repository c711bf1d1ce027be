"""Sequence tagger: tags B, M, E, S (0 to 3), five character features, Viterbi decoding.

A worker decodes a batch of sequences at once: emissions of all places are gathered as arrays, and one
step of the decoder takes every sequence that is that long. Sums run in the same order as for one
sequence alone, so ties fall alike.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.functions import text as T

OUTSIDE = "_BOS_"
#: Feature names by the distance of the character they show.
TEMPLATES = {-2: "U00:", -1: "U01:", 0: "U02:", 1: "U03:", 2: "U04:"}
#: A code that stands between texts in one array; no character has it.
GAP = 0x110000
#: Rows a model may have: five features a character, four tags each. No model is larger, so it may be broadcast.
FEATURE_ROWS = 5 * 4 * (GAP + 1)
#: Sequences that are much longer than all others are decoded one by one.
FEW = 4
#: Characters of a sequence that are decoded at once; of longer ones the sums before each piece are kept.
PIECE = 1 << 16

_BEFORE = (OUTSIDE, OUTSIDE)


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The characters of all texts, one after another, and the length of each text."""
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
    return codes, np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))


def feature_names(chars: str | list[str]) -> list[list[str]]:
    """The five features of each place."""
    padded = [*_BEFORE, *chars, *_BEFORE]
    return [[name + padded[i + 2 + d] for d, name in TEMPLATES.items()] for i in range(len(chars))]


class Tagger:
    """Weights of transitions (4 x 4) and of features (feature -> 4 weights)."""

    def __init__(self, trans: list[list[float]] | None = None, feats: dict[str, list[float]] | None = None) -> None:
        self.trans = trans if trans is not None else [[0.0] * 4 for _ in range(4)]
        self.feats = feats if feats is not None else {}
        self.tables: list[tuple[np.ndarray, np.ndarray]] | None = None

    def weights(self) -> tuple[list[list[float]], dict[str, list[float]]]:
        return self.trans, self.feats

    @classmethod
    def collect(cls, trans: DataFrame, feats: DataFrame) -> Tagger:
        """The model of two tables (at most FEATURE_ROWS rows of features that text can have)."""
        out = cls()
        for r in trans.collect():  # at most 16 rows
            out.trans[r["from_tag"]][r["to_tag"]] = r["weight"]
        # Others never match a place: a template's name and one character, or the mark outside.
        shown = F.substring("feature", 1, 4).isin(*TEMPLATES.values()) & (
            (F.char_length("feature") == 5) | (F.substring(F.col("feature"), F.lit(5), F.char_length("feature")) == OUTSIDE)
        )
        rows = feats.filter(shown).select("feature", "tag", "weight").toPandas()
        for f, tag, w in zip(rows["feature"], rows["tag"], rows["weight"]):
            out.feats.setdefault(f, [0.0] * 4)[tag] = w
        return out

    def emissions(self, chars: str | list[str]) -> list[list[float]]:
        get, out = self.feats.get, []
        for names in feature_names(chars):
            a = b = c = d = 0.0
            for name in names:
                w = get(name)
                if w is not None:
                    a += w[0]
                    b += w[1]
                    c += w[2]
                    d += w[3]
            out.append([a, b, c, d])
        return out

    def decode(self, chars: str | list[str]) -> list[int]:
        """Tags of the best sequence; of equal scores the lowest tag."""
        return best_tags(self.emissions(chars), self.trans)

    def _tables(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each template the codes of its characters and their weights; row 0 is for all others."""
        if self.tables is None:
            by: dict[str, dict[int, list[float]]] = {name: {} for name in TEMPLATES.values()}
            for feature, w in self.feats.items():
                rows, rest = by.get(feature[:4]), feature[4:]
                if rows is not None and (rest == OUTSIDE or len(rest) == 1):
                    rows[GAP if rest == OUTSIDE else ord(rest)] = w
            self.tables = []
            for rows in by.values():
                codes = np.array(sorted(rows), dtype=np.int64)
                self.tables.append((codes, np.array([[0.0] * 4, *(rows[c] for c in codes.tolist())])))
        return self.tables

    def emissions_of(self, codes: np.ndarray, lens: np.ndarray) -> np.ndarray:
        """Scores (place, tag) of sequences that lie one after another."""
        pad = 2  # marks between the sequences, as far as features look
        at = np.arange(len(codes)) + np.repeat(np.arange(len(lens)) * pad + pad, lens)
        wide = np.full(len(codes) + pad * (len(lens) + 1), GAP, dtype=np.int64)
        wide[at] = codes
        out = np.zeros((len(codes), 4))
        for d, (known, weights) in zip(TEMPLATES, self._tables()):
            if not len(known):
                continue
            seen = wide[at + d]
            row = np.searchsorted(known, seen)
            row[row == len(known)] = 0
            out += weights[np.where(known[row] == seen, row + 1, 0)]
        return out

    def decode_many(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The tags of all texts, one after another, and the length of each text."""
        codes, lens = code_points(texts)
        scores = self.emissions_of(codes, lens)
        tags = np.zeros(len(codes), dtype=np.int8)
        starts = np.cumsum(lens) - lens
        order = np.argsort(-lens, kind="stable")
        order = order[lens[order] > 0]
        # The few that are much longer than the rest.
        bound = 2 * int(lens[order[FEW - 1]]) + 64 if len(order) >= FEW else 0
        alone = order[lens[order] > bound]
        for k in alone.tolist():
            lo, hi = int(starts[k]), int(starts[k] + lens[k])
            tags[lo:hi] = best_tags_long(scores[lo:hi], self.trans)
        order = order[len(alone):]
        if len(order):
            trans, lo, n = np.array(self.trans), starts[order], lens[order]
            now, backs = scores[lo].copy(), []
            many = np.searchsorted(-n, -np.arange(1, int(n[0])), side="left")  # sequences longer than 1, 2, ...
            for step, m in enumerate(many.tolist(), 1):
                options = (now[:m, :, None] + trans) + scores[lo[:m] + step][:, None, :]
                back = options.argmax(axis=1)  # the first of equals
                now[:m] = np.take_along_axis(options, back[:, None, :], axis=1)[:, 0, :]
                backs.append(back.astype(np.int8))
            tag = now.argmax(axis=1)
            for step in range(len(backs), 0, -1):
                back = backs[step - 1]
                m = len(back)
                tags[lo[:m] + step] = tag[:m]
                tag[:m] = back[np.arange(m), tag[:m]]
            tags[lo] = tag
        return tags, lens

    def cut(self, block: str, compat_duplicate: bool = False) -> list[str]:
        return self.cut_many([block], compat_duplicate)[0]

    def cut_many(self, texts: list[str], compat_duplicate: bool = False) -> list[list[str]]:
        """The words of each text."""
        if not texts:
            return []
        tags, lens = self.decode_many(texts)
        starts = np.cumsum(lens) - lens
        if compat_duplicate:
            return [join_tags(t, tags[lo : lo + n].tolist(), True) for t, lo, n in zip(texts, starts.tolist(), lens.tolist())]
        # A word begins where B or S stands, after E or S, and where its text does.
        begins = (tags == 0) | (tags == 3)
        begins[1:] |= (tags[:-1] == 2) | (tags[:-1] == 3)
        begins[starts[lens > 0]] = True
        cuts = np.append(np.flatnonzero(begins), len(tags))
        first = np.searchsorted(cuts, starts).tolist()
        last = np.searchsorted(cuts, starts + lens).tolist()
        cuts = cuts.tolist()
        return [
            [t[cuts[k] - lo : cuts[k + 1] - lo] for k in range(a, b)] for t, lo, a, b in zip(texts, starts.tolist(), first, last)
        ]


def best_tags(scores: list[list[float]], trans: list[list[float]]) -> list[int]:
    """The tags of one sequence."""
    if not scores:
        return []
    last, back = _steps(islice(scores, 1, None), trans, scores[0])
    tag = last.index(max(last))
    tags = [tag]
    for frm in reversed(back):
        tag = frm[tag]
        tags.append(tag)
    return tags[::-1]


def best_tags_long(scores: np.ndarray, trans: list[list[float]], piece: int | None = None) -> np.ndarray:
    """The tags of one sequence of any length.

    The way there keeps only the four sums before each piece; the way back decodes piece by piece from
    them. Every sum is the one of `best_tags`, so ties fall alike.
    """
    piece = piece or PIECE
    tags = np.zeros(len(scores), dtype=np.int8)
    if not len(scores):
        return tags
    sums, before = scores[0].tolist(), []
    starts = range(1, len(scores), piece)
    back: list[tuple[int, int, int, int]] = []
    for lo in starts:
        before.append(sums)
        sums, back = _steps(scores[lo : lo + piece].tolist(), trans, sums)
    tag = sums.index(max(sums))
    for lo, kept in zip(reversed(starts), reversed(before)):
        if lo != starts[-1]:  # of the last piece the way there is still known
            _, back = _steps(scores[lo : lo + piece].tolist(), trans, kept)
        mine = []
        for frm in reversed(back):
            mine.append(tag)
            tag = frm[tag]
        tags[lo : lo + len(mine)] = mine[::-1]
    tags[0] = tag
    return tags


def _steps(
    scores: Iterable[list[float]], trans: list[list[float]], sums: list[float]
) -> tuple[list[float], list[tuple[int, int, int, int]]]:
    """The sums behind the scores and where each came from; written out tag by tag, which takes half the time of a loop.

    Sums run in the order previous + transition + emission, as ties depend on it; the first of equals wins.
    """
    (t00, t01, t02, t03), (t10, t11, t12, t13), (t20, t21, t22, t23), (t30, t31, t32, t33) = trans
    a0, a1, a2, a3 = sums
    back: list[tuple[int, int, int, int]] = []
    for e0, e1, e2, e3 in scores:
        n0, b0, x = a0 + t00 + e0, 0, a1 + t10 + e0
        if x > n0:
            n0, b0 = x, 1
        x = a2 + t20 + e0
        if x > n0:
            n0, b0 = x, 2
        x = a3 + t30 + e0
        if x > n0:
            n0, b0 = x, 3
        n1, b1, x = a0 + t01 + e1, 0, a1 + t11 + e1
        if x > n1:
            n1, b1 = x, 1
        x = a2 + t21 + e1
        if x > n1:
            n1, b1 = x, 2
        x = a3 + t31 + e1
        if x > n1:
            n1, b1 = x, 3
        n2, b2, x = a0 + t02 + e2, 0, a1 + t12 + e2
        if x > n2:
            n2, b2 = x, 1
        x = a2 + t22 + e2
        if x > n2:
            n2, b2 = x, 2
        x = a3 + t32 + e2
        if x > n2:
            n2, b2 = x, 3
        n3, b3, x = a0 + t03 + e3, 0, a1 + t13 + e3
        if x > n3:
            n3, b3 = x, 1
        x = a2 + t23 + e3
        if x > n3:
            n3, b3 = x, 2
        x = a3 + t33 + e3
        if x > n3:
            n3, b3 = x, 3
        back.append((b0, b1, b2, b3))
        a0, a1, a2, a3 = n0, n1, n2, n3
    return [a0, a1, a2, a3], back


def join_tags(chars: str | list[str], tags: list[int], compat_duplicate: bool = False) -> list[str]:
    """Words that tags cut characters into, as `functions.text.words_of_tags`."""
    out: list[str] = []
    word = ""
    for c, tag in zip(chars, tags):
        if tag in (0, 3) and word:
            out += [word] * (2 if tag == 3 and compat_duplicate else 1)
            word = ""
        if tag == 3:
            out.append(c)
            continue
        word += c
        if tag == 2:
            out.append(word)
            word = ""
    return [*out, word] if word else out


def sentences_of_corpus(lines: DataFrame, line_col: str = "line") -> DataFrame:
    """The other columns with chars and tags of the line's words, punctuation aside; empty ones go."""
    words = F.filter(T.fields(line_col), lambda w: ~T.is_punctuation(w))
    keep = [c for c in lines.columns if c != line_col]
    rows = lines.select(*keep, words.alias("_w"))
    return rows.filter(F.size("_w") > 0).select(
        *keep, T.characters(F.array_join("_w", "")).alias("chars"), F.flatten(F.transform("_w", T.word_tags)).alias("tags")
    )


def sentences_of_lexicon(entries: DataFrame) -> DataFrame:
    """Every dictionary line (word, ...) as a sentence of one word, punctuation aside."""
    keep = [c for c in entries.columns if c not in ("word", "freq")]
    return entries.filter(~T.is_punctuation("word")).select(*keep, T.characters("word").alias("chars"), T.word_tags("word").alias("tags"))


def tagger_features(sentences: DataFrame, id_col: str = "sent_id") -> DataFrame:
    """(id, pos, template 0 to 4, feature) of every place; neighbours are picked from the array."""
    at = sentences.select(id_col, "chars", F.posexplode("chars").alias("pos", "c"))
    pick = lambda d: F.when(F.col("pos") + d >= 0, F.get("chars", F.col("pos") + d))
    feats = F.array(*[F.concat(F.lit(name), F.coalesce(pick(d), F.lit(OUTSIDE))) for d, name in TEMPLATES.items()])
    return at.select(id_col, "pos", F.posexplode(feats).alias("template", "feature"))


def emission_scores(sentences: DataFrame, feats: DataFrame, id_col: str = "sent_id") -> DataFrame:
    """(id, pos, tag, score): summed weights of the place's features for each tag."""
    rows = tagger_features(sentences, id_col)
    tags = F.explode(F.array(*[F.lit(t) for t in range(4)])).alias("tag")
    hit = rows.join(feats, "feature").groupBy(id_col, "pos", "tag").agg(F.sum("weight").alias("score"))
    every = rows.filter("template = 0").select(id_col, "pos", tags)
    return every.join(hit, [id_col, "pos", "tag"], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))


def viterbi_decode(sentences: DataFrame, model: Tagger, out: str = "pred") -> DataFrame:
    """`sentences` (chars, ...) with the decoded tags."""
    shared = sentences.sparkSession.sparkContext.broadcast(model.weights())

    @F.pandas_udf("array<int>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tagger = Tagger(*shared.value)
        for chars in batches:
            tags, lens = tagger.decode_many(["".join(c) for c in chars])
            yield pd.Series(np.split(tags.astype(np.int32), np.cumsum(lens)[:-1]) if len(lens) else [], dtype=object)

    return sentences.withColumn(out, run("chars"))
