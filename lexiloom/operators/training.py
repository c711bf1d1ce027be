"""Training of the tagger: structured perceptron, in one sequence or by iterative parameter mixing.

`learn` is one online update in plain form; `Learners` make the same updates on arrays, for a sequence of each
of several shards at once. Weights of the training lie on a grid (`GRAIN`), so their sums are exact in any
order, and a sequence is decoded in lanes side by side (`tags_by_lanes`) without a change to any tie.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.operators.tagger import GAP, OUTSIDE, TEMPLATES, Tagger, best_tags, code_points, feature_names, tagger_features

EPOCHS = 10
#: Characters a shard of the training data has, where the number of shards is not given.
SHARD_CHARS = 250_000
#: Mixed weights are whole multiples of 1 / GRAIN, so that sums of them are exact in whatever order they are taken.
GRAIN = 1 << 20
#: Characters of a lane, and those before it from which its beginning is guessed.
LANE, AHEAD = 64, 12
#: Sequences of fewer characters are decoded in plain loops.
SHORT = 32
#: Sums up to this bound are exact on the grid.
EXACT = float((1 << 52) // GRAIN)
#: Shards that a task trains side by side, bytes of their weights and characters of them that it holds, all at most.
TOGETHER, WEIGHT_BYTES, HELD = 32, 64 << 20, 8 << 20


def perceptron_deltas(sentences: DataFrame, id_col: str = "sent_id") -> tuple[DataFrame, DataFrame]:
    """Batch updates of sentences (chars, tags, pred) with any wrong tag.

    Features (feature, tag, weight): +1 for the right tag and -1 for the other wherever they differ;
    transitions (from_tag, to_tag, weight): the same for pairs that differ. Zeros are left out.
    """
    wrong = sentences.filter("tags <> pred")
    at = wrong.select(id_col, F.posexplode(F.arrays_zip("tags", "pred")).alias("pos", "p")).select(
        id_col, "pos", F.col("p.tags").alias("gold"), F.col("p.pred").alias("guess")
    )
    moves = F.explode(F.array(F.struct(F.col("gold").alias("tag"), F.lit(1.0).alias("w")), F.struct(F.col("guess").alias("tag"), F.lit(-1.0).alias("w"))))
    feats = (
        tagger_features(wrong, id_col).join(at.filter("gold <> guess"), [id_col, "pos"])
        .select("feature", moves.alias("m")).groupBy("feature", F.col("m.tag").alias("tag")).agg(F.sum("m.w").alias("weight"))
    )
    pairs = wrong.select(
        F.explode(
            F.transform(
                F.sequence(F.lit(1), F.greatest(F.size("tags") - 1, F.lit(1))),
                lambda i: F.struct(
                    F.get("tags", i - 1).alias("g0"), F.get("tags", i).alias("g1"), F.get("pred", i - 1).alias("p0"), F.get("pred", i).alias("p1")
                ),
            )
        ).alias("x")
    ).filter("x.g1 IS NOT NULL AND (x.g0 <> x.p0 OR x.g1 <> x.p1)")
    steps = F.explode(
        F.array(
            F.struct(F.col("x.g0").alias("a"), F.col("x.g1").alias("b"), F.lit(1.0).alias("w")),
            F.struct(F.col("x.p0").alias("a"), F.col("x.p1").alias("b"), F.lit(-1.0).alias("w")),
        )
    )
    trans = pairs.select(steps.alias("s")).groupBy(F.col("s.a").alias("from_tag"), F.col("s.b").alias("to_tag")).agg(F.sum("s.w").alias("weight"))
    return feats.filter("weight <> 0"), trans.filter("weight <> 0")


def sentence_accuracy(sentences: DataFrame) -> DataFrame:
    """One row (accuracy): the share of sentences with every tag right."""
    return sentences.agg(F.avg((F.col("tags") == F.col("pred")).cast("double")).alias("accuracy"))


def learn(model: Tagger, chars: list[str], tags: list[int]) -> None:
    """One online update."""
    pred = model.decode(chars)
    if pred == tags:
        return
    for names, g, p in zip(feature_names(chars), tags, pred):
        if g != p:
            for f in names:
                w = model.feats.setdefault(f, [0.0] * 4)
                w[g] += 1.0
                w[p] -= 1.0
    for i in range(1, len(tags)):
        if tags[i - 1] != pred[i - 1] or tags[i] != pred[i]:
            model.trans[tags[i - 1]][tags[i]] += 1.0
            model.trans[pred[i - 1]][pred[i]] -= 1.0


#: A map of the four tags in one byte, two bits for each; _AFTER has the map of b behind c at b << 8 | c.
_SAME = 0b11100100


def _after() -> np.ndarray:
    maps, shift = np.arange(256), 2 * np.arange(4)
    to = (maps[:, None] >> shift) & 3
    return (((maps[:, None, None] >> 2 * to) & 3) << shift).sum(axis=2).astype(np.uint8).ravel()


_AFTER = _after()


def tags_by_lanes(scores: Callable[[np.ndarray, np.ndarray], np.ndarray], starts: np.ndarray, lens: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """The tags of sequences, one after another, as `best_tags` has them; all sums must be exact.

    `scores(places, owner)` gives the scores (step, tag, lane) of places (step, lane) in the sequences `owner`, whose
    places begin at `starts`; `trans` (sequence, from, to) are their transitions. Sequences fall into lanes that
    take a step at once. A lane begins with the sums (less the first of them) that a run over the last places before it
    ends with; where these are not those that the lane before ends with, it is run again. The way back is
    a map of the four tags for each place, and maps of a lane are joined before its last tag is known.
    """
    lane = min(LANE, max(AHEAD, int(lens.max())))
    many = -(-lens // lane)
    last = np.cumsum(many) - 1
    first = last + 1 - many
    m = int(many.sum())
    own = np.repeat(np.arange(len(lens)), many)
    begin = starts[own] + (np.arange(m) - first[own]) * lane
    size = np.full(m, lane)
    size[last] = lens - (many - 1) * lane
    grid = scores(begin + np.arange(lane)[:, None], own)
    move = np.ascontiguousarray(trans.transpose(1, 2, 0)[:, :, own])
    goes_on = np.ones(m, dtype=bool)
    goes_on[first] = False
    goes_on = np.flatnonzero(goes_on)
    before = np.zeros((4, m))
    if len(goes_on):
        now, option = grid[lane - AHEAD].copy(), np.empty((4, 4, m))
        for k in range(lane - AHEAD + 1, lane):
            np.add(now[:, None], move, out=option)
            np.maximum.reduce(option, axis=0, out=now)
            np.add(now, grid[k], out=now)
        before[:, goes_on] = (now - now[0])[:, goes_on - 1]
    sums, less = np.empty((lane, 4, m)), np.empty((lane, 3, 4, m), dtype=bool)
    todo = None
    while todo is None or len(todo):
        whole = todo is None
        g, t, now = (grid, move, before) if whole else (grid[:, :, todo], move[:, :, todo], before[:, todo])
        s, le = (sums, less) if whole else (np.empty(g.shape), np.empty((lane, 3, *t.shape[1:]), dtype=bool))
        option = np.empty(t.shape)
        for k in range(lane):
            np.add(now[:, None], t, out=option)
            now = s[k]
            np.maximum.reduce(option, axis=0, out=now)
            np.not_equal(option[:3], now, out=le[k])
            np.add(now, g[k], out=now)
            if k == 0 and whole:
                now[:, first] = g[0][:, first]
        if not whole:
            sums[:, :, todo], less[:, :, :, todo] = s, le
        end = sums[-1] - sums[-1][0]
        todo = goes_on[(before[:, goes_on] != end[:, goes_on - 1]).any(axis=0)]
        before[:, todo] = end[:, todo - 1]
    ne = less.view(np.uint8)
    back = ne[:, 0] * (1 + ne[:, 1] * (1 + ne[:, 2]))  # the first of equals
    maps = back[:, 0] | back[:, 1] << 2 | back[:, 2] << 4 | back[:, 3] << 6
    for k in np.flatnonzero(size < lane).tolist():
        maps[size[k] :, k] = _SAME
    high, path = maps.astype(np.uint16) << 8, np.full((lane, m), _SAME, dtype=np.uint8)
    for k in range(lane - 1, 0, -1):
        path[k - 1] = _AFTER[high[k] | path[k]]
    enter = _AFTER[high[0] | path[0]].tolist()
    ends = [0] * m
    for lo, hi, tag in zip(first.tolist(), last.tolist(), sums[size[last] - 1, :, last].argmax(axis=1).tolist()):
        ends[hi] = tag
        for k in range(hi, lo, -1):
            ends[k - 1] = tag = enter[k] >> 2 * tag & 3
    tags = (path >> (2 * np.array(ends, dtype=np.uint8))) & 3
    at = np.arange(int(lens.sum())) + np.repeat(first * lane - (np.cumsum(lens) - lens), lens)
    return tags.T.ravel()[at].astype(np.int8)


class Learners:
    """Models of shards on arrays, trained side by side: the next sequence of every shard is decoded with the others'.

    Weights lie by tag, shard, template and character. `held` has, for each shard, its number, its sentences
    (codes, gold) in order and, where it goes on from a part that was trained before, the state of that.
    """

    def __init__(self, first: Tagger, held: list[tuple[int, list[tuple[np.ndarray, np.ndarray]], tuple | None]]) -> None:
        template = {name: k for k, name in enumerate(TEMPLATES.values())}
        known = []
        for feature, w in first.feats.items():
            k, rest = template.get(feature[:4]), feature[4:]
            if k is not None and (rest == OUTSIDE or len(rest) == 1):
                known.append((k, GAP if rest == OUTSIDE else ord(rest), w))
        gaps = np.full(2, GAP)
        codes, golds, self.lo, self.n = [gaps], [np.zeros(2, np.int8)], [], []
        at = 2
        for _, sentences, _ in held:
            lens = [len(g) for _, g in sentences]
            self.n.append(np.array(lens, dtype=np.int64))
            self.lo.append(at + np.cumsum([0, *(x + 2 for x in lens)])[:-1].astype(np.int64))
            for c, g in sentences:
                codes += [c, gaps]
                golds += [g, gaps.astype(np.int8)]
            at += sum(lens) + 2 * len(lens)
        codes = np.concatenate([*codes, np.full(LANE + 2, GAP)])
        self.gold = np.concatenate(golds)
        met = np.zeros(GAP + 1, dtype=bool)
        met[codes] = True
        met[[c for _, c, _ in known]] = True
        for _, _, state in held:
            if state is not None:
                met[state[0]] = True
        self.names = np.flatnonzero(met)
        row = np.zeros(GAP + 1, dtype=np.int32)
        row[self.names] = np.arange(len(self.names))
        self.codes = row[codes]
        self.weights = np.zeros((4, len(held), len(TEMPLATES), len(self.names)))
        for k, c, w in known:
            self.weights[:, :, k, row[c]] = np.array(w)[:, None]
        self.trans = np.repeat(np.array(first.trans, dtype=np.float64)[None], len(held), axis=0)
        for k, (_, _, state) in enumerate(held):
            if state is not None:
                self.weights[:, k] = 0.0
                self.weights[:, k][:, :, row[state[0]]] = state[1]
                self.trans[k] = state[2]
        on_grid = all((x * GRAIN == np.rint(x * GRAIN)).all() for x in (self.weights, self.trans))
        self.most = self._most() if on_grid else np.inf

    def _most(self) -> float:
        """No score of a place, its transition included, is further from zero."""
        return len(TEMPLATES) * float(np.abs(self.weights).max(initial=0.0)) + float(np.abs(self.trans).max())

    def learn(self) -> None:
        """One pass over all sentences, of each shard in order."""
        n, lo, at = [x.tolist() for x in self.n], [x.tolist() for x in self.lo], [0] * len(self.n)
        while True:
            shard = []
            for k, mine in enumerate(n):
                end = at[k]
                while end < len(mine) and mine[end] < SHORT:
                    end += 1
                if end > at[k]:
                    self._plain(k, lo[k][at[k] : end], mine[at[k] : end])
                at[k] = end + 1
                if end < len(mine):
                    shard.append(k)
            if not shard:
                return
            self._round(np.array(shard), np.array([lo[k][at[k] - 1] for k in shard]), np.array([n[k][at[k] - 1] for k in shard]))

    def _plain(self, shard: int, lo: list[int], n: list[int]) -> None:
        """The next short sentences of a shard, one after another, on lists of the weights that they meet."""
        planes, trans, size = self.weights[:, shard].reshape(4, -1), self.trans[shard].tolist(), len(self.names)
        first, end = lo[0] - 2, lo[-1] + n[-1] + 2
        codes, gold = self.codes[first:end], self.gold[first:end].tolist()
        of = np.stack([codes[2 + d : len(codes) - 2 + d] + k * size for k, d in enumerate(TEMPLATES)], axis=1)
        met, of = np.unique(of, return_inverse=True)
        w, of = planes[:, met].T.tolist(), of.reshape(-1, len(TEMPLATES)).tolist()
        for a, m in zip(lo, n):
            if not m:
                continue
            a -= first + 2
            seen, tags, scores = of[a : a + m], gold[a + 2 : a + 2 + m], []
            for rows in seen:
                e0 = e1 = e2 = e3 = 0.0
                for r in rows:
                    x = w[r]
                    e0 += x[0]
                    e1 += x[1]
                    e2 += x[2]
                    e3 += x[3]
                scores.append((e0, e1, e2, e3))
            pred = best_tags(scores, trans)
            if pred == tags:
                continue
            for rows, g, p in zip(seen, tags, pred):
                if g != p:
                    for r in rows:
                        w[r][g] += 1.0
                        w[r][p] -= 1.0
            for i in range(1, m):
                if tags[i - 1] != pred[i - 1] or tags[i] != pred[i]:
                    trans[tags[i - 1]][tags[i]] += 1.0
                    trans[pred[i - 1]][pred[i]] -= 1.0
        planes[:, met] = np.array(w).T
        self.weights[:, shard] = planes.reshape(self.weights[:, shard].shape)
        self.trans[shard] = trans
        self.most = self._most() if self.most < np.inf else self.most

    def _scores(self, shard: np.ndarray, places: np.ndarray) -> np.ndarray:
        """(step, tag, lane) of places (step, lane)."""
        out = np.zeros((len(places), 4, places.shape[1]))
        planes, size = self.weights.reshape(4, -1), len(self.names)
        for k, d in enumerate(TEMPLATES):
            at = self.codes[places + d] + (shard * len(TEMPLATES) + k) * size
            for tag in range(4):
                out[:, tag] += planes[tag].take(at)
        return out

    def _round(self, shard: np.ndarray, lo: np.ndarray, n: np.ndarray) -> None:
        if self.most * (int(n.max()) + 1) < EXACT:
            pred = tags_by_lanes(lambda places, own: self._scores(shard[own], places), lo, n, self.trans[shard])
        else:  # sums in the order of one step after another
            pred = np.concatenate(
                [best_tags(self._scores(np.full(1, k), a + np.arange(b)[:, None])[:, :, 0].tolist(), self.trans[k].tolist()) for k, a, b in zip(shard, lo, n)]
            )
        start = np.cumsum(n) - n
        places = np.arange(int(n.sum())) + np.repeat(lo - start, n)
        gold = self.gold[places]
        off = pred != gold
        wrong = np.flatnonzero(off)
        if not len(wrong):
            return
        owner = np.repeat(shard, n)
        of, at = owner[wrong], places[wrong]
        flat, size, plane = self.weights.reshape(-1), len(self.names), self.weights[0].size
        right, other = gold[wrong].astype(np.int64) * plane, pred[wrong].astype(np.int64) * plane
        for k, d in enumerate(TEMPLATES):
            row = self.codes[at + d] + (of * len(TEMPLATES) + k) * size
            np.add.at(flat, right + row, 1.0)
            np.add.at(flat, other + row, -1.0)
        moved = off[1:] | off[:-1]
        moved[start[1:] - 1] = False  # between two sequences
        i = np.flatnonzero(moved)
        told, has = gold.astype(np.int64), pred.astype(np.int64)
        trans = self.trans.reshape(-1)
        np.add.at(trans, owner[i] * 16 + told[i] * 4 + told[i + 1], 1.0)
        np.add.at(trans, owner[i] * 16 + has[i] * 4 + has[i + 1], -1.0)
        # An update moves a score of a feature by one for each place at most.
        self.most += (len(TEMPLATES) + 1) * int(n.max())
        if self.most * (int(n.max()) + 1) >= EXACT / 64 and self.most < np.inf:
            self.most = self._most()

    def state(self, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """What the k-th shard goes on from: names, weights, transitions."""
        return self.names, self.weights[:, k].copy(), self.trans[k].copy()

    def rows(self, shards: list[int]) -> pa.RecordBatch:
        """(kind, name, tag, w) of weights other than zero, summed over the shards, and how many they are."""
        t, w = self.trans[shards].sum(axis=0), self.weights[:, shards].sum(axis=1)
        out = [("T", str(a), b, x) for a, r in enumerate(t.tolist()) for b, x in enumerate(r) if x]
        templates, show = list(TEMPLATES.values()), [OUTSIDE if c == GAP else chr(c) for c in self.names.tolist()]
        at = np.nonzero(w)
        out += [("F", templates[k] + show[r], tag, x) for tag, k, r, x in zip(*(a.tolist() for a in at), w[at].tolist())]
        return pa.RecordBatch.from_pylist([dict(zip(_ROW.names, x)) for x in [*out, ("N", "", 0, float(len(shards)))]], _ROW)


_ROW = pa.schema([("kind", pa.string()), ("name", pa.string()), ("tag", pa.int32()), ("w", pa.float64())])


def one_pass(first: Tagger, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Weights of the shards of sentences (shard, text, tags), which come shard by shard, after a pass from `first`."""
    held: list[tuple[int, list, tuple | None]] = []
    chars, seen = 0, np.zeros(GAP + 1, dtype=bool)

    def trained(ends: bool) -> Iterator[pa.RecordBatch]:
        if not held:
            return
        made = Learners(first, held)
        made.learn()
        done = list(range(len(held) if ends else len(held) - 1))
        if done:
            yield made.rows(done)
        held[:] = [] if ends else [(held[-1][0], [], made.state(len(held) - 1))]

    for batch in batches:
        shards, tags = batch.column("shard").to_numpy(), batch.column("tags")
        codes, lens = code_points(batch.column("text").to_pylist())
        gold, at = tags.flatten().to_numpy(zero_copy_only=False).astype(np.int8), 0
        for shard, n in zip(shards.tolist(), lens.tolist()):
            new = not held or held[-1][0] != shard
            if new:
                full = len(held) >= TOGETHER or (len(held) + 1) * int(seen.sum()) * len(TEMPLATES) * 32 > WEIGHT_BYTES
                if full or chars > HELD // 2:
                    yield from trained(True)
                    chars, seen = 0, np.zeros(GAP + 1, dtype=bool)
                held.append((shard, [], None))
            elif chars > HELD:
                yield from trained(False)
                chars = 0
            mine = codes[at : at + n].astype(np.int32)
            held[-1][1].append((mine, gold[at : at + n]))
            seen[mine] = True
            chars, at = chars + n, at + n
    yield from trained(True)


def shards_of(sentences: DataFrame) -> int:
    """Shards for the data at hand, whatever the machine: one for each SHARD_CHARS characters."""
    chars = sentences.agg(F.sum(F.size("chars").cast("long"))).first()[0] or 0
    return max(1, -(-chars // SHARD_CHARS))


def mixed(total: float, shards: float) -> float:
    """The mean of a weight over the shards, on the grid of GRAIN."""
    return round(total / shards * GRAIN) / GRAIN


def train_tagger(
    sentences: DataFrame, epochs: int = EPOCHS, shards: int | None = 1, order: str = "ord", start: tuple[int, Tagger] | None = None,
    told: Callable[[int, Tagger], None] | None = None,
) -> Tagger:
    """Weights after `epochs` passes over sentences (chars, tags, `order`).

    One shard is the sequential perceptron in `order` (then by the text). With more (`None`: by the size of the data), every
    shard passes over its own sentences from the mixed weights and the shards' weights are averaged after
    each epoch (iterative parameter mixing): another estimate, which converges as well. Which shard a sentence
    goes to, its place there and the mean depend on the data alone, so cores and partitions change no weight.
    A task holds the models and sentences of a few shards (`TOGETHER`, `HELD`); of a large one, a part after another.

    `told` is called with the number of each epoch that is done and its weights; `start` gives both back to
    a run that goes on behind them.
    """
    shards = shards_of(sentences) if shards is None else shards
    rows = sentences.select(
        F.array_join("chars", "").alias("text"), F.col("tags").cast("array<tinyint>").alias("tags"), F.col(order).alias("o"),
        F.pmod(F.xxhash64(order), F.lit(shards)).cast("int").alias("shard"),
    )
    # By range, as numbers that are hashed would meet in some tasks and leave others empty. A task takes several shards.
    cores = sentences.sparkSession.sparkContext.defaultParallelism
    tasks = min(shards, max(-(-shards // TOGETHER), 2 * cores))
    rows = rows.repartitionByRange(tasks, "shard").sortWithinPartitions("shard", "o", "text").persist()
    done, model = start or (0, Tagger())
    try:
        for epoch in range(done + 1, epochs + 1):
            shared = sentences.sparkSession.sparkContext.broadcast(model.weights())

            def epoch_pass(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
                return one_pass(Tagger(*shared.value), batches)

            told_rows = rows.select("shard", "text", "tags").mapInArrow(epoch_pass, "kind string, name string, tag int, w double")
            sums = told_rows.groupBy("kind", "name", "tag").agg(F.sum("w").alias("w"))
            got = sums.toPandas()  # the model, which the alphabet bounds
            shared.unpersist()
            n = float(got.loc[got["kind"] == "N", "w"].sum()) or 1.0
            model = Tagger()
            for kind, name, tag, w in got.itertuples(index=False):
                if kind == "T":
                    model.trans[int(name)][tag] = mixed(w, n)
                elif kind == "F":
                    model.feats.setdefault(name, [0.0] * 4)[tag] = mixed(w, n)
            if told is not None:
                told(epoch, model)
    finally:
        rows.unpersist()
    return model


def model_tables(session, model: Tagger) -> tuple[DataFrame, DataFrame]:
    """Transitions and features of a model as tables, zeros left out."""
    trans = [(a, b, w) for a, r in enumerate(model.trans) for b, w in enumerate(r) if w]
    feats = [(f, tag, w) for f, ws in model.feats.items() for tag, w in enumerate(ws) if w]
    return (
        session.createDataFrame(trans, "from_tag int, to_tag int, weight double"),
        session.createDataFrame(feats, "feature string, tag int, weight double"),
    )
