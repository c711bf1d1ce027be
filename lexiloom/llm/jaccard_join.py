r"""Exact Jaccard join on word shingles in metric space: pivots, Voronoi regions, windows.

The Jaccard distance d = 1 - J is a metric; documents link when d <= EPS = 1/4.

1. Regions. A document shows the first 36 % of its shingles in hash order. The least document
   that shows a shingle is the shingle's pivot, and a document may be near a pivot only if it
   shows one of the pivot's shingles. Two linked documents share at least `_need` shown shingles,
   so documents that share fewer drop out, and a document enters the regions of its pivots in a
   global order (heaviest share first) only until what is left could not hold a link (the weighted
   prefix bound), and only where another member is of about its size. Every linked pair shares a region; passages that many texts quote do not open one.
2. Small regions are joined exactly in place: the pivot's distances give the triangle windows
   |d(x, p) - d(y, p)| <= EPS, pairs inside a window are verified on whole shingle sets, pairs
   already connected are passed over.
3. Large regions get `PIVOTS` pivots of their own: members drawn by hash and the one that is nearest
   to those on average, to which most copies of one text link. A member within EPS of a pivot links to
   it; each member goes to the cell of its nearest pivot and is replicated to every cell within the
   window d_j <= d_min + 2 EPS; cells whose members all hang together need no pairs; the others join
   recursively, and what is too dense for that
   (members copied more than `SPREAD` times, or large after `DEPTH` rounds) is joined exactly in blocks, where only
   members outside the main body are compared with all others.
4. Links between distinct sets, together with membership of equal sets, give the components.

Sets are 64-bit shingle hashes; equal sets (copies) are one node, identified by a 128-bit digest, and one
row of them is read for the join. Cells of hot shingles are pre-aggregated instead of gathered. Which documents read their whole set
is decided by a Bloom filter of bounded size (`common.BLOOM_BITS`).

Defined results: null, empty or blank texts have no shingles, link with nothing and form their own
class; texts of fewer than five words are one shingle; rows that repeat an id share the least id of
their classes; no rows in, no rows out; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window
from pyspark.storagelevel import StorageLevel

from lexiloom.llm.common import BROADCAST_ROWS, discard, documents, key_filter, small_batches, stage
from lexiloom.llm.components import connected_components
from lexiloom.llm.shingles import overlap, set_digest, shingle_set

EPS = 0.25
NUM, DEN = 3, 4  # J >= NUM / DEN
SHOWN = 36  # per cent of a set's shingles, in hash order
CAP_MEMBERS = 1024
ROWS = 256
SLICE = 4096
SPREAD = 2.5
CAP_SHINGLES = 4_000_000
CALL_SHINGLES = 1_000_000
#: Classes of set sizes between sizes that may just link.
SIZE_STEPS = 4
PIVOTS = 8
DEPTH = 4
PLACED_ROWS = 2 * BROADCAST_ROWS
HOT_SHARE = 0.005
SALTED_ROWS = 20_000
BLOCK_MEMBERS = 2048
#: Pivot sets of so many shingles in all are broadcast to the members.
PIVOT_SHINGLES = 4_000_000
_SEEN = 50_000


def linked(common, a, b):
    """Whether sets of a and b shingles with so many in common link; numbers or arrays."""
    return DEN * common >= NUM * (a + b - common)


def _shown(n: Column) -> Column:
    return F.least(n, F.floor((n * SHOWN + 99) / 100) + 2)


def _need(n: Column) -> Column:
    """Shown shingles that a document of `n` shares with any linked one, at least.

    A partner has m = ceil(3n/4) shingles or more. Of two linked sets, the one whose shown range
    ends first has its shown shingles in the other but for floor(n/4), and the other shows those.
    """
    m = F.floor((n * NUM + DEN - 1) / DEN)
    return F.least(m, F.floor(m * (SHOWN - 25) / 100) + 2)


def _node(digest: str) -> int:
    return int(digest[:15], 16)


def fingerprints(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, th (hash of the text), row (hash of id and text), n, digest, node and the shown shingles of every row.


    A task shows the shingles of equal sets once; the others carry null. Of a shown shingle the first 48
    bits are kept, in two lists: they tell cells apart, and two shingles in one cell only let a candidate
    more pass.
    """

    @F.pandas_udf("struct<n: long, digest: string, node: long, shown: array<int>, shown2: array<short>>")
    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        seen: set[int] = set()
        for texts in batches:
            out = []
            for t in texts:
                s = shingle_set(t)
                n, d = len(s), set_digest(s)
                k, node = min(n, (n * SHOWN + 99) // 100 + 2), _node(d)
                if n and node not in seen:
                    out.append((n, d, node, (s[:k] >> np.uint64(32)).astype(np.uint32).view(np.int32), (s[:k] >> np.uint64(16)).astype(np.uint16).view(np.int16)))
                else:
                    out.append((n, d, node, None, None))
                if len(seen) < _SEEN:
                    seen.add(node)
            yield pd.DataFrame(out, columns=["n", "digest", "node", "shown", "shown2"])

    return docs.select(
        F.col(id_col).alias("id"), F.xxhash64(text_col).alias("th"), _row(id_col, text_col).alias("row"), scan(F.col(text_col)).alias("f")
    ).select("id", "th", "row", "f.*")


def _row(id_col: str, text_col: str) -> Column:
    return F.xxhash64(F.xxhash64(text_col), F.col(id_col))


def _cells(prints: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node, pivot, c): shown shingles of the node whose cell has the pivot and a second member; and
    the staged table that this reads."""
    shown = prints.filter("shown IS NOT NULL")
    sample = shown.filter(F.pmod(F.xxhash64("digest", "id"), F.lit(64)) == 0)
    docs = sample.count()
    token = (F.col("t.shown").cast("long") * 65536 + F.col("t.shown2").cast("long")).alias("token")
    each = F.explode(F.arrays_zip("shown", "shown2")).alias("t")
    tokens = shown.select("node", each).select("node", token)
    hot = (
        sample.select(each).select(token).groupBy("token").agg(F.count("*").alias("c"))
        .filter(F.col("c") >= max(32, int(HOT_SHARE * docs))).select("token")
    )  # at most (shown shingles of a document) / HOT_SHARE rows
    # Hot cells are told in parts of about SALTED_ROWS, so that no task takes one whole; their least member
    # follows from the parts. Left joins let every token pass once, whether hot or not.
    salts = max(64, 64 * docs // SALTED_ROWS)
    marked = tokens.join(F.broadcast(hot.withColumn("is_hot", F.lit(True))), "token", "left")
    part = Window.partitionBy("token", F.when(F.col("is_hot"), F.pmod("node", F.lit(salts))).otherwise(0))
    told = marked.select(
        "node", F.when(F.col("is_hot"), F.col("token")).alias("hot"), F.min("node").over(part).alias("lo"),
        F.max("node").over(part).alias("hi"),
    ).filter("lo <> hi OR hot IS NOT NULL").withColumn("hi", F.when(F.col("hot").isNotNull(), F.col("hi")))
    told = stage(told, "jaccard-told-cells")
    ends = told.filter("hot IS NOT NULL").groupBy("hot").agg(F.min("lo").alias("least"), F.max("hi").alias("most"))
    rows = told.join(F.broadcast(ends), "hot", "left").select(
        "node", F.coalesce("least", "lo").alias("pivot"), (F.col("hot").isNull() | (F.col("least") < F.col("most"))).alias("two")
    )
    return rows.filter("two").groupBy("node", "pivot").agg(F.count("*").alias("c")), told


def _regions(prints: DataFrame) -> DataFrame:
    """(node, pivot, n): the regions a node enters, those with two members at least."""
    per = prints.filter("shown IS NOT NULL").groupBy("node").agg(F.count("*").alias("m"), F.max("n").alias("n"))
    mine = Window.partitionBy("node")
    cells, told = _cells(prints)
    near = (
        cells.join(per, "node").select("node", "pivot", "n", (F.col("c") / F.col("m")).alias("c"))
        .withColumn("all", F.sum("c").over(mine)).filter(F.col("all") >= _need(F.col("n")) - 1e-9).drop("all")
    )
    near = stage(near, "jaccard-cells")
    discard(told)
    order = near.groupBy("pivot").agg(F.avg(F.col("c") / _shown(F.col("n"))).alias("score"), F.count("*").alias("members"))
    order = stage(order.filter("members > 1"), "jaccard-pivots")
    # Weight of pivots without a second member, and of shingles without one, counts as kept.
    first = mine.orderBy(F.desc("score"), "pivot").rowsBetween(Window.unboundedPreceding, -1)
    held = near.join(order, "pivot").withColumns(
        {"before": F.coalesce(F.sum("c").over(first), F.lit(0.0)), "inside": F.sum("c").over(mine)}
    )
    kept = held.filter(F.col("before") < F.col("inside") - _need(F.col("n")) + 1 - 1e-9)
    kept = stage(kept.select("node", "pivot", "n"), "jaccard-kept")
    # Linked sets differ in size by a third at most: a member without another of about its size in the region goes.
    size = F.floor(F.log(F.col("n").cast("double")) * (SIZE_STEPS / math.log(DEN / NUM))).cast("int")
    kept = kept.withColumn("size", size)
    around = F.explode(F.sequence(F.col("size") - SIZE_STEPS - 1, F.col("size") + SIZE_STEPS + 1)).alias("size")
    live = stage(
        kept.groupBy("pivot", "size").agg(F.count("*").alias("c")).select("pivot", around, "c")
        .groupBy("pivot", "size").agg(F.sum("c").alias("c")).filter("c > 1").select("pivot", "size"),
        "jaccard-live",
    )
    regions = stage(kept.join(_few(live), ["pivot", "size"]).drop("size"), "jaccard-regions")
    discard(near, order, kept, live)
    return regions


def _whole_sets(docs: DataFrame, id_col: str, text_col: str, prints: DataFrame, regions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members (region, row, digest, n), `row` being the one row that stands for a set, and the sets
    (row, shingles) of those rows, read from the texts when they are asked for."""
    one = prints.filter("n > 0").groupBy("node", "digest").agg(F.min("row").alias("row"))
    members = stage(
        regions.join(one, "node").select(F.col("pivot").cast("string").alias("region"), "row", "digest", "n"), "jaccard-members"
    )
    wanted = stage(members.select("row").distinct(), "jaccard-wanted")
    may_hold = key_filter(wanted, "row")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            hit = may_hold(pdf["row"].to_numpy())  # lets a few more pass
            yield pd.DataFrame({"row": pdf["row"][hit], "shingles": [shingle_set(t).tobytes() for t in pdf["text"][hit]]})

    rows = docs.select(_row(id_col, text_col).alias("row"), F.col(text_col).alias("text"))
    sets = rows.mapInPandas(read, "row long, shingles binary")
    again = prints.groupBy("row").agg(F.count("*").alias("c")).filter("c > 1").join(wanted, "row", "left_semi")
    return members, sets if again.isEmpty() else once_each(sets)


def once_each(sets: DataFrame) -> DataFrame:
    """(row, shingles), each row once; partial aggregates keep one a task."""
    return sets.groupBy("row").agg(F.first("shingles").alias("shingles"))


def _few(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """To be broadcast if it has at most so many (narrow) rows; a written table."""
    return F.broadcast(df) if df.count() <= most else df


class _Union:
    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> None:
        self.up[self.find(i)] = self.find(j)


def overlaps(rows: list[np.ndarray], cols: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections, by products of incidence matrices over slices of shared shingles."""
    left, right = np.concatenate(rows), np.concatenate(cols)
    shared = np.intersect1d(left, right)
    out = np.zeros((len(rows), len(cols)), dtype=np.float32)
    if not len(shared):
        return out.astype(np.int64)

    def places(values: np.ndarray, sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
        at = np.searchsorted(shared, values)
        at[at == len(shared)] = 0
        held = shared[at] == values
        order = np.argsort(at[held], kind="stable")
        return at[held][order], owner[held][order]

    (la, lo), (ra, ro) = places(left, rows), places(right, cols)
    for lo_at in range(0, len(shared), SLICE):
        a = np.zeros((len(rows), SLICE), dtype=np.float32)
        b = np.zeros((len(cols), SLICE), dtype=np.float32)
        i, j = np.searchsorted(la, [lo_at, lo_at + SLICE])
        a[lo[i:j], la[i:j] - lo_at] = 1
        i, j = np.searchsorted(ra, [lo_at, lo_at + SLICE])
        b[ro[i:j], ra[i:j] - lo_at] = 1
        out += a @ b.T  # exact: sums of less than 2 ** 24 ones
    return np.rint(out).astype(np.int64)


def join_members(sets: list[np.ndarray], labels: list[int], main: int | None = None) -> list[tuple[int, int]]:
    """Links (i, j) that connect exactly what the links among all members connect.

    Members of one label >= 0 are known to be connected. `main` names a label whose members are
    compared with the others only.
    """
    n = len(sets)
    if n < 2:
        return []
    if n == 2:
        near = linked(overlap(sets[0], sets[1]), len(sets[0]), len(sets[1]))
        return [(0, 1)] if near and (labels[0] < 0 or labels[0] != labels[1]) else []
    size = np.array([len(s) for s in sets])
    c = np.array([overlap(s, sets[0]) for s in sets])
    far = 1.0 - c / np.maximum(1, size + size[0] - c)  # distances to the pivot
    order = np.argsort(far, kind="stable")
    label = np.array(labels)
    body = np.arange(n)
    for k in set(labels) - {-1}:
        body[label == k] = np.flatnonzero(label == k)[0]
    links = []
    far_in_order = far[order]
    for lo in range(0, n, ROWS):
        rows = order[lo : lo + ROWS]
        # The triangle window: nothing beyond it can link with a row of this strip.
        hi = int(np.searchsorted(far_in_order, far_in_order[min(n, lo + ROWS) - 1] + EPS + 1e-9, side="right"))
        cols = order[lo:hi]
        if main is not None and (label[rows] == main).all():
            cols = cols[label[cols] != main]
        if not len(cols):
            continue
        if len(rows) * len(cols) <= 64:
            common = np.array([[overlap(sets[i], sets[j]) for j in cols] for i in rows])
        else:
            common = overlaps([sets[i] for i in rows], [sets[j] for j in cols])
        near = linked(common, size[rows][:, None], size[cols][None, :])
        for i, hit in zip(rows, near):
            js = cols[hit]
            for b in np.unique(body[js]):
                if b != body[i]:
                    j = js[body[js] == b][0]
                    links.append((int(i), int(j)))
                    body[body == b] = body[i]
    return links


def _decode(column) -> list[np.ndarray]:
    return [np.frombuffer(b, dtype=np.uint64) for b in column]


def _calls(regions: DataFrame) -> DataFrame:
    """(keys of a region, weight) and the call that joins it.

    Light regions share a call, heavy ones have their own; no call takes more than a large region.
    """
    total = regions.agg(F.sum("weight")).first()[0] or 0
    calls = max(1, total // CALL_SHINGLES)
    return regions.withColumn(
        "call",
        F.when(F.col("weight") > CALL_SHINGLES // 4, F.col("group")).otherwise(
            F.pmod(F.xxhash64("group"), F.lit(calls)).cast("string")
        ),
    )


def _join_calls(members: DataFrame) -> DataFrame:
    """Links of each group of (call, group, digest, shingles, label, main)."""

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["group", "digest"], ignore_index=True)
        group, digest = pdf["group"].to_numpy(), pdf["digest"].to_numpy()
        new = np.append(True, (group[1:] != group[:-1]) | (digest[1:] != digest[:-1]))  # a set may come more than once
        at = np.flatnonzero(new)
        cut = np.append(np.flatnonzero(np.append(True, group[at][1:] != group[at][:-1])), len(at))
        sets, label, main = pdf["shingles"].to_numpy(), pdf["label"].to_numpy(), pdf["main"].to_numpy()
        out = []
        for lo, hi in zip(cut[:-1], cut[1:]):
            if hi - lo > 1:
                rows = at[lo:hi]
                links = join_members(_decode(sets[rows]), label[rows].tolist(), main[rows[0]] if main[rows[0]] >= 0 else None)
                out += [(digest[rows[i]], digest[rows[j]]) for i, j in links]
        return pd.DataFrame(out, columns=["a", "b"])

    columns = ["call", "group", "digest", "shingles", "label", "main"]
    return members.select(*columns).groupBy("call").applyInPandas(join, "a string, b string")


def _join_groups(members: DataFrame, keys: list[str]) -> DataFrame:
    """Links of each group, by `keys`, of (digest, n, shingles, label, main)."""
    weights = members.groupBy(*keys).agg(F.sum("n").alias("weight"))
    weights = stage(weights.withColumn("group", F.concat_ws("/", *keys)), "jaccard-weights")
    calls = _calls(weights)
    return _join_calls(members.join(F.broadcast(calls) if weights.count() <= BROADCAST_ROWS else calls, keys))


def _pivot_sets(members: DataFrame, picks: DataFrame) -> DataFrame:
    """(region, pivots): the picked members (region, digest) as an array of (j, digest, shingles), to be
    broadcast if they are small; PIVOTS entries a region."""
    numbered = Window.partitionBy("region").orderBy("digest")
    pivots = (
        members.select("region", "digest", "n", "shingles").join(_few(stage(picks, "jaccard-picks")), ["region", "digest"])
        .withColumn("j", F.row_number().over(numbered) - 1)
        .groupBy("region").agg(F.array_sort(F.collect_list(F.struct("j", "digest", "shingles"))).alias("pivots"), F.sum("n").alias("size"))
    )
    pivots = stage(pivots, "jaccard-pivot-sets")
    total = pivots.agg(F.sum("size")).first()[0] or 0
    return F.broadcast(pivots.drop("size")) if total <= PIVOT_SHINGLES else pivots.drop("size")


def _drawn(members: DataFrame, depth: int) -> DataFrame:
    """(region, digest) of up to PIVOTS - 1 members of each region, drawn by hash."""
    draw = lambda j: F.min(F.struct(F.xxhash64("digest", F.lit(depth * PIVOTS + j)).alias("h"), "digest"))["digest"]
    picks = members.groupBy("region").agg(F.array_distinct(F.array(*[draw(j) for j in range(PIVOTS - 1)])).alias("digests"))
    return picks.select("region", F.explode("digests").alias("digest"))


def _distances(s: np.ndarray, pivots: list[np.ndarray]) -> tuple[list[int], list[float]]:
    common = [overlap(s, q) for q in pivots]
    return common, [1.0 - c / max(1, len(s) + len(q) - c) for c, q in zip(common, pivots)]


def _central(members: DataFrame, drawn: DataFrame) -> DataFrame:
    """(region, digest) of the member that is nearest to the drawn ones on average."""

    def far(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            mean = [sum(_distances(s, _decode(p["shingles"] for p in ps))[1]) for s, ps in zip(_decode(pdf["shingles"]), pdf["pivots"])]
            yield pdf[["region", "digest"]].assign(far=mean)

    rows = members.select("region", "digest", "shingles").join(_pivot_sets(members, drawn), "region", "left").mapInPandas(
        far, "region string, digest string, far double"
    )
    return rows.groupBy("region").agg(F.min(F.struct("far", "digest"))["digest"].alias("digest"))


def _split(members: DataFrame, depth: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One round over large regions (region, digest, n, shingles): links to pivots, cells left,
    and regions so dense that their windows would copy a member `SPREAD` times."""
    drawn = stage(_drawn(members, depth), "jaccard-drawn")
    pivots = _pivot_sets(members, drawn.union(_central(members, drawn)).distinct())

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            masks, links, cells = [], [], []
            for s, ps in zip(_decode(pdf["shingles"]), pdf["pivots"]):
                mask, to, sets = 0, [], _decode(p["shingles"] for p in ps)
                common, ds = _distances(s, sets)
                for p, q, c in zip(ps, sets, common):
                    if linked(c, len(s), len(q)):
                        mask |= 1 << p["j"]
                        to.append(p["digest"])
                least = min(ds)
                cells.append([p["j"] for p, x in zip(ps, ds) if x <= least + 2 * EPS + 1e-9])
                masks.append(mask)
                links.append(to)
            yield pdf[["region", "digest", "n", "shingles"]].assign(mask=masks, links=links, cells=cells)

    # Left, so that the many members of a region are the side that a skewed join splits.
    seen = stage(
        members.select("region", "digest", "n", "shingles").join(pivots, "region", "left").mapInPandas(
            measure, "region string, digest string, n long, shingles binary, mask long, links array<string>, cells array<int>"
        ),
        "jaccard-measured",
    )
    links = seen.select(F.col("digest").alias("a"), F.explode("links").alias("b")).filter("a <> b")

    def bodies(pdf: pd.DataFrame) -> pd.DataFrame:
        u = _Union(PIVOTS)
        masks = [int(m) for m in pdf["mask"]]
        for m in masks:
            on = [j for j in range(PIVOTS) if m >> j & 1]
            for j in on[1:]:
                u.join(on[0], j)
        label = [u.find((m & -m).bit_length() - 1) if m else -1 for m in masks]
        return pd.DataFrame({"region": pdf["region"], "mask": masks, "label": label})

    kinds = seen.select("region", "mask").distinct().groupBy("region").applyInPandas(bodies, "region string, mask long, label int")
    told = seen.join(_few(stage(kinds, "jaccard-bodies")), ["region", "mask"]).drop("mask", "links")
    states = told.groupBy("region").agg(
        F.min("label").alias("lo"), F.max("label").alias("hi"), F.avg(F.size("cells")).alias("spread")
    ).filter("lo < 0 OR lo <> hi")
    states = stage(states.select("region", (F.col("spread") > SPREAD).alias("stuck")), "jaccard-states")
    told = told.join(_few(states), "region")
    stuck = told.filter("stuck").drop("stuck", "cells")
    placed = told.filter("NOT stuck").withColumn("cell", F.explode("cells"))
    placed = stage(
        placed.select(F.concat_ws(".", "region", "cell").alias("region"), "digest", "n", "shingles", "label"), "jaccard-placed"
    )
    open_ = placed.groupBy("region").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("c")).filter(
        "c > 1 AND (lo < 0 OR lo <> hi)"
    )
    left = stage(placed.join(_few(stage(open_.select("region"), "jaccard-open")), "region"), "jaccard-left")
    return links, left, stage(stuck, "jaccard-stuck")


def _sized(members: DataFrame) -> DataFrame:
    sizes = members.groupBy("region").agg(F.count("*").alias("members"), F.sum("n").alias("weight"))
    return stage(
        sizes.select("region", ((F.col("members") > CAP_MEMBERS) | (F.col("weight") > CAP_SHINGLES)).alias("large")),
        "jaccard-sizes",
    )


def _blocks(members: DataFrame) -> DataFrame:
    """Dense regions in pairs of blocks: members outside the main body against all others."""
    sizes = members.groupBy("region", "label").agg(F.count("*").alias("c"), F.sum("n").alias("w"))
    body = sizes.filter("label >= 0").groupBy("region").agg(F.max(F.struct("c", "label"))["label"].alias("main"))
    counts = sizes.groupBy("region").agg(F.sum("c").alias("all"), F.sum("w").alias("all_w"))
    plan = counts.join(body, "region", "left").withColumn("main", F.coalesce("main", F.lit(-2)))
    minor = sizes.join(plan.select("region", "main"), "region").filter("label <> main").groupBy("region").agg(
        F.sum("c").alias("minor"), F.sum("w").alias("minor_w")
    )
    blocks = lambda c, w: F.greatest(F.ceil(F.col(c) / BLOCK_MEMBERS), F.ceil(F.col(w) / (CAP_SHINGLES // 2)))
    plan = plan.join(minor, "region").select("region", "main", blocks("minor", "minor_w").alias("nb"), blocks("all", "all_w").alias("na"))
    m = members.join(_few(stage(plan, "jaccard-plan")), "region").withColumn("h", F.xxhash64("digest"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = m.filter("main >= 0 AND label <> main").withColumn("x", F.pmod("h", "nb")).withColumn("y", every("na"))
    right = m.filter("main >= 0").withColumn("y", F.pmod("h", "na")).withColumn("x", every("nb"))
    # Without a main body all are compared with all: each pair of blocks once.
    alike = m.filter("main < 0").withColumn("b", F.pmod("h", "na")).withColumn("o", every("na"))
    alike = alike.withColumn("x", F.least("b", "o")).withColumn("y", F.greatest("b", "o"))
    cols = ["region", "x", "y", "digest", "n", "shingles", "label", "main"]
    return left.select(*cols).union(right.select(*cols)).union(alike.select(*cols))


def join_regions(members: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) between digests that connect exactly what links inside the regions connect.

    `members` (region string, row, digest, n: size of its set) is a written table, distinct, and `sets`
    (row, shingles) has each row once. Where members go is settled on the narrow table; a set moves to
    its regions in one shuffle.
    """
    sizes = members.groupBy("region").agg(F.count("*").alias("members"), F.sum("n").alias("weight"))
    sizes = sizes.withColumn("large", (F.col("members") > CAP_MEMBERS) | (F.col("weight") > CAP_SHINGLES))
    sizes = stage(sizes.select("region", F.col("region").alias("group"), "weight", "large"), "jaccard-sizes")
    placed = stage(members.join(_calls(sizes), "region"), "jaccard-calls")
    small, large = placed.filter("NOT large").select("row", "digest", "group", "call"), placed.filter("large").select("row", "digest", "n", "region")
    # Narrow rows in a counted number go to the sets, which then need no shuffle to meet their regions.
    small, large = ((F.broadcast(df) if df.count() <= PLACED_ROWS else df) for df in (small, large))
    small = sets.join(small, "row").withColumn("label", F.lit(-1)).withColumn("main", F.lit(-1))
    found = [stage(_join_calls(small), "jaccard-links")]
    any_large = not sizes.filter("large").isEmpty()
    if any_large:
        # Few against all rows: dealt anew, so that they make a few files.
        large = sets.join(large, "row").select("region", "digest", "n", "shingles").repartition("digest")
        large = stage(large.withColumn("label", F.lit(-1)), "jaccard-large")
    discard(sizes, placed)
    if not any_large:
        return found[0]
    for depth in range(DEPTH):
        links, left, stuck = _split(large, depth)
        flagged = left.join(_few(_sized(left)), "region")
        new = [links, _join_groups(flagged.filter("NOT large").withColumn("main", F.lit(-1)), ["region"])]
        before, large = large, stage(flagged.filter("large").drop("large"), "jaccard-large")
        last = large.isEmpty() or depth == DEPTH - 1
        dense = stuck.union(large.select(stuck.columns)) if last else stuck
        if not dense.isEmpty():
            new.append(_join_groups(_blocks(dense), ["region", "x", "y"]))
        found += [stage(df, "jaccard-links") for df in new]
        discard(before, left, stuck)
        if last:
            break
    out = found[0]
    for df in found[1:]:
        out = out.union(df)
    return out


def links_of(docs: DataFrame, prints: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Links (a, b) between digests that connect exactly the documents that link."""
    regions = _regions(prints)
    # Nodes are 60 bits of the digest; the digests tell sets apart from here on.
    members, sets = _whole_sets(docs, id_col, text_col, prints, regions)
    discard(regions)
    links = join_regions(members, sets)
    discard(members)
    return links


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_shingles, component_id (least id reachable), digest, th (hash of the
    text) and class_key (digest that names the component).

    The prints are one narrow step from the input; executors keep them on disk, and what a lost one had
    is made again from its part of the input.
    """
    small_batches(docs.sparkSession)
    prints = fingerprints(docs, id_col, text_col).persist(StorageLevel.DISK_ONLY)
    links = links_of(docs, prints, id_col, text_col)
    comps = connected_components(links)
    rows = prints.select("id", "th", "n", "digest")
    keyed = rows.join(_few(comps), rows["digest"] == comps["node"], "left").select(
        "id", "th", "n", "digest", F.coalesce("component", "digest").alias("class_key")
    )
    keyed = stage(keyed, "jaccard-keyed")
    prints.unpersist()
    discard(comps)
    least = keyed.filter("n > 0").groupBy("class_key").agg(F.min("id").alias("least"), F.count("*").alias("c")).filter("c > 1")
    return keyed.join(_few(stage(least, "jaccard-least")), "class_key", "left").select(
        "id", F.col("n").alias("n_shingles"), F.coalesce("least", "id").alias("component_id"), "digest", "th", "class_key",
    )


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = jaccard_components(documents(spark, sf_dir))
    return out.select(F.col("id").alias("doc_id"), "n_shingles", "component_id")


OP2_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, hash(array_to_string(w[i : i + 4], ' ')) AS t
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c
  FROM s a JOIN s b ON a.t = b.t AND a.doc_id < b.doc_id GROUP BY 1, 2
), e AS (
  SELECT x, y FROM c JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y
  WHERE 100 * c >= 75 * (nx.n + ny.n - c)
), g AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
r AS (
  SELECT doc_id AS v, doc_id AS u FROM n
  UNION
  SELECT r.v, g.y FROM r JOIN g ON g.x = r.u
)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(m.u, d.doc_id) AS component_id
FROM d LEFT JOIN n ON n.doc_id = d.doc_id
LEFT JOIN (SELECT v, min(u) AS u FROM r GROUP BY v) m ON m.v = d.doc_id
"""
