r"""Approximate nearest neighbours by multi-index hashing of learned rotated binary codes.

1. Codes. Unit vectors less their mean are rotated and each coordinate gives its sign; the rotations are learned on a
   sample (iterative quantisation: rotate, take signs, turn the rotation to meet them), as many as `BITS` bits take.
2. Radius. Pairs of sample vectors, one turned towards another by a known angle, tell the Hamming radius that holds
   a vector of a given cosine in `SURE` of 100 cases. A query's k-th best cosine within the sample is a lower
   bound of its true one, so the radius of that cosine is the query's radius; it is never so small that it
   holds fewer than k codes of the sample.
3. Index. All vectors are dealt to shards by a hash of their row, so copies and dense regions spread evenly. A shard has a
   posting list for each value of each substring of 8 bits.
4. Probing. Within radius r = m * a + e (m substrings) a code agrees up to a bits in one of the first e + 1
   substrings or up to a - 1 in one of the others (pigeonhole), so the lists of these values hold every code
   within r. Codes that they give are compared whole; the cosine of those within r is taken on the original
   vectors in double precision.
5. Each shard returns k rows a query, a window the best k of all.

Queries and shards meet in blocks of at most `SHARD` vectors and `QUERIES` queries, so a task's memory is bounded
and no pair leaves it. Only the fit uses the sample (at most `SAMPLE` vectors, the least hashes); every vector
is indexed and may be found.

Defined results: a vector that is null, zero, or holds a null or non-finite component, a row without
an id, and a vector of another length than most have take no part; rows that repeat an id are vectors of their own
(a query leaves out its own row only), repeated queries have ranks of their own; of equal cosines the smaller id comes
first; fewer than k candidates are all returned. No rows in, no rows out; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexiloom.llm.common import discard, small_batches, stage, table

NEAREST = 5
EVERY = 50
BITS = 128
SUB_BITS = 8
SAMPLE = 2048
SURE = 97
ROUNDS = 20
SHARD = 1 << 18
QUERIES = 1 << 14
#: Tasks that a small table is dealt to for each core.
TASKS = 1
_POPULATION = np.bitwise_count(np.arange(256, dtype=np.uint8))
#: Values of a substring that differ in at most so many bits from 0.
_WITHIN = [np.flatnonzero(_POPULATION <= a).astype(np.uint8) for a in range(SUB_BITS + 1)]


def _matrix(column) -> np.ndarray:
    """A column of lists of one length as rows of doubles."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy().astype(np.float64).reshape(len(column), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


class Coder:
    """Binary codes of vectors, and the radius that a cosine needs; learned on rows of unit vectors."""

    def __init__(self, units: np.ndarray, bits: int = BITS, seed: int = 0):
        rng = np.random.default_rng(seed)
        self.mean = units.mean(axis=0)
        x = units - self.mean
        wide = min(x.shape[1], bits)
        axes = np.linalg.svd(x, full_matrices=True)[2][:wide].T
        y, turns = x @ axes, []
        for _ in range(-(-bits // wide)):
            turn = np.linalg.qr(rng.normal(size=(wide, wide)))[0]
            for _ in range(ROUNDS):
                u, _, v = np.linalg.svd(np.where(y @ turn >= 0, 1.0, -1.0).T @ y)
                turn = (u @ v).T
            turns.append(axes @ turn)
        self.turn = np.concatenate(turns, axis=1)[:, :bits]
        self._calibrate(units, rng)

    def codes(self, units: np.ndarray) -> np.ndarray:
        """Rows of bytes, a substring each."""
        return np.packbits((units - self.mean) @ self.turn >= 0, axis=1)

    def _calibrate(self, units: np.ndarray, rng: np.random.Generator) -> None:
        """Radii by cosine: vectors turned towards others by the cosine's angle."""
        self.levels = np.linspace(-1, 1, 81)
        bits = self.turn.shape[1]
        self.radii = np.full(len(self.levels), bits)
        a, b = (units[rng.integers(0, len(units), 2000)] for _ in range(2))
        aside = b - (a * b).sum(axis=1, keepdims=True) * a
        some = (aside * aside).sum(axis=1) > 1e-12
        if not some.any():
            return
        a, aside = a[some], _unit(aside[some])
        own = self.codes(a)
        for k, c in enumerate(self.levels):
            apart = np.bitwise_count(own ^ self.codes(c * a + np.sqrt(1 - c * c) * aside)).sum(axis=1)
            self.radii[k] = int(np.ceil(np.percentile(apart, SURE)))
        self.radii = np.maximum.accumulate(self.radii[::-1])[::-1]

    def radius(self, cosine: np.ndarray) -> np.ndarray:
        at = np.clip(np.searchsorted(self.levels, cosine, side="right") - 1, 0, len(self.levels) - 1)
        return self.radii[at]


class Index:
    """Posting lists of a shard: rows by the value of each substring."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        self.order = [np.argsort(c, kind="stable") for c in codes.T]
        self.first = [np.searchsorted(c[o], np.arange(257)) for c, o in zip(codes.T, self.order, strict=True)]

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """Rows whose code is within `radius` of `code`."""
        m = len(self.order)
        most, extra = divmod(min(int(radius), m * SUB_BITS), m)
        hit = np.zeros(len(self.codes), bool)
        for j in range(m):
            a = most if j <= extra else most - 1
            if a < 0:
                continue
            values = code[j] ^ _WITHIN[min(a, SUB_BITS)]
            starts = self.first[j][values]
            sizes = self.first[j][values.astype(np.int64) + 1] - starts
            at = np.arange(sizes.sum()) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)
            hit[self.order[j][at]] = True
        rows = np.flatnonzero(hit)
        return rows[np.bitwise_count(self.codes[rows] ^ code).sum(axis=1) <= radius]


def _usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """uid, id, vec of the rows that take part."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("vec")).filter("id IS NOT NULL AND size(vec) > 0")
    good = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    square = F.aggregate("vec", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    rows = rows.filter(good).withColumn("square", square).filter((F.col("square") > 0) & (F.col("square") < float("inf"))).drop("square")
    common = rows.groupBy(F.size("vec").alias("n")).agg(F.count("*").alias("c")).orderBy(F.desc("c"), F.desc("n")).first()
    return rows.filter(F.size("vec") == (common["n"] if common else 0)).withColumn("uid", F.monotonically_increasing_id())


def _coded(rows: DataFrame, coder: Coder) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(coder)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = shared.value.codes(_unit(_matrix(batch.column("vec")))) if batch.num_rows else []
            yield batch.append_column("code", pa.array([c.tobytes() for c in codes], pa.binary()))

    kind = rows.schema["vec"].dataType.simpleString()
    return rows.select("uid", "id", "vec").mapInArrow(code, f"uid long, id long, vec {kind}, code binary")


def _with_radius(queries: DataFrame, coder: Coder, sample: np.ndarray, uids: np.ndarray, k: int) -> DataFrame:
    shared = queries.sparkSession.sparkContext.broadcast((coder, sample, coder.codes(sample), uids))

    def radius(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            coder, units, codes, uids = shared.value
            radii = np.full(batch.num_rows, coder.turn.shape[1])
            if batch.num_rows and len(units) > k:
                mine = batch.column("uid").to_numpy()[:, None] == uids
                cosine = np.where(mine, -2.0, _unit(_matrix(batch.column("vec"))) @ units.T)
                kth = np.partition(cosine, -k, axis=1)[:, -k]
                own = np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint8).reshape(batch.num_rows, -1)
                for n, (c, is_mine) in enumerate(zip(own, mine, strict=True)):
                    apart = np.bitwise_count(codes ^ c).sum(axis=1).astype(np.int64) + is_mine * 9999
                    radii[n] = max(coder.radius(kth[n]), np.partition(apart, k - 1)[k - 1])
            yield batch.append_column("radius", pa.array(radii.astype(np.int32)))

    kind = queries.schema["vec"].dataType.simpleString()
    return queries.mapInArrow(radius, f"uid long, id long, vec {kind}, code binary, radius int")


def _probe(k: int):
    """A shard against a block of queries: the best k rows of each query within its radius."""

    def probe(rows: pa.Table, queries: pa.Table) -> pa.Table:
        names = ["query", "query_id", "id", "uid", "score"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64()]
        out: list[list] = [[] for _ in names]
        if rows.num_rows and queries.num_rows:
            vecs, ids, uids = _matrix(rows["vec"]), rows["id"].to_numpy(), rows["uid"].to_numpy()
            norms = np.sqrt((vecs * vecs).sum(axis=1))
            codes = np.frombuffer(b"".join(rows["code"].to_pylist()), np.uint8).reshape(len(ids), -1)
            index, asked = Index(codes), _matrix(queries["vec"])
            for n, (q, q_id, code, r) in enumerate(zip(*(queries[c].to_pylist() for c in ("uid", "id", "code", "radius")), strict=True)):
                near = index.within(np.frombuffer(code, np.uint8), r)
                near = near[uids[near] != q]
                size = np.sqrt((asked[n] * asked[n]).sum())
                cosine = vecs[near] @ asked[n] / (norms[near] * size)
                if len(near) > k:
                    # What may be among the k best whatever the order of the products' sum.
                    near = near[cosine >= np.partition(cosine, -k)[-k] - 1e-9]
                cosine = (vecs[near] * asked[n]).sum(axis=1) / (norms[near] * size)
                best = np.lexsort((uids[near], ids[near], -cosine))[:k]
                near = near[best]
                for column, part in zip(out, (np.full(len(near), q), np.full(len(near), q_id), ids[near], uids[near], cosine[best]), strict=True):
                    column.append(part)
        flat = [np.concatenate(c) if c else np.empty(0) for c in out]
        return pa.table([pa.array(c).cast(kind) for c, kind in zip(flat, kinds, strict=True)], names=names)

    return probe


def nearest(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = NEAREST, every: int = EVERY) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each row whose id is divisible by `every`."""
    spark = vectors.sparkSession
    small_batches(spark, mb=8)
    rows = stage(_usable(vectors, id_col, vec_col), "near-rows")
    total = rows.count()
    if not total:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    taken = rows.select("uid", "vec").orderBy(F.xxhash64("vec"), "uid").limit(SAMPLE).toArrow()
    units = _unit(_matrix(taken["vec"]))
    coder = Coder(units)
    coded = stage(_coded(rows, coder), "near-codes")
    discard(rows)
    queries = stage(_with_radius(coded.filter(F.col("id") % every == 0), coder, units, taken["uid"].to_numpy(), k), "near-queries")
    blocks = max(1, -(-queries.count() // QUERIES))
    # The split changes no result: what lies within a query's radius is the same in however many shards.
    size = max(1024, min(SHARD, -(-total // (TASKS * spark.sparkContext.defaultParallelism))))
    shards = -(-total // size)
    number = lambda n, seed: F.pmod(F.xxhash64("uid", F.lit(seed)), F.lit(n)).cast("int")
    every_ = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = coded.select("*", number(shards, 1).alias("shard"), every_(blocks).alias("block")).groupBy("shard", "block")
    right = queries.select("*", every_(shards).alias("shard"), number(blocks, 2).alias("block")).groupBy("shard", "block")
    found = left.cogroup(right).applyInArrow(_probe(k), "query long, query_id long, id long, uid long, score double")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id", "uid"))
    found = found.withColumn("rank", rank).filter(F.col("rank") <= k)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


def op13_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))
