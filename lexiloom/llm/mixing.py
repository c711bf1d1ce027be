"""Mixing sources to target weights by Pfair scheduling, in DataFrame functions alone.

Documents of a source are cut into blocks of `BLOCK_DOCS` in hash order. A source with share q of
a period of P slots (P = the sum of the shares) releases its block j at slot floor(j P / q) and
has to place it before slot ceil((j + 1) P / q); earliest deadline first over the released blocks
fills every slot, and at each slot every source has placed its weight's worth of blocks to within
less than one block. The schedule repeats with the period, so a block's slot is arithmetic on one
small table. When a source runs out, a new phase begins with the shares of those left, until every
document is placed exactly once.

What the driver works out (`plan_phases`) depends on the number of sources and the shares only: at
most `MOST_SOURCES` phases of about a period of slots, or as many as the caller names targets. Every source with a
target keeps its place; where a table has more sources, the largest of the others keep theirs and the rest share
one, under the name `OTHERS`.
Numbering of documents inside a source is salted: buckets of a hash of the whole row are numbered on their own and
shifted by counted offsets, so a source with a third of all rows is spread over many tasks, and so are rows
that share an id or have none.

Defined results: a null source counts as the empty name; sources without a target get the least
share, 1; null ids sort first; rows that repeat an id are placed one by one; an empty table gives
an empty mix; other columns are carried along, and a column named as one of the results gives way.
"""

from __future__ import annotations

import heapq
import json
from math import gcd

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexiloom.llm.common import documents

BLOCK_DOCS = 16
PERIOD = 1000
SMOOTHING = 0.7
BUCKET_DOCS = 100_000
LEAST_BUCKETS = 64
MOST_SOURCES = 256
OTHERS = "(other sources)"
RESULTS = ["mix_source", "mix_block", "mix_phase", "mix_slot", "mix_release", "mix_deadline", "mix_position"]

_PLAN = (
    "array<struct<mix_source: string, phases: array<struct<phase: int, first: long, last: long, quota: long, "
    "period: long, start: long, slots: array<int>>>>>"
)


def smoothed_shares(counts: dict[str, int], period: int = PERIOD, power: float = SMOOTHING) -> dict[str, int]:
    """Integer shares of the period in proportion to count ** power, 1 at least."""
    mass = {s: n**power for s, n in counts.items() if n > 0}
    total = sum(mass.values())
    return {s: max(1, round(period * m / total)) for s, m in sorted(mass.items())}


def edf_period(quotas: dict[str, int]) -> dict[str, list[int]]:
    """Slots of one period by source: earliest deadline first among released blocks."""
    period = sum(quotas.values())
    slots: dict[str, list[int]] = {s: [] for s in quotas}
    waiting = [(0, s) for s in sorted(quotas)]
    heapq.heapify(waiting)
    ready: list[tuple[int, str]] = []
    for t in range(period):
        while waiting and waiting[0][0] <= t:
            _, s = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(len(slots[s]) + 1) * period // quotas[s]), s))
        _, s = heapq.heappop(ready)
        slots[s].append(t)
        if len(slots[s]) < quotas[s]:
            heapq.heappush(waiting, (len(slots[s]) * period // quotas[s], s))
    return slots


def plan_phases(blocks: dict[str, int], shares: dict[str, int]) -> list[dict]:
    """By source, the phases with the blocks first..last it places in each and where."""
    left = {s: n for s, n in blocks.items() if n > 0}
    done = dict.fromkeys(left, 0)
    plan: dict[str, list[dict]] = {s: [] for s in left}
    start = phase = 0
    while left:
        least = 0
        for s in left:
            least = gcd(least, max(1, shares.get(s, 1)))
        quotas = {s: max(1, shares.get(s, 1)) // least for s in left}
        period = sum(quotas.values())
        slots = edf_period(quotas)
        length = 1 + min((n - 1) // quotas[s] * period + slots[s][(n - 1) % quotas[s]] for s, n in left.items())
        for s in sorted(left):
            placed = length // period * quotas[s] + sum(x < length % period for x in slots[s])
            if placed:
                plan[s].append(
                    {"phase": phase, "first": done[s], "last": done[s] + placed - 1, "quota": quotas[s],
                     "period": period, "start": start, "slots": slots[s]}
                )
            done[s] += placed
            left[s] -= placed
        left = {s: n for s, n in left.items() if n > 0}
        start += length
        phase += 1
    return [{"mix_source": s, "phases": p} for s, p in sorted(plan.items())]


def mix(
    docs: DataFrame,
    shares: dict[str, int] | None = None,
    id_col: str = "doc_id",
    source_col: str = "source",
    block_docs: int = BLOCK_DOCS,
) -> DataFrame:
    """The columns of `docs` and mix_source, mix_block, mix_phase, mix_slot, mix_release,
    mix_deadline (first slot past it) and mix_position (0, 1, 2, ... over the whole mix)."""
    spark = docs.sparkSession
    keyed = docs.drop(*RESULTS).select(
        F.struct("*").alias("row"),
        F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("mix_source"),
        F.col(id_col).alias("mix_id"),
        F.xxhash64(id_col).alias("mix_hash"),
        F.xxhash64(*docs.drop(*RESULTS).columns).alias("mix_row"),
    )
    total = docs.count()
    buckets = max(LEAST_BUCKETS, -(-total // BUCKET_DOCS))
    keyed = keyed.withColumn("mix_bucket", F.pmod("mix_row", F.lit(buckets)))
    sources = keyed.groupBy("mix_source").agg(F.count("*").alias("n"))
    # Every source with a target keeps its place, however many the caller names.
    targets = sorted(shares or {})
    most = max(MOST_SOURCES, len(targets) + 1)
    largest = sources.orderBy(F.col("mix_source").isin(targets).desc(), F.desc("n"), "mix_source").limit(most + 1)
    named = [r["mix_source"] for r in largest.collect()]
    if len(named) > most:
        own = F.col("mix_source").isin(named[: most - 1])
        keyed = keyed.withColumn("mix_source", F.when(own, F.col("mix_source")).otherwise(F.lit(OTHERS)))
    sizes = keyed.groupBy("mix_source", "mix_bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("mix_source").orderBy("mix_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("mix_source", "mix_bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    counts = {r["mix_source"]: r["n"] for r in sizes.groupBy("mix_source").agg(F.sum("n").alias("n")).collect()}
    blocks = {s: -(-n // block_docs) for s, n in counts.items()}
    plan = plan_phases(blocks, smoothed_shares(counts) if shares is None else shares)

    # Documents missing from the last block of a source, by the slot of that block.
    short = []
    for p in plan:
        end, last = p["phases"][-1], blocks[p["mix_source"]] - 1
        j = last - end["first"]
        slot = end["start"] + j // end["quota"] * end["period"] + end["slots"][j % end["quota"]]
        short.append({"slot": slot, "n": blocks[p["mix_source"]] * block_docs - counts[p["mix_source"]]})
    table = spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(plan)), _PLAN)))
    gaps = F.from_json(F.lit(json.dumps(short)), "array<struct<slot: long, n: long>>")

    inside = Window.partitionBy("mix_source", "mix_bucket").orderBy("mix_hash", "mix_id", "mix_row")
    at = (
        keyed.withColumn("rn", F.row_number().over(inside) - 1)
        .join(offsets, ["mix_source", "mix_bucket"])
        .withColumn("index", F.col("offset") + F.col("rn"))
        .withColumn("mix_block", F.floor(F.col("index") / block_docs).cast("long"))
        .join(F.broadcast(table), "mix_source")
        .withColumn("p", F.filter("phases", lambda p: (F.col("mix_block") >= p["first"]) & (F.col("mix_block") <= p["last"]))[0])
        .withColumn("j", F.col("mix_block") - F.col("p.first"))
    )
    cycle = F.expr("j div p.quota")
    return (
        at.withColumn("mix_slot", F.col("p.start") + cycle * F.col("p.period") + F.get(F.col("p.slots"), F.expr("int(j % p.quota)")))
        .withColumn("mix_phase", F.col("p.phase"))
        .withColumn("mix_release", F.expr("p.start + j * p.period div p.quota"))
        .withColumn("mix_deadline", F.expr("p.start + ((j + 1) * p.period + p.quota - 1) div p.quota"))
        .withColumn(
            "mix_position",
            F.col("mix_slot") * block_docs + F.col("index") % block_docs
            - F.aggregate(F.filter(gaps, lambda g: g["slot"] < F.col("mix_slot")), F.lit(0).cast("long"), lambda a, g: a + g["n"]),
        )
        .select("row.*", *RESULTS)
    )


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir).select("doc_id", "source"))
