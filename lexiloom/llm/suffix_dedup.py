r"""Removal of long repeated byte strings by distributed prefix doubling.

A byte goes if it is covered by a string of `LENGTH` bytes that also starts anywhere else. Sorting a
rank pair for every byte would move the corpus many times over, so the suffixes that are sorted are
sparse: they start at anchors, the leftmost least K-gram hash of each window of `SPAN` positions, which
depend on the bytes alone. Equal strings of `LENGTH` bytes have the same anchors inside, so nothing is
lost between anchors; a phrase is what lies from one anchor to the next, K bytes past it.

1. Equal texts are grouped by SHA-256; one of each group goes on, for of the others everything that is
   long enough repeats.
2. Ranks of length 1 are the phrases; a phrase that is nowhere else drops out. Each round pairs the rank
   of a position with the rank found m phrases on, groups the pairs, drops the unique ones and reranks the
   rest to length 2m, until runs are past the threshold.
3. Two overlapping power-of-two ranks name every run that covers all strings starting between an anchor
   and the next. Strings under a shared run are repeats. Of the rest, those whose inner run is shared are
   open, at the ends of matches; they and the strings of the same inner runs elsewhere are settled byte by
   byte, by 96-bit hashes of the strings themselves.

Repeated passages below the threshold are not removed but counted: `n_passages` has the stretches of
`PASSAGE` bytes or more of which every two phrases in a row occur again somewhere. It is told from the
ranks alone, so it sees what lies between the first and the last anchor of a passage, and texts shorter than
`LENGTH` have none.

Ranks are 64-bit names of runs of phrase hashes.
Groups are partial aggregates and skewed joins; texts that share no phrase are not read again.

Defined results: null text counts as empty; texts shorter than `LENGTH` keep everything; matches never
cross documents; rows that repeat an id and text are texts of their own, so that long ones repeat each
other; no rows in, no rows out; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexiloom.llm.common import BROADCAST_ROWS, documents, key_filter, small_batches, stage
from lexiloom.llm.shingles import Powers, mix64

LENGTH = 400
K = 16
SPAN = 128
#: Least bytes of a stretch that counts as a repeated passage.
PASSAGE = 128
#: Open strings are hashed in packings of about so many and settled in calls of about so many.
PACKING = 1_000_000
CALL_STRINGS = 2_000_000
#: Shared ranks (one long each) that may be broadcast after they were counted; more are joined by a shuffle.
NAMES = 2_000_000
_BYTES = [mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(s)) | np.uint64(1) for s in (3, 5)]


class Bytes:
    """The bytes of one text with hashes of any of its ranges."""

    def __init__(self, raw: bytes) -> None:
        self.raw = np.frombuffer(raw, dtype=np.uint8)
        self.sums: list[np.ndarray | None] = [None, None]

    def hashes(self, lo: np.ndarray, hi: np.ndarray, which: int = 0) -> np.ndarray:
        up, down = Powers.of(len(self.raw) + 1)
        if self.sums[which] is None:
            terms = _BYTES[which][self.raw] * up[: len(self.raw)]
            self.sums[which] = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(terms, dtype=np.uint64)))
        s = self.sums[which]
        return mix64((s[hi] - s[lo]) * down[lo] + (hi - lo).astype(np.uint64))


def sliding_argmin(key: np.ndarray, span: int) -> np.ndarray:
    """For each window of `span` keys (distinct), the least key, by prefix and suffix minima of blocks."""
    n = len(key)
    pad = -n % span
    blocks = np.concatenate((key, np.full(pad, np.iinfo(np.uint64).max, dtype=np.uint64))).reshape(-1, span)
    prefix = np.minimum.accumulate(blocks, axis=1).ravel()
    suffix = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(suffix[: n - span + 1], prefix[span - 1 : n])


class Anchors:
    """Anchors of a text of LENGTH bytes or more, and the phrases between them."""

    def __init__(self, data: Bytes) -> None:
        n = len(data.raw)
        at = np.arange(n - K + 1)
        # Position in the low half: of equal hashes the leftmost is least.
        key = (data.hashes(at, at + K) & np.uint64(0xFFFFFFFF00000000)) | at.astype(np.uint64)
        least = (sliding_argmin(key, SPAN) & np.uint64(0xFFFFFFFF)).astype(np.int64)
        self.pos = np.unique(least)
        self.first = np.searchsorted(self.pos, least)  # anchor of each window of positions
        self.size = n

    def phrases(self, data: Bytes) -> np.ndarray:
        return data.hashes(self.pos[:-1], self.pos[1:] + K)

    def reach(self) -> tuple[np.ndarray, np.ndarray]:
        """Phrases from each anchor that make a run past the threshold (0 if the text ends before), and
        the most that any decision needs."""
        pos, n = self.pos, len(self.pos)
        t = np.arange(n - 1)
        need = pos[:-1] + LENGTH + (pos[1:] - pos[:-1]) - 1
        end = np.searchsorted(pos + K, need)
        full = np.where(end < n, end - t, 0)
        most = np.maximum(1, np.searchsorted(pos, pos[:-1] + LENGTH + 2 * SPAN + K, side="right") - 1 - t)
        return full, most

    def groups(self) -> tuple[np.ndarray, ...]:
        """Strings (by start lo..hi, hi exclusive) with one floor anchor t and one inner run from f over d
        phrases; t is -1 before the first anchor."""
        starts = np.arange(self.size - LENGTH + 1)
        f = self.first[: len(starts)]
        last = self.first[LENGTH - (SPAN + K - 1) : LENGTH - (SPAN + K - 1) + len(starts)]
        t = np.searchsorted(self.pos, starts, side="right") - 1
        cut = np.flatnonzero((np.diff(f) != 0) | (np.diff(last) != 0) | (np.diff(t) != 0)) + 1
        lo = np.concatenate(([0], cut))
        hi = np.concatenate((cut, [len(starts)]))
        return lo, hi, t[lo], f[lo], (last - f)[lo]


def _two(n: np.ndarray) -> np.ndarray:
    """The largest power of two up to each n >= 1."""
    return 1 << (np.frexp(n.astype(np.float64))[1] - 1)


def _read(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(
        F.col(id_col).alias("id"), text.alias("text"), F.sha2(text, 256).alias("sha"), F.octet_length(text).cast("long").alias("n")
    )


def _phrases(texts: DataFrame) -> DataFrame:
    """(sha, h, full, most) of every long text: one entry a phrase."""

    @F.pandas_udf("struct<h: array<long>, full: array<int>, most: array<int>>")
    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for t in batch:
                data = Bytes(t.encode("utf-8", "surrogatepass"))
                a = Anchors(data)
                full, most = a.reach()
                out.append((a.phrases(data).view(np.int64), full.astype(np.int32), most.astype(np.int32)))
            yield pd.DataFrame(out, columns=["h", "full", "most"])

    return texts.filter(F.col("n") >= LENGTH).select("sha", scan("text").alias("p")).select("sha", "p.*")


def _shared(rows: DataFrame) -> DataFrame:
    """Rows whose rank occurs more than once."""
    names = rows.groupBy("rank").agg(F.count("*").alias("c")).filter("c > 1").select("rank")
    names = stage(names, "suffix-names")
    side = F.broadcast(names) if names.count() <= NAMES else names
    return stage(rows.join(side, "rank", "left_semi"), "suffix-ranks")


def doubled_ranks(phrases: DataFrame) -> DataFrame:
    """(doc, t, m, rank): the shared runs of m = 1, 2, 4, ... phrases from position t."""
    rows = phrases.select("doc", "most", F.posexplode("h").alias("t", "rank"))
    alive = _shared(rows.select("doc", "t", F.get("most", F.col("t")).alias("most"), "rank"))
    out, m = alive.select("doc", "t", F.lit(1).alias("m"), "rank"), 1
    while not alive.isEmpty():
        there = Window.partitionBy("doc").orderBy("t").rangeBetween(m, m)  # the position m phrases on, if alive
        m *= 2
        pairs = alive.withColumn("ahead", F.max("rank").over(there)).filter((F.col("most") >= m) & F.col("ahead").isNotNull())
        pairs = pairs.select("doc", "t", "most", F.xxhash64(F.lit(m), "rank", "ahead").alias("rank"))
        alive = _shared(stage(pairs, "suffix-pairs"))
        out = out.union(alive.select("doc", "t", F.lit(m).alias("m"), "rank"))
    return out


def _covered(ranks: DataFrame, phrases: DataFrame) -> DataFrame:
    """(doc, t): positions whose run past the threshold is shared."""
    reach = phrases.select("doc", F.posexplode("full").alias("t", "d")).filter("d > 0").withColumn(
        "m", F.expr("1 << int(floor(log2(d)))")
    )
    a = ranks.withColumnRenamed("rank", "a")
    b = ranks.select("doc", F.col("t").alias("t2"), "m", F.col("rank").alias("b"))
    runs = (
        a.join(reach, ["doc", "t", "m"])
        .withColumn("t2", F.col("t") + F.col("d") - F.col("m"))
        .join(b, ["doc", "t2", "m"])
        .select("doc", "t", F.xxhash64("a", "b", "d").alias("rank"))
    )
    return _shared(stage(runs, "suffix-full")).select("doc", "t")


_GROUPS = ["doc", "core", "lo", "hi", "off", "sure"]


def _passages(pos: np.ndarray, pairs: np.ndarray) -> int:
    """Stretches of PASSAGE bytes or more under shared runs of two phrases, which start at `pairs`."""
    t = np.unique(pairs)
    if not len(t):
        return 0
    cut = np.flatnonzero(np.diff(t) != 1) + 1
    first, last = t[np.append(0, cut)], t[np.append(cut, len(t)) - 1]
    return int(np.count_nonzero(pos[last + 2] + K - pos[first] >= PASSAGE))


def _groups(cand: DataFrame) -> DataFrame:
    """(doc, core, lo, hi, off, sure): strings that start at lo..hi of texts with (text, rt, rm, rank, ts).

    `core` names their inner run, `off` is how far the first one starts before it; `rt`, `rm` and `rank`
    are the shared runs of the text, `ts` the positions under a run past the threshold. A row without core
    tells in `hi` how many passages the text shares.
    """

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out: list[tuple[np.ndarray, ...]] = []
            told: list[tuple] = []
            for doc, text, rt, rm, rank, ts in zip(pdf["doc"], pdf["text"], pdf["rt"], pdf["rm"], pdf["rank"], pdf["ts"]):
                data = Bytes(text.encode("utf-8", "surrogatepass"))
                a = Anchors(data)
                lo, hi, t, f, d = a.groups()
                ok, core = np.zeros(len(lo), dtype=bool), np.zeros(len(lo), dtype=np.uint64)
                two = _two(d)
                for m in np.unique(two):
                    mine = np.flatnonzero(rm == m)
                    if not len(mine):
                        continue
                    held, name = np.zeros(len(a.pos) + 1, dtype=bool), np.zeros(len(a.pos) + 1, dtype=np.uint64)
                    held[rt[mine]], name[rt[mine]] = True, rank[mine].view(np.uint64)
                    g = np.flatnonzero(two == m)
                    g = g[held[f[g]] & held[f[g] + d[g] - m]]
                    ok[g] = True
                    core[g] = mix64(mix64(mix64(name[f[g]]) + name[f[g] + d[g] - m]) + d[g].astype(np.uint64))
                full = np.zeros(len(a.pos) + 1, dtype=bool)
                full[ts] = True
                sure = full[t] & (t >= 0)
                out.append((np.full(int(ok.sum()), doc), core[ok].view(np.int64), lo[ok], hi[ok], (a.pos[f] - lo)[ok], sure[ok]))
                told.append((doc, None, 0, _passages(a.pos, rt[rm == 2]), 0, True))
            if out:
                rows = pd.DataFrame(dict(zip(_GROUPS, map(np.concatenate, zip(*out))))).astype({"core": "Int64"})
                yield pd.concat([rows, pd.DataFrame(told, columns=_GROUPS).astype({"core": "Int64"})])

    return cand.mapInPandas(scan, "doc long, core long, lo long, hi long, off long, sure boolean")


def _open(groups: DataFrame) -> DataFrame:
    """(doc, lo, hi): starts cut to the offsets at which their inner run is open anywhere."""
    open_ = F.when(~F.col("sure"), F.col("off"))
    cores = groups.groupBy("core").agg(
        F.count("*").alias("c"),
        F.max(open_).alias("most"),
        F.min(F.when(~F.col("sure"), F.col("off") - (F.col("hi") - F.col("lo")) + 1)).alias("least"),
    ).filter("c > 1 AND most IS NOT NULL").select("core", "most", "least")
    # String s of a group has offset off - (s - lo).
    return (
        groups.join(stage(cores, "suffix-cores"), "core")
        .select(
            "doc", F.greatest("lo", F.expr("lo + off - most")).cast("int").alias("lo"),
            F.least("hi", F.expr("lo + off - least + 1")).cast("int").alias("hi"),
        )
        .filter("lo < hi")
    )


def _twins(key: np.ndarray, extra: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which hashes occur more than once, and of each of those the first place."""
    order = np.lexsort((extra, key))
    same = (key[order][1:] == key[order][:-1]) & (extra[order][1:] == extra[order][:-1])
    again, first = np.zeros(len(key), dtype=bool), np.zeros(len(key), dtype=bool)
    again[order] = np.append(False, same) | np.append(same, False)
    first[order] = np.append(same, False) & ~np.append(False, same)
    return again, first


def _stretches(doc: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc, lo, hi) of the runs of consecutive starts."""
    order = np.lexsort((start, doc))
    doc, start = doc[order], start[order]
    cut = np.flatnonzero((np.diff(doc) != 0) | (np.diff(start) != 1)) + 1
    lo = np.concatenate(([0], cut)) if len(doc) else cut
    hi = np.concatenate((cut, [len(doc)])) if len(doc) else cut
    return doc[lo], start[lo], start[hi - 1] + 1


_BLOBS = "call long, docs binary, key binary, extra binary, which binary, start binary"
_NOWHERE = 0xFFFFFFFF


def _hashed(cand: DataFrame, calls: int) -> DataFrame:
    """Hashes of the open strings of (doc, text, lo, hi), packed by the call that settles them.

    Strings that meet in a packing are settled there and then (call, with no key, tells where they
    start); one hash goes on for all of them, so a string that a third of all texts hold costs one
    entry a packing.
    """

    def pack(found: list[tuple[np.ndarray, ...]]) -> pd.DataFrame:
        doc, key, extra, start = map(np.concatenate, zip(*found))
        again, first = _twins(key, extra)
        rows = []
        if again.any():
            d, lo, hi = _stretches(doc[again], start[again])
            rows.append((int(d[0] % calls), d.tobytes(), b"", b"", b"", np.stack((lo, hi)).astype(np.int64).tobytes()))
        send = np.flatnonzero(~again | first)
        to = (key[send] >> np.uint64(20)) % np.uint64(calls)
        order = np.argsort(to, kind="stable")
        send, to = send[order], to[order]
        cut = np.flatnonzero(np.diff(to)) + 1
        for part in np.split(send, cut) if len(send) else []:
            call = int((key[part[0]] >> np.uint64(20)) % np.uint64(calls))
            docs, which = np.unique(doc[part], return_inverse=True)  # the texts of this part alone
            which = np.where(first[part], _NOWHERE, which).astype(np.uint32)
            rows.append((call, docs.tobytes(), key[part].tobytes(), extra[part].tobytes(), which.tobytes(), start[part].astype(np.int32).tobytes()))
        return pd.DataFrame(rows, columns=["call", "docs", "key", "extra", "which", "start"])

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found, n = [], 0
        for pdf in batches:
            for doc, text, lo, hi in zip(pdf["doc"], pdf["text"], pdf["lo"], pdf["hi"]):
                data = Bytes(text.encode("utf-8", "surrogatepass"))
                lens = hi - lo
                start = np.repeat(lo - np.cumsum(lens) + lens, lens) + np.arange(lens.sum())
                start = np.unique(start).astype(np.int64)
                other = data.hashes(start, start + LENGTH, 1)
                key = mix64(data.hashes(start, start + LENGTH) + mix64(other))
                found.append((np.full(len(start), doc, dtype=np.int64), key, (other >> np.uint64(32)).astype(np.uint32), start))
                n += len(start)
                if n >= PACKING:
                    yield pack(found)
                    found, n = [], 0
        if found:
            yield pack(found)

    return cand.mapInPandas(scan, _BLOBS)


def _settled(blobs: DataFrame) -> DataFrame:
    """(doc, lo, hi): starts of open strings that occur elsewhere."""

    def settle(pdf: pd.DataFrame) -> pd.DataFrame:
        load = lambda b, kind: np.frombuffer(b, dtype=kind)
        there = pdf["key"].map(len) > 0
        out = []
        for docs, where in zip(pdf["docs"][~there], pdf["start"][~there]):
            lo, hi = load(where, np.int64).reshape(2, -1)
            out.append((load(docs, np.int64), lo, hi))
        sent = pdf[there]
        if len(sent):
            key, extra, which, start = (
                np.concatenate([load(b, kind) for b in sent[c]])
                for c, kind in (("key", np.uint64), ("extra", np.uint32), ("which", np.uint32), ("start", np.int32))
            )
            again, _ = _twins(key, extra)
            row = np.repeat(np.arange(len(sent)), [len(k) // 8 for k in sent["key"]])
            docs = [load(b, np.int64) for b in sent["docs"]]
            base = np.cumsum([0, *map(len, docs)])
            hit = np.flatnonzero(again & (which != _NOWHERE))
            doc = np.concatenate(docs)[base[row[hit]] + which[hit]]
            out.append(_stretches(doc, start[hit].astype(np.int64)))
        doc, lo, hi = map(np.concatenate, zip(*out))
        return pd.DataFrame({"doc": doc, "lo": lo, "hi": hi})

    return blobs.groupBy("call").applyInPandas(settle, "doc long, lo long, hi long")


def _removal(cand: DataFrame) -> DataFrame:
    """(sha, n_removed, n_spans, kept) of texts with the starts of repeated strings (ts; lo, hi)."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for sha, text, ts, lo, hi in zip(pdf["sha"], pdf["text"], pdf["ts"], pdf["lo"], pdf["hi"]):
                data = Bytes(text.encode("utf-8", "surrogatepass"))
                n = len(data.raw)
                pos = Anchors(data).pos
                lo = np.concatenate((pos[ts], lo))
                hi = np.concatenate((pos[np.minimum(ts + 1, len(pos) - 1)], hi))
                depth = np.zeros(n + 1, dtype=np.int64)
                np.add.at(depth, lo, 1)
                np.add.at(depth, np.minimum(hi - 1 + LENGTH, n), -1)
                gone = np.cumsum(depth)[:n] > 0
                spans = int(np.count_nonzero(np.diff(gone.view(np.int8), prepend=0) == 1))
                out.append((sha, int(gone.sum()), spans, hashlib.sha256(data.raw[~gone].tobytes()).hexdigest()))
            yield pd.DataFrame(out, columns=["sha", "n_removed", "n_spans", "kept"])

    return cand.mapInPandas(scan, "sha string, n_removed long, n_spans long, kept string")


def _lists(df: DataFrame, *cols: str) -> DataFrame:
    """The columns as parallel lists by text; lists are bounded by the text itself."""
    all_ = df.groupBy("doc").agg(F.collect_list(F.struct(*cols)).alias("x"))
    return all_.select("doc", *[F.col(f"x.{c}").alias(c) for c in cols])


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_bytes, n_removed, n_spans, kept_sha256, n_passages."""
    small_batches(docs.sparkSession)
    rows = _read(docs, id_col, text_col)
    keys = stage(rows.select("id", "sha", "n"), "suffix-keys")
    copies = keys.groupBy("sha").agg(F.count("*").alias("c"), F.min("id").alias("one")).filter("c > 1")
    copies = stage(copies.select("sha", "one"), "suffix-copies")
    side = F.broadcast(copies) if copies.count() <= BROADCAST_ROWS else copies
    copied = keys.join(side.select("sha"), "sha", "left_semi")
    single = keys.join(side.select("sha"), "sha", "left_anti")
    texts = rows.join(side, "sha", "left").filter("one IS NULL OR id <=> one").select("sha", "n", "text")
    phrases = stage(_phrases(texts).withColumn("doc", F.monotonically_increasing_id()), "suffix-phrases")
    ranks = doubled_ranks(phrases)
    covered = _covered(ranks, phrases)

    # Texts with a shared phrase, and what is known of them.
    ts = stage(_lists(covered.withColumnRenamed("t", "ts"), "ts"), "suffix-covered")
    profile = _lists(ranks.select("doc", F.col("t").alias("rt"), F.col("m").alias("rm"), "rank"), "rt", "rm", "rank").join(ts, "doc", "left")
    names = phrases.select("doc", "sha").join(ranks.filter("m = 1").select("doc").distinct(), "doc")
    names = stage(names.withColumn("key", F.xxhash64("sha")), "suffix-candidates")
    may_hold = key_filter(names, "key")

    @F.pandas_udf("boolean")
    def wanted(key: pd.Series) -> pd.Series:
        return pd.Series(may_hold(key.to_numpy()))

    picked = texts.filter(F.col("n") >= LENGTH).filter(wanted(F.xxhash64("sha")))
    cand = stage(picked.join(names.drop("key"), "sha").select("doc", "sha", "text"), "suffix-texts")
    empty = lambda kind: F.array().cast(kind)
    known = cand.join(profile, "doc").withColumn("ts", F.coalesce("ts", empty("array<int>")))
    groups = stage(_groups(known), "suffix-groups")
    shares = groups.filter("core IS NULL AND hi > 0").select("doc", F.col("hi").alias("n_passages"))
    parts = stage(_lists(_open(groups.filter("core IS NOT NULL")), "lo", "hi"), "suffix-open")
    strings = parts.agg(F.sum(F.aggregate(F.zip_with("hi", "lo", lambda h, l: h - l), F.lit(0).cast("long"), lambda a, x: a + x))).first()[0]
    calls = max(1, (strings or 0) // CALL_STRINGS)
    spans = stage(_settled(_hashed(cand.join(parts, "doc"), calls)), "suffix-spans")
    none = F.array().cast("array<long>")
    both = ts.join(_lists(spans, "lo", "hi"), "doc", "full").select(
        "doc", F.coalesce("ts", empty("array<int>")).alias("ts"), F.coalesce("lo", none).alias("lo"), F.coalesce("hi", none).alias("hi")
    )
    removal = stage(_removal(cand.join(both, "doc")), "suffix-removal").dropDuplicates(["sha"])
    shares = names.join(shares, "doc").groupBy("sha").agg(F.max("n_passages").alias("n_passages"))
    # Of copies nothing is asked but their length, so that they need no join with what was found for one text.
    zero = F.lit(0).cast("long")
    long_copy = F.col("n") >= LENGTH
    copied = copied.select(
        "id", F.col("n").alias("n_bytes"), F.when(long_copy, F.col("n")).otherwise(zero).alias("n_removed"),
        F.when(long_copy, 1).otherwise(0).cast("long").alias("n_spans"),
        F.when(long_copy, F.sha2(F.lit(""), 256)).otherwise(F.col("sha")).alias("kept_sha256"),
        (F.col("n") >= PASSAGE).cast("long").alias("n_passages"),
    )
    single = single.join(removal, "sha", "left").join(shares, "sha", "left").select(
        "id", F.col("n").alias("n_bytes"), F.coalesce("n_removed", zero).alias("n_removed"), F.coalesce("n_spans", zero).alias("n_spans"),
        F.coalesce("kept", "sha").alias("kept_sha256"), F.coalesce("n_passages", zero).alias("n_passages"),
    )
    return copied.unionByName(single)


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(documents(spark, sf_dir)).withColumnRenamed("id", "doc_id")
