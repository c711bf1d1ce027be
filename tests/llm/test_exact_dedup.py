import hashlib
import re
from collections import defaultdict

from pyspark.sql import functions as F

from lexiloom.llm import exact_dedup as X


def brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub("[\x20\x09-\x0d]", "", t or "")].append((-len(t or ""), i))
    out = []
    for i, t in rows:
        norm = re.sub("[\x20\x09-\x0d]", "", t or "")
        keep = min(groups[norm])[1]
        out.append((i, keep, len(groups[norm]), keep == i, hashlib.sha256(norm.encode()).hexdigest()))
    return sorted(out)


def test_against_brute_force(make, prose):
    rows = [*prose, (900, "x y"), (901, "xy"), (902, "x  y "), (903, " x y"), (904, "xz"), (905, "x y")]
    got = X.exact_dedup(make(rows), digest_all=True).collect()
    assert sorted((r["id"], r["keep_id"], r["group_size"], r["kept"], r["digest"]) for r in got) == brute(rows)


def test_ties_repeats_and_null_ids(make):
    got = X.exact_dedup(make([(3, "a b"), (1, "b"), (2, "ab "), (2, "ab "), (None, "q"), (None, None)])).collect()
    by = defaultdict(list)
    for r in got:
        by[r["id"]].append((r["keep_id"], r["group_size"], r["kept"]))
    # Of two rows that are the same, one stays.
    assert by[3] == [(2, 3, False)] and sorted(by[2]) == [(2, 3, False), (2, 3, True)] and by[1] == [(1, 1, True)]
    assert by[None] == [(None, 1, True)] * 2


def test_full_content_is_hashed_for_survivors_only(make):
    long = "w" * 100
    got = {r["id"]: r["digest"] for r in X.exact_dedup(make([(1, "alone here"), (2, long), (3, long), (4, long[:-1] + "v")])).collect()}
    assert got[1] is None and got[2] == got[3] != got[4] and got[4] is not None


def test_empty_table(make):
    assert X.exact_dedup(make([])).count() == 0


def test_joins_when_keys_are_too_many_to_broadcast(make, prose, monkeypatch):
    monkeypatch.setattr(X, "BROADCAST_ROWS", 0)
    got = X.exact_dedup(make(prose), digest_all=True).collect()
    assert sorted((r["id"], r["keep_id"], r["group_size"], r["kept"], r["digest"]) for r in got) == brute(prose)


def test_only_candidates_are_hashed_beyond_the_broadcast(make, monkeypatch):
    monkeypatch.setattr(X, "BROADCAST_ROWS", 0)
    alone = [(i, f"{'w' * i} only once") for i in range(300)]
    rows = [*alone, (900, "twice here"), (901, "twice  here"), (902, None), (903, "")]
    out = X.exact_dedup(make(rows))
    got = out.collect()
    assert sum(r["digest"] is not None for r in got) == 4 and sorted((r["id"], r["keep_id"], r["group_size"], r["kept"]) for r in got) == sorted(
        (i, k, n, kept) for i, k, n, kept, _ in brute(rows)
    )
    plan = X._candidates(make(rows), make(rows).select("n", F.lit(1).cast("long").alias("prefix")), "doc_id", "text")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("sha2(") < plan.index("picked(")  # the filter lies below what is hashed
