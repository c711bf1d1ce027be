import hashlib
import re

import numpy as np
import pytest

from lexiloom.llm import jaccard_join as J
from lexiloom.llm.components import connected_components
from lexiloom.llm.shingles import overlap, shingle_set


def words(text):
    return re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def shingles(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    up = {k: k for k in range(len(sets))}

    def find(k):
        while up[k] != k:
            k = up[k]
        return k

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 4 * len(x & y) >= 3 * len(x | y):
                up[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(sets):
        least[find(k)] = min(i, least.get(find(k), i))
    return sorted((i, len(s), least[find(k)]) for k, (i, s) in enumerate(sets))


def result(df):
    return sorted((r["id"], r["n_shingles"], r["component_id"]) for r in J.jaccard_components(df).collect())


def test_against_brute_force(make, prose):
    assert result(make(prose)) == brute(prose)


@pytest.mark.parametrize("spread", [0.5, 9.0])
def test_large_regions_split_recursively_or_in_blocks(make, prose, monkeypatch, spread):
    for name, value in {"CAP_MEMBERS": 4, "BLOCK_MEMBERS": 3, "PIVOTS": 3, "HOT_SHARE": 0.0, "DEPTH": 2, "SPREAD": spread, "PLACED_ROWS": 0, "PIVOT_SHINGLES": 0}.items():
        monkeypatch.setattr(J, name, value)
    assert result(make(prose)) == brute(prose)


def test_threshold_is_inclusive(make):
    base = [f"w{i}" for i in range(12)]  # 8 shingles
    longer = [*base, "x"]  # 9: 8/9
    other = [*base[:10], "y", "z"]  # shares 6 of 8: 6/10
    exact = [f"v{i}" for i in range(10)]  # 6 shingles
    more = [*exact, "p", "q"]  # 8: 6/8 is the threshold itself
    rows = [(5, " ".join(longer)), (4, " ".join(base)), (3, " ".join(other)), (2, " ".join(exact)), (1, " ".join(more))]
    assert result(make(rows)) == brute(rows) == [(1, 8, 1), (2, 6, 1), (3, 8, 3), (4, 8, 4), (5, 9, 4)]


def test_nulls_repeats_and_empty_table(make):
    rows = [(9, "a b c d e f"), (9, "a b c d e f"), (2, "A B c d e f"), (7, None), (8, ""), (1, "zz")]
    got = result(make(rows))
    assert got == [(1, 1, 1), (2, 2, 2), (7, 0, 7), (8, 0, 8), (9, 2, 2), (9, 2, 2)]
    assert result(make([])) == []


def test_shingle_sets_match_their_definition():
    rng = np.random.default_rng(1)
    for _ in range(200):
        a, b = (" ".join(rng.choice(["A", "b", "é", "\n", "C!", "ß"], size=rng.integers(0, 30))) for _ in range(2))
        x, y = shingle_set(a), shingle_set(b)
        assert len(x) == len(shingles(a))
        assert overlap(x, y) == len(shingles(a) & shingles(b))


def test_needed_overlap_is_a_bound(spark):
    rows = spark.range(1, 400).select("id", J._shown(J.F.col("id")).alias("shown"), J._need(J.F.col("id")).alias("need")).collect()
    shown = {r["id"]: r["shown"] for r in rows}
    need = {r["id"]: r["need"] for r in rows}
    for n in range(1, 300):
        partners = range(-(-3 * n // 4), min(399, 4 * n // 3) + 1)
        assert need[n] <= min(shown[m] - m // 4 for m in [*partners, n])


def test_components_of_chains_hubs_and_loops(spark):
    edges = [(f"{i:03}", f"{i + 1:03}") for i in range(0, 60)] + [("500", f"{i}") for i in range(600, 640)] + [("900", "900"), (None, "7")]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert {got[f"{i:03}"] for i in range(61)} == {"000"} and {got[str(i)] for i in range(600, 640)} == {"500"}
    assert "900" not in got


def test_components_of_long_chains_in_random_order(spark):
    names = [hashlib.sha256(str(i).encode()).hexdigest()[:32] for i in range(2500)]
    edges = [(names[i], names[i + 1]) for i in range(2499) if i != 1499]  # 1500 and 1000 nodes
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a string, b string")).collect()}
    first, second = min(names[:1500]), min(names[1500:])
    assert got == {**dict.fromkeys(names[:1500], first), **dict.fromkeys(names[1500:], second)}


def test_many_copies_and_repeated_rows_are_one_set(make, prose, monkeypatch):
    """A text that a third of all rows hold, with and without ids of its own, and its near copies."""
    monkeypatch.setattr(J, "_SEEN", 0)  # every row shows its shingles
    base = prose[0][1]
    near = [(2000 + k, " ".join([*base.split()[:-1], f"end{k}"])) for k in range(5)]
    rows = [*prose[:40], *((3000 + k // 2, base) for k in range(60)), *near]
    assert result(make(rows)) == brute(rows)
    monkeypatch.setattr(J, "BROADCAST_ROWS", 0)
    assert result(make(rows)) == brute(rows)
